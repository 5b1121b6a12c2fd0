"""The entry point without the training-data part, or without its pipeline."""

import json
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
ASK = "import json, __spark_entry__ as e; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"


def names(folder):
    done = subprocess.run([sys.executable, "-c", ASK], cwd=folder, capture_output=True, text=True, check=True, timeout=300)
    return json.loads(done.stdout.splitlines()[-1])


@pytest.mark.parametrize("gone", [("colloquy/llm", "corpus_pipeline.py"), ("colloquy/llm",), ("corpus_pipeline.py",)])
def test_entry_point_imports_without(tmp_path, gone):
    from colloquy.catalog.everything import REGISTRY

    copy = tmp_path / "copy"
    skip = [Path(g).name for g in gone if "." not in g] + ["__pycache__"]
    shutil.copytree(ROOT / "colloquy", copy / "colloquy", ignore=shutil.ignore_patterns(*skip))
    for file in ("__spark_entry__.py", "corpus_pipeline.py"):
        if file not in gone and (ROOT / file).exists():
            shutil.copy(ROOT / file, copy)
    queries, oracles = names(copy)
    assert set(REGISTRY) <= set(queries) and "pipeline" not in queries
    assert {n for n, e in REGISTRY.items() if e.sql} <= set(oracles)
    if "colloquy/llm" in gone:
        assert set(queries) == set(REGISTRY)


def test_nothing_else_imports_the_part():
    for file in (ROOT / "colloquy").rglob("*.py"):
        if "llm" not in file.relative_to(ROOT).parts:
            assert "colloquy.llm" not in file.read_text(), file
