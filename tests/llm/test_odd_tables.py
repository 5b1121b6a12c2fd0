"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

import pytest
from colloquy.llm.everything import REGISTRY

CLASH = (
    "fp node key t1 t2 _row row data length piece host rule verdict _keys shard score _score start gram "
    "hot rows keep record payload rank block draw q media feature a b root least asked ids "
    "x component n deviation whitened bits part h1 h2 salt first_id parts low high good toxic_lost tie places"
)


def documents(texts, first=0):
    return [(first + i, t, "en", "src", len(t or "")) for i, t in enumerate(texts)]


LONG = "The quick brown fox and the lazy dog of the house. " * 4000
TEXTS = [None, "", "   \n", "one", "one", "two words", LONG, LONG, "é" * 500, "\u0000 a\u0001b", "<|endoftext|> x", "A b c d e f. " * 60]
DOCS = documents(TEXTS) + documents(TEXTS[:3]) + [(None, "nobody", None, None, None), (None, "nobody", None, None, None)]
PAGES = [
    (0, None, None), (1, "x", ""), (2, "http://", "<p>a"), (3, "HTTP://A.COM/en/x", f"<article><p>{LONG}</p></article>"),
    (3, "HTTP://A.COM/en/x", f"<article><p>{LONG}</p></article>"), (None, "ftp://b.net/de/1?q", "<p>a"), (None, "ftp://b.net/de/1?q", "<p>a"),
]
VECTORS = [
    (0, [1.0, 2.0], 1), (100, [1.0], 1), (100, [1.0], 1), (3, None, 1), (4, [], 1), (5, [float("nan"), 1.0], 1), (6, [float("inf")], 1),
    (7, [None, 1.0], 1), (None, [1.0, 1.0], 1), (8, [-3.5, 0.0], 1),
]
LABELS = [(i, i % 2, 0) for i in range(12)] + [(3, None, 0), (None, 1, 0), (3, 1, 1)]
ROWS = {"op1": len(PAGES), "op2": len(DOCS), "op3": len(DOCS), "op5": len(PAGES), "op7": len(PAGES), "op8": len(DOCS), "op9": len(DOCS), "op10": len(DOCS)}
# six usable vectors in two dimensions; the languages en and null
ROWS |= {"op11": len(DOCS), "op12": 6 * 2, "op13": 2 * 600}


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_empty_tables(spark, folder, name):
    assert REGISTRY[name].run(spark, folder()).count() == 0


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_odd_rows(spark, folder, name):
    run = REGISTRY[name].run
    found = run(spark, folder(CLASH, documents=DOCS, pages=PAGES, embeddings=VECTORS, labels=LABELS)).collect()
    number = name.split("_")[0]
    assert len(found) == ROWS.get(number, len(found))
    by_id = {}
    for row in found:
        by_id.setdefault(row[0], []).append(row)
    if number == "op2":
        empty = by_id[0][0]
        assert (empty["n_bytes"], empty["payload_bytes"]) == (0, 576)
        assert by_id[3][0]["feature"] == by_id[4][0]["feature"]
    if number == "op4":
        assert sum(r["length"] for r in by_id[0]) == 2  # a null text in each of two rows: the end id
    if number == "op6":
        asked = [(r["query_id"], r["vec_id"]) for r in found]
        assert len([a for a in asked if a[0] == 100]) == 2 * 3 and all(a != b for a, b in asked)
    if number == "op7":
        kinds = sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in found if r["page_id"] is not None)
        assert kinds == [(0, "revisit", 1), (1, "response", None), (2, "response", None), (3, "response", None), (3, "response", None)]
        assert [r["refers_to"] for r in by_id[None]] == [2, 2]
    if number == "op9":
        assert by_id[6][0]["n_removed"] == len(LONG) and by_id[9][0]["n_removed"] == 0
    if number == "op10":
        assert {r["fingerprint"] for r in by_id[0]} == {"0" * 16} and by_id[2][0]["component_id"] == 0
        assert {r["component_id"] for r in by_id[None]} == {None}


def test_pipeline(spark, folder):
    import corpus_pipeline

    docs = DOCS + documents([f"The cat number {i} of the house went to see what was left in field {i * 7}." for i in range(40)], 100)
    path = folder(CLASH, documents=docs, labels=[])
    last = None
    rows = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, rows, path)
        if name != "packing":
            assert after.columns == rows.columns
        last, rows = rows.count(), spark.createDataFrame(after.collect(), after.schema)
        assert rows.count() <= last or name == "packing"
        if name == "simhash near-dedup":
            kept = [r["text"] for r in rows.select("text").collect()]
            assert sum(t == "one" for t in kept) == 1 and sum(t == LONG for t in kept) == 1
            assert sum("cat number" in (t or "") for t in kept) == 40
    empty = spark.read.parquet(f"{path}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, path)
        assert empty.count() == 0
