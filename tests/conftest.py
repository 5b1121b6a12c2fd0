import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))


@pytest.fixture(scope="session")
def spark():
    from colloquy.session import local_session

    session = local_session(4, 4)
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture()
def run_one(spark):
    """Evaluate a column over one text value."""
    from pyspark.sql import functions as F

    def run(make, *values):
        df = spark.createDataFrame([tuple(values)], [f"c{i}" for i in range(len(values))])
        return df.select(make(*[F.col(f"c{i}") for i in range(len(values))]).alias("o")).first()["o"]

    return run
