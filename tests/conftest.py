import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck(small):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in Path(small).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


@pytest.fixture(scope="session")
def same():
    """Whether two pandas frames hold the same rows in any order, numbers to nine digits."""

    def rows(frame):
        frame = frame[sorted(frame.columns)]

        def cell(v):
            if v is None or v != v:
                return "null"
            return repr(round(float(v), 9)) if isinstance(v, float) else str(v)

        return sorted(tuple(cell(v) for v in r) for r in frame.itertuples(index=False))

    return lambda a, b: sorted(a.columns) == sorted(b.columns) and rows(a) == rows(b)
