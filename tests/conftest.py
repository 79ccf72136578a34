"""One local session for all tests, and DuckDB over the same tables."""

import os
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), os.environ.get("PYTHONPATH", "")])
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for name in sorted(os.listdir(sf_dir)):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def _plain(v):
    if isinstance(v, float):
        return round(v, 9)
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19]
    return v


@pytest.fixture(scope="session")
def same_rows(duck):
    """Asserts that a DataFrame has the rows and columns of a SQL query."""

    def check(df, sql):
        result = duck.execute(sql)
        names = [d[0] for d in result.description]
        assert sorted(names) == sorted(df.columns)
        want = sorted(repr(tuple(_plain(r[names.index(c)]) for c in sorted(names))) for r in result.fetchall())
        got = sorted(repr(tuple(_plain(r[c]) for c in sorted(names))) for r in df.collect())
        assert got == want

    return check
