import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + ":" + os.environ.get("PYTHONPATH", "")

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", "file://" + str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"create view {t} as from '{DATA}/{t}.parquet'")
    return c


def _plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.fixture(scope="session")
def same(spark, duck):
    """Compare a query with its SQL on the smallest tables."""

    def check(f, sql):
        df = f(spark, DATA)
        names = sorted(df.columns)
        mine = sorted((tuple(_plain(r[n]) for n in names) for r in df.collect()), key=str)
        q = duck.sql(sql)
        assert sorted(q.columns) == names
        at = [q.columns.index(n) for n in names]
        theirs = sorted((tuple(_plain(r[i]) for i in at) for r in q.fetchall()), key=str)
        assert mine == theirs

    return check
