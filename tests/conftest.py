import os
import sys
from pathlib import Path

import pytest

REPO = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, REPO)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [REPO, os.environ.get("PYTHONPATH")]))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for table in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return con


def rows_of(frame):
    """Sorted rows with columns by name; values as text."""
    columns = sorted(frame.columns)

    def text(v):
        if v is None or v != v:
            return "null"
        return f"{float(v):.9g}" if isinstance(v, float) else str(v)

    return sorted("|".join(text(v) for v in row) for row in frame[columns].itertuples(index=False))


@pytest.fixture(scope="session")
def same(spark, duck):
    """Assert that a query's rows are those of its SQL."""

    def check(query, sql):
        got, want = query(spark, SF).toPandas(), duck.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        # integers with nulls come as floats on one side
        for c in got.columns:
            if str(want[c].dtype).startswith("Int") or str(got[c].dtype) == "float64" and str(want[c].dtype).startswith("int"):
                got[c], want[c] = got[c].astype("Int64").astype("object"), want[c].astype("Int64").astype("object")
                got[c], want[c] = got[c].where(got[c].notna(), None), want[c].where(want[c].notna(), None)
        assert rows_of(got) == rows_of(want)

    return check
