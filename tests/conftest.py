"""One local session for all tests; Python workers find the repository."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import pandas as pd
import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

from pyspark.sql import SparkSession  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = (
        SparkSession.builder.master("local[4]").appName("embergrid-tests").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "3g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.checkpoint.dir", f"file://{shared}")
        .config("spark.local.dir", str(tmp_path_factory.mktemp("local"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def rows(df) -> list[tuple]:
    """Rows of a pandas frame, columns by name, values as comparable text."""
    def text(v):
        if v is None or (not hasattr(v, "__len__") and pd.isna(v)):
            return "null"
        if isinstance(v, float):  # whole numbers of a column with nulls, too
            return str(int(v)) if v.is_integer() else f"{v:.6g}"
        return str(v)

    return sorted(tuple(text(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="session")
def same_as_sql(spark, sf, duck):
    def check(query, sql):
        a, b = query(spark, sf).toPandas(), duck.execute(sql).df()
        assert sorted(a.columns) == sorted(b.columns)
        assert rows(a) == rows(b)

    return check
