"""Table access and lineage cuts of the hotspot engine."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write once in the shared folder of spark.checkpoint.dir (where it is unset, a temporary one of a local master, and
    of no cluster) and read again."""
    conf = df.sparkSession.conf
    root = conf.get("spark.checkpoint.dir", None)
    if not root:
        if not df.sparkSession.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='embergrid-')}"
        conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
