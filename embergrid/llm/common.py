"""Shared helpers of the text operators: table access, row maps over Arrow batches, lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; only Spark opens the path, so any store that Spark reads will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_texts(
    df: DataFrame,
    fn: Callable[[list[str | None]], dict[str, pa.Array]],
    outputs: T.StructType,
    text_col: str = "text",
    carry: Iterable[str] = ("doc_id",),
    drop_unless: str | None = None,
    slice_bytes: int = 8 << 20,
) -> DataFrame:
    """Apply ``fn`` to the texts of each Arrow batch and append the columns that it returns.

    ``carry`` columns pass through untouched; where one has the name of an output, the output wins. Batches are cut
    again by text volume, so that a run of very long texts does not sit in memory at once. With ``drop_unless`` only
    rows whose boolean output of that name is true are returned.
    """
    names = [f.name for f in outputs]
    carried = [c for c in dict.fromkeys(carry) if c not in names]
    fields = [df.schema[c] for c in carried] + list(outputs)
    source = df.select(*[F.col(f"`{c}`") for c in carried], F.col(f"`{text_col}`").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, slice_bytes):
                made = fn(part.column("__text").to_pylist())
                arrays = [part.column(c) for c in carried] + [made[n] for n in names]
                out = pa.RecordBatch.from_arrays(arrays, names=carried + names)
                if drop_unless is not None:
                    out = out.filter(out.column(drop_unless))
                yield out

    return source.mapInArrow(run, T.StructType(fields))


def _slices(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``most`` bytes (one row at least)."""
    if batch.num_rows == 0:
        return
    rows = max(1, min(batch.num_rows, batch.num_rows * most // max(1, batch.nbytes)))
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; where it is unset, a temporary one of a local master, and of no cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='embergrid-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root


_SCRATCH: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def cut(df: DataFrame, keep: bool = False) -> DataFrame:
    """Materialise once as Parquet in the shared folder; readers prune columns and survive lost executors. Within
    ``scratch()`` the folder goes at its end, unless it is to be kept."""
    path = f"{checkpoint_root(df.sparkSession).rstrip('/')}/cut-{uuid.uuid4().hex}"
    held = _SCRATCH.get()
    if held is not None and not keep:
        held.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch():
    """Delete what ``cut`` writes inside, as soon as the result is written (with ``keep``)."""
    token = _SCRATCH.set(paths := [])
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        spark = SparkSession.getActiveSession()
        for path in paths if spark else ():
            to = spark._jvm.org.apache.hadoop.fs.Path(path)
            to.getFileSystem(spark._jsc.hadoopConfiguration()).delete(to, True)


#: A key with more than a HOT-th of all rows (LEAST_HOT at least) is dealt over several tasks.
HOT, LEAST_HOT = 1024, 64


def hot_keys(rows: DataFrame, key: str, total: int, n: Column | None = None) -> DataFrame:
    """Keys of more than ``total / HOT`` rows, fewer than HOT of them, with the number of parts to cut each into."""
    most = max(total // HOT, LEAST_HOT)
    counted = rows.groupBy(key).agg((F.sum(n) if n is not None else F.count("*")).alias("__n"))
    return counted.where(F.col("__n") > most).select(key, F.ceil(F.col("__n") / most).cast("int").alias("__parts"))


def salted_join(rows: DataFrame, few: DataFrame, key: str, hot: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """Join on ``key`` where ``few`` has one row a key and a hot key's ``rows`` spread over as many parts as it has."""
    h = F.broadcast(hot)
    left = rows.join(h, key, "left").withColumn("__part", F.coalesce(F.pmod(F.xxhash64(*by), F.col("__parts")), F.lit(0)).cast("int")).drop("__parts")
    right = few.join(h, key, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts")
    return left.join(right, [key, "__part"], how).drop("__part")


def smallest_per_group(df: DataFrame, group: str, order: list, n: int) -> DataFrame:
    """The first ``n`` rows of each group; Spark limits the groups in each task before it shuffles them."""
    from pyspark.sql import Window

    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


def crc_of_id(col: str = "doc_id"):
    """crc32 of the id written as text, as the held-out folds are defined."""
    return F.crc32(F.col(col).cast("string").cast("binary"))
