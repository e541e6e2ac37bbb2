"""Operator 13: what five filters remove, alone and in every order, by an incremental stream with retractions.

All files of the table pass as available-now micro-batches. Four filters judge a text by itself; the fifth takes a text
for a copy if a smaller id has it anywhere, before or after. So each distinct text has a state: the least id so far and the
rows that hold it. Where a smaller id arrives, what was counted for the earlier holders is taken back and counted anew as
copies. Each micro-batch writes its changes to the counters of (part, failed filters) under its own number; their sums at
the end are the counts over the whole table, and all orders follow from them.

Rows of one task that share a text are condensed before they reach its state, so that a text that a third of all rows hold
sends a row per Arrow batch. Rows that can't hold the least id, and rows without an id, pass without touching the state.

Defined cases: a null text is an empty one; words are runs of characters other than space and control characters from tab to carriage
return; rows that share an id and a text are copies of smaller ids alone, not of each other; a null id is smaller than
none and no id is smaller than it, so such a row is no copy and makes none; a null part is the empty one; a document is labelled
if any of its label rows says so, and label rows without an id label none; texts are judged whole, however long; extra columns are not read; an empty
table has no parts and no rows.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter
from itertools import permutations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from embergrid.llm.common import checkpoint_root

FILTERS = "ABCDE"
COPY = 16  # the bit of the last filter
_SPACE = r"[\x20\x09-\x0D]+"
_DELTA = "part string, mask int, good boolean, toxic boolean, n long"
_HELD = "least long, holders string"  # holders: JSON of [part, good, toxic, rows]


def text_failures(text: Column, cut: Column) -> Column:
    """Bits of the filters that judge a text by itself: few words, few distinct words, many capitals, symbols. ``cut`` is the
    text split at runs of white space, with an empty first or last part where it begins or ends with one."""
    first, last = (F.element_at(cut, i) == "" for i in (1, -1))
    n = F.size(cut) - F.when(first, 1).otherwise(0) - F.when(last & (F.size(cut) > 1), 1).otherwise(0)
    distinct = F.size(F.array_distinct(cut)) - F.when(first | last, 1).otherwise(0)
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    bits = (n < 200, 100 * distinct < 50 * n, 100 * capitals > 3 * F.length(text), text.rlike("[#$%&*|]"))
    return sum((F.when(b, 1 << i).otherwise(0) for i, b in enumerate(bits)), F.lit(0)).cast("int")


def condense(batches):
    """One row for each text of an Arrow batch, kind of holder and whether it has the text's least id there."""
    for batch in batches:
        t = pa.Table.from_batches([batch])
        least = t.group_by("name").aggregate([("doc_id", "min")])
        t = t.join(least, "name")
        settled = pc.or_kleene(pc.is_null(t["doc_id"]), pc.greater(t["doc_id"], t["doc_id_min"]))
        mask = pc.if_else(pc.greater(t["doc_id"], t["doc_id_min"]), pc.bit_wise_or(t["mask"], pa.scalar(COPY, pa.int32())), t["mask"])
        t = t.drop_columns(["doc_id_min"]).set_column(t.schema.get_field_index("mask"), "mask", pc.coalesce(mask, t["mask"])).append_column("settled", settled)
        t = t.set_column(t.schema.get_field_index("doc_id"), "doc_id", pc.if_else(settled, pa.scalar(None, pa.int64()), t["doc_id"]))
        keys = ["name", "doc_id", "part", "mask", "good", "toxic", "settled"]
        out = t.group_by(keys).aggregate([([], "count_all")]).rename_columns([*keys, "n"])
        yield from out.select([*keys, "n"]).to_batches()


class LeastHolder(StatefulProcessor):
    """State of one text: its least id and the rows that hold it, by part and labels."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", _HELD)

    def handleInputRows(self, key, rows, timerValues):
        change: Counter = Counter()
        state, touched = self.held.get(), False
        least, holders = (state[0], Counter({(part, good, toxic): n for part, good, toxic, n in json.loads(state[1])})) if state else (None, Counter())
        for r in rows:
            who = (r.part, r.good, r.toxic)
            if r.settled:
                change[r.part, r.mask, r.good, r.toxic] += r.n
            elif least is None or r.doc_id < least:
                for (part, good, toxic), n in holders.items():  # they are copies now
                    change[part, r.mask, good, toxic] -= n
                    change[part, r.mask | COPY, good, toxic] += n
                least, holders, touched = r.doc_id, Counter({who: r.n}), True
                change[r.part, r.mask, r.good, r.toxic] += r.n
            elif r.doc_id == least:
                holders[who] += r.n
                touched = True
                change[r.part, r.mask, r.good, r.toxic] += r.n
            else:
                change[r.part, r.mask | COPY, r.good, r.toxic] += r.n
        if touched:
            self.held.update((least, json.dumps([(*who, n) for who, n in holders.items()])))
        for (part, mask, good, toxic), n in change.items():
            if n:
                yield Row(part=part, mask=mask, good=good, toxic=toxic, n=n)

    def close(self) -> None:
        pass


def filter_counters(spark: SparkSession, documents: str, labels: DataFrame, batches: int = 4, folder: str | None = None) -> DataFrame:
    """(part, mask, good, toxic, n) over all documents: rows by the set of filters that they fail.

    The files under the path ``documents`` are dealt over about ``batches`` micro-batches; state, progress and counters are in
    ``folder`` (a new one in the shared folder if none is given), where a run that was stopped goes on and later files are added.
    """
    schema = spark.read.parquet(documents).select("doc_id", "text", "lang").schema
    folder = folder or f"{checkpoint_root(spark).rstrip('/')}/audit-{uuid.uuid4().hex}"
    files = len(spark.read.schema(schema).parquet(documents).inputFiles())
    # as a pattern, the path may name a single file, too
    docs = spark.readStream.schema(schema).option("maxFilesPerTrigger", max(1, -(-files // batches))).parquet(f"{documents[:-1]}[{documents[-1]}]")
    text = F.coalesce("text", F.lit(""))
    parts = docs.select("doc_id", "lang", text.alias("text"), F.split(text, _SPACE).alias("cut"))  # split once
    judged = parts.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2("text", 256).alias("name"), F.coalesce("lang", F.lit("")).alias("part"), text_failures(F.col("text"), F.col("cut")).alias("mask"))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.bool_or(F.col("quality") == 1).alias("good"), F.bool_or(F.col("toxic") == 1).alias("toxic"))
    joined = judged.join(known, "doc_id", "left").select("name", "doc_id", "part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    short = joined.mapInArrow(condense, "name string, doc_id long, part string, mask int, good boolean, toxic boolean, settled boolean, n long")
    changes = short.groupBy("name").transformWithState(LeastHolder(), _DELTA, "Update", "None")

    def store(batch: DataFrame, number: int) -> None:
        sums = batch.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n")).where("n != 0")
        sums.coalesce(1).write.mode("overwrite").parquet(f"{folder}/changes/batch={number}")

    # one state partition a core (a stored run keeps its own number); only the changes of its state are written with each
    # batch, no space is reserved beforehand for each partition's logs, and an executor's partitions share their memory
    needed = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
        "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
        "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
        "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
        "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
        "spark.sql.shuffle.partitions": str(spark.sparkContext.defaultParallelism),
    }
    before = {k: spark.conf.get(k, None) for k in needed}
    for k, v in needed.items():
        spark.conf.set(k, v)
    try:
        run = changes.writeStream.foreachBatch(store).outputMode("update").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    stored = spark.read.schema(_DELTA).parquet(f"{folder}/changes")
    return stored.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n")).where("n != 0")


def interactions(counters: DataFrame, filters: str = FILTERS) -> DataFrame:
    """All orders of the filters, step by step, from the counters: one row per part, order and step."""
    orders = ["".join(p) for p in permutations(filters)]
    steps = F.explode(F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(k + 1).alias("step")) for o in orders for k in range(len(filters))])).alias("s")
    bit = F.pow(F.lit(2), F.instr(F.lit(filters), F.substr(F.col("s.filter_order"), F.col("s.step"), F.lit(1))) - 1).cast("int")
    before = sum((F.when(F.substr(F.col("s.filter_order"), F.lit(i), F.lit(1)) == f, F.when(F.col("s.step") > i, 1 << k).otherwise(0)).otherwise(0) for i in range(1, len(filters) + 1) for k, f in enumerate(filters)), F.lit(0))
    rows = counters.select("*", steps).select("*", bit.alias("bit"), before.alias("before"))
    fails, gone = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    share = F.when(fails, F.col("n") * len(orders) / F.bit_count("mask"))  # of all orders, those in which it comes first of what the row fails
    return rows.groupBy("part", F.col("s.filter_order").alias("filter_order"), F.col("s.step").alias("step")).agg(
        count(~fails & ~gone).alias("kept"), count(fails & ~gone).alias("removed"), count(fails & gone).alias("redundant"), count(F.col("mask") == F.col("bit")).alias("unique_fails"),
        count(fails & ~gone & F.col("good")).alias("good_lost"), count(fails & ~gone & F.col("toxic")).alias("toxic_lost"), F.coalesce(F.sum(share), F.lit(0)).cast("long").alias("shapley"),
    )


def filter_audit(spark: SparkSession, documents: str, labels: DataFrame, batches: int = 4) -> DataFrame:
    """The audit of the table under the path ``documents`` with the labels of its documents."""
    return interactions(filter_counters(spark, documents, labels, batches))
