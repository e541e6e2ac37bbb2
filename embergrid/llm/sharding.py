"""Operator 10: shards by best-fit-decreasing bin packing of indivisible groups.

Rows of equal text form a group. Groups are counted by size class; the classes, a bounded number, are packed in
descending order on the driver, each group into the fullest shard that still takes it (a balanced order of remaining
capacities; many equal groups go in one step, which places them as one by one). The smallest capacity for which all
groups fit in the given shards is searched for. The placement goes back to the rows by ranks within size classes.

Defined cases: a null text has size 8 and crc 0, as an empty one, and falls in its group; no group is ever cut, so that one
larger than a fair share of all bytes makes its shard as large as itself; groups of one size class are placed in the order
of their digests; an empty table has no rows; repeated rows each get a slot; very long texts are read only for their size
and digests; a carried column gives way to an output of the same name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from embergrid.llm.common import cut, hot_keys, salted_join

EXACT = 4096  # sizes up to here are classes of their own; above, classes are 1/4096 wide


def size_class(size):
    """The size rounded up to twelve significant bits: at most some hundred thousand classes whatever the data hold."""
    bits = F.greatest(F.lit(0), F.length(F.bin(size)) - 12)
    return F.when(size <= EXACT, size).otherwise(F.shiftleft(F.lit(1).cast("long"), 0) * F.ceil(size / F.pow(F.lit(2.0), bits)) * F.pow(F.lit(2.0), bits)).cast("long")


class Rooms:
    """Remaining capacities as a balanced search tree (a treap) of (room, shard)."""

    def __init__(self, rooms):
        self.root = None
        for room in rooms:
            self.add(room)

    def _split(self, node, key):
        """What sorts before ``key``, and the rest."""
        if node is None:
            return None, None
        of, rank, left, right = node
        if of < key:
            low, high = self._split(right, key)
            return (of, rank, left, low), high
        low, high = self._split(left, key)
        return low, (of, rank, high, right)

    def _join(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            return a[0], a[1], a[2], self._join(a[3], b)
        return b[0], b[1], self._join(a, b[2]), b[3]

    def add(self, room: tuple[int, int]) -> None:
        low, high = self._split(self.root, room)
        rank = (room[1] + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF  # a shard keeps its random rank
        self.root = self._join(self._join(low, (room, rank, None, None)), high)

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return the tightest room of at least ``size``."""
        low, high = self._split(self.root, (size, -1))
        if high is None:
            return None
        node = high
        while node[2] is not None:
            node = node[2]
        self.root = self._join(low, self._split(high, (node[0][0], node[0][1] + 1))[1])
        return node[0]


def best_fit(classes: list[tuple[int, int]], shards: int, capacity: int) -> list[list[tuple[int, int]]] | None:
    """Per class (size, count), in the order given (descending), the runs (shard, count); None if they don't fit."""
    free = Rooms((capacity, s) for s in range(shards))
    out = []
    for size, count in classes:
        runs = []
        while count:
            if (tightest := free.take(size)) is None:
                return None
            room, shard = tightest
            n = min(count, room // size)
            runs.append((shard, n))
            count -= n
            free.add((room - n * size, shard))
        out.append(runs)
    return out


def pack(classes: list[tuple[int, int]], shards: int) -> list[list[tuple[int, int]]]:
    """Best fit decreasing at the least capacity found by bisection to a ten-thousandth.

    A group above a fair share of what is left has a shard to itself; the others share the remaining shards.
    """
    alone, left, total = [], shards, sum(s * n for s, n in classes)
    for i, (size, count) in enumerate(classes):
        runs = []
        while len(runs) < count and left > 1 and size * left > total:
            left, total = left - 1, total - size
            runs.append((left, 1))
        alone.append(runs)
        if len(runs) < count:
            break
    first = len(alone) - 1
    rest = [(s, n - (len(alone[i]) if i <= first else 0)) for i, (s, n) in enumerate(classes)]
    low = max(-(-total // left), *(s for s, n in rest if n), 1)
    high, step = low, max(1, low // 10_000)
    while (found := best_fit(rest, left, high)) is None:
        high, step = high + step, step * 2
    low = high - step // 2 if high > low else low
    while high - low > max(1, total // left // 10_000):
        mid = (low + high) // 2
        got = best_fit(rest, left, mid)
        low, high, found = (low, mid, got) if got is not None else (mid, high, found)
    return [(alone[i] if i <= first else []) + runs for i, runs in enumerate(found)]


def shard(df: DataFrame, shards: int = 24, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",), rows_per_block: int = 20_000) -> DataFrame:
    """Append size, text_crc32, law, shard, slot and grown_shard.

    Shuffles carry ids and digests, never texts. Group totals are pre-aggregated; ranks within classes and slots within
    shards are counted in salted blocks, so no task holds a class or a shard.
    """
    spark = df.sparkSession
    outs = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    names = [c for c in dict.fromkeys(carry) if c not in outs]
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = cut(
        df.select(
            *[F.col(f"`{c}`") for c in names],
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.substring(F.unhex(F.sha2(text, 256)), 1, 16).alias("__key"),
            F.xxhash64(*[F.col(f"`{c}`") for c in names], F.monotonically_increasing_id()).alias("__salt"),
        )
    )
    n_rows = rows.count()
    groups = rows.groupBy("__key").agg(F.sum("size").alias("__bytes"), F.count("*").alias("__rows"))
    blocks = max(1, n_rows // rows_per_block)
    groups = cut(groups.select("__key", "__rows", size_class(F.col("__bytes")).alias("__class"), F.pmod(F.xxhash64("__key"), F.lit(blocks)).alias("__block")))
    counts = groups.groupBy("__class", "__block").agg(F.count("*").alias("__n"))
    classes = [(r[0], r[1]) for r in groups.groupBy("__class").agg(F.count("*").alias("n")).orderBy(F.desc("__class")).collect()]
    runs = []
    for (size, _), of in zip(classes, pack(classes, shards), strict=True):
        first = 0
        for s, n in of:
            runs.append((size, first, first + n, s))
            first += n
    placed = spark.createDataFrame(runs, "__class long, __from long, __to long, shard int")
    before = Window.partitionBy("__class").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__first", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    in_block = Window.partitionBy("__class", "__block").orderBy("__key")
    ranked = groups.drop("__rows").withColumn("__at", F.row_number().over(in_block) - 1).join(offsets, ["__class", "__block"])
    ranked = ranked.withColumn("__rank", F.col("__first") + F.col("__at")).drop("__block", "__first", "__at")
    # runs of a class are disjoint: each group meets its own one
    home = ranked.join(placed, "__class").where((F.col("__rank") >= F.col("__from")) & (F.col("__rank") < F.col("__to"))).select("__key", "shard")
    out = salted_join(rows, home, "__key", hot_keys(groups, "__key", n_rows, F.col("__rows")), ["__salt"])
    out = out.withColumn("__block", F.pmod("__salt", F.lit(max(1, blocks // shards + 1) * 4)))
    out = cut(out.select(*names, "size", "text_crc32", "shard", "__block", "__salt"))
    per_block = out.groupBy("shard", "__block").agg(F.count("*").alias("__n"))
    w = Window.partitionBy("shard").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    firsts = per_block.select("shard", "__block", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__first"))
    slots = Window.partitionBy("shard", "__block").orderBy(*names, "__salt")
    return (
        out.withColumn("__at", F.row_number().over(slots) - 1)
        .join(firsts, ["shard", "__block"])
        .select(*names, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("__first") + F.col("__at")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
