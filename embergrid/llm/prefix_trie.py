"""Operator 11: the trie of conversation prefixes, in node tables behind minimal perfect hashes.

A prefix is named by 128 bits: every turn (role and text) is an affine map of two 64-bit numbers, made of its MD5, and the
maps of a prefix follow one another. Maps compose in any grouping, so sorted ranges of rows are folded apart and joined by one
row a range: a conversation may be of any length.

Pieces of conversations (``BLOCK`` depths each) are dealt over shards of bounded size. A shard enumerates its distinct
prefixes, gives each a slot by a minimal perfect hash, checks every lookup against the slot's own digest, depth, parent
and last text's size, and scatters counts into flat arrays; what shards say of a node is summed. In a second round each
node's own values (is it a leaf, what does it save) go to the shard that holds its smallest member's path and are accumulated
there through the array of parent slots, deepest first; what lies in later blocks of that path enters at the block's last
node. Sums over shards are sums over subtrees.

Defined cases: rows without a conv_id belong to no conversation; a null turn comes first, and rows of one turn come in the
order of the MD5 of role and text (equal rows are interchangeable and both count); null roles and texts are empty; a
conversation whose turns all gave way to an absent head is a member of the root alone; two prefixes of one digest stop
the run; an empty table has no node; extra columns are not read; texts enter whole, however long. The digest of a node's
ends is of one running text by definition: ids are packed by sorted ranges first, and one task streams the packs of a node.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from embergrid.llm.common import HOT, LEAST_HOT, cut, salted_join, scratch
from embergrid.llm.near_dedup import mix

#: Rows of a shard, depths of a block, and ids of a pack.
SHARD, BLOCK, PACK = 1 << 16, 1 << 14, 1 << 12
#: Where every prefix starts: the digest of the root.
ROOT = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_ALL = (1 << 64) - 1
_MAPS = ("a1", "b1", "a2", "b2")
_WAS = ("p1", "q1", "p2", "q2")
_KEY = "a long, b long"


def _long(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def turn_maps(md5: list[bytes]) -> list[np.ndarray]:
    """Slope (odd) and offset of each turn's map, for the two numbers."""
    halves = np.frombuffer(b"".join(md5), "<u8").reshape(-1, 2)
    return [m for h in (halves[:, 0], halves[:, 1]) for m in (mix(h) | np.uint64(1), mix(~h))]


def scan(maps: list[np.ndarray], start: np.ndarray) -> list[np.ndarray]:
    """Each row's maps since its run's start composed, in steps of doubled reach; ``start`` is the first row of the run."""
    a1, b1, a2, b2 = (m.copy() for m in maps)
    far, reach = np.arange(len(start)) - start, 1
    while (i := np.flatnonzero(far >= reach)).size:
        j = i - reach
        b1[i], b2[i] = a1[i] * b1[j] + b1[i], a2[i] * b2[j] + b2[i]
        a1[i], a2[i] = a1[i] * a1[j], a2[i] * a2[j]
        reach *= 2
    return [a1, b1, a2, b2]


def _along(batches):
    """Sorted rows (conv_id, md5, ...): append the range, the place in the conversation's run and the run's maps up to each
    row and before it."""
    part = TaskContext.get().partitionId()
    key, n, held = None, 0, [1, 0, 1, 0]
    for batch in batches:
        conv = batch.column("conv_id").to_numpy()
        if not len(conv):
            continue
        new = np.concatenate([[conv[0] != key], conv[1:] != conv[:-1]])
        start = np.maximum.accumulate(np.where(new, np.arange(len(conv)), 0))
        maps = scan(turn_maps(batch.column("md5").to_pylist()), start)
        place = np.arange(len(conv)) - start
        before = [np.concatenate([m[:1], m[:-1]]) for m in maps]
        first = np.flatnonzero(place == 0)
        for m, one in zip(before, (1, 0, 1, 0), strict=True):
            m[first] = one
        if not new[0]:  # the run goes on from the last batch
            run = slice(0, int(np.argmax(new)) if new.any() else len(conv))
            place[run] += n
            c = np.array(held, np.uint64)
            for of in (maps, before):
                of[1][run], of[3][run] = of[0][run] * c[1] + of[1][run], of[2][run] * c[3] + of[3][run]
                of[0][run], of[2][run] = of[0][run] * c[0], of[2][run] * c[2]
        key, n, held = conv[-1], int(place[-1]) + 1, [int(m[-1]) for m in maps]
        made = [pa.array(np.full(len(conv), part, np.int32)), pa.array(place)] + [pa.array(m.view(np.int64)) for m in (*maps, *before)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, "part", "place", *_MAPS, *_WAS])


def along(rows: DataFrame, order: list[Column], kept: tuple[str, ...]) -> DataFrame:
    """Rows with their place in the conversation (from 0) and its prefix digests through them (a, b) and before them (pa, pb).

    Ranges of the sorted rows are folded apart; one summary row a range, some dozen bytes, passes through the driver.
    """
    long = lambda names: [T.StructField(c, T.LongType()) for c in names]
    schema = T.StructType([*rows.schema.fields, T.StructField("part", T.IntegerType()), *long(("place", *_MAPS, *_WAS))])
    # equal rows differ by a number of no meaning, so that a range never grows with their count
    dealt = rows.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange("conv_id", *order, "__tie")
    folded = cut(dealt.sortWithinPartitions("conv_id", *order, "__tie").drop("__tie").mapInArrow(_along, schema))
    last = F.max_by(F.struct("conv_id", "place", *_MAPS), F.struct("conv_id", "place"))
    offsets, key, n, at = {}, None, 0, ROOT
    for p in sorted(folded.groupBy("part").agg(F.min("conv_id").alias("first"), last.alias("last")).collect(), key=lambda r: r.part):
        if key == p.first:
            offsets[p.part] = (key, n, *at)
        if key != p.first or p.last.conv_id != p.first:
            n, at = 0, ROOT
        key, n = p.last.conv_id, n + p.last.place + 1
        at = tuple((p.last[a] * x + p.last[b]) & _ALL for a, b, x in (("a1", "b1", at[0]), ("a2", "b2", at[1])))
    def adjust(batches):
        for batch in batches:
            conv, part = batch.column("conv_id").to_numpy(), batch.column("part").to_numpy()
            place = batch.column("place").to_numpy().copy()
            from_ = np.tile(np.array([ROOT], np.uint64).T, len(conv))
            for k in np.unique(part).tolist():
                if k in offsets:
                    of, n, *at = offsets[k]
                    on = (part == k) & (conv == of)
                    place[on] += n
                    from_[:, on] = np.array([at], np.uint64).T
            m = {c: batch.column(c).to_numpy().view(np.uint64) for c in (*_MAPS, *_WAS)}
            made = [m["a1"] * from_[0] + m["b1"], m["a2"] * from_[1] + m["b2"], m["p1"] * from_[0] + m["q1"], m["p2"] * from_[1] + m["q2"]]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(place), *(pa.array(x.view(np.int64)) for x in made)], names=[*kept, "place", "a", "b", "pa", "pb"])

    return folded.mapInArrow(adjust, T.StructType([*(rows.schema[c] for c in kept), *long(("place", "a", "b", "pa", "pb"))]))


class Slots:
    """Minimal perfect hash of distinct keys: the keys that fall alone on a level's table stay there, the others go on to
    the next; a slot is a key's rank among all that stay. Lookups are checked, and unknown keys have no slot (-1)."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        left, before = np.arange(len(a)), 0
        while len(left):
            at = self._place(a[left], b[left], len(self.levels), 2 * len(left))
            alone = np.bincount(at, minlength=2 * len(left)) == 1
            self.levels.append((alone, before + np.cumsum(alone) - 1))
            left, before = left[~alone[at]], before + int(alone.sum())
        self.a, self.b = np.zeros_like(a), np.zeros_like(b)
        at = self._find(a, b)
        self.a[at], self.b[at] = a, b

    @staticmethod
    def _place(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(a.view(np.uint64) ^ mix(b.view(np.uint64) + np.uint64(level))) % np.uint64(size)).astype(np.int64)

    def _find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out, todo = np.full(len(a), -1), np.arange(len(a))
        for level, (alone, rank) in enumerate(self.levels):
            at = self._place(a[todo], b[todo], level, len(alone))
            hit = alone[at]
            out[todo[hit]] = rank[at[hit]]
            todo = todo[~hit]
        return out

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        at = self._find(a, b)
        if len(self.a):
            at[(at >= 0) & ((self.a[at] != a) | (self.b[at] != b))] = -1
        return at


class Table:
    """One shard's nodes: slots, and flat arrays of depth, parent and the last text's size."""

    def __init__(self, col: dict[str, np.ndarray]):
        order = np.lexsort((col["b"], col["a"]))
        a, b = col["a"][order], col["b"][order]
        first = np.ones(len(a), bool)
        first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        self.slots = Slots(a[first], b[first])
        self.at = self.slots.of(col["a"], col["b"])
        self.size = int(first.sum())
        self.of = {}
        for c in ("depth", "pa", "pb", "bytes"):
            self.of[c] = np.zeros(self.size, np.int64)
            self.of[c][self.at] = col[c]
            if not np.array_equal(self.of[c][self.at], col[c]):
                raise ValueError("two prefixes share a digest")

    def parents(self, block: int) -> np.ndarray:
        """The parent's slot, -1 for the first node of a block."""
        return np.where(self.of["depth"] % block == 0, -1, self.slots.of(self.of["pa"], self.of["pb"]))

    def accumulate(self, values: list[np.ndarray], block: int) -> None:
        """Add every node's values to its parent's, deepest nodes first."""
        parent, depth = self.parents(block), self.of["depth"]
        order = np.argsort(-depth, kind="stable")
        order = order[parent[order] >= 0]
        for level in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1):
            for v in values:
                np.add.at(v, parent[level], v[level])


def _columns(t: pa.Table, names) -> dict[str, np.ndarray]:
    return {c: t.column(c).to_numpy() for c in names}


def _count(t: pa.Table) -> pa.Table:
    """A shard's nodes with their members here and the smallest one."""
    col = _columns(t, ("conv_id", "depth", "a", "b", "pa", "pb", "bytes"))
    nodes = Table(col)
    least = np.full(nodes.size, np.iinfo(np.int64).max)
    np.minimum.at(least, nodes.at, col["conv_id"])
    return pa.table({"a": nodes.slots.a, "b": nodes.slots.b, **nodes.of, "n": np.bincount(nodes.at, minlength=nodes.size), "conv_id": least})


def _sum(t: pa.Table, block: int) -> pa.Table:
    """A shard's part of the subtree sums: path rows (leaves null) make the table, the others carry values."""
    path = t.filter(t.column("leaves").is_null())
    given = t.filter(t.column("leaves").is_valid())
    nodes = Table(_columns(path, ("depth", "a", "b", "pa", "pb", "bytes")))
    v = _columns(given, ("a", "b", "leaves", "saved"))
    at = nodes.slots.of(v["a"], v["b"])
    if (at < 0).any():
        raise ValueError("a value without its path")
    sums = [np.zeros(nodes.size, np.int64) for _ in range(2)]
    for s, c in zip(sums, ("leaves", "saved"), strict=True):
        np.add.at(s, at, v[c])
    nodes.accumulate(sums, block)
    some = (sums[0] != 0) | (sums[1] != 0)
    return pa.table({"a": nodes.slots.a[some], "b": nodes.slots.b[some], "leaves": sums[0][some], "saved": sums[1][some]})


def rebuilt(conversations: DataFrame, heads: int = 9, every: int = 5) -> tuple[DataFrame, DataFrame]:
    """Turns of the rebuilt conversations (conv_id, src, pos, md5, bytes), and all conv_ids.

    Conversation c takes the first h turns of c - c % every, h being the CRC-32 of c modulo ``heads``, then its own after
    its first h.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    md5 = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", md5.alias("md5"), F.octet_length(text).cast("long").alias("bytes"))
    placed = cut(along(turns, [F.asc_nulls_first("turn"), F.col("md5")], ("conv_id", "md5", "bytes")).select("conv_id", F.col("place").alias("pos"), "md5", "bytes"))
    taken = lambda c: F.crc32(F.col(c).cast("string").cast("binary")) % heads
    convs = placed.select("conv_id").distinct()
    own = placed.where(F.col("pos") >= taken("conv_id")).withColumn("src", F.lit(1))
    # a base has fewer than ``heads`` turns to give and fewer than 2 * every takers
    head = placed.where((F.col("pos") < heads - 1) & (F.col("conv_id") % every == 0)).withColumnRenamed("conv_id", "base")
    takers = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % every)
    given = head.join(takers, "base").where(F.col("pos") < taken("conv_id")).withColumn("src", F.lit(0))
    names = ("conv_id", "src", "pos", "md5", "bytes")
    return own.select(*names).unionByName(given.select(*names)), convs


def _packed(batches):
    """Sorted (a, b, conv_id): one row per node and some thousand ids, joined by commas."""
    for batch in batches:
        a, b, ids = (batch.column(c).to_numpy() for c in ("a", "b", "conv_id"))
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        cuts = np.union1d(np.flatnonzero(new), np.arange(0, len(a), PACK))
        text = [",".join(map(str, x.tolist())) for x in np.split(ids, cuts[1:])] if len(a) else []
        yield pa.RecordBatch.from_arrays([pa.array(a[cuts]), pa.array(b[cuts]), pa.array(ids[cuts]), pa.array(text, pa.string())], names=["a", "b", "least", "ids"])


def _hashed(batches):
    """Sorted packs: one digest a node, fed pack by pack."""
    key, h, done = None, None, ([], [], [])

    def close():
        for c, x in zip(done, (*key, h.hexdigest()), strict=True):
            c.append(x)

    def flush():
        out = pa.RecordBatch.from_arrays([pa.array(done[0], pa.int64()), pa.array(done[1], pa.int64()), pa.array(done[2], pa.string())], names=["a", "b", "ends_sha256"])
        for c in done:
            c.clear()
        return out

    for batch in batches:
        for a, b, ids in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "ids")), strict=True):
            if (a, b) != key:
                if h:
                    close()
                key, h = (a, b), hashlib.sha256()
            else:
                h.update(b",")
            h.update(ids.encode())
        if done[0]:
            yield flush()
    if h:
        close()
        yield flush()


def prefix_trie(conversations: DataFrame, size: int = SHARD, block: int = BLOCK) -> DataFrame:
    """One row per node of the trie of the rebuilt conversations; shards of about ``size`` rows, blocks of ``block`` depths."""
    with scratch():
        return cut(_nodes(conversations, size, block), keep=True)


def _nodes(conversations: DataFrame, size: int, block: int) -> DataFrame:
    turns, convs = rebuilt(conversations)
    path = along(turns, [F.col("src"), F.col("pos")], ("conv_id", "bytes")).select("conv_id", (F.col("place") + 1).alias("depth"), "a", "b", "pa", "pb", "bytes")
    root = [F.lit(_long(x)).cast("long") for x in ROOT]
    zero = F.lit(0).cast("long")
    path = cut(path.unionByName(convs.select("conv_id", zero.alias("depth"), root[0].alias("a"), root[1].alias("b"), zero.alias("pa"), zero.alias("pb"), zero.alias("bytes"))))
    rows = path.count()
    spark = conversations.sparkSession
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // size))
    at = ((F.col("depth") - F.col("depth") % block) / block).cast("long")
    shard = F.pmod(F.xxhash64("conv_id", at), F.lit(shards)).alias("shard")
    local = path.select("*", shard).groupBy("shard").applyInArrow(_count, f"{_KEY}, depth long, pa long, pb long, bytes long, n long, conv_id long")
    same = F.struct("depth", "pa", "pb", "bytes")
    nodes = cut(local.groupBy("a", "b").agg(F.min(same).alias("x"), F.max(same).alias("y"), F.sum("n").alias("n_convs"), F.min("conv_id").alias("conv_id")))
    if nodes.where("x != y").limit(1).count():
        raise ValueError("two prefixes share a digest")
    nodes = nodes.select("a", "b", "x.*", "n_convs", "conv_id")
    children = nodes.where("depth > 0").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("n_children"))
    nodes = cut(nodes.join(children, ["a", "b"], "left").withColumn("n_children", F.coalesce("n_children", zero)))
    value = nodes.select("conv_id", "depth", "a", "b", (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved")).where("leaves != 0 or saved != 0")
    # what later blocks of a path hold enters a block at its last node
    later = value.groupBy("conv_id", at.alias("block")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")).where("block > 0")
    ends_of_blocks = path.where(F.col("depth") % block == block - 1).select("conv_id", "depth", "a", "b", at.alias("at"))
    carried = ends_of_blocks.join(_suffix(later), ["conv_id", "at"]).select("conv_id", "depth", "a", "b", "leaves", "saved")
    null = F.lit(None).cast("long")
    names = ("shard", "depth", "a", "b", "pa", "pb", "bytes", "leaves", "saved")
    lines = path.select(shard, *names[1:7], null.alias("leaves"), null.alias("saved"))
    values = value.unionByName(carried).select(shard, "depth", "a", "b", zero.alias("pa"), zero.alias("pb"), zero.alias("bytes"), "leaves", "saved")
    sums = lines.unionByName(values).groupBy("shard").applyInArrow(lambda t: _sum(t, block), f"{_KEY}, leaves long, saved long").groupBy("a", "b").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    last = path.groupBy("conv_id").agg(F.max_by(F.struct("a", "b"), "depth").alias("x")).select("x.a", "x.b", "conv_id")
    packs = last.repartitionByRange("a", "b", "conv_id").sortWithinPartitions("a", "b", "conv_id").mapInArrow(_packed, f"{_KEY}, least long, ids string")
    ends = packs.repartition("a", "b").sortWithinPartitions("a", "b", "least").mapInArrow(_hashed, f"{_KEY}, ends_sha256 string")
    # a parent of many children is dealt over several tasks
    most = max(rows // HOT, LEAST_HOT)
    key = F.struct("a", "b")
    hot = nodes.where(F.col("n_children") > most).select(key.alias("parent"), F.ceil(F.col("n_children") / most).cast("int").alias("__parts"))
    full = nodes.join(sums, ["a", "b"]).join(ends, ["a", "b"], "left").withColumn("parent", F.when(F.col("depth") > 0, F.struct(F.col("pa").alias("a"), F.col("pb").alias("b"))))
    named = salted_join(full, nodes.select(key.alias("parent"), F.col("conv_id").alias("parent_conv_id")), "parent", hot, ["a", "b"], "left")
    none = hashlib.sha256(b"").hexdigest()
    return named.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def _suffix(later: DataFrame) -> DataFrame:
    """For every block of a path that has later ones: the sums over all those."""
    path = Window.partitionBy("conv_id")
    behind = path.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, 0)
    sums = later.select("conv_id", "block", F.sum("leaves").over(behind).alias("all_leaves"), F.sum("saved").over(behind).alias("all_saved"), F.lag("block").over(path.orderBy("block")).alias("before"))
    # blocks without values of their own pass on what comes behind them
    at = F.explode(F.sequence(F.coalesce("before", F.lit(0).cast("long")), F.col("block") - 1)).alias("at")
    return sums.select("conv_id", at, F.col("all_leaves").alias("leaves"), F.col("all_saved").alias("saved"))
