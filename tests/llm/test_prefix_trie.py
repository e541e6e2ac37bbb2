"""Operator 11 against a plain trie, its hash tables and its folded ranges by themselves."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from embergrid.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn int, role string, text string"


def plain(rows):
    """Nodes of the rebuilt conversations by dictionaries."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    seqs = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        seqs[c] = tuple(x[3:] for x in sorted(own.get(base, []))[:h] + sorted(own[c])[h:])
    nodes = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            nodes.setdefault(s[:d], []).append(c)
    out = []
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        kids = [q for q in below if len(q) == len(p) + 1]
        leaves = [q for q in below if not any(len(r) == len(q) + 1 and r[:-1] == q for r in below)]
        saved = sum((len(nodes[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        ends = ",".join(map(str, sorted(c for c in members if len(seqs[c]) == len(p))))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def made():
    rnd = random.Random(11)
    some = ["a", "b", "é", "", None, "longer text"]
    rows = [(rnd.choice([-7, -5, -3, 0, 1, 2, 3, 4, 5, 8, 9, 11, 17]), rnd.choice([None, *range(12)]), rnd.choice(["user", "assistant", None]), rnd.choice(some)) for _ in range(160)]
    rows += [(c, t, "user", f"same {t}") for c in (20, 21, 22, 40, 45, 46) for t in range(9)]
    rows += [(50, t, "u", "x") for t in range(40)] + [(55, t, "u", "x") for t in range(31)] + [(56, t, "u", "x") for t in range(40)]
    rows += [(60, 1, "u", "equal rows")] * 25 + [(None, 1, "u", "no conversation")] * 3 + [(78, 0, "u", "head absent"), (63, 0, None, None)]
    return rows


@pytest.mark.parametrize("size,block,partitions", [(pt.SHARD, pt.BLOCK, 1), (16, 4, 7), (40, 1, 3)])
def test_nodes_equal_a_plain_trie(spark, made, size, block, partitions):
    """Whole, and cut into small shards, short blocks and many ranges: conversations go over several of each."""
    df = spark.createDataFrame(made, SCHEMA).repartition(5)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert found(pt.prefix_trie(df, size, block)) == plain(made)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_empty_and_clashing_columns(spark):
    assert pt.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert pt.prefix_trie(spark.createDataFrame([(None, 1, "u", "t")], SCHEMA)).count() == 0
    rows = [(1, 0, "u", "t"), (0, 0, "u", "t" * 300_000)]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("a", "b", "md5", "part", "place", "shard", "leaves", "n"):
        df = df.withColumn(c, F.lit("other"))
    assert found(pt.prefix_trie(df)) == plain(rows)


def test_slots_are_minimal_and_checked():
    rnd = np.random.default_rng(1)
    for n in (0, 1, 2, 1000):
        a, b = rnd.integers(-(2**62), 2**62, n), rnd.integers(0, 3, n)
        a[: n // 2] = a[n // 2 : n // 2 * 2]  # equal in one half, not in the other
        b[: n // 2] += 10
        slots = pt.Slots(a, b)
        assert sorted(slots.of(a, b).tolist()) == list(range(n))
        assert (slots.of(a, b + 100) == -1).all()


def test_shards_refuse_two_prefixes_of_one_digest():
    one = lambda x: np.array(x, np.int64)
    col = {"a": one([1, 1]), "b": one([2, 2]), "depth": one([3, 3]), "pa": one([4, 4]), "pb": one([5, 6]), "bytes": one([7, 7])}
    with pytest.raises(ValueError):
        pt.Table(col)


def test_scan_composes_from_each_run_s_start():
    rnd = np.random.default_rng(2)
    md5 = [rnd.bytes(16) for _ in range(200)]
    start = np.array([0] * 3 + [3] * 100 + [103] + [104] * 96)
    maps = pt.turn_maps(md5)
    got = pt.scan(maps, start)
    for x, (slope, offset) in enumerate(((0, 1), (2, 3))):
        for i in range(200):
            s = 12345 + x
            for j in range(start[i], i + 1):
                s = (int(maps[slope][j]) * s + int(maps[offset][j])) % 2**64
            assert s == (int(got[slope][i]) * (12345 + x) + int(got[offset][i])) % 2**64
