"""Operator 8: benchmark passages in documents by Wu-Manber search.

Item windows of ten words are byte strings of a normalised text. A table of blocks gives how far the search may skip at a
position; where it may not, the block ending there selects a bucket of windows by their last bytes, and direct comparison
confirms. Windows of short items, shorter by nature, form a search of their own so that they do not shrink the skips of
the others.

A benchmark of more than ``max_windows`` words is searched for in several passes, each with a share of the items.

Defined cases: null and empty texts have no words; items without words have no windows; the windows of items with a null id count as hits, and such items are not listed; repeated items
count once by id; a window that several items share counts for each; texts are searched whole, however long; repeated
rows give repeated results; a carried column gives way to an output of the same name, and to nothing else; an empty table
has no rows, and an empty benchmark no hits.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from embergrid.llm.common import cut, hot_keys, map_texts, salted_join

WINDOW = 10
MAX_WINDOWS = 500_000

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words: runs of ASCII letters, digits and non-ASCII characters, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def windows_of(words: list[bytes]) -> Iterable[bytes]:
    if words:
        for i in range(max(1, len(words) - WINDOW + 1)):
            yield b" ".join(words[i : i + WINDOW])


@dataclass(frozen=True)
class Search:
    """Wu-Manber tables over patterns written as b" w1 w2 ... "."""

    block: int
    least: int  # bytes of the shortest pattern
    shift: dict[bytes, int]  # block -> bytes to skip; absent blocks skip least - block + 1
    buckets: dict[bytes, list[bytes]]  # last block of the first ``least`` bytes -> patterns

    @classmethod
    def build(cls, patterns: list[bytes]) -> "Search":
        least = min(map(len, patterns))
        block = max(1, min(8, least // 3))
        shift: dict[bytes, int] = {}
        buckets: dict[bytes, list[bytes]] = {}
        for p in patterns:
            for end in range(block, least + 1):
                b = p[end - block : end]
                shift[b] = min(shift.get(b, least), least - end)
            buckets.setdefault(p[least - block : least], []).append(p)
        return cls(block, least, shift, buckets)

    def occurrences(self, data: bytes) -> Iterable[tuple[int, bytes]]:
        """(start, pattern) of every occurrence, overlapping ones included."""
        block, least, buckets = self.block, self.least, self.buckets
        skip, get = least - block + 1, self.shift.get
        at, n = least, len(data)
        while at <= n:
            b = data[at - block : at]
            d = get(b, skip)
            if d:
                at += d
                continue
            start = at - least
            for p in buckets[b]:
                if data.startswith(p, start):
                    yield start, p
            at += 1


@dataclass(frozen=True)
class Matcher:
    searches: tuple[Search, ...]
    items: dict[bytes, tuple[str, ...]]  # pattern -> ids of its items

    @classmethod
    def build(cls, rows: Iterable[tuple[object, str | None]]) -> "Matcher":
        items: dict[bytes, set[str]] = {}
        for item, text in rows:
            for w in windows_of(words_of(text)):
                named = items.setdefault(b" " + w + b" ", set())
                if item is not None:  # an item without an id has windows, but no name to be listed by
                    named.add(str(item))
        full = [p for p in items if p.count(b" ") == WINDOW + 1]
        short = [p for p in items if p.count(b" ") <= WINDOW]
        return cls(tuple(Search.build(x) for x in (full, short) if x), {p: tuple(sorted(i)) for p, i in items.items()})

    def hits(self, text: str | None) -> tuple[int, list[tuple[int, int]], set[str]]:
        """The document's words, the merged [first, last) word ranges inside windows, and the items found."""
        words = words_of(text)
        data = b" " + b" ".join(words) + b" "
        found: list[tuple[int, int]] = []
        items: set[str] = set()
        for search in self.searches:
            word = at = 0
            for start, p in search.occurrences(data):
                word += data.count(b" ", at, start)
                at = start
                found.append((word, word + p.count(b" ") - 1))
                items.update(self.items[p])
        return len(words), merged(found), items


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_RANGES = T.ArrayType(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))
_ITEMS = T.ArrayType(T.StringType())
OUTPUTS = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")


#: What lies between words.
_APART = r"[^0-9A-Za-z\x{80}-\x{10FFFF}]+"


def _searched(texts: list[str | None], matcher: Matcher) -> dict[str, pa.Array]:
    got = [matcher.hits(t) for t in texts]
    pairs = pa.struct([("a", pa.int64()), ("b", pa.int64())])
    return {
        "n_words": pa.array([g[0] for g in got], pa.int64()),
        "__found": pa.array([[{"a": a, "b": b} for a, b in g[1]] for g in got], pa.list_(pairs)),
        "__items": pa.array([sorted(g[2]) for g in got], pa.list_(pa.string())),
        "__any": pa.array([bool(g[1]) for g in got], pa.bool_()),
    }


def decontaminate(
    df: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    carry: tuple[str, ...] = ("doc_id",),
    max_windows: int = MAX_WINDOWS,
    only_clean: bool = False,
) -> DataFrame:
    """Append n_words, n_hit, n_items, items_sha256 and contaminated to every row.

    The benchmark's words are counted first. Up to ``max_windows`` of them (some 100 MB at most in a worker) go to every task
    and the search is one narrow map. More are dealt to passes by a hash of the item. Each pass reads the texts and writes
    the hits of those that have any, under the text's SHA-256, so that only one pass's tables are in memory and no text is
    written; the hits meet the rows at the end.
    """
    tests = benchmark.select(F.col("item_id"), F.col("text"))
    n = F.size(F.split(F.coalesce("text", F.lit("")), _APART))
    passes = max(1, -(-(tests.agg(F.sum(n)).first()[0] or 0) // max(1, max_windows)))
    names = [c for c in dict.fromkeys(carry) if c not in OUTPUTS]
    own = [f"__kept{i}" for i in range(len(names))]  # no carried name can meet one of the search's
    rows = df.select(*[F.col(f"`{c}`").alias(o) for c, o in zip(names, own, strict=True)], F.col(f"`{text_col}`").alias("__doc"))
    spark = df.sparkSession

    def search(docs: DataFrame, some: DataFrame, carried: tuple[str, ...], only_hits: bool) -> DataFrame:
        got = some.toArrow()
        held = spark.sparkContext.broadcast(Matcher.build(zip(got["item_id"].to_pylist(), got["text"].to_pylist(), strict=True)))
        out = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("__found", _RANGES), T.StructField("__items", _ITEMS), T.StructField("__any", T.BooleanType())])
        return map_texts(docs, lambda texts: _searched(texts, held.value), out, "__doc", carried, "__any" if only_hits else None)

    if passes == 1:
        rows = search(rows, tests, tuple(own), False)
    else:
        rows = rows.withColumn("__name", F.sha2(F.coalesce("__doc", F.lit("")), 256))
        parts = [search(rows, tests.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k), ("__name",), True).groupBy("__name").agg(F.first("__found").alias("f"), F.first("__items").alias("i")) for k in range(passes)]
        hits = cut(functools.reduce(DataFrame.unionByName, map(cut, parts)).groupBy("__name").agg(F.flatten(F.collect_list("f")).alias("__found"), F.array_distinct(F.flatten(F.collect_list("i"))).alias("__items")))
        words = F.size(F.filter(F.split(F.coalesce("__doc", F.lit("")), _APART), lambda w: w != "")).cast("long")
        rows = rows.select(*own, "__name", words.alias("n_words"))
        counted = rows.join(hits.select("__name"), "__name", "left_semi")
        rows = salted_join(rows, hits, "__name", hot_keys(counted, "__name", counted.count()), own or ["n_words"], "left")
    # ranges of several passes may overlap
    covered = F.aggregate(F.array_sort("__found"), F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")), lambda x, r: F.struct((x["n"] + F.greatest(r["b"] - F.greatest(r["a"], x["to"]), F.lit(0))).alias("n"), F.greatest(r["b"], x["to"]).alias("to")), lambda x: x["n"])
    rows = rows.select(*own, "n_words", F.coalesce(covered, F.lit(0)).cast("long").alias("n_hit"), F.array_sort(F.coalesce("__items", F.array().cast("array<string>"))).alias("__seen"))
    result = rows.select(
        *[F.col(o).alias(c) for c, o in zip(names, own, strict=True)],
        "n_words", "n_hit", F.size("__seen").cast("long").alias("n_items"), F.sha2(F.array_join("__seen", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
    return result.where(~F.col("contaminated")) if only_clean else result
