"""Operator 9: near duplicates by BagMinHash.

A text is the bag of its five-word shingles. Each shingle carries Poisson processes over dyadic intervals of weight,
(0, 1], (1, 2], (2, 4], ...; a point's position inside its interval decides whether a bag of that count holds it, so equal
points of two bags are minima with the probability of their weighted Jaccard similarity. Signatures are cut into bands;
texts that share a band are candidates, and the overlap of the whole bags decides.

Linking runs in two steps. First every text meets the head of each of its bands, the text there that shares bands with
most others, so that a group of copies makes about as many pairs as texts. Then texts that share a band but no component yet meet each other, behind a sketch of 256 bits of
their signatures, so that no link between different texts of one band is lost. Components are the classes.

Defined cases: words are lower-cased runs of ASCII letters, digits and non-ASCII characters; a text of one to four words
is one shingle; texts without a word are alike only if equal; null is a text of its own, equal to other nulls; equal word
sequences are one text (named by 128 bits of their digest); repeated rows fall in one class; a class is named by its least
doc_id, and a null doc_id is never that name unless the class has no other. No verdict needs doc_id to be a key: rows
are told apart by id and text, and rows that agree in both have one verdict. Extra columns are ignored, whatever their
names, and kept by ``drop_near_duplicates``; very long texts are signed whole; an empty table has no rows. Equal texts of
one id are one row after ``drop_near_duplicates``.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from embergrid.llm.common import cut, hot_keys, map_texts, salted_join, scratch
from embergrid.llm.decontaminate import words_of

SHINGLE = 5
SIZE = 256
#: Chance to miss a pair that is just as similar as asked for.
MISS = 3e-6
SKETCH = ("s0", "s1", "s2", "s3")
TOGETHER = 1 << 15  # words of the texts that are signed in one go
PAIRED = 4096  # texts of a band that one task compares with all of the band
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


@dataclass(frozen=True)
class Shape:
    """How signatures are cut for a similarity: bands of as many rows as leave the chance MISS to share none, and the sketch
    bits that may differ, six deviations above the mean. At 0.8: 42 bands of 6, and 54 of 256 bits."""

    rows: int
    bands: int
    bits: int

    @classmethod
    def of(cls, similarity: float) -> "Shape":
        needed = lambda r: math.ceil(math.log(MISS) / math.log1p(-(similarity**r)))
        if not 0 < similarity < 1 or needed(1) > SIZE:
            raise ValueError(f"signatures of {SIZE} numbers find no pairs of similarity {similarity}")
        rows = max(r for r in range(1, 65) if r * needed(r) <= SIZE)
        p = (1 - similarity) / 2
        return cls(rows, needed(rows), math.floor(SIZE * p + 6 * math.sqrt(SIZE * p * (1 - p))))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x + _MIX[0]
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = _Hashes()


def bags_of(many: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes and their counts of many texts, one text behind the other, and how many each text has."""
    lens = np.fromiter(map(len, many), np.int64, len(many))
    h = np.fromiter(map(_HASHES.__getitem__, chain.from_iterable(many)), np.uint64, int(lens.sum()))
    starts = np.cumsum(lens) - lens
    full = np.zeros(max(0, len(h) - SHINGLE + 1), np.uint64)
    for i in range(SHINGLE):
        full += mix(h[i : i + len(full)] * _PLACES[i])
    full = mix(full)
    parts = []
    for at, n in zip(starts.tolist(), lens.tolist(), strict=True):
        if n >= SHINGLE:
            parts.append(np.sort(full[at : at + n - SHINGLE + 1]))
        elif n:  # one shingle of all the words
            s = np.zeros(1, np.uint64)
            for i in range(n):
                s += mix(h[at + i : at + i + 1] * _PLACES[i])
            parts.append(mix(s))
    sizes = np.maximum(lens - SHINGLE + 1, np.minimum(lens, 1))
    flat = np.concatenate(parts) if parts else full[:0]
    owner = np.repeat(np.arange(len(many)), sizes)
    first = np.ones(len(flat), bool)
    first[1:] = (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(first)
    return flat[at], np.diff(at, append=len(flat)), np.bincount(owner[at], minlength=len(many))


def signatures(shingles: np.ndarray, counts: np.ndarray, sizes: np.ndarray, size: int = SIZE) -> np.ndarray:
    """Least point of each component over the processes of each bag (float64, one row a bag, inf for an empty bag).

    All bags advance together: points come in rounds, only from processes that may still lower a component of their bag.
    """
    h = np.full((len(sizes), size), np.inf)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    seeds, base, width, weight, owners = [mix(shingles)], [np.zeros(len(shingles))], [np.ones(len(shingles))], [counts], [owner]
    k = 0
    while (more := counts > 1 << k).any():
        seeds.append(mix(shingles[more] ^ np.uint64(0x5851F42D4C957F2D * (k + 1) & 0xFFFFFFFFFFFFFFFF)))
        base.append(np.full(more.sum(), float(1 << k)))
        width.append(np.full(more.sum(), float(1 << k)))
        weight.append(counts[more])
        owners.append(owner[more])
        k += 1
    seed, base, width, weight, owner = map(np.concatenate, (seeds, base, width, weight, owners))
    x, drawn, least = np.zeros(len(seed)), 0, h.reshape(-1)
    while len(seed):
        t = max(1, min(64, 4096 // len(seed)))
        steps = np.arange(drawn, drawn + t, dtype=np.uint64) * np.uint64(3)
        r = mix(seed[:, None] + steps * _MIX[1])
        gap = np.log(((r >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / (-size * width)[:, None]
        # one running sum from the first gap on, so that equal points of two bags are equal to the last bit
        points = np.cumsum(np.column_stack([x, gap]), axis=1)[:, 1:]
        r = mix(r)
        part = ((r >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64) + (owner * size)[:, None]
        level = np.floor(base[:, None] + (r & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 * width[:, None])
        held = level < weight[:, None]
        np.minimum.at(least, part[held], points[held])
        x, drawn = points[:, -1], drawn + t
        live = np.flatnonzero(x < h.max(axis=1)[owner])
        if len(live) < len(seed):
            seed, base, width, weight, x, owner = seed[live], base[live], width[live], weight[live], x[live], owner[live]
    return h


def name_of(text: str | None, words: list[bytes]) -> tuple[int, int]:
    """128 bits that name the text's word sequence, as two numbers."""
    if words:
        data = b"w" + b" ".join(words)
    else:
        data = b"n" if text is None else b"t" + text.encode("utf-8", "surrogatepass")
    d = hashlib.blake2b(data, digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _marks(shape: Shape, many: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bands, sketch and bag size of each word list; lists without a word have no use for theirs."""
    shingles, counts, sizes = bags_of(many)
    bits = mix(signatures(shingles, counts, sizes).view(np.uint64))
    key = np.zeros((len(many), shape.bands), np.uint64)
    for part in bits[:, : shape.bands * shape.rows].reshape(len(many), shape.bands, shape.rows).transpose(2, 0, 1):
        key = mix(key ^ part)
    sketch = np.packbits((bits & np.uint64(1)).astype(bool), axis=1).view("<i8")
    owner = np.repeat(np.arange(len(many)), sizes)
    return mix(key + np.arange(shape.bands, dtype=np.uint64)).view(np.int64), sketch, np.bincount(owner, counts, len(many)).astype(np.int64)


def _signed(shape: Shape, texts: list[str | None]) -> dict[str, pa.Array]:
    """Name, bands, sketch and bag size of each text; texts without a word have no bands."""
    words = [words_of(t) for t in texts]
    names = [name_of(t, w) for t, w in zip(texts, words, strict=True)]
    first = {name: i for i, name in reversed(list(enumerate(names)))}  # equal texts of the batch are signed once
    todo = sorted(first.values())
    bands, sketch, size = np.zeros((len(texts), shape.bands), np.int64), np.zeros((len(texts), 4), np.int64), np.zeros(len(texts), np.int64)
    at = 0
    while at < len(todo):
        end, n = at, 0
        while end < len(todo) and (end == at or n + len(words[todo[end]]) <= TOGETHER):
            n += len(words[todo[end]])
            end += 1
        part = todo[at:end]
        bands[part], sketch[part], size[part] = _marks(shape, [words[i] for i in part])
        at = end
    of = np.fromiter((first[name] for name in names), np.int64, len(names))
    ends = np.cumsum([0, *(shape.bands if w else 0 for w in words)]).astype(np.int32)
    flat = bands[of][np.fromiter(map(bool, words), bool, len(words))].ravel()
    out = {"id": pa.array([a for a, _ in names], pa.int64()), "check": pa.array([b for _, b in names], pa.int64()), "bands": pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), "n": pa.array(size[of])}
    return out | {s: pa.array(sketch[of, i]) for i, s in enumerate(SKETCH)}


_SIGNED = T.StructType([T.StructField("id", T.LongType()), T.StructField("check", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("n", T.LongType()), *(T.StructField(s, T.LongType()) for s in SKETCH)])


def _bags(texts: list[str | None]) -> dict[str, pa.Array]:
    """Name and bag of each text, the bag as a set: a shingle's further occurrences under names of their own."""
    words = [words_of(t) for t in texts]
    names = [name_of(t, w) for t, w in zip(texts, words, strict=True)]
    shingles, counts, sizes = bags_of(words)
    nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    flat = mix(np.repeat(shingles, counts) + nth.astype(np.uint64) * _MIX[0]).view(np.int64)
    ends = np.cumsum([0, *np.bincount(np.repeat(np.arange(len(texts)), sizes), counts, len(texts)).astype(np.int64)]).astype(np.int32)
    return {"id": pa.array([a for a, _ in names], pa.int64()), "check": pa.array([b for _, b in names], pa.int64()), "bag": pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))}


_BAGS = T.StructType([T.StructField("id", T.LongType()), T.StructField("check", T.LongType()), T.StructField("bag", T.ArrayType(T.LongType()))])


def verified(pairs: DataFrame, bags: DataFrame, similarity: float, hot: DataFrame) -> DataFrame:
    """Pairs (a, b) whose bags overlap enough, by the whole bags; ``hot``: the a of many pairs."""
    both = pairs.join(bags.select(F.col("id").alias("b"), F.col("bag").alias("bag_b")), "b")
    both = salted_join(both, bags.select(F.col("id").alias("a"), F.col("bag").alias("bag_a")), "a", hot, ["b"])
    return both.where(_alike(F.col("bag_a"), F.col("bag_b"), similarity)).select("a", "b")


def _alike(a: Column, b: Column, similarity: float) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return shared >= F.lit(similarity) * (F.size(a) + F.size(b) - shared)


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(id, label): the least id of each component, by least labels of neighbours with pointer jumping.

    Every round is written to the shared folder, so that lineage stays short; only counts reach the driver. The rows of
    a hub, or of a label that many took over, are spread over several tasks.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    total = both.count()
    hubs = cut(hot_keys(both, "b", total))
    labels = cut(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("label")))
    for _ in range(most):
        near = salted_join(both, labels.select(F.col("id").alias("b"), "label"), "b", hubs, ["a"]).groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        step = cut(labels.join(near, "id").select("id", "label", F.least("label", "near").alias("least")))
        # the label is itself a member: take over its label, too
        heads = step.select(F.col("id").alias("least"), F.col("label").alias("far"))
        new = salted_join(step, heads, "least", hot_keys(step, "least", total), ["id"]).select("id", F.least("least", "far").alias("new"), "label")
        new = cut(new)
        changed = new.where(F.col("new") != F.col("label")).limit(1).count()
        labels = new.select("id", F.col("new").alias("label"))
        if not changed:
            return labels
    raise RuntimeError("components did not settle")


def _near(a: str, b: str, bits: int):
    return sum((F.bit_count(F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))) for s in SKETCH), F.lit(0)) <= bits


def near_dedup(df: DataFrame, similarity: float = 0.8, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, class_id (least doc_id of the class), n_class (its rows) and kept (it names the class;
    where the name stands on several texts, the one with the least hash).
    """
    return _verdicts(df, similarity, text_col, id_col)[0].select("doc_id", "class_id", "n_class", "kept")


def _renamed(rows: DataFrame, clash: DataFrame | None) -> DataFrame:
    """Ids that stand for several texts give way to a hash of all 128 bits."""
    if clash is None:
        return rows.drop("check")
    known = clash.select("id", F.lit(True).alias("__clash"))
    return rows.join(F.broadcast(known), "id", "left").withColumn("id", F.when(F.col("__clash"), F.xxhash64("id", "check")).otherwise(F.col("id"))).drop("__clash", "check")


def _verdicts(df: DataFrame, similarity: float, text_col: str = "text", id_col: str = "doc_id") -> tuple[DataFrame, bool]:
    """The result with each row's text hash ``__key``, and whether doc_id is no key of the rows.

    Texts are read twice and cross the network once, for the texts that share a band; all else moves ids, bands or bags.
    """
    with scratch():
        return _judged(df, similarity, Shape.of(similarity), text_col, id_col)


def _judged(df: DataFrame, similarity: float, shape: Shape, text_col: str, id_col: str) -> tuple[DataFrame, bool]:
    docs = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).withColumn("__key", F.xxhash64("text"))
    signed = map_texts(docs, partial(_signed, shape), _SIGNED, carry=("doc_id", "__key"))
    signed = cut(signed.withColumn("__row", F.monotonically_increasing_id()))
    n_rows, n_ids = signed.agg(F.count("*"), F.count_distinct("doc_id")).first()
    repeats = n_rows != n_ids
    clash = cut(signed.groupBy("id").agg(F.min("check").alias("lo"), F.max("check").alias("hi")).where("lo != hi").select("id"))
    clash = clash if clash.limit(1).count() else None  # none is expected below some billion texts
    signed = _renamed(signed, clash)
    marks = ("bands", "n", *SKETCH)
    texts = signed.groupBy("id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__key", *marks)).alias("x"), F.count("*").alias("n_rows"))
    texts = cut(texts.select("id", "n_rows", *[f"x.{c}" for c in ("doc_id", "__key", *marks)]))
    sketches = texts.select("id", "n", *SKETCH)
    exploded = texts.select("id", F.explode("bands").alias("band"))
    full = cut(exploded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"))
    total = full.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    crowded = cut(hot_keys(full, "band", total, F.col("n")))
    met = salted_join(exploded, full, "band", crowded, ["id"])
    # the text that meets most others heads its bands: of near copies that is their common original, if it is there
    degree = met.groupBy("id").agg(F.sum("n").alias("degree"))
    shared = cut(met.select("band", "id").join(degree, "id"))
    heads = shared.groupBy("band").agg(F.max(F.struct("degree", "id")).alias("h")).select("band", F.col("h.id").alias("head"))
    star = cut(salted_join(shared, heads, "band", crowded, ["id"]).where("id != head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct())
    hubs = cut(hot_keys(star, "a", star.count()))
    names_of = lambda s: sketches.select(F.col("id").alias(s), F.struct("n", *SKETCH).alias(f"of_{s}"))
    star = salted_join(star.join(names_of("b"), "b"), names_of("a"), "a", hubs, ["b"])
    star = cut(star.where(_sizes("of_a", "of_b", similarity) & _near("of_a", "of_b", shape.bits)).select("a", "b"))
    # one row of each text, by its id and the text's hash; the bag goes under the name of the very text that it is made of
    wanted = shared.select("id").distinct().join(texts.select("id", "doc_id", "__key"), "id").select("doc_id", "__key")
    bags = _renamed(map_texts(_semi(docs, wanted, repeats), _bags, _BAGS, carry=()), clash)
    bags = cut(bags.dropDuplicates(["id"]) if repeats else bags)
    edges = cut(verified(star, bags, similarity, hubs))
    labels = components(edges)
    member = cut(shared.select("band", "id").join(labels, "id", "left").select("band", "id", F.coalesce("label", "id").alias("label")))
    mixed = member.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("m")).where("lo != hi").select("band", "m")
    open_ = salted_join(member, mixed, "band", crowded, ["id"]).join(texts.select("id", "bands", "n", *SKETCH), "id").join(bags, "id")
    open_ = cut(open_)
    few, many, parts = open_.where(F.col("m") <= PAIRED).withColumn("part", F.lit(0)), open_.where(F.col("m") > PAIRED), F.ceil(F.col("m") / PAIRED).cast("int")
    # a crowded band's pairs are judged in several tasks: one side is dealt, the other goes to each
    dealt, repeated = many.withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int")), many.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    more = cut(_cross(few, few, similarity, shape.bits).union(_cross(dealt, repeated, similarity, shape.bits)))
    if more.limit(1).count():
        labels = components(edges.union(more))
    # classes from one row a text; every row then learns its text's class
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__key")).alias("x")
    home = cut(texts.select("id", "doc_id", "__key", "n_rows").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id")))
    names = home.groupBy("label").agg(least, F.sum("n_rows").alias("n_class")).select("label", F.col("x.doc_id").alias("class_id"), F.col("x.__key").alias("__class_key"), "n_class")
    of_text = salted_join(home.select("id", "label"), names, "label", hot_keys(home, "label", n_rows), ["id"]).drop("label")
    out = salted_join(signed.select("doc_id", "__key", "id", "__row"), of_text, "id", hot_keys(texts, "id", n_rows, F.col("n_rows")), ["__row"])
    kept = F.col("doc_id").eqNullSafe(F.col("class_id"))
    kept = kept & (F.col("__key") == F.col("__class_key")) if repeats else kept
    return cut(out.select("doc_id", "__key", "class_id", "n_class", kept.alias("kept")), keep=True), repeats


def _cross(left: DataFrame, right: DataFrame, similarity: float, bits: int) -> DataFrame:
    """Pairs (a, b) of one band's part, of different components, whose bags overlap enough.

    Pairs that fail are turned down inside the join: no row is made for them, and each pair is judged in one band.
    """
    p, q = left.alias("p"), right.alias("q")
    apart = (F.col("p.band") == F.col("q.band")) & (F.col("p.part") == F.col("q.part")) & (F.col("p.id") < F.col("q.id")) & (F.col("p.label") != F.col("q.label"))
    once = F.array_min(F.array_intersect("p.bands", "q.bands")) == F.col("p.band")
    met = p.join(q, apart & _sizes("p", "q", similarity) & _near("p", "q", bits) & once & _alike(F.col("p.bag"), F.col("q.bag"), similarity))
    return met.select(F.col("p.id").alias("a"), F.col("q.id").alias("b"))


def _sizes(a: str, b: str, similarity: float) -> Column:
    """Whether bags of these sizes can be alike at all."""
    x, y = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (x >= F.lit(similarity) * y) & (y >= F.lit(similarity) * x)


def _semi(docs: DataFrame, rows: DataFrame, repeats: bool, how: str = "left_semi") -> DataFrame:
    """Rows of ``docs`` (with doc_id and __key) whose id and text hash are, or are not, among ``rows``."""
    if not repeats:
        return docs.join(rows.select("doc_id"), "doc_id", how)
    r = rows.select(F.col("doc_id").alias("__id"), F.col("__key").alias("__of"))
    return docs.join(r, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__of")), how)


def drop_near_duplicates(df: DataFrame, similarity: float = 0.8) -> DataFrame:
    """One row of each class of ``df``: the one that names it, whether or not ids are missing or stand on several texts."""
    verdict, repeats = _verdicts(df, similarity)
    if not repeats:
        return _semi(df, verdict.where("not kept"), False, "left_anti")
    gone = verdict.where("not kept").select("doc_id", "__key").distinct()
    left = _semi(df.withColumn("__key", F.xxhash64("text")), gone, True, "left_anti")
    return left.dropDuplicates(["doc_id", "__key"]).select(*df.columns)
