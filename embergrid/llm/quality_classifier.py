"""Operator 2: quality by nearest-neighbour voting over latent-semantic vectors.

Texts become counts of pairs of adjacent character shapes and of hashed words, with one term for the share of their word
triples that came before. Log counts are weighted by how far a term sets good and bad labelled texts apart, and projected
on the leading singular vectors of the labelled texts. The labelled vectors are broadcast (a bounded number of them), every document's cosine with all of them is computed exactly
in blocks, and the nearest neighbours vote with their similarity as weight.

Defined cases: a null text is an empty one; a text without any term has the zero vector, whose neighbours all tie at
similarity 0, so that its score is the mean label; neighbours that tie with the last one all vote; labels without a quality or
a document are ignored; of several label rows for a document, or several rows of a document, each is a neighbour of its own; with
labels of one kind all terms weigh alike; without any labelled document every score is 0.5; repeated rows have equal
scores; texts count whole, however long; a carried column gives way to an output of the same name; an empty table has no
rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from embergrid.llm.common import crc_of_id, map_texts

#: Shapes 0 to 31 of a byte: 0 other controls, 1 space, 2 line end, 3 lower vowel, 4 lower consonant, 5 capital,
#: 6 digit, 7 byte of a non-ASCII letter, then single marks, 31 for the remaining ones.
_MARKS = b".,!?;:-'\"()/|#*$%&<>=+@"
SHAPES = 32
PAIRS = SHAPES * SHAPES
#: Upper bounds of the shares of repeated word triples; each range is a term.
SHARES = np.array([0.02, 0.05, 0.1, 0.2, 0.35, 0.6])
#: Hashed words, and what they weigh beside the other terms.
WORDS, WORD_PART = 1024, 0.4
FIRST_WORD = PAIRS + len(SHARES) + 1
TERMS = FIRST_WORD + WORDS


def _shape_table() -> bytes:
    table = bytearray(256)
    for b in range(256):
        c = chr(b)
        if b >= 0x80:
            table[b] = 7
        elif c in " \t":
            table[b] = 1
        elif c in "\n\r":
            table[b] = 2
        elif c in "aeiou":
            table[b] = 3
        elif c.islower():
            table[b] = 4
        elif c.isupper():
            table[b] = 5
        elif c.isdigit():
            table[b] = 6
        elif b in _MARKS:
            table[b] = 8 + _MARKS.index(b)
        elif b >= 0x20:
            table[b] = 31
    return bytes(table)


_SHAPE = _shape_table()


class _Buckets(dict):
    """The term of each word, remembered for a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        k = self[word] = FIRST_WORD + xxhash.xxh3_64_intdigest(word) % WORDS
        return k


_BUCKETS = _Buckets()


def term_counts(texts: list[str | None]) -> np.ndarray:
    """Counts of shape pairs and of words, and the mark of the share of repeated word triples, one row of TERMS per text."""
    out = np.zeros((len(texts), TERMS), np.float32)
    for i, text in enumerate(texts):
        data = (text or "").encode("utf-8", "surrogatepass")
        a = np.frombuffer(data.translate(_SHAPE), np.uint8)
        if len(a) > 1:
            out[i, :PAIRS] = np.bincount(a[:-1].astype(np.int16) * SHAPES + a[1:], minlength=PAIRS)
        words = data.split()
        n = len(words) - 2
        if n > 0:
            share = 1 - len(set(zip(words, words[1:], words[2:]))) / n
            out[i, PAIRS + int(np.searchsorted(SHARES, share))] = 1
        if words:
            out[i] += np.bincount(np.fromiter(map(_BUCKETS.__getitem__, data.lower().split()), np.int64, len(words)), minlength=TERMS)
    return out


def term_weights(counts: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """How far each term's log count sets the two kinds of labelled texts apart, in their deviations, over its own size."""
    logs, good = np.log1p(counts), labels >= 0.5
    size = np.maximum(np.sqrt(np.square(logs).mean(axis=0)), 0.05)
    apart = np.ones(TERMS)
    if good.any() and not good.all():
        a, b = logs[good], logs[~good]
        apart = np.abs(a.mean(axis=0) - b.mean(axis=0)) / np.sqrt(a.var(axis=0) + b.var(axis=0) + 1e-3)
    return (apart / size * np.where(np.arange(TERMS) < FIRST_WORD, 1, WORD_PART)).astype(np.float32)


def scaled(counts: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Log counts times weights, as unit rows (zero rows stay)."""
    x = np.log1p(counts) * weight
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(length > 0, length, 1)


@dataclass(frozen=True)
class LatentModel:
    """``weight`` (terms) times log counts, projected on ``basis`` (terms x k); unit ``vectors`` of the labelled texts."""

    weight: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    neighbours: int

    def project(self, counts: np.ndarray) -> np.ndarray:
        z = scaled(counts, self.weight) @ self.basis
        length = np.linalg.norm(z, axis=1, keepdims=True)
        return (z / np.where(length > 0, length, 1)).astype(np.float32)

    def score(self, counts: np.ndarray, block: int = 256) -> np.ndarray:
        """Votes of the nearest neighbours; all that tie with the last of them vote."""
        n = len(self.labels)
        if n == 0:
            return np.full(len(counts), 0.5)
        k = min(self.neighbours, n)
        out = np.empty(len(counts))
        for at in range(0, len(counts), block):
            cos = self.project(counts[at : at + block]) @ self.vectors.T
            last = np.partition(cos, n - k, axis=1)[:, n - k : n - k + 1]
            w = np.where(cos >= last - 1e-6, np.maximum(cos, 1e-6), 0).astype(np.float64)
            out[at : at + block] = (w @ self.labels) / w.sum(axis=1)
        return np.clip(out, 0.0, 1.0)


def build_model(counts: np.ndarray, labels: np.ndarray, dims: int = 32, neighbours: int = 25) -> LatentModel:
    """Singular vectors by the eigenvectors of the (terms x terms) product; its size does not depend on the rows."""
    n = len(labels)
    if n == 0:
        empty = np.zeros((0, dims), np.float32)
        return LatentModel(np.ones(TERMS, np.float32), np.zeros((TERMS, dims), np.float32), empty, labels, neighbours)
    weight = term_weights(counts, labels)
    x = scaled(counts, weight)
    _, vectors = np.linalg.eigh((x.T @ x).astype(np.float64))
    model = LatentModel(weight, vectors[:, ::-1][:, :dims].astype(np.float32), np.zeros((0, dims), np.float32), labels, neighbours)
    return LatentModel(model.weight, model.basis, model.project(counts), labels.astype(np.float64), neighbours)


def fit(df: DataFrame, labels: DataFrame, sample: int = 4096, dims: int = 32, neighbours: int = 25) -> LatentModel:
    """Fit on at most ``sample`` labelled documents, those with the smallest hash of the id outside the held-out fold.

    ``sample`` is the documented bound of what is collected and broadcast (4096 rows of 32 floats: 0.5 MB).
    """
    chosen = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (crc_of_id() % 5 != 0))
        .select("doc_id", F.col("quality").cast("double").alias("__label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "__label")
        .limit(sample)
    )
    rows = df.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    out = T.StructType([T.StructField("counts", T.BinaryType())])
    made = map_texts(rows, lambda texts: {"counts": pa.array([r.astype("<f4").tobytes() for r in term_counts(texts)], pa.binary())}, out, carry=("doc_id", "__label"))
    got = made.orderBy(F.xxhash64("doc_id"), "doc_id", "__label").limit(sample).toArrow()
    counts = np.frombuffer(b"".join(got["counts"].to_pylist()), "<f4").reshape(-1, TERMS)
    return build_model(counts, np.array(got["__label"].to_pylist(), np.float64), dims, neighbours)


def quality_scores(df: DataFrame, model: LatentModel, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",), threshold: float = 0.3) -> DataFrame:
    """Append score and predicted to every row; a narrow map over the broadcast model."""
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(texts):
        score = held.value.score(term_counts(texts))
        return {"score": pa.array(score, pa.float64()), "predicted": pa.array((score >= threshold).astype(np.int32), pa.int32())}

    out = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return map_texts(df, run, out, text_col, carry)
