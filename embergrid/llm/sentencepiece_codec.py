"""Operator 6: SentencePiece encoding and decoding on the tokenizers library.

The model's protobuf is parsed here; its normaliser, word marker, scores (merge order of a BPE model, probabilities of a
unigram model) and byte fallback are rebuilt as a tokenizers pipeline, which makes the ids and decodes them again. Whole
texts are encoded in multithreaded batches, and every text is then verified against the sentencepiece library:
``parity`` tells whether that library gives the same ids. It changes none.

Defined cases: a null or empty text has no ids and decodes to the empty text; a text is encoded whole, however long;
repeated rows give repeated results; a carried column gives way to an output of the same name; an empty table has no
rows. A literal word marker in a text is a space to the model and decodes to one (``roundtrip`` is false then).
"""

from __future__ import annotations

import os
import struct
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from embergrid.llm.common import map_texts

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6  # piece types of the format
UNIGRAM, BPE = 1, 2  # model types of the format


def _fields(data: bytes):
    """(field number, value) of a protobuf message: varints as numbers, everything else as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield key >> 3, data[at : at + size]
        at += size


@dataclass(frozen=True)
class Model:
    pieces: tuple[tuple[str, float, int], ...]
    kind: int
    charsmap: bytes
    dummy_prefix: bool
    squeeze: bool  # remove_extra_whitespaces

    @classmethod
    def parse(cls, data: bytes) -> "Model":
        pieces, trainer, norm = [], {}, {}
        for number, value in _fields(data):
            if number == 1:
                p = dict(_fields(value))
                pieces.append((p[1].decode(), struct.unpack("<f", p.get(2, bytes(4)))[0], p.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                norm = dict(_fields(value))
        return cls(tuple(pieces), trainer.get(3, UNIGRAM), norm.get(2, b""), bool(norm.get(3, 1)), bool(norm.get(4, 1)))

    def backend(self):
        """The tokenizers pipeline."""
        from tokenizers import Tokenizer, decoders, models, normalizers

        ids = {p: i for i, (p, _, _) in enumerate(self.pieces)}
        unknown = next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)
        bytes_too = any(k == BYTE for _, _, k in self.pieces)
        if self.kind == BPE:
            score = {p: s for p, s, k in self.pieces if k == NORMAL}
            merges = []
            for piece, s in score.items():
                ways = [(ids[piece[:i]], ids[piece[i:]], piece[:i], piece[i:]) for i in range(1, len(piece)) if piece[:i] in score and piece[i:] in score]
                merges += [(-s, ids[piece], *w) for w in sorted(ways)]
            merges.sort()
            model = models.BPE(ids, [(m[4], m[5]) for m in merges], unk_token=self.pieces[unknown][0], fuse_unk=True, byte_fallback=bytes_too)
        else:
            model = models.Unigram([(p, s) for p, s, _ in self.pieces], unknown, bytes_too)
        tok = Tokenizer(model)
        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.squeeze:
            steps += [normalizers.Strip(), normalizers.Replace(_many_spaces(), " ")]
        if self.dummy_prefix:
            steps.append(normalizers.Prepend(MARK))
        steps.append(normalizers.Replace(" ", MARK))
        tok.normalizer = normalizers.Sequence(steps)
        first = [decoders.Strip(" ", 1, 0)] if self.dummy_prefix else []
        tok.decoder = decoders.Sequence([decoders.ByteFallback(), decoders.Fuse(), decoders.Replace(MARK, " "), *first])
        return tok


def _many_spaces():
    from tokenizers import Regex

    return Regex(" {2,}")


CACHE = 150_000
SLICE = 2 << 20  # bytes of text in memory at once with their encodings
LEARN = 8192  # pre-tokens encoded in one call
THREADS = "2"  # of the backend in each worker, as many as a task has cores; RAYON_NUM_THREADS overrides it


class Recent:
    """A bounded cache in two generations: what the last ``most`` new entries touched stays."""

    def __init__(self, most: int = CACHE):
        self.most, self.new, self.old = most, {}, {}

    def missing(self, keys: set) -> list:
        """Make all keys that either generation holds current; the others."""
        if len(self.new) > self.most:
            self.old, self.new = self.new, {}
        out = []
        for k in keys - self.new.keys():
            v = self.old.get(k)
            if v is None:
                out.append(k)
            else:
                self.new[k] = v
        return out


class Codec:
    """Backend and sentencepiece of one worker."""

    def __init__(self, path: str):
        import sentencepiece

        os.environ.setdefault("RAYON_NUM_THREADS", THREADS)
        with open(path, "rb") as f:
            self.model = Model.parse(f.read())
        self.tok = self.model.backend()
        self.spm = sentencepiece.SentencePieceProcessor(model_file=path)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def verify(self, texts: list[str], ids: list[list[int]]) -> list[bool]:
        """Whether the sentencepiece library gives the same ids."""
        return [a == b for a, b in zip(ids, self.spm.encode(texts, num_threads=1), strict=True)]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.tok.decode_batch(ids, skip_special_tokens=False)


_WORKER: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _WORKER:
        _WORKER.clear()
        _WORKER[path] = Codec(path)
    return _WORKER[path]


def sentencepiece_encode(df: DataFrame, path: str, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Append token_ids, n_tokens, parity (sentencepiece agrees) and roundtrip (the ids decode to the text); a narrow map.

    ``path`` must be readable on every executor, as an installed package's file is.
    """

    def run(texts):
        c = codec(path)
        texts = [t or "" for t in texts]
        ids = c.encode(texts)
        sizes = list(map(len, ids))
        offsets = np.cumsum([0, *sizes]).astype(np.int32)
        flat = np.fromiter(chain.from_iterable(ids), np.int32, int(offsets[-1]))
        return {
            "token_ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
            "n_tokens": pa.array(sizes, pa.int64()),
            "parity": pa.array(c.verify(texts, ids), pa.bool_()),
            "roundtrip": pa.array([a == b for a, b in zip(c.decode(ids), texts, strict=True)], pa.bool_()),
        }

    out = T.StructType([T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("parity", T.BooleanType()), T.StructField("roundtrip", T.BooleanType())])
    return map_texts(df, run, out, text_col, carry, slice_bytes=SLICE)


def sentencepiece_decode(df: DataFrame, path: str, ids_col: str = "token_ids", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Append decoded_text of a column of ids; null ids decode to the empty text."""

    def run(rows):
        return {"decoded_text": pa.array(codec(path).decode([list(r) if r is not None else [] for r in rows]), pa.string())}

    return map_texts(df, run, T.StructType([T.StructField("decoded_text", T.StringType())]), ids_col, carry)
