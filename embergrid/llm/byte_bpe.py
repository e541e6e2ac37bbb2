"""Operator 12: byte-level BPE by merge replay over the words of a whole corpus block at once.

The distinct words (pre-tokens) of a task's block of texts that its worker has not met yet stand one behind the other as a
linked list of tokens. An inverted index leads from the token that a pair makes, which is its rank, to the places of such pairs in
all words. Ranks are replayed in order: a rank's merges are applied at all its places from left to right, and only the touched
neighbours are looked up and indexed anew. The result is that of merging the least pair of each word again and again, as
long as no merge makes a pair of a lower rank; a word in which one does is merged alone by the least pair and place.

A word that is itself in the vocabulary is its own token, as in the tiktoken library. The classes of the pre-token pattern
are read off that library, whose Unicode version may differ from Python's.

Defined cases: a null text has no tokens and decodes to no bytes; texts are encoded whole, however long, and so is a word
of any length (only words of up to ``SHORT`` characters are remembered); special tokens' strings are ordinary text; places
of one rank that overlap go to the leftmost; repeated rows give repeated results; a carried column gives way to an output
of the same name; an empty table has no rows; null ids decode to null, and ids outside the vocabulary are an error.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from embergrid.llm.common import map_texts
from embergrid.llm.token_count import BOUNDS, LEADS, Classes, compiled

#: Characters of a word that a worker remembers, how many such words it holds, bytes of the words that are replayed together,
#: and bytes of the texts of a block.
SHORT, HELD, TOGETHER, SLICE = 64, 300_000, 1 << 20, 4 << 20
_NONE = 1 << 62  # no rank


@lru_cache(maxsize=1)
def classes() -> Classes:
    """Ranges of the code points that the tiktoken library takes for letters, numbers and white space."""
    import tiktoken

    every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    out: Classes = {}
    for kind, pattern in (("L", r"\p{L}"), ("N", r"\p{N}"), ("S", r"\s")):
        probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        points = np.frombuffer(bytes(probe.encode_ordinary(every)).decode().encode("utf-32-le"), np.uint32)
        last = np.flatnonzero(np.diff(points, append=0x200000) != 1)
        first = np.concatenate([[0], last[:-1] + 1])
        out[kind] = list(zip(points[first].tolist(), points[last].tolist(), strict=True))
    return out


class Merges:
    """A vocabulary of ranks and what its pairs make."""

    def __init__(self, tokens: dict[bytes, int]):
        self.tokens = tokens
        self.size = max(tokens.values()) + 1
        self.bytes: list[bytes | None] = [None] * self.size
        for t, rank in tokens.items():
            self.bytes[rank] = t
        self.first = np.array([tokens[bytes([b])] for b in range(256)])
        # every pair of tokens that makes a token, and which; the last is none
        cuts = [(x * self.size + y, r) for t, r in tokens.items() for c in range(1, len(t)) if (x := tokens.get(t[:c])) is not None and (y := tokens.get(t[c:])) is not None]
        self.pairs, self.makes = np.array([*sorted(cuts), (1 << 62, _NONE)], np.int64).T.copy()

    @classmethod
    def read(cls, path: str) -> "Merges":
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a})

    def rank(self, left: int, right: int) -> int:
        """The token that a pair makes, _NONE if none."""
        return self.tokens.get(self.bytes[left] + self.bytes[right], _NONE)

    def alone(self, word: bytes) -> list[int]:
        """One word by the least pair, the leftmost among equals."""
        tok, n = self.first[np.frombuffer(word, np.uint8)].tolist(), len(word)
        back, on = list(range(-1, n - 1)), list(range(1, n + 1))
        todo = [(r, i) for i in range(n - 1) if (r := self.rank(tok[i], tok[i + 1])) != _NONE]
        heapify(todo)
        while todo:
            r, i = heappop(todo)
            j = on[i]
            if tok[i] < 0 or j == n or self.rank(tok[i], tok[j]) != r:
                continue
            tok[i], tok[j] = r, -1
            k = on[i] = on[j]
            if k < n:
                back[k] = i
                if (s := self.rank(r, tok[k])) != _NONE:
                    heappush(todo, (s, i))
            if (h := back[i]) >= 0 and (s := self.rank(tok[h], r)) != _NONE:
                heappush(todo, (s, h))
        return [t for t in tok if t >= 0]

    def together(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``rank`` of many pairs at once; no token (below 0) makes no pair."""
        key = left.astype(np.int64) * self.size + right
        key[(left < 0) | (right < 0)] = -1
        at = np.searchsorted(self.pairs, key)
        return np.where(self.pairs[at] == key, self.makes[at], _NONE)

    def replay(self, words: list[bytes]) -> list[np.ndarray]:
        """Token ids of each word, all merges of a rank in all words at once."""
        if not words:
            return []
        ends = np.cumsum([len(w) + 1 for w in words])
        tok = self.first[np.frombuffer(b"\0".join([*words, b""]), np.uint8)]
        tok[ends - 1] = -2  # a place without a token parts the words
        n = len(tok)
        back, on = np.arange(-1, n - 1), np.arange(1, n + 1)
        at: dict[int, list[np.ndarray]] = {}  # the inverted index
        todo: list[int] = []
        odd: list[np.ndarray] = []

        def index(places: np.ndarray, ranks: np.ndarray) -> None:
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            for s, a, b in zip(ranks[[0, *cuts]].tolist(), [0, *cuts.tolist()], [*cuts.tolist(), len(ranks)], strict=True):
                if s in at:
                    at[s].append(places[a:b])
                else:
                    at[s] = [places[a:b]]
                    heappush(todo, s)

        first = self.together(tok[:-1], tok[1:])
        some = np.flatnonzero(first != _NONE)
        if len(some):
            index(some, first[some])
        while todo:
            r = heappop(todo)
            i = np.unique(np.concatenate(at.pop(r)))
            i = i[tok[i] >= 0]
            j = on[i]
            here = self.together(tok[i], tok[j]) == r  # else a neighbour was merged before
            i, j = i[here], j[here]
            if not len(i):
                continue
            follows = np.concatenate([[False], j[:-1] == i[1:]])
            if follows.any():  # places that overlap: every other one of a run
                t = np.arange(len(i))
                keep = (t - np.maximum.accumulate(np.where(follows, 0, t))) % 2 == 0
                i, j = i[keep], j[keep]
            k = on[j]
            passing = self.together(np.full(len(k), r), tok[k])  # what the right neighbour is until it is merged itself
            tok[i], tok[j] = r, -1
            on[i], back[k] = k, i
            h = back[i]
            places, ranks = np.concatenate([i, h]), np.concatenate([self.together(tok[i], tok[k]), self.together(tok[h], tok[i])])
            if (low := ranks < r).any() or (passing < r).any():
                odd += [places[low], i[passing < r]]
            some = ranks != _NONE
            if some.any():
                index(places[some], ranks[some])
        left = tok >= 0
        out = np.split(tok[left], np.cumsum(np.add.reduceat(left, [0, *ends[:-1]]))[:-1])
        for w in np.unique(np.searchsorted(ends, np.concatenate(odd), side="right")).tolist() if odd else []:
            out[w] = np.array(self.alone(words[w]))
        return out


class Numbers(dict):
    """Words by number, in the order in which they are met."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


class Worker:
    """The vocabulary of one worker, its pattern, and the ids of words that it has met."""

    def __init__(self, path: str):
        self.merges = Merges.read(path)
        self.split = [compiled(classes(), b).findall for b in BOUNDS]
        self.numbers, self.ids_of = Numbers(), []

    def words(self, text: str) -> list[str]:
        """The pre-tokens, by the narrowest pattern that holds all the text's characters."""
        top = 0 if text.isascii() else int(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8).max())
        return self.split[sum(top >= lead for lead in LEADS)](text)

    def ids(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words as little-endian unsigned 32-bit numbers: vocabulary first, then replays of bounded size."""
        data = [w.encode("utf-8", "surrogatepass") for w in words]
        out = [[r] if (r := self.merges.tokens.get(d)) is not None else None for d in data]
        todo = [i for i, o in enumerate(out) if o is None]
        while todo:
            n = size = 0
            while n < len(todo) and (not n or size + len(data[todo[n]]) <= TOGETHER):
                size += len(data[todo[n]])
                n += 1
            for i, ids in zip(todo[:n], self.merges.replay([data[i] for i in todo[:n]]), strict=True):
                out[i] = ids
            todo = todo[n:]
        return [np.array(o, "<u4").tobytes() for o in out]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self.numbers) > HELD:
            self.numbers, self.ids_of = Numbers(), []
        number, known = self.numbers.__getitem__, len(self.numbers)
        cut = [np.fromiter(map(number, self.words(t)), np.int32) if t else [] for t in texts]
        new = list(islice(self.numbers, known, None))
        self.ids_of += self.ids(new)
        out = [b"".join(map(self.ids_of.__getitem__, c)) for c in cut]
        if any(len(w) > SHORT for w in new):
            kept = [w for w in new if len(w) <= SHORT]
            ids = [self.ids_of[self.numbers[w]] for w in kept]
            for w in new:
                del self.numbers[w]
            self.numbers.update(zip(kept, range(known, known + len(kept)), strict=True))
            self.ids_of[known:] = ids
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.merges.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_WORKER: dict[str, Worker] = {}


def worker(path: str) -> Worker:
    if path not in _WORKER:
        _WORKER.clear()
        _WORKER[path] = Worker(path)
    return _WORKER[path]


def bpe_encode(df: DataFrame, path: str, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Append n_tokens and ids (little-endian unsigned 32-bit numbers, one behind the other); a narrow map.

    ``path`` names a file of ranks that every executor can read, as an installed package's file is.
    """

    def run(texts):
        ids = worker(path).encode(texts)
        return {"n_tokens": pa.array([len(b) // 4 for b in ids], pa.int64()), "ids": pa.array(ids, pa.binary())}

    return map_texts(df, run, T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())]), text_col, carry, slice_bytes=SLICE)


def bpe_decode(df: DataFrame, path: str, ids_col: str = "ids", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Append decoded, the bytes of a column of ids as ``bpe_encode`` writes them."""

    def run(rows):
        return {"decoded": pa.array([worker(path).decode(b) if b is not None else None for b in rows], pa.binary())}

    return map_texts(df, run, T.StructType([T.StructField("decoded", T.BinaryType())]), ids_col, carry, slice_bytes=SLICE)
