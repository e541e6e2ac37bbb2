"""Operator 5: token counts by a two-tier lookup on the map side.

Tier 1 is a compact table of frequent pre-tokens and their token counts, broadcast to every task; tier 2 encodes what it
misses and keeps the result in a bounded cache of the worker. Pre-tokens are never shuffled: only the first pass's
summaries of frequent ones, of a bounded size per task, are merged. The table decides speed alone, never a count.

The classes of the pre-token pattern are read off the library itself, whose Unicode version may differ from Python's.

Defined cases: a null text is an empty one with no tokens; texts that hold an added token's string are encoded whole by
the library; a text is counted whole, however long; repeated rows give repeated results; of equally frequent pre-tokens
those that sort first enter the table, which changes no count; a carried column gives way to an output of the same name;
an empty table has an empty first tier and no rows.
"""

from __future__ import annotations

import os
import re
import uuid
from collections import Counter
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from embergrid.llm.common import map_texts
from embergrid.llm.sentencepiece_codec import LEARN, SLICE, THREADS, Recent

#: Fixed value: the pre-token pattern of byte-level BPE vocabularies of this kind, over classes L, N and S.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"
#: Texts are cut by the narrowest pattern that holds all their characters: those below U+0500, the basic plane, all. UTF-8
#: begins characters beyond the first two bounds with the bytes given.
BOUNDS, LEADS = (0x500, 0x10000, 0x110000), (0xD4, 0xF0)

Classes = dict[str, list[tuple[int, int]]]


@lru_cache(maxsize=1)
def classes() -> Classes:
    """Ranges of the code points that the library takes for letters, numbers and white space."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    probe = {"L": (r"\p{L}+", "a"), "N": (r"\p{N}+", "1"), "S": (r"\s+", " ")}
    out: Classes = {}
    for kind, (pattern, member) in probe.items():
        runs = [every[a:b] for _, (a, b) in Split(Regex(pattern), "isolated").pre_tokenize_str(every)]
        inside = {i % 2 for i, run in enumerate(runs) if member in run}  # runs inside and outside alternate
        out[kind] = [(ord(run[0]), ord(run[-1])) for i, run in enumerate(runs) if i % 2 in inside]
    return out


def compiled(of: Classes, below: int) -> re.Pattern:
    """The pattern with its classes written out for the characters below a bound."""
    names = {k: "".join(f"\\U{a:08x}-\\U{min(b, below - 1):08x}" for a, b in ranges if a < below) for k, ranges in of.items()}
    return re.compile(PATTERN.format(**names))


def _byte_names() -> list[str]:
    """The character by which byte-level vocabularies write each byte: printable ones as they are, others from U+0100 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {b: chr(b) for b in kept}
    for b in range(256):
        if b not in names:
            names[b] = chr(256 + len(names) - len(kept))
    return [names[b] for b in range(256)]


_NAMES = str.maketrans({b: c for b, c in enumerate(_byte_names())})


class Tiers(dict):
    """The tokenizer of one worker with both tiers: itself, the broadcast table, and a bounded cache of what it misses."""

    def __init__(self, path: str, frequent: dict[str, int], of: Classes):
        from tokenizers import Tokenizer

        super().__init__(frequent)
        os.environ.setdefault("RAYON_NUM_THREADS", THREADS)
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.split = [compiled(of, b).findall for b in BOUNDS]
        self.cache = Recent()

    def __missing__(self, word: str) -> int:
        return self.cache.new[word]

    def encoded(self, texts: list[str]) -> list[int]:
        """Token counts by the library."""
        parts = (texts[at : at + LEARN] for at in range(0, len(texts), LEARN))
        return [len(e) for part in parts for e in self.tok.encode_batch_fast(part, add_special_tokens=False)]

    def pieces(self, words: list[str]) -> list[int]:
        """Token counts of single pre-tokens, by the library's merge model alone."""
        merge = self.tok.model.tokenize
        return [len(merge(w.encode().decode("latin-1").translate(_NAMES))) for w in words]

    def pretokens(self, text: str, data: bytes) -> list[str] | None:
        """The text's pre-tokens; None for a text with an added token's string."""
        if any(a in text for a in self.added):
            return None
        top = 0 if data.isascii() else int(np.frombuffer(data, np.uint8).max())
        return self.split[sum(top >= lead for lead in LEADS)](text)

    def count(self, texts: list[str], datas: list[bytes]) -> list[int]:
        cut = [self.pretokens(t, d) for t, d in zip(texts, datas, strict=True)]
        words = set(chain.from_iterable(c for c in cut if c)) - self.keys()
        new = self.cache.missing(words)
        self.cache.new.update(zip(new, self.pieces(new), strict=True))
        whole = iter(self.encoded([t for t, c in zip(texts, cut, strict=True) if c is None]))
        return [next(whole) if c is None else sum(map(self.__getitem__, c)) for c in cut]


_WORKER: dict = {}


def _worker(path: str, table: str, held) -> Tiers:
    if _WORKER.get("of") != (path, table):
        old = _WORKER.get("tiers") if _WORKER.get("of", ("",))[0] == path else None
        frequent, of = held.value
        _WORKER.update(of=(path, table), tiers=Tiers(path, frequent, of))
        if old:  # exact counts outlive a table
            _WORKER["tiers"].cache = old.cache
    return _WORKER["tiers"]


def frequent_pretokens(df: DataFrame, path: str, size: int = 8192, per_task: int = 2048, counters: int = 65_536, text_col: str = "text") -> dict[str, int]:
    """Frequent pre-tokens over all texts, with their token counts: the words between spaces that are letters alone.

    Each task keeps a frequency sketch of at most ``counters`` entries (when it is full, the rarest go) and
    returns its ``per_task`` leading ones; the merged table of at most ``size`` entries reaches the driver.
    """

    def summarise(batches):
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    seen.update(text.split(" "))
                    floor = 1
                    while len(seen) > (counters if floor == 1 else counters // 2):
                        seen = Counter({w: n for w, n in seen.items() if n > floor})
                        floor *= 2
        top = [(" " + w, n) for w, n in seen.most_common(2 * per_task) if n > 1 and len(w) <= 64 and w.isalpha()][:per_task]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["word", "n"])

    parts = df.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(summarise, "word string, n long")
    rows = parts.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(size).toArrow()
    tiers = Tiers(path, {}, classes())
    words = [w for w in rows["word"].to_pylist() if tiers.pretokens(w, w.encode()) == [w]]
    return dict(zip(words, tiers.pieces(words), strict=True))


def token_counts(df: DataFrame, path: str, frequent: dict[str, int], limit: int = 1024, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Append n_bytes, n_tokens and over_limit to every row; a narrow map."""
    held, table = df.sparkSession.sparkContext.broadcast((frequent, classes())), uuid.uuid4().hex

    def run(texts):
        counter = _worker(path, table, held)
        data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        n = counter.count([t or "" for t in texts], data)
        return {"n_bytes": pa.array([len(d) for d in data], pa.int64()), "n_tokens": pa.array(n, pa.int64()), "over_limit": pa.array([k > limit for k in n], pa.bool_())}

    out = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])
    return map_texts(df, run, out, text_col, carry, slice_bytes=SLICE)
