"""Operator 12 against the tiktoken library and against plain merging."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from embergrid.llm import byte_bpe as bb
from embergrid.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    import tiktoken

    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def le(ids) -> bytes:
    return np.array(ids, "<u4").tobytes()


def test_ids_equal_the_library(library):
    rnd = random.Random(12)
    pool = [chr(rnd.randrange(0x20, 0x3000)) for _ in range(60)] + [chr(rnd.randrange(0x10000, 0x20000)) for _ in range(30)] + list("abc  \n\t'sll re") + ["\u0085", " ", "ᲊ", "Ɤ", "<|endoftext|>"]
    some = ["".join(rnd.choice(pool) for _ in range(rnd.randrange(80))) for _ in range(2000)]
    some += ["".join(rnd.choice("abcdefghinorst") for _ in range(rnd.randrange(200))) for _ in range(1000)]
    some += ["a" * 100_001, "ab" * 50_000, " " * 30_000 + "x", "é" * 4097, "", "\n \n", None, "a" * 100_001]
    w = bb.Worker(PATH)
    for _ in range(2):  # met and not yet met
        got = w.encode(some)
        assert got == [le(library.encode_ordinary(t or "")) for t in some]
    assert [w.decode(b).decode() for b in got] == [t or "" for t in some]
    assert max(map(len, w.numbers)) <= bb.SHORT and len(w.numbers) == len(w.ids_of) == len(set(w.numbers.values()))


def plain(tokens, word):
    """Merge the least pair, the leftmost among equals, again and again."""
    parts = [bytes([b]) for b in word]
    while True:
        ways = [(tokens[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in tokens]
        if not ways:
            return [tokens[p] for p in parts]
        i = min(ways)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@pytest.mark.parametrize("seed", range(6))
def test_replay_equals_plain_merging_whatever_the_ranks(seed):
    """Vocabularies whose ranks follow no order of merges: words that need an earlier rank again are told and merged alone."""
    rnd = random.Random(seed)
    strings = {bytes([b]) for b in range(256)} | {bytes(rnd.choice(b"abc") for _ in range(rnd.randrange(2, 6))) for _ in range(60)}
    ranks = dict(zip(sorted(strings), rnd.sample(range(400), len(strings)), strict=True))
    m = bb.Merges(ranks)
    words = [bytes(rnd.choice(b"abc") for _ in range(rnd.randrange(1, 40))) for _ in range(300)] + [b"a" * k for k in range(1, 30)]
    alone, called = m.alone, []
    m.alone = lambda w: called.append(w) or alone(w)
    assert [x.tolist() for x in m.replay(words)] == [plain(ranks, w) for w in words]
    assert called and len(called) < len(words)
    assert m.replay([]) == []


def test_query_equals_the_library(spark, sf, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op12_byte_bpe"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode_ordinary(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(le(ids)).hexdigest(), hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest())


def test_odd_rows(spark, library):
    rows = [(1, None, "x"), (1, "", "y"), (None, "same text", "z"), (None, "same text", "z"), (2, "lorem dolor " * 50_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    made = bb.bpe_encode(df, PATH, carry=("doc_id", "ids"))
    assert made.columns == ["doc_id", "n_tokens", "ids"]
    back = bb.bpe_decode(made.withColumn("decoded", made.ids), PATH, carry=("doc_id", "ids", "decoded")).collect()
    for (i, t, _), r in zip(rows, back, strict=True):
        assert (r.doc_id, bytes(r.ids), bytes(r.decoded)) == (i, le(library.encode_ordinary(t or "")), (t or "").encode())
    assert bb.bpe_encode(df.limit(0), PATH).count() == 0
    null = spark.createDataFrame([(1, None)], "doc_id long, ids binary")
    assert bb.bpe_decode(null, PATH).first().decoded is None
