"""The corpus pipeline: each stage against its operator's rule on the stage's own input."""

import corpus_pipeline as cp
import pytest

from embergrid.llm.decontaminate import words_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def stages(spark):
    sf = "/root/testdata/sf0.01"
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for _, f in cp.STAGES:
        before, docs = docs, cp.cut(f(spark, docs, sf))
        out.append((before.toPandas(), docs.toPandas()))
    return out


def test_stages_keep_columns_and_only_known_rows(stages):
    for before, after in stages[:-1]:
        assert list(after.columns) == list(cp.COLUMNS)
        assert set(after.doc_id) <= set(before.doc_id) and after.doc_id.is_unique


def test_quality_stage_cleans_and_keeps(stages):
    from embergrid.llm.quality_rules import clean_text

    before, after = stages[0]
    want = {i: r["clean_text"] for i, t in zip(before.doc_id, before.text, strict=True) if (r := clean_text(t))["kept"]}
    assert dict(zip(after.doc_id, after.text, strict=True)) == want and (after.n_chars == after.text.str.len()).all()


def test_dedup_stage_leaves_no_exact_copies(stages):
    before, after = stages[1]
    assert after.text.is_unique and len(after) < len(before)
    assert set(before.text.map(lambda t: tuple(words_of(t)))) >= set(after.text.map(lambda t: tuple(words_of(t))))


def test_benchmark_stage_drops_what_holds_a_window(stages, spark):
    before, after = stages[2]
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").toPandas()
    wins = {tuple(w[i : i + 10]) for t in bench.text if (w := words_of(t)) for i in range(max(1, len(w) - 9))}
    clean = [i for i, t in zip(before.doc_id, before.text, strict=True) if not any(tuple((w := words_of(t))[k : k + n]) in wins for n in {len(x) for x in wins} for k in range(len(words_of(t)) - n + 1))]
    assert sorted(after.doc_id) == sorted(clean) and len(clean) < len(before)


def test_secret_stage_leaves_no_secret(stages):
    from embergrid.llm.secret_scan import build

    before, after = stages[3]
    assert sorted(before.doc_id) == sorted(after.doc_id)
    kinds = {k for spans in build().ready().batch(list(after.text)) for k, _, _ in spans}
    assert not kinds & {"access", "hex", "assign"}


def test_tokens_decode_to_the_text(stages):
    before, after = stages[4]
    assert len(before) == len(after) and after.parity.all() and after.roundtrip.all()


def test_run_equals_stages(spark, stages):
    got = cp.run(spark, "/root/testdata/sf0.01").toPandas()
    assert sorted(zip(got.doc_id, got.n_tokens, strict=True)) == sorted(zip(stages[4][1].doc_id, stages[4][1].n_tokens, strict=True))


LONG = " ".join(f"w{i}." for i in range(60))


def test_odd_rows_have_defined_results_in_all_stages(spark):
    """Nulls, ids that repeat or are missing, empty and very long texts, copies, extra columns, empty tables."""
    sf = "/root/testdata/sf0.001"
    huge = " ".join(f"v{i}" + ("." if i % 9 == 0 else "") for i in range(60_000))
    rows = [(1, None), (None, "x " * 50), (2, ""), (3, LONG), (3, LONG), (None, LONG), (4, "Prose of a kind. " + LONG), (4, huge), (None, "Other words. " + LONG.replace("w", "u"))]
    docs = spark.createDataFrame([(i, t, None, "s", None, "more") for i, t in rows], SCHEMA + ", kept string").select("kept", "text", "n_chars", "doc_id", "lang", "source")
    texts = lambda df: sorted((r.doc_id is None, r.doc_id or 0, (r.text or "")[:8]) for r in df.collect())
    out = []
    for _, f in cp.STAGES:
        docs = cp.cut(f(spark, docs, sf))
        out.append(docs)
    good = [(False, 3, "w0. w1. "), (False, 3, "w0. w1. "), (False, 4, "Prose of"), (False, 4, "v0. v1 v"), (True, 0, "Other wo"), (True, 0, "w0. w1. ")]
    assert texts(out[0]) == sorted(good)
    left = [(False, 3, "w0. w1. "), (False, 4, "v0. v1 v"), (True, 0, "Other wo")]
    assert texts(out[1]) == texts(out[2]) == texts(out[3]) == left
    last = out[4].collect()
    assert len(last) == 3 and all(r.parity and r.roundtrip and r.n_tokens == len(r.token_ids) for r in last) and max(r.n_tokens for r in last) > 60_000


def test_each_stage_alone_on_null_and_empty_texts_and_empty_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (3, "", "en", "s", 0), (None, None, "en", "s", 0)], SCHEMA)
    for (name, f), want in zip(cp.STAGES, [[], [1, 2], [None, 1, 2, 3], [None, 1, 2, 3], [None, 1, 2, 3]], strict=True):
        assert sorted((r.doc_id for r in f(spark, docs, sf).collect()), key=lambda i: i or 0) == want, name
        assert f(spark, docs.where("false"), sf).count() == 0
