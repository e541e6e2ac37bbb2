"""Operator 13 against a plain restatement: one batch and many, copies in every order, resumed runs, odd rows."""

import random
from collections import Counter
from itertools import permutations

import pytest

from embergrid.llm import filter_audit as fa

DOCS = "doc_id long, text string, lang string"
LABELS = "doc_id long, quality int, toxic int"


def mask(text: str) -> int:
    words = "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text).split(" ")
    words = [w for w in words if w]
    bits = (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text), any(c in "#$%&*|" for c in text))
    return sum(1 << i for i, b in enumerate(bits) if b)


def plain(rows, labels):
    """Counts by part, order and step, document by document."""
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good, toxic = ({i for i, *v in labels if v[k] == 1 and i is not None} for k in (0, 1))
    docs = [((lang or ""), mask(t or "") | (16 if i is not None and i > least[t or ""] else 0), i in good, i in toxic) for i, t, lang in rows]
    out = {}
    for part in {d[0] for d in docs}:
        mine, first = [d for d in docs if d[0] == part], Counter()
        for order in map("".join, permutations("ABCDE")):
            gone = [False] * len(mine)
            for step, f in enumerate(order, 1):
                bit, n = 1 << "ABCDE".index(f), Counter()
                for k, (_, m, g, x) in enumerate(mine):
                    if m & bit:
                        n["redundant" if gone[k] else "removed"] += 1
                        n["unique"] += m == bit
                        n["good"] += g and not gone[k]
                        n["toxic"] += x and not gone[k]
                        gone[k] = True
                first[f] += n["removed"]
                out[part, order, step] = [gone.count(False), n["removed"], n["redundant"], n["unique"], n["good"], n["toxic"]]
        for order in map("".join, permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                out[part, order, step].append(first[f])
    return out


def found(df):
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in df.collect()}


@pytest.fixture(scope="module")
def made():
    rnd = random.Random(13)
    base = ["", "  \t ", "Some words # here", "lorem dolor " * 150, " ".join(f"w{i}" for i in range(250)), "A" * 3 + " b" * 97, "x\x0by\x85z q", "UPPER " + " ".join(f"v{i}" for i in range(220)), " ".join(f"k{i}" for i in range(210)) + " 5%", None]
    rows = [(rnd.choice([None, *range(60)]), rnd.choice(base), rnd.choice(["en", "de", "", None])) for _ in range(400)]
    rows += [(5, base[4], "en")] * 3 + [(500 - i, "one text, ids falling", "en") for i in range(40)] + [(None, None, None)]
    labels = [(rnd.choice([None, *range(60)]), rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for _ in range(80)] + [(480, 1, 1)]
    return rows, labels


def write(spark, folder, rows, files):
    """Files in the order of their names and times, so that batches come in that order."""
    for k in range(files):
        spark.createDataFrame(rows[k::files], DOCS).coalesce(1).write.mode("append").parquet(str(folder))


def test_many_batches_equal_a_plain_count(spark, made, tmp_path):
    rows, labels = made
    write(spark, tmp_path / "d", rows, 4)
    got = fa.filter_audit(spark, f"file://{tmp_path}/d", spark.createDataFrame(labels, LABELS), batches=4)
    assert found(got) == plain(rows, labels)


def test_changes_take_back_what_a_smaller_id_makes_a_copy(spark, tmp_path):
    """Ids fall from batch to batch: each batch retracts the last holder, and only the sums are right."""
    docs, work = f"file://{tmp_path}/d", f"file://{tmp_path}/w"
    labels = spark.createDataFrame([(9, 1, 0)], LABELS)
    text = "a short text"
    spark.createDataFrame([(9, text, "en")], DOCS).write.parquet(docs)
    assert {(r["mask"], r.good): r.n for r in fa.filter_counters(spark, docs, labels, folder=work).collect()} == {(1, True): 1}
    spark.createDataFrame([(7, text, "de"), (8, text, "de")], DOCS).coalesce(1).write.mode("append").parquet(docs)
    counters = fa.filter_counters(spark, docs, labels, folder=work)  # goes on from the stored state
    assert {(r.part, r["mask"], r.good): r.n for r in counters.collect()} == {("en", 17, True): 1, ("de", 1, False): 1, ("de", 17, False): 1}
    changes = spark.read.parquet(f"{work}/changes").where("good").collect()
    assert sorted((r["mask"], r.n) for r in changes) == [(1, -1), (1, 1), (17, 1)]
    again = fa.filter_counters(spark, docs, labels, folder=work)  # nothing new: nothing changes
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, counters.collect()))


def test_empty_table_and_clashing_columns(spark, tmp_path):
    labels = spark.createDataFrame([], LABELS)
    spark.createDataFrame([], DOCS).write.parquet(f"file://{tmp_path}/e")
    assert fa.filter_audit(spark, f"file://{tmp_path}/e", labels).count() == 0
    spark.createDataFrame([(1, "t", "en", 5, "p", True)], DOCS + ", mask int, part string, settled boolean").write.parquet(f"file://{tmp_path}/c")
    assert found(fa.filter_audit(spark, f"file://{tmp_path}/c", labels)) == plain([(1, "t", "en")], [])
