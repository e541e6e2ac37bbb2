"""Folds over ordered rows of a key as scans of sorted ranges.

A step x -> max(c, a x + b) with a >= 0 followed by another is such a step again, so any run of rows is three numbers. Rows
are sorted into ranges by key and order, each range is read as a stream and gives one row per key, and a key's few range
rows are folded in order. No array holds a key's history, and a key of any length is spread over ranges.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Steps = tuple[np.ndarray, np.ndarray, np.ndarray]
_NONE = (1.0, 0.0, -np.inf)  # the step that changes nothing


def after(f: Steps, g: Steps) -> Steps:
    """The step g behind the step f."""
    with np.errstate(invalid="ignore"):
        low = np.where(np.isneginf(f[2]), -np.inf, g[0] * f[2] + g[1])
    return g[0] * f[0], g[0] * f[1] + g[1], np.maximum(g[2], low)


def compose(steps: Steps, start: np.ndarray) -> Steps:
    """Each row's steps since its run's first row composed, in passes of doubled reach; ``start`` is that row."""
    a, b, c = (s.copy() for s in steps)
    far, reach = np.arange(len(start)) - start, 1
    while (i := np.flatnonzero(far >= reach)).size:
        a[i], b[i], c[i] = after((a[i - reach], b[i - reach], c[i - reach]), (a[i], b[i], c[i]))
        reach *= 2
    return a, b, c


def range_steps(df: DataFrame, key: str, order: list[str], steps: Callable[[pd.DataFrame, np.ndarray], Steps]) -> DataFrame:
    """One row per key and range, in the order of (part, run): the columns of the run's first row, the composition (a, b, c)
    of the steps of the rows behind it, the last row's ``last`` (of the first order column) and the number of rows n.

    ``steps`` gives each row's step, from its columns and the first order column of the row before.
    """
    names = df.columns
    schema = T.StructType([*df.schema.fields, *(T.StructField(c, T.DoubleType()) for c in ("a", "b", "c")), T.StructField("last", df.schema[order[0]].dataType), T.StructField("n", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("run", T.LongType())])

    def fold(batches):
        part, run, held = TaskContext.get().partitionId(), 0, None
        for pdf in batches:
            if not len(pdf):
                continue
            k, t = pdf[key].to_numpy(), pdf[order[0]].to_numpy()
            on = held is not None and bool(held[0][key] == k[0])  # the held run goes on
            new = np.concatenate([[not on], k[1:] != k[:-1]])
            start = np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))
            before = np.concatenate([[held[2] if on else t[0]], t[:-1]])
            own = [np.where(new, one, s) for s, one in zip(steps(pdf, before), _NONE, strict=True)]
            whole = compose(tuple(own), start)
            ends = np.concatenate([np.flatnonzero(new[1:]), [len(k) - 1]])
            runs = [[pdf.iloc[start[e]] if new[start[e]] else None, tuple(w[e] for w in whole), t[e], int(e - start[e] + 1)] for e in ends]
            if on:
                runs[0] = [held[0], after(held[1], runs[0][1]), runs[0][2], held[3] + runs[0][3]]
            elif held is not None:
                runs.insert(0, held)
            held = runs.pop()
            if runs:
                yield table(runs, part, run)
                run += len(runs)
        if held is not None:
            yield table([held], part, run)

    def table(runs, part, run):
        head = pd.DataFrame([r[0] for r in runs]).reset_index(drop=True)[names]
        a, b, c = zip(*(r[1] for r in runs), strict=True)
        return head.assign(a=a, b=b, c=c, last=[r[2] for r in runs], n=[r[3] for r in runs], part=part, run=range(run, run + len(runs)))

    # equal rows differ by a number of no meaning, so that a range never grows with their count
    dealt = df.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(key, *order, "__tie").sortWithinPartitions(key, *order, "__tie")
    return dealt.drop("__tie").mapInPandas(fold, schema)


def fold_runs(runs: DataFrame, key: str, start: Column, head: Callable[[Column, Column], Column]) -> DataFrame:
    """The final value per key and its number of rows: ``head`` steps over a run's first row, the run's step over the rest."""
    rows = F.array_sort(F.collect_list(F.struct("part", "run", *[c for c in runs.columns if c not in (key, "part", "run")])))

    def step(acc: Column, r: Column) -> Column:
        x = r["a"] * head(acc, r) + r["b"]
        return F.struct(F.greatest(r["c"], x).alias("x"), r["last"].cast("double").alias("last"))

    zero = F.struct(start.cast("double").alias("x"), F.lit(None).cast("double").alias("last"))
    return runs.groupBy(key).agg(F.aggregate(rows, zero, step, lambda acc: acc["x"]).alias("x"), F.sum("n").alias("n"))
