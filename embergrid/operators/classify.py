"""A learned verdict on candidates: context parameters of the contextual tests and a random forest over them."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTEXT = ("x1", "x2", "x3", "x4")
FEATURES = (*CONTEXT, "bt7", "bt14", "btd", "day")


def context_parameters(px: DataFrame, scale: float = 1.0) -> DataFrame:
    """Append by how much a candidate exceeds what its background allows: x1 and x2 for the difference of the bands (by 3.5
    deviations, by 5.5 K), x3 for the hot band (by 3 deviations), x4 for the other (by one deviation less 4 K).

    Needs the columns of ``background_stats``; without enough background all are null.
    """
    x = {
        "x1": F.col("btd") - (F.col("mu_btd") + 3.5 * F.col("sd_btd")), "x2": F.col("btd") - (F.col("mu_btd") + 5.5 * scale),
        "x3": F.col("bt7") - (F.col("mu_bt7") + 3 * F.col("sd_bt7")), "x4": F.col("bt14") - (F.col("mu_bt14") + F.col("sd_bt14") - 4 * scale),
    }
    return px.withColumns(x)


def fit_forest(rows: DataFrame, features: tuple[str, ...] = FEATURES, trees: int = 100, depth: int = 20, seed: int = 42) -> PipelineModel | None:
    """A forest that tells rows with label 1 from those with label 0; rows without a label or a feature teach nothing. None
    without rows of both labels."""
    rows = rows.dropna(subset=["label", *features])
    if rows.select("label").distinct().limit(2).count() < 2:
        return None
    vector = VectorAssembler(inputCols=list(features), outputCol="__x", handleInvalid="skip")
    forest = RandomForestClassifier(featuresCol="__x", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed)
    return Pipeline(stages=[vector, forest]).fit(rows.withColumn("label", F.col("label").cast("double")))


def forest_scores(rows: DataFrame, model: PipelineModel | None, threshold: float = 0.5) -> DataFrame:
    """Append score (0 to 1, null where a feature is missing or without a model) and predicted."""
    if model is None:
        return rows.withColumn("score", F.lit(None).cast("double")).withColumn("predicted", F.lit(None).cast("int"))
    keep = model.stages[0].copy().setHandleInvalid("keep")  # missing features become NaN, so that no row is lost
    out = model.stages[1].transform(keep.transform(rows))
    known = F.lit(True)
    for c in keep.getInputCols():
        known = known & F.col(c).isNotNull()
    score = F.when(known, vector_to_array("probability")[1])
    return out.select(*rows.columns, score.alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
