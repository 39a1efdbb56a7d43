"""Model output as keyed columns."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def positive_probability(col: str = "probability") -> Column:
    return F.get(vector_to_array(F.col(col)), F.lit(1))


def _with_score(model: PipelineModel, df: DataFrame, out: str) -> DataFrame:
    """``df`` and the score of ``model``; its working columns are gone."""
    scored = model.transform(df)
    value = positive_probability() if "probability" in scored.columns else F.col("prediction")
    return scored.select(*df.columns, value.alias(out))


def score(
    model: PipelineModel,
    df: DataFrame,
    key: str | list[str],
    out: str = "p1",
    keep: list[str] | tuple = (),
    p0: str | None = None,
) -> DataFrame:
    """``key, *keep, out``: the probability of class 1 (and of class 0 as ``p0``).

    A model without probabilities (a linear SVM) gives its class label.
    """
    keys = [key] if isinstance(key, str) else list(key)
    scored = _with_score(model, df, out).select(*keys, *keep, out)
    return scored if p0 is None else scored.withColumn(p0, 1 - F.col(out))


def score_many(
    models: dict[str, PipelineModel], df: DataFrame, key: str | list[str], keep: list[str] | tuple = ()
) -> DataFrame:
    """``key, *keep`` and one score column per model, in one scan and without a join."""
    keys = [key] if isinstance(key, str) else list(key)
    for out, model in models.items():
        df = _with_score(model, df, out)
    return df.select(*keys, *keep, *models)
