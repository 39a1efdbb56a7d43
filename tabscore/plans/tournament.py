"""Tournament rules: public/private scores, latest submission, file contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabscore.operators.metrics import auc


def public_private_auc(
    df: DataFrame, share: int = 33, key: str = "t_id", label: str = "target", score: str = "probability"
) -> DataFrame:
    """``part, auc``: ``share`` percent of the ids are public, the rest private.

    The part of an id follows from the MD5 of its decimal text, so every run and
    every engine agrees, and ids of any pattern are shared out alike.
    """
    number = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("bigint")
    part = F.when(number % 100 < share, "public").otherwise("private")
    return auc(df.select(part.alias("part"), label, score), label, score, ["part"])


def rank_latest(
    log: DataFrame, user: str, ts: str, metric: str, top: int = 10, tie: str | None = None
) -> DataFrame:
    """Rank users by the metric of their latest submission; best ``top`` only.

    ``max`` of (time, tie, metric) is pre-aggregated, so a user with very many
    submissions is not sorted in one task. ``tie`` orders equal times.
    """
    order = [ts] if tie is None else [ts, tie]
    # NULL metrics of the latest submission stay: the struct carries them along
    latest = log.groupBy(user).agg(F.max(F.struct(*order, F.col(metric).alias("__metric"))).alias("last"))
    best = (
        latest.select(user, F.col(f"last.{ts}").alias(ts), F.col("last.__metric").alias(metric))
        .orderBy(F.desc(metric), user)
        .limit(top)
    )
    return best.select(F.row_number().over(Window.orderBy(F.desc(metric), user)).alias("rank"), "*")


def validate_submission(
    sub: DataFrame, ids: DataFrame, key: str = "t_id", probability: str = "probability"
) -> DataFrame:
    """``key, problem`` for every broken rule; empty means valid.

    Problems: ``missing``, ``unknown``, ``duplicate``, ``no_probability``,
    ``out_of_range``. Both sides are counted per id before they are joined.
    """
    p = F.col(probability).cast("double")
    sent = sub.groupBy(key).agg(
        F.count("*").alias("__n"),
        F.count_if(p.isNull() | F.isnan(p)).alias("__null"),
        F.count_if(((p < 0) | (p > 1)) & ~F.isnan(p)).alias("__range"),
    )
    wanted = ids.select(key).distinct().withColumn("__wanted", F.lit(True))
    both = sent.join(wanted, key, "full")
    problem = F.array_compact(
        F.array(
            F.when(F.col("__n").isNull(), "missing"),
            F.when(F.col("__wanted").isNull(), "unknown"),
            F.when(F.col("__n") > 1, "duplicate"),
            F.when(F.col("__null") > 0, "no_probability"),
            F.when(F.col("__range") > 0, "out_of_range"),
        )
    )
    return both.select(key, F.explode(problem).alias("problem"))
