"""ROC AUC, accuracy, performance reports, early stopping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabscore.operators.ordered import number_within_ranges, order_columns, position_of, range_of, tag_ranges


def _binary(label: str) -> Column:
    y = F.col(label).cast("double")
    return F.when(y.isin(0.0, 1.0), y).otherwise(F.raise_error(F.lit(f"{label} must be 0 or 1")))


def _earlier_ranges(by: list[str]) -> Window:
    """Earlier ranges of the same group; the input has one row per (range, group)."""
    return Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)


def auc(
    df: DataFrame,
    label: str,
    score: str,
    by: list[str] | tuple = (),
    ties: str = "average",
    order_by=None,
    fractional: bool = False,
) -> DataFrame:
    """Exact area under the ROC curve: ``*by, auc``.

    ``ties='average'`` counts a tie as half. ``ties='order'`` resolves ties by
    ``order_by``, which must make the row order total. ``fractional`` allows an
    outcome between 0 and 1 (ties by order only). A group with one class only
    gives NULL. NULL scores rank lowest.
    """
    if ties == "average":
        if fractional:
            raise ValueError("a fractional outcome needs ties='order'")
        return _auc_average(df, label, score, list(by))
    if ties != "order":
        raise ValueError(f"unknown ties {ties!r}")
    if order_by is None:
        raise ValueError("ties='order' needs order_by")
    return _auc_order(df, label, score, list(by), order_columns(order_by), fractional)


def _score_counts(df: DataFrame, label: str, score: str, by: list[str]) -> DataFrame:
    """``*by, __score, pos, neg``, one row for each distinct score: a hot score is one row before it travels."""
    rows = df.select(*by, F.col(score).cast("double").alias("__score"), _binary(label).alias("__y"))
    return rows.groupBy(*by, "__score").agg(F.sum("__y").alias("pos"), F.sum(1 - F.col("__y")).alias("neg"))


def _auc_average(df: DataFrame, label: str, score: str, by: list[str]) -> DataFrame:
    # Two exchanges of distinct scores: the one that counts them, and the one of the window.
    below = (
        Window.partitionBy("__range", *by).orderBy("__score").rowsBetween(Window.unboundedPreceding, -1)
    )
    won = F.col("pos") * (F.coalesce(F.sum("neg").over(below), F.lit(0.0)) + F.col("neg") / 2)
    per_range = (
        tag_ranges(_score_counts(df, label, score, by), "__score")
        .select("__range", *by, "pos", "neg", won.alias("won"))
        .groupBy("__range", *by)
        .agg(F.sum("won").alias("won"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    )
    start = F.coalesce(F.sum("neg").over(_earlier_ranges(by)), F.lit(0.0))
    pairs = F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0.0))
    return (
        per_range.select("*", start.alias("start"))
        .groupBy(*by)
        .agg((F.sum(F.col("won") + F.col("pos") * F.col("start")) / pairs).alias("auc"))
    )


def _auc_order(
    df: DataFrame, label: str, score: str, by: list[str], order: list[Column], fractional: bool
) -> DataFrame:
    # Sum of y * (rank - running sum of y). The running sum needs no order:
    # sum_i y_i * sum_{j<=i} y_j = ((sum y)^2 + sum y^2) / 2. The rank is the
    # position inside the range plus the rows of the earlier ranges.
    y = F.col(label).cast("double") if fractional else _binary(label)
    rows = df.withColumns({"__y": y, "__score": F.col(score).cast("double")})
    numbered = number_within_ranges(rows, [*by, F.desc("__score"), *order])
    per_range = (
        numbered.select(*by, "__y", range_of().alias("__range"), position_of().alias("__pos"))
        .groupBy("__range", *by)
        .agg(
            F.count("*").alias("n"),
            F.min("__pos").alias("first"),
            F.sum("__y").alias("s"),
            F.sum(F.col("__y") * F.col("__y")).alias("q"),
            F.sum(F.col("__y") * F.col("__pos")).alias("t"),
        )
    )
    start = F.coalesce(F.sum("n").over(_earlier_ranges(by)), F.lit(0))
    ranks = F.col("t") + (F.col("start") - F.col("first") + 1) * F.col("s")
    total = F.sum("s")
    above = F.sum(ranks) - (total * total + F.sum("q")) / 2
    pairs = F.nullif(total * (F.sum("n") - total), F.lit(0.0))
    return per_range.select("*", start.alias("start")).groupBy(*by).agg((1 - above / pairs).alias("auc"))


def accuracy(df: DataFrame, label: str, pred: str) -> DataFrame:
    return df.agg(F.avg((F.col(pred) == F.col(label)).cast("double")).alias("accuracy"))


def performance(df: DataFrame, label: str, p: str, cut: float = 0.5, by: list[str] | tuple = ()) -> DataFrame:
    """One row per group: n, AUC, log loss, MSE, accuracy and confusion counts at ``cut``.

    Every row must have a score; one that is NULL or NaN raises.
    """
    by = list(by)
    y, prob = _binary(label), F.col(p).cast("double")
    lacking = F.raise_error(F.lit(f"{p} is NULL or NaN")).cast("boolean")
    df = df.filter(F.when(prob.isNotNull() & ~F.isnan(prob), F.lit(True)).otherwise(lacking))
    safe = F.least(F.greatest(prob, F.lit(1e-15)), F.lit(1 - 1e-15))
    yes, hit = prob > cut, y == 1.0
    rows = df.select(
        *by,
        (-F.log(F.when(hit, safe).otherwise(1 - safe))).alias("loss"),
        ((prob - y) * (prob - y)).alias("se"),
        hit.alias("hit"),
        yes.alias("yes"),
    )
    report = rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg("loss").alias("logloss"),
        F.avg("se").alias("mse"),
        F.avg((F.col("hit") == F.col("yes")).cast("double")).alias("accuracy"),
        F.count_if(F.col("yes") & F.col("hit")).alias("tp"),
        F.count_if(F.col("yes") & ~F.col("hit")).alias("fp"),
        F.count_if(~F.col("yes") & ~F.col("hit")).alias("tn"),
        F.count_if(~F.col("yes") & F.col("hit")).alias("fn"),
    )
    area = auc(df, label, p, by)
    if not by:
        return report.select("*", area.scalar().alias("auc"))
    named = area.select(*[F.col(b).alias(f"__b_{b}") for b in by], "auc")
    match = [F.col(b).eqNullSafe(F.col(f"__b_{b}")) for b in by]
    return report.join(named, match).select(*report.columns, "auc")


def _running(df: DataFrame, label: str, p: str, by: list[str]) -> DataFrame:
    """Distinct scores with the rows (``tp``, ``fp``) of that score or a greater one, and the totals ``p_all``, ``n_all``.

    Runs inside ranges of scores; what is joined back is one row for each range and group.
    """
    x = F.col(p).cast("double")
    lacking = F.raise_error(F.lit(f"{p} is NULL or NaN")).cast("boolean")
    known = df.filter(F.when(x.isNotNull() & ~F.isnan(x), F.lit(True)).otherwise(lacking))
    tagged = tag_ranges(_score_counts(known, label, p, by), "__score")
    down = Window.partitionBy("__range", *by).orderBy(F.desc("__score")).rowsBetween(Window.unboundedPreceding, 0)
    runs = tagged.select("*", F.sum("pos").over(down).alias("tp"), F.sum("neg").over(down).alias("fp"))
    ranges = tagged.groupBy("__range", *by).agg(F.sum("pos").alias("rp"), F.sum("neg").alias("rn"))
    whole = Window.partitionBy(*by)
    later = whole.orderBy("__range").rowsBetween(1, Window.unboundedFollowing)

    def above(c: str) -> Column:
        return F.coalesce(F.sum(c).over(later), F.lit(0.0))

    starts = ranges.select(
        F.col("__range").alias("__r"),
        *[F.col(b).alias(f"__b_{b}") for b in by],
        above("rp").alias("above_p"),
        above("rn").alias("above_n"),
        F.sum("rp").over(whole).alias("p_all"),
        F.sum("rn").over(whole).alias("n_all"),
    )
    match = F.col("__range") == F.col("__r")
    for b in by:
        match = match & F.col(b).eqNullSafe(F.col(f"__b_{b}"))
    return runs.join(starts, match).select(
        *by,
        F.col("__score").alias("threshold"),
        "pos",
        "neg",
        (F.col("tp") + F.col("above_p")).alias("tp"),
        (F.col("fp") + F.col("above_n")).alias("fp"),
        "p_all",
        "n_all",
    )


THRESHOLD_METRICS = (
    "f1", "f2", "f0point5", "accuracy", "precision", "recall", "specificity", "mcc", "min_class_accuracy", "mean_class_accuracy",
)


def threshold_sweep(df: DataFrame, label: str, p: str, by: list[str] | tuple = ()) -> DataFrame:
    """``*by, threshold, tp, fp, tn, fn`` and ``THRESHOLD_METRICS``: one row for each distinct score.

    A row is predicted 1 where its score is the threshold or greater. A metric
    whose denominator is 0 is NULL. A score that is NULL or NaN raises.
    """
    by = list(by)
    counts = _running(df, label, p, by).select(
        *by,
        "threshold",
        "tp",
        "fp",
        (F.col("n_all") - F.col("fp")).alias("tn"),
        (F.col("p_all") - F.col("tp")).alias("fn"),
    )
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))

    def part(a: Column, b: Column) -> Column:
        return a / F.nullif(b, F.lit(0.0))

    def f_score(beta: float) -> Column:
        w = beta * beta
        return part((1 + w) * tp, (1 + w) * tp + w * fn + fp)

    recall, specificity = part(tp, tp + fn), part(tn, tn + fp)
    metrics = {
        "f1": f_score(1.0),
        "f2": f_score(2.0),
        "f0point5": f_score(0.5),
        "accuracy": part(tp + tn, tp + fp + tn + fn),
        "precision": part(tp, tp + fp),
        "recall": recall,
        "specificity": specificity,
        "mcc": part(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))),
        # NULL where a class has no rows
        "min_class_accuracy": F.when(recall.isNotNull() & specificity.isNotNull(), F.least(recall, specificity)),
        "mean_class_accuracy": (recall + specificity) / 2,
    }
    whole = [F.col(c).cast("long").alias(c) for c in ("tp", "fp", "tn", "fn")]
    return counts.select(*by, "threshold", *whole, *[metrics[m].alias(m) for m in THRESHOLD_METRICS])


def best_thresholds(df: DataFrame, label: str, p: str, by: list[str] | tuple = ()) -> DataFrame:
    """``*by, metric, value, threshold, tp, fp, tn, fn``: where each metric is greatest; of equal values the greatest threshold."""
    by = list(by)
    sweep = threshold_sweep(df, label, p, by)
    at = ["threshold", "tp", "fp", "tn", "fn"]
    best = [F.max(F.when(F.col(m).isNotNull(), F.struct(F.col(m).alias("value"), *at))).alias(m) for m in THRESHOLD_METRICS]
    wide = sweep.groupBy(*by).agg(*best)
    each = [F.struct(F.lit(m).alias("metric"), F.col(m).alias("at")) for m in THRESHOLD_METRICS]
    return wide.select(*by, F.inline(F.array(*each))).select(*by, "metric", "at.*")


def gains_lift(df: DataFrame, label: str, p: str, groups: int = 16, by: list[str] | tuple = ()) -> DataFrame:
    """``*by, group, n, n_pos, lower, response, lift, capture, cum_n, cum_pos, cum_lift, cum_capture``.

    Rows go into ``groups`` equal parts by falling score; rows of one score stay
    together, in the part where the first of them falls. ``lift`` is the part's
    rate of 1 over that of all rows, ``capture`` its share of all 1s; ``cum_``
    counts this part and all above it.
    """
    by = list(by)
    running = _running(df, label, p, by)
    before = F.col("tp") + F.col("fp") - F.col("pos") - F.col("neg")
    total = F.col("p_all") + F.col("n_all")
    parts = (
        running.withColumn("group", (F.floor(before * groups / total) + 1).cast("int"))
        .groupBy(*by, "group")
        .agg(
            F.sum(F.col("pos") + F.col("neg")).alias("n"),
            F.sum("pos").alias("n_pos"),
            F.min("threshold").alias("lower"),
            F.max(F.col("tp") + F.col("fp")).alias("cum_n"),
            F.max("tp").alias("cum_pos"),
            F.first("p_all").alias("p_all"),
            F.first(total).alias("total"),
        )
    )
    rate, positives = F.nullif(F.col("p_all"), F.lit(0.0)) / F.col("total"), F.nullif(F.col("p_all"), F.lit(0.0))
    return parts.select(
        *by,
        "group",
        F.col("n").cast("long").alias("n"),
        F.col("n_pos").cast("long").alias("n_pos"),
        "lower",
        (F.col("n_pos") / F.col("n")).alias("response"),
        (F.col("n_pos") / F.col("n") / rate).alias("lift"),
        (F.col("n_pos") / positives).alias("capture"),
        F.col("cum_n").cast("long").alias("cum_n"),
        F.col("cum_pos").cast("long").alias("cum_pos"),
        (F.col("cum_pos") / F.col("cum_n") / rate).alias("cum_lift"),
        (F.col("cum_pos") / positives).alias("cum_capture"),
    )


def early_stop(
    history: DataFrame,
    rounds: int,
    tol: float,
    maximize: bool = True,
    model: str = "model_id",
    round_col: str = "round",
    metric: str = "metric",
) -> DataFrame:
    """First round at which training should stop, per model (NULL: never).

    Moving averages over ``rounds`` values: stop when the best of the last
    ``rounds`` averages is not better than the one before them by the relative
    tolerance. ``rounds=0`` switches stopping off. One group holds one model's
    history, that is one row per training round.
    """
    ordered = Window.partitionBy(model).orderBy(round_col)
    if rounds == 0:
        return history.groupBy(model).agg(F.lit(None).cast("int").alias("stop_round"))
    last = ordered.rowsBetween(-rounds + 1, 0)
    smooth = history.select(
        model,
        F.col(round_col).alias("round"),
        F.when(F.count("*").over(last) == rounds, F.avg(metric).over(last)).alias("smooth"),
    )
    w = Window.partitionBy(model).orderBy("round")
    best = (F.max if maximize else F.min)("smooth").over(w.rowsBetween(-rounds + 1, 0))
    marked = smooth.select(model, "round", best.alias("best"), F.lag("smooth", rounds).over(w).alias("before"))
    change = F.col("best") - F.col("before") if maximize else F.col("before") - F.col("best")
    stalled = change < F.abs(F.col("before")) * tol
    return marked.groupBy(model).agg(F.min(F.when(stalled, F.col("round"))).alias("stop_round"))


def stop_round(values: list[float], rounds: int, tol: float, maximize: bool = True) -> int | None:
    """The rule of ``early_stop`` on one short list; rounds count from 1."""
    if rounds == 0:
        return None
    smooth = [sum(values[i - rounds + 1 : i + 1]) / rounds for i in range(rounds - 1, len(values))]
    for i in range(rounds, len(smooth)):
        recent, before = smooth[i - rounds + 1 : i + 1], smooth[i - rounds]
        change = max(recent) - before if maximize else before - min(recent)
        if change < abs(before) * tol:
            return i + rounds
    return None
