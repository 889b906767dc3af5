"""Evaluation of 0/1 predictions and of real-valued scores by aggregations."""

from __future__ import annotations

from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.operators.lookup import broadcast_if_small
from flowlens.session import materialize

RANGE_ROWS = 1_000_000


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def accuracy_of(prediction: Column, label: Column) -> Column:
    """Aggregate: fraction of equal pairs, for labels of any type."""
    return F.avg((prediction == label).cast("double"))


def confusion(
    df: DataFrame, prediction: str = "prediction", label: str = "label", by: tuple[str, ...] = ()
) -> DataFrame:
    """Counts tp, fp, tn, fn of 0/1 predictions, optionally per group."""
    p, y = F.col(prediction) == 1, F.col(label) == 1
    return df.groupBy(*by).agg(
        F.count_if(p & y).alias("tp"),
        F.count_if(p & ~y).alias("fp"),
        F.count_if(~p & ~y).alias("tn"),
        F.count_if(~p & y).alias("fn"),
    )


def hard_metrics(
    df: DataFrame, prediction: str = "prediction", label: str = "label", by: tuple[str, ...] = ()
) -> DataFrame:
    """Accuracy, and the areas under the ROC and PR curves of hard predictions.

    With a single cut-off the ROC area is the mean of both class recalls, and the
    PR curve consists of the points (0, P), (R, P) and (1, share of positives).
    """
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    total, positives, negatives = tp + fp + tn + fn, tp + fn, tn + fp
    recall, specificity = _ratio(tp, positives), _ratio(tn, negatives)
    precision = F.coalesce(_ratio(tp, tp + fp), F.lit(0.0))
    share = _ratio(positives, total)
    area_pr = recall * precision + (1 - recall) * (precision + share) / 2
    return confusion(df, prediction, label, by).select(
        *by,
        "tp",
        "fp",
        "tn",
        "fn",
        _ratio(tp + tn, total).alias("accuracy"),
        ((recall + specificity) / 2).alias("auroc_hard"),
        area_pr.alias("aupr_hard"),
    )


def ranking_area(
    df: DataFrame, score: str = "rawPrediction", label: str = "label", metric: str = "areaUnderROC"
) -> float:
    """Area under the curve of the real-valued scores, for comparison with the above."""
    return BinaryClassificationEvaluator(
        rawPredictionCol=score, labelCol=label, metricName=metric
    ).evaluate(df)


# --- real-valued scores, per group ---------------------------------------------------------


def curve_points(
    df: DataFrame,
    score: str = "score",
    label: str = "label",
    by: tuple[str, ...] = (),
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """A row per group and distinct score, from the highest one down: ``by``, the score,
    ``pos`` and ``neg`` rows that have it, and ``tp`` and ``fp``, those at or above it.

    Rows of equal scores are counted before anything is sorted. The counts are then stored
    in ranges of groups and scores; each range adds up its own, and what the ranges before
    it hold of a group is added, so no task sorts a group. Rows without a score (NaN is
    none) or a label take no part.
    """
    value, truth = F.col(score).cast("double"), F.col(label) == 1
    counts = (
        df.where(value.isNotNull() & ~F.isnan(value) & F.col(label).isNotNull())
        .groupBy(*by, (value + 0.0).alias(score))
        .agg(F.count_if(truth).alias("pos"), F.count_if(~truth).alias("neg"))
    )
    counts = materialize(counts, "score-counts")
    parts = max(1, -(-counts.count() // range_rows))
    order = [*[F.col(c) for c in by], F.desc(score)]
    ranged = materialize(
        counts.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "score-ranges"
    )
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    held = ranged.groupBy(*by, "_part").agg(F.sum("pos").alias("_pos"), F.sum("neg").alias("_neg"))
    before = broadcast_if_small(
        held.select(
            *[F.col(c).alias(f"_by_{c}") for c in by],
            F.col("_part").alias("_of"),
            F.coalesce(F.sum("_pos").over(earlier), F.lit(0)).alias("_tp"),
            F.coalesce(F.sum("_neg").over(earlier), F.lit(0)).alias("_fp"),
        )
    )
    same = F.col("_part") == F.col("_of")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    inside = Window.partitionBy(*by, "_part").orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    return (
        ranged.withColumn("tp", F.sum("pos").over(inside))
        .withColumn("fp", F.sum("neg").over(inside))
        .join(before, same)
        .select(
            *by, score, "pos", "neg",
            (F.col("tp") + F.col("_tp")).alias("tp"), (F.col("fp") + F.col("_fp")).alias("fp"),
        )
    )


def ranking_areas(
    df: DataFrame,
    score: str = "score",
    label: str = "label",
    by: tuple[str, ...] = (),
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """``by, positives, negatives, auroc, aupr`` of real-valued scores, exact with ties.

    The ROC area is the share of pairs of a positive and a negative row that the scores put
    right, equal scores counting half. The PR curve starts at no recall with the precision of
    the highest score; straight lines join its points. A group of one class has null areas.
    """
    points = curve_points(df, score, label, by, range_rows)
    pos, neg, tp, fp = (F.col(c).cast("double") for c in ("pos", "neg", "tp", "fp"))
    above, wrong = tp - pos, fp - neg
    precision = tp / (tp + fp)
    before = F.when(above + wrong > 0, above / (above + wrong)).otherwise(precision)
    sums = points.groupBy(*by).agg(
        F.sum("pos").alias("positives"),
        F.sum("neg").alias("negatives"),
        F.sum(neg * (above + pos / 2)).alias("_pairs"),
        F.sum(pos * (precision + before) / 2).alias("_area"),
    )
    both = (F.col("positives") > 0) & (F.col("negatives") > 0)
    return sums.select(
        *by,
        "positives",
        "negatives",
        F.when(both, F.col("_pairs") / F.col("positives") / F.col("negatives")).alias("auroc"),
        F.when(both, F.col("_area") / F.col("positives")).alias("aupr"),
    )


# --- how far a linear separator is from the best one ---------------------------------------


def hinge_certificate(
    df: DataFrame,
    coefficients: list[float],
    intercept: float,
    reg: float,
    features: str = "features",
    label: str = "label",
) -> DataFrame:
    """One row: ``n, loss, objective, norm, gap`` of a separator for the mean hinge loss plus
    ``reg / 2`` times the squared coefficients, from one aggregation.

    ``norm`` is that of the subgradient in which rows on the margin count as within; ``gap``
    is the objective less a lower bound of the best one: the dual value of the rows within the
    margin, their weights evened out between the classes so that they are feasible. A
    gap of zero proves the separator best. ``features`` is an array of numbers, ``reg`` above 0.
    """
    if reg <= 0:
        raise ValueError("reg must be above 0")
    weights = F.lit([float(c) for c in coefficients])
    margin = F.aggregate(
        F.zip_with(F.col(features), weights, lambda x, w: x * w), F.lit(float(intercept)), lambda a, x: a + x
    )
    rows = df.select(
        F.col(features).alias("_x"), F.when(F.col(label) == 1, 1.0).otherwise(-1.0).alias("_y"), margin.alias("_m")
    ).withColumn("_in", F.when(F.col("_y") * F.col("_m") <= 1, 1.0).otherwise(0.0))
    inside, y = F.col("_in"), F.col("_y")
    sums = rows.agg(
        F.count("*").alias("n"),
        F.sum(F.greatest(F.lit(0.0), 1 - y * F.col("_m"))).alias("hinge"),
        *[
            F.sum(F.when(y == sign, inside * F.get("_x", F.lit(j)))).alias(f"{name}{j}")
            for sign, name in ((1.0, "p"), (-1.0, "q"))
            for j in range(len(coefficients))
        ],
        F.coalesce(F.sum(F.when(y == 1, inside)), F.lit(0.0)).alias("p"),
        F.coalesce(F.sum(F.when(y == -1, inside)), F.lit(0.0)).alias("q"),
    )
    n = F.col("n").cast("double")
    p, q = F.col("p"), F.col("q")
    few = F.least(p, q)
    slope = gained = F.lit(0.0)
    for j, w in enumerate(coefficients):
        one, other = (F.coalesce(F.col(f"{name}{j}"), F.lit(0.0)) for name in "pq")
        part = F.lit(reg * w) - (one - other) / n
        slope = slope + part * part
        even = F.when(few > 0, (one * few / p - other * few / q) / n).otherwise(0.0)
        gained = gained + even * even
    slope = slope + F.pow((p - q) / n, F.lit(2))
    square = sum(float(w) * float(w) for w in coefficients)
    loss = F.col("hinge") / n
    objective = loss + F.lit(reg / 2 * square)
    # The weights may also be scaled down together: the best share of them is a parabola's top.
    share = F.when(gained > 0, F.least(F.lit(1.0), 2 * few / n * reg / gained)).otherwise(1.0)
    dual = share * 2 * few / n - share * share * gained / (2 * reg)
    return sums.select(
        "n", loss.alias("loss"), objective.alias("objective"), F.sqrt(slope).alias("norm"),
        (objective - dual).alias("gap"),
    )
