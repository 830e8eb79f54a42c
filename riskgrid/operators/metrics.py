"""Ranking metrics of scores: exact curves over the distinct scores of each sample."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import once
from .order import cells, running


def score_counts(df: DataFrame, score: str, target: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., score, n, events): one row per distinct score."""
    return df.where(F.col(score).isNotNull() & F.col(target).isNotNull()).groupBy(*by, F.col(score).cast("double").alias("score")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(target).cast("long")).alias("events"))


def curve(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., score, n, events, tp, fp, pos, neg) in falling order of score: counts at or above each score, and totals."""
    by, counts = list(by), once(counts)
    totals = counts.groupBy(*by).agg(F.sum("events").alias("pos"), F.sum(F.col("n") - F.col("events")).alias("neg"))
    ranked = running(counts.withColumn("others", F.col("n") - F.col("events")), by, "score", ["events", "others"], descending=True)
    ranked = ranked.select(*by, "score", "n", "events", F.col("cum_events").alias("tp"), F.col("cum_others").alias("fp"))
    return ranked.join(totals, by) if by else ranked.crossJoin(F.broadcast(totals))


def metrics(df: DataFrame, score: str, target: str = "def", by: Sequence[str] = (), threshold: float = 0.5) -> DataFrame:
    """(by..., auc, gini, pr_auc, recall, f1) of each sample; null where a class is missing or a ratio has no denominator.

    auc counts ties half; pr_auc is the average precision; recall and f1 call scores of at least threshold positive.
    """
    return measured(score_counts(df, score, target, by), by, threshold)


def measured(counts: DataFrame, by: Sequence[str] = (), threshold: float = 0.5) -> DataFrame:
    """metrics() from counts by score (by..., score, n, events)."""
    by = list(by)
    c = curve(counts, by)
    others, pos, neg = F.col("n") - F.col("events"), F.col("pos").cast("double"), F.col("neg").cast("double")
    won = F.sum(others * (F.col("tp") - F.col("events") + F.col("events") / 2))  # pairs whose positive ranks higher
    hit = F.sum(F.when(F.col("score") >= threshold, F.col("events")).otherwise(0)).cast("double")
    wrong = F.sum(F.when(F.col("score") >= threshold, others).otherwise(0)).cast("double")
    found = c.groupBy(*by).agg(
        won.alias("_won"),
        F.sum(F.col("events") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("_ap"),
        hit.alias("_tp"),
        wrong.alias("_fp"),
        F.first(pos).alias("_pos"),
        F.first(neg).alias("_neg"),
    )
    auc = F.try_divide(F.col("_won"), F.col("_pos") * F.col("_neg"))
    return found.select(
        *by,
        auc.alias("auc"),
        (2 * auc - 1).alias("gini"),
        F.try_divide(F.col("_ap"), F.col("_pos")).alias("pr_auc"),
        F.try_divide(F.col("_tp"), F.col("_pos")).alias("recall"),
        F.try_divide(2 * F.col("_tp"), F.col("_tp") + F.col("_fp") + F.col("_pos")).alias("f1"),
    )


def roc(df: DataFrame, score: str, target: str = "def", by: Sequence[str] = ()) -> DataFrame:
    """(by..., threshold, fpr, tpr): a point per distinct score, one at infinity (0, 0) and one at minus infinity (1, 1)."""
    c = curve(score_counts(df, score, target, by), by)
    point = c.select(*by, F.col("score").alias("threshold"), F.try_divide(F.col("fp").cast("double"), F.col("neg")).alias("fpr"), F.try_divide(F.col("tp").cast("double"), F.col("pos")).alias("tpr"))
    ends = c.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where("_n > 0").select(*by, F.explode(F.array(F.struct(F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("v")), F.struct(F.lit(float("-inf")).alias("threshold"), F.lit(1.0).alias("v")))).alias("e"))
    return point.unionByName(ends.select(*by, F.col("e.threshold").alias("threshold"), F.col("e.v").alias("fpr"), F.col("e.v").alias("tpr")))


def short_roc(df: DataFrame, score: str, target: str = "def", by: Sequence[str] = ()) -> DataFrame:
    """roc() without the points on a straight line between their neighbours; the area below stays the same.

    A point goes where the next step has its slope. Steps are compared within cells of the curve, in whole numbers; the last point of a cell stays.
    """
    by = list(by)
    c = cells(once(curve(score_counts(df, score, target, by), by).drop("_cell")), by, "score")
    following = Window.partitionBy(*by, "_cell").orderBy(F.desc("score"))
    others = F.col("n") - F.col("events")
    straight = F.coalesce(F.col("events") * F.lead(others).over(following) == F.lead("events").over(following) * others, F.lit(False))
    c = c.withColumn("_straight", straight).where("not _straight")
    point = c.select(*by, F.col("score").alias("threshold"), F.try_divide(F.col("fp").cast("double"), F.col("neg")).alias("fpr"), F.try_divide(F.col("tp").cast("double"), F.col("pos")).alias("tpr"))
    start = c.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where("_n > 0").select(*by, F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return point.unionByName(start)


def area(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., points, auc): the area below the points of short_roc(), by trapezoids between neighbours."""
    by = list(by)
    before = Window.partitionBy(*by).orderBy(F.desc("threshold"))
    wide = (F.col("fpr") - F.lag("fpr").over(before)) * (F.col("tpr") + F.lag("tpr").over(before)) / 2
    return points.withColumn("_a", wide).groupBy(*by).agg(F.count(F.lit(1)).alias("points"), F.sum("_a").alias("auc"))


def pr_curve(df: DataFrame, score: str, target: str = "def", by: Sequence[str] = ()) -> DataFrame:
    """(by..., threshold, precision, recall, step): step is the rise of recall against the next higher score."""
    c = curve(score_counts(df, score, target, by), by).select(*by, F.col("score").alias("threshold"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), F.try_divide(F.col("tp").cast("double"), F.col("pos")).alias("recall"), F.try_divide(F.col("events").cast("double"), F.col("pos")).alias("step"))
    return c
