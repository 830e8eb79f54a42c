"""Points, scores, contributions, risk classes and their stability.

A model is a dict: intercept (number), references (variable -> modality) and coefficients (variable -> modality ->
number, the reference left out).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import as_modality, interval_label, mapped, ratio, sigmoid
from ..sources.files import require
from .binning import vingtiles
from .distributions import density

Model = Mapping[str, object]
#: Vingtiles of each risk class, from the riskiest: first vingtile, last vingtile, name.
CLASSES = ((1, 3, "Very high risk"), (4, 6, "High risk"), (7, 8, "Medium-high risk"), (9, 12, "Medium risk"), (13, 17, "Low risk"), (18, 20, "Very low risk"))
#: What the usual scorecard's variables and modalities are called in reports, for points_table().
VARIABLE_LABELS = {"loan_int_rate_dis": "loan_int_rate", "loan_percent_income_dis": "loan_percent_income", "cb_person_default_on_file": "cb_person_default_on_file", "home_ownership_3": "home_ownership_3"}
MODALITY_LABELS = {
    "loan_int_rate_dis": {"1": "(12.21, 21.825]", "2": "(9.91, 12.21]", "3": "(5.419, 9.91]"},
    "loan_percent_income_dis": {"1": "(0.2, 0.44]", "2": "(0.11, 0.2]", "3": "(-0.001, 0.11]"},
    "cb_person_default_on_file": {"N": "N", "Y": "Y"},
    "home_ownership_3": {"OWN": "OWN", "MORTGAGE": "MORTGAGE", "OTHER_RENT": "OTHER_RENT"},
}
LEAST_GAP, LEAST_SHARE, LEAST_DEFAULTS = 0.30, 0.01, 500


def with_references(model: Model) -> dict[str, dict[str, float]]:
    """Coefficients per variable, the reference's 0 among them."""
    return {v: {model["references"][v]: 0.0} | dict(c) for v, c in model["coefficients"].items()}


def modality_points(model: Model, scale: float = 1000.0) -> dict[str, dict[str, float]]:
    """Points of each modality: its distance from the variable's largest coefficient in units that let the best row reach scale."""
    of = with_references(model)
    spread = {v: max(c.values()) - min(c.values()) for v, c in of.items()}
    whole = sum(spread.values())
    if whole <= 0:
        raise ValueError("no coefficient differs, so there is nothing to score")
    return {v: {m: scale * abs(x - max(c.values())) / whole for m, x in c.items()} for v, c in of.items()}


def points_table(spark, model: Model, scale: float = 1000.0, variable_labels: Mapping[str, str] = VARIABLE_LABELS, modality_labels: Mapping[str, Mapping[str, str]] = MODALITY_LABELS) -> DataFrame:
    """(variable, variable_label, modality, modality_label, coefficient, points) of each modality; what has no label is its own."""
    points, of = modality_points(model, scale), with_references(model)
    rows = [(v, variable_labels.get(v, v), m, modality_labels.get(v, {}).get(m, m), float(of[v][m]), float(p)) for v, c in points.items() for m, p in c.items()]
    return spark.createDataFrame(rows, "variable string, variable_label string, modality string, modality_label string, coefficient double, points double")


def score(df: DataFrame, model: Model, scale: float = 1000.0) -> DataFrame:
    """Add score_<v> and missing_score_<v> per variable, missing_any and score_total; an unknown modality makes the total null.

    Expressions over each row alone, so streams are scored alike.
    """
    points = modality_points(model, scale)
    require(df, points)
    out = df.withColumns({f"score_{v}": mapped(F.col(v).cast("string"), p) for v, p in points.items()})
    out = out.withColumns({f"missing_score_{v}": F.col(f"score_{v}").isNull() for v in points})
    total, missing = F.lit(0.0), F.lit(False)
    for v in points:
        total, missing = total + F.col(f"score_{v}"), missing | F.col(f"missing_score_{v}")
    return out.withColumns({"missing_any": missing, "score_total": total})


def probability(df: DataFrame, model: Model, out: str = "probability") -> DataFrame:
    """Add the model's default probability; a modality without a coefficient counts as the reference."""
    margin = F.lit(float(model["intercept"]))
    for v, c in model["coefficients"].items():
        margin = margin + (F.coalesce(mapped(as_modality(F.col(v)), c), F.lit(0.0)) if c else F.lit(0.0))
    return df.withColumn(out, sigmoid(margin))


def contributions(df: DataFrame, model: Model, scale: float = 1000.0) -> DataFrame:
    """(variable, max_share, mean, sd, sd_share): largest points / 10, mean and deviation of points over the rows, and sd as % of all.

    A modality that has no rows weighs 0; rows of an unknown modality have no points but count among all rows.
    """
    points = modality_points(model, scale)
    rows = [(v, m, float(p)) for v, c in points.items() for m, p in c.items()]
    table = df.sparkSession.createDataFrame(rows, "variable string, modality string, points double")
    counts = df.select(F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), as_modality(F.col(v)).alias("modality")) for v in points])).alias("p")).groupBy("p.variable", "p.modality").agg(F.count(F.lit(1)).alias("n"))
    shares = counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("variable")))
    joined = table.join(shares, ["variable", "modality"], "left").fillna(0.0, ["share"])
    mean = F.sum(F.col("share") * F.col("points"))
    centred = joined.join(joined.groupBy("variable").agg(mean.alias("mean")), "variable")
    spread = F.pow(F.col("points") - F.col("mean"), F.lit(2.0))
    out = centred.groupBy("variable").agg((F.max("points") / (scale / 100)).alias("max_share"), F.first("mean").alias("mean"), F.sqrt(F.sum(F.col("share") * spread)).alias("sd"))
    return out.withColumn("sd_share", ratio(F.col("sd"), F.sum("sd").over(Window.partitionBy())) * 100)


def vingtile_table(df: DataFrame, row_key: Sequence[str], score: str = "score_total", target: str = "def", bins: int = 20) -> DataFrame:
    """(score_vingtile, min_score, max_score, n, n_def, default_rate) over the rows that have a score."""
    return vingtile_rates(vingtiles(df, score, row_key, bins).where("score_vingtile is not null"), score, target, [])


def vingtile_rates(rows: DataFrame, score: str, target: str, by: list[str]) -> DataFrame:
    return rows.groupBy(*by, "score_vingtile").agg(
        F.min(score).alias("min_score"), F.max(score).alias("max_score"), F.count(F.lit(1)).alias("n"), F.sum(F.col(target).cast("long")).alias("n_def"), F.avg(F.col(target).cast("double")).alias("default_rate")
    )


def class_number(vingtile: Column, classes: Sequence[tuple[int, int, str]] = CLASSES) -> Column:
    """The class of a vingtile; vingtile is an expression over many edges, so it is named once."""
    return mapped(vingtile, {v: k for k, (first, last, _) in enumerate(classes, 1) for v in range(first, last + 1)})


def with_classes(df: DataFrame, row_key: Sequence[str], score: str = "score_total", classes: Sequence[tuple[int, int, str]] = CLASSES) -> DataFrame:
    """Add score_vingtile, score_class (from 1, the riskiest; null without a score) and risk_label."""
    out = vingtiles(df, score, row_key).withColumn("score_class", class_number(F.col("score_vingtile"), classes))
    return out.withColumn("risk_label", mapped(F.col("score_class"), {k: name for k, (*_, name) in enumerate(classes, 1)}))


def class_table(rows: DataFrame, score: str = "score_total", target: str = "def") -> DataFrame:
    """A row per risk class of with_classes() rows, with the checks that a class has to pass.

    score_class, risk_label, min_score, max_score, score_interval, n, n_def, default_rate; least, most and range of its
    vingtiles' rates; share (of all rows, unscored ones included); gap: the fall of the rate against the class before,
    as a part of that; gap_ok (at least 30 %, or no class before), share_ok (1 %), defaults_ok (500), size_ok (either).
    """
    require(rows, [score, target, "score_vingtile", "score_class"])
    small = rows.groupBy("score_class", "risk_label", "score_vingtile").agg(F.min(score).alias("lo"), F.max(score).alias("hi"), F.count(F.lit(1)).alias("c"), F.sum(F.col(target).cast("long")).alias("d"))
    everything = F.sum("c").over(Window.partitionBy())  # at most classes x vingtiles rows
    table = small.withColumns({"all": everything, "rate": ratio(F.col("d"), F.col("c"))}).where("score_class is not null").groupBy("score_class", "risk_label").agg(
        F.min("lo").alias("min_score"), F.max("hi").alias("max_score"), F.sum("c").alias("n"), F.sum("d").alias("n_def"),
        F.min("rate").alias("least_rate"), F.max("rate").alias("most_rate"), F.first("all").alias("all"),
    )
    table = table.withColumns({"default_rate": ratio(F.col("n_def"), F.col("n")), "share": ratio(F.col("n"), F.col("all")), "rate_range": F.col("most_rate") - F.col("least_rate")})
    before = F.lag("default_rate").over(Window.orderBy("score_class"))
    table = table.withColumns({"gap": F.try_divide(before - F.col("default_rate"), before), "score_interval": interval_label(F.col("min_score"), F.col("max_score"), open_low=False)})
    table = table.withColumns({"gap_ok": F.coalesce(F.col("gap") >= LEAST_GAP, F.lit(True)), "share_ok": F.col("share") >= LEAST_SHARE, "defaults_ok": F.col("n_def") >= LEAST_DEFAULTS})
    return table.withColumn("size_ok", F.col("share_ok") | F.col("defaults_ok")).drop("all")


def class_summary(table: DataFrame) -> DataFrame:
    """What a reader wants of class_table()."""
    return table.select("score_class", "risk_label", "score_interval", "share", "default_rate", "gap")


def class_stability(rows: DataFrame, period: str = "year", target: str = "def") -> DataFrame:
    """(period, score_class, n, n_def, default_rate, share of the period's scored rows)."""
    table = rows.groupBy(F.col(period).alias("period"), "score_class").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(target).cast("long")).alias("n_def"))
    scored = F.sum(F.when(F.col("score_class").isNotNull(), F.col("n"))).over(Window.partitionBy("period"))
    table = table.withColumns({"default_rate": ratio(F.col("n_def"), F.col("n")), "share": ratio(F.col("n"), scored)})
    return table.where("score_class is not null and period is not null")  # after the window, as else every row's class would be found for the filter and again for the groups


def class_stability_summary(table: DataFrame) -> DataFrame:
    """(score_class, periods, and least, most, mean, sd and cv of the default rate and of the share) over the periods."""
    out = [F.count_distinct("period").alias("periods")]
    for c, name in (("default_rate", "rate"), ("share", "share")):
        out += [F.min(c).alias(f"{name}_min"), F.max(c).alias(f"{name}_max"), F.avg(c).alias(f"{name}_mean"), F.stddev_samp(c).alias(f"{name}_sd")]
    found = table.groupBy("score_class").agg(*out)
    return found.withColumns({f"{name}_cv": F.try_divide(F.col(f"{name}_sd"), F.col(f"{name}_mean")) for name in ("rate", "share")})


def stability_matrix(table: DataFrame, value: str, classes: int = len(CLASSES)) -> DataFrame:
    """A row per period and a column per class of a value of class_stability()."""
    return table.groupBy("period").pivot("score_class", list(range(1, classes + 1))).agg(F.first(value))


def densities(df: DataFrame, score: str = "score_total", target: str = "def", by: str = "dataset", points: int = 300, low: float = 0.0, high: float = 1000.0) -> DataFrame:
    """(by, def, x, density): density() of the score per sample and target on an even grid from low to high."""
    return density(df, score, [by, target], points, low, high)
