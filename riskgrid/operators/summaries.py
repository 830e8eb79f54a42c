"""Default summaries, tables and profiles."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import half_even, ratio
from ..sources.files import once, require
from .order import melted, quantiles, running

SORT_KEYS = ("count", "defaults", "prop", "default_rate", "category")


def counted(target: str) -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), F.sum(F.col(target).cast("long")).alias("n_def")]


def default_summary(df: DataFrame, category: str, target: str = "def", sort_by: str = "count", ascending: bool = False, include_missing: bool = False, declared: Sequence[str] | None = None) -> DataFrame:
    """(row, category, n, prop, n_def, default_rate): a row per category in the wanted order, and a Total row last.

    A missing category is left out, or counts as 'Missing'. Ties are ordered by category. declared: the categories of an ordered domain; each
    has a row, of count 0 and without a rate where none of it is there, category order (of sort_by and of ties) is theirs, and any other category
    is missing.
    """
    require(df, [category, target])
    if sort_by not in SORT_KEYS:
        raise ValueError(f"sort_by must be one of {SORT_KEYS}")
    value = F.col(category).cast("string")
    if declared is not None:
        value = F.when(value.isin(list(declared)), value)
    rows = df.select(F.coalesce(value, F.lit("Missing")) if include_missing else value, F.col(target).cast("long")).toDF("category", target).where("category is not null")
    table = rows.rollup("category").agg(*counted(target), F.grouping("category").alias("total"))
    table = table.where("n > 0")
    place = F.col("category")
    if declared is not None:
        domain = df.sparkSession.createDataFrame([(c, k) for k, c in enumerate(declared)], "category string, place int")  # a row a category
        table = table.join(domain.drop("place"), "category", "full").fillna(0, ["n", "n_def", "total"]).join(domain, "category", "left")
        place = F.coalesce("place", F.lit(len(declared)))
    table = table.withColumns({"prop": ratio(F.col("n"), F.sum(F.when(F.col("total") == 1, F.col("n"))).over(Window.partitionBy())), "default_rate": ratio(F.col("n_def"), F.col("n"))})
    key = {"count": F.col("n"), "defaults": F.col("n_def"), "category": place}.get(sort_by, F.col(sort_by))
    order = Window.orderBy("total", key.asc_nulls_last() if ascending else key.desc_nulls_last(), place)  # a row per category
    return table.withColumn("row", F.row_number().over(order)).select("row", F.when(F.col("total") == 1, "Total").otherwise(F.col("category")).alias("category"), "n", "prop", "n_def", "default_rate")


def distribution_summary(df: DataFrame, target: str = "def", by: str = "dataset") -> DataFrame:
    """(by, n, n_def, default_rate) of each sample, and of all as Total (whose rate is over all rows, no mean of rates)."""
    table = df.rollup(by).agg(*counted(target), F.grouping(by).alias("_total"))
    return table.select(F.when(F.col("_total") == 1, "Total").otherwise(F.col(by)).alias(by), "n", "n_def", ratio(F.col("n_def"), F.col("n")).alias("default_rate"))


def rates(df: DataFrame, by: Sequence[str], target: str = "def", scale: float = 1.0) -> DataFrame:
    """(by..., n, n_def, default_rate * scale) of each group."""
    return df.groupBy(*by).agg(*counted(target)).withColumn("default_rate", ratio(F.col("n_def"), F.col("n")) * scale)


def rate_matrix(df: DataFrame, period: str, category: str, categories: Sequence[str], target: str = "def") -> DataFrame:
    """A row per period and a column of default rates per category."""
    return df.groupBy(period).pivot(category, list(categories)).agg(F.avg(F.col(target).cast("double")))


def missing_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(variable, n_missing, share) of each column, in one pass."""
    found = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in columns])
    return found.select(F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).alias("n_missing"), ratio(F.col(c), F.col("_n")).alias("share")) for c in columns])).alias("r")).select("r.*")


def value_shares(df: DataFrame, column: str, keep_missing: bool = False) -> DataFrame:
    """(value, n, share) of each value; missing ones are left out unless wanted."""
    rows = df.select(F.col(column).cast("string").alias("value"))
    counts = (rows if keep_missing else rows.where("value is not null")).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", ratio(F.col("n"), F.sum("n").over(Window.partitionBy())))


def contingency(df: DataFrame, a: str, b: str, normalize: str | None = None, digits: int | None = None) -> DataFrame:
    """(a, b, n) for each pair of values that occurs; normalize: share of index (a), columns (b) or all, as value.

    Rows with a missing value in either are left out. digits: shares are rounded half to even and given in percent.
    """
    counts = df.select(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).dropna().groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    if normalize is None:
        return counts
    of = {"index": ["a"], "columns": ["b"], "all": []}[normalize]
    share = ratio(F.col("n"), F.sum("n").over(Window.partitionBy(*of)))
    return counts.withColumn("value", half_even(share, digits) * 100 if digits is not None else share)


def contingency_margins(df: DataFrame, a: str, b: str) -> DataFrame:
    """contingency() with margins: 'All' stands for any value."""
    rows = df.select(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).dropna()
    cube = rows.cube("a", "b").agg(F.count(F.lit(1)).alias("n"), F.grouping("a").alias("ga"), F.grouping("b").alias("gb"))
    return cube.select(F.when(F.col("ga") == 1, "All").otherwise(F.col("a")).alias("a"), F.when(F.col("gb") == 1, "All").otherwise(F.col("b")).alias("b"), "n")


def rare_level_variables(df: DataFrame, variables: Sequence[str], threshold: float = 0.05) -> DataFrame:
    """(variable, n_levels, least_share) of the variables with a level whose share is at most threshold; unknown ones are skipped with a warning."""
    unknown = [v for v in variables if v not in df.columns]
    if unknown:
        warnings.warn(f"no such columns: {', '.join(unknown)}", stacklevel=2)
    counts = melted(df, [v for v in variables if v in df.columns], kind="string").where("value is not null").groupBy("variable", "value").agg(F.count(F.lit(1)).alias("n"))
    shares = counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("variable")))
    return shares.groupBy("variable").agg(F.count(F.lit(1)).alias("n_levels"), F.min("share").alias("least_share")).where(F.col("least_share") <= threshold)


def relative_gaps(df: DataFrame, category: str, target: str = "def") -> DataFrame:
    """(category, default_rate, gap): the change of rate against the next lower category in percent, 0 for the first.

    Against a rate of 0 the gap is infinite, or 0 where both are 0.
    """
    table = df.where(F.col(category).isNotNull()).groupBy(F.col(category).cast("string").alias("category")).agg(F.avg(F.col(target).cast("double")).alias("default_rate"))
    before = F.lag("default_rate").over(Window.orderBy("default_rate", "category"))  # a row per category
    gap = F.when(before.isNull(), 0.0).when(before > 0, (F.col("default_rate") / before - 1) * 100).when(F.col("default_rate") > 0, float("inf")).otherwise(0.0)
    return table.withColumn("gap", gap)


def describe(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., variable, n, mean, sd, min, q1, median, q3, max) of each column; exact quartiles, missing values don't count."""
    keys = [*by, "variable"]
    long = melted(once(df.select(*by, *columns)), columns, by)
    moments = long.where("value is not null").groupBy(*keys).agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    found = quantiles(long, keys, (0.25, 0.5, 0.75)).join(moments, keys)
    return found.select(*keys, "n", "mean", "sd", F.col("low").alias("min"), *[F.col("q")[j].alias(name) for j, name in enumerate(("q1", "median", "q3"))], F.col("high").alias("max"))


def scored_profile(df: DataFrame, score: str, target: str = "def", by: str = "dataset") -> DataFrame:
    """(by, n, min_score, mean_score, max_score, default_rate)."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.min(score).alias("min_score"), F.avg(score).alias("mean_score"), F.max(score).alias("max_score"), F.avg(F.col(target).cast("double")).alias("default_rate"))


def ecdf(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., value, n, share): the share of the group's rows up to each distinct value."""
    counts = melted(df, [column], by).where("value is not null").groupBy(*by, "value").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(*by).agg(F.sum("n").alias("_all"))
    ranked = running(counts, by, "value", ["n"])
    ranked = ranked.join(totals, list(by)) if by else ranked.crossJoin(F.broadcast(totals))
    return ranked.select(*by, "value", "n", ratio(F.col("cum_n"), F.col("_all")).alias("share"))


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """(bin, low, high, n) of equal-width bins over the range, the last one closed; empty bins are absent."""
    ends = df.agg(F.min(column).cast("double").alias("_lo"), F.max(column).cast("double").alias("_hi"))
    rows = df.select(F.col(column).cast("double").alias("x")).where("x is not null").crossJoin(F.broadcast(ends))  # one row
    width = (F.col("_hi") - F.col("_lo")) / bins
    number = F.least(F.coalesce(F.floor(F.try_divide(F.col("x") - F.col("_lo"), width)), F.lit(0)), F.lit(bins - 1)).cast("int")
    return rows.groupBy(number.alias("bin"), (F.col("_lo") + number * width).alias("low"), (F.col("_lo") + (number + 1) * width).alias("high")).agg(F.count(F.lit(1)).alias("n"))
