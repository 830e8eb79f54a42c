"""Fold-robust variable selection. Each rule looks at the training part of every fold, from counts taken once."""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import V_STRENGTHS, class_of
from ..sources.files import once
from .association import chi2_of, correlation_matrix, cramers, kruskal_of, looked_up, pair_counts, value_counts, without_fold
from .order import average_ranks, melted


def listed(spark, variables: Sequence[str]) -> DataFrame:
    """(variable, place): the order in which variables were named, which settles ties."""
    return spark.createDataFrame(list(enumerate(variables)), "place int, variable string")


def kruskal_by_fold(df: DataFrame, variables: Sequence[str], target: str, folds: Sequence[int], fold: str = "fold") -> DataFrame:
    """(left_out, variable, h, df, p_value) over the rows outside each fold."""
    return kruskal_of(without_fold(value_counts(df, variables, target, [fold]), folds, fold), ["left_out", "variable"])


def cramers_by_fold(df: DataFrame, variables: Sequence[str], target: str, folds: Sequence[int], fold: str = "fold") -> DataFrame:
    """(left_out, variable, v): bias-corrected V with the target over the rows outside each fold."""
    found = chi2_of(without_fold(value_counts(df, variables, target, [fold], "string"), folds, fold), ["left_out", "variable"])
    return found.select("left_out", "variable", cramers(found, corrected=True).alias("v"))


def keep_associated(df: DataFrame, variables: Sequence[str], target: str, folds: Sequence[int], alpha: float = 0.05, p_values: DataFrame | None = None) -> DataFrame:
    """(variable, place, worst_p, kept): kept if the Kruskal-Wallis p is below alpha whichever fold is left out. p_values: kruskal_by_fold(), where it is known."""
    found = (kruskal_by_fold(df, variables, target, folds) if p_values is None else p_values).groupBy("variable").agg(F.max("p_value").alias("worst_p"), F.count("p_value").alias("_n"))
    out = listed(df.sparkSession, variables).join(found, "variable", "left")
    return out.select("variable", "place", "worst_p", F.coalesce((F.col("_n") == len(folds)) & (F.col("worst_p") < alpha), F.lit(False)).alias("kept"))


def keep_categorical(df: DataFrame, variables: Sequence[str], target: str, folds: Sequence[int], low: float = 0.10, v_values: DataFrame | None = None) -> DataFrame:
    """(variable, place, mean_v, strength, kept): kept if the corrected V is at least low whichever fold is left out. v_values: cramers_by_fold(), where it is known."""
    found = (cramers_by_fold(df, variables, target, folds) if v_values is None else v_values).groupBy("variable").agg(F.avg("v").alias("mean_v"), F.min("v").alias("_least"), F.count("v").alias("_n"))
    out = listed(df.sparkSession, variables).join(found, "variable", "left")
    kept = F.coalesce((F.col("_n") == len(folds)) & (F.col("_least") >= low), F.lit(False))
    return out.select("variable", "place", "mean_v", class_of(F.col("mean_v"), V_STRENGTHS).alias("strength"), kept.alias("kept"))


def evicted(pairs: DataFrame, merit: DataFrame, order: DataFrame) -> DataFrame:
    """Of each pair (keys..., a, b) the one of less merit, the first named on ties: (variable) dropped. merit: (keys..., variable, merit)."""
    keys = [c for c in merit.columns if c not in ("variable", "merit")]
    rank = merit.join(order, "variable")
    a, b = (rank.select(*keys, F.col("variable").alias(s), F.col("merit").alias(f"m{s}"), F.col("place").alias(f"p{s}")) for s in "ab")
    joined = pairs.join(a, [*keys, "a"]).join(b, [*keys, "b"])
    first, second = F.when(F.col("pa") < F.col("pb"), F.col("a")).otherwise(F.col("b")), F.when(F.col("pa") < F.col("pb"), F.col("b")).otherwise(F.col("a"))
    m1, m2 = F.when(F.col("pa") < F.col("pb"), F.col("ma")).otherwise(F.col("mb")), F.when(F.col("pa") < F.col("pb"), F.col("mb")).otherwise(F.col("ma"))
    return joined.select(F.when(m2 < m1, second).otherwise(first).alias("variable")).distinct()


def kept_after(order: DataFrame, dropped: DataFrame) -> DataFrame:
    """(variable, place, kept) in the order given."""
    return order.join(dropped.withColumn("_d", F.lit(True)), "variable", "left").select("variable", "place", F.col("_d").isNull().alias("kept"))


def spearman_by_fold(df: DataFrame, variables: Sequence[str], folds: Sequence[int], fold: str = "fold") -> DataFrame:
    """(left_out, a, b, r) over the rows outside each fold, for variables without missing values.

    A value's ranks outside every fold come from one table of counts, which rows look up (see association.looked_up); no row is
    repeated for a fold or a variable.
    """
    rows = df.select(F.col(fold).alias("_fold"), *[F.col(v).cast("double").alias(v) for v in variables])
    counts = melted(rows, variables, ["_fold"]).groupBy("_fold", "variable", "value").agg(F.count(F.lit(1)).alias("n"))
    ranks = average_ranks(without_fold(counts, folds, "_fold"), ["left_out", "variable"])
    by_value = ranks.groupBy("variable", "value").agg(*[F.max(F.when(F.col("left_out") == i, F.col("rank"))).alias(f"rank{k}") for k, i in enumerate(folds)])
    wide = looked_up(rows, variables, by_value)
    pairs = [(a, b, k, i) for n, a in enumerate(variables) for b in variables[n + 1 :] for k, i in enumerate(folds)]

    def rank(v: str, k: int, i: int) -> Column:
        return F.when(F.col("_fold") != i, F.col(f"rank{k}_{v}"))

    found = wide.agg(*[F.corr(rank(a, k, i), rank(b, k, i)).alias(f"c{n}") for n, (a, b, k, i) in enumerate(pairs)])
    return found.select(F.explode(F.array(*[F.struct(F.lit(i).alias("left_out"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{n}").alias("r")) for n, (a, b, _, i) in enumerate(pairs)])).alias("p")).select("p.*")


def drop_correlated(df: DataFrame, variables: Sequence[str], target: str, folds: Sequence[int], threshold: float = 0.7, fold: str = "fold", p_values: DataFrame | None = None) -> DataFrame:
    """(variable, place, kept): of two variables whose |Spearman| reaches threshold outside some fold, the one of larger p goes.

    Every pair is judged by itself: a variable that goes can still evict another. The correlation of a pair uses the
    rows that have both. p_values: kruskal_by_fold(), where it is known; where not, df is evaluated once and what is needed of it written.
    """
    if p_values is None:
        df = once(df.select(*dict.fromkeys([fold, target, *variables])))
    order = listed(df.sparkSession, variables)
    holes = df.agg(*[F.max(F.col(v).isNull()).alias(v) for v in variables]).first()
    full = [v for v in variables if not holes[v]]
    broken = [[a, b] for i, a in enumerate(variables) for b in variables[i + 1 :] if holes[a] or holes[b]]
    found = [spearman_by_fold(df, full, folds, fold)] if len(full) > 1 else []  # without missing values, ranks serve all pairs
    if broken:
        parts = df.select(fold, *variables).withColumn("left_out", F.explode(F.filter(F.array(*[F.lit(i) for i in folds]), lambda i: i != F.col(fold))))
        found += [correlation_matrix(parts, pair, "spearman", ["left_out"]).where(F.col("a") != F.col("b")) for pair in broken]
    if not found:
        return order.select("variable", "place", F.lit(True).alias("kept"))
    strong = functools.reduce(DataFrame.unionByName, found).where(F.abs("r") >= threshold).select("left_out", "a", "b")
    p = kruskal_by_fold(df, variables, target, folds, fold) if p_values is None else p_values.where(F.col("variable").isin(list(variables)))
    return kept_after(order, evicted(strong, p.select("left_out", "variable", (-F.coalesce("p_value", F.lit(1.0))).alias("merit")), order))


def drop_correlated_categorical(df: DataFrame, variables: Sequence[str], target: str, folds: Sequence[int], threshold: float = 0.5, fold: str = "fold", v_values: DataFrame | None = None) -> DataFrame:
    """(variable, place, kept): of two variables whose corrected V reaches threshold outside some fold, the one of lower mean V with the target goes.

    v_values: cramers_by_fold(), where it is known.
    """
    order = listed(df.sparkSession, variables)
    found = chi2_of(without_fold(pair_counts(df, variables, [fold]), folds, fold), ["left_out", "a", "b"])
    strong = found.where(F.col("a") != F.col("b")).where(cramers(found, corrected=True) >= threshold).select("a", "b").distinct()
    v = cramers_by_fold(df, variables, target, folds, fold) if v_values is None else v_values.where(F.col("variable").isin(list(variables)))
    return kept_after(order, evicted(strong, v.groupBy("variable").agg(F.avg("v").alias("merit")), order))


@dataclass
class Selection:
    """decisions: (kind, place, variable, associated, kept) of every variable; continuous and categorical: those kept, in the order given."""

    decisions: DataFrame
    continuous: list[str]
    categorical: list[str]


def select(
    df: DataFrame, continuous: Sequence[str], categorical: Sequence[str], folds: Sequence[int], target: str = "def_year", eviction_target: str = "def", fold: str = "fold",
    alpha: float = 0.05, low: float = 0.10, correlation: float = 0.5, high: float = 0.50,
) -> Selection:
    """The four rules in turn: associated continuous variables, associated categorical ones, and of either those that no other evicts.

    The rules judge by target; of two correlated continuous variables the one of larger p against eviction_target goes. df is read once; one
    table of counts by (fold, variable, value, target, eviction target) of each kind gives all tests with a target.
    """
    columns = dict.fromkeys([fold, target, eviction_target, *continuous, *categorical])
    slim = once(df.select(*columns))

    def counted(variables: Sequence[str], kind: str) -> DataFrame:
        return once(value_counts(slim.withColumn("_evict", F.col(eviction_target)), variables, target, [fold, "_evict"], kind))

    def by(counts: DataFrame, level: str) -> DataFrame:
        return counts.where(F.col(level).isNotNull()).groupBy(fold, "variable", "value", F.col(level).cast("string").alias("level")).agg(F.sum("n").alias("n"))

    spark, tables, kept = df.sparkSession, [], {"continuous": [], "categorical": []}

    def decided(kind: str, first: DataFrame, second: Callable[[list[str]], DataFrame]) -> None:
        stay = [r["variable"] for r in first.where("kept").orderBy("place").collect()]  # a row a variable
        last = second(stay) if stay else listed(spark, []).withColumn("kept", F.lit(True))
        table = once(first.select("place", "variable", F.col("kept").alias("associated")).join(last.select("variable", F.col("kept").alias("_k")), "variable", "left").select(F.lit(kind).alias("kind"), "place", "variable", "associated", F.coalesce("_k", F.lit(False)).alias("kept")))
        kept[kind] = [r["variable"] for r in table.where("kept").orderBy("place").collect()]
        tables.append(table)

    if continuous:
        numbers = counted(continuous, "double")
        p = kruskal_of(without_fold(by(numbers, "level"), folds, fold), ["left_out", "variable"])
        against = kruskal_of(without_fold(by(numbers, "_evict"), folds, fold), ["left_out", "variable"])
        decided("continuous", keep_associated(slim, continuous, target, folds, alpha, p), lambda stay: drop_correlated(slim, stay, eviction_target, folds, correlation, fold, against))
    if categorical:
        found = chi2_of(without_fold(by(counted(categorical, "string"), "level"), folds, fold), ["left_out", "variable"])
        v = once(found.select("left_out", "variable", cramers(found, corrected=True).alias("v")))
        decided("categorical", keep_categorical(slim, categorical, target, folds, low, v), lambda stay: drop_correlated_categorical(slim, stay, target, folds, high, fold, v))
    if not tables:
        raise ValueError("no variables to select from")
    return Selection(functools.reduce(DataFrame.unionByName, tables), kept["continuous"], kept["categorical"])
