"""Association between variables: Kruskal-Wallis, chi-squared and Cramér's V, Pearson and Spearman correlations."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import V_READINGS, chi2_sf, class_of, half_even
from ..sources.files import once
from .order import average_ranks, melted
from .summaries import contingency


#: A table of at most so many values of a variable (some 30 MB with a rank for each of four folds) is sent to every task.
BROADCAST_VALUES = 500_000


def value_counts(df: DataFrame, variables: Sequence[str], target: str, keep: Sequence[str] = (), kind: str = "double") -> DataFrame:
    """(keep..., variable, value, level, n): counts of each variable's values by the target's levels, in one shuffle.

    Rows with a missing value or target don't count.
    """
    rows = melted(df, variables, [*keep, target], kind).where(F.col("value").isNotNull() & F.col(target).isNotNull())
    return rows.groupBy(*keep, "variable", "value", F.col(target).cast("string").alias("level")).agg(F.count(F.lit(1)).alias("n"))


def without_fold(counts: DataFrame, folds: Sequence[int], fold: str = "fold") -> DataFrame:
    """Counts of the rows outside each fold, from counts by fold: (left_out, ... , n). Training folds need no scan of their own."""
    keys = [c for c in counts.columns if c not in (fold, "n")]
    others = F.filter(F.array(*[F.lit(i) for i in folds]), lambda i: i != F.col(fold))
    return counts.withColumn("left_out", F.explode(others)).groupBy("left_out", *keys).agg(F.sum("n").alias("n"))


def kruskal_of(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., h, df, p_value) of the Kruskal-Wallis test on counts (keys..., value, level, n).

    H uses average ranks and the correction for ties. Fewer than two levels, or values that are all equal, give nulls.
    """
    keys, counts = list(keys), once(counts)  # read for the ranks and for the levels
    values = counts.groupBy(*keys, "value").agg(F.sum("n").alias("n"))
    ranks = average_ranks(values, keys).withColumn("n", F.col("n").cast("double"))
    whole = ranks.groupBy(*keys).agg(F.sum("n").alias("_all"), F.sum(F.col("n") * F.col("n") * F.col("n") - F.col("n")).alias("_ties"))
    levels = counts.join(ranks.select(*keys, "value", "rank"), [*keys, "value"]).groupBy(*keys, "level").agg(F.sum(F.col("n") * F.col("rank")).alias("_r"), F.sum("n").cast("double").alias("_n"))
    sums = levels.groupBy(*keys).agg(F.sum(F.col("_r") * F.col("_r") / F.col("_n")).alias("_s"), (F.count(F.lit(1)) - 1).cast("int").alias("df")).join(whole, keys)
    n = F.col("_all")
    raw = 12 / (n * (n + 1)) * F.col("_s") - 3 * (n + 1)
    spread = 1 - F.try_divide(F.col("_ties"), n * n * n - n)
    h = F.when((F.col("df") >= 1) & (spread > 0), F.try_divide(raw, spread))
    return sums.select(*keys, h.alias("h"), "df").withColumn("p_value", chi2_sf(F.when(F.col("h") < 0, 0.0).otherwise(F.col("h")), F.col("df")))


def kruskal(df: DataFrame, variables: Sequence[str], target: str) -> DataFrame:
    """kruskal_of() for each variable against the levels of target."""
    return kruskal_of(value_counts(df, variables, target), ["variable"])


def chi2_of(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., n, rows, columns, chi2, dof, p_value) of the tables of counts (keys..., value, level, n).

    Cells that don't occur count as 0: their share of the statistic is what is left of n after the expected counts of the
    others. A 2 x 2 table gets the continuity correction, for which its four cells are named. One row or column gives nulls.
    """
    keys, counts = list(keys), once(counts)  # read for both margins and for the cells
    a = counts.groupBy(*keys, "value").agg(F.sum("n").alias("_a"))
    b = counts.groupBy(*keys, "level").agg(F.sum("n").alias("_b"))
    whole = a.groupBy(*keys).agg(F.sum("_a").cast("double").alias("n"), F.count(F.lit(1)).alias("rows"))
    whole = whole.join(b.groupBy(*keys).agg(F.count(F.lit(1)).alias("columns")), keys)
    grid = a.join(b, keys).join(whole, keys).join(counts.withColumnRenamed("n", "_o"), [*keys, "value", "level"], "left")  # margins of few values
    expected = F.col("_a") * F.col("_b") / F.col("n")
    off = F.abs(F.coalesce(F.col("_o"), F.lit(0)) - expected)
    small = (F.col("rows") == 2) & (F.col("columns") == 2)
    off = F.when(small, off - F.least(F.lit(0.5), off)).otherwise(off)
    out = grid.groupBy(*keys, "n", "rows", "columns").agg(F.sum(off * off / expected).alias("_c"))
    dof = ((F.col("rows") - 1) * (F.col("columns") - 1)).cast("int")
    real = (F.col("rows") > 1) & (F.col("columns") > 1)
    out = out.select(*keys, F.col("n").cast("long").alias("n"), "rows", "columns", F.when(real, F.col("_c")).alias("chi2"), dof.alias("dof"))
    return out.withColumn("p_value", chi2_sf(F.col("chi2"), F.col("dof")))


def cramers(chi2: DataFrame, corrected: bool = False) -> Column:
    """Cramér's V of a row of chi2_of(), plain or with the bias correction; null for degenerate tables."""
    n, r, k = F.col("n").cast("double"), F.col("rows"), F.col("columns")
    if not corrected:
        return F.sqrt(F.try_divide(F.col("chi2") / n, (F.least(r, k) - 1).cast("double")))
    phi = F.greatest(F.lit(0.0), F.col("chi2") / n - F.try_divide((k - 1) * (r - 1), n - 1))
    rr, kk = (x - F.try_divide((x - 1) * (x - 1), n - 1) for x in (r, k))
    return F.sqrt(F.try_divide(phi, F.when(F.least(rr, kk) > 1, F.least(rr, kk) - 1)))


def cramers_v_with_target(df: DataFrame, variables: Sequence[str], target: str, corrected: bool = False) -> DataFrame:
    """chi2_of() with v for each variable against target; rows with either missing don't count."""
    found = chi2_of(value_counts(df, variables, target, kind="string"), ["variable"])
    return found.withColumn("v", cramers(found, corrected))


def pair_counts(df: DataFrame, variables: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., a, b, value, level, n) for each unordered pair of variables, itself included, in one scan and shuffle."""
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("string").alias("value"), F.col(b).cast("string").alias("level")) for a, b in combinations_with_replacement(variables, 2)])
    rows = df.select(*keep, F.explode(pairs).alias("p")).select(*keep, "p.*").where("value is not null and level is not null")
    return rows.groupBy(*keep, "a", "b", "value", "level").agg(F.count(F.lit(1)).alias("n"))


def cramers_v_matrix(df: DataFrame, variables: Sequence[str], corrected: bool = False, percent: bool = False) -> DataFrame:
    """(a, b, v) for all ordered pairs of variables, the diagonal included."""
    found = chi2_of(pair_counts(df, variables), ["a", "b"])
    half = found.select("a", "b", (cramers(found, corrected) * (100 if percent else 1)).alias("v"))
    return half.union(half.where("a <> b").select(F.col("b"), F.col("a"), "v"))


def contingency_test(df: DataFrame, a: str, b: str) -> DataFrame:
    """(n, rows, columns, chi2, dof, p_value, v, reading) of two variables, where reading puts V in words."""
    rows = df.select(F.lit(f"{a} x {b}").alias("variable"), F.col(a).cast("string").alias("value"), F.col(b).cast("string").alias("level")).dropna()
    found = chi2_of(rows.groupBy("variable", "value", "level").agg(F.count(F.lit(1)).alias("n")), ["variable"])
    return found.withColumn("v", cramers(found)).withColumn("reading", class_of(F.col("v"), V_READINGS)).drop("variable")


def contingency_analysis(df: DataFrame, a: str, b: str, normalize: str = "index") -> tuple[DataFrame, DataFrame]:
    """Of two variables: contingency_test(), and their table (a, b, n, value) of shares of rows ('index'), columns or all, rounded to 3 decimals, in percent."""
    rows = df.dropna(subset=[a, b])
    table = contingency(rows, a, b, normalize=normalize).withColumn("value", half_even(F.col("value"), 3) * 100)
    return contingency_test(rows, a, b), table


def looked_up(rows: DataFrame, variables: Sequence[str], table: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """rows with <c>_<v> for each variable v, a double, and each further column c of table (keys..., variable, value, c...): what the table says of v's value; null if nothing.

    A variable of at most BROADCAST_VALUES values has its part of the table sent to every task, so its rows stay where they are; by others
    rows are dealt once each, without being repeated for the variables.
    """
    table, keys = once(table), list(keys)
    more = [c for c in table.columns if c not in (*keys, "variable", "value")]
    sizes = {r["variable"]: r["count"] for r in table.groupBy("variable").count().collect()}  # a row a variable
    for v in variables:
        own = table.where(F.col("variable") == v).select(*keys, F.col("value").alias(v), *[F.col(c).alias(f"{c}_{v}") for c in more])
        rows = rows.join(F.broadcast(own) if sizes.get(v, 0) <= BROADCAST_VALUES else own, [*keys, v], "left")
    return rows


def ranked(df: DataFrame, variables: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., variables...): each variable replaced by its average rank within keys. Rows without any value are left out.

    Values are counted and ranked in one table for all variables, which each variable's column then looks up (see looked_up).
    """
    rows = once(df.select(*keys, *[F.col(v).cast("double").alias(v) for v in variables]))
    counts = melted(rows, variables, keys).where("value is not null").groupBy(*keys, "variable", "value").agg(F.count(F.lit(1)).alias("n"))
    found = looked_up(rows, variables, average_ranks(counts, [*keys, "variable"]).select(*keys, "variable", "value", "rank"), keys)
    return found.dropna("all", subset=[f"rank_{v}" for v in variables]).select(*keys, *[F.col(f"rank_{v}").alias(v) for v in variables])


def correlation_matrix(df: DataFrame, variables: Sequence[str], method: str = "pearson", by: Sequence[str] = (), percent: bool = False) -> DataFrame:
    """(by..., a, b, r) for all pairs of variables in the order given (a before b, or equal); rows with any missing don't count."""
    rows = df.select(*by, *variables).dropna(subset=list(variables))
    if method == "spearman":
        rows = ranked(rows, variables, by)
    elif method != "pearson":
        raise ValueError("method must be pearson or spearman")
    pairs = list(combinations_with_replacement(variables, 2))
    found = rows.groupBy(*by).agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    scale = 100 if percent else 1
    return found.select(*by, F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), (F.col(f"c{i}") * scale).alias("r")) for i, (a, b) in enumerate(pairs)])).alias("p")).select(*by, "p.*")


def baseline_f1(df: DataFrame, target: str = "def") -> DataFrame:
    """(f1) of calling every row positive: 2 p / (p + 1) at the default rate p."""
    return df.agg((2 * F.avg(F.col(target).cast("double"))).alias("t")).select((F.col("t") / (F.col("t") / 2 + 1)).alias("f1"))
