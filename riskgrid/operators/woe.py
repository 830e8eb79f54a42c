"""Weight of evidence and information value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.files import once
from .binning import displayed_edges, edges_of, place
from .order import melted

FEW = 10


def fitted_edges(df: DataFrame, variables: Sequence[str], bins: int) -> dict[str, list[float]]:
    """Distinct quantile edges of the numeric variables with more than FEW values; the others are taken as they are."""
    numeric = [f.name for f in df.schema if f.name in variables and isinstance(f.dataType, T.NumericType)]
    if not numeric:
        return {}
    # whether a column has more than FEW values needs no count of them all
    long = melted(df, numeric).where("value is not null")
    few = long.groupBy("variable").agg(F.approx_count_distinct("value", 0.02).alias("n")).collect()  # a row per variable
    many = [r["variable"] for r in few if r["n"] > 5 * FEW]
    near = [r["variable"] for r in few if r["n"] <= 5 * FEW]
    if near:
        exact = df.agg(*[F.count_distinct(c).alias(c) for c in near]).first()
        many += [c for c in near if exact[c] > FEW]
    found = edges_of(df, many, bins) if many else {}
    return {v: sorted(set(e)) for v, e in found.items()}


def woe_table(df: DataFrame, variables: Sequence[str], target: str = "def", bins: int = 5, epsilon: float = 1e-16) -> DataFrame:
    """(variable, cutoff, upper, n, events, event_share, non_events, non_event_share, woe, iv) for each group of each variable.

    Groups are quantile bins or the raw values; woe = ln(share of events / share of non-events), so that above 0 is riskier;
    iv is the group's part. upper is the bin's upper edge as displayed (see binning.displayed_edges), null for raw
    values. Missing values don't count. df is evaluated once and its target and variables are written, as edges take several passes.
    """
    df = once(df.select(*dict.fromkeys([target, *variables])))
    edges = fitted_edges(df, variables, bins)
    groups, uppers = [], []
    for v in variables:
        if v in edges:
            shown = displayed_edges(edges[v])
            number = place(F.col(v), edges[v])
            groups.append(F.when(number.isNotNull(), F.lpad(number.cast("string"), 3, "0")))
            uppers += [(v, f"{k:03d}", shown[k]) for k in range(1, len(shown))]
        else:
            groups.append(F.col(v).cast("string"))
    rows = df.select(F.col(target).cast("long").alias("_y"), F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), g.alias("cutoff")) for v, g in zip(variables, groups)])).alias("p"))
    counts = rows.where("p.cutoff is not null").groupBy("p.variable", "p.cutoff").agg(F.count("_y").alias("n"), F.sum("_y").alias("events"))
    counts = counts.withColumn("non_events", F.col("n") - F.col("events"))
    of = Window.partitionBy("variable")  # a row per group

    def share(c: str) -> Column:
        return F.greatest(F.col(c).cast("double"), F.lit(epsilon)) / (F.sum(c).over(of) + epsilon)

    out = counts.withColumns({"event_share": share("events"), "non_event_share": share("non_events")})
    out = out.withColumn("woe", F.ln(F.col("event_share") / F.col("non_event_share")))
    out = out.withColumn("iv", F.col("woe") * (F.col("event_share") - F.col("non_event_share")))
    known = df.sparkSession.createDataFrame(uppers, "variable string, cutoff string, upper double")
    return out.join(F.broadcast(known), ["variable", "cutoff"], "left").select("variable", "cutoff", "upper", "n", "events", "event_share", "non_events", "non_event_share", "woe", "iv")


def information_values(table: DataFrame) -> DataFrame:
    """(variable, iv) summed over the groups of woe_table()."""
    return table.groupBy("variable").agg(F.sum("iv").alias("iv"))


def cutoffs(table: DataFrame, variable: str) -> list[float]:
    """The displayed upper edges of a variable's bins, ascending, for binning.apply_cutoffs()."""
    return [r["upper"] for r in table.where((F.col("variable") == variable) & F.col("upper").isNotNull()).orderBy("cutoff").collect()]


def intervals(table: DataFrame) -> DataFrame:
    """(variable, bin, interval) of the binned variables of woe_table(): struct (lo, hi), the outer ones unbounded; to be saved, and read by binning.uppers_of()."""
    of = Window.partitionBy("variable").orderBy("cutoff")  # a row a bin
    rows = table.where("upper is not null").select("variable", F.col("cutoff").cast("int").alias("bin"), F.lag("upper").over(of).alias("lo"), F.col("upper").alias("hi"), F.lead("upper").over(of).alias("next"))
    lo, hi = F.coalesce("lo", F.lit(float("-inf"))), F.when(F.col("next").isNotNull(), F.col("hi")).otherwise(F.lit(float("inf")))
    return rows.select("variable", "bin", F.struct(lo.alias("lo"), hi.alias("hi")).alias("interval"))


def label_directions(table: DataFrame) -> DataFrame:
    """(variable, slope, direction) of the binned variables of woe_table(): the slope of the event rate over the bins' numbers, weighed by rows.

    The bins are to be named so that label 1 is the riskiest end: 'up' (1, 2, ... with the value) where the rate falls, 'down' where it rises.
    """
    k, n, e = F.col("cutoff").cast("double"), F.col("n").cast("double"), F.col("events").cast("double")
    sums = table.where("upper is not null").groupBy("variable").agg(F.sum(n).alias("n"), F.sum(n * k).alias("k"), F.sum(n * k * k).alias("kk"), F.sum(e).alias("e"), F.sum(e * k).alias("ek"))
    slope = F.try_divide(F.col("ek") - F.col("e") * F.col("k") / F.col("n"), F.col("kk") - F.col("k") * F.col("k") / F.col("n"))
    return sums.select("variable", slope.alias("slope"), F.when(slope > 0, "down").otherwise("up").alias("direction"))
