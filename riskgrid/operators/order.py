"""Order statistics that no single task holds: exact quantiles, running sums and positions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import once

#: Ranks that percentile_approx gives are off by at most 1 / ACCURACY of the rows.
ACCURACY = 10_000
#: Values of a key are dealt to 2 ** CELL_BITS cells of about equal weight.
CELL_BITS = 8
#: Rows that one task sorts or holds at once, about: some 90 MB, which stays in memory.
ROWS_A_TASK = 500_000


def parted(df: DataFrame, rows: int, *keys: str | Column) -> DataFrame:
    """df dealt by keys to tasks of about ROWS_A_TASK rows, so that what sorts them by more columns doesn't spill however many there are; a df of fewer rows is left as it is."""
    if rows <= ROWS_A_TASK:
        return df
    return df.repartition(max(math.ceil(rows / ROWS_A_TASK), df.sparkSession.sparkContext.defaultParallelism), *keys)


def melted(df: DataFrame, variables: Sequence[str], keep: Sequence[str] = (), kind: str = "double") -> DataFrame:
    """One row (keep..., variable, value) for each row and variable, in one scan."""
    pairs = F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).cast(kind).alias("value")) for v in variables])
    return df.select(*keep, F.explode(pairs).alias("_p")).select(*keep, "_p.variable", "_p.value")


def quantiles(long: DataFrame, keys: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """(keys..., n, low, high, q): for each key the exact quantiles q of value, linear between neighbouring values.

    Null values don't count. Two passes over long: the first, run at once, takes approximate quantiles that bracket each rank; the second
    counts the rows by their place among the brackets, and by value only within them, so that only few values are ordered. keys should
    have few values (variables, periods, samples), as a row of brackets for each goes through the driver. probabilities ascend.
    """
    long, keys = long.where("value is not null").select(*keys, "value"), list(keys)
    p = [float(x) for x in probabilities]
    slack = 4 / ACCURACY
    around = [x for q in p for x in (max(0.0, q - slack), min(1.0, q + slack))]
    sketch = F.percentile_approx("value", around, ACCURACY)
    whole = long.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), sketch.alias("_around"))
    few = F.col("n") <= 2 * ACCURACY  # so few that a rank or two may lie outside a bracket: all of them are ordered
    lows = F.array(*[F.col("low") if around[2 * j] == 0 else F.when(few, F.col("low")).otherwise(F.col("_around")[2 * j]) for j in range(len(p))])
    highs = F.array(*[F.col("high") if around[2 * j + 1] == 1 else F.when(few, F.col("high")).otherwise(F.col("_around")[2 * j + 1]) for j in range(len(p))])
    whole = whole.select(*keys, "n", "low", "high", lows.alias("_lows"), highs.alias("_highs"))
    whole = long.sparkSession.createDataFrame(whole.collect(), whole.schema)  # a row per key

    def joined(rows: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(whole), keys) if keys else rows.crossJoin(F.broadcast(whole))  # one row without keys

    rows = joined(long)
    bracketed, zone = F.lit(False), F.lit(0)
    for j in range(len(p)):
        bracketed = bracketed | F.col("value").between(F.col("_lows")[j], F.col("_highs")[j])
        zone = zone + F.when(F.col("value") >= F.col("_lows")[j], 1).otherwise(0)
    placed = rows.select(*keys, zone.alias("_zone"), F.when(bracketed, F.col("value")).alias("value")).groupBy(*keys, "_zone", "value").agg(F.count(F.lit(1)).alias("_c"))
    places = F.sequence(F.lit(0), F.lit(len(p) - 1))
    # of each rank: the rows below its bracket count as one value below all, those within it each as its own
    inside = F.filter(places, lambda j: (F.col("value") >= F.get("_lows", j)) & (F.col("value") <= F.get("_highs", j)))
    kept = F.array_union(F.transform(F.filter(places, lambda j: F.col("_zone") <= j), lambda j: F.struct(j.alias("j"), F.lit(None).cast("double").alias("v"))), F.coalesce(F.transform(inside, lambda j: F.struct(j.alias("j"), F.col("value").cast("double").alias("v"))), F.array().cast("array<struct<j:int,v:double>>")))
    counts = joined(placed).select(*keys, "n", "_c", F.explode(kept).alias("_e")).groupBy(*keys, "n", F.col("_e.j").alias("_j"), F.col("_e.v").alias("value")).agg(F.sum("_c").alias("_c"))
    upto = Window.partitionBy(*keys, "_j").orderBy(F.col("value").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rank = F.get(F.array(*[F.lit(x) for x in p]), F.col("_j")) * (F.col("n") - 1)
    counts = counts.withColumns({"_upto": F.sum("_c").over(upto), "_rank": rank})
    at = counts.groupBy(*keys, "_j").agg(
        F.min(F.when(F.col("_upto") > F.floor("_rank"), F.col("value"))).alias("_a"),
        F.min(F.when(F.col("_upto") > F.ceil("_rank"), F.col("value"))).alias("_b"),
        F.first(F.col("_rank") - F.floor("_rank")).alias("_part"),
    )
    at = at.withColumn("_v", F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_part"))
    found = at.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_j", "_v"))), lambda s: s["_v"]).alias("q"))  # one entry a probability
    return joined(found).select(*keys, "n", "low", "high", "q")


def cells(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Add _cell, which never falls as value rises within a key: its place among approximate quantiles of the key's rows.

    keys should have few values (variables, samples, folds): a row of cuts for each is broadcast.
    """
    n = 1 << CELL_BITS
    cuts = df.groupBy(*keys).agg(F.percentile_approx(value, [k / n for k in range(1, n)], ACCURACY).alias("_cuts"))
    out = (df.join(F.broadcast(cuts), list(keys)) if keys else df.crossJoin(F.broadcast(cuts))).withColumn("_cell", F.lit(0))
    for k in reversed(range(CELL_BITS)):
        step = 1 << k
        out = out.withColumn("_cell", F.col("_cell") + F.when(F.get("_cuts", F.col("_cell") + (step - 1)) < F.col(value), step).otherwise(0))
    return out.drop("_cuts")


def running(df: DataFrame, keys: Sequence[str], value: str, sums: Sequence[str], descending: bool = False, ties: Sequence[str] = ()) -> DataFrame:
    """Add cum_<x> for each x of sums: its sum over the key's rows up to and with this one in the order of value, then ties.

    Rows are ordered within cells of a key, and the cells' totals (keys * 2 ** CELL_BITS rows) are summed up apart, so
    no task orders all rows of a key. df is evaluated once, and written (see sources.files.once).
    """
    keys = list(keys)
    placed = cells(once(df), keys, value)

    def way(*columns: str) -> list[Column]:
        return [F.desc(c) if descending else F.asc(c) for c in columns]

    totals = placed.groupBy(*keys, "_cell").agg(*[F.sum(x).alias(f"_t_{x}") for x in sums])
    before = Window.partitionBy(*keys).orderBy(*way("_cell")).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "_cell", *[F.coalesce(F.sum(f"_t_{x}").over(before), F.lit(0)).alias(f"_b_{x}") for x in sums])
    within = Window.partitionBy(*keys, "_cell").orderBy(*way(value), *ties).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = placed.withColumns({f"cum_{x}": F.sum(x).over(within) for x in sums}).join(F.broadcast(totals), [*keys, "_cell"])
    return out.withColumns({f"cum_{x}": F.col(f"cum_{x}") + F.col(f"_b_{x}") for x in sums}).drop("_cell", *[f"_b_{x}" for x in sums])


def average_ranks(counts: DataFrame, keys: Sequence[str], n: str = "n") -> DataFrame:
    """counts: (keys..., value, n), one row a value. Adds rank, the average rank of the rows of that value within the key."""
    return running(counts, keys, "value", [n]).withColumn("rank", F.col(f"cum_{n}") - (F.col(n) - 1) / 2).drop(f"cum_{n}")


def positions(df: DataFrame, strata: Sequence[str], cell: str, ties: Sequence[str], out: str = "position", keep: Sequence[str] | None = None, rows: int = 0) -> DataFrame:
    """Add out: 1, 2, ... within each stratum in the order of cell (a whole number of few values), then ties.

    Only rows of equal stratum and cell are ordered by one task. df is evaluated once and written with their places there; counts by
    stratum and cell, and all that reads the result, scan that. keep: the columns wanted besides strata and cell; all, if none are named.
    rows: how many rows df has at most, where it is known (see parted).
    """
    within = Window.partitionBy(*strata, cell).orderBy(*ties)
    columns = list(dict.fromkeys([*strata, cell, *(df.columns if keep is None else keep)]))
    df = parted(df.select(*dict.fromkeys([*columns, *ties])), rows, *strata, cell)
    placed = once(df.withColumn(out, F.row_number().over(within)).select(*columns, out))
    counts = placed.groupBy(*strata, cell).agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*strata).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    offsets = once(counts.select(*strata, cell, F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before")))  # written, so that its size is known to the join
    return placed.join(offsets, [*strata, cell]).withColumn(out, F.col(out) + F.col("_before")).drop("_before")
