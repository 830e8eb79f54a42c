"""Box statistics and densities of continuous columns."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import once
from .order import melted, quantiles

#: A column's range is cut into so many cells for a density; of each group at most so many numbers are left of its rows.
FINE = 1 << 14
#: Pairs of points and cells that are held in memory at once.
AT_ONCE = 1 << 20


def box_statistics(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), reach: float = 1.5) -> DataFrame:
    """(by..., variable, n, mean, q1, median, q3, low_whisker, high_whisker, n_below, n_above) of each column.

    Whiskers end at the last values within reach times the distance of the quartiles from them; what lies beyond is counted. Missing
    values and rows without a category of by don't count. The input is read once, and the written columns twice more: for the quartiles,
    and for what lies between bounds that they give.
    """
    keys = [*by, "variable"]
    long = melted(once(df.select(*by, *columns)), columns, by).where("value is not null")
    long = long.dropna(subset=list(by)) if by else long
    found = quantiles(long, keys, (0.25, 0.5, 0.75)).select(*keys, *[F.col("q")[j].alias(c) for j, c in enumerate(("q1", "median", "q3"))])
    span = reach * (F.col("q3") - F.col("q1"))
    found = found.withColumns({"_low": F.col("q1") - span, "_high": F.col("q3") + span})
    rows = long.join(F.broadcast(found), keys)  # a row for each key of a summary
    return rows.groupBy(*keys, "q1", "median", "q3").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"),
        F.min(F.when(F.col("value") >= F.col("_low"), F.col("value"))).alias("_a"), F.max(F.when(F.col("value") <= F.col("_high"), F.col("value"))).alias("_b"),
        F.count(F.when(F.col("value") < F.col("_low"), 1)).alias("n_below"), F.count(F.when(F.col("value") > F.col("_high"), 1)).alias("n_above"),
    ).select(*keys, "n", "mean", "q1", "median", "q3", F.least("_a", "q1").alias("low_whisker"), F.greatest("_b", "q3").alias("high_whisker"), "n_below", "n_above")


def density(df: DataFrame, column: str, by: Sequence[str] = (), points: int = 200, low: float | None = None, high: float | None = None, cut: float = 3.0, fine: int = FINE) -> DataFrame:
    """(by..., x, density): a Gaussian kernel estimate of a column for each group, at points evenly spaced x.

    Bandwidth w: standard deviation times n to the power -1/5. Without low and high, each group's points reach cut * w beyond its values. Fewer
    than two rows, or equal values, give 0 everywhere. Rows are summed up in fine cells of the group's range; a cell's
    rows stand at their mean, so that cells of one value are exact, and elsewhere the error is below (range / fine / w) ** 2 / 8 of the
    kernel's height 0.4 / w. What a task holds is bounded by fine and points, whatever the rows or distinct values.
    """
    by = list(by)
    rows = once(df.select(*by, F.col(column).cast("double").alias("_s"))).where("_s is not null")
    rows = rows.dropna(subset=by) if by else rows
    sums = rows.groupBy(*by).agg(F.count(F.lit(1)).cast("double").alias("_n"), F.stddev_samp("_s").alias("_sd"), F.min("_s").alias("_lo"), F.max("_s").alias("_hi"))
    sums = sums.where("_n > 0").withColumn("_w", F.coalesce("_sd", F.lit(0.0)) * F.pow("_n", F.lit(-0.2)))
    keyed = rows.join(F.broadcast(sums), by) if by else rows.crossJoin(F.broadcast(sums))  # a row a group
    cell = F.least(F.coalesce(F.floor(F.try_divide(F.col("_s") - F.col("_lo"), F.col("_hi") - F.col("_lo")) * fine), F.lit(0)), F.lit(fine - 1)).cast("int")
    facts = ["_n", "_w", "_lo", "_hi"]
    cells = keyed.groupBy(*by, *facts, cell.alias("_cell")).agg(F.count(F.lit(1)).cast("double").alias("_c"), F.avg("_s").alias("_at"))

    def of(frame: pd.DataFrame) -> pd.DataFrame:
        n, w, lo, hi = (float(frame[c].iloc[0]) for c in facts)
        x = np.linspace(lo - cut * w if low is None else low, hi + cut * w if high is None else high, points)
        total, at, c = np.zeros(points), frame["_at"].to_numpy(), frame["_c"].to_numpy()
        if w > 0:
            for k in range(0, len(at), step := max(1, AT_ONCE // points)):
                total += np.exp(-(((x[:, None] - at[None, k : k + step]) / w) ** 2) / 2) @ c[k : k + step]
            total /= n * w * math.sqrt(2 * math.pi)
        return pd.DataFrame({c: [frame[c].iloc[0]] * points for c in by} | {"x": x, "density": total})

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in by)
    schema = ", ".join(filter(None, [kinds, "x double, density double"]))
    if by:
        return cells.groupBy(*by).applyInPandas(of, schema)

    def whole(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [f for f in frames if len(f)]
        if held:
            yield of(pd.concat(held))

    return cells.coalesce(1).mapInPandas(whole, schema)  # at most fine rows
