"""Right-closed bins by quantiles, equal widths or given cutoffs, and score vingtiles."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, NumericType, StringType

from ..functions.scalar import interval_label, mapped
from ..sources.files import once
from .order import ROWS_A_TASK, melted, positions, quantiles, running

#: Ranges that keys_at() counts a group's rows in.
RANGES = 512


def edges_of(df: DataFrame, variables: Sequence[str], bins: int) -> dict[str, list[float]]:
    """The quantile edges of each variable, bins + 1 numbers each, on the driver; a variable without values has none."""
    found = quantiles(melted(df, variables), ["variable"], [k / bins for k in range(bins + 1)]).collect()  # a row per variable
    return {r["variable"]: list(r["q"]) for r in found}


def place(column: Column, edges: Sequence[float]) -> Column:
    """The number of the right-closed bin (from 1) of column; the lowest edge belongs to bin 1; null outside the edges."""
    out = F.lit(None).cast("int")
    for k in range(len(edges) - 1, 0, -1):
        out = F.when(column <= edges[k], k).otherwise(out)
    return F.when(column >= edges[0], out)


def labelled(number: Column, labels: Sequence[object]) -> Column:
    return F.get(F.array(*[F.lit(x) for x in labels]), number - 1)


def quantile_bins(df: DataFrame, variable: str, bins: int, out: str, duplicates: str = "raise", labels: Sequence[object] | None = None) -> DataFrame:
    """Add out, the quantile bin of variable. Equal edges raise ValueError, or with duplicates='drop' are one edge."""
    edges = edges_of(df, [variable], bins).get(variable, [])
    unique = sorted(set(edges))
    if len(unique) < len(edges) and duplicates == "raise":
        raise ValueError(f"quantile edges of {variable} are not unique")
    number = place(F.col(variable), unique) if len(unique) > 1 else F.lit(None).cast("int")
    return df.withColumn(out, labelled(number, labels) if labels else number)


def quartile_bins(df: DataFrame, variable: str, out: str) -> DataFrame:
    """Add out, the label ]a ; b] of the quarter of variable, the first one open just below the minimum."""
    edges = edges_of(df, [variable], 4)[variable]
    edges[0] -= 1e-9
    number = place(F.col(variable), edges)
    return df.withColumn(out, labelled_interval(number, edges))


def labelled_interval(number: Column, edges: Sequence[float]) -> Column:
    out = F.lit(None).cast("string")
    for k in range(len(edges) - 1, 0, -1):
        out = F.when(number == k, interval_label(F.lit(edges[k - 1]), F.lit(edges[k]))).otherwise(out)
    return out


def equal_width_edges(low: float, high: float, bins: int) -> list[float]:
    """Evenly spaced edges, the first one lower by a thousandth of the range so that the minimum falls in bin 1."""
    if low == high:
        pad = 0.001 * abs(low) if low else 0.001
        low, high = low - pad, high + pad
        return [low + (high - low) * k / bins for k in range(bins + 1)]
    edges = [low + (high - low) / bins * k for k in range(bins)] + [high]
    edges[0] -= 0.001 * (high - low)
    return edges


def equal_width_bins(df: DataFrame, variable: str, bins: int, out: str) -> DataFrame:
    """Add out, the equal-width bin (from 1) of variable over its range."""
    low, high = df.agg(F.min(variable).cast("double"), F.max(variable).cast("double")).first()
    return df.withColumn(out, place(F.col(variable), equal_width_edges(low, high, bins)) if low is not None else F.lit(None).cast("int"))


def displayed_edges(edges: Sequence[float], precision: int = 3) -> list[float]:
    """The edges as an interval's text shows them: rounded to the first precision at which they stay apart.

    A number below 1 keeps that many significant digits, a larger one that many decimals. The first edge is shown lower by
    one unit of the last place, as the lowest value belongs to the first bin.
    """

    def shown(x: float, p: int) -> float:
        if not math.isfinite(x) or x == 0:
            return x
        part, whole = math.modf(x)
        digits = -math.floor(math.log10(abs(part))) - 1 + p if whole == 0 else p
        return round(x, digits)

    for p in range(precision, 20):
        out = [shown(x, p) for x in edges]
        if len(set(out)) == len(out):
            break
    return [out[0] - 10.0**-p, *out[1:]]


def interval(text: Column) -> Column:
    """The struct (lo, hi) of an interval's text (a, b]; null if it is none. inf and -inf are numbers."""
    found = [F.regexp_extract(text, r"^\s*\(\s*([^,\s]+)\s*,\s*([^,\s\]]+)\s*\]\s*$", k) for k in (1, 2)]
    lo, hi = (F.when(F.lower(x).isin("inf", "+inf", "infinity"), F.lit(float("inf"))).when(F.lower(x).isin("-inf", "-infinity"), F.lit(float("-inf"))).otherwise(x.try_cast("double")) for x in found)
    return F.when(lo.isNotNull() & hi.isNotNull(), F.struct(lo.alias("lo"), hi.alias("hi")))


def interval_text(ends: Column) -> Column:
    """The text (a, b] of a struct (lo, hi)."""
    return F.concat(F.lit("("), ends["lo"].cast("string"), F.lit(", "), ends["hi"].cast("string"), F.lit("]"))


def uppers_of(table: DataFrame, variable: str, column: str = "interval") -> list[float]:
    """The ascending upper ends of a variable's intervals in a saved table (variable, interval), as structs (lo, hi) or as text (a, b].

    For apply_cutoffs(). ValueError without intervals, with text that is none, or if they leave a gap or overlap.
    """
    rows = table.where((F.col("variable") == variable) & F.col(column).isNotNull())
    of = interval(F.col(column)) if isinstance(table.schema[column].dataType, StringType) else F.col(column)
    ends = [r["i"] for r in rows.select(of.alias("i")).distinct().collect()]  # a row a bin
    if not ends:
        raise ValueError(f"no cutoff for {variable}")
    if any(e is None for e in ends):
        raise ValueError(f"a cutoff of {variable} is no interval (a, b]")
    ends = sorted((e["lo"], e["hi"]) for e in ends)
    if any(a[1] != b[0] for a, b in zip(ends, ends[1:])) or any(lo >= hi for lo, hi in ends):
        raise ValueError(f"the intervals of {variable} are not side by side")
    return [hi for _, hi in ends]


def apply_cutoffs(df: DataFrame, variable: str, uppers: Sequence[float], out: str, labels: Sequence[object] | None = None) -> DataFrame:
    """Add out, the right-closed bin of variable between ascending upper cutoffs; the outer bins are unbounded.

    uppers: the upper ends of the fitted bins; the last one stands for infinity. No cutoff raises ValueError.
    """
    if not uppers:
        raise ValueError(f"no cutoff for {variable}")
    number = F.lit(len(uppers))
    for k in range(len(uppers) - 1, 0, -1):
        number = F.when(F.col(variable) <= uppers[k - 1], k).otherwise(number)
    number = F.when(F.col(variable).isNotNull(), number)
    return df.withColumn(out, labelled(number, labels) if labels else number)


def vingtile_edges(n: int, bins: int = 20) -> list[float]:
    """Edges among the ranks 1..n, in the double arithmetic of a quantile of whole numbers."""
    out = []
    for k in range(bins + 1):
        v = (k / bins) * (n - 1)
        out.append(1 + math.floor(v) + (v - math.floor(v)))
    return out


def keys_at(rows: DataFrame, row_key: Sequence[str], wanted: Iterable[tuple[int, int]]) -> dict[tuple[int, int], tuple]:
    """For each (group, place) the row_key of the row at that place, from 1, among the rows of that group (_g) in the order of row_key.

    Rows are counted in even ranges of the first key column where that is a number, and only a range that holds a wanted place is
    ordered. If it has more than ROWS_A_TASK rows it is divided further; where all its rows are equal in that column, by the next one.
    """
    spark, first = rows.sparkSession, row_key[0]
    number = F.col(first).cast("double") if isinstance(rows.schema[first].dataType, NumericType) else F.lit(0.0)
    plain = F.when(~F.isnan(number), number)
    spans = rows.groupBy("_g").agg(F.min(plain).alias("_lo"), F.max(plain).alias("_hi"), F.count(F.lit(1)).alias("_all"))
    spans = spark.createDataFrame(spans.collect(), spans.schema)  # a row a group
    width = F.col("_hi") - F.col("_lo")
    place = F.least(F.floor((number - F.col("_lo")) / width * RANGES), F.lit(RANGES - 1))
    cell = F.when(number.isNull(), -1).when(F.isnan(number), RANGES).when((width > 0) & (width < math.inf), place).otherwise(0).cast("int")
    placed = rows.join(F.broadcast(spans), "_g").withColumn("_cell", cell)
    equal = F.min(first).eqNullSafe(F.max(first)) & F.count(first).isin(F.lit(0), F.count(F.lit(1)))
    counts = placed.groupBy("_g", "_cell", "_all").agg(F.count(F.lit(1)).alias("_c"), F.min(first).alias("_least"), equal.alias("_equal"))
    before = Window.partitionBy("_g").orderBy("_cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    places = F.broadcast(spark.createDataFrame(sorted(wanted), "_g int, _place long"))
    at = counts.withColumn("_before", F.sum("_c").over(before) - F.col("_c")).join(places, "_g").where("_place > _before and _place <= _before + _c").collect()  # a row a place

    out = {(r["_g"], r["_place"]): (r["_least"],) for r in at if r["_equal"] and len(row_key) == 1}
    at = [r for r in at if (r["_g"], r["_place"]) not in out]
    large = [r for r in at if r["_c"] > ROWS_A_TASK and (r["_equal"] or r["_c"] < r["_all"])]
    for part, keys in (([r for r in large if not r["_equal"]], row_key), ([r for r in large if r["_equal"]], row_key[1:])):
        if part:
            ids = {c: k for k, c in enumerate(sorted({(r["_g"], r["_cell"]) for r in part}))}
            these = spark.createDataFrame([(*c, k) for c, k in ids.items()], "_g int, _cell int, _k int")
            inner = once(placed.join(F.broadcast(these), ["_g", "_cell"]).select(F.col("_k").alias("_g"), *keys))
            found = keys_at(inner, keys, {(ids[r["_g"], r["_cell"]], r["_place"] - r["_before"]) for r in part})
            for r in part:
                key = found[ids[r["_g"], r["_cell"]], r["_place"] - r["_before"]]
                out[r["_g"], r["_place"]] = (r["_least"], *key) if r["_equal"] else key
    small = [(r["_g"], r["_cell"], r["_place"], r["_place"] - r["_before"]) for r in at if r not in large]
    if small:
        within = Window.partitionBy("_g", "_cell", "_place").orderBy(*row_key)
        near = placed.join(F.broadcast(spark.createDataFrame(small, "_g int, _cell int, _place long, _n long")), ["_g", "_cell"])
        found = near.withColumn("_r", F.row_number().over(within)).where("_r = _n").select("_g", "_place", F.struct(*row_key).alias("_k"))
        out |= {(r["_g"], r["_place"]): tuple(r["_k"]) for r in found.collect()}  # a row a place
    return out


def vingtiles(df: DataFrame, score: str, row_key: Sequence[str], bins: int = 20, out: str = "score_vingtile") -> DataFrame:
    """Add out: the bin of a row's rank by score, ties in the order of row_key; null for a null score.

    df is read for the counts, for the keys at the edges and for the result, and is not written: give it written (sources.files.once) if it
    takes more than a scan. Counts by score tell the score at each of the
    bins - 1 inner edges, and of a score that an edge parts, the row_key at the edge is looked up; every row is then binned by
    comparing its score with them, and its row_key with those of its score only. Rows that are equal in both share a bin.
    """
    value = F.col(score).cast("double")
    slim = df.where(F.col(score).isNotNull()).select(value.alias("_s"), *row_key)
    upto = running(slim.groupBy("_s").agg(F.count(F.lit(1)).alias("_n")), [], "_s", ["_n"])
    edges = vingtile_edges(upto.agg(F.sum("_n")).first()[0] or 0, bins)[1:-1]
    least = [F.min(F.when(F.col("cum__n") > e, F.struct("_s", (F.col("cum__n") - F.col("_n")).alias("before")))).alias(f"e{k}") for k, e in enumerate(edges)]
    at = [(e, math.nan if x[0] != x[0] else x[0], x[1]) for e, x in zip(edges, upto.agg(*least).first()) if x is not None]  # of each edge the least score with a rank above it, and the rows before that score
    places: dict[float, list[int]] = {}  # of each score that edges part: the places of its last rows below them
    for e, s, before in at:
        if before + 1 <= e:
            places.setdefault(s, []).append(math.floor(e) - before)
    group = {s: k for k, s in enumerate(places)}
    fields = [(c, df.schema[c].dataType) for c in row_key]
    keys = keys_at(slim.where(F.col("_s").isin(list(group))).select(mapped(F.col("_s"), group).alias("_g"), *row_key), row_key, {(group[s], n) for s in places for n in places[s]}) if places else {}
    key = F.struct(*row_key)
    alike = ArrayType(df.select(key.alias("k")).schema["k"].dataType)  # of the rows' type to the last, so that no row's edges are cast to it
    parted = {s: F.array(*[F.struct(*[F.lit(x).cast(kind).alias(c) for (c, kind), x in zip(fields, keys[group[s], n])]) for n in places[s]]).cast(alike) for s in places}

    number = F.lit(1)
    for e, s, before in at:
        number = number + F.when(value > s if before + 1 <= e else value >= s, 1).otherwise(0)
    for k in range(max(map(len, places.values()), default=0)):
        number = number + F.when(F.get(mapped(value, parted), F.lit(k)) < key, 1).otherwise(0)
    return df.withColumn(out, F.when(F.col(score).isNotNull(), number).cast("int"))


def binned_rates(df: DataFrame, variable: str, bins: int, how: str = "quantile", target: str = "def", by: Sequence[str] = ()) -> DataFrame:
    """(by..., bin, n, default_rate in percent) of a variable in quantile bins ('quantile' raises on equal edges, 'distinct' drops them) or in bins of equal width ('width').

    The rows behind charts of default rates by bin. Rows without a value have no bin and don't count.
    """
    if how == "width":
        placed = equal_width_bins(df, variable, bins, "bin")
    elif how in ("quantile", "distinct"):
        placed = quantile_bins(df, variable, bins, "bin", duplicates="raise" if how == "quantile" else "drop")
    else:
        raise ValueError("how must be quantile, distinct or width")
    rate = 100 * F.avg(F.col(target).cast("double"))
    return placed.where("bin is not null").groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"), rate.alias("default_rate"))
