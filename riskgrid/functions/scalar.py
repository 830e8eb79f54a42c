"""Scalar expressions over columns: clips, maps, classes by threshold, labels and the chi-squared tail."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Upper bounds (exclusive) and names of stability classes of a population-stability index.
PSI_CLASSES = ((0.10, "Stable"), (0.25, "Light drift"), (math.inf, "Strong drift"))
#: The same for how strongly Cramér's V associates a variable with the target, and for reading a single V.
V_STRENGTHS = ((0.10, "weak"), (0.30, "moderate"), (math.inf, "strong"))
V_READINGS = ((0.10, "very weak"), (0.20, "weak"), (0.30, "moderate"), (math.inf, "strong"))
#: Terms of the series and of the continued fraction of chi2_sf.
SERIES_TERMS, FRACTION_TERMS = 600, 300


def clip(column: Column, low: Column | float | None = None, high: Column | float | None = None) -> Column:
    """column held within [low, high]; null stays null (greatest() and least() would drop it)."""
    out = column
    if low is not None:
        out = F.when(out < low, low).otherwise(out)
    if high is not None:
        out = F.when(out > high, high).otherwise(out)
    return out


def mapped(column: Column, values: Mapping[object, object]) -> Column:
    """values[column], null where it has no such key."""
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[column]


def mapped_or_self(column: Column, values: Mapping[str, str]) -> Column:
    return F.coalesce(mapped(column, values), column) if values else column


def missing_flag(column: Column) -> Column:
    return column.isNull().cast("int")


def as_modality(column: Column) -> Column:
    """A modality as text; a missing one is 'nan'."""
    return F.coalesce(column.cast("string"), F.lit("nan"))


def class_of(column: Column, classes: tuple[tuple[float, str], ...]) -> Column:
    """The name of the first class whose upper bound is above column; null for null."""
    out = F.lit(classes[-1][1])
    for bound, name in reversed(classes[:-1]):
        out = F.when(column < bound, name).otherwise(out)
    return F.when(column.isNotNull(), out)


def interval_label(low: Column, high: Column, open_low: bool = True) -> Column:
    return F.format_string("]%.2f ; %.2f]" if open_low else "[%.2f ; %.2f]", low, high)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def half_even(column: Column, digits: int) -> Column:
    return F.bround(column, digits)


def let(value: Column, use) -> Column:
    """use(value), with value computed once however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def log_gamma_half(df: Column) -> Column:
    """log Gamma(df / 2) for whole df >= 1, by the product down to Gamma(1) or Gamma(1/2)."""
    even = df % 2 == 0
    below = F.when(df > 2, F.sequence(F.lit(1), (F.floor((df - 1) / 2)).cast("int"))).otherwise(F.array().cast("array<int>"))
    terms = F.transform(below, lambda k: F.ln(F.when(even, k.cast("double")).otherwise(k - 0.5)))
    return F.aggregate(terms, F.when(even, F.lit(0.0)).otherwise(F.lit(0.5 * math.log(math.pi))), lambda a, x: a + x)


def chi2_sf(x: Column, df: Column) -> Column:
    """P(X > x) for a chi-squared variable of whole df >= 1; null for null or df < 1.

    Below the mean the series of the lower incomplete gamma function, else its continued fraction from the back, so that small
    probabilities keep their relative precision.
    """

    def tail(v: Column) -> Column:
        a, y, log_gamma = v["a"], v["y"], v["g"]
        start = F.struct((1 / a).alias("term"), (1 / a).alias("sum"))
        series = F.aggregate(F.sequence(F.lit(1), F.lit(SERIES_TERMS)), start, lambda s, k: F.struct((s["term"] * y / (a + k)).alias("term"), (s["sum"] + s["term"] * y / (a + k)).alias("sum")), lambda s: s["sum"])
        lower = 1 - F.exp(-y + a * F.ln(y) - log_gamma) * series
        fraction = F.aggregate(F.sequence(F.lit(FRACTION_TERMS), F.lit(1), F.lit(-1)), y + 2 * FRACTION_TERMS + 1 - a, lambda f, k: y + 2 * (k - 1) + 1 - a - k * (k - a) / f)
        return F.when(y <= 0, F.lit(1.0)).when(y < a + 1, lower).otherwise(F.exp(-y + a * F.ln(y) - log_gamma) / fraction)

    parts = F.struct((df / 2.0).alias("a"), (x / 2.0).cast("double").alias("y"), log_gamma_half(df).alias("g"))
    return F.when(x.isNotNull() & (df >= 1), let(parts, tail))
