"""Winsorizing and imputation fitted on the training sample."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import clip, missing_flag
from .order import melted, quantiles


def bounds_table(df: DataFrame, columns: Sequence[str], lower: float = 0.01, upper: float = 0.99) -> DataFrame:
    """(variable, lower, upper): the given quantiles of each column, for a report."""
    return quantiles(melted(df, columns), ["variable"], (lower, upper)).select("variable", F.col("q")[0].alias("lower"), F.col("q")[1].alias("upper"))


def iqr_bounds(train: DataFrame, columns: Sequence[str], width: float = 1.5) -> dict[str, tuple[float, float]]:
    """For each column Q1 - width * IQR and Q3 + width * IQR over train."""
    found = quantiles(melted(train, columns), ["variable"], (0.25, 0.75)).collect()  # a row per column
    return {r["variable"]: (r["q"][0] - width * (r["q"][1] - r["q"][0]), r["q"][1] + width * (r["q"][1] - r["q"][0])) for r in found}


def winsorize(df: DataFrame, columns: Sequence[str], sample: str = "dataset", train: str = "Train") -> DataFrame:
    """df with columns clipped to the bounds of the training sample; missing values stay missing."""
    bounds = iqr_bounds(df.where(F.col(sample) == train), columns)
    return df.withColumns({c: clip(F.col(c), *bounds[c]) for c in columns if c in bounds})


def impute(df: DataFrame, constants: dict[str, float], medians: Sequence[str], sample: str = "dataset", train: str = "Train") -> DataFrame:
    """Add <c>_missing for each filled column, then fill: with its constant, or with its median over the training sample."""
    found = quantiles(melted(df.where(F.col(sample) == train), medians), ["variable"], (0.5,)).collect()  # a row per column
    fills = constants | {r["variable"]: r["q"][0] for r in found}
    flags = {f"{c}_missing": missing_flag(F.col(c)) for c in [*constants, *medians]}
    return df.withColumns(flags).withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fills.items()})


def missing_flags(df: DataFrame, sample: str = "dataset", train: str = "Train") -> DataFrame:
    """Add <c>_missing for each column with a missing value in the training sample."""
    found = df.where(F.col(sample) == train).agg(*[F.max(F.col(c).isNull()).alias(c) for c in df.columns]).first()
    return df.withColumns({f"{c}_missing": missing_flag(F.col(c)) for c in df.columns if found[c]} or {sample: F.col(sample)})
