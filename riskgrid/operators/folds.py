"""Stratified splits and folds, the same in every run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import positions

CELLS = 1 << 16


def shuffled(row_key: Sequence[str], seed: int) -> Column:
    """A random cell of each row, drawn by a hash of its key."""
    return F.shiftrightunsigned(F.xxhash64(*row_key, F.lit(seed)), 48)


def stratified_positions(df: DataFrame, strata: Sequence[str], row_key: Sequence[str], seed: int = 42) -> DataFrame:
    """Add position: 1, 2, ... within each stratum in random order."""
    return positions(df.withColumn("_shuffle", shuffled(row_key, seed)), strata, "_shuffle", row_key).drop("_shuffle")


def stratified_split(df: DataFrame, strata: Sequence[str], row_key: Sequence[str], test_share: float = 0.2, seed: int = 42, out: str = "is_test") -> DataFrame:
    """Add out: true for the share of each stratum nearest to test_share from below, by one row at most."""
    placed = stratified_positions(df, strata, row_key, seed)
    return placed.withColumn(out, F.floor(F.col("position") * test_share) > F.floor((F.col("position") - 1) * test_share)).drop("position")


def stratified_folds(df: DataFrame, k: int, strata: Sequence[str], row_key: Sequence[str], first: int = 0, seed: int = 42, out: str = "fold") -> DataFrame:
    """Add out: a fold first .. first + k - 1; within a stratum the folds' sizes differ by one row at most."""
    placed = stratified_positions(df, strata, row_key, seed)
    return placed.withColumn(out, ((F.col("position") - 1) % k + first).cast("int")).drop("position")


def drawn(keys: Sequence[Column], seed: int) -> Column:
    """A whole number below 2 ** 31 - 1 from whole numbers, by integer arithmetic that any SQL engine repeats."""
    prime = (1 << 31) - 1
    out = F.lit(seed).cast("long")
    for key in keys:
        out = (out * 48271 + F.pmod(key.cast("long"), F.lit(prime))) % prime
    for _ in range(3):  # spreads small keys over the range
        out = (out * 69621 + 12345) % prime
    return out


def sampled(df: DataFrame, n: int, row_key: Sequence[str], seed: int = 42, whole: Sequence[str] | None = None) -> DataFrame:
    """A simple random sample of n rows: those of smallest hash of the key (of its columns `whole`, whole numbers, where given, else of all)."""
    draw = F.xxhash64(*row_key, F.lit(seed)) if whole is None else drawn([F.col(c) for c in whole], seed)
    return df.orderBy(draw, *row_key).limit(n)
