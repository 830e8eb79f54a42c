from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from riskgrid.functions import scalar
from riskgrid.operators import logit


# closed forms: df 2 is exp(-x/2), df 1 is erfc(sqrt(x/2)), df 4 is (1 + x/2) exp(-x/2)
@pytest.mark.parametrize(
    ("x", "df", "want"),
    [(0.0, 3, 1.0), (0.01, 1, math.erfc(math.sqrt(0.005))), (3.0, 1, math.erfc(math.sqrt(1.5))), (200.0, 1, math.erfc(10.0)), (5.0, 2, math.exp(-2.5)), (900.0, 2, math.exp(-450)), (8.0, 4, 5 * math.exp(-4)), (1000.0, 4, 501 * math.exp(-500))],
)
def test_chi2_tail(spark, x, df, want):
    got = spark.range(1).select(scalar.chi2_sf(F.lit(x), F.lit(df)).alias("p")).first()["p"]
    assert got == pytest.approx(want, rel=1e-9)
    assert logit.chi2_tail(x, df) == pytest.approx(want, rel=1e-9)


def test_chi2_of_null_and_of_no_freedom_is_null(spark):
    row = spark.range(1).select(scalar.chi2_sf(F.lit(None).cast("double"), F.lit(2)).alias("a"), scalar.chi2_sf(F.lit(1.0), F.lit(0)).alias("b")).first()
    assert row["a"] is None and row["b"] is None


def test_clip_keeps_null_and_maps_fall_back(spark):
    df = spark.createDataFrame([(1.0, "a"), (9.0, "b"), (None, None)], "x double, k string")
    rows = df.select(scalar.clip(F.col("x"), 2, 5).alias("c"), scalar.mapped(F.col("k"), {"a": "A"}).alias("m"), scalar.mapped_or_self(F.col("k"), {"a": "A"}).alias("s"), scalar.as_modality(F.col("k")).alias("t")).collect()
    assert [tuple(r) for r in rows] == [(2.0, "A", "A", "a"), (5.0, None, "b", "b"), (None, None, None, "nan")]


def test_classes_of_a_stability_index(spark):
    df = spark.createDataFrame([(0.0999,), (0.1,), (0.25,), (None,)], "x double")
    assert [r[0] for r in df.select(scalar.class_of(F.col("x"), scalar.PSI_CLASSES)).collect()] == ["Stable", "Light drift", "Strong drift", None]
