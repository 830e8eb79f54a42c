"""How often the tables are read and how much is moved: each input is joined once, whatever the number of passes after that."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskgrid.operators import association, binning, order, preparation, scorecard, selection, stability, woe
from riskgrid.sources import files, loanbook


def counted(df, acc):
    """df with a column whose every evaluation adds one to acc."""

    def seen(rows):
        for frame in rows:
            acc.add(len(frame))
            yield frame

    return df.mapInPandas(seen, df.schema)


@pytest.fixture
def seen(spark):
    return spark.sparkContext.accumulator(0)


def test_the_book_joins_its_tables_once_for_all_passes(spark, seen, monkeypatch):
    lines = loanbook.lines
    monkeypatch.setattr(loanbook, "lines", lambda s, d: counted(lines(s, d), seen))
    book = loanbook.loan_book(spark, "/root/testdata/sf0.001", ["emp_like", "rate_like"])
    assert set(book.columns) == {"def", "year", "u", "emp_like", "rate_like", "fold", "dataset"}
    filled = preparation.impute(book.withColumn("emp_like", F.col("emp_like").cast("double")), {"emp_like": 0.0}, ["rate_like"])
    assert filled.where("rate_like is null or emp_like is null").count() == 0
    assert seen.value == spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count() == filled.count()


def test_positions_keep_the_wanted_columns_and_read_rows_once(spark, seen):
    df = counted(spark.range(500).select("id", (F.col("id") % 3).alias("k"), (F.col("id") * 7 % 11).alias("c"), F.lit("x").alias("other")), seen)
    rows = order.positions(df, ["k"], "c", ["id"], keep=["other"]).toPandas()
    assert seen.value == 500 and set(rows.columns) == {"k", "c", "other", "position"}
    for _, part in rows.groupby("k"):
        assert sorted(part["position"]) == list(range(1, len(part) + 1))


def hundreds(spark, n: int = 400):
    x = F.col("id")
    return spark.range(n).select((x * 7 % 101).cast("double").alias("a"), (x * 13 % 57).cast("double").alias("b"), (x * 7 % 101 + x % 3).cast("double").alias("c"), (x * 31 % 5 < 2).cast("int").alias("def"), (x % 4).cast("int").alias("fold"))


def test_woe_table_reads_its_rows_once(spark, seen):
    table = woe.woe_table(counted(hundreds(spark), seen), ["a", "b"])
    assert table.groupBy("variable").agg(F.sum("n").alias("n")).where("n = 400").count() == 2
    assert seen.value == 400


def test_tests_of_association_read_their_rows_once(spark, seen):
    assert association.kruskal(counted(hundreds(spark), seen), ["a", "b"], "def").count() == 2 and seen.value == 400
    assert association.cramers_v_with_target(counted(hundreds(spark), seen), ["a", "b"], "def").count() == 2 and seen.value == 800


@pytest.mark.parametrize("most", [1000, 0])
def test_correlated_variables_look_their_ranks_up(spark, seen, monkeypatch, most):
    monkeypatch.setattr(association, "BROADCAST_VALUES", most)
    out = selection.drop_correlated(counted(hundreds(spark), seen), ["a", "b", "c"], "def", range(4))
    kept = {r["variable"]: r["kept"] for r in out.collect()}
    assert kept["b"] and not (kept["a"] and kept["c"]) and seen.value == 400
    pdf = hundreds(spark).toPandas()
    for r in selection.spearman_by_fold(hundreds(spark), ["a", "b", "c"], range(4)).collect():
        assert r["r"] == pytest.approx(pdf[pdf["fold"] != r["left_out"]][[r["a"], r["b"]]].corr("spearman").iloc[0, 1])
    ranks = association.ranked(hundreds(spark), ["a", "b"], ["fold"]).toPandas()
    want = pdf[["a", "b"]].groupby(pdf["fold"]).rank().assign(fold=pdf["fold"])
    assert sorted(map(tuple, ranks[["fold", "a", "b"]].to_numpy())) == sorted(map(tuple, want[["fold", "a", "b"]].to_numpy()))


def test_vingtiles_write_no_rows_but_those_at_edges(spark, monkeypatch):
    written = []
    monkeypatch.setattr(binning, "once", lambda df: written.append(df.count()) or files.once(df))
    df = spark.range(4000).select("id", (F.col("id") % 1000).cast("double").alias("s"))
    assert binning.vingtiles(df, "s", ["id"]).groupBy("score_vingtile").count().where("count = 200").count() == 20
    assert sum(written) <= 4 * 19


def test_stability_repeats_counts_for_pairs_and_not_rows(spark, monkeypatch):
    compared, repeated = stability.compared, []
    monkeypatch.setattr(stability, "compared", lambda counts, pairs: repeated.append(counts.count()) or compared(counts, pairs))
    df = hundreds(spark).withColumn("dataset", F.concat(F.lit("s"), F.col("fold") % 3))
    found = stability.psi(df, "dataset", [("s0", "s1"), ("s1", "s2")], ["a", "b"], ["def"], bins=4)
    assert found.where("psi is not null").count() == 6 and max(repeated) <= 3 * 2 * 12


def test_rows_beyond_a_task_are_dealt_to_more_tasks_and_items_are_not_sorted_for_their_join(spark, monkeypatch):
    rows = {c: [r[c] for r in loanbook.loan_book(spark, "/root/testdata/sf0.001", ["k1", "k2"]).orderBy("k1", "k2", "u", "fold").collect()] for c in ("k1", "fold", "dataset")}
    monkeypatch.setattr(order, "ROWS_A_TASK", 500)
    items = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    lines = loanbook.lines(spark, "/root/testdata/sf0.001")
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan and "Sort [" not in plan
    assert plan.count("REPARTITION_BY_NUM") == 2 and lines.rdd.getNumPartitions() == -(-items // 500)
    again = loanbook.loan_book(spark, "/root/testdata/sf0.001", ["k1", "k2"]).orderBy("k1", "k2", "u", "fold").collect()
    assert all([r[c] for r in again] == rows[c] for c in rows)


def test_classes_of_periods_name_the_edges_once(spark):
    x = F.col("id")
    df = spark.range(4000).select("id", (x % 1000).cast("double").alias("score_total"), (x % 3).alias("year"), (x * 31 % 5 < 2).cast("int").alias("def"))
    table = scorecard.class_stability(scorecard.with_classes(df, ["id"]))
    plan = table._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and plan.count("struct(id") <= 2  # found once for each row, and compared with the keys at the edges of its own score
    assert {r["score_class"]: r["n"] for r in table.groupBy("score_class").agg(F.sum("n").alias("n")).collect()} == {k: 200 * (b - a + 1) for k, (a, b, _) in enumerate(scorecard.CLASSES, 1)}


@pytest.mark.parametrize("task", [50, 10**6])
def test_keys_at_edges_are_found_whatever_the_spread_of_the_keys(spark, monkeypatch, task):
    monkeypatch.setattr(binning, "ROWS_A_TASK", task)
    monkeypatch.setattr(binning, "RANGES", 8)
    rng = np.random.default_rng(4)
    first = np.concatenate([np.full(1500, 7.0), 2.0 ** rng.integers(-40, 60, 700), rng.normal(size=500), [np.inf, -np.inf, np.nan, np.nan]])
    rows = [(1.0 if k % 3 else float(k % 2), None if k % 11 == 0 else float(a), int(b), f"r{c}") for k, (a, b, c) in enumerate(zip(first, rng.integers(0, 40, len(first)), rng.permutation(len(first))))]
    df = spark.createDataFrame(rows, "s double, a double, b int, c string")

    def way(r):
        a = r[1]
        return (r[0], a is not None, a is not None and a != a, 0.0 if a is None or a != a else a, r[2], r[3])

    want = {r[3]: int(v) for r, v in zip(sorted(rows, key=way), pd.qcut(np.arange(1, len(rows) + 1), 20, labels=False) + 1)}
    assert {r["c"]: r["score_vingtile"] for r in binning.vingtiles(df, "s", ["a", "b", "c"]).collect()} == want


def test_scores_that_are_no_number_come_last(spark):
    df = spark.range(400).select("id", F.when(F.col("id") % 2 == 0, float("nan")).otherwise(F.col("id").cast("double")).alias("s"))
    got = {r["id"]: r["score_vingtile"] for r in binning.vingtiles(df, "s", ["id"]).collect()}
    assert got == {k: 1 + (k // 2 if k % 2 else 200 + k // 2) // 20 for k in range(400)}
