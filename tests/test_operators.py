from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskgrid.operators import association, binning, distributions, folds, logit, metrics, models, order, preparation, scorecard, selection, stability, summaries, woe
from riskgrid.plans.catalogue import MODEL


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(1)
    n = 3000
    x = np.round(rng.normal(50, 20, n), 1)
    x[::17] = np.nan
    pdf = pd.DataFrame({"id": range(n), "x": x, "tied": rng.integers(0, 5, n).astype(float), "k": rng.choice(list("abc"), n), "year": rng.integers(2015, 2018, n), "def": (rng.random(n) < 0.3).astype(int)})
    return pdf, spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x"))).cache()


def test_quantiles_are_exact(sample):
    pdf, df = sample
    p = [0, 0.01, 0.1, 0.25, 0.5, 0.77, 0.99, 1]
    got = {(r["year"], r["variable"]): r["q"] for r in order.quantiles(order.melted(df, ["x", "tied"], ["year"]), ["year", "variable"], p).collect()}
    for (year, v), q in got.items():
        assert q == pytest.approx(np.nanquantile(pdf.loc[pdf.year == year, v], p), abs=1e-9)


def test_quantiles_of_many_rows_use_brackets(spark, monkeypatch):
    monkeypatch.setattr(order, "ACCURACY", 100)
    df = spark.range(20_000).select(((F.col("id") * 7919) % 20_000).cast("double").alias("x"))
    q = order.quantiles(order.melted(df, ["x"]), ["variable"], [0.1, 0.5, 0.9]).first()["q"]
    assert q == pytest.approx([1999.9, 9999.5, 17999.1])


def test_running_sums_and_average_ranks(sample):
    pdf, df = sample
    counts = order.melted(df, ["x", "tied"]).where("value is not null").groupBy("variable", "value").agg(F.count("*").alias("n"))
    got = {(r["variable"], r["value"]): r["rank"] for r in order.average_ranks(counts, ["variable"]).collect()}
    for v in ("x", "tied"):
        ranks = pdf[v].rank()
        assert all(got[v, x] == r for x, r in zip(pdf[v].dropna(), ranks.dropna()))


def test_positions_number_each_stratum(sample):
    _, df = sample
    rows = order.positions(df.withColumn("c", F.col("id") % 13), ["k"], "c", ["id"]).toPandas()
    for _, part in rows.groupby("k"):
        assert sorted(part["position"]) == list(range(1, len(part) + 1))
        assert part.sort_values("position")[["c", "id"]].equals(part.sort_values(["c", "id"])[["c", "id"]])


def test_bins(spark):
    df = spark.createDataFrame([(float(x),) for x in (0, 1, 2, 3, 10)], "x double")
    assert binning.equal_width_edges(0, 10, 3) == pytest.approx([-0.01, 3.333333, 6.666667, 10], abs=1e-6)
    assert [r["b"] for r in binning.equal_width_bins(df, "x", 3, "b").orderBy("x").collect()] == [1, 1, 1, 1, 3]
    tied = spark.createDataFrame([(1.0,)] * 4 + [(2.0,)], "x double")
    with pytest.raises(ValueError, match="not unique"):
        binning.quantile_bins(tied, "x", 3, "b")
    assert {r["b"] for r in binning.quantile_bins(tied, "x", 3, "b", duplicates="drop").collect()} == {1}
    with pytest.raises(ValueError, match="no cutoff"):
        binning.apply_cutoffs(df, "x", [], "b")
    assert [r["b"] for r in binning.apply_cutoffs(df, "x", [1.0, 2.5, 3.0], "b", ["u", "v", "w"]).orderBy("x").collect()] == ["u", "u", "v", "w", "w"]


@pytest.mark.parametrize("n", [20, 91, 171, 181, 599])
def test_vingtile_edges_follow_quantiles_of_ranks(n):
    ranks = pd.Series(np.arange(1, n + 1))
    want = pd.qcut(ranks, 20, labels=False) + 1
    edges = binning.vingtile_edges(n)
    assert [max(1, sum(e < r for e in edges[:-1])) for r in ranks] == list(want)


def test_displayed_edges_match_interval_text():
    x = pd.Series([0.12345, 0.5, 1.23456, 7.0, 9.87654, 12.5, 12.50049, 30.1])
    cut = pd.qcut(x, 4)
    got = binning.displayed_edges(list(x.quantile([0, 0.25, 0.5, 0.75, 1])))
    assert got[1:] == [i.right for i in cut.cat.categories] and got[0] == pytest.approx(cut.cat.categories[0].left)


def test_vingtiles_of_rows_with_ties_and_without_score(spark):
    rows = [(i, float(i % 7) if i % 10 else None) for i in range(500)]
    got = binning.vingtiles(spark.createDataFrame(rows, "id int, s double"), "s", ["id"]).toPandas().sort_values("id")
    rank = got["s"].rank(method="first")
    want = pd.qcut(rank, 20, labels=False) + 1
    assert got["score_vingtile"].isna().sum() == 50
    assert (got["score_vingtile"].dropna() == want.dropna()).all()
    empty = binning.vingtiles(spark.createDataFrame([], "id int, s double"), "s", ["id"])
    assert empty.count() == 0


def test_winsorizing_again_changes_nothing(sample):
    _, df = sample
    one = preparation.winsorize(df.withColumn("dataset", F.lit("Train")), ["x"])
    two = preparation.winsorize(one, ["x"])
    assert one.agg(F.sum("x"), F.count("x")).first() == two.agg(F.sum("x"), F.count("x")).first()


def test_imputation_uses_the_training_median(spark):
    rows = [("Train", 1.0, None), ("Train", 3.0, 5.0), ("Train", None, 7.0), ("OOT", None, None), ("OOT", 100.0, 1.0)]
    out = preparation.impute(spark.createDataFrame(rows, "dataset string, rate double, emp double"), {"emp": 0.0}, ["rate"]).collect()
    assert [(r["rate"], r["emp"], r["rate_missing"], r["emp_missing"]) for r in out] == [(1, 0, 0, 1), (3, 5, 0, 0), (2, 7, 1, 0), (2, 0, 1, 1), (100, 1, 0, 0)]


def test_summary_rejects_unknown_keys_and_columns(sample):
    _, df = sample
    with pytest.raises(ValueError, match="sort_by"):
        summaries.default_summary(df, "k", sort_by="size")
    with pytest.raises(ValueError, match="missing columns"):
        summaries.default_summary(df, "nowhere")


def test_stability_index_of_a_sample_with_itself_is_zero(sample):
    _, df = sample
    twice = df.withColumn("s", F.lit("a")).union(df.withColumn("s", F.lit("b")))
    assert all(abs(r["psi"]) < 1e-12 for r in stability.psi(twice, "s", [("a", "b")], ["x", "tied"], ["k"]).collect())


def test_stability_index_leaves_out_the_least_value_and_names_empty_bins(spark):
    ref, curr = [1, 2, 3, 4, 5, 6], [1, 2, 2, 3, 4, 9]
    df = spark.createDataFrame([("r", float(x)) for x in ref] + [("c", float(x)) for x in curr], "s string, x double")
    table = {r["bin"]: (r["r"], r["c"]) for r in stability.binned_shares(df, "s", [("r", "c")], ["x"], 3).collect()}
    assert table == {"1": (0.2, 0.5), "2": (0.4, 0.5), "3": (0.4, 0.0)}  # bins (1, 2.67], (2.67, 4.33], (4.33, 6]
    assert stability.psi(df, "s", [("r", "c")], ["x"], bins=3).first()["psi"] is None
    with pytest.raises(ValueError, match="empty bins: x r-c bin 3"):
        stability.psi(df, "s", [("r", "c")], ["x"], bins=3, on_empty="raise")


def test_information_value_is_not_negative(sample):
    _, df = sample
    table = woe.woe_table(df, ["x", "tied", "k"])
    assert all(r["iv"] >= 0 for r in woe.information_values(table).collect())
    assert len(woe.cutoffs(table, "x")) == 5 and woe.cutoffs(table, "k") == []


def test_two_by_two_tables_are_corrected_for_continuity(spark):
    df = spark.createDataFrame([("a", "u")] * 10 + [("a", "v")] * 20 + [("b", "u")] * 30 + [("b", "v")] * 15, "x string, y string")
    got = association.contingency_test(df, "x", "y").first()
    o, e = np.array([[10, 20], [30, 15]]), np.array([[16, 14], [24, 21]])
    assert got["chi2"] == pytest.approx(((abs(o - e) - 0.5) ** 2 / e).sum()) and got["dof"] == 1


def test_constant_values_have_no_kruskal_statistic(spark):
    df = spark.createDataFrame([(1.0, 0), (1.0, 1), (1.0, 1)], "x double, y int")
    row = association.kruskal(df, ["x"], "y").first()
    assert row["h"] is None and row["p_value"] is None


def test_folds_are_balanced(sample):
    _, df = sample
    sizes = folds.stratified_folds(df, 4, ["def", "year"], ["id"]).groupBy("def", "year").pivot("fold", [0, 1, 2, 3]).count().collect()
    assert all(max(r[2:]) - min(r[2:]) <= 1 for r in sizes)


def test_auc_of_the_opposite_score_is_the_rest(sample):
    _, df = sample
    a = metrics.metrics(df, "tied").first()["auc"]
    b = metrics.metrics(df.withColumn("tied", -F.col("tied")), "tied").first()["auc"]
    assert a + b == pytest.approx(1)


def test_metrics_without_one_class_are_null(spark):
    row = metrics.metrics(spark.createDataFrame([(0.2, 0), (0.9, 0)], "s double, def int"), "s").first()
    assert row["auc"] is None and row["pr_auc"] is None and row["recall"] is None


def test_best_row_scores_the_scale():
    points = scorecard.modality_points(MODEL)
    assert sum(max(p.values()) for p in points.values()) == pytest.approx(1000)
    with pytest.raises(ValueError, match="nothing to score"):
        scorecard.modality_points({"intercept": 0, "references": {"a": "1"}, "coefficients": {"a": {"2": 0.0}}})


def test_unknown_modality_has_no_score_but_a_probability(spark):
    df = spark.createDataFrame([("1", "1", "F", "REST"), ("?", "1", "F", "REST")], "q3 string, d3 string, l_linestatus string, seg3 string")
    known, unknown = scorecard.probability(scorecard.score(df, MODEL), MODEL).collect()
    assert known["score_total"] is not None and unknown["score_total"] is None and unknown["missing_any"]
    assert known["probability"] == unknown["probability"]


def test_risk_classes_reproduce_published_shares_and_gaps(spark):
    sizes, defaults = (4888, 4887, 3258, 6516, 8145, 4887), (2812, 1898, 710, 907, 617, 164)
    rows = [(k, float(k), 1 if i < d else 0) for k, (n, d) in enumerate(zip(sizes, defaults), 1) for i in range(n)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["score_class", "score_total", "def"])).withColumns({"score_vingtile": F.col("score_class"), "risk_label": F.lit("")})
    got = scorecard.class_table(df).orderBy("score_class").collect()
    assert [round(100 * r["share"], 4) for r in got] == [15.0026, 14.9995, 9.9997, 19.9994, 24.9992, 14.9995]
    assert [round(100 * r["default_rate"], 4) for r in got] == [57.5286, 38.8377, 21.7925, 13.9196, 7.5752, 3.3558]
    assert [r["gap"] and round(100 * r["gap"], 4) for r in got] == [None, 32.4897, 43.8883, 36.1268, 45.5788, 55.6996]
    assert all(r["gap_ok"] and r["size_ok"] for r in got)


def test_density_of_equal_scores_is_zero(spark):
    df = spark.createDataFrame([("Train", 1, 5.0), ("Train", 1, 5.0), ("Train", 0, 1.0)], "dataset string, def int, score_total double")
    assert scorecard.densities(df, points=10).agg(F.max("density")).first()[0] == 0


def test_pattern_fit_matches_glm(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"a": rng.choice(["1", "2", "3"], 4000), "b": rng.choice(["x", "y"], 4000)})
    p = 1 / (1 + np.exp(1 - 0.8 * (pdf.a == "2") - 1.5 * (pdf.a == "3") + 0.6 * (pdf.b == "y")))
    pdf["def"], pdf["dataset"], pdf["fold"] = (rng.random(4000) < p).astype(int), rng.choice(["Train", "Test", "OOT"], 4000, p=[0.6, 0.2, 0.2]), rng.integers(0, 4, 4000)
    df = spark.createDataFrame(pdf)
    found = logit.search(df, ["a", "b"]).where("k = 2").first().asDict()
    refs = logit.reference_modalities(df.where("dataset = 'Train'"), ["a", "b"])
    names = [(v, m) for v, m in (("a", "1"), ("a", "2"), ("a", "3"), ("b", "x"), ("b", "y")) if refs[v] != m]
    flat = df.where("dataset = 'Train'").select(F.col("def").alias("label"), *[(F.col(v) == m).cast("double").alias(f"{v}={m}") for v, m in names])
    fit = GeneralizedLinearRegression(family="binomial", maxIter=50, tol=1e-12).fit(VectorAssembler(inputCols=flat.columns[1:], outputCol="features").transform(flat))
    assert [found["coefficients"][c] for c in flat.columns[1:]] == pytest.approx(list(fit.coefficients), abs=1e-6)
    assert [found["p_values"][c] for c in flat.columns[1:]] == pytest.approx(list(fit.summary.pValues)[:-1], rel=1e-4, abs=1e-12)
    model = logit.model_of(found, refs)
    assert logit.scorecard_table(spark, model).count() == 1 + 5
    auc = {r["dataset"]: r["auc"] for r in logit.evaluate(df, model).collect()}
    assert auc["Test"] == pytest.approx(found["auc_test"], abs=1e-9)


def test_separation_is_an_error_not_a_crash(spark):
    rows = [("1", 0), ("1", 1), ("2", 1), ("2", 1)] * 20
    df = spark.createDataFrame(rows, "a string, def int").withColumns({"dataset": F.lit("Train"), "fold": (F.monotonically_increasing_id() % 4).cast("int")})
    row = logit.search(df, ["a"]).first()
    assert row["error"] and row["gini_penalised"] is None
    with pytest.raises(ValueError, match="no model"):
        logit.best(logit.search(df, ["a"]))


def searchable(n, variables, seed):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({v: rng.choice(list("abc"[: 2 + k % 2]), n) for k, v in enumerate(variables)})
    p = 1 / (1 + np.exp(1 - 0.9 * (pdf[variables[0]] == "b") - 0.5 * (pdf[variables[1]] == "c")))
    pdf["def"], pdf["dataset"], pdf["fold"] = (rng.random(n) < p).astype(int), rng.choice(["Train", "Test", "OOT"], n, p=[0.6, 0.2, 0.2]), rng.integers(0, 4, n)
    return pdf


def same(a, b):
    if isinstance(a, dict):
        return a.keys() == b.keys() and all(same(a[k], b[k]) for k in a)
    return a == b or (isinstance(a, float) and isinstance(b, float) and a == pytest.approx(b, rel=1e-8, abs=1e-8))


def test_models_of_many_patterns_are_fitted_by_sums(spark, monkeypatch):
    variables = ["v1", "v2", "v3"]
    pdf = searchable(3000, variables, 6)
    pdf.loc[pdf["v3"] == "b", "v3"] = None
    df = spark.createDataFrame(pdf)
    want = {r["formula"]: r.asDict(True) for r in logit.search(df, variables).collect()}
    monkeypatch.setattr(logit, "MOST_PATTERNS", 20)
    got = {r["formula"]: r.asDict(True) for r in logit.search(df, variables).collect()}
    assert got.keys() == want.keys() and len(got) == 7
    for formula in want:
        for column in want[formula]:
            assert same(want[formula][column], got[formula][column]), (formula, column)


def test_errors_of_models_fitted_by_sums(spark, monkeypatch):
    monkeypatch.setattr(logit, "MOST_PATTERNS", 0)
    rows = [("1", 0), ("1", 1), ("2", 1), ("2", 1)] * 20
    df = spark.createDataFrame(rows, "a string, def int").withColumns({"dataset": F.lit("Train"), "fold": (F.monotonically_increasing_id() % 4).cast("int")})
    assert "singular" in logit.search(df, ["a"]).first()["error"]
    assert logit.search(df.where("def = 1"), ["a"]).first()["error"] == "one class only"


def test_a_search_over_many_variables_sends_no_large_table(spark):
    variables = [f"v{k}" for k in range(12)]
    found = logit.search(spark.createDataFrame(searchable(1500, variables, 7)), variables, [1, 2, 3])
    assert "Broadcast" not in found._jdf.queryExecution().toString()
    got = logit.ordered(found).collect()
    assert len(got) == 12 + 66 + 220 and {r["k"] for r in got if r["place"] == 1} == {1, 2, 3}
    for k in (1, 2, 3):
        keys = [[r[c] if r[c] is not None else -1 for c in logit.ORDER] for r in sorted(got, key=lambda r: r["place"]) if r["k"] == k]
        assert keys == sorted(keys, reverse=True)


def test_models_saved_and_scored_together(spark, tmp_path):
    variables = ["v1", "v2", "v3"]
    df = spark.createDataFrame(searchable(800, variables, 8)).withColumn("row", F.monotonically_increasing_id())
    refs = logit.reference_modalities(df.where("dataset = 'Train'"), variables)
    models.save_models(models.found_models(logit.search(df, variables), refs), str(tmp_path / "m"))
    known = models.load_models(spark, str(tmp_path / "m"))
    assert known.count() == 7
    odd = df.withColumn("v1", F.when(F.col("row") % 50 == 0, "unknown").otherwise(F.col("v1")))
    for name in ("v1+v3", "v2"):
        model = models.model_named(known, name)
        want = {r["row"]: (r["score_total"], r["missing_any"], r["p"]) for r in scorecard.probability(scorecard.score(odd, model), model, "p").collect()}
        got = {r["row"]: (r["score_total"], r["missing_any"], r["probability"]) for r in models.score_all(odd, known).where(F.col("model") == name).collect()}
        assert got.keys() == want.keys() and all(same(a, b) for k in want for a, b in zip(want[k], got[k]))
    with pytest.raises(ValueError, match="no model"):
        models.model_named(known, "v9")
    assert models.score_all(odd, known.limit(0)).count() == 0


def test_box_statistics_match_pandas(spark):
    rng = np.random.default_rng(12)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b", None], 900), "x": rng.standard_t(2, 900), "y": rng.integers(0, 4, 900).astype(float)})
    pdf.loc[::17, "x"] = None
    got = {(r["g"], r["variable"]): r for r in distributions.box_statistics(spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "g string, x double, y double"), ["x", "y"], ["g"]).collect()}
    assert len(got) == 4
    for (g, v), r in got.items():
        x = pdf.loc[pdf["g"] == g, v].dropna()
        q1, q2, q3 = x.quantile([0.25, 0.5, 0.75])
        low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        want = [len(x), x.mean(), q1, q2, q3, x[x >= low].min(), x[x <= high].max(), (x < low).sum(), (x > high).sum()]
        assert [r[c] for c in ("n", "mean", "q1", "median", "q3", "low_whisker", "high_whisker", "n_below", "n_above")] == pytest.approx(want)
    assert distributions.box_statistics(spark.createDataFrame([], "x double"), ["x"]).count() == 0


def test_densities_keep_to_their_stated_error(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate((rng.normal(0, 1, 4000), rng.normal(6, 0.5, 1000)))
    df = spark.createDataFrame([("a", float(v)) for v in x] + [("one", 3.0), ("same", 2.0), ("same", 2.0), ("a", None), (None, 1.0)], "g string, x double")
    w = x.std(ddof=1) * len(x) ** -0.2
    for fine in (1 << 14, 200):
        got = {g: f.sort_values("x") for g, f in distributions.density(df, "x", ["g"], points=50, fine=fine).toPandas().groupby("g")}
        at = got["a"]["x"].to_numpy()
        assert at[0] == pytest.approx(x.min() - 3 * w) and at[-1] == pytest.approx(x.max() + 3 * w)
        want = np.exp(-(((at[:, None] - x[None, :]) / w) ** 2) / 2).sum(axis=1) / (len(x) * w * np.sqrt(2 * np.pi))
        assert np.abs(got["a"]["density"] - want).max() <= ((x.max() - x.min()) / fine / w) ** 2 / 8 * 0.4 / w
        assert (got["one"]["density"] == 0).all() and (got["same"]["density"] == 0).all() and set(got) == {"a", "one", "same"}
    few = distributions.density(spark.createDataFrame([(float(v),) for v in [1, 1, 2, 5] * 9], "x double"), "x", points=9).toPandas()
    s = np.array([1, 1, 2, 5] * 9, float)
    w = s.std(ddof=1) * len(s) ** -0.2
    assert np.abs(few["density"] - np.exp(-(((few["x"].to_numpy()[:, None] - s) / w) ** 2) / 2).sum(axis=1) / (len(s) * w * np.sqrt(2 * np.pi))).max() < 1e-12
    assert distributions.density(df.limit(0), "x", ["g"]).count() == 0 and distributions.density(df.limit(0), "x").count() == 0


def test_intervals_read_back_give_the_same_bins(spark, tmp_path):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame(pd.DataFrame({"x": rng.normal(size=800).round(3), "z": rng.gamma(2, 3, 800).round(2), "def": rng.integers(0, 2, 800)}))
    table = woe.woe_table(df, ["x", "z"])
    woe.intervals(table).write.parquet(str(tmp_path / "i"))
    saved = spark.read.parquet(str(tmp_path / "i"))
    text = saved.select("variable", binning.interval_text(F.col("interval")).alias("interval"))
    for v in ("x", "z"):
        want = [r["b"] for r in binning.apply_cutoffs(df, v, woe.cutoffs(table, v), "b").collect()]
        for known in (saved, text):
            assert [r["b"] for r in binning.apply_cutoffs(df, v, binning.uppers_of(known, v), "b").collect()] == want
    for bad, why in (([], "no cutoff"), (["(1, 2]", "(3, 4]"], "side by side"), (["(2, 1]"], "side by side"), (["[1, 2)"], "no interval")):
        with pytest.raises(ValueError, match=why):
            binning.uppers_of(spark.createDataFrame([("x", t) for t in bad], "variable string, interval string"), "x")


def test_labels_start_at_the_riskiest_end(spark):
    rows = [(float(k), float(-k), 1.0, int(k * 7 % 100 < k)) for k in range(100)]
    table = woe.woe_table(spark.createDataFrame(rows, "up double, down double, flat double, def int"), ["up", "down", "flat"])
    assert {r["variable"]: r["direction"] for r in woe.label_directions(table).collect()} == {"up": "down", "down": "up"}


def test_declared_categories_without_rows_stay(spark):
    df = spark.createDataFrame([("b", 1), ("b", 0), ("x", 1), (None, 0), ("a", 0)], "c string, def int")
    got = [(r["category"], r["n"], r["n_def"], r["default_rate"]) for r in summaries.default_summary(df, "c", sort_by="category", ascending=True, declared=["b", "none", "a"]).orderBy("row").collect()]
    assert got == [("b", 2, 1, 0.5), ("none", 0, 0, None), ("a", 1, 0, 0.0), ("Total", 3, 1, pytest.approx(1 / 3))]
    got = [r["category"] for r in summaries.default_summary(df, "c", sort_by="default_rate", include_missing=True, declared=["b", "none", "a"]).orderBy("row").collect()]
    assert got == ["b", "Missing", "a", "none", "Total"] or got == ["Missing", "b", "a", "none", "Total"]


def test_short_curves_have_the_same_area(spark):
    rng = np.random.default_rng(9)
    rows = [("a", round(float(v), 2), int(v + rng.normal() > 0)) for v in rng.normal(size=1500)] + [("b", float(k), int(k > 6)) for k in range(12)]
    df = spark.createDataFrame(rows, "g string, s double, def int")
    long = {r["g"]: r["n"] for r in metrics.roc(df, "s", by=["g"]).groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()}
    want = {r["g"]: r["auc"] for r in metrics.metrics(df, "s", by=["g"]).collect()}
    got = {r["g"]: r for r in metrics.area(metrics.short_roc(df, "s", by=["g"]), ["g"]).collect()}
    assert {g: r["auc"] for g, r in got.items()} == {g: pytest.approx(a, abs=1e-12) for g, a in want.items()}
    assert got["a"]["points"] < long["a"]


def test_vingtiles_of_keys_that_repeat_or_are_missing(spark):
    rows = [(k % 3 if k % 5 else None, k // 2, 1.0 if k < 90 else float(k)) for k in range(120)]
    df = spark.createDataFrame(rows, "a int, b int, s double")
    got = binning.vingtiles(df, "s", ["a", "b"]).toPandas()
    assert len(got) == 120 and set(got["score_vingtile"]) <= set(range(1, 21))
    assert (got.groupby(["a", "b", "s"], dropna=False)["score_vingtile"].nunique() == 1).all()
    ordered = got.sort_values(["s", "a", "b"], na_position="first")["score_vingtile"].to_numpy()
    assert (np.diff(ordered) >= 0).all() and np.bincount(ordered)[1:].max() <= 8


def test_selection_is_the_four_rules_in_turn(spark):
    rng = np.random.default_rng(10)
    n = 1200
    x = rng.normal(size=n)
    pdf = pd.DataFrame({"x": x, "x2": x * 2 + rng.normal(size=n) * 0.1, "noise": rng.normal(size=n), "holes": x + rng.normal(size=n), "c": np.where(x > 0, "h", "l"), "c2": np.where(x > 0.1, "h", "l"), "dull": rng.choice(["p", "q"], n)})
    pdf["def"], pdf["year"], pdf["fold"] = (x + rng.normal(size=n) > 0.5).astype(int), rng.integers(2020, 2022, n), rng.integers(0, 4, n)
    df = spark.createDataFrame(pdf).withColumn("def_year", F.concat_ws("_", "def", "year")).withColumn("holes", F.when(F.col("x") < 1.5, F.col("holes")))
    continuous, categorical = ["x", "x2", "noise", "holes"], ["c", "c2", "dull"]
    made = selection.select(df, continuous, categorical, range(4))
    first = [r["variable"] for r in selection.keep_associated(df, continuous, "def_year", range(4)).where("kept").orderBy("place").collect()]
    second = [r["variable"] for r in selection.keep_categorical(df, categorical, "def_year", range(4)).where("kept").orderBy("place").collect()]
    assert first == ["x", "x2", "holes"] and second == ["c", "c2"]
    assert made.continuous == [r["variable"] for r in selection.drop_correlated(df, first, "def", range(4), 0.5).where("kept").orderBy("place").collect()]
    assert made.categorical == [r["variable"] for r in selection.drop_correlated_categorical(df, second, "def_year", range(4), 0.5).where("kept").orderBy("place").collect()]
    assert len(made.continuous) < 3 and len(made.categorical) == 1
    assert {r["variable"]: r["associated"] for r in made.decisions.collect()} == {v: v in first + second for v in continuous + categorical}
    with pytest.raises(ValueError, match="no variables"):
        selection.select(df, [], [], range(4))
