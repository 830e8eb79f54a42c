"""Registered queries on distributions, declared categories, saved cutoffs and short curves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import binning, distributions, metrics, scorecard, selection, summaries, woe
from ..sources import files
from ..sources.loanbook import lines, loan_book
from .catalogue import IDS, LEFT, MODAL, MODEL, modalities, query
from .oracle import BOOK, CHI2, CURVE, KRUSKAL, chi2_sf, stacked

BOXED = ["l_extendedprice", "l_quantity", "emp_like", "rate_like"]


@query("vz8_box_statistics", BOOK + ", x AS (" + stacked("loans", BOXED, "c_mktsegment, ", "DOUBLE") + """),
q AS (SELECT c_mktsegment, variable, count(*) AS n, avg(value) AS mean, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS med, quantile_cont(value, 0.75) AS q3 FROM x WHERE value IS NOT NULL GROUP BY ALL)
SELECT c_mktsegment, variable, n, round(mean, 6) AS mean, round(q1, 6) AS q1, round(med, 6) AS median, round(q3, 6) AS q3,
  round(min(value) FILTER (WHERE value >= q1 - 1.5 * (q3 - q1)), 6) AS low_whisker, round(max(value) FILTER (WHERE value <= q3 + 1.5 * (q3 - q1)), 6) AS high_whisker,
  count(*) FILTER (WHERE value < q1 - 1.5 * (q3 - q1)) AS n_below, count(*) FILTER (WHERE value > q3 + 1.5 * (q3 - q1)) AS n_above
FROM x JOIN q USING (c_mktsegment, variable) WHERE value IS NOT NULL GROUP BY ALL""")
def vz8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distributions.box_statistics(lines(spark, sf_dir), BOXED, ["c_mktsegment"])


@query("vz10_box_statistics_of_all_rows", BOOK + ", x AS (" + stacked("(SELECT *, power(l_extendedprice, 3) / 1e12 AS skewed FROM loans)", ["skewed", "l_tax"], "", "DOUBLE") + """),
q AS (SELECT variable, count(*) AS n, avg(value) AS mean, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS med, quantile_cont(value, 0.75) AS q3 FROM x GROUP BY ALL)
SELECT variable, n, round(mean, 6) AS mean, round(q1, 6) AS q1, round(med, 6) AS median, round(q3, 6) AS q3, round(min(value) FILTER (WHERE value >= q1 - 1.5 * (q3 - q1)), 6) AS low_whisker, round(max(value) FILTER (WHERE value <= q3 + 1.5 * (q3 - q1)), 6) AS high_whisker,
  count(*) FILTER (WHERE value < q1 - 1.5 * (q3 - q1)) AS n_below, count(*) FILTER (WHERE value > q3 + 1.5 * (q3 - q1)) AS n_above FROM x JOIN q USING (variable) GROUP BY ALL""")
def vz10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distributions.box_statistics(lines(spark, sf_dir).withColumn("skewed", F.pow("l_extendedprice", F.lit(3.0)) / 1e12), ["skewed", "l_tax"])


def sql_density(value: str, by: str, points: int) -> str:
    """The direct sum over distinct values, after a table r of rows."""
    keys = f"{by}, " if by else ""
    return f"""
, cnt AS (SELECT {keys}CAST({value} AS DOUBLE) AS s, count(*) AS c FROM loans WHERE {value} IS NOT NULL GROUP BY ALL),
m AS (SELECT {keys}count(*) AS n, stddev_samp({value}) * power(count(*), -0.2) AS w, min({value}) AS lo, max({value}) AS hi FROM loans WHERE {value} IS NOT NULL {f'GROUP BY {by}' if by else ''}),
g AS (SELECT {keys}n, w, lo - 3 * w + k * (hi - lo + 6 * w) / {points - 1} AS x FROM m, range({points}) AS t(k))
SELECT {'g.' + by + ', ' if by else ''}round(x, 4) AS x, round(sum(c * exp(-power((x - s) / w, 2) / 2)) / (any_value(n) * any_value(w) * sqrt(2 * pi())), 5) AS density FROM g JOIN cnt ON {f'g.{by} = cnt.{by}' if by else 'true'} GROUP BY ALL"""


@query("vz8_density_by_category", BOOK + sql_density("l_quantity", "c_mktsegment", 200))
def vz8_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = distributions.density(lines(spark, sf_dir), "l_quantity", ["c_mktsegment"])
    return found.select("c_mktsegment", F.round("x", 4).alias("x"), F.round("density", 5).alias("density"))


@query("vz10_density", BOOK.replace("loans AS (", "loans0 AS (").replace("FROM loans)", "FROM loans0)") + ", loans AS (SELECT l_extendedprice / 1000 AS price FROM loans0)" + sql_density("price", "", 60))
def vz10_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = distributions.density(lines(spark, sf_dir).withColumn("price", F.col("l_extendedprice") / 1000), "price", points=60)
    return found.select(F.round("x", 4).alias("x"), F.round("density", 5).alias("density"))


DECLARED = ["5-LOW", "4-NOT SPECIFIED", "0-NONE", "3-MEDIUM", "2-HIGH", "9-OTHER"]


@query("ag1_declared_categories", BOOK + """
, dom(category, place) AS (VALUES """ + ", ".join(f"('{c}', {k})" for k, c in enumerate([*DECLARED, "Missing"])) + """),
t AS (SELECT CASE WHEN o_orderpriority IN (SELECT category FROM dom) THEN o_orderpriority ELSE 'Missing' END AS category, count(*) AS n, sum(def) AS n_def FROM loans GROUP BY 1),
u AS (SELECT category, place, coalesce(n, 0) AS n, coalesce(n_def, 0) AS n_def FROM dom LEFT JOIN t USING (category))
SELECT row_number() OVER (ORDER BY place) AS row, category, n, round(n / sum(n) OVER (), 6) AS prop, CAST(n_def AS BIGINT) AS n_def, round(n_def / nullif(n, 0), 6) AS default_rate FROM u
UNION ALL SELECT 8, 'Total', sum(n), 1.0, CAST(sum(n_def) AS BIGINT), round(sum(n_def) / sum(n), 6) FROM u""")
def ag1_declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.default_summary(lines(spark, sf_dir), "o_orderpriority", sort_by="category", ascending=True, include_missing=True, declared=DECLARED)


INTERVALS = [("l_discount", "(-inf, 0.02]"), ("l_discount", "(0.05, inf]"), ("l_discount", "(0.02, 0.05]"), ("l_quantity", "(0.5, 17.0]"), ("l_quantity", "(17.0, 33.0]"), ("l_quantity", "(33.0, 49.5]")]


@query("bn5_cutoffs_from_saved_intervals", BOOK + """
SELECT CASE WHEN l_discount <= 0.02 THEN 1 WHEN l_discount <= 0.05 THEN 2 ELSE 3 END AS discount_bin, CASE WHEN l_quantity <= 17 THEN 'c' WHEN l_quantity <= 33 THEN 'b' ELSE 'a' END AS quantity_bin, count(*) AS n, CAST(sum(def) AS BIGINT) AS n_def FROM loans GROUP BY ALL""")
def bn5_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cutoffs as text in CSV, and as intervals in Parquet, read back and applied."""
    as_text, as_ends = files.scratch(spark, "intervals"), files.scratch(spark, "intervals")
    files.write_csv(spark.createDataFrame(INTERVALS, "variable string, interval string"), as_text)
    text = spark.read.schema("variable string, interval string").option("header", True).csv(as_text)
    text.select("variable", binning.interval(F.col("interval")).alias("interval")).write.parquet(as_ends)
    out = binning.apply_cutoffs(lines(spark, sf_dir), "l_discount", binning.uppers_of(text, "l_discount"), "discount_bin")
    out = binning.apply_cutoffs(out, "l_quantity", binning.uppers_of(spark.read.parquet(as_ends), "l_quantity"), "quantity_bin", ["c", "b", "a"])
    return out.groupBy("discount_bin", "quantity_bin").agg(*summaries.counted("def"))


SLOPED = ["l_discount", "l_extendedprice", "l_quantity", "q_left"]


@query("t7_label_directions", BOOK + ", r AS (SELECT *, 51 - l_quantity AS q_left FROM loans), e AS (SELECT " + ", ".join(f"list_sort(list_distinct(quantile_cont({v}, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS q_{v}" for v in SLOPED) + " FROM r), g AS (" + " UNION ALL ".join(
    f"SELECT '{v}' AS variable, greatest(len(list_filter(q_{v}, lambda x: x < {v})), 1) AS k, def FROM r, e" for v in SLOPED) + """)
SELECT variable, round(regr_slope(def, k), 6) AS slope, CASE WHEN regr_slope(def, k) > 0 THEN 'down' ELSE 'up' END AS direction FROM g GROUP BY 1""")
def t7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return woe.label_directions(woe.woe_table(lines(spark, sf_dir).withColumn("q_left", 51 - F.col("l_quantity")), SLOPED))


@query("lm17_area_of_short_roc", MODAL.replace("scored AS", "scored0 AS") + ", scored AS (SELECT *, round(margin, 9) AS s FROM scored0)" + CURVE + """
SELECT dataset, round(sum((n - e) * (tp - e / 2.0)) / (any_value(pos) * any_value(neg)), 6) AS auc FROM cur GROUP BY dataset""")
def lm17_roc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = scorecard.probability(modalities(spark, sf_dir), MODEL, "p").withColumn("p", F.round("p", 9))
    return metrics.area(metrics.short_roc(rated, "p", by=["dataset"]), ["dataset"]).drop("points")


@query("me3_area_of_short_roc_of_many_scores", BOOK + ", scored AS (SELECT *, l_extendedprice AS s FROM book)" + CURVE + """
SELECT dataset, round(sum((n - e) * (tp - e / 2.0)) / (any_value(pos) * any_value(neg)), 6) AS auc FROM cur GROUP BY dataset""")
def me3_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.area(metrics.short_roc(loan_book(spark, sf_dir, ["l_extendedprice"]), "l_extendedprice", by=["dataset"]), ["dataset"]).drop("points")


SELECTED, SELECTED_TEXT = ["l_quantity", "q_noise", "l_tax", "q_tax", "key_noise"], ["o_orderpriority", "c_mktsegment", "l_linestatus", "p3", "o_orderstatus"]


def sql_keyed(prefix: str, columns: list[str], level: str, kind: str) -> str:
    return " UNION ALL ".join(f"SELECT '{prefix}/{c}/' || i AS key, CAST({c} AS {kind}) AS value, CAST({level} AS VARCHAR) AS level FROM mix" for c in columns)


@query("vs_selection_chain", BOOK + LEFT + """
, mix AS (SELECT *, def || '_' || year AS dy, l_quantity * 2 + u % 7 AS q_noise, l_quantity + l_tax * 50 AS q_tax, k3 % 97 AS key_noise, CASE o_orderpriority WHEN '1-URGENT' THEN 'u' WHEN '5-LOW' THEN 'l' ELSE 'm' END AS p3 FROM parts),
obs AS (""" + sql_keyed("y", SELECTED, "dy", "DOUBLE") + " UNION ALL " + sql_keyed("d", SELECTED, "def", "DOUBLE") + ")" + KRUSKAL + """
, kp AS (SELECT key, """ + chi2_sf("h", "df") + """ AS p FROM kw),
k1 AS (SELECT split_part(key, '/', 2) AS variable, max(p) < 0.05 AS associated FROM kp WHERE key LIKE 'y/%' GROUP BY 1),
rk AS (SELECT i, """ + ", ".join(f"rank() OVER (PARTITION BY i ORDER BY {v}) + (count(*) OVER (PARTITION BY i, {v}) - 1) / 2.0 AS {v}" for v in SELECTED) + """ FROM mix),
pr AS (""" + " UNION ALL ".join(f"SELECT i, '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM rk GROUP BY i" for k, a in enumerate(SELECTED) for b in SELECTED[k + 1:]) + """),
gone AS (SELECT CASE WHEN kb.p > ka.p THEN b ELSE a END AS v FROM pr JOIN kp ka ON ka.key = 'd/' || a || '/' || i JOIN kp kb ON kb.key = 'd/' || b || '/' || i
  WHERE abs(r) >= 0.5 AND a IN (SELECT variable FROM k1 WHERE associated) AND b IN (SELECT variable FROM k1 WHERE associated)),
obs2 AS (""" + sql_keyed("y", SELECTED_TEXT, "dy", "VARCHAR") + " UNION ALL " + " UNION ALL ".join(sql_keyed(f"p/{b}", [a], b, "VARCHAR") for k, a in enumerate(SELECTED_TEXT) for b in SELECTED_TEXT[k + 1:]) + ")" + CHI2.replace("obs", "obs2") + """
, k2 AS (SELECT split_part(key, '/', 2) AS variable, min(vc) >= 0.1 AS associated, avg(vc) AS v FROM vs WHERE key LIKE 'y/%' GROUP BY 1),
p2 AS (SELECT split_part(key, '/', 3) AS a, split_part(key, '/', 2) AS b FROM vs WHERE key LIKE 'p/%' GROUP BY ALL HAVING max(vc) >= 0.5),
gone2 AS (SELECT CASE WHEN kb.v < ka.v THEN b ELSE a END AS v FROM p2 JOIN k2 ka ON ka.variable = a AND ka.associated JOIN k2 kb ON kb.variable = b AND kb.associated)
SELECT 'continuous' AS kind, variable, associated, associated AND variable NOT IN (SELECT v FROM gone) AS kept FROM k1
UNION ALL SELECT 'categorical', variable, associated, associated AND variable NOT IN (SELECT v FROM gone2) FROM k2""")
def vs_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    p3 = F.coalesce(scalar.mapped(F.col("o_orderpriority"), {"1-URGENT": "u", "5-LOW": "l"}), F.lit("m"))
    book = loan_book(spark, sf_dir, ["k3", "l_quantity", "l_tax", "o_orderpriority", "c_mktsegment", "l_linestatus", "o_orderstatus"]).withColumns({"def_year": F.concat_ws("_", "def", "year"), "q_noise": F.col("l_quantity") * 2 + F.col("u") % 7, "q_tax": F.col("l_quantity") + F.col("l_tax") * 50, "key_noise": F.col("k3") % 97, "p3": p3})
    return selection.select(book, SELECTED, SELECTED_TEXT, IDS).decisions.drop("place")
