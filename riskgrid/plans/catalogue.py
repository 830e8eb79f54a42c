"""The registered queries: each operator on the loan book, with the SQL it is held against."""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import association, binning, folds, logit, metrics, preparation, scorecard, selection, stability, summaries, woe
from ..sources import files
from ..sources.loanbook import CATEGORICAL, CONTINUOUS, FOLDS, KEYS, lines, loan_book
from .oracle import BOOK, CHI2, CURVE, KRUSKAL, SCORED, psi, stacked
from .oracle import chi2_sf as sql_chi2_sf
from .oracle import log10p as sql_log10p
from .scorecard_pipeline import scorecard_of

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
DIGITS = 6


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles rounded, counts as longs, so that both engines print alike."""
    kinds = {"double": lambda c: F.round(c, digits), "int": lambda c: c.cast("long")}
    return df.select(*[kinds[kind](F.col(f"`{c}`")).alias(c) if kind in kinds else F.col(f"`{c}`") for c, kind in df.dtypes])


def query(name: str, sql: str | None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return f

    return put


def log10p(column: str = "p_value") -> Column:
    return F.round(F.log10(F.greatest(F.col(column), F.lit(1e-280))), 4)


# --- summaries and tables ---------------------------------------------------------------------------------------

SUMMARY = """
, t AS (SELECT o_orderpriority AS category, count(*) AS n, sum(def) AS n_def FROM loans GROUP BY 1),
u AS (SELECT *, n / sum(n) OVER () AS prop, n_def / n AS default_rate FROM t)
SELECT row_number() OVER (ORDER BY {key} {way}, category) AS row, category, CAST(n AS BIGINT) AS n, round(prop, 6) AS prop, CAST(n_def AS BIGINT) AS n_def, round(default_rate, 6) AS default_rate FROM u
UNION ALL SELECT 1 + (SELECT count(*) FROM t), 'Total', count(*), 1.0, CAST(sum(def) AS BIGINT), round(avg(def), 6) FROM loans
"""
for sort_key, sql_key, rising in (("count", "n", False), ("defaults", "n_def", False), ("prop", "prop", True), ("default_rate", "default_rate", True), ("category", "category", True)):
    query(f"ag1_default_summary_by_{sort_key}", BOOK + SUMMARY.format(key=sql_key, way="ASC" if rising else "DESC"))(
        lambda spark, sf_dir, sort_key=sort_key, rising=rising: summaries.default_summary(lines(spark, sf_dir), "o_orderpriority", sort_by=sort_key, ascending=rising)
    )


@query("ag1_default_summary_with_missing", BOOK + """
, x AS (SELECT CASE WHEN emp_like IS NULL THEN 'Missing' WHEN emp_like > 25 THEN 'long' ELSE 'short' END AS category, def FROM loans),
t AS (SELECT category, count(*) AS n, sum(def) AS n_def FROM x GROUP BY 1)
SELECT row_number() OVER (ORDER BY n DESC, category) AS row, category, n, round(n / sum(n) OVER (), 6) AS prop, CAST(n_def AS BIGINT) AS n_def, round(n_def / n, 6) AS default_rate FROM t
UNION ALL SELECT 4, 'Total', count(*), 1.0, CAST(sum(def) AS BIGINT), round(avg(def), 6) FROM x""")
def ag1_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = lines(spark, sf_dir).withColumn("tenure", F.when(F.col("emp_like") > 25, "long").when(F.col("emp_like").isNotNull(), "short"))
    return summaries.default_summary(book, "tenure", include_missing=True)


@query("ag2_distribution_summary", BOOK + """
SELECT coalesce(dataset, 'Total') AS dataset, count(*) AS n, CAST(sum(def) AS BIGINT) AS n_def, round(avg(def), 6) AS default_rate FROM book GROUP BY ROLLUP (dataset)""")
def ag2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.distribution_summary(loan_book(spark, sf_dir, []))


@query("ag3_defaults_per_year", BOOK + "SELECT year, count(*) AS n, CAST(sum(def) AS BIGINT) AS n_def, round(avg(def), 6) AS default_rate FROM loans GROUP BY year")
def ag3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.rates(lines(spark, sf_dir), ["year"])


@query("ag4_missing_table", BOOK + """
, x AS (SELECT count(*) AS n, count(*) - count(emp_like) AS emp_like, count(*) - count(rate_like) AS rate_like, count(*) - count(l_tax) AS l_tax FROM loans)
SELECT 'emp_like' AS variable, emp_like AS n_missing, round(emp_like / n, 6) AS share FROM x UNION ALL SELECT 'rate_like', rate_like, round(rate_like / n, 6) FROM x UNION ALL SELECT 'l_tax', l_tax, round(l_tax / n, 6) FROM x""")
def ag4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.missing_table(lines(spark, sf_dir), ["emp_like", "rate_like", "l_tax"])


for keep in (False, True):
    query(f"ag5_value_shares{'_with_missing' if keep else ''}", BOOK + f"""
SELECT CAST(CAST(emp_like AS BIGINT) AS VARCHAR) AS value, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM loans {'' if keep else 'WHERE emp_like IS NOT NULL'} GROUP BY 1""")(
        lambda spark, sf_dir, keep=keep: summaries.value_shares(lines(spark, sf_dir).withColumn("emp_like", F.col("emp_like").cast("long")), "emp_like", keep)
    )


@query("ag6_rate_by_year_and_segment", BOOK + "SELECT year, c_mktsegment, count(*) AS n, CAST(sum(def) AS BIGINT) AS n_def, round(100 * avg(def), 6) AS default_rate FROM loans GROUP BY 1, 2")
def ag6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.rates(lines(spark, sf_dir), ["year", "c_mktsegment"], scale=100)


@query("ag8_contingency", BOOK + "SELECT o_orderpriority AS a, CAST(def AS VARCHAR) AS b, count(*) AS n FROM loans GROUP BY 1, 2")
def ag8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.contingency(lines(spark, sf_dir), "o_orderpriority", "def")


for kind, over in (("index", "PARTITION BY a"), ("columns", "PARTITION BY b"), ("all", "")):
    query(f"ag8_contingency_share_{kind}", BOOK + f", x AS (SELECT o_orderpriority AS a, CAST(def AS VARCHAR) AS b, count(*) AS n FROM loans GROUP BY 1, 2) SELECT a, b, n, round(n / sum(n) OVER ({over}), 6) AS value FROM x")(
        lambda spark, sf_dir, kind=kind: summaries.contingency(lines(spark, sf_dir), "o_orderpriority", "def", normalize=kind)
    )


@query("ag8_contingency_margins", BOOK + "SELECT coalesce(c_mktsegment, 'All') AS a, coalesce(CAST(def AS VARCHAR), 'All') AS b, count(*) AS n FROM loans GROUP BY CUBE (c_mktsegment, def)")
def ag8_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.contingency_margins(lines(spark, sf_dir), "c_mktsegment", "def")


@query("ag9_rare_level_variables", BOOK + f"""
, x AS ({stacked('loans', CATEGORICAL, '', 'VARCHAR')}), c AS (SELECT variable, value, count(*) AS n FROM x GROUP BY 1, 2), s AS (SELECT variable, n / sum(n) OVER (PARTITION BY variable) AS share FROM c)
SELECT variable, count(*) AS n_levels, round(min(share), 6) AS least_share FROM s GROUP BY variable HAVING min(share) <= 0.2""")
def ag9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.rare_level_variables(lines(spark, sf_dir), [*CATEGORICAL, "unknown"], 0.2)


@query("ag10_relative_gaps", BOOK + """
, x AS (SELECT o_orderpriority AS category, avg(def) AS r FROM loans GROUP BY 1)
SELECT category, round(r, 6) AS default_rate, round(coalesce((r / lag(r) OVER (ORDER BY r, category) - 1) * 100, 0), 6) AS gap FROM x""")
def ag10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.relative_gaps(lines(spark, sf_dir), "o_orderpriority")


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("ag11_rate_matrix", BOOK + "SELECT year, " + ", ".join(f"round(avg(def) FILTER (WHERE c_mktsegment = '{s}'), 6) AS \"{s}\"" for s in SEGMENTS) + " FROM loans GROUP BY year")
def ag11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.rate_matrix(lines(spark, sf_dir), "year", "c_mktsegment", SEGMENTS)


@query("ag12_describe", BOOK + f"""
, x AS ({stacked('book', [*CONTINUOUS, 'emp_like'], 'dataset, ', 'DOUBLE')})
SELECT dataset, variable, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round(min(value), 6) AS min, round(quantile_cont(value, 0.25), 6) AS q1,
  round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q3, round(max(value), 6) AS max FROM x GROUP BY 1, 2""")
def ag12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.describe(loan_book(spark, sf_dir, [*CONTINUOUS, "emp_like"]), [*CONTINUOUS, "emp_like"], ["dataset"])


def fixed_score(spark: SparkSession, sf_dir: str, columns: Sequence[str] = ()) -> DataFrame:
    """The loan book's score s and dataset, with these columns of lines()."""
    return loan_book(spark, sf_dir, [*columns, "l_quantity", "l_discount"]).withColumn("s", (6 * F.col("l_quantity") + 1500 * F.col("l_discount")) / 500)


@query("ag13_scored_profile", SCORED + "SELECT dataset, count(*) AS n, round(min(s), 6) AS min_score, round(avg(s), 6) AS mean_score, round(max(s), 6) AS max_score, round(avg(def), 6) AS default_rate FROM scored GROUP BY 1")
def ag13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.scored_profile(fixed_score(spark, sf_dir), "s")


@query("wn8_ecdf", BOOK + "SELECT CAST(def AS BIGINT) AS def, CAST(l_quantity AS DOUBLE) AS value, count(*) AS n, round(sum(count(*)) OVER (PARTITION BY def ORDER BY l_quantity) / sum(count(*)) OVER (PARTITION BY def), 6) AS share FROM loans GROUP BY def, l_quantity")
def wn8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.ecdf(lines(spark, sf_dir), "l_quantity", ["def"])


@query("vz11_histogram", BOOK + """
, e AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM loans), b AS (SELECT least(CAST(floor((c_acctbal - lo) / ((hi - lo) / 30)) AS BIGINT), 29) AS bin, lo, hi FROM loans, e)
SELECT bin, round(any_value(lo + bin * ((hi - lo) / 30)), 6) AS low, round(any_value(lo + (bin + 1) * ((hi - lo) / 30)), 6) AS high, count(*) AS n FROM b GROUP BY bin""")
def vz11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.histogram(lines(spark, sf_dir), "c_acctbal")


@query("pr_scalars", BOOK + """
SELECT k1, k2, k3, k4, round(k5, 6) AS k5, CAST(CASE WHEN year < 1996 THEN 1996 ELSE year END AS BIGINT) AS year_floor, round(CASE WHEN emp_like < 5 THEN 5 WHEN emp_like > 40 THEN 40 ELSE emp_like END, 6) AS clipped,
  concat_ws('_', def, year) AS def_year, CAST(emp_like IS NULL AS BIGINT) AS emp_missing, round(coalesce(emp_like, 0), 6) AS filled,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'B' WHEN 'MACHINERY' THEN 'M' END AS mapped, CASE c_mktsegment WHEN 'BUILDING' THEN 'B' WHEN 'MACHINERY' THEN 'M' ELSE c_mktsegment END AS relabelled,
  coalesce(CAST(CAST(rate_like * 100 AS BIGINT) AS VARCHAR), 'nan') AS modality, round(greatest(l_discount, 0.03), 6) AS floored, round(1 / (1 + exp(-(l_quantity - 25) / 10)), 6) AS squashed,
  CASE WHEN l_discount < 0.1 THEN 'Stable' WHEN l_discount < 0.25 THEN 'Light drift' ELSE 'Strong drift' END AS class
FROM loans""")
def pr(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    short = {"BUILDING": "B", "MACHINERY": "M"}
    return lines(spark, sf_dir).select(
        *KEYS,
        scalar.clip(c("year"), 1996).alias("year_floor"),
        scalar.clip(c("emp_like"), 5, 40).cast("double").alias("clipped"),
        F.concat_ws("_", "def", "year").alias("def_year"),
        scalar.missing_flag(c("emp_like")).alias("emp_missing"),
        F.coalesce(c("emp_like").cast("double"), F.lit(0.0)).alias("filled"),
        scalar.mapped(c("c_mktsegment"), short).alias("mapped"),
        scalar.mapped_or_self(c("c_mktsegment"), short).alias("relabelled"),
        scalar.as_modality(F.round(c("rate_like") * 100).cast("long")).alias("modality"),
        F.greatest(c("l_discount"), F.lit(0.03)).alias("floored"),
        scalar.sigmoid((c("l_quantity") - 25) / 10).alias("squashed"),
        scalar.class_of(c("l_discount"), scalar.PSI_CLASSES).alias("class"),
    )


# --- bins and preparation ---------------------------------------------------------------------------------------

BINNED = "SELECT CAST({bin} AS {kind}) AS bin, count(*) AS n, round(min({v}), 6) AS low, round(max({v}), 6) AS high, round(avg(def), 6) AS default_rate FROM loans, e GROUP BY 1"


def bin_rows(df: DataFrame, variable: str) -> DataFrame:
    return df.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.min(variable).cast("double").alias("low"), F.max(variable).cast("double").alias("high"), F.avg(F.col("def").cast("double")).alias("default_rate"))


def case_edges(v: str, k: int) -> str:
    return "CASE " + " ".join(f"WHEN {v} <= q[{j + 1}] THEN {j}" for j in range(1, k + 1)) + " END"


@query("bn1_quartile_bins", BOOK + ", e AS (SELECT quantile_cont(l_quantity, [0.0, 0.25, 0.5, 0.75, 1.0]) AS q FROM loans) " + BINNED.format(
    bin="CASE " + " ".join(f"WHEN l_quantity <= q[{j + 1}] THEN printf(']%.2f ; %.2f]', q[{j}] - {'1e-9' if j == 1 else '0'}, q[{j + 1}])" for j in range(1, 5)) + " END", kind="VARCHAR", v="l_quantity"))
def bn1(spark: SparkSession, sf_dir: str) -> DataFrame:
    # whole quantities: at exact halves of the last digit the two engines print differently
    return bin_rows(binning.quartile_bins(lines(spark, sf_dir), "l_quantity", "bin"), "l_quantity")


@query("bn2_quantile_bins", BOOK + ", e AS (SELECT quantile_cont(c_acctbal, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS q FROM loans) " + BINNED.format(bin=case_edges("c_acctbal", 5), kind="BIGINT", v="c_acctbal"))
def bn2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bin_rows(binning.quantile_bins(lines(spark, sf_dir), "c_acctbal", 5, "bin"), "c_acctbal")


@query("bn3_quantile_bins_dropping_equal_edges", BOOK + """
, e AS (SELECT list_sort(list_distinct(quantile_cont(l_tax, [""" + ", ".join(str(k / 20) for k in range(21)) + """]))) AS q FROM loans) """ + BINNED.format(bin="greatest(len(list_filter(q, lambda x: x < l_tax)), 1)", kind="BIGINT", v="l_tax"))
def bn3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bin_rows(binning.quantile_bins(lines(spark, sf_dir), "l_tax", 20, "bin", duplicates="drop"), "l_tax")


@query("bn4_equal_width_bins", BOOK + ", e AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM loans) " + BINNED.format(bin="CASE " + " ".join(f"WHEN c_acctbal <= lo + (hi - lo) / 6 * {k} THEN {k}" for k in range(1, 6)) + " ELSE 6 END", kind="BIGINT", v="c_acctbal"))
def bn4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bin_rows(binning.equal_width_bins(lines(spark, sf_dir), "c_acctbal", 6, "bin"), "c_acctbal")


@query("bn5_apply_cutoffs", BOOK + ", e AS (SELECT 1) " + BINNED.format(bin="CASE WHEN l_discount <= 0.02 THEN 'a' WHEN l_discount <= 0.05 THEN 'b' ELSE 'c' END", kind="VARCHAR", v="l_discount"))
def bn5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bin_rows(binning.apply_cutoffs(lines(spark, sf_dir), "l_discount", [0.02, 0.05, 0.1], "bin", ["a", "b", "c"]), "l_discount")


VINGTILE = """
, rk AS (SELECT *, row_number() OVER (ORDER BY {score}, k1, k2, k3, k4, k5) AS rk FROM {rows} WHERE {score} IS NOT NULL),
cnt AS (SELECT count(*) AS n FROM rk),
edge AS (SELECT list_transform(range(1, 21), lambda k: 1 + floor(CAST(k AS DOUBLE) / 20 * (n - 1)) + (CAST(k AS DOUBLE) / 20 * (n - 1) - floor(CAST(k AS DOUBLE) / 20 * (n - 1)))) AS ed FROM cnt),
ving AS (SELECT rk.*, 1 + len(list_filter(ed, lambda x: x < rk)) AS score_vingtile FROM rk, edge)
"""


@query("bn6_vingtiles", SCORED + VINGTILE.format(score="s", rows="scored") + "SELECT k1, k2, k3, k4, round(k5, 6) AS k5, score_vingtile FROM ving")
def bn6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binning.vingtiles(fixed_score(spark, sf_dir, KEYS), "s", KEYS).select(*KEYS, "score_vingtile")


@query("dp1_bounds_table", BOOK + f", x AS ({stacked('loans', CONTINUOUS, '', 'DOUBLE')}) SELECT variable, round(quantile_cont(value, 0.01), 6) AS lower, round(quantile_cont(value, 0.99), 6) AS upper FROM x GROUP BY 1")
def dp1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preparation.bounds_table(lines(spark, sf_dir), CONTINUOUS)


@query("dp2_winsorize", BOOK + """
, q AS (SELECT quantile_cont(emp_like, 0.25) AS a, quantile_cont(emp_like, 0.75) AS b, quantile_cont(k5, 0.25) AS c, quantile_cont(k5, 0.75) AS d FROM book WHERE dataset = 'Train' AND l_quantity BETWEEN 10 AND 20),
w AS (SELECT book.*, CASE WHEN emp_like < a - 1.5 * (b - a) THEN a - 1.5 * (b - a) WHEN emp_like > b + 1.5 * (b - a) THEN b + 1.5 * (b - a) ELSE emp_like END AS e2,
  CASE WHEN k5 < c - 1.5 * (d - c) THEN c - 1.5 * (d - c) WHEN k5 > d + 1.5 * (d - c) THEN d + 1.5 * (d - c) ELSE k5 END AS p2 FROM book, q)
SELECT k1, k2, k3, k4, round(k5, 6) AS k5, round(e2, 6) AS emp_like, round(p2, 6) AS l_extendedprice FROM w""")
def dp2(spark: SparkSession, sf_dir: str) -> DataFrame:
    # bounds from a narrow part of the training sample, so that many rows are clipped
    book = loan_book(spark, sf_dir, [*KEYS, "emp_like", "l_extendedprice", "l_quantity"]).withColumn("part", F.when((F.col("dataset") == "Train") & F.col("l_quantity").between(10, 20), "Train").otherwise("rest"))
    return preparation.winsorize(book.withColumn("emp_like", F.col("emp_like").cast("double")), ["emp_like", "l_extendedprice"], "part").select(*KEYS, "emp_like", "l_extendedprice")


@query("dp3_impute", BOOK + """
, q AS (SELECT quantile_cont(rate_like, 0.5) AS m FROM book WHERE dataset = 'Train')
SELECT k1, k2, k3, k4, round(k5, 6) AS k5, CAST(emp_like IS NULL AS BIGINT) AS emp_like_missing, CAST(rate_like IS NULL AS BIGINT) AS rate_like_missing, round(coalesce(emp_like, 0), 6) AS emp_like, round(coalesce(rate_like, m), 6) AS rate_like FROM book, q""")
def dp3(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = loan_book(spark, sf_dir, [*KEYS, "emp_like", "rate_like"]).withColumn("emp_like", F.col("emp_like").cast("double"))
    return preparation.impute(book, {"emp_like": 0.0}, ["rate_like"]).select(*KEYS, "emp_like_missing", "rate_like_missing", "emp_like", "rate_like")


@query("dp4_missing_flags", BOOK + "SELECT k1, k2, k3, k4, round(k5, 6) AS k5, CAST(emp_like IS NULL AS BIGINT) AS emp_like_missing, CAST(rate_like IS NULL AS BIGINT) AS rate_like_missing FROM book")
def dp4(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = preparation.missing_flags(loan_book(spark, sf_dir))
    return out.select(*KEYS, *[c for c in out.columns if c.endswith("_missing")])


for how, variable, bins, sql in (
    ("quantile", "c_acctbal", 5, ", e AS (SELECT quantile_cont(c_acctbal, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS q FROM loans), b AS (SELECT *, " + case_edges("c_acctbal", 5) + " AS bin FROM loans, e)"),
    ("distinct", "l_tax", 20, ", e AS (SELECT list_sort(list_distinct(quantile_cont(l_tax, [" + ", ".join(str(k / 20) for k in range(21)) + "]))) AS q FROM loans), b AS (SELECT *, greatest(len(list_filter(q, lambda x: x < l_tax)), 1) AS bin FROM loans, e)"),
    ("width", "c_acctbal", 6, ", e AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM loans), b AS (SELECT *, CASE " + " ".join(f"WHEN c_acctbal <= lo + (hi - lo) / 6 * {k} THEN {k}" for k in range(1, 6)) + " ELSE 6 END AS bin FROM loans, e)"),
):
    query(f"vz_rates_by_{how}_bin", BOOK + sql + " SELECT CAST(year AS BIGINT) AS year, CAST(bin AS BIGINT) AS bin, count(*) AS n, round(100 * avg(def), 6) AS default_rate FROM b GROUP BY 1, 2")(
        lambda spark, sf_dir, how=how, variable=variable, bins=bins: binning.binned_rates(lines(spark, sf_dir), variable, bins, how, by=["year"])
    )


@query("pr1_period_chain", """
WITH raw AS (SELECT c_custkey AS k, CAST(1 + c_custkey % 15 AS BIGINT) AS history, CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS status, c_mktsegment FROM customer),
p AS (SELECT *, CASE WHEN 2024 - history < 2013 THEN 2013 ELSE 2024 - history END AS year FROM raw)
SELECT k, year, CAST(status AS BIGINT) AS def, CASE WHEN year <= 2021 THEN 'train' ELSE 'oot' END AS part FROM p WHERE year <= 2022""")
def pr1(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    raw = customers.select(F.col("c_custkey").alias("k"), (1 + F.col("c_custkey") % 15).cast("int").alias("cb_person_cred_hist_length"), (F.col("c_acctbal") < 0).alias("loan_status"))
    train, oot = files.cut_by_year(files.derive_period(raw), 2021, 2022)
    return train.withColumn("part", F.lit("train")).unionByName(oot.withColumn("part", F.lit("oot"))).select("k", "year", "def", "part")


@query("io8_folds_written_and_read", BOOK + "SELECT CAST(f AS BIGINT) AS fold, count(*) FILTER (WHERE fold <> f) AS n_train, CAST(sum(def) FILTER (WHERE fold <> f) AS BIGINT) AS d_train, count(*) FILTER (WHERE fold = f) AS n_valid, CAST(sum(def) FILTER (WHERE fold = f) AS BIGINT) AS d_valid FROM book, range(4) AS t(f) GROUP BY f")
def io8(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = files.scratch(spark, "folds")
    files.save_folds(loan_book(spark, sf_dir, []).select("def", "fold"), folder)
    out = []
    for i, (train, valid) in files.load_folds(spark, folder).items():
        sides = [side.agg(F.count(F.lit(1)).alias(f"n_{name}"), F.sum("def").alias(f"d_{name}")) for side, name in ((train, "train"), (valid, "valid"))]
        out.append(sides[0].crossJoin(sides[1]).withColumn("fold", F.lit(i)))  # one row each
    return functools.reduce(DataFrame.unionByName, out)


@query("io1_csv_written_and_read", "SELECT c_custkey, c_name, round(c_acctbal, 6) AS c_acctbal, c_mktsegment FROM customer")
def io1(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = files.scratch(spark, "csv")
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    files.write_csv(customers, folder)
    return files.read_csv(spark, folder, customers.schema)


# --- association and stability ----------------------------------------------------------------------------------

NUMERIC = ["l_quantity", "l_discount", "c_acctbal"]


def obs(rows: str, columns: list[str], level: str, kind: str) -> str:
    return ", obs AS (" + " UNION ALL ".join(f"SELECT '{c}' AS key, CAST({c} AS {kind}) AS value, CAST({level} AS VARCHAR) AS level FROM {rows} WHERE {c} IS NOT NULL" for c in columns) + ")"


@query("sa1_kruskal_wallis", BOOK + obs("loans", [*NUMERIC, "emp_like"], "def", "DOUBLE") + KRUSKAL + f"SELECT key AS variable, round(h, 6) AS h, df, {sql_log10p('h', 'df')} AS log10_p FROM kw")
def sa1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return association.kruskal(lines(spark, sf_dir), [*NUMERIC, "emp_like"], "def").select("variable", "h", "df", log10p().alias("log10_p"))


@query("sa1_kruskal_wallis_many_levels", BOOK + obs("loans", NUMERIC, "year", "DOUBLE") + KRUSKAL + f"SELECT key AS variable, round(h, 6) AS h, df, {sql_log10p('h', 'df')} AS log10_p FROM kw")
def sa1_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return association.kruskal(lines(spark, sf_dir), NUMERIC, "year").select("variable", "h", "df", log10p().alias("log10_p"))


@query("sa4_cramers_v_with_target", BOOK + obs("loans", CATEGORICAL, "def", "VARCHAR") + CHI2 + f"SELECT key AS variable, CAST(n AS BIGINT) AS n, round(chi2, 6) AS chi2, dof, {sql_log10p('chi2', 'dof')} AS log10_p, round(v, 6) AS v FROM vs")
def sa4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return association.cramers_v_with_target(lines(spark, sf_dir), CATEGORICAL, "def").select("variable", "n", "chi2", "dof", log10p().alias("log10_p"), "v")


@query("sa6_cramers_v_corrected", BOOK + obs("loans", CATEGORICAL, "def", "VARCHAR") + CHI2 + "SELECT key AS variable, round(vc, 6) AS v FROM vs")
def sa6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return association.cramers_v_with_target(lines(spark, sf_dir), CATEGORICAL, "def", corrected=True).select("variable", "v")


PAIRS = ", obs AS (" + " UNION ALL ".join(f"SELECT '{a}/{b}' AS key, {a} AS value, {b} AS level FROM loans" for a in CATEGORICAL for b in CATEGORICAL) + ")"
for corrected in (False, True):
    query(f"sa5_cramers_v_matrix{'_corrected' if corrected else ''}", BOOK + PAIRS + CHI2 + f"SELECT split_part(key, '/', 1) AS a, split_part(key, '/', 2) AS b, round({'vc' if corrected else 'v'} * 100, 6) AS v FROM vs")(
        lambda spark, sf_dir, corrected=corrected: association.cramers_v_matrix(lines(spark, sf_dir), CATEGORICAL, corrected, percent=True)
    )

CORR = "SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM r"
CORRS = " UNION ALL ".join(CORR.format(a=a, b=b) for i, a in enumerate(NUMERIC) for b in NUMERIC[i:])


@query("sa7_pearson", BOOK + ", r AS (SELECT * FROM loans) " + CORRS)
def sa7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return association.correlation_matrix(lines(spark, sf_dir), NUMERIC)


@query("sa7_spearman", BOOK + ", r AS (SELECT " + ", ".join(f"rank() OVER (ORDER BY {v}) + (count(*) OVER (PARTITION BY {v}) - 1) / 2.0 AS {v}" for v in NUMERIC) + " FROM loans) " + CORRS)
def sa7_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return association.correlation_matrix(lines(spark, sf_dir), NUMERIC, "spearman")


@query("sa8_contingency_test", BOOK + ", obs AS (SELECT 'x' AS key, c_mktsegment AS value, CAST(def AS VARCHAR) AS level FROM loans)" + CHI2 + f"SELECT CAST(n AS BIGINT) AS n, r AS rows, k AS columns, round(chi2, 6) AS chi2, dof, {sql_log10p('chi2', 'dof')} AS log10_p, round(v, 6) AS v, CASE WHEN v < 0.1 THEN 'very weak' WHEN v < 0.2 THEN 'weak' WHEN v < 0.3 THEN 'moderate' ELSE 'strong' END AS reading FROM vs")
def sa8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return association.contingency_test(lines(spark, sf_dir), "c_mktsegment", "def").select("n", "rows", "columns", "chi2", "dof", log10p().alias("log10_p"), "v", "reading")


@query("sa8_contingency_analysis_table", BOOK + """
, x AS (SELECT c_mktsegment AS a, l_linestatus AS b, count(*) AS n FROM loans GROUP BY 1, 2)
SELECT a, b, n, round(round_even(n / sum(n) OVER (PARTITION BY a), 3) * 100, 6) AS value FROM x""")
def sa8_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return association.contingency_analysis(lines(spark, sf_dir), "c_mktsegment", "l_linestatus")[1]


@query("sa10_baseline_f1", BOOK + "SELECT round(2 * avg(def) / (avg(def) + 1), 6) AS f1 FROM loans")
def sa10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return association.baseline_f1(lines(spark, sf_dir))


YEARS = stability.pairs_of(range(1995, 2002))
SAMPLES = [("Train", "Test"), ("Train", "OOT"), ("Test", "OOT")]


@query("ps6_psi_by_year", BOOK + psi(YEARS, ["l_extendedprice", "l_tax"], ["c_mktsegment"], "year", 10) + """
, r AS (SELECT *, round_even(psi, 4) AS p FROM psis)
SELECT variable, """ + ", ".join(f"max(p) FILTER (WHERE ref = '{a}') AS \"{a}-{b}\"" for a, b in YEARS) + """, max(p) AS worst, CASE WHEN max(p) < 0.1 THEN 'Stable' WHEN max(p) < 0.25 THEN 'Light drift' ELSE 'Strong drift' END AS stability FROM r GROUP BY variable""")
def ps6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stability.psi_table(lines(spark, sf_dir), "year", YEARS, ["l_extendedprice", "l_tax"], ["c_mktsegment"])


@query("ps7_psi_between_samples", BOOK + psi(SAMPLES, ["l_extendedprice", "l_quantity", "c_acctbal"], ["c_mktsegment", "o_orderpriority"], "dataset", 10) + "SELECT ref, curr, variable, round(psi, 6) AS psi FROM psis")
def ps7(spark: SparkSession, sf_dir: str) -> DataFrame:
    continuous, qualitative = ["l_extendedprice", "l_quantity", "c_acctbal"], ["c_mktsegment", "o_orderpriority"]
    return stability.psi(loan_book(spark, sf_dir, [*continuous, *qualitative]), "dataset", SAMPLES, continuous, qualitative)


WOE = """
, e AS (SELECT list_sort(list_distinct(quantile_cont(l_discount, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS qd, list_sort(list_distinct(quantile_cont(l_extendedprice, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS qp FROM loans),
g AS (
  SELECT 'l_discount' AS variable, lpad(CAST(greatest(len(list_filter(qd, lambda x: x < l_discount)), 1) AS VARCHAR), 3, '0') AS cutoff, def FROM loans, e
  UNION ALL SELECT 'l_extendedprice', lpad(CAST(greatest(len(list_filter(qp, lambda x: x < l_extendedprice)), 1) AS VARCHAR), 3, '0'), def FROM loans, e
  UNION ALL SELECT 'l_linenumber', CAST(k2 AS VARCHAR), def FROM loans
  UNION ALL SELECT 'o_orderpriority', o_orderpriority, def FROM loans),
c AS (SELECT variable, cutoff, count(*) AS n, sum(def) AS events, count(*) - sum(def) AS non_events FROM g GROUP BY 1, 2),
s AS (SELECT *, greatest(events, 1e-16) / (sum(events) OVER w + 1e-16) AS es, greatest(non_events, 1e-16) / (sum(non_events) OVER w + 1e-16) AS ns FROM c WINDOW w AS (PARTITION BY variable)),
woe AS (SELECT variable, cutoff, n, CAST(events AS BIGINT) AS events, es, CAST(non_events AS BIGINT) AS non_events, ns, ln(es / ns) AS woe, ln(es / ns) * (es - ns) AS iv FROM s)
"""
WOE_VARIABLES = ["l_discount", "l_extendedprice", "l_linenumber", "o_orderpriority"]


def woe_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return woe.woe_table(lines(spark, sf_dir).withColumn("l_linenumber", F.col("k2")), WOE_VARIABLES)


@query("wo1_woe_table", BOOK + WOE + "SELECT variable, cutoff, n, events, round(es, 6) AS event_share, non_events, round(ns, 6) AS non_event_share, round(woe, 6) AS woe, round(iv, 6) AS iv FROM woe")
def wo1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return woe_rows(spark, sf_dir).drop("upper")


@query("wo1_information_values", BOOK + WOE + "SELECT variable, round(sum(iv), 6) AS iv FROM woe GROUP BY 1")
def wo1_iv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return woe.information_values(woe_rows(spark, sf_dir))


# --- folds and selection ----------------------------------------------------------------------------------------


@query("sm_stratified_positions", BOOK + "SELECT k1, k2, k3, k4, round(k5, 6) AS k5, CAST(fold AS BIGINT) AS fold, dataset FROM book")
def sm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loan_book(spark, sf_dir, KEYS).select(*KEYS, "fold", "dataset")


STRATUM = BOOK + ", x AS (SELECT def, year, count(*) AS n FROM loans GROUP BY 1, 2) "


@query("sm1_stratified_split", STRATUM + "SELECT CAST(def AS BIGINT) AS def, CAST(year AS BIGINT) AS year, n, CAST(floor(n * 0.2) AS BIGINT) AS n_test FROM x")
def sm1(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = folds.stratified_split(lines(spark, sf_dir).select("def", "year", *KEYS), ["def", "year"], KEYS)
    return split.groupBy("def", "year").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("is_test"), 1)).alias("n_test"))


for first in (0, 1):
    query(f"sm{2 + first}_stratified_folds_from_{first}", STRATUM + f"SELECT CAST(def AS BIGINT) AS def, CAST(year AS BIGINT) AS year, CAST(f + {first} AS BIGINT) AS fold, CAST((n - f + 3) // 4 AS BIGINT) AS n FROM x, range(4) AS t(f)")(
        lambda spark, sf_dir, first=first: folds.stratified_folds(lines(spark, sf_dir).select("def", "year", *KEYS), 4, ["def", "year"], KEYS, first).groupBy("def", "year", "fold").agg(F.count(F.lit(1)).alias("n"))
    )


def sql_drawn(columns: list[str], seed: int) -> str:
    out = f"CAST({seed} AS BIGINT)"
    for c in columns:
        out = f"(({out} * 48271 + {c} % 2147483647) % 2147483647)"
    for _ in range(3):
        out = f"(({out} * 69621 + 12345) % 2147483647)"
    return out


@query("sm4_sample", BOOK + f"SELECT k1, k2, k3, k4, round(k5, 6) AS k5, l_quantity FROM (SELECT *, row_number() OVER (ORDER BY {sql_drawn(KEYS[:4], 42)}, k1, k2, k3, k4, k5) AS r FROM loans) WHERE r <= 500")
def sm4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.sampled(lines(spark, sf_dir), 500, KEYS, whole=KEYS[:4]).select(*KEYS, "l_quantity")


IDS = list(range(FOLDS))
LEFT = ", left_out(i) AS (VALUES (0), (1), (2), (3)), parts AS (SELECT i, loans2.* FROM left_out JOIN book AS loans2 ON fold <> i)"
MIXED = ["l_quantity", "l_discount", "c_acctbal", "l_tax"]


def fold_obs(columns: list[str], level: str, kind: str) -> str:
    return ", obs AS (" + " UNION ALL ".join(f"SELECT '{c}/' || i AS key, CAST({c} AS {kind}) AS value, CAST({level} AS VARCHAR) AS level FROM parts" for c in columns) + ")"


@query("vs1_keep_associated", BOOK + LEFT + fold_obs(MIXED, "def", "DOUBLE") + KRUSKAL + f"SELECT split_part(key, '/', 1) AS variable, max({sql_log10p('h', 'df')}) AS log10_p, max({sql_log10p('h', 'df')}) < log10(0.05) AS kept FROM kw GROUP BY 1")
def vs1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.keep_associated(loan_book(spark, sf_dir, MIXED), MIXED, "def", IDS).select("variable", log10p("worst_p").alias("log10_p"), "kept")


@query("vs2_keep_categorical", BOOK + LEFT + fold_obs(CATEGORICAL, "def", "VARCHAR") + CHI2 + "SELECT split_part(key, '/', 1) AS variable, round(avg(vc), 6) AS mean_v, min(vc) >= 0.1 AS kept FROM vs GROUP BY 1")
def vs2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.keep_categorical(loan_book(spark, sf_dir, CATEGORICAL), CATEGORICAL, "def", IDS).select("variable", "mean_v", "kept")


@query("vs4_drop_correlated", BOOK + LEFT + ", mix AS (SELECT *, l_quantity + l_tax * 50 AS q_tax, l_quantity * 2 + u % 7 AS q_noise FROM parts)" + fold_obs(["l_quantity", "q_tax", "q_noise"], "def", "DOUBLE").replace("FROM parts", "FROM mix") + KRUSKAL + """
, rk AS (SELECT i, """ + ", ".join(f"rank() OVER (PARTITION BY i ORDER BY {v}) + (count(*) OVER (PARTITION BY i, {v}) - 1) / 2.0 AS {v}" for v in ("l_quantity", "q_tax", "q_noise")) + """ FROM mix),
cs AS (SELECT i, corr(l_quantity, q_tax) AS c01, corr(l_quantity, q_noise) AS c02, corr(q_tax, q_noise) AS c12 FROM rk GROUP BY i),
pr AS (SELECT i, 'l_quantity' AS a, 'q_tax' AS b FROM cs WHERE abs(c01) >= 0.7 UNION ALL SELECT i, 'l_quantity', 'q_noise' FROM cs WHERE abs(c02) >= 0.7 UNION ALL SELECT i, 'q_tax', 'q_noise' FROM cs WHERE abs(c12) >= 0.7),
kp AS (SELECT key, """ + sql_chi2_sf("h", "df") + """ AS p FROM kw),
gone AS (SELECT CASE WHEN kb.p > ka.p THEN b ELSE a END AS v FROM pr JOIN kp ka ON ka.key = a || '/' || i JOIN kp kb ON kb.key = b || '/' || i)
SELECT variable, variable NOT IN (SELECT v FROM gone) AS kept FROM (VALUES ('l_quantity'), ('q_tax'), ('q_noise')) AS t(variable)""")
def vs4(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = loan_book(spark, sf_dir, ["l_quantity", "l_tax"]).withColumns({"q_tax": F.col("l_quantity") + F.col("l_tax") * 50, "q_noise": F.col("l_quantity") * 2 + F.col("u") % 7})
    return selection.drop_correlated(book, ["l_quantity", "q_tax", "q_noise"], "def", IDS).select("variable", "kept")


@query("vs5_drop_correlated_categorical", BOOK + LEFT + """
, mix AS (SELECT *, CASE o_orderpriority WHEN '1-URGENT' THEN 'u' WHEN '5-LOW' THEN 'l' ELSE 'm' END AS p3 FROM parts)
, obs AS (SELECT 'p/' || i AS key, o_orderpriority AS value, p3 AS level FROM mix UNION ALL SELECT 'a/' || i, o_orderpriority, CAST(def AS VARCHAR) FROM mix UNION ALL SELECT 'b/' || i, p3, CAST(def AS VARCHAR) FROM mix)""" + CHI2 + """
, m AS (SELECT split_part(key, '/', 1) AS w, max(vc) AS hi, avg(vc) AS v FROM vs GROUP BY 1)
SELECT variable, NOT ((SELECT hi FROM m WHERE w = 'p') >= 0.5 AND variable = CASE WHEN (SELECT v FROM m WHERE w = 'b') < (SELECT v FROM m WHERE w = 'a') THEN 'p3' ELSE 'o_orderpriority' END) AS kept
FROM (VALUES ('o_orderpriority'), ('p3'), ('c_mktsegment')) AS t(variable)""")
def vs5(spark: SparkSession, sf_dir: str) -> DataFrame:
    p3 = F.coalesce(scalar.mapped(F.col("o_orderpriority"), {"1-URGENT": "u", "5-LOW": "l"}), F.lit("m"))
    return selection.drop_correlated_categorical(loan_book(spark, sf_dir, ["o_orderpriority", "c_mktsegment"]).withColumn("p3", p3), ["o_orderpriority", "p3", "c_mktsegment"], "def", IDS).select("variable", "kept")


# --- metrics ----------------------------------------------------------------------------------------------------


@query("me_metrics", SCORED + CURVE + """
SELECT dataset, round(sum((n - e) * (tp - e / 2.0)) / (any_value(pos) * any_value(neg)), 6) AS auc, round(2 * sum((n - e) * (tp - e / 2.0)) / (any_value(pos) * any_value(neg)) - 1, 6) AS gini,
  round(sum(e * tp / (tp + fp)) / any_value(pos), 6) AS pr_auc, round(coalesce(sum(e) FILTER (WHERE s >= 0.5), 0) / any_value(pos), 6) AS recall,
  round(2 * coalesce(sum(e) FILTER (WHERE s >= 0.5), 0) / (coalesce(sum(n) FILTER (WHERE s >= 0.5), 0) + any_value(pos)), 6) AS f1 FROM cur GROUP BY dataset""")
def me(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.metrics(fixed_score(spark, sf_dir), "s", by=["dataset"])


@query("me3_roc", SCORED + CURVE + """
SELECT dataset, round(s, 6) AS threshold, round(fp / neg, 6) AS fpr, round(tp / pos, 6) AS tpr FROM cur
UNION ALL SELECT DISTINCT dataset, CAST('inf' AS DOUBLE), 0.0, 0.0 FROM cur UNION ALL SELECT DISTINCT dataset, CAST('-inf' AS DOUBLE), 1.0, 1.0 FROM cur""")
def me3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.roc(fixed_score(spark, sf_dir), "s", by=["dataset"])


@query("me4_pr_curve", SCORED + CURVE + "SELECT dataset, round(s, 6) AS threshold, round(tp / (tp + fp), 6) AS precision, round(tp / pos, 6) AS recall, round(e / pos, 6) AS step FROM cur")
def me4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.pr_curve(fixed_score(spark, sf_dir), "s", by=["dataset"])


# --- scorecard and classes --------------------------------------------------------------------------------------

#: A fixed model of four variables.
MODEL = {
    "intercept": -1.8,
    "references": {"q3": "1", "d3": "1", "l_linestatus": "F", "seg3": "REST"},
    "coefficients": {"q3": {"2": 0.55, "3": 1.02}, "d3": {"2": 0.31, "3": 0.48}, "l_linestatus": {"O": 0.02}, "seg3": {"BUILDING": 0.07, "MACHINERY": -0.11}},
}


def with_modalities(loans: DataFrame) -> DataFrame:
    """loans with the fixed model's variables; d3 is missing where rate_like is."""
    out = binning.apply_cutoffs(loans, "l_quantity", [17, 34, 50], "q3", ["1", "2", "3"])
    out = binning.apply_cutoffs(out, "rate_like", [0.03, 0.07, 0.1], "d3", ["1", "2", "3"])
    return out.withColumn("seg3", F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), F.col("c_mktsegment")).otherwise("REST"))


def modalities(spark: SparkSession, sf_dir: str, columns: Sequence[str] = ()) -> DataFrame:
    """The loan book with the fixed model's variables and these columns of lines()."""
    return with_modalities(loan_book(spark, sf_dir, [*columns, "l_quantity", "rate_like", "l_linestatus", "c_mktsegment"]))


#: Points by hand: 1000 |c - largest of the variable| / 1.70, where 1.70 = 1.02 + 0.48 + 0.02 + 0.18.
MODAL = BOOK + """
, modal AS (
  SELECT *, CASE WHEN l_quantity <= 17 THEN '1' WHEN l_quantity <= 34 THEN '2' ELSE '3' END AS q3,
    CASE WHEN rate_like IS NULL THEN NULL WHEN rate_like <= 0.03 THEN '1' WHEN rate_like <= 0.07 THEN '2' ELSE '3' END AS d3,
    CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN c_mktsegment ELSE 'REST' END AS seg3 FROM book),
pts AS (
  SELECT *, 1000 * CASE q3 WHEN '1' THEN 1.02 WHEN '2' THEN 0.47 ELSE 0 END / 1.7 AS pq, 1000 * CASE d3 WHEN '1' THEN 0.48 WHEN '2' THEN 0.17 WHEN '3' THEN 0 END / 1.7 AS pd,
    1000 * CASE l_linestatus WHEN 'F' THEN 0.02 ELSE 0 END / 1.7 AS pl, 1000 * CASE seg3 WHEN 'REST' THEN 0.07 WHEN 'BUILDING' THEN 0 ELSE 0.18 END / 1.7 AS ps,
    CASE q3 WHEN '1' THEN 0 WHEN '2' THEN 0.55 ELSE 1.02 END + coalesce(CASE d3 WHEN '1' THEN 0 WHEN '2' THEN 0.31 WHEN '3' THEN 0.48 END, 0) + CASE l_linestatus WHEN 'F' THEN 0 ELSE 0.02 END + CASE seg3 WHEN 'REST' THEN 0 WHEN 'BUILDING' THEN 0.07 ELSE -0.11 END - 1.8 AS margin
  FROM modal),
scored AS (SELECT *, round(pq + pd + pl + ps, 6) AS st FROM pts)
"""


def totalled(loans: DataFrame) -> DataFrame:
    return scorecard.score(loans, MODEL).withColumn("score_total", F.round("score_total", 6))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loans with their score; what reads no sample or fold doesn't have them put in order and numbered for the book."""
    return totalled(with_modalities(lines(spark, sf_dir)))


def scored_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys, year, target and score of the loans, written, as vingtiles read them several times."""
    return files.once(scored(spark, sf_dir).select(*KEYS, "year", "def", "score_total"))


@query("sc2_points", """
SELECT variable, modality, CAST(coefficient AS DOUBLE) AS coefficient, CAST(points AS DOUBLE) AS points FROM (VALUES ('q3', '1', 0.0, 600.0), ('q3', '2', 0.55, 276.470588), ('q3', '3', 1.02, 0.0), ('d3', '1', 0.0, 282.352941), ('d3', '2', 0.31, 100.0), ('d3', '3', 0.48, 0.0),
  ('l_linestatus', 'F', 0.0, 11.764706), ('l_linestatus', 'O', 0.02, 0.0), ('seg3', 'REST', 0.0, 41.176471), ('seg3', 'BUILDING', 0.07, 0.0), ('seg3', 'MACHINERY', -0.11, 105.882353)) AS t(variable, modality, coefficient, points)""")
def sc2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scorecard.points_table(spark, MODEL).select("variable", "modality", "coefficient", "points")


@query("sc3_scores", MODAL + "SELECT k1, k2, k3, k4, round(k5, 6) AS k5, d3 IS NULL AS missing_any, st AS score_total FROM scored")
def sc3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select(*KEYS, "missing_any", "score_total")


@query("lm16_probability", MODAL + "SELECT k1, k2, k3, k4, round(k5, 6) AS k5, round(1 / (1 + exp(-margin)), 6) AS probability FROM scored")
def lm16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scorecard.probability(modalities(spark, sf_dir, KEYS), MODEL).select(*KEYS, "probability")


@query("lm17_evaluate_model", MODAL.replace("scored AS", "scored0 AS") + ", scored AS (SELECT *, 1 / (1 + exp(-margin)) AS p, round(margin, 9) AS s FROM scored0)" + CURVE + """
SELECT dataset, round(sum((n - e) * (tp - e / 2.0)) / (any_value(pos) * any_value(neg)), 6) AS auc, round(2 * sum((n - e) * (tp - e / 2.0)) / (any_value(pos) * any_value(neg)) - 1, 6) AS gini FROM cur GROUP BY dataset""")
def lm17(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = scorecard.probability(modalities(spark, sf_dir), MODEL, "p").withColumn("p", F.round("p", 9))
    return metrics.metrics(rated, "p", by=["dataset"]).select("dataset", "auc", "gini")


def contribution(v: str, best: float, points: dict[str, float]) -> str:
    of = "CASE " + v + " " + " ".join(f"WHEN '{m}' THEN {p}" for m, p in points.items()) + " ELSE NULL END"
    return f"SELECT '{v}' AS variable, {best} / 10 / 1.7 AS max_share, sum({of}) / 1.7 / count(*) AS mean, sqrt(greatest(0, sum(power({of} / 1.7 - (SELECT sum({of}) / 1.7 / count(*) FROM modal), 2)) / count(*))) AS sd FROM modal"


@query("sc4_contributions", MODAL + ", c AS (" + " UNION ALL ".join([contribution("q3", 1020, {"1": 1020, "2": 470, "3": 0}), contribution("d3", 480, {"1": 480, "2": 170, "3": 0}), contribution("l_linestatus", 20, {"F": 20, "O": 0}), contribution("seg3", 180, {"REST": 70, "BUILDING": 0, "MACHINERY": 180})]) + """)
SELECT variable, round(max_share, 6) AS max_share, round(mean, 6) AS mean, round(sd, 6) AS sd, round(100 * sd / sum(sd) OVER (), 6) AS sd_share FROM c""")
def sc4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scorecard.contributions(modalities(spark, sf_dir), MODEL)


@query("sc6_vingtile_table", MODAL + VINGTILE.format(score="st", rows="scored") + "SELECT score_vingtile, round(min(st), 6) AS min_score, round(max(st), 6) AS max_score, count(*) AS n, CAST(sum(def) AS BIGINT) AS n_def, round(avg(def), 6) AS default_rate FROM ving GROUP BY 1")
def sc6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scorecard.vingtile_table(scored_once(spark, sf_dir), KEYS)


CLASS = """
, classed AS (SELECT *, CASE WHEN score_vingtile <= 3 THEN 1 WHEN score_vingtile <= 6 THEN 2 WHEN score_vingtile <= 8 THEN 3 WHEN score_vingtile <= 12 THEN 4 WHEN score_vingtile <= 17 THEN 5 ELSE 6 END AS score_class FROM ving)
"""


def classed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scorecard.with_classes(scored_once(spark, sf_dir), KEYS)


@query("sc7_risk_classes", MODAL + VINGTILE.format(score="st", rows="scored") + CLASS + """
, v AS (SELECT score_class, score_vingtile, avg(def) AS r FROM classed GROUP BY 1, 2), vr AS (SELECT score_class, min(r) AS lo, max(r) AS hi FROM v GROUP BY 1),
c AS (SELECT score_class, min(st) AS a, max(st) AS b, count(*) AS n, sum(def) AS d, avg(def) AS r, count(*) / (SELECT count(*) FROM scored) AS share FROM classed GROUP BY 1),
g AS (SELECT *, (lag(r) OVER (ORDER BY score_class) - r) / lag(r) OVER (ORDER BY score_class) AS gap FROM c)
SELECT CAST(g.score_class AS BIGINT) AS score_class, round(a, 6) AS min_score, round(b, 6) AS max_score, printf('[%.2f ; %.2f]', a, b) AS score_interval, n, CAST(d AS BIGINT) AS n_def, round(r, 6) AS default_rate,
  round(lo, 6) AS least_rate, round(hi, 6) AS most_rate, round(hi - lo, 6) AS rate_range, round(share, 6) AS share, round(gap, 6) AS gap, coalesce(gap >= 0.3, true) AS gap_ok, share >= 0.01 AS share_ok, d >= 500 AS defaults_ok, share >= 0.01 OR d >= 500 AS size_ok
FROM g JOIN vr ON g.score_class = vr.score_class""".replace("AS score_class, round(a, 6)", "AS score_class, CASE g.score_class WHEN 1 THEN 'Very high risk' WHEN 2 THEN 'High risk' WHEN 3 THEN 'Medium-high risk' WHEN 4 THEN 'Medium risk' WHEN 5 THEN 'Low risk' ELSE 'Very low risk' END AS risk_label, round(a, 6)"))
def sc7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scorecard.class_table(classed(spark, sf_dir))


@query("sc10_class_summary", MODAL + VINGTILE.format(score="st", rows="scored") + CLASS + """
, c AS (SELECT score_class, min(st) AS a, max(st) AS b, avg(def) AS r, count(*) / (SELECT count(*) FROM scored) AS share FROM classed GROUP BY 1)
SELECT CAST(score_class AS BIGINT) AS score_class, CASE score_class WHEN 1 THEN 'Very high risk' WHEN 2 THEN 'High risk' WHEN 3 THEN 'Medium-high risk' WHEN 4 THEN 'Medium risk' WHEN 5 THEN 'Low risk' ELSE 'Very low risk' END AS risk_label,
  printf('[%.2f ; %.2f]', a, b) AS score_interval, round(share, 6) AS share, round(r, 6) AS default_rate, round((lag(r) OVER (ORDER BY score_class) - r) / lag(r) OVER (ORDER BY score_class), 6) AS gap FROM c""")
def sc10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scorecard.class_summary(scorecard.class_table(classed(spark, sf_dir)))


PERIODS = """
, pc AS (SELECT year AS period, score_class, count(*) AS n, sum(def) AS d, avg(def) AS r, count(*) / sum(count(*)) OVER (PARTITION BY year) AS share FROM classed GROUP BY 1, 2)
"""


@query("sc8_class_stability", MODAL + VINGTILE.format(score="st", rows="scored") + CLASS + PERIODS + "SELECT CAST(period AS BIGINT) AS period, CAST(score_class AS BIGINT) AS score_class, n, CAST(d AS BIGINT) AS n_def, round(r, 6) AS default_rate, round(share, 6) AS share FROM pc")
def sc8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scorecard.class_stability(classed(spark, sf_dir))


@query("sc8_class_stability_summary", MODAL + VINGTILE.format(score="st", rows="scored") + CLASS + PERIODS + "SELECT CAST(score_class AS BIGINT) AS score_class, count(DISTINCT period) AS periods, " + ", ".join(
    f"round(min({c}), 6) AS {n}_min, round(max({c}), 6) AS {n}_max, round(avg({c}), 6) AS {n}_mean, round(stddev_samp({c}), 6) AS {n}_sd, round(stddev_samp({c}) / avg({c}), 6) AS {n}_cv" for c, n in (("r", "rate"), ("share", "share"))) + " FROM pc GROUP BY 1")
def sc8_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scorecard.class_stability_summary(scorecard.class_stability(classed(spark, sf_dir)))


for value, column in (("default_rate", "r"), ("share", "share")):
    query(f"sc8_{value}_matrix", MODAL + VINGTILE.format(score="st", rows="scored") + CLASS + PERIODS + "SELECT CAST(period AS BIGINT) AS period, " + ", ".join(f"round(max({column}) FILTER (WHERE score_class = {k}), 6) AS \"{k}\"" for k in range(1, 7)) + " FROM pc GROUP BY 1")(
        lambda spark, sf_dir, value=value: scorecard.stability_matrix(scorecard.class_stability(classed(spark, sf_dir)), value)
    )


@query("sc11_densities", MODAL + """
, cnt AS (SELECT dataset, def, st, count(*) AS c FROM scored WHERE st IS NOT NULL GROUP BY ALL), m AS (SELECT dataset, def, count(*) AS n, stddev_samp(st) AS sd FROM scored WHERE st IS NOT NULL GROUP BY ALL),
g AS (SELECT CAST(k AS DOUBLE) * 1000 / 299 AS x FROM range(300) AS t(k))
SELECT cnt.dataset, CAST(cnt.def AS BIGINT) AS def, round(x, 6) AS x, round(sum(c * exp(-power((x - st) / (sd * power(n, -0.2)), 2) / 2) / (n * sd * power(n, -0.2) * sqrt(2 * pi()))), 6) AS density
FROM cnt JOIN m ON cnt.dataset = m.dataset AND cnt.def = m.def, g GROUP BY 1, 2, 3""")
def sc11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scorecard.densities(totalled(modalities(spark, sf_dir)))


# --- model search -----------------------------------------------------------------------------------------------


@query("lm_one_variable_search", BOOK + """
, t AS (SELECT o_orderpriority AS p, sum(def) AS d, count(*) - sum(def) AS g FROM book WHERE dataset = 'Train' GROUP BY 1), ref AS (SELECT p AS rp, d AS rd, g AS rg FROM t ORDER BY d / (d + g), p LIMIT 1)
SELECT p AS modality, round(ln((d / g) / (rd / rg)), 6) AS coefficient, round(ln(rd / rg), 6) AS intercept FROM t, ref WHERE p <> rp""")
def lm_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = logit.search(loan_book(spark, sf_dir, ["o_orderpriority"]), ["o_orderpriority"])
    return found.select(F.explode("coefficients").alias("modality", "coefficient"), "intercept").withColumn("modality", F.substring_index("modality", "=", -1))


@query("lm1_reference_modalities", MODAL + " SELECT * FROM (" + " UNION ALL ".join(f"(SELECT '{v}' AS variable, coalesce({v}, 'nan') AS modality FROM modal GROUP BY {v} ORDER BY avg(def), 2 LIMIT 1)" for v in ("q3", "d3", "seg3", "l_linestatus")) + ")")
def lm1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = logit.reference_modalities(modalities(spark, sf_dir), ["q3", "d3", "seg3", "l_linestatus"])
    return spark.createDataFrame(sorted(found.items()), "variable string, modality string")


@query("lm11_model_search", None)
def lm11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logit.search(modalities(spark, sf_dir, ["o_orderpriority"]).withColumn("d3", scalar.as_modality(F.col("d3"))), ["q3", "d3", "seg3", "l_linestatus", "o_orderpriority"])


@query("e2e_scorecard_pipeline", None)
def e2e(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbers = ["l_quantity", "emp_like", "rate_like", "l_extendedprice"]
    book = loan_book(spark, sf_dir, [*KEYS, *numbers, "l_linestatus", "o_orderpriority"]).withColumns({c: F.col(c).cast("double") for c in numbers})
    made = scorecard_of(book, ["l_quantity", "rate_like", "l_extendedprice"], ["l_linestatus", "o_orderpriority"], KEYS, {"emp_like": 0.0}, ["rate_like"], IDS)
    return made.classes
