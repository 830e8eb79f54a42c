"""Registered queries on models: searched, checked, ordered, saved and scored."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import logit, models
from ..sources.files import scratch
from ..sources.loanbook import KEYS
from .catalogue import MODAL, MODEL, log10p, modalities, query
from .oracle import log10p as sql_log10p

CANDIDATES = ["q3", "d3", "seg3", "l_linestatus", "o_orderpriority"]
#: Variables of models with one variable; q3_line crosses two, so that its model has a coefficient for each of their cells.
SINGLE = ["q3", "seg3", "l_linestatus", "o_orderpriority", "q3_line"]

#: Cells (variable, modality m, rows n, events s) of the training sample; of models with one variable, everything follows from them.
CELLS = MODAL + """
, crossed AS (SELECT *, q3 || '/' || l_linestatus AS q3_line FROM modal),
lv AS (""" + " UNION ALL ".join(f"SELECT '{v}' AS variable, {v} AS m, dataset, fold, def FROM crossed" for v in SINGLE) + """),
cell AS (SELECT variable, m, count(*) AS n, sum(def) AS s FROM lv WHERE dataset = 'Train' GROUP BY ALL),
odds AS (SELECT *, ln(s / (n - s)) AS lo, s * (n - s) / n AS w, n / sum(n) OVER (PARTITION BY variable) AS pi FROM cell),
ref AS (SELECT variable, arg_min(m, (s / n, m)) AS rm FROM cell GROUP BY 1),
co AS (SELECT o.*, r.lo AS rlo, r.w AS rw, r.pi AS rpi, o.lo - r.lo AS b FROM odds o JOIN ref USING (variable) JOIN odds r ON r.variable = ref.variable AND r.m = rm WHERE o.m <> rm),
joint AS (SELECT variable, sum(w * b * b) - power(sum(w * b), 2) / (sum(w) + any_value(rw)) AS x, count(*) AS df FROM co GROUP BY 1),
llr AS (SELECT variable, 2 * (sum(s * ln(s / n) + (n - s) * ln(1 - s / n)) - (sum(s) * ln(sum(s) / sum(n)) + sum(n - s) * ln(1 - sum(s) / sum(n)))) AS x, count(*) - 1 AS df FROM cell GROUP BY 1)
"""


def single_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logit.search(modalities(spark, sf_dir, ["o_orderpriority"]).withColumn("q3_line", F.concat_ws("/", "q3", "l_linestatus")), SINGLE, [1])


@query("lm5_single_model_checks", CELLS + f"""
SELECT variable, m AS modality, round(rlo, 6) AS intercept, round(b, 6) AS coefficient, {sql_log10p("b * b / (1 / w + 1 / rw)", "1")} AS log10_p, {sql_log10p("joint.x", "joint.df")} AS log10_joint_p,
  {sql_log10p("llr.x", "llr.df")} AS log10_llr_p, round((1 - pi) * (pi + rpi) / rpi, 6) AS vif, (1 - pi) * (pi + rpi) / rpi < 10 AS vif_ok, b * b / (1 / w + 1 / rw) > 3.841458820694124 AS modality_ok
FROM co JOIN joint USING (variable) JOIN llr USING (variable)""")
def lm5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = single_models(spark, sf_dir).select(F.col("variables")[0].alias("variable"), "intercept", "p_values", "joint_p", "llr_p", "vif", F.explode("coefficients").alias("name", "coefficient"))
    rows = rows.select("*", F.col("p_values")[F.col("name")].alias("p"), F.col("joint_p")[F.col("variable")].alias("jp"), F.col("vif")[F.col("name")].alias("v"))
    return rows.select("variable", F.expr("substring(name, length(variable) + 2)").alias("modality"), "intercept", "coefficient", log10p("p").alias("log10_p"), log10p("jp").alias("log10_joint_p"), log10p("llr_p").alias("log10_llr_p"), F.col("v").alias("vif"), (F.col("v") < 10).alias("vif_ok"), (F.col("p") < 0.05).alias("modality_ok"))


#: Metrics of the one-variable models on each sample, and on each fold of the model that leaves it out.
SINGLE_METRICS = CELLS + """
, rate AS (SELECT variable, m, k, sum(def) / count(*) AS p FROM lv, (SELECT unnest([-1, 0, 1, 2, 3]) AS k) WHERE dataset = 'Train' AND fold <> k GROUP BY ALL),
part AS (SELECT variable, m, lower(dataset) AS part, -1 AS k, def FROM lv UNION ALL SELECT variable, m, 'fold' || fold, fold, def FROM lv WHERE dataset = 'Train'),
ev AS (SELECT part.variable, part, round(p, 12) AS p, count(*) AS n, sum(def) AS s FROM part JOIN rate ON rate.variable = part.variable AND rate.m = part.m AND rate.k = part.k GROUP BY ALL),
cur AS (SELECT *, sum(s) OVER w AS tp, sum(n - s) OVER w AS fp, sum(s) OVER (PARTITION BY variable, part) AS pos, sum(n - s) OVER (PARTITION BY variable, part) AS neg FROM ev WINDOW w AS (PARTITION BY variable, part ORDER BY p DESC)),
me AS (SELECT variable, part, 2 * sum((n - s) * (tp - s / 2.0)) / (any_value(pos) * any_value(neg)) - 1 AS gini, sum(s * tp / (tp + fp)) / any_value(pos) AS pr_auc,
  coalesce(sum(s) FILTER (WHERE p >= 0.5), 0) / any_value(pos) AS recall, 2 * coalesce(sum(s) FILTER (WHERE p >= 0.5), 0) / (coalesce(sum(n) FILTER (WHERE p >= 0.5), 0) + any_value(pos)) AS f1 FROM cur GROUP BY ALL),
wide AS (SELECT variable, """ + ", ".join(
    f"max({m}) FILTER (WHERE part = '{x}') AS {m}_{x}" for m in logit.PENALISED for x in ("train", "test", "oot")) + ", " + ", ".join(
    f"avg({m}) FILTER (WHERE part LIKE 'fold%') AS {m}_fold_mean, min({m}) FILTER (WHERE part LIKE 'fold%') AS {m}_fold_min, stddev_samp({m}) FILTER (WHERE part LIKE 'fold%') AS {m}_fold_sd" for m in logit.PENALISED) + """ FROM me GROUP BY 1),
pen AS (SELECT *, """ + ", ".join(f"{m}_fold_mean - abs({m}_train - {m}_test) - abs({m}_train - {m}_oot) AS {m}_penalised" for m in logit.PENALISED) + " FROM wide)\n"
MEASURES = [f"{m}_{x}" for m in logit.PENALISED for x in ("train", "test", "oot", "fold_mean", "fold_min", "fold_sd", "penalised")]


@query("lm10_single_model_metrics", SINGLE_METRICS + "SELECT variable, " + ", ".join(f"round({c}, 6) AS {c}" for c in MEASURES) + " FROM pen")
def lm10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return single_models(spark, sf_dir).select(F.col("variables")[0].alias("variable"), *MEASURES)


@query("so2_model_order", SINGLE_METRICS + """
, ok AS (SELECT co.variable, bool_and(b * b / (1 / w + 1 / rw) > 3.841458820694124 AND (1 - pi) * (pi + rpi) / rpi < 10) AND any_value(""" + sql_log10p("joint.x", "joint.df") + """) < log10(0.05) AND any_value(""" + sql_log10p("llr.x", "llr.df") + """) < log10(0.05) AS ok
  FROM co JOIN joint USING (variable) JOIN llr USING (variable) GROUP BY 1)
SELECT row_number() OVER (ORDER BY ok DESC, gini_penalised DESC, pr_auc_penalised DESC, recall_penalised DESC, f1_penalised DESC, gini_fold_mean DESC, variable) AS place, variable, ok AS all_ok FROM pen JOIN ok USING (variable)""")
def so2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logit.ordered(single_models(spark, sf_dir)).select("place", F.col("variables")[0].alias("variable"), "all_ok")


SUBSETS = [c for k in (1, 2, 3) for c in combinations(CANDIDATES, k)]


@query("lm2_fitted_margins", MODAL + """
, lv AS (""" + " UNION ALL ".join(f"SELECT '{v}' AS variable, coalesce({v}, 'nan') AS m, def FROM modal WHERE dataset = 'Train'" for v in CANDIDATES) + """),
cell AS (SELECT variable, m, count(*) AS n, sum(def) AS s FROM lv GROUP BY ALL),
subset(model, variable) AS (VALUES """ + ", ".join(f"('{'+'.join(c)}', '{v}')" for c in SUBSETS for v in c) + """)
SELECT model, variable, m AS modality, CAST(n AS BIGINT) AS n, CAST(s AS BIGINT) AS events, round(CAST(s AS DOUBLE), 4) AS fitted FROM subset JOIN cell USING (variable)""")
def lm2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The expected events of each modality of each fitted model, which at the maximum of the likelihood, and only there, are the observed ones."""
    book = modalities(spark, sf_dir, ["o_orderpriority"]).withColumns({v: scalar.as_modality(F.col(v)) for v in CANDIDATES})
    train = book.where("dataset = 'Train'")
    found = models.found_models(logit.search(book, CANDIDATES, [1, 2, 3]), logit.reference_modalities(train, CANDIDATES))
    rated = models.score_all(train.groupBy(*CANDIDATES).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("def").cast("long")).alias("events")), found)
    each = F.explode(F.filter(F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).alias("modality")) for v in CANDIDATES]), lambda x: F.array_contains(F.split("model", r"\+"), x["variable"])))
    out = rated.select("model", "n", "events", "probability", each.alias("e")).groupBy("model", "e.variable", "e.modality")
    return out.agg(F.sum("n").alias("n"), F.sum("events").alias("events"), F.round(F.sum(F.col("n") * F.col("probability")), 4).alias("fitted"))


#: A second fixed model, of two variables.
SECOND = {"intercept": -1.1, "references": {"q3": "3", "l_linestatus": "O"}, "coefficients": {"q3": {"1": -0.9, "2": -0.4}, "l_linestatus": {"F": 0.1}}}


@query("lm15_models_scored_together", MODAL + """
SELECT k1, k2, k3, k4, round(k5, 6) AS k5, 'first' AS model, st AS score_total, d3 IS NULL AS missing_any, round(1 / (1 + exp(-margin)), 6) AS probability FROM scored
UNION ALL SELECT k1, k2, k3, k4, round(k5, 6), 'second', round(1000 * (CASE q3 WHEN '1' THEN 0.9 WHEN '2' THEN 0.4 ELSE 0 END + CASE l_linestatus WHEN 'F' THEN 0 ELSE 0.1 END), 6), false,
  round(1 / (1 + exp(1.1 - CASE q3 WHEN '1' THEN -0.9 WHEN '2' THEN -0.4 ELSE 0 END - CASE l_linestatus WHEN 'F' THEN 0.1 ELSE 0 END)), 6) FROM modal""")
def lm15(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "models")
    models.save_models(models.model_rows(spark, {"first": MODEL, "second": SECOND}), path)
    return models.score_all(modalities(spark, sf_dir, KEYS), models.load_models(spark, path)).select(*KEYS, "model", "score_total", "missing_any", "probability")


def spread(v: str, points: dict[str, float]) -> str:
    of = f"CASE {v} " + " ".join(f"WHEN '{m}' THEN {1000 * p / 1.7}" for m, p in points.items()) + " END"
    return f"SELECT 'contribution' AS kind, '{v}' AS name, '' AS modality, sum({of}) / count(*) AS value FROM modal WHERE dataset = 'Train'"


@query("sc5_score_outputs", MODAL + """
, c AS (""" + " UNION ALL ".join([spread("q3", {"1": 1.02, "2": 0.47, "3": 0}), spread("d3", {"1": 0.48, "2": 0.17, "3": 0}), spread("l_linestatus", {"F": 0.02, "O": 0}), spread("seg3", {"REST": 0.07, "BUILDING": 0, "MACHINERY": 0.18})]) + """),
p AS (SELECT DISTINCT 'points' AS kind, 'q3' AS name, q3 AS modality, pq AS value FROM pts UNION SELECT DISTINCT 'points', 'd3', d3, pd FROM pts WHERE d3 IS NOT NULL UNION SELECT DISTINCT 'points', 'l_linestatus', l_linestatus, pl FROM pts UNION SELECT DISTINCT 'points', 'seg3', seg3, ps FROM pts)
SELECT kind, name, modality, round(value, 4) AS value FROM (SELECT * FROM c UNION ALL SELECT * FROM p UNION ALL SELECT 'score', dataset, '', avg(pq + pd + pl + ps) FROM pts GROUP BY dataset)""")
def sc5(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = models.score_outputs(modalities(spark, sf_dir), MODEL)
    value = F.round("value", 4).alias("value")
    rows = made.points.select(F.lit("points").alias("kind"), F.col("variable").alias("name"), "modality", F.col("points").alias("value"))
    rows = rows.unionByName(made.rows.groupBy(F.col("dataset").alias("name")).agg(F.avg("score_total").alias("value")).select(F.lit("score").alias("kind"), "name", F.lit("").alias("modality"), "value"))
    return rows.unionByName(made.contributions.select(F.lit("contribution").alias("kind"), F.col("variable").alias("name"), F.lit("").alias("modality"), F.col("mean").alias("value"))).select("kind", "name", "modality", value)
