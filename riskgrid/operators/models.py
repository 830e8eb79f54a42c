"""Models as typed rows: saved, read, and scored together in one pass."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import as_modality, sigmoid
from ..sources.files import once, require
from .scorecard import Model, contributions, modality_points, points_table, score, with_references

#: A model: its intercept, and each modality of each variable with its coefficient, its points and whether it is the reference.
MODEL_ROW = "name string, intercept double, terms array<struct<variable string, modality string, coefficient double, points double, is_reference boolean>>"
#: All models that are scored together have at most so many terms, as they are sent to every task (some 20 MB).
MOST_TERMS = 200_000


def model_rows(spark: SparkSession, models: Mapping[str, Model], scale: float = 1000.0) -> DataFrame:
    """A row of MODEL_ROW for each named model."""
    rows = []
    for name, model in models.items():
        points, of = modality_points(model, scale), with_references(model)
        rows.append((name, float(model["intercept"]), [(v, m, float(x), float(points[v][m]), m == model["references"][v]) for v, c in of.items() for m, x in c.items()]))
    return spark.createDataFrame(rows, MODEL_ROW)


def found_models(results: DataFrame, references: Mapping[str, str], scale: float = 1000.0) -> DataFrame:
    """The fitted models of logit.search() as rows of MODEL_ROW, named by their variables joined by +."""
    ref = F.create_map(*[F.lit(x) for pair in references.items() for x in pair])
    own = F.flatten(F.transform("variables", lambda v: F.concat(
        F.array(F.struct(v.alias("variable"), F.get(F.array(ref[v]), F.lit(0)).alias("modality"), F.lit(0.0).alias("coefficient"), F.lit(True).alias("is_reference"))),
        F.transform(F.filter(F.map_entries("coefficients"), lambda e: F.startswith(e["key"], F.concat(v, F.lit("=")))), lambda e: F.struct(v.alias("variable"), F.substring(e["key"], F.length(v) + 2, F.length(e["key"])).alias("modality"), e["value"].alias("coefficient"), F.lit(False).alias("is_reference"))),
    )))
    terms = results.where("coefficients is not null").select(F.array_join("variables", "+").alias("name"), "intercept", F.explode(own).alias("t")).select("name", "intercept", "t.*")
    spread = terms.groupBy("name", "variable").agg(F.max("coefficient").alias("most"), (F.max("coefficient") - F.min("coefficient")).alias("spread"))
    whole = spread.groupBy("name").agg(F.sum("spread").alias("whole"))
    points = terms.join(spread, ["name", "variable"]).join(whole, "name").withColumn("points", F.try_divide(scale * (F.col("most") - F.col("coefficient")), F.col("whole")))
    term = F.struct("variable", "modality", "coefficient", "points", "is_reference")
    return points.groupBy("name", "intercept").agg(F.array_sort(F.collect_list(term)).alias("terms"))


def save_models(models: DataFrame, path: str) -> None:
    models.write.mode("overwrite").parquet(path)


def load_models(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MODEL_ROW).parquet(path)


def model_named(models: DataFrame, name: str) -> Model:
    """One of the models as the dict that scorecard.score() takes; ValueError if there is none."""
    row = models.where(F.col("name") == name).first()
    if row is None:
        raise ValueError(f"no model {name}")
    coefficients: dict[str, dict[str, float]] = {t["variable"]: {} for t in row["terms"]}
    for t in row["terms"]:
        if not t["is_reference"]:
            coefficients[t["variable"]][t["modality"]] = t["coefficient"]
    return {"intercept": row["intercept"], "references": {t["variable"]: t["modality"] for t in row["terms"] if t["is_reference"]}, "coefficients": coefficients}


def score_all(df: DataFrame, models: DataFrame) -> DataFrame:
    """Each row of df once for each model, with model, score_total (null and missing_any true where a modality is unknown) and probability (there the reference's).

    One pass over df. The models meet the rows as one broadcast row of maps from modality to points and coefficient; ValueError if they have
    more than MOST_TERMS terms.
    """
    models = once(models)  # read twice, and what it is made by can be a search
    terms = models.select("name", "intercept", F.explode("terms").alias("t")).select("name", "intercept", "t.*")
    size = terms.agg(F.count(F.lit(1)).alias("n"), F.collect_set("variable").alias("variables")).first()
    if size["n"] > MOST_TERMS:
        raise ValueError(f"{size['n']} terms are too many to be scored together")
    require(df, size["variables"])
    if not size["n"]:
        return df.limit(0).withColumns({"model": F.lit(""), "score_total": F.lit(0.0), "missing_any": F.lit(False), "probability": F.lit(0.0)})
    key = F.concat_ws("=", "variable", "modality")
    one = terms.groupBy("name", "intercept").agg(
        F.collect_set("variable").alias("variables"), F.map_from_entries(F.collect_list(F.struct(key, "points"))).alias("points"), F.map_from_entries(F.collect_list(F.struct(key, "coefficient"))).alias("coefficients")
    )
    one = one.agg(F.collect_list(F.struct("name", "intercept", F.array_sort("variables").alias("variables"), "points", "coefficients")).alias("_models"))
    of = F.create_map(*[x for v in sorted(size["variables"]) for x in (F.lit(v), F.concat_ws("=", F.lit(v), as_modality(F.col(v))))])
    rows = df.withColumn("_of", of).crossJoin(F.broadcast(one))  # one row

    def added(m: Column, values: str, start: Column, unknown: Column) -> Column:
        return F.aggregate(m["variables"], start, lambda total, v: total + F.coalesce(F.try_element_at(m[values], F.try_element_at(F.col("_of"), v)), unknown))

    each = F.transform("_models", lambda m: F.struct(m["name"].alias("model"), added(m, "points", F.lit(0.0), F.lit(None).cast("double")).alias("score_total"), sigmoid(added(m, "coefficients", m["intercept"], F.lit(0.0))).alias("probability")))
    out = rows.select(*df.columns, F.explode(each).alias("_s"))
    return out.select(*df.columns, "_s.model", "_s.score_total", F.col("_s.score_total").isNull().alias("missing_any"), "_s.probability")


@dataclass
class ScoreOutputs:
    """points: scorecard.points_table(); rows: scorecard.score() of all samples; contributions: of the training sample."""

    points: DataFrame
    rows: DataFrame
    contributions: DataFrame


def score_outputs(df: DataFrame, model: Model, scale: float = 1000.0, sample: str = "dataset", train: str = "Train") -> ScoreOutputs:
    """Points, scores and contributions of a model in one call."""
    require(df, [sample])
    return ScoreOutputs(points_table(df.sparkSession, model, scale), score(df, model, scale), contributions(df.where(F.col(sample) == train), model, scale))
