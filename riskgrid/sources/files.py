"""Typed readers and writers of loan tables, folds, reports and models."""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The raw loan table.
RAW_LOANS = T.StructType(
    [
        T.StructField("person_age", T.IntegerType()),
        T.StructField("person_income", T.DoubleType()),
        T.StructField("person_home_ownership", T.StringType()),
        T.StructField("person_emp_length", T.DoubleType()),
        T.StructField("loan_intent", T.StringType()),
        T.StructField("loan_grade", T.StringType()),
        T.StructField("loan_amnt", T.DoubleType()),
        T.StructField("loan_int_rate", T.DoubleType()),
        T.StructField("loan_status", T.IntegerType()),
        T.StructField("loan_percent_income", T.DoubleType()),
        T.StructField("cb_person_default_on_file", T.StringType()),
        T.StructField("cb_person_cred_hist_length", T.IntegerType()),
    ]
)


def require(df: DataFrame, columns: Iterable[str]) -> None:
    """Raise ValueError if df lacks any of the columns."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def without_nan(df: DataFrame) -> DataFrame:
    """NaN in floating columns becomes null, as missing values are null everywhere here."""
    return df.withColumns({f.name: F.when(~F.isnan(f.name), F.col(f.name)) for f in df.schema if isinstance(f.dataType, T.DoubleType | T.FloatType)} or {df.columns[0]: F.col(df.columns[0])})


def read_csv(spark: SparkSession, path: str, schema: T.StructType = RAW_LOANS) -> DataFrame:
    """A CSV file or folder with a header, read with an explicit schema; no pass to infer types."""
    return without_nan(spark.read.schema(schema).option("header", True).csv(path))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def derive_period(df: DataFrame, history: str = "cb_person_cred_hist_length", asof: int = 2024, first: int = 2013) -> DataFrame:
    """Add year (asof less the length of credit history, at least first) and def (the loan status as a number)."""
    require(df, [history, "loan_status"])
    year = asof - F.col(history)
    return df.withColumns({"year": F.when(year < first, first).otherwise(year).cast("int"), "def": F.col("loan_status").cast("int")})


def cut_by_year(df: DataFrame, last_train: int, oot: int, year: str = "year") -> tuple[DataFrame, DataFrame]:
    """Rows up to the last training year, and those of the out-of-time year; later years fall in neither."""
    return df.where(F.col(year) <= last_train), df.where(F.col(year) == oot)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path that driver and executors share: below spark.checkpoint.dir where that is set, else (one machine) below a temporary folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):  # local-cluster has executors of its own
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{shared or tempfile.mkdtemp(prefix='riskgrid-')}/{name}-{uuid.uuid4().hex}"


def once(df: DataFrame) -> DataFrame:
    """df, evaluated now and written to a folder of scratch(), for plans that read it in several places."""
    folder = scratch(df.sparkSession, "once")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def save_folds(df: DataFrame, path: str, fold: str = "fold") -> None:
    """Write df once, a folder for each fold; training rows of fold i are those of all other folders."""
    df.write.mode("overwrite").partitionBy(fold).parquet(path)


def load_folds(spark: SparkSession, path: str, fold: str = "fold") -> dict[int, tuple[DataFrame, DataFrame]]:
    """For each fold its (training, validation) rows without the fold column; folds are pruned at the scan."""
    df = spark.read.parquet(path)
    ids = sorted(r[0] for r in df.select(fold).distinct().collect())
    return {i: (df.where(F.col(fold) != i).drop(fold), df.where(F.col(fold) == i).drop(fold)) for i in ids}


def save_report(tables: Mapping[str, DataFrame], path: str) -> None:
    """A report of several small tables: a folder with one CSV folder for each, in place of a workbook's sheets."""
    for name, table in tables.items():
        write_csv(table.coalesce(1), f"{path}/{name}")


def save_model(spark: SparkSession, model: Mapping[str, object], path: str) -> None:
    """A model (a nest of dicts, lists, text and numbers) as one row of JSON text."""
    spark.createDataFrame([(json.dumps(model, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_model(spark: SparkSession, path: str) -> dict[str, object]:
    return json.loads(spark.read.text(path).first()[0])
