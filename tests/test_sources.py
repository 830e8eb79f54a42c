from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from riskgrid.operators import scorecard
from riskgrid.plans.catalogue import MODEL
from riskgrid.sources import files
from riskgrid.streaming import scoring


def test_csv_round_trip_with_missing_values(spark, tmp_path):
    path = tmp_path / "loans.csv"
    head = ",".join(f.name for f in files.RAW_LOANS)
    path.write_text(f"{head}\n22,59000,RENT,123,PERSONAL,D,35000,16.02,1,0.59,Y,3\n21,9600,OWN,,EDUCATION,B,1000,NaN,0,0.1,N,14\n")
    df = files.derive_period(files.read_csv(spark, str(path)))
    rows = df.orderBy("loan_amnt").collect()
    assert [r["year"] for r in rows] == [2013, 2021] and [r["def"] for r in rows] == [0, 1]
    assert rows[0]["person_emp_length"] is None and rows[0]["loan_int_rate"] is None
    train, oot = files.cut_by_year(df, 2020, 2021)
    assert train.count() == 1 and oot.count() == 1
    files.write_csv(df, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 2
    with pytest.raises(ValueError, match="missing columns"):
        files.derive_period(df.drop("loan_status"))


def test_folds_reports_and_models_round_trip(spark, tmp_path):
    df = spark.range(100).withColumn("fold", (F.col("id") % 4).cast("int"))
    files.save_folds(df, str(tmp_path / "folds"))
    back = files.load_folds(spark, str(tmp_path / "folds"))
    assert sorted(back) == [0, 1, 2, 3] and all((a.count(), b.count()) == (75, 25) and "fold" not in a.columns for a, b in back.values())
    files.save_model(spark, MODEL, str(tmp_path / "model"))
    assert files.load_model(spark, str(tmp_path / "model")) == MODEL
    files.save_report({"a": df.limit(3), "b": df.limit(2)}, str(tmp_path / "report"))
    assert spark.read.option("header", True).csv(str(tmp_path / "report/a")).count() == 3


def test_a_stream_is_scored_like_a_table(spark, tmp_path):
    rows = [("1", "1", "F", "REST"), ("3", "2", "O", "BUILDING"), ("?", "2", "O", "BUILDING")]
    table = spark.createDataFrame(rows, "q3 string, d3 string, l_linestatus string, seg3 string")
    table.write.parquet(str(tmp_path / "in"))
    stream = scoring.scored_stream(spark.readStream.schema(table.schema).parquet(str(tmp_path / "in")), MODEL)
    query = scoring.write_scores(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    assert query.awaitTermination(120)
    got = {r["q3"]: r["score_total"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r["q3"]: r["score_total"] for r in scorecard.score(table, MODEL).collect()}
    assert got == want
