"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns, of the stages and of operators that lacked such tests."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from riskgrid.llm import decontamination, langid, quality
from riskgrid.llm.common import held_out

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators give to columns of their own.
NAMES = ("u", "_u", "x", "score", "predicted", "digest", "fp", "copies", "component_id", "key", "item_id", "size", "taken", "shard", "slot", "law", "_cell", "_atom")


def clashing(frame):
    return frame.withColumns({c: F.lit(f"mine {c}") for c in NAMES})


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(n))


def quality_docs(n):
    """Prose, and among it shouting, repetition and symbols; the ids of the prose."""
    rng = random.Random(3)
    rows, good = [], []
    for i in range(n):
        text = prose(rng, rng.randint(20, 200)).capitalize() + "."
        if rng.random() < 0.3:
            text = rng.choice([text.upper().replace(" ", "!! "), " ".join(["buy now"] * 60), "".join(rng.choice("#$%&*0123456789 ") for _ in range(400))])
        else:
            good.append(i)
        rows.append((i, text))
    return rows, good


def tables(spark, folder, rows, good):
    clashing(spark.createDataFrame(rows, DOCS)).write.parquet(f"{folder}/documents.parquet")
    item = prose(random.Random(9), 60)
    spark.createDataFrame([(0, item), (None, None), (1, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    labels = [(i, 1 if i in good else 0, 0) for i in range(400)] + [(None, 1, 0), (3, None, None), (70_000, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return item


def test_pipeline_of_odd_rows(spark, tmp_path):
    import corpus_pipeline

    rows, good = quality_docs(400)
    rng = random.Random(13)
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in rows]
    long = prose(rng, 40_000).capitalize() + "."
    odd = [(None, prose(rng, 90) + ".", None, None, None), (900, None, None, "s0", None), (901, "", "en", None, 0), (902, " \n\t", None, "s1", 3), (903, long, "en", "s1", len(long)), rows[good[0]], rows[good[0]]]
    tables(spark, tmp_path, rows + odd, set(good))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:4]:
        before = docs.columns
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == before, name
        assert docs.where("u <> 'mine u' or size <> 'mine size' or score <> 'mine score'").count() == 0, name
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert len(out) and all(sorted(p["slot"]) == list(range(len(p))) for _, p in out.groupby("shard"))
    assert set(out["doc_id"].dropna()) <= {r[0] for r in rows + odd}


def test_pipeline_of_no_rows(spark, tmp_path):
    import corpus_pipeline

    tables(spark, tmp_path, [], set())
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_quality_and_language_of_odd_rows(spark):
    rows, good = quality_docs(400)
    rows = [(i, t, "en" if i % 2 else "fr", "s", len(t)) for i, t in rows]
    long = prose(random.Random(2), 60_000) + "."
    odd = [(None, "some words", None, None, None), (900, None, "en", "s", None), (901, "", None, "s", 0), (903, long, "en", "s", 1), rows[5], rows[5]]
    docs = clashing(spark.createDataFrame(rows + odd, DOCS))
    trusted = spark.createDataFrame([(i,) for i in good] + [(None,), (None,)], "doc_id long")
    got = quality.score(docs, quality.train(docs, trusted, ~held_out())).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    again = [r.score for r in got if r.doc_id == rows[5][0]]
    assert len(again) == 3 and max(again) - min(again) < 1e-9
    told = langid.identify(docs, langid.train(docs, ~held_out())).collect()
    assert len(told) == len(got) and {r.lang_pred for r in told} <= {"en", "fr", "und"}
    assert {r.lang_pred for r in told if r.doc_id in (900, 901)} == {"und"}


def test_samples_stop_at_their_documented_numbers(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "fit", lambda p, q, prior, **_: seen.append((len(p), len(q))))
    rows, good = quality_docs(400)
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    quality.train(docs, spark.createDataFrame([(i,) for i in good], "doc_id long"), F.lit(True), positives=30, unlabelled=50, prior=0.5)
    assert seen == [(30, 50)]


def test_ties_between_languages_go_to_the_first(spark):
    same = [(i, "the same words in either language", "fr" if i % 2 else "en", "s", 1) for i in range(60)]
    docs = spark.createDataFrame(same, DOCS)
    assert {r.lang_pred for r in langid.identify(docs, langid.train(docs, F.lit(True))).collect()} == {"en"}


def test_leaks_beside_clashing_columns(spark):
    item = prose(random.Random(9), 60)
    docs = clashing(spark.createDataFrame([(1, "before " + item + " after", "en", "s", 1), (2, "nothing of it", "en", "s", 1), (None, None, None, None, None)], DOCS))
    benchmark = spark.createDataFrame([(0, item, "b")], "item_id long, text string, doc_id string")
    assert {(r.doc_id, r.item_id) for r in decontamination.leaks(docs, benchmark).collect()} == {(1, 0)}
    left = decontamination.without_leaks(docs, benchmark)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {2, None}
