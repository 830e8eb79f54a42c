"""Quality rules: statistics against brute force, path lengths by hand, held-out labels."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from riskgrid.llm import rules
from riskgrid.llm.common import held_out

WORD = r"[^\x20\x09-\x0D]+"


def brute(text):
    text = text or ""
    words = re.findall(WORD, text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines, seen = [x for x in text.split("\n") if re.search(WORD, x)], set()
    dup = 0
    for line in lines:
        dup += line in seen
        seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_statistics_match_brute_force():
    rng = random.Random(3)
    texts = [None, "", " \n\t\x0b\x0c\r ", "a", "a a a a", "a b c\x1cd \x85e", "x y z x y z x y", "ä\nä\n\nä \n 日本 日本"]
    for _ in range(300):
        texts.append("".join(rng.choice(["a", "b", "é", "日", " ", " ", "\n", "\r\n", "\t", "#", "<", "."]) for _ in range(rng.randint(0, 80))))
    texts += ["w " * 200_000, "one two three\n" * 50_000]
    for text in texts:
        assert rules.statistics(text)[:5] == brute(text), text


def test_path_lengths_of_a_tree_by_hand():
    leaf, inner = -1, 0
    tree = (np.array([inner, leaf, inner, leaf, leaf]), np.array([1.0, 0, 5.0, 0, 0]), np.array([1, 0, 3, 0, 0]), np.array([0, 1.0, 0, 2.0, 3.5]))
    forest = rules.Forest([tree, tree], 4)
    assert forest.depths(np.array([[0.0], [1.0], [5.0]])).tolist() == [1.0, 2.0, 3.5]
    # the mean depth of a missing value in random search trees: H(n - 1) * 2 - 2 (n - 1) / n, H by its logarithm
    assert abs(float(rules.usual_depth(256)) - (2 * sum(1 / k for k in range(1, 256)) - 2 * 255 / 256)) < 0.01
    assert rules.usual_depth(np.array([0, 1, 2])).tolist() == [0, 0, 1]


def test_trees_isolate_outliers_and_end_on_equal_rows():
    rng = np.random.default_rng(1)
    x = np.concatenate((rng.normal(0, 1, (1000, 3)), [[9.0, -9.0, 9.0]]))
    a = rules.grow(x).anomaly(x)
    assert a.argmax() == 1000 and a[1000] > 0.7 and np.median(a) < 0.5
    assert (rules.grow(x).anomaly(x) == a).all()
    same = rules.grow(np.ones((50, 2)))
    assert len({*same.anomaly(np.array([[1.0, 1.0], [7.0, 7.0]]))}) == 1


def test_thresholds_lose_no_good_rows_for_a_few_bad_ones():
    bins = np.array([10, 20, 30, 40])
    assert rules.calibrated(bins, np.array([50, 50, 0, 0]), np.array([0, 0, 5, 5]), 100) == pytest.approx((30 + 21) / 2 / rules.BINS)
    assert rules.calibrated(bins, np.array([50, 45, 5, 0]), np.array([0, 0, 5, 5]), 100) == pytest.approx((40 + 31) / 2 / rules.BINS)
    assert rules.calibrated(bins, np.array([50, 45, 4, 1]), np.array([0, 0, 5, 5]), 100) == np.inf
    assert rules.calibrated(bins, np.array([50, 50, 0, 0]), np.zeros(4, int), 100) == np.inf


def test_verdicts_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = rules.verdicts(docs.select("doc_id", "text"), labels).join(labels, "doc_id").where(held_out()).toPandas()
    texts = {r.doc_id: r.text for r in docs.join(labels, "doc_id").select("doc_id", "text").collect()}
    for row in got.head(300).itertuples():
        n_words, *_, repeat = want = brute(texts[row.doc_id])
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == want
        assert row.base_failed == (n_words < 50 or 100 * repeat > 50 * n_words)
    assert not (got["kept"] & got["base_failed"]).any()
    judged = got[~got["base_failed"]]
    assert judged[judged["quality"] == 0]["kept"].mean() < 0.05
    assert judged[judged["quality"] == 1]["kept"].mean() > 0.995


def test_edges_of_verdicts(spark):
    rng = random.Random(2)
    prose = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(80)) for _ in range(60)]
    rows = [(i, t, True, 1) for i, t in enumerate(prose)]
    rows += [(100 + i, " ### ".join(t.split()), False, 2) for i, t in enumerate(prose[:20])]
    rows += [(900, None, True, 0), (901, "", True, 0), (None, prose[0], True, 0), (902, "one two three " * 60_000, True, 0), rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept boolean, quality int")  # columns with names of the result
    labels = spark.createDataFrame([(i, 1, 5) for i in range(60)] + [(100 + i, 0, 5) for i in range(20)] + [(0, None, 1), (None, 1, 1), (7, 9, 1)], "doc_id long, quality int, n_words int")
    got = [(r.doc_id, r.kept, r.base_failed) for r in rules.verdicts(docs, labels).collect()]
    assert len(got) == len(rows) and got.count((0, True, False)) == 2
    assert {i for i, kept, failed in got if not kept and not failed} == {100 + i for i in range(20)}
    assert {i for i, _, failed in got if failed} == {900, 901, 902} and (None, True, False) in got
    alone = rules.verdicts(docs, labels.where("quality = 1")).collect()
    assert all(r.kept != r.base_failed for r in alone)
    assert rules.verdicts(docs.limit(0), labels).count() == 0
    assert rules.verdicts(docs.where("doc_id = 901"), labels.limit(0)).first().kept is False
