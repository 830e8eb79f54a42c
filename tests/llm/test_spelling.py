"""Spelling variants against brute force."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from riskgrid.llm import spelling

LETTER = "abcdeéèß"


def lowered(run):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)


def counted(docs):
    out = Counter()
    for doc_id, text in docs:
        for run in map(lowered, re.findall("[A-Za-zÀ-ÿ]+", text or "")):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            k = h % len(run)
            out[run[:k] + run[k + 1 :] if h % 97 == 0 else run] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(docs):
    n = counted(docs)
    near = {w: [v for v in n if one_apart(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def rows_of(frame):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in frame.select("word", "form", "root", "n", "n_near", "form_n").collect()}


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(4)
    words = ["".join(rng.choice(LETTER) for _ in range(rng.randint(4, 8))) for _ in range(60)]
    out = []
    for i in range(120):
        text = []
        for _ in range(rng.randint(0, 60)):
            w = list(rng.choice(words))
            if rng.random() < 0.5:
                k, kind = rng.randrange(len(w)), rng.randrange(3)
                w[k : k + (kind != 0)] = [] if kind == 1 else [rng.choice(LETTER)]
            text.append(rng.choice([str, str.capitalize])("".join(w)))
        out.append((i, rng.choice([" ", "-", "\n", "日", "1"]).join(text)))
    out += [(900, None), (901, ""), (None, " ".join(words)), (902, "12 %% 日本"), (903, "Zebra zebra ZEBRA ÉBRAS ébras "), (904, "x" * 300_000 + " " + "zebra " * 50_000)]
    return out + out[:5]  # repeated rows


def test_variants_match_brute_force(spark, docs):
    rows = [(i, t, "w", 7, "r") for i, t in docs if i != 904]
    got = spelling.variants(spark.createDataFrame(rows, "doc_id long, text string, word string, n int, root string"))  # columns of the result's names
    assert rows_of(got) == brute([(i, t) for i, t in docs if i != 904])
    assert got.count() == len(rows_of(got))


def test_variants_of_very_long_texts_and_words(spark, docs):
    got = {r.word: r.n for r in spelling.word_counts(spark.createDataFrame(docs, "doc_id long, text string")).where("n >= 3").collect()}
    assert got == counted(docs) and got["zebra"] > 40_000


def test_ties_of_forms_go_to_the_smallest_and_chains_to_the_last(spark):
    text = " ".join(["aaaab"] * 8 + ["aaaaz"] * 8 + ["aaaac"] * 4 + ["aaaacd"] * 3 + ["éaaab"] * 3 + ["baaaz"] * 16)
    got = {r.word: r for r in spelling.variants(spark.createDataFrame([(5, text)], "doc_id long, text string")).collect()}
    assert got == {w: r for w, r in got.items() if (r.word, r.form, r.root, r.n, r.n_near, r.form_n) in brute([(5, text)])}
    assert got["aaaac"].form == "aaaab" and got["aaaaz"].form == "baaaz" and got["aaaab"].form is None


def test_no_words_give_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(empty).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, None), (2, "one two 3")], "doc_id long, text string")).count() == 0


def test_hashes_of_all_edits_are_those_of_the_edited_words():
    alphabet = sorted(LETTER)
    near = spelling.Neighbourhood(alphabet)
    for word in ("a", "abéd", "bbbbbb"):
        seen = set()
        for kind, h in near.edits(near.coded([word])):
            for place in np.ndindex(h.shape[1:]):
                edit = near.edited(word, kind, place[0], place[1] if len(place) > 1 else 0)
                seen.add(edit)
                if edit:
                    assert near.hashes(near.coded([edit]))[0] == h[(0, *place)]
        left, right = [word[:i] for i in range(len(word) + 1)], [word[i:] for i in range(len(word) + 1)]
        want = {a + b[1:] for a, b in zip(left, right) if b} | {a + c + b[1:] for a, b in zip(left, right) if b for c in alphabet} | {a + c + b for a, b in zip(left, right) for c in alphabet}
        assert seen == want


def test_a_crowded_filter_and_a_shuffled_vocabulary_lose_nothing(spark, docs, monkeypatch):
    monkeypatch.setattr(spelling, "FILTER_BITS", 10)
    monkeypatch.setattr(spelling, "BROADCAST_WORDS", 1)
    rows = [x for x in docs if x[0] != 904]
    assert rows_of(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)
