"""Decontamination, quality, extraction, mixing, language and sharding on small fixtures."""

from __future__ import annotations

import hashlib
import itertools
import random
import time
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskgrid.llm import decontamination, langid, mixing, pages, quality, sharding
from riskgrid.llm.common import held_out

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, letters="abcdefghijklmnop"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(n))


def edited(rng, text, edits):
    chars = list(text)
    for _ in range(edits):
        k = rng.randrange(len(chars))
        kind = rng.randrange(3)
        if kind == 0:
            chars[k] = "z"
        elif kind == 1:
            del chars[k]
        else:
            chars.insert(k, "q")
    return "".join(chars)


def least_edits(pattern, text):
    """The fewest edits of the whole pattern against any part of text."""
    row = np.zeros(len(text) + 1, int)
    codes = np.array([ord(c) for c in text])
    for i, c in enumerate(pattern, 1):
        down = np.empty_like(row)
        down[0] = i
        down[1:] = np.minimum(row[1:] + 1, row[:-1] + (codes != ord(c)))
        row = np.minimum.accumulate(down - np.arange(len(down))) + np.arange(len(down))
    return int(row.min())


def test_leaks_match_alignment_of_every_window(spark):
    rng = random.Random(1)
    items = [prose(rng, n) for n in (60, 40, 18, 12, 8)] + ["tiny"]
    docs = []
    for i in range(60):
        words = prose(rng, rng.randint(5, 150))
        if i % 2:
            part = rng.choice(items[:5])
            words += " " + edited(rng, part, rng.choice([0, 1, 3, 6, 9, 20])) + " " + prose(rng, 5)
        docs.append((i, rng.choice([str.upper, str.lower, lambda t: t.replace(" ", ",\n ")])(words), "en", "s", 1))
    docs += [(100, None, "en", "s", 1), (101, "", "en", "s", 1), (102, prose(rng, 60_000) + items[0], "en", "s", 1), (None, items[1], "en", "s", 1)]
    benchmark = spark.createDataFrame([*enumerate(items), (0, items[0]), (None, items[0]), (50, None)], "item_id long, text string")
    got = decontamination.leaks(spark.createDataFrame(docs, DOCS), benchmark).collect()
    rule = decontamination.Rule()
    want = set()
    for doc_id, text, *_ in docs:
        if not text or len(text) > 10_000:
            continue
        flat = "".join(map(chr, decontamination.normalise([text])[0][1:].astype(int)))
        for item, body in enumerate(items):
            starts = [*range(0, max(len(body) - rule.window, 0) + 1, rule.window)]
            starts += [len(body) - rule.window] if starts[-1] + rule.window < len(body) else []
            windows = [body[s : s + rule.window] for s in starts]
            if len(body) >= rule.least and any(least_edits(w, flat) <= rule.budget(len(w)) for w in windows):
                want.add((doc_id, item))
    assert {(r.doc_id, r.item_id) for r in got} - {(102, 0)} == want and (102, 0) in {(r.doc_id, r.item_id) for r in got}
    whole = next(r for r in got if r.doc_id is None)
    assert (whole.start, whole.end, whole.edits) == (0, len(items[1]), 0)
    kept = decontamination.without_leaks(spark.createDataFrame(docs, DOCS), benchmark)
    assert {r.doc_id for r in kept.collect()} == {d for d, *_ in docs} - {r.doc_id for r in got} and kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_leaks_of_excerpts_off_any_grid(spark):
    rng = random.Random(11)
    rule, items = decontamination.Rule(), [prose(rng, n) for n in (45, 60, 75, 90)]
    docs = []
    for item, text in enumerate(items):
        for share in (0.5, 0.6, 0.7, 0.8):
            n = max(int(share * len(text)), rule.window)
            for start in (1, (len(text) - n) // 2, rng.randrange(len(text) - n)):
                docs.append((len(docs), item, prose(rng, 30) + " " + text[start : start + n].strip() + " " + prose(rng, 30)))
        for start in (rule.window // 2, rule.window + 40):  # one window, with all the edits it may have
            part = text[start : start + rule.window].replace(" ", "a", 1)
            for k in range(6, 6 + 12 * (rule.budget(rule.window) - 1), 12):
                part = part[:k] + "z" + part[k + 1 :]
            docs.append((len(docs), item, prose(rng, 30) + " " + part + " " + prose(rng, 30)))
    want = {(d, item) for d, item, _ in docs}
    assert all(min(least_edits(items[i][s : s + rule.window], t) for s in range(len(items[i]) - rule.window + 1)) <= rule.budget(rule.window) for _, i, t in docs[::5])
    df = spark.createDataFrame([(d, t, "en", "s", 1) for d, _, t in docs], DOCS)
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.leaks(df, benchmark).collect()} == want
    assert decontamination.without_leaks(df, benchmark).count() == 0


def test_leaks_in_several_benchmark_blocks_and_of_nothing(spark):
    rng = random.Random(2)
    items = [prose(rng, 50) for _ in range(12)]
    docs = spark.createDataFrame([(i, prose(rng, 30) + " " + t, "en", "s", 1) for i, t in enumerate(items)], DOCS)
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert sorted({(r.doc_id, r.item_id) for r in decontamination.leaks(docs, benchmark, block=5).collect()}) == [(i, i) for i in range(12)]
    assert decontamination.without_leaks(docs, benchmark, block=5).count() == 0
    assert decontamination.leaks(docs, benchmark.limit(0)).count() == 0 and decontamination.leaks(docs.limit(0), benchmark).count() == 0
    assert decontamination.without_leaks(docs, benchmark.limit(0)).count() == 12


def quality_docs(n=600):
    rng = random.Random(3)
    rows, good = [], []
    for i in range(n):
        bad = rng.random() < 0.3
        text = prose(rng, rng.randint(20, 200)).capitalize() + "."
        if bad:
            text = rng.choice([text.upper().replace(" ", "!! "), " ".join(["buy now"] * 60), "".join(rng.choice("#$%&*0123456789 ") for _ in range(400))])
        rows.append((i, text, "en", "s", 1))
        if not bad:
            good.append(i)
    return rows, good


def test_quality_is_learnt_from_positives_alone(spark):
    rows, good = quality_docs()
    docs = spark.createDataFrame([*rows, (9000, None, "en", "s", 1), (9001, "", "en", "s", 1), (None, rows[0][1], "en", "s", 1), rows[0]], DOCS)
    trusted = spark.createDataFrame([(i,) for i in good[::2]], "doc_id long")
    scorer = quality.train(docs, trusted, ~held_out())
    assert 0.05 <= scorer.prior <= 0.98
    got = quality.score(docs, scorer).collect()
    assert len(got) == len(rows) + 4 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    rest = [r for r in got if r.doc_id is not None and r.doc_id < 9000 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([r.predicted == (r.doc_id in set(good)) for r in rest]) > 0.95
    kept = quality.keep_good(docs, scorer)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in got)


def test_quality_without_positives_scores_a_half(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "s", 1), (2, None, None, None, None)], DOCS)
    assert quality.train(docs, docs.select("doc_id").limit(0), ~held_out()) is None
    assert [r.score for r in quality.score(docs, None).collect()] == [0.5, 0.5]
    assert quality.score(docs.limit(0), None).count() == 0


def test_non_negative_risk_separates_what_it_can():
    rng = np.random.default_rng(0)
    positive = rng.normal(2, 1, (500, 3))
    unlabelled = np.concatenate((rng.normal(2, 1, (600, 3)), rng.normal(-2, 1, (1400, 3))))
    prior = quality.estimate_prior(positive, unlabelled)
    assert 0.2 < prior < 0.42
    scores = quality.fit(positive, unlabelled, prior).score(unlabelled)
    assert ((scores > 0.5) == (np.arange(2000) < 600)).mean() > 0.97


def test_languages_are_told_apart_on_held_out_texts(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.randint(10, 60), {"xx": "abcdefgh", "yy": "ghijklmé", "zz": "abnopqrß"}[lang]), lang, "s", 1) for i, lang in enumerate(rng.choice(["xx", "yy", "zz"]) for _ in range(400))]
    docs = spark.createDataFrame([*rows, (900, None, "xx", "s", 1), (901, "123 !?", "xx", "s", 1), (902, "a", None, "s", 1), (903, rows[0][1] * 300, "xx", "s", 1), rows[0]], DOCS)
    got = {r.doc_id: r for r in langid.identify(docs, langid.train(docs, ~held_out())).collect()}
    rest = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert np.mean([got[r[0]].lang_pred == r[2] for r in rest]) > 0.97
    assert (got[900].lang_pred, got[901].lang_pred) == ("und", "und") and got[902].lang_pred in ("xx", "yy", "zz") and got[903].lang_pred == rows[0][2]
    assert all(0 <= r.score <= 1 for r in got.values())
    none = langid.train(docs.limit(0), ~held_out())
    assert langid.identify(docs, none).first().lang_pred == "und" and langid.identify(docs.limit(0), none).count() == 0


def test_more_languages_than_a_word_has_bits(spark):
    rng = random.Random(14)
    alphabets = {f"l{k:02d}": "".join(rng.sample("abcdefghijklmnopqrstuvwxyzéßñø", 7)) for k in range(70)}
    rows = [(i, prose(rng, 60, alphabets[lang]), lang, "s", 1) for i, lang in enumerate(list(alphabets) * 12)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"h": F.lit(1), "c": F.lit("x")})
    filters = langid.train(docs, ~held_out())
    assert len(filters.langs) == 70 and filters.words.shape[0] == 2
    rest = [r for r in langid.identify(docs, filters).collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([r.lang_pred == rows[r.doc_id][2] for r in rest]) > 0.95
    assert len(langid.grams("«» ٣٤ 🙂 …")) == 0 and len(langid.grams("«abcdef»")) == len(langid.grams("abcdef"))


def words(text):
    return len((text or "").replace("\x0b", " ").split())


def targets(sizes, weights=(5.0, 2.0, 1.0), most=3.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(order)}
    total, open_, out = float(sum(sizes.values())), set(order), {}
    while open_:
        rest = total - sum(out.values())
        share = {s: rest * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > most * sizes[s]}
        if not over:
            return out | share
        out |= {s: most * sizes[s] for s in over}
        open_ -= over
    return out


def test_mix_meets_targets_and_agrees_with_itself(spark):
    rng = random.Random(6)
    names = ["b", "a", None, "", "é", "d", "tiny"]
    rows = [(i, prose(rng, rng.randint(0, 40)) if i % 50 else None, "en", rng.choices(names, [30, 10, 5, 5, 5, 5, 1])[0], 1) for i in range(1500)]
    rows += [rows[7], rows[7]]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"size": F.lit("mine"), "_cut": F.lit(1)})
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += words(t)
    want = targets(sizes)
    taken = Counter()
    for r in got:
        assert r.size == words(r.text) and r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], abs=1e-5)
        assert r.taken == r.copies * r.size <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 120 for s in sizes)  # a document holds 40 words, three copies of one are tied
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    again = mixing.mix(docs.repartition(7)).collect()
    assert Counter((r.doc_id, r.taken) for r in again) == Counter((r.doc_id, r.taken) for r in got)
    mixed = mixing.mixed_rows(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in got) and mixed.first()["size"] == "mine"


def test_mix_by_inclusion_and_of_nothing(spark):
    rows = [(i, "w " * 10, "en", "s0" if i < 500 else "s1", 1 if i % 2 else 9) for i in range(1000)]
    got = mixing.mix(spark.createDataFrame(rows, DOCS), weights=(0.3, 0.7), inclusion="n_chars").collect()
    rate = {odd: np.mean([r.copies for r in got if r.source == "s0" and (r.n_chars == 1) == odd]) for odd in (True, False)}
    assert rate[False] > 3 * rate[True] > 0
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0
    empty = spark.createDataFrame([(1, None, None, None, None), (2, "", None, "s", 1)], DOCS)
    assert [(r.size, r.taken) for r in mixing.mix(empty).collect()] == [(0, 0), (0, 0)]


def test_the_sample_is_the_pareto_order_cut_at_the_rest(spark):
    """Against a plain ordering of each source: whole copies, then documents by random odds over inclusion odds."""
    rng = random.Random(16)
    rows = [(i, prose(rng, rng.randint(1, 60)), "en", rng.choice("aab"), 1) for i in range(400)]
    got = {r.doc_id: r for r in mixing.mix(spark.createDataFrame(rows, DOCS)).collect()}
    for source in "ab":
        mine = [r for r in got.values() if r.source == source]
        total, target = mine[0].source_size, mine[0].target
        whole = int(target / total + 1e-12)
        rest, scale = target - whole * total, sum(r.size**0.5 for r in mine)

        def rank(r):
            digest = hashlib.md5(f"{r.doc_id}:{hashlib.md5(r.text.encode()).hexdigest()}:7".encode()).hexdigest()
            u = (int(digest[:12], 16) + 0.5) / (1 << 48)
            p = min(rest / total * r.size**0.5 * len(mine) / scale, 1 - 1e-12)
            return u / (1 - u) / (p / (1 - p))

        order, upto, best = sorted(mine, key=rank), 0, (rest, 0)
        for k, r in enumerate(order, 1):
            upto += r.size
            best = min(best, (abs(upto - rest), k))
        assert [r.copies for r in order] == [whole + (k < best[1]) for k in range(len(order))]


def test_minimax_cuts_match_brute_force():
    rng = np.random.default_rng(7)
    for _ in range(60):
        sizes, shards = rng.integers(1, 30, rng.integers(1, 9)), int(rng.integers(1, 5))

        def best(i, left):
            if i == len(sizes):
                return 0
            if left == 0:
                return 10**9
            return min(max(sizes[i:j].sum(), best(j, left - 1)) for j in range(i + 1, len(sizes) + 1))

        ends = sharding.minimax_cuts(sizes, shards)
        parts = np.split(sizes, ends[:-1])
        assert len(parts) == min(shards, len(sizes)) and ends[-1] == len(sizes) and max(p.sum() for p in parts) == best(0, shards)
        assert all(len(p) for p in parts)
        cuts = [np.split(sizes, c) for c in itertools.combinations(range(1, len(sizes)), len(parts) - 1)]
        assert min(p.sum() for p in parts) == max(min(p.sum() for p in c) for c in cuts if max(p.sum() for p in c) == best(0, shards))


def test_no_shard_is_left_half_empty():
    rng = np.random.default_rng(9)
    for _ in range(20):
        sizes = rng.integers(1, 400, 4000)
        sizes[rng.integers(4000)] = 40_000  # one large atom, which sets the capacity
        parts = [p.sum() for p in np.split(sizes, sharding.minimax_cuts(sizes, 24)[:-1])]
        rest = sorted(parts)[:-1]
        assert len(parts) == 24 and rest[0] > 0.6 * np.mean(rest)  # what lies before the large atom may not divide evenly


def test_shards_are_even_whole_and_numbered(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.randint(0, 60)) if i % 9 else rng.choice(["same", "copy é", None, ""]), "en", "s", 1) for i in range(3000)]
    rows += [(None, "no id", "en", "s", 1), rows[0], rows[0]]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"size": F.lit("x"), "shard": F.lit(1)})
    got = sharding.shard(docs).toPandas()
    assert len(got) == len(rows) and set(got["law"]) == {"bytes"} and got["grown_shard"].isna().all()
    sizes = got["text"].map(lambda t: len((t or "").encode()) + 8)
    assert (got["size"] == sizes).all() and (got["text_crc32"] == got["text"].map(lambda t: zlib.crc32((t or "").encode()))).all()
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    assert got.assign(t=got["text"].fillna("")).groupby("t")["shard"].nunique().max() == 1
    by = got.groupby("shard")["size"].sum()
    assert list(by.index) == list(range(24)) and by.max() < 1.25 * by.mean() and by.min() > 0.75 * by.mean()
    assert sharding.shard(docs.limit(0)).count() == 0 and sharding.shard(docs.limit(1)).first()["slot"] == 0


def test_slots_of_many_cells(spark, monkeypatch):
    """Cells follow the rows of the largest shard; their first slots are the same by a join of tables as by a broadcast."""
    rng = random.Random(18)
    rows = [(i, prose(rng, rng.randint(0, 30)) if i % 3 else "one text of a third of all rows", "en", "s", 1) for i in range(2000)] + [(None, None, None, None, None)] * 3
    docs = spark.createDataFrame(rows, DOCS)
    want = sharding.shard(docs).toPandas()
    monkeypatch.setattr(sharding, "CELL_ROWS", 5)
    slots = []
    for most in (0, 100_000):
        monkeypatch.setattr(sharding, "BROADCAST_CELLS", most)
        got = sharding.shard(docs).toPandas()
        assert sorted(got["shard"]) == sorted(want["shard"]) and len(got) == len(rows)
        for _, part in got.groupby("shard"):
            assert sorted(part["slot"]) == list(range(len(part)))
        slots.append(got[got["doc_id"].notna()].set_index("doc_id")[["shard", "slot"]].sort_index())
    assert slots[0].equals(slots[1]) and len(got[got["text"] == rows[0][1]]["shard"].unique()) == 1


PAGE = """<!doctype html><html><head><title>No</title><style>p{}</style><script>var t = "</p>no";</script></head><body>
<nav><ul><li><a href="/a">Home</a><li><a href="/b">About</a></ul></nav><div class="cookie-banner">We use cookies, accept.</div>
<article><h1>Caf&eacute; &amp; more</h1><p>First   para\n with <b>bold</b> and <a href=x>link</a>.<p>Second &lt;one&gt; par<br>goes on here.<div class="advert">Buy now, sponsored.</div>
<ul><li>An item of it.</li></ul></article><section class="comments"><h3>Comments</h3><div class="comment"><p>Nice reply here.</p></div></section>
<aside class="sidebar"><h3>Popular</h3><a href=z>latest tags</a></aside><form><label>email</label><input></form><footer>&copy; rights reserved</footer>"""
TEXT = "Café & more\nFirst para with bold and link.\nSecond <one> par goes on here.\nAn item of it."


def test_blocks_of_a_broken_page():
    blocks = pages.leaves(PAGE)
    assert [b[1] for b in blocks][3:7] == TEXT.split("\n")[0:3] + ["Buy now, sponsored."]
    assert [b[2] for b in blocks][:2] == [1.0, 1.0]
    assert pages.leaves("") == [] and [b[1] for b in pages.leaves("plain &am text <unclosed")] == ["plain &am text"]
    assert [b[1] for b in pages.leaves("<p>a<!-- b -->c<script>x</p>")] == ["ac"]


@pytest.mark.parametrize(
    "page, want",
    [
        ('<article><p>one <svg class="i" /> two</p><p>three</p></article>', ["one two", "three"]),
        ("<article><p>one <svg/>two<svg\n data-x='>'/></p><p>three</p></article>", ["one two", "three"]),
        ("<title-card>a card</title-card><p>b</p><video-player src=x></video-player><p>c</p>", ["a card", "b", "c"]),
        ("<p>let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be</p>", ["let x=1 be"]),
        ('<p>one<svg viewBox="0"><path d="M0"/><text>no</text></svg></p><title>no</title><script src=x/>no</script><p>two', ["one", "two"]),
    ],
)
def test_silent_elements_take_no_text_beside_them(page, want):
    assert [b[1] for b in pages.leaves(page)] == want


@pytest.mark.parametrize("part", ['<p class="x>t ', "<a href='x>t ", "<div><b>t ", "<b ", "</i><b>t", '<p title="a > b">x</p>', "<!-- ", "<b>t<p>u"])
def test_broken_pages_take_time_in_proportion(part):
    page = part * (1_000_000 // len(part))
    began = time.process_time()
    pages.Vectors().of(pages.leaves(page)[:2000])
    assert time.process_time() - began < 8


def test_parts_of_the_frame_inside_an_article_go():
    """What the contract leaves out goes wherever it stands, and an article needs no name that tells of it."""
    net, vectors = pages.train(), pages.Vectors()
    rng = random.Random(21)
    say = lambda n: prose(rng, n).capitalize() + "."
    for opening, closing in (("<article>", "</article>"), ('<div class="xk1">', "</div>")):
        body = [say(30), say(50), say(40)]
        page = "<html><body><nav><a href=/>Home</a> <a href=/b>About</a></nav>" + opening + "".join(f"<p>{t}</p>" for t in body)
        page += '<section class="comments"><h3>2 comments</h3><div class="comment"><b>Ann</b> says<p>Nice reply.</p></div></section>' * (opening == "<article>")
        page += closing + "<footer>&copy; all rights reserved. Privacy, terms.</footer></body></html>"
        blocks = pages.leaves(page)
        assert [b[1] for b, keep in zip(blocks, net.predict([vectors.of(blocks)])[0]) if keep] == body, opening


def test_parts_of_a_long_page_are_labelled_as_one(monkeypatch):
    net, rng = pages.Labeller.fresh(5, 1), np.random.default_rng(2)
    long, short = rng.normal(size=(103, pages.WIDTH)).astype(np.float32), rng.normal(size=(7, pages.WIDTH)).astype(np.float32)
    whole = net.predict([short, long, short[:0]])
    x, mask = pages.padded([long])
    monkeypatch.setattr(pages, "LEAVES", 10)
    assert np.allclose(net.margins_in_parts(long), net.margins(x, mask)[:, 0], atol=1e-5)
    assert [p.tolist() for p in net.predict([short, long, short[:0]])] == [p.tolist() for p in whole]


def test_extraction_labels_blocks_of_unseen_layouts(spark):
    layouts, net, vectors = pages.Layouts(4711), pages.train(), pages.Vectors()
    wrong = total = 0
    for _ in range(150):
        blocks = pages.leaves(layouts.page())
        want = [e.label == "1" for e, *_ in blocks]
        wrong += int((net.predict([vectors.of(blocks)])[0] != want).sum()) if blocks else 0
        total += len(blocks)
    assert wrong / total < 0.01
    long = "<article>" + "".join(f"<p>Paragraph {k} of a very long page.</p>" for k in range(25_000)) + "</article>"
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, "x"), (None, "v", "", "x"), (3, "w", "<nav><a href=x>Menu</a></nav>", "x"), (4, "w", long, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = pages.extract(df, net).collect()
    assert [(r.page_id, r.text, r.n_chars) for r in got[:5]] == [(1, TEXT, len(TEXT))] * 2 + [(2, "", 0), (None, "", 0), (3, "", 0)]
    assert got[5].text.count("\n") > 24_000
    assert pages.extract(df.limit(0), net).count() == 0


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = pages.Labeller.fresh(3, 0)
    net.weights = [w.astype(np.float64) for w in net.weights]
    x = rng.normal(size=(4, 2, pages.WIDTH))
    mask = np.array([[True, True], [True, True], [True, False], [True, False]])
    y = rng.integers(0, 2, (4, 2)).astype(float)

    def loss():
        m = net.margins(x, mask)
        return (np.where(mask, np.logaddexp(0, m) - y * m, 0)).sum() / mask.sum()

    grads = net.gradients(x, mask, y)
    for k, spot in ((0, (5, 2)), (1, (1, 7)), (2, (4,)), (3, (9, 11)), (4, (0, 3)), (6, (2,)), (7, (0,))):
        w = net.weights[k]
        w[spot] += 1e-5
        up = loss()
        w[spot] -= 2e-5
        down = loss()
        w[spot] += 1e-5
        assert grads[k][spot] == pytest.approx((up - down) / 2e-5, rel=1e-5, abs=1e-9)


def test_pipeline_keeps_columns_and_drops_what_it_should(spark, tmp_path):
    import corpus_pipeline

    rows, good = quality_docs(500)
    rng = random.Random(9)
    item = prose(rng, 60)
    rows = [(i, t, "en", f"s{i % 4}", len(t)) for i, t, *_ in rows]
    clean = prose(rng, 120).capitalize() + "."
    rows += [(1000, prose(rng, 80) + " " + item + " " + prose(rng, 80) + ".", "en", "s1", 1), (1001, clean, "en", "s2", 1), (1002, clean, "en", "s3", 1)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, 1 if i in set(good) else 0, 0) for i in range(500)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    left = {r.doc_id for r in docs.collect()}
    assert 1001 in left and not {1000, 1002} & left and len(left & set(good)) > 0.97 * len(good) and len(left - set(good)) < 20
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert set(out["doc_id"]) <= left and {"shard", "slot", "size"} <= set(out.columns)
    assert isinstance(out, pd.DataFrame) and all(sorted(p["slot"]) == list(range(len(p))) for _, p in out.groupby("shard"))
