"""Operators that compare rows, against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from pyspark.sql import functions as F

from riskgrid.llm import copies, embeddings, lines, simhash
from riskgrid.llm.common import components, join_counted, shared_folder, written

DOCS = "doc_id long, text string, lang string, fp long, size string"


def classes(ids, linked):
    label = {i: i for i in ids}
    while True:
        new = {i: min([label[i], *(label[j] for j in ids if linked(i, j))]) for i in ids}
        if new == label:
            return label
        label = new


def texts(n=60, seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    out = []
    for _ in range(n):
        if out and rng.random() < 0.5:
            words = rng.choice(out).split(" ")
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(len(words))] = word()
            out.append(" ".join(words))
        else:
            out.append(" ".join(word() for _ in range(rng.randint(1, 200))))
    return out


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    counts = Counter(b for g in grams for b in range(64) if xxhash.xxh64_intdigest(g.encode(), 42) >> b & 1)
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(grams))


@pytest.mark.parametrize("choices", [(2,), (3,), (2, 3, 4)])
def test_simhash_classes_match_brute_force(spark, choices):
    rows = [*texts(), "", None, "ONE", "One", "Ärger x y", "a b", "w " * 50_000]
    docs = spark.createDataFrame([(i + 5, t, "en", 9, "s") for i, t in enumerate(rows)], DOCS)
    got = {r.doc_id: r for r in simhash.near_duplicates(docs, choices=choices).collect()}
    fps = {i + 5: fingerprint(t) for i, t in enumerate(rows)}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{f:016x}" for i, f in fps.items()}
    want = classes(list(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3)
    assert {i: r.component_id for i, r in got.items()} == want


def test_simhash_of_repeated_rows_and_null_ids(spark):
    rows = [(7, "same text here for all", "en", 1, "a"), (7, "same text here for all", "en", 1, "b"), (3, "same text here for all", "en", 1, "c"), (None, "same text here for all", "en", 1, "d"), (9, "quite another text altogether", "en", 1, "e")]
    docs = spark.createDataFrame(rows, DOCS)
    assert sorted((r.doc_id or -1, r.component_id) for r in simhash.near_duplicates(docs).collect()) == [(-1, 3), (3, 3), (7, 3), (7, 3), (9, 9)]
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.size for r in kept.collect()) == ["c", "d", "e"]
    twice = spark.createDataFrame([rows[0], rows[0]], DOCS)
    assert simhash.one_of_each(twice).count() == 1


def test_simhash_of_no_rows(spark):
    empty = spark.createDataFrame([], DOCS)
    assert simhash.near_duplicates(empty).count() == 0 and simhash.one_of_each(empty).count() == 0


def shingles(text):
    parts = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return frozenset(tuple(parts[i : i + 5]) for i in range(max(len(parts) - 4, 1))) if parts else frozenset()


@pytest.mark.parametrize("dense", (4, 0))  # 0: every tile is linked in two turns
def test_near_copies_against_all_pairs(spark, dense, monkeypatch):
    rng = random.Random(3)
    vocab = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(3000)]
    texts = []
    for _ in range(40):
        words = rng.choices(vocab, k=rng.randint(60, 300))
        texts.append(" ".join(words))
        for _ in range(rng.randint(0, 4)):
            changed = list(words)
            for k in rng.sample(range(len(words)), max(1, len(words) // rng.choice((25, 60, 100)))):
                changed[k] = rng.choice(vocab)
            texts.append(" ".join(changed))
    texts += [texts[0].upper(), texts[5], "", None, " \n", "one two three", "One two  three", "one two", "x " * 20_000]
    docs = spark.createDataFrame([(i + 3, t, "en", 1, "n") for i, t in enumerate(texts)], DOCS)
    monkeypatch.setattr(copies, "DENSE", dense)
    got = {r.doc_id: r.component_id for r in copies.classes(docs, radius=12, fine_radius=26, choices=(5,)).collect()}
    sets = {i + 3: shingles(t) for i, t in enumerate(texts)}
    alike = lambda i, j: sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) > 0
    assert got == classes(list(sets), alike)
    assert len(set(got.values())) < len(texts) - 20


def test_pairs_of_a_large_group_of_near_copies_grow_with_its_texts(spark, monkeypatch):
    """Copies of one text with changes of their own, most of them alike to few others; some share changes with up to 12 others and link by those only."""
    rng = random.Random(5)
    vocab = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(3000)]
    base = rng.choices(vocab, k=150)

    def changed(words, n):
        out = list(words)
        for k in rng.sample(range(len(words)), n):
            out[k] = rng.choice(vocab)
        return out

    texts = [changed(base, rng.randint(0, 9)) for _ in range(240)]
    for n in (2, 5, 12):
        own = changed(base, 7)
        texts += [changed(own, 1) for _ in range(n)]
    rng.shuffle(texts)
    sets = {i: shingles(" ".join(t)) for i, t in enumerate(texts)}
    asked, verified = [], copies.verified
    monkeypatch.setattr(copies, "verified", lambda pairs, *others: asked.append(pairs.count()) or verified(pairs, *others))
    docs = spark.createDataFrame([(i, " ".join(t), "en", 1, "n") for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: r.component_id for r in copies.classes(docs, radius=12, fine_radius=26, choices=(5,)).collect()}
    assert got == classes(list(sets), lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    assert 80 < len(set(got.values())) < 220
    assert sum(asked[1:]) < 12 * len(texts), asked  # after the first turn, which takes up to DENSE pairs a row of each tile; all pairs: 33 411


def test_shingles_are_listed_of_units_left_apart_only(spark, monkeypatch):
    """Groups of near copies that the first turn links need no shingles, and of two groups that it leaves apart shingles of one text alone meet nothing."""
    rng = random.Random(11)
    vocab = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(3000)]

    def changed(words, n):
        out = list(words)
        for k in rng.sample(range(len(words)), n):
            out[k] = rng.choice(vocab)
        return out

    bases = [rng.choices(vocab, k=150) for _ in range(6)]
    texts = [changed(base, 1) for base in bases for _ in range(12)]
    far = [changed(bases[0], 8) for _ in range(8)]  # each changed in up to 40 of its 146 shingles, less alike than 0.8 to one another
    monkeypatch.setattr(copies, "DENSE", 0)
    listed, rare_shingles = [], copies.rare_shingles

    def seen(wanted, *others):
        shared, counts = rare_shingles(wanted, *others)
        listed.append((wanted.count(), shared.count(), counts.agg(F.sum("rare")).first()[0]))
        return shared, counts

    monkeypatch.setattr(copies, "rare_shingles", seen)
    for rows in (texts, texts + far):
        sets = {i: shingles(" ".join(t)) for i, t in enumerate(rows)}
        docs = spark.createDataFrame([(i, " ".join(t), "en", 1, "n") for i, t in enumerate(rows)], DOCS)
        got = {r.doc_id: r.component_id for r in copies.classes(docs, radius=12, fine_radius=26, choices=(5,)).collect()}
        assert got == classes(list(sets), lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    assert len(listed) == 1  # nothing is left apart in the first
    wanted, shared, rare = listed[0]
    assert 8 <= wanted <= 20 and shared < rare / 2, listed


def test_recall_of_near_copies_at_the_settings_of_the_stage(spark):
    """Several hundred pairs of 0.8 or more, many of them close to it, by the stage's own radii."""
    rng = random.Random(11)
    vocab = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(3000)]
    texts = []
    for _ in range(450):
        words = rng.choices(vocab, k=rng.randint(80, 500))
        changed = list(words)
        for k in rng.sample(range(len(words)), max(1, int(len(words) * rng.choice((0.005, 0.01, 0.015, 0.02, 0.025))))):
            changed[k] = rng.choice(vocab)
        texts += [" ".join(words), " ".join(changed)]
    sets = [shingles(t) for t in texts]
    alike = [i for i in range(0, len(texts), 2) if len(sets[i] & sets[i + 1]) >= 0.8 * len(sets[i] | sets[i + 1])]
    got = {r.doc_id: r.component_id for r in copies.classes(spark.createDataFrame([(i, t, "en", 1, "n") for i, t in enumerate(texts)], DOCS)).collect()}
    found = [i for i in alike if got[i] == got[i + 1]]
    assert len(alike) > 350 and len(found) >= 0.95 * len(alike), (len(alike), len(found))
    assert all(got[i + 1] == i + 1 for i in range(0, len(texts), 2) if i not in alike)


def test_wide_fingerprints_of_alike_sets_are_within_the_radius():
    rng = np.random.default_rng(4)
    worst = 0
    for n in (5, 9, 40, 300, 2000):
        for _ in range(60):
            both = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            k = int(len(both) * 0.1)
            a, b = both[k:], both[: len(both) - k] if k else both
            x, y = (np.frombuffer(copies.wide_fingerprint(v), np.uint64) for v in (a, b))
            assert len(x) == copies.WIDE // 64
            worst = max(worst, int(np.bitwise_count(x ^ y).sum()))
    assert worst <= 125


def test_near_copies_of_repeated_rows_null_ids_and_no_rows(spark):
    rows = [(7, "same text here for all", "en", 1, "a"), (7, "same text here for all", "en", 1, "b"), (3, "same text here for all", "en", 1, "c"), (None, "same text here for all", "en", 1, "d"), (9, None, "en", 1, "e"), (9, None, None, 1, "e")]
    docs = spark.createDataFrame(rows, DOCS)
    assert sorted((r.doc_id or -1, r.component_id) for r in copies.classes(docs).collect()) == [(-1, 3), (3, 3), (7, 3), (7, 3), (9, 9), (9, 9)]
    kept = copies.one_of_each(docs.withColumn("digest", F.lit(1)).withColumn("u", F.lit(1)).withColumn("copies", F.lit(1)))
    assert kept.columns == [*docs.columns, "digest", "u", "copies"] and sorted(r.size for r in kept.collect()) == ["c", "d", "e"]
    empty = spark.createDataFrame([], DOCS)
    assert copies.classes(empty).count() == 0 and copies.one_of_each(empty).count() == 0


def test_hot_keys_are_joined_apart(spark):
    rows = spark.createDataFrame([(1, i) for i in range(9)] + [(2, 9), (3, 10), (3, 11)], "k long, x long")
    table = rows.groupBy("k").agg(F.count(F.lit(1)).alias("copies"), F.max("x").alias("m"))
    want = [(1, i, 8) for i in range(9)] + [(2, 9, 9), (3, 10, 11), (3, 11, 11)]
    for hot, most in ((1, 9), (1, 1), (100, 9), (1, 0)):
        assert sorted((r.k, r.x, r.m) for r in join_counted(rows, table, "k", hot, most).collect()) == want


def test_plan_thresholds_cover_the_radius():
    rng = np.random.default_rng(0)
    bits = rng.integers(0, 2, (500, 64)).astype(float)
    for choices in ((2,), (3,), (4,), (2, 3, 4)):
        parts = simhash.plan(500, bits.T @ bits, 3, choices)
        assert sorted(b for bits_, _ in parts for b in bits_) == list(range(64))
        assert sum(t for _, t in parts) == 3 - len(parts) + 1


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(900, i) for i in range(901, 950)] + [(5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 900 for i in range(900, 950)}


def vectors(n=700, dim=32, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    for i in range(0, n, 3):
        x[i] = x[rng.integers(n)] * rng.uniform(0.5, 4) + rng.normal(size=dim) * rng.choice([0, 0.05, 0.3])
    x[40:200] = x[40] + rng.normal(size=(160, dim)) * 0.05
    return x, rng.integers(0, 3, n)


@pytest.mark.parametrize(("leaf", "tile"), [(512, 1024), (32, 1024), (64, 24)])
def test_embedding_links_match_brute_force(spark, monkeypatch, leaf, tile):
    monkeypatch.setattr("riskgrid.llm.embeddings.tiled.__defaults__", (tile, 0))
    x, label = vectors()
    x[300:340] = x[300]  # copies
    label[300:340] = label[300]
    rows = [(i, [float(v) for v in x[i]], int(label[i]), "k") for i in range(len(x))]
    got = {r.vec_id: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, node string"), leaf=leaf).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (u @ u.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(links, False)
    found, there = sum(r.n_links for r in got.values()), int(links.sum())
    assert all(got[i].n_links <= n for i, n in enumerate(links.sum(axis=1)))  # none below the threshold, none twice
    assert found >= (0.97 if leaf < 512 else 1) * there
    if leaf == 512:
        want = classes(range(len(x)), lambda i, j: links[i, j])
        assert {i: r.component_id for i, r in got.items()} == want
        assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_embeddings_that_link_with_nothing(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [0.0, 0.0], 1), (7, [nan, 1.0], 1), (8, [inf, 1.0], 1), (9, [None, 1.0], 1), (10, [], 1), (11, [1.0, 0.0, 0.0], 1), (None, [1e-200, 0.0], 1)]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert len(got) == len(rows)
    assert {(r.vec_id, r.n_links, r.component_id) for r in got if r.vec_id is None or r.vec_id <= 2} == {(1, 3, 1), (2, 3, 1), (None, 3, 1)}
    assert all((r.n_links, r.component_id, r.kept) == (0, r.vec_id, True) for r in got if r.vec_id and r.vec_id > 2)
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def removed_lines(docs, threshold=0.8):
    seen, out = [], {}
    for doc_id, text in sorted((d, t) for d, t, *_ in docs if d is not None):
        out[doc_id] = []
        for k, line in enumerate((text or "").split("\n")):
            tokens = frozenset(re.findall(r"[^\x20\x09-\x0D]+", line))
            if tokens and any(len(tokens & t) >= threshold * len(tokens | t) - 1e-9 for t in seen):
                out[doc_id].append(k)
            if tokens:
                seen.append(tokens)
    return out


@pytest.mark.parametrize(("heads", "few"), [(1, 2), (4, 16), (4, 1024)])
def test_repeated_lines_match_brute_force(spark, monkeypatch, heads, few):
    monkeypatch.setattr(lines, "HEADS", heads)
    monkeypatch.setattr(lines, "HOT", few)
    rng = random.Random(5)
    base = [t.split(" ") for t in texts(25, 8)]
    rows = []
    for i in range(80):
        chosen = []
        for _ in range(rng.randint(0, 6)):
            words = list(rng.choice(base))[: rng.choice([3, 8, 20, 60])]
            for _ in range(rng.choice([0, 0, 1, 2])):
                words[rng.randrange(len(words))] = f"x{rng.randint(0, 40)}"
            rng.shuffle(words)
            chosen.append(rng.choice([" ", "  ", "\t"]).join(words))
        rows.append((i, "\n".join(chosen), "d", 1))
    rows += [(90, None, "d", 1), (91, "\n\n", "d", 1), (92, "é " * 30_000, "d", 1), (None, rows[3][1], "d", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, did string, line int")
    got = {r.doc_id: r for r in lines.repeated_lines(docs).collect()}
    want = removed_lines(rows)
    assert {i: [int(k) for k in r.removed.split(",") if k] for i, r in got.items() if i is not None} == want
    assert all(r.n_same + r.n_near == len(want[i]) for i, r in got.items() if i is not None) and got[None].removed == ""
    assert sum(r.n_near for r in got.values()) > 5
    clean = {r.doc_id: r for r in lines.without_repeated_lines(docs).collect()}
    assert clean[90].text is None and all(r.did == "d" for r in clean.values())
    assert clean[4].text == "\n".join(line for k, line in enumerate(rows[4][1].split("\n")) if k not in want[4])


def test_repeated_rows_do_not_repeat_their_own_lines(spark):
    docs = spark.createDataFrame([(1, "one two three four five"), (1, "one two three four five"), (2, "one two three four five\nnew words")], "doc_id long, text string")
    assert sorted((r.doc_id, r.removed) for r in lines.repeated_lines(docs).collect()) == [(1, ""), (1, ""), (2, "0")]
    assert lines.repeated_lines(docs.limit(0)).count() == 0


def test_pairs_of_similar_lines_grow_with_the_lines(spark, monkeypatch):
    """Of a group of near lines each meets one other; lines near to a third only meet the others after that."""
    rng = random.Random(13)
    base = [f"w{k}" for k in range(40)]
    rows = []
    for i in range(70):
        words = list(base)
        for k in rng.sample(range(40), 1 if i < 60 else 4):  # two lines with four changes each share too little
            words[k] = f"x{i}y{k}"
        rows.append((i, " ".join(words)))
    met, similar = [], lines.similar
    monkeypatch.setattr(lines, "similar", lambda found, *others: met.append(found.count()) or similar(found, *others))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [int(k) for k in r.removed.split(",") if k] for r in lines.repeated_lines(docs).collect()}
    assert got == removed_lines(rows) and sum(map(bool, got.values())) >= 59
    assert sum(met) < 10 * len(rows), met  # all pairs: 2415


def test_joined_postings_grow_with_the_lines(spark, monkeypatch):
    """Near copies whose rare tokens are shared leave the join."""
    rng = random.Random(17)
    base = [f"w{k}" for k in range(40)]
    rows = []
    for i in range(70):
        words = list(base)
        for k in rng.sample(range(40), 1 if i < 60 else 4):
            words[k] = f"x{i}y{k}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, " ".join([f"v{k}" for k in range(5 * i, 5 * i + 5)])) for i in range(6)] + [(200 + i, " ".join([f"v{k}" for k in range(5 * i, 5 * i + 4)])) for i in range(6)]
    made, pairs = [], lines.pairs_of_all
    monkeypatch.setattr(lines, "pairs_of_all", lambda *given: (found := pairs(*given), made.append(found.count()))[0])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [int(k) for k in r.removed.split(",") if k] for r in lines.repeated_lines(docs).collect()}
    assert got == removed_lines(rows) and sum(map(bool, got.values())) >= 65
    assert sum(made) < 10 * len(rows), made


@pytest.mark.parametrize(("ratio", "threshold"), [(1.1, 0.8), (1.5, 0.5), (2.0, 0.8)])
def test_sizes_of_similar_lines_share_a_band(spark, monkeypatch, ratio, threshold):
    """A line of every size and copies with tokens added, up to and beyond the threshold."""
    monkeypatch.setattr(lines, "BAND", ratio)
    monkeypatch.setattr(lines, "RAREST", 1)
    rows = []
    for n in (4, 5, 7, 8, 11, 12, 16, 24, 33, 48, 100):
        for more in (0, int(n / threshold) - n, int(n / threshold) - n + 1):
            words = [f"s{n}w{k}" for k in range(n)] + [f"s{n}m{more}x{k}" for k in range(more)]
            rows.append((len(rows), " ".join(words if len(rows) % 2 else words[::-1])))
    random.Random(3).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [int(k) for k in r.removed.split(",") if k] for r in lines.repeated_lines(docs, threshold).collect()}
    assert got == removed_lines(rows, threshold) and sum(map(bool, got.values())) >= 11


def test_lines_of_documents_with_ids_at_either_end(spark):
    rows = [(-(1 << 63), "one two three four five"), (-5, "one two three four five"), (3, "six one two three four five"), ((1 << 63) - 1, "one two three four five\nnew")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [int(k) for k in r.removed.split(",") if k] for r in lines.repeated_lines(docs).collect()}
    assert got == removed_lines(rows) == {rows[0][0]: [], -5: [0], 3: [0], rows[3][0]: [0]}


def test_codes_of_the_most_frequent_tokens_come_last(spark):
    """Levels fill six bits at most: a code of bit 63 would sort before all."""
    levels = F.from_json(F.lit(str([63] * (1 << 16))), "array<bigint>")
    row = spark.createDataFrame([("a b c a  d",)], "text string").select(lines.codes(F.col("text"), levels, 1 << 16).alias("c")).first()
    assert len(row.c) == 4 and min(row.c) >= 63 << 57 and row.c == sorted(row.c)


def test_many_near_lines_of_one_hot_token(spark):
    """A group of near copies beyond HOT, some near only to others than the first ones compared."""
    rng = random.Random(7)
    base = [f"w{k}" for k in range(12)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.choice([0, 1, 2, 3])):
            words[rng.randrange(len(words))] = f"v{rng.randrange(9)}"
        rows.append((i, " ".join(words), "d", 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, did string, line int")
    want = removed_lines(rows)
    before = lines.HOT
    lines.HOT = 8
    try:
        got = {r.doc_id: [int(k) for k in r.removed.split(",") if k] for r in lines.repeated_lines(docs).collect()}
    finally:
        lines.HOT = before
    assert got == want


def test_lines_that_share_one_hot_and_one_other_token_of_their_prefixes(spark, monkeypatch):
    monkeypatch.setattr(lines, "HOT", 8)
    monkeypatch.setattr(lines, "HEADS", 1)
    common = [f"c{k}" for k in range(38)]
    rows = [(i, " ".join(["hot", *common[3 * i : 3 * i + 4]]), "d", 1) for i in range(12)]
    rows += [(20 + i, "\n".join(" ".join(common[k : k + 7]) for k in range(0, 38, 7)), "d", 1) for i in range(40)]
    rows += [(70, " ".join(["cool", "hot", *common]), "d", 1), (71, " ".join([f"u{k}" for k in range(10)] + ["cool", "hot", *common]), "d", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, did string, line int")
    got = {r.doc_id: [int(k) for k in r.removed.split(",") if k] for r in lines.repeated_lines(docs).collect()}
    assert got == removed_lines(rows)
    assert got[70] == [] and got[71] == [0]


def test_shared_folder_without_the_setting(spark, monkeypatch):
    """A session of one machine gets a temporary folder and keeps it; a cluster must be told of one."""
    assert spark.conf.get("spark.checkpoint.dir", None) is None or shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    assert shared_folder(spark) == shared_folder(spark) and spark.sparkContext.getCheckpointDir()
    assert written(spark.range(3)).count() == 3

    class Cluster:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Cluster()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session())
