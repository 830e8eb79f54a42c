"""Near copies of whole texts: SimHash candidates by the generalised pigeonhole, verified by shingle sets.

A stage of its own beside simhash.near_duplicates: texts link where the Jaccard similarity of their sets of five-word
shingles is at least 0.8. Candidates come from fingerprints of the sets of single words, which a changed word touches
once and not in every shingle that holds it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, join_counted, shuffles_removed, tiled, whole_groups, written
from .simhash import bit_moments, majority, plan, probes, representatives, shingle_hashes, words_of

#: Tiles with more candidate pairs than this for each row are linked by a few of them first.
DENSE = 4
#: Up to so many groups of equal keys are counted in a broadcast table.
BROADCAST_GROUPS = 1_000_000
#: Fingerprints of so many bits are compared before whole sets are.
WIDE = 512
#: So many rows of a tile meet all its others at once.
ROWS_AT_ONCE = 256
#: A shingle that at most so many of the units left apart in dense tiles have is rare, and all its pairs are looked at.
RARE = 8
FACTORS = np.random.default_rng(8).integers(1, 1 << 63, WIDE // 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MIXER = np.uint64(0x9E3779B97F4A7C15)
TILE = ["part_no", "key", "tile_lo", "tile_hi"]


def shingle_set(text: str | None, words: int) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(words_of(text), words), np.uint64))


def described(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, digest, fp, fine, n) of each row: of its shingle set the 128-bit digest, the fingerprint fine and the
    size n; fp is the fingerprint of its set of words."""

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for text in frame["text"]:
                parts = words_of(text)
                shingles = np.unique(np.array(shingle_hashes(parts, words), np.uint64))
                fp = majority([xxhash.xxh64_intdigest(w, 42) for w in set(parts)])
                out.append((xxhash.xxh3_128_digest(shingles.tobytes()), fp, majority(shingles.tolist()), len(shingles)))
            rows = pd.DataFrame(out, columns=["digest", "fp", "fine", "n"])
            rows.insert(0, "doc_id", frame["doc_id"].astype("Int64").to_numpy())
            yield rows

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(of, "doc_id long, digest binary, fp long, fine long, n int")


def tile_candidates(frames: Iterator[pd.DataFrame], parts: list[tuple[list[int], int]], radius: int, fine_radius: int, ratio: float, whole: bool, ends: bool = False) -> Iterator[pd.DataFrame]:
    """Pairs of each tile within radius bits and fine_radius bits of fine, in different components so far, and near enough in size.

    A pair comes from the first part that holds it only, and there from the own key of its smaller unit only. Where rows have
    rare (see rare_shingles), pairs that are similar only if they share a rare shingle are left to sharing().
    Unless whole is set, a tile with more than DENSE pairs for each row gives the first and the last partner of each row only, or the
    partner of the least share of rare ones, and its pairs are marked dense. If ends is set, only the units (u) that have a pair are given.
    """
    masks = [(np.uint64(sum(1 << (63 - b) for b in bits)), t) for bits, t in parts]
    for block in whole_groups(frames, TILE):
        fp, own = block["fp"].to_numpy().view(np.uint64), block["own"].to_numpy()
        u, n, fine = block["u"].to_numpy(), block["n"].to_numpy().astype(np.float64), block["fine"].to_numpy().view(np.uint64)
        comp, part = (block["comp"].to_numpy() if "comp" in block else u), block["part_no"].to_numpy()
        most = n - block["rare"].to_numpy() if "rare" in block else n  # what a set may share without a rare shingle
        change = np.zeros(len(block), bool)
        change[0] = True
        for name in TILE:
            v = block[name].to_numpy()
            change[1:] |= v[1:] != v[:-1]
        starts = np.flatnonzero(change)
        left, right, marks, paired = [], [], [], np.zeros(len(block), bool)
        for s, e in zip(starts, np.append(starts[1:], len(block))):
            mine = s + np.flatnonzero(own[s:e])
            if e - s < 2 or not len(mine):
                continue
            found = []
            for at in range(0, len(mine), ROWS_AT_ONCE):
                rows = mine[at : at + ROWS_AT_ONCE]
                i, j = np.nonzero(np.bitwise_count(fp[rows][:, None] ^ fp[None, s:e]) <= radius)
                i, j = rows[i], s + j
                good = (u[i] < u[j]) & (comp[i] != comp[j]) & (np.minimum(n[i], n[j]) >= ratio * np.maximum(n[i], n[j]))
                i, j = i[good], j[good]
                good = np.bitwise_count(fine[i] ^ fine[j]) <= fine_radius
                good &= np.minimum(most[i], most[j]) * (1 + ratio) >= ratio * (n[i] + n[j]) - 1e-9
                for mask, t in masks[: part[s]]:
                    good &= np.bitwise_count((fp[i] ^ fp[j]) & mask).astype(np.int64) > t
                if ends:
                    paired[i[good]] = paired[j[good]] = True
                else:
                    found.append((i[good], j[good]))
            if ends:
                continue
            i, j = (np.concatenate(x) for x in zip(*found))
            dense = not whole and len(i) > DENSE * (e - s)
            if dense and "rare" in block:
                some = np.concatenate([best_partner(x, y, most / n) for x, y in ((i, j), (j, i))])
                i, j = i[some], j[some]
            elif dense:  # i ascends, so that these are the first and the last partner of each j
                some = np.unique(np.concatenate((np.unique(j, return_index=True)[1], len(j) - 1 - np.unique(j[::-1], return_index=True)[1])))
                i, j = i[some], j[some]
            left.append(i)
            right.append(j)
            marks.append(np.full(len(i), dense))
        if paired.any():
            yield pd.DataFrame({"u": np.unique(u[paired])})
        if left and sum(map(len, left)):
            i, j = np.concatenate(left), np.concatenate(right)
            yield pd.DataFrame({"part_no": part[i], "key": block["key"].to_numpy()[i], "a": np.minimum(u[i], u[j]), "b": np.maximum(u[i], u[j]), "dense": np.concatenate(marks)})


def best_partner(x: np.ndarray, y: np.ndarray, merit: np.ndarray) -> np.ndarray:
    """Of the pairs (x, y), for each x the place of that whose y has the most merit, the first on ties."""
    order = np.lexsort((y, -merit[y], x))
    return order[np.unique(x[order], return_index=True)[1]]


def tiles(units: DataFrame, parts: list[tuple[list[int], int]], among: DataFrame | None, *others: str) -> DataFrame:
    """The rows of units (u, fp, fine, n, others) in the tiles where they meet, sorted by tile; with among (part_no, key), in these groups only."""
    keys = probes(units, parts, "fine", "u", "n", *others)
    if among is not None:
        keys = keys.join(among, ["part_no", "key"], "left_semi")
    dealt = tiled(keys, ["part_no", "key"], "u", broadcast_up_to=BROADCAST_GROUPS).select(*TILE, "own", "fp", "fine", "u", "n", *others)
    return dealt.repartition(*TILE).sortWithinPartitions(*TILE)


def candidates(units: DataFrame, parts: list[tuple[list[int], int]], radius: int, fine_radius: int, ratio: float, among: DataFrame | None = None, whole: bool = False) -> DataFrame:
    """(part_no, key, a, b, dense) from units (u, fp, fine, n); with among (part_no, key), from these groups only, and units have comp and rare."""
    met = tiles(units, parts, among, *(["comp", "rare"] if among is not None else []))
    return written(met.mapInPandas(lambda frames: tile_candidates(frames, parts, radius, fine_radius, ratio, whole), "part_no int, key long, a long, b long, dense boolean"))


def apart_units(units: DataFrame, parts: list[tuple[list[int], int]], radius: int, fine_radius: int, ratio: float, among: DataFrame) -> DataFrame:
    """(u) of the units (u, fp, fine, n, comp) that have a pair in these groups with one of another component."""
    met = tiles(units, parts, among, "comp")
    return written(met.mapInPandas(lambda frames: tile_candidates(frames, parts, radius, fine_radius, ratio, True, ends=True), "u long").distinct())


def wide_fingerprint(shingles: np.ndarray) -> bytes:
    """WIDE bits of a shingle set: a bit is 1 if over half of the shingles' hashes, mixed anew for each 64 bits, have it."""
    out = []
    with np.errstate(over="ignore"):
        for factor in FACTORS:
            h = shingles * factor
            h ^= h >> np.uint64(29)
            out.append(majority(h * MIXER))
    return np.array(out, np.int64).tobytes()


def needed_sets(wanted: DataFrame, docs: DataFrame, units: DataFrame, words: int) -> DataFrame:
    """(u, wide, shingles) of each unit of wanted (u), from the text of one of its documents."""

    def sets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [shingle_set(t, words) for t in frame["text"]]
            yield pd.DataFrame({"digest": [xxhash.xxh3_128_digest(x.tobytes()) for x in found], "wide": [wide_fingerprint(x) for x in found], "shingles": [x.tobytes() for x in found]})

    needed = written(units.join(wanted.distinct(), "u", "left_semi").select("u", "digest", "least_id"))
    holders = needed.select(F.col("least_id").alias("_id")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = texts.join(holders, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    known = texts.select("text").mapInPandas(sets, "digest binary, wide binary, shingles binary").join(needed.select("u", "digest"), "digest")
    return written(known.dropDuplicates(["digest"]).select("u", "wide", "shingles"))


def rare_shingles(wanted: DataFrame, docs: DataFrame, units: DataFrame, words: int) -> tuple[DataFrame, DataFrame]:
    """Of the units of wanted (u), of shingles that at most RARE of them have: (shingle, u) of those that two or more have; (u, rare), how many each unit has."""

    def listed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [np.frombuffer(x, np.int64) for x in frame["shingles"]]
            yield pd.DataFrame({"u": np.repeat(frame["u"].to_numpy(), list(map(len, found))), "shingle": np.concatenate(found)})

    rows = needed_sets(wanted, docs, units, words).select("u", "shingles").mapInPandas(listed, "u long, shingle long")
    rows = written(rows)
    # a shingle of one unit is counted for it without a join
    few = written(rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("units"), F.min("u").alias("u")).where(F.col("units") <= RARE))
    shared = written(rows.join(few.where("units > 1").select("shingle"), "shingle"))
    counts = few.where("units = 1").select("u").union(shared.select("u")).groupBy("u").agg(F.count(F.lit(1)).alias("rare"))
    return shared, counts


def sharing(rare: DataFrame, units: DataFrame, radius: int, fine_radius: int, ratio: float) -> DataFrame:
    """The pairs (a, b) of units (u, fp, fine, n, comp) that share a rare shingle, by the rules of tile_candidates()."""
    pairs = rare.select("shingle", F.col("u").alias("a")).join(rare.select("shingle", F.col("u").alias("b")), "shingle").where("a < b").select("a", "b").distinct()
    for end in ("a", "b"):
        pairs = pairs.join(units.select(F.col("u").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in ("fp", "fine", "n", "comp")]), end)
    x, y = ({c: F.col(f"{end}_{c}") for c in ("fp", "fine", "n", "comp")} for end in ("a", "b"))
    near = (F.bit_count(x["fp"].bitwiseXOR(y["fp"])) <= radius) & (F.bit_count(x["fine"].bitwiseXOR(y["fine"])) <= fine_radius)
    return pairs.where((x["comp"] != y["comp"]) & (F.least(x["n"], y["n"]) >= ratio * F.greatest(x["n"], y["n"])) & near).select("a", "b")


def verified(pairs: DataFrame, docs: DataFrame, units: DataFrame, words: int, similarity: float, wide_radius: int) -> DataFrame:
    """The pairs (a, b) of units whose shingle sets have at least the Jaccard similarity.

    First the pairs meet fingerprints of WIDE bits, and those that differ in more than wide_radius go. For the others, the set of b
    is sent once a pair, and that of a once for all its pairs.
    """
    known = needed_sets(pairs.select(F.explode(F.array("a", "b")).alias("u")), docs, units, words)
    near = pairs
    for end in ("a", "b"):
        near = near.join(known.select(F.col("u").alias(end), F.col("wide").alias(f"{end}_wide")), end)

    def close(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x, y = (np.frombuffer(b"".join(frame[c]), np.uint64).reshape(len(frame), -1) for c in ("a_wide", "b_wide"))
            yield frame.loc[np.bitwise_count(x ^ y).sum(axis=1) <= wide_radius, ["a", "b"]]

    near = written(near.mapInPandas(close, "a long, b long"))

    def alike(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, own = None, np.zeros(0, np.uint64)
        for frame in frames:
            keep = []
            for u, b, raw in zip(frame["a"], frame["b"].isna(), frame["shingles"]):
                x = np.frombuffer(raw, np.uint64)
                if b:  # the set of a comes before its partners
                    a, own = u, x
                shared = len(np.intersect1d(own, x, assume_unique=True)) if u == a and not b else -1
                keep.append(shared >= similarity * (len(x) + len(own) - shared) - 1e-9)
            yield frame.loc[np.array(keep, bool), ["a", "b"]]

    firsts = near.select("a").distinct().join(known.select(F.col("u").alias("a"), "shingles"), "a").select("a", F.lit(None).cast("long").alias("b"), "shingles")
    seconds = near.join(known.select(F.col("u").alias("b"), "shingles"), "b").select("a", "b", "shingles")
    both = firsts.unionByName(seconds).repartition("a").sortWithinPartitions("a", F.col("b").asc_nulls_first())
    return written(both.mapInPandas(alike, "a long, b long"))


def classes(docs: DataFrame, radius: int = 7, fine_radius: int = 20, words: int = 5, similarity: float = 0.8, choices: tuple[int, ...] = (4,), wide_radius: int = 125) -> DataFrame:
    """Class every document with those that verified links reach: (doc_id, component_id), one row per input row.

    docs: doc_id, text and any others, which are ignored. Texts of equal shingle sets are one unit (texts of fewer
    words than a shingle are one shingle, texts without words, null ones included, one unit). Units link where their
    word fingerprints are within radius bits, their shingle fingerprints within fine_radius of 64 and wide_radius of WIDE bits (at a similarity of 0.8 some 77 of 512
    differ, and 125 is six deviations away) and the Jaccard similarity of their shingle sets is at least similarity;
    none below it link. component_id is the smallest doc_id of the class; a null doc_id stays null and is a
    component_id only of a class that has no other. An empty table gives no rows.

    Candidates of large groups are not all paired at once: in a tile of many pairs each unit meets two partners first. Of the units of such
    tiles that still have a candidate in another component, and of no others, the rare shingles are then found. Pairs that share one come from a join by them; any other pair shares common shingles only, of which most near
    copies with changes of their own have too few. Pairs that have enough meet by the unit of the least share of rare ones first, and only units that
    these links leave apart meet all others of their tile. So the result is the same as from all pairs.
    """
    with shuffles_removed(docs.sparkSession):
        return found_classes(docs, radius, fine_radius, words, similarity, choices, wide_radius)


def with_components(units: DataFrame, reached: DataFrame) -> DataFrame:
    """units with comp, the component that reached (node, component) has for u, or else u itself."""
    return units.join(reached.withColumnRenamed("node", "u"), "u", "left").withColumn("comp", F.coalesce("component", "u")).drop("component")


def found_classes(docs: DataFrame, radius: int, fine_radius: int, words: int, similarity: float, choices: tuple[int, ...], wide_radius: int) -> DataFrame:
    """What classes() says."""
    rows = written(described(docs, words))
    ones = rows.groupBy("digest").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in ("fp", "fine", "n")])
    units = written(ones.withColumn("u", F.monotonically_increasing_id()))
    least = math.ceil(similarity / (1 - similarity) - 1e-9)  # smaller sets are similar to equal ones only
    search = units.where(F.col("n") >= least).select("u", "fp", "fine", "n")
    total, both = bit_moments(search)
    reached = units.select(F.col("u").alias("node"), F.col("u").alias("component")).limit(0)
    if total > 1:
        parts = plan(total, both, radius, choices)
        some = candidates(search, parts, radius, fine_radius, similarity)
        links = verified(some.select("a", "b").distinct(), docs, units, words, similarity, wide_radius)
        reached = components(links)
        dense = some.where("dense").select("part_no", "key").distinct()
        if not dense.isEmpty():
            dense, reached = written(dense), written(reached)
            held = apart_units(with_components(search, reached), parts, radius, fine_radius, similarity, dense)
            turns = () if held.isEmpty() else (False, True)
            if turns:
                rare, counts = rare_shingles(held, docs, units, words)
                search = written(search.join(held, "u").join(counts, "u", "left").fillna(0, ["rare"]))
            for whole in turns:
                apart = with_components(search, reached)
                rest = candidates(apart, parts, radius, fine_radius, similarity, dense, whole).select("a", "b")
                if whole:
                    rest = rest.union(sharing(rare, apart, radius, fine_radius, similarity))
                rest = written(rest.distinct())
                links = links.union(verified(rest, docs, units, words, similarity, wide_radius))
                reached = written(components(links))
    of = written(units.join(reached.withColumnRenamed("node", "u"), "u", "left").select("digest", "copies", "least_id", F.coalesce("component", "u").alias("class")))
    named = of.join(of.groupBy("class").agg(F.min("least_id").alias("component_id")), "class").select("digest", "copies", "component_id")
    return join_counted(rows.select("doc_id", "digest"), written(named), "digest").select("doc_id", "component_id")


def one_of_each(docs: DataFrame, radius: int = 7, fine_radius: int = 20, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs, with their columns, that stand for their class of near copies; see simhash.representatives."""
    return representatives(docs, classes(docs, radius, fine_radius, words, similarity))
