"""Embedding near-duplicates by a forest of random-projection trees with spill overlap."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, components, roots, tiled, unit_hash, whole_groups

#: Deepest tree: thresholds of 2 ** 18 nodes are 2 MB a tree. Leaves beyond it are compared in tiles.
DEEPEST = 18
#: Up to so many leaves (some 8 MB), their sizes are broadcast.
BROADCAST_LEAVES = 100_000
#: A node that fewer sampled vectors reach is cut at the median of its whole level.
FEW = 8


@dataclass
class Tree:
    """Each level has a random direction, each node a threshold; what lies within margin of it goes to both sides."""

    directions: np.ndarray
    cuts: list[np.ndarray]
    margin: float

    def leaves(self, x: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of each leaf that each unit vector of x reaches at its depth."""
        row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
        for level, cuts in enumerate(self.cuts):
            on = depth[row] > level
            if not on.any():
                break
            place = (x @ self.directions[level])[row] - cuts[np.where(on, node, 0)]
            left, right = on & (place < self.margin), on & (place >= -self.margin)
            node = np.concatenate((node[~on], 2 * node[left], 2 * node[right] + 1))
            row = np.concatenate((row[~on], row[left], row[right]))
        return row, node


def grow(sample: np.ndarray, dim: int, depth: int, margin: float, seed: int) -> Tree:
    """A tree whose thresholds are medians of the sampled unit vectors (0 where there are none)."""
    rng = np.random.default_rng([seed, dim])
    directions = rng.normal(size=(depth, dim))
    directions /= np.linalg.norm(directions, axis=1, keepdims=True)
    node, cuts = np.zeros(len(sample), np.int64), []
    for level in range(depth):
        place = sample @ directions[level]
        level_cuts = np.full(1 << level, np.median(place) if len(place) else 0.0)
        order = np.argsort(node, kind="stable")
        names, starts = np.unique(node[order], return_index=True)
        for name, part in zip(names, np.split(order, starts[1:])):
            if len(part) >= FEW:
                level_cuts[name] = np.median(place[part])
        cuts.append(level_cuts)
        node = 2 * node + (place >= level_cuts[node])
    return Tree(directions, cuts, margin / math.sqrt(dim))


def units(vectors: pd.Series) -> np.ndarray:
    """Vectors of one length as rows of unit length, in double precision whatever their scale."""
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def leaf_rows(frames: Iterator[pd.DataFrame], forests: dict[int, list[Tree]]) -> Iterator[pd.DataFrame]:
    """A row for each vector and leaf, with all the leaves of the vector."""
    for frame in frames:
        for dim, part in frame.groupby("dim"):
            part = part.reset_index(drop=True)
            x, depth = units(part["v"]), part["depth"].to_numpy()
            found = [tree.leaves(x, depth) for tree in forests[dim]]
            row = np.concatenate([r for r, _ in found])
            leaf = np.concatenate([node + (k << 32) for k, (_, node) in enumerate(found)])
            order = np.lexsort((leaf, row))
            row, leaf = row[order], leaf[order]
            own = np.split(leaf, np.flatnonzero(np.diff(row)) + 1)
            yield pd.DataFrame({
                "label": part["label"].to_numpy()[row], "dim": dim, "leaf": leaf, "leaves": [own[r] for r in row],
                "node": part["node"].to_numpy()[row], "copies": part["copies"].to_numpy()[row], "v": part["v"].to_numpy()[row],
            })


def met_before(a: pd.Series, b: pd.Series, leaf: int) -> np.ndarray:
    """Whether a row of a and one of b share a leaf before this one, so that their pair has been counted there."""
    sides = [[own[own < leaf] for own in side] for side in (a, b)]
    known = np.unique(np.concatenate([*sides[0], *sides[1]]))
    ones = []
    for side in sides:
        one = np.zeros((len(side), len(known)), np.float32)
        for i, own in enumerate(side):
            one[i, np.searchsorted(known, own)] = 1
        ones.append(one)
    return ones[0] @ ones[1].T > 0


def tile_links(frames: Iterator[pd.DataFrame], threshold: float) -> Iterator[pd.DataFrame]:
    """For each vector with links in a tile: (a: itself, b: the first it reaches there, links: vectors linked, copies counted).

    A pair counts in the first leaf that both vectors share, so each pair counts once.
    """
    names = ["label", "dim", "leaf", "tile_lo", "tile_hi"]
    for block in whole_groups(frames, names):
        for (_, _, leaf, lo, hi), group in block.groupby(names, sort=False):
            if len(group) < 2:
                continue
            a = group if lo == hi else group[group["part"] == lo]
            b = group if lo == hi else group[group["part"] == hi]
            if not len(a) or not len(b):
                continue
            links = units(a["v"]) @ units(b["v"]).T >= threshold
            if lo == hi:
                np.fill_diagonal(links, False)
            ia, ib = np.flatnonzero(links.any(axis=1)), np.flatnonzero(links.any(axis=0))
            if not len(ia):
                continue
            a, b, links = a.iloc[ia], b.iloc[ib], links[np.ix_(ia, ib)]
            links &= ~met_before(a["leaves"], b["leaves"], leaf)
            counts = links @ b["copies"].to_numpy(), links.T @ a["copies"].to_numpy()
            if lo == hi:
                node, n, square = a["node"].to_numpy(), counts[0], links
            else:
                node, n = np.concatenate((a["node"], b["node"])), np.concatenate(counts)
                square = np.zeros((len(node), len(node)), bool)
                square[: len(a), len(a) :], square[len(a) :, : len(a)] = links, links.T
            some = n > 0
            yield pd.DataFrame({"a": node[some], "b": node[roots(square)][some], "links": n[some]})


def comparable(label: str = "label", embedding: str = "embedding") -> Column:
    """Whether a row can link: label and vector not null, no component null or not finite, not all components zero."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    return F.coalesce(F.col(label).isNotNull() & finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, trees: int = 4, leaf: int = 512, margin: float = 0.24, fit_rows: int = 8192, seed: int = 11) -> DataFrame:
    """Link vectors of equal label whose cosine is at least threshold, and class them by links.

    vectors: vec_id, label, embedding (array of numbers); other columns are ignored. Returns one row per input row:
    vec_id, n_links (other vectors linked directly), component_id (smallest vec_id reachable, itself included) and kept
    (vec_id = component_id). Vectors that are null, empty, zero or hold null or non-finite components, and rows with a
    null label, link with nothing, nor do vectors of different lengths. Equal vectors of a label, repeated rows
    included, link with each other and are one node of the search. A row with a null vec_id takes part and is never a
    component_id unless its class has no other; kept is then whether both are null. An empty table gives no rows.

    Each distinct vector goes down `trees` trees to leaves of about `leaf` vectors of its label; at each node it also
    goes to the other side if it lies within margin / sqrt(length) of the threshold. Thresholds are medians over a
    bounded sample (fit_rows vectors); all vectors are placed. All pairs within a leaf are verified, in tiles of bounded size, so
    only pairs that no tree puts together are missed (recall is measured in the tests).
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.withColumns({"ok": comparable("label", "v"), "k1": F.xxhash64("v", F.lit(1)), "k2": F.xxhash64("v", F.lit(2))})
    slim = vectors.schema["embedding"].dataType.simpleString()
    kind = slim if slim in ("array<float>", "array<double>") else "array<double>"
    same = ["label", "k1", "k2"]
    distinct = rows.where("ok").groupBy(*same).agg(F.first("v").cast(kind).alias("v"), F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    distinct = checkpointed(distinct.withColumns({"dim": F.size("v"), "node": F.monotonically_increasing_id()}))

    sizes = distinct.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n"))
    depth = F.least(F.greatest(F.ceil(F.log2(F.col("n") / leaf)), F.lit(0)), F.lit(DEEPEST)).cast("int")
    sizes = checkpointed(sizes.select("label", "dim", depth.alias("depth")))
    dims = {r["dim"]: r["depth"] for r in sizes.groupBy("dim").agg(F.max("depth").alias("depth")).collect()}  # lengths of vectors
    share = min(1.0, 1.2 * fit_rows / max(distinct.count(), 1))
    sample = distinct.where(unit_hash(F.col("node"), seed) < share).select("dim", "v").limit(fit_rows).toPandas()
    forests = {}
    for dim, deepest in dims.items():
        known = sample.loc[sample["dim"] == dim, "v"]
        x = units(known) if len(known) else np.zeros((0, dim))
        forests[dim] = [grow(x, dim, deepest, margin, seed + k) for k in range(trees)]
    sent = spark.sparkContext.broadcast(forests)

    placed = distinct.join(sizes, ["label", "dim"]).select("label", "dim", "depth", "node", "copies", "v")
    schema = f"label string, dim int, leaf long, leaves array<long>, node long, copies long, v {kind}"
    placed = placed.mapInPandas(lambda frames: leaf_rows(frames, sent.value), schema)
    names = ["label", "dim", "leaf", "tile_lo", "tile_hi"]
    tiles = tiled(placed, ["label", "dim", "leaf"], "node", broadcast_up_to=BROADCAST_LEAVES).repartition(*names).sortWithinPartitions(*names)
    found = checkpointed(tiles.mapInPandas(lambda frames: tile_links(frames, threshold), "a long, b long, links long"))

    links = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    of = distinct.select(*same, "node", "least", "copies").join(links, "node", "left")
    of = of.join(components(found.select("a", "b")), "node", "left").withColumn("class", F.coalesce("component", "node"))
    of = checkpointed(of)
    classes = of.groupBy("class").agg(F.min("least").alias("component_id"))
    of = of.join(classes, "class").select(*same, "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    linked = rows.where("ok").select("vec_id", *same).join(of, same).select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.col("ok")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
