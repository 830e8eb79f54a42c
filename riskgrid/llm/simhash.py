"""SimHash near-duplicates by a generalised pigeonhole search."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, components, join_counted, roots, tiled, whole_groups

#: A-Z to a-z; no other byte changes, those of other letters included.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
BITS = 64
#: Shingles whose bits are counted at once.
BLOCK = 1 << 14
#: Up to so many ids (8 MB) are broadcast.
BROADCAST_IDS = 1_000_000


def words_of(text: str | None) -> list[bytes]:
    """The lower-cased words of a whole text; none for null."""
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()  # bytes.split() cuts at \x20 and \x09-\x0D


def shingle_hashes(parts: list[bytes], words: int) -> list[int]:
    """XXH64 of each shingle of that many words, repeats included; fewer words are one shingle."""
    if not parts:
        return []
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(words, len(parts))
    digest = xxhash.xxh64_intdigest
    return [digest(joined[s:e], 42) for s, e in zip(starts[: len(parts) - width + 1].tolist(), ends[width - 1 :].tolist())]


def majority(hashes: list[int] | np.ndarray) -> int:
    """The signed 64-bit fingerprint of some hashes: a bit is 1 if over half of them have it; 0 for none."""
    total = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), BLOCK):
        block = np.array(hashes[i : i + BLOCK], dtype=">u8")
        total += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * total > len(hashes)).tobytes(), "big", signed=True)


def fingerprint(text: str | None, words: int = 3) -> int:
    """The signed 64-bit fingerprint of a whole text; 0 for null and for texts without words."""
    return majority(shingle_hashes(words_of(text), words))


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp) of each row of docs."""

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "fp": np.array([fingerprint(t, words) for t in frame["text"]], np.int64)})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(of, "doc_id long, fp long")


def bit_moments(fps: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints, and for each pair of bits how many have both set, over all rows of fps."""

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, both = 0, np.zeros((BITS, BITS), np.int64)
        for frame in frames:
            bits = np.unpackbits(frame["fp"].to_numpy().astype(">i8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32)
            n += len(bits)
            both += np.rint(bits.T @ bits).astype(np.int64)
        yield pd.DataFrame({"bit": range(BITS), "n": n, "both": list(both)})

    sums = fps.select("fp").mapInPandas(of, "bit int, n long, both array<long>")
    rows = sums.groupBy("bit").agg(F.sum("n").alias("n"), *[F.sum(F.col("both")[j]).alias(f"b{j}") for j in range(BITS)]).collect()
    both = np.zeros((BITS, BITS))
    for row in rows:
        both[row["bit"]] = row[2:]
    return (rows[0]["n"] if rows else 0), both


def correlated_groups(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Deal the 64 bits to parts of nearly equal width, each grown by the bit most correlated with those it has."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    free, groups = set(range(BITS)), []
    for k in range(parts):
        width = BITS // parts + (k < BITS % parts)
        group = [max(sorted(free), key=lambda b: corr[b, sorted(free)].sum())]
        free.remove(group[0])
        while len(group) < width:
            best = max(sorted(free), key=lambda b: corr[b, group].sum())
            group.append(best)
            free.remove(best)
        groups.append(sorted(group))
    return groups


def close_share(differ: np.ndarray, radius: int) -> float:
    """The share of pairs that differ at no more than radius of the bits, given each bit's share of differing pairs."""
    if radius < 0:
        return 0.0
    at = np.zeros(radius + 2)
    at[0] = 1
    for d in differ:
        at = at * (1 - d) + np.concatenate(([0], at[:-1])) * d
    return float(at[: radius + 1].sum())


def plan(n: int, both: np.ndarray, radius: int = 3, choices: tuple[int, ...] = (2, 3, 4), probe_cost: float = 4.0) -> list[tuple[list[int], int]]:
    """The cheapest [(bits, threshold)]: two fingerprints within radius are within the threshold of some part.

    With m parts, thresholds that sum to radius - m + 1 suffice (a part of threshold -1 is not probed). For each m, a
    dynamic programme over parts and the sum so far picks thresholds of least cost, where the cost of a part is the
    expected number of candidate pairs plus probe_cost for each probe. Estimates come from the bit statistics of all
    fingerprints.
    """
    p = np.diag(both) / max(n, 1)
    differ = np.clip(2 * p * (1 - p), 1e-3, 1)
    best: tuple[float, list[tuple[list[int], int]]] = (math.inf, [])
    for m in choices:
        groups, need = correlated_groups(n, both, m), radius - m + 1
        states: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for group in groups:
            step: dict[int, tuple[float, list[int]]] = {}
            for done, (cost, chosen) in states.items():
                for t in range(-1, radius + 1):
                    probes = sum(math.comb(len(group), k) for k in range(t + 1))
                    c = cost + n * n / 2 * close_share(differ[group], t) + probe_cost * n * probes
                    if done + t <= max(need, 0) + m and c < step.get(done + t, (math.inf,))[0]:
                        step[done + t] = (c, [*chosen, t])
            states = step
        cost, chosen = states[need]
        if cost < best[0]:
            best = (cost, list(zip(groups, chosen)))
    return best[1]


def probes(fps: DataFrame, parts: list[tuple[list[int], int]], *others: str) -> DataFrame:
    """(part_no, key, own, fp, others): the key of each fingerprint in each probed part, and all keys within the threshold.

    own marks the fingerprint's own key; two fingerprints are compared where at least one has its own.
    """

    def of(k: int, bits: list[int], t: int) -> Column:
        own = F.col("fp").bitwiseAND(F.lit(signed(sum(1 << (63 - b) for b in bits))))
        flips = [signed(sum(1 << (63 - b) for b in some)) for r in range(t + 1) for some in combinations(bits, r)]
        return F.transform(F.array(*[F.lit(x) for x in flips]), lambda x: F.struct(F.lit(k).alias("part_no"), own.bitwiseXOR(x).alias("key"), (x == 0).alias("own")))

    keys = F.concat(*[of(k, bits, t) for k, (bits, t) in enumerate(parts) if t >= 0])
    return fps.select("fp", *others, F.explode(keys).alias("k")).select("k.part_no", "k.key", "k.own", "fp", *others)


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def tile_links(frames: Iterator[pd.DataFrame], radius: int) -> Iterator[pd.DataFrame]:
    """Edges that connect what is linked within each tile: at most one less than its rows for a tile."""
    names = ["part_no", "key", "tile_lo", "tile_hi"]
    for block in whole_groups(frames, names):
        fp, own = block["fp"].to_numpy().view(np.uint64), block["own"].to_numpy()
        change = np.zeros(len(block), bool)
        change[0] = True
        for name in names:
            v = block[name].to_numpy()
            change[1:] |= v[1:] != v[:-1]
        starts = np.flatnonzero(change)
        sizes = np.diff(np.append(starts, len(block)))
        found: list[np.ndarray] = []
        for size in np.unique(sizes[(sizes > 1) & (sizes <= 32)]):
            at = starts[sizes == size]
            for i, j in combinations(range(size), 2):
                a, b = at + i, at + j
                hit = (np.bitwise_count(fp[a] ^ fp[b]) <= radius) & (own[a] | own[b])
                found.append(np.stack((fp[a[hit]], fp[b[hit]]), axis=1))
        for s, size in zip(starts[sizes > 32], sizes[sizes > 32]):
            f, o = fp[s : s + size], own[s : s + size]
            links = (np.bitwise_count(f[:, None] ^ f[None, :]) <= radius) & (o[:, None] | o[None, :])
            root = roots(links)
            hung = np.flatnonzero(root != np.arange(size))
            found.append(np.stack((f[hung], f[root[hung]]), axis=1))
        if found:
            pairs = np.concatenate(found).view(np.int64)
            pairs = pairs[pairs[:, 0] != pairs[:, 1]]
            if len(pairs):
                yield pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})


def near_duplicates(docs: DataFrame, radius: int = 3, words: int = 3, choices: tuple[int, ...] = (2, 3, 4)) -> DataFrame:
    """Class every document with those whose SimHash fingerprints are linked by steps of at most radius bits.

    docs: doc_id, text and any others. Returns doc_id, fingerprint (16 hexadecimal digits) and component_id, the
    smallest doc_id of the class, one row per input row. A null or empty text has fingerprint zero and links like any
    other. Repeated rows and equal texts are one fingerprint before any comparison. A null doc_id stays null and
    takes part in links; it is never a component_id unless its class has no other id. An empty table gives no rows.

    The search groups correlated bits into parts with thresholds of their own (see plan), probes each part, verifies
    whole fingerprints within tiles of bounded size, and joins links by distributed star contraction.
    """
    fps = checkpointed(fingerprints(docs, words))
    return join_counted(fps, classes(fps, radius, choices), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def classes(fps: DataFrame, radius: int, choices: tuple[int, ...]) -> DataFrame:
    """(fp, component_id, copies) of each distinct fingerprint of fps (doc_id, fp); copies counts its rows."""
    distinct = checkpointed(fps.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("copies")))
    n, both = bit_moments(distinct)
    if n < 2:
        return distinct.select("fp", F.col("least_id").alias("component_id"), "copies")
    names = ["part_no", "key", "tile_lo", "tile_hi"]
    tiles = tiled(probes(distinct, plan(n, both, radius, choices)), ["part_no", "key"], "fp").repartition(*names).sortWithinPartitions(*names)
    edges = tiles.select(*names, "fp", "own").mapInPandas(lambda frames: tile_links(frames, radius), "a long, b long")
    linked = components(edges)
    of = distinct.join(linked, distinct["fp"] == linked["node"], "left").select("fp", "least_id", "copies", F.coalesce("component", "fp").alias("class"))
    of = checkpointed(of)
    return checkpointed(of.join(of.groupBy("class").agg(F.min("least_id").alias("component_id")), "class").select("fp", "component_id", "copies"))


def one_of_each(docs: DataFrame, radius: int = 3, words: int = 3, choices: tuple[int, ...] = (2, 3, 4)) -> DataFrame:
    """The rows of docs that stand for their class of near_duplicates; see representatives."""
    return representatives(docs, near_duplicates(docs, radius, words, choices))


def representatives(docs: DataFrame, members: DataFrame) -> DataFrame:
    """The rows of docs, with their columns, that stand for their class: those whose doc_id is its component_id.

    members: (doc_id, component_id) of every row of docs. Of rows that share such a doc_id one stays, the first by text
    digest. A row without a doc_id can't be told from others by it and stays.

    Texts are not shuffled while the ids to remove are at most BROADCAST_IDS (they are broadcast then; beyond that, an
    anti join hashed on doc_id removes them); only the rows of repeated doc_ids, if any, are grouped, by a minimum.
    """
    members = checkpointed(members.where("doc_id is not null").select("doc_id", "component_id"))
    removed = members.where("doc_id <> component_id").select("doc_id").distinct()
    again = checkpointed(members.groupBy("doc_id").count().where("count > 1").select("doc_id").join(removed, "doc_id", "left_anti"))
    out = without(docs, removed.union(again))
    if again.isEmpty():
        return out
    first = F.min_by(F.struct(*docs.columns), F.coalesce(F.md5("text"), F.lit("")))
    repeated = docs.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(first.alias("row")).select("row.*")
    return out.unionByName(repeated)


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    ids = checkpointed(ids.distinct())
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_anti").select(*docs.columns)
