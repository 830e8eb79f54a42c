"""Sharding by a minimax contiguous partition."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Atoms are ranges of the digest of the text; a power of two.
ATOMS = 1 << 17
#: Rows of a shard are numbered within cells, dealt by a hash of doc_id: at least so many, and more where those of the largest shard would hold above CELL_ROWS rows.
CELLS = 64
CELL_ROWS = 50_000
#: The first slots of so many cells (some 3 MB) are broadcast; those of more are joined on the keys by which the cells are shuffled anyway.
BROADCAST_CELLS = 100_000
OVERHEAD = 8


def fits(upto: np.ndarray, capacity: int, shards: int) -> list[int] | None:
    """The ends of the greedy shards of at most capacity over prefix sums, or None if they are more than shards."""
    ends, at, n = [], 0, len(upto) - 1
    while at < n:
        if len(ends) == shards:
            return None
        end = int(np.searchsorted(upto, upto[at] + capacity, side="right")) - 1
        if end <= at:
            return None
        ends.append(end)
        at = end
    return ends


def levelled(upto: np.ndarray, capacity: int, shards: int) -> list[int]:
    """The ends of as many shards as there are atoms for, up to shards, none above capacity, whose smallest sum is largest.

    A binary search over that sum; for each, the ends that a number of shards can have are found one shard after the other.
    """
    n = len(upto) - 1
    shards = min(shards, n)
    first, before = np.searchsorted(upto, upto - capacity, side="left"), np.arange(n + 1) - 1

    def reached(least: int) -> tuple[list[np.ndarray], np.ndarray] | None:
        last = np.minimum(np.searchsorted(upto, upto - least, side="right") - 1, before)
        steps = [np.arange(n + 1) == 0]
        for _ in range(shards):
            count = np.concatenate(([0], np.cumsum(steps[-1])))
            steps.append((last >= first) & (count[last + 1] > count[np.minimum(first, n)]))
        return (steps, last) if steps[-1][n] else None

    low, high = 0, int(upto[n]) // shards
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if reached(mid) else (low, mid - 1)
    steps, last = reached(low)
    ends = [n]
    for left in range(shards - 1, 0, -1):
        at = ends[-1]
        could = first[at] + np.flatnonzero(steps[left][first[at] : last[at] + 1])
        ends.append(int(could[np.abs(upto[could] - upto[at] * left / (left + 1)).argmin()]))  # nearest to an even share
    return ends[::-1]


def minimax_cuts(sizes: np.ndarray, shards: int) -> list[int]:
    """The ends of at most the given contiguous shards of the ordered sizes whose largest sum is least.

    A binary search finds the smallest capacity that the greedy cut keeps to; under it, the shards are cut as even as they can be.
    """
    upto = np.concatenate(([0], np.cumsum(sizes.astype(np.int64))))
    if not len(sizes):
        return []
    low, high = max(int(sizes.max()), -(-int(upto[-1]) // shards)), int(upto[-1])
    while low < high:
        mid = (low + high) // 2
        if fits(upto, mid, shards) is None:
            low = mid + 1
        else:
            high = mid
    return levelled(upto, low, shards)


def number_of(atom: Column, firsts: list[int], low: int = 0, high: int | None = None) -> Column:
    """How many of the ascending firsts are at most atom, by halving."""
    high = len(firsts) if high is None else high
    if low == high:
        return F.lit(low)
    mid = (low + high) // 2
    return F.when(atom < firsts[mid], number_of(atom, firsts, low, mid)).otherwise(number_of(atom, firsts, mid + 1, high))


def shard(docs: DataFrame, shards: int = 24, atoms: int = ATOMS) -> DataFrame:
    """Put whole documents into shards of nearly equal bytes, equal texts together (law bytes).

    docs: doc_id, text and any others; all are kept, and size (UTF-8 bytes of the text, none for null, plus 8),
    text_crc32 (that of no bytes for a null text), law, shard, slot (0, 1, ... within the shard) and grown_shard (null) are added,
    in place of columns of those names. The order is that of the MD5 digest of the text; an atom is what falls into one
    of atoms equal ranges of it, so equal texts are never parted (null counts as the empty text here). The atoms' sizes,
    at most atoms numbers, go to the driver, which finds the smallest capacity that contiguous shards of whole atoms
    need, and cuts them under it as even as it can. A group of equal texts above the mean shard size is a shard of its own size, as no law that keeps it whole can
    split it. Rows of equal texts and ids, and those with a null id, are numbered one by one. An empty table gives no rows.

    Slots need no sort of a whole shard: rows are numbered within cells of a shard by a hash of doc_id, whose number goes
    with the rows of the largest shard, and the cells' counts give each cell its first slot.
    """
    mine = ["size", "text_crc32", "law", "shard", "slot", "grown_shard", "_atom", "_cell", "_first"]
    width = 5
    base = docs.drop(*mine).withColumns({
        "size": F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + OVERHEAD,
        "text_crc32": F.crc32(F.coalesce("text", F.lit(""))),
        "law": F.lit("bytes"),
        "_atom": F.floor(F.conv(F.substring(F.md5(F.coalesce("text", F.lit(""))), 1, width), 16, 10).cast("long") * atoms / (1 << 4 * width)).cast("int"),
    })
    rows = base.groupBy("_atom").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n")).orderBy("_atom").collect()  # at most atoms rows
    at, sizes = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
    firsts = [int(at[e]) for e in minimax_cuts(sizes, shards)[:-1]]
    held = np.bincount(np.searchsorted(np.array(firsts, np.int64), at, side="right"), weights=[r[2] for r in rows], minlength=1)
    cells = max(CELLS, -(-int(held.max()) // CELL_ROWS))
    base = base.withColumns({"shard": number_of(F.col("_atom"), firsts).cast("int"), "_cell": F.pmod(F.xxhash64("doc_id", F.lit("slot")), F.lit(cells)).cast("int")})
    before = Window.partitionBy("shard").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = base.groupBy("shard", "_cell").agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select("shard", "_cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first"))
    offsets = F.broadcast(offsets) if shards * cells <= BROADCAST_CELLS else offsets
    within = Window.partitionBy("shard", "_cell").orderBy("doc_id", "text_crc32", "size")
    out = base.join(offsets, ["shard", "_cell"]).withColumn("slot", F.col("_first") + F.row_number().over(within) - 1)
    kept = [c for c in docs.columns if c not in mine]
    return out.select(*kept, "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
