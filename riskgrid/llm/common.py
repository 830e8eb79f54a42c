"""What several operators of this subpackage share."""

from __future__ import annotations

import math
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one side that a single comparison task holds at most, on average.
TILE_ROWS = 1024
#: Keys of more rows than this are joined by broadcast, up to so many of them (some 40 MB).
HOT_ROWS = 10_000
HOT_KEYS = 1_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, or that a checkpoint folder of the context lies in.

    Where neither is set, a session of one machine gets a temporary one; on a cluster, whose executors could not see it, this raises.
    """
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    known = sc.getCheckpointDir()
    if not (shared or known) and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not known:
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="riskgrid-"))
    return shared or sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of df with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage of df with a Parquet table in the shared folder, which takes less room than a checkpoint."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within, each finished execution's shuffle files are removed at once; for operators of many eager steps."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves remainder 0 modulo 5; an id that is null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5 == 0


def unit_hash(column: Column, seed: int) -> Column:
    """A number in [0, 1) from a 64-bit hash of column and seed."""
    return F.shiftrightunsigned(F.xxhash64(column, F.lit(seed)), 11) / F.lit(float(1 << 53))


def whole_groups(frames: Iterator[pd.DataFrame], keys: list[str], rows: int = 20_000) -> Iterator[pd.DataFrame]:
    """Cut a stream of rows sorted by keys into frames of about the given rows that never part a group."""
    held: list[pd.DataFrame] = []
    n = 0
    for frame in frames:
        if not len(frame):
            continue
        held.append(frame)
        n += len(frame)
        if n < rows:
            continue
        block = pd.concat(held, ignore_index=True)
        last = np.ones(len(block), bool)
        for key in keys:
            values = block[key].to_numpy()
            last &= values == values[-1]
        cut = len(block) - int(last.sum())
        if cut:
            yield block.iloc[:cut].reset_index(drop=True)
        held = [block.iloc[cut:].reset_index(drop=True)]
        n = len(block) - cut
    if held:
        yield pd.concat(held, ignore_index=True)


def tiled(rows: DataFrame, keys: list[str], member: str, tile_rows: int = TILE_ROWS, broadcast_up_to: int = 0) -> DataFrame:
    """Deal the rows of each group of equal keys to tiles such that any two rows of a group meet in some tile.

    A group of up to tile_rows is one tile. A larger one is cut by a hash of member into parts of about tile_rows,
    and each pair of parts is a tile of its own, so that no task ever holds a whole large group. Adds the columns
    part (of the row) and tile_lo, tile_hi (the pair of parts that meet). Where the groups are found to be at most
    broadcast_up_to, their sizes are broadcast and the rows need no shuffle here; for wide rows of few groups.
    """
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    if broadcast_up_to:
        sizes = checkpointed(sizes)
        sizes = F.broadcast(sizes) if sizes.count() <= broadcast_up_to else sizes
    parted = rows.join(sizes, keys).withColumn("_parts", F.ceil(F.col("_n") / tile_rows).cast("int"))
    parted = parted.withColumn("part", F.pmod(F.xxhash64(F.lit("tile"), F.col(member)), F.col("_parts")).cast("int"))
    return (
        parted.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
        .withColumn("tile_lo", F.least("part", "_other"))
        .withColumn("tile_hi", F.greatest("part", "_other"))
        .drop("_n", "_parts", "_other")
    )


def join_counted(rows: DataFrame, table: DataFrame, key: str, hot: int = HOT_ROWS, broadcast_up_to: int = HOT_KEYS) -> DataFrame:
    """rows joined with the one row of table for their key, where table.copies says how many rows of rows have it.

    The rows of keys with more than hot copies stay where they are and meet a broadcast table; there are at most rows /
    hot such keys, and the others' groups are small. Should even those be more than broadcast_up_to, hot is doubled until they are not.
    """
    while table.where(F.col("copies") > hot).count() > broadcast_up_to:
        hot *= 2
    few = F.broadcast(table.where(F.col("copies") > hot))
    return rows.join(few, key).unionByName(rows.join(few.select(key), key, "left_anti").join(table.where(F.col("copies") <= hot), key))


def roots(links: np.ndarray) -> np.ndarray:
    """For a symmetric boolean matrix, the smallest index that each row reaches."""
    n = len(links)
    label = np.arange(n)
    links = links | np.eye(n, dtype=bool)
    while True:
        low = np.where(links, label[None, :], n).min(axis=1)
        low = np.minimum(low, low[low])
        if (low == label).all():
            return label
        label = low


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b): one row (node, component) for each node that has an edge.

    component is the smallest node that node reaches. Alternates large stars and small stars (each node hangs its
    larger, then its smaller neighbours under the least one), which takes logarithmically many rounds; every round is
    a partial minimum and an equi-join, and its result is checkpointed. Nothing is collected but three sums.
    """

    def least(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("a").agg(F.min("b").alias("m"))

    edges = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    for _ in range(max_rounds):
        both = edges.union(edges.select("b", "a"))
        low = least(both).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = least(large)
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        edges = checkpointed(small.where("a <> b").distinct())
        found = edges.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long")), F.bit_xor(F.xxhash64("a", "b"))).first()
        if found == seen:
            break
        seen = found
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def partitions_for(spark: SparkSession, rows: int, each: int) -> int:
    """Partitions of about the given rows each, but at least the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / each))
