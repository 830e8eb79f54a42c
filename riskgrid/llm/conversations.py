"""The prefix trie of conversations, summed over its subtrees along heavy paths."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import join_counted, shuffles_removed, written
from .spelling import CRC_TABLE, crc_sql

#: A sequence of turns x0, x1, ... is known by the sum of x_i * BASE ** i modulo PRIME, where x_i is the MD5 of role and text.
PRIME = (1 << 127) - 1
BASE = int.from_bytes(hashlib.md5(b"turn").digest(), "big") % PRIME
UNBASE = pow(BASE, -1, PRIME)
ROOT = bytes(16)
#: Conversations that share a head come in rows of FAMILY ids; a head has fewer than HEADS turns.
FAMILY, HEADS = 5, 9
#: Nodes of a path that are summed in one go; a longer path is summed in blocks.
BLOCK = 4096
#: Ids that are joined to one piece of text before pieces of a node meet.
PIECE = 4096


def number(key: bytes) -> int:
    return int.from_bytes(key, "big")


def key_of(n: int) -> bytes:
    return n.to_bytes(16, "big")


def head_length(conv_id: str) -> Column:
    return (F.crc32(F.col(conv_id).cast("string")) % HEADS).cast("int")


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, before, after, bytes) of (conv_id, turn, role, text): the place of each turn, and the keys of what precedes it and of it with that.

    Turns are ordered by turn (null first), role and text. The whole table is ordered by range, so that a long conversation lies in several
    partitions; each numbers its own part, and what the first conversation of a partition brings along from earlier ones is added from
    a table of one row a partition.
    """
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text", "_row"]
    digest = F.unhex(F.md5(F.concat_ws(":", F.octet_length("role"), "role", "text")))
    rows = turns.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = rows.select("conv_id", digest.alias("x"), F.octet_length("text").cast("long").alias("bytes"))

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, first, conv, n, total, power = TaskContext.get().partitionId(), None, None, 0, 0, 1
        for frame in frames:
            pos, before, after, lead = [], [], [], []
            for c, x in zip(frame["conv_id"], frame["x"]):
                if c != conv:
                    first = c if conv is None else first
                    conv, n, total, power = c, 0, 0, 1
                pos.append(n)
                before.append(key_of(total))
                total = (total + number(x) * power) % PRIME
                after.append(key_of(total))
                lead.append(c == first)
                n, power = n + 1, power * BASE % PRIME
            yield pd.DataFrame({"part": part, "lead": lead, "conv_id": frame["conv_id"], "pos": pos, "before": before, "after": after, "bytes": frame["bytes"]})

    local = written(rows.mapInPandas(scan, "part int, lead boolean, conv_id long, pos long, before binary, after binary, bytes long"))
    ends = local.groupBy("part").agg(
        F.min("conv_id").alias("first"), F.max("conv_id").alias("last"), F.max_by("after", F.struct("conv_id", "pos")).alias("key"), F.max(F.struct("conv_id", "pos"))["pos"].alias("pos")
    )
    brought: dict[int, tuple[int, int]] = {}
    conv, n, total = None, 0, 0
    for part, first, last, key, pos in sorted(map(tuple, ends.collect())):  # a row a partition
        if first == conv:
            brought[part] = (n, total)
        n, total = (n, total) if first == last == conv else (0, 0)
        total = (total + number(key) * pow(BASE, n, PRIME)) % PRIME
        conv, n = last, n + pos + 1
    if not brought:
        return local.drop("part", "lead")
    sent = local.sparkSession.sparkContext.broadcast(brought)

    def completed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part in set(frame.loc[frame["lead"], "part"]) & set(sent.value):
                n, total = sent.value[part]
                power = pow(BASE, n, PRIME)
                at = frame.index[frame["lead"] & (frame["part"] == part)]
                frame.loc[at, "pos"] += n
                for c in ("before", "after"):
                    frame.loc[at, c] = pd.Series([key_of((total + number(k) * power) % PRIME) for k in frame.loc[at, c]], at)
            yield frame.drop(columns=["part", "lead"])

    return local.mapInPandas(completed, "conv_id long, pos long, before binary, after binary, bytes long")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations: (conv_id, length), and their prefixes (conv_id, depth, key, parent, bytes, last).

    A conversation c is the first h turns of conversation c - c % 5 (h = crc32 of c % 9; all of them if fewer, none if it is absent),
    then its own turns after its first h. Keys are sums, so the key of a rebuilt prefix follows from those of the two originals.
    """
    rows = numbered(turns)
    early = F.when(F.col("pos") < HEADS - 1, F.struct("pos", "after", "bytes"))
    convs = written(rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"), F.sort_array(F.collect_list(early)).alias("early")))
    base = convs.select(F.col("conv_id").alias("base"), F.col("early").alias("head"))
    facts = convs.withColumns({"base": F.col("conv_id") - F.col("conv_id") % FAMILY, "h": head_length("conv_id")}).join(base, "base", "left")
    facts = facts.withColumn("head", F.coalesce(F.expr("slice(head, 1, h)"), F.expr("slice(early, 1, 0)")))

    def state(turns: str, n: Column) -> Column:
        return F.coalesce(F.get(F.col(turns), n.cast("int") - 1)["after"], F.lit(ROOT))

    facts = facts.withColumns({"shared": F.size("head"), "length": F.size("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0))})
    facts = written(facts.withColumns({"skipped": state("early", F.least(F.col("h"), F.size("early"))), "start": state("head", F.col("shared"))}).drop("early", "base", "own"))

    each = F.posexplode(F.transform("head", lambda t, i: F.struct(t["after"].alias("key"), F.coalesce(F.get("head", i - 1)["after"], F.lit(ROOT)).alias("parent"), t["bytes"].alias("bytes"))))
    heads = facts.select("conv_id", "length", each.alias("d", "t")).select("conv_id", (F.col("d") + 1).cast("long").alias("depth"), "t.key", "t.parent", "t.bytes", (F.col("d") + 1 == F.col("length")).alias("last"))

    def keyed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            parent, key = [], []
            for before, after, start, skipped, shift in zip(frame["before"], frame["after"], frame["start"], frame["skipped"], frame["shift"]):
                if shift == 0 and start == skipped:  # its own head
                    parent.append(before)
                    key.append(after)
                    continue
                a, b, back = number(start), number(skipped), pow(UNBASE, int(shift), PRIME) if shift else 1
                parent.append(key_of((a + (number(before) - b) * back) % PRIME))
                key.append(key_of((a + (number(after) - b) * back) % PRIME))
            yield pd.DataFrame({"conv_id": frame["conv_id"], "depth": frame["depth"], "key": key, "parent": parent, "bytes": frame["bytes"], "last": frame["last"]})

    tails = rows.join(facts.drop("head"), "conv_id").where("pos >= h").withColumns({"shift": F.col("h") - F.col("shared"), "depth": F.col("pos") + 1 - F.col("h") + F.col("shared")})
    tails = tails.select("conv_id", "depth", "before", "after", "start", "skipped", "shift", "bytes", (F.col("depth") == F.col("length")).alias("last"))
    tails = tails.mapInPandas(keyed, "conv_id long, depth long, key binary, parent binary, bytes long, last boolean")
    return facts.select("conv_id", "length"), written(heads.unionByName(tails))


def ends_digests(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256) of (key, conv_id): the SHA-256 of each key's ids in ascending order, comma-joined.

    Ids are ordered by range and joined to pieces of text where they lie, so that a key of very many ids is read as few rows, one after the other.
    """
    order = ["key", "conv_id"]

    def pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, []

        def out() -> pd.DataFrame:
            return pd.DataFrame({"key": [key], "first": [held[0]], "text": [",".join(map(str, held))]})

        for frame in frames:
            done = []
            for k, c in zip(frame["key"], frame["conv_id"]):
                if held and (k != key or len(held) == PIECE):
                    done.append(out())
                    held = []
                key = k
                held.append(c)
            if done:
                yield pd.concat(done)
        if held:
            yield out()

    def digests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, sha = None, None
        for frame in frames:
            done = []
            for k, text in zip(frame["key"], frame["text"]):
                if k == key:
                    sha.update(b"," + text.encode())
                    continue
                if sha:
                    done.append((key, sha.hexdigest()))
                key, sha = k, hashlib.sha256(text.encode())
            yield pd.DataFrame(done, columns=["key", "ends_sha256"])
        if sha:
            yield pd.DataFrame([(key, sha.hexdigest())], columns=["key", "ends_sha256"])

    text = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(pieces, "key binary, first long, text string")
    return text.repartition("key").sortWithinPartitions("key", "first").mapInPandas(digests, "key binary, ends_sha256 string")


def heavy_paths(nodes: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Add path and heavy to nodes: each node's path is named by the conversation that ends at its lower end.

    The heavy child of a node is the one of most members (ties: of smallest member), so a step to another child at
    least halves the members. Every path ends at a leaf, and the leaf's smallest member runs along all of it: the path is what that
    conversation passes after its last light step. No rounds are needed to find the paths.
    """
    heavy = nodes.where("depth > 0").groupBy("parent").agg(F.max(F.struct("n_convs", -F.col("conv_id"), "key"))["key"].alias("key")).select("key", F.lit(True).alias("heavy"))
    nodes = written(nodes.join(heavy, "key", "left").withColumn("heavy", F.coalesce("heavy", F.lit(False))))
    leaves = nodes.where("n_children = 0").select("conv_id")
    along = prefixes.join(leaves, "conv_id", "left_semi").select(F.col("conv_id").alias("path"), "key")
    along = join_counted(along, nodes.where("depth > 0").withColumn("copies", F.col("n_convs")), "key")
    root = nodes.where("depth = 0")
    along = written(along.unionByName(leaves.withColumnRenamed("conv_id", "path").crossJoin(F.broadcast(root.drop("heavy"))).withColumns({"heavy": F.lit(False), "copies": F.lit(0)})))  # root is one row
    light = along.where("not heavy").groupBy("path").agg(F.max("depth").alias("_from"))
    return along.join(light, "path").where("depth >= _from").drop("_from", "copies")


def subtree_sums(nodes: DataFrame, values: list[str], max_rounds: int = 64) -> DataFrame:
    """Replace the values of each node of heavy_paths() by their sums over its subtree.

    Sums of whole paths go up to the paths that they hang from, one light step a round, of which there are at most
    the logarithm of the number of conversations. Each path's sum is then added to the node that it hangs from, and sums from the
    lower end run along the paths, in blocks of a path.
    """
    sums = [F.sum(v).alias(v) for v in values]
    up = written(nodes.where("not heavy and depth > 0").select("path", "parent", "parent_path"))
    reached = [written(nodes.groupBy("path").agg(*sums))]
    for _ in range(max_rounds):
        further = written(reached[-1].join(up, "path").groupBy(F.col("parent_path").alias("path")).agg(*sums))
        if not further.head(1):
            break
        reached.append(further)
    else:
        raise RuntimeError("paths did not settle")
    total = reached[0]
    for more in reached[1:]:
        total = total.unionByName(more)
    hung = total.groupBy("path").agg(*sums).join(up, "path").groupBy(F.col("parent").alias("key")).agg(*[F.sum(v).alias(f"_{v}") for v in values])
    nodes = nodes.join(hung, "key", "left").withColumns({v: F.col(v) + F.coalesce(f"_{v}", F.lit(0)) for v in values})
    nodes = written(nodes.drop(*[f"_{v}" for v in values]).withColumn("_block", F.floor(F.col("depth") / BLOCK)))
    later = Window.partitionBy("path").orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = nodes.groupBy("path", "_block").agg(*sums).select("path", "_block", *[F.coalesce(F.sum(v).over(later), F.lit(0)).alias(f"_{v}") for v in values])
    upto = Window.partitionBy("path", "_block").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = nodes.withColumns({v: F.sum(v).over(upto) for v in values}).join(blocks, ["path", "_block"])
    return out.withColumns({v: F.col(v) + F.col(f"_{v}") for v in values}).drop("_block", *[f"_{v}" for v in values])


def trie(conversations: DataFrame) -> DataFrame:
    """One row for each node of the prefix trie of the rebuilt conversations.

    conversations: conv_id, turn, role, text; other columns are ignored. Rows without a conv_id are left out; a null role or text is
    empty; turns of equal turn are ordered by role and text, and repeated rows are turns of their own. Returns conv_id
    (smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves, saved_tokens and
    ends_sha256; conversations without turns are members of the root. An empty table gives no nodes.
    """
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]
    with shuffles_removed(conversations.sparkSession):
        convs, prefixes = rebuilt(conversations.where("conv_id is not null").select(F.col("conv_id").cast("long"), "turn", *text))
        root = convs.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0")
        root = root.select(F.lit(ROOT).alias("key"), "n_convs", "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("bytes"))
        nodes = prefixes.groupBy("key").agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), *[F.first(c).alias(c) for c in ("depth", "parent", "bytes")])
        nodes = written(nodes.unionByName(root))
        kids = nodes.where("depth > 0").groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
        nodes = written(nodes.join(kids, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
        nodes = written(heavy_paths(nodes, prefixes))
        above = nodes.where("n_children > 0").select(F.col("key").alias("parent"), F.col("path").alias("parent_path"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("copies"))
        none = {"parent_path": F.lit(None).cast("long"), "parent_conv_id": F.lit(None).cast("long"), "copies": F.lit(0).cast("long")}
        nodes = join_counted(nodes.where("depth > 0"), above, "parent").unionByName(nodes.where("depth = 0").withColumns(none)).drop("copies")
        nodes = written(nodes.withColumns({"saved_tokens": (F.col("n_convs") - 1) * F.col("bytes"), "n_leaves": (F.col("n_children") == 0).cast("long")}))
        summed = subtree_sums(nodes, ["saved_tokens", "n_leaves"])
        ends = prefixes.where("last").select("key", "conv_id").unionByName(convs.where("length = 0").select(F.lit(ROOT).alias("key"), "conv_id"))
        digests = written(ends_digests(ends))
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return summed.join(digests, "key", "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", empty).alias("ends_sha256"))


ORACLE = f"""
WITH {CRC_TABLE},
o AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL),
conv AS (SELECT c, {crc_sql("c::VARCHAR")} % 9 AS h FROM (SELECT DISTINCT c FROM o), crc_table),
r AS (SELECT conv.c, role, text, 0 AS own, pos FROM conv JOIN o ON o.c = conv.c - conv.c % 5 AND pos < h
  UNION ALL SELECT conv.c, role, text, 1, pos FROM conv JOIN o ON o.c = conv.c AND pos >= h),
p AS (SELECT c, 0 AS d, CAST([] AS STRUCT(role VARCHAR, text VARCHAR)[]) AS seq, 0 AS bytes FROM conv
  UNION ALL SELECT c, row_number() OVER w, list(struct_pack(role := role, text := text)) OVER w, octet_length(encode(text)) FROM r WINDOW w AS (PARTITION BY c ORDER BY own, pos ROWS UNBOUNDED PRECEDING)),
node AS (SELECT seq, any_value(d) AS d, min(c) AS c, count(*) AS n, any_value(bytes) AS bytes FROM p GROUP BY seq),
id AS (SELECT p.c, p.d, node.c AS first, node.n, node.bytes FROM p JOIN node ON p.seq = node.seq),
edge AS (SELECT node.c, node.d, id.first AS parent FROM node LEFT JOIN id ON id.c = node.c AND id.d = node.d - 1),
kids AS (SELECT parent AS c, d - 1 AS d, count(*) AS n FROM edge WHERE d > 0 GROUP BY ALL),
under AS (SELECT id.first AS c, id.d, sum((node.n - 1) * node.bytes) AS saved, sum((kids.n IS NULL)::INT) AS leaves
  FROM node LEFT JOIN kids ON kids.c = node.c AND kids.d = node.d JOIN id ON id.c = node.c AND id.d <= node.d GROUP BY ALL),
ends AS (SELECT first AS c, d, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM (SELECT * FROM id QUALIFY d = max(d) OVER (PARTITION BY c)) GROUP BY ALL)
SELECT node.c AS conv_id, node.d::BIGINT AS depth, edge.parent AS parent_conv_id, node.n::BIGINT AS n_convs, coalesce(kids.n, 0)::BIGINT AS n_children, leaves::BIGINT AS n_leaves,
  saved::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM node JOIN edge ON edge.c = node.c AND edge.d = node.d JOIN under ON under.c = node.c AND under.d = node.d
  LEFT JOIN kids ON kids.c = node.c AND kids.d = node.d LEFT JOIN ends ON ends.c = node.c AND ends.d = node.d
"""
