"""The conversation trie against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from riskgrid.llm import conversations

SCHEMA = "conv_id long, turn int, role string, text string"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        whole[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in sorted(whole.items()):
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)

    def below(node):
        found, todo = [], [node]
        while todo:
            found.append(todo.pop())
            todo += kids[found[-1]]
        return found

    out = set()
    for node, ids in members.items():
        sub = below(node)
        ends = ",".join(str(c) for c in ids if len(whole[c]) == len(node))
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in sub if x)
        parent = min(members[node[:-1]]) if node else None
        out.add((ids[0], len(node), parent, len(ids), len(kids[node]), sum(not kids[x] for x in sub), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def nodes_of(frame):
    rows = [tuple(r) for r in frame.select(*NAMES).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def made(rng, convs, turns, texts=3):
    out = []
    for c in convs:
        for t in range(rng.randint(1, turns)):
            out.append((c, rng.choice([None, t, t]), rng.choice(["user", "assistant", None]), rng.choice([None, "", "é" * rng.randint(1, texts), "a b"])))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_matches_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = made(rng, rng.sample(range(-40, 200), 90), 11)
    rows += rows[:20] + [(None, 0, "user", "x"), (300, 0, "user", "same"), (301, 0, "user", "same"), (305, 0, "user", "same")]
    rng.shuffle(rows)
    frame = spark.createDataFrame([(*r, 1, b"x") for r in rows], SCHEMA + ", depth int, key binary")  # columns of names used inside
    assert nodes_of(conversations.trie(frame)) == brute(rows)


def test_large_groups_of_equal_conversations_and_long_ones(spark, monkeypatch):
    for name, value in (("BLOCK", 8), ("PIECE", 7)):
        monkeypatch.setattr(conversations, name, value)
    rng = random.Random(5)
    rows = [(c, t, "user", f"t{t}") for c in range(0, 400, 2) for t in range(4)]
    rows += [(1000, t, "user", f"u{t}" + "long text " * (20_000 if t == 7 else 1)) for t in range(700)]  # lies in several partitions
    rows += [(1003, t, "user", f"u{t}") for t in range(30)] + made(rng, range(1, 60, 2), 6)
    assert nodes_of(conversations.trie(spark.createDataFrame(rows, SCHEMA).repartition(7))) == brute(rows)


def test_turns_are_numbered_across_partitions(spark):
    rows = [(c, t, "r", f"{c}-{t}") for c in (1, 2, 3) for t in range(120 if c == 2 else 2)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = conversations.numbered(spark.createDataFrame(rows, SCHEMA)).orderBy("conv_id", "pos").collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [(r.conv_id, r.pos) for r in got] == [(c, t) for c, t, *_ in sorted(rows)]
    for c in (1, 2, 3):
        total = 0
        for r in (r for r in got if r.conv_id == c):
            assert conversations.number(r.before) == total
            text = f"{c}-{r.pos}"
            total += int(hashlib.md5(f"1:r:{text}".encode()).hexdigest(), 16) * pow(conversations.BASE, r.pos, conversations.PRIME)
            total %= conversations.PRIME
            assert conversations.number(r.after) == total


def test_edges_of_the_trie(spark):
    assert conversations.trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert conversations.trie(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA)).count() == 0
    lost = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 1)  # its first turn gives way to a head that is absent
    assert nodes_of(conversations.trie(spark.createDataFrame([(lost, 0, "a", "b")], SCHEMA))) == brute([(lost, 0, "a", "b")]) == {(lost, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lost).encode()).hexdigest())}


def test_sql_agrees(spark):
    path = "/root/testdata/sf0.001"
    duckdb.sql(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM '{path}/conversations.parquet'")
    want = {tuple(r) for r in duckdb.sql(f"SELECT {', '.join(NAMES)} FROM ({conversations.ORACLE})").fetchall()}
    assert nodes_of(conversations.trie(spark.read.parquet(f"{path}/conversations.parquet"))) == want
