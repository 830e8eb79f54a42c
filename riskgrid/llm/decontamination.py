"""Benchmark decontamination by q-gram lemma filtering and banded alignment."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Normalised characters that are searched at once.
CHUNK = 1 << 20
#: Pieces of benchmark items that are broadcast at once; a larger benchmark is searched in blocks of so many.
BLOCK_WINDOWS = 20_000


@dataclass(frozen=True)
class Rule:
    """Any window of `window` characters of an item leaks where a text has it within a share `error` of edits; q is the gram length.

    Windows start at every character. Items shorter than a window are one window; those of fewer than `least` characters are too short to tell.
    """

    window: int = 96
    error: float = 0.08
    q: int = 10
    least: int = 24

    def budget(self, n: int) -> int:
        return int(self.error * n)

    def shared(self, n: int) -> int:
        """The q-gram lemma: what matches n characters within the budget shares so many q-grams with them."""
        return max(1, n - self.q + 1 - self.q * self.budget(n))


@lru_cache(1)
def alphanumeric() -> np.ndarray:
    return np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)


def lower(text: str) -> str:
    """Lower case, character by character, so that offsets stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower()[:1] or c for c in text)


def normalise(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The code points of all texts in lower case, each run of others than letters and digits one blank, 0 before each text;
    where each came from in the texts laid end to end with one separator before each; and the place of each separator."""
    joined = "\0" + "\0".join(lower(t or "").replace("\0", " ") for t in texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    end = points == 0
    solid = alphanumeric()[points] | end
    keep = solid.copy()
    keep[1:] |= solid[:-1]
    at = np.flatnonzero(keep)
    codes = np.where(solid, points, 32)[at].astype(np.uint64)
    return codes, at, np.flatnonzero(end)


def gram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = codes[:n].copy()
    for k in range(1, q):
        h *= np.uint64(0x100000001B3)
        h += codes[k : n + k]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    return h


class Index:
    """The q-grams of a block of pieces of benchmark items."""

    def __init__(self, pieces: list[tuple[int, str]], rule: Rule):
        self.rule = rule
        items: dict[str, list[int]] = {}
        for item, piece in pieces:
            items.setdefault(piece, []).append(item)
        self.items = list(items.values())
        codes = [np.frombuffer(w.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) for w in items]
        lengths = np.array([len(c) for c in codes], np.int64)
        self.codes, self.offset = np.concatenate([*codes, np.zeros(0, np.uint64)]), np.cumsum(lengths) - lengths
        self.sizes = np.minimum(lengths, rule.window)  # of a piece's windows
        self.last = lengths - self.sizes  # where its last window starts
        self.need = np.array([rule.shared(int(n)) for n in self.sizes], np.int64)
        hashes = [gram_hashes(c, rule.q) for c in codes]
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        piece = np.repeat(np.arange(len(hashes)), [len(x) for x in hashes]) if hashes else np.zeros(0, np.int64)
        place = np.concatenate([np.arange(len(x)) for x in hashes]) if hashes else np.zeros(0, np.int64)
        order = np.argsort(h, kind="stable")
        self.piece, self.place = piece[order].astype(np.int64), place[order].astype(np.int64)
        self.grams, self.first, self.times = np.unique(h[order], return_index=True, return_counts=True)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.grams >> np.uint64(44)).astype(np.int64)] = True
        self.slack = rule.budget(rule.window)
        self.band = max(8, 2 * self.slack)
        self.reach = rule.window + self.slack
        self.shift = 2 * self.reach  # beyond any place in a piece

    def candidates(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(piece, start in it, first diagonal) of the windows that share as many q-grams within one of the overlapping
        diagonal bands as the lemma asks."""
        h = gram_hashes(codes, self.rule.q)
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(h) or not len(self.grams):
            return none
        at = np.flatnonzero(self.maybe[(h >> np.uint64(44)).astype(np.int64)])
        spot = np.minimum(np.searchsorted(self.grams, h[at]), len(self.grams) - 1)
        same = self.grams[spot] == h[at]
        at, spot = at[same], spot[same]
        # a region that matches lies within reach of each of its grams, so too few hits around one rule it out
        near = np.searchsorted(at, at + self.reach, "right") - np.searchsorted(at, at - self.reach)
        dense = near >= self.need.min()
        at, spot = at[dense], spot[dense]
        if not len(at):
            return none
        times = self.times[spot]
        entry = np.repeat(self.first[spot] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        piece, place = self.piece[entry], self.place[entry]
        diagonal = np.repeat(at, times) - place + self.shift  # at least 0
        bands = (len(codes) + self.shift) // self.band + 2
        band, into = np.divmod(diagonal, self.band)
        also = (into < self.slack) & (band > 0)
        hits = np.concatenate(((piece * bands + band) * self.shift + place, (piece[also] * bands + band[also] - 1) * self.shift + place[also]))
        hits = np.unique(hits)  # by band, then place; a gram counts once in a band
        group, place = np.divmod(hits, self.shift)
        piece, band = np.divmod(group, bands)
        # the windows whose first hit is this one reach from behind the hit before to it, and must reach the last hit they need
        full = np.arange(len(hits)) + self.need[piece] - 1
        last = np.minimum(full, len(hits) - 1)
        before = np.concatenate(([-1], np.where(group[1:] == group[:-1], place[:-1], -1)))
        low = np.maximum(before + 1, place[last] - (self.sizes[piece] - self.rule.q))
        high = np.minimum(place, self.last[piece])
        enough = np.flatnonzero((full == last) & (group[last] == group) & (low <= high))
        many = high[enough] - low[enough] + 1
        start = np.repeat(low[enough] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        return np.repeat(piece[enough], many), start, np.repeat(band[enough] * self.band - self.shift, many)

    def aligned(self, codes: np.ndarray, piece: np.ndarray, into: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(edits, start) of the best alignment of each whole window within its band, widened by the budget at both sides."""
        width = self.band + 3 * self.slack
        edits, start = np.full(len(piece), 1 << 20), np.zeros(len(piece), np.int64)
        pad = np.concatenate((np.zeros(self.shift + width, np.uint64), codes, np.zeros(self.shift + 2 * width, np.uint64)))
        step = np.arange(width)
        begin = first + into - self.slack
        for n in np.unique(self.sizes[piece]):
            for block in np.array_split(of := np.flatnonzero(self.sizes[piece] == n), len(of) // 4096 + 1):
                text = np.lib.stride_tricks.sliding_window_view(pad, int(n) + width)[begin[block] + self.shift + width]
                want = np.lib.stride_tricks.sliding_window_view(self.codes, int(n))[self.offset[piece[block]] + into[block]]
                cost = np.zeros((len(block), width), np.int32)
                for i in range(int(n)):
                    down = cost + (text[:, i : i + width] != want[:, i : i + 1])
                    down[:, :-1] = np.minimum(down[:, :-1], cost[:, 1:] + 1)
                    cost = np.minimum.accumulate(down - step, axis=1) + step
                best = cost.argmin(axis=1)
                edits[block] = cost[np.arange(len(block)), best]
                start[block] = begin[block] + best
        return edits, start

    def leaks(self, texts: list[str | None]) -> pd.DataFrame:
        """A row (row, item_id, start, end, edits, windows) for each leaked region, in code points of each text, end exclusive."""
        codes, source, ends = normalise(texts)
        cut = np.flatnonzero(codes == 0)
        found: list[tuple[int, int, int, int, int]] = []
        for begin in range(0, len(codes), CHUNK):
            part = codes[begin : begin + CHUNK + 2 * self.reach]
            piece, into, first = self.candidates(part)
            if not len(piece):
                continue
            edits, start = self.aligned(part, piece, into, first)
            good = edits <= (self.rule.error * self.sizes[piece]).astype(np.int64)
            for w, e, s in zip(piece[good].tolist(), edits[good].tolist(), start[good].tolist()):
                n = int(self.sizes[w])
                row = int(np.searchsorted(cut, begin + s + n // 2, "right")) - 1
                lo, hi = max(begin + s, int(cut[row]) + 1), min(begin + s + n, int(cut[row + 1]) if row + 1 < len(cut) else len(codes))
                if hi > lo:
                    base = int(ends[row]) + 1
                    found += [(row, item, int(source[lo]) - base, int(source[hi - 1]) + 1 - base, e) for item in self.items[w]]
        merged: list[list[int]] = []
        for row, item, lo, hi, e in sorted(set(found)):
            last = merged[-1] if merged else None
            if last and last[:2] == [row, item] and lo <= last[3] + self.rule.window:
                last[3], last[4], last[5] = max(last[3], hi), min(last[4], e), last[5] + 1
            else:
                merged.append([row, item, lo, hi, e, 1])
        return pd.DataFrame(merged, columns=["row", "item_id", "start", "end", "edits", "windows"])


def pieces(benchmark: DataFrame, rule: Rule) -> DataFrame:
    """(item_id, piece): each normalised item cut into pieces that overlap, so that each of its windows lies in one piece alone."""

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for item, text in zip(frame["item_id"], frame["text"]):
                codes, _, _ = normalise([text])
                flat = codes[1:].astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass").strip()
                if len(flat) >= rule.least:
                    out += [(item, flat[s : s + 2 * rule.window - 1]) for s in range(0, max(len(flat) - rule.window, 0) + 1, rule.window)]
            yield pd.DataFrame(out, columns=["item_id", "piece"])

    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null").mapInPandas(of, "item_id long, piece string").distinct()


def indexes(benchmark: DataFrame, rule: Rule, block: int) -> Iterator[Broadcast]:
    """A broadcast index for each block of at most about `block` pieces of the benchmark."""
    rows = pieces(benchmark, rule).cache()
    blocks = -(-rows.count() // block)
    for b in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("piece"), F.lit(blocks)) == b).collect()  # a block, whatever the benchmark's size
        yield benchmark.sparkSession.sparkContext.broadcast(Index([(r["item_id"], r["piece"]) for r in part], rule))
    rows.unpersist()


def leaks(docs: DataFrame, benchmark: DataFrame, rule: Rule = Rule(), block: int = BLOCK_WINDOWS) -> DataFrame:
    """The regions of documents that leak a benchmark item.

    docs: doc_id, text; benchmark: item_id, text; other columns of either are ignored. Returns doc_id, item_id, start,
    end (code points of the whole text, end exclusive, as far as the matched windows reach), edits (fewest of a
    matched window) and windows (how many spans matched), one row per region; regions of an item less than a window apart are one.
    Matching ignores case and what lies between letters and digits. Null and empty texts leak nothing, null items and
    items under rule.least characters can't be leaked. Repeated documents each give their rows; repeated items
    (ids) one. Without any leak, document or item there are no rows.

    Each block of the benchmark is broadcast and all whole texts are read past it: q-grams shared with it are
    counted in overlapping diagonal bands, windows, at whatever character they start, that share as many in a band as
    the q-gram lemma asks are kept and verified by banded alignment. There is no shuffle of documents.
    """
    schema = "doc_id long, item_id long, start long, end long, edits int, windows int"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    out = docs.sparkSession.createDataFrame([], schema)

    for index in indexes(benchmark, rule, block):

        def of(frames: Iterator[pd.DataFrame], index: Broadcast = index) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for i in range(0, len(frame), 500):
                    part = frame.iloc[i : i + 500]
                    found = index.value.leaks(part["text"].tolist())
                    ids = part["doc_id"].astype("Int64").iloc[found["row"].to_numpy(np.int64)].reset_index(drop=True)
                    yield pd.DataFrame({"doc_id": ids} | {c: found[c].to_numpy() for c in ["item_id", "start", "end", "edits", "windows"]})

        out = out.union(rows.mapInPandas(of, schema))
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, rule: Rule = Rule(), block: int = BLOCK_WINDOWS) -> DataFrame:
    """The rows of docs, with their columns, that leak no benchmark item; decided row by row, without a shuffle."""
    for index in indexes(benchmark, rule, block):
        docs = docs.where(leakless(index)("text"))
    return docs


def leakless(index: Broadcast) -> Callable[[str], Column]:
    def clean(texts: pd.Series) -> pd.Series:
        ok = np.ones(len(texts), bool)
        values = texts.tolist()
        for i in range(0, len(values), 500):
            ok[i + index.value.leaks(values[i : i + 500])["row"].to_numpy(np.int64)] = False
        return pd.Series(ok)

    return F.pandas_udf(clean, "boolean")
