"""Quality rules: statistics of whole texts, fixed limits, and an isolation forest over the statistics."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, shuffles_removed, unit_hash, written

#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
#: Statistics that the rules count, in this order.
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_lines", "n_distinct", "n_upper", "n_digits", "n_marks", "n_ends"]
#: Bins of anomaly scores in which labelled rows are counted.
BINS = 4096
UPPER = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))
MARKS = b"!\"'(),-./:;?@[]\\_`{}~^+="


def statistics(text: str | None) -> tuple[int, ...]:
    """COUNTS and MORE of a whole text; all 0 for null.

    Words are runs of anything but space and \\x09-\\x0D. n_repeat_words counts the words in 3-word windows that the
    text has twice or more; n_dup_lines the lines with a word that equal an earlier line.
    """
    if not text:
        return (0,) * (len(COUNTS) + len(MORE))
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # of bytes: at space and \x09-\x0D only
    blanks = len(raw) - len(raw.translate(None, b" \t\n\x0b\x0c\r"))
    lines = [line for line in raw.split(b"\n") if line.split(None, 1)]
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        often = {w for w, n in Counter(windows).items() if n > 1}
        upto = 0
        for i, w in enumerate(windows):
            if w in often:
                repeated += i + 3 - max(i, upto)
                upto = i + 3

    def among(marks: bytes) -> int:
        return len(raw) - len(raw.translate(None, marks))

    ends = sum(line.rstrip()[-1:] in (b".", b"!", b"?", b'"') for line in lines)
    return (len(words), len(text) - blanks, among(SYMBOLS), len(lines) - len(set(lines)), repeated, len(lines), len(set(words)), among(UPPER), among(DIGITS), among(MARKS), ends)


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, COUNTS..., MORE...) of each row of docs, in one pass over whole texts."""
    names = COUNTS + MORE

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            got = np.array([statistics(t) for t in frame["text"]], np.int64).reshape(len(frame), len(names))
            yield pd.concat([frame["doc_id"].astype("Int64"), pd.DataFrame(got, columns=names)], axis=1)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(of, "doc_id long, " + ", ".join(f"{c} long" for c in names))


#: Families of rates that a forest each is grown on.
FAMILIES = ["words", "symbols", "lines", "repeats"]


def rates(frame: pd.DataFrame) -> list[np.ndarray]:
    """What the forests see, a matrix for each of FAMILIES: the statistics as rates, so that long texts are no anomaly as such."""
    s = {c: frame[c].to_numpy(np.float64) for c in COUNTS + MORE}
    words, chars, lines = (np.maximum(s[c], 1) for c in ("n_words", "word_chars", "n_lines"))
    return [
        np.stack((chars / words, s["n_upper"] / chars, s["n_digits"] / chars), axis=1),
        np.stack((s["n_symbols"] / words, s["n_symbols"] / chars), axis=1),
        np.stack((s["n_dup_lines"] / lines, s["n_ends"] / lines, np.log1p(s["n_words"] / lines)), axis=1),
        np.stack((s["n_repeat_words"] / words, s["n_distinct"] / np.sqrt(words), s["n_marks"] / words), axis=1),
    ]


def usual_depth(n: np.ndarray | float) -> np.ndarray:
    """The mean depth at which a search for a missing value ends in a random binary tree of n values."""
    n = np.asarray(n, np.float64)
    many = 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1)
    return np.where(n > 2, many, np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Trees as arrays: feature (-1 at a leaf), value, the left child (the right one follows it), and at leaves the depth with what its rows would add."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    rows: int

    def depths(self, x: np.ndarray) -> np.ndarray:
        """The mean path length of each row over all trees."""
        total = np.zeros(len(x))
        for feature, value, left, depth in self.trees:
            at = np.zeros(len(x), np.int64)
            while (inner := feature[at] >= 0).any():
                here = at[inner]
                at[inner] = left[here] + (x[inner, feature[here]] >= value[here])
            total += depth[at]
        return total / max(len(self.trees), 1)

    def anomaly(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1: 2 to the power of minus the path length over the usual one; 0.5 is as usual."""
        return 2.0 ** (-self.depths(x) / max(float(usual_depth(self.rows)), 1e-9))


def grow(x: np.ndarray, trees: int = 200, rows: int = 256, seed: int = 12) -> Forest:
    """Isolation trees: each takes rows of x without replacement and splits them at random values of random features.

    A tree ends at single rows, at rows that no feature parts, and at the depth log2(rows).
    """
    rng = np.random.default_rng(seed)
    rows = min(rows, len(x))
    most = math.ceil(math.log2(max(rows, 2)))
    out = []
    for _ in range(trees):
        nodes: list[list[float]] = [[-1, 0.0, 0, 0.0]]
        todo = [(0, rng.choice(len(x), rows, replace=False), 0)]
        while todo:
            node, own, depth = todo.pop()
            low, high = x[own].min(axis=0), x[own].max(axis=0)
            free = np.flatnonzero(high > low)
            if len(own) < 2 or depth == most or not len(free):
                nodes[node][3] = depth + float(usual_depth(len(own)))
                continue
            f = int(rng.choice(free))
            value = rng.uniform(low[f], high[f])
            value = value if low[f] < value else high[f]
            right = x[own, f] >= value
            nodes[node][:3] = [f, value, len(nodes)]
            todo += [(len(nodes), own[~right], depth + 1), (len(nodes) + 1, own[right], depth + 1)]
            nodes += [[-1, 0.0, 0, 0.0], [-1, 0.0, 0, 0.0]]
        f, v, left, d = zip(*nodes)
        out.append((np.array(f, np.int64), np.array(v), np.array(left, np.int64), np.array(d)))
    return Forest(out, rows)


def scored(stats: DataFrame, forests: list[Forest]) -> DataFrame:
    """Add anomalies to rows of measured(), one of each family; without forests it is empty."""
    sent = stats.sparkSession.sparkContext.broadcast(forests)
    names = stats.columns

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            a = [f.anomaly(x) for f, x in zip(sent.value, rates(frame))]
            yield frame[names].assign(anomalies=list(np.stack(a, axis=1)) if a else [[]] * len(frame))

    return stats.mapInPandas(of, ", ".join(f"`{n}` {kind}" for n, kind in stats.dtypes) + ", anomalies array<double>")


def calibrated(bins: np.ndarray, good: np.ndarray, bad: np.ndarray, cost: float, least: float = 0.05) -> float:
    """The anomaly from which on rows go: that of the largest share of bad rows caught less cost times the share of good rows lost.

    bins ascend; good and bad count the labelled rows of each. The threshold lies in the middle of the gap below the first bin that goes.
    Infinite where a label has no row, or where no threshold is worth the share least.
    """
    if not good.sum() or not bad.sum():
        return math.inf
    merit = np.cumsum(bad[::-1])[::-1] / bad.sum() - cost * np.cumsum(good[::-1])[::-1] / good.sum()
    k = int(merit.argmax())
    return float((bins[k] + (bins[k - 1] + 1 if k else bins[k])) / 2 / BINS) if merit[k] > least else math.inf


def thresholds(known: DataFrame, families: int, cost: float) -> list[float]:
    """A threshold for each family from all rows of known (anomalies, quality), by counts of a row for each family and bin."""
    each = known.select("quality", F.posexplode("anomalies").alias("family", "anomaly"))
    at = F.least(F.floor(F.col("anomaly") * BINS), F.lit(BINS - 1)).cast("int")
    counts = each.groupBy("family", at.alias("bin")).agg(F.sum("quality").alias("good"), F.sum(1 - F.col("quality")).alias("bad")).orderBy("family", "bin").toPandas()  # at most families * BINS rows
    own = [counts[counts["family"] == k] for k in range(families)]
    return [calibrated(c["bin"].to_numpy(), c["good"].to_numpy(np.int64), c["bad"].to_numpy(np.int64), cost) for c in own]


def verdicts(docs: DataFrame, labels: DataFrame, sample: int = 8192, cost: float = 100.0) -> DataFrame:
    """Judge each row of docs by rules: fixed limits, then isolation forests.

    docs: doc_id, text; labels: doc_id, quality (1 good, 0 not; others and null don't count); other columns of either are ignored.
    Returns doc_id, COUNTS, base_failed (n_words < 50, or more than half of the words in repeated windows), anomalies
    (one of each of FAMILIES) and kept (not base_failed, and each anomaly below its family's threshold).

    A forest of each family grows on at most sample rows that pass the base rules, those of smallest hash of doc_id. Its threshold is
    calibrated on all labelled rows that pass the base rules and are not held out (common.held_out): it weighs the share of good rows
    that it loses cost times the share of others that it catches. A document with several labels counts as good only if all say so.
    Without labels of both kinds, or without a row that passes, only the base rules decide. Null and empty texts have no
    words and fail; repeated rows are judged each; an empty table gives no rows. Whole texts are read once; what
    follows works on the written statistics.
    """
    with shuffles_removed(docs.sparkSession):
        failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
        stats = written(measured(docs).withColumn("base_failed", failed))
        passed = stats.where("not base_failed")
        n, u = passed.count(), unit_hash(F.col("doc_id"), 12)
        few = passed.where(u < (1.0 if n <= sample else 1.2 * sample / n)).orderBy(u, *COUNTS).limit(sample).toPandas()  # bounded
        forests = [grow(x) for x in rates(few)] if len(few) else []
        judged = written(scored(stats, forests))
        marks = labels.where("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("long").alias("quality"))
        limits = thresholds(judged.where("not base_failed").where(~held_out()).join(marks, "doc_id"), len(forests), cost)
    odd = [F.col("anomalies")[k] >= limit for k, limit in enumerate(limits) if limit < math.inf]
    kept = ~F.col("base_failed")
    for each in odd:
        kept &= ~each
    return judged.select("doc_id", *COUNTS, "base_failed", "anomalies", kept.alias("kept"))
