"""Language identification with language-bitmask n-gram filters."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, unit_hash

#: A mask word holds one bit for each of so many languages; further languages have words of their own.
WORD_LANGS = 62
PROBES = 3
_STEP = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(1)
def letters() -> np.ndarray:
    """For each code point whether it is a letter or a mark of one."""
    return np.fromiter((unicodedata.category(chr(c))[0] in "LM" for c in range(0x110000)), bool, 0x110000)


def grams(text: str | None, n: int = 4) -> np.ndarray:
    """64-bit hashes of the n-grams of a whole text: lower case, each run of non-letters one blank, a blank at both ends."""
    points = np.frombuffer((" " + (text or "").lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letters()[points]
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]  # the first of a run of others stands for the run
    points = np.where(letter, points, 32)[keep].astype(np.uint64)
    if len(points) < n or not letter.any():
        return np.zeros(0, np.uint64)
    h = points[: len(points) - n + 1].copy()
    for k in range(1, n):
        h *= np.uint64(0x100000001B3)
        h += points[k : len(points) - n + 1 + k]
    h *= _STEP
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def slots(h: np.ndarray, bits: int) -> list[np.ndarray]:
    """The slots of each hash in a filter of 2 ** bits words: disjoint bit ranges of it."""
    return [(h >> np.uint64(64 - bits * (k + 1))).astype(np.int64) & ((1 << bits) - 1) for k in range(PROBES)]


@dataclass
class Filters:
    """One Bloom filter for each language, bit-sliced: words[j, s] holds bit s of the filters of languages WORD_LANGS * j and on."""

    langs: list[str]
    words: np.ndarray
    bits: int
    n: int

    def __post_init__(self) -> None:
        fill = np.array([((self.words[k // WORD_LANGS] >> np.uint64(k % WORD_LANGS)) & np.uint64(1)).mean() for k in range(len(self.langs))])
        self.false = fill**PROBES

    def counts(self, text: str | None) -> tuple[np.ndarray, int]:
        """For each language the number of n-grams its filter has, corrected for false positives; and their total number."""
        h = grams(text, self.n)
        found = np.zeros(len(self.langs))
        for i in range(0, len(h), 1 << 16):
            first, *rest = slots(h[i : i + (1 << 16)], self.bits)
            masks = self.words[:, first]
            for s in rest:
                masks &= self.words[:, s]
            for k in range(len(self.langs)):
                found[k] += np.count_nonzero(masks[k // WORD_LANGS] & np.uint64(1 << k % WORD_LANGS))
        # found = true + (total - true) * false
        return np.clip((found - len(h) * self.false) / np.maximum(1 - self.false, 1e-9), 0, len(h)), len(h)

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language of the largest corrected count (ties: the first in code point order), and its share of all counts."""
        if not self.langs or not has_letter(text):
            return "und", 0.0
        c, _ = self.counts(text)
        k = int(c.argmax())
        c = c + 1e-3
        return self.langs[k], float(c[k] / c.sum())


def train(docs: DataFrame, eligible: Column, per_lang: int = 400, n: int = 4, bits: int = 18, least: int = 3, spread: float = 0.2) -> Filters:
    """Learn the filters from a bounded sample: about per_lang documents of each language, those of smallest hash of doc_id.

    A language's filter gets the n-grams that occur at least `least` times in its sample, at a rate of at least
    `spread` times the highest rate in any language. Null languages are not learnt. The n-gram counts are summed in
    Spark, and so are the filter words, of which at most 2 ** bits for each 62 languages go to the driver.
    """
    u = unit_hash(F.col("doc_id"), 43)
    known = docs.where(eligible & F.col("lang").isNotNull())
    sizes = known.groupBy("lang").count().collect()  # a row per language
    langs = sorted(row["lang"] for row in sizes)
    share = F.create_map(*[F.lit(x) for row in sizes for x in (row["lang"], min(1.0, 1.2 * per_lang / row["count"]))]) if sizes else F.create_map(F.lit(""), F.lit(0.0))
    index = {lang: k for k, lang in enumerate(langs)}
    sample = known.where(u < F.coalesce(share[F.col("lang")], F.lit(0.0))).select("lang", "text")

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lang, texts in frame.groupby("lang")["text"]:
                h, c = np.unique(np.concatenate([grams(t, n) for t in texts] or [np.zeros(0, np.uint64)]), return_counts=True)
                yield pd.DataFrame({"lang": index[lang], "h": h.view(np.int64), "c": c})

    c = checkpointed(sample.mapInPandas(count, "lang int, h long, c long").groupBy("lang", "h").agg(F.sum("c").alias("c")))
    totals = {row["lang"]: row["t"] for row in c.groupBy("lang").agg(F.sum("c").alias("t")).collect()}
    rate = F.create_map(*[F.lit(x) for k, t in totals.items() for x in (k, 1.0 / t)]) if totals else F.create_map(F.lit(0), F.lit(0.0))
    per_gram = c.withColumn("r", F.col("c") * rate[F.col("lang")]).groupBy("h").agg(F.collect_list(F.struct("lang", "c", "r")).alias("of"), F.max("r").alias("top"))  # one entry a language
    strong = F.filter("of", lambda x: (x["c"] >= least) & (x["r"] >= spread * F.col("top")))
    spots = [F.shiftrightunsigned("h", 64 - bits * (k + 1)).bitwiseAND(F.lit((1 << bits) - 1)) for k in range(PROBES)]
    kept = per_gram.select("h", F.explode(strong).alias("x")).select("h", (F.col("x.lang") / WORD_LANGS).cast("int").alias("j"), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("x.lang") % WORD_LANGS).cast("int")).alias("m"))
    filled = kept.select("j", "m", F.explode(F.array(*spots)).alias("s")).groupBy("j", "s").agg(F.bit_or("m").alias("m"))
    words = np.zeros((max(1, -(-len(langs) // WORD_LANGS)), 1 << bits), np.uint64)
    rows = filled.collect()  # at most 2 ** bits for each word of languages
    if rows:
        words[np.array([row["j"] for row in rows]), np.array([row["s"] for row in rows])] = np.array([row["m"] for row in rows], np.uint64)
    return Filters(langs, words, bits, n)


def identify(docs: DataFrame, filters: Filters) -> DataFrame:
    """(doc_id, lang_pred, score) of each row of docs; `und` with score 0 for a text that is null or has no letter.

    A text too short for any n-gram gets the first language at an even score. Nothing but the text enters.
    """
    sent = docs.sparkSession.sparkContext.broadcast(filters)

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            got = [sent.value.predict(t) for t in frame["text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "lang_pred": [g[0] for g in got], "score": [g[1] for g in got]})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(of, "doc_id long, lang_pred string, score double")
