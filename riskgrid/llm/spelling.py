"""Spelling variants by full neighbourhood generation: every one-letter edit of a word is emitted and joined to the vocabulary."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_counted, shuffles_removed, written

#: Lower-cases A-Z and blanks whatever is no letter of a word, on texts in Latin-1.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))
#: A run is damaged where this divides its checksum.
DAMAGE = 97
#: Distinct words that a counting task holds before it emits them.
HELD_WORDS = 500_000
#: The filter of edits has about so many bits a word, up to 2 ** FILTER_BITS (32 MB); a fuller filter lets more edits through to the join.
BITS_A_WORD = 16
FILTER_BITS = 28
#: A vocabulary of up to so many words (some 10 MB) is broadcast to its edits; a larger one and its edits are shuffled.
BROADCAST_WORDS = 200_000
#: Edits that are held in memory at once.
EDITS_AT_ONCE = 400_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def runs_of(text: str) -> list[bytes]:
    """The letter runs of a whole text in UTF-8, A-Z lower-cased."""
    return text.encode("latin-1", "replace").translate(LETTERS).decode("latin-1").encode().split()


def word_counts(docs: DataFrame, least_length: int = 5) -> DataFrame:
    """(word, n): how often each word of at least least_length code points occurs, damaged runs counted as what is left of them.

    Of a run whose unsigned crc32 h of `<doc_id>:<run>` is a multiple of 97, code point h % length is deleted; a null
    doc_id counts as the empty text. Tasks count before they shuffle, so a frequent word travels once a task.
    """

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter[bytes] = Counter()

        def out() -> pd.DataFrame:
            words = [(w.decode(), n) for w, n in held.items() if n and len(w) >= least_length]
            held.clear()
            return pd.DataFrame([x for x in words if len(x[0]) >= least_length], columns=["word", "n"])

        for frame in frames:
            for doc_id, text in zip(frame["id"], frame["text"]):
                if text is None:
                    continue
                runs = runs_of(text)
                held.update(runs)
                start = zlib.crc32(f"{doc_id or ''}:".encode())
                for run in [r for r in set(runs) if not zlib.crc32(r, start) % DAMAGE]:
                    n, word = runs.count(run), run.decode()
                    k = zlib.crc32(run, start) % len(word)
                    held[run] -= n
                    held[(word[:k] + word[k + 1 :]).encode()] += n
                if len(held) > HELD_WORDS:
                    yield out()
        yield out()

    rows = docs.select(F.col("doc_id").cast("string").alias("id"), "text").where("text is not null")
    return rows.mapInPandas(of, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def letter_values(alphabet: list[str]) -> np.ndarray:
    """A random 64-bit number for each letter, the same in every task."""
    return np.random.default_rng(11).integers(1, 1 << 63, len(alphabet), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def probes(h: np.ndarray, bits: int) -> list[np.ndarray]:
    """The bits of the filter that stand for a hash."""
    h, mask = mixed(h), np.uint64((1 << bits) - 1)
    return [(h & mask).astype(np.int64), ((h >> np.uint64(18)) & mask).astype(np.int64), ((h >> np.uint64(36)) & mask).astype(np.int64)]


class Neighbourhood:
    """All distinct deletions, replacements and insertions of words of one length over an alphabet, by their hashes.

    The hash of letters c0 c1 ... is the sum of value(c_i) * MULTIPLIER ** i modulo 2 ** 64, so the hash of an edit
    comes from sums over what is left and right of it.
    """

    def __init__(self, alphabet: list[str]):
        self.alphabet, self.values = alphabet, letter_values(alphabet)
        self.at = {c: i for i, c in enumerate(alphabet)}

    def coded(self, words: list[str]) -> np.ndarray:
        return np.array([[self.at[c] for c in w] for w in words], np.int64)

    def sums(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Powers of the multiplier, and for each word the hash of its first 0, 1, ... letters."""
        with np.errstate(over="ignore"):
            power = np.cumprod(np.array([1] + [MULTIPLIER] * codes.shape[1], np.uint64), dtype=np.uint64)
            upto = np.cumsum(self.values[codes] * power[:-1], axis=1, dtype=np.uint64)
        return power, np.concatenate((np.zeros((len(codes), 1), np.uint64), upto), axis=1)

    def hashes(self, codes: np.ndarray) -> np.ndarray:
        return self.sums(codes)[1][:, -1]

    def edits(self, codes: np.ndarray) -> Iterator[tuple[str, np.ndarray]]:
        """(kind, hashes): hashes of words x places for deletions, of words x places x letters for the others."""
        power, upto = self.sums(codes)
        whole = upto[:, -1:]
        with np.errstate(over="ignore"):
            yield "delete", upto[:, :-1] + (whole - upto[:, 1:]) * INVERSE
            own = self.values[codes]
            yield "replace", whole[:, :, None] + (self.values[None, None, :] - own[:, :, None]) * power[None, :-1, None]
            yield "insert", (upto + (whole - upto) * MULTIPLIER)[:, :, None] + self.values[None, None, :] * power[None, :, None]

    def edited(self, word: str, kind: str, place: int, letter: int) -> str:
        if kind == "delete":
            return word[:place] + word[place + 1 :]
        return word[:place] + self.alphabet[letter] + word[place + (kind == "replace") :]


def vocabulary_filter(words: DataFrame, alphabet: list[str], rows: int) -> tuple[int, np.ndarray]:
    """(bits, words of 64 bits): a Bloom filter of the vocabulary; tasks set bits, equal words of it are united before they are collected."""
    bits = int(np.clip(np.ceil(np.log2(max(rows, 1) * BITS_A_WORD)), 10, FILTER_BITS))

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        near = Neighbourhood(alphabet)
        for frame in frames:
            by_length = frame["word"].groupby(frame["word"].str.len())
            at = np.concatenate([p for _, some in by_length for p in probes(near.hashes(near.coded(list(some))), bits)])
            yield pd.DataFrame({"slot": at >> 6, "mask": (np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64)})

    slots = words.select("word").mapInPandas(of, "slot long, mask long").groupBy("slot").agg(F.bit_or("mask").alias("mask"))
    filled = np.zeros(1 << (bits - 6), np.int64)
    got = slots.toPandas()  # at most 2 ** (FILTER_BITS - 6) rows
    filled[got["slot"].to_numpy(np.int64)] = got["mask"].to_numpy(np.int64)
    return bits, filled.view(np.uint8)


def edits_of(words: DataFrame, alphabet: list[str], bits: int, bloom: np.ndarray) -> DataFrame:
    """(word, near): the distinct one-letter edits of each word that pass the filter; those outside the vocabulary that do are few."""
    sent = words.sparkSession.sparkContext.broadcast(bloom)  # at most 2 ** FILTER_BITS bits

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        near, filled = Neighbourhood(alphabet), sent.value

        def passing(h: np.ndarray) -> np.ndarray:
            flat = h.reshape(-1)
            left = np.arange(len(flat))
            for at in range(3):
                p = probes(flat[left], bits)[at]
                left = left[(filled[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1]
            return left

        for frame in frames:
            for length, some in frame["word"].groupby(frame["word"].str.len()):
                some, step = list(some), max(1, EDITS_AT_ONCE // (len(alphabet) * (length + 1)))
                for start in range(0, len(some), step):
                    part = some[start : start + step]
                    pairs = set()
                    for kind, h in near.edits(near.coded(part)):
                        for place in zip(*np.unravel_index(passing(h), h.shape)):
                            w = part[place[0]]
                            pairs.add((w, near.edited(w, kind, int(place[1]), int(place[2]) if len(place) > 2 else 0)))
                    yield pd.DataFrame([x for x in pairs if x[0] != x[1]], columns=["word", "near"])

    return words.select("word").mapInPandas(of, "word string, near string")


def near_words(vocabulary: DataFrame, alphabet: list[str], rows: int) -> DataFrame:
    """(word, near, n): each word with each word of vocabulary (word, n) that differs by exactly one letter inserted, deleted or replaced."""
    bits, bloom = vocabulary_filter(vocabulary, alphabet, rows)
    edits = edits_of(vocabulary, alphabet, bits, bloom)
    known = vocabulary.withColumnsRenamed({"word": "near", "n": "near_n"})
    known = F.broadcast(known) if rows <= BROADCAST_WORDS else known.hint("merge")  # edits themselves are never broadcast
    return edits.join(known, "near").select("word", "near", "near_n")


def roots(forms: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(word, root) from (word, form): follows forms to the last, each round twice as far as the one before.

    A form has at least twice its word's count, so chains have no cycle and are as long as the logarithm of a count.
    """
    at = written(forms.select("word", F.col("form").alias("root")))
    for _ in range(max_rounds):
        copies = at.groupBy("root").agg(F.count(F.lit(1)).alias("copies"))
        further = at.select(F.col("word").alias("root"), F.col("root").alias("next")).join(copies, "root")
        if not further.head(1):
            return at
        moved = join_counted(at, further, "root").select("word", F.col("next").alias("root"))
        at = written(moved.unionByName(at.join(further.select("root"), "root", "left_anti").select("word", "root")))
    raise RuntimeError("roots did not settle")


def variants(docs: DataFrame, least_length: int = 5, least_count: int = 3, ratio: int = 2) -> DataFrame:
    """One row (word, form, root, n, n_near, form_n) for each word of the texts of docs.

    Words are letter runs (A-Z lower-cased, some damaged: word_counts) of at least least_length code points that occur
    at least least_count times. Near words differ by exactly one inserted, deleted or replaced code point. form is the near word of largest n
    (ties: the smallest in code-point order) where that n is at least ratio * n, else null; root follows forms to
    the last; n_near counts near words. Null and empty texts have no words; repeated rows count as often as they
    stand there; a null doc_id counts as the empty text; other columns are ignored; a table without words gives no rows.

    Every edit of every word over the alphabet of the vocabulary is generated and joined to the vocabulary by its
    text, so no distance is computed. A Bloom filter of bounded size lets the edits that are no words go unshuffled.
    """
    spark = docs.sparkSession
    with shuffles_removed(spark):
        vocabulary = written(word_counts(docs, least_length).where(F.col("n") >= least_count))
        letters = vocabulary.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).where("c <> ''").distinct()
        alphabet = sorted(row.c for row in letters.collect())  # at most 90 letters
        near = near_words(vocabulary, alphabet, vocabulary.count())
        best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
        best = best.select("word", "n_near", F.col("best.near").alias("top"), (-F.col("best.less")).alias("top_n"))
        taken = F.col("top_n") >= ratio * F.col("n")
        out = vocabulary.join(best, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(taken, F.col("top")).alias("form"), F.when(taken, F.col("top_n")).alias("form_n")
        )
        out = written(out)
        last = roots(out.where("form is not null"))
    return out.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: crc32 of the UTF-8 of _t as an unsigned number, for DuckDB; CRC_TABLE makes the polynomial's table by its rule.
CRC_TABLE = """RECURSIVE crc_step AS (
  SELECT i AS byte, 0 AS k, i::UBIGINT AS v FROM range(256) r(i)
  UNION ALL SELECT byte, k + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::UBIGINT) ELSE v // 2 END FROM crc_step WHERE k < 8),
crc_table AS (SELECT list(v ORDER BY byte) AS crc FROM crc_step WHERE k = 8)"""


def crc_sql(text: str) -> str:
    """SQL of the unsigned crc32 of a text, where the one row of crc_table is joined."""
    codes = f"list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), (2 * i + 1)::BIGINT, 2))::UBIGINT)"
    return f"xor(list_reduce({codes}, lambda h, b: xor(h // 256, crc[(xor(h % 256, b) + 1)::BIGINT]), 4294967295::UBIGINT), 4294967295::UBIGINT)"


ORACLE = f"""
WITH {CRC_TABLE},
run AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS c
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents) GROUP BY ALL),
hashed AS (SELECT run, c, {crc_sql("id || ':' || run")} AS h FROM run, crc_table WHERE length(run) >= 5),
damaged AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, c FROM hashed),
v AS (SELECT word, sum(c)::BIGINT AS n FROM damaged WHERE length(word) >= 5 GROUP BY 1 HAVING sum(c) >= 3),
gap AS (SELECT word, n, unnest(range(length(word))) AS i FROM v),
cut AS (SELECT word, n, i, substr(word, 1, i) AS a, substr(word, i + 2) AS b FROM gap),
near AS (
  SELECT x.word, y.word AS near, y.n AS near_n FROM cut x JOIN cut y ON x.a = y.a AND x.b = y.b AND x.i = y.i AND x.word <> y.word
  UNION SELECT x.word, y.word, y.n FROM cut x JOIN v y ON x.a || x.b = y.word
  UNION SELECT y.word, x.word, x.n FROM cut x JOIN v y ON x.a || x.b = y.word),
best AS (SELECT word, count(*) AS n_near, (list(near ORDER BY near_n DESC, encode(near)))[1] AS near, max(near_n) AS near_n FROM near GROUP BY 1),
f AS (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN near_n >= 2 * n THEN near END AS form, CASE WHEN near_n >= 2 * n THEN near_n END AS form_n
  FROM v LEFT JOIN best USING (word)),
up AS (SELECT word, word AS root, form AS next FROM f UNION ALL SELECT up.word, up.next, f.form FROM up JOIN f ON f.word = up.next)
SELECT f.word, f.form, up.root, f.n, f.n_near, f.form_n FROM f JOIN up ON up.word = f.word AND up.next IS NULL
"""
