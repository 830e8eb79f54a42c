"""Secret scan: fixed patterns, and a battery of randomness tests. DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

#: The base kinds in the order that ranks them at equal starts: kind, pattern, group and the least length of it.
#: Where a shorter match could not hold a later one, the pattern asks for the length itself.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (
    ("assign", ASSIGN, r"(?i)passw|secret|token|api_?key", 2, 12),
    ("access", r"AKIA[A-Z0-9]{14,}", r"AKIA[A-Z0-9]{14}", 0, 18),
    ("hex", r"(?<![0-9a-f])[0-9a-f]{16,}", r"(?<![0-9a-f])[0-9a-f]{16}", 0, 16),
)
#: '=' is of a token only as padding at its end; between a name and a value it parts two tokens.
TOKEN = r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{20,}+(?:=++(?![A-Za-z0-9+/_-]))?+|[A-Za-z0-9+/_-]{1,19}+=++(?![A-Za-z0-9+/_-]))"
TOKEN_HINT = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20}"
#: Encodings, tried in this order: name, what a token of it matches, its alphabet.
_UP, _LOW, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ENCODINGS = (
    ("hex", r"^(?=.*[0-9])(?=.*[a-f])[0-9a-f]+$", "0123456789abcdef"),
    ("HEX", r"^(?=.*[0-9])(?=.*[A-F])[0-9A-F]+$", "0123456789ABCDEF"),
    ("base32", r"^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+=*$", _UP + "234567"),
    ("upper36", r"^(?=.*[0-9])(?=.*[A-Z])[A-Z0-9]+$", _UP + _DIGITS),
    ("lower36", r"^(?=.*[0-9])(?=.*[a-z])[a-z0-9]+$", _LOW + _DIGITS),
    ("base64", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/_-]+=*$", _UP + _LOW + _DIGITS + "+/-_"),
    ("lower", r"^[a-z]+=*$", _LOW),
    ("upper", r"^[A-Z]+=*$", _UP),
    ("letters", r"^[A-Za-z]+=*$", _UP + _LOW),
)
#: Words that the model of names learns from: letters alone, shorter than a token, and not a piece of one.
WORD = r"(?<![A-Za-z0-9+/_-])[A-Za-z]{2,19}+(?![A-Za-z0-9+/_=-])"
#: Percentages of the letters a to z in English text.
ENGLISH = (
    8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.77, 4.0, 2.4, 6.7, 7.5, 1.9, 0.095, 6.0, 6.3, 9.1, 2.8, 0.98, 2.4, 0.15, 2.0, 0.074,
)
#: How often, in a name, a lower-case letter, capital, digit or sign follows the start or a character of such a class.
FOLLOWS = {
    "start": (0.50, 0.35, 0.10, 0.05),
    "lower": (0.80, 0.10, 0.06, 0.04),
    "capital": (0.50, 0.35, 0.10, 0.05),
    "digit": (0.10, 0.10, 0.70, 0.10),
    "sign": (0.40, 0.30, 0.25, 0.05),
}
CHARACTERS = _LOW + _UP + _DIGITS + "+/-_"
PRIOR = 200.0  # pairs of letters that the English percentages count for
ANY = 0.1  # share of letters that follow no habit of words, which bounds what a single rare pair can say
SPAN = "struct<start:int,rank:int,end:int,kind:string>"
STEP = 0.05  # of -log10 p, in which p-values are counted


def spans(text: Column, pattern: str, hint: str, group: int, least: int, kind: str, rank: int) -> Column:
    """Leftmost non-overlapping matches whose group has the least length, as an array of SPAN in code points.

    Matches and the pieces between them alternate, so sums of their lengths give the places.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    held = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.split(text, pattern, -1)
    empty = F.array().cast(f"array<{SPAN}>")
    zero = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["found"])
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"))
        return F.struct(end.alias("at"), F.when(F.length(x["held"]) >= least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    triples = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("found"), held.alias("held"))
    return F.when(text.rlike(hint), F.aggregate(triples, zero, step, lambda acc: acc["out"])).otherwise(empty)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def normal_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal, by the rational approximation 26.2.17 of Abramowitz and Stegun (error under 1e-7)."""

    def tail(t: Column) -> Column:
        series = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
        return F.greatest(F.exp(-z * z / 2) * 0.3989422804014327 * series, F.lit(1e-30))

    return let(let(1 / (1 + 0.2316419 * F.abs(z)), tail), lambda p: F.when(z >= 0, p).otherwise(1 - p))


def encoding_of(token: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, shape, _ in reversed(ENCODINGS):
        out = F.when(token.rlike(shape), F.lit(name)).otherwise(out)
    return out


def battery(token: Column, encoding: Column) -> Column:
    """The p-value of a token under the hypothesis that its characters are drawn evenly and independently.

    Three tests on the places of its characters in the alphabet: chi-squared of the counts (one-sided: too uneven; its
    exact variance accounts for the length), runs above and below the middle, and lag-1 serial correlation
    (two-sided), joined by Fisher's method. Small: the token is structured, say text.
    """
    letters = F.lit("")
    for name, _, of in ENCODINGS:
        letters = F.when(encoding == name, F.lit(of)).otherwise(letters)
    solid = F.filter(F.split(token, ""), lambda c: (c != "") & (c != "="))

    def places(alphabet: Column) -> Column:
        return F.struct(F.length(alphabet).cast("double").alias("width"), F.transform(solid, lambda c: (F.call_function("instr", alphabet, c) - 1).cast("double")).alias("x"))

    def uneven(x: Column, n: Column, width: Column) -> Column:
        squares = total(F.transform(F.array_distinct(x), lambda v: F.pow(F.size(F.filter(x, lambda y: y == v)).cast("double"), F.lit(2.0))))
        return (width / n * squares - n - (width - 1)) / F.sqrt(2 * (width - 1) * (n - 1) / n)

    def runs(high: Column, n: Column) -> Column:
        turns = total(F.zip_with(F.slice(high, 2, F.size(high) - 1), F.slice(high, 1, F.size(high) - 1), lambda a, b: F.abs(a - b)))
        expected = let(total(high), lambda n1: 2 * (n - n1) * n1 / n + 1)
        return let(expected, lambda e: (turns + 1 - e) / F.sqrt(F.greatest((e - 1) * (e - 2) / (n - 1), F.lit(0.25))))

    def serial(x: Column, n: Column) -> Column:
        off = let(total(x) / n, lambda mean: F.transform(x, lambda v: v - mean))
        return let(
            off,
            lambda d: (total(F.zip_with(F.slice(d, 2, F.size(d) - 1), F.slice(d, 1, F.size(d) - 1), lambda a, b: a * b)) / F.greatest(total(F.transform(d, lambda v: v * v)), F.lit(1e-9)) + 1 / n) * F.sqrt(n),
        )

    def joined(p: Column) -> Column:
        return let(-total(F.transform(p, F.ln)), lambda half: F.exp(-half) * (1 + half + half * half / 2))

    def tests(x: Column, n: Column, width: Column) -> Column:
        high = F.transform(x, lambda v: (v >= width / 2).cast("double"))
        two = F.transform(F.array(let(high, lambda h: runs(h, n)), serial(x, n)), lambda z: F.least(2 * normal_tail(F.abs(z)), F.lit(1.0)))
        return joined(F.concat(F.array(let(uneven(x, n, width), normal_tail)), two))

    return let(let(letters, places), lambda of: let(F.size(of["x"]).cast("double"), lambda n: tests(of["x"], n, of["width"])))


def letter_pairs(text: DataFrame) -> np.ndarray:
    """How often each letter (column) follows the start of a word (row 0) or another letter in the words of text (column text), in either case."""
    words = text.select(F.explode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("c"))
    at = F.transform(F.filter(F.split(F.lower("word"), ""), lambda c: c != ""), lambda c: F.call_function("instr", F.lit(_LOW), c))
    pairs = F.zip_with(F.concat(F.array(F.lit(0)), F.slice(at, 1, F.size(at) - 1)), at, lambda a, b: a * 27 + b)
    out = np.zeros((27, 27))
    for pair, c in words.select(F.explode(pairs).alias("pair"), "c").groupBy("pair").agg(F.sum("c")).collect():  # 27 x 26 rows at most
        out[divmod(pair, 27)] = c
    return out[:, 1:]


def name_model(pairs: np.ndarray) -> np.ndarray:
    """log10 of how likely each of CHARACTERS (column) follows the start (row 0) or another of them in a name of words and numbers.

    The class of a character depends on the class before it (FOLLOWS), and a letter within a word on the letter before
    it, by the pairs counted; a capital after a small letter begins a word, as does a letter after a digit or sign.
    """
    english = np.array(ENGLISH) / sum(ENGLISH)
    follows = (pairs + PRIOR * english) / (pairs.sum(axis=1, keepdims=True) + PRIOR)
    follows = (1 - ANY) * follows + ANY / 26
    ends = (26, 52, 62, 66)
    out = np.zeros((67, 66))
    for before in range(67):
        kind = "start" if before == 0 else next(name for name, end in zip(("lower", "capital", "digit", "sign"), ends) if before <= end)
        inside = follows[(before - 1) % 26 + 1] if kind in ("lower", "capital") else follows[0]
        lower, capital, digit, sign = FOLLOWS[kind]
        out[before] = np.concatenate((lower * inside, capital * (follows[0] if kind == "lower" else inside), np.full(10, digit / 10), np.full(4, sign / 4)))
    return np.log10(out)


def evidence(token: Column, encoding: Column, model: np.ndarray) -> Column:
    """log10 of how much likelier a token is as even draws from its alphabet than as a name by the model.

    Of a name the ratio is 1 on average, so ratios are e-values against the hypothesis that the token is a name.
    """
    width = F.lit(0.0)
    for name, _, of in ENCODINGS:
        width = F.when(encoding == name, F.lit(math.log10(len(of)))).otherwise(width)
    table = F.split(F.lit(",".join(f"{v:.6f}" for v in model.ravel())), ",").cast("array<double>")
    solid = F.filter(F.split(token, ""), lambda c: (c != "") & (c != "="))
    places = F.transform(solid, lambda c: F.call_function("instr", F.lit(CHARACTERS), c))
    terms = let(places, lambda x: F.zip_with(F.concat(F.array(F.lit(0)), F.slice(x, 1, F.size(x) - 1)), x, lambda a, b: F.get(table, a * 66 + b - 1)))
    return let(terms, lambda t: -total(t) - F.size(t) * width)


def rejected_above(tokens: DataFrame, rate: float) -> dict[str, float]:
    """For each class of tokens (encoding and length) the score from which Benjamini and Hochberg's rule rejects.

    tokens: class, score (-log10 of a p-value, or log10 of an e-value, for which the rule is the same and holds under
    any dependence). Scores are counted in steps of STEP, rounded down, so that the counts are few
    whatever the number of tokens; a class that rejects none has no entry.
    """
    counts = tokens.groupBy("class", F.floor(F.col("score") / STEP).alias("step")).agg(F.count(F.lit(1)).alias("c"))
    down = Window.partitionBy("class").orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counts.withColumn("k", F.sum("c").over(down)).withColumn("m", F.sum("c").over(Window.partitionBy("class")))
    passing = ranked.where(F.pow(F.lit(10.0), -F.col("step") * STEP) <= rate * F.col("k") / F.col("m"))
    return {row[0]: row[1] * STEP for row in passing.groupBy("class").agg(F.min("step")).collect()}  # some 6 x 40 classes at most


def scan(docs: DataFrame, rate: float = 0.05) -> DataFrame:
    """Secrets of every whole text: those of the base patterns, and tokens that pass for random.

    docs: doc_id, text and others, which are ignored. Returns doc_id, n_assign, n_access, n_hex, base_sha256 (of the
    base spans), spans (all) and n_random, one row per input row, repeated rows included; a null text is empty, and
    texts without spans have the digest of the empty string and empty spans. A null doc_id stays null. Spans are
    kind:start:end in code points, end exclusive, by start and then kind (assign, access, hex, random).

    A token of 20 or more characters (padding by '=' at its end included) beside the base spans, whose characters fit an
    encoding (hexadecimal, base 32, 36 or 64, letters), is tested twice, within its class of encoding and length (half powers of
    two, as the tests gain power with length), over the whole corpus. First, the randomness battery of its encoding: what it
    calls structured is out, and the false-discovery rate of calling random tokens structured is held to rate. Second,
    of what is left the evidence against a name made of words and numbers must be such that names are at most rate of the tokens reported
    in the class; how names look is learnt from the letter pairs of all words of the corpus.
    """
    text = F.coalesce("text", F.lit(""))
    model = name_model(letter_pairs(docs.select(text.alias("text"))))
    base = F.concat(*[spans(text, pattern, hint, group, least, kind, rank) for rank, (kind, pattern, hint, group, least) in enumerate(BASE)])
    rows = docs.select("doc_id", F.array_sort(base).alias("base"), spans(text, TOKEN, TOKEN_HINT, 0, 20, "random", len(BASE)).alias("tokens"), text.alias("text"))
    beside = F.filter("tokens", lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (b["end"] > t["start"])))

    def classed(t: Column, token: Column, encoding: Column) -> Column:
        band = F.floor(2 * F.log2(F.length(token).cast("double"))).cast("string")
        score = F.when(encoding.isNotNull(), -F.log10(F.greatest(battery(token, encoding), F.lit(1e-40))))
        ratio = F.when(encoding.isNotNull(), evidence(token, encoding, model))
        return F.struct(t.alias("span"), F.concat_ws("/", encoding, band).alias("class"), score.alias("score"), ratio.alias("evidence"))

    def tested(t: Column) -> Column:
        token = F.substring("text", t["start"] + 1, t["end"] - t["start"])
        return let(token, lambda token: let(encoding_of(token), lambda encoding: classed(t, token, encoding)))

    def steps(limits: dict[str, float]) -> Column:
        return F.create_map(*[F.lit(x) for pair in limits.items() for x in pair]) if limits else F.create_map(F.lit(""), F.lit(0.0))

    def stepped(score: Column) -> Column:
        return F.floor(score / STEP) * STEP

    tokens = F.when(F.size("tokens") > 0, F.filter(F.transform(beside, tested), lambda t: t["score"].isNotNull()))
    slim = checkpointed(rows.select("doc_id", "base", tokens.alias("tokens")))
    each = slim.select(F.explode("tokens").alias("t")).select("t.*")
    uneven = steps(rejected_above(each, rate))

    def even(t: Column) -> Column:
        return stepped(t["score"]) < F.coalesce(uneven[t["class"]], F.lit(1e9))

    # What the battery calls structured has no evidence left, which keeps the others' ratios e-values.
    left = F.when(even(F.struct("score", "class")), F.col("evidence")).otherwise(F.lit(-1e6))
    unlike = steps(rejected_above(each.select("class", left.alias("score")), rate))
    found = F.filter("tokens", lambda t: even(t) & (stepped(t["evidence"]) >= F.coalesce(unlike[t["class"]], F.lit(1e9)) - STEP / 2))
    random = F.coalesce(F.transform(found, lambda t: t["span"]), F.array().cast(f"array<{SPAN}>"))

    def listed(of: Column) -> Column:
        return F.array_join(F.transform(of, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return slim.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind, *_ in BASE],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.array_sort(F.concat("base", random))).alias("spans"),
        F.size(random).cast("long").alias("n_random"),
    )
