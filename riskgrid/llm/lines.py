"""Line dedup by an exact set-similarity join. DataFrame functions only."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shuffles_removed, written

#: Blanks other than space between tokens.
TABS = "\t\x0b\x0c\r"
#: Tokens are counted in buckets of their hash, 2 ** BUCKET_BITS[0] to 2 ** BUCKET_BITS[1] of them, some eight a document; the counts' levels become one constant of the plan.
BUCKET_BITS = (16, 18)
#: Tokens that more sets have in their prefixes are hot: their sets are compared with HEADS of them first.
HOT = 1024
HEADS = 4
#: Prefix tokens are counted in so many buckets to find the hot ones.
PREFIX_BUCKETS = 1 << 16
#: Each line is first compared with the earliest line of each of its so many rarest tokens.
RAREST = 2
#: Sizes of sets within this ratio are one band; sets meet only in bands that similar ones can share.
BAND = 1.5
#: Up to so many rows (some 40 MB) are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Sets of more tokens have more parity bits.
FEW_TOKENS = 64
#: A set of n tokens must share one token with another in their prefixes, and one more for each EACH of its tokens, with prefixes that much longer.
EACH = 80
#: Prefix tokens are joined in so many turns, by their last bits, so that the shuffles of one turn only are on disk at a time.
TURNS = 2
SLACK = 1e-9


def shares(n: Column) -> Column:
    """How many tokens the prefixes of similar sets share at least, if the smaller has n tokens."""
    return (F.floor(n / EACH) + 1).cast("int")


def small(df: DataFrame) -> DataFrame:
    """A written table, with the hint to broadcast it if it is found to have at most BROADCAST_ROWS."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def spaced() -> Column:
    """The text with all blanks but line ends as spaces; empty for null."""
    text = F.coalesce("text", F.lit(""))
    tabbed = F.contains(text, F.lit(TABS[0]))
    for c in TABS[1:]:
        tabbed = tabbed | F.contains(text, F.lit(c))
    return F.when(tabbed, F.translate(text, TABS, " " * len(TABS))).otherwise(text)


def line_rows(docs: DataFrame) -> DataFrame:
    """(did, line, text) of each line of docs, its blanks all spaces; documents without an id have none."""
    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("did"), F.posexplode(F.split(spaced(), "\n")).alias("line", "text"))


def rarity(docs: DataFrame) -> tuple[Column, int]:
    """The constant array whose entry b grows with the logarithm of how often tokens of bucket b occur in all docs; its length."""
    buckets = 1 << min(max(math.ceil(math.log2(8 * docs.count() + 1)), BUCKET_BITS[0]), BUCKET_BITS[1])
    counts = docs.select(F.explode(F.split(F.replace(spaced(), F.lit("\n"), F.lit(" ")), " ")).alias("w")).groupBy(F.xxhash64("w").bitwiseAND(buckets - 1).cast("int").alias("b")).count()
    level = F.least(F.floor(1.5 * F.log2(F.col("count") + 1.0)), F.lit(63)).cast("int")  # six bits, so that codes stay above 0
    # a row of text for each 4096 buckets goes to the driver
    rows = counts.select((F.col("b") / 4096).cast("int").alias("part"), F.concat_ws(":", F.col("b"), level).alias("pair")).groupBy("part").agg(F.concat_ws(",", F.collect_list("pair")).alias("pairs"))
    levels = [0] * buckets
    for row in rows.collect():
        for pair in row["pairs"].split(","):
            b, _, n = pair.partition(":")
            levels[int(b)] = int(n)
    return F.from_json(F.lit(str(levels)), "array<bigint>"), buckets


def codes(text: Column, levels: Column, buckets: int) -> Column:
    """The distinct tokens of a line as numbers in order of rarity: the level of the token above 57 bits of its hash.

    Levels are given as not null, so that the numbers are sorted as such and not as objects.
    """
    hashes = F.array_remove(F.array_distinct(F.transform(F.split(text, " "), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))
    return F.sort_array(F.transform(hashes, lambda h: F.shiftleft(F.coalesce(F.get(levels, h.bitwiseAND(buckets - 1)), F.lit(0).cast("long")), 57).bitwiseOR(F.shiftrightunsigned(h, 7))))


def parity(codes: Column, at: int) -> Column:
    """64 bits, each the parity of how many of the codes name it by their six bits from `at` on: two sets that differ in k tokens differ in at most k bits."""

    masks = F.from_json(F.lit(str([1 << k for k in range(63)] + [-(1 << 63)])), "array<bigint>")  # looked up faster than a cast and a shift
    return F.aggregate(codes, F.lit(0).cast("long"), lambda bits, c: bits.bitwiseXOR(F.get(masks, (F.shiftright(c, at) if at else c).bitwiseAND(63))))


def placed(lines: DataFrame) -> Column:
    """One number for each (did, line), in their order: a long if all fit."""
    low, high, last = lines.agg(F.min("did"), F.max("did"), F.max("line")).first()
    bits = max(last or 0, 1).bit_length()
    if (max(abs(low or 0), abs(high or 0)) + 1) << bits < 1 << 63:
        return F.col("did") * (1 << bits) + F.col("line")
    return (F.col("did").cast("decimal(38,0)") * (1 << 32) + F.col("line")).cast("decimal(38,0)")


def pairs(x: DataFrame, y: DataFrame, threshold: float, *keys: str, sized: bool = False) -> DataFrame:
    """(x_did, x_line, y_did, y_line, least) for each posting that sets of two lines share, y the earlier, which may have the similarity if they share `least`.

    Filters: lengths; positions (what is left of both sets after the token, and what may be shared before it, may suffice); and the bits
    of parity(), which bound how much the sets differ. Pairs are taken with the later line of x; or, if sized, with the larger
    set of x (of equal ones the later) and the smaller of y, whose prefixes may then be short. Sized, pairs whose later line is `known` are left out.
    """
    c = F.col
    before = (c("y.did") < c("x.did")) | ((c("y.did") == c("x.did")) & (c("y.line") < c("x.line")))
    same = (c("y.did") == c("x.did")) & (c("y.line") == c("x.line"))
    on = (c("x.token") == c("y.token")) & (((c("x.n") > c("y.n")) & ~same | (c("x.n") == c("y.n")) & before) if sized else before)
    if sized:
        on = on & ~F.when(before, c("x.known")).otherwise(c("y.known"))
    for key in keys:
        on = on & (c(f"x.{key}") == c(f"y.{key}"))
    total, smaller = c("x.n") + c("y.n"), c("y.n") if sized else F.least("x.n", "y.n")
    lengths = smaller >= threshold * (c("x.n") if sized else F.greatest("x.n", "y.n")) - SLACK
    left = F.least(c("x.n") - c("x.i"), c("y.n") - c("y.i")) + shares(smaller) - 1 >= threshold / (1 + threshold) * total - SLACK
    apart = (1 - threshold) / (1 + threshold) * total + SLACK
    close = F.bit_count(c("x.bits").bitwiseXOR(c("y.bits"))) <= apart
    closer = (smaller <= FEW_TOKENS) | (F.bit_count(c("x.more_bits").bitwiseXOR(c("y.more_bits"))) <= apart)
    joined = x.alias("x").join(y.alias("y"), on & lengths & left & close & closer)
    ends = {f"{side}_{part}": (c(f"{side}.{part}"), c(f"{other}.{part}")) for side, other in ("xy", "yx") for part in ("did", "line")}
    return joined.select(*[(F.when(before, a).otherwise(b) if sized else a).alias(name) for name, (a, b) in ends.items()], shares(smaller).alias("least"))


def pairs_of_all(postings: DataFrame, threshold: float) -> DataFrame:
    """The pairs within postings, written; a larger set's whole prefix against a smaller one's short prefix, some of the tokens at a time.

    As the larger set has at least as many tokens, a pair shares 2 t / (1 + t) of the smaller one, whose prefix is the shorter for it.
    The band of sizes is part of the key: the larger set stands in its own, the smaller one in each that a similar larger set can have.
    """
    n = F.col("n")
    least = F.greatest(n, F.pow(F.lit(BAND), F.col("band")) * (1 - SLACK))  # size of a larger set in the band
    short = n - F.ceil(threshold / (1 + threshold) * (n + least) - SLACK) + shares(n)

    def band(size: Column) -> Column:
        return F.floor(F.log(size) / math.log(BAND)).cast("int")

    def keyed(rows: DataFrame) -> DataFrame:
        return rows.withColumn("token", F.col("token").bitwiseXOR(F.call_function("shiftleft", F.col("band").cast("long"), F.lit(51)))).drop("band")

    found = []
    for turn in range(TURNS):
        some = postings.where(F.col("token").bitwiseAND(TURNS - 1) == turn)
        larger = keyed(some.withColumn("band", band(n.cast("double"))))
        bands = F.sequence(band(n.cast("double")), band((n + SLACK) / threshold * (1 + SLACK)))
        smaller = keyed(some.withColumn("band", F.explode(bands)).where(F.col("i") < short))
        found.append(written(pairs(larger, smaller.hint("shuffle_hash"), threshold, sized=True)))
    return reduce(DataFrame.union, found)


def near_rarest(able: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """The (did, line) of lines similar to the earliest line of one of their RAREST rarest tokens: most near copies, without the pairs among them."""
    rows = able.select("did", "line", "n", "bits", "more_bits", F.posexplode(F.slice("prefix", 1, RAREST)).alias("i", "token")).repartition("token")
    heads = rows.groupBy("token").agg(F.min(F.struct("did", "line", "n", "bits", "more_bits", "i")).alias("h"), F.count(F.lit(1)).alias("rows"))
    heads = heads.where("rows > 1").select("token", "h.*")
    return similar(written(pairs(rows, heads.hint("shuffle_hash"), threshold).drop("least").distinct()), docs, threshold)


def verified(found: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """The (did, line) of each x of the pairs that share enough tokens and whose sets have at least the Jaccard similarity threshold."""
    ids = ["x_did", "x_line", "y_did", "y_line"]
    shared = found.groupBy(*ids, "least").agg(F.count(F.lit(1)).alias("shared"))
    return similar(written(shared.where("shared >= least").select(*ids)), docs, threshold)


def similar(found: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """The (did, line) of each x of found whose set has at least the Jaccard similarity threshold with that of y.

    Tokens are compared as text, read again for the wanted lines only.
    """
    ends = [found.select(F.col(f"{side}_did").alias("did"), F.col(f"{side}_line").alias("line")) for side in "xy"]
    wanted = written(ends[0].union(ends[1]).distinct())
    some = line_rows(docs.join(small(wanted.select(F.col("did").alias("doc_id")).distinct()), "doc_id", "left_semi")).join(small(wanted), ["did", "line"])
    sets = written(some.select("did", "line", F.array_remove(F.array_distinct(F.split("text", " ")), "").alias("words")))
    for side in "xy":
        found = found.join(sets.select(*[F.col(c).alias(f"{side}_{c}") for c in sets.columns]), [f"{side}_did", f"{side}_line"])
    enough = F.size(F.array_intersect("x_words", "y_words")) * (1 + threshold) >= threshold * (F.size("x_words") + F.size("y_words")) - SLACK
    return written(found.where(enough).select(F.col("x_did").alias("did"), F.col("x_line").alias("line")).distinct())


def hot_tokens(postings: DataFrame) -> DataFrame | None:
    """(token) of those that more than HOT sets have in their prefixes, or None; counted one by one only in buckets that may hold one."""
    bucket = F.col("token").bitwiseAND(PREFIX_BUCKETS - 1).cast("int")
    full = {row[0] for row in postings.groupBy(bucket.alias("b")).count().where(F.col("count") > HOT).select("b").collect()}  # at most PREFIX_BUCKETS rows
    if not full:
        return None
    chosen = F.from_json(F.lit(str([int(b in full) for b in range(PREFIX_BUCKETS)])), "array<int>")
    hot = written(postings.where(F.get(chosen, bucket) == 1).groupBy("token").count().where(F.col("count") > HOT).select("token"))
    return None if hot.isEmpty() else hot


def searched(docs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(did, line, first) of each line with tokens, first where none of its token set is earlier; and (did, line) of the firsts similar to an earlier line."""
    all_lines = line_rows(docs)
    levels, buckets = rarity(docs)
    ranked = all_lines.select("did", "line", codes(F.col("text"), levels, buckets).alias("codes"))
    n = F.size("codes")
    prefix = F.slice("codes", 1, (n - F.ceil(threshold * n - SLACK)).cast("int") + shares(n))
    bits = [parity(F.col("codes"), 0).alias("bits"), F.when(n > FEW_TOKENS, parity(F.col("codes"), 6)).otherwise(0).alias("more_bits")]
    digests = [F.xxhash64("codes").alias("d1"), F.xxhash64(F.lit(1), F.col("codes")).alias("d2")]
    lines = written(ranked.select("did", "line", n.alias("n"), *digests, *bits, prefix.alias("prefix"))).where("n > 0")
    # the place is one number, so that the least of a set needs no sort; the join back has a key of its own for each line, however often a set repeats
    lines = lines.withColumn("place", placed(lines))
    firsts = lines.groupBy("d1", "d2").agg(F.min("place").alias("place")).select("place", "d1", F.lit(True).alias("first"))
    lines = lines.join(firsts.hint("shuffle_hash"), ["place", "d1"], "left")
    lines = written(lines.select("did", "line", "n", "bits", "more_bits", "prefix", F.coalesce("first", F.lit(False)).alias("first")))

    # a set of n tokens is similar to another only if all of its tokens, and one more, would be
    able = lines.where(F.col("first") & (F.col("n") >= threshold * (F.col("n") + 1) - SLACK))
    known = near_rarest(able, docs, threshold)
    few = known.count() <= BROADCAST_ROWS
    able = able.join(small(known.withColumn("known", F.lit(True))), ["did", "line"], "left").withColumn("known", F.coalesce("known", F.lit(False)))
    able = able if few else written(able)
    postings = able.select("did", "line", "n", "bits", "more_bits", "known", F.posexplode("prefix").alias("i", "token"))
    hot = hot_tokens(lines.where(F.col("first")).select(F.explode("prefix").alias("token")))
    if hot is None:
        return lines, known.union(verified(pairs_of_all(postings, threshold), docs, threshold))
    hot = small(hot)
    cool, wide = postings.join(hot, "token", "left_anti"), written(postings.join(hot, "token", "left_semi"))
    slot = F.pmod(F.xxhash64("did", "line"), F.lit(HEADS))
    heads = written(wide.groupBy("token", slot.alias("slot")).agg(F.min(F.struct("did", "line", "n", "bits", "more_bits", "i")).alias("h")).select("token", "h.*"))
    cool_pairs = pairs_of_all(cool, threshold)
    near = known.union(verified(cool_pairs.union(pairs(wide.where(~F.col("known")), small(heads), threshold)), docs, threshold))
    doubtful = wide.join(small(near), ["did", "line"], "left_anti")
    cool_pairs = cool_pairs.join(small(near.select(F.col("did").alias("x_did"), F.col("line").alias("x_line"))), ["x_did", "x_line"], "left_anti")
    # by size as well, so that a hot token is many keys; a similar set's size is in the same band or one beside it
    band = F.floor(F.log(F.col("n").cast("double")) / -math.log(threshold) + SLACK).cast("int")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    doubtful = doubtful.withColumn("band", F.explode(F.array(band - 1, band, band + 1))).repartition(parts, "token", "band")
    others = wide.withColumn("band", band).repartition(parts, "token", "band")
    # a pair may share both cool and hot tokens, so what it shares is counted over all
    return lines, near.union(verified(cool_pairs.unionByName(pairs(doubtful, others, threshold, "band")), docs, threshold))


def repeated_lines(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Lines that repeat an earlier one: per document the numbers of its lines that go.

    docs: doc_id, text; others are ignored. A line is what stands between line ends \\n, its tokens are its distinct
    runs of characters other than \\x20 and \\x09-\\x0D, as they are. A line goes if the Jaccard similarity of its tokens
    with those of any line earlier in the order of (doc_id, number), removed or not, is at least threshold. Lines
    without tokens stay. Returns doc_id, n_lines, n_same (lines that go and whose very token set occurs earlier), n_near (others
    that go) and removed (their numbers from 0, ascending, comma-joined), one row per input row. A null text is one
    empty line. A document with a null doc_id has no place in the order: nothing of it goes or makes others go.
    Rows that share a doc_id are one document in that order: lines at equal places don't make each other go, and each
    row reports the lines of all of them. An empty table gives no rows.

    Tokens are ordered by rarity in the corpus (counted in buckets of their hash; any one order gives the same result), and
    the first lines of two token sets that share a token in their prefixes are candidates if lengths, positions
    and parity bits allow. The prefix of the larger set of n tokens is n - ceil(t n) + 1 long, that of the smaller n - ceil(2 t n / (1 + t)) + 1,
    for the threshold t, both by one longer for each further token that is asked for. Before that each meets the earliest set of its RAREST
    rarest tokens, and what is found similar there is in no pair as the later one. The sets of a token that up to HOT share are all compared there. Where more share it, every set is first compared
    with up to HEADS of them, which removes most of a large group of near copies without comparing all its pairs; sets
    still in doubt are then joined with all others, so the result is exact. Candidates are verified on the tokens themselves.
    Before that, token sets are told apart by 128 bits of a hash, and tokens by 57 besides their level.
    """
    with shuffles_removed(docs.sparkSession):
        lines, near = searched(docs, threshold)
    again = lines.where(~F.col("first")).select("did", "line", F.lit(True).alias("again"))
    gone = again.union(near.select("did", "line", F.lit(False))).groupBy("did")
    gone = gone.agg(F.collect_set(F.when(F.col("again"), F.col("line"))).alias("same"), F.collect_set(F.when(~F.col("again"), F.col("line"))).alias("near"))  # of one document
    text = F.coalesce("text", F.lit(""))
    n_lines = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), n_lines.cast("long").alias("n_lines"))
    none = F.array().cast("array<int>")
    same = F.coalesce("same", none)
    close = F.array_except(F.coalesce("near", none), same)
    return base.join(gone, F.col("doc_id") == F.col("did"), "left").select(
        "doc_id",
        "n_lines",
        F.size(same).cast("long").alias("n_same"),
        F.size(close).cast("long").alias("n_near"),
        F.array_join(F.sort_array(F.array_union(same, close)).cast("array<string>"), ",").alias("removed"),
    )


def without_repeated_lines(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The rows of docs with their columns, texts without the lines that repeated_lines() reports; a null text stays null."""
    gone = repeated_lines(docs, threshold).where("removed <> ''").select(F.col("doc_id").alias("_doc_id"), F.split("removed", ",").alias("_gone")).distinct()
    joined = docs.join(gone, F.col("doc_id") == F.col("_doc_id"), "left")
    kept = F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains("_gone", i.cast("string")))
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return joined.withColumn("text", text).select(*docs.columns)


#: The same by brute candidate search: every pair of token sets that share a token of their prefixes.
ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(range(len(p))) AS line, unnest(p) AS t
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents WHERE doc_id IS NOT NULL)),
toks AS (
  SELECT doc_id, line, list_sort(list_distinct(regexp_extract_all(t, '[^\x20\x09-\x0D]+'))) AS w FROM lines),
sets AS (
  SELECT row_number() OVER (ORDER BY w) AS id, w, len(w) AS n, min((doc_id, line)) AS pos FROM toks WHERE len(w) > 0 GROUP BY w),
words AS (SELECT id, n, pos, unnest(w) AS u FROM sets),
df AS (SELECT u, count(*) AS c FROM words GROUP BY u),
pre AS (
  SELECT id, n, pos, u FROM (
    SELECT id, n, pos, words.u AS u, row_number() OVER (PARTITION BY id ORDER BY c, words.u) AS r FROM words JOIN df ON words.u = df.u)
  WHERE r <= n - ceil(0.8 * n - 1e-9) + 1),
cand AS (
  SELECT DISTINCT a.id AS x, b.id AS y FROM pre a JOIN pre b ON a.u = b.u AND b.pos < a.pos
  WHERE least(a.n, b.n) >= 0.8 * greatest(a.n, b.n) - 1e-9),
near AS (
  SELECT DISTINCT x FROM cand JOIN sets a ON a.id = x JOIN sets b ON b.id = y
  WHERE len(list_intersect(a.w, b.w)) * 1.8 >= 0.8 * (a.n + b.n) - 1e-9),
flags AS (
  SELECT toks.doc_id AS doc_id, toks.line AS line, (toks.doc_id, toks.line) <> sets.pos AS again, sets.id IN (SELECT x FROM near) AS near
  FROM toks JOIN sets ON toks.w = sets.w),
gone AS (
  SELECT doc_id, count(*) FILTER (WHERE again) AS n_same, count(*) FILTER (WHERE near AND NOT again) AS n_near,
         string_agg(CAST(line AS VARCHAR), ',' ORDER BY line) AS removed
  FROM flags WHERE again OR near GROUP BY doc_id)
SELECT d.doc_id AS doc_id, CAST(len(string_split(coalesce(d.text, ''), chr(10))) AS BIGINT) AS n_lines,
       coalesce(n_same, 0) AS n_same, coalesce(n_near, 0) AS n_near, coalesce(removed, '') AS removed
FROM documents d LEFT JOIN gone ON d.doc_id = gone.doc_id
"""
