"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

#: Cells of the sampling order whose sums of words are kept for each source.
CELLS = 1024
#: Up to so many sources, what is known of them is broadcast; more of them are joined.
BROADCAST_SOURCES = 20_000
#: Columns that mix() adds or uses.
MINE = ["size", "source_size", "target", "copies", "taken", "_u", "_x", "_n", "_xs", "_whole", "_rest", "_rank", "_cut", "_source", "_cell"]
#: A word is a run of characters other than space and \x09-\x0D.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a whole text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(*columns: Column, seed: int) -> Column:
    """A number in (0, 1) from the MD5 digest of the columns as text, the same in every run."""
    text = F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns], F.lit(str(seed)))
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def source_targets(sources: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """Add the target of each source to (source, source_size, ...): by weight of all sizes, at most most times its own.

    What a capped source can't take goes to the others by weight, which ends at a water level: target = least of
    most * source_size and weight * level. In the order of the levels that fill them, the first source that the level
    of itself and all after it does not fill sets the level.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    w = sources.withColumn("_weight", cycle[((F.row_number().over(ordered) - 1) % len(weights)).cast("int")])
    w = w.withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    by_level = Window.orderBy(F.col("_cap") / F.col("_weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    all_ = by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = w.withColumn("_level", (F.sum("source_size").over(all_) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_weight").over(rest))
    opened = F.when(F.col("_weight") * F.col("_level") <= F.col("_cap"), F.struct((F.col("_cap") / F.col("_weight")).alias("k"), F.col("_level").alias("level")))
    w = w.withColumn("_open", F.min(opened).over(all_)["level"])
    target = F.least(F.col("_cap"), F.coalesce(F.col("_weight") * F.col("_open"), F.col("_cap")))
    return w.withColumn("target", F.round(target, 6)).drop("_weight", "_cap", "_level", "_open")


def with_facts(rows: DataFrame, facts: DataFrame, few: bool) -> DataFrame:
    """Rows with the facts of their source (a null source has its own); broadcast only where the sources are few."""
    facts = facts.withColumn("_source", F.struct(F.col("source").isNull(), F.coalesce("source", F.lit("")))).drop("source")
    keyed = rows.withColumn("_source", F.struct(F.col("source").isNull(), F.coalesce("source", F.lit(""))))
    return keyed.join(F.broadcast(facts) if few else facts, "_source").drop("_source")


def pareto_rank(facts_joined: DataFrame) -> DataFrame:
    """Add _rank in (0, 1]: in order of random odds over inclusion odds."""
    p = F.least(F.col("_rest") / F.greatest("source_size", F.lit(1)) * F.col("_x") * F.col("_n") / F.greatest("_xs", F.lit(1e-300)), F.lit(1 - 1e-12))
    odds = F.col("_u") / (1 - F.col("_u")) / F.when(p > 0, p / (1 - p))
    return facts_joined.withColumn("_rank", F.coalesce(odds / (1 + odds), F.lit(1.0)))


def root_size(text: Column) -> Column:
    """The square root of a text's words, as a measure of inclusion: longer documents are likelier, but less than their length."""
    return F.sqrt(word_count(text).cast("double"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most: float = 3.0, inclusion: str | None = None, seed: int = 7) -> DataFrame:
    """How many copies of each document a mix of the given source weights takes.

    docs: doc_id, text, source and any others; all are kept, and size, source_size, target, copies and taken
    (copies * size) are added, in place of columns of those names (also of names that begin with _ used here). Sources
    are ordered by code point, null last, and weigh as the cycle of weights. A source whose target is c whole copies
    and a rest takes c copies of every document for certain. The rest is a sample without replacement: a document of
    inclusion probability p and random number u ranks at (u / (1 - u)) / (p / (1 - p)), and the documents that rank
    first are taken until their words are as near to the rest as a cut in that order allows. p is in proportion to the
    column inclusion where that is given (null, not above 0 or not finite: ranked last), else to root_size() of the text.
    u comes from the digest of doc_id and text, so reruns agree; rows equal in both rank alike and are taken or left
    together. Null and empty texts have size 0 and add no words. An empty table gives no rows.

    Word sums per source and cell of the order find the cell where a source's cut lies; only the documents of that
    cell are ranked one by one, so no task holds a whole source.
    """
    one = root_size(F.col("text")) if inclusion is None else F.coalesce(F.when((F.col(inclusion) > 0) & (F.col(inclusion) < float("inf")), F.col(inclusion).cast("double")), F.lit(0.0))
    base = docs.withColumns({"_x": one}).drop(*[c for c in MINE if c != "_x"])
    base = base.withColumns({"size": word_count(F.col("text")), "_u": uniform(F.col("doc_id"), F.md5(F.coalesce("text", F.lit(""))), seed=seed)})
    slim = checkpointed(base.select("source", "size", "_u", "_x"))

    sums = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_n"), F.sum("_x").alias("_xs"))
    facts = source_targets(sums, weights, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0).cast("long")
    facts = facts.withColumn("_whole", whole)
    facts = checkpointed(facts.withColumn("_rest", F.greatest(F.col("target") - F.col("_whole") * F.col("source_size"), F.lit(0.0))))
    few = facts.count() <= BROADCAST_SOURCES

    ranked = pareto_rank(with_facts(slim, facts.where("_rest > 0"), few)).select("source", "size", "_rank", "_rest")
    ranked = ranked.withColumn("_cell", F.least(F.floor(F.col("_rank") * CELLS), F.lit(CELLS - 1)).cast("int"))
    cells = ranked.groupBy("source", "_cell").agg(F.sum("size").alias("_words"), F.first("_rest").alias("_rest"))
    running = Window.partitionBy("source").orderBy("_cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = cells.withColumn("_upto", F.sum("_words").over(running))
    first = F.struct("_cell", (F.col("_upto") - F.col("_words")).alias("before"))
    crossing = cells.where("_upto >= _rest").groupBy("source").agg(F.min(first).alias("_c")).select("source", F.col("_c._cell").alias("_at"), F.col("_c.before").alias("_before"))
    inside = with_facts(ranked, crossing, few).where("_cell = _at")
    upto = Window.partitionBy("source").orderBy("_rank")  # rows of equal rank count together
    off = F.abs(F.col("_before") + F.sum("size").over(upto) - F.col("_rest"))
    cuts = inside.withColumn("_off", off).groupBy("source").agg(F.min(F.struct("_off", "_rank")).alias("_best"), F.first(F.abs(F.col("_before") - F.col("_rest"))).alias("_none"), F.first("_at").alias("_at"))
    # where the cell is better left whole, the cut is just below it
    cuts = cuts.select("source", F.when(F.col("_best._off") <= F.col("_none"), F.col("_best._rank")).otherwise(F.col("_at") / F.lit(float(CELLS)) - 1e-9).alias("_cut"))
    facts = with_facts(facts, cuts.withColumnRenamed("_cut", "_c"), few).withColumnRenamed("_c", "_cut").unionByName(
        facts.join(cuts.select(F.col("source").alias("_s")), F.col("source").eqNullSafe(F.col("_s")), "left_anti").withColumn("_cut", F.when(F.col("_rest") > 0, F.lit(1.0)).otherwise(F.lit(-1.0)))
    )
    facts = checkpointed(facts)

    out = pareto_rank(with_facts(base, facts, few))
    out = out.withColumn("copies", F.col("_whole") + F.when(F.col("_rank") <= F.col("_cut"), 1).otherwise(0))
    out = out.withColumn("taken", F.col("copies") * F.col("size"))
    return out.select(*[c for c in docs.columns if c not in MINE], "size", "source_size", "target", "copies", "taken")


def mixed_rows(docs: DataFrame, **options: object) -> DataFrame:
    """The mix itself: the rows of docs, each as often as mix() takes it, with the columns of docs as they are."""
    held = {c: f"_held_{k}" for k, c in enumerate(docs.columns) if c in MINE}
    taken = mix(docs.withColumnsRenamed(held), **options).where("copies > 0")
    copies = F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("_copy")
    return taken.select("*", copies).select(*[F.col(held.get(c, c)).alias(c) for c in docs.columns])
