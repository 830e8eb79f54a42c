"""Population-stability indices between samples and over time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import PSI_CLASSES, class_of, half_even
from ..sources.files import once
from .order import melted, quantiles


def pairs_of(samples: Sequence[object]) -> list[tuple[str, str]]:
    """Consecutive samples."""
    return [(str(a), str(b)) for a, b in zip(samples, samples[1:])]


def bin_of(value: Column, edges: Sequence[float]) -> Column:
    """The number of the right-closed bin (a, b] between distinct ascending edges; null at or below the first and above the last.

    So the least value of the reference sample falls in no bin, as in the index that is reproduced here.
    """
    above = F.lit(0)
    for e in edges:
        above = above + F.when(F.lit(e) < value, 1).otherwise(0)
    return F.when((above >= 1) & (above < len(edges)), above)


def compared(counts: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Each count (_sample, ..., n) once for each pair its sample is in: (ref, curr, is_ref, ..., n)."""
    sides = F.array(*[F.struct(F.lit(a).alias("ref"), F.lit(b).alias("curr"), F.lit(side == a).alias("is_ref"), F.lit(side).alias("_s")) for a, b in pairs for side in (a, b)])
    rest = [c for c in counts.columns if c != "_sample"]
    mine = F.filter(sides, lambda s: s["_s"] == F.col("_sample"))
    return counts.select(*rest, F.explode(mine).alias("p")).select("p.ref", "p.curr", "p.is_ref", *rest)


def shares(rows: DataFrame) -> DataFrame:
    """(ref, curr, variable, bin, r, c) shares of both samples per bin, from counts (ref, curr, is_ref, variable, bin, n)."""
    counts = rows.groupBy("ref", "curr", "variable", "bin").agg(F.sum(F.when(F.col("is_ref"), F.col("n")).otherwise(0)).alias("_r"), F.sum(F.when(~F.col("is_ref"), F.col("n")).otherwise(0)).alias("_c"))
    totals = counts.groupBy("ref", "curr", "variable").agg(F.sum("_r").alias("_rn"), F.sum("_c").alias("_cn"))
    joined = counts.join(totals, ["ref", "curr", "variable"])
    return joined.select("ref", "curr", "variable", "bin", F.try_divide(F.col("_r").cast("double"), F.col("_rn")).alias("r"), F.try_divide(F.col("_c").cast("double"), F.col("_cn")).alias("c"))


def psi_of(table: DataFrame) -> DataFrame:
    """(ref, curr, variable, psi) = sum of (c - r) ln(c / r); null where a bin of either sample is empty (see empty_bins)."""
    term = F.when((F.col("r") > 0) & (F.col("c") > 0), (F.col("c") - F.col("r")) * F.ln(F.col("c") / F.col("r")))
    found = table.groupBy("ref", "curr", "variable").agg(F.sum(term).alias("psi"), F.count(term).alias("_n"), F.count(F.lit(1)).alias("_of"))
    return found.select("ref", "curr", "variable", F.when(F.col("_n") == F.col("_of"), F.col("psi")).alias("psi"))


def binned_shares(df: DataFrame, sample: str, pairs: Sequence[tuple[str, str]], continuous: Sequence[str], bins: int) -> DataFrame:
    """shares() of continuous variables in the quantile bins of each pair's reference sample.

    Edges are numbers on the driver. Rows are counted by their bins of all reference samples, of which a variable has no more
    combinations than edges, before a count is repeated for the pairs.
    """
    refs, keys = sorted({a for a, _ in pairs}), ["ref", "curr", "variable"]
    rows = df.select(F.col(sample).cast("string").alias("_sample"), *continuous)
    long = melted(rows.where(F.col("_sample").isin(refs)).withColumnRenamed("_sample", "ref"), continuous, ["ref"])
    own = quantiles(long, ["ref", "variable"], [k / bins for k in range(bins + 1)]).select("ref", "variable", F.array_distinct("q").alias("_edges"))
    found = own.collect()  # a row per reference sample and variable
    at = {(r["ref"], r["variable"]): r["_edges"] for r in found}
    each = [F.struct(F.lit(v).alias("variable"), *[(bin_of(F.col(v).cast("double"), at[a, v]) if (a, v) in at else F.lit(None).cast("int")).alias(f"b{k}") for k, a in enumerate(refs)]) for v in continuous]
    counts = rows.select("_sample", F.explode(F.array(*each)).alias("p")).groupBy("_sample", "p.variable", *[f"p.b{k}" for k in range(len(refs))]).agg(F.count(F.lit(1)).alias("n"))
    paired = compared(counts, pairs)
    number = F.coalesce(*[F.when(F.col("ref") == a, F.col(f"b{k}")) for k, a in enumerate(refs)])
    placed = paired.select(*keys, "is_ref", "n", number.cast("string").alias("bin")).where("bin is not null")
    edges = df.sparkSession.createDataFrame(found, own.schema).join(F.broadcast(df.sparkSession.createDataFrame(pairs, "ref string, curr string")), "ref")  # a row per pair
    known = edges.select(*keys, F.explode(F.sequence(F.lit(1), F.size("_edges") - 1).cast("array<string>")).alias("bin"))
    return known.join(shares(placed), [*keys, "bin"], "left").fillna(0.0, ["r", "c"])


def psi(df: DataFrame, sample: str, pairs: Sequence[tuple[str, str]], continuous: Sequence[str] = (), qualitative: Sequence[str] = (), bins: int = 10, on_empty: str = "null") -> DataFrame:
    """(ref, curr, variable, psi) for each pair of samples and variable.

    on_empty: what an empty bin of either sample does: 'null' (the index is null) or 'raise' (ValueError naming the bins).
    """
    df = once(df.select(sample, *continuous, *qualitative))
    tables = []
    if continuous:
        tables.append(binned_shares(df, sample, pairs, continuous, bins))
    if qualitative:
        long = melted(df.withColumn("_sample", F.col(sample).cast("string")), qualitative, ["_sample"], "string").where("value is not null")
        tables.append(shares(compared(long.groupBy("_sample", "variable", F.col("value").alias("bin")).agg(F.count(F.lit(1)).alias("n")), pairs)))
    table = tables[0] if len(tables) == 1 else tables[0].unionByName(tables[1])
    if on_empty == "raise":
        bad = table.where("r = 0 or c = 0").select("variable", "ref", "curr", "bin").limit(20).collect()
        if bad:
            raise ValueError("empty bins: " + "; ".join(f"{r['variable']} {r['ref']}-{r['curr']} bin {r['bin']}" for r in bad))
    return psi_of(table)


def psi_table(df: DataFrame, sample: str, pairs: Sequence[tuple[str, str]], continuous: Sequence[str] = (), qualitative: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """A row per variable: a column of the index (4 decimals) for each pair, worst, and stability by the worst."""
    names = [f"{a}-{b}" for a, b in pairs]
    long = psi(df, sample, pairs, continuous, qualitative, bins)
    wide = long.withColumns({"psi": half_even(F.col("psi"), 4), "pair": F.concat_ws("-", "ref", "curr")}).groupBy("variable").pivot("pair", names).agg(F.first("psi"))
    worst = F.array_max(F.array(*[F.col(f"`{n}`") for n in names]))
    return wide.withColumn("worst", worst).withColumn("stability", class_of(F.col("worst"), PSI_CLASSES))
