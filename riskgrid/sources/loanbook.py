"""A loan book out of lineitem, orders and customer: the columns that the registered queries work on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.order import parted, positions

KEYS = ["k1", "k2", "k3", "k4", "k5"]
CONTINUOUS = ["l_extendedprice", "l_quantity", "c_acctbal"]
CATEGORICAL = ["o_orderpriority", "c_mktsegment", "o_orderstatus", "l_linestatus"]
OOT_YEAR = 2001
FOLDS = 4


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per loan: five key columns, u (noise 0..999), def (target), year, features, two of them with missing values."""
    item, orders, customer = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "orders", "customer"))
    # orders meet their customers first, as they are a fraction of the items: so each item is moved for one join, and as orders are hashed, items are not sorted for it
    owned = parted(orders.join(customer, F.col("o_custkey") == F.col("c_custkey")), n := item.count(), "o_orderkey").hint("shuffle_hash")
    joined = parted(item, n, "l_orderkey").join(owned, F.col("l_orderkey") == F.col("o_orderkey"))
    shift = F.when(F.col("o_orderpriority") == "1-URGENT", 120).when(F.col("o_orderpriority") == "5-LOW", -40).otherwise(0)
    noise = (F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104729 + F.col("l_partkey") * 31) % 1000
    book = joined.select(
        *[F.col(c).alias(k) for c, k in zip(("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"), KEYS)],
        noise.cast("long").alias("u"),
        F.year("l_shipdate").alias("year"),
        *["l_extendedprice", "l_quantity", "l_discount", "l_tax", "c_acctbal"],
        *CATEGORICAL,
        F.when((F.col("l_orderkey") + F.col("l_partkey")) % 11 != 0, F.col("l_quantity")).alias("emp_like"),
        F.when((F.col("l_orderkey") + F.col("l_suppkey")) % 10 != 0, F.col("l_discount")).alias("rate_like"),
        shift.alias("_shift"),
    )
    target = F.col("u") < 60 + 6 * F.col("l_quantity") + 1500 * F.col("l_discount") + F.col("_shift")
    return book.withColumn("def", target.cast("int")).drop("_shift")


def loan_book(spark: SparkSession, sf_dir: str, columns: Sequence[str] | None = None) -> DataFrame:
    """lines() with fold (0..3, balanced within target and year) and dataset (Train, Test: every fifth, OOT: the last year).

    columns: those of lines() that are wanted besides def, year and u; all, if none are named. The tables are joined once and the
    book is written (see operators.order.positions), so each pass over it is a scan.
    """
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    book = positions(lines(spark, sf_dir), ["def", "year"], "u", KEYS, "_position", columns, items)
    dataset = F.when(F.col("year") == OOT_YEAR, "OOT").when(F.col("_position") % 5 == 0, "Test").otherwise("Train")
    return book.withColumns({"fold": (F.col("_position") % FOLDS).cast("int"), "dataset": dataset}).drop("_position")
