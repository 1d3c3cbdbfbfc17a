"""Input tables, and generators of samples with a known network."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import simulate


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of a folder; columns and filters reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lineitem_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of lineitem that play a node's part, with the derived net price."""
    t = read(spark, sf_dir, "lineitem")
    return t.select(
        "l_quantity", "l_extendedprice", "l_discount", "l_tax", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"), "l_returnflag", "l_linestatus", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_suppkey"
    )


def chain_sample(spark: SparkSession, rows: int = 10_000, seed: int = 1) -> DataFrame:
    """a ~ N(0, 1); b = 1 + 2 a + N; c binary on b; d counts on a; e of three classes
    on b; g one of 50 groups. Draws are hashes of (seed, row): the same however the
    table is cut into partitions."""
    normal, uniform = ((lambda k, f=f: f(F.col("id"), seed, k)) for f in (simulate.normal, simulate.uniform))
    t = spark.range(rows).select("id", normal(0).alias("a")).withColumn("b", 1 + 2 * F.col("a") + normal(1))
    t = t.withColumn("c", F.when(uniform(2) < 1 / (1 + F.exp(-(F.col("b") - 1))), "yes").otherwise("no"))
    t = t.withColumn("d", F.floor(-F.ln(1 - uniform(3)) * F.exp(0.4 * F.col("a")) * 2))
    u = uniform(4) * 3 + F.col("b") / 2
    return t.withColumn("e", F.when(u < 1, "x").when(u < 2.2, "y").otherwise("z")).withColumn("g", F.col("id") % 50)
