"""All pairs of rows of a group, worked out once for each pair of values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 8192  # rows of a group that one task holds against the whole group


def valued_pairs(rows: DataFrame, key: str, value: str, within: list[str], prepare: Callable[[Column], Column], score: Callable[[Column, Column], Column], out: str, keep: bool = False) -> DataFrame:
    """(a, b, out): pairs of rows with equal `within`, ordered by key, with score(prepare(value of a), prepare(value of b)); keep: those alone whose score is true.

    Rows of a group with the same value are one, so the score is worked out once for two values and not once for two rows; what remains for
    each pair is to be written.  A large group is dealt out in blocks.
    """
    spark = rows.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    p = rows.select(*within, F.col(key).alias("k"), F.col(value).alias("v"))
    sizes = p.groupBy(*within).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = p.join(sizes, within).withColumn("block", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int"))
    groups = dealt.groupBy(*within, "blocks", "block", "v").agg(F.collect_list("k").alias("ks"), F.min("k").alias("least"), F.max("k").alias("most"))
    groups = groups.withColumn("x", prepare(F.col("v")))
    a = groups.select(*within, "block", F.col("ks").alias("a"), "least", "x").repartition(n, *within, "block")
    b = groups.select(*within, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("ks").alias("b"), "most", F.col("x").alias("y")).repartition(n, *within, "block")
    both = a.join(b, [*within, "block"]).where("least < most").select("a", "b", score(F.col("x"), F.col("y")).alias(out))
    both = both.where(out) if keep else both
    return both.select(F.explode("a").alias("a"), "b", out).select("a", F.explode("b").alias("b"), out).where("a < b")
