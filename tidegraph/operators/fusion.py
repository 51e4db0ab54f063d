"""Combining a dense and a graph ranking of chunks; every list is (q_id, chunk_id, rank from 1[, score])."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranking import minmax
from .vector_search import ranked


def rrf(dense: DataFrame, graph: DataFrame, k: int = 60, pool: int = 20) -> DataFrame:
    """Reciprocal rank fusion: the sum of 1 / (k + rank); the best `pool`."""
    both = dense.select("q_id", "chunk_id", "rank").unionAll(graph.select("q_id", "chunk_id", "rank"))
    fused = both.groupBy("q_id", "chunk_id").agg(F.round(F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))), 6).alias("score"))
    return ranked(fused, "q_id", [F.desc("score"), F.col("chunk_id")], pool)


def weighted(dense: DataFrame, graph: DataFrame, covered: DataFrame, w: float = 0.5, overlap_boost: float = 3.0, coverage_boost: float = 1.3, threshold: int = 2, pool: int = 30) -> DataFrame:
    """Normalised scores: both lists have it: the larger times overlap_boost; else the weighted sum.

    A chunk that n >= threshold entities cover is multiplied by coverage_boost^(n - threshold + 1).  A chunk of the graph
    alone gets the least dense value, one of the dense list alone 0 from the graph.
    """
    d = minmax(dense.select("q_id", "chunk_id", F.col("score").alias("ds")), "ds", "dn").withColumn("in_d", F.lit(True))
    g = minmax(graph.select("q_id", "chunk_id", F.col("score").alias("gs")), "gs", "gn").withColumn("in_g", F.lit(True))
    low = d.groupBy("q_id").agg(F.coalesce(F.min("dn"), F.lit(0.0)).alias("low"))
    x = d.join(g, ["q_id", "chunk_id"], "full_outer").join(low, "q_id", "left").join(covered.select("q_id", "chunk_id", "n_entities"), ["q_id", "chunk_id"], "left")
    dn = F.coalesce("dn", "low", F.lit(0.0))
    gn = F.coalesce("gn", F.lit(0.0))
    score = F.when(F.col("in_d") & F.col("in_g"), F.greatest(dn, gn) * overlap_boost).otherwise(F.lit(w) * dn + F.lit(1 - w) * gn)
    n = F.coalesce("n_entities", F.lit(0))
    score = F.when(n >= threshold, score * F.pow(F.lit(coverage_boost), n - threshold + 1)).otherwise(score)
    return ranked(x.select("q_id", "chunk_id", F.round(score, 6).alias("score")), "q_id", [F.desc("score"), F.col("chunk_id")], pool)


def dual(dense: DataFrame, graph: DataFrame, k: int = 6) -> DataFrame:
    """Chunks of both lists in graph order, then dense-only and graph-only by turns; k of each question."""
    d, g = dense.select("q_id", "chunk_id", F.col("rank").alias("dr")), graph.select("q_id", "chunk_id", F.col("rank").alias("gr"))
    x = d.join(g, ["q_id", "chunk_id"], "full_outer")
    x = x.withColumn("section", F.when(F.col("dr").isNotNull() & F.col("gr").isNotNull(), 0).otherwise(1)).withColumn("source", F.when(F.col("section") == 0, 0).when(F.col("dr").isNotNull(), 0).otherwise(1))
    own = F.when(F.col("section") == 0, F.col("gr")).otherwise(F.coalesce("dr", "gr"))
    turn = F.row_number().over(Window.partitionBy("q_id", "section", "source").orderBy(own))
    x = x.withColumn("turn", turn)
    return ranked(x, "q_id", [F.col("section"), F.col("turn"), F.col("source")], k).select("q_id", "chunk_id", "rank")
