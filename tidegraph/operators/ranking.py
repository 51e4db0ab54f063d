"""Scores of nodes, chunks and facts to ranks and weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import among
from .vector_search import ranked


def top_nodes(scores: DataFrame, k: int) -> DataFrame:
    """scores(q_id, uid, score) summed over entities and tiers; the best k of each question."""
    total = scores.groupBy("q_id", "uid").agg(F.round(F.sum("score"), 6).alias("score"))
    return ranked(total, "q_id", [F.desc("score"), F.col("uid")], k)


def graph_chunks(chunk_scores: DataFrame, nodes: DataFrame, node_chunks: DataFrame) -> DataFrame:
    """Chunks of surviving nodes, by the best rank among their nodes, then by score: (q_id, chunk_id, score, best_rank, position)."""
    best = nodes.join(node_chunks.join(among(nodes.select("uid")), "uid", "left_semi"), "uid").groupBy("q_id", "chunk_id").agg(F.min("rank").alias("best_rank"))
    total = chunk_scores.groupBy("q_id", "chunk_id").agg(F.round(F.sum("score"), 6).alias("score"))
    return ranked(total.join(best, ["q_id", "chunk_id"]), "q_id", [F.col("best_rank"), F.desc("score"), F.col("chunk_id")], rank="position")


def fact_weights(facts: DataFrame, nodes: DataFrame, k: int = 10) -> DataFrame:
    """facts(q_id, subj_uid, obj_uid, score) to weights of their ends in the graph: summed, over ref_count, best k, adding up to 1."""
    ends = facts.select("q_id", F.col("subj_uid").alias("uid"), "score").unionAll(facts.select("q_id", F.col("obj_uid").alias("uid"), "score"))
    total = ends.where(F.col("uid").isNotNull() & (F.col("uid") != 0)).groupBy("q_id", "uid").agg(F.sum("score").alias("total"))
    best = ranked(total.join(nodes.select("uid", "ref_count"), "uid").select("q_id", "uid", F.round(F.col("total") / F.greatest("ref_count", F.lit(1)), 6).alias("score")), "q_id", [F.desc("score"), F.col("uid")], k)
    # where a question's scores add up to 0, shares are what floating point makes of it: 0 / 0 is no number
    whole = F.sum("score").over(Window.partitionBy("q_id"))
    return best.withColumn("weight", F.round(F.when(whole == 0, F.col("score") * float("inf")).otherwise(F.col("score") / F.nullif(whole, F.lit(0.0))), 6))


def minmax(df: DataFrame, value: str, out: str) -> DataFrame:
    """Values of a question scaled by the least and largest positive one, so others fall below 0; 0.5 where those are the same, as they are without any."""
    w = Window.partitionBy("q_id")
    pos = F.when(F.col(value) > 0, F.col(value))
    return df.withColumn(out, _scaled(F.col(value), F.min(pos).over(w), F.max(pos).over(w)))


def _scaled(value: Column, least: Column, most: Column) -> Column:
    low, high = F.coalesce(least, F.lit(0.0)), F.coalesce(most, F.lit(1.0))
    return F.when(high > low, (value - low) / (high - low)).otherwise(F.lit(0.5))


def minmax_of_many(df: DataFrame, value: str, out: str) -> DataFrame:
    """minmax() where rows are many and questions few: the bounds go to the rows, which are made twice and not dealt out by question."""
    pos = F.when(F.col(value) > 0, F.col(value))
    bounds = df.groupBy(F.col("q_id").alias("__q")).agg(F.min(pos).alias("__low"), F.max(pos).alias("__high"))
    both = df.join(F.broadcast(bounds), F.col("q_id").eqNullSafe(F.col("__q")))
    return both.withColumn(out, _scaled(F.col(value), F.col("__low"), F.col("__high"))).drop("__q", "__low", "__high")


def upper_median(df: DataFrame, by: str, value: str) -> DataFrame:
    """(by, median): element n // 2 of the sorted values."""
    order = Window.partitionBy(by).orderBy(value)
    return df.select(by, F.col(value).alias("median"), (F.row_number().over(order) - 1).alias("r"), F.count("*").over(Window.partitionBy(by)).alias("n")).where(F.col("r") == F.floor(F.col("n") / 2)).select(by, "median")
