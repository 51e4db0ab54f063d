"""Answers and retrieval against truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metrics, vector


def answers(qa: DataFrame, alpha: float = 0.0) -> DataFrame:
    """qa(q_id, predict, gt) with exact match and ROUGE-L."""
    return qa.select("q_id", metrics.exact_match(F.col("predict"), F.col("gt")).alias("em"), F.round(metrics.rouge_l(F.lower("predict"), F.lower("gt"), alpha), 4).alias("rouge_l"))


def containment(qa: DataFrame) -> DataFrame:
    """qa(q_id, predict, truths array<array<string>>): a flag for each list, and whether the question counts."""
    flags = metrics.contains_all(F.col("predict"), F.col("truths"))
    return qa.select("q_id", flags.alias("flags"), metrics.accurate(flags).alias("correct"))


def retrieval(hits: DataFrame, relevant: DataFrame) -> DataFrame:
    """hits(q_id, chunk_id, rank), relevant(q_id, chunk_id): hit and reciprocal of the first relevant rank, for each question that has hits."""
    first = hits.join(relevant, ["q_id", "chunk_id"], "left_semi").groupBy("q_id").agg(F.min("rank").alias("first"))
    return hits.select("q_id").distinct().join(first, "q_id", "left").select("q_id", F.col("first").isNotNull().cast("int").alias("hit"), F.round(F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0)), 6).alias("rr"))


def report(per_question: DataFrame, columns: list[str]) -> DataFrame:
    return per_question.agg(F.count("*").alias("questions"), *[F.round(F.avg(F.col(c).cast("double")), 4).alias(c) for c in columns])


def semantic(pairs: DataFrame) -> DataFrame:
    """pairs(q_id, pvec, rvec) of predictions and references: the best cosine of each question."""
    return pairs.select("q_id", F.round(vector.cosine(F.col("pvec"), F.col("rvec")), 6).alias("s")).groupBy("q_id").agg(F.max("s").alias("semantic"))


def phases(runs: DataFrame) -> DataFrame:
    """runs(phase, q_id, correct): accuracy of each phase (hot tier alone, persistent tier alone, cold vectors)."""
    return runs.groupBy("phase").agg(F.count("*").alias("questions"), F.round(F.avg(F.col("correct").cast("double")), 4).alias("accuracy"))
