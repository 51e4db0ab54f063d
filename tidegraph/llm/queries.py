"""The queries of this subpackage: each applies its operator to its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, mixing, pieces, quality, rules, simhash, suffix, tokens, topk, windows


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    net = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.classify(docs, net).select("doc_id", langid.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_docs(spark, sf_dir), shingle=4, radius=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(_docs(spark, sf_dir))


def op4_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.exact_substrings(_docs(spark, sf_dir), length=50)
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest(_docs(spark, sf_dir), tokenizer_file("piece_bpe_32k.model"))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    found = langid.identify(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), langid.fit(docs))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "rejected")


def tokenizer_file(name: str) -> str:
    """Where the machine keeps a public tokenizer; the files are never copied into the repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.digests(spark, tokens.dataset(_docs(spark, sf_dir), tokenizer_file("word_bpe_49k.json"), end_id=1))


def op8_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = windows.near_passages(_docs(spark, sf_dir))
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_words", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "spans", F.sha2("kept", 256).alias("kept_sha256"), F.col("kept").cast("string").alias("text"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mixture(_docs(spark, sf_dir))
    return found.select("doc_id", "mix_source", "mix_lang", "mix_topic", "n_tokens", F.round("target_weight", 6).alias("target_weight"), F.round("probability", 6).alias("probability"), "kept")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=10)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": op1_quality,
        "op2_simhash": op2_simhash,
        "op3_rules": op3_rules,
        "op4_suffix_array": op4_suffix_array,
        "op5_pieces": op5_pieces,
        "op6_langid": op6_langid,
        "op7_tokens": op7_tokens,
        "op8_windows": op8_windows,
        "op9_mixing": op9_mixing,
        "op10_topk": op10_topk,
    }


def oracle_sql() -> dict[str, str]:
    return {"op9_mixing": mixing.ORACLE, "op10_topk": topk.ORACLE}
