"""Mixing sources to target weights: iterative proportional fitting, with DataFrame functions only.

Token counts are summed by cell (source, language, topic).  Raking scales the cells in turn until the shares of sources,
languages and topics meet their targets; a cell's calibrated probability is proportional to raked over present
tokens, so the largest is 1 and nothing is repeated.  Documents are kept by a hash of doc_id below their cell's probability, so the
choice is reproducible and doesn't depend on partitions.

Default targets: shares proportional to a power of the tokens at hand, 0.7 for sources and 0.8 for languages (rare ones gain) and 1 for
topics.  Topics are rough forms of text that plain functions can tell: table, list, licence, contact, prose.

Cells are as many as the combinations that occur.  They are raked as a table: each pass is three windowed sums
over cells, never over documents.

Defined cases: null source, language or text are values of their own ('' for the first two), a null doc_id hashes as ''; a text
without words has no tokens and is kept with its cell's probability; a corpus without tokens keeps everything; equal rows
give equal results; an empty table gives an empty result; further columns are carried, clashing names are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

WORD = r"[^\x20\x09-\x0D]+"
PASSES, POWERS, SEED = 6, {"source": 0.7, "lang": 0.8, "topic": 1.0}, "mix-1"
DERIVED = ("mix_source", "mix_lang", "mix_topic", "n_tokens", "target_weight", "probability", "kept")


def topic() -> Column:
    text = F.coalesce(F.col("text"), F.lit(""))
    return (
        F.when(text.contains(" | "), "table")
        .when(text.contains("\n- ") | text.contains("\n* "), "list")
        .when(F.lower(text).contains("license") | F.lower(text).contains("rights reserved"), "licence")
        .when(text.contains("@"), "contact")
        .otherwise("prose")
    )


def measured(docs: DataFrame) -> DataFrame:
    """docs with their cell and tokens (words)."""
    kept = docs.select(*[c for c in docs.columns if c.lower() not in DERIVED])
    return kept.select(
        "*",
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("mix_source"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("mix_lang"),
        topic().alias("mix_topic"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_tokens"),
    )


def raked(cells: DataFrame, powers: dict[str, float], passes: int) -> DataFrame:
    """cells(mix_source, mix_lang, mix_topic, tokens) with w: shares whose marginals meet their targets."""
    everything = Window.partitionBy(F.lit(0))
    cells = cells.withColumn("w", F.col("tokens").cast("double"))
    axes = ("source", "lang", "topic")
    for a in axes:
        mass = F.pow(F.sum("tokens").over(Window.partitionBy(f"mix_{a}")).cast("double"), F.lit(float(powers[a])))
        cells = cells.withColumn(f"t_{a}", mass)
        # the targets of an axis add up to 1: each cell counts its value's mass once
        n = F.count("*").over(Window.partitionBy(f"mix_{a}"))
        cells = cells.withColumn(f"n_{a}", n)
        cells = cells.withColumn(f"t_{a}", F.col(f"t_{a}") / F.sum(F.col(f"t_{a}") / F.col(f"n_{a}")).over(everything)).drop(f"n_{a}")
    for _ in range(passes):
        for a in axes:
            cells = cells.withColumn("w", F.col("w") * F.col(f"t_{a}") / F.sum("w").over(Window.partitionBy(f"mix_{a}")))
    return cells.select("mix_source", "mix_lang", "mix_topic", "tokens", "w")


def uniform(seed: str = SEED) -> Column:
    """In [0, 1), from 52 bits of a hash of doc_id."""
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def mixture(docs: DataFrame, powers: dict[str, float] | None = None, passes: int = PASSES, seed: str = SEED) -> DataFrame:
    """docs with their cell, tokens, target_weight (share of the mixture), probability and kept."""
    rows = measured(docs)
    names = ["mix_source", "mix_lang", "mix_topic"]
    cells = common.written(rows.groupBy(*names).agg(F.sum("n_tokens").alias("tokens")), "mix-cells")
    whole = cells.where("tokens > 0")
    fitted = raked(whole, powers or POWERS, passes).withColumn("ratio", F.col("w") / F.col("tokens"))
    fitted = fitted.withColumn("p", F.round(F.col("ratio") / F.max("ratio").over(Window.partitionBy(F.lit(0))), 9))
    table = common.written(cells.join(fitted.select(*[F.col(c).alias(f"f_{c}") for c in names], "w", "p"), [F.col(c) == F.col(f"f_{c}") for c in names], "left").select(*names, F.round(F.coalesce("w", F.lit(0.0)), 9).alias("target_weight"), F.coalesce("p", F.lit(1.0)).alias("probability")), "mix-weights")
    out = rows.join(table, names)  # cells are few: the planner broadcasts them by their size
    return out.withColumn("kept", uniform(seed) < F.col("probability"))


def _oracle() -> str:
    """The same steps as SQL over whole tables; a pass is three nested selections."""
    axes = ("source", "lang", "topic")
    steps = [
        r"""rows_ AS (
  SELECT doc_id, coalesce(source, '') AS mix_source, coalesce(lang, '') AS mix_lang,
         CASE WHEN coalesce(text, '') LIKE '% | %' THEN 'table'
              WHEN contains(coalesce(text, ''), chr(10) || '- ') OR contains(coalesce(text, ''), chr(10) || '* ') THEN 'list'
              WHEN contains(lower(coalesce(text, '')), 'license') OR contains(lower(coalesce(text, '')), 'rights reserved') THEN 'licence'
              WHEN contains(coalesce(text, ''), '@') THEN 'contact' ELSE 'prose' END AS mix_topic,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS n_tokens
  FROM documents)""",
        "cells AS (SELECT mix_source, mix_lang, mix_topic, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM rows_ GROUP BY ALL)",
        "k0 AS (SELECT *, CAST(tokens AS DOUBLE) AS w FROM cells WHERE tokens > 0)",
    ]
    at = 0
    for a in axes:
        steps.append(f"k{at + 1} AS (SELECT *, pow(CAST(sum(tokens) OVER (PARTITION BY mix_{a}) AS DOUBLE), {POWERS[a]}) AS m_{a}, count(*) OVER (PARTITION BY mix_{a}) AS n_{a} FROM k{at})")
        steps.append(f"k{at + 2} AS (SELECT * EXCLUDE (m_{a}, n_{a}), m_{a} / sum(m_{a} / n_{a}) OVER () AS t_{a} FROM k{at + 1})")
        at += 2
    for _ in range(PASSES):
        for a in axes:
            steps.append(f"k{at + 1} AS (SELECT * REPLACE (w * t_{a} / sum(w) OVER (PARTITION BY mix_{a}) AS w) FROM k{at})")
            at += 1
    steps.append(f"fit AS (SELECT *, round((w / tokens) / max(w / tokens) OVER (), 9) AS p FROM k{at})")
    steps.append("weights AS (SELECT c.mix_source, c.mix_lang, c.mix_topic, round(coalesce(f.w, 0.0), 9) AS target_weight, coalesce(f.p, 1.0) AS probability FROM cells c LEFT JOIN fit f USING (mix_source, mix_lang, mix_topic))")
    return "WITH " + ",\n".join(steps) + f"""
SELECT doc_id, mix_source, mix_lang, mix_topic, n_tokens, round(target_weight, 6) AS target_weight, round(probability, 6) AS probability,
       CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':{SEED}'), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE < probability AS kept
FROM rows_ JOIN weights USING (mix_source, mix_lang, mix_topic)
"""


ORACLE = _oracle()
