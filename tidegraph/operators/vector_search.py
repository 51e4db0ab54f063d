"""Exact top-k by cosine of a query set against all rows, in blocks of queries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK = 256
LEAST_ROWS, SHARD_ROWS = 4096, 65536  # rows of a shard: no fewer than the first if there are few, no more than about the second


def in_blocks(queries: DataFrame, corpus: DataFrame, q_id: str = "q_id") -> DataFrame:
    """Each query beside each row of corpus: queries are packed in blocks, and a row meets a whole block at once.

    The work is the stated query set times the rows; what is sent is the rows times the number of blocks.
    """
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    packed = queries.groupBy(F.pmod(F.xxhash64(q_id), F.lit(blocks)).cast("int").alias("__b")).agg(F.collect_list(F.struct(*queries.columns)).alias("__q"))
    spread = corpus.withColumn("__b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return spread.join(packed, "__b").withColumn("__x", F.explode("__q")).select(*[F.col(f"__x.{c}").alias(c) for c in queries.columns], *corpus.columns)


def ranked(df: DataFrame, by: str | list[str], order: list[Column], k: int | None = None, rank: str = "rank") -> DataFrame:
    """rank from 1 within `by`; with k only the first k, which Spark limits before and after the shuffle."""
    out = df.withColumn(rank, F.row_number().over(Window.partitionBy(*([by] if isinstance(by, str) else by)).orderBy(*order)).cast("bigint"))
    return out.where(F.col(rank) <= k) if k else out


def top_k(queries: DataFrame, corpus: DataFrame, k: int = 10, key: str = "chunk_id", own: Column | None = None, within: str | None = None) -> DataFrame:
    """(q_id, key, score, rank): cosine of qvec with vec, 6 decimals; ties to the smaller key.

    own: the key of a query's own row, which is left out; within: a column of both sides that has to be equal.  Shards of the
    corpus meet blocks of queries in Arrow batches: a matrix product, of which the k best a query are passed on, so what is
    sent is rows times blocks of queries, and k rows for each query and shard.
    """
    return ranked(scores(queries, corpus, k, key, own, within), "q_id", [F.desc("score"), F.col(key)], k)


def scores(queries: DataFrame, corpus: DataFrame, k: int | None = None, key: str = "chunk_id", own: Column | None = None, within: str | None = None) -> DataFrame:
    """(q_id, key, score) as top_k passes them on, k or more for each query and shard; without k those of all rows, which stay where they are."""
    spark = queries.sparkSession
    n_q, n_c = queries.count(), corpus.count()
    blocks = max(1, -(-n_q // QUERY_BLOCK))
    shards = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_c // LEAST_ROWS)), -(-n_c // SHARD_ROWS))
    same = F.col(within) if within else F.lit(0)
    asked = queries.select("q_id", "qvec", (own if own is not None else F.lit(None)).cast("string").alias("own"), same.alias("same"), F.pmod(F.xxhash64("q_id"), F.lit(blocks)).cast("int").alias("b"))
    asked = asked.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    rows = corpus.select(F.col(key).cast("string").alias("id"), "vec", same.alias("same"), F.pmod(F.xxhash64(key), F.lit(shards)).cast("int").alias("s"))
    rows = rows.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    kind = queries.schema["q_id"].dataType.simpleString()

    def meet(q: pa.Table, c: pa.Table) -> pa.Table:
        out = best_of(q, c, len(c) if k is None else k)
        return pa.table({"q_id": q.column("q_id").take(pa.array(out[0])), "id": c.column("id").take(pa.array(out[1])), "score": out[2]})

    scored = asked.groupBy("b", "s").cogroup(rows.groupBy("b", "s")).applyInArrow(meet, f"q_id {kind}, id string, score double")
    return scored.select("q_id", F.col("id").cast(corpus.schema[key].dataType).alias(key), "score")


def best_of(q: pa.Table, c: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of c, score) of the k best and of what ties with the last, for each row of q."""
    none = np.zeros(0, np.int64)
    if not len(q) or not len(c):
        return none, none, np.zeros(0)
    unit = []
    for table, name in ((q, "qvec"), (c, "vec")):
        x = table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(table), -1).astype(np.float64)
        length = np.sqrt((x * x).sum(axis=1, keepdims=True))
        unit.append(np.divide(x, length, out=np.zeros_like(x), where=length > 0))
    ids = c.column("id").to_numpy(zero_copy_only=False)
    group_q, group_c = (t.column("same").to_numpy(zero_copy_only=False) for t in (q, c))
    alike = (group_q != group_q[0]).any() or (group_c != group_q[0]).any()
    own = q.column("own").to_pylist()
    rows, found, scores = [], [], []
    for i in range(len(q)):
        s = np.round(unit[1] @ unit[0][i], 6) + 0.0
        ok = np.ones(len(s), bool) if own[i] is None else ids != own[i]
        if alike:
            ok &= group_c == group_q[i]
        at = np.flatnonzero(ok)
        if len(at) > k:
            at = at[s[at] >= np.partition(s[at], len(at) - k)[len(at) - k]]
        rows.append(np.full(len(at), i))
        found.append(at)
        scores.append(s[at])
    return tuple(np.concatenate(x) for x in (rows, found, scores))


def rerank(pairs: DataFrame, n: int) -> DataFrame:
    """Best n per query by the lexical score (Jaccard of lower-case words of question and text), ties by chunk_id."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.col(c)), r"\s+"), lambda t: t != ""))
    a, b = words("question"), words("text")
    union = F.size(F.array_union(a, b))
    scored = pairs.withColumn("rerank_score", F.round(F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union), 6))
    return ranked(scored, "q_id", [F.desc("rerank_score"), F.col("chunk_id")], n)
