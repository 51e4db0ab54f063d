"""Exact top-k by inner product, block at a time.

Vectors of integers are dealt to shards by runs of ids; a shard lays them out in blocks of like rows, each with the largest and smallest value of every component.  Components
are a query's terms: its bound for a block is the sum over terms of the query's weight times the block's maximum (minimum,
for a negative weight).  A query takes a shard's blocks by falling bound, scores a whole block through its forward index,
and ends with the first bound below its k-th best score so far; bounds equal to it are still read, for ties.

Queries travel in groups to the shards of blocks, so neither side is ever in one place.

Defined cases: a null vec_id takes no part, nor do null vectors or those with null or non-finite components; vectors of different
lengths aren't compared; ties go to the smaller vec_id; a query never finds rows with its own vec_id; where a query's vec_id
repeats, its smallest vector is the query, while repeated candidates are found as often as they are there; sums beyond 64 bits
saturate; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

BLOCK, SHARD, GROUP = 256, 64, 1024  # ids of a block, blocks of a shard, queries of a group


def quantised(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, q, dim): floor(scale * component), of the vectors that take part."""
    usable = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    q = F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    return vectors.where(usable).select(F.col("vec_id").cast("long").alias("vec_id"), q.alias("q")).withColumn("dim", F.size("q"))


def products(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """Integer inner products of rows with a vector; floating point only where every partial sum is exact."""
    most = float(np.abs(matrix).max(initial=0)) * float(np.abs(vector).max(initial=0)) * max(1, len(vector))
    if most < 2**53:
        return (matrix.astype(np.float64) @ vector.astype(np.float64)).astype(np.int64)
    if most < 2**62:
        return matrix @ vector
    exact = matrix.astype(object) @ vector.astype(object)
    return np.array([max(-(2**63), min(2**63 - 1, x)) for x in exact], np.int64)


def arranged(matrix: np.ndarray, most: int = BLOCK) -> np.ndarray:
    """An order of rows in which each run of `most` is alike: halves along the component that varies most, again and again."""
    out, todo = [], [np.arange(len(matrix))]
    while todo:
        own = todo.pop()
        if len(own) <= most:
            out.append(own)
            continue
        rows = matrix[own]
        by = rows[:, int(rows.var(axis=0, dtype=np.float64).argmax())] if rows.shape[1] else np.zeros(len(own), np.int64)
        half = -(-len(own) // (2 * most)) * most  # whole blocks
        order = np.argsort(by, kind="stable")
        todo += [own[order[half:]], own[order[:half]]]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def search(ids: np.ndarray, matrix: np.ndarray, edges: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int):
    """(query_id, vec_id, score) of each query's k best among rows in blocks edges[i]:edges[i + 1]; and the share of blocks that were read."""
    high, low = (f.reduceat(matrix, edges[:-1], axis=0).astype(np.float64) for f in (np.maximum, np.minimum))
    weight = queries.astype(np.float64)
    bounds = np.maximum(weight, 0) @ high.T + np.minimum(weight, 0) @ low.T
    slack = np.abs(bounds) * 1e-12 + 1  # a bound is never below the exact one
    out, read = [], 0
    blocks = [matrix[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
    for i, own in enumerate(query_ids):
        best_id, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for j in np.argsort(-bounds[i], kind="stable"):
            if len(best) == k and bounds[i, j] + slack[i, j] < best[-1]:
                break
            read += 1
            got, who = products(blocks[j], queries[i]), ids[edges[j] : edges[j + 1]]
            keep = (who != own) & (got >= best[-1] if len(best) == k else True)
            best_id, best = np.concatenate([best_id, who[keep]]), np.concatenate([best, got[keep]])
            order = np.lexsort((best_id, -best))[:k]
            best_id, best = best_id[order], best[order]
        out.append((np.full(len(best), own), best_id, best))
    return [np.concatenate(x) for x in zip(*out, strict=True)], read / max(1, bounds.size)


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score) for each vec_id divisible by `every`, against all rows."""
    spark = vectors.sparkSession
    common.small_batches(spark)
    rows = quantised(vectors, scale)
    wanted = rows.where(F.col("vec_id") % every == 0).groupBy("dim", "vec_id").agg(F.min("q").alias("q"))
    shards = F.floor(F.col("vec_id") / (BLOCK * SHARD))

    def packed(key, table):
        ids = table.column("vec_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        flat = table.column("q").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1) if len(ids) else np.zeros((0, 0), np.int64)
        return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "at": pa.array([key[1].as_py()], pa.int64()), "block": pa.array([common.pack(ids[order], flat[order].reshape(-1))], pa.binary())})

    kind = "dim int, at long, block binary"
    block = rows.select("dim", shards.alias("at"), "vec_id", "q").groupBy("dim", "at").applyInArrow(packed, kind)
    # two numbers for each length of vectors: how many places the blocks and the groups of queries take; joined by what they weigh at run time
    n = rows.groupBy("dim").agg(F.ceil(F.count("*") / (BLOCK * SHARD)).alias("n_shards"), F.ceil(F.count_if(F.col("vec_id") % every == 0) / GROUP).alias("n_groups")).where("n_groups > 0")
    asked = wanted.join(n, "dim").select("dim", F.pmod(F.floor(F.col("vec_id") / every), F.col("n_groups")).alias("at"), "vec_id", "q")
    group = asked.groupBy("dim", "at").applyInArrow(packed, kind)
    # every group meets every shard once
    left = block.join(n, "dim").select("dim", F.pmod("at", "n_shards").alias("shard"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_groups") - 1)).alias("grp"), "block")
    right = group.join(n, "dim").select("dim", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_shards") - 1)).alias("shard"), F.col("at").alias("grp"), "block")

    def meet(key, a, b):
        dim = key[0].as_py()
        ids, flat = (np.concatenate(x) for x in zip(*map(common.unpack, a.column("block").to_pylist()), strict=True)) if len(a) else (np.zeros(0, np.int64),) * 2
        who, ask = (np.concatenate(x) for x in zip(*map(common.unpack, b.column("block").to_pylist()), strict=True)) if len(b) else (np.zeros(0, np.int64),) * 2
        if not len(ids) or not len(who):
            found = [np.zeros(0, np.int64)] * 3
        else:
            matrix = flat.reshape(len(ids), dim)
            order = arranged(matrix)
            edges = np.append(np.arange(0, len(ids), BLOCK), len(ids))
            found, _ = search(ids[order], matrix[order], edges, who, ask.reshape(len(who), dim), k)
        return pa.table({"query_id": found[0], "vec_id": found[1], "score": found[2]})

    near = left.groupBy("dim", "shard", "grp").cogroup(right.groupBy("dim", "shard", "grp")).applyInArrow(meet, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
         CAST(list_inner_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
