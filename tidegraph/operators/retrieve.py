"""One retrieval from questions to final chunks: dense hits, linked entities, walks over both tiers, ranking, fusion, rerank, promotion.

All questions are one table.  A tier may be an empty table, which is how a run without it is made.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from . import cache, fusion, graph, ranking, walk
from .vector_search import ranked, rerank, top_k


@dataclass
class Store:
    """What a retrieval reads: chunks(chunk_id, vec[, text]), index(uid, vec) of entities, both tiers of the graph."""

    chunks: DataFrame
    index: DataFrame
    hot_mentions: DataFrame  # chunk_id, uid
    hot_edges: DataFrame  # src, dst, relation, source_chunk
    kept_vertices: DataFrame  # vid, source_chunk
    kept_edges: DataFrame


@dataclass
class Retrieval:
    dense: DataFrame  # q_id, chunk_id, score, rank
    entities: DataFrame  # q_id, ent_id, weight
    graph: DataFrame  # q_id, chunk_id, score, best_rank, rank
    coverage: DataFrame  # q_id, chunk_id, entities, n_entities
    final: DataFrame  # q_id, chunk_id, rank
    stats: DataFrame


def linked_entities(questions: DataFrame, index: DataFrame, k: int = 5) -> DataFrame:
    """(q_id, ent_id, uid, weight): the k entities nearest to a question, each of weight 1."""
    near = top_k(questions.select("q_id", "qvec"), index, k, key="uid")
    return near.select("q_id", F.col("uid").cast("string").alias("ent_id"), "uid", F.lit(1.0).alias("weight"))


def written_entities(questions: DataFrame, k: int = 5) -> DataFrame:
    """(q_id, ent_id, weight): entities that the question's text names, without a vector (graph-only retrieval)."""
    return questions.select("q_id", F.explode(text.heuristic_entities(F.col("question"), k)).alias("ent_id"), F.lit(1.0).alias("weight"))


def seeds_of(entities: DataFrame, index: DataFrame, k: int = 5) -> DataFrame:
    """(q_id, ent_id, uid, weight): the k entities of the index nearest to each linked entity; an entity is looked up once for all questions."""
    own = entities.select("uid").distinct().join(index, "uid").select(F.col("uid").alias("q_id"), F.col("vec").alias("qvec"))
    near = top_k(own, index, k, key="uid").select(F.col("q_id").alias("uid"), F.col("uid").alias("seed"))
    return entities.join(near, "uid").select("q_id", "ent_id", F.col("seed").alias("uid"), "weight")


def hybrid(questions: DataFrame, store: Store, topk: int = 10, top_entities: int = 5, top_chunks: int = 15, answer_topk: int = 6, how: str = "rrf", own: Column | None = None, max_hops: int = 10, use_dense: bool = True) -> Retrieval:
    """questions(q_id, qvec[, question]) to their chunks. how: rrf, weighted, dual, or graph_only; own: the chunk of a question's own row, left out."""
    if how not in ("rrf", "weighted", "dual", "graph_only"):
        raise ValueError(how)
    dense = top_k(questions, store.chunks, topk, own=own)
    if how == "graph_only" or not use_dense:
        dense = dense.where(F.lit(False))
    entities = walk.cut(linked_entities(questions, store.index, top_entities))
    seeds = walk.cut(seeds_of(entities, store.index, top_entities))
    like = walk.by_cosine(questions, store.index)
    hot, hot_nodes = walk.beam_walk(seeds, store.hot_mentions, store.hot_edges, like, max_hops=max_hops, top_chunks=top_chunks)
    kept, kept_nodes = walk.two_hop(seeds, store.kept_vertices, store.kept_edges, like)
    both = walk.cut(hot.select("q_id", "ent_id", "chunk_id", "score").unionByName(kept))
    where = store.hot_mentions.select("uid", "chunk_id").union(store.kept_vertices.where(F.coalesce("source_chunk", F.lit("")) != "").select("vid", "source_chunk")).distinct()
    nodes = ranking.top_nodes(hot_nodes.unionByName(kept_nodes), top_chunks)
    by_graph = walk.cut(ranking.graph_chunks(both, nodes, where).withColumnRenamed("position", "rank"))
    covered = graph.coverage(both)
    if how == "graph_only":
        final = by_graph.where(F.col("rank") <= answer_topk)
    elif how == "rrf":
        final = fusion.rrf(dense, by_graph)
    elif how == "weighted":
        final = fusion.weighted(dense, by_graph, covered)
    else:
        final = fusion.dual(dense, by_graph, answer_topk)
    final = final.select("q_id", "chunk_id", "rank")
    if "question" in questions.columns and "text" in store.chunks.columns and how != "graph_only":
        final = rerank(final.join(questions.select("q_id", "question"), "q_id").join(store.chunks.select("chunk_id", "text"), "chunk_id"), answer_topk).select("q_id", "chunk_id", "rank")
    final = walk.cut(final.where(F.col("rank") <= answer_topk))
    return Retrieval(dense, entities, by_graph, covered, final, statistics(questions, dense, entities, both, covered, final))


def statistics(questions: DataFrame, dense: DataFrame, entities: DataFrame, graph_hits: DataFrame, covered: DataFrame, final: DataFrame) -> DataFrame:
    """(q_id, dense_total, graph_total, graph_in_final, dense_in_final, overlap, n_entities, n_covered)."""
    flags = (
        dense.select("q_id", "chunk_id", F.lit("d").alias("k"))
        .union(graph_hits.select("q_id", "chunk_id", F.lit("g")).distinct())
        .union(final.select("q_id", "chunk_id", F.lit("f")))
        .groupBy("q_id", "chunk_id")
        .agg(F.collect_set("k").alias("k"))
    )
    has = lambda *x: F.count_if(F.forall(F.array(*[F.lit(v) for v in x]), lambda v: F.array_contains("k", v)))
    counts = flags.groupBy("q_id").agg(has("d").alias("dense_total"), has("g").alias("graph_total"), has("g", "f").alias("graph_in_final"), has("d", "f").alias("dense_in_final"), has("d", "g").alias("overlap"))
    out = questions.select("q_id").join(counts, "q_id", "left").join(entities.groupBy("q_id").agg(F.count_distinct("ent_id").alias("n_entities")), "q_id", "left").join(covered.groupBy("q_id").agg(F.count("*").alias("n_covered")), "q_id", "left")
    return out.fillna(0)


def promoted(covered: DataFrame, tau_hit: int = 3) -> DataFrame:
    """(chunk_id): every covered chunk is an access of its question; those that reach tau_hit."""
    return covered.select("q_id", "chunk_id").distinct().groupBy("chunk_id").agg(F.count("*").alias("hits")).where(F.col("hits") >= tau_hit).select("chunk_id")


def write_promoted(chunks: DataFrame, store: Store, nodes: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The subgraphs of promoted chunks upserted into the kept tier: (vertices, edges, counts of the writes)."""
    return cache.write_subgraphs(chunks, store.hot_mentions, store.hot_edges, store.kept_vertices, store.kept_edges, nodes)


def rerank_others(candidates: DataFrame, keep: DataFrame, n: int) -> DataFrame:
    """candidates(q_id, chunk_id, rank, question, text): those that aren't kept are reranked to max(1, n - kept), then the kept ones in their order up to n."""
    c = candidates.join(keep.select("q_id", "chunk_id").distinct().withColumn("kept", F.lit(True)), ["q_id", "chunk_id"], "left").withColumn("kept", F.coalesce("kept", F.lit(False)))
    n_kept = c.groupBy("q_id").agg(F.count_if("kept").alias("n_kept"))
    others = rerank(c.where("not kept").drop("rank", "kept"), n).join(n_kept, "q_id").where(F.col("rank") <= F.greatest(F.lit(1), F.lit(n) - F.col("n_kept")))
    kept = ranked(c.where("kept"), "q_id", [F.col("rank")], rank="turn").withColumn("later", F.lit(1))
    both = others.select("q_id", "chunk_id", F.lit(0).alias("later"), F.col("rank").alias("turn")).unionByName(kept.select("q_id", "chunk_id", "later", "turn"))
    return ranked(both, "q_id", [F.col("later"), F.col("turn")], n).select("q_id", "chunk_id", "rank")
