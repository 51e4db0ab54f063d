"""The bounded hot tier as tables: accesses(chunk_id, ts, event_id) and mentions/edges of resident chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import among, both_ways, chunk_subgraph
from .ranking import upper_median
from .store import upsert


def chunk_state(accesses: DataFrame) -> DataFrame:
    """(chunk_id, created_at, last_access, hits)."""
    return accesses.groupBy("chunk_id").agg(F.min("ts").alias("created_at"), F.max("ts").alias("last_access"), F.count("*").alias("hits"))


def promotions(accesses: DataFrame, tau_hit: int = 3) -> DataFrame:
    """The access at which a chunk's count reaches tau_hit: it fires once."""
    w = Window.partitionBy("chunk_id").orderBy("ts", "event_id")
    return accesses.withColumn("hit", F.row_number().over(w)).where(F.col("hit") == tau_hit).select("chunk_id", F.col("ts").alias("promoted_at"), "event_id")


def expired(state: DataFrame, now: Column, ttl_s: int) -> DataFrame:
    """Chunks idle for more than ttl_s (not: as long); none if it is 0."""
    idle = F.unix_timestamp(now) - F.unix_timestamp("last_access")
    return state.where((F.lit(ttl_s) > 0) & (idle > ttl_s))


def over_capacity(state: DataFrame, n_nodes: int, c_max: int, max_nodes: int | None = None) -> bool:
    return state.count() > c_max or (max_nodes is not None and n_nodes > max_nodes)


def evictions(state: DataFrame, c_max: int) -> DataFrame:
    """Chunks beyond capacity: those without hits first, then by last access; (chunk_id, position).

    Positions come from counts of a sorted histogram of (has hits, last access), so no task sees all chunks.
    """
    keyed = state.select("chunk_id", (F.col("hits") > 0).cast("int").alias("warm"), "last_access")
    w_all = Window.partitionBy("warm").orderBy("day")
    days = keyed.groupBy("warm", F.to_date("last_access").alias("day")).agg(F.count("*").alias("n"))
    cold = days.where("warm = 0").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("cold"))
    before = days.withColumn("before", F.sum("n").over(w_all.rowsBetween(Window.unboundedPreceding, -1)))
    rank = F.row_number().over(Window.partitionBy("warm", "day").orderBy("last_access", "chunk_id"))
    total = days.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    x = keyed.withColumn("day", F.to_date("last_access")).withColumn("r", rank).join(before, ["warm", "day"])
    position = F.col("r") + F.coalesce("before", F.lit(0)) + F.when(F.col("warm") == 1, cold.scalar()).otherwise(0)
    return x.withColumn("position", position.cast("bigint")).where(F.col("position") <= total.scalar() - c_max).select("chunk_id", "position")


def prune(state: DataFrame, now: Column, ttl_s: int, c_max: int, mentions: DataFrame | None = None, max_nodes: int | None = None) -> DataFrame:
    """What stays after expiry and eviction at one moment, within c_max chunks and, with mentions(chunk_id, uid), max_nodes nodes."""
    fresh = state.join(expired(state, now, ttl_s).select("chunk_id"), "chunk_id", "left_anti")
    gone = evictions(fresh, c_max).select("chunk_id")
    if mentions is not None and max_nodes is not None:
        # all chunks in the order in which they would go; a node goes with the last of its chunks, so what has to go is a prefix
        order = evictions(fresh, 0)
        last = mentions.join(order, "chunk_id").groupBy("uid").agg(F.max("position").alias("position"))
        bound = last.orderBy(F.desc("position")).limit(max_nodes + 1).agg(F.when(F.count("*") > max_nodes, F.min("position")).otherwise(0).alias("p"))
        gone = gone.union(order.where(F.col("position") <= bound.scalar()).select("chunk_id"))
    return fresh.join(gone, "chunk_id", "left_anti")


def capacity(c_max: int, total: int, grow: bool = False) -> int:
    """The capacity after an ingest: with grow at least all chunks, so that nothing is evicted."""
    return max(c_max, total) if grow else c_max


def after_eviction(mentions: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (uid, ref_count) of the surviving mentions, and edges whose chunk and both ends survive."""
    left = mentions.join(gone.select("chunk_id"), "chunk_id", "left_anti")
    nodes = left.groupBy("uid").agg(F.count_distinct("chunk_id").alias("ref_count"))
    alive = nodes.select("uid")
    kept = edges.join(gone.select(F.col("chunk_id").alias("source_chunk")), "source_chunk", "left_anti")
    kept = kept.join(alive.withColumnRenamed("uid", "src"), "src", "left_semi").join(alive.withColumnRenamed("uid", "dst"), "dst", "left_semi")
    return nodes, kept


def write_subgraphs(chunks: DataFrame, mentions: DataFrame, edges: DataFrame, vertices: DataFrame, kept_edges: DataFrame, nodes: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chosen chunks' subgraphs written to the persistent tier: (vertices, edges, counts).

    A vertex gets all its chunks of the hot tier, comma-joined in order, and name and type of nodes(uid, name, type); an edge's
    identity is (src, dst, relation), so the last chunk that has it stays.  counts: one write a chunk, and nodes and edges written.
    """
    found, own = chunk_subgraph(chunks, mentions, edges)
    at = mentions.select("uid", "chunk_id").union(edges.select(F.explode(F.array("src", "dst")), "source_chunk")).distinct()
    new = found.select("uid").distinct().join(at, "uid").groupBy(F.col("uid").alias("vid")).agg(F.array_join(F.array_sort(F.collect_set("chunk_id")), ",").alias("source_chunk"))
    if nodes is not None:
        new = new.join(nodes.select(F.col("uid").alias("vid"), "name", "type"), "vid", "left")
    counts = chunks.agg(F.count_distinct("chunk_id").alias("writes")).withColumns({"nodes": found.agg(F.count("*")).scalar(), "edges": own.agg(F.count("*")).scalar()})
    old = vertices.select(*[F.col(c) if c in vertices.columns else F.lit(None).cast("string").alias(c) for c in new.columns])
    written = upsert(old, new.withColumn("write_seq", F.lit(0)), ["vid"]).drop("write_seq")
    # latest wins among the edges written: by chunk
    order = F.row_number().over(Window.partitionBy("src", "dst", "relation").orderBy("source_chunk"))
    return written, upsert(kept_edges.select(*own.columns), own.withColumn("write_seq", order), ["src", "dst", "relation"]).drop("write_seq"), counts


def entity_promotion(hits: DataFrame, edges: DataFrame, vertices: DataFrame, threshold: int = 3) -> tuple[DataFrame, DataFrame]:
    """Entities matched by at least `threshold` answered questions, hits(q_id, uid): their edges, and edges to neighbours that the persistent tier has."""
    chosen = hits.groupBy("uid").agg(F.count_distinct("q_id").alias("n")).where(F.col("n") >= threshold)
    near = both_ways(edges).join(among(chosen.select(F.col("uid").alias("src"))), "src", "left_semi")
    known = near.join(vertices.select(F.col("vid").alias("dst")).distinct(), "dst", "left_semi")
    return chosen, near.select("src", "dst", "relation").distinct().join(known.select("dst").distinct().withColumn("in_l2", F.lit(True)), "dst", "left").select("src", "dst", "relation", F.coalesce("in_l2", F.lit(False)).alias("in_l2"))


def entity_counters(hits: DataFrame, threshold: int = 3) -> DataFrame:
    """(uid, promotions, left): how often an entity reached the threshold, each time starting anew, and what its counter holds then."""
    n = F.col("n")
    return hits.groupBy("uid").agg(F.count_distinct("q_id").alias("n")).select("uid", F.floor(n / threshold).alias("promotions"), (n % threshold).alias("left"))


def write_entities(chosen: DataFrame, edges: DataFrame, vertices: DataFrame, kept_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Promoted entities, their neighbours and all their edges in the persistent tier; no chunk stands behind them."""
    own = edges.join(chosen.select(F.col("uid").alias("src")), "src", "left_semi").unionByName(edges.join(chosen.select(F.col("uid").alias("dst")), "dst", "left_semi"))
    own = own.select("src", "dst", "relation").distinct()
    ends = own.select(F.explode(F.array("src", "dst")).alias("vid")).union(chosen.select("uid")).distinct()
    v = upsert(vertices.select("vid", "source_chunk"), ends.select("vid", F.lit("").alias("source_chunk"), F.lit(0).alias("write_seq")), ["vid"]).drop("write_seq")
    e = upsert(kept_edges.select("src", "dst", "relation", "source_chunk"), own.select("*", F.lit("").alias("source_chunk"), F.lit(0).alias("write_seq")), ["src", "dst", "relation"]).drop("write_seq")
    return v, e


def convergence(hits: DataFrame, least: int = 3) -> DataFrame:
    """Chunks that at least `least` distinct entities of a question hit."""
    return hits.groupBy("q_id", "chunk_id").agg(F.count_distinct("ent_id").alias("n")).where(F.col("n") >= least)


def weighted_convergence(hits: DataFrame, weights: DataFrame) -> DataFrame:
    """Chunks whose covering entities' weights reach the upper median weight of the question."""
    total = hits.distinct().join(weights, ["q_id", "ent_id"]).groupBy("q_id", "chunk_id").agg(F.round(F.sum("weight"), 6).alias("total"))
    return total.join(upper_median(weights, "q_id", "weight"), "q_id").where(F.col("total") >= F.col("median")).select("q_id", "chunk_id", "total")


def hottest(state: DataFrame, tau_hit: int = 3, k: int = 5) -> DataFrame:
    return state.withColumn("status", F.when(F.col("hits") >= tau_hit, "promoted").otherwise("resident")).orderBy(F.desc("hits"), "chunk_id").limit(k).select("chunk_id", "hits", "status")


def first_residents(state: DataFrame, k: int = 3) -> DataFrame:
    """The k chunks that were touched last."""
    return state.orderBy(F.desc("last_access"), "chunk_id").limit(k).select("chunk_id", "hits")


def widened(ranked: DataFrame, unknown: DataFrame, k: int, step: int = 10) -> DataFrame:
    """Hits to `k + step` for questions whose answer is still unknown, to k for the others; both cut from one ranking."""
    flag = unknown.select("q_id").distinct().withColumn("more", F.lit(step))
    return ranked.join(flag, "q_id", "left").where(F.col("rank") <= k + F.coalesce("more", F.lit(0))).drop("more")
