"""The hot tier over an access log: counts, promotion, expiry, eviction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cache
from . import fixtures as X
from .registry import query, table

_NOW = "2024-01-31 00:00:00"
_STATE = "SELECT chunk_id, min(ts) AS created_at, max(ts) AS last_access, count(*) AS hits FROM accesses GROUP BY chunk_id"


def _state(spark, d):
    return cache.chunk_state(X.accesses(spark, d))


def _now():
    return F.lit(_NOW).cast("timestamp")


@query("access_count", X.with_(["accesses"], "SELECT chunk_id, count(*) AS hits FROM accesses GROUP BY chunk_id"))
def access_count(spark, d):
    return _state(spark, d).select("chunk_id", "hits")


@query("chunk_touch", X.with_(["accesses"], "SELECT chunk_id, epoch_us(min(ts)) AS created_us, epoch_us(max(ts)) AS last_us FROM accesses GROUP BY chunk_id"))
def chunk_touch(spark, d):
    return _state(spark, d).select("chunk_id", F.unix_micros("created_at").alias("created_us"), F.unix_micros("last_access").alias("last_us"))


@query("promote_at_tau", X.with_(["accesses"], "SELECT chunk_id, epoch_us(ts) AS promoted_us, event_id FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY ts, event_id) AS hit FROM accesses) WHERE hit = 3"))
def promote_at_tau(spark, d):
    return cache.promotions(X.accesses(spark, d)).select("chunk_id", F.unix_micros("promoted_at").alias("promoted_us"), "event_id")


@query("ttl_expired", X.with_(["accesses"], f"SELECT chunk_id, hits FROM state WHERE epoch(TIMESTAMP '{_NOW}') - floor(epoch(last_access)) > 3600", {"state": _STATE}))
def ttl_expired(spark, d):
    return cache.expired(_state(spark, d), _now(), 3600).select("chunk_id", "hits")


@query("lru_evict", X.with_(["accesses"], "SELECT chunk_id, position FROM (SELECT chunk_id, row_number() OVER (ORDER BY hits > 0, last_access, chunk_id) AS position, count(*) OVER () AS n FROM state) WHERE position <= n - 100", {"state": _STATE}))
def lru_evict(spark, d):
    return cache.evictions(_state(spark, d), 100)


_GONE = "SELECT chunk_id FROM (SELECT chunk_id, row_number() OVER (ORDER BY hits > 0, last_access, chunk_id) AS position, count(*) OVER () AS n FROM state) WHERE position <= n - 100"
_MENT = "SELECT DISTINCT chunk_id, ent_id AS uid FROM accesses"


@query("evict_refcount", X.with_(["accesses"], "SELECT uid, count(DISTINCT chunk_id) AS ref_count FROM ment WHERE chunk_id NOT IN (SELECT chunk_id FROM gone) GROUP BY uid", {"state": _STATE, "gone": _GONE, "ment": _MENT}))
def evict_refcount(spark, d):
    m = X.accesses(spark, d).select("chunk_id", F.col("ent_id").alias("uid")).distinct()
    e = m.select(F.col("uid").alias("src"), F.col("uid").alias("dst"), F.lit("SAW").alias("relation"), F.col("chunk_id").alias("source_chunk"))
    return cache.after_eviction(m, e, cache.evictions(_state(spark, d), 100))[0]


@query("prune_graph", X.with_(["accesses"], f"""SELECT chunk_id, hits FROM fresh WHERE chunk_id NOT IN (SELECT chunk_id FROM (SELECT chunk_id, row_number() OVER (ORDER BY hits > 0, last_access, chunk_id) AS position, count(*) OVER () AS n FROM fresh) WHERE position <= n - 50)""",
    {"state": _STATE, "fresh": f"SELECT * FROM state WHERE epoch(TIMESTAMP '{_NOW}') - floor(epoch(last_access)) <= 86400"}))
def prune_graph(spark, d):
    return cache.prune(_state(spark, d), _now(), 86400, 50).select("chunk_id", "hits")


@query("hot_chunks", X.with_(["accesses"], "SELECT chunk_id, hits, CASE WHEN hits >= 3 THEN 'promoted' ELSE 'resident' END AS status FROM state ORDER BY hits DESC, chunk_id LIMIT 5", {"state": _STATE}))
def hot_chunks(spark, d):
    return cache.hottest(_state(spark, d))


@query("promote_convergence", X.with_(["hits"], "SELECT q_id, chunk_id, count(DISTINCT ent_id) AS n FROM hits GROUP BY ALL HAVING count(DISTINCT ent_id) >= 3"))
def promote_convergence(spark, d):
    return cache.convergence(X.hits(spark, d))


_W = "SELECT DISTINCT o_custkey AS q_id, o_orderpriority AS ent_id, CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) / 10 AS weight FROM orders"


@query("promote_weighted", X.with_(["hits"], """SELECT q_id, chunk_id, total FROM (SELECT q_id, chunk_id, round(sum(weight), 6) AS total FROM hits JOIN w USING (q_id, ent_id) GROUP BY ALL) JOIN (
  SELECT q_id, weight AS median FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY weight) - 1 AS r, count(*) OVER (PARTITION BY q_id) AS n FROM w) WHERE r = n // 2) USING (q_id) WHERE total >= median""", {"w": _W}))
def promote_weighted(spark, d):
    w = table(spark, d, "orders").select(F.col("o_custkey").alias("q_id"), F.col("o_orderpriority").alias("ent_id"), (F.substring("o_orderpriority", 1, 1).cast("double") / 10).alias("weight")).distinct()
    return cache.weighted_convergence(X.hits(spark, d), w)


@query("promote_coverage", X.with_(["hits"], "SELECT chunk_id, count(*) AS accesses FROM (SELECT DISTINCT q_id, chunk_id FROM hits) GROUP BY chunk_id HAVING count(*) >= 3"))
def promote_coverage(spark, d):
    covered = X.hits(spark, d).select("q_id", "chunk_id").distinct()
    log = covered.select("chunk_id", F.col("q_id").cast("timestamp").alias("ts"), F.col("q_id").alias("event_id"))
    chosen = cache.promotions(log).select("chunk_id")
    return cache.chunk_state(log).join(chosen, "chunk_id", "left_semi").select("chunk_id", F.col("hits").alias("accesses"))
