"""The whole retrieval over embedded rows: each row is a chunk and an entity, linked to the rows of a half and a third of its id.

Even rows' chunks are in the hot tier, odd ones' in the persistent tier; a question is a row whose id is divisible by 100.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cache, evaluate, retrieve
from . import fixtures as X
from .registry import query, table


def _store(spark, d, hot: bool = True, kept: bool = True) -> retrieve.Store:
    c = X.chunks(spark, d)
    links = c.select("chunk_id", "vec_id", F.explode(F.array(F.struct(F.lit("HALF").alias("relation"), F.lit(2).alias("by")), F.struct(F.lit("THIRD").alias("relation"), F.lit(3).alias("by")))).alias("l")).select(
        F.col("vec_id").alias("src"), F.floor(F.col("vec_id") / F.col("l.by")).alias("dst"), "l.relation", F.col("chunk_id").alias("source_chunk"), "vec_id"
    )
    links = links.where("src <> dst")
    hot_edges = links.where((F.col("vec_id") % 2 == 0) & F.lit(hot)).drop("vec_id")
    kept_edges = links.where((F.col("vec_id") % 2 == 1) & F.lit(kept)).drop("vec_id")
    ends = lambda e: e.select(F.col("source_chunk").alias("chunk_id"), F.explode(F.array("src", "dst")).alias("uid")).distinct()
    vertices = ends(kept_edges).groupBy(F.col("uid").alias("vid")).agg(F.max("chunk_id").alias("source_chunk"))
    return retrieve.Store(c.select("chunk_id", "vec"), c.select(F.col("vec_id").alias("uid"), "vec"), ends(hot_edges), hot_edges, vertices, kept_edges)


def _run(spark, d, how: str = "rrf", **tiers) -> retrieve.Retrieval:
    q = X.questions(spark, d)
    dense = tiers.pop("use_dense", True)
    return retrieve.hybrid(q, _store(spark, d, **tiers), how=how, own=F.concat(F.lit("chunk_"), F.col("q_id").cast("string")), use_dense=dense)


_COS = lambda a, b: f"round(list_inner_product({a}, {b}) / (sqrt(list_inner_product({a}, {a})) * sqrt(list_inner_product({b}, {b}))), 6)"


def _walk(prefix: str, both: str, start: str, hops: int) -> dict[str, str]:
    """A beam of 5 for each question and entity from `start`, by the likeness of question and node."""
    out = {f"{prefix}0": start}
    for n in range(1, hops):
        gone = " UNION ALL ".join(f"SELECT q_id, ent_id, uid FROM {prefix}{i}" for i in range(n))
        out[f"{prefix}{n}"] = f"""SELECT q_id, ent_id, uid FROM (SELECT q_id, ent_id, uid, row_number() OVER (PARTITION BY q_id, ent_id ORDER BY sim DESC, uid) AS r FROM (
          SELECT DISTINCT f.q_id, f.ent_id, b.dst AS uid FROM {prefix}{n - 1} f JOIN {both} b ON f.uid = b.src) n JOIN sim USING (q_id, uid)
          WHERE NOT EXISTS (SELECT 1 FROM ({gone}) s WHERE s.q_id = n.q_id AND s.ent_id = n.ent_id AND s.uid = n.uid)) WHERE r <= 5"""
    return out


def sql(tail: str, hot: bool = True, kept: bool = True, dense: bool = True, extra: dict | None = None) -> str:
    weights, far = [0.5 ** min(i, 2) for i in range(10)], (1.0, 0.5, 0.3)
    union = lambda rows: " UNION ALL ".join(rows)
    parts = {
        "idx": "SELECT vec_id AS uid, vec FROM chunks",
        "links": "SELECT vec_id AS src, vec_id // n AS dst, rel AS relation, chunk_id AS source_chunk, vec_id FROM chunks, (VALUES ('HALF', 2), ('THIRD', 3)) t(rel, n) WHERE vec_id <> vec_id // n",
        "he": f"SELECT src, dst, relation, source_chunk FROM links WHERE vec_id % 2 = 0 AND {hot}",
        "ke": f"SELECT src, dst, relation, source_chunk FROM links WHERE vec_id % 2 = 1 AND {kept}",
        "hm": "SELECT DISTINCT source_chunk AS chunk_id, unnest([src, dst]) AS uid FROM he",
        "kv": "SELECT uid AS vid, max(c) AS source_chunk FROM (SELECT source_chunk AS c, unnest([src, dst]) AS uid FROM ke) GROUP BY uid",
        "hb": "SELECT src, dst, source_chunk FROM he UNION ALL SELECT dst, src, source_chunk FROM he",
        "kb": "SELECT src, dst, source_chunk FROM ke UNION ALL SELECT dst, src, source_chunk FROM ke",
        "sim": f"SELECT q_id, uid, {_COS('qvec', 'vec')} AS sim FROM questions, idx",
        "ents": "SELECT q_id, uid, CAST(uid AS VARCHAR) AS ent_id FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY sim DESC, uid) AS r FROM sim) WHERE r <= 5",
        "ee": f"SELECT a.uid, b.uid AS seed, {_COS('a.vec', 'b.vec')} AS s FROM idx a JOIN idx b ON a.uid IN (SELECT uid FROM ents)",
        "sds": "SELECT q_id, ent_id, seed AS uid FROM ents JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY s DESC, seed) AS r FROM ee) WHERE r <= 5) USING (uid)",
        **_walk("h", "hb", "SELECT q_id, ent_id, uid FROM sds", 10),
        **_walk("k", "kb", "SELECT q_id, ent_id, uid FROM sds WHERE uid IN (SELECT vid FROM kv)", 3),
        "hs": "SELECT q_id, ent_id, chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY q_id, ent_id ORDER BY score DESC, chunk_id) AS r FROM (SELECT q_id, ent_id, chunk_id, round(sum(w), 6) AS score FROM ("
        + union(f"SELECT q_id, ent_id, chunk_id, CAST({w} AS DOUBLE) AS w FROM h{i} JOIN hm USING (uid) UNION ALL SELECT q_id, ent_id, source_chunk, CAST({w} AS DOUBLE) FROM h{i} JOIN hb ON uid = src" for i, w in enumerate(weights))
        + ") GROUP BY ALL)) WHERE r <= 15",
        "ks": "SELECT q_id, ent_id, chunk_id, round(sum(w), 6) AS score FROM ("
        + union([*(f"SELECT q_id, ent_id, source_chunk AS chunk_id, CAST({w} AS DOUBLE) AS w FROM k{i} JOIN kv ON uid = vid" for i, w in enumerate(far)), *(f"SELECT q_id, ent_id, source_chunk, CAST({w} AS DOUBLE) FROM k{i} JOIN kb ON uid = src" for i, w in enumerate(far[1:]))])
        + ") GROUP BY ALL",
        "cs": "SELECT * FROM hs UNION ALL SELECT * FROM ks",
        "ns": "SELECT q_id, uid, rank FROM (SELECT q_id, uid, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, uid) AS rank FROM (SELECT q_id, uid, round(sum(s), 6) AS score FROM ("
        + union([*(f"SELECT q_id, uid, CAST({w} AS DOUBLE) AS s FROM h{i}" for i, w in enumerate(weights)), *(f"SELECT q_id, uid, CAST({w} AS DOUBLE) FROM k{i}" for i, w in enumerate(far))])
        + ") GROUP BY ALL)) WHERE rank <= 15",
        "nc": "SELECT uid, chunk_id FROM hm UNION SELECT vid, source_chunk FROM kv",
        "gr": """SELECT q_id, chunk_id, score, row_number() OVER (PARTITION BY q_id ORDER BY best_rank, score DESC, chunk_id) AS rank FROM (SELECT q_id, chunk_id, round(sum(score), 6) AS score FROM cs GROUP BY ALL)
          JOIN (SELECT q_id, chunk_id, min(rank) AS best_rank FROM ns JOIN nc USING (uid) GROUP BY ALL) USING (q_id, chunk_id)""",
        "dn": f"SELECT * FROM dense WHERE {dense}",
        "fin": """SELECT q_id, chunk_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT q_id, chunk_id, round(sum(CAST(1 AS DOUBLE) / (60 + rank)), 6) AS score FROM (
          SELECT q_id, chunk_id, rank FROM dn UNION ALL SELECT q_id, chunk_id, rank FROM gr) GROUP BY ALL)) WHERE rank <= 6""",
        "cov": "SELECT q_id, chunk_id, count(DISTINCT ent_id) AS n FROM cs GROUP BY ALL",
    }
    return X.with_(["chunks", "questions", "dense"], tail, parts | (extra or {}))


@query("hybrid_retrieve", sql("SELECT q_id, chunk_id, rank FROM fin"))
def hybrid_retrieve(spark, d):
    return _run(spark, d).final


@query("hybrid_graph_only", sql("SELECT q_id, chunk_id, rank FROM gr WHERE rank <= 6"))
def hybrid_graph_only(spark, d):
    return _run(spark, d, "graph_only").final


@query("hybrid_dual", sql("""SELECT q_id, chunk_id, rank FROM (SELECT q_id, chunk_id, row_number() OVER (PARTITION BY q_id ORDER BY section, turn, source) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY q_id, section, source ORDER BY CASE WHEN section = 0 THEN gr ELSE coalesce(dr, gr) END) AS turn FROM (
    SELECT coalesce(a.q_id, b.q_id) AS q_id, coalesce(a.chunk_id, b.chunk_id) AS chunk_id, a.rank AS dr, b.rank AS gr,
      CASE WHEN a.rank IS NOT NULL AND b.rank IS NOT NULL THEN 0 ELSE 1 END AS section, CASE WHEN a.rank IS NOT NULL THEN 0 ELSE 1 END AS source
    FROM dn a FULL OUTER JOIN gr b ON a.q_id = b.q_id AND a.chunk_id = b.chunk_id))) WHERE rank <= 6"""))
def hybrid_dual(spark, d):
    return _run(spark, d, "dual").final


@query("hybrid_stats", sql("""SELECT q.q_id, (SELECT count(*) FROM dn WHERE dn.q_id = q.q_id) AS dense_total, (SELECT count(DISTINCT chunk_id) FROM cs WHERE cs.q_id = q.q_id) AS graph_total,
  (SELECT count(*) FROM fin WHERE fin.q_id = q.q_id AND chunk_id IN (SELECT chunk_id FROM cs WHERE cs.q_id = q.q_id)) AS graph_in_final, (SELECT count(*) FROM fin WHERE fin.q_id = q.q_id AND chunk_id IN (SELECT chunk_id FROM dn WHERE dn.q_id = q.q_id)) AS dense_in_final,
  (SELECT count(*) FROM dn WHERE dn.q_id = q.q_id AND chunk_id IN (SELECT chunk_id FROM cs WHERE cs.q_id = q.q_id)) AS overlap, (SELECT count(*) FROM ents WHERE ents.q_id = q.q_id) AS n_entities, (SELECT count(*) FROM cov WHERE cov.q_id = q.q_id) AS n_covered FROM questions q"""))
def hybrid_stats(spark, d):
    return _run(spark, d).stats


_PROMOTED = "SELECT chunk_id FROM cov GROUP BY chunk_id HAVING count(*) >= 2"


@query("promotion_write", sql("""SELECT 'vertex' AS kind, CAST(vid AS VARCHAR) AS key, chunks FROM (SELECT uid AS vid, string_agg(DISTINCT chunk_id, ',' ORDER BY chunk_id) AS chunks FROM hm WHERE uid IN (SELECT uid FROM hm WHERE chunk_id IN (SELECT chunk_id FROM pr)) GROUP BY uid
  UNION ALL SELECT vid, source_chunk FROM kv WHERE vid NOT IN (SELECT uid FROM hm WHERE chunk_id IN (SELECT chunk_id FROM pr)))
  UNION ALL SELECT 'edge', src || '|' || relation || '|' || dst, max(source_chunk) FROM he WHERE source_chunk IN (SELECT chunk_id FROM pr) GROUP BY src, relation, dst
  UNION ALL SELECT 'edge', src || '|' || relation || '|' || dst, max(source_chunk) FROM ke WHERE (src, relation, dst) NOT IN (SELECT (src, relation, dst) FROM he WHERE source_chunk IN (SELECT chunk_id FROM pr)) GROUP BY src, relation, dst""", extra={"pr": _PROMOTED}))
def promotion_write(spark, d):
    """Chunks that two questions or more cover move to the persistent tier with their subgraphs."""
    s = _store(spark, d)
    chosen = retrieve.promoted(_run(spark, d).coverage, 2)
    vertices, edges, _ = retrieve.write_promoted(chosen, s)
    v = vertices.select(F.lit("vertex").alias("kind"), F.col("vid").cast("string").alias("key"), F.col("source_chunk").alias("chunks"))
    return v.unionAll(edges.select(F.lit("edge"), F.concat_ws("|", F.col("src"), "relation", F.col("dst")), "source_chunk"))


@query("promotion_counts", sql("SELECT (SELECT count(*) FROM pr) AS writes, (SELECT count(*) FROM hm WHERE chunk_id IN (SELECT chunk_id FROM pr)) AS nodes, (SELECT count(*) FROM he WHERE source_chunk IN (SELECT chunk_id FROM pr)) AS edges", extra={"pr": _PROMOTED}))
def promotion_counts(spark, d):
    return retrieve.write_promoted(retrieve.promoted(_run(spark, d).coverage, 2), _store(spark, d))[2]


def _phase_sql(name: str, **tiers) -> str:
    return f"SELECT '{name}' AS phase, count(*) AS questions, round(avg(CASE WHEN hit THEN 1.0::DOUBLE ELSE 0.0 END), 4) AS accuracy FROM (" + sql("SELECT q.q_id, EXISTS (SELECT 1 FROM fin JOIN chunks c USING (chunk_id) WHERE fin.q_id = q.q_id AND c.label = q.q_label) AS hit FROM questions q", **tiers) + ")"


@query("fair_phases", " UNION ALL ".join([_phase_sql("hot", kept=False, dense=False), _phase_sql("kept", hot=False, dense=False), _phase_sql("cold", hot=False, kept=False)]))
def fair_phases(spark, d):
    """The share of questions with a final chunk of their label: the hot tier alone, the persistent tier alone, vectors alone."""
    q, c = X.questions(spark, d), X.chunks(spark, d).select("chunk_id", "label")
    runs = None
    for name, tiers in (("hot", {"kept": False, "use_dense": False}), ("kept", {"hot": False, "use_dense": False}), ("cold", {"hot": False, "kept": False})):
        final = _run(spark, d, **tiers).final
        good = final.join(c, "chunk_id").select("q_id", F.col("label").alias("q_label")).distinct().withColumn("ok", F.lit(True))
        one = q.select("q_id", "q_label").join(good, ["q_id", "q_label"], "left").select(F.lit(name).alias("phase"), "q_id", F.coalesce("ok", F.lit(False)).alias("correct"))
        runs = one if runs is None else runs.unionAll(one)
    return evaluate.phases(runs)


# --- entity promotion and pruning that write

_MATCH = "SELECT DISTINCT o_custkey AS q_id, l_partkey * 10 + 2 AS uid FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


def _matched(spark, d):
    o, l = table(spark, d, "orders"), table(spark, d, "lineitem")  # noqa: E741
    return l.join(o, l.l_orderkey == o.o_orderkey).select(F.col("o_custkey").alias("q_id"), (F.col("l_partkey") * 10 + 2).alias("uid"))


@query("entity_counters", X.with_([], "SELECT uid, n // 3 AS promotions, n % 3 AS \"left\" FROM (SELECT uid, count(*) AS n FROM m GROUP BY uid)", {"m": _MATCH}))
def entity_counters(spark, d):
    return cache.entity_counters(_matched(spark, d))


@query("promote_entity_write", X.with_(["kg_edges", "l2_vertices"], """SELECT 'vertex' AS kind, CAST(vid AS VARCHAR) AS key, CASE WHEN vid IN (SELECT vid FROM ends) THEN '' ELSE source_chunk END AS chunk FROM l2_vertices
  UNION ALL SELECT 'edge', src || '|' || relation || '|' || dst, '' FROM (SELECT DISTINCT src, relation, dst FROM kg_edges WHERE dst IN (SELECT uid FROM ch))""", {"m": _MATCH, "ch": "SELECT uid FROM m GROUP BY uid HAVING count(*) >= 40", "ends": "SELECT DISTINCT unnest([src, dst]) AS vid FROM kg_edges WHERE dst IN (SELECT uid FROM ch)"}))
def promote_entity_write(spark, d):
    e, v = X.kg_edges(spark, d), X.l2_vertices(spark, d)
    chosen, _ = cache.entity_promotion(_matched(spark, d), e, v, 40)
    vertices, edges = cache.write_entities(chosen, e, v, e.limit(0))
    return vertices.select(F.lit("vertex").alias("kind"), F.col("vid").cast("string").alias("key"), F.col("source_chunk").alias("chunk")).unionAll(edges.select(F.lit("edge"), F.concat_ws("|", F.col("src"), "relation", F.col("dst")), "source_chunk"))


@query("prune_max_nodes", X.with_(["accesses"], """SELECT chunk_id FROM pos WHERE p > greatest((SELECT greatest(count(*) - 150, 0) FROM pos), coalesce((SELECT CASE WHEN count(*) > 100 THEN min(lp) ELSE 0 END FROM (SELECT lp FROM (SELECT uid, max(p) AS lp FROM ment JOIN pos USING (chunk_id) GROUP BY uid) ORDER BY lp DESC LIMIT 101)), 0))""",
    {"state": "SELECT chunk_id, max(ts) AS last_access, count(*) AS hits FROM accesses GROUP BY chunk_id", "ment": "SELECT DISTINCT chunk_id, ent_id AS uid FROM accesses", "pos": "SELECT chunk_id, row_number() OVER (ORDER BY hits > 0, last_access, chunk_id) AS p FROM state"}))
def prune_max_nodes(spark, d):
    a = X.accesses(spark, d)
    kept = cache.prune(cache.chunk_state(a), F.lit("2024-01-31 00:00:00").cast("timestamp"), 0, 150, a.select("chunk_id", F.col("ent_id").alias("uid")).distinct(), 100)
    return kept.select("chunk_id")
