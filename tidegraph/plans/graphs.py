"""Graph building, walks, paths and tiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cache, graph, ranking, store, walk
from . import fixtures as X
from .registry import query

_SETS = ["kg_edges"]


@query("kg_triplets", X.with_(_SETS, "SELECT DISTINCT src AS head, relation, dst AS tail FROM kg_edges"))
def kg_triplets(spark, d):
    return graph.triplets(X.kg_edges(spark, d, repeated=True))


@query("kg_entities", X.with_(_SETS, "SELECT DISTINCT unnest([src, dst]) AS entity FROM kg_edges"))
def kg_entities(spark, d):
    return graph.entities_of(graph.triplets(X.kg_edges(spark, d, repeated=True)))


@query("node_merge", X.with_(["kg_mentions", "entities"], """SELECT m.uid, min(e.name) AS name, min(e.type) AS type, min(e."desc") AS "desc", CAST(count(DISTINCT chunk_id) AS BIGINT) AS ref_count FROM kg_mentions m JOIN entities e ON m.uid = e.uid GROUP BY m.uid"""))
def node_merge(spark, d):
    m = X.kg_mentions(spark, d).join(X.entities(spark, d), "uid").withColumn("seq", F.col("chunk_id").cast("bigint"))
    return graph.merge_nodes(m).drop("source_chunks")


@query("edge_merge", X.with_(_SETS, "SELECT DISTINCT src, dst, relation, source_chunk FROM kg_edges"))
def edge_merge(spark, d):
    e = X.kg_edges(spark, d)
    return graph.merge_edges(e.unionAll(e.where("relation = 'SUPPLIES'")))


@query("one_hop_bidir", X.with_(["seeds", "bidir"], "SELECT q_id, uid, dst AS neighbour, relation, source_chunk FROM seeds JOIN bidir ON uid = src"))
def one_hop_bidir(spark, d):
    return graph.one_hop(X.seeds(spark, d).select("q_id", "uid"), X.kg_edges(spark, d))


def _hop_sql(n: int, source: str, seen: list[str]) -> dict[str, str]:
    """A beam of 5 from the nodes of `source`, without those of `seen`."""
    gone = " UNION ALL ".join(f"SELECT q_id, uid FROM {s}" for s in seen)
    return {f"h{n}": f"""SELECT q_id, uid FROM (SELECT q_id, uid, row_number() OVER (PARTITION BY q_id ORDER BY sim IS NULL, sim DESC, uid) AS r FROM (
      SELECT DISTINCT f.q_id, b.dst AS uid FROM {source} f JOIN bidir b ON f.uid = b.src) n LEFT JOIN entities e USING (uid)
      WHERE NOT EXISTS (SELECT 1 FROM ({gone}) s WHERE s.q_id = n.q_id AND s.uid = n.uid)) WHERE r <= 5"""}


HOPS = 10
_WALK = {"h0": "SELECT q_id, uid FROM seeds"}
for _n in range(1, HOPS):
    _WALK |= _hop_sql(_n, f"h{_n - 1}", [f"h{_i}" for _i in range(_n)])
_W = [0.5 ** min(_n, 2) for _n in range(HOPS)]
_PARTS = " UNION ALL ".join(f"SELECT q_id, chunk_id, CAST({w} AS DOUBLE) AS w FROM h{i} JOIN kg_mentions USING (uid) UNION ALL SELECT q_id, source_chunk, CAST({w} AS DOUBLE) FROM h{i} JOIN bidir ON uid = src" for i, w in enumerate(_W))


def _affinity(spark, d):
    return X.entities(spark, d).select("uid", "sim")


@query("l1_bfs_beam", X.with_(["seeds", "kg_mentions", "bidir", "entities"], f"""SELECT q_id, ent_id, chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, chunk_id) AS r FROM (
  SELECT q_id, 'e1' AS ent_id, chunk_id, round(sum(w), 6) AS score FROM ({_PARTS}) GROUP BY ALL)) WHERE r <= 15""", _WALK))
def l1_bfs_beam(spark, d):
    return walk.beam_walk(X.seeds(spark, d), X.kg_mentions(spark, d), X.kg_edges(spark, d), _affinity(spark, d))[0]


@query("l1_node_scores", X.with_(["seeds", "bidir", "entities"], "SELECT q_id, 'e1' AS ent_id, uid, score FROM (" + " UNION ALL ".join(f"SELECT q_id, uid, CAST({w} AS DOUBLE) AS score FROM h{i}" for i, w in enumerate(_W)) + ")", _WALK))
def l1_node_scores(spark, d):
    return walk.beam_walk(X.seeds(spark, d), X.kg_mentions(spark, d), X.kg_edges(spark, d), _affinity(spark, d))[1]


@query("l2_two_hop", X.with_(["seeds", "l2_vertices", "bidir", "entities"], """SELECT q_id, 'e1' AS ent_id, chunk_id, round(sum(w), 6) AS score FROM (
  SELECT q_id, source_chunk AS chunk_id, CAST(1 AS DOUBLE) AS w FROM h0 JOIN l2_vertices ON uid = vid UNION ALL SELECT q_id, source_chunk, CAST(0.5 AS DOUBLE) FROM h1 JOIN l2_vertices ON uid = vid
  UNION ALL SELECT q_id, source_chunk, CAST(0.3 AS DOUBLE) FROM h2 JOIN l2_vertices ON uid = vid
  UNION ALL SELECT q_id, source_chunk, CAST(0.5 AS DOUBLE) FROM h0 JOIN bidir ON uid = src UNION ALL SELECT q_id, source_chunk, CAST(0.3 AS DOUBLE) FROM h1 JOIN bidir ON uid = src) GROUP BY ALL""",
    {"h0": "SELECT q_id, uid FROM seeds WHERE uid IN (SELECT vid FROM l2_vertices)"} | _hop_sql(1, "h0", ["h0"]) | _hop_sql(2, "h1", ["h0", "h1"])))
def l2_two_hop(spark, d):
    return walk.two_hop(X.seeds(spark, d), X.l2_vertices(spark, d), X.kg_edges(spark, d), _affinity(spark, d))[0]


_FACT = {"f0": "SELECT q_id, uid FROM seeds"}
for _n in range(1, HOPS):
    _seen = " UNION ALL ".join(f"SELECT q_id, uid FROM f{_i}" for _i in range(_n))
    _FACT[f"f{_n}"] = f"SELECT DISTINCT s.q_id, b.dst AS uid FROM f{_n - 1} s JOIN bidir b ON s.uid = b.src WHERE NOT EXISTS (SELECT 1 FROM ({_seen}) z WHERE z.q_id = s.q_id AND z.uid = b.dst)"
_FACT_PARTS = " UNION ALL ".join(f"SELECT q_id, chunk_id, CAST({0.5**i} AS DOUBLE) AS w FROM f{i} JOIN kg_mentions USING (uid) UNION ALL SELECT q_id, source_chunk, CAST({0.5 ** (i + 1)} AS DOUBLE) FROM f{i} JOIN bidir ON uid = src" for i in range(HOPS))


@query("fact_bfs_decay", X.with_(["seeds", "kg_mentions", "bidir"], f"""SELECT q_id, chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, chunk_id) AS r FROM (
  SELECT q_id, chunk_id, round(sum(w), 6) AS score FROM ({_FACT_PARTS}) GROUP BY ALL)) WHERE r <= 15""", _FACT))
def fact_bfs_decay(spark, d):
    return walk.fact_walk(X.seeds(spark, d).select("q_id", "uid", "weight"), X.kg_mentions(spark, d), X.kg_edges(spark, d))


@query("fact_l2_lookup", X.with_(["seeds", "l2_vertices", "bidir"], """SELECT q_id, chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, chunk_id) AS r FROM (SELECT q_id, chunk_id, round(sum(w), 6) AS score FROM (
  SELECT q_id, source_chunk AS chunk_id, CAST(1 AS DOUBLE) AS w FROM seeds JOIN l2_vertices ON uid = vid UNION ALL SELECT q_id, source_chunk, CAST(0.5 AS DOUBLE) FROM seeds JOIN bidir ON uid = src) GROUP BY ALL)) WHERE r <= 15"""))
def fact_l2_lookup(spark, d):
    return walk.fact_lookup(X.seeds(spark, d).select("q_id", "uid", "weight"), X.l2_vertices(spark, d), X.kg_edges(spark, d))


_STEP = {"e": "SELECT DISTINCT src, dst, relation, src || '|' || relation || '|' || dst AS eid FROM kg_edges",
    "step": "SELECT src AS a, dst AS b, ' -' || relation || '-> ' || dst AS t, eid FROM e UNION ALL SELECT dst, src, ' <-' || relation || '- ' || src, eid FROM e"}
_PATHS = """SELECT uid, path, CAST(hops AS BIGINT) AS hops FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY hops, path) AS r FROM (
  SELECT uid, uid || t AS path, 1 AS hops FROM seeds JOIN step ON uid = a
  UNION ALL SELECT uid, uid || x.t || y.t, 2 FROM seeds JOIN step x ON uid = x.a JOIN step y ON x.b = y.a AND x.eid <> y.eid)) WHERE r <= 30"""


@query("var_length_paths", X.with_(["seeds", "kg_edges"], _PATHS, _STEP))
def var_length_paths(spark, d):
    return graph.paths(X.seeds(spark, d).select("uid"), X.kg_edges(spark, d), 2, limit=30)


@query("path_sequences", X.with_(["seeds", "kg_edges"], f"SELECT DISTINCT path FROM ({_PATHS})", _STEP))
def path_sequences(spark, d):
    return graph.sequences(graph.path_map(graph.paths(X.seeds(spark, d).select("uid"), X.kg_edges(spark, d), 2, limit=30)))


@query("path_triples", X.with_(["seeds", "kg_edges"], f"""SELECT DISTINCT unnest(CASE WHEN hops = 1 THEN [CASE WHEN starts_with(a1, '-') THEN h || '|' || r1 || '|' || m ELSE m || '|' || r1 || '|' || h END]
  ELSE [CASE WHEN starts_with(a1, '-') THEN h || '|' || r1 || '|' || m ELSE m || '|' || r1 || '|' || h END, CASE WHEN starts_with(a2, '-') THEN m || '|' || r2 || '|' || t ELSE t || '|' || r2 || '|' || m END] END) AS triple FROM (
  SELECT hops, s[1] AS h, s[2] AS a1, trim(s[2], '<->') AS r1, s[3] AS m, s[4] AS a2, trim(s[4], '<->') AS r2, s[5] AS t FROM (SELECT hops, string_split(path, ' ') AS s FROM ({_PATHS})))""", _STEP))
def path_triples(spark, d):
    p = graph.paths(X.seeds(spark, d).select("uid"), X.kg_edges(spark, d), 2, limit=30)
    return graph.triples_of(p).select(F.concat_ws("|", "head", "relation", "tail").alias("triple")).distinct()


@query("path_entities", X.with_(["seeds", "kg_edges"], f"""SELECT path, CAST(len(list_distinct(list_filter([s[1], s[3], s[5]], lambda x: x IS NOT NULL))) AS BIGINT) AS entities FROM (SELECT DISTINCT path, string_split(path, ' ') AS s FROM ({_PATHS}))""", _STEP))
def path_entities(spark, d):
    p = graph.paths(X.seeds(spark, d).select("uid"), X.kg_edges(spark, d), 2, limit=30)
    return graph.entities_by_path(p).select("path", F.size("entities").cast("bigint").alias("entities"))


@query("chunk_subgraph", X.with_(["kg_edges", "kg_mentions"], """SELECT chunk_id, CAST(count(DISTINCT uid) AS BIGINT) AS nodes, CAST(max(n) AS BIGINT) AS edges FROM (
  SELECT chunk_id, uid, (SELECT count(*) FROM kg_edges e WHERE e.source_chunk = m.chunk_id) AS n FROM kg_mentions m WHERE chunk_id IN (SELECT CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderstatus = 'F')) GROUP BY chunk_id"""))
def chunk_subgraph(spark, d):
    from .registry import table

    chosen = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("string").alias("chunk_id"))
    nodes, edges = graph.chunk_subgraph(chosen, X.kg_mentions(spark, d), X.kg_edges(spark, d))
    a = nodes.groupBy("chunk_id").agg(F.count("*").alias("nodes"))
    return a.join(edges.groupBy(F.col("source_chunk").alias("chunk_id")).agg(F.count("*").alias("edges")), "chunk_id")


@query("rehydrate_missing", X.with_(["kg_edges"], "SELECT source_chunk, src, dst, relation FROM kg_edges WHERE CAST(source_chunk AS BIGINT) IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus <> 'F')"))
def rehydrate_missing(spark, d):
    from .registry import table

    o = table(spark, d, "orders")
    meta = X.kg_edges(spark, d).groupBy(F.col("source_chunk").alias("chunk_id")).agg(F.collect_list(F.struct("src", F.col("dst").alias("tgt"), F.col("relation").alias("rel"))).alias("relations"))
    chunks = meta.select("chunk_id", F.struct(F.transform("relations", lambda r: F.struct(r["src"].alias("uid"))).alias("entities"), F.col("relations")).alias("graph_meta"))
    key = F.col("o_orderkey").cast("string").alias("chunk_id")
    hits, resident = o.where("o_orderpriority = '1-URGENT'").select(key), o.where("o_orderstatus = 'F'").select(key)
    return graph.rehydrate(hits, resident, chunks)[1].select("source_chunk", "src", "dst", "relation")


@query("coverage", X.with_(["hits"], "SELECT q_id, chunk_id, count(DISTINCT ent_id) AS n_entities, string_agg(DISTINCT ent_id, ',' ORDER BY ent_id) AS entities FROM hits GROUP BY ALL"))
def coverage(spark, d):
    return graph.coverage(X.hits(spark, d)).select("q_id", "chunk_id", "n_entities", F.array_join("entities", ",").alias("entities"))


_NODES = " UNION ALL ".join(f"SELECT q_id, uid, CAST({w} AS DOUBLE) AS score FROM h{i}" for i, w in enumerate(_W))


@query("entity_rank_topk", X.with_(["seeds", "bidir", "entities"], f"SELECT q_id, uid, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, uid) AS rank FROM ({_NODES})) WHERE rank <= 10", _WALK))
def entity_rank_topk(spark, d):
    nodes = walk.beam_walk(X.seeds(spark, d), X.kg_mentions(spark, d), X.kg_edges(spark, d), _affinity(spark, d))[1]
    return ranking.top_nodes(nodes, 10)


@query("graph_rank", X.with_(["seeds", "kg_mentions", "bidir", "entities"], f"""SELECT q_id, chunk_id, score, best_rank, row_number() OVER (PARTITION BY q_id ORDER BY best_rank, score DESC, chunk_id) AS position FROM (
  SELECT q_id, chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, chunk_id) AS r FROM (SELECT q_id, chunk_id, round(sum(w), 6) AS score FROM ({_PARTS}) GROUP BY ALL)) WHERE r <= 15)
  JOIN (SELECT q_id, chunk_id, min(rank) AS best_rank FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, uid) AS rank FROM ({_NODES})) WHERE rank <= 15) JOIN kg_mentions USING (uid) GROUP BY ALL) USING (q_id, chunk_id)""", _WALK))
def graph_rank(spark, d):
    m = X.kg_mentions(spark, d)
    chunks, nodes = walk.beam_walk(X.seeds(spark, d), m, X.kg_edges(spark, d), _affinity(spark, d))
    return ranking.graph_chunks(chunks, ranking.top_nodes(nodes, 15), m)


_FACTS = "SELECT o_custkey AS q_id, l_partkey * 10 + 2 AS subj_uid, l_suppkey * 10 + 3 AS obj_uid, round(l_discount, 2) AS score FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


@query("fact_entity_weights", X.with_(["kg_mentions"], """SELECT q_id, uid, score, rank, round(score / sum(score) OVER (PARTITION BY q_id), 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, uid) AS rank FROM (
  SELECT q_id, uid, round(sum(score) / greatest(max(n), 1), 6) AS score FROM (SELECT q_id, subj_uid AS uid, score FROM facts UNION ALL SELECT q_id, obj_uid, score FROM facts) JOIN (SELECT uid, count(*) AS n FROM kg_mentions GROUP BY uid) USING (uid) GROUP BY q_id, uid)) WHERE rank <= 10""", {"facts": _FACTS}))
def fact_entity_weights(spark, d):
    from .registry import table

    o, l = table(spark, d, "orders"), table(spark, d, "lineitem")  # noqa: E741
    facts = l.join(o, l.l_orderkey == o.o_orderkey).select(F.col("o_custkey").alias("q_id"), (F.col("l_partkey") * 10 + 2).alias("subj_uid"), (F.col("l_suppkey") * 10 + 3).alias("obj_uid"), F.round("l_discount", 2).alias("score"))
    nodes = X.kg_mentions(spark, d).groupBy("uid").agg(F.count("*").alias("ref_count"))
    return ranking.fact_weights(facts, nodes)


@query("median_weight", "SELECT q_id, median FROM (SELECT l_suppkey AS q_id, l_quantity AS median, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) - 1 AS r, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem) WHERE r = n // 2")
def median_weight(spark, d):
    from .registry import table

    return ranking.upper_median(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("q_id"), F.col("l_quantity").alias("w")), "q_id", "w")


@query("schema_summary", X.with_(["kg_edges", "entities"], "SELECT a.type AS src_type, relation, b.type AS dst_type, count(*) AS edges FROM kg_edges JOIN entities a ON src = a.uid JOIN entities b ON dst = b.uid GROUP BY ALL"))
def schema_summary(spark, d):
    return store.schema_summary(X.kg_edges(spark, d), X.entities(spark, d))


@query("graph_stats", X.with_(["l2_vertices", "kg_edges"], "SELECT (SELECT count(*) FROM l2_vertices) AS nodes, (SELECT count(*) FROM kg_edges) AS edges"))
def graph_stats(spark, d):
    return store.graph_stats(X.l2_vertices(spark, d), X.kg_edges(spark, d))


_GONE = "SELECT src, dst, relation FROM kg_edges WHERE relation = 'ORDERED'"


@query("delete_triplet", X.with_(["kg_edges", "l2_vertices"], """SELECT 'edge' AS kind, count(*) AS n FROM kg_edges WHERE relation <> 'ORDERED'
  UNION ALL SELECT 'vertex', count(*) FROM l2_vertices WHERE NOT (vid IN (SELECT unnest([src, dst]) FROM kg_edges WHERE relation = 'ORDERED') AND vid NOT IN (SELECT unnest([src, dst]) FROM kg_edges WHERE relation <> 'ORDERED'))"""))
def delete_triplet(spark, d):
    e = X.kg_edges(spark, d)
    left, vertices = graph.delete_triplet(e, X.l2_vertices(spark, d), e.where("relation = 'ORDERED'").select("src", "dst", "relation").distinct())
    return left.agg(F.lit("edge").alias("kind"), F.count("*").alias("n")).unionAll(vertices.agg(F.lit("vertex"), F.count("*")))


@query("upsert_vertex", "SELECT user_id AS vid, event_type AS name FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1 UNION ALL SELECT s_suppkey + 1000000, s_name FROM supplier")
def upsert_vertex(spark, d):
    from .registry import table

    old = table(spark, d, "supplier").select((F.col("s_suppkey") + 1000000).alias("vid"), F.col("s_name").alias("name"))
    new = table(spark, d, "events").select(F.col("user_id").alias("vid"), F.col("event_type").alias("name"), F.col("event_id").alias("write_seq"))
    return store.upsert(old, new, ["vid"]).drop("write_seq")


@query("upsert_edge", X.with_(["kg_edges"], "SELECT src, dst, relation, source_chunk FROM (SELECT *, row_number() OVER (PARTITION BY src, dst, relation ORDER BY CAST(source_chunk AS BIGINT) DESC) AS r FROM kg_edges) WHERE r = 1"))
def upsert_edge(spark, d):
    e = X.kg_edges(spark, d)
    return store.upsert(e.limit(0), e.withColumn("write_seq", F.col("source_chunk").cast("bigint")), ["src", "dst", "relation"]).drop("write_seq")


@query("upsert_triplet", X.with_(["kg_edges"], "SELECT vid, count(*) AS n FROM (SELECT DISTINCT unnest([src, dst]) AS vid, relation FROM kg_edges) GROUP BY vid"))
def upsert_triplet(spark, d):
    rows = X.kg_edges(spark, d, repeated=True).select(F.explode(F.array("src", "dst")).alias("vid"), "relation").withColumn("write_seq", F.lit(0))
    return store.upsert(rows.limit(0).drop("write_seq"), rows, ["vid", "relation"]).groupBy("vid").agg(F.count("*").alias("n"))


@query("storage_footprint", X.with_(["l2_vertices", "kg_edges"], """SELECT CAST(n * 100 + e * 50 AS DOUBLE) AS l2_logical, round(CAST(n * 100 + e * 50 AS DOUBLE) * 4.57::DOUBLE, 2) AS l2_disk, CAST(v * 64 * 4 AS DOUBLE) AS vector_data, round(CAST(v * 64 * 4 AS DOUBLE) * 1.5::DOUBLE, 2) AS vector_index, CAST(150000 AS DOUBLE) AS l1_bound, round(CAST(n * 100 + e * 50 AS DOUBLE) * 4.57::DOUBLE / 150000, 4) AS ratio
  FROM (SELECT (SELECT count(*) FROM l2_vertices) AS n, (SELECT count(*) FROM kg_edges) AS e, (SELECT count(*) FROM embeddings) AS v)"""))
def storage_footprint(spark, d):
    from .registry import table

    counts = store.graph_stats(X.l2_vertices(spark, d), X.kg_edges(spark, d)).withColumn("vectors", table(spark, d, "embeddings").agg(F.count("*")).scalar())
    return counts.select(*[v.alias(k) for k, v in store.footprint("nodes", "edges", "vectors", 64).items()])


@query("promote_entity", X.with_(["hits", "l2_vertices", "bidir"], """SELECT src, dst, relation, dst IN (SELECT vid FROM l2_vertices) AS in_l2 FROM (SELECT DISTINCT src, dst, relation FROM bidir WHERE src IN (
  SELECT l_partkey * 10 + 2 FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_partkey HAVING count(DISTINCT o_custkey) >= 40))"""))
def promote_entity(spark, d):
    matched = X.kg_rows(spark, d).select(F.col("customer").alias("q_id"), F.col("part").alias("uid"))
    return cache.entity_promotion(matched, X.kg_edges(spark, d), X.l2_vertices(spark, d), 40)[1]
