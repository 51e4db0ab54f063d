"""Lookups, sinks that are read back, ingestion by aligned names, model texts, logs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import parsing, vector
from ..operators import answer, fetch, graph, ingest, models, retrieve, store, vector_search
from ..session import checkpoints
from ..sources import datasets
from . import fixtures as X
from .registry import query, table
from .texts import _HEUR


def _new(spark, what: str) -> str:
    return f"{checkpoints(spark)}/{what}-{uuid.uuid4().hex}"


# --- lookups


@query("point_fetch", "SELECT c_name, c_mktsegment FROM customer WHERE c_custkey = 7")
def point_fetch(spark, d):
    return fetch.one(table(spark, d, "customer"), "c_custkey", 7, ["c_name", "c_mktsegment"])


@query("texts_in_order", "SELECT user_id AS q_id, md5(string_agg(coalesce(t.text, ''), '|' ORDER BY event_id)) AS texts, count(*) AS n FROM events e LEFT JOIN documents t ON t.doc_id = e.event_id % 1500 GROUP BY user_id")
def texts_in_order(spark, d):
    e = table(spark, d, "events").withColumn("id", (F.col("event_id") % 1500).cast("string"))
    lists = e.groupBy(F.col("user_id").alias("q_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "id"))), lambda s: s["id"]).alias("ids"))
    got = fetch.texts_in_order(lists, table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), "text"))
    return got.select("q_id", F.md5(F.array_join("texts", "|")).alias("texts"), F.size("texts").cast("bigint").alias("n"))


@query("node_props", X.with_(["entities"], "SELECT uid AS vid, name, type FROM entities WHERE uid IN (SELECT l_partkey * 10 + 2 FROM lineitem WHERE l_quantity > 49)"))
def node_props(spark, d):
    ids = table(spark, d, "lineitem").where("l_quantity > 49").select((F.col("l_partkey") * 10 + 2).alias("vid"))
    return fetch.node_props(ids, X.entities(spark, d).withColumnRenamed("uid", "vid"), ["name", "type"])


@query("run_info", "SELECT event_type, md5(string_agg(CAST(user_id AS VARCHAR), ',' ORDER BY event_id)) AS users FROM events GROUP BY event_type")
def run_info(spark, d):
    got = fetch.accumulated(table(spark, d, "events"), "event_type", F.col("user_id").cast("string"), "event_id")
    return got.select("event_type", F.md5(F.array_join("values", ",")).alias("users"))


# --- sinks


@query("chunk_sink", X.with_(["kg_mentions"], """SELECT CAST(o_orderkey AS VARCHAR) AS chunk_id, o_orderpriority AS text, '2024-01-31T00:00:00Z' AS ts, n AS uids, n AS entities, coalesce(e, 0) AS relations, CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 15) AS BIGINT) AS pk
  FROM orders LEFT JOIN (SELECT chunk_id, count(*) AS n FROM kg_mentions GROUP BY chunk_id) m ON m.chunk_id = CAST(o_orderkey AS VARCHAR) LEFT JOIN (SELECT source_chunk, count(*) AS e FROM kg_edges GROUP BY source_chunk) k ON k.source_chunk = m.chunk_id WHERE n IS NOT NULL"""))
def chunk_sink(spark, d):
    """Chunks with their metadata appended in two batches, and read back."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("chunk_id"), F.col("o_orderpriority").alias("text"), F.array().cast("array<double>").alias("vec"), "o_orderkey")
    e, at = X.entities(spark, d).select("uid", "name", "type", "desc"), _new(spark, "chunks")
    for part in (0, 1):  # a batch's metadata are made of its own chunks alone
        own = lambda c: F.pmod(F.col(c).cast("bigint"), F.lit(2)) == part  # noqa: B023, E731
        meta = ingest.graph_meta(X.kg_mentions(spark, d).where(own("chunk_id")).join(e, "uid"), X.kg_edges(spark, d).where(own("source_chunk")))
        store.append_chunks(o.where(own("o_orderkey")).join(meta, "chunk_id"), at, F.lit("2024-01-31 00:00:00").cast("timestamp"))
    back = fetch.chunk_parts(o.select("chunk_id").distinct(), spark.read.parquet(at), counts=True, keep=("pk",)).where("pk is not null")
    return back.select("chunk_id", "text", "ts", *[F.col(c).cast("bigint").alias(c if c != "entity_uids" else "uids") for c in ("entity_uids", "entities", "relations")], "pk")


@query("triplet_export", X.with_(["kg_edges"], "SELECT DISTINCT src AS head, relation, dst AS tail FROM kg_edges"))
def triplet_export(spark, d):
    at = _new(spark, "triplets")
    store.export_triplets(X.kg_edges(spark, d, repeated=True), at)
    return datasets.read_json(spark, at, "head bigint, relation string, tail bigint", lines=True)


@query("result_files", "SELECT conv_id, turn, md5(text) AS body FROM conversations")
def result_files(spark, d):
    """Two batches' result files written as JSON lines and merged."""
    c, paths = table(spark, d, "conversations"), []
    for part in (0, 1):
        paths.append(_new(spark, "results"))
        store.write_json(c.where(F.col("conv_id") % 2 == part).select("conv_id", "turn", "text"), paths[-1])
    return store.merge_results(spark, paths, "conv_id bigint, turn bigint, text string").select("conv_id", "turn", F.md5("text").alias("body"))


@query("upsert_vertex_props", """SELECT vid, replace(name, '"', ' ') AS name, type, NULL::VARCHAR AS source_chunk FROM (SELECT coalesce(s.vid, e.vid) AS vid, coalesce(e.name, s.name) AS name, coalesce(e.type, s.type) AS type FROM (SELECT s_suppkey AS vid, s_name AS name, 'supplier' AS type FROM supplier) s
  FULL OUTER JOIN (SELECT user_id AS vid, arg_max(props, event_id) AS name, arg_max(CASE WHEN event_type <> 'view' THEN event_type END, CASE WHEN event_type <> 'view' THEN event_id END) AS type FROM events GROUP BY user_id) e ON s.vid = e.vid)""")
def upsert_vertex_props(spark, d):
    """Users' events written over suppliers: quoted names are escaped, a null type leaves the one that is there, other columns stay out."""
    old = table(spark, d, "supplier").select(F.col("s_suppkey").alias("vid"), F.col("s_name").alias("name"), F.lit("supplier").alias("type"), F.lit(None).cast("string").alias("source_chunk"))
    new = table(spark, d, "events").select(F.col("user_id").alias("vid"), F.col("props").alias("name"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("type"), "value", F.col("event_id").alias("write_seq"))
    return store.upsert_vertices(old, new)


_HID = lambda c: f"CAST('0x' || substr(md5({c}), 1, 15) AS BIGINT)"


@query("upsert_triplet_rows", f"""SELECT 'vertex' AS kind, {_HID('name')} AS a, NULL::BIGINT AS b, name AS label FROM (SELECT DISTINCT unnest([p_name, p_brand]) AS name FROM part) UNION ALL SELECT 'edge', {_HID('p_name')}, {_HID('p_brand')}, 'MADE_BY' FROM (SELECT DISTINCT p_name, p_brand FROM part)""")
def upsert_triplet_rows(spark, d):
    t = table(spark, d, "part").select(F.col("p_name").alias("head"), F.lit("MADE_BY").alias("relation"), F.col("p_brand").alias("tail"))
    v, e = store.upsert_triplets(spark.createDataFrame([], "vid bigint, name string"), spark.createDataFrame([], "src bigint, dst bigint, relation string"), t)
    return v.select(F.lit("vertex").alias("kind"), F.col("vid").alias("a"), F.lit(None).cast("bigint").alias("b"), F.col("name").alias("label")).unionAll(e.select(F.lit("edge"), "src", "dst", "relation"))


# --- ingestion by aligned names

def _extracted(spark, d):
    p = table(spark, d, "part")
    e = F.array(F.struct(F.col("p_name").alias("id"), F.lit("part").alias("type"), F.lit("").alias("desc")), F.struct(F.col("p_brand").alias("id"), F.lit("brand").alias("type"), F.lit("").alias("desc")))
    r = F.array(F.struct(F.col("p_name").alias("src"), F.col("p_brand").alias("tgt"), F.lit("MADE_BY").alias("rel")), F.struct(F.col("p_name").alias("src"), F.col("p_brand").alias("tgt"), F.lit("").alias("rel")), F.struct(F.col("p_name").alias("src"), F.lit("nobody").alias("tgt"), F.lit("X").alias("rel")))
    return p.select(F.col("p_partkey").cast("string").alias("chunk_id"), e.alias("entities"), r.alias("relations"))


def _uids(spark, d):
    """An alignment map: parts by name, brands by number; a third of the names isn't in it."""
    p = table(spark, d, "part")
    a = p.where("p_partkey % 3 <> 0").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("uid")).select("name", F.lit("part").alias("type"), F.lit("").alias("desc"), "uid")
    return a.unionAll(p.select("p_brand").distinct().select("p_brand", F.lit("brand"), F.lit(""), -F.substring("p_brand", 7, 9).cast("bigint")))


_UIDS = "SELECT p_name AS name, min(p_partkey) AS uid FROM part WHERE p_partkey % 3 <> 0 GROUP BY p_name"


@query("aligned_mentions", f"WITH u AS ({_UIDS}) SELECT CAST(p_partkey AS VARCHAR) AS chunk_id, uid, p_name AS name FROM part JOIN u ON name = p_name UNION ALL SELECT CAST(p_partkey AS VARCHAR), -CAST(substr(p_brand, 7) AS BIGINT), p_brand FROM part")
def aligned_mentions(spark, d):
    return ingest.aligned_graph(_extracted(spark, d), _uids(spark, d))[0].select("chunk_id", "uid", "name")


@query("aligned_facts", f"WITH u AS ({_UIDS}) SELECT p_name || ' MADE_BY ' || p_brand AS fact_text, CAST(p_partkey AS VARCHAR) AS chunk_id, uid AS subj_uid, -CAST(substr(p_brand, 7) AS BIGINT) AS obj_uid FROM part JOIN u ON name = p_name")
def aligned_facts(spark, d):
    _, edges = ingest.aligned_graph(_extracted(spark, d), _uids(spark, d))
    return ingest.facts(edges).select("fact_text", "chunk_id", "subj_uid", "obj_uid")


@query("index_batches")
def index_batches(spark, d):
    """The benchmark's texts in two batches, the second against the index that the first left."""
    b = table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("chunk_id"), "text", "item_id")
    index = spark.createDataFrame([], "uid bigint, name string, type string, desc string, vec array<double>")
    out = None
    for part in (0, 1):
        m, _, index = ingest.index_batch(b.where(F.col("item_id") % 2 == part), index, vector.hashed_embedding)
        out = m if out is None else out.unionByName(m)
    return out.groupBy("chunk_id").agg(F.count_distinct("uid").alias("nodes"))


# --- model texts

_EMB = lambda c: f"(SELECT list_transform(r, lambda x: CASE WHEN n = 0 THEN x ELSE x / n END) FROM (SELECT r, sqrt(list_inner_product(r, r)) AS n FROM (SELECT list_transform(range(32), lambda i: CAST(len(list_filter(s, lambda v: v = i)) AS DOUBLE)) AS r FROM (SELECT list_transform(list_filter(regexp_split_to_array(lower({c}), '\\s+'), lambda t: t <> ''), lambda t: CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % 32) AS s))))"


@query("text_similarity", f"SELECT item_id, round(list_inner_product({_EMB('x')}, {_EMB('y')}), 6) AS sim FROM (SELECT a.item_id, a.text AS x, b.text AS y FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1)")
def text_similarity(spark, d):
    b = table(spark, d, "benchmark")
    both = b.join(b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other")), "item_id")
    return both.select("item_id", vector.text_similarity(F.col("text"), F.col("other")).alias("sim"))


@query("triplet_vectors", f"SELECT p_name AS head, p_brand AS tail, round(list_sum(list_transform({_EMB("p_name || ' MADE_BY ' || p_brand")}, lambda x: round(x, 6))), 4) AS total FROM (SELECT DISTINCT p_name, p_brand FROM part)")
def triplet_vectors(spark, d):
    """Vectors of triples, half of which were made before."""
    t = table(spark, d, "part").select(F.col("p_name").alias("head"), F.lit("MADE_BY").alias("relation"), F.col("p_brand").alias("tail")).distinct()
    key, words = ["head", "relation", "tail"], F.concat_ws(" ", "head", "relation", "tail")
    before = models.embed_absent(t.where(F.length("head") % 2 == 0), key, words, spark.createDataFrame([], "head string, relation string, tail string, vec array<double>"), vector.hashed_embedding)
    every = models.embed_absent(t, key, words, before, vector.hashed_embedding)
    return every.select("head", "tail", F.round(F.aggregate("vec", F.lit(0.0), lambda s, x: s + F.round(x, 6)), 4).alias("total"))


@query("question_rewrite", "SELECT conv_id, turn, CASE WHEN length(trim(role)) > 4 THEN trim(role) ELSE text END AS question FROM (SELECT conv_id, turn, text, CASE role WHEN 'user' THEN ' ab ' ELSE role END AS role FROM conversations)")
def question_rewrite(spark, d):
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", models.rewritten(F.col("text"), F.when(F.col("role") == "user", " ab ").otherwise(F.col("role"))).alias("question"))


@query("prompts", """SELECT item_id, md5('Answer from the passages alone, as JSON {"final_answer":"..."}; say "I don''t know." if they don''t tell.' || chr(10) || chr(10) || text || chr(10) || chr(10) || 'Question: q' || item_id) AS prompt FROM benchmark""")
def prompts(spark, d):
    b = table(spark, d, "benchmark")
    return b.select("item_id", F.md5(models.ask("answer", context=F.col("text"), question=F.concat(F.lit("q"), F.col("item_id").cast("string")))).alias("prompt"))


@query("query_entities", """SELECT s_suppkey AS id, CASE s_suppkey % 3 WHEN 0 THEN s_name || ':org' WHEN 1 THEN s_name || ':|x:' ELSE '' END AS entities FROM supplier""")
def query_entities(spark, d):
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey") % 3
    raw = F.when(k == 0, F.format_string('{"entities": [{"id": "%s", "type": "org"}, {"id": ""}]}', "s_name")).when(k == 1, F.format_string('```json\n{"entities": [{"name": "%s"}, "x"]}\n```', "s_name")).otherwise("none")
    listed = F.transform(parsing.query_entities(raw), lambda e: F.concat(e["id"], F.lit(":"), e["type"]))
    return s.select(F.col("s_suppkey").alias("id"), F.array_join(listed, "|").alias("entities"))


_RW = "SELECT a.item_id AS q_id, b.item_id AS other, list_distinct(list_filter(regexp_split_to_array(lower(a.text), '\\s+'), lambda t: t <> '')) AS x, list_distinct(list_filter(regexp_split_to_array(lower(b.text), '\\s+'), lambda t: t <> '')) AS y FROM benchmark a JOIN benchmark b ON a.item_id <> b.item_id AND a.item_id % 100 = 0"


@query("rerank_with_kept", f"""WITH p AS (SELECT q_id, CAST(other AS VARCHAR) AS chunk_id, other, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))::DOUBLE, 6) AS s FROM ({_RW})),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY other) AS rank FROM p) WHERE rank <= 30),
o AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY s DESC, chunk_id) AS turn FROM c WHERE rank % 10 <> 0), k AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY rank) AS turn FROM c WHERE rank % 10 = 0)
SELECT q_id, chunk_id, rank FROM (SELECT q_id, chunk_id, row_number() OVER (PARTITION BY q_id ORDER BY later, turn) AS rank FROM (SELECT q_id, chunk_id, 0 AS later, turn FROM o WHERE turn <= 3 UNION ALL SELECT q_id, chunk_id, 1, turn FROM k)) WHERE rank <= 6""")
def rerank_with_kept(spark, d):
    b = table(spark, d, "benchmark")
    q = b.where("item_id % 100 = 0").select(F.col("item_id").alias("q_id"), F.col("text").alias("question"))
    pairs = vector_search.in_blocks(q, b.select(F.col("item_id").cast("string").alias("chunk_id"), "text", "item_id")).where("item_id <> q_id")
    c = vector_search.ranked(pairs, "q_id", [F.col("item_id")], 30).drop("item_id")
    return retrieve.rerank_others(c, c.where("rank % 10 = 0"), 6)


@query("written_entities", "SELECT q_id, unnest(string_split(entities, chr(1))) AS ent_id, CAST(1 AS DOUBLE) AS weight FROM (" + _HEUR("q_id", "(SELECT conv_id * 1000 + turn AS q_id, text FROM conversations WHERE role = 'user')").replace("1, 6)", "1, 5)").replace("'|')", "chr(1))") + ") WHERE entities <> ''")
def written_entities(spark, d):
    c = table(spark, d, "conversations").where("role = 'user'")
    return retrieve.written_entities(c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("q_id"), F.col("text").alias("question")))


@query("agentic_chunks", "SELECT conv_id AS q_id, string_agg(DISTINCT c, ',' ORDER BY c) AS chunks FROM (SELECT conv_id, unnest(['r' || role, 't' || (turn % 3)]) AS c FROM conversations) GROUP BY conv_id")
def agentic_chunks(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("q_id"), F.col("turn").alias("step"), F.array(F.concat(F.lit("r"), "role"), F.concat(F.lit("t"), (F.col("turn") % 3).cast("string"))).alias("chunks"))
    return answer.agentic_chunks(c).select("q_id", F.array_join("chunks", ",").alias("chunks"))


# --- logs


@query("log_numbers", "SELECT event_id AS line, CAST(user_id AS DOUBLE) + 0.5::DOUBLE AS a, CAST(event_id AS DOUBLE) AS b, event_type AS kind FROM events")
def log_numbers(spark, d):
    e = table(spark, d, "events")
    lines = e.select(F.col("event_id").alias("line"), F.format_string("at 12 [%s] user=%d.5 event %d", "event_type", "user_id", "event_id").alias("value"))
    n = datasets.log_numbers(lines, "user=", 2)
    t = datasets.log_texts(lines, "[", "]")
    return n.join(t, "line").select("line", F.get("numbers", F.lit(0)).alias("a"), F.get("numbers", F.lit(1)).alias("b"), F.col("text").alias("kind"))
