"""Tables of the engine derived from the star schema, as DataFrames and as SQL for the other side.

Chunks are orders and embedded rows, entities are customers, parts and suppliers; a question is a row whose id is divisible by 100.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vector
from .registry import table

EVERY = 100


def chunks(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select(F.concat(F.lit("chunk_"), e.vec_id.cast("string")).alias("chunk_id"), vector.doubles(e.embedding).alias("vec"), "vec_id", F.col("label").cast("bigint").alias("label"))


def questions(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.where(e.vec_id % EVERY == 0).select(e.vec_id.alias("q_id"), vector.doubles(e.embedding).alias("qvec"), F.col("label").cast("bigint").alias("q_label"))


def kg_rows(spark: SparkSession, d: str) -> DataFrame:
    """(source_chunk, customer, part, supplier) of each line item.  Both tables are dealt out by the chunk's id, so all that is made for each chunk stays where it is.

    As many partitions as are set: they aren't joined to larger ones, as much more is made of them than they hold.
    """
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    o, l = table(spark, d, "orders"), table(spark, d, "lineitem")  # noqa: E741
    items = l.select(F.col("l_orderkey").cast("string").alias("source_chunk"), (F.col("l_partkey") * 10 + 2).alias("part"), (F.col("l_suppkey") * 10 + 3).alias("supplier"))
    buyers = o.select(F.col("o_orderkey").cast("string").alias("source_chunk"), (F.col("o_custkey") * 10 + 1).alias("customer"))
    return items.repartition(n, "source_chunk").join(buyers.repartition(n, "source_chunk"), "source_chunk")


def kg_edges(spark: SparkSession, d: str, repeated: bool = False) -> DataFrame:
    """repeated: also the edges that a chunk has several times, for what is made distinct anyway."""
    ends = F.array(*[F.struct(F.col(src).alias("src"), F.lit(ordered).alias("ordered")) for src, ordered in (("customer", True), ("supplier", False))])
    e = kg_rows(spark, d).select(F.explode(ends).alias("e"), F.col("part").alias("dst"), "source_chunk").select("e.src", "dst", "e.ordered", "source_chunk")
    return (e if repeated else e.distinct()).select("src", "dst", F.when(F.col("ordered"), "ORDERED").otherwise("SUPPLIES").alias("relation"), "source_chunk")


def kg_mentions(spark: SparkSession, d: str) -> DataFrame:
    return kg_rows(spark, d).select(F.col("source_chunk").alias("chunk_id"), F.explode(F.array("customer", "part", "supplier")).alias("uid")).distinct()


def entities(spark: SparkSession, d: str) -> DataFrame:
    """(uid, name, type, desc, sim) of all customers, parts and suppliers."""
    c, p, s = table(spark, d, "customer"), table(spark, d, "part"), table(spark, d, "supplier")
    return (
        c.select((c.c_custkey * 10 + 1).alias("uid"), c.c_name.alias("name"), F.lit("customer").alias("type"), c.c_mktsegment.alias("desc"), F.round(c.c_acctbal, 2).alias("sim"))
        .unionAll(p.select((p.p_partkey * 10 + 2).alias("uid"), p.p_name.alias("name"), F.lit("part").alias("type"), F.concat_ws(" ", p.p_brand, p.p_type).alias("desc"), F.round(p.p_retailprice, 2).alias("sim")))
        .unionAll(s.select((s.s_suppkey * 10 + 3).alias("uid"), F.concat(s.s_name, F.lit(", Inc.")).alias("name"), F.lit("supplier").alias("type"), F.lit("").alias("desc"), F.round(s.s_acctbal, 2).alias("sim")))
    )


def seeds(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    return c.where(c.c_custkey % EVERY == 0).select(c.c_custkey.alias("q_id"), F.lit("e1").alias("ent_id"), (c.c_custkey * 10 + 1).alias("uid"), F.lit(1.0).alias("weight"))


def accesses(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.concat(F.lit("chunk_"), (e.event_id % 200).cast("string")).alias("chunk_id"), e.ts.cast("timestamp").alias("ts"), "event_id", F.col("user_id").alias("ent_id"), "event_type")


def hits(spark: SparkSession, d: str) -> DataFrame:
    """(q_id, ent_id, chunk_id): an entity (order priority) of a question (customer) hit a chunk (part)."""
    o, l = table(spark, d, "orders"), table(spark, d, "lineitem")  # noqa: E741
    return l.join(o, l.l_orderkey == o.o_orderkey).select(F.col("o_custkey").alias("q_id"), F.col("o_orderpriority").alias("ent_id"), F.concat(F.lit("p"), (F.col("l_partkey") % 50).cast("string")).alias("chunk_id")).distinct()


def l2_vertices(spark: SparkSession, d: str) -> DataFrame:
    """Each node of the graph with the last (largest) chunk that wrote it."""
    return kg_mentions(spark, d).groupBy(F.col("uid").alias("vid")).agg(F.max("chunk_id").alias("source_chunk"))


def qa(spark: SparkSession, d: str) -> DataFrame:
    """A user's turn and the assistant's next one: question, prediction (the answer's text) and truth (the question's text)."""
    c = table(spark, d, "conversations")
    a = c.where("role = 'user'").select("conv_id", F.col("turn").alias("t"), F.col("text").alias("gt"))
    b = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("t"), F.col("text").alias("predict"))
    return a.join(b, ["conv_id", "t"]).select((F.col("conv_id") * 1000 + F.col("t")).alias("q_id"), "predict", "gt")


SQL = {
    "chunks": "SELECT 'chunk_' || vec_id AS chunk_id, CAST(embedding AS DOUBLE[]) AS vec, vec_id, CAST(label AS BIGINT) AS label FROM embeddings",
    "questions": "SELECT vec_id AS q_id, CAST(embedding AS DOUBLE[]) AS qvec, CAST(label AS BIGINT) AS q_label FROM embeddings WHERE vec_id % 100 = 0",
    "kg_edges": """SELECT DISTINCT src, dst, relation, source_chunk FROM (
        SELECT o_custkey * 10 + 1 AS src, l_partkey * 10 + 2 AS dst, 'ORDERED' AS relation, CAST(o_orderkey AS VARCHAR) AS source_chunk FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        UNION ALL SELECT l_suppkey * 10 + 3, l_partkey * 10 + 2, 'SUPPLIES', CAST(o_orderkey AS VARCHAR) FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
    "kg_mentions": "SELECT DISTINCT source_chunk AS chunk_id, unnest([src, dst]) AS uid FROM kg_edges",
    "entities": """SELECT c_custkey * 10 + 1 AS uid, c_name AS name, 'customer' AS type, c_mktsegment AS "desc", round(c_acctbal, 2) AS sim FROM customer
        UNION ALL SELECT p_partkey * 10 + 2, p_name, 'part', p_brand || ' ' || p_type, round(p_retailprice, 2) FROM part
        UNION ALL SELECT s_suppkey * 10 + 3, s_name || ', Inc.', 'supplier', '', round(s_acctbal, 2) FROM supplier""",
    "seeds": "SELECT c_custkey AS q_id, 'e1' AS ent_id, c_custkey * 10 + 1 AS uid, CAST(1 AS DOUBLE) AS weight FROM customer WHERE c_custkey % 100 = 0",
    "bidir": "SELECT src, dst, relation, source_chunk FROM kg_edges UNION ALL SELECT dst, src, relation, source_chunk FROM kg_edges",
    "accesses": "SELECT 'chunk_' || (event_id % 200) AS chunk_id, ts, event_id, user_id AS ent_id, event_type FROM events",
    "hits": "SELECT DISTINCT o_custkey AS q_id, o_orderpriority AS ent_id, 'p' || (l_partkey % 50) AS chunk_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "l2_vertices": "SELECT uid AS vid, max(chunk_id) AS source_chunk FROM kg_mentions GROUP BY uid",
    "qa": """SELECT a.conv_id * 1000 + a.turn AS q_id, b.text AS predict, a.text AS gt FROM conversations a JOIN conversations b
        ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND a.role = 'user' AND b.role = 'assistant'""",
    "scored": "SELECT q_id, chunk_id, round(CASE WHEN list_inner_product(qvec, qvec) * list_inner_product(vec, vec) = 0 THEN 0.0 ELSE list_inner_product(qvec, vec) / (sqrt(list_inner_product(qvec, qvec)) * sqrt(list_inner_product(vec, vec))) END, 6) AS score, vec_id, label, q_label FROM questions, chunks WHERE vec_id <> q_id",
    "dense": "SELECT q_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, chunk_id) AS rank FROM scored) WHERE rank <= 10",
    "glist": "SELECT q_id, chunk_id, score, rank FROM (SELECT q_id, chunk_id, CAST(score + 1 AS DOUBLE) AS score, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, chunk_id) AS rank FROM scored WHERE label = q_label) WHERE rank <= 15",
}
_NEEDS = {"kg_mentions": ["kg_edges"], "bidir": ["kg_edges"], "l2_vertices": ["kg_mentions"], "scored": ["questions", "chunks"], "dense": ["scored"], "glist": ["scored"]}


def with_(names: list[str], body: str, extra: dict[str, str] | None = None) -> str:
    """body after the definitions of `names`, what they need first."""
    order: list[str] = []

    def add(n: str) -> None:
        for m in _NEEDS.get(n, []):
            add(m)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    parts = [f"{n} AS ({SQL[n]})" for n in order] + [f"{k} AS ({v})" for k, v in (extra or {}).items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body
