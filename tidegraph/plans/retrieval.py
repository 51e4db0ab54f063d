"""Vector search, fusion and ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vector
from ..operators import fusion, ranking, vector_search
from . import fixtures as X
from .registry import query, table


def dense(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    return vector_search.top_k(X.questions(spark, d), X.chunks(spark, d), k, own=F.concat(F.lit("chunk_"), F.col("q_id").cast("string")))


def graph_list(spark: SparkSession, d: str, k: int = 15) -> DataFrame:
    """A second ranking: chunks of the question's own label, by score + 1."""
    q = X.questions(spark, d).withColumnRenamed("q_label", "label")
    near = vector_search.top_k(q, X.chunks(spark, d), k, own=F.concat(F.lit("chunk_"), F.col("q_id").cast("string")), within="label")
    return near.select("q_id", "chunk_id", (F.col("score") + 1).alias("score"), "rank")


def coverage_list(spark: SparkSession, d: str) -> DataFrame:
    """How many entities cover a chunk of the graph list: 1 to 4, by its id."""
    return graph_list(spark, d).select("q_id", "chunk_id", (F.substring("chunk_id", 7, 20).cast("bigint") % 4 + 1).alias("n_entities"))


@query("dpr_topk", X.with_(["dense"], "SELECT * FROM dense"))
def dpr_topk(spark, d):
    return dense(spark, d)


@query("dpr_only_topk", X.with_(["dense"], "SELECT q_id, chunk_id, rank FROM dense WHERE rank <= 6"))
def dpr_only_topk(spark, d):
    return dense(spark, d, 6).select("q_id", "chunk_id", "rank")


@query("cosine_pairs", """SELECT a.label AS label, count(*) AS n, round(min(s), 6) AS low, round(max(s), 6) AS high FROM (
  SELECT x.label, round(list_inner_product(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])) / (sqrt(list_inner_product(CAST(x.embedding AS DOUBLE[]), CAST(x.embedding AS DOUBLE[]))) * sqrt(list_inner_product(CAST(y.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])))), 6) AS s FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1) a GROUP BY a.label""")
def cosine_pairs(spark, d):
    c = X.chunks(spark, d)  # each row beside the next one
    c = c.join(c.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec").alias("other")), "vec_id").select(F.col("label").cast("int").alias("label"), F.round(vector.cosine(F.col("vec"), F.col("other")), 6).alias("s"))
    return c.groupBy("label").agg(F.count("*").alias("n"), F.round(F.min("s"), 6).alias("low"), F.round(F.max("s"), 6).alias("high"))


_CENTROID = "SELECT CAST(label AS BIGINT) AS label, i, avg(x) AS x FROM (SELECT label, unnest(range(len(embedding))) AS i, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings) GROUP BY ALL"


@query("entity_link_topk", X.with_(["chunks"], """SELECT q_id, chunk_id AS entity, score, rank FROM (
  SELECT q_id, chunk_id, score, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, chunk_id) AS rank FROM (
    SELECT t.label AS q_id, c.chunk_id, round(list_inner_product(t.v, c.vec) / (sqrt(list_inner_product(t.v, t.v)) * sqrt(list_inner_product(c.vec, c.vec))), 6) AS score FROM cv t, chunks c)) WHERE rank <= 5""",
    {"cent": _CENTROID, "cv": "SELECT label, list(x ORDER BY i) AS v FROM cent GROUP BY label"}))
def entity_link_topk(spark, d):
    e = X.chunks(spark, d)
    flat = e.select("label", F.posexplode("vec").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    centre = flat.groupBy(F.col("label").alias("q_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("qvec"))
    return vector_search.top_k(centre, e, 5).withColumnRenamed("chunk_id", "entity")


@query("fact_topk", X.with_(["scored"], "SELECT q_id, fact_id, score, rank FROM (SELECT q_id, 'fact_' || chunk_id AS fact_id, score, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, 'fact_' || chunk_id) AS rank FROM scored) WHERE rank <= 100"))
def fact_topk(spark, d):
    facts = X.chunks(spark, d).withColumn("fact_id", F.concat(F.lit("fact_"), "chunk_id"))
    return vector_search.top_k(X.questions(spark, d), facts, 100, key="fact_id", own=F.concat(F.lit("fact_chunk_"), F.col("q_id").cast("string")))


_RRF = "SELECT q_id, chunk_id, round(sum(CAST(1 AS DOUBLE) / (60 + rank)), 6) AS score FROM (SELECT q_id, chunk_id, rank FROM dense UNION ALL SELECT q_id, chunk_id, rank FROM glist) GROUP BY ALL"


@query("rrf_fusion", X.with_(["dense", "glist"], "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, chunk_id) AS rank FROM f) WHERE rank <= 20", {"f": _RRF}))
def rrf_fusion(spark, d):
    return fusion.rrf(dense(spark, d), graph_list(spark, d))


def _MM(v: str, src: str) -> str:
    pos = f"CASE WHEN {v} > 0 THEN {v} END"
    high, low = f"coalesce(max({pos}) OVER w, CAST(1 AS DOUBLE))", f"coalesce(min({pos}) OVER w, CAST(0 AS DOUBLE))"
    return f"SELECT q_id, chunk_id, CASE WHEN {high} > {low} THEN ({v} - {low}) / ({high} - {low}) ELSE 0.5 END AS n FROM {src} WINDOW w AS (PARTITION BY q_id)"


@query("weighted_fusion", X.with_(["dense", "glist"], """SELECT q_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, chunk_id) AS rank FROM (
  SELECT q_id, chunk_id, round(CASE WHEN ne >= 2 THEN s * pow(1.3::DOUBLE, ne - 1) ELSE s END, 6) AS score FROM (
    SELECT q_id, chunk_id, coalesce(CAST(substr(CASE WHEN gin THEN chunk_id END, 7) AS BIGINT) % 4 + 1, 0) AS ne,
      CASE WHEN din AND gin THEN greatest(dn, gn) * 3.0::DOUBLE ELSE 0.5::DOUBLE * dn + 0.5::DOUBLE * gn END AS s FROM (
      SELECT coalesce(dd.q_id, gg.q_id) AS q_id, coalesce(dd.chunk_id, gg.chunk_id) AS chunk_id, dd.q_id IS NOT NULL AS din, gg.q_id IS NOT NULL AS gin, coalesce(dd.n, low.low, 0.0) AS dn, coalesce(gg.n, 0.0) AS gn
      FROM dd FULL OUTER JOIN gg ON dd.q_id = gg.q_id AND dd.chunk_id = gg.chunk_id LEFT JOIN low ON low.q_id = coalesce(dd.q_id, gg.q_id))))) WHERE rank <= 30""",
    {"dd": _MM("score", "dense"), "gg": _MM("score", "glist"), "low": "SELECT q_id, coalesce(min(n), 0.0) AS low FROM dd GROUP BY q_id"}))
def weighted_fusion(spark, d):
    return fusion.weighted(dense(spark, d), graph_list(spark, d), coverage_list(spark, d))


@query("dual_fusion", X.with_(["dense", "glist"], """SELECT q_id, chunk_id, rank FROM (SELECT q_id, chunk_id, row_number() OVER (PARTITION BY q_id ORDER BY section, turn, source) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY q_id, section, source ORDER BY CASE WHEN section = 0 THEN gr ELSE coalesce(dr, gr) END) AS turn FROM (
    SELECT coalesce(a.q_id, b.q_id) AS q_id, coalesce(a.chunk_id, b.chunk_id) AS chunk_id, a.rank AS dr, b.rank AS gr,
      CASE WHEN a.rank IS NOT NULL AND b.rank IS NOT NULL THEN 0 ELSE 1 END AS section, CASE WHEN a.rank IS NOT NULL THEN 0 ELSE 1 END AS source
    FROM dense a FULL OUTER JOIN glist b ON a.q_id = b.q_id AND a.chunk_id = b.chunk_id))) WHERE rank <= 6"""))
def dual_fusion(spark, d):
    return fusion.dual(dense(spark, d), graph_list(spark, d))


@query("graph_only_topk", X.with_(["glist"], "SELECT q_id, chunk_id, rank FROM glist WHERE rank <= 6"))
def graph_only_topk(spark, d):
    return graph_list(spark, d, 6).select("q_id", "chunk_id", "rank")


@query("minmax_norm", X.with_(["scored"], "SELECT q_id, chunk_id, round(n, 6) AS norm FROM (" + _MM("score", "scored") + ")"))
def minmax_norm(spark, d):
    """Over all pairs of questions and chunks, of which about half have scores below 0."""
    every = vector_search.scores(X.questions(spark, d), X.chunks(spark, d), own=F.concat(F.lit("chunk_"), F.col("q_id").cast("string")))
    return ranking.minmax_of_many(every, "score", "n").select("q_id", "chunk_id", F.round("n", 6).alias("norm"))


@query("retry_expansion", X.with_(["scored"], "SELECT q_id, chunk_id, rank FROM (SELECT q_id, chunk_id, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, chunk_id) AS rank FROM scored) WHERE rank <= CASE WHEN q_id % 200 = 0 THEN 20 ELSE 10 END"))
def retry_expansion(spark, d):
    from ..operators import cache

    unknown = X.questions(spark, d).where("q_id % 200 = 0").select("q_id")
    return cache.widened(dense(spark, d, 20), unknown, 10).select("q_id", "chunk_id", "rank")


@query("retrieval_stats", X.with_(["dense", "glist"], """SELECT count(*) AS questions, round(avg(nd), 4) AS dense_hits, round(avg(ng), 4) AS graph_hits, round(avg(nb), 4) AS both_hits, CAST(sum(CASE WHEN ng = 0 THEN 1 ELSE 0 END) AS BIGINT) AS zero_graph FROM (
  SELECT q.q_id, (SELECT count(*) FROM dense a WHERE a.q_id = q.q_id) AS nd, (SELECT count(*) FROM glist g WHERE g.q_id = q.q_id) AS ng,
  (SELECT count(*) FROM dense a JOIN glist g ON a.q_id = g.q_id AND a.chunk_id = g.chunk_id WHERE a.q_id = q.q_id) AS nb FROM questions q)"""))
def retrieval_stats(spark, d):
    a = dense(spark, d).groupBy("q_id").agg(F.collect_set("chunk_id").alias("a"))
    b = graph_list(spark, d).groupBy("q_id").agg(F.collect_set("chunk_id").alias("b"))
    none = F.array().cast("array<string>")
    x = X.questions(spark, d).select("q_id").join(a, "q_id", "left").join(b, "q_id", "left").select(F.coalesce("a", none).alias("a"), F.coalesce("b", none).alias("b"))
    return x.agg(F.count("*").alias("questions"), F.round(F.avg(F.size("a")), 4).alias("dense_hits"), F.round(F.avg(F.size("b")), 4).alias("graph_hits"), F.round(F.avg(F.size(F.array_intersect("a", "b"))), 4).alias("both_hits"), F.count_if(F.size("b") == 0).alias("zero_graph"))


@query("lexical_rerank", """WITH p AS (SELECT a.item_id AS q_id, b.item_id AS other, list_distinct(list_filter(regexp_split_to_array(lower(a.text), '\\s+'), lambda t: t <> '')) AS x, list_distinct(list_filter(regexp_split_to_array(lower(b.text), '\\s+'), lambda t: t <> '')) AS y
  FROM benchmark a JOIN benchmark b ON a.item_id <> b.item_id AND a.item_id % 100 = 0)
SELECT q_id, chunk_id, rerank_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY rerank_score DESC, chunk_id) AS rank FROM (
  SELECT q_id, CAST(other AS VARCHAR) AS chunk_id, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))::DOUBLE, 6) AS rerank_score FROM p)) WHERE rank <= 15""")
def lexical_rerank(spark, d):
    b = table(spark, d, "benchmark")
    q = b.where("item_id % 100 = 0").select(F.col("item_id").alias("q_id"), F.col("text").alias("question"))
    pairs = vector_search.in_blocks(q, b.select(F.col("item_id").cast("string").alias("chunk_id"), "text")).where("chunk_id <> cast(q_id as string)")
    return vector_search.rerank(pairs, 15).select("q_id", "chunk_id", "rerank_score", "rank")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return fusion.rrf(dense(spark, d), graph_list(spark, d)).where("rank <= 6")


@query("hybrid_final", X.with_(["dense", "glist"], "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, chunk_id) AS rank FROM f) WHERE rank <= 6", {"f": _RRF}))
def hybrid_final(spark, d):
    return flagship(spark, d)
