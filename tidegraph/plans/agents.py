"""Extraction, cached answers, answering and the multi-step loop."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import answer, ingest
from ..sources import chunking
from .registry import query, table

_NAMES = r"list_filter(l, lambda x, i: list_position(l, x) = i)"
_CAPS = r"""list_filter(list_transform(list_filter(regexp_split_to_array({c}, '\s+'), lambda t: t <> ''), lambda t: regexp_replace(t, '^[.,:;!?()\[\]{{}}"]+|[.,:;!?()\[\]{{}}"]+$', '', 'g')), lambda t: length(t) >= 3 AND regexp_matches(t, '^\p{{Lu}}'))"""

@query("rule_extraction", f"SELECT item_id, array_to_string({_NAMES}, '|') AS names, CAST(greatest(len({_NAMES}) - 1, 0) AS BIGINT) AS relations FROM (SELECT item_id, {_CAPS.format(c='text')} AS l FROM benchmark)")
def rule_extraction(spark, d):
    b = table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("chunk_id"), "text")
    got = ingest.rule_extractor(b)
    return got.select(F.col("chunk_id").cast("bigint").alias("item_id"), F.array_join(F.transform("entities", lambda e: e["id"]), "|").alias("names"), F.size("relations").cast("bigint").alias("relations"))


@query("ingest_graph", rf"""SELECT doc_id, count(DISTINCT n) AS nodes, count(*) AS mentions FROM (SELECT doc_id, seq, unnest({_NAMES}) AS n FROM (SELECT doc_id, seq, {_CAPS.format(c="substr(text, seq * 700 + 1, 800)")} AS l FROM (
  SELECT doc_id, text, unnest(range(CAST(greatest(1, ceil((length(text) - 100) / 700.0)) AS BIGINT))) AS seq FROM documents WHERE length(text) > 0))) GROUP BY doc_id""")
def ingest_graph(spark, d):
    # a chunk is named with its document: ids of chunks are 48 bits of a hash, equal for rows of one doc_id and by chance for others, so none is joined back by it
    chunks = chunking.fixed(table(spark, d, "documents")).select(F.struct("doc_id", "chunk_id").alias("chunk_id"), "text")
    mentions, _ = ingest.build(chunks)
    return mentions.groupBy("chunk_id.doc_id").agg(F.count_distinct("name").alias("nodes"), F.count("*").alias("mentions"))


@query("llm_cache_join", "SELECT conv_id, turn, md5(text) IN (SELECT md5(text) FROM conversations WHERE turn = 0) AS cached FROM conversations")
def llm_cache_join(spark, d):
    c = table(spark, d, "conversations")
    cache = c.where("turn = 0").select(F.md5("text").alias("key"), F.col("role").alias("response"))
    return ingest.answered_before(c.withColumnRenamed("text", "prompt"), cache).select("conv_id", "turn", F.col("response").isNotNull().alias("cached"))


_QW = lambda c: rf"list_distinct(list_filter(regexp_split_to_array(lower(regexp_replace({c}, '[^A-Za-z0-9\s]', ' ', 'g')), '\s+'), lambda t: t <> ''))"


@query("answer_best_sentence", rf"""SELECT q_id, answer, overlap FROM (SELECT q.q_id, coalesce(b.s, 'I don''t know.') AS answer, coalesce(b.overlap, 0) AS overlap FROM q LEFT JOIN (SELECT * FROM (
  SELECT q_id, s, overlap, row_number() OVER (PARTITION BY q_id ORDER BY overlap DESC, rank, pos) AS r FROM (SELECT q.q_id, trim(p.s) AS s, p.rank, p.pos, len(list_intersect({_QW('q.question')}, {_QW('trim(p.s)')})) AS overlap FROM q JOIN p ON q.q_id = p.q_id WHERE trim(p.s) <> '')) WHERE r = 1 AND overlap > 0) b ON q.q_id = b.q_id)""".replace("SELECT q_id, answer", r"""WITH q AS (SELECT conv_id AS q_id, text AS question FROM conversations WHERE role = 'user' AND (conv_id, turn) IN (SELECT (conv_id, min(turn)) FROM conversations WHERE role = 'user' GROUP BY conv_id)),
p AS (SELECT q_id, rank, unnest(range(len(l))) AS pos, unnest(l) AS s FROM (SELECT conv_id AS q_id, turn AS rank, regexp_split_to_array(text, '[.\n]') AS l FROM conversations WHERE role = 'assistant'))
SELECT q_id, answer""", 1))
def answer_best_sentence(spark, d):
    c = table(spark, d, "conversations")
    first = c.where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("question"))
    context = c.where("role = 'assistant'").select(F.col("conv_id").alias("q_id"), "text", F.col("turn").alias("rank"))
    return answer.best_sentence(first.withColumnRenamed("conv_id", "q_id"), context)


@query("agentic_rounds")
def agentic_rounds(spark, d):
    c = table(spark, d, "conversations")
    first = c.where("role = 'user'").groupBy(F.col("conv_id").alias("q_id")).agg(F.min_by("text", "turn").alias("question"))
    context = c.where("role = 'assistant'").select(F.col("conv_id").alias("q_id"), "text", F.col("turn").alias("rank"))
    return answer.agentic(first, lambda q: context.join(q.select("q_id"), "q_id", "left_semi"))


@query("run_summary", "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total, round(avg(value), 4) AS mean, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def run_summary(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"), F.round(F.avg("value"), 4).alias("mean"), F.count_distinct("user_id").alias("users"))
