"""Streams run to their end, against batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import chunking
from ..streaming import access
from .registry import query


def _log(spark, d):
    e = access.events(spark, f"{d}/events.parquet")
    return e.withColumn("chunk_id", F.concat(F.lit("chunk_"), (F.col("event_id") % 200).cast("string")))


@query("stream_access_count", "SELECT 'chunk_' || (event_id % 200) AS chunk_id, count(*) AS hits FROM events GROUP BY ALL")
def stream_access_count(spark, d):
    return access.run(access.access_counts(_log(spark, d)), "complete")


@query("stream_promote", "SELECT 'chunk_' || (event_id % 200) AS chunk_id, CAST(3 AS BIGINT) AS hits FROM events GROUP BY ALL HAVING count(*) >= 3")
def stream_promote(spark, d):
    return access.run(access.promotions(_log(spark, d)), "append").select("chunk_id", "hits")


@query("stream_tumbling", "SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_tumbling(spark, d):
    return access.run(access.tumbling(_log(spark, d)), "update", ["start", "event_type"])


@query("stream_session", """SELECT epoch_us(min(ts)) AS start, user_id, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
  SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""")
def stream_session(spark, d):
    return access.run(access.sessions(_log(spark, d)), "complete")


@query("stream_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark, d):
    return access.run(access.first_seen(_log(spark, d), ["user_id", "event_type"]), "append").select("user_id", "event_type").distinct()


@query("stream_ingest", """SELECT doc_id, count(*) AS chunks FROM (SELECT doc_id, unnest(range(CAST(greatest(1, ceil((length(text) - 100) / 700.0)) AS BIGINT))) AS seq FROM documents WHERE length(text) > 0) GROUP BY doc_id""")
def stream_ingest(spark, d):
    docs = access.source(spark, f"{d}/documents.parquet")
    out = access.folder(spark)
    access.ingest(docs, out, chunking.fixed)
    return spark.read.parquet(out).groupBy("doc_id").agg(F.count("*").alias("chunks"))
