"""Lookups by id, of one row or of many at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def one(rows: DataFrame, key: str, value, fields: list[str], limit: int = 1) -> DataFrame:
    """Fields of the rows whose key is `value`; the filter reaches the scan."""
    return rows.where(F.col(key) == value).select(*fields).limit(limit)


def chunk_parts(ids: DataFrame, chunks: DataFrame, counts: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(chunk_id, text, ts, entity_uids, entities, relations, *keep) of ids(chunk_id); what a chunk or the table lacks is empty.

    counts: lengths in place of the lists, taken before anything is dealt out; keep: further columns as they are.
    """
    meta = "struct<entities:array<struct<uid:bigint,name:string,type:string,desc:string>>,relations:array<struct<src_uid:bigint,tgt_uid:bigint,relation:string>>>"
    have = lambda name, kind: F.col(name).cast(kind) if name in chunks.columns else F.lit(None).cast(kind)
    there = chunks.select("chunk_id", have("text", "string").alias("text"), have("ts", "string").alias("ts"), have("entity_uids", "array<bigint>").alias("uids"), have("graph_meta", meta).alias("meta"), *keep)
    empty = F.array().cast
    if counts:
        size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
        there = there.select("chunk_id", "text", "ts", size("uids").alias("entity_uids"), size("meta.entities").alias("entities"), size("meta.relations").alias("relations"), *keep)
        return ids.select("chunk_id").join(there, "chunk_id", "left").fillna("", ["text", "ts"]).fillna(0, ["entity_uids", "entities", "relations"])
    return ids.select("chunk_id").join(there, "chunk_id", "left").select(
        "chunk_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("ts", F.lit("")).alias("ts"), F.coalesce("uids", empty("array<bigint>")).alias("entity_uids"),
        F.coalesce("meta.entities", empty("array<struct<uid:bigint,name:string,type:string,desc:string>>")).alias("entities"),
        F.coalesce("meta.relations", empty("array<struct<src_uid:bigint,tgt_uid:bigint,relation:string>>")).alias("relations"), *keep,
    )


def texts_in_order(lists: DataFrame, chunks: DataFrame, ids: str = "ids") -> DataFrame:
    """lists(q_id, ids) with `texts`: a text for each id in the order given, '' for those that aren't there."""
    flat = lists.select("q_id", F.posexplode(ids).alias("pos", "chunk_id")).join(chunks.select("chunk_id", "text"), "chunk_id", "left")
    back = flat.groupBy("q_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("text", F.lit("")).alias("t")))), lambda s: s["t"]).alias("texts"))
    return lists.join(back, "q_id", "left").withColumn("texts", F.coalesce("texts", F.array().cast("array<string>")))


def node_props(ids: DataFrame, vertices: DataFrame, props: list[str]) -> DataFrame:
    """Properties of the vertices of ids(vid) that are there."""
    return vertices.join(ids.select("vid").distinct(), "vid", "left_semi").select("vid", *props)


def accumulated(rows: DataFrame, by: str, value: Column, order: str) -> DataFrame:
    """(by, values): all values of a key in order."""
    return rows.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v")))), lambda s: s["v"]).alias("values"))
