"""Documents to graph: chunks, rule-based extraction in place of a model, nodes and edges with their chunks.

An extractor is any function from chunks(chunk_id, text) to (chunk_id, entities, relations); a remote model would be one over
mapInPandas.  Answers of models are kept by the md5 of their prompt and joined back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

def capitalised(c: Column) -> Column:
    """Distinct capitalised words of three characters or more, without marks at their ends, in order."""
    return F.array_distinct(F.filter(text.bare_words(c), lambda t: (F.length(t) >= 3) & t.rlike(r"^\p{Lu}")))


def rule_extractor(chunks: DataFrame) -> DataFrame:
    """Entities are capitalised words; each is NEXT_TO the one that follows it."""
    names = chunks.select("chunk_id", capitalised(F.col("text")).alias("names"))
    entities = F.transform("names", lambda n: F.struct(n.alias("id"), F.lit("term").alias("type"), F.lit("").alias("desc")))
    pairs = F.when(F.size("names") > 1, F.zip_with(F.slice("names", 1, F.size("names") - 1), F.slice("names", 2, F.size("names")), lambda a, b: F.struct(a.alias("src"), b.alias("tgt"), F.lit("NEXT_TO").alias("rel"))))
    return names.select("chunk_id", entities.alias("entities"), F.coalesce(pairs, F.array().cast("array<struct<src:string,tgt:string,rel:string>>")).alias("relations"))


def build(chunks: DataFrame, extractor: Callable[[DataFrame], DataFrame] = rule_extractor) -> tuple[DataFrame, DataFrame]:
    """mentions(chunk_id, uid, name, type, desc) and edges(src, dst, relation, source_chunk) of chunks."""
    got = extractor(chunks)
    uid = lambda n: text.stable_id(text.normalize_name(n), F.lit("term"))
    mentions = got.select("chunk_id", F.explode("entities").alias("e")).select("chunk_id", uid(F.col("e.id")).alias("uid"), F.col("e.id").alias("name"), "e.type", "e.desc")
    edges = got.select("chunk_id", F.explode("relations").alias("r")).select(uid(F.col("r.src")).alias("src"), uid(F.col("r.tgt")).alias("dst"), F.col("r.rel").alias("relation"), F.col("chunk_id").alias("source_chunk"))
    return mentions, edges.distinct()


def aligned_graph(extracted: DataFrame, uids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """mentions(chunk_id, uid, name, type, desc) and edges of extracted(chunk_id, entities, relations) by aligned uids(name, type, desc, uid).

    A name that a chunk lists twice is the last of its entries.  Relations need both ends among the chunk's entities, and a label.
    """
    listed = extracted.select("chunk_id", F.posexplode("entities").alias("pos", "e")).select("chunk_id", "pos", F.col("e.id").alias("name"), "e.type", "e.desc")
    last = listed.groupBy("chunk_id", "name").agg(F.max_by(F.struct("type", "desc"), "pos").alias("e")).select("chunk_id", "name", "e.type", "e.desc")
    there = uids.select(F.col("name").alias("__n"), F.col("type").alias("__t"), F.col("desc").alias("__d"), "uid").dropDuplicates(["__n", "__t", "__d"])
    on = F.col("name").eqNullSafe(F.col("__n")) & F.col("type").eqNullSafe(F.col("__t")) & F.col("desc").eqNullSafe(F.col("__d"))
    mentions = last.join(there, on).select("chunk_id", "uid", "name", "type", "desc")
    ends = mentions.select("chunk_id", "name", "uid")
    rel = extracted.select("chunk_id", F.explode("relations").alias("r")).select("chunk_id", "r.src", "r.tgt", "r.rel").where((F.coalesce("src", F.lit("")) != "") & (F.coalesce("tgt", F.lit("")) != "") & (F.coalesce("rel", F.lit("")) != ""))
    a = ends.select("chunk_id", F.col("name").alias("src"), F.col("uid").alias("src_uid"))
    b = ends.select("chunk_id", F.col("name").alias("tgt"), F.col("uid").alias("dst_uid"))
    edges = rel.join(a, ["chunk_id", "src"]).join(b, ["chunk_id", "tgt"])
    return mentions, edges.select(F.col("src_uid").alias("src"), F.col("dst_uid").alias("dst"), F.col("rel").alias("relation"), F.col("chunk_id").alias("source_chunk"), F.col("src").alias("src_name"), F.col("tgt").alias("dst_name"))


def facts(edges: DataFrame) -> DataFrame:
    """(fact_text, subj_name, obj_name, relation, chunk_id, subj_uid, obj_uid) of aligned edges."""
    return edges.select(text.fact_text(F.col("src_name"), F.col("relation"), F.col("dst_name")).alias("fact_text"), F.col("src_name").alias("subj_name"), F.col("dst_name").alias("obj_name"), "relation", F.col("source_chunk").alias("chunk_id"), F.col("src").alias("subj_uid"), F.col("dst").alias("obj_uid")).distinct()


def graph_meta(mentions: DataFrame, edges: DataFrame) -> DataFrame:
    """(chunk_id, entity_uids, graph_meta) that a chunk is stored with, and rebuilt from."""
    e = mentions.groupBy("chunk_id").agg(F.array_sort(F.collect_set(F.struct("uid", "name", "type", "desc"))).alias("entities"))
    r = edges.groupBy(F.col("source_chunk").alias("chunk_id")).agg(F.array_sort(F.collect_set(F.struct(F.col("src").alias("src_uid"), F.col("dst").alias("tgt_uid"), "relation"))).alias("relations"))
    none = F.array().cast("array<struct<src_uid:bigint,tgt_uid:bigint,relation:string>>")
    return e.join(r, "chunk_id", "left").select("chunk_id", F.array_sort(F.array_distinct(F.transform("entities", lambda x: x["uid"]))).alias("entity_uids"), F.struct("entities", F.coalesce("relations", none).alias("relations")).alias("graph_meta"))


def index_batch(chunks: DataFrame, index: DataFrame, embed: Callable[[Column], Column], extractor: Callable[[DataFrame], DataFrame] = rule_extractor, **limits) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One batch of chunks(chunk_id, text) against an entity index: (mentions, edges, index for the next batch).

    Each distinct (name, type, desc) is embedded and aligned once; links between entities that may be the same come as edges without a chunk.
    """
    from .alignment import align, extended, link_edges

    got = extractor(chunks)
    names = got.select(F.explode("entities").alias("e")).select(F.col("e.id").alias("name"), "e.type", "e.desc").distinct()
    batch = names.select(text.stable_id(F.col("name"), F.col("type"), F.col("desc")).alias("ent_id"), "name", "type", "desc", embed(text.entity_text(F.col("name"), F.col("type"), F.col("desc"))).alias("vec"))
    done = align(batch, index, **limits)
    mentions, edges = aligned_graph(got, done.withColumnRenamed("aligned_uid", "uid"))
    links = link_edges(done).select("src", "dst", "relation", "source_chunk", F.lit(None).cast("string").alias("src_name"), F.lit(None).cast("string").alias("dst_name"))
    return mentions, edges.unionByName(links), extended(index, done)


def answered_before(prompts: DataFrame, cache: DataFrame) -> DataFrame:
    """prompts with the cached response (null where there is none); cache(key, response), key is md5 of the prompt."""
    return prompts.join(cache.select("key", "response").dropDuplicates(["key"]), F.md5("prompt") == F.col("key"), "left").drop("key")
