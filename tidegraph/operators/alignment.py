"""Entity alignment: exact and name caches, then a cascade over the nearest entities of an index snapshot.

A batch aligns against the index as it was before the batch; equal (name, type, desc) within it get the same uid.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .vector_search import ranked, top_k


def exact_cache(entities: DataFrame) -> DataFrame:
    """entities(name, type, desc, ...) with the uid that equal triples share."""
    return entities.withColumn("uid", text.stable_id(F.col("name"), F.col("type"), F.col("desc")))


def name_cache(entities: DataFrame, floor: float | None = 0.3) -> DataFrame:
    """(ent_id, primary_id): the first entity of the same normalised name and type, if the descriptions are at least `floor` alike (None: always)."""
    keyed = entities.withColumn("key", F.concat_ws("|", text.normalize_name(F.col("name")), text.normalize_type(F.col("type"))))
    heads = keyed.groupBy("key").agg(F.min("ent_id").alias("primary_id"), F.min_by("desc", "ent_id").alias("primary_desc"))
    first = keyed.join(heads, "key")
    if floor is not None:
        alike = text.desc_similarity(F.col("desc"), F.col("primary_desc"), F.lit(None).cast("double")) >= floor
        first = first.withColumn("primary_id", F.when((F.col("ent_id") == F.col("primary_id")) | alike, F.col("primary_id")).otherwise(F.col("ent_id")))
    return first.select("ent_id", "key", "primary_id")


def candidates(entities: DataFrame, index: DataFrame, k: int = 50) -> DataFrame:
    """entities(ent_id, name, type, desc, vec) beside their k nearest of index(uid, name, type, desc, vec)."""
    near = top_k(entities.select(F.col("ent_id").alias("q_id"), F.col("vec").alias("qvec")), index.select("uid", "vec"), k, key="uid")
    near = near.select(F.col("q_id").alias("ent_id"), "uid", F.col("score").alias("cos"), "rank")
    there = index.select("uid", F.col("name").alias("i_name"), F.col("type").alias("i_type"), F.col("desc").alias("i_desc"))
    return near.join(entities.select("ent_id", "name", "type", "desc"), "ent_id").join(there, "uid")


def flagged(cand: DataFrame, ratio: float | None = 0.85) -> DataFrame:
    """Equality of names and types, and alias, of each candidate; ratio: the edit ratio above which names are aliases (None: rules alone).

    The ratio is computed only for candidates of the same type that no rule has settled.
    """
    a, b = text.name_tokens(F.col("name")), text.name_tokens(F.col("i_name"))
    out = cand.withColumns({
        "name_eq": text.normalize_name(F.col("name")) == text.normalize_name(F.col("i_name")),
        "type_eq": text.normalize_type(F.col("type")) == text.normalize_type(F.col("i_type")),
        "alias": text.alias_by_rules(a, b),
    })
    if ratio is None:
        return out
    open_ = F.col("type_eq") & ~F.col("name_eq") & ~F.col("alias")
    got = text.edit_ratio(F.when(open_, F.array_join(a, " ")), F.when(open_, F.array_join(b, " ")))
    return out.withColumn("ratio", got).withColumn("alias", F.col("alias") | (F.col("ratio") > ratio)).drop("ratio")


def cascade(cand: DataFrame, reuse_cos: float = 0.92, same_desc: float = 0.6, tau_desc: float = 0.5, ratio: float | None = 0.85) -> DataFrame:
    """(ent_id, decision, match_uid, uid, link): one candidate is chosen (exact, alias, nearest) and a ladder decides."""
    x = flagged(cand, ratio)
    order = F.when(F.col("name_eq") & F.col("type_eq"), 0).when(F.col("type_eq") & F.col("alias"), 1).otherwise(2)
    m = ranked(x.withColumn("class", order), "ent_id", [F.col("class"), F.col("rank")], 1, rank="pick")
    d = F.round(text.desc_similarity(F.col("desc"), F.col("i_desc"), F.col("cos")), 6)
    m = m.withColumn("d", d)
    decision = (
        F.when(F.col("cos") >= reuse_cos, "reuse_vector")
        .when(F.col("name_eq") & F.col("type_eq") & (F.col("d") >= same_desc), "reuse_exact")
        .when(F.col("name_eq") & F.col("type_eq"), "new_possible_same_as")
        .when(F.col("name_eq") & (text.normalize_type(F.col("type")) == "") & ~F.col("type_eq") & (F.col("d") >= tau_desc), "reuse_untyped")
        .when(F.col("type_eq") & F.col("alias"), "new_alias_of")
        .otherwise("new")
    )
    m = m.withColumn("decision", decision)
    fresh = text.stable_id(F.col("name"), F.col("type"), F.col("desc"))
    return m.select(
        "ent_id", "decision", F.col("uid").alias("match_uid"),
        F.when(F.col("decision").startswith("reuse"), F.col("uid")).otherwise(fresh).alias("uid"),
        F.when(F.col("decision") == "new_possible_same_as", "possible_same_as").when(F.col("decision") == "new_alias_of", "alias_of").alias("link"),
    )


def align(entities: DataFrame, index: DataFrame, k: int = 50, **limits) -> DataFrame:
    """A whole batch: entities(ent_id, name, type, desc, vec) with decision, aligned_uid, match_uid and link.

    Equal (name, type, desc) are one; of those with the same normalised name and type the first by ent_id stands for all, whatever
    their descriptions; it alone meets the index.  Entities without any candidate are new.
    """
    first = name_cache(entities, floor=None).select("ent_id", "primary_id")
    alone = entities.join(first.select(F.col("primary_id").alias("ent_id")).distinct(), "ent_id", "left_semi")
    got = cascade(candidates(alone, index, k), **limits)
    fresh = exact_cache(alone).select("ent_id", F.col("uid").alias("fresh"))
    chosen = fresh.join(got, "ent_id", "left").select(F.col("ent_id").alias("primary_id"), "fresh", F.coalesce("decision", F.lit("new")).alias("decision"), F.coalesce("uid", "fresh").alias("aligned_uid"), "match_uid", "link")
    out = entities.join(first, "ent_id").join(chosen, "primary_id")
    cached = (F.col("ent_id") != F.col("primary_id")) & (text.stable_id(F.col("name"), F.col("type"), F.col("desc")) != F.col("fresh"))
    out = out.withColumn("link", F.when(~cached, F.col("link"))).withColumn("decision", F.when(cached, "cached").otherwise(F.col("decision")))
    return out.drop("primary_id", "fresh")


def extended(index: DataFrame, aligned: DataFrame) -> DataFrame:
    """The index with the new entities of an aligned batch: what the next batch meets."""
    new = aligned.where(F.col("decision").startswith("new")).select(F.col("aligned_uid").alias("uid"), "name", "type", "desc", "vec").dropDuplicates(["uid"])
    return index.select("uid", "name", "type", "desc", "vec").unionByName(new.join(index.select("uid"), "uid", "left_anti"))


def link_edges(aligned: DataFrame) -> DataFrame:
    """Edges between a new entity and the one it may be; no chunk stands behind them."""
    return aligned.where("link is not null").select(F.col("aligned_uid").alias("src"), F.col("match_uid").alias("dst"), F.col("link").alias("relation"), F.lit(None).cast("string").alias("source_chunk")).distinct()
