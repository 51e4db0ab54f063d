"""The knowledge graph as tables: mentions(chunk_id, uid, name, type, desc, seq) and edges(src, dst, relation, source_chunk)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..session import checkpoints
from .vector_search import ranked

EDGE = ["src", "dst", "relation", "source_chunk"]
FEW = 1_000_000  # ids that are broadcast at most, some 16 bytes each


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by checkpoint(), in the folder of spark.checkpoint.dir."""
    checkpoints(df.sparkSession)
    return df.checkpoint()


def among(nodes: DataFrame) -> DataFrame:
    """Distinct rows of a column of ids, to keep only what belongs to them before anything is dealt out; broadcast where they are few."""
    ids = cut(nodes.distinct())
    return F.broadcast(ids) if ids.count() <= FEW else ids


def merge_nodes(mentions: DataFrame) -> DataFrame:
    """One row for each uid: the first non-empty name, type and desc by seq, its chunks and how many they are."""
    first = lambda c: F.coalesce(F.min_by(F.col(c), F.when(F.col(c) != "", F.col("seq"))), F.lit("")).alias(c)
    chunk = F.nullif(F.col("chunk_id"), F.lit(""))
    found = mentions.groupBy("uid").agg(first("name"), first("type"), first("desc"), F.array_sort(F.collect_set(chunk)).alias("source_chunks"))
    # counted apart, so that names and descriptions aren't sorted by chunk
    counts = mentions.select(F.col("uid").alias("__uid"), chunk.alias("c")).distinct().groupBy("__uid").agg(F.count("c").alias("ref_count"))
    return found.join(counts, F.col("uid").eqNullSafe(F.col("__uid"))).drop("__uid")


def merge_edges(edges: DataFrame) -> DataFrame:
    return edges.select(*EDGE).dropDuplicates(EDGE)


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge from both of its ends; a loop twice."""
    return edges.select("src", "dst", "relation", "source_chunk").unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "relation", "source_chunk"))


def one_hop(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(q_id, uid, neighbour, relation, source_chunk) over edges in either direction."""
    e = both_ways(edges)
    return seeds.join(e, seeds.uid == e.src).select("q_id", "uid", F.col("dst").alias("neighbour"), "relation", "source_chunk")


def triplets(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("head"), "relation", F.col("dst").alias("tail")).distinct()


def entities_of(trips: DataFrame) -> DataFrame:
    return trips.select(F.col("head").alias("entity")).union(trips.select("tail")).distinct()


def chunk_subgraph(chunks: DataFrame, mentions: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (chunk_id, uid) and edges of chosen chunks: listed entities and both ends of the chunk's edges."""
    own = edges.join(chunks.select(F.col("chunk_id").alias("source_chunk")), "source_chunk", "left_semi")
    listed = mentions.join(chunks.select("chunk_id"), "chunk_id", "left_semi").select("chunk_id", "uid")
    ends = own.select(F.col("source_chunk").alias("chunk_id"), F.explode(F.array("src", "dst")).alias("uid"))
    return listed.union(ends).distinct(), own.select(*EDGE).distinct()


def rehydrate(hits: DataFrame, resident: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mentions and edges of hit chunks that no tier holds, rebuilt from their stored graph_meta; relations lacking an end or a label are skipped."""
    missing = hits.select("chunk_id").distinct().join(resident.select("chunk_id").distinct(), "chunk_id", "left_anti")
    meta = chunks.join(missing, "chunk_id", "left_semi")
    mentions = meta.select("chunk_id", F.explode("graph_meta.entities").alias("e")).select("chunk_id", "e.*")
    relations = meta.select("chunk_id", F.explode("graph_meta.relations").alias("r")).select(F.col("r.src").alias("src"), F.col("r.tgt").alias("dst"), F.col("r.rel").alias("relation"), F.col("chunk_id").alias("source_chunk"))
    return mentions, relations.where(F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.coalesce("relation", F.lit("")) != ""))


def coverage(hits: DataFrame) -> DataFrame:
    """(q_id, chunk_id, entities, n_entities) from hits(q_id, ent_id, chunk_id) of either tier."""
    return hits.groupBy("q_id", "chunk_id").agg(F.array_sort(F.collect_set("ent_id")).alias("entities"), F.count_distinct("ent_id").alias("n_entities"))


def paths(seeds: DataFrame, edges: DataFrame, depth: int = 2, limit: int | None = None) -> DataFrame:
    """(uid, path, hops): edge-distinct walks of 1..depth edges in either direction, as text "a -r-> b <-s- c".

    limit: so many of each uid, shorter ones first, then by text (a graph store takes any); of each length no more
    than that are carried on to the result.
    """
    e = edges.select("src", "dst", "relation")
    away = e.select(F.col("src").alias("a"), F.col("dst").alias("b"), "relation", F.lit(True).alias("ahead")).unionAll(e.select(F.col("dst").alias("a"), F.col("src").alias("b"), "relation", F.lit(False).alias("ahead")))
    sign = lambda left, right: F.when(F.col("ahead"), left).otherwise(right)
    eid = F.concat_ws("|", sign(F.col("a"), F.col("b")), "relation", sign(F.col("b"), F.col("a")))
    t = F.concat(sign(F.lit(" -"), F.lit(" <-")), "relation", sign(F.lit("-> "), F.lit("- ")), F.col("b").cast("string"))
    now = seeds.select("uid", F.col("uid").alias("at"), F.col("uid").cast("string").alias("path"), F.array().cast("array<string>").alias("used"))
    out = None
    for hop in range(1, depth + 1):
        # only the edges at nodes reached are made distinct and spelt out
        step = away.join(among(now.select(F.col("at").alias("a"))), "a", "left_semi").distinct().select("a", "b", t.alias("t"), eid.alias("eid"))
        now = now.join(step, now["at"] == step["a"]).where(~F.array_contains("used", F.col("eid"))).select("uid", F.col("b").alias("at"), F.concat("path", "t").alias("path"), F.concat("used", F.array("eid")).alias("used"))
        now = cut(now) if hop < depth else now
        found = now.select("uid", "path", F.lit(hop).cast("bigint").alias("hops"))
        if limit:
            found = ranked(found, "uid", [F.col("path")], limit).drop("rank")
        out = found if out is None else out.unionAll(found)
        if limit and hop < depth:
            # who has so many already gets none of the longer ones
            full = out.groupBy("uid").agg(F.count("*").alias("n")).where(F.col("n") >= limit)
            now = cut(now.join(full.select("uid"), "uid", "left_anti"))
    return ranked(out, "uid", [F.col("hops"), F.col("path")], limit).drop("rank") if limit else out


def path_map(found: DataFrame) -> DataFrame:
    """(uid, paths): the paths of each subject; meant for paths() with a limit."""
    return found.groupBy("uid").agg(F.array_sort(F.collect_list("path")).alias("paths"))


def sequences(mapped: DataFrame) -> DataFrame:
    return mapped.select(F.explode("paths").alias("path")).distinct()


def triples_of(found: DataFrame) -> DataFrame:
    """(path, head, relation, tail): the triples that path texts spell."""
    return found.select("path", F.explode(text.path_triples(F.col("path"))).alias("t")).select("path", "t.*")


def entities_by_path(found: DataFrame) -> DataFrame:
    """(path, entities): the ends of a path's triples."""
    return found.select("path").distinct().select("path", F.array_sort(F.array_distinct(F.flatten(F.transform(text.path_triples(F.col("path")), lambda t: F.array(t["head"], t["tail"]))))).alias("entities"))


def delete_triplet(edges: DataFrame, vertices: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges without those of gone(src, dst, relation); vertices without the touched ends that no edge reaches any more."""
    left = edges.join(gone, ["src", "dst", "relation"], "left_anti")
    touched = gone.select(F.explode(F.array("src", "dst")).alias("vid")).distinct()
    alive = left.select(F.explode(F.array("src", "dst")).alias("vid")).distinct()
    return left, vertices.join(touched.join(alive, "vid", "left_anti"), "vid", "left_anti")
