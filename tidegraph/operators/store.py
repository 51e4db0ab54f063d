"""The tables that stay: upserts, versions, exports, statistics, and the modelled footprint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import stable_id


def upsert(old: DataFrame, new: DataFrame, key: list[str], seq: str = "write_seq") -> DataFrame:
    """The last write of each key by seq; rows of `old` are older than any of `new`."""
    both = old.withColumn(seq, F.lit(-1).cast("bigint")).unionByName(new.withColumn(seq, F.col(seq).cast("bigint")))
    rest = [c for c in both.columns if c not in (*key, seq)]
    if not rest:  # nothing to choose from, so nothing is sorted
        return both.groupBy(*key).agg(F.max(seq).alias(seq)).select(*both.columns)
    w = Window.partitionBy(*key).orderBy(F.desc(seq), *[F.col(c) for c in rest])
    return both.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def next_version(spark: SparkSession, path: str) -> int:
    """One more than the largest version=N folder of a table."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return 1
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    return 1 + max([0, *(int(n.split("=")[1]) for n in names if n.startswith("version=") and n.split("=")[1].isdigit())])


def save_version(df: DataFrame, path: str) -> int:
    """Write a new version beside those that may still be read; none is ever overwritten."""
    n = next_version(df.sparkSession, path)
    df.write.parquet(f"{path}/version={n}")
    return n


def load_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    return spark.read.parquet(f"{path}/version={version or next_version(spark, path) - 1}")


def append_absent(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of `new` whose key `old` lacks, one for each key."""
    return new.dropDuplicates(key).join(old.select(*key).distinct(), key, "left_anti")


def merge_results(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Result files of batches as one table; a missing file is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(paths)


#: The properties that a vertex keeps.
VERTEX_PROPS = ("name", "type", "source_chunk")


def upsert_vertices(old: DataFrame, new: DataFrame, seq: str = "write_seq") -> DataFrame:
    """old(vid, name, type, source_chunk) after the writes of new(vid, write_seq, ...): only known properties, quotes to blanks; a null leaves what is there."""
    props = [c for c in VERTEX_PROPS if c in new.columns]
    last = new.groupBy("vid").agg(*[F.max_by(F.translate(c, '"', " "), F.when(F.col(c).isNotNull(), F.col(seq))).alias(f"__{c}") for c in props])
    both = old.join(last, "vid", "full_outer")
    return both.select("vid", *[F.coalesce(f"__{c}", c).alias(c) if c in props else F.col(c) for c in VERTEX_PROPS])


def upsert_triplets(vertices: DataFrame, edges: DataFrame, trips: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both ends (vid, name) and the edge (src, dst, relation) of trips(head, relation, tail) written; a name's id is its hash."""
    vid = lambda c: stable_id(F.col(c))
    ends = trips.select(F.explode(F.array("head", "tail")).alias("name")).distinct().select(vid("name").alias("vid"), "name", F.lit(0).alias("write_seq"))
    own = trips.select(vid("head").alias("src"), vid("tail").alias("dst"), "relation").distinct().withColumn("write_seq", F.lit(0))
    return upsert(vertices, ends, ["vid"]).drop("write_seq"), upsert(edges, own, ["src", "dst", "relation"]).drop("write_seq")


CHUNK_COLUMNS = "chunk_id string, text string, vec array<double>, entity_uids array<bigint>, graph_meta struct<entities:array<struct<uid:bigint,name:string,type:string,desc:string>>,relations:array<struct<src_uid:bigint,tgt_uid:bigint,relation:string>>>, ts string, pk bigint"
FACT_COLUMNS = ("fact_text", "subj_name", "obj_name", "relation", "chunk_id", "subj_uid", "obj_uid", "vec")


def append_chunks(chunks: DataFrame, path: str, now: Column | None = None) -> None:
    """Chunk rows with their key (a hash of chunk_id) and the UTC time of writing, appended to the table at path."""
    ts = F.date_format(F.to_utc_timestamp(now if now is not None else F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows = chunks.withColumn("ts", F.coalesce("ts", ts) if "ts" in chunks.columns else ts).withColumn("pk", stable_id(F.col("chunk_id")))
    rows.select(*[c.strip().split(" ")[0] for c in CHUNK_COLUMNS.replace("struct<entities:array<struct<uid:bigint,name:string,type:string,desc:string>>,relations:array<struct<src_uid:bigint,tgt_uid:bigint,relation:string>>>", "s").split(",")]).write.mode("append").parquet(path)


def append_facts(facts: DataFrame, path: str) -> None:
    facts.select(*FACT_COLUMNS, stable_id(F.col("fact_text"), F.col("chunk_id")).alias("pk")).write.mode("append").parquet(path)


def append_entities(index_path: str, entities: DataFrame) -> None:
    """New rows (uid, name, type, desc, vec) of the entity index; those whose uid it has stay out."""
    spark = entities.sparkSession
    new = entities.select("uid", "name", "type", "desc", "vec").dropDuplicates(["uid"])
    at = spark._jvm.org.apache.hadoop.fs.Path(index_path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        new = new.join(spark.read.parquet(index_path).select("uid"), "uid", "left_anti")
    new.write.mode("append").parquet(index_path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a line."""
    df.write.json(path)


def export_triplets(edges: DataFrame, path: str) -> None:
    write_json(edges.select(F.col("src").alias("head"), "relation", F.col("dst").alias("tail")).distinct(), path)


def graph_stats(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    return vertices.agg(F.count("*").alias("nodes")).withColumn("edges", edges.agg(F.count("*")).scalar())


def schema_summary(edges: DataFrame, kinds: DataFrame) -> DataFrame:
    """How many edges of each relation lead from one type to another."""
    a, b = kinds.select(F.col("uid").alias("src"), F.col("type").alias("src_type")), kinds.select(F.col("uid").alias("dst"), F.col("type").alias("dst_type"))
    return edges.join(a, "src").join(b, "dst").groupBy("src_type", "relation", "dst_type").agg(F.count("*").alias("edges"))


def footprint(nodes: int | str, edges: int | str, vectors: int | str, dim: int, c_max: int = 100) -> dict:
    """Modelled bytes of the tiers: 100 a node and 50 an edge, 4.57 times that on disk; 4 a vector component, the index 1.5 times; and how often the hot tier's bound fits into the persistent graph."""
    n, e, v = (F.expr(str(x)) for x in (nodes, edges, vectors))
    logical, data = (n * 100 + e * 50).cast("double"), (v * dim * 4).cast("double")
    l1 = c_max * 5 * 200 + c_max * 5 * 100
    return {"ratio": F.round(logical * 4.57 / l1, 4), "l2_logical": logical, "l2_disk": F.round(logical * 4.57, 2), "vector_data": data, "vector_index": F.round(data * 1.5, 2), "l1_bound": F.lit(float(l1))}


def unexpired(rows: DataFrame, ts: str, now, days: int = 14) -> DataFrame:
    """Rows written within the last `days` before now."""
    return rows.where(F.col(ts).cast("timestamp") > now - F.make_dt_interval(F.lit(days)))
