"""Access streams: counts, promotion at the tau-th hit, windows, deduplication, and ingestion in versions.

Each function takes a streaming DataFrame; `run` drives a query to the end of what is there (availableNow) and returns
its result.  Append mode withholds windows that the last watermark hasn't closed; what is compared with a batch uses update
or complete output.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import cache, store
from ..session import checkpoints


def source(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table as a stream: a folder, or the one file that a folder holds under that name."""
    schema = spark.read.parquet(path).schema
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        return reader.option("pathGlobFilter", at.getName()).parquet(path.rsplit("/", 1)[0])
    return reader.parquet(path)


def events(spark: SparkSession, path: str) -> DataFrame:
    """The events table as a stream; ts becomes a timestamp, as watermarks need."""
    return source(spark, path).withColumn("ts", F.col("ts").cast("timestamp"))


def folder(spark: SparkSession) -> str:
    """A new folder beside the session's checkpoints."""
    return f"{checkpoints(spark)}/stream-{uuid.uuid4().hex}"


def run(stream: DataFrame, mode: str, key: list[str] | None = None) -> DataFrame:
    """The final rows: of complete output the last batch's, of update output the last of each key, of append output all."""
    spark, at = stream.sparkSession, folder(stream.sparkSession)

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("__batch", F.lit(number)).write.mode("overwrite").parquet(f"{at}/out/batch={number}")  # a batch that runs again writes the same folder

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    rows = spark.read.parquet(f"{at}/out").drop("batch")
    if mode == "complete":
        return rows.where(F.col("__batch") == rows.agg(F.max("__batch")).scalar()).drop("__batch")
    if mode == "update" and key:
        return store.upsert(rows.drop("__batch").limit(0), rows.withColumnRenamed("__batch", "write_seq"), key).drop("write_seq")
    return rows.drop("__batch")


def access_counts(stream: DataFrame, key: str = "chunk_id") -> DataFrame:
    return stream.groupBy(key).agg(F.count("*").alias("hits"))


def promotions(stream: DataFrame, tau_hit: int = 3) -> DataFrame:
    """(chunk_id, hits, event_id) once for each chunk, when its count reaches tau_hit; the count is kept as state."""

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count = state.get[0] if state.exists else 0
        own = pd.concat(batches).sort_values(["ts", "event_id"])
        if count < tau_hit <= count + len(own):
            yield pd.DataFrame({"chunk_id": [key[0]], "hits": [tau_hit], "event_id": [own["event_id"].iloc[tau_hit - count - 1]]})
        state.update((count + len(own),))

    return stream.select("chunk_id", "ts", "event_id").groupBy("chunk_id").applyInPandasWithState(advance, "chunk_id string, hits long, event_id long", "n long", "append", GroupStateTimeout.NoTimeout)


def tumbling(stream: DataFrame, width: str = "1 day", late: str = "1 day", kind: str = "event_type") -> DataFrame:
    out = stream.withWatermark("ts", late).groupBy(F.window("ts", width), kind).agg(F.count("*").alias("n"))
    return out.select(F.unix_seconds("window.start").alias("start"), kind, "n")


def sessions(stream: DataFrame, gap: str = "6 hours", late: str = "1 day", user: str = "user_id") -> DataFrame:
    out = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), user).agg(F.count("*").alias("n"))
    return out.select(F.unix_micros("session_window.start").alias("start"), user, "n")


def first_seen(stream: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def ingest(stream: DataFrame, path: str, build: Callable[[DataFrame], DataFrame]) -> None:
    """Each micro-batch through build(batch) into a version of the table at path, named by the batch, so that a repeat overwrites only itself."""

    def write(batch: DataFrame, number: int) -> None:
        build(batch).write.mode("overwrite").parquet(f"{path}/version={number + 1}")

    stream.writeStream.option("checkpointLocation", f"{path}/_state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()


def pruned(stream: DataFrame, path: str, now: Column, ttl_s: int, c_max: int) -> None:
    """After each micro-batch of accesses the resident chunks' state is a new version at path, within capacity and idle time."""

    def prune(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        own = cache.chunk_state(batch)
        if number:
            both = spark.read.parquet(f"{path}/version={number}").select(*own.columns).unionByName(own)
            own = both.groupBy("chunk_id").agg(F.min("created_at").alias("created_at"), F.max("last_access").alias("last_access"), F.sum("hits").alias("hits"))
        cache.prune(own, now, ttl_s, c_max).write.mode("overwrite").parquet(f"{path}/version={number + 1}")

    stream.writeStream.option("checkpointLocation", f"{path}/_state").trigger(availableNow=True).foreachBatch(prune).start().awaitTermination()


def driven(batches: int, ingest: Callable[[int], None], answer: Callable[[int], None], odd_only: bool = False, noise: Callable[[int], None] | None = None) -> list[int]:
    """Batches 1..n in turn: each is ingested, then answered; with odd_only the even ones aren't, and take noise documents instead. The numbers answered."""
    done = []
    for number in range(1, batches + 1):
        ingest(number)
        if not odd_only or number % 2:
            answer(number)
            done.append(number)
        elif noise is not None:
            noise(number)
    return done
