"""Helpers that several operators share: packed columns, shared folders, batches, components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoints, ship

#: Rows and bytes of one Arrow batch that a Python worker gets: bounds its memory when texts are long.
BATCH_ROWS, BATCH_BYTES = 256, 8 << 20

_PACK, _CLOSE, _UNPACK = zstandard.ZstdCompressor(level=1), zstandard.ZstdCompressor(level=7), zstandard.ZstdDecompressor()


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session, a smaller setting of the caller's stays; let workers import this package."""
    ship(spark)
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        try:
            now = int(spark.conf.get(key))
        except Exception:  # the key is unknown to this Spark version, or is written with a unit
            now = 0
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a local one where none is set and driver and tasks share a machine."""
    return checkpoints(spark)


_WRITTEN: dict[str, list[str]] = {}  # folders by application


def written(df: DataFrame, what: str) -> DataFrame:
    """Cut the lineage: write df once as a table of the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _drop(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cleanup(spark: SparkSession, keep: DataFrame | None = None) -> None:
    """Delete the tables that operators of this session have written, once what was made from them is consumed; `keep` stays."""
    ours = _WRITTEN.get(spark.sparkContext.applicationId, [])
    kept = keep.inputFiles() if keep is not None else []
    for path in list(ours):
        if not any(path.rsplit("/", 1)[1] in f for f in kept):
            _drop(spark, path)
            ours.remove(path)


def remove(df: DataFrame) -> None:
    """Delete a table made by written() that no later stage reads."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _drop(df.sparkSession, folder)


def pack(*columns: np.ndarray, close: bool = False) -> bytes:
    """Columns of equal or different lengths as one compressed block, byte plane by byte plane; close: as small as is worth it where most of it repeats."""
    parts = [len(columns).to_bytes(2, "little")]
    for x in columns:
        code = x.dtype.str.encode()
        parts += [len(code).to_bytes(1, "little"), code, len(x).to_bytes(8, "little"), np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T).tobytes()]
    return (_CLOSE if close else _PACK).compress(b"".join(parts))


def unpack(block: bytes) -> list[np.ndarray]:
    raw = _UNPACK.decompress(block)
    at, out = 2, []
    for _ in range(int.from_bytes(raw[:2], "little")):
        width = raw[at]
        kind = np.dtype(raw[at + 1 : at + 1 + width].decode())
        at += 1 + width
        n = int.from_bytes(raw[at : at + 8], "little")
        at += 8
        planes = np.frombuffer(raw, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += n * kind.itemsize
    return out


def squeeze(raw: bytes) -> bytes:
    return _PACK.compress(raw)


def unsqueeze(block: bytes) -> bytes:
    return _UNPACK.decompress(block)


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finalizer over unsigned integers."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Slots:
    """A hash table from 64-bit keys to small integers, probed many keys at a time; grows as it fills."""

    def __init__(self, room: int):
        self._sized(max(room, 8))

    def _sized(self, room: int) -> None:
        size = 1 << (2 * room - 1).bit_length()
        self.key, self.at, self.mask, self.n = np.zeros(size, np.uint64), np.full(size, -1, np.int32), np.uint64(size - 1), 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The integer of each key, -1 where there is none."""
        out, todo, slot = np.full(len(keys), -1, np.int32), np.arange(len(keys)), (keys & self.mask).astype(np.int64)
        while len(todo):
            there = self.at[slot]
            same = self.key[slot] == keys[todo]
            out[todo] = np.where(same, there, -1)
            on = np.flatnonzero((there >= 0) & ~same)
            todo, slot = todo[on], (slot[on] + 1) & int(self.mask)
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Enter distinct keys that aren't there yet, with values that differ."""
        if 3 * (self.n + len(keys)) > 2 * len(self.at):
            old = self.at >= 0
            keys, values = np.concatenate([self.key[old], keys]), np.concatenate([self.at[old], values])
            self._sized(2 * len(keys))
        self.n += len(keys)
        todo, slot = np.arange(len(keys)), (keys & self.mask).astype(np.int64)
        while len(todo):
            free = self.at[slot] < 0
            self.at[slot[free]], self.key[slot[free]] = values[todo[free]], keys[todo[free]]
            on = np.flatnonzero(self.at[slot] != values[todo])  # of several that meet in a free slot one stays
            todo, slot = todo[on], (slot[on] + 1) & int(self.mask)


def spans_of(raw: bytes | np.ndarray, edges: np.ndarray) -> pa.Array:
    """raw[edges[i]:edges[i + 1]] as a binary array that shares raw's memory."""
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(np.ascontiguousarray(edges, np.int32)), pa.py_buffer(raw)])


def names_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each entry of a binary array."""
    n = len(words)
    edges = np.frombuffer(words.buffers()[1], np.int32, n + 1, words.offset * 4) if n else np.zeros(1, np.int32)
    raw = np.frombuffer(words.buffers()[2], np.uint8)[edges[0] : edges[-1]] if edges[-1] > edges[0] else np.zeros(0, np.uint8)
    size = np.diff(edges).astype(np.int64)
    one, two = size.astype(np.uint64), size.astype(np.uint64)
    full = np.flatnonzero(size)
    if len(full):
        start = (edges[:-1] - edges[0]).astype(np.int64)
        place = np.arange(len(raw)) - np.repeat(start, size)
        value = mixed((place.astype(np.uint64) << np.uint64(8)) | raw, 17)
        at = start[full]
        one[full] += np.add.reduceat(value, at)
        two[full] += np.add.reduceat(value * (value >> np.uint64(32) | np.uint64(1)), at)
    return mixed(one, 3), mixed(two, 4)


def sliding(x: np.ndarray, width: int, op: Callable) -> np.ndarray:
    """op (minimum or maximum) over each window of `width` entries; by doubling."""
    have = 1
    while have * 2 <= width:
        x = op(x[:-have], x[have:])
        have *= 2
    return op(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def below(share: float) -> int:
    """The 64-bit hash below which about this share of hashes lies."""
    return min(2**63 - 1, int(-(2**63) + share * (2**64 - 1)))


def sampled(rows: DataFrame, most: int, *key: str | Column, size: Column | None = None, most_bytes: int = 0) -> DataFrame:
    """At most `most` rows, those with the smallest hash of `key`, with that hash as h; of rows with equal hashes one.

    A count sets a threshold that lets about a third more than that through; of what passes only hashes meet in one task, so rows
    stay where they are.  With `size`, rows are taken in that order as long as their sizes add up to most_bytes.
    """
    n = rows.count()
    share = min(1.0, (1.3 * most + 100) / max(1, n))
    hashed = rows.withColumn("h", F.xxhash64(*key))
    few = hashed.where(F.col("h") <= below(share)) if share < 1 else hashed
    first = few.groupBy("h").agg(F.first(size if size is not None else F.lit(0)).alias("n")).orderBy("h").limit(most).collect()  # two numbers for each row of the sample
    total, last = 0, None
    for r in first:
        total += r["n"] or 0
        if size is not None and total > most_bytes and last is not None:
            break
        last = r["h"]
    if last is None:
        return hashed.limit(0)
    others = [c for c in hashed.columns if c != "h"]
    return few.where(F.col("h") <= last).groupBy("h").agg(*[F.first(c).alias(c) for c in others]).select(*others, "h")


def row_key() -> list:
    """A key that tells rows apart even where doc_id repeats or is null: equal only for equal (doc_id, text)."""
    return [F.xxhash64(F.col("doc_id"), F.col("text")).alias("rk")]


def grouped(df: DataFrame, key: str, func: Callable, schema: str) -> DataFrame:
    """One call of func(key value, table) for each key."""
    return df.groupBy(key).applyInArrow(lambda k, table: func(k[0].as_py(), table), schema)


def batches(kind: pa.Schema, rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of bounded bytes, where rows hold blocks of some 100 KB."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, bytes | str)) + 64
        if size > 4 << 20 or len(held) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kind.types, strict=True)], schema=kind)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kind.types, strict=True)], schema=kind)


def cut(order_by: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """(value, start, end) of the runs of a sorted array of small integers below n."""
    edges = np.searchsorted(order_by, np.arange(n + 1))
    return [(v, int(edges[v]), int(edges[v + 1])) for v in range(n) if edges[v] < edges[v + 1]]


def min_labels(a: np.ndarray, b: np.ndarray, n: int, label: np.ndarray | None = None) -> np.ndarray:
    """Smallest index reachable for each of n nodes over the links a-b; label: what is known already."""
    label = np.arange(n) if label is None else label
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:
            nearer = label[label]
            if np.array_equal(nearer, label):
                break
            label = nearer
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def components(links: DataFrame, what: str) -> DataFrame:
    """(node, label) of every linked node: label is the smallest node reachable over links(a, b), longs.

    Alternates large-star and small-star rounds; each round is two aggregations with map-side combine
    and is written to the shared folder, so a lost executor costs one round.  Rounds grow with the
    logarithm of the longest chain.  Ends when a round leaves the links as they were.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{what}-links")
    before = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large star: each neighbour above a node points to the smallest of the node and its neighbours
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: each node and its neighbours below it point to the smallest of them
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        after = written(small.where("a <> b").distinct(), f"{what}-links")
        state = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        remove(edges)
        edges = after
        if state == before:
            return edges.groupBy("a").agg(F.min("b").alias("label")).select(F.col("a").alias("node"), "label")
        before = state
