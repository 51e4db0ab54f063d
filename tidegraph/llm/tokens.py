"""Token-ID output: documents as id arrays, each a zstandard frame of its own under one shared dictionary.

File format, version 1.  A data set is a table of shards in ascending doc_id; a shard has the name of its dictionary (SHA-256), its
documents' ids, frame ends, token counts and the frames laid end to end.  A frame holds unsigned little-endian ids, 2 bytes each where the vocabulary allows.
Frame i is bytes ends[i - 1]:ends[i] of ``frames``, so one short document is read without the rest.  ``shards/``
holds the shards, ``dictionary/`` the dictionary.  Both are Parquet written by Spark's committer, as executors have no other way
into any store that Spark can write to; a task that is run again leaves no second copy.

The dictionary is trained on serialized id arrays of segments of ``SEGMENT`` characters.  Segments of all documents, whole as they are, are drawn by
a hash of (doc_id, place), about ``SAMPLE`` bytes of text in all: a bound on training alone, which bears on the files' size and on nothing else.
Where that is too little to train on, the segments themselves are the dictionary.

Encoding goes through the tokenizers library.  It is given each distinct word between ASCII blanks once, whole, the added token that no word holds
set between them, and a worker keeps the ids (``WORDS`` words at most; then it starts anew).  That is exact where the tokenizer drops white space and
normalises no character by one beyond a blank; a file whose normaliser or pattern isn't the one known to be so has each whole text encoded instead.
Only words of ASCII alone are lower-cased beforehand, so that they are met again.

Defined cases: a null text is empty; each document ends with the end id, so none is empty; rows stay one to one, equal doc_ids lie
side by side ordered by a hash of their texts; a null doc_id comes first; an empty table gives an empty data set; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SAMPLE, SEGMENT, DICT_BYTES, LEVEL = 8 << 20, 4096, 64 << 10, 3
SHARD_BYTES = 1 << 20
WORDS = 1 << 20  # words that a worker keeps
#: The normaliser and pre-tokenizer under which words between ASCII blanks have ids of their own.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


class Encoder:
    """Ids of texts, the same as the library's for each whole text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.size = self.library.get_vocab_size()
        file = json.loads(self.library.to_str())
        added = file["added_tokens"]
        plain = [t for t in added if not (t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] or set(t["content"]) & set(" \t\n\v\f\r"))]
        alike = file["normalizer"] == _NORMALIZER and file["pre_tokenizer"] == _PRE_TOKENIZER and file["truncation"] is None and file["padding"] is None
        self.by_words = bool(added) and len(plain) == len(added) and alike
        self.added = sorted({t["content"][:2] for t in added})
        self.between, self.between_id = (plain[0]["content"], plain[0]["id"]) if plain else ("", -1)
        self.forget()

    def forget(self) -> None:
        """Drop the words met so far."""
        self.known, self.n, self.used = common.Slots(WORDS), 0, 0
        self.check, self.first, self.count = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        self.flat = np.zeros(1 << 18, np.uint32)

    def ids_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, ids of each) of words that hold no added token."""
        joined = [self.between.join(words[a : a + 256]) for a in range(0, len(words), 256)]
        flat = np.fromiter(chain.from_iterable([*e.ids, self.between_id] for e in self.library.encode_batch_fast(joined, add_special_tokens=False)), np.int64)
        cut = flat == self.between_id
        ends = np.flatnonzero(cut)
        return flat[~cut].astype(np.uint32), np.diff(ends, prepend=-1) - 1

    def lookup(self, words: pa.Array) -> np.ndarray:
        """Numbers of distinct words; those not met before are encoded."""
        words = lowered(words)
        name, check = common.names_of(words)
        found = self.known.find(name)
        if (odd := (found >= 0) & (self.check[found] != check)).any():  # equal names of different words
            self.forget()
            found[:] = -1
        at = np.flatnonzero(found < 0)
        if not len(at):
            return found
        if self.n and self.n + len(at) > WORDS:
            self.forget()
            found[:] = -1
            at = np.arange(len(found))
        _, one, back = np.unique(name[at], return_index=True, return_inverse=True)  # words that differ in case may now be equal
        if odd.any() or (check[at][one][back] != check[at]).any():
            raise ValueError("two words of one batch share a 64-bit name")
        new = at[one]
        flat, count = self.ids_of([x.decode("utf-8", "replace") for x in words.take(pa.array(new)).to_pylist()])
        n = len(new)
        while self.n + n > len(self.first):
            self.first, self.count, self.check = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.count, self.check))
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        own = slice(self.n, self.n + n)
        self.check[own], self.count[own], self.first[own] = check[new], count, self.used + np.cumsum(count) - count
        self.flat[self.used : self.used + len(flat)] = flat
        numbers = np.arange(self.n, self.n + n, dtype=np.int32)
        if self.n + n <= WORDS:  # a batch of more words than that is kept for itself alone
            self.known.add(name[new], numbers)
        self.n, self.used = self.n + n, self.used + len(flat)
        found[at] = numbers[back]
        return found

    def encode(self, texts: pa.Array | list[str]) -> list[np.ndarray]:
        """Ids of each text; null: none."""
        texts = pc.fill_null(pa.array(texts, pa.string()) if isinstance(texts, list) else texts.cast(pa.string()), "")
        if not self.by_words:
            return [np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
        odd = np.zeros(len(texts), bool)  # may hold an added token
        for sign in self.added:
            odd |= pc.match_substring(texts, sign, ignore_case=True).to_numpy(zero_copy_only=False)
        split = pc.ascii_split_whitespace(pc.if_else(pa.array(odd), "", texts) if odd.any() else texts)
        words = split.flatten().dictionary_encode()
        number = self.lookup(words.dictionary.cast(pa.binary()))
        at = number[words.indices.to_numpy()]
        n = self.count[at].astype(np.int64)
        end = np.cumsum(n)
        ids = self.flat[np.repeat(self.first[at] - end + n, n) + np.arange(n.sum())]
        edges = np.concatenate([[0], end])[split.offsets.to_numpy() - split.offsets[0].as_py()]
        out = [ids[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
        if self.n > WORDS:
            self.forget()
        whole = np.flatnonzero(odd).tolist()
        for i, x in zip(whole, self.library.encode_batch_fast([texts[i].as_py() for i in whole], add_special_tokens=False) if whole else [], strict=True):
            out[i] = np.array(x.ids, np.uint32)
        return out


def lowered(words: pa.Array) -> pa.Array:
    """A binary array whose ASCII entries have a-z for A-Z. Others stay: a mark may join a capital only, or a small letter only."""
    n = len(words)
    edges = np.frombuffer(words.buffers()[1], np.int32, n + 1, words.offset * 4) if n else np.zeros(1, np.int32)
    raw = np.frombuffer(words.buffers()[2], np.uint8)[: edges[-1]].copy() if edges[-1] else np.zeros(0, np.uint8)
    wide = np.concatenate([[0], np.cumsum(raw >= 0x80)])
    plain = np.repeat(wide[edges[1:]] == wide[edges[:-1]], np.diff(edges))
    own = raw[edges[0] :]
    own[plain & (own >= 65) & (own <= 90)] |= 32
    return common.spans_of(raw, edges)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def serialized(ids: np.ndarray, width: int) -> bytes:
    return ids.astype(f"<u{width}").tobytes()


def id_bytes(vocabulary: int) -> int:
    return 2 if vocabulary <= 1 << 16 else 4


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size()


def train_dictionary(docs: DataFrame, path: str, end_id: int) -> bytes:
    """A dictionary from a bounded sample; empty only where there are no documents."""
    size = docs.agg(F.sum(F.greatest(F.coalesce(F.octet_length("text"), F.lit(0)), F.lit(1))).alias("n")).first()["n"]
    share = min(1.0, SAMPLE / max(1, size or 1))
    last = F.greatest(F.floor((F.coalesce(F.length("text"), F.lit(0)) - 1) / SEGMENT), F.lit(0)).cast("int")
    drawn = F.filter(F.sequence(F.lit(0), last), lambda i: F.xxhash64("doc_id", i) <= common.below(share))
    rows = docs.select("doc_id", "text", F.explode(drawn).alias("i")).select("doc_id", "i", F.substring("text", F.col("i") * SEGMENT + 1, F.lit(SEGMENT)).alias("text"))

    def run(parts):
        for part in parts:
            e = encoder(path)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("i"), pa.array([serialized(np.append(x, end_id), id_bytes(e.size)) for x in e.encode(part.column("text"))], pa.binary())], names=["doc_id", "i", "x"])

    table = rows.mapInArrow(run, "doc_id long, i int, x binary").toArrow()
    got = sorted(zip(*(table.column(c).to_pylist() for c in ("x", "i")), strict=True))  # one order, however they came
    got = [x for x, _ in got]
    try:
        return zstandard.train_dictionary(min(DICT_BYTES, max(1024, sum(map(len, got)) // 32)), got, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few
        return b"".join(got)[-DICT_BYTES:]


_SHARD = "part int, start_in_part long, first_id long, last_id long, dictionary string, id_width int, doc_id array<long>, frame_end array<long>, n_tokens array<long>, frames binary"


def write(docs: DataFrame, where: str, path: str, end_id: int = 1) -> None:
    """Encode docs(doc_id, text) into the folder `where`, in ascending doc_id order."""
    spark = docs.sparkSession
    common.small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    trained = train_dictionary(docs, path, end_id)
    name = hashlib.sha256(trained).hexdigest()
    spark.createDataFrame([(1, name, trained)], "version int, name string, content binary").coalesce(1).write.parquet(f"{where}/dictionary")
    n = common.partitions(spark)
    # doc_id alone is read for the edges of the ranges; as many numbers as there are partitions
    edges = docs.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10_000) if n > 1 else F.lit(None)).first()[0] or []
    edges = np.unique(np.array(edges, np.int64))
    shared = spark.sparkContext.broadcast((trained, edges))
    width = id_bytes(vocabulary_size(path))

    def encode(parts):
        content, cuts = shared.value
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(content) if content else None, write_checksum=False)
        e = encoder(path)
        for part in parts:
            ids = part.column("doc_id").to_pylist()
            got = [np.append(x, np.uint32(end_id)) for x in e.encode(part.column("text"))]
            place = [0 if i is None else int(np.searchsorted(cuts, i, side="right")) for i in ids]
            yield pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), part.column("doc_id"), part.column("tie"), pa.array([len(x) for x in got], pa.int64()), pa.array([pack.compress(serialized(x, width)) for x in got], pa.binary())], names=["part", "doc_id", "tie", "n", "frame"])

    def shards(parts) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("part", pa.int32()), ("start_in_part", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("dictionary", pa.string()), ("id_width", pa.int32()), ("doc_id", pa.list_(pa.int64())), ("frame_end", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())), ("frames", pa.binary())])
        now, start, held, size = None, 0, [], 0

        def out():
            ends = np.cumsum([len(x[2]) for x in held]).tolist()
            known = [x[0] for x in held if x[0] is not None]
            row = (now, start, known[0] if known else None, known[-1] if known else None, name, width, [x[0] for x in held], ends, [x[1] for x in held], b"".join(x[2] for x in held))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kind.types, strict=True)], schema=kind)

        for part in parts:
            for p, i, k, frame in zip(*(part.column(c).to_pylist() for c in ("part", "doc_id", "n", "frame")), strict=True):
                if held and (p != now or size + len(frame) > SHARD_BYTES):
                    yield out()
                    start += sum(x[1] for x in held)
                    held, size = [], 0
                if p != now:
                    now, start = p, 0
                held.append((i, k, frame))
                size += len(frame)
        if held:
            yield out()

    frames = docs.withColumn("tie", F.xxhash64("text")).mapInArrow(encode, "part int, doc_id long, tie long, n long, frame binary")
    ordered = frames.repartition(n, "part").sortWithinPartitions("part", "doc_id", "tie")
    ordered.mapInArrow(shards, _SHARD).write.option("compression", "none").option("parquet.block.size.row.check.min", "4").parquet(f"{where}/shards")


def _each(spark: SparkSession, where: str, schema: str, column) -> DataFrame:
    """(doc_id, start, n_tokens, column of the documents' ids) of a data set, from its files."""
    common.small_batches(spark)
    content = {r["name"]: bytes(r["content"]) for r in spark.read.parquet(f"{where}/dictionary").collect()}
    shards = spark.read.schema(_SHARD).parquet(f"{where}/shards")
    total = shards.select("part", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("part").agg(F.sum("n").alias("n"))
    base, at = {}, 0
    for r in total.orderBy("part").collect():  # a number for each partition of the writer
        base[r["part"]] = at
        at += r["n"]
    shared = spark.sparkContext.broadcast((content, base))

    def run(parts):
        dictionaries, bases = shared.value
        readers = {k: zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(v) if v else None) for k, v in dictionaries.items()}
        for part in parts:
            for p, begin, _, _, name, width, doc, end, count, frames in zip(*(part.column(c).to_pylist() for c in part.schema.names), strict=True):
                start = bases[p] + begin + np.cumsum(count) - count
                ids = [np.frombuffer(readers[name].decompress(frames[a:b]), f"<u{width}") for a, b in zip([0, *end], end, strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start), pa.array([len(x) for x in ids], pa.int64()), column(ids)], names=["doc_id", "start", "n_tokens", "x"])

    return shards.mapInArrow(run, schema)


def read(spark: SparkSession, where: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of each document of a data set, from its files."""

    def lists(ids: list[np.ndarray]) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)), pa.array(np.concatenate(ids).astype(np.int64)))

    return _each(spark, where, "doc_id long, start long, n_tokens long, x array<long>", lists).withColumnRenamed("x", "ids")


def digests(spark: SparkSession, where: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files alone."""

    def sums(ids: list[np.ndarray]) -> pa.Array:
        return pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())

    return _each(spark, where, "doc_id long, start long, n_tokens long, x long", sums).withColumnRenamed("x", "ids_crc32")


def document(spark: SparkSession, where: str, doc_id: int) -> list[int] | None:
    """The ids of one document, the first of its doc_id: the shards' ranges tell the files, and of its shard one frame is decompressed."""
    shards = spark.read.schema(_SHARD).parquet(f"{where}/shards").where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id) & F.array_contains("doc_id", doc_id))
    found = shards.select("part", "start_in_part", "dictionary", "id_width", "doc_id", "frame_end").orderBy("part", "start_in_part").limit(1).collect()
    if not found:
        return None
    row = found[0]
    i = row["doc_id"].index(doc_id)
    a, b = (row["frame_end"][i - 1] if i else 0), row["frame_end"][i]
    frame = shards.where((F.col("part") == row["part"]) & (F.col("start_in_part") == row["start_in_part"])).select(F.substring("frames", a + 1, b - a).alias("x")).first()["x"]
    content = bytes(spark.read.parquet(f"{where}/dictionary").where(F.col("name") == row["dictionary"]).first()["content"])
    return np.frombuffer(zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content) if content else None).decompress(bytes(frame)), f"<u{row['id_width']}").tolist()


def dataset(docs: DataFrame, path: str, end_id: int = 1) -> str:
    """Write docs to a new folder beside the session's checkpoints; its name."""
    where = f"{common.shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write(docs, where, path, end_id)
    return where
