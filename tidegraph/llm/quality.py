"""Quality classifier: a byte-level convolutional network in numpy.

Learned filters of ``WIDTH`` bytes slide over the whole text by ``STRIDE``.  Their responses are max-pooled over pieces
of ``PIECE`` bytes, pieces are averaged within overlapping chunks of ``PIECES``, and a text's chunks are combined by
their mean and their maximum into one logistic score.  Every byte of every text is seen.

Training (Adam on the log loss) uses at most ``SAMPLE`` labelled rows, those with the smallest hash, as long as their texts are ``SAMPLE_BYTES``
or less in all; both are documented bounds of the sample, and each text of it is learnt from whole.  Rows of the held-out fold never train.

Defined cases: a null text is scored as an empty one, an empty text as padding; rows stay one to one and equal texts
get equal scores; a null doc_id is carried, and joins no label; labels that contradict each other for a
doc_id, or are null, don't train; without labels every score is 0.5; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .langid import held_out

WIDTH, STRIDE, PIECE, PIECES, HOP, FILTERS = 8, 2, 64, 8, 7, 16
SAMPLE, SAMPLE_BYTES, EPOCHS, BATCH = 3000, 64 << 20, 8, 64
STEP = 1 << 19  # bytes whose responses are held at once
CHUNK_BYTES, HOP_BYTES = PIECE * PIECES, PIECE * HOP


class Net:
    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.table = r.normal(0, 0.25, (WIDTH, 256, FILTERS)).astype(np.float32)  # response of each filter to a byte at each place
        self.bias = np.zeros(FILTERS, np.float32)
        self.weight = r.normal(0, 0.1, 2 * FILTERS).astype(np.float32)
        self.out = np.zeros(1, np.float32)

    def parts(self) -> list[np.ndarray]:
        return [self.table, self.bias, self.weight, self.out]

    def responses(self, raw: np.ndarray) -> np.ndarray:
        """(pieces, positions in a piece, filters) of bytes whose length is a multiple of PIECE."""
        padded = np.concatenate([raw, np.zeros(WIDTH, np.uint8)])
        n = len(raw) // STRIDE
        total = np.take(self.table[0], padded[: n * STRIDE : STRIDE], axis=0)
        for i in range(1, WIDTH):
            total += np.take(self.table[i], padded[i : i + n * STRIDE : STRIDE], axis=0)
        return total.reshape(-1, PIECE // STRIDE, FILTERS)


def laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts end to end, each padded with zeros (a filter's width at least) to whole pieces, one chunk at least; and pieces of each."""
    pieces = np.array([max(PIECES, -(-(len(x) + WIDTH) // PIECE)) for x in texts])
    return np.frombuffer(b"".join(x.ljust(p * PIECE, b"\0") for x, p in zip(texts, pieces.tolist(), strict=True)), np.uint8), pieces


def chunk_starts(pieces: int) -> np.ndarray:
    """First pieces of chunks that overlap by PIECES - HOP and cover all pieces; the last ends with them."""
    return np.unique(np.minimum(np.arange(0, pieces - PIECES + HOP, HOP), pieces - PIECES))


def score(net: Net, texts: list[bytes]) -> np.ndarray:
    out = np.empty(len(texts))
    start = 0
    while start < len(texts):
        end, size = start, 0
        while end < len(texts) and (end == start or size + len(texts[end]) + CHUNK_BYTES <= STEP):
            size += len(texts[end]) + CHUNK_BYTES
            end += 1
        raw, pieces = laid_out(texts[start:end])
        pooled = np.concatenate([net.responses(raw[a : a + STEP]).max(axis=1) for a in range(0, len(raw), STEP)])
        if len(raw) > STEP:  # a piece at a step's end has to see the bytes after it
            for a in range(STEP, len(raw), STEP):
                near = np.concatenate([raw[a - PIECE : a], raw[a : a + PIECE]])
                pooled[a // PIECE - 1] = net.responses(near)[0].max(axis=0)
        pooled = np.maximum(pooled + net.bias, 0)
        base = np.concatenate([[0], np.cumsum(pieces)])
        for i in range(start, end):
            own = pooled[base[i - start] : base[i - start + 1]]
            at = chunk_starts(len(own))
            total = np.concatenate([np.zeros((1, FILTERS)), np.cumsum(own, axis=0, dtype=np.float64)])
            chunk = (total[at + PIECES] - total[at]) / PIECES
            z = chunk.max(axis=0) @ net.weight[:FILTERS] + chunk.mean(axis=0) @ net.weight[FILTERS:] + net.out[0]
            out[i] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        start = end
    return out


def strongest(net: Net, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each piece and filter: the largest response, and the byte where it starts; as score() sees them."""
    tops, places = [], []
    for a in range(0, len(raw), STEP):
        part = raw[a : a + STEP + PIECE]  # the next piece too: the last one's filters reach into it
        own = net.responses(part)[: len(raw[a : a + STEP]) // PIECE]
        where = own.argmax(axis=1)
        tops.append(np.take_along_axis(own, where[:, None, :], axis=1)[:, 0, :])
        places.append(a + (np.arange(len(where))[:, None] * (PIECE // STRIDE) + where) * STRIDE)
    return np.concatenate(tops), np.concatenate(places)


def train(examples: list[tuple[bytes, int]], seed: int = 7) -> Net:
    """examples: whole texts and the label 0 or 1."""
    net, r = Net(seed), np.random.default_rng(seed)
    m, v = ([np.zeros_like(x) for x in net.parts()] for _ in range(2))
    step = 0
    for epoch in range(EPOCHS):
        order = r.permutation(len(examples))
        rate = 0.02 * (1 - epoch / EPOCHS) + 0.002
        for s in range(0, len(order), BATCH):
            own = [examples[i] for i in order[s : s + BATCH]]
            y = np.array([y for _, y in own], np.float32)
            raw, pieces = laid_out([x for x, _ in own])
            top, place = strongest(net, raw)
            top = top + net.bias
            live = top > 0
            pooled = np.where(live, top, 0)
            base = np.cumsum(pieces) - pieces
            starts = [chunk_starts(p) for p in pieces.tolist()]
            n_chunks = np.array([len(x) for x in starts])
            at = np.concatenate([x + b for x, b in zip(starts, base, strict=True)])  # first pieces of all chunks
            total = np.concatenate([np.zeros((1, FILTERS)), np.cumsum(pooled, axis=0, dtype=np.float64)])
            chunk = ((total[at + PIECES] - total[at]) / PIECES).astype(np.float32)
            first = np.cumsum(n_chunks) - n_chunks
            doc_of = np.repeat(np.arange(len(own)), n_chunks)
            high = np.maximum.reduceat(chunk, first, axis=0)
            mean = np.add.reduceat(chunk, first, axis=0) / n_chunks[:, None]
            z = high @ net.weight[:FILTERS] + mean @ net.weight[FILTERS:] + net.out[0]
            dz = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(own)
            g_weight = np.concatenate([high.T @ dz, mean.T @ dz])
            ahead = (chunk == high[doc_of]) * (dz[doc_of, None] * net.weight[:FILTERS]) + (dz / n_chunks)[doc_of, None] * net.weight[FILTERS:]
            edge = np.zeros((len(pooled) + 1, FILTERS))  # a chunk's gradient goes to each of its pieces
            np.add.at(edge, at, ahead / PIECES)
            np.add.at(edge, at + PIECES, -ahead / PIECES)
            g_piece = np.cumsum(edge[:-1], axis=0) * live
            g_table = np.zeros_like(net.table)
            padded = np.concatenate([raw, np.zeros(WIDTH, np.uint8)])
            column = np.arange(FILTERS)
            for i in range(WIDTH):
                slot = padded[place + i].astype(np.int64) * FILTERS + column
                g_table[i] = np.bincount(slot.reshape(-1), weights=g_piece.reshape(-1), minlength=256 * FILTERS).reshape(256, FILTERS)
            step += 1
            for x, g, a, b in zip(net.parts(), [g_table + 1e-5 * net.table, g_piece.sum(axis=0), g_weight + 1e-4 * net.weight, np.array([dz.sum()])], m, v, strict=True):
                a += 0.1 * (g - a)
                b += 0.002 * (g * g - b)
                x -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.998**step)) + 1e-7)).astype(np.float32)
    return net


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Net | None:
    """Learn quality from rows that aren't held out: at most `sample` of them, of `sample_bytes` of text in all."""
    common.small_batches(docs.sparkSession)
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).where(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("most")).where("y = most")
    known = common.sampled(known.select("doc_id", F.col("y").cast("int").alias("y")), sample, "doc_id").select("doc_id", "y")
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(known), "doc_id")  # at most `sample` rows of 24 bytes
    got = common.sampled(rows, sample, "doc_id", F.col("text"), size=F.octet_length("text"), most_bytes=sample_bytes).orderBy("h").toArrow()
    if not got.num_rows:
        return None
    return train([(x or b"", y) for x, y in zip(got.column("text").to_pylist(), got.column("y").to_pylist(), strict=True)])


def classify(docs: DataFrame, net: Net | None) -> DataFrame:
    """(doc_id, score): the probability of quality 1."""
    spark = docs.sparkSession
    common.small_batches(spark)
    shared = spark.sparkContext.broadcast(net)  # 130 KB, whatever the corpus holds

    def run(parts):
        for part in parts:
            texts = [(x or "").encode("utf-8", "surrogatepass") for x in part.column("text").to_pylist()]
            got = score(shared.value, texts) if shared.value is not None else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(got)], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
