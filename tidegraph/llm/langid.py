"""Language identification: nearest of several centroids per language, over normalised TF-IDF n-gram vectors.

A text, lower-cased, becomes counts of its byte pairs and triples, hashed to ``dims`` columns; a letter of two bytes
weighs in like two letters.  Counts are damped (log), weighted by inverse document frequency and
normalised.  Each language's training vectors are clustered by cosine (k-means from spread starts), and a
text takes the language of the centroid with the largest cosine.  A text farther from every centroid than nearly all training texts of
its length is rejected.

Centroids and limits are learnt from at most ``sample`` labelled rows (a documented bound), as many of each language as share it evenly: those with the
smallest hash of (doc_id, text), whole texts, so that a rare language has its centroids on a corpus of any size.  Document frequencies are those
of all rows of the training fold.  The model is a few MB, whatever the corpus holds.

Defined cases: null, empty and letterless texts are ``und``, score 0, rejected; rows stay one to one and equal texts
get equal results; a null doc_id is carried and is never trained on; with no labelled row all is ``und``; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

_LETTER = regex.compile(r"\p{L}")
DIMS, CENTROIDS, SAMPLE = 4096, 4, 4000
STEP = 1 << 20  # bytes that are counted at once


@dataclass
class Model:
    names: list[str]  # of each centroid
    centroids: np.ndarray  # normalised rows
    idf: np.ndarray
    floor: np.ndarray  # lowest cosine that is accepted, by band of length
    edges: np.ndarray  # lengths where bands begin


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """crc32 of doc_id as text, mod 5, is 0."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary") if isinstance(doc_id, str) else doc_id.cast("string").cast("binary")) % 5 == 0


def counts(texts: list[str], dims: int = DIMS) -> np.ndarray:
    """Hashed pair and triple counts of each text."""
    out = np.zeros((len(texts), dims), np.float32)
    raws = [b" " + x.lower().encode("utf-8", "surrogatepass") + b" " for x in texts]
    start = 0
    while start < len(raws):
        end, size = start, 0
        while end < len(raws) and (end == start or size + len(raws[end]) <= STEP):
            size += len(raws[end])
            end += 1
        raw = np.frombuffer(b"".join(raws[start:end]), np.uint8)
        owner = np.repeat(np.arange(end - start, dtype=np.uint32), [len(x) for x in raws[start:end]])
        for at in range(0, len(raw), 4 * STEP):  # a single long text in steps
            x = raw[at : at + 4 * STEP + 2].astype(np.uint32)
            own = owner[at : at + 4 * STEP + 2]
            pair = x[:-1] * np.uint32(0x9E3779B1) + x[1:] * np.uint32(0x85EBCA77)
            triple = pair[:-1] + x[2:] * np.uint32(0xC2B2AE3D)
            pair = (pair ^ (pair >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            triple = (triple ^ (triple >> np.uint32(15))) * np.uint32(0x297A2D39)
            for h, n in ((pair, 1), (triple, 2)):
                m = min(len(h), 4 * STEP)
                same = own[:m] == own[n : m + n]
                slot = own[:m] * np.uint32(dims) + (h[:m] >> np.uint32(8)) % np.uint32(dims)
                out[start:end] += np.bincount(slot[same], minlength=(end - start) * dims).reshape(end - start, dims)
        start = end
    return out


def vectors(texts: list[str], idf: np.ndarray | None = None) -> np.ndarray:
    x = np.log1p(counts(texts))
    if idf is not None:
        x *= idf
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    return x


def _cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; starts are spread: each is the row least like those before it, the first the row most like the mean."""
    mean = x.mean(axis=0)
    picked = [int((x @ mean).argmax())]
    best = x @ x[picked[0]]
    while len(picked) < min(k, len(x)):
        picked.append(int(best.argmin()))
        best = np.maximum(best, x @ x[picked[-1]])
    c = x[picked].copy()
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        for j in range(len(c)):
            if (near == j).any():
                c[j] = x[near == j].mean(axis=0)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c


def frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    """(texts that have each column, texts) of all rows(text) with a letter: partial counts of each partition, summed by Spark."""

    def run(parts):
        total, n = np.zeros(DIMS + 1, np.int64), 0
        for part in parts:
            texts = [x for x in part.column("text").to_pylist() if x and _LETTER.search(x)]
            for a in range(0, len(texts), 64):
                total[:DIMS] += (counts(texts[a : a + 64]) > 0).sum(axis=0)
            n += len(texts)
        total[DIMS] = n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["at", "n"])

    got = rows.select("text").mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # as many rows as columns
    out = np.zeros(DIMS + 1, np.int64)
    out[got.column("at").to_numpy()] = got.column("n").to_numpy()
    return out[:DIMS], int(out[DIMS])


def fit(docs: DataFrame, centroids: int = CENTROIDS, sample: int = SAMPLE) -> Model | None:
    """Learn from text and non-null lang of rows that aren't held out; `sample` of them for centroids and limits."""
    common.small_batches(docs.sparkSession)
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).where(~held_out()).select("doc_id", "text", "lang")
    known = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a number for each language
    if not known:
        return None
    each = -(-sample // len(known))
    hashed = rows.withColumn("h", F.xxhash64("doc_id", "text"))
    limit = F.create_map(*[F.lit(x) for lang, n in sorted(known.items()) for x in (lang, common.below(min(1.0, (1.2 * each + 60) / n)))])
    few = hashed.where(F.col("h") <= limit[F.col("lang")])
    chosen = few.groupBy("lang", "h").agg(F.first("text").alias("text"))

    def run(parts):  # what goes to the driver is sparse counts, not texts
        for part in parts:
            texts = part.column("text").to_pylist()
            keep = [i for i, x in enumerate(texts) if _LETTER.search(x)]
            x = counts([texts[i] for i in keep])
            at = [np.flatnonzero(r).astype(np.uint16) for r in x]
            yield pa.RecordBatch.from_arrays([pa.array([part.column("lang")[i].as_py() for i in keep], pa.string()), pa.array([part.column("h")[i].as_py() for i in keep], pa.int64()), pa.array([len(texts[i]) for i in keep], pa.int64()), pa.array([common.pack(a, r[a]) for a, r in zip(at, x, strict=True)], pa.binary())], names=["lang", "h", "n", "x"])

    got = chosen.select("lang", "h", "text").mapInArrow(run, "lang string, h long, n long, x binary").toArrow().sort_by([("lang", "ascending"), ("h", "ascending")])
    if not got.num_rows:
        return None
    x = np.zeros((got.num_rows, DIMS), np.float32)
    for row, block in zip(x, got.column("x").to_pylist(), strict=True):
        at, value = common.unpack(block)
        row[at] = value
    lang, size = np.array(got.column("lang").to_pylist(), object), got.column("n").to_numpy()
    have, n_rows = frequencies(rows)
    idf = (np.log((1 + n_rows) / (1 + have)) + 1).astype(np.float32)
    x = np.log1p(x) * idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    names, found = [], []
    for name in sorted(set(lang)):
        c = _cluster(x[lang == name], centroids)
        found.append(c)
        names += [name] * len(c)
    c = np.concatenate(found).astype(np.float32)
    best = (x @ c.T).max(axis=1)
    edges = np.array([0, 20, 60, 150, 400, 1000, 4000])
    band = np.searchsorted(edges, size, side="right") - 1
    floor = np.zeros(len(edges), np.float32)
    for b in range(len(edges)):
        floor[b] = floor[b - 1] if b else 0  # where rows are few, that of shorter texts, which lie farther off; else nothing is rejected
        if (band == b).sum() >= 20:  # below the lower tail of its band
            low, mid = np.quantile(best[band == b], [0.01, 0.5])
            floor[b] = max(0.0, low - 0.8 * (mid - low))
    return Model(names, c, idf, floor, edges)


def predict(texts: list[str | None], model: Model | None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and rejection of each text."""
    lang, score, rejected = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
    keep = [i for i, x in enumerate(texts) if x and _LETTER.search(x)] if model else []
    for s in range(0, len(keep), 64):
        own = keep[s : s + 64]
        cosine = vectors([texts[i] for i in own], model.idf) @ model.centroids.T
        best = cosine.argmax(axis=1)
        for i, b, c in zip(own, best, cosine[np.arange(len(own)), best], strict=True):
            lang[i], score[i] = model.names[b], min(1.0, max(0.0, float(c)))
            rejected[i] = c < model.floor[np.searchsorted(model.edges, len(texts[i]), side="right") - 1]
    return lang, score, rejected


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of docs with lang_pred, score and rejected in place of columns of those names."""
    spark = docs.sparkSession
    common.small_batches(spark)
    kept = docs.select(*[c for c in docs.columns if c.lower() not in ("lang_pred", "score", "rejected")])
    shared = spark.sparkContext.broadcast(model)  # a few MB: centroids and weights, bounded by the languages learnt

    def run(parts):
        for part in parts:
            lang, score, rejected = predict(part.column("text").to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], names=[*part.schema.names, "lang_pred", "score", "rejected"])

    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(run, f"{schema}, lang_pred string, score double, rejected boolean")
