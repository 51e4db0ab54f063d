"""SimHash near-duplicates: exact tiled comparison with exclusive-or and bit counts.

Distinct fingerprints are cut into tiles of at most about ``tile`` rows, each tile holding one population
count.  Two fingerprints within ``radius`` bits have population counts within ``radius`` of each other, so
only tiles of near counts meet.  In a task the same test is made again on the counts of the four 16-bit
quarters, whose differences add up to at most the distance.  What a task emits is a spanning forest of the
links it found (never all pairs), so a group of a million near copies costs a million rows, and components
come out the same.

Defined cases: a null or blank text has fingerprint zero and is linked like any other; rows with a null
doc_id take part, and get the smallest doc_id of their component (null if it has none); equal rows give
equal results; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

_OWN = ("__key", "__none", "__th", "__n")


def fingerprint_of(text: str | None, shingle: int = 4) -> int:
    """Bit i is 1 if it is set in over half the XXH64 (seed 42) of the text's word shingles, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII blanks cut
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(b" ".join(words), 42)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - shingle + 1
    hashes = np.fromiter((digest(line[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[shingle - 1 :].tolist(), strict=True)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, th, fp): th is a hash of the text, fp the fingerprint's 64 bits as a signed long."""
    common.small_batches(docs.sparkSession)

    def run(parts):
        for part in parts:
            fp = np.array([fingerprint_of(x, shingle) for x in part.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("th"), pa.array(fp)], names=["doc_id", "th", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text").mapInArrow(run, "doc_id long, th long, fp long")


def _quarters(fp: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fp.view(np.uint16).reshape(-1, 4)).astype(np.int8)


def _classes(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """fp ordered by its quarters' counts; the distinct counts; where each class starts (and the end)."""
    counts = _quarters(fp).astype(np.int32)
    key = ((counts[:, 0] * 17 + counts[:, 1]) * 17 + counts[:, 2]) * 17 + counts[:, 3]
    order = np.argsort(key, kind="stable")
    _, first = np.unique(key[order], return_index=True)
    return fp[order], counts[order][first], np.append(first, len(fp))


def near_links(left: np.ndarray, right: np.ndarray | None, radius: int) -> np.ndarray:
    """Links (n, 2) that span, within left and right together, what lies within radius bits. right None: left with itself.

    Memory holds one class's comparisons at a time, and their links are merged before the next.
    """
    left, lc, ls = _classes(left)
    own = right is None
    right, rc, rs = (left, lc, ls) if own else _classes(right)
    nodes = left if own else np.concatenate([left, right])
    shift = 0 if own else len(left)
    label, forest = np.arange(len(nodes)), []
    for i in range(len(lc)):
        near = np.flatnonzero(np.abs(rc - lc[i]).sum(axis=1) <= radius)
        if own:
            near = near[near >= i]
        if not len(near):
            continue
        a = left[ls[i] : ls[i + 1]]
        at = np.concatenate([np.arange(rs[j], rs[j + 1]) for j in near])
        b = right[at]
        step = max(1, (1 << 21) // len(b))
        for s in range(0, len(a), step):
            hit = np.bitwise_count(a[s : s + step, None] ^ b[None, :]) <= radius
            x, y = np.nonzero(hit)
            if not len(x):
                continue
            x, y = x + (ls[i] + s), at[y] + shift
            new = label[x] != label[y]
            if new.any():
                x, y = x[new], y[new]
                old = label.copy()
                label = common.min_labels(label[x], label[y], len(nodes), label)
                moved = np.flatnonzero((label != old) & (np.arange(len(nodes)) == old))  # roots that found a smaller root
                forest.append(np.stack([nodes[moved], nodes[label[moved]]], 1))
    return np.concatenate(forest) if forest else np.zeros((0, 2), nodes.dtype)


def links(fps: DataFrame, radius: int = 4, tile: int = 1 << 17) -> DataFrame:
    """Links (a, b) between distinct fingerprints fp that span all pairs within radius bits.

    The counts by population (65 rows at most) set how many tiles each population has; that map is all the
    driver sees.  A tile of 131,072 fingerprints is a block of 1 MB, sent once to each partner; tiles are smaller where that
    makes fewer than two a partition, so that no task gets much more than others.
    """
    spark = fps.sparkSession
    count = {r["p"]: r["n"] for r in fps.groupBy(F.bit_count("fp").alias("p")).agg(F.count("*").alias("n")).collect()}
    tile = min(tile, max(4096, sum(count.values()) // (2 * common.partitions(spark))))
    by_count = {p: -(-n // tile) for p, n in count.items()}
    if not by_count:
        return spark.createDataFrame([], "a long, b long")
    tiles = F.create_map(*[F.lit(x) for p, k in sorted(by_count.items()) for x in (p, k)])
    placed = fps.withColumn("p", F.bit_count("fp")).withColumn("t", F.pmod(F.xxhash64("fp"), tiles[F.col("p")]).cast("int"))

    def blocks(key, table):
        p, t = (x.as_py() for x in key)
        return pa.table({"p": [p], "t": [t], "block": [np.sort(table.column("fp").to_numpy()).tobytes()]}, schema=pa.schema([("p", pa.int32()), ("t", pa.int32()), ("block", pa.binary())]))

    block = placed.select("p", "t", "fp").groupBy("p", "t").applyInArrow(blocks, "p int, t int, block binary")
    # each pair of tiles has one meeting place, named by the lower tile first
    q_all = F.filter(F.sequence(F.col("p") - radius, F.col("p") + radius), lambda q: F.map_contains_key(tiles, q))
    others = F.flatten(F.transform(q_all, lambda q: F.transform(F.sequence(F.lit(0), tiles[q] - 1), lambda u: F.struct(q.alias("q"), u.alias("u")))))
    me = F.struct(F.col("p").alias("q"), F.col("t").alias("u"))
    met = block.select("p", "t", "block", F.explode(others).alias("o")).select(F.least(me, "o").alias("lo"), F.greatest(me, "o").alias("hi"), "block")

    def meet(key, table):
        both = [np.frombuffer(x, np.uint64) for x in table.column("block").to_pylist()]
        found = near_links(both[0], both[1] if len(both) > 1 else None, radius).view(np.int64)
        return pa.table({"a": found[:, 0], "b": found[:, 1]})

    return met.groupBy("lo", "hi").applyInArrow(meet, "a long, b long")


def _labelled(docs: DataFrame, shingle: int, radius: int, tile: int) -> DataFrame:
    """(doc_id, th, fp, label, component_id): label is the smallest fingerprint of the component, as a signed long."""
    prints = common.written(fingerprints(docs, shingle), "simhash")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
    found = common.components(links(distinct.select("fp"), radius, tile), "simhash")
    label = distinct.join(found, distinct.fp == found.node, "left").select("fp", "low", F.coalesce("label", "fp").alias("label"))
    least = label.groupBy("label").agg(F.min("low").alias("component_id"))
    return prints.join(label.join(least, "label").select("fp", "label", "component_id"), "fp").select("doc_id", "th", "fp", "label", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4, tile: int = 1 << 17) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable over links of at most radius bits."""
    return _labelled(docs, shingle, radius, tile).select("doc_id", "fp", "component_id")


def without_near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4, tile: int = 1 << 17) -> DataFrame:
    """docs with one row of each component: of the smallest doc_id, or of no doc_id where the component has none.

    If that doc_id has several texts in the component, the text with the smallest hash stays; of rows equal in doc_id and text the one whose other
    columns, written as JSON, have the smallest hash.
    """

    def keyed(df: DataFrame, text_hash: Column) -> DataFrame:  # plain columns: what the join has dealt out serves the window as well
        return df.withColumns({"__key": F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")), "__none": F.col("doc_id").isNull(), "__th": text_hash})

    found = _labelled(docs, shingle, radius, tile)
    first = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("label").agg(F.min("th").alias("th"), F.min("doc_id").alias("doc_id"))
    chosen = keyed(first, F.col("th")).select("__key", "__none", "__th").distinct()
    aside = [c for c in docs.columns if c in _OWN]  # columns of the names used here are set aside
    plain = docs.withColumnsRenamed({c: f"__own{c}" for c in aside})
    kept = keyed(plain, F.xxhash64("text")).join(chosen, ["__key", "__none", "__th"], "left_semi")
    others = [F.col(f"`{c.replace('`', '``')}`") for c in plain.columns if c not in ("doc_id", "text")]
    order = F.row_number().over(Window.partitionBy("__key", "__none", "__th").orderBy(F.xxhash64(F.to_json(F.struct(*others))) if others else F.lit(0)))
    return kept.withColumn("__n", order).where("__n = 1").select(*plain.columns).withColumnsRenamed({f"__own{c}": c for c in aside})
