"""Exact substring deduplication by a distributed merge sort of suffixes that knows common prefixes.

A byte goes if a string of ``length`` bytes that covers it also starts in a document with a smaller doc_id.

1. Documents are dealt to buckets once, compressed.  Each string of ``length`` bytes is represented by the
   suffix that starts at the least hashed gram inside it: equal strings choose equal suffixes, and one suffix
   stands for the run of neighbouring strings that choose it, about 17 of them.
2. A filter that has only false positives drops the suffixes whose first gram occurs in one document alone: sorted
   hashes, one for each gram of a chunk, go out as differences, and one bit for each comes back.
3. Each chunk of a bucket sorts what is left into runs, front-coded (length of the prefix shared with the one before, then
   the rest), one run for each range of gram hashes.  Equal suffixes of a run are one entry with its least and largest doc_id; where
   they stand is not sent, the bucket sorts again what is told.
4. A range merges its runs with a loser tree whose nodes keep the prefix length they share with the last
   winner.  Unequal lengths decide a match without reading a byte; equal ones compare from there on.
   Neighbours in the merged order that share the gram form a group; the strings of a group find the least
   doc_id that has each of them, and the entries of larger documents are told.
5. The buckets turn that into intervals of each document, unite them and cut them out.

Rows in a group are never paired: its cost is its entries times the strings of one suffix.  What meets in a range is one entry of a chunk
for each distinct suffix, however many documents hold it, so a passage in a third of all rows stays small.  Buckets and ranges are as many as the
shuffle's partitions, or more where the texts are more than ``BUCKET`` bytes for each.

Defined cases: a null text is empty; texts shorter than ``length`` stay whole; a null doc_id counts as larger
than any other, and rows with the same doc_id never cut each other; equal rows give equal results; an empty table
gives an empty result; further columns are ignored.  Strings are UTF-8 bytes, so a cut may fall inside a character.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

GRAM = 16  # bytes that choose and name a suffix
BUCKET = 32 << 20  # bytes of text for each pair of buckets
CHUNK = 16 << 20  # bytes of text that are held, sorted and sent at once
BLOCK = 1 << 15  # bytes that are hashed at once, so that what is at hand stays in a core's cache
ENTRIES = 1 << 15  # entries of a range that are merged before their strings are told apart; groups are not parted
_LAST = np.iinfo(np.int64).max
_BYTE = common.mixed(np.arange(256, dtype=np.uint64), 1)


def gram_hashes(raw: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each `size` bytes (a power of two) of raw; by doubling."""
    h, by = _BYTE[raw], 1
    factor = 0x9FB21C651E98DF25
    while by < size:
        h = h[:-by] * np.uint64(factor) + h[by:]
        h ^= h >> np.uint64(29)
        factor = factor * factor % 2**64
        by *= 2
    return h


def window_hashes(raw: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each `size` bytes, any size of 32 to 64."""
    half = gram_hashes(raw, 32)
    return common.mixed(half[: len(raw) - size + 1] * np.uint64(0xD1342543DE82EF95) + half[size - 32 : size - 32 + len(raw) - size + 1], 7)


class Chunk:
    """Documents laid end to end, with the suffixes that represent their strings."""

    def __init__(self, texts: list[bytes], length: int):
        self.raw = np.frombuffer(b"".join(texts), np.uint8)
        self.base = np.concatenate([[0], np.cumsum([len(x) for x in texts], dtype=np.int64)])
        self.length = length
        n, grams = len(self.raw), length - GRAM + 1
        found = [(np.zeros(0, np.int64),) * 3]
        names = [np.zeros(0, np.uint64)]
        doc = 0
        for at in range(0, max(0, n - length + 1), BLOCK):
            part = self.raw[at : at + BLOCK + length - 1]
            h = gram_hashes(part, GRAM)
            key = (h * np.uint64(0xD1342543DE82EF95)) & ~np.uint64(0xFFFFFF) | np.arange(len(h), dtype=np.uint64)  # a place has 24 bits beside the hash
            place = (common.sliding(key, grams, np.minimum) & np.uint64(0xFFFFFF)).astype(np.int64)
            # strings that reach beyond their document are none
            inside = np.ones(len(place), bool)
            while doc < len(self.base) - 1 and self.base[doc + 1] - length + 1 < at + len(place):
                a, b = max(0, self.base[doc + 1] - length + 1 - at), self.base[doc + 1] - at
                inside[a : max(0, b)] = False
                if b > len(place):
                    break
                doc += 1
            start = np.flatnonzero(inside)
            if len(start):
                place = place[start]
                cut = np.flatnonzero((place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1))
                last = np.append(cut, len(start) - 1)
                found.append((place[last] + at, start[np.concatenate([[0], cut + 1])] + at, start[last] + at))
                names.append(common.mixed(h[place[last]], 3) >> np.uint64(16))
        gram, first, last = (np.concatenate(x) for x in zip(*found, strict=True))
        name = np.concatenate(names)
        order = np.argsort(name, kind="stable")
        self.name, self.gram, self.first, self.last = name[order], gram[order], first[order], last[order]

        self.doc = np.searchsorted(self.base, self.first, side="right") - 1
        # a gram of a document is named once
        self.new = np.append(True, (self.name[1:] != self.name[:-1]))[: len(self.name)]
        self.two = np.zeros(int(self.new.sum()), bool)  # grams that more than one document of this chunk holds
        again = np.flatnonzero(~self.new & np.append(False, self.doc[1:] != self.doc[:-1])[: len(self.name)])
        self.two[np.cumsum(self.new)[again] - 1] = True

    def parts(self, n: int) -> list[tuple[int, int, int]]:
        return common.cut((self.name * np.uint64(n) >> np.uint64(48)).astype(np.int64), n)

    def keys(self, at: np.ndarray) -> np.ndarray:
        """Fixed-width rows: the suffix as far as its strings reach, 255, what stands before it from right to left, 255."""
        gram, first, reach = self.gram[at], self.first[at], self.last[at] + self.length
        ahead, behind = reach - gram, gram - first
        width = 2 * self.length - GRAM + 2
        col = np.arange(width)
        source = np.where(col < ahead[:, None], gram[:, None] + col, gram[:, None] + ahead[:, None] - col)  # ahead + 1 is one to the left of the gram
        inside = (col < ahead[:, None]) | ((col > ahead[:, None]) & (col <= (ahead + behind)[:, None]))
        out = self.raw[np.clip(source, 0, len(self.raw) - 1)]
        out[~inside] = 0
        rows = np.arange(len(at))
        out[rows, ahead] = 255
        out[rows, ahead + behind + 1] = 255
        return out


def chunked(texts: list[bytes], most: int = CHUNK):
    """Ranges of a list of texts with at most `most` bytes each, one text at least."""
    start = size = 0
    for i, x in enumerate(texts):
        if i > start and size + len(x) > most:
            yield start, i
            start, size = i, 0
        size += len(x)
    if start < len(texts):
        yield start, len(texts)


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of two keys of equal length; their first `known` bytes are known to be equal."""
    number = int.from_bytes
    while known < len(a):
        x, y = a[known : known + 16], b[known : known + 16]
        if x != y:
            return known + (8 * len(x) - (number(x) ^ number(y)).bit_length()) // 8
        known += 16
    return len(a)


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, place in it, prefix shared with the entry before) in merged order, of sorted front-coded runs."""
    run, place, shared, _ = next(merged_blocks(runs, None))
    return run, place, shared


def merged_blocks(runs: list[tuple[Iterable[bytes], Iterable[int]]], most: int | None):
    """(run, place in it, prefix shared with the entry before, keys) in merged order, of sorted front-coded runs; a block ends where the gram changes, after
    `most` entries or more.

    A loser tree: each inner node keeps the loser of its match and how long a prefix the loser shares with
    the winner that passed.  Once a winner is out, all lengths on its path refer to it, so of two
    contenders the one that shares more is smaller; only at equal lengths are bytes read, from there on.
    """
    k = 1
    while k < len(runs):
        k *= 2
    following = [zip(*r, strict=True) for r in runs] + [iter(())] * (k - len(runs))
    over = (b"", -1)  # what a run that has ended gives
    head = [next(x, over) for x in following]
    head, have_of = [x for x, _ in head], [x for _, x in head]
    loser, depth = [0] * k, [-1] * k

    def build(node: int) -> tuple[int, int]:
        """Winner and its length; all the first entries share nothing that is known."""
        if node >= k:
            return node - k, min(have_of[node - k], 0)
        (a, la), (b, lb) = build(2 * node), build(2 * node + 1)
        if la < lb:
            a, la, b, lb = b, lb, a, la
        elif la == lb == 0:
            lb = common_prefix(head[a], head[b], 0)
            if head[b][lb:] < head[a][lb:]:
                a, b = b, a
        loser[node], depth[node] = b, lb
        return a, la

    paths = [[(leaf + k) >> i for i in range(1, k.bit_length())] for leaf in range(k)]
    winner, have = build(1) if k > 1 else (0, have_of[0])
    out_run, out_shared, keys, passed = [], [], [], np.zeros(k, np.int64)

    def block():
        run = np.array(out_run, np.int64)
        order = np.argsort(run, kind="stable")
        size = np.bincount(run, minlength=k) if len(run) else np.zeros(k, np.int64)
        place = np.empty(len(run), np.int64)
        place[order] = np.arange(len(run)) - np.repeat(np.cumsum(size) - size, size)
        place += passed[run]
        passed[:] += size
        return run, place, np.array(out_shared, np.int64), keys

    most = np.inf if most is None else most
    while have >= 0:
        if have < GRAM and len(keys) >= most:
            yield block()
            out_run, out_shared, keys = [], [], []
        out_run.append(winner)
        out_shared.append(have)
        keys.append(head[winner])
        head[winner], have = next(following[winner], over)
        for node in paths[winner]:
            other = depth[node]
            if other < have:
                continue
            if other > have:
                depth[node], have = have, other
                loser[node], winner = winner, loser[node]
            elif have >= 0:
                rival = loser[node]
                x, y = head[winner], head[rival]
                depth[node] = both = common_prefix(x, y, have)
                if both < len(x) and x[both] > y[both]:
                    loser[node], winner = winner, rival
    yield block()


def front_code(rows: np.ndarray) -> np.ndarray:
    """For each row but the first, the length of the prefix that it shares with the row before."""
    differ = rows[1:] != rows[:-1]
    return np.concatenate([[0], np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])]).astype(np.uint8) if len(rows) else np.zeros(0, np.uint8)


def front_decode(shared: np.ndarray, rest: np.ndarray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(front_keys(shared, rest, width)), np.uint8).reshape(-1, width)


def front_keys(shared: np.ndarray, rest: np.ndarray, width: int) -> Iterator[bytes]:
    raw, at, now = memoryview(rest), 0, b""
    for s in shared.tolist():
        now = now[:s] + raw[at : at + width - s]
        at += width - s
        yield now


def lowest(rows: np.ndarray, shared: np.ndarray, doc: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(whether an entry is alone, first of its numbers, numbers): the least document of all strings of an entry, or of each.

    rows: keys in merged order, equal ones side by side; shared: the prefix with the row before; doc: the least document of
    each.  Entries whose gram has one context only are alone: all their strings have one number.
    """
    width = rows.shape[1]
    new = shared < width
    new[:1] = True
    same = np.cumsum(new) - 1  # class of equal keys
    group = np.cumsum(np.concatenate([[True], shared[1:] < GRAM]) if len(shared) else [])[new] - 1
    key = rows[new]
    n_class = len(key)
    least = np.full(n_class, _LAST, np.int64)
    np.minimum.at(least, same, doc)
    alone = np.bincount(group, minlength=n_class)[group] == 1
    marks = key == 255
    ahead = marks.argmax(axis=1)
    total = width - 1 - marks[:, ::-1].argmax(axis=1) - 1  # bytes without both marks
    many = np.flatnonzero(~alone)
    first, numbers = np.arange(n_class), least
    if len(many):
        # contents in reading order, end to end
        col = np.arange(width)
        behind = total[many] - ahead[many]
        source = np.where(col < behind[:, None], ahead[many][:, None] + behind[:, None] - col, col - behind[:, None])
        flat = np.take_along_axis(key[many], np.clip(source, 0, width - 1), axis=1)[col < total[many][:, None]]
        base = np.concatenate([[0], np.cumsum(total[many])[:-1]])
        n = total[many] - length + 1
        offset = np.concatenate([[0], np.cumsum(n)])
        place = np.repeat(base - offset[:-1], n) + np.arange(offset[-1])
        name = window_hashes(flat, length)[place]
        order = np.argsort(name, kind="stable")
        edge = np.concatenate([[True], name[order][1:] != name[order][:-1]])
        low = np.empty(len(name), np.int64)
        low[order] = np.minimum.reduceat(np.repeat(least[many], n)[order], np.flatnonzero(edge))[np.cumsum(edge) - 1]
        first = first.copy()
        first[many] = n_class + offset[:-1]
        numbers = np.concatenate([least, low])
    return alone[same], first[same], numbers


def united(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of intervals; those that touch are one."""
    order = np.argsort(start, kind="stable")
    start, far = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > far[:-1]]) if len(start) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return start[at], far[np.append(at[1:], len(start)) - 1] if len(start) else far


def ordered(table: pa.Table) -> tuple[list[bytes], np.ndarray, list]:
    """Texts, order values and doc_ids of a bucket, in an order that every reading repeats."""
    table = table.take(pa.array(np.argsort(table.column("rk").to_numpy(), kind="stable")))
    ids = table.column("doc_id").to_pylist()
    return [common.unsqueeze(x) for x in table.column("body").to_pylist()], np.array([_LAST if x is None else x for x in ids], np.int64), ids


def bucket_pairs(docs: DataFrame) -> int:
    """Half the number of buckets: the shuffle's partitions, or more if texts are large."""
    size = docs.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first()["n"] or 0
    return max(common.partitions(docs.sparkSession), -(-size // BUCKET))


def bucketed(docs: DataFrame, n: int) -> DataFrame:
    """(bucket, rk, doc_id, body): documents compressed and dealt out once; equal plans share the exchange."""
    common.small_batches(docs.sparkSession)

    def run(parts):
        for part in parts:
            body = [common.squeeze(x or b"") for x in part.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("bucket", "rk", "doc_id")), pa.array(body, pa.binary())], names=["bucket", "rk", "doc_id", "body"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").select("*", *common.row_key())
    rows = rows.withColumn("bucket", F.pmod("rk", F.lit(2 * n)).cast("int"))
    return rows.mapInArrow(run, "bucket int, rk long, doc_id long, body binary").repartition(n, "bucket")


def _table(rows: list[tuple], **kinds) -> pa.Table:
    return pa.table(list(zip(*rows, strict=True)) if rows else [[] for _ in kinds], schema=pa.schema(list(kinds.items())))


def repeated(_, table: pa.Table) -> pa.Table:
    """For each block of sorted names, with a bit each for those that its chunk holds twice, the bits of those that any two chunks or one hold twice."""
    blocks = [common.unpack(x) for x in table.column("block").to_pylist()]
    every = np.concatenate([np.cumsum(x[0]) for x in blocks])
    twice = np.concatenate([np.unpackbits(x[1], count=len(x[0])) for x in blocks]).astype(bool)
    order = np.argsort(every, kind="stable")
    there = every[order]
    again = there[1:] == there[:-1]
    twice[order[1:][again]] = True
    twice[order[:-1][again]] = True
    edges = np.cumsum([len(x[0]) for x in blocks])[:-1]
    masks = [np.packbits(x).tobytes() for x in np.split(twice, edges)]
    return table.drop_columns("block").append_column("mask", pa.array(masks, pa.binary()))


def bits_of(masks: pa.Table) -> dict[tuple[int, int], bytes]:
    return {(c, p): m for c, p, m in zip(*(masks.column(x).to_pylist() for x in ("chunk", "part", "mask")), strict=True)}


def exact_substrings(docs: DataFrame, length: int = 50) -> DataFrame:
    """(doc_id, n_bytes, spans, kept): the maximal removed runs as (start, end) bytes, and the bytes that stay."""
    if not 33 <= length <= 64:
        raise ValueError("length: 33 to 64 bytes")
    n = bucket_pairs(docs)
    held = bucketed(docs, n)
    width = 2 * length - GRAM + 2

    def names(bucket, table):
        texts, _, _ = ordered(table)
        rows = []
        for c, (a, b) in enumerate(chunked(texts)):
            chunk = Chunk(texts[a:b], length)
            number = np.cumsum(chunk.new) - 1
            for p, s, e in chunk.parts(n):
                own = chunk.name[s:e][chunk.new[s:e]]
                rows.append((bucket, c, p, common.pack(np.diff(own, prepend=np.uint64(0)), np.packbits(chunk.two[number[s] : number[e - 1] + 1]))))
        return _table(rows, bucket=pa.int32(), chunk=pa.int32(), part=pa.int32(), block=pa.binary())

    def entries(texts: list[bytes], c: int, bits: dict, only=None):
        """(part, keys, shared, first of each entry's places, where) of a chunk, always the same: where they stand is made again for what comes back."""
        chunk = Chunk(texts, length)
        number = np.cumsum(chunk.new) - 1
        for p, s, e in chunk.parts(n):
            if only is not None and (c, p) not in only:
                continue
            again = np.unpackbits(np.frombuffer(bits[c, p], np.uint8)).astype(bool)
            at = s + np.flatnonzero(again[number[s:e] - number[s]])
            if not len(at):
                continue
            key = chunk.keys(at)
            order = np.argsort(key.view(f"S{width}").reshape(-1), kind="stable")
            key, at = key[order], at[order]
            shared = front_code(key)
            new = shared < width
            new[0] = True
            doc, edge = chunk.doc[at], np.flatnonzero(new)
            yield p, key[new], shared[new], edge, (np.diff(np.append(edge, len(at))), (chunk.last[at] - chunk.first[at] + 1)[edge], doc, chunk.first[at] - chunk.base[doc])

    def runs(_, table, masks):
        texts, order_value, _ = ordered(table)
        bucket = table.column("bucket")[0].as_py() if len(table) else 0
        bits, rows = bits_of(masks), []
        for c, (a, b) in enumerate(chunked(texts)):
            for p, key, shared, edge, where in entries(texts[a:b], c, bits):
                rest, value = key[np.arange(width) >= shared[:, None]], order_value[a:b][where[2]]
                rows.append((p, bucket, c, common.pack(shared, rest, np.minimum.reduceat(value, edge), np.maximum.reduceat(value, edge))))
        return _table(rows, part=pa.int32(), bucket=pa.int32(), chunk=pa.int32(), run=pa.binary())

    def merged(_, table):
        """What the entries of a range are told, a block of neighbouring groups at a time: keys and strings of one block are at hand, and numbers for the rest."""
        decoded = [common.unpack(x) for x in table.column("run").to_pylist()]
        ahead = np.concatenate([[0], np.cumsum([len(x[0]) for x in decoded])])
        least, most = (np.concatenate([x[i] for x in decoded]) for i in (2, 3))
        found = []
        for run, place, shared, keys in merged_blocks([(front_keys(x[0], x[1], width), x[0].tolist()) for x in decoded], ENTRIES):
            at = ahead[run] + place
            rows = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, width)
            alone, first, numbers = lowest(rows, shared, least[at], length)
            size = np.where(alone, 1, width - 1 - (rows == 255)[:, ::-1].argmax(axis=1) - 1 - length + 1)
            # an entry all of whose documents come first for all its strings has nothing to be told
            own = numbers[np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())]
            later = (np.minimum.reduceat(own, np.cumsum(size) - size) if len(size) else own) < most[at]
            found.append((run[later].astype(np.int32), place[later].astype(np.uint32), alone[later], size[later].astype(np.int32), own[np.repeat(later, size)]))
        del decoded, least, most
        run, place, alone, size, low = (np.concatenate(x) for x in zip(*found, strict=True))
        del found
        order, start = np.argsort(run, kind="stable"), np.cumsum(size, dtype=np.int64) - size
        bucket, chunk = table.column("bucket").to_pylist(), table.column("chunk").to_pylist()
        part = table.column("part").to_pylist()
        out = []
        for r, s, e in common.cut(run[order], len(bucket)):
            own = order[s:e]
            m = size[own]
            of = np.repeat(start[own] - np.cumsum(m) + m, m) + np.arange(m.sum())
            out.append((bucket[r], chunk[r], part[r], common.pack(place[own], alone[own].astype(np.uint8), low[of])))
        return _table(out, bucket=pa.int32(), chunk=pa.int32(), part=pa.int32(), block=pa.binary())

    def intervals(told: bytes, places: tuple[np.ndarray, ...], value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, start, end) in a chunk, of what a range told it."""
        entry, alone, low = common.unpack(told)
        count, n_strings, doc, first = places
        entry = entry.astype(np.int64)
        begin = np.cumsum(count) - count
        m = np.where(alone == 1, 1, n_strings[entry]).astype(np.int64)
        offset = np.cumsum(m) - m
        occ = np.repeat(begin[entry] - np.cumsum(count[entry]) + count[entry], count[entry]) + np.arange(count[entry].sum())
        of = np.repeat(np.arange(len(entry)), count[entry])
        own, start, whole = value[doc[occ]], first[occ].astype(np.int64), n_strings[entry][of].astype(np.int64)
        out = []
        for s in range(0, len(occ), 1 << 15):
            o = slice(s, s + (1 << 15))
            reps = m[of[o]]
            edge = np.cumsum(reps) - reps
            index = np.arange(reps.sum()) - np.repeat(edge, reps)
            seen = low[np.repeat(offset[of[o]], reps) + index] < np.repeat(own[o], reps)
            lo = np.minimum.reduceat(np.where(seen, index, 1 << 30), edge)
            hi = np.maximum.reduceat(np.where(seen, index, -1), edge)
            hi = np.where((hi >= 0) & (alone[of[o]] == 1), whole[o] - 1, hi)
            ok = hi >= 0
            out.append((doc[occ[o]][ok].astype(np.int64), start[o][ok] + lo[ok], start[o][ok] + hi[ok] + length))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def removed(_, table, blocks):
        texts, order_value, ids = ordered(table)
        came = blocks.column("mask").is_null()
        told = {(c, p): x for c, p, x in zip(*(blocks.filter(came).column(k).to_pylist() for k in ("chunk", "part", "block")), strict=True)}
        bits, hit = bits_of(blocks.filter(pc.invert(came))), {c for c, _ in told}
        spans, kept = [], []
        for c, (a, b) in enumerate(chunked(texts)):
            lengths = np.array([len(x) for x in texts[a:b]], np.int64)
            base = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])  # one apart, so that runs of two documents never touch
            found = [intervals(told[c, p], where, order_value[a:b]) for p, _, _, _, where in entries(texts[a:b], c, bits, told)] if c in hit else []
            doc, start, end = (np.concatenate(x) for x in zip((np.zeros(0, np.int64),) * 3, *found, strict=True))
            start, end = united(base[doc] + start, base[doc] + end)
            owner = np.searchsorted(base, start, side="right") - 1
            edge = np.searchsorted(owner, np.arange(b - a + 1))
            start, end = (start - base[owner]).tolist(), (end - base[owner]).tolist()
            for i, text in enumerate(texts[a:b]):
                s, e = start[edge[i] : edge[i + 1]], end[edge[i] : edge[i + 1]]
                spans.append([{"start": x, "end": y} for x, y in zip(s, e, strict=True)])
                kept.append(b"".join(text[x:y] for x, y in zip([0, *e], [*s, len(text)], strict=True)))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_bytes": pa.array([len(x) for x in texts], pa.int64()), "spans": pa.array(spans, kind), "kept": pa.array(kept, pa.binary())})

    sent = common.grouped(held, "bucket", names, "bucket int, chunk int, part int, block binary")
    masks = common.grouped(sent, "part", repeated, "bucket int, chunk int, part int, mask binary")
    # one plan: the documents are dealt out once for its three readings, and nothing that only the end of a query frees is held twice
    sorted_runs = held.groupBy("bucket").cogroup(masks.groupBy("bucket")).applyInArrow(lambda k, a, b: runs(k, a, b), "part int, bucket int, chunk int, run binary")
    gone = common.grouped(sorted_runs, "part", merged, "bucket int, chunk int, part int, block binary")
    back = gone.withColumn("mask", F.lit(None).cast("binary")).unionByName(masks.withColumn("block", F.lit(None).cast("binary")))
    out = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"
    return held.groupBy("bucket").cogroup(back.groupBy("bucket")).applyInArrow(lambda k, a, b: removed(k, a, b), out)
