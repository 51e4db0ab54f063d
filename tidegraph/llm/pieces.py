"""SentencePiece encoding and decoding with sampled segmentations.

A text becomes a lattice of vocabulary pieces (and byte pieces, where a character has none).  Each piece has a log
probability; forward filtering adds up the mass of all segmentations that reach a place, and backward sampling draws
one from the end, edge by edge.  Draws come from a counter-based generator over (seed, row key, place in the text), so a row
gets the same segmentation on any machine and in any order.  Decoding gives back the text, byte for byte.

Where no piece of the vocabulary holds a space after another character, or a line break, lattices are cut there without changing any
probability; the vocabulary is checked for that, and texts stay whole if it doesn't hold.  A filtered lattice depends on its
stretch alone: a worker keeps those it has met (``EDGES`` edges at most; then it starts anew), and all stretches of a batch
are sampled in step.  A stretch of more than ``LONGEST`` characters is filtered by itself with one number a character, and its edges
are made again block by block from its end: the same segmentations in bounded memory.

The file's scores are merge ranks, not log probabilities; pieces get -``alpha`` * log(rank + 10), a Zipf law.  alpha = 0 makes all
segmentations equally likely; a large alpha favours few and frequent pieces.

Defined cases: a null text is encoded as an empty one; an empty text has no pieces; a "▁" of the text itself is encoded as
bytes, so that it isn't taken for a space; a null row key counts as -1; equal (key, text) give equal pieces; an empty table
gives an empty result; further columns are carried, clashing names are replaced.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

ALPHA, SEED, LONGEST = 1.0, 42, 1 << 12
STEP, EDGES = 1 << 19, 6 << 20  # bytes that are sampled at once; edges that a worker keeps
_ROLL = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary:
    """Pieces of a model file: ids, probabilities and bytes, a table to look them up by hash, and the lattices met so far."""

    def __init__(self, path: str, alpha: float = ALPHA):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = n = library.get_piece_size()
        self.bytes = [b""] * n
        self.byte_id = np.zeros(256, np.int64)
        texts, ids = [], []
        for i in range(n):
            piece = library.id_to_piece(i)
            if library.is_byte(i):
                self.byte_id[int(piece[3:5], 16)], self.bytes[i] = i, bytes([int(piece[3:5], 16)])
            elif not (library.is_control(i) or library.is_unknown(i) or library.is_unused(i)):
                texts.append(piece.replace("▁", " "))
                ids.append(i)
                self.bytes[i] = texts[-1].encode()
        mass = np.zeros(n + 1)  # the last is that of no piece, -1
        mass[ids] = np.exp(-alpha * np.log(np.arange(len(ids)) + 10))
        with np.errstate(divide="ignore"):
            self.mass, self.logp, self.byte_mass = mass, np.log(mass[:-1]), float(np.exp(-alpha * np.log(n + 10)))
        self.longest = max(map(len, texts))
        self.cuts = not any("\n" in t or " " in t.lstrip(" ") for t in texts)  # whether lattices may be cut at blanks
        codes = [np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in texts]
        self.pieces = common.Slots(len(texts))
        for length in range(1, self.longest + 1):
            own = [k for k, c in enumerate(codes) if len(c) == length]
            if own:
                flat = np.concatenate([codes[k] for k in own])
                self.pieces.add(self.hashes(flat, length)[length - 1][length - 1 :: length], np.array([ids[k] for k in own], np.int32))
        self.some = np.zeros(1 << 20, bool)
        self.some[(self.pieces.key[self.pieces.at >= 0] & np.uint64(0xFFFFF)).astype(np.int64)] = True
        self.forget()

    def forget(self) -> None:
        """Drop the lattices met so far."""
        self.known, self.n, self.edges = common.Slots(EDGES // 16), 0, 0
        self.check, self.last, self.count = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
        self.places, self.first = 0, np.zeros(1 << 18, np.int32)
        self.bound, self.code, self.back = np.zeros(1 << 19, np.uint32), np.zeros(1 << 19, np.int32), np.zeros(1 << 19, np.uint8)

    @staticmethod
    def hashes(codes: np.ndarray, longest: int) -> list[np.ndarray]:
        """Of the 1, 2, ... longest characters that end at each place."""
        one = common.mixed(codes.astype(np.uint64), 11)
        out = [one]
        for _ in range(longest - 1):
            h = out[-1]
            out.append(np.concatenate([one[:1], h[:-1] * _ROLL + one[1:]]))
        return [(h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * i) >> np.uint64(8) for i, h in enumerate(out)]

    def ends(self, codes: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each place and length: the piece that ends there (size + character for its bytes, -1 for none), and its probability."""
        wide = min(self.longest, int(place.max()) + 1)
        piece = np.full((len(codes), wide), -1, np.int32)
        for k, h in enumerate(self.hashes(codes, wide)):
            at = np.flatnonzero(self.some[h & np.uint64(0xFFFFF)])  # few are left to be looked up
            at = at[place[at] >= k]
            piece[at, k] = self.pieces.find(h[at])
        weight = self.mass[piece]
        bare = np.flatnonzero(piece[:, 0] < 0)
        code = codes[bare]
        weight[bare, 0] = self.byte_mass ** (1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000))
        piece[bare, 0] = self.size + code.astype(np.int64)
        return piece, weight

    def lookup(self, spans: pa.Array) -> np.ndarray:
        """Numbers of the lattices of distinct stretches; those not met before are filtered. -1: longer than LONGEST."""
        name, check = common.names_of(spans)
        found = self.known.find(name)
        odd = np.flatnonzero((found >= 0) & (self.check[found] != check))
        at = np.flatnonzero(found < 0)
        _, one = np.unique(name[at], return_index=True)
        if len(odd) or len(one) < len(at):  # equal names of different stretches, which no corpus has shown: those go without the table
            odd = np.union1d(odd, np.delete(at, one))
            found[odd] = -1
            at = np.setdiff1d(at, odd)
        if len(at):
            new = spans.take(pa.array(at))
            ends = np.frombuffer(new.buffers()[1], np.int32, len(at) + 1)
            raw = np.frombuffer(new.buffers()[2], np.uint8)[: ends[-1]]
            size = np.diff(np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[ends])  # characters
            fit = np.flatnonzero(size <= LONGEST)
            if self.edges + 4 * int(size[fit].sum()) > EDGES and self.n:
                self.forget()
                return self.lookup(spans)
            fit = fit[np.argsort(-size[fit], kind="stable")]
            for own in np.split(fit, np.flatnonzero(np.diff(np.cumsum(size[fit]) // STEP)) + 1):
                if not len(own):
                    continue
                texts = new.take(pa.array(own))
                first, m = self.n, int(size[own].sum())
                codes = np.frombuffer(texts.buffers()[2].to_pybytes()[: np.frombuffer(texts.buffers()[1], np.int32)[len(own)]].decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32, m)
                self.learn(codes, size[own])
                found[at[own]] = np.arange(first, self.n, dtype=np.int32)
                self.check[first : self.n] = check[at[own]]
                self.known.add(name[at[own]], found[at[own]])
        return found

    def learn(self, codes: np.ndarray, size: np.ndarray) -> None:
        """Filter the lattices of stretches given longest first, and keep them."""
        start = np.cumsum(size) - size
        piece, share = self.ends(codes, np.arange(len(codes)) - np.repeat(start, size))
        wide = piece.shape[1]
        reach = np.zeros(len(codes) + len(size))  # one node before each stretch's first character
        reach[start + np.arange(len(size))] = 1
        step = np.arange(wide)
        for p in range(int(size[0])):
            n = int(np.searchsorted(-size, -p, side="left"))  # stretches longer than p
            at = start[:n] + p
            node = at + np.arange(n) + 1
            w = min(wide, p + 1)
            x = reach[node[:, None] - 1 - step[:w]] * share[at, :w]
            total = x.sum(axis=1)
            reach[node] = total
            share[at, :w] = x / total[:, None]
            if p % 8 == 7:  # only ratios matter from here on: keep them far from underflow
                reach[node[:, None] - np.arange(min(wide, p + 2))] /= total[:, None]
        count, bound, code, back = edges_of(piece, share)
        while self.n + len(size) > len(self.last):
            self.last, self.count, self.check = (np.concatenate([x, np.zeros_like(x)]) for x in (self.last, self.count, self.check))
        while self.places + len(codes) > len(self.first):
            self.first = np.concatenate([self.first, np.zeros_like(self.first)])
        while self.edges + len(code) > len(self.code):
            self.bound, self.code, self.back = (np.concatenate([x, np.zeros_like(x)]) for x in (self.bound, self.code, self.back))
        self.last[self.n : self.n + len(size)] = self.places + start + size - 1
        self.count[self.n : self.n + len(size)] = size
        self.first[self.places : self.places + len(codes)] = self.edges + np.cumsum(count) - count
        for whole, part in ((self.bound, bound), (self.code, code), (self.back, back)):
            whole[self.edges : self.edges + len(code)] = part
        self.n, self.places, self.edges = self.n + len(size), self.places + len(codes), self.edges + len(code)


def edges_of(piece: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, ...]:
    """(edges of each place, bound, code, length): bound is the share of the place's mass up to this edge in 1 / 2^32.

    Long pieces come first: they mostly have the larger share, and are found with fewer steps.
    """
    piece, share = piece[:, ::-1], share[:, ::-1]
    there = piece >= 0
    count = there.sum(axis=1)
    row, column = np.divmod(np.flatnonzero(there), piece.shape[1])
    share = share[row, column]
    last = np.cumsum(count) - 1
    total = np.cumsum(share)
    total -= np.repeat(total[last] - np.add.reduceat(share, last - count + 1), count) if len(share) else 0
    bound = np.clip(total * 4294967296.0, 0, 4294967295.0).astype(np.uint32)
    bound[last] = 4294967295
    return count, bound, piece[row, column], (piece.shape[1] - column).astype(np.uint8)


def draws(key: np.ndarray, place: np.ndarray) -> np.ndarray:
    """32 bits for each row key and place in its text; the largest value is left out."""
    return np.minimum(common.mixed(key + place.astype(np.uint64) * _ROLL, 5) >> np.uint64(32), np.uint64(4294967294)).astype(np.uint32)


def sample_long(vocab: Vocabulary, codes: np.ndarray, key: np.ndarray, first: int, block: int = 1 << 14) -> tuple[np.ndarray, np.ndarray]:
    """(places, codes) of the pieces of one stretch; of its filter only the logarithm of each place's mass is held whole."""
    n, wide = len(codes), vocab.longest

    def part(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        before = max(0, a - wide)
        piece, weight = vocab.ends(codes[before:b], np.arange(b - before) if before == 0 else np.arange(b - before) + wide)
        return piece[a - before :], weight[a - before :]

    log = np.zeros(n + 1)
    recent, scale = np.zeros(wide), 0.0  # masses of the last places, the newest first
    recent[0] = 1
    for a in range(0, n, block):
        _, weight = part(a, min(n, a + block))
        w = weight.shape[1]
        for p, own in enumerate(weight, a):
            total = float(recent[:w] @ own)
            recent[1:] = recent[:-1]
            recent[0] = total
            log[p + 1] = np.log(total) + scale
            if p % 8 == 7:
                recent /= total
                scale += np.log(total)
    places, found = [], []
    end, a = n, n  # the piece sought ends before `end`
    while end:
        if end <= a:
            a = max(0, end - block)
            piece, weight = part(a, end)
            w = piece.shape[1]
            ahead = a + 1 + np.arange(end - a)  # nodes after each place
            node = ahead[:, None] - 1 - np.arange(w)
            share = np.where(node >= 0, weight * np.exp(log[np.maximum(node, 0)] - log[ahead][:, None]), 0.0)
            count, bound, code, back = edges_of(piece, share)
            edge = (np.cumsum(count) - count).tolist()
            draw = draws(key, first + np.arange(a, end)).tolist()
            bound, code, back = bound.tolist(), code.tolist(), back.tolist()
        e = edge[end - 1 - a]
        while bound[e] <= draw[end - 1 - a]:
            e += 1
        places.append(end - 1)
        found.append(code[e])
        end -= back[e]
    return np.array(places[::-1], np.int64), np.array(found[::-1], np.int64)


def encode(vocab: Vocabulary, texts: list[bytes | str], keys: list[int], seed: int = SEED) -> list[np.ndarray]:
    """Ids of a sampled segmentation of each text."""
    texts = [x.encode("utf-8", "surrogatepass") if isinstance(x, str) else x for x in texts]
    with np.errstate(over="ignore"):
        row_key = common.mixed(np.array([(-1 if k is None else k) % 2**64 for k in keys], np.uint64) if keys else np.zeros(0, np.uint64), seed)
    out: list[np.ndarray] = []
    a = 0
    while a < len(texts):
        b, size = a, 0
        while b < len(texts) and (b == a or size + len(texts[b]) < STEP):
            size += len(texts[b]) + 1
            b += 1
        out += _encode(vocab, texts[a:b], row_key[a:b])
        a = b
    return out


def _encode(vocab: Vocabulary, texts: list[bytes], key: np.ndarray) -> list[np.ndarray]:
    joined = b"".join([b" " + x for x in texts if x])
    raw = np.frombuffer(joined, np.uint8)
    text_end = np.cumsum([len(x) + 1 if x else 0 for x in texts])
    out = np.full(len(raw), -1, np.int32)  # the piece that ends at a character: byte where its stretch starts, and characters from there
    if len(raw):
        start = np.zeros(len(raw) + 1, bool)
        if vocab.cuts:
            line, blank = raw == 10, raw == 32
            start[:-1] |= line
            start[1:] |= line
            start[0:-1] |= blank & ~np.concatenate([[False], blank[:-1]])
        start[text_end] = start[0] = True
        edges = np.flatnonzero(start)
        owner = np.searchsorted(text_end, edges[:-1], side="right")
        spans = common.spans_of(joined, edges).dictionary_encode()
        which = vocab.lookup(spans.dictionary)[spans.indices.to_numpy()]
        begin, own, first = edges[:-1], key[owner], edges[:-1] - np.concatenate([[0], text_end])[owner]
        for i in np.flatnonzero(which < 0).tolist():
            codes = np.frombuffer(joined[edges[i] : edges[i + 1]].decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
            place, code = sample_long(vocab, codes, own[i : i + 1], int(first[i]))
            out[begin[i] + place] = code
        ok = np.flatnonzero(which >= 0)
        which, begin, own, first = which[ok], begin[ok], own[ok], first[ok]
        left, place = vocab.count[which].astype(np.int64), vocab.last[which].astype(np.int64)
        while len(left):
            draw = draws(own, first + left - 1)
            edge = vocab.first[place]
            more = np.flatnonzero(vocab.bound[edge] <= draw)
            while len(more):
                edge[more] += 1
                more = more[vocab.bound[edge[more]] <= draw[more]]
            out[begin + left - 1] = vocab.code[edge]
            n = vocab.back[edge]
            left, place = left - n, place - n
            go = np.flatnonzero(left > 0)
            if len(go) < len(left):
                left, place, begin, own, first = left[go], place[go], begin[go], own[go], first[go]
    parts = np.concatenate([[0], text_end])
    return [_spelt(vocab, x[x >= 0]) for x in (out[a:b] for a, b in zip(parts[:-1].tolist(), parts[1:].tolist(), strict=True))]


def _spelt(vocab: Vocabulary, codes: np.ndarray) -> np.ndarray:
    """Characters without a piece become their bytes' pieces."""
    odd = np.flatnonzero(codes >= vocab.size)
    if not len(odd):
        return codes
    spelling = {c: vocab.byte_id[np.frombuffer(chr(c - vocab.size).encode("utf-8", "surrogatepass"), np.uint8)] for c in np.unique(codes[odd]).tolist()}
    parts, last = [], 0
    for i in odd.tolist():
        parts += [codes[last:i], spelling[int(codes[i])]]
        last = i + 1
    return np.concatenate([*parts, codes[last:]]).astype(np.int32)


def decode(vocab: Vocabulary, ids: list[int] | np.ndarray) -> str:
    raw = b"".join(map(vocab.bytes.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids))
    return raw[1:].decode("utf-8", "surrogatepass")  # the first is the space set before every text


_VOCABULARIES: dict[tuple, Vocabulary] = {}


def vocabulary(path: str, alpha: float) -> Vocabulary:
    """One for each worker process, file and alpha."""
    if (path, alpha) not in _VOCABULARIES:
        _VOCABULARIES[path, alpha] = Vocabulary(path, alpha)
    return _VOCABULARIES[path, alpha]


def _schema(df: DataFrame) -> str:
    return "".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}, " for f in df.schema.fields)


def _texts(part: pa.RecordBatch) -> list[bytes]:
    return [x or b"" for x in part.column("text").cast(pa.binary()).to_pylist()]


def _sums(got: list[np.ndarray]) -> tuple[pa.Array, pa.Array]:
    """n_pieces, and the CRC of the ids as little-endian 32-bit integers."""
    return pa.array([len(x) for x in got], pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in got], pa.int64())


def encoded(docs: DataFrame, path: str, key: str = "doc_id", alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """The rows of docs with pieces (array of ids), n_pieces and pieces_crc32 (of the ids as little-endian 32-bit integers)."""
    common.small_batches(docs.sparkSession)
    kept = docs.select(*[c for c in docs.columns if c.lower() not in ("pieces", "n_pieces", "pieces_crc32")])

    def run(parts):
        vocab = vocabulary(path, alpha)
        for part in parts:
            got = encode(vocab, _texts(part), part.column(key).to_pylist(), seed)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in got])]).astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int32), *got]).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*part.columns, lists, *_sums(got)], names=[*part.schema.names, "pieces", "n_pieces", "pieces_crc32"])

    return kept.mapInArrow(run, f"{_schema(kept)}pieces array<int>, n_pieces long, pieces_crc32 long")


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """The rows with `decoded`, the text that their pieces spell."""
    common.small_batches(rows.sparkSession)
    kept = rows.select(*[c for c in rows.columns if c.lower() != "decoded"])

    def run(parts):
        vocab = vocabulary(path, ALPHA)
        for part in parts:
            lists = part.column("pieces")
            flat, at = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([decode(vocab, flat[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], pa.string())], names=[*part.schema.names, "decoded"])

    return kept.mapInArrow(run, f"{_schema(kept)}decoded string")


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """(the key, n_pieces, pieces_crc32, decoded, lossless): each text encoded, and decoded from its ids alone, in one pass."""
    common.small_batches(docs.sparkSession)
    kept = docs.select(key, "text")

    def run(parts):
        vocab = vocabulary(path, alpha)
        for part in parts:
            texts = _texts(part)
            got = encode(vocab, texts, part.column(key).to_pylist(), seed)
            back = [decode(vocab, x) for x in got]
            same = [x.encode("utf-8", "surrogatepass") == t for x, t in zip(back, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(key), *_sums(got), pa.array(back, pa.string()), pa.array(same)], names=[key, "n_pieces", "pieces_crc32", "decoded", "lossless"])

    return kept.mapInArrow(run, f"{_schema(kept.drop('text'))}n_pieces long, pieces_crc32 long, decoded string, lossless boolean")


def digest(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_pieces, pieces_crc32, decoded_sha256, lossless) after a round trip of every text."""
    rows = round_trip(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), path)
    return rows.select("doc_id", "n_pieces", "pieces_crc32", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), "lossless")
