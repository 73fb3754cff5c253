"""Byte-level BPE, encoding and decoding, over whole texts.

Pre-tokenisation works on arrays: each code point has a class, a look at its neighbours gives it a symbol, and a
symbol stands for a function from states to states. Functions compose associatively, so a scan composes them within
blocks (all blocks at a time), over the blocks, and within blocks again with the state that enters each; where a
symbol meets a state in which it begins a piece there is a boundary. No pattern is matched. Pieces are slices of the
texts' bytes, made distinct by dictionary encoding, and only those that the bounded cache doesn't know are merged, in
rounds over all of them. Token offsets are kept, and ids decode by taking their byte strings.

The pieces are those of `'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`.

Defined results: null text is empty and has no ids; nothing is a special token; repeated rows are encoded alike; an
empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from csift.llm.common import slices

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Bytes of text that a worker has in arrays at a time.
SLICE = 1 << 20

# Classes of code points.
LETTER, ONE, R, V, L, E, NUMBER, SPACE, WHITE, QUOTE, OTHER, END = range(12)
#: Code points with the property White_Space, but for the space itself.
WHITE_SPACE = (9, 10, 11, 12, 13, 0x85, 0xA0, 0x1680, 0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006, 0x2007, 0x2008, 0x2009, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
# Symbols; with FIRST added, those of a text's first code point.
S_LETTER, S_NUMBER, S_OTHER, S_SHORT, S_LONG, S_WHITE, S_LAST_SPACE, S_LAST_WHITE = range(8)
FIRST = 8
# States: what the piece so far is.
NONE, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_WHITE, AFTER_SPACE, ONE_MORE, TWO_MORE = range(8)
BLOCK = 64


def _functions() -> tuple[np.ndarray, np.ndarray]:
    """to[symbol, state] and begins[symbol, state]."""
    goes_on = {
        S_LETTER: {IN_LETTERS: IN_LETTERS, AFTER_SPACE: IN_LETTERS, ONE_MORE: NONE, TWO_MORE: ONE_MORE},
        S_NUMBER: {IN_NUMBERS: IN_NUMBERS, AFTER_SPACE: IN_NUMBERS},
        S_OTHER: {IN_OTHERS: IN_OTHERS, AFTER_SPACE: IN_OTHERS},
        S_SHORT: {IN_OTHERS: IN_OTHERS, AFTER_SPACE: IN_OTHERS},
        S_LONG: {IN_OTHERS: IN_OTHERS, AFTER_SPACE: IN_OTHERS},
        S_WHITE: {IN_WHITE: IN_WHITE},
    }
    new = {S_LETTER: IN_LETTERS, S_NUMBER: IN_NUMBERS, S_OTHER: IN_OTHERS, S_SHORT: ONE_MORE, S_LONG: TWO_MORE, S_WHITE: IN_WHITE, S_LAST_SPACE: AFTER_SPACE, S_LAST_WHITE: NONE}
    to, begins = np.zeros((16, 8), np.int64), np.zeros((16, 8), bool)
    for symbol, fresh in new.items():
        for state in range(8):
            on = goes_on.get(symbol, {}).get(state)
            to[symbol, state], begins[symbol, state] = (fresh, True) if on is None else (on, False)
            to[symbol + FIRST, state], begins[symbol + FIRST, state] = fresh, True
    return to, begins


TO, BEGINS = _functions()
_classes: list[np.ndarray] = []


def classes() -> np.ndarray:
    """The class of each code point; made once a process, from general categories."""
    if not _classes:
        kinds = np.fromiter((LETTER if c == "L" else NUMBER if c == "N" else OTHER for c in (unicodedata.category(chr(i))[0] for i in range(0x110000))), np.uint8, 0x110000)
        kinds[list(WHITE_SPACE)] = WHITE
        kinds[ord(" ")], kinds[ord("'")] = SPACE, QUOTE
        kinds[[ord(c) for c in "stmd"]] = ONE
        for c, kind in zip("rvle", (R, V, L, E)):
            kinds[ord(c)] = kind
        _classes.append(kinds)
    return _classes[0]


def symbols(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """points: code points of texts one after the other; starts: where texts that aren't empty begin."""
    kinds = classes()[points]
    first = np.zeros(len(points) + 2, bool)
    first[starts] = True
    first[len(points) :] = True
    padded = np.concatenate([kinds, np.full(2, END, np.uint8)])
    nxt = np.where(first[1:-1], END, padded[1:-1])
    after = np.where(first[1:-1] | first[2:], END, padded[2:])
    white = (kinds == SPACE) | (kinds == WHITE)
    last = white & (nxt != SPACE) & (nxt != WHITE) & (nxt != END)
    quote = kinds == QUOTE
    out = np.full(len(points), S_OTHER, np.int64)
    out[kinds <= E] = S_LETTER
    out[kinds == NUMBER] = S_NUMBER
    out[white] = S_WHITE
    out[last & (kinds == SPACE)] = S_LAST_SPACE
    out[last & (kinds == WHITE)] = S_LAST_WHITE
    out[quote & (nxt == ONE)] = S_SHORT
    out[quote & (((nxt == R) | (nxt == V)) & (after == E) | (nxt == L) & (after == L))] = S_LONG
    return out + FIRST * first[:-2]


def boundaries(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where pieces begin."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    blocks = -(-n // BLOCK)
    marks = np.full(blocks * BLOCK, S_WHITE, np.int64)
    marks[:n] = symbols(points, starts)
    marks = np.ascontiguousarray(marks.reshape(blocks, BLOCK).T) * 8
    flat = TO.ravel()
    whole = np.broadcast_to(np.arange(8), (blocks, 8)).copy()  # composed function of each block
    for row in marks:
        whole = flat[row[:, None] + whole]
    # exclusive scan over blocks by doubling: whole[b] becomes the composition of blocks 0..b
    step = 1
    while step < blocks:
        whole[step:] = np.take_along_axis(whole[step:], whole[:-step], 1)
        step *= 2
    state = np.concatenate([[NONE], whole[:-1, NONE]])
    begins, found = BEGINS.ravel(), np.empty((BLOCK, blocks), bool)
    for k, row in enumerate(marks):
        at = row + state
        found[k] = begins[at]
        state = flat[at]
    return np.nonzero(found.T.ravel()[:n])[0]


class Vocabulary:
    """Ranks of byte strings, and for pairs of tokens what they merge to."""

    CACHED = 150_000
    ROUNDS_UP_TO = 32

    def __init__(self, lines: bytes):
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines.splitlines() if x)}
        strings = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            strings[rank] = token
        self.strings = pa.array(strings, pa.binary())
        self.lengths = np.array([len(x) for x in strings], np.int64)
        self.bytes = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        pairs = [(self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        a, b, r = np.array(pairs, np.int64).T
        self._hashed(a << 20 | b, r)
        self.known: dict[bytes, bytes] = {}  # ids as 32-bit integers

    NEVER = np.int64(1 << 40)

    def _hashed(self, keys: np.ndarray, values: np.ndarray) -> None:
        """An open-addressed table: key k lies at one of `probes` places after its hash."""
        size = 1 << max(10, int(len(keys) * 4).bit_length())
        self.mask, self.keys, self.values, self.probes = size - 1, np.full(size, -1, np.int64), np.full(size, self.NEVER), 0
        while len(keys):
            at = self._place(keys, self.probes)
            free = self.keys[at] < 0
            _, one = np.unique(at[free], return_index=True)
            put = np.nonzero(free)[0][one]
            self.keys[at[put]], self.values[at[put]] = keys[put], values[put]
            left = np.ones(len(keys), bool)
            left[put] = False
            keys, values, self.probes = keys[left], values[left], self.probes + 1

    def _place(self, keys: np.ndarray, probe: int) -> np.ndarray:
        return (((keys * 0x9E3779B97F4A7C1 & 0x7FFFFFFFFFFFFFFF) >> 23) + probe) & self.mask

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair's merge, NEVER if there is none."""
        keys = np.where((a < 0) | (b < 0), -2, a << 20 | b)
        out = np.full(keys.shape, self.NEVER)
        for probe in range(self.probes):
            at = self._place(keys, probe)
            hit = self.keys[at] == keys
            out[hit] = self.values[at[hit]]
        return out

    def _rounds(self, pieces: list[bytes]) -> list[bytes]:
        """In each round every piece merges its pair of least rank, the leftmost first."""
        width = max(map(len, pieces))
        lengths = np.array([len(p) for p in pieces])
        inside = np.arange(width) < lengths[:, None]
        parts = np.full((len(pieces), width), -1, np.int64)
        parts[inside] = self.bytes[np.frombuffer(b"".join(pieces), np.uint8)]
        done: list[bytes] = [b""] * len(pieces)
        rows, columns = np.arange(len(pieces)), np.arange(width)
        ranks = np.full(parts.shape, self.NEVER)
        ranks[:, :-1] = self.merged(parts[:, :-1], parts[:, 1:])
        while len(rows):
            best = ranks.argmin(1)
            value = np.take_along_axis(ranks, best[:, None], 1)[:, 0]
            over = value == self.NEVER
            for k in np.nonzero(over)[0]:
                done[rows[k]] = parts[k][parts[k] >= 0].astype(np.int32).tobytes()
            rows, parts, ranks, best, value = rows[~over], parts[~over], ranks[~over], best[~over], value[~over]
            if not len(rows):
                break
            source = np.minimum(columns + (columns > best[:, None]), width - 1)
            parts[:, -1] = np.where(best == width - 2, -1, parts[:, -1])
            tail = parts[:, -1].copy()
            parts = np.take_along_axis(parts, source, 1)
            ranks = np.take_along_axis(ranks, source, 1)
            at = np.arange(len(rows))
            parts[:, -1] = -1
            ranks[:, -1] = self.NEVER
            if width > 1:
                # what stood last has moved one to the left
                parts[:, -2] = np.where(best < width - 2, tail, parts[:, -2])
                ranks[:, -2] = self.NEVER
            parts[at, best] = value
            right = np.minimum(best + 1, width - 1)
            ranks[at, best] = np.where(best + 1 < width, self.merged(value, parts[at, right]), self.NEVER)
            left = np.maximum(best - 1, 0)
            ranks[at, left] = np.where(best > 0, self.merged(parts[at, left], value), ranks[at, left])
        return done

    def _long(self, piece: bytes) -> bytes:
        """The same for one long piece, with a heap of pairs."""
        n = len(piece)
        parts = self.bytes[np.frombuffer(piece, np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ends = np.arange(1, n + 1).tolist()
        rank = self.ranks.get
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            r, i, end = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if not alive[i] or j >= n or ends[j] != end or rank(piece[i:end]) != r:
                continue
            parts[i], ends[i], alive[j] = r, end, False
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (new := rank(piece[i : ends[k]])) is not None:
                    heapq.heappush(heap, (new, i, ends[k]))
            if (h := before[i]) >= 0 and (new := rank(piece[h:end])) is not None:
                heapq.heappush(heap, (new, h, end))
        return np.array([p for p, a in zip(parts, alive) if a], np.int32).tobytes()

    def pieces(self, distinct: list[bytes]) -> list[bytes]:
        """Ids of each piece, through the cache."""
        if len(self.known) > self.CACHED:
            self.known.clear()
        known, todo = self.known, []
        for piece in distinct:
            if piece not in known:
                if (r := self.ranks.get(piece)) is not None:
                    known[piece] = r.to_bytes(4, "little")
                elif len(piece) > self.ROUNDS_UP_TO:
                    known[piece] = self._long(piece)
                else:
                    todo.append(piece)
        todo.sort(key=len)
        for at in range(0, len(todo), 4096):
            part = todo[at : at + 4096]
            known.update(zip(part, self._rounds(part)))
        return [known[piece] for piece in distinct]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, each id's first byte in its text, and where each text's ids begin (n + 1)."""
        strings = [x or "" for x in texts.to_pylist()]
        text = "".join(strings)
        data = text.encode("utf-8", "surrogatepass")
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        chars = np.array([len(x) for x in strings], np.int64)
        starts = np.concatenate([[0], np.cumsum(chars)])
        at = boundaries(points, np.unique(starts[:-1][chars > 0]))
        places = np.zeros(len(points) + 1, np.int64)
        np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF), out=places[1:])
        ends = np.append(places[at], places[-1]).astype(np.int32)
        encoded = pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(data)]).dictionary_encode()
        merged = self.pieces(encoded.dictionary.to_pylist())
        counts = np.array([len(x) // 4 for x in merged], np.int64)
        table = np.frombuffer(b"".join(merged), "<i4")
        heads = np.cumsum(counts) - counts
        which = encoded.indices.to_numpy()
        each = counts[which]
        total = np.concatenate([[0], np.cumsum(each)])
        ids = table[np.repeat(heads[which] - total[:-1], each) + np.arange(total[-1])]
        begin = total[np.searchsorted(at, starts)] if len(at) else np.zeros(len(starts), np.int64)
        sizes = self.lengths[ids]
        offsets = np.cumsum(sizes) - sizes - np.repeat(places[starts[:-1]], np.diff(begin))
        return ids, offsets, begin

    def decode(self, ids: np.ndarray, begin: np.ndarray) -> list[memoryview]:
        """The bytes of each text."""
        taken = self.strings.take(pa.array(ids))
        if not len(ids):
            return [memoryview(b"")] * (len(begin) - 1)
        ends = np.frombuffer(taken.buffers()[1], np.int32)[: len(ids) + 1]
        data = memoryview(taken.buffers()[2])
        return [data[ends[i] : ends[j]] for i, j in zip(begin[:-1], begin[1:])]


_vocabularies: dict[bytes, Vocabulary] = {}


def vocabulary(lines: bytes) -> Vocabulary:
    """One a process."""
    key = hashlib.sha256(lines).digest()
    if key not in _vocabularies:
        _vocabularies[key] = Vocabulary(lines)
    return _vocabularies[key]


def rank_file(path: str | None = None) -> bytes:
    """The rank file's content, read on the driver; executors get it as a broadcast of under 1 MB."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    with open(path, "rb") as file:
        return file.read()


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids and offsets (each id's first byte in the text) of each row."""
    lines = docs.sparkSession.sparkContext.broadcast(rank_file(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(lines.value)
        for part in slices(batches, "text", SLICE):
            ids, offsets, begin = words.encode(part.column("text"))
            lists = [pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(x.astype(np.int32))) for x in (ids, offsets)]
            yield pa.record_batch([part.column("doc_id"), *lists], ["doc_id", "ids", "offsets"])

    return _narrow(docs).mapInArrow(run, "doc_id long, ids array<int>, offsets array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text (binary) of each row of `encode`."""
    lines = encoded.sparkSession.sparkContext.broadcast(rank_file(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(lines.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lists = part.column("ids")
                begin = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
                texts = words.decode(lists.flatten().to_numpy(zero_copy_only=False), begin)
                yield pa.record_batch([part.column("doc_id"), pa.array([bytes(x) for x in texts], pa.binary())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text binary")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row: encodes, decodes the ids, and keeps digests of both."""
    lines = docs.sparkSession.sparkContext.broadcast(rank_file(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(lines.value)
        for part in slices(batches, "text", SLICE):
            ids, _, begin = words.encode(part.column("text"))
            sums = [hashlib.sha256(memoryview(ids[i:j].astype("<u4"))).hexdigest() for i, j in zip(begin[:-1], begin[1:])]
            back = [hashlib.sha256(x).hexdigest() for x in words.decode(ids, begin)]
            yield pa.record_batch([part.column("doc_id"), pa.array(np.diff(begin)), pa.array(sums), pa.array(back)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _narrow(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
