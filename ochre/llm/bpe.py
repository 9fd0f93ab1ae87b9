"""Byte-level BPE by ranks: ids of whole texts, and texts of ids.

A text is cut into pieces by the pattern of the rank files.  The distinct pieces of a
block are looked up in two tiers.  A piece that is a token as a whole is found by a
minimal perfect hash over the vocabulary and compared byte by byte with what stands
there.  Any other is merged: its bytes are a linked list, a heap holds the pairs that
are tokens, and the pair of least rank (of those, the leftmost) is joined until none is
left, in n log n steps for n bytes.  A worker remembers merged pieces, up to ``MEMORY``.

Each text is encoded by itself, so nothing is shuffled and nothing grows with the
table; a very long text is taken in parts that end before white space, where the
pattern never joins pieces.

Defined results: a null or empty text has no ids, and null or empty ids (or null entries
in them) stand for no bytes; an id that no token has raises; repeated rows and ties are
encoded alike; other columns stay as they are, one with the name of the new column is
replaced; an empty table gives an empty one.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructType

from .common import BLOCK_BYTES, blocks, map_arrow, text_bytes
from .hashing import mixed, piece_hashes, ragged

#: Merged pieces that a worker remembers.
MEMORY = 400_000
#: Bytes of a text that are taken at once, where it can be cut.
PART_BYTES = 4 << 20

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3


@lru_cache(maxsize=1)
def character_classes() -> np.ndarray:
    """The class of each code point: white space, letter, number or other."""
    import regex

    points = np.arange(0x110000, dtype="<u4")
    points = points[(points < 0xD800) | (points > 0xDFFF)]
    text = points.tobytes().decode("utf-32-le")
    kind = np.full(0x110000, OTHER, np.uint8)
    for pattern, k in ((r"\s+", SPACE), (r"\p{L}+", LETTER), (r"\p{N}+", NUMBER)):
        for m in regex.finditer(pattern, text):
            kind[points[m.start() : m.end()]] = k
    return kind


def pieces(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where the pieces of the texts ``data[bounds[i] : bounds[i + 1]]`` start.

    Letters, numbers, white space and the rest go apart, a single space goes with what
    follows it, and an apostrophe that stands alone takes s, t, re, ve, m, ll or d.
    """
    if not len(data):
        return np.zeros(0, np.int64)
    at = np.flatnonzero((data & 0xC0) != 0x80)
    points = data if len(at) == len(data) else np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4")
    kind = character_classes()[points]
    n = len(points)
    ends_text = np.zeros(n + 1, bool)
    ends_text[np.searchsorted(at, bounds)] = True
    ends_text[n] = True
    cut = np.ones(n + 1, bool)
    cut[1:n] = (kind[1:] != kind[:-1]) | ends_text[1:n]
    last = np.flatnonzero((kind == SPACE) & cut[1:] & ~ends_text[1:])  # white space right before something else
    run = cut.copy()
    cut[last] = True
    cut[last[points[last] == 32] + 1] = False
    marks = np.flatnonzero((points == 39) & cut[:-1] & run[1:] & ~ends_text[1:])
    if len(marks):
        marks = marks[run[marks] & (kind[marks + 1] == LETTER)]
        one, two = points[marks + 1], points[np.minimum(marks + 2, n - 1)]
        two = np.where(ends_text[np.minimum(marks + 2, n)], 0, two)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = (np.isin(one, [ord("r"), ord("v")]) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        cut[marks[short | long] + 1] = False
        cut[marks[short] + 2] = True
        cut[marks[long] + 3] = True
    return at[np.flatnonzero(cut[:n])]


class PerfectHash:
    """Numbers distinct 64-bit keys from 0 without gaps.

    Each level has twice as many places as keys are left; a key alone at its place is
    settled there, the others go on to the next level.
    """

    def __init__(self, keys: np.ndarray):
        if len(np.unique(keys)) != len(keys):
            raise ValueError("two tokens have one key")
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        base = 0
        while len(keys):
            size = 2 * len(keys)
            place = self._place(keys, len(self.levels), size)
            alone = np.bincount(place, minlength=size) == 1
            self.levels.append((alone, base + np.cumsum(alone) - alone))
            base += int(alone.sum())
            keys = keys[~alone[place]]

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mixed(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % np.uint64(size)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; some number or -1 for a key that isn't among them."""
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (alone, number) in enumerate(self.levels):
            place = self._place(keys[open_], level, len(alone))
            settled = alone[place]
            out[open_[settled]] = number[place[settled]]
            open_ = open_[~settled]
        return out


_COUNT = list(range(-1, 4096))


def merged(piece: bytes, ids: list[int], pair: list[int], ranks: dict[bytes, int]) -> list[int]:
    """The ids of a piece: least rank first, leftmost of equal ones.

    ``ids`` are those of its bytes and ``pair`` the ranks of each byte with the next, -1
    where that is no token; both are used up.  A heap entry is a rank and a place in one number.
    """
    n = len(piece)
    heap = [r << 32 | i for i, r in enumerate(pair) if r >= 0]
    if not heap:
        return ids
    heapify(heap)
    # the list links: the part that starts at i is followed by one at after[i]
    after, before = (_COUNT[2 : n + 2], _COUNT[:n]) if n < 4000 else (list(range(1, n + 1)), list(range(-1, n - 1)))
    get = ranks.get
    while heap:
        top = heappop(heap)
        i, rank = top & 0xFFFFFFFF, top >> 32
        if pair[i] != rank:
            continue  # one of its parts has been joined to another
        ids[i] = rank
        gone = after[i]
        end = after[i] = after[gone]
        pair[gone] = -1
        if end < n:
            before[end] = i
            r = pair[i] = get(piece[i : after[end]], -1)
            if r >= 0:
                heappush(heap, r << 32 | i)
        else:
            pair[i] = -1
        left = before[i]
        if left >= 0:
            r = pair[left] = get(piece[left:end], -1)
            if r >= 0:
                heappush(heap, r << 32 | left)
    out, i = [], 0
    while i < n:
        out.append(ids[i])
        i = after[i]
    return out


class Ranks:
    """A vocabulary of byte strings by rank, which is the id."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        tokens = sorted(self.ranks, key=self.ranks.get)
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)
        lengths = np.array([len(t) for t in tokens], np.int64)
        starts = np.cumsum(lengths) - lengths
        ids = np.array([self.ranks[t] for t in tokens], np.int64)
        keys = piece_hashes(self.blob, starts, lengths)
        self.hash = PerfectHash(keys)
        slot = self.hash.find(keys)
        self.id, self.at, self.length = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        self.id[slot], self.at[slot], self.length[slot] = ids, starts, lengths
        # by id, for decoding; an id without a token has length 0
        self.token_at, self.token_length = np.zeros(int(ids.max()) + 1, np.int64), np.zeros(int(ids.max()) + 1, np.int64)
        self.token_at[ids], self.token_length[ids] = starts, lengths
        self.byte_id = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.two = np.full(1 << 16, -1, np.int64)
        for token, rank in self.ranks.items():
            if len(token) == 2:
                self.two[token[0] << 8 | token[1]] = rank
        self.memory: dict[bytes, bytes] = {}

    def whole(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """The id of each piece that is a token, else -1."""
        slot = self.hash.find(keys)
        same = (slot >= 0) & (self.length[slot] == lengths)
        own = np.flatnonzero(same)
        if len(own):
            equal = data[ragged(starts[own], lengths[own])] == self.blob[ragged(self.at[slot[own]], lengths[own])]
            same[own] = np.logical_and.reduceat(equal, np.cumsum(lengths[own]) - lengths[own])
        return np.where(same, self.id[slot], -1)

    def encode_block(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts ``data[bounds[i] : bounds[i + 1]]`` one after the other, and where each text's ids start (one more than texts)."""
        starts = pieces(data, bounds)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(bounds), np.int64)
        lengths = np.diff(starts, append=len(data))
        keys = piece_hashes(data, starts, lengths)
        words, first, which = np.unique(keys, return_index=True, return_inverse=True)
        if not (np.array_equal(lengths[first][which], lengths) and np.array_equal(data[ragged(starts[first][which], lengths)], data)):
            words, first, which = keys, np.arange(len(keys)), np.arange(len(keys))  # two pieces with one key: each by itself
        at, size = starts[first], lengths[first]
        found = self.whole(data, at, size, words)
        n = np.ones(len(words), np.int64)
        missed = np.flatnonzero(found < 0)
        more = self._merged(data, at[missed], size[missed])
        n[missed] = [len(x) // 4 for x in more]
        place = np.cumsum(n) - n
        pool = np.zeros(int(n.sum()), np.int32)
        pool[place[found >= 0]] = found[found >= 0]
        pool[ragged(place[missed], n[missed])] = np.frombuffer(b"".join(more), np.int32)
        ends = np.concatenate([[0], np.cumsum(n[which])])
        return pool[ragged(place[which], n[which])], ends[np.searchsorted(starts, bounds)]

    def _merged(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> list[bytes]:
        """The ids of pieces that are no tokens, as bytes of 32-bit numbers."""
        if not len(starts):
            return []
        raw = data.tobytes()
        single = self.byte_id[data]
        pair = np.full(len(data), -1, np.int64)
        pair[:-1] = self.two[data[:-1].astype(np.int64) << 8 | data[1:]]
        out = []
        for a, k in zip(starts.tolist(), lengths.tolist()):
            piece = raw[a : a + k]
            ids = self.memory.get(piece)
            if ids is None:
                last = a + k - 1
                ids = array("i", merged(piece, single[a : last + 1].tolist(), [*pair[a:last].tolist(), -1], self.ranks)).tobytes()
                if len(self.memory) >= MEMORY:
                    self.memory.clear()
                if k <= 256:
                    self.memory[piece] = ids
            out.append(ids)
        return out

    def encode(self, text: str | bytes) -> np.ndarray:
        raw = np.frombuffer(text.encode() if isinstance(text, str) else text, np.uint8)
        return np.concatenate([np.zeros(0, np.int32), *(self.encode_block(raw[a:b], np.array([0, b - a]))[0] for a, b in parts(raw))])

    def decode_block(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of ids, and how many each has."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.token_length) or not self.token_length[ids].all()):
            raise ValueError("an id that no token has")
        lengths = self.token_length[ids]
        return self.blob[ragged(self.token_at[ids], lengths)], lengths


def parts(raw: np.ndarray, most: int = PART_BYTES) -> Iterator[tuple[int, int]]:
    """Cuts a text where white space follows something else, every ``most`` bytes or, where there is none before, later."""
    begin, size = 0, len(raw)
    while size - begin > most:
        space = (raw[begin:] == 32) if size - begin < 2 * most else (raw[begin : begin + 2 * most] == 32)
        ok = np.flatnonzero(space[1:] & (raw[begin : begin + len(space) - 1] > 32) & (raw[begin : begin + len(space) - 1] < 127)) + 1
        early = ok[ok <= most]
        if len(early):
            stop = begin + int(early[-1])
        elif len(ok):
            stop = begin + int(ok[0])
        else:
            stop = size  # nowhere to cut for long: the rest as one
        yield begin, stop
        begin = stop
    if begin < size:
        yield begin, size


@lru_cache(maxsize=2)
def vocabulary_ranks(path: str) -> Ranks:
    return Ranks(path)


def _with(docs: DataFrame, name: str, kind) -> tuple[list[str], StructType]:
    fields = [f for f in docs.schema.fields if f.name != name]
    schema = StructType(fields)
    return [f.name for f in fields], schema.add(name, kind)


def encode_texts(docs: DataFrame, path: str, text: str = "text", into: str = "ids") -> DataFrame:
    """``docs`` with the ids of ``text``; ``path`` is a file of ranks that lies on every machine."""
    kept, schema = _with(docs, into, ArrayType(IntegerType(), False))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = vocabulary_ranks(path)
        for batch in blocks(batches, text):
            data, bounds = text_bytes(batch, text)
            if len(data) > max(PART_BYTES, BLOCK_BYTES):  # one long text
                ids = ranks.encode(data.tobytes())
                ends = np.where(bounds > 0, len(ids), 0)
            else:
                ids, ends = ranks.encode_block(data, bounds)
            column = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], column], names=[*kept, into])

    return map_arrow(docs, encode, schema)


def decode_ids(docs: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``docs`` with the bytes that ``ids`` stand for."""
    kept, schema = _with(docs, into, BinaryType())

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = vocabulary_ranks(path)
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column(ids)
            each = np.nan_to_num(np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), float)).astype(np.int64)  # null: 0
            flat = column.flatten()
            valid = np.asarray(flat.is_valid().to_numpy(zero_copy_only=False))
            data, lengths = ranks.decode_block(flat.drop_null().to_numpy(zero_copy_only=False).astype(np.int64))
            full = np.zeros(len(flat), np.int64)
            full[valid] = lengths
            ends = np.concatenate([[0], np.cumsum(full)])[np.concatenate([[0], np.cumsum(each)])]
            raw = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], raw], names=[*kept, into])

    return map_arrow(docs, decode, schema)
