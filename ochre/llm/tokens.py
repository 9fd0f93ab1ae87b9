"""Byte-level BPE ids from the tokenizers library, with a bounded memory of words."""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

from .hashing import piece_hashes, ragged

#: Words whose ids a worker remembers, at about 45 bytes each.
CACHE_WORDS = 1_000_000
#: Bytes after which a space may not be cut off: white space, and what starts white space of several bytes.
_LEADS = np.ones(256, bool)
_LEADS[:33] = False
_LEADS[[0xC2, 0xE1, 0xE2, 0xE3]] = False


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Where a public vocabulary lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Collision(Exception):
    """Two words have one key."""


class WordwiseEncoder:
    """Ids of whole texts, by cutting before single spaces.

    The byte-level pattern starts a new piece at every single space that a visible
    character follows, and merges never cross pieces, so a text's ids are those of
    its space-led words in turn.  The vocabulary's added tokens, such as <|endoftext|>,
    are cut out first, as the library does.  The library encodes each word once.  Words
    are found by a 64-bit key and compared byte by byte with what the key stands for;
    where two words share a key, the block is encoded text by text instead.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        added = sorted((t.content for t in self.library.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.added = re.compile(b"|".join(re.escape(t.encode()) for t in added)) if added else None
        size = self.library.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        # each letter of a byte-level token stands for one byte
        self.width = np.array([len(self.library.id_to_token(i) or "") for i in range(size)], np.int64)
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at, self.n = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.ids = np.zeros(0, self.dtype)
        self.bytes, self.byte_at, self.size = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, text: str) -> np.ndarray:
        raw = np.frombuffer(text.encode(), np.uint8)
        return self.encode_block(raw, np.array([0, len(raw)]))[0]

    def encode_block(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts ``data[bounds[i] : bounds[i + 1]]`` one after the other, and where each text's ids start (one more than texts)."""
        if not len(data):
            return np.zeros(0, self.dtype), np.zeros(len(bounds), np.int64)
        try:
            return self._by_words(data, bounds)
        except Collision:
            texts = [data[a:b].tobytes().decode() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            found = [np.array(x.ids, self.dtype) for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]
            return np.concatenate(found), np.concatenate([[0], np.cumsum([len(x) for x in found])])

    def _by_words(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = len(data)
        cut = np.zeros(size, bool)
        cut[:-1] = (data[:-1] == 32) & _LEADS[data[1:]]
        spans = self._added_tokens(data, bounds)
        edges = np.unique(np.concatenate([bounds, spans.ravel()]))
        cut[edges[edges > 0] - 1] = False
        for a, b in spans.tolist():
            cut[a:b] = False
        cut[edges[edges < size]] = True
        starts = np.flatnonzero(cut)
        lengths = np.diff(starts, append=size)
        prefix = self._first_bytes(data, starts, lengths)
        keys = piece_hashes(data, starts, lengths) ^ (prefix * np.uint64(0x9FB21C651E98DF25))
        words, first, which = np.unique(keys, return_index=True, return_inverse=True)
        if not (np.array_equal(lengths[first][which], lengths) and np.array_equal(data[ragged(starts[first][which], lengths)], data)):
            raise Collision
        at, n = self._known(words, data, starts[first], lengths[first])
        out = self.ids[ragged(at[which], n[which])]
        ends = np.concatenate([[0], np.cumsum(n[which].astype(np.int64))])
        return out, ends[np.searchsorted(starts, bounds)]

    def _added_tokens(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Where added tokens start and end, a row each."""
        spans: list[tuple[int, int]] = []
        raw = data.tobytes()
        if self.added and self.added.search(raw):
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):  # none stands across two texts
                spans += [m.span() for m in self.added.finditer(raw, a, b)]
        return np.array(spans, np.int64).reshape(-1, 2)

    @staticmethod
    def _first_bytes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        whole = np.lib.stride_tricks.sliding_window_view(padded, 8)[starts].copy().view("<u8")[:, 0]
        short = np.minimum(lengths, 8).astype(np.uint64) * np.uint64(8)
        mask = np.where(short >= 64, ~np.uint64(0), (np.uint64(1) << (short % np.uint64(64))) - np.uint64(1))
        return whole & mask

    def _known(self, words: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each word lie and how many; encodes those not met before."""
        place = np.searchsorted(self.keys, words)
        known = np.zeros(len(words), bool)
        inside = place < len(self.keys)
        known[inside] = self.keys[place[inside]] == words[inside]
        new = ~known
        if known.any():
            own = place[known]
            if not (np.array_equal(self.size[own], lengths[known]) and np.array_equal(self.bytes[ragged(self.byte_at[own], lengths[known])], data[ragged(starts[known], lengths[known])])):
                raise Collision
        if new.any():
            if len(self.keys) + int(new.sum()) > CACHE_WORDS and known.any():
                self._forget()
                return self._known(words, data, starts, lengths)
            at, n = self._learn(data, starts[new], lengths[new])
            where = place[new]
            self.byte_at = np.insert(self.byte_at, where, len(self.bytes) + np.cumsum(lengths[new]) - lengths[new])
            self.bytes = np.concatenate([self.bytes, data[ragged(starts[new], lengths[new])]])
            self.keys, self.at, self.n, self.size = (np.insert(old, where, more) for old, more in ((self.keys, words[new]), (self.at, at), (self.n, n), (self.size, lengths[new])))
            place = np.searchsorted(self.keys, words)
        return self.at[place], self.n[place]

    def _learn(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encodes words in one call; each word's ids are cut out by the bytes that tokens stand for."""
        led = data[starts] == 32
        led &= (lengths > 1) & _LEADS[data[np.minimum(starts + 1, len(data) - 1)]]
        at, n, base = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int32), len(self.ids)
        found = [self.ids]
        if led.any():
            text = data[ragged(starts[led], lengths[led])].tobytes().decode()
            ids = np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)
            stops = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum(lengths[led])) + 1
            n[led] = np.diff(stops, prepend=0)
            at[led] = base + stops - n[led]
            found.append(ids.astype(self.dtype))
            base += len(ids)
        if not led.all():  # words that start their text
            own = np.flatnonzero(~led)
            texts = [data[a : a + k].tobytes().decode() for a, k in zip(starts[own].tolist(), lengths[own].tolist())]
            for i, x in zip(own.tolist(), self.library.encode_batch_fast(texts, add_special_tokens=False)):
                at[i], n[i] = base, len(x.ids)
                found.append(np.array(x.ids, self.dtype))
                base += len(x.ids)
        self.ids = np.concatenate(found)
        return at, n


@lru_cache(maxsize=2)
def encoder(path: str) -> WordwiseEncoder:
    return WordwiseEncoder(path)
