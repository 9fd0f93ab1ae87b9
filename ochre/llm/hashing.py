"""Vectorised hashes of the pieces of a byte buffer."""

from __future__ import annotations

import numpy as np

_POWER = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)


def _powers_to(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = 1 << max(10, (n - 1).bit_length())
        with np.errstate(over="ignore"):
            _powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, _POWER)]))
    return _powers


def mixed(h: np.ndarray) -> np.ndarray:
    """Each 64-bit value with its bits spread over all places."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def piece_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``data[s : s + n]`` for pieces in ascending order that don't overlap; all lengths over 0."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    ends = starts + lengths
    total = int(lengths.sum())
    if total != ends[-1] - starts[0]:  # gaps between pieces are left out first
        step = np.ones(total, np.int64)
        heads = np.cumsum(lengths) - lengths
        step[heads[0]] = starts[0]
        step[heads[1:]] = starts[1:] - ends[:-1] + 1
        data, starts = data[np.cumsum(step)], heads
    else:
        data, starts = data[starts[0] : ends[-1]], starts - starts[0]
    step = np.ones(total, np.int64)
    step[0] = 0
    step[starts[1:]] = 1 - lengths[:-1]
    within = np.cumsum(step)
    with np.errstate(over="ignore"):
        value = _powers_to(int(lengths.max()))[within] * (data.astype(np.uint64) + np.uint64(1))
        return mixed(np.add.reduceat(value, starts) + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices of all pieces one after the other."""
    lengths = lengths.astype(np.int64)
    full = lengths > 0
    starts, lengths = starts[full].astype(np.int64), lengths[full]
    if not len(starts):
        return np.zeros(0, np.int64)
    step = np.ones(int(lengths.sum()), np.int64)
    heads = np.cumsum(lengths) - lengths
    step[0] = starts[0]
    step[heads[1:]] = starts[1:] - starts[:-1] - lengths[:-1] + 1
    return np.cumsum(step)


#: Classes of bytes: 0 separates, 1 is part of a word, 2 is punctuation.
_KIND = np.ones(256, np.int8)
_KIND[:33] = 0
_KIND[[b for b in range(33, 128) if not chr(b).isalnum()]] = 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def runs(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of word bytes and of punctuation in texts that lie one after the other: starts, lengths, and the number of the text."""
    kind = _KIND[data]
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[bounds] = True
    starts = np.flatnonzero(edge[:-1])
    lengths = np.diff(np.flatnonzero(edge))
    mine = kind[starts] > 0
    starts, lengths = starts[mine], lengths[mine]
    return starts, lengths, np.searchsorted(bounds, starts, "right") - 1


#: What separates words where only white space does: bytes 9 to 13 and the space.
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def spaced_words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs without bytes 9 to 13 and spaces: starts, lengths, and the number of the text."""
    inside = ~_BLANK[data]
    padded = np.zeros(len(data) + 1, bool)
    padded[:-1] = inside
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = bounds[:-1][np.diff(bounds) > 0]
    begins[heads] = inside[heads]
    starts = np.flatnonzero(begins)
    stops = padded.copy()
    stops[1:] = padded[:-1] & ~padded[1:]
    stops[0] = False
    inner = bounds[(bounds > 0) & (bounds < len(data))]
    stops[inner] |= inside[inner - 1]
    ends = np.flatnonzero(stops)
    return starts, ends - starts, np.searchsorted(bounds, starts, "right") - 1
