"""A FLAC codec on numpy.

The encoder writes one-channel streams of constant, verbatim and fixed-predictor
frames (orders 0 to 4, each with one Rice parameter or one for each of its partitions,
whichever is shorter), and a seek point for every frame.  With seek points the decoder
parses many frames side by side: the place of each sample's stop bit depends on the one
before it, so samples are taken in step, one vector operation over all frames at a time,
and residuals are summed by columns.  Any other stream (several channels, escapes, linear
prediction with quantised coefficients, wasted bits) is read frame by frame.

Both work on ``GROUP_BYTES`` of frames at a time, so a long stream takes no more working
memory than short ones.  Every frame's CRC-8 and CRC-16 are verified, and the stream's
MD5 over the samples.
"""

from __future__ import annotations

import hashlib
import struct
from functools import lru_cache
from typing import NamedTuple

import numpy as np

BLOCK = 4096
RATE = 8000
#: Bytes of frames that are coded at once.
GROUP_BYTES = 1 << 20
#: Samples of a Rice partition, at least, and the highest order of a fixed predictor.
PARTITION, MOST_ORDER = 64, 4
#: Frames that are decoded in step.
SIDE_BY_SIDE = 256
#: Fixed values of the format: block-size codes, sample-rate codes, sample-size codes.
BLOCK_SIZES = {1: 192, 2: 576, 3: 1152, 4: 2304, 5: 4608, **{8 + i: 256 << i for i in range(8)}}
SAMPLE_RATES = {1: 88200, 2: 176400, 3: 192000, 4: 8000, 5: 16000, 6: 22050, 7: 24000, 8: 32000, 9: 44100, 10: 48000, 11: 96000}
SAMPLE_SIZES = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}
#: Fixed values of the format: weights of the fixed predictors.
FIXED = {0: (), 1: (1,), 2: (2, -1), 3: (3, -3, 1), 4: (4, -6, 4, -1)}


class FlacError(ValueError):
    """A stream that is broken or not FLAC."""


def _crc_table(poly: int, bits: int) -> np.ndarray:
    table = np.arange(256, dtype=np.uint32) << (bits - 8)
    for _ in range(8):
        table = np.where(table >> (bits - 1) & 1, table << 1 ^ poly, table << 1) & ((1 << bits) - 1)
    return table


_CRC8 = _crc_table(0x07, 8).tolist()
_CRC16 = _crc_table(0x8005, 16).astype(np.uint16)
_by_distance = _CRC16[None, :]


def crc8(data: bytes) -> int:
    value = 0
    for byte in data:
        value = _CRC8[value ^ byte]
    return value


def crc16_all(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, tail: int = 0) -> np.ndarray:
    """CRC-16 of adjoining pieces of ``data``, less the last ``tail`` bytes of each: a byte's share depends on its distance from the end alone."""
    global _by_distance
    longest = int(lengths.max())
    if len(_by_distance) < longest:
        rows = [_by_distance[-1]]
        for _ in range(longest - len(_by_distance)):
            last = rows[-1]
            rows.append((last << np.uint16(8)) ^ _CRC16[last >> np.uint16(8)])
        _by_distance = np.concatenate([_by_distance, np.array(rows[1:], np.uint16)])
    stop = starts[-1] + lengths[-1]
    distance = np.repeat(starts + lengths - 1 - tail, lengths) - np.arange(starts[0], stop)
    share = _by_distance[np.maximum(distance, 0), data[starts[0] : stop]]
    share[distance < 0] = 0
    return np.bitwise_xor.reduceat(share, starts - starts[0])


@lru_cache(maxsize=1 << 16)
def _frame_header(number: int, size: int) -> bytes:
    code = 12 if size == BLOCK else 7
    head = bytes([0xFF, 0xF8, code << 4 | 4, 1 << 1]) + chr(number).encode("utf-8", "surrogatepass") + (b"" if size == BLOCK else struct.pack(">H", size - 1))
    return head + bytes([crc8(head)])


def encode(data: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """One stream for each of ``data[bounds[i] : bounds[i + 1]]``; bytes are samples less 128.  No piece is empty."""
    sizes = np.diff(bounds)
    frames = -(-sizes // BLOCK)
    doc = np.repeat(np.arange(len(sizes)), frames)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(frames) - frames, frames)
    start = bounds[doc] + number * BLOCK
    size = np.minimum(BLOCK, bounds[doc + 1] - start)
    coded = [_encode_frames(data, number[a:b], start[a:b], size[a:b]) for a, b in _groups(size)]
    out = np.concatenate([c for c, _ in coded]) if coded else np.zeros(0, np.uint8)
    length = np.concatenate([n for _, n in coded]) if coded else np.zeros(0, np.int64)
    at = np.cumsum(length) - length
    raw = (data ^ 0x80).astype(np.uint8)

    streams, frame = [], 0
    for i, n in enumerate(frames.tolist()):
        a, b = frame, frame + n
        piece = raw[bounds[i] : bounds[i + 1]]
        info = struct.pack(">HH", BLOCK, BLOCK) + bytes(6) + (RATE << 44 | 0 << 41 | 7 << 36 | len(piece)).to_bytes(8, "big") + hashlib.md5(piece.tobytes()).digest()
        points = np.zeros(n, [("sample", ">u8"), ("offset", ">u8"), ("size", ">u2")])
        points["sample"], points["offset"], points["size"] = number[a:b] * BLOCK, at[a:b] - at[a], size[a:b]
        table = points.tobytes()
        streams.append(b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(table).to_bytes(3, "big") + table + out[at[a] : at[b - 1] + length[b - 1]].tobytes())
        frame = b
    return streams


def _groups(size: np.ndarray) -> list[tuple[int, int]]:
    """Cuts frames into runs of at most ``GROUP_BYTES``; a larger one stands alone."""
    total, out, a = np.concatenate([[0], np.cumsum(size)]), [], 0
    while a < len(size):
        b = max(a + 1, int(np.searchsorted(total, total[a] + GROUP_BYTES, "right")) - 1)
        out.append((a, b))
        a = b
    return out


def _rice(folded: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The better of two likely Rice parameters for each run of folded residuals, and the bits that takes."""
    mean = np.add.reduceat(folded, first) / count
    low = np.clip(np.floor(np.log2(np.maximum(mean * 0.6931, 1.0))), 0, 13).astype(np.int32)
    bits = np.stack([count * (k + 1) + np.add.reduceat(folded >> np.repeat(k, count), first) for k in (low, low + 1)])
    return low + bits.argmin(axis=0).astype(np.int32), bits.min(axis=0)


def _encode_frames(data: np.ndarray, number: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of adjoining frames, and each one's length."""
    data = data[start[0] : start[-1] + size[-1]]
    start = start - start[0]
    x = data.astype(np.int32) - 128

    # residuals of the fixed predictors; a frame's first samples don't count
    within = np.arange(len(x), dtype=np.int32) - np.repeat(start, size).astype(np.int32)
    residuals, cost = [x], [np.add.reduceat(np.abs(x), start)]
    for order in range(1, MOST_ORDER + 1):
        residuals.append(np.diff(residuals[-1], prepend=0))
        cost.append(np.add.reduceat(np.abs(residuals[-1]) * (within >= order), start))
    order = np.where(size > MOST_ORDER, np.stack(cost).argmin(axis=0), 0)
    constant = cost[1] == 0
    chosen = np.repeat(order, size)
    residual = np.select([chosen == k for k in range(MOST_ORDER)], residuals[:-1], residuals[-1])[within >= chosen]
    del residuals
    folded = (residual << 1) ^ (residual >> 31)
    count = size - order
    first = np.cumsum(count) - count
    k, bits = _rice(folded, first, count)
    bits = bits + 4

    # the same with as many partitions as halves of the frame allow
    parts = np.zeros(len(size), np.int64)
    for p in range(1, 7):
        parts[(size % (PARTITION << p) == 0) & (size >= PARTITION << p)] = p
    pieces = np.repeat(size >> parts, 1 << parts)
    head_of = np.cumsum(1 << parts) - (1 << parts)
    pieces[head_of] -= order
    piece_at = np.cumsum(pieces) - pieces
    fine_k, fine_bits = _rice(folded, piece_at, pieces)
    fine = np.add.reduceat(fine_bits + 4, head_of)
    split = (parts > 0) & (fine < bits)
    bits = np.where(split, fine, bits)
    parts = np.where(split, parts, 0)
    each = np.repeat(split, count)
    k_each = np.where(each, np.repeat(fine_k, pieces), np.repeat(k, count))
    opens = np.zeros(len(folded), bool)
    opens[piece_at] = True
    opens &= each
    opens[first] = True

    verbatim = ~constant & (6 + bits + 8 * order >= 8 * size)
    coded = ~constant & ~verbatim
    heads = [_frame_header(n, s) for n, s in zip(number.tolist(), size.tolist())]
    head = np.array([len(h) for h in heads], np.int64)
    body = np.where(constant, 2, np.where(verbatim, 1 + size, 1 + order + (6 + bits + 7) // 8))
    length = head + body + 2
    at = np.cumsum(length) - length
    out_bits = np.zeros(int(length.sum()) * 8, np.uint8)
    mine = np.repeat(coded, count)
    k_each, folded, opens = k_each[mine], folded[mine], opens[mine]
    quotient = folded >> k_each
    ends = np.cumsum(quotient + 1 + k_each + 4 * opens, dtype=np.int64)
    n_coded = count[coded]
    base = (at + head + 1 + order)[coded] * 8 + 6
    begun = np.concatenate([[0], ends])[np.cumsum(n_coded) - n_coded]
    ends += np.repeat(base - begun, n_coded)
    out_bits[ends - k_each - 1] = 1
    for b in range(int(k_each.max()) if len(k_each) else 0):
        has = k_each > b
        out_bits[ends[has] - 1 - b] = folded[has] >> b & 1
    opening, own_k = (ends - k_each - quotient - 1)[opens], k_each[opens]
    for b in range(4):
        out_bits[opening - 1 - b] = own_k >> b & 1
        out_bits[base - 1 - b] = parts[coded] >> b & 1
    out = np.packbits(out_bits)
    del out_bits

    for i, h in enumerate(heads):
        out[at[i] : at[i] + len(h)] = np.frombuffer(h, np.uint8)
    sub = at + head
    out[sub] = np.where(constant, 0, np.where(verbatim, 1 << 1, (8 | order) << 1))
    raw = (data ^ 0x80).astype(np.uint8)
    out[sub[constant] + 1] = raw[start[constant]]
    for j in range(MOST_ORDER):
        warm = coded & (order > j)
        out[sub[warm] + 1 + j] = raw[start[warm] + j]
    for i in np.flatnonzero(verbatim):
        out[sub[i] + 1 : sub[i] + 1 + size[i]] = raw[start[i] : start[i] + size[i]]
    crc = crc16_all(out, at, length, tail=2)
    out[at + length - 2], out[at + length - 1] = crc >> 8, crc & 0xFF
    return out, length


class Info(NamedTuple):
    rate: int
    channels: int
    bits: int
    samples: int
    md5: bytes
    points: np.ndarray
    frames_at: int


def read_info(stream: bytes) -> Info:
    """The metadata of a stream and where its frames start."""
    if stream[:4] != b"fLaC":
        raise FlacError("no FLAC stream")
    at, last, info, points = 4, False, None, np.zeros(0, [("sample", ">u8"), ("offset", ">u8"), ("size", ">u2")])
    while not last:
        kind, size = stream[at], int.from_bytes(stream[at + 1 : at + 4], "big")
        last, kind, own = bool(kind & 0x80), kind & 0x7F, stream[at + 4 : at + 4 + size]
        if kind == 0:
            packed = int.from_bytes(own[10:18], "big")
            info = (packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1, own[18:34])
        elif kind == 3:
            points = np.frombuffer(own, points.dtype)
            points = points[points["sample"] != (1 << 64) - 1]
        at += 4 + size
    if info is None:
        raise FlacError("no stream info")
    return Info(*info, points, at)


def decode_blocks(streams: list[bytes]) -> list[tuple[Info, list[int], list[np.ndarray]]]:
    """Of each stream what it says of itself, the first sample of each frame, and the frames' samples: one row a sample, one column a channel."""
    infos = [read_info(s) for s in streams]
    out: list = [None] * len(streams)
    fast = [i for i, (s, m) in enumerate(zip(streams, infos)) if m.channels == 1 and m.bits == 8 and len(m.points) and int(m.points["size"].astype(np.int64).sum()) == m.samples]
    for i, samples in zip(fast, _decode_seekable([streams[i] for i in fast], [infos[i] for i in fast])):
        if samples is not None:
            firsts = infos[i].points["sample"].astype(np.int64).tolist()
            out[i] = (infos[i], firsts, [samples[a:b] for a, b in zip(firsts, [*firsts[1:], len(samples)])])
    for i, m in enumerate(infos):
        if out[i] is None:
            found = list(frames(streams[i], m))
            out[i] = (m, [first for first, _ in found], [block for _, block in found])
        if m.md5 != bytes(16):
            md5 = hashlib.md5()
            for block in out[i][2]:
                md5.update(as_pcm(block, m.bits))
            if md5.digest() != m.md5:
                raise FlacError("the samples' MD5 differs")
    return out


def decode(streams: list[bytes]) -> list[np.ndarray]:
    """The samples of each stream: one row a sample, one column a channel."""
    return [np.concatenate([np.zeros((0, m.channels), np.int16), *blocks]) for m, _, blocks in decode_blocks(streams)]


def as_pcm(samples: np.ndarray, bits: int) -> bytes:
    """Little-endian whole bytes, channels side by side."""
    width = (bits + 7) // 8
    if width in (1, 2, 4):
        return samples.astype(f"<i{width}").tobytes()
    return samples.astype("<i4").view(np.uint8).reshape(*samples.shape, 4)[..., :width].tobytes()


def _decode_seekable(streams: list[bytes], infos: list[Info]) -> list[np.ndarray | None]:
    """The samples of each stream, its frames read side by side; None for streams with a frame of another kind than ``encode`` writes."""
    if not streams:
        return []
    data = np.frombuffer(b"".join(s[m.frames_at :] for s, m in zip(streams, infos)), np.uint8)
    sizes = np.array([len(s) - m.frames_at for s, m in zip(streams, infos)], np.int64)
    base = np.cumsum(sizes) - sizes
    n = np.array([len(m.points) for m in infos])
    doc = np.repeat(np.arange(len(streams)), n)
    at = base[doc] + np.concatenate([m.points["offset"].astype(np.int64) for m in infos])
    size = np.concatenate([m.points["size"].astype(np.int64) for m in infos])
    length = np.diff(at, append=len(data))
    if (length < 4).any():
        raise FlacError("a seek point is out of place")
    number = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    start = np.cumsum(size) - size
    x = np.zeros(int(size.sum()), np.int16)
    odd = np.zeros(len(streams), bool)
    for a, b in _groups(length):
        bad = _decode_frames(data, at[a:b], length[a:b], number[a:b], size[a:b], start[a:b], x)
        odd[doc[a:b][bad]] = True
    ends = np.cumsum(n)
    return [None if odd[i] else x[start[b - m] : start[b - 1] + size[b - 1], None] for i, (b, m) in enumerate(zip(ends.tolist(), n.tolist()))]


def _decode_frames(data, at, length, number, size, start, x) -> np.ndarray:
    """Decodes frames into ``x``; returns which of them are of another kind."""
    if crc16_all(data, at, length).any():
        raise FlacError("a frame's CRC-16 differs")
    head = np.zeros(len(at), np.int64)
    odd = np.zeros(len(at), bool)
    raw = data[at[0] : at[-1] + length[-1]].tobytes()
    for i, (a, k, s) in enumerate(zip((at - at[0]).tolist(), number.tolist(), size.tolist())):
        expected = _frame_header(k, s)
        head[i] = len(expected)
        odd[i] = raw[a : a + len(expected)] != expected  # a header in another way, or broken: its CRC-8 is checked frame by frame
    sub = np.minimum(at + head, len(data) - 1)
    kind, wasted = data[sub] >> 1 & 0x3F, data[sub] & 1
    order = np.where(kind & 0x38 == 8, kind & 7, 0).astype(np.int64)
    fixed = (kind & 0x38 == 8) & (order <= MOST_ORDER)
    rice = np.minimum(sub + 1 + order, len(data) - 1)
    parts = (data[rice] >> 2 & 15).astype(np.int64)
    plain = (data[rice] >> 6 == 0) & (size % (1 << parts) == 0) & (size >> parts > order)
    odd |= (wasted == 1) | ~((kind <= 1) | fixed & plain)

    signed = data.view(np.int8)
    for i in np.flatnonzero(~odd & (kind == 0)).tolist():
        x[start[i] : start[i] + size[i]] = signed[sub[i] + 1]
    for i in np.flatnonzero(~odd & (kind == 1)).tolist():
        x[start[i] : start[i] + size[i]] = signed[sub[i] + 1 : sub[i] + 1 + size[i]]
    coded = np.flatnonzero(~odd & fixed)
    coded = coded[np.argsort(-(size[coded] - order[coded]), kind="stable")]
    for own in (coded[i : i + SIDE_BY_SIDE] for i in range(0, len(coded), SIDE_BY_SIDE)):
        odd[own] = _decode_group(data, at[own], length[own], rice[own], parts[own], size[own], order[own], signed, sub[own] + 1, start[own], x)
    return odd


def _decode_group(data, at, length, rice, parts, size, order, signed, warm_at, start, x) -> np.ndarray:
    """Rice residuals and fixed predictors of some frames, most samples first, into ``x``; returns which frames have an escape."""
    own = np.concatenate([data[a : a + n] for a, n in zip(at.tolist(), length.tolist())] + [np.zeros(3, np.uint8)])
    offset = np.cumsum(length) - length
    bits = np.unpackbits(own)
    following = np.where(bits, np.arange(len(bits), dtype=np.int32), np.int32(len(bits) - 1))[::-1]
    following = np.ascontiguousarray(np.minimum.accumulate(following)[::-1])  # the next set bit
    del bits
    wide = own.astype(np.int32)
    window = np.zeros(len(own), np.int32)  # 24 bits from each byte on
    window[:-2] = wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:]

    def number(place: np.ndarray, n) -> np.ndarray:
        return (window.take(place >> 3, mode="clip") >> (24 - (place & 7) - n)) & ((1 << n) - 1)

    count = size - order
    most = int(count[0])
    p = ((offset + rice - at) * 8 + 6).astype(np.int32)
    stops, begins = np.zeros((most, len(at)), np.int32), np.zeros((most, len(at)), np.int32)
    k_of = np.zeros((most, len(at)), np.int8)
    step, escaped = np.zeros(len(at), np.int32), np.zeros(len(at), bool)
    # where partitions begin: all frames at the first residual, then those with several
    frame = np.repeat(np.arange(len(at)), (1 << parts) - 1)
    nth = np.arange(len(frame)) - np.repeat(np.cumsum((1 << parts) - 1) - (1 << parts) + 1, (1 << parts) - 1) + 1
    opens = nth * (size >> parts)[frame] - order[frame]
    by_step = np.argsort(opens, kind="stable")
    opens, frame = opens[by_step], frame[by_step]
    edges = [0, *(np.flatnonzero(np.diff(opens)) + 1).tolist(), len(opens)] if len(opens) else [0]
    later = {int(opens[a]): frame[a:b] for a, b in zip(edges[:-1], edges[1:])}
    active = np.searchsorted(-count, -np.arange(most), "left")  # frames with more samples than this
    for i, m in enumerate(active.tolist()):
        new = slice(None) if i == 0 else later.get(i)
        if new is not None:
            k = number(p[new], 4)
            escaped[new] |= k == 15
            p[new] += 4
            step[new] = k + 1
        begins[i, :m] = p[:m]
        row = stops[i, :m]
        following.take(p[:m], 0, row, "clip")
        np.add(row, step[:m], p[:m])
        k_of[i, :m] = step[:m]
    k_of -= 1
    valid = np.arange(most)[:, None] < count
    k = np.where(valid, k_of, 0).astype(np.int32)
    folded = np.where(valid, stops - begins, 0) << k | number(stops + 1, k)
    del begins, stops, k, k_of
    value = np.where(valid, (folded >> 1) ^ -(folded & 1), 0)
    warm = np.stack([signed[np.minimum(warm_at + j, len(signed) - 1)].astype(np.int32) for j in range(MOST_ORDER)])
    for o in range(1, MOST_ORDER + 1):
        same = np.flatnonzero(order == o)
        if not len(same):
            continue
        levels = [warm[:o, same]]
        for _ in range(o - 1):
            levels.append(np.diff(levels[-1], axis=0))
        part = value[:, same]
        for level in reversed(levels):
            part = np.cumsum(part, axis=0, dtype=np.int32) + level[-1]
        value[:, same] = part
    for i, (a, o, n) in enumerate(zip(start.tolist(), order.tolist(), count.tolist())):
        x[a : a + o] = warm[:o, i]
        x[a + o : a + o + n] = value[:n, i]
    return escaped


class _Bits:
    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, at * 8

    def take(self, n: int) -> int:
        if not n:
            return 0
        a, b = self.at >> 3, (self.at + n + 7) >> 3
        if b > len(self.data):
            raise FlacError("the stream ends early")
        value = int.from_bytes(self.data[a:b], "big") >> (b * 8 - self.at - n) & (1 << n) - 1
        self.at += n
        return value

    def signed(self, n: int) -> int:
        value = self.take(n)
        return value - (1 << n) if n and value >> (n - 1) else value

    def unary(self) -> int:
        n = 0
        while not self.take(1):
            n += 1
        return n


def frames(stream: bytes, info: Info | None = None):
    """(first sample, samples by channel) of each frame in turn, for any stream."""
    info = info or read_info(stream)
    at, sample = info.frames_at, 0
    while at < len(stream) and (not info.samples or sample < info.samples):
        block, at = _frame(stream, at, info)
        yield sample, block
        sample += len(block)


def block_at(stream: bytes, sample: int) -> tuple[int, np.ndarray]:
    """The frame that holds ``sample``, reached by the nearest seek point before it: (its first sample, samples)."""
    info = read_info(stream)
    before = info.points[info.points["sample"] <= sample]
    at, first = (info.frames_at + int(before["offset"][-1]), int(before["sample"][-1])) if len(before) else (info.frames_at, 0)
    while True:
        block, at = _frame(stream, at, info)
        if first <= sample < first + len(block):
            return first, block
        first += len(block)


def _frame(stream: bytes, at: int, info: Info) -> tuple[np.ndarray, int]:
    bits = _Bits(stream, at)
    if bits.take(15) != 0x7FFC:
        raise FlacError("no frame here")
    bits.take(1)
    size_code, rate_code, channel_code, bits_code = bits.take(4), bits.take(4), bits.take(4), bits.take(3)
    bits.take(1)
    lead = bits.take(8)
    extra = 0 if lead < 0x80 else 6 - (lead ^ 0xFF).bit_length() + 1
    bits.take(8 * max(0, extra))
    size = bits.take(8) + 1 if size_code == 6 else bits.take(16) + 1 if size_code == 7 else BLOCK_SIZES[size_code]
    bits.take({12: 8, 13: 16, 14: 16}.get(rate_code, 0))
    if crc8(stream[at : bits.at >> 3]) != bits.take(8):
        raise FlacError("a frame's CRC-8 differs")
    depth = SAMPLE_SIZES.get(bits_code, info.bits)
    n = channel_code + 1 if channel_code < 8 else 2
    wide = {8: (0, 1), 9: (1, 0), 10: (0, 1)}.get(channel_code, (0,) * n)
    sub = [_subframe(bits, size, depth + w) for w in wide]
    if channel_code == 8:
        sub[1] = sub[0] - sub[1]
    elif channel_code == 9:
        sub[0] = sub[0] + sub[1]
    elif channel_code == 10:
        middle = sub[0] << 1 | sub[1] & 1
        sub = [(middle + sub[1]) >> 1, (middle - sub[1]) >> 1]
    bits.at = bits.at + 7 & ~7
    end = (bits.at >> 3) + 2
    if end > len(stream) or crc16_all(np.frombuffer(stream[at:end], np.uint8), np.array([0]), np.array([end - at]))[0]:
        raise FlacError("a frame's CRC-16 differs")
    return np.stack(sub, axis=1), end


def _subframe(bits: _Bits, size: int, depth: int) -> np.ndarray:
    if bits.take(1):
        raise FlacError("a subframe's first bit is set")
    kind = bits.take(6)
    wasted = bits.unary() + 1 if bits.take(1) else 0
    depth -= wasted
    if kind == 0:
        x = np.full(size, bits.signed(depth), np.int64)
    elif kind == 1:
        x = np.array([bits.signed(depth) for _ in range(size)], np.int64)
    elif kind & 0x38 == 8 and kind & 7 <= 4:
        order = kind & 7
        warm = [bits.signed(depth) for _ in range(order)]
        x = predicted(warm, _residual(bits, size, order), FIXED[order], 0)
    elif kind & 0x20:
        order = (kind & 31) + 1
        warm = [bits.signed(depth) for _ in range(order)]
        precision, shift = bits.take(4) + 1, bits.signed(5)
        weights = tuple(bits.signed(precision) for _ in range(order))
        x = predicted(warm, _residual(bits, size, order), weights, shift)
    else:
        raise FlacError("a reserved subframe type")
    return x << wasted


def predicted(warm: list[int], residual: list[int], weights: tuple[int, ...], shift: int) -> np.ndarray:
    """Samples from a linear predictor over the last samples, latest first, and what it missed."""
    x = list(warm)
    for r in residual:
        x.append(r + (sum(w * v for w, v in zip(weights, reversed(x[len(x) - len(weights) :]))) >> shift))
    return np.array(x, np.int64)


def _residual(bits: _Bits, size: int, order: int) -> list[int]:
    wide = {0: 4, 1: 5}.get(bits.take(2))
    if wide is None:
        raise FlacError("a reserved residual coding")
    parts = bits.take(4)
    out: list[int] = []
    for i in range(1 << parts):
        n, k = (size >> parts) - (order if i == 0 else 0), bits.take(wide)
        if k == (1 << wide) - 1:
            raw = bits.take(5)
            out += [bits.signed(raw) for _ in range(n)]
        else:
            for _ in range(n):
                folded = bits.unary() << k | bits.take(k)
                out.append(folded >> 1 ^ -(folded & 1))
    return out
