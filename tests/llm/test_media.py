import hashlib
import tracemalloc
import zlib

import numpy as np
import pytest
from corpora import documents, empty, odd_texts
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ochre.llm import flac, media


def padded(raw):
    return raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))


def feature_by_hand(payload):
    x = [b - 128 for b in payload]
    pairs = list(zip(x, x[1:]))
    return f"n={len(x)};peak={max(map(abs, x))};sum={sum(x)};energy={sum(v * v for v in x)};crossings={sum((a < 0) != (b < 0) for a, b in pairs)};steps={sum(abs(a - b) for a, b in pairs)}"


def test_round_trip(spark):
    docs = documents(spark)
    docs = docs.unionByName(docs.where("doc_id = 7")).withColumn("media", F.lit(1)).withColumn("payload", F.lit(2)).withColumn("n_bytes", F.lit(3))
    found = media.media_digests(docs).collect()
    rows = {r["doc_id"]: r for r in found}
    assert len(found) == len(odd_texts()) + 1
    for k, text in enumerate(odd_texts()):
        raw = (text or "").encode()
        payload = padded(raw)
        r = rows[k]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["feature"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), feature_by_hand(payload))
        stream = flac.encode(np.frombuffer(payload, np.uint8), np.array([0, len(payload)]))[0]
        assert (r["media_bytes"], r["media_sha256"]) == (len(stream), hashlib.sha256(stream).hexdigest())
    assert rows[0]["media_sha256"] == rows[1]["media_sha256"] and rows[7]["feature"] == rows[8]["feature"]
    assert media.media_digests(empty(spark)).count() == 0


def test_pcm_blocks(spark, tmp_path):
    text = "abc de" * 3000
    stored = media.store_media(documents(spark, [text, "short", None]), str(tmp_path / "media"))
    pcm = media.write_pcm_blocks(stored.unionByName(stored.select(F.lit(9).cast("long").alias("doc_id"), "n_bytes", F.lit(None).cast("binary").alias("media")).limit(1)), str(tmp_path / "pcm"))
    rows = media.block_rows(pcm).where("doc_id = 0").orderBy("block").collect()
    assert [r["first_sample"] for r in rows] == [r["byte_offset"] for r in rows] == list(range(0, len(padded(text.encode())), flac.BLOCK))
    samples = np.frombuffer(b"".join(bytes(r["pcm"]) for r in rows), np.int8)
    assert (samples.view(np.uint8) ^ 0x80).tobytes() == padded(text.encode())
    held = {r["doc_id"]: r for r in media.block_of(pcm, 9000).collect()}
    assert set(held) == {0} and held[0]["first_sample"] == 8192 and bytes(held[0]["pcm"]) == samples[8192:12288].tobytes()
    assert {r["doc_id"] for r in media.block_of(pcm, 5).collect()} == {0, 1, 2}


def test_a_text_of_twenty_megabytes(spark):
    text = ("some words that repeat, é and 日本 " * 1000 + "x" * 9000) * 450
    payload = padded(text.encode())
    assert len(payload) > 20_000_000
    row = media.media_digests(documents(spark, [text]), shares=1).first()
    assert (row["payload_bytes"], row["payload_sha256"]) == (len(payload), hashlib.sha256(payload).hexdigest())


def test_working_memory_does_not_grow_with_the_text():
    def peak(n):
        data = np.random.default_rng(1).integers(90, 120, n, dtype=np.uint8)
        tracemalloc.start()
        stream = flac.encode(data, np.array([0, n]))[0]
        flac.decode_blocks([stream])
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most

    small, large = peak(2_000_000), peak(8_000_000)
    assert large - small < 12 * 6_000_000, (small, large)


def test_high_orders_and_partitions():
    t = np.arange(4096)
    smooth = [np.round(60 * np.sin(t / 300 + k) + 40 * np.sin(t / 900)) for k in range(3)] + [np.round((t / 2048 - 1) ** 3 * 100)]
    mixed = np.where(t < 2048, np.random.default_rng(2).integers(-100, 100, 4096), t % 3)
    pieces = [(np.clip(x, -128, 127) + 128).astype(np.uint8) for x in [*smooth, mixed]] + [np.arange(n, dtype=np.uint8) for n in (1, 2, 3, 4, 5, 63, 64, 128, 192)]
    kinds, parted = set(), 0
    for p in pieces:
        stream = flac.encode(p, np.array([0, len(p)]))[0]
        info = flac.read_info(stream)
        sub = info.frames_at + len(flac._frame_header(0, len(p)))
        kind = stream[sub] >> 1
        kinds.add(kind)
        parted += kind & 0x38 == 8 and stream[sub + 1 + (kind & 7)] >> 2 & 15 > 0
        fast, slow = flac.decode([stream])[0], np.concatenate([b for _, b in flac.frames(stream)])
        assert (fast == slow).all() and ((fast[:, 0] + 128).astype(np.uint8) == p).all()
    together = flac.encode(np.concatenate(pieces), np.cumsum([0, *map(len, pieces)]))
    assert [((x[:, 0] + 128).astype(np.uint8) == p).all() for x, p in zip(flac.decode(together), pieces)] == [True] * len(pieces)
    assert parted and kinds & {10, 11, 12} and len(kinds) > 3, (kinds, parted)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=300), min_size=1, max_size=4))
def test_any_bytes(pieces):
    bounds = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
    streams = flac.encode(np.frombuffer(b"".join(pieces), np.uint8), bounds)
    for piece, stream, fast in zip(pieces, streams, flac.decode(streams)):
        slow = np.concatenate([b for _, b in flac.frames(stream)])
        for samples in (fast, slow):
            assert (samples[:, 0].astype(np.int8).view(np.uint8) ^ 0x80).tobytes() == piece


def test_seeking():
    data = np.random.default_rng(1).integers(97, 110, 20000, dtype=np.uint8)
    stream = flac.encode(data, np.array([0, len(data)]))[0]
    first, block = flac.block_at(stream, 9000)
    assert first == 8192 and (block[:, 0].astype(np.int8).view(np.uint8) ^ 0x80).tobytes() == data[8192:12288].tobytes()


def test_broken_streams():
    data = np.frombuffer(b"some text that is long enough to be coded " * 20, np.uint8)
    stream = flac.encode(data, np.array([0, len(data)]))[0]
    broken = bytearray(stream)
    broken[-20] ^= 4
    for bad in (bytes(broken), stream[:-3], b"RIFF" + stream[4:]):
        with pytest.raises((flac.FlacError, IndexError)):
            flac.decode([bad])


class Writer:
    """Bits by hand, for frames that the encoder never writes."""

    def __init__(self):
        self.bits = ""

    def put(self, value, n):
        self.bits += format(value & ((1 << n) - 1), f"0{n}b") if n else ""
        return self

    def rice(self, residual, k):
        for r in residual:
            u = r * 2 if r >= 0 else -2 * r - 1
            self.bits += "0" * (u >> k) + "1"
            self.put(u, k)
        return self


def frame(writer_of, size, channels, assignment, depth=8):
    head = bytes([0xFF, 0xF8, 0x60 | 4, assignment << 4 | 1 << 1, 0, size - 1])
    w = Writer()
    writer_of(w)
    body = w.bits + "0" * (-len(w.bits) % 8)
    raw = head + bytes([flac.crc8(head)]) + bytes(int(body[i : i + 8], 2) for i in range(0, len(body), 8))
    crc = int(flac.crc16_all(np.frombuffer(raw, np.uint8), np.array([0]), np.array([len(raw)]))[0])
    info = b"\x00\x10\x00\x10" + bytes(6) + (8000 << 44 | (channels - 1) << 41 | (depth - 1) << 36 | size).to_bytes(8, "big") + bytes(16)
    return b"fLaC\x80" + len(info).to_bytes(3, "big") + info + raw + crc.to_bytes(2, "big")


def test_linear_prediction_partitions_and_stereo():
    size, weights, shift = 32, (5, -2), 2
    left = [10, 12]
    residual = [(k * 7) % 11 - 5 for k in range(size - 2)]
    left = flac.predicted(left, residual, weights, shift).tolist()
    assert left[5] == residual[3] + ((5 * left[4] - 2 * left[3]) >> 2)
    side = [(k % 5) - 2 for k in range(size)]

    def write(w):
        w.put(0, 1).put(0x20 | 1, 6).put(0, 1).put(left[0], 16).put(left[1], 16)  # order 2, samples of 16 bits
        w.put(4 - 1, 4).put(shift, 5)
        for c in weights:
            w.put(c, 4)
        w.put(0, 2).put(1, 4)  # two partitions
        w.put(3, 4).rice(residual[: size // 2 - 2], 3)
        w.put(15, 4).put(6, 5)  # the second as plain numbers of 6 bits
        for r in residual[size // 2 - 2 :]:
            w.put(r, 6)
        w.put(0, 1).put(1, 6).put(1, 1).put(1, 1)  # verbatim, one wasted bit
        for s in side:
            w.put(s, 16)

    head = frame(write, size, 2, 8, 16).replace(b"", b"")
    stream = bytearray(head)
    at = flac.read_info(bytes(stream)).frames_at
    stream[at + 3] = 8 << 4 | 4 << 1  # left and side, 16 bits
    stream[at + 6] = flac.crc8(bytes(stream[at : at + 6]))
    crc = int(flac.crc16_all(np.frombuffer(bytes(stream[at:-2]), np.uint8), np.array([0]), np.array([len(stream) - 2 - at]))[0])
    stream[-2:] = crc.to_bytes(2, "big")
    samples = flac.decode([bytes(stream)])[0]
    assert samples[:, 0].tolist() == left and (samples[:, 0] - samples[:, 1]).tolist() == [2 * s for s in side]
