"""Media columns: texts' bytes as FLAC, and FLAC to PCM blocks.

``encode_media`` turns a payload column into a column of FLAC streams, which
``store_media`` writes.  ``pcm_blocks`` decodes such a column, verifying every checksum:
a row a stream with its blocks of PCM, the first sample of each and its byte place, so a
reader can seek; ``write_pcm_blocks`` writes that, ``block_rows`` has a row a block, and
``block_of`` picks the block that holds a sample.  ``pcm_features`` reads the blocks back
and tells what was stored.  ``media_digests`` does it all for a table, a share of the rows
at a time, and keeps the digests alone, so what lies on disk in between is a share too.

Streams are coded about a megabyte at a time inside a task, and nothing is shuffled.

Defined results: null is an empty payload, padded to 64 zero bytes; equal payloads
give equal streams, and repeated rows a row each; a long text is one stream, coded in
groups of frames; an empty table gives no rows; a broken stream raises, a null one has
no blocks; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flac
from .common import blocks, discard, map_arrow, scratch, temporary, text_bytes, written

PAD = 64
#: Payload bytes that are taken at once.
SIDE_BY_SIDE = 1 << 20


def encode_media(rows: DataFrame, column: str = "text") -> DataFrame:
    """``doc_id, n_bytes, media``: the UTF-8 bytes of ``column``, zero-padded to a positive multiple of 64, as 8-bit FLAC."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "payload", SIDE_BY_SIDE):
            data, bounds = text_bytes(batch, "payload")
            sizes = np.diff(bounds)
            padded = np.maximum(-(-sizes // PAD), 1) * PAD
            starts = np.cumsum(padded) - padded
            out = np.zeros(int(padded.sum()), np.uint8)
            out[np.arange(len(data)) + np.repeat(starts - bounds[:-1], sizes)] = data
            streams = flac.encode(out, np.append(starts, len(out)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), pa.array(streams, pa.binary())], names=["doc_id", "n_bytes", "media"])

    payload = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(column), F.lit("")).alias("payload"))
    return map_arrow(payload, encode, "doc_id long, n_bytes long, media binary")


def store_media(rows: DataFrame, path: str, column: str = "text") -> DataFrame:
    """Writes ``encode_media`` as Parquet; returns the table as stored."""
    encode_media(rows, column).write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.parquet(path)


PCM = "doc_id long, n_bytes long, media_bytes long, media_sha256 string, channels int, bits int, first_samples array<long>, byte_offsets array<long>, pcm array<binary>"


def pcm_blocks(media: DataFrame) -> DataFrame:
    """A row a stream of any FLAC ``media``: its size and SHA-256, and by block the first sample, its byte place in the PCM stream, and the PCM."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in PCM.split(", ")]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary()))
        for batch in blocks(batches, "media", SIDE_BY_SIDE):
            own = [x for x in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media"))) if x[2] is not None]
            rows = []
            for (doc, size, stream), (info, firsts, samples) in zip(own, flac.decode_blocks([x[2] for x in own])):
                pcm = [flac.as_pcm(x, info.bits) for x in samples]
                places = np.cumsum([0, *map(len, pcm)])[:-1].tolist()
                rows.append((doc, size, len(stream), hashlib.sha256(stream).hexdigest(), info.channels, info.bits, firsts, places, pcm))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    size = F.col("n_bytes").cast("long") if "n_bytes" in media.columns else F.lit(None).cast("long")
    return map_arrow(media.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("n_bytes"), "media"), cut, PCM)


def write_pcm_blocks(media: DataFrame, path: str) -> DataFrame:
    """Writes ``pcm_blocks`` as Parquet; returns the table as stored."""
    pcm_blocks(media).write.option("compression", "zstd").parquet(path)
    return media.sparkSession.read.parquet(path)


def block_rows(pcm: DataFrame) -> DataFrame:
    """``doc_id, block, first_sample, byte_offset, channels, pcm``: a row a block."""
    each = F.posexplode(F.arrays_zip("first_samples", "byte_offsets", "pcm")).alias("block", "b")
    return pcm.select("doc_id", "channels", each).select("doc_id", "block", F.col("b.first_samples").alias("first_sample"), F.col("b.byte_offsets").alias("byte_offset"), "channels", F.col("b.pcm").alias("pcm"))


def block_of(pcm: DataFrame, sample: int) -> DataFrame:
    """``doc_id, first_sample, pcm``: each stream's block that holds ``sample``; streams that end before it go."""
    k = F.size(F.filter("first_samples", lambda x: x <= sample)) - 1
    width = F.col("channels") * F.ceil(F.col("bits") / 8)
    rows = pcm.withColumn("_k", k).where("_k >= 0").select("doc_id", width.alias("_w"), F.get("first_samples", F.col("_k")).alias("first_sample"), F.get("pcm", F.col("_k")).alias("pcm"))
    return rows.where(F.col("first_sample") + F.length("pcm") / F.col("_w") > sample).drop("_w")


def _features(x: np.ndarray) -> str:
    """Sums over the samples, as whole numbers: peak, mean level, energy, sign changes, steps."""
    wide = x.astype(np.int32)
    step = np.abs(np.diff(wide))
    return f"n={len(x)};peak={int(np.abs(wide).max(initial=0))};sum={int(wide.sum(dtype=np.int64))};energy={int((wide * wide).sum(dtype=np.int64))};crossings={int(np.count_nonzero((wide[1:] < 0) != (wide[:-1] < 0)))};steps={int(step.sum(dtype=np.int64))}"


def pcm_features(pcm: DataFrame) -> DataFrame:
    """From blocks of ``encode_media``'s streams: the payload's size, SHA-256 and the CRC-32 of its last 64 bytes, the stream's size and SHA-256, and features."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for parts in batch.column("pcm"):
                x = np.frombuffer(b"".join(p.as_py() for p in parts), np.int8)
                payload = (x.view(np.uint8) ^ 0x80).tobytes()
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]), _features(x)))
            if rows:
                size, sha, crc, feature = (pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.string(), pa.int64(), pa.string())))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), size, sha, crc, batch.column("media_bytes"), batch.column("media_sha256"), feature], names=names)

    rows = pcm.select("doc_id", "n_bytes", "media_bytes", "media_sha256", "pcm")
    return map_arrow(rows, read, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_digests(rows: DataFrame, column: str = "text", shares: int = 2) -> DataFrame:
    """Stores each row's text as FLAC, reads that back, writes its PCM blocks, and reads ``pcm_features`` from those.

    The rows are dealt to ``shares`` by a hash; a share's streams and blocks are deleted
    once its digests are written.
    """
    spark, found = rows.sparkSession, []
    for k in range(shares):
        with temporary(spark) as keep:
            own = rows.where(F.pmod(F.xxhash64("doc_id", column), F.lit(shares)) == k)
            stored = written(encode_media(own, column), "media")
            pcm = write_pcm_blocks(stored, scratch(spark, "pcm"))
            discard(stored)
            found.append(keep(written(pcm_features(pcm), "digests")))
    return reduce(DataFrame.unionByName, found)
