"""Token-ID output: flat unsigned integer files with 64-bit document offsets.

``write_token_files`` deals documents by ``doc_id`` into shards; a task encodes its
documents in order and writes three flat files a shard: the ids, the 64-bit place
where each document starts, and the document ids.  There is a shard for each
``SHARD_BYTES`` of text, and one for each shuffle partition at least.  A manifest row a
shard comes back to the driver, and each shard's base is the prefix sum of the token
counts before it.  ``read_token_files`` maps the files into memory again; from a store
that can't be mapped it reads the ids of some documents at a time.

A task writes under a name of its own and a shard counts only once the manifest names
it, so a repeated or speculative task leaves nothing that is read.

Defined results: a null text is empty (only the end id); a null ``doc_id`` sorts
before all others; rows with equal ``doc_id`` are ordered by a hash of their text;
a long text is encoded whole; an empty table gives no shard; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, filesystem, map_arrow, scratch, shuffle_partitions, text_bytes
from .tokens import encoder, vocabulary

MANIFEST = "shard string, first_doc long, first_hash long, n_docs long, n_null long, n_tokens long, width int"
#: Bytes of text a shard, about.
SHARD_BYTES = 256 << 20
DOCS_AT_ONCE = 4096
DOCUMENTS = "doc_id long, start long, n_tokens long, ids_crc32 long"


class Shard(NamedTuple):
    shard: str
    base: int
    doc_base: int
    n_docs: int
    n_null: int
    n_tokens: int
    width: int


class Flat:
    """A flat file of numbers: memory-mapped where the store is a mounted one, else read by ranges."""

    def __init__(self, uri: str, dtype: str):
        store, path = filesystem(uri)
        self.dtype = np.dtype(dtype)
        size = store.get_file_info(path).size
        self.mapped = (np.memmap(path, self.dtype, "r") if size else np.zeros(0, self.dtype)) if store.type_name == "local" else None
        self.file = store.open_input_file(path) if self.mapped is None else None

    def __getitem__(self, span: slice) -> np.ndarray:
        if self.mapped is not None:
            return self.mapped[span]
        width = self.dtype.itemsize
        return np.frombuffer(self.file.read_at((span.stop - span.start) * width, span.start * width), self.dtype)


def write_token_files(documents: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 0) -> list[Shard]:
    """Writes the ids of all documents in ascending ``doc_id`` order under ``folder``; returns the shards in that order."""
    spark = documents.sparkSession
    place, run = tokenizer or vocabulary(), uuid.uuid4().hex

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, name, out = encoder(place), f"{run}-{uuid.uuid4().hex}", {}
        store, path = filesystem(folder)
        first, n_docs, n_null, n_tokens = None, 0, 0, 0
        try:
            for batch in blocks(batches, "text"):
                if first is None:
                    store.create_dir(path, recursive=True)
                    out = {kind: store.open_output_stream(f"{path}/{name}.{kind}") for kind in ("ids", "starts", "docs")}
                    first = (batch.column("doc_id")[0].as_py(), batch.column("text_hash")[0].as_py())
                ids, ends = encode.encode_block(*text_bytes(batch, "text"))
                ids = np.insert(ids, ends[1:], np.array(end_id, encode.dtype))
                starts = ends + np.arange(len(ends))
                out["ids"].write(ids.tobytes())
                out["starts"].write((n_tokens + starts[:-1]).astype("<i8").tobytes())
                out["docs"].write(batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                n_docs, n_null, n_tokens = n_docs + batch.num_rows, n_null + batch.column("doc_id").null_count, n_tokens + len(ids)
        finally:
            for stream in out.values():
                stream.close()
        if first is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([first[0]], pa.int64()), pa.array([first[1]], pa.int64()), *(pa.array([x], pa.int64()) for x in (n_docs, n_null, n_tokens)), pa.array([encode.dtype.itemsize], pa.int32())],
                names=["shard", "first_doc", "first_hash", "n_docs", "n_null", "n_tokens", "width"],
            )

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    dealt = rows.repartitionByRange(max(shuffle_partitions(spark), -(-size // SHARD_BYTES)), "doc_id", "text_hash").sortWithinPartitions("doc_id", "text_hash")
    manifest = map_arrow(dealt, shard, MANIFEST).collect()  # a row a shard
    manifest.sort(key=lambda r: (r.first_doc is not None, r.first_doc or 0, r.first_hash))
    shards, base, doc_base = [], 0, 0
    for r in manifest:
        shards.append(Shard(r.shard, base, doc_base, r.n_docs, r.n_null, r.n_tokens, r.width))
        base, doc_base = base + r.n_tokens, doc_base + r.n_docs
    return shards


def read_token_files(spark: SparkSession, folder: str, shards: list[Shard]) -> DataFrame:
    """A row a document from the files: where its ids start among all, how many, and the crc32 of them as 32-bit integers."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = Flat(f"{folder}/{r['shard']}.ids", f"<u{r['width']}")
                starts, docs = Flat(f"{folder}/{r['shard']}.starts", "<i8"), Flat(f"{folder}/{r['shard']}.docs", "<i8")
                for i in range(0, r["n_docs"], DOCS_AT_ONCE):
                    stop = min(i + DOCS_AT_ONCE, r["n_docs"])
                    own = starts[i : min(stop + 1, r["n_docs"])]
                    ends = np.append(own, r["n_tokens"])[1 : stop - i + 1]
                    own = own[: stop - i]
                    crc = [zlib.crc32(ids[a:b].astype("<u4")) for a, b in zip(own.tolist(), ends.tolist())]
                    null = np.arange(i, stop) < r["n_null"]
                    yield pa.RecordBatch.from_arrays([pa.array(np.asarray(docs[i:stop]), mask=null), pa.array(own + r["base"]), pa.array(ends - own), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    table = spark.createDataFrame(shards, "shard string, base long, doc_base long, n_docs long, n_null long, n_tokens long, width int")
    return map_arrow(table.repartition(max(1, min(len(shards), shuffle_partitions(spark)))), read, DOCUMENTS)


def token_files(documents: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Writes the files to the shared folder and reads every document back."""
    spark = documents.sparkSession
    folder = scratch(spark, "tokens")
    return read_token_files(spark, folder, write_token_files(documents, folder, tokenizer))
