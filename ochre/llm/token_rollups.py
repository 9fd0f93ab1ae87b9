"""Token counts kept by deltas.

A change is a signed row: ``+1`` a document that comes in, ``-1`` one that goes, and a
revised count is both.  A batch of changes is summed by source, language and
tokenizer version and committed under its id, as a folder of its own that is renamed
into place; a batch that is there already is left alone, so a repeated commit changes
nothing (with other sums it raises), and one that broke off before its rename was never
there.  Totals are the sum of the committed deltas and of the base into which
``compact`` sums up older ones; one process compacts at a time.

A delta has a row a key, written by as many tasks as the keys need, and sums are combined
before the shuffle, so a hot source is no burden.

Defined results: a null text has no characters and no tokens but counts as a
document; null source or language is a key like any other; keys whose documents and
tokens all went are left out of the totals; repeated rows count each; a long text is
counted whole; no batch, or batches of no rows, give no totals; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, map_arrow, text_bytes
from .tokens import encoder, vocabulary

KEYS = ("source", "lang", "tokenizer_version")
SUMS = ("n_docs", "n_tokens", "n_chars")
MARKS = "batch string, mark string"
DELTA = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long, n_chars long"


@lru_cache(maxsize=2)
def _ranks(path: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _counter(path: str) -> Callable[[pa.RecordBatch], np.ndarray]:
    """Counts the tokens of each text in a batch."""
    if path.endswith(".tiktoken"):
        ranks = _ranks(path)
        return lambda batch: np.array([len(ranks.encode_ordinary(t)) for t in batch.column("text").to_pylist()], np.int64)
    return lambda batch: np.diff(encoder(path).encode_block(*text_bytes(batch, "text"))[1])


def count_tokens(documents: DataFrame, version: str, path: str | None = None) -> DataFrame:
    """``doc_id, source, lang, tokenizer_version, n_tokens, n_chars``; ``path`` is the vocabulary of ``version``."""
    place = path or vocabulary(version)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _counter(place)
        for batch in blocks(batches, "text"):
            columns = [batch.column(c) for c in ("doc_id", "source", "lang", "n_chars")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(tokens(batch), pa.int64())], names=["doc_id", "source", "lang", "n_chars", "n_tokens"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
    counted = map_arrow(rows, count, "doc_id long, source string, lang string, n_chars long, n_tokens long")
    return counted.select("doc_id", "source", "lang", F.lit(version).alias("tokenizer_version"), "n_tokens", "n_chars")


def inserted(counts: DataFrame) -> DataFrame:
    return counts.withColumn("sign", F.lit(1))


def deleted(counts: DataFrame) -> DataFrame:
    return counts.withColumn("sign", F.lit(-1))


def revised(old: DataFrame, new: DataFrame) -> DataFrame:
    return deleted(old).unionByName(inserted(new))


class RollupStore:
    """Totals under ``folder``, which all machines must see and whose store renames folders in one step (HDFS does, plain object stores don't)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _place(self, batch: str) -> str:
        return f"{self.folder}/batch={quote(batch, safe='')}"

    def _names(self, kind: str) -> list[str]:
        top = self._path(self.folder)
        if not self._fs.exists(top):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(top)]
        return sorted(n.removeprefix(kind) for n in names if n.startswith(kind))

    def _base(self) -> str | None:
        """The newest compacted state: its totals and the marks of the batches in it."""
        found = self._names("base=")
        return f"{self.folder}/base={found[-1]}" if found else None

    def _marks(self) -> DataFrame:
        """``batch, mark``: the batches in the base."""
        base = self._base()
        return self.spark.read.schema(MARKS).parquet(f"{base}/marks") if base else self.spark.createDataFrame([], MARKS)

    def _loose(self) -> list[str]:
        """Batches that are not in the base, though one may still lie beside it."""
        names = [unquote(n) for n in self._names("batch=")]
        inside = {r["batch"] for r in self._marks().where(F.col("batch").isin(names)).collect()} if names else set()
        return [n for n in names if n not in inside]

    def batches(self) -> list[str]:
        """The ids of all committed batches."""
        return sorted({r["batch"] for r in self._marks().collect()} | set(self._loose()))

    def _mark_of(self, delta: str) -> str:
        """The same for equal deltas, whatever files they lie in."""
        row = self.spark.read.schema(DELTA).parquet(delta).agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*KEYS, *SUMS).cast("decimal(20,0)")).alias("sum")).first()
        return f"{row['n']}:{row['sum']}"

    def _committed_mark(self, batch: str) -> str | None:
        row = self._marks().where(F.col("batch") == batch).first()
        if row:
            return row["mark"]
        return self._mark_of(self._place(batch)) if self._fs.exists(self._path(self._place(batch))) else None

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Adds a batch of changes (keys, ``sign``, ``n_tokens``, ``n_chars``).

        False if that batch was there already with the same sums; a batch of the same
        id with other sums raises and changes nothing.
        """
        signed = [F.sum("sign").cast("long").alias("n_docs"), *(F.sum(F.col("sign") * F.col(c)).cast("long").alias(c) for c in ("n_tokens", "n_chars"))]
        attempt = f"{self.folder}/_attempt-{uuid.uuid4().hex}"
        changes.groupBy(*KEYS).agg(*signed).write.parquet(attempt)
        target = self._path(self._place(batch))
        before = self._committed_mark(batch)
        if before is None and self._fs.rename(self._path(attempt), target):
            own = [s.getPath() for s in self._fs.listStatus(target) if s.getPath().getName().startswith("_attempt-")]
            if not own:
                return True
            for path in own:  # another commit of this batch was first, and this one was moved into it
                self._fs.delete(path, True)
            return False
        mark = self._mark_of(attempt)
        self._fs.delete(self._path(attempt), True)
        if mark != (before or self._committed_mark(batch)):
            raise ValueError(f"batch {batch!r} was committed before with other changes")
        return False

    def totals(self) -> DataFrame:
        base = self._base()
        places = [self._place(b) for b in self._loose()] + ([f"{base}/sums"] if base else [])
        if not places:
            return self.spark.createDataFrame([], DELTA)
        sums = self.spark.read.schema(DELTA).parquet(*places).groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS])
        return sums.where(" OR ".join(f"{c} <> 0" for c in SUMS))

    def compact(self) -> None:
        """Sums all batches up into a new base, which counts from the rename on; then batches and bases that the one before held are deleted."""
        before, loose = self._base(), self._loose()
        if not loose:
            return
        held = [unquote(n) for n in self._names("batch=") if unquote(n) not in loose]
        attempt = f"{self.folder}/_attempt-{uuid.uuid4().hex}"
        self.totals().write.parquet(f"{attempt}/sums")
        marks = self.spark.createDataFrame([(b, self._committed_mark(b)) for b in loose], MARKS)
        self._marks().unionByName(marks).write.parquet(f"{attempt}/marks")
        number = int(before.rpartition("=")[2]) + 1 if before else 1
        if not self._fs.rename(self._path(attempt), self._path(f"{self.folder}/base={number:012d}")):
            raise OSError("the new base could not be put in place")
        for path in [self._place(b) for b in held] + [f"{self.folder}/base={n}" for n in self._names("base=") if int(n) < number - 1]:
            self._fs.delete(self._path(path), True)
