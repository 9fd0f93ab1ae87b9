"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..shipping import ensure_shipped

#: Text handed to numpy or a tokenizer at once, in bytes.
BLOCK_BYTES = 1 << 20
#: Bytes of an Arrow batch between Spark and Python.
BATCH_BYTES = 8 << 20

_own_dir: dict[str, str] = {}
#: Paths written, by application, and where tables that were read back lie.
_made: dict[str, list[str]] = {}
_lies_at: WeakKeyDictionary = WeakKeyDictionary()


def map_arrow(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """``df.mapInArrow``, with this package sent to the executors first.

    Batches are held to ``BATCH_BYTES``: Spark's own limit would take much of what an
    executor leaves to Python workers.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    ensure_shipped(df.sparkSession)
    return df.mapInArrow(fn, schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is what the cluster names in ``spark.checkpoint.dir``.  Only where that is
    unset (tests in one process) a temporary folder is made and set.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        _own_dir[app] = tempfile.mkdtemp(prefix="ochre-")
        spark.sparkContext.setCheckpointDir(_own_dir[app])
    return _own_dir[app]


def scratch(spark: SparkSession, what: str) -> str:
    """A new path under the shared folder."""
    path = f"{shared_dir(spark)}/ochre/{what}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: its lineage ends there."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    _lies_at[back] = path
    return back


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes at its end what was written to the shared folder within, but for the tables given to the function it yields."""
    made = _made.setdefault(spark.sparkContext.applicationId, [])
    first, kept = len(made), set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(_lies_at[df])
        return df

    try:
        yield keep
    finally:
        own = made[first:]
        made[first:] = [p for p in own if p in kept]
        for path in own:
            if path not in kept:
                _delete(spark, path)


def discard(df: DataFrame) -> None:
    """Deletes a table of ``written`` that nothing will read any more."""
    path = _lies_at.pop(df)
    made = _made.get(df.sparkSession.sparkContext.applicationId, [])
    if path in made:
        made.remove(path)
    _delete(df.sparkSession, path)


def clear_scratch(spark: SparkSession) -> None:
    """Deletes all that this application's operators have left in the shared folder; results that were not saved go with it."""
    for path in _made.pop(spark.sparkContext.applicationId, []):
        _delete(spark, path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def blocks(batches: Iterable[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts record batches by rows so that ``column`` has at most ``limit`` bytes in each; a longer value stands alone."""
    import numpy as np

    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
        ends = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32, col.offset + len(col) + 1)[col.offset :].astype(np.int64)
        row = 0
        while row < batch.num_rows:
            stop = max(row + 1, int(np.searchsorted(ends, ends[row] + limit, "right")) - 1)
            yield batch.slice(row, stop - row)
            row = stop


def text_bytes(batch: pa.RecordBatch, column: str):
    """The bytes of a text column in one buffer, and the places where each value starts (one more than rows); null is empty."""
    import numpy as np

    col = batch.column(batch.schema.get_field_index(column))
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    ends = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32, col.offset + len(col) + 1)[col.offset :].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None and col.buffers()[2].size else np.zeros(0, np.uint8)
    if col.null_count:  # a null may have bytes of its own below it
        lengths = np.where(np.asarray(col.is_valid().to_numpy(zero_copy_only=False)), np.diff(ends), 0)
        keep = np.concatenate([data[a : a + n] for a, n in zip(ends[:-1].tolist(), lengths.tolist())] or [data[:0]])
        return keep, np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    return data[ends[0] : ends[-1]], ends - ends[0]


def filesystem(uri: str):
    """The file system of a shared folder, and the path there, for Python on any machine."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)
