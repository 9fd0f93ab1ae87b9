"""The scan on a stream of texts.

A record is scanned by itself, so the stream needs no state and no watermark: late
texts are scanned when they come.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import codes
from ..functions.sequence import as_bytes, normalized
from ..operators.scan import scan


def stream_records(texts: DataFrame) -> DataFrame:
    """Records from a stream of ``seq_idx, seq_id, text``."""
    seq = normalized(F.col("text"))
    return texts.select("seq_idx", "seq_id", as_bytes(seq).alias("seq"), F.length(seq).alias("length"), F.lit(False).alias("circular"), F.lit("raw").alias("source_kind"))


def scan_stream(texts: DataFrame, path: str, checkpoint: str, table_id: int = codes.DEFAULT) -> StreamingQuery:
    """Appends the hits of each batch to ``path``; a batch that is run again takes its own place."""

    def save(batch: DataFrame, number: int) -> None:
        scan(batch, table_id).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream_records(texts).writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).start()
