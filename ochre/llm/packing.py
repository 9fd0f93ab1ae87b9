"""Best-fit packing by a plan over counts of lengths.

Documents become pieces of at most ``capacity`` tokens.  Only the histogram of piece
lengths (at most ``capacity`` rows) comes to the driver, where best-fit decreasing
runs over counts: bins with equal free space are one range, so a step places many
pieces at once.  The plan names, for a length, which ranks go to which bins and at
which offset.  Pieces get their rank within their length in two steps (count by
length and salt, prefix sums, then a row number within the salt), so a length that
holds a third of all pieces is shared by many tasks, and look their slot up.

The plan's size depends on ``capacity`` alone, not on the corpus, so broadcasting it
is safe.

``least_bins`` bounds from below what any packing of a histogram needs.

Defined results: null text is empty and gives one piece with the end id alone; an
empty table gives no piece; equal rows get slots of their own; a long text is encoded
whole and cut into pieces only afterwards; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import blocks, map_arrow, shuffle_partitions, text_bytes, written
from .tokens import encoder, vocabulary

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def document_pieces(documents: DataFrame, capacity: int = 2048, tokenizer: str | None = None, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """A row a piece.  A document with more than ``capacity`` ids is cut so that all pieces but the first are full."""
    place = tokenizer or vocabulary()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(place)
        for batch in blocks(batches, "text"):
            ids, ends = encode.encode_block(*text_bytes(batch, "text"))
            ids = np.insert(ids, ends[1:], np.array(end_id, encode.dtype)).astype("<u4")
            begins = ends + np.arange(len(ends))
            sizes = np.diff(begins)
            pieces = -(-sizes // capacity)
            doc = np.repeat(np.arange(len(sizes)), pieces)
            number = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            first = (sizes - 1) % capacity + 1
            start = np.where(number == 0, 0, first[doc] + (number - 1) * capacity)
            length = np.where(number == 0, first[doc], capacity)
            at = begins[doc] + start
            own = [ids[a : a + n] for a, n in zip(at.tolist(), length.tolist())]
            arrays = [batch.column("doc_id").take(pa.array(doc)), pa.array(number.astype(np.int32)), pa.array(start), pa.array(length), pa.array([zlib.crc32(x) for x in own], pa.int64())]
            if with_ids:
                arrays.append(pa.array([x.tobytes() for x in own], pa.binary()))
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return map_arrow(rows, cut, PIECES + ", ids binary" * with_ids)


def plan_bins(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Best-fit decreasing over counts: rows (length, first rank, first bin, offset), each good up to the next rank of its length, and the number of bins."""
    free: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by free space: ranges of bins
    plan, bins = [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        space = length
        while left:
            while space <= capacity and not free[space]:
                space += 1
            if space > capacity:
                break
            first, n = free[space].pop()
            take = min(n, left)
            plan.append((length, rank, first, capacity - space))
            if take < n:
                free[space].append((first + take, n - take))
            free[space - length].append((first, take))
            rank, left = rank + take, left - take
            space = length  # what was just filled may take another
        if left:
            each = capacity // length
            full, rest = divmod(left, each)
            for k in range(each if full else 0):
                plan.append((length, rank, bins, k * length))
                rank += full
            if full:
                free[capacity - each * length].append((bins, full))
            for k in range(rest):
                plan.append((length, rank, bins + full, k * length))
                rank += 1
            if rest:
                free[capacity - rest * length].append((bins + full, 1))
            bins += full + bool(rest)
    return plan, bins


def least_bins(histogram: dict[int, int], capacity: int) -> int:
    """No packing has fewer bins: for each ``small``, pieces over ``capacity - small`` stand alone, those over half never share, and what the rest over ``small`` still needs."""
    longest, best = sorted(histogram), 0
    for small in [0, *(n for n in longest if n <= capacity // 2)]:
        alone = sum(histogram[n] for n in longest if n > capacity - small)
        halves = [n for n in longest if capacity // 2 < n <= capacity - small]
        room = sum(histogram[n] * (capacity - n) for n in halves)
        rest = sum(histogram[n] * n for n in longest if max(small, 1) <= n <= capacity // 2)
        best = max(best, alone + sum(histogram[n] for n in halves) + max(0, -(-(rest - room) // capacity)))
    return best


def assign(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``.  ``pieces`` should be a written table, as it is read twice."""
    spark = pieces.sparkSession
    salts = shuffle_partitions(spark)
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    counts = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most ``capacity`` rows
    plan, _ = plan_bins(histogram, capacity)
    slots: dict[int, tuple[list, list, list]] = {}
    for length, rank, first, offset in plan:
        for column, value in zip(slots.setdefault(length, ([], [], [])), (rank, first, offset)):
            column.append(value)
    table = spark.createDataFrame([(k, *v) for k, v in slots.items()], "length long, _ranks array<long>, _firsts array<long>, _offsets array<int>")
    base = counts.withColumn("_base", F.sum("_n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)))
    base = base.select("length", "_salt", F.coalesce("_base", F.lit(0)).alias("_base"))
    ranked = salted.withColumn("_row", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1)
    placed = ranked.join(base, ["length", "_salt"]).withColumn("_rank", F.col("_row") + F.col("_base")).join(F.broadcast(table), "length")
    longest = max((len(v[0]) for v in slots.values()), default=1)
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(longest.bit_length()))])
    # binary search for the last slot that starts at the piece's rank or before
    k = F.aggregate(steps, F.lit(0), lambda low, step: F.when(F.get("_ranks", low + step) <= F.col("_rank"), low + step).otherwise(low))
    slot = placed.withColumn("_k", k + 1)
    at = lambda c: F.element_at(c, F.col("_k"))
    return slot.select(*pieces.columns, (at("_firsts") + F.col("_rank") - at("_ranks")).alias("sequence_id"), at("_offsets").cast("long").alias("offset"))


def pack_documents(documents: DataFrame, capacity: int = 2048, tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """Where each piece of each document goes: its sequence and its place there, gapless from 0."""
    return assign(written(document_pieces(documents, capacity, tokenizer, end_id), "pieces"), capacity)


def packed_sequences(placed: DataFrame) -> DataFrame:
    """Sequences of ids from placed pieces that carry ``ids``: a row a sequence, at most its capacity of ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id", "piece")))
    return placed.groupBy("sequence_id").agg(parts.alias("_parts")).select("sequence_id", F.expr("aggregate(_parts.ids, cast('' as binary), (a, x) -> concat(a, x))").alias("ids"), F.col("_parts.offset").alias("starts"), F.col("_parts.doc_id").alias("doc_ids"))
