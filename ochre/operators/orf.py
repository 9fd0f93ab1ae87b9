"""Open reading frames between stops of one reading frame.

A frame is worked on in chunks, so a chromosome's frame is no single task.  Each chunk
finds the regions between its own stops; what is open at its end (the last stop, and the
first start after it) is handed on by a pass over chunks, a row each, and completes the
region at the head of the next chunk that has a stop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import codes
from ..schema import FEATURES
from .scan import CHUNK, codon_windows, first_numbers, scan_order


#: Bases whose stops and starts are one partition, on both strands.
PART = 1 << 23


def _regions(marks: DataFrame, chunk: int, parts: int | None = None, carries: bool = True) -> DataFrame:
    """``seq_idx, seq_id, strand, frame, stop_at, start_at, stop_before``: a region a row, from right after a stop to the next one (null: none), with its first start.

    ``parts``: into how many partitions the marks are dealt.  ``carries``: whether any frame has several chunks.
    """
    frame = ["seq_idx", "seq_id", "strand", "frame"]
    keys = [*frame, "_chunk"]
    own = Window.partitionBy(*keys).orderBy("rpos").rowsBetween(Window.unboundedPreceding, -1)
    # keys are never null, so that no join adds a filter of its own and both uses of the marks share one shuffle
    marks = marks.select(*[F.coalesce(c, F.lit(v)).alias(c) for c, v in (("seq_idx", -1), ("seq_id", ""), ("strand", "+"), ("frame", 0))], "rpos", "start_at", "is_stop")
    marks = marks.withColumn("_chunk", F.coalesce(F.floor(F.col("rpos") / chunk), F.lit(0)))
    if parts:
        marks = marks.repartition(parts, *keys)
    inner = marks.withColumn("_region", F.coalesce(F.count(F.when(F.col("is_stop"), 1)).over(own), F.lit(0))).withColumn("stop_before", F.max(F.when(F.col("is_stop"), F.col("rpos"))).over(own))
    local = inner.groupBy(*keys, "_region").agg(F.max(F.when(F.col("is_stop"), F.col("rpos"))).alias("stop_at"), F.min("start_at").alias("start_at"), F.max("stop_before").alias("stop_before"))
    if not carries:
        return local.select(*frame, "stop_at", "start_at", "stop_before")
    # what each chunk leaves open: its last stop, and the first start after that
    left = local.groupBy(*keys).agg(F.max("stop_at").alias("_last"), F.min(F.when(F.col("stop_at").isNull(), F.col("start_at"))).alias("_open"))
    along = Window.partitionBy(*frame).orderBy("_chunk")
    left = left.withColumn("_group", F.count("_last").over(along.rowsBetween(Window.unboundedPreceding, 0)))  # chunks since one with a stop
    group = Window.partitionBy(*frame, "_group").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, 0)
    left = left.withColumn("_first", F.min("_open").over(group)).withColumn("_stop", F.max("_last").over(group))
    carried = left.select(*frame, "_chunk", F.lag("_first").over(along).alias("_first"), F.lag("_stop").over(along).alias("_stop"))
    head = F.col("_region") == 0
    whole = local.join(carried, keys, "left")
    return whole.select(*frame, "stop_at", F.when(head, F.coalesce("_first", "start_at")).otherwise(F.col("start_at")).alias("start_at"), F.when(head, F.col("_stop")).otherwise(F.col("stop_before")).alias("stop_before"))


def predict_orfs(records: DataFrame, hits: DataFrame, table_id: int = codes.DEFAULT, min_len_nt: int = 90, start_codons: list[str] | None = None, require_start: bool = True, include_alt_starts: bool = False, chunk: int = CHUNK) -> DataFrame:
    """ORFs as features.  Each runs to a stop, from the first start codon after the stop before it, or right after that stop.

    Stops over the origin of a circular record take no part, and a region without a
    stop at its end is no ORF.
    """
    min_len_nt = min_len_nt or 90
    stops = hits.where("NOT wraps").select("seq_idx", "seq_id", "strand", "frame", "rpos", F.lit(None).cast("int").alias("start_at"), F.lit(True).alias("is_stop"))
    marks = stops
    if require_start:
        starts = list(start_codons) if start_codons else list(codes.genetic_code(table_id).all_starts if include_alt_starts else ("ATG",))
        opening = codon_windows(records, starts).select("seq_idx", "seq_id", "strand", (F.col("rpos") % 3 + 1).cast("int").alias("frame"), "rpos", F.col("rpos").alias("start_at"), F.lit(False).alias("is_stop"))
        marks = stops.unionByName(opening)
    one = records.agg(F.sum(F.col("length").cast("long")).alias("total"), F.max("length").alias("longest")).first()
    # as many partitions as the bases need, so that no task grows with the input
    parts = max(records.sparkSession.sparkContext.defaultParallelism, -(-(one["total"] or 0) // PART))
    regions = _regions(marks, chunk, parts, (one["longest"] or 0) > chunk)
    if require_start:
        found = regions.where("stop_at IS NOT NULL AND start_at IS NOT NULL")
    else:
        found = regions.where("stop_at IS NOT NULL").withColumn("start_at", F.coalesce(F.col("stop_before") + 3, F.col("frame") - 1))
    found = found.drop("stop_before")
    found = found.withColumn("length_nt", F.col("stop_at") + 3 - F.col("start_at")).where(F.col("length_nt") >= min_len_nt)
    found = found.join(records.select("seq_idx", "length"), "seq_idx")
    plus = F.col("strand") == "+"
    found = found.withColumn("start", F.when(plus, F.col("start_at") + 1).otherwise(F.col("length") - 2 - F.col("stop_at"))).withColumn("end", F.when(plus, F.col("stop_at") + 3).otherwise(F.col("length") - F.col("start_at")))

    # numbers in scan order, from counts
    keys = scan_order(F.col("stop_at"), chunk)
    group = list(keys)
    found = found.withColumns(keys)
    base = first_numbers(found.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")), group)
    found = found.repartition(parts, *group).withColumn("_row", F.row_number().over(Window.partitionBy(*group).orderBy("stop_at"))).join(base, group).withColumn("_no", F.col("_row") + F.col("_base"))
    segment = F.array(F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.lit(None).cast("int").alias("phase")))
    none = F.lit(None).cast("string")
    columns = {
        "feat_idx": F.col("_no"), "seq_id": F.col("seq_id"), "type": F.lit("ORF"), "strand": F.col("strand"), "segments": segment, "ordered_segments": segment,
        "start": F.col("start"), "end": F.col("end"), "name": none, "locus_tag": none, "product": F.concat(F.lit("predicted ORF (frame "), F.col("strand"), F.col("frame"), F.lit(")")),
        "protein_id": none, "transl_table": F.lit(table_id), "phase": F.lit(None), "transl_except": F.lit(None),
        "id": F.concat(F.lit("ORF_"), F.col("seq_id"), F.lit("_"), F.col("strand"), F.col("frame"), F.lit("_"), F.col("_no").cast("string")),
        "parent": none, "partial5": F.lit(False), "partial3": F.lit(False), "length_nt": F.col("length_nt"),
    }
    from pyspark.sql.types import _parse_datatype_string

    types = {f.name: f.dataType for f in _parse_datatype_string(FEATURES).fields}
    return found.select(*[c.cast(types[name]).alias(name) for name, c in columns.items()])
