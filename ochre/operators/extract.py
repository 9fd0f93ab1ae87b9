"""Coding sequences and proteins of features."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codes
from ..functions.sequence import as_text, non_empty, reverse_complement
from .select import exportable


#: Bases of a sequence that are joined to a feature at once.
CHUNK = 1 << 14


def coding_sequences(features: DataFrame, records: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``features`` with ``coding_seq``: their segments in reading order, each turned around on the minus strand; empty where they lie on no record.

    Segments meet the chunks of the sequence that they lie on, so no feature ever carries
    a whole record.
    """
    last = F.floor((F.col("length") - 1) / chunk)
    chunks = records.where("length > 0").select("seq_id", "seq", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("_no"))
    chunks = chunks.select("seq_id", "_no", F.expr(f"substring(seq, CAST(_no * {chunk} + 1 AS INT), {chunk})").alias("_piece"))
    spans = features.select("feat_idx", "seq_id", "strand", F.posexplode("ordered_segments").alias("_k", "_s"))
    spans = spans.select("feat_idx", "seq_id", "strand", "_k", F.greatest(F.lit(1), F.col("_s.start")).alias("_from"), F.col("_s.end").alias("_to")).where("_to >= _from")
    spans = spans.select("*", F.explode(F.sequence(F.floor((F.col("_from") - 1) / chunk), F.floor((F.col("_to") - 1) / chunk))).alias("_no"))
    begin = F.greatest(F.col("_from") - 1 - F.col("_no") * chunk, F.lit(0))
    part = F.expr("substring(_piece, CAST(_a + 1 AS INT), CAST(_b - _a AS INT))")
    met = spans.join(chunks, ["seq_id", "_no"]).withColumn("_a", begin).withColumn("_b", F.least(F.col("_to") - F.col("_no") * chunk, F.lit(chunk)))
    minus = F.col("strand") == "-"
    met = met.select("feat_idx", "_k", F.when(minus, -F.col("_no")).otherwise(F.col("_no")).alias("_o"), F.when(minus, reverse_complement(as_text(part))).otherwise(as_text(part)).alias("_part"))
    whole = met.groupBy("feat_idx").agg(F.array_join(F.sort_array(F.collect_list(F.struct("_k", "_o", "_part")))["_part"], "").alias("coding_seq"))  # as long as the feature
    return features.join(whole, "feat_idx", "left").select(*features.columns, F.coalesce("coding_seq", F.lit("")).alias("coding_seq"))


def translated(seq: Column, table_id: Column, phase: Column) -> Column:
    """The protein of a coding sequence under a code; one stop at the end goes, others stay as ``*``.

    Worked out once a row: nothing that reads it may have it worked out again.
    """
    aminos = {t: codes.genetic_code(t).amino for t in codes.CODES}
    default = aminos[codes.DEFAULT]

    def proteins_of(seqs: pa.Array, tables: pa.Array, phases: pa.Array) -> pa.Array:
        out = []
        for own, table, skip in zip(seqs.to_pylist(), tables.to_pylist(), phases.to_pylist()):
            own, amino, first = own or "", aminos.get(table, default), skip if skip in (1, 2) else 0
            upper, last = own.upper(), first + (len(own) - first) // 3 * 3
            out.append("".join([amino.get(upper[k : k + 3], "X") for k in range(first, last, 3)]).removesuffix("*"))
        return pa.array(out, pa.string())

    return F.arrow_udf(proteins_of, "string").asNondeterministic()(seq, table_id, phase)


def label() -> Column:
    made = F.concat_ws("_", "type", "seq_id", F.col("start").cast("string"))
    return F.coalesce(non_empty(F.col("name")), non_empty(F.col("locus_tag")), non_empty(F.col("id")), made)


def defline() -> Column:
    place = F.concat(F.col("seq_id"), F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string"), F.lit("("), F.col("strand"), F.lit(")"))
    gene = F.when(non_empty(F.col("name")).isNotNull(), F.concat(F.lit("gene="), F.col("name"))).when(non_empty(F.col("locus_tag")).isNotNull(), F.concat(F.lit("locus_tag="), F.col("locus_tag")))
    return F.concat_ws(" ", label(), place, F.concat(F.lit("type="), F.col("type")), gene, non_empty(F.col("product")))


def proteins(features: DataFrame, records: DataFrame, table_id: int = codes.DEFAULT) -> DataFrame:
    """Exportable features with ``coding_seq``, ``table`` and ``protein``; those without a protein go."""
    own = coding_sequences(exportable(features), records).withColumn("table", F.coalesce("transl_table", F.lit(table_id)))
    return own.withColumn("protein", translated(F.col("coding_seq"), codes.supported(F.col("table")), F.col("phase"))).where("protein <> ''")
