"""Filters, orders and views of stops and genes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.sequence import feature_key, non_empty, signed_frame, truncated
from ..schema import CODING

SHOWN_ROWS, FLAGGED_ROWS, MAX_TICKS, MAX_GENES = 5000, 20, 12_000, 8_000
TERMINATORS = ("cds-terminator", "orf-terminator")


def display_hits(hits: DataFrame, mode: str = "all") -> DataFrame:
    """``coding`` keeps terminators alone; ``all`` keeps every hit."""
    return hits.where(F.col("context").isin(*TERMINATORS)) if mode == "coding" else hits


def hit_gene_name() -> Column:
    return F.coalesce(non_empty(F.col("gene_name")), non_empty(F.col("locus_tag")), truncated(non_empty(F.col("product")), 40), F.col("feature_id"), F.lit(""))


def hit_filter(codon: str = "all", strand: str = "all", context: str = "all", seq_id: str = "", gene: str = "") -> Column:
    """Equality on codon, strand and context; substrings, case aside, of record and gene."""
    passes = F.lit(True)
    for column, value in (("codon", codon), ("strand", strand), ("context", context)):
        if value != "all":
            passes &= F.col(column) == value
    if seq_id.strip():
        passes &= F.lower("seq_id").contains(seq_id.strip().lower())
    if gene.strip():
        passes &= F.lower(hit_gene_name()).contains(gene.strip().lower())
    return passes


def filter_hits(hits: DataFrame, **given: str) -> DataFrame:
    """The hits that pass ``hit_filter``."""
    return hits.where(hit_filter(**given))


def sort_hits(hits: DataFrame, key: str = "start", descending: bool = False, limit: int | None = SHOWN_ROWS) -> DataFrame:
    """A view in order of one column, ties in scan order, of at most ``limit`` rows."""
    by = F.lower(hit_gene_name()) if key == "gene" else F.col(key)
    ordered = hits.orderBy(by.desc() if descending else by.asc(), "hit_no")
    return ordered.limit(limit) if limit else ordered


def sort_genes(genes: DataFrame, key: str = "internal_stops", descending: bool = True) -> DataFrame:
    return genes.orderBy(F.col(key).desc() if descending else F.col(key).asc(), "feat_idx")


def flagged_genes(genes: DataFrame, limit: int = FLAGGED_ROWS) -> DataFrame:
    return sort_genes(genes.where("internal_stops > 0")).limit(limit)


def exportable(features: DataFrame) -> DataFrame:
    return features.where(F.col("type").isin(*CODING))


def table_counts(hits: DataFrame, passes: Column, limit: int = SHOWN_ROWS) -> DataFrame:
    """One row from one pass: rows shown, rows that pass the filter, and all rows."""
    filtered = F.count(F.when(passes, 1))
    return hits.agg(F.least(filtered, F.lit(limit).cast("long")).alias("shown"), filtered.alias("filtered"), F.count(F.lit(1)).alias("total"))


# ---- what charts are drawn from


def within_cap(rows: DataFrame, limit: int, key: str = "seq_id") -> DataFrame:
    """The rows of records that have at most ``limit``; others are skipped whole, as ``skipped`` tells."""
    few = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") <= limit).select(key)
    return rows.join(few, key, "left_semi")


def chart_notes(hits: DataFrame, features: DataFrame, ticks: int = MAX_TICKS, genes: int = MAX_GENES) -> DataFrame:
    """A row a record with stops or genes: how many, whether its stops are drawn, how many genes are, and a note where something isn't."""
    stops = hits.groupBy("seq_id").agg(F.count(F.lit(1)).alias("n_stops"))
    own = exportable(features).groupBy("seq_id").agg(F.count(F.lit(1)).alias("n_genes"))
    rows = stops.join(own, "seq_id", "full").select("seq_id", F.coalesce("n_stops", F.lit(0)).alias("n_stops"), F.coalesce("n_genes", F.lit(0)).alias("n_genes"))
    drawn, shown = F.col("n_stops") <= ticks, F.least(F.col("n_genes"), F.lit(genes).cast("long"))
    no_ticks = F.when(~drawn, F.concat(F.col("n_stops").cast("string"), F.lit(f" stops are more than the {ticks} that are drawn one by one; see the density.")))
    few_genes = F.when(F.col("n_genes") > genes, F.concat(F.lit(f"The first {genes} of "), F.col("n_genes").cast("string"), F.lit(" genes by start.")))
    return rows.select("seq_id", "n_stops", "n_genes", drawn.alias("ticks_drawn"), shown.alias("genes_drawn"), F.concat_ws(" ", no_ticks, few_genes).alias("note"))


def first_genes(lanes: DataFrame, limit: int = MAX_GENES) -> DataFrame:
    """The first ``limit`` genes of each record by start."""
    rank = F.row_number().over(Window.partitionBy("seq_id").orderBy("start", "feat_idx"))
    return lanes.withColumn("_k", rank).where(F.col("_k") <= limit).drop("_k")


def frame_track(hits: DataFrame, limit: int = MAX_TICKS) -> DataFrame:
    """Ticks by signed frame of the records that have at most ``limit`` stops."""
    rows = hits.select("seq_id", signed_frame(F.col("strand"), F.col("frame")).alias("lane"), "start", "codon", "id")
    return within_cap(rows, limit)


def circular_angles(hits: DataFrame, records: DataFrame) -> DataFrame:
    """The angle of each hit on its circular record, in degrees."""
    circles = records.where("circular").select("seq_id", "length")
    return hits.join(circles, "seq_id").select("seq_id", "start", "strand", "rpos", "codon", ((F.col("start") - 1) / F.col("length") * 360).alias("angle"))


def feature_angles(features: DataFrame, records: DataFrame) -> DataFrame:
    """The angles at which genes, CDS and ORFs start and end on their circular records, in degrees."""
    circles = records.where("circular").select("seq_id", "length")
    own = features.where(F.col("type").isin("gene", *CODING)).join(circles, "seq_id")
    at = lambda c: (F.col(c) - 1) / F.col("length") * 360
    return own.select("feat_idx", "seq_id", "type", "strand", at("start").alias("from_angle"), at("end").alias("to_angle"))


def gene_lanes(hits: DataFrame, features: DataFrame, records: DataFrame) -> DataFrame:
    """The frame each CDS or ORF is drawn in: that of the first stop that ends it, else of its last codon's place."""
    own = exportable(features).withColumn("key", feature_key())
    order = F.struct("wraps", "seq_idx", (F.col("strand") == "-").alias("_m"), "frame", "rpos")
    ids = F.array_union(F.coalesce("terminator_feature_ids", F.array().cast("array<string>")), F.array("feature_id"))
    ends = hits.where(F.col("context").isin(*TERMINATORS)).select("seq_id", F.explode(ids).alias("key"), F.struct(signed_frame(F.col("strand"), F.col("frame")).alias("lane"), "codon").alias("v"), order.alias("_o"))
    ends = ends.where("key IS NOT NULL").groupBy("seq_id", "key").agg(F.min_by("v", "_o").alias("v"))
    rows = own.join(ends, ["seq_id", "key"], "left").join(records.select("seq_id", "length"), "seq_id")
    place = F.when(F.col("strand") == "-", F.col("length") - (F.col("start") + 2)).otherwise(F.col("end") - 3)
    fallback = signed_frame(F.col("strand"), (F.pmod(place, F.lit(3)) + 1).cast("int"))
    return rows.select("feat_idx", "seq_id", "key", "start", "end", F.coalesce("v.lane", fallback).alias("lane"), F.col("v.codon").alias("codon"))


def colour_index(codon: Column, stops: list[str]) -> Column:
    """Which of six colours a codon has: its place among the stops; the last for others."""
    place = F.array_position(F.array(*map(F.lit, stops)), codon) - 1
    return F.when(place < 0, 5).otherwise(place % 6).cast("int")
