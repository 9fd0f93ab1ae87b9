"""CSV, TSV and Markdown tables of hits, genes and frames.

Each format is a DataFrame of ``ord, line``, so a table of any size is written by
many tasks with ``write_parts``; ``text_of`` makes the exact text of a small one.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import FRAMES

COORDINATES = "Coordinates are 1-based and inclusive, so start and end both count. BED files alone are 0-based and half-open (chromStart = start - 1). A stop has one id (stop_0001, ...) in all formats."
ENDS = {"csv": ("\r\n", ""), "tsv": ("\n", "\n"), "md": ("\n", "\n"), "text": ("\n", "\n")}


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def csv_cell(c: Column) -> Column:
    s = _text(c)
    marked = s.contains('"') | s.contains(",") | s.contains("\n") | s.contains("\r")  # no pattern, which costs more than all the rest
    return F.when(marked, F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def tsv_cell(c: Column) -> Column:
    return F.regexp_replace(_text(c), "[\t\r\n]+", " ")


def md_cell(c: Column) -> Column:
    return F.regexp_replace(F.replace(_text(c), F.lit("|"), F.lit("\\|")), "[\r\n]+", " ")


def line(cells: Iterable[Column], kind: str) -> Column:
    if kind == "csv":
        return F.concat_ws(",", *map(csv_cell, cells))
    if kind == "tsv":
        return F.concat_ws("\t", *map(tsv_cell, cells))
    return F.concat(F.lit("| "), F.concat_ws(" | ", *map(md_cell, cells)), F.lit(" |"))


def _yes(c: str) -> Column:
    return F.when(F.col(c), "yes").otherwise("")


def hit_cells(annotated: bool = False) -> dict[str, Column]:
    cells = {"stop_id": F.col("id"), **{c: F.col(c) for c in ("seq_id", "start", "end", "strand", "frame", "codon", "name")}}
    if annotated:
        cells |= {"gene": F.col("gene_name"), "locus_tag": F.col("locus_tag"), "product": F.col("product"), "context": F.col("context"), "recoding_candidate": _yes("recoding_candidate")}
    return cells


def gene_cells() -> dict[str, Column]:
    names = {"gene": "gene", "locus_tag": "locus_tag", "product": "product", "length_bp": "length", "internal_stops": "internal_stops", "terminator_codon": "terminator_codon", "strand": "strand"}
    return {k: F.col(v) for k, v in names.items()} | {"pseudogene_flag": _yes("pseudogene_flag"), "feature_id": F.col("feature_id")}


def frame_cells(stops: list[str]) -> dict[str, Column]:
    return {c: F.col(c) for c in ("frame", *stops, "total")}


def table_lines(rows: DataFrame, cells: dict[str, Column], order: Column, kind: str) -> DataFrame:
    """``ord, line``: the header at 0, then each row at its ``order`` (from 1)."""
    header = rows.sparkSession.range(1).select(F.lit(0).cast("long").alias("ord"), line([F.lit(c) for c in cells], kind).alias("line"))
    if kind == "md":
        rule = rows.sparkSession.range(1).select(F.lit(0).cast("long").alias("ord"), line([F.lit("---")] * len(cells), kind).alias("line"))
        header = header.unionByName(rule)
    return header.unionByName(rows.select(order.cast("long").alias("ord"), line(cells.values(), kind).alias("line")))


def hit_lines(hits: DataFrame, kind: str = "csv", annotated: bool = False) -> DataFrame:
    return table_lines(hits, hit_cells(annotated), F.col("hit_no"), kind)


def gene_lines(genes: DataFrame, kind: str = "csv") -> DataFrame:
    return table_lines(genes, gene_cells(), F.col("feat_idx") + 1, kind)


def frame_lines(breakdown: DataFrame, stops: list[str], kind: str = "csv") -> DataFrame:
    return table_lines(breakdown, frame_cells(stops), F.array_position(F.array(*map(F.lit, FRAMES)), F.col("frame")), kind)


def text_of(lines: DataFrame, kind: str) -> str:
    """The exact text, line by line through the driver."""
    between, after = ENDS[kind]
    return between.join(r["line"] for r in lines.orderBy("ord").select("line").toLocalIterator()) + after


def write_text(lines: DataFrame, kind: str, path: str) -> None:
    """One local file, written as lines come in, so the driver holds one partition at a time."""
    between, after = ENDS[kind]
    with open(path, "w", encoding="utf-8", newline="") as out:
        for k, row in enumerate(lines.orderBy("ord").select("line").toLocalIterator()):
            out.write((between if k else "") + row["line"])
        out.write(after)


def write_parts(lines: DataFrame, path: str, parts: int | None = None) -> None:
    """Many files whose names are in order of their lines, each written by a task."""
    ordered = lines.repartitionByRange(parts, "ord") if parts else lines.repartitionByRange("ord")
    ordered.sortWithinPartitions("ord").select("line").write.text(path)
