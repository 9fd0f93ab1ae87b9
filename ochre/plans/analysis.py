"""A whole analysis: files in, annotated stops and summaries out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codes
from ..operators import aggregate, annotate, orf, scan, select
from ..sources.dispatch import Loaded, load
from ..sources.files import header_lines


@dataclass
class Analysis:
    records: DataFrame
    features: DataFrame
    hits: DataFrame
    table_id: int
    table_source: str
    table_note: str
    mode: str
    warnings: list[str]
    errors: list[str]

    @property
    def stops(self) -> list[str]:
        return list(codes.stop_set(self.table_id))

    def display_hits(self) -> DataFrame:
        return select.display_hits(self.hits, self.mode)

    def summary(self) -> DataFrame:
        return aggregate.summary(self.hits, self.records, self.stops)

    def genes(self) -> DataFrame:
        return aggregate.gene_summary(self.hits, self.features)

    def frames(self) -> DataFrame:
        return aggregate.frame_breakdown(self.hits, self.stops)

    def sanity(self) -> DataFrame | None:
        """Only for codes whose stops don't depend on context."""
        return None if codes.genetic_code(self.table_id).ambiguous_stops else aggregate.code_sanity(self.genes())


def resolve_table(manual: int | None = None, organism: int | None = None, declared: int | None = None, header: int | None = None) -> tuple[int, str]:
    """The code to use and what chose it: a manual choice, a typed organism, the features, the headers, or the default."""
    for table_id, source in ((manual, "manual"), (organism, "organism"), (declared, "declared"), (header, "header")):
        if table_id is not None:
            return codes.genetic_code(table_id).id, source
    return codes.DEFAULT, "default"


def table_note(table_id: int, source: str, declared: int | None, header: int | None) -> str:
    """What chose the code, and who disagrees."""
    told = {"manual": "chosen by hand", "organism": "chosen by the organism typed in", "declared": "declared by the features", "header": "suggested by the headers", "default": "the default"}[source]
    note = f"Genetic code {table_id} ({codes.genetic_code(table_id).name}): {told}."
    for other, what in ((declared, "The features declare"), (header, "The headers suggest")):
        if other is not None and other != table_id:
            note += f" {what} code {other}."
    return note


def organism_code(spark, text: str | None) -> int | None:
    if not text:
        return None
    return spark.range(1).select(codes.organism_table(F.lit(text)).alias("t")).first()["t"]


def analyse(files: DataFrame, large_fasta: DataFrame | None = None, large_genbank: DataFrame | None = None, large_gff: DataFrame | None = None, table_id: int | None = None, organism: str | None = None, mode: str | None = None, min_orf_nt: int = 90, require_start: bool = True, include_alt_starts: bool = False) -> Analysis:
    """Scans ``files`` (file_no, name, text) and large files as ``read_fasta``, ``read_genbank`` and ``gff3.read_lines`` give them.

    ``mode`` is ``coding`` by default where there are CDS features, else ``all``; in
    coding mode without any CDS, open reading frames are predicted and take their place.
    """
    spark = files.sparkSession
    loaded: Loaded = load(files, large_fasta, large_genbank, large_gff)
    records, features = loaded.records.cache(), loaded.features.cache()
    declared_row = aggregate.declared_table(features).first()
    declared, header = declared_row["table_id"], codes.organism_of_lines(header_lines(files)).first()["table_id"]
    chosen, source = resolve_table(table_id, organism_code(spark, organism), declared, header)
    warnings = loaded.warnings + ([declared_row["warning"]] if declared_row["warning"] else [])
    note = aggregate.ambiguity_warning(records).first()["note"]
    warnings += [note] if note else []
    hits = scan.numbered(scan.scan(records, chosen))
    has_cds = bool(features.where("type = 'CDS'").take(1))
    mode = mode or ("coding" if has_cds else "all")
    if mode == "coding" and not has_cds:
        orfs = orf.predict_orfs(records, hits, chosen, min_orf_nt, require_start=require_start, include_alt_starts=include_alt_starts)
        features = features.unionByName(orfs.withColumn("feat_idx", F.col("feat_idx") + (1 << 61)))
    annotated = annotate.annotate(hits, features, chosen) if features.take(1) else annotate.without_context(hits)
    return Analysis(records, features, annotated, chosen, source, table_note(chosen, source, declared, header), mode, warnings, loaded.errors)
