"""FASTA of coding sequences and proteins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codes
from ..functions.sequence import wrapped_lines
from ..operators.extract import coding_sequences, defline, proteins
from ..operators.select import exportable


def fna_rows(features: DataFrame, records: DataFrame, width: int = 60) -> DataFrame:
    """``feat_idx, line``: an entry a CDS or ORF with a sequence."""
    own = coding_sequences(exportable(features), records).where("coding_seq <> ''")
    return own.select("feat_idx", F.concat(F.lit(">"), defline(), F.lit("\n"), wrapped_lines(F.col("coding_seq"), width)).alias("line"))


def faa_rows(features: DataFrame, records: DataFrame, table_id: int = codes.DEFAULT, width: int = 60) -> DataFrame:
    """``feat_idx, line``: an entry a protein, with the code it was translated by."""
    own = proteins(features, records, table_id)
    return own.select("feat_idx", F.concat(F.lit(">"), defline(), F.lit(" table="), F.col("table").cast("string"), F.lit("\n"), wrapped_lines(F.col("protein"), width)).alias("line"))
