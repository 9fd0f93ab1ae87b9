"""A corpus pipeline: each stage works on what its predecessor kept.

``STAGES`` lists (name, function); a function takes (spark, documents, sf_dir) and
returns a DataFrame, which is written as Parquet and read again for the next stage.
All stages but the last return the columns of ``documents``, extra ones with them.

In all stages an empty table stays one, repeated rows share their fate, and long texts
are taken whole; what a null ``doc_id`` or text, or a tie, gives is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ochre.llm import decontaminate, line_windows, ngram_join, packing, quality
from ochre.llm.common import discard, temporary, written
from ochre.llm.queries import document_grades

#: Starts the names of columns that stages add for a while.
OWN = "__pipeline_"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that are good with a probability of at least a half (operator 10).

    A null or empty text is rated by its lack of words; a null ``doc_id`` has no label
    but is rated like others; a probability of exactly a half keeps.
    """
    model = quality.fit(docs, document_grades(spark, sf_dir), n_grades=3, max_rows=20_000)
    return quality.score(docs, model, tail_grade=2, least=0.5, prefix=OWN).where(f"{OWN}keep").select(*[F.col(f"`{c}`") for c in docs.columns])


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes later occurrences of repeated three-line windows out of the texts (operator 6); every row stays.

    A null text stays null; null ids come first; between equal ids the text's hash, then
    the place decides which occurrence is the first; ``n_chars`` follows the text.
    """
    cut = line_windows.dedup_lines(docs.select("doc_id", "text", F.struct("*").alias(f"{OWN}row")), width=3)
    row = F.col(f"{OWN}row")
    changed = {"text": F.col("text"), "n_chars": F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(row["n_chars"])}
    return cut.select(*[changed.get(c, row[c]).alias(c) for c in docs.columns])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of similar ones (operator 5).

    Null and empty texts are like nothing and stay, as do rows with a null ``doc_id``; of
    rows that share an id one stays.
    """
    return ngram_join.one_of_each(docs, ngram_join.similar_documents(docs))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in which no benchmark item stands (operator 8).

    Null and empty texts stay; null ids are judged like others; a score of exactly
    ``least`` takes a document out.
    """
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), least=0.5)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes in sequences of 2048 tokens (operator 3).

    A null text is empty: one piece with the end id alone.  Pieces of equal length take
    slots in the order of their ids; which they get is not said otherwise.
    """
    return packing.pack_documents(docs, capacity=2048)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", benchmark_stage),
    ("best-fit packing", packing_stage),
]

#: SQL can express neither the classifier nor the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for k, (_, stage) in enumerate(STAGES[:-1]):
        with temporary(spark) as keep:
            docs = keep(written(stage(spark, docs, sf_dir), f"stage{k}"))
        if before is not None:
            discard(before)  # the stage after it is written
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
