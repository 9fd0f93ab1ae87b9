"""The queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, hard_negatives, license_scan, line_windows, media, ngram_join, packing, quality, token_files, token_rollups, url_reputation, whitening
from .common import scratch, written
from .tokens import vocabulary
from .url_reputation import Rule


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(_table(spark, sf_dir, "documents"), "text")


def op2_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after three batches, each committed twice: all documents are loaded with one
    tokenizer, those not in English are counted anew with a multilingual one, and the
    documents labelled toxic are taken down."""
    documents = _table(spark, sf_dir, "documents")
    loaded = written(token_rollups.count_tokens(documents, "byte_bpe_50k", vocabulary("byte_bpe_50k.json")), "counts")
    foreign = ~F.col("lang").eqNullSafe("en")
    recounted = written(token_rollups.count_tokens(documents.where(foreign), "byte_bpe_multi_50k", vocabulary("byte_bpe_multi_50k.tiktoken")), "counts")
    now = loaded.where(~foreign).unionByName(recounted)
    toxic = _table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct()
    store = token_rollups.RollupStore(spark, scratch(spark, "rollups"))
    for _ in range(2):
        store.commit("load", token_rollups.inserted(loaded))
        store.commit("recount", token_rollups.revised(loaded.where(foreign), recounted))
        store.commit("take-down", token_rollups.deleted(now.join(toxic, "doc_id", "left_semi")))
    return store.totals()


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), capacity=2048)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(_table(spark, sf_dir, "documents"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(_table(spark, sf_dir, "documents"))


def op6_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_windows.dedup_lines(_table(spark, sf_dir, "documents"), width=3)


#: The rules of the URL query.
URL_RULES = [Rule("com/en/", "block"), Rule("example.com/en/7", "allow"), Rule("net/de/", "allow"), Rule("example.net/de/8", "block"), Rule("org/es/", "block")]


def op7_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes are the labels with the page's id: bad if of low quality or toxic."""
    bad = (F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)
    outcomes = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    return url_reputation.judge_urls(_table(spark, sf_dir, "pages"), outcomes, URL_RULES, z=1.645, max_bad=0.3)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents in which a benchmark item stands, whole or edited, with the item."""
    found = decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), least=0.5)
    return found.select("doc_id", "item_id", "score", "start_word", "end_word")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_table(spark, sf_dir, "documents"))


def document_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graded ratings from the labels: 0 toxic, 1 of low quality, 2 good; unlabelled values give no grade."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return _table(spark, sf_dir, "labels").select("doc_id", grade.alias("grade"))


def op10_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    model = quality.fit(documents, document_grades(spark, sf_dir), n_grades=3, max_rows=20_000)
    rated = quality.score(documents.select("doc_id", "text"), model, tail_grade=2, least=0.5)
    return rated.select("doc_id", "expected_grade", F.col("tail").alias("p_good"), "keep")


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode_texts(_table(spark, sf_dir, "documents").select("doc_id", "text"), path).drop("text")
    decoded = bpe.decode_ids(encoded, path)
    decimal = F.array_join(F.transform("ids", lambda x: x.cast("string")), ",")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(decimal.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = _table(spark, sf_dir, "embeddings")
    model = whitening.fit(embeddings, "embedding", scale=1024.0, offset=100_000)
    rows = whitening.whiten(embeddings, model, "embedding", components=8)
    explained = model.explained[:8]
    error = whitening.identity_error(rows, len(explained))
    long = rows.select("vec_id", "n", F.expr("try_cast(deviation AS bigint)").alias("deviation"), F.posexplode("whitened").alias("k", "whitened"))
    shares = F.array(*map(F.lit, explained)) if explained else F.array().cast("array<double>")
    return long.select("vec_id", (F.col("k") + 1).alias("component"), "n", "deviation", "whitened", F.get(shares, F.col("k")).alias("explained"), F.lit(error).cast("double").alias("identity_error"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh label is read as the next one, as a wrong label would be."""
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    embeddings = _table(spark, sf_dir, "embeddings").select("vec_id", noisy.alias("label"), "embedding")
    return hard_negatives.mine(embeddings, F.col("vec_id") % 50 == 0, "vec_id", "label", "embedding", scale=256.0, positives=5, negatives=3, low=50, high=95)


QUERIES = {
    "op1_flac_media": op1_flac_media,
    "op2_token_rollups": op2_token_rollups,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_token_files": op4_token_files,
    "op5_ngram_join": op5_ngram_join,
    "op6_line_windows": op6_line_windows,
    "op7_url_reputation": op7_url_reputation,
    "op8_decontamination": op8_decontamination,
    "op9_license_scan": op9_license_scan,
    "op10_ordinal_quality": op10_ordinal_quality,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_whitening": op12_whitening,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE_SQL: dict[str, str] = {
    "op5_ngram_join": ngram_join.SIMILAR_SQL,
    "op6_line_windows": line_windows.DEDUP_SQL,
    "op7_url_reputation": url_reputation.JUDGE_SQL,
    "op9_license_scan": license_scan.SCAN_SQL,
    "op13_hard_negatives": hard_negatives.MINE_SQL,
}
