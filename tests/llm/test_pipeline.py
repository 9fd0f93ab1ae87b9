"""Each stage of the pipeline against a plain version of it, on the smallest tables."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ochre.llm import queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


def test_stages(spark):
    from test_similar import brute as groups
    from test_text_filters import brute_alignment, brute_lines, word_list

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").cache()
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    stages = dict(corpus_pipeline.STAGES)
    assert names == ["quality classifier", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "best-fit packing"]

    kept = stages[names[0]](spark, docs, FOLDER)
    assert kept.columns == columns and {r["doc_id"] for r in kept.collect()} <= {r["doc_id"] for r in docs.collect()}
    rated = queries.op10_ordinal_quality(spark, FOLDER)
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in rated.where("keep").collect()}

    texts = [r["text"] for r in docs.orderBy("doc_id").collect()]
    cut = stages[names[1]](spark, docs, FOLDER)
    rows = cut.orderBy("doc_id").collect()
    assert cut.columns == columns and [r["text"] for r in rows] == brute_lines(texts)[0] and all(r["n_chars"] == len(r["text"]) for r in rows)

    one = stages[names[2]](spark, docs, FOLDER)
    ids = [r["doc_id"] for r in docs.orderBy("doc_id").collect()]
    expected = {ids[k] for k, (_, c) in groups(texts).items() if c == k}
    assert one.columns == columns and sorted(r["doc_id"] for r in one.collect()) == sorted(expected)

    clean = stages[names[3]](spark, docs, FOLDER)
    items = [word_list(r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    pairs = {i: word_list(t) for i, t in zip(ids, texts)}
    grams = lambda w: {tuple(w[k : k + 4]) for k in range(len(w) - 3)}
    bad = {i for i, w in pairs.items() for item in items if grams(item) & grams(w) and brute_alignment(item, w) >= len(item)}
    assert clean.columns == columns and {r["doc_id"] for r in clean.collect()} == set(ids) - bad


def test_run(spark):
    rows = corpus_pipeline.run(spark, FOLDER)
    assert rows.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
    assert rows.where("piece = 0").select("doc_id").distinct().count() > 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for file in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{FOLDER}/{file}'")
    found = queries.QUERIES[name](spark, FOLDER)
    told = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in told.description]
    assert sorted(names) == sorted(found.columns)
    assert sorted((tuple(r[n] for n in names) for r in found.collect()), key=str) == sorted(told.fetchall(), key=str)


def test_stages_on_odd_tables(spark):
    """Null ids, null and empty texts, repeated rows and empty tables go through every stage as its docstring says."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(60)
    item = spark.read.parquet(f"{FOLDER}/benchmark.parquet").first()["text"]
    odd = spark.createDataFrame([(None, None), (None, "a text without an id, good enough to stay"), (900_001, None), (900_002, ""), (900_003, "same"), (900_003, "same"), (None, item)], "doc_id long, text string")
    more = odd.select("doc_id", "text", *[F.lit(None).cast(t).alias(c) for c, t in docs.dtypes if c not in ("doc_id", "text")]).select(*docs.columns)
    rows = docs.unionByName(more)
    rows = rows.cache()
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, rows.limit(0), FOLDER)
        assert none.count() == 0 and (name == "best-fit packing" or none.columns == docs.columns)
        out = stage(spark, rows, FOLDER).collect()
        texts = [(r["doc_id"], r["text"]) for r in out] if name != "best-fit packing" else []
        if name == "line dedup":
            assert len(out) == rows.count() and texts.count((900_003, "same")) == 2 and (900_001, None) in texts
        elif name == "n-gram Jaccard join":
            assert texts.count((900_003, "same")) == 1 and (900_001, None) in texts and (900_002, "") in texts and sum(d is None for d, _ in texts) == 3
        elif name == "benchmark decontamination":
            assert (None, item) not in texts and (None, None) in texts and texts.count((900_003, "same")) == 2
        elif name == "best-fit packing":
            assert {900_001, 900_002, 900_003, None} <= {r["doc_id"] for r in out}
