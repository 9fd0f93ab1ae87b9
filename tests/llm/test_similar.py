import os
import random
import re

import numpy as np
from corpora import documents, empty, odd_texts, prose
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ochre.llm import decontaminate, ngram_join
from ochre.llm.components import connected_components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute(texts):
    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in range(len(texts))}


def found(frame):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.similar_documents(frame).collect()}


def corpus():
    r = random.Random(9)
    texts = odd_texts()
    for _ in range(4):  # groups of near copies, some on either side of the threshold, with a shared passage
        base = prose(r, r.randint(20, 90)).split(" ")
        passage = prose(r, 60)
        for _ in range(12):
            own = base.copy()
            for _ in range(r.randint(0, 4)):
                own[r.randrange(len(own))] = r.choice(["x", "y", "z"])
            texts.append(" ".join(own))
        texts += [passage + " " + prose(r, n) for n in (3, 10, 15, 40)]
    return texts


def test_against_brute_force(spark):
    texts = corpus()
    assert found(documents(spark, texts)) == brute(texts)


def test_without_hubs_the_prefixes_find_all(spark, monkeypatch):
    """With the first step switched off, the prefix step alone must find every link."""
    texts = corpus()
    monkeypatch.setattr(ngram_join, "_star_pairs", lambda classes: classes.select(F.col("id").alias("u"), F.col("id").alias("v")).limit(0))
    assert found(documents(spark, texts)) == brute(texts)


def test_with_shuffles_instead_of_broadcasts(spark, monkeypatch):
    texts = corpus()[:50]
    monkeypatch.setattr(ngram_join, "SENT_BYTES", -1)
    monkeypatch.setattr(ngram_join, "STAR_ROWS", 2)
    assert found(documents(spark, texts)) == brute(texts)


def test_odd_tables(spark):
    assert ngram_join.similar_documents(empty(spark)).count() == 0
    base = "a b c d e f g h"
    rows = documents(spark, [base, base]).unionByName(documents(spark, [base]).withColumn("doc_id", F.lit(None).cast("long"))).unionByName(documents(spark, [base]))
    result = ngram_join.similar_documents(rows).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in result if r["doc_id"] is not None) == [(0, 0), (0, 0), (1, 0)]
    assert [r["component_id"] for r in result if r["doc_id"] is None] == [None]
    kept = ngram_join.one_of_each(rows, ngram_join.similar_documents(rows))
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [0, None]


def test_an_id_with_several_texts_is_one_node(spark):
    a, b = "a b c d e f g h", "p q r s t u v w"
    rows = documents(spark, [a, b, "else"]).withColumn("doc_id", F.lit(5).cast("long")).where("text <> 'else'").unionByName(documents(spark, ["", "", "", b, "so on and on it goes"]).where("doc_id >= 3"))
    result = sorted((r["doc_id"], r["component_id"]) for r in ngram_join.similar_documents(rows).collect())
    assert result == [(3, 3), (4, 4), (5, 3), (5, 3)]
    assert sorted(r["doc_id"] for r in ngram_join.one_of_each(rows, ngram_join.similar_documents(rows)).collect()) == [3, 4]


def test_long_texts_and_scratch(spark):
    r = random.Random(12)
    long = prose(r, 250_000)
    assert len(long) > 1_500_000
    changed = " ".join("x" if k % 40 == 0 else w for k, w in enumerate(long.split(" ")))
    texts = [long, changed, "short one", long + " and more"]
    assert found(documents(spark, texts)) == brute(texts)
    from ochre.llm.common import _made, clear_scratch

    left = _made[spark.sparkContext.applicationId]
    assert left and all(os.path.exists(p) for p in left) and not [p for p in left if "/edges-" in p or "/marks-" in p]
    mine = ngram_join.similar_documents(documents(spark, texts))
    assert mine.count() == 4
    clear_scratch(spark)
    assert not any(os.path.exists(p) for p in left)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=14))
def test_components(spark, edges):
    parent = list(range(13))
    for _ in range(13):
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    rows = connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r["vertex"]: r["component"] for r in rows} == {x: parent[x] for e in edges if e[0] != e[1] for x in e}


def test_long_chain(spark):
    rows = connected_components(spark.range(60).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))).collect()
    assert len(rows) == 61 and {r["component"] for r in rows} == {0}


def test_blocks_of_few_words():
    for text in ("a", "a b", "a b c", "a b c d", ""):
        raw = np.frombuffer(text.encode(), np.uint8)
        assert len(ngram_join.shingle_sets(raw, np.array([0, len(raw)]))[0]) == bool(text)
        words, _ = decontaminate.word_hashes(raw, np.array([0, len(raw)]))
        assert len(decontaminate.ngrams(words)) == len(words) == len(text.split())


def test_hashes_of_shingles_are_sets():
    texts = [t for t in odd_texts() if t]
    raw = [t.encode() for t in texts]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    sets = ngram_join.shingle_sets(np.frombuffer(b"".join(raw), np.uint8), bounds)
    assert [len(s) for s in sets] == [len(shingles(t)) for t in texts]


def test_clashing_columns(spark):
    docs = documents(spark, odd_texts()[:12], extra=False)
    clash = docs
    for name in ("group", "component", "n", "shingle", "hash", "component_id", "n_shingles", "members"):
        clash = clash.withColumn(name, F.lit("x"))
    assert found(clash) == found(docs)
