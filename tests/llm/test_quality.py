import math
import random
import re

import numpy as np
import pytest
from corpora import documents, empty, odd_texts, prose

from ochre.llm import quality


def labelled(n=600):
    r = random.Random(8)
    rows = []
    for k in range(n):
        grade = (2, 2, 2, 1, 0)[k % 5]
        words = prose(r, r.randint(30, 120)).split(" ")
        if grade == 0:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(["nasty", "awful", "vile"]))
        if grade == 1:
            words = [w + r.choice(["%%%", "***", "###"]) for w in words]
        rows.append((" ".join(words), grade))
    return rows


def test_held_out_accuracy(spark):
    rows = labelled()
    docs = documents(spark, [t for t, _ in rows])
    grades = spark.createDataFrame([(k, g) for k, (_, g) in enumerate(rows) if k < 400] + [(None, 1), (1, None)], "doc_id long, grade int")
    model = quality.fit(docs, grades, n_grades=3)
    assert (np.diff(model.thresholds) >= 0).all()
    rated = {r["doc_id"]: r for r in quality.score(docs, model, tail_grade=2).collect()}
    held = [(k, g) for k, (_, g) in enumerate(rows) if k >= 400]
    assert np.mean([rated[k]["keep"] == (g == 2) for k, g in held]) > 0.95
    assert np.mean([rated[k]["keep"] for k, g in held if g == 2]) > 0.98
    means = [np.mean([rated[k]["expected_grade"] for k, g in held if g == x]) for x in range(3)]
    assert means == sorted(means)
    again = quality.fit(docs, grades, n_grades=3)
    assert (again.weights == model.weights).all()


def test_the_sample_is_bounded(spark):
    rows = labelled(100)
    docs = documents(spark, [t for t, _ in rows])
    grades = spark.createDataFrame([(k, g) for k, (_, g) in enumerate(rows)], "doc_id long, grade int")
    seen = []
    original, quality.fit_ordinal = quality.fit_ordinal, lambda index, starts, g, *a: seen.append(len(g)) or original(index, starts, g, *a)
    try:
        quality.fit(docs, grades, n_grades=3, max_rows=30)
    finally:
        quality.fit_ordinal = original
    assert seen == [30]


def test_repeated_ids_count_once(spark):
    rows = labelled(60)
    docs = documents(spark, [t for t, _ in rows])
    grades = spark.createDataFrame([(k, g) for k, (_, g) in enumerate(rows)], "doc_id long, grade int")
    once = quality.fit(docs, grades, n_grades=3)
    many = docs
    for _ in range(5):
        many = many.unionByName(docs.where("doc_id = 7"))
    assert (quality.fit(many, grades.unionByName(grades), n_grades=3).weights == once.weights).all()


def test_long_texts_are_fitted_whole(spark, monkeypatch):
    """No feature of a text of 60,000 distinct words is left out; documents beyond the bound on bytes are left out whole."""
    texts = [" ".join(f"w{k}" for k in range(n, n + 60_000)) for n in (0, 1, 2, 3)] + ["short text"] * 6
    docs = documents(spark, texts)
    grades = spark.createDataFrame([(k, k % 2) for k in range(len(texts))], "doc_id long, grade int")
    seen = []
    monkeypatch.setattr(quality, "fit_ordinal", lambda index, starts, own, n, bits: seen.append((index, starts, own)))
    quality.fit(docs, grades, n_grades=2)
    lengths = np.diff(seen[0][1])
    whole = [len(np.diff(quality.features(*raw(t), quality.BITS)[1])) and quality.features(*raw(t), quality.BITS)[1][1] for t in texts]
    assert len(lengths) == 10 and lengths.max() > 50_000 and all(n - w <= 0 and w - n < 100 for n, w in zip(lengths[:4], whole[:4]))
    quality.fit(docs, grades, n_grades=2, min_rows=1, max_bytes=500_000)
    assert 4 * len(seen[1][0]) <= 500_000 and 0 < len(seen[1][2]) < 10
    assert all(n in whole for n in np.diff(seen[1][1]).tolist())


def raw(text):
    data = np.frombuffer(text.encode(), np.uint8)
    return data, np.array([0, len(data)])


def test_equal_texts_get_equal_scores(spark):
    rows = labelled(90)
    texts = [t for t, _ in rows] * 3 + ["x " * 300_000, "", None]
    docs = documents(spark, texts).repartition(5)
    model = quality.fit(docs, spark.createDataFrame([(k, g) for k, (_, g) in enumerate(rows)], "doc_id long, grade int"), n_grades=3)
    by: dict = {}
    for r in quality.score(docs, model, tail_grade=2).collect():
        by.setdefault(r["text"] or "", set()).add((r["score"], r["expected_grade"], r["tail"]))
    assert all(len(x) == 1 for x in by.values()) and len(by) == len({t or "" for t in texts})


def features_by_hand(text, bits):
    """The hashed features of one text, by whole numbers and loops."""
    m = (1 << 64) - 1

    def mixed(h):
        h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & m
        h = (h ^ h >> 27) * 0x94D049BB133111EB & m
        return h ^ h >> 31

    def hashed(piece):
        total, power = len(piece) * 0xD6E8FEB86659FD93, 1
        for byte in piece:
            total += power * (byte + 1)
            power = power * 0x9E3779B97F4A7C15 & m
        return mixed(total & m)

    raw = re.sub(rb"[A-Z]", lambda x: x[0].lower(), text.encode())
    pieces = re.findall(rb"[0-9a-z\x80-\xff]+|[\x21-\x2f\x3a-\x60\x7b-\x7f]+", raw)
    keys = {hashed(p) & (1 << bits) - 1 for p in pieces}
    n = len(pieces)
    again = sum(a == b for a, b in zip(pieces, pieces[1:]))
    marks = sum(not re.match(rb"[0-9a-z\x80-\xff]", p) for p in pieces)
    share = lambda part: 10 * part // n if n else 11
    levels = [share(again), share(marks), share(min(len(keys), n)), min(n, 64) // 8]
    return keys | {mixed(level + 1000 * k) & (1 << bits) - 1 for k, level in enumerate(levels, 1)}


def test_scores_by_hand(spark):
    rows = labelled(80)
    docs = documents(spark)
    texts = [t or "" for t in odd_texts()]
    model = quality.fit(documents(spark, [t for t, _ in rows]), spark.createDataFrame([(k, g) for k, (_, g) in enumerate(rows)], "doc_id long, grade int"), n_grades=3)
    for r in quality.score(docs, model, tail_grade=1, least=0.7).collect():
        keys = features_by_hand(texts[r["doc_id"]], model.bits)
        score = math.fsum(float(model.weights[k]) for k in keys)
        above = [1 / (1 + math.exp(t - score)) for t in model.thresholds]
        assert r["score"] == pytest.approx(score, abs=1e-9) and r["expected_grade"] == pytest.approx(sum(above), abs=1e-9)
        assert r["tail"] == pytest.approx(above[0], abs=1e-9) and r["keep"] == (r["tail"] >= 0.7)


def test_gradients():
    r = np.random.default_rng(3)
    index, starts = r.integers(0, 16, 60).astype(np.int32), np.arange(0, 61, 3)
    grades = r.integers(0, 3, 20)
    model = quality.fit_ordinal(index, starts, grades, 3, bits=4, steps=8000, batch=20, sparse=0)

    def loss(weights, thresholds):
        score = np.add.reduceat(weights[index], starts[:-1])
        at = np.concatenate([[-np.inf], thresholds, [np.inf]])
        return -np.log(quality._sigmoid(at[grades + 1] - score) - quality._sigmoid(at[grades] - score)).mean()

    best = loss(model.weights.astype(float), model.thresholds)
    for k in range(16):
        for step in (-0.3, 0.3):
            moved = model.weights.astype(float)
            moved[k] += step
            assert loss(moved, model.thresholds) >= best - 3e-3
    for step in (-0.2, 0.2):
        assert loss(model.weights.astype(float), model.thresholds + [step, 0]) >= best - 3e-3


def test_odd_tables(spark):
    docs = documents(spark)
    nothing = spark.createDataFrame([], "doc_id long, grade int")
    rated = quality.score(docs, quality.fit(docs, nothing, 3), tail_grade=2)
    assert rated.count() == docs.count() and all(r["keep"] for r in rated.collect())
    assert rated.columns.count("score") == 1  # an input column of that name is replaced
    one = quality.fit(docs, spark.createDataFrame([(7, 0), (8, 0)], "doc_id long, grade int"), 3)
    assert not any(r["keep"] for r in quality.score(docs, one, tail_grade=1).collect())
    assert quality.score(empty(spark), one, tail_grade=1).count() == 0
