import os
import random
from fractions import Fraction
from math import floor

import numpy as np
import pytest

from ochre.llm import queries, whitening
from ochre.llm.common import clear_scratch

NAN, INF = float("nan"), float("inf")


def frame(spark, rows, kind="double"):
    return spark.createDataFrame([(k, v, 7, 8) for k, v in enumerate(rows)], f"vec_id long, v array<{kind}>, n int, whitened int")


def exact(rows, scale, offset):
    """Whole numbers, their sums, and the covariance as fractions."""
    xs = [[floor(Fraction(c) * scale) + offset for c in row] for row in rows]
    n, d = len(xs), len(xs[0])
    sums = [sum(x[i] for x in xs) for i in range(d)]
    cov = [[Fraction(sum((n * x[i] - sums[i]) * (n * x[j] - sums[j]) for x in xs), n**3) for j in range(d)] for i in range(d)]
    return xs, sums, cov


def same_up_to_sign(a, b):
    return np.allclose(a, b, rtol=1e-7, atol=1e-9) or np.allclose(a, -b, rtol=1e-7, atol=1e-9)


def check(spark, rows, scale, offset, shift=None, k=3, dropped=(), rtol=1e-9):
    model = whitening.fit(frame(spark, [*rows, *dropped]).repartition(3), "v", scale, offset, shift)
    xs, sums, cov = exact(rows, int(scale), offset)
    n = len(rows)
    assert (model.n, list(model.sums)) == (n, sums)
    values = np.linalg.eigvalsh(np.array([[float(c) for c in row] for row in cov]))[::-1]
    assert np.allclose(model.eigenvalues[:k], values[: len(model.eigenvalues[:k])], rtol=rtol)
    found = {r["vec_id"]: r for r in whitening.whiten(frame(spark, [*rows, *dropped]), model, "v", components=k).collect()}
    assert sorted(found) == list(range(n))
    centred = np.array([[float(Fraction(n * v - s, n)) for v, s in zip(x, sums)] for x in xs])
    white = np.array([found[i]["whitened"] for i in range(n)])
    for c in range(len(model.eigenvalues[:k])):
        assert same_up_to_sign(white[:, c], centred @ model.vectors[:, c] / np.sqrt(values[c]))
    for i, x in enumerate(xs):
        told = sum((n * v - s) ** 2 for v, s in zip(x, sums))
        assert found[i]["deviation"] == (told if told < 10**38 else None) and found[i]["n"] == n
    error = whitening.identity_error(whitening.whiten(frame(spark, rows), model, "v", components=k), len(model.eigenvalues[:k]))
    assert error < 1e-9
    return model


def vectors(n, d, seed=1, spread=1.0):
    r = np.random.default_rng(seed)
    return (r.normal(size=(n, d)) * np.linspace(1, 3, d) * spread).tolist()


def test_against_fractions(spark):
    odd = [None, [1.0, None, 2.0, 3.0], [1.0, NAN, 2.0, 3.0], [1.0, INF, 2.0, 3.0], [], [1.0], [1e300, 0.0, 0.0, 0.0]]
    model = check(spark, vectors(200, 4), 1024.0, 100_000, dropped=odd)
    assert abs(sum(whitening.Whitening.explained.fget(model)) - 1) < 1e-12


def test_large_numbers_and_shifts(spark):
    """Numbers of several limbs, with sums far beyond 64 bits; a shift changes nothing."""
    rows = [[float(x * 2**40 + 2**55), float(y * 2**35), float(x + 3 * y)] for x, y in vectors(90, 2, 5, 1000.0)]
    a = check(spark, rows, 1.0, 0, rtol=1e-6)
    b = whitening.fit(frame(spark, rows), "v", 1.0, 0, shift=12345)
    c = whitening.fit(frame(spark, rows).repartition(5), "v", 1.0, 0, shift=-(1 << 50))
    assert a.sums == b.sums == c.sums and a.trace == b.trace == c.trace and (a.eigenvalues == c.eigenvalues).all()


def test_scatter_blocks(monkeypatch):
    monkeypatch.setattr(whitening, "ROWS", 4)
    monkeypatch.setattr(whitening, "BLOCKS", 2)
    r = random.Random(2)
    rows = [[r.choice([0, 1, -1, 1 << 20, -(1 << 20), (1 << 41) + 5, -(1 << 61), (1 << 61) - 1]) for _ in range(3)] for _ in range(50)]
    total = whitening.Scatter(3)
    total.add(np.array(rows[:31], np.int64))
    total.add(np.array(rows[31:], np.int64))
    cells = {}
    for i, j, power, value in total.cells():
        assert (abs(value) <= 1 << 41).all()
        for a, b, v in zip(i.tolist(), j.tolist(), value.tolist()):
            cells[a, b] = cells.get((a, b), 0) + (v << whitening.LIMB * power)
    for a in range(3):
        for b in range(a, 4):
            assert cells.get((a, b), 0) == sum(x[a] * (1 if b == 3 else x[b]) for x in rows)


def test_few_directions(spark):
    """Directions without spread are no components."""
    rows = [[float(round(x * 1000)), 2.0 * round(x * 1000), 5.0, -1.0] for (x,) in vectors(30, 1)]
    assert len(check(spark, rows, 1.0, 3, k=4).eigenvalues) == 1
    for same in ([[1.0, 2.0]] * 5, [[1.0, 2.0]], [None, None], []):
        model = whitening.fit(frame(spark, same), "v", 1024.0, 5)
        rows = whitening.whiten(frame(spark, same), model, "v").collect()
        assert len(model.eigenvalues) == 0 and [r["whitened"] for r in rows] == [[]] * sum(x is not None for x in same)


def test_repeated_rows_and_types(spark):
    rows = [[0.5, 1.25], [0.5, 1.25], [-3.0, 2.0], [4.5, -1.0]]
    check(spark, rows, 1024.0, 0, k=2)
    a = whitening.fit(frame(spark, rows, "float"), "v", 1024.0, 0)
    assert a.sums == whitening.fit(frame(spark, rows), "v", 1024.0, 0).sums
    null_id = spark.createDataFrame([(None, [1.0, 2.0]), (2, [3.0, 1.0])], "vec_id long, v array<double>")
    assert {r["vec_id"] for r in whitening.whiten(null_id, whitening.fit(null_id, "v"), "v").collect()} == {None, 2}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()}
    ids = sorted(rows)
    xs, sums, cov = exact([rows[i] for i in ids], 1024, 100_000)
    n = len(ids)
    v = np.array([[float(c) for c in row] for row in cov])
    values, vectors_ = np.linalg.eigh(v)
    values, vectors_ = values[::-1], vectors_[:, ::-1]
    found = {}
    for r in queries.op12_whitening(spark, folder).collect():
        found[r["vec_id"], r["component"]] = r
    assert len(found) == 8 * n
    for c in range(8):
        own = np.array([found[i, c + 1]["whitened"] for i in ids])
        centred = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(x, sums)] for x in xs])
        assert same_up_to_sign(own, centred @ vectors_[:, c] / np.sqrt(values[c]))
        r = found[ids[0], c + 1]
        assert abs(r["explained"] / (values[c] / np.trace(v)) - 1) < 1e-9 and 0 <= r["identity_error"] < 1e-9
    for i, x in zip(ids, xs):
        assert found[i, 1]["deviation"] == sum((n * a - s) ** 2 for a, s in zip(x, sums)) and found[i, 3]["n"] == n
    clear_scratch(spark)
