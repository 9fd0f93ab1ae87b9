import os
from math import floor

import numpy as np
import pytest
from pyspark.sql import functions as F

from ochre.llm import hard_negatives as hn
from ochre.llm import queries
from ochre.llm.common import clear_scratch

NAN = float("nan")
KIND = "vec_id long, label int, v array<float>, score int, unit int, anchor string"


def frame(spark, rows, kind=KIND):
    return spark.createDataFrame([(*r, 1, 2, "x") for r in rows], kind).repartition(3)


def brute(rows, anchor=lambda i: i % 5 == 0, positives=5, negatives=3, scale=256, low=50, high=95, d=None):
    """Ids are distinct here."""
    d = d or max((len(v) for _, _, v in rows if v), default=0)
    ok = [(i, label, [floor(np.float64(x) * scale) for x in v]) for i, label, v in rows if i is not None and label is not None and v is not None and len(v) == d and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for i, label, v in ok:
        if not anchor(i):
            continue
        scored = sorted(((-sum(a * b for a, b in zip(v, w)), j, m) for j, m, w in ok if j != i))
        for minus, j, _ in [x for x in scored if x[2] == label][:positives]:
            window = [x for x in scored if x[2] != label and low * -minus <= 100 * -x[0] <= high * -minus]
            out |= {(i, j, k + 1, x[1], -minus, -x[0]) for k, x in enumerate(window[:negatives])}
    return out


def mined(df, every=5, **more):
    rows = hn.mine(df, F.col("vec_id") % every == 0, "vec_id", "label", "v", **more).collect()
    found = {(r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in rows}
    assert len(found) == len(rows)
    return found


def clustered(n, d=6, seed=1, clusters=6, noise=0.15):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(clusters, d)) * 2
    return [(k, int(r.integers(0, 4)), (centres[k % clusters] + r.normal(size=d) * noise).astype(np.float32).tolist()) for k in range(n)]


def random_rows(n, d=5, seed=2, labels=3):
    r = np.random.default_rng(seed)
    return [(k, int(r.integers(0, labels)), r.normal(size=d).astype(np.float32).tolist()) for k in range(n)]


@pytest.mark.parametrize("rows", [clustered(150), random_rows(120), random_rows(60, 2, 3, 30)], ids=["clustered", "random", "rare labels"])
def test_against_brute_force(spark, rows):
    assert mined(frame(spark, rows)) == brute(rows)


def test_small_units_and_portions(spark, monkeypatch):
    """Anchors in many units, candidates in many portions and blocks; a third of the rows share one vector."""
    for name, value in (("UNIT", 4), ("PORTION", 10), ("SCORES", 32), ("SENT_ROWS", 7)):
        monkeypatch.setattr(hn, name, value)
    rows = clustered(120, seed=4)
    rows = [(i, label, rows[0][2]) if i % 3 == 0 else (i, label, v) for i, label, v in rows]
    assert mined(frame(spark, rows)) == brute(rows)


def test_odd_rows(spark):
    rows = random_rows(40, 3)
    odd = [(None, 1, [1.0, 2.0, 3.0]), (100, None, [9.0, 9.0, 9.0]), (105, 1, None), (110, 1, [1.0, None, 2.0]), (115, 1, [1.0, NAN, 2.0]), (120, 1, [float("inf"), 0.0, 0.0]), (125, 1, [9.0]), (130, 1, []), (135, 1, [3e38, 0.0, 0.0])]
    assert mined(frame(spark, rows + odd)) == brute(rows)
    assert mined(frame(spark, []).limit(0)) == set()
    assert mined(frame(spark, [(5, 1, [1.0, 2.0])])) == set()
    assert mined(frame(spark, [(5, 1, []), (6, 1, [])])) == set()
    assert mined(frame(spark, [r for r in rows if r[0] % 5])) == set()  # no anchors
    assert mined(frame(spark, [(i, 1, v) for i, _, v in rows])) == set()  # one label
    assert mined(frame(spark, [(i, i, v) for i, _, v in rows])) == set()  # no positives


def test_ties_and_repeats(spark):
    rows = [(k, k % 2, [1.0, 1.0] if k % 3 else [0.75, 0.75]) for k in range(30)]
    assert mined(frame(spark, rows)) == brute(rows)
    assert mined(frame(spark, rows + rows)) == brute(rows)
    # an id with two vectors counts once, with its best score in the window
    more = [(7, 1, [0.5, 0.5]), (7, 1, [0.9, 0.9])]
    assert len(mined(frame(spark, rows + more))) == len(brute(rows))


def test_large_numbers(spark):
    """Scores beyond what doubles hold are exact."""
    r = np.random.default_rng(8)
    rows = [(k, k % 3, [float(x) for x in r.integers(-(2**29), 2**29, 3)]) for k in range(40)]
    kind = KIND.replace("float", "double")
    assert mined(frame(spark, rows, kind), scale=1.0) == brute(rows, scale=1)


def test_labels_of_other_types(spark):
    rows = random_rows(40, 3)
    named = spark.createDataFrame([(i, f"label {m}", v) for i, m, v in rows], "vec_id long, label string, v array<float>")
    assert mined(named) == brute(rows)


def test_other_numbers(spark):
    rows = clustered(80, seed=6)
    assert mined(frame(spark, rows), positives=2, negatives=4, low=10, high=99) == brute(rows, positives=2, negatives=4, low=10, high=99)


def test_bounds_leave_candidates_out(spark, monkeypatch):
    """On clustered vectors, most candidates are sent to few units."""
    rows = frame(spark, clustered(600, seed=9, clusters=8, noise=0.02))
    sent = []
    whole = hn._sent

    def counted(*args):
        out = whole(*args)
        if args[-1] is not None:
            sent.append(out.count())
        return out

    monkeypatch.setattr(hn, "_sent", counted)
    assert mined(rows, every=10)
    others = 600 * (hn.FEWEST_PIVOTS - 1)
    assert sent[0] < others / 2 and sent[1] < others


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_query(spark):
    import duckdb

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    told = con.execute(queries.ORACLE_SQL["op13_hard_negatives"])
    names = [c[0] for c in told.description]
    found = queries.op13_hard_negatives(spark, folder)
    assert sorted(tuple(r[c] for c in names) for r in found.collect()) == sorted(told.fetchall())
    clear_scratch(spark)
