"""Hard negatives by a Voronoi-partitioned nearest-neighbour join.

Vectors become whole numbers, and a score is an inner product.  A candidate c gets one
more coordinate, the root of M - |c|**2 with M the greatest squared length, an anchor q
gets 0 there; then |q - c|**2 = |q|**2 + M - 2 * score, so the best scores are the
nearest neighbours.  Pivots (a bounded number, by hash) part the space: each anchor and
each candidate belongs to the pivot nearest to it.

Anchors of a pivot form units of at most some ``UNIT`` anchors.  A join has two rounds.
The first joins each unit with the candidates of its own pivot, which gives every
anchor a score that it can reach.  From these comes a bound for each unit; in the second
round a candidate of another pivot goes to those units only for which its distance from
the unit's pivot, its side of the plane between both pivots and the unit's radius leave it a
chance (triangle inequality).  Units meet their candidates in portions of some
``PORTION``, so neither a vector that a third of the rows share nor a frequent label ends
in one task; each portion is joined exactly, block by block, and lists of a few
rows an anchor are merged.  Positives are one such join among equal labels; negatives
another one among different labels, within a window of scores for each positive.

Defined results: rows with a null id or label, a null vector, null or non-finite
entries or none, another length than most vectors have, or a squared length of 2**62 and more
take no part; ties go to the smaller id; rows that share an id count once in a list,
with their best score there, and never for an anchor of that id; of several rows
of one anchor id, that with the smallest label and vector is the anchor; an anchor without
positives, or with none above 0, gives no rows; an empty table gives an empty one; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from ..shipping import ensure_shipped
from .common import map_arrow, temporary, written
from .vectors import dimension, floored, usable

#: Anchors joined at once, candidates joined with them at once, and scores held at once.
UNIT, PORTION, SCORES = 8192, 1 << 16, 1 << 21
FEWEST_PIVOTS, MOST_PIVOTS = 8, 1024
#: Groups of labels for which the first join keeps bounds of their own.
BUCKETS = 64
#: Rows that a task hands on at once, and squared lengths that take part.
SENT_ROWS, LONGEST = 1 << 14, float(1 << 62)
NO_ID = (1 << 63) - 1


@dataclass(frozen=True)
class Space:
    """What distances are measured by."""

    d: int
    kind: str
    longest: int
    #: Pivots as rows, and their further coordinates.
    pivots: np.ndarray
    heights: np.ndarray

    @property
    def exact(self) -> type:
        """Sums of products are exact in doubles below 2**53, else in 64-bit whole numbers."""
        return np.float64 if self.longest < 1 << 53 else np.int64

    @property
    def slack(self) -> float:
        return 1e-9 * math.sqrt(self.longest) + 1e-9

    def rows(self, column: pa.Array) -> np.ndarray:
        """Stored vectors as a matrix."""
        if not len(column):
            return np.zeros((0, self.d))
        return np.frombuffer(b"".join(column.to_pylist()), self.kind).reshape(len(column), self.d).astype(np.float64)

    def distances(self, rows: np.ndarray, candidates: bool) -> np.ndarray:
        """From each row to each pivot."""
        square = (rows * rows).sum(axis=1)
        product = rows @ self.pivots.T
        if candidates:
            product += np.sqrt(np.maximum(self.longest - square, 0))[:, None] * self.heights
            square = np.full(len(rows), float(self.longest))
        return np.sqrt(np.maximum(square[:, None] + self.longest - 2 * product, 0))

    def between(self) -> np.ndarray:
        """Distances between pivots."""
        product = self.pivots @ self.pivots.T + np.outer(self.heights, self.heights)
        return np.sqrt(np.maximum(2 * self.longest - 2 * product, 0))


@dataclass(frozen=True)
class Units:
    """The units of anchors: their pivots, and how far the nearest and the farthest anchor lie from these."""

    pivot: np.ndarray
    near: np.ndarray
    far: np.ndarray


def cleaned(df: DataFrame, id_: str, label: str, vector: str, anchors: Column, scale: float) -> tuple[DataFrame, int, str]:
    """``id, label, bucket, anchor, square, vec`` of the rows that take part; the vectors' length and how entries are stored."""
    d = dimension(df, vector)
    single = isinstance(df.schema[vector].dataType, ArrayType) and isinstance(df.schema[vector].dataType.elementType, FloatType)
    kind = "<f4" if single and math.frexp(scale)[0] == 0.5 else "<f8"  # whole parts of floats are floats
    rows = df.where(F.col(id_).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull())
    rows = rows.select(F.col(id_).cast("long").alias("id"), F.col(label).alias("label"), F.pmod(F.xxhash64(label), F.lit(BUCKETS)).cast("int").alias("bucket"), F.coalesce(anchors, F.lit(False)).alias("anchor"), F.col(vector).alias("vector"))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            place, values = usable(batch.column("vector"), d)
            fits, whole = floored(values, scale, LONGEST)
            short = (whole * whole).sum(axis=1) < LONGEST
            place, whole = place[fits][short], whole[short]
            square = (whole.astype(np.int64) ** 2).sum(axis=1)
            raw = pa.Array.from_buffers(pa.binary(), len(place), [None, pa.py_buffer((np.arange(len(place) + 1) * (d * int(kind[2]))).astype(np.int32).tobytes()), pa.py_buffer(whole.astype(kind).tobytes())])
            own = batch.select(["id", "label", "bucket", "anchor"]).take(pa.array(place))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(square, pa.int64()), raw], names=["id", "label", "bucket", "anchor", "square", "vec"])

    return map_arrow(rows, clean, f"id long, label {rows.schema['label'].dataType.simpleString()}, bucket int, anchor boolean, square long, vec binary"), d, kind


def _assigned(rows: DataFrame, space: Space, candidates: bool) -> DataFrame:
    """``rows`` with the nearest pivot and the distance from it."""
    names = rows.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", cell int, distance double"

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                away = space.distances(space.rows(batch.column("vec")), candidates)
                cell = away.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(away[np.arange(len(cell)), cell], pa.float64())], names=[*names, "cell", "distance"])

    return map_arrow(rows, assign, schema)


def _reachable(space: Space, units: Units, batch: pa.RecordBatch, between: np.ndarray, bound: np.ndarray, beyond: np.ndarray | None) -> np.ndarray:
    """Which candidates of a batch may serve which units of other pivots (candidates x units).

    ``bound``: the greatest distance of use to a unit, by label group or one for all;
    ``beyond``: the least one.
    """
    away = space.distances(space.rows(batch.column("vec")), True)
    cell = batch.column("cell").to_numpy()
    own = away[np.arange(len(cell)), cell]
    here = away[:, units.pivot]
    least = np.maximum(here - units.far, units.near - here)
    apart = between[cell][:, units.pivot]
    with np.errstate(divide="ignore", invalid="ignore"):
        plane = (here**2 - own[:, None] ** 2) / (2 * apart)
    least = np.maximum(least, np.where(apart > 0, plane, 0))
    most = bound[:, batch.column("bucket").to_numpy()].T if bound.shape[1] > 1 else bound.T
    serves = (least <= most + space.slack) & (units.pivot != cell[:, None])
    if beyond is not None:
        serves &= here + units.far + space.slack >= beyond
    return serves


def _sent(rows: DataFrame, space: Space, units: Units, bound: np.ndarray, beyond: np.ndarray | None, portions: np.ndarray | None) -> DataFrame:
    """Candidates with each unit of another pivot that they may serve; with ``portions`` None, only the number for each unit."""
    between = space.between()
    label = rows.schema["label"].dataType.simpleString()

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(units.pivot), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            row, unit = np.nonzero(_reachable(space, units, batch, between, bound, beyond))
            if portions is None:
                counts += np.bincount(unit, minlength=len(counts))
                continue
            part = batch.column("salt").to_numpy()[row] % portions[unit]
            own = batch.select(["id", "label", "vec"])
            for k in range(0, len(row), SENT_ROWS):
                cut = slice(k, k + SENT_ROWS)
                yield pa.RecordBatch.from_arrays([pa.array(unit[cut], pa.int32()), pa.array(part[cut], pa.int32()), *own.take(pa.array(row[cut])).columns], names=["unit", "part", "id", "label", "vec"])
        if portions is None:
            full = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(counts[full], pa.int64())], names=["unit", "n"])

    chosen = rows.select("id", "label", "bucket", "vec", "cell", F.shiftrightunsigned(F.xxhash64("id"), 1).alias("salt"))
    return map_arrow(chosen, send, "unit int, n long" if portions is None else f"unit int, part int, id long, label {label}, vec binary")


def best_in_windows(ids: np.ndarray, codes: np.ndarray, rows: np.ndarray, low: np.ndarray, high: np.ndarray, other_ids: np.ndarray, other_codes: np.ndarray, others: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best candidates of each anchor in each of its windows of scores: anchor's place, window, candidate's id, score.

    ``low`` and ``high`` have a row an anchor and a column a window (an empty one has
    low > high).  Only candidates with an equal, or else with another, code count.
    """
    n, windows = low.shape
    whole = rows.dtype == np.int64
    least, most = (-(1 << 62) - 1, 1 << 62) if whole else (-np.inf, np.inf)  # beyond all scores
    score = np.full((n, windows, k), least, rows.dtype)
    found = np.full((n, windows, k), NO_ID, np.int64)
    low, high = low.astype(rows.dtype), high.astype(rows.dtype)
    step = max(1, SCORES // max(n, 1))
    for begin in range(0, len(others), step):
        block, block_ids, block_codes = others[begin : begin + step], other_ids[begin : begin + step], other_codes[begin : begin + step]
        product = rows @ block.T
        needed = np.maximum(low, score[:, :, -1])
        floor = np.where(low <= high, needed, most).min(axis=1)
        at, which = np.nonzero(product >= floor[:, None])
        ok = ((codes[at] == block_codes[which]) == same) & (ids[at] != block_ids[which])
        at, which = at[ok], which[ok]
        value, who = product[at, which], block_ids[which]
        for w in range(windows):
            mine = (value >= needed[at, w]) & (value <= high[at, w])
            if not mine.any():
                continue
            a, v, c = at[mine], value[mine], who[mine]
            touched = np.unique(a)
            old = np.repeat(touched, k)
            a, v, c = np.concatenate([old, a]), np.concatenate([score[touched, w].ravel(), v]), np.concatenate([found[touched, w].ravel(), c])
            order = np.lexsort((-v, c, a))  # the best of each id
            a, v, c = a[order], v[order], c[order]
            first = (c == NO_ID) | np.concatenate([[True], (a[1:] != a[:-1]) | (c[1:] != c[:-1])])
            a, v, c = a[first], v[first], c[first]
            order = np.lexsort((c, -v, a))
            a, v, c = a[order], v[order], c[order]
            rank = np.arange(len(a)) - np.searchsorted(a, a)
            keep = rank < k
            score[a[keep], w, rank[keep]], found[a[keep], w, rank[keep]] = v[keep], c[keep]
    at, w, rank = np.nonzero(found != NO_ID)
    return at, w, found[at, w, rank], score[at, w, rank]


def _joined(anchors: DataFrame, candidates: DataFrame, space: Space, k: int, same: bool) -> DataFrame:
    """``anchor, window, id, score``: the best of each portion.  ``anchors``: ``unit, part, id, label, vec, low, high``."""
    ensure_shipped(anchors.sparkSession)

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.combine_chunks(), right.combine_chunks()
        labels = pa.chunked_array([*left.column("label").chunks, *right.column("label").chunks], left.schema.field("label").type)
        codes = labels.combine_chunks().dictionary_encode().indices.to_numpy() if len(labels) else np.zeros(0, np.int64)
        rows, others = (space.rows(t.column("vec")).astype(space.exact) for t in (left, right))
        if left.num_rows and right.num_rows:
            window = lambda c: np.array(left.column(c).to_pylist(), np.int64).reshape(left.num_rows, -1)
            found = best_in_windows(left.column("id").to_numpy(), codes[: len(rows)], rows, window("low"), window("high"), right.column("id").to_numpy(), codes[len(rows) :], others, k, same)
        else:
            found = (np.zeros(0, np.int64),) * 4
        at, w, ids, score = found
        own = left.column("id").to_numpy()[at] if len(at) else np.zeros(0, np.int64)
        return pa.table({"anchor": pa.array(own, pa.int64()), "window": pa.array(w, pa.int32()), "id": pa.array(ids, pa.int64()), "score": pa.array(np.asarray(score).astype(np.int64), pa.int64())})

    return anchors.groupBy("unit", "part").cogroup(candidates.groupBy("unit", "part")).applyInArrow(join, "anchor long, window int, id long, score long")


def _lists(parts: DataFrame, k: int) -> DataFrame:
    """``anchor, window, best``: the ``k`` best of all portions as an array of ``score, id``."""
    one = parts.repartition("anchor").groupBy("anchor", "window", "id").agg(F.max("score").alias("score"))
    sorted_ = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "id")))
    lists = one.groupBy("anchor", "window").agg(F.slice(sorted_, 1, k).alias("best"))
    return lists.select("anchor", "window", F.transform("best", lambda x: F.struct((-x["minus"]).alias("score"), x["id"].alias("id"))).alias("best"))


def _portioned(anchors: DataFrame, portions: np.ndarray) -> DataFrame:
    """``anchors`` once for each portion of candidates of their unit."""
    spark = anchors.sparkSession
    sizes = spark.createDataFrame([(k, int(v)) for k, v in enumerate(portions)], "unit int, _portions int")
    wide = anchors.join(F.broadcast(sizes), "unit")  # a number a unit
    return wide.select("*", F.explode(F.sequence(F.lit(0), F.col("_portions") - 1)).alias("part")).select("unit", "part", "id", "label", "vec", "low", "high")


class Join:
    """Anchors in units, and the candidates to join them with."""

    def __init__(self, rows: DataFrame, anchors: DataFrame, space: Space):
        spark = rows.sparkSession
        self.space, self.rows = space, rows
        sizes = {r["cell"]: r["n"] for r in anchors.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a pivot
        pivots, base = [], []
        for cell in range(len(space.pivots)):
            base.append(len(pivots))
            pivots += [cell] * (-(-sizes.get(cell, 0) // UNIT))
        table = spark.createDataFrame([(c, base[c], -(-n // UNIT)) for c, n in sizes.items()], "cell int, _base int, _units int")
        unit = (F.col("_base") + F.pmod(F.xxhash64("id", F.lit(1)), F.col("_units"))).cast("int")
        self.anchors = written(anchors.join(F.broadcast(table), "cell").select("id", "label", "bucket", "vec", "square", "cell", "distance", unit.alias("unit")), "anchors")
        near, far = np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf)
        for r in self.anchors.groupBy("unit").agg(F.min("distance").alias("near"), F.max("distance").alias("far")).collect():  # a row a unit
            near[r["unit"]], far[r["unit"]] = r["near"], r["far"]
        self.units = Units(np.array(pivots, np.int64), near, far)
        self.cells = {r["cell"]: r["n"] for r in rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}

    def first(self, windows: DataFrame, k: int, same: bool) -> DataFrame:
        """Anchors with the candidates of their own pivots.  ``windows``: ``id, low, high`` of anchors."""
        spark = self.rows.sparkSession
        portions = np.array([-(-max(1, self.cells.get(int(p), 0)) // PORTION) for p in self.units.pivot], np.int64)
        table = spark.createDataFrame([(int(p), k, int(portions[k])) for k, p in enumerate(self.units.pivot)], "cell int, unit int, _portions int")
        own = self.rows.join(F.broadcast(table), "cell")
        own = own.select("unit", F.pmod(F.shiftrightunsigned(F.xxhash64("id"), 1), F.col("_portions")).cast("int").alias("part"), "id", "label", "vec")
        return _joined(_portioned(self.anchors.join(windows, "id"), portions), own, self.space, k, same)

    def second(self, windows: DataFrame, k: int, same: bool, reach: DataFrame) -> DataFrame:
        """Anchors with candidates of other pivots.  ``reach``: by anchor ``id``, the least and the greatest score of use (null: all)."""
        away = lambda c: F.sqrt(F.greatest(F.col("square") + F.lit(float(self.space.longest)) - 2.0 * F.col(c), F.lit(0.0)))
        groups = BUCKETS if same else 1
        bound = np.full((len(self.units.pivot), groups), -np.inf)
        beyond = None if same else np.full(len(self.units.pivot), np.inf)
        bounds = self.anchors.join(reach, "id").groupBy("unit", (F.col("bucket") if same else F.lit(0)).alias("b"))
        for r in bounds.agg(F.max(F.when(F.col("least").isNull(), F.lit(math.inf)).otherwise(away("least"))).alias("most"), F.min(F.when(F.col("greatest").isNull(), F.lit(0.0)).otherwise(away("greatest"))).alias("near")).collect():  # a row a unit and label group
            bound[r["unit"], r["b"]] = r["most"]
            if beyond is not None:
                beyond[r["unit"]] = r["near"]
        served = np.zeros(len(self.units.pivot), np.int64)
        for r in _sent(self.rows, self.space, self.units, bound, beyond, None).groupBy("unit").agg(F.sum("n").alias("n")).collect():
            served[r["unit"]] = r["n"]
        portions = np.maximum(1, -(-served // PORTION))
        sent = _sent(self.rows, self.space, self.units, bound, beyond, portions)
        return _joined(_portioned(self.anchors.join(windows, "id"), portions), sent, self.space, k, same)


def mine(df: DataFrame, anchors: Column, id_: str, label: str, vector: str, scale: float = 256.0, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    For each row where ``anchors`` holds: its ``positives`` best other rows of its label,
    and for each of these the first ``negatives`` of the rows of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score.
    """
    spark = df.sparkSession
    rows, d, kind = cleaned(df, id_, label, vector, anchors, scale)
    told = rows.agg(F.max("square").alias("longest"), F.count(F.when(F.col("anchor"), 1)).alias("anchors")).first()
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not told["anchors"] or not d:
        return spark.createDataFrame([], result)
    wanted = min(MOST_PIVOTS, max(FEWEST_PIVOTS, -(-told["anchors"] // UNIT)))
    chosen = rows.select("vec", F.xxhash64("id").alias("h"), "id").orderBy("h", "id").limit(wanted).collect()
    pivots = np.unique(np.array([np.frombuffer(r["vec"], kind).astype(np.float64) for r in chosen]).reshape(len(chosen), d), axis=0)
    space = Space(d, kind, told["longest"], pivots, np.sqrt(np.maximum(told["longest"] - (pivots * pivots).sum(axis=1), 0)))
    with temporary(spark) as keep:
        all_ = written(_assigned(rows, space, True), "vectors")
        # one row an anchor id
        one = all_.where("anchor").groupBy("id").agg(F.min(F.struct("label", "vec", "bucket", "square")).alias("r")).select("id", "r.*")
        join = Join(all_, _assigned(one, space, False), space)
        whole = join.anchors.select("id", F.array(F.lit(-(1 << 62))).alias("low"), F.array(F.lit(1 << 62)).alias("high"))
        begun = written(_lists(join.first(whole, positives, True), positives), "positives-first").withColumnRenamed("anchor", "id")
        kth = F.when(F.size("best") == positives, F.element_at("best", -1)["score"])
        reach = join.anchors.select("id").join(begun.select("id", kth.alias("least")), "id", "left").select("id", "least", F.lit(None).cast("long").alias("greatest"))
        more = join.second(whole, positives, True, reach)
        spelled = begun.select(F.col("id").alias("anchor"), "window", F.explode("best").alias("b")).select("anchor", "window", "b.id", "b.score")
        pos = written(_lists(spelled.unionByName(more), positives), "positives").select(F.col("anchor").alias("id"), F.col("best").alias("positives"))

        least = F.transform("positives", lambda p: F.ceil(p["score"].cast("decimal(20,0)") * low / 100).cast("long"))
        most = F.transform("positives", lambda p: F.floor(p["score"].cast("decimal(20,0)") * high / 100).cast("long"))
        fill = F.greatest(F.lit(0), F.lit(positives) - F.size("positives"))
        windows = written(pos.select("id", F.concat(least, F.array_repeat(F.lit(1).cast("long"), fill)).alias("low"), F.concat(most, F.array_repeat(F.lit(0).cast("long"), fill)).alias("high"), "positives"), "windows")
        bounds = windows.select("id", "low", "high")
        first = written(_lists(join.first(bounds, negatives, False), negatives), "negatives-first")
        reached = first.select(F.col("anchor").alias("id"), "window", F.when(F.size("best") == negatives, F.element_at("best", -1)["score"]).alias("kth"))
        open_ = windows.select("id", F.posexplode(F.arrays_zip("low", "high")).alias("window", "w")).where("w.low <= w.high").join(reached, ["id", "window"], "left")
        reach = open_.groupBy("id").agg(F.min(F.greatest("w.low", "kth")).alias("least"), F.max("w.high").alias("greatest"))
        more = join.second(bounds.join(reach.select("id"), "id", "left_semi"), negatives, False, reach)
        spelled = first.select("anchor", "window", F.explode("best").alias("b")).select("anchor", "window", "b.id", "b.score")
        found = _lists(spelled.unionByName(more), negatives).withColumnRenamed("anchor", "id").join(windows.select("id", "positives"), "id")
        positive = F.get("positives", F.col("window"))
        flat = found.select("id", positive.alias("p"), F.posexplode("best").alias("k", "n"))
        columns = {"anchor_id": F.col("id"), "positive_id": F.col("p.id"), "rank": (F.col("k") + 1).cast("int"), "negative_id": F.col("n.id"), "positive_score": F.col("p.score"), "negative_score": F.col("n.score")}
        return keep(written(flat.select(*[c.alias(name) for name, c in columns.items()]), "hard-negatives"))


#: The same by brute force, for the query's table and numbers.
MINE_SQL = """
WITH v AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT a.id AS anchor, a.label AS own, b.id AS id, b.label AS label, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
  FROM v a, v b WHERE a.id % 50 = 0 AND a.id <> b.id
), positives AS (
  SELECT anchor, id, score FROM scores WHERE own = label
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5
)
SELECT p.anchor AS anchor_id, p.id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor, p.id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank,
       s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM positives p JOIN scores s ON s.anchor = p.anchor AND s.own <> s.label AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor, p.id ORDER BY s.score DESC, s.id) <= 3
"""
