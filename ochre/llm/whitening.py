"""Whitening of embeddings from an exact integer scatter matrix.

Entries become whole numbers, x = floor(scale * entry) + offset.  Tasks subtract a shift
from them and sum entries and cross-products up without any rounding: numbers are cut
into limbs of 20 bits, so that products of limbs over a block of rows are exact in
double arithmetic, and the sums of limbs are kept by powers of two as 64-bit numbers,
which Spark adds up by cell of the matrix.  The driver gets one row a cell and power (its
number depends on the dimension alone), puts them together as numbers of any size,
forms n * X'X - S S', and only then divides, rounds once and decomposes.

The fit is two scans and one small shuffle; rows are whitened where they are read.

Defined results: a vector takes no part if it is null, has a null or non-finite entry,
another length than ``dimension`` (by default that which most have), or an entry for
which x is beyond 62 bits; repeated rows count each; a null id stays null; other columns
are dropped.  Directions without spread (eigenvalue within rounding of 0) are no
components, so constant vectors and tables of one row give none; an empty table gives an
empty one.  Equal eigenvalues come in the order of the decomposition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow
from .vectors import dimension, floored, usable

#: Bits of a limb, and rows of which products are summed at once: 2 * 20 + 13 bits fit a double.
LIMB, ROWS = 20, 1 << 13
#: Blocks whose sums are added in 64 bits.
BLOCKS = 256
LARGEST = float(1 << 62)


def limbs(numbers: np.ndarray) -> list[np.ndarray]:
    """Whole numbers as limbs of ``LIMB`` bits from the lowest, the highest signed, as doubles."""
    out = []
    while len(numbers) and np.abs(numbers).max() >= 1 << LIMB:
        out.append((numbers & ((1 << LIMB) - 1)).astype(np.float64))
        numbers = numbers >> LIMB
    return [*out, numbers.astype(np.float64)]


class Scatter:
    """Exact sums and cross-products of whole numbers, by powers of 2**LIMB."""

    def __init__(self, d: int):
        self.d, self.n = d, 0
        self.open: dict[int, np.ndarray] = {}
        self.closed: dict[int, np.ndarray] = {}
        self.blocks = 0

    def add(self, numbers: np.ndarray) -> None:
        """``numbers``: rows of 64-bit whole numbers."""
        for k in range(0, len(numbers), ROWS):
            block = limbs(numbers[k : k + ROWS])
            ones = np.ones((len(block[0]), 1))
            for a, left in enumerate(block):
                for b, right in enumerate(block):
                    # the column of ones gives the sums, once
                    both = left.T @ np.hstack([right, ones if b == 0 else 0 * ones])
                    power = self.open.setdefault(a + b, np.zeros((self.d, self.d + 1), np.int64))
                    power += both.astype(np.int64)
            self.n += len(ones)
            self.blocks += 1
            if self.blocks == BLOCKS:
                self._close()

    def _close(self) -> None:
        for power, cells in self.open.items():
            whole = self.closed.setdefault(power, np.zeros((self.d, self.d + 1), object))
            whole += cells.astype(object)
        self.open, self.blocks = {}, 0

    def cells(self) -> Iterator[tuple[np.ndarray, np.ndarray, int, np.ndarray]]:
        """(row, column, power, value) of the upper triangle and the sums (column d), values of at most 41 bits."""
        self._close()
        i, j = np.triu_indices(self.d, 0, self.d + 1)
        for power, cells in self.closed.items():
            rest = cells[i, j]
            while rest.any():
                low = rest % (1 << 2 * LIMB)
                keep = low != 0
                yield i[keep], j[keep], power, low[keep].astype(np.int64)
                rest = (rest - low) >> 2 * LIMB
                power += 2
                if all(-(1 << 40) < v < 1 << 40 for v in rest.tolist()):  # signed, as the last digit may be
                    keep = rest != 0
                    if keep.any():
                        yield i[keep], j[keep], power, rest[keep].astype(np.int64)
                    break


@dataclass(frozen=True)
class Whitening:
    n: int
    dimension: int
    scale: float
    offset: int
    #: Sums of x by dimension.
    sums: tuple[int, ...]
    #: Falling eigenvalues of those components that have spread, and unit vectors as columns.
    eigenvalues: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def explained(self) -> list[float]:
        return [float(e / self.trace) for e in self.eigenvalues]


def _whole(batch: pa.RecordBatch, d: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors that take part, and floor(scale * entry) as 64-bit numbers."""
    place, rows = usable(batch.column(batch.schema.names.index("vector")), d)
    fits, whole = floored(rows, scale, LARGEST)
    return place[fits], whole.astype(np.int64)


def fit(df: DataFrame, vector: str, scale: float = 1024.0, offset: int = 0, shift: int | None = None, dimension_: int | None = None) -> Whitening:
    """Means and principal directions of all vectors.  ``shift`` (by default ``offset``) only keeps numbers small; it must be within 62 bits of all x."""
    d = dimension_ or dimension(df, vector)
    less = offset - (offset if shift is None else shift)  # what is added to floor(scale * entry)

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Scatter(d)
        for batch in batches:
            if batch.num_rows:
                total.add(_whole(batch, d, scale)[1] + less)
        if total.n:
            parts = [(np.array([-1]), np.array([-1]), 0, np.array([total.n])), *total.cells()]
            columns = [np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.concatenate([np.full(len(p[0]), p[2]) for p in parts]), np.concatenate([p[3] for p in parts])]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=["i", "j", "power", "value"])

    found = map_arrow(df.select(F.col(vector).alias("vector")), scatter, "i int, j int, power int, value long")
    n, sums, products = 0, [0] * d, [[0] * d for _ in range(d)]
    for i, j, power, value in found.groupBy("i", "j", "power").agg(F.sum("value").alias("value")).collect():
        if i < 0:
            n = value
        elif j == d:
            sums[i] += value << LIMB * power
        else:
            products[i][j] += value << LIMB * power
    scaled = [[n * products[min(i, j)][max(i, j)] - sums[i] * sums[j] for j in range(d)] for i in range(d)]
    covariance = np.array([[v / (n * n) for v in row] for row in scaled], np.float64) if n else np.zeros((d, d))
    trace = sum(scaled[i][i] for i in range(d)) / (n * n) if n else 0.0
    values, vectors = np.linalg.eigh(covariance) if d else (np.zeros(0), np.zeros((0, 0)))
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], vectors[:, order]
    spread = values > max(trace, 0.0) * d * np.finfo(float).eps
    return Whitening(n, d, scale, offset, tuple(s + n * (offset - less) for s in sums), values[spread], vectors[:, spread], trace)


def whiten(df: DataFrame, model: Whitening, vector: str, id_: str = "vec_id", components: int = 8) -> DataFrame:
    """``id_, n, deviation, whitened``: a row a vector.

    ``deviation`` is the sum over dimensions of (n * x - sum)**2, exact (null beyond 38
    digits), ``whitened`` the centred x along the first ``components`` over the root of the eigenvalue.
    """
    kind = df.schema[id_].dataType.simpleString()
    n, d, scale = model.n, model.dimension, model.scale
    sums = [s - n * model.offset for s in model.sums]  # of floor(scale * entry)
    onto = model.vectors[:, :components] / np.sqrt(model.eigenvalues[:components])
    largest = max(map(abs, sums), default=0)

    def along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            place, y = _whole(batch, d, scale)
            most = n * int(np.abs(y).max(initial=0)) + largest
            if d * most * most < 1 << 63:
                z = n * y - np.array(sums, np.int64)
                deviation = pa.array((z * z).sum(axis=1), pa.int64()).cast(pa.decimal128(38, 0))
            else:
                z = n * y.astype(object) - np.array(sums, object)
                deviation = pa.array([Decimal(v) if v < 10**38 else None for v in (z * z).sum(axis=1).tolist()], pa.decimal128(38, 0))
            white = (z.astype(np.float64) / n) @ onto
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(place) + 1) * onto.shape[1], pa.int32()), pa.array(white.ravel(), pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(place)), pa.array(np.full(len(place), n), pa.int64()), deviation, lists], names=["id", "n", "deviation", "whitened"])

    rows = map_arrow(df.select(F.col(id_).alias("id"), F.col(vector).alias("vector")), along, f"id {kind}, n long, deviation decimal(38,0), whitened array<double>")
    return rows.withColumnRenamed("id", id_) if id_ != "id" else rows


def identity_error(whitened: DataFrame, components: int) -> float | None:
    """The largest entry, in size, of the covariance of ``whitened`` minus the identity; null without rows or components."""
    if not components:
        return None
    at = lambda k: F.get("whitened", F.lit(k))
    cells: list[Column] = [F.abs(F.covar_pop(at(i), at(j)) - F.lit(float(i == j))) for i in range(components) for j in range(i, components)]
    return whitened.agg(F.array_max(F.array(*cells)).alias("e")).first()["e"]
