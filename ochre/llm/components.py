"""Connected components of a graph of links, by alternating large and small stars.

Each round hangs every vertex's larger neighbours on its smallest one, then every
vertex and its smaller neighbours likewise, until nothing changes; the number of
rounds grows with the logarithm of the largest component.  Edges are written to the
shared folder after each round, so lineage stays short; those of the round before go.  Minima are combined before
the shuffle and the joins can be split where one vertex has very many edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, temporary, written


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("sum")).first()
    return row["n"], row["sum"]


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v) to (vertex, component), a written table: the smallest vertex that can be reached.  Vertices without edges don't appear."""
    with temporary(edges.sparkSession) as keep:
        return keep(written(_components(edges), "components"))


def _components(edges: DataFrame) -> DataFrame:
    edges = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    mark = _mark(edges)
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small_least = large.where("u <> v").groupBy("u").agg(F.min("v").alias("m"))
        small = large.where("u <> v").join(small_least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        last, edges = edges, written(small.where("u <> v").distinct(), "edges")
        discard(last)
        last, mark = mark, _mark(edges)
        if last == mark:
            break
    pairs = edges.select(F.col("u").alias("vertex"), F.col("v").alias("component"))
    return pairs.unionByName(edges.select(F.col("v").alias("vertex"), F.col("v").alias("component"))).groupBy("vertex").agg(F.min("component").alias("component"))
