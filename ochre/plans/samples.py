"""Reproducible sample sequences.

Bases come from a counter: each place is worked out from the seed and its own number by
32-bit arithmetic (the public-domain generator mulberry32), so any part of a sequence
can be made by itself, by any task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import as_bytes

#: Bases made at once.
CHUNK = 1 << 12
# Fixed values of the generator: what the counter grows by, the shifts, and what is or'ed in.
GROWS_BY, SHIFTS, ORED = 0x6D2B79F5, (15, 7, 14), (1, 61)
_WORD = 0xFFFFFFFF


def _times(a: Column, b: Column) -> Column:
    """The low 32 bits of a product of two 32-bit numbers, without any intermediate beyond 49 bits."""
    high = (a * F.shiftright(b, 16)).bitwiseAND(0xFFFF) * (1 << 16)
    return (a * b.bitwiseAND(0xFFFF) + high).bitwiseAND(_WORD)


def uniform(seed: Column, place: Column) -> Column:
    """The 32-bit number at ``place`` (from 0) of the sequence of a seed, as a long."""
    step = _times((place + 1).cast("long").bitwiseAND(_WORD), F.lit(GROWS_BY).cast("long"))
    # each value is bound once, as it is used twice
    bound = lambda value, fn: F.get(F.transform(F.array(value), fn), F.lit(0))
    a = (seed.cast("long") + step).bitwiseAND(_WORD)
    first = bound(a, lambda s: _times(s.bitwiseXOR(F.shiftrightunsigned(s, SHIFTS[0])), s.bitwiseOR(F.lit(ORED[0]).cast("long"))))
    second = bound(first, lambda t: (t + _times(t.bitwiseXOR(F.shiftrightunsigned(t, SHIFTS[1])), t.bitwiseOR(F.lit(ORED[1]).cast("long")))).bitwiseAND(_WORD).bitwiseXOR(t))
    return bound(second, lambda t: t.bitwiseXOR(F.shiftrightunsigned(t, SHIFTS[2])))


def base(seed: Column, place: Column) -> Column:
    """The base at a place: a quarter of the numbers each."""
    return F.substring(F.lit("ACGT"), F.shiftrightunsigned(uniform(seed, place), 30).cast("int") + 1, F.lit(1))


def sample_records(specs: DataFrame) -> DataFrame:
    """Records from ``seq_idx, seq_id, seed, length, circular, planted`` (places from 0, and codons that stand there instead).

    Chunks are made one by one, with the codons that reach into them, and joined by record,
    so what a codon costs doesn't grow with its record.
    Nulls: no length is none, a null seed is 0; codons that don't fit are left out.
    """
    sized = specs.withColumn("length", F.greatest(F.lit(0), F.coalesce(F.col("length"), F.lit(0))).cast("int")).withColumn("seed", F.coalesce(F.col("seed"), F.lit(0)).cast("long"))
    chunks = sized.select("seq_idx", "seed", "length", F.explode_outer(F.when(F.col("length") > 0, F.sequence(F.lit(0), F.col("length") - 1, F.lit(CHUNK)))).alias("_from"))

    # a codon goes to each chunk that it reaches into, cut to it; later ones in their order stand over earlier ones
    sites = sized.select("seq_idx", "length", F.posexplode("planted").alias("_k", "_p")).select("seq_idx", "length", "_k", "_p.at", "_p.codon").withColumn("_end", F.col("at") + F.length("codon"))
    sites = sites.where("codon <> '' AND at >= 0 AND _end <= length")
    firsts = F.sequence(F.floor(F.col("at") / CHUNK), F.floor((F.col("_end") - 1) / CHUNK))
    sites = sites.select("*", F.explode(firsts).alias("_no")).withColumn("_from", (F.col("_no") * CHUNK).cast("int"))
    begin, end = F.greatest("at", "_from"), F.least(F.col("_end"), F.col("_from") + CHUNK)
    sites = sites.select("seq_idx", "_from", F.struct("_k", (begin - F.col("_from")).alias("at"), F.substring("codon", begin - F.col("at") + 1, end - begin).alias("codon")).alias("_p"))
    sites = sites.groupBy("seq_idx", "_from").agg(F.sort_array(F.collect_list("_p")).alias("_own"))

    # dealt out by chunk, as a record may be nearly all there is
    dealt = chunks.repartition(specs.sparkSession.sparkContext.defaultParallelism * 4, "seq_idx", "_from").join(sites, ["seq_idx", "_from"], "left")
    places = F.sequence(F.col("_from"), F.least(F.col("_from") + CHUNK, F.col("length")) - 1)
    plain = F.coalesce(F.array_join(F.transform(places, lambda k: base(F.col("seed"), k)), ""), F.lit(""))
    text = F.aggregate(F.coalesce("_own", F.array().cast("array<struct<_k:int,at:int,codon:string>>")), plain, lambda s, p: F.overlay(s, p["codon"], p["at"] + 1, F.length(p["codon"])))
    bodies = dealt.select("seq_idx", "_from", text.alias("_text")).groupBy("seq_idx").agg(F.array_join(F.sort_array(F.collect_list(F.struct("_from", "_text")))["_text"], "").alias("_body"))
    own = sized.join(bodies, "seq_idx")
    return own.select("seq_idx", "seq_id", as_bytes(F.col("_body")).alias("seq"), "length", F.coalesce(F.col("circular"), F.lit(False)).alias("circular"), F.lit("raw").alias("source_kind"))
