"""Column expressions on sequences and coordinates.

Sequences are scanned as ASCII bytes: a substring of bytes takes the same time
anywhere, one of a string grows with its place.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters and their complements; others stay.
BASES, COMPLEMENTS = "ACGTRYKMBVDH", "TGCAYRMKVBHD"


def normalized(text: Column, letters: str = "", instead: str = "") -> Column:
    """Upper case, U as T, and only letters A-Z; further ``letters`` may be read as others in the same pass."""
    upper = F.upper(F.coalesce(text, F.lit("")))
    one = F.translate(upper, "U" + letters, "T" + instead) if letters else F.replace(upper, F.lit("U"), F.lit("T"))
    return F.regexp_replace(one, "[^A-Z]", "")


def normalization_stats(text: Column) -> Column:
    """What ``normalized`` changes and what the sequence holds besides bases."""
    text = F.coalesce(text, F.lit(""))
    counted = {"lowercase": "[a-z]", "u_converted": "[uU]", "gaps": r"[-.*~]", "unexpected": "[EFIJLOPQXZefijlopqxz]", "ambiguous": "[RYSWKMBDHVNryswkmbdhvn]"}
    return F.struct(*[F.regexp_count(text, F.lit(p)).cast("long").alias(name) for name, p in counted.items()])


def normalization_note(stats: Column) -> Column:
    """A sentence on what was changed; null if nothing was."""
    parts = [("u_converted", " U for T"), ("lowercase", " small letters"), ("gaps", " gap marks, taken out"), ("unexpected", " letters that stand for no base")]
    notes = F.concat_ws("; ", *[F.when(stats[name] > 0, F.concat(stats[name].cast("string"), F.lit(what))) for name, what in parts])
    return F.when(notes != "", F.concat(F.lit("The sequence had "), notes, F.lit(".")))


def as_bytes(seq: Column) -> Column:
    return F.encode(seq, "US-ASCII")


def as_text(seq: Column) -> Column:
    return F.decode(seq, "US-ASCII")


def complement(seq: Column) -> Column:
    return F.translate(seq, BASES, COMPLEMENTS)


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def reversed_codon(codon: str) -> str:
    """``reverse_complement`` of a few letters in Python."""
    return codon[::-1].translate(str.maketrans(BASES, COMPLEMENTS))


def count_ambiguous(seq: Column) -> Column:
    """Letters other than A, C, G and T."""
    return F.length(F.translate(seq, "ACGT", ""))


def wrap1(x: Column, length: Column) -> Column:
    """A 1-based coordinate on a circle."""
    return F.pmod(x - 1, length) + 1


def forward_start(strand: Column, rpos: Column, length: Column) -> Column:
    """The 1-based forward start of the codon at ``rpos`` (from 0) of the reading strand."""
    return F.when(strand == "-", length - 2 - rpos).otherwise(rpos + 1)


def signed_frame(strand: Column, frame: Column) -> Column:
    return F.concat(F.when(strand == "-", "-").otherwise("+"), frame.cast("string"))


def wrapped_lines(text: Column, width: int = 60) -> Column:
    return F.regexp_replace(text, f"(.{{{width}}})(?=.)", "$1\n")


def truncated(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - 1), F.lit("…"))).otherwise(text)


def non_empty(c: Column) -> Column:
    return F.when(c != "", c)


#: Where a feature's id comes from.
def feature_key() -> Column:
    return F.coalesce(non_empty(F.col("id")), non_empty(F.col("locus_tag")), non_empty(F.col("name")))
