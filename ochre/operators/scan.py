"""The six-frame scan for stop codons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructField, StructType
from pyspark.sql.window import Window

from ..functions import codes, letters
from ..functions.sequence import as_text, forward_start, reverse_complement, reversed_codon, wrap1
from ..schema import HITS
from ..shipping import ensure_shipped

#: Bases of a reading strand that are taken apart at once.
CHUNK = 1 << 20
#: Sequences numbered together.
BLOCK = 1024


def codon_windows(records: DataFrame, among: list[str] | None = None, chunk: int = CHUNK, origin: bool = False, strands: tuple[str, ...] = ("+", "-")) -> DataFrame:
    """``seq_idx, seq_id, length, strand, rpos, codon, wraps``: all codons of all six frames, or those ``among`` some.

    Only the forward strand is read: a codon of the reverse strand is one whose reverse
    complement stands there.  Long sequences are cut into chunks that overlap by two bases
    first, so no array has more than ``chunk`` places; with ``origin``, the two codons
    over the origin of a circular record are one more piece.
    """
    if among is not None:
        return _codons_among(records, among, chunk, origin, strands)
    rows = records.select("seq_idx", "seq_id", "length", "circular", "seq")
    bases = F.when(F.col("length") >= 3, F.sequence(F.lit(0), F.col("length") - 3, F.lit(chunk)))
    pieces = F.transform(bases, lambda b: F.struct(b.alias("base"), F.substring(F.col("seq"), b + 1, F.lit(chunk + 2)).alias("piece"), F.lit(False).alias("wraps")))
    if origin:
        around = F.struct((F.col("length") - 2).alias("base"), F.expr("concat(substring(seq, length - 1, 2), substring(seq, 1, 2))").alias("piece"), F.lit(True).alias("wraps"))
        pieces = F.concat(pieces, F.when(F.col("circular") & (F.col("length") >= 3), F.array(around)).otherwise(F.array().cast("array<struct<base:int,piece:binary,wraps:boolean>>")))
    pieces = rows.select("seq_idx", "seq_id", "length", F.explode_outer(pieces).alias("_p")).select("seq_idx", "seq_id", "length", "_p.*")
    spots = pieces.select("*", F.explode_outer(F.sequence(F.lit(0), F.length("piece") - 3)).alias("_at")).where("_at IS NOT NULL")
    spots = spots.select("seq_idx", "seq_id", "length", "wraps", (F.col("base") + F.col("_at")).alias("_from"), as_text(F.expr("substring(piece, _at + 1, 3)")).alias("_codon"))
    spots = spots.select("*", F.explode(F.array(*map(F.lit, strands))).alias("strand"))
    minus = F.col("strand") == "-"
    rpos = F.when(minus, F.pmod(F.col("length") - 3 - F.col("_from"), F.col("length"))).otherwise(F.col("_from"))
    return spots.select("seq_idx", "seq_id", "length", "strand", rpos.alias("rpos"), F.when(minus, reverse_complement(F.col("_codon"))).otherwise(F.col("_codon")).alias("codon"), "wraps")


def _codons_among(records: DataFrame, among: list[str], chunk: int, origin: bool, strands: tuple[str, ...]) -> DataFrame:
    """``codon_windows`` for some codons: only where one stands is a row made, and no row a base."""
    rows = records.select("seq_idx", "seq_id", "length", "circular", "seq")
    ensure_shipped(records.sparkSession)
    known = rows.schema
    fields = [StructField(c, known[c].dataType) for c in ("seq_idx", "seq_id", "length")]
    schema = StructType([*fields, StructField("strand", StringType()), StructField("rpos", IntegerType()), StructField("codon", StringType()), StructField("wraps", BooleanType())])
    own = {"+": [c if "+" in strands else "" for c in among], "-": [reversed_codon(c) if "-" in strands else "" for c in among]}
    return rows.mapInArrow(letters.codon_places(own["+"], own["-"], list(among), chunk, origin, to_arrow_schema(schema)), schema)


def _named(codon: Column, stops: dict[str, str]) -> Column:
    name = F.lit("stop")
    for c, n in stops.items():
        if n != "stop":
            name = F.when(codon == c, n).otherwise(name)
    return name


def scan(records: DataFrame, table_id: int = codes.DEFAULT, stops: dict[str, str] | None = None) -> DataFrame:
    """All stop codons on both strands, origin-crossing ones of circular records with them.

    ``stops`` (codon to name) takes the place of the code's definite stops.  A codon
    with ambiguous letters counts when each of its readings is a stop.
    """
    found = codes.resolved_stops(codes.stop_set(table_id) if stops is None else stops)
    if not found:
        return records.sparkSession.createDataFrame([], HITS)
    both = codon_windows(records, sorted(found), origin=True)
    first = forward_start(F.col("strand"), F.col("rpos"), F.col("length"))
    start = F.when(F.col("wraps"), wrap1(first, F.col("length"))).otherwise(first)
    end = F.when(F.col("wraps"), wrap1(first + 2, F.col("length"))).otherwise(first + 2)
    return both.select(
        "seq_idx", "seq_id", start.cast("int").alias("start"), end.cast("int").alias("end"), "strand", (F.col("rpos") % 3 + 1).cast("int").alias("frame"),
        "codon", _named(F.col("codon"), found).alias("name"), "wraps", F.col("rpos").cast("int").alias("rpos"),
    )


def scan_totals(records: DataFrame) -> DataFrame:
    """One row: records, bases, bases looked at (three a codon), and ambiguous letters."""
    text = as_text(F.col("seq"))
    return records.agg(
        F.count(F.lit(1)).alias("sequence_count"), F.coalesce(F.sum("length"), F.lit(0)).alias("total_length"),
        F.coalesce(F.sum(F.greatest(F.col("length") - 2, F.lit(0)).cast("long") * 6), F.lit(0)).alias("total_bases_scanned"),
        F.coalesce(F.sum(F.length(F.translate(text, "ACGT", "")).cast("long")), F.lit(0)).alias("ambiguous_base_count"),
    )


def scan_order(place: Column, chunk: int) -> dict[str, Column]:
    """What rows of a scan are grouped by, in its order: record, strand, frame, and chunk of the frame.

    None of it is null, so no join adds a filter of its own and what is read twice is shuffled once.
    """
    known = lambda c, instead: F.coalesce(c, F.lit(instead))
    return {"_seq": known(F.col("seq_idx"), -1), "_minus": known((F.col("strand") == "-").cast("int"), 0), "_frame": known(F.col("frame"), 0), "_chunk": known(F.floor(place / chunk), 0)}


def first_numbers(counts: DataFrame, group: list[str]) -> DataFrame:
    """How many rows stand before each group, and in all, from ``_seq``, what else the ``group`` is ordered by, and ``_n`` rows each.

    Sums are made in two steps, within blocks of records and over blocks.
    """
    leading = group[: group.index("_seq")]
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_block", F.coalesce(F.floor(F.col("_seq") / BLOCK), F.lit(0)))
    blocks = counts.groupBy(*leading, "_block").agg(F.sum("_n").alias("_b"))
    blocks = blocks.select(*leading, "_block", F.coalesce(F.sum("_b").over(before(Window.orderBy(*leading, "_block"))), F.lit(0)).alias("_start"), F.sum("_b").over(Window.partitionBy()).alias("_total"))
    inside = before(Window.partitionBy(*leading, "_block").orderBy(*group[len(leading) :]))
    placed = counts.withColumn("_in", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(blocks, [*leading, "_block"])
    return placed.select(*group, (F.col("_in") + F.col("_start")).alias("_base"), "_total")


def numbered(hits: DataFrame, prefix: str = "stop_", chunk: int = CHUNK) -> DataFrame:
    """``hits`` with ``hit_no`` and ``id`` in scan order: crossing hits last, then record, strand, frame and place.

    Counts are summed up in four steps (within a chunk of a frame, a frame, a block of
    records, over blocks), so no window ever holds all hits, nor all of a chromosome's frame.
    """
    keys = {"_wraps": F.coalesce("wraps", F.lit(False)), **scan_order(F.col("rpos"), chunk)}
    group = list(keys)
    own = hits.withColumns(keys)
    base = first_numbers(own.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")), group)
    ranked = own.withColumn("_row", F.row_number().over(Window.partitionBy(*group).orderBy("rpos")))
    joined = ranked.join(base, group).withColumn("hit_no", F.col("_base") + F.col("_row"))
    digits = F.greatest(F.lit(4), F.length(F.col("_total").cast("string")))
    name = F.concat(F.lit(prefix), F.lpad(F.col("hit_no").cast("string"), digits, F.lit("0")))
    return joined.select("hit_no", name.alias("id"), *hits.columns)
