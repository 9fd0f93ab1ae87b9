"""Where a stop lies: terminator, inside a gene, or between genes.

Matching is on the same strand only.  Terminators come from the features: each CDS
or ORF claims the one stop at its true end.  Other stops meet features by bins of several
levels: a segment stands at the level whose bins are as wide as itself, so in two bins at
most however long it is, and a stop looks up one bin a level, of the levels that occur.
The join is on record, strand and bin, so no record is joined as a whole.  Claims are found
by the same bins, so stops and features are made and shuffled once for all of it.  A feature
is a row a bin, however many segments it has there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codes
from ..functions.sequence import feature_key, non_empty
from ..schema import CODING, NONCODING

#: The width of the narrowest bins, and by how many powers of two those of the next level are wider.
BIN, STEP, LEVELS = 256, 6, 4
#: The bin of stops without a record, in which no feature lies.
NOWHERE = -(1 << 62)
#: What tells a stop from all others.
KEY = ["seq_id", "strand", "rpos"]
ADDED = ("context", "gene_name", "locus_tag", "product", "feature_id", "in_frame", "recoding_candidate", "recoded_aa", "terminator_feature_ids")


def coding_offset(strand: Column, ordered: Column, start: Column, end: Column) -> Column:
    """How many coding bases stand before a codon in a spliced feature; null outside its segments."""
    plus = strand == "+"
    begin = F.struct(F.lit(0).alias("done"), F.lit(None).cast("int").alias("at"))

    def step(state: Column, s: Column) -> Column:
        inside = F.when(plus, (start >= s["start"]) & (start <= s["end"])).otherwise((end >= s["start"]) & (end <= s["end"]))
        here = state["done"] + F.when(plus, start - s["start"]).otherwise(s["end"] - end)
        return F.struct((state["done"] + s["end"] - s["start"] + 1).alias("done"), F.when(state["at"].isNull() & inside, here).otherwise(state["at"]).alias("at"))

    return F.aggregate(ordered, begin, step, lambda state: state["at"])


def in_reading_frame(offset: Column, phase: Column) -> Column:
    shift = F.when(phase.isin(1, 2), phase).otherwise(0)
    return F.coalesce(F.pmod(offset - shift, F.lit(3)) == 0, F.lit(False))


def three_prime(strand: Column, ordered: Column) -> Column:
    """The forward coordinate of a feature's last base in reading direction."""
    last = F.element_at(ordered, -1)
    return F.when(strand == "+", last["end"]).otherwise(last["start"])


def _prepared(features: DataFrame, table_id: int) -> DataFrame:
    return features.select(
        "feat_idx", "seq_id", "strand", "type", "segments", "ordered_segments", (F.col("end") - F.col("start")).alias("span"), F.col("type").isin(*CODING).alias("coding"), "phase",
        F.coalesce("transl_table", F.lit(table_id)).alias("code"), "transl_except",
        F.struct(non_empty(F.col("name")).alias("gene_name"), non_empty(F.col("locus_tag")).alias("locus_tag"), non_empty(F.col("product")).alias("product"), feature_key().alias("feature_id")).alias("names"),
    )


def _stops_here(codon: Column) -> Column:
    return (F.col("type") != "CDS") | F.array_contains(codes.stops_of(F.col("code")), codon)


def assign_terminators(hits: DataFrame, features: DataFrame, table_id: int = codes.DEFAULT) -> DataFrame:
    """``seq_id, strand, rpos, codon, feat_idx, type, span, names, included, start``: the stop that each CDS or ORF ends with.

    First the feature's own last codon, if it is an in-frame stop under the feature's
    code; else the codon right after the feature.
    """
    claims = _claims(_placed(hits, 1), _ends(features, table_id))
    return claims.select("seq_id", "strand", "rpos", F.col("_hit.codon").alias("codon"), "feat_idx", "type", "span", "names", "included", F.col("_hit.start").alias("start"))


def _placed(hits: DataFrame, levels: int, shared: bool = True) -> DataFrame:
    """``seq_id, strand, rpos, wraps, start, end, _hit, _spot``: each hit in the bin of each level in which it starts.

    One over the origin is also where it would start before the first base, for features
    that end there.  What it is joined by is never null, so no join adds a filter of its own
    and stops that are joined twice are shuffled once; unless ``shared``, keys stay as they
    are, so that a filter on them also holds for the features.
    """
    rest = [c for c in hits.columns if c not in KEY]
    lost = F.col("seq_id").isNull()
    spots = lambda place: [_spot(_bin(place, k)) for k in range(levels)]
    starts, before = spots(F.col("start")), spots(F.col("end") - 2)
    bins = F.when(F.col("wraps"), F.array_distinct(F.array(*starts, *before))).otherwise(F.array(*starts))
    bins = F.when(lost, F.array(F.lit(NOWHERE))).otherwise(bins)
    keys = [F.coalesce(c, F.lit("")).alias(c) if shared else F.col(c) for c in ("seq_id", "strand")]
    return hits.select(*keys, "rpos", "wraps", "start", "end", F.struct(*rest, lost.alias("_lost")).alias("_hit"), F.explode(bins).alias("_spot"))


def _spot(number: Column) -> Column:
    """One number for a bin of a strand of a record: rows are sorted by it at once, and by names only where two have the same."""
    return F.xxhash64("seq_id", "strand", number)


def _same() -> Column:
    return (F.col("_spot") == F.col("__spot")) & (F.col("seq_id") == F.col("_seq_id")) & (F.col("strand") == F.col("_strand"))


def _end_bins(end: Column) -> Column:
    """The narrowest bins of the codon that ends at a feature's end and of the one right after it."""
    ahead = F.col("strand") == "+"
    return F.array(_bin(F.when(ahead, end - 2).otherwise(end - 3), 0), _bin(F.when(ahead, end + 1).otherwise(end), 0))


def _in_spots(features: DataFrame, bins: Column, *columns: Column) -> DataFrame:
    """``__spot, _seq_id, _strand, _f``: a row a feature and bin, with ``columns`` in one."""
    rows = features.where("seq_id IS NOT NULL AND strand IS NOT NULL").select("seq_id", "strand", F.struct(*columns).alias("_f"), F.explode(F.array_distinct(bins)).alias("_number"))
    return rows.select(_spot(F.col("_number")).alias("__spot"), F.col("seq_id").alias("_seq_id"), F.col("strand").alias("_strand"), "_f")


def _ends(features: DataFrame, table_id: int) -> DataFrame:
    """CDS and ORFs in the bins of the stops that may end them."""
    coding = _prepared(features, table_id).where("coding").withColumn("_end", three_prime(F.col("strand"), F.col("ordered_segments")))
    return _in_spots(coding, _end_bins(F.col("_end")), *[F.col(c) for c in ("_end", "feat_idx", "type", "span", "names", "ordered_segments", "phase", "code")])


def _binned(known: DataFrame, table_id: int, named: bool) -> DataFrame:
    """Features in the bins of all stops that overlap or end them, shuffled by them once for both."""
    known = _prepared(known, table_id)
    first, last = F.array_min(F.col("segments.start")), F.array_max(F.col("segments.end"))
    known = known.withColumn("_end", F.when(F.col("coding"), three_prime(F.col("strand"), F.col("ordered_segments")))).withColumn("_from", first).withColumn("_to", last)
    of_segments = F.flatten(F.transform("segments", lambda s: _span_bins(s["start"] - 2, s["end"])))
    each = F.when(F.col("_end").isNotNull(), F.concat(of_segments, _end_bins(F.col("_end")))).otherwise(of_segments)
    # one that fits into a narrow bin with all that may end it needs no bins of its parts
    bins = F.when(F.col("_to") - F.col("_from") + 9 <= BIN, F.array(_bin(F.col("_from") - 5, 0), _bin(F.col("_to") + 3, 0))).otherwise(each)
    # a feature of one segment is told by that alone
    single = F.coalesce((F.size("segments") == 1) & (F.col("segments") == F.col("ordered_segments")), F.lit(False))
    names = F.col("names") if named else F.struct(*[F.lit(None).cast("string").alias(c) for c in ("gene_name", "locus_tag", "product", "feature_id")]).alias("names")
    own = [
        (~F.col("coding")).alias("_c"), *[F.col(c) for c in ("span", "feat_idx", "type", "_from", "_to", "_end", "phase", "code", "transl_except")], names,
        F.when(F.size("segments") > 1, F.col("segments")).alias("segments"), F.when(~single, F.col("ordered_segments")).alias("ordered_segments"), F.col("strand").alias("_fs"),
    ]
    return _in_spots(known, bins, *own).repartition("__spot", "_seq_id", "_strand")


def _claims(placed: DataFrame, rows: DataFrame) -> DataFrame:
    """``seq_id, strand, feat_idx, type, span, names, rpos, included, _hit``: the stop, of those ``_placed``, that each CDS or ORF ends with."""
    f, plus = F.col("_f"), F.col("strand") == "+"
    # not a condition on stops alone, which would part their shuffle from that of ``annotate``
    placed_at = lambda a, b: F.when(F.col("_hit._lost"), F.lit(None)).when(plus, a).otherwise(b)
    last = placed_at(F.col("end"), F.col("start")) == f["_end"]
    after = placed_at(F.col("start") - 1, F.col("end") + 1) == f["_end"]
    met = placed.join(rows, _same() & (last | after))
    offset = coding_offset(F.col("strand"), f["ordered_segments"], F.col("start"), F.col("end"))
    if "_from" in rows.schema["_f"].dataType.names:
        at = F.when(plus, F.col("start")).otherwise(F.col("end"))
        single = F.when((at >= f["_from"]) & (at <= f["_to"]), F.when(plus, at - f["_from"]).otherwise(f["_to"] - at))
        offset = F.when(f["ordered_segments"].isNull(), single).otherwise(offset)
    own = last & in_reading_frame(offset, f["phase"])
    stops = (f["type"] != "CDS") | F.array_contains(codes.stops_of(f["code"]), F.col("_hit.codon"))
    met = met.where(stops & (own | after)).withColumn("way", F.when(own, 0).otherwise(1))
    # the whole hit and feature, so that they are the same shuffles as those of ``annotate``
    first = F.min_by(F.struct("way", "rpos", "_hit"), F.struct("way", "wraps", "rpos")).alias("_first")
    chosen = met.groupBy("seq_id", "strand", f["feat_idx"].alias("feat_idx")).agg(first, F.first("_f").alias("_f"))
    return chosen.select("seq_id", "strand", "feat_idx", "_f.type", "_f.span", "_f.names", F.col("_first.rpos").alias("rpos"), (F.col("_first.way") == 0).alias("included"), F.col("_first._hit").alias("_hit"))


def _by_stop(claims: DataFrame) -> DataFrame:
    """``seq_id, strand, rpos, _hit, _t``: a row a stop that is claimed, with the feature that counts and the ids of all."""
    ids = F.sort_array(F.collect_list(F.when(F.col("names.feature_id").isNotNull(), F.struct("feat_idx", F.col("names.feature_id").alias("fid")))))
    ending = F.min(F.struct("span", (-F.col("feat_idx")).alias("_later"), "type", "names")).alias("_e")
    found = claims.groupBy(*KEY).agg(F.first("_hit").alias("_hit"), ending, F.array_distinct(ids["fid"]).alias("_ids"))
    return found.select(*KEY, "_hit", F.struct("_e.type", "_e.names", F.when(F.size("_ids") > 1, F.col("_ids")).alias("ids")).alias("_t"))


def _ended(kind: Column) -> Column:
    return F.when(kind == "ORF", "orf-terminator").otherwise("cds-terminator")


def ending(hits: DataFrame, features: DataFrame, table_id: int = codes.DEFAULT) -> DataFrame:
    """The rows of ``annotate`` that are terminators, which are known without looking at any other feature."""
    found = _by_stop(_claims(_placed(hits, 1), _ends(features, table_id))).select(*KEY, "_hit.*", "_t")
    t = F.col("_t")
    return found.select(
        *hits.columns, _ended(t["type"]).alias("context"), *[t["names"][c].alias(c) for c in ("gene_name", "locus_tag", "product", "feature_id")],
        F.lit(True).alias("in_frame"), F.lit(False).alias("recoding_candidate"), F.lit(None).cast("string").alias("recoded_aa"), t["ids"].alias("terminator_feature_ids"),
    )


def _level(width: Column) -> Column:
    """The lowest level whose bins are at least ``width`` wide."""
    out = F.lit(LEVELS - 1)
    for k in reversed(range(LEVELS - 1)):
        out = F.when(width <= BIN << STEP * k, k).otherwise(out)
    return out


def _bin(place: Column, level: Column | int) -> Column:
    """A number for the bin of a level in which a place lies."""
    sizes = [BIN << STEP * k for k in range(LEVELS)]
    size = F.lit(sizes[level]) if isinstance(level, int) else F.get(F.array(*map(F.lit, sizes)), level)
    return F.floor(place / size) * LEVELS + level


def _span_bins(first: Column, last: Column) -> Column:
    """The bins, of the level as wide as a span, in which its places lie: two at most, but beyond the widest bins all between."""
    level = _level(last - first + 1).cast("int")
    size = BIN << STEP * (LEVELS - 1)
    wide = F.transform(F.sequence(F.floor(first / size), F.floor(last / size)), lambda k: k * LEVELS + (LEVELS - 1))
    return F.when(last - first < size, F.array_distinct(F.array(_bin(first, level), _bin(last, level)))).otherwise(wide)


def segment_bins(features: DataFrame) -> DataFrame:
    """A row a segment and bin in which a stop that overlaps it may start, at most two for each: the features' columns, ``_s`` and ``_bin``."""
    segments = features.select("*", F.explode("segments").alias("_s"))
    return segments.select("*", F.explode(_span_bins(F.col("_s.start") - 2, F.col("_s.end"))).alias("_bin"))


def levels_of(features: DataFrame, widest: int | None = None) -> int:
    """How many levels hold the segments of ``features``; none is wider than ``widest``, where that is known."""
    if widest is None:
        widest = features.agg(F.max(F.array_max(F.transform("segments", lambda s: s["end"] - s["start"] + 1))).alias("w")).first()["w"]
    widest = (widest or 0) + 2
    return next((k + 1 for k in range(LEVELS - 1) if widest <= BIN << STEP * k), LEVELS)


def annotate(hits: DataFrame, features: DataFrame, table_id: int = codes.DEFAULT, plain: DataFrame | None = None, widest: int | None = None, named: bool = True) -> DataFrame:
    """``hits`` with their context; every hit stays.

    ``plain``: all hits, where ``hits`` are but some of them.  ``widest``: the bases of the
    widest segment or more, if known, which saves working all features out for it.  Unless
    ``named``, names and ids of features are left out, for those who only ask for contexts.
    """
    known = features.where(F.col("type").isin(*CODING, *NONCODING))
    levels = levels_of(known, widest)
    own, rows = _placed(hits, levels, plain is None), _binned(known, table_id, named)
    claims = _claims(own, rows) if plain is None else _claims(_placed(plain.select(*KEY, "wraps", "start", "end", "codon"), 1, False), _ends(features, table_id))
    here = _spot(_bin(F.col("_hit.start"), 0))
    ends = _by_stop(claims).select(here.alias("__spot"), F.col("seq_id").alias("_seq_id"), F.col("strand").alias("_strand"), F.col("rpos").alias("_rpos"), "_t")
    # by bins like the other join, so that nothing is sorted anew between them
    keys = ["__spot", "_seq_id", "_strand"]
    met = own.join(ends, _same() & (F.col("_rpos") <= F.col("rpos")) & (F.col("_rpos") >= F.col("rpos")), "left").drop(*keys)
    f, overlap = F.col("_f"), lambda a, b: (b >= F.col("start")) & (a <= F.col("end"))
    inside = overlap(f["_from"], f["_to"]) & (f["segments"].isNull() | F.exists(f["segments"], lambda s: overlap(s["start"], s["end"])))
    # in one, so that no part of it becomes a filter of features, which would part their shuffle from that of claims
    met = met.join(rows, _same() & F.coalesce(~F.col("wraps") & ~F.col("_hit._lost") & inside, F.lit(False)), "left")
    # of a feature's segments that overlap a stop, the greatest counts
    parts = F.transform(F.filter(f["segments"], lambda s: overlap(s["start"], s["end"])), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    segment = F.when(f["segments"].isNull(), F.struct(f["_from"].alias("start"), f["_to"].alias("end"))).otherwise(F.array_max(parts))
    order = F.when(f.isNotNull(), F.struct(f["_c"].alias("_c"), f["span"].alias("span"), segment.alias("segment"), f["feat_idx"].alias("feat_idx"), f.alias("_own")))
    by = ["_spot", *KEY] if levels == 1 else KEY  # with one level, stops stay where the joins have put them
    joined = met.groupBy(*by).agg(F.first("_hit").alias("_hit"), F.min(order).alias("_f"), F.min("_t").alias("_t"))
    if levels == 1:  # one over the origin counts where it starts
        joined = joined.where(~F.col("_hit.wraps") | F.col("_hit._lost") | (F.col("_spot") == here))
    joined = joined.select(F.when(~F.col("_hit._lost"), F.col("seq_id")).alias("seq_id"), "strand", "rpos", "_hit.*", F.struct("_f._own.*", "_f.segment").alias("_f"), F.col("_f").isNull().alias("_none"), "_t")
    f, t = F.col("_f"), F.col("_t")
    ahead, (first, last) = f["_fs"] == "+", (f["segment"][c] for c in ("start", "end"))
    within = F.when(ahead, F.when((F.col("start") >= first) & (F.col("start") <= last), F.col("start") - first)).when((F.col("end") >= first) & (F.col("end") <= last), last - F.col("end"))
    offset = F.when(f["ordered_segments"].isNull(), within).otherwise(coding_offset(f["_fs"], f["ordered_segments"], F.col("start"), F.col("end")))
    joined = joined.withColumn("_frame", F.when(t.isNull() & ~f["_c"], in_reading_frame(offset, f["phase"])))
    exception = F.get(F.filter(f["transl_except"], lambda x: (x["start"] <= F.col("end")) & (x["end"] >= F.col("start"))), F.lit(0))
    is_cds = f["type"] == "CDS"
    recoded = is_cds & (exception.isNotNull() | ~F.array_contains(codes.stops_of(f["code"]), F.col("codon")))
    context = (
        F.when(t.isNotNull(), _ended(t["type"]))
        .when(F.col("_none"), "intergenic")
        .when(f["_c"], "within-noncoding-gene")
        .when(~F.col("_frame"), "cds-internal-outframe")
        .when(recoded, "cds-recoded")
        .otherwise("cds-internal-inframe")
    )
    names = F.coalesce(t["names"], f["names"])
    return joined.withColumn("context", context).select(
        *hits.columns, "context", names["gene_name"].alias("gene_name"), names["locus_tag"].alias("locus_tag"), names["product"].alias("product"), names["feature_id"].alias("feature_id"),
        F.when(t.isNotNull(), True).otherwise(F.col("_frame")).alias("in_frame"), (F.col("context") == "cds-internal-inframe").alias("recoding_candidate"),
        F.when((F.col("context") == "cds-recoded") & exception.isNotNull(), F.coalesce(exception["aa"], F.lit("recoded"))).alias("recoded_aa"),
        t["ids"].alias("terminator_feature_ids"),
    )


#: Bases of a bin in which ends of features and stops near them meet.
NEAR = 16


def nearest_terminators(hits: DataFrame, features: DataFrame, table_id: int = codes.DEFAULT, strict: bool = False) -> DataFrame:
    """``seq_id, strand, rpos, context, feature_id, feat_idx, distance``: stops that stand at the end of a CDS or ORF, give or take three bases.

    This is the tolerant test for single stops, as against ``assign_terminators``: a stop
    that is part of the feature must be in its frame, one right after it needn't.  The
    nearest feature counts, of those the shortest, then the first by start and number.
    ``strict`` allows no distance.  Stops over the origin take no part.
    """
    most = 0 if strict else 3
    coding = _prepared(features, table_id).where("coding").withColumn("_end", three_prime(F.col("strand"), F.col("ordered_segments")))
    # a stop that counts starts at most six bases from the feature's last one
    bins = F.array_distinct(F.array(F.floor((F.col("_end") - 6) / NEAR), F.floor((F.col("_end") + 6) / NEAR)))
    coding = coding.select("*", F.explode(bins).alias("_bin"))
    own = hits.where("NOT wraps").select(*KEY, "start", "end", "codon", F.floor(F.col("start") / NEAR).alias("_bin"))
    met = own.join(coding, ["seq_id", "strand", "_bin"])
    plus = F.col("strand") == "+"
    included = F.when(plus, F.abs(F.col("end") - F.col("_end"))).otherwise(F.abs(F.col("start") - F.col("_end")))
    after = F.when(plus, F.abs(F.col("start") - F.col("_end") - 1)).otherwise(F.abs(F.col("end") - F.col("_end") + 1))
    offset = coding_offset(F.col("strand"), F.col("ordered_segments"), F.col("start"), F.col("end"))
    distance = F.least(F.when((included <= most) & in_reading_frame(offset, F.col("phase")), included), F.when(after <= most, after))
    met = met.where(_stops_here(F.col("codon"))).withColumn("distance", distance).where("distance IS NOT NULL")
    first = F.array_min(F.col("segments.start"))
    best = met.groupBy(*KEY).agg(F.min(F.struct("distance", "span", first.alias("first"), "feat_idx", "type", "names")).alias("_t"))
    return best.select(*KEY, _ended(F.col("_t.type")).alias("context"), F.col("_t.names.feature_id").alias("feature_id"), "_t.feat_idx", "_t.distance")


def without_context(hits: DataFrame) -> DataFrame:
    """The schema of ``annotate`` where there are no features."""
    kinds = {"in_frame": "boolean", "recoding_candidate": "boolean", "terminator_feature_ids": "array<string>"}
    return hits.select("*", *[F.lit(None).cast(kinds.get(c, "string")).alias(c) for c in ADDED])
