from helpers import feature, features, records, tuples
from pyspark.sql import functions as F

from ochre.operators import aggregate, annotate, extract, scan, select
from ochre.schema import HITS


def contexts(spark, seq, *rows, circular=False, table=11):
    hits = scan.numbered(scan.scan(records(spark, ("a", seq, circular)), table))
    out = annotate.annotate(hits, features(spark, *rows), table)
    return {(r["start"], r["strand"]): r for r in out.collect()}


#      123456789012345678
PLUS = "ATGTAACCCTAGTGACCC"


def test_terminator_included_and_internal(spark):
    got = contexts(spark, PLUS, feature(1, "a", "CDS", "+", (1, 12)))
    assert got[10, "+"]["context"] == "cds-terminator" and got[10, "+"]["in_frame"]
    assert got[4, "+"]["context"] == "cds-internal-inframe" and got[4, "+"]["recoding_candidate"]
    assert got[13, "+"]["context"] == "intergenic" and got[13, "+"]["in_frame"] is None  # a tandem stop is no second terminator


def test_terminator_excluded(spark):
    got = contexts(spark, PLUS, feature(1, "a", "CDS", "+", (1, 9)))
    assert got[10, "+"]["context"] == "cds-terminator"


def test_shared_stop(spark):
    got = contexts(spark, PLUS, feature(1, "a", "CDS", "+", (1, 12)), feature(2, "a", "CDS", "+", (4, 12)))
    assert got[10, "+"]["terminator_feature_ids"] == ["f1", "f2"] and got[10, "+"]["feature_id"] == "f2"


def test_strand_must_match(spark):
    got = contexts(spark, "CCCTTAGGG", feature(1, "a", "CDS", "+", (1, 9)))
    assert got[4, "-"]["context"] == "intergenic"


def test_codes_and_exceptions(spark):
    other = feature(1, "a", "CDS", "+", (1, 18), transl_table=4)
    assert contexts(spark, "ATGTGACCCCCCCCCCCC", other)[4, "+"]["context"] == "cds-recoded"
    sec = feature(1, "a", "CDS", "+", (1, 18), transl_except=[(4, 6, "Sec")])
    got = contexts(spark, "ATGTGACCCCCCCCCCCC", sec)[4, "+"]
    assert (got["context"], got["recoded_aa"]) == ("cds-recoded", "Sec")


def test_phase_shifts_the_frame(spark):
    base = feature(1, "a", "CDS", "+", (1, 18))
    shifted = feature(1, "a", "CDS", "+", (1, 18), phase=1)
    seq = "CATGTAACCCCCCCCCCC"
    assert contexts(spark, seq, base)[5, "+"]["context"] == "cds-internal-outframe"
    assert contexts(spark, seq, shifted)[5, "+"]["context"] == "cds-internal-inframe"


def test_noncoding_and_specific(spark):
    got = contexts(spark, PLUS, feature(1, "a", "gene", "+", (1, 18)), feature(2, "a", "mRNA", "+", (3, 8)))
    assert got[4, "+"]["context"] == "within-noncoding-gene" and got[4, "+"]["feature_id"] == "f2"


def test_spliced_minus_offset(spark):
    found = spark.range(1).select(annotate.coding_offset(F.lit("-"), F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((20, 25), (1, 10))]), F.lit(6), F.lit(8)).alias("v")).first()["v"]
    assert found == 6 + 2


def test_far_feature_over_bins(spark):
    seq = "C" * 9000 + "TAA" + "C" * 100
    assert contexts(spark, seq, feature(1, "a", "gene", "+", (10, 9050)))[9001, "+"]["context"] == "within-noncoding-gene"


def test_wrap_hits(spark):
    got = contexts(spark, "AACCCCCCCT", feature(1, "a", "gene", "+", (1, 10)), circular=True)
    assert got[10, "+"]["wraps"] and got[10, "+"]["end"] == 2 and got[10, "+"]["context"] == "intergenic"


def test_gene_summary_and_sanity(spark):
    own = records(spark, ("a", PLUS, False))
    table = features(spark, feature(1, "a", "CDS", "+", (1, 12)), feature(2, "a", "CDS", "+", (4, 12)), feature(3, "a", "CDS", "-", (1, 18)))
    hits = annotate.annotate(scan.scan(own), table)
    rows = {r["feature_id"]: r for r in aggregate.gene_summary(hits, table).collect()}
    assert rows["f1"]["internal_stops"] + rows["f2"]["internal_stops"] == 1
    assert rows["f1"]["terminator_codon"] == rows["f2"]["terminator_codon"] == "TAG" and rows["f3"]["terminator_codon"] is None
    bad = spark.createDataFrame([(k, 1, None) for k in range(19)], "feat_idx int, internal_stops int, terminator_codon string")
    assert not aggregate.code_sanity(bad).first()["suspicious"]
    assert aggregate.code_sanity(bad.unionByName(bad)).first()["suspicious"]
    assert aggregate.code_sanity(bad.limit(0)).first()["suspicious"] is False


def test_summary_is_dense(spark):
    own = records(spark, ("a", "CCCTTAGGG", False))
    row = aggregate.summary(scan.scan(own), own, ["TAA", "TAG", "TGA"]).first()
    assert row["by_codon"] == {"TAA": 1, "TAG": 1, "TGA": 0} and row["by_frame"]["-3"] == 0 and row["gc_count"] == 6
    empty = records(spark)
    row = aggregate.summary(scan.scan(empty), empty, ["TAA"]).first()
    assert row["total_stops"] == 0 and row["gc_percent"] == 0.0
    assert sum(r["plus"] + r["minus"] for r in aggregate.density_bins(scan.scan(own), own).collect()) == 2


def test_views(spark):
    own = records(spark, ("a", PLUS * 4, True))
    table = features(spark, feature(1, "a", "CDS", "+", (1, 12), name="thrL"))
    hits = scan.numbered(annotate.annotate(scan.scan(own), table))
    assert tuples(select.display_hits(hits, "coding"), "codon") == [("TAG",)]
    assert select.filter_hits(hits, gene="THR").count() > 0 and select.filter_hits(hits, codon="TAA", strand="-").count() == hits.where("codon='TAA' and strand='-'").count()
    starts = [s for (s,) in tuples(select.sort_hits(hits, "start", descending=True, limit=5), "start")]
    assert starts == sorted(starts, reverse=True) and len(starts) <= 5
    assert tuples(select.gene_lanes(hits, table, own), "lane", "codon") == [("+1", "TAG")]


def test_sequences_and_proteins(spark):
    own = records(spark, ("a", "ATGAAATAACCC", True))
    table = features(spark, feature(1, "a", "CDS", "+", (10, 12), (1, 3), ordered=[(10, 12), (1, 3)]), feature(2, "a", "CDS", "-", (1, 6)), feature(3, "a", "CDS", "+", (1, 9), name="x", product="thing"))
    assert dict(tuples(extract.coding_sequences(table, own), "feat_idx", "coding_seq")) == {1: "CCCATG", 2: "TTTCAT", 3: "ATGAAATAA"}
    assert dict(tuples(extract.coding_sequences(table, own, chunk=4), "feat_idx", "coding_seq")) == {1: "CCCATG", 2: "TTTCAT", 3: "ATGAAATAA"}  # over many chunks
    assert dict(tuples(extract.proteins(table, own), "feat_idx", "protein")) == {1: "PM", 2: "FH", 3: "MK"}


def test_wide_features_have_few_rows(spark):
    """A segment has two rows of bins at most, whatever its length, and stops inside and at its edges find it."""
    widths = [1, 3, 4094, 4095, 5000, 262_142, 262_143, 300_000, 16_777_214, 20_000_000]
    rows = [feature(k, "a", "gene", "+", (start, start + w - 1)) for k, (w, start) in enumerate((w, s) for w in widths for s in (1, 4090, 1_000_003))]
    bins = annotate.segment_bins(features(spark, *rows)).groupBy("feat_idx").count().collect()
    assert len(bins) == len(rows) and max(r["count"] for r in bins) == 2
    assert annotate.levels_of(features(spark, *rows)) == 4 and annotate.levels_of(features(spark, rows[0])) == 1 and annotate.levels_of(features(spark, rows[0]).limit(0)) == 1


def test_wide_features_as_by_brute_force(spark):
    import random

    r = random.Random(7)
    spots = sorted(r.sample(range(1, 600_000), 150)) + [4094, 4095, 4096, 8190, 262_143, 262_144]
    hits = spark.createDataFrame([(0, "a", s, s + 2, "+", (s - 1) % 3 + 1, "TAA", "ochre", False, s - 1) for s in sorted(set(spots))], HITS)
    table = []
    for k in range(60):
        a = r.randint(1, 500_000)
        table.append((k, a, a + r.choice([2, 50, 4000, 9000, 70_000, 280_000])))
    table += [(60, 4097, 8000), (61, 100, 4094), (62, 262_145, 262_200), (63, 1, 600_000)]
    rows = [feature(k, "a", "gene", "+", (a, b)) for k, a, b in table]
    for own in (rows, [x for x, (_, a, b) in zip(rows, table) if b - a < 4000]):  # four levels, and one
        known = [t for t, x in zip(table, rows) if x in own]
        expected = {}
        for s in set(spots):
            inside = [(b - a, a, k) for k, a, b in known if b >= s and a <= s + 2]
            expected[s] = f"f{min(inside)[2]}" if inside else None
        found = {x["start"]: x["feature_id"] for x in annotate.annotate(hits, features(spark, *own)).collect()}
        assert found == expected


def test_the_greatest_overlapping_segment_counts(spark):
    """Between features of one length, that whose overlapping segment starts first; of a feature's own segments, the greatest."""
    hits = spark.createDataFrame([(0, "a", 10, 12, "+", 1, "TAA", "ochre", False, 9)], HITS)
    rows = [feature(1, "a", "gene", "+", (1, 11), (11, 40)), feature(2, "a", "gene", "+", (5, 44))]
    got = annotate.annotate(hits, features(spark, *rows)).first()
    assert got["feature_id"] == "f2"
    got = annotate.annotate(hits, features(spark, rows[0], feature(3, "a", "gene", "+", (11, 50)))).first()
    assert got["feature_id"] == "f1"
