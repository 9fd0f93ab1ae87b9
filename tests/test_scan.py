import random

from helpers import records, tuples, value
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ochre.functions import sequence
from ochre.operators import orf, scan
from ochre.plans import samples

COMPLEMENT = dict(zip("ACGTRYKMBVDHNSW", "TGCAYRMKVBHDNSW"))
STOPS = {"TAA": "ochre", "TAG": "amber", "TGA": "opal", "TAR": "stop", "TRA": "stop"}


def brute(rows):
    out = set()
    for name, s, circular in rows:
        n = len(s)
        for strand, reading in (("+", s), ("-", "".join(COMPLEMENT.get(c, c) for c in reversed(s)))):
            for p in range(n if circular and n >= 3 else n - 2):
                codon = (reading + reading)[p : p + 3]
                if codon in STOPS and len(codon) == 3:
                    start = n - 2 - p if strand == "-" else p + 1
                    wraps = p > n - 3
                    end = start + 2
                    if wraps:
                        start, end = (start - 1) % n + 1, (end - 1) % n + 1
                    out.add((name, start, end, strand, p % 3 + 1, codon, STOPS[codon], wraps, p))
    return out


COLUMNS = ("seq_id", "start", "end", "strand", "frame", "codon", "name", "wraps", "rpos")


def test_worked_example(spark):
    hits = scan.scan(records(spark, ("a", "CCCTTAGGG", False)))
    assert sorted(tuples(hits, "codon", "start", "end", "strand", "frame")) == [("TAA", 4, 6, "-", 1), ("TAG", 5, 7, "+", 2)]


def test_against_brute_force(spark):
    r = random.Random(1)
    rows = [(f"s{k}", "".join(r.choice("ACGTACGTACGTRYNEX") for _ in range(n)), k % 2 == 0) for k, n in enumerate([0, 1, 2, 3, 4, 5, 7, 50, 333])]
    assert set(tuples(scan.scan(records(spark, *rows)), *COLUMNS)) == brute(rows)


def test_chunks_make_no_difference(spark):
    r = random.Random(2)
    own = records(spark, ("a", "".join(r.choice("ACGT") for _ in range(500)), False))
    whole, cut = (sorted(tuples(scan.codon_windows(own, ["TAA", "TAG"], chunk), "strand", "rpos", "codon")) for chunk in (1 << 20, 7))
    assert whole == cut


@settings(max_examples=5, deadline=None)
@given(st.text("ACGT", min_size=3, max_size=40))
def test_strands_mirror(spark, s):
    turned = "".join(COMPLEMENT[c] for c in reversed(s))
    hits = scan.scan(records(spark, ("a", s, False), ("b", turned, False)))
    rows = tuples(hits, "seq_id", "strand", "rpos", "codon")
    assert {(t, p, c) for n, t, p, c in rows if n == "a"} == {("+" if t == "-" else "-", p, c) for n, t, p, c in rows if n == "b"}


def test_codes_without_stops_and_empty_tables(spark):
    assert scan.scan(records(spark, ("a", "TAATAGTGA", False)), 28).count() == 0
    assert scan.scan(records(spark)).count() == 0
    assert scan.scan_totals(records(spark, ("a", "TA", False))).first()["sequence_count"] == 1


def test_numbers_follow_scan_order(spark):
    r = random.Random(3)
    rows = [(f"s{k}", "".join(r.choice("ACGT") for _ in range(120)), k == 1) for k in range(3)]
    hits = scan.numbered(scan.scan(records(spark, *rows))).collect()
    order = sorted(hits, key=lambda h: (h["wraps"], h["seq_idx"], h["strand"] == "-", h["frame"], h["rpos"]))
    assert [h["hit_no"] for h in order] == list(range(1, len(hits) + 1))
    assert order[0]["id"] == "stop_0001"


def test_normalization(spark):
    assert value(spark, sequence.normalized(F.lit("aug uaa-12ß"))) == "ATGTAASS"
    stats = value(spark, sequence.normalization_stats(F.lit("auguaa-.Ern")))
    assert stats.asDict() == {"lowercase": 8, "u_converted": 2, "gaps": 2, "unexpected": 1, "ambiguous": 2}
    assert value(spark, sequence.normalization_note(F.struct(*[F.lit(0).alias(c) for c in ("lowercase", "u_converted", "gaps", "unexpected")]))) is None
    assert value(spark, sequence.wrapped_lines(F.lit("ABCDEFG"), 3)) == "ABC\nDEF\nG"


def brute_orfs(s, require, least):
    out = []
    for strand, reading in (("+", s), ("-", "".join(COMPLEMENT[c] for c in reversed(s)))):
        for frame in range(3):
            begin = frame
            for p in range(frame, len(s) - 2, 3):
                if reading[p : p + 3] in ("TAA", "TAG", "TGA"):
                    opened = next((q for q in range(begin, p, 3) if reading[q : q + 3] == "ATG"), None) if require else begin
                    if opened is not None and p + 3 - opened >= least:
                        out.append((strand, opened + 1 if strand == "+" else len(s) - p - 2, p + 3 if strand == "+" else len(s) - opened))
                    begin = p + 3
    return sorted(out)


def test_orfs(spark):
    r = random.Random(4)
    s = "".join(r.choice("ACGT") for _ in range(900))
    own = records(spark, ("a|b", s, True))
    hits = scan.scan(own)
    for require in (True, False):
        found = orf.predict_orfs(own, hits, min_len_nt=30, require_start=require)
        assert sorted(tuples(found, "strand", "start", "end")) == brute_orfs(s, require, 30)
        whole = sorted(tuples(found, "feat_idx", "id", "strand", "start", "end"))
        for chunk in (7, 60, 400):  # frames in many chunks give the same, numbers too
            parts = orf.predict_orfs(own, hits, min_len_nt=30, require_start=require, chunk=chunk)
            assert sorted(tuples(parts, "feat_idx", "id", "strand", "start", "end")) == whole
        ids = [i for (i,) in tuples(found, "id")]
        assert len(set(ids)) == len(ids) and all(i.startswith("ORF_a|b_") for i in ids)


def test_numbers_by_chunks(spark):
    r = random.Random(6)
    own = records(spark, *[(f"r{k}", "".join(r.choice("ACGT") for _ in range(n)), k % 2 == 0) for k, n in enumerate((300, 5, 900))])
    hits = scan.scan(own)
    whole = sorted(tuples(scan.numbered(hits), "hit_no", "id", "seq_id", "strand", "frame", "rpos"))
    assert [x[0] for x in whole] == list(range(1, len(whole) + 1))
    for chunk in (10, 100):
        assert sorted(tuples(scan.numbered(hits, chunk=chunk), "hit_no", "id", "seq_id", "strand", "frame", "rpos")) == whole


def test_largest_task_of_a_long_frame(spark):
    """A frame of many stops is dealt to many groups, none with more than its chunk holds."""
    rows = spark.range(200_000).select(F.lit(0).cast("long").alias("seq_idx"), F.lit("a").alias("seq_id"), F.lit("+").alias("strand"), F.lit(1).alias("frame"), (F.col("id") * 3).cast("int").alias("rpos"), F.lit(None).cast("int").alias("start_at"), F.lit(True).alias("is_stop"))
    regions = orf._regions(rows, 30_000)
    assert regions.where("stop_at IS NOT NULL").count() == 200_000 and regions.where("stop_at = stop_before + 3").count() == 199_999
    plan = regions._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("_chunk" in line for line in windows)


def test_samples(spark):
    """Against the generator written out in Python; any chunk size gives the same."""

    def brute(seed, n):
        out, mask = "", 0xFFFFFFFF
        for k in range(n):
            a = (seed + (k + 1) * 0x6D2B79F5) & mask
            t = (a ^ a >> 15) * (a | 1) & mask
            t = (t + ((t ^ t >> 7) * (t | 61) & mask) & mask) ^ t
            out += "ACGT"[(t ^ t >> 14) >> 30]
        return out

    specs = spark.createDataFrame([(0, "a", 20260709, 500, True, [(3, "TAA"), (498, "TAG"), (-1, "TGA")]), (1, "b", -5, 70, None, None), (2, "c", None, 0, False, []), (3, "d", 1 << 40, None, False, [])], "seq_idx long, seq_id string, seed long, length int, circular boolean, planted array<struct<at:int,codon:string>>")
    expected = {"a": brute(20260709, 500), "b": brute(-5, 70), "c": "", "d": ""}
    expected["a"] = expected["a"][:3] + "TAA" + expected["a"][6:]
    before = samples.CHUNK
    try:
        for samples.CHUNK in (before, 64):
            rows = {r["seq_id"]: r for r in samples.sample_records(specs).collect()}
            assert {k: bytes(r["seq"]).decode() for k, r in rows.items()} == expected and rows["a"]["circular"] and not rows["b"]["circular"]
    finally:
        samples.CHUNK = before
