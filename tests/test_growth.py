"""What must not grow with the input: rows made for a scan, a task's share of marks, what a planted codon or a protein costs."""

import re
import time
import unicodedata
from pathlib import Path

import pytest
from helpers import feature, features, records, tuples
from pyspark.sql import functions as F

from ochre.functions import letters
from ochre.functions.sequence import normalized, reversed_codon
from ochre.operators import aggregate, annotate, extract, orf, scan
from ochre.plans import samples, tables
from ochre.plans.staged import staged
from ochre.sinks import delimited
from ochre.sources import gff3
from ochre.sources.dispatch import load


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_letters_of_all_characters(spark):
    """Python's letters of a text are those of Spark's own functions."""
    chars = [chr(k) for k in range(0x30000) if not 0xD800 <= k < 0xE000 and unicodedata.category(chr(k)) != "Cn"]
    texts = ["".join(f"{c}u{c}eJ." for c in chars[k : k + 64]) for k in range(0, len(chars), 64)] + ["", "ßéu-.x", "plain u", "ﬁ ŉ ſı", None]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    for fold in ((), (tables.FOLDED, tables.BASES)):
        expected = [r["s"] for r in rows.select(normalized(F.col("text"), *fold).alias("s")).collect()]
        assert [letters.letters_of(None if t is None else t.encode(), letters.reading(*fold)).decode() for t in texts] == expected
    assert letters.letters_of(b"A\xffc", letters.reading()) == b"AC"


def brute(seq, circular, among, strands):
    n = len(seq)
    places = [(k, seq[k : k + 3], False) for k in range(n - 2)] + ([(n - 2 + k, ((seq + seq)[n - 2 + k : n + 1 + k]), True) for k in (0, 1)] if circular and n >= 3 else [])
    for at, codon, wraps in places:
        for strand in strands:
            own = codon if strand == "+" else reversed_codon(codon)
            if own in among:
                yield strand, at if strand == "+" else (n - 3 - at) % n, own, wraps


@pytest.mark.parametrize("strands", [("+", "-"), ("+",), ("-",)])
def test_scan_makes_rows_for_hits_alone(spark, monkeypatch, strands):
    monkeypatch.setattr(letters, "FLUSH", 5)
    seqs = [("a", "TAATTATGATCATAGNNTAR" * 3, True), ("b", "", True), ("c", "TA", True), ("d", "AAT", True), ("e", "CTATTAnTAA?TAG", False), ("f", "TGA", False)]
    own = records(spark, *seqs)
    among = ["TAA", "TAG", "TAR", "TGA", "TTA"]
    for chunk in (1 << 20, 4):
        found = scan.codon_windows(own, among, chunk, origin=True, strands=strands)
        assert sorted(tuples(found, "seq_id", "strand", "rpos", "codon", "wraps")) == sorted((i, *r) for i, s, c in seqs for r in brute(s, c, among, strands))
    assert "Generate" not in plan(found)
    assert scan.codon_windows(own, []).count() == 0


def test_marks_are_dealt_by_bases(spark, monkeypatch):
    """A partition of marks stands for so many bases, however many there are."""
    monkeypatch.setattr(orf, "PART", 50)
    own = records(spark, *[(f"r{k}", "ATGAAACCCTAA" * 10, False) for k in range(5)])
    found = orf.predict_orfs(own, scan.scan(own), min_len_nt=9)
    assert "RepartitionByExpression" in plan(found) and ", 12" in plan(found)
    assert found.where("strand = '+'").count() == 50


def test_many_planted_codons(spark):
    """A third of a record planted, overlapping and over the ends of chunks, in time that doesn't grow with its length."""
    n = 300_000
    planted = [(k, "TAA" if k % 2 else "GGGG") for k in range(0, n - 3, 3)] + [(samples.CHUNK - 2, "CCCC"), (n - 2, "AAA"), (5, "")]
    expected = ["G"] * n
    for at, codon in planted:
        if at + len(codon) <= n:
            expected[at : at + len(codon)] = codon
    specs = spark.createDataFrame([(0, "a", 1, n, True, planted)], "seq_idx long, seq_id string, seed long, length int, circular boolean, planted array<struct<at:int,codon:string>>")
    began = time.time()
    seq = bytes(samples.sample_records(specs).first()["seq"]).decode()
    assert time.time() - began < 30  # minutes, when every codon meant a copy of the record
    assert len(seq) == n and seq[: n - 3] == "".join(expected)[: n - 3]


def test_protein_is_worked_out_once(spark):
    rows = spark.createDataFrame([("ATGTGATAA", 4, None), ("AATGTGATAA", 11, 1), ("atgnnn", 99, 3), ("", 1, 0), (None, None, None), ("AT", 1, 2)], "s string, t int, p int")
    made = rows.withColumn("protein", extract.translated(F.col("s"), F.col("t"), F.col("p")))
    assert [r["protein"] for r in made.collect()] == ["MW", "M*", "MX", "", "", ""]
    assert plan(made.where("protein <> ''").select(F.concat("protein", F.lit("."), "protein"))).count("proteins_of") == 1



def test_annotation_of_some_hits_by_a_known_width(spark, monkeypatch):
    """With a known width features aren't worked out for it, and some hits get what they get among all."""
    own = records(spark, ("a", "ATGTAAAAATAGCCCTGATAA", False))
    hits = scan.scan(own)
    genes = features(spark, feature(0, "a", "CDS", "+", (1, 12)), feature(1, "a", "gene", "+", (10, 21)))
    columns = ("seq_id", "strand", "rpos", "context", "feature_id", "in_frame", "terminator_feature_ids")
    expected = sorted(map(str, tuples(annotate.annotate(hits, genes).where("codon = 'TAA'"), *columns)))
    monkeypatch.setattr(type(genes), "first", lambda df: pytest.fail("an action"))
    found = annotate.annotate(hits.where("codon = 'TAA'"), genes, plain=hits, widest=12)
    assert sorted(map(str, tuples(found, *columns))) == expected and len(expected) > 1


def test_terminators_alone(spark):
    """What ends features is known without the join of all stops with all features, over an origin and without an id too."""
    own = records(spark, ("a", "AATGAAATAGTAATT", True), ("b", "TTAATGTAACTATTA", False))
    hits = scan.scan(own)
    row = lambda k, s, sign, *spans, **more: feature(k, s, "ORF" if k % 3 == 2 else "CDS", sign, *spans, **more)
    spans = [((a, b),) for a in range(1, 14, 2) for b in range(a + 2, 16)] + [((1, 1), (13, 15)), ((1, 2), (14, 15)), ((2, 4), (9, 12))]
    table = features(spark, *[row(k, s, sign, *span, id=None if k % 5 == 0 else f"f{k % 40}") for k, (s, sign, span) in enumerate((s, sign, span) for s in "ab" for sign in "+-" for span in spans)])
    columns = [*hits.columns, *annotate.ADDED]
    for many in (None, 1 << 13):
        expected = [r for r in map(str, annotate.annotate(hits, table, widest=many).where("context IN ('cds-terminator', 'orf-terminator')").select(*columns).collect())]
        assert sorted(map(str, annotate.ending(hits, table).select(*columns).collect())) == sorted(expected) and len(expected) > 3
    assert annotate.annotate(hits, table).count() == hits.count()
    assert "_from" not in plan(annotate.ending(hits, table)) and "_from" in plan(annotate.annotate(hits, table))


def test_stops_are_shuffled_once(spark):
    """Claims and the features' join use one shuffle of the stops, and genes one annotation."""
    own = records(spark, ("a", "ATGTAAAAATAGCCCTGATAA", False))
    genes = features(spark, feature(0, "a", "CDS", "+", (1, 12)), feature(1, "a", "gene", "+", (10, 21)))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = annotate.annotate(scan.scan(own), genes, widest=12)
        assert "ReusedExchange" in found._jdf.queryExecution().executedPlan().toString()
        assert plan(aggregate.gene_summary(found, genes)).count("MapInArrow") == plan(found).count("MapInArrow")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_features_are_made_once(spark):
    """Claims and the join with all features use one shuffle of the features too, a row a feature and bin."""
    own = records(spark, ("a", "ATGTAAAAATAGCCCTGATAA", False))
    genes = features(spark, feature(0, "a", "CDS", "+", (1, 4), (7, 9), (11, 12)), feature(1, "a", "gene", "+", (10, 21)))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = annotate.annotate(scan.scan(own), genes, widest=12)
        assert found._jdf.queryExecution().executedPlan().toString().count("ReusedExchange") == 2
        assert annotate._binned(features(spark, feature(0, "a", "CDS", "+", (300, 304), (307, 309), (311, 312))), 11, True).count() == 1
        contexts = annotate.annotate(scan.scan(own), genes, widest=12, named=False)
        assert sorted(tuples(contexts, "rpos", "strand", "context", "in_frame")) == sorted(tuples(found, "rpos", "strand", "context", "in_frame"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_first_of_an_id_is_credited(spark):
    """Of several CDS of one id the first has the stops; those without an id have none, however many they are."""
    own = records(spark, ("a", "ATGTAAAAATAG", False))
    genes = features(spark, feature(2, "a", "CDS", "+", (1, 12), id="x"), feature(1, "a", "CDS", "+", (1, 12), id="x"), *[feature(k, "a", "CDS", "-", (1, 9), id=None) for k in (3, 4)], feature(5, "a", "CDS", "-", (1, 9), id="#3"))
    found = aggregate.gene_summary(annotate.annotate(scan.scan(own), genes), genes)
    assert sorted(tuples(found, "feat_idx", "feature_id", "internal_stops", "terminator_codon")) == [(1, "x", 1, "TAG"), (2, "x", 0, None), (3, None, 0, None), (4, None, 0, None), (5, "#3", 0, None)]


def test_cells_are_quoted_without_patterns(spark):
    rows = spark.createDataFrame([(t,) for t in ('a"b', "a,b", "a\nb", "a\rb", "ab", "", None)], "t string").select(delimited.csv_cell(F.col("t")).alias("c"))
    assert [r["c"] for r in rows.collect()] == ['"a""b"', '"a,b"', '"a\nb"', '"a\rb"', "ab", "", ""]
    assert "RLIKE" not in plan(rows).upper()


def executed(spark, df):
    """The physical plan with shuffles where joins and groups need them, however small the tables."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        return df()._jdf.queryExecution().executedPlan().toString()
    finally:
        for k in conf:
            spark.conf.unset(k)


def test_gff3_features_stay_with_their_file(spark):
    """Texts are shuffled once by file; rows, features and names aren't, nor is a table of features kept on disk."""
    row = lambda kind, k, more: f"c{k % 2}\tx\t{kind}\t{k}\t{k + 9}\t.\t{'+-'[k % 2]}\t.\t{more}"
    one = [row("gene", 1, "ID=g;Name=n"), row("mRNA", 2, "ID=r;Parent=g"), row("CDS", 3, "ID=k;Parent=r"), row("CDS", 5, "ID=k;Parent=r"), row("tRNA", 4, "Parent=k"), row("tRNA", 4, "Parent=k"), row("rRNA", 6, "ID=z;Parent=late"), row("gene", 7, "ID=late;locus_tag=L=1"), row("gene", 8, "")]
    files = spark.createDataFrame([(k, "\n".join(one[k % 3 :])) for k in range(20)], "file_no int, text string")
    plan = executed(spark, lambda: gff3.features_of(gff3.rows_of(gff3.by_file(files))))
    assert plan.count("Exchange") == plan.count("Exchange hashpartitioning(file_no") == 1 and "InMemory" not in plan
    found = sorted(map(str, gff3.features_of(gff3.rows_of(gff3.by_file(files))).collect()))
    assert found == sorted(map(str, gff3.features_of(gff3.rows_of(files)).collect())) and len(found) == 7 * 7 + 7 * 6 + 6 * 5
    names = {r["id"] or r["type"]: (r["name"], r["locus_tag"]) for r in gff3.features_of(gff3.rows_of(files)).where("file_no = 0").collect()}
    assert names == {"g": ("n", None), "r": ("n", None), "k": ("n", None), "tRNA": ("n", None), "z": (None, "L=1"), "late": (None, "L=1"), "gene": (None, None)}


def test_gff3_lines_stay_with_their_file(spark):
    """Texts are written out in small compressed files, all of them, and lines are shuffled once, by file."""
    row = lambda k, more: f"c\tx\tgene\t{k}\t{k + 9}\t.\t+\t.\t{more}"
    texts = ["\n".join([f"##gff-version 3 {'x' * 5000}", row(1, f"ID=g{k};Name=n"), row(2, f"ID=r{k};Parent=g{k}"), row(3, f"ID=c{k};Parent=r{k}")]) for k in range(35)]
    path = staged(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(2), "few", packed=4)
    files = list(Path(path.removeprefix("file:")).glob("part-*.gz"))
    assert len(files) >= 9 and sum(f.stat().st_size for f in files) < 0.1 * sum(map(len, texts))
    lines = gff3.read_lines(spark, path)
    assert lines.count() == 4 * 35 and lines.select("file_no").distinct().count() == len(files)
    plan = executed(spark, lambda: gff3.features_of(gff3.feature_lines(lines, whole=True)))
    assert plan.count("REPARTITION_BY_NUM") == 1 and "InMemoryTableScan" not in plan and "hashpartitioning(file_no, id" not in (short := re.sub(r"#\d+L?", "", plan)) and "hashpartitioning(file_no, _" not in short
    found = sorted(map(str, gff3.features_of(gff3.feature_lines(lines, whole=True)).collect()))
    assert found == sorted(map(str, gff3.features_of(gff3.feature_lines(lines)).collect())) and len(found) == 3 * 35 and all("name='n'" in f for f in found)


def test_loading_keeps_neither_lines_nor_features(spark):
    """What load keeps is the records and a row an annotated id; features of texts that lie by file are shuffled once, to tell doubles."""
    row = lambda s, k, more: f"{s}\tx\tgene\t{k}\t{k + 9}\t.\t+\t.\t{more}"
    note = lambda s: "\n".join(["##gff-version 3", row(s, 1, f"ID=g{s};Name=n"), row(s, 1, f"ID=h{s}"), row(s, 2, f"ID=r{s};Parent=g{s}"), f"{s}\tx\tCDS\tz\t9\t.\t+\t0\tID=bad"])
    files = spark.createDataFrame([(k, str(k), note(f"s{k // 2}") if k % 2 else f">s{k // 2}\nACGT") for k in range(14) if k != 4], "file_no int, name string, text string")
    loaded = load(gff3.by_file(files).persist())
    assert sorted(tuples(loaded.features, "seq_id", "start", "name")) == sorted((f"s{k}", at, "n") for k in range(7) if k != 2 for at in (1, 2))
    assert loaded.warnings[-1] == "2 feature(s) left out, as their 1 id(s) have no sequence: s2." and sum("lacks a number" in w for w in loaded.warnings) == 5 and any(w.startswith("2 further notes") for w in loaded.warnings)
    kept = executed(spark, lambda: loaded.features.groupBy("seq_id").count())
    assert "attributes" not in kept[kept.index("InMemoryRelation") :] and re.sub(r"#\d+L?", "", kept).count("Exchange hashpartitioning(file_no, id") == 0
