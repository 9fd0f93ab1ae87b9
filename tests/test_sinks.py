import io
import json
import xml.dom.minidom
import zipfile

import pytest

from helpers import feature, features, records, value
from pyspark.sql import functions as F

from ochre.operators import aggregate, annotate, scan, select
from ochre.sinks import figures, delimited, documents, fasta, tracks

STOPS = ["TAA", "TAG", "TGA"]


def analysed(spark, circular=False):
    own = records(spark, ("a", "ATGTAACCCTAGTGACC", circular))
    table = features(spark, feature(1, "a", "CDS", "+", (1, 12), name='q"x, y', product="p"))
    return own, table, scan.numbered(annotate.annotate(scan.scan(own), table))


def test_csv_and_tsv(spark, tmp_path):
    _, _, hits = analysed(spark)
    text = delimited.text_of(delimited.hit_lines(hits, "csv", annotated=True), "csv")
    lines = text.split("\r\n")
    assert lines[0].startswith("stop_id,seq_id,start") and '"q""x, y"' in text and not text.endswith("\r\n") and len(lines) == hits.count() + 1
    assert delimited.text_of(delimited.hit_lines(hits, "tsv"), "tsv").endswith("\n")
    assert delimited.text_of(delimited.hit_lines(hits, "md"), "md").split("\n")[1] == "| " + " | ".join(["---"] * 8) + " |"
    delimited.write_text(delimited.hit_lines(hits, "csv", annotated=True), "csv", str(tmp_path / "h.csv"))
    assert (tmp_path / "h.csv").read_bytes().decode() == text
    delimited.write_parts(delimited.hit_lines(hits, "csv"), str(tmp_path / "parts"))
    assert spark.read.text(str(tmp_path / "parts")).count() == hits.count() + 1


def test_escapes(spark):
    assert value(spark, delimited.md_cell(F.lit("a|b\nc"))) == "a\\|b c" and value(spark, delimited.tsv_cell(F.lit("a\tb"))) == "a b"
    assert value(spark, tracks.escaped(F.lit("100%;a=b&c,d\t"))) == "100%25%3Ba%3Db%26c%2Cd%09"


def test_tracks(spark):
    own, _, hits = analysed(spark, circular=True)
    gff = delimited.text_of(tracks.gff3_lines(hits, own), "text")
    assert gff.startswith("##gff-version 3\n##sequence-region a 1 17\n") and "Is_circular=true" in gff and "\tstop_codon\t" in gff
    crossing = hits.where("wraps").count()
    assert (f"# {crossing} stops over the origin" in gff) == (crossing > 0)
    bed = delimited.text_of(tracks.bed_lines(hits, STOPS, bed9=True), "text").split("\n")
    assert bed[0].startswith("track ") and "\t3\t6\t" in "\n".join(bed) and tracks.bed_palette()[0] in "\n".join(bed)
    assert tracks.bed_palette("no such scheme") == tracks.bed_palette()


def test_fasta(spark):
    own, table, _ = analysed(spark)
    assert fasta.fna_rows(table, own, width=6).first()["line"] == '>q"x, y a:1-12(+) type=CDS gene=q"x, y p\nATGTAA\nCCCTAG'
    assert fasta.faa_rows(table, own).first()["line"].endswith("table=11\nM*P")


def test_documents(spark, monkeypatch):
    own, table, hits = analysed(spark)
    one = aggregate.summary(hits, own, STOPS).first().asDict()
    frames, genes = aggregate.frame_breakdown(hits, STOPS), aggregate.gene_summary(hits, table)
    doc = json.loads(documents.to_json(one, hits, genes, frames, STOPS))
    assert len(doc["hits"]) == one["total_stops"] and doc["frame_breakdown"]["stops"] == STOPS and doc["gene_summary"][0]["terminator_codon"] == "TAG"
    book = zipfile.ZipFile(io.BytesIO(documents.to_xlsx(one, hits, frames, STOPS, genes, annotated=True)))
    assert book.testzip() is None
    for name in book.namelist():
        xml.dom.minidom.parseString(book.read(name))
    assert b"Per-gene" in book.read("xl/workbook.xml")
    text = documents.to_text(one, frames, STOPS, select.flagged_genes(genes), n_flagged=genes.where("internal_stops > 0").count() + 3)
    assert "\r\n" in text and "TAA (ochre)" in text and "[Reading frames]" in text and "... and  3 more" in text
    page = documents.to_html(one, hits, frames, STOPS, genes, annotated=True, max_rows=1)
    assert "<svg" in page and "The first 1 of" in page and "q&quot;x, y" in page
    monkeypatch.setattr(documents, "MOST_ROWS", 1)
    for make in (lambda: documents.to_json(one, hits), lambda: documents.to_xlsx(one, hits, frames, STOPS)):
        with pytest.raises(ValueError, match="too many"):
            make()
    assert documents.column_name(27) == "AB" and documents.file_name("my file.fa", "csv") == "my_file.csv"


def test_stream(spark, tmp_path):
    from ochre.streaming.scan import scan_stream

    spark.createDataFrame([(0, "a", "CCCTTAGGG")], "seq_idx long, seq_id string, text string").write.parquet(str(tmp_path / "in"))
    texts = spark.readStream.schema("seq_idx long, seq_id string, text string").parquet(str(tmp_path / "in"))
    query = scan_stream(texts, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    query.processAllAvailable()
    query.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_axes(spark):
    from ochre.sinks.axes import bases_label, nice_step

    assert [nice_step(s, 10) for s in (10, 17, 48502, 90)] == [1, 2, 5000, 10] and [bases_label(n) for n in (12, 1500, 2000, 1250000)] == ["12 bp", "1.5 kb", "2 kb", "1.25 Mb"]
    own, table, _ = analysed(spark, circular=True)
    row = select.feature_angles(table, own).first()
    assert row["from_angle"] == 0 and abs(row["to_angle"] - 11 / 17 * 360) < 1e-9


def test_charts_keep_to_their_caps(spark):
    """Records beyond the cap on ticks are skipped whole; of genes the first are drawn."""
    own, table, hits = analysed(spark)
    n = hits.where("seq_id = 'a'").count() if "seq_id" in hits.columns else 0
    for limit, kept in ((n, n), (n - 1, 0)):
        assert select.frame_track(hits, limit).where("seq_id = 'a'").count() == kept
    notes = {r["seq_id"]: r for r in select.chart_notes(hits, table, ticks=0, genes=0).collect()}
    assert all(not r["ticks_drawn"] and r["genes_drawn"] == 0 and "more than the 0" in r["note"] for r in notes.values())
    assert all(r["note"] == "" and r["ticks_drawn"] for r in select.chart_notes(hits, table).collect())
    lanes = select.gene_lanes(hits, table, own)
    total, starts = lanes.count(), sorted(r["start"] for r in lanes.collect())
    for limit in range(total + 1):
        assert sorted(r["start"] for r in select.first_genes(lanes, limit).collect()) == starts[:limit]


def test_figures(spark, monkeypatch):
    own, table, hits = analysed(spark, circular=True)
    pieces = figures.circular_pieces(hits, table, own, STOPS)
    page = figures.documents(pieces, figures.SIDE, figures.SIDE).first()["svg"]
    xml.dom.minidom.parseString(page)
    assert page.count("<line") == hits.count() and page.count("<circle") == 1 and page.count("<path") == table.where("type IN ('CDS', 'gene')").count()
    for made in (figures.track_pieces(hits, own, STOPS), figures.gene_map_pieces(select.gene_lanes(hits, table, own), own, STOPS), figures.density_pieces(aggregate.density_bins(hits, own))):
        xml.dom.minidom.parseString(figures.documents(made, figures.WIDTH, 300).first()["svg"])
    monkeypatch.setattr(select, "MAX_TICKS", 0)
    assert figures.circular_pieces(hits, table, own, STOPS).where("layer = 2").count() == 0
    value_of = lambda x: spark.range(1).select(figures.hundredths(F.lit(x)).alias("v")).first()["v"]
    assert [value_of(x) for x in (0.0, 1.005, -0.004, -1.5, 12.3456, -0.01)] == ["0.00", "1.00", "0.00", "-1.50", "12.35", "-0.01"]


def test_json_in_parts(spark):
    own, table, hits = analysed(spark)
    one, frames, genes = aggregate.summary(hits, own, STOPS), aggregate.frame_breakdown(hits, STOPS), aggregate.gene_summary(hits, table)
    parts = {}
    for r in documents.json_parts(one, hits, genes, frames).orderBy("part", "ord").collect():
        parts.setdefault(r["part"], []).append(json.loads(r["json"]))
    whole = json.loads(documents.to_json(one.first().asDict(), hits, genes, frames, STOPS))
    assert parts["hits"] == whole["hits"] and parts["gene_summary"] == whole["gene_summary"] and [r["frame"] for r in parts["frame_breakdown"]] == whole["frame_breakdown"]["frame_order"]
    assert parts["summary"][0]["total_stops"] == whole["summary"]["total_stops"]


def test_workbooks_stream(spark, tmp_path):
    """Rows made by executors are those made from values, and go straight into a file."""
    own, table, hits = analysed(spark)
    cells = documents.hit_cells(annotated=True)
    rows = [r["xml"] for r in documents.sheet_rows(hits, cells, F.col("hit_no")).orderBy("row").collect()]
    values = documents._rows(hits, cells, "hit_no")
    assert rows == [f'<row r="{k}">' + "".join(documents._cell(k, c, v, False) for c, v in enumerate(row)) + "</row>" for k, row in enumerate(values, 2)]
    one, frames = aggregate.summary(hits, own, STOPS).first().asDict(), aggregate.frame_breakdown(hits, STOPS)
    with open(tmp_path / "book.xlsx", "wb") as file:
        assert documents.to_xlsx(one, hits, frames, STOPS, annotated=True, file=file) == b""
    book = zipfile.ZipFile(tmp_path / "book.xlsx")
    assert book.testzip() is None and book.read("xl/worksheets/sheet2.xml").decode().count("<row ") == len(rows) + 1
