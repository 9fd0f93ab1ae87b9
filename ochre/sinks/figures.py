"""Figures as pieces of SVG, a row each, made where the data are.

A circular plot and a gene map are pieces with an order; ``documents`` puts those of a
record together.  Records with more stops than ``select.MAX_TICKS`` are skipped with a note,
and of a record's genes the first ``select.MAX_GENES`` are drawn, so a document is bounded.
Coordinates are rounded to hundredths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import signed_frame
from ..operators import select
from ..schema import CODING, FRAMES

#: Sizes of the circular plot: its side, the ring's and the genes' radius, and the genes' width.
SIDE, RING, GENES, GENE_WIDTH = 520, 220, 206, 9
#: Sizes of the gene map: width, lane, gap, and margins above and at both sides.
WIDTH, LANE, GAP, TOP, LEFT, RIGHT = 900, 24, 7, 42, 54, 20


def hundredths(x: Column) -> Column:
    """A number with two decimals, as text."""
    cents = F.floor(x * 100 + 0.5)
    size = F.abs(cents)
    return F.concat(F.when(cents < 0, "-").otherwise(""), F.floor(size / 100).cast("string"), F.lit("."), F.lpad((size % 100).cast("string"), 2, "0"))


def _polar(radius, degrees: Column) -> tuple[Column, Column]:
    """A point on a circle around the middle; 0 degrees is at the top, and they grow clockwise."""
    turn = F.radians(degrees - 90)
    return F.lit(SIDE / 2) + radius * F.cos(turn), F.lit(SIDE / 2) + radius * F.sin(turn)


def _tag(name: str, **values) -> Column:
    parts = [F.lit(f"<{name}")]
    for key, value in values.items():
        parts += [F.lit(f' {key.replace("_", "-")}="'), value if isinstance(value, Column) else F.lit(str(value)), F.lit('"')]
    return F.concat(*parts, F.lit("/>"))


def _colour(codon: Column, stops: list[str]) -> Column:
    return F.concat(F.lit("var(--codon-"), (select.colour_index(codon, stops) + 1).cast("string"), F.lit(")"))


def circular_pieces(hits: DataFrame, features: DataFrame, records: DataFrame, stops: list[str]) -> DataFrame:
    """``seq_id, layer, ord, piece``: ring, gene arcs and stop ticks of circular records."""
    circles = records.where("circular AND length > 0").select("seq_id", "length")
    ring = circles.select("seq_id", F.lit(0).alias("layer"), F.lit(0).cast("long").alias("ord"), _tag("circle", cx=SIDE // 2, cy=SIDE // 2, r=RING, fill="none", stroke="var(--border-strong)").alias("piece"))
    own = features.where(F.col("type").isin("gene", *CODING)).join(circles, "seq_id")
    angle = lambda place: (place - 1) / F.col("length") * 360
    begin, end = angle(F.col("start")), angle(F.col("end"))
    end = F.when(end <= begin, begin + F.greatest(F.lit(0.4), angle(F.col("end") + F.col("length")) - begin)).otherwise(end)
    minus = F.col("strand") == "-"
    radius = F.when(minus, GENES - GENE_WIDTH).otherwise(GENES)
    (ax, ay), (bx, by) = _polar(radius, begin), _polar(radius, end)
    path = F.concat_ws(" ", F.lit("M"), hundredths(ax), hundredths(ay), F.lit("A"), radius.cast("string"), radius.cast("string"), F.lit("0"), F.when(F.pmod(end - begin, F.lit(360)) > 180, "1").otherwise("0"), F.lit("1"), hundredths(bx), hundredths(by))
    arcs = own.select("seq_id", F.lit(1).alias("layer"), F.col("feat_idx").alias("ord"), _tag("path", d=path, fill="none", stroke=F.when(minus, "var(--codon-4)").otherwise("var(--accent)"), stroke_width=GENE_WIDTH).alias("piece"))
    drawn = select.within_cap(hits, select.MAX_TICKS)
    ticks = drawn.join(circles, "seq_id")
    turn = angle(F.col("start"))
    (px, py), (qx, qy) = _polar(F.when(minus, RING - 4).otherwise(RING), turn), _polar(F.when(minus, RING).otherwise(RING + 8), turn)
    lines = ticks.select("seq_id", F.lit(2).alias("layer"), (F.col("rpos").cast("long") * 2 + minus.cast("int")).alias("ord"), _tag("line", x1=hundredths(px), y1=hundredths(py), x2=hundredths(qx), y2=hundredths(qy), stroke=_colour(F.col("codon"), stops)).alias("piece"))
    return ring.unionByName(arcs).unionByName(lines)


def gene_map_pieces(lanes: DataFrame, records: DataFrame, stops: list[str]) -> DataFrame:
    """``seq_id, layer, ord, piece``: an arrow for each gene of ``select.gene_lanes``, in its frame's lane, with its stop's colour at the tip."""
    own = select.first_genes(lanes, select.MAX_GENES).join(records.where("length > 0").select("seq_id", "length"), "seq_id")
    x = lambda place: F.lit(LEFT) + (place - 1) / F.col("length") * (WIDTH - LEFT - RIGHT)
    number = F.array_position(F.array(*map(F.lit, FRAMES)), F.col("lane")) - 1
    top = F.lit(TOP) + number * (LANE + GAP)
    left, right = x(F.col("start")), x(F.col("end") + 1)
    tip = F.least(F.lit(6.0), right - left)
    minus = F.col("lane").startswith("-")
    body = _tag("rect", x=hundredths(F.when(minus, left + tip).otherwise(left)), y=top.cast("string"), width=hundredths(right - left - tip), height=LANE, fill="var(--surface)")
    points = lambda a, b: F.concat(hundredths(a), F.lit(","), top.cast("string"), F.lit(" "), hundredths(a), F.lit(","), (top + LANE).cast("string"), F.lit(" "), hundredths(b), F.lit(","), (top + LANE // 2).cast("string"))
    head = _tag("polygon", points=F.when(minus, points(left + tip, left)).otherwise(points(right - tip, right)), fill=F.when(F.col("codon").isNull(), "var(--border)").otherwise(_colour(F.col("codon"), stops)))
    return own.select("seq_id", F.lit(1).alias("layer"), F.col("feat_idx").alias("ord"), F.concat(body, head).alias("piece"))


def density_pieces(bins: DataFrame, height: int = 60) -> DataFrame:
    """``seq_id, layer, ord, piece``: bars of ``aggregate.density_bins``, plus strand up and minus strand down, to the scale of the record's highest."""
    tops = bins.groupBy("seq_id").agg(F.greatest(F.max("plus"), F.max("minus")).alias("_top"), F.max("bin").alias("_last"))
    own = bins.join(tops, "seq_id").where("_top > 0")
    width = F.lit(float(WIDTH - LEFT - RIGHT)) / (F.col("_last") + 1)
    x = hundredths(F.lit(LEFT) + F.col("bin") * width)
    tall = lambda c: F.col(c) / F.col("_top") * height
    bar = lambda y, h, colour: _tag("rect", x=x, y=y, width=hundredths(width), height=h, fill=colour)
    both = F.concat(bar(hundredths(F.lit(TOP + height) - tall("plus")), hundredths(tall("plus")), "var(--accent)"), bar(F.lit(str(TOP + height)), hundredths(tall("minus")), "var(--codon-4)"))
    return own.select("seq_id", F.lit(1).alias("layer"), F.col("bin").cast("long").alias("ord"), both.alias("piece"))


def documents(pieces: DataFrame, width: int, height: int) -> DataFrame:
    """``seq_id, svg``: the pieces of each record in order; as many as the caps allow."""
    inner = F.array_join(F.sort_array(F.collect_list(F.struct("layer", "ord", "piece")))["piece"], "")
    head = f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {width} {height}" width="{width}" height="{height}">'
    return pieces.groupBy("seq_id").agg(F.concat(F.lit(head), inner, F.lit("</svg>")).alias("svg"))


def track_pieces(hits: DataFrame, records: DataFrame, stops: list[str]) -> DataFrame:
    """``seq_id, layer, ord, piece``: a tick for each stop in its frame's lane."""
    own = select.within_cap(hits, select.MAX_TICKS).join(records.where("length > 0").select("seq_id", "length"), "seq_id")
    x = hundredths(F.lit(LEFT) + (F.col("start") - 1) / F.col("length") * (WIDTH - LEFT - RIGHT))
    number = F.array_position(F.array(*map(F.lit, FRAMES)), signed_frame(F.col("strand"), F.col("frame"))) - 1
    top = F.lit(TOP) + number * (LANE + GAP)
    line = _tag("line", x1=x, y1=top.cast("string"), x2=x, y2=(top + LANE).cast("string"), stroke=_colour(F.col("codon"), stops))
    return own.select("seq_id", F.lit(1).alias("layer"), (F.col("rpos").cast("long") * 2 + (F.col("strand") == "-").cast("int")).alias("ord"), line.alias("piece"))
