from pyspark.sql import functions as F

from ochre.schema import FEATURES, RECORDS

FEATURE_NAMES = [p.split()[0] for p in ("feat_idx seq_id type strand segments ordered_segments start end name locus_tag product protein_id transl_table phase transl_except id parent partial5 partial3 length_nt").split()]


def records(spark, *rows):
    """(id, sequence, circular) each."""
    return spark.createDataFrame([(k, i, bytearray(s, "ascii"), len(s), c, "raw") for k, (i, s, c) in enumerate(rows)], RECORDS)


def feature(k, seq_id, kind, strand, *segments, ordered=None, **more):
    own = [(a, b, None) for a, b in segments]
    row = {"feat_idx": k, "seq_id": seq_id, "type": kind, "strand": strand, "segments": sorted(own), "start": min(a for a, _ in segments), "end": max(b for _, b in segments), "partial5": False, "partial3": False, "id": f"f{k}"}
    row["ordered_segments"] = [(a, b, None) for a, b in ordered] if ordered else (sorted(own, reverse=True) if strand == "-" else sorted(own))
    row |= more
    return tuple(row.get(n) for n in FEATURE_NAMES)


def features(spark, *rows):
    return spark.createDataFrame(list(rows), FEATURES)


def tuples(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def lit(x):
    return F.lit(x)
