"""Times the headline queries; prints one line of JSON."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

HEADLINE = ("codon_counts", "frame_breakdown", "six_frame_hits", "hit_ids", "summary", "density_bins", "orfs_start_stop", "orfs_stop_stop", "terminators", "classify_hits", "gene_summary", "cds_faa", "gff3_rows")


def main() -> None:
    from pyspark.sql import SparkSession

    from ochre.queries import QUERIES

    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(2 * int(cpus))).config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g")).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["codon_counts"](spark, folder).collect()  # compiles and warms up
    took = {}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    bases = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("sum(length(text)) AS n").first()["n"]
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(folder.rstrip("/")), "characters": bases, "mb_per_s_scanned": round(bases / 1e6 / took["codon_counts"], 2)}))


if __name__ == "__main__":
    main()
