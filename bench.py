"""Headline queries, each run whole into a no-op sink. Prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from tidemark.plans import registry

HEADLINE = ["rec_windows", "rec_windows_segmented", "qry_overlaps", "qry_residuals", "aln_counts", "cmp_overlap", "cmp_residual", "cmp_coverage_summary", "cmp_containment", "cmp_leadlag_start", "cmp_asof_previous", "cohort_at_least",
            "matrix_sources", "hierarchy", "epi_form", "epi_relations", "epi_scorecard", "rup_any", "seq_three_step", "rev_changelog"]


def main():
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    registry.QUERIES["rec_windows"](spark, sf).count()
    took = {}
    for name in HEADLINE:
        t = time.time()
        registry.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - t, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf)}))


if __name__ == "__main__":
    main()
