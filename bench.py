"""Headline queries on ``$BENCH_SF_DIR``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from genomeframe.queries import QUERIES
from genomeframe.session import local_session

HEADLINE = [
    "accuracy_report",
    "interval_merge",
    "introns",
    "bp_overlap",
    "overlap_semi",
    "overlap_anti",
    "reciprocal_overlap",
    "longest_orf",
    "motif_sites",
    "energy_per_contig",
    "feature_ancestors",
    "exon_sets",
    "score_sites",
    "span_candidates",
    "best_chain",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, int(cores) if cores.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1_000_000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in HEADLINE:
        started = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - started, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    result = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
