"""Benchmark the headline queries.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Prints ONE JSON line: {"metric", "value", "unit", "queries": {name: sec}, "sf"}.
Each query is executed fully (``noop`` sink, no driver collect) once after a
warm-up of the session; the value is the sum of the per-query wall times.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from quarry.plans.registry import queries  # noqa: E402
from quarry.session import build_session  # noqa: E402

HEADLINE = [
    "saturation_curve",            # flagship: W1/X1 + J5 over all question types
    "saturation_metadata",
    "saturation_words",            # steep curve over every word of the English texts
    "saturation_curve_per_crop",   # W2 per group
    "g9_state_summary",            # 5-table join + distinct counts
    "g11b_bucket_by_year",         # dimension lookup + shares within year
    "g13_district_crop_matrix",
    "w3_cluster_matrix",           # re-ranked cluster matrix with top-5 texts
    "s4_run_log_summary",          # regex parse + normalised + substring joins
    "f11_clean_text",              # text preprocessing (reference: ~30 s / 100k)
    "m1_tfidf_weights",            # TF-IDF (reference: ~10 s / 100k)
    "m4_top_keywords",
    "e_quality_scores",            # silhouette / DB / CH
    "c1_kmeans_clusters",          # k-means (reference: ~1 min / 100k)
    "c4_dbscan_clusters",          # density clustering
    "j11_knn_graph",               # exact 15-NN graph (reference: distances ~5 min / 100k)
    "c5_hdbscan_clusters",         # HDBSCAN re-aim (reference: ~3 min / 100k)
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)
    qs = queries()
    names = [n for n in HEADLINE if n in qs]
    spark.read.parquet(f"{sf_dir}/region.parquet").count()  # warm-up
    times = {}
    for name in names:
        t0 = time.time()
        try:
            qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - t0, 3)
        except Exception as e:  # noqa: BLE001
            print(f"{name} failed: {type(e).__name__}: {str(e)[:200]}", file=sys.stderr)
            times[name] = None
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None
    total = round(sum(v for v in times.values() if v is not None), 3)
    print(json.dumps({"metric": "headline_total_sec", "value": total, "unit": "sec",
                      "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
