"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from checks import QUERIES  # noqa: E402
from resight.session import build_session  # noqa: E402

HEADLINE = [
    "a4_catalogue_scan", "b9_sparsify", "c3_knn_blocked", "c5_radius_join", "c6_quadrant_neighbours", "c8_mutual_links",
    "d1_evidence", "d6_encounter_statistics", "e2_random_split", "e5_arc_length", "e7_gaussian_smooth", "e12_edge_split",
    "e13_misidentifications", "s12_resample", "s13_resample_arc", "j1_oriented_curvature", "j2_curvature_descriptors",
    "j3_gauss_descriptors", "j4_lnbnn_scores", "j4_lnbnn_scores_whole", "j4_lnbnn_scores_lsh", "j5_pair_scores",
    "j7_encounter_scores", "j9_evaluate_topk", "j13_training_table", "j14_link_points", "i1_warp_chi_square",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=int(cpus) * 2, spark__driver__memory="16g",
        spark__driver__maxResultSize="4g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in names:
        began = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    scale = folder.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(scale) if scale.replace(".", "").isdigit() else scale}))


if __name__ == "__main__":
    main()
