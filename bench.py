"""Headline-query benchmark: prints ONE JSON line.

env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
     BENCH_QUERIES (comma list, default the headline set).
Each query is fully executed with the no-op sink (no driver collect). The stand-in inputs (reviews,
generations, vectors) are written before, their time is shown as ``prep``; then one warm-up run of the
flagship, so session start-up is not billed to a query.
"""
from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pairlens.plans.queries import QUERIES  # noqa: E402
from pairlens.session import local_session  # noqa: E402
from pairlens.sources.fixtures import Fixtures  # noqa: E402

HEADLINE = ["score_cells", "icace_matching_a2", "icace_approx_exact", "icace_approx_sample", "icace_generative",
            "icace_random", "score_overall", "topk_sweep", "gen_funnel", "gen_hygiene", "pairs_all",
            "contrastive_role_counts", "contrastive_samples", "contrastive_loss_v1", "loss_grid"]


def run(spark, name: str, sf_dir: str) -> float:
    t = time.time()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return round(time.time() - t, 3)


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [q for q in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if q]
    spark = local_session(cpus, shuffle_partitions=int(cpus) * 2, app="pairlens-bench")
    t = time.time()
    fx = Fixtures(spark, sf_dir)
    fx.generations, fx.vectors()
    prep = round(time.time() - t, 3)
    run(spark, "score_cells", sf_dir)  # warm-up: JVM, parquet footers, Python workers
    times = {n: run(spark, n, sf_dir) for n in names}
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_headline_query_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "prep": prep, "sf": float(m.group(1)) if m else None, "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
