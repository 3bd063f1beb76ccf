"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is fully executed with the ``noop`` sink (every row produced,
nothing collected) after one untimed warm-up of the session. Prints ONE
JSON line: {"metric", "value" (total seconds), "unit", "queries", "sf"}.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "model_dataset", "base_orders", "items_agg", "worst_categories", "worst_states", "overall_bad_rate",
    "delay_by_score", "corr_delay_score", "review_by_late_flag", "score_distribution", "orders_per_month",
    "missing_profile", "cluster_features", "impute_median", "one_hot", "confusion_matrix",
    "classification_report", "regression_metrics", "residual_bins", "box_stats", "gaussian_nb", "logistic",
    "linear_regression",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from orderlens.session import get_spark
    from orderlens.plans.queries import REGISTRY
    spark = get_spark(f"local[{cpus}]", int(cpus) * 2)
    only = sys.argv[1:] or HEADLINE
    REGISTRY["table_shapes"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    times, errors = {}, {}
    for name in only:
        t0 = time.time()
        try:
            REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - t0, 3)
        except Exception as e:  # noqa: BLE001 — report, keep timing the rest
            times[name] = None
            errors[name] = f"{type(e).__name__}: {str(e)[:200]}"
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "headline_queries_total_time", "value": round(sum(v for v in times.values() if v), 3),
           "unit": "sec", "queries": times, "sf": float(m.group(1)) if m else sf_dir}
    if errors:
        out["errors"] = errors
    print(json.dumps(out))


if __name__ == "__main__":
    main()
