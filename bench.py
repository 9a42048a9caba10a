"""Times the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from factorloom import catalog  # noqa: E402
from factorloom.session import session  # noqa: E402

#: Panel load, expression evaluation, evaluation, composition, backtest, learning.
HEADLINE = ("bars_daily", "densify_panel", "forward_adjust", "dsl_nested_atoms", "dsl_all_atoms", "ic_summary", "factor_grade", "quantile_turnover", "composite_score", "vector_backtest_equal", "summary_252", "trade_ledger", "asof_last_value", "interval_membership_all", "learning_rows", "ridge_scores")


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["bars_daily"](spark, folder).count()  # starts the JVM's compilers
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
