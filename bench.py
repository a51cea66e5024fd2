"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tickloom.checks import QUERIES  # noqa: E402
from tickloom.session import local_session  # noqa: E402

HEADLINE = [
    "rank_ic_momentum", "factors_default18", "alpha101_001_012", "cicc_shape", "cicc_corr", "asof_statements", "asof_bucketed_ticks", "event_decay_daily",
    "eligibility_masks", "label_session_clock", "label_triple_barrier", "ic_summary_hac", "stratified_ic", "factor_summary_table", "integrity_quarantine",
    "panel_reconcile", "event_integrity_checks", "session_bars", "universe_filter_audit", "fifo_round_trips", "sector_signals", "flow_features",
    "news_cross_validation", "bucket_fundamental_rank",
]


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cpus, partitions=max(8, int(cpus) if cpus.isdigit() else 8))
    QUERIES["symbol_identity"](spark, root).count()  # warm the session, not the queries
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, root).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": root.rstrip("/").rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
