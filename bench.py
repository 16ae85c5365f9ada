"""Benchmark of headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the data, ``BENCH_CPUS`` the local cores, ``BENCH_QUERIES`` an optional comma-separated choice, or
``all``. With ``BENCH_SWEEP=1`` the regime chain is also timed on 1, 10 and 100 times the entities.
Every query is planned and written to the ``noop`` sink, so all of its rows are computed and none travel to the driver.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import functions as F

from tidemark.operators import regime
from tidemark.plans import bindings, load
from tidemark.session import local_session, materialise

HEADLINE = (
    "resample_month_last",
    "aligned_indicators",
    "regimes",
    "transition_counts",
    "shrunk_transitions",
    "forward_returns",
    "asof_nearest_prices",
    "cell_stats",
    "grouped_cells",
    "series_cards",
    "z_scores",
    "rolling_trends",
    "range_anomalies",
    "similar_vectors",
    "analog_signals",
    "snapshot_returns",
    "risk_report",
    "rolling_win_rate",
    "exposure",
    "account_rollup",
    "risk_limits",
    "reconciliation",
    "fifo_matches",
    "document_sections",
    "code_mentions",
    "numbered_items",
    "run_log_summary",
    "stream_drawdown",
)


def entity_sweep(spark, sf: str) -> dict[str, float]:
    """Seconds of the regime chain over copies of every entity: about ten times the entities should take ten times as long."""
    base = materialise(bindings.observations(spark, sf), "bench-observations")
    took = {}
    for times in (1, 10, 100):
        start = time.perf_counter()
        copies = base.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(times)))).withColumn("entity_id", F.concat_ws("-", "entity_id", "copy")).drop("copy")
        regime.classify(copies).write.format("noop").mode("overwrite").save()
        took[f"x{times}"] = round(time.perf_counter() - start, 3)
    return took


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    registry = load()
    chosen = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE))
    names = list(registry) if chosen == "all" else chosen.split(",")
    # One cheap query first, so that JVM start-up is not charged to the first measured query.
    registry["iso_weeks"].build(spark, sf).write.format("noop").mode("overwrite").save()
    took = {}
    for name in names:
        start = time.perf_counter()
        registry[name].build(spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    sweep = entity_sweep(spark, sf) if os.environ.get("BENCH_SWEEP") else {}
    spark.stop()
    total = round(sum(took.values()), 3)
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/"))} | ({"entity_sweep": sweep} if sweep else {})))


if __name__ == "__main__":
    main()
