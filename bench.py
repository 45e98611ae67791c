"""Time the headline jobs on the given scale and print one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores. Each job is
run to the end: results are written to the no-op sink or to a table.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from slicesync.plans.differential import run_differential_sync  # noqa: E402
from slicesync.plans.fingerprints import FingerprintStore  # noqa: E402
from slicesync.queries import QUERIES  # noqa: E402
from slicesync.queries.shared import AS_OF_PURCHASES, purchases  # noqa: E402
from slicesync.session import build_session, run_dir  # noqa: E402
from slicesync.sources.versions import VersionedTable  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))

HEADLINES = [
    "agg1_level1_fingerprint", "agg2_level2_fingerprint", "dif1_classify", "dif3_drill_down",
    "join3_keep_slices", "join4_slice_delete", "agg7_table_profile", "agg9_monthly_trend",
    "agg11_period_totals", "agg12_server_totals", "agg14_event_counts", "agg24_panel_kpis",
    "join1_fact_header", "join6_update_by_key", "win1_page_with_total", "win2_share",
    "inc2_append_beyond_watermark", "inc3_replace_window", "rev2_update", "ver6_change_feed",
]


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def with_changes(rows, percent: int):
    """The purchases with one more unit in the given share of slices."""
    chosen = F.pmod(F.xxhash64("period", "l_suppkey"), F.lit(100)) < percent
    return rows.withColumn(
        "l_quantity", F.when(chosen, F.col("l_quantity") + 1).otherwise(F.col("l_quantity"))
    )


def sync_times(spark, bucket_by: str | None = None) -> tuple[dict[str, float], dict[str, int]]:
    """A first sync, then syncs after 0, 1, 10 and 100 percent of the slices changed."""
    base = purchases(spark, SF_DIR)
    times, rows = {}, {}
    target = VersionedTable(spark, run_dir(spark, "bench"), partition_by="period", bucket_by=bucket_by)
    store = FingerprintStore(spark, run_dir(spark, "bench-fingerprints"))
    state = base
    for label, percent in (("first", None), ("0pct", 0), ("1pct", 1), ("10pct", 10),
                           ("100pct", 100)):
        state = state if not percent else with_changes(state, percent)
        started = time.perf_counter()
        stats = run_differential_sync(
            state, target, store, country="all", table_name="purchases", level1="period",
            level2="l_suppkey", as_of=AS_OF_PURCHASES,
        )
        times[f"sync_{label}"] = round(time.perf_counter() - started, 3)
        rows[f"sync_{label}"] = stats.rows_downloaded
    return times, rows


def main() -> None:
    spark = build_session(
        "bench", master=f"local[{CPUS}]", spark__sql__shuffle__partitions=CPUS,
        spark__driver__memory=os.environ.get("BENCH_DRIVER_MEMORY", "16g"),
        spark__ui__showConsoleProgress="false",
        # Small inputs: let rebalanced writes use every core.
        spark__sql__adaptive__advisoryPartitionSizeInBytes="8m",
    )
    spark.sparkContext.setLogLevel("ERROR")
    drain(purchases(spark, SF_DIR))  # start the engine before the clock
    times, rows = sync_times(spark)
    bucketed, _ = sync_times(spark, "l_suppkey")
    for name in HEADLINES:
        started = time.perf_counter()
        drain(QUERIES[name](spark, SF_DIR))
        times[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "total_wall_clock",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "rows_downloaded": rows,
                "with_buckets": bucketed,
                "rows_per_sec_first_sync": round(rows["sync_first"] / times["sync_first"]),
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "cpus": CPUS,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
