"""Differential synchronisation: find changed slices, read and replace only those."""

from __future__ import annotations

from dataclasses import asdict, dataclass
from datetime import datetime
from time import perf_counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slicesync.functions.periods import now_utc, period_int, shift_months
from slicesync.operators.fingerprint import (
    classify,
    in_mutable_window,
    roll_up,
    slices_to_sync,
    sync_stats,
)
from slicesync.operators.slices import drop_slices
from slicesync.plans.fingerprints import FingerprintStore
from slicesync.plans.slice_source import MEASURES, SLICE, DatabaseSource, FrameSource, by_value
from slicesync.session import stage
from slicesync.sources.versions import VersionedTable, align_columns


@dataclass
class DiffSyncStats:
    table_name: str
    country: str
    is_first_sync: bool = False
    total_level1_values: int = 0
    changed_level1: int = 0
    new_level1: int = 0
    deleted_level1: int = 0
    unchanged_level1: int = 0
    outside_window: int = 0
    total_changed_pairs: int = 0
    rows_downloaded: int = 0
    rows_skipped: int = 0
    version: int | None = None
    fingerprint_seconds: float = 0.0
    write_seconds: float = 0.0

    def as_dict(self) -> dict:
        return asdict(self)


def run_differential_sync(
    source: DataFrame | FrameSource | DatabaseSource,
    target: VersionedTable,
    store: FingerprintStore,
    *,
    country: str,
    table_name: str,
    level1: str,
    level2: str,
    mutable_months: int = 0,
    as_of: datetime | None = None,
    job_id: str = "",
) -> DiffSyncStats:
    """Bring ``target`` to the state of ``source`` within the source's scope.

    ``source`` is the extraction with its lookback filter applied: level-1
    values that it does not hold are out of scope and stay in the target.
    Fingerprints are taken before the rows are read and stored after the rows
    are committed, so a failure or a concurrent change is seen again next time.
    Stored fingerprints that were made in another way, or given up by a run in
    another mode, say nothing: then every level-1 value of the source counts as
    new, whatever the window.
    Level-1 values and statuses pass through the driver, as partition values
    do in any partitioned write; slices and rows do not.
    """
    if target.partition_by != level1.lower():
        raise ValueError(f"the target must be partitioned by {level1}")
    if isinstance(source, DataFrame):
        source = FrameSource(source, level1, level2)
    level1, level2 = level1.lower(), level2.lower()
    stats = DiffSyncStats(table_name, country)
    stored1 = store.find(country, table_name, "period")
    stats.is_first_sync = stored1 is None or not target.exists()
    if stats.is_first_sync:
        return full_sync(source, target, store, stats, job_id)

    started = perf_counter()
    known = store.known(country, table_name, "period", source.made_by)
    stored1 = stored1.where(F.lit(known)).select("level1_value", *MEASURES)
    status1 = classify(source.level1_prints(), stored1, ["level1_value"])
    cutoff = (
        period_int(shift_months(as_of or now_utc(), -mutable_months))
        if mutable_months and known
        else 0
    )
    status1 = stage(in_mutable_window(status1, cutoff), "level1-status")
    counted = sync_stats(status1).first()
    for name in ("total_level1_values", "changed_level1", "new_level1", "deleted_level1",
                 "unchanged_level1", "rows_skipped"):
        setattr(stats, name, counted[name])
    all_rows = counted["rows_candidate"] + counted["rows_skipped"]

    open1 = status1.where(F.col("in_window") & F.col("status").isin("changed", "new"))
    to_open = counted["changed_level1"] + counted["new_level1"]
    opened = (
        {row[0]: row[1] for row in open1.select("level1_value", "status").collect()}
        if to_open
        else {}
    )
    stats.outside_window = to_open - len(opened)
    stats.fingerprint_seconds = perf_counter() - started
    if not opened:
        stats.rows_skipped = all_rows
        if stats.deleted_level1:
            store.save(_level1_to_store(status1), country, table_name, "period", job_id,
                       made_by=source.made_by)
        return stats

    values = list(opened)
    now2 = stage(source.level2_prints(values), "level2-now")
    stored2 = store.load(country, table_name, "product", values, source.made_by)
    stored2 = stored2.where(F.lit(known)).select(*SLICE, *MEASURES)
    slices = stage(slices_to_sync(open1, classify(now2, stored2, SLICE)), "slices")
    # Units of the target that slices fall in: level-1 values, or buckets of level 2 in them.
    bucket = target.bucket_of("level2_value") if target.bucket_by == level2 else F.lit(None).cast("int")
    per_unit = slices.groupBy("level1_value", bucket.alias("bucket")).agg(
        F.count(F.lit(1)), F.coalesce(F.sum("row_count"), F.lit(0))
    ).collect()
    stats.total_changed_pairs = sum(row[2] for row in per_unit)
    stats.rows_downloaded = sum(row[3] for row in per_unit)
    if source.reads_level1_whole and per_unit:
        # The slices are picked from all rows of their level-1 values, which the wire carries.
        stats.rows_downloaded = open1.agg(F.coalesce(F.sum("row_count"), F.lit(0))).first()[0]
    stats.rows_skipped = all_rows - stats.rows_downloaded

    stats.fingerprint_seconds, started = perf_counter() - started, perf_counter()
    # A level-1 value that is new may have rows from before it left the scope.
    new_values = {value for value, status in opened.items() if status == "new"}
    units = {(value, None) for value in new_values}
    units |= {(row[0], row[1]) for row in per_unit if row[0] not in new_values}
    if units:
        fresh = source.slice_rows(slices, values)
        old = target.read(parts=[unit for unit in units if unit[0] not in new_values])
        rows, named, keys = by_value(old, slices, source.kinds)
        kept = drop_slices(rows, named, keys, SLICE).select(*old.columns)
        rows = kept.unionByName(align_columns(fresh, kept.schema))
        store.forget(country, table_name, ("window", "watermark", "ranges"))
        stats.version = target.replace_parts(
            rows, units, operation="differential", job_id=job_id
        )
    stats.write_seconds = perf_counter() - started
    store.save(now2, country, table_name, "product", job_id, level1_values=values,
               made_by=source.made_by)
    store.save(_level1_to_store(status1), country, table_name, "period", job_id,
               made_by=source.made_by)
    return stats


def full_sync(source, target, store, stats: DiffSyncStats, job_id: str) -> DiffSyncStats:
    """One scan to fingerprint all slices, one to write; level 1 is rolled up.

    What was stored is given up before the target changes, so a failure
    between the two leaves fingerprints that are unknown, never wrong ones.
    """
    started = perf_counter()
    now2 = stage(source.level2_prints(), "level2-now")
    now1 = roll_up(now2)
    totals = now1.agg(F.count(F.lit(1)), F.coalesce(F.sum("row_count"), F.lit(0))).first()
    stats.total_level1_values = stats.new_level1 = totals[0]
    stats.total_changed_pairs = now2.count()
    stats.rows_downloaded = totals[1]
    store.forget(stats.country, stats.table_name)
    stats.fingerprint_seconds, started = perf_counter() - started, perf_counter()
    stats.version = target.overwrite(source.all_rows(), operation="full", job_id=job_id)
    stats.write_seconds = perf_counter() - started
    store.save(now2, stats.country, stats.table_name, "product", job_id, made_by=source.made_by)
    store.save(now1, stats.country, stats.table_name, "period", job_id, made_by=source.made_by)
    return stats


def _level1_to_store(status1: DataFrame) -> DataFrame:
    """What is true of the target now.

    A change outside the window was not applied, so its stored fingerprint
    stays; a new value outside the window has none. Deleted values leave.
    """
    applied = F.col("in_window") | (F.col("status") == "unchanged")
    rows = status1.where(
        (F.col("status") != "deleted") & (applied | (F.col("status") == "changed"))
    )
    return rows.select(
        "level1_value",
        *[F.when(applied, F.col(m)).otherwise(F.col(f"stored_{m}")).alias(m) for m in MEASURES],
    )
