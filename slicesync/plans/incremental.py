"""Incremental synchronisation: append beyond a watermark, refresh a recent window."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slicesync.functions.columns import lower_case_names
from slicesync.functions.hashing import made_by
from slicesync.functions.periods import moment_literal, now_utc, shift_months
from slicesync.operators.fingerprint import MEASURES, classify, fingerprint, window_fingerprint
from slicesync.operators.intervals import cover, within
from slicesync.operators.slices import drop_slices, keep_slices
from slicesync.plans.fingerprints import FingerprintStore
from slicesync.session import local_rows, stage
from slicesync.sources.versions import VersionedTable

WINDOW_KEY = "mutable_window"
# Fingerprints of the differential mode, which a write in this one outdates.
SLICE_LEVELS = ("period", "product")


def watermark(target: DataFrame, key: str) -> DataFrame:
    """Highest key of the target as BIGINT; NULL if it has no rows."""
    return target.agg(F.max(F.col(key).cast("bigint")).alias("max_key"))


def beyond(
    source: DataFrame,
    key: str,
    max_key: int,
    date_column: str | None = None,
    boundary: datetime | None = None,
) -> DataFrame:
    """Rows above the watermark; with a window only those before its boundary."""
    fresh = source.where(F.col(key) > max_key)
    if boundary is not None:
        fresh = fresh.where(F.col(date_column) < moment_literal(boundary))
    return fresh


def in_window(df: DataFrame, date_column: str, boundary: datetime) -> DataFrame:
    return df.where(F.col(date_column) >= moment_literal(boundary))


@dataclass
class IncrementalStats:
    table_name: str
    mode: str = "nothing"
    rows_window: int = 0
    rows_new: int = 0
    rows_late: int = 0
    ranges_read: int = 0
    version: int | None = None


def run_incremental_sync(
    source: DataFrame,
    target: VersionedTable,
    store: FingerprintStore,
    *,
    country: str,
    table_name: str,
    key: str,
    date_column: str | None = None,
    mutable_months: int = 0,
    as_of: datetime | None = None,
    job_id: str = "",
    force_full: bool = False,
    range_keys: int | None = None,
) -> IncrementalStats:
    """Append rows whose key exceeds the target's, and replace a changed window.

    ``force_full`` writes the whole source instead, as a first run does.
    The window's boundary is one value for the rows removed and the rows read.
    With ``range_keys`` the source's keys are counted in ranges of so many, and
    ranges in which a key came late (below the watermark, dated before the
    window) are read again; of their rows those are appended whose key the
    target lacks, so keys must be unique. Without it such rows are not found.
    """
    source = lower_case_names(source)
    key = key.lower()
    date_column = date_column.lower() if date_column else None
    stats = IncrementalStats(table_name)
    known = target.exists() and not force_full
    max_key = _last_key(target, store, country, table_name, key) if known else None
    windowed = bool(mutable_months and date_column)
    boundary = shift_months(as_of or now_utc(), -mutable_months) if windowed else None
    how = made_by(source)

    if max_key is None:
        stats.mode = "full"
        now = _window_prints(in_window(source, date_column, boundary)) if windowed else None
        store.forget(country, table_name)
        stats.version = target.overwrite(source, operation="full", job_id=job_id)
        stats.rows_new = target.rows_written(stats.version)
        if windowed:
            store.save(now, country, table_name, "window", job_id, made_by=how)
        if range_keys:
            ranges = stage(key_ranges(source, key, range_keys), "ranges")
            store.save(ranges, country, table_name, "ranges", job_id,
                       made_by=_ranged_by(key, range_keys))
        return stats

    # One read of the source: what may be written is staged, and the fingerprint, the
    # counts and the write all come from there.
    wanted = F.col(key) > max_key
    if windowed:
        wanted = wanted | (F.col(date_column) >= moment_literal(boundary))
    ranges = grown = None
    if range_keys:
        ranges = stage(key_ranges(source, key, range_keys), "ranges")
        grown, intervals = _grown_ranges(
            ranges, store, country, table_name, key, range_keys, max_key)
        stats.ranges_read = grown.count()
        wanted = wanted | within(source, key, intervals)
    staged = stage(source.where(wanted), "incremental")
    fresh = beyond(staged, key, max_key, date_column, boundary)
    window = in_window(staged, date_column, boundary) if windowed else staged.where(F.lit(False))
    if stats.ranges_read:
        late = stage(_late_rows(
            staged, target.read(), key, max_key, grown, range_keys, intervals, date_column, boundary,
        ), "late")
        stats.rows_late = late.count()
        fresh = fresh.unionByName(late)
    new_rows, highest = fresh.agg(F.count(F.lit(1)), F.max(F.col(key).cast("bigint"))).first()
    now = _window_prints(window) if windowed else None
    if windowed and not _same(now, store.load(country, table_name, "window", made_by=how)):
        stats.mode = "window"
        stats.rows_window, stats.rows_new = now.first()["row_count"], new_rows
        highest = staged.agg(F.max(F.col(key).cast("bigint"))).first()[0]
        store.forget(country, table_name, (*SLICE_LEVELS, "watermark"))
        # The window is one commit with the appended rows, so no reader ever
        # sees the one without the other.
        stats.version = _replace_window(
            target, fresh.unionByName(window), date_column, boundary, job_id
        )
        store.save(now, country, table_name, "window", job_id, made_by=how)
    elif new_rows:
        stats.mode = "append"
        store.forget(country, table_name, (*SLICE_LEVELS, "watermark"))
        stats.version = target.append(fresh, operation="incremental", job_id=job_id)
        stats.rows_new = new_rows
    if stats.version is not None:
        _keep_key(store, max(max_key, highest or max_key), country, table_name, key, job_id)
    if range_keys and (stats.version is not None or stats.ranges_read):
        store.save(ranges, country, table_name, "ranges", job_id,
                   made_by=_ranged_by(key, range_keys))
    return stats


def key_ranges(source: DataFrame, key: str, range_keys: int) -> DataFrame:
    """Fingerprints of the keys in ranges of ``range_keys`` keys; only the key is read."""
    if range_keys < 1:
        raise ValueError("range_keys must be positive")
    keys = source.where(F.col(key).isNotNull()).select(
        F.col(key).cast("bigint").alias(key), _range_of(key, range_keys).alias("level1_value"))
    return fingerprint(keys, ["level1_value"], [key])


def _range_of(key: str, range_keys: int) -> Column:
    value, width = F.col(key).cast("bigint"), F.lit(range_keys).cast("bigint")
    return F.call_function("div", value - F.pmod(value, width), width)


def _ranged_by(key: str, range_keys: int) -> str:
    return f"{key} in ranges of {range_keys}"


def _grown_ranges(ranges, store, country, table_name, key, range_keys, max_key):
    """Ranges up to the watermark whose keys are not those last seen, and intervals over them.

    What was never counted has to be looked at whole once.
    """
    before = store.load(country, table_name, "ranges", made_by=_ranged_by(key, range_keys)).select(
        F.col("level1_value").cast("bigint").alias("level1_value"), *MEASURES)
    status = classify(ranges, before, ["level1_value"]).where("status IN ('changed', 'new')")
    grown = stage(status.select("level1_value").where(
        F.col("level1_value") <= max_key // range_keys), "grown")
    intervals = [
        (low * range_keys, min((high + 1) * range_keys - 1, max_key))
        for low, high in cover(grown, "level1_value")
    ]
    return grown, intervals


def _late_rows(staged, target, key, max_key, grown, range_keys, intervals, date_column, boundary):
    """Staged rows of the grown ranges, outside the window, whose key the target lacks there."""
    def settled(rows):
        rows = rows.where(within(rows, key, intervals) & (F.col(key) <= max_key))
        if boundary is not None:
            rows = rows.where(F.coalesce(F.col(date_column) < moment_literal(boundary), F.lit(False)))
        return rows.withColumn("_range", _range_of(key, range_keys))

    late = keep_slices(settled(staged), grown, ["_range"], ["level1_value"]).drop("_range")
    return drop_slices(late, settled(target), [key])


def _window_prints(window: DataFrame) -> DataFrame:
    prints = window_fingerprint(window).withColumn("level1_value", F.lit(WINDOW_KEY))
    return stage(prints, "window")


def _last_key(
    target: VersionedTable, store: FingerprintStore, country: str, table_name: str, key: str
) -> int | None:
    """The highest key ever synchronised: as stored, else the target's key column is read."""
    if store.known(country, table_name, "watermark", key):
        return int(store.load(country, table_name, "watermark", made_by=key).first()["level1_value"])
    return watermark(target.read(), key).first()[0]


def _keep_key(store: FingerprintStore, value: int, country, table_name, key, job_id) -> None:
    mark = local_rows(store.spark, [(str(value), 0, 0)], "level1_value string, row_count long, "
                      "checksum_xor long").withColumn("checksum_sum", F.lit(0))
    store.save(mark, country, table_name, "watermark", job_id, made_by=key)


def _same(now: DataFrame, stored: DataFrame) -> bool:
    measures = ["row_count", "checksum_xor", "checksum_sum"]
    before = stored.select(*measures).first()
    return before is not None and tuple(before) == tuple(now.select(*measures).first())


def _replace_window(
    target: VersionedTable, rows: DataFrame, date_column: str, boundary: datetime, job_id: str
) -> int:
    """Rows of the window out, ``rows`` in; parts the window does not touch stay as they are."""
    current = target.read()
    hit = F.coalesce(F.col(date_column) >= moment_literal(boundary), F.lit(False))
    if not target.partition_by:
        kept = current.where(~hit)
        return target.overwrite(
            kept.unionByName(rows.select(*kept.columns)), operation="incremental", job_id=job_id
        )
    parts = [row[0] for row in current.where(hit).select(target.partition_by).distinct().collect()]
    kept = target.read(parts=parts).where(~hit)
    return target.replace_parts(
        kept.unionByName(rows.select(*kept.columns)), parts,
        operation="incremental", job_id=job_id,
    )
