"""Baseline, mutate, restore; and the cases where a sync could lose rows."""

from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from slicesync.operators.fingerprint import sync_stats
from slicesync.plans.differential import run_differential_sync
from slicesync.plans.fingerprints import FingerprintStore
from slicesync.plans.slice_source import DatabaseSource, FrameSource
from slicesync.sources.versions import VersionedTable

SCHEMA = "Periodo int, idproduto int, valor decimal(10,2), descripcion string"


def baseline():
    return {
        (period, product): Decimal(period) / 100 + product
        for period in (202401, 202402, 202403)
        for product in range(1, 6)
    }


class Bench:
    def __init__(self, spark, folder, bucket_by=None):
        self.spark = spark
        self.target = VersionedTable(spark, f"{folder}/t", partition_by="periodo", bucket_by=bucket_by, buckets=4)
        self.store = FingerprintStore(spark, f"{folder}/f")

    def sync(self, rows, **options):
        source = self.spark.createDataFrame(
            [(p, q, v, "d") for (p, q), v in rows.items()], SCHEMA)
        return run_differential_sync(
            source, self.target, self.store, country="x", table_name="t", level1="Periodo",
            level2="idproduto", **options)

    def rows(self):
        return {(r["periodo"], r["idproduto"]): r["valor"] for r in self.target.read().collect()}


@pytest.fixture
def bench(spark, folder):
    return Bench(spark, folder)


@pytest.mark.parametrize("bucket_by", [None, "idproduto"])
def test_baseline_mutate_restore(spark, folder, bucket_by):
    bench, rows = Bench(spark, folder, bucket_by), baseline()
    first = bench.sync(rows)
    assert first.is_first_sync and first.rows_downloaded == 15 and first.new_level1 == 3
    assert bench.rows() == rows

    mutated = {**rows, (202402, 3): Decimal("999.99"), (202403, 6): Decimal("66.66")}
    second = bench.sync(mutated)
    assert (second.changed_level1, second.unchanged_level1) == (2, 1)
    assert second.rows_downloaded == 2 and second.total_changed_pairs == 2
    assert bench.rows() == mutated and len(mutated) == 16
    if bucket_by:  # each slice is in a bucket of its own, beside at most a few others
        assert bench.target.rows_written(second.version) < 10

    third = bench.sync(rows)
    assert third.rows_downloaded == 1 and third.total_changed_pairs == 2
    assert bench.rows() == rows

    fourth = bench.sync(rows)
    assert fourth.version is None and fourth.rows_downloaded == 0 and fourth.rows_skipped == 15


def test_only_change_is_a_deleted_slice(bench):
    rows = baseline()
    bench.sync(rows)
    del rows[(202402, 3)]
    assert bench.sync(rows).total_changed_pairs == 1
    assert bench.rows() == rows


def test_out_of_scope_month_stays_and_returns(bench):
    rows = baseline()
    bench.sync(rows)
    recent = {key: value for key, value in rows.items() if key[0] >= 202402}
    assert bench.sync(recent).deleted_level1 == 1
    assert bench.rows() == rows
    # Back in scope and different: all of it is replaced, nothing is doubled.
    changed = {**rows, (202401, 1): Decimal("1.00")}
    del changed[(202401, 2)]
    assert bench.sync(changed).new_level1 == 1
    assert bench.rows() == changed


def test_change_outside_the_window_is_seen_later(bench):
    rows = baseline()
    bench.sync(rows)
    changed = {**rows, (202401, 1): Decimal("5.00"), (202403, 1): Decimal("6.00")}
    as_of = datetime(2024, 3, 15)
    stats = bench.sync(changed, mutable_months=1, as_of=as_of)
    assert stats.outside_window == 1 and stats.rows_downloaded == 1
    assert bench.rows() == {**rows, (202403, 1): Decimal("6.00")}
    assert bench.sync(changed, mutable_months=1, as_of=as_of).outside_window == 1
    assert bench.sync(changed).changed_level1 == 1
    assert bench.rows() == changed


def test_null_keys_are_slices(bench):
    rows = {(None, 1): Decimal("1.00"), (202401, None): Decimal("2.00"), **baseline()}
    bench.sync(rows)
    assert bench.rows() == rows
    rows[(None, 1)] = Decimal("7.00")
    rows[(202401, None)] = Decimal("8.00")
    assert bench.sync(rows).rows_downloaded == 2
    assert bench.rows() == rows


def test_failed_write_is_seen_again(bench, monkeypatch):
    rows = baseline()
    bench.sync(rows)
    changed = {**rows, (202402, 3): Decimal("9.00")}

    def broken(*args, **kwargs):
        raise OSError("disk full")

    with monkeypatch.context() as patch:
        patch.setattr(VersionedTable, "replace_parts", broken)
        with pytest.raises(OSError):
            bench.sync(changed)
    assert bench.rows() == rows
    assert bench.sync(changed).rows_downloaded == 1
    assert bench.rows() == changed


def test_other_columns_fail_and_keep_the_table(spark, bench):
    rows = baseline()
    bench.sync(rows)
    source = spark.createDataFrame([(202401, 1, "x")], "periodo int, idproduto int, other string")
    with pytest.raises(ValueError, match="columns do not match"):
        run_differential_sync(
            source, bench.target, bench.store, country="x", table_name="t",
            level1="periodo", level2="idproduto")
    assert bench.rows() == rows


def test_slice_with_a_third_of_all_rows(spark, folder):
    """One product of one month holds most rows; results stay whole."""
    source = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, 202401).otherwise(202402 + (F.col("id") % 2).cast("int"))
        .alias("periodo"),
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 50).cast("int")
        .alias("idproduto"),
        F.col("id"),
    )
    target = VersionedTable(spark, f"{folder}/t", partition_by="periodo")
    store = FingerprintStore(spark, f"{folder}/f")
    options = {"country": "x", "table_name": "t", "level1": "periodo", "level2": "idproduto"}
    run_differential_sync(source, target, store, **options)
    changed = source.withColumn(
        "id", F.when(F.col("idproduto") == 0, F.col("id") + 1_000_000).otherwise(F.col("id")))
    stats = run_differential_sync(changed, target, store, **options)
    assert stats.rows_downloaded == changed.where("idproduto = 0").count()
    columns = target.read().columns
    assert target.read().exceptAll(changed.select(*columns)).isEmpty()
    assert changed.select(*columns).exceptAll(target.read()).isEmpty()


def test_stats_of_nothing(spark):
    empty = spark.createDataFrame([], "status string, row_count long")
    assert set(sync_stats(empty).first().asDict().values()) == {0}


def _mode(bench, rows, mode, force_full=False):
    from slicesync.plans.extract import synchronise

    source = bench.spark.createDataFrame(
        [(p, q, v, f"{p // 100}-{p % 100:02d}-01", p * 100 + q) for (p, q), v in rows.items()],
        "periodo int, idproduto int, valor decimal(10,2), d string, k int",
    ).withColumn("d", F.col("d").cast("timestamp_ntz"))
    settings = {
        "differential": {"level1": "periodo", "level2": "idproduto"},
        "incremental": {"key": "k", "date_column": "d", "mutable_months": 24},
    }
    return synchronise(
        source, bench.target, bench.store, country="x", table_name="t", force_full=force_full,
        as_of=datetime(2024, 3, 15), **({mode: settings[mode]} if mode else {}))


@pytest.mark.parametrize("between,full", [
    ("differential", True), ("incremental", True), (None, True), ("incremental", False)])
@pytest.mark.parametrize("mode", ["differential", "incremental"])
def test_any_run_between_leaves_no_stale_fingerprint(bench, mode, between, full):
    """Scenario: state A, a run in another mode with B, state A again."""
    rows = baseline()
    other = {key: value + 1 for key, value in rows.items()}
    _mode(bench, rows, mode)
    _mode(bench, other, between, full)
    assert bench.rows() == other
    _mode(bench, rows, mode)
    assert bench.rows() == rows


def test_fingerprints_made_in_another_way_say_nothing(bench):
    rows = baseline()
    bench.sync(rows)
    assert bench.sync(rows).rows_downloaded == 0
    prints = bench.store.find("x", "t", "period")
    bench.store.save(prints, "x", "t", "period", made_by="other")
    again = bench.sync(rows, mutable_months=1, as_of=datetime(2024, 3, 15))
    assert not again.is_first_sync and again.new_level1 == 3 and again.rows_downloaded == 15
    assert bench.rows() == rows and bench.sync(rows).rows_downloaded == 0


def test_a_database_sends_level1_values_whole(spark, folder):
    """What is counted as downloaded is what the predicates read, not the slices picked from it."""
    rows, read = baseline(), []
    target, store = VersionedTable(spark, f"{folder}/t", partition_by="periodo"), FingerprintStore(spark, f"{folder}/f")

    def sync(values):
        frame = spark.createDataFrame([(p, q, v, "d") for (p, q), v in values.items()], SCHEMA)
        frame.createOrReplaceTempView("sent_whole")

        def rows_of(predicates):
            sent = spark.table("sent_whole").where(" OR ".join(f"({p})" for p in predicates))
            read.append(sent.count())
            return sent

        source = DatabaseSource(
            "sent_whole", "Periodo", "idproduto", run=spark.sql, read=rows_of, read_all=lambda: spark.table("sent_whole"),
            row_hash="xxhash64(*)", xor="bit_xor", hash_sum="sum(cast(xxhash64(*) AS decimal(20,0)))",
            bucket_hash="abs(cast(hash({}) AS bigint))")
        return run_differential_sync(
            source, target, store, country="x", table_name="t", level1="Periodo", level2="idproduto")

    assert sync(rows).rows_downloaded == 15
    stats = sync({**rows, (202402, 3): Decimal("1.00")})
    assert read == [5] and (stats.rows_downloaded, stats.rows_skipped, stats.total_changed_pairs) == (5, 10, 1)
    assert sync({**rows, (202402, 3): Decimal("1.00")}).rows_downloaded == 0 and read == [5]


def test_rows_are_joined_to_slices_without_texts(spark):
    """Rows that are shuffled to meet the slices carry their own columns and nothing else."""
    source = FrameSource(spark.range(100).selectExpr("CAST(id % 3 AS int) AS p", "id % 7 AS q", "id AS v"), "p", "q")
    slices = spark.createDataFrame([("1", "2"), ("2", "5"), (None, "1")], "level1_value string, level2_value string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = source.slice_rows(slices, ["1", "2"])
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert "LeftSemi" in plan and "as string" not in plan
        assert {r["v"] for r in rows.collect()} == {
            v for v in range(100) if (v % 3, v % 7) in ((1, 2), (2, 5))}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("kinds", [
    ("int", "bigint"), ("string", "date"), ("string", "string"), ("smallint", "double"), ("date", "boolean")])
def test_slices_of_any_type_are_found(spark, folder, kinds):
    """Also a text that looks like a number, NULL, and 0.0 beside -0.0, which differ as slices only."""
    inner = {"bigint": ("7", "8"), "date": ("2024-01-01", "0999-12-31"), "string": ("07", "7 "),
             "double": ("0.0", "-0.0"), "boolean": ("true", "false")}[kinds[1]]
    outer = {"int": ("1", "2"), "string": ("01", "1"), "smallint": ("3", "2"), "date": ("2024-02-29", "1999-12-31")}[kinds[0]]
    keys = [(a, b) for a in (*outer, None) for b in (*inner, None)]

    def state(values):
        rows = [(a, b, v) for (a, b), v in zip(keys, values)] * 2
        frame = spark.createDataFrame(rows, "p string, q string, v int")
        return frame.select(F.col("p").cast(kinds[0]), F.col("q").cast(kinds[1]), "v")

    target, store = VersionedTable(spark, f"{folder}/t", partition_by="p"), FingerprintStore(spark, f"{folder}/f")
    options = {"country": "x", "table_name": "t", "level1": "p", "level2": "q"}
    run_differential_sync(state(range(9)), target, store, **options)
    changed = state([10 + v if v % 2 else v for v in range(9)])
    stats = run_differential_sync(changed, target, store, **options)
    assert (stats.rows_downloaded, stats.total_changed_pairs) == (8, 4)

    def sorted_rows(df):
        return sorted(map(tuple, df.select(F.col("p").cast("string"), F.col("q").cast("string"), "v").collect()), key=repr)

    assert sorted_rows(target.read()) == sorted_rows(changed)
    assert run_differential_sync(changed, target, store, **options).rows_downloaded == 0
