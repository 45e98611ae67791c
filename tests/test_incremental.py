from datetime import datetime

import pytest

from slicesync.plans.extract import Extraction, TimeFilter, choose_mode, panel_extraction, synchronise
from slicesync.plans.fingerprints import FingerprintStore
from slicesync.plans.incremental import run_incremental_sync
from slicesync.sources.versions import VersionedTable

SCHEMA = "id long, day timestamp_ntz, v string"
AS_OF = datetime(2024, 7, 31, 12)  # a one-month window starts on 2024-06-30 12:00


def rows(*entries):
    return [(i, datetime(*day), v) for i, day, v in entries]


OLD = rows((1, (2024, 5, 1), "a"), (2, (2024, 6, 30, 11), "b"), (3, (2024, 6, 30, 12), "c"),
           (4, (2024, 7, 2), "d"))


@pytest.fixture(params=[None, "v"])
def sync(spark, folder, request):
    target = VersionedTable(spark, f"{folder}/t", partition_by=request.param)
    store = FingerprintStore(spark, f"{folder}/f")

    def run(entries, **options):
        return run_incremental_sync(
            spark.createDataFrame(entries, SCHEMA), target, store, country="x", table_name="t",
            key="id", as_of=AS_OF, **options)

    run.read = lambda: sorted(map(tuple, target.read().select("id", "day", "v").collect()))
    return run


def test_append_only(sync):
    assert sync(OLD).mode == "full"
    more = OLD + rows((9, (2024, 7, 9), "e"))
    stats = sync(more)
    assert (stats.mode, stats.rows_new) == ("append", 1)
    assert sync.read() == sorted(more)
    assert sync(more).mode == "nothing"


def test_window_is_replaced_at_one_boundary(sync):
    window = {"date_column": "day", "mutable_months": 1}
    sync(OLD, **window)
    changed = rows((1, (2024, 5, 1), "ignored"), (2, (2024, 6, 30, 11), "ignored"),
                   (3, (2024, 6, 30, 12), "C"), (5, (2024, 7, 20), "new"))
    stats = sync(changed, **window)
    assert (stats.mode, stats.rows_window, stats.rows_new) == ("window", 2, 0)
    assert sync.read() == sorted(OLD[:2] + changed[2:])
    assert sync(changed, **window).mode == "nothing"


def test_new_rows_before_the_window_are_appended_once(sync):
    window = {"date_column": "day", "mutable_months": 1}
    sync(OLD, **window)
    more = OLD + rows((7, (2024, 4, 1), "late key"), (8, (2024, 7, 3), "in window"))
    stats = sync(more, **window)
    assert (stats.rows_window, stats.rows_new) == (3, 1)
    assert sync.read() == sorted(more)


def test_late_row_below_the_watermark_is_missed(sync):
    """As documented: a differential sync finds such rows, this one does not."""
    sync(OLD)
    sync(OLD + rows((0, (2024, 1, 1), "late")))
    assert sync.read() == sorted(OLD)


def test_mode_choice():
    assert choose_mode(True, {"a": 1}, {"b": 1}) == "full"
    assert choose_mode(False, {"a": 1}, {"b": 1}) == "differential"
    assert choose_mode(False, None, {"b": 1}) == "incremental"
    assert choose_mode() == "full"


def test_empty_full_run_is_written_unless_told_otherwise(spark, folder):
    target = VersionedTable(spark, f"{folder}/t")
    store = FingerprintStore(spark, f"{folder}/f")
    options = {"country": "x", "table_name": "t"}
    full, none = spark.range(3), spark.range(0)
    assert synchronise(full, target, store, **options)["rows"] == 3
    synchronise(none, target, store, keep_when_empty=True, **options)
    assert target.read().count() == 3
    synchronise(none, target, store, **options)
    assert target.read().count() == 0


def test_extractions(spark):
    table = spark.createDataFrame(
        [(202401, "a", 1), (202401, "a", 1), (202212, "b", 2)], "Periodo int, Nome string, q int")
    spec = Extraction("x", columns={"p": "Periodo", "n": "Nome"}, computed={"twice": "q * 2"},
                      time=TimeFilter("periods", "Periodo"), distinct=True)
    assert [tuple(r) for r in spec.build(table, datetime(2024, 1, 5), 6).collect()] == [
        (202401, "a", 2)]
    assert panel_extraction("pais").build(table, AS_OF).columns == ["periodo", "nome", "q"]
    with pytest.raises(ValueError):
        Extraction("x", time=TimeFilter("weekly", "Periodo")).build(table, AS_OF)


@pytest.mark.parametrize(
    ("kind", "days", "kept"),
    [("since_months", None, [2, 3]), ("since_days", 90, [2, 3]), ("dates", None, [2, 3]),
     ("since_year_of", None, [1, 2, 3])],
)
def test_time_filters_on_timestamps(spark, kind, days, kept):
    table = spark.createDataFrame(
        rows((0, (2023, 12, 31), ""), (1, (2024, 1, 1), ""), (2, (2024, 7, 1), ""),
             (3, (2024, 7, 31), "")), SCHEMA)
    spec = Extraction("x", columns=("id",), time=TimeFilter(kind, "day", days))
    assert sorted(r[0] for r in spec.build(table, AS_OF, 2).collect()) == kept


@pytest.mark.parametrize("kind", ["periods", "since_period", "years", "since_year"])
def test_time_filters_on_numbers(spark, kind):
    values = [202312, 202401, 202407] if "period" in kind else [2023, 2024]
    table = spark.createDataFrame([(v,) for v in values], "n int")
    built = Extraction("x", time=TimeFilter(kind, "n")).build(table, AS_OF, 6)
    assert sorted(r[0] for r in built.collect()) == values[1:]
