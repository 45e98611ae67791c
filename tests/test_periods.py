from datetime import date, datetime

import pytest
from hypothesis import given
from hypothesis import strategies as st

from slicesync.functions import periods as P


@given(st.integers(1900, 2100), st.integers(1, 12), st.integers(-600, 600))
def test_shift_period_is_reversible(year, month, months):
    period = year * 100 + month
    assert P.shift_period(P.shift_period(period, months), -months) == period


@given(st.datetimes(datetime(1970, 1, 1), datetime(2099, 12, 31)), st.integers(-240, 240))
def test_shift_months_agrees_with_periods(moment, months):
    moved = P.shift_months(moment, months)
    assert P.period_int(moved) == P.shift_period(P.period_int(moment), months)
    assert moved.time() == moment.time() and moved.day <= moment.day


def test_month_end_is_clamped():
    assert P.shift_months(datetime(2024, 3, 31, 8, 30), -1) == datetime(2024, 2, 29, 8, 30)


def test_template_params():
    assert P.template_params(datetime(2024, 1, 31, 10), 24) == {
        "lookback_months": 24, "start_period": 202201, "end_period": 202401,
        "start_year": 2022, "end_year": 2024,
        "start_date": date(2022, 1, 1), "end_date": date(2024, 1, 31),
    }


@pytest.mark.parametrize("months", [0, -1, None])
def test_lookback_must_be_positive(months):
    with pytest.raises(ValueError):
        P.template_params(datetime(2024, 1, 1), months)


def test_placeholders_take_numbers_and_dates_only():
    params = P.template_params(datetime(2024, 1, 31), 1)
    text = P.fill_placeholders("p >= {start_period} and d >= {start_date}", params)
    assert text == "p >= 202312 and d >= '2023-12-01'"
    with pytest.raises(KeyError):
        P.fill_placeholders("x = {nothing}", params)
    with pytest.raises(TypeError):
        P.fill_placeholders("x = {v}", {"v": "1; drop table t"})


def test_run_sql_rejects_unknown_names(spark):
    assert P.run_sql(spark, "SELECT :n + 1 AS x", {"n": 1, "unused": 2}).first()["x"] == 2
    with pytest.raises(KeyError):
        P.run_sql(spark, "SELECT :m AS x", {"n": 1})


def test_period_columns(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-02-29 10:00:00' AS d, '2024' AS y, '3' AS m")
    row = df.select(P.period_of("d"), P.period_from_parts("y", "m")).first()
    assert tuple(row) == (202402, 202403)
    start = spark.sql("SELECT 202407 AS p").select(P.period_start("p")).first()[0]
    assert start == date(2024, 7, 1)
