"""Periods (integers YYYYMM), calendar arithmetic and time filters.

Every filter leaves the stored column bare on one side, so that it reaches the
Parquet or JDBC scan. ``as_of`` is always explicit; nothing reads the clock
behind the caller's back.
"""

from __future__ import annotations

import calendar
import re
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_LOOKBACK_MONTHS = 24


def now_utc() -> datetime:
    from datetime import timezone

    return datetime.now(timezone.utc).replace(tzinfo=None)


def shift_months(moment: datetime, months: int) -> datetime:
    """Move by calendar months, keeping the time of day and clamping the day."""
    month0 = moment.year * 12 + (moment.month - 1) + months
    year, month = divmod(month0, 12)
    day = min(moment.day, calendar.monthrange(year, month + 1)[1])
    return moment.replace(year=year, month=month + 1, day=day)


def period_int(moment: date) -> int:
    return moment.year * 100 + moment.month


def shift_period(period: int, months: int) -> int:
    if not 1 <= period % 100 <= 12:
        raise ValueError(f"not a YYYYMM period: {period}")
    year, month = divmod(period // 100 * 12 + period % 100 - 1 + months, 12)
    return year * 100 + month + 1


def period_of(moment: Column | str) -> Column:
    """YYYYMM of a date or timestamp column."""
    return F.year(moment) * 100 + F.month(moment)


def period_from_parts(year: Column | str, month: Column | str) -> Column:
    year = F.col(year) if isinstance(year, str) else year
    month = F.col(month) if isinstance(month, str) else month
    return (year.cast("int") * 100 + month.cast("int")).cast("int")


def period_start(period: Column | str) -> Column:
    """First day of a YYYYMM column."""
    period = F.col(period) if isinstance(period, str) else period
    return F.make_date((period / 100).cast("int"), period % 100, F.lit(1))


def _check_lookback(months: int) -> int:
    if months is None or months <= 0:
        raise ValueError("lookback_months must be positive")
    return months


def moment_literal(moment: date | datetime) -> Column:
    """A zone-free timestamp literal."""
    if not isinstance(moment, datetime):
        moment = datetime(moment.year, moment.month, moment.day)
    return F.lit(moment.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


# --- parameters -----------------------------------------------------------

def template_params(as_of: datetime, lookback_months: int = DEFAULT_LOOKBACK_MONTHS) -> dict:
    """The seven parameters an extraction may refer to, as typed values."""
    start = shift_months(as_of, -_check_lookback(lookback_months))
    return {
        "lookback_months": lookback_months,
        "start_period": period_int(start),
        "end_period": period_int(as_of),
        "start_year": start.year,
        "end_year": as_of.year,
        "start_date": date(start.year, start.month, 1),
        "end_date": as_of.date(),
    }


def _names_in(text: str, pattern: str, params: dict) -> list[str]:
    names = list(dict.fromkeys(re.findall(pattern, text)))
    unknown = [name for name in names if name not in params]
    if unknown:
        raise KeyError(f"unknown parameters: {', '.join(unknown)}")
    return names


def run_sql(spark: SparkSession, text: str, params: dict) -> DataFrame:
    """Run Spark SQL with named ``:params``; an unknown name is an error."""
    names = _names_in(text, r"(?<![:\w]):([a-z_]\w*)", params)
    return spark.sql(text, args={name: params[name] for name in names})


def fill_placeholders(text: str, params: dict) -> str:
    """Fill ``{name}`` placeholders of a text that a database will run.

    Only numbers and dates are accepted, so no value can change the statement.
    """
    literals = {}
    for name in _names_in(text, r"\{(\w+)\}", params):
        value = params[name]
        if isinstance(value, bool) or not isinstance(value, (int, float, date)):
            raise TypeError(f"parameter {name} must be a number or a date")
        literals[name] = f"'{value.isoformat()}'" if isinstance(value, date) else str(value)
    return re.sub(r"\{(\w+)\}", lambda match: literals[match.group(1)], text)


# --- filters --------------------------------------------------------------

def in_periods(column: str, start: int, end: int) -> Column:
    return F.col(column).between(start, end)


def since_period(column: str, as_of: datetime, months: int) -> Column:
    return F.col(column) >= period_int(shift_months(as_of, -_check_lookback(months)))


def in_years(column: str, start: int, end: int) -> Column:
    return F.col(column).between(start, end)


def since_year(column: str, as_of: datetime, months: int) -> Column:
    return F.col(column) >= shift_months(as_of, -_check_lookback(months)).year


def since_year_of(column: str, as_of: datetime, months: int) -> Column:
    """``year(column) >= year(as_of - months)`` as a range on the bare column."""
    first = shift_months(as_of, -_check_lookback(months)).year
    return F.col(column) >= moment_literal(date(first, 1, 1))


def in_year_of(column: str, year: int) -> Column:
    """``year(column) = year`` as a range on the bare column."""
    return (F.col(column) >= moment_literal(date(year, 1, 1))) & (
        F.col(column) < moment_literal(date(year + 1, 1, 1))
    )


def since_months(column: str, as_of: datetime, months: int) -> Column:
    return F.col(column) >= moment_literal(shift_months(as_of, -_check_lookback(months)))


def since_days(column: str, as_of: datetime, days: int) -> Column:
    return F.col(column) >= moment_literal(as_of - timedelta(days=days))


def between_moments(column: str, start: date, end: date) -> Column:
    return F.col(column).between(moment_literal(start), moment_literal(end))


def period_range_of(column: str, start: int, end: int) -> Column:
    """Rows whose timestamp falls in the periods start..end, as a pushable range."""
    after = shift_period(end, 1)
    return (F.col(column) >= moment_literal(date(start // 100, start % 100, 1))) & (
        F.col(column) < moment_literal(date(after // 100, after % 100, 1))
    )


def since_period_of(column: str, as_of: datetime, months: int) -> Column:
    """Period of ``column`` >= period of as_of - months, as a range on the bare column."""
    start = shift_months(as_of, -_check_lookback(months))
    return F.col(column) >= moment_literal(date(start.year, start.month, 1))


def in_years_of(column: str, start: int, end: int) -> Column:
    """``year(column)`` between two years, as a range on the bare column."""
    return (F.col(column) >= moment_literal(date(start, 1, 1))) & (
        F.col(column) < moment_literal(date(end + 1, 1, 1))
    )
