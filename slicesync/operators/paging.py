"""Ordered pages and totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slicesync.operators.intervals import CELLS, literal, occupied_cells, within

#: Rows that a page's range may hold before it is cut further.
RANGE_ROWS = 1_000_000


def page(df: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    """One page in a total order; Spark keeps only offset + limit rows per task."""
    if limit <= 0 or offset < 0:
        raise ValueError("limit must be positive and offset must not be negative")
    ordered = df.orderBy(*order)
    return (ordered.offset(offset) if offset else ordered).limit(limit)


def page_with_total(
    df: DataFrame, order: list, limit: int, offset: int = 0, total: str = "total_count"
) -> DataFrame:
    """A page with the number of all rows beside it.

    The total is a scalar subquery: an unpartitioned window would move every
    row into one task.
    """
    count = df.agg(F.count(F.lit(1)).alias(total))
    return page(df, order, limit, offset).withColumn(total, count.scalar())


def newest(df: DataFrame, column: str, rows: int, *tie_break: str | Column) -> DataFrame:
    return page(df, [F.desc(column), *tie_break], rows)


def page_at(
    df: DataFrame, order: Sequence[str], limit: int, offset: int = 0,
    descending: Sequence[str] = (), range_rows: int = RANGE_ROWS, cells: int = CELLS,
) -> DataFrame:
    """The same rows as ``page``, at any depth, by sorting one range of the order only.

    Rows are counted in ranges of the first order column (integers, dates or
    timestamps), a prefix sum finds the ranges the page lies in, and they are cut
    again while they hold more than ``range_rows`` rows; a single value is cut by
    the next order column of such a type. NULLs come first, descending last. A
    count reads one column of the range it cuts, so the last sort is of at most
    about ``range_rows`` + ``limit`` rows unless they agree in all those columns.
    """
    if limit <= 0 or offset < 0:
        raise ValueError("limit must be positive and offset must not be negative")
    pieces, rows, ahead, names = [], df, offset, list(order)
    while names:
        try:
            spans = _spans(rows, names[0], cells, names[0] in descending)
        except ValueError:  # a type without ranges
            break
        chosen, ahead = _spans_of_page(spans, limit, ahead)
        if not chosen:
            return df.limit(0)
        (low, high, size), rest = chosen[0], chosen[1:]
        if rest:  # the page begins in one span and ends in others, of which it takes the first rows
            behind = _in_spans(rows, names[0], rest)
            pieces.append(_sorted_page(behind, order, descending, limit - (size - ahead), 0))
            limit = size - ahead
        rows = _in_spans(rows, names[0], chosen[:1])
        if size <= range_rows:
            break
        if low == high:
            names.pop(0)
        elif len(spans) == 1:  # nothing left that tells its rows apart
            break
    found = _sorted_page(rows, order, descending, limit, ahead)
    for piece in pieces:
        found = found.unionByName(piece)
    return found.orderBy(*_order(order, descending)) if pieces else found


def _order(order: Sequence[str], descending: Sequence[str]) -> list[Column]:
    return [F.desc(name) if name in descending else F.asc(name) for name in order]


def _sorted_page(rows, order, descending, limit, offset) -> DataFrame:
    return page(rows, _order(order, descending), limit, offset)


def _in_spans(rows: DataFrame, name: str, spans: list[tuple]) -> DataFrame:
    known = [(low, high) for low, high, _ in spans if low is not None]
    inside = F.col(f"`{name}`").isNull() if len(known) < len(spans) else None
    if known:
        bounds = within(rows, name, [(min(low for low, _ in known), max(high for _, high in known))])
        inside = bounds if inside is None else inside | bounds
    return rows.where(inside)


def _spans(rows: DataFrame, name: str, cells: int, down: bool) -> list[tuple]:
    """(low, high, rows) in the page's order; NULLs have no bounds. At most ``cells`` + 3."""
    found = [(r["low"], r["high"], r["row_count"]) for r in sorted(
        occupied_cells(rows, name, cells).collect(), key=lambda r: r["first"])]
    missing = rows.where(F.col(f"`{name}`").isNull()).count()
    spans = ([(None, None, missing)] if missing else []) + found
    return spans[::-1] if down else spans


def _spans_of_page(spans: list[tuple], limit: int, ahead: int) -> tuple[list[tuple], int]:
    """Spans the page lies in, and the rows of the first that come before the page."""
    chosen, before = [], 0
    for span in spans:
        if before + span[2] > ahead and before < ahead + limit:
            chosen.append((span, before))
        before += span[2]
    return [span for span, _ in chosen], ahead - (chosen[0][1] if chosen else 0)


def page_after(
    df: DataFrame, order: Sequence[str], last: Sequence, limit: int, descending: Sequence[str] = (),
) -> DataFrame:
    """The page behind the row whose order columns are ``last``: no row before it is sorted.

    The order columns must not be NULL and must tell rows apart.
    """
    if limit <= 0 or len(order) != len(last) or not order or None in last:
        raise ValueError("a page needs a positive limit and a value for each order column")
    beyond, equal, edge = F.lit(False), F.lit(True), None
    for name, value in zip(order, last):
        column, mark = F.col(f"`{name}`"), literal(value, df.schema[name].dataType)
        down = name in descending
        beyond = beyond | (equal & (column < mark if down else column > mark))
        equal = equal & (column == mark)
        if edge is None:  # bare, so that it reaches the scan
            edge = column <= mark if down else column >= mark
    return _sorted_page(df.where(edge & beyond), order, descending, limit, 0)
