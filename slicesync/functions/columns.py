"""Column-level helpers: names, defaults, labels, allow-listed expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lower_case_names(df: DataFrame) -> DataFrame:
    """Lower-case all names; two names that fall together are an error."""
    names = [name.lower() for name in df.columns]
    clashes = sorted({name for name in names if names.count(name) > 1})
    if clashes:
        raise ValueError(f"names differ only in case: {', '.join(clashes)}")
    return df.toDF(*names)


def default_zero(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(0))


def code_label(column: str, labels: Mapping[object, str]) -> Column:
    """Label of a code, NULL for codes that are not listed."""
    chosen = None
    for code, label in labels.items():
        chosen = (F if chosen is None else chosen).when(F.col(column) == code, F.lit(label))
    if chosen is None:
        raise ValueError("no labels given")
    return chosen


def self_lookup(df: DataFrame, column: str, names: Sequence[str]) -> DataFrame:
    """A lookup table whose id, label and description are the value itself."""
    values = df.where(F.col(column).isNotNull()).select(F.col(column).alias(names[0])).distinct()
    return values.select(*[F.col(names[0]).alias(name) for name in names])


def allowed_expression(name: str, allowed: Mapping[str, str]) -> Column:
    """The expression registered under ``name``; callers never pass free text."""
    if name not in allowed:
        raise KeyError(f"expression {name!r} is not allowed; known: {', '.join(sorted(allowed))}")
    return F.expr(allowed[name])


def null_safe_equal(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """AND of ``left.k <=> right.k``: NULL is a key like any other."""
    condition = None
    for key in keys:
        term = left[key].eqNullSafe(right[key])
        condition = term if condition is None else condition & term
    if condition is None:
        raise ValueError("no key columns given")
    return condition
