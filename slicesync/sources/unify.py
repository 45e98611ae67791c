"""Concatenate parts whose schemas differ."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def unified_schema(parts: Sequence[DataFrame]) -> T.StructType:
    """For each column the first type that is not the null type, in order of appearance."""
    types: dict[str, T.DataType] = {}
    for part in parts:
        for field in part.schema.fields:
            if field.name not in types or isinstance(types[field.name], T.NullType):
                types[field.name] = field.dataType
    return T.StructType([T.StructField(name, kind) for name, kind in types.items()])


def cast_to(df: DataFrame, schema: T.StructType, failures: str | None = None) -> DataFrame:
    """Cast by name; a value that does not fit becomes NULL, an absent column is NULL.

    With ``failures`` a column of that name counts the values lost per row.
    """
    columns, lost = [], []
    have = {field.name: field.dataType for field in df.schema.fields}
    for field in schema.fields:
        if field.name not in have:
            columns.append(F.lit(None).cast(field.dataType).alias(field.name))
        elif have[field.name] == field.dataType:
            columns.append(F.col(f"`{field.name}`"))
        else:
            source = F.col(f"`{field.name}`")
            target = source.try_cast(field.dataType)
            columns.append(target.alias(field.name))
            lost.append((source.isNotNull() & target.isNull()).cast("int"))
    if failures:
        columns.append((sum(lost, F.lit(0)) if lost else F.lit(0)).alias(failures))
    return df.select(*columns)


def concat_parts(parts: Sequence[DataFrame], failures: str | None = None) -> DataFrame:
    """One relation out of many parts, with the unified schema."""
    if not parts:
        raise ValueError("nothing to concatenate")
    schema = unified_schema(parts)
    combined = None
    for part in parts:
        aligned = cast_to(part, schema, failures)
        combined = aligned if combined is None else combined.unionByName(aligned)
    return combined
