"""Row hashes and the aggregates that make a slice fingerprint.

A fingerprint is (count, XOR of hashes, sum of hashes). XOR alone cancels equal
pairs, so a swap of one duplicated row for another would go unseen; the sum
does not cancel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HASH_METHODS = ("xxhash64", "md5")

# The unsigned sum is kept in three lanes of plain long additions (22 bits
# each), which stay inside generated code and cannot overflow below 2^41 rows
# per slice; they are put together once per slice.
_LANE_BITS = 22
_LANE_MASK = (1 << _LANE_BITS) - 1


def _as_json(column: Column) -> Column:
    """Nested values as text in which NULLs stay where they are."""
    return F.to_json(column, {"ignoreNullFields": "false"})


def _portable_text(field: T.StructField, scale: int | None) -> Column:
    """Framed text of a value that other SQL engines produce too.

    The length comes before the text, and NULL has no length, so no value can
    pass for another or for the end of its neighbour.
    """
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        if scale is None:
            raise ValueError(f"column {field.name!r} is binary floating point; name a scale")
        column = column.cast(f"decimal(38,{scale})")
    elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        column = _as_json(column)
    text = column.cast("string")
    framed = F.concat(F.char_length(text).cast("string"), F.lit(":"), text)
    return F.coalesce(framed, F.lit("N"))


def _hashable(field: T.StructField) -> list[Column]:
    """Inputs of xxhash64 for one column; it skips NULLs, so they get a flag."""
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        column = _as_json(column)
    return [column, column.isNull()] if field.nullable else [column]


def row_hash(
    df: DataFrame, columns: list[str] | None = None, method: str = "xxhash64",
    scale: int | None = None,
) -> Column:
    """A 64-bit hash of the row: ``xxhash64`` (fast) or ``md5`` (portable).

    ``md5`` needs the decimal ``scale`` at which binary floating point values
    count as equal; ``xxhash64`` takes them bit by bit.
    """
    fields = [df.schema[name] for name in (columns or df.columns)]
    if method == "xxhash64":
        return F.xxhash64(*[part for field in fields for part in _hashable(field)])
    if method == "md5":
        text = F.concat(*[_portable_text(field, scale) for field in fields])
        return F.conv(F.substring(F.md5(text), 1, 16), 16, -10).cast("long")
    raise ValueError(f"unknown hash method {method!r}; use one of {HASH_METHODS}")


def made_by(df: DataFrame, method: str = "xxhash64", scale: int | None = None) -> str:
    """How a hash of ``df`` is made: equal texts mean comparable fingerprints."""
    columns = ",".join(f"{f.name}:{f.dataType.simpleString()}{'?' if f.nullable else ''}" for f in df.schema)
    return f"{method}({columns})" if scale is None else f"{method}/{scale}({columns})"


def fingerprint_aggregates(hash_column: str = "_row_hash") -> list[Column]:
    """Aggregates over the row hash; finish with :func:`finish_fingerprint`."""
    value = F.col(hash_column)
    lanes = [
        F.sum(F.shiftrightunsigned(value, _LANE_BITS * i).bitwiseAND(F.lit(_LANE_MASK)))
        for i in range(3)
    ]
    return [
        F.count(F.lit(1)).alias("row_count"),
        F.bit_xor(value).alias("checksum_xor"),
        *[lane.alias(f"_lane{i}") for i, lane in enumerate(lanes)],
    ]


def finish_fingerprint(df: DataFrame) -> DataFrame:
    """Replace the three lanes by ``checksum_sum``, their weighted total."""
    total = sum(
        F.col(f"_lane{i}").cast("decimal(20,0)")
        * F.lit(str(1 << (_LANE_BITS * i))).cast("decimal(14,0)")
        for i in range(3)
    )
    return df.withColumn("checksum_sum", total.cast("decimal(38,0)")).drop(
        "_lane0", "_lane1", "_lane2"
    )
