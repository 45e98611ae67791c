"""Fingerprints kept up by differences: subtract the rows that went, add those that came.

Count and sum of row hashes are sums, and XOR is its own inverse, so the fingerprint of a
slice after a change follows from the one before and the changed rows alone. A base that does
not belong to the rows shows itself where a slice gets less than no rows, or has none left
and hashes all the same; otherwise it is as right as it was, and ``wrong_slices`` recounts
any slices asked for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slicesync.operators.fingerprint import MEASURES, classify, fingerprint
from slicesync.operators.slices import keep_slices

IS_WRONG = (
    "row_count < 0 OR checksum_sum < 0 OR (row_count = 0 AND (checksum_xor <> 0 OR checksum_sum <> 0))"
    " OR (row_count > 0 AND checksum_sum > row_count * 18446744073709551615BD)"
)


class WrongBase(ValueError):
    """Stored fingerprints that the changed rows cannot have come from."""


def change_prints(removed: DataFrame, added: DataFrame, keys: Sequence[str], columns: Sequence[str], **options) -> DataFrame:
    """What a change does to the fingerprints of the slices it touches. Both sides have ``keys``
    and ``columns`` (the hashed ones), of the same types."""
    gone = fingerprint(removed, keys, list(columns), **options)
    came = fingerprint(added, keys, list(columns), **options)
    minus = gone.select(
        *keys, (-F.col("row_count")).alias("row_count"), "checksum_xor",
        (-F.col("checksum_sum")).cast("decimal(38,0)").alias("checksum_sum"))
    return added_up(minus, came, keys)


def added_up(first: DataFrame, second: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The sum of two relations of fingerprints, or of fingerprints and changes."""
    columns = [*keys, *MEASURES]
    return first.select(*columns).unionByName(second.select(*columns)).groupBy(*keys).agg(
        F.sum("row_count").alias("row_count"), F.bit_xor("checksum_xor").alias("checksum_xor"),
        F.sum("checksum_sum").cast("decimal(38,0)").alias("checksum_sum"))


def moved_on(prints: DataFrame, change: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fingerprints after the change; slices without rows are gone, wrong ones are kept as such."""
    return added_up(prints, change, keys).where(f"row_count <> 0 OR {IS_WRONG}")


def refuse_wrong(prints: DataFrame, keys: Sequence[str]) -> None:
    wrong = prints.where(IS_WRONG).select(*keys).first()
    if wrong is not None:
        raise WrongBase(f"fingerprints do not belong to these rows, as at {wrong.asDict()}")


def wrong_slices(prints: DataFrame, rows: DataFrame, keys: Sequence[str], columns: Sequence[str],
                 of: DataFrame | None = None, **options) -> DataFrame:
    """Slices whose rows have another fingerprint; only those of ``of`` are read if it is given."""
    if of is not None:
        rows, prints = keep_slices(rows, of, keys), keep_slices(prints, of, keys)
    counted = fingerprint(rows, keys, list(columns), **options)
    return classify(counted, prints, keys).where("status <> 'unchanged'")
