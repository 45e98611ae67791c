"""Table permissions: who may read, write or delete how much."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PERMISSION_SCHEMA = "user_name string, table_name string, access string, max_delete_rows long"
ANY_TABLE = "*"

# Which granted access covers which requested access.
COVERS = {
    "read": ("read", "read_write"),
    "write": ("write", "read_write"),
    "read_write": ("read_write",),
}


def covers(granted: Column, requested: Column) -> Column:
    condition = F.lit(False)
    for access, grants in COVERS.items():
        condition = condition | ((requested == access) & granted.isin(*grants))
    return F.coalesce(condition, F.lit(False))


def decide(
    requests: DataFrame, permissions: DataFrame, access: str | Column = "access"
) -> DataFrame:
    """Each request with ``granted``, ``delete_cap`` and ``decision``.

    A grant on the table itself decides; a grant on ``*`` only where there is
    none. Requests carry ``user_name``, ``table_name`` and, for deletes,
    ``delete_rows``. Permissions must be unique per user and table.
    """
    wanted = F.col(access) if isinstance(access, str) else access
    asked = requests.withColumn("_wanted", wanted)
    own = permissions.where(F.col("table_name") != ANY_TABLE).select(
        F.col("user_name").alias("_u1"), F.col("table_name").alias("_t1"),
        F.col("access").alias("_a1"), F.col("max_delete_rows").alias("_m1"),
    )
    anywhere = permissions.where(F.col("table_name") == ANY_TABLE).select(
        F.col("user_name").alias("_u2"), F.col("access").alias("_a2"),
        F.col("max_delete_rows").alias("_m2"),
    )
    has_own = F.col("_u1").isNotNull()
    granted_access = F.when(has_own, F.col("_a1")).otherwise(F.col("_a2"))
    cap = F.when(has_own, F.col("_m1")).otherwise(F.col("_m2"))
    granted = covers(granted_access, F.col("_wanted"))
    too_many = cap.isNotNull() & (F.col("delete_rows") > cap)
    if "delete_rows" not in requests.columns:
        too_many = F.lit(False)
    decision = (
        F.when(~granted, "blocked").when(F.coalesce(too_many, F.lit(False)), "blocked")
        .otherwise("allowed")
    )
    reason = F.when(~granted, "access denied").when(
        F.coalesce(too_many, F.lit(False)), "delete limit exceeded"
    )
    return (
        asked.join(own, (F.col("user_name") == F.col("_u1")) & (F.col("table_name") == F.col("_t1")),
                   "left")
        .join(anywhere, F.col("user_name") == F.col("_u2"), "left")
        .select(
            *[asked[name] for name in requests.columns],
            granted.alias("granted"),
            cap.alias("delete_cap"),
            decision.alias("decision"),
            reason.alias("reason"),
        )
    )


def accessible_tables(
    permissions: DataFrame, user_name: str, access: str | None = None
) -> DataFrame:
    own = permissions.where(F.col("user_name") == user_name)
    if access is not None:
        own = own.where(covers(F.col("access"), F.lit(access)))
    return own.select("table_name")
