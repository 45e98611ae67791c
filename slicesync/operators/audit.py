"""Audit events: masking, severity, filters."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slicesync.functions.periods import since_days
from slicesync.operators.events import filtered
from slicesync.operators.paging import newest

# Event types that are warnings.
WARNING_TYPES = ("auth_failure", "permission_denied", "delete_blocked")
TOKEN_PREFIX_CHARS = 8


def token_prefix(token: Column | str) -> Column:
    """First characters of a token; NULL for no token."""
    token = F.col(token) if isinstance(token, str) else token
    return F.when(
        F.length(token) > 0, F.concat(F.substring(token, 1, TOKEN_PREFIX_CHARS), F.lit("..."))
    )


def severity(event_type: Column | str) -> Column:
    event_type = F.col(event_type) if isinstance(event_type, str) else event_type
    return (
        F.when(event_type.isin(*WARNING_TYPES), "warning")
        .when(event_type.contains("failed"), "error")
        .otherwise("info")
    )


def audit_rows(raw: DataFrame) -> DataFrame:
    """Rows fit to be stored: the token itself never is."""
    return raw.withColumns(
        {"user_token_prefix": token_prefix("token"), "severity": severity("event_type")}
    ).drop("token")


def search(
    audit: DataFrame, action: str | None = None, share: str | None = None, limit: int = 100
) -> DataFrame:
    chosen = filtered(audit, {"action": action, "request.share_name": share})
    return newest(chosen, "event_time", limit, "event_id")


def accesses_by_recipient(
    audit: DataFrame, as_of: datetime, days: int = 7, action: str | None = None
) -> DataFrame:
    recent = filtered(audit, {"action": action}).where(since_days("event_time", as_of, days))
    return recent.groupBy(
        F.col("user_name").alias("recipient"), F.col("request.table_name").alias("table_name")
    ).agg(F.count(F.lit(1)).alias("query_count"))
