"""Every operator as a runnable query over the test tables, beside its SQL."""

from slicesync.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]


def load_all() -> None:
    from slicesync.queries import (  # noqa: F401
        aggregates,
        filters,
        joins,
        narrowing,
        pages,
        projections,
        queue,
        scans,
        sync,
        versions,
    )


load_all()
