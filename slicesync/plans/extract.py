"""Extractions: what to read of a source table, and which way to synchronise it."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slicesync.functions import periods as P
from slicesync.functions.columns import lower_case_names
from slicesync.plans.differential import DiffSyncStats, full_sync, run_differential_sync
from slicesync.plans.fingerprints import FingerprintStore
from slicesync.plans.incremental import run_incremental_sync
from slicesync.plans.slice_source import FrameSource
from slicesync.sources.tables import row_cap
from slicesync.sources.versions import VersionedTable


@dataclass(frozen=True)
class TimeFilter:
    """Which rows of a fact table lie in the lookback.

    ``kind``: ``periods`` (YYYYMM start..end), ``since_period``, ``years``
    (start..end), ``since_year``, ``since_year_of`` (year of a timestamp),
    ``since_months``, ``since_days`` (needs ``days``) or ``dates`` (start..end).
    """

    kind: str
    column: str
    days: int | None = None

    def condition(self, as_of: datetime, lookback_months: int) -> Column:
        params = P.template_params(as_of, lookback_months)
        rules: dict[str, Callable[[], Column]] = {
            "periods": lambda: P.in_periods(
                self.column, params["start_period"], params["end_period"]
            ),
            "since_period": lambda: P.since_period(self.column, as_of, lookback_months),
            "years": lambda: P.in_years(self.column, params["start_year"], params["end_year"]),
            "since_year": lambda: P.since_year(self.column, as_of, lookback_months),
            "since_year_of": lambda: P.since_year_of(self.column, as_of, lookback_months),
            "since_months": lambda: P.since_months(self.column, as_of, lookback_months),
            "since_days": lambda: P.since_days(self.column, as_of, self.days),
            "dates": lambda: P.between_moments(
                self.column, params["start_date"], params["end_date"]
            ),
        }
        if self.kind not in rules:
            raise ValueError(f"unknown time filter {self.kind!r}")
        return rules[self.kind]()


@dataclass(frozen=True)
class Extraction:
    """One output table: columns, computed columns and filters over one source.

    Without ``columns`` all columns of the tenant's source are taken, since
    tenants differ in what they have. ``columns`` maps output to source names
    where a mapping is given. ``computed`` holds SQL expressions.
    """

    name: str
    source: str | None = None
    columns: tuple[str, ...] | Mapping[str, str] | None = None
    computed: Mapping[str, str] = field(default_factory=dict)
    time: TimeFilter | None = None
    where: str | None = None
    distinct: bool = False

    def build(
        self,
        table: DataFrame,
        as_of: datetime,
        lookback_months: int = P.DEFAULT_LOOKBACK_MONTHS,
        limit: int | None = None,
    ) -> DataFrame:
        if self.time is not None:
            table = table.where(self.time.condition(as_of, lookback_months))
        if self.where:
            table = table.where(self.where)
        if isinstance(self.columns, Mapping):
            chosen = [F.col(src).alias(out) for out, src in self.columns.items()]
        else:
            chosen = [F.col(name) for name in (self.columns or table.columns)]
        chosen += [F.expr(text).alias(out) for out, text in self.computed.items()]
        result = table.select(*chosen)
        return row_cap(lower_case_names(result.distinct() if self.distinct else result), limit)


# The fact tables of the household panel and how each limits its
# history. Every other table of the panel is a dimension and is read whole.
PANEL_FACTS = {
    "dolar": TimeFilter("periods", "periodo"),
    "domicilio_posse_bens": TimeFilter("since_year_of", "data"),
    "hato_cabecalho": TimeFilter("since_months", "data_compra"),
    "hato_ruim_cabecalho": TimeFilter("since_days", "data_criacao", days=90),
    "j_atoscompra_new": TimeFilter("periods", "periodo"),
    "loc_psdata_compras": TimeFilter("since_months", "feviaje"),
    "mordom": TimeFilter("years", "ano"),
    "nac_ato": TimeFilter("since_months", "datacoleta"),
    "pre_mordom": TimeFilter("years", "ano"),
    "rg_domicilios_pesos": TimeFilter("years", "ano"),
    "rg_panelis": TimeFilter("years", "ano"),
    "rg_pets": TimeFilter("years", "ano"),
}


def panel_extraction(table_name: str, **overrides) -> Extraction:
    """The extraction of a panel table; a tenant's deviations come as overrides."""
    settings = {"name": table_name, "time": PANEL_FACTS.get(table_name), **overrides}
    return Extraction(**settings)


def choose_mode(
    force_full: bool = False, differential: dict | None = None, incremental: dict | None = None
) -> str:
    """A forced full run wins, then differential, then incremental, else full."""
    if force_full:
        return "full"
    if differential:
        return "differential"
    return "incremental" if incremental else "full"


def synchronise(
    source: DataFrame,
    target: VersionedTable,
    store: FingerprintStore,
    *,
    country: str,
    table_name: str,
    force_full: bool = False,
    differential: dict | None = None,
    incremental: dict | None = None,
    keep_when_empty: bool = False,
    as_of: datetime | None = None,
    job_id: str = "",
) -> dict:
    """Run one table in the mode its configuration asks for; returns what was done.

    A full run of no rows writes an empty table unless ``keep_when_empty``. A
    forced full run leaves the fingerprints of what it wrote, so that the
    configured mode goes on from there.
    """
    mode = choose_mode(force_full, differential, incremental)
    if mode == "differential":
        stats = run_differential_sync(
            source, target, store, country=country, table_name=table_name,
            as_of=as_of, job_id=job_id, **differential,
        )
        return {"mode": mode, "rows": stats.rows_downloaded, "version": stats.version}
    if mode == "incremental":
        result = run_incremental_sync(
            source, target, store, country=country, table_name=table_name,
            as_of=as_of, job_id=job_id, **incremental,
        )
        return {"mode": mode, "rows": result.rows_window + result.rows_new,
                "version": result.version}
    if keep_when_empty and target.exists() and source.isEmpty():
        return {"mode": mode, "rows": 0, "version": None}
    if differential:
        slices = FrameSource(source, differential["level1"], differential["level2"])
        stats = full_sync(slices, target, store, DiffSyncStats(table_name, country), job_id)
        return {"mode": mode, "rows": stats.rows_downloaded, "version": stats.version}
    if incremental:
        result = run_incremental_sync(
            source, target, store, country=country, table_name=table_name,
            as_of=as_of, job_id=job_id, force_full=True, **incremental,
        )
        return {"mode": mode, "rows": result.rows_new, "version": result.version}
    store.forget(country, table_name)
    version = target.overwrite(source, operation="full", job_id=job_id)
    return {"mode": mode, "rows": target.rows_written(version), "version": version}
