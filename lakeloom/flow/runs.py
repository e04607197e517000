"""Whole loads as task graphs: staging, current state, star schema, marts, validation."""

from __future__ import annotations

from datetime import date

from lakeloom.flow.graph import Graph, Outcome, Task
from lakeloom.operators.increment import resolve_batch
from lakeloom.plans import layers
from lakeloom.quality import tables
from lakeloom.schemas import INCREMENTAL, SNAPSHOT
from lakeloom.session import Run
from lakeloom.sources.readers import Reader
from lakeloom.sources.storage import Store

#: Loads that wait for others. A table's check follows its load.
STAGE_AFTER = {"tickets": ("bookings",), "segments": ("tickets", "flights"), "boarding_passes": ("segments",), "routes": ("airports", "airplanes"), "seats": ("airplanes",), "flights": ("routes",)}
ODS_AFTER = {"tickets": ("bookings",), "routes": ("airports", "airplanes"), "flights": ("routes",), "segments": ("flights", "tickets"), "boarding_passes": ("segments",), "seats": ("airplanes",)}
DIMS = ("airports", "airplanes", "tariffs", "passengers")
MARTS = ("sales_report", "airport_traffic", "route_performance", "monthly_overview", "passenger_loyalty")


def _pair(name: str, load, check, after: tuple[str, ...] = (), retries: int = 1, delay: float = 30.0) -> list[Task]:
    return [Task(f"load_{name}", load, after, retries, delay), Task(f"check_{name}", check, (f"load_{name}",), retries, delay)]


def stage_graph(store: Store, source: Reader, run: Run, delay: float = 30.0) -> Graph:
    tasks = []
    for n in (*INCREMENTAL, *SNAPSHOT):
        after = tuple(f"check_{x}" for x in STAGE_AFTER.get(n, ()))
        tasks += _pair(n, lambda n=n: layers.load_stage(store, source, n, run), lambda n=n: tables.check_stage(store, source, n, run), after, delay=delay)
    return Graph(tasks)


def ods_graph(store: Store, run: Run, batch: str | None = None, delay: float = 30.0) -> Graph:
    chosen: list[str] = []

    def resolve() -> str:
        chosen.append(resolve_batch([store.read(f"stg.{n}") for n in SNAPSHOT], batch))
        return chosen[0]

    tasks = [Task("resolve_batch", resolve, (), 1, delay)]
    for n in (*INCREMENTAL, *SNAPSHOT):
        after = ("resolve_batch", *(f"check_{x}" for x in ODS_AFTER.get(n, ())))
        load = (lambda n=n: layers.load_snapshot(store, n, chosen[0], run)) if n in SNAPSHOT else (lambda n=n: layers.load_current(store, n))
        tasks += _pair(n, load, lambda n=n: tables.check_ods(store, n, chosen[0]), after, delay=delay)
    return Graph(tasks)


def dds_graph(store: Store, run: Run, days: tuple[date, date] | None = None, rebuild: bool = False, delay: float = 30.0) -> Graph:
    load = {n: getattr(layers, f"load_{n}") for n in DIMS}
    tasks = _pair("calendar", lambda: layers.load_calendar(store, *(days or ())), lambda: tables.check_dds(store, "dim_calendar"), delay=delay)
    for n in DIMS:
        tasks += _pair(n, lambda n=n: load[n](store, run), lambda n=n: tables.check_dds(store, f"dim_{n}"), ("check_calendar",), delay=delay)
    tasks += _pair("routes", lambda: layers.load_routes(store, run), lambda: tables.check_dds(store, "dim_routes"), ("check_airports", "check_airplanes"), delay=delay)
    before = tuple(f"check_{n}" for n in (*DIMS, "routes"))
    return Graph(tasks + _pair("fact", lambda: layers.load_fact(store, run, rebuild), lambda: tables.check_dds(store, "fact_flight_sales"), before, delay=delay))


def dm_graph(store: Store, run: Run, delay: float = 30.0) -> Graph:
    tasks = []
    for n in MARTS:
        load = (lambda: layers.load_route_performance(store, run)) if n == "route_performance" else (lambda n=n: layers.load_mart(store, n, run))
        tasks += _pair(n, load, lambda n=n: tables.check_dm(store, n, run.run_id), delay=delay)
    return Graph(tasks)


def validate_graph(store: Store, run: Run) -> Graph:
    snapshots = [Task(f"validate_{n}", lambda n=n: tables.validate_snapshot(store, n), (), 0) for n in SNAPSHOT]
    ends = [Task("validate_dimensions", lambda: tables.validate_dimensions(store), tuple(t.name for t in snapshots), 0), Task("same_batch", lambda: tables.checks.require([tables.same_batch(store)]), (), 0), Task("qa", lambda: tables.qa(store, run), (), 0), Task("validate_marts", lambda: tables.validate_marts(store), (), 0), Task("reconcile", lambda: tables.reconcile(store), (), 0)]
    return Graph([*snapshots, *ends, Task("scd2_active_test", lambda: tables.scd2_active_test(store, run), ("validate_dimensions",), 0)])


def run_all(store: Store, source: Reader, run: Run, days: tuple[date, date] | None = None, threads: int = 4, delay: float = 0.0) -> list[Outcome]:
    """Staging, current state, star schema and marts, one after the other, under the store's lock; then the tables' upkeep."""
    with store.lock():
        graphs = (lambda: stage_graph(store, source, run, delay), lambda: ods_graph(store, run, delay=delay), lambda: dds_graph(store, run, days, delay=delay), lambda: dm_graph(store, run, delay))
        out = [g().run(threads).check() for g in graphs]
        for name in store.tables:
            store.maintain(name)
        return out
