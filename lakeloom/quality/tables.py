"""The checks of each table after its load, and validators of the whole warehouse."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.functions.parse import shift_time
from lakeloom.operators import increment
from lakeloom.plans import layers
from lakeloom.quality import checks
from lakeloom.quality.checks import Finding
from lakeloom.schemas import INCREMENTAL, SNAPSHOT, SOURCE, TABLES
from lakeloom.session import Run
from lakeloom.sources.readers import Reader
from lakeloom.sources.storage import Store

#: Child table and key, parent table and key.
PARENTS = {
    "tickets": [(["book_ref"], "bookings", ["book_ref"])],
    "flights": [(["route_no"], "routes", ["route_no"])],
    "segments": [(["ticket_no"], "tickets", ["ticket_no"]), (["flight_id"], "flights", ["flight_id"])],
    "boarding_passes": [(["ticket_no", "flight_id"], "segments", ["ticket_no", "flight_id"])],
    "routes": [(["departure_airport"], "airports", ["airport_code"]), (["arrival_airport"], "airports", ["airport_code"]), (["airplane_code"], "airplanes", ["airplane_code"])],
    "seats": [(["airplane_code"], "airplanes", ["airplane_code"])],
}

#: References whose failure only warns: routes may name airplanes that come with a later batch.
LENIENT = {("routes", "airplanes")}


def _severity(child: str, parent: str) -> str:
    return checks.WARN if (child, parent) in LENIENT else checks.ERROR


def check_stage(store: Store, source: Reader, name: str, run: Run) -> list[Finding]:
    """The batch against its source window; keys unique and filled; parents in the same history."""
    stage, key = store.read(f"stg.{name}"), SOURCE[name][1]
    batch = stage.where(F.col("_load_id") == run.run_id)
    if name in SNAPSHOT:
        out = [checks.not_empty(f"stg.{name}.source", source(name)), checks.count_equal(f"stg.{name}.rows", source(name), batch)]
    else:
        mark = increment.high_water_mark(stage, "event_ts", run.run_id)
        rows, event = layers.incremental_source(source, name, mark)
        window = increment.newer(rows, event, mark)
        out = checks.window_equal(f"stg.{name}.window", window, batch)
    out += checks.judge(batch, checks.is_unique(f"stg.{name}.unique", key), checks.is_filled(f"stg.{name}.filled", key, key))
    for own, parent, theirs in PARENTS.get(name, []):
        there = store.read(f"stg.{parent}")
        if parent in SNAPSHOT:
            there = there.where(F.col("_load_id") == run.run_id)
        out.append(checks.references(f"stg.{name}.{parent}", batch, own, there, theirs, _severity(name, parent)))
    return checks.require(out)


def last_loaded(rows: DataFrame) -> DataFrame:
    """The rows that the last load wrote; all of an empty table's none."""
    last = rows.agg(F.max("_load_ts")).first()[0]
    return rows if last is None else rows.where(F.col("_load_ts") == F.lit(last.isoformat(sep=" ")).cast("timestamp_ntz"))


def touched(rows: DataFrame, keys: DataFrame, key: list[str] | tuple[str, ...]) -> DataFrame:
    """The rows of a large table that have one of a batch's keys: whether those are unique is known without shuffling the others."""
    return rows.join(keys.select(*key).distinct(), list(key), "left_semi")


def check_ods(store: Store, name: str, batch: str | None = None) -> list[Finding]:
    rows, key = store.read(f"ods.{name}"), SOURCE[name][1]
    table = TABLES[f"ods.{name}"]
    stage = store.read(f"stg.{name}")
    if name in SNAPSHOT:
        stage = stage.where(F.col("_load_id") == batch)
    else:  # what was staged last; of earlier batches their own checks told, and ``reconcile`` looks at all
        stage = last_loaded(stage)
    expected = layers.typed_rows(name, stage)
    scope = rows if name in SNAPSHOT else touched(rows, expected, key)
    out = checks.judge(scope, checks.is_unique(f"ods.{name}.unique", key), checks.is_filled(f"ods.{name}.filled", table.required))
    if name in SNAPSHOT:
        out += [*checks.same_keys(f"ods.{name}.covers", f"ods.{name}.extra", expected, rows, key), checks.not_empty(f"ods.{name}.batch", stage)]
    else:
        out.append(checks.covers(f"ods.{name}.covers", expected, rows, key))
    for own, parent, theirs in PARENTS.get(name, []):
        out.append(checks.references(f"ods.{name}.{parent}", rows, own, store.read(f"ods.{parent}"), theirs, _severity(name, parent)))
    return checks.require(out)


_COVERED = {"dim_airports": ("airports", "airport_code", "airport_bk"), "dim_airplanes": ("airplanes", "airplane_code", "airplane_bk"), "dim_tariffs": ("segments", "fare_conditions", "fare_conditions"), "dim_passengers": ("tickets", "passenger_id", "passenger_id")}


def check_dds(store: Store, name: str, least_days: int = 1000) -> list[Finding]:
    rows, table = store.read(f"dds.{name}"), TABLES[f"dds.{name}"]
    rules = [checks.is_filled(f"dds.{name}.filled", table.required)]
    if name != "fact_flight_sales":
        rules.insert(0, checks.is_unique(f"dds.{name}.unique", table.key))
    if name in _COVERED:
        rules.append(checks.is_unique(f"dds.{name}.sk", [rows.columns[0]]))
    if name == "dim_calendar":
        rules.append(checks.has_rows("dds.dim_calendar.days", least_days))
    if name == "fact_flight_sales":
        rules += [checks.is_rare(f"dds.fact.{c}", F.col(c).isNull()) for c in ("calendar_sk", "departure_airport_sk", "arrival_airport_sk")]
        rules.append(checks.is_filled("dds.fact.tariff_sk", ["tariff_sk"]))
        rules += [checks.is_filled(f"dds.fact.{c}", [c], severity=checks.INFO) for c in ("airplane_sk", "passenger_sk", "route_sk")]
    out = checks.judge(rows, *rules)
    if name in _COVERED:
        source, theirs, own = _COVERED[name]
        out.append(checks.covers(f"dds.{name}.covers", store.read(f"ods.{source}").where(F.col(theirs).isNotNull()), rows, [theirs], [own]))
    if name == "dim_calendar":
        out.append(checks.covers("dds.dim_calendar.covers", store.read("ods.flights").where("scheduled_departure IS NOT NULL").select(F.to_date("scheduled_departure").alias("d")), rows, ["d"], ["date_actual"]))
    if name == "dim_routes":
        out += checks.versions("dds.dim_routes", rows, "route_sk", "route_bk", store.read("ods.routes").select(F.col("route_no").alias("route_bk")))
    if name == "fact_flight_sales":
        out.append(checks.unique("dds.fact_flight_sales.unique", touched(rows, last_loaded(rows), table.key), table.key))
        out.append(checks.count_equal("dds.fact.rows", store.read("ods.segments"), rows))
    return checks.require(out)


def check_dm(store: Store, name: str, run_id: str | None = None) -> list[Finding]:
    rows, table = store.read(f"dm.{name}"), TABLES[f"dm.{name}"]
    rules = [checks.is_unique(f"dm.{name}.unique", table.key), checks.is_filled(f"dm.{name}.filled", table.required)]
    if "avg_load_factor" in rows.columns:
        rules.append(checks.load_rule(f"dm.{name}.load_factor"))
    out = checks.judge(rows, *rules)
    if name == "sales_report":
        out += checks.sales_invariants(rows if run_id is None else rows.where(F.col("_load_id") == run_id))
    return checks.require(out)


# validators


def validate_snapshot(store: Store, name: str) -> list[Finding]:
    """A snapshot holds exactly the batch it claims, and no other."""
    rows, key = store.read(f"ods.{name}"), SOURCE[name][1]
    batches = [r[0] for r in rows.select("_load_id").distinct().limit(2).collect()]
    one = Finding(f"{name}.one_batch", checks.ERROR, len(batches) == 1, len(batches), f"batches {batches}")
    if not one.ok:
        return checks.require([one])
    expected = layers.typed_rows(name, store.read(f"stg.{name}").where(F.col("_load_id") == batches[0]))
    own = checks.judge(rows, checks.is_unique(f"{name}.unique", key), checks.is_filled(f"{name}.keys", key))
    return checks.require([one, *checks.same_keys(f"{name}.missing", f"{name}.extra", expected, rows, key), *own])


def same_batch(store: Store, names: tuple[str, ...] = ("airplanes", "seats")) -> Finding:
    """Snapshots that are read together hold one and the same batch."""
    held = {n: sorted(r[0] for r in store.read(f"ods.{n}").select("_load_id").distinct().limit(2).collect()) for n in names}
    ok = len({tuple(x) for x in held.values()}) == 1 and all(len(x) == 1 for x in held.values())
    return Finding(f"{'_'.join(names)}.same_batch", checks.ERROR, ok, len(held), f"batches {held}")


def validate_dimensions(store: Store) -> list[Finding]:
    out = []
    for name, (source, theirs, own) in _COVERED.items():
        rows = store.read(f"dds.{name}")
        out += [checks.not_empty(f"{name}.rows", rows), checks.unique(f"{name}.unique", rows, [own]), checks.covers(f"{name}.covers", store.read(f"ods.{source}").where(F.col(theirs).isNotNull()), rows, [theirs], [own])]
    routes = store.read("dds.dim_routes")
    open_ = routes.where("valid_to IS NULL")
    out += [checks.filled("dim_airplanes.seats", store.read("dds.dim_airplanes"), ["total_seats"]), checks.covers("dim_routes.open", store.read("ods.routes"), open_, ["route_no"], ["route_bk"]), checks.unique("dim_routes.one_open", open_, ["route_bk"]), checks.no_gaps("dim_routes.gaps", routes, "route_bk")]
    return checks.require(out)


def validate_marts(store: Store) -> list[Finding]:
    out = []
    for name, table in TABLES.items():
        if name.startswith("dm."):
            rows = store.read(name)
            out += [checks.not_empty(f"{name}.rows", rows), checks.filled(f"{name}.keys", rows, table.key)]
    return checks.require(out)


def single_version(dim: DataFrame, bk: str) -> DataFrame:
    """The least business key that has exactly one version, if any."""
    return dim.groupBy(bk).agg(F.count(F.lit(1)).alias("n")).where("n = 1").orderBy(bk).limit(1)


def scd2_active_test(store: Store, run: Run, load: Callable[[Store, Run], None] = layers.load_routes) -> list[Finding]:
    """Change one route's departure time, load, look for exactly one new version.

    All of it happens in a clone of the four tables that the load reads, so that a driver that dies leaves no planted row, and
    checks that run beside it see the tables as they are.
    """
    root = f"{store.root}/_clones/{uuid.uuid4().hex}"
    try:
        trial = store.clone(root, ("ods.routes", "dds.dim_routes", "dds.dim_airports", "dds.dim_airplanes"))
        routes = trial.read("ods.routes")
        chosen = single_version(trial.read("dds.dim_routes"), "route_bk").collect()
        if not chosen:
            raise LookupError("no route has exactly one version")
        route = chosen[0]["route_bk"]
        trial.replace("ods.routes", routes.withColumn("departure_time", F.when(F.col("route_no") == route, shift_time("departure_time", 3600)).otherwise(F.col("departure_time"))))
        load(trial, run)
        after = trial.read("dds.dim_routes").where(F.col("route_bk") == route)
        n, hashes, open_ = after.agg(F.count(F.lit(1)), F.count_distinct("hashdiff"), F.count_if(F.col("valid_to").isNull())).first()
        return checks.require(
            [
                Finding("scd2.versions", checks.ERROR, n == 2, n, f"{n} versions, not 2"),
                Finding("scd2.open", checks.ERROR, open_ == 1, n, "not exactly one open version"),
                Finding("scd2.hash", checks.ERROR, hashes == 2, hashes, "the hashes don't differ"),
                checks.no_gaps("scd2.gaps", after, "route_bk"),
            ]
        )
    finally:
        store.files.delete(root)


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of each table."""
    return reduce(DataFrame.unionByName, [rows.agg(F.lit(n).alias("table_name"), F.count(F.lit(1)).alias("n")) for n, rows in tables.items()])


def scorecard(store: Store) -> DataFrame:
    return counts({n: store.read(n) for n in TABLES})


def reconcile(store: Store) -> list[Finding]:
    """Layer against layer: staged keys in the current state, revenue and boarded totals of fact and mart."""
    out = []
    for name in INCREMENTAL:
        out.append(checks.covers(f"{name}.parity", layers.typed_rows(name, store.read(f"stg.{name}")), store.read(f"ods.{name}"), SOURCE[name][1]))
    fact = store.read("dds.fact_flight_sales").where("calendar_sk IS NOT NULL AND departure_airport_sk IS NOT NULL AND arrival_airport_sk IS NOT NULL AND tariff_sk IS NOT NULL")
    a = fact.agg(F.sum("price"), F.count_if("is_boarded")).first()
    b = store.read("dm.sales_report").agg(F.sum("total_revenue"), F.sum("passengers_boarded")).first()
    out.append(Finding("revenue", checks.ERROR, (a[0] or 0) == (b[0] or 0), 0, f"fact {a[0]}, mart {b[0]}"))
    out.append(Finding("boarded", checks.ERROR, (a[1] or 0) == (b[1] or 0), 0, f"fact {a[1]}, mart {b[1]}"))
    return checks.require(out)


_ORPHANS = {"calendar_sk": "dim_calendar", "departure_airport_sk": "dim_airports", "arrival_airport_sk": "dim_airports", "airplane_sk": "dim_airplanes", "tariff_sk": "dim_tariffs", "passenger_sk": "dim_passengers", "route_sk": "dim_routes"}


def fact_orphans(fact: DataFrame, dims: dict[str, DataFrame]) -> DataFrame:
    """For each key of the fact the rows whose key no dimension row has; nulls aren't looked up."""
    parts = []
    for column, name in _ORPHANS.items():
        dim = dims[name.removeprefix("dim_")]
        own = fact.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("k")).agg(F.count(F.lit(1)).alias("n"))
        lost = own.join(dim.select(F.col("calendar_sk" if name == "dim_calendar" else dim.columns[0]).alias("k")), "k", "left_anti")
        parts.append(lost.agg(F.lit(column).alias("key_column"), F.coalesce(F.sum("n"), F.lit(0)).alias("orphans")))
    return reduce(DataFrame.unionByName, parts)


def parity(ods: dict[str, DataFrame], fact: DataFrame) -> DataFrame:
    """Rows, revenue and boarded passengers of the current state and of the fact, side by side."""
    segments = ods["segments"].agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("revenue"))
    passes = ods["boarding_passes"].agg(F.count(F.lit(1)).alias("boarded"))
    facts = fact.agg(F.count(F.lit(1)).alias("n"), F.sum("price").alias("revenue"), F.count_if("is_boarded").alias("boarded"))
    return segments.crossJoin(passes).withColumn("layer", F.lit("ods")).unionByName(facts.withColumn("layer", F.lit("dds")))  # one row each


def recent_duplicates(stage: DataFrame, key: list[str], run: Run, days: int = 5) -> DataFrame:
    """Keys staged more than once within the last days, whatever runs staged them."""
    since = run.ts() - F.make_dt_interval(F.lit(days))
    return checks.duplicate_keys(stage.where((F.col("_load_ts") > since) & (F.col("_load_ts") <= run.ts())), key)


def qa(store: Store, run: Run) -> list[Finding]:
    """Parity of layers, orphan keys, snapshots of one batch, keys staged twice within five days."""
    ods = {n: store.read(f"ods.{n}") for n in ("segments", "boarding_passes")}
    fact = store.read("dds.fact_flight_sales")
    a, b = (r for r in parity(ods, fact).orderBy("layer").collect())
    out = [Finding("qa.parity", checks.ERROR, a["n"] == b["n"] and a["revenue"] == b["revenue"], abs(a["n"] - b["n"]), f"dds {tuple(a)}, ods {tuple(b)}")]
    lost = {r["key_column"]: r["orphans"] for r in fact_orphans(fact, layers.dims_of(store)).collect()}
    out += [Finding(f"qa.orphans.{k}", checks.ERROR, not n, n, f"{n} rows of the fact have a key that no row has") for k, n in lost.items()]
    out.append(same_batch(store))
    out += [Finding(f"qa.recent.{n}", checks.WARN, not (k := recent_duplicates(store.read(f"stg.{n}"), list(SOURCE[n][1]), run).count()), k, f"{k} keys were staged more than once") for n in INCREMENTAL]
    return checks.require(out)


def as_rows(spark: SparkSession, findings: list[Finding]) -> DataFrame:
    """Findings as a table."""
    return spark.createDataFrame([(f.check, f.severity, f.ok, float(f.value)) for f in findings], "check_name string, severity string, ok boolean, value double")
