"""Loads of the four layers, one function for each table; each reads and writes a store.

Deltas are made stable before their target is replaced, so that a mark is never read from rows
that the same load wrote.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from datetime import date, datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.functions import parse
from lakeloom.operators import dimension, increment, merge, recompute
from lakeloom.plans import marts
from lakeloom.schemas import INCREMENTAL, SNAPSHOT, SOURCE, TABLES, source_schema
from lakeloom.session import Run
from lakeloom.sources.readers import DATED, Jdbc, Reader
from lakeloom.sources.storage import Store, scratched, stable

# staging


def incremental_source(source: Reader, name: str, mark: datetime | None = None) -> tuple[DataFrame, str]:
    """Source rows with the column that dates them, those above a mark alone if there is one.

    A source that can cut its increments does so; of others the dating table is cut before it is joined.
    """
    event = DATED.get(name, "book_date")
    if mark is not None and hasattr(source, "increment"):
        return source.increment(name, mark), event
    cut = (lambda rows, c: rows) if mark is None else (lambda rows, c: increment.newer(rows, c, mark))
    if name in DATED:
        return cut(source(name), event), event
    bookings = cut(source("bookings").select("book_ref", "book_date"), "book_date")
    if name == "tickets":
        return source(name).join(bookings, "book_ref"), event
    dated = source("tickets").select("ticket_no", "book_ref").join(bookings, "book_ref").select("ticket_no", "book_date")
    return source(name).join(dated, "ticket_no"), event


@scratched
def load_stage(store: Store, source: Reader, name: str, run: Run) -> None:
    """Append what is new. The mark is read from the staged rows without this run's, so that a retry sees the same window."""
    business = source_schema(name).fieldNames()
    key = SOURCE[name][1]
    target = store.read(f"stg.{name}")
    if name in SNAPSHOT:
        rows = increment.snapshot_append(source(name), target, key, business, run)
    else:
        mark = increment.high_water_mark(target, "event_ts", run.run_id)
        dated, event = incremental_source(source, name, mark)
        rows = increment.hwm_append(dated, target, key, event, business, run, all_history=name == "tickets", mark=mark)
    store.append(f"stg.{name}", rows)


def load_first(store: Store, source: Jdbc, name: str, run: Run, column: str, parts: int, threads: int = 4) -> int:
    """The first load of a large source table, in parts of equal rows that are read side by side.

    Where the database cuts is kept with the table, and each part is committed as a batch of this run. So a load that was
    stopped goes on with the parts that are lacking when it is called again with its run, and a whole one adds nothing. How many
    parts there are is returned.
    """
    table, writer = f"stg.{name}", f"first.{run.run_id}"
    cuts = store.note(table, f"{writer}.{column}")
    if cuts is None:
        cuts = store.note(table, f"{writer}.{column}", json.dumps(source.cuts(store.spark, name, column, parts)))
    kind = source_schema(name)[column].dataType.typeName()
    conditions = source.predicates(f"r.{column}", json.loads(cuts), kind == "string" and column not in source.numbers.get(name, ()))
    business = source_schema(name).fieldNames()

    def load(k: int) -> None:
        rows, event = source.part(store.spark, name, conditions[k])
        store.append(table, increment.staged(rows, business, event, run), batch=(f"{writer}.{k}", 0))

    with ThreadPoolExecutor(threads) as pool:
        list(pool.map(load, range(len(conditions))))
    return len(conditions)


# current state


def _ods_columns(name: str) -> dict[str, F.Column]:
    t, text = parse.typed, lambda c: parse.blank_to_null(c)
    return {
        "bookings": lambda: {"book_ref": F.col("book_ref"), "book_date": t("book_date", "timestamp"), "total_amount": t("total_amount", "decimal(10,2)")},
        "tickets": lambda: {"ticket_no": F.col("ticket_no"), "book_ref": F.col("book_ref"), "passenger_id": F.col("passenger_id"), "passenger_name": F.col("passenger_name"), "is_outbound": t("outbound", "boolean")},
        "flights": lambda: {"flight_id": t("flight_id", "int"), "route_no": F.col("route_no"), "status": F.col("status")} | {c: t(c, "timestamp") for c in ("scheduled_departure", "scheduled_arrival", "actual_departure", "actual_arrival")},
        "segments": lambda: {"ticket_no": F.col("ticket_no"), "flight_id": t("flight_id", "int"), "fare_conditions": F.col("fare_conditions"), "amount": t("price", "decimal(10,2)")},
        "boarding_passes": lambda: {"ticket_no": F.col("ticket_no"), "flight_id": t("flight_id", "int"), "seat_no": F.col("seat_no"), "boarding_no": t("boarding_no", "int"), "boarding_time": t("boarding_time", "timestamp")},
        "airports": lambda: {"airport_code": F.col("airport_code")} | {c: parse.localised(c) for c in ("airport_name", "city", "country")} | {"coordinates": text("coordinates"), "timezone": text("timezone")},
        "airplanes": lambda: {"airplane_code": F.col("airplane_code"), "model": parse.localised("model", fallback=True), "range_km": t("range", "int"), "speed_kmh": t("speed", "int")},
        "routes": lambda: {c: F.col(c) for c in ("route_no", "validity", "departure_airport", "arrival_airport", "airplane_code")} | {"days_of_week": parse.int_array("days_of_week"), "departure_time": parse.clock_time(text("scheduled_time")), "duration": parse.interval("duration")},
        "seats": lambda: {c: F.col(c) for c in ("airplane_code", "seat_no", "fare_conditions")},
    }[name]()


def typed_rows(name: str, rows: DataFrame, *lineage: F.Column | str) -> DataFrame:
    """Staged rows with the types and names of the current state."""
    return rows.select(*[c.alias(n) for n, c in _ods_columns(name).items()], *lineage)


@scratched
def load_snapshot(store: Store, name: str, batch: str, run: Run) -> None:
    """Replace a snapshot table by one batch; the batch's id is its lineage."""
    rows = increment.snapshot_of(store.read(f"stg.{name}"), batch, SOURCE[name][1])
    store.replace(f"ods.{name}", typed_rows(name, rows, F.lit(batch).alias("_load_id"), run.ts().alias("_load_ts")))


def current_delta(store: Store, name: str) -> DataFrame:
    stage, current, key = store.read(f"stg.{name}"), store.read(f"ods.{name}"), SOURCE[name][1]
    if name == "flights":
        rows = increment.hwm_delta_with_history(stage, current, key, store.read("stg.segments"), store.read("ods.segments"), "flight_id")
    else:
        rows = increment.hwm_delta(stage, current, key)
    return typed_rows(name, rows, "event_ts", "_load_id", "_load_ts")


def load_current(store: Store, name: str) -> None:
    """Upsert what was staged since; the staged rows' lineage goes along, as it is the next mark. New and changed rows alone are written."""
    compare = [c for c in TABLES[f"ods.{name}"].columns if c not in SOURCE[name][1] and c not in ("_load_id", "_load_ts", "event_ts")]
    store.upsert(f"ods.{name}", current_delta(store, name), SOURCE[name][1], compare)


# star schema


def load_calendar(store: Store, first: date = date(2016, 1, 1), last: date = date(2030, 12, 31)) -> None:
    if store.read("dds.dim_calendar").isEmpty():
        store.replace("dds.dim_calendar", dimension.calendar(store.spark, first, last))


def _upsert_dimension(store: Store, name: str, source: DataFrame, sk: str, bk: str, attributes: Sequence[str], run: Run, update: bool = True) -> None:
    """A type-1 dimension: rows that are new or have changed are written, the others aren't touched."""
    table = f"dds.dim_{name}"
    delta = dimension.scd1_delta(store.read(table), source, sk, bk, attributes, run, update)
    store.upsert(table, delta, [bk], attributes or [bk], [*attributes, "updated_at", "_load_id", "_load_ts"])


@scratched
def load_airports(store: Store, run: Run) -> None:
    source = store.read("ods.airports").withColumnRenamed("airport_code", "airport_bk")
    _upsert_dimension(store, "airports", source, "airport_sk", "airport_bk", ["airport_name", "city", "country", "timezone", "coordinates"], run)


def airplanes_with_seats(airplanes: DataFrame, seats: DataFrame) -> DataFrame:
    n = seats.groupBy("airplane_code").agg(F.count(F.lit(1)).cast("int").alias("total_seats"))
    return airplanes.join(n, "airplane_code", "left").withColumn("total_seats", F.coalesce("total_seats", F.lit(0)))


@scratched
def load_airplanes(store: Store, run: Run) -> None:
    source = airplanes_with_seats(store.read("ods.airplanes"), store.read("ods.seats")).withColumnRenamed("airplane_code", "airplane_bk")
    _upsert_dimension(store, "airplanes", source, "airplane_sk", "airplane_bk", ["model", "range_km", "speed_kmh", "total_seats"], run)


@scratched
def load_tariffs(store: Store, run: Run) -> None:
    """Insert only: from the fares of segments."""
    source = store.read("ods.segments").where("fare_conditions IS NOT NULL").select("fare_conditions").distinct()
    _upsert_dimension(store, "tariffs", source, "tariff_sk", "fare_conditions", [], run, update=False)


def latest_passengers(tickets: DataFrame) -> DataFrame:
    """One name for each passenger, of the latest ticket."""
    order = [F.col("event_ts").desc_nulls_last(), F.col("_load_ts").desc_nulls_first(), F.col("ticket_no").desc_nulls_first()]
    return increment.latest(tickets, ["passenger_id"], *order).select("passenger_id", "passenger_name")


@scratched
def load_passengers(store: Store, run: Run) -> None:
    _upsert_dimension(store, "passengers", latest_passengers(store.read("ods.tickets")), "passenger_sk", "passenger_id", ["passenger_name"], run)


ROUTE_HASH = ["departure_airport", "arrival_airport", "airplane_code", "days_of_week", "departure_time", "_duration"]
ROUTE_REFRESH = ["departure_city", "arrival_city", "airplane_model", "total_seats"]


def route_versions(routes: DataFrame, airports: DataFrame, airplanes: DataFrame) -> DataFrame:
    """The latest validity of each route, with what its dimensions say of it now."""
    now = dimension.latest_version(routes, "route_no", "validity").withColumnRenamed("route_no", "route_bk")
    cities = lambda role: airports.select(F.col("airport_bk").alias(f"{role}_airport"), F.col("city").alias(f"{role}_city"))
    planes = airplanes.select(F.col("airplane_bk").alias("airplane_code"), F.col("model").alias("airplane_model"), F.coalesce("total_seats", F.lit(0)).alias("total_seats"))
    rows = now.join(cities("departure"), "departure_airport").join(cities("arrival"), "arrival_airport").join(planes, "airplane_code")
    return rows.withColumn("days_of_week", parse.array_text("days_of_week")).withColumn("_duration", parse.interval_text("duration"))


@scratched
def load_routes(store: Store, run: Run, refresh_all: bool = False) -> None:
    source = route_versions(store.read("ods.routes"), store.read("dds.dim_airports"), store.read("dds.dim_airplanes"))
    store.replace("dds.dim_routes", dimension.scd2_apply(store.read("dds.dim_routes"), source, "route_sk", "route_bk", ROUTE_HASH, ROUTE_REFRESH, run, refresh_all))


def resolved_flights(flights: DataFrame, routes: DataFrame, dims: marts.Dims) -> DataFrame:
    """Flights with all keys that follow from them: day, airports, the route's version of the day and its airplane.

    Resolved here, a flight is looked up once, not once for each of its passengers.
    """
    rows = flights.select("flight_id", "route_no", F.to_date("scheduled_departure").alias("_day"))
    latest = dimension.latest_version(routes, "route_no", "validity").select(F.col("route_no").alias("_r"), "departure_airport", "arrival_airport")
    rows = rows.join(latest, rows["route_no"] == latest["_r"], "left").drop("_r")
    look = dimension.lookup
    rows = look(rows, dims["calendar"], "_day", "date_actual", {"calendar_sk": "calendar_sk"})
    rows = look(rows, dims["airports"], "departure_airport", "airport_bk", {"airport_sk": "departure_airport_sk"})
    rows = look(rows, dims["airports"], "arrival_airport", "airport_bk", {"airport_sk": "arrival_airport_sk"})
    rows = dimension.asof_carry(rows, dims["routes"], ("route_no", "route_bk"), F.col("_day"), {"route_sk": "route_sk", "airplane_code": "_plane"})
    rows = look(rows, dims["airplanes"], "_plane", "airplane_bk", {"airplane_sk": "airplane_sk"})
    return rows.select("flight_id", "calendar_sk", "departure_airport_sk", "arrival_airport_sk", "airplane_sk", "route_sk")


def fact_rows(ods: dict[str, DataFrame], dims: marts.Dims) -> DataFrame:
    """Every segment with its keys resolved; a dimension that lacks a row leaves a null key.

    Tariffs or passengers that aren't given aren't looked up, and the fact lacks their key.
    """
    segments = ods["segments"].select("ticket_no", "flight_id", "fare_conditions", F.col("amount").alias("price"))
    bookings = ods["bookings"].select("book_ref", F.to_date("book_date").alias("book_date"))
    tickets = ods["tickets"].select("ticket_no", "book_ref", "passenger_id")
    if "passengers" in dims:
        tickets = dimension.lookup(tickets, dims["passengers"], "passenger_id", "passenger_id", {"passenger_sk": "passenger_sk"})
    tickets = tickets.join(bookings, "book_ref")
    passes = ods["boarding_passes"].select("ticket_no", "flight_id", "seat_no", F.lit(True).alias("_boarded"))
    flights = resolved_flights(ods["flights"], ods["routes"], dims)
    # passes meet their segments by ticket, which has few, and the flights are compared there: a join by both would shuffle segments that lie by ticket again
    mine = F.col("s.ticket_no") == F.col("p.ticket_no")
    same = F.col("s.flight_id") - F.col("p.flight_id") == 0
    boarded = segments.alias("s").join(passes.alias("p"), mine & same, "left").select("s.*", "p.seat_no", "p._boarded")
    rows = boarded.join(tickets, "ticket_no").join(flights, "flight_id")
    if "tariffs" in dims:
        rows = dimension.lookup(rows, dims["tariffs"], "fare_conditions", "fare_conditions", {"tariff_sk": "tariff_sk"})
    columns = ("calendar_sk", "departure_airport_sk", "arrival_airport_sk", "airplane_sk", "tariff_sk", "passenger_sk", "route_sk", "book_ref", "ticket_no", "flight_id", "book_date", "seat_no", "price")
    return rows.select(*[c for c in columns if c in rows.columns], F.col("_boarded").isNotNull().alias("is_boarded"))


MUTABLE = ["seat_no", "price", "is_boarded"]


def fact_upsert(fact: DataFrame, rows: DataFrame, run: Run) -> DataFrame:
    """Changed measures of known segments and new segments; resolved keys of a known one are frozen."""
    delta = rows.withColumn("_load_id", run.id()).withColumn("_load_ts", run.ts())
    return merge.scd1_upsert(fact, delta, ["ticket_no", "flight_id"], MUTABLE, [*MUTABLE, "_load_id", "_load_ts"])


def dims_of(store: Store) -> marts.Dims:
    return {n: store.read(f"dds.dim_{n}") for n in ("calendar", "airports", "airplanes", "tariffs", "passengers", "routes")}


FACT, SUMS = "dds.fact_flight_sales", "dds.flight_sums"


def _marks(ods: dict[str, DataFrame]) -> dict[str, str]:
    """How far each incremental source of the fact has come."""
    return {n: found.isoformat() for n in INCREMENTAL if (found := ods[n].agg(F.max("_load_ts")).first()[0])}


def changed_segments(store: Store, ods: dict[str, DataFrame]) -> DataFrame:
    """Keys of segments that the current state got since the last load of the fact: new ones, and those whose
    pass, ticket, booking or flight is new."""
    marks = {n: store.mark(FACT, n) or increment.FLOOR for n in INCREMENTAL}
    new = {n: increment.newer(ods[n], "_load_ts", marks[n]) for n in INCREMENTAL}
    segments = ods["segments"].select("ticket_no", "flight_id")
    booked = ods["tickets"].join(new["bookings"].select("book_ref"), "book_ref", "left_semi").select("ticket_no")
    tickets = new["tickets"].select("ticket_no").unionByName(booked).distinct()
    parts = [
        new["segments"].select("ticket_no", "flight_id"),
        new["boarding_passes"].select("ticket_no", "flight_id"),
        segments.join(tickets, "ticket_no", "left_semi"),
        segments.join(new["flights"].select("flight_id"), "flight_id", "left_semi"),
    ]
    return reduce(DataFrame.unionByName, parts).distinct()


@scratched
def load_fact(store: Store, run: Run, rebuild: bool = False) -> None:
    """Upsert the segments that changed, into the partitions that hold them or will.

    The rest of the fact is neither computed nor written again; to find known segments their keys alone
    are read. ``rebuild`` makes the whole fact anew, which resolves late dimensions.
    """
    ods = {n: store.read(f"ods.{n}") for n in (*INCREMENTAL, "routes")}
    marks = _marks(ods)
    if rebuild or not store.partitions(FACT):
        store.replace(FACT, fact_upsert(store.spark.createDataFrame([], TABLES[FACT].schema), fact_rows(ods, dims_of(store)), run), marks)
        load_sums(store, run)
        return
    keys = stable(changed_segments(store, ods))
    mine = ods["segments"].join(keys, ["ticket_no", "flight_id"], "left_semi")
    delta = stable(fact_rows(ods | {"segments": mine}, dims_of(store)))
    known = store.read(FACT).select("ticket_no", "flight_id", "calendar_sk").join(keys, ["ticket_no", "flight_id"], "left_semi")
    touched = sorted({*store.partition_of(FACT, known), *store.partition_of(FACT, delta)})
    if touched:
        store.replace_partitions(FACT, fact_upsert(store.read(FACT, partitions=touched), delta, run), touched, marks)
        load_sums(store, run, touched)


def load_sums(store: Store, run: Run, partitions: list[str] | None = None) -> None:
    """Sums of each flight, of the fact's partitions that a load has touched or of all: what marts over flights read instead of the fact."""
    sums = marts.flight_sums(store.read(FACT, partitions=partitions)).withColumn("_load_id", run.id()).withColumn("_load_ts", run.ts())
    if partitions is None:
        store.replace(SUMS, sums)
    else:
        store.replace_partitions(SUMS, sums, partitions)


# marts


def _audited(rows: DataFrame, run: Run) -> DataFrame:
    return rows.select("*", run.ts().alias("created_at"), run.ts().alias("updated_at"), run.id().alias("_load_id"), run.ts().alias("_load_ts"))


#: Mart: affected key of the fact, aggregation, compared columns, columns that an update writes (None: all).
INCREMENTAL_MARTS: dict[str, tuple[list[str], Callable[[DataFrame, marts.Dims], DataFrame], list[str], list[str] | None]] = {
    "sales_report": (
        ["calendar_sk"],
        marts.sales_report,
        ["tickets_sold", "passengers_boarded", "total_revenue", "boarding_rate", "departure_city", "arrival_city"],
        ["departure_city", "arrival_city", "fare_conditions", "day_of_week", "day_name", "is_weekend", "tickets_sold", "passengers_boarded", "total_revenue", "avg_price", "min_price", "max_price", "boarding_rate", "updated_at", "_load_id", "_load_ts"],
    ),
    "airport_traffic": (["calendar_sk"], marts.airport_traffic, [], None),
    "monthly_overview": (["year_actual", "month_actual"], marts.monthly_overview, [], None),
    "passenger_loyalty": (["passenger_sk"], marts.passenger_loyalty, [], None),
}


@scratched
def load_mart(store: Store, name: str, run: Run) -> None:
    """Recompute the grains that new or changed facts touch and merge them, into the months that hold them
    where the mart has months; of other marts, whose rows may be as many as passengers, changed rows alone are written."""
    key, aggregate, compare, update = INCREMENTAL_MARTS[name]
    table = f"dm.{name}"
    mart, fact, dims = store.read(table), store.read(FACT), dims_of(store)
    grain = list(TABLES[table].key)
    business = [c for c in mart.columns if c not in ("created_at", "updated_at", "_load_id", "_load_ts")]
    compare = compare or [c for c in business if c not in grain]
    update = update or [c for c in mart.columns if c not in grain and c != "created_at"]
    mark = store.mark(table, FACT) or increment.high_water_mark(mart, "_load_ts")
    if key == ["calendar_sk"]:  # the fact's partitions that new rows are in hold all rows of their days
        fact = store.read(FACT, partitions=store.partition_of(FACT, increment.newer(fact, "_load_ts", mark)))
    if name == "monthly_overview":  # its key is a month: facts carry it while they are cut, and only those months' partitions are read
        months = dims["calendar"].select(F.col("calendar_sk").alias("_m"), "year_actual", "month_actual")
        days = stable(increment.newer(fact, "_load_ts", mark).select(F.col("calendar_sk").alias("_m")).distinct())
        there = months.join(months.join(days, "_m").select("year_actual", "month_actual").distinct(), ["year_actual", "month_actual"])
        fact = store.read(FACT, partitions=store.partition_of(FACT, there.select(F.col("_m").alias("calendar_sk"))))
        fact = fact.join(months, F.col("calendar_sk") == F.col("_m")).drop("_m")
        aggregate = lambda rows, d, f=aggregate: f(rows.drop("year_actual", "month_actual"), d)
    delta = recompute.affected_rows(fact, mark, key, lambda rows: aggregate(rows, dims), lambda d: _audited(d, run).select(*mart.columns))
    marks = {FACT: found.isoformat()} if (found := store.read(FACT).agg(F.max("_load_ts")).first()[0]) else {}
    if not TABLES[table].partition:
        store.upsert(table, delta, grain, compare, update, marks=marks)
        return
    delta = stable(delta)
    if touched := store.partition_of(table, delta):
        store.replace_partitions(table, merge.scd1_upsert(store.read(table, partitions=touched), delta, grain, compare, update), touched, marks)


def load_route_performance(store: Store, run: Run) -> None:
    """From the sums of flights, some hundred times fewer rows than the fact's."""
    rows = marts.route_performance_of(store.read(SUMS), dims_of(store))
    store.replace("dm.route_performance", rows.withColumn("_load_id", run.id()).withColumn("_load_ts", run.ts()))
