"""Tables of all layers: columns with types, required columns, keys, comments.

A type ending in ``!`` is required. Parquet does not enforce that, so the store checks it before
it publishes a version.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql.types import StructType


@dataclass(frozen=True)
class Table:
    name: str
    columns: dict[str, str]
    key: tuple[str, ...]
    comment: str = ""
    partition: str = ""  # SQL expression; its values must not change for a key

    def comment_of(self, column: str) -> str:
        return COMMENTS.get(column, "surrogate key" if column.endswith("_sk") else "business key" if column.endswith("_bk") or column in self.key else "")

    @property
    def required(self) -> list[str]:
        return [c for c, t in self.columns.items() if t.endswith("!")]

    @property
    def schema(self) -> StructType:
        return StructType.fromDDL(", ".join(f"`{c}` {t.rstrip('!')}" for c, t in self.columns.items()))


def _columns(text: str) -> dict[str, str]:
    """``name type, name type``; commas inside brackets belong to the type."""
    out, depth, part = {}, 0, ""
    for c in text + ",":
        depth += c in "(<"
        depth -= c in ")>"
        if c == "," and not depth:
            name, kind = part.split(None, 1)
            out[name] = kind.strip()
            part = ""
        else:
            part += c
    return out


AUDIT = "created_at timestamp_ntz!, updated_at timestamp_ntz!, _load_id string!, _load_ts timestamp_ntz!"
LOAD = "_load_id string!, _load_ts timestamp_ntz!"
MONEY, TOTAL, RATE = "decimal(10,2)", "decimal(15,2)", "decimal(5,4)"

#: Source tables: business columns as the source has them, and their key.
SOURCE = {
    "bookings": (f"book_ref string, book_date timestamp_ntz, total_amount {MONEY}", ("book_ref",)),
    "tickets": ("ticket_no string, book_ref string, passenger_id string, passenger_name string, outbound string", ("ticket_no",)),
    "flights": ("flight_id string, route_no string, status string, scheduled_departure timestamp_ntz, scheduled_arrival timestamp_ntz, actual_departure timestamp_ntz, actual_arrival timestamp_ntz", ("flight_id",)),
    "segments": (f"ticket_no string, flight_id string, fare_conditions string, price {MONEY}", ("ticket_no", "flight_id")),
    "boarding_passes": ("ticket_no string, flight_id string, seat_no string, boarding_no int, boarding_time timestamp_ntz", ("ticket_no", "flight_id")),
    "airports": ("airport_code string, airport_name string, city string, country string, coordinates string, timezone string", ("airport_code",)),
    "airplanes": ("airplane_code string, model string, range string, speed string", ("airplane_code",)),
    "routes": ("route_no string, validity string, departure_airport string, arrival_airport string, airplane_code string, days_of_week string, scheduled_time string, duration string", ("route_no", "validity")),
    "seats": ("airplane_code string, seat_no string, fare_conditions string", ("airplane_code", "seat_no")),
}
INCREMENTAL = ("bookings", "tickets", "flights", "segments", "boarding_passes")
SNAPSHOT = ("airports", "airplanes", "routes", "seats")

_STG = {
    f"stg.{name}": Table(f"stg.{name}", {c: "string" for c in _columns(cols)} | {"event_ts": "timestamp_ntz", "_load_ts": "timestamp_ntz!", "_load_id": "string!"}, key, "append-only history, business columns as text")
    for name, (cols, key) in SOURCE.items()
}

_ODS = {
    "airports": "airport_code string!, airport_name string!, city string!, country string!, coordinates string, timezone string!",
    "airplanes": "airplane_code string!, model string!, range_km int, speed_kmh int",
    "routes": "route_no string!, validity string!, departure_airport string!, arrival_airport string!, airplane_code string!, days_of_week array<int>, departure_time string!, duration interval hour to second!",
    "seats": "airplane_code string!, seat_no string!, fare_conditions string!",
    "bookings": f"book_ref string!, book_date timestamp!, total_amount {MONEY}!, event_ts timestamp_ntz",
    "tickets": "ticket_no string!, book_ref string!, passenger_id string!, passenger_name string!, is_outbound boolean, event_ts timestamp_ntz",
    "flights": "flight_id int!, route_no string!, status string!, scheduled_departure timestamp, scheduled_arrival timestamp, actual_departure timestamp, actual_arrival timestamp, event_ts timestamp_ntz",
    "segments": f"ticket_no string!, flight_id int!, fare_conditions string!, amount {MONEY}!, event_ts timestamp_ntz",
    "boarding_passes": "ticket_no string!, flight_id int!, seat_no string!, boarding_no int, boarding_time timestamp, event_ts timestamp_ntz",
}

_DDS = {
    "dim_calendar": ("calendar_sk int!, date_actual date!, year_actual int!, month_actual int!, day_actual int!, day_of_week int!, day_name string!, is_weekend boolean!", ("date_actual",)),
    "dim_airports": (f"airport_sk int!, airport_bk string!, airport_name string!, city string!, country string!, timezone string!, coordinates string, {AUDIT}", ("airport_bk",)),
    "dim_airplanes": (f"airplane_sk int!, airplane_bk string!, model string!, range_km int, speed_kmh int, total_seats int, {AUDIT}", ("airplane_bk",)),
    "dim_tariffs": (f"tariff_sk int!, fare_conditions string!, {AUDIT}", ("fare_conditions",)),
    "dim_passengers": (f"passenger_sk int!, passenger_id string!, passenger_name string!, {AUDIT}", ("passenger_id",)),
    "dim_routes": (
        f"route_sk int!, route_bk string!, departure_airport string!, arrival_airport string!, airplane_code string!, departure_city string!, arrival_city string!, airplane_model string!, total_seats int!, days_of_week string, departure_time string, duration interval hour to second, hashdiff string!, valid_from date!, valid_to date, {AUDIT}",
        ("route_sk",),
    ),
    "fact_flight_sales": (
        f"calendar_sk int, departure_airport_sk int, arrival_airport_sk int, airplane_sk int, tariff_sk int, passenger_sk int, route_sk int, book_ref string!, ticket_no string!, flight_id int!, book_date date, seat_no string, price {MONEY}, is_boarded boolean!, {LOAD}",
        ("ticket_no", "flight_id"),
    ),
    "flight_sums": (f"route_sk int, airplane_sk int, calendar_sk int, flight_id int!, n bigint!, b bigint!, s decimal(20,2), {LOAD}", ("flight_id", "calendar_sk", "route_sk", "airplane_sk")),
}

_DM = {
    "sales_report": (
        f"flight_date date!, departure_airport_sk int!, arrival_airport_sk int!, tariff_sk int!, departure_city string!, departure_airport_bk string!, arrival_city string!, arrival_airport_bk string!, fare_conditions string!, day_of_week int!, day_name string!, is_weekend boolean!, tickets_sold int!, passengers_boarded int!, total_revenue {TOTAL}!, avg_price {MONEY}!, min_price {MONEY}, max_price {MONEY}, boarding_rate {RATE}!, {AUDIT}",
        ("flight_date", "departure_airport_sk", "arrival_airport_sk", "tariff_sk"),
    ),
    "airport_traffic": (
        f"traffic_date date!, airport_sk int!, airport_bk string!, city string!, departures_flights int!, departures_passengers int!, departures_revenue {TOTAL}!, arrivals_flights int!, arrivals_passengers int!, arrivals_revenue {TOTAL}!, total_passengers int!, {AUDIT}",
        ("traffic_date", "airport_sk"),
    ),
    "route_performance": (
        f"route_bk string!, route_sk int!, departure_airport_bk string!, departure_city string!, arrival_airport_bk string!, arrival_city string!, airplane_bk string!, airplane_model string!, total_seats int!, total_flights int!, total_tickets int!, total_boarded int!, total_revenue {TOTAL}!, avg_ticket_price {MONEY}, avg_boarding_rate {RATE}!, avg_load_factor {RATE}, first_flight_date date, last_flight_date date, {LOAD}",
        ("route_bk",),
    ),
    "monthly_overview": (
        f"year_actual int!, month_actual int!, airplane_sk int!, airplane_bk string!, airplane_model string!, total_seats int!, total_flights int!, total_tickets int!, total_boarded int!, total_revenue {TOTAL}!, avg_ticket_price {MONEY}, avg_load_factor {RATE}, unique_routes int!, unique_passengers int!, {AUDIT}",
        ("year_actual", "month_actual", "airplane_sk"),
    ),
    "passenger_loyalty": (
        f"passenger_sk int!, passenger_bk string!, passenger_name string!, total_bookings int!, total_flights int!, total_boarded int!, total_spent {TOTAL}!, avg_ticket_price {MONEY}, favorite_fare_conditions string, unique_routes int!, first_flight_date date, last_flight_date date, days_as_customer int, {AUDIT}",
        ("passenger_sk",),
    ),
}

#: What columns mean, wherever they are.
COMMENTS = {
    "event_ts": "business time of a row in its source",
    "_load_id": "run that wrote the row, or the batch it came with",
    "_load_ts": "moment of that run",
    "created_at": "moment of the run that added the row",
    "updated_at": "moment of the run that last changed it",
    "valid_from": "first day of a version",
    "valid_to": "day after the last of a version, null while it is open",
    "hashdiff": "digest of the attributes whose change makes a version",
    "is_boarded": "whether the segment has a boarding pass",
    "avg_load_factor": "boarded passengers by seats, over all flights",
    "boarding_rate": "boarded passengers by tickets sold",
}

#: Partitions of tables that grow with time: 32 days, or a month.
PARTITIONS = {"dds.fact_flight_sales": "calendar_sk div 32", "dds.flight_sums": "calendar_sk div 32", "dm.sales_report": "date_format(flight_date, 'yyyy-MM')", "dm.airport_traffic": "date_format(traffic_date, 'yyyy-MM')"}

TABLES: dict[str, Table] = (
    _STG
    | {f"ods.{n}": Table(f"ods.{n}", _columns(f"{c}, {LOAD}"), SOURCE[n][1], "typed current state") for n, c in _ODS.items()}
    | {f"dds.{n}": Table(f"dds.{n}", _columns(c), k, "star schema", PARTITIONS.get(f"dds.{n}", "")) for n, (c, k) in _DDS.items()}
    | {f"dm.{n}": Table(f"dm.{n}", _columns(c), k, "data mart", PARTITIONS.get(f"dm.{n}", "")) for n, (c, k) in _DM.items()}
)


def source_schema(name: str) -> StructType:
    return StructType.fromDDL(SOURCE[name][0])
