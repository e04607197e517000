"""Aggregations of the five marts, over the fact with its dimensions.

Each takes the fact (cut to what is affected) and the dimensions by name, and returns the mart's
business columns. Dimensions are left to the optimizer: it broadcasts those it knows to be small.
Distinct counts come from distinct rows of the grain they count, never from partial counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.functions.parse import mean, ratio
from lakeloom.operators.recompute import distinct_in_role, roles

Dims = dict[str, DataFrame]


def _boarded() -> "F.Column":
    return F.sum(F.when(F.col("is_boarded"), 1).otherwise(0))


def dated(fact: DataFrame, dims: Dims, how: str = "inner") -> DataFrame:
    cal = dims["calendar"].select(F.col("calendar_sk").alias("_c"), "date_actual", "year_actual", "month_actual", "day_of_week", "day_name", "is_weekend")
    return fact.join(cal, F.col("calendar_sk") == F.col("_c"), how).drop("_c")


def sales_report(fact: DataFrame, dims: Dims) -> DataFrame:
    """Date, departure, arrival and tariff; rows without one of the dimensions drop out."""
    airports = dims["airports"]
    dep = airports.select(F.col("airport_sk").alias("departure_airport_sk"), F.col("airport_bk").alias("departure_airport_bk"), F.col("city").alias("departure_city"))
    arr = airports.select(F.col("airport_sk").alias("arrival_airport_sk"), F.col("airport_bk").alias("arrival_airport_bk"), F.col("city").alias("arrival_city"))
    grain = ["calendar_sk", "departure_airport_sk", "arrival_airport_sk", "tariff_sk"]
    # sums first: the dimensions then join a row for each grain, not for each ticket
    sums = fact.groupBy(*grain).agg(F.count(F.lit(1)).alias("n"), _boarded().alias("b"), F.sum("price").alias("s"), F.min("price").alias("min_price"), F.max("price").alias("max_price"))
    joined = dated(sums, dims).join(dep, "departure_airport_sk").join(arr, "arrival_airport_sk").join(dims["tariffs"].select("tariff_sk", "fare_conditions"), "tariff_sk")
    return joined.select(
        F.col("date_actual").alias("flight_date"),
        "departure_airport_sk",
        "arrival_airport_sk",
        "tariff_sk",
        "departure_city",
        "departure_airport_bk",
        "arrival_city",
        "arrival_airport_bk",
        "fare_conditions",
        "day_of_week",
        "day_name",
        "is_weekend",
        F.col("n").cast("int").alias("tickets_sold"),
        F.col("b").cast("int").alias("passengers_boarded"),
        F.col("s").cast("decimal(15,2)").alias("total_revenue"),
        mean(F.col("s"), F.col("n")).alias("avg_price"),
        "min_price",
        "max_price",
        ratio(F.col("b"), F.col("n")).alias("boarding_rate"),
    )


def airport_traffic(fact: DataFrame, dims: Dims) -> DataFrame:
    """Date and airport; each fact counts once as a departure and once as an arrival."""
    # flights first: a flight has many tickets, and only then each row becomes two
    flights = fact.groupBy("calendar_sk", "departure_airport_sk", "arrival_airport_sk", "flight_id").agg(_boarded().alias("b"), F.sum("price").alias("s"))
    each = roles(flights, "role", "airport_sk", {"departure": "departure_airport_sk", "arrival": "arrival_airport_sk"}).where("airport_sk IS NOT NULL")
    dep, arr = F.col("role") == "departure", F.col("role") == "arrival"
    zero = F.lit(0).cast("decimal(20,2)")
    boarded = lambda role: F.sum(F.when(role, F.col("b")).otherwise(0)).cast("int")
    agg = each.groupBy("calendar_sk", "airport_sk").agg(
        distinct_in_role(dep, F.col("flight_id")).cast("int").alias("departures_flights"),
        boarded(dep).alias("departures_passengers"),
        F.coalesce(F.sum(F.when(dep, F.col("s"))), zero).cast("decimal(15,2)").alias("departures_revenue"),
        distinct_in_role(arr, F.col("flight_id")).cast("int").alias("arrivals_flights"),
        boarded(arr).alias("arrivals_passengers"),
        F.coalesce(F.sum(F.when(arr, F.col("s"))), zero).cast("decimal(15,2)").alias("arrivals_revenue"),
        F.sum("b").cast("int").alias("total_passengers"),
    )
    named = dated(agg, dims).join(dims["airports"].select("airport_sk", "airport_bk", "city"), "airport_sk")
    return named.select(F.col("date_actual").alias("traffic_date"), "airport_sk", "airport_bk", "city", "departures_flights", "departures_passengers", "departures_revenue", "arrivals_flights", "arrivals_passengers", "arrivals_revenue", "total_passengers")


def flight_sums(fact: DataFrame) -> DataFrame:
    """Tickets, boarded passengers and revenue of each flight: what marts over flights need of the fact."""
    return fact.groupBy("route_sk", "airplane_sk", "calendar_sk", "flight_id").agg(F.count(F.lit(1)).alias("n"), _boarded().cast("bigint").alias("b"), F.sum("price").cast("decimal(20,2)").alias("s"))


def route_performance(fact: DataFrame, dims: Dims) -> DataFrame:
    return route_performance_of(flight_sums(fact), dims)


def route_performance_of(sums: DataFrame, dims: Dims) -> DataFrame:
    """Route across all its versions, with the attributes of the open one; closed routes drop out."""
    routes = dims["routes"]
    versions = routes.select("route_sk", "route_bk")
    agg = (
        dated(sums.join(versions, "route_sk"), dims, "left")
        .groupBy("route_bk")
        .agg(F.count_distinct("flight_id").alias("flights"), F.sum("n").alias("n"), F.sum("b").alias("b"), F.sum("s").alias("s"), F.min("date_actual").alias("first_flight_date"), F.max("date_actual").alias("last_flight_date"))
    )
    now = routes.where("valid_to IS NULL").select(
        "route_bk", "route_sk", F.col("departure_airport").alias("departure_airport_bk"), "departure_city", F.col("arrival_airport").alias("arrival_airport_bk"), "arrival_city", F.col("airplane_code").alias("airplane_bk"), "airplane_model", "total_seats"
    )
    return agg.join(now, "route_bk").select(
        "route_bk",
        "route_sk",
        "departure_airport_bk",
        "departure_city",
        "arrival_airport_bk",
        "arrival_city",
        "airplane_bk",
        "airplane_model",
        "total_seats",
        F.col("flights").cast("int").alias("total_flights"),
        F.col("n").cast("int").alias("total_tickets"),
        F.col("b").cast("int").alias("total_boarded"),
        F.col("s").cast("decimal(15,2)").alias("total_revenue"),
        mean(F.col("s"), F.col("n")).alias("avg_ticket_price"),
        ratio(F.col("b"), F.col("n")).alias("avg_boarding_rate"),
        ratio(F.col("b"), F.col("flights") * F.col("total_seats")).alias("avg_load_factor"),
        "first_flight_date",
        "last_flight_date",
    )


def monthly_overview(fact: DataFrame, dims: Dims) -> DataFrame:
    """Year, month and airplane.

    The load factor is the average over flights. An airplane's seats are one number in a group, so
    that average is boarded over flights times seats, exactly and without a second grouping.
    """
    key = ["year_actual", "month_actual", "airplane_sk"]
    some = fact.where("airplane_sk IS NOT NULL")
    flights = dated(flight_sums(some), dims).join(dims["routes"].select("route_sk", "route_bk"), "route_sk", "left")
    planes = dims["airplanes"].select("airplane_sk", "airplane_bk", F.col("model").alias("airplane_model"), "total_seats")
    sums = flights.groupBy(*key).agg(F.count_distinct("flight_id").alias("flights"), F.sum("n").alias("n"), F.sum("b").alias("b"), F.sum("s").alias("s"), F.count_distinct("route_bk").alias("routes"))
    # each passenger once a month, then counted: no row of the fact is repeated for another distinct count, and each is shuffled once
    monthly = dated(some.where("passenger_sk IS NOT NULL").select("airplane_sk", "calendar_sk", "passenger_sk"), dims).groupBy(*key, "passenger_sk").agg(F.lit(1).alias("one"))
    people = monthly.groupBy(*key).agg(F.count(F.lit(1)).alias("passengers"))
    agg = sums.join(people, key, "left").withColumn("passengers", F.coalesce("passengers", F.lit(0)))
    return (
        agg.join(planes, "airplane_sk")
        .select(
            *key,
            "airplane_bk",
            "airplane_model",
            F.coalesce("total_seats", F.lit(0)).alias("total_seats"),
            F.col("flights").cast("int").alias("total_flights"),
            F.col("n").cast("int").alias("total_tickets"),
            F.col("b").cast("int").alias("total_boarded"),
            F.col("s").cast("decimal(15,2)").alias("total_revenue"),
            mean(F.col("s"), F.col("n")).alias("avg_ticket_price"),
            ratio(F.col("b"), F.col("flights") * F.col("total_seats")).alias("avg_load_factor"),
            F.col("routes").cast("int").alias("unique_routes"),
            F.col("passengers").cast("int").alias("unique_passengers"),
        )
    )


def passenger_loyalty(fact: DataFrame, dims: Dims) -> DataFrame:
    """Passenger over the whole history; the favourite fare is the most frequent one, ties by name."""
    rows = (
        dated(fact.where("passenger_sk IS NOT NULL"), dims, "left")
        .join(dims["routes"].select("route_sk", "route_bk"), "route_sk", "left")
        .join(dims["tariffs"].select("tariff_sk", "fare_conditions"), "tariff_sk", "left")
    )
    # rows are dealt by passenger once; there the first one of each booking, flight and route is marked, so that none is repeated for a distinct count
    needed = ("passenger_sk", "book_ref", "flight_id", "route_bk", "fare_conditions", "price", "is_boarded", "date_actual")
    first = lambda c: F.when(F.col(c).isNotNull() & (F.row_number().over(Window.partitionBy("passenger_sk", c).orderBy(c)) == 1), 1).otherwise(0)
    counted = {"bookings": "book_ref", "flights": "flight_id", "routes": "route_bk"}
    marked = rows.select(*needed).repartition("passenger_sk").withColumns({n: first(c) for n, c in counted.items()})
    fares = marked.groupBy("passenger_sk", "fare_conditions").agg(
        *[F.sum(n).alias(n) for n in counted],
        F.count(F.lit(1)).alias("n"),
        _boarded().alias("b"),
        F.sum("price").alias("s"),
        F.min("date_actual").alias("first_flight_date"),
        F.max("date_actual").alias("last_flight_date"),
    )
    most = F.min(F.when(F.col("fare_conditions").isNotNull(), F.struct((-F.col("n")).alias("n"), "fare_conditions")))
    agg = fares.groupBy("passenger_sk").agg(
        *[F.sum(c).alias(c) for c in (*counted, "n", "b")],
        F.sum("s").cast("decimal(20,2)").alias("s"),
        F.min("first_flight_date").alias("first_flight_date"),
        F.max("last_flight_date").alias("last_flight_date"),
        most.getField("fare_conditions").alias("favorite_fare_conditions"),
    )
    who = dims["passengers"].select("passenger_sk", F.col("passenger_id").alias("passenger_bk"), "passenger_name")
    return (
        agg.join(who, "passenger_sk")
        .select(
            "passenger_sk",
            "passenger_bk",
            "passenger_name",
            F.col("bookings").cast("int").alias("total_bookings"),
            F.col("flights").cast("int").alias("total_flights"),
            F.col("b").cast("int").alias("total_boarded"),
            F.col("s").cast("decimal(15,2)").alias("total_spent"),
            mean(F.col("s"), F.col("n")).alias("avg_ticket_price"),
            "favorite_fare_conditions",
            F.col("routes").cast("int").alias("unique_routes"),
            "first_flight_date",
            "last_flight_date",
            F.datediff("last_flight_date", "first_flight_date").alias("days_as_customer"),
        )
    )
