"""Registered queries over the test tables, each with the same question in SQL.

Decimals leave as doubles of the same exact value, counts as bigints.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.functions import parse
from lakeloom.operators import dimension, increment, merge, recompute
from lakeloom.plans import adapter, layers, marts
from lakeloom.quality import checks, tables
from lakeloom.session import Run
from lakeloom.sources.storage import stable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

RUN_1, RUN_2 = adapter.RUN, Run("run_2", datetime(2024, 1, 3), date(2000, 1, 1))


def query(sql: str):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles, integers as bigints."""
    kinds = dict(df.dtypes)
    return df.select(*[F.col(c).cast("double" if k.startswith("decimal") else "bigint" if k in ("int", "smallint", "tinyint") else k).alias(c) for c, k in kinds.items()])


def business(df: DataFrame) -> DataFrame:
    return plain(df.drop("created_at", "updated_at", "_load_id", "_load_ts", "event_ts"))


# marts

_HALF = "((2 * {a} + {b}) // (2 * {b})) / 100.0"
_RATE = "((20000 * {a} + {b}) // (2 * {b})) / 10000.0"
_MEAN, _BOARDED = _HALF.format(a="sum(cents)", b="count(*)"), "CAST(sum(CASE WHEN is_boarded THEN 1 ELSE 0 END) AS BIGINT)"


@query(
    adapter.SQL
    + f"""SELECT f.day AS flight_date, f.dep_sk AS departure_airport_sk, f.arr_sk AS arrival_airport_sk, f.tariff_sk, d.city AS departure_city, d.airport_bk AS departure_airport_bk,
  a.city AS arrival_city, a.airport_bk AS arrival_airport_bk, t.fare_conditions, isodow(f.day) AS day_of_week, dayname(f.day) AS day_name, isodow(f.day) IN (6, 7) AS is_weekend,
  count(*) AS tickets_sold, {_BOARDED} AS passengers_boarded, CAST(sum(price) AS DOUBLE) AS total_revenue, {_MEAN} AS avg_price,
  CAST(min(price) AS DOUBLE) AS min_price, CAST(max(price) AS DOUBLE) AS max_price, {_RATE.format(a=_BOARDED, b="count(*)")} AS boarding_rate
FROM fact f JOIN airport d ON d.airport_sk = f.dep_sk JOIN airport a ON a.airport_sk = f.arr_sk JOIN tariff t ON t.tariff_sk = f.tariff_sk
GROUP BY ALL"""
)
def mart_sales_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(marts.sales_report(*adapter.new_fact(spark, sf_dir, *adapter.FLIGHT, "tariffs")))


@query(
    adapter.SQL
    + f""", r AS (SELECT day, dep_sk AS sk, 'd' AS role, flight_id, price, is_boarded FROM fact UNION ALL SELECT day, arr_sk, 'a', flight_id, price, is_boarded FROM fact)
SELECT day AS traffic_date, sk AS airport_sk, airport_bk, city, count(DISTINCT CASE WHEN role = 'd' THEN flight_id END) AS departures_flights,
  CAST(count(*) FILTER (WHERE role = 'd' AND is_boarded) AS BIGINT) AS departures_passengers, CAST(coalesce(sum(price) FILTER (WHERE role = 'd'), 0) AS DOUBLE) AS departures_revenue,
  count(DISTINCT CASE WHEN role = 'a' THEN flight_id END) AS arrivals_flights, CAST(count(*) FILTER (WHERE role = 'a' AND is_boarded) AS BIGINT) AS arrivals_passengers,
  CAST(coalesce(sum(price) FILTER (WHERE role = 'a'), 0) AS DOUBLE) AS arrivals_revenue, {_BOARDED} AS total_passengers
FROM r JOIN airport ON airport_sk = sk GROUP BY day, sk, airport_bk, city"""
)
def mart_airport_traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(marts.airport_traffic(*adapter.new_fact(spark, sf_dir, *adapter.FLIGHT)))


_FLIGHTS = "count(DISTINCT flight_id)"


@query(
    adapter.SQL
    + f"""SELECT r.route_bk, r.route_sk, d.airport_bk AS departure_airport_bk, d.city AS departure_city, a.airport_bk AS arrival_airport_bk, a.city AS arrival_city,
  r.brand AS airplane_bk, p.model AS airplane_model, p.total_seats, {_FLIGHTS} AS total_flights, count(*) AS total_tickets, {_BOARDED} AS total_boarded,
  CAST(sum(price) AS DOUBLE) AS total_revenue, {_MEAN} AS avg_ticket_price, {_RATE.format(a=_BOARDED, b="count(*)")} AS avg_boarding_rate,
  {_RATE.format(a=_BOARDED, b=f"({_FLIGHTS} * max(p.total_seats))")} AS avg_load_factor, min(f.day) AS first_flight_date, max(f.day) AS last_flight_date
FROM fact f JOIN route r USING (route_sk) JOIN airport d ON d.n_nationkey = r.dep_n JOIN airport a ON a.n_nationkey = r.arr_n JOIN plane p ON p.airplane_bk = r.brand
GROUP BY ALL"""
)
def mart_route_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(marts.route_performance(*adapter.new_fact(spark, sf_dir, *adapter.FLIGHT)))


@query(
    adapter.SQL
    + f"""SELECT year(f.day) AS year_actual, month(f.day) AS month_actual, f.airplane_sk, p.airplane_bk, p.model AS airplane_model, p.total_seats, {_FLIGHTS} AS total_flights,
  count(*) AS total_tickets, {_BOARDED} AS total_boarded, CAST(sum(price) AS DOUBLE) AS total_revenue, {_MEAN} AS avg_ticket_price,
  {_RATE.format(a=_BOARDED, b=f"({_FLIGHTS} * max(p.total_seats))")} AS avg_load_factor, count(DISTINCT f.route_sk) AS unique_routes, count(DISTINCT f.passenger_sk) AS unique_passengers
FROM fact f JOIN plane p USING (airplane_sk) GROUP BY ALL"""
)
def mart_monthly_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    needed = ("airplane_sk", "route_sk", "calendar_sk", "passenger_sk", "flight_id", "price", "is_boarded")
    return plain(marts.monthly_overview(*adapter.fact(spark, sf_dir, *adapter.FLIGHT, "passengers", columns=needed)))


_MODE = """, fares AS (SELECT passenger_sk, fare_conditions, row_number() OVER (PARTITION BY passenger_sk ORDER BY count(*) DESC, fare_conditions) AS k
  FROM fact JOIN tariff USING (tariff_sk) GROUP BY passenger_sk, fare_conditions)"""


@query(
    adapter.SQL
    + _MODE
    + f"""SELECT f.passenger_sk, p.passenger_id AS passenger_bk, p.c_name AS passenger_name, count(DISTINCT f.ticket_no) AS total_bookings, {_FLIGHTS} AS total_flights,
  {_BOARDED} AS total_boarded, CAST(sum(price) AS DOUBLE) AS total_spent, {_MEAN} AS avg_ticket_price, any_value(g.fare_conditions) AS favorite_fare_conditions,
  count(DISTINCT f.route_sk) AS unique_routes, min(f.day) AS first_flight_date, max(f.day) AS last_flight_date, date_diff('day', min(f.day), max(f.day)) AS days_as_customer
FROM fact f JOIN passenger p USING (passenger_sk) LEFT JOIN fares g ON g.passenger_sk = f.passenger_sk AND g.k = 1 GROUP BY f.passenger_sk, p.passenger_id, p.c_name"""
)
def mart_passenger_loyalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(marts.passenger_loyalty(*adapter.new_fact(spark, sf_dir)))


@query(
    adapter.SQL
    + f"""SELECT f.day AS flight_date, f.dep_sk AS departure_airport_sk, f.arr_sk AS arrival_airport_sk, f.tariff_sk, count(*) AS tickets_sold, {_BOARDED} AS passengers_boarded,
  CAST(sum(price) AS DOUBLE) AS total_revenue, CASE WHEN max(book_date) >= DATE '{adapter.DAY_2}' OR any_value(f.day) IN (SELECT day FROM fact WHERE book_date >= DATE '{adapter.DAY_2}') THEN 'run_2' ELSE 'run_1' END AS touched
FROM fact f WHERE f.dep_sk IS NOT NULL AND f.arr_sk IS NOT NULL AND f.tariff_sk IS NOT NULL GROUP BY f.day, f.dep_sk, f.arr_sk, f.tariff_sk"""
)
def mart_sales_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts booked before day two make the mart; the others arrive in a second run and touch whole dates."""
    rows, d = adapter.fact(spark, sf_dir)
    late = F.col("book_date") >= F.lit(adapter.DAY_2).cast("date")
    rows = rows.withColumn("_load_ts", F.when(late, RUN_2.ts()).otherwise(RUN_1.ts()))
    first = marts.sales_report(rows.where(~late), d).withColumn("_load_ts", RUN_1.ts()).withColumn("touched", F.lit("run_1"))
    grain = ["flight_date", "departure_airport_sk", "arrival_airport_sk", "tariff_sk"]
    stamp = lambda x: x.withColumn("_load_ts", RUN_2.ts()).withColumn("touched", F.lit("run_2")).select(*first.columns)
    out = recompute.affected_recompute(rows, first, ["calendar_sk"], lambda x: marts.sales_report(x, d), grain, ["touched"], None, stamp)
    return plain(out.select(*grain, "tickets_sold", "passengers_boarded", "total_revenue", "touched"))


# fact and dimensions


@query(adapter.SQL + "SELECT calendar_sk, dep_sk AS departure_airport_sk, arr_sk AS arrival_airport_sk, airplane_sk, tariff_sk, passenger_sk, route_sk, ticket_no AS book_ref, ticket_no, CAST(flight_id AS BIGINT) AS flight_id, book_date, seat_no, CAST(price AS DOUBLE) AS price, is_boarded FROM fact")
def fact_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return business(adapter.new_fact(spark, sf_dir)[0])


@query(
    adapter.SQL
    + """SELECT ticket_no, CAST(flight_id AS BIGINT) AS flight_id, tariff_sk, CASE WHEN is_boarded OR flight_id % 3 = 0 THEN seat_no ELSE NULL END AS seat_no, is_boarded,
  CAST(price AS DOUBLE) AS price, CASE WHEN flight_id % 3 = 0 AND is_boarded THEN 'run_2' ELSE 'run_1' END AS touched FROM fact"""
)
def fact_update_mutable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passes of every third flight appear later: measures change, resolved keys stay."""
    rows, _ = adapter.fact(spark, sf_dir)
    later = F.col("flight_id") % 3 == 0
    old = rows.withColumn("seat_no", F.when(~later, F.col("seat_no"))).withColumn("is_boarded", F.col("is_boarded") & ~later)
    new = rows.drop("_load_id", "_load_ts").withColumn("tariff_sk", F.lit(None).cast("int"))
    out = layers.fact_upsert(old, new, RUN_2)
    return plain(out.select("ticket_no", "flight_id", "tariff_sk", "seat_no", "is_boarded", "price", F.col("_load_id").alias("touched")))


@query("SELECT CAST(date_diff('day', DATE '2016-01-01', d) + 1 AS BIGINT) AS calendar_sk, d AS date_actual, year(d) AS year_actual, month(d) AS month_actual, day(d) AS day_actual, isodow(d) AS day_of_week, dayname(d) AS day_name, isodow(d) IN (6, 7) AS is_weekend FROM (SELECT CAST(unnest(generate_series(DATE '2016-01-01', DATE '2030-12-31', INTERVAL 1 DAY)) AS DATE) AS d)")
def calendar_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(dimension.calendar(spark))


@query("SELECT p_brand AS airplane_bk, lower(p_brand) AS model, CAST(replace(p_brand, 'Brand#', '') AS BIGINT) * 100 AS range_km, CAST(replace(p_brand, 'Brand#', '') AS BIGINT) * 10 + 500 AS speed_kmh, count(*) AS total_seats, row_number() OVER (ORDER BY p_brand) AS airplane_sk FROM part GROUP BY p_brand")
def dim_airplanes_seats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return business(adapter.dims(spark, sf_dir, "airplanes")["airplanes"])


@query("SELECT passenger_id, passenger_name FROM (SELECT CAST(o_custkey AS VARCHAR) AS passenger_id, c_name || '/' || CAST(o_orderkey % 7 AS VARCHAR) AS passenger_name, row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) DESC, CAST(o_orderkey AS VARCHAR) DESC) AS k FROM orders JOIN customer ON c_custkey = o_custkey) WHERE k = 1")
def dim_passengers_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passengers change their names; of tickets of one day the last ticket number decides."""
    tickets = adapter.current(spark, sf_dir)["tickets"]
    named = tickets.withColumn("passenger_name", F.concat_ws("/", "passenger_name", (F.col("ticket_no").cast("bigint") % 7).cast("string")))
    return layers.latest_passengers(named.withColumn("event_ts", F.date_trunc("day", "event_ts").cast("timestamp_ntz")))


@query("SELECT r AS passenger_sk, c_custkey AS passenger_id FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey % 2 <> 0, c_custkey) AS r FROM customer)")
def surrogate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even customers are known; odd ones get the next keys, in order."""
    c = adapter.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("passenger_id"))
    known = dimension.assign_keys(c.where("passenger_id % 2 = 0"), "passenger_sk", ["passenger_id"])
    return plain(known.unionByName(dimension.assign_keys(c.where("passenger_id % 2 <> 0"), "passenger_sk", ["passenger_id"], dimension.max_key(known, "passenger_sk"))))


@query("SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) + 7 AS sk, o_orderdate, o_orderkey FROM orders")
def surrogate_keys_ranged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense keys by a range-partitioned sort, as of more rows than one task should sort."""
    o = adapter.table(spark, sf_dir, "orders").select("o_orderdate", "o_orderkey")
    return plain(dimension.assign_keys(o, "sk", ["o_orderdate", "o_orderkey"], 7, one_sort=0))


@query("SELECT n_nationkey AS bk, CASE WHEN n_nationkey % 3 = 0 THEN n_name || '!' ELSE n_name END AS name, CASE WHEN n_nationkey >= 20 OR n_nationkey % 3 = 0 THEN 'run_2' ELSE 'run_1' END AS touched, row_number() OVER (ORDER BY n_nationkey >= 20, n_nationkey) AS sk FROM nation")
def scd1_dim_two_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = adapter.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("bk"), F.col("n_name").alias("name"))
    none = spark.createDataFrame([], "sk int, bk bigint, name string, created_at timestamp_ntz, updated_at timestamp_ntz, _load_id string, _load_ts timestamp_ntz")
    first = dimension.scd1_dimension(none, n.where("bk < 20"), "sk", "bk", ["name"], RUN_1)
    changed = n.withColumn("name", F.when(F.col("bk") % 3 == 0, F.concat("name", F.lit("!"))).otherwise(F.col("name")))
    second = dimension.scd1_dimension(first, changed, "sk", "bk", ["name"], RUN_2)
    return plain(second.select("sk", "bk", "name", F.col("_load_id").alias("touched")))


def two_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes of two loads: every fifth one moves, the seventh ones vanish, the last appear later."""
    frames = [adapter.sources(spark, sf_dir, changed_routes=c)["routes"] for c in (False, True)]
    d = adapter.dims(spark, sf_dir, "airports", "airplanes")
    typed = [layers.typed_rows("routes", f.withColumn("event_ts", RUN_1.ts()).withColumn("_load_id", F.lit("b")).withColumn("_load_ts", RUN_1.ts())) for f in frames]
    r = F.col("route_no").cast("int")
    now = [layers.route_versions(x, d["airports"], d["airplanes"]) for x in (typed[0].where(r % 11 != 0), typed[1].where(r % 7 != 0))]
    apply = lambda dim, src, run: dimension.scd2_apply(dim, src, "route_sk", "route_bk", layers.ROUTE_HASH, layers.ROUTE_REFRESH, run)
    return apply(apply(adapter.empty(spark, "dds.dim_routes"), now[0], RUN_1), now[1], RUN_2)


_ROUTES = """WITH s AS (SELECT *, CAST(s_suppkey AS VARCHAR) AS bk, 'Brand#' || CAST(s_suppkey % 25 + 1 AS VARCHAR) AS brand FROM supplier
  WHERE 'Brand#' || CAST(s_suppkey % 25 + 1 AS VARCHAR) IN (SELECT p_brand FROM part)),
v AS (SELECT bk, s_suppkey, k, CAST(s_nationkey AS VARCHAR) AS dep, CAST((s_nationkey + CASE WHEN k = 2 AND s_suppkey % 5 = 0 THEN 8 ELSE 7 END) % 25 AS VARCHAR) AS arr, brand,
  '{' || CAST(s_suppkey % 7 + 1 AS VARCHAR) || ',' || CAST((s_suppkey + 3) % 7 + 1 AS VARCHAR) || '}' AS days,
  printf('%02d:%02d:00', s_suppkey % 24, s_suppkey % 4 * 15) AS tm, printf('%02d:%02d:00', s_suppkey % 9 + 1, s_suppkey % 2 * 30) AS dur
  FROM s, (VALUES (1), (2)) t(k)),
h AS (SELECT *, md5(concat_ws('|', dep, arr, brand, days, tm, dur)) AS hash FROM v),
one AS (SELECT * FROM h WHERE k = 1 AND s_suppkey % 11 <> 0), two AS (SELECT * FROM h WHERE k = 2 AND s_suppkey % 7 <> 0),
first AS (SELECT one.bk, one.arr, one.hash, DATE '1900-01-01' AS valid_from, CASE WHEN two.hash IS NULL OR two.hash <> one.hash THEN DATE '2000-01-01' END AS valid_to,
  row_number() OVER (ORDER BY one.bk) AS route_sk FROM one LEFT JOIN two USING (bk)),
later AS (SELECT two.bk, two.arr, two.hash, CASE WHEN one.bk IS NULL THEN DATE '1900-01-01' ELSE DATE '2000-01-01' END AS valid_from, CAST(NULL AS DATE) AS valid_to,
  (SELECT count(*) FROM one) + row_number() OVER (ORDER BY two.bk) AS route_sk FROM two LEFT JOIN one USING (bk) WHERE one.hash IS NULL OR one.hash <> two.hash),
dim AS (SELECT * FROM first UNION ALL SELECT * FROM later)
"""


@query(_ROUTES + "SELECT route_sk, bk AS route_bk, arr AS arrival_airport, hash AS hashdiff, valid_from, valid_to FROM dim")
def scd2_two_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(two_versions(spark, sf_dir).select("route_sk", "route_bk", "arrival_airport", "hashdiff", "valid_from", "valid_to"))


#: Later versions of every tenth route start ten days late, those of every other fifth ten days early.
_BROKEN = _ROUTES.rstrip() + """, broken AS (SELECT route_sk, bk, valid_to, CASE WHEN valid_from <> DATE '2000-01-01' THEN valid_from WHEN CAST(bk AS INTEGER) % 10 = 0 THEN DATE '2000-01-11' ELSE DATE '1999-12-22' END AS valid_from FROM dim)
"""


def broken_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = lambda x: F.lit(x).cast("date")
    moved = F.when(F.col("route_bk").cast("int") % 10 == 0, day("2000-01-11")).otherwise(day("1999-12-22"))
    return two_versions(spark, sf_dir).withColumn("valid_from", F.when(F.col("valid_from") == day("2000-01-01"), moved).otherwise(F.col("valid_from")))


@query(_BROKEN + "SELECT a.bk AS route_bk, a.valid_to, b.valid_from AS next_from FROM broken a JOIN broken b ON a.bk = b.bk AND a.route_sk < b.route_sk WHERE a.valid_to IS NULL OR a.valid_to <> b.valid_from")
def scd2_gap_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions that don't meet, planted gaps and overlaps both."""
    return dimension.gaps(broken_versions(spark, sf_dir), "route_bk").select("route_bk", "valid_to", "next_from")


@query(_BROKEN + "SELECT a.route_sk AS a_sk, b.route_sk AS b_sk FROM broken a JOIN broken b ON a.bk = b.bk AND a.route_sk < b.route_sk AND a.valid_from < coalesce(b.valid_to, DATE '9999-12-31') AND b.valid_from < coalesce(a.valid_to, DATE '9999-12-31')")
def scd2_overlap_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(dimension.overlaps(broken_versions(spark, sf_dir), "route_sk", "route_bk").select("a_sk", "b_sk"))


_RULES = _BROKEN.rstrip() + """, x AS (SELECT route_sk, bk, CASE WHEN route_sk % 6 = 0 THEN NULL ELSE valid_to END AS t, valid_from AS f0 FROM broken),
y AS (SELECT route_sk, bk, t, coalesce(t, DATE '9999-12-31') AS far, CASE WHEN route_sk % 13 = 0 AND t IS NOT NULL THEN t + 1 ELSE f0 END AS f FROM x),
n AS (SELECT (SELECT count(*) FROM (SELECT bk FROM y WHERE t IS NULL GROUP BY bk HAVING count(*) > 1)) AS n_opens, (SELECT count(*) FROM y WHERE f > t) AS n_orders,
  (SELECT count(*) FROM y b WHERE b.f < b.far AND EXISTS (SELECT 1 FROM y a WHERE a.bk = b.bk AND a.f < a.far AND (a.f < b.f OR (a.f = b.f AND a.route_sk < b.route_sk)) AND a.far > b.f)) AS n_overlaps,
  (SELECT count(DISTINCT bk) FROM y WHERE t IS NULL AND CAST(bk AS INTEGER) % 3 = 0) AS n_sources)
SELECT c AS check_name, 'ERROR' AS severity, v = 0 AS ok, CAST(v AS DOUBLE) AS value FROM n, (VALUES ('v.open'), ('v.order'), ('v.overlap'), ('v.source')) k(c), LATERAL (SELECT CASE c WHEN 'v.open' THEN n_opens WHEN 'v.order' THEN n_orders WHEN 'v.overlap' THEN n_overlaps ELSE n_sources END AS v) z"""


@query(_RULES)
def dq_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules of versions: of every sixth route the first one stays open, others end before they begin, overlap, or have left the source."""
    sk = F.col("route_sk")
    dim = broken_versions(spark, sf_dir).withColumn("valid_to", F.when(sk % 6 != 0, F.col("valid_to")))
    dim = dim.withColumn("valid_from", F.when((sk % 13 == 0) & F.col("valid_to").isNotNull(), F.date_add("valid_to", 1)).otherwise(F.col("valid_from")))
    source = dim.select("route_bk").where(F.col("route_bk").cast("int") % 3 != 0).distinct()
    return tables.as_rows(spark, checks.versions("v", dim, "route_sk", "route_bk", source))


@query(_ROUTES + "SELECT bk AS route_bk, count(*) AS versions, min(valid_from) AS first_from, count(DISTINCT hash) AS hashes FROM dim GROUP BY bk HAVING count(*) > 1")
def report_multi_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes with several versions."""
    g = two_versions(spark, sf_dir).groupBy("route_bk").agg(F.count(F.lit(1)).alias("versions"), F.min("valid_from").alias("first_from"), F.count_distinct("hashdiff").alias("hashes"))
    return g.where("versions > 1")


@query(
    "WITH ver AS (SELECT p_partkey, p_brand, DATE '1900-01-01' AS f, DATE '1998-01-01' AS t FROM part UNION ALL SELECT p_partkey, p_brand || '+', DATE '1998-01-01', CASE WHEN p_partkey % 10 = 0 THEN DATE '2000-01-01' END FROM part) SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate, ver.p_brand AS brand FROM lineitem LEFT JOIN ver ON l_partkey = p_partkey AND CAST(l_shipdate AS DATE) >= f AND (t IS NULL OR CAST(l_shipdate AS DATE) < t)"
)
def asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = adapter.table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    day = lambda x: F.lit(x).cast("date")
    old = part.select("p_partkey", "p_brand", day("1900-01-01").alias("valid_from"), day("1998-01-01").alias("valid_to"))
    new = part.select("p_partkey", F.concat("p_brand", F.lit("+")).alias("p_brand"), day("1998-01-01").alias("valid_from"), F.when(F.col("p_partkey") % 10 == 0, day("2000-01-01")).alias("valid_to"))
    rows = adapter.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    return plain(dimension.asof_lookup(rows, old.unionByName(new), ("l_partkey", "p_partkey"), F.to_date("l_shipdate"), {"p_brand": "brand"}))


@query("SELECT l_orderkey, l_linenumber, s_name, v FROM lineitem LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY v DESC) AS k FROM (SELECT s_suppkey, s_name, unnest(['a', 'b', CASE WHEN s_suppkey % 2 = 0 THEN 'c' ELSE 'B' END]) AS v FROM supplier)) s ON s.s_suppkey = l_suppkey AND k = 1")
def latest_version_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = adapter.table(spark, sf_dir, "supplier")
    versions = s.withColumn("v", F.explode(F.array(F.lit("a"), F.lit("b"), F.when(F.col("s_suppkey") % 2 == 0, "c").otherwise("B"))))
    rows = adapter.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    return plain(dimension.lookup(rows, dimension.latest_version(versions, "s_suppkey", "v"), "l_suppkey", "s_suppkey", {"s_name": "s_name", "v": "v"}).drop("l_suppkey"))


# increments

_ORDERS = "SELECT o_orderkey, o_orderdate FROM orders"


@query(f"WITH m AS (SELECT max(o_orderdate) AS hwm FROM orders WHERE o_orderdate < TIMESTAMP '{adapter.DAY_2}') SELECT CAST(o_orderkey AS VARCHAR) AS book_ref, o_orderdate AS event_ts, 'run_2' AS load_id FROM orders, m WHERE o_orderdate > hwm")
def hwm_append_day2(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = adapter.sources(spark, sf_dir)
    target = adapter.staged(frames, "bookings").where(F.col("event_ts") < F.lit(adapter.DAY_2).cast("timestamp_ntz"))
    rows = increment.hwm_append(frames["bookings"], target, ["book_ref"], "book_date", frames["bookings"].columns, RUN_2)
    return rows.select("book_ref", "event_ts", F.col("_load_id").alias("load_id"))


@query("SELECT count(*) AS n FROM orders WHERE false")
def hwm_append_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same run again adds nothing."""
    frames = adapter.sources(spark, sf_dir)
    target = adapter.staged(frames, "bookings")
    return increment.hwm_append(frames["bookings"], target, ["book_ref"], "book_date", frames["bookings"].columns, RUN_1).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS airport_code, lower(n_name) || CASE WHEN n_nationkey % 2 = 0 THEN '2' ELSE '' END AS airport_name FROM nation WHERE n_nationkey <> 3")
def snapshot_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches with changes, one vanished key and repeated rows: the second is the new content."""
    frames = adapter.sources(spark, sf_dir)
    one = adapter.staged(frames, "airports", RUN_1)
    two = adapter.staged(frames, "airports", RUN_2).where("airport_code <> '3'")
    renamed = two.withColumn("airport_name", F.when(F.col("airport_code").cast("int") % 2 == 0, F.regexp_replace("airport_name", '"}$', '2"}')).otherwise(F.col("airport_name")))
    stage = one.unionByName(renamed).unionByName(renamed)
    return layers.typed_rows("airports", increment.snapshot_of(stage, "run_2", ["airport_code"])).select("airport_code", "airport_name")


@query("SELECT event_id, user_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id DESC) AS k FROM events) WHERE k = 1")
def dedup_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = adapter.table(spark, sf_dir, "events")
    return increment.latest(e, ["user_id"], F.col("ts").desc_nulls_last(), F.col("event_id").desc()).select("event_id", "user_id", "ts")


@query("SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC, ts DESC) AS k FROM events) WHERE k = 1")
def dedup_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = adapter.table(spark, sf_dir, "events").withColumn("_load_ts", F.col("event_id")).withColumn("event_ts", F.col("ts"))
    return increment.latest_load(e, ["event_type"]).select("event_id", "event_type")


@query(
    f"""WITH li AS (SELECT *, l_suppkey * 1000 + (year(l_shipdate) - 1995) * 12 + month(l_shipdate) AS flight_id FROM lineitem),
dep AS (SELECT flight_id, min(l_shipdate) AS dep FROM li GROUP BY flight_id),
named AS (SELECT DISTINCT flight_id FROM li JOIN orders ON o_orderkey = l_orderkey WHERE o_orderdate >= TIMESTAMP '{adapter.DAY_2}')
SELECT CAST(flight_id AS VARCHAR) AS flight_id, dep AS event_ts FROM dep WHERE dep >= TIMESTAMP '{adapter.DAY_2}' OR flight_id IN (SELECT flight_id FROM named)"""
)
def flights_with_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flights staged on day two, and older ones that segments of day two name."""
    frames = adapter.sources(spark, sf_dir)
    by_day = lambda x: x.withColumn("_load_ts", F.when(F.col("event_ts") < F.lit(adapter.DAY_2).cast("timestamp_ntz"), RUN_1.ts()).otherwise(RUN_2.ts()))
    flights, segments = (stable(by_day(adapter.staged(frames, n))) for n in ("flights", "segments"))  # as a warehouse has them: the marks read them again
    old = flights.where(F.col("_load_ts") == RUN_1.ts())
    rows = increment.hwm_delta_with_history(flights, old, ["flight_id"], segments, segments.where(F.col("_load_ts") == RUN_1.ts()), "flight_id")
    return rows.select("flight_id", "event_ts")


@query("WITH b AS (SELECT r_regionkey AS k FROM region), four AS (SELECT k FROM b INTERSECT SELECT k FROM b WHERE k <> 4 INTERSECT SELECT k FROM b WHERE k <> 0 INTERSECT SELECT k FROM b) SELECT 'batch_' || CAST(k AS VARCHAR) AS load_id, TIMESTAMP '2024-01-01' + to_days(CAST(k AS INTEGER) * 2) AS ready_ts FROM four ORDER BY ready_ts DESC, load_id DESC LIMIT 1")
def batch_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = adapter.table(spark, sf_dir, "region").select(F.concat(F.lit("batch_"), F.col("r_regionkey").cast("string")).alias("_load_id"), F.col("r_regionkey").alias("k"))
    at = lambda days: r.withColumn("_load_ts", F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.col("k") * days))
    stages = [at(1), at(2).where("k <> 4"), at(1).where("k <> 0"), at(1)]
    chosen = increment.resolve_batch(stages)
    return increment.common_batches(stages).where(F.col("_load_id") == chosen).select(F.col("_load_id").alias("load_id"), "ready_ts")


_UPSERT = """WITH d AS (SELECT c_custkey, CASE WHEN c_custkey % 20 = 0 THEN NULL WHEN c_custkey % 20 = 1 THEN upper(c_name) || '*' ELSE c_name END AS c_name, c_acctbal FROM customer WHERE c_custkey % 20 < 5 OR c_custkey >= 1000)
SELECT coalesce(t.c_custkey, d.c_custkey) AS c_custkey, CASE WHEN t.c_custkey IS NULL OR (d.c_custkey IS NOT NULL AND t.c_name IS DISTINCT FROM d.c_name) THEN d.c_name ELSE t.c_name END AS c_name,
  CASE WHEN t.c_custkey IS NULL OR (d.c_custkey IS NOT NULL AND t.c_name IS DISTINCT FROM d.c_name) THEN 'run_2' ELSE 'run_1' END AS touched
FROM (SELECT * FROM customer WHERE c_custkey < 1000) t FULL JOIN d ON t.c_custkey = d.c_custkey"""


def _renamed(customers: DataFrame) -> DataFrame:
    k = F.col("c_custkey") % 20
    name = F.when(k == 0, F.lit(None)).when(k == 1, F.concat(F.upper("c_name"), F.lit("*"))).otherwise(F.col("c_name"))
    return customers.withColumn("c_name", name).withColumn("touched", F.lit("run_2"))


def _upsert(spark: SparkSession, sf_dir: str, counted: bool) -> DataFrame:
    c = adapter.table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    delta = _renamed(c.where((F.col("c_custkey") % 20 < 5) | (F.col("c_custkey") >= 1000)))
    return merge.scd1_upsert(c.where("c_custkey < 1000").withColumn("touched", F.lit("run_1")), delta, ["c_custkey"], ["c_name"], delta_rows=delta.count() if counted else None)


@query(_UPSERT)
def scd1_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _upsert(spark, sf_dir, False)


@query(_UPSERT)
def scd1_upsert_small_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The delta's rows are counted; it is broadcast only as long as they are few."""
    return _upsert(spark, sf_dir, True)


@query(
    """WITH d AS (SELECT c_custkey, CASE WHEN c_custkey % 20 = 0 THEN NULL WHEN c_custkey % 20 = 1 THEN upper(c_name) || '*' ELSE c_name END AS c_name FROM customer WHERE c_custkey < 100 AND c_custkey % 20 < 5 OR c_custkey BETWEEN 100 AND 119)
SELECT coalesce(t.c_custkey, d.c_custkey) AS c_custkey, CASE WHEN t.c_custkey IS NULL OR (d.c_custkey IS NOT NULL AND t.c_name IS DISTINCT FROM d.c_name) THEN d.c_name ELSE t.c_name END AS c_name,
  CASE WHEN t.c_custkey IS NULL OR (d.c_custkey IS NOT NULL AND t.c_name IS DISTINCT FROM d.c_name) THEN 'run_2' ELSE 'run_1' END AS touched
FROM (SELECT * FROM customer WHERE c_custkey NOT BETWEEN 100 AND 119) t FULL JOIN d ON t.c_custkey = d.c_custkey"""
)
def scd1_upsert_large_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A delta of some 45 rows, new and changed ones, against a target that grows with the table."""
    c = adapter.table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    delta = _renamed(c.where("c_custkey < 100 AND c_custkey % 20 < 5 OR c_custkey BETWEEN 100 AND 119"))
    target = c.where("c_custkey NOT BETWEEN 100 AND 119").withColumn("touched", F.lit("run_1"))
    return merge.scd1_upsert(target, delta, ["c_custkey"], ["c_name"], delta_rows=delta.count())


# relational inventory


def _t(name: str):
    return lambda spark, sf_dir: adapter.table(spark, sf_dir, name)


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t("events")(spark, sf_dir).select("event_id", parse.typed(parse.localised("props", "k"), "bigint").alias("k"))


@query("SELECT l_orderkey, l_linenumber, CAST(CAST(l_extendedprice AS DECIMAL(10,2)) AS DOUBLE) AS price, CAST(l_shipdate AS DATE) AS day, CASE WHEN l_linenumber = 1 THEN NULL ELSE CAST(l_linenumber AS BIGINT) END AS number, l_returnflag = 'R' AS returned FROM lineitem")
def typed_cast_nullif(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _t("lineitem")(spark, sf_dir)
    text = li.select("l_orderkey", "l_linenumber", F.col("l_extendedprice").cast("decimal(10,2)").cast("string").alias("p"), F.col("l_shipdate").cast("string").alias("d"), F.when(F.col("l_linenumber") == 1, "").otherwise(F.col("l_linenumber").cast("string")).alias("n"), F.when(F.col("l_returnflag") == "R", "t").otherwise("f").alias("r"))
    return plain(text.select("l_orderkey", "l_linenumber", parse.typed("p", "decimal(10,2)").alias("price"), F.to_date(parse.typed("d", "timestamp_ntz")).alias("day"), parse.typed("n", "int").alias("number"), parse.typed("r", "boolean").alias("returned")))


@query("SELECT o_orderpriority, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, count(*) FILTER (WHERE o_totalprice > 300000) AS large FROM orders GROUP BY 1")
def filter_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t("orders")(spark, sf_dir)
    return o.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.count_if(F.col("o_totalprice") > 300000).alias("large"))


@query("SELECT n_regionkey AS region, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY 1")
def ordered_listagg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of a region as one text; a region has few nations."""
    return plain(_t("nation")(spark, sf_dir).groupBy(F.col("n_regionkey").alias("region")).agg(F.array_join(F.sort_array(F.collect_list("n_name")), ",").alias("names")))


@query("SELECT 'orders' AS table_name, count(*) AS n FROM orders UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'supplier', count(*) FROM supplier")
def scorecard_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.counts({n: _t(n)(spark, sf_dir) for n in ("orders", "customer", "part", "supplier")})


@query("SELECT l_returnflag, count(*) AS n, CAST(sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS done, ((20000 * CAST(sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) + count(*)) // (2 * count(*))) / 10000.0 AS rate, greatest(min(l_linenumber), 2) AS low FROM lineitem GROUP BY 1")
def conditional_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _t("lineitem")(spark, sf_dir).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("l_linestatus") == "F", 1).otherwise(0)).alias("done"), F.min("l_linenumber").alias("low"))
    return plain(g.select("l_returnflag", "n", "done", parse.ratio(F.col("done"), F.col("n")).alias("rate"), F.greatest("low", F.lit(2)).alias("low")))


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def in_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    poor = _t("customer")(spark, sf_dir).where("c_acctbal < 0").select("c_custkey")
    return _t("orders")(spark, sf_dir).join(poor, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")


@query("SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)")
def not_exists_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t("orders")(spark, sf_dir).join(_t("lineitem")(spark, sf_dir), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@query("SELECT c_custkey, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) THEN 'known' ELSE 'new' END AS kind FROM customer")
def exists_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = _t("orders")(spark, sf_dir).select(F.col("o_custkey").alias("k")).distinct()
    return _t("customer")(spark, sf_dir).join(seen, F.col("c_custkey") == F.col("k"), "left").select("c_custkey", F.when(F.col("k").isNotNull(), "known").otherwise("new").alias("kind"))


@query("SELECT s_suppkey, CAST(unnest([s_suppkey % 7 + 1, (s_suppkey + 3) % 7 + 1]) AS BIGINT) AS day FROM supplier")
def array_parse_unnest(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _t("supplier")(spark, sf_dir)
    text = s.select("s_suppkey", F.concat(F.lit("{"), (F.col("s_suppkey") % 7 + 1).cast("string"), F.lit(","), ((F.col("s_suppkey") + 3) % 7 + 1).cast("string"), F.lit("}")).alias("days"))
    return plain(text.select("s_suppkey", F.explode(parse.int_array("days")).alias("day")))


@query("SELECT date_trunc('day', ts) + INTERVAL 1 DAY AS next_day, count(*) AS n FROM events GROUP BY 1")
def date_trunc_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_trunc("day", "ts").cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY")
    return _t("events")(spark, sf_dir).groupBy(day.alias("next_day")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 1")
def top1_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t("orders")(spark, sf_dir).orderBy(F.col("o_orderdate").desc(), "o_orderkey").limit(1).select("o_orderkey", "o_orderdate")


@query(adapter.SQL + ", per AS (SELECT airplane_sk, flight_id, count(*) AS n, count(*) FILTER (WHERE is_boarded) AS b FROM fact WHERE airplane_sk IS NOT NULL GROUP BY 1, 2) SELECT airplane_sk, count(*) AS flights, CAST(sum(n) AS BIGINT) AS tickets, max(b) AS most_boarded FROM per GROUP BY 1")
def two_level_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flights first, then airplanes."""
    rows, _ = adapter.new_fact(spark, sf_dir, *adapter.FLIGHT)
    per = rows.where("airplane_sk IS NOT NULL").groupBy("airplane_sk", "flight_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_boarded").alias("b"))
    return plain(per.groupBy("airplane_sk").agg(F.count(F.lit(1)).alias("flights"), F.sum("n").alias("tickets"), F.max("b").alias("most_boarded")))


@query("SELECT c_mktsegment AS segment, o_orderpriority AS mode FROM (SELECT c_mktsegment, o_orderpriority, row_number() OVER (PARTITION BY c_mktsegment ORDER BY count(*) DESC, o_orderpriority) AS k FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2) WHERE k = 1")
def most_frequent_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t("orders")(spark, sf_dir).join(_t("customer")(spark, sf_dir), F.col("o_custkey") == F.col("c_custkey")).withColumnRenamed("c_mktsegment", "segment")
    return recompute.most_frequent(rows, ["segment"], "o_orderpriority", "mode")


@query(adapter.SQL + "SELECT fare_conditions, count(*) AS tickets, CAST(sum(price) AS DOUBLE) AS revenue FROM fact JOIN tariff USING (tariff_sk) GROUP BY 1 ORDER BY 3 DESC")
def report_by_tariff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, d = adapter.new_fact(spark, sf_dir, *adapter.FLIGHT, "tariffs")
    return plain(rows.join(d["tariffs"].select("tariff_sk", "fare_conditions"), "tariff_sk").groupBy("fare_conditions").agg(F.count(F.lit(1)).alias("tickets"), F.sum("price").alias("revenue")).orderBy(F.col("revenue").desc()))


@query(adapter.SQL + "SELECT r.route_sk, r.route_bk, count(f.ticket_no) AS facts FROM route r LEFT JOIN fact f USING (route_sk) GROUP BY 1, 2")
def report_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, d = adapter.new_fact(spark, sf_dir, *adapter.FLIGHT)
    return plain(d["routes"].select("route_sk", "route_bk").join(rows.select("route_sk", "ticket_no"), "route_sk", "left").groupBy("route_sk", "route_bk").agg(F.count("ticket_no").alias("facts")))


_KEYS = ("calendar_sk", "departure_airport_sk", "arrival_airport_sk", "airplane_sk", "tariff_sk", "passenger_sk", "route_sk")


@query(adapter.SQL + "SELECT count(*) AS n, " + ", ".join(f"count(*) - count({s}) AS null_{k}" for k, s in zip(_KEYS, ("calendar_sk", "dep_sk", "arr_sk", "airplane_sk", "tariff_sk", "passenger_sk", "route_sk"), strict=True)) + " FROM fact")
def report_null_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = adapter.new_fact(spark, sf_dir)
    return rows.agg(F.count(F.lit(1)).alias("n"), *[(F.count(F.lit(1)) - F.count(k)).alias(f"null_{k}") for k in _KEYS])


# data quality


@query("SELECT 'lines' AS check_name, 'ERROR' AS severity, n = 0 AS ok, CAST(n AS DOUBLE) AS value FROM (SELECT count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS n FROM lineitem) UNION ALL SELECT 'suppliers', 'ERROR', n = 0, CAST(n AS DOUBLE) FROM (SELECT count(*) - count(DISTINCT (l_orderkey, l_suppkey % 3)) AS n FROM lineitem)")
def dq_unique_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _t("lineitem")(spark, sf_dir).withColumn("third", F.col("l_suppkey") % 3)
    return tables.as_rows(spark, [checks.unique("lines", li, ["l_orderkey", "l_linenumber"]), checks.unique("suppliers", li, ["l_orderkey", "third"])])


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def dq_having_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(checks.duplicate_keys(_t("lineitem")(spark, sf_dir), ["l_orderkey", "l_linenumber"]))


@query("SELECT DISTINCT o_orderkey FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE l_orderkey IS NULL")
def dq_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.missing(_t("orders")(spark, sf_dir), _t("lineitem")(spark, sf_dir), ["o_orderkey"], ["l_orderkey"])


@query("SELECT o_custkey AS k, 'extra' AS side FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 0) UNION ALL SELECT c_custkey, 'missing' FROM (SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 0 EXCEPT SELECT o_custkey FROM orders)")
def dq_missing_extra_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = _t("customer")(spark, sf_dir).where("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("k"))
    held = _t("orders")(spark, sf_dir).select(F.col("o_custkey").alias("k"))
    return merge.missing(held, expected, ["k"]).withColumn("side", F.lit("extra")).unionByName(merge.missing(expected, held, ["k"]).withColumn("side", F.lit("missing")))


@query("SELECT event_id FROM events WHERE CASE WHEN event_id % 50 = 0 THEN NULL WHEN event_id % 50 = 1 THEN ' ' ELSE event_type END IS NULL OR trim(CASE WHEN event_id % 50 = 1 THEN ' ' ELSE event_type END) = ''")
def dq_null_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 50
    e = _t("events")(spark, sf_dir).withColumn("event_type", F.when(k == 0, F.lit(None)).when(k == 1, " ").otherwise(F.col("event_type")))
    return e.where(F.coalesce(checks.blank(["event_type"], ["event_type"]), F.lit(True))).select("event_id")


_SHARES = " UNION ALL ".join(
    f"SELECT '{n}.any' AS check_name, 'WARN' AS severity, b = 0 AS ok, CAST(b AS DOUBLE) AS value FROM {v} UNION ALL SELECT '{n}', 'ERROR', b / n <= 0.01, b / n FROM {v}" for n, v in (("poor", "p"), ("few", "f"))
)


@query(f"WITH p AS (SELECT count(*) AS n, count(*) FILTER (WHERE c_acctbal < 0) AS b FROM customer), f AS (SELECT count(*) AS n, count(*) FILTER (WHERE l_orderkey % 1000 = 1) AS b FROM lineitem) {_SHARES}")
def dq_ratio_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A share above the limit and one below it; any bad row warns."""
    c, li = _t("customer")(spark, sf_dir), _t("lineitem")(spark, sf_dir)
    return tables.as_rows(spark, [*checks.share("poor", c, F.col("c_acctbal") < 0), *checks.share("few", li, F.col("l_orderkey") % 1000 == 1)])


@query(
    adapter.SQL
    + """, m AS (SELECT dep_sk, count(*) AS n, count(*) FILTER (WHERE is_boarded) AS b, sum(price) * CASE WHEN dep_sk = 1 THEN -1 ELSE 1 END AS s FROM fact WHERE dep_sk IS NOT NULL AND arr_sk IS NOT NULL GROUP BY day, dep_sk, arr_sk, tariff_sk),
    c AS (SELECT count(*) FILTER (WHERE b + CASE WHEN dep_sk = 2 THEN 1000 ELSE 0 END > n) AS boarded, count(*) FILTER (WHERE s < 0) AS revenue FROM m)
  SELECT 'sales_report.boarded' AS check_name, 'ERROR' AS severity, boarded = 0 AS ok, CAST(boarded AS DOUBLE) AS value FROM c UNION ALL SELECT 'sales_report.rate', 'ERROR', true, 0.0 UNION ALL SELECT 'sales_report.revenue', 'ERROR', revenue = 0, CAST(revenue AS DOUBLE) FROM c"""
)
def dq_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The invariants of the sales mart, with negative revenue of one airport and too many passengers of another."""
    m = marts.sales_report(*adapter.new_fact(spark, sf_dir, *adapter.FLIGHT, "tariffs"))
    k = F.col("departure_airport_sk")
    broken = m.withColumn("total_revenue", F.when(k == 1, -F.col("total_revenue")).otherwise(F.col("total_revenue"))).withColumn("passengers_boarded", F.col("passengers_boarded") + F.when(k == 2, 1000).otherwise(0))
    return tables.as_rows(spark, checks.sales_invariants(broken))


@query(f"SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) IN (SELECT CAST(o_orderdate AS DATE) FROM orders WHERE o_orderdate >= TIMESTAMP '{adapter.DAY_2}' AND o_orderkey % 3 = 0)")
def dq_affected_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the dates that a run's rows touch."""
    o = _t("orders")(spark, sf_dir).withColumn("day", F.to_date("o_orderdate"))
    mine = (F.col("o_orderdate") >= F.lit(adapter.DAY_2).cast("timestamp_ntz")) & (F.col("o_orderkey") % 3 == 0)
    tagged = o.withColumn("_load_id", F.when(mine, "run_2").otherwise("run_1"))
    return checks.only_run(o, tagged, "run_2", ["day"]).select("o_orderkey")


def _more() -> None:
    """Queries over stored tables, validators, flows and streams."""
    from lakeloom.plans import feeds, stored

    for more in (stored, feeds):
        QUERIES.update(more.QUERIES)
        SQL.update(more.SQL)


_more()


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mart_sales_report(spark, sf_dir)


__all__ = ["QUERIES", "SQL", "Column", "flagship"]
