"""Registered queries over stored tables, loads, validators, flows and streams, each with its rows in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.flow.graph import Graph, Task, poll
from lakeloom.operators import increment
from lakeloom.plans import adapter, layers
from lakeloom.quality import checks, tables
from lakeloom.quality.checks import Finding, QualityError
from lakeloom.schemas import Table
from lakeloom.session import Run
from lakeloom.sources.storage import Missing, Store, shared_folder
from lakeloom.streaming import stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
RUN_1, RUN_2 = adapter.RUN, Run("run_2", datetime(2024, 1, 3), date(2000, 1, 1))


def query(sql: str):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def findings_of(check: Callable[[], list[Finding]]) -> list[Finding]:
    """Findings of checks that may fail."""
    try:
        return check()
    except QualityError as e:
        return e.findings


def expected(*rows: str) -> str:
    """SQL of findings: name, severity and an expression of the value, which is zero where all is well."""
    parts = [r.split("|") for r in rows]
    return " UNION ALL ".join(f"SELECT '{n}' AS check_name, '{s}' AS severity, ({v}) = 0 AS ok, CAST(({v}) AS DOUBLE) AS value" for n, s, v in parts)


# tables


def new_store(spark: SparkSession, **made: Table) -> Store:
    store = Store(spark, f"{shared_folder(spark)}/lakeloom-stores/{uuid.uuid4().hex}", {t.name: t for t in made.values()})
    store.bootstrap()
    return store


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapter.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("bigint").alias("k"), F.col("c_name").alias("name"))


_CUSTOMERS = Table("a.customers", {"k": "bigint!", "name": "string"}, ("k",))


@query("SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN upper(c_name) ELSE c_name || '!' END AS name FROM customer")
def store_append_and_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two appends, a part that is refused, a replacement from the table's own content, a truncation that is taken back."""
    c, store = _customers(spark, sf_dir), new_store(spark, c=_CUSTOMERS)
    store.append("a.customers", c.where("k % 2 = 0"))
    store.append("a.customers", c.where("k % 2 = 1"))
    try:
        store.append("a.customers", c.withColumn("k", F.lit(None).cast("bigint")))
    except Missing:
        even = F.col("k") % 2 == 0
        store.replace("a.customers", store.read("a.customers").withColumn("name", F.when(even, F.upper("name")).otherwise(F.concat("name", F.lit("!")))))
    held = store.version("a.customers")
    store.truncate("a.customers")
    store.restore("a.customers", held)
    store.vacuum("a.customers")
    return store.read("a.customers")


@query("SELECT 'before' AS moment, false AS there, 0 AS n UNION ALL SELECT 'created', true, 0 UNION ALL SELECT 'filled', true, (SELECT count(*) FROM customer) UNION ALL SELECT 'reset', true, 0")
def store_existence(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store(spark, f"{shared_folder(spark)}/lakeloom-stores/{uuid.uuid4().hex}", {"a.customers": _CUSTOMERS})
    seen = []
    look = lambda moment: seen.append((moment, store.exists("a.customers"), store.read("a.customers").count()))
    look("before")
    store.bootstrap()
    store.bootstrap()
    look("created")
    store.append("a.customers", _customers(spark, sf_dir))
    look("filled")
    store.reset()
    look("reset")
    return spark.createDataFrame(seen, "moment string, there boolean, n bigint")


_ORDERS = Table("a.orders", {"k": "bigint!", "day": "date", "price": "double", "touched": "string"}, ("k",), partition="date_format(day, 'yyyy-MM')")


@query("SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS day, o_totalprice AS price, CASE WHEN year(o_orderdate) = 1997 AND month(o_orderdate) IN (3, 4) THEN 'run_2' ELSE 'run_1' END AS touched FROM orders")
def store_replace_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two months of a table in months are written again; the other months keep their files."""
    o = adapter.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("bigint").alias("k"), F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").alias("price"), F.lit("run_1").alias("touched"))
    store = new_store(spark, o=_ORDERS)
    store.append("a.orders", o)
    months = ["1997-03", "1997-04"]
    store.replace_partitions("a.orders", store.read("a.orders", partitions=months).withColumn("touched", F.lit("run_2")), months)
    return store.read("a.orders")


@query("SELECT 'a.customers' AS table_name, (SELECT count(*) FROM customer) AS n, c AS column_name, CAST(0 AS BIGINT) AS nulls, CASE c WHEN 'k' THEN CAST((SELECT min(c_custkey) FROM customer) AS VARCHAR) ELSE (SELECT min(c_name) FROM customer) END AS least, CASE c WHEN 'k' THEN CAST((SELECT max(c_custkey) FROM customer) AS VARCHAR) ELSE (SELECT max(c_name) FROM customer) END AS greatest FROM (VALUES ('k'), ('name')) t(c)")
def table_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics in one scan; the number of values, which is estimated, is left out."""
    store = new_store(spark, c=_CUSTOMERS)
    store.append("a.customers", _customers(spark, sf_dir))
    return store.analyze("a.customers").drop("values")


@query("SELECT CAST(1 AS BIGINT) AS one, 'constant' AS label, (SELECT count(*) FROM orders) AS n, EXISTS (SELECT 1 FROM orders WHERE o_totalprice > 400000) AS some")
def constant_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row of constants with what is asked of a table: its rows, and whether it has a certain one, which one row decides."""
    o = adapter.table(spark, sf_dir, "orders")
    some = not o.where("o_totalprice > 400000").limit(1).isEmpty()
    return spark.sql("SELECT CAST(1 AS BIGINT) AS one, 'constant' AS label, (SELECT count(*) FROM {o}) AS n, :some AS some", args={"some": some}, o=o)


@query("SELECT k, label FROM nation JOIN (VALUES (CAST(1 AS BIGINT), 'one'), (7, 'seven'), (99, 'none')) t(k, label) ON k = n_nationkey")
def inline_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(1, "one"), (7, "seven"), (99, "none")], "k bigint, label string")
    return rows.join(adapter.table(spark, sf_dir, "nation").select("n_nationkey"), F.col("k") == F.col("n_nationkey"), "left_semi")


@query("SELECT TIMESTAMP '2024-01-03' AS now, DATE '2000-01-01' AS today, 'run_2' AS run_id, count(*) AS n FROM region")
def run_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run is the only source of "now"; all rows of a load share its moment."""
    r = adapter.table(spark, sf_dir, "region").withColumn("now", RUN_2.ts()).withColumn("today", RUN_2.date()).withColumn("run_id", RUN_2.id())
    return r.groupBy("now", "today", "run_id").agg(F.count(F.lit(1)).alias("n"))


# loads


@query("SELECT CAST(n_nationkey AS VARCHAR) AS airport_code, r AS load_id FROM nation, (VALUES ('run_1'), ('run_2')) t(r)")
def snapshot_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full copies of two runs; the second one's repeat adds nothing."""
    frames = adapter.sources(spark, sf_dir)
    source, names = frames["airports"], frames["airports"].columns
    held = adapter.empty(spark, "stg.airports")
    for run in (RUN_1, RUN_2, RUN_2):
        held = held.unionByName(increment.snapshot_append(source, held, ["airport_code"], names, run).select(*held.columns))
    return held.select("airport_code", F.col("_load_id").alias("load_id"))


@query(f"SELECT CAST(o_orderkey AS VARCHAR) AS book_ref, o_orderdate + CASE WHEN o_orderkey % 3 = 0 THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END AS event_ts FROM orders WHERE o_orderdate >= TIMESTAMP '{adapter.DAY_2}'")
def hwm_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows staged after the current state, the latest of each key; every third one was staged twice."""
    stage = adapter.staged(adapter.sources(spark, sf_dir), "bookings")
    late = F.col("event_ts") >= F.lit(adapter.DAY_2).cast("timestamp_ntz")
    old = stage.where(~late)
    new = stage.where(late).withColumn("_load_ts", RUN_2.ts())
    again = new.where(F.col("book_ref").cast("bigint") % 3 == 0).withColumn("event_ts", F.col("event_ts") + F.expr("INTERVAL 1 DAY"))
    return increment.hwm_delta(old.unionByName(new).unionByName(again), old, ["book_ref"]).select("book_ref", "event_ts")


@query(f"SELECT CAST(o_orderkey AS VARCHAR) AS ticket_no, o_orderdate AS book_date FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderdate > TIMESTAMP '{adapter.DAY_2}'")
def incremental_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickets above a mark: bookings are cut before they are joined."""
    rows, event = layers.incremental_source(adapter.source(spark, sf_dir), "tickets", datetime.fromisoformat(adapter.DAY_2))
    return rows.select("ticket_no", event)


# checks




@query(
    expected("whole|ERROR|0", "short.empty|INFO|0", "lost|ERROR|(SELECT -count(*) FROM orders WHERE o_orderkey % 5 = 0 AND o_orderdate > TIMESTAMP '1999-01-01')", "copy|ERROR|0", "copy.lost|ERROR|(SELECT -count(*) FROM nation WHERE n_nationkey < 3)")
    .replace("(0) = 0 AS ok, CAST((0) AS DOUBLE) AS value UNION ALL SELECT 'lost'", "false AS ok, 0.0 AS value UNION ALL SELECT 'short', 'ERROR', true, 0.0 UNION ALL SELECT 'lost'")
)
def dq_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches against their source windows: a whole one, an empty one, one that lost rows; and two snapshots."""
    o = adapter.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    window = increment.newer(o, "o_orderdate", datetime(1999, 1, 1))
    none = increment.newer(o, "o_orderdate", datetime(2999, 1, 1))
    n = adapter.table(spark, sf_dir, "nation")
    found = [*checks.window_equal("whole", window, window), *checks.window_equal("short", none, none), *checks.window_equal("lost", window, window.where("o_orderkey % 5 <> 0"))]
    return tables.as_rows(spark, [*found, checks.count_equal("copy", n, n), checks.count_equal("copy.lost", n, n.where("n_nationkey >= 3"))])


@query(
    expected(
        "unique|ERROR|(SELECT count(*) - count(DISTINCT o_custkey) FROM orders)",
        "filled|ERROR|(SELECT count(*) FROM orders WHERE o_orderkey % 50 IN (0, 1))",
        "parents|ERROR|(SELECT count(DISTINCT o_custkey) FROM orders WHERE o_custkey % 7 = 0)",
        "lenient|WARN|(SELECT count(DISTINCT o_custkey) FROM orders WHERE o_custkey % 7 = 0)",
        "covers|ERROR|(SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders))",
        "extra|ERROR|(SELECT count(DISTINCT o_custkey) FROM orders WHERE o_custkey % 7 = 0)",
        "order|ERROR|(SELECT count(*) FROM orders WHERE o_totalprice < 1000)",
        "factor|ERROR|(SELECT count(*) FROM orders WHERE o_totalprice > 200000)",
    )
    + " UNION ALL SELECT 'least', 'ERROR', n >= 1000, CAST(n AS DOUBLE) FROM (SELECT count(*) AS n FROM orders) UNION ALL SELECT 'rows', 'ERROR', true, 0.0 UNION ALL SELECT 'none', 'ERROR', false, 0.0"
)
def dq_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every check of rows against tables that break it."""
    o, c = adapter.table(spark, sf_dir, "orders"), adapter.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"))
    k = F.col("o_orderkey") % 50
    blank = o.withColumn("o_comment", F.when(k == 0, F.lit(None)).when(k == 1, " ").otherwise("x"))
    some = c.where("o_custkey % 7 <> 0")
    key = ["o_custkey"]
    found = [
        checks.unique("unique", o, key),
        checks.filled("filled", blank, ["o_comment"], ["o_comment"]),
        checks.references("parents", o, key, some, key),
        checks.references("lenient", o, key, some, key, checks.WARN),
        checks.covers("covers", c, o, key),
        checks.no_extra("extra", some, o, key),
        checks.invariant("order", o, F.col("o_totalprice") >= 1000),
        checks.load_factors("factor", o.withColumn("avg_load_factor", F.col("o_totalprice") / 100000)),
        checks.at_least("least", o, 1000),
        checks.not_empty("rows", o),
        checks.not_empty("none", o.limit(0)),
    ]
    return tables.as_rows(spark, found)


@query(
    "WITH n AS (SELECT count(*) FILTER (WHERE o_orderkey % 10 = 3) AS bad FROM orders) SELECT s AS severity, s = 'ERROR' AS raised, CAST(2 AS BIGINT) AS findings, CASE s WHEN 'ERROR' THEN 'a: ' || CAST(bad AS VARCHAR) || ' rows break the invariant' ELSE '' END AS message FROM n, (VALUES ('ERROR'), ('WARN')) t(s)"
)
def dq_severities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of severity ERROR stop a load with their message; others are kept."""
    o, rows = adapter.table(spark, sf_dir, "orders"), []
    for severity in ("ERROR", "WARN"):
        found = checks.judge(o, checks.always("a", F.col("o_orderkey") % 10 != 3, severity), checks.always("b", F.col("o_orderkey") >= 0))
        try:
            rows.append((severity, False, len(checks.require(found)), ""))
        except QualityError as e:
            rows.append((severity, True, len(e.findings), str(e)))
    return spark.createDataFrame(rows, "severity string, raised boolean, findings bigint, message string")


# validators, over tables with planted faults


@query(
    expected("airports.one_batch|ERROR|0", "airports.missing|ERROR|1", "airports.extra|ERROR|1", "airports.unique|ERROR|1", "airports.keys|ERROR|0").replace(
        "'airports.one_batch' AS check_name, 'ERROR' AS severity, (0) = 0 AS ok, CAST((0) AS DOUBLE) AS value", "'airports.one_batch' AS check_name, 'ERROR' AS severity, true AS ok, 1.0 AS value"
    )
    + " UNION ALL SELECT 'airplanes_seats.same_batch', 'ERROR', false, 2.0 UNION ALL SELECT 'airplanes_routes.same_batch', 'ERROR', true, 2.0"
)
def validate_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An airport is missing, one is extra, one is there twice; seats are of another batch."""
    held = adapter.Held(spark, sf_dir)
    rows = held.read("ods.airports")
    extra, twice = rows.where("airport_code = '4'").withColumn("airport_code", F.lit("none")), rows.where("airport_code = '5'")
    changed = {"ods.airports": rows.where("airport_code <> '3'").unionByName(extra).unionByName(twice), "ods.seats": held.read("ods.seats").withColumn("_load_id", F.lit("other"))}
    broken = adapter.Held(spark, sf_dir, changed, held)
    found = findings_of(lambda: tables.validate_snapshot(broken, "airports"))
    return tables.as_rows(spark, [*found, tables.same_batch(broken), tables.same_batch(broken, ("airplanes", "routes"))])


@query(
    adapter.SQL
    + ", b AS (SELECT count(*) AS n FROM passenger WHERE passenger_sk % 10 = 0) SELECT * FROM ("
    + expected(
        *[f"dim_{d}.{c}|ERROR|{v}" for d in ("airports", "airplanes", "tariffs", "passengers") for c, v in (("rows", "0"), ("unique", "0"), ("covers", "(SELECT n FROM b)" if d == "passengers" else "0"))],
        "dim_airplanes.seats|ERROR|0", "dim_routes.open|ERROR|(SELECT count(*) FROM route WHERE route_sk % 5 = 0) + (SELECT count(*) FROM supplier) - (SELECT count(*) FROM route)", "dim_routes.one_open|ERROR|0", "dim_routes.gaps|ERROR|0",
    )
    + ")"
)
def validate_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth passenger is missing, every fifth route is closed."""
    held = adapter.Held(spark, sf_dir)
    routes = held.read("dds.dim_routes")
    closed = routes.withColumn("valid_to", F.when(F.col("route_sk") % 5 == 0, RUN_1.date()).otherwise(F.col("valid_to")))
    changed = {"dds.dim_passengers": held.read("dds.dim_passengers").where("passenger_sk % 10 <> 0"), "dds.dim_routes": closed}
    return tables.as_rows(spark, findings_of(lambda: tables.validate_dimensions(adapter.Held(spark, sf_dir, changed, held))))


@query(
    expected(*[f"dm.{n}.{c}|ERROR|{v}" for n in ("sales_report", "airport_traffic", "route_performance", "monthly_overview", "passenger_loyalty") for c, v in (("rows", "0"), ("keys", "(SELECT count(*) FROM passenger WHERE passenger_sk % 10 = 0)" if n == "passenger_loyalty" else "0"))])
    .join([adapter.SQL + "SELECT * FROM (", ")"])
)
def validate_marts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth passenger's key is null in its mart."""
    held = adapter.Held(spark, sf_dir)
    m = held.read("dm.passenger_loyalty")
    sk = F.col("passenger_sk")
    changed = {"dm.passenger_loyalty": m.withColumn("passenger_sk", F.when(sk % 10 != 0, sk))}
    return tables.as_rows(spark, findings_of(lambda: tables.validate_marts(adapter.Held(spark, sf_dir, changed, held))))


@query(adapter.SQL + "SELECT k AS key_column, CASE k WHEN 'passenger_sk' THEN (SELECT count(*) FROM fact WHERE passenger_sk % 10 = 0) WHEN 'tariff_sk' THEN (SELECT count(*) FROM fact WHERE tariff_sk = 1) ELSE 0 END AS orphans FROM (VALUES ('calendar_sk'), ('departure_airport_sk'), ('arrival_airport_sk'), ('airplane_sk'), ('tariff_sk'), ('passenger_sk'), ('route_sk')) t(k)")
def qa_fact_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of the fact without a dimension row: some passengers and a tariff are gone."""
    rows, dims = adapter.fact(spark, sf_dir)
    lost = dims | {"passengers": dims["passengers"].where("passenger_sk % 10 <> 0"), "tariffs": dims["tariffs"].where("tariff_sk <> 1")}
    return tables.fact_orphans(rows, lost)


@query(adapter.SQL + "SELECT 'dds' AS layer, count(*) AS n, CAST(sum(price) AS DOUBLE) AS revenue, count(*) FILTER (WHERE is_boarded) AS boarded FROM fact UNION ALL SELECT 'ods', count(*), CAST(sum(CAST(l_extendedprice AS DECIMAL(10,2))) AS DOUBLE), count(*) FILTER (WHERE l_linestatus = 'F') FROM seg")
def qa_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = tables.parity(adapter.current(spark, sf_dir), adapter.fact(spark, sf_dir)[0])
    return both.select("layer", "n", F.col("revenue").cast("double").alias("revenue"), "boarded")


@query("SELECT o_orderkey, count(*) AS n FROM orders, (VALUES (1), (2)) t(k) WHERE o_orderkey % 4 = 0 GROUP BY 1")
def qa_recent_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth order was staged again two days ago, all of them ten days ago."""
    o = adapter.table(spark, sf_dir, "orders").select("o_orderkey")
    ago = lambda rows, days: rows.withColumn("_load_ts", RUN_2.ts() - F.make_dt_interval(F.lit(days)))
    stage = ago(o, 0).unionByName(ago(o.where("o_orderkey % 4 = 0"), 2)).unionByName(ago(o, 10))
    return tables.recent_duplicates(stage, ["o_orderkey"], RUN_2)


@query("SELECT task, state, tries, CASE state WHEN 'done' THEN (SELECT count(*) FROM orders WHERE o_orderkey % 5 = k) ELSE 0 END AS n FROM (VALUES ('flaky', 'done', CAST(2 AS BIGINT), 0), ('broken', 'failed', 3, 1), ('after', 'skipped', 0, 2), ('always', 'done', 1, 3), ('polled', 'done', 3, 4)) t(task, state, tries, k)")
def flow_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loads of a fifth of the orders each: retries, a failure, what it skips, one that runs anyway, and one that polls."""
    names = ("flaky", "broken", "after", "always", "polled")
    tries, store = {n: 0 for n in names}, new_store(spark, **{n: Table(f"a.{n}", {"k": "bigint!"}, ("k",)) for n in names})
    orders = adapter.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("bigint").alias("k"))

    def load(name: str) -> None:
        store.append(f"a.{name}", orders.where(F.col("k") % 5 == names.index(name)))

    def run(name: str, good_at: int | None) -> None:
        tries[name] += 1
        if good_at is None or tries[name] < good_at:
            raise OSError(name)
        load(name)

    def asked() -> bool:
        tries["polled"] += 1
        if tries["polled"] == 3:
            load("polled")
        return tries["polled"] == 3

    tasks = [
        Task("flaky", lambda: run("flaky", 2), (), 1, 0),
        Task("broken", lambda: run("broken", None), ("flaky",), 2, 0),
        Task("after", lambda: run("after", 1), ("broken",), 0),
        Task("always", lambda: run("always", 1), ("broken", "after"), 0, all_done=True),
        Task("polled", lambda: poll(asked, 0, 5), (), 0),
    ]
    out = Graph(tasks).run(2)
    return spark.createDataFrame([(n, out.state[n], tries[n], store.written(f"a.{n}")) for n in tries], "task string, state string, tries bigint, n bigint")


# streams


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of files; the pattern takes a table of one file as well as a folder."""
    return stream.file_stream(spark, f"{sf_dir}/event[s].parquet", adapter.table(spark, sf_dir, "events").schema)


def _checkpoint(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/lakeloom-checkpoints/{uuid.uuid4().hex}"


_COUNTS = Table("a.counts", {"window_start": "timestamp!", "event_type": "string", "n": "bigint"}, ("window_start",))


@query("SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts by a stream with a watermark, in full after the last batch."""
    store = new_store(spark, c=_COUNTS)
    counts = stream.windowed_counts(_events(spark, sf_dir), "ts", "1 hour", "3650 days", "event_type")
    write = lambda batch, number: store.replace("a.counts", batch)
    counts.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", _checkpoint(spark)).trigger(availableNow=True).start().awaitTermination()
    return store.read("a.counts").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


_STAGED = Table("a.events", {"event_id": "string", "user_id": "string", "event_type": "string", "event_ts": "timestamp_ntz", "_load_ts": "timestamp_ntz!", "_load_id": "string!"}, ("event_id",))


@query("SELECT CAST(event_id AS VARCHAR) AS event_id, ts AS event_ts FROM events")
def stream_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream into a staging table, started twice with one checkpoint and once with none: nothing is staged twice."""
    store, at = new_store(spark, e=_STAGED), _checkpoint(spark)
    for checkpoint in (at, at, _checkpoint(spark)):
        stream.stage_stream(_events(spark, sf_dir), store, "a.events", ["event_id"], "ts", checkpoint, lambda: RUN_1.run_ts).awaitTermination()
    return store.read("a.events").select("event_id", "event_ts")


_LAST = Table("a.last", {"user_id": "bigint!", "event_type": "string", "event_ts": "timestamp_ntz", "_load_ts": "timestamp_ntz!", "_load_id": "string!"}, ("user_id",))


@query("SELECT user_id, max(ts) AS event_ts FROM events GROUP BY 1")
def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest event of each user, merged batch by batch."""
    store = new_store(spark, e=_LAST)
    rows = _events(spark, sf_dir).select(F.col("user_id").cast("bigint").alias("user_id"), "event_type", F.col("ts").alias("event_ts"), RUN_1.ts().alias("_load_ts"), RUN_1.id().alias("_load_id"))
    stream.upsert_stream(rows, store, "a.last", ["user_id"], ["event_type", "event_ts"], _checkpoint(spark)).awaitTermination()
    return store.read("a.last").select("user_id", "event_ts")


_USERS = Table("a.users", {"user_sk": "bigint!", "user_id": "bigint!"}, ("user_id",))
_FACTS = Table("a.facts", {"event_id": "bigint!", "user_id": "bigint", "user_sk": "bigint", "_load_ts": "timestamp_ntz!", "_load_id": "string!"}, ("event_id",))


@query("SELECT event_id, user_id + 1000 AS user_sk, CASE WHEN user_id % 3 = 0 THEN 'run_2' ELSE 'stream-0' END AS load_id FROM events WHERE user_id IS NOT NULL")
def stream_late_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts stream in before every third user is known; their keys are filled when the users have come."""
    store = new_store(spark, u=_USERS, f=_FACTS)
    users = adapter.table(spark, sf_dir, "events").where("user_id IS NOT NULL").select(F.col("user_id").cast("bigint").alias("user_id")).distinct().withColumn("user_sk", F.col("user_id") + 1000)
    store.append("a.users", users.where("user_id % 3 <> 0"))
    rows = _events(spark, sf_dir).where("user_id IS NOT NULL").select(F.col("event_id").cast("bigint").alias("event_id"), F.col("user_id").cast("bigint").alias("user_id"))
    lookups = {"user_sk": ("user_id", "a.users", "user_id")}
    stream.resolve_stream(rows, store, "a.facts", lookups, _checkpoint(spark), lambda: RUN_1.run_ts).awaitTermination()
    store.append("a.users", users.where("user_id % 3 = 0"))
    stream.backfill(store, "a.facts", lookups, RUN_2)
    return store.read("a.facts").select("event_id", "user_sk", F.col("_load_id").alias("load_id"))
