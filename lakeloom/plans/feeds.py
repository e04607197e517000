"""Registered queries over streams of several micro-batches and over stores that change often, each with its rows in SQL."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterable, Iterator
from datetime import timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lakeloom.operators import dimension
from lakeloom.plans import adapter
from lakeloom.plans.stored import RUN_1, RUN_2, _checkpoint, _customers, new_store
from lakeloom.quality import checks, tables
from lakeloom.schemas import Table
from lakeloom.session import setting, templated
from lakeloom.sources.storage import Refused, scratch, shared_folder, stable
from lakeloom.streaming import stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: Micro-batches of a query's stream.
SLICES = 5


def query(sql: str):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapter.table(spark, sf_dir, "events").select(F.col("event_id").cast("bigint").alias("event_id"), F.col("user_id").cast("bigint").alias("user_id"), "event_type", F.col("ts").cast("timestamp_ntz").alias("ts"))


def feed_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/lakeloom-feeds/{uuid.uuid4().hex}"


def fed(spark: SparkSession, slices: Iterable[DataFrame], start: Callable[[DataFrame], StreamingQuery], folder: str | None = None) -> Iterator[StreamingQuery]:
    """A stream over a folder that gets one slice after the other: each is a micro-batch of its own, after a restart."""
    folder = folder or feed_folder(spark)
    for rows in slices:
        rows.write.mode("append").parquet(folder)
        q = start(stream.file_stream(spark, folder, rows.schema))
        q.awaitTermination()
        yield q


def mixed(rows: DataFrame, key: str = "event_id") -> list[DataFrame]:
    """Slices that each have rows of all times."""
    return [rows.where(F.pmod(F.col(key), F.lit(SLICES)) == (3 * k + 1) % SLICES) for k in range(SLICES)]


def by_time(rows: DataFrame) -> list[DataFrame]:
    """Slices of equal time, in order; every tenth row of the first one comes with the last."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    first, last = rows.agg(F.coalesce(F.min(us), F.lit(0)), F.coalesce(F.max(us), F.lit(0))).first()
    at = F.least(F.lit(SLICES - 1), F.floor((us - first) * SLICES / F.lit(max(1, last - first)))).cast("int")
    placed = rows.withColumn("_at", F.when((at == 0) & (F.col("event_id") % 10 == 0), SLICES - 1).otherwise(at))
    return [placed.where(F.col("_at") == k).drop("_at") for k in range(SLICES)]


_LATEST = Table("a.latest", {"user_id": "bigint!", "event_type": "string", "event_ts": "timestamp_ntz", "_load_ts": "timestamp_ntz!", "_load_id": "string!"}, ("user_id",))


@query("SELECT user_id, ts AS event_ts, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type DESC) AS rn FROM events WHERE user_id IS NOT NULL) WHERE rn = 1")
def stream_upsert_out_of_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest event of each user over five micro-batches that each have events of all times: no older event wins."""
    store, at = new_store(spark, e=_LATEST), _checkpoint(spark)
    rows = events(spark, sf_dir).where("user_id IS NOT NULL").select("event_id", "user_id", "event_type", F.col("ts").alias("event_ts"), RUN_1.ts().alias("_load_ts"), RUN_1.id().alias("_load_id"))
    for _ in fed(spark, mixed(rows), lambda s: stream.upsert_stream(s, store, "a.latest", ["user_id"], ["event_type"], at)):
        pass
    return store.read("a.latest").select("user_id", "event_ts", "event_type")


_FACTS = Table("a.facts", {"event_id": "bigint!", "user_id": "bigint", "_load_ts": "timestamp_ntz!", "_load_id": "string!"}, ("event_id",))


@query("SELECT event_id, user_id, CAST(1 AS BIGINT) AS copies FROM events")
def stream_two_writers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two streams with checkpoints of their own append to one table, in five micro-batches each and by turns; the first one's last
    batch is repeated, as after a crash before its checkpoint took note. Nothing is lost, nothing is there twice."""
    store = new_store(spark, f=_FACTS)
    rows = events(spark, sf_dir).select("event_id", "user_id")
    feeds = []
    for half in (0, 1):
        at, folder = _checkpoint(spark), feed_folder(spark)
        start = lambda s, at=at: stream.resolve_stream(s, store, "a.facts", {}, at, lambda: RUN_1.run_ts)
        feeds.append((fed(spark, mixed(rows.where(F.col("event_id") % 2 == half)), start, folder), folder, at))
    for _ in range(SLICES):
        for feed, _, _ in feeds:
            next(feed)
    folder, at = feeds[0][1:]
    last = max(int(f) for f in store.files.list(f"{at}/commits") if f.isdigit())
    store.files.delete(f"{at}/commits/{last}")
    stream.resolve_stream(stream.file_stream(spark, folder, rows.schema), store, "a.facts", {}, at, lambda: RUN_1.run_ts).awaitTermination()
    return store.read("a.facts").groupBy("event_id", "user_id").agg(F.count(F.lit(1)).alias("copies"))


_HOURS = Table("a.hours", {"window_start": "timestamp!", "event_type": "string", "n": "bigint"}, ("window_start", "event_type"))
_TIMED_SQL = f"WITH b AS (SELECT min(ts) AS low, max(ts) AS high FROM events), e AS (SELECT events.*, least({SLICES - 1}, CAST(floor((epoch_us(ts) - epoch_us(low)) * {SLICES} / (epoch_us(high) - epoch_us(low))) AS BIGINT)) AS fifth FROM events, b) "


def _late(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    store, at, gone = new_store(spark, c=_HOURS), _checkpoint(spark), 0
    start = lambda s: stream.counts_stream(s, store, "a.hours", "ts", "1 hour", "1 hour", ["event_type"], at, once=["event_id"])
    for q in fed(spark, by_time(events(spark, sf_dir)), start):
        gone += stream.dropped(q)
    return store.read("a.hours"), gone


@query(_TIMED_SQL + "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM e, b WHERE NOT (fifth = 0 AND event_id % 10 = 0) AND date_trunc('hour', ts) + INTERVAL 2 HOUR <= high GROUP BY 1, 2")
def stream_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts of windows that the watermark has passed, each appended once. Rows of the first fifth that come with the last
    micro-batch are dropped, and windows still open at the end aren't there."""
    return _late(spark, sf_dir)[0].select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@query(_TIMED_SQL + "SELECT count(*) AS dropped FROM e WHERE fifth = 0 AND event_id % 10 = 0")
def stream_late_rows_counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows were dropped as late, by the progress of the micro-batches."""
    return spark.createDataFrame([(_late(spark, sf_dir)[1],)], "dropped bigint")


_EVENTS = Table("a.events", {"event_id": "bigint!", "event_type": "string", "ts": "timestamp_ntz"}, ("event_id",))


@query("SELECT event_id, event_type, ts FROM events")
def stream_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third event comes again with the same micro-batch and every second one with the next; one of each is kept."""
    store, at = new_store(spark, e=_EVENTS), _checkpoint(spark)
    rows, slices = events(spark, sf_dir).select("event_id", "event_type", "ts"), []
    own = [rows.where(F.pmod("event_id", F.lit(SLICES)) == k) for k in range(SLICES)]
    for k in range(SLICES):
        again = [own[k].where("event_id % 3 = 0")] + ([own[k - 1].where("event_id % 2 = 0")] if k else [])
        slices.append(reduce(DataFrame.unionByName, again, own[k]))
    for _ in fed(spark, slices, lambda s: stream.distinct_stream(s, store, "a.events", ["event_id"], "ts", "3650 days", at)):
        pass
    return store.read("a.events")


# stores


@query("SELECT c_custkey AS k, CASE WHEN c_custkey % 7 = 0 THEN upper(c_name) || '!' ELSE c_name END AS name, (SELECT count(*) FROM customer WHERE c_custkey % 7 = 0 OR c_custkey % 10 = 0) AS rows_written FROM customer")
def store_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An upsert of new, changed and unchanged rows writes the new and changed ones alone; a repeat of its batch writes none."""
    c, store = _customers(spark, sf_dir), new_store(spark, c=Table("a.customers", {"k": "bigint!", "name": "string"}, ("k",)))
    store.append("a.customers", c.where("k % 10 <> 0"))
    before = store.parts("a.customers")
    delta = c.withColumn("name", F.when(F.col("k") % 7 == 0, F.concat(F.upper("name"), F.lit("!"))).otherwise(F.col("name"))).where("k % 7 = 0 OR k % 10 = 0 OR k % 3 = 0")
    for _ in range(2):
        store.upsert("a.customers", delta, ["k"], ["name"], batch=("loader", 1))
    written = store.written("a.customers") - sum(store.written("a.customers", {p}) for p in before)
    return store.read("a.customers").withColumn("rows_written", F.lit(written).cast("bigint"))


@query("SELECT c_custkey AS k, CASE WHEN c_custkey % 25 < 5 THEN upper(c_name) ELSE c_name END AS name, CAST(10 AS BIGINT) AS versions, true AS few_parts FROM customer")
def store_upkeep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty-five appends and five upserts, then upkeep: the same rows, in few parts, with the last ten versions."""
    c, store = _customers(spark, sf_dir), new_store(spark, c=Table("a.customers", {"k": "bigint!", "name": "string"}, ("k",)))
    for k in range(25):
        store.append("a.customers", c.where(F.col("k") % 25 == k))
    for k in range(5):
        store.upsert("a.customers", c.where(F.col("k") % 25 == k).withColumn("name", F.upper("name")), ["k"], ["name"])
    store.maintain("a.customers", keep=10, grace=timedelta(0))
    few = len(store.parts("a.customers")) <= store.SMALL_PARTS
    return store.read("a.customers").select("*", F.lit(store.version("a.customers")).cast("bigint").alias("versions"), F.lit(few).alias("few_parts"))


@query("SELECT c_custkey AS k, c_name AS name, 'origin' AS store FROM customer UNION ALL SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'changed' ELSE c_name END, 'clone' FROM customer")
def store_clone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A clone shares the files of its origin; what is written to it, and its upkeep, leave the origin alone."""
    c, store = _customers(spark, sf_dir), new_store(spark, c=Table("a.customers", {"k": "bigint!", "name": "string"}, ("k",)))
    store.append("a.customers", c)
    other = store.clone(f"{shared_folder(spark)}/lakeloom-stores/{store.root.rsplit('/', 1)[1]}-clone", ["a.customers"])
    other.upsert("a.customers", c.where("k % 2 = 0").withColumn("name", F.lit("changed")), ["k"], ["name"])
    other.maintain("a.customers", keep=1, grace=timedelta(0))
    return store.read("a.customers").withColumn("store", F.lit("origin")).unionByName(other.read("a.customers").withColumn("store", F.lit("clone")))



# many versions of one key


@query(
    "WITH ver AS (SELECT CAST(CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_custkey END AS BIGINT) AS k, CAST(o_orderdate AS DATE) AS f, min(o_orderkey) AS v FROM orders GROUP BY 1, 2), span AS (SELECT k, f, CASE WHEN v % 5 = 0 THEN f + 3 ELSE lead(f) OVER (PARTITION BY k ORDER BY f) END AS t, v FROM ver)"
    ", x AS (SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS day, CAST(CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE o_custkey END AS BIGINT) AS k FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
    " SELECT l_orderkey, l_linenumber, CASE WHEN t IS NULL OR day < t THEN CAST(v AS BIGINT) END AS v FROM x ASOF LEFT JOIN span ON x.k = span.k AND x.day >= span.f"
)
def asof_many_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The price list of a day for each line: a third of all rows and versions have one key, every fifth version ends early."""
    day = lambda c: F.to_date(c)
    k = F.when(F.col("o_orderkey") % 3 == 0, 0).otherwise(F.col("o_custkey")).cast("bigint").alias("k")
    orders = adapter.table(spark, sf_dir, "orders").select("o_orderkey", k, day("o_orderdate").alias("valid_from"))
    lists = orders.groupBy("k", "valid_from").agg(F.min("o_orderkey").cast("bigint").alias("v"))
    after = F.lead("valid_from").over(Window.partitionBy("k").orderBy("valid_from"))
    dim = lists.select(F.col("k").alias("bk"), "valid_from", F.when(F.col("v") % 5 == 0, F.date_add("valid_from", 3)).otherwise(after).alias("valid_to"), "v")
    lines = adapter.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate").join(orders.select("o_orderkey", "k"), F.col("l_orderkey") == F.col("o_orderkey"))
    out = dimension.asof_carry(lines, dim, ("k", "bk"), day("l_shipdate"), {"v": "v"}, span=90)
    return out.select(F.col("l_orderkey"), F.col("l_linenumber"), "v")


# checks that need no join, or no read


@query(
    "SELECT 'whole' AS load, 'keys' AS check_name, 'ERROR' AS severity, true AS ok, CAST(0 AS DOUBLE) AS value, (SELECT count(*) FROM customer) AS held UNION ALL SELECT 'whole', 'rich.any', 'WARN', n = 0, CAST(n AS DOUBLE), (SELECT count(*) FROM customer) FROM (SELECT count(*) FILTER (WHERE c_acctbal > 9990) AS n FROM customer)"
    " UNION ALL SELECT 'whole', 'rich', 'ERROR', true, CAST(count(*) FILTER (WHERE c_acctbal > 9990) AS DOUBLE) / count(*), count(*) FROM customer"
    " UNION ALL SELECT 'broken', 'keys', 'ERROR', false, CAST(count(*) FILTER (WHERE c_custkey % 5 = 0) AS DOUBLE), count(*) FROM customer UNION ALL SELECT 'broken', 'rich.any', 'WARN', n = 0, CAST(n AS DOUBLE), (SELECT count(*) FROM customer) FROM (SELECT count(*) FILTER (WHERE c_acctbal > 9990) AS n FROM customer)"
    " UNION ALL SELECT 'broken', 'rich', 'ERROR', true, CAST(count(*) FILTER (WHERE c_acctbal > 9990) AS DOUBLE) / count(*), count(*) FROM customer"
)
def store_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules answered while a part is written, without another read; a part that breaks one of severity ERROR is refused."""
    store = new_store(spark, c=Table("a.accounts", {"k": "bigint!", "name": "string", "balance": "double"}, ("k",)))
    c = adapter.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("bigint").alias("k"), F.col("c_name").alias("name"), F.col("c_acctbal").cast("double").alias("balance"))
    rules = [checks.is_filled("keys", ["k", "name"], ["name"]), checks.is_rare("rich", F.col("balance") > 9990, 0.5)]
    out = []
    for load, rows in (("whole", c), ("broken", c.withColumn("name", F.when(F.col("k") % 5 != 0, F.col("name")).otherwise(F.lit(" "))))):
        with contextlib.suppress(Refused):
            store.append("a.accounts", rows, rules=rules)
        out.append(tables.as_rows(spark, store.findings["a.accounts"]).select(F.lit(load).alias("load"), "*", F.lit(store.written("a.accounts")).cast("bigint").alias("held")))
    return out[0].unionByName(out[1])


@query(
    "SELECT 'alike.missing' AS check_name, 'ERROR' AS severity, true AS ok, CAST(0 AS DOUBLE) AS value UNION ALL SELECT 'alike.extra', 'ERROR', true, 0 UNION ALL SELECT 'other.missing', 'ERROR', n = 0, CAST(n AS DOUBLE) FROM (SELECT count(*) FILTER (WHERE o_orderkey % 100 = 1) AS n FROM orders)"
    " UNION ALL SELECT 'other.extra', 'ERROR', n = 0, CAST(n AS DOUBLE) FROM (SELECT count(*) FILTER (WHERE o_orderkey % 100 = 2) AS n FROM orders)"
)
def dq_same_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of two tables by sums of hashes; they are joined only where the sums differ: here one in a hundred is lost and another renamed."""
    o = adapter.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("bigint").alias("k"))
    k = F.col("k")
    held = o.where(k % 100 != 1).unionByName(o.where(k % 100 == 2).select((-k - 1).alias("k")))
    return tables.as_rows(spark, [*checks.same_keys("alike.missing", "alike.extra", o, o.repartition(7, "k"), ["k"]), *checks.same_keys("other.missing", "other.extra", o, held, ["k"])])


@query("SELECT 'batch' AS check_name, 'ERROR' AS severity, false AS ok, CAST(count(*) AS DOUBLE) AS value FROM nation WHERE n_regionkey IN (1, 3) UNION ALL SELECT 'history', 'ERROR', true, 0")
def dq_batch_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents are looked for in the child's own batch: those that an earlier batch had, and this one lacks, are no parents of it."""
    n = adapter.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("r"))
    history = n.select("k", F.lit("run_1").alias("_load_id")).unionByName(n.where("r NOT IN (1, 3)").select("k", F.lit("run_2").alias("_load_id")))
    found = [checks.references("batch", n, ["k"], history.where(F.col("_load_id") == RUN_2.run_id), ["k"]), checks.references("history", n, ["k"], history, ["k"])]
    return tables.as_rows(spark, found)


# runs


@query("SELECT o_orderkey AS k, 'run_2' AS load_id, CAST(o_orderdate AS DATE) AS day, 'unset' AS mode FROM orders WHERE o_orderdate >= TIMESTAMP '1999-01-01' AND o_totalprice > 1000")
def run_templated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL of a load with the run's id and other values as arguments, and a setting that isn't set."""
    mode = setting(spark, "lakeloom.mode.of.no.one", "unset")
    sql = "SELECT CAST(o_orderkey AS BIGINT) AS k, :run_id AS load_id, CAST(o_orderdate AS DATE) AS day, :mode AS mode FROM {o} WHERE o_orderdate >= CAST(:since AS TIMESTAMP_NTZ) AND o_totalprice > :least"
    return templated(spark, sql, RUN_2, {"o": adapter.table(spark, sf_dir, "orders")}, since="1999-01-01", least=1000, mode=mode)


@query("SELECT min(r) AS route_bk FROM (SELECT CAST(s_suppkey AS VARCHAR) AS r FROM supplier WHERE s_suppkey % 4 <> 0)")
def pick_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least route with exactly one version, of those of which every fourth has two."""
    s = adapter.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_suppkey").cast("string").alias("route_bk"))
    return tables.single_version(s.unionByName(s.where("k % 4 = 0")), "route_bk").select("route_bk")


@query("SELECT c_custkey AS k, c_name AS name, true AS gone FROM customer")
def store_scratch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intermediate tables of a load are gone when it ends; what it wrote stays."""
    store = new_store(spark, c=Table("a.customers", {"k": "bigint!", "name": "string"}, ("k",)))
    with scratch():
        rows = stable(_customers(spark, sf_dir))
        files = rows.inputFiles()
        store.append("a.customers", rows)
    gone = bool(files) and not any(store.files.exists(f) for f in files)
    return store.read("a.customers").withColumn("gone", F.lit(gone))


@query("SELECT c_custkey AS k, c_name AS name, CAST(1 AS BIGINT) AS refused FROM customer")
def store_serial_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A load that begins while another one runs is refused; the next one, after it, runs."""
    c, store = _customers(spark, sf_dir), new_store(spark, c=Table("a.customers", {"k": "bigint!", "name": "string"}, ("k",)))
    refused = 0
    with store.lock():
        store.append("a.customers", c.where("k % 2 = 0"))
        try:
            with store.lock():
                store.append("a.customers", c)
        except RuntimeError:
            refused += 1
    with store.lock():
        store.append("a.customers", c.where("k % 2 = 1"))
    return store.read("a.customers").withColumn("refused", F.lit(refused).cast("bigint"))
