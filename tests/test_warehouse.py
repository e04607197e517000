"""Whole loads on a store: two days, repeats, late dimensions, checks, validators."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lakeloom.flow.graph import Graph, Task, poll
from lakeloom.flow.runs import dds_graph, dm_graph, ods_graph, run_all, stage_graph, validate_graph
from lakeloom.plans import adapter, layers
from lakeloom.quality import checks, tables
from lakeloom.schemas import TABLES, Table, source_schema
from lakeloom.session import Run
from lakeloom.sources.readers import Jdbc, frames_source
from lakeloom.sources.storage import Missing, Store

DAY_1, DAY_2, AGAIN = Run("day_1", datetime(2024, 1, 1)), Run("day_2", datetime(2024, 1, 2)), Run("again", datetime(2024, 1, 3))
DAYS = (adapter.FIRST, adapter.LAST)


def first_day(frames):
    """Bookings before the second day, and what belongs to them."""
    cut = F.lit(adapter.DAY_2).cast("timestamp_ntz")
    bookings = frames["bookings"].where(F.col("book_date") < cut)
    tickets = frames["tickets"].join(bookings.select("book_ref"), "book_ref", "left_semi")
    segments = frames["segments"].join(tickets.select("ticket_no"), "ticket_no", "left_semi")
    return frames | {
        "bookings": bookings,
        "tickets": tickets,
        "segments": segments,
        "boarding_passes": frames["boarding_passes"].join(tickets.select("ticket_no"), "ticket_no", "left_semi"),
    }


@pytest.fixture(scope="module")
def frames(spark, sf_dir):
    small = adapter.sources(spark, sf_dir)
    keep = small["bookings"].where(F.col("book_ref").cast("int") % 6 == 0)
    small["bookings"] = keep
    small["tickets"] = small["tickets"].join(keep.select("book_ref"), "book_ref", "left_semi")
    small["segments"] = small["segments"].join(keep.select("book_ref"), F.col("ticket_no") == F.col("book_ref"), "left_semi")
    small["boarding_passes"] = small["boarding_passes"].join(keep.select("book_ref"), F.col("ticket_no") == F.col("book_ref"), "left_semi")
    return {n: f.cache() for n, f in small.items()}


@pytest.fixture(scope="module")
def store(spark, frames, tmp_path_factory):
    s = Store(spark, f"file://{tmp_path_factory.mktemp('dw')}")
    s.bootstrap()
    run_all(s, frames_source(first_day(frames)), DAY_1, DAYS)
    return s


def content(store, name):
    return sorted(map(repr, store.read(name).collect()))


def test_two_days_and_a_repeat(store, frames):
    assert store.read("dds.fact_flight_sales").count() == first_day(frames)["segments"].count()
    keys = {r["passenger_id"]: r["passenger_sk"] for r in store.read("dds.dim_passengers").collect()}
    old = {r["book_ref"] for r in store.read("stg.bookings").collect()}
    run_all(store, frames_source(frames), DAY_2, DAYS)
    assert {r[0] for r in store.read("stg.bookings").select("_load_id").distinct().collect()} == {"day_1", "day_2"}
    assert old < {r["book_ref"] for r in store.read("stg.bookings").collect()}
    assert store.read("dds.fact_flight_sales").count() == frames["segments"].count()
    after = {r["passenger_id"]: r["passenger_sk"] for r in store.read("dds.dim_passengers").collect()}
    assert keys.items() <= after.items() and sorted(after.values()) == list(range(1, len(after) + 1))
    tables.reconcile(store)
    # marts are those of a computation from scratch
    fact, dims = store.read("dds.fact_flight_sales"), layers.dims_of(store)
    for name, (_, aggregate, _, _) in layers.INCREMENTAL_MARTS.items():
        scratch = aggregate(fact, dims)
        mine = store.read(f"dm.{name}").select(*scratch.columns)
        assert sorted(map(repr, mine.collect())) == sorted(map(repr, scratch.select(*[F.col(c).cast(t).alias(c) for c, t in mine.dtypes]).collect())), name
    # a repeated run without new rows changes no current row
    names = [n for n in TABLES if n.startswith(("ods.bookings", "ods.tickets", "ods.flights", "ods.segments", "dds.", "dm.sales", "dm.passenger"))]
    before = {n: content(store, n) for n in names}
    run_all(store, frames_source(frames), AGAIN, DAYS)
    assert {n: content(store, n) for n in names} == before
    assert validate_graph(store, Run("check", datetime(2024, 1, 5))).run(1).check().state["scd2_active_test"] == "done"
    assert content(store, "dds.dim_routes") == before["dds.dim_routes"]
    assert {r["table_name"] for r in tables.scorecard(store).collect()} == set(TABLES)


def test_late_dimension(store):
    """A fact before its passenger has no key; a rebuild fills it."""
    ods = {n: store.read(f"ods.{n}") for n in ("bookings", "tickets", "flights", "segments", "boarding_passes", "routes")}
    dims = layers.dims_of(store)
    none = layers.fact_rows(ods, dims | {"passengers": dims["passengers"].limit(0)})
    assert none.where("passenger_sk IS NOT NULL").count() == 0 and none.count() == ods["segments"].count()
    late = layers.fact_upsert(adapter.empty(store.spark, "dds.fact_flight_sales"), none, DAY_2)
    assert layers.fact_upsert(late, layers.fact_rows(ods, dims), AGAIN).where("passenger_sk IS NOT NULL").count() == 0
    layers.load_fact(store, AGAIN, rebuild=True)
    assert store.read("dds.fact_flight_sales").where("passenger_sk IS NULL").count() == 0


def test_fact_load_touches_changed_partitions_alone(store):
    """One changed pass writes one partition of the fact and the months of one day of the mart."""
    first, second = Run("passes", datetime(2024, 2, 1)), Run("passes_2", datetime(2024, 2, 2))
    layers.load_fact(store, first)  # whatever other tests left
    old = store.parts(layers.FACT)
    layers.load_fact(store, first)
    assert store.parts(layers.FACT) == old  # nothing new, nothing written
    for n in ("sales_report", "airport_traffic"):
        layers.load_mart(store, n, first)
    mart = store.parts("dm.sales_report")
    passes = store.read("ods.boarding_passes")
    one = passes.orderBy("ticket_no", "flight_id").limit(1).collect()[0]
    mine = (F.col("ticket_no") == one["ticket_no"]) & (F.col("flight_id") == one["flight_id"])
    store.replace("ods.boarding_passes", passes.withColumn("seat_no", F.when(mine, "99Z").otherwise(F.col("seat_no"))).withColumn("_load_ts", F.when(mine, second.ts()).otherwise(F.col("_load_ts"))))
    layers.load_fact(store, second)
    new = store.parts(layers.FACT)
    assert len(old - new) == 1 and len(old & new) == len(old) - 1
    assert store.read(layers.FACT).where("seat_no = '99Z'").count() == 1 and store.read(layers.FACT).count() == store.read("ods.segments").count()
    layers.load_mart(store, "sales_report", second)
    assert len(mart - store.parts("dm.sales_report")) <= 2
    tables.qa(store, second)


def test_a_mart_of_passengers_writes_changed_rows_alone(store):
    """One changed price: of the loyalty mart one row is written, and the content is that of a computation from scratch."""
    first, second = Run("loyal", datetime(2024, 2, 5)), Run("loyal_2", datetime(2024, 2, 6))
    for name in ("passenger_loyalty", "monthly_overview"):
        layers.load_mart(store, name, first)
    old, rows = store.parts("dm.passenger_loyalty"), store.written("dm.passenger_loyalty")
    one = store.read("ods.boarding_passes").orderBy(F.desc("ticket_no"), "flight_id").limit(1).collect()[0]
    mine = (F.col("ticket_no") == one["ticket_no"]) & (F.col("flight_id") == one["flight_id"])
    segments = store.read("ods.segments")
    store.replace("ods.segments", segments.withColumn("amount", F.when(mine, F.col("amount") + 1).otherwise(F.col("amount"))).withColumn("_load_ts", F.when(mine, second.ts()).otherwise(F.col("_load_ts"))))
    layers.load_fact(store, second)
    for name in ("passenger_loyalty", "monthly_overview"):
        layers.load_mart(store, name, second)
        aggregate = layers.INCREMENTAL_MARTS[name][1]
        scratch = aggregate(store.read(layers.FACT), layers.dims_of(store))
        mart = store.read(f"dm.{name}").select(*scratch.columns)
        assert sorted(map(repr, mart.collect())) == sorted(map(repr, scratch.select(*[F.col(c).cast(t).alias(c) for c, t in mart.dtypes]).collect())), name
    assert old < store.parts("dm.passenger_loyalty") and store.written("dm.passenger_loyalty") == rows + 1
    assert [r["total_spent"] is not None for r in store.read("dm.passenger_loyalty").where("_load_id = 'loyal_2'").collect()] == [True]
    before = store.parts("dm.passenger_loyalty")
    layers.load_mart(store, "passenger_loyalty", second)
    assert store.parts("dm.passenger_loyalty") == before and store.mark("dm.passenger_loyalty", layers.FACT) == second.run_ts


def test_checks_fail_when_they_should(spark, store):
    rows = store.read("ods.segments")
    with pytest.raises(checks.QualityError):
        checks.require([checks.unique("u", rows.unionByName(rows.limit(1)), ["ticket_no", "flight_id"])])
    with pytest.raises(checks.QualityError):
        checks.require([checks.references("r", rows.withColumn("ticket_no", F.lit("none")), ["ticket_no"], store.read("ods.tickets"), ["ticket_no"])])
    with pytest.raises(checks.QualityError):
        checks.require([checks.filled("f", rows.withColumn("ticket_no", F.lit(" ")), ["ticket_no"], ["ticket_no"])])
    with pytest.raises(checks.QualityError):
        checks.require(checks.window_equal("w", rows, rows.limit(0)))
    assert all(f.ok or f.severity == "INFO" for f in checks.require(checks.window_equal("w", rows.limit(0), rows.limit(0))))
    with pytest.raises(checks.QualityError):
        checks.require([checks.no_extra("x", rows.limit(0), rows, ["ticket_no"])])
    df = spark.range(1000).withColumn("bad", F.col("id") < 5)
    warn = checks.require(checks.share("s", df, F.col("bad")))
    assert [f.ok for f in warn] == [False, True]
    with pytest.raises(checks.QualityError):
        checks.require(checks.share("s", df, F.col("id") < 20))
    with pytest.raises(checks.QualityError):
        checks.require([checks.invariant("i", df, F.col("id") < 10)])
    with pytest.raises(checks.QualityError):
        checks.require([checks.at_least("n", df, 1001)])
    versions = spark.createDataFrame([(1, "a", "2024-01-01", None), (2, "a", "2024-01-05", None)], "sk int, bk string, f string, t string").select("sk", "bk", F.to_date("f").alias("valid_from"), F.to_date("t").alias("valid_to"))
    assert [f.ok for f in checks.versions("v", versions, "sk", "bk")] == [False, True, False]
    with pytest.raises(checks.QualityError):
        tables.scd2_active_test(store, Run("x", datetime(2024, 1, 9)), load=lambda *_: None)
    assert store.read("ods.routes").count() == store.read("ods.routes").select("route_no").distinct().count()


def test_checks_of_a_load_look_at_its_keys(store):
    """A repeated key of the last load is found, in the current state and in the fact; the rest isn't looked at."""
    for name, check in (("ods.segments", lambda: tables.check_ods(store, "segments")), (layers.FACT, lambda: tables.check_dds(store, "fact_flight_sales", 0))):
        check()
        held = store.version(name)
        store.append(name, tables.last_loaded(store.read(name)).limit(1))
        with pytest.raises(checks.QualityError, match="unique"):
            check()
        store.restore(name, held)
        check()


# store


def test_store(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}", {"a.t": Table("a.t", {"k": "int!", "v": "string"}, ("k",))})
    s.bootstrap()
    assert s.exists("a.t") and s.read("a.t").count() == 0
    s.append("a.t", spark.createDataFrame([(1, "x")], "k int, v string"))
    s.append("a.t", spark.createDataFrame([(2, "y")], "k int, v string"))
    s.replace("a.t", s.read("a.t").withColumn("v", F.upper("v")))
    assert sorted(map(tuple, s.read("a.t").collect())) == [(1, "X"), (2, "Y")]
    assert s.read("a.t", 2).count() == 1
    with pytest.raises(Missing):
        s.append("a.t", spark.createDataFrame([(None, "z")], "k int, v string"))
    with pytest.raises(ValueError):
        s.append("a.t", spark.createDataFrame([(1,)], "k int"))
    assert s.read("a.t").count() == 2
    s.truncate("a.t")
    assert s.read("a.t").count() == 0
    s.restore("a.t", 3)
    assert s.read("a.t").count() == 2
    s.vacuum("a.t")
    assert s.read("a.t").count() == 2 and s.version("a.t") == 1
    with s.lock():
        with pytest.raises(RuntimeError), s.lock():
            pass
    with s.lock():
        pass
    with s.lock():
        held = json.loads(s.files.read(f"{s.root}/_lock"))
        s.files.write(f"{s.root}/_lock", json.dumps(held | {"at": "2020-01-01T00:00:00+00:00"}))
        with s.lock():  # left by a driver that died long ago
            pass
    s.break_lock()
    s.reset()
    assert s.read("a.t").count() == 0


def test_a_crash_leaves_the_old_table_or_the_new_one(spark, tmp_path, monkeypatch):
    """Every step of a pointer change may be the last one."""
    s = Store(spark, f"file://{tmp_path}", {"a.t": Table("a.t", {"k": "int!"}, ("k",))})
    s.bootstrap()
    s.append("a.t", spark.createDataFrame([(1,)], "k int"))
    s.append("a.t", spark.createDataFrame([(2,)], "k int"))
    held = s._dir("a.t")
    n = s._numbers("a.t")[0]
    whole = s.files.read(f"{held}/_pointers/{n:012d}")
    for cut in (0, 5, len(whole) - 1):  # the next pointer, written in part
        s.files.write(f"{held}/_pointers/{n + 1:012d}", whole[:cut])
        assert s.exists("a.t") and s.read("a.t").count() == 2 and s.version("a.t") == 3
    s.append("a.t", spark.createDataFrame([(3,)], "k int"))
    monkeypatch.setattr(s.files, "delete", lambda p: (_ for _ in ()).throw(OSError("stopped")))
    with pytest.raises(OSError):  # after the whole state of the oldest version, before the old ones go
        s.retain("a.t", 2)
    monkeypatch.undo()
    assert s.read("a.t").count() == 3 and s.version("a.t") == 4
    s.append("a.t", spark.createDataFrame([(4,)], "k int"))
    assert s.read("a.t").count() == 4
    fresh = Store(spark, s.root, s.tables)
    for keep in (3, 2, 1):
        s.retain("a.t", keep)
        assert s.version("a.t") == fresh.version("a.t") == keep and s.read("a.t").count() == fresh.read("a.t").count() == 4
        assert sorted(r["k"] for r in s.read("a.t", 1).collect()) == list(range(1, 5 - keep + 1))
    with pytest.raises(Exception):  # another writer took the number
        s.files.write(f"{held}/_pointers/{s._numbers('a.t')[0]:012d}", "x", overwrite=False)


def test_partitions_and_marks(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}", {"a.t": Table("a.t", {"k": "int!", "d": "date", "v": "string"}, ("k",), partition="date_format(d, 'yyyy-MM')")})
    s.bootstrap()
    rows = lambda *x: spark.createDataFrame(list(x), "k int, d string, v string").withColumn("d", F.to_date("d"))
    s.append("a.t", rows((1, "2024-01-05", "a"), (2, "2024-02-05", "b"), (3, None, "c")), {"x": "2024-01-01"})
    assert s.partitions("a.t") == ["2024-01", "2024-02", "none"]
    assert [r["k"] for r in s.read("a.t", partitions=["2024-02"]).collect()] == [2]
    before = s.parts("a.t")
    s.replace_partitions("a.t", rows((2, "2024-02-05", "B"), (4, "2024-03-01", "d")), ["2024-02", "2024-03"])
    assert sorted((r["k"], r["v"]) for r in s.read("a.t").collect()) == [(1, "a"), (2, "B"), (3, "c"), (4, "d")]
    assert len(before & s.parts("a.t")) == 2 and s.mark("a.t", "x") == datetime(2024, 1, 1)
    s.truncate("a.t")
    assert s.mark("a.t", "x") is None
    s.restore("a.t", 3)
    s.vacuum("a.t")
    assert s.read("a.t").count() == 4 and s.mark("a.t", "x") == datetime(2024, 1, 1)
    assert {r["column_name"]: (r["n"], r["nulls"]) for r in s.analyze("a.t").collect()} == {"k": (4, 0), "d": (4, 1), "v": (4, 0)}
    assert s.describe("a.t").where("required").count() == 1


def test_polling_ends():
    answers = iter([0, None, "yes"])
    assert poll(lambda: next(answers), 1, 3, lambda _: None) == "yes"
    with pytest.raises(TimeoutError):
        poll(lambda: None, 0, 2)


def test_jdbc_options():
    j = Jdbc("jdbc:postgresql://h/db", "bookings", {"user": "u"}, {"airports": ("city",)}, {"seats": ("n", 0, 10, 4)})
    o = j.options("bookings", datetime(2024, 1, 1), ("id", 0, 10, 4))
    assert o["dbtable"] == "(SELECT r.* FROM bookings.bookings r WHERE r.book_date > {ts '2024-01-01 00:00:00'}) q" and o["numPartitions"] == "4"
    assert "JOIN bookings.bookings b ON b.book_ref = t.book_ref WHERE b.book_date >" in j.options("segments", datetime(2024, 1, 1))["dbtable"]
    assert j.options("airports")["customSchema"] == "city STRING"
    assert j.options("seats")["dbtable"] == "bookings.seats" and j.options("seats")["partitionColumn"] == "n"


def test_jdbc_loads_increments_alone(spark, frames, tmp_path):
    """Against a database in this JVM: the second load asks it for newer rows and gets no others."""
    url = "jdbc:derby:memory:lakeloom_test;create=true"
    for name in ("bookings", "tickets", "segments"):
        f = frames[name]
        for c, k in f.dtypes:
            f = f.withColumn(c, F.col(c).cast("timestamp")) if k == "timestamp_ntz" else f
        f = f.toDF(*[c.upper() for c in f.columns])
        f.write.format("jdbc").options(url=url, dbtable=f"APP.{name}", createTableColumnTypes=", ".join(f"{c} VARCHAR(60)" for c, k in f.dtypes if k == "string")).option("quoteIdentifiers", "false").mode("overwrite").save()
    j = Jdbc(url, "APP")
    source = j.source(spark)
    mark = datetime(1999, 1, 1)
    for name in ("bookings", "tickets", "segments"):
        rows, event = layers.incremental_source(source, name, mark)
        want, _ = layers.incremental_source(frames_source(frames), name, mark)
        key = list(source_schema(name).fieldNames())
        assert event == "book_date"
        assert sorted(map(repr, rows.select(*key, event).collect())) == sorted(map(repr, want.select(*key, event).collect()))
        assert 0 < rows.count() < frames[name].count()
    s = Store(spark, f"file://{tmp_path}")
    s.bootstrap()
    layers.load_stage(s, source, "bookings", DAY_1)
    assert s.read("stg.bookings").count() == frames["bookings"].count()
    layers.load_stage(s, source, "bookings", DAY_2)
    assert s.read("stg.bookings").count() == frames["bookings"].count()


def test_first_load_in_parts(spark, frames, tmp_path, monkeypatch):
    """Parts of equal rows cut by the database; a stopped load goes on with the parts it lacks, by the same cuts."""
    url = "jdbc:derby:memory:lakeloom_first;create=true"
    for name in ("bookings", "tickets"):
        f = frames[name]
        for c, k in f.dtypes:
            f = f.withColumn(c, F.col(c).cast("timestamp")) if k == "timestamp_ntz" else f
        f.toDF(*[c.upper() for c in f.columns]).write.format("jdbc").options(url=url, dbtable=f"APP.{name}", createTableColumnTypes=", ".join(f"{c} VARCHAR(60)" for c, k in f.dtypes if k == "string")).option("quoteIdentifiers", "false").mode("overwrite").save()
    j, s = Jdbc(url, "APP"), Store(spark, f"file://{tmp_path}")
    s.bootstrap()
    cuts = j.cuts(spark, "tickets", "ticket_no", 5)
    assert len(cuts) == 4 and cuts == sorted(cuts)
    n = frames["tickets"].count()
    sizes = [j.part(spark, "tickets", c)[0].count() for c in j.predicates("r.ticket_no", cuts)]
    assert sum(sizes) == n and max(sizes) - min(sizes) <= 2
    append, calls = s.append, []

    def stops(*a, **k):
        calls.append(a)
        if len(calls) == 3:
            raise OSError("stopped")
        return append(*a, **k)

    monkeypatch.setattr(s, "append", stops)
    with pytest.raises(OSError):
        layers.load_first(s, j, "tickets", DAY_1, "ticket_no", 5, threads=1)
    monkeypatch.undo()
    assert 0 < s.read("stg.tickets").count() < n
    for _ in range(2):
        assert layers.load_first(s, j, "tickets", DAY_1, "ticket_no", 5) == 5
    assert s.read("stg.tickets").count() == s.read("stg.tickets").select("ticket_no").distinct().count() == n
    want, event = layers.incremental_source(frames_source(frames), "tickets")
    assert s.read("stg.tickets").agg(F.max("event_ts")).first() == want.agg(F.max(event)).first()
    layers.load_stage(s, j.source(spark), "tickets", DAY_2)  # the marks go on from there
    assert s.read("stg.tickets").count() == n
    assert j.predicates("c", ["a", "o'b"]) == ["c < 'a' OR c IS NULL", "c >= 'a' AND c < 'o''b'", "c >= 'o''b'"] and j.predicates("c", []) == ["1 = 1"] and j.predicates("c", ["5"], False)[1] == "c >= 5"


def test_commands(spark, tmp_path):
    from lakeloom.__main__ import arguments, jdbc_of, main

    a = arguments(["load", "file:///x", "--parquet", "/y", "--days", "2020-01-01", "2020-12-31"])
    assert a.command == "load" and a.days[1].year == 2020
    j = jdbc_of(arguments(["load", "file:///x", "--jdbc", "jdbc:x", "--property", "user=u", "--split", "seats:n:0:10:4", "--text", "airports:city", "--text", "airports:country"]))
    assert (j.properties, j.splits, j.text_columns) == ({"user": "u"}, {"seats": ("n", 0, 10, 4)}, {"airports": ("city", "country")})
    with pytest.raises(SystemExit, match="--run"):
        main(["load", f"file://{tmp_path}", "--jdbc", "jdbc:x", "--first", "tickets:ticket_no:4"])
    root = f"file://{tmp_path}"
    Store(spark, root).bootstrap()
    assert main(["status", root]) == 0 and main(["truncate", root]) == 0 and main(["analyze", root, "ods.bookings"]) == 0 and main(["unlock", root]) == 0
    with pytest.raises(SystemExit):
        main(["load", root])


# graphs


def test_graph_order_retries_and_teardown():
    seen = []

    def flaky():
        seen.append("flaky")
        if seen.count("flaky") < 2:
            raise OSError

    def broken():
        raise ValueError("no")

    out = Graph([Task("a", flaky, (), 1, 0), Task("b", broken, ("a",), 0), Task("c", lambda: seen.append("c"), ("b",)), Task("d", lambda: seen.append("d"), ("b", "c"), all_done=True)]).run(2)
    assert out.state == {"a": "done", "b": "failed", "c": "skipped", "d": "done"} and seen == ["flaky", "flaky", "d"]
    with pytest.raises(ValueError):
        out.check()
    with pytest.raises(ValueError):
        Graph([Task("a", broken, ("b",)), Task("b", broken, ("a",))])
    with pytest.raises(ValueError):
        Graph([Task("a", broken, ("z",))])


def test_graph_shapes(store):
    run = DAY_1
    stage, ods, dds, dm = stage_graph(store, frames_source({}), run), ods_graph(store, run), dds_graph(store, run), dm_graph(store, run)
    assert "check_bookings" in stage.before("load_tickets") and "load_airports" not in stage.before("load_bookings")
    assert {"check_flights", "check_tickets"} <= ods.before("load_segments") and "load_segments" not in ods.before("load_flights")
    assert "resolve_batch" in ods.before("load_seats")
    assert {"check_airports", "check_airplanes"} <= dds.before("load_routes") and "load_passengers" not in dds.before("load_routes")
    assert {"check_routes", "check_tariffs", "check_passengers"} <= dds.before("load_fact")
    assert dm.before("load_sales_report") == set() and dm.before("check_sales_report") == {"load_sales_report"}
    assert validate_graph(store, run).tasks["validate_seats"].retries == 0


# streams


def test_streams_equal_batches(spark, tmp_path, frames):
    from lakeloom.schemas import source_schema
    from lakeloom.streaming.stream import file_stream, stage_stream, upsert_stream, windowed_counts

    folder = str(tmp_path / "in")
    frames["bookings"].repartition(3).write.parquet(folder)
    s = Store(spark, f"file://{tmp_path}/dw")
    s.bootstrap()
    rows = file_stream(spark, folder, source_schema("bookings"), 1)
    stage_stream(rows, s, "stg.bookings", ["book_ref"], "book_date", str(tmp_path / "c1"), lambda: datetime(2024, 1, 1)).awaitTermination()
    assert s.read("stg.bookings").count() == frames["bookings"].count()
    typed = rows.select("book_ref", F.col("book_date").cast("timestamp").alias("book_date"), "total_amount", F.col("book_date").alias("event_ts"), F.lit("s").alias("_load_id"), F.lit("2024-01-01").cast("timestamp_ntz").alias("_load_ts"))
    upsert_stream(typed, s, "ods.bookings", ["book_ref"], ["total_amount"], str(tmp_path / "c2")).awaitTermination()
    assert s.read("ods.bookings").count() == frames["bookings"].count()
    q = windowed_counts(rows, "book_date", "365 days", "1 day").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("w").agg(F.sum("n")).first()[0] == frames["bookings"].count()
