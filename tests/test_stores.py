"""Stores that change often and streams into them: nothing lost, nothing twice, writes that follow the change."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lakeloom.operators.merge import scd1_upsert
from lakeloom.quality import checks
from lakeloom.schemas import Table
from lakeloom.session import Run
from lakeloom.sources import storage
from lakeloom.sources.storage import Commit, Missing, Store, scratch, stable
from lakeloom.streaming import stream

T = Table("a.t", {"k": "int!", "v": "string", "n": "int", "at": "int"}, ("k",))
SCHEMA = "k int, v string, n int, at int"
ROW = "event_id bigint, user_id bigint, ts timestamp_ntz"


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/dw", {"a.t": T})
    s.bootstrap()
    return s


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_a_thousand_versions_have_small_pointers(store):
    for k in range(1000):
        store._commit("a.t", Commit(add={f"part-{k:032x}": 1}))
    number = store._numbers("a.t")[0]
    sizes = [len(store.files.read(f"{store._dir('a.t')}/_pointers/{n:012d}")) for n in store._numbers("a.t")[: Store.WHOLE]]
    assert number == 1001 and max(sizes) < 100_000 and min(sizes) < 400
    fresh = Store(store.spark, store.root, store.tables)
    assert len(fresh.parts("a.t")) == 1000


@pytest.mark.parametrize("seed", range(3))
def test_upsert_like_a_rewrite(spark, store, seed, monkeypatch):
    """Random upserts, broadcast or shuffled, with null values, null keys, columns that aren't updated, and compaction in between."""
    r = random.Random(seed)
    target = []
    for step in range(5):
        delta = [(k, r.choice(["a", "b", None]), r.choice([1, 2, None]), step) for k in r.sample(range(30), r.randint(0, 12))]
        df = spark.createDataFrame(delta, SCHEMA)
        update = ["v", "at"] if step % 2 else None
        held = spark.createDataFrame(target, SCHEMA)
        target = [tuple(x) for x in scd1_upsert(held, df, ["k"], ["v"], update).collect()]
        monkeypatch.setattr(storage, "BROADCAST_BYTES", r.choice([0, 1 << 30]))
        store.upsert("a.t", df, ["k"], ["v"], update)
        assert rows(store.read("a.t")) == sorted(target, key=repr)
        if step == 3:
            monkeypatch.setattr(Store, "HIDDEN_SHARE", 0.0)
            hidden = bool(store._state("a.t").hidden)
            assert store.compact("a.t") == hidden and not store._state("a.t").hidden
            assert rows(store.read("a.t")) == sorted(target, key=repr)


def test_bytes_written_follow_the_change(spark, store):
    store.append("a.t", spark.range(50_000).select(F.col("id").cast("int").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"), F.lit(1).alias("n"), F.lit(0).alias("at")))
    whole = store.files.bytes(store._dir("a.t"))
    before = store.parts("a.t")
    for k in range(3):
        store.upsert("a.t", spark.createDataFrame([(7 + 1000 * k, "x", 1, 1), (90_000 + k, "y", 1, 1), (8, None, 1, 1)], SCHEMA), ["k"], ["v"])
    assert store.files.bytes(store._dir("a.t")) - whole < 0.05 * whole
    assert before < store.parts("a.t") and store.read("a.t").count() == 50_003
    assert {r["k"] for r in store.read("a.t").where("v IN ('x', 'y') OR v IS NULL").collect()} == {7, 1007, 2007, 90_000, 90_001, 90_002, 8}
    assert store.read("a.t", 2).count() == 50_000 and store.read("a.t", 2).where("k = 7 AND v <> 'x'").count() == 1
    with pytest.raises(Missing):
        store.upsert("a.t", spark.createDataFrame([(None, "z", 1, 1)], SCHEMA), ["k"], ["v"])
    assert store.read("a.t").count() == 50_003


def test_many_positions_are_never_broadcast(spark, store, monkeypatch):
    """Positions of deleted rows compress to small files, which Spark would broadcast by their size: the count decides."""
    store.append("a.t", spark.range(3000).select(F.col("id").cast("int").alias("k"), F.lit("old").alias("v"), F.lit(1).alias("n"), F.lit(0).alias("at")))
    delta = spark.range(1000).select(F.col("id").cast("int").alias("k"), F.lit("new").alias("v"), F.lit(1).alias("n"), F.lit(1).alias("at"))
    store.upsert("a.t", delta, ["k"], ["v"])
    plan = lambda: store.read("a.t")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan()
    monkeypatch.setattr(storage, "BROADCAST_BYTES", 1000 * storage.POSITION_BYTES - 1)
    assert "BroadcastHashJoin" not in plan() and "SortMergeJoin" in plan()
    assert store.read("a.t").count() == 3000 and store.read("a.t").where("v = 'new'").count() == 1000


def test_positions_in_partitions(spark, tmp_path):
    """Files of one write have one name in each partition; deleted rows are told apart by both."""
    s = Store(spark, f"file://{tmp_path}/dw", {"a.t": Table("a.t", dict(T.columns), ("k",), partition="n")})
    s.bootstrap()
    s.append("a.t", spark.range(60).select(F.col("id").cast("int").alias("k"), F.lit("old").alias("v"), (F.col("id") % 3).cast("int").alias("n"), F.lit(0).alias("at")).coalesce(1))
    s.upsert("a.t", spark.createDataFrame([(k, "new", k % 3, 1) for k in (0, 1, 2, 30, 59, 60)], SCHEMA), ["k"], ["v"])
    got = {r["k"]: r["v"] for r in s.read("a.t").collect()}
    assert len(got) == s.read("a.t").count() == 61 and {k for k, v in got.items() if v == "new"} == {0, 1, 2, 30, 59, 60}
    assert {r["k"] for r in s.read("a.t", partitions=["1"]).collect()} == set(range(1, 60, 3))
    s.replace_partitions("a.t", s.read("a.t", partitions=["1"]).withColumn("v", F.lit("again")), ["1"])
    assert s.read("a.t").count() == 61 and s.read("a.t").where("v = 'again'").count() == 20


@pytest.mark.parametrize("partition", ["", "concat('a b%:+', n)"])
def test_upkeep_writes_worn_parts_alone(spark, tmp_path, monkeypatch, partition):
    """Of three parts, or partitions, the one with many deleted rows is written again, then those with most until positions are few."""
    s = Store(spark, f"file://{tmp_path}/dw", {"a.t": Table("a.t", dict(T.columns), ("k",), partition=partition)})
    s.bootstrap()
    for n in range(3):
        s.append("a.t", spark.range(100 * n, 100 * n + 100).select(F.col("id").cast("int").alias("k"), F.lit("old").alias("v"), F.lit(n).alias("n"), F.lit(0).alias("at")))
    first = s.parts("a.t")
    put = lambda *keys: s.upsert("a.t", spark.createDataFrame([(k, "new", k // 100, 1) for k in keys], SCHEMA), ["k"], ["v"])
    now = lambda: {r["k"]: r["v"] for r in s.read("a.t").collect()}
    put(*range(20), 100, 101, 102, 200, 201)
    want = now()
    assert s.compact("a.t")
    assert len(first - s.parts("a.t")) == 1 and sum(s._state("a.t").hidden.values()) == 5
    assert now() == want and s.read("a.t").count() == 300 and sum(v == "new" for v in want.values()) == 25
    assert not s.compact("a.t")
    monkeypatch.setattr(storage, "BROADCAST_BYTES", 4 * storage.POSITION_BYTES)  # of five positions at most two stay
    assert s.compact("a.t") and sum(s._state("a.t").hidden.values()) == 2 and len(first - s.parts("a.t")) == 2
    assert now() == want and s.read("a.t").count() == 300
    put(202)
    assert now() == want | {202: "new"} and s.read("a.t", s.version("a.t") - 1).where("v = 'new'").count() == 25
    s.replace("a.t", s.read("a.t"))
    assert not s._state("a.t").hidden and now() == want | {202: "new"}
    monkeypatch.undo()
    monkeypatch.setattr(Store, "SMALL_PARTS", 3)
    for k in range(203, 208):
        put(k)
    assert len(s._state("a.t").hidden) == 5 and s.compact("a.t")
    assert len(s._state("a.t").hidden) <= 1 and now() == want | {k: "new" for k in range(202, 208)}


def test_sequences_decide(spark, store):
    one = lambda *r: spark.createDataFrame([r], SCHEMA)
    put = lambda *r: store.upsert("a.t", one(*r), ["k"], ["v", "n", "at"], sequence=["at", "n"])
    for r in [(1, "b", 1, 5), (1, "old", 9, 4), (1, "tie", 1, 5), (1, "none", 1, None)]:
        put(*r)
    assert rows(store.read("a.t")) == [(1, "b", 1, 5)]
    put(1, "c", 2, 5)
    assert rows(store.read("a.t")) == [(1, "c", 2, 5)]


def test_batches_are_committed_with_their_parts(spark, store, monkeypatch):
    df = spark.createDataFrame([(1, "a", 1, 1)], SCHEMA)
    for put in (store.append, store.replace):
        store.truncate("a.t")
        for _ in range(2):
            put("a.t", df, batch=(put.__name__, 0))
        assert store.read("a.t").count() == 1
    store.upsert("a.t", df.withColumn("k", F.lit(2)), ["k"], ["v"], batch=("u", 3))
    store.upsert("a.t", df.withColumn("k", F.lit(3)), ["k"], ["v"], batch=("u", 3))
    assert {r["k"] for r in store.read("a.t").collect()} == {1, 2} and store.batch("a.t", "u") == 3
    write = store.files.write  # a crash after the part, before the pointer
    monkeypatch.setattr(store.files, "write", lambda *a, **k: (_ for _ in ()).throw(OSError("stopped")))
    with pytest.raises(OSError):
        store.append("a.t", df.withColumn("k", F.lit(4)), batch=("append", 1))
    monkeypatch.setattr(store.files, "write", write)
    assert store.read("a.t").count() == 2
    for _ in range(2):
        store.append("a.t", df.withColumn("k", F.lit(4)), batch=("append", 1))
    assert sorted(r["k"] for r in store.read("a.t").collect()) == [1, 2, 4]


def test_upkeep_joins_small_parts_and_keeps_versions(spark, store):
    for k in range(25):
        store.append("a.t", spark.createDataFrame([(k, "a", 1, 1)], SCHEMA))
    store.maintain("a.t", keep=3)  # what is younger than a day stays for those who read it
    assert len(store.parts("a.t")) == 1 and store.version("a.t") == 3 and store.read("a.t").count() == 25
    assert len([f for f in store.files.list(store._dir("a.t")) if f.startswith("part-")]) == 26
    store.retain("a.t", 1)
    assert [f for f in store.files.list(store._dir("a.t")) if f.startswith("part-")] == list(store.parts("a.t"))
    assert store.read("a.t").count() == 25 and not store.compact("a.t")
    fresh = Store(spark, store.root, store.tables)
    fresh.append("a.t", spark.createDataFrame([(99, "b", 1, 1)], SCHEMA))
    assert store.read("a.t").count() == 26 and store.version("a.t") == 2
    store.restore("a.t", 1)
    assert store.read("a.t").count() == 25


def test_empty_writes_leave_no_parts(spark, store):
    none = spark.createDataFrame([], SCHEMA)
    store.append("a.t", none)
    store.upsert("a.t", none, ["k"], ["v"])
    store.replace("a.t", none)
    assert not store.parts("a.t") and store.read("a.t").count() == 0
    assert [f for f in store.files.list(store._dir("a.t")) if f.startswith("part-")] == []


def test_scratch_deletes_what_is_made_inside(spark):
    with pytest.raises(ZeroDivisionError), scratch():
        inner = stable(spark.range(3))
        assert inner.count() == 3
        raise ZeroDivisionError
    with pytest.raises(Exception, match="PATH_NOT_FOUND|not exist"):
        inner.count()
    assert stable(spark.range(3)).count() == 3


def test_a_lock_is_renewed_and_a_lost_one_stops_its_owner(spark, store):
    with store.lock(stale=timedelta(seconds=0.6)):
        first = json.loads(store.files.read(f"{store.root}/_lock"))["at"]
        import time

        time.sleep(1)
        assert json.loads(store.files.read(f"{store.root}/_lock"))["at"] > first
        with pytest.raises(RuntimeError), store.lock(stale=timedelta(seconds=0.6)):
            pass
        store.files.write(f"{store.root}/_lock", json.dumps({"owner": "another", "at": first}))
        time.sleep(0.5)
        with pytest.raises(RuntimeError, match="taken over"):
            store.append("a.t", spark.createDataFrame([(1, "a", 1, 1)], SCHEMA))
    assert json.loads(store.files.read(f"{store.root}/_lock"))["owner"] == "another"
    store.break_lock()


def test_rules_while_writing(spark, store):
    good, bad = spark.createDataFrame([(1, "a", 1, 1), (2, "b", 2, 1)], SCHEMA), spark.createDataFrame([(3, " ", 3, 1)], SCHEMA)
    rules = [checks.is_filled("v", ["v"], ["v"]), checks.always("n", F.col("n") < 10), checks.has_rows("least", 1)]
    store.append("a.t", good, rules=rules)
    assert [(f.check, f.ok, f.value) for f in store.findings["a.t"]] == [("v", True, 0), ("n", True, 0), ("least", True, 2)]
    with pytest.raises(storage.Refused, match="v: 1 rows"):
        store.append("a.t", bad, rules=rules)
    assert store.read("a.t").count() == 2 and len([f for f in store.files.list(store._dir("a.t")) if f.startswith("part-")]) == 1


def test_threads_append_to_one_table(spark, store):
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(6) as pool:
        list(pool.map(lambda k: store.append("a.t", spark.createDataFrame([(k, "a", 1, 1)], SCHEMA), batch=(f"w{k}", 0)), range(12)))
    assert sorted(r["k"] for r in store.read("a.t").collect()) == list(range(12))


# streams


def feed(spark, folder, *events):
    df = spark.createDataFrame([(i, u, datetime(2024, 1, d)) for i, u, d in events], ROW)
    df.write.mode("append").parquet(folder)


FACTS = Table("a.facts", {"event_id": "bigint!", "user_id": "bigint", "ts": "timestamp_ntz", "_load_ts": "timestamp_ntz!", "_load_id": "string!"}, ("event_id",))
LAST = Table("a.last", {"user_id": "bigint!", "event_id": "bigint", "event_ts": "timestamp_ntz", "_load_ts": "timestamp_ntz!", "_load_id": "string!"}, ("user_id",))
STAGED = Table("a.staged", {"event_id": "string", "user_id": "string", "event_ts": "timestamp_ntz", "_load_ts": "timestamp_ntz!", "_load_id": "string!"}, ("event_id",))


@pytest.fixture
def sinks(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/dw", {t.name: t for t in (FACTS, LAST, STAGED)})
    s.bootstrap()
    return s


def clock():
    return datetime(2024, 2, 1)


def test_a_new_checkpoint_loses_nothing(spark, sinks, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    feed(spark, a, (1, 1, 1), (2, 1, 2))
    feed(spark, b, (3, 2, 3))
    start = lambda folder, at: stream.resolve_stream(stream.file_stream(spark, folder, spark.createDataFrame([], ROW).schema), sinks, "a.facts", {}, str(tmp_path / at), clock).awaitTermination()
    start(a, "c1")
    start(b, "c2")
    start(a, "c1")
    assert sorted(r["event_id"] for r in sinks.read("a.facts").collect()) == [1, 2, 3]


@pytest.mark.parametrize("days", [(5, 1, 3), (1, 3, 5), (3, 5, 1)])
def test_older_events_never_win(spark, sinks, tmp_path, days):
    folder, at = str(tmp_path / "in"), str(tmp_path / "c")
    for k, d in enumerate(days):
        feed(spark, folder, (10 * d, 1, d), (k, 2 + k, d))
        read = stream.file_stream(spark, folder, spark.createDataFrame([], ROW).schema)
        typed = read.select("user_id", "event_id", F.col("ts").alias("event_ts"), F.lit("2024-01-01").cast("timestamp_ntz").alias("_load_ts"), F.lit("x").alias("_load_id"))
        stream.upsert_stream(typed, sinks, "a.last", ["user_id"], ["event_id"], at).awaitTermination()
    assert {r["user_id"]: r["event_id"] for r in sinks.read("a.last").collect()} == {1: 50, 2: 0, 3: 1, 4: 2}


def test_staging_once_whatever_the_stream(spark, sinks, tmp_path):
    folder = str(tmp_path / "in")
    schema = spark.createDataFrame([], ROW).schema
    feed(spark, folder, (1, 5, 1), (1, 6, 1), (2, 1, 2))
    stream.stage_stream(stream.file_stream(spark, folder, schema), sinks, "a.staged", ["event_id"], "ts", str(tmp_path / "c1"), clock).awaitTermination()
    feed(spark, folder, (1, 7, 9), (3, 1, 2))
    for at in ("c1", "c2"):
        stream.stage_stream(stream.file_stream(spark, folder, schema, 1), sinks, "a.staged", ["event_id"], "ts", str(tmp_path / at), clock).awaitTermination()
    assert sorted((r["event_id"], r["user_id"], r["event_ts"].day) for r in sinks.read("a.staged").collect()) == [("1", "6", 1), ("1", "7", 9), ("2", "1", 2), ("3", "1", 2)]


def test_backfill_writes_the_filled_rows_alone(spark, tmp_path):
    facts = Table("a.f", {"event_id": "bigint!", "user_id": "bigint", "user_sk": "bigint", "_load_ts": "timestamp_ntz!", "_load_id": "string!"}, ("event_id",))
    users = Table("a.u", {"user_sk": "bigint!", "user_id": "bigint!"}, ("user_id",))
    s = Store(spark, f"file://{tmp_path}/dw", {"a.f": facts, "a.u": users})
    s.bootstrap()
    run = Run("fill", datetime(2024, 1, 2))
    s.append("a.f", spark.range(100).select(F.col("id").alias("event_id"), (F.col("id") % 10).alias("user_id"), F.when(F.col("id") % 10 < 8, F.col("id") % 10 + 100).alias("user_sk"), Run("first", datetime(2024, 1, 1)).ts().alias("_load_ts"), F.lit("first").alias("_load_id")))
    s.append("a.u", spark.range(9).select((F.col("id") + 100).alias("user_sk"), F.col("id").alias("user_id")))
    before = s.parts("a.f")
    stream.backfill(s, "a.f", {"user_sk": ("user_id", "a.u", "user_id")}, run)
    assert s.written("a.f", s.parts("a.f") - before) == 10 and s.read("a.f").count() == 100
    assert {(r["user_id"], r["user_sk"], r["_load_id"]) for r in s.read("a.f").where("user_id >= 7").collect()} == {(7, 107, "first"), (8, 108, "fill"), (9, None, "first")}
