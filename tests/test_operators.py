"""Operators on tiny frames: the seed scenarios."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lakeloom.functions import parse
from lakeloom.operators import dimension, increment, merge, recompute
from lakeloom.quality import checks
from lakeloom.session import Run

R1, R2, R3 = (Run(f"r{i}", datetime(2024, 1, i), date(2024, 1, i)) for i in (1, 2, 3))
STAGE = "k string, v string, event_ts timestamp_ntz, _load_ts timestamp_ntz, _load_id string"


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def value(spark, column, text="x"):
    return spark.createDataFrame([(text,)], "c string").select(column.alias("o")).first()["o"]


# parsing


def test_parsing(spark):
    assert value(spark, parse.typed("c", "int"), "") is None
    assert value(spark, parse.typed("c", "int"), "12") == 12
    assert value(spark, parse.localised("c"), '{"en": "a", "ru": "b"}') == "b"
    assert value(spark, parse.localised("c", fallback=True), "plain") == "plain"
    assert value(spark, parse.int_array("c"), "{1, 3}") == [1, 3]
    assert value(spark, parse.int_array("c"), "{}") == []
    assert value(spark, parse.array_text(parse.int_array("c")), "{1,3}") == "{1,3}"
    assert value(spark, parse.clock_time("c"), "07:30") == "07:30:00"
    assert value(spark, parse.shift_time("c", 3600), "23:30:10") == "00:30:10"
    assert value(spark, parse.interval_text(parse.interval("c")), "01:40:00") == "01:40:00"
    assert value(spark, parse.interval_text(parse.interval("c")), "26:05:09") == "26:05:09"
    with pytest.raises(PySparkException):
        value(spark, parse.typed("c", "int"), "twelve")
    with pytest.raises(PySparkException):
        value(spark, parse.clock_time("c"), "25:00:00")


def test_ratio_rounds_half_up_and_keeps_zero(spark):
    df = spark.createDataFrame([(1, 8), (1, 0), (1, 3)], "a long, b long")
    assert [str(r[0]) for r in df.select(parse.ratio(F.col("a"), F.col("b"))).collect()] == ["0.1250", "None", "0.3333"]


def test_hashdiff_leaves_nulls_out(spark):
    df = spark.createDataFrame([("a", None, "b"), ("a", "b", None)], "x string, y string, z string")
    assert len({r[0] for r in df.select(parse.hashdiff("x", "y", "z")).collect()}) == 1


# increments


def stage(spark, *data):
    return spark.createDataFrame([(k, v, e, t, i) for k, v, e, t, i in data], STAGE)


def test_window_is_strict_and_a_retry_adds_nothing(spark):
    day = lambda d: datetime(2024, 1, d)
    source = spark.createDataFrame([("a", day(1)), ("b", day(2)), ("c", day(3)), (None, day(3))], "k string, at timestamp_ntz")
    target = stage(spark, ("b", None, day(2), day(2), "r1")).drop("v")
    new = increment.hwm_append(source, target, ["k"], "at", ["k"], R2)
    assert rows(new, "k", "_load_id") == [("c", "r2"), (None, "r2")]
    again = increment.hwm_append(source, target.unionByName(new), ["k"], "at", ["k"], R2)
    assert rows(again, "k") == [(None,)]
    later = increment.hwm_append(source, target.unionByName(new), ["k"], "at", ["k"], R3)
    assert later.count() == 0


def test_history_scope(spark):
    source = spark.createDataFrame([("a", datetime(2024, 2, 1))], "k string, at timestamp_ntz")
    target = stage(spark, ("a", None, datetime(2024, 1, 1), datetime(2024, 1, 1), "r1")).drop("v")
    assert increment.hwm_append(source, target, ["k"], "at", ["k"], R2).count() == 1
    assert increment.hwm_append(source, target, ["k"], "at", ["k"], R2, all_history=True).count() == 0


def test_first_load_takes_everything(spark):
    source = spark.createDataFrame([("a", datetime(1950, 1, 1))], "k string, at timestamp_ntz")
    assert increment.hwm_append(source, stage(spark).drop("v"), ["k"], "at", ["k"], R1).count() == 1


def test_latest_event_wins_with_nulls_last(spark):
    t = datetime(2024, 1, 1)
    s = stage(spark, ("a", "old", datetime(2023, 1, 1), t, "r"), ("a", "new", datetime(2023, 2, 1), t, "r"), ("a", "none", None, t, "r"), ("b", "only", None, t, "r"))
    assert rows(increment.latest_event(s, ["k"]), "k", "v") == [("a", "new"), ("b", "only")]


def test_batches(spark):
    t = lambda d: datetime(2024, 1, d)
    full = stage(spark, ("a", None, None, t(1), "b1"), ("a", None, None, t(2), "b2"), ("a", None, None, t(3), "b3"))
    part = full.where("_load_id <> 'b3'")
    assert increment.resolve_batch([full, part]) == "b2"
    assert increment.resolve_batch([full, part], "b1") == "b1"
    with pytest.raises(LookupError):
        increment.resolve_batch([full, full.limit(0)])


def test_snapshot_has_one_batch(spark):
    t = lambda d: datetime(2024, 1, d)
    s = stage(spark, ("a", "1", None, t(1), "b1"), ("b", "1", None, t(1), "b1"), ("a", "2", None, t(2), "b2"), ("a", "3", None, t(3), "b2"))
    assert rows(increment.snapshot_of(s, "b2", ["k"]), "k", "v") == [("a", "3")]


# merges


@pytest.mark.parametrize("small", [None, 10])
def test_upsert(spark, small):
    target = spark.createDataFrame([("a", None, "r1"), ("b", "x", "r1"), ("c", "x", "r1"), (None, "n", "r1")], "k string, v string, _load_id string")
    delta = spark.createDataFrame([("a", "now", "r2"), ("b", "x", "r2"), ("d", "y", "r2"), (None, "m", "r2")], "k string, v string, _load_id string")
    out = merge.scd1_upsert(target, delta, ["k"], ["v"], delta_rows=small)
    assert rows(out, "k", "v", "_load_id") == sorted([("a", "now", "r2"), ("b", "x", "r1"), ("c", "x", "r1"), ("d", "y", "r2"), (None, "n", "r1"), (None, "m", "r2")], key=repr)
    kept = merge.scd1_upsert(target, delta, ["k"], ["v"], insert=False, delta_rows=small)
    assert kept.count() == target.count()
    assert rows(merge.scd1_upsert(target, delta, ["k"], ["v"], ["v"], delta_rows=small).where("k = 'a'"), "v", "_load_id") == [("now", "r1")]


@pytest.mark.parametrize("small", [None, 10])
def test_upsert_keeps_columns_of_its_own_names(spark, small):
    target = spark.createDataFrame([("a", "x", "1"), ("b", "x", "2")], "k string, _hit string, _own string")
    delta = spark.createDataFrame([("a", "y", "3"), ("c", "z", "4")], "k string, _hit string, _own string")
    out = merge.scd1_upsert(target, delta, ["k"], ["_hit"], delta_rows=small)
    assert rows(out, "k", "_hit", "_own") == [("a", "y", "3"), ("b", "x", "2"), ("c", "z", "4")]


def test_rules_by_one_scan(spark):
    t = spark.createDataFrame([(1, "a"), (1, None), (2, " ")], "k int, v string")
    rules = [checks.is_unique("u", ["k"]), checks.is_filled("f", ["v"], ["v"]), checks.has_rows("n", 3), checks.is_rare("r", F.col("k") == 2), checks.always("i", F.col("k") > 1)]
    found = checks.judge(t, *rules)
    assert [(f.check, f.ok, round(f.value, 2)) for f in found] == [("u", False, 1), ("f", False, 2), ("n", True, 3), ("r.any", False, 1), ("r", False, 0.33), ("i", False, 2)]
    assert all(f.ok for f in checks.judge(t.limit(0), *rules) if f.check != "n")
    one_by_one = [checks.unique("u", t, ["k"]), checks.filled("f", t, ["v"], ["v"]), checks.at_least("n", t, 3), *checks.share("r", t, F.col("k") == 2), checks.invariant("i", t, F.col("k") > 1)]
    assert found == one_by_one


def test_missing_keys(spark):
    a = spark.createDataFrame([("x",), ("y",), (None,)], "k string")
    b = spark.createDataFrame([("x",), ("z",), (None,)], "k string")
    assert rows(merge.missing(a, b, ["k"]), "k") == [("y",), (None,)]


# dimensions


@pytest.mark.parametrize("one_sort", [0, 10**6])
def test_keys_are_dense_and_ordered(spark, one_sort):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("bk"))
    out = dimension.assign_keys(df, "sk", ["bk"], 5, one_sort).collect()
    assert sorted((r["sk"], r["bk"]) for r in out) == [(i + 6, i) for i in range(1000)]


DIM = "sk int, bk string, name string, created_at timestamp_ntz, updated_at timestamp_ntz, _load_id string, _load_ts timestamp_ntz"


def test_keys_stay_and_new_ones_follow(spark):
    first = dimension.scd1_dimension(spark.createDataFrame([], DIM), spark.createDataFrame([("b", "B"), ("c", None)], "bk string, name string"), "sk", "bk", ["name"], R1)
    second = dimension.scd1_dimension(first, spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C")], "bk string, name string"), "sk", "bk", ["name"], R2)
    assert rows(second, "sk", "bk", "name", "_load_id", "created_at") == [(1, "b", "B", "r1", R1.run_ts), (2, "c", "C", "r2", R1.run_ts), (3, "a", "A", "r2", R2.run_ts)]


SCD2 = "sk int, bk string, attr string, city string, hashdiff string, valid_from date, valid_to date, created_at timestamp_ntz, updated_at timestamp_ntz, _load_id string, _load_ts timestamp_ntz"


def apply(spark, dim, data, run, **more):
    source = spark.createDataFrame(data, "bk string, attr string, city string")
    return dimension.scd2_apply(dim, source, "sk", "bk", ["attr"], ["city"], run, **more)


def test_versions(spark):
    far = date(1900, 1, 1)
    one = apply(spark, spark.createDataFrame([], SCD2), [("a", "1", "x"), ("b", "1", "x"), ("c", "1", "x")], R1)
    assert rows(one, "bk", "valid_from", "valid_to") == [(k, far, None) for k in "abc"]
    again = apply(spark, one, [("a", "1", "x"), ("b", "1", "x"), ("c", "1", "x")], R1)
    assert rows(again, *one.columns) == rows(one, *one.columns)
    two = apply(spark, again, [("a", "2", "x"), ("c", "1", "y"), ("d", "1", "x")], R2)
    assert rows(two, "bk", "attr", "city", "valid_from", "valid_to") == sorted(
        [("a", "1", "x", far, R2.day), ("a", "2", "x", R2.day, None), ("b", "1", "x", far, R2.day), ("c", "1", "y", far, None), ("d", "1", "x", far, None)], key=repr
    )
    assert sorted(r["sk"] for r in two.collect()) == [1, 2, 3, 4, 5]
    assert dimension.gaps(two, "bk").count() == dimension.overlaps(two, "sk", "bk").count() == 0
    back = apply(spark, two, [("a", "2", "z"), ("b", "1", "x"), ("c", "1", "y"), ("d", "1", "x")], R3)
    assert rows(back.where("bk = 'b'"), "valid_from", "valid_to") == sorted([(far, R2.day), (R3.day, None)], key=repr)
    assert dimension.gaps(back, "bk").count() == 1
    assert rows(back.where("bk = 'a'"), "city", "valid_to") == sorted([("x", R2.day), ("z", None)], key=repr)
    everywhere = apply(spark, two, [("a", "2", "z")], R3, refresh_all=True)
    assert {r["city"] for r in everywhere.where("bk = 'a'").collect()} == {"z"}
    same_day = apply(spark, two, [("a", "3", "x"), ("c", "1", "y"), ("d", "1", "x")], R2)
    assert rows(same_day.where("bk = 'a'"), "valid_from", "valid_to") == sorted([(far, R2.day), (R2.day, R2.day), (R2.day, None)], key=repr)


def test_lookup_edges(spark):
    dim = spark.createDataFrame([("a", 1, date(1900, 1, 1), date(2024, 1, 2)), ("a", 2, date(2024, 1, 2), None)], "bk string, sk int, valid_from date, valid_to date")
    fact = spark.createDataFrame([("a", date(2024, 1, 1)), ("a", date(2024, 1, 2)), ("z", date(2024, 1, 2)), ("a", None)], "k string, d date")
    out = dimension.asof_lookup(fact, dim, ("k", "bk"), F.col("d"), {"sk": "sk"})
    assert rows(out, "k", "d", "sk") == sorted([("a", date(2024, 1, 1), 1), ("a", date(2024, 1, 2), 2), ("z", date(2024, 1, 2), None), ("a", None, None)], key=repr)


@pytest.mark.parametrize("span", [None, 1, 30, 400])
def test_versions_carried_forward(spark, span):
    """Against the join with all versions, with gaps, ties of time, null keys and days, a key of ten thousand versions, names that clash."""
    day = lambda n: date(2000, 1, 1) + timedelta(days=n)
    r = random.Random(1)
    versions = [("hot", i, day(i), day(i + 1 if i % 3 else i + 2 if i % 2 else i + 1)) for i in range(0, 3000, 2)]
    versions += [(k, 10_000 + i, day(100 * i), None if i == 3 else day(100 * i + (100 if i % 2 else 40))) for k in "abc" for i in range(4)] + [(None, 1, day(0), None)]
    dim = spark.createDataFrame(versions, "bk string, sk int, valid_from date, valid_to date")
    facts = [(r.choice(["hot", "hot", "a", "b", "c", "z", None]), None if r.random() < 0.02 else day(r.randint(-50, 3100)), i) for i in range(1500)] + [("hot", day(10), 7)] * 3
    fact = spark.createDataFrame(facts, "k string, d date, _k int")
    mine = dimension.asof_carry(fact, dim, ("k", "bk"), F.col("d"), {"sk": "sk"}, span=span)
    assert mine.columns == ["k", "d", "_k", "sk"]
    assert rows(mine, "k", "d", "_k", "sk") == rows(dimension.asof_lookup(fact, dim, ("k", "bk"), F.col("d"), {"sk": "sk"}), "k", "d", "_k", "sk")
    assert dimension.asof_carry(fact.limit(0), dim, ("k", "bk"), F.col("d"), {"sk": "sk"}, span=span).count() == 0
    assert dimension.asof_carry(fact, dim.limit(0), ("k", "bk"), F.col("d"), {"sk": "sk"}, span=span).where("sk IS NOT NULL").count() == 0


def test_calendar(spark):
    c = dimension.calendar(spark)
    assert c.count() == 5479
    r = c.where("date_actual = DATE'2017-01-01'").first()
    assert (r["day_of_week"], r["day_name"], r["is_weekend"], r["calendar_sk"]) == (7, "Sunday", True, 367)


# marts


def test_most_frequent_breaks_ties_by_name(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (2, "b"), (2, "b"), (2, "a"), (3, None)], "k int, v string")
    assert rows(recompute.most_frequent(df, ["k"], "v", "m"), "k", "m") == [(1, "a"), (2, "b")]


def test_only_affected_grains_are_written(spark):
    fact = spark.createDataFrame([(1, 10, R1.run_ts), (1, 5, R2.run_ts), (2, 7, R1.run_ts)], "d int, v int, _load_ts timestamp_ntz")
    mart = spark.createDataFrame([(1, 10, R1.run_ts, "r1"), (2, 999, R1.run_ts, "r1")], "d int, s int, _load_ts timestamp_ntz, _load_id string")
    total = lambda f: f.groupBy("d").agg(F.sum("v").cast("int").alias("s"))
    out = recompute.affected_recompute(fact, mart, ["d"], total, ["d"], ["s"], None, lambda x: x.withColumn("_load_ts", R2.ts()).withColumn("_load_id", R2.id()))
    assert rows(out, "d", "s", "_load_id") == [(1, 15, "r2"), (2, 999, "r1")]
