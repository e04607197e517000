"""Every registered query with SQL gives the same rows in DuckDB."""

import os
from datetime import date
from decimal import Decimal

import duckdb
import pytest

from lakeloom.plans import catalog


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, db, sf_dir, name):
    mine = catalog.QUERIES[name](spark, sf_dir)
    other = db.execute(catalog.SQL[name])
    columns = [c[0] for c in other.description]
    assert sorted(mine.columns) == sorted(columns)
    order = sorted(columns)
    a = sorted(repr(tuple(r[c] for c in order)) for r in mine.collect())
    b = sorted(repr(tuple(r[columns.index(c)] for c in order)) for r in other.fetchall())
    assert a == b


def test_entry_contract():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(catalog.QUERIES) <= set(e.queries())
    assert set(catalog.QUERIES) == set(catalog.SQL)


def test_small_deltas_are_counted(spark, sf_dir, monkeypatch):
    seen = []
    upsert = catalog.merge.scd1_upsert
    monkeypatch.setattr(catalog.merge, "scd1_upsert", lambda target, delta, *a, **b: seen.append((target.count(), delta.count(), b["delta_rows"])) or upsert(target, delta, *a, **b))
    larger = sf_dir.replace("0.001", "0.01")
    catalog.QUERIES["scd1_upsert_small_delta"](spark, larger)
    for at in (sf_dir, larger):
        catalog.QUERIES["scd1_upsert_large_target"](spark, at)
    assert all(n == rows for _, n, rows in seen)
    assert seen[1][1] == seen[2][1] < 50 and seen[2][0] >= 1000


def test_a_query_makes_what_it_reads_itself(spark, sf_dir):
    """What a mart shuffles doesn't depend on what ran before, and queries of routes make neither passengers nor tariffs."""
    from lakeloom.plans import adapter

    assert set(adapter.dims(spark, sf_dir, "airports", "airplanes")) == {"airports", "airplanes"}
    assert set(adapter.dims(spark, sf_dir, "routes")) == {"airports", "airplanes", "routes"}
    rows, _ = adapter.new_fact(spark, sf_dir)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    # lines are dealt by ticket once; the second shuffle of their rows is the join with flights
    dealt = [x for x in plan.splitlines() if "Exchange hashpartitioning(ticket_no" in x]
    assert all("flight_id" not in x for x in dealt) and any("REPARTITION_BY_COL" in x for x in dealt)


def test_versions_of_routes_read_no_sales(spark, sf_dir, tmp_path, monkeypatch):
    """Neither the result nor what is written for it reads lines, orders or customers, so their growth costs queries of versions nothing."""
    from lakeloom.operators import dimension
    from lakeloom.plans import adapter

    own = tmp_path / "sf"  # a path that no other test has read
    own.symlink_to(sf_dir)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    read, stable = [], dimension.stable
    for module in (adapter, dimension):
        monkeypatch.setattr(module, "stable", lambda df: read.append(plan(df)) or stable(df))
    read.append(plan(catalog.QUERIES["scd2_overlap_check"](spark, str(own))))
    there = {c: sum(f"Relation [{c}#" in x for x in read) for c in ("s_suppkey", "p_partkey", "l_orderkey", "o_orderkey", "c_custkey")}
    assert there["s_suppkey"] and there["p_partkey"]
    assert not (there["l_orderkey"] or there["o_orderkey"] or there["c_custkey"])


def test_fares_are_those_of_segments(spark, tmp_path):
    """A fare of superseded lines alone is none; one that isn't the last line's in its least and greatest ticket is found among all."""
    from lakeloom.plans import adapter

    day = "TIMESTAMP_NTZ'1996-01-02 00:00:00'"
    lines = [(1, 1, "R"), (1, 2, "N"), (2, 1, "R"), (3, 1, "R"), (3, 2, "N"), (4, 1, "X"), (4, 2, "N"), (5, 1, None)]
    values = ", ".join(f"({k}L, 7L, 1L, {n}, 1D, 2D, 0D, 0D, {repr(f) if f else 'NULL'}, 'F', {day})" for k, n, f in lines)
    names = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"

    def found(where):
        spark.sql(f"SELECT * FROM VALUES {values} AS t({names})").where(where).write.mode("overwrite").parquet(f"{tmp_path}/lineitem.parquet")
        rows = adapter.fares(spark, str(tmp_path))
        own = adapter.segment_lines(spark, str(tmp_path)).select("l_returnflag").distinct()
        assert sorted(map(repr, rows.collect())) == sorted(repr(r).replace("l_returnflag", "fare_conditions") for r in own.collect())
        return {r[0] for r in rows.collect()}, "REPARTITION_BY_COL" in rows._jdf.queryExecution().executedPlan().toString()

    # R is last in ticket 2 alone, neither its least nor its greatest: all lines are dealt
    assert found("true") == ({"R", "N", None}, True)
    assert found("l_orderkey <> 4 AND NOT (l_orderkey = 3 AND l_linenumber = 2)") == ({"R", "N", None}, False)


def test_a_fact_takes_the_dimensions_that_are_named(spark, sf_dir):
    """Passengers and tariffs aren't made for what doesn't read them; segments and passes aren't dated by their tickets."""
    from lakeloom.plans import adapter

    rows, d = adapter.new_fact(spark, sf_dir, *adapter.FLIGHT)
    assert set(d) == set(adapter.FLIGHT) and not {"tariff_sk", "passenger_sk"} & set(rows.columns)
    whole, all_ = adapter.new_fact(spark, sf_dir)
    assert set(whole.columns) - set(rows.columns) == {"tariff_sk", "passenger_sk"} and set(all_) == {*adapter.FLIGHT, "tariffs", "passengers"}
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    # orders are read as tickets and as bookings, lines as segments, passes and flights, and nothing again to date them
    assert [plan.count(f"Relation [{c}#") for c in ("o_orderkey", "c_custkey", "l_orderkey")] == [2, 1, 3]
    assert whole.count() == rows.count() > 0


def _fact(spark, rows):
    names = "calendar_sk int, airplane_sk int, tariff_sk int, passenger_sk int, route_sk int, book_ref string, flight_id int, price decimal(10,2), is_boarded boolean"
    return spark.createDataFrame([(*r[:7], Decimal(r[7]), r[8]) for r in rows], names)


def _dims(spark):
    from lakeloom.operators import dimension

    return {
        "calendar": dimension.calendar(spark, date(1995, 1, 1), date(1995, 3, 31)),
        "airplanes": spark.sql("SELECT 1 AS airplane_sk, 'P' AS airplane_bk, 'p' AS model, 10 AS total_seats"),
        "routes": spark.sql("SELECT * FROM VALUES (1, 'a'), (2, 'a'), (3, 'b') AS t(route_sk, route_bk)"),
        "tariffs": spark.sql("SELECT * FROM VALUES (1, 'Y'), (2, 'B') AS t(tariff_sk, fare_conditions)"),
        "passengers": spark.sql("SELECT * FROM VALUES (1, 'one', 'One'), (2, 'two', 'Two'), (3, 'none', 'None') AS t(passenger_sk, passenger_id, passenger_name)"),
    }


def _exchanged(df, what):
    return [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning(" in x and what in x]


def test_monthly_overview_shuffles_passengers_once(spark):
    from lakeloom.plans import marts

    rows = [(1, 1, 1, 1, 1, "x", 1, 10, True), (2, 1, 1, 1, 1, "x", 2, 10, True), (2, 1, 1, 2, 1, "y", 2, 10, False), (40, 1, 1, 1, 3, "z", 3, 10, True), (40, 1, 1, None, 3, "z", 3, 10, True)]
    got = marts.monthly_overview(_fact(spark, rows), _dims(spark))
    assert len(_exchanged(got, "passenger_sk")) == 1
    names = ("month_actual", "total_flights", "total_tickets", "unique_routes", "unique_passengers")
    assert sorted(tuple(r[n] for n in names) for r in got.collect()) == [(1, 2, 3, 1, 2), (2, 1, 2, 1, 1)]


def test_passenger_loyalty_deals_rows_once(spark):
    """Versions of a route are one, nulls aren't counted, ties of fares go to the least; no row is repeated for a distinct count."""
    from lakeloom.plans import marts

    rows = [
        (1, 1, 1, 1, 1, "x", 1, 10, True),
        (2, 1, 2, 1, 2, "x", 2, 20, False),
        (3, 1, 2, 1, 3, "y", 2, 30, True),
        (40, 1, 1, 1, None, None, None, 40, False),
        (5, 1, None, 1, 3, "z", 3, 50, None),
        (5, 1, None, 2, 1, "w", 4, 5, True),
        (6, 1, 1, None, 1, "v", 5, 6, True),
    ]
    got = marts.passenger_loyalty(_fact(spark, rows), _dims(spark))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and plan.count("Scan ExistingRDD") == 1
    found = {r["passenger_bk"]: r for r in got.collect()}
    assert set(found) == {"one", "two"}
    names = ("total_bookings", "total_flights", "total_boarded", "total_spent", "avg_ticket_price", "favorite_fare_conditions", "unique_routes", "first_flight_date", "last_flight_date", "days_as_customer")
    assert [found["one"][n] for n in names] == [3, 3, 2, Decimal("150.00"), Decimal("30.00"), "B", 2, date(1995, 1, 1), date(1995, 2, 9), 39]
    assert [found["two"][n] for n in names] == [1, 1, 1, Decimal("5.00"), Decimal("5.00"), None, 1, date(1995, 1, 5), date(1995, 1, 5), 0]


def test_invariants_write_no_fact(spark, sf_dir, monkeypatch):
    """The mart is judged by one scan, so its fact needn't be written."""
    from lakeloom.plans import adapter

    monkeypatch.setattr(adapter, "fact", lambda *a, **b: pytest.fail("the fact was written"))
    assert len(catalog.QUERIES["dq_invariants"](spark, sf_dir).collect()) == 3
