"""Commands: ``python -m lakeloom load|validate|status|truncate|restore|analyze|unlock ROOT ...``."""

from __future__ import annotations

import argparse
from datetime import date, datetime, timezone

from lakeloom.flow.runs import run_all, validate_graph
from lakeloom.plans.layers import load_first
from lakeloom.session import Run, session
from lakeloom.sources.readers import Jdbc, parquet_source
from lakeloom.sources.storage import Store


def arguments(args: list[str] | None = None) -> argparse.Namespace:
    top = argparse.ArgumentParser(prog="lakeloom", description=__doc__)
    top.add_argument("--master", help="Spark master; that of spark-submit by default")
    commands = top.add_subparsers(dest="command", required=True)
    each = {n: commands.add_parser(n, help=h) for n, h in (("load", "load all layers"), ("validate", "run all validators"), ("status", "rows and versions of each table"), ("truncate", "empty all tables"), ("restore", "make an earlier version the current one"), ("analyze", "statistics of a table"), ("unlock", "remove the lock of a load that died"))}
    for p in each.values():
        p.add_argument("root", help="folder of the warehouse")
    each["load"].add_argument("--parquet", help="folder of source tables")
    each["load"].add_argument("--jdbc", help="URL of the source database")
    each["load"].add_argument("--schema", default="bookings", help="schema of the source database")
    each["load"].add_argument("--property", action="append", default=[], help="name=value of the connection")
    each["load"].add_argument("--split", action="append", default=[], metavar="TABLE:COLUMN:LOW:HIGH:PARTS", help="read a table by ranges of a numeric column, side by side")
    each["load"].add_argument("--text", action="append", default=[], metavar="TABLE:COLUMN", help="read a column as text, whatever the database says of its type")
    each["load"].add_argument("--first", action="append", default=[], metavar="TABLE:COLUMN:PARTS", help="load a table for the first time in parts of equal rows, cut at values of a column; a stopped load goes on with its --run")
    each["load"].add_argument("--days", nargs=2, type=date.fromisoformat, help="first and last day of the calendar")
    for n in ("load", "validate"):
        each[n].add_argument("--run", help="id of the run; its moment by default")
    for n in ("restore", "analyze"):
        each[n].add_argument("table")
    each["restore"].add_argument("version", type=int)
    return top.parse_args(args)


def jdbc_of(a: argparse.Namespace) -> Jdbc:
    """The source database, with its reads side by side and its columns of text."""
    texts: dict[str, tuple[str, ...]] = {}
    for table, column in (x.split(":") for x in a.text):
        texts[table] = (*texts.get(table, ()), column)
    splits = {t: (c, int(low), int(high), int(n)) for t, c, low, high, n in (x.split(":") for x in a.split)}
    return Jdbc(a.jdbc, a.schema, dict(p.split("=", 1) for p in a.property), texts, splits)


def main(args: list[str] | None = None) -> int:
    a = arguments(args)
    spark = session(master=a.master)
    store = Store(spark, a.root)
    now = datetime.now(timezone.utc).replace(tzinfo=None)
    run = Run(getattr(a, "run", None) or now.strftime("run_%Y%m%dT%H%M%S"), now)
    if a.command == "load":
        if bool(a.parquet) == bool(a.jdbc):
            raise SystemExit("name one source, --parquet or --jdbc")
        if a.first and not a.run:
            raise SystemExit("--first needs a --run, by which a stopped load is known again")
        database = None if a.parquet else jdbc_of(a)
        source = parquet_source(spark, a.parquet) if a.parquet else database.source(spark)
        store.bootstrap()
        for name, column, parts in (x.split(":") for x in a.first):
            with store.lock():
                print(name, load_first(store, database, name, run, column, int(parts)), "parts")
        for outcome in run_all(store, source, run, tuple(a.days) if a.days else None):
            print(outcome.state)
    elif a.command == "validate":
        with store.lock():
            outcome = validate_graph(store, run).run()
        print(outcome.state)
        return len(outcome.errors)
    elif a.command == "status":
        for name in store.tables:
            print(name, store.version(name), store.read(name).count())
    elif a.command == "truncate":
        with store.lock():
            store.reset()
    elif a.command == "restore":
        with store.lock():
            store.restore(a.table, a.version)
    elif a.command == "analyze":
        store.analyze(a.table).show(1000, False)
    else:
        store.break_lock()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
