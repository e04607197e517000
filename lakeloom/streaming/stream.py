"""Streams into the same tables: each micro-batch is a run of the batch operators.

A table's pointer keeps, with the parts of a micro-batch, the stream's own id and the batch's number. The id is that of
the checkpoint, so a repeated micro-batch is known whatever run repeats it, and another stream, or
one that starts anew with an empty checkpoint, is another writer: none of its batches is taken for a known one.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from lakeloom.operators.dimension import lookup
from lakeloom.operators.increment import free, latest, same, staged
from lakeloom.session import Run
from lakeloom.sources.storage import Files, Store, scratch, stable

Clock = Callable[[], datetime]
#: Micro-batches after which small parts are joined and old versions forgotten.
UPKEEP = 50


def file_stream(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def writer_of(spark: SparkSession, checkpoint: str) -> str:
    """The id that a stream keeps in its checkpoint, from its first start on."""
    return json.loads(Files(spark, checkpoint).read(f"{checkpoint.rstrip('/')}/metadata"))["id"]


def _each_batch(rows: DataFrame, store: Store, name: str, checkpoint: str, load: Callable[[DataFrame, int, tuple[str, int]], None], trigger: dict[str, object], mode: str = "append") -> StreamingQuery:
    """Start a stream whose micro-batches ``load`` writes, given the batch's number and what the table is to remember of it."""

    def run(batch: DataFrame, number: int) -> None:
        mine = (writer_of(store.spark, checkpoint), number)
        last = store.batch(name, mine[0])
        if last is not None and last >= number:
            return
        with scratch():
            load(batch, number, mine)
        if number % UPKEEP == UPKEEP - 1:
            store.maintain(name)

    return rows.writeStream.outputMode(mode).foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def stage_stream(rows: DataFrame, store: Store, name: str, key: Sequence[str], event: str, checkpoint: str, clock: Clock = datetime.now, **trigger: object) -> StreamingQuery:
    """Append a stream to a staging table: each key once an event time, whichever stream brought it.

    Of rows with one key and event time in a batch the greatest is staged. Of staged rows those within the batch's event
    times alone are looked at, so that parts outside of them are skipped.
    """
    business = [c for c in store.tables[name].columns if c not in ("event_ts", "_load_ts", "_load_id")]

    def load(batch: DataFrame, number: int, mine: tuple[str, int]) -> None:
        run = Run(f"stream-{number}", clock())
        once = [*key, "event_ts"]
        new = stable(latest(staged(batch, business, event, run), once, *[F.col(c).desc_nulls_last() for c in business]))
        low, high = new.agg(F.min("event_ts"), F.max("event_ts")).first()
        held = store.read(name).select(*once)
        within = F.col("event_ts").isNull()
        if low is not None:
            at = lambda t: F.lit(t.isoformat(sep=" ")).cast("timestamp_ntz")
            within = within | F.col("event_ts").between(at(low), at(high))
        on = same("d", "t", key) & F.col("d.event_ts").eqNullSafe(F.col("t.event_ts"))
        store.append(name, new.alias("d").join(held.where(within).alias("t"), on, "left_anti"), batch=mine)

    return _each_batch(rows, store, name, checkpoint, load, trigger)


def upsert_stream(rows: DataFrame, store: Store, name: str, key: Sequence[str], compare: Sequence[str], checkpoint: str, sequence: Sequence[str] = ("event_ts", "_load_ts"), **trigger: object) -> StreamingQuery:
    """Merge a stream of full rows into a current-state table, by the order of events instead of their arrival.

    The row with the greatest ``sequence`` counts, within a batch and against the table; of equal ones the greatest in
    ``compare``, so that the table is the same in whatever order and batches the rows come.
    """
    order = [*sequence, *[c for c in compare if c not in sequence]]

    def load(batch: DataFrame, number: int, mine: tuple[str, int]) -> None:
        newest = latest(batch, key, *[F.col(c).desc_nulls_last() for c in order]).select(*store.tables[name].columns)
        store.upsert(name, newest, key, [c for c in order if c not in key], sequence=order, batch=mine)

    return _each_batch(rows, store, name, checkpoint, load, trigger)


def resolve_stream(rows: DataFrame, store: Store, name: str, lookups: dict[str, tuple[str, str, str]], checkpoint: str, clock: Clock = datetime.now, **trigger: object) -> StreamingQuery:
    """Append a stream of facts with surrogate keys: ``lookups`` maps a key column to (business column, dimension, its key).

    Each micro-batch reads the dimensions as they are then. A fact whose dimension row is late keeps a null
    key until ``backfill``.
    """

    def load(batch: DataFrame, number: int, mine: tuple[str, int]) -> None:
        run = Run(f"stream-{number}", clock())
        for sk, (own, dim, bk) in lookups.items():
            batch = lookup(batch, store.read(dim), own, bk, {sk: sk})
        store.append(name, batch.withColumn("_load_id", run.id()).withColumn("_load_ts", run.ts()), batch=mine)

    return _each_batch(rows, store, name, checkpoint, load, trigger)


def backfill(store: Store, name: str, lookups: dict[str, tuple[str, str, str]], run: Run) -> None:
    """Fill null keys whose dimension rows have come since; keys that are there stay, and rows without a null aren't written.

    The table's key tells its rows apart.
    """
    lacking = lambda c: F.col(c).isNull()
    some: Column = F.lit(False)
    for sk in lookups:
        some = some | lacking(sk)
    rows, found = store.read(name).where(some), F.lit(False)
    for sk, (own, dim, bk) in lookups.items():
        late = free("_late", rows)
        rows = lookup(rows, store.read(dim), own, bk, {sk: late}).withColumn(free(f"_was_{sk}", rows), lacking(sk) & F.col(late).isNotNull())
        found = found | F.col(rows.columns[-1])
        rows = rows.withColumn(sk, F.coalesce(sk, late)).drop(late)
    filled = rows.where(found).withColumn("_load_id", run.id()).withColumn("_load_ts", run.ts())
    store.upsert(name, filled, store.tables[name].key, list(lookups), [*lookups, "_load_id", "_load_ts"])


# time


def timed(rows: DataFrame, ts: str, late: str) -> DataFrame:
    """Rows with ``_ts`` and a watermark on it, which is ``late`` behind the greatest time seen."""
    return rows.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)


def windowed_counts(rows: DataFrame, ts: str, every: str, late: str, *key: str) -> DataFrame:
    """Counts in tumbling windows; rows later than the watermark are dropped."""
    counts = timed(rows, ts, late).groupBy(F.window("_ts", every).alias("w"), *key).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").alias("window_start"), *key, "n")


def counts_stream(rows: DataFrame, store: Store, name: str, ts: str, every: str, late: str, key: Sequence[str], checkpoint: str, once: Sequence[str] = (), **trigger: object) -> StreamingQuery:
    """Append the counts of windows that the watermark has passed; their state is given up, and rows later than it are dropped.

    With ``once`` rows of one such key count once. ``dropped`` then says how many rows were late; without, how many sums of
    a task's rows, as those are formed before they are looked at.
    """
    counts = timed(rows, ts, late)
    if once:
        counts = counts.dropDuplicatesWithinWatermark(list(once))
    counts = counts.groupBy(F.window("_ts", every).alias("w"), *key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), *key, "n")
    return _each_batch(counts, store, name, checkpoint, lambda batch, number, mine: store.append(name, batch, batch=mine), trigger)


def distinct_stream(rows: DataFrame, store: Store, name: str, key: Sequence[str], ts: str, late: str, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Append a stream, of rows with one key within the watermark's delay one only; keys are kept no longer than that."""
    once = timed(rows, ts, late).dropDuplicatesWithinWatermark(list(key)).drop("_ts")
    return _each_batch(once, store, name, checkpoint, lambda batch, number, mine: store.append(name, batch, batch=mine), trigger)


def dropped(query: StreamingQuery) -> int:
    """Rows that came after the watermark had passed them, over the micro-batches that the query's progress still has."""
    return sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)
