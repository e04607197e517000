"""High-water-mark increments, snapshots and the latest row of each key."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.session import Run

FLOOR = datetime(1900, 1, 1)


def free(name: str, *frames: DataFrame) -> str:
    """A column name made from ``name`` that none of the frames has, whatever its case."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def same(a: str, b: str, keys: Sequence[str]) -> Column:
    """Equality of keys, not null-safe: a null key matches nothing."""
    on = F.lit(True)
    for k in keys:
        on = on & (F.col(f"{a}.{k}") == F.col(f"{b}.{k}"))
    return on


def high_water_mark(target: DataFrame, ts: str, without_run: str | None = None) -> datetime:
    """Largest timestamp, or FLOOR. Leaving the own run out lets a retry see the same window.

    It is a literal: a scan filter and a remote source can take it, a joined one-row table can't.
    """
    rows = target if without_run is None else target.where(F.col("_load_id").isNull() | (F.col("_load_id") != without_run))
    return rows.agg(F.max(ts)).first()[0] or FLOOR


def newer(rows: DataFrame, ts: Column | str, mark: datetime) -> DataFrame:
    """Rows strictly above the mark; rows at the mark or late ones are skipped."""
    return rows.where((F.col(ts) if isinstance(ts, str) else ts) > F.lit(mark.isoformat(sep=" ")).cast("timestamp_ntz"))


def staged(rows: DataFrame, business: Sequence[str], event: Column | str, run: Run) -> DataFrame:
    """Business columns as text, with event time and lineage."""
    at = F.col(event) if isinstance(event, str) else event
    return rows.select(*[F.col(c).cast("string").alias(c) for c in business], at.cast("timestamp_ntz").alias("event_ts"), run.ts().alias("_load_ts"), run.id().alias("_load_id"))


def hwm_append(source: DataFrame, target: DataFrame, key: Sequence[str], event: str, business: Sequence[str], run: Run, all_history: bool = False, mark: datetime | None = None) -> DataFrame:
    """New staging rows of an incremental source: above the mark, not yet staged.

    "Not yet staged" looks at the current run alone, or at all history. Rows that arrive late or
    carry exactly the mark's time are not taken, which is the contract of this operator.
    """
    mark = high_water_mark(target, "event_ts", run.run_id) if mark is None else mark
    window = newer(source, event, mark).alias("s")
    seen = target if all_history else target.where(F.col("_load_id") == run.run_id)
    keys = seen.select(*key).distinct().alias("t")
    return staged(window.join(keys, same("s", "t", key), "left_anti"), business, event, run)


def snapshot_append(source: DataFrame, target: DataFrame, key: Sequence[str], business: Sequence[str], run: Run) -> DataFrame:
    """A full copy for this run, without what this run has staged already."""
    mine = target.where(F.col("_load_id") == run.run_id).select(*key).distinct().alias("t")
    return staged(source.alias("s").join(mine, same("s", "t", key), "left_anti"), business, run.ts(), run)


def latest(rows: DataFrame, key: Sequence[str], *order: Column) -> DataFrame:
    """First row of each key in an order."""
    rank, place = F.row_number().over(Window.partitionBy(*key).orderBy(*order)), free("_rank", rows)
    return rows.withColumn(place, rank).where(F.col(place) == 1).drop(place)


def latest_event(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Incremental rows: event time first, then load time."""
    return latest(rows, key, F.col("event_ts").desc_nulls_last(), F.col("_load_ts").desc_nulls_first())


def latest_load(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Snapshot rows: load time first, then event time."""
    return latest(rows, key, F.col("_load_ts").desc_nulls_first(), F.col("event_ts").desc_nulls_last())


def hwm_delta(stage: DataFrame, current: DataFrame, key: Sequence[str]) -> DataFrame:
    """Staged rows loaded after everything in the current state, one for each raw text key."""
    return latest_event(newer(stage, "_load_ts", high_water_mark(current, "_load_ts")), key)


def hwm_delta_with_history(stage: DataFrame, current: DataFrame, key: Sequence[str], references: DataFrame, reference_current: DataFrame, ref_key: str) -> DataFrame:
    """As hwm_delta, and the whole staged history of keys that new referring rows name."""
    new = newer(stage, "_load_ts", high_water_mark(current, "_load_ts"))
    named = newer(references, "_load_ts", high_water_mark(reference_current, "_load_ts")).select(ref_key).where(F.col(ref_key).isNotNull()).distinct()
    history = stage.join(named, stage[key[0]] == named[ref_key], "left_semi")
    return latest_event(new.unionByName(history), key)


def snapshot_of(stage: DataFrame, batch: str, key: Sequence[str]) -> DataFrame:
    """One batch, one row for each key: the whole new content of a snapshot table."""
    return latest_load(stage.where(F.col("_load_id") == batch), key)


def resolve_batch(stages: Sequence[DataFrame], override: str | None = None) -> str:
    """The batch to load: the named one, or the latest that all snapshots have (ties: greatest id)."""
    if override:
        return override
    found = common_batches(stages).orderBy(F.col("ready_ts").desc(), F.col("_load_id").desc()).limit(1).collect()
    if not found:
        raise LookupError("no batch is in all snapshots")
    return found[0]["_load_id"]


def common_batches(stages: Sequence[DataFrame]) -> DataFrame:
    """Batches that all snapshots have, with the time when the last of them was ready."""
    common = stages[0].select("_load_id")
    for s in stages[1:]:
        common = common.intersect(s.select("_load_id"))
    ready = common.distinct()
    for i, s in enumerate(stages):
        ready = ready.join(s.groupBy("_load_id").agg(F.max("_load_ts").alias(f"_t{i}")), "_load_id")
    times = [F.col(f"_t{i}") for i in range(len(stages))]
    return ready.select("_load_id", (F.greatest(*times) if len(times) > 1 else times[0]).alias("ready_ts"))
