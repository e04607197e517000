"""Functional merges: the new content of a table from its old content and a delta."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.operators.increment import free, same
from lakeloom.sources.storage import BROADCAST_BYTES, row_bytes


def differs(a: str, b: str, columns: Sequence[str]) -> Column:
    """Null-safe inequality in any column."""
    return reduce(lambda x, y: x | y, [~F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in columns], F.lit(False))


def scd1_upsert(target: DataFrame, delta: DataFrame, key: Sequence[str], compare: Sequence[str], update: Sequence[str] | None = None, insert: bool = True, delta_rows: int | None = None) -> DataFrame:
    """Update rows whose compared columns differ, insert new keys, delete nothing.

    Unchanged rows keep all their values, lineage too. ``delta`` has one row for each key and the target's
    columns; ``update`` names those that an update writes (all but the key by default). A null key
    matches nothing. With a counted small delta the target isn't shuffled.
    """
    columns = target.columns
    update = [c for c in (update or columns) if c not in key]
    hit, own = free("_hit", target, delta), free("_own", target, delta)
    changed = differs("t", "d", compare)
    pick = [(F.when(F.col(hit) & changed, F.col(f"d.{c}")).otherwise(F.col(f"t.{c}")) if c in update else F.col(f"t.{c}")).alias(c) for c in columns]
    new = delta.select(*columns).withColumn(hit, F.lit(True))
    if delta_rows is not None and delta_rows * row_bytes(delta) <= BROADCAST_BYTES:
        small = F.broadcast(new)
        kept = target.alias("t").join(small.alias("d"), same("t", "d", key), "left").withColumn(hit, F.coalesce(hit, F.lit(False))).select(*pick)
        if not insert:
            return kept
        matched = F.broadcast(target.alias("t").join(small.alias("d"), same("t", "d", key), "left_semi").select(*key).distinct())
        return kept.unionByName(delta.select(*columns).alias("d").join(matched.alias("t"), same("d", "t", key), "left_anti"))
    old = target.withColumn(own, F.lit(True))
    joined = old.alias("t").join(new.alias("d"), same("t", "d", key), "full_outer" if insert else "left").withColumn(hit, F.coalesce(hit, F.lit(False)))
    if not insert:
        return joined.select(*pick)
    known = F.col(own).isNotNull()
    return joined.select(*[F.when(known, p).otherwise(F.col(f"d.{c}")).alias(c) for p, c in zip(pick, columns, strict=True)])


def insert_new(target: DataFrame, delta: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of the delta whose key the target lacks."""
    return delta.alias("d").join(target.select(*key).alias("t"), same("d", "t", key), "left_anti")


def missing(expected: DataFrame, held: DataFrame, key: Sequence[str], held_key: Sequence[str] | None = None) -> DataFrame:
    """Distinct keys of ``expected`` that ``held`` lacks; a null key is always missing."""
    there = held.select(*[F.col(h).alias(k) for k, h in zip(key, held_key or key, strict=True)])
    return expected.select(*key).distinct().alias("e").join(there.alias("h"), same("e", "h", key), "left_anti")
