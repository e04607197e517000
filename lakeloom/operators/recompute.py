"""Recomputing the affected grains of an aggregate, roles as rows, the most frequent value."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.operators.increment import high_water_mark, newer
from lakeloom.operators.merge import scd1_upsert


def affected(fact: DataFrame, mark: datetime, key: Sequence[str]) -> DataFrame:
    """Distinct keys of facts loaded after a mark."""
    return newer(fact, "_load_ts", mark).select(*key).distinct()


def affected_rows(fact: DataFrame, mark: datetime, affected_key: Sequence[str], aggregate: Callable[[DataFrame], DataFrame], keep: Callable[[DataFrame], DataFrame] = lambda x: x) -> DataFrame:
    """Whole keys that facts after the mark touch, aggregated again."""
    return keep(aggregate(fact.join(affected(fact, mark, affected_key), list(affected_key), "left_semi")))


def affected_recompute(fact: DataFrame, mart: DataFrame, affected_key: Sequence[str], aggregate: Callable[[DataFrame], DataFrame], grain: Sequence[str], compare: Sequence[str], update: Sequence[str] | None = None, keep: Callable[[DataFrame], DataFrame] = lambda x: x, mark: datetime | None = None) -> DataFrame:
    """New content of a mart: whole affected keys are aggregated again and merged.

    Facts are cut to the affected keys before they are aggregated; other rows of the mart aren't
    touched, nor are rows whose grain has gone. Only a difference in ``compare`` writes a row. Without
    a mark that of the mart's rows counts.
    """
    mark = high_water_mark(mart, "_load_ts") if mark is None else mark
    return scd1_upsert(mart, affected_rows(fact, mark, affected_key, aggregate, keep), grain, compare, update)


def roles(rows: DataFrame, role: str, key: str, variants: dict[str, str]) -> DataFrame:
    """A row for each role of a row, from one scan: ``variants`` maps a role to its key column."""
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.col(c).alias("k")) for r, c in variants.items()]))
    return rows.withColumn("_role", each).withColumn(role, F.col("_role.r")).withColumn(key, F.col("_role.k")).drop("_role")


def most_frequent(rows: DataFrame, key: Sequence[str], value: str, name: str) -> DataFrame:
    """Most frequent value of each key, nulls left out; ties go to the least value."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*key, value).agg(F.count(F.lit(1)).alias("_n"))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.col("_n").desc(), F.col(value).asc()))
    return counts.withColumn("_r", rank).where("_r = 1").select(*key, F.col(value).alias(name))


def distinct_in_role(role: Column, value: Column) -> Column:
    return F.count_distinct(F.when(role, value))
