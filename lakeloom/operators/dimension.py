"""Surrogate keys, type-1 and type-2 dimensions, point-in-time lookups, the calendar."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeloom.functions.parse import hashdiff
from lakeloom.operators.increment import free, latest, same
from lakeloom.operators.merge import differs, insert_new, scd1_upsert
from lakeloom.session import Run
from lakeloom.sources.storage import stable

FIRST_DAY = date(1900, 1, 1)
#: Rows up to which one sorted partition numbers them.
ONE_SORT = 1_000_000


def assign_keys(rows: DataFrame, name: str, order: Sequence[str], start: int = 0, one_sort: int = ONE_SORT) -> DataFrame:
    """Dense keys from ``start + 1`` in an order; the first column is the key.

    Rows are written once before they are counted, so that nothing is computed twice. Beyond
    ``one_sort`` rows: a range-partitioned sort, the row counts of its partitions, and offsets from
    them. No task sees more than its range.
    """
    columns, rows = rows.columns, stable(rows)
    if rows.count() <= one_sort:
        key = (F.row_number().over(Window.orderBy(*order)) + start).cast("int")
        return rows.select(key.alias(name), *columns)
    place = F.struct(F.spark_partition_id().alias("p"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("i"))
    held = stable(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", place))
    offsets, n = [], start
    for r in held.groupBy("_place.p").count().orderBy("p").collect():
        offsets.append((r["p"], n))
        n += r["count"]
    before = rows.sparkSession.createDataFrame(offsets, "_p int, _before long")
    joined = held.join(F.broadcast(before), F.col("_place.p") == F.col("_p"))
    return joined.select((F.col("_before") + F.col("_place.i") + 1).cast("int").alias(name), *columns)


def max_key(dim: DataFrame, name: str) -> int:
    return dim.agg(F.max(name)).first()[0] or 0


def scd1_dimension(dim: DataFrame, source: DataFrame, sk: str, bk: str, attributes: Sequence[str], run: Run, update: bool = True) -> DataFrame:
    """Type-1 dimension: changed attributes are overwritten, new business keys get the next keys.

    ``source`` has one row for each business key. With ``update=False`` rows are only added.
    """
    fresh = source.select(bk, *attributes)
    audit = [run.ts().alias("created_at"), run.ts().alias("updated_at"), run.id().alias("_load_id"), run.ts().alias("_load_ts")]
    new = assign_keys(insert_new(dim, fresh, [bk]), sk, [bk], max_key(dim, sk)).select(sk, bk, *attributes, *audit)
    old = dim
    if update and attributes:
        delta = fresh.select(F.lit(None).cast("int").alias(sk), bk, *attributes, *audit)
        old = scd1_upsert(dim, delta.select(*dim.columns), [bk], attributes, [*attributes, "updated_at", "_load_id", "_load_ts"], insert=False)
    return old.unionByName(new.select(*dim.columns))


def scd1_delta(dim: DataFrame, source: DataFrame, sk: str, bk: str, attributes: Sequence[str], run: Run, update: bool = True) -> DataFrame:
    """The rows of a type-1 dimension that a load adds or changes, whole, with their keys; see ``scd1_dimension``."""
    fresh = source.select(bk, *attributes)
    audit = [run.ts().alias("created_at"), run.ts().alias("updated_at"), run.id().alias("_load_id"), run.ts().alias("_load_ts")]
    new = assign_keys(insert_new(dim, fresh, [bk]), sk, [bk], max_key(dim, sk)).select(sk, bk, *attributes, *audit)
    if not (update and attributes):
        return new.select(*dim.columns)
    known = dim.select(bk, sk, *attributes).alias("t").join(fresh.alias("s"), same("t", "s", [bk])).where(differs("t", "s", attributes))
    changed = known.select(F.col(f"t.{sk}"), F.col(f"s.{bk}"), *[F.col(f"s.{c}") for c in attributes], *audit)
    return new.unionByName(changed).select(*dim.columns)


def scd2_apply(dim: DataFrame, source: DataFrame, sk: str, bk: str, hashed: Sequence[Column | str], refreshed: Sequence[str], run: Run, refresh_all: bool = False) -> DataFrame:
    """Type-2 dimension with half-open versions ``[valid_from, valid_to)``; open ones have no end.

    1. an open version whose hash differs from the source's, or whose key the source lacks, ends
       on the run's day;
    2. a key without an open version of the same hash gets a new one, from FIRST_DAY if the key
       was never seen, else from the run's day;
    3. ``refreshed`` attributes are overwritten in open versions (or all) without a new version.

    Applying it again on the same day without a change changes nothing.
    """
    own = {sk, bk, "hashdiff", "valid_from", "valid_to", "created_at", "updated_at", "_load_id", "_load_ts"}
    attributes = [c for c in dim.columns if c in source.columns and c not in own]
    now = source.withColumn("hashdiff", hashdiff(*hashed))
    s = now.select(F.col(bk).alias("_bk"), F.col("hashdiff").alias("_hash"), *[F.col(c).alias(f"_new_{c}") for c in refreshed])
    open_ = F.col("valid_to").isNull()
    joined = dim.join(s, dim[bk] == s["_bk"], "left")
    ends = open_ & (F.col("_bk").isNull() | (F.col("_hash") != F.col("hashdiff")))
    scope = F.col("_bk").isNotNull() & (F.lit(refresh_all) | (open_ & ~ends))
    moved = F.lit(False)
    for c in refreshed:
        moved = moved | ~F.col(c).eqNullSafe(F.col(f"_new_{c}"))
    old = joined.select(
        *[
            F.when(scope, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)
            if c in refreshed
            else F.when(ends, run.date()).otherwise(F.col(c)).alias(c)
            if c == "valid_to"
            else F.when(ends | (scope & moved), run.ts()).otherwise(F.col(c)).alias(c)
            if c == "updated_at"
            else F.col(c)
            for c in dim.columns
        ]
    )
    known = dim.groupBy(F.col(bk).alias("_k")).agg(F.max(F.when(open_, F.col("hashdiff"))).alias("_open"))
    fresh = now.join(known, now[bk] == known["_k"], "left").where(F.col("_open").isNull() | (F.col("_open") != F.col("hashdiff")))
    begins = F.when(F.col("_k").isNull(), F.lit(FIRST_DAY.isoformat()).cast("date")).otherwise(run.date())
    added = fresh.select(bk, *attributes, "hashdiff", begins.alias("valid_from"), F.lit(None).cast("date").alias("valid_to"), run.ts().alias("created_at"), run.ts().alias("updated_at"), run.id().alias("_load_id"), run.ts().alias("_load_ts"))
    numbered = assign_keys(added, sk, [bk], max_key(dim, sk))
    return old.unionByName(numbered.select(*dim.columns))


def asof_lookup(fact: DataFrame, dim: DataFrame, key: tuple[str, str], day: Column, columns: dict[str, str], valid_from: str = "valid_from", valid_to: str = "valid_to") -> DataFrame:
    """Left join with the version valid on a day. ``columns`` maps columns of the dimension to new names.

    Versions of a key may not overlap, or rows repeat.
    """
    k, low, high, at = (free(x, fact) for x in ("_k", "_from", "_to", "_day"))
    d = dim.select(F.col(key[1]).alias(k), F.col(valid_from).alias(low), F.col(valid_to).alias(high), *[F.col(c).alias(n) for c, n in columns.items()])
    rows = fact.withColumn(at, day)
    on = (rows[key[0]] == d[k]) & (rows[at] >= d[low]) & (d[high].isNull() | (rows[at] < d[high]))
    return rows.join(d, on, "left").drop(k, low, high, at)


def asof_carry(fact: DataFrame, dim: DataFrame, key: tuple[str, str], at: Column, columns: dict[str, str], valid_from: str = "valid_from", valid_to: str = "valid_to", span: int | None = None) -> DataFrame:
    """As ``asof_lookup``, for keys of many versions: rows and versions are sorted together and the last version is carried forward.

    A row costs the same whatever the number of versions; ``asof_lookup`` meets all versions of its key. Of versions
    that overlap the one that began last counts, so that no row repeats. ``at`` and the bounds have one type, a date or a
    timestamp. With a ``span`` of days a key is cut into ranges of time, each sorted by itself, as one key may hold a
    large share of all rows: the version that is valid when a range begins is added to it.
    """
    k, low, high, kind, t, own, cell, held = (free(x, fact) for x in ("_k", "_from", "_to", "_kind", "_at", "_row", "_cell", "_held"))
    version = dim.where(F.col(key[1]).isNotNull() & F.col(valid_from).isNotNull()).select(F.col(key[1]).alias(k), F.col(valid_from).alias(low), F.col(valid_to).alias(high), F.struct(*[F.col(c).alias(n) for c, n in columns.items()]).alias(held))
    rows = fact.select(F.col(key[0]).alias(k), at.alias(t), F.lit(1).alias(kind), F.struct(*fact.columns).alias(own))
    keys = [k]
    if span:
        number = lambda c: F.floor(F.unix_date(F.to_date(c)) / span)
        first, last = rows.agg(F.min(number(F.col(t))), F.max(number(F.col(t)))).first()
        if first is not None:
            after = Window.partitionBy(k).orderBy(low)
            until = F.least(F.coalesce(number(F.lead(low).over(after)), F.lit(last)), F.lit(last))
            start = F.greatest(number(F.col(low)), F.lit(first))
            version = version.withColumn("_until", until).where(start <= F.col("_until")).withColumn(cell, F.explode(F.sequence(start, F.col("_until")))).drop("_until")
            rows, keys = rows.withColumn(cell, number(F.col(t))), [k, cell]
    both = rows.unionByName(version.withColumn(t, F.col(low)).withColumn(kind, F.lit(0)), allowMissingColumns=True)
    seen = F.last(F.when(F.col(kind) == 0, F.struct(F.col(high).alias("to"), F.col(held).alias("v"))), ignorenulls=True).over(Window.partitionBy(*keys).orderBy(F.col(t).asc_nulls_first(), kind, F.col(low).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn(held, seen).where(F.col(kind) == 1)
    valid = F.col(k).isNotNull() & F.col(t).isNotNull() & (F.col(f"{held}.to").isNull() | (F.col(t) < F.col(f"{held}.to")))
    return found.select(f"{own}.*", *[F.when(valid, F.col(f"{held}.v.{n}")).alias(n) for n in columns.values()])


def latest_version(rows: DataFrame, key: str, version: str) -> DataFrame:
    """The row with the greatest version of each key, as text."""
    return latest(rows, [key], F.col(version).desc_nulls_first())


def gaps(dim: DataFrame, bk: str) -> DataFrame:
    """Versions whose end isn't the next one's start."""
    after = F.lead("valid_from").over(Window.partitionBy(bk).orderBy("valid_from", F.col("valid_to").asc_nulls_last()))
    return dim.withColumn("next_from", after).where(F.col("next_from").isNotNull() & (F.col("valid_to").isNull() | (F.col("valid_to") != F.col("next_from"))))


def overlaps(dim: DataFrame, sk: str, bk: str) -> DataFrame:
    """Versions that share a day with an earlier one of their key (a_sk the one that lasts longest, b_sk the later one).

    One sort a key, and a row for each version that is in the way, not for each pair; zero-length
    versions share no day.
    """
    far = F.lit("9999-12-31").cast("date")
    rows = dim.select(F.col(bk).alias("bk"), F.col(sk).alias("b_sk"), F.col("valid_from").alias("b_from"), F.coalesce("valid_to", far).alias("b_to")).where("b_from < b_to")
    before = Window.partitionBy("bk").orderBy("b_from", "b_sk").rowsBetween(Window.unboundedPreceding, -1)
    longest = F.max(F.struct(F.col("b_to").alias("to"), F.col("b_sk").alias("sk"), F.col("b_from").alias("from"))).over(before)
    met = rows.withColumn("a", longest).where(F.col("a.to") > F.col("b_from"))
    return met.select(F.col("bk").alias("a_bk"), F.col("a.sk").alias("a_sk"), F.col("a.from").alias("a_from"), F.col("a.to").alias("a_to"), F.col("bk").alias("b_bk"), "b_sk", "b_from", "b_to")


def calendar(spark: SparkSession, first: date = date(2016, 1, 1), last: date = date(2030, 12, 31)) -> DataFrame:
    """A row for each day, with keys in day order; Monday is day 1."""
    days = spark.sql(f"SELECT explode(sequence(DATE'{first}', DATE'{last}', INTERVAL 1 DAY)) AS date_actual")
    d = F.col("date_actual")
    return days.select(
        (F.datediff(d, F.lit(first.isoformat()).cast("date")) + 1).cast("int").alias("calendar_sk"),
        "date_actual",
        F.year(d).alias("year_actual"),
        F.month(d).alias("month_actual"),
        F.dayofmonth(d).alias("day_actual"),
        (F.weekday(d) + 1).alias("day_of_week"),
        F.date_format(d, "EEEE").alias("day_name"),
        F.weekday(d).isin(5, 6).alias("is_weekend"),
    )


def lookup(fact: DataFrame, dim: DataFrame, fact_key: str, dim_key: str, columns: dict[str, str]) -> DataFrame:
    """Left join that keeps rows whose key the dimension lacks."""
    k = free("_k", fact)
    d = dim.select(F.col(dim_key).alias(k), *[F.col(c).alias(n) for c, n in columns.items()])
    return fact.join(d, fact[fact_key] == d[k], "left").drop(k)


__all__ = ["asof_carry", "asof_lookup", "assign_keys", "calendar", "gaps", "latest_version", "lookup", "max_key", "overlaps", "same", "scd1_dimension", "scd2_apply"]
