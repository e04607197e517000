"""Readers of the source tables: Parquet folders and JDBC databases."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.schemas import SOURCE, source_schema

Reader = Callable[[str], DataFrame]

#: Incremental sources that have a date of their own; a booking's dates the others.
DATED = {"bookings": "book_date", "flights": "scheduled_departure"}


def parquet_source(spark: SparkSession, folder: str) -> Reader:
    return lambda name: spark.read.schema(source_schema(name)).parquet(f"{folder}/{name}.parquet")


def frames_source(frames: dict[str, DataFrame]) -> Reader:
    return lambda name: frames[name]


@dataclass(frozen=True)
class Jdbc:
    """A source database. Types without a counterpart come as text."""

    url: str
    schema: str
    properties: dict[str, str] = field(default_factory=dict)
    text_columns: dict[str, tuple[str, ...]] = field(default_factory=dict)
    splits: dict[str, tuple[str, int, int, int]] = field(default_factory=dict)
    #: Columns that are text in the staging tables and numbers in the database.
    numbers: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"flights": ("flight_id",), "segments": ("flight_id",), "boarding_passes": ("flight_id",)})

    def _dated(self, table: str) -> tuple[str, str]:
        """A table with the column that dates its rows; the database joins what a table takes from others."""
        rows, date = f"{self.schema}.{table} r", DATED.get(table)
        if date:
            return f"SELECT r.* FROM {rows}", f"r.{date}"
        ticket = "r" if table == "tickets" else "t"
        joins = "" if table == "tickets" else f" JOIN {self.schema}.tickets t ON t.ticket_no = r.ticket_no"
        return f"SELECT r.*, b.book_date FROM {rows}{joins} JOIN {self.schema}.bookings b ON b.book_ref = {ticket}.book_ref", "b.book_date"

    def options(self, table: str, newer_than: datetime | None = None, split: tuple[str, int, int, int] | None = None) -> dict[str, str]:
        """Reader options of one table. A mark goes to the database, which sends newer rows alone; ``split`` is
        (column, low, high, parts) of reads side by side."""
        own = {"url": self.url} | self.properties
        custom = self.text_columns.get(table)
        if custom:
            own["customSchema"] = ", ".join(f"{c} STRING" for c in custom)
        own["dbtable"] = f"{self.schema}.{table}"
        if newer_than:
            rows, date = self._dated(table)
            own["dbtable"] = f"({rows} WHERE {date} > {{ts '{newer_than.isoformat(sep=' ')}'}}) q"
        split = split or self.splits.get(table)
        if split:
            column, low, high, parts = split
            own |= {"partitionColumn": column, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(parts)}
        return own

    def read(self, spark: SparkSession, table: str, newer_than: datetime | None = None, split: tuple[str, int, int, int] | None = None) -> DataFrame:
        """Business columns of a table; with a mark also ``book_date``, where another table dates its rows."""
        rows = spark.read.format("jdbc").options(**self.options(table, newer_than, split)).load()
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in source_schema(table)]
        dated = [F.col("book_date").cast("timestamp_ntz").alias("book_date")] if newer_than and table not in DATED else []
        return rows.select(*columns, *dated)

    def cuts(self, spark: SparkSession, table: str, column: str, parts: int) -> list[str]:
        """Values of a column, text or number, that cut a table into parts of equal rows: the database orders and skips.

        They come from the column's own values, so that reads side by side are balanced however those are spread.
        Fewer than ``parts - 1`` come back where one value would begin several parts.
        """
        own = {"url": self.url} | self.properties
        ask = lambda sql: spark.read.format("jdbc").options(**own, query=sql).load().collect()
        where = f"FROM {self.schema}.{table} WHERE {column} IS NOT NULL"
        n = ask(f"SELECT COUNT(*) AS n {where}")[0][0]
        found = [ask(f"SELECT {column} AS k {where} ORDER BY {column} OFFSET {n * i // parts} ROWS FETCH NEXT 1 ROWS ONLY") for i in range(1, parts)] if n >= parts else []
        return list(dict.fromkeys(str(r[0][0]) for r in found if r))

    @staticmethod
    def predicates(column: str, cuts: Sequence[str], text: bool = True) -> list[str]:
        """Conditions that cut a table at values of a column: every row meets exactly one, rows without a value the first."""
        quoted = ["'" + c.replace("'", "''") + "'" if text else c for c in cuts]
        if not quoted:
            return ["1 = 1"]
        inner = [f"{column} >= {a} AND {column} < {b}" for a, b in zip(quoted, quoted[1:], strict=False)]
        return [f"{column} < {quoted[0]} OR {column} IS NULL", *inner, f"{column} >= {quoted[-1]}"]

    def part(self, spark: SparkSession, table: str, condition: str) -> tuple[DataFrame, str]:
        """The rows of a table that meet a condition on a column ``r.name``, with the column that dates them."""
        rows, date = self._dated(table)
        sql = f"({rows} WHERE {condition}) q"
        options = {k: v for k, v in self.options(table).items() if k not in ("partitionColumn", "lowerBound", "upperBound", "numPartitions")} | {"dbtable": sql}
        found = spark.read.format("jdbc").options(**options).load()
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in source_schema(table)]
        event = date.partition(".")[2]
        extra = [] if event in source_schema(table).fieldNames() else [F.col(event).cast("timestamp_ntz").alias(event)]
        return found.select(*columns, *extra), event

    def source(self, spark: SparkSession) -> JdbcSource:
        return JdbcSource(self, spark)


@dataclass(frozen=True)
class JdbcSource:
    """A reader whose increments are cut and dated by the database."""

    jdbc: Jdbc
    spark: SparkSession

    def __call__(self, name: str) -> DataFrame:
        return self.jdbc.read(self.spark, name)

    def increment(self, name: str, mark: datetime) -> DataFrame:
        return self.jdbc.read(self.spark, name, mark)


SOURCES = tuple(SOURCE)
