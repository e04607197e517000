"""Session and run context. A run context is the only source of "now" in a load."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def session(name: str = "lakeloom", master: str | None = None, **more: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    return builder.config(map=SETTINGS | more).getOrCreate()


@dataclass(frozen=True)
class Run:
    """One load: its id, its moment and its day. All rows of a task share the moment."""

    run_id: str
    run_ts: datetime
    run_date: date | None = None

    @property
    def day(self) -> date:
        return self.run_date or self.run_ts.date()

    def ts(self) -> Column:
        return F.lit(self.run_ts.isoformat(sep=" ")).cast("timestamp_ntz")

    def id(self) -> Column:
        return F.lit(self.run_id)

    def date(self) -> Column:
        return F.lit(self.day.isoformat()).cast("date")


def setting(spark: SparkSession, name: str, default: str | None = None) -> str | None:
    """A setting of the session, or the default where it isn't set: no error, as an unset one is usual."""
    found = spark.conf.get(name, None)
    return default if found is None else found


def templated(spark: SparkSession, text: str, run: Run, frames: dict[str, DataFrame] | None = None, **args: object) -> DataFrame:
    """SQL of a load, with the run's id, moment and day as ``:run_id``, ``:run_ts`` and ``:run_date`` and more arguments by name.

    Arguments are values, never text of the statement; frames stand in braces by name.
    """
    return spark.sql(text, args={"run_id": run.run_id, "run_ts": run.run_ts, "run_date": run.day} | args, **(frames or {}))
