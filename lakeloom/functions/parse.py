"""Typing of text columns. Malformed values raise (ANSI), blank ones become null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(_col(c), F.lit(""))


def typed(c: Column | str, kind: str) -> Column:
    return blank_to_null(c).cast(kind)


def localised(c: Column | str, language: str = "ru", fallback: bool = False) -> Column:
    """Text of one language from ``{"en": ..., "ru": ...}``; with fallback, the raw value if there is none."""
    found = F.get_json_object(_col(c), f"$.{language}")
    return F.coalesce(found, _col(c)) if fallback else found


def int_array(c: Column | str) -> Column:
    """``{1,3}`` as an array; ``{}`` is the empty array."""
    parts = F.split(F.regexp_replace(_col(c), "[{}\\s]", ""), ",")
    return F.transform(F.filter(parts, lambda x: x != ""), lambda x: x.cast("int"))


def array_text(c: Column | str) -> Column:
    return F.when(_col(c).isNotNull(), F.concat(F.lit("{"), F.array_join(F.transform(_col(c), lambda x: x.cast("string")), ","), F.lit("}")))


def clock_time(c: Column | str) -> Column:
    """``HH:mm:ss`` of a time of day; anything else raises."""
    x = _col(c)
    good = x.rlike(r"^([01][0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9])?$")
    padded = F.when(F.length(x) == 5, F.concat(x, F.lit(":00"))).otherwise(x)
    return F.when(x.isNull() | good, padded).otherwise(F.raise_error(F.concat(F.lit("not a time of day: "), x)).cast("string"))


def shift_time(c: Column | str, seconds: int) -> Column:
    """A time of day moved by some seconds; it wraps at midnight."""
    p = F.split(_col(c), ":")
    s = F.pmod(p[0].cast("int") * 3600 + p[1].cast("int") * 60 + p[2].cast("int") + seconds, F.lit(86400))
    return F.format_string("%02d:%02d:%02d", (s / 3600).cast("int"), F.pmod((s / 60).cast("int"), F.lit(60)), F.pmod(s, F.lit(60)))


def interval(c: Column | str) -> Column:
    return blank_to_null(c).cast("interval hour to second")


def interval_text(c: Column | str) -> Column:
    """``HH:mm:ss``, for hashing."""
    x = _col(c).cast("interval day to second")
    s = F.extract(F.lit("DAY"), x) * 86400 + F.extract(F.lit("HOUR"), x) * 3600 + F.extract(F.lit("MINUTE"), x) * 60 + F.extract(F.lit("SECOND"), x).cast("int")
    return F.when(x.isNotNull(), F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("int"), F.pmod(F.floor(s / 60), F.lit(60)).cast("int"), F.pmod(s, F.lit(60)).cast("int")))


def hashdiff(*columns: Column | str) -> Column:
    """MD5 over attributes joined by a bar; nulls are left out."""
    return F.md5(F.concat_ws("|", *[_col(c) for c in columns]))


def ratio(a: Column, b: Column, kind: str = "decimal(5,4)") -> Column:
    """a / b rounded half up to four places, null if b is 0."""
    return F.round(a.cast("decimal(20,0)") / F.nullif(b.cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)")), 4).cast(kind)


def mean(total: Column, n: Column, kind: str = "decimal(10,2)") -> Column:
    """Sum over count with one rounding."""
    return (total.cast("decimal(26,2)") / F.nullif(n, F.lit(0)).cast("decimal(12,0)")).cast(kind)
