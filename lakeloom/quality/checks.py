"""Checks over DataFrames. Each returns findings; ERROR findings make ``require`` raise.

A check that is an aggregate of one table is a ``Rule``; ``judge`` answers all rules of a table by one scan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.operators.dimension import gaps, overlaps
from lakeloom.operators.merge import missing

ERROR, WARN, INFO = "ERROR", "WARN", "INFO"


class QualityError(AssertionError):
    """A check of severity ERROR failed; it carries all findings."""

    def __init__(self, message: str, findings: Sequence[Finding] = ()):
        super().__init__(message)
        self.findings = list(findings)


@dataclass(frozen=True)
class Finding:
    check: str
    severity: str
    ok: bool
    value: float
    message: str


def require(findings: Iterable[Finding]) -> list[Finding]:
    out = list(findings)
    bad = [f for f in out if not f.ok and f.severity == ERROR]
    if bad:
        raise QualityError("; ".join(f"{f.check}: {f.message}" for f in bad), out)
    return out


@dataclass(frozen=True)
class Rule:
    """A check that is an aggregate of a table's rows, with the findings that its value makes."""

    value: Column
    findings: Callable[[Any], list[Finding]]


def judge(rows: DataFrame, *rules: Rule) -> list[Finding]:
    """Findings of the rules, in their order, from one scan."""
    found = rows.agg(*[r.value.alias(f"_{i}") for i, r in enumerate(rules)]).first()
    return [f for r, v in zip(rules, found, strict=True) for f in r.findings(v)]


def _none(check: str, n: int, what: str, severity: str = ERROR) -> Finding:
    return Finding(check, severity, n == 0, n, f"{n} {what}")


def count_equal(check: str, expected: DataFrame, held: DataFrame) -> Finding:
    a, b = expected.count(), held.count()
    return Finding(check, ERROR, a == b, b - a, f"expected {a} rows, found {b}")


def window_equal(check: str, window: DataFrame, batch: DataFrame) -> list[Finding]:
    """An increment equals its source window; an empty window is fine if the batch is empty too."""
    a, b = window.count(), batch.count()
    note = [Finding(f"{check}.empty", INFO, a > 0, a, "the increment is empty")] if a == 0 else []
    return [*note, Finding(check, ERROR, a == b, b - a, f"the window has {a} rows, the batch {b}")]


def not_empty(check: str, rows: DataFrame) -> Finding:
    return Finding(check, ERROR, not rows.isEmpty(), 0, "there are no rows")


def has_rows(check: str, least: int) -> Rule:
    return Rule(F.count(F.lit(1)), lambda n: [Finding(check, ERROR, n >= least, n, f"{n} rows, {least} at least are needed")])


def at_least(check: str, rows: DataFrame, least: int) -> Finding:
    return judge(rows, has_rows(check, least))[0]


def duplicate_keys(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, null keys among them."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def is_unique(check: str, key: Sequence[str]) -> Rule:
    """Rows less distinct keys, where a null key is a key like any other."""
    return Rule(F.count(F.lit(1)) - F.count_distinct(F.struct(*key)), lambda n: [_none(check, n, f"rows repeat a key {tuple(key)}")])


def unique(check: str, rows: DataFrame, key: Sequence[str]) -> Finding:
    return judge(rows, is_unique(check, key))[0]


def blank(columns: Sequence[str], text: Sequence[str] = ()) -> Column:
    """Null in any column, or a blank text in some."""
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns] + [F.trim(F.col(c)) == "" for c in text], F.lit(False))


def is_filled(check: str, columns: Sequence[str], text: Sequence[str] = (), severity: str = ERROR) -> Rule:
    return Rule(F.count_if(F.coalesce(blank(columns, text), F.lit(True))), lambda n: [_none(check, n, f"rows lack one of {tuple(columns)}", severity)])


def filled(check: str, rows: DataFrame, columns: Sequence[str], text: Sequence[str] = (), severity: str = ERROR) -> Finding:
    return judge(rows, is_filled(check, columns, text, severity))[0]


def references(check: str, rows: DataFrame, key: Sequence[str], parent: DataFrame, parent_key: Sequence[str], severity: str = ERROR) -> Finding:
    """Keys without a parent; null keys aren't looked up."""
    named = rows.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key]))
    return _none(check, missing(named, parent, key, parent_key).count(), "keys have no parent", severity)


def covers(check: str, expected: DataFrame, held: DataFrame, key: Sequence[str], held_key: Sequence[str] | None = None) -> Finding:
    return _none(check, missing(expected, held, key, held_key).count(), "expected keys are missing")


def no_extra(check: str, expected: DataFrame, held: DataFrame, key: Sequence[str]) -> Finding:
    return _none(check, missing(held, expected, key).count(), "keys are held that were not expected")


def content(rows: DataFrame, key: Sequence[str]) -> Column:
    """Number of rows and a sum of hashes of their keys, whatever their order."""
    return F.struct(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*key).cast("decimal(20,0)")).alias("sum"), F.sum(F.xxhash64(F.lit(1), *key).cast("decimal(20,0)")).alias("more"))


def same_keys(missing_check: str, extra_check: str, expected: DataFrame, held: DataFrame, key: Sequence[str]) -> list[Finding]:
    """``covers`` and ``no_extra`` of tables that should hold the same keys.

    Each side is read once and summed; they are joined only where the sums differ, to tell how many keys are
    missing or extra. Keys of one type are hashed alike.
    """
    a, b = (r.select(content(r, key).alias("c")).first()["c"] for r in (expected.select(*key), held.select(*key)))
    if a == b:
        return [_none(missing_check, 0, "expected keys are missing"), _none(extra_check, 0, "keys are held that were not expected")]
    return [covers(missing_check, expected, held, key), no_extra(extra_check, expected, held, key)]


def is_rare(check: str, bad: Column, limit: float = 0.01) -> Rule:
    """Any bad row warns, more than a share of them fails."""

    def told(r: Any) -> list[Finding]:
        part = r["b"] / r["n"] if r["n"] else 0.0
        return [Finding(f"{check}.any", WARN, r["b"] == 0, r["b"], f"{r['b']} rows"), Finding(check, ERROR, part <= limit, part, f"{part:.2%} of the rows, {limit:.2%} are allowed")]

    return Rule(F.struct(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("b")), told)


def share(check: str, rows: DataFrame, bad: Column, limit: float = 0.01) -> list[Finding]:
    return judge(rows, is_rare(check, bad, limit))


def always(check: str, holds: Column, severity: str = ERROR) -> Rule:
    """A condition that no row may break; unknown counts as kept."""
    return Rule(F.count_if(~F.coalesce(holds, F.lit(True))), lambda n: [_none(check, n, "rows break the invariant", severity)])


def invariant(check: str, rows: DataFrame, holds: Column, severity: str = ERROR) -> Finding:
    return judge(rows, always(check, holds, severity))[0]


def only_run(rows: DataFrame, changed: DataFrame, run_id: str, key: Sequence[str]) -> DataFrame:
    """Rows in the scope of a run: those whose key its changed rows touch."""
    return rows.join(changed.where(F.col("_load_id") == run_id).select(*key).distinct(), list(key), "left_semi")


def versions(check: str, dim: DataFrame, sk: str, bk: str, source: DataFrame | None = None) -> list[Finding]:
    """Type-2 rules: one open version a key, ends after starts, no overlap, open keys in the source."""
    open_ = dim.where("valid_to IS NULL")
    out = [
        _none(f"{check}.open", duplicate_keys(open_, [bk]).count(), "keys have several open versions"),
        invariant(f"{check}.order", dim, F.col("valid_from") <= F.col("valid_to")),
        _none(f"{check}.overlap", overlaps(dim, sk, bk).count(), "pairs of versions overlap"),
    ]
    return out if source is None else [*out, _none(f"{check}.source", missing(open_, source, [bk]).count(), "open keys are not in the source")]


def sales_rules() -> list[Rule]:
    c = F.col
    return [
        always("sales_report.boarded", c("tickets_sold") >= c("passengers_boarded")),
        always("sales_report.rate", c("boarding_rate").between(0, 1)),
        always("sales_report.revenue", c("total_revenue") >= 0),
    ]


def sales_invariants(mart: DataFrame) -> list[Finding]:
    return judge(mart, *sales_rules())


def load_rule(check: str) -> Rule:
    return always(check, F.col("avg_load_factor").between(0, 2))


def load_factors(check: str, mart: DataFrame) -> Finding:
    return judge(mart, load_rule(check))[0]


def no_gaps(check: str, dim: DataFrame, bk: str) -> Finding:
    return _none(check, gaps(dim, bk).count(), "versions don't meet the next one")
