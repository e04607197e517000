"""Sharding (operator 3): Hilbert-curve order over several metadata dimensions, cut into runs.

Source, language, size (log scale) and doc_id are quantised to ``BITS`` bits each between their
least and greatest values; strings count by the bytes after the prefix that all share. Rows are
sorted by the Hilbert index of their cell (then doc_id, then text) and cut into runs of equal
row counts, so that a file covers a compact box in all dimensions and min/max statistics prune it.

The law is ``rows``: shard sizes differ by one row at most. Ranks come from a range-partitioned
sort and the row counts of its partitions; only those counts reach the driver, so one hot source
or one hot cell is cut like any other run.

Defined cases: null in any dimension counts as that dimension's least value; null text has no
bytes (size 8, CRC 0). Rows that agree in everything get neighbouring slots in any order. An empty
table gives no rows; with fewer rows than shards some shards are empty.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from lakeloom.llm.common import materialise, read

SHARDS = 24
BITS = 8


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Index along the Hilbert curve of integer points, one a row, in [0, 2**bits) each."""
    x = np.array(cells, np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo excess work, from the highest bit
        low = q - 1
        for i in range(n):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[n - 1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= turn
    index = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            index = index << 1 | (x[i] >> b & 1)
    return index


def _string_key(column: str, prefix: int) -> Column:
    """Order-preserving number of the seven bytes after a prefix."""
    part = F.hex(F.substring(F.encode(F.col(column), "UTF-8"), prefix + 1, 7))
    return F.conv(F.rpad(part, 14, "0"), 16, 10).cast("double")


def _common_prefix(a: str | None, b: str | None) -> int:
    x, y = (a or "").encode(), (b or "").encode()
    return next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))


def cells(docs: DataFrame, strings: list[str], numbers: dict[str, Column], bits: int = BITS) -> DataFrame:
    """Columns ``_q0``, ``_q1`` ... with the quantised dimensions; two small aggregations find their ranges."""
    ends = docs.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in strings for f in (F.min, F.max)]).first() if strings else {}
    keys = {c: _string_key(c, _common_prefix(ends[f"min_{c}"], ends[f"max_{c}"])) for c in strings} | numbers
    span = docs.agg(*[f(k).cast("double").alias(f"{f.__name__}_{c}") for c, k in keys.items() for f in (F.min, F.max)]).first()
    out = docs
    for i, (c, k) in enumerate(keys.items()):
        low, high = span[f"min_{c}"], span[f"max_{c}"]
        width = (high - low) if low is not None and high > low else 1.0
        scaled = F.floor((k.cast("double") - F.lit(low if low is not None else 0.0)) / F.lit(width) * F.lit(float((1 << bits) - 1)))
        out = out.withColumn(f"_q{i}", F.coalesce(F.greatest(F.lit(0), F.least(scaled, F.lit((1 << bits) - 1))), F.lit(0)).cast("int"))
    return out


def curve(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """``docs`` with the column ``_curve``."""

    @pandas_udf("long")
    def along(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.stack([a, b, c, d], 1), bits))

    size = F.octet_length(F.coalesce("text", F.lit("")))
    quantised = cells(docs, ["source", "lang"], {"size": F.log2(size + 1.0), "doc_id": F.col("doc_id")}, bits)
    return quantised.withColumn("_curve", along("_q0", "_q1", "_q2", "_q3")).drop("_q0", "_q1", "_q2", "_q3")


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, curve of each document."""
    text = F.coalesce("text", F.lit(""))
    rows = curve(docs.select("doc_id", "source", "lang", "text")).select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.col("_curve").alias("curve"))
    order = ["curve", "doc_id", "text_crc32", "size"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ranked = materialise(ordered.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "curve-order")
    counts = ranked.groupBy("_part").count().orderBy("_part").collect()  # one number for each partition
    before, n = [], 0
    for r in counts:
        before.append((r["_part"], n))
        n += r["count"]
    offsets = docs.sparkSession.createDataFrame(before, "_part int, _before long")
    rank = ranked.join(F.broadcast(offsets), "_part").withColumn("_rank", F.col("_before") + F.col("_at"))
    placed = rank.withColumn("shard", F.expr(f"_rank * {shards} div {max(n, 1)}").cast("int"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("_rank") - F.expr(f"(cast(shard as long) * {n} + {shards - 1}) div {shards}")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve")


def write_ordered(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Write whole documents as about ``shards`` files in curve order."""
    curve(docs).repartitionByRange(shards, "_curve", "doc_id").sortWithinPartitions("_curve", "doc_id").drop("_curve").write.parquet(path)


def op3_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(read(spark, sf_dir, "documents"))
