"""Exact dedup (operator 2): static binary-fuse filters over an immutable snapshot.

Texts are equal when identical after deleting every character of ``[\\x20\\x09-\\x0D]``. A snapshot
holds its distinct digests in buckets and one fuse filter for each bucket. The digests of a new
batch are grouped among themselves, screened by the filters, and only positives are joined with
the snapshot's exact buckets. Texts of all candidates are then compared byte by byte; a digest
that two different texts share is split.

Defined cases: null text counts as empty, so null, empty and blank texts are copies of each other.
Of equal texts the row with most code points stays, then the smallest doc_id (null last), then any
one of fully repeated rows. An empty table gives an empty result. Other columns are ignored here
and kept by ``drop_copies``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm import fuse
from lakeloom.llm.common import BROADCAST_BYTES, discard, free, join_bounded, materialise, one_of_each, read, several_texts

#: Digests of one filter, about; a filter then has about 1.2 MB.
FILTER_KEYS = 1_000_000


def normalised(text: Column | str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def digest64(text: Column) -> Column:
    return F.xxhash64(text)


@dataclass(frozen=True)
class Snapshot:
    """Immutable: distinct digests by bucket, and a filter for each bucket."""

    entries: DataFrame  # bucket int, digest long
    filters: DataFrame  # bucket int, filter binary
    buckets: int
    distinct: DataFrame  # the table behind entries


def bucket_of(digest: str, buckets: int) -> Column:
    return F.pmod(F.shiftrightunsigned(F.col(digest), 7), F.lit(buckets)).cast("int")


def build_snapshot(digests: DataFrame, filter_keys: int = FILTER_KEYS, incoming: int = 0) -> Snapshot:
    """Snapshot of the column ``digest``; the number of buckets follows the number of digests, or of those that
    will be screened if they are more, and is that of the shuffle partitions at least, so that all tasks get some."""
    distinct = materialise(digests.select("digest").distinct(), "snapshot-digests")
    least = int(digests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(least, -(-max(distinct.count(), incoming) // filter_keys))
    entries = distinct.select(bucket_of("digest", buckets).alias("bucket"), "digest")

    def build(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"bucket": part["bucket"].iloc[:1], "filter": [fuse.build(part["digest"].to_numpy())]})

    filters = materialise(entries.groupBy("bucket").applyInPandas(build, "bucket int, filter binary"), "snapshot-filters")
    return Snapshot(entries, filters, buckets, distinct)


def _positives(digests: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """bucket and digest of the distinct incoming digests that the filters let through."""

    def test(new: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(new) or not len(held):
            return new[["bucket", "digest"]].iloc[:0]
        return new[["bucket", "digest"]][fuse.contains(held["filter"].iloc[0], new["digest"].to_numpy(np.int64))]

    incoming = digests.select(bucket_of("digest", buckets).alias("bucket"), "digest")
    return incoming.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(test, "bucket int, digest long")


def screen(digests: DataFrame, snapshot: Snapshot) -> DataFrame:
    """The distinct incoming digests that the snapshot's exact buckets hold; filters first."""
    positive = _positives(digests, snapshot.filters, snapshot.buckets)
    return positive.join(snapshot.entries, ["bucket", "digest"], "left_semi").select("digest")


# a snapshot that is stored, and later batches against it


def _digests(docs: DataFrame) -> DataFrame:
    norm = normalised("text")
    return docs.select(digest64(norm).alias("digest"), F.unhex(F.sha2(norm, 256)).alias("sha"))


def store_snapshot(docs: DataFrame, path: str, filter_keys: int = FILTER_KEYS) -> None:
    """Write an immutable snapshot of the texts of ``docs``: their digests in a folder for each bucket, and a filter for each bucket.

    A folder that is there already is an error: a snapshot is never changed, a later state is another snapshot.
    """
    spark = docs.sparkSession
    distinct = materialise(_digests(docs).distinct(), "snapshot-digests")
    snapshot = build_snapshot(distinct, filter_keys)
    placed = distinct.select("digest", "sha", bucket_of("digest", snapshot.buckets).alias("bucket"))
    placed.repartition(snapshot.buckets, "bucket").write.partitionBy("bucket").parquet(f"{path}/entries")
    snapshot.filters.write.parquet(f"{path}/filters")
    spark.range(1).select(F.lit(snapshot.buckets).alias("buckets")).write.parquet(f"{path}/about")  # last: without it there is no snapshot
    discard(distinct, snapshot.filters, snapshot.distinct)


@dataclass(frozen=True)
class Screening:
    """Digests and SHA-256 of a batch that a stored snapshot holds, and the part of its entries that was read for them."""

    known: DataFrame  # digest long, sha binary
    entries: DataFrame


def screen_stored(docs: DataFrame, path: str) -> Screening:
    """Screen a batch by the filters of a stored snapshot; of its entries only buckets with positives are read."""
    spark = docs.sparkSession
    buckets = spark.read.parquet(f"{path}/about").first()["buckets"]
    batch = materialise(_digests(docs).distinct(), "batch-digests")
    filters = spark.read.schema("bucket int, filter binary").parquet(f"{path}/filters")
    positive = materialise(batch.join(_positives(batch.select("digest").distinct(), filters, buckets), "digest"), "positives")
    found = [r["bucket"] for r in positive.select("bucket").distinct().collect()]  # one number a bucket at most
    entries = spark.createDataFrame([], "digest long, sha binary")
    if found:  # their folders alone
        entries = spark.read.schema("digest long, sha binary").parquet(*[f"{path}/entries/bucket={b}" for b in sorted(found)])
    known = positive.select("digest", "sha").join(entries.select("digest", "sha"), ["digest", "sha"], "left_semi")
    discard(batch)
    return Screening(known, entries)


def drop_known(docs: DataFrame, path: str) -> DataFrame:
    """The rows of a batch whose text a stored snapshot lacks, with all their columns; copies within the batch are left to ``drop_copies``."""
    sha, theirs = free("_sha", docs), free("_known", docs)
    known = materialise(screen_stored(docs, path).known.select(F.col("sha").alias(theirs)), "known")
    there = F.broadcast(known) if known.count() * 50 <= BROADCAST_BYTES else known
    marked = docs.withColumn(sha, F.unhex(F.sha2(normalised("text"), 256)))
    return marked.join(there, marked[sha] == there[theirs], "left_anti").drop(sha)


def classify(docs: DataFrame, in_snapshot: Column | None = None, digest: Callable[[Column], Column] = digest64) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    ``in_snapshot`` tells the rows of the immutable snapshot from those of the new batch; without
    it, doc_id's hash deals the rows to both. The result doesn't depend on it.
    """
    part = in_snapshot if in_snapshot is not None else F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    texts = docs.select("doc_id", F.coalesce(part, F.lit(False)).alias("old"), normalised("text").alias("norm"), F.char_length(F.coalesce("text", F.lit(""))).alias("cp")).withColumn("digest", digest(F.col("norm")))
    rows = materialise(texts.select("doc_id", "old", "digest", F.sha2("norm", 256).alias("text_sha256"), "cp", F.monotonically_increasing_id().alias("row")), "digests")
    old, new = rows.where("old"), rows.where(~F.col("old"))
    batch = materialise(new.groupBy("digest").agg(F.count("*").alias("n")), "batch-digests")
    snapshot = build_snapshot(old, incoming=batch.count())
    held = screen(batch, snapshot)
    again = old.groupBy("digest").agg(F.count("*").alias("n")).unionByName(batch).where("n > 1").select("digest")
    candidates = materialise(held.unionByName(again).distinct(), "candidates")
    discard(batch, snapshot.filters, snapshot.distinct)
    n = candidates.count()
    copies = join_bounded(texts, candidates, ["digest"], "left_semi", n, 16)
    if not several_texts(copies, "digest", "norm").isEmpty():  # texts with one digest: SHA-256 tells them apart
        if not several_texts(copies.withColumn("sha", F.sha2("norm", 256)), "sha", "norm").isEmpty():
            raise ValueError("different texts with one SHA-256")
    marked = join_bounded(rows, candidates.withColumn("candidate", F.lit(True)), ["digest"], "left", n, 16)
    best = marked.where("candidate").groupBy("digest", "text_sha256").agg(F.max(F.struct("cp", F.bitwise_not("doc_id").alias("low"), F.bitwise_not("row").alias("r"), "doc_id", "row")).alias("best"), F.count("*").alias("size"))
    best = materialise(best.select("digest", "text_sha256", F.col("best.doc_id").alias("keep"), F.col("best.row").alias("keep_row"), "size"), "kept-rows")
    joined = join_bounded(marked, best, ["digest", "text_sha256"], "left", n, 150)
    alone = F.col("size").isNull()
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: an anti-join with those that go.

    Rows are told apart by doc_id (nulls are alike) and text; of rows that agree in both one stays,
    if any does. Columns of any name are kept as they are.
    """
    verdict = materialise(classify(docs).select("doc_id", "text_sha256", "kept"), "verdict")
    id_, sha, mine = free("_id", docs), free("_sha", docs), free("_mine", docs)
    rows = verdict.groupBy("doc_id", "text_sha256").agg(F.bool_or("kept").alias("any"), F.count(F.lit(1)).alias("n"))
    gone = materialise(rows.where(~F.col("any")).select(F.col("doc_id").alias(id_), F.col("text_sha256").alias(sha)), "gone")
    marked = docs.withColumn(mine, F.sha2(normalised("text"), 256))
    there = F.broadcast(gone) if gone.count() * 110 <= BROADCAST_BYTES else gone
    kept = marked.join(there, marked["doc_id"].eqNullSafe(gone[id_]) & (marked[mine] == gone[sha]), "left_anti")
    if not rows.where("any AND n > 1").isEmpty():  # fully repeated rows, or copies under one doc_id
        kept = _longest(kept, mine)
    return kept.drop(mine)


def _longest(docs: DataFrame, sha: str) -> DataFrame:
    """Of rows with one doc_id and digest those with most code points, then one of them."""
    length, most, digest, id_ = (free(x, docs) for x in ("_cp", "_most", "_digest", "_id"))
    sized = docs.withColumn(length, F.char_length(F.coalesce("text", F.lit(""))))
    best = sized.groupBy("doc_id", sha).agg(F.max(length).alias(most), F.count_distinct(length).alias("k")).where("k > 1")
    best = best.select(F.col("doc_id").alias(id_), F.col(sha).alias(digest), most)
    joined = sized.join(best, sized["doc_id"].eqNullSafe(best[id_]) & (sized[sha] == best[digest]), "left")
    longest = joined.where(F.col(most).isNull() | (F.col(length) == F.col(most))).drop(length, most, digest, id_)
    return one_of_each(longest, ["doc_id", sha])


def op2_fuse_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS cp,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), w AS (
  SELECT doc_id, text_sha256,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY cp DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM t
)
SELECT doc_id, keep_id, group_size, keep_id = doc_id AS kept, text_sha256 FROM w
"""
