"""Target-distribution importance resampling (operator 13) by a streaming CRC ring.

Each text is scanned once. A ring keeps the running CRC-32 states of the last ``n`` starts; a word extends each of
them by a space and the word and opens a state of its own, so that after every word the ring holds the
CRC of each run of 1 to ``n`` words that ends there, without a run ever being built. A feature's
bucket is its CRC modulo ``buckets``. The scan stores the buckets of each document; counts of the corpus, weights and
scores come from those, so that no text is read twice.

The gain of a bucket compares its share in the target with its share in the corpus; a document's
weight is the sum over its features. Adding a Gumbel number made from the doc_id turns the highest
scores into a draw without replacement in proportion to exp(weight / 1000). The order is found by
a range-partitioned sort of narrow rows with the offsets of its partitions.

Defined cases: null and empty texts have no features, weight 0 and no rank. A null doc_id draws with an
empty one's hash and comes after equal scores. Equal scores go to the smaller doc_id; repeated
rows take neighbouring ranks. An empty target has t = T = 0; an empty corpus gives no rows. Very long texts are
read in pieces. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm.common import CRC32_SQL, discard, map_arrow, materialise, read, small_batches

N, BUCKETS, LEAST_WORDS, PERCENT, SEED = 1, 10_000, 20, 10, 2024

#: Lower case of A-Z; bytes that aren't of a word become spaces.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or b >= 97 and b != 127 and not 123 <= b <= 126 else 32 for b in range(256))
PIECE = 1 << 18


def word_pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a whole text, some hundred kB at a time."""
    at = 0
    while at < len(text):
        end = at + PIECE
        part = text[at:end].translate(_WORD_BYTES)
        while end < len(text) and not part.endswith(b" "):  # on to the end of the word
            part += text[end : end + 1].translate(_WORD_BYTES)
            end += 1
        yield part.split()
        at = end


def ring(text: bytes, n: int, buckets: int) -> tuple[int, np.ndarray]:
    """Number of words, and the bucket of each run of 1 to n words."""
    states: list[int] = []
    words, found = 0, []
    for piece in word_pieces(text):
        words += len(piece)
        seen: list[int] = []
        for word in piece:
            if n > 1:
                more = b" " + word
                states = [crc32(more, s) for s in states[-(n - 1) :]]
                states.append(crc32(word))
                seen += states
            else:
                seen.append(crc32(word))
        found.append(np.array(seen, np.uint32) % np.uint32(buckets))
    return words, np.concatenate(found or [np.zeros(0, np.uint32)])


def _kind(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def features(docs: DataFrame, key: str, n: int, buckets: int) -> DataFrame:
    """key, n_words and the buckets of all features, packed, of each row."""
    kind = _kind(buckets)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [ring(t or b"", n, buckets) for t in batch.column(1).cast(pa.binary()).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([w for w, _ in rows], pa.int64()), pa.array([f.astype(kind).tobytes() for _, f in rows], pa.binary())], [key, "n_words", "buckets"])

    return map_arrow(docs.select(key, "text"), run, f"{key} {docs.schema[key].dataType.simpleString()}, n_words long, buckets binary")


def bucket_counts(rows: DataFrame, buckets: int) -> np.ndarray:
    """Features in each bucket; a task sends one row a bucket, whatever it has read."""
    kind = _kind(buckets)
    small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for packed in batch.column(0).to_pylist():
                total += np.bincount(np.frombuffer(packed, kind), minlength=buckets)
        held = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], ["bucket", "n"])

    sums = rows.select("buckets").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in sums.collect():  # at most one row a bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(smoothed share in the target / smoothed share in the corpus)) of each bucket."""
    m = len(corpus)
    s_all, t_all = int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + m) / ((s + 1) * (t_all + m)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(rows: DataFrame, gain: np.ndarray, seed: int) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of stored features."""
    kind = _kind(len(gain))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        packed = [np.frombuffer(x, kind) for x in batch.column(2).to_pylist()]
        weight = np.array([int(gain[x].sum()) for x in packed], np.int64)
        score = weight + np.array([noise(i, seed) for i in batch.column(0).to_pylist()], np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array([len(x) for x in packed], np.int64)), pa.array(weight), pa.array(score)], ["doc_id", "n_words", "n_features", "weight", "score"])

    return map_arrow(rows.select("doc_id", "n_words", "buckets"), run, "doc_id long, n_words long, n_features long, weight long, score long")


def resample(docs: DataFrame, target: DataFrame, n: int = N, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank (null if not drawn), n_words of each document.

    ``target`` has a text column; ``percent`` of the documents with at least ``least_words`` words are drawn.
    """
    stored = materialise(features(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id", n, buckets), "ring-buckets")
    wanted = features(target.select(F.lit(0).alias("one"), "text"), "one", n, buckets)
    gain = gains(bucket_counts(stored, buckets), bucket_counts(wanted, buckets))
    rows = materialise(scored(stored, gain, seed).withColumn("_row", F.monotonically_increasing_id()), "weights")
    discard(stored)
    able = F.col("n_words") >= least_words
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight"), F.col("_row")]
    ordered = rows.where(able).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialise(ordered.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "score-order")
    before, total = [], 0
    for r in placed.groupBy("_part").count().orderBy("_part").collect():  # one number for each partition
        before.append((r["_part"], total))
        total += r["count"]
    drawn = percent * total // 100
    offsets = docs.sparkSession.createDataFrame(before, "_part int, _before long")
    rank = F.col("_before") + F.col("_at") + 1
    ranked = placed.join(F.broadcast(offsets), "_part").withColumn("rank", F.when(rank <= drawn, rank))
    both = ranked.select("doc_id", "n_features", "weight", "score", "rank", "n_words")
    return both.unionByName(rows.where(~able).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"), "n_words"))


def draw(docs: DataFrame, target: DataFrame, **how: int) -> DataFrame:
    """The drawn documents with all their columns and ``rank``; of rows with one doc_id and different ranks the best counts."""
    got = resample(docs, target, **how).where("rank IS NOT NULL").groupBy("doc_id").agg(F.min("rank").alias("rank"))
    return docs.join(got, "doc_id")


def op13_crc_ring_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP13_SQL = (
    f"WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents), b AS (SELECT {_WORDS} AS w FROM benchmark), dw AS (SELECT r, unnest(w) AS word FROM d), bw AS (SELECT unnest(w) AS word FROM b)"
    + ", hexed AS (SELECT word, hex(encode(word)) AS x FROM (SELECT word FROM dw UNION SELECT word FROM bw)), crc AS (SELECT word, CAST("
    + CRC32_SQL.format(bytes="list_transform(range(len(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))")
    + """ % 10000 AS BIGINT) AS bucket FROM hexed)
, s AS (SELECT bucket, count(*) AS s FROM dw JOIN crc USING (word) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM bw JOIN crc USING (word) GROUP BY bucket)
, totals AS (SELECT (SELECT count(*) FROM dw) AS ss, (SELECT count(*) FROM bw) AS tt)
, gain AS (
  SELECT k AS bucket, CAST(floor(1000 * ln(CAST((coalesce(t, 0) + 1) * (ss + 10000) AS DOUBLE) / CAST((coalesce(s, 0) + 1) * (tt + 10000) AS DOUBLE))) AS BIGINT) AS g
  FROM range(10000) k(k) CROSS JOIN totals LEFT JOIN s ON s.bucket = k LEFT JOIN t ON t.bucket = k
), sums AS (SELECT r, sum(g) AS weight FROM dw JOIN crc USING (word) JOIN gain USING (bucket) GROUP BY r)
, scored AS (
  SELECT doc_id, r, len(w) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM d LEFT JOIN sums USING (r)
), placed AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank, CAST(n_features AS BIGINT) AS n_words FROM scored LEFT JOIN placed USING (r)
"""
)
