"""Language ID (operator 10): nearest centroid over TF-IDF n-gram vectors.

Texts are lower-cased, everything but letters becomes one space, and byte n-grams of one to three
are hashed into ``BINS`` bins. Vectors are log TF times IDF, scaled to length one. Each language
has several centroids, found by spherical k-means over a bounded sample of labelled rows; the
language of the nearest centroid by cosine wins. A document is rejected if it has no letter, or
if its cosine is below its language's limit at its number of n-grams. Limits are ``MARGIN`` times
a low quantile of the cosines that pieces of a language's labelled texts, of all lengths, have with
the language's centroids; the fewer n-grams, the lower they are.

Defined cases: null text, empty text and text without a letter give ``und`` with score 0. Ties go
to the first language by name. Without any labelled row every text gets ``und``. Very long texts
are read whole. Repeated rows are predicted alike; extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeloom.llm.common import discard, join_bounded, map_arrow, materialise, read, small_batches

BINS = 4096
#: Labelled rows a language that a model is fitted on; the bound of the training sample.
SAMPLE = 300
#: Characters of a sampled text that are fitted on: so many pieces spread evenly over it. Predictions read whole texts.
FIT_CHARS, FIT_PIECES = 20_000, 10
CENTROIDS = 3
#: A text is rejected below MARGIN times this quantile of the cosines of labelled pieces with as many n-grams.
QUANTILE, MARGIN = 0.01, 0.65
#: Characters of the pieces; how many pieces about a power of two of n-grams must have to set a limit there.
PIECES, ENOUGH = [4 << k for k in range(12)], 40

_LETTER = re.compile(rb"[A-Za-z]")
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


@dataclass
class Model:
    languages: list[str]  # of each centroid
    centroids: np.ndarray  # one a row, of length 1
    idf: np.ndarray
    limits: dict[str, tuple[np.ndarray, np.ndarray]]  # log2 of n-grams and least cosine, of each language


def has_letter(text: bytes) -> bool:
    return bool(_LETTER.search(text)) or (not text.isascii() and any(map(str.isalpha, text.decode())))


def counts(text: bytes) -> np.ndarray:
    """Counts of hashed byte n-grams of the letters of a whole text."""
    if not text.isascii():
        text = text.decode().lower().encode()
    a = np.frombuffer(b" " + b" ".join(text.translate(_LETTERS).split()) + b" ", np.uint8).astype(np.int32)
    pairs = a[:-1] * 257 + a[1:]
    grams = [a + 1, pairs * 31 + 7]
    if len(a) > 2:
        grams.append((pairs[:-1] * 263 + a[2:]) * 2 + 1)
    out = np.zeros(BINS)
    for x in grams:
        out += np.bincount(((x * np.int32(40503)) >> 4) & (BINS - 1), minlength=BINS)
    return out


def vectors(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (np.log1p(tf) * idf).astype(np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-9)


def cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from points far apart; the same rows give the same centroids."""
    chosen = [0]
    nearest = x @ x[0]
    for _ in range(min(k, len(x)) - 1):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, x @ x[chosen[-1]])
    c = x[chosen]
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        c = np.stack([x[own == i].mean(0) if (own == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c


def limit(texts: list[bytes], own: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least cosine of a text by the log2 of its n-grams, from pieces of a language's texts."""
    sizes, cosines = [], []
    for chars in [*PIECES, None]:
        if chars is None:
            cut = texts
        else:
            whole = [t for t in map(bytes.decode, texts) if len(t) > chars]
            cut = [t[at : at + chars].encode() for t in whole for at in (0, (len(t) - chars) // 2)]
        tf = [counts(t) for t in cut if has_letter(t)]
        if tf:
            tf = np.stack(tf)
            sizes.append(np.log2(tf.sum(1)))
            cosines.append((vectors(tf, idf) @ own.T).max(1))
    size, cosine = np.concatenate(sizes), np.concatenate(cosines)
    at = np.round(size)
    held = [b for b in np.unique(at) if (at == b).sum() >= ENOUGH]
    if not held:
        return np.zeros(1), np.array([MARGIN * np.quantile(cosine, QUANTILE)])
    return np.array(held), np.array([MARGIN * np.quantile(cosine[at == b], QUANTILE) for b in held])


def fit(rows: list[tuple[str, bytes]], k: int = CENTROIDS) -> Model:
    """Model of (language, text) rows."""
    rows = sorted((lang, text) for lang, text in rows if has_letter(text))
    if not rows:
        return Model([], np.zeros((0, BINS), np.float32), np.ones(BINS), {})
    tf = np.stack([counts(text) for _, text in rows])
    idf = np.log((1 + len(rows)) / (1 + (tf > 0).sum(0))) + 1
    x, names = vectors(tf, idf), np.array([lang for lang, _ in rows], object)
    found = [(lang, c) for lang in sorted(set(names)) for c in cluster(x[names == lang], k)]
    limits = {lang: limit([t for name, t in rows if name == lang], np.stack([c for name, c in found if name == lang]), idf) for lang in sorted(set(names))}
    return Model([lang for lang, _ in found], np.stack([c for _, c in found]), idf, limits)


def predict(model: Model, texts: list[bytes]) -> tuple[list[str], list[float], list[bool]]:
    """Language, score (cosine) and rejection of each text."""
    langs, scores, rejected = ["und"] * len(texts), [0.0] * len(texts), [True] * len(texts)
    told = [i for i, t in enumerate(texts) if model.languages and has_letter(t)]
    for at in range(0, len(told), 128):
        part = told[at : at + 128]
        tf = np.stack([counts(texts[i]) for i in part])
        cos = vectors(tf, model.idf) @ model.centroids.T
        for i, best, n, row in zip(part, cos.argmax(1), tf.sum(1), cos, strict=True):
            langs[i] = model.languages[best]
            scores[i] = float(min(1, max(0, row[best])))
            rejected[i] = bool(row[best] < np.interp(np.log2(n), *model.limits[langs[i]]))
    return langs, scores, rejected


def spread_pieces(column: str) -> Column:
    """A text, or pieces spread evenly over a long one."""
    size, n = FIT_CHARS // FIT_PIECES, F.char_length(column)
    piece = lambda k: F.substring(F.col(column), (F.floor(k * (n - size) / (FIT_PIECES - 1)) + 1).cast("int"), F.lit(size))
    return F.when(n > FIT_CHARS, F.array_join(F.transform(F.sequence(F.lit(0), F.lit(FIT_PIECES - 1)), piece), "")).otherwise(F.col(column))


def sample(docs: DataFrame, learn: Column, per_language: int = SAMPLE) -> list[tuple[str, bytes]]:
    """At most ``per_language`` different rows of each language, chosen by a hash of doc_id and text.

    Rows that agree in language, doc_id and text count once, whatever their number, so that a
    language with any labelled row is learned. A language's count sets how low a hash must be, so
    that about twice the rows needed are sorted; of each longer text FIT_CHARS characters, in pieces
    from its beginning to its end, are fitted on, which bounds what reaches the driver.
    """
    labelled = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = labelled.select("lang", F.xxhash64("doc_id", "text").alias("h"), F.xxhash64("text", F.lit(1)).alias("h2"))
    distinct = materialise(rows.groupBy("lang", "h", "h2").agg(F.count(F.lit(1)).alias("n")).drop("n"), "labelled")
    spread = F.pmod("h", F.lit(1 << 40))
    share = materialise(distinct.groupBy("lang").agg((F.lit(float(2 * per_language + 50) * (1 << 40)) / F.count(F.lit(1))).alias("below")), "shares")
    low = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 40)), "h", "h2"))
    ids = join_bounded(distinct, share, ["lang"], "inner", share.count(), 60).where(spread < F.col("below")).withColumn("low", low).where(F.col("low") <= per_language).select("lang", "h", "h2")
    named = labelled.select("lang", "text", F.xxhash64("doc_id", "text").alias("h"), F.xxhash64("text", F.lit(1)).alias("h2"))
    held = materialise(ids, "sampled")
    chosen = join_bounded(named, held, ["lang", "h", "h2"], "left_semi", held.count(), 60)
    once = chosen.groupBy("lang", "h", "h2").agg(F.first(spread_pieces("text")).alias("text"))
    found = [(r["lang"], r["text"].encode()) for r in once.collect()]
    discard(distinct, share, held)
    return found


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame, learn: Column | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of each document."""
    spark = docs.sparkSession
    fold = ~held_out() if learn is None else learn
    model = spark.sparkContext.broadcast(fit(sample(docs, fold)))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [x or b"" for x in batch.column(2).cast(pa.binary()).to_pylist()]
        langs, scores, rejected = predict(model.value, texts)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return map_arrow(docs.select("doc_id", held_out().alias("held_out"), "text"), run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def keep_told(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language is told, with all their columns."""
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit(sample(docs, ~held_out())))
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            texts = [x or b"" for x in batch.column(at).cast(pa.binary()).to_pylist()]
            yield batch.filter(pa.array([not x for x in predict(model.value, texts)[2]], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read(spark, sf_dir, "documents"))
