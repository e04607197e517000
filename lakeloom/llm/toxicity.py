"""Toxicity (operator 12): a classifier with counterfactual regularisation.

A logistic regression tells toxic texts by their words. In labelled texts that name a group of people, the
term is swapped for others of its kind and for a neutral word; the fit penalises every change of the logit
that a swap makes, by ``PENALTY`` times its square. A term that is merely often seen beside insults
so gets no weight of its own, and a neutral mention of a group isn't taken for an insult.

Features are whole words and their beginnings of three to seven characters, as languages bend their insults.
A feature's value grows with the logarithm of its count and, in equal part, of its rate, over the whole
text, lower-cased. They are chosen by the chi-square of their presence against the label: at most ``FEATURES`` of
those beyond ``CHI``, seen in ``SEEN`` different labelled texts at least. Both classes weigh the same.

The fit takes at most ``SAMPLE`` labelled rows a class, chosen by a hash of doc_id; copies of a text count
once, with the mean of their labels, and texts whose runs of three words have one least hash, as near copies mostly have, share the
weight of one: else a mislabelled text with many copies would teach its words. Sampled ids go to the scan of
the documents, so no text is shuffled; the driver gets ``FEATURES`` features and of each sampled
text the values of those it has.

Defined cases: null and empty texts get the score of a text without any feature. Repeated labels of a
doc_id count by their mean (0.5 and more: toxic), null labels not at all. Without labelled rows of both
classes every score is 0. A null doc_id is scored like any other and learned from never. Very long
texts are read whole; repeated rows score alike; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeloom.llm.common import discard, map_arrow, materialise, read, small_batches

#: Labelled rows a class that the model is fitted on; features of the model; bounds of their choice.
SAMPLE, FEATURES, CHI, SEEN = 5_000, 1024, 24.0, 4
#: Weight of a squared change of the logit by a swap; ridge; score from which a text counts as toxic.
PENALTY, RIDGE, THRESHOLD = 4.0, 0.1, 0.7
#: Characters of a word's beginnings; words that a worker's memo, or a task's partial sums, hold at most.
STEMS, MEMO = range(3, 8), 50_000

# Terms that are swapped for one another. The last of each line is the neutral word.
IDENTITY: tuple[tuple[str, ...], ...] = (
    ("women", "men", "girls", "boys", "people"),
    ("woman", "man", "girl", "boy", "person"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "religious"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "believers"),
    ("black", "white", "asian", "latino", "african", "european", "human"),
    ("gay", "lesbian", "bisexual", "straight", "transgender", "queer", "single"),
    ("immigrants", "refugees", "foreigners", "migrants", "residents"),
    ("immigrant", "refugee", "foreigner", "migrant", "resident"),
    ("deaf", "blind", "disabled", "elderly", "young", "local"),
    ("frauen", "männer", "leute"),
    ("muslime", "christen", "juden", "gläubige"),
    ("femmes", "hommes", "gens"),
    ("musulmans", "chrétiens", "juifs", "croyants"),
    ("mujeres", "hombres", "gente"),
    ("musulmanes", "cristianos", "judíos", "creyentes"),
)

_KIND = {word.encode(): tuple(w.encode() for w in line) for line in IDENTITY for word in line}
_TERMS = frozenset(_KIND)
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_PIECE = 1 << 20


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a whole text, in pieces that end between words."""
    at = 0
    while at < len(text):
        end = at + _PIECE
        while end < len(text) and (text[end] >= 128 or _LETTERS[text[end]] != 32):
            end += 1
        part = text[at:end]
        yield (part if part.isascii() else part.decode().lower().encode()).translate(_LETTERS).split()
        at = end


def words(text: bytes) -> Counter[bytes]:
    out: Counter[bytes] = Counter()
    for piece in pieces(text):
        out.update(piece)
    return out


def least(text: bytes) -> int:
    """Least hash of three neighbouring words: near copies mostly have the same one, other texts don't."""
    return min((xxhash.xxh3_64_intdigest(b" ".join(w[i : i + 3])) >> 1 for w in pieces(text) for i in range(max(1, len(w) - 2))), default=0)


def of_word(word: bytes) -> list[bytes]:
    """The features of a word: itself and its beginnings."""
    if word.isascii():
        return [b"=" + word, *[b"^" + word[:k] for k in STEMS if len(word) >= k]]
    chars = word.decode()
    return [b"=" + word, *[b"^" + chars[:k].encode() for k in STEMS if len(chars) >= k]]


def value(count: int, size: int) -> float:
    """Of a feature that a text of ``size`` words has so often."""
    return (math.log1p(count) + math.log1p(200 * count / max(size, 20))) / 2


def swapped(own: Counter[bytes]) -> list[Counter[bytes]]:
    """The text's words with all its identity terms swapped: for the next of their kind, the one after, and the neutral word."""
    found = own.keys() & _TERMS
    out: list[Counter[bytes]] = []
    for step in (1, 2, None) if found else ():
        other = Counter({w: n for w, n in own.items() if w not in found})
        for w in found:
            line = _KIND[w]
            other[line[-1] if step is None else line[(line.index(w) + step) % len(line)]] += own[w]
        if other != own and other not in out:
            out.append(other)
    return out


@dataclass
class Vocabulary:
    """Values of chosen features; a bounded memo has the places of a word's features."""

    place: dict[bytes, int]
    memo: dict[bytes, tuple[int, ...]] = field(default_factory=dict)

    def __getstate__(self):
        return {"place": self.place, "memo": {}}

    def values(self, own: Counter[bytes]) -> dict[int, float]:
        counts: dict[int, int] = defaultdict(int)
        for w, n in own.items():
            known = self.memo.get(w)
            if known is None:
                if len(self.memo) >= MEMO:
                    self.memo.clear()
                known = self.memo[w] = tuple(self.place[f] for f in of_word(w) if f in self.place)
            for k in known:
                counts[k] += n
        size = own.total()
        return {k: value(n, size) for k, n in sorted(counts.items())}


@dataclass
class Model:
    vocabulary: Vocabulary
    weights: list[float]
    bias: float | None  # None: nothing was learned

    def score(self, text: bytes) -> float:
        if self.bias is None:
            return 0.0
        z = self.bias + sum(self.weights[k] * v for k, v in self.vocabulary.values(words(text)).items())
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))


def solve(x: np.ndarray, toxic: np.ndarray, clean: np.ndarray, moves: np.ndarray, how_many: np.ndarray, penalty: float = PENALTY, ridge: float = RIDGE, steps: int = 60) -> tuple[np.ndarray, float]:
    """Weights and bias by Newton steps: rows of values with their weights as toxic and clean, and changes of values that swaps make."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    held = np.diag(np.r_[np.full(x.shape[1], ridge), 1e-6])
    held[:-1, :-1] += 2 * penalty * (moves * how_many[:, None]).T @ moves
    w = np.zeros(x1.shape[1])

    def loss(w: np.ndarray) -> float:
        z = x1 @ w
        return float(toxic @ np.logaddexp(0, -z) + clean @ np.logaddexp(0, z) + w @ held @ w / 2)

    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -700, 700)))
        gradient = x1.T @ ((toxic + clean) * p - toxic) + held @ w
        step = np.linalg.solve(x1.T @ (x1 * ((toxic + clean) * p * (1 - p))[:, None]) + held, gradient)
        size = 1.0
        while size > 1e-6 and (after := loss(w - size * step)) > now:
            size /= 2
        if size <= 1e-6:
            break
        w, gone, now = w - size * step, now - after, after
        if gone < 1e-9 * max(1.0, abs(now)):
            break
    return w[:-1], float(w[-1])


#: A labelled text: values of its features by place, the same after each swap, its label, its weight.
Row = tuple[dict[int, float], Sequence[dict[int, float]], float, float]


def fit(rows: Sequence[Row], vocabulary: Vocabulary, penalty: float = PENALTY) -> Model:
    """Model of labelled texts."""
    share = np.array([r[3] for r in rows])
    toxic = np.array([r[2] for r in rows]) * share
    n1, n0 = toxic.sum(), (share - toxic).sum()
    if not (n1 > 0 and n0 > 0):
        return Model(vocabulary, [], None)
    x = np.zeros((len(rows), len(vocabulary.place)))
    moves: dict[tuple[tuple[int, float], ...], float] = defaultdict(float)
    for k, (own, others, _, weight) in enumerate(rows):
        for at, v in own.items():
            x[k, at] = v
        for other in others:
            change = {at: other.get(at, 0.0) - own.get(at, 0.0) for at in other.keys() | own.keys()}
            moves[tuple(sorted((at, v) for at, v in change.items() if v))] += weight / len(others)
    d = np.zeros((len(moves), x.shape[1]))
    for k, move in enumerate(moves):
        for at, v in move:
            d[k, at] = v
    even = share.sum() / 2
    weights, bias = solve(x, toxic * even / n1, (share - toxic) * even / n0, d, np.array(list(moves.values())), penalty)
    return Model(vocabulary, weights.tolist(), bias)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, learn: Column, per_class: int = SAMPLE) -> DataFrame:
    """doc_id and toxic of at most ``per_class`` labelled documents of each class, by a hash of doc_id."""
    told = labels.where(learn & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    there = told.join(docs.select("doc_id"), "doc_id", "left_semi")
    low = materialise(there.select("doc_id", "toxic", F.pmod(F.xxhash64("doc_id", F.lit(12)), F.lit(1 << 40)).alias("h")), "labelled")
    n = {r["toxic"]: r["n"] for r in low.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = low.limit(0)
    for c in sorted(n):  # about twice the rows needed are sorted
        few = low.where((F.col("toxic") == c) & (F.col("h") < F.lit(int((2 * per_class + 50) * (1 << 40) / n[c]))))
        chosen = chosen.unionByName(few.orderBy("h", "doc_id").limit(per_class))
    held = materialise(chosen.drop("h"), "labelled-sample")
    discard(low)
    return held


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weight and toxic weight of the texts that have each feature, summed within a task."""
    held: dict[bytes, list[float]] = {}

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array([v[0] for v in held.values()], pa.float64()), pa.array([v[1] for v in held.values()], pa.float64())], ["feature", "a", "n"])

    for batch in batches:
        for own, toxic, share in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            for f in {f for w in own for f in of_word(w)}:
                both = held.setdefault(f, [0.0, 0.0])
                both[0] += toxic * share
                both[1] += share
            if len(held) > MEMO:
                yield out()
                held.clear()
    yield out()


def choose(once: DataFrame, n: float, n1: float) -> Vocabulary:
    """The features of labelled texts (own, toxic, share) that tell most."""
    small_batches(once.sparkSession)
    a, b = F.col("a"), F.col("n")
    chi = F.lit(n) * F.pow(a * n - b * n1, 2) / (b * (n - b) * F.lit(n1 * (n - n1)))
    seen = once.select("own", "toxic", "share").mapInArrow(_sums, "feature binary, a double, n double").groupBy("feature").agg(F.sum("a").alias("a"), F.sum("n").alias("n")).where((b >= SEEN) & (b < n - 1e-6))
    best = seen.withColumn("chi", F.round(chi, 6)).where(F.col("chi") >= CHI).orderBy(F.col("chi").desc(), "feature").limit(FEATURES).select("feature").collect()
    return Vocabulary({f: k for k, f in enumerate(sorted(bytes(r["feature"]) for r in best))})


def learn_model(docs: DataFrame, labels: DataFrame, learn: Column | None = None, penalty: float = PENALTY, per_class: int = SAMPLE) -> Model:
    """Fit on documents of the labels that ``learn`` takes."""
    chosen = sample(docs, labels, ~held_out() if learn is None else learn, per_class)  # at most 2 x per_class rows of 12 bytes
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"), "text", "toxic")

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
        own = [words(t) for t in found]
        columns = [pa.array([sorted(w) for w in own], pa.list_(pa.binary())), pa.array([[w[x] for x in sorted(w)] for w in own], pa.list_(pa.int64())), pa.array(list(map(least, found)), pa.int64())]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns], ["sha", "toxic", "own", "counts", "least"])

    bags = map_arrow(texts, count, "sha string, toxic int, own array<binary>, counts array<long>, least long")
    different = bags.groupBy("sha").agg(F.avg("toxic").alias("toxic"), *[F.first(c).alias(c) for c in ("own", "counts", "least")])
    once = materialise(different.withColumn("share", F.lit(1.0) / F.count(F.lit(1)).over(Window.partitionBy("least"))), "labelled-words")
    n, n1 = once.agg(F.sum("share"), F.sum(F.col("toxic") * F.col("share"))).first()
    if not n or not 0 < n1 < n:
        discard(chosen, once)
        return Model(Vocabulary({}), [], None)
    vocabulary = choose(once, n, n1)

    pair = np.dtype([("at", "<u2"), ("value", "<f8")])

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        bags = []
        for w, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = Counter(dict(zip(w, c, strict=True)))
            bags.append([np.array(list(vocabulary.values(x).items()), dtype=pair).tobytes() for x in (own, *swapped(own))])
        return pa.RecordBatch.from_arrays([pa.array(bags, pa.list_(pa.binary())), batch.column(2), batch.column(3), batch.column(4)], ["bags", "toxic", "share", "sha"])

    few = map_arrow(once.select("own", "counts", "toxic", "share", "sha"), cut, "bags array<binary>, toxic double, share double, sha string")
    rows = []
    for r in sorted(few.collect(), key=lambda r: r["sha"]):
        own, *others = [{int(k): float(v) for k, v in np.frombuffer(bag, pair)} for bag in r["bags"]]
        rows.append((own, others, r["toxic"], r["share"]))
    discard(chosen, once)
    return fit(rows, vocabulary, penalty)


def toxicity(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of each document, by a model."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        score = np.array([known.value.score(t or b"") for t in batch.column(2).cast(pa.binary()).to_pylist()], np.float64)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text"), run, "doc_id long, held_out boolean, score double, predicted int")


def keep_civil(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns."""
    small_batches(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(learn_model(docs, labels))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([known.value.score(t or b"") < threshold for t in batch.column(at).cast(pa.binary()).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op12_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity(docs, learn_model(docs, read(spark, sf_dir, "labels")))
