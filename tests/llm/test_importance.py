"""Operator 13 against brute force, and its defined cases."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lakeloom.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def runs(text, n):
    w = WORD.findall((text or "").translate(LOWER))
    return len(w), [" ".join(w[i : i + k]) for i in range(len(w)) for k in range(1, n + 1) if i + k <= len(w)]


def brute(docs, target, n=1, buckets=10_000, least=20, percent=10, seed=2024):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    own = [(i, *runs(t, n)) for i, t in docs]
    s, t = Counter(bucket(f) for _, _, fs in own for f in fs), Counter(bucket(f) for x in target for f in runs(x, n)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    rows = []
    for i, words, fs in own:
        weight = sum(gain[bucket(f)] for f in fs)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), words))
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(able[: percent * len(able) // 100])}
    return Counter((*r[:4], rank.get(id(r))) for r in rows)


def result(df):
    return Counter(tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in df.collect())


def text(x):
    return x.decode() if isinstance(x, (bytes, bytearray)) else x


def test_query_like_brute_force(spark, sf_dir):
    at = sf_dir.replace("0.001", "0.01")
    docs = [(r["doc_id"], text(r["text"])) for r in spark.read.parquet(f"{at}/documents.parquet").collect()]
    target = [text(r["text"]) for r in spark.read.parquet(f"{at}/benchmark.parquet").collect()]
    assert result(importance.op13_crc_ring_resampling(spark, at)) == brute(docs, target)


@pytest.mark.parametrize("n", [1, 2, 3])
def test_longer_runs_other_buckets(spark, n):
    docs = [(i, " ".join(f"w{(i * k) % 17}" for k in range(3 * i))) for i in range(40)]
    target = ["w1 w2 w3 w4", "", None]
    got = importance.resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(t,) for t in target], "text string"), n=n, buckets=70_000, least_words=5, percent=30, seed=7)
    assert result(got) == brute(docs, target, n, 70_000, 5, 30, 7)


@given(st.text(alphabet="aB9 .éÀ 日\n", max_size=200), st.integers(1, 4), st.integers(3, 40))
@settings(max_examples=60, deadline=None)
def test_ring_in_pieces_of_any_size(value, n, piece):
    before, importance.PIECE = importance.PIECE, piece
    try:
        words, got = importance.ring(value.encode(), n, 1000)
    finally:
        importance.PIECE = before
    want_words, want = runs(value, n)
    assert words == want_words
    assert Counter(got.tolist()) == Counter(zlib.crc32(f.encode()) % 1000 for f in want)


def test_defined_cases(spark):
    words = " ".join(f"Word{i}" for i in range(30))
    docs = [(1, words), (1, words), (1, words), (2, None), (3, ""), (4, "?!"), (None, words), (5, "long " * 300_000), *[(10 + i, f"{words} {i % 3}") for i in range(30)]]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, rank string, _row int")
    target = spark.createDataFrame([("word1 word2",)], "text string")
    assert result(importance.resample(df, target)) == brute(docs, ["word1 word2"])
    drawn = importance.draw(df.where("doc_id > 9").drop("rank"), target, percent=50)
    assert drawn.columns == ["doc_id", "text", "_row", "rank"] and sorted(r["rank"] for r in drawn.collect()) == list(range(1, 16))
    none = spark.createDataFrame([], "doc_id long, text string")
    assert importance.resample(none, target).count() == 0
    assert result(importance.resample(df, target.where("false"))) == brute(docs, [])


def test_a_task_sends_one_row_a_bucket(spark):
    df = spark.createDataFrame([(i, "hot " * 50) for i in range(500)], "doc_id long, text string")
    counts = importance.bucket_counts(importance.features(df, "doc_id", 1, 10_000), 10_000)
    assert counts.sum() == 25_000 and np.count_nonzero(counts) == 1
