"""Operator 12: accuracy on rows that nothing was learned from, the effect of swaps, and defined cases."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeloom.llm import toxicity


def test_held_out_rows(spark, sf_dir):
    at = sf_dir.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    out = toxicity.op12_counterfactual_toxicity(spark, at)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"] and out.count() == docs.count()
    rows = out.join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    held = [r for r in rows if r["held_out"]]
    caught = [r["predicted"] for r in held if r["toxic"]]
    wrong = [r["predicted"] for r in held if not r["toxic"]]
    assert np.mean(caught) > 0.85 and np.mean(wrong) < 0.005


INSULTS = ["idiot", "moron", "scum", "clown"]


def word(k):
    return "w" + "".join(chr(97 + int(d)) for d in str(k))


def texts(seed, n, toxic_share):
    """Insults come mostly with one group's name; other groups are named in neutral texts."""
    r, out = random.Random(seed), []
    for i in range(n):
        toxic = r.random() < toxic_share
        w = [word(r.randint(0, 200)) for _ in range(r.randint(20, 60))]
        if toxic:
            w += r.sample(INSULTS, r.randint(1, 2)) if r.random() < 0.7 else []
            w += ["muslims"] if r.random() < 0.6 else []
        elif r.random() < 0.1:
            w.append(r.choice(["christians", "jews", "muslims"]))
        r.shuffle(w)
        out.append((i, " ".join(w), int(toxic)))
    return out


def learned(spark, rows, penalty):
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    return toxicity.learn_model(df.select("doc_id", "text"), df.select("doc_id", "toxic"), F.lit(True), penalty)


def test_swaps_take_the_weight_of_identity_terms(spark):
    rows = texts(1, 900, 0.3)
    plain, even = learned(spark, rows, 0.0), learned(spark, rows, toxicity.PENALTY)
    neutral = [f"{' '.join(map(word, range(9)))} the {term} of {' '.join(map(word, range(20, 40)))}" for term in ("muslims", "christians", "jews", "believers")]
    spread = lambda m: np.ptp([np.log(s / (1 - s)) for s in map(m.score, map(str.encode, neutral))])
    assert plain.score(neutral[0].encode()) > 0.7 > even.score(neutral[0].encode())
    assert spread(even) < 0.1 * spread(plain)
    insult = neutral[1].encode() + b" moron scum"
    assert min(plain.score(insult), even.score(insult)) > 0.7
    fresh = texts(2, 600, 0.0)
    wrong = [sum(m.score(t.encode()) >= 0.7 for _, t, _ in fresh) for m in (plain, even)]
    assert wrong[0] > 5 and wrong[1] == 0


def test_swapped_bags():
    own = Counter({b"women": 2, b"gay": 1, b"x": 3})
    assert toxicity.swapped(own) == [Counter({b"men": 2, b"lesbian": 1, b"x": 3}), Counter({b"girls": 2, b"bisexual": 1, b"x": 3}), Counter({b"people": 2, b"single": 1, b"x": 3})]
    assert toxicity.swapped(Counter({b"x": 1})) == []
    assert len({w for line in toxicity.IDENTITY for w in line}) == sum(map(len, toxicity.IDENTITY))


@pytest.mark.parametrize("piece", [1, 5, 1 << 20])
def test_words_of_pieces(monkeypatch, piece):
    monkeypatch.setattr(toxicity, "_PIECE", piece)
    assert toxicity.words("Übel, ÜBEL! it's 3x x y".encode()) == Counter({"übel".encode(): 2, b"it": 1, b"s": 1, b"x": 1, "x y".encode(): 1})


def test_copies_of_a_wrong_label_teach_nothing(spark):
    rows = texts(3, 600, 0.3)
    rows += [(10_000 + i, f"wronglabel otherword {' '.join(map(word, range(50)))} end{word(i)}", 1) for i in range(120)]
    model = learned(spark, rows, toxicity.PENALTY)
    assert not {f for f in model.vocabulary.place if b"wronglabel" in f}
    assert model.score(b"wronglabel otherword wa wb wc") < 0.7


def test_defined_cases(spark):
    rows = texts(4, 300, 0.4)
    odd = [(1000, None), (1001, ""), (1002, "?!"), (None, "idiot moron scum"), (1003, "word " * 200_000 + "idiot moron scum clown " * 3000), (2000, "idiot moron"), (2000, "idiot moron")]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(*o, "x") for o in odd], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y, 0.5) for i, _, y in rows] + [(1000, None, 0.5), (None, 1, 0.5), (0, rows[0][2], 0.5), (99_999, 1, 0.5)], "doc_id long, toxic int, quality double")
    model = toxicity.learn_model(docs, labels)
    out = {(r["doc_id"], r["score"], r["predicted"]) for r in toxicity.toxicity(docs, model).collect()}
    score = {i: s for i, s, _ in out}
    assert score[1000] == score[1001] == score[1002] < 0.7
    assert score[None] > 0.7 and score[1003] > 0.7 and score[2000] > 0.7
    assert toxicity.keep_civil(docs, labels).columns == docs.columns
    assert {1000, 1001} <= {r["doc_id"] for r in toxicity.keep_civil(docs, labels).collect()}.difference({None, 1003})
    for some in (labels.where("toxic = 1"), labels.limit(0)):
        assert {r["score"] for r in toxicity.toxicity(docs, toxicity.learn_model(docs, some)).collect()} == {0.0}
    assert toxicity.toxicity(docs.limit(0), model).count() == 0


def test_sample_is_bounded_and_of_both_classes(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 10 == 0).cast("int").alias("toxic"))
    got = toxicity.sample(docs, labels, F.lit(True), 100)
    assert {(r["toxic"], r["n"]) for r in got.groupBy("toxic").agg(F.count("*").alias("n")).collect()} == {(0, 100), (1, 100)}
