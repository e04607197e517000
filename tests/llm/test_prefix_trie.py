"""Operator 11 against brute force, and its defined cases."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from lakeloom.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def conversations(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(v, key=lambda t: t[:2])] for c, v in own.items()}


def rebuilt(rows):
    own = conversations(rows)
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
    return out


def brute(paths):
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    for p in members:
        if p:
            kids[p[:-1]].add(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        own = (len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        saved[p] = own + sum(saved[k] for k in kids[p])
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items())


def result(df):
    assert df.columns == COLUMNS
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.collect())


def test_query_like_brute_force(spark, sf_dir):
    for at in (sf_dir, sf_dir.replace("0.001", "0.01")):
        rows = [tuple(x.decode() if isinstance(x, (bytes, bytearray)) else x for x in r) for r in spark.read.parquet(f"{at}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
        assert result(prefix_trie.op11_patricia_prefix_trie(spark, at)) == brute(rebuilt(rows))


@pytest.mark.parametrize(("partitions", "seed"), [(1, 1), (2, 2), (7, 3), (40, 4)])
def test_any_partitioning_like_brute_force(spark, monkeypatch, partitions, seed):
    """Copies, paths that end on others' way, branches at every depth, over borders; few children wait and pieces are small."""
    monkeypatch.setattr(prefix_trie, "PIECE", 5)
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(600), 150):
        copy = r.random() < 0.3
        turns = ["hot"] * 3 if copy else [r.choice("ab") * r.randint(0, 2) for _ in range(r.randint(1, 7))]
        rows += [(c, k, "user" if k % 2 else None, f"{t} {t} x") for k, t in enumerate(turns)]
    df = spark.createDataFrame(rows, SCHEMA)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert result(prefix_trie.prefix_trie(prefix_trie.rebuilt(df))) == brute(rebuilt(rows))
        plain = {c: tuple(t) for c, t in conversations(rows).items()}
        assert result(prefix_trie.prefix_trie(prefix_trie.turns_of(df).select("conv_id", "turns"))) == brute(plain)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def build(paths, waiting):
    """Rows of the builder for one partition, and the names that open rows ask for."""
    tree = prefix_trie.Builder(0)
    for path, c in sorted(paths):
        tree.add(path, [1] * (len(path) // prefix_trie.TURN), c)
    tree.finish()
    return tree.out


def test_children_that_wait_too_many_ask_for_a_name(spark, monkeypatch):
    turn = lambda *k: b"".join(hashlib.md5(str(x).encode()).digest() for x in k)
    paths = [(turn("x", i, j), 10 * i + j) for i in range(9) for j in range(9)]
    monkeypatch.setattr(prefix_trie, "WAITING", 3)
    rows = build(paths, 3)
    names = {r["key"] for r in rows if r["kind"] == "name"} | {r["key"] for r in rows if r["kind"] == "part"}
    asked = [r["parent_key"] for r in rows if r["kind"] == "open"]
    assert len(asked) > 9 and set(asked) <= names
    assert max(len(prefix_trie.Builder(0).stack[0].waiting), 0) == 0
    assert sum(r["kind"] in ("node", "open", "part") for r in rows) == 1 + 1 + 9 + 81


def test_defined_cases(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert prefix_trie.prefix_trie(prefix_trie.rebuilt(empty)).count() == 0
    rows = [(40, None, None, None), (40, 1, "user", "long " * 50_000), (41, 3, "user", ""), (41, 2, "user", "a b c"), (41, 2, "user", "a b c"), (None, 1, "user", "lost"), (43, 0, "user", "only"), (-1, 0, "user", "below"), (-1, 1, "user", "zero")]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", path string").withColumnRenamed("path", "digest")
    assert result(prefix_trie.prefix_trie(prefix_trie.rebuilt(df))) == brute(rebuilt(rows))


def test_turnless_conversations_end_at_the_root(spark):
    alone = [c for c in range(21, 60) if zlib.crc32(str(c).encode()) % 4 and c % 20][:5]
    rows = [(c, 0, "user", "gone") for c in alone]
    got = result(prefix_trie.prefix_trie(prefix_trie.rebuilt(spark.createDataFrame(rows, SCHEMA))))
    assert got == brute(rebuilt(rows))
    assert got == [(alone[0], 0, -1, 5, 0, 1, 0, hashlib.sha256(",".join(map(str, alone)).encode()).hexdigest())]


def test_thousands_of_copies_in_many_pieces(spark):
    rows = [(c, k, "user", "same words") for c in range(3000) for k in range(4)]
    assert result(prefix_trie.prefix_trie(prefix_trie.rebuilt(spark.createDataFrame(rows, SCHEMA)))) == brute(rebuilt(rows))
