"""Operators 1, 2, 4, 6, 9 and 10 against brute force, and their defined cases."""

import functools
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakeloom.llm import common, decontaminate, exact_dedup, fuse, language_id, line_dedup, packing, simhash, token_counts

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, digest string, bucket string, slot string"


def frame(spark, texts):
    """Documents with extra columns whose names clash; ids from 0, None for a null text."""
    return spark.createDataFrame([(i, t, "en", "s", None, "r", "d", "b", "x") for i, t in enumerate(texts)], DOCS)


ODD = [None, "", " \t\n", "a b", "a  b", "ab", "a\x0bb\x0cc\rd", "x" * 50_000, "x " * 30_000, "é", "é", "a b", " ", "日本語 text", "A b"]


# fuse filter


@given(st.sets(st.integers(-(2**63), 2**63 - 1), max_size=300))
@settings(max_examples=40, deadline=None)
def test_filter_has_no_false_negatives(keys):
    keys = np.array(sorted(keys), np.int64)
    blob = fuse.build(keys)
    assert fuse.contains(blob, keys).all()


def test_filter_is_small_and_rarely_wrong():
    r = np.random.default_rng(1)
    keys, others = r.integers(-(2**63), 2**63 - 1, 50_000), r.integers(-(2**63), 2**63 - 1, 50_000)
    blob = fuse.build(keys)
    assert fuse.contains(blob, keys).all()
    assert fuse.contains(blob, others).mean() < 0.006
    assert len(blob) < 1.4 * len(keys)


# exact dedup


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i))
    out = {}
    for norm, own in groups.items():
        keep = min(own)[1]
        for _, i in own:
            out[i] = (keep, len(own), i == keep, hashlib.sha256(norm.encode()).hexdigest())
    return out


def exact_result(df):
    return {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in df.collect()}


@pytest.mark.parametrize("split", [None, "doc_id < 9", "true", "false"])
def test_exact_dedup_like_brute_force(spark, split):
    texts = ODD + ["hot copy"] * 40 + ["hot  copy"]
    assert exact_result(exact_dedup.classify(frame(spark, texts), split and F.expr(split))) == brute_exact(enumerate(texts))


def test_exact_dedup_splits_a_digest_that_texts_share(spark):
    texts = ODD + ["hot copy"] * 5
    assert exact_result(exact_dedup.classify(frame(spark, texts), digest=lambda c: F.length(c).cast("long") % 3)) == brute_exact(enumerate(texts))


def test_exact_dedup_empty_nulls_and_repeated_rows(spark):
    assert exact_dedup.classify(frame(spark, [])).count() == 0
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, "b")], "doc_id long, text string")
    rows = exact_dedup.classify(df).collect()
    assert sorted((r["doc_id"] is None, r["keep_id"] is None, r["group_size"], r["kept"]) for r in rows) == [(False, False, 3, False), (False, False, 3, True), (True, False, 3, False), (True, True, 1, True)]
    clash = df.select("*", *[F.lit(c).alias(c) for c in ("_id", "_sha", "_mine", "_rank", "_row", "_least", "_n", "_key0", "digest", "kept")])
    kept = exact_dedup.drop_copies(clash)
    assert kept.columns == clash.columns
    assert Counter((r["doc_id"], r["text"], r["_sha"], r["_rank"]) for r in kept.collect()) == Counter([(1, "a", "_sha", "_rank"), (None, "b", "_sha", "_rank")])


def test_copies_under_one_doc_id(spark):
    """Rows are told apart by doc_id and text; of copies under one doc_id the longest stays."""
    df = spark.createDataFrame([(2, "A"), (5, "A"), (5, "B"), (5, "B "), (5, "C"), (None, "D"), (None, "D"), (7, None), (7, "")], "doc_id long, text string")
    assert Counter((r["doc_id"], r["text"]) for r in exact_dedup.drop_copies(df).collect() if r["doc_id"] != 7) == Counter([(2, "A"), (5, "B "), (5, "C"), (None, "D")])
    assert exact_dedup.drop_copies(df).where("doc_id = 7").count() == 1


@pytest.mark.parametrize("limit", [0, 1 << 30])
def test_broadcast_or_shuffle_gives_the_same(spark, monkeypatch, limit):
    """The joins of operators 1, 2, 4 and 8 shuffle where a side is not proven small."""
    for module in (common, exact_dedup, simhash, decontaminate):
        monkeypatch.setattr(module, "BROADCAST_BYTES", limit)
    texts = ODD + ["hot copy"] * 40 + ["hot  copy"]
    assert exact_result(exact_dedup.classify(frame(spark, texts))) == brute_exact(enumerate(texts))
    kept = {c for c, *_ in brute_exact(enumerate(texts)).values()}
    assert {r["doc_id"] for r in exact_dedup.drop_copies(frame(spark, texts)).collect()} == kept
    block = "\n".join(f"shared line {i}" for i in range(12))
    lines = [block, f"mine\n{block}", "x\ny", f"{block}\nx\ny"]
    assert {r["doc_id"]: (r["text"], r["n_removed"]) for r in line_dedup.dedup_passages(frame(spark, lines)).collect()} == brute_passages(list(enumerate(lines)))
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    clean = decontaminate.drop_contaminated(frame(spark, TEXTS), items, chars=60)
    assert {r["doc_id"] for r in clean.collect()} == {i for i, t in enumerate(TEXTS) if not brute_hits(t, ITEMS)[4]}
    near = [" ".join(f"w{i}" for i in range(100)), " ".join(f"w{i}" for i in range(1, 101)), "else"]
    assert {r["doc_id"] for r in simhash.keep_one(frame(spark, near)).collect()} == {0, 2}


# decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute_hits(text, items):
    w = WORD.findall(lower(text))
    hit, found = set(), set()
    for item, t in items:
        v = WORD.findall(lower(t))
        n = min(10, len(v))
        for k in range(len(v) - n + 1) if v else ():
            for i in range(len(w) - n + 1):
                if w[i : i + n] == v[k : k + n]:
                    hit |= set(range(i, i + n))
                    found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


ITEMS = [(1, "one two three four five six seven eight nine ten eleven"), (2, "Short item"), (10, "short ITEM"), (3, None), (4, "..."), (5, "été à la plage"), (6, "a a a a a a a a a a a a")]
TEXTS = [None, "", "zero ONE two, three-four five six seven eight nine ten ELEVEN twelve", "one two three four five six seven eight nine", "a short item; shortitem short item", "ÉTÉ été à la plage", "a " * 30, "one two three four five six seven eight nine ten " * 3, "short\x00item", "x" * 70_000 + " short item"]


@pytest.mark.parametrize("chars", [10**6, 60])
def test_decontamination_like_brute_force(spark, chars):
    items = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id long, text string, doc_id string")
    out = decontaminate.decontaminate(frame(spark, TEXTS), items, chars=chars).collect()
    for r in out:
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == brute_hits(TEXTS[r["doc_id"]], ITEMS), r["doc_id"]
        words = [x for a, b in [map(int, s.split(":")) for s in r["spans"].split(",") if s] for x in WORD.findall(lower(TEXTS[r["doc_id"]][a:b]))]
        assert len(words) == r["n_hit"]
    docs = frame(spark, TEXTS).unionByName(frame(spark, TEXTS[2:4])).withColumn("_id", F.lit(1)).withColumn("_digest", F.lit(2))
    rows = decontaminate.decontaminate(docs, items, chars=chars).collect()
    assert len(rows) == len(TEXTS) + 2
    clean = decontaminate.drop_contaminated(docs.limit(len(TEXTS)).where("text is not null or doc_id = 0"), items, chars=chars)
    assert clean.columns == docs.columns
    clean = decontaminate.drop_contaminated(frame(spark, TEXTS), items, chars=chars)
    assert {r["doc_id"] for r in clean.collect()} == {i for i, t in enumerate(TEXTS) if not brute_hits(t, ITEMS)[4]}
    assert clean.columns == frame(spark, []).columns


def test_windows_come_in_blocks(spark):
    """Each window is in one block with all its items, a block is bounded, and a batch builds no automaton again."""
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = defaultdict(set)
    for i, t in ITEMS:
        for w in decontaminate.windows((t or "").encode()):
            want[w].add(str(i))
    many = list(decontaminate.blocks(items, chars=60))
    assert len(many) > 2 and len({b.name for b in many}) == len(many)
    held = [(w, set(ids)) for b in many for w, ids in b.held.items()]
    assert len(held) == len(want) and dict(held) == want
    assert decontaminate.automaton(many[0]) is decontaminate.automaton(many[0])


@pytest.mark.parametrize("size", [1, 2, 3, 10])
def test_hashes_of_windows_do_not_depend_on_place(size):
    """Equal windows have one hash wherever they are, others have others, and long texts are hashed too."""
    r = np.random.default_rng(size)
    seen: dict[bytes, int] = {}
    for _ in range(60):
        w = [bytes(r.choice(list(b"ab\xc3\xa9"), r.integers(1, 4)).tolist()) for _ in range(int(r.integers(0, 400)))]
        hashes = decontaminate.window_hashes(decontaminate.word_hashes(w), size).tolist()
        assert len(hashes) == max(0, len(w) - size + 1)
        for i, h in enumerate(hashes):
            assert seen.setdefault(b" ".join(w[i : i + size]), h) == h
    assert len(set(seen.values())) == len(seen)
    long = decontaminate.window_hashes(decontaminate.word_hashes([b"word", b"x"] * 200_000), 10)
    assert len(long) == 399_991 and len(set(long.tolist())) == 2 and set(long[:2].tolist()) == set(long.tolist())


def test_blocks_look_at_their_own_documents_alone(spark, monkeypatch):
    """Of many blocks, screens leave the documents that share a window, and no others are scanned by an automaton, with few windows a screen too."""
    r = random.Random(4)
    word = lambda: f"w{r.randrange(3000)}"
    items = [(i, " ".join(word() for _ in range(r.randint(3, 60)))) for i in range(60)]
    clean = [" ".join(word() for _ in range(300)) for _ in range(150)]
    texts = [t if i % 10 else f"{t} {items[i % 60][1]}, {t}" for i, t in enumerate(clean)]
    held, bench = frame(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    want = [brute_hits(t, items) for t in texts]
    windows_ = decontaminate.Windows(bench, chars=5000)
    assert windows_.n > 5
    near = decontaminate.screened(held, windows_.screen(0, windows_.n)).collect()
    assert {x["doc_id"] for x in near} == {i for i, x in enumerate(want) if x[4]}
    assert all(set(x["blocks"]) <= set(range(windows_.n)) for x in near) and min(len(x["blocks"]) for x in near) < windows_.n
    windows_.close()
    for few in (1, 700, 10**6):
        monkeypatch.setattr(decontaminate, "SCREEN_WINDOWS", few)
        rows = decontaminate.decontaminate(held, bench, chars=20_000 if few == 1 else 5000).collect()
        assert {x["doc_id"]: (x["n_words"], x["n_hit"], x["n_items"], x["items_sha256"], x["contaminated"]) for x in rows} == dict(enumerate(want))
    assert {x["doc_id"] for x in decontaminate.drop_contaminated(held, bench, chars=5000).collect()} == {i for i, x in enumerate(want) if not x[4]}


def test_decontamination_without_items_or_documents(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r["n_hit"] for r in decontaminate.decontaminate(frame(spark, TEXTS), none).collect()} == {0}
    assert decontaminate.decontaminate(frame(spark, []), none).count() == 0


# line dedup


def test_chunks_cover_the_text_and_resist_shifts():
    lines = [f"line {i * 7919 % 1000}" for i in range(300)]
    text = "\n".join(lines).encode()
    found = line_dedup.chunks(text)
    assert b"".join(text[a:b] for _, _, a, b in found) == text
    moved = "\n".join(["new", *lines[:150], "another", *lines[150:]]).encode()
    pieces = lambda t: {t[a:b] for _, _, a, b in line_dedup.chunks(t)}
    assert len(pieces(text) & pieces(moved)) >= len(found) - 6


def brute_chunks(raw):
    """Boundaries by their definition, one line after the other, without numpy."""
    lines = raw.split(b"\n")
    if not lines[-1]:
        lines.pop()
    mask, factor = (1 << 64) - 1, 0x9E3779B97F4A7C15
    h = [int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little") for x in lines]
    out, own, at = [], [], 0
    for i, line in enumerate(lines):
        own.append(line)
        rolled = (h[i] + (h[i - 1] * factor if i else 0)) & mask
        if (len(own) >= 2 and (rolled >> 17) % 3 == 0) or i == len(lines) - 1:
            size = min(sum(len(x) + 1 for x in own), len(raw) - at)
            out.append((len(out), len(own), at, at + size))
            own, at = [], at + size
    return out


@given(st.lists(st.sampled_from(["a", "b", "", "é", "long line"]), max_size=40))
@settings(max_examples=80, deadline=None)
def test_chunks_like_their_definition(lines):
    raw = "\n".join(lines).encode()
    assert line_dedup.chunks(raw) == brute_chunks(raw)


def brute_lines(rows):
    """First places win; a chunk is its body without the last newline."""
    seen, out = set(), {}
    cut = {}
    for i, t in rows:
        raw = (t or "").encode()
        cut[i] = [(k, raw[a:b]) for _, k, a, b in brute_chunks(raw)]
    for i, t in sorted(rows, key=lambda r: r[0]):
        kept, gone = [], 0
        for k, part in cut[i]:
            body = part.removesuffix(b"\n")
            if k > 1 and body in seen:
                gone += k
            else:
                kept.append(part)
            if k > 1:
                seen.add(body)
        out[i] = ((t or "") if not gone else b"".join(kept).removesuffix(b"\n").decode(), gone)
    return out


def test_line_dedup_like_brute_force(spark):
    block = "\n".join(f"shared line {i}" for i in range(12))
    texts = [None, "", "\n", "\n\n\n", block, block, f"mine\n{block}", f"{block}\nmine", "one line", "one line", f"{block}\n{block}", *[f"own {i}\n{block}\nend {i}\n" for i in range(30)], "é\n" * 5000]
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in line_dedup.dedup_lines(frame(spark, texts)).collect()}
    assert got == brute_lines(list(enumerate(texts)))
    assert got[5] == ("", 12)
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0


def brute_passages(rows):
    """Without chunks: both lines of a pair of neighbours go where the pair has an earlier place that it doesn't overlap."""
    seen, out = {}, {}
    for i, t in rows:
        lines = (t or "").split("\n")
        lines = lines if lines[-1] else lines[:-1]
        gone = set()
        for k, pair in enumerate(zip(lines, lines[1:], strict=False)):
            place = seen.setdefault(pair, (i, k))
            if place != (i, k):
                gone |= {k, k + 1} - ({k} if place == (i, k - 1) else set())
        out[i] = ("\n".join(x for k, x in enumerate(lines) if k not in gone) if gone else t or "", len(gone))
    return out


def test_passages_like_brute_force(spark, sf_dir):
    """Every run of two or more lines goes at its later places, wherever chunks end; single lines stay."""
    r = np.random.default_rng(5)
    shared = [[f"passage {k} line {j}" for j in range(k % 6 + 2)] for k in range(24)]
    texts = [None, "", "\n\n\n", "é\n" * 5000, "a\na\na", "alone", "x\nalone\ny", "alone\n"]
    for i in range(60):
        a, b = shared[i % 24], shared[int(r.integers(24))]
        texts.append("\n".join([f"own {i}", *a, f"between {i}", f"more {i}", *b]) + "\n" * (i % 2))
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in line_dedup.dedup_passages(frame(spark, texts)).collect()}
    assert got == brute_passages(list(enumerate(texts)))
    assert got[3] == ("é\né", 4998) and got[6] == ("x\nalone\ny", 0) and got[8 + 24][0].startswith("own 24\nbetween 24\nmore 24")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    assert {r["doc_id"]: (r["text"], r["n_removed"]) for r in line_dedup.op1_chunk_line_dedup(spark, sf_dir).collect()} == brute_passages(rows)
    assert line_dedup.dedup_passages(frame(spark, [])).count() == 0


def test_passages_in_repeated_rows(spark):
    """Of rows that agree in everything one keeps its text; rows of one doc_id with other texts are rows like any other."""
    text = "a\nb\nc"
    df = spark.createDataFrame([(1, text), (1, text), (1, text), (1, "x\na\nb"), (None, text), (2, None), (2, None)], "doc_id long, text string")
    rows = Counter((r["doc_id"], r["text"], r["n_removed"]) for r in line_dedup.dedup_passages(df).collect())
    assert rows == Counter({(1, text, 0): 1, (1, "", 3): 2, (1, "x", 2): 1, (None, "", 3): 1, (2, "", 0): 2})


# token counts


def brute_tokens(v, word):
    best = [(0.0, 0)]
    for e in range(1, len(word) + 1):
        s, n = best[e - 1]
        options = [(s + token_counts.UNKNOWN, n + len(word[e - 1].encode()))]
        for b in range(e):
            if word[b:e] in v.score:
                options.append((best[b][0] + v.score[word[b:e]], best[b][1] + 1))
        best.append(max(options, key=lambda x: (x[0], -x[1])))
    return best[-1][1]


@given(st.lists(st.text("abcé▁x", max_size=12), max_size=20))
@settings(max_examples=60, deadline=None)
def test_trie_counts_like_plain_programming(words):
    v = token_counts.Vocabulary(["▁", "a", "▁a", "ab", "b", "abc", "é", "▁ab", "cab"])
    counter = token_counts.Counter(v)
    text = " ".join(words)
    assert counter.counts([text]) == [(len(text.split()), sum(brute_tokens(v, "▁" + w) for w in text.split()))]


def test_token_counts_with_bounded_tables(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "NODES", 5)
    monkeypatch.setattr(token_counts, "KEPT", 3)
    v = token_counts.Vocabulary(token_counts.pieces())
    texts = ["The quick brown fox", "", "fox quick " * 50, "日本語", "x" * 3000]
    assert token_counts.Counter(v).counts(texts) == [(len(t.split()), sum(brute_tokens(v, "▁" + w) for w in t.split())) for t in texts]


def viterbi(scores, word):
    """Tokens of the best split, by recursion over the rest of a word."""
    @functools.cache
    def best(at):
        if at == len(word):
            return 0.0, 0
        ways = [(scores[word[at:to]], 1, to) for to in range(at + 1, min(len(word), at + 20) + 1) if word[at:to] in scores]
        ways.append((token_counts.UNKNOWN, len(word[at].encode()), at + 1))
        found = [(s + best(to)[0], n + best(to)[1]) for s, n, to in ways]
        top = max(s for s, _ in found)
        return top, min(n for s, n in found if abs(s - top) < 1e-9)

    return best(0)[1]


def test_token_counts_of_whole_documents(spark, sf_dir):
    """The registered query against a Viterbi with scores computed here."""
    pieces = token_counts.pieces()
    total = math.log(sum(1 / (i + 1) for i in range(len(pieces))))
    scores = {}
    for i, p in enumerate(pieces):
        scores.setdefault(p, -math.log(i + 1) - total)
    assert max(map(len, scores)) <= 20
    known = functools.cache(lambda w: viterbi(scores, "▁" + w))
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = token_counts.op6_trie_token_counts(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        words = texts[r["doc_id"]].split()
        long = [w for w in words if len(w) > 300]
        if not long:
            assert (r["n_pretokens"], r["n_tokens"]) == (len(words), sum(map(known, words))), r["doc_id"]


def test_token_counts_defined_cases(spark):
    rows = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(frame(spark, ODD), token_counts.pieces()).collect()}
    assert rows[0] == rows[1] == rows[2] == 0 and rows[3] == rows[4] and len(rows) == len(ODD)


# packing


@given(st.lists(st.integers(1, 30), max_size=200))
@settings(max_examples=60, deadline=None)
def test_sum_of_squares_keeps_every_piece(lengths):
    where, offset = packing.sum_of_squares(np.array(lengths, np.int64), 30)
    used = defaultdict(list)
    for b, o, n in zip(where, offset, lengths, strict=True):
        used[b].append((o, n))
    for own in used.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= 30


@pytest.mark.parametrize("early", [True, False])
def test_sum_of_squares_rule(early):
    """Every placement is the cheapest one by the definition."""
    r = np.random.default_rng(3)
    size, lengths = 12, r.integers(1, 12, 150)
    where, offset = packing.sum_of_squares(lengths, size, early)
    level = {}
    cost = lambda bins: sum(n * n for g, n in Counter(size - x for x in bins.values()).items() if g)
    for b, n in zip(where, lengths, strict=True):
        options = [cost(level | {k: x + n}) for k, x in level.items() if x + n <= size]
        options += [cost(level | {"new": n})] * (early or not options)
        level[b] = level.get(b, 0) + n
        assert cost(level) == min(options)


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    json = packing.vocabulary()
    coder = Tokenizer.from_str(json)
    texts = [*ODD, "word " * 5000, "don't <|endoftext|> I'LL 12345 ÉTÉ", "a b　c\x1cd\x85e", "x<|startoftext|>y", "a~b ~ ~~ c", "~"]
    rows = packing.pack(frame(spark, texts), json, group=3).collect()
    own, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        own[r["doc_id"]].append(r)
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, t in enumerate(texts):
        ids = np.array([*coder.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        parts = sorted(own[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in parts] == list(range(len(parts)))
        assert [(r["start"], r["length"], r["ids_crc32"]) for r in parts] == [(s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for s in range(0, len(ids), 2048)]
    for places in seqs.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= 2048
    assert packing.pack(frame(spark, []), json).count() == 0


def test_packing_wastes_little(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").select((F.length("text") / 4).cast("int")).collect()
    lengths = np.sort(np.array([r[0] % 2048 + 1 for r in n] * 10))[::-1]
    where, _ = packing.sum_of_squares(lengths)
    assert where.max() + 1 <= 1.005 * -(-lengths.sum() // 2048) + 2


def test_words_like_whole_texts():
    """Words through shared texts and small tables give the tokenizer's own ids."""
    import random

    words = packing.Words(packing.vocabulary(), 40)
    r = random.Random(1)
    letters = "ab'stSTrevmldLDH~.,!:=)0 9éÉß×½ªİ\u0301\u0331\u0338Σσς<|>日 \x85"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(800)]
    texts += ["don't 'S **'s I'VE 'd'd", "Straße ÿŸ İı ſ ﬁ", "<|endoftext|>a a<|b", "<|ENDOFTEXT|>", "a " * 200]
    texts += ["H\u0331a.Σ AΣ.b E\u0301.É. A\u0344 I'S. I'M, K\u0331", "", " ", "a)'s.'s", "x=\u0338.\u0301"]
    for at in range(0, len(texts), 7):
        part = texts[at : at + 7]
        for t, ids in zip(part, words.encode(pa.array(part)), strict=True):
            assert ids.tolist() == words.coder.encode(t, add_special_tokens=False).ids, t


# language


def test_language_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")
    rows = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 100
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.97
    assert sum(r["rejected"] for r in rows) == 0
    assert all(0 <= r["score"] <= 1 for r in rows)
    held = {r["doc_id"] for r in rows}
    assert held == {i for i in range(docs.count()) if zlib.crc32(str(i).encode()) % 5 == 0}


def test_language_defined_cases(spark):
    df = frame(spark, ["the cat sat on the mat", None, "", "12 %%", "—…", "日本語", "x" * 60_000])
    rows = {r["doc_id"]: r for r in language_id.identify(df).collect()}
    assert [rows[i]["lang_pred"] for i in (1, 2, 3, 4)] == ["und"] * 4
    assert rows[5]["lang_pred"] == rows[6]["lang_pred"] == "en"
    assert rows[1]["score"] == 0
    assert {r["doc_id"] for r in language_id.keep_told(df).collect()} >= {0}
    assert not {1, 2, 3, 4} & {r["doc_id"] for r in language_id.keep_told(df).collect()}
    unlabelled = df.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language_id.identify(unlabelled).collect()} == {"und"}
    assert language_id.identify(frame(spark, [])).count() == 0


def test_language_rejects_other_texts(spark, sf_dir):
    """Foreign languages and random letters, from a few words on, are rejected; held-out documents of all lengths aren't."""
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")
    model = language_id.fit(language_id.sample(docs, ~language_id.held_out()))
    r = np.random.default_rng(4)
    words = lambda letters, n: " ".join("".join(r.choice(list(letters), r.integers(2, 10))) for _ in range(n)).encode()
    for letters in ("abcdefghijklmnopqrstuvwxyz", "bcdfghjklmnpqrstvwxz", "абвгдежзиклмнопрстуфхцчшщыэюя", "的一是不了人我在有他这为之大来以个中上们"):
        for n in (12, 40, 200, 1000):
            assert sum(language_id.predict(model, [words(letters, n) for _ in range(20)])[2]) >= 18, (letters, n)
    polish = "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa."
    russian = "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства."
    greek = "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα. Είναι προικισμένοι με λογική και συνείδηση."
    foreign = [t[:n].encode() for t in (polish, russian, greek) for n in (40, 80, 160)]
    assert all(language_id.predict(model, foreign)[2])
    clean = [t["text"].encode() for t in docs.where(language_id.held_out()).select("text").collect()]
    assert not any(language_id.predict(model, clean)[2])


def test_language_is_learned_from_the_fold_alone(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    wrong = docs.withColumn("lang", F.when(language_id.held_out(), F.lit("zz")).otherwise(F.col("lang")))
    a, b = ({r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(x).collect()} for x in (docs, wrong))
    assert a == b


def test_language_sample_of_rows_that_share_a_doc_id(spark):
    """A language whose rows all have one doc_id, or are all alike, is learned, and the sample stays bounded."""
    rows = [(7, f"the cat number {i} sat on the mat", "en") for i in range(900)] + [(7, "le chat noir dort sur le lit", "fr")] * 900 + [(None, f"der Hund {i} schläft", "de") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("h", F.lit("x"))
    found = Counter(lang for lang, _ in language_id.sample(df, F.lit(True)))
    assert 250 <= found["en"] <= 300 and found["fr"] == 1 and found["de"] == 5
    long = spark.createDataFrame([(1, "ab " * 50_000, "en")], "doc_id long, text string, lang string")
    assert len(language_id.sample(long, F.lit(True))[0][1]) == language_id.FIT_CHARS


def test_language_predictions_like_brute_force(spark, sf_dir):
    """Bins, vectors, nearest centroid and rejection, written out for one text at a time."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language_id.fit(language_id.sample(docs, ~language_id.held_out()))
    got = {r["doc_id"]: r for r in language_id.identify(docs).collect()}

    def wrapped(x):
        return (x + 2**31) % 2**32 - 2**31

    for r in docs.collect()[:60]:
        text = (r["text"] or "").lower() if not (r["text"] or "").isascii() else r["text"]
        raw = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in text.encode())
        raw = b" " + b" ".join(raw.split()) + b" "
        tf = Counter()
        for n in (1, 2, 3):
            for i in range(len(raw) - n + 1):
                g = raw[i : i + n]
                pair = g[0] * 257 + g[1] if n > 1 else 0
                x = (g[0] + 1, pair * 31 + 7, (pair * 263 + g[-1]) * 2 + 1)[n - 1]
                tf[(wrapped(wrapped(x) * 40503) >> 4) & 4095] += 1
        v = {b: math.log1p(c) * model.idf[b] for b, c in tf.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        cosines = [sum(x * c[b] for b, x in v.items()) / norm for c in model.centroids]
        best = max(range(len(cosines)), key=cosines.__getitem__)
        row = got[r["doc_id"]]
        assert row["lang_pred"] == model.languages[best] and abs(row["score"] - min(1, max(0, cosines[best]))) < 1e-4
        sizes, limits = model.limits[row["lang_pred"]]
        limit = np.interp(math.log2(sum(tf.values())), sizes, limits)
        assert row["rejected"] == (cosines[best] < limit) or abs(cosines[best] - limit) < 1e-5


def test_a_tokenizer_that_does_not_work_by_words_gets_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = ["Hello  World, it's 42!\n New line", "", "ÀB  c", "tabs\tand   spaces "]
    for name, by_words in (("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)):
        json = packing.vocabulary(public_tokenizers.path(name))
        assert packing.works_by_words(json) is by_words
        got = packing.Words(json).encode(pa.array(texts))
        assert [x.tolist() for x in got] == [Tokenizer.from_str(json).encode(t, add_special_tokens=False).ids for t in texts]


def test_vocabularies_that_begin_alike_are_told_apart(spark):
    start = [f"a{i}" for i in range(100)]
    counts = lambda *last: token_counts.count_tokens(frame(spark, ["xyz"]), [*start, *last, *"xyz▁"]).first()["n_tokens"]
    assert [counts("▁xyz"), counts("▁xy"), counts("▁xyz")] == [1, 2, 1]


def test_pieces_of_a_long_text_are_spread(spark):
    long = "".join(chr(97 + i // 10_000) for i in range(200_000))
    df = spark.createDataFrame([("short",), (long,), (None,)], "text string").select(language_id.spread_pieces("text").alias("p"))
    short, spread, none = [r["p"] for r in df.collect()]
    assert (short, none) == ("short", None) and spread.startswith("aa") and spread.endswith("tt") and len(set(spread)) > 9 and len(spread) == language_id.FIT_CHARS


def test_a_batch_against_a_stored_snapshot(spark, tmp_path):
    """Texts that an earlier batch stored are found by the filters and few buckets; the snapshot isn't changed or written twice."""
    path = f"file://{tmp_path}/snapshot"
    old = [f"text number {i}" for i in range(3000)] + ["", "same\ttext", "same text"]
    exact_dedup.store_snapshot(frame(spark, old), path, filter_keys=50)
    buckets = spark.read.parquet(f"{path}/about").first()["buckets"]
    assert buckets >= 60
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        exact_dedup.store_snapshot(frame(spark, ["x"]), path)
    new = ["text  number 17", "text number 17", "sametext", None, "new", "new", "text number 9999"]
    batch = frame(spark, new).withColumn("_sha", F.lit("mine"))
    got = exact_dedup.screen_stored(batch, path)
    read = {f.rsplit("bucket=", 1)[1].split("/")[0] for f in got.entries.inputFiles()}
    assert 1 <= len(read) <= 6 < buckets and got.known.count() == 3
    left = exact_dedup.drop_known(batch, path)
    assert left.columns == batch.columns and sorted(r["text"] for r in left.collect()) == ["new", "new", "text number 9999"]
    assert sorted(r["text"] for r in exact_dedup.drop_copies(left).collect()) == ["new", "text number 9999"]
    assert exact_dedup.drop_known(batch.limit(0), path).count() == 0
    none = f"file://{tmp_path}/none"
    exact_dedup.store_snapshot(frame(spark, []), none)
    assert exact_dedup.drop_known(batch, none).count() == len(new)
