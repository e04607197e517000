"""Benchmark decontamination (operator 4): one Aho-Corasick automaton over test items.

A-Z are lower-cased and words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. A window is ten consecutive
words of an item, or all of a shorter one. The automaton holds each distinct window once, between
spaces; the words of a document, joined by spaces, run through it once. Hits are mapped back to
code points of the original text.

Windows are cut, grouped and measured by Spark. The driver takes them block by block, and a block has about
``BLOCK_CHARS`` characters. One block, the usual case, is one automaton over one scan. Of
more, the documents are scanned once for each ``SCREEN_WINDOWS`` windows, by 64-bit hashes of those: a document that
shares one goes on, whole, with the numbers of the blocks that hold it, and only those blocks' automata
run over it. A hash decides nothing but that. Hit documents' rows are merged by doc_id and a digest of the
text; a task belongs to one block, so a worker builds an automaton once, not once for each batch.

Defined cases: null and empty texts have no words and no hits; items without words are never
found; equal items all count; a null item_id counts as the empty string. Repeated documents get
equal rows. Without benchmark items nothing is hit. Extra columns are ignored, and kept by
``drop_contaminated``.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm.common import BROADCAST_BYTES, discard, free, map_arrow, materialise, read, small_batches

WINDOW = 10
#: Characters of windows in one automaton; it needs about 60 bytes for each.
BLOCK_CHARS = 4_000_000
#: Windows of one screen: a hash and a block's number, 12 bytes, for each; about 25 MB of benchmark text.
SCREEN_WINDOWS = 4_000_000

#: Same length as the text: lower-case words stay, all else becomes a space.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


def windows(text: bytes, size: int = WINDOW) -> list[bytes]:
    w = words(text)
    return [b" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []


_BASE = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(w: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` words, from the words' hashes."""
    n = max(0, len(hashes) - size + 1) if size else 0
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out = out * _BASE + hashes[j : j + n]
    return out


@dataclass(frozen=True)
class Screen:
    """Sorted hashes of windows and the numbers of their blocks, by the windows' words."""

    held: dict[int, tuple[np.ndarray, np.ndarray]]

    def blocks(self, w: list[bytes]) -> list[int]:
        """Numbers of the blocks that may hold a window of a text: of all that do, and hardly any other."""
        found: set[int] = set()
        own = word_hashes(w)
        for size, (hashes, numbers) in self.held.items():
            mine = np.unique(window_hashes(own, size))
            lo, hi = np.searchsorted(hashes, mine), np.searchsorted(hashes, mine, "right")
            for a, b in zip(lo[lo < hi].tolist(), hi[lo < hi].tolist(), strict=True):
                found.update(numbers[a:b].tolist())
        return sorted(found)


@dataclass(frozen=True)
class Block:
    """Windows, with the items that have them, of one automaton; broadcast under a name of its own."""

    name: str
    held: dict[bytes, list[str]]


_BUILT: dict[str, ahocorasick.Automaton] = {}


def automaton(block: Block) -> ahocorasick.Automaton | None:
    """The automaton of a block; a worker keeps the last one."""
    if not block.held:
        return None
    if block.name not in _BUILT:
        _BUILT.clear()
        a = ahocorasick.Automaton()
        for w, own in block.held.items():
            a.add_word(f" {w.decode('latin-1')} ", (w.count(b" ") + 1, own))
        a.make_automaton()
        _BUILT[block.name] = a
    return _BUILT[block.name]


def item_windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """window (binary), its words and hash, and the ids of the items that have it, as sorted strings; a row for each distinct window."""
    ids = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id"), "text")

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, found, counts, hashes = [], [], [], []
        for name, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            w = words(text or b"")
            n = min(size, len(w))
            own = dict(zip(windows(text or b"", size), window_hashes(word_hashes(w), n).view(np.int64).tolist(), strict=True))
            names += [name] * len(own)
            counts += [n] * len(own)
            found += own.keys()
            hashes += own.values()
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(found, pa.binary()), pa.array(counts, pa.int32()), pa.array(hashes, pa.int64())], ["id", "window", "words", "hash"])

    each = map_arrow(ids, cut, "id string, window binary, words int, hash long")
    return each.groupBy("window", "words", "hash").agg(F.array_sort(F.collect_set("id")).alias("ids"))


class Windows:
    """The windows of all items, written once, in ``n`` blocks of about ``chars`` characters of windows and ids."""

    def __init__(self, items: DataFrame, size: int = WINDOW, chars: int = BLOCK_CHARS):
        self.rows = materialise(item_windows(items, size), "windows")
        total = self.rows.agg(F.sum(F.length("window") + 2 + F.aggregate("ids", F.lit(0), lambda a, x: a + F.length(x))), F.count(F.lit(1))).first()
        self.n = max(1, -(-int(total[0] or 0) // chars))
        self.at_once = max(1, SCREEN_WINDOWS * self.n // max(1, total[1]))  # blocks of one screen

    def _number(self) -> Column:
        return F.pmod(F.xxhash64("window"), F.lit(self.n)).cast("int")

    def block(self, k: int) -> Block:
        rows = self.rows.where(self._number() == k).select("window", "ids").collect()
        return Block(uuid.uuid4().hex, {bytes(r["window"]): r["ids"] for r in rows})

    def screen(self, first: int, last: int) -> Screen:
        """Of the blocks from ``first`` to ``last``, exclusive: bounded by ``SCREEN_WINDOWS``."""
        found = self.rows.select("words", "hash", self._number().alias("k")).where(F.col("k").between(first, last - 1)).toArrow()
        size, hashes, numbers = (found.column(i).to_numpy() for i in range(3))
        held = {}
        for n in np.unique(size).tolist():
            mine = hashes[size == n].view(np.uint64)
            order = np.argsort(mine)
            held[n] = mine[order], numbers[size == n][order]
        return Screen(held)

    def close(self) -> None:
        discard(self.rows)


def blocks(items: DataFrame, size: int = WINDOW, chars: int = BLOCK_CHARS) -> Iterator[Block]:
    """The windows block by block; the driver holds one at a time."""
    held = Windows(items, size, chars)
    yield from map(held.block, range(held.n))
    held.close()


def scan(a: ahocorasick.Automaton | None, text: bytes) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Number of words, runs of hit words (from, to) and items found."""
    w = words(text)
    if a is None or not w:
        return len(w), [], set()
    line = (b" " + b" ".join(w) + b" ").decode("latin-1")
    found = list(a.iter(line))
    if not found:
        return len(w), [], set()
    gaps = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
    ends = np.searchsorted(gaps, [end for end, _ in found]).tolist()
    items = {x for _, (_, own) in found for x in own}
    return len(w), merged([(end - n, end) for end, (_, (n, _)) in zip(ends, found, strict=True)]), items


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def spans(text: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of words as code points of the original text, end exclusive."""
    if not runs:
        return []
    word = np.frombuffer(text.translate(_WORD_BYTES), np.uint8) != 32
    edge = np.diff(np.concatenate([[0], word.view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    points = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    return [(int(points[starts[a]]), int(points[ends[b - 1]])) for a, b in runs]


def _row(n: int, text: bytes, runs: list[tuple[int, int]], items: Iterable[str]) -> tuple:
    names = sorted(set(items))
    hit = sum(b - a for a, b in runs)
    return n, hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), hit > 0, ",".join(f"{a}:{b}" for a, b in spans(text, runs))


FIELDS = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans string"
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string()]
_NAMES = [x.split()[0] for x in FIELDS.split(", ")]


def _scan_one(docs: DataFrame, block: Block) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, rows = automaton(shared.value), []
        for text in (x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()):
            n, runs, items = scan(a, text)
            rows.append(_row(n, text, runs, items))
        columns = list(zip(*rows, strict=True)) or [[]] * len(_TYPES)
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True))], ["doc_id", *_NAMES])

    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id long, {FIELDS}")


_HITS = "doc_id long, digest string, starts array<int>, stops array<int>, items array<string>"


def hit_rows(docs: DataFrame, block: Block) -> DataFrame:
    """doc_id, digest of the text, runs of hit words and items, of the documents that a block hits."""
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, at, rows = automaton(shared.value), [], []
        for i, text in enumerate(batch.column(2).cast(pa.binary()).to_pylist()):
            _, runs, items = scan(a, text or b"")
            if runs:
                at.append(i)
                rows.append(([x for x, _ in runs], [y for _, y in runs], sorted(items)))
        columns = list(zip(*rows, strict=True)) or [[]] * 3
        types = [pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string())]
        own = pa.array(at, pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["doc_id", "digest", "starts", "stops", "items"])

    return map_arrow(docs.select("doc_id", _digest().alias("digest"), "text"), run, _HITS)


def _digest() -> Column:
    return F.md5(F.coalesce("text", F.lit("")))


def screened(docs: DataFrame, screen: Screen) -> DataFrame:
    """doc_id, text and the numbers of the blocks to look at, of the documents that share a hash with a screen."""
    shared = docs.sparkSession.sparkContext.broadcast(screen)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        numbers = [shared.value.blocks(words(x or b"")) for x in batch.column(1).cast(pa.binary()).to_pylist()]
        own = pa.array([i for i, k in enumerate(numbers) if k], pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), pa.array([k for k in numbers if k], pa.list_(pa.int32()))], ["doc_id", "text", "blocks"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, text string, blocks array<int>")


def all_hits(docs: DataFrame, held: Windows) -> DataFrame:
    """The hit rows of all blocks, a row for each hit doc_id and text. What the screens leave is written, and each block
    is looked for in its own documents of those."""
    found = []
    for first in range(0, held.n, held.at_once):
        last = min(held.n, first + held.at_once)
        near = materialise(screened(docs, held.screen(first, last)), "screened")
        there = [r["k"] for r in near.select(F.explode("blocks").alias("k")).distinct().collect()]
        found += [materialise(hit_rows(near.where(F.array_contains("blocks", k)), held.block(k)), "hits") for k in sorted(there)]
        discard(near)
    rows = reduce(DataFrame.unionByName, found, docs.sparkSession.createDataFrame([], _HITS))
    flat = lambda c: F.flatten(F.collect_list(c)).alias(c)  # noqa: E731 - a document has one row for each block, and for each repeated row
    once = rows.groupBy("doc_id", "digest", "starts", "stops", "items").agg(F.count(F.lit(1)).alias("n")).drop("n")
    hits = materialise(once.groupBy("doc_id", "digest").agg(flat("starts"), flat("stops"), flat("items")), "merged-hits")
    discard(*found)
    return hits


def _scan_many(docs: DataFrame, held: Windows) -> DataFrame:
    hits = all_hits(docs, held)
    there = hits.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), "starts", "stops", "items")
    mine = docs.select("doc_id", "text", _digest().alias("digest"))
    size = hits.agg(F.sum(80 + 8 * F.size("starts") + 40 * F.size("items"))).first()[0] or 0
    joined = mine.join(F.broadcast(there) if size <= BROADCAST_BYTES else there, mine["doc_id"].eqNullSafe(there["_id"]) & (mine["digest"] == there["_digest"]), "left")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text, starts, stops, items in zip(batch.column(1).cast(pa.binary()).to_pylist(), *(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
            text = text or b""
            rows.append(_row(len(words(text)), text, merged(list(zip(starts or (), stops or (), strict=True))), items or ()))
        columns = list(zip(*rows, strict=True)) or [[]] * len(_TYPES)
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True))], ["doc_id", *_NAMES])

    return map_arrow(joined.select("doc_id", "text", "starts", "stops", "items"), run, f"doc_id long, {FIELDS}")


def decontaminate(docs: DataFrame, items: DataFrame, size: int = WINDOW, chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and spans of each document."""
    held = Windows(items, size, chars)
    out = _scan_one(docs, held.block(0)) if held.n == 1 else _scan_many(docs, held)
    held.close()
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, size: int = WINDOW, chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` without any hit, with all their columns."""
    held = Windows(items, size, chars)
    if held.n > 1:
        id_, digest, mine = free("_id", docs), free("_digest", docs), free("_mine", docs)
        hits = all_hits(docs, held).select(F.col("doc_id").alias(id_), F.col("digest").alias(digest))
        held.close()
        marked = docs.withColumn(mine, _digest())
        there = F.broadcast(hits) if hits.count() * 80 <= BROADCAST_BYTES else hits
        return marked.join(there, marked["doc_id"].eqNullSafe(hits[id_]) & (marked[mine] == hits[digest]), "left_anti").drop(mine)
    first = held.block(0)
    held.close()
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(first)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            a = automaton(shared.value)
            clean = [not scan(a, x or b"")[1] for x in batch.column(at).cast(pa.binary()).to_pylist()]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op4_automaton_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("spans")


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM bw), dw AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
), hits AS (
  SELECT DISTINCT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g
), dh AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit, min(p) AS first_word FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
), its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(dh.n_hit, 0) AS n_hit, coalesce(its.n_items, 0) AS n_items,
       sha256(coalesce(its.names, '')) AS items_sha256, coalesce(dh.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN dh USING (doc_id) LEFT JOIN its USING (doc_id)
"""
