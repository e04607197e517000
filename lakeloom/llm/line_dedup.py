"""Line dedup (operator 1): content-defined chunks of lines.

Lines are hashed; a rolling hash over ``SPAN`` line hashes ends a chunk where it is a multiple of
``MODULUS``, once the chunk has two lines, so that inserted or deleted lines move boundaries only
nearby. A chunk of two or more lines that occurs again anywhere, in the same document too, is
removed everywhere but at its first place (smallest doc_id, null last; then position), after its
bytes were compared.

Chunks miss passages that don't fill one. The smallest level is therefore every window of two
lines, whatever chunks they are in: both lines go wherever the same window, compared by its bytes,
has an earlier place. Any passage of two or more lines consists of windows, so it goes at every
later place and no boundary matters. Windows inside a removed chunk have an earlier place for sure
and aren't counted again; chunks take most of the copies with one row for each.

The table that is kept holds for each document the list of its chunks and a 64-bit key for each
window; digests and keys are counted from the lists alone, and texts are read again, from where
they are, for documents with repeated chunks or windows. Keys only screen: windows are the same by
128-bit digests. Rows are named by a hash of doc_id and text; only where two rows have one name, as repeated rows
do, the documents are written once more with numbers.

Defined cases: null and empty texts have no lines and stay empty; a text whose lines are all
removed becomes empty. Lines end at ``\\n``. A line that is repeated alone, without a neighbour,
is never removed; the first place of every line stays. Of a line repeated in a row the first two
stay. Repeated rows are copies of each other: the first keeps its text. Other columns are ignored.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm.common import discard, join_bounded, map_arrow, materialise, read, several_texts

SPAN = 2
MODULUS = 3
_A = 0x9E3779B97F4A7C15

_CHUNK = pa.struct([("no", pa.int32()), ("lines", pa.int32()), ("start", pa.int64()), ("stop", pa.int64()), ("digest", pa.binary())])
CHUNKS = "array<struct<no:int,lines:int,start:bigint,stop:bigint,digest:binary>>"


def lines_of(text: bytes) -> list[bytes]:
    """Lines without their newlines; one at the end of the text starts no further line."""
    lines = text.split(b"\n")
    if not lines[-1]:
        lines.pop()
    return lines


def _hashes(lines: list[bytes]) -> np.ndarray:
    return np.array([int.from_bytes(blake2b(x, digest_size=8).digest(), "little") for x in lines], np.uint64)


def _keys(h: np.ndarray) -> np.ndarray:
    """A key of each window of two lines, by the hashes of the lines."""
    with np.errstate(over="ignore"):
        return (h[:-1] * np.uint64(_A) + h[1:]).view(np.int64)


def chunks(text: bytes, span: int = SPAN, modulus: int = MODULUS) -> list[tuple[int, int, int, int]]:
    """(number, lines, start, stop) of each chunk, in bytes; a chunk has its last line's newline."""
    lines = lines_of(text)
    return _chunks(len(text), lines, _hashes(lines), span, modulus)


def _chunks(size: int, lines: list[bytes], h: np.ndarray, span: int = SPAN, modulus: int = MODULUS) -> list[tuple[int, int, int, int]]:
    rolled, power = np.zeros_like(h), np.uint64(1)
    with np.errstate(over="ignore"):
        for k in range(min(span, len(h))):
            rolled[k:] += h[: len(h) - k] * power
            power *= np.uint64(_A)
    ends = ((rolled >> np.uint64(17)) % np.uint64(modulus) == 0).tolist()
    stops = (np.cumsum([len(x) + 1 for x in lines])).tolist()
    out, first, start = [], 0, 0
    for i, end in enumerate(ends):
        if (end and i - first >= 1) or i == len(lines) - 1:
            stop = min(stops[i], size)
            out.append((len(out), i - first + 1, start, stop))
            first, start = i + 1, stop
    return out


def _body(text: bytes, start: int, stop: int) -> bytes:
    """Bytes of a chunk without the newline at its end, which a text's last line may lack."""
    part = text[start:stop]
    return part[:-1] if part.endswith(b"\n") else part


def _chunk_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
    out, keys = [], []
    for text in batch.column(2).cast(pa.binary()).to_pylist():
        text = text or b""
        lines = lines_of(text)
        h = _hashes(lines)
        out.append([{"no": n, "lines": k, "start": a, "stop": b, "digest": blake2b(_body(text, a, b), digest_size=16).digest()} for n, k, a, b in _chunks(len(text), lines, h)])
        keys.append(_keys(h))
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(_CHUNK)), pa.array(keys, pa.list_(pa.int64()))], ["row", "doc_id", "chunks", "keys"])


def _candidate_bytes(batch: pa.RecordBatch) -> pa.RecordBatch:
    digests, bodies = [], []
    for text, own in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist(), strict=True):
        for c in own:
            digests.append(c["digest"])
            bodies.append(_body(text, c["start"], c["stop"]))
    return pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(bodies, pa.binary())], ["digest", "body"])


def _flags(sizes: list[int], gone: list[int] | None) -> np.ndarray:
    """Of each line, whether it is in a removed chunk; by the chunks' lines."""
    drop = np.zeros(len(sizes), bool)
    drop[gone or []] = True
    return np.repeat(drop, sizes)


def _open_windows(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Windows that aren't inside a removed chunk."""
    rows, numbers, keys = [], [], []
    for row, own, gone, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
        if not len(key):
            continue
        key = key.values.to_numpy(zero_copy_only=False)
        chunk = np.repeat(np.arange(len(own)), own)
        no = np.flatnonzero(~(_flags(own, gone)[:-1] & (chunk[:-1] == chunk[1:])))
        rows.append(np.full(len(no), row, np.int64))
        numbers.append(no)
        keys.append(key[no])
    joined = [np.concatenate(x).astype(t) if x else np.zeros(0, t) for x, t in ((rows, np.int64), (numbers, np.int32), (keys, np.int64))]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in joined], ["row", "no", "key"])


def _window_bodies(batch: pa.RecordBatch) -> pa.RecordBatch:
    rows, docs, numbers, digests, bodies = [], [], [], [], []
    for row, doc, text, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist(), strict=True):
        lines = lines_of(text)
        for no in own:
            body = lines[no] + b"\n" + lines[no + 1]
            rows.append(row)
            docs.append(doc)
            numbers.append(no)
            digests.append(blake2b(body, digest_size=16).digest())
            bodies.append(body)
    return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(docs, pa.int64()), pa.array(numbers, pa.int32()), pa.array(digests, pa.binary()), pa.array(bodies, pa.binary())], ["row", "doc_id", "no", "digest", "body"])


def _cut_lines(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Texts without removed chunks and ranges of lines. Chunks are cut again, which costs less than keeping texts beside them."""
    texts, n_lines, n_chunks, n_removed = [], [], [], []
    for text, gone, ranges in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
        text = text or b""
        lines = lines_of(text)
        own = [k for _, k, _, _ in _chunks(len(text), lines, _hashes(lines))]
        flags = _flags(own, gone)
        for r in ranges or ():
            flags[r["low"] : r["high"] + 1] = True
        n_lines.append(len(lines))
        n_chunks.append(len(own))
        n_removed.append(int(flags.sum()))
        if flags.any():
            text = b"\n".join(x for x, f in zip(lines, flags.tolist(), strict=True) if not f)
        texts.append(text.decode())
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_lines, pa.int64()), pa.array(n_chunks, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(texts, pa.string())], ["doc_id", "n_lines", "n_chunks", "n_removed", "text"])


def _place(number: str) -> Column:
    return F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("d"), "row", F.col(number).alias("no"))


def _named(docs: DataFrame) -> DataFrame:
    """row (a name that no other row has), doc_id and text."""
    named = docs.select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", "text")
    if named.groupBy("row").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return named
    return materialise(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "numbered")


def _chunk_level(named: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Chunks and window keys of each document; numbers of the chunks that go, by row; a bound for the latter's entries."""
    held = materialise(map_arrow(named, _chunk_rows, f"row long, doc_id long, chunks {CHUNKS}, keys array<bigint>"), "chunks")
    places = held.select("row", "doc_id", F.explode(F.filter("chunks", lambda c: c["lines"] > 1)).alias("c")).select("row", "doc_id", "c.no", "c.start", "c.stop", "c.digest")
    again = materialise(places.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"), "repeated-digests")
    n = again.count()
    found = materialise(join_bounded(places, again, ["digest"], "left_semi", n, 40), "repeated-chunks")
    by_row = found.groupBy("row").agg(F.collect_list(F.struct("digest", "start", "stop")).alias("own"))
    texts = join_bounded(named.select("row", "text"), by_row, ["row"], "inner", found.count(), 60)
    bodies = map_arrow(texts.select("text", "own"), _candidate_bytes, "digest binary, body binary")
    if not several_texts(bodies, "digest", "body").isEmpty():
        raise ValueError("different chunks with one 128-bit digest")
    first = found.groupBy("digest").agg(F.min(_place("no")).alias("first"))
    later = join_bounded(found, first, ["digest"], "inner", n, 60).where((F.col("row") != F.col("first.row")) | (F.col("no") != F.col("first.no")))
    gone = materialise(later.groupBy("row").agg(F.collect_list("no").alias("gone")), "removed-chunks")
    discard(again, found)
    return held, gone, gone.agg(F.sum(F.size("gone") + 16)).first()[0] or 0


def dedup_lines(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_chunks, n_removed (lines) and the text that stays, of each document; by chunks alone."""
    named = _named(docs)
    held, gone, entries = _chunk_level(named)
    discard(held)
    joined = join_bounded(named, gone, ["row"], "left", entries, 4)
    return map_arrow(joined.select("doc_id", "text", "gone", F.lit(None).cast("array<struct<low:int,high:int>>").alias("ranges")), _cut_lines, "doc_id long, n_lines long, n_chunks long, n_removed long, text string")


def dedup_passages(docs: DataFrame) -> DataFrame:
    """The columns of ``dedup_lines``; by chunks, then by windows of two lines."""
    named = _named(docs)
    held, gone, entries = _chunk_level(named)
    sizes = F.col("chunks.lines").alias("sizes")
    marked = join_bounded(held.select("row", sizes, "keys"), gone, ["row"], "left", entries, 4).select("row", "sizes", "gone", "keys")
    windows = materialise(map_arrow(marked, _open_windows, "row long, no int, key long"), "windows")
    again = materialise(windows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "repeated-keys")
    found = materialise(join_bounded(windows, again, ["key"], "left_semi", again.count(), 24).select("row", "no"), "repeated-windows")
    by_row = found.groupBy("row").agg(F.collect_list("no").alias("own"))
    texts = join_bounded(named, by_row, ["row"], "inner", found.count(), 24)
    bodies = map_arrow(texts.select("row", "doc_id", "text", "own"), _window_bodies, "row long, doc_id long, no int, digest binary, body binary")
    if not several_texts(bodies, "digest", "body").isEmpty():
        raise ValueError("different windows with one 128-bit digest")
    exact = materialise(bodies.drop("body"), "window-places")
    first = materialise(exact.groupBy("digest").agg(F.min(_place("no")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "first-windows")
    later = join_bounded(exact, first, ["digest"], "inner", first.count(), 60).where((F.col("row") != F.col("first.row")) | (F.col("no") != F.col("first.no")))
    # a window that overlaps its own first place, as in a line repeated in a row, leaves that place whole
    low = F.greatest("no", F.when(F.col("row") == F.col("first.row"), F.col("first.no") + 2))
    ranges = later.groupBy("row").agg(F.collect_list(F.struct(low.alias("low"), (F.col("no") + 1).alias("high"))).alias("ranges"))
    cut = materialise(gone.join(ranges, "row", "full_outer"), "removed-lines")
    discard(held, gone, windows, again, found, exact, first)
    entries = cut.agg(F.sum(F.coalesce(F.size("gone"), F.lit(0)) + 2 * F.coalesce(F.size("ranges"), F.lit(0)) + 24)).first()[0] or 0
    joined = join_bounded(named, cut, ["row"], "left", entries, 4)
    return map_arrow(joined.select("doc_id", "text", "gone", "ranges"), _cut_lines, "doc_id long, n_lines long, n_chunks long, n_removed long, text string")


def op1_chunk_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_passages(read(spark, sf_dir, "documents"))
