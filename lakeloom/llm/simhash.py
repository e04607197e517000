"""SimHash near-dedup (operator 8) with pivot distance tables.

A fingerprint has a bit where more than half of the XXH64 values (seed 42) of a document's shingles
of three words have it. Fingerprints link at two or fewer differing bits; components of the links are the
groups.

Distinct fingerprints are dealt to buckets: of four blocks of 16 bits, two agree in any linked
pair, so that each of the six pairs of blocks makes a bucket key. Each fingerprint has a table of
its Hamming distances to ``PIVOTS`` reference fingerprints; inside a bucket, pairs whose tables
differ by more than the radius in any coordinate are discarded, and survivors are verified. A
bucket of more than ``BUCKET`` fingerprints, as large groups of near copies make, is not paired at
all: each of its fingerprints names itself and its neighbours at one free bit, and two
fingerprints within two bits name a common one. That is exact, linear, and no name has more than
33 fingerprints.

``keep_one`` removes near copies as the pipeline means them: five words and a similarity of 0.8. Two bits of
64 are much nearer than that (a pair at 0.8 differs in about ten), so it has sketches of SKETCH bits:
one of shingles of two words, whose bands bring candidates together, and one of five words, whose
distance decides where it is far from the limit; near it the shingles themselves are compared. References of its pivot
tables are rows of the bucket.

Defined cases: null, empty and blank texts have fingerprint zero, linked like any other. Rows with
one fingerprint are in one group. A null doc_id is passed through and never names a group unless
all its rows have none. Repeated rows get equal rows. Extra columns are ignored, and kept by
``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm.common import BROADCAST_BYTES, discard, free, join_bounded, map_arrow, materialise, one_of_each, read
from lakeloom.llm.components import components

SHINGLE = 3
RADIUS = 2
PIVOTS = 16
BUCKET = 64

# near copies: bits of a sketch; words of the shingles that screen and that decide; the least similarity (Jaccard);
# the share of pairs at that similarity that no band may bring together; rows of a chunk
SKETCH = 256
SCREEN_WORDS, WORDS = 2, 5
SIMILAR = 0.8
MISSED = 0.03
CHUNK = 512
#: Chunks of a bucket up to which all pairs of them meet; bits that split a larger one, and how many times.
MANY_CHUNKS, SPLIT_BITS, MOST_SPLITS = 32, 6, 4
#: Links that a worker keeps before it hands them on.
LINK_ROWS = 50_000
#: Bytes of shingles of a crowd that are compared in one piece.
CROWD_BYTES = 16 << 20

_BANDS = list(combinations(range(4), 2))
_REFERENCES = np.random.default_rng(20).integers(0, 1 << 64, PIVOTS, np.uint64)


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """Fingerprint of a whole text, unsigned."""
    w = text.lower().split()
    if not w:
        return 0
    line = b" ".join(w)
    hash64 = xxhash.xxh64_intdigest
    if len(w) < size:
        return hash64(line, 42)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    h = np.array([hash64(line[a:b], 42) for a, b in zip(starts[: len(w) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 65536):
        ones += np.unpackbits(h[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (signed) of each document."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.array([fingerprint(t or b"") for t in batch.column(1).cast(pa.binary()).to_pylist()], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, fp long")


def pivot_table(fp: np.ndarray) -> np.ndarray:
    """Hamming distances to the reference fingerprints, a row for each fingerprint."""
    return np.bitwise_count(fp[:, None] ^ _REFERENCES[None, :]).astype(np.int8)


def _bucket_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
    fp = batch.column(0).to_numpy().view(np.uint64)
    tables = pivot_table(fp)
    blocks = [(fp >> np.uint64(16 * i)) & np.uint64(0xFFFF) for i in range(4)]
    keys = np.concatenate([blocks[a] | blocks[b] << np.uint64(16) for a, b in _BANDS]).astype(np.int64)
    keys |= np.repeat(np.arange(len(_BANDS), dtype=np.int64), len(fp)) << 32
    rows = pa.array([x.tobytes() for x in tables], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.tile(fp, len(_BANDS)).view(np.int64)), pa.concat_arrays([rows] * len(_BANDS))], ["bucket", "fp", "pivots"])


def linked(fp: np.ndarray, tables: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Indices i < j of linked fingerprints of a small bucket."""
    i, j = np.triu_indices(len(fp), 1)
    for c in range(tables.shape[1]):  # one coordinate after the other: few pairs reach the last
        near = np.abs(tables[i, c] - tables[j, c]) <= radius
        i, j = i[near], j[near]
    near = np.bitwise_count(fp[i] ^ fp[j]) <= radius
    return i[near], j[near]


def _bucket_links(batch: pa.RecordBatch) -> pa.RecordBatch:
    u, v = [], []
    for fps, pivots in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        fp = np.array(fps, np.int64)
        i, j = linked(fp.view(np.uint64), np.frombuffer(b"".join(pivots), np.int8).reshape(len(fp), -1))
        u.append(fp[i])
        v.append(fp[j])
    none = [np.zeros(0, np.int64)]
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(u or none)), pa.array(np.concatenate(v or none))], ["u", "v"])


def _free_bits(band: int) -> np.ndarray:
    a, b = _BANDS[band]
    bits = [x for block in range(4) if block not in (a, b) for x in range(16 * block, 16 * block + 16)]
    return np.array([0, *(1 << x for x in bits)], np.uint64)


_FREE = np.stack([_free_bits(b) for b in range(len(_BANDS))])


def _names(batch: pa.RecordBatch) -> pa.RecordBatch:
    bucket, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
    names = fp[:, None] ^ _FREE[bucket >> 32]
    n = names.shape[1]
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(bucket, n)), pa.array(names.ravel().view(np.int64)), pa.array(np.repeat(fp, n).view(np.int64))], ["bucket", "name", "fp"])


def links(distinct: DataFrame, bucket_rows: int = BUCKET) -> DataFrame:
    """Edges (u, v) between distinct fingerprints ``fp`` whose components are those of all links."""
    rows = materialise(map_arrow(distinct.select("fp"), _bucket_rows, "bucket long, fp long, pivots binary"), "buckets")
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    sized = rows.join(sizes, "bucket")
    small = sized.where(F.col("n") <= bucket_rows).groupBy("bucket").agg(F.collect_list(F.struct("fp", "pivots")).alias("own")).select(F.col("own.fp").alias("fps"), F.col("own.pivots").alias("pivots"))
    pairs = map_arrow(small, _bucket_links, "u long, v long")
    named = map_arrow(sized.where(F.col("n") > bucket_rows).select("bucket", "fp"), _names, "bucket long, name long, fp long")
    met = named.groupBy("bucket", "name").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    stars = met.select(F.array_min("fps").alias("u"), F.explode("fps").alias("v")).where("u != v").distinct()
    return pairs.unionByName(stars)


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint and component_id of each document."""
    rows = materialise(fingerprints(docs), "fingerprints")
    distinct = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct-fingerprints")
    joined = components(links(distinct), "fingerprint-links").withColumnRenamed("node", "fp")
    owned = distinct.join(joined, "fp", "left").select("fp", "low", F.coalesce("component", "fp").alias("component"))
    lowest = owned.groupBy("component").agg(F.min("low").alias("component_id"))
    named = materialise(owned.join(lowest, "component").select("fp", "component_id"), "components")
    discard(distinct)
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# near copies by five words


def shingle_sketch(text: bytes, size: int) -> np.ndarray:
    """SKETCH bits (as numbers of 64) of the distinct shingles of ``size`` words of a whole text."""
    w = text.lower().split()
    if not w:
        return np.zeros(SKETCH // 64, np.uint64)
    word = np.array([xxhash.xxh64_intdigest(x, 42) for x in w], np.uint64)
    n = max(1, len(word) - size + 1)
    h = np.zeros(n, np.uint64)
    for k in range(min(size, len(word))):
        h = h * np.uint64(0x9E3779B97F4A7C15) + _mixed(word[k : k + n])
    h = np.unique(h)
    wide = np.stack([_mixed(h + np.uint64(k * 0x632BE59BD9B4E019 & (1 << 64) - 1)) for k in range(SKETCH // 64)], 1)
    ones = np.zeros(SKETCH, np.int64)
    for at in range(0, len(wide), 16384):
        ones += np.unpackbits(wide[at : at + 16384].view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, sha (of the text), screen and sketch: bits of shingles of two and of five words."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or b"" for t in batch.column(2).cast(pa.binary()).to_pylist()]
        columns = [pa.array([shingle_sketch(t, k).tobytes() for t in texts], pa.binary()) for k in (SCREEN_WORDS, WORDS)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "sha", "screen", "sketch"])

    return map_arrow(docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"), "text"), run, "doc_id long, sha string, screen binary, sketch binary")


def bands(rows: int) -> np.ndarray:
    """Bits of each band. A band has about as many cells as there are rows, and there are so many bands that of
    pairs at the least similarity MISSED at most agree in none."""
    bits = max(16, int(np.ceil(np.log2(max(rows, 2)))))
    agree = (1 - _differing(SIMILAR, SCREEN_WORDS)) ** bits
    n = int(np.ceil(np.log(MISSED) / np.log(1 - agree)))
    r = np.random.default_rng(11)
    order = np.concatenate([r.permutation(SKETCH) for _ in range(-(-n * bits // SKETCH) + 1)])
    return order[: n * bits].reshape(n, bits)


def _differing(jaccard: float, size: int) -> float:
    """Share of bits in which two sketches of ``size`` words differ, if edits leave this similarity of five words."""
    kept = (2 * jaccard / (1 + jaccard)) ** (size / WORDS)
    return float(np.arccos(kept) / np.pi)


#: Differing bits of two sketches at the least similarity; at one that is surely above it, and at one that may be: pairs between
#: those are compared by their shingles.
FAR_BITS, SURE_BITS, LOOSE_BITS = (int(SKETCH * _differing(s, WORDS)) for s in (SIMILAR, SIMILAR + 0.07, SIMILAR - 0.08))


def near_pairs(sketch: np.ndarray, radius: int | None = None, first: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Indices i < j of linked sketches, one a row; with ``first`` i is below it and j isn't. The first rows are the references of the
    pivot tables: pairs whose distances to one of them differ by more than the radius are discarded, the others verified."""
    radius = FAR_BITS if radius is None else radius
    apart = lambda x, y: np.bitwise_count(x ^ y).sum(-1, dtype=np.int16)
    tables = np.stack([apart(sketch, p) for p in sketch[:PIVOTS]], 1)
    out_i, out_j = [], []
    for i in range(len(sketch) - 1 if first is None else first):
        j = np.arange(i + 1 if first is None else first, len(sketch))
        for c in range(tables.shape[1]):
            j = j[np.abs(tables[j, c] - tables[i, c]) <= radius]
        j = j[apart(sketch[j], sketch[i]) <= radius]
        out_i.append(np.full(len(j), i))
        out_j.append(j)
    none = [np.zeros(0, np.int64)]
    return np.concatenate(out_i or none), np.concatenate(out_j or none)


def forest(n: int, i: np.ndarray, j: np.ndarray) -> tuple[list[tuple[int, int]], list[int]]:
    """Edges that hang each member of a component to the one with most links, and those members."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    degree = np.bincount(np.concatenate([i, j]).astype(np.int64), minlength=n)
    hub: dict[int, int] = {}
    for x in range(n):
        r = find(x)
        if r not in hub or degree[x] > degree[hub[r]]:
            hub[r] = x
    return [(hub[find(x)], x) for x in range(n) if hub[find(x)] != x], sorted(hub.values())


def _band_rows(many: np.ndarray):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        screen = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
        bits = np.unpackbits(screen, axis=1, bitorder="little")
        keys = []
        for k, band in enumerate(many):
            key = np.full(batch.num_rows, k + 1, np.uint64)
            for word in range(0, len(band), 32):
                own = bits[:, band[word : word + 32]].astype(np.uint64)
                key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + own @ (np.uint64(1) << np.arange(own.shape[1], dtype=np.uint64)))
            keys.append(key.view(np.int64))
        n = len(many)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.concat_arrays([batch.column(0).combine_chunks() if isinstance(batch.column(0), pa.ChunkedArray) else batch.column(0)] * n), pa.concat_arrays([batch.column(2)] * n)], ["bucket", "node", "sketch"])

    return run


def _tied(nodes: list, sketches: list[bytes], first: int | None = None) -> tuple[list[tuple], list[int], np.ndarray, list]:
    """Edges (u, v, differing bits) of rows that meet, and their hubs, sketches and nodes in one order; with ``first`` only pairs
    of one of the first so many rows and a later one.

    Sure links hang the rows of a component to its hub. Of the other pairs that may be alike none is left out whose ends aren't in one
    such component, as only their shingles tell which of them joins two components.
    """
    order = sorted(range(len(nodes)), key=nodes.__getitem__) if first is None else list(range(len(nodes)))
    x = np.frombuffer(b"".join(sketches[k] for k in order), np.uint64).reshape(len(order), -1)
    i, j = near_pairs(x, LOOSE_BITS, first)
    far = np.bitwise_count(x[i] ^ x[j]).sum(-1, dtype=np.int64)
    sure = far <= SURE_BITS
    edges, hubs = forest(len(order), i[sure], j[sure])
    own = [nodes[k] for k in order]
    out = [(own[u], own[v], 0) for u, v in edges]
    root = np.arange(len(order))
    for u, v in edges:
        root[v] = u
    apart = ~sure & (root[i] != root[j])
    out += [(own[a], own[b], d) for a, b, d in zip(i[apart].tolist(), j[apart].tolist(), far[apart].tolist(), strict=True)]
    return out, hubs, x, own


def _links(node: str) -> str:
    return f"bucket long, u {node}, v {node}, far int, sketch binary"


def _links_of(rows: list[tuple], node: str) -> pa.RecordBatch:
    kind = pa.binary() if node == "binary" else pa.int64()
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), kind, kind, pa.int32(), pa.binary()))], ["bucket", "u", "v", "far", "sketch"])


def _told(bucket: int, edges: list[tuple], x: np.ndarray, own: list, crowds: bool) -> list[tuple]:
    """Rows for the edges of rows that met. With ``crowds``, where more pairs may be alike than there are rows in them, those rows
    go on in their place, as members (far -1) of a crowd that is named by all of them: rows, not pairs, are counted then."""
    loose = [e for e in edges if e[2] > SURE_BITS]
    ends = {n for u, v, _ in loose for n in (u, v)}
    if not crowds or len(loose) <= len(ends):
        return [(bucket, *e, None) for e in edges]
    members = [k for k in range(len(own)) if own[k] in ends]
    name = xxhash.xxh64_intdigest(repr(sorted(own[k] for k in members)))
    sure = [(bucket, *e, None) for e in edges if e[2] <= SURE_BITS]
    return sure + [(name - (1 << 63), own[k], None, -1, x[k].tobytes()) for k in members]


def _chunk_links(node: str, crowds: bool):
    """Edges of each chunk, and its hubs where its bucket has more chunks."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for bucket, chunks, nodes, sketches in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            edges, hubs, x, own = _tied(nodes, sketches)
            out += _told(bucket, edges, x, own, crowds)
            if chunks > 1:
                out += [(bucket, own[k], None, None, x[k].tobytes()) for k in hubs]
            if len(out) >= LINK_ROWS:
                yield _links_of(out, node)
                out = []
        yield _links_of(out, node)

    return run


def _block_links(node: str, crowds: bool):
    """Edges in a chunk of a bucket, or between the rows of two."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for bucket, low, rows in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            rows = sorted(rows, key=lambda r: (r["chunk"] != low, r["node"]))
            first = sum(r["chunk"] == low for r in rows)
            if first and len(rows) > 1:  # a chunk by itself, or two
                edges, _, x, own = _tied([r["node"] for r in rows], [r["sketch"] for r in rows], first if first < len(rows) else None)
                out += _told(bucket, edges, x, own, crowds)
            if len(out) >= LINK_ROWS:
                yield _links_of(out, node)
                out = []
        yield _links_of(out, node)

    return run


def _split_rows(level: int):
    """Rows of crowded buckets under narrower ones: SPLIT_BITS more bits of the screen, in as many ways as MISSED asks for."""
    agree = (1 - _differing(SIMILAR, SCREEN_WORDS)) ** SPLIT_BITS
    n = int(np.ceil(np.log(MISSED) / np.log(1 - agree)))
    many = np.stack([np.random.default_rng(100 * level + k).permutation(SKETCH)[:SPLIT_BITS] for k in range(n)])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bucket = batch.column(0).to_numpy().view(np.uint64)
        bits = np.unpackbits(np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(batch.num_rows, -1), axis=1, bitorder="little")
        weight = np.uint64(1) << np.arange(SPLIT_BITS, dtype=np.uint64)
        keys = [_mixed(_mixed(bucket + np.uint64(k + 1)) + bits[:, band].astype(np.uint64) @ weight).view(np.int64) for k, band in enumerate(many)]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.concat_arrays([batch.column(1)] * n), pa.concat_arrays([batch.column(3)] * n)], ["bucket", "node", "sketch"])

    return run


def _blocks(rows: DataFrame, crowds: bool) -> DataFrame:
    """Links between rows of a bucket (bucket, node, sketch, chunks): every chunk is linked whole, and every pair of chunks meets once."""
    part = F.pmod(F.xxhash64("node", F.lit(-1)), F.col("chunks")).cast("int")
    own = rows.withColumn("chunk", part)
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")
    met = own.select("bucket", "chunk", other, F.struct(F.col("chunk").alias("chunk"), "node", "sketch").alias("row"))
    pairs = met.groupBy("bucket", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high")).agg(F.collect_list("row").alias("rows"))
    kind = rows.schema["node"].dataType.simpleString()
    return map_arrow(pairs.select("bucket", "low", "rows"), _block_links(kind, crowds), _links(kind))


def near_edges(held: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Edges (u, v) whose sketches are at the least similarity or nearer; see ``near_links``."""
    return near_links(held, chunk).where(F.col("far") <= FAR_BITS).select("u", "v")


def near_links(held: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Edges (u, v, far) between the ``node`` of ``held`` whose sketches are near, each by itself; see ``near_met``."""
    return near_met(held, chunk, False)[0]


def near_met(held: DataFrame, chunk: int = CHUNK, crowds: bool = True) -> tuple[DataFrame, DataFrame]:
    """Edges (u, v, far) between the ``node`` of ``held`` (node, screen, sketch; one row each) whose sketches are near; and, with
    ``crowds``, members (crowd, node, sketch) of crowds, of which any two whose sketches are near are such an edge, too.

    Rows that agree in a band meet in its bucket. A bucket is dealt to chunks of about ``chunk`` rows, each of
    which is linked whole. Of a bucket with several chunks the hub of each component goes on: where that leaves
    half of the rows or fewer, as with near copies, to a next round; else every pair of its chunks meets, block by block,
    and no pair of what went on is unmet. A bucket that is too large for that is first split by further bits.
    """
    many, kind = bands(held.count()), held.schema["node"].dataType.simpleString().replace("bigint", "long")
    banded = f"bucket long, node {kind}, sketch binary"
    rows = map_arrow(held.select("node", "screen", "sketch"), _band_rows(many), banded)
    found, level, splits = [], 0, 0
    while True:
        rows = materialise(rows, "band-rows")
        large = materialise(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > chunk).select("bucket", "n", F.ceil(F.col("n") / chunk).cast("int").alias("chunks")), "large-buckets")
        n = large.count()
        dealt = join_bounded(rows, large.drop("n"), ["bucket"], "left", n, 24).withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        part = F.pmod(F.xxhash64("node", F.lit(level)), F.col("chunks")).alias("part")
        groups = dealt.groupBy("bucket", part, "chunks").agg(F.collect_list(F.struct("node", "sketch")).alias("own")).where((F.size("own") > 1) | (F.col("chunks") > 1))
        out = materialise(map_arrow(groups.select("bucket", "chunks", F.col("own.node").alias("nodes"), F.col("own.sketch").alias("sketches")), _chunk_links(kind, crowds), _links(kind)), "near-links")
        found.append(out)
        discard(rows)
        if not n:
            discard(large)
            break
        hubs = out.where("v IS NULL AND far IS NULL").select("bucket", F.col("u").alias("node"), "sketch")
        left = hubs.groupBy("bucket").agg(F.count(F.lit(1)).alias("left"))
        state = materialise(large.join(left, "bucket").select("bucket", (F.col("left") * 2 <= F.col("n")).alias("shrinks"), F.ceil(F.col("left") / chunk).cast("int").alias("chunks")), "large-buckets")
        discard(large)
        sorts = F.when(F.col("shrinks") | (F.col("chunks") == 1), "again").when((F.col("chunks") > MANY_CHUNKS) & F.lit(splits < MOST_SPLITS), "split").otherwise("blocks")
        state = state.withColumn("way", sorts)
        ways = {r["way"] for r in state.select("way").distinct().collect()}
        on = join_bounded(hubs, state, ["bucket"], "inner", n, 40)
        if "blocks" in ways:
            found.append(materialise(_blocks(on.where("way = 'blocks'"), crowds), "block-links"))
        rows = on.where("way = 'again'").select("bucket", "node", "sketch")
        if "split" in ways:
            wide = on.where("way = 'split'").join(held.select("node", "screen"), "node").select("bucket", "node", "screen", "sketch")
            rows = rows.unionByName(map_arrow(wide, _split_rows(splits), banded))
            splits += 1
        if not ways - {"blocks"}:
            break
        level += 1
    told = found[0]
    for more in found[1:]:
        told = told.unionByName(more)
    return told.where("v IS NOT NULL").select("u", "v", "far"), told.where("far = -1").select(F.col("bucket").alias("crowd"), F.col("u").alias("node"), "sketch")


def shingles(text: bytes) -> np.ndarray:
    """Hashes of the different shingles of WORDS words of a whole text."""
    w = text.lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    word = np.array([xxhash.xxh64_intdigest(x, 7) for x in w], np.uint64)
    n = max(1, len(word) - WORDS + 1)
    h = np.full(n, len(word) if len(word) < WORDS else WORDS, np.uint64)
    for k in range(min(WORDS, len(word))):
        h = _mixed(h * np.uint64(0x9E3779B97F4A7C15) + word[k : k + n])
    return np.unique(h)


def _enough(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets of shingles have SIMILAR or more in common."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= SIMILAR * (len(x) + len(y) - both)


def shingles_of(docs: DataFrame, held: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, own (shingles, 8 bytes each), size in bytes of the given nodes of ``held`` (doc_id, sha, node).

    Only texts of such nodes are read into shingles, one text a node.
    """
    ends = nodes.distinct()
    n = ends.count()
    chosen = materialise(join_bounded(held.select("node", "sha"), ends, ["node"], "left_semi", n, 64).groupBy("node").agg(F.min("sha").alias("sha")), "near-chosen")
    marked = docs.select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"), "text")
    texts = join_bounded(marked, chosen, ["sha"], "inner", n, 140).select("node", "text")

    def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t or b"").tobytes() for t in batch.column(1).cast(pa.binary()).to_pylist()], pa.binary())], ["node", "own"])

    own = map_arrow(texts, sets, "node binary, own binary").groupBy("node").agg(F.first("own").alias("own"))
    own = materialise(own.withColumn("size", F.octet_length("own")), "near-shingles")
    discard(chosen)
    return own


def alike(docs: DataFrame, held: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of pairs (u, v) of the nodes of ``held`` (doc_id, sha, node) those whose texts have SIMILAR or more of their shingles in common."""
    own = shingles_of(docs, held, pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))))
    side = lambda c: own.select(F.col("node").alias(c), F.col("own").alias(f"{c}_own"))

    def compare(batch: pa.RecordBatch) -> pa.RecordBatch:
        both = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
        keep = [_enough(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)) for a, b in both]
        return batch.filter(pa.array(keep, pa.bool_())).select(["u", "v"])

    met = materialise(map_arrow(pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "u_own", "v_own"), compare, "u binary, v binary"), "near-alike")
    discard(own)
    return met


def _crowd_links(rows: pa.Table) -> pa.Table:
    """Links (u, v) that join what is alike of a crowd, or of two pieces of one; the nearest pairs are compared first, and none
    whose ends are joined already."""
    rows = rows.sort_by([("piece", "ascending"), ("node", "ascending")])
    node, piece, component = (rows[c].to_pylist() for c in ("node", "piece", "component"))
    x = np.frombuffer(b"".join(rows["sketch"].to_pylist()), np.uint64).reshape(len(node), -1)
    own = [np.frombuffer(s, np.uint64) for s in rows["own"].to_pylist()]
    root = {c: c for c in component}

    def find(c: bytes) -> bytes:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    first = piece.count(piece[0])
    i, j = near_pairs(x, LOOSE_BITS, first if first < len(node) else None)
    order = np.argsort(np.bitwise_count(x[i] ^ x[j]).sum(-1, dtype=np.int64), kind="stable")
    out = []
    for a, b in zip(i[order].tolist(), j[order].tolist(), strict=True):
        p, q = find(component[a]), find(component[b])
        if p != q and _enough(own[a], own[b]):
            root[max(p, q)] = min(p, q)
            out.append((node[a], node[b]))
    return pa.table({c: pa.array([e[k] for e in out], pa.binary()) for k, c in enumerate("uv")})


def crowd_links(docs: DataFrame, held: DataFrame, members: DataFrame, joined: DataFrame) -> DataFrame:
    """Links (u, v) that join the members (crowd, node, sketch) that are alike, given the components that are ``joined`` already.

    A crowd that is in one component is left alone. A crowd meets in one task, its rows with their shingles; if it has more than
    CROWD_BYTES of those it is dealt to pieces, any two of which meet.
    """
    there = join_bounded(members, joined, ["node"], "left", joined.count(), 64).withColumn("component", F.coalesce("component", "node"))
    several = there.groupBy("crowd").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a != b").select("crowd")
    there = materialise(there.join(several, "crowd"), "near-members")
    own = shingles_of(docs, held, there.select("node"))
    pieces = there.join(own.select("node", "size"), "node").groupBy("crowd").agg(F.greatest(F.lit(1), F.ceil(F.sum("size") / CROWD_BYTES)).cast("int").alias("pieces"))
    dealt = there.join(pieces, "crowd").withColumn("piece", F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).withColumn("low", F.least("piece", "other")).withColumn("high", F.greatest("piece", "other"))
    met = met.select("crowd", "low", "high", "piece", "node", "component", "sketch").join(own.select("node", "own"), "node")
    out = materialise(met.groupBy("crowd", "low", "high").applyInArrow(_crowd_links, "u binary, v binary"), "crowd-links")
    discard(there, own)
    return out


def _apart(loose: DataFrame, joined: DataFrame) -> DataFrame:
    """Pairs (u, v, far) whose ends are in different components, with those as ``a`` and ``b``."""
    n = joined.count()
    for end, c in (("u", "_a"), ("v", "_b")):
        there = joined.select(F.col("node").alias(end), F.col("component").alias(c))
        loose = join_bounded(loose, there, [end], "left", n, 64).withColumn(c, F.coalesce(c, end))
    return loose.where("_a != _b").select("u", "v", "far", F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))


def near_groups(docs: DataFrame, held: DataFrame, near: DataFrame, crowds: DataFrame | None = None) -> DataFrame:
    """node, component of the nodes of links (u, v, far): sure ones, and of the others and in ``crowds`` those whose shingles are alike.

    Between two components the nearest pair is compared first; where that doesn't join them, all the others are.
    """
    links = near.where(F.col("far") <= SURE_BITS).select("u", "v")
    joined = materialise(components(links, "near-components"), "near-nodes")
    loose, made = near.where(F.col("far") > SURE_BITS), []
    if crowds is not None and not crowds.isEmpty():
        made += [joined, crowd_links(docs, held, crowds, joined)]
        links = links.unionByName(made[-1])
        joined = materialise(components(links, "near-components"), "near-nodes")
    for each in (False, True):
        apart = materialise(_apart(loose, joined), "near-apart")
        made.append(apart)
        if apart.isEmpty():
            break
        nearest = apart.groupBy("a", "b").agg(F.min(F.struct("far", "u", "v")).alias("p")).select("p.u", "p.v")
        made.append(alike(docs, held, apart.select("u", "v") if each else nearest))
        links = links.unionByName(made[-1])
        made.append(joined)
        joined = materialise(components(links, "near-components"), "near-nodes")
        loose = apart.select("u", "v", "far").join(nearest, ["u", "v"], "left_anti")
    discard(*made)
    return joined


def near_copies(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id and sha of each different row with its group ``component``; doc_id and sha of the one that stays of each group.

    A node is a pair of sketches, named by a digest of them, so that neither the nodes nor what is linked depend on how rows lie.
    """
    node = F.unhex(F.md5(F.concat("screen", "sketch"))).alias("node")
    held = materialise(sketches(docs).groupBy("doc_id", "sha").agg(F.first("screen").alias("screen"), F.first("sketch").alias("sketch")).withColumn("node", node), "sketches")
    nodes = materialise(held.groupBy("node").agg(F.first("screen").alias("screen"), F.first("sketch").alias("sketch")), "sketch-nodes")
    ends = [F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")]
    links, members = near_met(nodes)
    near = materialise(links.groupBy(*ends).agg(F.min("far").alias("far")), "near-links")
    crowds = materialise(members.dropDuplicates(["crowd", "node"]), "near-crowds")
    joined = near_groups(docs, held, near, crowds)
    discard(nodes, near, crowds)
    named = join_bounded(held.select("doc_id", "sha", "node"), joined, ["node"], "left", joined.count(), 64).select("doc_id", "sha", F.coalesce("component", "node").alias("component"))
    named = materialise(named, "near-classes")
    discard(held, joined)
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sha")
    stay = named.groupBy("component").agg(F.min(first).alias("first")).select("first.doc_id", "first.sha")
    return named, stay


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies, with all its columns: the smallest doc_id (null last), then the smallest digest of the text.

    Rows are told apart by doc_id (nulls are alike) and text, so rows with one doc_id and different
    texts go or stay each for itself; of rows that agree in both one stays, if any does. Columns of any name
    are kept as they are. Two texts are near copies at a similarity of SIMILAR of their sets of
    five-word shingles: where the distance of their sketches doesn't tell it surely, the sets are compared.
    """
    named, stay = near_copies(docs)
    id_, sha, mine = free("_id", docs), free("_sha", docs), free("_mine", docs)
    gone = named.select("doc_id", "sha").exceptAll(stay)
    gone = materialise(gone.select(F.col("doc_id").alias(id_), F.col("sha").alias(sha)), "near-gone")
    marked = docs.withColumn(mine, F.sha2(F.coalesce("text", F.lit("")), 256))
    there = F.broadcast(gone) if gone.count() * 110 <= BROADCAST_BYTES else gone
    kept = marked.join(there, marked["doc_id"].eqNullSafe(gone[id_]) & (marked[mine] == gone[sha]), "left_anti")
    if not marked.groupBy("doc_id", mine).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        kept = one_of_each(kept, ["doc_id", mine])
    return kept.drop(mine)


def op8_pivot_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(read(spark, sf_dir, "documents"))
