"""Conversation prefix trie (operator 11) by Patricia construction.

A conversation is a path of turns, a turn 16 bytes of a digest of role and text, so that sorting the
concatenated digests sorts conversations by their turns. All paths, copies too, are sorted by ranges; each
partition is then read once, from path to path. The length of the prefix that a path shares with the one
before it says which points end there: only branches, ends and leaves are made, with compressed edges between
them, on a stack as deep as the tree. Counts are summed on this compressed tree; when a point is complete, the
unary nodes of its edge are written with the sums of the edge's turns from each of them to its end.

Everything a node needs is a sum or minimum over the paths below it. A path adds its words to all nodes above
it (each member once) and, beyond what it shares with the path before it, the words of the nodes that it
brings; saved_tokens is the first sum less the second. So a node that crosses the border of two
partitions, which is one on the first or last path of a partition, leaves partial sums under a digest of its
prefix, and those are added up; what both sides of a border have counted is taken off. Partial sums
are no more than the turns of two paths a partition.

Defined cases: turns are ordered by number, null first, and turns with one number by their digest. Null role or text
is empty. Rows without conv_id belong to no conversation and are left out. Repeated rows are turns of
their own. No conversation gives no row, not even a root. A conversation is one row of 24 bytes a turn while it is
sorted; texts aren't shuffled. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeloom.llm.common import CRC32_SQL, join_bounded, map_arrow, materialise, read, small_batches

TURN = 16
#: Rows of an output batch; children that wait for their parent's name; bytes of a piece of ids.
ROWS, WAITING, PIECE = 4096, 4096, 1 << 16
#: Conversations of a family that share openings, and openings of at most one turn less than this, in the query's rebuilding.
FAMILY, OPENINGS = 20, 4

_NONE = hashlib.sha256(b"").hexdigest()
#: kind: node (whole), open (lacks its parent's name), name (of a point that open rows ask for), part (partial
#: sums of a node), ids (of the members that end there, in pieces), first and last (path of a partition).
_SCHEMA = "kind string, key binary, parent_key binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, part int, at int, bytes binary, words binary"
_ARROW = pa.schema([("kind", pa.string()), ("key", pa.binary()), ("parent_key", pa.binary()), *[(c, pa.int64()) for c in ("depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")], ("ends_sha256", pa.string()), ("part", pa.int32()), ("at", pa.int32()), ("bytes", pa.binary()), ("words", pa.binary())])
_SUMS = ["n_convs", "n_children", "n_leaves", "saved_tokens"]


def turns_of(rows: DataFrame) -> DataFrame:
    """conv_id and its turns in order, each with digest and number of words. Turns of one family are in one partition."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)), 1, TURN)
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    conv = F.col("conv_id").cast("long")
    narrow = rows.where("conv_id IS NOT NULL").select(conv.alias("conv_id"), (conv - F.pmod(conv, F.lit(FAMILY))).alias("family"), F.struct(F.col("turn").alias("turn"), digest.alias("digest"), words.alias("words")).alias("t"))
    return narrow.repartition("family").groupBy("family", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def rebuilt(rows: DataFrame) -> DataFrame:
    """The query's conversations: the opening of the family's first, then the own turns after as many."""
    own = turns_of(rows)
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(OPENINGS)).cast("int")
    head = F.max(F.when(F.col("conv_id") == F.col("family"), F.slice("turns", 1, OPENINGS - 1))).over(Window.partitionBy("family"))
    both = own.withColumn("head", F.coalesce(head, F.slice("turns", 1, 0))).withColumn("h", h)
    return both.select("conv_id", F.concat(F.slice("head", F.lit(1), F.col("h")), F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))


def shared(a: bytes, b: bytes) -> int:
    """Turns that two paths have in common at their beginning."""
    low, high = 0, min(len(a), len(b)) // TURN
    while low < high:
        mid = (low + high + 1) // 2
        if a[low * TURN : mid * TURN] == b[low * TURN : mid * TURN]:
            low = mid
        else:
            high = mid - 1
    return low


def keys(path: bytes, first: int, last: int) -> list[bytes]:
    """Digests of the prefixes of ``first`` to ``last`` turns."""
    h = hashlib.blake2b(path[: first * TURN], digest_size=16)
    out = [h.copy().digest()]
    for d in range(first, last):
        h.update(path[d * TURN : (d + 1) * TURN])
        out.append(h.copy().digest())
    return out


@dataclass
class Point:
    """A branch, end or leaf, with the sums over the paths below it in this partition."""

    depth: int
    first: bool  # it holds the partition's first path
    intro: int  # turns that its first path shares with the one before it
    n: int = 0
    low: int | None = None
    leaves: int = 0
    total: int = 0  # words of its paths
    brought: int = 0  # words of the nodes that its paths bring
    children: int = 0
    ids: bytearray = field(default_factory=bytearray)
    waiting: list[tuple] = field(default_factory=list)
    asked: bool = False

    def add(self, n: int, low: int, total: int, brought: int) -> None:
        self.n += n
        self.low = low if self.low is None else min(self.low, low)
        self.total += total
        self.brought += brought


class Builder:
    """The compressed tree of one partition's sorted paths, a row at a time."""

    def __init__(self, part: int):
        self.part, self.out = part, []
        self.stack = [Point(0, True, 0)]
        self.path, self.sums = None, [0]

    def add(self, path: bytes, words: list[int], conv_id: int) -> None:
        if path == self.path:
            end = self.stack[-1]
            end.add(1, conv_id, self.sums[-1], 0)
            end.ids += b",%d" % conv_id
            return
        common = 0 if self.path is None else shared(self.path, path)
        self.cut(common)
        sums = list(accumulate(words, initial=0))
        if self.path is None:
            self.edge("first", path, words)
        depth = len(path) // TURN
        if depth:
            self.stack.append(Point(depth, self.path is None, common))
        self.path, self.sums, self.words = path, sums, words
        end = self.stack[-1]
        end.add(1, conv_id, sums[-1], sums[-1] - sums[common])
        end.ids += b",%d" % conv_id

    def cut(self, depth: int) -> None:
        """Complete the points below a depth; a point is made there if there is none."""
        while self.stack[-1].depth > depth:
            point = self.stack.pop()
            if self.stack[-1].depth < depth:
                self.stack.append(Point(depth, point.first, point.intro))
            self.close(point, self.stack[-1], False)

    def finish(self) -> None:
        if self.path is None:
            return
        self.edge("last", self.path, self.words)
        while len(self.stack) > 1:
            point = self.stack.pop()
            self.close(point, self.stack[-1], True)
        if not self.stack[0].children:
            self.stack[0].leaves = 1
        self.write(self.stack[0], -1, True)

    def close(self, point: Point, parent: Point, last: bool) -> None:
        if not point.children:
            point.leaves = 1
        parent.add(point.n, point.low, point.total, point.brought)
        parent.leaves += point.leaves
        parent.children += 1
        top = self.write(point, parent.depth, point.first or last)
        if top is None:
            return
        if parent.first or len(parent.waiting) >= WAITING:  # a point on the first path has its name only in the end
            parent.asked = True
            self.open(top, keys(self.path, parent.depth, parent.depth)[0])
        else:
            parent.waiting.append(top)

    def open(self, row: tuple, parent_key: bytes) -> None:
        self.row("open", parent_key=parent_key, **dict(zip(("depth", "conv_id", *_SUMS, "ends_sha256"), row, strict=True)))

    def write(self, point: Point, above: int, border: bool) -> tuple | None:
        """The node of a point and the unary ones of its edge; the uppermost is returned if its parent has to name it."""
        ids = bytes(point.ids[1:])
        if border:
            names = keys(self.path, max(above, 0), point.depth)
            for at, begin in enumerate(range(0, len(point.ids), PIECE)):
                self.row("ids", key=names[-1], part=self.part, at=at, bytes=bytes(point.ids[begin : begin + PIECE]))
            point.ids = bytearray()
        name = keys(self.path, point.depth, point.depth)[0] if border or point.asked else None
        for row in point.waiting:
            if border:
                self.open(row, name)
            else:
                self.row("node", parent_conv_id=point.low, **dict(zip(("depth", "conv_id", *_SUMS, "ends_sha256"), row, strict=True)))
        point.waiting = []
        if point.asked and not border:
            self.row("name", key=name, conv_id=point.low)
        sha = hashlib.sha256(ids).hexdigest() if ids and not border else _NONE
        top = None
        for d in range(point.depth, above, -1):
            before = self.sums[max(d - 1, 0)]
            saved = point.total - point.n * before - (point.brought - max(0, before - self.sums[point.intro]))
            row = (d, point.low, point.n, point.children if d == point.depth else 1, point.leaves, saved, sha if d == point.depth else _NONE)
            if border:
                self.row("part", key=names[d - max(above, 0)], parent_key=names[d - 1 - max(above, 0)] if d else None, **dict(zip(("depth", "conv_id", *_SUMS), row[:-1], strict=True)))
            elif d > above + 1:
                self.row("node", parent_conv_id=point.low, **dict(zip(("depth", "conv_id", *_SUMS, "ends_sha256"), row, strict=True)))
            else:
                top = row
        return top

    def edge(self, kind: str, path: bytes, words: list[int]) -> None:
        self.row(kind, part=self.part, bytes=path, words=np.array(words, "<i4").tobytes())

    def row(self, kind: str, **values: object) -> None:
        self.out.append({"kind": kind, **values})

    def batch(self) -> pa.RecordBatch:
        rows, self.out = self.out, []
        return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in _ARROW], schema=_ARROW)


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tree = Builder(TaskContext.get().partitionId())
    for batch in batches:
        for path, words, conv_id in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            tree.add(path, words, conv_id)
            if len(tree.out) >= ROWS:
                yield tree.batch()
    tree.finish()
    yield tree.batch()


def _both_sides(batch: pa.RecordBatch) -> pa.RecordBatch:
    """What the partitions on both sides of a border have counted, to be taken off the nodes that their paths share."""
    fix = Builder(0)
    for before, words, after in zip(*[c.to_pylist() for c in batch.columns], strict=True):
        n = shared(before, after)
        sums = list(accumulate(np.frombuffer(words, "<i4").tolist(), initial=0))
        no_leaf = -1 if n * TURN == len(before) else 0
        for d, key in enumerate(keys(before, 0, n)):
            fix.row("part", key=key, depth=d, n_convs=0, n_children=-1 if d < n else 0, n_leaves=no_leaf, saved_tokens=sums[n] - sums[max(d - 1, 0)])
    return fix.batch()


def _hash_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's pieces, which come in order; no more than one batch is held."""
    now, h, lead = None, hashlib.sha256(), True
    for batch in batches:
        done_keys, done = [], []
        for key, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if key != now:
                if now is not None:
                    done_keys.append(now)
                    done.append(h.hexdigest())
                now, h, lead = key, hashlib.sha256(), True
            h.update(piece[1:] if lead else piece)
            lead = False
        yield pa.RecordBatch.from_arrays([pa.array(done_keys, pa.binary()), pa.array(done, pa.string())], ["key", "ends_sha256"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([h.hexdigest()], pa.string())], ["key", "ends_sha256"])


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The nodes of all prefixes of conversations (conv_id, turns of digest and words); see the query's columns."""
    spark = conversations.sparkSession
    small_batches(spark)
    path = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), ""))
    paths = conversations.select(path.alias("path"), F.transform("turns", lambda t: t["words"]).alias("words"), "conv_id")
    ordered = paths.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    built = materialise(ordered.mapInArrow(_build, _SCHEMA), "trie")
    kind = lambda *k: built.where(F.col("kind").isin(*k))

    parts = sorted(r["part"] for r in kind("first").select("part").collect())  # one number for each partition
    after = spark.createDataFrame(list(zip(parts, parts[1:], strict=False)), "part int, next int")
    last = kind("last").select("part", F.col("bytes").alias("before"), "words").join(F.broadcast(after), "part")
    first = kind("first").select(F.col("part").alias("next"), F.col("bytes").alias("after"))
    borders = last.join(first, "next").select("before", "words", "after")
    fixes = map_arrow(borders, _both_sides, _SCHEMA)
    sums = kind("part").unionByName(fixes).groupBy("key", "depth").agg(F.min("conv_id").alias("conv_id"), F.max("parent_key").alias("parent_key"), *[F.sum(c).alias(c) for c in _SUMS])
    ids = kind("ids").select("key", "part", "at", "bytes").repartition("key").sortWithinPartitions("key", "part", "at").select("key", "bytes").mapInArrow(_hash_ids, "key binary, ends_sha256 string")
    shared_nodes = materialise(sums.join(ids, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_NONE))), "trie-shared")

    names = shared_nodes.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id")).unionByName(kind("name").select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id")))
    columns = ["conv_id", "depth", "parent_conv_id", *_SUMS, "ends_sha256"]
    known = [c for c in columns if c != "parent_conv_id"]
    lacking = kind("open").select("parent_key", *known).unionByName(shared_nodes.select("parent_key", *known))
    named = join_bounded(lacking, names, ["parent_key"], "left", names.count(), 60)
    return kind("node").select(*columns).unionByName(named.select(*columns))


def op11_patricia_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt(read(spark, sf_dir, "conversations")))


#: Each node as the list of its turns, not by sorting.
OP11_SQL = (
    r"""
WITH own AS (
  SELECT conv_id, list({'r': coalesce(role, ''), 'x': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS t FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), ids AS (SELECT conv_id, t, """
    + CRC32_SQL.format(bytes="list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(ord(s) AS BIGINT))")
    + r""" % 4 AS h FROM own
), paths AS (SELECT i.conv_id, list_concat(coalesce(b.t[1:i.h], []), i.t[i.h + 1:]) AS p FROM ids i LEFT JOIN own b ON b.conv_id = i.conv_id - ((i.conv_id % 20) + 20) % 20
), members AS (SELECT conv_id, p, unnest(range(0, len(p) + 1)) AS d FROM paths
), nodes AS (SELECT p[1:d] AS node, any_value(d) AS d, min(conv_id) AS conv_id, count(*) AS n FROM members GROUP BY p[1:d]
), ends AS (SELECT p AS node, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS sha FROM paths GROUP BY p
), kids AS (SELECT node[1:d - 1] AS node, count(*) AS k FROM nodes WHERE d > 0 GROUP BY node[1:d - 1]
), own_sums AS (
  SELECT n.node, n.d, CASE WHEN k.k IS NULL THEN 1 ELSE 0 END AS leaf,
    CASE WHEN n.d = 0 THEN 0 ELSE (n.n - 1) * len(regexp_extract_all(n.node[n.d].x, '[^\x20\x09-\x0D]+')) END AS saved
  FROM nodes n LEFT JOIN kids k ON k.node = n.node
), up AS (SELECT node, leaf, saved, unnest(range(0, d + 1)) AS a FROM own_sums
), sums AS (SELECT node[1:a] AS node, sum(leaf) AS leaves, sum(saved) AS saved FROM up GROUP BY node[1:a])
SELECT n.conv_id, n.d AS depth, q.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(k.k, 0) AS n_children, CAST(s.leaves AS BIGINT) AS n_leaves,
  CAST(s.saved AS BIGINT) AS saved_tokens, coalesce(e.sha, sha256('')) AS ends_sha256
FROM nodes n JOIN sums s ON s.node = n.node LEFT JOIN nodes q ON n.d > 0 AND q.node = n.node[1:n.d - 1]
LEFT JOIN kids k ON k.node = n.node LEFT JOIN ends e ON e.node = n.node
"""
)
