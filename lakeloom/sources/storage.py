"""Versioned tables in a shared folder, and intermediate tables that survive lost executors."""

from __future__ import annotations

import json
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field
from datetime import datetime, timedelta, timezone
from functools import reduce, wraps
from typing import Protocol

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lakeloom.schemas import TABLES, Table

_OWN: list[str] = []
#: End of a whole pointer file, and the folder name of a partition.
_END, _PARTITION = "\n.", "_p"
#: Bytes of a counted side of a join up to which it may be broadcast.
BROADCAST_BYTES = 32 << 20
#: Bytes of the place of a deleted row in memory: most of it is the file's name.
POSITION_BYTES = 120


def row_bytes(df: DataFrame) -> int:
    """A generous size of a row in memory, by its types: the engine's own default sizes, with 100 bytes a text."""
    return 16 + sum(100 if k == "string" else 400 if "<" in k else 16 for _, k in df.dtypes)


def bounded(df: DataFrame, size: int) -> DataFrame:
    """A side of a join, of so many bytes by its count: broadcast if they are few, else never, however small its files look to Spark."""
    return F.broadcast(df) if size <= BROADCAST_BYTES else df.hint("merge")


def _folder(part: str) -> str:
    """The folder that a part's files are in, as their paths name it."""
    return part.rpartition("/")[2]


def unescaped(path: Column) -> Column:
    """A piece of a file's address as the file system names it."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a local one only on a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="lakeloom-store-"))
    return f"file://{_OWN[0]}"


_SCOPES = threading.local()


@contextmanager
def scratch() -> Iterator[None]:
    """Intermediate tables that ``stable`` makes inside are deleted at the end, also after an error."""
    held: list[tuple[SparkSession, str]] = []
    stack = _SCOPES.__dict__.setdefault("stack", [])
    stack.append(held)
    try:
        yield
    finally:
        stack.remove(held)
        for spark, path in held:
            Files(spark, path).delete(path)


def scratched(f: Callable) -> Callable:
    """A function whose intermediate tables are deleted when it returns."""

    @wraps(f)
    def run(*args: object, **kwargs: object) -> object:
        with scratch():
            return f(*args, **kwargs)

    return run


def stable(df: DataFrame) -> DataFrame:
    """Write once and read back: cuts the lineage, and later reads see the same rows.

    Inside ``scratch`` the files are deleted at its end; outside they stay, as what is returned may be read at any time.
    """
    path = f"{shared_folder(df.sparkSession)}/lakeloom-stable/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if stack := _SCOPES.__dict__.get("stack"):
        stack[-1].append((df.sparkSession, path))
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Files:
    """Few file operations through Spark's own file systems, so that any store works."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.root = root
        self.fs = self._path(root).getFileSystem(self.conf)

    def _path(self, p: str):
        return self.jvm.org.apache.hadoop.fs.Path(p)

    def exists(self, p: str) -> bool:
        return self.fs.exists(self._path(p))

    def read(self, p: str) -> str:
        stream = self.fs.open(self._path(p))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, p: str, text: str, overwrite: bool = True) -> None:
        stream = self.fs.create(self._path(p), overwrite)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def delete(self, p: str) -> None:
        self.fs.delete(self._path(p), True)

    def list(self, p: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(p))) if self.exists(p) else []

    def bytes(self, p: str) -> int:
        return self.fs.getContentSummary(self._path(p)).getLength()

    def changed(self, p: str) -> datetime:
        """When a file or folder was last changed, UTC."""
        return datetime.fromtimestamp(self.fs.getFileStatus(self._path(p)).getModificationTime() / 1000, timezone.utc)


class Missing(ValueError):
    """A required column holds nulls."""


class Refused(ValueError):
    """A rule that a part was written under doesn't hold."""


class Rule(Protocol):
    """What can be asked of rows while they are written: an aggregate without distinct, and the findings its value makes."""

    value: Column
    findings: Callable


@dataclass
class State:
    """What a table is at a version: its parts with their rows (null: not known), deleted rows by table of
    positions, how far its sources were loaded, and the last batch of each writer that numbers its batches."""

    parts: dict[str, int | None] = field(default_factory=dict)
    hidden: dict[str, int] = field(default_factory=dict)
    marks: dict[str, str] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)


@dataclass
class Commit:
    """A change of a table, or its whole state at some versions, so that few changes are read to know a table."""

    add: dict[str, int | None] = field(default_factory=dict)
    drop: list[str] = field(default_factory=list)
    hide: dict[str, int] = field(default_factory=dict)
    show: list[str] = field(default_factory=list)
    marks: dict[str, str] = field(default_factory=dict)
    unmark: bool = False
    batches: dict[str, int] = field(default_factory=dict)
    state: dict | None = None

    def apply(self, old: State) -> State:
        if self.state is not None:
            return State(**self.state)
        gone, shown = set(self.drop), set(self.show)
        return State(
            {p: n for p, n in old.parts.items() if p not in gone} | self.add,
            {p: n for p, n in old.hidden.items() if p not in shown} | self.hide,
            ({} if self.unmark else old.marks) | self.marks,
            old.batches | self.batches,
        )


class Store:
    """Tables below a root. A table is a set of immutable parts; numbered pointers say what each version changed.

    A pointer is created, never changed, and counts once it is whole. So a crash at any moment leaves
    the old version or the new one, readers see the old rows or the new ones, a second writer of the same
    number fails, and a table may be written from its own content. A pointer holds what its version adds and
    drops, and every ``WHOLE`` versions the whole state, so that its size doesn't grow with the number of versions.

    Appends add a part. ``upsert`` adds a part of new and changed rows and a table of the positions of the rows
    that those replace, which readers leave out: bytes written follow the change. ``compact`` writes small
    parts and parts with deleted rows again; ``retain`` forgets old versions with their files; ``maintain`` does both.

    A writer that numbers its batches, as a stream does, gives (writer, number): a batch that is in the table already
    is not written again, as the number is committed together with the parts.

    A table with a ``partition`` (an SQL expression) is written in folders of its values; readers may name
    those they need, and ``replace_partitions`` leaves the others as they are.
    """

    #: Versions between two whole states; versions that ``maintain`` keeps; small parts and deleted rows it lets be.
    WHOLE, KEEP, SMALL_PARTS, HIDDEN_SHARE = 20, 50, 20, 0.1
    #: Bytes up to which a part is small.
    SMALL_BYTES = 64 << 20

    def __init__(self, spark: SparkSession, root: str, tables: dict[str, Table] | None = None):
        self.spark, self.root, self.tables = spark, root.rstrip("/"), TABLES if tables is None else tables
        self.files = Files(spark, self.root)
        self._known: dict[str, tuple[int, State]] = {}
        self.findings: dict[str, list] = {}  # of the rules of the last part of each table
        self._top: dict[str, int] = {}  # number of the last pointer, whole or not
        self._lost = False
        self._turn = threading.RLock()  # threads of one driver may append to one table

    def _dir(self, name: str) -> str:
        return f"{self.root}/{name.replace('.', '/')}"

    def _path(self, name: str, part: str) -> str:
        """Parts of a clone's origin have whole paths."""
        return part if "://" in part or part.startswith("/") else f"{self._dir(name)}/{part}"

    # pointers

    def _numbers(self, name: str) -> list[int]:
        """Numbers of pointers, the latest first, whole or not."""
        return sorted((int(f) for f in self.files.list(f"{self._dir(name)}/_pointers") if f.isdigit()), reverse=True)

    def _commit_of(self, name: str, number: int, base: bool = False) -> Commit | None:
        path = f"{self._dir(name)}/_pointers/{number:012d}{'.base' if base else ''}"
        text = self.files.read(path) if not base or self.files.exists(path) else ""
        return Commit(**json.loads(text.removesuffix(_END))) if text.endswith(_END) else None  # else a writer was stopped while it wrote

    def _held(self, name: str) -> list[tuple[int, State]]:
        """All versions that are held, from the oldest whole state, with their numbers."""
        out: list[tuple[int, State]] = []
        for n in reversed(self._numbers(name)):
            c = self._commit_of(name, n)
            if c is not None and not out and c.state is None:
                c = self._commit_of(name, n, base=True)
            if c is not None:
                out.append((n, c.apply(out[-1][1] if out else State())))
        return out

    def _newer(self, name: str, at: int, top: int) -> list[int]:
        """Numbers above a known version, the latest first. Numbers have no holes, so that few files are looked at, not all listed."""
        there = lambda n: self.files.exists(f"{self._dir(name)}/_pointers/{n:012d}")
        while there(top + 1):
            top += 1
        return list(range(top, at, -1))

    def _state(self, name: str) -> State:
        with self._turn:
            return self._look(name)

    def _look(self, name: str) -> State:
        at, state = self._known.get(name, (0, State()))
        if at and self.files.exists(f"{self._dir(name)}/_pointers/{at:012d}"):
            numbers = self._newer(name, at, self._top[name])
        else:  # not known yet, or forgotten since
            numbers, at, state = self._numbers(name), 0, State()
        newer: list[tuple[int, Commit]] = []
        for n in numbers:
            if n <= at:
                break
            if (c := self._commit_of(name, n)) is not None:
                if c.state is None and not at and (whole := self._commit_of(name, n, base=True)):
                    c = whole
                newer.append((n, c))
                if c.state is not None:
                    break
        for n, c in reversed(newer):
            at, state = n, c.apply(state)
        self._known[name], self._top[name] = (at, state), max([at, *numbers])
        return state

    def _commit(self, name: str, change: Commit) -> None:
        if self._lost:
            raise RuntimeError(f"the lock of {self.root} was taken over")
        with self._turn:
            state = change.apply(self._state(name))
            at, number = self._known[name][0], self._top[name] + 1
            if change.state is None and (not at or number % self.WHOLE == 0):
                change.state = asdict(state)
            self.files.write(f"{self._dir(name)}/_pointers/{number:012d}", json.dumps(asdict(change)) + _END, overwrite=False)
            self._known[name], self._top[name] = (number, state), number

    def note(self, name: str, key: str, text: str | None = None) -> str | None:
        """A text that a load keeps with a table, beside the marks; given one, it is written."""
        if text is not None:
            self._commit(name, Commit(marks={f"note.{key}": text}))
        return self._state(name).marks.get(f"note.{key}")

    def mark(self, name: str, source: str) -> datetime | None:
        """How far a source was loaded into the current version of a table."""
        found = self._state(name).marks.get(source)
        return datetime.fromisoformat(found) if found else None

    def batch(self, name: str, writer: str) -> int | None:
        """The last batch of a writer that the current version has."""
        return self._state(name).batches.get(writer)

    def _done(self, name: str, batch: tuple[str, int] | None) -> bool:
        return batch is not None and self._state(name).batches.get(batch[0], -1) >= batch[1]

    def exists(self, name: str) -> bool:
        self._state(name)
        return self._known[name][0] > 0

    def create(self, name: str) -> None:
        if not self.exists(name):
            self._commit(name, Commit())

    def bootstrap(self) -> None:
        """Create what is missing; running it again changes nothing."""
        for name in self.tables:
            self.create(name)

    def version(self, name: str) -> int:
        """How many versions are held; the current one has this number, the oldest one has 1."""
        return len(self._held(name))

    def parts(self, name: str) -> set[str]:
        """Parts of the current version."""
        return set(self._state(name).parts)

    def written(self, name: str, parts: Iterable[str] | None = None) -> int:
        """Rows of parts of the current version as they were written, deleted ones too; tables in partitions don't know them."""
        held = self._state(name).parts
        return sum(n or 0 for p, n in held.items() if parts is None or p in parts)

    # reading

    def read(self, name: str, version: int | None = None, partitions: Iterable[str] | None = None) -> DataFrame:
        """The current rows, or those of an earlier version (from 1); of some partitions only, if they are named."""
        state = self._state(name) if version is None else self._held(name)[version - 1][1]
        wanted = None if partitions is None else {f"{_PARTITION}={p}" for p in partitions}
        return self._rows(name, state, [p for p in state.parts if wanted is None or p.rpartition("/")[2] in wanted])

    def _rows(self, name: str, state: State, parts: Sequence[str], located: bool = False) -> DataFrame:
        """Rows of parts without the deleted ones; ``located``: with their file and place in it."""
        schema = self.tables[name].schema
        if not parts:
            rows = self.spark.createDataFrame([], schema)
            return rows.withColumns({"_file": F.lit(None).cast("string"), "_row": F.lit(None).cast("long")}) if located else rows
        rows = self.spark.read.schema(schema).parquet(*[self._path(name, p) for p in parts])
        if not located and not state.hidden:
            return rows
        rows = rows.select("*", F.substring_index("_metadata.file_path", "/", -2).alias("_file"), F.col("_metadata.row_index").alias("_row"))
        if state.hidden:
            hidden = self._hidden(name, state)
            rows = rows.join(bounded(hidden, sum(state.hidden.values()) * POSITION_BYTES), ["_file", "_row"], "left_anti")
        return rows if located else rows.select(*schema.names)

    def _hidden(self, name: str, state: State) -> DataFrame:
        """Files and places of deleted rows."""
        return self.spark.read.schema("_file string, _row long").parquet(*[self._path(name, p) for p in state.hidden])

    def partitions(self, name: str) -> list[str]:
        return sorted({p.rpartition(f"/{_PARTITION}=")[2] for p in self._state(name).parts if f"/{_PARTITION}=" in p})

    def partition_of(self, name: str, rows: DataFrame) -> list[str]:
        """The partitions that rows of a table belong to, as few as a table has."""
        return sorted(r[0] for r in rows.select(self._partition(name)).distinct().collect())

    def _partition(self, name: str) -> Column:
        return F.coalesce(F.expr(self.tables[name].partition).cast("string"), F.lit("none")).alias(_PARTITION)

    # writing

    def _checked(self, name: str, rows: DataFrame) -> DataFrame:
        table = self.tables[name]
        lacking = [c for c in table.columns if c not in rows.columns]
        if lacking:
            raise ValueError(f"{name} lacks {lacking}")
        return rows.select(*[F.col(c).cast(f.dataType).alias(c) for c, f in zip(table.columns, table.schema, strict=True)])

    def _part(self, name: str, rows: DataFrame, rules: Sequence[Rule] = ()) -> dict[str, int | None]:
        """Write a part; its rows, nulls where none may be, and what rules ask for are counted while it is written. A part
        that has such nulls, or of which a rule's findings make ``require`` raise, is removed."""
        part = f"part-{uuid.uuid4().hex}"
        path, table, seen = f"{self._dir(name)}/{part}", self.tables[name], Observation()
        checked = self._checked(name, rows)
        if table.partition:
            checked = checked.select("*", self._partition(name)).hint("rebalance", _PARTITION)
        bad = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in table.required], F.lit(False))
        checked = checked.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(bad).alias("bad"), *[r.value.alias(f"rule{i}") for i, r in enumerate(rules)])
        if table.partition:
            checked.write.partitionBy(_PARTITION).parquet(path)
        else:
            checked.write.parquet(path)
        found = seen.get
        if found["bad"]:
            self.files.delete(path)
            raise Missing(f"null in a required column of {name}")
        self.findings[name] = [f for i, r in enumerate(rules) for f in r.findings(found[f"rule{i}"])]
        worst = [f for f in self.findings[name] if not f.ok and f.severity == "ERROR"]
        if worst:
            self.files.delete(path)
            raise Refused("; ".join(f"{f.check}: {f.message}" for f in worst))
        if not found["rows"]:
            self.files.delete(path)
            return {}
        if not table.partition:
            return {part: found["rows"]}
        return {f"{part}/{f}": None for f in self.files.list(path) if f.startswith(f"{_PARTITION}=")}

    def append(self, name: str, rows: DataFrame, marks: dict[str, str] | None = None, batch: tuple[str, int] | None = None, rules: Sequence[Rule] = ()) -> None:
        if not self._done(name, batch):
            self._commit(name, Commit(add=self._part(name, rows, rules), marks=marks or {}, batches=dict([batch] if batch else [])))

    def replace(self, name: str, rows: DataFrame, marks: dict[str, str] | None = None, batch: tuple[str, int] | None = None) -> None:
        if not self._done(name, batch):
            new, old = self._part(name, rows), self._state(name)
            self._commit(name, Commit(new, list(old.parts), show=list(old.hidden), marks=marks or {}, batches=dict([batch] if batch else [])))

    def replace_partitions(self, name: str, rows: DataFrame, partitions: Iterable[str], marks: dict[str, str] | None = None) -> None:
        """The whole new content of these partitions; the others keep their files."""
        gone = {f"{_PARTITION}={p}" for p in partitions}
        new = self._part(name, rows)
        self._commit(name, Commit(new, [p for p in self._state(name).parts if p.rpartition("/")[2] in gone], marks=marks or {}))

    def upsert(self, name: str, delta: DataFrame, key: Sequence[str], compare: Sequence[str], update: Sequence[str] | None = None, sequence: Sequence[str] = (), marks: dict[str, str] | None = None, batch: tuple[str, int] | None = None) -> None:
        """Update rows whose compared columns differ, insert new keys, delete nothing, and write no other row.

        ``delta`` has one row for each key; ``update`` names the columns that an update writes (all but the key by
        default). With a ``sequence`` of columns a row is changed only by one whose sequence is greater (null
        least), and the sequence decides before ``compare``. A null key matches nothing. Of the table, the columns
        that decide are read; a delta of few bytes is broadcast, so that the table isn't shuffled.
        """
        if self._done(name, batch):
            return
        done = {"marks": marks or {}, "batches": dict([batch] if batch else [])}
        state, columns = self._state(name), list(self.tables[name].columns)
        if not state.parts:
            self._commit(name, Commit(add=self._part(name, delta), **done))
            return
        update = [c for c in (update or columns) if c not in key]
        with scratch():
            new = stable(self._checked(name, delta))
            n = new.count()
            if not n:
                self._commit(name, Commit(**done))
                return
            size = n * row_bytes(new)
            target = self._rows(name, state, list(state.parts), located=True).alias("t")
            on = reduce(lambda a, b: a & b, [F.col(f"t.{k}") == F.col(f"d.{k}") for k in key])
            differs = reduce(lambda a, b: a | b, [~F.col(f"t.{c}").eqNullSafe(F.col(f"d.{c}")) for c in compare], F.lit(False))
            if sequence:
                later = F.struct(*[F.col(f"d.{c}") for c in sequence]) > F.struct(*[F.col(f"t.{c}") for c in sequence])
                differs = differs & later
            pick = [F.col(f"d.{c}" if c in update or c in key else f"t.{c}").alias(c) for c in columns]
            met = stable(target.join(bounded(new, size).alias("d"), on).select(*pick, "t._file", "t._row", differs.alias("_changed")))
            changed = met.where("_changed")
            known = met.select(*key).distinct()
            fresh = new.alias("d").join(bounded(known, size).alias("t"), on, "left_anti")
            part = self._part(name, changed.select(*columns).unionByName(fresh.select(*columns)))
            hide, gone = f"gone-{uuid.uuid4().hex}", changed.count()
            if gone:
                changed.select("_file", "_row").write.parquet(f"{self._dir(name)}/{hide}")
            self._commit(name, Commit(part, hide={hide: gone} if gone else {}, **done))

    def truncate(self, name: str) -> None:
        old = self._state(name)
        self._commit(name, Commit(drop=list(old.parts), show=list(old.hidden), unmark=True))

    def reset(self) -> None:
        for name in self.tables:
            if self.exists(name):
                self.truncate(name)

    def restore(self, name: str, version: int) -> None:
        """Make an earlier version the current one. Batches that writers committed since stay committed."""
        then, now = self._held(name)[version - 1][1], self._state(name)
        drop, show = [p for p in now.parts if p not in then.parts], [p for p in now.hidden if p not in then.hidden]
        self._commit(name, Commit({p: n for p, n in then.parts.items() if p not in now.parts}, drop, {p: n for p, n in then.hidden.items() if p not in now.hidden}, show, then.marks, True))

    # upkeep

    def compact(self, name: str) -> bool:
        """Write again what there is need for, and nothing else; false if there is none.

        Small parts are joined if a table, or one of its partitions, has many. A part, or a partition, is written
        without its deleted rows once they are more than ``HIDDEN_SHARE`` of it. Positions of deleted rows stay few
        enough to be broadcast: beyond that, the parts with most of them are written again, until the rest are half as many.
        """
        state = self._state(name)
        held: dict[str, list[str]] = {}
        for p in state.parts:
            held.setdefault(_folder(p), []).append(p)
        chosen: set[str] = set()
        for own in held.values() if self.tables[name].partition else [list(state.parts)]:
            small = [p for p in own if p.startswith("part-") and self.files.bytes(self._path(name, p)) <= self.SMALL_BYTES] if len(own) > self.SMALL_PARTS else []
            chosen |= set(small) if len(small) > self.SMALL_PARTS else set()
        gone = self._gone(name, state)
        chosen |= {p for f in self._worn(name, state, held, gone) for p in held[f]}
        swept = {f for f in gone if chosen.issuperset(held.get(f, ()))}  # of parts that are written again or aren't there any more
        tidy = bool(swept) or len(state.hidden) > self.SMALL_PARTS
        if not chosen and not tidy:
            return False
        rest, hide = {f: n for f, n in gone.items() if f not in swept}, {}
        if tidy and rest:
            hide = {f"gone-{uuid.uuid4().hex}": sum(rest.values())}
            left = self._hidden(name, state)
            if swept:
                left = left.where(~unescaped(F.substring_index("_file", "/", 1)).isin(*swept))
            left.coalesce(1).write.parquet(self._path(name, next(iter(hide))))
        part = self._part(name, self._rows(name, state, sorted(chosen))) if chosen else {}
        self._commit(name, Commit(part, sorted(chosen), hide, list(state.hidden) if tidy else []))
        return True

    def _gone(self, name: str, state: State) -> dict[str, int]:
        """Deleted rows by the folder of their files: a part, or a partition."""
        if not state.hidden:
            return {}
        folder = unescaped(F.substring_index("_file", "/", 1)).alias("f")
        return {r["f"]: r["n"] for r in self._hidden(name, state).groupBy(folder).agg(F.count(F.lit(1)).alias("n")).collect()}

    def _worn(self, name: str, state: State, held: dict[str, list[str]], gone: dict[str, int]) -> set[str]:
        """Folders to write again for their deleted rows. Rows of partitions are counted, by the files' footers."""
        there = {f: n for f, n in gone.items() if f in held}
        rows = {f: sum(state.parts[p] or 0 for p in held[f]) for f in there if None not in [state.parts[p] for p in held[f]]}
        if counted := [self._path(name, p) for f in there if f not in rows for p in held[f]]:
            folder = unescaped(F.substring_index(F.substring_index("_metadata.file_path", "/", -2), "/", 1)).alias("f")
            rows |= {r["f"]: r["n"] for r in self.spark.read.schema(self.tables[name].schema).parquet(*counted).select(folder).groupBy("f").agg(F.count(F.lit(1)).alias("n")).collect()}
        worn = {f for f, n in there.items() if n > self.HIDDEN_SHARE * rows.get(f, 0)}
        left = sum(n for f, n in there.items() if f not in worn)
        if left * POSITION_BYTES > BROADCAST_BYTES:
            for f in sorted(there.keys() - worn, key=lambda f: (-there[f], f)):
                if left * POSITION_BYTES * 2 <= BROADCAST_BYTES:
                    break
                worn.add(f)
                left -= there[f]
        return worn

    def retain(self, name: str, keep: int, grace: timedelta = timedelta(0)) -> None:
        """Forget all but the last versions; files that no held version has, and that are older than ``grace``, are deleted."""
        held = self._held(name)[-keep:]
        if not held:
            return
        first, state = held[0]
        if self._commit_of(name, first).state is None:  # its whole state, beside the pointer, which isn't changed
            self.files.write(f"{self._dir(name)}/_pointers/{first:012d}.base", json.dumps(asdict(Commit(state=asdict(state)))) + _END)
        for n in self._numbers(name):
            if n < first:
                self.files.delete(f"{self._dir(name)}/_pointers/{n:012d}")
                self.files.delete(f"{self._dir(name)}/_pointers/{n:012d}.base")
        used = {p.partition("/")[0] for _, s in held for p in (*s.parts, *s.hidden)}
        before = datetime.now(timezone.utc) - grace
        for f in self.files.list(self._dir(name)):
            if f.startswith(("part-", "gone-")) and f not in used and self.files.changed(f"{self._dir(name)}/{f}") <= before:
                self.files.delete(f"{self._dir(name)}/{f}")

    def vacuum(self, name: str) -> None:
        """Forget all versions but the current one, with their files."""
        self.retain(name, 1)

    def maintain(self, name: str, keep: int | None = None, grace: timedelta = timedelta(hours=24)) -> None:
        """Compact where there is need; keep the last versions, and files that a reader or writer may still use."""
        self.compact(name)
        self.retain(name, keep or self.KEEP, grace)

    def clone(self, root: str, names: Iterable[str]) -> Store:
        """Another store with the current content of tables and no copy of their files: what is written there stays there."""
        other = Store(self.spark, root, {n: self.tables[n] for n in names})
        for n in other.tables:
            state = self._state(n)
            whole = lambda held, n=n: {self._path(n, p): k for p, k in held.items()}
            other._commit(n, Commit(state=asdict(State(whole(state.parts), whole(state.hidden), state.marks, state.batches))))
        return other

    def describe(self, name: str) -> DataFrame:
        """Columns of a table with their types, whether they are required, and their comments."""
        table = self.tables[name]
        rows = [(name, c, f.dataType.simpleString(), c in table.required, table.comment_of(c)) for c, f in zip(table.columns, table.schema, strict=True)]
        return self.spark.createDataFrame(rows, "table_name string, column_name string, type string, required boolean, comment string")

    def analyze(self, name: str) -> DataFrame:
        """Statistics of a table in one scan: rows, and of each column nulls, about how many values, least and greatest."""
        rows, table = self.read(name), self.tables[name]
        plain = [f.name for f in table.schema if f.dataType.typeName() not in ("array", "interval day to second")]
        each = [F.struct(F.lit(c).alias("column_name"), (F.count(F.lit(1)) - F.count(c)).alias("nulls"), F.approx_count_distinct(c).alias("values"), F.min(c).cast("string").alias("least"), F.max(c).cast("string").alias("greatest")) for c in plain]
        one = rows.agg(F.count(F.lit(1)).alias("n"), F.array(*each).alias("columns"))
        return one.select(F.lit(name).alias("table_name"), "n", F.explode("columns").alias("c")).select("table_name", "n", "c.*")

    # one writer

    @contextmanager
    def lock(self, stale: timedelta = timedelta(minutes=15)) -> Iterator[None]:
        """One writer at a time: surrogate keys rely on it.

        The lock names its owner and time, and a live owner renews it every third of ``stale``. An older one was left
        by a driver that died and is taken over; if its owner lives after all, its next commit fails. ``break_lock``
        removes one whose owner is known to be gone.
        """
        p, me = f"{self.root}/_lock", uuid.uuid4().hex
        says = lambda: json.dumps({"owner": me, "app": self.spark.sparkContext.applicationId, "at": datetime.now(timezone.utc).isoformat()})
        holder = lambda: json.loads(self.files.read(p) or "{}") if self.files.exists(p) else {}
        if self.files.exists(p):
            held = holder()
            since = datetime.fromisoformat(held["at"]) if "at" in held else None
            if since is None or datetime.now(timezone.utc) - since < stale:
                raise RuntimeError(f"{self.root} is locked by {held.get('owner', 'another load')} since {held.get('at', 'an unknown time')}")
            self.break_lock()
        self.files.write(p, says(), overwrite=False)
        ended = threading.Event()

        def renew() -> None:
            while not ended.wait(stale.total_seconds() / 3):
                if holder().get("owner") != me:
                    self._lost = True
                    return
                self.files.write(p, says())

        beat = threading.Thread(target=renew, daemon=True)
        beat.start()
        try:
            yield
        finally:
            ended.set()
            beat.join()
            self._lost = False
            if holder().get("owner") == me:
                self.files.delete(p)

    def break_lock(self) -> None:
        self.files.delete(f"{self.root}/_lock")
