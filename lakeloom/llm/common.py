"""What the operators of this subpackage share: reading, shared storage, Arrow helpers, digests.

Nothing here keeps state between executors: what a job reuses is written as Parquet below the
folder named by ``spark.checkpoint.dir``, so a lost executor costs its tasks and nothing else.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch; texts of up to a few hundred kB then need some ten MB a batch.
BATCH_ROWS = 512
#: Largest table, in bytes, that an operator broadcasts; its rows are counted first.
BROADCAST_BYTES = 32 << 20

#: CRC-32 in SQL: ``{bytes}`` is a list of bytes.
CRC32_SQL = "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {bytes}), lambda c, b: list_reduce(list_prepend(xor(c, b), CAST(range(8) AS BIGINT[])), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, CAST(3988292384 AS BIGINT)) ELSE x >> 1 END)), CAST(4294967295 AS BIGINT))"

_OWN_DIR: list[str] = []


def free(name: str, *frames: DataFrame) -> str:
    """A column name made from ``name`` that none of the frames has, whatever its case."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share; a local one only on a local master (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN_DIR:
        _OWN_DIR.append(tempfile.mkdtemp(prefix="lakeloom-"))
    return f"file://{_OWN_DIR[0]}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/lakeloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    held = df.sparkSession.read.schema(df.schema).parquet(path)
    held.held_at = path
    return held


def discard(*held: DataFrame) -> None:
    """Delete tables of ``materialise`` that nothing reads any more; what a result still reads stays."""
    for df in held:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.held_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Bound the memory of an Arrow batch by its rows, unless the session asks for fewer."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > BATCH_ROWS or int(spark.conf.get(key, "10000")) <= 0:
        spark.conf.set(key, str(BATCH_ROWS))


def map_arrow(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch, which gives one or several."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = f(batch)
            yield from (out,) if isinstance(out, pa.RecordBatch) else out

    return df.mapInArrow(run, schema)


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow string column as UTF-8; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def join_bounded(left: DataFrame, right: DataFrame, on: list[str], how: str, rows: int, row_bytes: int) -> DataFrame:
    """Join that broadcasts ``right`` only if its counted rows stay below BROADCAST_BYTES, else shuffles."""
    return left.join(F.broadcast(right) if rows * row_bytes <= BROADCAST_BYTES else right, on, how)


def several_texts(rows: DataFrame, key: str, payload: str) -> DataFrame:
    """Keys of ``rows`` whose payloads, compared byte by byte, are not all the same.

    Copies collapse before the shuffle, so a key with very many equal payloads sends one row a task.
    """
    return rows.groupBy(key, payload).agg(F.count("*").alias("_n")).groupBy(key).agg(F.count("*").alias("_texts")).where("_texts > 1").select(key)


def one_of_each(docs: DataFrame, keys: list[str]) -> DataFrame:
    """One row of each key (nulls are alike), whichever. No task gets all rows of a key.

    Rows are written with a number each; the least number of a key is found by partial sums, and
    only keys and numbers of rows with repeated keys are joined, then the numbers that go.
    """
    row, least, n = free("_row", docs), free("_least", docs), free("_n", docs)
    numbered = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    again = materialise(numbered.groupBy(*keys).agg(F.min(row).alias(least), F.count(F.lit(1)).alias(n)).where(F.col(n) > 1).drop(n), "repeated-keys")
    names = [free(f"_key{i}", numbered) for i in range(len(keys))]
    again = again.select(*[F.col(k).alias(x) for k, x in zip(keys, names, strict=True)], least)
    same = [numbered[k].eqNullSafe(again[x]) for k, x in zip(keys, names, strict=True)]
    small = again.count() * 150 <= BROADCAST_BYTES
    gone = materialise(numbered.select(row, *keys).join(F.broadcast(again) if small else again, same).where(F.col(row) != F.col(least)).select(row), "repeated-rows")
    return numbered.join(F.broadcast(gone) if gone.count() * 16 <= BROADCAST_BYTES else gone, row, "left_anti").select(*docs.columns)
