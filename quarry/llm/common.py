"""What the corpus operators share: the shared folder, stored tables, batches of text, names that can't clash."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from weakref import WeakKeyDictionary

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are handed to numpy in slices of about this many bytes, whatever the size of an Arrow batch.
SLICE_BYTES = 1 << 20
#: Stored tables of a number and little more are broadcast up to this many rows and joined by shuffle beyond.
BROADCAST_ROWS = 1 << 19


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir. Where that is unset: a temporary folder if all
    runs on this machine, else one in the warehouse, which all executors see."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and context.master.startswith("local"):
            named = tempfile.mkdtemp(prefix="quarry-")
        context.setCheckpointDir(named or f"{spark.conf.get('spark.sql.warehouse.dir')}/quarry-scratch")
    return context.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """The rows of df, computed once and kept in the shared folder, by column: lineage ends here, lost executors lose nothing,
    and later reads take only the columns they need."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def discard(*tables: DataFrame) -> None:
    """Deletes stored() tables of which all that depends on them is stored itself; other DataFrames are left alone."""
    for table in tables:
        if (path := _PATHS.pop(table, None)) is not None:
            spark = table.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def few(rows: DataFrame) -> DataFrame:
    """A stored table of narrow rows, broadcast where its count is small, so that what it meets is not shuffled; its keys' hot
    values then meet in no task."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def quoted(name: str) -> Column:
    """The column of that very name, dots and backticks included."""
    return F.col(f"`{name.replace('`', '``')}`")


def fresh(df: DataFrame, name: str) -> str:
    """A column name like this that df hasn't."""
    return name if name not in df.columns else name + "_" * max(map(len, df.columns))


def shielded(run: Callable[..., DataFrame], own: tuple[str, ...] = ("doc_id", "text", "lang", "source", "n_chars")) -> Callable[..., DataFrame]:
    """run(spark, docs, sf_dir) with every column but own under a name that nothing uses while it runs, so that no column of an
    operator takes the place of one of docs; all come back in their order, under their names."""

    def wrapped(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = [c if c in own else f"__extra_{i}" for i, c in enumerate(docs.columns)]
        out = run(spark, docs.toDF(*names), sf_dir)
        return out.select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)))

    wrapped.__doc__ = run.__doc__
    return wrapped


def map_text(df: DataFrame, run: Callable, schema: object) -> DataFrame:
    """df.mapInArrow(run, schema) for rows that may be long (Spark bounds the bytes of a batch, and slices() what numpy gets of
    it); a worker, which lives on between tasks, gives freed memory back at a task's end."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(task, schema)


def give_back() -> None:
    """Returns what the allocators hold free to the system, where they can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def sampled(df: DataFrame, key: Column, rows: int, of: int) -> DataFrame:
    """The rows of least hashed key, about four times as many as wanted of a table of that size, so that a top-k after it
    sends little from each partition."""
    parts = 1 << 30
    most = parts if of <= 4 * rows else max(1, 4 * rows * parts // of)
    return df.where(F.pmod(F.xxhash64(key, F.lit(29)), F.lit(parts)) < most)


def slices(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """A batch in row slices whose text column holds about SLICE_BYTES each; a longer text is a slice of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for row, size in enumerate(sizes):
        if row > start and total + size > SLICE_BYTES:
            yield batch.slice(start, row - start)
            start, total = row, 0
        total += int(size)
    if len(sizes) > start:
        yield batch.slice(start)


def to_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo folds; -1 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds, F.lit(-1))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
