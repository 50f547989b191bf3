"""Helpers that the training-data operators share: tables, shared scratch tables, distributed ranks."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator
from types import TracebackType

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

ROWS_PER_BUCKET = 20_000
BROADCAST_ROWS = 500_000  # keys at most that go to every executor
#: Batches between Spark and Python: rows hold whole texts, and batches live outside the heap.
BATCH_ROWS, BATCH_BYTES = 1_000, 4 << 20
RELEASED = 16  # batches after which a Python worker gives unused memory back
#: Shuffle files of a scratch table's job go as soon as the table is written, not when the driver collects its garbage.
_CLEAN = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
_own_dirs: dict[str, str] = {}
_kept: dict[str, SparkSession] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory; any path that Spark can read."""
    modest_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def modest_batches(spark: SparkSession) -> None:
    """Bound the session's batches between Spark and Python, unless they are smaller already."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        held = spark.conf.get(key, None)
        if held is None or not held.isdigit() or not 0 < int(held) <= most:
            spark.conf.set(key, str(most))


def give_back() -> None:
    """Return memory that Arrow and the C library hold but don't use: Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def thrifty(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of batches that gives unused memory back after each ``RELEASED`` batches and at its end."""

    @functools.wraps(run)
    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, batch in enumerate(run(batches), 1):
            yield batch
            if k % RELEASED == 0:
                give_back()
        give_back()

    return own


@contextlib.contextmanager
def settings(spark: SparkSession, held: dict[str, str]) -> Iterator[None]:
    """Settings that hold within the block only."""
    before = {k: spark.conf.get(k, None) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session may go without that setting; it then gets a temporary folder of its own.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        own = tempfile.TemporaryDirectory(prefix="glyphloom-")
        atexit.register(own.cleanup)
        _own_dirs[app] = own.name
    return f"file://{_own_dirs[app]}"


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _written(df: DataFrame, label: str, *more: Column) -> tuple[DataFrame, str, dict[str, int]]:
    """The table, its path, and what was observed of its rows while they were written: ``rows`` and ``more``."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    seen = Observation(path)
    with settings(spark, _CLEAN):
        df.observe(seen, F.count(F.lit(1)).alias("rows"), *more).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path, seen.get


def materialise(df: DataFrame, label: str) -> DataFrame:
    """A scratch table that an operator's result reads: written as Parquet and read back, until ``forget`` deletes it."""
    out, path, _ = _written(df, label)
    _kept[path] = df.sparkSession
    return out


class Scratch:
    """Tables that an operator writes to the shared folder on its way.

    A table cuts lineage, so that a lost executor costs no recomputation, and fixes one evaluation of a plan that is used
    several times. When the block ends, all tables go but those that the result still reads (``keep``).
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: dict[int, tuple[DataFrame, str, dict[str, int]]] = {}

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, kind: type[BaseException] | None, error: BaseException | None, trace: TracebackType | None) -> None:
        self.drop(*(df for df, *_ in list(self.tables.values())))

    def table(self, df: DataFrame, label: str, *more: Column) -> DataFrame:
        """Write ``df`` as Parquet and read it back; its rows are counted, and ``more`` (named aggregates) taken, on the way."""
        out, path, seen = _written(df, label, *more)
        self.tables[id(out)] = (out, path, seen)
        return out

    def seen(self, df: DataFrame) -> dict[str, int]:
        """What was observed of a table: ``rows`` and what else was asked for."""
        return self.tables[id(df)][2]

    def small(self, df: DataFrame, *columns: Column, most: int = BROADCAST_ROWS) -> DataFrame:
        """A table of keys (or ``columns`` of it), broadcast if it has no more than ``most`` rows; a larger one is shuffled."""
        own = df.select(*columns) if columns else df
        return F.broadcast(own) if self.seen(df)["rows"] <= most else own

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more; others are left alone."""
        for df in tables:
            held = self.tables.pop(id(df), None)
            if held is not None:
                _delete(self.spark, held[1])

    def keep(self, df: DataFrame) -> DataFrame:
        """Leave a table to the caller, whose result reads it; ``forget`` deletes it."""
        _, path, _ = self.tables.pop(id(df))
        _kept[path] = self.spark
        return df


def kept() -> set[str]:
    """Scratch tables that results still read."""
    return set(_kept)


def forget(paths: set[str]) -> None:
    """Delete kept tables whose results have been written elsewhere."""
    for path in paths & set(_kept):
        _delete(_kept.pop(path), path)


def bucket_count(rows: int) -> int:
    """Buckets that keep about ``ROWS_PER_BUCKET`` rows each; grows with the data."""
    return max(64, -(-rows // ROWS_PER_BUCKET))


def rank_within(df: DataFrame, keys: list[str], order: list[str], rows: int, out: str) -> DataFrame:
    """Gapless ranks from 0 within each key, without bringing a key's rows together.

    Rows are dealt to hash buckets of ``order``; a bucket's rows are numbered where they are and the
    bucket's start is a running sum over the (small) table of bucket counts. Rows that agree in ``order``
    get different ranks in any order.
    """
    n = bucket_count(rows)
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(n)).cast("int"))
    by = [*keys, "_bucket"]
    starts = (
        dealt.groupBy(*by)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn(
            "_start",
            F.coalesce(
                F.sum("_n").over(Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)),
                F.lit(0).cast("long"),
            ),
        )
        .drop("_n")
    )
    numbered = dealt.withColumn("_row", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    same = [numbered[k].eqNullSafe(starts[k]) for k in by]
    kept = [numbered[c] for c in df.columns]
    return numbered.join(starts, same).select(*kept, (starts["_start"] + numbered["_row"] - 1).cast("long").alias(out))


def utf8(text: str | Column) -> Column:
    """A text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary")
