"""Intermediate tables in the folder that driver and executors share.

Iterative operators cut their lineage here: a table written as Parquet under
``spark.checkpoint.dir`` survives the loss of any executor, keeps column pruning
and, unlike a cached block, is never computed twice.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

#: Bytes of a row group of intermediate tables: what a writer holds in memory.
ROW_GROUP = 32 << 20
#: Setting of how many rows Spark's Parquet reader holds.
READ_ROWS = "spark.sql.parquet.columnarReaderBatchSize"
#: Most rows that ``small_side`` lets Spark broadcast.
BROADCAST_ROWS = 200_000
#: Setting by which Spark multiplies the size of files to estimate that of their rows, and what it is here at least: rows
#: of voxels take one or two bytes in Parquet and about eighty in a hash table.
FILE_FACTOR, LEAST_FACTOR = "spark.sql.sources.fileCompressionFactor", 40.0
#: Setting of how many partitions a shuffle has, and of how many rows one of them has to hold on average at most.
PARTITIONS, TASK_ROWS = "spark.sql.shuffle.partitions", 500_000
#: Paths staged inside of the open ``scratch`` blocks, innermost last.
_open: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session; one of our own only where none is set (tests)."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="voxtable-"))
        path = sc.getCheckpointDir()
    return path.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/voxtable/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and return it reread: lineage ends there."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path  # type: ignore[attr-defined]
    if _open:
        _open[-1].append(path)
    return out


def honest_sizes(spark: SparkSession) -> None:
    """From now on the session doesn't take compressed voxels for small tables; a higher factor of the user's stays.

    What is small in truth AQE still broadcasts, by the bytes that were shuffled.
    """
    if float(spark.conf.get(FILE_FACTOR)) < LEAST_FACTOR:
        spark.conf.set(FILE_FACTOR, str(LEAST_FACTOR))


def enough_partitions(spark: SparkSession, rows: int) -> None:
    """From now on shuffles of the session have partitions for tables of so many rows; a higher number of the user's stays.

    With a fixed number the hash tables of a task grow with the input. AQE puts small partitions together, by bytes.
    """
    least = -(-rows // TASK_ROWS)
    if int(spark.conf.get(PARTITIONS)) < least:
        spark.conf.set(PARTITIONS, str(least))


def staged_rows(df: DataFrame, label: str = "stage") -> DataFrame:
    """``staged``, but above BROADCAST_ROWS rows the table is joined by sorting, however small its files are.

    Spark estimates by the files, so that it would send tables of millions of voxels through
    the driver. Unions and semi-joins forget such a mark; ``honest_sizes`` is for them.
    """
    honest_sizes(df.sparkSession)
    rows = Observation()
    out = staged(df.observe(rows, F.count(F.lit(1)).alias("n")), label)
    n = rows.get.get("n", 0)
    out = sorted_side(out, n)
    out._rows = n  # type: ignore[attr-defined]
    return out


def sorted_side(df: DataFrame, rows: int) -> DataFrame:
    """``df``, which has so many rows, marked for sorted joins if they are too many to broadcast."""
    if rows <= BROADCAST_ROWS:
        return df
    out = df.hint("merge")
    if hasattr(df, "_staged_path"):
        out._staged_path = df._staged_path  # type: ignore[attr-defined]
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop_staged(df: DataFrame) -> None:
    """Delete what ``staged`` wrote for ``df``; nothing may read it afterwards."""
    path = getattr(df, "_staged_path", None)
    if path:
        _delete(df.sparkSession, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables staged inside are deleted at the end, save those given to the function it yields.

    What is read after the block must stem from kept tables or from tables of outside.
    """
    paths: list[str] = []
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._staged_path)  # type: ignore[attr-defined]
        return df

    _open.append(paths)
    try:
        yield keep
    finally:
        _open.pop()
        for path in paths:
            if path not in kept:
                _delete(spark, path)
            elif _open:
                _open[-1].append(path)


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows, else as it is.

    ``df`` should be staged: its rows are counted, unless ``staged_rows`` has done so.
    """
    known = getattr(df, "_rows", None)
    n = df.limit(rows + 1).count() if known is None else known
    return F.broadcast(df) if n <= rows else df


@contextmanager
def arrow_batches(spark: SparkSession, rows: int = 512, size: str = "1m") -> Iterator[None]:
    """Jobs run inside exchange Arrow batches of about ``size`` and at most ``rows`` rows with Python, and read so many
    rows at a time: whole texts are long rows."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": size, READ_ROWS: str(rows)}
    before = {key: spark.conf.get(key) for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


#: What one operator keeps between the batches and tasks of a Python worker.
_resident: dict = {}


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def resident(key, build: Callable[[], object]):
    """The caches ``key`` of this Python worker; those of another operator go, as workers serve one after the other."""
    if key not in _resident:
        _resident.clear()
        gc.collect()
        _give_back()
        _resident[key] = build()
    return _resident[key]


def trimmed(batches: Iterator) -> Iterator:
    """``batches`` of a Python task; after each one the memory that its rows took returns to the system."""
    for batch in batches:
        yield batch
        del batch
        _give_back()


def packed(df: DataFrame, **more) -> DataFrame:
    """All columns of ``df`` in one struct ``_row`` beside new ones, so that no names clash."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]) if df.columns else F.struct(F.lit(None).alias("_"))
    return df.select(row.alias("_row"), *[c.alias(k) for k, c in more.items()])


def unpacked(df: DataFrame) -> DataFrame:
    """The columns that ``packed`` put away."""
    return df.select("_row.*")
