"""What the training-data operators share: reading tables, shared-folder tables, Arrow blocks."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship

#: Rows in one Arrow batch; long texts make larger batches fill a worker's memory.
BATCH_ROWS = 512
BATCH_BYTES = 4 << 20
#: Level of zstd for tables that are read again: a writer's window outside the heap is 0.5 MB instead of 2.
LEVEL = "1"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Sends the package to the executors; small Arrow batches, so that a batch of long texts stays a few megabytes."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


@contextlib.contextmanager
def batch_rows(spark: SparkSession, n: int) -> Iterator[None]:
    """Other Arrow batches for what is written inside."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(n))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def shared_dir(spark: SparkSession) -> str:
    """A folder that driver and executors all see: spark.checkpoint.dir. Where that is unset, a temporary one in local mode (tests); on a cluster an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        spark.conf.set("spark.checkpoint.dir", base)
        atexit.register(shutil.rmtree, base.removeprefix("file://"), ignore_errors=True)
    return base.rstrip("/")


#: Tables that each open scratch() made: their folders.
_scratch: ContextVar[tuple[list[str], ...]] = ContextVar("scratch", default=())
#: The catalog's name of tables that have one, by folder.
_names: dict[str, str] = {}


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are deleted at the end, but for those written with keep: a result may depend on these alone."""
    made: list[str] = []
    token = _scratch.set((*_scratch.get(), made))
    try:
        yield
    finally:
        _scratch.reset(token)
        for folder in made:
            _delete(spark, folder)
        gc.collect()
        spark._jvm.System.gc()  # plans that are gone give up their shuffle files


def _delete(spark: SparkSession, folder: str) -> None:
    if folder in _names:
        spark.sql(f"DROP TABLE IF EXISTS {_names.pop(folder)}")
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _folder(spark: SparkSession, tag: str, keep: bool = False) -> str:
    path = f"{shared_dir(spark)}/tessera/{tag}-{uuid.uuid4().hex}"
    open_ = _scratch.get()
    if open_:
        # what a step keeps goes with the scratch around it
        if not keep:
            open_[-1].append(path)
        elif len(open_) > 1:
            open_[-2].append(path)
    return path


def materialise(df: DataFrame, tag: str, codec: str = "zstd", keep: bool = False) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: lineage is cut and a lost executor loses nothing."""
    spark = df.sparkSession
    path = _folder(spark, tag, keep)
    df.write.option("compression", codec).option("parquet.compression.codec.zstd.level", LEVEL).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, tag: str, column: str, codec: str = "zstd") -> DataFrame:
    """Like materialise, dealt by a column, so that joins on it don't shuffle the table again. df is partitioned by that column already."""
    spark = df.sparkSession
    path, name = _folder(spark, tag), f"tessera_{tag}_{uuid.uuid4().hex}"
    _names[path] = name
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.option("compression", codec).option("parquet.compression.codec.zstd.level", LEVEL).option("path", path).bucketBy(n, column).saveAsTable(name)
    return spark.table(name)


def drop(df: DataFrame) -> None:
    """Deletes the files of a materialised table that nothing reads any more."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, folder)


def long_id(docs: DataFrame, col: str) -> Column:
    """An id column as bigint. Ids of operators that compare rows are whole numbers; others raise an error at once instead of becoming null."""
    if not isinstance(docs.schema[col].dataType, T.IntegralType):
        raise TypeError(f"{col} holds {docs.schema[col].dataType.simpleString()}, not whole numbers")
    return F.col(col).cast("long")


#: What clears each cache that a Python worker keeps from task to task.
_caches: dict[str, Callable[[], None]] = {}


def cache(name: str, clear: Callable[[], None]) -> None:
    _caches[name] = clear


def settle(keep: str = "") -> None:
    """Called as a task begins in a Python worker: caches of other operators, which ran in this worker before, are given up, and their memory goes
    back to the system."""
    for name, clear in _caches.items():
        if name != keep:
            clear()
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def blocks(batches: Iterator[pa.RecordBatch], text: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts and joins batches by rows so that each holds about `limit` bytes of `text`; a longer text stands alone. Nulls become empty."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(text)
        col = batch.column(at)
        if col.null_count:
            batch = batch.set_column(at, text, pc.fill_null(col, ""))
            col = batch.column(at)
        ends = pc.cumulative_sum(pc.cast(pc.binary_length(col), pa.int64())).to_numpy()
        lo, before = 0, 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(ends.searchsorted(before + limit - size, side="right"))) if size < limit else lo
            hi = min(hi, batch.num_rows)
            if hi > lo:
                part = batch.slice(lo, hi - lo)
                size += int(ends[hi - 1]) - before
                before, lo = int(ends[hi - 1]), hi
                held.append(part)
            if size >= limit or lo < batch.num_rows:
                yield _joined(held)
                held, size = [], 0
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    if len(held) == 1:
        return held[0]
    return pa.concat_batches(held)
