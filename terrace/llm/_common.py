"""What the operators of this subpackage share: tables, intermediate tables in the shared folder, and bounded Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes in an Arrow batch. Both are bounds on the memory of a Python worker, not on what is read.
BATCH_ROWS, BATCH_BYTES = 1_000, 4 << 20

#: Spark's setting under which a query's shuffle files are deleted when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Texts may be very long: what goes to Python at once is bounded by rows and by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir. Only where it is unset on a single machine, as in tests, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='terrace-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Write df as Parquet to the shared folder and read it back: lineage ends there, a lost executor loses nothing, and the write's shuffles go as it ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete tables that cut() wrote and that no later frame reads."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class _Worker:
    """The operator that keeps things in this Python worker. Workers live longer than an operator's tasks."""

    module: str | None = None


def settle(module: str) -> None:
    """From here on this Python worker works for the operator in `module`: what the one before has kept goes, by its module's forget(), and its memory is given back."""
    if _Worker.module not in (None, module):
        getattr(sys.modules.get(_Worker.module), "forget", lambda: None)()
        give_back()
    _Worker.module = module


def give_back() -> None:
    """What this Python worker has freed goes back to the machine, where other workers and the JVM need it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        getattr(ctypes.CDLL(None), "malloc_trim", lambda _: None)(0)


def in_worker(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """f for mapInArrow or mapInPandas, as a task of its module's operator that leaves no freed memory behind."""
    module = f.__module__

    def run(batches: Iterator) -> Iterator:
        settle(module)
        try:
            yield from f(batches)
        finally:
            give_back()

    return run


def over_batches(df: DataFrame, f: Callable[[dict[str, list]], dict[str, list] | None], schema: str, arrow: pa.Schema) -> DataFrame:
    """df's rows through f, one bounded batch of Python lists at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and (out := f({n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)})) is not None:
                yield pa.RecordBatch.from_pydict(out, schema=arrow)

    run.__module__ = f.__module__
    return df.mapInArrow(in_worker(run), schema)
