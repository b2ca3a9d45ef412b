"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that Python code handles at once; keeps a worker's memory small whatever the Arrow batch size is.
SLICE_ROWS = 256

# The two word definitions, as byte tables. A byte of 0x80 or more is part of a word in both.
#: Letters A-Z lowered; every ASCII character that is neither a letter nor a digit becomes a space.
ALNUM = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: Letters A-Z lowered; nothing else changes (bytes.split() then cuts at ASCII white space).
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: bytes | None) -> list[bytes]:
    """Lower-cased words of letters, digits and non-ASCII characters."""
    return text.translate(ALNUM).split() if text else []


def raw(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """A text column as UTF-8 bytes."""
    return column.cast(pa.large_binary()).to_pylist()


def map_slices(df: DataFrame, fn: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: T.StructType | str) -> DataFrame:
    """mapInArrow over slices of SLICE_ROWS rows. fn is called once in each task and returns the function for slices.

    What the function remembers goes with the task: an idle worker keeps no memory of it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = fn()
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, SLICE_ROWS):
                    if (out := one(batch.slice(at, SLICE_ROWS))) is not None:
                        yield out
        finally:
            one = batch = out = None
            given_back()

    return df.mapInArrow(run, schema)


def given_back() -> None:
    """Let the system have the memory that this worker no longer uses."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def named(column: str) -> Column:
    """A column by its whole name, which may have dots."""
    return F.col("`" + column.replace("`", "``") + "`")


def free_name(taken: list[str], name: str) -> str:
    """name, with underscores in front until no column of that name exists (names compare without case)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share.

    Only a local master without that setting, as in tests, gets a temporary folder of its own.
    """
    sc = spark.sparkContext
    shared = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir") or _LOCAL.get(sc.applicationId)
    if not shared:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = _LOCAL[sc.applicationId] = tempfile.mkdtemp(prefix="checkpoints-")
    return shared


_LOCAL: dict[str, str] = {}
#: Where this process has tables in shared folders.
_WRITTEN: dict[str, str] = {}


def materialize(df: DataFrame, **seen: Column) -> DataFrame:
    """Cut the lineage: write a table in the shared folder and read it; later jobs read the columns that they need.

    Lost executors lose none of it, and plans don't grow over iterations, as constraints and statistics start anew.
    A table stays until discard() or the end of the process. seen: sums over the rows, which are taken while they are
    written; the result's attribute `seen` has them.
    """
    spark = df.sparkSession
    if not _WRITTEN:
        atexit.register(_discard_all)
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    watch = Observation() if seen else None
    (df.observe(watch, *(c.alias(k) for k, c in seen.items())) if watch else df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.seen = watch.get if watch else {}
    _WRITTEN[path] = spark.sparkContext.applicationId
    out.written = path
    return out


def on_split_key(left: DataFrame, sums: DataFrame, key: str) -> DataFrame:
    """left joined with sums, which are made by a groupBy of the key.

    By the key alone Spark would join sums where they were made, and then can't split the rows of a key that most rows
    of left have. The key's hash is a second key, so that both sides are dealt anew.
    """
    h = free_name([*left.columns, *sums.columns], "h")
    return left.withColumn(h, F.xxhash64(key)).join(sums.withColumn(h, F.xxhash64(key)), [key, h]).drop(h)


def delete_folder(spark: SparkSession, path: str) -> None:
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(jsc.hadoopConfiguration()).delete(place, True)


def discard(df: DataFrame) -> None:
    """Delete a table that materialize() wrote. Nothing that is made of it may run any more."""
    if (path := df.__dict__.get("written")) and _WRITTEN.pop(path, None):
        delete_folder(df.sparkSession, path)


def _discard_all() -> None:
    """At the end of the process, what its live session has written goes."""
    spark = SparkSession.getActiveSession()
    if spark is None or spark.sparkContext._jsc is None:
        return
    for path in [p for p, app in _WRITTEN.items() if app == spark.sparkContext.applicationId]:
        delete_folder(spark, path)
