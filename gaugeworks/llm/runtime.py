"""What the operators share: the cluster's shared folder, materialised steps, bounded Arrow batches."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Callable, Hashable
from functools import reduce
from operator import and_
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch sent to Python workers. Spark's default of 10,000 rows
#: of long texts would hold hundreds of MB at once. Batches also end at so many bytes.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20

_created: dict[str, set[str]] = {}
_held: dict[Hashable, Any] = {}


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, in rows and in bytes, unless the user has chosen sizes of their own."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(rows) == "10000":
        spark.conf.set(rows, str(BATCH_ROWS))
        spark.conf.set(size, str(BATCH_BYTES))


def held(key: Hashable, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps from task to task: one thing at a time, so that a worker which Spark
    uses again for the next operator lets go of the last one's tables and memos."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def shared_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which all executors share.

    Where the setting is absent (local tests), one temporary folder is chosen
    and recorded in the session, so that later calls use the same one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='spark-gauge-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/gauge-{uuid.uuid4().hex[:12]}"
    if spark.sparkContext.applicationId not in _created:
        _created[spark.sparkContext.applicationId] = set()
        atexit.register(_remove, spark)
    _created[spark.sparkContext.applicationId].add(path)
    return path


def _remove(spark: SparkSession) -> None:
    """Delete the session's folders when Python ends, if the session is still there."""
    try:
        for path in _created.get(spark.sparkContext.applicationId, ()):
            drop(spark, path)
    except Exception:  # noqa: BLE001 - the JVM may be gone already; the files are scratch
        return


def drop(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system it lies."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage at a table that survives lost executors, and freezes
    values which a recomputation could choose otherwise (names, identifiers).
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._gauge_path = path  # type: ignore[attr-defined]
    return out


def release(df: DataFrame | None) -> None:
    """Delete a table made by ``materialise`` that nothing reads any more."""
    path = getattr(df, "_gauge_path", None)
    if path:
        drop(df.sparkSession, path)


def without_rows(docs: DataFrame, keys: list[Column], gone: DataFrame, tied: DataFrame) -> DataFrame:
    """``docs`` without the rows whose ``keys`` are in ``gone``, and with one row for each key in ``tied``.

    Columns of the two tables stand for the keys in their order; ``docs`` may have any names.
    The tables grow with ``docs``, so the join is one by sorting at every size, never a broadcast.
    """
    names = [f"_{i}_{uuid.uuid4().hex[:8]}" for i in range(len(keys))]
    tied = materialise(tied.toDF(*names))

    def met(keyed: DataFrame) -> Column:
        return reduce(and_, (k.eqNullSafe(keyed[n]) for k, n in zip(keys, names, strict=True)))

    dropped = materialise(gone.toDF(*names))
    if not tied.head(1):
        return docs.join(dropped.hint("merge"), met(dropped), "left_anti")
    either = dropped.unionByName(tied)
    one = docs.join(tied, met(tied), "left_semi").withColumns(dict(zip(names, keys, strict=True))).dropDuplicates(names)
    return docs.join(either.hint("merge"), met(either), "left_anti").union(one.select(*(F.col(f"`{c}`") for c in docs.columns)))


def sweep(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of plans that are done.

    The cleaner acts when the driver collects its garbage, which a quiet driver
    hardly does; operators of many steps call this so that the disk holds the
    shuffles of one step rather than of all.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the corpus tables, through Spark's reader (any Hadoop path works)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, null counting as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def strings(column: pa.Array) -> list[str]:
    """Python strings of an Arrow column, null counting as empty."""
    return ["" if x is None else x for x in column.to_pylist()]
