"""Steps of iterative operators, computed once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

#: Rows that a task is meant to hold where the number of partitions follows the table.
ROWS_A_TASK = 1 << 18


def parts_of(rows: int) -> int:
    """Partitions for so many rows, so that the memory of a task does not grow with the table."""
    return 1 + rows // ROWS_A_TASK


def kept(frame: DataFrame, *before: DataFrame) -> DataFrame:
    """The frame, computed once: as a table in the checkpoint folder where a session has one (``spark.checkpoint.dir``),
    which survives lost executors and cuts the lineage, else in the cache, from which lost parts are computed again.

    ``before`` are steps made in the same way that nothing but this one reads; once this one is there they are let go.
    """
    spark = frame.sparkSession
    root = spark.sparkContext.getCheckpointDir()
    if not root:
        out = frame.persist()
        cached = [b for b in before if b.is_cached]
        if cached:
            out.count()
        for b in cached:
            b.unpersist()
        return out
    path = f"{root}/step-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    out = spark.read.schema(frame.schema).parquet(path)
    out._step_path = path  # type: ignore[attr-defined]
    for old in filter(None, (getattr(b, "_step_path", None) for b in before)):
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(old)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    return out
