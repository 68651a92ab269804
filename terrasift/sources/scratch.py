"""A folder for tables and documents between jobs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A fresh path in the folder that the driver and all executors share: the one that ``spark.checkpoint.dir`` names."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="terrasift-")  # a single machine, as in tests
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/s{uuid.uuid4().hex}"


def staged(rows: DataFrame) -> DataFrame:
    """``rows`` as a written table: the plan of what follows starts there, and lost executors don't matter."""
    path = shared_dir(rows.sparkSession)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


#: Rows and bytes of documents that go to Python at once at most: what they are parsed into is many times larger.
BATCH_ROWS, BATCH_BYTES = 32, 4 << 20


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs within send documents to Python in small batches; the session's own settings hold again afterwards."""
    own = {}
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        own[key] = spark.conf.get(key)
        now = int(own[key]) if own[key].isdigit() else 0
        spark.conf.set(key, str(min(now, most) if now > 0 else most))
    try:
        yield
    finally:
        for key, value in own.items():
            spark.conf.set(key, value)


def parsed_once(rows: DataFrame) -> DataFrame:
    """``staged`` for narrow rows that parsing gives: it runs once, in small batches. A stream stays as it is."""
    if rows.isStreaming:
        return rows
    with small_batches(rows.sparkSession):
        return staged(rows)
