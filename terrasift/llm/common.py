"""Helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import functools
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
#: ``bytes.translate`` table that lower-cases A-Z and leaves other bytes alone.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACES = bytes(32 if 9 <= b <= 13 else b for b in LOWER)


#: Rows of an Arrow batch where it would be Spark's default of 10,000: texts are long.
BATCH_ROWS = 4000
#: Bytes of an Arrow batch of operators that need no large ones.
BATCH_BYTES = 4 << 20

_held: dict[str, object] = {}


def once(name: str, make: Callable[[], object]) -> object:
    """What ``make`` gives, kept by this Python worker until another name is asked for."""
    if name not in _held:
        _held.clear()
        _held[name] = make()
    return _held[name]


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over a task's batches, after which the worker gives unused memory back to the machine.

    Idle workers stay, and each stage may use other ones.
    """

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return wrapped


def lean_table(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """``run`` over a group's table, likewise."""

    def wrapped(table: pa.Table) -> pa.Table:
        out = run(table)
        give_back()
        return out

    return wrapped


def give_back() -> None:
    """Unused memory goes back to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def map_batches(rows: DataFrame, run: Callable[[Iterator], Iterator], schema, batch_bytes: int | None = None) -> DataFrame:
    """``mapInArrow`` with small batches, from now on of ``batch_bytes`` at most if given, and workers that stay small."""
    conf, name = rows.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(name, "10000") == "10000":
        conf.set(name, str(BATCH_ROWS))
    if batch_bytes:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(batch_bytes))
    return rows.mapInArrow(lean(run), schema)


def broadcast_key(name: str, shared) -> str:
    return f"{name}-{getattr(shared, 'id', None) or id(shared)}"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone, a null text as the empty one."""
    return docs.select(docs["doc_id"].alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def shared_dir(spark: SparkSession) -> str:
    """A fresh path in the folder that all executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        # a single machine, as in tests
        root = tempfile.mkdtemp(prefix="terrasift-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/t{uuid.uuid4().hex}"


def written(df: DataFrame, path: str | None = None, partition_by: list[str] | None = None) -> DataFrame:
    """``df`` as a table in the shared folder: its lineage ends there, and lost executors don't matter."""
    spark = df.sparkSession
    path = path or shared_dir(spark)
    writer = df.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lower_words(text: str) -> list[bytes]:
    """White-space separated words in UTF-8, A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").translate(_SPACES).split()


def running_total(rows: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """Adds ``name``, the sum of ``value`` over all rows before, ``part`` and ``rank``, a row's place within its part.

    Ranges of rows are summed each by itself; the sums of ranges, one for each partition, are added up by the driver.
    """
    spark = rows.sparkSession
    dealt = written(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    inside = Window.partitionBy("part").orderBy(*order)
    sums = dealt.groupBy("part").agg(F.sum(value).alias("total")).orderBy("part").collect()
    before, starts = 0, []
    for part, total in sums:
        starts.append((part, before))
        before += total
    offsets = spark.createDataFrame(starts, "part int, offset long")
    return (
        dealt.withColumn(name, F.sum(value).over(inside) - F.col(value))
        .withColumn("rank", F.row_number().over(inside) - 1)
        .join(F.broadcast(offsets), "part")
        .withColumn(name, F.col(name) + F.col("offset"))
        .drop("offset")
    )
