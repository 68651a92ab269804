"""Exact deduplication with DataFrame functions only.

Rows are grouped by a 128-bit content hash *and* the bytes themselves, so that Spark's aggregation compares the
bytes inside each hash group. Copies meet in the map tasks first, hence one row per text and map task is shuffled,
however large a group of copies is. Ids and sizes come back to the documents over the hash alone; hashes that two
different texts share (none, unless MD5 is attacked) take the join over hash and bytes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasift.llm.common import doc_texts, written


def content_hash(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def exact_dedup(docs: DataFrame, keep: str = "smallest", content_hash: Callable[[Column], Column] = content_hash) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each row of ``docs``.

    Texts are equal when their bytes are; null equals ''. ``keep`` is "smallest" or "largest": the doc_id that stays.
    Rows that repeat an id and its text are one document, so all are kept if one is; they count in ``group_size``.
    Null ids never win over others; a group with null ids only has keep_id null and keeps its rows.
    An empty table gives an empty one. Columns other than doc_id and text are not looked at.
    """
    best = {"smallest": F.min, "largest": F.max}[keep]
    rows = doc_texts(docs).withColumn("hash", content_hash(F.col("text")))
    texts = rows.groupBy("hash", "text").agg(F.count(F.lit(1)).alias("group_size"), best("doc_id").alias("keep_id"))
    groups = written(
        texts.groupBy("hash").agg(
            F.count(F.lit(1)).alias("texts"), F.max("group_size").alias("group_size"), F.max("keep_id").alias("keep_id")
        )
    )
    digest = F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256")
    out = rows.select("doc_id", "hash", digest).join(groups.filter("texts = 1"), "hash")
    shared = groups.filter("texts > 1").select("hash")
    if not shared.isEmpty():
        apart = texts.join(shared, "hash", "left_semi")
        out = out.unionByName(rows.join(apart, ["hash", "text"]).withColumn("text_sha256", digest), allowMissingColumns=True)
    return out.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
