"""From raw documents to encoded ones: language id, exact and near deduplication, decontamination, byte-level BPE."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasift.llm.byte_bpe import bpe_encode, broadcast_tables
from terrasift.llm.common import fold, read_table, written
from terrasift.llm.decontamination import find_leaks
from terrasift.llm.exact_dedup import exact_dedup
from terrasift.llm.language_id import UNKNOWN, language_id
from terrasift.llm.minhash_join import near_duplicates
from terrasift.llm.queries import TOKENIZERS

#: Documents whose language is less certain go.
CERTAIN = 0.3
#: Row keys that are broadcast at most.
BROADCAST_IDS = 1_000_000


def _keyed(docs: DataFrame, ordered: bool = False) -> DataFrame:
    """``docs`` with ``_row``, a key of each row, written; ``ordered``: in the order of ids, null ones last."""
    if ordered:
        order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
        docs = docs.repartitionByRange(*order).sortWithinPartitions(*order)
    return written(docs.withColumn("_row", F.monotonically_increasing_id()))


def _rows(keyed: DataFrame) -> DataFrame:
    """The documents under their row keys, for an operator."""
    return keyed.withColumn("doc_id", F.col("_row")).drop("_row")


def _without(keyed: DataFrame, found: DataFrame) -> DataFrame:
    """The documents but for the rows whose keys an operator has found; few keys are broadcast, more take a shuffle join."""
    gone = written(found.select(F.col("doc_id").alias("_gone")).distinct())
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return keyed.join(gone, F.col("_row") == F.col("_gone"), "left_anti").drop("_row")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in some language; all of them if there is nothing to learn languages from."""
    training = fold(F.col("doc_id"), 4) != 2
    if docs.filter(training & F.col("lang").isNotNull() & F.col("text").isNotNull()).isEmpty():
        return docs
    keyed = _keyed(docs)
    found = language_id(_rows(keyed), training, learn=docs)
    return _without(keyed, found.filter((F.col("lang_pred") == UNKNOWN) | (F.col("score") < CERTAIN)))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: the one with the smallest id."""
    keyed = _keyed(docs, ordered=True)
    return _without(keyed, exact_dedup(_rows(keyed)).filter("NOT kept"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id."""
    keyed = _keyed(docs, ordered=True)
    return _without(keyed, near_duplicates(_rows(keyed)).filter("NOT kept"))


def leak_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks."""
    keyed = _keyed(docs)
    return _without(keyed, find_leaks(_rows(keyed), read_table(spark, sf_dir, "benchmark")))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens and whether decoding gives the text back."""
    tables = broadcast_tables(spark, f"{TOKENIZERS}/byte_bpe_multi_50k.tiktoken", public_tokenizers.PATTERN)
    coded = bpe_encode(docs, tables, decode=True)
    return coded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language id", language_stage),
    ("exact dedup", exact_stage),
    ("near dedup", near_stage),
    ("decontamination", leak_stage),
    ("byte-level BPE", encode_stage),
]

#: Language id and near dedup aren't SQL; the tests check what each stage keeps, and the operators against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again by the next."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
