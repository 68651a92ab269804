"""Deduplication across runs: what earlier runs have kept stays out of later ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasift.operators.dedup import first_wins
from terrasift.sources.scratch import staged

#: Buckets of the table of keys: a run joins it bucket by bucket, without a shuffle of what was seen before.
BUCKETS = 64


def first_wins_again(batch: DataFrame, run: str, state: str, key: Column, order: list[str | Column], buckets: int = BUCKETS) -> DataFrame:
    """The rows of ``batch`` that are the first of their key in this run and all before it, written.

    ``state`` is a table of keys, bucketed by key, that each run adds its own to; it is made by the first run. A run that
    is done again, as after a failure, gives the same rows and adds nothing. Rows without a key all stay, and are not
    remembered. Runs over the parts of a table in their order give what one run gives over the whole.
    """
    spark = batch.sparkSession
    first = first_wins(batch, [], key, order).withColumn("_key", key)
    there = spark.catalog.tableExists(state)
    keyed = first.filter("_key IS NOT NULL")
    if there:
        known = spark.table(state).filter(F.col("run") != run).select("_key")
        keyed = keyed.repartition(buckets, "_key").join(known, "_key", "left_anti")
    kept = staged(keyed.select(*first.columns).unionByName(first.filter("_key IS NULL")))
    if not there or spark.table(state).filter(F.col("run") == run).isEmpty():
        keys = kept.filter("_key IS NOT NULL").select("_key", F.lit(run).alias("run")).repartition(buckets, "_key")
        keys.write.bucketBy(buckets, "_key").sortBy("_key").format("parquet").mode("append").saveAsTable(state)
    return kept.drop("_key")
