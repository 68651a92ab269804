"""Ordered output in parts, and first-wins over several runs."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from terrasift.operators import render
from terrasift.operators.dedup import first_wins, listing_key
from terrasift.operators.output import read_ordered, write_ordered
from terrasift.operators.seen import first_wins_again


def made(spark, n):
    return spark.range(n).select(F.pmod(F.col("id") * 7, F.lit(n or 1)).alias("o"), F.concat(F.lit("é"), F.col("id").cast("string")).alias("NAME"), F.when(F.col("id") % 3 == 0, F.col("id") * 10).alias("N"), F.lit(" x ").alias("_head_")).repartition(5)


def joined(path):
    return "".join(p.read_text() for p in sorted(Path(path).glob("part-*")))


@pytest.mark.parametrize("n", [0, 1, 500])
def test_table_is_the_collected_one(spark, tmp_path, n):
    rows = made(spark, n)
    facts = write_ordered(rows, str(tmp_path / "t"), ["o"])
    texts = rows.orderBy("o").select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in rows.columns if c != "o"))
    assert joined(tmp_path / "t") == render.aligned(texts)
    assert (facts.rows, facts.filled["N"], facts.longest["NAME"]) == (n, -(-n // 3), len(f"é{n - 1}") if n else 0)
    lines = read_ordered(spark, str(tmp_path / "t")).orderBy("n").collect()
    assert [r.n for r in lines] == list(range(n + 1)) and [r.line for r in lines] == joined(tmp_path / "t").splitlines()


def test_parts_are_many(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_ordered(made(spark, 2000), str(tmp_path / "t"), ["o"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = [p for p in sorted((tmp_path / "t").glob("part-*")) if p.stat().st_size]
    assert len(parts) > 2 and sum("NAME" in p.read_text() for p in parts) == 1 and "NAME" in parts[0].read_text()


@pytest.mark.parametrize("n", [0, 1, 300])
def test_lines_and_document(spark, tmp_path, n):
    rows = made(spark, n)
    wanted = [{k: v for k, v in r.asDict().items() if k != "o" and v is not None} for r in rows.orderBy("o").collect()]
    assert write_ordered(rows, str(tmp_path / "l"), ["o"], "lines").rows == n
    assert [json.loads(x) for x in joined(tmp_path / "l").splitlines()] == wanted
    write_ordered(rows, str(tmp_path / "d"), ["o"], "document")
    assert json.loads(joined(tmp_path / "d")) == wanted


def test_fault_stops_the_write(spark, tmp_path):
    bad = made(spark, 100).withColumn("NAME", F.when(F.col("o") == 50, "a\tb").otherwise(F.col("NAME")))
    with pytest.raises(Exception, match="control character"):
        write_ordered(bad, str(tmp_path / "t"), ["o"])
    assert not list((tmp_path / "t").glob("part-*"))
    with pytest.raises(ValueError, match="mode"):
        write_ordered(bad, str(tmp_path / "u"), ["o"], "csv")


def listings(spark, rows):
    return spark.createDataFrame([(n, i, u, (a,), "k") for n, i, u, a in rows], "n int, id string, url string, address struct<full: string>, _run string")


def test_runs(spark):
    """Runs over parts give what one run gives over the whole, also when one is repeated."""
    rows = [(n, f"i{n % 17}" if n % 3 else "", f"u{n % 11}" if n % 4 else " ", "A st" if n % 5 else "") for n in range(200)]
    whole = sorted(r.n for r in first_wins(listings(spark, rows), [], listing_key(), ["n"]).collect())
    spark.sql("DROP TABLE IF EXISTS seen_test")
    kept = []
    for run, part in enumerate((rows[:80], rows[80:81], [], rows[81:], rows[81:])):
        name = str(min(run, 3))
        found = first_wins_again(listings(spark, part), name, "seen_test", listing_key(), ["n"], buckets=4)
        assert found.columns == ["n", "id", "url", "address", "_run"]
        numbers = sorted(r.n for r in found.collect())
        if run == 4:
            assert numbers == kept[-1]
        else:
            kept.append(numbers)
    assert sorted(n for part in kept for n in part) == whole
    assert spark.table("seen_test").count() == spark.table("seen_test").select("_key").distinct().count()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        keys = spark.range(5).select(F.col("id").cast("string").alias("_key")).repartition(4, "_key")
        plan = keys.join(spark.table("seen_test").select("_key"), "_key", "left_anti")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 1 and "SelectedBucketsCount: 4 out of 4" in plan
    spark.sql("DROP TABLE seen_test")
