"""Listings matched with earlier ones by keys of several priorities, and recency without arrays."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from terrasift.functions import dates
from terrasift.operators import history as H
from terrasift.operators.recency import recency_of

TODAY = dt.date(2026, 7, 21)
NONE = {"totalMonthlyCost": None, "requiredMonthlyFees": None, "availability": "", "bedrooms": None, "bathrooms": None, "laundry": "", "flexSpaces": [], "status": ""}
SCHEMA = "n long, id string, url string, address struct<full: string>, price long, totalMonthlyCost long, requiredMonthlyFees long, availability string, bedrooms double, bathrooms double, laundry string, flexSpaces array<string>, status string, historyStatus string, bucket int, bits int"


def listings(spark, rows):
    return spark.createDataFrame([(n, i, u, (a,), p, *NONE.values(), "x", 1, 2) for n, i, u, a, p in rows], SCHEMA)


def made(rng, n, shared):
    pick = lambda name, k: rng.choice(["", " ", None, f"{name}{rng.randint(0, k)}"])
    return [(i, pick("i", shared), pick("u", shared), pick("A ", shared), i) for i in range(n)]


def wanted(now, before):
    index = {}
    for n, i, u, a, price in sorted(before):
        for key in keys(i, u, a):
            index.setdefault(key, price)
    return {n: next((index[k] for k in keys(i, u, a) if k in index), None) for n, i, u, a, _ in now}


def keys(i, u, a):
    return [(k, v) for k, v in (("id", (i or "").strip()), ("url", (u or "").strip()), ("address", " ".join((a or "").lower().split()))) if v]


@pytest.mark.parametrize(("most", "bits"), [(H.BROADCAST_KEYS, H.BITS), (0, 32), (0, 1)])
def test_priority(spark, monkeypatch, most, bits):
    """By broadcast, by a filter that is mostly right, and by one that lets much through."""
    monkeypatch.setattr(H, "BROADCAST_KEYS", most)
    monkeypatch.setattr(H, "BITS", bits)
    if bits == 1:
        monkeypatch.setattr(H, "MOST_BITS", 1 << 15)
    rng = random.Random(bits)
    now, before = made(rng, 400, 500), made(rng, 300, 500)
    found = H.prior_listings(listings(spark, now), H.history_index(listings(spark, before), ["n"]))
    assert {r.n: r.old.price if r.old else None for r in found.collect()} == wanted(now, before) and found.count() == 400
    assert H.prior_listings(listings(spark, now), H.history_index(listings(spark, []), ["n"])).filter("old IS NOT NULL").count() == 0
    assert H.prior_listings(listings(spark, []), H.history_index(listings(spark, before), ["n"])).count() == 0


def test_priority_before_order(spark):
    """The id of a later listing outweighs the address of an earlier one; of equal keys the earlier listing counts."""
    before = [(1, "", "", "1 Main St", 10), (2, "a", "u", "", 20), (3, "a", "v", "", 30)]
    now = [(1, "a", "", "1 MAIN  st", 0), (2, "zz", "v", "1 main st", 0), (3, "", "", " 1 Main st ", 0), (4, None, None, None, 0)]
    found = H.prior_listings(listings(spark, now), H.history_index(listings(spark, before), ["n"]))
    assert {r.n: r.old and r.old.price for r in found.collect()} == {1: 20, 2: 30, 3: 10, 4: None}


def exchanges(df, column):
    plan = df._jdf.queryExecution().sparkPlan().toString()
    return plan


def test_listings_stay_or_go_once(spark, monkeypatch):
    """With few keys no shuffle of listings; with many, exchanges by the key alone."""
    before = H.history_index(listings(spark, made(random.Random(1), 50, 60)), ["n"])
    now = listings(spark, made(random.Random(2), 50, 60))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan(H.prior_listings(now, before))
    monkeypatch.setattr(H, "BROADCAST_KEYS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(H.prior_listings(now, before))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Generate" not in text and "Aggregate" not in text and text.count("BroadcastHashJoin") >= 3


EVENTS = ["Listed for rent", "listing removed", "Price change", "Rental listing", "sold", "Listed for rent, sold", "rent change", None]


def logs(rng, groups):
    return [(g, dt.date(2026, 6, 1) + dt.timedelta(days=rng.randint(0, 90)) if rng.random() < 0.95 else None, n, rng.choice(EVENTS), 1) for g in range(groups) for n in range(rng.randint(0, 9))]


def test_recency_is_the_fold(spark):
    rows = logs(random.Random(5), 300)
    events = spark.createDataFrame(rows, "g int, date date, n int, said string, listed int").withColumn("event", F.lower("said"))
    got = {r.g: (r.listed, r.updated, r.days) for r in recency_of(events, ["g"], ["n"], F.lit(TODAY)).collect()}
    one = F.struct("date", F.col("n").alias("ord"), F.coalesce("event", F.lit("")).alias("event"), F.lit(True).alias("rental"))
    folded = events.filter("date IS NOT NULL").groupBy("g").agg(F.array_sort(F.collect_list(one)).alias("e")).select("g", dates.recency(F.col("e"), F.lit(TODAY)).alias("r"))
    assert got == {r.g: tuple(r.r) for r in folded.collect()}
    assert recency_of(events.limit(0), ["g"], ["n"], F.lit(TODAY)).count() == 0


def test_hot_group_is_split(spark):
    """Every task pre-aggregates what it has of a group: one row of it leaves each."""
    events = spark.range(0, 40_000, 1, 8).select(F.lit(1).alias("g"), F.expr("date_add(DATE '2020-01-01', CAST(id % 900 AS INT))").alias("date"), F.col("id").alias("n"), F.when(F.col("id") % 900 == 500, "listing removed").when(F.col("id") % 900 == 600, "listed for rent").otherwise("change").alias("event"))
    found = recency_of(events, ["g"], ["n"], F.lit(TODAY))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "partial_max" in plan and "collect_list" not in plan and "Window" not in plan
    assert [tuple(r) for r in found.collect()] == [(1, dt.date(2021, 8, 23), dt.date(2022, 6, 18), (TODAY - dt.date(2021, 8, 23)).days)]
