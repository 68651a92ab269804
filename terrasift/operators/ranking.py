"""Order and limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrasift.spec import parse_sort


def sort_order(mode: str, ties: list[str]) -> list[Column]:
    """Unknown values come last in either direction; ties keep their order."""
    by = {
        "recommended": [], "price-asc": [F.col("price").asc_nulls_last()], "price-desc": [F.col("price").desc_nulls_last()],
        "newest": [F.col("daysListed").asc_nulls_last()], "beds-desc": [F.col("bedrooms").desc_nulls_last()],
        "sqft-desc": [F.col("livingArea").desc_nulls_last()],
    }
    return [*by[parse_sort(mode)], *(F.col(c).asc() for c in ties)]


def sort_listings(rows: DataFrame, mode: str, ties: list[str]) -> DataFrame:
    return rows.orderBy(*sort_order(mode, ties))


def limit_per(rows: DataFrame, groups: list[str], mode: str, ties: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of each group (0: all), with their ``rank``. Spark cuts each task's groups before it shuffles."""
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*groups).orderBy(*sort_order(mode, ties))))
    return ranked.filter(F.col("rank") <= n) if n else ranked
