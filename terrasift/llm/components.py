"""Connected components by alternating stars, on Spark all through."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasift.llm.common import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's larger (or smaller) neighbours are tied to the least node around it."""
    around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = around.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    tied = around.join(least, "u")
    if large:
        return tied.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    down = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
    return down.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """node, root: the least node of its component for each node of ``edges`` (u, v), itself included.

    Loops and repeated edges don't matter; no edges give no rows. The number of rounds grows with the logarithm of the
    longest path; each round is written to the shared folder.
    """
    now = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct())
    mark = F.struct(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h"))
    before = None
    while before != (before := now.agg(mark.alias("mark")).first().mark):
        if not before.n:
            break
        now = written(_star(_star(now, large=True), large=False))
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
