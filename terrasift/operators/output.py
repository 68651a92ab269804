"""Ordered text output of any size: tables, lines and documents as parts that make one text when joined in their order.

Nothing is collected but widths and facts. Rows are dealt by ranges of their order, so part after part goes on where the
one before ended; facts about the rows come out of the pass that writes them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from terrasift.operators.render import checked

MODES = ("table", "lines", "document")


@dataclass(frozen=True)
class Facts:
    """What was written: rows, how many of them have a value in each column, and its longest text."""

    rows: int
    filled: dict[str, int]
    longest: dict[str, int]


def _widths(rows: DataFrame, columns: list[str]) -> dict[str, int]:
    found = rows.agg(*(F.max(F.length(c)).alias(c) for c in columns)).first()
    return {c: max(len(c), found[c] or 0) for c in columns}


def table_line(widths: dict[str, int], cells: dict[str, Column], pad: int = 2) -> Column:
    """Cells under one another; no space at a line's end."""
    return F.rtrim(F.concat(*(F.rpad(cells[c], width + pad, " ") for c, width in widths.items())))


def write_ordered(rows: DataFrame, path: str, order: list[str], mode: str = "table", pad: int = 2) -> Facts:
    """Writes ``rows`` in the order of ``order``, whose values tell rows apart, as text parts below ``path``.

    "table": all columns but ``order``'s as text under a header, aligned; a null cell is empty, and one with a control
    character stops the write, so that no part shows. "lines": one JSON object a line. "document": one JSON array.
    An empty table has its header, no lines, or an empty array.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    spark = rows.sparkSession
    columns = [c for c in rows.columns if c not in order]
    text = lambda c: F.col(c).cast("string")
    if mode == "table":
        rows = rows.select(*order, *(F.coalesce(text(c), F.lit("")).alias(c) for c in columns))
        widths = _widths(rows, columns)
        ends = {0: "".join(c.ljust(w + pad) for c, w in widths.items()).rstrip()}
        line = table_line(widths, {c: F.col(c) for c in columns}, pad)
    else:
        ends, line = {}, F.to_json(F.struct(*columns), {"ignoreNullFields": "true"})
    if mode == "document":
        # all but the first row follow a comma
        first = rows.agg(F.min(F.struct(*order)).alias("first")).first()["first"]
        begins = F.struct(*order) == F.struct(*(F.lit(v).cast(rows.schema[c].dataType).alias(c) for c, v in first.asDict().items())) if first else F.lit(True)
        ends, line = {0: "[", 2: "]"}, F.concat(F.when(begins, "").otherwise(","), line)
    # what stands before the first row and behind the last one are rows without values
    whole = rows.withColumn("_head", F.lit(1))
    for head in ends:
        whole = whole.unionByName(spark.range(1).select(F.lit(head).alias("_head"), *(F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema)))
    dealt = whole.repartitionByRange("_head", *order).sortWithinPartitions("_head", *order)
    # behind the exchange, as the sample that its ranges are made from would be counted too
    seen, own = Observation(), F.col("_head") == 1
    counts = {"rows": F.count(F.when(own, 1))}
    for c in columns:
        counts |= {f"filled_{c}": F.count(F.when(own, F.nullif(text(c), F.lit("")))), f"longest_{c}": F.coalesce(F.max(F.when(own, F.length(text(c)))), F.lit(0))}
    told = dealt.observe(seen, *(value.alias(name) for name, value in counts.items()))
    if mode == "table":
        told = checked(told)
    for head, literal in ends.items():
        line = F.when(F.col("_head") == head, literal).otherwise(line)
    told.select(line.alias("value")).write.text(path)
    found = seen.get
    return Facts(found["rows"], {c: found[f"filled_{c}"] for c in columns}, {c: found[f"longest_{c}"] for c in columns})


def read_ordered(spark: SparkSession, path: str) -> DataFrame:
    """n, line: the lines of all parts in their order, counted from 0."""
    parts = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("part"), F.monotonically_increasing_id().alias("at"))
    counts = parts.groupBy("part").agg(F.count(F.lit(1)).alias("count"))
    before = counts.withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # as many rows as parts
    place = F.row_number().over(Window.partitionBy("part").orderBy("at")) - 1
    return parts.withColumn("place", place).join(F.broadcast(before), "part").select((F.col("before") + F.col("place")).alias("n"), F.col("value").alias("line"))
