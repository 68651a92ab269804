"""Searches below a JSON document's root, by VARIANT values and a recursive query: no Python, no limit on depth.

A node's place is its steps from the root, an index for an element and a name for a field. Places are in the order of a
walk that looks at an object before what is below it, and goes through its fields by name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasift.sources.records import TELLING

_STEPS = "array<struct<i: int, k: string>>"
_WALK = """
WITH RECURSIVE nodes(key, steps, value) AS (
  SELECT key, CAST(array() AS {steps}), value FROM {{roots}}
  UNION ALL
  SELECT n.key, array_append(n.steps, named_struct('i', CASE WHEN e.key IS NULL THEN e.pos ELSE 0 END, 'k', e.key)), e.value
  FROM nodes n, LATERAL variant_explode(n.value) e {into})
SELECT key, steps, value FROM nodes
"""
#: Levels of nesting that a document may have; Spark stops a query beyond.
LEVELS = 10_000


def _walk(documents: DataFrame, key: str, document: str, into: str = "") -> DataFrame:
    """key, steps, value of all nodes; ``into`` is a condition on a step ``e`` that is to be taken."""
    spark = documents.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    spark.conf.set("spark.sql.cteRecursionLevelLimit", str(LEVELS))
    roots = documents.select(documents[key].alias("key"), F.try_parse_json(documents[document]).alias("value"))
    return spark.sql(_WALK.format(steps=_STEPS, into=into), roots=roots)


def path_text(steps: Column) -> Column:
    """Steps as text: names behind dots, indices in brackets."""
    text = F.array_join(F.transform(steps, lambda s: F.when(s["k"].isNull(), F.concat(F.lit("["), s["i"].cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("."), s["k"]))), "")
    return F.regexp_replace(text, r"^\.", "")


def values_under(documents: DataFrame, wanted: str, key: str = "source_id", document: str = "document") -> DataFrame:
    """``key``, path, place, kind, value (JSON text): all values under a key, wherever it stands.

    ``place`` orders the values of a document: by the object that has the key. Text that isn't JSON has no values, nor
    has a document that repeats a key within an object; the kind is as VARIANT names it, with its size for a decimal.
    """
    last = F.element_at("steps", -1)
    hits = _walk(documents, key, document).filter((F.size("steps") > 0) & (last["k"] == wanted))
    place = F.slice("steps", F.lit(1), F.size("steps") - 1)
    kind = F.regexp_extract(F.schema_of_variant("value"), "^[A-Z]+", 0)
    return hits.select(F.col("key").alias(key), path_text(F.col("steps")).alias("path"), place.alias("place"), kind.alias("kind"), F.to_json("value").alias("value"))


def first_under(documents: DataFrame, wanted: str, key: str = "source_id", document: str = "document") -> DataFrame:
    """``key``, path, value: the first of ``values_under`` of each document that has any."""
    best = F.min_by(F.struct("path", "value"), "place")
    return values_under(documents, wanted, key, document).groupBy(key).agg(best.alias("hit")).select(key, "hit.path", "hit.value")


def objects_under(documents: DataFrame, wanted: str = "property", key: str = "source_id", document: str = "document") -> DataFrame:
    """``key``, path, place, value: those of ``values_under`` that are objects."""
    return values_under(documents, wanted, key, document).filter("kind = 'OBJECT'").drop("kind")


def strings_below(documents: DataFrame, key: str = "source_id", document: str = "document", telling: list[str] = TELLING) -> DataFrame:
    """``key``, strings: all strings that aren't blank, in the order of their places; of objects only fields with telling names.

    A document without any has no row.
    """
    names = " OR ".join(f"contains(lower(e.key), '{name}')" for name in telling)
    nodes = _walk(documents, key, document, f"WHERE e.key IS NULL OR {names}")
    text = F.when(F.schema_of_variant("value") == "STRING", F.try_variant_get("value", "$", "string"))
    found = nodes.withColumn("text", text).filter("text IS NOT NULL AND text RLIKE '\\\\S'")
    ordered = F.array_sort(F.collect_list(F.struct("steps", "text")))
    return found.groupBy("key").agg(ordered.alias("all")).select(F.col("key").alias(key), F.transform("all", lambda x: x["text"]).alias("strings"))
