"""Queries below the roots of nested documents, made of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasift.registry import query, table
from terrasift.sources.trees import first_under, objects_under, strings_below


def nested_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, document: customers at depths of up to 12, with the wanted keys again further on, and rooms by telling names."""
    key, name = F.col("c_custkey"), F.col("c_name")
    deep = (key % 13).cast("int")
    inner = F.concat(F.lit('{"totalResultCount":'), key.cast("string"), F.lit(',"property":{"zpid":'), key.cast("string"), F.lit(',"property":{"n":1}}}'))
    nested = F.concat(F.repeat(F.lit('{"w":[null,'), deep), inner, F.repeat(F.lit("]}"), deep))
    rooms = F.concat(F.lit('[{"roomName":"'), name, F.lit('","area":"no","Features":["b",{"type":"  ","a":"no"},["c"]],"description":{"name":"d","x":"no"}},7,"'), F.col("c_mktsegment"), F.lit('"]'))
    later = F.lit('"z":{"totalResultCount":"late","property":[1]},"y":[{"property":{"zpid":0}}],')
    return table(spark, sf_dir, "customer").select(key.alias("id"), F.concat(F.lit("{"), later, F.lit('"b":'), nested, F.lit("}")).alias("document"), rooms.alias("rooms"))


@query("""
SELECT c_custkey AS id, 'b' || repeat('.w[1]', CAST(c_custkey % 13 AS INT)) || '.totalResultCount' AS path, CAST(c_custkey AS VARCHAR) AS value FROM customer
""")
def nested_first_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first value under a key, at any depth."""
    return first_under(nested_documents(spark, sf_dir), "totalResultCount", "id")


@query("""
WITH d AS (SELECT c_custkey AS id, 'b' || repeat('.w[1]', CAST(c_custkey % 13 AS INT)) || '.property' AS path FROM customer)
SELECT id, path, '{"property":{"n":1},"zpid":' || id || '}' AS value FROM d UNION ALL SELECT id, path || '.property', '{"n":1}' FROM d UNION ALL SELECT id, 'y[0].property', '{"zpid":0}' FROM d
""")
def nested_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every object under a key, one inside another among them."""
    return objects_under(nested_documents(spark, sf_dir), "property", "id").drop("place")


@query("SELECT c_custkey AS id, 'b|c|d|' || c_name || '|' || c_mktsegment AS strings FROM customer")
def nested_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings under telling names, by the order of names."""
    return strings_below(nested_documents(spark, sf_dir), "id", "rooms").select("id", F.array_join("strings", "|").alias("strings"))
