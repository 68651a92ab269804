"""HTTP archives: one JSON document each, one row an entry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasift.schemas import ARCHIVE, ENTRY

VERSION = "1.2"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """source_id, archive: documents of version 1.2. Unknown fields are ignored; others fail when they are looked at."""
    texts = spark.read.text(path, wholetext=True).withColumn("source_id", F.input_file_name())
    return parse_archives(texts.withColumnRenamed("value", "document"))


def parse_archives(documents: DataFrame) -> DataFrame:
    """As ``read_archives``, for a column ``document``."""
    parsed = F.from_json("document", ARCHIVE, {"mode": "PERMISSIVE"})
    rows = documents.select("source_id", parsed.alias("archive"))
    version = F.coalesce("archive.log.version", F.lit(""))
    fault = F.when(version == "", F.lit("log.version is required")).otherwise(F.concat(F.lit("unsupported version "), version))
    return rows.withColumn("archive", F.when(version == VERSION, F.col("archive")).otherwise(F.raise_error(fault).cast(ARCHIVE)))


def entries(archives: DataFrame) -> DataFrame:
    """source_id, entry_index, entry."""
    return archives.select("source_id", F.posexplode("archive.log.entries").alias("entry_index", "entry"))


def query_items(url: Column, most: int = 4096) -> Column:
    """name, value of a link's query: split at ``&``, cut at the first ``=``, decoded where that works.

    A query of more than ``most`` items fails.
    """
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    found = F.filter(F.split(query, "&"), lambda p: p != "")
    parts = F.when(F.size(found) > most, F.raise_error(F.lit(f"a query has more than {most} items")).cast("array<string>")).otherwise(found)
    decode = lambda c: F.coalesce(F.try_url_decode(c), c)
    item = lambda p: F.struct(decode(F.substring_index(p, "=", 1)).alias("name"), decode(F.when(p.contains("="), F.regexp_replace(p, "^[^=]*=", "")).otherwise("")).alias("value"))
    return F.transform(parts, item)


def ready_to_save(entry: Column) -> Column:
    """An entry as it is written: missing lists are empty, the cache an object, timings there."""
    pairs = "array<struct<name: string, value: string, comment: string>>"
    fill = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    kinds = ENTRY[ENTRY.index("cookies: ") + 9 :]
    cookies = kinds[: kinds.index(">>") + 2]
    request = entry["request"].withField("headers", fill(entry["request"]["headers"], pairs)).withField("queryString", fill(entry["request"]["queryString"], pairs)).withField("cookies", fill(entry["request"]["cookies"], cookies))
    response = entry["response"].withField("headers", fill(entry["response"]["headers"], pairs)).withField("cookies", fill(entry["response"]["cookies"], cookies))
    zero = F.struct(*(F.lit(None).cast("double").alias(n) for n in ("blocked", "dns", "connect")), *(F.lit(0.0).alias(n) for n in ("send", "wait", "receive")), F.lit(None).cast("double").alias("ssl"), F.lit(None).cast("string").alias("comment"))
    return entry.withField("request", request).withField("response", response).withField("cache", F.coalesce(entry["cache"], F.lit("{}"))).withField("timings", F.coalesce(entry["timings"], zero))
