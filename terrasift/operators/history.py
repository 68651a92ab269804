"""Listings compared with those of an earlier search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasift.functions.text import collapse_ws, null_if_empty, text_set, trim_ws
from terrasift.sources.scratch import staged

COMPARED = ["price", "totalMonthlyCost", "requiredMonthlyFees", "availability", "bedrooms", "bathrooms", "laundry", "flexSpaces", "status"]


def keys_by_priority() -> list[Column]:
    """A listing's keys, null where it has none: id, link, address in lower case with single spaces."""
    values = {"id": trim_ws(F.col("id")), "url": trim_ws(F.col("url")), "address": F.lower(collapse_ws(F.col("address.full")))}
    return [F.concat(F.lit(f"{name}:"), null_if_empty(value)) for name, value in values.items()]


def money_change(label: str, before: Column, now: Column) -> Column:
    return (
        F.when(before.isNull() & now.isNotNull(), f"{label} confirmed")
        .when(before.isNotNull() & now.isNull(), f"{label} became unknown")
        .when(now < before, f"{label} decreased")
        .when(now > before, f"{label} increased")
    )


def changes(before: str, now: str = "") -> Column:
    """What changed between two rows' columns, in fixed order."""
    old = lambda name: F.col(f"{before}{name}")
    new = lambda name: F.col(f"{now}{name}")
    folded = lambda c: F.lower(collapse_ws(F.coalesce(c, F.lit(""))))
    differs = lambda name, fold: ~fold(old(name)).eqNullSafe(fold(new(name)))
    laundry = F.when(folded(new("laundry")) == "in-unit", "in-unit laundry confirmed").otherwise("laundry details changed")
    told = [
        money_change("price", old("price"), new("price")),
        money_change("total monthly cost", old("totalMonthlyCost"), new("totalMonthlyCost")),
        money_change("required monthly fees", old("requiredMonthlyFees"), new("requiredMonthlyFees")),
        F.when(differs("availability", lambda c: trim_ws(F.coalesce(c, F.lit("")))), F.lit("availability changed")),
        F.when(differs("bedrooms", lambda c: c), F.lit("bedroom count changed")),
        F.when(differs("bathrooms", lambda c: c), F.lit("bathroom count changed")),
        F.when(differs("laundry", folded), laundry),
        F.when(differs("flexSpaces", text_set), F.lit("flex details changed")),
        F.when(differs("status", folded), F.lit("rental status changed")),
    ]
    return F.array_compact(F.array(*told))


#: Keys of earlier listings that are broadcast at most, and bits of a filter over more of them: 64 MB.
BROADCAST_KEYS, MOST_BITS = 1_000_000, 1 << 29
#: Bits of the filter for each key: one key in 32 that isn't there passes.
BITS = 32
KINDS = ("id:", "url:", "address:")


def history_index(previous: DataFrame, order: list[str]) -> DataFrame:
    """key, old: for each key the first earlier listing that has it, written."""
    keyed = previous.select(F.struct(*order).alias("ord"), F.struct(*COMPARED).alias("old"), F.explode(F.array_compact(F.array(*keys_by_priority()))).alias("key"))
    return staged(keyed.groupBy("key").agg(F.min_by("old", "ord").alias("old")))


def key_filter(index: DataFrame, n: int) -> tuple[DataFrame, int]:
    """(blocks of at most MOST_BITS bits in all, their number): where keys are, by hash. Its size is bounded, so it may be broadcast."""
    size = max(1 << 15, min(MOST_BITS, 1 << (n * BITS - 1).bit_length()))
    place = F.pmod(F.xxhash64("key"), F.lit(size))
    found = index.select(F.bitmap_bucket_number(place).alias("_bucket"), F.bitmap_bit_position(place).alias("bit"))
    return staged(found.groupBy("_bucket").agg(F.bitmap_construct_agg("bit").alias("_bits"))), size


def _may_have(rows: DataFrame, found: DataFrame, size: int, key: str) -> DataFrame:
    """Nulls ``key`` where the filter knows that no earlier listing has it."""
    place = F.pmod(F.xxhash64(key), F.lit(size))
    bit = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    joined = rows.withColumn("_bucket", F.when(F.col(key).isNotNull(), F.bitmap_bucket_number(place))).join(F.broadcast(found), "_bucket", "left")
    there = F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False))
    return joined.withColumn(key, F.when(there, F.col(key))).drop("_bucket", "_bits")


def prior_listings(current: DataFrame, index: DataFrame) -> DataFrame:
    """Adds ``old``: the earlier listing of the first of a row's keys, by priority, that ``index`` has.

    A few keys are broadcast: the rows stay where they are. With more, a filter of bounded size says which of a row's keys
    may be there, and the row goes once to the first of them; of what it says one in BITS is wrong, and such a row goes on
    to its next key. Rows without a key that may be there stay out of the join, and a key that very many rows have is
    split by Spark's skew join.
    """
    n = index.count()
    names = ["_k0", "_k1", "_k2"]
    rows = current.withColumns(dict(zip(names, keys_by_priority(), strict=True)))
    if n <= BROADCAST_KEYS:
        for name, kind in zip(names, KINDS, strict=True):
            part = index.filter(F.col("key").startswith(kind)).select(F.col("key").alias(name), F.col("old").alias(f"{name}_old"))
            rows = rows.join(F.broadcast(part), name, "left")  # at most BROADCAST_KEYS rows in all three
        return rows.withColumn("old", F.coalesce(*(f"{name}_old" for name in names))).drop(*names, *(f"{name}_old" for name in names))
    found, size = key_filter(index, n)
    for name in names:
        rows = _may_have(rows, found, size, name)
    rows = rows.withColumn("_keys", F.array_compact(F.array(*names))).drop(*names)
    kind = index.schema["old"].dataType
    parts = [rows.filter(F.size("_keys") == 0).withColumn("old", F.lit(None).cast(kind))]
    left = rows.filter(F.size("_keys") > 0)
    for turn in range(len(names)):
        tried = left.withColumn("_key", F.get("_keys", F.lit(turn))).join(index.withColumnRenamed("key", "_key"), "_key", "left").drop("_key")
        more = F.col("old").isNull() & (F.size("_keys") > turn + 1)
        parts.append(tried.filter(~more))
        left = tried.filter(more).drop("old")
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.drop("_keys")


def annotate_history(current: DataFrame, previous: DataFrame, order: list[str]) -> DataFrame:
    """Adds historyStatus and historyChanges.

    ``order`` names the columns that order the previous listings. A listing is matched by its first key that a previous
    one has, with the first previous one of that key.
    """
    joined = prior_listings(current.drop("historyStatus", "historyChanges"), history_index(previous, order))
    told = F.when(F.col("old").isNull(), F.array().cast("array<string>")).otherwise(changes("old."))
    status = F.when(F.col("old").isNull(), "new-to-digest").when(F.size("historyChanges") > 0, "previously-surfaced-changed").otherwise("previously-surfaced-still-active")
    return joined.withColumn("historyChanges", told).withColumn("historyStatus", status).drop("old")
