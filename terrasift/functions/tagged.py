"""Coercion of tagged JSON scalars.

A tagged scalar is ``struct<kind: string, text: string>``: the kind of the JSON value (string, number, bool, null,
object, array) and its text, a number's as written. An absent value is a null struct. What can't be coerced is null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrasift.functions.text import let, trim_ws

TAGGED = "struct<kind: string, text: string>"

# The literals that count as boolean.
TRUE = ["1", "t", "T", "TRUE", "true", "True"]
FALSE = ["0", "f", "F", "FALSE", "false", "False"]

_TOKEN = r"(?:[0-9]{1,3}(?:,[0-9]{3}(?![0-9]))+|[0-9]+)(?:\.[0-9]+)?"
_FLOAT = r"^[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"


def present(tag: Column) -> Column:
    """Whether there is a value that isn't null."""
    return tag.isNotNull() & (tag["kind"] != "null")


def is_string(tag: Column) -> Column:
    return tag["kind"] == "string"


def as_string(tag: Column) -> Column:
    """A string, trimmed, or a number as written."""
    return F.when(tag["kind"] == "string", trim_ws(tag["text"])).when(tag["kind"] == "number", tag["text"])


def as_double(tag: Column) -> Column:
    """A finite number, or a string that is one."""
    text = trim_ws(tag["text"])
    value = F.when(tag["kind"].isin("number", "string") & text.rlike(_FLOAT), text.try_cast("double"))
    return F.when(F.abs(value) < float("inf"), value)


def as_long(tag: Column) -> Column:
    """A number without a fraction, however written, or a string of an integer; in the range of 64 bits."""
    text = trim_ws(tag["text"])
    plain = text.rlike("^[+-]?[0-9]+$")
    # 1e3, 5.0: exact in decimal; the exponent is taken out as shifts of the point
    decimal = text.try_cast("decimal(38,10)")
    whole = F.when(decimal % 1 == 0, decimal.try_cast("decimal(28,0)").try_cast("long"))
    return F.when(plain & tag["kind"].isin("number", "string"), text.try_cast("long")).when((tag["kind"] == "number") & text.rlike(_FLOAT), whole)


def as_bool(tag: Column) -> Column:
    """A boolean, or one of its literals as a string."""
    text = trim_ws(tag["text"])
    known = tag["kind"].isin("bool", "string")
    return F.when(known & text.isin(*TRUE), True).when(known & text.isin(*FALSE), False)


def is_integral(tag: Column) -> Column:
    return as_long(tag).isNotNull()


def parse_money(c: Column) -> Column:
    """The one amount in a text, rounded half away from zero.

    Thousands are grouped by commas or not at all; k, m or b right behind the number multiply it unless a letter or digit
    follows; a minus before it, also before a currency sign, rejects it, as does a second number or one beyond 64 bits.
    """
    value = trim_ws(c)
    tokens = F.regexp_extract_all(value, F.lit(f"({_TOKEN})"), 1)
    before = F.regexp_extract(value, f"^([^0-9]*){_TOKEN}", 1)
    suffix = F.lower(F.regexp_extract(value, f"{_TOKEN}([kKmMbB])(?![0-9A-Za-z])", 1))
    times = F.when(suffix == "k", 1e3).when(suffix == "m", 1e6).when(suffix == "b", 1e9).otherwise(1.0)
    scaled = F.regexp_replace(F.get(tokens, F.lit(0)), ",", "").try_cast("double") * times
    sound = (F.size(tokens) == 1) & ~before.rlike(r"[-−][\s\p{Z}\p{Sc}]*$") & (scaled < 9.223372036854775e18)
    return F.when(sound, F.round(scaled).try_cast("long"))


def as_money(tag: Column) -> Column:
    """An integer that isn't negative, or the amount in a string."""
    amount = F.when(is_string(tag), let(tag["text"], parse_money))
    return F.coalesce(let(as_long(tag), lambda whole: F.when(whole >= 0, whole)), amount)


def is_money(tag: Column) -> Column:
    return F.when(is_string(tag), parse_money(tag["text"]).isNotNull()).otherwise(is_integral(tag))


def first_of(coerce: Callable[[Column], Column], tags: list[Column]) -> Column:
    """The first alias that can be coerced."""
    return F.coalesce(*(let(tag, coerce) for tag in tags), F.lit(None))


def first_string(*tags: Column) -> Column:
    """The first alias that is a string or number and not blank; else empty."""
    return F.coalesce(*(let(tag, lambda t: F.nullif(as_string(t), F.lit(""))) for tag in tags), F.lit(""))


def first_double(*tags: Column) -> Column:
    return first_of(as_double, list(tags))


def first_long(*tags: Column) -> Column:
    return first_of(as_long, list(tags))


def first_money(*tags: Column) -> Column:
    return first_of(as_money, list(tags))


def normalize_identifier(tag: Column) -> Column:
    """A positive decimal identifier without leading zeros, or null."""
    text = as_string(tag)
    return F.when(text.rlike("^[0-9]+$"), F.nullif(F.regexp_replace(text, "^0+", ""), F.lit("")))


def total_cost(price: Column, fees: Column, includes_fees: Column) -> Column:
    """Null without a price; the price if it includes fees; else their sum, null if fees are unknown, negative or too large."""
    total = F.try_add(price, fees)
    return F.when(price.isNull(), None).when(includes_fees, price).when((fees >= 0) & (price >= 0) & (total >= 0), total)
