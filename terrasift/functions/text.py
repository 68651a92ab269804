"""Text functions as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, for Java's regular expressions.
SPACE = r"[\s\x{0085}\p{Z}]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trim_ws(c: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def collapse_ws(c: Column) -> Column:
    """Trimmed, and with one space for each run of white space."""
    return trim_ws(F.regexp_replace(c, f"{SPACE}+", " "))


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def null_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def canonical_text(c: Column) -> Column:
    """Lower case; everything but letters and numbers becomes single spaces; trimmed."""
    return F.trim(F.regexp_replace(F.lower(text_or_empty(c)), r"[^\p{L}\p{N}]+", " "))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def contains_any(text: Column, *terms: str) -> Column:
    return any_of([text.contains(term) for term in terms])


def contains_word(text: Column, word: str) -> Column:
    """Whether one of the words of a canonical text is ``word``."""
    return F.concat(F.lit(" "), text, F.lit(" ")).contains(f" {word} ")


def matches_words(text: Column, *patterns: str) -> Column:
    """Whether a pattern matches between ASCII word boundaries."""
    return text.rlike(f"(?<![0-9A-Za-z_])(?:{'|'.join(patterns)})(?![0-9A-Za-z_])")


def normalize_city(c: Column) -> Column:
    """Letters and digits in lower case; other runs become one space."""
    return canonical_text(c)


def location_slug(c: Column) -> Column:
    """Letters and digits as they are; other runs become one hyphen."""
    return F.regexp_replace(F.regexp_replace(c, r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")


def state_qualifier(c: Column) -> Column:
    """The last word in upper case if it has two ASCII letters and isn't the only one; else empty."""
    return F.upper(F.regexp_extract(c, f"{SPACE}([A-Za-z]{{2}}){SPACE}*$", 1))


def query_city(c: Column) -> Column:
    """What stands before the state, normalized; empty without a state."""
    return F.when(state_qualifier(c) != "", normalize_city(F.regexp_extract(c, f"^(.*){SPACE}[A-Za-z]{{2}}{SPACE}*$", 1))).otherwise("")


def postal_code(c: Column) -> Column:
    """Five ASCII digits, or null."""
    return F.when(trim_ws(c).rlike("^[0-9]{5}$"), trim_ws(c))


def unique_fold(values: Column) -> Column:
    """Trimmed, not blank, and the first spelling of each string without regard to case."""
    trimmed = F.filter(F.transform(values, trim_ws), lambda x: x != "")
    empty = F.array().cast("array<string>")
    add = lambda held, x: F.when(F.exists(held, lambda y: F.lower(y) == F.lower(x)), held).otherwise(F.array_append(held, x))
    return F.coalesce(F.aggregate(trimmed, empty, add), empty)


def text_set(values: Column) -> Column:
    """Lower case, collapsed, without blanks, distinct and sorted: equal for equal sets."""
    folded = F.transform(values, lambda x: F.lower(collapse_ws(x)))
    return F.coalesce(F.array_sort(F.array_distinct(F.filter(folded, lambda x: x != ""))), F.array().cast("array<string>"))


def has_any_value(values: Column, wanted: list[str]) -> Column:
    """Whether a value is wanted, in any case and without regard to white space around it."""
    folded = F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x: F.lower(trim_ws(x)))
    return F.arrays_overlap(folded, F.array(*(F.lit(x.strip().lower()) for x in wanted)))


def is_control_free(c: Column) -> Column:
    return ~c.rlike(r"\p{Cc}")
