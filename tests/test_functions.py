"""Scalar rules, case by case."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from terrasift.functions import classify as C
from terrasift.functions import dates as D
from terrasift.functions import redact as R
from terrasift.functions import tagged as T
from terrasift.functions import text as X

TODAY = dt.date(2026, 7, 21)


def values(spark, cases, kind, *columns):
    """Each column function over all inputs, in order."""
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], f"i int, c {kind}").coalesce(1)
    out = rows.select("i", *(f(F.col("c")).alias(f"o{k}") for k, f in enumerate(columns))).orderBy("i").collect()
    return [tuple(r)[1:] if len(columns) > 1 else r[1] for r in out]


def test_money_text(spark):
    cases = {
        "$1,234": 1234, "1.5k": 1500, "2M": 2_000_000, "1b": 1_000_000_000, "$1,000/mo": 1000, "$2,500+": 2500, "3kg": 3, "1.5": 2, "2.5": 3,
        " 7 ": 7, "1 - 2": None, "-5": None, "$-5": None, "−$ 5": None, "12,34": None, "1,234,5678": None, "9e99": None, "": None, "abc": None,
        "1.2.3": None, "99999999999999999999": None, "0": 0, "1,234,567": 1234567, "5K ": 5000, "5k1": None,
    }
    assert values(spark, list(cases), "string", T.parse_money) == list(cases.values())


def test_tagged_scalars(spark):
    cases = [
        (("number", "5"), 5, 5.0, None, "5"), (("number", "1e3"), 1000, 1000.0, None, "1e3"), (("number", "1.9"), None, 1.9, None, "1.9"),
        (("string", " 7 "), 7, 7.0, None, "7"), (("string", "7.0"), None, 7.0, None, "7.0"), (("number", "9223372036854775808"), None, 9.223372036854776e18, None, "9223372036854775808"),
        (("string", "NaN"), None, None, None, "NaN"), (("string", "1d"), None, None, None, "1d"), (("bool", "true"), None, None, True, None),
        (("string", "yes"), None, None, None, "yes"), (("string", "F"), None, None, False, "F"), (("array", ""), None, None, None, None), (None, None, None, None, None),
    ]
    got = values(spark, [c[0] for c in cases], T.TAGGED, T.as_long, T.as_double, T.as_bool, T.as_string)
    assert got == [c[1:] for c in cases]


def test_total_cost(spark):
    rows = [(None, 1, None), (100, None, True), (100, 20, False), (100, None, False), (100, -1, None), (2**63 - 1, 1, False)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, p long, f long, b boolean")
    got = [r[0] for r in df.orderBy("i").select(T.total_cost(F.col("p"), F.col("f"), F.col("b"))).collect()]
    assert got == [None, 100, 120, None, None, None]


def test_availability(spark):
    cases = {("string", "2026-08-15"): "2026-08-15", ("number", "1786752000000"): "2026-08-15", ("string", "1786752000"): "2026-08-15", ("string", "Aug 5, 2026"): "2026-08-05", ("string", "soon"): "soon", ("number", "0"): "", ("null", None): "", ("string", "2026-08-15T10:00:00Z"): "2026-08-15"}
    assert values(spark, list(cases), T.TAGGED, D.normalized_availability) == list(cases.values())
    dates = {"now": TODAY, "Available Now": TODAY, "2026-09-01": dt.date(2026, 9, 1), "": None, "later": None, "September 3, 2026": dt.date(2026, 9, 3)}
    assert values(spark, list(dates), "string", lambda c: D.availability_date(c, F.lit(TODAY))) == list(dates.values())


@pytest.mark.parametrize(
    ("features", "said", "laundry"),
    [
        (["Washer dryer hookups"], "", "hookups"), ([], "coin-operated laundry", "shared"), ([], "No laundry here", "none"), (["In Unit"], "", "in-unit"),
        (["Washer", "Dryer"], "", "in-unit"), (["Washer"], "", "unknown"), ([], "washer and dryer included", "in-unit"), (["In", "Unit washer"], "", "in-unit"),
    ],
)
def test_laundry(spark, features, said, laundry):
    df = spark.createDataFrame([(features, said)], "f array<string>, d string")
    assert df.select(C.classify_laundry(F.col("f"), F.col("d"))).first()[0] == laundry


def test_parking_pets_flex(spark):
    parking = {"Attached Garage": "private-garage", "Attached garage in community garage": "garage", "Garage": "garage", "Carport": "available", "No parking": "none", "": "unknown"}
    assert values(spark, [[k] for k in parking], "array<string>", lambda c: C.classify_parking(c, F.lit(""))) == list(parking.values())
    pets = {"No pets": "not-allowed", "Pets allowed": "allowed", "Cats only": "restricted", "cats, dogs": "restricted", "breed restrictions": "restricted", "": "unknown", "Pets allowed, small dogs": "restricted"}
    assert values(spark, [[k] for k in pets], "array<string>", C.classify_pets) == list(pets.values())
    flex = {"a den": ["den"], "hidden": [], "home office and bonus room": ["office", "bonus"], "xéden": ["den"], "open loft": ["loft"], "flex space": ["flex"]}
    assert values(spark, list(flex), "string", lambda c: C.classify_flex(c, F.array().cast("array<string>"), F.lit("x"))) == list(flex.values())


def test_recency(spark):
    tag = lambda date, event, rental=True: {"date": ("string", date), "event": ("string", event), "postingIsRental": ("bool", str(rental).lower())}
    cases = [
        [tag("2026-07-18", "Price change"), tag("2026-07-10", "Listed for rent")],
        [tag("2026-07-10", "Listed for rent"), tag("2026-07-11", "Listing removed")],
        [tag("2026-07-10", "Listed for sale", False)],
        [tag("2027-01-01", "Listed for rent")],
        [tag("bad", "Listed for rent")],
        None,
    ]
    got = values(spark, cases, f"array<map<string, {T.TAGGED}>>", lambda c: D.recency(D.history_events(c), F.lit(TODAY)))
    assert [None if g is None else tuple(g) for g in got] == [(dt.date(2026, 7, 10), dt.date(2026, 7, 18), 11), (None,) * 3, (None,) * 3, (dt.date(2027, 1, 1), dt.date(2027, 1, 1), None), (None,) * 3, None]


def test_text(spark):
    assert values(spark, ["  Über-Cool X! ", None, "1–2"], "string", X.canonical_text) == ["über cool x", "", "1 2"]
    assert values(spark, ["Seattle WA", "98101", "wa", "New York, ny "], "string", X.state_qualifier, X.query_city) == [("WA", "seattle"), ("", ""), ("", ""), ("NY", "new york")]
    assert values(spark, [[" A", "a", "", "B"], []], "array<string>", X.unique_fold) == [["A", "B"], []]
    assert values(spark, ["St. Paul--MN"], "string", X.location_slug) == ["St-Paul-MN"]


def test_secrets(spark):
    names = {"X-API-Key": True, "monkey": False, "user_email": True, "Authorization": True, "design": False, "pricing": False}
    assert values(spark, list(names), "string", R.is_sensitive_key) == list(names.values())
    texts = {"Bearer abc": True, "aaaaaaaa.bbbbbbbb.cccccccc": True, "a.b.c": False, "hello": False}
    assert values(spark, list(texts), "string", R.is_credential) == list(texts.values())
    assert values(spark, ["application/json; charset=x", "a/b+json", "text/html"], "string", R.is_json_media) == [True, True, False]
