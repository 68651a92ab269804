"""Documents to listings and properties, and the whole plan."""

import datetime as dt
import json

from pyspark.sql import functions as F

from terrasift.operators import render
from terrasift.operators.coverage import coverage, discovered, issues, plan_estimate, route_table
from terrasift.sources.scratch import staged
from terrasift.plans.search import SearchPlan, page_details, snapshot_listings
from terrasift.sources.previous import parse_previous
from terrasift.sources.records import challenge, script_text, search_response
from terrasift.sources.scratch import BATCH_ROWS, parsed_once
from terrasift.spec import Boundary, DetailFilters, Route, SearchFilters, SearchSpec

TODAY = dt.date(2026, 7, 21)


def script(value, before="", attributes=""):
    return f"<html>{before}<script {attributes} id='__NEXT_DATA__'>{json.dumps(value)}</script></html>"


def snapshot(rows, more=None, **search):
    results = {"listResults": rows} | ({} if more is None else {"mapResults": more})
    state = {"queryState": {"pagination": {"currentPage": 2}}, "cat1": {"searchResults": results, "searchList": {"totalResultCount": 7, "totalPages": 3}}}
    return {"props": {"pageProps": {"searchPageState": state | search}}}


def read(spark, *documents):
    docs = spark.createDataFrame([(f"d{i}", d if isinstance(d, str | None) else json.dumps(d)) for i, d in enumerate(documents)], "source_id string, document string")
    return snapshot_listings(docs, F.lit(TODAY))


def test_list_then_map_and_first_wins(spark):
    doc = snapshot([{"zpid": "1", "unformattedPrice": 5}, {"zpid": 2, "detailUrl": "/homedetails/x/2_zpid/"}], [{"zpid": "2"}, {"zpid": "9", "unformattedPrice": 7}, {"zpid": "1"}])
    rows, told = read(spark, doc, script(doc, before="<!-- <script id='__NEXT_DATA__'>{}</script> -->", attributes='nonce="abc>def"'))
    got = [tuple(r) for r in rows.orderBy("source_id", "group", "ord").select("source_id", "id", "url", "price").collect()]
    one = [("1", "", 5), ("2", "https://www.zillow.com/homedetails/x/2_zpid/", None), ("9", "https://www.zillow.com/homedetails/9_zpid/", 7)]
    assert got == [(d, *r) for d in ("d0", "d1") for r in one]
    meta = told.orderBy("source_id").first()
    assert (meta.currentPage, meta.returned, meta.totalPages, meta.totalResults) == (2, 3, 3, 7)


def test_building_card(spark):
    card = {"id": "b", "detailUrl": "https://x/b", "isBuilding": True, "minBaseRent": 1980, "totalRequiredMonthlyMinFee": 45, "listPriceIncludesRequiredMonthlyFees": False, "statusType": "FOR_RENT", "units": [{"beds": "2", "price": "$1,980+"}, {"beds": "3", "roomForRent": True}]}
    row = read(spark, snapshot([card]))[0].first()
    assert (row.price, row.requiredMonthlyFees, row.totalMonthlyCost, row.bedrooms, row.homeType, row.sharedHousing, row.isBuilding) == (1980, 45, 2025, 3.0, "APARTMENT", True, True)


def test_drift(spark):
    good = [{"zpid": 1}, {"address": "1 A St"}, {"address": {"streetAddress": "2 B"}}, {"url": "https://x/1"}, {"zpid": "3", "beds": None}]
    bad = [{}, {"unknown": 1}, {"zpid": " "}, {"zpid": "1", "beds": "many"}, {"zpid": "1", "area": 1.5}, {"zpid": [1]}, {"zpid": "1", "address": 5}]
    rows, told = read(spark, *(snapshot([g]) for g in good), *(snapshot([b]) for b in bad))
    drift = {r.source_id: r.drift for r in told.collect()}
    assert [drift[f"d{i}"] is None for i in range(12)] == [True] * 5 + [False] * 7
    assert rows.count() == 5
    assert drift["d8"].detail == "beds must be numeric" and drift["d8"].path.endswith("listResults[0]")


def test_broken_documents(spark):
    docs = [None, "", "[]", "{", '{"a":1} 2', snapshot({}), {"props": {}}, "<p>", snapshot([5])]
    rows, told = read(spark, *docs)
    assert rows.count() == 0 and told.filter("drift IS NULL").count() == 0 and told.count() == len(docs)


def test_response_paths(spark):
    docs = [{"data": {"cat1": {"searchResults": {"listResults": [{"zpid": 1}]}}}}, {"z": [{"deep": {"listResults": [{"zpid": 2}]}}]}]
    df = spark.createDataFrame([(json.dumps(d),) for d in docs], "d string").select(search_response(F.col("d")).alias("s"))
    assert [r.s.listings[0].path for r in df.collect()] == ["data.cat1.searchResults.listResults[0]", "z[0].deep.listResults[0]"]


def test_script_and_challenge(spark):
    assert script_text("<script>var a='<script id=__NEXT_DATA__>'</script><SCRIPT data-x=\"id='y'\" id=\"__NEXT_&#68;ATA__\">{}</SCRIPT>") == "{}"
    assert script_text("<div id='__NEXT_DATA__'></div>") is None and script_text("<!-- ") is None
    df = spark.createDataFrame([("<html>Press & Hold</html>", False), ("<html>captcha</html>", True), ("{}", False)], "d string, has boolean")
    assert [r[0] for r in df.select(challenge(F.col("d"), F.col("has"))).collect()] == ["press-and-hold challenge page", None, None]


COMMUNITY = {
    "zpid": "41", "streetAddress": "6 Birch Ln", "city": "Tacoma", "state": "WA", "zipcode": "98402", "description": "quiet court", "buildingAttributes": {"hasSharedLaundry": True},
    "floorPlans": [
        {"zpid": "6610", "beds": 2, "sqft": 840, "minBaseRent": 2150, "amenityDetails": ["In unit washer"], "description": "corner plan", "units": [
            {"zpid": "6620", "unitNumber": "C", "baseRent": 2280, "totalRequiredMonthlyMinFee": 64, "listPriceIncludesRequiredMonthlyFees": False, "availableFrom": "2026-11-05", "description": "top floor"},
            {"zpid": "6620", "baseRent": 1}, {"note": "nothing"}]},
        {"zpid": "6630", "minPrice": "$1,910", "beds": 1}],
    "ungroupedUnits": [{"price": "$1.5k"}, {"price": "$1.5k"}],
}
PROPERTY = {
    "zpid": 31415, "url": "/homedetails/31415_zpid/", "streetAddress": "8 Larch Ct", "city": "Tacoma", "state": "WA", "zipcode": "98402", "price": "$512,300", "bedrooms": 3,
    "resoFacts": {"laundryFeatures": ["In Unit"], "appliances": ["Washer", "Dishwasher"], "parkingFeatures": ["Attached Garage"], "availabilityDate": 1788998400000, "atAGlanceFacts": [{"factLabel": "Pets", "factValue": "Cats, dogs OK"}], "rooms": [{"roomType": "Office"}]},
    "priceHistory": [{"date": "2026-07-02", "event": "Listed for rent", "postingIsRental": True}, {"date": "2026-07-14", "event": "Price change", "postingIsRental": True}],
}


def page(cache, **props):
    return script({"props": {"pageProps": {"componentProps": {"gdpClientCache": cache}} | props}})


def details(spark, *documents):
    pages = spark.createDataFrame([(f"https://z/{i}", d) for i, d in enumerate(documents)], "link string, document string")
    return page_details(pages, F.lit(TODAY))


def test_community(spark):
    doc = script({"props": {"pageProps": {"componentProps": {"initialReduxState": {"gdp": {"building": COMMUNITY}}}}}})
    rows, errors = details(spark, doc)
    got = [tuple(r) for r in rows.orderBy("ord").select("id", "price", "totalMonthlyCost", "laundry", "availability", "bedrooms").collect()]
    assert got == [("6620", 2280, 2344, "in-unit", "2026-11-05", 2.0), ("", 2150, None, "in-unit", "", 2.0), ("6630", 1910, None, "shared", "", 1.0), ("", 1500, None, "shared", "", None), ("", 1500, None, "shared", "", None)]
    unit = rows.filter("id = '6620'").first()
    assert unit.description == "top floor | corner plan | quiet court" and unit.address.full == "6 Birch Ln #C, Tacoma WA 98402"
    assert errors.count() == 0


def test_property_choice(spark):
    other = {"zpid": "5", "url": "/x", "price": 1, "bedrooms": 1, "bathrooms": 1, "livingArea": 3, "description": "rich"}
    twice = {"a": {"property": {"zpid": 31415}}, "b": {"property": PROPERTY}}
    docs = [
        page(json.dumps({"q": {"property": PROPERTY}, "r": {"property": other}}), zpid="31415"),
        page({"q": {"property": PROPERTY}, "r": {"property": other}}),
        page(twice),
        page({"q": {"property": {"price": 1}}, "r": {"property": PROPERTY}}),
        page({"q": {"property": {"zpid": 1, "url": "/homedetails/2_zpid/"}}}),
        "<p>",
        page(json.dumps(json.dumps(json.dumps({})))),
    ]
    rows, errors = details(spark, *docs)
    assert [r.link for r in rows.orderBy("link").collect()] == ["https://z/0", "https://z/2"]
    p = rows.filter("link = 'https://z/0'").first()
    assert (p.id, p.price, p.laundry, p.parking, p.petPolicy, p.flexSpaces, p.availability, p.daysListed, p.listedDate) == ("31415", 512300, "in-unit", "private-garage", "restricted", ["office", "private-garage"], "2026-09-10", 19, "2026-07-02")
    assert errors.count() == 5


def test_plan(spark):
    base = [{"zpid": str(i), "unformattedPrice": 1000 * i, "beds": i, "detailUrl": f"https://z/{i}", "address": {"streetAddress": f"{i} A", "city": "Seattle", "state": "WA", "zipcode": "98101"}} for i in range(1, 5)]
    listings = read(spark, snapshot(base))[0].drop("source_id").withColumn("location", F.lit("Seattle WA"))
    found, errors = details(spark, "<p>", page({"q": {"property": PROPERTY | {"zpid": "1"} | {"url": "/homedetails/1_zpid/"}}}))
    # documents are parsed once; what follows looks at the result five times
    listings, found, errors = staged(listings), staged(found), staged(errors)
    spec = SearchSpec(filters=SearchFilters(min_beds=1), details=DetailFilters(laundry="in-unit", unknown_laundry="watchlist"), boundary=Boundary(strict=True), sort_by="price-desc", limit=3)
    plan = SearchPlan(spec, TODAY)
    rows = plan.build(listings, found, errors, previous=listings.filter("id != '4'"), order=["group", "ord"])
    got = [(r.id, r.price, r.matchStatus, r.detailStatus, r.historyStatus) for r in plan.ordered(rows).collect()]
    assert got == [("1", 512300, "match", "enriched", "previously-surfaced-changed"), ("4", 4000, "watchlist", "unavailable", "new-to-digest"), ("3", 3000, "watchlist", "unavailable", "previously-surfaced-changed")]
    table = render.table(rows)
    assert table.columns[:3] == ["ID", "PRICE", "BEDS"] and {"MATCH", "HISTORY", "LAUNDRY"} <= set(table.columns)
    assert "$512,300" in render.aligned(render.checked(table))
    assert render.property_table(found, ["link"]).count() == 24
    lines = render.location_lines(rows.select("location", "group", "ord", "id"), spark.createDataFrame([("Seattle WA", "late")], "location string, error string"), ["group", "ord"])
    assert [json.loads(r.line).get("error") for r in lines.collect()] == [None, None, None, "late"]


def test_boundary(spark):
    rows = [("Seattle", "WA", "98101"), ("Bellevue", "WA", "98004"), ("", "", ""), ("Seattle", "OR", "98101")]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, address struct<city: string, state: string, postalCode: string>")
    from terrasift.operators.filters import inside

    def ids(query, boundary, unknown=False):
        return sorted(r.i for r in df.filter(inside(F.lit(query), boundary, unknown)).collect())

    assert ids("Seattle WA", Boundary(strict=True)) == [0]
    assert ids("Seattle WA", Boundary(strict=True), True) == [0, 2]
    assert ids("98101", Boundary(strict=True)) == [0, 3]
    assert ids("Eastside WA", Boundary(strict=True, city_aliases={"eastside wa": ["bellevue"]})) == [1]
    assert ids("x", Boundary(allowed_cities=frozenset({"bellevue"}))) == [1]
    assert ids("x", Boundary()) == [0, 1, 2, 3]


def test_previous_shapes(spark):
    row = {"id": "1", "address": {"full": "x"}}
    docs = [json.dumps([row]), json.dumps({"listings": [row, row]}), json.dumps({"results": [{"listings": [row]}, {"error": "e"}]}), "\n".join(map(json.dumps, [{"location": "a", "listing": row}, {"location": "b", "error": "late"}, row]))]
    df = spark.createDataFrame([(f"d{i}", d) for i, d in enumerate(docs)], "source_id string, document string")
    got = {r["source_id"]: r["count"] for r in parse_previous(df).groupBy("source_id").count().collect()}
    assert got == {"d0": 1, "d1": 2, "d2": 1, "d3": 2}


def test_coverage(spark):
    pages = spark.createDataFrame([("a", 1, 2, 4, 2), ("a", 2, 2, 4, 3), ("b", 1, None, None, 1), ("b", 2, None, None, 1)], "route string, page int, total_pages int, total_results int, n_items int")
    ids = [("a", 1, 0, "101"), ("a", 1, 1, "shared"), ("a", 2, 0, "201"), ("a", 2, 1, "shared"), ("a", 2, 2, ""), ("b", 1, 0, "x"), ("b", 2, 0, "y")]
    items = spark.createDataFrame(ids, "route string, page int, ord int, id string").withColumn("url", F.lit("")).withColumn("address", F.struct(F.lit("").alias("full")))
    got = {r.route: (r.pagesFetched, r.totalPages, r.uniqueListings, r.complete) for r in coverage(pages, items).collect()}
    assert got == {"a": (2, 2, 4, True), "b": (2, None, 2, False)}
    once = discovered(items.withColumn("route_ord", F.when(F.col("route") == "a", 0).otherwise(1)))
    assert once.count() == 6
    bad = spark.createDataFrame([("L", 1, 2, "late"), ("L", 0, 1, "first")], "location string, route_ord int, page int, error string")
    assert tuple(issues(bad).first()) == ("L", 2, "first")
    routes = route_table(spark, [Route("r", max_pages=3), Route("s")], 5).withColumn("location", F.lit("L"))
    assert tuple(plan_estimate(routes, dt.timedelta(seconds=5), dt.timedelta(seconds=5)).first()) == (9, 35.0)


def test_filters_reach_below_the_details(spark):
    """What is known before the details is tested before they are looked up: in the optimized plan below the join."""
    from pathlib import Path

    from terrasift import search_queries

    data = "/root/testdata/sf0.001"
    if not Path(data).exists():
        pytest.skip("no test tables")
    plan = search_queries.search(spark, data)._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Join LeftOuter, (link") :]
    scan = next(line for line in below.splitlines() if "Filter" in line and "o_totalprice" in line)
    assert "200000" in scan and "<= 30" in scan and "springfield" in scan


def test_documents_go_to_python_in_small_batches(spark):
    """However many documents a task has, few are parsed at once; the session's settings hold again afterwards."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    seen = F.pandas_udf(lambda x: x * 0 + len(x), "long")
    counts = parsed_once(spark.range(100, numPartitions=1).select(seen("id").alias("n")))
    assert counts.agg(F.max("n"), F.count("n")).first() == (BATCH_ROWS, 100)
    assert spark.conf.get(name) == before


def test_listings_do_not_carry_their_document(spark, monkeypatch):
    """What is written for a listing holds its own fields and the document's metadata, not the document's other listings."""
    kept = []
    monkeypatch.setattr("terrasift.operators.normalize.parsed_once", lambda rows: kept.append(rows.columns) or rows)
    snapshot_listings(spark.createDataFrame([("a", "{}")], "source_id string, document string"), F.lit(TODAY))
    assert kept == [["source_id", "head", "group", "ord", "path", "listing", "fault"]]


def test_listings_are_settled_within_their_document(spark):
    """No listing is shuffled, nor what documents tell of themselves, as long as no document's id repeats."""
    rows, told = read(spark, snapshot([{"zpid": 1}, {"zpid": 1}]), snapshot([{"zpid": 1}, {"zpid": "2", "beds": "many"}]), "{")
    assert all("Exchange" not in x._jdf.queryExecution().executedPlan().toString() for x in (rows, told))
    assert [r.id for r in rows.collect()] == ["1"] and sorted(r.returned for r in told.collect()) == [0, 0, 1]


def test_documents_with_one_id(spark):
    """Their listings count once, and fail together."""
    docs = [("a", [{"zpid": 1}, {"zpid": 2}]), ("a", [{"zpid": 2}, {"zpid": 3}]), ("b", [{"zpid": 4}]), ("b", [{"beds": "many"}]), (None, [{"zpid": 5}])]
    df = spark.createDataFrame([(k, json.dumps(snapshot(rows))) for k, rows in docs], "source_id string, document string")
    rows, told = snapshot_listings(df, F.lit(TODAY))
    assert sorted(r.id for r in rows.collect()) == ["1", "2", "3", "5"]
    assert sorted(((r.source_id, r.drift is None, r.returned) for r in told.collect()), key=repr) == [("a", True, 3), ("b", False, 0), (None, True, 1)]
