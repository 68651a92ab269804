"""Records to listings and properties, by column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrasift.functions import classify as C
from terrasift.functions import dates as D
from terrasift.functions import tagged as T
from terrasift.functions.text import let, null_if_empty, trim_ws, unique_fold
from terrasift.schemas import LISTING_FIELDS, PROPERTY_FIELDS
from terrasift.sources.scratch import parsed_once

# The site that relative links belong to, and what notes say.
SITE = "https://www.zillow.com"
GARAGE_NOTE = "Private garage must be verified as exclusive-use, non-shared, and included in rent."
PLAN_NOTE = "Floor plan availability and exact unit details require verification."
COST_NOTE = "Required monthly fees and total monthly cost need verification."

Get = Callable[[str], Column]


def getter(record: Column) -> Get:
    """The tagged scalar of a path; null if the record is."""
    return lambda path: F.try_element_at(record["scalars"], F.lit(path))


def texts(record: Column, *paths: str) -> Column:
    """The strings at some paths, one after another."""
    empty = F.array().cast("array<string>")
    parts = [F.coalesce(F.try_element_at(record["strings"], F.lit(p)), empty) for p in paths]
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def objects(record: Column, path: str) -> Column:
    return F.try_element_at(record["lists"], F.lit(path))


def absolute_url(c: Column) -> Column:
    """A link as it is if it has a scheme; else below the site."""
    url = trim_ws(c)
    path = F.when(url.startswith("/"), url).otherwise(F.concat(F.lit("/"), url))
    return F.when(url == "", "").when(url.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), url).when(url.startswith("//"), F.concat(F.lit("https:"), url)).otherwise(F.concat(F.lit(SITE), path))


def property_url(id_: Column, fallback: Column) -> Column:
    known = F.concat(F.lit(f"{SITE}/homedetails/"), id_, F.lit("_zpid/"))
    return F.when(id_.rlike("^0*[1-9][0-9]*$"), known).when(fallback.rlike("^https://[^/]+"), fallback).otherwise("")


def identifier_in_url(url: Column) -> Column:
    """The last path segment ``<digits>_zpid``'s digits, or null."""
    path = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")
    found = F.regexp_extract_all(path, F.lit(r"(?i)(?<=^|/)0*([1-9][0-9]*)_zpid(?=/|$)"), 1)
    return F.get(found, F.size(found) - 1)


def join_address(street: Column, city: Column, state: Column, postal: Column) -> Column:
    """``street, city state zip`` of the parts that aren't blank."""
    parts = [null_if_empty(trim_ws(p)) for p in (city, state, postal)]
    return F.concat_ws(", ", null_if_empty(trim_ws(street)), null_if_empty(F.concat_ws(" ", *parts)))


def address(get: Get) -> Column:
    nested = lambda *keys: [get(f"address.{key}") for key in keys]
    own = lambda *keys: [get(key) for key in keys]
    street = T.first_string(*own("addressStreet", "streetAddress"), *nested("streetAddress", "addressStreet"))
    city = T.first_string(*own("addressCity", "city"), *nested("city", "addressCity"))
    state = T.first_string(*own("addressState", "state"), *nested("state", "addressState"))
    postal = T.first_string(*own("addressZipcode", "zipcode", "postalCode"), *nested("zipcode", "postalCode", "addressZipcode"))
    full = F.coalesce(F.when(T.is_string(get("address")), trim_ws(get("address")["text"])), T.first_string(*nested("full", "formattedAddress")))
    parts = F.struct(street.alias("street"), city.alias("city"), state.alias("state"), postal.alias("postalCode"), full.alias("full"))
    whole = lambda a: a.withField("full", F.when(a["full"] == "", join_address(a["street"], a["city"], a["state"], a["postalCode"])).otherwise(a["full"]))
    return let(parts, whole)


def coordinates(get: Get) -> Column:
    latitude = T.first_double(*map(get, ("latitude", "lat", "latLong.latitude", "latLong.lat")))
    longitude = T.first_double(*map(get, ("longitude", "lng", "lon", "latLong.longitude", "latLong.lng", "latLong.lon")))
    return F.struct(latitude.alias("latitude"), longitude.alias("longitude"))


def wrong(get: Get, keys: list[str], expected: str, valid: Callable[[Column], Column], prefix: str = "") -> list[Column]:
    """For each key the complaint, or null if its value is absent or valid."""
    bad = lambda tag: T.present(tag) & ~F.coalesce(valid(tag), F.lit(False))
    return [F.when(let(get(f"{prefix}{key}"), bad), F.lit(f"{prefix}{key} must be {expected}")) for key in keys]


def _address_faults(get: Get) -> list[Column]:
    kind = F.when(T.present(get("address")) & ~get("address")["kind"].isin("string", "object"), F.lit("address must be a string or object"))
    names = ["streetAddress", "addressStreet", "city", "addressCity", "state", "addressState", "full", "formattedAddress"]
    text = wrong(get, names, "a string", T.is_string, "address.")
    return [kind, *text, *wrong(get, ["zipcode", "postalCode", "addressZipcode"], "a string or number", lambda t: T.as_string(t).isNotNull(), "address.")]


def _coordinate_faults(get: Get) -> list[Column]:
    kind = F.when(T.present(get("latLong")) & (get("latLong")["kind"] != "object"), F.lit("latLong must be an object"))
    return [kind, *wrong(get, ["latitude", "lat", "longitude", "lng", "lon"], "numeric", lambda t: T.as_double(t).isNotNull(), "latLong.")]


def listing_fault(get: Get) -> Column:
    """The first complaint about a listing's fields, or null."""
    named = lambda t: T.as_string(t).isNotNull()
    numeric = lambda t: T.as_double(t).isNotNull()
    texts_ = [
        "detailUrl", "hdpUrl", "url", "homeType", "propertyType", "statusType", "homeStatus", "statusText", "imgSrc", "imageUrl",
        "addressStreet", "streetAddress", "addressCity", "city", "addressState", "state", "availabilityDate",
    ]
    return F.coalesce(
        *wrong(get, ["zpid", "id", "addressZipcode", "zipcode", "postalCode"], "a string or number", named),
        *wrong(get, texts_, "a string", T.is_string),
        *wrong(get, ["beds", "bedrooms", "baths", "bathrooms", "latitude", "lat", "longitude", "lng", "lon"], "numeric", numeric),
        *wrong(get, ["area", "livingArea", "daysOnZillow"], "an integer", T.is_integral),
        *wrong(get, ["unformattedPrice"], "a money value", T.is_money),
        *wrong(get, ["price"], "a string or number", lambda t: T.is_string(t) | numeric(t)),
        *_address_faults(get),
        *_coordinate_faults(get),
    )


def property_fault(get: Get) -> Column:
    """The first complaint about a property's fields, or null."""
    money = lambda t: T.as_long(t).isNotNull() | (T.is_string(t) & T.parse_money(t["text"]).isNotNull())
    names = [
        "streetAddress", "addressStreet", "city", "addressCity", "state", "addressState", "homeType", "propertyType",
        "homeStatus", "statusType", "statusText", "description", "imgSrc", "imageUrl",
    ]
    numbers = ["bedrooms", "beds", "bathrooms", "baths", "lotSize", "lotAreaValue", "latitude", "lat", "longitude", "lng", "lon"]
    return F.coalesce(
        *wrong(get, ["price", "unformattedPrice"], "a number or money string", money),
        *wrong(get, numbers, "numeric", lambda t: T.as_double(t).isNotNull()),
        *wrong(get, ["livingArea", "area", "yearBuilt"], "an integer", T.is_integral),
        *wrong(get, names, "a string", T.is_string),
        *wrong(get, ["zipcode", "postalCode", "addressZipcode"], "a string or number", lambda t: T.as_string(t).isNotNull()),
        *_address_faults(get),
        *_coordinate_faults(get),
    )


def max_unit_bedrooms(record: Column) -> Column:
    return F.array_max(F.transform(objects(record, "units"), lambda u: T.as_double(F.try_element_at(u, F.lit("beds")))))


def _shaped(fields: dict[str, str], values: dict[str, Column]) -> Column:
    """A struct of the relation's fields: absent text is empty, absent lists are, all else is null."""

    def value(name: str, kind: str) -> Column:
        if name in values:
            return values[name].cast(kind).alias(name)
        if kind == "string":
            return F.lit("").alias(name)
        return (F.array() if kind.startswith("array") else F.lit(None)).cast(kind).alias(name)

    return F.struct(*(value(name, kind) for name, kind in fields.items()))


def bound(body: Callable[..., Column], *values: Column) -> Column:
    """``body`` of values that are worked out once each."""
    names = [f"v{i}" for i in range(len(values))]
    return let(F.struct(*(v.alias(n) for v, n in zip(values, names, strict=True))), lambda s: body(*(s[n] for n in names)))


def recency_dates(history: Column, today: Column) -> Column:
    """struct<listed, updated, days> of a price history, dates as text."""
    text = lambda d: F.coalesce(F.date_format(d, "yyyy-MM-dd"), F.lit(""))
    shaped = lambda f: F.struct(text(f["listed"]).alias("listed"), text(f["updated"]).alias("updated"), f["days"].alias("days"))
    return let(D.recency(D.history_events(history), today), shaped)


PRICES = ["unformattedPrice", "baseRent", "minBaseRent", "minPrice", "price"]


def listing(record: Column, today: Column) -> Column:
    """A listing of a search result's record, whatever ``listing_fault`` says."""
    return let(record, lambda r: _listing(r, today))


def _listing(record: Column, today: Column) -> Column:
    get = getter(record)
    return bound(
        lambda *v: _listing_of(record, *v),
        C.is_true(get("isBuilding")),
        T.first_string(get("homeType"), get("propertyType")),
        T.first_string(get("description")),
        address(get),
        T.first_money(*map(get, PRICES)),
        T.first_money(get("totalRequiredMonthlyMinFee")),
        let(get("listPriceIncludesRequiredMonthlyFees"), T.as_bool),
        recency_dates(objects(record, "priceHistory"), today),
    )


def _listing_of(record: Column, building: Column, home_type: Column, description: Column, where: Column, price: Column, fees: Column, includes: Column, dates: Column) -> Column:
    get = getter(record)
    shared, student = C.housing_kind(get, objects(record, "units"), description, where["full"])
    bedrooms = T.first_double(get("beds"), get("bedrooms"))
    return _shaped(LISTING_FIELDS, {
        "id": T.first_string(get("zpid"), get("id")),
        "url": let(T.first_string(*map(get, ("detailUrl", "hdpUrl", "url"))), absolute_url),
        "address": where,
        "priceText": F.coalesce(T.as_string(get("price")), F.lit("")),
        "price": price, "requiredMonthlyFees": fees, "priceIncludesRequiredFees": includes,
        "totalMonthlyCost": T.total_cost(price, fees, includes),
        "bedrooms": F.coalesce(F.when(building, max_unit_bedrooms(record)), bedrooms),
        "bathrooms": T.first_double(get("baths"), get("bathrooms")),
        "livingArea": T.first_long(get("area"), get("livingArea")),
        "homeType": F.when(building & (home_type == ""), "APARTMENT").otherwise(home_type),
        "status": T.first_string(*map(get, ("statusType", "homeStatus", "statusText"))),
        "isBuilding": building, "sharedHousing": shared, "studentHousing": student,
        "incomeRestricted": C.is_income_restricted(get, description),
        "imageUrl": T.first_string(get("imgSrc"), get("imageUrl")),
        "coordinates": coordinates(get),
        "daysListed": F.coalesce(T.first_long(get("daysOnZillow")), dates["days"], T.first_long(get("hdpData.homeInfo.daysOnZillow"))),
        "listedDate": dates["listed"], "updatedDate": dates["updated"],
        "availability": D.normalized_availability(get("availabilityDate")),
        "description": description,
    })


def glance_facts(record: Column) -> Column:
    """Map of lower-case labels to values of the facts at a glance; of a repeated label the last value."""
    text = lambda item, key: F.when(F.try_element_at(item, F.lit(key))["kind"] == "string", trim_ws(F.try_element_at(item, F.lit(key))["text"]))
    pairs = F.transform(objects(record, "resoFacts.atAGlanceFacts"), lambda i: F.struct(F.lower(text(i, "factLabel")).alias("key"), text(i, "factValue").alias("value")))
    full = F.filter(pairs, lambda p: (p["key"] != "") & (p["value"] != ""))
    last = F.filter(full, lambda p, i: ~F.exists(F.slice(full, i + 2, F.size(full)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def rental_facts(record: Column, description: Column) -> Column:
    """struct of laundry, parking, pets, flex spaces and availability of a property."""
    return let(glance_facts(record), lambda glance: _facts(record, description, glance))


def _facts(record: Column, description: Column, glance: Column) -> Column:
    get = getter(record)
    seen = lambda label: F.filter(F.array(F.try_element_at(glance, F.lit(label))), lambda x: x.isNotNull())
    flag = lambda key, name: F.filter(F.array(F.when((get(f"resoFacts.{key}")["kind"] == "bool") & (get(f"resoFacts.{key}")["text"] == "true"), F.lit(name))), lambda x: x.isNotNull())
    at = lambda *keys: texts(record, *(f"resoFacts.{key}" for key in keys))
    laundry = unique_fold(F.concat(at("laundryFeatures"), seen("laundry"), F.filter(at("appliances"), C.is_laundry_appliance)))
    parking = unique_fold(F.concat(at("parkingFeatures", "otherParking"), seen("parking"), flag("hasAttachedGarage", "Attached Garage"), flag("hasGarage", "Garage"), flag("hasOpenParking", "Open Parking")))
    pets = unique_fold(F.concat(at("allowedPets"), seen("pets"), flag("hasPetsAllowed", "Pets allowed")))
    available = F.coalesce(*(F.when(T.present(t), t) for t in (get("resoFacts.availabilityDate"), get("availabilityDate"))))
    told = F.try_element_at(glance, F.lit("date available"))
    available = F.coalesce(available, F.when(told.isNotNull(), F.struct(F.lit("string").alias("kind"), told.alias("text"))))
    spaces = unique_fold(at("rooms", "interiorFeatures", "otherInteriorFeatures"))

    def facts(laundry: Column, parking: Column, pets: Column, kind: Column) -> Column:
        named = {
            "laundry": C.classify_laundry(laundry, description), "laundryFeatures": laundry, "parking": kind, "parkingFeatures": parking,
            "petPolicy": C.classify_pets(pets), "allowedPets": pets, "flexSpaces": C.classify_flex(description, spaces, kind),
            "availability": D.normalized_availability(available),
        }
        return F.struct(*(c.alias(n) for n, c in named.items()))

    return bound(lambda a, b, c: let(C.classify_parking(b, description), lambda kind: facts(a, b, c, kind)), laundry, parking, pets)


FACTS = ["laundry", "laundryFeatures", "parking", "parkingFeatures", "petPolicy", "allowedPets", "flexSpaces", "availability"]


def garage_notes(flex: Column) -> Column:
    return F.array_compact(F.array(F.when(F.array_contains(flex, "private-garage"), F.lit(GARAGE_NOTE))))


def property_row(record: Column, identifier: Column, identity_url: Column, today: Column, raw: Column | None = None) -> Column:
    """A property of a page's record, whatever ``property_fault`` says."""

    def of(record: Column) -> Column:
        get = getter(record)
        return let(
            T.first_string(get("description")),
            lambda description: bound(
                lambda *v: _property_of(record, identifier, identity_url, raw, description, *v),
                address(get), rental_facts(record, description), T.first_money(*map(get, PRICES)), T.first_money(get("totalRequiredMonthlyMinFee")),
                let(get("listPriceIncludesRequiredMonthlyFees"), T.as_bool), recency_dates(objects(record, "priceHistory"), today),
                let(T.first_string(*map(get, ("url", "hdpUrl", "detailUrl"))), absolute_url),
            ),
        )

    return let(record, of)


def _property_of(record: Column, identifier: Column, identity_url: Column, raw: Column | None, description: Column, where: Column, facts: Column, price: Column, fees: Column, includes: Column, dates: Column, url: Column) -> Column:
    get = getter(record)
    shared, student = C.housing_kind(get, objects(record, "units"), description, where["full"])
    return _shaped(PROPERTY_FIELDS, {name: facts[name] for name in FACTS} | {
        "id": F.coalesce(identifier, T.first_string(get("zpid"), get("id"))),
        "url": F.when(url == "", F.coalesce(identity_url, F.lit(""))).otherwise(url),
        "address": where, "price": price, "requiredMonthlyFees": fees, "priceIncludesRequiredFees": includes,
        "totalMonthlyCost": T.total_cost(price, fees, includes),
        "bedrooms": T.first_double(get("bedrooms"), get("beds")),
        "bathrooms": T.first_double(get("bathrooms"), get("baths")),
        "livingArea": T.first_long(get("livingArea"), get("area")),
        "lotSize": T.first_double(get("lotSize"), get("lotAreaValue")),
        "yearBuilt": T.first_long(*map(get, ("yearBuilt", "resoFacts.yearBuilt", "resoFacts.yearBuiltEffective"))),
        "homeType": T.first_string(get("homeType"), get("propertyType")),
        "status": T.first_string(*map(get, ("homeStatus", "statusType", "statusText"))),
        "description": description,
        "imageUrl": T.first_string(*map(get, ("imgSrc", "imageUrl", "responsivePhotosOriginalRatio"))),
        "coordinates": coordinates(get),
        "daysListed": F.coalesce(T.first_long(get("daysOnZillow")), dates["days"]), "listedDate": dates["listed"], "updatedDate": dates["updated"],
        "sharedHousing": shared, "studentHousing": student, "incomeRestricted": C.is_income_restricted(get, description),
        "verificationNotes": garage_notes(facts["flexSpaces"]),
    } | ({} if raw is None else {"raw": raw}))


def rental_row(building: Column, plan: Column, unit: Column, merged: Column, source_url: Column, today: Column, raw: Column | None = None) -> Column:
    """A unit of a community, or a floor plan without units: the unit's values, else the plan's, else the building's."""
    of_unit, of_plan, of_building = map(getter, (unit, plan, building))
    either = lambda *keys: [*map(of_unit, keys), *map(of_plan, keys)]
    id_ = F.coalesce(F.when(unit.isNull(), T.normalize_identifier(of_plan("zpid"))).otherwise(T.normalize_identifier(of_unit("zpid"))), F.lit(""))
    said = [T.first_string(get("description"), get("additionalInformation")) for get in (of_unit, of_plan)]
    own = T.first_string(of_building("description"))
    description = F.concat_ws(" | ", *(null_if_empty(trim_ws(s)) for s in (*said, own)))
    features = unique_fold(F.concat(texts(unit, "amenityDetails", "unitFeatures"), texts(plan, "amenityDetails", "unitFeatures")))
    pets = unique_fold(F.concat(texts(unit, "allowedPets"), texts(plan, "allowedPets")))
    includes = F.coalesce(*(let(t, T.as_bool) for t in either("listPriceIncludesRequiredMonthlyFees")))
    available = F.coalesce(*(null_if_empty(D.normalized_availability(t)) for t in either("availableFrom", "availabilityDate")), F.lit(""))
    return bound(
        lambda *v: _rental_with(building, plan, unit, merged, source_url, raw, *v),
        id_, T.first_string(of_unit("unitNumber")), address(of_building), own, description, features, pets, includes, available,
        T.first_money(*either("baseRent", "minBaseRent", "minPrice", "price")), T.first_money(*either("totalRequiredMonthlyMinFee")),
    )


def _rental_with(building: Column, plan: Column, unit: Column, merged: Column, source_url: Column, raw: Column | None, id_: Column, number: Column, base: Column, own: Column, description: Column, features: Column, pets: Column, includes: Column, available: Column, price: Column, fees: Column) -> Column:
    street = F.when(number == "", base["street"]).otherwise(trim_ws(F.concat(base["street"], F.lit(" #"), number)))
    full = F.when(number == "", base["full"]).otherwise(join_address(street, base["city"], base["state"], base["postalCode"]))
    where = base.withField("street", street).withField("full", full)
    amenities = unique_fold(F.concat(features, texts(building, "commonUnitAmenities")))
    return bound(
        lambda *v: _rental_of(building, plan, unit, merged, source_url, raw, id_, base, own, description, features, pets, includes, available, price, fees, *v),
        where, amenities, T.total_cost(price, fees, includes), C.classify_parking(features, description), C.classify_laundry(features, description),
    )


def _rental_of(building: Column, plan: Column, unit: Column, merged: Column, source_url: Column, raw: Column | None, id_: Column, base: Column, own: Column, description: Column, features: Column, pets: Column, includes: Column, available: Column, price: Column, fees: Column, where: Column, amenities: Column, total: Column, parking: Column, narrow: Column) -> Column:
    of_unit, of_plan, of_building, of_both = map(getter, (unit, plan, building, merged))
    either = lambda *keys: [*map(of_unit, keys), *map(of_plan, keys)]
    common = F.when(C.is_true(of_building("buildingAttributes.hasSharedLaundry")), "shared").otherwise(C.UNKNOWN)
    wide = let(C.classify_laundry(amenities, description), lambda w: F.when(w != C.UNKNOWN, w))
    kinds = [C.housing_kind(of_building, objects(building, "units"), own, base["full"]), C.housing_kind(of_both, objects(merged, "units"), description, where["full"])]
    flex = C.classify_flex(description, amenities, parking)
    notes = F.array_compact(F.array(F.when(parking == "private-garage", F.lit(GARAGE_NOTE)), F.when(unit.isNull(), F.lit(PLAN_NOTE)), F.when(total.isNull(), F.lit(COST_NOTE))))
    return _shaped(PROPERTY_FIELDS, {
        "id": id_, "url": property_url(id_, source_url), "address": where, "price": price, "requiredMonthlyFees": fees,
        "totalMonthlyCost": total, "priceIncludesRequiredFees": includes,
        "bedrooms": T.first_double(*either("beds", "bedrooms")), "bathrooms": T.first_double(*either("baths", "bathrooms")),
        "livingArea": T.first_long(*either("sqft", "livingArea", "area")), "homeType": F.lit("APARTMENT"),
        "status": T.first_string(*either("homeStatus", "statusType", "statusText")), "description": description,
        "coordinates": coordinates(of_building), "availability": available,
        "laundry": F.when(narrow != C.UNKNOWN, narrow).otherwise(F.coalesce(wide, common)), "laundryFeatures": amenities,
        "parking": parking, "parkingFeatures": features, "petPolicy": C.classify_pets(pets), "allowedPets": pets, "flexSpaces": flex,
        "sharedHousing": kinds[0][0] | kinds[1][0], "studentHousing": kinds[0][1] | kinds[1][1],
        "incomeRestricted": C.is_income_restricted(of_building, own) | C.is_income_restricted(of_both, description),
        "verificationNotes": notes,
    } | ({} if raw is None else {"raw": raw}))


def search_listings(parsed: DataFrame, today: Column, key: str = "source_id") -> tuple[DataFrame, DataFrame]:
    """(listings, documents) of ``parsed``, which has ``key`` and ``search``, a parsed search document.

    One faulty listing fails its whole document; ``documents`` has the metadata, or where and how a document drifts.
    Listings keep their place: the list's before the map's, each in order; repeated ones go, the first stays.

    All of this is settled within a document's row, so that no listing is shuffled. Only if a ``key`` repeats do listings
    meet by it, as those of documents with one key are told apart and fail together.
    """
    from terrasift.operators.dedup import first_wins, listing_key

    def item(x: Column, row: Column) -> Column:
        nameless = (row["id"] == "") & (row["url"] == "") & (row["address"]["full"] == "")
        fault = F.coalesce(listing_fault(getter(x["record"])), F.when(nameless, F.lit("listing has no recognized core identity")))
        url = F.when(x["path"].rlike(r"\.mapResults\[") & (row["url"] == ""), property_url(row["id"], F.lit(""))).otherwise(row["url"])
        return F.struct(x["group"].alias("group"), x["ord"].alias("ord"), x["path"].alias("path"), row.withField("url", url).alias("listing"), fault.alias("fault"))

    def keyed(x: Column) -> Column:
        return F.struct(listing_key(lambda name: x["listing"][name]).alias("key"), *(x[c].alias(c) for c in ("group", "ord", "path", "listing")))

    def firsts(items: Column) -> Column:
        """By key and place, each key's first; those without a key all."""
        return let(F.sort_array(F.transform(items, keyed)), lambda s: F.filter(s, lambda x, i: x["key"].isNull() | ~x["key"].eqNullSafe(F.get(s, i - 1)["key"])))

    every = F.transform("search.listings", lambda x: let(listing(x["record"], today), lambda row: item(x, row)))
    docs = parsed.select(key, F.col("search.drift").alias("drift"), F.col("search.metadata").alias("metadata"), every.alias("every"))
    fault = let(F.get(F.filter("every", lambda x: x["fault"].isNotNull()), F.lit(0)), lambda x: F.when(x.isNotNull(), F.struct(x["path"].alias("path"), x["fault"].alias("detail"))))
    docs = docs.withColumn("fault", fault).withColumn("kept", F.when(F.col("drift").isNull() & F.col("fault").isNull(), firsts(F.col("every"))))
    returned = F.when(F.col("kept").isNull(), 0).otherwise(F.size("kept"))
    each = docs.select(key, "drift", "metadata", "fault", returned.alias("returned"), F.posexplode_outer("kept").alias("n", "item"))
    # what a listing's row carries of its document is small, as each of them carries it
    head = F.struct("drift", "metadata", "returned", (F.coalesce("n", F.lit(0)) == 0).alias("first"))
    rows = parsed_once(each.select(key, head.alias("head"), "item.group", "item.ord", "item.path", "item.listing", "fault"))
    drift = F.coalesce("head.drift", "fault")
    told = rows.filter("head.first").select(key, drift.alias("drift"), "head.metadata", "head.returned")
    kept = rows.filter("group IS NOT NULL").select(key, "group", "ord", "listing.*")
    if not rows.isStreaming and not told.groupBy(key).count().filter("count > 1").isEmpty():
        told = told.groupBy(key).agg(F.min("drift").alias("drift"), F.min("metadata").alias("metadata"))
        fine = told.filter("drift IS NULL").select(F.col(key).alias("_fine"))
        kept = first_wins(kept.join(fine, F.col(key).eqNullSafe(F.col("_fine")), "left_semi"), [key], listing_key(), ["group", "ord"])
        count = kept.groupBy(F.col(key).alias("_of")).agg(F.count(F.lit(1)).cast("int").alias("returned"))
        told = told.join(count, F.col(key).eqNullSafe(F.col("_of")), "left").drop("_of")
    page = lambda name: F.coalesce(T.as_long(F.col(f"metadata.{name}")).cast("int"), F.lit(0)).alias(name)
    documents = told.select(
        key, "drift", page("currentPage"), F.coalesce("returned", F.lit(0)).alias("returned"), page("resultsPerPage"), page("totalPages"), page("totalResults"),
        F.coalesce(T.as_string(F.col("metadata.resultsHash")), F.lit("")).alias("resultsHash"), C.is_true(F.col("metadata.relaxedResults")).alias("relaxedResults"),
    )
    return kept, documents


def property_score(p: Column) -> Column:
    """How much a property tells, to choose between candidates."""
    points = lambda test, n: F.when(test, n).otherwise(0)
    told = lambda name: (p[name] != "") & (p[name] != C.UNKNOWN)
    return (
        points(p["id"] != "", 8) + points(p["url"] != "", 4) + points(p["address"]["full"] != "", 4) + points(p["price"].isNotNull(), 3)
        + points(p["bedrooms"].isNotNull(), 2) + points(p["bathrooms"].isNotNull(), 2) + points(p["livingArea"].isNotNull(), 2)
        + points(p["homeType"] != "", 1) + points(p["coordinates"]["latitude"].isNotNull(), 1) + points(p["coordinates"]["longitude"].isNotNull(), 1)
        + points(p["description"] != "", 1) + points(p["yearBuilt"].isNotNull(), 1) + points(told("laundry"), 2) + points(told("parking"), 1)
        + points(told("petPolicy"), 1) + points(F.size(p["flexSpaces"]) > 0, 1)
    )


def identity(get: Get) -> tuple[Column, Column, Column]:
    """(identifier, url, fault) of a property's record: identifiers in its fields and links must agree."""
    own, lenient = T.normalize_identifier(get("zpid")), T.normalize_identifier(get("id"))
    keys = ["url", "hdpUrl", "detailUrl"]
    link = {key: null_if_empty(absolute_url(F.when(T.is_string(get(key)), get(key)["text"]))) for key in keys}
    inside = [identifier_in_url(link[key]) for key in keys]
    ids = F.array_compact(F.array(own, lenient, *inside))
    kinds = [F.when(T.present(get(key)) & ~T.is_string(get(key)), F.lit(f"{key} must be a string")) for key in keys]
    fault = F.coalesce(
        F.when(T.present(get("zpid")) & own.isNull(), F.lit("zpid must be a positive decimal identifier")),
        *kinds,
        F.when(F.size(F.array_distinct(ids)) > 1, F.concat(F.lit("conflicting property identifiers "), F.array_join(F.array_distinct(ids), " and "))),
    )
    return F.get(ids, F.lit(0)), F.coalesce(*link.values()), fault


def page_properties(parsed: DataFrame, today: Column, key: str = "source_id", requested: Column | None = None, source_url: Column | None = None, include_raw: bool = False) -> tuple[DataFrame, DataFrame]:
    """(properties, documents) of ``parsed``, which has ``key`` and ``page``, a parsed rental page.

    A community gives a row for each unit, and for each floor plan without a usable one. Another page gives the one
    property it is about: the identifier that is asked for or named by the page, else the only one there is, and of its
    candidates the one that tells most, by path if several do. Anything ambiguous is drift.
    """
    requested = F.lit(None).cast("string") if requested is None else requested
    source_url = F.lit("") if source_url is None else source_url
    pages = parsed.withColumn("_asked", requested).withColumn("_source", source_url)
    units = pages.filter("page.kind = 'community'").select(key, "_source", F.col("page.building").alias("b"), F.inline("page.rentals"))
    row = rental_row(F.col("b"), F.col("planRecord"), F.col("unitRecord"), F.col("merged"), F.col("_source"), today, F.col("raw") if include_raw else None)
    units = units.select(key, "path", "plan", "unit", F.col("unitRecord").isNull().alias("only_plan"), row.alias("p"))
    units = units.filter((F.col("p.id") != "") | F.col("p.price").isNotNull() | (F.col("p.availability") != ""))

    named = F.filter(F.transform("page.ids", lambda x: F.struct(x["path"].alias("path"), T.normalize_identifier(x["id"]).alias("id"))), lambda x: F.lit(True))
    bad = F.filter(named, lambda x: x["id"].isNull())
    ids = F.array_distinct(F.array_compact(F.concat(F.array("_asked"), F.transform(named, lambda x: x["id"]))))
    single = pages.filter("page.kind = 'property'").select(
        key, "page.candidates", F.get(ids, F.lit(0)).alias("expected"),
        F.coalesce(
            F.when(F.size(bad) > 0, F.struct(F.get(bad, F.lit(0))["path"].alias("path"), F.lit("authoritative identifier must be a positive decimal identifier").alias("detail"))),
            F.when(F.size(ids) > 1, F.struct(F.lit("page").alias("path"), F.concat(F.lit("authoritative identifiers conflict: "), F.array_join(ids, ", ")).alias("detail"))),
        ).alias("drift"),
    )
    each = single.select(key, "expected", "drift", F.posexplode_outer("candidates").alias("n", "c"))
    get = getter(F.col("c.record"))
    id_, url, fault = identity(get)
    each = each.withColumn("id_", id_).withColumn("url_", url).withColumn("identity_fault", F.when(F.col("c").isNotNull(), fault))
    each = each.withColumn("p", property_row(F.col("c.record"), F.col("id_"), F.col("url_"), today, F.col("c.raw") if include_raw else None))
    nameless = F.when((F.col("p.id") == "") & (F.col("p.url") == ""), F.lit("normalized property has no core identity"))
    each = each.withColumn("fault", F.coalesce(property_fault(get), nameless)).withColumn("score", property_score(F.col("p")))
    who = F.coalesce(F.concat(F.lit("id:"), F.col("id_")), F.concat(F.lit("url:"), F.col("url_")))
    each = each.withColumn("who", F.when(F.col("identity_fault").isNull(), who))
    # one table of narrow rows: the pages by themselves, units, and candidates
    each = each.select(F.lit(2).alias("part"), key, "expected", "drift", "n", F.col("c").isNotNull().alias("there"), F.col("c.path").alias("path"), "id_", "identity_fault", "fault", "score", "who", "p")
    heads = pages.select(F.lit(0).alias("part"), key, "page.kind", F.col("page.drift").alias("head_drift"))
    table = parsed_once(heads.unionByName(units.withColumn("part", F.lit(1)), True).unionByName(each, True))
    heads, units, each = (table.filter(F.col("part") == i) for i in range(3))

    plans = Window.partitionBy(key, "plan")
    units = units.withColumn("has_unit", F.max(~F.col("only_plan")).over(plans)).filter(~F.col("only_plan") | ~F.col("has_unit"))
    own = F.when(F.col("p.id") != "", F.concat(F.lit("id:"), F.col("p.id"))).otherwise(F.concat(F.lit("source:"), F.col("path")))
    once = Window.partitionBy(key, own).orderBy("plan", "unit")
    units = units.withColumn("_n", F.row_number().over(once)).filter("_n = 1")
    place = Window.partitionBy(key).orderBy("plan", "unit")
    community = units.select(key, F.lit("community").alias("kind"), (F.row_number().over(place) - 1).alias("ord"), "p.*")

    usable = F.col("there") & F.col("who").isNotNull() & (F.col("expected").isNull() | (F.col("id_") == F.col("expected")))
    nothing = F.col("there") & F.col("who").isNull() & F.col("identity_fault").isNull()
    best = F.min_by(F.struct(F.col("path"), F.col("p").alias("p")), F.when(usable & F.col("fault").isNull(), F.struct((-F.col("score")).alias("s"), F.col("path"))))
    chosen = each.groupBy(key).agg(
        F.first("drift").alias("drift"), F.first("expected").alias("expected"), F.count_if("there").alias("n"),
        F.min_by(F.struct(F.col("path"), F.col("identity_fault").alias("detail")), F.when(F.col("identity_fault").isNotNull(), F.col("n"))).alias("identity"),
        F.max(nothing).alias("nameless"), F.array_sort(F.collect_set(F.when(usable, F.col("who")))).alias("who"), best.alias("best"),
        F.min_by(F.struct(F.col("path"), F.col("fault").alias("detail")), F.when(usable & F.col("fault").isNotNull(), F.col("path"))).alias("fault"),
    )
    told = lambda detail: F.struct(F.lit("property").alias("path"), detail.alias("detail"))
    free = F.col("expected").isNull()
    drift = F.coalesce(
        "drift",
        F.when(F.col("n") == 0, told(F.lit("property object is missing"))),
        F.when(~free & (F.size("who") == 0), told(F.concat(F.lit("property object for expected identifier "), F.col("expected"), F.lit(" is missing")))),
        F.when(free, F.col("identity")),
        F.when(free & F.col("nameless"), told(F.lit("property candidate without a core identity makes selection ambiguous"))),
        F.when(F.size("who") == 0, told(F.lit("property objects have no valid core identity"))),
        F.when(F.size("who") > 1, told(F.concat(F.lit("multiple distinct property candidates are ambiguous: "), F.array_join("who", ", ")))),
        F.when(F.col("best").isNull(), F.coalesce(F.col("fault"), told(F.lit("property object has no valid normalized values")))),
    )
    chosen = chosen.withColumn("drift", drift)
    one = chosen.filter("drift IS NULL").select(key, F.lit("property").alias("kind"), F.lit(0).alias("ord"), "best.p.*")
    properties = community.unionByName(one)
    empty = heads.filter("kind = 'community'").select(key).join(community.select(key).distinct(), key, "left_anti")
    missing = empty.select(key, F.struct(F.lit("building.floorPlans").alias("path"), F.lit("no currently described rental units or floor plans").alias("detail")).alias("drift"))
    faults = heads.filter("head_drift IS NOT NULL").select(key, F.col("head_drift").alias("drift")).unionByName(chosen.filter("drift IS NOT NULL").select(key, "drift")).unionByName(missing)
    documents = heads.select(key, "kind").join(faults, key, "left")
    return properties, documents

