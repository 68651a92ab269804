"""Classification of listing texts by phrases, on canonical text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrasift.functions.tagged import as_bool, as_string, first_string
from terrasift.functions.text import any_of, canonical_text, contains_any, contains_word, let, matches_words, text_or_empty, trim_ws

UNKNOWN = "unknown"

# The phrases of each class, most decisive class first.
HOOKUPS_LISTED = ["hookup", "hook up", "connections"]
HOOKUPS = ["washer dryer hookups", "washer and dryer hookups", "w d hookups"]
SHARED_LAUNDRY = ["shared laundry", "community laundry", "common laundry", "coin laundry", "coin operated", "on site laundry"]
NO_LAUNDRY = ["no laundry", "no washer", "laundry not available"]
IN_UNIT = [
    "in unit laundry", "in unit washer", "in unit dryer", "washer dryer in unit", "washer and dryer in unit",
    "in home laundry", "in home washer", "in home dryer", "private laundry", "private washer", "inside laundry",
    "washer dryer included", "washer and dryer included",
]
NO_PARKING = ["no parking", "parking not available"]
SHARED_GARAGE = ["shared garage", "community garage", "common garage", "assigned stall", "assigned space in garage"]
PRIVATE_GARAGE = [
    "attached garage", "detached garage", "private garage", "exclusive use garage", "exclusive garage",
    "standalone garage", "individual garage", "enclosed garage",
]
GARAGE = ["garage parking", "parking garage", "shared garage", "community garage", "common garage"]
PARKING_LISTED = ["parking", "carport", "covered", "assigned", "off street", "driveway", "open"]
NO_PETS = ["no pets", "pets not allowed", "no animals"]
PET_LIMITS = ["restrictions", "restricted", "breed", "weight limit", "deposit", "fee"]
ALL_PETS = ["pets allowed", "all pets"]
SOME_PETS = ["cats", "dogs", "small pets", "large pets"]
FEW_PETS = ["cats only", "dogs only", "small dogs"]
FLEX_SPACES = ["den", "office", "bonus", "loft", "flex"]
FLEX_LISTED = {"bonus": ["bonus room", "bonus space", "bonus area"], "flex": ["flex room", "flex space", "flex area"]}
FLEX_DESCRIBED = {
    "den": ["den"],
    "office": [
        "(?:home|private|dedicated|separate) office", "office (?:space|room|area)", "(?:office den|den office)",
        "use(?:d)? as (?:an? )?office",
    ],
    "bonus": ["bonus (?:room|space|area)"],
    "loft": ["(?:upstairs |open )?loft (?:room|space|area)", "(?:upstairs|open) loft"],
    "flex": ["flex (?:room|space|area)"],
}
SHARED_HOUSING = [
    "room for rent", "private room", "shared room", "shared housing", "shared apartment", "rent by the room",
    "individual lease", "individual leasing", "per person", "per bed", "bed space", "bedspace", "co[- ]?living",
    "coliving", "communal living",
]
STUDENT_HOUSING = [
    "student housing", "student apartment", "campus housing", "university housing", "dorm", "dormitory", "residence hall",
]
ROOM_UNIT = ["(?:unit )?[0-9]+rm[0-9]+", "bedroom [a-z0-9]+"]
INCOME_RESTRICTED = [
    "income restricted", "income-restricted", "income limit", "income limits", "maximum income", "affordable housing",
    "below market rate", "bmr housing", "area median income", "ami limit", "ami limits",
]
HOME_TYPES = {
    "apartment": ["APARTMENT"],
    "condo": ["CONDO", "CONDOMINIUM", "CONDO_COOP", "COOP"],
    "townhouse": ["TOWNHOUSE", "TOWNHOME"],
    "single-family": ["SINGLE_FAMILY", "HOUSE"],
}


def joined(features: Column, *more: Column) -> Column:
    """Canonical text of listed features, and of what else is said; phrases may run over the borders of features."""
    parts = F.coalesce(features, F.array().cast("array<string>"))
    return canonical_text(F.concat_ws(" | ", parts, *(text_or_empty(m) for m in more)))


def is_laundry_appliance(c: Column) -> Column:
    return let(F.regexp_replace(F.replace(canonical_text(c), F.lit("dishwasher"), F.lit("")), " +", " "), _names_laundry)


def _names_laundry(text: Column) -> Column:
    return contains_word(text, "washer") | contains_word(text, "dryer") | contains_any(text, "laundry", "wd hookup", "w d hookup")


def over_both(features: Column, description: Column, rules) -> Column:
    """``rules`` of the canonical text of the features, and of that with the description."""
    return let(joined(features), lambda listed: let(joined(features, description), lambda all_: rules(listed, all_)))


def classify_laundry(features: Column, description: Column) -> Column:
    return over_both(features, description, _laundry)


def _laundry(listed: Column, all_: Column) -> Column:
    return (
        F.when(contains_any(listed, *HOOKUPS_LISTED) | contains_any(all_, *HOOKUPS), "hookups")
        .when(contains_any(all_, *SHARED_LAUNDRY), "shared")
        .when(contains_any(all_, *NO_LAUNDRY), "none")
        .when(contains_any(all_, *IN_UNIT) | listed.contains("in unit"), "in-unit")
        .when(listed.contains("washer") & listed.contains("dryer"), "in-unit")
        .otherwise(UNKNOWN)
    )


def classify_parking(features: Column, description: Column) -> Column:
    return over_both(features, description, _parking)


def _parking(listed: Column, all_: Column) -> Column:
    return (
        F.when(contains_any(all_, *NO_PARKING), "none")
        .when(contains_any(all_, *PRIVATE_GARAGE) & ~contains_any(all_, *SHARED_GARAGE), "private-garage")
        .when(listed.contains("garage") | contains_any(all_, *GARAGE), "garage")
        .when(contains_any(listed, *PARKING_LISTED), "available")
        .otherwise(UNKNOWN)
    )


def classify_pets(allowed: Column) -> Column:
    return let(joined(allowed), _pets)


def _pets(text: Column) -> Column:
    general, species = contains_any(text, *ALL_PETS), contains_any(text, *SOME_PETS)
    return (
        F.when(contains_any(text, *NO_PETS), "not-allowed")
        .when(contains_any(text, *PET_LIMITS), "restricted")
        .when((general | species) & (contains_any(text, *FEW_PETS) | (species & ~general)), "restricted")
        .when(general, "allowed")
        .otherwise(UNKNOWN)
    )


def classify_flex(description: Column, listed: Column, parking: Column) -> Column:
    """Names of the spaces, in fixed order; a private garage counts as the last."""
    return let(canonical_text(description), lambda said: let(joined(listed), lambda text: _flex(said, text, parking)))


def _flex(said: Column, listed: Column, parking: Column) -> Column:
    def has(name: str) -> Column:
        structured = contains_any(listed, *FLEX_LISTED[name]) if name in FLEX_LISTED else contains_word(listed, name)
        return structured | matches_words(said, *FLEX_DESCRIBED[name])

    found = [F.when(has(name), F.lit(name)) for name in FLEX_SPACES]
    return F.array_compact(F.array(*found, F.when(parking == "private-garage", F.lit("private-garage"))))


def is_true(tag: Column) -> Column:
    return F.coalesce(let(tag, as_bool), F.lit(False))


def housing_kind(get, units: Column, description: Column, address: Column) -> tuple[Column, Column]:
    """(shared, student): by flags, types and units of a listing, and by its texts.

    ``get`` gives the tagged scalar of a path; ``units`` is an array of maps of tagged scalars.
    """
    keys = ("studentHousingType", "communityType", "communitySubType", "buildingType")
    types = F.filter(F.array(*(canonical_text(as_string(get(k))) for k in keys)), lambda t: ~t.isin("", "none", "not student housing"))
    unit = lambda u, key: F.try_element_at(u, F.lit(key))
    unit_types = F.filter(F.transform(units, lambda u: canonical_text(first_string(unit(u, "studentHousingType")))), lambda t: ~t.isin("", "none"))
    some = lambda values, test: F.coalesce(F.exists(values, test), F.lit(False))
    text = canonical_text(F.concat_ws(" | ", text_or_empty(description), text_or_empty(address)))
    rooms = is_true(get("roomForRent")) | is_true(get("isRoomForRent")) | is_true(get("listing_sub_type.is_roomForRent"))
    rooms = rooms | some(units, lambda u: is_true(unit(u, "roomForRent"))) | some(unit_types, lambda t: contains_any(t, "individual", "bed"))
    rooms = rooms | some(types, lambda t: contains_any(t, "individual lease", "per bed")) | matches_words(canonical_text(address), *ROOM_UNIT)
    students = is_true(get("isStudentHousing")) | some(types, lambda t: contains_any(t, "student", "individual lease", "per bed"))
    students = students | some(unit_types, lambda t: F.lit(True))
    return rooms | let(text, lambda t: matches_words(t, *SHARED_HOUSING)), students | let(text, lambda t: matches_words(t, *STUDENT_HOUSING))


def restricts_income(tag: Column, limits: Column) -> Column:
    """A restriction object says so unless it, or its list of limits, is empty."""
    filled = tag["kind"].isin("object", "array") & ~tag["text"].isin("{}", "[]")
    return F.coalesce(filled & ~F.coalesce((limits["kind"] == "array") & (limits["text"] == "[]"), F.lit(False)), F.lit(False))


def is_income_restricted(get, description: Column) -> Column:
    flags = [f"{at}{key}" for at in ("", "building.") for key in ("isIncomeRestricted", "isLowIncome", "showIncomeRestrictedCTA")]
    paths = ["incomeRestrictions", "buildingAttributes.incomeRestrictions", "building.buildingAttributes.incomeRestrictions"]
    objects = [restricts_income(get(path), get(f"{path}.incomeLimits")) for path in paths]
    return any_of([is_true(get(key)) for key in flags] + objects) | matches_words(canonical_text(description), *INCOME_RESTRICTED)


def is_for_rent(status: Column) -> Column:
    return F.upper(trim_ws(status)).rlike("^(?:FOR_RENT|FOR RENT|FOR_RENT_.*)$")


def home_type_matches(home_type: Column, allowed: list[str]) -> Column:
    names = [name for kind in allowed for name in HOME_TYPES[kind]]
    return F.upper(trim_ws(home_type)).isin(*names) if names else F.lit(False)
