"""Reference periods and value cells of a published release."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from advertide.functions.text import BLANK, dash_key, strip

# Month names a release header may spell in full or by three letters.
MONTHS = (
    "january",
    "february",
    "march",
    "april",
    "may",
    "june",
    "july",
    "august",
    "september",
    "october",
    "november",
    "december",
)
# Two-digit years below the pivot belong to this century.
CENTURY_PIVOT = 80
FIRST_YEAR, LAST_YEAR = 1900, 2100

# How a release says a figure exists but is not shown.
ABSENCE = {
    "np": "SUPPRESSED",
    "n.p.": "SUPPRESSED",
    "n.p": "SUPPRESSED",
    "..": "NOT_COVERED",
}

VALUE_STATES = ("PRESENT", "ZERO", "UNAVAILABLE", "SUPPRESSED", "NOT_COVERED")
MEASURED = ("PRESENT", "ZERO")


def _month_number(word: Column) -> Column:
    short = F.substring(F.lower(word), 1, 3)
    listed = F.array(*[F.lit(name[:3]) for name in MONTHS])
    return F.array_position(listed, short).cast("int")


def _first_day(year: Column, month: Column) -> Column:
    return F.make_date(year, month, F.lit(1))


def parse_period(cell: Column) -> Column:
    """struct(period_start, granularity) of a header cell, null when it names no period."""
    label = F.trim(F.regexp_replace(cell, f"[{BLANK}]+", " "))

    month_first = r"^([A-Za-z]{3,9})[ ./-]+(\d{2}|\d{4})\z"
    month = _month_number(F.regexp_extract(label, month_first, 1))
    written = F.regexp_extract(label, month_first, 2).try_cast("int")
    year = (
        F.when(written >= 100, written)
        .when(written < CENTURY_PIVOT, written + 2000)
        .otherwise(written + 1900)
    )

    year_month = r"^(\d{4})[/-](\d{1,2})\z"
    ym_year = F.regexp_extract(label, year_month, 1).try_cast("int")
    ym_month = F.regexp_extract(label, year_month, 2).try_cast("int")

    # A date-typed header, exported as text, names its month.
    full_date = F.regexp_extract(label, r"^(\d{4}-\d{2}-\d{2})(?:[T ]\d{2}:\d{2}.*)?\z", 1).try_cast("date")

    quarter_first = r"(?i)^Q([1-4])[ -]+(\d{4})\z"
    year_first = r"(?i)^(\d{4})[ -]+Q([1-4])\z"
    quarter = F.coalesce(
        F.regexp_extract(label, quarter_first, 1).try_cast("int"),
        F.regexp_extract(label, year_first, 2).try_cast("int"),
    )
    quarter_year = F.coalesce(
        F.regexp_extract(label, quarter_first, 2).try_cast("int"),
        F.regexp_extract(label, year_first, 1).try_cast("int"),
    )

    year_only = F.regexp_extract(label, r"^(\d{4})\z", 1).try_cast("int")

    def reading(start: Column, granularity: str) -> Column:
        return F.struct(start.alias("period_start"), F.lit(granularity).alias("granularity"))

    return (
        F.when(label.rlike(month_first) & (month > 0), reading(_first_day(year, month), "MONTH"))
        .when(ym_month.between(1, 12), reading(_first_day(ym_year, ym_month), "MONTH"))
        .when(full_date.isNotNull(), reading(F.trunc(full_date, "MM"), "MONTH"))
        .when(quarter.isNotNull(), reading(_first_day(quarter_year, quarter * 3 - 2), "QUARTER"))
        .when(year_only.between(FIRST_YEAR, LAST_YEAR), reading(_first_day(year_only, F.lit(1)), "YEAR"))
    )


def period_start(day: Column, granularity: Column) -> Column:
    """The first day of the month, quarter or year a day lies in."""
    return (
        F.when(granularity == "MONTH", F.trunc(day, "MM"))
        .when(granularity == "QUARTER", F.trunc(day, "QUARTER"))
        .when(granularity == "YEAR", F.trunc(day, "YEAR"))
    )


def period_label(day: Column, granularity: Column) -> Column:
    year = F.lpad(F.year(day).cast("string"), 4, "0")
    return (
        F.when(granularity == "MONTH", F.concat(year, F.lit("-"), F.lpad(F.month(day).cast("string"), 2, "0")))
        .when(granularity == "QUARTER", F.concat(year, F.lit("-Q"), F.quarter(day).cast("string")))
        .when(granularity == "YEAR", year)
    )


def read_value(cell: Column) -> Column:
    """struct(state, value, unreadable): blank is unavailable, a word is a problem, never zero."""
    text = strip(cell)
    absent = F.create_map(*[F.lit(part) for pair in ABSENCE.items() for part in pair])
    marker = F.try_element_at(absent, F.lower(text))
    number = F.regexp_replace(text, f"[,{BLANK}]", "")
    # A bare sign, "NaN" and "Infinity" are words here, so the shape is tested first.
    numeric = F.when(
        number.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\z"), number.try_cast("double")
    )
    state = (
        F.when(text.isNull() | (text == ""), "UNAVAILABLE")
        .when(marker.isNotNull(), marker)
        .when(numeric == 0, "ZERO")
        .when(numeric.isNotNull(), "PRESENT")
    )
    value = F.when(state == "ZERO", F.lit(0.0)).when(state == "PRESENT", numeric)
    return F.struct(
        state.alias("state"), value.alias("value"), F.when(state.isNull(), text).alias("unreadable")
    )


def is_consistent(value: Column, state: Column) -> Column:
    """A figure is held exactly when its state says it was measured."""
    return (
        F.when(state == "PRESENT", value.isNotNull() & ~F.isnan(value))
        .when(state == "ZERO", F.coalesce(value == 0, F.lit(False)))
        .when(state.isin("UNAVAILABLE", "SUPPRESSED", "NOT_COVERED"), value.isNull())
        .otherwise(F.lit(False))
    )


def change_struct(latest: Column, previous: Column) -> Column:
    """struct(absolute, percent, direction); null when a side is missing, no percent on a zero base."""
    absolute = latest - previous
    direction = F.when(absolute > 0, "UP").when(absolute < 0, "DOWN").otherwise("FLAT")
    percent = F.when(previous != 0, absolute / previous * 100)
    return F.when(
        latest.isNotNull() & previous.isNotNull(),
        F.struct(absolute.alias("absolute"), percent.alias("percent"), direction.alias("direction")),
    )


def _dimension_token(code: Column, name: Column) -> Column:
    return (
        F.when(F.trim(code) != "", F.concat(F.lit("c."), dash_key(code)))
        .when(F.trim(name) != "", F.concat(F.lit("n."), dash_key(name)))
        .otherwise("none")
    )


def series_key(
    source: Column,
    dataset: Column,
    measure: Column,
    granularity: Column,
    geo_code: Column,
    geo_name: Column,
    occ_code: Column,
    occ_name: Column,
    qualifiers: Column,
) -> Column:
    """One stable key per stated definition; qualifiers in name order, unusable ones left out."""
    pairs = F.transform(
        F.map_entries(F.coalesce(qualifiers, F.create_map().cast("map<string,string>"))),
        lambda e: F.struct(dash_key(e["key"]).alias("name"), dash_key(e["value"]).alias("value")),
    )
    usable = F.filter(pairs, lambda p: (p["name"] != "") & (p["value"] != ""))
    stated = F.transform(F.array_sort(usable), lambda p: F.concat(p["name"], F.lit("."), p["value"]))
    head = F.array(
        dash_key(source),
        dash_key(dataset),
        dash_key(measure),
        F.lower(granularity),
        F.concat(F.lit("g:"), _dimension_token(geo_code, geo_name)),
        F.concat(F.lit("o:"), _dimension_token(occ_code, occ_name)),
    )
    return F.array_join(F.concat(head, stated), "|")


def describe_series(
    measure: Column,
    unit: Column,
    geo_code: Column,
    geo_name: Column,
    occ_code: Column,
    occ_name: Column,
    qualifiers: Column,
    granularity: Column,
    dataset: Column,
) -> Column:
    geography = F.coalesce(geo_name, geo_code)
    occupation = F.coalesce(occ_name, occ_code)
    stated = F.transform(
        F.array_sort(F.map_entries(F.coalesce(qualifiers, F.create_map().cast("map<string,string>")))),
        lambda e: F.concat(e["key"], F.lit(": "), e["value"]),
    )
    parts = F.concat(
        F.array(
            F.concat(measure, F.lit(" ("), unit, F.lit(")")),
            F.concat(F.lit("geography: "), geography),
            F.concat(F.lit("occupation: "), occupation),
        ),
        stated,
        F.array(F.lower(granularity), dataset),
    )
    return F.array_join(parts, "; ")
