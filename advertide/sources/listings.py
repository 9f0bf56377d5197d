"""Listing feeds: provider JSON, result pages and detail pages read as typed rows, rejects kept beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from advertide.functions.text import (
    empty_to_null,
    feed_text,
    heading_employer,
    heading_title,
    page_entities,
    page_text,
    split_places,
)

# Currency of each country a feed covers.
CURRENCIES = {
    "at": "EUR",
    "au": "AUD",
    "be": "EUR",
    "br": "BRL",
    "ca": "CAD",
    "ch": "CHF",
    "de": "EUR",
    "es": "EUR",
    "fr": "EUR",
    "gb": "GBP",
    "in": "INR",
    "it": "EUR",
    "mx": "MXN",
    "nl": "EUR",
    "nz": "NZD",
    "pl": "PLN",
    "sg": "SGD",
    "us": "USD",
    "za": "ZAR",
}
# Employment tokens of detail pages and the type each means.
EMPLOYMENT_TOKENS = {
    "FULL_TIME": "FULL_TIME",
    "PART_TIME": "PART_TIME",
    "CONTRACTOR": "CONTRACT",
    "TEMPORARY": "TEMPORARY",
    "INTERN": "INTERNSHIP",
    "OTHER": "CASUAL",
}
# Field labels that may follow the workplace location on a detail page.
LABELS_AFTER_LOCATION = (
    "Job ad reference",
    "Closing date",
    "Yearly salary",
    "Fortnightly salary",
    "Total remuneration",
    "Salary Other",
    "Contact person",
    "Contact details",
    "Classification",
    "Occupational group",
    "Position type",
)
# What a result list, its rows and their parts look like.
RESULT_COUNT = r"(?i)of\s*<strong>\s*([\d,]+)\s*</strong>\s*matching"
RESULT_LIST = r'(?i)(<ol[^>]*class="[^"]*search-results[^"]*"[\s\S]*?)(?:</ol>|\z)'
RESULT_ROW = r"(?i)(<li>[\s\S]*?</li>)"
RESULT_LINK = r'(?i)<a\s+href="((?:jncustomsearch\.viewFullSingle\?|/jobs/)[^"]*)"[^>]*>([\s\S]*?)</a>'
ROW_TYPE = r'(?i)<span class="type">([\s\S]*?)</span>'
ROW_LOCALITY = r'(?i)<strong class="locality">([\s\S]*?)</strong>'
ROW_EXCERPT = r'(?i)<div class="search-description">([\s\S]*?)</div>'
DETAIL_JSON = r'(?i)<script[^>]*type="application/ld\+json"[^>]*>([\s\S]*?)</script>'
DETAIL_LICENCE = r'(?i)<meta[^>]*name="DCTERMS\.license"[^>]*content="([^"]*)"[^>]*>'


def read_listing_lines(spark: SparkSession, path: str) -> DataFrame:
    """A feed kept as one JSON record per line."""
    return spark.read.text(path)


def _kind(raw: Column, path: str) -> Column:
    """JSON type of a field: STRING, BIGINT and so on, VOID for null, SQL null when absent."""
    return F.schema_of_variant(F.try_variant_get(raw, path, "variant"))


def parse_listings(lines: DataFrame, column: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Every record with its fields and the list of faults that keep it out, empty for an accepted one.

    The envelope is lenient and a record strict: unknown fields are dropped, a
    known field of the wrong type is a fault.
    """
    staged = lines.withColumn("v", F.try_parse_json(column))
    raw = F.col("v")
    text = lambda path: F.try_variant_get(raw, path, "string")
    number = lambda path: F.try_variant_get(raw, path, "double")

    def wrong(path: str, *kinds: str) -> Column:
        kind = _kind(raw, path)
        named = F.regexp_extract(kind, r"^([A-Z]+)", 1)
        return F.when(kind.isNotNull() & ~named.isin(*kinds), path[2:])

    numeric = ("BIGINT", "DOUBLE", "DECIMAL", "FLOAT")
    texts = (
        "$.description", "$.created", "$.company.display_name", "$.location.display_name", "$.category.label",
        "$.category.tag", "$.contract_type", "$.contract_time",
    )
    title, url, identifier = text("$.title"), text("$.redirect_url"), text("$.id")
    faults = F.array_compact(
        F.array(
            F.when(raw.isNull(), "(record)"),
            F.when((F.coalesce(identifier, F.lit("")) == "") | wrong("$.id", "STRING", *numeric).isNotNull(), "id"),
            F.when((F.coalesce(title, F.lit("")) == "") | wrong("$.title", "STRING").isNotNull(), "title"),
            F.when(~F.coalesce(url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:\S+\z"), F.lit(False)), "redirect_url"),
            *[wrong(path, "STRING") for path in texts],
            *[wrong(path, *numeric) for path in ("$.latitude", "$.longitude", "$.salary_min", "$.salary_max")],
            wrong("$.salary_is_predicted", "BOOLEAN", "STRING", *numeric),
        )
    )
    predicted = text("$.salary_is_predicted")
    return staged.select(
        *keep,
        F.col(column).alias("raw"),
        identifier.alias("id"),
        title.alias("title"),
        url.alias("redirect_url"),
        text("$.description").alias("description"),
        text("$.created").alias("created"),
        text("$.company.display_name").alias("company"),
        text("$.location.display_name").alias("location"),
        F.try_variant_get(raw, "$.location.area", "array<string>").alias("area"),
        text("$.category.label").alias("category_label"),
        text("$.category.tag").alias("category_tag"),
        number("$.latitude").alias("latitude"),
        number("$.longitude").alias("longitude"),
        number("$.salary_min").alias("salary_min"),
        number("$.salary_max").alias("salary_max"),
        # Any number but zero, "1" and "true" count as yes.
        F.coalesce(
            F.when(_kind(raw, "$.salary_is_predicted") == "STRING", F.lower(predicted).isin("1", "true")).otherwise(
                (F.lower(predicted) == "true") | (predicted.try_cast("double") != 0)
            ),
            F.lit(False),
        ).alias("salary_is_predicted"),
        text("$.contract_type").alias("contract_type"),
        text("$.contract_time").alias("contract_time"),
        faults.alias("faults"),
    )


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.size("faults") == 0)


def rejected(parsed: DataFrame) -> DataFrame:
    """Quarantine rows: the identifier where there is one, the faults and the record as it came."""
    return parsed.filter(F.size("faults") > 0).select(
        F.col("id").alias("source_id"), F.lit("VALIDATION").alias("kind"), F.array_join("faults", "; ").alias("message"), "raw"
    )


def canonical_listings(records: DataFrame, source: str, country: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Accepted feed records as listings, beside columns of the records to ``keep``."""
    description = empty_to_null(feed_text(F.col("description")))
    raw_text = F.coalesce("location", F.when(F.size("area") > 0, F.array_join("area", ", ")))
    placed = raw_text.isNotNull()
    currency = F.lit(CURRENCIES.get(country.lower())).cast("string")
    paid = (F.col("salary_min").isNotNull() | F.col("salary_max").isNotNull()) & currency.isNotNull()
    employment = (
        F.when(F.lower("contract_time") == "full_time", "FULL_TIME")
        .when(F.lower("contract_time") == "part_time", "PART_TIME")
        .when(F.lower("contract_type") == "contract", "CONTRACT")
    )
    return records.select(
        *keep,
        F.lit(source).alias("source_key"),
        F.col("id").alias("source_id"),
        feed_text(F.col("title")).alias("title"),
        description.alias("description"),
        F.when(description.isNotNull(), "TEXT").alias("description_format"),
        F.lit(True).alias("description_is_excerpt"),
        empty_to_null(F.trim("company")).alias("company_name"),
        raw_text.alias("location_text"),
        F.coalesce("area", F.array().cast("array<string>")).alias("area"),
        F.when(placed, F.col("latitude")).alias("latitude"),
        F.when(placed, F.col("longitude")).alias("longitude"),
        employment.alias("employment_type"),
        # The feed does not say where the work is done.
        F.lit(None).cast("string").alias("remote_type"),
        F.col("contract_type").alias("contract_type"),
        F.when(paid, F.col("salary_min")).alias("salary_min"),
        F.when(paid, F.col("salary_max")).alias("salary_max"),
        F.when(paid, currency).alias("salary_currency"),
        F.when(paid, "YEAR").alias("salary_period"),
        F.when(paid, F.when(F.col("salary_is_predicted"), "SOURCE_ESTIMATED").otherwise("REPORTED")).alias("salary_basis"),
        F.col("redirect_url").alias("apply_url"),
        F.col("redirect_url").alias("source_url"),
        F.try_to_timestamp("created").cast("timestamp_ntz").alias("posted_at"),
        F.col("category_tag").alias("category_tag"),
        F.when(F.col("category_tag").isNotNull(), F.coalesce("category_label", "category_tag")).alias("category_label"),
    )


def parse_result_pages(pages: DataFrame, base_url: str) -> DataFrame:
    """One row per listing of each result page with its list of faults, empty for a usable one.

    A page without its count is one row of its own; a listing without a reference or a
    heading is a faulty row beside the good ones of its page. No page stops the others.
    """
    html = F.col("html")
    count = F.regexp_replace(F.regexp_extract(html, RESULT_COUNT, 1), ",", "").try_cast("bigint")
    listed = F.regexp_extract(html, RESULT_LIST, 1)
    nothing = F.array(F.lit(None).cast("string"))
    items = F.when(F.col("total").isNotNull(), F.regexp_extract_all(listed, F.lit(RESULT_ROW), F.lit(1))).otherwise(nothing)
    rows = (
        pages.withColumn("total", count)
        .withColumn("item", F.explode_outer(items))
        .filter(F.col("total").isNull() | F.col("item").rlike(RESULT_LINK))
        .withColumn("href", page_entities(F.regexp_extract("item", RESULT_LINK, 1)))
        .withColumn("heading", page_text(F.regexp_extract("item", RESULT_LINK, 2)))
    )
    by_counter = empty_to_null(F.regexp_extract("href", r"(?i)in_jnCounter=(\d+)", 1))
    by_path = empty_to_null(F.regexp_extract("href", r"(?i)/jobs/([^?#/]+)", 1))
    reference = F.coalesce(by_counter, by_path)
    counted = F.col("total").isNotNull()
    faults = F.array_compact(
        F.array(
            F.when(~counted, "no result count"),
            F.when(counted & reference.isNull(), "no reference"),
            F.when(counted & (F.col("heading") == ""), "no heading"),
        )
    )
    part = lambda pattern: empty_to_null(page_text(F.regexp_extract("item", pattern, 1)))
    site = base_url.split("/", 3)
    address = F.when(F.startswith("href", F.lit("/")), F.concat(F.lit("/".join(site[:3])), "href")).otherwise(
        F.concat(F.lit(base_url), "href")
    )
    return rows.select(
        "page_id",
        "total",
        reference.cast("string").alias("reference"),
        heading_title(F.col("heading")).alias("title"),
        heading_employer(F.col("heading")).alias("employer"),
        part(ROW_TYPE).alias("employment_text"),
        split_places(page_text(F.regexp_extract("item", ROW_LOCALITY, 1))).alias("localities"),
        part(ROW_EXCERPT).alias("excerpt"),
        address.alias("detail_url"),
        faults.alias("faults"),
    )


DETAIL_SCHEMA = (
    "title string, description string, datePosted string, validThrough string, employmentType string,"
    "hiringOrganization struct<name:string>, identifier struct<value:string>"
)


def parse_detail_pages(pages: DataFrame) -> DataFrame:
    """One row per detail page with the record of its data block and the list of faults, empty for a usable one."""
    html = F.col("html")
    block = empty_to_null(F.regexp_extract(html, DETAIL_JSON, 1))
    posting = F.from_json(block, DETAIL_SCHEMA)
    stated = lambda field: empty_to_null(F.trim(field))
    several = F.from_json(F.col("p.employmentType"), "array<string>")
    one = F.filter(F.array("p.employmentType"), lambda e: e.isNotNull())
    kinds = F.when(F.startswith(F.col("p.employmentType"), F.lit("[")), several).otherwise(one)
    after = "|".join(LABELS_AFTER_LOCATION)
    workplace = F.regexp_extract(page_text(html), rf"(?i)Workplace Location\s*(.+?)\s*(?:{after}|\z)", 1)
    licence = page_entities(empty_to_null(F.regexp_extract(html, DETAIL_LICENCE, 1)))
    faults = F.array_compact(
        F.array(
            F.when(F.col("block").isNull(), "no data block"),
            F.when(F.col("block").isNotNull() & F.try_parse_json("block").isNull(), "unreadable data block"),
            F.when(F.col("block").isNotNull() & stated(F.col("p.identifier.value")).isNull(), "no identifier"),
            F.when(F.col("block").isNotNull() & stated(F.col("p.title")).isNull(), "no title"),
        )
    )
    return (
        pages.withColumn("block", block)
        .withColumn("p", posting)
        .select(
            "page_id",
            stated(F.col("p.identifier.value")).alias("reference"),
            stated(F.col("p.title")).alias("title"),
            stated(F.col("p.hiringOrganization.name")).alias("employer"),
            stated(F.col("p.description")).alias("description"),
            stated(F.col("p.datePosted")).alias("date_posted"),
            stated(F.col("p.validThrough")).alias("valid_through"),
            F.coalesce(kinds, F.array().cast("array<string>")).alias("employment_types"),
            split_places(workplace).alias("localities"),
            licence.alias("licence"),
            faults.alias("faults"),
        )
    )


def employment_type(tokens: Column) -> Column:
    """The first token that means something."""
    table = F.create_map(*[F.lit(part) for pair in EMPLOYMENT_TOKENS.items() for part in pair])
    read = F.filter(F.transform(tokens, lambda t: F.try_element_at(table, F.upper(F.trim(t)))), lambda t: t.isNotNull())
    return F.try_element_at(read, F.lit(1))


def listings_from_details(rows: DataFrame, details: DataFrame, source: str, state: str) -> DataFrame:
    """Usable result rows joined to their detail pages as listings; the detail's localities win over the row's."""
    d = details.filter(F.size("faults") == 0).select(*[F.col(c).alias(f"d_{c}") for c in details.columns if c != "faults"])
    usable = rows.filter(F.size("faults") == 0).drop("faults")
    both = usable.join(d, F.col("reference") == F.col("d_reference"))
    localities = F.when(F.size("d_localities") > 0, F.col("d_localities")).otherwise(F.col("localities"))
    placed = F.size(localities) > 0
    return both.select(
        F.lit(source).alias("source_key"),
        F.col("d_reference").alias("source_id"),
        F.col("d_title").alias("title"),
        F.col("d_description").alias("description"),
        F.when(F.col("d_description").isNotNull(), "TEXT").alias("description_format"),
        F.lit(False).alias("description_is_excerpt"),
        F.col("d_employer").alias("company_name"),
        F.when(placed, F.array_join(localities, ", ")).alias("location_text"),
        F.when(placed, F.concat(F.array(F.lit(state)), localities)).alias("area"),
        employment_type(F.col("d_employment_types")).alias("employment_type"),
        F.col("employment_text").alias("contract_type"),
        F.col("detail_url").alias("apply_url"),
        F.col("detail_url").alias("source_url"),
        F.try_to_timestamp("d_date_posted").cast("timestamp_ntz").alias("posted_at"),
    )
