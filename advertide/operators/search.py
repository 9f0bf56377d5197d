"""Reading the advertisement table: filters, paging, gated fields and nested attachments.

Filters are plain predicates ANDed on one frame, so they reach the scan; a page
is the top rows of that frame and the total counts the same frame.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# State and territory abbreviations.
STATES = ("NSW", "VIC", "QLD", "SA", "WA", "TAS", "NT", "ACT")
PAGE_SIZE, LARGEST_PAGE = 20, 50


@dataclass(frozen=True)
class Search:
    text: str | None = None
    location: str | None = None
    category: str | None = None
    source: str | None = None
    employment: str | None = None
    signal: str | None = None
    area: str | None = None
    skill: str | None = None
    posted_within_days: int | None = None


def visible(allow_synthetic: bool = False) -> Column:
    """Live, canonical and, unless allowed, not synthetic."""
    shown = (F.col("status") == "ACTIVE") & F.col("is_canonical")
    return shown if allow_synthetic else shown & ~F.col("is_synthetic")


def real_only(jobs: DataFrame) -> DataFrame:
    return jobs.filter(~F.col("is_synthetic"))


def contains_any(term: str, *columns: str) -> Column:
    """Case-insensitive substring in any of the columns."""
    needle = F.lower(F.lit(term))
    return reduce(lambda a, b: a | b, [F.contains(F.lower(c), needle) for c in columns])


def in_location(term: str) -> Column:
    state = F.col("state_code") == term.upper()
    if term.strip().upper() in STATES:
        return state
    return contains_any(term, "location_text") | state


def in_area(status: str) -> Column:
    """Unknown takes in the advertisements that name no place at all."""
    return F.coalesce(F.col("regional_status"), F.lit("UNKNOWN")) == status


def posted_within(days: int, now: str) -> Column:
    return F.col("posted_at") >= F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))


def conditions(search: Search, now: str) -> list[Column]:
    equal = {
        "category_tag": search.category,
        "source_key": search.source,
        "employment_type": search.employment,
        "signal": search.signal,
    }
    out = [F.col(c) == v for c, v in equal.items() if v]
    if search.area:
        out.append(in_area(search.area))
    if search.posted_within_days is not None:
        out.append(posted_within(search.posted_within_days, now))
    if search.location and search.location.strip():
        out.append(in_location(search.location.strip()))
    if search.text and search.text.strip():
        out.append(contains_any(search.text.strip(), "title", "description", "company_name"))
    return out


def matching(jobs: DataFrame, links: DataFrame, search: Search, now: str, allow_synthetic: bool = False) -> DataFrame:
    found = jobs.filter(reduce(lambda a, b: a & b, conditions(search, now), visible(allow_synthetic)))
    if search.skill:
        having = links.filter(F.col("skill_key") == search.skill).select(F.col("job_id").alias("id"))
        found = found.join(having, "id", "left_semi")
    return found


def page_of(found: DataFrame, page: int = 1, size: int = PAGE_SIZE) -> DataFrame:
    """One page, newest first, undated last, ties by id."""
    page, size = max(1, page), min(max(1, size), LARGEST_PAGE)
    ordered = found.orderBy(F.col("posted_at").desc_nulls_last(), F.asc("id"))
    return ordered.offset((page - 1) * size).limit(size)


def search_page(
    jobs: DataFrame, links: DataFrame, search: Search, now: str, page: int = 1, size: int = PAGE_SIZE
) -> tuple[DataFrame, DataFrame]:
    """(the page, one row with the total), both from the same filtered frame."""
    found = matching(jobs, links, search, now)
    return page_of(found, page, size), found.agg(F.count(F.lit(1)).alias("total"))


def usable_sources(registry: DataFrame, production: bool = True) -> DataFrame:
    """Sources usable where the job runs: outside production everything is, fixtures never are inside it."""
    eligible = (F.col("activation") == "ACTIVE") & (F.col("compliance_status") == "VERIFIED")
    return registry.filter(eligible if production else F.lit(True))


def field_permissions(registry: DataFrame, rights: DataFrame, field: str) -> DataFrame:
    """source_key and whether its field may be shown; an unstated position is not permission."""
    stated = rights.filter(F.col("field") == field).select("source_key", "stated")
    eligible = (F.col("activation") == "ACTIVE") & (F.col("compliance_status") == "VERIFIED")
    return registry.join(stated, "source_key", "left").select(
        "source_key", F.coalesce(eligible & (F.col("stated") == "PERMITTED"), F.lit(False)).alias("permitted")
    )


def gate_field(jobs: DataFrame, registry: DataFrame, rights: DataFrame, field: str) -> DataFrame:
    """Null the field where its source may not show it and say so where something was held back."""
    permissions = field_permissions(registry, rights, field)
    permitted = F.coalesce(F.col("permitted"), F.lit(False))
    return (
        jobs.join(permissions, "source_key", "left")
        .withColumn(f"{field}_withheld", ~permitted & F.col(field).isNotNull())
        .withColumn(field, F.when(permitted, F.col(field)))
        .drop("permitted")
    )


def salary() -> Column:
    """struct(min, max, currency, period, basis), null unless a bound and all its terms are stated."""
    stated = (
        (F.col("salary_min").isNotNull() | F.col("salary_max").isNotNull())
        & F.col("salary_currency").isNotNull()
        & F.col("salary_period").isNotNull()
        & F.col("salary_basis").isNotNull()
    )
    return F.when(
        stated,
        F.struct(
            F.col("salary_min").alias("min"),
            F.col("salary_max").alias("max"),
            F.col("salary_currency").alias("currency"),
            F.col("salary_period").alias("period"),
            F.col("salary_basis").alias("basis"),
        ),
    )


def contract_label(contract: Column) -> Column:
    """Blank and permanent are not worth saying; anything else starts with a capital."""
    said = F.lower(F.trim(contract))
    return F.when(
        (said != "") & (said != "permanent"), F.concat(F.upper(F.substring(said, 1, 1)), F.substr(said, F.lit(2)))
    )


def evidence_items(stored: Column) -> Column:
    """Stored evidence as array<struct(phrase, sentence)>; an item without both as strings is left out.

    ``context`` stands in for a missing or null sentence, not for one of another type.
    """
    items = F.try_variant_get(F.try_parse_json(stored), "$", "array<variant>")

    def text(value: Column) -> Column:
        # A number or a flag in place of the string is not a quotation.
        return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))

    def quotation(item: Column) -> Column:
        phrase, sentence, context = (F.try_variant_get(item, f"$.{name}", "variant") for name in ("phrase", "sentence", "context"))
        absent = sentence.isNull() | F.is_variant_null(sentence)
        said = F.when(absent, text(context)).otherwise(text(sentence))
        return F.struct(text(phrase).alias("phrase"), said.alias("sentence"))

    pairs = F.filter(F.transform(items, quotation), lambda q: q["phrase"].isNotNull() & q["sentence"].isNotNull())
    return F.coalesce(pairs, F.array().cast("array<struct<phrase:string,sentence:string>>"))


def placement() -> Column:
    """Where an advertisement stands; the unplaced struct where it names no place."""
    derived = F.coalesce(F.col("postcode_source") == "DERIVED_FROM_COORDINATES", F.lit(False))
    text = lambda value: F.lit(value).cast("string")

    def as_struct(status, category, basis, postcode, is_derived):
        return F.struct(
            status.alias("status"),
            category.alias("category"),
            basis.alias("basis"),
            postcode.alias("postcode"),
            is_derived.alias("postcode_is_derived"),
        )

    placed = as_struct(
        F.col("regional_status"), F.col("regional_category"), F.col("regional_basis"), F.col("postcode"), derived
    )
    nowhere = as_struct(text("UNKNOWN"), text(None), text("NONE"), text(None), F.lit(False))
    return F.when(F.col("place_id").isNotNull(), placed).otherwise(nowhere)


def days_since(moment: Column, now: str) -> Column:
    """Elapsed days with their fraction."""
    return F.timestamp_diff("MICROSECOND", moment, F.lit(now).cast("timestamp_ntz")) / 86_400_000_000


def lifecycle(now: str, new_within: int = 3, stale_after: int = 7) -> Column:
    """NEW, ACTIVE, STALE, EXPIRED or REMOVED, from stored status and elapsed days."""
    confirmed = days_since(F.coalesce("last_verified_at", "first_seen_at"), now)
    return (
        F.when(F.col("status") == "WITHDRAWN", "REMOVED")
        .when(F.col("status") == "EXPIRED", "EXPIRED")
        .when(confirmed > stale_after, "STALE")
        .when(days_since(F.col("posted_at"), now) <= new_within, "NEW")
        .otherwise("ACTIVE")
    )


def publicly_visible(state: Column) -> Column:
    return ~state.isin("EXPIRED", "REMOVED")


def nested_skills(links: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Per advertisement its skills in vocabulary order; withdrawn entries last, by name."""
    # An advertisement holds each vocabulary entry at most once, so lists stay short.
    known = links.join(vocabulary.select(F.col("key").alias("skill_key"), "name", "kind", "pos"), "skill_key", "left")
    item = F.struct(
        F.coalesce(F.col("pos"), F.lit(2147483647)).alias("pos"),
        F.coalesce(F.col("name"), F.col("skill_key")).alias("name"),
        "kind",
        "matched_text",
    )
    return known.groupBy(F.col("job_id").alias("id")).agg(F.sort_array(F.collect_list(item)).alias("skills"))


def with_skills(jobs: DataFrame, links: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Advertisements with their skills as a list, empty where there are none."""
    nested = nested_skills(links, vocabulary)
    return jobs.join(nested, "id", "left").withColumn(
        "skills", F.coalesce("skills", F.array().cast(nested.schema["skills"].dataType))
    )


def indexed_sources(jobs: DataFrame, registry: DataFrame) -> DataFrame:
    """Sources that have something to show, by display name; an unregistered one shows its key."""
    shown = jobs.filter(visible()).select("source_key").distinct()
    return (
        shown.join(registry.select("source_key", "display_name"), "source_key", "left")
        .withColumn("display_name", F.coalesce("display_name", "source_key"))
        .orderBy("display_name")
    )


def skills_in_use(jobs: DataFrame, links: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Vocabulary entries at least one visible advertisement carries, in vocabulary order."""
    live = links.join(jobs.filter(visible()).select(F.col("id").alias("job_id")), "job_id", "left_semi")
    used = live.select(F.col("skill_key").alias("key")).distinct()
    return vocabulary.join(used, "key", "left_semi").orderBy("pos")


def last_verified(jobs: DataFrame) -> DataFrame:
    return (
        jobs.groupBy("source_key")
        .agg(F.max("last_verified_at").alias("last_verified_at"))
        .filter(F.col("last_verified_at").isNotNull())
    )


def attributions(page: DataFrame, registry: DataFrame) -> DataFrame:
    """Lines a page of results owes: one per distinct source on it that requires one."""
    owed = registry.filter("attribution_required").select("source_key", "display_name", "attribution_text")
    return owed.join(page.select("source_key").distinct(), "source_key", "left_semi")


def vocabulary_by_kind(vocabulary: DataFrame) -> DataFrame:
    """One row per kind with its entries in order. A vocabulary is a short list kept by hand."""
    return vocabulary.groupBy("kind").agg(
        F.min("pos").alias("first"), F.sort_array(F.collect_list(F.struct("pos", "name"))).alias("entries")
    )


def register_split(registry: DataFrame, rights: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Each source as in use, not used or fixture, with the fields it does not let through."""
    eligible = (F.col("activation") == "ACTIVE") & (F.col("compliance_status") == "VERIFIED")
    use = (
        F.when(eligible, "IN_USE").when(F.col("activation") == "DEVELOPMENT_ONLY", "FIXTURE").otherwise("NOT_USED")
    )
    permitted = (
        rights.filter(F.col("stated") == "PERMITTED").groupBy("source_key").agg(F.collect_set("field").alias("allowed"))
    )
    listed = F.array(*[F.lit(f) for f in fields])
    allowed = F.coalesce(F.col("allowed"), F.array().cast("array<string>"))
    return registry.join(permitted, "source_key", "left").select(
        "source_key",
        "kind",
        use.alias("use"),
        ((F.col("kind") == "JOB_LISTING") & eligible).alias("is_listing_source"),
        F.array_except(listed, allowed).alias("withheld"),
    )
