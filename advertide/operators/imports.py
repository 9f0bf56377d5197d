"""Whole imports put together from the single operators. Network walks are not part of them: input is already a table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from advertide.functions.redaction import redact
from advertide.functions.text import dash_key, word_key
from advertide.functions.wording import SPONSORSHIP, SignalPack, combined_text, signal_of
from advertide.operators import merge as M
from advertide.operators.places import relink, resolve_geography, resolve_occupation, state_abbreviation
from advertide.operators.totals import keep_recent
from advertide.sources import listings as L
from advertide.sources import release as R
from advertide.session import stage

LARGEST_RATE = 0.05


@dataclass(frozen=True)
class ReleaseImport:
    series: DataFrame
    observations: DataFrame
    quarantined: DataFrame
    counts: DataFrame
    ledger: DataFrame


RESOLVED_FIELDS = ["resolved_code", "geography_resolution", "occupation_id", "occupation_resolution"]


def retained_readings(
    sheets: DataFrame, layout: DataFrame, source: str, dataset: str, measure: str, retain_periods: int
) -> DataFrame:
    """Readings of the newest period columns, as many as hold the ``retain_periods`` newest periods with a usable cell.

    Columns are taken by their headers. Where some of them hold no usable cell at all, the
    next older ones are taken as well, twice as many each time, until enough do or no column is left.
    """
    headed = R.header_periods(layout).count()
    taken = min(max(retain_periods, 0), headed)
    while True:
        narrowed = R.stated_rows(sheets, layout, recent_periods=taken)
        read = stage(R.readings(narrowed, source, dataset, measure), "readings")
        usable = read.filter(F.col("value_state").isNotNull()).select("period_start").distinct().count()
        if usable >= retain_periods or taken >= headed:
            return read
        taken = min(2 * taken, headed)


def import_release(
    sheets: DataFrame,
    stored_observations: DataFrame,
    geography: DataFrame,
    occupations: DataFrame,
    source: str,
    dataset: str,
    measure: str,
    unit: str,
    retain_periods: int,
    stored_series: DataFrame | None = None,
    runs: DataFrame | None = None,
    checksum: str | Column | None = None,
    started: str = "1970-01-01",
    finished: str = "1970-01-01",
) -> ReleaseImport:
    """A release read, narrowed to the retained periods, resolved and merged.

    Only the columns of retained periods are taken apart and kept. Older ones are read
    inside their row: their figures count as seen, their faults are quarantined, and only
    rows of a series stated more than once are taken apart whole, for repeats. A period
    in which no sheet holds a usable cell is not one of the retained.

    The gate is part of ``counts``. Where it fails, ``observations`` and ``series`` are
    what was stored, so a release that changed shape never replaces good data. A
    release whose ``checksum`` a completed run of ``runs`` (source_key, dataset, status,
    checksum) has recorded is not read again: its run is SKIPPED and the stored tables
    stay. :func:`~advertide.sources.release.input_checksum` works it out from the files. ``ledger`` is the row to append to the runs.
    """
    done = F.lit(False)
    if runs is not None:
        same = (F.col("source_key") == source) & (F.col("dataset") == dataset) & (F.col("checksum") == checksum)
        done = runs.filter(same & (F.col("status") == "COMPLETED")).agg((F.count(F.lit(1)) > 0).alias("done")).scalar()
        sheets = sheets.filter(~done)
    layout = R.layouts(sheets)
    stated = R.stated_rows(sheets, layout)
    facts = stage(R.row_facts(stated, source, dataset, measure), "release-rows")
    observed = R.observations(R.first_readings(retained_readings(sheets, layout, source, dataset, measure, retain_periods)))
    again = R.readings(R.rows_of_repeated_series(stated, facts), source, dataset, measure)
    repeated = stage(R.repeats(again, R.first_readings(again)).select(*R.PLACE, "label", "series_key", "value", "value_state", "agrees"), "repeats")
    problems = R.problems(stated, R.unread_cells(facts), repeated)

    window = keep_recent(observed, retain_periods)
    merged = M.merge_observations(stored_observations, window)
    snapshot = M.latest_of(merged, ["series_key", "period_start"], ["value_state", "value"])

    described = R.series_of(facts, source, dataset, measure, unit)
    areas = resolve_geography(described, geography, "geography_code", "geography_name").withColumnRenamed(
        "resolution", "geography_resolution"
    )
    series = resolve_occupation(areas, occupations, "occupation_code").withColumnRenamed(
        "resolution", "occupation_resolution"
    )

    usable = facts.agg(F.coalesce(F.sum(F.col("columns") - F.size("unread")), F.lit(0)).alias("n")).scalar()
    seen = usable - repeated.agg(F.count(F.lit(1)).alias("n")).scalar()
    found = problems.agg(F.count(F.lit(1)).alias("n")).scalar()
    dropped = repeated.filter("agrees").agg(F.count(F.lit(1)).alias("n")).scalar()
    outcome = M.outcome(merged)
    counts = outcome.select(
        (seen + found).alias("records_seen"),
        (F.col("created") + F.col("updated")).alias("records_written"),
        (F.col("unchanged") + dropped).alias("records_skipped"),
        found.alias("records_quarantined"),
        F.when(done, "SKIPPED").otherwise("COMPLETED").alias("status"),
        F.lit(None).cast("string").alias("error"),
    )
    records = problems.select(
        F.col("series_key").alias("source_id"),
        F.when(F.col("kind") == "NO_DIMENSIONS", "MAPPING").otherwise("VALIDATION").alias("kind"),
        F.concat_ws(" ", "sheet", F.lit("row"), F.col("row_index").cast("string"), "label").alias("message"),
        "raw",
    )
    quarantined = M.quarantine(records, F.lit(None).cast("bigint"), F.lit(source))
    gated = M.quarantine_gate(counts, LARGEST_RATE)
    # A failed run publishes nothing, and neither does a skipped one, whatever it would prune. One of the two is empty.
    failed = gated.select((F.col("status") != "COMPLETED").alias("failed")).scalar()
    as_stored = stored_observations.filter(failed).select(
        "series_key", "period_start", F.lit(M.KEPT).alias("action"), "value_state", "value"
    )
    published = keep_recent(snapshot, retain_periods).filter(~failed).unionByName(as_stored)
    if stored_series is not None:
        stated = [c for c in series.columns if c not in ("series_key", *RESOLVED_FIELDS)]
        resulting = M.merge_series(stored_series, series, stated, RESOLVED_FIELDS)
        kept = stored_series.filter(failed).withColumn("action", F.lit(M.KEPT)).select(*resulting.columns)
        series = resulting.filter(~failed).unionByName(kept)
    ledger = M.ledger_row(gated, source, dataset, F.col("status"), started, finished).withColumn("checksum", F.lit(checksum))
    return ReleaseImport(series, published, quarantined, gated, ledger)


@dataclass(frozen=True)
class ListingImport:
    listings: DataFrame
    companies: DataFrame
    locations: DataFrame
    quarantined: DataFrame
    counts: DataFrame
    ledger: DataFrame


HASHED = [
    "source_key", "source_id", "title", "description", "description_format", "description_is_excerpt", "company_name",
    "location_text", "latitude", "longitude", "employment_type", "remote_type", "contract_type", "salary_min", "salary_max",
    "salary_currency", "salary_period", "salary_basis", "apply_url", "source_url", "posted_at", "category_tag",
]

# A location as the dimension holds it; ``geo_code`` is null while no area answers to it.
LOCATION = ["location_key", "raw_text", "country_name", "state_name", "state_code", "latitude", "longitude", "geo_code"]


def stated_locations(fed: DataFrame, version: list[str]) -> DataFrame:
    """The locations a feed names, each as the first record by ``version`` states it.

    State, area and coordinates come from that one record. A feed states its hierarchy
    broadest first: the country, then the state; finer names are the provider's own.
    """
    broadest = lambda n: F.try_element_at("area", F.lit(n))
    stated = fed.select(
        *version,
        dash_key(F.col("location_text")).alias("location_key"),
        F.col("location_text").alias("raw_text"),
        broadest(1).alias("country_name"),
        broadest(2).alias("state_name"),
        state_abbreviation(broadest(2)).alias("state_code"),
        "latitude",
        "longitude",
        F.lit(None).cast("string").alias("geo_code"),
    )
    rest = [c for c in LOCATION if c != "location_key"]
    order = [*version, "raw_text", "state_name", "latitude", "longitude"]
    return M.one_per_key(stated.filter(F.col("location_key") != "").select("location_key", *rest, *version), ["location_key"], order).select(*LOCATION)


def with_signal(listings: DataFrame, pack: SignalPack) -> DataFrame:
    """Signal and evidence beside the text they were read from: anew for written rows, as stored for all others."""
    written = F.col("action").isin(*M.WRITTEN)
    stored = {c: F.col(c) if c in listings.columns else F.lit(None).cast("string") for c in ("signal", "evidence")}
    read = (
        listings.withColumn("_text", F.when(written, combined_text(F.col("title"), F.col("description"))))
        .withColumn("_excerpt", F.coalesce("description_is_excerpt", F.lit(False)))
        .withColumn("_found", F.when(written, signal_of("_text", "_excerpt", pack)))
    )
    evidence = F.when(F.size("_found.evidence") > 0, F.to_json("_found.evidence"))
    return read.select(
        *[c for c in listings.columns if c not in stored],
        F.when(written, F.col("_found.signal")).otherwise(stored["signal"]).alias("signal"),
        F.when(written, evidence).otherwise(stored["evidence"]).alias("evidence"),
    )


def import_listings(
    lines: DataFrame,
    stored: DataFrame,
    companies: DataFrame,
    locations: DataFrame,
    geography: DataFrame,
    registry: DataFrame,
    source: str,
    country: str,
    now: str,
    expire_after_days: int,
    version: list[str],
    walk_complete: bool = True,
    pack: SignalPack = SPONSORSHIP,
    dataset: str = "listings",
    started: str | None = None,
) -> ListingImport:
    """A feed read, rejects set aside, contact details removed, merged by content hash, placed, and the unseen expired.

    Nothing is read from a source that ``registry`` does not know as active and verified:
    the job fails with the reason. ``version`` names columns of ``lines`` that tell the
    order of records, such as their place in the feed or the time of the walk: of several
    records of one listing the last counts. ``locations`` is the whole dimension after the
    run: stored rows, those the feed adds, and of both the ones no area was found for
    tried again. ``ledger`` is the row to append to the runs.
    """
    usable = M.require_usable(registry, source).scalar()
    # Accepted rows, rejects and both dimensions come from one staged parse.
    parsed = stage(L.parse_listings(lines.filter(usable == source), keep=tuple(version)), "listings")
    fed = L.canonical_listings(L.accepted(parsed), source, country, tuple(version)).withColumn("description", redact(F.col("description")))
    merged = M.upsert_listings(stored, fed, HASHED, now, version)
    expired = M.expire_unseen(merged, source, now, expire_after_days, walk_complete)
    keys = {"company_key": word_key(F.col("company_name")), "location_key": dash_key(F.col("location_text"))}
    current = with_signal(expired, pack).withColumns({k: F.nullif(v, F.lit("")) for k, v in keys.items()})
    named = fed.select(keys["company_key"].alias("company_key"), "company_name")

    added = stated_locations(fed, version).join(locations.select("location_key"), "location_key", "left_anti")
    placed = relink(locations.select(*LOCATION).unionByName(added), geography)

    rejects = L.rejected(parsed)
    outcome = M.outcome(merged)
    # Records of a listing that a later one of the same feed replaces are skipped.
    accepted = fed.agg(F.count(F.lit(1)).alias("n")).scalar()
    refused = rejects.agg(F.count(F.lit(1)).alias("n")).scalar()
    written = F.col("created") + F.col("updated")
    counts = outcome.select(
        (accepted + refused).alias("records_seen"),
        written.alias("records_written"),
        (accepted - written).alias("records_skipped"),
        refused.alias("records_quarantined"),
    )
    return ListingImport(
        current,
        M.new_keys(named, companies, "company_key"),
        placed,
        M.quarantine(rejects, F.lit(None).cast("bigint"), F.lit(source)),
        counts,
        M.ledger_row(counts, source, dataset, "COMPLETED", started or now, now),
    )
