"""Declared data-quality checks.

A check is a frame of failing rows (``id``, ``weight``). What a row of one table can
fail by itself is a :class:`Rule`; all rules of a table are judged in one read of it,
as an array of what the row fails, exploded once. The failing rows of all checks are
written as one narrow table, from which failures are summed and the first few
identifiers are picked by a ranked limit that applies before the shuffle.
Identifiers are reported, content never is.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from advertide.functions.periods import MEASURED
from advertide.functions.redaction import CONTACT_RULES, Rule as ContactRule, has_contact
from advertide.operators.places import classify_places
from advertide.session import stage

EXAMPLES = 5


@dataclass(frozen=True)
class Check:
    name: str
    asserts: str
    failing: DataFrame | None
    detail: str | None = None


@dataclass(frozen=True)
class Rule:
    """What a row can fail by itself: the identifier it is shown by, and how often it counts (null or 0: it passes)."""

    identifier: Column
    weight: Column

    @classmethod
    def broken_by(cls, condition: Column, identifier: Column) -> Rule:
        return cls(identifier, condition.cast("int"))


def failing(df: DataFrame, identifier: Column, weight: Column | None = None) -> DataFrame:
    counted = F.lit(1) if weight is None else weight
    return df.select(identifier.cast("string").alias("id"), counted.cast("bigint").alias("weight"))


def failures(df: DataFrame, rules: Sequence[tuple[str, Rule]]) -> DataFrame:
    """``name, id, weight`` of everything the rows of one table fail, in one read of it."""
    failed = [
        F.when(
            rule.weight > 0,
            F.struct(
                F.lit(name).alias("name"),
                rule.identifier.cast("string").alias("id"),
                rule.weight.cast("bigint").alias("weight"),
            ),
        )
        for name, rule in rules
    ]
    return df.select(F.explode(F.array_compact(F.array(*failed))).alias("failed")).select("failed.*")


def broken(df: DataFrame, *rules: Rule) -> DataFrame:
    """``id, weight`` of the rows that fail one check made of these rules."""
    return failures(df, [("", rule) for rule in rules]).drop("name")


def report(
    spark: SparkSession, checks: list[Check], shared: Sequence[DataFrame] = (), examples: int = EXAMPLES
) -> DataFrame:
    """(name, asserts, status, failures, examples, detail), one row per check in the order given.

    ``shared`` holds failures of several checks at once (``name, id, weight``), as
    :func:`failures` gives them; they count for the checks of those names. The failing
    rows are written once to the shared folder, so no table is read again to show examples.
    """
    own = [c.failing.select(F.lit(c.name).alias("name"), "id", "weight") for c in checks if c.failing is not None]
    found = stage(reduce(lambda a, b: a.unionByName(b), [*own, *shared]), "quality-failures")
    failures = found.groupBy("name").agg(F.sum("weight").alias("failures"))
    first = Window.partitionBy("name").orderBy("id")
    few = (
        found.withColumn("rank", F.row_number().over(first))
        .filter(F.col("rank") <= examples)
        .groupBy("name")
        .agg(F.sort_array(F.collect_list("id")).alias("examples"))
    )
    declared = spark.createDataFrame(
        [(i, c.name, c.asserts, c.detail) for i, c in enumerate(checks)],
        "position int, name string, asserts string, detail string",
    )
    total = F.coalesce("failures", F.lit(0))
    return (
        declared.join(failures, "name", "left")
        .join(few, "name", "left")
        .select(
            "position",
            "name",
            "asserts",
            F.when(total == 0, "PASS").otherwise("FAIL").alias("status"),
            total.alias("failures"),
            F.coalesce("examples", F.array().cast("array<string>")).alias("examples"),
            "detail",
        )
        .orderBy("position")
        .drop("position")
    )


def summary(reported: DataFrame) -> DataFrame:
    return reported.agg(
        F.count_if(F.col("status") == "PASS").alias("passed"),
        F.count_if(F.col("status") == "FAIL").alias("failed"),
        (F.count_if(F.col("status") == "FAIL") == 0).alias("ok"),
    )


def negative_rule() -> Rule:
    return Rule.broken_by(F.col("value") < 0, F.col("id"))


def negative_values(*tables: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [broken(t, negative_rule()) for t in tables])


def missingness_rule(shown: Column | None = None) -> Rule:
    """A figure without a measuring state, or a measuring state without a figure."""
    wrong = F.col("value").isNull() == F.coalesce(F.col("value_state").isin(*MEASURED), F.lit(False))
    return Rule.broken_by(wrong, F.col("id") if shown is None else shown)


def unmodelled_missingness(metric: DataFrame) -> DataFrame:
    return broken(metric, missingness_rule())


def unresolved_geography(unresolved: DataFrame) -> DataFrame:
    return failing(unresolved, F.coalesce("code", "name", F.lit("unnamed")), F.col("series_count"))


def orphan_areas(geography: DataFrame, root: str = "COUNTRY") -> DataFrame:
    orphans = geography.filter(F.col("parent_code").isNull() & (F.col("level") != root))
    return failing(orphans, F.concat_ws(" ", "level", "code"))


def unclassified_occupations(occupations: DataFrame) -> DataFrame:
    return failing(occupations.filter((F.col("version") == "") | (F.col("name") == "")), F.col("id"))


def shared_live_addresses(shared: DataFrame) -> DataFrame:
    return failing(shared, F.col("apply_url"), F.col("excess"))


def dates_rule(now: str) -> Rule:
    """Each impossible date of a row counts once."""
    tomorrow = F.lit(now).cast("timestamp_ntz") + F.make_dt_interval(F.lit(1))
    yes = lambda condition: F.coalesce(condition, F.lit(False)).cast("int")
    wrong = (
        yes(F.col("posted_at") > tomorrow)
        + yes(F.col("last_verified_at") > tomorrow)
        + yes(F.col("expired_at") < F.col("first_seen_at"))
    )
    return Rule(F.col("id"), wrong)


def impossible_dates(jobs: DataFrame, now: str) -> DataFrame:
    return broken(jobs, dates_rule(now))


SPOKEN = ("OFFERED", "OPEN_TO", "MAY_BE_CONSIDERED", "EXCLUDED")


def evidence_rule(spoken: tuple[str, ...] = SPOKEN) -> Rule:
    empty = F.col("evidence").isNull() | (F.json_array_length("evidence") == 0)
    return Rule.broken_by(F.col("signal").isin(*spoken) & empty, F.col("id"))


def unevidenced_signals(jobs: DataFrame, spoken: tuple[str, ...] = SPOKEN) -> DataFrame:
    return broken(jobs, evidence_rule(spoken))


def placement_problem() -> Column:
    status, basis = F.col("regional_status"), F.col("regional_basis")
    return (
        F.when((status == "UNKNOWN") & (basis != "NONE"), "unplaced with a basis")
        .when((status != "UNKNOWN") & (basis == "NONE"), "placed without a basis")
        .when((basis == "POSTCODE") & F.col("postcode").isNull(), "placed by a postcode it does not hold")
        .when((status == "NOT_REGIONAL") & (basis == "STATE"), "excluded by a rule that only includes")
        .when((status != "REGIONAL") & F.col("regional_category").isNotNull(), "not regional with a category")
    )


def coherence_rule() -> Rule:
    problem = placement_problem()
    return Rule.broken_by(problem.isNotNull(), F.concat_ws(": ", F.col("place_id").cast("string"), problem))


def incoherent_placements(places: DataFrame) -> DataFrame:
    return broken(places, coherence_rule())


def attributed_rule() -> Rule:
    nameless = F.col("regional_instrument").isNull() | F.col("classified_on").isNull()
    return Rule.broken_by((F.col("regional_status") != "UNKNOWN") & nameless, F.col("place_id"))


def unattributed_placements(places: DataFrame) -> DataFrame:
    return broken(places, attributed_rule())


def postcode_source_rule() -> Rule:
    derived = F.col("postcode_source") == "DERIVED_FROM_COORDINATES"
    return Rule.broken_by(derived & F.col("postcode_reference").isNull(), F.col("place_id"))


def unsourced_postcodes(places: DataFrame) -> DataFrame:
    return broken(places, postcode_source_rule())


def postcode_form_rule() -> Rule:
    return Rule.broken_by(~F.col("postcode").rlike(r"^[0-9]{4}\z"), F.col("place_id"))


def malformed_postcodes(places: DataFrame) -> DataFrame:
    return broken(places, postcode_form_rule())


def placed_again(places: DataFrame, allocations: DataFrame) -> DataFrame:
    """Places with the verdict the tables give today on what their own verdict rests on."""
    asked = F.when(F.col("regional_basis") == "POSTCODE", F.col("postcode"))
    return classify_places(places.withColumn("asked", asked), allocations, "asked")


def instrument_rule() -> Rule:
    """Placed by postcode or state, and the tables now say otherwise; judged on :func:`placed_again`."""
    settled = F.col("regional_basis").isin("POSTCODE", "STATE")
    return Rule.broken_by(settled & (F.col("placed.status") != F.col("regional_status")), F.col("place_id"))


def outdated_placements(places: DataFrame, allocations: DataFrame) -> DataFrame:
    return broken(placed_again(places, allocations), instrument_rule())


def listings_by_source(jobs: DataFrame, registry: DataFrame) -> DataFrame:
    """Live listings per source with UNKNOWN, INELIGIBLE or ELIGIBLE."""
    eligible = (F.col("activation") == "ACTIVE") & (F.col("compliance_status") == "VERIFIED")
    known = registry.select("source_key", eligible.alias("eligible"))
    counts = jobs.filter(F.col("status") == "ACTIVE").groupBy("source_key").agg(F.count(F.lit(1)).alias("listings"))
    standing = F.when(F.col("eligible").isNull(), "UNKNOWN").when(F.col("eligible"), "ELIGIBLE").otherwise("INELIGIBLE")
    return counts.join(known, "source_key", "left").select("source_key", "listings", standing.alias("standing"))


def sources_standing(by_source: DataFrame, standing: str) -> DataFrame:
    return failing(by_source.filter(F.col("standing") == standing), F.col("source_key"), F.col("listings"))


def unpublishable_descriptions(jobs: DataFrame, permissions: DataFrame, registry: DataFrame) -> DataFrame:
    """Descriptions held for a listing source that may not show them, one row per source."""
    refused = registry.filter("kind = 'JOB_LISTING'").join(permissions.filter("permitted"), "source_key", "left_anti")
    held = jobs.filter(F.col("description").isNotNull()).groupBy("source_key").agg(F.count(F.lit(1)).alias("n"))
    return failing(held.join(refused.select("source_key"), "source_key", "left_semi"), F.col("source_key"), F.col("n"))


def contacts_rule(rules: tuple[ContactRule, ...] = CONTACT_RULES) -> Rule:
    return Rule.broken_by(has_contact(F.col("description"), rules), F.col("id"))


def stored_contacts(jobs: DataFrame, rules: tuple[ContactRule, ...] = CONTACT_RULES) -> DataFrame:
    return broken(jobs, contacts_rule(rules))


def quotation_rule() -> Rule:
    blank = F.col("matched_text").isNull() | (F.trim("matched_text") == "")
    return Rule.broken_by(blank, F.col("job_id"))


def unquoted_attachments(links: DataFrame) -> DataFrame:
    return broken(links, quotation_rule())


def drifted_vocabulary(problems: DataFrame) -> DataFrame:
    return failing(problems, F.concat_ws(": ", "key", "problem"))


def stale_attachments(expected: DataFrame, stored: DataFrame) -> DataFrame:
    """Advertisements whose stored attachments are not exactly those the vocabulary reads today."""
    yes = F.lit(True)
    want = expected.select("job_id", "skill_key", F.col("matched_text").alias("want"), yes.alias("wanted"))
    have = stored.filter(F.col("method") == "DETERMINISTIC").select(
        "job_id", "skill_key", F.coalesce("matched_text", F.lit("")).alias("have"), yes.alias("held")
    )
    both = want.join(have, ["job_id", "skill_key"], "full_outer")
    off = both.filter(F.col("wanted").isNull() | F.col("held").isNull() | (F.col("want") != F.col("have")))
    return failing(off.select("job_id").distinct(), F.col("job_id"))




def _eligible() -> Column:
    return (F.col("activation") == "ACTIVE") & (F.col("compliance_status") == "VERIFIED")


def attribution_rule() -> Rule:
    owed = _eligible() & F.col("attribution_required") & F.col("attribution_text").isNull()
    return Rule.broken_by(owed, F.col("source_key"))


def missing_attribution(registry: DataFrame) -> DataFrame:
    return broken(registry, attribution_rule())


def licence_rule() -> Rule:
    return Rule.broken_by((F.col("rights_status") == "ESTABLISHED") & F.col("licence").isNull(), F.col("source_key"))


def unlinked_licences(registry: DataFrame) -> DataFrame:
    return broken(registry, licence_rule())


def with_positions(registry: DataFrame, rights: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """Each source with how many of the fields that a listing needs it states a position on."""
    stated = rights.filter(F.col("field").isin(*required)).groupBy("source_key").agg(F.count_distinct("field").alias("stated"))
    return registry.join(stated, "source_key", "left")


def positions_rule(required: tuple[str, ...]) -> Rule:
    """Eligible listing sources that state no position on a field every listing needs; judged on :func:`with_positions`."""
    silent = F.coalesce("stated", F.lit(0)) < len(required)
    return Rule.broken_by(_eligible() & (F.col("kind") == "JOB_LISTING") & silent, F.col("source_key"))


def undescribed_rights(registry: DataFrame, rights: DataFrame, required: tuple[str, ...]) -> DataFrame:
    return broken(with_positions(registry, rights, required), positions_rule(required))


def _shown(rule: str, identifier: Column) -> Column:
    return F.concat_ws(": ", F.lit(rule), identifier.cast("string"))


def metric_constraint() -> Rule:
    return missingness_rule(_shown("value and state", F.col("id")))


def job_constraints() -> list[Rule]:
    bounds = F.col("salary_min").isNotNull() | F.col("salary_max").isNotNull()
    fixture = F.col("is_synthetic") != (F.col("source_key") == "fixture")
    return [
        Rule.broken_by(F.col("salary_min") > F.col("salary_max"), _shown("salary range", F.col("id"))),
        Rule.broken_by(bounds & F.col("salary_basis").isNull(), _shown("salary basis", F.col("id"))),
        Rule.broken_by(fixture, _shown("synthetic source", F.col("id"))),
    ]


def repeated_keys(runs: DataFrame, summaries: DataFrame, summary_key: list[str]) -> DataFrame:
    """More than one running run of a source and data set, more than one summary of a key."""
    running = runs.filter(F.col("status") == "RUNNING").groupBy("source_key", "dataset").agg(F.count(F.lit(1)).alias("n"))
    single = Rule.broken_by(F.col("n") > 1, _shown("one running", F.concat_ws("/", "source_key", "dataset")))
    # Null keys are equal to each other here, as the rule requires.
    repeated = summaries.groupBy(*summary_key).agg(F.count(F.lit(1)).alias("n"))
    key = F.concat_ws("/", *[F.coalesce(F.col(k).cast("string"), F.lit("-")) for k in summary_key])
    unique = Rule.broken_by(F.col("n") > 1, _shown("one summary", key))
    return broken(running, single).unionByName(broken(repeated, unique))


def broken_constraints(jobs: DataFrame, metric: DataFrame, runs: DataFrame, summaries: DataFrame, summary_key: list[str]) -> DataFrame:
    """What the table constraints forbid, as ``constraint: id``."""
    rows = broken(metric, metric_constraint()).unionByName(broken(jobs, *job_constraints()))
    return rows.unionByName(repeated_keys(runs, summaries, summary_key))


def declared_rules(identifier: str, declared: dict[str, tuple[str, ...]]) -> list[Rule]:
    """Stored codes outside their declared list, as ``column: id``."""
    return [Rule.broken_by(~F.col(c).isin(*values), F.concat_ws(": ", F.lit(c), identifier)) for c, values in declared.items()]


def undeclared_values(df: DataFrame, identifier: str, declared: dict[str, tuple[str, ...]]) -> DataFrame:
    return broken(df, *declared_rules(identifier, declared))


def held_by_source(jobs: DataFrame, registry: DataFrame, permissions: DataFrame) -> DataFrame:
    """Each source's live listings and stored descriptions, with its standing and whether it refuses descriptions."""
    counts = jobs.groupBy("source_key").agg(
        F.count_if(F.col("status") == "ACTIVE").alias("live"), F.count("description").alias("described")
    )
    permitted = permissions.filter("permitted").select("source_key", F.lit(True).alias("permitted")).distinct()
    known = registry.select("source_key", "kind", _eligible().alias("eligible")).join(permitted, "source_key", "left")
    refuses = (F.col("kind") == "JOB_LISTING") & F.col("permitted").isNull()
    return counts.join(known, "source_key", "left").select(
        "source_key", "live", "described", "eligible", F.coalesce(refuses, F.lit(False)).alias("refuses")
    )


def unregistered_rule() -> Rule:
    return Rule(F.col("source_key"), F.when(F.col("eligible").isNull(), F.col("live")))


def ineligible_rule() -> Rule:
    return Rule(F.col("source_key"), F.when(~F.col("eligible"), F.col("live")))


def refused_rule() -> Rule:
    return Rule(F.col("source_key"), F.when(F.col("refuses"), F.col("described")))
