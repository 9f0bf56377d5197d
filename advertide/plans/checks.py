"""Data-quality checks and source health."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from advertide.functions.redaction import CONTACT_RULES
from advertide.operators import dedup as D
from advertide.operators import health as H
from advertide.operators import merge as M
from advertide.operators import places as G
from advertide.operators import quality as Q
from advertide.operators import search as S
from advertide.operators import totals as T
from advertide.plans.areas import UNRESOLVED, allocation_sql, classified_sql
from advertide.plans.inputs import NOW, RUN_NOW, Inputs
from advertide.plans.listings import ELIGIBLE, moment
from advertide.plans.registry import query
from advertide.plans.upkeep import STORED_SKILL
from advertide.plans.words import DRIVER_VOCABULARY, EDGES, attachments, attachments_sql

REQUIRED = ("title", "description")
DECLARED = {
    "status": ("ACTIVE", "EXPIRED"),
    "signal": ("OFFERED", "OPEN_TO", "MAY_BE_CONSIDERED", "NOT_MENTIONED", "INDETERMINATE"),
    "category_tag": ("en", "fr", "de"),
}
SUMMARY_KEY = ["geo", "measure", "occ"]


def eligible_unresolved(t: Inputs) -> DataFrame:
    resolved = G.resolve_geography(t.stated_area, t.numbered_area, "stated_code", "stated_name")
    return T.unresolved_dimensions(resolved.withColumn("source_key", F.lit("feed")), "feed")


CHECKS = {
    "s1_counts_non_negative": (
        "Figures are zero or more, in observations and in summaries",
        lambda t: Q.negative_values(t.faulty_metric, t.faulty_summary),
        "select id, 1 as weight from {faulty_metric} where value < 0 union all select id, 1 from {faulty_summary} where value < 0",
    ),
    "s2_missingness_modelled": (
        "The state of a reading and its figure say the same",
        lambda t: Q.unmodelled_missingness(t.faulty_metric),
        "select id, 1 as weight from {faulty_metric} where (value is null) = coalesce(value_state in ('PRESENT', 'ZERO'), false)",
    ),
    "s3_series_resolved": (
        "A series that names a region can be placed",
        lambda t: Q.unresolved_geography(eligible_unresolved(t)),
        f"select coalesce(code, name, 'unnamed') as id, series_count as weight from ({UNRESOLVED}) u",
    ),
    "s4_hierarchy_complete": (
        "Only a country may stand without a parent area",
        lambda t: Q.orphan_areas(t.faulty_area),
        "select concat(level, ' ', code) as id, 1 as weight from {faulty_area} where parent_code is null and level <> 'COUNTRY'",
    ),
    "s5_occupations_classified": (
        "An occupation has a name and tells its edition",
        lambda t: Q.unclassified_occupations(t.faulty_occupation),
        "select id, 1 as weight from {faulty_occupation} where version = '' or name = ''",
    ),
    "s6_no_duplicate_live_listings": (
        "An application address belongs to one live canonical listing",
        lambda t: Q.shared_live_addresses(D.shared_addresses(t.job)),
        "select apply_url as id, count(*) - 1 as weight from {job} where status = 'ACTIVE' and is_canonical and apply_url is not null group by 1 having count(*) > 1",
    ),
    "s7_dates_possible": (
        "Listing dates are in a possible order and not ahead of the clock",
        lambda t: Q.impossible_dates(t.job, NOW),
        f"""select id, w as weight from (select id, case when posted_at > timestamp '{NOW}' + interval 1 day then 1 else 0 end
          + case when last_verified_at > timestamp '{NOW}' + interval 1 day then 1 else 0 end + case when expired_at < first_seen_at then 1 else 0 end as w from {{job}}) j where w > 0""",
    ),
    "s8_signal_evidenced": (
        "A graded signal comes with its quotation",
        lambda t: Q.unevidenced_signals(t.job),
        "select id, 1 as weight from {job} where signal in ('OFFERED', 'OPEN_TO', 'MAY_BE_CONSIDERED', 'EXCLUDED') and doc_id % 11 in (0, 1)",
    ),
    "s9_placement_coherent": (
        "Status, basis and category of a place fit each other",
        lambda t: Q.incoherent_placements(t.place),
        """select concat(place_id, ': ', p) as id, 1 as weight from (select place_id, case when regional_status = 'UNKNOWN' and regional_basis <> 'NONE' then 'unplaced with a basis'
          when regional_status <> 'UNKNOWN' and regional_basis = 'NONE' then 'placed without a basis' when regional_basis = 'POSTCODE' and postcode is null then 'placed by a postcode it does not hold'
          when regional_status = 'NOT_REGIONAL' and regional_basis = 'STATE' then 'excluded by a rule that only includes'
          when regional_status <> 'REGIONAL' and regional_category is not null then 'not regional with a category' end as p from {place}) x where p is not null""",
    ),
    "s10_placement_attributed": (
        "A verdict on a place cites its instrument and date",
        lambda t: Q.unattributed_placements(t.place),
        "select cast(place_id as varchar) as id, 1 as weight from {place} where regional_status <> 'UNKNOWN' and (regional_instrument is null or classified_on is null)",
    ),
    "s11_derived_postcode_sourced": (
        "A postcode worked out from a point cites its boundaries",
        lambda t: Q.unsourced_postcodes(t.place),
        "select cast(place_id as varchar) as id, 1 as weight from {place} where postcode_source = 'DERIVED_FROM_COORDINATES' and postcode_reference is null",
    ),
    "s12_postcode_well_formed": (
        "Postcodes have exactly four digits",
        lambda t: Q.malformed_postcodes(t.place),
        "select cast(place_id as varchar) as id, 1 as weight from {place} where not regexp_matches(postcode, '^[0-9][0-9][0-9][0-9]$')",
    ),
    "s13_matches_instrument": (
        "Placing again by postcode or state changes no verdict",
        lambda t: Q.outdated_placements(t.place, G.allocation_table(t.spark)),
        f"""with alloc as ({allocation_sql()}), a as (select place_id, regional_status, regional_basis, state_code, case when regional_basis = 'POSTCODE' then postcode end as postcode
          from {{place}} where regional_basis in ('POSTCODE', 'STATE')) select cast(place_id as varchar) as id, 1 as weight from ({classified_sql('a')}) c where new_status <> regional_status""",
    ),
    "s14_source_registered": (
        "The register knows the source of each live listing",
        lambda t: Q.sources_standing(Q.listings_by_source(t.job, t.source_registry), "UNKNOWN"),
        "select source_key as id, count(*) as weight from {job} where status = 'ACTIVE' and source_key not in (select source_key from {source_registry}) group by 1",
    ),
    "s15_source_eligible": (
        "The source of each live listing may be used today",
        lambda t: Q.sources_standing(Q.listings_by_source(t.job, t.source_registry), "INELIGIBLE"),
        f"select source_key as id, count(*) as weight from {{job}} where status = 'ACTIVE' and source_key in (select source_key from {{source_registry}} where not ({ELIGIBLE})) group by 1",
    ),
    "s16_description_withheld": (
        "Descriptions are held only where the rights allow them",
        lambda t: Q.unpublishable_descriptions(t.job, S.field_permissions(t.source_registry, t.rights, "description"), t.source_registry),
        f"""select source_key as id, count(*) as weight from {{job}} where description is not null and source_key in (select source_key from {{source_registry}} r where kind = 'JOB_LISTING'
          and not ({ELIGIBLE} and exists (select 1 from {{rights}} x where x.source_key = r.source_key and x.field = 'description' and x.stated = 'PERMITTED'))) group by 1""",
    ),
    "s17_no_contact_details": (
        "Redaction left no contact in a description",
        lambda t: Q.stored_contacts(t.job, CONTACT_RULES),
        "select id, 1 as weight from {job} where " + " or ".join(f"regexp_matches(description, '{pattern}')" for pattern, _ in EDGES),
    ),
    "s18_attachment_evidenced": (
        "A skill is attached together with the matching words",
        lambda t: Q.unquoted_attachments(t.job_skill),
        "select job_id as id, 1 as weight from {job_skill} where matched_text is null or trim(matched_text) = ''",
    ),
    "s19_vocabulary_in_step": (
        "Stored and declared vocabulary hold the same entries",
        lambda t: Q.drifted_vocabulary(M.drift(t.sql(STORED_SKILL), t.skill, "key", ["name", "kind"])),
        f"""with o as (select key, name, kind from ({STORED_SKILL}) s), m as (select coalesce(n.key, o.key) as key, o.key as a, n.key as b, o.name is distinct from n.name as d1, o.kind is distinct from n.kind as d2 from o full outer join {{skill}} n on n.key = o.key)
          select key || ': missing from the table' as id, 1 as weight from m where a is null union all select key || ': missing from the declaration', 1 from m where b is null
          union all select key || ': name has drifted', 1 from m where a is not null and b is not null and d1 union all select key || ': kind has drifted', 1 from m where a is not null and b is not null and d2""",
    ),
    "s20_matches_vocabulary": (
        "Reading again would attach each stored skill again",
        lambda t: Q.stale_attachments(attachments(t.job, DRIVER_VOCABULARY), t.job_skill),
        f"""with w as ({attachments_sql()}), h as (select job_id, skill_key, matched_text from {{job_skill}})
          select distinct coalesce(w.job_id, h.job_id) as id, 1 as weight from w full outer join h on h.job_id = w.job_id and h.skill_key = w.skill_key
          where w.matched_text is distinct from h.matched_text""",
    ),
    "s21_attribution_available": (
        "Where attribution is due its text is on file",
        lambda t: Q.missing_attribution(t.source_registry),
        f"select source_key as id, 1 as weight from {{source_registry}} where {ELIGIBLE} and attribution_required and attribution_text is null",
    ),
    "s22_licence_linkable": (
        "Settled rights come with a licence",
        lambda t: Q.unlinked_licences(t.source_registry),
        "select source_key as id, 1 as weight from {source_registry} where rights_status = 'ESTABLISHED' and licence is null",
    ),
    "s23_listing_content_described": (
        "For each needed field a listing source has said yes or no",
        lambda t: Q.undescribed_rights(t.source_registry, t.rights, REQUIRED),
        f"""select source_key as id, 1 as weight from {{source_registry}} r where {ELIGIBLE} and kind = 'JOB_LISTING'
          and (select count(*) from {{rights}} x where x.source_key = r.source_key and x.field in ('title', 'description')) < 2""",
    ),
    "s25_constraints": (
        "Rows obey the rules of their tables",
        lambda t: Q.broken_constraints(t.job, t.faulty_metric, t.run, t.faulty_metric, SUMMARY_KEY),
        """select 'value and state: ' || id as id, 1 as weight from {faulty_metric} where (value is null) = coalesce(value_state in ('PRESENT', 'ZERO'), false)
          union all select 'salary range: ' || id, 1 from {job} where salary_min > salary_max
          union all select 'salary basis: ' || id, 1 from {job} where (salary_min is not null or salary_max is not null) and salary_basis is null
          union all select 'synthetic source: ' || id, 1 from {job} where is_synthetic <> (source_key = 'fixture')
          union all select 'one running: ' || source_key || '/' || dataset, 1 from {run} where status = 'RUNNING' group by source_key, dataset having count(*) > 1
          union all select 'one summary: ' || geo || '/' || measure || '/' || coalesce(cast(occ as varchar), '-'), 1 from {faulty_metric} group by geo, measure, occ having count(*) > 1""",
    ),
    "s26_declared_values": (
        "Coded columns use known codes only",
        lambda t: Q.undeclared_values(t.job, "id", DECLARED),
        """select 'status: ' || id as id, 1 as weight from {job} where status not in ('ACTIVE', 'EXPIRED')
          union all select 'signal: ' || id, 1 from {job} where signal not in ('OFFERED', 'OPEN_TO', 'MAY_BE_CONSIDERED', 'NOT_MENTIONED', 'INDETERMINATE')
          union all select 'category_tag: ' || id, 1 from {job} where category_tag not in ('en', 'fr', 'de')""",
    ),
}


def _failing_query(build):
    return lambda t: build(t)


for _name, (_asserts, _build, _sql) in CHECKS.items():
    query(_name, None if _sql is None else f"select id, cast(weight as bigint) as weight from ({_sql}) f")(_failing_query(_build))


def _report_sql() -> str:
    """Names, failures and five first identifiers of every check that has its own SQL."""
    parts = []
    for name, (_, _, sql) in CHECKS.items():
        if sql is not None:
            parts.append(
                f"""select '{name}' as name, case when coalesce(sum(weight), 0) = 0 then 'PASS' else 'FAIL' end as status, cast(coalesce(sum(weight), 0) as bigint) as failures,
          coalesce(array_to_string(list_sort(list(id))[1:5], ' | '), '') as examples from ({sql}) f"""
            )
    return "\nunion all ".join(parts)


def shared_failures(t: Inputs) -> tuple[set[str], list[DataFrame]]:
    """Checks that are judged with others of their table, and the failures of each table in one read of it."""
    permissions = S.field_permissions(t.source_registry, t.rights, "description")
    single = lambda name, rules: [(name, rule) for rule in rules]
    tables = [
        (
            t.faulty_metric,
            [
                ("s1_counts_non_negative", Q.negative_rule()),
                ("s2_missingness_modelled", Q.missingness_rule()),
                ("s25_constraints", Q.metric_constraint()),
            ],
        ),
        (t.faulty_summary, [("s1_counts_non_negative", Q.negative_rule())]),
        (
            t.job,
            [
                ("s7_dates_possible", Q.dates_rule(NOW)),
                ("s8_signal_evidenced", Q.evidence_rule()),
                ("s17_no_contact_details", Q.contacts_rule(CONTACT_RULES)),
                *single("s25_constraints", Q.job_constraints()),
                *single("s26_declared_values", Q.declared_rules("id", DECLARED)),
            ],
        ),
        (
            Q.placed_again(t.place, G.allocation_table(t.spark)),
            [
                ("s9_placement_coherent", Q.coherence_rule()),
                ("s10_placement_attributed", Q.attributed_rule()),
                ("s11_derived_postcode_sourced", Q.postcode_source_rule()),
                ("s12_postcode_well_formed", Q.postcode_form_rule()),
                ("s13_matches_instrument", Q.instrument_rule()),
            ],
        ),
        (
            Q.held_by_source(t.job, t.source_registry, permissions),
            [
                ("s14_source_registered", Q.unregistered_rule()),
                ("s15_source_eligible", Q.ineligible_rule()),
                ("s16_description_withheld", Q.refused_rule()),
            ],
        ),
        (
            Q.with_positions(t.source_registry, t.rights, REQUIRED),
            [
                ("s21_attribution_available", Q.attribution_rule()),
                ("s22_licence_linkable", Q.licence_rule()),
                ("s23_listing_content_described", Q.positions_rule(REQUIRED)),
            ],
        ),
    ]
    repeated = Q.repeated_keys(t.run, t.faulty_metric, SUMMARY_KEY).select(F.lit("s25_constraints").alias("name"), "id", "weight")
    names = {name for _, rules in tables for name, _ in rules}
    return names, [*[Q.failures(table, rules) for table, rules in tables], repeated]


@query("s_quality_report", _report_sql())
def s_report(t: Inputs) -> DataFrame:
    shared, frames = shared_failures(t)
    checks = [
        Q.Check(name, asserts, None if name in shared else build(t))
        for name, (asserts, build, sql) in CHECKS.items()
        if sql is not None
    ]
    reported = Q.report(t.spark, checks, frames)
    return reported.select("name", "status", "failures", F.array_join("examples", " | ").alias("examples"))


@query(
    "d22_listings_by_source",
    f"""select j.source_key, count(*) as listings, case when max(r.source_key) is null then 'UNKNOWN' when bool_or({ELIGIBLE}) then 'ELIGIBLE' else 'INELIGIBLE' end as standing
    from {{job}} j left join {{source_registry}} r on r.source_key = j.source_key where status = 'ACTIVE' group by 1""",
)
def d22(t: Inputs) -> DataFrame:
    return Q.listings_by_source(t.job, t.source_registry)


FACTS = """with s as (select source_key, started_at, finished_at, run_id, records_written, records_seen, row_number() over (partition by source_key order by finished_at desc, run_id desc) as rn from {run} where status = 'COMPLETED'),
  f as (select source_key, coalesce(finished_at, started_at) as at, error, row_number() over (partition by source_key order by started_at desc, run_id desc) as rn from {run} where status = 'FAILED'),
  r as (select source_key, min(started_at) as since from {run} where status = 'RUNNING' group by 1),
  k as (select distinct source_key from {run})
  select k.source_key, s.finished_at as last_success_at, coalesce(records_written, 0) as records_written, coalesce(records_seen, 0) as records_seen, f.at as last_failure_at, f.error as last_failure_message, r.since as running_since
  from k left join s on s.source_key = k.source_key and s.rn = 1 left join f on f.source_key = k.source_key and f.rn = 1 left join r on r.source_key = k.source_key"""
SECOND = "strftime({0}, '%Y-%m-%d %H:%M:%S')"


@query(
    "e11_run_facts",
    f"select source_key, {SECOND.format('last_success_at')} as last_success_at, records_written, records_seen, {SECOND.format('last_failure_at')} as last_failure_at, last_failure_message, {SECOND.format('running_since')} as running_since from ({FACTS}) f",
)
def e11(t: Inputs) -> DataFrame:
    facts = H.run_facts(t.run)
    for column in ("last_success_at", "last_failure_at", "running_since"):
        facts = facts.withColumn(column, moment(column))
    return facts


JOINED = f"""select r.source_key, retrieval_method in ('API', 'CRAWL') as scheduled, f.last_success_at, f.last_failure_at, coalesce(l.n, 0) as active_listings, l.oldest as oldest_verified_at, coalesce(e.n, 0) as quarantined_recently
  from {{source_registry}} r left join ({FACTS}) f on f.source_key = r.source_key
  left join (select source_key, count(*) as n, min(last_verified_at) as oldest from {{job}} where status = 'ACTIVE' group by 1) l on l.source_key = r.source_key
  left join (select source_key, count(*) as n from {{run_error}} where occurred_at >= timestamp '{RUN_NOW}' - interval 48 hours group by 1) e on e.source_key = r.source_key
  where {ELIGIBLE}"""
VERDICT = f"""case when last_success_at is null and last_failure_at is null then 'NOT_RUN' when last_failure_at is not null and (last_success_at is null or last_failure_at > last_success_at) then 'FAILING'
  when scheduled and last_success_at < timestamp '{RUN_NOW}' - interval 36 hours then 'SILENT' when scheduled and oldest_verified_at < timestamp '{RUN_NOW}' - interval 14 days then 'STALE'
  when quarantined_recently > 0 then 'STALE' else 'HEALTHY' end"""


def facts(t: Inputs) -> DataFrame:
    return H.source_facts(t.source_registry, t.run, t.job, t.run_error, RUN_NOW)


@query("m1_health_verdict", f"select source_key, {VERDICT} as health from ({JOINED}) j")
def m1(t: Inputs) -> DataFrame:
    return H.with_verdict(facts(t), RUN_NOW).select("source_key", "health")


@query(
    "m2_source_facts",
    f"select source_key, scheduled, {SECOND.format('last_success_at')} as last_success_at, {SECOND.format('last_failure_at')} as last_failure_at, active_listings, {SECOND.format('oldest_verified_at')} as oldest_verified_at, quarantined_recently from ({JOINED}) j",
)
def m2(t: Inputs) -> DataFrame:
    return facts(t).select(
        "source_key", "scheduled", moment("last_success_at").alias("last_success_at"), moment("last_failure_at").alias("last_failure_at"),
        "active_listings", moment("oldest_verified_at").alias("oldest_verified_at"), "quarantined_recently",
    )


@query("m3_health_report", f"select count(*) as sources, count(*) filter (where health = 'HEALTHY') as healthy, bool_and(health = 'HEALTHY') as ok from (select {VERDICT} as health from ({JOINED}) j) v")
def m3(t: Inputs) -> DataFrame:
    return H.overall(H.with_verdict(facts(t), RUN_NOW))
