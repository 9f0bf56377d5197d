"""Advertisement queries over listings derived from the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from advertide.functions import labels as L
from advertide.operators import search as S
from advertide.plans.inputs import NOW, Inputs
from advertide.plans.registry import query

FIELDS = ("title", "description", "company", "location", "salary")
VISIBLE = "status = 'ACTIVE' and is_canonical and not is_synthetic"
ELIGIBLE = "activation = 'ACTIVE' and compliance_status = 'VERIFIED'"


def moment(column):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def found(t: Inputs, **filters) -> DataFrame:
    return S.matching(t.job, t.job_skill, S.Search(**filters), NOW)


@query("b1_visible_listings", f"select id from {{job}} where {VISIBLE}")
def b1(t: Inputs) -> DataFrame:
    return t.job.filter(S.visible()).select("id")


@query(
    "b2_text_contains",
    f"""select id from {{job}} where {VISIBLE} and (contains(lower(title), 'and the') or contains(lower(description), 'and the') or contains(lower(company_name), 'and the'))""",
)
def b2(t: Inputs) -> DataFrame:
    return found(t, text=" And The ").select("id")


@query(
    "b3_location",
    f"""select 'state' as asked, id from {{job}} where {VISIBLE} and state_code = 'NSW'
    union all select 'text', id from {{job}} where {VISIBLE} and (contains(lower(location_text), 'europe') or state_code = 'EUROPE')""",
)
def b3(t: Inputs) -> DataFrame:
    asked = {"state": "nsw", "text": "europe"}
    parts = [found(t, location=term).select(F.lit(name).alias("asked"), "id") for name, term in asked.items()]
    return parts[0].unionByName(parts[1])


@query(
    "b4_equality_filters",
    f"select id from {{job}} where {VISIBLE} and category_tag = 'en' and employment_type = 'FULL_TIME' and signal = 'NOT_MENTIONED'",
)
def b4(t: Inputs) -> DataFrame:
    return found(t, category="en", employment="FULL_TIME", signal="NOT_MENTIONED").select("id")


@query(
    "b5_area_filter",
    f"""select 'UNKNOWN' as area, id from {{job}} where {VISIBLE} and (regional_status = 'UNKNOWN' or place_id is null)
    union all select 'REGIONAL', id from {{job}} where {VISIBLE} and regional_status = 'REGIONAL'""",
)
def b5(t: Inputs) -> DataFrame:
    parts = [found(t, area=area).select(F.lit(area).alias("area"), "id") for area in ("UNKNOWN", "REGIONAL")]
    return parts[0].unionByName(parts[1])


@query(
    "b6_posted_recently",
    f"select id from {{job}} where {VISIBLE} and posted_at >= timestamp '{NOW}' - interval 365 days",
)
def b6(t: Inputs) -> DataFrame:
    return found(t, posted_within_days=365).select("id")


@query("b7_without_synthetic", "select id, status from {job} where not is_synthetic")
def b7(t: Inputs) -> DataFrame:
    S.real_only(t.job).createOrReplaceTempView("job_real")
    return t.spark.sql("select id, status from job_real")


@query(
    "b8_rights_gated_description",
    f"""select j.id, case when p.ok then j.description end as description, not coalesce(p.ok, false) and j.description is not null as description_withheld
    from {{job}} j left join (select r.source_key, coalesce({ELIGIBLE} and s.stated = 'PERMITTED', false) as ok from {{source_registry}} r
      left join {{rights}} s on s.source_key = r.source_key and s.field = 'description') p on p.source_key = j.source_key""",
)
def b8(t: Inputs) -> DataFrame:
    return S.gate_field(t.job, t.source_registry, t.rights, "description").select("id", "description", "description_withheld")


SALARY_SQL = "(salary_min is not null or salary_max is not null) and salary_currency is not null and salary_period is not null and salary_basis is not null"


@query(
    "b10_salary",
    f"""select id, case when {SALARY_SQL} then salary_min end as salary_low, case when {SALARY_SQL} then salary_max end as salary_high,
    case when {SALARY_SQL} then salary_currency end as currency from {{job}}""",
)
def b10(t: Inputs) -> DataFrame:
    return t.job.select("id", S.salary().alias("salary")).select(
        "id", F.col("salary.min").alias("salary_low"), F.col("salary.max").alias("salary_high"), F.col("salary.currency").alias("currency")
    )


@query(
    "b11_contract_label",
    """select id, case when lower(trim(contract_type)) not in ('', 'permanent') then
      concat(upper(substr(lower(trim(contract_type)), 1, 1)), substr(lower(trim(contract_type)), 2)) end as contract_label from {job}""",
)
def b11(t: Inputs) -> DataFrame:
    return t.job.select("id", S.contract_label(F.col("contract_type")).alias("contract_label"))


@query(
    "b12_stored_evidence",
    """select id, case doc_id % 11 when 0 then '' when 1 then '' when 2 then 'p=old;q=t' when 3 then '' when 4 then 'p=c' else 'p=s' end as quoted from {job}""",
)
def b12(t: Inputs) -> DataFrame:
    mixed = '[{"phrase":"p","sentence":1,"context":"c"},{"phrase":2,"sentence":"s"},"p",{"phrase":"p","sentence":null,"context":"c"}]'
    evidence = F.when(F.col("doc_id") % 11 == 4, mixed).otherwise(F.col("evidence"))
    shown = F.transform(S.evidence_items(evidence), lambda e: F.concat(e["phrase"], F.lit("="), e["sentence"]))
    return t.job.select("id", F.array_join(shown, ";").alias("quoted"))


@query(
    "b13_placement",
    """select id, coalesce(regional_status, 'UNKNOWN') as status, regional_category as category, coalesce(regional_basis, 'NONE') as basis,
    postcode, coalesce(postcode_source = 'DERIVED_FROM_COORDINATES', false) as postcode_is_derived from {job}""",
)
def b13(t: Inputs) -> DataFrame:
    return t.job.select("id", S.placement().alias("p")).select("id", "p.*")


LIFECYCLE_SQL = f"""case when status = 'WITHDRAWN' then 'REMOVED' when status = 'EXPIRED' then 'EXPIRED'
    when coalesce(last_verified_at, first_seen_at) < timestamp '{NOW}' - interval 7 days then 'STALE'
    when posted_at >= timestamp '{NOW}' - interval 3 days then 'NEW' else 'ACTIVE' end"""


@query("b14_lifecycle", f"select id, {LIFECYCLE_SQL} as state, {LIFECYCLE_SQL} not in ('EXPIRED', 'REMOVED') as is_shown from {{job}}")
def b14(t: Inputs) -> DataFrame:
    staged = t.job.select("id", S.lifecycle(NOW).alias("state"))
    return staged.withColumn("is_shown", S.publicly_visible(F.col("state")))


def sql_label(code: str, wording: dict[str, str]) -> str:
    arms = " ".join(f"when '{k}' then '{v}'" for k, v in wording.items())
    return f"case {code} {arms} end"


@query(
    "b19_code_labels",
    f"""select id, {sql_label('state', L.LIFECYCLE)} as lifecycle_label, {sql_label('regional_status', L.AREA_STATUS)} as area_label,
    {sql_label('regional_category', L.AREA_CATEGORY)} as category_label, {sql_label('regional_basis', L.AREA_BASIS)} as basis_label,
    {sql_label('regional_basis', L.AREA_BASIS_MEANING)} as basis_meaning, {sql_label('signal', L.SIGNAL)} as signal_label,
    {sql_label('signal', L.SIGNAL_MEANING)} as signal_meaning, {sql_label('employment_type', L.EMPLOYMENT)} as employment_label
    from (select *, {LIFECYCLE_SQL} as state from {{job}}) j""",
)
def b19(t: Inputs) -> DataFrame:
    c = F.col
    return t.job.withColumn("state", S.lifecycle(NOW)).select(
        "id",
        L.label(c("state"), L.LIFECYCLE).alias("lifecycle_label"),
        L.label(c("regional_status"), L.AREA_STATUS).alias("area_label"),
        L.label(c("regional_category"), L.AREA_CATEGORY).alias("category_label"),
        L.label(c("regional_basis"), L.AREA_BASIS).alias("basis_label"),
        L.label(c("regional_basis"), L.AREA_BASIS_MEANING).alias("basis_meaning"),
        L.label(c("signal"), L.SIGNAL).alias("signal_label"),
        L.label(c("signal"), L.SIGNAL_MEANING).alias("signal_meaning"),
        L.label(c("employment_type"), L.EMPLOYMENT).alias("employment_label"),
    )


@query(
    "b19_vocabulary_labels",
    f"""select key as code, {sql_label('kind', L.SKILL_KIND)} as label from {{skill}} where key in (select skill_key from {{job_skill}})
    union all select occ_code, case when count(distinct nullif(occ_name, '')) = 1 then concat(min(nullif(occ_name, '')), ' (', occ_code, ')')
      when occ_code = '0' then 'All occupations' else concat('Code ', occ_code) end from {{series}} group by occ_code""",
)
def b19_vocabulary(t: Inputs) -> DataFrame:
    from advertide.operators.totals import occupation_options
    from advertide.plans.inputs import DATASET, SOURCE

    used = t.job_skill.select(F.col("skill_key").alias("key")).distinct()
    kinds = t.skill.join(used, "key", "left_semi").select(F.col("key").alias("code"), L.label(F.col("kind"), L.SKILL_KIND).alias("label"))
    groups = occupation_options(t.series, SOURCE, DATASET)
    return kinds.unionByName(groups.select("code", L.occupation_label(F.col("code"), F.col("name")).alias("label")))


@query(
    "b20_source_register",
    f"""select r.source_key, case when {ELIGIBLE} then 'IN_USE' when activation = 'DEVELOPMENT_ONLY' then 'FIXTURE' else 'NOT_USED' end as use,
    kind = 'JOB_LISTING' and {ELIGIBLE} as is_listing_source,
    (select string_agg(f.field, ',' order by f.pos) from (values ('title', 0), ('description', 1), ('company', 2), ('location', 3), ('salary', 4)) f(field, pos)
      where not exists (select 1 from {{rights}} x where x.source_key = r.source_key and x.field = f.field and x.stated = 'PERMITTED')) as withheld
    from {{source_registry}} r""",
)
def b20(t: Inputs) -> DataFrame:
    split = S.register_split(t.source_registry, t.rights, FIELDS)
    return split.select("source_key", "use", "is_listing_source", F.array_join("withheld", ",").alias("withheld"))


@query(
    "c3_listing_enrichment",
    """select j.id, j.company_name, j.location_text, coalesce(s.skills, '') as skills from {job} j left join (
      select job_id, string_agg(concat(name, ':', matched_text), ',' order by pos) as skills from {job_skill} join {skill} on key = skill_key group by 1) s on s.job_id = j.id""",
)
def c3(t: Inputs) -> DataFrame:
    shown = F.transform("skills", lambda s: F.concat(s["name"], F.lit(":"), s["matched_text"]))
    enriched = S.with_skills(t.job, t.job_skill, t.skill)
    return enriched.select("id", "company_name", "location_text", F.array_join(shown, ",").alias("skills"))


@query(
    "c4_has_skill",
    f"select id from {{job}} where {VISIBLE} and id in (select job_id from {{job_skill}} where skill_key = 'der')",
)
def c4(t: Inputs) -> DataFrame:
    return found(t, skill="der").select("id")


@query(
    "d6_indexed_sources",
    f"select distinct j.source_key, coalesce(display_name, j.source_key) as display_name from {{job}} j left join {{source_registry}} r on r.source_key = j.source_key where {VISIBLE}",
)
def d6(t: Inputs) -> DataFrame:
    return S.indexed_sources(t.job, t.source_registry)


@query(
    "d7_skills_in_use",
    f"select key, name, pos from {{skill}} where key in (select skill_key from {{job_skill}} where job_id in (select id from {{job}} where {VISIBLE}))",
)
def d7(t: Inputs) -> DataFrame:
    return S.skills_in_use(t.job, t.job_skill, t.skill).select("key", "name", "pos")


@query(
    "d8_last_verified",
    "select source_key, strftime(max(last_verified_at), '%Y-%m-%d %H:%M:%S') as last_verified_at from {job} group by 1 having max(last_verified_at) is not null",
)
def d8(t: Inputs) -> DataFrame:
    return S.last_verified(t.job).withColumn("last_verified_at", moment("last_verified_at"))


PAGE_SQL = f"select * from {{job}} where {VISIBLE} order by posted_at desc nulls last, id limit 20 offset 20"


@query("d24_attribution_owed", f"select distinct r.source_key, display_name, attribution_text from {{source_registry}} r join ({PAGE_SQL}) p on p.source_key = r.source_key where attribution_required")
def d24(t: Inputs) -> DataFrame:
    return S.attributions(S.page_of(found(t), 2), t.source_registry)


@query(
    "d25_vocabulary_by_kind",
    "select kind, string_agg(name, ',' order by pos) as entries from {skill} where key in (select skill_key from {job_skill}) group by kind",
)
def d25(t: Inputs) -> DataFrame:
    used = t.job_skill.select(F.col("skill_key").alias("key")).distinct()
    grouped = S.vocabulary_by_kind(t.skill.join(used, "key", "left_semi"))
    return grouped.orderBy("first").select("kind", F.array_join(F.col("entries")["name"], ",").alias("entries"))


@query("f1_search_page", f"select id, title, source_key, strftime(posted_at, '%Y-%m-%d %H:%M:%S') as posted_at from ({PAGE_SQL}) p")
def f1(t: Inputs) -> DataFrame:
    page, _ = S.search_page(t.job, t.job_skill, S.Search(), NOW, page=2)
    return page.select("id", "title", "source_key", moment("posted_at").alias("posted_at"))


@query("f1_search_total", f"select count(*) as total from {{job}} where {VISIBLE} and regional_status = 'REGIONAL' and contains(lower(title), 'th')")
def f1_total(t: Inputs) -> DataFrame:
    wanted = matching_titles(t)
    return wanted.agg(F.count(F.lit(1)).alias("total"))


def matching_titles(t: Inputs) -> DataFrame:
    return found(t, area="REGIONAL").filter(S.contains_any("TH", "title"))


@query(
    "f4_skills_in_vocabulary_order",
    "select key, name, pos, count(*) as n from {job_skill} join {skill} on key = skill_key group by 1, 2, 3 order by pos, name",
)
def f4(t: Inputs) -> DataFrame:
    used = t.job_skill.groupBy(F.col("skill_key").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return used.join(t.skill, "key").select("key", "name", "pos", "n").orderBy("pos", "name")


@query("f8_vocabulary_in_common", "select key from {skill} intersect select skill_key from {job_skill}")
def f8(t: Inputs) -> DataFrame:
    return t.skill.select("key").intersect(t.job_skill.select("skill_key"))


@query(
    "d18_distributions",
    """select 'signal' as what, signal as k, count(*) as n from {job} group by 2
    union all select 'skill', skill_key, count(*) from {job_skill} group by 2
    union all select 'placement', concat(regional_status, '/', regional_basis), count(*) from {place} group by 2""",
)
def d18(t: Inputs) -> DataFrame:
    from advertide.operators.merge import distribution

    placed = t.place.withColumn("verdict", F.concat_ws("/", "regional_status", "regional_basis"))
    parts = [("signal", t.job, "signal"), ("skill", t.job_skill, "skill_key"), ("placement", placed, "verdict")]
    frames = [distribution(df, column).select(F.lit(what).alias("what"), F.col(column).alias("k"), "n") for what, df, column in parts]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])
