"""Merge, sweep, retention, run-record and duplicate queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from advertide.functions.text import url_key, word_key
from advertide.operators import dedup as D
from advertide.operators import merge as M
from advertide.operators import partitions as B
from advertide.operators import totals as T
from advertide.plans.inputs import NOW, RUN_NOW, Inputs
from advertide.plans.listings import moment
from advertide.plans.registry import query
from advertide.session import work_folder

HASHED = ["source_key", "source_id", "title", "description"]
HASH_SQL = "sha256(cast(to_json([{0}source_key, {0}source_id, {0}title, {0}description]) as varchar))"
STAMP = "strftime({0}, '%Y-%m-%d %H:%M:%S')"


@query("g2_content_hash", f"select source_id, {HASH_SQL.format('')} as content_hash from {{fed_listing}}")
def g2(t: Inputs) -> DataFrame:
    return t.fed_listing.select("source_id", M.content_hash(*HASHED).alias("content_hash"))


SAME = "o.source_key = n.source_key and o.source_id = n.source_id"
LISTING_ACTION = f"""case when o.source_id is null then 'CREATED' when n.source_id is null then 'KEPT'
    when {HASH_SQL.format('o.')} = {HASH_SQL.format('n.')} then 'UNCHANGED' else 'UPDATED' end"""
UPSERTED = f"""select coalesce(n.source_key, o.source_key) as source_key, coalesce(n.source_id, o.source_id) as source_id, {LISTING_ACTION} as action,
    coalesce(n.title, o.title) as title, case when n.source_id is not null then 'ACTIVE' else o.status end as status,
    case when n.source_id is not null then timestamp '{NOW}' else o.last_seen_at end as last_seen_at,
    case when n.source_id is null then o.expired_at end as expired_at
    from {{stored_listing}} o full outer join {{fed_listing}} n on {SAME}"""


def upserted(t: Inputs) -> DataFrame:
    return M.upsert_listings(t.stored_listing, t.fed_listing, HASHED, NOW)


@query(
    "g1_listing_upsert",
    f"select source_key, source_id, action, title, status, {STAMP.format('last_seen_at')} as last_seen_at, {STAMP.format('expired_at')} as expired_at from ({UPSERTED}) u",
)
def g1(t: Inputs) -> DataFrame:
    return upserted(t).select(
        "source_key", "source_id", "action", "title", "status",
        moment("last_seen_at").alias("last_seen_at"), moment("expired_at").alias("expired_at"),
    )


@query(
    "g1_upsert_outcome",
    f"""select count(*) filter (where action = 'CREATED') as created, count(*) filter (where action = 'UPDATED') as updated,
    count(*) filter (where action = 'UNCHANGED') as unchanged, count(*) filter (where action = 'KEPT') as kept from ({UPSERTED}) u""",
)
def g1_outcome(t: Inputs) -> DataFrame:
    return M.outcome(upserted(t))


@query("g1_second_run_writes_nothing", f"select 'UNCHANGED' as action, count(*) as n from {{fed_listing}} union all select 'KEPT', count(*) from ({UPSERTED}) u where action = 'KEPT'")
def g1_again(t: Inputs) -> DataFrame:
    first = upserted(t).drop("action", "content_hash")
    return M.upsert_listings(first, t.fed_listing, HASHED, NOW).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


ONE_SOURCE = UPSERTED.replace("{fed_listing}", "(select * from {fed_listing} where source_key = 'src3')")


def stored_by_source(t: Inputs) -> B.Facts:
    hashed = t.stored_listing.withColumn("content_hash", M.content_hash(*HASHED))
    return B.create(hashed, work_folder(t.spark, "listings"), "source_key")


@query(
    "g1_source_partition_upsert",
    f"select source_key, source_id, case when source_key = 'src3' then title end as title, status, {STAMP.format('last_seen_at')} as last_seen_at from ({ONE_SOURCE}) u",
)
def g1_partition(t: Inputs) -> DataFrame:
    table = stored_by_source(t)
    B.upsert_source(t.spark, table, t.fed_listing, HASHED, NOW, "src3")
    # Titles the feed brought; the engines spell the upper case of some stored letters in different ways.
    title = F.when(F.col("source_key") == "src3", F.col("title")).alias("title")
    return table.read(t.spark).select("source_key", "source_id", title, "status", moment("last_seen_at").alias("last_seen_at"))


@query(
    "g4_source_partition_expiry",
    f"""select source_key, status, count(*) as n from (select source_key, case when coalesce(status = 'ACTIVE' and last_seen_at < timestamp '{NOW}' - interval 14 days
      and source_key = 'chat', false) then 'EXPIRED' else status end as status from {{stored_listing}} where source_key <> 'src3') s group by 1, 2""",
)
def g4_partition(t: Inputs) -> DataFrame:
    table = stored_by_source(t)
    B.expire_source(t.spark, table, "chat", NOW, 14)
    B.purge_source(t.spark, table, "src3")
    return table.read(t.spark).groupBy("source_key", "status").agg(F.count(F.lit(1)).alias("n"))


@query(
    "g3_refresh_decision",
    f"""with k as (select source_url, max(last_verified_at) as v from {{job}} where source_url is not null group by 1)
    select page_id, k.source_url is not null as touch, case when coalesce(v > timestamp '{NOW}' - interval 900 days, false) then 'SKIP' else 'FETCH' end as decision
    from {{pages}} left join k on k.source_url = url""",
)
def g3(t: Inputs) -> DataFrame:
    rows = t.pages.select("page_id", F.col("url").alias("detail_url"))
    stored = t.job.filter(F.col("source_url").isNotNull())
    return M.refresh_decisions(rows, stored, NOW, 900).select("page_id", "touch", "decision")


@query(
    "g4_expire_unseen",
    f"""select source_key, source_id, case when due then 'EXPIRED' else status end as status, case when due then '{NOW}' else {STAMP.format('expired_at')} end as expired_at
    from (select *, coalesce(status = 'ACTIVE' and last_seen_at < timestamp '{NOW}' - interval 14 days and source_key = 'chat', false) as due from {{stored_listing}}) s""",
)
def g4(t: Inputs) -> DataFrame:
    expired = M.expire_unseen(t.stored_listing, "chat", NOW, 14)
    return expired.select("source_key", "source_id", "status", moment("expired_at").alias("expired_at"))


@query("g5_purge_source", "select source_key, count(*) as n from {stored_listing} where source_key <> 'src3' group by 1")
def g5(t: Inputs) -> DataFrame:
    return M.purge_source(t.stored_listing, "src3").groupBy("source_key").agg(F.count(F.lit(1)).alias("n"))


OBSERVED = """select coalesce(n.series_key, o.series_key) as series_key, coalesce(n.period_start, o.period_start) as period_start,
    case when o.series_key is null then 'CREATED' when n.series_key is null then 'KEPT'
      when o.value_state = n.value_state and o.value is not distinct from n.value then 'UNCHANGED' else 'UPDATED' end as action,
    case when n.series_key is null then o.value else n.value end as value, case when n.series_key is null then o.value_state else n.value_state end as value_state
    from {stored_metric} o full outer join {metric} n on o.series_key = n.series_key and o.period_start = n.period_start"""


def observed(t: Inputs) -> DataFrame:
    incoming = t.metric.select("series_key", "period_start", "value", "value_state")
    return M.merge_observations(t.stored_metric, incoming)


@query("g6_observation_merge", f"select series_key, strftime(period_start, '%Y-%m-%d') as period, action, value, value_state from ({OBSERVED}) o")
def g6(t: Inputs) -> DataFrame:
    merged = M.latest_of(observed(t), ["series_key", "period_start"], ["value", "value_state"])
    return merged.select("series_key", F.date_format("period_start", "yyyy-MM-dd").alias("period"), "action", "value", "value_state")


@query(
    "g6_period_partition_merge",
    """with n as (select * from {metric} where year(period_start) >= 1997),
    m as (select coalesce(n.series_key, o.series_key) as series_key, coalesce(n.period_start, o.period_start) as period_start,
      case when n.series_key is null then o.value else n.value end as value, case when n.series_key is null then o.value_state else n.value_state end as value_state
      from {stored_metric} o full outer join n on o.series_key = n.series_key and o.period_start = n.period_start)
    select series_key, strftime(period_start, '%Y-%m-%d') as period, value, value_state from m
    where period_start in (select distinct period_start from m order by 1 desc limit 60)""",
)
def g6_partition(t: Inputs) -> DataFrame:
    table = B.create(t.stored_metric, work_folder(t.spark, "observations"), "period_start")
    incoming = t.metric.select("series_key", "period_start", "value", "value_state").filter(F.year("period_start") >= 1997)
    B.merge_periods(t.spark, table, incoming)
    B.prune_periods(t.spark, table, 60)
    return table.read(t.spark).select("series_key", F.date_format("period_start", "yyyy-MM-dd").alias("period"), "value", "value_state")


@query(
    "g7_series_upsert",
    """with i as (select s.series_key, s.occ_name, g.code as geo_id from {series} s left join {geography} g on g.code = s.geo_code and g.level = 'SA4'),
    o as (select series_key, concat('Brand ', split_part(series_key, '|', 2)) as occ_name, split_part(series_key, '|', 1) as geo_id from {stored_metric} group by 1)
    select coalesce(i.series_key, o.series_key) as series_key,
      case when o.series_key is null then 'CREATED' when i.series_key is null then 'KEPT'
        when o.occ_name is not distinct from i.occ_name and o.geo_id is not distinct from i.geo_id then 'UNCHANGED' else 'UPDATED' end as action,
      case when i.series_key is null then o.occ_name else i.occ_name end as occ_name, case when i.series_key is null then o.geo_id else i.geo_id end as geo_id
    from o full outer join i on o.series_key = i.series_key""",
)
def g7(t: Inputs) -> DataFrame:
    areas = t.geography.filter("level = 'SA4'").select(F.col("code").alias("geo_code"), F.col("code").alias("geo_id"))
    incoming = t.series.select("series_key", "occ_name", "geo_code").join(areas, "geo_code", "left").drop("geo_code")
    keys = t.stored_metric.select("series_key").distinct()
    parts = F.split("series_key", r"\|")
    stored = keys.select("series_key", F.concat(F.lit("Brand "), parts[1]).alias("occ_name"), parts[0].alias("geo_id"))
    return M.merge_series(stored, incoming, ["occ_name"], ["geo_id"])


@query(
    "g9_retention_prune",
    """with p as (select period_start, count(*) as rows from {metric} group by 1), k as (select period_start from p order by 1 desc limit 60)
    select strftime(period_start, '%Y-%m-%d') as period, rows, period_start in (select period_start from k) as kept from p""",
)
def g9(t: Inputs) -> DataFrame:
    outcome = T.retention_outcome(t.metric, 60)
    return outcome.select(F.date_format("period_start", "yyyy-MM-dd").alias("period"), "rows", "kept")


@query(
    "g10_attachment_sync",
    """with w as (select job_id, skill_key, min(matched_text) as q from {job_skill} where matched_text <> ' ' group by 1, 2),
    o as (select concat('job-', lpad(cast(doc_id as varchar), 12, '0')) as job_id, case when quality = 1 then 'the' else 'der' end as skill_key, case when toxic = 1 then 'THE' else 'The' end as q from {labels})
    select coalesce(w.job_id, o.job_id) as job_id, coalesce(w.skill_key, o.skill_key) as skill_key,
      case when o.job_id is null then 'ATTACH' when w.job_id is null then 'DETACH' when w.q = o.q then 'SAME' else 'REQUOTE' end as action, coalesce(w.q, o.q) as matched_text
    from o full outer join w on w.job_id = o.job_id and w.skill_key = o.skill_key""",
)
def g10(t: Inputs) -> DataFrame:
    wanted = t.job_skill.filter("matched_text <> ' '")
    stored = t.labels.select(
        F.concat(F.lit("job-"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("job_id"),
        F.when(F.col("quality") == 1, "the").otherwise("der").alias("skill_key"),
        F.lit("DETERMINISTIC").alias("method"),
        F.when(F.col("toxic") == 1, "THE").otherwise("The").alias("matched_text"),
    )
    return M.sync_attachments(wanted, stored, ["job_id", "skill_key"], "matched_text")


STORED_SKILL = "select c_mktsegment as x, min(lower(substr(c_mktsegment, 1, 3))) as key, min(c_mktsegment) as name, 'TOOL' as kind from {customer} group by 1 union all select p_type, 'the', 'The', 'TOOL' from {part} where p_type = 'SMALL' group by 1 union all select p_type, 'que', 'QUE', 'DOMAIN' from {part} where p_type = 'LARGE' or p_type = 'ECONOMY' group by 1, p_type having p_type = 'ECONOMY'"


@query(
    "c17_vocabulary_drift",
    f"""with o as (select key, name, kind from ({STORED_SKILL}) s), n as (select key, name, kind from {{skill}}),
    m as (select coalesce(n.key, o.key) as key, o.key as a, n.key as b, o.name is distinct from n.name as d1, o.kind is distinct from n.kind as d2 from o full outer join n on n.key = o.key)
    select key, 'missing from the table' as problem from m where a is null union all select key, 'missing from the declaration' from m where b is null
    union all select key, 'name has drifted' from m where a is not null and b is not null and d1 union all select key, 'kind has drifted' from m where a is not null and b is not null and d2""",
)
def c17(t: Inputs) -> DataFrame:
    return M.drift(t.sql(STORED_SKILL), t.skill, "key", ["name", "kind"])


@query(
    "g11_vocabulary_sync",
    f"""select coalesce(n.key, o.key) as key, case when o.key is null then 'CREATED' when n.key is null then 'KEPT' when o.name = n.name and o.kind = n.kind then 'UNCHANGED' else 'UPDATED' end as action,
    coalesce(n.name, o.name) as name, coalesce(n.kind, o.kind) as kind from ({STORED_SKILL}) o full outer join {{skill}} n on n.key = o.key""",
)
def g11(t: Inputs) -> DataFrame:
    stored = t.sql(STORED_SKILL).select("key", "name", "kind")
    return M.latest_of(M.merge(stored, t.skill.select("key", "name", "kind"), ["key"], ["name", "kind"]), ["key"], ["name", "kind"])


@query(
    "a13_registry_seed",
    """with o as (select source as source_key, concat('Source ', substr(source, 4)) as display_name, 'ACTIVE' as activation from {documents} where lang in ('de', 'es') group by 1)
    select coalesce(n.source_key, o.source_key) as source_key, case when o.source_key is null then 'CREATED' when n.source_key is null then 'KEPT'
      when o.display_name = n.display_name and o.activation = n.activation then 'UNCHANGED' else 'UPDATED' end as action
    from o full outer join {source_registry} n on n.source_key = o.source_key""",
)
def a13(t: Inputs) -> DataFrame:
    stored = (
        t.documents.filter("lang in ('de', 'es')")
        .select(
            F.col("source").alias("source_key"),
            F.concat(F.lit("Source "), F.substr("source", F.lit(4))).alias("display_name"),
            F.lit("ACTIVE").alias("activation"),
        )
        .distinct()
    )
    declared = t.source_registry.select("source_key", "display_name", "activation")
    return M.merge(stored, declared, ["source_key"], ["display_name", "activation"]).select("source_key", "action")


@query(
    "c15_new_dimension_keys",
    """select k as company_key, min(company_name) as company_name from (select trim(regexp_replace(lower(company_name), '[^a-z0-9]+', ' ', 'g')) as k, company_name from {job}) j
    where k <> '' and k not in (select trim(regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g')) from {customer} where c_mktsegment = 'BUILDING') group by 1""",
)
def c15(t: Inputs) -> DataFrame:
    held = t.customer.filter("c_mktsegment = 'BUILDING'").select(word_key(F.col("c_name")).alias("company_key"))
    incoming = t.job.select(word_key(F.col("company_name")).alias("company_key"), "company_name")
    return M.new_keys(incoming, held, "company_key")


@query(
    "f7_key_differences",
    """select 'ATTACH' as side, id as k from {job} where id not in (select concat('job-', lpad(cast(doc_id as varchar), 12, '0')) from {labels})
    union all select 'DETACH', concat('job-', lpad(cast(l.doc_id as varchar), 12, '0')) from {labels} l where not exists (select 1 from {job} j where j.doc_id = l.doc_id and j.status = 'ACTIVE') and l.quality = 1""",
)
def f7(t: Inputs) -> DataFrame:
    named = t.labels.select(F.concat(F.lit("job-"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("id"), "quality")
    only_jobs, _ = M.key_differences(t.job, named, "id")
    _, only_labels = M.key_differences(t.job.filter("status = 'ACTIVE'"), named.filter("quality = 1"), "id")
    return only_jobs.select(F.lit("ATTACH").alias("side"), F.col("id").alias("k")).unionByName(
        only_labels.select(F.lit("DETACH").alias("side"), F.col("id").alias("k"))
    )


@query(
    "f6_problem_union",
    """select 'metric' as what, series_key as id from {stored_metric} where value < 2 union all select 'listing', source_id from {stored_listing} where status = 'EXPIRED'""",
)
def f6(t: Inputs) -> DataFrame:
    few = t.stored_metric.filter("value < 2").select(F.lit("metric").alias("what"), F.col("series_key").alias("id"))
    gone = t.stored_listing.filter("status = 'EXPIRED'").select(F.lit("listing").alias("what"), F.col("source_id").alias("id"))
    return few.unionByName(gone)


@query(
    "g17_quarantine",
    """select event_id as run_id, source_key, kind, message from (select event_id, concat('src', cast(user_id % 20 as varchar)) as source_key,
      case when value < 3 then 'VALIDATION' when props like '%7%' then 'MAPPING' end as kind, case when value < 3 then 'value too small' when props like '%7%' then 'unreadable properties' end as message from {events}) e where kind is not null""",
)
def g17(t: Inputs) -> DataFrame:
    kind = F.when(F.col("value") < 3, "VALIDATION").when(F.col("props").contains("7"), "MAPPING")
    message = F.when(F.col("value") < 3, "value too small").when(F.col("props").contains("7"), "unreadable properties")
    rejects = t.events.select(
        "*", kind.alias("kind"), message.alias("message"), F.col("event_id").cast("string").alias("source_id"), F.col("props").alias("raw")
    ).filter(F.col("kind").isNotNull())
    source = F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string"))
    return M.quarantine(rejects, F.col("event_id"), source).select("run_id", "source_key", "kind", "message")


@query(
    "g18_quarantine_gate",
    """select run_id, round(rate, 6) as quarantine_rate, case when rate > 0.05 then 'FAILED' else status end as status
    from (select *, case when records_seen > 0 then records_quarantined / records_seen else 0 end as rate from {run}) r""",
)
def g18(t: Inputs) -> DataFrame:
    gated = M.quarantine_gate(t.run, 0.05)
    return gated.select("run_id", F.round("quarantine_rate", 6).alias("quarantine_rate"), "status")


@query(
    "g19_unseen_inputs",
    """select error_id from {run_error} e join {events} v on v.event_id = e.error_id where not exists (select 1 from {run} r where r.status = 'COMPLETED' and r.source_key = e.source_key
      and r.dataset = case when v.user_id % 3 = 0 then 'full' else 'delta' end and r.checksum = v.props)""",
)
def g19(t: Inputs) -> DataFrame:
    dataset = F.when(F.col("user_id") % 3 == 0, "full").otherwise("delta")
    offered = t.run_error.join(t.events, F.col("event_id") == F.col("error_id")).select(
        "error_id", "source_key", dataset.alias("dataset"), F.col("props").alias("checksum")
    )
    return M.unseen_inputs(offered, t.run).select("error_id")


@query(
    "g20_ledger_row",
    f"""select 'feed' as source_key, 'listings' as dataset, 'COMPLETED' as status, count(*) as records_seen, count(*) filter (where action in ('CREATED', 'UPDATED')) as records_written,
    count(*) filter (where action = 'UNCHANGED') as records_skipped, count(*) filter (where false) as records_quarantined from ({UPSERTED}) u where action <> 'KEPT'""",
)
def g20(t: Inputs) -> DataFrame:
    counts = M.outcome(upserted(t)).select(
        (F.col("created") + F.col("updated") + F.col("unchanged")).alias("records_seen"),
        (F.col("created") + F.col("updated")).alias("records_written"),
        F.col("unchanged").alias("records_skipped"),
        F.lit(0).cast("bigint").alias("records_quarantined"),
    )
    row = M.require_balanced(M.ledger_row(counts, "feed", "listings", "COMPLETED", NOW, NOW))
    return row.drop("started_at", "finished_at")


@query(
    "g21_reap_abandoned_runs",
    f"""select run_id, due as reaped, case when due then 'FAILED' else status end as status, case when due then '{RUN_NOW}' else {STAMP.format('finished_at')} end as finished_at
    from (select *, status = 'RUNNING' and started_at < timestamp '{RUN_NOW}' - interval 2 hours as due from {{run}}) r""",
)
def g21(t: Inputs) -> DataFrame:
    reaped = M.reap_abandoned(t.run, RUN_NOW)
    return reaped.select("run_id", "reaped", "status", moment("finished_at").alias("finished_at"))


@query(
    "g24_accounting",
    "select run_id, records_seen, records_written + records_skipped + records_quarantined as accounted from {run} where records_written + records_skipped + records_quarantined <> records_seen",
)
def g24(t: Inputs) -> DataFrame:
    return M.unbalanced_runs(t.run).select("run_id", "records_seen", "accounted")


@query(
    "g25_code_remap",
    "select signal, count(*) as n from (select case signal when 'OFFERED' then 'MENTIONED' when 'EXCLUDED' then 'REFUSED' else signal end as signal from {job}) j group by 1",
)
def g25(t: Inputs) -> DataFrame:
    return M.remap(t.job, "signal", {"OFFERED": "MENTIONED", "EXCLUDED": "REFUSED"}).groupBy("signal").agg(F.count(F.lit(1)).alias("n"))


# Addresses in the driver tables are all of the plain scheme://host/path form.
URL_SQL = "case when regexp_matches(lower({0}), '^https?://[^/?#]+') then concat(regexp_replace(lower(regexp_extract({0}, '^[a-zA-Z]+://([^/?#]+)', 1)), '^www\\.', ''), regexp_replace(regexp_extract({0}, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1), '/+$', '')) end"
CTA = "concat('cta:', substr(sha256(cast(to_json([ck, tk, lk]) as varchar)), 1, 32))"
CANDIDATES = f"""select id, source_key, posted_at, coalesce(trim(description) <> '', false) as described, 'url:' || {URL_SQL.format('apply_url')} as url_sig,
    case when ck <> '' and tk <> '' and lk <> '' then {CTA} end as identity_sig
    from (select *, trim(regexp_replace(lower(company_name), '[^a-z0-9]+', ' ', 'g')) as ck, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) as tk,
      regexp_replace(regexp_replace(lower(location_text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as lk from {{job}}) k"""
PREFERENCE = "order by described desc, posted_at asc nulls last, source_key, id"
MEMBERS = f"""members as (
    with cand as (select * from ({CANDIDATES}) c where id in (select id from {{job}} where status = 'ACTIVE')),
    u as (select *, first_value(id) over (partition by url_sig {PREFERENCE}) as canon, count(*) over (partition by url_sig) as n,
      min(source_key) over (partition by url_sig) <> max(source_key) over (partition by url_sig) as mixed from cand where url_sig is not null),
    ku as (select * from u where n >= 2 and mixed),
    i as (select *, first_value(id) over (partition by identity_sig {PREFERENCE}) as canon, count(*) over (partition by identity_sig) as n,
      min(source_key) over (partition by identity_sig) <> max(source_key) over (partition by identity_sig) as mixed
      from cand where identity_sig is not null and id not in (select id from ku))
    select id, url_sig as signature, 'CANONICAL_URL' as confidence, canon as canonical_id, n as members, id = canon as is_canonical from ku
    union all select id, identity_sig, 'IDENTITY_TRIPLE', canon, n, id = canon from i where n >= 2 and mixed)"""


def members(t: Inputs) -> DataFrame:
    return D.duplicate_members(t.job.filter("status = 'ACTIVE'"))


@query("h2_canonical_url_key", f"select page_id, {URL_SQL.format('url')} as url_key from {{pages}}")
def h2(t: Inputs) -> DataFrame:
    return t.pages.select("page_id", url_key(F.col("url")).alias("url_key"))


@query("h19_duplicate_signatures", f"select id, url_sig, identity_sig from ({CANDIDATES}) c")
def h19(t: Inputs) -> DataFrame:
    return D.with_signatures(t.job).select("id", "url_sig", "identity_sig")


@query("e4_duplicate_members", f"with {MEMBERS} select id, signature, confidence, members from members")
def e4(t: Inputs) -> DataFrame:
    return members(t).select("id", "signature", "confidence", "members")


@query("e5_canonical_members", f"with {MEMBERS} select signature, confidence, canonical_id, members from members where is_canonical")
def e5(t: Inputs) -> DataFrame:
    return D.duplicate_groups(members(t))


@query("d18_duplicate_confidence", f"with {MEMBERS} select confidence, count(*) as n from members where is_canonical group by 1")
def d18_confidence(t: Inputs) -> DataFrame:
    return M.distribution(D.duplicate_groups(members(t)), "confidence")


@query("d21_shared_addresses", "select apply_url, count(*) as n, count(*) - 1 as excess from {job} where status = 'ACTIVE' and is_canonical and apply_url is not null group by 1 having count(*) > 1")
def d21(t: Inputs) -> DataFrame:
    return D.shared_addresses(t.job)


@query(
    "g12_duplicate_write_back",
    f"""with {MEMBERS} select j.id, case when m.id is not null then 'GROUPED' when status = 'ACTIVE' and duplicate_group is not null then 'UNGROUPED' else 'LEFT' end as action,
      case when m.id is not null then m.signature when status = 'ACTIVE' then null else duplicate_group end as duplicate_group,
      case when m.id is not null then m.is_canonical when status = 'ACTIVE' and duplicate_group is not null then true else j.is_canonical end as is_canonical
    from {{grouped_job}} j left join members m on m.id = j.id""",
)
def g12(t: Inputs) -> DataFrame:
    return D.write_back(t.grouped_job, members(t))


@query(
    "g12_emptied_groups",
    """select distinct duplicate_group as signature from {grouped_job} where duplicate_group is not null
    and duplicate_group not in (select duplicate_group from {grouped_job} where status <> 'ACTIVE' and duplicate_group is not null)""",
)
def g12_emptied(t: Inputs) -> DataFrame:
    stored = t.grouped_job.filter("duplicate_group is not null").select(F.col("duplicate_group").alias("signature")).distinct()
    return D.emptied_groups(stored, D.write_back(t.grouped_job, members(t)))
