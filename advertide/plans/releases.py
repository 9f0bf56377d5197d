"""Source, sink and import queries over sheets, feeds and pages made from the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from advertide.functions import periods as P
from advertide.functions.text import dash_key
from advertide.operators import imports as I
from advertide.operators import totals as T
from advertide.plans.inputs import DATASET, NOW, Inputs
from advertide.plans.listings import moment
from advertide.plans.registry import query
from advertide.plans.series import LEAF, occupation_sql, occupation_table, state_table
from advertide.sources import listings as L
from advertide.sources import registries as G
from advertide.sources import release as R
from advertide.sources import sinks as K
from advertide.session import stage

MEASURE, UNIT, FEED = "Online advertisements", "advertisements", "feed"


def sheets(t: Inputs) -> DataFrame:
    """The observations as a release would print them: three sheets of series, one that repeats some of them, and two that cannot be read."""
    months = t.metric.select("period_start").distinct().agg(F.sort_array(F.collect_list("period_start")).alias("m")).scalar()
    printed = (
        F.when(F.col("value_state") == "SUPPRESSED", "np")
        .when(F.col("value_state") == "ZERO", "0")
        .when(F.col("value") % 7 == 2, " .. ")
        .when((F.month("period_start") == 5) & (F.col("value") % 3 == 1), "-")
        .otherwise(F.format_number(F.col("value") * 1000, 0))
    )
    # A series prints one row: its list is as long as the release has months.
    rows = (
        t.metric.groupBy("geo_code", "occ_code")
        .agg(F.map_from_entries(F.collect_list(F.struct(F.col("period_start"), printed.alias("cell")))).alias("by_month"))
        .withColumn("nk", F.substr("geo_code", F.lit(2)).cast("int"))
        .withColumn("months", months)
    )
    stated = F.array(F.col("occ_code"), F.concat(F.lit("Brand "), "occ_code"), F.col("geo_code"), F.lit("Original"))
    values = F.transform("months", lambda m: F.try_element_at("by_month", m))
    number = (F.col("nk") * 100 + F.col("occ_code").cast("int") + 5).alias("row_index")
    series = rows.select(F.concat(F.lit("S"), (F.col("nk") % 3).cast("string")).alias("sheet"), number, F.concat(stated, values).alias("cells"))
    again = rows.filter("occ_code = '7'").select(
        F.lit("S9").alias("sheet"), number, F.concat(stated, F.transform(values, lambda v: F.when(F.col("nk") % 4 == 0, "9").otherwise(v))).alias("cells")
    )
    regions = t.region.withColumn("months", months)
    titles = F.array(*[F.lit(x) for x in ("ANZSCO_CODE", "Anzsco  Title", "Region", "Adjustment")])
    labels = F.transform("months", lambda m: F.date_format(m, "MMM-yy"))
    wide = lambda sheet, row, cells: regions.select(sheet.alias("sheet"), row.cast("int").alias("row_index"), cells.alias("cells"))
    each = F.concat(F.lit("S"), F.when(F.col("r_regionkey") == 3, 9).otherwise(F.col("r_regionkey")).cast("string"))
    blanks = F.transform("months", lambda m: F.lit("5"))
    nobody = F.array(F.lit(None), F.lit(" "), F.lit(None), F.lit("Original")).cast("array<string>")
    headers = wide(each, F.lit(4), F.concat(titles, labels)).filter("sheet <> 'S4'")
    captions = wide(each, F.lit(1), F.array(F.concat(F.lit("Table of "), "r_name"))).filter("sheet <> 'S4'")
    nameless = wide(F.lit("S0"), F.col("r_regionkey") + 4000, F.concat(nobody, blanks))
    notes = wide(F.lit("T1"), F.col("r_regionkey") + 1, F.array(F.col("r_name"), F.lit("note")))
    undimensioned = wide(F.lit("T2"), F.col("r_regionkey") + 1, F.concat(F.array(F.lit("Remarks")), F.when(F.col("r_regionkey") == 1, labels).otherwise(blanks)))
    out = series
    for part in (again, headers, captions, nameless, notes, undimensioned):
        out = out.unionByName(part)
    return out


CELLS = """select g.geo_code, g.occ_code, nk, p.period_start, nk * 100 + cast(g.occ_code as int) + 5 as row_index, case when m.series_key is null then null when m.value_state = 'SUPPRESSED' then 'np' when m.value_state = 'ZERO' then '0'
    when m.value % 7 = 2 then '..' when month(m.period_start) = 5 and m.value % 3 = 1 then '-' else cast(cast(m.value * 1000 as bigint) as varchar) end as cell
  from (select distinct geo_code, occ_code, cast(substr(geo_code, 2) as int) as nk from {metric}) g cross join (select distinct period_start from {metric}) p
  left join {metric} m on m.geo_code = g.geo_code and m.occ_code = g.occ_code and m.period_start = p.period_start"""
READ = f"""select *, 'feed|advertisement-index|online-advertisements|month|g:n.' || lower(geo_code) || '|o:c.' || occ_code || '|adjustment.original' as series_key,
    case when cell is null then 'UNAVAILABLE' when cell = 'np' then 'SUPPRESSED' when cell = '..' then 'NOT_COVERED' when cell = '0' then 'ZERO' when cell <> '-' then 'PRESENT' end as value_state,
    case when cell = '-' then null else try_cast(cell as double) end as value
  from (select 'S' || (nk % 3) as sheet, * from ({CELLS}) a union all select 'S9', geo_code, occ_code, nk, period_start, row_index, case when nk % 4 = 0 then '9' else cell end from ({CELLS}) b where occ_code = '7') c"""
RANKED = f"select *, row_number() over (partition by series_key, period_start order by sheet, row_index) as rn, first_value(value_state) over (partition by series_key, period_start order by sheet, row_index) as first_state, first_value(value) over (partition by series_key, period_start order by sheet, row_index) as first_value from ({READ}) r where value_state is not null"
PERIOD = "strftime(period_start, '%Y-%m-%d')"


class Parsed:
    """The steps of one release, shared by the queries that look at different parts of it."""

    def __init__(self, t: Inputs):
        # A stored release is a table; here it is made once and kept.
        self.sheets = stage(sheets(t), "sheets")
        self.layout = R.layouts(self.sheets)
        self.stated = R.stated_rows(self.sheets, self.layout)
        self.read = R.readings(self.stated, FEED, DATASET, MEASURE)
        self.first = R.first_readings(self.read)


@query("a2_release_observations", f"select series_key, {PERIOD} as period, value_state, value from ({RANKED}) f where rn = 1")
def a2(t: Inputs) -> DataFrame:
    found = R.observations(Parsed(t).first)
    return found.select("series_key", F.date_format("period_start", "yyyy-MM-dd").alias("period"), "value_state", "value")


@query(
    "a2_release_recent_periods",
    f"select {PERIOD} as period, count(*) as n from ({RANKED}) f where rn = 1 and period_start in (select distinct period_start from {{metric}} order by 1 desc limit 13) group by 1",
)
def a2_recent(t: Inputs) -> DataFrame:
    release = sheets(t)
    stated = R.stated_rows(release, R.layouts(release), recent_periods=13)
    found = R.observations(R.first_readings(R.readings(stated, FEED, DATASET, MEASURE)))
    return found.groupBy(F.date_format("period_start", "yyyy-MM-dd").alias("period")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "a2_release_problems",
    f"""select kind, sheet, row_index, period, raw from (
      select 'UNREADABLE_VALUE' as kind, sheet, row_index, strftime(period_start, '%b-%y') as period, cell as raw from ({READ}) u where value_state is null
      union all select 'CONFLICTING_DUPLICATE', sheet, row_index, strftime(period_start, '%b-%y'), coalesce(cast(value as varchar), value_state) from ({RANKED}) c
        where rn > 1 and (value_state <> first_state or value is distinct from first_value)
      union all select 'NO_DIMENSIONS', 'S0', r_regionkey + 4000, null, ' |  |  | Original' || repeat(' | 5', (select cast(count(distinct period_start) as int) from {{metric}})) from {{region}}) p""",
)
def a2_problems(t: Inputs) -> DataFrame:
    release = Parsed(t)
    found = R.problems(release.stated, release.read, R.repeats(release.read, release.first))
    return found.select("kind", "sheet", "row_index", F.col("label").alias("period"), "raw")


@query(
    "a3_sheet_report",
    f"""with s as (select distinct period_start from {{metric}}), d as (select count(*) as n, min(period_start) as a, max(period_start) as b from s),
    c as (select sheet, count(distinct (geo_code, occ_code)) as data_rows from ({READ}) r group by 1)
    select sheet, 'PARSED' as status, null as reason, 4 as header_row, n as period_columns, strftime(a, '%Y-%m') as first_period, strftime(b, '%Y-%m') as last_period, data_rows, 'Adjustment' as unmatched from c, d
    union all select 'T1', 'SKIPPED', 'no header row', null, null, null, null, 0, '' from d
    union all select 'T2', 'SKIPPED', 'periods without a dimension', 2, n, null, null, 0, 'Remarks' from d""",
)
def a3(t: Inputs) -> DataFrame:
    release = sheets(t)
    layout = R.layouts(release)
    return R.sheet_report(layout, R.stated_rows(release, layout))


@query(
    "e10_repeated_readings",
    f"select series_key, {PERIOD} as period, sheet, value_state = first_state and value is not distinct from first_value as agrees from ({RANKED}) f where rn > 1",
)
def e10(t: Inputs) -> DataFrame:
    release = Parsed(t)
    later = R.repeats(release.read, release.first)
    return later.select("series_key", F.date_format("period_start", "yyyy-MM-dd").alias("period"), "sheet", "agrees")


@query(
    "h8_period_labels",
    """select label, strftime(start, '%Y-%m-%d') as period, grain from (
      select distinct strftime(d, '%b-%y') as label, date_trunc('month', d) as start, 'MONTH' as grain from (select cast(l_shipdate as date) as d from {lineitem}) a
      union select distinct strftime(d, '%B %Y'), date_trunc('month', d), 'MONTH' from (select cast(l_shipdate as date) as d from {lineitem}) b
      union select distinct strftime(d, '%Y-%m'), date_trunc('month', d), 'MONTH' from (select cast(l_shipdate as date) as d from {lineitem}) c
      union select distinct strftime(d, '%Y-%m-%d'), date_trunc('month', d), 'MONTH' from (select cast(l_shipdate as date) as d from {lineitem}) h
      union select distinct strftime(d, '%Y-%m-%d') || ' 00:00:00', date_trunc('month', d), 'MONTH' from (select cast(l_shipdate as date) as d from {lineitem}) i
      union select distinct 'Q' || quarter(d) || ' ' || year(d), date_trunc('quarter', d), 'QUARTER' from (select cast(l_shipdate as date) as d from {lineitem}) e
      union select distinct strftime(d, '%Y'), date_trunc('year', d), 'YEAR' from (select cast(l_shipdate as date) as d from {lineitem}) f) g""",
)
def h8(t: Inputs) -> DataFrame:
    d = F.col("l_shipdate").cast("date")
    quarter = F.concat(F.lit("Q"), F.quarter(d).cast("string"), F.lit(" "), F.year(d).cast("string"))
    spelled = F.array(F.date_format(d, "MMM-yy"), F.date_format(d, "MMMM yyyy"), F.date_format(d, "yyyy-MM"), F.date_format(d, "yyyy-MM-dd"), F.date_format(d, "yyyy-MM-dd HH:mm:ss"), quarter, F.date_format(d, "yyyy"))
    labels = t.lineitem.select(F.explode(spelled).alias("label")).distinct()
    read = labels.withColumn("p", P.parse_period(F.col("label")))
    return read.select("label", F.date_format("p.period_start", "yyyy-MM-dd").alias("period"), F.col("p.granularity").alias("grain"))


@query(
    "h9_value_cells",
    """select state, unreadable, count(*) as n, round(sum(value), 2) as total from (
      select case l_linenumber when 1 then 'PRESENT' when 2 then 'SUPPRESSED' when 3 then 'NOT_COVERED' when 4 then null when 5 then 'UNAVAILABLE' when 6 then 'ZERO' else 'PRESENT' end as state,
        case when l_linenumber = 4 then '-' end as unreadable, case l_linenumber when 6 then 0 when 1 then l_quantity * 1000 when 7 then l_quantity * 0.5 end as value from {lineitem}) c group by 1, 2""",
)
def h9(t: Inputs) -> DataFrame:
    n = F.col("l_linenumber")
    cell = (
        F.when(n == 1, F.format_number(F.col("l_quantity") * 1000, 0))
        .when(n == 2, " NP")
        .when(n == 3, "..")
        .when(n == 4, " - ")
        .when(n == 5, "  ")
        .when(n == 6, "0.0")
        .otherwise((F.col("l_quantity") * 0.5).cast("string"))
    )
    read = t.lineitem.select(P.read_value(cell).alias("r")).select("r.*")
    return read.groupBy("state", "unreadable").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query(
    "h17_header_roles",
    """select k, case k when 0 then 'occupation_code' when 1 then 'geography_name' when 2 then 'geography_name' when 3 then 'geography_name' when 5 then 'geography_level' end as role,
    case k when 0 then 0 when 1 then 0 when 2 then 11 when 3 then 2 when 5 then 3 end as rank, count(*) as n from (select c_custkey % 6 as k from {customer}) c group by 1""",
)
def h17(t: Inputs) -> DataFrame:
    spelled = F.array(*[F.lit(x) for x in ("ANZSCO_CODE", " Region  name", "State/Territory", "SA4", "Adjustment", "Level type")])
    labels = t.customer.select((F.col("c_custkey") % 6).alias("k"))
    read = labels.withColumn("r", R.header_role(F.element_at(spelled, (F.col("k") + 1).cast("int"))))
    return read.groupBy("k", F.col("r.role").alias("role"), F.col("r.rank").alias("rank")).agg(F.count(F.lit(1)).alias("n"))


def area_lines(t: Inputs) -> DataFrame:
    named = t.geography.select(
        F.when(F.col("code") == "N3", "").otherwise(F.col("code")).alias("code"),
        F.col("name"),
        F.when(F.col("code") == "N7", "CITY").otherwise(F.col("level")).alias("level"),
        F.when(F.col("code") == "N9", "").otherwise(F.col("parent_code")).alias("parentCode"),
        F.when(F.col("code") != "N11", F.col("has_geometry")).alias("hasGeometry"),
        F.when(F.col("code") == "N13", -1.0).otherwise(F.col("area_sq_km")).alias("areaSqKm"),
    )
    return named.select(F.to_json(F.struct("*")).alias("value"))


@query(
    "a1_area_registry",
    """select case when code = 'N3' then '' else code end as code, name, coalesce(area_sq_km, 0) * case when code = 'N13' then 0 else 1 end as area_sq_km,
    case code when 'N3' then 'code' when 'N7' then 'level' when 'N9' then 'parentCode' when 'N11' then 'hasGeometry' when 'N13' then 'areaSqKm' else '' end as faults from {geography}""",
)
def a1(t: Inputs) -> DataFrame:
    return G.parse_areas(area_lines(t)).select(
        "code", "name", F.greatest(F.coalesce("area_sq_km", F.lit(0.0)), F.lit(0.0)).alias("area_sq_km"), F.array_join("faults", ", ").alias("faults")
    )


def listing_lines(t: Inputs) -> DataFrame:
    """Listings as a provider's feed would send them, some of them faulty."""
    d = F.col("doc_id")
    record = F.struct(
        F.col("source_id").alias("id"),
        F.when(d % 17 == 3, F.lit("")).otherwise(F.concat(F.lit("<b>"), "category_tag", F.lit("</b> &amp; Co&nbsp;"))).alias("title"),
        F.when(d % 19 == 4, F.lit("nowhere")).otherwise(F.concat(F.lit("https://example.com/"), "source_id")).alias("redirect_url"),
        F.col("description").alias("description"),
        F.when(d % 7 == 1, F.lit("last week")).otherwise(F.date_format("posted_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("created"),
        F.struct(F.concat(F.lit(" "), "company_name").alias("display_name")).alias("company"),
        F.struct(F.when(d % 3 == 0, F.col("location_text")).alias("display_name"), F.split("location_text", ", ").alias("area")).alias("location"),
        F.struct(F.col("category_tag").alias("tag")).alias("category"),
        F.col("salary_min"),
        F.col("salary_max"),
        F.when(d % 4 == 0, "1").when(d % 4 == 1, "true").when(d % 4 == 2, "0").alias("salary_is_predicted"),
        F.when(d % 3 == 1, "contract").alias("contract_type"),
        F.when(d % 5 == 2, "full_time").when(d % 5 == 3, "part_time").alias("contract_time"),
    )
    text = F.to_json(record)
    # Every other identifier is a number, every 23rd record is cut short, every 13th has a text where a number belongs.
    numbered = F.when(d % 2 == 0, text).otherwise(F.regexp_replace(text, r'"id":"S(\d+)"', '"id":$1'))
    broken = F.when(d % 23 == 5, F.substring(numbered, 1, 20)).when(
        d % 13 == 6, F.regexp_replace(numbered, r"^\{", '{"latitude":"north",')
    )
    return t.job.select("doc_id", F.coalesce(broken, numbered).alias("value"))


FAULTS = """case when doc_id % 23 = 5 then '(record); id; title; redirect_url' else concat_ws('; ', case when doc_id % 17 = 3 then 'title' end,
    case when doc_id % 19 = 4 then 'redirect_url' end, case when doc_id % 13 = 6 then 'latitude' end) end"""


@query("a4_listing_feed", f"select doc_id, {FAULTS} as faults from {{job}}")
def a4(t: Inputs) -> DataFrame:
    parsed = L.parse_listings(listing_lines(t), keep=("doc_id",))
    return parsed.select("doc_id", F.array_join("faults", "; ").alias("faults"))


SQL_PAID = "doc_id % 4 <> 1 or doc_id % 6 <> 1"


@query(
    "h15_canonical_listings",
    f"""select case when doc_id % 2 = 0 then source_id else cast(doc_id as varchar) end as source_id, trim(category_tag || ' & Co') as title, nullif(trim(regexp_replace(regexp_replace(description, '<[^>]*>', ' ', 'g'), '[\\s\\x{{0b}}\\x{{00a0}}\\x{{feff}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+', ' ', 'g')), '') as description,
    company_name, location_text, case when doc_id % 5 = 2 then 'FULL_TIME' when doc_id % 5 = 3 then 'PART_TIME' when doc_id % 3 = 1 then 'CONTRACT' end as employment_type,
    salary_min, salary_max, case when {SQL_PAID} then 'AUD' end as salary_currency, case when {SQL_PAID} then case when doc_id % 4 in (0, 1) then 'SOURCE_ESTIMATED' else 'REPORTED' end end as salary_basis,
    case when doc_id % 7 <> 1 then strftime(posted_at, '%Y-%m-%d %H:%M:%S') end as posted_at, category_tag as category_label
    from {{job}} where {FAULTS} = ''""",
)
def h15(t: Inputs) -> DataFrame:
    listed = L.canonical_listings(L.accepted(L.parse_listings(listing_lines(t))), "feed", "AU")
    return listed.select(
        "source_id", "title", "description", "company_name", "location_text", "employment_type", "salary_min", "salary_max",
        "salary_currency", "salary_basis", moment("posted_at").alias("posted_at"), "category_label",
    )


def result_pages(t: Inputs) -> DataFrame:
    """Result lists put in front of the driver's own pages."""
    k = F.col("page_id").cast("string")
    item = lambda href, more: F.concat(
        F.lit('<li>\n<h3><A HREF="'), href, F.lit('" onClick="go()">Officer '), k, F.lit(", R&amp;D, Dept of "), k, F.lit("&nbsp;</A>"), F.lit(more), F.lit("</li>")
    )
    full = '<span class="type">Temporary <i>Full-time</i></span></h3><strong class="locality">Gold Coast, Wide Bay ,,Flexible</strong><div class="search-description">Line&ndash;one <br>two</div>'
    first = item(F.concat(F.lit("jncustomsearch.viewFullSingle?in_organid=1&amp;in_jnCounter="), k), full)
    second = item(F.concat(F.lit("/jobs/ref-"), k, F.lit("?x=1")), "")
    listed = F.concat(
        F.lit("<p>1&ndash;2</strong> of <strong> 1,002</strong> matching</p><ol class=\"search-results jobs\">"), first, second,
        F.lit('<li><a href="/about">About</a></li></ol>'), F.col("html"),
    )
    return t.pages.select("page_id", listed.alias("html"))


SITE = "https://portal.example/tools/"


@query(
    "a5_result_pages",
    f"""select page_id, cast(1002 as bigint) as total, cast(page_id as varchar) as reference, 'Officer ' || page_id || ', R&D' as title, 'Dept of ' || page_id as employer, 'Temporary Full-time' as employment_text,
      'Gold Coast|Wide Bay|Flexible' as localities, 'Line–one two' as excerpt, '{SITE}jncustomsearch.viewFullSingle?in_organid=1&in_jnCounter=' || page_id as detail_url, '' as faults from {{pages}} where page_id % 9 <> 4
    union all select page_id, 1002, 'ref-' || page_id, 'Officer ' || page_id || ', R&D', 'Dept of ' || page_id, null, '', null, 'https://portal.example/jobs/ref-' || page_id || '?x=1', '' from {{pages}} where page_id % 9 <> 4
    union all select page_id, null, null, null, null, null, null, null, null, 'no result count' from {{pages}} where page_id % 9 = 4""",
)
def a5(t: Inputs) -> DataFrame:
    # Some pages lack their count: they are faulty rows beside the good pages.
    counted = F.when(F.col("page_id") % 9 == 4, F.replace("html", F.lit("1,002</strong>"), F.lit("some</strong>"))).otherwise(F.col("html"))
    rows = L.parse_result_pages(result_pages(t).withColumn("html", counted), SITE)
    return rows.withColumn("localities", F.array_join("localities", "|")).withColumn("faults", F.array_join("faults", ", "))


def detail_pages(t: Inputs) -> DataFrame:
    """Detail pages: the driver's pages with a data block and labelled text, faulty by page number."""
    n = F.col("page_id")
    k = n.cast("string")
    kinds = F.when(n % 2 == 0, F.lit('["Full","CONTRACTOR"]')).otherwise(F.lit('"part_time"'))
    block = F.concat(
        F.lit('<script type="application/ld+json">{"title":" Title '), k, F.lit('","description":"'), F.regexp_replace("url", '[\\\\"]', ""),
        F.lit('","datePosted":"2001-02-'), F.lpad((n % 28 + 1).cast("string"), 2, "0"), F.lit('","employmentType":'), kinds,
        F.lit(',"hiringOrganization":{"name":"Org"},"identifier":{"value":"'), F.when(n % 11 == 3, "").otherwise(k), F.lit('"}'),
        F.when(n % 13 == 4, "").otherwise("}"), F.lit("</script>"),
    )
    meta = F.lit('<meta name="DCTERMS.license" scheme="URI" content="CC&nbsp;BY">')
    place = F.lit("<p>Workplace <b>Location</b> Cairns, Wide Bay </p><p>Closing date 1 May</p>")
    html = F.concat(meta, F.when(n % 7 == 2, "").otherwise(block), F.when(n % 5 == 1, "").otherwise(place), F.lit("<p>end</p>"))
    return t.pages.select("page_id", html.alias("html"))


@query(
    "a6_detail_pages",
    """select page_id, case when not broken and page_id % 11 <> 3 then cast(page_id as varchar) end as reference, case when not broken then 'Title ' || page_id end as title,
      case when not broken then regexp_replace(url, '[\\\\"]', '', 'g') end as description, case when broken then '' when page_id % 2 = 0 then 'Full|CONTRACTOR' else 'part_time' end as employment_types,
      case when page_id % 5 = 1 then '' else 'Cairns|Wide Bay' end as localities, 'CC BY' as licence, faults from (select *, page_id % 7 = 2 or page_id % 13 = 4 as broken,
      case when page_id % 7 = 2 then 'no data block' when page_id % 13 = 4 then 'unreadable data block, no identifier, no title' when page_id % 11 = 3 then 'no identifier' else '' end as faults from {pages}) p""",
)
def a6(t: Inputs) -> DataFrame:
    details = L.parse_detail_pages(detail_pages(t))
    return details.select(
        "page_id", "reference", "title", "description", F.array_join("employment_types", "|").alias("employment_types"),
        F.array_join("localities", "|").alias("localities"), "licence", F.array_join("faults", ", ").alias("faults"),
    )


@query(
    "h15_page_listings",
    """select cast(page_id as varchar) as source_id, 'Org' as company_name, case when page_id % 5 = 1 then 'Gold Coast, Wide Bay, Flexible' else 'Cairns, Wide Bay' end as location_text,
    case when page_id % 2 = 0 then 'CONTRACT' else 'PART_TIME' end as employment_type, '2001-02-' || lpad(cast(page_id % 28 + 1 as varchar), 2, '0') || ' 00:00:00' as posted_at
    from {pages} where page_id % 7 <> 2 and page_id % 13 <> 4 and page_id % 11 <> 3""",
)
def h15_pages(t: Inputs) -> DataFrame:
    rows = L.parse_result_pages(result_pages(t), SITE)
    listed = L.listings_from_details(rows, L.parse_detail_pages(detail_pages(t)), "portal", "Queensland")
    return listed.select("source_id", "company_name", "location_text", "employment_type", moment("posted_at").alias("posted_at"))


@query("a7_allocation_columns", "select cast(unit as varchar) as unit, area_code as area, coalesce(state_code, '') as state from {unit_area}")
def a7(t: Inputs) -> DataFrame:
    needed = {"unit": "unit", "area_code": "area", "state_code": "state"}
    return G.required_columns(t.unit_area, needed).fillna("", ["state"])


@query(
    "a8_feature_registry",
    """select 'N' || n_nationkey as code, n_name as name, 'SA4' as level, case when n_nationkey % 4 <> 0 then 'R' || n_regionkey end as parent_code, n_nationkey % 6 <> 0 as has_geometry,
    case when n_nationkey % 5 <> 0 then cast(n_nationkey + 0.5 as double) end as area_sq_km, case when n_nationkey % 3 = 1 then 'New' end as change_label from {nation}""",
)
def a8(t: Inputs) -> DataFrame:
    k = F.col("n_nationkey")
    properties = F.struct(
        F.concat(F.lit(" N"), k.cast("string")).alias("CODE"),
        F.concat("n_name", F.lit("  ")).alias("NAME"),
        F.when(k % 4 == 0, " ").otherwise(F.concat(F.lit("R"), F.col("n_regionkey").cast("string"))).alias("UP"),
        F.when(k % 5 == 0, "n/a").otherwise((k + 0.5).cast("string")).alias("AREA"),
        F.when(k % 3 == 1, " New ").when(k % 3 == 2, "").alias("CHANGE"),
    )
    shape = F.when(k % 6 != 0, F.struct(F.lit("Polygon").alias("type")))
    feature = F.struct(F.lit("Feature").alias("type"), shape.alias("geometry"), properties.alias("properties"))
    features = G.parse_features(t.nation.select(F.to_json(feature).alias("value")))
    return G.feature_areas(features, "SA4", "CODE", "NAME", "UP", "AREA", "CHANGE")


@query("a9_verdict_artefact", "select 'LIN' as instrument, code, 'name of ' || code as name, cast(null as varchar) as state_code, status, length(code) as distinct_postcodes from {area_verdict}")
def a9(t: Inputs) -> DataFrame:
    # One artefact per verdict, so no document has to hold all areas.
    area = F.struct(
        F.col("code"), F.concat(F.lit("name of "), "code").alias("name"), F.lit(None).cast("string").alias("stateCode"), "status", F.length("code").alias("distinctPostcodes")
    )
    artefact = F.struct(F.struct(F.lit("LIN").alias("id"), F.lit("F1").alias("registerId")).alias("instrument"), F.array(area).alias("areas"))
    return G.parse_verdicts(t.area_verdict.select(F.to_json(artefact).alias("value")))


ABOUT = K.Provenance(
    "Advertisements, by group", "The publisher", DATASET, "2001-11", "CC BY 4.0", "https://licence.example/by", 'The "source"', "Summed", "feed", "2001-08-01T00:00:00.000Z"
)
STATE_COLUMNS = {
    "state_code": "State code", "name": "State, name", "total": "Advertisements", "previous_total": "Advertisements, previous period", "regions_reporting": "Regions reporting",
}
GROUP_COLUMNS = {"code": "Code", "name": "Group", "total": "Advertisements", "previous_total": "Advertisements, previous period", "is_leaf": "Finest grain"}
HEADER_SQL = " union all ".join(f"select '{line.replace(chr(39), chr(39) * 2)}' as line" for line in K.header_lines(ABOUT))
WHOLE = "coalesce(cast(cast({0} as bigint) as varchar), '')"


STATE_SQL = f"""select state_code, g.name, total, previous_total, regions_reporting from ({occupation_sql('state_code')}) o join {{geography}} g on g.code = o.state_code and g.level = 'STATE' where o.code = '0'"""


@query(
    "a10_csv_by_state",
    f"""{HEADER_SQL} union all select 'State code,"State, name",Advertisements,"Advertisements, previous period",Regions reporting'
    union all select state_code || ',' || name || ',' || {WHOLE.format('total')} || ',' || {WHOLE.format('previous_total')} || ',' || regions_reporting from ({STATE_SQL}) s""",
)
def a10(t: Inputs) -> DataFrame:
    order = [-F.coalesce("total", F.lit(0.0)), F.col("state_code")]
    return K.csv_lines(state_table(t), STATE_COLUMNS, ABOUT, order).sort("part", "seat", "place").select("line")


@query(
    "a11_json_by_state",
    f"""select '{{"state_code":"' || state_code || '","name":"' || name || '","total":' || coalesce(cast(total as varchar), 'null') || ',"previous_total":' || coalesce(cast(previous_total as varchar), 'null') || ',"regions_reporting":' || regions_reporting || '}}' as line from ({STATE_SQL}) s""",
)
def a11(t: Inputs) -> DataFrame:
    order = [-F.coalesce("total", F.lit(0.0)), F.col("state_code")]
    lines = K.json_lines(state_table(t), STATE_COLUMNS, ABOUT, order)
    return lines.filter("part = 1").select(F.ltrim("line", F.lit(",")).alias("line"))


@query(
    "a14_dataset_by_occupation",
    f"""with codes as ({occupation_sql()}) {HEADER_SQL} union all select 'Code,Group,Advertisements,"Advertisements, previous period",Finest grain'
    union all select code || ',' || coalesce(name, '') || ',' || {WHOLE.format('total')} || ',' || {WHOLE.format('previous_total')} || ',' || cast({LEAF} as varchar) from codes c where code <> '0'""",
)
def a14(t: Inputs) -> DataFrame:
    permitted = T.require_aggregable(t.source_registry, "src0").scalar()
    return K.csv_lines(occupation_table(t).filter(permitted == "src0"), GROUP_COLUMNS, ABOUT, [F.col("code")]).sort("part", "seat", "place").select("line")


RETAINED = f"select * from ({RANKED}) f where rn = 1 and period_start in (select distinct period_start from {{metric}} order by 1 desc limit 24)"
STORED = "select 'feed|advertisement-index|online-advertisements|month|g:n.' || lower(split_part(series_key, '|', 1)) || '|o:c.' || split_part(series_key, '|', 2) || '|adjustment.original' as series_key, period_start, value * 1000 as value from {stored_metric}"


def stored_observations(t: Inputs) -> DataFrame:
    parts = F.split("series_key", r"\|")
    key = F.concat(F.lit("feed|advertisement-index|online-advertisements|month|g:n."), F.lower(parts[0]), F.lit("|o:c."), parts[1], F.lit("|adjustment.original"))
    return t.stored_metric.select(key.alias("series_key"), "period_start", (F.col("value") * 1000).alias("value"), "value_state")


def release_import(t: Inputs, **rest) -> I.ReleaseImport:
    return I.import_release(sheets(t), stored_observations(t), t.geography, t.occupation, FEED, DATASET, MEASURE, UNIT, 24, **rest)


G22 = f"""with n as (select (select count(*) from ({RANKED}) a where rn = 1) as seen,
      (select count(*) from ({READ}) b where value_state is null) + (select count(*) from ({RANKED}) c where rn > 1 and (value_state <> first_state or value is distinct from first_value)) + (select count(*) from {{region}}) as problems,
      (select count(*) from ({RANKED}) d where rn > 1 and value_state = first_state and value is not distinct from first_value) as dropped,
      (select count(*) from ({RETAINED}) e) as kept, (select count(*) from ({RETAINED}) f join ({STORED}) s on s.series_key = f.series_key and s.period_start = f.period_start where f.value_state = 'PRESENT' and f.value = s.value) as same)
    select seen + problems as records_seen, kept - same as records_written, same + dropped as records_skipped, problems as records_quarantined, case when problems / (seen + problems) > 0.05 then 'FAILED' else 'COMPLETED' end as status from n"""


@query("g22_release_import", G22)
def g22(t: Inputs) -> DataFrame:
    return release_import(t).counts.select("records_seen", "records_written", "records_skipped", "records_quarantined", "status")


@query(
    "g22_published_observations",
    f"""with c as (
    {G22}), r as ({RETAINED}),
    s as (select k.series_key, k.period_start, m.value_state, k.value from ({STORED}) k join {{stored_metric}} m
      on k.series_key = 'feed|advertisement-index|online-advertisements|month|g:n.' || lower(split_part(m.series_key, '|', 1)) || '|o:c.' || split_part(m.series_key, '|', 2) || '|adjustment.original' and k.period_start = m.period_start),
    u as (select series_key, period_start, value_state, value from r union all select * from s where not exists (select 1 from r where r.series_key = s.series_key and r.period_start = s.period_start)),
    p as (select * from u where period_start in (select distinct period_start from u order by 1 desc limit 24) and (select status from c) = 'COMPLETED'
      union all select * from s where (select status from c) <> 'COMPLETED')
    select series_key, strftime(period_start, '%Y-%m-%d') as period, value_state, value from p""",
)
def g22_published(t: Inputs) -> DataFrame:
    return release_import(t).observations.select("series_key", F.date_format("period_start", "yyyy-MM-dd").alias("period"), "value_state", "value")


@query(
    "g22_ledger",
    f"""with c as (
    {G22})
    select '{FEED}' as source_key, '{DATASET}' as dataset, *, 'sum-2' as checksum from c""",
)
def g22_ledger(t: Inputs) -> DataFrame:
    runs = t.region.select(
        F.lit(FEED).alias("source_key"), F.lit(DATASET).alias("dataset"), F.concat(F.lit("sum-"), "r_regionkey").alias("checksum"),
        F.when(F.col("r_regionkey") == 2, "FAILED").otherwise("COMPLETED").alias("status"),
    )
    return release_import(t, runs=runs, checksum="sum-2").ledger.drop("started_at", "finished_at")


@query(
    "g22_imported_series",
    """select 'feed|advertisement-index|online-advertisements|month|g:n.' || lower(geo_code) || '|o:c.' || occ_code || '|adjustment.original' as series_key, 'UNRESOLVED' as geography_resolution,
    case when occ_code = '0' then 'UNRESOLVED' when cast(occ_code as int) % 5 = 0 then 'AMBIGUOUS' else 'RESOLVED' end as occupation_resolution from {series}""",
)
def g22_series(t: Inputs) -> DataFrame:
    return release_import(t).series.select("series_key", "geography_resolution", "occupation_resolution")


@query(
    "g23_listing_import",
    f"""with p as (select doc_id, {FAULTS} as f from {{job}})
    select count(*) as records_seen, count(*) filter (where f = '') as records_written, cast(0 as bigint) as records_skipped, count(*) filter (where f <> '') as records_quarantined from p""",
)
def g23(t: Inputs) -> DataFrame:
    return listing_import(t).counts


# The dimension before the run: every other nation's text, those of the first regions without an area.
STORED_LOCATION = """select concat(n_name, ', ', r_name) as raw_text, n_name as country_name, r_name as state_name,
    case when r_regionkey < 2 then cast(null as string) else concat('R', cast(r_regionkey as string)) end as geo_code
    from {nation} join {region} on n_regionkey = r_regionkey where n_nationkey % 2 = 0"""


def listing_import(t: Inputs) -> I.ListingImport:
    lines = listing_lines(t)
    none = F.lit(None)
    stored = t.stored_listing.select(
        "*", *[none.cast("string").alias(c) for c in I.HASHED if c not in t.stored_listing.columns]
    )
    companies = t.customer.filter("c_mktsegment = 'BUILDING'").select(F.lower("c_name").alias("company_key"))
    locations = t.sql(STORED_LOCATION).select(
        dash_key(F.col("raw_text")).alias("location_key"), "raw_text", "country_name", "state_name", none.cast("string").alias("state_code"),
        none.cast("double").alias("latitude"), none.cast("double").alias("longitude"), "geo_code",
    )
    registry = t.source_registry.select(F.lit("feed").alias("source_key"), F.lit("ACTIVE").alias("activation"), F.lit("VERIFIED").alias("compliance_status"))
    return I.import_listings(lines, stored, companies, locations, t.geography, registry, "feed", "au", NOW, 14, ["doc_id"])


@query(
    "g23_locations",
    f"""with named as (select distinct location_text as raw_text from {{job}} where {FAULTS} = '' and location_text is not null),
    every as (select raw_text, split_part(raw_text, ', ', 2) as state_name, 'N' as stored, cast(null as varchar) as geo_code from named where raw_text not in (select raw_text from ({STORED_LOCATION}) s)
      union all select raw_text, state_name, 'Y', geo_code from ({STORED_LOCATION}) o)
    select raw_text, state_name, coalesce(geo_code, (select min(code) from {{geography}} g where g.level = 'STATE' and g.name = state_name)) as geo_code from every""",
)
def g23_locations(t: Inputs) -> DataFrame:
    return listing_import(t).locations.select("raw_text", "state_name", "geo_code")


@query(
    "g23_ledger",
    f"""select 'feed' as source_key, 'listings' as dataset, 'COMPLETED' as status, count(*) as records_seen, count(*) filter (where {FAULTS} = '') as records_written,
    cast(0 as bigint) as records_skipped, count(*) filter (where {FAULTS} <> '') as records_quarantined from {{job}}""",
)
def g23_ledger(t: Inputs) -> DataFrame:
    return listing_import(t).ledger.drop("started_at", "finished_at")


@query(
    "g23_listing_snapshot",
    f"""select 'feed' as source_key, 'CREATED' as action, 'ACTIVE' as status, count(*) as n from {{job}} where {FAULTS} = ''
    union all select source_key, 'KEPT', status, count(*) from {{stored_listing}} group by 1, 3""",
)
def g23_snapshot(t: Inputs) -> DataFrame:
    return listing_import(t).listings.groupBy("source_key", "action", "status").agg(F.count(F.lit(1)).alias("n"))
