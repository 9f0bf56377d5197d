"""Indicator-series queries over monthly counts derived from the line items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from advertide.functions import periods as P
from advertide.functions.text import area_slug
from advertide.operators import totals as T
from advertide.plans.inputs import DATASET, EDITION, LEVELS, SOURCE, TOTAL_CODE, Inputs
from advertide.plans.registry import query

SCOPE = T.Scope(SOURCE, DATASET, EDITION, LEVELS)
STATE_A, STATE_B = "R1", "R2"
OCCUPATION = "7"
FLOOR = 1.0


def scope(**changes) -> T.Scope:
    return T.Scope(**{**SCOPE.__dict__, **changes})


def day(column):
    return F.date_format(column, "yyyy-MM-dd")


def occupations(t: Inputs, **changes) -> DataFrame:
    return T.occupation_totals(t.series, t.metric, t.geography, scope(**changes))


def states(t: Inputs) -> DataFrame:
    return T.occupation_totals(t.series, t.metric, t.geography, SCOPE, by_state=True)


def cube(t: Inputs) -> DataFrame:
    return T.occupation_cube(t.series, t.metric, t.geography, SCOPE, TOTAL_CODE)


def regions(t: Inputs, occupation: str = OCCUPATION) -> DataFrame:
    return T.region_totals(t.series, t.metric, t.geography, scope(occupation=occupation))


# SQL of the shared steps, for the oracle texts below.
AREAS = "select code as geo_code, name as geo_name, level, parent_code as state_code from {geography} where edition = 'E1' and level in ('GCCSA', 'SA4')"
SCOPED = f"select s.series_key, s.occ_code, s.occ_name, a.* from {{series}} s join ({AREAS}) a on a.geo_code = s.geo_code"


def pair_sql(condition: str = "true") -> str:
    found = f"select distinct period_start from {{metric}} m join ({SCOPED}) x on x.series_key = m.series_key where {condition}"
    return f"""select max(period_start) as latest,
       (select max(period_start) from ({found}) u where period_start < (select max(period_start) from ({found}) v)) as previous
from ({found}) w"""


def region_sql(occupation: str = OCCUPATION) -> str:
    condition = f"x.occ_code = '{occupation}'"
    return f"""select x.geo_code as code, x.geo_name as name, x.level, x.state_code, x.occ_code,
    l.value as latest_value, l.value_state as latest_state, p.value as previous_value, p.value_state as previous_state
from ({SCOPED}) x
left join {{metric}} l on l.series_key = x.series_key and l.period_start = (select latest from ({pair_sql(condition)}) q)
left join {{metric}} p on p.series_key = x.series_key and p.period_start = (select previous from ({pair_sql(condition)}) q)
where {condition}"""


def occupation_sql(by: str = "", where: str = "true") -> str:
    keys = f"{by}, x.occ_code" if by else "x.occ_code"
    return f"""select {by + ',' if by else ''} x.occ_code as code,
    case when count(distinct occ_name) = 1 then min(occ_name) end as name,
    sum(case when m.period_start = pr.latest then m.value end) as total,
    sum(case when m.period_start = pr.previous then m.value end) as previous_total,
    count(distinct case when m.period_start = pr.latest and m.value is not null then x.geo_code end) as regions_reporting
from ({SCOPED}) x
cross join ({pair_sql()}) pr
left join {{metric}} m on m.series_key = x.series_key and m.period_start in (pr.latest, pr.previous)
where x.occ_code is not null and x.occ_code <> '' and {where}
group by {keys}"""


LEAF = "not exists (select 1 from codes o where o.code <> c.code and o.code like c.code || '%')"
DIRECTION = "case when latest_value - previous_value > 0 then 'UP' when latest_value - previous_value < 0 then 'DOWN' when latest_value - previous_value = 0 then 'FLAT' end"


@query(
    "c1_region_totals",
    f"""select code, name, level, state_code, latest_value, latest_state, previous_value, previous_state,
    latest_value - previous_value as change, round((latest_value - previous_value) / nullif(previous_value, 0) * 100, 6) as change_percent,
    {DIRECTION} as direction from ({region_sql()}) r""",
)
def c1(t: Inputs) -> DataFrame:
    return regions(t).select(
        "code", "name", "level", "state_code", "latest_value", "latest_state", "previous_value", "previous_state",
        F.col("change.absolute").alias("change"),
        F.round("change.percent", 6).alias("change_percent"),
        F.col("change.direction").alias("direction"),
    )


@query("c2_regions_without_data", f"select code, name, level, state_code from ({region_sql('9')}) r where latest_state is null")
def c2(t: Inputs) -> DataFrame:
    return T.without_data(regions(t, "9")).select("code", "name", "level", "state_code")


@query("c2_regions_reporting", f"select code, latest_state, latest_value from ({region_sql('9')}) r where latest_state is not null")
def c2_reporting(t: Inputs) -> DataFrame:
    return T.reporting(regions(t, "9")).select("code", "latest_state", "latest_value")


@query(
    "d1_occupation_totals",
    f"""select o.*, (select count(distinct geo_code) from ({SCOPED}) z) as regions_in_scope from ({occupation_sql()}) o""",
)
def d1(t: Inputs) -> DataFrame:
    return occupations(t)


@query(
    "d1_occupation_totals_in_state",
    f"""select o.*, (select count(distinct geo_code) from ({SCOPED}) z where state_code = 'R1') as regions_in_scope
    from ({occupation_sql(where="x.state_code = 'R1'")}) o""",
)
def d1_state(t: Inputs) -> DataFrame:
    return occupations(t, state=STATE_A)


@query(
    "d2_occupation_options",
    """select occ_code as code, case when count(distinct nullif(occ_name, '')) = 1 then min(nullif(occ_name, '')) end as name
    from {series} where source_key = 'feed' and dataset = 'Advertisement index' and occ_code is not null and occ_code <> ''
    group by occ_code""",
)
def d2(t: Inputs) -> DataFrame:
    return T.occupation_options(t.series, SOURCE, DATASET)


@query("d3_regions_in_scope", f"select count(distinct geo_code) as regions_in_scope from ({SCOPED}) x")
def d3(t: Inputs) -> DataFrame:
    return T.scoped_series(t.series, t.geography, SCOPE).agg(F.count_distinct("geo_code").alias("regions_in_scope"))


@query(
    "d4_series_and_area_counts",
    """select 'series' as counted, source_key as of, count(*) as n from {series} group by source_key
    union all select 'area', edition, count(*) from {geography} group by edition""",
)
def d4(t: Inputs) -> DataFrame:
    def counted(df, what, by):
        return df.groupBy(F.col(by).alias("of")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("counted"), "of", "n")

    return counted(t.series, "series", "source_key").unionByName(counted(t.geography, "area", "edition"))


@query(
    "d9_state_rollup",
    f"""select state_code, sum(latest_value) as total, sum(previous_value) as previous_total,
    count(latest_value) as regions_reporting, count(*) as regions_in_scope
    from ({region_sql()}) r where state_code is not null group by state_code""",
)
def d9(t: Inputs) -> DataFrame:
    return T.state_rollup(regions(t))


@query(
    "d10_state_table",
    f"""select o.state_code, g.name, total, previous_total, regions_reporting, z.n as regions_in_scope,
    total - previous_total as change, round((total - previous_total) / nullif(previous_total, 0) * 100, 6) as change_percent
    from ({occupation_sql('state_code')}) o
    join (select state_code, count(distinct geo_code) as n from ({SCOPED}) s group by 1) z on z.state_code = o.state_code
    join {{geography}} g on g.code = o.state_code and g.level = 'STATE' where o.code = '0'""",
)
def d10(t: Inputs) -> DataFrame:
    return state_table(t)


def state_table(t: Inputs) -> DataFrame:
    names = t.geography.filter("level = 'STATE'").select(F.col("code").alias("state_code"), F.col("name"))
    change = P.change_struct(F.col("total"), F.col("previous_total"))
    return (
        states(t)
        .filter(F.col("code") == TOTAL_CODE)
        .drop("name", "code")
        .join(names, "state_code")
        .select(
            "state_code", "name", "total", "previous_total", "regions_reporting", "regions_in_scope",
            change["absolute"].alias("change"), F.round(change["percent"], 6).alias("change_percent"),
        )
    )


@query(
    "d11_occupation_table",
    f"""with codes as ({occupation_sql()})
    select code, name, total, previous_total, {LEAF} as is_leaf from codes c where code <> '0'""",
)
def d11(t: Inputs) -> DataFrame:
    return occupation_table(t)


def occupation_table(t: Inputs) -> DataFrame:
    flagged = occupations(t).withColumn("is_leaf", T.finest("code")).filter(F.col("code") != TOTAL_CODE)
    return flagged.select("code", "name", "total", "previous_total", "is_leaf")


LOCATION_QUOTIENT = f"""with codes as ({occupation_sql()}), st as ({occupation_sql('state_code')})
    select s.state_code, s.code, s.total, case when s.total >= 1 and b.total > 0 and n.total > 0 and c.total > 0
        then round((s.total / b.total) / (c.total / n.total), 6) end as quotient
    from st s join codes c on c.code = s.code
    join (select state_code, total from st where code = '0') b on b.state_code = s.state_code
    cross join (select total from codes where code = '0') n where s.code <> '0'"""


@query("d12_location_quotient", LOCATION_QUOTIENT)
def d12(t: Inputs) -> DataFrame:
    return T.location_quotients(cube(t), TOTAL_CODE).select(
        "state_code", "code", "total",
        F.when(F.col("total") >= FLOOR, F.round("quotient", 6)).alias("quotient"),
    )


@query(
    "d13_mix_divergence",
    f"""with codes as ({occupation_sql()}),
    a as ({occupation_sql(where="x.state_code = 'R1'")}), b as ({occupation_sql(where="x.state_code = 'R2'")})
    select c.code, a.total as a_value, b.total as b_value, round(a.total / ta.total * 100, 6) as a_share,
      round(b.total / tb.total * 100, 6) as b_share, round(a.total / ta.total * 100 - b.total / tb.total * 100, 6) as gap
    from codes c join a on a.code = c.code join b on b.code = c.code
    cross join (select total from a where code = '0') ta cross join (select total from b where code = '0') tb
    where c.code <> '0' and a.total is not null and b.total is not null and (a.total >= 1 or b.total >= 1) and {LEAF}
    order by abs(a.total / ta.total * 100 - b.total / tb.total * 100) desc, c.code limit 6""",
)
def d13(t: Inputs) -> DataFrame:
    pairs = T.divergence(cube(t), STATE_A, STATE_B, TOTAL_CODE, FLOOR)
    top = pairs.orderBy(F.desc(F.abs("gap")), "code").limit(6)
    return top.select(
        "code", "a_value", "b_value", F.round("a_share", 6).alias("a_share"),
        F.round("b_share", 6).alias("b_share"), F.round("gap", 6).alias("gap"),
    )


@query(
    "d14_shares",
    f"""with codes as ({occupation_sql()}), st as ({occupation_sql('state_code')})
    select s.state_code, s.code, round(s.total / nullif(c.total, 0) * 100, 6) as share_of_occupation,
      round(s.total / nullif(b.total, 0) * 100, 6) as share_of_place, round(s.total / nullif(n.total, 0) * 100, 6) as share_of_national
    from st s join codes c on c.code = s.code
    left join (select state_code, total from st where code = '0') b on b.state_code = s.state_code
    cross join (select max(total) as total from codes where code = '0') n where s.code <> '0'""",
)
def d14(t: Inputs) -> DataFrame:
    local = cube(t).filter(~F.col("national") & (F.col("code") != TOTAL_CODE))
    return local.select(
        "state_code", "code",
        F.round(T.share(F.col("total"), F.col("national_value")), 6).alias("share_of_occupation"),
        F.round(T.share(F.col("total"), F.col("place_total")), 6).alias("share_of_place"),
        F.round(T.share(F.col("total"), F.col("national_total")), 6).alias("share_of_national"),
    )


BANDS = """(select step, low, high, max(high) over (order by step rows between unbounded preceding and 1 preceding) as reached
    from (select step, max(case when i = floor(step * (n / 5)) then value end) as low,
            max(case when i = least(n - 1, ceil((step + 1) * (n / 5)) - 1) then value end) as high
          from (select value, row_number() over (order by value) - 1 as i, count(*) over () as n from {metric} where value is not null) v
          cross join (select unnest([0, 1, 2, 3, 4]) as step) s
          group by step) p)"""


@query(
    "d19_quantile_bands",
    f"select row_number() over (order by step) - 1 as band, low, high from {BANDS} b where reached is null or high > reached",
)
def d19(t: Inputs) -> DataFrame:
    return T.quantile_bands(t.metric, "value", 5).select(F.col("band").cast("bigint"), "low", "high")


@query(
    "d19_band_assignment",
    f"""with bands as (select row_number() over (order by step) - 1 as band, high from {BANDS} b where reached is null or high > reached)
    select r.code, r.latest_value, case when r.latest_value is not null then
      least((select count(*) from bands where high < r.latest_value), (select count(*) - 1 from bands)) end as band
    from ({region_sql('0')}) r""",
)
def d19_assign(t: Inputs) -> DataFrame:
    bands = T.quantile_bands(t.metric, "value", 5)
    placed = T.assign_bands(regions(t, "0"), "latest_value", bands)
    return placed.select("code", "latest_value", F.col("band").cast("bigint"))


CHANGED = "select *, lag(value) over (partition by series_key order by period_start) as before_value from {metric}"


@query(
    "d20_area_summary",
    f"""select s.geo_code, s.measure, s.basis, strftime(m.period_start, '%Y-%m-%d') as period, s.occ_code, m.value, m.value_state,
    m.value - before_value as change, round((m.value - before_value) / nullif(before_value, 0) * 100, 6) as change_percent,
    case when m.value is not null then rank() over (partition by s.measure, s.basis, m.period_start, s.occ_code order by m.value desc nulls last) end as position,
    count(m.value) over (partition by s.measure, s.basis, m.period_start, s.occ_code) as sample_size
    from ({CHANGED}) m join {{series}} s on s.series_key = m.series_key""",
)
def d20(t: Inputs) -> DataFrame:
    return T.area_summary(t.series, t.metric).select(
        "geo_code", "measure", "basis", day("period_start").alias("period"), "occ_code", "value", "value_state",
        "change", F.round("change_percent", 6).alias("change_percent"),
        F.col("position").cast("bigint").alias("position"), "sample_size",
    )


@query(
    "d23_two_occupations_by_state",
    """with v as (select g.parent_code as state_code, m.occ_code, sum(m.value) as v from {metric} m
      join {geography} g on g.code = m.geo_code where m.occ_code in ('7', '12') and m.period_start = (select max(period_start) from {metric})
      group by 1, 2)
    select state_code, max(case when occ_code = '7' then v end) as a, max(case when occ_code = '12' then v end) as b
    from v where v is not null group by state_code""",
)
def d23(t: Inputs) -> DataFrame:
    newest = t.metric.agg(F.max("period_start").alias("p")).scalar()
    areas = t.geography.select(F.col("code").alias("geo_code"), F.col("parent_code").alias("state_code"))
    current = t.metric.filter((F.col("period_start") == newest) & F.col("occ_code").isin("7", "12"))
    pivoted = current.join(areas, "geo_code").groupBy("state_code").pivot("occ_code", ["7", "12"]).agg(F.sum("value"))
    sized = F.coalesce("a", F.lit(0.0)) + F.coalesce("b", F.lit(0.0))
    return (
        pivoted.select("state_code", F.col("7").alias("a"), F.col("12").alias("b"))
        .filter(F.col("a").isNotNull() | F.col("b").isNotNull())
        .orderBy(sized.desc(), "state_code")
    )


@query(
    "e1_two_latest_periods",
    "select strftime(period_start, '%Y-%m-%d') as period from (select distinct period_start from {metric} order by 1 desc limit 2) p",
)
def e1(t: Inputs) -> DataFrame:
    return T.two_latest(t.metric).select(day("period_start").alias("period"))


@query(
    "e2_period_change",
    f"""select series_key, strftime(period_start, '%Y-%m-%d') as period, value - before_value as absolute,
    round((value - before_value) / nullif(before_value, 0) * 100, 6) as percent,
    case when value - before_value > 0 then 'UP' when value - before_value < 0 then 'DOWN' when value - before_value = 0 then 'FLAT' end as direction
    from ({CHANGED}) c""",
)
def e2(t: Inputs) -> DataFrame:
    return T.with_change(t.metric).select(
        "series_key", day("period_start").alias("period"), "change.absolute",
        F.round("change.percent", 6).alias("percent"), "change.direction",
    )


@query(
    "e3_recent_periods",
    """select series_key, strftime(period_start, '%Y-%m-%d') as period, value from {metric}
    where period_start in (select distinct period_start from {metric} order by 1 desc limit 13)""",
)
def e3(t: Inputs) -> DataFrame:
    return T.keep_recent(t.metric, 13).select("series_key", day("period_start").alias("period"), "value")


@query(
    "e6_movers",
    f"""with codes as ({occupation_sql()}),
    moved as (select code, total - previous_total as absolute, case when previous_total >= 20 then round((total - previous_total) / previous_total * 100, 6) end as percent
      from codes c where code <> '0' and total is not null and previous_total is not null and {LEAF})
    select * from (select 'RISER' as side, * from moved where absolute > 0 order by absolute desc, code limit 5)
    union all select * from (select 'FALLER' as side, * from moved where absolute < 0 order by absolute, code limit 5)""",
)
def e6(t: Inputs) -> DataFrame:
    published = occupations(t).filter(F.col("code") != TOTAL_CODE)
    finest = published.withColumn("is_leaf", T.finest("code")).filter("is_leaf")
    return T.movers(finest, 5, 20.0).select("side", "code", "absolute", F.round("percent", 6).alias("percent"))


@query(
    "e7_position_in_ranking",
    f"""with k as (select code, row_number() over (order by latest_value desc, code) as pos from ({region_sql('0')}) r where latest_value is not null)
    select 'N4' as code, (select pos from k where code = 'N4') as position, (select count(*) from k) as of""",
)
def e7(t: Inputs) -> DataFrame:
    return T.position_of(regions(t, "0"), "code", "N4", "latest_value")


@query(
    "e8_share_of_maximum",
    f"select code, latest_value, round(latest_value / max(latest_value) over (), 6) as of_maximum from ({region_sql('0')}) r",
)
def e8(t: Inputs) -> DataFrame:
    return T.with_share_of_maximum(regions(t, "0"), "latest_value").select(
        "code", "latest_value", F.round("of_maximum", 6).alias("of_maximum")
    )


@query(
    "e9_state_specialisms",
    f"""with codes as ({occupation_sql()}), st as ({occupation_sql('state_code')}),
    q as (select s.state_code, b.total as state_total, s.code, s.total as value, (s.total / b.total) / (c.total / n.total) as quotient
      from st s join codes c on c.code = s.code
      join (select state_code, total from st where code = '0') b on b.state_code = s.state_code
      cross join (select total from codes where code = '0') n
      where s.code <> '0' and s.total >= 1 and b.total > 0 and c.total > 0 and {LEAF})
    select state_code, state_total, code, value, round(quotient, 6) as quotient, place from (
      select *, row_number() over (partition by state_code order by quotient desc, code) as place from q where quotient > 1) r
    where place <= 4""",
)
def e9(t: Inputs) -> DataFrame:
    best = T.specialisms(cube(t), TOTAL_CODE, FLOOR, 4)
    return best.select(
        "state_code", F.col("place_total").alias("state_total"), "code", F.col("total").alias("value"), F.round("quotient", 6).alias("quotient"),
        F.col("place").cast("bigint").alias("place"),
    ).orderBy(F.desc("state_total"), "state_code", "place")


@query(
    "e12_busiest_and_most_concentrated",
    f"""with r as ({region_sql('0')}), codes as ({occupation_sql()}), st as ({occupation_sql('state_code')}),
    q as (select s.state_code, (s.total / b.total) / (c.total / n.total) as quotient
      from st s join codes c on c.code = s.code join (select state_code, total from st where code = '0') b on b.state_code = s.state_code
      cross join (select total from codes where code = '0') n where s.code = '7' and s.total >= 1 and c.total > 0)
    select (select code from r where latest_value is not null order by latest_value desc, code limit 1) as busiest,
      (select state_code from q order by quotient desc, state_code limit 1) as most_concentrated""",
)
def e12(t: Inputs) -> DataFrame:
    # The greatest value first, then the least code: a maximum over (value, code reversed) is a minimum of (-value, code).
    busiest = (
        regions(t, "0")
        .filter(F.col("latest_value").isNotNull())
        .agg(F.min(F.struct(-F.col("latest_value"), F.col("code")))["code"].alias("code"))
        .scalar()
    )
    scored = T.location_quotients(cube(t), TOTAL_CODE).filter(
        (F.col("code") == OCCUPATION) & (F.col("total") >= FLOOR) & F.col("quotient").isNotNull()
    )
    return scored.agg(F.min(F.struct(-F.col("quotient"), F.col("state_code")))["state_code"].alias("most_concentrated")).select(
        busiest.alias("busiest"), "most_concentrated"
    )


@query(
    "f2_region_table_order",
    f"select code, name, latest_value from ({region_sql()}) r order by latest_value desc nulls last, name",
)
def f2(t: Inputs) -> DataFrame:
    return regions(t).select("code", "name", "latest_value").orderBy(F.col("latest_value").desc_nulls_last(), "name")


@query("f3_occupations_by_total", f"select code, total from ({occupation_sql()}) o order by total desc nulls last")
def f3(t: Inputs) -> DataFrame:
    return occupations(t).select("code", "total").orderBy(F.col("total").desc_nulls_last(), "code")


@query("f5_distinct_occupations", "select distinct occ_code as code, occ_name as name from {series} where occ_code is not null and occ_code <> ''")
def f5(t: Inputs) -> DataFrame:
    stated = t.series.filter("occ_code is not null and occ_code <> ''")
    return stated.select(F.col("occ_code").alias("code"), F.col("occ_name").alias("name")).distinct().orderBy("code")


@query(
    "h10_series_key",
    """select concat('feed|advertisement-index|online-advertisements|month|g:c.', lower(geo_code), '|o:c.', occ_code, '|adjustment.original') as key,
    concat('Online advertisements (advertisements); geography: ', geo_code, '; occupation: ', coalesce(occ_name, occ_code), '; Adjustment: Original; month; Advertisement index') as description
    from {series}""",
)
def h10(t: Inputs) -> DataFrame:
    c = F.col
    stated = F.create_map(F.lit("Adjustment"), F.lit("Original"))
    none = F.lit(None).cast("string")
    return t.series.select(
        P.series_key(c("source_key"), c("dataset"), c("measure"), c("granularity"), c("geo_code"), none, c("occ_code"), c("occ_name"), stated).alias("key"),
        P.describe_series(c("measure"), c("unit"), c("geo_code"), none, c("occ_code"), c("occ_name"), stated, c("granularity"), c("dataset")).alias("description"),
    )


@query(
    "h11_period_starts",
    """select period, count(*) as n from (
      select case g when 'MONTH' then strftime(d, '%Y-%m') when 'QUARTER' then concat(year(d), '-Q', quarter(d)) else strftime(d, '%Y') end as label,
        strftime(date_trunc(g, d), '%Y-%m-%d') as start, concat(label, ' ', start) as period
      from (select cast(l_shipdate as date) as d, case l_linenumber % 3 when 0 then 'MONTH' when 1 then 'QUARTER' else 'YEAR' end as g from {lineitem}) x) y
    group by period""",
)
def h11(t: Inputs) -> DataFrame:
    grain = F.element_at(F.array(F.lit("MONTH"), F.lit("QUARTER"), F.lit("YEAR")), F.col("l_linenumber") % 3 + 1)
    days = t.lineitem.select(F.col("l_shipdate").cast("date").alias("d"), grain.alias("g"))
    period = F.concat_ws(" ", P.period_label(F.col("d"), F.col("g")), day(P.period_start(F.col("d"), F.col("g"))))
    return days.groupBy(period.alias("period")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "h13_leaf_codes",
    f"with codes as (select distinct occ_code as code from {{series}}) select code, {LEAF} as is_leaf from codes c",
)
def h13(t: Inputs) -> DataFrame:
    return T.with_leaf_flag(t.series.select(F.col("occ_code").alias("code")).distinct())


@query(
    "b9_aggregation_gate",
    """select source_key, case when activation = 'DEVELOPMENT_ONLY' then 'development fixture'
      when activation <> 'ACTIVE' then concat('activation is ', activation)
      when compliance_status <> 'VERIFIED' then concat('compliance is ', compliance_status)
      when not permits_aggregates then 'its licence reserves aggregate use' end as refused from {source_registry}""",
)
def b9(t: Inputs) -> DataFrame:
    return t.source_registry.select("source_key", T.refusal_reason().alias("refused"))


@query("b15_occupation_text_search", f"select code, name from ({occupation_sql()}) o where contains(lower(code), 'd 1') or contains(lower(coalesce(name, '')), 'd 1')")
def b15(t: Inputs) -> DataFrame:
    needle = F.lit("d 1")
    found = F.contains(F.lower("code"), needle) | F.contains(F.lower(F.coalesce("name", F.lit(""))), needle)
    return occupations(t).filter(found).select("code", "name")


@query("b16_regions_of_state", f"select code, latest_state is null as missing from ({region_sql()}) r where state_code = 'R1'")
def b16(t: Inputs) -> DataFrame:
    return regions(t).filter(F.col("state_code") == STATE_A).select("code", F.col("latest_state").isNull().alias("missing"))


@query(
    "c18_two_scopes_on_code",
    f"""select a.code, a.total as a_value, b.total as b_value from ({occupation_sql(where="x.state_code = 'R1'")}) a
    join ({occupation_sql(where="x.state_code = 'R2'")}) b on b.code = a.code where a.total is not null and b.total is not null""",
)
def c18(t: Inputs) -> DataFrame:
    both = states(t).filter(F.col("total").isNotNull())
    sides = [both.filter(F.col("state_code") == s).select("code", F.col("total").alias(v)) for s, v in ((STATE_A, "a_value"), (STATE_B, "b_value"))]
    return sides[0].join(sides[1], "code")


@query(
    "c16_area_lookups",
    """select g.level, g.code, g.name, p.name as parent_name, regexp_replace(regexp_replace(lower(g.name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as slug
    from {geography} g left join {geography} p on p.code = g.parent_code
    where g.level = 'SA4' or g.parent_code = 'R2' or (g.level = 'STATE' and g.code = 'R3') or regexp_replace(lower(g.name), '[^a-z0-9]+', '-', 'g') = 'middle-east'""",
)
def c16(t: Inputs) -> DataFrame:
    from advertide.operators.places import areas_with_parents

    areas = areas_with_parents(t.geography).withColumn("slug", area_slug(F.col("name")))
    wanted = (
        (F.col("level") == "SA4")
        | (F.col("parent_code") == "R2")
        | ((F.col("level") == "STATE") & (F.col("code") == "R3"))
        | (F.col("slug") == area_slug(F.lit("MIDDLE EAST")))
    )
    return areas.filter(wanted).select("level", "code", "name", "parent_name", "slug").orderBy("code")
