"""Place queries: resolving, crosswalks, range classification, inheritance, polygons and hierarchies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from advertide.operators import places as G
from advertide.plans.inputs import Inputs
from advertide.plans.registry import query

INSTRUMENT = "LIN 19/217"
WORDS = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"


def aliased(expression: str) -> str:
    arms = " ".join(f"when '{k}' then '{v}'" for k, v in G.STATE_ALIASES.items())
    key = WORDS.format(expression)
    return f"case {key} {arms} else {key} end"


def keyed(view: str, key: str, value: str = "code", where: str = "true") -> str:
    return f"select {key} as k, count(*) as n, min({value}) as one from {{{view}}} where {where} group by 1"


@query(
    "c5_geography_resolution",
    f"""with by_code as ({keyed('numbered_area', "upper(regexp_replace(code, '\\s+', '', 'g'))")}), by_name as ({keyed('numbered_area', WORDS.format('name'))}),
    s as (select *, upper(regexp_replace(nullif(trim(stated_code), ''), '\\s+', '', 'g')) as ck, {aliased("nullif(trim(stated_name), '')")} as nk from {{stated_area}})
    select s.id, case when a.n > 1 then null when a.n = 1 then a.one when b.n > 1 then null when b.n = 1 then b.one when c.n = 1 then c.one end as resolved_code,
      case when a.n > 1 then 'AMBIGUOUS' when a.n = 1 then 'RESOLVED' when b.n > 1 then 'AMBIGUOUS' when b.n = 1 then 'RESOLVED'
        when c.n > 1 then 'AMBIGUOUS' when c.n = 1 then 'RESOLVED' else 'UNRESOLVED' end as resolution
    from s left join by_code a on a.k = s.ck
    left join by_code b on regexp_matches(s.ck, '^[0-9]+$') and b.k = cast(try_cast(s.ck as bigint) as varchar)
    left join by_name c on c.k = s.nk""",
)
def c5(t: Inputs) -> DataFrame:
    resolved = G.resolve_geography(t.stated_area, t.numbered_area, "stated_code", "stated_name")
    return resolved.select("id", "resolved_code", "resolution")


@query(
    "c6_resolution_at_level",
    f"""with by_name as ({keyed('numbered_area', WORDS.format('name'), where="level = 'SA4'")})
    select s.id, case when n = 1 then one end as resolved_code, case when n > 1 then 'AMBIGUOUS' when n = 1 then 'RESOLVED' else 'UNRESOLVED' end as resolution
    from {{stated_area}} s left join by_name on k = {aliased('stated_name')}""",
)
def c6(t: Inputs) -> DataFrame:
    return G.resolve_at_level(t.stated_area, t.numbered_area, "stated_name", "SA4").select("id", "resolved_code", "resolution")


@query(
    "c7_occupation_resolution",
    f"""with by_code as ({keyed('occupation', 'code', 'occupation_id')})
    select p_partkey as id, case when n = 1 then one end as occupation_id, case when n > 1 then 'AMBIGUOUS' when n = 1 then 'RESOLVED' else 'UNRESOLVED' end as resolution
    from {{part}} left join by_code on k = substr(p_brand, 7) and p_size % 7 <> 0""",
)
def c7(t: Inputs) -> DataFrame:
    code = F.when(F.col("p_size") % 7 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), F.substr("p_brand", F.lit(7))))
    stated = t.part.select(F.col("p_partkey").alias("id"), code.alias("stated_code"))
    return G.resolve_occupation(stated, t.occupation, "stated_code").select("id", "occupation_id", "resolution")


@query(
    "c8_first_resolvable_locality",
    """with parts as (select place_id, i, trim(list_extract(string_split(raw_text, ','), i)) as locality from {place}, (values (1), (2)) v(i)),
    hit as (select p.place_id, p.i, p.locality, q.portal_key, g.code from parts p left join {portal} q on q.portal_key = lower(p.locality)
      left join {geography} g on g.level = 'SA4' and g.name = q.area_name),
    f as (select place_id, min(i) filter (where code is not null) as at from hit group by 1)
    select h.place_id as id, coalesce(max(case when i = f.at then code end), 'W') as resolved_code,
      coalesce(string_agg(locality, ';' order by i) filter (where portal_key is null and (f.at is null or i < f.at)), '') as unknown
    from hit h join f on f.place_id = h.place_id group by 1""",
)
def c8(t: Inputs) -> DataFrame:
    listings = t.place.select(F.col("place_id").alias("id"), F.transform(F.split("raw_text", ","), lambda p: F.trim(p)).alias("localities"))
    settled = G.resolve_localities(listings, t.portal, t.geography, "SA4", "W")
    return settled.select("id", "resolved_code", F.array_join("unknown", ";").alias("unknown"))


@query(
    "c9_relink_unresolved",
    f"""with by_level as (select level, {WORDS.format('name')} as k, min(code) as one from {{geography}} group by 1, 2 having count(*) = 1),
    p as (select *, case when place_id % 2 = 0 then split_part(raw_text, ', ', 2) end as state_name from {{place}})
    select p.place_id, coalesce(p.geo_code, one) as geo_code from p left join by_level b
      on b.level = case when state_name is null then 'COUNTRY' else 'STATE' end and b.k = {WORDS.format('coalesce(state_name, raw_text)')}""",
)
def c9(t: Inputs) -> DataFrame:
    named = F.when(F.col("place_id") % 2 == 0, F.split_part("raw_text", F.lit(", "), F.lit(2)))
    places = t.place.select("place_id", "raw_text", "geo_code", named.alias("state_name"))
    return G.relink(places, t.geography).select("place_id", "geo_code")


@query(
    "c10_unit_crosswalk",
    "select area_code, count(*) as units, count(postcode) as matched, count(*) - count(postcode) as unmatched from {unit_area} a left join {unit_postcode} p on p.unit = a.unit group by 1",
)
def c10(t: Inputs) -> DataFrame:
    return (
        t.unit_area.join(t.unit_postcode, "unit", "left")
        .groupBy("area_code")
        .agg(F.count(F.lit(1)).alias("units"), F.count("postcode").alias("matched"), F.count_if(F.col("postcode").isNull()).alias("unmatched"))
    )


def allocation_sql() -> str:
    def literal(value):
        return "null" if value is None else f"'{value}'" if isinstance(value, str) else str(value)

    rows = ", ".join("(" + ", ".join(map(literal, row)) + ")" for row in G.allocation_rows())
    return f"select * from (values {rows}) r(jurisdiction, category, kind, lo, hi)"


def classified_sql(view: str) -> str:
    hit = "(select bool_or(true) from alloc a where a.jurisdiction = p.state_code and a.category = '{0}' and ({1}))"
    in_range = "a.kind = 'ALL' or (a.kind = 'RANGES' and try_cast(p.postcode as int) between a.lo and a.hi)"
    city, other = hit.format(G.CITY, in_range), hit.format(G.OTHER, in_range + " or a.kind = 'REMAINDER'")
    listed = "exists (select 1 from alloc a where a.jurisdiction = p.state_code)"
    readable = "regexp_matches(p.postcode, '^[0-9][0-9][0-9][0-9]$')"
    wholly = hit.format(G.CITY, "a.kind = 'ALL'"), hit.format(G.OTHER, "a.kind in ('ALL', 'REMAINDER')")
    arms = f"""when state_code is null or not {listed} then '{{unknown}}' when postcode is not null and not {readable} then '{{unknown}}'
      when postcode is not null and {city} then '{{city}}' when postcode is not null and {other} then '{{other}}' when postcode is not null then '{{none}}'
      when {wholly[0]} then '{{wholecity}}' when {hit.format(G.OTHER, "a.kind = 'ALL'")} then '{{wholeother}}' when {wholly[1]} then '{{whole}}' else '{{unknown}}'"""
    verdict = arms.format(
        unknown="UNKNOWN||NONE", city=f"REGIONAL|{G.CITY}|POSTCODE", other=f"REGIONAL|{G.OTHER}|POSTCODE", none="NOT_REGIONAL||POSTCODE",
        wholecity=f"REGIONAL|{G.CITY}|STATE", wholeother=f"REGIONAL|{G.OTHER}|STATE", whole="REGIONAL||STATE",
    )
    return f"""select p.*, split_part(v, '|', 1) as new_status, nullif(split_part(v, '|', 2), '') as new_category, split_part(v, '|', 3) as new_basis
    from (select p.*, case {verdict} end as v from {view} p) p"""


@query(
    "c11_postcode_range_classification",
    f"with alloc as ({allocation_sql()}) select place_id, new_status as status, new_category as category, new_basis as basis from ({classified_sql('{place}')}) c",
)
def c11(t: Inputs) -> DataFrame:
    placed = G.classify_places(t.place, G.allocation_table(t.spark))
    return placed.select("place_id", "placed.*")


@query(
    "c11_wholly_regional_places",
    f"""select state_code, count(*) as places from {{place}} where state_code in (select jurisdiction from ({allocation_sql()}) a
    where kind = 'ALL' or (kind = 'REMAINDER' and category = '{G.OTHER}')) group by 1""",
)
def c11_wholly(t: Inputs) -> DataFrame:
    settled = G.wholly_regional(G.allocation_table(t.spark)).withColumnRenamed("jurisdiction", "state_code")
    return t.place.join(settled, "state_code", "left_semi").groupBy("state_code").agg(F.count(F.lit(1)).alias("places"))


REGION_SQL = """select raw_text, case when bool_or(portal_key is null or (area_name is not null and status is null)) or count(status) = 0 then null
    when min(status) = max(status) and min(status) in ('REGIONAL', 'NOT_REGIONAL') then min(status) else 'UNKNOWN' end as region_status
  from (select distinct raw_text, trim(unnest(string_split(raw_text, ','))) as part from {place}) x
  left join {portal} q on q.portal_key = lower(part)
  left join {geography} g on lower(g.name) = lower(q.area_name) left join {area_verdict} v on v.code = g.code group by 1"""


@query("c12_region_inheritance", f"select place_id, region_status from {{place}} p left join ({REGION_SQL}) r on r.raw_text = p.raw_text")
def c12(t: Inputs) -> DataFrame:
    return G.inherit_regions(t.place, t.portal, t.geography, t.area_verdict, "raw_text").select("place_id", "region_status")


def points(t: Inputs) -> DataFrame:
    return t.embeddings.select(
        F.col("vec_id").alias("point_id"),
        F.col("embedding")[0].cast("double").alias("x"),
        F.col("embedding")[1].cast("double").alias("y"),
    )


def corner(x: str, y: str) -> Column:
    return F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))


def polygons(t: Inputs) -> DataFrame:
    ring = F.array(corner("x0", "y0"), corner("x1", "y0"), corner("x1", "y1"), corner("x0", "y1"))
    return t.box.select("polygon_id", ring.alias("ring"))


POINTS = "select vec_id as point_id, cast(embedding[1] as double) as x, cast(embedding[2] as double) as y from {embeddings}"
HELD = "x >= cast(x0 as double) and x < cast(x1 as double) and y >= cast(y0 as double) and y < cast(y1 as double)"


@query("c13_point_in_polygon", f"select point_id, min(polygon_id) as polygon_id from ({POINTS}) p left join {{box}} b on {HELD} group by 1")
def c13(t: Inputs) -> DataFrame:
    return G.place_points(points(t), polygons(t), 0.05).select("point_id", "polygon_id")


def pierced(t: Inputs) -> DataFrame:
    """Every box with a slanted hole in its middle and a triangle for a second part beyond its upper right corner."""
    at = lambda x, y: F.struct(F.expr(f"cast({x} as double)").alias("x"), F.expr(f"cast({y} as double)").alias("y"))
    box = F.array(at("x0", "y0"), at("x1", "y0"), at("x1", "y1"), at("x0", "y1"))
    hole = F.array(at("x0 + 0.05", "y0 + 0.01"), at("x0 + 0.08", "y0 + 0.04"), at("x0 + 0.05", "y0 + 0.07"), at("x0 + 0.02", "y0 + 0.04"))
    island = F.array(at("x1 + 0.01", "y1"), at("x1 + 0.31", "y1"), at("x1 + 0.01", "y1 + 0.3"))
    return t.box.select("polygon_id", F.array(box, hole, island).alias("rings"))


IN_HOLE = "abs(x - (x0 + 0.05)) + abs(y - (y0 + 0.04)) < 0.03"
ON_ISLAND = "x > x1 + 0.01 and y > y1 and (x - (x1 + 0.01)) + (y - y1) < 0.3"


@query(
    "c13_holes_and_parts",
    f"""select point_id, min(polygon_id) as polygon_id from ({POINTS}) p
    left join {{box}} b on ({HELD} and not {IN_HOLE}) or ({ON_ISLAND}) group by 1""",
)
def c13_pierced(t: Inputs) -> DataFrame:
    return G.place_points(points(t), pierced(t), 0.05).select("point_id", "polygon_id")


# Nine points of ten pulled together until they lie in one cell of the grid, a tenth of those on one spot.
CROWDED = f"""select point_id, case when point_id % 10 = 0 then x when point_id % 10 = 1 then 0.03125 else 0.025 + x / 64 end as x,
    case when point_id % 10 = 0 then y when point_id % 10 = 1 then 0.03125 else 0.025 + y / 64 end as y from ({POINTS}) q"""


@query("c13_dense_cells", f"select point_id, min(polygon_id) as polygon_id from ({CROWDED}) p left join {{box}} b on {HELD} group by 1")
def c13_dense(t: Inputs) -> DataFrame:
    last = F.col("point_id") % 10
    pulled = lambda axis: F.when(last == 0, F.col(axis)).when(last == 1, F.lit(0.03125)).otherwise(F.lit(0.025) + F.col(axis) / 64).alias(axis)
    crowded = points(t).select("point_id", pulled("x"), pulled("y"))
    return G.place_points(crowded, polygons(t), 0.05, most=100).select("point_id", "polygon_id")


PARENT = "case level when 'STATE' then 'COUNTRY' when 'GCCSA' then 'STATE' when 'SA4' then 'STATE' end"


@query(
    "c14_hierarchy_problems",
    f"""with a as (select *, {PARENT} as up from {{faulty_area}}), k as (select * from a where level in ('COUNTRY', 'STATE', 'GCCSA', 'SA4'))
    select code, level, 'unknown level' as problem from a where level not in ('COUNTRY', 'STATE', 'GCCSA', 'SA4')
    union all select code, level, 'duplicate code in level' from (select *, row_number() over (partition by level, code order by name) as rn from k) d where rn > 1
    union all select code, level, 'root has a parent' from k where up is null and parent_code is not null
    union all select code, level, 'parent missing' from k where up is not null and parent_code is null
    union all select code, level, 'parent absent' from k where up is not null and parent_code is not null
      and not exists (select 1 from k p where p.level = k.up and p.code = k.parent_code)""",
)
def c14(t: Inputs) -> DataFrame:
    return G.hierarchy_problems(t.faulty_area)


@query(
    "d15_level_summary",
    """select l.level, count(g.code) as total, count(case when g.has_geometry then 1 end) as mappable
    from (values ('COUNTRY'), ('STATE'), ('GCCSA'), ('SA4'), ('SA2')) l(level) left join {geography} g on g.level = l.level group by 1""",
)
def d15(t: Inputs) -> DataFrame:
    return G.level_summary(t.geography, (*G.LEVELS, "SA2"))


@query("d16_edition_changes", "select level, coalesce(change_label, 'Not stated') as change_label, count(*) as n from {geography} group by 1, 2")
def d16(t: Inputs) -> DataFrame:
    return G.edition_changes(t.geography)


@query(
    "d17_area_verdicts",
    f"""with alloc as ({allocation_sql()}), u as (select a.unit, a.area_code, a.area_name, a.state_code, p.postcode from {{unit_area}} a left join {{unit_postcode}} p on p.unit = a.unit),
    c as ({classified_sql('u')}),
    t as (select area_code, area_name, state_code, count(*) as units, count(postcode) as units_with_postcode,
      count(*) filter (where postcode is not null and new_status = 'REGIONAL') as units_regional,
      count(*) filter (where postcode is not null and new_status = 'NOT_REGIONAL') as units_not_regional, count(distinct postcode) as distinct_postcodes from c group by 1, 2, 3)
    select *, case when units_with_postcode = 0 then 'UNKNOWN' when units_not_regional = 0 then 'REGIONAL' when units_regional = 0 then 'NOT_REGIONAL' else 'MIXED' end as status from t""",
)
def d17(t: Inputs) -> DataFrame:
    return G.area_verdicts(t.unit_area, t.unit_postcode, G.allocation_table(t.spark))


@query(
    "g8_hierarchical_upsert",
    f"""with a as (select * from {{faulty_area}} where level in ('COUNTRY', 'STATE', 'GCCSA', 'SA4')),
    c as (select *, parent_code is null as written from a where level = 'COUNTRY'),
    s as (select *, parent_code is null or parent_code in (select code from c where written) as written from a where level = 'STATE'),
    r as (select *, parent_code is null or parent_code in (select code from s where written) as written from a where level in ('GCCSA', 'SA4'))
    select level, code, parent_code, written from c union all select level, code, parent_code, written from s union all select level, code, parent_code, written from r""",
)
def g8(t: Inputs) -> DataFrame:
    return G.import_hierarchy(t.faulty_area).select("level", "code", "parent_code", "written")


DUE = f"(regional_instrument is distinct from '{INSTRUMENT}' or regional_basis = 'NONE' or (postcode is not null and regional_basis <> 'POSTCODE'))"


@query(
    "g15_placement_sweep",
    f"""with alloc as ({allocation_sql()}), r as ({REGION_SQL}), c as (select c.*, r.region_status, new_status = 'UNKNOWN' and r.region_status in ('REGIONAL', 'NOT_REGIONAL') as by_region
      from ({classified_sql('{place}')}) c left join r on r.raw_text = c.raw_text)
    select place_id, {DUE} as is_due,
      case when not {DUE} then regional_status when by_region then region_status else new_status end as regional_status,
      case when not {DUE} then regional_category when coalesce(by_region, false) then null else new_category end as regional_category,
      case when not {DUE} then regional_basis when by_region then 'REGION' else new_basis end as regional_basis,
      case when {DUE} then '{INSTRUMENT}' else regional_instrument end as regional_instrument,
      case when {DUE} then '2001-08-01' else strftime(classified_on, '%Y-%m-%d') end as classified_on from c""",
)
def g15(t: Inputs) -> DataFrame:
    swept = G.classification_sweep(
        t.place, G.allocation_table(t.spark), t.portal, t.geography, t.area_verdict, INSTRUMENT, "2001-08-01"
    )
    return swept.select(
        "place_id", "is_due", "regional_status", "regional_category", "regional_basis", "regional_instrument",
        F.date_format("classified_on", "yyyy-MM-dd").alias("classified_on"),
    )


@query(
    "g16_postcode_fill",
    f"""select place_id, coalesce(l.postcode, f.polygon_id) as postcode,
      case when f.polygon_id is not null then 'DERIVED_FROM_COORDINATES' else postcode_source end as postcode_source,
      case when f.polygon_id is not null then 'boxes-1' else postcode_reference end as postcode_reference
    from {{place}} l left join (select p.point_id, min(polygon_id) as polygon_id from ({POINTS}) p join {{box}} b on {HELD} group by 1) f
      on f.point_id = l.place_id and l.postcode is null""",
)
def g16(t: Inputs) -> DataFrame:
    located = t.place.join(points(t).withColumnRenamed("point_id", "place_id"), "place_id", "left")
    filled = G.fill_postcodes(located, polygons(t), "boxes-1", 0.05)
    return filled.select("place_id", "postcode", "postcode_source", "postcode_reference")


UNRESOLVED = f"""select stated_code as code, stated_name as name, count(*) as series_count from {{stated_area}} s
    left join ({keyed('numbered_area', 'code')}) a on a.k = nullif(trim(stated_code), '')
    left join ({keyed('numbered_area', 'code')}) b on regexp_matches(trim(stated_code), '^[0-9]+$') and b.k = cast(try_cast(trim(stated_code) as bigint) as varchar)
    left join ({keyed('numbered_area', WORDS.format('name'))}) c on c.k = {aliased("nullif(trim(stated_name), '')")}
    where case when a.n is not null then a.n > 1 when b.n is not null then b.n > 1 when c.n is not null then c.n > 1 else true end group by 1, 2"""


@query("d5_unresolved_dimensions", UNRESOLVED)
def d5(t: Inputs) -> DataFrame:
    from advertide.operators.totals import unresolved_dimensions

    resolved = G.resolve_geography(t.stated_area, t.numbered_area, "stated_code", "stated_name")
    listed = unresolved_dimensions(resolved.withColumn("source_key", F.lit("feed")), "feed")
    return listed.orderBy(F.desc("series_count"), "code", "name")


@query("h12_postcode_normalise", "select c_custkey as id, case when c_custkey % 3 <> 0 and c_custkey % 4 <> 1 then lpad(cast(c_custkey % 10000 as varchar), 4, '0') end as postcode from {customer}")
def h12(t: Inputs) -> DataFrame:
    from advertide.functions.text import four_digit_postcode

    digits = F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0")
    raw = (
        F.when(F.col("c_custkey") % 3 == 0, F.concat(digits, F.lit("0")))
        .when(F.col("c_custkey") % 4 == 1, F.concat(F.lit("A"), digits))
        .otherwise(F.concat(F.lit(" "), digits, F.lit("  ")))
    )
    return t.customer.select(F.col("c_custkey").alias("id"), four_digit_postcode(raw).alias("postcode"))


@query(
    "h14_state_abbreviation",
    """select id, case when c in (2, 4) then 'NSW' when c = 3 then 'TAS' end as state from (select c_custkey as id, c_nationkey % 5 as c from {customer}) x""",
)
def h14(t: Inputs) -> DataFrame:
    spelled = F.array(*[F.lit(x) for x in ("Atlantis", "Western-Sea", "N.S.W", "  tas", "New  South Wales")])
    written = F.element_at(spelled, F.col("c_nationkey") % 5 + 1)
    # Dots split letters into words, so "N.S.W" needs its own spelling.
    cleaned = F.replace(written, F.lit("."), F.lit(""))
    return t.customer.select(F.col("c_custkey").alias("id"), G.state_abbreviation(cleaned).alias("state"))
