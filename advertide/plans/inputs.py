"""The driver tables seen as the operators' inputs.

Each view is one SQL text both engines read the same way, so the reference SQL
of a query starts from exactly the rows its Spark plan starts from.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from advertide.session import stage

TABLES = (
    "region",
    "nation",
    "customer",
    "supplier",
    "part",
    "orders",
    "lineitem",
    "events",
    "documents",
    "embeddings",
    "pages",
    "benchmark",
    "labels",
    "conversations",
)

# The clock of every registered query, so results are the same on every run.
NOW = "2001-08-01 00:00:00"
RUN_NOW = "2024-01-31 00:00:00"
EDITION = "E1"
SOURCE = "feed"
DATASET = "Advertisement index"
LEVELS = ("GCCSA", "SA4")
TOTAL_CODE = "0"

VIEWS: dict[str, str] = {}

VIEWS["geography"] = """
select 'W' as code, 'World' as name, 'COUNTRY' as level, cast(null as string) as parent_code,
       'E1' as edition, true as has_geometry, cast(null as double) as area_sq_km,
       cast(null as string) as change_label
from {region} group by 1
union all
select concat('R', cast(r_regionkey as string)), r_name, 'STATE', case when r_regionkey >= 0 then 'W' end, 'E1', true,
       1000.5 * (r_regionkey + 1), case when r_regionkey % 2 = 0 then 'No change' end
from {region}
union all
select concat('N', cast(n_nationkey as string)), n_name,
       case when n_nationkey % 5 = 0 then 'GCCSA' else 'SA4' end,
       concat('R', cast(n_regionkey as string)), 'E1', n_nationkey % 6 <> 0,
       20.25 * (n_nationkey + 1), case n_nationkey % 3 when 0 then 'No change' when 1 then 'New' end
from {nation}
"""

# Advertisements counted per place, occupation and month. The brand number is the
# occupation code, a natural prefix hierarchy; code 0 holds all of a place.
VIEWS["cell"] = """
select s_nationkey as nk, substr(p_brand, 7) as occ,
       make_date(year(l_shipdate), month(l_shipdate), 1) as period_start, count(*) as n
from {lineitem}
join {part} on l_partkey = p_partkey
join {supplier} on l_suppkey = s_suppkey
group by 1, 2, 3
"""

VIEWS["metric"] = """
select geo_code, occ_code, concat(geo_code, '|', occ_code) as series_key, period_start,
       case when h % 23 = 0 then cast(null as double) when h % 23 = 1 then cast(0 as double)
            else cast(n as double) end as value,
       case when h % 23 = 0 then 'SUPPRESSED' when h % 23 = 1 then 'ZERO' else 'PRESENT' end as value_state
from (
  select concat('N', cast(nk as string)) as geo_code, occ as occ_code, period_start, n,
         nk * 7 + cast(occ as int) * 3 + month(period_start) + year(period_start) as h
  from (
    select nk, case when grouping(occ) = 1 then '0' else occ end as occ, period_start, sum(n) as n
    from {cell} group by grouping sets ((nk, occ, period_start), (nk, period_start))
  ) coded
) stated
"""

VIEWS["series"] = """
select series_key, 'feed' as source_key, 'Advertisement index' as dataset,
       'Online advertisements' as measure, 'advertisements' as unit, 'OFFICIAL' as basis,
       'MONTH' as granularity, geo_code, occ_code,
       case when occ_code = '0' then concat('All in ', geo_code) when occ_code = '3' then cast(null as string)
            when occ_code = '14' then '' else concat('Brand ', occ_code) end as occ_name
from {metric} group by series_key, geo_code, occ_code
"""

VIEWS["source_registry"] = """
select source as source_key, concat('Source ', substr(source, 4)) as display_name,
       case when sn % 9 = 8 then 'MARKET_INDICATOR' else 'JOB_LISTING' end as kind,
       case when sn % 10 = 3 then 'DEVELOPMENT_ONLY' when sn % 5 = 4 then 'PENDING' else 'ACTIVE' end as activation,
       case when sn % 7 = 6 then 'UNVERIFIED' else 'VERIFIED' end as compliance_status,
       sn % 2 = 0 as attribution_required,
       case when sn % 8 <> 0 then concat('Data from source ', substr(source, 4)) end as attribution_text,
       case when sn % 3 <> 0 then 'CC BY 4.0' end as licence,
       case when sn % 2 = 1 then 'ESTABLISHED' else 'PARTIAL' end as rights_status,
       case sn % 3 when 0 then 'API' when 1 then 'CRAWL' else 'FILE' end as retrieval_method,
       sn % 4 <> 1 as permits_aggregates
from (select source, cast(substr(source, 4) as int) as sn from {documents} group by source) named
where sn <> 7
"""

# One row per stated position; a field nobody stated a position on has no row.
VIEWS["rights"] = """
select source_key, 'description' as field,
       case when sn % 3 = 0 then 'PERMITTED' else 'PROHIBITED' end as stated
from (select source_key, cast(substr(source_key, 4) as int) as sn from {source_registry}) a where sn % 3 <> 2
union all
select source_key, 'title', 'PERMITTED'
from (select source_key, cast(substr(source_key, 4) as int) as sn from {source_registry}) b where sn % 5 <> 1
union all
select source_key, 'salary', case when sn % 4 = 0 then 'PROHIBITED' else 'PERMITTED' end
from (select source_key, cast(substr(source_key, 4) as int) as sn from {source_registry}) c where sn % 2 = 0
"""

VIEWS["place"] = """
select c_custkey as place_id, concat(n_name, ', ', r_name) as raw_text,
       case n_nationkey % 9 when 0 then 'NSW' when 1 then 'VIC' when 2 then 'QLD' when 3 then 'WA'
            when 4 then 'SA' when 5 then 'TAS' when 6 then 'ACT' when 7 then 'NT' end as state_code,
       case when c_custkey % 7 = 0 then cast(null as string) when c_custkey % 31 = 0 then 'X12'
            else lpad(cast((c_custkey * 37) % 8000 as string), 4, '0') end as postcode,
       case when c_custkey % 3 = 0 then 'DERIVED_FROM_COORDINATES' when c_custkey % 7 = 0 then cast(null as string)
            else 'STATED' end as postcode_source,
       case when c_custkey % 15 <> 0 then 'boundaries-2021' end as postcode_reference,
       case when c_custkey % 4 = 0 then 'UNKNOWN' when c_custkey % 4 = 1 then 'NOT_REGIONAL' else 'REGIONAL' end as regional_status,
       case when c_custkey % 8 = 2 then 'CITY_OR_MAJOR_CENTRE' when c_custkey % 40 = 1 then 'REGIONAL_CENTRE_OR_OTHER' end as regional_category,
       case when c_custkey % 4 = 0 and c_custkey % 20 <> 0 then 'NONE' when c_custkey % 9 = 4 then 'STATE'
            when c_custkey % 13 = 5 then 'NONE' else 'POSTCODE' end as regional_basis,
       case when c_custkey % 11 <> 3 then 'LIN 19/217' when c_custkey % 2 = 0 then 'LIN 18/000' end as regional_instrument,
       case when c_custkey % 17 <> 2 then cast('2001-01-01' as date) end as classified_on,
       case when c_custkey % 5 <> 0 then concat('N', cast(n_nationkey as string)) end as geo_code,
       c_acctbal
from {customer} join {nation} on c_nationkey = n_nationkey join {region} on n_regionkey = r_regionkey
"""

# Copies of a text share a company and a place, as real re-postings do.
VIEWS["job"] = """
select concat('job-', lpad(cast(d.doc_id as string), 12, '0')) as id, d.doc_id, d.source as source_key,
       concat('S', cast(d.doc_id as string)) as source_id,
       split_part(d.text, chr(10), 1) as title,
       case when d.doc_id % 19 <> 7 then d.text end as description,
       d.doc_id % 3 = 0 as description_is_excerpt,
       case when c.c_custkey % 5 = 0 then concat('The ', c.c_name) else c.c_name end as company_name, p.place_id, p.raw_text as location_text, p.state_code, p.postcode,
       p.regional_status, p.regional_category, p.regional_basis, p.postcode_source,
       g.url as apply_url, g.url as source_url,
       case when d.doc_id % 17 <> 5 then o.o_orderdate end as posted_at,
       o.o_orderdate as first_seen_at,
       o.o_orderdate + (d.doc_id % 40) * interval '1' day as last_seen_at,
       case when d.doc_id % 13 <> 4 then o.o_orderdate + (d.doc_id % 40) * interval '1' day end as last_verified_at,
       case when d.doc_id % 10 = 9 then o.o_orderdate + (d.doc_id % 7 - 1) * interval '1' day end as expired_at,
       case when d.doc_id % 10 = 9 then 'EXPIRED' when coalesce(l.toxic, 0) = 1 then 'WITHDRAWN' else 'ACTIVE' end as status,
       d.doc_id % 8 <> 3 as is_canonical,
       coalesce(l.quality, 1) = 0 as is_synthetic,
       d.lang as category_tag,
       case o.o_orderpriority when '1-URGENT' then 'FULL_TIME' when '2-HIGH' then 'PART_TIME'
            when '3-MEDIUM' then 'CONTRACT' end as employment_type,
       case d.doc_id % 5 when 0 then ' Permanent ' when 1 then 'CONTRACT' when 2 then '' when 3 then ' fixed Term' end as contract_type,
       case when d.doc_id % 4 <> 1 then o.o_totalprice * 0.5 end as salary_min,
       case when d.doc_id % 6 <> 1 then o.o_totalprice * 0.75 end as salary_max,
       case when d.doc_id % 5 <> 2 then 'AUD' end as salary_currency,
       case when d.doc_id % 9 <> 2 then 'YEAR' end as salary_period,
       case when d.doc_id % 7 <> 2 then 'REPORTED' end as salary_basis,
       case d.doc_id % 7 when 0 then 'OFFERED' when 1 then 'EXCLUDED' when 2 then 'INDETERMINATE' else 'NOT_MENTIONED' end as signal,
       case d.doc_id % 11 when 0 then '[]' when 1 then cast(null as string)
            when 2 then '[{"phrase":"p","context":"old"},{"phrase":1,"sentence":"s"},null,{"phrase":"q","sentence":"t"}]'
            when 3 then '{"phrase":"p"}'
            else '[{"phrase":"p","sentence":"s"}]' end as evidence
from (select *, n_chars % (select count(*) from {customer}) as ck, n_chars % (select count(*) from {pages}) as pk from {documents}) d
left join {customer} c on c.c_custkey = d.ck and d.n_chars % 11 <> 0
left join {place} p on p.place_id = d.ck and d.n_chars % 13 <> 0
left join {orders} o on o.o_orderkey = d.doc_id
left join {labels} l on l.doc_id = d.doc_id
left join {pages} g on g.page_id = d.pk and d.n_chars % 3 = 0
"""

# What Spark reads for a view, where the same rows can be worked out with less moved.
# The links of an advertisement hang on its number and its length alone, so they are found
# for these, and each text meets them once instead of passing through every join.
LEANER: dict[str, str] = {}
LEANER["job"] = (
    re.sub(r"\bd\.(text|source|lang)\b", r"t.\1", VIEWS["job"])
    .replace("from {documents}) d", "from (select distinct doc_id, n_chars from {documents}) k) d")
    + "join {documents} t on t.doc_id <=> d.doc_id and t.n_chars <=> d.n_chars\n"
)

# Words of the driver's prose stand in for skills.
VIEWS["skill"] = """
select key, name, kind, pos from (values
  ('the', 'The', 'TOOL', 0), ('que', 'Que', 'TOOL', 1), ('der', 'Der', 'TECHNICAL', 2),
  ('with', 'With', 'CERTIFICATION', 3), ('ment', 'Ment', 'TECHNICAL', 4), ('zzz', 'Zzz', 'CERTIFICATION', 5)
) as v(key, name, kind, pos)
"""

VIEWS["job_skill"] = """
select job_id, key as skill_key, 'DETERMINISTIC' as method,
       case when doc_id % 23 = 1 then ' ' else name end as matched_text
from (
  select concat('job-', lpad(cast(doc_id as string), 12, '0')) as job_id, doc_id, doc_id % 9 as pick from {documents}
  union all
  select concat('job-', lpad(cast(doc_id as string), 12, '0')), doc_id, doc_id % 4 from {documents}
  where doc_id % 4 <> doc_id % 9
) picked join {skill} on pos = pick
"""

VIEWS["run"] = """
select event_id as run_id, concat('src', cast(user_id % 20 as string)) as source_key,
       case when user_id % 3 = 0 then 'full' else 'delta' end as dataset,
       case event_type when 'purchase' then 'COMPLETED' when 'error' then 'FAILED' else 'RUNNING' end as status,
       ts as started_at,
       case when event_type = 'purchase' or (event_type = 'error' and event_id % 2 = 0)
            then ts + cast(floor(value) as int) * interval '1' minute end as finished_at,
       cast(floor(value * 10) as bigint) as records_seen,
       cast(floor(value * 8) as bigint) as records_written,
       cast(floor(value * 10) as bigint) - cast(floor(value * 8) as bigint) - (event_id % 2) - case when event_id % 50 = 1 then 1 else 0 end as records_skipped,
       event_id % 2 as records_quarantined,
       props as checksum,
       case when event_type = 'error' then concat('failed: ', props) end as error
from {events} where event_type in ('purchase', 'error', 'signup')
"""

VIEWS["run_error"] = """
select event_id as error_id, event_id as run_id, concat('src', cast(user_id % 20 as string)) as source_key,
       case when event_id % 3 = 0 then 'MAPPING' else 'VALIDATION' end as kind, ts as occurred_at
from {events} where event_type = 'error' or (event_type = 'view' and event_id % 4 = 0)
"""

# A registry whose codes are bare numbers: regions and nations share some, so those are ambiguous.
VIEWS["numbered_area"] = """
select cast(n_nationkey as string) as code, case when n_nationkey = 5 then 'New South Wales' else n_name end as name,
       'SA4' as level from {nation}
union all
select cast(r_regionkey as string), r_name, 'STATE' from {region}
"""

VIEWS["stated_area"] = """
select c_custkey as id,
       case c_custkey % 5 when 0 then concat(' 0', cast(c_nationkey as string)) when 1 then cast(c_nationkey as string)
            when 3 then '' when 4 then 'zz' end as stated_code,
       case c_custkey % 4 when 0 then replace(n_name, '_', ' - ') when 1 then 'nsw' when 3 then 'nowhere' end as stated_name
from {customer} join {nation} on c_nationkey = n_nationkey
"""

VIEWS["occupation"] = """
select distinct substr(p_brand, 7) as code, 'v1' as version, concat(substr(p_brand, 7), '/v1') as occupation_id from {part}
union all
select distinct substr(p_brand, 7), 'v2', concat(substr(p_brand, 7), '/v2') from {part} where cast(substr(p_brand, 7) as int) % 5 = 0
"""

# Portal names: every nation is an area, every region but one is known and no place.
VIEWS["portal"] = """
select lower(n_name) as portal_key, n_name as area_name from {nation} where n_nationkey % 6 <> 5
union all
select lower(r_name), cast(null as string) from {region} where r_name <> 'EUROPE'
"""

VIEWS["area_verdict"] = """
select concat('N', cast(n_nationkey as string)) as code,
       case n_nationkey % 4 when 0 then 'REGIONAL' when 1 then 'NOT_REGIONAL' else 'MIXED' end as status
from {nation} where n_nationkey % 7 <> 6
"""

VIEWS["unit_area"] = """
select place_id as unit, concat('N', cast(c_nationkey as string)) as area_code, n_name as area_name, state_code
from {place} join {customer} on c_custkey = place_id join {nation} on c_nationkey = n_nationkey
"""

VIEWS["unit_postcode"] = "select place_id as unit, postcode from {place} where postcode is not null and postcode <> 'X12'"

# A registry with every kind of fault in it.
VIEWS["faulty_area"] = """
select code, name, level, parent_code from {geography}
union all
select concat('N', cast(n_nationkey as string)), n_name, case when n_nationkey % 5 = 0 then 'GCCSA' else 'SA4' end,
       case when n_nationkey >= 0 then 'R1' end
from {nation} where n_nationkey % 10 = 0
union all
select concat('M', cast(n_nationkey as string)), n_name, 'SA4', case when n_nationkey % 2 = 0 then 'R9' end
from {nation} where n_nationkey % 4 <> 1
union all
select concat('Q', cast(r_regionkey as string)), r_name, case when r_regionkey = 0 then 'PLANET' else 'STATE' end, 'V' from {region}
union all
select 'V', 'Void', 'COUNTRY', 'W' from {region} where r_regionkey = 0
"""

VIEWS["box"] = """
select lpad(cast(n_nationkey as string), 4, '1') as polygon_id,
       (n_nationkey % 5) * 0.1 - 0.25 as x0, (n_nationkey % 5) * 0.1 - 0.15 as x1,
       floor(n_nationkey / 5) * 0.08 - 0.2 as y0, floor(n_nationkey / 5) * 0.08 - 0.12 as y1
from {nation} where n_nationkey % 9 <> 4
"""


# What an earlier run stored: labelled documents, some re-titled since, and chat turns no feed lists any more.
VIEWS["stored_listing"] = """
select d.source as source_key, concat('S', cast(d.doc_id as string)) as source_id,
       case when l.quality = 0 then upper(split_part(d.text, chr(10), 1)) else split_part(d.text, chr(10), 1) end as title,
       d.text as description, case when l.toxic = 1 then 'EXPIRED' else 'ACTIVE' end as status,
       o.o_orderdate as last_seen_at, o.o_orderdate as last_verified_at,
       case when l.toxic = 1 then o.o_orderdate end as expired_at
from {documents} d join {labels} l on l.doc_id = d.doc_id left join {orders} o on o.o_orderkey = d.doc_id
union all
select 'chat', concat('C', cast(conv_id as string), '-', cast(turn as string)), role, text, 'ACTIVE',
       o.o_orderdate, o.o_orderdate, cast(null as timestamp)
from {conversations} left join {orders} o on o.o_orderkey = conv_id
"""

VIEWS["fed_listing"] = """
select source as source_key, concat('S', cast(doc_id as string)) as source_id,
       split_part(text, chr(10), 1) as title, text as description
from {documents}
"""

# The observations of an earlier release: the same cells counted over settled line items only.
VIEWS["stored_metric"] = """
select concat('N', cast(s_nationkey as string), '|', substr(p_brand, 7)) as series_key,
       make_date(year(l_shipdate), month(l_shipdate), 1) as period_start, cast(count(*) as double) as value, 'PRESENT' as value_state
from {lineitem}
join {part} on l_partkey = p_partkey
join {supplier} on l_suppkey = s_suppkey
where l_linestatus = 'F'
group by 1, 2
"""

# Groups an earlier pass formed: one per text seen more than once, whatever its source.
VIEWS["grouped_job"] = """
select j.*, case when c.n > 1 or j.doc_id % 29 = 3 then concat('old:', cast(j.doc_id % 50 as string)) end as duplicate_group
from {job} j join (select doc_id, count(*) over (partition by n_chars, lang) as n from {documents}) c on c.doc_id = j.doc_id
"""


# Figures with every fault a check looks for: negatives, and states that disagree with their figure.
VIEWS["faulty_metric"] = """
select concat('c', cast(c_custkey as string)) as id, case when c_custkey % 11 <> 3 then c_acctbal - 1000 end as value,
       case c_custkey % 4 when 0 then 'PRESENT' when 1 then 'SUPPRESSED' when 2 then 'PRESENT' end as value_state,
       c_nationkey as geo, c_mktsegment as measure, case when c_custkey % 2 = 0 then c_custkey % 3 end as occ
from {customer}
"""

VIEWS["faulty_summary"] = """
select concat('s', cast(s_suppkey as string)) as id, s_acctbal - 500 as value from {supplier}
"""

VIEWS["faulty_occupation"] = """
select cast(p_partkey as string) as id, case when p_size % 10 = 0 then '' else 'v1' end as version,
       case when p_size % 7 = 0 then '' else p_name end as name from {part}
"""


_NAME = re.compile(r"\{([a-z]\w*)\}")


def needs(sql: str) -> list[str]:
    """Tables and views a text refers to, each once, in order."""
    return [n for n in dict.fromkeys(_NAME.findall(sql)) if n in VIEWS or n in TABLES]


def named(sql: str) -> str:
    """The text with tables and views named plainly; other braces are its own."""
    return _NAME.sub(lambda m: m.group(1) if m.group(1) in VIEWS or m.group(1) in TABLES else m.group(0), sql)


def oracle_text(body: str) -> str:
    """One SQL statement with every view a body names written out as a common table expression."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in VIEWS and name not in order:
            for inner in needs(VIEWS[name]):
                visit(inner)
            order.append(name)

    for name in needs(body):
        visit(name)
    plain = named(body).strip()
    if not order:
        return plain
    parts = [f"{n} as ({named(VIEWS[n]).strip()})" for n in order]
    if plain.lower().startswith("with "):
        return "with " + ",\n".join(parts) + ",\n" + plain[5:]
    return "with " + ",\n".join(parts) + "\n" + plain


# The observation table every series report reads. It is places x codes x months
# rows however many line items there are. A session writes it once, as the import
# of a release would; every query then reads it as a table.
STORED = ("metric",)
_STAGED: dict[tuple[str, str, str], DataFrame] = {}


class Inputs:
    """The driver tables and views of one scale directory, each read lazily and once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._frames: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or (name not in VIEWS and name not in TABLES):
            raise AttributeError(name)
        if name not in self._frames:
            if name in TABLES:
                self._frames[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                frame = self.sql(LEANER.get(name, VIEWS[name]))
                self._frames[name] = self._stored(name, frame) if name in STORED else frame
        return self._frames[name]

    def _stored(self, name: str, frame: DataFrame) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _STAGED:
            _STAGED[key] = stage(frame, name)
        return _STAGED[key]

    def sql(self, text: str) -> DataFrame:
        # Braces that name no table belong to the text itself.
        used = needs(text)
        literal = text.replace("{", "{{").replace("}", "}}")
        for name in used:
            literal = literal.replace("{{" + name + "}}", "{" + name + "}")
        return self.spark.sql(literal, **{name: getattr(self, name) for name in used})
