"""Text queries: keys, markup, redaction, graded signals and vocabularies.

The packs below use words of the driver's invented prose, so they match; the
packs of the functions package are run over the same texts by the sweeps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from advertide.functions import redaction as R
from advertide.functions import text as X
from advertide.functions import wording as W
from advertide.operators import merge as M
from advertide.plans.inputs import Inputs
from advertide.plans.registry import query
from advertide.session import spread

DRIVER_VOCABULARY = (
    W.Entry("The", "the", "TOOL", (r"\bthe\b",)),
    W.Entry("Que", "que", "TOOL", (r"(?i)\bque\b",)),
    W.Entry("Der", "der", "TECHNICAL", (r"\bder\b", r"\bDie\b")),
    W.Entry("With", "with", "CERTIFICATION", (r"(?i)\bwith the\b", r"\bby of\b")),
    W.Entry("Ment", "ment", "TECHNICAL", (r"ment[a-z]{2,4}\b",)),
    W.Entry("Zzz", "zzz", "CERTIFICATION", (r"\bzzz\b",)),
)

DRIVER_PACK = W.SignalPack(
    keyword="the",
    negators=r"(?i)\b(?:not|no|never|is|by)\b",
    tiers=(
        W.Tier("EXCLUDED", 100, (r"(?i)\bwith the\b",), refusal=True),
        W.Tier("OFFERED", 2, (r"(?i)\bof the\b", r"(?i)\bthe of\b")),
        W.Tier("OPEN_TO", 1, (r"(?i)\bthe (?:in|on)\b",)),
        W.Tier("MAY_BE_CONSIDERED", 0, (r"(?i)\bto the\b[^.!?]{0,40}\ba\b",)),
        W.Tier("MAY_BE_CONSIDERED", 0, (r"(?i)\bthe (?:and|to|for|a)\b",)),
    ),
)

BLANKS = "[\\s\\x{0b}\\x{00a0}\\x{feff}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


def plain_sql(expression: str) -> str:
    """The reference text of markup removal, for texts without numeric entities."""
    text = f"regexp_replace({expression}, '<[^>]*>', ' ', 'g')"
    for entity, character in X.ENTITIES:
        character = character.replace("'", "''")
        text = f"replace({text}, '{entity}', '{character}')"
    return f"trim(regexp_replace({text}, '{BLANKS}+', ' ', 'g'))"


def attachments(jobs: DataFrame, vocabulary: tuple[W.Entry, ...]) -> DataFrame:
    """One row per advertisement and vocabulary entry found in it."""
    found = W.with_vocabulary(spread(jobs.select("id", "title", "description", "company_name"), "id"), vocabulary)
    # Exploding outer keeps the optimizer from testing the matches once more before exploding them.
    return found.select(F.col("id").alias("job_id"), F.explode_outer("found").alias("m")).filter("m is not null").select(
        "job_id", F.col("m.key").alias("skill_key"), F.col("m.matched_text").alias("matched_text"), F.col("m.sentence").alias("sentence")
    )


def escaped(pattern: str) -> str:
    return pattern.replace("'", "''")


def anchored(pattern: str) -> str:
    flags, body = ("(?i)", pattern[4:]) if pattern.startswith("(?i)") else ("", pattern)
    return escaped(f"{flags}^((?s:.)*?)({body})")


def quote_sql(text: str, low: str, high: str, start: str, end: str) -> str:
    def strip(piece: str) -> str:
        return f"regexp_replace({piece}, '^{BLANKS}+|{BLANKS}+$', '', 'g')"

    whole = strip(f"substr({text}, ({low}) + 1, ({high}) - ({low}))")
    window = strip(f"substr({text}, greatest({low}, ({start}) - 110) + 1, least({high}, ({end}) + 110) - greatest({low}, ({start}) - 110))")
    return f"""case when ({high}) - ({low}) > 320 then (case when ({start}) - 110 > ({low}) then '…' else '' end) || {window} || (case when ({end}) + 110 < ({high}) then '…' else '' end) else {whole} end"""


def attachments_sql() -> str:
    rows = []
    for position, entry in enumerate(DRIVER_VOCABULARY):
        for order, pattern in enumerate(entry.patterns):
            rows.append(f"({position}, {order}, '{entry.key}', '{entry.name}', '{escaped(pattern)}', '{anchored(pattern)}')")
    text = plain_sql("title || ' . ' || coalesce(description, '')")
    sentence = quote_sql("text", "low", "high", "start", "stop")
    return f"""select job_id, skill_key, trim(wording) as matched_text, {sentence} as sentence from (
      select *, length(regexp_extract(substr(text, 1, start), '^((?s:.)*[.!?])', 1)) as low,
        least(stop + length(regexp_extract(substr(text, stop + 1), '^([^.!?]*)', 1)) + 1, length(text)) as high from (
      select *, start + length(wording) as stop, row_number() over (partition by job_id, skill_key order by start, ord) as rn from (
        select j.id as job_id, v.key as skill_key, v.ord, j.text, length(regexp_extract(j.text, v.anchored, 1)) as start, regexp_extract(j.text, v.anchored, 2) as wording
        from (select id, company_name, {text} as text from {{job}}) j
        join (values {', '.join(rows)}) v(pos, ord, key, name, pattern, anchored) on regexp_matches(j.text, v.pattern)
        where not coalesce(contains(' ' || trim(regexp_replace(lower(j.company_name), '[^a-z0-9]+', ' ', 'g')) || ' ', ' ' || lower(v.name) || ' '), false)) m) n where rn = 1) o"""


@query(
    "h1_text_keys",
    """select doc_id, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) as words, regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as dashes,
    regexp_replace(regexp_replace(strip_accents(lower(title)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as slug, upper(regexp_replace(source, '\\s+', '', 'g')) as code
    from (select doc_id, source, split_part(text, chr(10), 1) as title from {documents}) d""",
)
def h1(t: Inputs) -> DataFrame:
    title = F.split_part("text", F.lit("\n"), F.lit(1))
    return t.documents.select("doc_id", "source", "text").select(
        "doc_id", X.word_key(title).alias("words"), X.dash_key(title).alias("dashes"),
        X.area_slug(title).alias("slug"), X.code_key(F.concat(F.lit(" "), F.col("source"), F.lit(" "))).alias("code"),
    )


# Entities the plain reading leaves alone stay as they are written.
@query("h3_html_to_text", f"select page_id, {plain_sql('html')} as text from {{pages}}")
def h3(t: Inputs) -> DataFrame:
    return t.pages.select("page_id", X.plain_text(F.col("html")).alias("text"))


# Feed wording: known entities read, others blanked; no entity here stands for an ampersand that starts another.
@query(
    "h3_feed_text",
    f"""select page_id, trim(regexp_replace(replace(regexp_replace(regexp_replace(replace(replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&quot;', '"'), '&amp;', chr(57344)), '(?i)&[a-z#0-9]+;', ' ', 'g'), chr(57345), ' '), chr(57344), '&'), '{BLANKS}+', ' ', 'g')) as text from {{pages}}""",
)
def h3_feed(t: Inputs) -> DataFrame:
    return t.pages.select("page_id", X.feed_text(F.col("html")).alias("text"))


CONTACTED = """select doc_id, concat(text, case doc_id % 6
    when 0 then concat(' Ring 04', lpad(cast(doc_id * 7919 % 100000000 as string), 8, '0'), ' or 0412 345 678 0412-345-679.')
    when 1 then concat(' Call (07) 3', lpad(cast(doc_id % 1000 as string), 3, '0'), ' 1234 now')
    when 2 then concat(' +61 2 9', lpad(cast(doc_id % 1000 as string), 3, '0'), ' 4321, mail ', source, '.jobs@example.com.au')
    when 3 then ' 1300 123 456 or 131 234 or 13 12 34 and 13 12 34 5'
    when 4 then concat(' no. 100412345678 and 0412345678', cast(doc_id % 10 as string)) else '' end) as text
from {documents}"""

# The redaction rules spelt without look-around. Each keeps what stands beside the match.
EDGES = (
    ("([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)*\\.[A-Za-z]{2,})\\b", None),
    ("(^|[^0-9])(\\+61[ ()\\-.]?[0-9](?:[ ()\\-.]?[0-9]){8})($|[^0-9])", 2),
    ("()(\\(0[2-8]\\)[ \\-.]?[0-9]{4}[ \\-.]?[0-9]{4})($|[^0-9])", 2),
    ("(^|[^0-9])(0[23478](?:[ \\-.]?[0-9]){8})($|[^0-9])", 2),
    ("(^|[^0-9])(1[38]00[ \\-.]?[0-9]{3}[ \\-.]?[0-9]{3})($|[^0-9])", 2),
    ("(^|[^0-9])(13[ \\-.]?[0-9]{2}[ \\-.]?[0-9]{2})($|[^0-9 \\-.]|[ \\-.](?:$|[^0-9]))", 2),
)


def redacted_sql(text: str) -> str:
    out = f"regexp_replace({text}, '\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)*\\.[A-Za-z]{{2,}}\\b', '{R.EMAIL_MARK}', 'g')"
    for pattern, _ in EDGES[1:]:
        for _ in range(2):  # a match takes its right edge with it, so its neighbour is found on the second pass
            out = f"regexp_replace({out}, '{pattern}', '\\1{R.PHONE_MARK}\\3', 'g')"
    return out


REDACTED = f"""select doc_id, text, after, length(replace(after, '{R.EMAIL_MARK}', '{R.EMAIL_MARK}~')) - length(after)
    + length(replace(after, '{R.PHONE_MARK}', '{R.PHONE_MARK}~')) - length(after) as removals
    from (select doc_id, text, {redacted_sql('text')} as after from ({CONTACTED}) c) r"""


@query("h5_contact_redaction", f"select doc_id, after as text, removals, removals > 0 as has_contact from ({REDACTED}) r")
def h5(t: Inputs) -> DataFrame:
    text = F.col("text")
    return spread(t.sql(CONTACTED), "doc_id").select("doc_id", R.redaction(text).alias("r"), R.has_contact(text).alias("has_contact")).select(
        "doc_id", "r.text", "r.removals", "has_contact"
    )


@query("g14_redaction_sweep", f"select count(*) as examined, count(*) filter (where removals > 0) as rewritten, cast(sum(removals) as bigint) as removals from ({REDACTED}) r")
def g14(t: Inputs) -> DataFrame:
    return M.redaction_outcome(M.redaction_sweep(spread(t.sql(CONTACTED), "doc_id"), "text"))


def signal_sql() -> str:
    """Every match placed in its sentence, judged, then settled per sentence and per text."""
    rows = []
    for tier_no, tier in enumerate(DRIVER_PACK.tiers):
        for pattern_no, pattern in enumerate(tier.patterns):
            body = pattern[4:]
            rows.append(f"({tier_no}, {pattern_no}, {tier.rank}, '{tier.signal}', {str(tier.refusal).lower()}, '{escaped(pattern)}', '(?i)((?s:.)*?)({escaped(body)})')")
    # The keyword is matched as lower-case text, as a pattern of one word.
    return f"""with texts as (select id, description, description_is_excerpt, {plain_sql('description')} as plain from {{job}}),
    sentences as (select id, unnest(regexp_extract_all(plain, '[^.!?]*[.!?]|[^.!?]+$')) as s, generate_subscripts(regexp_extract_all(plain, '[^.!?]*[.!?]|[^.!?]+$'), 1) as i from texts where contains(lower(description), 'the')),
    hits as (select id, i, s, tier, pat, rank, signal, refusal, unnest(regexp_extract_all(s, paired, 1)) as gap, unnest(regexp_extract_all(s, paired, 2)) as phrase, generate_subscripts(regexp_extract_all(s, paired, 1), 1) as k
      from sentences join (values {', '.join(rows)}) v(tier, pat, rank, signal, refusal, pattern, paired) on regexp_matches(s, pattern)),
    placed as (select *, cast(sum(length(gap) + length(phrase)) over (partition by id, i, tier, pat order by k) as bigint) as stop from hits),
    judged as (select *, stop - length(phrase) as start, refusal
      or regexp_matches(regexp_extract(substr(s, greatest(0, stop - length(phrase) - 60) + 1, stop - length(phrase) - greatest(0, stop - length(phrase) - 60)), '[^.;:!?]*$'), '{escaped(DRIVER_PACK.negators)}')
      or regexp_matches(regexp_extract(substr(s, stop + 1, 40), '^[^.;:!?]*'), '{escaped(DRIVER_PACK.negators)}') as refused from placed),
    best as (select *, case when refused then 100 else rank end as r, row_number() over (partition by id, i order by case when refused then 100 else rank end desc, tier, pat, start) as rn,
      first_value(struct_pack(tier := tier, pat := pat, i := i, start := start)) over (partition by id, i order by tier, pat, start) as met from judged),
    found as (select id, i, s, r, case when refused then 'EXCLUDED' else signal end as signal, trim(phrase) as phrase, met, {quote_sql('s', '0', 'length(s)', 'start', 'stop')} as sentence from best where rn = 1),
    settled as (select id, case when max(r) = 100 then 100 else min(r) end as r from found group by 1),
    spoken as (select f.id, min(f.signal) as signal, string_agg(f.phrase || '=' || f.sentence, ' | ' order by f.met.tier, f.met.pat, f.met.i, f.met.start) as evidence from found f join settled s on s.id = f.id and s.r = f.r group by 1)
    select t.id, case when description is null or trim(description) = '' then 'INDETERMINATE' when k.id is not null then k.signal when description_is_excerpt then 'INDETERMINATE' else 'NOT_MENTIONED' end as signal,
      coalesce(k.evidence, '') as evidence from texts t left join spoken k on k.id = t.id"""


def signals(t: Inputs, pack: W.SignalPack) -> DataFrame:
    found = W.signal_of("description", "description_is_excerpt", pack)
    jobs = spread(t.job.select("id", "description", "description_is_excerpt"), "id")
    return jobs.select("id", found.alias("found"))


@query("h6_graded_signal", signal_sql())
def h6(t: Inputs) -> DataFrame:
    shown = F.transform("found.evidence", lambda e: F.concat(e["phrase"], F.lit("="), e["sentence"]))
    return signals(t, DRIVER_PACK).select("id", F.col("found.signal").alias("signal"), F.array_join(shown, " | ").alias("evidence"))


@query(
    "h6_sponsorship_signal",
    "select id, case when description is null or trim(description) = '' or description_is_excerpt then 'INDETERMINATE' else 'NOT_MENTIONED' end as signal from {job} where not contains(lower(coalesce(description, '')), 'sponsor')",
)
def h6_sponsorship(t: Inputs) -> DataFrame:
    # The driver's prose never speaks of sponsorship, so silence is what the pack must read everywhere.
    return signals(t, W.SPONSORSHIP).select("id", F.col("found.signal").alias("signal"))


@query("g13_reclassification_sweep", f"select id, stored.signal as old_signal, s.signal as new_signal, stored.signal <> s.signal or (s.evidence = '') <> (stored.doc_id % 11 = 1) or s.evidence <> '' as differs from {{job}} stored join ({signal_sql()}) s using (id)")
def g13(t: Inputs) -> DataFrame:
    found = W.signal_of("description", "description_is_excerpt", DRIVER_PACK)
    stored = spread(t.job.select("id", "description", "description_is_excerpt", "signal", "evidence"), "id")
    swept = M.reclassified(stored, found)
    return swept.select("id", F.col("signal").alias("old_signal"), "new_signal", "differs")


@query("h7_vocabulary_extraction", f"select job_id, skill_key, matched_text from ({attachments_sql()}) a")
def h7(t: Inputs) -> DataFrame:
    return attachments(t.job, DRIVER_VOCABULARY).drop("sentence")


@query("h4_sentence_of_match", f"select job_id, skill_key, sentence from ({attachments_sql()}) a")
def h4(t: Inputs) -> DataFrame:
    return attachments(t.job, DRIVER_VOCABULARY).drop("matched_text")


@query("h7_skill_vocabulary")
def h7_skills(t: Inputs) -> DataFrame:
    return attachments(t.job, W.SKILLS)


@query(
    "e13_earliest_wording",
    """select conv_id, min(pos) as pos from (select conv_id, turn, unnest(['the', 'que', 'der']) as w, case when contains(text, w) then instr(text, w) end as pos from {conversations}) c where pos is not null group by 1""",
)
def e13(t: Inputs) -> DataFrame:
    entry = W.Entry("word", "word", "TOOL", ("the", "que", "der"))
    first = W.earliest_match(F.col("text"), entry)["start"] + 1
    found = t.conversations.select("conv_id", first.alias("pos")).filter("pos is not null")
    return found.groupBy("conv_id").agg(F.min("pos").cast("bigint").alias("pos"))


@query(
    "h16_split_headings",
    """select id, case when company_name is null or doc_id % 4 = 0 then trim(replace(title, ',', ';')) else trim(replace(title, ',', ';')) end as title, case when company_name is not null and doc_id % 4 <> 0 then company_name end as employer,
    array_to_string(list_filter(list_transform(string_split(coalesce(location_text, '') || ', ,' || source_key, ','), lambda x: trim(x)), lambda x: x <> ''), '|') as localities from {job}""",
)
def h16(t: Inputs) -> DataFrame:
    bare = F.replace("title", F.lit(","), F.lit(";"))
    heading = F.when(F.col("company_name").isNotNull() & (F.col("doc_id") % 4 != 0), F.concat(bare, F.lit(" , "), "company_name")).otherwise(bare)
    listed = F.concat(F.coalesce("location_text", F.lit("")), F.lit(", ,"), "source_key")
    staged = t.job.select("id", heading.alias("heading"), X.split_places(listed).alias("localities"))
    return staged.select(
        "id", X.heading_title(F.col("heading")).alias("title"), X.heading_employer(F.col("heading")).alias("employer"), F.array_join("localities", "|").alias("localities")
    )


@query(
    "h18_forbidden_wording",
    """select p_partkey, case p_size % 4 when 0 then 'total vacancies' when 1 then 'all jobs in australia,total jobs' else '' end as violations from {part}""",
)
def h18(t: Inputs) -> DataFrame:
    wording = F.element_at(
        F.array(*[F.lit(x) for x in ("TOTAL \n vacancies of ", "Total  jobs and all jobs in Australia: ", "Online advertisements ", "Jobs ")]),
        F.col("p_size") % 4 + 1,
    )
    return t.part.select("p_partkey", F.array_join(X.wording_violations(F.concat(wording, "p_name")), ",").alias("violations"))


@query(
    "h20_csv_field",
    """select doc_id, case when regexp_matches(text, '[",\\n\\r]') then '"' || replace(text, '"', '""') || '"' else text end as field from {documents}""",
)
def h20(t: Inputs) -> DataFrame:
    return t.documents.select("doc_id", X.csv_field(F.col("text")).alias("field"))
