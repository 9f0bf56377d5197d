"""What a text says: graded signals with quoted evidence, and vocabulary entries with their wording.

Both read each text once, inside its own row: sentences and matches are arrays,
so no shuffle is needed however long a text is or however many texts share a key.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from advertide.functions.text import (
    let,
    occurrences,
    plain_text,
    quote,
    sentence_at,
    shadow,
    split_flags,
    strip,
    word_key,
)


@dataclass(frozen=True)
class Tier:
    """Patterns that say the same thing equally firmly; a refusal is not weakened by negation."""

    signal: str
    rank: int
    patterns: tuple[str, ...]
    refusal: bool = False


@dataclass(frozen=True)
class SignalPack:
    tiers: tuple[Tier, ...]
    negators: str
    # Every pattern holds this text, so a sentence without it needs no further look.
    keyword: str
    refused: str = "EXCLUDED"
    refused_rank: int = 100
    silent: str = "NOT_MENTIONED"
    partial: str = "INDETERMINATE"
    # A negation counts within this many characters, in the same clause.
    before: int = 60
    after: int = 40


# The sponsorship pack. Tier order, pattern order and wording decide
# which phrase is quoted, so they are stated in full.
SPONSORSHIP = SignalPack(
    keyword="sponsor",
    negators=(
        r"(?i)\b(?:not|no|never|unable|cannot|can't|won't|will not|does not|do not|isn't|is not|"
        r"are not|without|ineligible for|unavailable)\b"
    ),
    tiers=(
        Tier(
            "EXCLUDED",
            100,
            (
                r"(?i)\bno (?:visa )?sponsorship\b",
                r"(?i)\bsponsorship (?:is |will )?(?:not|un)[- ]?(?:available|offered|provided|possible)\b",
                r"(?i)\bsponsorship (?:is )?not (?:being )?(?:offered|provided|available|considered)\b",
                r"(?i)\b(?:cannot|can not|can't|unable to|not able to|do not|does not|don't|will not|won't|not in a position to) sponsor\b",
                r"(?i)\b(?:cannot|can't|unable to|not able to|do not|does not|don't|will not|won't) (?:offer|provide) (?:visa )?sponsorship\b",
                r"(?i)\bnot (?:offering|providing) (?:visa )?sponsorship\b",
                r"(?i)\bsponsorship (?:is )?unavailable\b",
            ),
            refusal=True,
        ),
        Tier(
            "OFFERED",
            2,
            (
                r"(?i)\bsponsorship (?:is |are )?(?:available|offered|provided|included|supported)\b",
                r"(?i)\bsponsorship (?:is )?on offer\b",
                r"(?i)\bsponsorship will be (?:available|offered|provided)\b",
                r"(?i)\b(?:we|employer|company|organisation|client) (?:offer|offers|provide|provides) (?:full |visa )*sponsorship\b",
                r"(?i)\b(?:visa )?sponsorship (?:is )?(?:fully )?(?:available|provided) (?:for|to)\b",
            ),
        ),
        Tier(
            "OPEN_TO",
            1,
            (
                r"(?i)\b(?:willing|able|happy|prepared|keen|ready) to sponsor\b",
                r"(?i)\bopen to (?:sponsor|sponsoring|sponsorship)\b",
                r"(?i)\b(?:we|employer|company|organisation|client) (?:can|will) sponsor\b",
                r"(?i)\b(?:we|employer|company|organisation|client) sponsor\b",
                r"(?i)\bcan (?:offer|provide) (?:visa )?sponsorship\b",
                r"(?i)\bsponsorship can be (?:available|offered|provided|arranged)\b",
                r"(?i)\bwill (?:offer|provide) (?:visa )?sponsorship\b",
            ),
        ),
        Tier(
            "MAY_BE_CONSIDERED",
            0,
            (
                r"(?i)\bsponsorship (?:may|might|could) be (?:available|offered|provided|considered|discussed|arranged|possible)\b",
                r"(?i)\bsponsorship (?:will |may |can |would )?be considered\b",
                r"(?i)\bsponsorship (?:is |are )?(?:being )?considered\b",
                r"(?i)\b(?:may|might|could|would) (?:be able to |consider(?:ing)? )?sponsor\b",
                r"(?i)\b(?:consider|considering|consideration of) (?:visa )?sponsorship\b",
                r"(?i)\bsponsorship (?:is )?(?:possible|negotiable|an option)\b",
                r"(?i)\bsponsorship\b[^.!?]{0,40}\bcase[- ]by[- ]case\b",
                r"(?i)\bsponsor(?:ship)?\b[^.!?]{0,60}\bfor the right (?:candidate|person|applicant|individual)\b",
                r"(?i)\bfor the right (?:candidate|person|applicant|individual)\b[^.!?]{0,60}\bsponsor(?:ship)?\b",
            ),
        ),
        Tier(
            "MAY_BE_CONSIDERED",
            0,
            (
                r"(?i)\bvisa sponsorship\b",
                r"(?i)\bsponsorship (?:of |for )?(?:a )?(?:visa|482|494|491|186|187|485)\b",
                r"(?i)\b(?:482|494|491|186|187)\s*(?:visa )?(?:nomination|sponsorship)\b",
                r"(?i)\bsponsor(?:ed|ship) (?:for )?(?:eligible |suitable |skilled )?(?:candidates?|applicants?|workers?|migrants?)\b",
                r"(?i)\b(?:TSS|DAMA|ENS|RSMS)\b[^.!?]{0,30}\bsponsor",
                r"(?i)\bsponsor[^.!?]{0,30}\b(?:TSS|DAMA|ENS|RSMS)\b",
            ),
        ),
    ),
)


def _negated(sentence: Column, start: Column, end: Column, pack: SignalPack) -> Column:
    low = F.greatest(F.lit(0), start - pack.before)
    before = F.regexp_extract(F.substring(sentence, low + 1, start - low), r"([^.;:!?]*)\z", 1)
    after = F.regexp_extract(F.substring(sentence, end + 1, F.lit(pack.after)), r"^([^.;:!?]*)", 1)
    return before.rlike(pack.negators) | after.rlike(pack.negators)


def _labelled(tier_no: int, pattern_no: int, tier: Tier):
    """A hit with what its pattern stands for."""
    return lambda hit: F.struct(
        F.lit(tier_no).alias("tier"),
        F.lit(pattern_no).alias("pattern"),
        hit["start"].alias("start"),
        hit["end"].alias("end"),
        F.lit(tier.rank).alias("rank"),
        F.lit(tier.signal).alias("signal"),
        F.lit(tier.refusal).alias("refusal"),
    )


def _readings(sentence: Column, pack: SignalPack) -> Column:
    """Every match in one sentence with its weight, its place in the order met and its signal."""
    hits = F.concat(
        *[
            F.transform(occurrences(sentence, pattern), _labelled(tier_no, pattern_no, tier))
            for tier_no, tier in enumerate(pack.tiers)
            for pattern_no, pattern in enumerate(tier.patterns)
        ]
    )

    def read(hit: Column) -> Column:
        # The least struct is the highest rank, then the first met.
        def place(refused: Column) -> Column:
            return F.struct(
                F.when(refused, -pack.refused_rank).otherwise(-hit["rank"]).alias("weight"),
                hit["tier"].alias("tier"),
                hit["pattern"].alias("pattern"),
                hit["start"].alias("start"),
                F.when(refused, pack.refused).otherwise(hit["signal"]).alias("signal"),
                hit["end"].alias("end"),
            )

        return let(hit["refusal"] | _negated(sentence, hit["start"], hit["end"], pack), place)

    return F.transform(hits, read)


def detect_signal(text: Column, is_excerpt: Column, pack: SignalPack = SPONSORSHIP) -> Column:
    """struct(signal, evidence array<struct(phrase, sentence)>) of a text.

    The firmest wording of a sentence speaks for it, the weakest sentence speaks
    for the text, and one refusal settles it.
    """
    # A terminator closes a sentence, so the pieces are exactly the sentences.
    pieces = lambda whole: F.regexp_extract_all(whole, F.lit(r"([^.!?]*[.!?]|[^.!?]+\z)"), F.lit(1))
    sentences = let(
        plain_text(text),
        lambda plain: F.zip_with(
            pieces(plain), pieces(shadow(plain)), lambda s, dark: F.struct(s.alias("s"), dark.alias("dark"))
        ),
    )

    def judge(sentence: Column, dark: Column, position: Column) -> Column:
        def weigh(readings: Column) -> Column:
            first = F.array_min(
                F.transform(readings, lambda r: F.struct(r["tier"], r["pattern"], position, r["start"]))
            )
            return let(
                F.array_min(readings),
                lambda best: F.when(
                    best.isNotNull(),
                    F.struct(
                        first.alias("met"),
                        best["weight"].alias("weight"),
                        best["signal"].alias("signal"),
                        F.trim(F.substring(sentence, best["start"] + 1, best["end"] - best["start"])).alias("phrase"),
                        quote(sentence, F.lit(0), F.length(sentence), best["start"], best["end"]).alias(
                            "sentence"
                        ),
                    ),
                ),
            )

        return let(_readings(dark, pack), weigh)

    keyword = F.lit(pack.keyword.lower())
    holding = F.filter(
        F.transform(
            sentences,
            lambda e, i: F.when(
                F.contains(F.lower(e["s"]), keyword),
                F.struct(e["s"].alias("s"), e["dark"].alias("dark"), i.alias("i")),
            ),
        ),
        lambda e: e.isNotNull(),
    )
    findings = F.array_sort(
        F.filter(F.transform(holding, lambda e: judge(e["s"], e["dark"], e["i"])), lambda f: f.isNotNull())
    )
    none = F.array().cast("array<struct<phrase:string,sentence:string>>")
    quiet = F.when(is_excerpt, pack.partial).otherwise(pack.silent)

    def settle(found: Column) -> Column:
        # Weight is minus rank: a refusal is the least weight, the weakest wording the greatest.
        weights = F.transform(found, lambda f: f["weight"])
        refused = F.array_min(weights) == -pack.refused_rank
        settled = F.when(refused, F.array_min(weights)).otherwise(F.array_max(weights))
        return let(
            F.filter(found, lambda f: f["weight"] == settled),
            lambda spoken: F.struct(
                F.coalesce(F.try_element_at(spoken, F.lit(1))["signal"], quiet).alias("signal"),
                F.transform(
                    spoken,
                    lambda f: F.struct(f["phrase"].alias("phrase"), f["sentence"].alias("sentence")),
                ).alias("evidence"),
            ),
        )

    def without(signal: Column) -> Column:
        return F.struct(signal.alias("signal"), none.alias("evidence"))

    return (
        F.when(text.isNull() | (strip(text) == ""), without(F.lit(pack.partial)))
        # Entities and tags can hide the keyword; only a text without any is settled by its raw form.
        .when(~F.contains(F.lower(text), F.lit(pack.keyword.lower())) & ~text.rlike("[&<]"), without(quiet))
        .otherwise(let(findings, settle))
    )


@dataclass(frozen=True)
class Entry:
    """One vocabulary entry: any of the patterns attaches it.

    ``hints`` are lower-case texts of which any match holds at least one; a text
    without them is not searched. Without hints every text is.
    """

    name: str
    key: str
    kind: str
    patterns: tuple[str, ...]
    hints: tuple[str, ...] = ()


# The skill vocabulary, in the order skills are listed.
SKILLS = (
    Entry("AHPRA registration", "ahpra-registration", "CERTIFICATION", (r"(?i)\bAHPRA\b", r"(?i)\bAustralian Health Practitioner Regulation Agency\b"), ("ahpra", "health practitioner")),
    Entry(
        "Working with Children Check", "working-with-children-check", "CERTIFICATION",
        (
            r"(?i)\bblue card\b",
            r"\bWWCC\b",
            r"(?i)\bworking with children(?:'?s)? (?:check|card|clearance|screening)\b",
            r"(?i)\bworking with children\b[^.!?]{0,12}\bblue\b",
        ),
        ("blue card", "wwcc", "with children"),
    ),
    Entry(
        "Driver's licence", "drivers-licence", "CERTIFICATION",
        (
            r"(?i)\b(?:driver'?s?|drivers) (?:licence|license)\b",
            r"""(?i)\b(?:open )?["'“‘]?C["'”’]? ?class (?:driver'?s? )?(?:licence|license)\b""",
            r"(?i)\bclass C \(car\)",
        ),
        ("licence", "license", "class c"),
    ),
    Entry("Criminal history check", "criminal-history-check", "CERTIFICATION", (r"(?i)\b(?:criminal history|police|national police) (?:check|clearance|screening)\b",), ("check", "clearance", "screening")),
    Entry("First aid certificate", "first-aid-certificate", "CERTIFICATION", (r"(?i)\bfirst aid\b",), ("first aid",)),
    Entry("Forklift licence", "forklift-licence", "CERTIFICATION", (r"(?i)\bforklift\b",), ("forklift",)),
    Entry("NDIS Worker Screening Check", "ndis-worker-screening-check", "CERTIFICATION", (r"(?i)\bNDIS worker(?:s)? (?:screening|check)\b",), ("ndis",)),
    Entry("Responsible Service of Alcohol", "responsible-service-of-alcohol", "CERTIFICATION", (r"(?i)\bresponsible service of alcohol\b", r"\bRSA\b"), ("alcohol", "rsa")),
    Entry("Yellow Card", "yellow-card", "CERTIFICATION", (r"(?i)\byellow card\b",), ("yellow card",)),
    Entry("CPR certificate", "cpr-certificate", "CERTIFICATION", (r"\bCPR\b", r"(?i)\bcardiopulmonary resuscitation\b"), ("cpr", "cardiopulmonary")),
    Entry(
        "Heavy vehicle licence", "heavy-vehicle-licence", "CERTIFICATION",
        (r"\b(?:HR|MR|HC|MC) (?:class )?(?:truck )?(?:licence|license)\b", r"(?i)\bheavy (?:rigid|combination) (?:licence|license)\b"),
        ("licence", "license"),
    ),
    Entry("Construction White Card", "construction-white-card", "CERTIFICATION", (r"(?i)\bwhite card\b", r"(?i)\bconstruction induction (?:card|training)\b"), ("white card", "induction")),
    Entry(
        "Microsoft Excel", "microsoft-excel", "TOOL",
        (
            r"(?i)\bmicrosoft excel\b",
            r"(?i)\bMS ?Excel\b",
            r"(?i)\bexcel\b(?=[^.!?]{0,60}\b(?:word|outlook|powerpoint|spreadsheets?|microsoft|office)\b)",
            r"(?i)\b(?:word|outlook|powerpoint|spreadsheets?|microsoft|office)\b[^.!?]{0,60}\bexcel\b",
        ),
        ("excel",),
    ),
    Entry("Microsoft Office", "microsoft-office", "TOOL", (r"(?i)\bmicrosoft office\b", r"(?i)\bMS ?Office\b", r"(?i)\bOffice 365\b"), ("office",)),
    Entry("SAP", "sap", "TOOL", (r"\bSAP\b",), ("sap",)),
    Entry("ServiceNow", "servicenow", "TOOL", (r"(?i)\bServiceNow\b",), ("servicenow",)),
    Entry("Power BI", "power-bi", "TOOL", (r"(?i)\bpower ?BI\b",), ("power",)),
    Entry("Microsoft Azure", "microsoft-azure", "TOOL", (r"(?i)\bAzure\b",), ("azure",)),
    Entry("Salesforce", "salesforce", "TOOL", (r"(?i)\bSalesforce\b",), ("salesforce",)),
    Entry("Amazon Web Services", "amazon-web-services", "TOOL", (r"\bAWS\b", r"(?i)\bAmazon Web Services\b"), ("aws", "amazon")),
    Entry("SQL", "sql", "TECHNICAL", (r"\bSQL\b",), ("sql",)),
    Entry("Python", "python", "TECHNICAL", (r"\bPython\b",), ("python",)),
)


def _first_match(dark: Column, pattern: str) -> Column:
    """struct(start, length) of the first match of a pattern that the text holds.

    The match is looked for as it stands: behind a reluctant prefix every place before it costs many times as much.
    """
    flags, body = split_flags(pattern)
    # An empty match at the front leaves no piece before it, so empty ones are placed by their prefix.
    prefix = F.regexp_extract(dark, f"{flags}^([\\s\\S]*?)({body})", 1)
    return let(
        F.length(F.regexp_extract(dark, pattern, 0)),
        lambda length: F.struct(
            F.length(F.when(length == 0, prefix).otherwise(F.split(dark, pattern, 2)[0])).alias("start"),
            length.alias("length"),
        ),
    )


def earliest_match(dark: Column, entry: Entry) -> Column:
    """struct(start, order, end) of the first match of an entry, null when absent."""

    def placed(order: int):
        return lambda m: F.struct(m["start"].alias("start"), F.lit(order).alias("order"), (m["start"] + m["length"]).alias("end"))

    hits = [F.when(dark.rlike(pattern), let(_first_match(dark, pattern), placed(order))) for order, pattern in enumerate(entry.patterns)]
    return F.array_min(F.array(*hits))


def own_name(entry_name: str, company: Column) -> Column:
    """True where the entry is part of the advertiser's own name."""
    padded = F.concat(F.lit(" "), word_key(company), F.lit(" "))
    words = F.concat(F.lit(" "), word_key(F.lit(entry_name)), F.lit(" "))
    return F.coalesce((word_key(F.lit(entry_name)) != "") & F.contains(padded, words), F.lit(False))


def _attacher(joined: Column, position: int, entry: Entry):
    def attach(hit: Column) -> Column:
        wording = F.substring(joined, hit["start"] + 1, hit["end"] - hit["start"])
        return F.struct(
            F.lit(position).alias("position"),
            F.lit(entry.key).alias("key"),
            F.lit(entry.name).alias("name"),
            F.lit(entry.kind).alias("kind"),
            F.trim(wording).alias("matched_text"),
            sentence_at(joined, hit["start"], hit["end"]).alias("sentence"),
        )

    return attach


def vocabulary_matches(
    joined: Column, dark: Column, lowered: Column, company: Column, vocabulary: tuple[Entry, ...]
) -> Column:
    """array<struct(position, key, name, kind, matched_text, sentence)>, one per entry found.

    ``joined`` is the text, ``dark`` its shadow and ``lowered`` the lower-case shadow.
    """
    found = []
    for position, entry in enumerate(vocabulary):
        present = dark.rlike("|".join(f"(?:{p})" for p in entry.patterns))
        if entry.hints:
            hinted = F.contains(lowered, F.lit(entry.hints[0]))
            for hint in entry.hints[1:]:
                hinted = hinted | F.contains(lowered, F.lit(hint))
            present = hinted & present
        match = let(earliest_match(dark, entry), _attacher(joined, position, entry))
        found.append(F.when(present & ~own_name(entry.name, company), match))
    return F.filter(F.array(*found), lambda m: m.isNotNull())


@lru_cache(maxsize=32)
def _vocabulary_found(vocabulary: tuple[Entry, ...]) -> Column:
    """The matches of a vocabulary over the columns ``with_vocabulary`` adds; thousands of calls, so built once."""
    return vocabulary_matches(F.col("joined_text"), F.col("dark_text"), F.col("lowered_text"), F.col("company_name"), vocabulary)


@lru_cache(maxsize=32)
def signal_of(text: str, is_excerpt: str, pack: SignalPack = SPONSORSHIP) -> Column:
    """``detect_signal`` over two named columns, built once for each pack."""
    return detect_signal(F.col(text), F.col(is_excerpt), pack)


def with_vocabulary(jobs: DataFrame, vocabulary: tuple[Entry, ...]) -> DataFrame:
    """Advertisements with their vocabulary matches; each text is joined, blotted and lowered once."""
    joined, dark = F.col("joined_text"), F.col("dark_text")
    return (
        jobs.withColumn("joined_text", combined_text(F.col("title"), F.col("description")))
        .withColumn("dark_text", shadow(joined))
        .withColumn("lowered_text", F.lower(dark))
        .withColumn("found", _vocabulary_found(vocabulary))
        .drop("joined_text", "dark_text", "lowered_text")
    )


def combined_text(title: Column, description: Column) -> Column:
    """Title and description as one plain text with a sentence break between them."""
    return plain_text(F.concat(title, F.lit(" . "), F.coalesce(description, F.lit(""))))
