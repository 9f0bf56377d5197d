"""Keys, markup removal and sentence lookup as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space a browser engine calls white space. Java's \s
# leaves out the no-break space and the other Unicode blanks.
BLANK = r"\s\x{00a0}\x{feff}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

# Accented letters and the plain letter each is keyed under.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćčďēĕęěģīįłńňōőřśšťūůűźżž"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyaaaccdeeeegiilnnoorsstuuuzzz"

# Named entities and what each stands for, in the order applied.
ENTITIES = (
    ("&nbsp;", " "),
    ("&amp;", "&"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&apos;", "'"),
    ("&lt;", "<"),
    ("&gt;", ">"),
)
PAGE_ENTITIES = (
    ("&nbsp;", " "),
    ("&ndash;", "–"),
    ("&mdash;", "—"),
    ("&hellip;", "…"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&apos;", "'"),
    ("&lt;", "<"),
    ("&gt;", ">"),
)

# A private-use character no text carries.
MARK = "\ue000"

LONGEST_SENTENCE = 320
EXCERPT_RADIUS = 110


# A word edge between ASCII word characters and anything else. Java's own \\b takes
# accented letters for word characters on some releases and not on others.
WORD_EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def ascii_edges(pattern: str) -> str:
    """A pattern whose word edges mean the same on every Java release."""
    return pattern.replace(r"\b", WORD_EDGE)


def shadow(text: Column) -> Column:
    """The text with every letter, digit and mark outside ASCII blotted out, character for character.

    Patterns run on the shadow, where the plain word edge is an ASCII one, and
    their positions hold in the text itself.
    """
    return F.regexp_replace(text, r"[\p{L}\p{N}\p{M}&&[^\x00-\x7f]]", "•")


def let(value: Column, body) -> Column:
    """``body`` of a value worked out once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def split_flags(pattern: str) -> tuple[str, str]:
    return ("(?i)", pattern[4:]) if pattern.startswith("(?i)") else ("", pattern)


def occurrences(text: Column, pattern: str) -> Column:
    """array<struct(start, end)> of every match, 0-based, in order."""
    # The pieces between matches and the matches themselves alternate, so positions are running sums.
    gaps = F.transform(F.split(text, pattern, -1), lambda gap: F.length(gap))
    hits = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda hit: F.length(hit))
    lengths = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def extend(done: Column, pair: Column) -> Column:
        start = F.coalesce(F.try_element_at(done, F.lit(-1))["end"], F.lit(0)) + pair["gap"]
        return F.concat(done, F.array(F.struct(start.alias("start"), (start + pair["hit"]).alias("end"))))

    return F.when(text.rlike(pattern), F.aggregate(lengths, empty, extend)).otherwise(empty)


def squeeze(text: Column) -> Column:
    """Runs of blanks become one space; none at either end."""
    # One space between two words is what it shall be, and most characters are no blank by the first range asked.
    return F.trim(F.regexp_replace(text, rf"(?! [!-~])[[^!-~]&&[{BLANK}]]+", " "))


def strip(text: Column) -> Column:
    """Remove blanks, in the wide sense, from both ends."""
    return F.regexp_replace(text, rf"^[{BLANK}]+|[{BLANK}]+\z", "")


def word_key(text: Column) -> Column:
    """Lower-case ASCII words split by single spaces: company, title, name and header keys."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def dash_key(text: Column) -> Column:
    """Lower-case ASCII words joined by dashes: location keys and slugs."""
    return F.regexp_replace(
        F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", ""
    )


def area_slug(name: Column) -> Column:
    """Slug with accents removed, composed or combining."""
    bare = F.regexp_replace(F.translate(F.lower(name), ACCENTED, PLAIN), r"[\x{0300}-\x{036f}]", "")
    return dash_key(bare)


def code_key(code: Column) -> Column:
    return F.regexp_replace(F.upper(code), f"[{BLANK}]+", "")


def empty_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def url_key(url: Column) -> Column:
    """Host and path of an http address, or null when there is none to compare."""
    scheme = F.lower(F.try_parse_url(url, F.lit("PROTOCOL")))
    host = F.try_parse_url(url, F.lit("HOST"))
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    return F.when(
        scheme.isin("http", "https") & host.isNotNull() & (host != ""),
        F.concat(
            F.regexp_replace(F.lower(host), r"^www\.", ""),
            F.regexp_replace(path, "/+$", ""),
        ),
    )


def _character(code: Column) -> Column:
    """The character at a code point given as a number."""
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


def _swap_numeric(text: Column, pattern: str, read) -> Column:
    """Replace every numeric entity in one pass; a code that names no character stays as written."""

    def swap(gap: Column, entity: Column) -> Column:
        code = read(F.regexp_extract(entity, pattern, 1))
        named = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        return F.concat(gap, F.when(named, _character(code)).otherwise(F.coalesce(entity, F.lit(""))))

    def rewrite(text: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        entities = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        swapped = F.array_join(F.zip_with(gaps, entities, swap), "")
        return F.when(text.rlike(pattern), swapped).otherwise(text)

    return let(text, rewrite)


def _decimal(digits: Column) -> Column:
    return digits.try_cast("bigint")


def _hexadecimal(digits: Column) -> Column:
    return F.conv(digits, 16, 10).try_cast("bigint")


def plain_text(html: Column) -> Column:
    """Tags to spaces, entities to characters, blanks squeezed."""
    text = F.regexp_replace(html, "<[^>]*>", " ")
    for entity, character in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(character))
    text = _swap_numeric(text, r"&#(\d+);", _decimal)
    text = _swap_numeric(text, r"(?i)&#x([0-9a-f]+);", _hexadecimal)
    return squeeze(text)


def feed_text(html: Column) -> Column:
    """Feed wording: the few known entities are read, any other becomes a space."""
    text = F.regexp_replace(html, "<[^>]*>", " ")
    for entity, character in ENTITIES:
        if entity != "&amp;":
            text = F.regexp_replace(text, f"(?i){entity}", character)
    # Ampersands last, by way of a private mark, so none decoded here is read twice.
    text = F.regexp_replace(text, "(?i)&amp;", MARK)
    text = F.regexp_replace(text, "(?i)&[a-z#0-9]+;", " ")
    return squeeze(F.translate(text, MARK, "&"))


def page_entities(html: Column) -> Column:
    text = html
    for entity, character in PAGE_ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(character))
    text = _swap_numeric(text, r"&#(\d+);", _decimal)
    return F.replace(text, F.lit("&amp;"), F.lit("&"))


def page_text(html: Column) -> Column:
    return squeeze(page_entities(F.regexp_replace(html, "<[^>]*>", " ")))


def split_places(text: Column) -> Column:
    """Comma-separated place names, trimmed, blanks left out."""
    parts = F.transform(F.split(page_entities(text), ","), lambda part: F.trim(part))
    return F.filter(parts, lambda part: part != "")


def heading_title(heading: Column) -> Column:
    """What stands before the last comma; the whole heading where there is none."""
    return F.trim(F.regexp_replace(heading, r",[^,]*\z", ""))


def heading_employer(heading: Column) -> Column:
    """What stands after the last comma, null where that is nothing."""
    tail = F.trim(F.regexp_extract(heading, r",([^,]*)\z", 1))
    return empty_to_null(tail)


def sentence_from(text: Column, start: Column) -> Column:
    """How many characters precede the sentence that holds the 0-based position ``start``."""
    before = F.substring(text, F.lit(1), start)
    return F.length(F.regexp_extract(before, r"^([\s\S]*[.!?])", 1))


def sentence_to(text: Column, end: Column) -> Column:
    """The 0-based end (exclusive) of the sentence that holds the position ``end``."""
    after = F.substring(text, end + 1, F.length(text))
    gap = F.length(F.regexp_extract(after, r"^([^.!?]*)", 1))
    return F.least(end + gap + 1, F.length(text))


def quote(text: Column, first: Column, last: Column, start: Column, end: Column) -> Column:
    """The sentence [first, last), or a marked window round [start, end) when it is too long."""
    low = F.greatest(first, start - EXCERPT_RADIUS)
    high = F.least(last, end + EXCERPT_RADIUS)
    window = F.concat(
        F.when(low > first, F.lit("…")).otherwise(F.lit("")),
        strip(F.substring(text, low + 1, high - low)),
        F.when(high < last, F.lit("…")).otherwise(F.lit("")),
    )
    whole = strip(F.substring(text, first + 1, last - first))
    return F.when(last - first > LONGEST_SENTENCE, window).otherwise(whole)


def sentence_at(text: Column, start: Column, end: Column) -> Column:
    """The sentence round a match at 0-based [start, end)."""
    bounds = F.struct(sentence_from(text, start).alias("first"), sentence_to(text, end).alias("last"))
    return let(bounds, lambda b: quote(text, b["first"], b["last"], start, end))


def four_digit_postcode(raw: Column) -> Column:
    code = F.trim(raw)
    return F.when(code.rlike(r"^[0-9]{4}\z"), code)


# Wording that would pass an advertisement index off as a vacancy count.
FORBIDDEN_WORDING = (
    "total vacancies",
    "total job vacancies",
    "total number of vacancies",
    "all vacancies",
    "all job vacancies",
    "all jobs in australia",
    "all australian jobs",
    "every job",
    "every vacancy",
    "jobs available",
    "total jobs",
)


def wording_violations(label: Column, phrases: tuple[str, ...] = FORBIDDEN_WORDING) -> Column:
    """The forbidden phrases a label contains, in the order they are listed."""
    said = F.regexp_replace(F.lower(label), f"[{BLANK}]+", " ")
    listed = F.array(*[F.lit(phrase) for phrase in phrases])
    return F.filter(listed, lambda phrase: F.contains(said, phrase))


def csv_field(value: Column) -> Column:
    """One field of a comma-separated line: null is empty, quotes only where needed."""
    text = value.cast("string")
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.coalesce(F.when(text.rlike('[",\n\r]'), quoted).otherwise(text), F.lit(""))
