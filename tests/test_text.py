import random
import re

import pytest
from pyspark.sql import functions as F

from advertide.functions import periods as P
from advertide.functions import redaction as R
from advertide.functions import text as X
from advertide.functions import wording as W

ENTITY_CASES = {
    "<p>Fish &amp; chips</p>": "Fish & chips",
    "a&nbsp;b  c": "a b c",
    "&#8211;&#x2013;": "––",
    "&#38;#60;": "&#60;",
    "&#0; &#1114112; &#55296;": "&#0; &#1114112; &#55296;",
    "&lt;b&gt;": "<b>",
    "&#128512; ok": "😀 ok",
}


def column(spark, values, build):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [row[0] for row in df.orderBy("i").select(build(F.col("t"))).collect()]


def test_plain_text(spark):
    assert column(spark, ENTITY_CASES, X.plain_text) == list(ENTITY_CASES.values())


def test_feed_text_reads_known_entities_once(spark):
    cases = {"&amp;lt; x": "&lt; x", "a&copy;b": "a b", "<b>A</b>&AMP;B": "A &B", "&quot;q&quot;": '"q"'}
    assert column(spark, cases, X.feed_text) == list(cases.values())


def test_keys(spark):
    assert column(spark, ["  Acme & Sons, P/L "], X.word_key) == ["acme sons p l"]
    assert column(spark, ["-- Côte d'Or --"], X.area_slug) == ["cote-d-or"]
    assert column(spark, ["Café"], X.area_slug) == ["cafe"]
    assert column(spark, [" n 1 2 "], X.code_key) == ["N12"]


@pytest.mark.parametrize(
    "url, key",
    [
        ("https://www.Example.com/jobs/1/?utm=2#x", "example.com/jobs/1"),
        ("HTTP://example.com", "example.com"),
        ("ftp://example.com/a", None),
        ("nope", None),
        ("", None),
        (None, None),
    ],
)
def test_url_key(spark, url, key):
    assert column(spark, [url], X.url_key) == [key]


def test_sentence_round_a_match(spark):
    long = "x" * 400
    df = spark.createDataFrame([("One. Two three! Four", 5, 8), (f"A. {long} hit {long}", 404, 407)], "t string, a int, b int")
    got = [r[0] for r in df.select(X.sentence_at(F.col("t"), F.col("a"), F.col("b"))).collect()]
    assert got[0] == "Two three!"
    assert got[1].startswith("…x") and got[1].endswith("x…") and " hit " in got[1] and len(got[1]) == 2 + 110 + 3 + 110


@pytest.mark.parametrize(
    "label, expected",
    [
        ("Jan-06", ("2006-01-01", "MONTH")),
        ("January 2006", ("2006-01-01", "MONTH")),
        ("sept/79", ("2079-09-01", "MONTH")),
        ("Dec 80", ("1980-12-01", "MONTH")),
        ("2006-1", ("2006-01-01", "MONTH")),
        ("2006/13", None),
        ("Q3 2006", ("2006-07-01", "QUARTER")),
        ("2006 q4", ("2006-10-01", "QUARTER")),
        ("2006", ("2006-01-01", "YEAR")),
        ("1899", None),
        ("12", None),
        ("State", None),
        ("Foo-06", None),
    ],
)
def test_period_labels(spark, label, expected):
    (got,) = column(spark, [label], P.parse_period)
    assert (None if got is None else (got[0].isoformat(), got[1])) == expected


@pytest.mark.parametrize(
    "cell, expected",
    [
        (None, ("UNAVAILABLE", None, None)),
        ("  ", ("UNAVAILABLE", None, None)),
        ("0", ("ZERO", 0.0, None)),
        ("1,234", ("PRESENT", 1234.0, None)),
        ("1 234.5", ("PRESENT", 1234.5, None)),
        ("-3", ("PRESENT", -3.0, None)),
        ("NP", ("SUPPRESSED", None, None)),
        ("n.p.", ("SUPPRESSED", None, None)),
        ("..", ("NOT_COVERED", None, None)),
        ("-", (None, None, "-")),
        ("n/a", (None, None, "n/a")),
        ("NaN", (None, None, "NaN")),
    ],
)
def test_value_cells(spark, cell, expected):
    assert tuple(column(spark, [cell], P.read_value)[0]) == expected


def test_consistency_of_value_and_state(spark):
    rows = [(1.0, "PRESENT"), (None, "PRESENT"), (0.0, "ZERO"), (2.0, "ZERO"), (None, "SUPPRESSED"), (1.0, "SUPPRESSED"), (None, "OTHER")]
    df = spark.createDataFrame(rows, "v double, s string").select(P.is_consistent(F.col("v"), F.col("s")))
    assert [r[0] for r in df.collect()] == [True, False, True, False, True, False, False]


def test_change_between_periods(spark):
    df = spark.createDataFrame([(110.0, 100.0), (0.0, 0.0), (5.0, 0.0), (None, 1.0), (1.0, 2.0)], "a double, b double")
    got = [r[0] for r in df.select(P.change_struct(F.col("a"), F.col("b"))).collect()]
    assert [None if g is None else tuple(g) for g in got] == [
        (10.0, 10.0, "UP"),
        (0.0, None, "FLAT"),
        (5.0, None, "UP"),
        None,
        (-1.0, -50.0, "DOWN"),
    ]


# --- redaction, against a plain span search -------------------------------------------------


def spans_removed(text):
    taken = []
    for rule in R.CONTACT_RULES:
        for match in re.finditer(rule.pattern, text, re.ASCII):
            if all(match.end() <= a or match.start() >= b for a, b, _ in taken):
                taken.append((match.start(), match.end(), rule.placeholder))
    out = text
    for start, end, mark in sorted(taken, reverse=True):
        out = out[:start] + mark + out[end:]
    return out, len(taken)


def test_redaction_equals_span_search(spark):
    pieces = [
        "0412 345 678", "(07) 3123 4567", "+61 2 9123 4567", "+61(2)91234567", "1300 123 456", "13 12 34", "131234", "13 12 34 5",
        "a.b@c.com.au", "éa.b@c.org", "x@y", "10041234567812", "call", " ", "-", ".", "0", "12", "07", "1800.123.456", "[email removed]",
    ]
    rng = random.Random(7)
    texts = ["".join(rng.choice(pieces) + rng.choice(["", " ", " ", "\n"]) for _ in range(rng.randint(1, 9))) for _ in range(600)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    for text, out, count, has in df.select("t", R.redact(t), R.removals(t), R.has_contact(t)).collect():
        expected, n = spans_removed(text)
        assert (out, count, has) == (expected, n, n > 0), text


def test_redaction_is_stable(spark):
    once = column(spark, ["mail a@b.com or 0412 345 678"], R.redact)
    assert once == column(spark, once, R.redact) == ["mail [email removed] or [phone number removed]"]


# --- graded signal, against a direct reading ------------------------------------------------


def read_signal(text, is_excerpt, pack):
    """Match by match over the whole text, then per sentence, then per text."""
    if text is None or not text.strip():
        return pack.partial, []
    plain = " ".join(text.split())
    per_sentence = {}
    met = 0
    for tier in pack.tiers:
        for pattern in tier.patterns:
            for match in re.finditer(pattern, plain, re.ASCII):
                a, b = match.span()
                low = max((plain.rfind(c, 0, a) for c in ".!?")) + 1
                ends = [i for i in (plain.find(c, b) for c in ".!?") if i >= 0]
                high = min(ends) + 1 if ends else len(plain)
                before = re.split(r"[.;:!?]", plain[max(0, a - 60) : a])[-1]
                after = re.split(r"[.;:!?]", plain[b : b + 40])[0]
                refused = tier.refusal or any(re.search(pack.negators, part, re.ASCII) for part in (before, after))
                rank = 100 if refused else tier.rank
                entry = (rank, pack.refused if refused else tier.signal, match.group().strip(), plain[low:high].strip())
                met += 1
                if (low, high) not in per_sentence:
                    per_sentence[low, high] = entry
                elif rank > per_sentence[low, high][0]:
                    per_sentence[low, high] = entry
    if not per_sentence:
        return (pack.partial if is_excerpt else pack.silent), []
    entries = list(per_sentence.values())
    ranks = [e[0] for e in entries]
    settled = 100 if 100 in ranks else min(ranks)
    kept = [e for e in entries if e[0] == settled]
    return kept[0][1], [(e[2], e[3]) for e in kept]


@pytest.mark.parametrize(
    "text, excerpt, signal",
    [
        ("We offer visa sponsorship.", False, "OFFERED"),
        ("Sponsorship is available for the right candidate.", False, "OFFERED"),
        ("We are willing to sponsor. Sponsorship may be considered.", False, "MAY_BE_CONSIDERED"),
        ("No sponsorship. We are open to sponsorship.", False, "EXCLUDED"),
        ("We are not able to sponsor at this time", False, "EXCLUDED"),
        ("Great team.", False, "NOT_MENTIONED"),
        ("Great team.", True, "INDETERMINATE"),
        ("  ", False, "INDETERMINATE"),
        (None, False, "INDETERMINATE"),
        ("We proudly sponsor the local club.", False, "OPEN_TO"),
        ("482 visa sponsorship", True, "MAY_BE_CONSIDERED"),
    ],
)
def test_signal_cases(spark, text, excerpt, signal):
    expected = read_signal(text, excerpt, W.SPONSORSHIP)
    got = column(spark, [text], lambda t: W.detect_signal(t, F.lit(excerpt)))[0]
    assert (got[0], [tuple(e) for e in got[1]]) == expected
    if "proudly" not in (text or ""):
        assert got[0] == signal


def test_signal_equals_direct_reading(spark):
    words = (
        "we the company will can not no never cannot offer offers provide visa sponsorship sponsor sponsored is are not available "
        "offered considered may be on offer open to willing sponsoring unavailable without for right candidate 482 nomination TSS "
        "case by case possible café équipe . . ! ? ; :"
    ).split(" ")
    rng = random.Random(11)
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(3, 60))) for _ in range(400)]
    df = spark.createDataFrame([(t, i % 2 == 0) for i, t in enumerate(texts)], "t string, e boolean")
    for text, excerpt, got in df.select("t", "e", W.detect_signal(F.col("t"), F.col("e"))).collect():
        expected = read_signal(text, excerpt, W.SPONSORSHIP)
        # Long sentences are quoted as a window, which this reading does not cut.
        if all(len(s) <= 320 for _, s in expected[1]):
            assert (got[0], [tuple(e) for e in got[1]]) == expected, text


# --- vocabulary ----------------------------------------------------------------------------


def read_skills(title, description, company, vocabulary):
    text = " ".join(f"{title} . {description or ''}".split())
    found = {}
    padded = f" {' '.join(re.findall('[a-z0-9]+', (company or '').lower()))} "
    for entry in vocabulary:
        name = f" {' '.join(re.findall('[a-z0-9]+', entry.name.lower()))} "
        if name in padded:
            continue
        hits = [m for p in entry.patterns for m in [re.search(p, text, re.ASCII)] if m]
        if hits:
            found[entry.key] = min(hits, key=lambda m: m.start()).group().strip()
    return found


def test_vocabulary_equals_direct_reading(spark):
    words = (
        "SQL sql Python python excel word Excel Microsoft Office SAP sap Power BI blue card Blue Card WWCC working with children check "
        "driver's licence C class licence first aid police check forklift RSA AWS Azure ServiceNow Salesforce HR licence café naïveSQL éSQL . , "
    ).split(" ")
    rng = random.Random(3)
    companies = [None, "ServiceNow, Inc.", "Salesforce", "SQL Services", "Acme"]
    rows = [
        (i, " ".join(rng.choice(words) for _ in range(4)), " ".join(rng.choice(words) for _ in range(rng.randint(0, 30))), rng.choice(companies))
        for i in range(300)
    ]
    df = spark.createDataFrame(rows, "i int, title string, description string, company_name string")
    for i, title, description, company, found in W.with_vocabulary(df, W.SKILLS).select("i", "title", "description", "company_name", "found").collect():
        assert {m["key"]: m["matched_text"] for m in found} == read_skills(title, description, company, W.SKILLS), (title, description)


def test_hints_cover_their_patterns():
    for entry in W.SKILLS:
        assert entry.hints and all(h == h.lower() for h in entry.hints)


def test_forbidden_wording_and_csv_fields(spark):
    assert column(spark, ["Total  Job\nVacancies", "Online advertisements"], X.wording_violations) == [["total job vacancies"], []]
    assert column(spark, ['a"b', "a,b", "a\nb", "ab", None], X.csv_field) == ['"a""b"', '"a,b"', '"a\nb"', "ab", ""]
