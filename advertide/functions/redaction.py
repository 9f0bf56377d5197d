"""Contact details out of stored text: spans found rule by rule, spliced out and counted."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from advertide.functions.text import ascii_edges, let, occurrences


@dataclass(frozen=True)
class Rule:
    """A shape to replace; ``hints`` are texts of which every match holds at least one."""

    kind: str
    pattern: str
    placeholder: str
    hints: tuple[str, ...] = ()


# Address and Australian telephone shapes, applied in this order,
# and the words that stand in for them.
EMAIL_MARK = "[email removed]"
PHONE_MARK = "[phone number removed]"
CONTACT_RULES = (
    Rule("EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}\b", EMAIL_MARK, ("@",)),
    Rule("PHONE", r"(?<!\d)\+61[ ()\-.]?\d(?:[ ()\-.]?\d){8}(?!\d)", PHONE_MARK, ("+61",)),
    Rule("PHONE", r"\(0[2-8]\)[ \-.]?\d{4}[ \-.]?\d{4}(?!\d)", PHONE_MARK, ("(0",)),
    Rule("PHONE", r"(?<!\d)0[23478](?:[ \-.]?\d){8}(?!\d)", PHONE_MARK, ("02", "03", "04", "07", "08")),
    Rule("PHONE", r"(?<!\d)1[38]00[ \-.]?\d{3}[ \-.]?\d{3}(?!\d)", PHONE_MARK, ("1300", "1800")),
    Rule("PHONE", r"(?<!\d)13[ \-.]?\d{2}[ \-.]?\d{2}(?![ \-.]?\d)", PHONE_MARK, ("13",)),
)


def _hinted(text: Column, rule: Rule) -> Column:
    """Whether a rule is worth running, by plain search."""
    if not rule.hints:
        return F.lit(True)
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(hint)) for hint in rule.hints])


def _spans(text: Column, rules: tuple[Rule, ...]) -> Column:
    """array<struct(start, end, mark)> to take out, in text order.

    Every rule reads the text as it came, so what stands beside a match is never
    a placeholder; a match that overlaps an earlier rule's is left out.
    """
    empty = F.array().cast("array<struct<start:int,end:int,mark:string>>")

    def marked(rule: Rule) -> Column:
        hits = F.transform(
            occurrences(text, ascii_edges(rule.pattern)),
            lambda hit: F.struct(hit["start"].alias("start"), hit["end"].alias("end"), F.lit(rule.placeholder).alias("mark")),
        )
        return F.when(_hinted(text, rule), hits).otherwise(empty)

    def take(taken: Column, hit: Column) -> Column:
        overlaps = F.exists(taken, lambda other: (hit["start"] < other["end"]) & (hit["end"] > other["start"]))
        return F.when(overlaps, taken).otherwise(F.concat(taken, F.array(hit)))

    return F.array_sort(F.aggregate(F.concat(*[marked(rule) for rule in rules]), empty, take))


def redaction(text: Column, rules: tuple[Rule, ...] = CONTACT_RULES) -> Column:
    """struct(text, removals): contact details replaced by their placeholders, and how many were."""

    def splice(spans: Column) -> Column:
        start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

        def step(done: Column, span: Column) -> Column:
            kept = F.substring(text, done["at"] + 1, span["start"] - done["at"])
            return F.struct(F.concat(done["out"], kept, span["mark"]).alias("out"), span["end"].alias("at"))

        def close(done: Column) -> Column:
            return F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))

        return F.struct(
            F.aggregate(spans, start, step, close).alias("text"), F.size(spans).cast("bigint").alias("removals")
        )

    untouched = F.struct(text.alias("text"), F.lit(0).cast("bigint").alias("removals"))
    return F.when(has_contact(text, rules), let(_spans(text, rules), splice)).otherwise(untouched)


def redact(text: Column, rules: tuple[Rule, ...] = CONTACT_RULES) -> Column:
    return redaction(text, rules)["text"]


def removals(text: Column, rules: tuple[Rule, ...] = CONTACT_RULES) -> Column:
    return redaction(text, rules)["removals"]


def has_contact(text: Column, rules: tuple[Rule, ...] = CONTACT_RULES) -> Column:
    """True where at least one rule matches; no replacement is needed to know."""
    return reduce(
        lambda a, b: a | b, [_hinted(text, rule) & text.rlike(ascii_edges(rule.pattern)) for rule in rules]
    )
