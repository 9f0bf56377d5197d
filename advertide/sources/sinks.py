"""Dataset exports with their provenance.

Both layouts are lines with a sort key. Writing sorts them by range, so a large
export is many ordered part files that read as one document when put end to end,
and no task holds more than its own part.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from advertide.functions.text import csv_field

# Rows alike that are numbered out of one array.
STRETCH = 10_000


@dataclass(frozen=True)
class Provenance:
    title: str
    publisher: str
    dataset: str
    reference_period: str | None
    licence: str
    licence_url: str
    attribution: str
    derivation: str
    source: str
    retrieved_at: str


# The order and wording of the provenance lines.
def header_lines(p: Provenance) -> list[str]:
    lines = [p.title, "", f"Publisher: {p.publisher}", f"Dataset: {p.dataset}"]
    if p.reference_period is not None:
        lines.append(f"Reference period: {p.reference_period}")
    lines += [
        f"Licence: {p.licence} ({p.licence_url})",
        f"Attribution: {p.attribution}",
        f"Derivation: {p.derivation}",
        f"Source: {p.source}",
        f"Retrieved: {p.retrieved_at}",
        "",
        "Figures count online job advertisements, not vacancies.",
    ]
    return ["#" if line == "" else f"# {line}" for line in lines]


def _number(value: Column) -> Column:
    """Figures as a reader writes them: the shortest text that reads back the same, no trailing ".0", no exponent.

    A text with an exponent is written out digit by digit, so no figure loses any: its
    digits without the point, led or followed by as many zeros as the power asks for.
    """
    text = value.cast("string")
    digits = F.regexp_extract(text, r"^-?(\d+)", 1)
    behind = F.regexp_replace(F.regexp_extract(text, r"\.(\d+)", 1), r"0+$", "")
    power = F.try_to_number(F.regexp_extract(text, r"E([+-]?\d+)$", 1), F.lit("S999")).cast("int")
    every = F.concat(digits, behind)
    point = F.length(digits) + power
    zeros = lambda n: F.repeat(F.lit("0"), n.cast("int"))
    small = F.concat(F.lit("0."), zeros(-point), every)
    large = F.concat(every, zeros(point - F.length(every)))
    inside = F.concat(F.left(every, point), F.lit("."), F.substring(every, point + 1, F.length(every)))
    whole = F.when(point <= 0, small).when(point >= F.length(every), large).otherwise(inside)
    spelled = F.concat(F.when(F.startswith(text, F.lit("-")), "-").otherwise(""), whole)
    text = F.when(power.isNotNull(), spelled).otherwise(text)
    plain = F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(value == 0, "0").when(value.isNotNull(), plain)


def _shown(df: DataFrame, key: str) -> Column:
    kind = df.schema[key].dataType.simpleString()
    return _number(F.col(key)) if kind in ("double", "float") or kind.startswith("decimal") else F.col(key).cast("string")


def csv_lines(rows: DataFrame, columns: dict[str, str], provenance: Provenance, order: list[Column]) -> DataFrame:
    """(part, place, line): provenance, headings and one line per row. ``columns`` maps keys to headings."""
    spark = rows.sparkSession
    fields = [csv_field(_shown(rows, key)) for key in columns]
    body = rows.select(F.lit(2).alias("part"), F.struct(*order).alias("place"), F.concat_ws(",", *fields).alias("line"))
    place = body.schema["place"].dataType
    headings = ",".join(f'"{h.replace(chr(34), chr(34) * 2)}"' if any(c in h for c in ',"\n\r') else h for h in columns.values())
    fixed = [(0, i, line) for i, line in enumerate(header_lines(provenance))] + [(1, 0, headings)]
    head = spark.createDataFrame(fixed, "part int, seat int, line string")
    return (
        head.select("part", "seat", F.lit(None).cast(place).alias("place"), "line")
        .unionByName(body.withColumn("seat", F.lit(0)))
        .select("part", "seat", "place", "line")
    )


def json_lines(rows: DataFrame, columns: dict[str, str], provenance: Provenance, order: list[Column]) -> DataFrame:
    """(part, seat, place, line): one JSON document in pieces, rows keyed by column, nulls kept."""
    spark = rows.sparkSession
    shown = F.to_json(F.struct(*[F.col(key) for key in columns]), {"ignoreNullFields": "false"})
    body = rows.select(F.struct(*order).alias("place"), shown.alias("text"))
    # The least row goes without a comma and before all others; equal places are settled by text. Rows
    # alike in both are counted and told apart by number, so however many share the least place, no task orders them.
    first = body.agg(F.min(F.struct("place", "text")).alias("p")).scalar()
    is_least = F.struct("place", "text").eqNullSafe(first)
    alike = body.where(is_least).groupBy("place", "text").agg(F.count(F.lit(1)).alias("n"))
    least = alike.withColumn("start", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"), F.lit(STRETCH).cast("long"))))
    least = least.select("place", "text", F.explode(F.sequence("start", F.least("n", F.col("start") + (STRETCH - 1)))).alias("nth"))
    others = body.where(~is_least).withColumn("nth", F.lit(2).cast("long"))
    opens = F.col("nth") == 1
    lines = least.unionByName(others).select(
        F.lit(1).alias("part"), F.when(opens, 0).otherwise(1).alias("seat"), "place",
        F.concat(F.when(opens, F.lit("")).otherwise(F.lit(",")), "text").alias("line"),
    )
    described = {
        "title": provenance.title, "publisher": provenance.publisher, "dataset": provenance.dataset,
        "referencePeriod": provenance.reference_period, "licence": provenance.licence, "licenceUrl": provenance.licence_url,
        "attribution": provenance.attribution, "derivation": provenance.derivation, "source": provenance.source,
        "retrievedAt": provenance.retrieved_at,
    }
    about = F.to_json(F.struct(*[F.lit(v).cast("string").alias(k) for k, v in described.items()]), {"ignoreNullFields": "false"})
    listed = F.to_json(F.array(*[F.struct(F.lit(k).alias("key"), F.lit(h).alias("heading")) for k, h in columns.items()]))
    opening = F.concat(F.lit('{"provenance":'), about, F.lit(',"columns":'), listed, F.lit(',"rows":['))
    place = body.schema["place"].dataType
    ends = spark.range(2).select(
        (F.col("id") * 2).cast("int").alias("part"), F.lit(0).alias("seat"), F.lit(None).cast(place).alias("place"),
        F.when(F.col("id") == 0, opening).otherwise(F.lit("]}")).alias("line"),
    )
    return ends.unionByName(lines)


def write_lines(lines: DataFrame, path: str, separator: str = "\r\n") -> None:
    """Ordered part files; a short dataset is one file because AQE joins its small ranges."""
    lines.sort("part", "seat", "place").select("line").write.mode("errorifexists").option("lineSep", separator).text(path)
