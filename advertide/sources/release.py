"""A published release in wide sheets, read as long observations.

A sheet is rows of text cells (``sheet``, ``row_index`` from 1, ``cells``). The
header is looked for in the first rows only; its columns are recognised once per
sheet, so a data row carries no more than its own cells until the values are
taken apart, and periods outside retention are never taken apart at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from advertide.functions.periods import parse_period, period_label, read_value, series_key
from advertide.functions.text import empty_to_null, let, strip, word_key
from advertide.operators.merge import one_per_key

HEADER_ROWS = 25
FEWEST_PERIODS = 2

# Header spellings of each role, best first.
ALIASES = {
    "occupation_code": (
        "anzsco code",
        "anzsco",
        "anzsco id",
        "occupation code",
        "occupation id",
        "osca code",
        "code",
    ),
    "occupation_name": (
        "anzsco title",
        "anzsco name",
        "anzsco description",
        "occupation",
        "occupation title",
        "occupation name",
        "osca title",
        "title",
    ),
    "geography_code": ("state code", "region code", "sa4 code", "asgs code", "geography code", "area code"),
    "geography_name": (
        "region name",
        "sa4 name",
        "sa4",
        "gccsa name",
        "gccsa",
        "ivi region",
        "region",
        "geography",
        "location",
        "area",
        "state",
        "state territory",
        "state and territory",
        "states and territories",
    ),
    "geography_level": ("region level", "geography level", "asgs level", "level type"),
}



def input_checksum(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """One row: the digest of the bytes of a release's files. One file's is that of its content alone.

    Of several files, names and digests in name order are digested again, so a file
    that is added, renamed or changed in one byte gives another checksum, and the
    same files in another folder the same. Files without a byte count for nothing, and
    without any other there is no checksum. Spark reads a file of up to 2 GB as one
    value; a larger one fails the job and has to come in parts.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    each = files.select(F.struct(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("digest")).alias("f"))
    listed = each.agg(F.sort_array(F.collect_list("f")).alias("fs"))
    together = F.sha2(F.to_json("fs"), 256)
    return listed.select(
        F.when(F.size("fs") == 1, F.try_element_at("fs", F.lit(1))["digest"]).when(F.size("fs") > 1, together).alias("checksum")
    )


def read_sheets(spark: SparkSession, path: str, columns: int) -> DataFrame:
    """Sheets kept as CSV, one folder ``sheet=<name>`` each, with the row number in the first column.

    Every column is read as text; what a cell means is decided here, never by inference.
    """
    names = [f"c{i}" for i in range(columns)]
    schema = ", ".join(["row_index int", *[f"{n} string" for n in names], "sheet string"])
    stored = spark.read.schema(schema).csv(path)
    return stored.select("sheet", "row_index", F.array(*names).alias("cells"))


def header_role(label: Column) -> Column:
    """struct(role, rank) a header plays, null when it is none of the known spellings."""
    table = [
        F.struct(F.lit(alias).alias("key"), F.struct(F.lit(role).alias("role"), F.lit(rank).alias("rank")).alias("value"))
        for role, aliases in ALIASES.items()
        for rank, alias in enumerate(aliases)
    ]
    return F.try_element_at(F.map_from_entries(F.array(*table)), word_key(label))


def _classified(sheets: DataFrame) -> DataFrame:
    """The first rows of every sheet, one row per cell, with what the cell could be a header of."""
    first = sheets.filter(F.col("row_index") <= HEADER_ROWS)
    cells = first.select("sheet", "row_index", F.posexplode("cells").alias("pos", "cell"))
    read = cells.withColumn("label", empty_to_null(strip(F.col("cell")))).filter(F.col("label").isNotNull())
    return (
        read.withColumn("period", parse_period(F.col("label")))
        .withColumn("role", F.when(F.col("period").isNull(), header_role(F.col("label"))))
        .drop("cell")
    )


def layouts(sheets: DataFrame) -> DataFrame:
    """Per sheet the header row and its columns, or why there is none. One row per sheet, however long the sheet."""
    cells = _classified(sheets)
    rows = cells.groupBy("sheet", "row_index").agg(
        F.count("period").alias("periods"),
        F.count("role").alias("dimensions"),
        F.sort_array(
            F.collect_list(F.struct("pos", "label", "period", "role"))
        ).alias("columns"),
    )
    dated = F.col("periods") >= FEWEST_PERIODS
    header = F.min(F.when(dated & (F.col("dimensions") > 0), F.struct("row_index", "columns")))
    nameless = F.min(F.when(dated, F.struct("row_index", "periods", "columns")))
    found = rows.groupBy("sheet").agg(header.alias("header"), nameless.alias("dated"))
    every = sheets.groupBy("sheet").agg(F.count(F.lit(1)).alias("rows"))
    return every.join(found, "sheet", "left").select(
        "sheet",
        F.col("header.row_index").alias("header_row"),
        F.col("header.columns").alias("columns"),
        F.col("dated.row_index").alias("dated_row"),
        F.col("dated.periods").alias("dated_periods"),
        F.col("dated.columns").alias("dated_columns"),
    )


def _best_column(columns: Column, role: str) -> Column:
    """Position of the best spelled column of a role."""
    ranked = F.transform(
        F.filter(columns, lambda c: c["role"]["role"] == role), lambda c: F.struct(c["role"]["rank"], c["pos"])
    )
    return F.array_min(ranked)["pos"]


def _prepared(layout: DataFrame) -> DataFrame:
    columns = F.col("columns")
    periods = F.transform(
        F.filter(columns, lambda c: c["period"].isNotNull()),
        lambda c: F.struct(
            c["pos"].alias("pos"),
            c["label"].alias("label"),
            c["period"]["period_start"].alias("period_start"),
            c["period"]["granularity"].alias("granularity"),
        ),
    )
    qualifiers = F.filter(columns, lambda c: c["period"].isNull() & c["role"].isNull())
    return layout.filter(F.col("header_row").isNotNull()).select(
        "sheet",
        "header_row",
        periods.alias("periods"),
        F.get(periods, F.lit(0))["granularity"].alias("granularity"),
        F.transform(qualifiers, lambda c: F.struct(c["pos"].alias("pos"), c["label"].alias("label"))).alias("qualifiers"),
        *[_best_column(columns, role).alias(f"{role}_at") for role in ALIASES if role != "geography_level"],
    )


def header_periods(layout: DataFrame) -> DataFrame:
    """The periods some sheet has a column for, each once."""
    return _prepared(layout).select(F.explode("periods.period_start").alias("period_start")).distinct()


def _keep_newest(prepared: DataFrame, recent_periods: int | None) -> DataFrame:
    """Drop period columns older than the newest ``recent_periods`` of all sheets.

    What a row says of itself, its granularity included, is that of the whole header.
    """
    if recent_periods is None:
        return prepared
    newest = (
        prepared.select(F.explode("periods.period_start").alias("p"))
        .distinct()
        .orderBy(F.desc("p"))
        .limit(recent_periods)
        .agg(F.min("p").alias("oldest"))
        .scalar()
    )
    return (
        prepared.withColumn("oldest", newest)
        .withColumn("periods", F.filter("periods", lambda p: p["period_start"] >= F.col("oldest")))
        .drop("oldest")
    )


def stated_rows(sheets: DataFrame, layout: DataFrame, recent_periods: int | None = None) -> DataFrame:
    """Data rows below each header with their dimensions, qualifiers and the period columns to read."""
    prepared = _keep_newest(_prepared(layout), recent_periods)
    rows = sheets.join(prepared, "sheet").filter(F.col("row_index") > F.col("header_row"))
    content = F.exists("cells", lambda c: F.coalesce(strip(c) != "", F.lit(False)))
    cell = lambda at: empty_to_null(strip(F.get(F.col("cells"), F.col(at))))
    pairs = F.transform(
        "qualifiers",
        lambda q: F.struct(q["label"].alias("key"), empty_to_null(strip(F.get(F.col("cells"), q["pos"]))).alias("value")),
    )
    usable = F.filter(pairs, lambda p: p["value"].isNotNull())
    # A repeated qualifier heading keeps its last value.
    last = F.filter(usable, lambda p, i: ~F.exists(F.slice(usable, i + 2, F.size(usable)), lambda o: o["key"] == p["key"]))
    return rows.filter(content).select(
        "sheet",
        "row_index",
        "cells",
        "periods",
        "granularity",
        *[cell(f"{role}_at").alias(role) for role in ALIASES if role != "geography_level"],
        F.map_from_entries(last).alias("qualifiers"),
    )


def is_attributed() -> Column:
    return F.coalesce("geography_code", "geography_name", "occupation_code", "occupation_name").isNotNull()


def _keyed(stated: DataFrame, source: str, dataset: str, measure: str) -> DataFrame:
    """Attributed rows with the key of their series, made once per row, before the row is taken apart."""
    key = series_key(
        F.lit(source), F.lit(dataset), F.lit(measure), F.col("granularity"),
        F.col("geography_code"), F.col("geography_name"), F.col("occupation_code"), F.col("occupation_name"), F.col("qualifiers"),
    )
    return stated.filter(is_attributed()).withColumn("series_key", key)


def row_facts(stated: DataFrame, source: str, dataset: str, measure: str) -> DataFrame:
    """One row per attributed row, not taken apart: its series, how many cells can be used, those that cannot, and
    whether its header states a period ``twice``.
    """
    unread = F.transform(
        "periods",
        lambda p: F.struct(
            p["pos"].alias("pos"), p["label"].alias("label"), read_value(F.get(F.col("cells"), p["pos"]))["unreadable"].alias("unreadable")
        ),
    )
    return _keyed(stated, source, dataset, measure).select(
        "series_key", "sheet", "row_index", F.lit(0).alias("pos"), "geography_code", "geography_name", "occupation_code", "occupation_name",
        "qualifiers", "granularity", F.size("periods").alias("columns"),
        F.filter(unread, lambda c: c["unreadable"].isNotNull()).alias("unread"),
        (F.size(F.array_distinct("periods.period_start")) < F.size("periods")).alias("twice"),
    )


def unread_cells(facts: DataFrame) -> DataFrame:
    """The cells of :func:`row_facts` that are no figure, one row each."""
    return facts.select("series_key", "sheet", "row_index", F.inline("unread")).select(
        "series_key", "sheet", "row_index", F.col("pos"), "label", "unreadable"
    )


def rows_of_repeated_series(stated: DataFrame, facts: DataFrame) -> DataFrame:
    """The rows that can state a period of a series again: the series has several rows, or the header the period twice."""
    several = facts.groupBy("series_key").agg(F.count(F.lit(1)).alias("n"), F.max("twice").alias("any")).filter("n > 1 or any")
    at = facts.join(several, "series_key", "left_semi").select("sheet", "row_index")
    return stated.join(at, ["sheet", "row_index"], "left_semi")


def readings(stated: DataFrame, source: str, dataset: str, measure: str) -> DataFrame:
    """One row per period cell of an attributed row: series, period, state, value, or what could not be read."""
    stated = _keyed(stated, source, dataset, measure)
    cells = F.transform(
        "periods",
        lambda p: F.struct(
            p["pos"].alias("pos"),
            p["label"].alias("label"),
            p["period_start"].alias("period_start"),
            F.get(F.col("cells"), p["pos"]).alias("cell"),
        ),
    )
    return (
        stated.select(
            "series_key", "sheet", "row_index", "geography_code", "geography_name", "occupation_code",
            "occupation_name", "qualifiers", "granularity", F.explode(cells).alias("c"),
        )
        .withColumn("read", read_value(F.col("c.cell")))
        .select(
            "series_key", "sheet", "row_index", F.col("c.pos").alias("pos"), F.col("c.label").alias("label"),
            "geography_code", "geography_name", "occupation_code", "occupation_name", "qualifiers", "granularity",
            F.col("c.period_start").alias("period_start"), F.col("read.state").alias("value_state"),
            F.col("read.value").alias("value"), F.col("read.unreadable").alias("unreadable"),
        )
    )


PLACE = ["sheet", "row_index", "pos"]
SERIES_PERIOD = ["series_key", "period_start"]


def first_readings(read: DataFrame) -> DataFrame:
    """The first reading of every series and period, with how often it was read."""
    usable = read.filter(F.col("value_state").isNotNull()).select(*SERIES_PERIOD, *PLACE, "value_state", "value")
    where = F.struct(*PLACE)
    return usable.groupBy(*SERIES_PERIOD).agg(
        F.count(F.lit(1)).alias("times"), F.min(F.struct(where.alias("at"), "value_state", "value")).alias("first")
    )


def observations(first: DataFrame) -> DataFrame:
    return first.select(*SERIES_PERIOD, F.col("first.value_state").alias("value_state"), F.col("first.value").alias("value"))


def repeats(read: DataFrame, first: DataFrame) -> DataFrame:
    """Every reading after the first of its series and period, and whether it agrees with it.

    Only what was read more than once is joined back.
    """
    again = first.filter(F.col("times") > 1)
    usable = read.filter(F.col("value_state").isNotNull())
    later = usable.join(again, SERIES_PERIOD).filter(F.struct(*PLACE) != F.col("first.at"))
    agrees = F.col("value_state").eqNullSafe(F.col("first.value_state")) & F.col("value").eqNullSafe(F.col("first.value"))
    return later.withColumn("agrees", agrees)


def problems(stated: DataFrame, read: DataFrame, repeated: DataFrame) -> DataFrame:
    """What could not be used: rows about nothing, cells that are no figure, readings that contradict the first."""
    none = F.lit(None).cast("string")
    shown = F.array_join(F.transform("cells", lambda c: F.coalesce(strip(c), F.lit(""))), " | ")
    nothing = stated.filter(~is_attributed()).select(
        F.lit("NO_DIMENSIONS").alias("kind"), "sheet", "row_index", none.alias("label"), none.alias("series_key"), shown.alias("raw")
    )
    unreadable = read.filter(F.col("unreadable").isNotNull()).select(
        F.lit("UNREADABLE_VALUE").alias("kind"), "sheet", "row_index", "label", "series_key", F.col("unreadable").alias("raw")
    )
    conflicts = repeated.filter(~F.col("agrees")).select(
        F.lit("CONFLICTING_DUPLICATE").alias("kind"), "sheet", "row_index", "label", "series_key",
        F.coalesce(F.col("value").cast("string"), "value_state").alias("raw"),
    )
    return nothing.unionByName(unreadable).unionByName(conflicts)


def series_of(read: DataFrame, source: str, dataset: str, measure: str, unit: str) -> DataFrame:
    """One row per series with what the source states of it."""
    stated = ["geography_code", "geography_name", "occupation_code", "occupation_name", "granularity"]
    thin = read.select("series_key", *stated, F.to_json("qualifiers").alias("qualifiers"), *PLACE)
    once = one_per_key(thin, ["series_key"], PLACE).drop(*PLACE)
    return once.select(
        "series_key", F.lit(source).alias("source_key"), F.lit(dataset).alias("dataset"), F.lit(measure).alias("measure"),
        F.lit(unit).alias("unit"), *stated, "qualifiers",
    )


def sheet_report(layout: DataFrame, stated: DataFrame) -> DataFrame:
    """Per sheet: read or passed over and why, its span of periods, its rows and the headers no role claims."""
    data = stated.filter(is_attributed()).groupBy("sheet").agg(F.count(F.lit(1)).alias("data_rows"))
    columns = F.coalesce("columns", "dated_columns")
    dated = F.filter("columns", lambda c: c["period"].isNotNull())
    label = lambda c: period_label(c["period"]["period_start"], c["period"]["granularity"])
    unmatched = F.filter(columns, lambda c: c["period"].isNull() & c["role"].isNull())
    parsed = F.col("header_row").isNotNull()
    return layout.join(data, "sheet", "left").select(
        "sheet",
        F.when(parsed, "PARSED").otherwise("SKIPPED").alias("status"),
        F.when(~parsed & F.col("dated_row").isNotNull(), "periods without a dimension")
        .when(~parsed, "no header row")
        .alias("reason"),
        F.coalesce("header_row", "dated_row").alias("header_row"),
        F.when(parsed, F.size(dated)).otherwise(F.col("dated_periods")).cast("bigint").alias("period_columns"),
        F.when(parsed, let(F.try_element_at(dated, F.lit(1)), label)).alias("first_period"),
        F.when(parsed, let(F.try_element_at(dated, F.lit(-1)), label)).alias("last_period"),
        F.coalesce("data_rows", F.lit(0)).alias("data_rows"),
        F.coalesce(F.array_join(unmatched["label"], ", "), F.lit("")).alias("unmatched"),
    )
