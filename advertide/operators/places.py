"""Resolving what a source says about a place, and classifying the place.

Lookups are equi joins against keys grouped once per dimension; a key with more
than one candidate is ambiguous and resolves to nothing. Postcode tables are one
value in which places are looked up, and polygons become grid cells, so neither
needs a range or nested-loop join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from advertide.functions.text import code_key, four_digit_postcode, word_key
from advertide.session import stage

# Levels from the root down and the level each hangs off.
LEVELS = ("COUNTRY", "STATE", "GCCSA", "SA4")
PARENT_LEVEL = {"STATE": "COUNTRY", "GCCSA": "STATE", "SA4": "STATE"}

# Short forms a source may use for a state, and each state's abbreviation.
STATE_ALIASES = {
    "nsw": "new south wales",
    "vic": "victoria",
    "qld": "queensland",
    "sa": "south australia",
    "wa": "western australia",
    "tas": "tasmania",
    "nt": "northern territory",
    "act": "australian capital territory",
    "aus": "australia",
    "aust": "australia",
    "australia": "australia",
}
STATE_ABBREVIATIONS = {
    "new south wales": "NSW",
    "victoria": "VIC",
    "queensland": "QLD",
    "south australia": "SA",
    "western australia": "WA",
    "tasmania": "TAS",
    "northern territory": "NT",
    "australian capital territory": "ACT",
}

RESOLVED, AMBIGUOUS, UNRESOLVED = "RESOLVED", "AMBIGUOUS", "UNRESOLVED"


def literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(part) for pair in pairs.items() for part in pair])


def name_key(name: Column, aliases: dict[str, str] | None = None) -> Column:
    """Normalised name, with short forms spelled out."""
    key = word_key(name)
    return F.coalesce(F.try_element_at(literal_map(STATE_ALIASES if aliases is None else aliases), key), key)


def state_abbreviation(name: Column) -> Column:
    return F.try_element_at(literal_map(STATE_ABBREVIATIONS), name_key(name))


def areas_with_parents(geography: DataFrame) -> DataFrame:
    """Each area with the name of the one it belongs to."""
    parents = geography.select(
        F.col("code").alias("parent_code"), F.col("edition"), F.col("name").alias("parent_name")
    )
    return geography.join(parents, ["parent_code", "edition"], "left")


def _candidates(dimension: DataFrame, key: Column, value: str, prefix: str) -> DataFrame:
    """One row per key: how many candidates share it and, when it is one, which."""
    return (
        dimension.select(key.alias(f"{prefix}_key"), F.col(value))
        .filter(F.col(f"{prefix}_key").isNotNull())
        .groupBy(f"{prefix}_key")
        .agg(F.count(F.lit(1)).alias(f"{prefix}_n"), F.min(value).alias(f"{prefix}_id"))
    )


def _settle(*stages: str) -> tuple[Column, Column]:
    """(id, status): the first stage with a candidate decides, and two candidates decide nothing."""
    status, found = None, None
    for stage in stages:
        n = F.col(f"{stage}_n")
        hit = F.when(n > 1, AMBIGUOUS).when(n == 1, RESOLVED)
        one = F.when(n == 1, F.col(f"{stage}_id"))
        status = F.when(hit.isNotNull(), hit) if status is None else status.when(hit.isNotNull(), hit)
        found = F.when(hit.isNotNull(), one) if found is None else found.when(hit.isNotNull(), one)
    return found, status.otherwise(UNRESOLVED)


def resolve_geography(stated: DataFrame, geography: DataFrame, code: str, name: str) -> DataFrame:
    """By code, then by code without leading zeros, then by name."""
    by_code = _candidates(geography, code_key(F.col("code")), "code", "code")
    by_bare = by_code.select(*[F.col(c).alias(c.replace("code", "bare", 1)) for c in by_code.columns])
    by_name = _candidates(geography, word_key(F.col("name")), "code", "name")
    given = code_key(F.when(F.trim(code) != "", F.col(code)))
    bare = F.when(given.rlike(r"^[0-9]+\z"), F.regexp_replace(given, "^0+(?=[0-9])", ""))
    named = F.when(F.trim(name) != "", name_key(F.col(name)))
    found, status = _settle("code", "bare", "name")
    return (
        stated.withColumn("code_key", given)
        .withColumn("bare_key", bare)
        .withColumn("name_key", named)
        .join(by_code, "code_key", "left")
        .join(by_bare, "bare_key", "left")
        .join(by_name, "name_key", "left")
        .select(*stated.columns, found.alias("resolved_code"), status.alias("resolution"))
    )


def resolve_at_level(stated: DataFrame, geography: DataFrame, name: str, level: str) -> DataFrame:
    """By name among the areas of one level."""
    at_level = geography.filter(F.col("level") == level)
    by_name = _candidates(at_level, word_key(F.col("name")), "code", "name")
    found, status = _settle("name")
    return (
        stated.withColumn("name_key", name_key(F.col(name)))
        .join(by_name, "name_key", "left")
        .select(*stated.columns, found.alias("resolved_code"), status.alias("resolution"))
    )


def resolve_occupation(stated: DataFrame, occupations: DataFrame, code: str) -> DataFrame:
    """By code only; a code held in several classification versions is ambiguous."""
    by_code = _candidates(occupations, code_key(F.col("code")), "occupation_id", "code")
    found, status = _settle("code")
    return (
        stated.withColumn("code_key", code_key(F.when(F.trim(code) != "", F.col(code))))
        .join(by_code, "code_key", "left")
        .select(*stated.columns, found.alias("occupation_id"), status.alias("resolution"))
    )


def resolve_localities(
    listings: DataFrame, vocabulary: DataFrame, geography: DataFrame, level: str, fallback: str | None
) -> DataFrame:
    """The first locality of each list that resolves, the unknown names met before it, else the fallback area.

    ``listings`` has an ``id`` and an array ``localities``; ``vocabulary`` maps a
    lower-case portal name to an area name, null for a name that is no place.
    """
    at_level = geography.filter(F.col("level") == level)
    areas = _candidates(at_level, word_key(F.col("name")), "code", "name").filter("name_n = 1")
    parts = listings.select("id", F.posexplode("localities").alias("pos", "locality"))
    known = vocabulary.select(F.col("portal_key"), F.col("area_name"), F.lit(True).alias("is_known"))
    placed = (
        parts.withColumn("portal_key", F.lower(F.trim("locality")))
        .join(known, "portal_key", "left")
        .withColumn("name_key", word_key(F.col("area_name")))
        .join(areas, "name_key", "left")
    )
    hit = F.when(F.col("name_id").isNotNull(), F.struct("pos", "name_id"))
    stranger = F.when(F.col("is_known").isNull(), F.struct("pos", "locality"))
    # A list of localities is one advertisement's own, a handful of names.
    settled = placed.groupBy("id").agg(
        F.min(hit).alias("first"), F.sort_array(F.collect_list(stranger)).alias("strangers")
    )
    met = F.filter("strangers", lambda s: F.col("first").isNull() | (s["pos"] < F.col("first.pos")))
    return (
        listings.select("id")
        .join(settled, "id", "left")
        .select(
            "id",
            F.coalesce(F.col("first.name_id"), F.lit(fallback)).alias("resolved_code"),
            F.coalesce(met["locality"], F.array().cast("array<string>")).alias("unknown"),
        )
    )


def relink(places: DataFrame, geography: DataFrame) -> DataFrame:
    """Retry rows no area was found for: by state where one is stated, by the country or else the text as one otherwise."""
    unresolved = places.filter(F.col("geo_code").isNull())
    country = ["country_name"] if "country_name" in places.columns else []
    stated = unresolved.withColumn("asked", F.coalesce("state_name", *country, "raw_text")).withColumn(
        "asked_level", F.when(F.col("state_name").isNull(), "COUNTRY").otherwise("STATE")
    )
    by_level = (
        geography.select(F.col("level").alias("asked_level"), word_key(F.col("name")).alias("name_key"), "code")
        .groupBy("asked_level", "name_key")
        .agg(F.count(F.lit(1)).alias("n"), F.min("code").alias("found"))
        .filter("n = 1")
        .drop("n")
    )
    retried = (
        stated.withColumn("name_key", name_key(F.col("asked")))
        .join(by_level, ["asked_level", "name_key"], "left")
        .withColumn("geo_code", F.col("found"))
        .select(*places.columns)
    )
    return places.filter(F.col("geo_code").isNotNull()).unionByName(retried)


@dataclass(frozen=True)
class Allocation:
    """Postcodes of one jurisdiction in one table: ranges, every postcode, or all the other table leaves."""

    kind: str
    ranges: tuple[tuple[int, int], ...] = ()


def ranges(*entries: int | tuple[int, int]) -> Allocation:
    return Allocation("RANGES", tuple(e if isinstance(e, tuple) else (e, e) for e in entries))


ALL, REMAINDER = Allocation("ALL"), Allocation("REMAINDER")
CITY, OTHER = "CITY_OR_MAJOR_CENTRE", "REGIONAL_CENTRE_OR_OTHER"

# The two postcode tables of the instrument, per state and territory.
CITY_POSTCODES = {
    "NSW": ranges(2259, (2264, 2308), (2500, 2526), (2528, 2535), 2574),
    "VIC": ranges((3211, 3232), 3235, 3240, 3328, (3330, 3333), 3340, 3342),
    "QLD": ranges(
        (4019, 4022), 4025, 4037, 4074, (4076, 4078), (4207, 4275), 4300, 4301, (4303, 4305),
        (4500, 4506), (4508, 4512), (4514, 4519), 4521, 4550, 4551, (4553, 4562), (4564, 4569), (4571, 4575),
    ),
    "WA": ranges((6000, 6038), (6050, 6083), (6090, 6182), (6208, 6211), 6214, (6556, 6558)),
    "SA": ranges((5000, 5171), 5173, 5174, (5231, 5235), (5240, 5252), 5351, (5950, 5960)),
    "TAS": ranges(7000, (7004, 7026), (7030, 7109), (7140, 7151), (7170, 7177)),
    "ACT": ALL,
}
OTHER_POSTCODES = {
    "NSW": ranges(
        (2250, 2258), (2260, 2263), (2311, 2490), 2527, (2536, 2551), (2575, 2739), 2753, 2754, (2756, 2758), (2773, 2898)
    ),
    "VIC": ranges(
        (3097, 3099), 3139, 3233, 3234, (3236, 3239), (3241, 3325), 3329, 3334, 3341, (3345, 3424), (3430, 3799),
        (3809, 3909), (3912, 3971), (3978, 3996),
    ),
    "QLD": ranges(
        4124, 4125, 4133, 4183, 4184, (4280, 4287), (4306, 4498), 4507, 4552, 4563, 4570, (4580, 4895)
    ),
    "WA": REMAINDER,
    "SA": REMAINDER,
    "TAS": REMAINDER,
    "NT": ALL,
    "NORFOLK_ISLAND": ALL,
    "OTHER_TERRITORIES": ALL,
}


def allocation_rows(
    city: dict[str, Allocation] = CITY_POSTCODES, other: dict[str, Allocation] = OTHER_POSTCODES
) -> list[tuple[str, str, str, int | None, int | None]]:
    """(jurisdiction, category, kind, lo, hi), one row per range and one per ALL or REMAINDER."""
    rows = []
    for category, table in ((CITY, city), (OTHER, other)):
        for jurisdiction, allocation in table.items():
            if allocation.kind == "RANGES":
                rows += [(jurisdiction, category, "RANGES", lo, hi) for lo, hi in allocation.ranges]
            else:
                rows.append((jurisdiction, category, allocation.kind, None, None))
    return rows


def allocation_table(spark: SparkSession, rows=None) -> DataFrame:
    schema = "jurisdiction string, category string, kind string, lo int, hi int"
    return spark.createDataFrame(allocation_rows() if rows is None else rows, schema)


def _rulebook(allocations: DataFrame) -> Column:
    """One map from jurisdiction to what the tables say of it: as large as the instrument, whatever the places."""
    rule = lambda category, kind: F.bool_or((F.col("category") == category) & (F.col("kind") == kind))
    listed = lambda category: F.collect_list(
        F.when((F.col("category") == category) & (F.col("kind") == "RANGES"), F.struct("lo", "hi"))
    )
    by_jurisdiction = allocations.filter("jurisdiction is not null").groupBy("jurisdiction").agg(
        F.struct(
            rule(CITY, "ALL").alias("city_all"),
            rule(OTHER, "ALL").alias("other_all"),
            rule(OTHER, "REMAINDER").alias("other_rest"),
            listed(CITY).alias("city"),
            listed(OTHER).alias("other"),
        ).alias("rules")
    )
    return by_jurisdiction.agg(F.map_from_entries(F.collect_list(F.struct("jurisdiction", "rules")))).scalar()


def classify_places(places: DataFrame, allocations: DataFrame, postcode: str = "postcode", jurisdiction: str = "state_code") -> DataFrame:
    """Status, category and basis of each place under the two tables; an undecided place is UNKNOWN.

    The instrument is looked up as one value, so places are neither joined nor moved.
    """
    book = F.try_element_at(_rulebook(allocations), F.upper(F.trim(jurisdiction)))
    ruled = places.withColumn("_rules", book).withColumn("_code", four_digit_postcode(F.col(postcode)).cast("int"))
    holds = lambda table: F.coalesce(
        F.exists(f"_rules.{table}", lambda r: F.col("_code").between(r["lo"], r["hi"])), F.lit(False)
    )
    flags = {name: F.col(f"_rules.{name}") for name in ("city_all", "other_all", "other_rest")}
    judged = ruled.withColumn("_in_city", flags["city_all"] | holds("city")).withColumn(
        "_in_other", flags["other_all"] | flags["other_rest"] | holds("other")
    )
    is_listed = F.col("_rules").isNotNull()
    readable = F.col("_code").isNotNull()
    stated = F.col(postcode).isNotNull()
    in_city, in_other = F.col("_in_city"), F.col("_in_other")
    wholly = flags["city_all"] | flags["other_all"] | flags["other_rest"]

    def verdict(status: str, category: Column, basis: str) -> Column:
        return F.struct(
            F.lit(status).alias("status"), category.cast("string").alias("category"), F.lit(basis).alias("basis")
        )

    unknown = verdict("UNKNOWN", F.lit(None), "NONE")
    by_state = F.when(flags["city_all"], CITY).when(flags["other_all"], OTHER)
    placement = (
        F.when(~is_listed, unknown)
        .when(stated & ~readable, unknown)
        .when(stated & in_city, verdict("REGIONAL", F.lit(CITY), "POSTCODE"))
        .when(stated & in_other, verdict("REGIONAL", F.lit(OTHER), "POSTCODE"))
        .when(stated, verdict("NOT_REGIONAL", F.lit(None), "POSTCODE"))
        .when(wholly, verdict("REGIONAL", by_state, "STATE"))
        .otherwise(unknown)
    )
    return judged.select(*places.columns, placement.alias("placed"))


def wholly_regional(allocations: DataFrame) -> DataFrame:
    """Jurisdictions no postcode of which lies outside the two tables."""
    settles = (F.col("kind") == "ALL") | ((F.col("kind") == "REMAINDER") & (F.col("category") == OTHER))
    return allocations.filter(settles).select("jurisdiction").distinct().orderBy("jurisdiction")


def inherit_regions(places: DataFrame, vocabulary: DataFrame, geography: DataFrame, verdicts: DataFrame, text: str) -> DataFrame:
    """The verdict all regions named in a text agree on; UNKNOWN where they do not, null where one is not known.

    Every distinct text is read once, so a text many places share costs one row.
    """
    texts = places.select(text).distinct()
    parts = texts.select(
        text, F.explode(F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p)), lambda p: p != "")).alias("part")
    )
    areas = geography.select(F.lower(F.trim("name")).alias("area_key"), F.col("code").alias("area_code"))
    known = vocabulary.select("portal_key", F.lower(F.trim("area_name")).alias("area_key"), F.lit(True).alias("is_known"))
    read = (
        parts.withColumn("portal_key", F.lower(F.trim("part")))
        .join(known, "portal_key", "left")
        .join(areas, "area_key", "left")
        .join(verdicts.select(F.col("code").alias("area_code"), "status"), "area_code", "left")
    )
    is_place = F.col("area_key").isNotNull()
    outside = F.col("is_known").isNull() | (is_place & F.col("status").isNull())
    agreed = read.groupBy(text).agg(
        F.bool_or(outside).alias("outside"),
        F.min("status").alias("least"),
        F.max("status").alias("most"),
    )
    verdict = (
        F.when(F.col("outside") | F.col("least").isNull(), F.lit(None).cast("string"))
        .when((F.col("least") == F.col("most")) & F.col("least").isin("REGIONAL", "NOT_REGIONAL"), F.col("least"))
        .otherwise("UNKNOWN")
    )
    return places.join(agreed.select(text, verdict.alias("region_status")), text, "left")


def area_verdicts(units: DataFrame, postcodes: DataFrame, allocations: DataFrame) -> DataFrame:
    """Per area: how its units fall either side of the tables, and the verdict all of them share.

    ``units`` has unit, area_code, area_name and state_code; ``postcodes`` has unit and postcode.
    """
    joined = units.join(postcodes, "unit", "left")
    # Units are classified per distinct (state, postcode): far fewer rows than units.
    pairs = joined.filter(F.col("postcode").isNotNull()).select("state_code", "postcode").distinct()
    verdicts = classify_places(pairs, allocations).select("state_code", "postcode", F.col("placed.status").alias("status"))
    counted = (
        joined.join(
            verdicts.withColumnRenamed("state_code", "s").withColumnRenamed("postcode", "p"),
            F.col("state_code").eqNullSafe(F.col("s")) & (F.col("postcode") == F.col("p")),
            "left",
        )
        .groupBy("area_code")
        .agg(
            F.min("area_name").alias("area_name"),
            F.min("state_code").alias("state_code"),
            F.count(F.lit(1)).alias("units"),
            F.count("postcode").alias("units_with_postcode"),
            F.count_if(F.col("status") == "REGIONAL").alias("units_regional"),
            F.count_if(F.col("status") == "NOT_REGIONAL").alias("units_not_regional"),
            F.count_distinct("postcode").alias("distinct_postcodes"),
        )
    )
    return counted.withColumn(
        "status",
        F.when(F.col("units_with_postcode") == 0, "UNKNOWN")
        .when(F.col("units_not_regional") == 0, "REGIONAL")
        .when(F.col("units_regional") == 0, "NOT_REGIONAL")
        .otherwise("MIXED"),
    )


def hierarchy_problems(geography: DataFrame, parent_level: dict[str, str] = PARENT_LEVEL, levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """(code, level, problem): unknown level, duplicate code, parent on a root, parent missing or absent."""
    known = geography.filter(F.col("level").isin(*levels))

    def problem(df: DataFrame, text: str) -> DataFrame:
        return df.select("code", "level", F.lit(text).alias("problem"))

    unknown = problem(geography.filter(~F.col("level").isin(*levels)), "unknown level")
    repeats = known.groupBy("level", "code").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # One problem per repeat after the first.
    duplicate = problem(repeats.withColumn("again", F.explode(F.sequence(F.lit(2), F.col("n")))), "duplicate code in level")
    expected = F.try_element_at(literal_map(parent_level), F.col("level"))
    child = known.withColumn("expected_level", expected)
    rooted = problem(child.filter("expected_level is null and parent_code is not null"), "root has a parent")
    missing = problem(child.filter("expected_level is not null and parent_code is null"), "parent missing")
    parents = known.select(F.col("level").alias("expected_level"), F.col("code").alias("parent_code")).distinct()
    dangling = problem(
        child.filter("expected_level is not null and parent_code is not null").join(
            parents, ["expected_level", "parent_code"], "left_anti"
        ),
        "parent absent",
    )
    return unknown.unionByName(duplicate).unionByName(rooted).unionByName(missing).unionByName(dangling)


def level_summary(geography: DataFrame, levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """Areas and mappable areas of every level, also of one without areas."""
    spark = geography.sparkSession
    every = spark.createDataFrame([(level,) for level in levels], "level string")
    counts = geography.groupBy("level").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("has_geometry").alias("mappable")
    )
    return every.join(counts, "level", "left").select(
        "level", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("mappable", F.lit(0)).alias("mappable")
    )


def edition_changes(geography: DataFrame) -> DataFrame:
    label = F.coalesce("change_label", F.lit("Not stated")).alias("change_label")
    return geography.groupBy("level", label).agg(F.count(F.lit(1)).alias("n"))


def ring_edges(rings: Column) -> Column:
    """All edges of some rings, each as its two ends; a ring closes by itself."""
    nexts = lambda ring: F.concat(F.slice(ring, F.lit(2), F.size(ring)), F.slice(ring, 1, 1))
    return F.flatten(
        F.transform(rings, lambda ring: F.zip_with(ring, nexts(ring), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))
    )


def grid_cells(polygons: DataFrame, size: float) -> DataFrame:
    """``polygon_id, cx, cy, edges``: the grid cells a polygon's box touches, each row of cells with its own edges alone.

    A polygon has one ``ring``, or ``rings`` where it has several parts or holes.
    """
    rings = F.col("rings") if "rings" in polygons.columns else F.array("ring")
    cell = lambda v: F.floor(v / size)
    edged = polygons.select("polygon_id", ring_edges(rings).alias("edges")).filter(F.size("edges") > 0)
    side = lambda axis, end: F.transform("edges", lambda e: cell(e[end][axis]))
    span = lambda axis: F.sequence(F.array_min(side(axis, "a")), F.array_max(side(axis, "a")))
    rows = edged.select("polygon_id", "edges", span("x").alias("across"), F.explode(span("y")).alias("cy"))
    # A ray to the right from a point of this row of cells meets no edge that lies above or below it.
    beside = F.filter(
        "edges",
        lambda e: (cell(F.least(e["a"]["y"], e["b"]["y"])) <= F.col("cy")) & (cell(F.greatest(e["a"]["y"], e["b"]["y"])) >= F.col("cy")),
    )
    rows = rows.select("polygon_id", "across", "cy", beside.alias("edges"))
    return rows.select("polygon_id", F.explode("across").alias("cx"), "cy", "edges")


def inside_edges(x: Column, y: Column, edges: Column) -> Column:
    """Even-odd test: how many edges a ray to the right crosses. Holes and parts need no marks of their own."""

    def crosses(edge: Column) -> Column:
        a, b = edge["a"], edge["b"]
        straddles = (a["y"] > y) != (b["y"] > y)
        at = (b["x"] - a["x"]) * (y - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"]
        return straddles & (x < at)

    return F.size(F.filter(edges, crosses)) % 2 == 1


# What a point and the pieces of polygons near it meet on: a cell of some level of the grid, and a share of its points.
MEETING = ["level", "lx", "ly", "slot"]


def dense_leaves(points: DataFrame, size: float, most: int, depth: int) -> DataFrame:
    """How grid cells of more than ``most`` points are split: one row per occupied finest cell in them.

    ``cx, cy, fx, fy, level, lx, ly, slots``: a cell is quartered until a quarter holds at most ``most``
    points, ``depth`` times at most; ``lx, ly`` is the quarter of that ``level``. One that holds more at
    the last level has ``slots``, shares of its points. Points are counted by finest cell first; the
    windows then see at most ``4 ** depth`` rows of a grid cell, which meet once.
    """
    at = lambda axis: F.floor(F.col(axis) / (size / 2**depth))
    up = lambda axis, level: F.shiftright(axis, depth - level)
    counts = points.select(at("x").alias("fx"), at("y").alias("fy")).groupBy("fx", "fy").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("cx", up("fx", 0)).withColumn("cy", up("fy", 0)).repartition("cx", "cy")
    for level in range(depth + 1):
        counts = counts.withColumn(f"x{level}", up("fx", level)).withColumn(f"y{level}", up("fy", level))
        held = Window.partitionBy("cx", "cy", f"x{level}", f"y{level}")
        counts = counts.withColumn(f"n{level}", F.sum("n").over(held))
    leaves = [F.when(F.col(f"n{level}") <= most, F.struct(F.lit(level).alias("level"), f"x{level}", f"y{level}", f"n{level}")) for level in range(depth)]
    last = F.struct(F.lit(depth).alias("level"), f"x{depth}", f"y{depth}", f"n{depth}")
    named = "struct<level:int,lx:bigint,ly:bigint,held:bigint>"
    split = counts.filter(F.col("n0") > most).withColumn("leaf", F.coalesce(*[leaf.cast(named) for leaf in [*leaves, last]]))
    return split.select(
        "cx", "cy", "fx", "fy", "leaf.level", "leaf.lx", "leaf.ly", F.ceil(F.col("leaf.held") / most).cast("int").alias("slots")
    )


def split_points(points: DataFrame, leaves: DataFrame, size: float, depth: int, salts: int = 16) -> DataFrame:
    """Points with the cell and share they are tested in. The key that looks it up is salted, so a dense cell is several."""
    at = lambda axis, scale: F.floor(F.col(axis) / scale)
    fine = size / 2**depth
    spread = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    known = leaves.select("fx", "fy", spread.alias("salt"), "level", "lx", "ly", "slots")
    keyed = points.select("point_id", "x", "y", at("x", fine).alias("fx"), at("y", fine).alias("fy"))
    keyed = keyed.withColumn("salt", F.pmod(F.xxhash64("point_id"), F.lit(salts)).cast("int"))
    found = keyed.join(known, ["fx", "fy", "salt"], "left")
    whole = F.col("level").isNull()
    return found.select(
        "point_id", "x", "y",
        F.coalesce("level", F.lit(0)).alias("level"),
        F.when(whole, at("x", size)).otherwise(F.col("lx")).alias("lx"),
        F.when(whole, at("y", size)).otherwise(F.col("ly")).alias("ly"),
        F.when(whole, 0).otherwise(F.pmod(F.xxhash64("point_id", F.lit("share")), F.col("slots"))).cast("int").alias("slot"),
    )


def split_cells(cells: DataFrame, leaves: DataFrame, size: float) -> DataFrame:
    """The cells of :func:`grid_cells`, those that are split in their quarters, each with the edges at its own height."""
    quarters = leaves.select("cx", "cy", "level", "lx", "ly", "slots").distinct()
    near = cells.join(quarters, ["cx", "cy"], "left")
    whole = F.col("level").isNull()
    scale = F.lit(size) / F.pow(F.lit(2.0), F.coalesce("level", F.lit(0)))
    near = near.select(
        "polygon_id", "edges", scale.alias("scale"),
        F.coalesce("level", F.lit(0)).alias("level"),
        F.when(whole, F.col("cx")).otherwise(F.col("lx")).alias("lx"),
        F.when(whole, F.col("cy")).otherwise(F.col("ly")).alias("ly"),
        F.coalesce("slots", F.lit(1)).alias("slots"),
    )
    cell = lambda v: F.floor(v / F.col("scale"))
    low = lambda e, axis: cell(F.least(e["a"][axis], e["b"][axis]))
    high = lambda e, axis: cell(F.greatest(e["a"][axis], e["b"][axis]))
    beside = F.filter("edges", lambda e: (low(e, "y") <= F.col("ly")) & (high(e, "y") >= F.col("ly")))
    near = near.withColumn("edges", beside)
    # A point inside has an edge on either side of it at its own height.
    left = F.array_min(F.transform("edges", lambda e: low(e, "x"))) <= F.col("lx")
    right = F.array_max(F.transform("edges", lambda e: high(e, "x"))) >= F.col("lx")
    slots = F.sequence(F.lit(0), F.col("slots") - 1)
    return near.filter(left & right).select("polygon_id", "edges", "level", "lx", "ly", F.explode(slots).alias("slot"))


def place_points(points: DataFrame, polygons: DataFrame, size: float = 1.0, most: int = 50_000, depth: int = 6) -> DataFrame:
    """The polygon each point lies in, null where it lies in none; the least id where several hold it.

    Points and polygons meet on a grid cell, so a point is tested only against
    polygons whose box touches its cell, and against those edges at its height.
    Cells are counted first: one that holds more than ``most`` points is split where it is dense.
    """
    celled = points.withColumn("cx", F.floor(F.col("x") / size)).withColumn("cy", F.floor(F.col("y") / size))
    cells = grid_cells(polygons, size)
    if celled.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).filter("cx is not null and cy is not null").isEmpty():
        near = celled.join(cells, ["cx", "cy"])
    else:
        # Points and cells both read the split, so it is worked out once.
        leaves = stage(dense_leaves(points.filter("x is not null and y is not null"), size, most, depth), "dense-cells")
        near = split_points(points, leaves, size, depth).join(split_cells(cells, leaves, size), MEETING)
    held = (
        near.filter(inside_edges(F.col("x"), F.col("y"), F.col("edges")))
        .groupBy("point_id")
        .agg(F.min("polygon_id").alias("polygon_id"))
    )
    return points.join(held, "point_id", "left")


def fill_postcodes(places: DataFrame, polygons: DataFrame, reference: str, size: float = 1.0) -> DataFrame:
    """Places without a postcode but with coordinates take the polygon's, marked as inferred and from what."""
    asked = places.filter(F.col("postcode").isNull() & F.col("x").isNotNull() & F.col("y").isNotNull())
    found = place_points(asked.select(F.col("place_id").alias("point_id"), "x", "y"), polygons, size)
    filled = found.select(
        F.col("point_id").alias("place_id"), four_digit_postcode(F.col("polygon_id")).alias("found")
    ).filter(F.col("found").isNotNull())
    return (
        places.join(filled, "place_id", "left")
        .withColumn("postcode", F.coalesce("postcode", "found"))
        .withColumn("postcode_source", F.when(F.col("found").isNotNull(), "DERIVED_FROM_COORDINATES").otherwise(F.col("postcode_source")))
        .withColumn("postcode_reference", F.when(F.col("found").isNotNull(), reference).otherwise(F.col("postcode_reference")))
        .drop("found")
    )


def needs_classifying(instrument: str) -> Column:
    """Placed under another instrument, not placed, or holding a postcode that did not decide."""
    return (
        ~F.col("regional_instrument").eqNullSafe(instrument)
        | (F.col("regional_basis") == "NONE")
        | (F.col("postcode").isNotNull() & (F.col("regional_basis") != "POSTCODE"))
    )


def classification_sweep(
    places: DataFrame,
    allocations: DataFrame,
    vocabulary: DataFrame,
    geography: DataFrame,
    verdicts: DataFrame,
    instrument: str,
    today: str,
    force: bool = False,
) -> DataFrame:
    """Places with their placement renewed where it is due; the instrument first, a region's verdict second."""
    due = F.lit(True) if force else needs_classifying(instrument)
    marked = places.withColumn("is_due", due)
    judged = inherit_regions(
        classify_places(marked.filter("is_due"), allocations), vocabulary, geography, verdicts, "raw_text"
    )
    by_region = (F.col("placed.status") == "UNKNOWN") & F.col("region_status").isin("REGIONAL", "NOT_REGIONAL")
    renewed = (
        judged.withColumn("regional_status", F.when(by_region, F.col("region_status")).otherwise(F.col("placed.status")))
        .withColumn("regional_category", F.when(~by_region, F.col("placed.category")))
        .withColumn("regional_basis", F.when(by_region, "REGION").otherwise(F.col("placed.basis")))
        .withColumn("regional_instrument", F.lit(instrument))
        .withColumn("classified_on", F.lit(today).cast("date"))
        .select(*marked.columns)
    )
    return marked.filter(~F.col("is_due")).unionByName(renewed)


def import_hierarchy(entries: DataFrame, levels: tuple[str, ...] = LEVELS, parent_level: dict[str, str] = PARENT_LEVEL) -> DataFrame:
    """Each entry as written or quarantined: a child counts only once its parent has been written.

    One join per level of a fixed-depth hierarchy, parents first.
    """
    outcome = None
    for level in levels:
        here = entries.filter(F.col("level") == level)
        above = parent_level.get(level)
        if above is None or outcome is None:
            judged = here.withColumn("written", F.col("parent_code").isNull())
        else:
            written = (
                outcome.filter((F.col("level") == above) & F.col("written"))
                .select(F.col("code").alias("parent_code"), F.lit(True).alias("has_parent"))
                .distinct()
            )
            judged = (
                here.join(written, "parent_code", "left")
                .withColumn("written", F.col("parent_code").isNull() | F.col("has_parent").isNotNull())
                .select(*entries.columns, "written")
            )
        outcome = judged if outcome is None else outcome.unionByName(judged)
    return outcome
