import random

import pytest
from pyspark.sql import functions as F

from advertide.operators import places as G


def test_every_postcode_of_every_state(spark):
    """Sweep of the whole postcode domain against the tables read one range at a time."""
    states = ["NSW", "VIC", "QLD", "WA", "SA", "TAS", "ACT", "NT", "NORFOLK_ISLAND", "XX"]
    sweep = spark.range(10000).select(F.lpad(F.col("id").cast("string"), 4, "0").alias("postcode")).withColumn(
        "state_code", F.explode(F.array(*[F.lit(s) for s in states]))
    )
    placed = G.classify_places(sweep, G.allocation_table(spark)).select("state_code", "postcode", "placed.*").collect()
    assert len(placed) == 100000

    def inside(allocation, number):
        return any(lo <= number <= hi for lo, hi in allocation.ranges)

    for state, postcode, status, category, basis in placed:
        city, other = G.CITY_POSTCODES.get(state), G.OTHER_POSTCODES.get(state)
        number = int(postcode)
        if city is None and other is None:
            expected = ("UNKNOWN", None, "NONE")
        elif city and (city.kind == "ALL" or inside(city, number)):
            expected = ("REGIONAL", G.CITY, "POSTCODE")
        elif other and (other.kind in ("ALL", "REMAINDER") or inside(other, number)):
            expected = ("REGIONAL", G.OTHER, "POSTCODE")
        else:
            expected = ("NOT_REGIONAL", None, "POSTCODE")
        assert (status, category, basis) == expected, (state, postcode)


def test_ranges_are_ordered_and_disjoint():
    for table in (G.CITY_POSTCODES, G.OTHER_POSTCODES):
        for allocation in table.values():
            flat = [n for pair in allocation.ranges for n in pair]
            assert flat == sorted(flat)
            assert all(a[1] < b[0] for a, b in zip(allocation.ranges, allocation.ranges[1:]))


@pytest.mark.parametrize(
    "postcode, state, expected",
    [
        ("2000", "nsw ", ("NOT_REGIONAL", None, "POSTCODE")),
        (" 2300 ", "NSW", ("REGIONAL", G.CITY, "POSTCODE")),
        ("230", "NSW", ("UNKNOWN", None, "NONE")),
        (None, "NSW", ("UNKNOWN", None, "NONE")),
        (None, "TAS", ("REGIONAL", None, "STATE")),
        (None, "NT", ("REGIONAL", G.OTHER, "STATE")),
        (None, "ACT", ("REGIONAL", G.CITY, "STATE")),
        ("2300", None, ("UNKNOWN", None, "NONE")),
    ],
)
def test_single_places(spark, postcode, state, expected):
    df = spark.createDataFrame([(postcode, state)], "postcode string, state_code string")
    row = G.classify_places(df, G.allocation_table(spark)).select("placed.*").collect()[0]
    assert tuple(row) == expected


def test_wholly_regional(spark):
    got = [r[0] for r in G.wholly_regional(G.allocation_table(spark)).collect()]
    assert got == ["ACT", "NORFOLK_ISLAND", "NT", "OTHER_TERRITORIES", "SA", "TAS", "WA"]


def test_resolution_refuses_to_guess(spark):
    areas = spark.createDataFrame(
        [("1", "New South Wales", "STATE"), ("101", "Capital", "SA4"), ("7", "Twin", "SA4"), ("7", "Twin", "STATE")],
        "code string, name string, level string",
    )
    stated = spark.createDataFrame(
        [(0, "101", None), (1, "0101", None), (2, "7", "Capital"), (3, None, "N.S.W"), (4, None, "nsw"), (5, "x", "capital!"), (6, None, "Twin"), (7, None, None)],
        "id int, c string, n string",
    )
    got = {r["id"]: (r["resolved_code"], r["resolution"]) for r in G.resolve_geography(stated, areas, "c", "n").collect()}
    assert got == {
        0: ("101", "RESOLVED"),
        1: ("101", "RESOLVED"),
        2: (None, "AMBIGUOUS"),
        3: (None, "UNRESOLVED"),
        4: ("1", "RESOLVED"),
        5: ("101", "RESOLVED"),
        6: (None, "AMBIGUOUS"),
        7: (None, "UNRESOLVED"),
    }
    at_level = G.resolve_at_level(stated, areas, "n", "SA4")
    assert {r["id"]: r["resolved_code"] for r in at_level.collect()}[6] == "7"


def test_region_inheritance(spark):
    vocabulary = spark.createDataFrame([("reg", "R"), ("city", "C"), ("mix", "M"), ("various", None)], "portal_key string, area_name string")
    areas = spark.createDataFrame([("1", "R"), ("2", "C"), ("3", "M")], "code string, name string")
    verdicts = spark.createDataFrame([("1", "REGIONAL"), ("2", "NOT_REGIONAL"), ("3", "MIXED")], "code string, status string")
    cases = {
        "Reg": "REGIONAL",
        "reg, various ,": "REGIONAL",
        "Reg, City": "UNKNOWN",
        "mix": "UNKNOWN",
        "various": None,
        "reg, elsewhere": None,
        " , ": None,
        "": None,
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    got = {r["t"]: r["region_status"] for r in G.inherit_regions(df, vocabulary, areas, verdicts, "t").collect()}
    assert got == cases


def test_localities(spark):
    vocabulary = spark.createDataFrame([("cairns region", "Cairns"), ("flexible", None), ("gone", "Not there")], "portal_key string, area_name string")
    areas = spark.createDataFrame([("306", "Cairns", "SA4")], "code string, name string, level string")
    rows = [(1, ["Flexible", "Mars", "Cairns region", "Venus"]), (2, ["Gone", "Mars"]), (3, []), (4, None)]
    df = spark.createDataFrame(rows, "id int, localities array<string>")
    got = {r["id"]: (r["resolved_code"], r["unknown"]) for r in G.resolve_localities(df, vocabulary, areas, "SA4", "3").collect()}
    assert got == {1: ("306", ["Mars"]), 2: ("3", ["Mars"]), 3: ("3", []), 4: ("3", [])}


def test_points_in_concave_polygons(spark):
    """Grid join against a plain even-odd test of every pair."""
    rng = random.Random(5)
    ell = [(0.0, 0.0), (3.0, 0.0), (3.0, 1.0), (1.0, 1.0), (1.0, 3.0), (0.0, 3.0)]
    polygons = {"1000": ell, "2000": [(x + 2.0, y + 1.5) for x, y in ell], "3000": [(-2.0, -2.0), (-0.5, 0.7), (-1.9, 1.3)]}
    points = [(i, rng.uniform(-3, 6), rng.uniform(-3, 6)) for i in range(800)]
    shapes = spark.createDataFrame([(k, [dict(x=x, y=y) for x, y in ring]) for k, ring in polygons.items()], "polygon_id string, ring array<struct<x:double,y:double>>")
    got = {r["point_id"]: r["polygon_id"] for r in G.place_points(spark.createDataFrame(points, "point_id int, x double, y double"), shapes, 0.7).collect()}

    def inside(x, y, ring):
        crossed = False
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                crossed = not crossed
        return crossed

    for i, x, y in points:
        assert got[i] == min((k for k, ring in polygons.items() if inside(x, y, ring)), default=None)


def test_points_in_rings_with_holes_and_parts(spark):
    """A slanted ring with a hole, an island in the hole and a second part, against the parity of each ring."""
    rings = [
        [(0.0, 0.0), (5.0, 1.0), (4.0, 5.0), (-1.0, 4.0)],
        [(1.0, 1.0), (3.5, 1.5), (3.0, 4.0), (0.5, 3.5)],
        [(1.5, 2.0), (2.5, 2.2), (2.0, 3.0)],
        [(6.0, 6.0), (8.0, 6.5), (6.5, 8.0)],
    ]
    rng = random.Random(9)
    points = [(i, rng.uniform(-2, 9), rng.uniform(-2, 9)) for i in range(600)]
    schema = "polygon_id string, rings array<array<struct<x:double,y:double>>>"
    rows = [("1000", [[dict(x=x, y=y) for x, y in ring] for ring in rings]), ("2000", []), ("3000", None)]
    frame = spark.createDataFrame(points, "point_id int, x double, y double")

    def crossings(x, y):
        edges = [e for ring in rings for e in zip(ring, ring[1:] + ring[:1])]
        return sum((ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax for (ax, ay), (bx, by) in edges)

    for size in (0.3, 2.0):
        got = {r["point_id"]: r["polygon_id"] for r in G.place_points(frame, spark.createDataFrame(rows, schema), size).collect()}
        assert got == {i: "1000" if crossings(x, y) % 2 else None for i, x, y in points}


def test_dense_cells_are_split(spark):
    """Nine points of ten in one grid cell, some of them in one spot: same polygons as with whole cells, and no key holds many."""
    rng = random.Random(3)
    shapes = {"1000": [(-3.0, -3.0), (4.0, -2.0), (0.7, 0.6), (3.0, 4.0), (-2.0, 3.0)], "2000": [(0.2, 0.2), (0.9, 0.25), (0.55, 0.8)], "3000": [(0.4, -5.0), (0.45, 5.0), (0.5, 5.0)]}
    frame = spark.createDataFrame([(k, [dict(x=x, y=y) for x, y in ring]) for k, ring in shapes.items()], "polygon_id string, ring array<struct<x:double,y:double>>")
    points = [(i, 0.5 + rng.gauss(0, 0.08), 0.5 + rng.gauss(0, 0.08)) for i in range(1500)]
    points += [(2000 + i, 0.31, 0.33) for i in range(300)]
    points += [(3000 + i, rng.uniform(-4, 5), rng.uniform(-4, 5)) for i in range(200)] + [(4000, None, 1.0), (4001, 0.5, None)]
    table = spark.createDataFrame(points, "point_id int, x double, y double")

    def inside(x, y, ring):
        edges = zip(ring, ring[1:] + ring[:1])
        return sum((ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax for (ax, ay), (bx, by) in edges) % 2 == 1

    want = {i: None if x is None or y is None else min((k for k, ring in shapes.items() if inside(x, y, ring)), default=None) for i, x, y in points}
    assert {r["point_id"]: r["polygon_id"] for r in G.place_points(table, frame, 1.0, most=50, depth=4).collect()} == want
    leaves = G.dense_leaves(table.dropna(), 1.0, 50, 4).cache()
    assert leaves.select("cx", "cy").distinct().count() == 1 and leaves.select("level").distinct().count() > 1
    shares = G.split_points(table.dropna(), leaves, 1.0, 4).groupBy(*G.MEETING).count()
    # Shares of one spot are dealt by hash, so they are near the bound and not under it.
    assert shares.agg(F.max("count")).first()[0] <= 90
    assert shares.agg(F.sum("count")).first()[0] == len(points) - 2


@pytest.mark.parametrize("state", ["a column", "a constant"])
def test_places_are_classified_where_they_are(spark, tmp_path, state):
    """No join, no exchange of places, also where all are of one state."""
    df = spark.range(100).select(F.lpad(F.col("id").cast("string"), 4, "2").alias("postcode"), F.col("id").alias("place_id"))
    code = F.lit("NSW") if state == "a constant" else F.element_at(F.array(F.lit("NSW"), F.lit("QLD")), (F.col("place_id") % 2 + 1).cast("int"))
    df.withColumn("state_code", code).write.parquet(str(tmp_path / "places"))
    placed = G.classify_places(spark.read.parquet(str(tmp_path / "places")), G.allocation_table(spark))
    plan = placed._jdf.queryExecution().executedPlan().toString().split("Subquery")[0]
    assert "Join" not in plan and "Exchange" not in plan
    assert placed.count() == 100


def test_children_wait_for_their_parents(spark):
    rows = [("W", "COUNTRY", None), ("S", "STATE", "W"), ("T", "STATE", "X"), ("a", "SA4", "S"), ("b", "SA4", "T")]
    df = spark.createDataFrame(rows, "code string, level string, parent_code string")
    assert {r["code"]: r["written"] for r in G.import_hierarchy(df).collect()} == {"W": True, "S": True, "T": False, "a": True, "b": False}
