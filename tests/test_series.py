import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from advertide.operators import totals as T

DAY = datetime.date


def bands_of(values, k):
    """Direct picks from the sorted list."""
    v, out = sorted(values), []
    for step in range(k):
        low = v[math.floor(step * len(v) / k)]
        high = v[min(len(v) - 1, math.ceil((step + 1) * len(v) / k) - 1)]
        if not out or high > out[-1][1]:
            out.append((low, high))
    return out


@pytest.mark.parametrize(
    "values, k",
    [
        ([716, 821, 901, 911, 974, 1344, 1425, 2671, 28020, 36904, 42880], 5),
        ([5, 5, 5, 5, 5, 5, 5, 9], 4),
        ([1], 5),
        ([random.Random(1).randint(0, 40) for _ in range(500)], 5),
        ([random.Random(2).random() for _ in range(3000)], 7),
    ],
)
def test_quantile_bands(spark, values, k):
    df = spark.createDataFrame([(float(v),) for v in values], "value double")
    bands = T.quantile_bands(df, "value", k)
    got = [(r["low"], r["high"]) for r in bands.orderBy("band").collect()]
    assert got == bands_of([float(v) for v in values], k)
    tops = [high for _, high in got]
    for value, band in T.assign_bands(df, "value", bands).distinct().collect():
        assert band == next((i for i, top in enumerate(tops) if value <= top), len(tops) - 1)


def test_value_positions_are_exact_under_a_hot_value(spark):
    values = [7.0] * 400 + [float(i % 50) for i in range(600)]
    df = spark.createDataFrame([(v,) for v in values], "value double")
    for value, n, before in T.value_positions(df, "value", slices=5).collect():
        assert n == values.count(value)
        assert before == sum(v < value for v in values)


def test_leaf_codes(spark):
    codes = ["0", "1", "11", "12", "121", "2", "30"]
    df = spark.createDataFrame([(c,) for c in codes], "code string")
    assert sorted(r[0] for r in T.leaf_codes(df).collect()) == ["0", "11", "121", "2", "30"]


def test_a_sum_over_nothing_is_null(spark):
    rows = [("A", None, None), ("A", None, 1.0), ("B", 2.0, None), (None, 9.0, 9.0)]
    got = T.state_rollup(spark.createDataFrame(rows, "state_code string, latest_value double, previous_value double"))
    assert {r["state_code"]: (r["total"], r["previous_total"], r["regions_reporting"], r["regions_in_scope"]) for r in got.collect()} == {
        "A": (None, 1.0, 0, 2),
        "B": (2.0, None, 1, 1),
    }


@pytest.fixture(scope="module")
def small(spark):
    geography = spark.createDataFrame(
        [("W", "World", "COUNTRY", None), ("S", "State", "STATE", "W"), ("a", "A", "SA4", "S"), ("b", "B", "SA4", "S")],
        "code string, name string, level string, parent_code string",
    ).withColumn("edition", F.lit("e"))
    series = spark.createDataFrame(
        [("a|0", "a", "0", "all A"), ("b|0", "b", "0", "all B"), ("a|1", "a", "1", "One"), ("b|1", "b", "1", "One")],
        "series_key string, geo_code string, occ_code string, occ_name string",
    ).select("*", F.lit("s").alias("source_key"), F.lit("d").alias("dataset"))
    metric = spark.createDataFrame(
        [
            ("a|0", DAY(2020, 2, 1), 10.0, "PRESENT"),
            ("a|0", DAY(2020, 1, 1), 8.0, "PRESENT"),
            ("b|0", DAY(2020, 2, 1), None, "SUPPRESSED"),
            ("a|1", DAY(2020, 2, 1), 0.0, "ZERO"),
            ("b|1", DAY(2019, 12, 1), 99.0, "PRESENT"),
        ],
        "series_key string, period_start date, value double, value_state string",
    )
    return series, metric, geography, T.Scope("s", "d", "e", ("SA4",))


def test_region_totals_keep_missing_apart_from_absent(small):
    series, metric, geography, scope = small
    one = T.Scope(**{**scope.__dict__, "occupation": "0"})
    rows = {r["code"]: r for r in T.region_totals(series, metric, geography, one).collect()}
    assert (rows["a"]["latest_value"], rows["a"]["previous_value"], rows["a"]["change"]["percent"]) == (10.0, 8.0, 25.0)
    assert (rows["b"]["latest_value"], rows["b"]["latest_state"]) == (None, "SUPPRESSED")
    totals = T.region_totals(series, metric, geography, one)
    assert T.without_data(totals).count() == 0 and T.reporting(totals).count() == 2


def test_occupation_totals(small):
    series, metric, geography, scope = small
    rows = {r["code"]: r for r in T.occupation_totals(series, metric, geography, scope).collect()}
    assert rows["0"]["name"] is None and rows["1"]["name"] == "One"
    assert (rows["0"]["total"], rows["0"]["previous_total"], rows["0"]["regions_reporting"]) == (10.0, 8.0, 1)
    # The second newest period in scope holds no reading of code 1.
    assert (rows["1"]["total"], rows["1"]["previous_total"], rows["1"]["regions_reporting"]) == (0.0, None, 1)
    assert {r["regions_in_scope"] for r in rows.values()} == {2}


def test_cube_holds_places_and_nation_from_one_reading(spark, small):
    series, metric, geography, scope = small
    more = geography.unionByName(
        spark.createDataFrame([("T", "Other", "STATE", "W"), ("c", "C", "SA4", "T"), ("d", "D", "SA4", None)], "code string, name string, level string, parent_code string").withColumn("edition", F.lit("e"))
    )
    rows = [("c|0", "c", "0", "all C"), ("c|1", "c", "1", "One"), ("c|12", "c", "12", "Part"), ("d|0", "d", "0", "all D"), ("c|x", "c", "", "none")]
    every = series.unionByName(
        spark.createDataFrame(rows, "series_key string, geo_code string, occ_code string, occ_name string").select("*", F.lit("s").alias("source_key"), F.lit("d").alias("dataset"))
    )
    read = [("c|0", DAY(2020, 2, 1), 30.0, "PRESENT"), ("c|1", DAY(2020, 2, 1), 6.0, "PRESENT"), ("c|12", DAY(2020, 2, 1), 3.0, "PRESENT"), ("d|0", DAY(2020, 2, 1), 2.0, "PRESENT")]
    cube = T.occupation_cube(every, metric.unionByName(spark.createDataFrame(read, metric.schema)), more, scope, "0")
    got = {(r.national, r.state_code, r.code): r for r in cube.collect()}
    assert {k: r.total for k, r in got.items()} == {
        (True, None, "0"): 42.0, (True, None, "1"): 6.0, (True, None, "12"): 3.0, (False, None, "0"): 2.0,
        (False, "S", "0"): 10.0, (False, "S", "1"): 0.0, (False, "T", "0"): 30.0, (False, "T", "1"): 6.0, (False, "T", "12"): 3.0,
    }
    assert got[(True, None, "0")].previous_total == 8.0 and got[(False, "S", "0")].regions_reporting == 1
    assert {k: r.is_leaf for k, r in got.items() if k[0]} == {(True, None, "0"): True, (True, None, "1"): False, (True, None, "12"): True}
    # A code is a leaf by the nation's list, also in a state that does not report its parts.
    assert got[(False, "S", "1")].is_leaf is False
    assert {(r.national_value, r.national_total) for r in got.values() if r.code == "1"} == {(6.0, 42.0)}
    quotients = {(r.state_code, r.code): r.quotient for r in T.location_quotients(cube, "0").collect()}
    assert quotients[("T", "1")] == (6 / 30) / (6 / 42) and set(quotients) == {("S", "1"), ("T", "1"), ("T", "12")}
    plan = cube._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Expand") == 1


def test_states_add_up_to_the_nation(spark):
    from advertide.plans.inputs import Inputs
    from advertide.plans.series import SCOPE

    t = Inputs(spark, "/root/testdata/sf0.001")
    args = (t.series, t.metric, t.geography, SCOPE)
    nation = {r["code"]: r["total"] for r in T.occupation_totals(*args).collect()}
    states = {}
    for row in T.occupation_totals(*args, by_state=True).collect():
        if row["total"] is not None:
            states[row["code"]] = states.get(row["code"], 0) + row["total"]
    assert states == {code: total for code, total in nation.items() if total is not None}


@pytest.mark.parametrize("key, reason", [("gone", "no source registered"), ("fix", "fixture"), ("off", "PENDING"), ("raw", "UNVERIFIED"), ("shut", "reserves")])
def test_aggregation_gate_refuses(spark, key, reason):
    registry = spark.createDataFrame(
        [
            ("fix", "DEVELOPMENT_ONLY", "VERIFIED", True),
            ("off", "PENDING", "VERIFIED", True),
            ("raw", "ACTIVE", "UNVERIFIED", True),
            ("shut", "ACTIVE", "VERIFIED", False),
            ("good", "ACTIVE", "VERIFIED", True),
        ],
        "source_key string, activation string, compliance_status string, permits_aggregates boolean",
    )
    assert T.require_aggregable(registry, "good").collect()[0][0] == "good"
    with pytest.raises(Exception, match=reason):
        T.require_aggregable(registry, key).collect()


def test_retention(spark):
    metric = spark.createDataFrame([("s", DAY(2020, m, 1)) for m in range(1, 6)] + [("u", DAY(2020, 1, 1))], "series_key string, period_start date")
    assert T.keep_recent(metric, 2).count() == 2
    assert T.keep_recent(metric, 9).count() == 6
    kept = T.retention_outcome(metric, 2).filter("not kept").agg(F.sum("rows")).collect()[0][0]
    assert kept == 4


def test_movers_and_position(spark):
    rows = [("a", 10.0, 5.0), ("b", 300.0, 250.0), ("c", 1.0, 9.0), ("d", 5.0, 5.0), ("e", None, 5.0)]
    df = spark.createDataFrame(rows, "code string, total double, previous_total double")
    got = [(r["side"], r["code"], r["absolute"], r["percent"]) for r in T.movers(df, 5, 200.0).collect()]
    assert got == [("RISER", "b", 50.0, 20.0), ("RISER", "a", 5.0, None), ("FALLER", "c", -8.0, None)]
    assert tuple(T.position_of(df, "code", "a", "total").collect()[0]) == ("a", 2, 4)
    assert tuple(T.position_of(df, "code", "e", "total").collect()[0]) == ("e", None, 4)
