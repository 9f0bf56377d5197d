"""Tables in partitions, input checksums, exact figures and the whole listing import."""

import datetime
import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from advertide.operators import imports as I
from advertide.operators import merge as M
from advertide.operators import partitions as B
from advertide.session import work_folder
from advertide.sources import release as R
from advertide.sources.sinks import _number

AT = datetime.datetime
HASHED = ["source_key", "source_id", "title"]
NOW = "2024-05-20 00:00:00"


def files_of(facts):
    """Path and time of writing of every data file."""
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{facts.path}/*/part-*")}


@pytest.fixture
def listings(spark):
    day = AT(2024, 5, 1)
    rows = [(s, str(i), f"{s}{i}", "ACTIVE", day, day, None) for s in ("a", "b", "c/d e", "7") for i in range(3)]
    schema = "source_key string, source_id string, title string, status string, last_seen_at timestamp_ntz, last_verified_at timestamp_ntz, expired_at timestamp_ntz"
    stored = spark.createDataFrame(rows, schema).withColumn("content_hash", M.content_hash(*HASHED))
    return B.create(stored, work_folder(spark, "facts"), "source_key")


def titles(spark, facts):
    return {(r.source_key, r.source_id): (r.title, r.status) for r in facts.read(spark).collect()}


def test_a_change_of_one_source_rewrites_one_partition(spark, listings):
    before, held = files_of(listings), titles(spark, listings)
    plan = listings.of(spark, ["b"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(source_key" in plan
    feed = spark.createDataFrame([("b", "1", "new"), ("b", "9", "more"), ("a", "1", "not of this source")], "source_key string, source_id string, title string")
    merged = B.upsert_source(spark, listings, feed, HASHED, NOW, "b")
    assert {(r.source_id, r.action) for r in merged.collect()} == {("0", "KEPT"), ("1", "UPDATED"), ("2", "KEPT"), ("9", "CREATED")}
    after = files_of(listings)
    same = {f for f in before if after.get(f) == before[f]}
    assert same == {f for f in before if "source_key=b/" not in f}
    assert titles(spark, listings) == held | {("b", "1"): ("new", "ACTIVE"), ("b", "9"): ("more", "ACTIVE")}
    again = B.upsert_source(spark, listings, feed, HASHED, NOW, "b")
    assert {r.action for r in again.collect()} == {"UNCHANGED", "KEPT"}


def test_expiry_and_purge_of_one_source(spark, listings):
    before = files_of(listings)
    B.expire_source(spark, listings, "7", NOW, 14, walk_complete=False)
    assert files_of(listings) == before
    B.expire_source(spark, listings, "7", NOW, 14)
    assert {k for k, (_, status) in titles(spark, listings).items() if status == "EXPIRED"} == {("7", str(i)) for i in range(3)}
    assert B.purge_source(spark, listings, "c/d e") and not B.purge_source(spark, listings, "c/d e")
    assert {k[0] for k in titles(spark, listings)} == {"a", "b", "7"}
    assert {f: t for f, t in files_of(listings).items() if "=a/" in f or "=b/" in f} == {f: t for f, t in before.items() if "=a/" in f or "=b/" in f}


def test_observations_are_merged_and_pruned_by_period(spark):
    month = lambda m: datetime.date(2024, m, 1)
    schema = "series_key string, period_start date, value double, value_state string"
    stored = spark.createDataFrame([(k, month(m), float(m), "PRESENT") for k in "xy" for m in range(1, 6)], schema)
    facts = B.create(stored, work_folder(spark, "facts"), "period_start")
    before = files_of(facts)
    incoming = spark.createDataFrame([("x", month(5), 5.0, "PRESENT"), ("x", month(4), 9.0, "PRESENT"), ("z", month(6), None, "SUPPRESSED")], schema)
    merged = B.merge_periods(spark, facts, incoming)
    assert {(r.series_key, r.period_start.month): r.action for r in merged.collect()} == {
        ("x", 4): "UPDATED", ("y", 4): "KEPT", ("x", 5): "UNCHANGED", ("y", 5): "KEPT", ("z", 6): "CREATED"
    }
    # May holds nothing new, so only April is written again and June added.
    after = files_of(facts)
    assert {f for f in before if after.get(f) != before[f]} == {f for f in before if "2024-04-01" in f}
    rows = {(r.series_key, r.period_start.month): r.value for r in facts.read(spark).collect()}
    assert rows[("x", 4)] == 9.0 and rows[("y", 4)] == 4.0 and rows[("z", 6)] is None and len(rows) == 11
    assert B.prune_periods(spark, facts, 2) == ["2024-01-01", "2024-02-01", "2024-03-01", "2024-04-01"]
    assert {r.period_start.month for r in facts.read(spark).collect()} == {5, 6} and B.prune_periods(spark, facts, 2) == []
    assert B.merge_periods(spark, facts, incoming.filter("period_start = '2024-05-01'")).count() == 2


def test_checksums_follow_the_bytes(spark, tmp_path):
    def checksum(name):
        return R.input_checksum(spark, str(tmp_path / name), "*.csv").first().checksum

    import hashlib

    for name, files in {"one": {"a.csv": b"x,1\n"}, "other": {"a.csv": b"x,2\n"}, "two": {"a.csv": b"x,1\n", "b.csv": b"z"}, "twin": {"b.csv": b"z", "a.csv": b"x,1\n"}, "none": {"c.txt": b"x"}}.items():
        (tmp_path / name).mkdir()
        for file, content in files.items():
            (tmp_path / name / file).write_bytes(content)
    assert checksum("one") == hashlib.sha256(b"x,1\n").hexdigest() != checksum("other")
    assert checksum("two") == checksum("twin") != checksum("one") and checksum("none") is None
    (tmp_path / "twin" / "b.csv").write_bytes(b"y")
    assert checksum("two") != checksum("twin")


def test_figures_keep_every_digit(spark):
    wanted = {
        1 / 3000: "0.0003333333333333333", 1e-19: "0.0000000000000000001", 1e25: "1" + "0" * 25, -1.25e-7: "-0.000000125", 1.2345e7: "12345000",
        12345678.5: "12345678.5", 1.0: "1", -0.5: "-0.5", 100.0: "100", 1e7: "10000000", 1e22: "1" + "0" * 22, 0.0: "0",
    }
    got = {r.v: r.t for r in spark.createDataFrame([(v,) for v in wanted], "v double").select("v", _number(F.col("v")).alias("t")).collect()}
    assert got == wanted
    import random

    rng = random.Random(3)
    values = [rng.uniform(-1, 1) * 10.0 ** rng.randint(-40, 40) for _ in range(500)] + [5e-324, 1.7976931348623157e308]
    for r in spark.createDataFrame([(v,) for v in values], "v double").select("v", _number(F.col("v")).alias("t")).collect():
        assert float(r.t) == r.v and "E" not in r.t


# --- the whole listing import ---------------------------------------------------------------


def feed(spark, records):
    return spark.createDataFrame([(n, json.dumps(r)) for n, r in enumerate(records)], "place long, value string")


def record(i, **more):
    return {"id": i, "title": "Cook", "redirect_url": f"https://x.com/{i}", "description": "Plain work.", **more}


def ingest(spark, records, stored=None, locations=None, registry=(("feed", "ACTIVE", "VERIFIED"),), now=NOW, **rest):
    nothing = spark.createDataFrame([], "source_key string, source_id string, title string, status string, last_seen_at timestamp_ntz, last_verified_at timestamp_ntz, expired_at timestamp_ntz")
    stored = nothing.select("*", *[F.lit(None).cast("string").alias(c) for c in I.HASHED if c not in nothing.columns]) if stored is None else stored
    held = spark.createDataFrame(locations or [], "location_key string, raw_text string, country_name string, state_name string, state_code string, latitude double, longitude double, geo_code string")
    areas = spark.createDataFrame([("1", "New South Wales", "STATE"), ("8", "Canberra", "STATE"), ("8", "Canberra", "SA4"), ("AU", "Australia", "COUNTRY")], "code string, name string, level string")
    companies = spark.createDataFrame([("known",)], "company_key string")
    known = spark.createDataFrame(list(registry), "source_key string, activation string, compliance_status string")
    return I.import_listings(feed(spark, records), stored, companies, held, areas, known, "feed", "au", now, 14, ["place"], **rest)


def test_the_last_version_in_the_feed_counts_whatever_its_hash(spark):
    for first, last in (("v1", "v2"), ("v2", "v1")):
        got = ingest(spark, [record(1, title=first), record(1, title=last)])
        assert [r.title for r in got.listings.collect()] == [last]
        assert tuple(got.counts.first()) == (2, 1, 1, 0)


@pytest.mark.parametrize("registry, reason", [((), "no source registered as feed"), ((("feed", "ACTIVE", "PENDING"),), "ACTIVE / PENDING"), ((("feed", "PAUSED", "VERIFIED"),), "PAUSED / VERIFIED")])
def test_a_source_that_may_not_be_ingested_is_refused(spark, registry, reason):
    with pytest.raises(Exception, match=reason):
        ingest(spark, [record(1)], registry=registry or (("other", "ACTIVE", "VERIFIED"),)).counts.collect()


def test_locations_are_added_from_one_record_and_tried_again(spark):
    place = lambda text, *area, **more: {"location": {"display_name": text, "area": list(area)}, **more}
    records = [
        record(1, **place("Sydney, NSW", "Australia", "New South Wales", "Sydney", latitude=-33.8, longitude=151.2)),
        record(2, **place("Sydney, NSW", "Australia", "Victoria", latitude=1.0, longitude=2.0)),
        record(3, **place("Canberra", "Australia", "Canberra", "Inner")),
        record(4, **place("Anywhere", "Australia")),
        record(5, **place("Mars", "Elsewhere", "Olympus")),
        record(6),
    ]
    held = [("perth", "Perth", "Australia", "NSW", None, None, None, None), ("old", "Old", None, None, None, None, None, "7")]
    got = {r.location_key: r for r in ingest(spark, records, locations=held).locations.collect()}
    sydney = next(r for k, r in got.items() if k.startswith("sydney"))
    assert (sydney.state_name, sydney.state_code, sydney.latitude, sydney.longitude, sydney.geo_code) == ("New South Wales", "NSW", -33.8, 151.2, "1")
    by_text = {r.raw_text: r.geo_code for r in got.values()}
    assert by_text == {"Sydney, NSW": "1", "Canberra": "8", "Anywhere": "AU", "Mars": None, "Perth": "1", "Old": "7"}


def test_signal_stands_beside_the_stored_text(spark):
    offer = "We offer visa sponsorship to the right person. Call 0412 345 678."
    first = ingest(spark, [record(1, description=offer), record(2, company={"display_name": "Known"}), record(3, company={"display_name": "New Co"}), {"id": ""}])
    rows = {r.source_id: r for r in first.listings.collect()}
    assert rows["1"].signal not in (None, "NOT_MENTIONED", "INDETERMINATE") and "sponsorship" in rows["1"].evidence
    assert "0412" not in rows["1"].description and rows["2"].evidence is None
    assert [r.company_key for r in first.companies.collect()] == [rows["3"].company_key]
    ledger = first.ledger.first()
    assert (ledger.source_key, ledger.status, ledger.records_seen, ledger.records_written, ledger.records_skipped, ledger.records_quarantined) == ("feed", "COMPLETED", 4, 3, 0, 1)
    # The second run changes one text: its signal is read anew, the others stay as they were stored.
    stored = first.listings.drop("action").withColumn("signal", F.when(F.col("source_id") == "2", "MARKED").otherwise(F.col("signal")))
    records = [record(1, description="Plain work."), record(2, company={"display_name": "Known"})]
    second = {r.source_id: r for r in ingest(spark, records, stored=stored).listings.collect()}
    assert (second["1"].action, second["1"].evidence) == ("UPDATED", None) and second["1"].signal != rows["1"].signal
    assert (second["2"].action, second["2"].signal) == ("UNCHANGED", "MARKED") and second["3"].action == "KEPT"
