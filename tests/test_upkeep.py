import datetime
import random

import pytest
from pyspark.sql import functions as F

from advertide.operators import dedup as D
from advertide.operators import health as H
from advertide.operators import merge as M
from advertide.operators import quality as Q
from advertide.operators import search as S

AT = datetime.datetime
NOW = "2024-05-20 00:00:00"


def test_merge_actions_are_null_safe(spark):
    stored = spark.createDataFrame([("a", 1.0), ("b", None), ("c", 3.0), (None, 4.0)], "k string, v double")
    incoming = spark.createDataFrame([("a", 2.0), ("b", None), ("d", 5.0), (None, 4.0)], "k string, v double")
    got = {r["k"]: (r["action"], r["v"]) for r in M.latest_of(M.merge(stored, incoming, ["k"], ["v"]), ["k"], ["v"]).collect()}
    assert got == {"a": ("UPDATED", 2.0), "b": ("UNCHANGED", None), "c": ("KEPT", 3.0), "d": ("CREATED", 5.0), None: ("UNCHANGED", 4.0)}


def test_one_row_per_key_and_a_hash_that_marks_nulls(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 1, None)], "k string, n int, v string")
    assert sorted(tuple(r) for r in M.one_per_key(df, ["k"], ["n"]).collect()) == [("a", 1, "y"), ("b", 1, None)]
    pairs = spark.createDataFrame([("x", None), (None, "x"), ("x", "")], "p string, q string")
    assert pairs.select(M.content_hash("p", "q")).distinct().count() == 3


def test_expiry_waits_for_a_complete_walk(spark):
    rows = [("s", "ACTIVE", AT(2024, 5, 1), None), ("s", "ACTIVE", AT(2024, 5, 19), None), ("s", "WITHDRAWN", AT(2024, 1, 1), None), ("o", "ACTIVE", AT(2024, 1, 1), None)]
    jobs = spark.createDataFrame(rows, "source_key string, status string, last_seen_at timestamp_ntz, expired_at timestamp_ntz")
    assert M.expire_unseen(jobs, "s", NOW, 14, walk_complete=False).filter("status = 'EXPIRED'").count() == 0
    expired = M.expire_unseen(jobs, "s", NOW, 14).filter("status = 'EXPIRED'").collect()
    assert len(expired) == 1 and expired[0]["expired_at"] == AT(2024, 5, 20)


def test_gate_and_accounting(spark):
    runs = spark.createDataFrame(
        [("ok", 100, 90, 5, 5), ("bad", 100, 90, 4, 6), ("none", 0, 0, 0, 0)],
        "run_id string, records_seen long, records_written long, records_skipped long, records_quarantined long",
    ).select("*", F.lit("COMPLETED").alias("status"), F.lit(None).cast("string").alias("error"))
    got = {r["run_id"]: (r["status"], r["error"]) for r in M.quarantine_gate(runs, 0.05).collect()}
    assert got == {"ok": ("COMPLETED", None), "bad": ("FAILED", "quarantine rate 6.0% exceeded 5.0%"), "none": ("COMPLETED", None)}
    assert M.require_balanced(runs).count() == 3
    with pytest.raises(Exception, match="add up"):
        M.require_balanced(runs.withColumn("records_skipped", F.lit(7).cast("long"))).collect()


def test_attachments_made_by_hand_are_left_alone(spark):
    wanted = spark.createDataFrame([("j1", "sql", "SQL"), ("j1", "py", "Python")], "job_id string, skill_key string, matched_text string")
    stored = spark.createDataFrame(
        [("j1", "sql", "DETERMINISTIC", "sql"), ("j1", "xl", "DETERMINISTIC", "Excel"), ("j1", "go", "MANUAL", "Go")],
        "job_id string, skill_key string, method string, matched_text string",
    )
    got = {r["skill_key"]: r["action"] for r in M.sync_attachments(wanted, stored, ["job_id", "skill_key"], "matched_text").collect()}
    assert got == {"sql": "REQUOTE", "py": "ATTACH", "xl": "DETACH"}


# --- duplicates, against a direct grouping --------------------------------------------------


def direct_members(rows):
    def key(url):
        if not url or not url.startswith("http"):
            return None
        host, _, path = url.split("://", 1)[1].split("?")[0].partition("/")
        return "url:" + host.removeprefix("www.") + ("/" + path if path else "").rstrip("/")

    def best(members):
        return min(members, key=lambda r: (not r["description"], r["posted_at"] is None, r["posted_at"] or AT.min, r["source_key"], r["id"]))

    claimed, out = set(), {}
    for confidence in (D.BY_URL, D.BY_IDENTITY):
        buckets = {}
        for r in rows:
            if r["id"] in claimed:
                continue
            parts = (r["company_name"], r["title"], r["location_text"])
            signature = key(r["apply_url"]) if confidence == D.BY_URL else (parts if all(parts) else None)
            if signature is not None:
                buckets.setdefault(signature, []).append(r)
        for members in buckets.values():
            if len(members) >= 2 and len({m["source_key"] for m in members}) >= 2:
                for m in members:
                    claimed.add(m["id"])
                    out[m["id"]] = (confidence, best(members)["id"], len(members))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_duplicates_equal_direct_grouping(spark, seed):
    rng = random.Random(seed)
    rows = [
        dict(
            id=f"j{i:03}",
            source_key=rng.choice("ab" if rng.random() < 0.8 else "c"),
            title=rng.choice(["cook", "nurse", ""]),
            company_name=rng.choice(["acme", "bolt", None]),
            location_text=rng.choice(["here", None, "there"]),
            apply_url=rng.choice([None, "mailto:x", "https://www.x.com/1/", "http://x.com/1?u=2", "https://x.com/2", f"https://y.com/{i}"]),
            source_url=None,
            description=rng.choice([None, "text"]),
            posted_at=rng.choice([None, AT(2024, 1, 1), AT(2024, 1, 2)]),
        )
        for i in range(120)
    ]
    schema = "id string, source_key string, title string, company_name string, location_text string, apply_url string, source_url string, description string, posted_at timestamp_ntz"
    found = D.duplicate_members(spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows], schema))
    got = {r["id"]: (r["confidence"], r["canonical_id"], r["members"]) for r in found.collect()}
    assert got == direct_members(rows)


def test_a_bucket_of_one_source_leaves_its_rows_to_the_next_round(spark):
    rows = [
        ("1", "a", "cook", "acme", "here", "https://x.com/1"),
        ("2", "a", "cook", "acme", "here", "https://x.com/1"),
        ("3", "b", "cook", "acme", "here", None),
    ]
    df = spark.createDataFrame(rows, "id string, source_key string, title string, company_name string, location_text string, apply_url string").select(
        "*", F.lit(None).cast("string").alias("source_url"), F.lit("d").alias("description"), F.lit(None).cast("timestamp_ntz").alias("posted_at")
    )
    got = D.duplicate_members(df).collect()
    assert {r["id"] for r in got} == {"1", "2", "3"} and {r["confidence"] for r in got} == {D.BY_IDENTITY}


# --- quality and health ---------------------------------------------------------------------


def test_report_counts_everything_and_shows_five(spark):
    many = Q.failing(spark.range(100), F.lpad(F.col("id").cast("string"), 3, "0"))
    weighed = Q.failing(spark.range(2), F.col("id"), F.lit(4))
    none = Q.failing(spark.range(0), F.col("id"))
    checks = [Q.Check("many", "a", many), Q.Check("weighed", "b", weighed, "why"), Q.Check("none", "c", none)]
    got = Q.report(spark, checks).collect()
    assert [(r["name"], r["status"], r["failures"]) for r in got] == [("many", "FAIL", 100), ("weighed", "FAIL", 8), ("none", "PASS", 0)]
    assert got[0]["examples"] == ["000", "001", "002", "003", "004"] and got[2]["examples"] == []
    assert tuple(Q.summary(Q.report(spark, checks)).collect()[0]) == (1, 2, False)


def test_rules_of_a_table_are_judged_in_one_read(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(40).select("id", (F.col("id") % 4).alias("a"), F.when(F.col("id") % 5 > 0, F.col("id") % 3).alias("b")).write.parquet(path)
    table = spark.read.parquet(path)
    rules = [
        ("a", Q.Rule.broken_by(F.col("a") == 0, F.col("id"))),
        ("b", Q.Rule(F.concat_ws(":", F.lit("b"), "id"), F.col("b"))),
        ("a", Q.Rule.broken_by(F.col("b").isNull(), F.col("id"))),
    ]
    found = Q.failures(table, rules)
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    sums = {r["name"]: (r["n"], r["w"]) for r in found.groupBy("name").agg(F.count("*").alias("n"), F.sum("weight").alias("w")).collect()}
    rows = [(i, i % 4, i % 3 if i % 5 else None) for i in range(40)]
    assert sums["a"] == (sum((a == 0) + (b is None) for _, a, b in rows),) * 2
    assert sums["b"] == (sum(1 for *_, b in rows if b), sum(b or 0 for *_, b in rows))
    got = Q.report(spark, [Q.Check("a", "x", None), Q.Check("b", "y", None), Q.Check("c", "z", Q.failing(table.limit(1), F.col("id")))], [found], 2).collect()
    assert [(r["name"], r["failures"]) for r in got] == [("a", sums["a"][1]), ("b", sums["b"][1]), ("c", 1)]
    assert got[0]["examples"] == ["0", "0"] and got[1]["examples"] == ["b:1", "b:11"]


@pytest.mark.parametrize(
    "success, failure, verified, errors, scheduled, expected",
    [
        (None, None, None, 0, True, "NOT_RUN"),
        (None, "2024-05-19", None, 0, True, "FAILING"),
        ("2024-05-18", "2024-05-19", None, 0, True, "FAILING"),
        ("2024-05-19", "2024-05-18", None, 0, True, "HEALTHY"),
        ("2024-05-10", None, None, 0, True, "SILENT"),
        ("2024-05-10", None, None, 0, False, "HEALTHY"),
        ("2024-05-19", None, "2024-05-01", 0, True, "STALE"),
        ("2024-05-19", None, "2024-05-01", 0, False, "HEALTHY"),
        ("2024-05-19", None, None, 3, True, "STALE"),
    ],
)
def test_health_verdicts(spark, success, failure, verified, errors, scheduled, expected):
    stamp = lambda text: F.lit(text).cast("timestamp_ntz")
    facts = spark.range(1).select(
        F.lit(scheduled).alias("scheduled"), stamp(success).alias("last_success_at"), stamp(failure).alias("last_failure_at"),
        stamp(verified).alias("oldest_verified_at"), F.lit(errors).alias("quarantined_recently"),
    )
    assert H.with_verdict(facts, NOW).collect()[0]["health"] == expected


@pytest.mark.parametrize(
    "status, verified, posted, expected",
    [
        ("ACTIVE", AT(2024, 5, 19), AT(2024, 5, 17), "NEW"),
        ("ACTIVE", AT(2024, 5, 19), AT(2024, 5, 16, 23), "ACTIVE"),
        ("ACTIVE", AT(2024, 5, 12, 23), AT(2024, 5, 19), "STALE"),
        ("ACTIVE", AT(2024, 5, 13), None, "ACTIVE"),
        ("ACTIVE", None, None, "STALE"),
        ("EXPIRED", AT(2024, 5, 19), None, "EXPIRED"),
        ("WITHDRAWN", AT(2024, 5, 19), None, "REMOVED"),
    ],
)
def test_lifecycle(spark, status, verified, posted, expected):
    row = [(status, AT(2024, 5, 1), verified, posted)]
    df = spark.createDataFrame(row, "status string, first_seen_at timestamp_ntz, last_verified_at timestamp_ntz, posted_at timestamp_ntz")
    assert df.select(S.lifecycle(NOW)).collect()[0][0] == expected


def test_pages_are_clamped(spark):
    df = spark.range(120).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("id"), F.lit(None).cast("timestamp_ntz").alias("posted_at"))
    assert S.page_of(df, 0, 500).count() == 50
    assert [r["id"] for r in S.page_of(df, 3, 50).collect()][:2] == ["100", "101"]
    assert S.page_of(df, -1, 0).count() == 1


def test_upsert_keeps_stored_columns_and_the_last_version(spark):
    names = [*M.LISTING_KEYS, "title", "status", "last_seen_at", "last_verified_at", "expired_at", "first_seen_at", "is_canonical"]
    kinds = ["string"] * 4 + ["timestamp_ntz"] * 4 + ["boolean"]
    schema = ", ".join(f"{n} {t}" for n, t in zip(names, kinds))
    day = datetime.datetime(2026, 1, 1)
    stored = spark.createDataFrame(
        [("feed", "k1", "old", "ACTIVE", day, day, None, day, False), ("feed", "k9", "kept", "EXPIRED", day, day, day, day, True)], schema
    )
    versions = [("feed", "k1", "v1", 1), ("feed", "k1", "v2", 2), ("feed", "k2", "new", 1)]
    for order in (versions, versions[::-1]):
        fed = spark.createDataFrame(order, f"{M.LISTING_KEYS[0]} string, {M.LISTING_KEYS[1]} string, title string, seen int")
        after = M.upsert_listings(stored, fed, ["title"], "2026-02-02 00:00:00", ["seen"]).collect()
        got = {r[M.LISTING_KEYS[1]]: (r.title, r.first_seen_at.month, r.is_canonical) for r in after}
        assert got == {"k1": ("v2", 1, False), "k2": ("new", 2, None), "k9": ("kept", 1, True)}
