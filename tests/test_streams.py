import datetime
import re
import tempfile

from pyspark.sql import functions as F

from advertide.operators import merge as M
from advertide.streaming import streams as Z

AT = datetime.datetime
LISTING = "source_key string, source_id string, title string, description string, fed_at timestamp"
HASHED = ["source_key", "source_id", "title", "description"]


def folder(name):
    return tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/" + name


def arrive(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_upsert_stream(spark):
    inbox, log, rejects, progress = (folder(n) for n in ("inbox", "log", "rejects", "progress"))
    start = spark.createDataFrame(
        [("s", "1", "old", "d", "ACTIVE"), ("s", "9", "gone", "d", "ACTIVE")], "source_key string, source_id string, title string, description string, status string"
    ).select(
        "*", F.lit("CREATED").alias("action"), M.content_hash(*HASHED).alias("content_hash"),
        *[F.lit(None).cast("timestamp_ntz").alias(c) for c in ("last_seen_at", "last_verified_at", "expired_at")],
    )
    start.write.parquet(f"{log}/batch=-1")
    step = Z.upsert_into(log, rejects, HASHED, F.when(F.length("title") < 2, "title"), lambda batch: f"2024-05-0{batch + 1} 00:00:00")

    def run():
        feed = Z.read_stream(spark, inbox, spark.read.parquet(inbox).schema, "*.parquet")
        Z.run_to_end(Z.first_sightings(feed, "fed_at", "1 day", HASHED), progress, step)

    day = AT(2024, 5, 1)
    arrive(spark, [("s", "1", "new", "d", day), ("s", "1", "new", "d", day), ("s", "2", "two", "d", day), ("s", "3", "x", "d", day)], LISTING, inbox)
    run()
    state = {r["source_id"]: (r["action"], r["title"]) for r in Z.current_listings(spark.read.parquet(log)).collect()}
    assert state == {"1": ("UPDATED", "new"), "2": ("CREATED", "two"), "9": ("CREATED", "gone")}
    assert [r["source_id"] for r in spark.read.parquet(rejects).collect()] == ["3"]

    arrive(spark, [("s", "2", "two", "d", AT(2024, 5, 3)), ("s", "4", "four", "d", AT(2024, 5, 3))], LISTING, inbox)
    run()
    log_rows = spark.read.parquet(log)
    state = {r["source_id"]: (r["action"], str(r["last_seen_at"])[:10]) for r in Z.current_listings(log_rows).collect()}
    # The run between the two only moved the watermark, so this is its third batch.
    assert state["2"] == ("UNCHANGED", "2024-05-03") and state["4"][0] == "CREATED" and state["1"] == ("UPDATED", "2024-05-01")
    # A batch holds what it changed, not the table.
    assert log_rows.filter("batch = 2").count() == 2
    whole = Z.compact(log_rows, 2)
    assert whole.count() == 4 and whole.select("source_id").distinct().count() == 4


def test_a_listing_that_changes_back_within_a_day(spark):
    inbox, log, rejects, progress = (folder(n) for n in ("inbox", "log", "rejects", "progress"))
    start = spark.createDataFrame([], "source_key string, source_id string, content_hash string, action string")
    start.write.parquet(f"{log}/batch=-1")
    step = Z.upsert_into(log, rejects, HASHED, F.lit(None).cast("string"), lambda batch: "2024-05-01 00:00:00", ["fed_at"])

    def run(rows):
        arrive(spark, [("s", "1", title, "d", AT(2024, 5, 1, hour)) for title, hour in rows], LISTING, inbox)
        feed = Z.read_stream(spark, inbox, spark.read.parquet(inbox).schema, "*.parquet")
        Z.run_to_end(Z.first_sightings(feed, "fed_at", "1 day", HASHED), progress, step)
        state = Z.current_listings(spark.read.schema(f"{LISTING}, content_hash string, action string, batch int").parquet(log))
        return [(r["title"], r["action"]) for r in state.collect()]

    assert run([("A", 1)]) == [("A", "CREATED")]
    assert run([("B", 2)]) == [("B", "UPDATED")]
    assert run([("A", 3)]) == [("A", "UPDATED")]
    # Both versions in one batch: the later one counts.
    assert run([("A", 5), ("C", 4)]) == [("A", "UNCHANGED")]


def changes(spark, rows, hour):
    return spark.createDataFrame([(s, i, title, "d", AT(2024, 5, 1, hour)) for s, i, title in rows], LISTING)


def state_of(spark, log, before=None):
    return {(r["source_key"], r["source_id"]): r["title"] for r in Z.current_listings(Z.read_log(spark, log, before)).collect()}


def test_a_log_is_kept_as_snapshot_and_tail(spark):
    log, rejects = folder("log"), folder("rejects")
    spark.createDataFrame([], "source_key string, source_id string, title string, content_hash string, action string").write.parquet(f"{log}/batch=-1")
    step = Z.upsert_into(log, rejects, HASHED, F.lit(None).cast("string"), lambda batch: f"2024-05-{batch + 1:02} 00:00:00", ["fed_at"], 3)
    fed = [[("a", "1", "x0"), ("b", "1", "y0")], [("a", "1", "x1")], [("a", "2", "z2")], [("a", "1", "x3"), ("c", "1", "w3")], [("b", "1", "y4")], [("c", "1", "w5")]]
    want, states = {}, []
    for batch, rows in enumerate(fed):
        step(changes(spark, rows, batch), batch)
        want |= {(s, i): title for s, i, title in rows}
        states.append(dict(want))
        assert state_of(spark, log) == want
    # Batches -1, 0 and 1 went into the first snapshot, 2 to 4 into the second: only the last batch is a tail.
    assert Z.published(spark, log) == 4 and Z.batches(spark, log) == [5]
    assert [n for n in Z.subfolders(spark, f"{log}/{Z.SNAPSHOTS}")] == ["upto=4"]
    # The running batch again, as after a crash before the engine has noted it: the same changes.
    before = sorted(map(str, spark.read.parquet(f"{log}/batch=5").collect()))
    step(changes(spark, fed[5], 5), 5)
    assert sorted(map(str, spark.read.parquet(f"{log}/batch=5").collect())) == before and state_of(spark, log) == want
    # Known hashes are read of the batch's sources only.
    plan = Z.known_hashes(Z.read_log(spark, log, 6), changes(spark, [("b", "1", "q")], 9))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*source_key", plan)


def test_crashes_around_a_snapshot_lose_and_repeat_nothing(spark):
    log, rejects = folder("log"), folder("rejects")
    spark.createDataFrame([], "source_key string, source_id string, title string, content_hash string, action string").write.parquet(f"{log}/batch=-1")
    step = Z.upsert_into(log, rejects, HASHED, F.lit(None).cast("string"), lambda batch: "2024-05-01 00:00:00", ["fed_at"], 99)
    for batch, title in enumerate(("p", "q", "r")):
        step(changes(spark, [("a", "1", title), ("a", f"k{batch}", title)], batch), batch)
    want = state_of(spark, log)
    # Written but not published: readers go on with the batches.
    Z.compact(Z.read_log(spark, log, 2), 1).write.partitionBy("source_key").parquet(f"{log}/{Z.SNAPSHOTS}/upto=1")
    assert Z.published(spark, log) is None and state_of(spark, log) == want
    # Published but not cleaned up: the old batches are passed over, though they still lie there.
    Z.publish(spark, log, 1)
    assert Z.published(spark, log) == 1 and Z.batches(spark, log) == [-1, 0, 1, 2]
    assert state_of(spark, log) == want and Z.read_log(spark, log).filter("batch < 1").count() == 0
    # Half cleaned up, then cleaned up again.
    Z.drop_folder(spark, f"{log}/batch=0")
    assert state_of(spark, log) == want
    Z.clean_up(spark, log)
    Z.clean_up(spark, log)
    assert Z.batches(spark, log) == [2] and state_of(spark, log) == want
    # A manifest row that was not finished counts for nothing.
    spark.range(1).write.parquet(f"{log}/{Z.MANIFEST}/upto=2")
    Z.drop_folder(spark, f"{log}/{Z.MANIFEST}/upto=2/_SUCCESS")
    assert Z.published(spark, log) == 1 and state_of(spark, log) == want


def test_expiry_and_late_rows(spark):
    inbox, sink, progress = (folder(n) for n in ("inbox", "sink", "progress"))
    schema = "ts timestamp, k string"

    def run():
        feed = Z.read_stream(spark, inbox, spark.read.parquet(inbox).schema, "*.parquet")
        Z.run_to_end(Z.expiries(feed, "ts", ["k"], "2 days", "0 seconds"), progress, sink=sink)

    arrive(spark, [(AT(2024, 5, 1), "a"), (AT(2024, 5, 2), "a"), (AT(2024, 5, 1), "b")], schema, inbox)
    run()
    arrive(spark, [(AT(2024, 5, 3, 12), "a"), (AT(2024, 5, 6), "c"), (AT(2024, 5, 1), "z")], schema, inbox)
    run()
    arrive(spark, [(AT(2024, 5, 20), "d"), (AT(2024, 5, 2), "b")], schema, inbox)
    run()
    got = sorted((r["k"], r["sightings"], r["expires_at"].isoformat()[:13]) for r in spark.read.parquet(sink).collect())
    assert ("a", 3, "2024-05-05T12") in got and ("b", 1, "2024-05-03T00") in got and ("c", 1, "2024-05-08T00") in got
    # The sighting of b that came after its expiry was too late to bring it back.
    assert [g for g in got if g[0] == "b"] == [("b", 1, "2024-05-03T00")]


def test_run_counts_drop_late_rows(spark):
    inbox, sink, progress = (folder(n) for n in ("inbox", "sink", "progress"))
    schema = "ts timestamp, source_key string, status string"

    def run():
        feed = Z.read_stream(spark, inbox, spark.read.parquet(inbox).schema, "*.parquet")
        Z.run_to_end(Z.run_counts(feed, "ts", "1 hour", "1 day"), progress, sink=sink)

    arrive(spark, [(AT(2024, 5, 1, 3), "s", "COMPLETED"), (AT(2024, 5, 1, 4), "s", "FAILED"), (AT(2024, 5, 3), "s", "COMPLETED")], schema, inbox)
    run()
    arrive(spark, [(AT(2024, 5, 1, 5), "s", "COMPLETED"), (AT(2024, 5, 9), "s", "COMPLETED")], schema, inbox)
    run()
    got = sorted((str(r["span_start"])[:10], r["runs"], r["completed"], r["failed"]) for r in spark.read.parquet(sink).collect())
    assert got == [("2024-05-01", 2, 1, 1), ("2024-05-03", 1, 1, 0)]
