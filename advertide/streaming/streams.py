"""The daily batch jobs as streams: upsert with rejects beside it, expiry of the unseen, health over time.

State lives in the JVM state store and is bounded by the watermark; output goes
to tables written one partition per batch, so a batch run twice writes the same.

A change log is kept as a snapshot and a tail. Every so many batches all that came
before the running batch is written as a snapshot, one partition per source, and
published by a row in the manifest; batches and snapshots it replaces are removed
afterwards. The engine has committed every batch before the running one, so no
batch that may run again lies in a snapshot, and what a crash leaves behind is
either not published yet (and written anew) or passed over by readers.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from advertide.operators import merge as M
from advertide.session import drop_folder, folder_exists, subfolders

KEYS = ["source_key", "source_id"]
# Folders of a log beside its batches; a leading underscore keeps them out of reads of the batches.
SNAPSHOTS, MANIFEST = "_snapshots", "_manifest"


def read_stream(spark: SparkSession, path: str, schema, name_pattern: str, files_per_batch: int = 1000) -> DataFrame:
    """Parquet files of a folder as they arrive."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", name_pattern)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(path)
    )


def first_sightings(stream: DataFrame, event_time: str, delay: str, hashed: list[str]) -> DataFrame:
    """Each sighting of a version once, however often the feed repeats it.

    The time of the sighting is part of the key: a listing that changes and changes
    back is three sightings, and one seen again tomorrow renews its own.
    """
    marked = stream.withColumn("content_hash", M.content_hash(*hashed))
    return marked.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([*KEYS, "content_hash", event_time])


def current_listings(log: DataFrame) -> DataFrame:
    """The state a change log has reached: the last change of every key. Partial maximums, no ordering."""
    rest = [c for c in log.columns if c not in KEYS and c != "batch"]
    last = F.max_by(F.struct(*rest), F.col("batch")).alias("last")
    return log.groupBy(*KEYS).agg(last).select(*KEYS, "last.*")


def current_hashes(log: DataFrame) -> DataFrame:
    """Keys and content hashes a change log has reached; no other column of it is read."""
    return log.groupBy(*KEYS).agg(F.max_by("content_hash", "batch").alias("content_hash"))


def compact(log: DataFrame, batch: int) -> DataFrame:
    """A log with every key once, as of a batch."""
    return current_listings(log.filter(F.col("batch") <= batch)).withColumn("batch", F.lit(batch).cast("bigint"))


def batches(spark: SparkSession, log: str) -> list[int]:
    """Numbers of the batches that lie in a log."""
    found = (re.fullmatch(r"batch=(-?\d+)", name) for name in subfolders(spark, log))
    return sorted(int(m[1]) for m in found if m)


def published(spark: SparkSession, log: str) -> int | None:
    """The last batch of the newest published snapshot."""
    upto = [int(name.removeprefix("upto=")) for name in subfolders(spark, f"{log}/{MANIFEST}")]
    whole = [n for n in upto if folder_exists(spark, f"{log}/{MANIFEST}/upto={n}/_SUCCESS")]
    return max(whole, default=None)


def read_log(spark: SparkSession, log: str, before: int | None = None) -> DataFrame:
    """Snapshot and tail of a log: each key's changes since the snapshot and one row for all before; ``before`` a batch."""
    upto = published(spark, log)
    tail = [n for n in batches(spark, log) if (upto is None or n > upto) and (before is None or n < before)]
    parts = [] if upto is None else [spark.read.parquet(f"{log}/{SNAPSHOTS}/upto={upto}")]
    # Batch by batch, since a table's first batch may hold other columns and kinds of time than later ones.
    for n in tail:
        parts.append(spark.read.parquet(f"{log}/batch={n}").withColumn("batch", F.lit(n).cast("bigint")))
    if not parts:
        raise ValueError(f"{log} holds no batch before {before}")
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole


def known_hashes(log: DataFrame, keys: DataFrame, most_sources: int = 1000) -> DataFrame:
    """Keys and content hashes a log has reached, for some keys only.

    A snapshot lies in one partition per source, and only those of the keys' sources
    are read: their names, of which there are as many as feeds in a batch, become a
    partition filter, unless there are more than ``most_sources``. Small enough keys
    are broadcast, and the snapshot stays where it lies.
    """
    sources = [r[0] for r in keys.select("source_key").distinct().limit(most_sources + 1).collect()]
    if len(sources) <= most_sources:
        log = log.filter(F.col("source_key").isin(sources))
    return current_hashes(log.join(keys.select(*KEYS).distinct(), KEYS, "left_semi"))


def take_snapshot(spark: SparkSession, log: str, upto: int) -> None:
    """Write the state as of a batch, publish it, then remove what it replaces."""
    state = compact(read_log(spark, log, upto + 1), upto)
    state.write.mode("overwrite").partitionBy("source_key").parquet(f"{log}/{SNAPSHOTS}/upto={upto}")
    publish(spark, log, upto)
    clean_up(spark, log)


def publish(spark: SparkSession, log: str, upto: int) -> None:
    spark.range(1).select(F.lit(upto).alias("batch")).coalesce(1).write.mode("overwrite").parquet(f"{log}/{MANIFEST}/upto={upto}")


def clean_up(spark: SparkSession, log: str) -> None:
    """Remove batches and snapshots that the newest published snapshot replaces; safe to run again."""
    upto = published(spark, log)
    if upto is None:
        return
    for n in batches(spark, log):
        if n <= upto:
            drop_folder(spark, f"{log}/batch={n}")
    for kind in (SNAPSHOTS, MANIFEST):
        for name in subfolders(spark, f"{log}/{kind}"):
            if int(name.removeprefix("upto=")) < upto:
                drop_folder(spark, f"{log}/{kind}/{name}")


def _write_batch(df: DataFrame, path: str, batch: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def upsert_into(
    log: str,
    rejects: str,
    hashed: list[str],
    fault: Column,
    now: Callable[[int], str],
    version: list[str] | None = None,
    snapshot_every: int = 50,
):
    """A foreachBatch step: rejects to their own table, changes appended to the log.

    Of several versions of a key in a batch the last by the ``version`` columns counts.
    Only created and updated listings and those whose sighting is renewed are
    written, never the whole table. When the tail before the batch has reached
    ``snapshot_every`` batches, it becomes part of a new snapshot first.
    """

    def step(incoming: DataFrame, batch: int) -> None:
        spark = incoming.sparkSession
        judged = incoming.withColumn("fault", fault).persist()
        try:
            _write_batch(judged.filter(F.col("fault").isNotNull()).select(*KEYS, F.col("fault").alias("message")), rejects, batch)
            accepted = judged.filter(F.col("fault").isNull()).select(*hashed, *(version or []))
            upto = published(spark, log)
            tail = [n for n in batches(spark, log) if n < batch and (upto is None or n > upto)]
            if len(tail) >= snapshot_every:
                take_snapshot(spark, log, tail[-1])
            # Changes of this very batch are left out, so a repeated batch sees what it saw before.
            known = known_hashes(read_log(spark, log, batch), accepted)
            _write_batch(M.listing_changes(known, accepted, hashed, now(batch), version), log, batch)
        finally:
            judged.unpersist()

    return step


def run_to_end(stream: DataFrame, progress: str, step=None, sink: str | None = None) -> None:
    """Run a stream over what has arrived and stop."""
    writer = stream.writeStream.option("checkpointLocation", progress).trigger(availableNow=True)
    if step is not None:
        query = writer.foreachBatch(step).start()
    else:
        query = writer.format("parquet").outputMode("append").start(sink)
    query.awaitTermination()


def expiries(stream: DataFrame, event_time: str, keys: list[str], unseen_for: str, delay: str) -> DataFrame:
    """One row per key each time it goes unseen for the given span: when it was last seen and when it expires.

    A session that closes after the span without a sighting is exactly that, and
    the engine drops its state when it closes.
    """
    seen = stream.withWatermark(event_time, delay)
    return (
        seen.groupBy(F.session_window(event_time, unseen_for).alias("session"), *keys)
        .agg(F.count(F.lit(1)).alias("sightings"), F.max(event_time).alias("last_seen_at"))
        .select(*keys, "sightings", "last_seen_at", F.col("session.end").alias("expires_at"))
    )


def run_counts(stream: DataFrame, event_time: str, delay: str, span: str) -> DataFrame:
    """Per source and span of time: runs, successes and failures. Rows later than the watermark are not counted."""
    status = F.col("status")
    return (
        stream.withWatermark(event_time, delay)
        .groupBy(F.window(event_time, span).alias("span"), "source_key")
        .agg(
            F.count(F.lit(1)).alias("runs"),
            F.count_if(status == "COMPLETED").alias("completed"),
            F.count_if(status == "FAILED").alias("failed"),
        )
        .select(F.col("span.start").alias("span_start"), "source_key", "runs", "completed", "failed")
    )


def recent_quarantine(stream: DataFrame, event_time: str, delay: str, span: str = "48 hours", every: str = "12 hours") -> DataFrame:
    """Per source how many records were set aside in the sliding span before each step."""
    return (
        stream.withWatermark(event_time, delay)
        .groupBy(F.window(event_time, span, every).alias("span"), "source_key")
        .agg(F.count(F.lit(1)).alias("quarantined"))
        .select(F.col("span.end").alias("as_of"), "source_key", "quarantined")
    )
