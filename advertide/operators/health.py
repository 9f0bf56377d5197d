"""Is each source being read? One grouped pass per table, one verdict per source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STALE_AFTER_HOURS = 36
QUARANTINE_WINDOW_HOURS = 48
EXPIRE_AFTER_DAYS = 14
# Ways of retrieval that run on a schedule.
SCHEDULED = ("API", "CRAWL")


def run_facts(runs: DataFrame) -> DataFrame:
    """Per source: the last success with its counters, the last failure and the oldest run still going."""
    done = F.when(F.col("status") == "COMPLETED", F.col("finished_at"))
    failed = F.when(F.col("status") == "FAILED", F.col("started_at"))
    success = F.max(F.when(done.isNotNull(), F.struct(done.alias("at"), "run_id", "records_written", "records_seen")))
    failure = F.max(
        F.when(
            failed.isNotNull(),
            F.struct(failed.alias("started"), "run_id", F.coalesce("finished_at", "started_at").alias("at"), "error"),
        )
    )
    return (
        runs.groupBy("source_key")
        .agg(
            success.alias("success"),
            failure.alias("failure"),
            F.min(F.when(F.col("status") == "RUNNING", F.col("started_at"))).alias("running_since"),
        )
        .select(
            "source_key",
            F.col("success.at").alias("last_success_at"),
            F.coalesce("success.records_written", F.lit(0)).alias("records_written"),
            F.coalesce("success.records_seen", F.lit(0)).alias("records_seen"),
            F.col("failure.at").alias("last_failure_at"),
            F.col("failure.error").alias("last_failure_message"),
            "running_since",
        )
    )


def source_facts(registry: DataFrame, runs: DataFrame, jobs: DataFrame, errors: DataFrame, now: str) -> DataFrame:
    """Everything a verdict rests on, one row per eligible source."""
    at = F.lit(now).cast("timestamp_ntz")
    live = (
        jobs.filter(F.col("status") == "ACTIVE")
        .groupBy("source_key")
        .agg(F.count(F.lit(1)).alias("active_listings"), F.min("last_verified_at").alias("oldest_verified_at"))
    )
    recent = (
        errors.filter(F.col("occurred_at") >= at - F.make_dt_interval(hours=F.lit(QUARANTINE_WINDOW_HOURS)))
        .groupBy("source_key")
        .agg(F.count(F.lit(1)).alias("quarantined_recently"))
    )
    eligible = (F.col("activation") == "ACTIVE") & (F.col("compliance_status") == "VERIFIED")
    sources = registry.filter(eligible).select(
        "source_key", "display_name", F.coalesce(F.col("retrieval_method").isin(*SCHEDULED), F.lit(False)).alias("scheduled")
    )
    joined = (
        sources.join(run_facts(runs), "source_key", "left").join(live, "source_key", "left").join(recent, "source_key", "left")
    )
    return joined.fillna(0, ["records_written", "records_seen", "active_listings", "quarantined_recently"])


def with_verdict(facts: DataFrame, now: str) -> DataFrame:
    """NOT_RUN, FAILING, SILENT, STALE or HEALTHY; the first that applies."""
    at = F.lit(now).cast("timestamp_ntz")
    hours = lambda moment: F.timestamp_diff("MICROSECOND", moment, at) / 3_600_000_000
    success, failure = F.col("last_success_at"), F.col("last_failure_at")
    health = (
        F.when(success.isNull() & failure.isNull(), "NOT_RUN")
        .when(failure.isNotNull() & (success.isNull() | (failure > success)), "FAILING")
        .when(F.col("scheduled") & (hours(success) > STALE_AFTER_HOURS), "SILENT")
        .when(F.col("scheduled") & (hours(F.col("oldest_verified_at")) > EXPIRE_AFTER_DAYS * 24), "STALE")
        .when(F.col("quarantined_recently") > 0, "STALE")
        .otherwise("HEALTHY")
    )
    reason = (
        F.when(success.isNull() & failure.isNull(), "no run has ever been recorded")
        .when(failure.isNotNull() & (success.isNull() | (failure > success)), "the most recent run failed")
        .when(
            F.col("scheduled") & (hours(success) > STALE_AFTER_HOURS),
            F.format_string("no successful run for %d hours", F.floor(hours(success))),
        )
        .when(
            F.col("scheduled") & (hours(F.col("oldest_verified_at")) > EXPIRE_AFTER_DAYS * 24),
            "listings are held that no run has confirmed within the expiry window",
        )
        .when(
            F.col("quarantined_recently") > 0,
            F.format_string("%d records could not be parsed recently", F.col("quarantined_recently")),
        )
    )
    return facts.withColumn("health", health).withColumn("reason", reason)


def overall(verdicts: DataFrame) -> DataFrame:
    """One row: how many sources, how many healthy, and whether all are."""
    healthy = F.col("health") == "HEALTHY"
    return verdicts.agg(
        F.count(F.lit(1)).alias("sources"),
        F.count_if(healthy).alias("healthy"),
        F.coalesce(F.bool_and(healthy), F.lit(True)).alias("ok"),
    )
