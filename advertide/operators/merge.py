"""Keeping tables: merges on natural keys, sweeps over stored rows, retention, quarantine and run records.

Every merge is one full-outer join on the natural key that yields each key's
action; the snapshot, the rows that changed and the counters all come from it. A
second identical run finds nothing to change.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from advertide.functions.redaction import CONTACT_RULES, Rule, redaction

CREATED, UPDATED, UNCHANGED, KEPT = "CREATED", "UPDATED", "UNCHANGED", "KEPT"
WRITTEN = (CREATED, UPDATED)


def content_hash(*columns: str) -> Column:
    """Digest of a fixed list of fields, nulls marked, so a moved value never looks the same."""
    return F.sha2(F.to_json(F.array(*[F.col(c).cast("string") for c in columns])), 256)


def one_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The least row of each key. Partial minimums are taken before the shuffle, so a hot key is no burden."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("best")
    return df.groupBy(*keys).agg(best).select(*keys, "best.*")


def merge(stored: DataFrame, incoming: DataFrame, keys: list[str], compare: list[str]) -> DataFrame:
    """Full-outer merge: keys, an ``action`` and both sides as structs ``old`` and ``new``.

    ``compare`` lists the columns a change is judged by, null-safe. Keys are matched null-safe.
    """
    old = stored.select(*[F.col(k).alias(f"old_{k}") for k in keys], F.struct(*stored.columns).alias("old"))
    new = incoming.select(*[F.col(k).alias(f"new_{k}") for k in keys], F.struct(*incoming.columns).alias("new"))
    same_key = reduce(lambda a, b: a & b, [F.col(f"old_{k}").eqNullSafe(F.col(f"new_{k}")) for k in keys])
    same = reduce(lambda a, b: a & b, [F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}")) for c in compare])
    action = (
        F.when(F.col("old").isNull(), CREATED)
        .when(F.col("new").isNull(), KEPT)
        .when(same, UNCHANGED)
        .otherwise(UPDATED)
    )
    joined = old.join(new, same_key, "full_outer")
    return joined.select(
        *[F.coalesce(f"new.{k}", f"old.{k}").alias(k) for k in keys], action.alias("action"), "old", "new"
    )


def latest_of(merged: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The merged snapshot: written rows as incoming, all others as stored."""
    written = F.col("action").isin(*WRITTEN)
    return merged.select(
        *keys, "action", *[F.when(written, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) for c in columns]
    )


def outcome(merged: DataFrame) -> DataFrame:
    """One row of counters."""
    count = lambda action: F.count_if(F.col("action") == action)
    return merged.agg(
        count(CREATED).alias("created"),
        count(UPDATED).alias("updated"),
        count(UNCHANGED).alias("unchanged"),
        count(KEPT).alias("kept"),
    )


LISTING_KEYS = ["source_key", "source_id"]


def last_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is last by ``order``; among equals the greatest content hash, so reruns agree.

    The hash is picked beside the rest of the row, by the same order and so from the same
    row: who only asks what changed moves and sorts no text.
    """
    rest = [c for c in df.columns if c not in keys]
    hashes = [c for c in ("content_hash",) if c in rest]
    place = F.struct(*order, *hashes)
    fields = [c for c in rest if c not in hashes]
    picked = [F.max_by(F.col(c), place).alias(c) for c in hashes]
    if fields:
        picked.append(F.max_by(F.struct(*fields), place).alias("row"))
    kept = df.groupBy(*keys).agg(*picked)
    return kept.select(*keys, *[F.col(c) if c in hashes else F.col("row")[c].alias(c) for c in rest])


def listing_changes(
    known: DataFrame, incoming: DataFrame, hashed: list[str], now: str, version: list[str] | None = None
) -> DataFrame:
    """Every listing of a feed as created, updated or unchanged, live and confirmed now.

    ``known`` is thin: the keys and ``content_hash`` of what is stored. No stored
    text is read or moved to tell what changed.
    """
    fresh = incoming.withColumn("content_hash", content_hash(*hashed))
    once = last_per_key(fresh, LISTING_KEYS, version) if version else one_per_key(fresh, LISTING_KEYS, ["content_hash"])
    held = known.select(*LISTING_KEYS, F.col("content_hash").alias("held_hash"), F.lit(True).alias("is_held"))
    action = (
        F.when(F.col("is_held").isNull(), CREATED)
        .when(F.col("held_hash").eqNullSafe(F.col("content_hash")), UNCHANGED)
        .otherwise(UPDATED)
    )
    at = F.lit(now).cast("timestamp_ntz")
    return once.join(held, LISTING_KEYS, "left").select(
        *LISTING_KEYS,
        action.alias("action"),
        *[c for c in hashed if c not in LISTING_KEYS],
        "content_hash",
        F.lit("ACTIVE").alias("status"),
        at.alias("last_seen_at"),
        at.alias("last_verified_at"),
        F.lit(None).cast("timestamp_ntz").alias("expired_at"),
    )


def upsert_listings(
    stored: DataFrame, incoming: DataFrame, hashed: list[str], now: str, version: list[str] | None = None
) -> DataFrame:
    """The whole table after a feed: its listings as changed, all others as stored.

    Columns that the feed does not state stay as stored; ``first_seen_at``, where the
    table has it, is now for a created listing. A ``content_hash`` the table already
    stores is used as it is. Of several versions of a key the last by the ``version``
    columns counts. Stored rows meet the feed's keys only, so a feed small enough to
    broadcast leaves the table where it lies.
    """
    known = stored if "content_hash" in stored.columns else stored.withColumn("content_hash", content_hash(*hashed))
    changes = listing_changes(known, incoming, hashed, now, version)
    carried = [c for c in known.columns if c not in changes.columns]
    if carried:
        changes = changes.join(known.select(*LISTING_KEYS, *carried), LISTING_KEYS, "left")
    if "first_seen_at" in carried:
        changes = changes.withColumn("first_seen_at", F.coalesce("first_seen_at", F.lit(now).cast("timestamp_ntz")))
    untouched = known.join(incoming.select(*LISTING_KEYS).distinct(), LISTING_KEYS, "left_anti")
    return changes.unionByName(untouched.withColumn("action", F.lit(KEPT)).select(*changes.columns))


def merge_observations(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Observations by series and period, written only where the state or the value differs."""
    return merge(stored, incoming, ["series_key", "period_start"], ["value_state", "value"])


def merge_series(stored: DataFrame, incoming: DataFrame, described: list[str], resolved: list[str]) -> DataFrame:
    """Series by key: what the source states always wins, a resolved id is refreshed, an unresolved one stays unresolved."""
    merged = merge(stored, incoming, ["series_key"], described + resolved)
    return latest_of(merged, ["series_key"], described + resolved)


def refresh_decisions(rows: DataFrame, stored: DataFrame, now: str, refresh_after_days: int) -> DataFrame:
    """Each listed address: touched if stored, skipped while recently verified, fetched otherwise."""
    cutoff = F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(F.lit(refresh_after_days))
    known = stored.groupBy(F.col("source_url").alias("detail_url")).agg(
        F.max("last_verified_at").alias("verified_at"), F.lit(True).alias("is_stored")
    )
    fresh = F.coalesce(F.col("verified_at") > cutoff, F.lit(False))
    return rows.join(known, "detail_url", "left").select(
        *rows.columns,
        F.coalesce("is_stored", F.lit(False)).alias("touch"),
        F.when(fresh, "SKIP").otherwise("FETCH").alias("decision"),
    )


def expire_unseen(jobs: DataFrame, source: str | None, now: str, days: int, walk_complete: bool = True) -> DataFrame:
    """Live rows of a source unseen for ``days`` expire; nothing does after an incomplete walk."""
    if not walk_complete:
        return jobs
    at = F.lit(now).cast("timestamp_ntz")
    unseen = (F.col("status") == "ACTIVE") & (F.col("last_seen_at") < at - F.make_dt_interval(F.lit(days)))
    if source is not None:
        unseen = unseen & (F.col("source_key") == source)
    due = F.coalesce(unseen, F.lit(False))
    return (
        jobs.withColumn("is_due", due)
        .withColumn("status", F.when(F.col("is_due"), "EXPIRED").otherwise(F.col("status")))
        .withColumn("expired_at", F.when(F.col("is_due"), at).otherwise(F.col("expired_at")))
        .drop("is_due")
    )


def purge_source(jobs: DataFrame, source: str) -> DataFrame:
    return jobs.filter(F.col("source_key") != source)


def new_keys(incoming: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Rows of dimension keys not held yet, one per key."""
    fresh = one_per_key(incoming.filter(F.col(key) != ""), [key], [c for c in incoming.columns if c != key])
    return fresh.join(dimension.select(key), key, "left_anti")


def drift(stored: DataFrame, declared: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, problem) both ways between a stored table and a declared list."""
    merged = merge(stored.select(key, *columns), declared.select(key, *columns), [key], columns)
    both = F.col("action").isin(UPDATED, UNCHANGED)
    problems = F.array_compact(
        F.array(
            F.when(F.col("action") == CREATED, "missing from the table"),
            F.when(F.col("action") == KEPT, "missing from the declaration"),
            *[
                F.when(both & ~F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}")), f"{c} has drifted")
                for c in columns
            ],
        )
    )
    return merged.select(key, F.explode(problems).alias("problem"))


def sync_attachments(wanted: DataFrame, stored: DataFrame, keys: list[str], quoted: str) -> DataFrame:
    """Each attachment as ATTACH, REQUOTE, DETACH or SAME; links made by hand are not looked at."""
    automatic = stored.filter(F.col("method") == "DETERMINISTIC").select(*keys, quoted)
    merged = merge(automatic, wanted.select(*keys, quoted), keys, [quoted])
    names = {CREATED: "ATTACH", UPDATED: "REQUOTE", KEPT: "DETACH", UNCHANGED: "SAME"}
    table = F.create_map(*[F.lit(part) for pair in names.items() for part in pair])
    return merged.select(*keys, F.element_at(table, F.col("action")).alias("action"), F.coalesce(f"new.{quoted}", f"old.{quoted}").alias(quoted))


def key_differences(left: DataFrame, right: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(keys only on the left, keys only on the right)."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti"), b.join(a, key, "left_anti")


def redaction_sweep(jobs: DataFrame, column: str = "description", rules: tuple[Rule, ...] = CONTACT_RULES) -> DataFrame:
    """Stored text with contact details removed and how many were."""
    return (
        jobs.withColumn("redaction", redaction(F.col(column), rules))
        .withColumn(column, F.col("redaction.text"))
        .withColumn("removals", F.coalesce("redaction.removals", F.lit(0)))
        .drop("redaction")
    )


def redaction_outcome(swept: DataFrame) -> DataFrame:
    return swept.agg(
        F.count(F.lit(1)).alias("examined"),
        F.count_if(F.col("removals") > 0).alias("rewritten"),
        F.sum("removals").alias("removals"),
    )


def reclassified(jobs: DataFrame, found: Column) -> DataFrame:
    """Rows with their new signal and evidence and whether either differs from what is stored.

    No evidence is stored as null, so an empty list equals null and nothing else.
    """
    judged = jobs.withColumn("found", found)
    evidence = F.when(F.size("found.evidence") > 0, F.to_json("found.evidence"))
    return (
        judged.withColumn("new_signal", F.col("found.signal"))
        .withColumn("new_evidence", evidence)
        .drop("found")
        .withColumn(
            "differs",
            ~F.col("signal").eqNullSafe(F.col("new_signal")) | ~F.col("evidence").eqNullSafe(F.col("new_evidence")),
        )
    )


def distribution(df: DataFrame, column: str) -> DataFrame:
    """How many rows hold each value, most frequent first."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def quarantine(rejects: DataFrame, run_id: Column, source: Column) -> DataFrame:
    """Every rejected row as a quarantine record."""
    return rejects.select(run_id.alias("run_id"), source.alias("source_key"), "source_id", "kind", "message", "raw")


def quarantine_gate(runs: DataFrame, threshold: float) -> DataFrame:
    """Runs fail when too large a part of what they saw was quarantined. Judged before a snapshot is published."""
    rate = F.when(F.col("records_seen") > 0, F.col("records_quarantined") / F.col("records_seen")).otherwise(0.0)
    failed = rate > threshold
    return (
        runs.withColumn("quarantine_rate", rate)
        .withColumn("status", F.when(failed, "FAILED").otherwise(F.col("status")))
        .withColumn(
            "error",
            F.when(failed, F.format_string("quarantine rate %.1f%% exceeded %.1f%%", rate * 100, F.lit(threshold * 100))).otherwise(
                F.col("error")
            ),
        )
    )


def unseen_inputs(inputs: DataFrame, runs: DataFrame) -> DataFrame:
    """Inputs whose checksum no completed run of the same source and dataset has recorded."""
    done = runs.filter(F.col("status") == "COMPLETED").select("source_key", "dataset", "checksum")
    return inputs.join(done, ["source_key", "dataset", "checksum"], "left_anti")


def require_usable(registry: DataFrame, source: str) -> DataFrame:
    """One row naming the source; the job fails with the reason when it may not be ingested."""
    found = registry.filter(F.col("source_key") == source).agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.when((F.col("activation") == "ACTIVE") & (F.col("compliance_status") == "VERIFIED"), F.lit(1))).alias("usable"),
        F.max(F.concat_ws(" / ", "activation", "compliance_status")).alias("standing"),
    )
    checked = (
        F.when(F.col("n") == 0, F.raise_error(F.lit(f"no source registered as {source}")))
        .when(F.col("usable").isNull(), F.raise_error(F.concat(F.lit(f"{source} may not be ingested: "), "standing")))
        .otherwise(F.lit(source))
    )
    return found.select(checked.alias("source_key"))


def reap_abandoned(runs: DataFrame, now: str, after_hours: int = 2) -> DataFrame:
    """Runs still marked running after too long become failed, which frees their source."""
    at = F.lit(now).cast("timestamp_ntz")
    abandoned = (F.col("status") == "RUNNING") & (F.col("started_at") < at - F.make_dt_interval(hours=F.lit(after_hours)))
    return (
        runs.withColumn("reaped", abandoned)
        .withColumn("status", F.when(F.col("reaped"), "FAILED").otherwise(F.col("status")))
        .withColumn("finished_at", F.when(F.col("reaped"), at).otherwise(F.col("finished_at")))
        .withColumn("error", F.when(F.col("reaped"), "abandoned before it completed").otherwise(F.col("error")))
    )


def ledger_row(counts: DataFrame, source: str, dataset: str, status: str | Column, started: str, finished: str) -> DataFrame:
    """One run record from a one-row frame of counters."""
    stamp = lambda text: F.lit(text).cast("timestamp_ntz")
    return counts.select(
        F.lit(source).alias("source_key"),
        F.lit(dataset).alias("dataset"),
        F.lit(status).alias("status"),
        "records_seen",
        "records_written",
        "records_skipped",
        "records_quarantined",
        stamp(started).alias("started_at"),
        stamp(finished).alias("finished_at"),
    )


def unbalanced_runs(runs: DataFrame) -> DataFrame:
    """Runs whose written, skipped and quarantined records do not add up to what they saw."""
    accounted = F.col("records_written") + F.col("records_skipped") + F.col("records_quarantined")
    return runs.filter(accounted != F.col("records_seen")).withColumn("accounted", accounted)


def require_balanced(runs: DataFrame) -> DataFrame:
    """The runs, unless one of them does not add up."""
    accounted = F.col("records_written") + F.col("records_skipped") + F.col("records_quarantined")
    checked = F.when(
        accounted != F.col("records_seen"), F.raise_error(F.lit("a run's records do not add up to what it saw"))
    ).otherwise(F.col("records_seen"))
    return runs.withColumn("records_seen", checked)


def remap(df: DataFrame, column: str, mapping: dict[str, str]) -> DataFrame:
    """Rewrite stored codes; a code without a new one stays."""
    table = F.create_map(*[F.lit(part) for pair in mapping.items() for part in pair])
    return df.withColumn(column, F.coalesce(F.try_element_at(table, F.col(column)), F.col(column)))
