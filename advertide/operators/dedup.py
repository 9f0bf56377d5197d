"""Grouping the same advertisement across sources.

Two rounds, by address first and by company, title and place second; a row
claimed by a kept group of the first round takes no part in the second. Groups
are found by partial aggregation (row count, least and greatest source, best
member), never by listing or pairing members, so a signature that holds a third
of all rows costs its reducers one row per map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from advertide.functions.text import dash_key, empty_to_null, url_key, word_key
from advertide.session import stage

BY_URL, BY_IDENTITY = "CANONICAL_URL", "IDENTITY_TRIPLE"


def url_signature(apply_url: Column, source_url: Column) -> Column:
    return F.concat(F.lit("url:"), F.coalesce(url_key(apply_url), url_key(source_url)))


def identity_signature(company: Column, title: Column, location: Column) -> Column:
    """Digest of the three keys, null unless all three say something."""
    parts = [empty_to_null(word_key(company)), empty_to_null(word_key(title)), empty_to_null(dash_key(location))]
    present = parts[0].isNotNull() & parts[1].isNotNull() & parts[2].isNotNull()
    digest = F.substring(F.sha2(F.to_json(F.array(*parts)), 256), 1, 32)
    return F.when(present, F.concat(F.lit("cta:"), digest))


def with_signatures(jobs: DataFrame) -> DataFrame:
    """Thin candidate rows: no text travels past this point."""
    described = F.coalesce(F.trim("description") != "", F.lit(False))
    return jobs.select(
        "id",
        "source_key",
        url_signature(F.col("apply_url"), F.col("source_url")).alias("url_sig"),
        identity_signature(F.col("company_name"), F.col("title"), F.col("location_text")).alias("identity_sig"),
        # The least struct is the row a group is shown by.
        F.struct(
            (~described).alias("undescribed"),
            F.col("posted_at").isNull().alias("undated"),
            F.col("posted_at").alias("posted_at"),
            F.col("source_key").alias("source_key"),
            F.col("id").alias("id"),
        ).alias("preference"),
    )


def _groups(candidates: DataFrame, signature: str, prefix: str) -> DataFrame:
    """Signatures shared by at least two rows of at least two sources, with the member each is shown by."""
    return (
        candidates.filter(F.col(signature).isNotNull())
        .groupBy(F.col(signature).alias(f"{prefix}_key"))
        .agg(
            F.count(F.lit(1)).alias(f"{prefix}_members"),
            F.min("source_key").alias("first_source"),
            F.max("source_key").alias("last_source"),
            F.min("preference")["id"].alias(f"{prefix}_canonical"),
        )
        .filter((F.col(f"{prefix}_members") >= 2) & (F.col("first_source") != F.col("last_source")))
        .drop("first_source", "last_source")
    )


def _join_key(signature: str, claimed: Column | None = None) -> Column:
    """Rows that cannot match get a key of their own, so they spread instead of meeting on null."""
    usable = F.col(signature) if claimed is None else F.when(~claimed, F.col(signature))
    return F.coalesce(usable, F.concat(F.lit("none:"), F.col("id")))


def duplicate_members(jobs: DataFrame) -> DataFrame:
    """(id, source_key, signature, confidence, canonical_id, members, is_canonical) of every grouped row."""
    # Three passes look at the signatures, one pass at the texts they come from.
    candidates = stage(with_signatures(jobs), "signatures")
    first = candidates.withColumn("u_key", _join_key("url_sig")).join(_groups(candidates, "url_sig", "u"), "u_key", "left")
    claimed = F.col("u_canonical").isNotNull()
    rest = first.filter(~claimed)
    second = first.withColumn("i_key", _join_key("identity_sig", claimed)).join(
        _groups(rest, "identity_sig", "i"), "i_key", "left"
    )
    canonical = F.coalesce("u_canonical", "i_canonical")
    return second.filter(canonical.isNotNull()).select(
        "id",
        "source_key",
        F.when(claimed, F.col("url_sig")).otherwise(F.col("identity_sig")).alias("signature"),
        F.when(claimed, BY_URL).otherwise(BY_IDENTITY).alias("confidence"),
        canonical.alias("canonical_id"),
        F.coalesce("u_members", "i_members").alias("members"),
        (F.col("id") == canonical).alias("is_canonical"),
    )


def duplicate_groups(members: DataFrame) -> DataFrame:
    """One row per group."""
    return members.filter("is_canonical").select("signature", "confidence", "canonical_id", "members")


def write_back(jobs: DataFrame, members: DataFrame) -> DataFrame:
    """Stored rows with group and canonical flag renewed; live rows that left their group stand alone again."""
    found = members.select(
        "id", F.col("signature").alias("new_group"), F.col("is_canonical").alias("new_canonical")
    )
    live = F.col("status") == "ACTIVE"
    grouped = F.col("new_group").isNotNull()
    stale = live & ~grouped & F.col("duplicate_group").isNotNull()
    action = F.when(grouped, "GROUPED").when(stale, "UNGROUPED").otherwise("LEFT")
    return jobs.join(found, "id", "left").select(
        "id",
        action.alias("action"),
        F.when(grouped, F.col("new_group")).when(~stale, F.col("duplicate_group")).alias("duplicate_group"),
        F.when(grouped, F.col("new_canonical")).when(stale, F.lit(True)).otherwise(F.col("is_canonical")).alias("is_canonical"),
    )


def emptied_groups(stored_groups: DataFrame, written: DataFrame) -> DataFrame:
    """Groups no stored row belongs to any more."""
    held = written.select(F.col("duplicate_group").alias("signature")).distinct()
    return stored_groups.join(held, "signature", "left_anti")


def shared_addresses(jobs: DataFrame) -> DataFrame:
    """Live canonical rows that share an application address, with how many are one too many."""
    return (
        jobs.filter((F.col("status") == "ACTIVE") & F.col("is_canonical") & F.col("apply_url").isNotNull())
        .groupBy("apply_url")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > 1)
        .withColumn("excess", F.col("n") - 1)
    )
