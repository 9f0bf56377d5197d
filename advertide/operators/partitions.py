"""Tables kept in partitions: listings by source, observations by period.

A merge reads the partitions its input names and replaces those that changed, by
dynamic partition overwrite; the others are neither read nor written. The new
rows are worked out and written to the shared folder before anything is
replaced, so a failed job leaves the table as it was, and one that fails while
replacing can be run again from its input.
"""

from __future__ import annotations

from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from advertide.operators import merge as M
from advertide.session import drop_folder, stage, subfolders

NULL_PARTITION = "__HIVE_DEFAULT_PARTITION__"


@dataclass(frozen=True)
class Facts:
    """A table at ``path``, one folder per value of the column ``by``; ``schema`` is that of the whole table."""

    path: str
    by: str
    schema: StructType

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.schema).parquet(self.path)

    def of(self, spark: SparkSession, values: list) -> DataFrame:
        """The rows of some partitions; a filter on the partition column, so no other folder is opened."""
        return self.read(spark).filter(F.col(self.by).isin(values))

    def folders(self, spark: SparkSession) -> dict[str, str]:
        """Folder of every partition by its value as text."""
        names = (n for n in subfolders(spark, self.path) if n.startswith(f"{self.by}="))
        return {unquote(n.removeprefix(f"{self.by}=")): f"{self.path}/{n}" for n in names}

    def replace(self, rows: DataFrame) -> None:
        """The partitions that ``rows`` hold become these rows. A large partition is written as several files."""
        whole = stage(rows.select(*self.schema.fieldNames()), f"facts-{self.by}")
        spread = whole.hint("rebalance", F.col(self.by))
        writer = spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(self.by).parquet(self.path)

    def drop(self, spark: SparkSession, values: list[str]) -> list[str]:
        """Remove whole partitions; returns the values that there were."""
        held = self.folders(spark)
        gone = [v for v in values if v in held]
        for value in gone:
            drop_folder(spark, held[value])
        return gone


def create(rows: DataFrame, path: str, by: str) -> Facts:
    """Write a table in partitions. The partition column comes last, as a reader sees it."""
    fields = [f for f in rows.schema.fields if f.name != by] + [rows.schema[by]]
    facts = Facts(path, by, StructType(fields))
    facts.replace(rows)
    return facts


def upsert_source(
    spark: SparkSession,
    listings: Facts,
    incoming: DataFrame,
    hashed: list[str],
    now: str,
    source: str,
    version: list[str] | None = None,
) -> DataFrame:
    """A feed of one source merged into its partition; returns what became of each of the source's listings.

    Rows of another source in the feed are an error of the caller and are left out.
    """
    own = incoming.filter(F.col("source_key") == source)
    merged = stage(M.upsert_listings(listings.of(spark, [source]), own, hashed, now, version), "upsert-source")
    carried = [c for c in listings.schema.fieldNames() if c not in merged.columns]
    if carried:
        raise ValueError(f"neither the table nor the feed has {carried}")
    listings.replace(merged)
    return merged


def expire_source(
    spark: SparkSession, listings: Facts, source: str, now: str, days: int, walk_complete: bool = True
) -> None:
    """Live rows of one source unseen for ``days`` expire in its partition; an incomplete walk touches nothing."""
    if walk_complete:
        listings.replace(M.expire_unseen(listings.of(spark, [source]), source, now, days))


def purge_source(spark: SparkSession, listings: Facts, source: str) -> bool:
    """Drop the partition of a source; no row is read."""
    return bool(listings.drop(spark, [source]))


def merge_periods(spark: SparkSession, observations: Facts, incoming: DataFrame) -> DataFrame:
    """Observations merged period by period; returns keys and actions of the periods that the input names.

    Only partitions with a created or updated observation are written. A period is a
    partition, so their list is as long as the calendar.
    """
    by = observations.by
    periods = [r[0] for r in incoming.select(by).distinct().collect()]
    keys, columns = ["series_key", by], ["value_state", "value"]
    rows = incoming.select(*keys, *columns)
    merged = M.merge(observations.of(spark, periods).select(*keys, *columns), rows, keys, columns)
    result = stage(M.latest_of(merged, keys, columns), "merge-periods")
    written = F.col("action").isin(*M.WRITTEN)
    changed = [r[0] for r in result.filter(written).select(by).distinct().collect()]
    if changed:
        observations.replace(result.filter(F.col(by).isin(changed)))
    return result.select(*keys, "action")


def prune_periods(spark: SparkSession, observations: Facts, count: int) -> list[str]:
    """Drop all but the ``count`` newest periods, by their folders alone; returns the dropped ones, oldest first."""
    held = sorted(v for v in observations.folders(spark) if v != NULL_PARTITION)
    return observations.drop(spark, held[: max(0, len(held) - count)])
