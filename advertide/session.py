"""Session set-up shared by the bench, the tests and jobs run by hand."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# AQE splits skewed join partitions and coalesces small ones, so a hot key does
# not need a hand-made salt in ordinary equi joins.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(name: str, cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def _shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints; a local one only on a single machine that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is not None:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="run-", dir="/tmp"))
    return spark.sparkContext.getCheckpointDir()


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder for a stream's output and progress, next to the checkpoints."""
    return f"{_shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Work a frame out once: written as a table in the shared folder and read from there.

    Later readers get pruned columns and true sizes, and a lost executor costs
    nothing that was worked out before.
    """
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str, width: int | None = None) -> DataFrame:
    """Rows dealt by key over ``width`` tasks (the shuffle width where none is told), for work that is heavy in each row.

    A text table may come in fewer splits than there are cores: a file of one row group is
    one task however long it is. Moving the texts once costs far less than reading them for patterns.
    """
    return df.repartition(width or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def folder_exists(spark: SparkSession, path: str) -> bool:
    files, at = _file_system(spark, path)
    return files.exists(at)


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder; none where it does not exist."""
    files, at = _file_system(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(at) if s.isDirectory()) if files.exists(at) else []


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder of a table this library keeps; one that is gone already is no fault."""
    files, at = _file_system(spark, path)
    files.delete(at, True)
