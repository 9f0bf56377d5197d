"""Small registries kept as JSON or tables: areas, features, region verdicts, allocations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from advertide.operators.places import LEVELS

AREA_SCHEMA = "code string, name string, level string, parentCode string, hasGeometry boolean, areaSqKm double"
FEATURE_SCHEMA = (
    "type string, geometry struct<type:string>, properties map<string,string>"
)
VERDICT_SCHEMA = (
    "instrument struct<id:string,registerId:string>,"
    "areas array<struct<code:string,name:string,stateCode:string,status:string,distinctPostcodes:int>>"
)
# Verdicts an area may carry.
VERDICTS = ("REGIONAL", "NOT_REGIONAL", "MIXED", "UNKNOWN")


def read_area_registry(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of areas, one row each, checked row by row."""
    return checked_areas(spark.read.schema(AREA_SCHEMA + ", _corrupt_record string").option("multiLine", True).json(path))


def parse_areas(lines: DataFrame, column: str = "value") -> DataFrame:
    """Areas given as one JSON object per row."""
    parsed = F.from_json(column, AREA_SCHEMA + ", _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"})
    return checked_areas(lines.select(parsed.alias("a")).select("a.*"))


def checked_areas(areas: DataFrame) -> DataFrame:
    """Areas with the list of what is wrong with each."""
    faults = F.array_compact(
        F.array(
            F.when(F.col("_corrupt_record").isNotNull(), "unreadable"),
            F.when(F.coalesce("code", F.lit("")) == "", "code"),
            F.when(F.coalesce("name", F.lit("")) == "", "name"),
            F.when(~F.coalesce(F.col("level").isin(*LEVELS), F.lit(False)), "level"),
            F.when(F.col("parentCode") == "", "parentCode"),
            F.when(F.col("hasGeometry").isNull(), "hasGeometry"),
            F.when(F.col("areaSqKm") < 0, "areaSqKm"),
        )
    )
    return areas.select(
        "code", "name", "level", F.col("parentCode").alias("parent_code"), F.col("hasGeometry").alias("has_geometry"),
        F.col("areaSqKm").alias("area_sq_km"), faults.alias("faults"),
    )


def require_valid(checked: DataFrame) -> DataFrame:
    """The rows without their fault lists; the job fails on the first row that has one."""
    message = F.concat(F.lit("area "), F.coalesce("code", F.lit("?")), F.lit(" failed: "), F.array_join("faults", ", "))
    code = F.when(F.size("faults") > 0, F.raise_error(message)).otherwise(F.col("code"))
    return checked.withColumn("code", code).drop("faults")


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """A feature collection as one row per feature."""
    collection = spark.read.schema(f"features array<struct<{FEATURE_SCHEMA.replace('type string', 'type:string', 1).replace('geometry struct', 'geometry:struct').replace('properties map', 'properties:map')}>>")
    return collection.option("multiLine", True).json(path).select(F.explode("features").alias("f")).select("f.*")


def parse_features(lines: DataFrame, column: str = "value") -> DataFrame:
    return lines.select(F.from_json(column, FEATURE_SCHEMA).alias("f")).select("f.*")


def feature_areas(
    features: DataFrame, level: str, code: str, name: str, parent: str | None, area: str, change: str
) -> DataFrame:
    """Registry rows of a layer's features: codes and names trimmed, blanks null, area only where it is a number."""

    def trimmed(field: str) -> Column:
        return F.nullif(F.trim(F.try_element_at("properties", F.lit(field))), F.lit(""))

    parent_code = F.lit(None).cast("string") if parent is None else trimmed(parent)
    missing = F.raise_error(F.lit(f"a {level} record is missing code or name"))
    return features.select(
        F.when(trimmed(code).isNull() | trimmed(name).isNull(), missing).otherwise(trimmed(code)).alias("code"),
        trimmed(name).alias("name"),
        F.lit(level).alias("level"),
        parent_code.alias("parent_code"),
        F.col("geometry").isNotNull().alias("has_geometry"),
        trimmed(area).try_cast("double").alias("area_sq_km"),
        trimmed(change).alias("change_label"),
    )


def read_verdicts(spark: SparkSession, path: str) -> DataFrame:
    return verdict_areas(spark.read.schema(VERDICT_SCHEMA).option("multiLine", True).json(path))


def parse_verdicts(documents: DataFrame, column: str = "value") -> DataFrame:
    return verdict_areas(documents.select(F.from_json(column, VERDICT_SCHEMA).alias("d")).select("d.*"))


def verdict_areas(documents: DataFrame) -> DataFrame:
    """Area verdicts of a stored artefact; an unknown verdict or a missing code fails the job."""
    areas = documents.select(F.col("instrument.id").alias("instrument"), F.explode("areas").alias("a")).select("instrument", "a.*")
    sound = (
        (F.coalesce("code", F.lit("")) != "")
        & (F.coalesce("name", F.lit("")) != "")
        & F.coalesce(F.col("status").isin(*VERDICTS), F.lit(False))
        & (F.coalesce("distinctPostcodes", F.lit(-1)) >= 0)
    )
    code = F.when(sound, F.col("code")).otherwise(F.raise_error(F.concat(F.lit("verdict failed its check: "), F.to_json(F.struct("*")))))
    return areas.select(
        "instrument", code.alias("code"), "name", F.col("stateCode").alias("state_code"), "status",
        F.col("distinctPostcodes").cast("bigint").alias("distinct_postcodes"),
    )


def required_columns(df: DataFrame, required: dict[str, str]) -> DataFrame:
    """The columns a job needs under the names it uses; says which columns were found when one is missing."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns {missing}; found {df.columns}")
    return df.select(*[F.trim(F.col(source).cast("string")).alias(name) for source, name in required.items()])


def read_allocation(spark: SparkSession, path: str, required: dict[str, str]) -> DataFrame:
    """An allocation table kept as CSV with a header, all columns text, blank keys left out."""
    table = required_columns(spark.read.option("header", True).csv(path), required)
    first, *_ = required.values()
    return table.filter(F.col(first) != "")
