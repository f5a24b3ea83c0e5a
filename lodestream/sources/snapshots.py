"""Versioned tables and model snapshots in parquet.

A version is written to its own folder and never changed, so nothing is
overwritten while it is read and a repeated write of a version is detected.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.functions import vectors as V
from lodestream.sources.keyed_log import exists, finished


def version_name(unix_seconds: int) -> str:
    return f"v{int(unix_seconds)}"


def snapshot_rows(version: str, users: DataFrame, items: DataFrame, dim: int) -> DataFrame:
    """(version, side, id, vector): both factor tables with their ids, and a zero bias row."""
    spark = users.sparkSession
    parts = [
        users.select(F.lit("user").alias("side"), F.col("user_id").cast("string").alias("id"), V.as_double("vector").alias("vector")),
        items.select(F.lit("item").alias("side"), F.col("item_id").cast("string").alias("id"), V.as_double("vector").alias("vector")),
        spark.range(1).select(F.lit("bias").alias("side"), F.lit("").alias("id"), V.zeros(dim).alias("vector")),
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.select(F.lit(version).alias("version"), "side", "id", "vector")


ROWS = "side string, id string, vector array<double>"


def write_version(rows: DataFrame, root: str, version: str) -> None:
    """Publish rows as a version; a published one is left as it is and raises, a half-written one is replaced."""
    spark = rows.sparkSession
    path = f"{root.rstrip('/')}/version={version}"
    if exists(spark, f"{path}/_SUCCESS"):
        raise ValueError(f"version {version} already exists")
    rows.drop("version").write.mode("overwrite").parquet(path)


def versions(spark: SparkSession, root: str) -> list[str]:
    """Published versions, by their number."""
    return sorted(finished(spark, root.rstrip("/"), "version"), key=lambda v: int(v[1:]))


def load_version(spark: SparkSession, root: str, version: str) -> DataFrame:
    rows = spark.read.schema(ROWS).parquet(f"{root.rstrip('/')}/version={version}")
    return rows.withColumn("version", F.lit(version))


def latest_version(spark: SparkSession, root: str) -> str | None:
    """Newest published version by its number, or None."""
    found = versions(spark, root)
    return found[-1] if found else None


def load_latest(spark: SparkSession, root: str) -> DataFrame:
    return load_version(spark, root, latest_version(spark, root))
