"""Keyed tables (profiles, items): upsert, vector update, removal, lookup.

All return the new content; publish it with sources.snapshots, never over the
files being read.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.functions import vectors as V


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Last row per key; a max aggregate, so a hot key is combined map-side."""
    rest = [c for c in rows.columns if c != key]
    newest = F.max_by(F.struct(*rest), F.struct(*order))
    return rows.groupBy(key).agg(newest.alias("_row")).select(key, "_row.*").select(rows.columns)


def dimension_error(vector, dim: int):
    """Error text when the vector's size is not dim, else null; a null vector has size 0."""
    size = F.coalesce(F.size(vector), F.lit(0))
    text = F.format_string(f"Embedding dimension mismatch: expected {dim}, got %d", size)
    return F.when(size != dim, text)


def upsert(old: DataFrame, new: DataFrame, key: str, order: list[str], dim: int, vector: str = "embedding") -> DataFrame:
    """old with new rows inserted or replacing; of duplicate keys the last in order wins.

    A row whose vector has another dimension fails the job.
    """
    error = dimension_error(vector, dim)
    checked = new.withColumn(vector, F.when(error.isNull(), F.col(vector)).otherwise(F.raise_error(error)))
    rest = [c for c in old.columns if c != key]
    newest = latest(checked, key, order).select(key, F.struct(*rest).alias("_new"))
    both = old.select(key, F.struct(*rest).alias("_old")).join(newest, key, "full")
    # keys of old are unique; a null key matches none
    return both.select(key, F.coalesce("_new", "_old").alias("_row")).select(key, "_row.*").select(old.columns)


def update_vectors(table: DataFrame, new: DataFrame, key: str, vector: str = "embedding", touched=None) -> DataFrame:
    """table with vectors replaced where new has the key; keys only in new add no row.

    touched = (column, value) is set on replaced rows, such as a last-updated time.
    """
    fresh = new.select(key, F.col(vector).alias("_new"))
    joined = table.join(fresh, key, "left")
    hit = F.col("_new").isNotNull()
    out = joined.withColumn(vector, F.coalesce(F.col("_new").cast(table.schema[vector].dataType), F.col(vector)))
    if touched is not None:
        column, value = touched
        out = out.withColumn(column, F.when(hit, value).otherwise(F.col(column)))
    return out.select(table.columns)


def remove(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """table without the given ids; an absent id changes nothing."""
    return table.join(ids.select(key), key, "left_anti")


def lookup(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of the asked ids; an absent id gives no row."""
    return table.join(ids.select(key).distinct(), key)


def new_profiles(users: DataFrame, dim: int, as_of) -> DataFrame:
    """Fresh profiles: zero vector, no preferences, no interactions."""
    return users.select(
        "user_id",
        V.zeros(dim).alias("embedding"),
        F.array().cast("array<string>").alias("preferences"),
        as_of.alias("last_updated"),
        F.lit(0).cast("long").alias("interaction_count"),
    )


def new_items(rows: DataFrame, as_of) -> DataFrame:
    """Item features with their defaults: no tags, popularity 0."""
    tags = F.col("tags") if "tags" in rows.columns else F.lit(None)
    popularity = F.col("popularity_score") if "popularity_score" in rows.columns else F.lit(None)
    return rows.select(
        "item_id",
        "embedding",
        "category",
        F.coalesce(tags.cast("array<string>"), F.array().cast("array<string>")).alias("tags"),
        F.coalesce(popularity.cast("double"), F.lit(0.0)).alias("popularity_score"),
        as_of.alias("created_at"),
    )
