"""User actions: weights, context and feature vectors, joins to training rows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.functions import draws
from lodestream.functions.clock import in_utc
from lodestream.functions import vectors as V
from lodestream.schemas import ACTION_WEIGHTS, DIM
from lodestream.sources.topics import wire_time

CONTEXT_DIM = 10


def action_weight(action_type: Column) -> Column:
    """Weight of an action and label of a training example; null for an unknown variant."""
    out = None
    for name, weight in ACTION_WEIGHTS.items():
        out = (F if out is None else out).when(action_type == name, F.lit(weight))
    return out


def _clock(ts: Column) -> tuple[Column, Column]:
    return F.hour(ts) / F.lit(24.0), F.weekday(ts) / F.lit(7.0)


def context_features(action_type: Column, ts: Column) -> Column:
    """[hour / 24, weekday (Monday = 0) / 7, action weight, zeros up to ten]."""
    hour, weekday = _clock(ts)
    rest = [F.lit(0.0)] * (CONTEXT_DIM - 3)
    return F.array(hour, weekday, action_weight(action_type), *rest)


def action_features(action_type: Column, ts: Column, noise_key: Column, dim: int = DIM, seed=0) -> Column:
    """One-hot action variant, time of day and week, then noise in [-1, 1).

    The noise is drawn from noise_key rather than from a process-wide
    generator, so a replayed action yields the same vector.
    """
    one_hot = [F.when(action_type == name, F.lit(1.0)).otherwise(F.lit(0.0)) for name in ACTION_WEIGHTS]
    hour, weekday = _clock(ts)
    noise = F.slice(draws.uniforms(noise_key, dim, seed, -1.0, 1.0), 9, dim - 8)
    return F.concat(F.array(*one_hot, hour, weekday), noise)


def action_feature_vectors(actions: DataFrame, dim: int = DIM, seed=0, noise_key: str = "event_id") -> DataFrame:
    """Feature records (id = user, vector, metadata JSON) of actions; other columns are kept."""
    actions = in_utc(actions)
    metadata = F.to_json(F.struct("action_type", wire_time("ts").alias("timestamp"), "item_id"))
    return actions.select(
        "*",
        F.col("user_id").alias("id"),
        action_features(F.col("action_type"), F.col("ts"), F.col(noise_key), dim, seed).alias("vector"),
        metadata.alias("metadata"),
    )


def with_items(actions: DataFrame, items: DataFrame) -> DataFrame:
    """Actions with the row of their item; an action on an unknown item is ignored.

    A plain equi-join: a small item table is broadcast by size, a large one is
    shuffled and a hot item is split by the adaptive skew join.
    """
    return actions.join(items, "item_id")


def training_examples(actions: DataFrame, items: DataFrame, profiles: DataFrame, dim: int = DIM) -> DataFrame:
    """Action left-joined to the stored profile (zeros if none) and joined to its item.

    Narrow action rows are joined first; the vectors ride along only in the
    final projection. Columns of actions other than the record's are kept.
    """
    stored = profiles.select("user_id", F.col("embedding").alias("user_features"))
    features = items.select("item_id", F.col("embedding").alias("item_features"))
    joined = in_utc(actions).join(features, "item_id").join(stored, "user_id", "left")
    return joined.select(
        *[F.col(c) for c in actions.columns if c != "context"],
        action_weight(F.col("action_type")).alias("label"),
        F.coalesce(V.as_double("user_features"), V.zeros(dim)).alias("user_features"),
        V.as_double("item_features").alias("item_features"),
        context_features(F.col("action_type"), F.col("ts")).alias("context_features"),
    )


def post_update_examples(history: DataFrame, items: DataFrame) -> DataFrame:
    """Training examples whose user features are the profile right after the action.

    history is the output of profiles.history: one row per applied action with
    its label and the updated embedding. Where it has brought item_features along,
    its rows, which carry vectors, are not joined to the items again.
    """
    updated = in_utc(history).withColumnRenamed("embedding", "user_features")
    if "item_features" not in history.columns:
        updated = updated.join(items.select("item_id", V.as_double("embedding").alias("item_features")), "item_id")
    return updated.withColumn("context_features", context_features(F.col("action_type"), F.col("ts")))
