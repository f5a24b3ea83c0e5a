"""Streaming jobs: features, profiles, joiner, trainer, funnel metrics.

Each takes streaming DataFrames and returns one, or a function for
foreachBatch, so the caller chooses source, sink, trigger and checkpoint.
Event time is TIMESTAMP, which watermarks need.
"""

import bisect
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestream import schemas
from lodestream.functions import vectors as V
from lodestream.functions.clock import in_utc
from lodestream.operators import training as T
from lodestream.operators.actions import action_feature_vectors, training_examples
from lodestream.operators.online_metrics import funnel_counts, funnel_rates
from lodestream.operators.profiles import LEARNING_RATE, fold
from lodestream.operators.quality import example_error, quarantine
from lodestream.session import cut_lineage
from lodestream.sources import keyed_log, snapshots, topics
from lodestream.sources.bucketed import Table, store

# fixed values: trainer's flush time, rows per flush and seconds between snapshots
FLUSH = "30 seconds"
BATCH_ROWS = 1024
SNAPSHOT_SECONDS = 3600


def event_time(stream: DataFrame, ts: str = "ts", lateness: str = "1 hour") -> DataFrame:
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)


def deduplicated(actions: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Each action once within the watermark: by event id, or by its fields where the feed has none."""
    known = ["event_id"] if "event_id" in actions.columns else ["user_id", "item_id", "action_type", "ts"]
    return actions.dropDuplicatesWithinWatermark(keys or known)


def features(actions: DataFrame, dim: int, seed=0) -> DataFrame:
    """Feature records of an action stream; stateless."""
    keyed = actions
    key = "event_id"
    if key not in actions.columns:
        keyed = actions.withColumn(key, F.concat_ws("/", "user_id", "item_id", F.col("ts").cast("string")))
    return action_feature_vectors(keyed, dim, seed).select("id", "vector", "metadata")


PROFILES = "user_id {kind}, embedding array<double>, interaction_count bigint"


def profiles_at(root: str, kind: str, buckets: int | None = None):
    """The table of stored profiles under root."""
    return store(root, "user_id", PROFILES.format(kind=kind), buckets)


def profile_updates(
    root: str, items: DataFrame, learning_rate: float = LEARNING_RATE, tie: str = "event_id", compact_every: int = 64, buckets: int | None = None
):
    """foreachBatch function that folds a micro-batch's actions into the stored profiles under root.

    Profiles are kept in a keyed log, or with a number of buckets in a bucketed
    table, of which a batch opens its users' buckets only. For profiles that late
    rows enter at their place see ordered.profile_updates.

    The batch goes through the batch fold, from the profiles of its users after
    the batches before it, so a hot user is spread and a repeated batch gives the
    same rows. Rows of a batch are applied in time order, after all earlier
    batches: a row that arrives late is applied on arrival.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        table = profiles_at(root, batch.schema["user_id"].dataType.simpleString(), buckets)
        rows = in_utc(batch).persist()
        stored = table.read(spark, before=batch_id, only=rows.select("user_id"))
        moved = fold(rows, items, learning_rate, start=stored, tie=tie)
        counted = stored.select("user_id", F.col("interaction_count").alias("_before"))
        total = F.col("interaction_count") + F.coalesce("_before", F.lit(0))
        out = moved.join(counted, "user_id", "left").select("user_id", "embedding", total.alias("interaction_count"))
        table.write(out if buckets is None else cut_lineage(out), batch_id)
        rows.unpersist()
        if batch_id and batch_id % compact_every == 0:
            table.settle(spark, batch_id)

    return run


def joined_examples(actions: DataFrame, items: DataFrame, profiles: DataFrame, dim: int) -> DataFrame:
    """Training examples of an action stream against the stored profiles and items (stream-static joins)."""
    return training_examples(actions, items, profiles, dim)


def interval_join(
    actions: DataFrame, feature_rows: DataFrame, value: str, within_seconds: int = 86400, salts: int = 8, key: str = "event_id"
) -> DataFrame:
    """Each action with its user's latest feature in the interval before it, once the watermark has passed.

    Both inputs carry watermarks on ts. Features and waiting actions are keyed
    state: behind the watermark only a user's latest feature is kept, and every
    action looks its feature up once, so no pairs are formed. Of features at
    the same time the largest value counts; it is a number or a text. A hot user's actions are spread by
    giving each one of salts lanes, to which the features are copied.
    """
    # a filler instead of null keeps whole numbers whole in pandas
    no_key, no_value = F.lit("0").cast(actions.schema[key].dataType), F.lit("0").cast(feature_rows.schema[value].dataType)
    left = actions.select(
        "user_id", F.pmod(F.xxhash64(key), F.lit(salts)).alias("salt"), "ts", F.unix_micros("ts").alias("at"),
        F.lit(True).alias("asks"), F.col(key).alias("key"), no_value.alias("value"),
    )
    lanes = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))).alias("salt")
    right = feature_rows.filter(F.col(value).isNotNull()).select(
        "user_id", lanes, "ts", F.unix_micros("ts").alias("at"), F.lit(False).alias("asks"), no_key.alias("key"),
        F.col(value).alias("value"),
    )
    kinds = {"key": actions.schema[key].dataType.simpleString(), "value": feature_rows.schema[value].dataType.simpleString()}
    span = within_seconds * 1_000_000

    def advance(group, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        f_at, f_value, a_at, a_key = ([list(c) for c in state.get] if state.exists else [[], [], [], []])
        for frame in frames:
            is_action = frame["asks"].astype(bool)
            a_at += frame.loc[is_action, "at"].tolist()
            a_key += frame.loc[is_action, "key"].tolist()
            f_at += frame.loc[~is_action, "at"].tolist()
            f_value += frame.loc[~is_action, "value"].tolist()
        passed = state.getCurrentWatermarkMs() * 1000
        features = sorted(zip(f_at, f_value))
        times = [t for t, _ in features]
        out = {"user_id": [], "key": [], "at": [], "matched": [], "value": []}
        waiting = []
        for t, k in sorted(zip(a_at, a_key)):
            if t >= passed:
                waiting.append((t, k))
                continue
            found = bisect.bisect_right(times, t) - 1
            if found >= 0 and times[found] >= t - span:
                for name, v in zip(out, (group[0], k, t, *features[found])):
                    out[name].append(v)
        behind = bisect.bisect_left(times, passed)
        features = features[max(0, behind - 1) :]
        if features or waiting:
            state.update(tuple([x[n] for x in part] for part in (features, waiting) for n in (0, 1)))
            # wake up for the next waiting action, or to forget a feature out of reach
            wake = waiting[0][0] if waiting else features[-1][0] + span
            if not waiting and wake < passed:
                state.remove()
            else:
                state.setTimeoutTimestamp(max(wake, passed) // 1000 + 1)
        elif state.exists:
            state.remove()
        if out["key"]:
            yield pd.DataFrame(out)

    user_kind = actions.schema["user_id"].dataType.simpleString()
    found = left.unionByName(right).groupBy("user_id", "salt").applyInPandasWithState(
        advance,
        f"user_id {user_kind}, key {kinds['key']}, at bigint, matched bigint, value {kinds['value']}",
        f"f_at array<bigint>, f_value array<{kinds['value']}>, a_at array<bigint>, a_key array<{kinds['key']}>",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )
    return found.select(
        F.col("key").alias(key), "user_id", F.timestamp_micros("at").alias("ts"),
        F.timestamp_micros("matched").alias("matched_at"), F.col("value").alias(value),
    )


def windowed_funnel(actions: DataFrame, width: str = "1 day") -> DataFrame:
    """Funnel counts and rates by tumbling window; actions later than the watermark are left out."""
    return (
        actions.groupBy(F.window("ts", width).alias("w"))
        .agg(*funnel_counts())
        .select(F.col("w.start").alias("window_start"), "impressions", "clicks", "conversions", *funnel_rates())
    )


def factors_at(root: str, side: str, kind: str, buckets: int | None = None):
    """The table of stored factors of a side, user or item, under root."""
    return store(f"{root}/{side}", f"{side}_id", f"{side}_id {kind}, vector array<double>", buckets)


def _seen_before(spark, root, batch, batch_id, pairs, buckets):
    """Positive pairs that the batch's users have from earlier batches."""
    users = pairs.select("user_id").distinct()
    if buckets is not None:
        return _seen_table(root, batch, buckets).read(spark, before=batch_id, only=users)
    done = [n for n in keyed_log.finished(spark, f"{root}/archive", "batch") if int(n) < batch_id]
    if not done:
        return None
    past = spark.read.schema(batch.schema).parquet(*[f"{root}/archive/batch={n}" for n in done])
    return past.filter("label > 0").join(users, "user_id", "left_semi").select("user_id", "item_id")


def _seen_table(root, batch, buckets):
    kinds = ", ".join(f"{c} {batch.schema[c].dataType.simpleString()}" for c in ("user_id", "item_id"))
    return Table(f"{root}/seen", "user_id", ("user_id", "item_id"), kinds, buckets)


def training_batch(
    root: str,
    items: DataFrame,
    dim: int,
    lr: float = T.LEARNING_RATE,
    reg: float = T.REGULARIZATION,
    ratio: float = T.NEGATIVE_RATIO,
    snapshot_seconds: int = SNAPSHOT_SECONDS,
    key: str = "event_id",
    clock=time.time,
    buckets: int | None = None,
):
    """foreachBatch function: check, add negatives, one gradient step, write back, archive, snapshot.

    Factors live in keyed logs under root; a batch starts from those of its ids
    after the batches before it, so a repeated batch gives the same result.
    Negatives are items that the batch's users have neither in the archive nor
    in the batch. The trained factors are written back, not the input features.
    When the last snapshot is old enough the logs are compacted and a model
    version published. With a number of buckets, factors and the pairs that users
    have had are kept in bucketed tables instead, and a batch opens the buckets of
    its ids only: what it reads does not grow with the archive.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        fine, bad = quarantine(batch, example_error())
        archive = f"{root}/archive/batch={int(batch_id)}"
        pairs = fine.select("user_id", "item_id")
        past = _seen_before(spark, root, batch, batch_id, pairs, buckets)
        if past is not None:
            pairs = pairs.unionByName(past)
        T.with_negatives(fine, items, pairs, key=key, ratio=ratio).write.mode("overwrite").parquet(archive)
        bad.write.mode("overwrite").parquet(f"{root}/rejected/batch={int(batch_id)}")
        augmented = spark.read.schema(batch.schema).parquet(archive)
        sides = {}
        tables = {side: factors_at(root, side, batch.schema[f"{side}_id"].dataType.simpleString(), buckets) for side in ("user", "item")}
        for side, table in tables.items():
            ids = augmented.select(f"{side}_id").distinct()
            sides[side] = T.factors_or_init(ids, table.read(spark, before=batch_id, only=ids), f"{side}_id", dim)
        moved = T.sgd_step(augmented.select("user_id", "item_id", "label"), sides["user"], sides["item"], lr, reg)
        for table, rows in zip(tables.values(), moved):
            table.write(rows if buckets is None else cut_lineage(rows), batch_id)
        if buckets is not None:
            _seen_table(root, batch, buckets).write(augmented.filter("label > 0").select("user_id", "item_id").distinct(), batch_id)
        batch.unpersist()
        snapshot_if_due(spark, root, tables, dim, batch_id, snapshot_seconds, int(clock()))

    return run


def snapshot_if_due(spark, root, tables, dim, batch_id, every_seconds, now) -> None:
    models = f"{root}/models"
    last = snapshots.latest_version(spark, models)
    if last is not None and now - int(last[1:]) < every_seconds:
        return
    for table in tables.values():
        table.settle(spark, batch_id)
    name = snapshots.version_name(now)
    rows = [table.read(spark) for table in tables.values()]
    snapshots.write_version(snapshots.snapshot_rows(name, *rows, dim), models, name)


def start_joiner(actions: DataFrame, items: DataFrame, profiles: DataFrame, dim: int, target: str, checkpoint: str, format="parquet", **trigger):
    """Start the query that turns an action stream into records of the training topic."""
    examples = joined_examples(actions, items, profiles, dim)
    return topics.write_topic(topics.encode(examples, topics.TRAINING_TOPIC), topics.TRAINING_TOPIC, target, checkpoint, format, **trigger)


def start_trainer(
    spark, source: str, root: str, items: DataFrame, dim: int, checkpoint: str, format: str = "parquet", rows: int = BATCH_ROWS,
    id_type=None, trigger: dict | None = None, **how,
):
    """Start the query that trains on the training topic, batch by batch.

    A batch starts every FLUSH and takes at most rows records from a topic (from
    a folder of files, one file). Records that cannot be decoded are kept under
    root/dead. An example is known by a hash of its fields, as the wire carries
    no id; records that are alike in all of them are one example.
    """
    layout = schemas.training_example(*([id_type] if id_type else []))
    limit = {"maxOffsetsPerTrigger": rows} if format == "kafka" else {"maxFilesPerTrigger": 1}
    raw = topics.read_topic(spark, topics.TRAINING_TOPIC, source, format, **limit)
    train = training_batch(root, items, dim, **how)

    def run(batch: DataFrame, batch_id: int) -> None:
        good, bad = topics.decode(batch, layout)
        bad.write.mode("overwrite").parquet(f"{root}/dead/batch={int(batch_id)}")
        keyed = good.withColumn("event_id", F.xxhash64(*good.columns)).dropDuplicates(["event_id"])
        train(as_doubles(keyed), batch_id)

    writer = raw.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run)
    return writer.trigger(**(trigger or {"processingTime": FLUSH})).start()


def as_doubles(examples: DataFrame) -> DataFrame:
    """Decoded examples with the vectors and the label in DOUBLE, as the operators have them."""
    vectors = {c: V.as_double(c) for c in ("user_features", "item_features", "context_features")}
    return examples.withColumns({**vectors, "label": F.col("label").cast("double")})
