"""Streams whose results do not depend on the order of arrival: profiles, sessions, trends."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestream.functions import vectors as V
from lodestream.functions.clock import in_utc, time_slice
from lodestream.operators import trends
from lodestream.operators.profiles import LEARNING_RATE, applied, fold
from lodestream.session import cut_lineage, drop_step
from lodestream.sources.bucketed import Table, store

PROFILE = "user_id {kind}, embedding array<double>, interaction_count bigint, last_updated timestamp_ntz"
SEGMENT = "user_id {kind}, slice bigint, n bigint, x array<double>, latest timestamp_ntz"
OPEN = "user_id {kind}, {tie} {tie_kind}, item_id {item}, action_type string, ts timestamp_ntz, slice bigint"


def segments(actions: DataFrame, items: DataFrame, learning_rate: float = LEARNING_RATE, tie: str = "event_id") -> DataFrame:
    """(user_id, slice, n, x, latest): each slice's actions folded by themselves, from zero; actions carry their slice."""
    each = actions.withColumn("user_id", F.struct("user_id", "slice"))
    found = fold(each, items, learning_rate, tie=tie)
    return found.select(
        "user_id.user_id", "user_id.slice", F.col("interaction_count").alias("n"), F.col("embedding").alias("x"), F.col("last_updated").alias("latest")
    )


def profiles_of(parts: DataFrame, learning_rate: float = LEARNING_RATE) -> DataFrame:
    """(user_id, embedding, interaction_count, last_updated) from a user's segments, in order of slice.

    A segment fades once for each action of the segments after it.
    """
    later = Window.partitionBy("user_id").orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, -1)
    aged = parts.withColumn("_after", F.coalesce(F.sum("n").over(later), F.lit(0)))
    return aged.groupBy("user_id").agg(
        V.vector_sum("x", F.pow(F.lit(1.0 - learning_rate), F.col("_after"))).alias("embedding"),
        F.sum("n").alias("interaction_count"),
        F.max("latest").alias("last_updated"),
    )


def state_of(root: str, kind: str, buckets: int, tie: str = "event_id", tie_kind: str = "bigint", item: str = "bigint"):
    """The three tables under root: open actions, segments, profiles."""
    shapes = {"open": OPEN, "segments": SEGMENT, "profiles": PROFILE}
    keys = {"open": ("user_id", tie), "segments": ("user_id", "slice"), "profiles": ("user_id",)}
    return [
        Table(f"{root}/{n}", "user_id", keys[n], s.format(kind=kind, tie=tie, tie_kind=tie_kind, item=item), buckets)
        for n, s in shapes.items()
    ]


def profile_updates(
    root: str,
    items: DataFrame,
    learning_rate: float = LEARNING_RATE,
    tie: str = "event_id",
    slice_seconds: int = 3600,
    keep_slices: int = 24,
    buckets: int = 64,
):
    """foreachBatch function that keeps profiles as the batch fold has them, whatever the order of arrival.

    A user's actions are folded by slices of time, the segments merged into the
    profile. A late action changes its slice's segment, which is folded again from
    the slice's actions; these are kept for keep_slices slices before the user's
    newest. An action older than that goes to root/late and changes nothing.
    Actions are known by the column tie: repeated ones count once. A batch opens
    the buckets of its users only, and repeating it gives the same rows.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        kinds = {c: batch.schema[c].dataType.simpleString() for c in ("user_id", tie, "item_id")}
        held, parts, folded = state_of(root, kinds["user_id"], buckets, tie, kinds[tie], kinds["item_id"])
        names = ["user_id", tie, "item_id", "action_type", "ts", "slice"]
        rows = applied(in_utc(batch), items).withColumn("slice", time_slice("ts", slice_seconds)).select(*names)
        rows = cut_lineage(rows.dropDuplicates(["user_id", tie]))
        known = cut_lineage(parts.read(spark, before=batch_id, only=rows))
        newest = known.groupBy("user_id").agg(F.max("slice").alias("_newest"))
        dated = rows.join(newest, "user_id", "left")
        is_late = F.coalesce(F.col("slice") < F.col("_newest") - keep_slices, F.lit(False))
        dated.filter(is_late).select(*names).write.mode("overwrite").parquet(f"{root}/late/batch={int(batch_id)}")
        before = cut_lineage(held.read(spark, before=batch_id, only=rows))
        timely = cut_lineage(dated.filter(~is_late).select(*names).join(before.select("user_id", tie), ["user_id", tie], "left_anti"))
        touched = timely.select("user_id", "slice").distinct()
        again = before.join(touched, ["user_id", "slice"], "left_semi").select(*names).unionByName(timely)
        changed = cut_lineage(segments(again, items, learning_rate, tie))
        whole = known.join(touched, ["user_id", "slice"], "left_anti").unionByName(changed)
        moved = profiles_of(whole.join(timely.select("user_id").distinct(), "user_id", "left_semi"), learning_rate)

        def recent(content):
            last = F.max("slice").over(Window.partitionBy("user_id"))
            return content.withColumn("_last", last).filter(F.col("slice") >= F.col("_last") - keep_slices).drop("_last")

        held.write(timely, batch_id, prune=recent)
        parts.write(changed, batch_id)
        folded.write(cut_lineage(moved), batch_id)
        drop_step(rows, known, before, timely, changed)

    return run


def sessions(actions: DataFrame, key: str = "user_id", ts: str = "ts", gap_minutes: int = 30) -> DataFrame:
    """(key, started, ended, n_events, duration_seconds, bounced): sessions split at gaps longer than the limit.

    As ordering.sessions, for a stream with a watermark on ts, where a session is
    let out once the watermark has passed its gap; or for a table. Spark's session
    windows hold one row of state for each open session, not its events; windows that
    touch are merged, so a gap of exactly the limit does not split.
    """
    window = F.session_window(ts, f"{gap_minutes} minutes").alias("_w")
    found = actions.groupBy(key, window).agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count("*").alias("n_events"))
    seconds = (F.unix_micros(F.col("ended").cast("timestamp")) - F.unix_micros(F.col("started").cast("timestamp"))) / F.lit(1e6)
    return found.select(key, "started", "ended", "n_events", seconds.alias("duration_seconds"), (F.col("n_events") == 1).alias("bounced"))


def heat_updates(root: str, rate: float = trends.RATE, buckets: int | None = None):
    """foreachBatch function that adds a batch's actions to the kept heats of their items.

    Arrival in any order gives the same sums, but for rounding. Heats are as of the
    batch's newest second: one number to the driver.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = in_utc(batch)
        newest = rows.agg(F.max(trends.second_of("ts"))).first()[0]
        if newest is None:
            return
        table = heats_at(root, batch.schema["item_id"].dataType.simpleString(), buckets)
        new = cut_lineage(trends.heat(rows, newest, rate))
        old = table.read(spark, before=batch_id, only=new)
        table.write(cut_lineage(trends.merged(old.unionByName(new), newest, rate)), batch_id)
        drop_step(new)

    return run


def heats_at(root: str, kind: str, buckets: int | None = None):
    """The table of kept heats under root."""
    return store(root, "item_id", trends.SCHEMA.format(kind=kind), buckets)
