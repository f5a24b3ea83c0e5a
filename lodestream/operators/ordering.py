"""Ordering within a key that may hold a large share of all rows."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestream.functions.clock import MICROS, epoch_micros, time_slice


def numbered(
    df: DataFrame, key: str, order: list[str], slice_seconds: int = 60, name: str = "seq", from_last: bool = False
) -> DataFrame:
    """1-based position of each row within its key, by the order columns, counted from the first or the last.

    The first order column is a timestamp. Rows are numbered inside (key, time
    slice); the number of rows in the slices before (or after), found from one
    small row per slice, is added. A hot key is thus spread over its slices.
    """
    way = (lambda c: F.col(c).desc()) if from_last else F.col
    sliced = df.withColumn("_slice", time_slice(order[0], slice_seconds))
    inside = Window.partitionBy(key, "_slice").orderBy(*[way(c) for c in order])
    earlier = Window.partitionBy(key).orderBy(way("_slice")).rowsBetween(Window.unboundedPreceding, -1)
    before = (
        sliced.groupBy(key, "_slice")
        .agg(F.count("*").alias("_n"))
        .select(key, "_slice", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    )
    return (
        sliced.withColumn("_inside", F.row_number().over(inside))
        .join(before, [key, "_slice"])
        .withColumn(name, F.col("_before") + F.col("_inside"))
        .drop("_slice", "_before", "_inside")
    )


def ranks_below(asked: DataFrame, marks: DataFrame, key: str, at: str, name: str, width: int = 4096) -> DataFrame:
    """asked (key, at, ...) with the number of the key's marks (key, at) at or below each position.

    Positions are whole numbers. Counts run inside slices of width positions;
    the marks of lower slices are added from one small row per slice.
    """
    blank = [F.lit(None).cast(asked.schema[c].dataType).alias(c) for c in asked.columns if c not in (key, at)]
    left = asked.withColumn("_mark", F.lit(0))
    both = left.unionByName(marks.select(key, at, *blank, F.lit(1).alias("_mark")))
    sliced = both.withColumn("_slice", F.floor(F.col(at) / F.lit(width)))
    inside = Window.partitionBy(key, "_slice").orderBy(at, F.desc("_mark"))
    lower = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        sliced.groupBy(key, "_slice")
        .agg(F.sum("_mark").alias("_n"))
        .select(key, "_slice", F.coalesce(F.sum("_n").over(lower), F.lit(0)).alias("_before"))
    )
    running = F.sum("_mark").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        sliced.withColumn("_in", running)
        .filter("_mark = 0")
        .join(before, [key, "_slice"])
        .withColumn(name, F.col("_in") + F.col("_before"))
        .select(*asked.columns, name)
    )


def dense_ids(ids: DataFrame, key: str, name: str = "idx", seed=0, digits: int = 3) -> DataFrame:
    """(key, name): distinct ids numbered from 0 without gaps, in the order of their md5 with the seed.

    Ids are numbered inside slices by the hash's first hex digits; the counts of
    the slices, 16^digits rows, give the offsets.
    """
    hashed = ids.select(key).filter(F.col(key).isNotNull()).distinct()
    tagged = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(f"dense{seed}")))
    sliced = hashed.withColumn("_hash", tagged).withColumn("_slice", F.substring("_hash", 1, digits))
    lower = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        sliced.groupBy("_slice")
        .agg(F.count("*").alias("_n"))
        .select("_slice", F.coalesce(F.sum("_n").over(lower), F.lit(0)).alias("_before"))
    )
    inside = F.row_number().over(Window.partitionBy("_slice").orderBy("_hash", key)) - 1
    return sliced.withColumn("_in", inside).join(before, "_slice").select(key, (F.col("_in") + F.col("_before")).alias(name))


def sessions(events: DataFrame, key: str = "user_id", ts: str = "ts", gap_minutes: int = 30) -> DataFrame:
    """(key, session, started, ended, n_events, duration_seconds, bounced) split at gaps longer than the limit.

    Events are first pre-aggregated to slices as wide as the gap: two events in
    one slice are always closer than the gap, so only slices need ordering. A
    key then has at most one row per slice of time, however many events.
    """
    width = gap_minutes * 60
    slices = (
        events.select(key, ts, time_slice(ts, width).alias("_s"))
        .groupBy(key, "_s")
        .agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count("*").alias("n"))
    )
    by_time = Window.partitionBy(key).orderBy("_s")
    opened = F.lag("last").over(by_time)
    fresh = F.when(
        opened.isNull() | (epoch_micros("first") - epoch_micros(opened) > F.lit(width * MICROS)), 1
    ).otherwise(0)
    numbered_slices = slices.withColumn("fresh", fresh).withColumn("session", F.sum("fresh").over(by_time))
    return (
        numbered_slices.groupBy(key, "session")
        .agg(F.min("first").alias("started"), F.max("last").alias("ended"), F.sum("n").alias("n_events"))
        .withColumn("duration_seconds", (epoch_micros("ended") - epoch_micros("started")) / F.lit(1e6))
        .withColumn("bounced", F.col("n_events") == 1)
    )


def latest_before(
    left: DataFrame, right: DataFrame, key: str, ts: str, value: str, within_seconds: int, slice_seconds: int = 60
) -> DataFrame:
    """left rows with right's latest (value, time) at or before their time and within the limit; inner.

    Of right rows at the same time the one with the largest value counts.
    Within (key, time slice) the latest right row is carried along the time
    order; where the slice has none yet, the last one of the closest earlier
    slice is used, taken from one row per slice. No pairs are formed.
    """
    taken = F.struct(F.col(ts).alias("at"), F.col(value).alias("value"))
    sides = left.select("*", F.lit(1).alias("_side"), F.lit(None).cast(_struct_of(right, ts, value)).alias("_r"))
    blank = [F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns if c not in (key, ts)]
    marks = right.select(key, ts, *blank, F.lit(0).alias("_side"), taken.alias("_r")).select(sides.columns)
    both = sides.unionByName(marks).withColumn("_slice", time_slice(ts, slice_seconds))
    inside = (
        Window.partitionBy(key, "_slice").orderBy(ts, "_side", "_r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    carried = both.withColumn("_in", F.last("_r", ignorenulls=True).over(inside)).filter(F.col("_side") == 1)
    slice_end = both.groupBy(key, "_slice").agg(F.max("_r").alias("_end"))
    earlier = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    before = slice_end.select(key, "_slice", F.last("_end", ignorenulls=True).over(earlier).alias("_prev"))
    out = carried.join(before, [key, "_slice"]).withColumn("_hit", F.coalesce("_in", "_prev"))
    near = epoch_micros(ts) - epoch_micros("_hit.at") <= F.lit(within_seconds * MICROS)
    return out.filter(F.col("_hit").isNotNull() & near).select(
        *left.columns, F.col("_hit.at").alias("matched_at"), F.col("_hit.value").alias(value)
    )


def _struct_of(right, ts, value):
    return f"struct<at:{right.schema[ts].dataType.simpleString()},value:{right.schema[value].dataType.simpleString()}>"
