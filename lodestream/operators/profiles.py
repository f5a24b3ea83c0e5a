"""Per-user profile embeddings folded from actions."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.functions import vectors as V
from lodestream.operators.actions import action_weight
from lodestream.operators.ordering import numbered
from lodestream.session import cut_lineage

LEARNING_RATE = 0.1
HISTORY_CHUNK = 256


def applied(actions: DataFrame, items: DataFrame) -> DataFrame:
    """Actions that count: known variant and known item."""
    return (
        actions.withColumn("weight", action_weight(F.col("action_type")))
        .filter(F.col("weight").isNotNull())
        .join(items.select("item_id"), "item_id", "left_semi")
    )


def fold(
    actions: DataFrame,
    items: DataFrame,
    learning_rate: float = LEARNING_RATE,
    start: DataFrame | None = None,
    tie: str = "event_id",
) -> DataFrame:
    """(user_id, embedding, interaction_count, last_updated) after all actions in (ts, tie) order.

    Each action sets e to (1 - r) e + r w item, so the n-th from the end of N
    actions adds r w (1 - r)^(n-1) item and a start embedding (frame of
    user_id, embedding) is scaled by (1 - r)^N. All actions of a user are
    numbered from the last, slice by slice of time, so a hot user is spread;
    shares are summed by (user, item) first, so each pair brings its vector
    once. Items are unique by id.
    """
    counted = applied(actions, items)
    tail = numbered(counted, "user_id", ["ts", tie], name="place", from_last=True)
    keep = 1.0 - learning_rate
    share = F.lit(learning_rate) * F.col("weight") * F.pow(F.lit(keep), F.col("place") - 1)
    shares = tail.groupBy("user_id", "item_id").agg(
        F.sum(share).alias("share"), F.count("*").alias("n"), F.max("ts").alias("latest")
    )
    out = (
        shares.join(items.select("item_id", "embedding"), "item_id")
        .groupBy("user_id")
        .agg(
            V.vector_sum("embedding", F.col("share")).alias("embedding"),
            F.sum("n").alias("interaction_count"),
            F.max("latest").alias("last_updated"),
        )
    )
    if start is not None:
        before = start.select("user_id", F.col("embedding").alias("before"))
        faded = V.scale("before", F.pow(F.lit(keep), F.col("interaction_count")))
        out = out.join(before, "user_id", "left").withColumn(
            "embedding", F.when(F.col("before").isNull(), F.col("embedding")).otherwise(V.add("embedding", faded))
        )
    return out.select("user_id", "embedding", "interaction_count", "last_updated")


def history(
    actions: DataFrame,
    items: DataFrame,
    learning_rate: float = LEARNING_RATE,
    tie: str = "event_id",
    slice_seconds: int = 60,
    chunk: int = HISTORY_CHUNK,
    item_features: str | None = None,
) -> DataFrame:
    """The profile right after each action, beginning at zero: one row per applied action.

    Actions of a user are numbered in order, written as narrow rows and cut into
    chunks. A chunk is folded by itself; the state it starts from comes from the
    ends of all chunks before it, which are folded first, in chunks of chunks, and
    so on up, and meets the chunk's rows in its fold. No group is larger than a
    chunk, whatever a user's share of rows. Only rows on their way into a fold carry
    a vector, the item's as it is stored; those that come out are not dealt again.
    With item_features, each row has its item's vector, in double, under that name
    as well; an item that comes twice gives what a join would. The largest number of
    actions of a user is what reaches the driver.
    """
    keep = 1.0 - learning_rate
    rows = numbered(applied(actions, items), "user_id", ["ts", tie], slice_seconds=slice_seconds, name="seq")
    place = F.col("seq") - 1
    rows = rows.withColumn("chunk", F.floor(place / chunk).cast("long")).withColumn("pos", (place % chunk).cast("int"))
    rows = cut_lineage(rows.withColumn("gain", F.lit(learning_rate) * F.col("weight")))
    most = rows.agg(F.max("seq")).first()[0] or 0
    vectors = items.select("item_id", F.col("embedding").alias("x"))
    joined = rows.join(vectors, "item_id")
    kept = [c for c in joined.columns if c not in ("x", "gain")]
    handed = [] if item_features is None else [item_features]
    schema = [f"{c} {joined.schema[c].dataType.simpleString()}" for c in kept]
    schema = ", ".join(schema + [f"{c} array<double>" for c in ("own", *handed)])
    run = _running(keep, after=True, drop=["gain"], vector=item_features)
    if most > chunk:
        starts = _starts(_ends(rows, vectors, keep, chunk), most // chunk + 1, keep**chunk, chunk).withColumnRenamed("block", "chunk")
        sides = [side.groupBy("user_id", "chunk") for side in (joined, starts)]
        own = sides[0].cogroup(sides[1]).applyInArrow(_from_start(run), f"{schema}, start array<double>")
    else:
        own = joined.groupBy("user_id", "chunk").applyInArrow(run, schema)
        own = own.withColumn("start", F.lit(None).cast("array<double>"))
    faded = V.scale("start", F.pow(F.lit(keep), F.col("pos") + 1))
    return own.select(
        *actions.columns,
        F.col("weight").alias("label"),
        F.col("seq").alias("interaction_count"),
        F.when(F.col("start").isNull(), F.col("own")).otherwise(V.add("own", faded)).alias("embedding"),
        *handed,
    )


def _ends(rows: DataFrame, vectors: DataFrame, keep: float, chunk: int) -> DataFrame:
    """(user_id, chunk, x): every chunk of users with several, x the state a full one folds to from zero, else null."""
    several = rows.filter(F.col("seq") == chunk + 1).select("user_id")
    begun, full = (
        rows.filter(F.col("pos") == at).select("user_id", "chunk").join(several, "user_id", "left_semi") for at in (0, chunk - 1)
    )
    steps = rows.select("user_id", "chunk", "pos", "gain", "item_id").join(full, ["user_id", "chunk"], "left_semi")
    run = _running(keep, after=True, drop=["gain", "item_id"])

    def last(block: pa.Table) -> pa.Table:
        done = run(block).slice(block.num_rows - 1)
        return done.select(["user_id", "chunk", "own"]).rename_columns(["user_id", "chunk", "x"])

    schema = f"user_id {rows.schema['user_id'].dataType.simpleString()}, chunk long, x array<double>"
    folded = steps.join(vectors, "item_id").groupBy("user_id", "chunk").applyInArrow(last, schema)
    return begun.join(folded, ["user_id", "chunk"], "left")


def _from_start(run):
    """A chunk's fold from zero beside the state it starts from, null for the first."""

    def both(chunk: pa.Table, start: pa.Table) -> pa.Table:
        out = run(chunk)
        before = pa.array(start["start"].to_pylist() or [None], pa.list_(pa.float64()))
        return out.append_column("start", before.take(pa.array(np.zeros(out.num_rows, np.int64))))

    return both


def _starts(ends: DataFrame, most: int, keep: float, chunk: int) -> DataFrame:
    """(user_id, block, start): the state before each block, from the ends x of all blocks before it.

    ends (user_id, chunk, x) has every block, x null for a last one that is not
    full; keep is the fade over one block, most the largest number of blocks.
    """
    blocks = ends.select(
        "user_id",
        F.col("chunk").alias("block"),
        F.floor(F.col("chunk") / chunk).cast("long").alias("chunk"),
        (F.col("chunk") % chunk).cast("int").alias("pos"),
        "x",
        F.lit(1.0).alias("gain"),
    )
    kind = ends.schema["user_id"].dataType.simpleString()
    schema = f"user_id {kind}, block long, chunk long, pos int, own array<double>, whole array<double>"
    inside = blocks.groupBy("user_id", "chunk").applyInArrow(_running(keep, after=False, drop=["gain"], size=chunk), schema)
    if most <= chunk:
        return inside.select("user_id", "block", F.col("own").alias("start"))
    inside = cut_lineage(inside)
    upper = inside.groupBy("user_id", "chunk").agg(F.first("whole", ignorenulls=True).alias("x"))
    above = _starts(upper, most // chunk + 1, keep**chunk, chunk).select("user_id", F.col("block").alias("chunk"), "start")
    faded = V.scale("start", F.pow(F.lit(keep), F.col("pos")))
    start = F.when(F.col("own").isNull(), faded).when(F.col("start").isNull(), F.col("own")).otherwise(V.add("own", faded))
    return inside.join(above, ["user_id", "chunk"]).select("user_id", "block", start.alias("start"))


def _running(keep: float, after: bool, drop: list[str], size: int | None = None, vector: str | None = None):
    """Fold of one chunk from zero, state by state, after or before each of its rows.

    A row without x leaves the state; a chunk without any has null states. With
    a size, whole is the state after the chunk's last row if the chunk has that
    many full rows, else null. A vector is a column for x: rows of one place, which
    are an action with each vector of its item, come with each x of that place.
    """

    def run(chunk: pa.Table) -> pa.Table:
        chunk = chunk.sort_by("pos")
        x = chunk["x"].combine_chunks()
        filled = x.is_valid().to_numpy(zero_copy_only=False)
        steps = x.flatten().to_numpy().astype(np.float64)
        dim = len(steps) // max(1, int(filled.sum()))
        steps = steps.reshape(-1, max(dim, 1))
        gain = chunk["gain"].to_numpy()
        state = np.zeros(steps.shape[1])
        own, used = np.empty((len(gain), steps.shape[1])), 0
        for n in range(len(gain)):
            if not after:
                own[n] = state
            if filled[n]:
                state = keep * state + gain[n] * steps[used]
                used += 1
            if after:
                own[n] = state
        if filled.any():
            offsets = np.arange(0, own.size + 1, own.shape[1], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(own.ravel()))
        else:
            lists = pa.nulls(len(gain), pa.list_(pa.float64()))
        out = chunk.drop_columns(["x", *drop]).append_column("own", lists)
        if size is not None:
            whole = [state if used == size and n == len(gain) - 1 else None for n in range(len(gain))]
            out = out.append_column("whole", pa.array(whole, pa.list_(pa.float64())))
        if vector is not None:
            pos = chunk["pos"].to_numpy()
            first, n = np.searchsorted(pos, pos, "left"), np.searchsorted(pos, pos, "right")
            n -= first
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            out = out.take(pa.array(np.repeat(np.arange(len(pos)), n)))
            out = out.append_column(vector, x.take(pa.array(np.repeat(first, n) + step)).cast(pa.list_(pa.float64())))
        return out

    return run


def get_or_create(users: DataFrame, profiles: DataFrame, dim: int) -> DataFrame:
    """Profile of each asked user; a zero one where none is stored."""
    return (
        users.select("user_id")
        .distinct()
        .join(profiles, "user_id", "left")
        .select(
            "user_id",
            F.coalesce(V.as_double("embedding"), V.zeros(dim)).alias("embedding"),
            F.coalesce("interaction_count", F.lit(0).cast("long")).alias("interaction_count"),
            F.col("embedding").isNull().alias("created"),
        )
    )
