"""Streams against their batch twins, driven from parquet files to the end of the input."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from lodestream import schemas
from lodestream.functions import vectors as V
from lodestream.operators import ordering, profiles
from lodestream.operators import online_metrics as O
from lodestream.sources import keyed_log, snapshots, topics
from lodestream.sources import tables as D
from lodestream.streaming import workers as W


@pytest.fixture()
def feed(spark, sf, tmp_path):
    """Actions in four files in time order, and a reader that takes one file per micro-batch."""

    def start(frame=None, name="actions"):
        rows = (frame if frame is not None else D.actions(spark, sf)).withColumn("ts", F.col("ts").cast("timestamp"))
        rows = rows.cache()
        path = str(tmp_path / name)
        edges = [r[0] for r in rows.select(F.percentile_approx("event_id", [0.25, 0.5, 0.75])).collect()][0]
        low = -1
        for high in [*edges, 1 << 60]:
            rows.filter((F.col("event_id") > low) & (F.col("event_id") <= high)).coalesce(1).write.mode("append").parquet(path)
            low = high
        return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)

    return start


def drain(stream, name, mode="append", sink=None, checkpoint=None):
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    query = (writer.foreachBatch(sink) if sink else writer.format("memory").queryName(name)).start()
    query.awaitTermination(240)
    assert query.exception() is None
    return query


def test_profile_stream_equals_fold(spark, sf, feed, tmp_path):
    items = D.items(spark, sf)
    # every action sent twice: the second copy must not count
    twice = D.actions(spark, sf)
    actions = W.deduplicated(W.event_time(feed(twice.union(twice)), lateness="1 day"))
    root = str(tmp_path / "profiles")
    drain(actions, "p", sink=W.profile_updates(root, items, compact_every=2), checkpoint=str(tmp_path / "c"))
    schema = "user_id bigint, embedding array<double>, interaction_count bigint"
    got = {r.user_id: r for r in keyed_log.current(spark, root, "user_id", schema).collect()}
    want = profiles.fold(D.actions(spark, sf), items).collect()
    assert len(got) == len(want) > 0
    for row in want:
        assert got[row.user_id].interaction_count == row.interaction_count
        assert np.allclose(got[row.user_id].embedding, row.embedding, atol=1e-12)


def test_feature_stream_through_topics(spark, sf, feed, tmp_path):
    actions = feed().withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    sent = topics.encode(W.features(actions, 16), topics.FEATURE_TOPIC)
    query = topics.write_topic(sent, topics.FEATURE_TOPIC, str(tmp_path), str(tmp_path / "c"))
    query.awaitTermination(120)
    raw = topics.read_topic(spark, topics.FEATURE_TOPIC, str(tmp_path), stream=False)
    good, bad = topics.decode(raw, schemas.feature_vector(LongType()))
    assert bad.count() == 0
    assert good.count() == D.actions(spark, sf).count()
    assert good.filter(F.size("vector") != 16).count() == 0


def test_interval_join_equals_batch(spark, sf, feed):
    actions = D.actions(spark, sf)
    strong = F.col("action_type").isin("Purchase", "Convert")
    flush = spark.createDataFrame(
        [(1 << 40, -1, 0, kind, dt.datetime(2024, 6, 1)) for kind in ("Purchase", "View")], actions.schema
    )
    both = W.event_time(feed(actions.union(flush)))
    weak = W.event_time(feed(actions.union(flush), "features"))
    feature_rows = weak.filter(~strong).select("user_id", "ts", F.col("event_id").alias("feature_id"))
    joined = W.interval_join(both.filter(strong), feature_rows, "feature_id", salts=3)
    drain(joined, "joined")
    got = spark.table("joined").filter("user_id >= 0").select("event_id", "feature_id")
    want = ordering.latest_before(
        actions.filter(strong),
        actions.filter(~strong).select("user_id", "ts", F.col("event_id").alias("feature_id")),
        "user_id", "ts", "feature_id", 86400,
    ).select("event_id", "feature_id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_windowed_funnel_equals_batch(spark, sf, feed):
    drain(W.windowed_funnel(W.event_time(feed())), "funnel", mode="complete")
    got = sorted(map(tuple, spark.table("funnel").withColumn("window_start", F.col("window_start").cast("timestamp_ntz")).collect()))
    want = sorted(map(tuple, O.windowed_funnel(D.actions(spark, sf)).withColumn("window_start", F.col("window_start").cast("timestamp_ntz")).collect()))
    assert got == want and got


def test_joiner_and_trainer(spark, sf, feed, tmp_path):
    items, stored = D.items(spark, sf).cache(), D.profiles(spark, sf).cache()
    actions = feed().withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    examples = W.joined_examples(actions, items, stored, D.DIM)
    root = str(tmp_path / "model")
    ticks = iter(range(1706659200, 1706759200, 2000))
    run = W.training_batch(root, items, D.DIM, lr=0.05, clock=lambda: next(ticks))
    last = {}

    def sink(batch, batch_id):
        run(batch, batch_id)
        last["id"] = batch_id
        batch.write.mode("overwrite").parquet(str(tmp_path / "last"))

    drain(examples, "t", sink=sink, checkpoint=str(tmp_path / "c"))
    positives = D.examples(spark, sf).filter("label > 0.5").count()
    archive = spark.read.parquet(f"{root}/archive")
    assert archive.filter("label > 0").count() == D.examples(spark, sf).count()
    assert archive.filter("label = 0").count() == 4 * positives
    # no negative is an item its user acted on in its batch or before
    made = archive.filter("label = 0").select("user_id", "item_id", F.col("batch").alias("at"))
    acted = archive.filter("label > 0").select("user_id", "item_id", "batch")
    assert made.join(acted, ["user_id", "item_id"]).filter("batch <= at").count() == 0
    schema = "user_id bigint, vector array<double>"
    users = keyed_log.current(spark, f"{root}/user", "user_id", schema)
    assert users.count() == archive.select("user_id").distinct().count()
    # four batches 2000 s apart: snapshots at the first and the third
    names = snapshots.versions(spark, f"{root}/models")
    assert names == ["v1706659200", "v1706663200"]
    # a repeated batch leaves the same factors
    before = {r.user_id: r.vector for r in users.collect()}
    batch = spark.read.parquet(str(tmp_path / "last"))
    again = W.training_batch(root, items, D.DIM, lr=0.05, clock=lambda: 1706663201)
    again(batch, last["id"])
    after = {r.user_id: r.vector for r in keyed_log.current(spark, f"{root}/user", "user_id", schema).collect()}
    assert before.keys() == after.keys()
    assert all(np.allclose(before[k], after[k], atol=1e-12) for k in before)


def test_interval_join_with_equal_times(spark, feed):
    """Many features at one time: the largest value, as in the batch form."""
    day = dt.datetime(2024, 1, 5)
    rows = [(n, 1, 0, "View", day + dt.timedelta(hours=n // 10)) for n in range(60)]
    rows += [(100 + n, 1, 0, "Purchase", day + dt.timedelta(hours=n)) for n in range(40)]
    rows += [(1 << 40, 9, 0, kind, dt.datetime(2024, 6, 1)) for kind in ("Purchase", "View")]
    log = spark.createDataFrame(rows, "event_id bigint, user_id bigint, item_id bigint, action_type string, ts timestamp_ntz")
    both, weak = W.event_time(feed(log, "a")), W.event_time(feed(log, "b"))
    feature_rows = weak.filter("action_type = 'View'").select("user_id", "ts", F.col("event_id").alias("f"))
    drain(W.interval_join(both.filter("action_type = 'Purchase'"), feature_rows, "f", salts=2), "ties")
    got = sorted(map(tuple, spark.table("ties").filter("user_id = 1").select("event_id", "f").collect()))
    batch = ordering.latest_before(
        log.filter("action_type = 'Purchase' AND user_id = 1"),
        log.filter("action_type = 'View'").select("user_id", "ts", F.col("event_id").alias("f")), "user_id", "ts", "f", 86400,
    ).select("event_id", "f")
    assert got == sorted(map(tuple, batch.collect())) and len(got) == 30


def test_joiner_topic_trainer_with_a_restart(spark, sf, tmp_path):
    """Actions to training topic to factors; both queries stop half way and go on from their checkpoints."""
    items, stored = D.items(spark, sf).cache(), D.profiles(spark, sf).cache()
    actions = D.actions(spark, sf)
    middle = actions.agg(F.percentile_approx("event_id", 0.5)).first()[0]
    root, topic = str(tmp_path / "model"), str(tmp_path / "topics")

    def turn(part):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        stream = spark.readStream.schema(actions.schema).parquet(str(tmp_path / "log"))
        once = {"availableNow": True}
        joiner = W.start_joiner(stream, items, stored, D.DIM, topic, str(tmp_path / "cj"), **once)
        joiner.awaitTermination(240)
        trainer = W.start_trainer(
            spark, topic, root, items, D.DIM, str(tmp_path / "ct"), id_type=LongType(), trigger=once, lr=0.05,
            clock=lambda: 1706659200,
        )
        trainer.awaitTermination(240)
        assert joiner.exception() is None and trainer.exception() is None
        return spark.read.parquet(f"{root}/archive").filter("label > 0").count()

    known = D.examples(spark, sf)
    first = turn(actions.filter(F.col("event_id") <= middle))
    assert first == known.filter(F.col("event_id") <= middle).count()
    assert turn(actions.filter(F.col("event_id") > middle)) == known.count()
    sent = topics.read_topic(spark, topics.TRAINING_TOPIC, topic, stream=False).count()
    assert sent == known.count()
    assert spark.read.schema("value string").parquet(f"{root}/dead").count() == 0
    schema = "user_id bigint, vector array<double>"
    users = keyed_log.current(spark, f"{root}/user", "user_id", schema)
    assert users.count() == known.select("user_id").distinct().count()
    assert snapshots.versions(spark, f"{root}/models") == ["v1706659200"]
