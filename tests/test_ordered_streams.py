"""Streams with shuffled arrival against the batch, and state that is read by bucket."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestream.operators import ordering, profiles, recommend, trends
from lodestream.sources import tables as D
from lodestream.sources.bucketed import Table
from lodestream.streaming import ordered as W
from lodestream.streaming import workers


@pytest.fixture
def shuffled(spark, sf, tmp_path):
    """Actions in five files without any order of time, and a reader that takes one file per micro-batch."""

    def start(frame=None, files=5):
        rows = D.actions(spark, sf) if frame is None else frame
        rows = rows.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("_f", F.pmod(F.xxhash64("event_id", F.lit(3)), F.lit(files)))
        path = str(tmp_path / "feed")
        for n in range(files):
            rows.filter(F.col("_f") == n).drop("_f").coalesce(1).write.mode("append").parquet(path)
        return spark.readStream.schema(rows.drop("_f").schema).option("maxFilesPerTrigger", 1).parquet(path)

    return start


def drain(stream, tmp_path, sink):
    query = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).foreachBatch(sink).start()
    query.awaitTermination(300)
    assert query.exception() is None


def same_profiles(got, want):
    got, want = ({r.user_id: r for r in f.collect()} for f in (got, want))
    assert got.keys() == want.keys() and want
    for user, r in want.items():
        assert got[user].interaction_count == r.interaction_count and got[user].last_updated == r.last_updated
        assert np.allclose(got[user].embedding, r.embedding, atol=1e-12)


def test_profiles_do_not_depend_on_arrival(spark, sf, shuffled, tmp_path):
    items, root = D.items(spark, sf), str(tmp_path / "p")
    update = W.profile_updates(root, items, keep_slices=24 * 60, buckets=8)
    seen = []

    def sink(batch, n):
        update(batch, n)
        if n == 2:  # a repeated batch changes nothing
            update(batch, n)
        seen.append(batch.count())

    drain(shuffled(), tmp_path, sink)
    assert len(seen) == 5
    same_profiles(W.state_of(root, "bigint", 8)[2].read(spark), profiles.fold(D.actions(spark, sf), items))
    assert spark.read.parquet(f"{root}/late").count() == 0


def test_actions_beyond_the_kept_slices(spark, tmp_path):
    items = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "item_id bigint, embedding array<double>")

    def batch(*rows):
        frame = spark.createDataFrame([(n, u, i, "View", t) for n, u, i, t in rows], "event_id bigint, user_id bigint, item_id bigint, action_type string, t string")
        return frame.withColumn("ts", F.col("t").cast("timestamp_ntz")).drop("t")

    root = str(tmp_path / "p")
    update = W.profile_updates(root, items, slice_seconds=3600, keep_slices=2, buckets=4)
    batches = [
        batch((1, 7, 1, "2024-01-01 10:10:00"), (2, 8, 1, "2024-01-01 01:00:00")),
        batch((3, 7, 2, "2024-01-01 08:30:00"), (4, 7, 2, "2024-01-01 10:05:00"), (1, 7, 1, "2024-01-01 10:10:00")),  # late, in time; one known
        batch((5, 7, 1, "2024-01-01 07:59:00"), (6, 8, 2, "2024-01-01 00:10:00"), (9, 8, 99, "2024-01-01 00:11:00")),  # 5 too late
        batch(),
    ]
    for n, b in enumerate(batches):
        update(b, n)
    kept = batches[0].union(batches[1].filter("event_id <> 1")).union(batches[2].filter("event_id = 6"))
    same_profiles(W.state_of(root, "bigint", 4)[2].read(spark), profiles.fold(kept, items))
    assert [r.event_id for r in spark.read.parquet(f"{root}/late").collect()] == [5]
    held = {r.event_id for r in W.state_of(root, "bigint", 4)[0].read(spark).collect()}
    assert held == {1, 2, 3, 4, 6}


def test_closed_sessions_equal_the_batch(spark, sf, tmp_path):
    """Late files within the watermark; gaps of exactly the limit and a microsecond more."""
    edge = "2024-01-02 00:00:00", "2024-01-02 00:30:00", "2024-01-02 01:00:00.000001", "2024-02-20 00:00:00"
    rows = D.actions(spark, sf).select("user_id", "ts").unionByName(
        spark.createDataFrame([(-1, t) for t in edge], "user_id bigint, t string").select("user_id", F.col("t").cast("timestamp_ntz").alias("ts"))
    )
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    path = str(tmp_path / "feed")
    for n in range(4):
        rows.filter(F.pmod(F.xxhash64("ts"), F.lit(4)) == n).filter("ts < '2024-02-01'").coalesce(1).write.mode("append").parquet(path)
    rows.filter("ts > '2024-02-01'").coalesce(1).write.mode("append").parquet(path)  # moves the watermark
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path).withWatermark("ts", "40 days")
    query = W.sessions(stream).writeStream.outputMode("append").trigger(availableNow=True).format("memory").queryName("closed").start()
    query.awaitTermination(300)
    want = ordering.sessions(rows.filter("ts < '2024-02-01'").withColumn("ts", F.col("ts").cast("timestamp_ntz"))).collect()
    horizon = max(r.ended for r in spark.table("closed").collect())
    found = {(r.user_id, r.started, r.ended, r.n_events, r.bounced) for r in spark.table("closed").collect()}
    closed = {(r.user_id, r.started, r.ended, r.n_events, r.bounced) for r in want if r.ended <= horizon}
    assert found and found == closed
    assert len({t for t in found if t[0] == -1}) == 2


def test_heats_from_a_shuffled_stream(spark, sf, shuffled, tmp_path):
    items, root = D.items(spark, sf), str(tmp_path / "h")
    update = W.heat_updates(root, buckets=4)

    def sink(batch, n):
        update(batch, n)
        update(batch, n)

    drain(shuffled(), tmp_path, sink)
    kept = W.heats_at(root, "bigint", 4).read(spark)
    for second, clock in ((1706659200, "2024-01-31 00:00:00"), (1707000000, "2024-02-03 22:40:00"), (1720000000, "2024-07-03 09:46:40")):
        as_of = F.lit(clock).cast("timestamp_ntz")
        want = recommend.trending(D.actions(spark, sf), items, as_of, 10).collect()
        got = trends.trending(kept, items, second, 10).collect()
        assert [np.round(r.score, 9) for r in got] == pytest.approx([np.round(r.score, 9) for r in want], abs=2e-9)
        if clock.startswith("2024-01"):
            assert [tuple(r)[:2] for r in got] == [tuple(r)[:2] for r in want]


def test_bucketed_table(spark, tmp_path):
    table = Table(str(tmp_path / "t"), "k", ("k", "part"), "k bigint, part int, x double", 16)
    frame = lambda rows: spark.createDataFrame(rows, "k bigint, part int, x double")
    assert table.read(spark).collect() == [] and table.files(spark) == []
    table.write(frame([(n, 0, float(n)) for n in range(200)] + [(None, 0, 5.0)]), 0)
    table.write(frame([(3, 0, -1.0), (3, 1, -2.0), (500, 0, 1.0)]), 1)
    rows = {(r.k, r.part): r.x for r in table.read(spark).collect()}
    assert len(rows) == 203 and rows[3, 0] == -1.0 and rows[3, 1] == -2.0 and rows[4, 0] == 4.0 and rows[None, 0] == 5.0
    before = {(r.k, r.part): r.x for r in table.read(spark, before=1, only=frame([(3, 0, 0.0)])).collect()}
    assert before == {(3, 0): 3.0}
    table.write(frame([(3, 0, 7.0)]), 1)  # batch 1 again, with other rows: its first try is gone
    rows = {(r.k, r.part): r.x for r in table.read(spark, only=frame([(3, 0, 0.0), (4, 0, 0.0)])).collect()}
    assert rows == {(3, 0): 7.0, (4, 0): 4.0}


def test_files_read_do_not_grow_with_history(spark, tmp_path):
    """Forty batches of three keys: each opens the files of their buckets, one a bucket."""
    table = Table(str(tmp_path / "t"), "k", ("k",), "k bigint, x double", 32)
    rng = np.random.default_rng(1)
    table.write(spark.range(3000).selectExpr("id AS k", "0D AS x"), 0)
    opened = []
    for n in range(1, 41):
        keys = spark.createDataFrame([(int(k), float(n)) for k in rng.choice(3000, 3, replace=False)], "k bigint, x double")
        opened.append(len(table.files(spark, before=n, only=keys)))
        if n <= 12 or n > 38:
            table.write(keys, n)
    assert max(opened) <= 3 and len(table.files(spark)) == 32
    assert table.read(spark).count() == 3000


def test_workers_by_bucket_equal_the_log(spark, sf, tmp_path):
    """Both layouts of the stored profiles and factors give the same rows."""
    items = D.items(spark, sf)
    parts = [D.actions(spark, sf).filter(F.col("event_id") % 3 == n) for n in range(3)]
    stores = []
    for buckets in (None, 8):
        root = str(tmp_path / f"p{buckets}")
        run = workers.profile_updates(root, items, buckets=buckets)
        for n, part in enumerate(parts):
            run(part, n)
        rows = workers.profiles_at(root, "bigint", buckets).read(spark).collect()
        stores.append({r.user_id: (r.interaction_count, np.array(r.embedding)) for r in rows})
    assert stores[0].keys() == stores[1].keys()
    assert all(stores[0][u][0] == stores[1][u][0] and np.allclose(stores[0][u][1], stores[1][u][1], atol=1e-12) for u in stores[0])
    examples = D.full_examples(spark, sf).withColumn("event_id", F.xxhash64("user_id", "item_id", "ts"))
    sides = []
    for buckets in (None, 8):
        root = str(tmp_path / f"t{buckets}")
        run = workers.training_batch(root, items, D.DIM, lr=0.01, clock=lambda: 10**9, buckets=buckets)
        for n in range(3):
            run(examples.filter(F.pmod("event_id", F.lit(3)) == n), n)
        tables = [workers.factors_at(root, side, "bigint", buckets).read(spark).collect() for side in ("user", "item")]
        sides.append([{r[0]: np.array(r[1]) for r in t} for t in tables])
    for a, b in zip(*sides):
        assert a.keys() == b.keys() and a
        assert all(np.allclose(a[k], b[k], atol=1e-12) for k in a)
