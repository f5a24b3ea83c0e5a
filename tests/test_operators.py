"""Operators on small literal frames, including the awkward rows."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.ml.recommendation import ALS
from pyspark.sql import functions as F

from lodestream.functions import vectors as V
from lodestream.operators import actions as actions_of
from lodestream.operators import keyed_tables as K
from lodestream.operators import optimizers, ordering, profiles, quality, recommend
from lodestream.operators import ranking_metrics as M
from lodestream.operators import similarity as S
from lodestream.operators import training as T
from lodestream.sources import snapshots, topics
from lodestream import schemas

T0 = dt.datetime(2024, 1, 1)
NIL = "00000000-0000-0000-0000-000000000000"
UID = "0f8b2c61-7d3e-4a90-9c15-2e6ab47d01f3"


def vectors(spark, n, dim, seed, key="item_id"):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, dim))
    return m, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], f"{key} bigint, embedding array<double>")


def brute(q, m, k, metric="cosine", hide=lambda a, b: False):
    if metric == "cosine":
        s = (q / np.linalg.norm(q, axis=1)[:, None]) @ (m / np.linalg.norm(m, axis=1)[:, None]).T
    elif metric == "dot":
        s = q @ m.T
    else:
        s = -((q[:, None, :] - m[None, :, :]) ** 2).sum(axis=2)
    out = set()
    for a in range(len(q)):
        order = [b for b in np.lexsort((np.arange(len(m)), -np.round(s[a], 9))) if not hide(a, b)]
        out |= {(a, int(b), n + 1) for n, b in enumerate(order[:k])}
    return out


def found(df, left="user_id", right="item_id"):
    return {(r[left], r[right], r["rank"]) for r in df.collect()}


@pytest.mark.parametrize("metric", ["cosine", "dot", "l2"])
@pytest.mark.parametrize("items_per_cell", [65536, 40])
def test_top_k_equals_brute_force(spark, metric, items_per_cell):
    q, users = vectors(spark, 30, 8, 1, "user_id")
    m, items = vectors(spark, 170, 8, 2)
    got = S.top_k(users, items, 7, metric, items_per_cell=items_per_cell)
    assert found(got) == brute(q, m, 7, metric)


@pytest.mark.parametrize("items_per_cell", [65536, 30])
def test_top_k_leaves_out_seen_and_takes_depth_by_query(spark, items_per_cell):
    q, users = vectors(spark, 20, 6, 3, "user_id")
    m, items = vectors(spark, 100, 6, 4)
    pairs = [(a, b) for a in range(20) for b in range(100) if (a * b) % 3 == 0]
    seen = spark.createDataFrame(pairs, "user_id bigint, item_id bigint")
    got = S.top_k(users, items, 5, "dot", seen=seen, items_per_cell=items_per_cell)
    assert found(got) == brute(q, m, 5, "dot", lambda a, b: (a * b) % 3 == 0)
    deep = S.top_k(users.withColumn("d", F.col("user_id") + 1), items, F.col("d"), items_per_cell=items_per_cell)
    assert found(deep) == {t for t in brute(q, m, 21) if t[2] <= t[0] + 1}


def test_top_k_ties_and_zero_vectors(spark):
    items = spark.createDataFrame([(n, [0.5] * 3) for n in (5, 3, 9)], "item_id bigint, embedding array<float>")
    users = spark.createDataFrame([(1, [1.0] * 3), (2, [0.0] * 3)], "user_id bigint, embedding array<float>")
    for cell in (65536, 1):
        rows = S.top_k(users, items, 2, items_per_cell=cell).collect()
        assert sorted((r.user_id, r.item_id, r["rank"], round(r.score, 6)) for r in rows) == [
            (1, 3, 1, 1.0), (1, 5, 2, 1.0), (2, 3, 1, 0.0), (2, 5, 2, 0.0)
        ]


def test_top_k_string_ids(spark):
    items = spark.createDataFrame([("b", [1.0]), ("a", [1.0])], "item_id string, embedding array<double>")
    users = spark.createDataFrame([("u", [2.0])], "user_id string, embedding array<double>")
    assert [(r.item_id, r["rank"]) for r in S.top_k(users, items, 1).collect()] == [("a", 1)]


@pytest.mark.parametrize("metric", ["cosine", "dot", "l2"])
def test_top_k_is_the_same_on_every_grid(spark, metric):
    """Broken vectors on both sides, two sizes, repeated rows and ids: one answer."""
    rng = np.random.default_rng(2)
    nan, inf = float("nan"), float("inf")
    broken = [None, [], [nan, 1.0, 2.0], [inf, 1.0, 2.0], [None, 1.0, 2.0], [1e200, 1e200, -1e200]]
    three = [rng.normal(size=3).tolist() for _ in range(40)]
    two = [rng.normal(size=2).tolist() for _ in range(9)]
    kind = "{} bigint, embedding array<double>"
    vectors_ = three + two + broken[:5] + broken
    items = [*enumerate(vectors_), (3, three[3]), (3, three[3]), (5, three[30])]
    queries = [*enumerate(three[:12] + two[:3] + broken[:5]), (1, three[1]), (1, three[20])]
    found_on = []
    for cell in (65536, 4):
        a = spark.createDataFrame(queries, kind.format("user_id")).repartition(5)
        b = spark.createDataFrame(items, kind.format("item_id")).repartition(3)
        rows = S.top_k(a, b, 3, metric, items_per_cell=cell).collect()
        found_on.append(sorted((r.user_id, r["rank"], r.item_id, round(r.score, 6)) for r in rows))
    assert found_on[0] == found_on[1]
    # 15 sound queries and one more vector under id 1, three rows each
    assert len(found_on[0]) == 3 * 16
    if metric == "cosine":
        assert {(u, i) for u, r, i, _ in found_on[0] if r == 1 and u not in (1, 5)} >= {(0, 0), (2, 2), (3, 3), (12, 40)}


def test_exclusions_hide_every_row_of_an_id(spark):
    items = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [0.5, 0.5])], "item_id bigint, embedding array<double>")
    users = spark.createDataFrame([(7, [1.0, 0.0]), (7, [1.0, 0.1])], "user_id bigint, embedding array<double>")
    seen = spark.createDataFrame([(7, 1)], "user_id bigint, item_id bigint")
    assert [r.item_id for r in S.top_k(users, items, 3, seen=seen).collect()] == [2, 2]


def test_similar_leaves_out_self(spark):
    m, items = vectors(spark, 50, 5, 6)
    keys = spark.createDataFrame([(n,) for n in (*range(50), 999)], "item_id bigint")
    got = recommend.similar_items(items, keys, 4, items_per_cell=20)
    assert found(got, "query_item_id") == brute(m, m, 4, hide=lambda a, b: a == b)


def test_ann_recall(spark):
    q, users = vectors(spark, 60, 16, 8, "user_id")
    m, items = vectors(spark, 800, 16, 9)
    exact = brute(q, m, 10)
    near = S.ann_top_k(users, items, 10, n_lists=12, n_probe=8, items_per_cell=50)
    hits = {t[:2] for t in found(near)} & {t[:2] for t in exact}
    assert len(hits) / len(exact) >= 0.95
    full = S.ann_top_k(users, items, 10, n_lists=6, n_probe=6)
    assert found(full) == exact
    # one list that nearly all queries probe: cut into lanes of both sides
    hot = S.ann_top_k(users, items, 10, n_lists=2, n_probe=2, items_per_cell=60, queries_per_cell=7)
    assert found(hot) == exact
    me = S.similar(items, items.select("item_id").limit(30), 4, "item_id", index=(5, 5))
    asked = [r[0] for r in items.select("item_id").limit(30).collect()]
    want = {t for t in brute(m, m, 4, hide=lambda a, b: a == b) if t[0] in asked}
    assert found(me, "query_item_id") == want
    none = S.ann_top_k(users, items.limit(0), 10, n_lists=6, n_probe=6)
    assert none.count() == 0


def _log(spark, rows):
    return spark.createDataFrame(rows, "event_id bigint, user_id bigint, item_id bigint, action_type string, ts timestamp_ntz")


def _fold(log, table):
    state = {}
    weights = schemas.ACTION_WEIGHTS
    steps = []
    for e, u, i, kind, ts in sorted(log, key=lambda r: (r[4], r[0])):
        if kind not in weights or i not in table:
            continue
        v, n = state.get(u, (np.zeros(3), 0))
        state[u] = (0.9 * v + 0.1 * weights[kind] * table[i], n + 1)
        steps.append((e, state[u][0]))
    return state, steps


def _busy_log(n, kinds=("View", "Like", "Share", "Purchase", "nonsense")):
    rng = np.random.default_rng(3)
    users = np.where(rng.random(n) < 0.6, 1, rng.integers(2, 6, n))
    seconds = rng.integers(0, 40 * 3600, n)
    return [
        (e, int(users[e]), int(rng.integers(0, 8)), kinds[int(rng.integers(0, len(kinds)))], T0 + dt.timedelta(seconds=int(seconds[e])))
        for e in range(n)
    ]


def test_profile_fold_with_hot_user_equals_sequential(spark):
    log = _busy_log(4000)
    table = {i: np.array([i + 1.0, -i, 0.5 * i]) for i in range(7)}
    items = spark.createDataFrame([(i, v.tolist()) for i, v in table.items()], "item_id bigint, embedding array<double>")
    want, steps = _fold(log, table)
    assert want[1][1] > 1500
    got = {r.user_id: r for r in profiles.fold(_log(spark, log), items).collect()}
    assert got.keys() == want.keys()
    for u, (v, n) in want.items():
        assert got[u].interaction_count == n and np.allclose(got[u].embedding, v, atol=1e-12)
    start = spark.createDataFrame([(2, [100.0, 0.0, -7.0])], "user_id bigint, embedding array<double>")
    moved = {r.user_id: r.embedding for r in profiles.fold(_log(spark, log), items, start=start).collect()}
    assert np.allclose(moved[2], want[2][0] + np.array([100.0, 0.0, -7.0]) * 0.9 ** want[2][1], atol=1e-12)
    # chunks of 256, and of 5 with three levels above them
    for chunk in (256, 5):
        after = {r.event_id: r.embedding for r in profiles.history(_log(spark, log), items, chunk=chunk).collect()}
        assert len(after) == len(steps)
        assert all(np.allclose(after[e], v, atol=1e-12) for e, v in steps)


def _plan_of(df) -> list[str]:
    """Lines of the plan, the last operator first, before anything adapts."""
    return df._jdf.queryExecution().executedPlan().toString().splitlines()


@pytest.mark.parametrize("chunk", [256, 7])
def test_examples_after_update_are_not_dealt_again(spark, monkeypatch, chunk):
    """No row with a profile is shuffled or written; those on their way into the fold carry the stored floats."""
    items = spark.createDataFrame([(i, [i + 1.0, -1.0 * i, 0.5 * i]) for i in range(7)], "item_id bigint, embedding array<float>")
    written, write = [], profiles.cut_lineage
    monkeypatch.setattr(profiles, "cut_lineage", lambda df: (written.append(df.schema.simpleString()), write(df))[1])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        # at most 40 actions of a user: chunks of 7, not chunks of chunks
        log = [(e, e % 5, e % 7, "Click", T0 + dt.timedelta(seconds=31 * e)) for e in range(200)]
        done = profiles.history(_log(spark, log), items, chunk=chunk, item_features="item_features")
        plan = _plan_of(actions_of.post_update_examples(done, items))
        fold = next(n for n, line in enumerate(plan) if "InArrow" in line)
        assert not any("Exchange" in line or "Join" in line for line in plan[:fold])
        assert len(written) == 1 and "array" not in written[0]
        vectors = [f.dataType.simpleString() for f in done.schema.fields if "array" in f.dataType.simpleString()]
        assert vectors == ["array<double>"] * 2 and not any("cast(embedding" in line for line in plan)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("chunk", [256, 5])
def test_examples_after_update_equal_a_join(spark, chunk):
    """Hot users, an item without a vector, one that is missing and one that comes twice."""
    log = _busy_log(700)
    table = {i: [i + 1.0, -1.0 * i, 0.5 * i] for i in range(6)} | {4: None}
    items = spark.createDataFrame([*table.items(), (5, [9.0, 8.0, 7.0])], "item_id bigint, embedding array<float>")
    examples = lambda **way: actions_of.post_update_examples(profiles.history(_log(spark, log), items, chunk=chunk, **way), items)
    joined, carried = (
        sorted((r.event_id, r.user_id, r.item_id, r.label, r.interaction_count, r.item_features or []) for r in examples(**way).collect())
        for way in ({}, {"item_features": "item_features"})
    )
    assert joined == carried
    once = items.filter("embedding IS NOT NULL AND embedding[0] != 6")
    known = {i: np.array(v) for i, v in (table | {5: [9.0, 8.0, 7.0]}).items() if v is not None}
    _, steps = _fold(log, known)
    done = profiles.history(_log(spark, log), once, chunk=chunk, item_features="item_features")
    got = {r.event_id: r for r in actions_of.post_update_examples(done, once).collect()}
    assert got.keys() == {e for e, _ in steps}
    assert all(np.allclose(got[e].user_features, v, atol=1e-12) for e, v in steps)
    assert all(r.item_features == known[r.item_id].tolist() for r in got.values())


@pytest.mark.parametrize("rate", [0.001, 0.1, 0.95, 1.0])
def test_fold_and_history_agree_at_any_rate(spark, rate):
    """A long tail of zeros leaves what came before it, however small."""
    log = [(n, 1, 0 if n < 100 else 1, "Purchase", T0 + dt.timedelta(minutes=n)) for n in range(1200)]
    items = spark.createDataFrame([(0, [1.0]), (1, [0.0])], "item_id bigint, embedding array<double>")
    state = 0.0
    for n in range(1200):
        state = (1 - rate) * state + rate * (1.0 if n < 100 else 0.0)
    got = profiles.fold(_log(spark, log), items, rate).first()
    last = profiles.history(_log(spark, log), items, rate).filter("event_id = 1199").first()
    assert got.embedding[0] == pytest.approx(state, rel=1e-9, abs=1e-300)
    assert last.embedding[0] == pytest.approx(state, rel=1e-9, abs=1e-300)
    if rate < 0.95:
        assert state > 0


def test_numbered_from_the_last(spark):
    df = _log(spark, _busy_log(500)).select("event_id", "user_id", "ts")
    up = ordering.numbered(df, "user_id", ["ts", "event_id"]).collect()
    down = {r.event_id: r.seq for r in ordering.numbered(df, "user_id", ["ts", "event_id"], from_last=True).collect()}
    total = {}
    for r in up:
        total[r.user_id] = total.get(r.user_id, 0) + 1
    assert all(down[r.event_id] == total[r.user_id] + 1 - r.seq for r in up)


def test_dense_ids_and_ranks(spark):
    ids = spark.createDataFrame([(f"u{n % 300}",) for n in range(900)] + [(None,)], "id string")
    rows = ordering.dense_ids(ids, "id").collect()
    assert sorted(r.idx for r in rows) == list(range(300)) and len({r.id for r in rows}) == 300
    rng = np.random.default_rng(1)
    marks = [(int(u), int(p)) for u, p in zip(rng.integers(0, 3, 400), rng.integers(0, 5000, 400))]
    asked = [(u, p, "x") for u in range(4) for p in range(0, 6000, 37)]
    got = ordering.ranks_below(
        spark.createDataFrame(asked, "u bigint, at bigint, extra string"), spark.createDataFrame(marks, "u bigint, at bigint"),
        "u", "at", "n", width=64,
    ).collect()
    assert {(r.u, r.at): r.n for r in got} == {(u, p): sum(v == u and q <= p for v, q in marks) for u, p, _ in asked}


def test_latest_before_breaks_ties_by_value(spark):
    asks = spark.createDataFrame([(1, T0, 5)], "user_id int, ts timestamp_ntz, event_id int")
    feats = [(1, T0, n) for n in range(50)] + [(1, T0 - dt.timedelta(hours=3), 99)]
    for seed in (0, 1, 2):
        order = np.random.default_rng(seed).permutation(len(feats))
        right = spark.createDataFrame([feats[n] for n in order], "user_id int, ts timestamp_ntz, f int").repartition(3)
        assert ordering.latest_before(asks, right, "user_id", "ts", "f", 86400).first().f == 49
    early = spark.createDataFrame([f for f in feats[:50]], "user_id int, ts timestamp_ntz, f int").withColumn("ts", F.col("ts") - F.expr("INTERVAL 2 HOURS"))
    assert ordering.latest_before(asks, early, "user_id", "ts", "f", 86400).first().f == 49


def test_numbered_and_sessions_with_hot_key(spark):
    log = _busy_log(3000)
    df = _log(spark, log).select("event_id", "user_id", "ts")
    got = {r.event_id: r.seq for r in ordering.numbered(df, "user_id", ["ts", "event_id"]).collect()}
    want, per = {}, {}
    for e, u, _, _, ts in sorted(log, key=lambda r: (r[4], r[0])):
        per[u] = per.get(u, 0) + 1
        want[e] = per[u]
    assert got == want
    sparse = [r for r in log if r[1] != 1 or r[0] % 40 == 0]
    visits = ordering.sessions(_log(spark, sparse)).collect()
    expected, last = {}, {}
    for _, u, _, _, ts in sorted(sparse, key=lambda r: r[4]):
        if u not in last or (ts - last[u][1]) > dt.timedelta(minutes=30):
            last[u] = [ts, ts, 0]
            expected[(u, ts)] = last[u]
        last[u][1] = ts
        last[u][2] += 1
    assert {(r.user_id, r.started): [r.started, r.ended, r.n_events] for r in visits} == expected


def test_action_errors(spark):
    now = T0
    rows = spark.createDataFrame(
        [
            (0, UID, UID, now),
            (1, NIL, UID, now),
            (2, UID, NIL, now),
            (3, UID, UID, now + dt.timedelta(hours=2)),
            (4, UID, UID, now - dt.timedelta(days=366)),
            (5, None, UID, now),
            (6, UID, UID, now + dt.timedelta(hours=1)),
        ],
        "n int, user_id string, item_id string, ts timestamp_ntz",
    )
    error = quality.action_error(F.lit(now).cast("timestamp_ntz"))
    got = {r.n: r.e for r in rows.select("n", error.alias("e")).collect()}
    assert got[0] is None and got[6] is None
    assert got[1] == got[5] == "User ID cannot be nil" and got[2] == "Item ID cannot be nil"
    assert "future" in got[3] and "past" in got[4]
    good, bad = quality.quarantine(rows, error)
    assert good.count() == 2 and bad.count() == 5


def test_profile_errors(spark):
    rows = spark.createDataFrame(
        [(0, UID, [0.1, 0.2]), (1, UID, [math.nan, 0.2]), (2, UID, []), (3, UID, [math.inf]), (4, UID, [0.0] * 2049), (5, UID, None)],
        "n int, user_id string, embedding array<float>",
    )
    got = {r.n: r.e for r in rows.select("n", quality.profile_error().alias("e")).collect()}
    assert got[0] is None and "invalid" in got[1] and "invalid" in got[3] and "too large" in got[4]
    assert got[2] == got[5] == "User embedding cannot be empty"


def test_null_fields_fail_every_validator(spark):
    def errors(kind, rows, error):
        return [r.e for r in spark.createDataFrame(rows, kind).select(error.alias("e")).collect()]

    now = F.lit(T0).cast("timestamp_ntz")
    assert None not in errors("user_id string, item_id string, ts timestamp_ntz", [(UID, UID, None)], quality.action_error(now))
    vector = [0.5, None]
    assert None not in errors("user_id string, embedding array<double>", [(UID, vector), (UID, None)], quality.profile_error())
    assert None not in errors(
        "item_id string, embedding array<double>, category string, popularity_score double",
        [(UID, vector, "c", 0.5), (UID, [1.0], None, 0.5), (UID, [1.0], "c", None)], quality.item_error(),
    )
    requests = [(UID, None, None, None), (UID, -1, None, None), (UID, 0, None, None), (UID, 3, [None], None), (UID, 3, None, [None])]
    kind = "user_id string, num_recommendations int, filter_categories array<string>, exclude_items array<string>"
    assert None not in errors(kind, requests, quality.request_error())
    assert errors(kind, [(UID, 3, None, None)], quality.request_error()) == [None]
    fine = (UID, UID, 0.5, [1.0], [1.0], [1.0])
    kind = "user_id string, item_id string, label double, user_features array<double>, item_features array<double>, context_features array<double>"
    holes = [tuple(None if n == k else v for n, v in enumerate(fine)) for k in range(6)]
    holes += [tuple([None] if n == k else v for n, v in enumerate(fine)) for k in (3, 4, 5)]
    assert errors(kind, [fine], quality.example_error()) == [None]
    assert None not in errors(kind, holes, quality.example_error())
    assert None not in errors("id string, vector array<double>", [(UID, None), (UID, [None]), (None, [1.0])], quality.feature_error())
    model = [("v1", "user", [1.0]), ("v2", "bias", [None]), ("v3", "bias", [1.0]), ("v4", "item", None)]
    got = {r.version: r.error for r in quality.model_errors(spark.createDataFrame(model, "version string, side string, vector array<double>")).collect()}
    assert got == {"v1": None, "v2": "Bias weights contain invalid values", "v3": None, "v4": "Item embedding weights cannot be empty"}
    assert "got 0" in errors("v array<double>", [(None,)], K.dimension_error("v", 64))[0]


def test_decode_drops_what_is_not_a_record(spark):
    good = (
        f'{{"user_id":"{UID}","item_id":"{UID}","action_type":"Like","timestamp":"2024-01-01T10:00:00.000001Z","context":{{"a":[1]}}}}'
    )
    rows = [
        ("k", good),
        ("k", None),
        ("k", "not json"),
        ("k", good.replace("Like", "Stare")),
        ("k", good.replace(f'"user_id":"{UID}",', "")),
        ("k", good.replace(f'"user_id":"{UID}"', '"user_id":"not a uuid"')),
        ("k", good.replace("2024-01-01T", "someday ")),
        ("k", good.replace(".000001Z", "")),
        ("k", good.replace("10:00:00.000001Z", "18:00:00+08:00").replace(',"context":{"a":[1]}', "")),
    ]
    records, bad = topics.decode(spark.createDataFrame(rows, "key string, value string"), schemas.user_action())
    ten = dt.datetime(2024, 1, 1, 10)
    assert [(r.action_type, r.ts, r.context) for r in records.collect()] == [
        ("Like", ten.replace(microsecond=1), '{"a":[1]}'), ("Like", ten, None)
    ]
    assert bad.count() == 6
    sent = topics.encode(records, topics.ACTION_TOPIC).collect()
    assert sent[0].key == UID and sent[0].value == good
    again, bad = topics.decode(topics.encode(records, topics.ACTION_TOPIC), schemas.user_action())
    assert again.collect() == records.collect() and bad.count() == 0


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Kolkata"])
def test_times_go_out_in_utc_in_any_zone(spark, zone):
    from lodestream.operators.actions import action_feature_vectors, training_examples

    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        # noon, and an hour that New York's clocks skip
        for at in ("2024-01-01T12:00:00Z", "2024-03-10T02:30:00Z"):
            row = spark.createDataFrame([(1, UID, UID, "Like", at, None)], "event_id int, user_id string, item_id string, action_type string, t string, context string")
            row = row.withColumn("ts", F.to_timestamp("t")).drop("t")
            value = topics.encode(row, topics.ACTION_TOPIC).first().value
            assert f'"timestamp":"{at[:-1]}.000000Z"' in value
            back, bad = topics.decode(topics.encode(row, topics.ACTION_TOPIC), schemas.user_action())
            assert back.select(F.col("ts").cast("string")).first()[0] == at[:-1].replace("T", " ") and bad.count() == 0
            hour = int(at[11:13]) / 24
            assert action_feature_vectors(row, 16).first().vector[6] == pytest.approx(hour)
            items = spark.createDataFrame([(UID, [1.0])], "item_id string, embedding array<double>")
            people = spark.createDataFrame([(UID, [1.0])], "user_id string, embedding array<double>")
            assert training_examples(row, items, people, 1).first().context_features[0] == pytest.approx(hour)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_upsert_last_wins_and_is_idempotent(spark):
    kind = "id bigint, embedding array<double>, seq int"
    old = spark.createDataFrame([(1, [1.0], 0), (2, [2.0], 0)], kind)
    new = spark.createDataFrame([(2, [3.0], 1), (2, [4.0], 2), (3, [5.0], 1)], kind)
    once = K.upsert(old, new, "id", ["seq"], 1)
    twice = K.upsert(once, new, "id", ["seq"], 1)
    want = [(1, [1.0]), (2, [4.0]), (3, [5.0])]
    assert sorted((r.id, r.embedding) for r in once.collect()) == want
    assert sorted((r.id, r.embedding) for r in twice.collect()) == want
    wrong = spark.createDataFrame([(2, [3.0, 1.0], 1)], kind)
    with pytest.raises(Exception, match="expected 1, got 2"):
        K.upsert(old, wrong, "id", ["seq"], 1).collect()


def test_new_rows_have_defaults(spark):
    now = F.lit(T0).cast("timestamp_ntz")
    p = K.new_profiles(spark.createDataFrame([(1,)], "user_id bigint"), 4, now).first()
    assert p.embedding == [0.0] * 4 and p.preferences == [] and p.interaction_count == 0 and p.last_updated == T0
    i = K.new_items(spark.createDataFrame([(1, [1.0], "books")], "item_id bigint, embedding array<float>, category string"), now).first()
    assert i.tags == [] and i.popularity_score == 0.0
    touched = K.update_vectors(
        spark.createDataFrame([(1, [1.0], T0), (2, [1.0], T0)], "user_id bigint, embedding array<double>, last_updated timestamp_ntz"),
        spark.createDataFrame([(1, [9.0]), (7, [9.0])], "user_id bigint, embedding array<double>"),
        "user_id",
        touched=("last_updated", F.lit(T0 + dt.timedelta(days=1)).cast("timestamp_ntz")),
    )
    assert sorted((r.user_id, r.embedding, r.last_updated.day) for r in touched.collect()) == [(1, [9.0], 2), (2, [1.0], 1)]


def _recs(spark, rows):
    return spark.createDataFrame(rows, "user_id int, rank int, item_id string")


def test_ranking_metrics(spark):
    recs = _recs(spark, [(1, 1, "a"), (1, 2, "b"), (1, 3, "c")])
    relevant = spark.createDataFrame([(1, "a", 1.0), (1, "c", 0.5), (3, "z", 1.0)], "user_id int, item_id string, grade double")
    users = spark.createDataFrame([(1,), (2,), (3,)], "user_id int")
    got = {r.user_id: r for r in M.precision_recall(recs, relevant, users, 5).collect()}
    assert (got[1].precision, got[1].recall, got[1].f1) == pytest.approx((2 / 3, 1.0, 0.8))
    assert (got[2].precision, got[2].recall, got[2].f1) == (0, 0, 0) == (got[3].precision, got[3].recall, got[3].f1)
    ndcg = {r.user_id: r.ndcg for r in M.ndcg(recs, relevant, users, 5).collect()}
    assert ndcg[1] == pytest.approx(0.950234, abs=1e-6) and ndcg[2] == ndcg[3] == 0
    ap = {r.user_id: r.ap for r in M.average_precision(recs, relevant, users, 5).collect()}
    assert ap[1] == pytest.approx((1 + 2 / 3) / 2)
    assert M.mean_average_precision(recs, relevant, users, 5).first()[0] == pytest.approx(ap[1] / 3)
    items = spark.createDataFrame(
        [("a", [0.0, 0.0], "x"), ("b", [3.0, 4.0], "y"), ("c", [0.0, 0.0], "x"), ("d", [1.0, 1.0], "x")],
        "item_id string, embedding array<double>, category string",
    )
    assert M.coverage(recs, items).first()[0] == 0.75
    apart = {r.user_id: r.diversity for r in M.intra_list_diversity(recs, items, users).collect()}
    assert apart == {1: pytest.approx(10 / 3), 2: 0.0, 3: 0.0}
    # a list longer than a block, one with an unknown item, and one of uneven sizes
    long_list = [(1, n + 1, f"i{n}") for n in range(1001)] + [(2, 1, "i0"), (2, 2, "gone"), (2, 3, "i5"), (3, 1, "i0"), (3, 2, "odd")]
    many = spark.createDataFrame([(f"i{n}", [float(n % 10), 0.0]) for n in range(1001)] + [("odd", [1.0])], "item_id string, embedding array<double>")
    x = np.arange(1001) % 10
    far = np.abs(x[:, None] - x[None, :]).sum() / (1001 * 1000)
    got = {r.user_id: r.diversity for r in M.intra_list_diversity(_recs(spark, long_list), many, users).collect()}
    assert got == {1: pytest.approx(far), 2: pytest.approx(5.0), 3: math.inf}
    kinds = {r.user_id: r.category_diversity for r in M.category_diversity(recs, items, users).collect()}
    assert kinds[1] == pytest.approx(2 / 3)
    popular = spark.createDataFrame([("a", 0.5), ("b", 0.0)], "item_id string, popularity double")
    assert {r.user_id: r.novelty for r in M.novelty(recs, popular, users).collect()}[1] == pytest.approx(1 / 3)


def test_explanations(spark):
    items = spark.createDataFrame(
        [(1, [1.0, 0.0], "books", 0.1), (2, [1.0, 1.0], "books", 0.1), (3, [0.0, 1.0], "books", 0.9), (4, [0.0, 1.0], "books", 0.1)],
        "item_id int, embedding array<double>, category string, popularity_score double",
    )
    people = spark.createDataFrame([(1, [1.0, 0.0])], "user_id int, embedding array<double>")
    asked = spark.createDataFrame([(1, n) for n in range(1, 6)], "user_id int, item_id int")
    got = {r.item_id: r.explanation for r in recommend.explain(asked, people, items).collect()}
    assert got[1].startswith("Highly") and got[2].startswith("Recommended because") and got[3].startswith("Popular books")
    assert got[4].endswith("new books content") and got[5] == "Recommended based on general popularity"


def test_recommend_filters_after_the_cut(spark):
    m, items = vectors(spark, 40, 4, 11)
    items = items.withColumn("category", F.concat(F.lit("c"), F.col("item_id") % 3))
    u, people = vectors(spark, 3, 4, 12, "user_id")
    people = people.withColumn("interaction_count", F.lit(1).cast("long"))
    asked = spark.createDataFrame(
        [(10, 0, 4, ["c1"], None), (11, 0, 3, None, None), (12, 1, 5, None, list(range(20))), (13, 77, 5, None, None)],
        "request_id int, user_id bigint, num_recommendations int, filter_categories array<string>, exclude_items array<bigint>",
    )
    got = recommend.recommend(asked, people, items, 4, -0.5, request_id="request_id").collect()
    for rid, user, n, cats, gone in ((10, 0, 4, {1}, ()), (11, 0, 3, {0, 1, 2}, ()), (12, 1, 5, {0, 1, 2}, range(20))):
        cosine = m @ u[user] / np.linalg.norm(m, axis=1) / np.linalg.norm(u[user])
        blended = (cosine + m @ u[user]) / 2
        order = [i for i in np.argsort(-cosine)[: 2 * n] if i % 3 in cats and i not in gone and blended[i] >= -0.5][:n]
        want = sorted(order, key=lambda i: -blended[i])
        rows = sorted((r for r in got if r.request_id == rid), key=lambda r: r["rank"])
        assert [r.item_id for r in rows] == want and len(rows) > 0
        assert np.allclose([r.score for r in rows], blended[want])
    # an unknown user scores zero everywhere
    zero = [r for r in got if r.request_id == 13]
    assert len(zero) == 5 and all(r.score == 0 for r in zero)
    assert [r for r in recommend.recommend(asked, people, items, 4, 0.7, request_id="request_id").collect() if r.request_id == 13] == []
    lists = recommend.nested(recommend.recommend(asked, people, items, 4, -0.5, request_id="request_id"), "request_id")
    assert lists.filter("size(recommendations) > 5").count() == 0


def test_recommend_filters_before_the_cut(spark):
    m, items = vectors(spark, 40, 4, 11)
    items = items.withColumn("category", F.concat(F.lit("c"), F.col("item_id") % 3))
    u, people = vectors(spark, 3, 4, 12, "user_id")
    asked = [
        (10, 0, 4, ["c1"], None), (11, 0, 3, None, None), (12, 1, 5, None, list(range(20))), (13, 77, 5, ["c0", "c2"], [0, 2]),
        (14, 2, 6, ["c2", "c2", "none"], [2, 5]), (15, 2, 6, ["none"], None), (16, 2, 2, [], None),
    ]
    kind = "request_id int, user_id bigint, num_recommendations int, filter_categories array<string>, exclude_items array<bigint>"
    frame = spark.createDataFrame(asked, kind)
    for grid in ({}, {"items_per_cell": 5, "queries_per_cell": 2}):
        got = recommend.recommend_prefiltered(frame, people, items, 4, -9.0, request_id="request_id", **grid).collect()
        for rid, user, n, cats, gone in asked:
            vector = u[user] if user < 3 else np.zeros(4)
            length = np.linalg.norm(m, axis=1) * np.linalg.norm(vector)
            cosine = np.divide(m @ vector, length, out=np.zeros(40), where=length > 0)
            ok = [i for i in range(40) if (cats is None or f"c{i % 3}" in cats) and i not in (gone or ())]
            order = sorted(ok, key=lambda i: (-round(cosine[i], 9), i))[:n]
            blended = (cosine + m @ vector) / 2
            want = sorted(order, key=lambda i: (-round(blended[i], 9), order.index(i)))
            rows = sorted((r for r in got if r.request_id == rid), key=lambda r: r["rank"])
            assert [r.item_id for r in rows] == want, rid
    near = recommend.recommend(frame.filter("request_id = 11"), people, items, 4, -9.0, request_id="request_id", index=(4, 4))
    exact = recommend.recommend(frame.filter("request_id = 11"), people, items, 4, -9.0, request_id="request_id")
    assert near.collect() == exact.collect()


def test_parse_requests(spark):
    raw = spark.createDataFrame(
        [(1, None, " a, b\t,c", f"{UID}, nope , {{{UID}}}"), (2, 3, None, None)],
        "user_id int, num_recommendations int, filter_categories string, exclude_items string",
    )
    got = {r.user_id: r for r in recommend.parse_requests(raw).collect()}
    assert got[1].num_recommendations == 10 and got[1].filter_categories == ["a", "b", "c"]
    assert got[1].exclude_items == [UID, f"{{{UID}}}"]
    assert got[2].num_recommendations == 3 and got[2].filter_categories is None and got[2].exclude_items is None


def test_optimizer_first_steps(spark):
    table = spark.createDataFrame([("w", [1.0, 2.0, 3.0], [0.1, 0.2, 0.3])], "key string, params array<double>, grad array<double>")
    assert optimizers.sgd(table, 0.01).first().params == pytest.approx([0.999, 1.998, 2.997])
    assert optimizers.adam(table).first().params == pytest.approx([0.999, 1.999, 2.999], abs=1e-6)
    assert optimizers.adagrad(table).first().params == pytest.approx([0.99, 1.99, 2.99], abs=1e-6)
    assert optimizers.rmsprop(table).first().params == pytest.approx([1 - 0.001 / math.sqrt(0.1)] + [2 - 0.001 / math.sqrt(0.1), 3 - 0.001 / math.sqrt(0.1)], abs=1e-6)
    two = optimizers.adam(optimizers.adam(table))
    p, m, v = np.array([1.0, 2.0, 3.0]), 0, 0
    g = np.array([0.1, 0.2, 0.3])
    for t in (1, 2):
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - 0.001 * (m / (1 - 0.9**t)) / np.sqrt(v / (1 - 0.999**t) + 1e-8)
    assert two.first().params == pytest.approx(p.tolist()) and two.first().t == 2


def test_sgd_step_with_single_examples_is_sequential(spark):
    rng = np.random.default_rng(5)
    u, i = rng.normal(size=(4, 3)), rng.normal(size=(4, 3))
    users = spark.createDataFrame([(n, u[n].tolist()) for n in range(4)], "user_id bigint, vector array<double>")
    items = spark.createDataFrame([(n, i[n].tolist()) for n in range(4)], "item_id bigint, vector array<double>")
    examples = spark.createDataFrame([(n, n, 1.0 / (n + 1)) for n in range(3)], "user_id bigint, item_id bigint, label double")
    new_users, new_items = T.sgd_step(examples, users, items, 0.1, 0.01)
    gu = {r.user_id: r.vector for r in new_users.collect()}
    gi = {r.item_id: r.vector for r in new_items.collect()}
    for n in range(3):
        e = 1.0 / (n + 1) - u[n] @ i[n]
        assert np.allclose(gu[n], u[n] + 0.1 * (e * i[n] - 0.01 * u[n]))
        assert np.allclose(gi[n], i[n] + 0.1 * (e * u[n] - 0.01 * i[n]))
    assert np.allclose(gu[3], u[3])
    assert T.loss(examples.limit(0), users, items).first().loss == 0.0


def test_training_lowers_the_loss(spark):
    rows = [(a, b, float((a + b) % 2)) for a in range(8) for b in range(8)]
    examples = spark.createDataFrame(rows, "user_id bigint, item_id bigint, label double")
    start = T.train(examples, 4, 0)
    end = T.train(examples, 4, 4, lr=0.1)
    assert T.loss(examples, *end).first().loss < T.loss(examples, *start).first().loss


def test_negatives(spark):
    items = spark.createDataFrame([(n, [float(n)]) for n in range(64)], "item_id bigint, embedding array<double>")
    rows = [(e, e % 5, e % 7, 1.0 if e % 2 else 0.1, [0.0], [0.0], [0.0], T0) for e in range(60)]
    examples = spark.createDataFrame(
        rows,
        "event_id bigint, user_id bigint, item_id bigint, label double, user_features array<double>, "
        "item_features array<double>, context_features array<double>, ts timestamp_ntz",
    )
    seen = examples.select("user_id", "item_id")
    out = T.with_negatives(examples, items, seen, ratio=4.0)
    made = out.filter("label = 0")
    assert out.count() == 60 + 30 * 4 == 60 + made.count()
    assert made.join(seen, ["user_id", "item_id"], "left_semi").count() == 0
    assert made.filter("item_features[0] <> item_id").count() == 0
    assert T.negatives_per_positive(9.5) == 5 and T.negatives_per_positive(2.9) == 2
    assert T.negatives_per_positive(9.5, most=None) == 9
    assert T.synthetic_negatives(examples, 4, 7.0).count() == 30 * 5
    assert T.synthetic_negatives(examples, 4, 7.0, most=None).count() == 30 * 7


def test_negatives_are_complete(spark):
    """Two users who have seen most of the catalogue, one who has seen all but two, one all of it."""
    items = spark.createDataFrame([(n, [float(n)]) for n in range(160)], "item_id bigint, embedding array<double>")
    seen = [(u, (n + 10 * u) % 160) for u in (0, 1) for n in range(75)] + [(2, n) for n in range(158)] + [(3, n) for n in range(160)]
    seen += [(0, 99999), (4, None)]
    rows = [(e, e % 2, 0, 1.0) for e in range(400)] + [(400, 2, 0, 1.0), (401, 3, 0, 1.0), (402, 9, 0, 1.0), (403, 9, 0, 0.5)]
    examples = spark.createDataFrame(rows, "event_id bigint, user_id bigint, item_id bigint, label double")
    known = spark.createDataFrame(seen, "user_id bigint, item_id bigint")
    got = T.catalogue_negatives(examples, items, known).collect()
    by = {}
    for r in got:
        by.setdefault(r.event_id, []).append(r.item_id)
        assert (r.user_id, r.item_id) not in seen
    assert all(len(set(by[e])) == len(by[e]) == 4 for e in range(400))
    assert sorted(by[400]) == [158, 159] and 401 not in by and len(by[402]) == 4 and 403 not in by
    assert len(T.catalogue_negatives(examples, items, known, ratio=30.0, most=None).filter("event_id = 0").collect()) == 30
    assert T.catalogue_negatives(examples, items, known, ratio=0.0).count() == 0
    assert T.catalogue_negatives(examples, items.limit(0), known).count() == 0


def test_als_takes_any_ids(spark):
    rows = [(f"user-{a}", 5_000_000_000 + b, 1.0) for a in range(12) for b in range(9) if (a + b) % 3 == 0]
    out = T.als_recommend(spark.createDataFrame(rows, "user_id string, item_id bigint, label double"), 4, 3).collect()
    assert {r.user_id for r in out} == {r[0] for r in rows} and {r.item_id for r in out} <= {r[1] for r in rows}
    assert len(out) == 36


def test_als_blocks_follow_the_ratings(spark, monkeypatch):
    rows = [(a, b, 1.0) for a in range(12) for b in range(9) if (a + b) % 3 == 0]
    examples, blocks = spark.createDataFrame(rows + rows, "user_id bigint, item_id bigint, label double"), []

    def als(**how):
        blocks.append((how.get("numUserBlocks"), how.get("numItemBlocks")))
        return ALS(**how)

    monkeypatch.setattr(T, "ALS", als)
    T.als_factors(examples, 2, iterations=1)
    monkeypatch.setattr(T, "RATINGS_PER_BLOCK", 3)
    people, things = T.als_factors(examples, 2, iterations=1)
    assert blocks == [(10, 10), (12, 12)]
    assert (people.count(), things.count()) == (12, 9)


def test_snapshots(spark, tmp_path):
    root = str(tmp_path / "models")
    users = spark.createDataFrame([(1, [1.0])], "user_id bigint, vector array<double>")
    items = spark.createDataFrame([(2, [2.0])], "item_id bigint, vector array<double>")
    for second in (99, 100):
        rows = snapshots.snapshot_rows(f"v{second}", users, items, 1)
        snapshots.write_version(rows, root, f"v{second}")
    assert snapshots.latest_version(spark, root) == "v100"
    loaded = snapshots.load_latest(spark, root)
    assert sorted((r.side, r.id, r.vector) for r in loaded.collect()) == [
        ("bias", "", [0.0]), ("item", "2", [2.0]), ("user", "1", [1.0])
    ]
    assert quality.model_errors(loaded).collect()[0].error is None
    with pytest.raises(Exception, match="already exists"):
        snapshots.write_version(rows, root, "v100")
    # a folder without the mark of a finished write is no version, and is written anew
    (tmp_path / "models" / "version=v101").mkdir()
    assert snapshots.latest_version(spark, root) == "v100"
    snapshots.write_version(rows, root, "v101")
    assert snapshots.versions(spark, root) == ["v99", "v100", "v101"]
    assert snapshots.latest_version(spark, str(tmp_path / "none")) is None


def test_keyed_log_survives_broken_writes_and_compacts(spark, tmp_path):
    from lodestream.sources import keyed_log

    root, schema = str(tmp_path / "log"), "id bigint, v double"
    (tmp_path / "log" / "changes" / "batch=0").mkdir(parents=True)
    assert keyed_log.current(spark, root, "id", schema).count() == 0
    for n in range(6):
        keyed_log.append(spark.createDataFrame([(n % 3, float(n)), (7, float(n))], schema), root, n)
        if n % 2:
            keyed_log.compact(spark, root, "id", schema, n)

    def content(**how):
        return sorted(map(tuple, keyed_log.current(spark, root, "id", schema, **how).collect()))

    assert content() == [(0, 3.0), (1, 4.0), (2, 5.0), (7, 5.0)]
    # a repeat of the last batch still finds the state before it
    assert content(before=5) == [(0, 3.0), (1, 4.0), (2, 2.0), (7, 4.0)]
    assert content(only=spark.createDataFrame([(2,), (9,)], "id bigint")) == [(2, 5.0)]
    kept = sorted(p.name for p in (tmp_path / "log" / "changes").iterdir())
    assert kept == ["batch=4", "batch=5"]
    assert sorted(p.name for p in (tmp_path / "log" / "base").iterdir()) == ["batch=3", "batch=5"]


def test_vector_sum_with_hot_group(spark):
    rows = spark.range(0, 3000, 1, 6).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("g"), F.array(F.col("id") * 1.0, F.lit(-1.0)).alias("v")
    )
    got = {r.g: r.s for r in rows.groupBy("g").agg(V.vector_sum("v").alias("s")).collect()}
    want = {}
    for n in range(3000):
        g = 0 if n % 3 == 0 else n % 50
        a = want.setdefault(g, [0.0, 0.0])
        a[0] += n
        a[1] -= 1
    assert got.keys() == want.keys() and all(got[g] == pytest.approx(want[g]) for g in want)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_shuffles_do_not_creep_in(spark):
    """Plans without adaptive re-planning, so that exchanges can be counted."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        log = _log(spark, _busy_log(50))
        items = spark.createDataFrame([(i, [1.0]) for i in range(7)], "item_id bigint, embedding array<double>")
        assert _plan(profiles.fold(log, items)).count("Exchange hashpartitioning") <= 12
        kind = "id bigint, embedding array<double>, seq int"
        old, new = spark.createDataFrame([(1, [1.0], 0)], kind), spark.createDataFrame([(2, [3.0], 1)], kind)
        assert _plan(K.upsert(old, new, "id", ["seq"], 1)).count("Exchange hashpartitioning") == 2
        recs = _recs(spark, [(1, 1, "a")])
        relevant = spark.createDataFrame([(1, "a", 1.0)], "user_id int, item_id string, grade double")
        things = spark.createDataFrame([("a", [0.0])], "item_id string, embedding array<double>")
        popular = spark.createDataFrame([("a", 0.5)], "item_id string, popularity double")
        users = spark.createDataFrame([(1,)], "user_id int")
        plan = _plan(M.all_metrics(recs, relevant, things, popular, users, 5))
        assert plan.count("Exchange hashpartitioning") <= 13
        from lodestream.operators import online_metrics

        assert _plan(online_metrics.online_metrics(log)).count("Window ") <= 2
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
