"""Products and sums over grids against plain loops, on rows that repeat, are null or unknown; and the plans that stay narrow."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from lodestream import schemas
from lodestream.operators import grids
from lodestream.operators import recommend as R
from lodestream.operators import similarity as S
from lodestream.sources import topics

VEC = "embedding array<double>"
LEFT = [(1, [1.0, 2.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 2.0, 3.0]), (5, [1.0, None]), (None, [1.0, 1.0])]
RIGHT = [(10, [3.0, 4.0]), (10, [1.0, 0.0]), (11, None), (12, [1.0, 1.0, 1.0]), (None, [1.0, 1.0])]
PAIRS = [(u, i) for u in (1, 2, 3, 4, 5, 6, None) for i in (10, 11, 12, 13, None)]


def _cosine(a, b):
    if a is None or b is None:
        return None
    if len(a) != len(b) or None in a or None in b:
        return 0.0
    below = math.hypot(*a) * math.hypot(*b)
    return sum(x * y for x, y in zip(a, b)) / below if below else 0.0


@pytest.mark.parametrize("rows", [1, 2, 65536])
def test_products_mean_a_left_join(spark, rows):
    left = spark.createDataFrame(LEFT, f"user_id bigint, {VEC}")
    right = spark.createDataFrame(RIGHT, f"item_id bigint, {VEC}")
    pairs = spark.createDataFrame(PAIRS, "user_id bigint, item_id bigint")
    wanted = []
    for u, i in PAIRS:
        for a in [v for k, v in LEFT if k == u and u is not None] or [None]:
            for b in [v for k, v in RIGHT if k == i and i is not None] or [None]:
                wanted.append((u, i, _cosine(a, b)))
    got = grids.products(pairs, left, right, rows=rows).collect()
    key = lambda t: (t[0], t[1], str(t[2]))
    assert sorted(plain_rows(got), key=key) == sorted(plain_rows(wanted), key=key)


def plain_rows(found):
    return [(str(u), str(i), None if s is None else round(s, 12)) for u, i, s in found]


@pytest.mark.parametrize("rows", [1, 3, 65536])
def test_sums_mean_a_join_and_an_aggregate(spark, rows):
    vectors = [(n, [float(n), 1.0 / (n + 1)]) for n in range(7)] + [(3, [0.5, 0.5]), (8, None), (None, [9.0, 9.0])]
    pairs = [(u, (u * k) % 9, 0.1 * k, k, 100 * u + k) for u in range(5) for k in range(1, 6)] + [(None, 2, 1.0, 1, 7)]
    wanted = {}
    for u, i, w, n, t in pairs:
        for key, v in vectors:
            if key == i and v is not None:
                x, m, last = wanted.get(u, ([0.0, 0.0], 0, 0))
                wanted[u] = ([a + w * b for a, b in zip(x, v)], m + n, max(last, t))
    frame = spark.createDataFrame(pairs, "u bigint, i bigint, w double, n bigint, t bigint")
    out = grids.sums(frame, spark.createDataFrame(vectors, f"i bigint, {VEC}"), "u", "i", "w", "embedding", latest="t", rows=rows)
    got = {r.u: (r.vector, r.n, r.latest) for r in out.collect()}
    assert got.keys() == wanted.keys()
    for u, (x, n, t) in wanted.items():
        assert got[u][0] == pytest.approx(x) and got[u][1:] == (n, t)


def test_pairs_are_shuffled_without_vectors(spark, capsys):
    """No vector is joined to a pair on its way through a shuffle."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        items = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], f"item_id bigint, {VEC}")
        people = spark.createDataFrame([(1, [1.0, 0.0])], f"user_id bigint, {VEC}")
        pairs = spark.createDataFrame([(1, 1), (1, 2)], "user_id bigint, item_id bigint")
        R.predict_pairs(pairs, people, items).explain()
        plan = capsys.readouterr().out
        assert "Join" not in plan
        assert R.predict_pairs(pairs, people, items).filter(F.col("score") == 1.0).count() == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_inner_dot_keeps_pairs_with_null_vectors(spark):
    left = spark.createDataFrame(LEFT, f"user_id bigint, {VEC}")
    right = spark.createDataFrame(RIGHT, f"item_id bigint, {VEC}")
    pairs = spark.createDataFrame(PAIRS, "user_id bigint, item_id bigint")
    got = plain_rows(grids.products(pairs, left, right, cosine=False, inner=True).collect())
    wanted = []
    for u, i in PAIRS:
        for a in [v for k, v in LEFT if k == u and u is not None]:
            for b in [v for k, v in RIGHT if k == i and i is not None]:
                whole = a is not None and b is not None and len(a) == len(b) and None not in a + b
                wanted.append((u, i, sum(x * y for x, y in zip(a, b)) if whole else None))
    key = lambda t: (t[0], t[1], str(t[2]))
    assert sorted(got, key=key) == sorted(plain_rows(wanted), key=key)


def test_what_a_search_sends_grows_with_its_rows():
    """Copies an item and a query make do not multiply from 12,000 to 120,000 rows, nor with the shuffle partitions."""
    def copies(n, slots):
        items, queries = S._grid(n, n, -(-n // S.ITEMS_PER_CELL), slots, 5)
        return items + queries

    assert copies(120_000, 100) <= 2 * copies(12_000, 100)
    assert copies(720_000, 600) <= 2 * copies(120_000, 100)
    assert copies(720_000, 600) == copies(720_000, 2000)


@pytest.mark.parametrize("metric", ["dot", "cosine", "l2"])
def test_bars_carried_over_blocks_lose_nothing(spark, metric, monkeypatch):
    """Items in many blocks, lengths far apart, ties across blocks: the order of a plain sort."""
    rng = np.random.default_rng(5)
    items = rng.integers(-2, 3, (300, 3)).astype(float) * rng.choice([0.25, 1.0, 4.0], (300, 1))
    asked = rng.integers(-2, 3, (20, 3)).astype(float)
    monkeypatch.setattr(S, "ITEM_BLOCK", 16)
    kept = S._Items(pa.array(np.arange(300)), items, [])
    cell = S._Cell(())
    cell.by_size = {3: kept}
    lists = pa.ListArray.from_arrays(np.arange(0, 61, 3, dtype=np.int32), asked.ravel())
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(20)), lists, pa.array([7] * 20, pa.int32())], names=["qid", "qvec", "k"])
    [(_, _, best)] = list(cell.best(batch, metric, False))
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1), 1e-300)[:, None]
    score = {"dot": asked @ items.T, "cosine": unit(asked) @ unit(items).T, "l2": -((asked[:, None] - items[None]) ** 2).sum(2)}[metric]
    for q in range(20):
        order = np.lexsort((np.arange(300), -np.round(score[q], 9)))[:7]
        assert best.cols[best.rows == q].tolist() == order.tolist()


def test_a_record_is_parsed_once(spark):
    """Conditions on a record do not make and parse it again."""
    raw = spark.range(3).select("id", F.to_json(F.struct("id", F.array(F.lit(0.5)).alias("vector"), F.lit("x").alias("metadata"))).alias("value"))
    good, _ = topics.decode(raw, schemas.feature_vector(LongType()))
    assert good._jdf.queryExecution().executedPlan().toString().count("from_json") == 1


def test_short_vectors_share_a_lane(spark, monkeypatch):
    short = spark.createDataFrame([(n, [1.0, float(n)]) for n in range(90)], f"user_id bigint, {VEC}")
    items = short.withColumnRenamed("user_id", "item_id").filter("item_id < 40")
    pairs = spark.createDataFrame([(n, n % 40) for n in range(90)], "user_id bigint, item_id bigint")
    monkeypatch.setattr(grids, "ROWS", 10)
    monkeypatch.setattr(grids, "VALUES", 60)
    assert grids._least_lanes(short, "embedding", None, 2) == 3
    monkeypatch.setattr(grids, "SHORT_ROWS", 20)
    assert grids._least_lanes(short, "embedding", None, 2) == 5
    assert grids._least_lanes(short, "embedding", 10, 2) == 9
    assert grids._least_lanes(short.withColumn("embedding", F.lit(None).cast("array<double>")), "embedding", None, 2) == 5
    got = grids.products(pairs, short, items, cosine=False, inner=True).collect()
    assert sorted(map(tuple, got)) == [(n, n % 40, 1.0 + n * (n % 40)) for n in range(90)]


def test_vectors_give_up_their_parts():
    parts = [pa.record_batch({"id": pa.array([5, 2]), "_x": pa.array([[1.0], [None]])}), pa.record_batch({"id": pa.array([5]), "_x": pa.array([[3.0]])})]
    held = grids._Vectors(parts, "id")
    assert parts == [] and held.names.to_pylist() == [2, 5] and held.code.tolist() == [0, 1, 1] and held.whole.tolist() == [False, True, True]
    rows, places = held.places(pa.array([9, 5, 2]))
    assert rows.tolist() == [1, 1, 2] and places.tolist() == [1, 2, 0]
    rows, places = held.places(pa.array([9, 5, None]))
    assert rows.tolist() == [1, 1] and places.tolist() == [1, 2]
