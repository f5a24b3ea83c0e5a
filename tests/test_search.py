"""Pruned, bounded and halved searches against the full ones."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestream.functions import vectors as V
from lodestream.operators import bounded, clusters, quantized, triangle
from lodestream.operators import similarity as S
from lodestream.plans.catalog import QUERIES

KIND = "{} bigint, embedding array<double>"


def frame(spark, matrix, key="item_id", ids=None):
    ids = range(len(matrix)) if ids is None else ids
    rows = [(int(n), None if v is None else [None if x is None else float(x) for x in v]) for n, v in zip(ids, matrix)]
    return spark.createDataFrame(rows, KIND.format(key))


def rows_of(found, key):
    return sorted((r[key], r["rank"], r.item_id, f"{round(r.score, 6):.9g}", f"{round(r.dot, 6):.9g}") for r in found.collect())


def planted(seed, groups, each, dim, noise):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim))
    return np.repeat(centres, each, axis=0) + noise * rng.normal(size=(groups * each, dim))


BROKEN = [None, [], [1.0], [0.0] * 8, [float("nan")] * 8, [1.0, None] * 4, [float("inf")] * 8]


# ---- centres -----------------------------------------------------------------


def test_nearest_in_blocks(monkeypatch):
    rng = np.random.default_rng(1)
    points, centres = rng.normal(size=(300, 6)), rng.normal(size=(40, 6))
    whole = clusters.nearest(points, centres, 5)
    monkeypatch.setattr(clusters, "BLOCK", 7)
    assert (clusters.nearest(points, centres, 5) == whole).all()
    assert (clusters.nearest(points, centres)[:, 0] == whole[:, 0]).all()
    far = ((points[:, None] - centres[None]) ** 2).sum(axis=2)
    assert (np.argsort(far, axis=1)[:, :5] == whole).all()


@pytest.mark.parametrize("small", [0, 1 << 22])
def test_lloyd_equals_rounds_on_one_machine(spark, small, monkeypatch):
    """A job a round, or all rounds in one task."""
    monkeypatch.setattr(clusters, "SMALL", small)
    points = planted(2, 6, 50, 8, 0.4)
    start = points[::50].reshape(1, 6, 8).copy()
    units = frame(spark, points, "iid").withColumnRenamed("embedding", "unit").repartition(5)
    found = clusters.lloyd(units, start, rounds=3)[0]
    want = start[0].copy()
    for _ in range(3):
        home = ((points[:, None] - want[None]) ** 2).sum(axis=2).argmin(axis=1)
        want = np.array([points[home == c].mean(axis=0) if (home == c).any() else want[c] for c in range(6)])
    assert np.allclose(found, want, atol=1e-12)


@pytest.mark.parametrize("small", [0, 1 << 22])
def test_lloyd_in_parts(spark, small, monkeypatch):
    """Two halves of a vector have centres of their own."""
    monkeypatch.setattr(clusters, "SMALL", small)
    points = planted(3, 5, 40, 8, 0.3)
    start = points[::40].reshape(5, 2, 4).transpose(1, 0, 2).copy()
    units = frame(spark, points, "iid").withColumnRenamed("embedding", "unit")
    both = clusters.lloyd(units, start, rounds=2)
    for part in (0, 1):
        half = units.withColumn("unit", F.slice("unit", 1 + 4 * part, 4))
        assert np.allclose(clusters.lloyd(half, start[part : part + 1], rounds=2)[0], both[part], atol=1e-12)


# ---- pruned approximate search ---------------------------------------------------


def test_recall_on_planted_clusters(spark):
    """At least 0.95 of the exact ten while opening at most a tenth of the items."""
    points = planted(4, 60, 60, 32, 0.35)
    items = frame(spark, points).repartition(4)
    users = frame(spark, planted(4, 60, 60, 32, 0.35)[::9] + 0.05, "user_id")
    index = quantized.build(items, n_lists=90, parts=8)
    near = quantized.search(index, users, 10, n_probe=5)
    exact = S.top_k(users, items, 10)
    found, want = ({(r.user_id, r.item_id) for r in f.collect()} for f in (near, exact))
    read = quantized.share_read(index, users, 5).first()
    assert len(found & want) / len(want) >= 0.95
    assert read.n_queries == 400 and read.items_read / read.items_asked <= 0.10
    scores = {(r.user_id, r.item_id): (r.score, r.dot) for r in exact.collect()}
    assert all(np.allclose(scores[r.user_id, r.item_id], (r.score, r.dot)) for r in near.collect() if (r.user_id, r.item_id) in scores)


@pytest.mark.parametrize("cells", [{}, {"items_per_cell": 40, "queries_per_cell": 7}])
def test_all_lists_and_all_scores_are_exact(spark, cells):
    points = planted(5, 10, 30, 8, 1.0)
    items = frame(spark, [*points, *BROKEN, points[3], points[3], points[7]], ids=[*range(300), *range(300, 307), 3, 900, 12])
    users = frame(spark, [*points[:25], *BROKEN, points[3]], "user_id", [*range(25), *range(50, 57), 3])
    index = quantized.build(items, n_lists=7, parts=4)
    found = rows_of(quantized.search(index, users, 6, n_probe=7, rerank=400, **cells), "user_id")
    sound = frame(spark, [*points, points[3], points[3], points[7]], ids=[*range(300), 3, 900, 12])
    assert found == rows_of(S.top_k(frame(spark, points[:25], "user_id"), sound, 6), "user_id")


def test_self_is_left_out_and_columns_are_carried(spark):
    points = planted(6, 5, 20, 8, 0.5)
    items = frame(spark, points).withColumn("category", F.concat(F.lit("c"), F.col("item_id").cast("string")))
    index = quantized.build(items, n_lists=4, parts=2, carry=("category",))
    asked = items.select(F.col("item_id").alias("user_id"), "embedding")
    found = quantized.search(index, asked, 3, 4, rerank=100, exclude_self=True, carry=("category",)).collect()
    assert len(found) == 300 and all(r.user_id != r.item_id and r.category == f"c{r.item_id}" for r in found)


def test_index_of_nothing_and_of_few(spark):
    none = quantized.build(frame(spark, []), n_lists=4, parts=2)
    assert quantized.search(none, frame(spark, [[1.0] * 4], "user_id"), 3, 2).collect() == []
    few = quantized.build(frame(spark, [[1.0, 0, 0, 0], [0, 1.0, 0, 0]]), n_lists=8, parts=2)
    found = quantized.search(few, frame(spark, [[1.0, 0.1, 0, 0]], "user_id"), 3, 8).collect()
    assert [(r.item_id, r["rank"]) for r in sorted(found, key=lambda r: r["rank"])] == [(0, 1), (1, 2)]
    with pytest.raises(ValueError):
        quantized.build(frame(spark, [[1.0, 2.0, 3.0]]), n_lists=1, parts=2)


def test_only_opened_lists_are_read(spark):
    index = quantized.build(frame(spark, planted(7, 8, 30, 8, 0.05)), n_lists=8, parts=2)
    codes = index.codes.filter(F.col("list").isin([3, 5]))
    plan = codes._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(list, [3,5])]" in plan


def test_recall_query(spark, sf):
    row = QUERIES["ann_pq_recall"](spark, sf).first()
    assert row.n_queries > 0 and row.recall >= 0.95 and row.share_read <= 0.10


# ---- bounds on lengths -------------------------------------------------------------


@pytest.mark.parametrize("threshold", [0.3, 5.0, 1e-9, 1e300])
def test_bounded_equals_top_k(spark, threshold):
    rng = np.random.default_rng(8)
    points = rng.normal(size=(400, 8)) * np.exp(rng.normal(size=(400, 1)) * 2)
    items = frame(spark, [*points, *BROKEN, points[5], [1e200] * 8], ids=[*range(407), 5, 407])
    users = frame(spark, [*points[:60] * 3, *BROKEN, [1e200] * 8], "user_id")
    seen = spark.createDataFrame([(n, m) for n in range(40) for m in range(0, 400, 3)], "user_id bigint, item_id bigint")
    want = S.top_k(users, items, 5, "dot", seen=seen).filter(F.col("score") > threshold)
    for cells in ({}, {"items_per_cell": 30, "queries_per_cell": 9}):
        assert rows_of(bounded.above(users, items, 5, threshold, seen=seen, **cells), "user_id") == rows_of(want, "user_id")


def test_pairs_are_skipped(spark):
    lengths = [2.0**n for n in range(-10, 10)]
    items, users = frame(spark, [[x, 0.0] for x in lengths]), frame(spark, [[0.0, 1.0], [4.0, 0.0]], "user_id")
    row = bounded.compared(users, items, 1.0).first()
    assert row.pairs == 40 and row.compared == 10 + 12
    assert bounded.above(users, items, 99, 1.0).count() == 11
    with pytest.raises(ValueError):
        bounded.above(users, items, 3, 0.0)


# ---- each pair once ------------------------------------------------------------------


@pytest.mark.parametrize("metric", ["cosine", "dot"])
@pytest.mark.parametrize("block", [16384, 37])
def test_triangle_equals_full_search(spark, metric, block):
    rng = np.random.default_rng(9)
    points = np.round(rng.normal(size=(300, 6)), 1)  # with ties
    odd = rng.normal(size=(9, 3))
    data = [*points, *odd, *BROKEN, points[4], points[4], points[9]]
    items = frame(spark, data, ids=[*range(len(data) - 3), 4, 500, 11]).repartition(3)
    found = rows_of(triangle.self_top_k(items, 4, metric=metric, rows_per_block=block), "query_item_id")
    want = S.top_k(items, items, 4, metric, "item_id", exclude_self=True)
    # an id with two vectors asks twice; both searches rank each vector by itself
    assert found == rows_of(want, "query_item_id")


def test_half_the_products():
    size, blocks = 1000, 8
    area = lambda left, right, same: sum((b - a) * (d - c) for (a, b), (c, d) in triangle.strips(left, right, same))
    cells = [(i, j) for i in range(blocks) for j in range(i, blocks)]
    done = sum(area(size, size, i == j) for i, j in cells)
    assert done <= 0.57 * (size * blocks) ** 2
    # within a block, strips below the diagonal are left out
    assert area(16 * triangle.STRIP, 16 * triangle.STRIP, True) <= 0.54 * (16 * triangle.STRIP) ** 2
    assert triangle.blocks_for(10**8, 1000) == -(-(10**8) // triangle.ROWS) and triangle.blocks_for(5, 1000) == 1


def test_triangle_of_nothing(spark):
    assert triangle.self_top_k(frame(spark, []), 3).collect() == []
    assert triangle.self_top_k(frame(spark, [[1.0, 2.0]]), 3).collect() == []
    with pytest.raises(ValueError):
        triangle.self_top_k(frame(spark, []), 3, metric="l2")


def test_dot_search_reads_only_boxes_that_can_reach_the_bar(monkeypatch):
    """Clusters at the corners of a cube: exact, and few items are compared with a query."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    corners = np.array([[n >> 2 & 1, n >> 1 & 1, n & 1, 0.5, 0.5, 0.5, 0.5, 0.5] for n in range(8)]) * 2 - 1
    items = np.repeat(corners, 2560, axis=0)[:20000] * rng.uniform(0.9, 1.1, (20000, 1)) + rng.normal(0, 0.02, (20000, 8))
    asked = corners[rng.integers(0, 8, 600)] + rng.normal(0, 0.02, (600, 8))
    lists = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * 8), pa.array(m.ravel()))
    cell, met, visits = S._Cell(()), [], S._Cell._visits

    def counted(self, *how):
        for first, end, some in visits(self, *how):
            met.append((end - first) * len(some))
            yield first, end, some

    monkeypatch.setattr(S._Cell, "_visits", counted)
    cell.add(S.ITEM, pa.RecordBatch.from_arrays([pa.array(np.arange(20000)), lists(items)], names=["iid", "ivec"]))
    columns = [pa.array(np.arange(600)), lists(asked), pa.array(np.zeros(600, np.int64)), pa.array(np.full(600, 5, np.int32))]
    ((_, _, best),) = cell.best(pa.RecordBatch.from_arrays(columns, names=["qid", "qvec", "qtag", "k"]), "dot", False)
    want = np.argsort(-np.round(asked @ items.T, 9), axis=1, kind="stable")[:, :5]
    assert best.cols.reshape(600, 5).tolist() == want.tolist()
    assert sum(met) < 0.4 * 600 * 20000


def test_reranked_rows_keep_dot_products_and_carried_columns(spark):
    rng = np.random.default_rng(6)
    m = rng.normal(size=(60, 4))
    rows = spark.createDataFrame([(n, v.tolist(), f"c{n}") for n, v in enumerate(m)], "item_id long, embedding array<double>, category string")
    index = quantized.build(rows, n_lists=4, parts=2, carry=("category",))
    asked = rows.select(F.col("item_id").alias("query"), "embedding").filter("query < 5")
    found = quantized.search(index, asked, 3, 4, rerank=20, query_id="query", carry=("category",))
    assert "qvec" not in found._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]
    for r in found.collect():
        assert r.category == f"c{r.item_id}"
        assert r.dot == pytest.approx(m[r.query] @ m[r.item_id])
        assert r.score == pytest.approx(r.dot / np.linalg.norm(m[r.query]) / np.linalg.norm(m[r.item_id]))


def test_a_cell_holds_its_own_columns_only():
    """A part of a batch would hold the whole batch: here 800 kB of a query's column."""
    ids, vectors = pa.array([7, 3, 7]), pa.array([[1.0], [2.0], [3.0]])
    wide = pa.record_batch({"iid": ids, "ivec": vectors, "qid": ids, "qvec": pa.array([[0.0] * 33_000] * 3)})
    cell = S._Cell(())
    cell.add(S.ITEM, wide)
    assert cell.item_parts[0].schema.names == ["iid", "ivec"]
    assert cell.item_parts[0].column("iid").buffers()[1].address != wide.column("iid").buffers()[1].address
    cell._prepare()
    assert not cell.item_parts and cell.by_size[1].ids.to_pylist() == [3, 7, 7]
