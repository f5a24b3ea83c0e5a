import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestream.llm import embedding_pairs as E


def plain(rows, threshold=0.93):
    """[(links, component, kept)] in row order, comparing all pairs."""
    ok = [
        label is not None and vec and all(x is not None and math.isfinite(x) for x in vec) and any(vec)
        for _, vec, label in rows
    ]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if o else None for (_, v, _), o in zip(rows, ok)]
    n = len(rows)
    top, links = list(range(n)), [0] * n

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(n):
        for j in range(i + 1, n):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                links[i] += 1
                links[j] += 1
                top[find(j)] = find(i)
    least = {}
    for i in range(n):
        if rows[i][0] is not None:
            least[find(i)] = min(least.get(find(i), rows[i][0]), rows[i][0])
    return [(links[i], least.get(find(i)), rows[i][0] is not None and rows[i][0] == least.get(find(i))) for i in range(n)]


def frame(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    for name in ("node", "id", "bucket", "weight", "n_links", "component_id"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def f32(v):
    return [float(np.float32(x)) for x in v]


def cloud(rng, dim, labels):
    rows = []
    for c in range(30):
        centre = np.array([rng.gauss(0, 1) for _ in range(dim)])
        for _ in range(rng.randrange(1, 9)):
            v = centre + 0.16 * np.array([rng.gauss(0, 1) for _ in range(dim)]) * rng.random() * 2
            rows.append((len(rows), f32(v * rng.choice([1, 1, 3])), rng.choice(labels)))
    return rows


@pytest.mark.parametrize("block", [512, 3])
def test_equals_all_pairs(spark, block):
    rng = random.Random(block)
    rows = cloud(rng, 64, [0, 1]) + cloud(rng, 24, [1])
    rows = [(k, v, l) for k, (_, v, l) in enumerate(rows)]
    for _ in range(40):  # copies of one vector
        rows.append((len(rows), rows[5][1], rows[5][2]))
    centre = np.array([rng.gauss(0, 1) for _ in range(64)])
    for _ in range(30):  # near copies that all link
        rows.append((len(rows), f32(centre + 0.05 * np.array([rng.gauss(0, 1) for _ in range(64)])), 0))
    rows += [
        (9001, None, 1), (9002, [0.0] * 64, 1), (9003, [None] + [1.0] * 63, 1), (9004, [float("nan")] + [1.0] * 63, 1),
        (9005, [float("inf")] + [1.0] * 63, 1), (9006, rows[0][1], None), (9007, [], 1), (None, rows[0][1], rows[0][2]),
        (9008, [3.0], 1), (9009, [2.0], 1), (9010, [-2.0], 1), (9010, [-2.0], 1), (9011, [3e38] * 8, 1), (9012, [1e-38] * 8, 1),
    ]
    rng.shuffle(rows)
    got = sorted(map(repr, [tuple(r) for r in E.near_vectors(frame(spark, rows), block=block).collect()]))
    want = sorted(map(repr, [(r[0], *p) for r, p in zip(rows, plain(rows))]))
    assert got == want


def test_recall_at_the_threshold():
    """Pairs at cosine 0.93 exactly meet in a bucket with the production parameters."""
    rng = np.random.default_rng(7)
    a = rng.normal(size=(4000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    g = rng.normal(size=a.shape)
    g -= (g * a).sum(1, keepdims=True) * a
    g /= np.linalg.norm(g, axis=1, keepdims=True)
    b = 0.93 * a + math.sqrt(1 - 0.93**2) * g
    ka, kb = E.bucket_keys(a), E.bucket_keys(b)
    assert (ka[:, :, :, None] == kb[:, :, None, :]).any((1, 2, 3)).mean() > 0.9995


@pytest.mark.parametrize("n", [2, 4, 8, 64, 128])
def test_transform_equals_butterflies(n):
    x = np.random.default_rng(n).normal(size=(5, n))
    y, half = x.copy(), 1
    while half < n:
        for start in range(0, n, 2 * half):
            a, b = y[:, start : start + half].copy(), y[:, start + half : start + 2 * half].copy()
            y[:, start : start + half], y[:, start + half : start + 2 * half] = a + b, a - b
        half *= 2
    assert np.allclose(E._hadamard(x), y / math.sqrt(n))


def test_empty(spark):
    assert E.near_vectors(frame(spark, [])).count() == 0
    only = E.near_vectors(frame(spark, [(1, None, 1)])).collect()
    assert [tuple(r) for r in only] == [(1, 0, 1, True)]


def test_query_on_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = {r.vec_id: tuple(r)[1:] for r in E.op1_embedding_pairs(spark, sf).collect()}
    assert got == {r[0]: p for r, p in zip(rows, plain(rows))}


@pytest.mark.parametrize("kind", ["string", "double"])
def test_labels_of_any_kind(spark, kind):
    rng = random.Random(8)
    names = ["a", "b", None] if kind == "string" else [1.2, 1.7, None]
    rows = cloud(rng, 16, names)
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<float>, label {kind}")
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in E.near_vectors(df).collect()}
    assert found == {r[0]: p for r, p in zip(rows, plain(rows))}
    assert any(n for n, _, _ in found.values())
