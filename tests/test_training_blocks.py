"""Sequential steps in strata, and optimizers with sparse state, against plain loops."""

import numpy as np
import pytest

from lodestream.operators import rotation as B


def blocks_of(spark, ids, key, blocks):
    frame = spark.createDataFrame([(int(n),) for n in ids], f"{key} bigint")
    return {r[0]: r[1] for r in frame.select(key, B.block_of(key, blocks)).collect()}


@pytest.fixture(scope="module")
def ratings():
    rng = np.random.default_rng(1)
    rows = [(int(u), int(i), float(y), n) for n, (u, i, y) in enumerate(zip(rng.integers(0, 40, 900), rng.integers(0, 25, 900), rng.random(900)))]
    hot = [(3, int(i), 0.5, 900 + n) for n, i in enumerate(rng.integers(0, 25, 400))]  # a third of all examples
    return rows + hot + [(3, 4, 0.5, 5000), (3, 4, 0.5, 5000)]


@pytest.mark.parametrize("blocks", [1, 3, 7])
def test_equals_a_sequential_run_in_stratum_order(spark, ratings, blocks):
    rng = np.random.default_rng(2)
    users, items = ({n: rng.normal(size=6) * 0.3 for n in range(k)} for k in (42, 27))  # two of each without examples
    frames = [
        spark.createDataFrame([(n, v.tolist()) for n, v in t.items()], f"{key} bigint, vector array<double>").repartition(3)
        for t, key in ((users, "user_id"), (items, "item_id"))
    ]
    extra = [(99, 1, 1.0, 1), (1, 99, 1.0, 1), (None, 1, 1.0, 1), (1, None, 1.0, 1), (1, 1, None, 1)]
    examples = spark.createDataFrame(ratings + extra, "user_id bigint, item_id bigint, label double, n bigint").repartition(5)
    got = B.train_sequential(examples, *frames, "n", epochs=2, blocks=blocks, lr=0.05, reg=0.02)
    ub, ib = blocks_of(spark, users, "user_id", blocks), blocks_of(spark, items, "item_id", blocks)
    for _ in range(2):
        for stratum in range(blocks):
            for b in range(blocks):
                own = [r for r in ratings if ub[r[0]] == b and ib[r[1]] == (b + stratum) % blocks]
                for u, i, y, _ in sorted(own, key=lambda r: (r[3], r[0], r[1], r[2])):
                    x, z = users[u], items[i]
                    e = y - x @ z
                    users[u], items[i] = x + 0.05 * (e * z - 0.02 * x), z + 0.05 * (e * x - 0.02 * z)
    for frame, want in zip(got, (users, items)):
        found = {r[0]: r[1] for r in frame.collect()}
        assert found.keys() == want.keys()
        assert all(np.allclose(found[k], want[k], atol=1e-12) for k in want)


def test_loss_falls_and_empty_input_is_kept(spark, ratings):
    from lodestream.operators.training import loss

    examples = spark.createDataFrame(ratings, "user_id bigint, item_id bigint, label double, n bigint")
    before = loss(examples, *B.fit_sequential(examples, 8, "n", epochs=0, seed=1)).first().loss
    after = loss(examples, *B.fit_sequential(examples, 8, "n", epochs=3, seed=1, lr=0.05, rows_per_block=10)).first().loss
    assert after < 0.8 * before
    users, items = B.fit_sequential(examples.limit(0), 8, "n")
    assert users.count() == items.count() == 0


# ---- optimizers with sparse state ---------------------------------------------


def dense_rules(optimizer, lr, reg, examples, users, items, steps):
    """Every row moves at every step, by the definitions."""
    tables = [{k: {"p": v.copy(), "a": np.zeros(v.size), "b": np.zeros(v.size)} for k, v in t.items()} for t in (users, items)]
    for n in range(1, steps + 1):
        grads = [{k: np.zeros(r["p"].size) for k, r in t.items()} for t in tables]
        for u, i, y, step in examples:
            if step == n:
                x, z = tables[0][u]["p"], tables[1][i]["p"]
                e = y - x @ z
                grads[0][u] -= e * z - reg * x
                grads[1][i] -= e * x - reg * z
        for table, grad in zip(tables, grads):
            for k, r in table.items():
                g = grad[k]
                if optimizer == "adam":
                    r["a"], r["b"] = 0.9 * r["a"] + 0.1 * g, 0.999 * r["b"] + 0.001 * g * g
                    r["p"] = r["p"] - lr * (r["a"] / (1 - 0.9**n)) / np.sqrt(r["b"] / (1 - 0.999**n) + 1e-8)
                elif optimizer == "rmsprop":
                    r["b"] = 0.9 * r["b"] + 0.1 * g * g
                    r["p"] = r["p"] - lr * g / np.sqrt(r["b"] + 1e-8)
                elif optimizer == "adagrad":
                    r["b"] = r["b"] + g * g
                    r["p"] = r["p"] - lr * g / np.sqrt(r["b"] + 1e-8)
                else:
                    r["p"] = r["p"] - lr * g
    return tables


@pytest.mark.parametrize("optimizer", ["sgd", "adam", "adagrad", "rmsprop"])
def test_sparse_steps_equal_the_dense_rule(spark, tmp_path, optimizer):
    from lodestream.operators import sparse_steps as O
    from lodestream.operators import training as T

    rng = np.random.default_rng(5)
    # ids are rare, so that most rows miss most steps, some all but one
    rows = [(int(u), int(i), float(y), int(n)) for u, i, y, n in zip(rng.integers(0, 25, 60), rng.integers(0, 18, 60), rng.random(60), rng.integers(1, 7, 60))]
    rows += [rows[0], rows[0]]
    extra = [(None, 1, 1.0, 1), (1, None, 1.0, 2), (1, 1, None, 3)]
    examples = spark.createDataFrame(rows + extra, "user_id bigint, item_id bigint, label double, n bigint")
    got = O.fit(examples, "n", 7, 5, optimizer, 0.02, seed=3, root=str(tmp_path), lr=0.05)  # no example has step 7
    starts = []
    for key in ("user_id", "item_id"):
        none = spark.createDataFrame([], f"{key} bigint, vector array<double>")
        ids = examples.filter("user_id IS NOT NULL AND item_id IS NOT NULL AND label IS NOT NULL")
        starts.append({r[0]: np.array(r[1]) for r in T.factors_or_init(ids, none, key, 5, 3).collect()})
    for frame, table in zip(got, dense_rules(optimizer, 0.05, 0.02, rows, *starts, 7)):
        found = frame.collect()
        assert len(found) == len(table)
        for r in found:
            assert r.t == 7 and np.allclose(r.vector, table[r[0]]["p"], atol=1e-12)
            for name in O.STATE[optimizer]:
                assert np.allclose(r[name], table[r[0]]["a" if name == "m" else "b"], atol=1e-12)


def test_long_absence_is_bounded(spark):
    """A million missed Adam steps: the sum stops where the moment has faded."""
    from lodestream.operators import sparse_steps as O

    row = spark.createDataFrame([(1, [1.0, -2.0], 4, [0.3, -0.1], [0.02, 0.0])], "id int, vector array<double>, t int, m array<double>, v array<double>")
    r = O.caught_up(row, "adam", 1_000_000, lr=0.01).first()
    p, m, v = np.array([1.0, -2.0]), np.array([0.3, -0.1]), np.array([0.02, 0.0])
    for n in range(5, 3000):
        m, v = 0.9 * m, 0.999 * v
        p = p - 0.01 * (m / (1 - 0.9**n)) / np.sqrt(v / (1 - 0.999**n) + 1e-8)
    assert r.t == 1_000_000 and np.allclose(r.vector, p, atol=1e-12) and np.allclose(r.m, 0, atol=1e-300)


# ---- orthogonal rows ---------------------------------------------------------------


def test_orthonormal_columns(spark):
    from lodestream.operators import orthogonal as Q

    rng = np.random.default_rng(6)
    data = rng.normal(size=(700, 9)) * 10.0 ** rng.integers(-3, 4, 9)
    rows = [(n, v.tolist()) for n, v in enumerate(data)] + [(900, None), (901, [1.0]), (902, [float("nan")] * 9), (903, [1.0, None] + [0.0] * 7)]
    frame = spark.createDataFrame(rows, "id bigint, vector array<double>")
    found = []
    for parts in (1, 7, 70):  # 70 triangles make two levels
        out = {r.id: r.vector for r in Q.orthonormal(frame.repartition(parts), 9).collect()}
        assert sorted(out) == list(range(700))
        found.append(np.array([out[n] for n in range(700)]))
        assert np.allclose(found[-1].T @ found[-1], np.eye(9), atol=1e-9)
    assert np.allclose(found[0], found[1], atol=1e-9) and np.allclose(found[0], found[2], atol=1e-9)
    # the same span: projecting the data on it changes nothing
    assert np.allclose(found[0] @ (found[0].T @ data), data, rtol=1e-8, atol=1e-8)


def test_fewer_or_dependent_rows(spark):
    from lodestream.operators import orthogonal as Q

    frame = lambda m: spark.createDataFrame([(n, [float(x) for x in v]) for n, v in enumerate(m)], "id bigint, vector array<double>")
    rng = np.random.default_rng(7)
    few = rng.normal(size=(3, 5))
    got = np.array([r.vector for r in Q.orthonormal(frame(few), 5).orderBy("id").collect()])
    assert np.allclose(got.T @ got, np.diag([1, 1, 1, 0, 0]), atol=1e-9)
    twice = np.repeat(rng.normal(size=(40, 2)), 2, axis=1)
    got = np.array([r.vector for r in Q.orthonormal(frame(twice), 4).orderBy("id").collect()])
    assert np.allclose(got.T @ got, np.diag([1, 0, 1, 0]), atol=1e-9)
    assert Q.orthonormal(frame([]), 4).collect() == []
    assert [r.vector for r in Q.orthonormal(frame([[0.0] * 3]), 3).collect()] == [[0.0] * 3]


def test_init_orthogonal_is_seeded(spark):
    from lodestream.operators import orthogonal as Q

    ids = spark.range(200).withColumnRenamed("id", "item_id")
    one, two, other = ({r.item_id: r.vector for r in Q.init_orthogonal(ids.repartition(p), "item_id", 8, s).collect()} for p, s in ((2, 1), (9, 1), (2, 2)))
    assert all(np.allclose(one[k], two[k], atol=1e-9) for k in one) and not np.allclose(one[5], other[5])
