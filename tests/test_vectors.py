"""Vector, text and draw functions on literal rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestream.functions import batches, draws, text, weighted
from lodestream.functions import vectors as V


def one(spark, expression, **columns):
    """Value of an expression over one row of literal columns."""
    row = spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, list) else F.array(*[F.lit(x) for x in v]).cast("array<double>").alias(k) for k, v in columns.items()])
    return row.select(expression.alias("v")).first()[0]


@pytest.mark.parametrize(
    "measure, a, b, expected",
    [
        (V.cosine, [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], 0.0),
        (V.cosine, [1.0, 1.0], [1.0, 1.0], 1.0),
        (V.cosine, [0.0, 0.0], [1.0, 1.0], 0.0),
        (V.cosine, [1.0], [1.0, 1.0], 0.0),
        (V.euclidean, [0.0, 0.0], [3.0, 4.0], 5.0),
        (V.euclidean, [0.0], [3.0, 4.0], math.inf),
        (V.manhattan, [0.0, 0.0], [3.0, -4.0], 7.0),
        (V.manhattan, [0.0], [3.0, -4.0], math.inf),
        (V.dot, [1.0, 2.0], [3.0, 4.0], 11.0),
    ],
)
def test_measures(spark, measure, a, b, expected):
    assert one(spark, measure("a", "b"), a=a, b=b) == pytest.approx(expected)


def test_normalize(spark):
    assert one(spark, V.normalize("a"), a=[3.0, 4.0]) == pytest.approx([0.6, 0.8])
    assert one(spark, V.normalize("a"), a=[0.0, 0.0]) == [0.0, 0.0]


def test_top_indices(spark):
    assert one(spark, V.top_indices("a", 2), a=[-4.0, 2.5, 7.25, 0.0, 6.0, 1.5]) == [2, 4]
    assert one(spark, V.top_indices("a", 3), a=[0.5, 0.9, 0.5]) == [1, 0, 2]


def test_activations(spark):
    assert one(spark, V.sigmoid(F.col("x")), x=0.0) == 0.5
    assert one(spark, V.relu(F.col("x")), x=-2.0) == 0.0
    assert one(spark, V.relu(F.col("x")), x=float("nan")) == 0.0


def test_softmax(spark):
    got = one(spark, V.softmax("a"), a=[1000.0, 1000.0, 999.0])
    assert sum(got) == pytest.approx(1.0) and got[0] == got[1] > got[2]
    assert one(spark, V.softmax("a"), a=[]) == []


def test_weighted_average(spark):
    rows = spark.createDataFrame(
        [(1, [1.0, 0.0], 0.5), (1, [0.0, 1.0], 0.5), (1, [9.0], 5.0), (2, [1.0, 2.0], -1.0)],
        "g int, v array<double>, w double",
    )
    got = {r.g: r.vector for r in weighted.weighted_average(rows, "g", "v", "w", 2).collect()}
    assert got == {1: pytest.approx([0.5, 0.5]), 2: pytest.approx([-1.0, -2.0])}


def test_sanitize_and_ids(spark):
    assert one(spark, text.sanitize(F.col("s"), 14), s="Tea & cake, 2 cups; <b>now</b>") == "Tea  cake, 2 c"
    assert one(spark, text.is_uuid(F.col("s")), s="0f8b2c61-7d3e-4a90-9c15-2e6ab47d01f3")
    assert not one(spark, text.is_uuid(F.col("s")), s="0f8b2c61-7d3e-4a90-9c15")
    made = one(spark, text.surrogate_id(F.col("s")), s="someone")
    assert one(spark, text.is_uuid(F.col("s")), s=made) and made.replace("-", "")[:16] == made.replace("-", "")[16:]
    assert one(spark, text.reason(F.col("x")), x=0.71249) == "Similar to your preferences (score: 0.712)"


def test_init_bounds_and_seed(spark):
    ids = spark.range(40)
    first = ids.select("id", draws.init_vector("id", "xavier_uniform", 100).alias("v")).collect()
    again = ids.repartition(3).select("id", draws.init_vector("id", "xavier_uniform", 100).alias("v")).collect()
    assert {r.id: r.v for r in first} == {r.id: r.v for r in again}
    values = np.array([r.v for r in first])
    assert np.abs(values).max() <= math.sqrt(6 / 100) and len(np.unique(values)) > 3900
    spread = np.array([r.v for r in ids.select(draws.init_vector("id", "lecun_normal", 100).alias("v")).collect()])
    assert spread.std() == pytest.approx(0.1, rel=0.05) and abs(spread.mean()) < 0.01
    sparse = np.array([r.v for r in ids.select(draws.init_vector("id", "sparse", 100, sparsity=0.7).alias("v")).collect()])
    assert (sparse == 0).mean() == pytest.approx(0.7, abs=0.03)


def test_score_batches_sizes(spark):
    import pandas as pd

    rows = spark.range(0, 25, 1, 1)
    sizes = batches.score_batches(rows, lambda c: pd.DataFrame({"n": [len(c)]}), "n int", 10)
    assert [r.n for r in sizes.collect()] == [10, 10, 5]


def test_clock_ignores_the_session_zone(spark):
    import datetime as dt

    from lodestream.functions import clock

    zone = spark.conf.get("spark.sql.session.timeZone")
    times = [dt.datetime(2024, 3, 10, 1, 59, 59, 5), dt.datetime(2024, 3, 10, 2, 30), dt.datetime(2024, 3, 10, 3, 30), dt.datetime(1969, 12, 31, 23, 59, 59, 999999)]
    rows = spark.createDataFrame([(t,) for t in times], "ts timestamp_ntz")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        got = [r[0] for r in rows.select(clock.epoch_micros("ts")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert got == [(t - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1) for t in times]
