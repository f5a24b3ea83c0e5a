"""Matrix factorisation: loss, gradient step, training loop, negative sampling."""

import math

from pyspark.ml.recommendation import ALS
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.functions import draws
from lodestream.functions import vectors as V
from lodestream.operators import grids
from lodestream.operators.keyed_tables import latest
from lodestream.operators.ordering import dense_ids, ranks_below
from lodestream.operators.similarity import top_k
from lodestream.session import cut_lineage, drop_step

LEARNING_RATE = 0.001
REGULARIZATION = 0.01
# fixed values: examples above the label limit get negatives, by default at most this many
POSITIVE_LABEL = 0.5
MAX_NEGATIVES = 5
NEGATIVE_RATIO = 4.0
#: Ratings of a block of users or items: a task of the library's fit holds them, and the factors they meet, all at once.
RATINGS_PER_BLOCK = 1 << 21
LEAST_BLOCKS = 10  # the library's own number


def factors_or_init(ids: DataFrame, factors: DataFrame, key: str, dim: int, seed=0) -> DataFrame:
    """(key, vector): the stored factor, else a Xavier uniform one drawn from the id."""
    stored = factors.select(key, V.as_double("vector").alias("vector"))
    fresh = draws.init_vector(key, "xavier_uniform", dim, seed)
    return (
        ids.select(key).distinct().join(stored, key, "left").select(key, F.coalesce("vector", fresh).alias("vector"))
    )


def _predicted(examples: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """Examples with both factors, and the factors' product as score; the factors stay out of the examples' shuffle."""
    return grids.products(examples, users, items, left_vec="vector", right_vec="vector", cosine=False, inner=True)


def loss(examples: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """(loss, n): mean squared error over examples with both factors; 0 if there are none."""
    error = F.col("label") - F.col("score")
    joined = _predicted(examples.select("user_id", "item_id", "label"), users, items)
    return joined.agg(F.coalesce(F.avg(error * error), F.lit(0.0)).alias("loss"), F.count("*").alias("n"))


def pair_totals(examples: DataFrame) -> DataFrame:
    """Labels summed by (user, item): all a gradient step needs of repeated pairs."""
    return examples.groupBy("user_id", "item_id").agg(F.sum("label").alias("label_sum"), F.count("*").alias("n"))


def residuals(totals: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """(user_id, item_id, n, err) by pair: label sum less n times the prediction."""
    err = F.col("label_sum") - F.col("n") * F.col("score")
    return _predicted(totals, users, items).select("user_id", "item_id", "n", err.alias("err"))


def gradient(residual: DataFrame, key: str, own: DataFrame, other_key: str, other: DataFrame, reg: float) -> DataFrame:
    """(key, vector, grad): ascent direction of one side from the old factors of both.

    Summed over the batch: error times the other side's factor, less reg times
    the own factor for each example. With one example per user and item this
    is the sequential rule; otherwise it is the summed-gradient step.
    """
    pull = grids.sums(residual, other, key, other_key, "err", "vector").select(key, F.col("vector").alias("pull"), "n")
    drag = V.scale("vector", F.col("n") * F.lit(-reg))
    old = own.select(key, V.as_double("vector").alias("vector"))
    return old.join(pull, key).select(key, "vector", V.add("pull", drag).alias("grad"))


def step_totals(
    totals: DataFrame, users: DataFrame, items: DataFrame, lr: float, reg: float
) -> tuple[DataFrame, DataFrame]:
    """One gradient step from pair totals.

    The residuals are written once, as narrow rows; each side then meets the
    other side's factors on a grid, so no vector is shuffled along with a pair.
    """
    narrow = cut_lineage(residuals(totals, users, items))

    def moved(key, old, graded):
        new = graded.select(key, V.add("vector", V.scale("grad", F.lit(lr))).alias("_new"))
        return old.join(new, key, "left").select(key, F.coalesce("_new", V.as_double("vector")).alias("vector"))

    return (
        moved("user_id", users, gradient(narrow, "user_id", users, "item_id", items, reg)),
        moved("item_id", items, gradient(narrow, "item_id", items, "user_id", users, reg)),
    )


def sgd_step(
    examples: DataFrame, users: DataFrame, items: DataFrame, lr: float = LEARNING_RATE, reg: float = REGULARIZATION
) -> tuple[DataFrame, DataFrame]:
    """New (user_id, vector) and (item_id, vector); ids without examples keep their factor."""
    return step_totals(pair_totals(examples), users, items, lr, reg)


def train(
    examples: DataFrame,
    dim: int,
    epochs: int,
    users: DataFrame | None = None,
    items: DataFrame | None = None,
    lr: float = LEARNING_RATE,
    reg: float = REGULARIZATION,
    seed=0,
) -> tuple[DataFrame, DataFrame]:
    """epochs gradient steps; factors missing at the start are drawn by id.

    Pair totals are written once and factors after each step, so the plan
    stays one step long; a step's files go when the next one's are there.
    """
    spark = examples.sparkSession
    kind = examples.schema

    def start(key, factors):
        if factors is None:
            factors = spark.createDataFrame([], f"{key} {kind[key].dataType.simpleString()}, vector array<double>")
        wanted = examples.select(key).union(factors.select(key))
        return cut_lineage(factors_or_init(wanted, factors, key, dim, seed))

    u, i = start("user_id", users), start("item_id", items)
    totals = cut_lineage(pair_totals(examples))
    for _ in range(epochs):
        new_u, new_i = step_totals(totals, u, i, lr, reg)
        new_u, new_i = cut_lineage(new_u), cut_lineage(new_i)
        drop_step(u, i)
        u, i = new_u, new_i
    return u, i


def als_recommend(examples: DataFrame, dim: int, k: int, reg: float = 0.1, iterations: int = 5, seed: int = 7):
    """Top k items per user from implicit-feedback alternating least squares, whatever the ids are.

    The library wants small whole numbers, so ids are numbered densely and
    joined back. Repeated pairs are summed first, so a user's block holds each
    item once. Ranking reuses the exact search kernel.
    """
    people, things = als_factors(examples, dim, reg, iterations, seed)
    return top_k(people, things, k, "dot")


def als_factors(examples: DataFrame, dim: int, reg: float = 0.1, iterations: int = 5, seed: int = 7):
    """(user_id, embedding) and (item_id, embedding) fitted to the summed labels.

    The fit holds a block of users or items in a task, so their number follows
    the ratings, which are written and counted first; only the count reaches the
    driver. Up to LEAST_BLOCKS full blocks the library's own number stays. One
    user's or item's ratings are never split.
    """
    totals = examples.groupBy("user_id", "item_id").agg(F.sum("label").cast("float").alias("rating"))
    numbers = {side: cut_lineage(dense_ids(examples, f"{side}_id", name=side)) for side in ("user", "item")}
    ratings = totals.join(numbers["user"], "user_id").join(numbers["item"], "item_id")
    ratings = cut_lineage(ratings.select(F.col("user").cast("int"), F.col("item").cast("int"), "rating"))
    blocks = max(LEAST_BLOCKS, math.ceil(ratings.count() / RATINGS_PER_BLOCK))
    model = ALS(
        rank=dim,
        maxIter=iterations,
        regParam=reg,
        numUserBlocks=blocks,
        numItemBlocks=blocks,
        implicitPrefs=True,
        userCol="user",
        itemCol="item",
        ratingCol="rating",
        seed=seed,
    ).fit(ratings)

    def named(factors, side):
        known = factors.select(F.col("id").cast("long").alias(side), F.col("features").alias("embedding"))
        return cut_lineage(known.join(numbers[side], side).select(f"{side}_id", "embedding"))

    found = named(model.userFactors, "user"), named(model.itemFactors, "item")
    drop_step(ratings, *numbers.values())
    return found


def negatives_per_positive(ratio: float, most: int | None = MAX_NEGATIVES) -> int:
    return int(ratio) if most is None else min(int(ratio), most)


def synthetic_negatives(
    examples: DataFrame, dim: int, ratio: float = NEGATIVE_RATIO, key: str = "event_id", seed=0, most: int | None = MAX_NEGATIVES
):
    """Phantom negatives: an item id outside the catalogue and a Xavier uniform vector for it.

    Ids and vectors are drawn from (key, draw number), not from a clock or a
    process-wide generator. Returns only the negatives, with the columns of
    examples; item_id becomes a string.
    """
    n = negatives_per_positive(ratio, most)
    drawn = F.explode(F.sequence(F.lit(1), F.lit(n))) if n > 0 else F.explode(F.array().cast("array<int>"))
    rows = examples.filter(F.col("label") > POSITIVE_LABEL).select("*", drawn.alias("_draw"))
    name = F.concat_ws(":", F.col(key).cast("string"), F.col("_draw").cast("string"), F.lit(f"item{seed}"))
    replaced = {
        "item_id": F.md5(name),
        "label": F.lit(0.0),
        "item_features": draws.init_vector(F.md5(name), "xavier_uniform", dim, seed),
    }
    return rows.select(*[replaced.get(c, F.col(c)).alias(c) for c in examples.columns])


def catalogue_negatives(
    examples: DataFrame,
    items: DataFrame,
    seen: DataFrame,
    ratio: float = NEGATIVE_RATIO,
    key: str = "event_id",
    seed=0,
    most: int | None = MAX_NEGATIVES,
) -> DataFrame:
    """(key, user_id, item_id, draw): items the user has not acted on, for each positive example.

    Every positive gets min(n, unseen items) different ones, n being the ratio
    cut to most (None: not cut). Catalogue items are numbered in hash order;
    a positive draws a place among its user's unseen items from its key and
    takes n from there on, round the end. The item at the j-th unseen place has
    number j plus the seen items before it, which are counted from the user's
    seen numbers slice by slice. So work and memory follow the seen pairs and the draws,
    and a hot user is spread over slices. Only the catalogue's row count
    reaches the driver.
    """
    n = negatives_per_positive(ratio, most)
    numbers = cut_lineage(dense_ids(items, "item_id", seed=seed))
    size = numbers.count()
    known = seen.select("user_id", "item_id").distinct().join(numbers, "item_id").select("user_id", F.col("idx").alias("at"))
    known = cut_lineage(known)
    # numbers of seen items become places among the unseen: less the seen ones before
    marks = ranks_below(known, known, "user_id", "at", "rank").select(
        "user_id", (F.col("at") - F.col("rank") + 1).alias("at")
    )
    unseen = cut_lineage(known.groupBy("user_id").agg((F.lit(size) - F.count("*")).alias("_unseen")))
    start = F.conv(F.substring(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(f"pick{seed}"))), 1, 15), 16, 10)
    wanted = (
        examples.filter(F.col("label") > POSITIVE_LABEL)
        .select(key, "user_id")
        .join(unseen, "user_id", "left")
        .withColumn("_unseen", F.coalesce("_unseen", F.lit(size)))
        .filter(F.col("_unseen") > 0)
        .withColumn("draw", F.explode(F.sequence(F.lit(1), F.least(F.lit(n).cast("long"), F.col("_unseen")))) if n > 0 else F.lit(1))
        .filter(F.lit(n > 0))
        .withColumn("at", (start.cast("bigint") + F.col("draw") - 1) % F.col("_unseen"))
    )
    wanted = cut_lineage(wanted.select(key, "user_id", F.col("draw").cast("int").alias("draw"), "at"))
    places = ranks_below(wanted.select("user_id", "at").distinct(), marks, "user_id", "at", "below")
    places = cut_lineage(places.select("user_id", "at", (F.col("at") + F.col("below")).alias("idx")))
    return wanted.join(places, ["user_id", "at"]).join(numbers, "idx").select(key, "user_id", "item_id", "draw")


def with_negatives(examples: DataFrame, items: DataFrame, seen: DataFrame, key: str = "event_id", **how) -> DataFrame:
    """examples and their catalogue negatives: label 0, same user, context and time.

    key identifies an example. Replaces phantom items, which would end up in the item table.
    """
    chosen = catalogue_negatives(examples, items, seen, key=key, **how)
    features = items.select("item_id", V.as_double("embedding").alias("item_features"))
    base = examples.drop("item_id", "item_features", "label")
    made = (
        chosen.drop("user_id", "draw")
        .join(base, key)
        .join(features, "item_id")
        .withColumn("label", F.lit(0.0))
        .select(examples.columns)
    )
    return examples.unionByName(made)


def latest_features(examples: DataFrame, key: str, features: str, order: list[str]) -> DataFrame:
    """(key, vector): the features of each id's last example in the batch."""
    rows = examples.select(key, F.col(features).alias("vector"), *order)
    return latest(rows, key, order).select(key, "vector")


def stats(users: DataFrame, items: DataFrame, archive: DataFrame, snapshot: DataFrame) -> DataFrame:
    """(stat, value): embedding counts, archived examples and the last snapshot's time in epoch seconds."""

    def line(name, frame, value):
        return frame.agg(F.coalesce(value, F.lit(0)).cast("bigint").alias("value")).select(F.lit(name).alias("stat"), "value")

    # fixed values: the names of the counters
    return (
        line("user_embeddings_count", users, F.count_distinct("user_id"))
        .unionByName(line("item_embeddings_count", items, F.count_distinct("item_id")))
        .unionByName(line("training_buffer_size", archive, F.count("*")))
        .unionByName(line("last_model_save", snapshot, F.max(F.substring("version", 2, 20).cast("bigint"))))
    )
