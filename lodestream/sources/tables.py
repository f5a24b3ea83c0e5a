"""The parquet tables seen as the recommender's records.

Each function reads only the columns it needs. Vectors here have DIM elements.
"""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.functions import draws, text
from lodestream.functions import vectors as V
from lodestream.operators import profiles as P
from lodestream.operators.actions import action_weight, training_examples

DIM = 64
AS_OF = "2024-01-31 00:00:00"
MID = "2024-01-16 00:00:00"
THRESHOLD = 0.2

# how logged events name the action variants; an "error" event is none of them
EVENT_ACTIONS = {"view": "View", "click": "Click", "purchase": "Purchase", "signup": "Convert"}


def as_of(at: str = AS_OF):
    return F.lit(at).cast("timestamp_ntz")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def _item_id():
    return F.get_json_object("props", "$.k").cast("bigint").alias("item_id")


def events(spark, sf) -> DataFrame:
    """All events; an event type that is no action keeps its own name."""
    kind = F.col("event_type")
    named = reduce(lambda c, pair: c.when(kind == pair[0], pair[1]), EVENT_ACTIONS.items(), F)
    return table(spark, sf, "events").select(
        "event_id", "user_id", _item_id(), named.otherwise(kind).alias("action_type"), "ts"
    )


def actions(spark, sf) -> DataFrame:
    kind = F.col("event_type")
    named = reduce(lambda c, pair: c.when(kind == pair[0], pair[1]), EVENT_ACTIONS.items(), F)
    return (
        table(spark, sf, "events")
        .filter(kind.isin(list(EVENT_ACTIONS)))
        .select("event_id", "user_id", _item_id(), named.alias("action_type"), "ts")
    )


def items(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("item_id"), "embedding", F.concat(F.lit("c"), F.col("label").cast("string")).alias("category")
    )


def clustered_items(spark, sf, n: int = 25) -> DataFrame:
    """Items gathered around n of them: twice the direction of the item of the same remainder, plus the own direction."""
    own = items(spark, sf).withColumn("group", F.col("item_id") % n)
    centres = own.filter(F.col("item_id") < n).select("group", V.normalize("embedding").alias("centre"))
    moved = F.zip_with("centre", V.normalize("embedding"), lambda c, x: 2 * c + x)
    return own.join(centres, "group").select("item_id", moved.alias("embedding"), "category")


def popularity(spark, sf) -> DataFrame:
    """(item_id, popularity): actions on the item over those on the most acted-on item."""
    counts = actions(spark, sf).groupBy("item_id").agg(F.count("*").alias("n"))
    most = counts.agg(F.max("n")).scalar()
    ids = table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"))
    return ids.join(counts, "item_id", "left").select(
        "item_id", (F.coalesce("n", F.lit(0)) / most.cast("double")).alias("popularity")
    )


def item_features(spark, sf) -> DataFrame:
    popular = popularity(spark, sf).withColumnRenamed("popularity", "popularity_score")
    return items(spark, sf).join(popular, "item_id")


def profiles(spark, sf, acted: DataFrame | None = None) -> DataFrame:
    return P.fold(actions(spark, sf) if acted is None else acted, items(spark, sf))


def users(spark, sf) -> DataFrame:
    """Everyone who appears in the log, acted or not."""
    return table(spark, sf, "events").select("user_id").distinct()


def requests(spark, sf) -> DataFrame:
    """One request per user: every third filters by category, every fifth excludes items."""
    by_user = F.col("user_id")
    return users(spark, sf).select(
        "user_id",
        F.lit(10).alias("num_recommendations"),
        F.when(by_user % 3 == 0, F.array(*[F.lit(f"c{n}") for n in (1, 3, 5, 7, 8)])).alias("filter_categories"),
        F.when(by_user % 5 == 0, F.sequence(F.lit(0).cast("bigint"), F.lit(49).cast("bigint"))).alias("exclude_items"),
    )


def relevant(spark, sf) -> DataFrame:
    """(user_id, item_id, grade) of items bought or converted on; the grade is the largest action weight."""
    return (
        actions(spark, sf)
        .filter(F.col("action_type").isin("Purchase", "Convert"))
        .groupBy("user_id", "item_id")
        .agg(F.max(action_weight(F.col("action_type"))).alias("grade"))
    )


def graded(spark, sf) -> DataFrame:
    """(user_id, item_id, grade) over all actions, so that grades differ."""
    return (
        actions(spark, sf)
        .groupBy("user_id", "item_id")
        .agg(F.max(action_weight(F.col("action_type"))).alias("grade"))
    )


def request_log(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select(
        (F.col("event_type") == "error").alias("failed"), F.floor("value").cast("bigint").alias("latency_ms")
    )


def examples(spark, sf) -> DataFrame:
    """(event_id, user_id, item_id, label, ts) of actions on known items."""
    counted = P.applied(actions(spark, sf), items(spark, sf))
    return counted.select("event_id", "user_id", "item_id", F.col("weight").alias("label"), "ts")


def interactions(spark, sf) -> DataFrame:
    """(user_id, item_id, label): customers and the parts they ordered, by quantity; ids beyond 32 bits."""
    orders = table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") + 5_000_000_000).alias("user_id"))
    lines = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"),
        (F.col("l_partkey") + 5_000_000_000).alias("item_id"),
        (F.col("l_quantity") / 50).alias("label"),
    )
    return lines.join(orders, "o_orderkey").drop("o_orderkey")


def full_examples(spark, sf) -> DataFrame:
    return training_examples(actions(spark, sf), items(spark, sf), profiles(spark, sf), DIM)


def user_factors(spark, sf) -> DataFrame:
    return users(spark, sf).select("user_id", draws.init_vector("user_id", "xavier_uniform", DIM).alias("vector"))


def item_factors(spark, sf) -> DataFrame:
    return items(spark, sf).select("item_id", V.as_double("embedding").alias("vector"))


def damaged_vectors(spark, sf) -> DataFrame:
    """Embeddings with faults by label: empty, NaN, infinite, too long, and null or with a null by id; the id of vector 0 is nil."""
    v, label, turn = V.as_double("embedding"), F.col("label"), F.col("vec_id") % 25
    faulty = (
        F.when(turn == 7, F.lit(None).cast("array<double>"))
        .when(turn == 8, F.concat(v, F.array(F.lit(None).cast("double"))))
        .when(label == 1, F.array().cast("array<double>"))
        .when(label == 2, F.concat(v, F.array(F.lit(float("nan")))))
        .when(label == 3, F.concat(F.array(F.lit(float("-inf"))), v))
        .when(label == 4, F.flatten(F.array_repeat(v, 33)))
        .otherwise(v)
    )
    return table(spark, sf, "embeddings").select(
        "vec_id", F.nullif("vec_id", F.lit(0).cast("bigint")).alias("id"), faulty.alias("vector"), "label"
    )


def damaged_names(column):
    """Category names with faults: empty for label 5, over a hundred bytes (not characters) for label 6."""
    return (
        F.when(F.col("label") == 5, F.lit(""))
        .when(F.col("label") == 6, F.repeat(F.lit("é"), 51))
        .otherwise(column)
    )


def surrogate(column):
    return text.surrogate_id(F.col(column).cast("string"))
