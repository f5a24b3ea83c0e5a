"""Recommendation queries, answered for a whole frame of requests at once."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestream.functions import text as X
from lodestream.functions import vectors as V
from lodestream.operators import grids
from lodestream.operators.actions import action_weight
from lodestream.operators.similarity import search, similar, top_k, top_k_in_lists
from lodestream.session import cut_lineage

DEFAULT_COUNT = 10
SIMILARITY_THRESHOLD = 0.7

# fixed values: the explanation texts
HIGHLY = "Highly recommended based on your preferences in %s category"
ALIKE = "Recommended because you like similar %s items"
POPULAR = "Popular %s item that might interest you"
DISCOVER = "Recommended to help you discover new %s content"
GENERAL = "Recommended based on general popularity"


def parse_requests(raw: DataFrame) -> DataFrame:
    """Query-string fields to typed requests.

    filter_categories and exclude_items are comma lists; items that are not
    UUIDs are dropped, a missing list stays null, the count defaults to ten.
    """
    names = F.transform(F.split("filter_categories", ","), X.trim)
    ids = F.filter(F.transform(F.split("exclude_items", ","), X.trim), X.is_uuid)
    return (
        raw.withColumn("filter_categories", names)
        .withColumn("exclude_items", ids)
        .withColumn("num_recommendations", F.coalesce("num_recommendations", F.lit(DEFAULT_COUNT)).cast("int"))
    )


def recommend(
    requests: DataFrame,
    profiles: DataFrame,
    items: DataFrame,
    dim: int,
    threshold: float = SIMILARITY_THRESHOLD,
    request_id: str = "user_id",
    index: tuple[int, int] | None = None,
    **grid,
) -> DataFrame:
    """(request id, user_id, rank, item_id, score, reason, category).

    Candidates are the 2N items of highest cosine over all items. In that
    order, excluded items and other categories are skipped, the score is the
    mean of cosine and dot product, scores under the threshold are dropped and
    the first N kept; these are ranked by score. The filters come after the
    2N cut, so a request can return fewer than N. An unknown user has a zero
    profile and thus only zero scores. Each distinct user is searched once, to
    the depth of the deepest of the user's requests; index (lists, probes) makes
    that search approximate. Requests are ranked under their own id, so a user
    with many of them is spread.
    """
    asked = requests.groupBy("user_id").agg((F.max("num_recommendations") * 2).alias("depth"))
    asked = cut_lineage(asked)
    vectors = asked.join(profiles.select("user_id", "embedding"), "user_id", "left").select(
        "user_id", "depth", F.coalesce(V.as_double("embedding"), V.zeros(dim)).alias("embedding")
    )
    found = search(
        vectors, items, F.col("depth"), index, query_rows=asked.count(), carry=("category",), **grid
    ).withColumnRenamed("rank", "place")
    wanted = _wanted(requests, request_id)
    return _answers(found.join(wanted, "user_id"), threshold, request_id)


def recommend_prefiltered(
    requests: DataFrame,
    profiles: DataFrame,
    items: DataFrame,
    dim: int,
    threshold: float = SIMILARITY_THRESHOLD,
    request_id: str = "user_id",
    **grid,
) -> DataFrame:
    """The same answers with the filters before the 2N cut.

    Candidates are the 2N items of highest cosine among those of the asked
    categories that are not excluded, so a request gets N answers wherever N
    eligible items reach the threshold. Request ids must be unique.
    """
    wanted = cut_lineage(_wanted(requests, request_id))
    vectors = wanted.join(profiles.select("user_id", "embedding"), "user_id", "left").select(
        request_id,
        (F.col("num_recommendations") * 2).alias("depth"),
        "filter_categories",
        F.coalesce(V.as_double("embedding"), V.zeros(dim)).alias("embedding"),
    )
    gone = wanted.select(request_id, F.explode("exclude_items").alias("item_id"))
    found = top_k_in_lists(
        vectors, items, F.col("depth"), "filter_categories", "category", query_id=request_id, seen=gone, carry=("category",), **grid
    ).withColumnRenamed("rank", "place")
    return _answers(found.join(wanted, request_id), threshold, request_id)


def _wanted(requests: DataFrame, request_id: str) -> DataFrame:
    return requests.select(
        *dict.fromkeys([request_id, "user_id"]), "num_recommendations", "filter_categories", "exclude_items"
    )


def _answers(candidates: DataFrame, threshold: float, request_id: str) -> DataFrame:
    """Ranked answers from each request's candidates with its wishes: filters, blended score, threshold, first N."""
    kept = (
        candidates.filter(F.col("place") <= F.col("num_recommendations") * 2)
        .filter(F.col("exclude_items").isNull() | ~F.array_contains("exclude_items", F.col("item_id")))
        .filter(F.col("filter_categories").isNull() | F.array_contains("filter_categories", F.col("category")))
        .withColumn("score", (F.col("score") + F.col("dot")) / 2)
        .filter(F.col("score") >= threshold)
    )
    keys = list(dict.fromkeys(["user_id", request_id]))
    if request_id != "user_id":
        kept = kept.repartition(*keys)
    first = Window.partitionBy(*keys).orderBy("place")
    best = Window.partitionBy(*keys).orderBy(F.round("score", 9).desc(), "place")
    return (
        kept.withColumn("turn", F.row_number().over(first))
        .filter(F.col("turn") <= F.col("num_recommendations"))
        .withColumn("rank", F.row_number().over(best))
        .select(*keys, "rank", "item_id", "score", X.reason(F.col("score")).alias("reason"), "category")
    )


def nested(recommended: DataFrame, request_id: str = "user_id") -> DataFrame:
    """One row per request with its ranked list; at most N entries by construction."""
    entry = F.struct("rank", "item_id", "score", "reason", "category")
    return recommended.groupBy(request_id).agg(F.array_sort(F.collect_list(entry)).alias("recommendations"))


def unseen(
    profiles: DataFrame, items: DataFrame, actions: DataFrame, k: int = 5, threshold: float = 0.3, **grid
) -> DataFrame:
    """Best k items by dot product that the user never acted on, above the threshold."""
    acted = actions.select("user_id", "item_id")
    found = top_k(profiles.select("user_id", "embedding"), items, k, "dot", seen=acted, **grid).drop("dot")
    return found.filter(F.col("score") > threshold)


def predict_pairs(pairs: DataFrame, profiles: DataFrame, items: DataFrame) -> DataFrame:
    """Cosine of each (user, item) pair; 0 if either row is missing."""
    known = cut_lineage(profiles.select("user_id", "embedding"))
    return grids.products(pairs, known, items).withColumn("score", F.coalesce("score", F.lit(0.0)))


def explain(recommended: DataFrame, profiles: DataFrame, items: DataFrame) -> DataFrame:
    """recommended with an explanation text per row."""
    u = profiles.select("user_id", F.col("embedding").alias("_u"))
    i = items.select(
        "item_id",
        F.col("embedding").alias("_i"),
        F.col("category").alias("_category"),
        F.col("popularity_score").alias("_popularity"),
    )
    alike = F.round(V.cosine("_u", "_i"), 9)
    category = F.col("_category")
    text = (
        F.when(F.col("_u").isNull() | F.col("_i").isNull(), F.lit(GENERAL))
        .when(F.col("_alike") > 0.8, F.format_string(HIGHLY, category))
        .when(F.col("_alike") > 0.6, F.format_string(ALIKE, category))
        .when(F.col("_popularity") > 0.8, F.format_string(POPULAR, category))
        .otherwise(F.format_string(DISCOVER, category))
    )
    joined = recommended.join(u, "user_id", "left").join(i, "item_id", "left").withColumn("_alike", alike)
    return joined.select(*[F.col(c) for c in recommended.columns], text.alias("explanation"))


def trending(
    actions: DataFrame, items: DataFrame, as_of, k: int, rate: float = 0.01, category: str | None = None
) -> DataFrame:
    """(rank, item_id, score, reason, category): most acted-on items, actions fading with age.

    Replaces fabricated trending rows with the sum of action weights decayed
    by the hour. The per-item sums are map-side combined; only k rows are
    ranked globally.
    """
    weight = action_weight(F.col("action_type")) * X.decay_weight(F.col("ts"), as_of, rate)
    heat = actions.groupBy("item_id").agg(F.sum(weight).alias("score"))
    named = heat.join(items.select("item_id", "category"), "item_id")
    if category is not None:
        named = named.filter(F.col("category") == category)
    # orderBy + limit keeps k rows per task; only those k are numbered
    top = named.orderBy(F.round("score", 9).desc(), "item_id").limit(k)
    place = F.row_number().over(Window.orderBy(F.round("score", 9).desc(), "item_id"))
    return top.select(place.alias("rank"), "item_id", "score", F.lit(X.TRENDING_REASON).alias("reason"), "category")


def personalized_trending(
    users: DataFrame, profiles: DataFrame, items: DataFrame, actions: DataFrame, as_of, k: int, rate: float = 0.01, **grid
) -> DataFrame:
    """Closest k items of each user with a profile; the trending list for the others."""
    # read for their number and for the search
    known = cut_lineage(users.select("user_id").distinct().join(profiles.select("user_id", "embedding"), "user_id"))
    close = top_k(known, items, k, "cosine", carry=("category",), **grid)
    personal = close.select(
        "user_id", "rank", "item_id", "score", X.reason(F.col("score"), X.TRENDING_FORMAT).alias("reason"), "category"
    )
    new = users.select("user_id").distinct().join(profiles.select("user_id"), "user_id", "left_anti")
    # the list has k rows: each is joined to every new user through its rank
    slots = new.select("user_id", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("rank"))
    general = slots.join(trending(actions, items, as_of, k, rate), "rank")
    return personal.unionByName(general.select(personal.columns))


def similar_users(profiles: DataFrame, users: DataFrame, k: int, **grid) -> DataFrame:
    return similar(profiles, users, k, "user_id", **grid)


def similar_items(items: DataFrame, keys: DataFrame, k: int, **grid) -> DataFrame:
    return similar(items, keys, k, "item_id", **grid)
