"""Exact inner-product search above a threshold, skipping items that are too short.

No dot product exceeds the product of the lengths (Cauchy-Schwarz). Items are
kept by levels of length, PER_OCTAVE to each doubling; a query is sent only to
the levels whose longest vectors could reach the threshold with it. Items of
other levels are never compared with it, nor sent where it is.
"""

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestream.functions import vectors as V
from lodestream.operators import similarity as S

PER_OCTAVE = 8
#: Level of vectors whose length is beyond a double.
TOP = 1 << 14
SLACK = 1e-6


def _level(length) -> F.Column:
    """Level of a length: below 2^((level + 1) / PER_OCTAVE)."""
    return F.when(length == math.inf, TOP).otherwise(F.floor(F.log2(length) * PER_OCTAVE)).cast("long")


def _least(length, threshold: float) -> F.Column:
    """The lowest level that a query of this length can reach the threshold in."""
    needed = F.lit(threshold) / length
    return F.coalesce(F.ceil(F.log2(needed) * PER_OCTAVE - 1 - SLACK), F.lit(-TOP)).cast("long")


def _sides(queries, items, threshold, query_id, query_vec, item_id, item_vec, k, carry):
    if not threshold > 0:
        raise ValueError("lengths bound positive products only: the threshold must be above zero")
    q, i = S._inputs(queries, items, query_id, query_vec, item_id, item_vec, k, carry)
    long = V.norm("qvec")
    asked = q.withColumn("_n", long).filter("_n > 0").withColumn("least", _least(F.col("_n"), threshold)).drop("_n")
    stored = i.withColumn("_n", V.norm("ivec")).filter("_n > 0").withColumn("list", _level(F.col("_n"))).drop("_n")
    return asked, stored


def above(
    queries: DataFrame,
    items: DataFrame,
    k,
    threshold: float,
    query_id: str = "user_id",
    query_vec: str = "embedding",
    item_id: str = "item_id",
    item_vec: str = "embedding",
    seen: DataFrame | None = None,
    carry: tuple[str, ...] = (),
    items_per_cell: int = S.ITEMS_PER_CELL,
    queries_per_cell: int = S.QUERIES_PER_BUCKET,
) -> DataFrame:
    """The best k items per query with a dot product above the threshold: (query id, item id, score, dot, rank, carried).

    The rows of similarity.top_k by dot product that exceed the threshold, which
    must be positive; seen leaves pairs out. Ties and vectors that take no part
    are as there. The levels in use reach the driver: at most PER_OCTAVE for each
    binary exponent of a double.
    """
    asked, stored = _sides(queries, items, threshold, query_id, query_vec, item_id, item_vec, k, carry)
    levels = sorted(r[0] for r in stored.select("list").distinct().collect())
    open_to = F.filter(F.array(*[F.lit(x) for x in levels]).cast("array<bigint>"), lambda x: x >= F.col("least"))
    asked = asked.select("qid", "qvec", "k", "qtag", F.explode(open_to).alias("list"))
    pairs = None if seen is None else seen.select(F.col(query_id).alias("qid"), F.col(item_id).alias("iid"))
    found = S._in_lists(stored, asked, "dot", False, carry, items_per_cell, queries_per_cell, pairs)
    depth = k if isinstance(k, int) else F.col("depth")
    best = S._merge(found.filter(F.col("score") > threshold)).filter(F.col("rank") <= depth)
    return S._renamed(best, query_id, item_id, carry)


def compared(
    queries: DataFrame, items: DataFrame, threshold: float, query_id: str = "user_id", query_vec: str = "embedding",
    item_id: str = "item_id", item_vec: str = "embedding",
) -> DataFrame:
    """(pairs, compared): pairs of sound vectors, zero ones left out, and those that the search compares."""
    asked, stored = _sides(queries, items, threshold, query_id, query_vec, item_id, item_vec, 1, ())
    none = F.lit(0).cast("long")
    sizes = stored.groupBy("list").agg(F.count("*").alias("n_items")).withColumn("n_queries", none)
    wishes = asked.groupBy(F.col("least").alias("list")).agg(F.count("*").alias("n_queries")).withColumn("n_items", none)
    # one row for each level: a running sum from the highest
    down = Window.orderBy(F.desc("list")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    reached = sizes.unionByName(wishes).withColumn("reached", F.sum("n_items").over(down))
    return reached.agg(
        (F.sum("n_queries") * F.sum("n_items")).alias("pairs"), F.sum(F.col("n_queries") * F.col("reached")).alias("compared")
    )
