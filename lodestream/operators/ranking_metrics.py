"""Offline ranking quality of recommended lists.

recs is (user_id, rank, item_id); relevant is (user_id, item_id[, grade]),
unique by pair; users lists who is evaluated. Everything joins on (user, item)
or aggregates by user, so one user's many relevant items stay spread out.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestream.functions import vectors as V
from lodestream.functions.batches import complete_groups, group_bounds
from lodestream.session import cut_lineage

# items of a list that one task compares with as many others
LIST_BLOCK = 512


def _hits(recs: DataFrame, relevant: DataFrame) -> DataFrame:
    marks = relevant.select("user_id", "item_id", F.lit(1).alias("hit"))
    return recs.join(marks, ["user_id", "item_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))


def _ratio(top, bottom):
    return F.coalesce(top / F.nullif(bottom.cast("double"), F.lit(0.0)), F.lit(0.0))


def f1(precision, recall):
    return _ratio(2.0 * precision * recall, precision + recall)


def precision_recall(recs: DataFrame, relevant: DataFrame, users: DataFrame, k: int) -> DataFrame:
    """(user_id, precision, recall, f1): hits in the first k over min(k, list length) and over all relevant."""
    found = (
        _hits(recs, relevant)
        .groupBy("user_id")
        .agg(F.count_if((F.col("rank") <= k) & (F.col("hit") == 1)).alias("hits"), F.count("*").alias("listed"))
    )
    owned = relevant.groupBy("user_id").agg(F.count("*").alias("owned"))
    joined = users.select("user_id").join(found, "user_id", "left").join(owned, "user_id", "left").fillna(0)
    precision = _ratio(F.col("hits"), F.least(F.col("listed"), F.lit(k)))
    recall = _ratio(F.col("hits"), F.col("owned"))
    return joined.select("user_id", precision.alias("precision"), recall.alias("recall")).withColumn(
        "f1", f1(F.col("precision"), F.col("recall"))
    )


def ndcg(recs: DataFrame, relevant: DataFrame, users: DataFrame, k: int) -> DataFrame:
    """(user_id, ndcg) with discount log2(position + 1).

    Discounting by log2(position) divides by zero at the first place; the
    usual shift is used instead. The ideal order is over all of the user's grades.
    """

    def gain(grade, place):
        return F.sum(grade / F.log2(place + 1))

    graded = recs.filter(F.col("rank") <= k).join(
        relevant.select("user_id", "item_id", "grade"), ["user_id", "item_id"]
    )
    got = graded.groupBy("user_id").agg(gain(F.col("grade"), F.col("rank")).alias("dcg"))
    by_grade = Window.partitionBy("user_id").orderBy(F.col("grade").desc(), "item_id")
    ideal = (
        relevant.withColumn("place", F.row_number().over(by_grade))
        .filter(F.col("place") <= k)
        .groupBy("user_id")
        .agg(gain(F.col("grade"), F.col("place")).alias("idcg"))
    )
    joined = users.select("user_id").join(got, "user_id", "left").join(ideal, "user_id", "left").fillna(0.0)
    return joined.select("user_id", _ratio(F.col("dcg"), F.col("idcg")).alias("ndcg"))


def average_precision(recs: DataFrame, relevant: DataFrame, users: DataFrame, k: int) -> DataFrame:
    """(user_id, ap): precision at each hit in the first k, over the number of relevant items."""
    first = _hits(recs.filter(F.col("rank") <= k), relevant)
    so_far = Window.partitionBy("user_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    gained = (
        first.withColumn("seen", F.sum("hit").over(so_far))
        .groupBy("user_id")
        .agg(F.sum(F.col("hit") * F.col("seen") / F.col("rank")).alias("gained"))
    )
    owned = relevant.groupBy("user_id").agg(F.count("*").alias("owned"))
    joined = users.select("user_id").join(gained, "user_id", "left").join(owned, "user_id", "left").fillna(0)
    return joined.select("user_id", _ratio(F.col("gained"), F.col("owned")).alias("ap"))


def mean_average_precision(recs: DataFrame, relevant: DataFrame, users: DataFrame, k: int) -> DataFrame:
    """(map): mean over all users, those without a hit counting as zero; 0 for no users."""
    return average_precision(recs, relevant, users, k).agg(F.coalesce(F.avg("ap"), F.lit(0.0)).alias("map"))


def coverage(recs: DataFrame, items: DataFrame) -> DataFrame:
    """(coverage): share of all items that were recommended to anyone."""
    shown = recs.select("item_id").distinct().withColumn("shown", F.lit(1))
    joined = items.select("item_id").join(shown, "item_id", "left")
    return joined.agg(_ratio(F.count("shown"), F.count("*")).alias("coverage"))


def _distance_sums(batches):
    """(user_id, total, n): summed distances of the pairs that meet in a cell, and the items counted there."""
    for table in complete_groups(batches, "user_id", "low", "high"):
        users = table.column("user_id").combine_chunks()
        low, high, block = (table.column(c).to_numpy() for c in ("low", "high", "block"))
        cut = group_bounds(pc.dictionary_encode(users).indices.to_numpy(), low, high)
        lists = table.column("x").combine_chunks()
        at, flat = lists.offsets.to_numpy(), lists.flatten().to_numpy()
        base = at[0]
        rows, totals, counts = [], [], []
        for start, stop in zip(cut, cut[1:]):
            sizes = np.diff(at[start : stop + 1])
            own = block[start:stop]
            rows.append(start)
            counts.append(int(stop - start) if low[start] == high[start] else 0)
            one = own == low[start]
            if (sizes != sizes[0]).any():
                pairs = stop - start > 1 if low[start] == high[start] else one.any() and (~one).any()
                totals.append(np.inf if pairs else 0.0)
                continue
            x = flat[at[start] - base : at[stop] - base].reshape(stop - start, -1)
            if low[start] == high[start]:
                apart = sum(np.sqrt(((x[n + 1 :] - x[n]) ** 2).sum(axis=1)).sum() for n in range(len(x) - 1))
            else:
                apart = sum(np.sqrt(((x[~one] - v) ** 2).sum(axis=1)).sum() for v in x[one])
            totals.append(float(apart))
        yield pa.RecordBatch.from_arrays(
            [users.take(pa.array(rows)), pa.array(totals, pa.float64()), pa.array(counts, pa.int64())],
            names=["user_id", "total", "n"],
        )


def intra_list_diversity(recs: DataFrame, items: DataFrame, users: DataFrame) -> DataFrame:
    """(user_id, diversity): mean euclidean distance between the items of a list; infinite if sizes differ.

    A list of any length is cut into blocks, and each pair of blocks is compared
    in a cell of its own; a cell lets out one sum, so no pair becomes a row.
    """
    listed = recs.join(items.select("item_id", V.as_double("embedding").alias("x")), "item_id").filter("x IS NOT NULL")
    blocks = recs.groupBy("user_id").agg(F.ceil(F.max("rank") / LIST_BLOCK).cast("int").alias("blocks"))
    block = F.floor((F.col("rank") - 1) / LIST_BLOCK).cast("int")
    cells = (
        listed.select("user_id", "x", block.alias("block"))
        .join(blocks, "user_id")
        .select("user_id", "x", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("_other"))
        .select("user_id", "x", "block", F.least("block", "_other").alias("low"), F.greatest("block", "_other").alias("high"))
        .repartition("user_id", "low", "high")
        .sortWithinPartitions("user_id", "low", "high")
    )
    kind = recs.schema["user_id"].dataType.simpleString()
    sums = cells.mapInArrow(_distance_sums, f"user_id {kind}, total double, n long")
    whole = sums.groupBy("user_id").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    mean = F.when(F.col("n") >= 2, F.col("total") / (F.col("n") * (F.col("n") - 1) / 2)).otherwise(F.lit(0.0))
    return users.select("user_id").join(whole.select("user_id", mean.alias("diversity")), "user_id", "left").fillna(0.0)


def category_diversity(recs: DataFrame, items: DataFrame, users: DataFrame) -> DataFrame:
    """(user_id, category_diversity): distinct categories over items with a known one; 0 for one item or none."""
    joined = recs.join(items.select("item_id", "category"), "item_id", "left")
    scored = joined.groupBy("user_id").agg(
        F.count("*").alias("n"), F.count_distinct("category").alias("kinds"), F.count("category").alias("known")
    )
    value = F.when(F.col("n") <= 1, F.lit(0.0)).otherwise(_ratio(F.col("kinds"), F.col("known")))
    return (
        users.select("user_id")
        .join(scored.select("user_id", value.alias("category_diversity")), "user_id", "left")
        .fillna(0.0)
    )


def novelty(recs: DataFrame, popularity: DataFrame, users: DataFrame) -> DataFrame:
    """(user_id, novelty): mean of -log2(popularity); an unknown or non-positive one adds 0 but counts."""
    joined = recs.join(popularity.select("item_id", "popularity"), "item_id", "left")
    bits = F.when(F.col("popularity") > 0, -F.log2("popularity")).otherwise(F.lit(0.0))
    scored = joined.groupBy("user_id").agg(F.avg(bits).alias("novelty"))
    return users.select("user_id").join(scored, "user_id", "left").fillna(0.0)


def all_metrics(recs: DataFrame, relevant: DataFrame, items: DataFrame, popularity: DataFrame, users: DataFrame, k: int):
    """One row: per-user metrics averaged over users, and catalogue coverage.

    The lists are joined once to their grades and popularities and written; one
    aggregate by user then gives every sum over a list, one over relevant gives
    the ideal ones. Only diversity, which needs the vectors, goes its own way.
    """
    marks = relevant.select("user_id", "item_id", F.col("grade").cast("double").alias("grade"))
    known = recs.join(marks, ["user_id", "item_id"], "left").join(popularity.select("item_id", "popularity"), "item_id", "left")
    listed = cut_lineage(known.select("user_id", "rank", "item_id", "grade", "popularity"))
    hit = F.col("grade").isNotNull() & (F.col("rank") <= k)
    so_far = Window.partitionBy("user_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = listed.withColumn("hit", hit.cast("int")).withColumn("seen", F.sum("hit").over(so_far))
    bits = F.when(F.col("popularity") > 0, -F.log2("popularity")).otherwise(F.lit(0.0))
    by_list = found.groupBy("user_id").agg(
        F.sum("hit").alias("hits"),
        F.count("*").alias("listed"),
        F.sum(F.when(hit, F.col("grade") / F.log2(F.col("rank") + 1))).alias("dcg"),
        F.sum(F.when(hit, F.col("seen") / F.col("rank"))).alias("gained"),
        F.avg(bits).alias("novelty"),
    )
    by_grade = Window.partitionBy("user_id").orderBy(F.col("grade").desc(), "item_id")
    ideal = marks.withColumn("place", F.row_number().over(by_grade)).groupBy("user_id").agg(
        F.count("*").alias("owned"),
        F.sum(F.when(F.col("place") <= k, F.col("grade") / F.log2(F.col("place") + 1))).alias("idcg"),
    )
    joined = (
        users.select("user_id")
        .join(by_list, "user_id", "left")
        .join(ideal, "user_id", "left")
        .join(intra_list_diversity(listed, items, users), "user_id")
        .fillna(0)
    )
    precision = _ratio(F.col("hits"), F.least(F.col("listed"), F.lit(k)))
    recall = _ratio(F.col("hits"), F.col("owned"))
    figures = {
        "precision_at_k": precision,
        "recall_at_k": recall,
        "f1_score": f1(precision, recall),
        "ndcg_at_k": _ratio(F.col("dcg"), F.col("idcg")),
        "map_score": _ratio(F.col("gained"), F.col("owned")),
        "diversity": F.col("diversity"),
        "novelty": F.col("novelty"),
    }
    means = joined.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(n) for n, c in figures.items()])
    return means.withColumn("coverage", coverage(listed, items).scalar())
