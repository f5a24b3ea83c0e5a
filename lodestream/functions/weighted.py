"""Aggregates over vectors that carry weights."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.functions import vectors as V


def weighted_average(rows: DataFrame, key: str, vector: str, weight: str, dim: int) -> DataFrame:
    """(key, vector): sum of weight times vector over the sum of weights.

    Vectors of another dimension than dim are skipped; a group whose weights
    sum to zero or less keeps the undivided sum.
    """
    usable = rows.filter(F.size(vector) == dim)
    totals = usable.groupBy(key).agg(
        V.vector_sum(V.scale(vector, F.col(weight))).alias("_sum"), F.sum(weight).alias("_weight")
    )
    divisor = F.when(F.col("_weight") > 0, F.col("_weight")).otherwise(F.lit(1.0))
    return totals.select(key, V.scale("_sum", 1.0 / divisor).alias("vector"))


def vector_stats(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, mean, variance) of a vector's elements; the variance is the population one."""
    v = V.as_double(vector)
    n = F.size(v)
    mean = F.aggregate(v, F.lit(0.0), lambda total, x: total + x) / n
    with_mean = rows.select(key, v.alias("_v"), mean.alias("mean"))
    apart = F.zip_with("_v", F.array_repeat("mean", F.size("_v")), lambda x, m: (x - m) * (x - m))
    variance = F.aggregate(apart, F.lit(0.0), lambda total, x: total + x) / F.size("_v")
    return with_mean.select(key, "mean", variance.alias("variance"))


def grouped_softmax(rows: DataFrame, key: str, score: str) -> DataFrame:
    """rows with each score's softmax share within its group.

    The group's maximum and sum are aggregates joined back, so a hot group is
    never gathered.
    """
    top = rows.groupBy(key).agg(F.max(score).alias("_top"))
    shifted = rows.join(top, key).withColumn("_e", F.exp(F.col(score) - F.col("_top")))
    total = shifted.groupBy(key).agg(F.sum("_e").alias("_total"))
    return shifted.join(total, key).select(*rows.columns, (F.col("_e") / F.col("_total")).alias("softmax"))
