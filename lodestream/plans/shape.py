"""Output shapes of the catalogue's queries: flat columns, six decimals."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.functions import vectors as V


def r6(c) -> Column:
    return F.round(c, 6)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r6(F.col(c)) for c in columns})


def as_bigint(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("bigint") for c in columns})


def long(df: DataFrame, keys: list[str], vector: str = "embedding") -> DataFrame:
    """One row per element: keys, i (0-based), value."""
    return df.select(*keys, F.posexplode(V.as_double(vector)).alias("i", "value")).select(
        *keys, F.col("i").cast("bigint").alias("i"), r6(F.col("value")).alias("value")
    )


def print_of(vector, name: str) -> list[Column]:
    """Size, sum and position-weighted sum: a vector as three columns."""
    v = V.as_double(vector)
    total = F.aggregate(v, F.lit(0.0), lambda t, x: t + x)
    weighted = F.aggregate(F.transform(v, lambda x, i: x * (i + 1)), F.lit(0.0), lambda t, x: t + x)
    return [
        F.size(v).cast("bigint").alias(f"{name}_n"),
        r6(total).alias(f"{name}_sum"),
        r6(weighted).alias(f"{name}_moment"),
    ]
