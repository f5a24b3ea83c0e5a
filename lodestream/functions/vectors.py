"""Vector expressions over ARRAY columns. Everything is computed in DOUBLE.

A value that depends on the whole vector (norm, maximum) enters a lambda as
one element of a repeated array: an expression written inside the lambda body
would be evaluated again for each element.
"""

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITY = float("inf")


def as_double(vector) -> Column:
    return F.col(vector).cast("array<double>") if isinstance(vector, str) else vector.cast("array<double>")


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def _spread(value: Column, like: Column) -> Column:
    return F.array_repeat(value, F.size(like))


def dot(a, b) -> Column:
    return _total(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y))


def norm(a) -> Column:
    return F.sqrt(F.aggregate(as_double(a), F.lit(0.0), lambda total, x: total + x * x))


def _same_size(a, b) -> Column:
    return F.size(a) == F.size(b)


def cosine(a, b) -> Column:
    """0 when the dimensions differ or either norm is zero."""
    safe = F.coalesce(dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0)), F.lit(0.0))
    return F.when(_same_size(a, b), safe).otherwise(F.lit(0.0))


def squared_l2(a, b) -> Column:
    return _total(F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y)))


def euclidean(a, b) -> Column:
    """+Infinity when the dimensions differ."""
    return F.when(_same_size(a, b), F.sqrt(squared_l2(a, b))).otherwise(F.lit(INFINITY))


def manhattan(a, b) -> Column:
    """+Infinity when the dimensions differ."""
    apart = _total(F.zip_with(as_double(a), as_double(b), lambda x, y: F.abs(x - y)))
    return F.when(_same_size(a, b), apart).otherwise(F.lit(INFINITY))


def scale(vector, factor: Column) -> Column:
    v = as_double(vector)
    return F.zip_with(v, _spread(factor.cast("double"), v), lambda x, f: x * f)


def add(a, b) -> Column:
    return F.zip_with(as_double(a), as_double(b), lambda x, y: x + y)


def normalize(vector) -> Column:
    """L2-normalised copy; a zero vector is returned unchanged."""
    v = as_double(vector)
    length = F.coalesce(F.nullif(norm(v), F.lit(0.0)), F.lit(1.0))
    return F.zip_with(v, _spread(length, v), lambda x, n: x / n)


def zeros(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0), dim)


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def relu(x: Column) -> Column:
    """max(x, 0); NaN gives 0, which greatest() alone would not."""
    return F.when(F.isnan(x), F.lit(0.0)).otherwise(F.greatest(x, F.lit(0.0)))


def softmax(vector) -> Column:
    """Shifted by the maximum; empty stays empty, a non-positive sum gives uniform."""
    v = as_double(vector)
    exps = F.zip_with(v, _spread(F.array_max(v), v), lambda x, top: F.exp(x - top))
    total = _total(exps)
    shares = F.zip_with(exps, _spread(total, v), lambda e, t: e / t)
    uniform = _spread(F.lit(1.0) / F.size(v), v)
    return F.when(F.size(v) == 0, v).when(total > 0, shares).otherwise(uniform)


def top_indices(scores, k: int) -> Column:
    """0-based positions of the k largest scores, ties by position."""
    v = as_double(scores)
    tagged = F.transform(v, lambda x, i: F.struct((-x).alias("s"), i.alias("i")))
    return F.transform(F.slice(F.array_sort(tagged), 1, k), lambda t: t["i"])


def vector_sum(vector, weight: Column | None = None) -> Column:
    """Element-wise sum as an aggregate expression, weights (not negative, not all zero) applied.

    One buffer of doubles per group with map-side combine, so a hot group
    costs one partial buffer per task and nothing is exploded by dimension.
    """
    points = array_to_vector(as_double(vector))
    return vector_to_array(Summarizer.sum(points) if weight is None else Summarizer.sum(points, weight))


def is_finite(x: Column) -> Column:
    return ~(F.isnan(x) | (F.abs(x) == F.lit(INFINITY)))


def all_finite(vector) -> Column:
    """False where an element is null, NaN or infinite; null for a null vector."""
    return ~F.exists(as_double(vector), lambda x: x.isNull() | ~is_finite(x))
