"""Orthogonal vectors: tall-skinny QR.

Each task factors its own rows and keeps a triangle of dim x dim; triangles are
stacked and factored again, some at a time, until one is left: the triangle of
the whole table. One more pass over the rows divides by it. With a positive
diagonal the triangle is unique, so the result does not depend on how rows are
dealt to tasks, but for rounding.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.functions import draws
from lodestream.operators.clusters import matrix
from lodestream.session import cut_lineage

#: Triangles that are stacked together.
FAN = 32
#: Rows a task factors at once.
BLOCK = 4096
#: What is left of a column, as a share of it, below which it depends on those before.
TINY = 1e-10


def triangle(stack: np.ndarray) -> np.ndarray:
    """R of QR with a diagonal that is not negative, as many rows as columns."""
    dim = stack.shape[1]
    if len(stack) < dim:
        stack = np.concatenate([stack, np.zeros((dim - len(stack), dim))])
    r = np.linalg.qr(stack, mode="r")
    return r * np.where(np.diag(r) < 0, -1.0, 1.0)[:, None]


def _factor(dim: int, vector: str):
    """A task's rows, dim numbers each, to its triangle as one row."""

    def run(batches):
        held = np.zeros((0, dim))
        for batch in batches:
            _, rows = matrix(batch.column(vector), dim)
            for start in range(0, len(rows), BLOCK):
                held = triangle(np.concatenate([held, rows[start : start + BLOCK]]))
        if len(held):
            yield pa.RecordBatch.from_arrays([pa.array([held.ravel()], pa.list_(pa.float64()))], names=["r"])

    return run


def _stacked(dim: int):
    def run(batches):
        held = np.zeros((0, dim))
        for batch in batches:
            for r in batch.column("r"):
                held = triangle(np.concatenate([held, r.values.to_numpy().reshape(dim, dim)]))
        if len(held):
            yield pa.RecordBatch.from_arrays([pa.array([held.ravel()], pa.list_(pa.float64()))], names=["r"])

    return run


def whole_triangle(rows: DataFrame, dim: int, vector: str = "vector") -> np.ndarray:
    """R of all rows, dim x dim, merged in a tree; this is all that reaches the driver."""
    level = cut_lineage(rows.select(vector).mapInArrow(_factor(dim, vector), "r array<double>"))
    while (n := level.count()) > 1:
        level = cut_lineage(level.repartition(-(-n // FAN)).mapInArrow(_stacked(dim), "r array<double>"))
    found = level.first()
    return np.array(found.r).reshape(dim, dim) if found else np.zeros((dim, dim))


def _independent(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Triangle of the columns of r one after the other, and those that do not depend on the ones before."""
    dim = len(r)
    basis, upper, fine = np.zeros((dim, dim)), np.zeros((dim, dim)), []
    for j in range(dim):
        left = r[:, j].copy()
        for _ in range(2):
            along = basis.T @ left
            upper[:, j] += along
            left -= basis @ along
        size = np.linalg.norm(left)
        if size > TINY * np.linalg.norm(r[:, j]):
            fine.append(j)
            upper[j, j] = size
            basis[:, j] = left / size
    return upper, np.array(fine, int)


def _divided(r: np.ndarray, vector: str):
    """Rows times the inverse of R; directions that the rows do not have become zero."""
    dim = len(r)
    upper, fine = _independent(r)
    inverse = np.zeros((dim, dim))
    inverse[np.ix_(fine, fine)] = np.linalg.inv(upper[np.ix_(fine, fine)])

    def run(batches):
        for batch in batches:
            places, rows = matrix(batch.column(vector), dim)
            own = batch.take(pa.array(places))
            ends = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * dim)
            made = pa.ListArray.from_arrays(ends, pa.array((rows @ inverse).ravel()))
            at = own.schema.get_field_index(vector)
            yield own.set_column(at, own.schema.field(at), made)

    return run


def orthonormal(rows: DataFrame, dim: int, vector: str = "vector") -> DataFrame:
    """rows with vectors replaced so that the table's dim columns are orthonormal and span what they spanned.

    Two passes of QR, the second for rounding. Directions that the rows do not
    have (fewer rows than dim, or dependent columns) become zero columns. Vectors
    of another size, null, or with null or non-finite numbers are left out.
    """
    sound = F.coalesce((F.size(vector) == dim) & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))), F.lit(False))
    out = rows.filter(sound).withColumn(vector, F.col(vector).cast("array<double>"))
    for _ in range(2):
        out = out.mapInArrow(_divided(whole_triangle(out, dim, vector), vector), out.schema)
        out = cut_lineage(out)
    return out


def init_orthogonal(ids: DataFrame, key: str, dim: int, seed=0) -> DataFrame:
    """(key, vector): uniform draws by id in -1 to 1, made orthonormal over all ids."""
    drawn = ids.select(key).distinct().select(key, draws.init_vector(key, "uniform", dim, seed, low=-1.0, high=1.0).alias("vector"))
    return orthonormal(drawn, dim)


def gram(rows: DataFrame, dim: int, vector: str = "vector") -> DataFrame:
    """(i, j, value): products of the columns, summed over all rows."""

    def run(batches):
        total = np.zeros((dim, dim))
        for batch in batches:
            _, own = matrix(batch.column(vector), dim)
            total += own.T @ own
        i, j = np.divmod(np.arange(dim * dim), dim)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], names=["i", "j", "value"])

    parts = rows.select(vector).mapInArrow(run, "i long, j long, value double")
    return parts.groupBy("i", "j").agg(F.sum("value").alias("value"))
