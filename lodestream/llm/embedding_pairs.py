"""Near-duplicate vectors: cross-polytope hashing after fast Hadamard rotations."""

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from lodestream.llm.common import arrow, bounds, complete, cut_lineage, forest, mix, row_key, table, unlink
from lodestream.llm.components import components

#: Hash tables, hashes joined to a key, keys a vector has in each table. With these, fewer than one in 10,000
#: pairs of 64 dimensions at cosine 0.93 exactly fail to meet; closer pairs meet more often. A table has (2 d)^3 buckets.
TABLES, HASHES, PROBES = 8, 3, 6
#: Members of a bucket compared at once with those of another block.
BLOCK = 512
#: Vectors hashed at once, few enough for the processor's cache.
CHUNK = 2048
SEED = 29


@functools.cache
def _sylvester(n: int) -> np.ndarray:
    return np.ones((1, 1)) if n == 1 else np.kron(_sylvester(n // 2), np.array([[1.0, 1.0], [1.0, -1.0]]))


def _hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the rows, whose length is a power of two, in two steps of about its root."""
    rows, n = x.shape
    right = 1 << (n.bit_length() // 2)
    left = n // right
    x = (x.reshape(rows * left, right) @ _sylvester(right)).reshape(rows, left, right)
    return np.matmul(_sylvester(left), x).reshape(rows, n) / math.sqrt(n)


def _largest(size: np.ndarray, depth: int) -> np.ndarray:
    """Columns of the depth largest entries of each row, the largest first, ties by column."""
    if depth < size.shape[1]:
        some = np.sort(np.argpartition(-size, depth - 1, axis=1)[:, :depth], axis=1)
    else:
        some = np.tile(np.arange(size.shape[1]), (len(size), 1))
    order = np.argsort(-np.take_along_axis(size, some, 1), axis=1, kind="stable")
    return np.take_along_axis(some, order, 1)


def bucket_keys(units: np.ndarray, tables=TABLES, hashes=HASHES, probes=PROBES, seed=SEED) -> np.ndarray:
    """(rows, tables, probes) 64-bit keys of unit vectors.

    A rotation is three rounds of random signs and a Hadamard transform; its hash
    is the nearest signed axis. A table joins `hashes` of them. Its further
    probes swap axes for the next nearest ones, the least loss first.
    """
    rows, dim = units.shape
    if rows > CHUNK:
        parts = [bucket_keys(units[k : k + CHUNK], tables, hashes, probes, seed) for k in range(0, rows, CHUNK)]
        return np.concatenate(parts)
    width = 1 << max(1, (dim - 1).bit_length())
    padded = np.zeros((rows, width))
    padded[:, :dim] = units
    depth = min(width, probes)
    out = np.zeros((rows, tables, probes), np.uint64)
    for t in range(tables):
        keys = np.full((rows, 1), np.uint64(t + 1))
        loss = np.zeros((rows, 1))
        for h in range(hashes):
            x = padded
            for signs in np.random.default_rng((seed, t, h)).choice([-1.0, 1.0], size=(3, width)):
                x = _hadamard(x * signs)
            size = np.abs(x)
            axis = _largest(size, depth)
            near = np.take_along_axis(size, axis, 1)
            axis = 2 * axis + (np.take_along_axis(x, axis, 1) > 0)
            keys = mix(keys[:, :, None] * np.uint64(2 * width + 1) + axis[:, None, :].astype(np.uint64)).reshape(rows, -1)
            loss = (loss[:, :, None] + ((near[:, :1] - near) ** 2)[:, None, :]).reshape(rows, -1)
            if keys.shape[1] > probes:
                best = np.argsort(loss, axis=1, kind="stable")[:, :probes]
                keys, loss = np.take_along_axis(keys, best, 1), np.take_along_axis(loss, best, 1)
        out[:, t, : keys.shape[1]] = keys
        out[:, t, keys.shape[1] :] = keys[:, :1]
    return out


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _units(matrix: np.ndarray) -> np.ndarray:
    """Rows at unit length; scaled first, so that no square overflows or vanishes."""
    matrix = matrix / np.abs(matrix).max(axis=1, keepdims=True)
    return matrix / np.sqrt(np.einsum("ij,ij->i", matrix, matrix))[:, None]


def _memberships(shape):
    def run(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                here = pa.array(np.flatnonzero(dims == dim))
                keys = bucket_keys(_units(_matrix(batch.column("vec").take(here))), **shape)
                flat = keys.reshape(len(here), -1)
                fresh = np.ones(flat.shape, bool)  # a probe that repeats a key counts once
                for k in range(1, flat.shape[1]):
                    fresh[:, k] = (flat[:, :k] != flat[:, k : k + 1]).all(axis=1)
                row, column = np.nonzero(fresh)
                take = pa.array(here.to_numpy()[row])
                yield {
                    "node": batch.column("node").take(take),
                    "label": batch.column("label").take(take),
                    "dim": dims[take.to_numpy()],
                    "bucket": flat[row, column].view(np.int64),
                }

    return run


def _pairs(threshold, shape):
    """Links within each cell: a sum of the partners' sizes for each node, and a forest of the links.

    A pair that meets in several buckets counts in the one with the least key
    that the two share.
    """

    def first_shared(a, b):
        """Least key of two rows' tables; keys of different tables never meet."""
        hit = (a[:, :, :, None] == b[:, :, None, :]).any(axis=3)
        return np.where(hit, a, ~np.uint64(0)).min(axis=(1, 2))

    def run(batches):
        for whole in complete(batches, "bucket", "side_a", "side_b", "label", "dim"):
            marks = [whole.column(c).to_numpy() for c in ("bucket", "side_a", "side_b", "label", "dim")]
            cut = bounds(*marks)
            bucket, side_a, side_b, _, dim = marks
            node, weight, side = (whole.column(c).to_numpy() for c in ("node", "weight", "side"))
            lists = whole.column("vec").combine_chunks()
            left, right = [], []
            units, at = [], np.zeros(len(node), np.int64)
            for d in np.unique(dim):
                here = np.flatnonzero(dim == d)
                at[here] = np.arange(len(here))
                units.append((d, _units(_matrix(lists.take(pa.array(here))))))
            units = dict(units)
            small, large = [], []
            for start, stop in zip(cut, cut[1:]):
                (small if stop - start <= 8 else large).append((start, stop))
            for size in range(2, 9):
                starts = np.array([s for s, e in small if e - s == size], np.int64)
                for i in range(size):
                    for j in range(i + 1, size):
                        left.append(starts + i)
                        right.append(starts + j)
            if left:
                a, b = np.concatenate(left), np.concatenate(right)
                apart = (side_a[a] != side_b[a]) & (side[a] == side[b])
                a, b = a[~apart], b[~apart]
                close = np.zeros(len(a), bool)
                for d, u in units.items():
                    mine = np.flatnonzero(dim[a] == d)
                    for some in range(0, len(mine), 1 << 16):
                        m = mine[some : some + (1 << 16)]
                        close[m] = np.einsum("ij,ij->i", u[at[a[m]]], u[at[b[m]]]) >= threshold
                found = [(a[close], b[close])]
            else:
                found = []
            for start, stop in large:
                own = np.arange(start, stop)
                u = units[dim[start]]
                if side_a[start] == side_b[start]:
                    x, y = np.nonzero(np.triu(u[at[own]] @ u[at[own]].T >= threshold, 1))
                    found.append((own[x], own[y]))
                else:
                    one, two = own[side[own] == side_a[start]], own[side[own] == side_b[start]]
                    if len(one) and len(two):
                        x, y = np.nonzero(u[at[one]] @ u[at[two]].T >= threshold)
                        found.append((one[x], two[y]))
            for a, b in found:
                if len(a) == 0:
                    continue
                rows = np.unique(np.concatenate([a, b]))
                keys = np.zeros((len(rows), shape["tables"], shape["probes"]), np.uint64)
                for d, u in units.items():
                    mine = np.flatnonzero(dim[rows] == d)
                    if len(mine):
                        keys[mine] = bucket_keys(u[at[rows[mine]]], **shape)
                counted = np.zeros(len(a), bool)
                for some in range(0, len(a), 1 << 14):
                    p = slice(some, some + (1 << 14))
                    ka, kb = keys[np.searchsorted(rows, a[p])], keys[np.searchsorted(rows, b[p])]
                    counted[p] = first_shared(ka, kb).view(np.int64) == bucket[a[p]]
                a, b = a[counted], b[counted]
                if len(a) == 0:
                    continue
                links = np.bincount(np.concatenate([a, b]), np.concatenate([weight[b], weight[a]]), len(node))
                linked = np.flatnonzero(links)
                x, y = forest(node[a], node[b])
                yield {"a": node[linked], "b": np.zeros(len(linked), np.int64), "n": links[linked].astype(np.int64)}
                yield {"a": x, "b": y, "n": np.full(len(x), -1)}

    return run


def _label_of(vectors: DataFrame, label: str) -> F.Column:
    """A whole number that stands for the label: itself, or 64 bits of any other kind."""
    if isinstance(vectors.schema[label].dataType, IntegralType):
        return F.col(label).cast("long")
    return F.when(F.col(label).isNotNull(), F.xxhash64(label))


def near_vectors(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
    threshold: float = 0.93,
    tables: int = TABLES,
    hashes: int = HASHES,
    probes: int = PROBES,
    block: int = BLOCK,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Vectors of one label and dimension are linked if they meet in a bucket and
    their cosine, in double precision, is at least the threshold. A vector that
    is null, empty, zero or holds a null or a component that is not finite, or
    has no label, has no links. Equal vectors are one node that counts as many
    times as it occurs. component_id is the smallest id reachable; kept is
    whether that is the row's own (false for a null id). Repeated rows are
    vectors of their own.

    A bucket with more members than a block is compared block against block in
    tasks of their own; tasks let out a count for each member and a forest of
    the links, never the pairs. What a node needs to be found twice over is
    recomputed from its vector, so nothing but narrow keys and the vectors of
    shared buckets is shuffled.
    """
    shape = {"tables": tables, "hashes": hashes, "probes": probes}
    rows = vectors.select(F.col(vec_id).alias("id"), F.col(embedding).alias("vec"), _label_of(vectors, label).alias("label"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    usable = F.col("label").isNotNull() & F.col("vec").isNotNull() & finite & F.exists("vec", lambda x: x != 0)
    rows = rows.withColumn("node", F.when(F.coalesce(usable, F.lit(False)), row_key("label", "vec")))
    nodes = cut_lineage(
        rows.filter("node IS NOT NULL")
        .groupBy("node")
        .agg(F.count("*").alias("weight"), F.min("id").alias("id"), F.first("label").alias("label"), F.first("vec").alias("vec"))
        .withColumn("dim", F.size("vec"))
    )
    member = cut_lineage(arrow(nodes.select("node", "label", "dim", "vec"), _memberships(shape), "node long, label long, dim int, bucket long"))
    shared = cut_lineage(member.groupBy("bucket", "label", "dim").agg(F.count("*").alias("size")).filter("size > 1"))
    blocks = F.ceil(F.col("size") / F.lit(block)).cast("int")
    seats = (
        member.join(shared, ["bucket", "label", "dim"])
        .withColumn("blocks", blocks)
        .withColumn("side", F.pmod(F.xxhash64("node", "bucket"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("node", "bucket", "side", F.least("side", "other").alias("side_a"), F.greatest("side", "other").alias("side_b"))
    )
    cell = ["bucket", "side_a", "side_b", "label", "dim"]
    cells = (
        seats.join(nodes.select("node", "weight", "label", "dim", "vec"), "node")
        .repartition(*[F.col(c) for c in cell])
        .sortWithinPartitions(*cell)
    )
    found = cut_lineage(arrow(cells, _pairs(threshold, shape), "a long, b long, n long"))
    links = found.filter("n >= 0").groupBy("a").agg(F.sum("n").alias("links"))
    star = components(found.filter("n < 0").select("a", "b"))
    tops = nodes.select("node", "id", "weight").join(star.select(F.col("a").alias("node"), F.col("b").alias("top")), "node", "left")
    tops = tops.withColumn("top", F.coalesce("top", "node"))
    least = cut_lineage(tops.groupBy("top").agg(F.min("id").alias("component_id")))
    known = cut_lineage(
        tops.join(least, "top")
        .join(links.select(F.col("a").alias("node"), "links"), "node", "left")
        .select("node", "component_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    )
    for done in (member, shared, found, star, least, nodes):
        unlink(done)
    out = rows.select("id", "node").join(known, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("id").alias(vec_id),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )


def op1_embedding_pairs(spark, sf_dir):
    """Links, component and verdict of every vector at cosine 0.93, label by label."""
    return near_vectors(table(spark, sf_dir, "embeddings"))
