"""Top-k of a table of vectors against itself, each unordered pair multiplied once.

Rows are dealt to blocks by a hash of their key. A cell is an unordered pair of
blocks; the product of its two sides gives the best partners of the rows of
both, read along its rows and along its columns. So half the products, and half
the cells, of a search of the table against itself.
"""

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lodestream.operators import similarity as S

ROWS = 16384
STRIP = 1024


class _Side:
    """Rows of one vector size, sorted by key."""

    def __init__(self, table: pa.Table, places: np.ndarray, matrix: np.ndarray):
        take = pa.array(places)
        self.ids, self.tags = table.column("iid").combine_chunks().take(take), table.column("itag").combine_chunks().take(take)
        both = pa.table({"i": self.ids, "t": self.tags})
        order = pc.sort_indices(both, sort_keys=[("i", "ascending"), ("t", "ascending")], null_placement="at_start")
        self.ids, self.tags, matrix = self.ids.take(order), self.tags.take(order), matrix[order.to_numpy()]
        code = pc.dictionary_encode(self.ids, null_encoding="encode").indices.to_numpy()
        tags = self.tags.to_numpy()
        fresh = np.ones(len(tags), bool)
        fresh[1:] = (code[1:] != code[:-1]) | (tags[1:] != tags[:-1])
        keep = pa.array(np.flatnonzero(fresh))
        self.ids, self.tags = self.ids.take(keep), self.tags.take(keep)
        self.matrix = matrix[fresh].astype(np.float64)
        self.norm, self.unit = S._normalized(self.matrix)
        self.names = code[fresh]

    def __len__(self):
        return len(self.matrix)


def strips(left: int, right: int, same: bool):
    """((start, stop), (start, stop)) of the products of a cell: above and on the diagonal if both sides are the same."""
    for a in range(0, left, STRIP):
        for b in range(a if same else 0, right, STRIP):
            yield (a, min(a + STRIP, left)), (b, min(b + STRIP, right))


def _top(score: np.ndarray, k: int, row0: int, col0: int, rows: "_Side", cols: "_Side", metric: str) -> S._Found:
    """The best k of each row, with a rounding step below the k-th kept as well."""
    if score.shape[1] > k:
        bar = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
        bar = np.maximum(bar - 10.0**-S.RANK_DIGITS, np.finfo(np.float64).min)
        r, c = np.nonzero(score >= bar[:, None])
    else:
        r, c = np.nonzero(score > -np.inf)
    chosen = score[r, c]
    dots = chosen * rows.norm[r + row0] * cols.norm[c + col0] if metric == "cosine" else chosen
    return S._Found(r + row0, c + col0, chosen, dots, np.round(chosen, S.RANK_DIGITS))


def best_of_cell(left: _Side, right: _Side, k: int, metric: str):
    """The best k partners in the other side of every row of both; right is left on the diagonal: then within it."""
    same = left is right
    name = (lambda s: s.unit) if metric == "cosine" else (lambda s: s.matrix)
    other = None if same else pc.index_in(right.ids, value_set=left.ids)
    clash = np.zeros((0, 2), np.int64)
    if not same and other.null_count < len(other):
        known = np.flatnonzero(other.is_valid().to_numpy(zero_copy_only=False))
        clash = np.stack([other.take(pa.array(known)).to_numpy(), known], axis=1)
    kept, last, parts = [None, None], None, ([], [])

    def shrink(side):
        held = [p for p in (kept[side], *parts[side]) if p is not None]
        if held:
            kept[side] = S._Found.joined(held).first(k)
        parts[side].clear()

    for (a0, a1), (b0, b1) in strips(len(left), len(right), same):
        if a0 != last:
            last = a0
            shrink(0)
            shrink(1)
        score = name(left)[a0:a1] @ name(right)[b0:b1].T
        score[np.isnan(score)] = -np.inf
        if same:
            score[left.names[a0:a1, None] == left.names[None, b0:b1]] = -np.inf
        else:
            here = clash[(clash[:, 0] >= a0) & (clash[:, 0] < a1) & (clash[:, 1] >= b0) & (clash[:, 1] < b1)]
            score[here[:, 0] - a0, here[:, 1] - b0] = -np.inf
        parts[0].append(_top(score, k, a0, b0, left, right, metric))
        if not (same and a0 == b0):
            parts[0 if same else 1].append(_top(score.T, k, b0, a0, right, left, metric))
    shrink(0)
    shrink(1)
    for found, rows, cols in ((kept[0], left, right), (kept[1], right, left)):
        if found is not None:
            yield found, rows, cols


def _scan(k: int, metric: str, schema: pa.Schema):
    def sized(batches):
        if not batches:
            return {}
        table = pa.Table.from_batches(batches).combine_chunks()
        return {size: _Side(table, places, matrix) for size, places, matrix in S._matrices(table.column("ivec"))}

    def of_cell(cell):
        left, right = sized(cell[0]), sized(cell[1])
        for size, own in left.items():
            far = own if not cell[1] else right.get(size)
            for found, rows, cols in best_of_cell(own, far, k, metric) if far is not None else ():
                r, c = pa.array(found.rows), pa.array(found.cols)
                made = [pa.array(x) for x in (found.score, found.dot, found.key)]
                yield pa.RecordBatch.from_arrays([rows.ids.take(r), rows.tags.take(r), cols.ids.take(c), *made], schema=schema)

    def run(batches):
        now, cell = None, ([], [])
        for batch in batches:
            if batch.num_rows == 0:
                continue
            cells, sides = batch.column("cell").to_numpy(), batch.column("side").to_numpy()
            cuts = [0, *(np.flatnonzero((cells[1:] != cells[:-1]) | (sides[1:] != sides[:-1])) + 1), batch.num_rows]
            for start, stop in zip(cuts, cuts[1:]):
                if cells[start] != now:
                    yield from of_cell(cell)
                    now, cell = cells[start], ([], [])
                cell[sides[start]].append(batch.slice(start, stop - start))
        yield from of_cell(cell)

    return run


def blocks_for(rows: int, slots: int, most: int = ROWS) -> int:
    """Blocks so that none has more than most rows and there are about as many cells as slots, if rows allow."""
    return max(math.ceil(rows / most), min(math.ceil(rows / STRIP), math.ceil(math.sqrt(2 * slots))), 1)


def self_top_k(
    vectors: DataFrame, k: int, key: str = "item_id", vec: str = "embedding", metric: str = "cosine", rows: int | None = None,
    rows_per_block: int = ROWS,
) -> DataFrame:
    """The k rows most alike each row by cosine or dot: (query_<key>, key, score, dot, rank); rows of the same key left out.

    The rows of similarity.similar for all keys. Vectors that are null, empty or
    not finite take no part, sizes never mix, rows equal in key and vector count
    once; ties on the score rounded to nine digits go to the smaller key. A block
    is copied to as many cells as there are blocks. A missing rows is counted,
    which is all that reaches the driver.
    """
    if metric not in ("cosine", "dot"):
        raise ValueError("metric is cosine or dot")
    known = vectors.filter(S.searchable(vec)).select(F.col(key).alias("iid"), F.xxhash64(vec).alias("itag"), F.col(vec).alias("ivec"))
    n = known.count() if rows is None else rows
    slots = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = blocks_for(n, slots, rows_per_block)
    own, far = F.col("block"), F.col("far")
    dealt = known.withColumn("block", F.pmod(F.xxhash64("iid", F.lit("block")), F.lit(blocks)).cast("int"))
    dealt = dealt.withColumn("far", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.select(
        "iid", "itag", "ivec", (F.least(own, far) * blocks + F.greatest(own, far)).alias("cell"), (own > far).cast("int").alias("side")
    )
    cells = dealt.repartition(max(1, min(blocks * (blocks + 1) // 2, 4 * slots)), "cell").sortWithinPartitions("cell", "side")
    kind = known.schema["iid"].dataType
    figures = [T.StructField(c, T.DoubleType()) for c in ("score", "dot", "rank_key")]
    schema = T.StructType(
        [T.StructField("qid", kind), T.StructField("qtag", T.LongType()), T.StructField("iid", kind), *figures]
    )
    found = cells.mapInArrow(_scan(k, metric, to_arrow_schema(schema)), schema)
    return S._renamed(S._merge(found).filter(F.col("rank") <= k), key, key)
