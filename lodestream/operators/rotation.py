"""Example-by-example matrix factorisation by rotating blocks.

Users and items are dealt to as many blocks each. A stratum pairs every user
block with one item block; no two of its pairs share a user or an item, so each
is a task that goes through its examples one by one, and the result is that of
going through the stratum's examples in any order of the blocks. The item
blocks then move on by one: after as many strata as blocks each example has
been used once. Examples of one pair of blocks go in the order of a column.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lodestream.functions import vectors as V
from lodestream.operators.training import LEARNING_RATE, REGULARIZATION, factors_or_init
from lodestream.session import cut_lineage, drop_step

USER, ITEM, EXAMPLE = 0, 1, 2
#: Factors of one side that a task holds.
ROWS_PER_BLOCK = 1 << 16


def block_of(key: str, blocks: int) -> F.Column:
    return F.pmod(F.xxhash64(F.col(key), F.lit("rotation")), F.lit(blocks)).cast("int")


def one_by_one(users: np.ndarray, items: np.ndarray, u: np.ndarray, i: np.ndarray, label: np.ndarray, lr: float, reg: float):
    """The sequential rule, in place: each example moves its two factors by their old values."""
    for a, b, y in zip(u.tolist(), i.tolist(), label.tolist()):
        x, z = users[a], items[b]
        error = y - x @ z
        users[a], items[b] = x + lr * (error * z - reg * x), z + lr * (error * x - reg * z)


def _stratum(lr: float, reg: float, schema: pa.Schema):
    """Factors of a cell after its examples; the cell's users come first, then its items, then examples in order."""

    class Cell:
        def __init__(self):
            self.ids, self.matrix = {USER: [], ITEM: []}, {USER: [], ITEM: []}
            self.ready = False

        def prepare(self):
            for side in (USER, ITEM):
                self.ids[side] = pa.concat_arrays(self.ids[side]) if self.ids[side] else pa.array([], pa.int64())
                self.matrix[side] = np.concatenate(self.matrix[side]) if self.matrix[side] else np.zeros((0, 1))
            self.ready = True

        def add(self, side, part):
            if side != EXAMPLE:
                lists = part.column("vector")
                self.ids[side].append(part.column("user_id" if side == USER else "item_id"))
                self.matrix[side].append(lists.flatten().to_numpy().reshape(part.num_rows, -1).copy())
                return
            if not self.ready:
                self.prepare()
            at = [
                pa.compute.index_in(part.column(key), value_set=self.ids[side]).to_numpy(zero_copy_only=False)
                for side, key in ((USER, "user_id"), (ITEM, "item_id"))
            ]
            one_by_one(self.matrix[USER], self.matrix[ITEM], *at, part.column("label").to_numpy(), lr, reg)

        def rows(self):
            if not self.ready:
                self.prepare()
            for side, name in ((USER, "user_id"), (ITEM, "item_id")):
                n = len(self.ids[side])
                if n:
                    width = self.matrix[side].shape[1]
                    ends = pa.array(np.arange(n + 1, dtype=np.int32) * width)
                    columns = {
                        "side": pa.array(np.full(n, side, np.int32)),
                        name: self.ids[side],
                        "vector": pa.ListArray.from_arrays(ends, pa.array(self.matrix[side].ravel())),
                    }
                    yield pa.RecordBatch.from_arrays(
                        [columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema
                    )

    def run(batches):
        now, cell = None, None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            cells, sides = batch.column("cell").to_numpy(), batch.column("side").to_numpy()
            cuts = [0, *(np.flatnonzero((cells[1:] != cells[:-1]) | (sides[1:] != sides[:-1])) + 1), batch.num_rows]
            for start, stop in zip(cuts, cuts[1:]):
                if cells[start] != now:
                    if cell is not None:
                        yield from cell.rows()
                    now, cell = cells[start], Cell()
                cell.add(int(sides[start]), batch.slice(start, stop - start))
        if cell is not None:
            yield from cell.rows()

    return run


def train_sequential(
    examples: DataFrame,
    users: DataFrame,
    items: DataFrame,
    order: str,
    epochs: int = 1,
    blocks: int | None = None,
    lr: float = LEARNING_RATE,
    reg: float = REGULARIZATION,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> tuple[DataFrame, DataFrame]:
    """(user_id, vector), (item_id, vector) after epochs of the sequential rule, stratum by stratum.

    users and items hold (id, vector), all of one size and each id once; examples
    (user_id, item_id, label, order). Examples without both factors or a label are
    left out. Repeated examples count each time. order breaks no ties by itself:
    equal values go by user, item and label. Blocks default to as many as keep
    rows_per_block factors a side in a task; an epoch has that many strata, each
    written to the shared folder, with the files of the one before it removed.
    A user with a large share of the examples meets one item block a stratum, so
    its examples are spread over the strata, which is what the order demands.
    """
    if blocks is None:
        blocks = max(1, math.ceil(max(users.count(), items.count()) / rows_per_block))
    uid, iid = users.schema["user_id"].dataType, items.schema["item_id"].dataType
    known = examples.filter(F.col("label").isNotNull()).select(
        "user_id", "item_id", F.col("label").cast("double").alias("label"), F.col(order).alias("_order"),
        block_of("user_id", blocks).alias("ub"), block_of("item_id", blocks).alias("ib"),
    )
    known = known.join(users.select("user_id"), "user_id", "left_semi").join(items.select("item_id"), "item_id", "left_semi")
    known = cut_lineage(known.withColumn("stratum", F.pmod(F.col("ib") - F.col("ub"), F.lit(blocks))))

    def tagged(frame, side, key, block):
        return frame.select(F.lit(side).alias("side"), F.col(key), V.as_double("vector").alias("vector"), block.alias("block"))

    schema = T.StructType(
        [
            T.StructField("side", T.IntegerType()),
            T.StructField("user_id", uid),
            T.StructField("item_id", iid),
            T.StructField("vector", T.ArrayType(T.DoubleType())),
        ]
    )
    factors = tagged(users, USER, "user_id", block_of("user_id", blocks)).unionByName(
        tagged(items, ITEM, "item_id", block_of("item_id", blocks)), allowMissingColumns=True
    )
    factors = cut_lineage(factors.select(*schema.names))
    run = _stratum(lr, reg, to_arrow_schema(schema))
    for stratum in [s for _ in range(epochs) for s in range(blocks)]:
        cell = F.when(F.col("side") == USER, block_of("user_id", blocks)).otherwise(
            F.pmod(block_of("item_id", blocks) - stratum, F.lit(blocks))
        )
        own = known.filter(F.col("stratum") == stratum).select(
            F.lit(EXAMPLE).alias("side"), "user_id", "item_id", "label", "_order", F.col("ub").alias("cell")
        )
        rows = factors.withColumn("cell", cell).unionByName(own, allowMissingColumns=True)
        dealt = rows.repartitionById(blocks, F.col("cell")).sortWithinPartitions("cell", "side", "_order", "user_id", "item_id", "label")
        moved = cut_lineage(dealt.mapInArrow(run, schema))
        drop_step(factors)
        factors = moved
    drop_step(known)
    return (
        factors.filter(F.col("side") == USER).select("user_id", "vector"),
        factors.filter(F.col("side") == ITEM).select("item_id", "vector"),
    )


def fit_sequential(examples: DataFrame, dim: int, order: str, epochs: int = 1, seed=0, **how) -> tuple[DataFrame, DataFrame]:
    """train_sequential from factors drawn by id."""
    spark = examples.sparkSession

    def start(key):
        kind = examples.schema[key].dataType.simpleString()
        none = spark.createDataFrame([], f"{key} {kind}, vector array<double>")
        return cut_lineage(factors_or_init(examples.filter(F.col(key).isNotNull()), none, key, dim, seed))

    return train_sequential(examples, start("user_id"), start("item_id"), order, epochs, **how)
