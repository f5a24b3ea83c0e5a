"""Helpers the operators of this subpackage share."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lodestream.functions.batches import complete_groups as complete
from lodestream.functions.batches import group_bounds as bounds
from lodestream.session import cut_lineage, ship_package
from lodestream.session import drop_step as unlink

__all__ = [
    "arrow", "bounds", "complete", "cut_lineage", "forest", "mix", "row_key", "ship_package", "table", "text_bytes", "unlink",
    "wide_key",
]

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(*columns) -> F.Column:
    """64-bit key of a row: rows with the same values, nulls included, get the same."""
    nulls = [F.isnull(c) for c in columns]
    return F.xxhash64(*columns, *nulls)


def wide_key(*columns) -> F.Column:
    """128-bit key of a row, for tables whose size makes equal 64-bit keys of different rows likely."""
    nulls = [F.isnull(c) for c in columns]
    return F.struct(F.xxhash64(*columns, *nulls).alias("a"), F.xxhash64(F.lit(1), *columns, *nulls).alias("b"))


def arrow(df: DataFrame, function, schema: StructType | str) -> DataFrame:
    """mapInArrow where function(batches) yields dicts of columns.

    A reused worker hands what a task's batches took back to the system.
    """
    target = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    names, kinds = target.names, to_arrow_schema(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in function(b for b in batches if b.num_rows):
            arrays = [
                columns[n]
                if isinstance(columns[n], (pa.Array, pa.ChunkedArray))
                else pa.array(columns[n], type=kinds.field(n).type)
                for n in names
            ]
            yield from pa.Table.from_arrays(arrays, schema=kinds).combine_chunks().to_batches()
            del columns, arrays
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, target)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its component) that link the same nodes as the edges (a, b)."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = place[: len(a)], place[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, label[left], low)
        np.minimum.at(label, label[right], low)
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped
        if (label == before).all():
            break
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column as one array, and the rows' starts; a null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary())
    column = column if column.null_count == 0 else pa.compute.fill_null(column, b"")
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[starts[0] : starts[-1]], starts - starts[0]


def mix(values: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values over 64 bits."""
    values = (values ^ (values >> np.uint64(30))) * _M1
    values = (values ^ (values >> np.uint64(27))) * _M2
    return values ^ (values >> np.uint64(31))
