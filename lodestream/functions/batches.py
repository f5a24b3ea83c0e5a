"""Apply a function to consecutive chunks of rows, or to sorted groups."""

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame


def score_batches(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema, batch_size: int) -> DataFrame:
    """Concatenated results of fn over chunks of batch_size rows (the last of a partition may be shorter)."""
    if batch_size <= 0:
        raise ValueError("Batch size cannot be zero")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = []
        count = 0
        for frame in frames:
            held.append(frame)
            count += len(frame)
            if count < batch_size:
                continue
            rows = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
            whole = count - count % batch_size
            for start in range(0, whole, batch_size):
                yield fn(rows.iloc[start : start + batch_size])
            held, count = [rows.iloc[whole:]], count - whole
        if count:
            yield fn(pd.concat(held, ignore_index=True))

    return df.mapInPandas(run, schema)


def group_bounds(*columns: np.ndarray) -> np.ndarray:
    """Start of each run of rows with equal values, and the end."""
    turn = np.zeros(len(columns[0]), bool)
    turn[:1] = True
    for c in columns:
        turn[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(turn), len(turn))


def complete_groups(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """Tables that hold whole groups; the rows arrive sorted by keys.

    Held back are only the rows of the last, perhaps unfinished, group.
    """
    held, held_key = [], None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        last = tuple(batch.column(k)[-1].as_py() for k in keys)
        differs = np.zeros(batch.num_rows, bool)
        for k in keys:
            codes = pc.dictionary_encode(batch.column(k), null_encoding="encode").indices.to_numpy()
            differs |= codes != codes[-1]
        start = int(np.flatnonzero(differs)[-1]) + 1 if differs.any() else 0
        if start == 0 and held and held_key != last:
            yield pa.Table.from_batches(held)
            held = []
        elif start:
            yield pa.Table.from_batches([*held, batch.slice(0, start)])
            held = []
        held.append(batch.slice(start))
        held_key = last
    if held:
        yield pa.Table.from_batches(held)
