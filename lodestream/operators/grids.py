"""Products and sums of vectors by pairs of ids, the pairs staying narrow.

Joined in the usual way, every pair carries its vectors through a shuffle. Here
the two sides are dealt to lanes by a hash of their ids and a cell is a lane of
each: a pair goes to one cell as a narrow row, a vector to the cells of its lane,
which are few. A task holds the vectors of its cell and streams the pairs past
them. Ids that repeat or are missing mean what they mean in a join.
"""

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lodestream.functions.batches import group_bounds

ROWS = 65536
#: Vector components of a lane, and vectors, however short they are, where ROWS would take more lanes than wanted.
VALUES = 3 << 20
SHORT_ROWS = 1 << 19
CELLS = 64
SUM_CELLS = 24  # fewer, as each lane of sums copies all vectors
LEFT, RIGHT, PAIR = 0, 1, 2
CHUNK = 8192


def lane(column, n: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")


def each(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def wanted_cells(spark) -> int:
    return min(CELLS, int(spark.conf.get("spark.sql.shuffle.partitions")))


class _Vectors:
    """Vectors of a cell, sorted by id; an id may have several. The parts are given up."""

    def __init__(self, parts, key):
        whole = pa.Table.from_batches(parts).select([key, "_x"]).combine_chunks()
        parts.clear()
        ids = whole.column(key).combine_chunks()
        order = pc.array_sort_indices(ids)
        ids = ids.take(order)
        if pa.types.is_integer(ids.type) and ids.null_count == 0:
            cut = group_bounds(ids.to_numpy())
            self.names, self.code = ids.take(pa.array(cut[:-1])), np.repeat(np.arange(len(cut) - 1, dtype=np.int32), np.diff(cut))
        else:
            codes = pc.dictionary_encode(ids)
            self.names, self.code = codes.dictionary, codes.indices.to_numpy()
        self.lists = whole.column("_x").combine_chunks().take(order)
        del whole, ids, order
        self.valid = self.lists.is_valid().to_numpy(zero_copy_only=False)
        offsets = self.lists.offsets.to_numpy()
        self.start, self.size = offsets[:-1] - offsets[0], np.diff(offsets)
        values = self.lists.flatten()
        self.whole = self.valid
        if values.null_count:
            # a component that is null makes products null
            holes = values.is_null().to_numpy(zero_copy_only=False)
            self.whole = self.valid & (np.add.reduceat(np.append(holes, False), np.minimum(self.start, len(holes))) * (self.size > 0) == 0)
        self.values = values.to_numpy(zero_copy_only=False)

    def codes(self, ids):
        """(known, code): which ids there are, and their numbers; whole numbers without a table of all names for each call."""
        if pa.types.is_integer(ids.type) and ids.type == self.names.type and ids.null_count == self.names.null_count == 0 and len(self.names):
            names, asked = self.names.to_numpy(), ids.to_numpy()
            at = np.minimum(np.searchsorted(names, asked), len(names) - 1)
            known = names[at] == asked
            return known, at[known]
        at = pc.index_in(ids, value_set=self.names)
        known = pc.is_valid(at).to_numpy(zero_copy_only=False) & ids.is_valid().to_numpy(zero_copy_only=False)
        return known, at.filter(pa.array(known)).to_numpy()

    def places(self, ids):
        """(rows, places): every row of ids with each vector of its id."""
        known, code = self.codes(ids)
        first = np.searchsorted(self.code, code, side="left")
        n = np.searchsorted(self.code, code, side="right") - first
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(np.flatnonzero(known), n), np.repeat(first, n) + step

    def matrix(self, places, size):
        return self.values[self.start[places][:, None] + np.arange(size)].astype(np.float64)


def _product(left, right, l_at, r_at, cosine):
    """Products of vectors at places; null where a vector is missing (-1), and for dot products where one is not whole."""
    score, null = np.zeros(len(l_at)), (l_at < 0) | (r_at < 0)
    known = np.flatnonzero(~null)
    l, r = l_at[known], r_at[known]
    null[known] = ~(left.valid[l] & right.valid[r])
    fit = left.whole[l] & right.whole[r] & (left.size[l] == right.size[r])
    if not cosine:
        null[known[~fit]] = True
    known, l, r = known[fit], l[fit], r[fit]
    for size in np.unique(left.size[l]):
        own = np.flatnonzero(left.size[l] == size)
        for at in range(0, len(own), CHUNK):
            some = own[at : at + CHUNK]
            a, b = left.matrix(l[some], size), right.matrix(r[some], size)
            value = np.einsum("ij,ij->i", a, b)
            if cosine:
                below = np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b))
                value = np.where(below == 0, 0.0, value / np.where(below == 0, 1.0, below))
            score[known[some]] = value
    return pa.array(score, mask=null)


def _outer(rows, places, n):
    """The same with every row that has no place, at -1, in order of rows."""
    lost = np.setdiff1d(np.arange(n), rows)
    rows, places = np.concatenate([rows, lost]), np.concatenate([places, np.full(len(lost), -1, np.int64)])
    order = np.argsort(rows, kind="stable")
    return rows[order], places[order]


def _by_cell(batches, prepare, kept):
    """(prepared sides, rows of pairs) as the cells' rows come in order of side; of each side only the kept columns are held."""
    now, held, ready = None, None, None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        cells, sides = (batch.column(c).to_numpy() for c in ("_cell", "_side"))
        cut = group_bounds(cells, sides)
        for start, stop in zip(cut, cut[1:]):
            if cells[start] != now:
                now, held, ready = cells[start], {LEFT: [], RIGHT: []}, None
            part = batch.slice(start, stop - start)
            if sides[start] != PAIR:
                # copied, as a slice would hold its whole batch with all columns
                held[sides[start]].append(part.select(kept[sides[start]]).take(pa.array(np.arange(part.num_rows))))
                continue
            if ready is None:
                ready, held = prepare(held), None
            yield now, ready, part


def _dealt(frames, cells: int, order: tuple[str, ...] = ()):
    """One frame of the sides, each cell's rows in order of side."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    # not null where a row has no vector: in Arrow a run of null lists takes time with the square of its length
    vectors = [c for c in ("_x", f"_x{LEFT}", f"_x{RIGHT}") if c in out.columns]
    out = out.withColumns({c: F.coalesce(c, F.array().cast(out.schema[c].dataType)) for c in vectors})
    return out.repartitionById(cells, F.col("_cell")).sortWithinPartitions("_cell", "_side", *order)


def _least_lanes(frame, vec, rows, wide):
    """Lanes that hold a side's vectors: rows in each, else ROWS or, where these are more than wide, as many as their components allow."""
    n = frame.count()
    lanes = max(1, math.ceil(n / (rows or ROWS)))
    if rows is None and lanes > wide:
        size = F.greatest(F.coalesce(F.size(vec), F.lit(0)), F.lit(0)).cast("long")
        values = frame.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
        lanes = min(lanes, max(1, math.ceil(values / VALUES), math.ceil(n / SHORT_ROWS)))
    return lanes


def products(
    pairs: DataFrame,
    left: DataFrame,
    right: DataFrame,
    left_id: str = "user_id",
    right_id: str = "item_id",
    left_vec: str = "embedding",
    right_vec: str = "embedding",
    cosine: bool = True,
    inner: bool = False,
    rows: int | None = None,
    dot: bool = False,
) -> DataFrame:
    """pairs with the score of both ids' vectors: cosine or dot product, in double precision; with dot, the product as well.

    A pair without one of the ids is left out if inner and has a null score
    otherwise. With a vector that is null the product is null. Cosine is 0 for vectors of different sizes, of length zero or with a null in them, a
    dot product null. The two sides' row counts reach the driver, of many rows
    their components' count too: unless rows is given, short vectors share a lane.
    """
    spark = pairs.sparkSession
    # both sides are copied, so that square grids copy least
    wide = max(1, math.isqrt(wanted_cells(spark)))
    l_lanes, r_lanes = (max(_least_lanes(frame, vec, rows, wide), wide) for frame, vec in ((left, left_vec), (right, right_vec)))

    def cell(l, r):
        return (l * F.lit(r_lanes) + r).cast("int").alias("_cell")

    def side(frame, number, key, vec, place):
        known = frame.filter(F.col(key).isNotNull()).select(F.col(key), F.col(vec).alias("_x"))
        if inner:
            # a pair stays with a vector that is null, which a null component stands for
            known = known.withColumn("_x", F.coalesce("_x", F.array(F.lit(None)).cast(frame.schema[vec].dataType.simpleString())))
        else:
            known = known.filter("_x IS NOT NULL")
        return known.select("*", each(l_lanes if number == RIGHT else r_lanes).alias("_l")).select(
            F.lit(number).alias("_side"), place(lane(key, l_lanes if number == LEFT else r_lanes), F.col("_l")), *[F.col(key)], F.col("_x").alias(f"_x{number}")
        )

    kinds = [pairs.schema[c].dataType for c in (left_id, right_id)]
    l_side = side(left.withColumn(left_id, F.col(left_id).cast(kinds[0])), LEFT, left_id, left_vec, cell)
    r_side = side(right.withColumn(right_id, F.col(right_id).cast(kinds[1])), RIGHT, right_id, right_vec, lambda own, far: cell(far, own))
    asked = pairs.select("*", F.lit(PAIR).alias("_side"), cell(lane(left_id, l_lanes), lane(right_id, r_lanes)))
    figures = {"score": cosine} | ({"dot": False} if dot else {})
    schema = T.StructType([*pairs.schema.fields, *[T.StructField(c, T.DoubleType()) for c in figures]])
    shape = to_arrow_schema(schema)

    def prepare(held):
        made = []
        for number, key in ((LEFT, left_id), (RIGHT, right_id)):
            parts = [b.rename_columns(["_x" if c == f"_x{number}" else c for c in b.schema.names]) for b in held.pop(number)]
            made.append(_Vectors(parts, key) if parts else None)
        return made

    kept = {LEFT: [left_id, f"_x{LEFT}"], RIGHT: [right_id, f"_x{RIGHT}"]}

    def run(batches):
        for _, (a, b), part in _by_cell(batches, prepare, kept):
            none, n = (np.zeros(0, np.int64), np.zeros(0, np.int64)), part.num_rows
            found = none if a is None else a.places(part.column(left_id))
            row, l_at = found if inner else _outer(*found, n)
            part = part.take(pa.array(row))
            found = none if b is None else b.places(part.column(right_id))
            row, r_at = found if inner else _outer(*found, part.num_rows)
            if len(row) == 0:
                continue
            l_at = l_at[row]
            known = a is not None and b is not None
            made = [_product(a, b, l_at, r_at, c) if known else pa.nulls(len(row), pa.float64()) for c in figures.values()]
            part = part.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in shape.names[: -len(figures)]], *made], schema=shape)

    return _dealt([asked, l_side, r_side], l_lanes * r_lanes).mapInArrow(run, schema)


def _summed(key, latest, schema):
    """One row for each run of rows with equal keys: vectors and counts added up, the latest time."""

    def of(ids, matrix, n, times):
        cut = group_bounds(pc.dictionary_encode(ids, null_encoding="encode").indices.to_numpy())[:-1]
        return [ids.take(pa.array(cut)), np.add.reduceat(matrix, cut, axis=0), np.add.reduceat(n, cut), np.maximum.reduceat(times, cut)]

    def batch(ids, matrix, n, times):
        offsets = pa.array(np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1])
        kind = schema.field("latest").type
        at = pa.array(times).view(kind) if pa.types.is_timestamp(kind) else pa.array(times, kind)
        lists = pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(matrix).ravel()))
        return pa.RecordBatch.from_arrays([ids, lists, pa.array(n), at], schema=schema)

    def run(parts):
        """Sums of parts (ids, matrix, n, times) in order of ids; a run that goes on in the next part is held back."""
        held = None
        for part in parts:
            part = of(*part)
            if held is not None:
                if held[1].shape[1] != part[1].shape[1]:
                    raise ValueError("vectors of different sizes cannot be added")
                part = of(pa.concat_arrays([held[0], part[0]]), *[np.concatenate([h, p]) for h, p in zip(held[1:], part[1:])])
            if len(part[0]) > 1:
                yield batch(part[0][:-1], *[c[:-1] for c in part[1:]])
            held = [part[0][-1:], *[c[-1:] for c in part[1:]]]
        if held is not None:
            yield batch(*held)

    return run


def _times(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return (column.view(pa.int64()) if pa.types.is_timestamp(column.type) else column.cast(pa.int64())).to_numpy(zero_copy_only=False)


def sums(
    pairs: DataFrame, vectors: DataFrame, by: str, of: str, weight: str, vec: str, n: str = "n", latest: str | None = None, rows: int = ROWS
) -> DataFrame:
    """(by, vector, n, latest): vectors of the pairs' other ids added up with weights, counts added, the latest time.

    A cell is a lane of by and a lane of the vectors; a vector is copied to the
    lanes of by, and each cell lets out one sum for each of its by. Pairs whose
    vector is null, or that have none, are left out; n and latest must not be
    null. Vectors added up must agree in size. The vectors' row count reaches the driver.
    """
    kind = pairs.schema[of].dataType
    known = vectors.filter(F.col(of).isNotNull()).select(F.col(of).cast(kind).alias("_of"), F.col(vec).alias("_x")).filter("_x IS NOT NULL")
    v_lanes = max(1, math.ceil(known.count() / rows))
    by_lanes = max(1, math.ceil(min(SUM_CELLS, wanted_cells(pairs.sparkSession)) / v_lanes))

    def cell(b, v):
        return (b * F.lit(v_lanes) + v).cast("int").alias("_cell")

    held = known.select(F.lit(LEFT).alias("_side"), "_of", "_x", each(by_lanes).alias("_l")).select(
        "_side", "_of", "_x", cell(F.col("_l"), lane("_of", v_lanes))
    )
    time = F.lit(0).cast("bigint") if latest is None else F.col(latest)
    asked = pairs.select(
        F.lit(PAIR).alias("_side"), F.col(by).alias("_by"), F.col(of).alias("_of"), F.col(weight).cast("double").alias("_w"),
        F.col(n).cast("bigint").alias("_n"), time.alias("_t"), cell(lane(by, by_lanes), lane(of, v_lanes)),
    )
    schema = T.StructType(
        [
            T.StructField(by, pairs.schema[by].dataType),
            T.StructField("vector", T.ArrayType(T.DoubleType())),
            T.StructField("n", T.LongType()),
            T.StructField("latest", asked.schema["_t"].dataType),
        ]
    )
    shape = to_arrow_schema(schema)
    add = _summed(by, latest, shape)

    def prepare(sides):
        return _Vectors(sides[LEFT], "_of") if sides[LEFT] else None

    def products_of(table, part):
        """Rows of a part times their vectors, a few at a time."""
        row, place = table.places(part.column("_of"))
        ids, w, n, t = part.column("_by"), part.column("_w").to_numpy(zero_copy_only=False), part.column("_n").to_numpy(zero_copy_only=False), _times(part.column("_t"))
        for at in range(0, len(row), CHUNK):
            r, p = row[at : at + CHUNK], place[at : at + CHUNK]
            sizes = table.size[p]
            if (sizes != sizes[0]).any():
                raise ValueError("vectors of different sizes cannot be added")
            yield ids.take(pa.array(r)), table.matrix(p, sizes[0]) * w[r][:, None], n[r], t[r]

    def run(batches):
        def parts():
            for _, table, part in _by_cell(batches, prepare, {LEFT: ["_of", "_x"]}):
                if table is not None:
                    yield from products_of(table, part)

        yield from add(parts())

    out = _dealt([asked, held], by_lanes * v_lanes, ("_by",)).mapInArrow(run, schema)
    if v_lanes == 1:
        return out

    def again(batches):
        def parts():
            for b in batches:
                if b.num_rows:
                    lists = b.column("vector")
                    yield b.column(by), lists.flatten().to_numpy().reshape(b.num_rows, -1), b.column("n").to_numpy(), _times(b.column("latest"))

        yield from add(parts())

    return out.repartition(F.col(by)).sortWithinPartitions(by).mapInArrow(again, schema)
