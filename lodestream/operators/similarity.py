"""Exact and approximate top-k search between two vector tables.

Exact search compares every query with every item. The comparison is laid out
as a grid of cells: each item belongs to one item lane and is copied to every
query lane, each query belongs to one query lane and is copied to every item
lane, so that each pair meets in exactly one cell. Lanes come from a hash of
the id, which keeps cells even whatever the data looks like. A task holds the
items of its cell, streams the queries past them, and lets out only the best k
per query, so pairs never exist as rows.

The answer does not depend on the grid. Vectors that are null, empty or hold a
null or a component that is not finite take no part on either side; a query is
compared with the items of its own size. Rows that agree in id and vector count
once; an id with several vectors is several items, or several queries with k
rows each.

Approximate search is the same scan with the cells taken from the nearest
centroids (an inverted-file layout); a list with many items or many queries is
cut into lanes of both.
"""

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lodestream.functions import vectors as V
from lodestream.operators import clusters

ITEMS_PER_CELL = 65536
QUERIES_PER_CELL = 1024
QUERIES_PER_BUCKET = 8192
CELLS = 64
PAIRS_PER_CELL = 1 << 34
#: Vector components of the items that a task holds, and items, however short their vectors are.
VALUES_PER_CELL = 1 << 24
SHORT_ITEMS_PER_CELL = 1 << 19
QUERY_BLOCK = 512
ITEM_BLOCK = 4096
CHUNK = 65536
#: Items of a box of near ones; by dot product a query reads only boxes that can reach its bar.
BOX = 1024
RANK_DIGITS = 9
ITEM, SEEN, QUERY = 0, 1, 2


def _matrices(column) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, places, rows) of the vectors of each size."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(lists.offsets.to_numpy())
    for size in np.unique(sizes):
        places = np.flatnonzero(sizes == size)
        own = lists if len(places) == len(lists) else lists.take(pa.array(places))
        yield int(size), places, own.flatten().to_numpy(zero_copy_only=False).reshape(len(places), int(size))


def _normalized(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row norms, and the rows at unit length; zero rows stay zero."""
    norms = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
    return norms, matrix / np.where(norms > 0, norms, 1.0)[:, None]


class _Found(NamedTuple):
    """Chosen pairs: query row, item position, score, dot product, rank key."""

    rows: np.ndarray
    cols: np.ndarray
    score: np.ndarray
    dot: np.ndarray
    key: np.ndarray

    @classmethod
    def joined(cls, parts):
        """parts as one, by query, key descending and item position."""
        whole = cls(*(np.concatenate(columns) for columns in zip(*parts)))
        return whole.taken(np.lexsort((whole.cols, -whole.key, whole.rows)))

    def taken(self, chosen):
        return _Found(*(column[chosen] for column in self))

    def places(self):
        return np.arange(len(self.rows)) - np.searchsorted(self.rows, self.rows, side="left")

    def first(self, k):
        return self.taken(self.places() < k)


def _near(matrix: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """rows in groups of a BOX, all full but the last: halved along the component that differs most."""
    if len(rows) <= BOX:
        return [rows]
    half = -(-len(rows) // BOX) // 2 * BOX
    order = np.argpartition(_widest(matrix, rows), half)
    return _near(matrix, rows[order[:half]]) + _near(matrix, rows[order[half:]])


def _widest(matrix: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The component of rows that differs most, without a copy of them all."""
    low, high = [], []
    for at in range(0, len(rows), CHUNK):
        own = matrix[rows[at : at + CHUNK]]
        low.append(own.min(axis=0))
        high.append(own.max(axis=0))
    return matrix[rows, np.argmax(np.max(high, axis=0).astype(np.float64) - np.min(low, axis=0))]


def _bounds(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least and largest components and the greatest length in each BOX of rows."""
    starts = np.arange(0, len(matrix), BOX)
    blocks = (matrix[n : n + BOX].astype(np.float64) for n in starts)
    longest = np.array([np.sqrt(np.einsum("ij,ij->i", b, b).max()) for b in blocks])
    return *(f.reduceat(matrix, starts, axis=0).astype(np.float64) for f in (np.minimum, np.maximum)), longest


class _Items:
    """Items of one cell and one size, sorted by id, repeated rows once."""

    def __init__(self, ids, matrix, carried):
        order = pc.array_sort_indices(ids)
        ids, matrix = ids.take(order), matrix[order.to_numpy()]
        codes = pc.dictionary_encode(ids, null_encoding="encode")
        self.code = codes.indices.to_numpy()
        fresh = np.ones(len(matrix), bool)
        fresh[1:] = self.code[1:] != self.code[:-1]
        again = np.flatnonzero(~fresh)
        fresh[again] = (matrix[again] != matrix[again - 1]).any(axis=1)
        if not fresh.all():
            keep = pa.array(np.flatnonzero(fresh))
            order, ids, matrix, self.code = order.take(keep), ids.take(keep), matrix[fresh], self.code[fresh]
        self.ids, self.matrix, self.names = ids, matrix, codes.dictionary
        self.carried = [c.take(order) for c in carried]
        self.boxes = None

    def in_boxes(self):
        """The rows dealt to boxes of near ones, and their places by id."""
        if self.boxes is None:
            order = np.concatenate(_near(self.matrix, np.arange(len(self.matrix), dtype=np.int32)))
            # the rows are kept once, in this order
            self.matrix = self.matrix[order]
            self.boxes = self.matrix, order, *_bounds(self.matrix)
        return self.boxes

    def places_of(self, rows, ids):
        """(row, place) of every item that has a row's id."""
        at = pc.index_in(ids, value_set=self.names)
        known = pc.is_valid(at).to_numpy(zero_copy_only=False)
        code, rows = at.drop_null().to_numpy(), rows[known]
        first = np.searchsorted(self.code, code, side="left")
        n = np.searchsorted(self.code, code, side="right") - first
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(rows, n), np.repeat(first, n) + step


class _Cell:
    """Items of one cell by vector size, and the pairs the current bucket must leave out."""

    def __init__(self, carry):
        self.carry, self.item_parts, self.seen_parts, self.by_size = carry, [], [], None

    def add(self, side, part):
        """Keep a part's own columns, copied: a slice would hold its whole batch, the queries' empty columns too."""
        columns = ["iid", "ivec", *self.carry] if side == ITEM else ["qid", "iid"]
        (self.item_parts if side == ITEM else self.seen_parts).append(part.select(columns).take(pa.array(np.arange(part.num_rows))))

    def _prepare(self):
        self.by_size = {}
        if self.item_parts:
            whole = pa.Table.from_batches(self.item_parts)
            self.item_parts = []
            whole = whole.combine_chunks()
            columns = {c: whole.column(c).combine_chunks() for c in ("iid", "ivec", *self.carry)}
            del whole
            for size, places, matrix in _matrices(columns.pop("ivec")):
                take = pa.array(places)
                carried = [columns[c].take(take) for c in self.carry]
                self.by_size[size] = _Items(columns["iid"].take(take), matrix, carried)
                del matrix

    def forget_seen(self):
        self.seen_parts = []

    def _hidden(self, items, qids, drop_self):
        """(query row, item position) pairs that must not be returned."""
        found = []
        if drop_self:
            found.append(items.places_of(np.arange(len(qids)), qids))
        if self.seen_parts:
            ids = pa.concat_arrays([p.column("qid") for p in self.seen_parts])
            others = pa.concat_arrays([p.column("iid") for p in self.seen_parts])
            names = pc.dictionary_encode(qids, null_encoding="encode")
            at = pc.index_in(ids, value_set=names.dictionary)
            known = pc.is_valid(at)
            row, place = items.places_of(at.filter(known).to_numpy(), others.filter(known))
            # a query id with several vectors hides the item from each
            code = names.indices.to_numpy()
            order = np.argsort(code, kind="stable")
            first = np.searchsorted(code[order], row, side="left")
            n = np.searchsorted(code[order], row, side="right") - first
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            found.append((order[np.repeat(first, n) + step], np.repeat(place, n)))
        if not found:
            return None
        return tuple(np.concatenate(c).astype(np.int64) for c in zip(*found))

    def best(self, queries, metric, drop_self):
        """(items, query places, found) by vector size: best k items of each query, where k is the query's own."""
        if self.by_size is None:
            self._prepare()
        for size, places, qmat in _matrices(queries.column("qvec")):
            items = self.by_size.get(size)
            if items is None:
                continue
            own = queries.take(pa.array(places))
            qids, ks = own.column("qid"), own.column("k").to_numpy()
            qmat = qmat.astype(np.float64)
            hidden = self._hidden(items, qids, drop_self)
            self.matrix, self.order, *self.bounds = items.in_boxes() if metric == "dot" else (items.matrix, None)
            if hidden is not None and self.order is not None:
                turned = np.empty(len(self.order), np.int64)
                turned[self.order] = np.arange(len(self.order))
                hidden = hidden[0], turned[hidden[1]]
            found = []
            for q0 in range(0, len(qmat), QUERY_BLOCK):
                q1 = min(q0 + QUERY_BLOCK, len(qmat))
                found.append(self._block(qmat[q0:q1], q0, max(1, int(ks[q0:q1].max())), metric, hidden))
            best = _Found.joined(found)
            yield items, places, best.first(ks[best.rows])

    def _reach(self, q):
        """The most that each query's product with an item of each box can be; an overflow counts as the most."""
        low, high, longest = self.bounds
        with np.errstate(over="ignore", invalid="ignore"):
            by_length = np.sqrt(np.einsum("ij,ij->i", q, q))[:, None] * longest
            by_box = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T + by_length * 1e-9
            most = np.minimum(by_length * (1 + 1e-9), by_box)
        return np.where(np.isnan(most), np.inf, most)

    def _visits(self, q, metric, lowest):
        """(first item, end, queries) to compare; by dot product each query's best box first, then those that reach its bar by then."""
        if metric != "dot":
            for i0 in range(0, len(self.matrix), ITEM_BLOCK):
                yield i0, min(i0 + ITEM_BLOCK, len(self.matrix)), np.arange(len(q))
            return
        reach = self._reach(q)
        home = reach.argmax(axis=1)
        for box in np.unique(home):
            yield box * BOX, min(box * BOX + BOX, len(self.matrix)), np.flatnonzero(home == box)
        for box in np.argsort(-reach.max(axis=0), kind="stable"):
            some = np.flatnonzero((reach[:, box] >= lowest) & (home != box))
            if len(some):
                yield box * BOX, min(box * BOX + BOX, len(self.matrix)), some

    def _block(self, q, q0, k, metric, hidden):
        """Best k of each of a block of queries, the items taken a block at a time.

        The cut is made on unrounded scores, a rounding step below the k-th so
        far: that keeps every pair whose rounded score can still be among the k.
        Later blocks only meet that bar, and few of their pairs pass it. By dot
        product a query meets its most promising box first, and no box in which
        nothing can pass its bar.
        """
        unit = metric == "cosine"
        q_scale, q_side = _normalized(q) if unit else (None, q)
        parts, held = [], 0
        lowest = np.full(len(q), -np.inf)
        for i0, i1, some in self._visits(q, metric, lowest):
            part = self.matrix[i0:i1].astype(np.float64)
            i_scale, i_side = _normalized(part) if unit else (None, part)
            score = q_side[some] @ i_side.T
            if metric == "l2":
                squares = np.einsum("ij,ij->i", q, q)[:, None] + np.einsum("ij,ij->i", part, part)[None, :]
                score *= 2.0
                score -= squares
                np.minimum(score, 0.0, out=score)
            score[np.isnan(score)] = -np.inf  # an overflow ranks last
            if hidden is not None:
                r, c = hidden
                here = (r >= q0) & (r < q0 + len(q)) & (c >= i0) & (c < i1)
                at, c = np.searchsorted(some, r[here] - q0), c[here] - i0
                met = some[np.minimum(at, len(some) - 1)] == r[here] - q0
                score[at[met], c[met]] = -np.inf
            above = score >= np.maximum(lowest[some], np.finfo(np.float64).min)[:, None]
            if score.shape[1] > k and np.count_nonzero(above) > 4 * k * len(some):
                bar = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
                above &= score >= (bar - 10.0**-RANK_DIGITS)[:, None]
            r, c = np.nonzero(above)
            chosen = score[r, c]
            if unit:
                dots = chosen * q_scale[r] * i_scale[c]
            else:
                dots = chosen if metric == "dot" else (chosen + squares[r, c]) / 2.0
            cols = c + i0 if self.order is None else self.order[c + i0]
            parts.append(_Found(some[r] + q0, cols, chosen, dots, np.round(chosen, RANK_DIGITS)))
            held += len(r)
            if held >= k * len(q):
                best = _Found.joined(parts).first(k)
                parts, held = [best], 0
                last = np.flatnonzero(best.places() == k - 1)
                lowest[best.rows[last] - q0] = best.score[last] - 10.0**-RANK_DIGITS
        return _Found.joined(parts).first(k)


def _fresh(part, before):
    """Places of queries that do not repeat the one before them, and the last one's mark."""
    qid, tag = part.column("qid"), part.column("qtag")
    codes, tags = pc.dictionary_encode(qid, null_encoding="encode").indices.to_numpy(), tag.to_numpy()
    fresh = np.ones(len(tags), bool)
    fresh[1:] = (codes[1:] != codes[:-1]) | (tags[1:] != tags[:-1])
    fresh[0] = before != (qid[0].as_py(), tags[0])
    return fresh, (qid[-1].as_py(), tags[-1])


def _scan(metric, drop_self, schema, carry):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, bucket, cell, before = None, None, None, None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            marks = np.stack([batch.column(c).to_numpy() for c in ("cell", "bucket", "side")])
            cells, buckets, sides = marks
            turns = (marks[:, 1:] != marks[:, :-1]).any(axis=0)
            cuts = [0, *(np.flatnonzero(turns) + 1), len(cells)]
            for start, stop in zip(cuts, cuts[1:]):
                if cells[start] != current:
                    current, cell, before = cells[start], _Cell(carry), None
                if buckets[start] != bucket:
                    bucket = buckets[start]
                    cell.forget_seen()
                part = batch.slice(start, stop - start)
                if sides[start] != QUERY:
                    cell.add(sides[start], part)
                    continue
                fresh, before = _fresh(part, before)
                if not fresh.all():
                    part = part.filter(pa.array(fresh))
                if part.num_rows == 0:
                    continue
                for items, places, best in cell.best(part, metric, drop_self):
                    rows, cols = pa.array(places[best.rows]), pa.array(best.cols)
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column("qid").take(rows),
                            part.column("qtag").take(rows),
                            items.ids.take(cols),
                            pa.array(best.score),
                            pa.array(best.dot),
                            pa.array(best.key),
                            pa.array((best.places() + 1).astype(np.int32)),
                            part.column("k").take(rows),
                            *[column.take(cols) for column in items.carried],
                        ],
                        schema=schema,
                    )

    return run


def _lane(column, lanes):
    return F.pmod(F.xxhash64(column), F.lit(lanes)).cast("int")


def _sides(items, queries, seen=None):
    """One frame of items, queries and left-out pairs, ordered within each cell.

    Items come first, then bucket by bucket the pairs to leave out and the
    queries, so that only one bucket's pairs are held at a time.
    """
    shape = {f.name: f.dataType for frame in (items, queries) for f in frame.schema.fields}

    def blank(kind):
        # in Arrow a run of null lists takes time with the square of its length, empty ones do not
        return (F.array() if isinstance(kind, T.ArrayType) else F.lit(None)).cast(kind)

    def tagged(frame, side):
        bucket = F.lit(-1) if side == ITEM else F.col("bucket")
        own = {"side": F.lit(side), "bucket": bucket.cast("int")}
        rest = {n: F.col(n) if n in frame.columns else blank(t) for n, t in shape.items()}
        return frame.select(*[c.alias(n) for n, c in {**rest, **own}.items()])

    out = tagged(items, ITEM).unionByName(tagged(queries, QUERY))
    return out if seen is None else out.unionByName(tagged(seen, SEEN))


def _result_types(queries, items, carry):
    fields = [
        T.StructField("qid", queries.schema["qid"].dataType),
        T.StructField("qtag", T.LongType()),
        T.StructField("iid", items.schema["iid"].dataType),
        T.StructField("score", T.DoubleType()),
        T.StructField("dot", T.DoubleType()),
        T.StructField("rank_key", T.DoubleType()),
        T.StructField("place", T.IntegerType()),
        T.StructField("depth", T.IntegerType()),
        *[T.StructField(c, items.schema[c].dataType) for c in carry],
    ]
    schema = T.StructType(fields)
    return schema, to_arrow_schema(schema)


def searchable(vector) -> F.Column:
    """Whether a vector takes part in a search."""
    return F.coalesce((F.size(vector) > 0) & V.all_finite(vector), F.lit(False))


def _depth(k):
    return F.lit(k) if isinstance(k, int) else k


def _inputs(queries, items, query_id, query_vec, item_id, item_vec, k, carry=()):
    q = queries.filter(searchable(query_vec)).select(
        F.col(query_id).alias("qid"), F.col(query_vec).alias("qvec"), _depth(k).cast("int").alias("k")
    )
    i = items.filter(searchable(item_vec)).select(F.col(item_id).alias("iid"), F.col(item_vec).alias("ivec"), *carry)
    return q.withColumn("qtag", F.xxhash64("qvec", "k")), i


def _renamed(ranked, query_id, item_id, carry=()):
    left = query_id if query_id != item_id else f"query_{query_id}"
    return ranked.select(F.col("qid").alias(left), F.col("iid").alias(item_id), "score", "dot", "rank", *carry)


def _merge(found):
    by_query = Window.partitionBy("qid", "qtag").orderBy(F.col("rank_key").desc(), F.col("iid"))
    return found.withColumn("rank", F.row_number().over(by_query))


def _grid(n_items: int, n_queries: int, least: int, slots: int, k) -> tuple[int, int]:
    """(item lanes, query lanes) of the grid that sends the fewest rows.

    An item is sent once for each query lane, a query once for each item lane,
    and brings back k rows from each if there are several. The number of cells
    is fixed but for searches so large that their cells would run long, so what
    is sent grows no faster than the rows until cells are full of items.
    """
    cells = min(slots, max(CELLS, math.ceil(n_items * n_queries / PAIRS_PER_CELL)))
    deep = (k if isinstance(k, int) else 20) / 8

    def across(item_lanes):
        return min(max(1, math.ceil(n_queries / QUERIES_PER_CELL)), math.ceil(cells / item_lanes))

    def sent(item_lanes):
        return n_items * across(item_lanes) + n_queries * item_lanes * (1 if item_lanes == 1 else 1 + deep)

    most = max(least, min(cells, n_items // QUERIES_PER_BUCKET))
    item_lanes = min(range(least, most + 1), key=sent)
    return item_lanes, across(item_lanes)


def top_k(
    queries: DataFrame,
    items: DataFrame,
    k,
    metric: str = "cosine",
    query_id: str = "user_id",
    query_vec: str = "embedding",
    item_id: str = "item_id",
    item_vec: str = "embedding",
    exclude_self: bool = False,
    seen: DataFrame | None = None,
    items_per_cell: int | None = None,
    query_rows: int | None = None,
    item_rows: int | None = None,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Exact best k items per query: (query id, item id, score, dot, rank, carried item columns).

    metric is cosine, dot or l2 (negative squared distance). k is a number or
    a column of queries. Ties on the score rounded to nine digits go to the
    smaller id. exclude_self leaves out the item with the query's own id;
    seen is a frame of (query id, item id) pairs to leave out. When query and
    item ids have the same name, the query's becomes query_<name>.

    carry names item columns to return along, which saves joining them back.
    query_rows and item_rows, exact or estimated, size the grid; a missing one
    is counted, which is all that reaches the driver. Where items are counted,
    so are their vectors' components, and a cell holds as many items as these
    allow unless items_per_cell is given. Which vectors take part, and what
    repeated ids mean, is said above.
    """
    q, i = _inputs(queries, items, query_id, query_vec, item_id, item_vec, k, carry)
    n_items, least, most = item_rows, 1, items_per_cell or (ITEMS_PER_CELL if item_rows is not None else SHORT_ITEMS_PER_CELL)
    if item_rows is None:
        found = i.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("ivec").cast("long")), F.lit(0)).alias("values")).first()
        n_items, least = found.n, math.ceil(found["values"] / VALUES_PER_CELL)
    n_queries = q.count() if query_rows is None else query_rows
    slots = int(q.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    item_lanes, query_lanes = _grid(n_items, n_queries, max(1, least, math.ceil(n_items / most)), slots, k)
    buckets = max(1, math.ceil(n_queries / query_lanes / QUERIES_PER_BUCKET))

    def cell(item_lane, query_lane):
        return (item_lane * F.lit(query_lanes) + query_lane).cast("int")

    def each(lanes):
        return F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)))

    bucket = F.pmod(F.xxhash64("qid", F.lit("bucket")), F.lit(buckets)).alias("bucket")
    item_lane, query_lane = _lane("iid", item_lanes), _lane("qid", query_lanes)
    items_in = i.select("*", each(query_lanes).alias("_l")).withColumn("cell", cell(item_lane, F.col("_l"))).drop("_l")
    queries_in = q.select("*", each(item_lanes).alias("_l")).select(
        "qid", "qvec", "k", "qtag", cell(F.col("_l"), query_lane).alias("cell"), bucket
    )
    seen_in = None
    if seen is not None:
        pairs = seen.select(F.col(query_id).alias("qid"), F.col(item_id).alias("iid")).distinct()
        seen_in = pairs.select("*", cell(item_lane, query_lane).alias("cell"), bucket)
    cells = (
        _sides(items_in, queries_in, seen_in)
        .repartitionById(item_lanes * query_lanes, F.col("cell"))
        .sortWithinPartitions("cell", "bucket", "side", "qid", "qtag")
    )
    schema, arrow_schema = _result_types(q, i, carry)
    found = cells.mapInArrow(_scan(metric, exclude_self, arrow_schema, carry), schema)
    if item_lanes == 1:
        ranked = found.withColumn("rank", F.col("place"))
    else:
        ranked = _merge(found).filter(F.col("rank") <= (k if isinstance(k, int) else F.col("depth")))
    return _renamed(ranked, query_id, item_id, carry)


def _with_lists(frame: DataFrame, vector: str, centres: np.ndarray, n: int) -> DataFrame:
    """frame with the numbers of the n nearest lists of a vector; an unusual size has a list of its own."""
    schema = T.StructType([*frame.schema.fields, T.StructField("lists", T.ArrayType(T.IntegerType()))])

    def run(batches):
        for batch in batches:
            lists = [None] * batch.num_rows
            for size, places, matrix in _matrices(batch.column(vector)):
                if size == centres.shape[1]:
                    _, units = _normalized(matrix.astype(np.float64))
                    found = clusters.nearest(units, centres, min(n, len(centres))).tolist()
                else:
                    found = [[-size]] * len(places)
                for place, own in zip(places, found):
                    lists[place] = own
            yield batch.append_column("lists", pa.array(lists, pa.list_(pa.int32())))

    return frame.mapInArrow(run, schema)


def ann_top_k(
    queries: DataFrame,
    items: DataFrame,
    k,
    n_lists: int,
    n_probe: int,
    query_id: str = "user_id",
    query_vec: str = "embedding",
    item_id: str = "item_id",
    item_vec: str = "embedding",
    exclude_self: bool = False,
    items_per_cell: int = ITEMS_PER_CELL,
    queries_per_cell: int = QUERIES_PER_BUCKET,
    item_rows: int | None = None,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Approximate best k by cosine: each query searches its n_probe nearest of n_lists lists.

    Stands in for a graph index, whose layered walk is a single-machine
    structure. Every candidate in a probed list is scored exactly; n_probe =
    n_lists gives the exact answer. Lists are assigned in the tasks that read
    the vectors. The lengths of the lists, counted on both sides, reach the
    driver and decide how many lanes of items and of queries a list is cut
    into: a list with many queries copies its items, one with many items its
    queries. Vectors that take no part are those of the exact search.
    """
    q, i = _inputs(queries, items, query_id, query_vec, item_id, item_vec, k, carry)
    rows = i.count() if item_rows is None else item_rows
    centres = clusters.centroids(i.select("iid", V.normalize("ivec").alias("unit")), n_lists, rows)
    stored = _with_lists(i, "ivec", centres, 1).withColumn("list", F.col("lists")[0]).drop("lists")
    asked = _with_lists(q, "qvec", centres, n_probe).withColumn("list", F.explode("lists")).drop("lists")
    found = _in_lists(stored, asked, "cosine", exclude_self, carry, items_per_cell, queries_per_cell)
    depth = k if isinstance(k, int) else F.col("depth")
    return _renamed(_merge(found).filter(F.col("rank") <= depth), query_id, item_id, carry)


def in_cells(stored, asked, item_columns, query_columns, items_per_cell, queries_per_cell, seen=None) -> DataFrame:
    """Items and the queries that ask for their list, dealt to cells and ordered within them, as a scan reads them.

    stored (iid, list, item_columns) and asked (qid, list, query_columns); a list
    with many queries copies its items, one with many items its queries, to
    lanes. seen pairs (qid, iid) are sent to the one cell where they matter. The
    lists' lengths on both sides reach the driver.
    """
    lengths = {}
    for side, frame in enumerate((stored, asked)):
        for r in frame.groupBy("list").count().collect():
            lengths.setdefault(r["list"], [0, 0])[side] = r["count"]
    plan, n_cells = [], 0
    for name, (n_items, n_queries) in sorted(lengths.items()):
        if n_items and n_queries:
            item_lanes, query_lanes = math.ceil(n_items / items_per_cell), math.ceil(n_queries / queries_per_cell)
            plan.append((name, n_cells, item_lanes, query_lanes))
            n_cells += item_lanes * query_lanes
    lanes = stored.sparkSession.createDataFrame(plan, "list bigint, base int, item_lanes int, query_lanes int")

    def lane(column, n):
        return F.pmod(F.xxhash64(column), F.col(n)).cast("int")

    def cell(item_lane, query_lane):
        return (F.col("base") + item_lane * F.col("query_lanes") + query_lane).cast("int").alias("cell")

    def each(n):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias("_l")

    bucket = F.lit(0).alias("bucket")
    items_in = stored.join(lanes, "list").select("*", each("query_lanes"))
    items_in = items_in.select("iid", *item_columns, cell(lane("iid", "item_lanes"), F.col("_l")))
    queries_in = asked.join(lanes, "list").select("*", each("item_lanes"))
    queries_in = queries_in.select("qid", *query_columns, cell(F.col("_l"), lane("qid", "query_lanes")), bucket)
    seen_in = None
    if seen is not None:
        placed = seen.distinct().join(stored.select("iid", "list").distinct(), "iid").join(lanes, "list")
        seen_in = placed.select("qid", "iid", cell(lane("iid", "item_lanes"), lane("qid", "query_lanes")), bucket)
    return (
        _sides(items_in, queries_in, seen_in)
        .repartition(F.col("cell"))
        .sortWithinPartitions("cell", "bucket", "side", "qid", "qtag")
    )


def _in_lists(stored, asked, metric, drop_self, carry, items_per_cell, queries_per_cell, seen=None) -> DataFrame:
    """Best items of each query within the lists it asks for; stored (iid, ivec, carried, list), asked (qid, qvec, k, qtag, list)."""
    cells = in_cells(stored, asked, ("ivec", *carry), ("qvec", "k", "qtag"), items_per_cell, queries_per_cell, seen)
    schema, arrow_schema = _result_types(asked, stored, carry)
    return cells.mapInArrow(_scan(metric, drop_self, arrow_schema, carry), schema)


def top_k_in_lists(
    queries: DataFrame,
    items: DataFrame,
    k,
    lists: str,
    list_of: str,
    metric: str = "cosine",
    query_id: str = "user_id",
    query_vec: str = "embedding",
    item_id: str = "item_id",
    item_vec: str = "embedding",
    seen: DataFrame | None = None,
    items_per_cell: int = ITEMS_PER_CELL,
    queries_per_cell: int = QUERIES_PER_BUCKET,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Exact best k among the items whose list_of is in the query's array lists; a null array stands for all.

    So a filter on a column of few values, such as a category, holds before the
    cut and not after it, and no other item is compared. The values and their
    numbers of rows reach the driver. seen leaves pairs out, as in top_k.
    """
    q, i = _inputs(
        queries, items, query_id, query_vec, item_id, item_vec, k, tuple(dict.fromkeys([*carry, list_of]))
    )
    wanted = queries.select(F.col(query_id).alias("qid"), F.xxhash64(query_vec, _depth(k).cast("int")).alias("qtag"), F.col(lists).alias("_l"))
    stored = i.withColumn("list", F.xxhash64(list_of))
    every = [r[0] for r in stored.select("list").distinct().collect()]
    names = F.when(F.col("_l").isNull(), F.array(*[F.lit(n) for n in every]).cast("array<bigint>")).otherwise(
        F.transform("_l", lambda n: F.xxhash64(n))
    )
    asked = q.join(wanted.select("qid", "qtag", F.explode(F.array_distinct(names)).alias("list")).distinct(), ["qid", "qtag"])
    pairs = None if seen is None else seen.select(F.col(query_id).alias("qid"), F.col(item_id).alias("iid"))
    found = _in_lists(stored, asked, metric, False, carry, items_per_cell, queries_per_cell, pairs)
    depth = k if isinstance(k, int) else F.col("depth")
    return _renamed(_merge(found).filter(F.col("rank") <= depth), query_id, item_id, carry)


def search(queries: DataFrame, items: DataFrame, k, index: tuple[int, int] | None = None, **how) -> DataFrame:
    """top_k by cosine, or ann_top_k where an index (lists, probes) is asked for."""
    if index is None:
        return top_k(queries, items, k, "cosine", **how)
    how.pop("query_rows", None)
    return ann_top_k(queries, items, k, *index, **how)


def similar(
    vectors: DataFrame, keys: DataFrame, k: int, key: str, vec: str = "embedding", index: tuple[int, int] | None = None, **grid
) -> DataFrame:
    """The k rows of vectors most alike each key, the key itself left out.

    A key without a row gives no result. Leaving the row itself out before
    ranking equals searching k+1 and dropping it, except under exact ties.
    """
    asked = keys.select(key).distinct().join(vectors.select(key, vec), key)
    return search(
        asked, vectors, k, index, query_id=key, query_vec=vec, item_id=key, item_vec=vec, exclude_self=True, **grid
    )
