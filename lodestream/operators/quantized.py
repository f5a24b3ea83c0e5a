"""Approximate search that prunes: residual codes over inverted lists, then exact scores of a few.

A unit vector is stored as the number of its nearest centre and one byte for
each of some parts of what is left over (product quantisation). A query opens
its nearest lists only. A task holds the codes of a group of lists, a byte a
part instead of eight a component, decodes a list once for all of its queries
that opened it, and lets out the few best of each. These are scored exactly from
their own vectors, so scores and order are those of the exact search.
"""

import itertools
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lodestream.functions import vectors as V
from lodestream.functions.batches import complete_groups, group_bounds
from lodestream.operators import clusters, grids
from lodestream.operators.similarity import ITEM, QUERY, RANK_DIGITS, _depth, _renamed, searchable
from lodestream.session import cut_lineage, drop_step, fresh_dir

CODES = 256
SAMPLE = 64  # training vectors a centre or codeword
RERANK = 8  # exact scores a wanted row
ITEMS_PER_CELL = 1 << 20
QUERIES_PER_CELL = 2048
QUERY_BLOCK = 256
#: Items of a list that make a row of codes.
PACK = 4096
#: Items decoded at once, and estimates a task holds before it cuts them down.
DECODED = 8192
HELD = 1 << 22


class Index(NamedTuple):
    """centres: lists x width; books: parts x codewords x width of a part; codes: list, n, and iid, itag, code of up to
    PACK items together, in order of list; items: iid, itag, ivec and carried columns; lengths: items of each list."""

    centres: np.ndarray
    books: np.ndarray
    codes: DataFrame
    items: DataFrame
    lengths: dict
    item_id: str


def _residuals(centres: np.ndarray):
    def of(units):
        return units - centres[clusters.nearest(units, centres)[:, 0]]

    return of


def _codes(centres: np.ndarray, books: np.ndarray, schema: pa.Schema):
    parts, _, width = books.shape

    def run(batches):
        for batch in batches:
            places, units = clusters.matrix(batch.column("unit"), parts * width)
            home = clusters.nearest(units, centres)[:, 0]
            rest = (units - centres[home]).reshape(-1, parts, width)
            code = np.empty((len(units), parts), np.uint8)
            for part in range(parts):
                code[:, part] = clusters.nearest(rest[:, part], books[part])[:, 0]
            offsets = pa.array(np.arange(len(code) + 1, dtype=np.int32) * parts).buffers()[1]
            own = batch.take(pa.array(places))
            packed = pa.Array.from_buffers(pa.binary(), len(code), [None, offsets, pa.py_buffer(code.tobytes())])
            yield pa.RecordBatch.from_arrays([own.column("iid"), own.column("itag"), pa.array(home), packed], schema=schema)

    return run


def _packed(schema: pa.Schema):
    """Items in order of list as rows of up to PACK."""

    def run(batches):
        for part in complete_groups(batches, "list"):
            part = part.combine_chunks()
            names = part.column("list").to_numpy()
            for first, last in itertools.pairwise(group_bounds(names).tolist()):
                for start in range(first, last, PACK):
                    own = part.slice(start, min(PACK, last - start))
                    code = b"".join(own.column("code").to_pylist())
                    one = lambda c: own.column(c).combine_chunks()
                    ends = pa.array([0, own.num_rows], pa.int32())
                    lists = [pa.ListArray.from_arrays(ends, one(c)) for c in ("iid", "itag")]
                    columns = [pa.array([int(names[start])]), pa.array([own.num_rows]), *lists, pa.array([code], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def build(
    items: DataFrame,
    n_lists: int,
    parts: int,
    item_id: str = "item_id",
    item_vec: str = "embedding",
    carry: tuple[str, ...] = (),
    rounds: int = clusters.ROUNDS,
    sample: int = SAMPLE,
    seed: int = 7,
) -> Index:
    """An index of the items' directions, written to the shared folder.

    parts must divide the vectors' size. Centres and codewords are trained in
    tasks, on about sample vectors for each; every item is then coded in the task
    that reads it. Vectors that are null, empty, not finite or of another size
    than most take no part; zero vectors have no direction and none either.
    Repeated rows count once. The driver gets the centres, the codewords and the
    lists' lengths, all set by the parameters.
    """
    known = items.filter(searchable(item_vec)).select(F.col(item_id).alias("iid"), F.col(item_vec).alias("ivec"), *carry)
    known = known.withColumn("itag", F.xxhash64("ivec"))
    nonzero = F.exists("ivec", lambda x: x != 0)
    units = known.filter(nonzero).select("iid", "itag", V.normalize("ivec").alias("unit"))
    rows = units.count()
    drawn = clusters.drawn(units, "iid", rows, max(n_lists, CODES) * sample, seed)
    start, width = clusters.first_of(drawn, "iid", clusters.CANDIDATES * n_lists)
    start = clusters.spread(start, n_lists, seed)
    if width % parts:
        raise ValueError(f"{parts} parts do not divide {width} components")
    centres = clusters.lloyd(drawn, start[None], rounds=rounds)[0] if width else np.zeros((1, parts))
    first, _ = clusters.first_of(drawn, "iid", CODES)
    residuals = _residuals(centres)
    words = residuals(first) if width else np.zeros((1, parts))
    words = words.reshape(len(words), parts, -1).transpose(1, 0, 2)
    books = clusters.lloyd(drawn, words, rounds=rounds, prepare=residuals)
    drop_step(drawn)
    kind = known.schema["iid"].dataType
    schema = T.StructType(
        [T.StructField("iid", kind), T.StructField("itag", T.LongType()), T.StructField("list", T.LongType()), T.StructField("code", T.BinaryType())]
    )
    coded = units.mapInArrow(_codes(centres, books, to_arrow_schema(schema)), schema).dropDuplicates(["iid", "itag"])
    path = fresh_dir(items.sparkSession, "codes")
    shape = T.StructType(
        [
            T.StructField("list", T.LongType()),
            T.StructField("n", T.LongType()),
            T.StructField("iid", T.ArrayType(kind)),
            T.StructField("itag", T.ArrayType(T.LongType())),
            T.StructField("code", T.BinaryType()),
        ]
    )
    in_order = coded.repartitionByRange("list").sortWithinPartitions("list")
    in_order.mapInArrow(_packed(to_arrow_schema(shape)), shape).write.parquet(path)
    codes = items.sparkSession.read.schema(shape).parquet(path)
    lengths = {r["list"]: r.n for r in codes.groupBy("list").agg(F.sum("n").alias("n")).collect()}
    return Index(centres, books, codes, known, lengths, item_id)


def _layout(lengths: dict, items_per_cell: int) -> dict:
    """list: (its first group of lists, over how many groups its items are spread); a group has about items_per_cell items."""
    out, group, room = {}, 0, items_per_cell
    for name, n in sorted(lengths.items()):
        if n > items_per_cell:
            spread = -(-n // items_per_cell)
            first = group if room == items_per_cell else group + 1
            out[name], group, room = (first, spread), first + spread, items_per_cell
            continue
        if n > room:
            group, room = group + 1, items_per_cell
        out[name], room = (group, 1), room - n
    return out


def _asked(frame: DataFrame, centres: np.ndarray, n: int, layout: dict) -> DataFrame:
    """Queries with their n nearest lists, a row for each group of lists: group, lists; unusual sizes get no row."""
    extra = [T.StructField("group", T.IntegerType()), T.StructField("lists", T.ArrayType(T.LongType()))]
    schema = T.StructType([*frame.schema.fields, *extra])
    width = centres.shape[1]

    def run(batches):
        for batch in batches:
            places, units = clusters.matrix(batch.column("unit"), width)
            rows, groups, lists = [], [], []
            for place, own in zip(places.tolist(), clusters.nearest(units, centres, n).tolist()):
                wanted = {}
                for name in own:
                    first, spread = layout.get(name, (0, 0))
                    for group in range(first, first + spread):
                        wanted.setdefault(group, []).append(name)
                for group, names in wanted.items():
                    rows.append(place)
                    groups.append(group)
                    lists.append(names)
            part = batch.take(pa.array(rows, pa.int64()))
            yield part.append_column("group", pa.array(groups, pa.int32())).append_column("lists", pa.array(lists, pa.list_(pa.int64())))

    return frame.mapInArrow(run, schema)


class _Cell:
    """The codes of a group of lists, and a lane of the queries that ask for them."""

    def __init__(self):
        self.items, self.queries = [], []

    def add(self, side, part):
        (self.items if side == ITEM else self.queries).append(part)

    def best(self, centres: np.ndarray, books: np.ndarray, drop_self: bool):
        """(queries, their rows, items' ids and tags, estimates): the highest estimates of each query.

        A list is decoded once for all of the cell's queries that opened it.
        """
        if not self.items or not self.queries:
            return
        items, queries = (pa.Table.from_batches(x).combine_chunks() for x in (self.items, self.queries))
        parts, _, width = books.shape
        packed = {c: items.column(c).combine_chunks() for c in ("iid", "itag", "code")}
        code = np.frombuffer(b"".join(packed["code"].to_pylist()), np.uint8).reshape(-1, parts)
        ids, tags = packed["iid"].flatten(), packed["itag"].flatten()
        names = np.repeat(items.column("list").to_numpy(), items.column("n").to_numpy())
        place = np.argsort(names, kind="stable")
        names, code = names[place], code[place]
        _, units = clusters.matrix(queries.column("unit"), parts * width)
        units, depth = units.astype(np.float32), queries.column("depth").to_numpy() + drop_self
        wanted = queries.column("lists").combine_chunks()
        asker = np.repeat(np.arange(len(wanted)), np.diff(wanted.offsets.to_numpy()))
        wanted = wanted.flatten().to_numpy()
        order = np.argsort(wanted, kind="stable")
        wanted, asker = wanted[order], asker[order]
        words, found = books.astype(np.float32), []
        for name in np.unique(wanted):
            first, last = np.searchsorted(names, [name, name + 1])
            own = asker[slice(*np.searchsorted(wanted, [name, name + 1]))]
            for start in range(first, last, DECODED):
                stop = min(start + DECODED, last)
                rest = np.concatenate([words[p, code[start:stop, p]] for p in range(parts)], axis=1)
                whole = (rest + centres[name].astype(np.float32)).T
                for at in range(0, len(own), QUERY_BLOCK):
                    q = own[at : at + QUERY_BLOCK]
                    score, k = units[q] @ whole, int(depth[q].max())
                    if k < score.shape[1]:
                        some = np.argpartition(-score, k - 1, axis=1)[:, :k]
                    else:
                        some = np.tile(np.arange(score.shape[1]), (len(q), 1))
                    estimate = np.take_along_axis(score, some, 1)
                    found.append((np.repeat(q, some.shape[1]), (some + start).ravel(), estimate.ravel()))
            if sum(len(f[0]) for f in found) > HELD:
                found = [self._highest(found, depth)]
        if found:
            row, at, estimate = self._highest(found, depth)
            chosen = pa.array(place[at])
            yield queries, pa.array(row), ids.take(chosen), tags.take(chosen), estimate.astype(np.float64)

    @staticmethod
    def _highest(found, depth):
        """The depth highest estimates of each query among those found."""
        row, at, estimate = (np.concatenate(c) for c in zip(*found))
        order = np.lexsort((-estimate, row))
        row, at, estimate = row[order], at[order], estimate[order]
        few = np.arange(len(row)) - np.searchsorted(row, row) < depth[row]
        return row[few], at[few], estimate[few]


def _estimates(centres: np.ndarray, books: np.ndarray, drop_self: bool, schema: pa.Schema):
    """The items of a cell with the highest estimates for each of its queries."""

    def rows(cell):
        for queries, row, ids, tags, estimate in cell.best(centres, books, drop_self):
            columns = [queries.column(c).combine_chunks().take(row) for c in ("qid", "qtag", "depth", "k")]
            yield pa.RecordBatch.from_arrays([*columns, ids, tags, pa.array(estimate)], schema=schema)

    def run(batches):
        now, cell = None, _Cell()
        for batch in batches:
            if batch.num_rows == 0:
                continue
            marks = np.stack([batch.column(c).to_numpy() for c in ("cell", "side")])
            cuts = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1), batch.num_rows]
            for start, stop in zip(cuts, cuts[1:]):
                if marks[0, start] != now:
                    yield from rows(cell)
                    now, cell = marks[0, start], _Cell()
                cell.add(marks[1, start], batch.slice(start, stop - start))
        yield from rows(cell)

    return run


def _cells(stored: DataFrame, asked: DataFrame, layout: dict, queries_per_cell: int) -> DataFrame:
    """Codes and queries by group of lists and lane of queries; a group's codes are copied to each of its lanes.

    The numbers of queries by group reach the driver.
    """
    slots = int(stored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    plan, n_cells = [], 0
    for r in sorted(asked.groupBy("group").count().collect()):
        plan.append((r["group"], n_cells, max(-(-r["count"] // queries_per_cell), min(-(-slots // len(layout)), r["count"]))))
        n_cells += plan[-1][2]
    lanes = stored.sparkSession.createDataFrame(plan, "group int, base int, lanes int")
    homes = stored.sparkSession.createDataFrame([(n, *home) for n, home in layout.items()], "list long, first int, spread int")
    cell = (F.col("base") + F.col("lane")).alias("cell")
    group = (F.col("first") + F.pmod(F.xxhash64(F.col("itag")[0]), F.col("spread"))).cast("int").alias("group")
    each = F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)).alias("lane")
    items = stored.join(homes, "list").select(*stored.columns, group).join(lanes, "group").select("*", each)
    items = items.select(F.lit(ITEM).alias("side"), cell, *stored.columns)
    queries = asked.join(lanes, "group").withColumn("lane", F.pmod(F.xxhash64("qid", "qtag"), F.col("lanes")).cast("int"))
    queries = queries.select(F.lit(QUERY).alias("side"), cell, "qid", "qtag", "unit", "depth", "k", "lists")
    both = items.unionByName(queries, allowMissingColumns=True)
    return both.repartitionById(max(1, n_cells), F.col("cell")).sortWithinPartitions("cell", "side")


def _named(number: str, tag: str):
    """One name for an id and the tag of its vector; null for an id that is missing."""
    return F.concat(F.col(number).cast("string"), F.lit(" "), F.col(tag).cast("string"))


def _exact(few: DataFrame, wanted: DataFrame, items: DataFrame, carry) -> DataFrame:
    """few (qid, qtag, iid, itag) with their cosine and dot product; the pairs stay narrow and meet their vectors on a grid."""
    pairs = few.withColumns({"_q": _named("qid", "qtag"), "_i": _named("iid", "itag")}).filter("_q IS NOT NULL AND _i IS NOT NULL")
    asked, found = wanted.select(_named("qid", "qtag").alias("_q"), "qvec"), items.select(_named("iid", "itag").alias("_i"), "ivec")
    scored = grids.products(pairs, asked, found, "_q", "_i", "qvec", "ivec", inner=True, dot=True).drop("_q", "_i")
    if carry:
        scored = scored.join(items.select("iid", "itag", *carry), ["iid", "itag"])
    return scored.withColumn("rank_key", F.round("score", RANK_DIGITS)).repartition("qid", "qtag").dropDuplicates(["qid", "qtag", "iid", "itag"])


def search(
    index: Index,
    queries: DataFrame,
    k,
    n_probe: int,
    rerank: int = RERANK,
    query_id: str = "user_id",
    query_vec: str = "embedding",
    exclude_self: bool = False,
    carry: tuple[str, ...] = (),
    items_per_cell: int = ITEMS_PER_CELL,
    queries_per_cell: int = QUERIES_PER_CELL,
) -> DataFrame:
    """Approximate best k items per query by cosine: (query id, item id, score, dot, rank, carried columns).

    Each query opens its n_probe nearest lists; of what it finds there, the k *
    rerank highest estimates are scored exactly. With all lists open and as many
    exact scores as items, that is the exact search. Only the files and row groups
    of lists that some query opens are read. Queries whose vector is null, empty,
    zero, not finite or of another size than the index get no rows. The answer
    does not depend on how lists are dealt to tasks.
    """
    wanted = queries.filter(searchable(query_vec)).select(
        F.col(query_id).alias("qid"), F.col(query_vec).alias("qvec"), _depth(k).cast("int").alias("k")
    )
    wanted = wanted.withColumn("qtag", F.xxhash64("qvec", "k")).filter(F.exists("qvec", lambda x: x != 0))
    wanted = cut_lineage(wanted.dropDuplicates(["qid", "qtag"]))
    units = wanted.withColumn("unit", V.normalize("qvec")).withColumn("depth", F.col("k") * rerank)
    layout = _layout(index.lengths, items_per_cell)
    probes = _asked(units.select("qid", "qtag", "unit", "depth", "k"), index.centres, min(n_probe, len(index.centres)), layout)
    asked = cut_lineage(probes)
    opened = [r[0] for r in asked.select(F.explode("lists")).distinct().collect()]
    stored = index.codes.filter(F.col("list").isin(opened)) if len(opened) < len(index.centres) else index.codes
    cells = _cells(stored, asked, layout, queries_per_cell)
    kinds = {c: t for c, t in [("qid", wanted.schema["qid"].dataType), ("iid", index.items.schema["iid"].dataType)]}
    of = lambda names: T.StructType([T.StructField(n, kinds.get(n) or t) for n, t in names])
    shape = of([("qid", None), ("qtag", T.LongType()), ("depth", T.IntegerType()), ("k", T.IntegerType()), ("iid", None), ("itag", T.LongType()), ("estimate", T.DoubleType())])
    rough = cells.mapInArrow(_estimates(index.centres, index.books, exclude_self, to_arrow_schema(shape)), shape)
    if exclude_self:
        rough = rough.filter(~F.col("qid").eqNullSafe(F.col("iid")))
    by_query = Window.partitionBy("qid", "qtag")
    order = F.row_number().over(by_query.orderBy(F.desc("estimate"), "iid", "itag"))
    few = rough.withColumn("_n", order).filter(F.col("_n") <= F.col("depth")).select("qid", "qtag", "k", "iid", "itag")
    exact = _exact(few, wanted, index.items, carry)
    ranked = exact.withColumn("rank", F.row_number().over(by_query.orderBy(F.desc("rank_key"), "iid")))
    return _renamed(ranked.filter("rank <= k"), query_id, index.item_id, carry)


def share_read(index: Index, queries: DataFrame, n_probe: int, query_id: str = "user_id", query_vec: str = "embedding") -> DataFrame:
    """(n_queries, items_read, items_asked): items in the lists that the queries open, and items times queries."""
    known = queries.filter(searchable(query_vec)).select(query_id, V.normalize(query_vec).alias("unit"))
    layout = _layout(index.lengths, ITEMS_PER_CELL)
    opened = _asked(known, index.centres, min(n_probe, len(index.centres)), layout).select(query_id, F.explode("lists").alias("list")).distinct()
    lengths = queries.sparkSession.createDataFrame(sorted(index.lengths.items()), "list long, n long")
    asked = F.count_distinct(query_id)
    return opened.join(lengths, "list").agg(
        asked.alias("n_queries"), F.sum("n").alias("items_read"), (asked * sum(index.lengths.values())).alias("items_asked")
    )
