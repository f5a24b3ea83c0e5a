"""Repeated byte strings by a depth-limited radix sort of suffixes.

A string of `length` bytes is repeated if it starts at two places. Suffixes are
sorted through that depth only, most significant digit first: a pass refines the
rank so far by the next bytes, rows alone in their group are done, and the groups
that are left at the full depth are exactly the repeated strings.

To sort fewer suffixes than there are bytes, every string is hung on an anchor:
the smallest of the hashed 16-byte grams that start in its first `span` bytes
(the first of equals). Equal strings have their anchors at the same offset, so
strings are compared from there. The bytes of a string are consumed in the order
in which its neighbours share them:

1. the bytes that all strings of an anchor have, from the anchor on (145 of 400),
2. those that all strings of a *cell* of 32 offsets before the anchor have besides
   (the next 224, on both sides),
3. the bytes that are left (31), string by string and as they are.

The rank after passes 1 and 2 is a 128-bit BLAKE2 digest of the rank before and of
the bytes consumed; pass 3 groups by rank and bytes. After passes 1 and 2 a cell
whose *hull*, all bytes that any of its strings touches, occurs twice is done as
well: all its strings are repeated. One of its members goes on where others share
its rank. Hulls are compared by 128-bit digests too.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.common import arrow, bounds, cut_lineage, mix, table, text_bytes, unlink, wide_key

LENGTH = 400
GRAM = 16
SPAN = 256
CELL = 32
#: Rows of texts a worker turns into words, or cuts, at a time; contexts whose strings it spells at a time.
ROWS = 500
SPELLED = 128
#: Type of a row's key.
KEY = "key struct<a:long,b:long>"
#: Bytes of a text taken at a time; a longer one is read in overlapping pieces.
PIECE = 1 << 18
_PLACE_BITS = 22
_PLACE = np.uint64((1 << _PLACE_BITS) - 1)

_SYMBOL = np.random.default_rng(11).integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_POWERS = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 4096)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def _prefix(data: np.ndarray) -> np.ndarray:
    """Rolling sums along the last axis, from which the hash of any stretch follows."""
    up, _ = _powers(data.shape[-1] + 1)
    out = np.zeros((*data.shape[:-1], data.shape[-1] + 1), np.uint64)
    np.cumsum(_SYMBOL[data] * up[: data.shape[-1]], axis=-1, dtype=np.uint64, out=out[..., 1:])
    return out


def _stretch(sums, start, stop) -> np.ndarray:
    """Hash of bytes start to stop: the same for the same bytes anywhere."""
    _, down = _powers(len(sums))
    return mix((sums[stop] - sums[start]) * down[start])


def _window_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each width neighbours: entry i is the least of values[i : i + width]."""
    n = len(values) - width + 1
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, ~np.uint64(0))
    padded[: len(values)] = values
    padded = padded.reshape(blocks, width)
    left = np.minimum.accumulate(padded, axis=1).ravel()
    right = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def _digests(pieces) -> np.ndarray:
    """128-bit digests of byte strings."""
    return np.array([hashlib.blake2b(p, digest_size=16).digest() for p in pieces] or [b""], object)[: len(pieces)]


def _tagged(tag, raw: bytes) -> bytes:
    return int(tag).to_bytes(2, "little") + raw


class Layout:
    """Sizes that follow from the length of the strings."""

    def __init__(self, length: int):
        if length < 2 * GRAM:
            raise ValueError(f"strings must have {2 * GRAM} bytes at least")
        self.length = length
        self.span = min(SPAN, length - GRAM)
        self.before = self.span - 1  # bytes before an anchor that its strings can hold


def _pieces(starts, length, before):
    """(row, first byte, last byte, first own, last own) of each stretch to read; an anchor is owned once."""
    for row, (a, b) in enumerate(zip(starts, starts[1:])):
        n = int(b - a)
        if n < length:
            continue
        for own in range(0, n, PIECE):
            end = min(n, own + PIECE)
            yield row, max(0, own - before), min(n, end + length), own, end


def _anchors_of(layout, data, starts, batch):
    length, span, before = layout.length, layout.span, layout.before

    def found(rows):
        sizes = np.array([stop - start for _, start, stop, _, _ in rows])
        at = np.concatenate([[0], np.cumsum(sizes)])
        text = np.concatenate([data[starts[r] + a : starts[r] + b] for r, a, b, _, _ in rows])
        sums = _prefix(text)
        places = np.arange(len(text) - GRAM + 1)
        grams = _stretch(sums, places, places + GRAM)
        marks = (grams & ~_PLACE) | places.astype(np.uint64)
        least = (_window_min(marks, span) & _PLACE).astype(np.int64)
        # strings that lie within one piece
        first = np.concatenate([np.arange(a, b - length + 1) for a, b in zip(at, at[1:])])
        anchor = least[first]
        cut = bounds(anchor)
        anchor = anchor[cut[:-1]]
        hi = anchor - first[cut[:-1]] + 1
        lo = anchor - first[cut[1:] - 1]
        piece = np.searchsorted(at, anchor, side="right") - 1
        shift, own, end, row = (np.array([p[k] for p in rows])[piece] for k in (1, 3, 4, 0))
        place = anchor - at[piece] + shift
        mine = (place >= own) & (place < end)
        anchor, lo, hi, piece, row, place = (x[mine] for x in (anchor, lo, hi, piece, row, place))
        left = np.maximum(anchor - before, at[piece])
        right = np.minimum(anchor + length, at[piece + 1])
        raw = text.tobytes()
        return {
            "key": batch.column("key").take(pa.array(row)),
            "pos": place,
            "cell": lo | hi << 16,
            "core": _digests([raw[a : a + length - before] for a in anchor.tolist()]),
            "hull": _digests([_tagged(a - l, raw[l:r]) for a, l, r in zip(anchor.tolist(), left.tolist(), right.tolist())]),
        }

    held, size = [], 0
    for piece in _pieces(starts, length, before):
        held.append(piece)
        size += piece[2] - piece[1]
        if size >= PIECE:
            yield found(held)
            held, size = [], 0
    if held:
        yield found(held)


def _anchors(layout):
    def run(batches):
        for batch in batches:
            data, starts = text_bytes(batch.column("text"))
            yield from _anchors_of(layout, data, starts, batch)

    return run


def _entries(column):
    """The structs of a column of lists."""
    return column.flatten()


def _flat(column, name):
    """A field of a list of structs, flattened, and the row each entry belongs to."""
    owner = pa.compute.list_parent_indices(column).to_numpy()
    return _entries(column).field(name).to_numpy(zero_copy_only=False), owner


def _contexts(layout):
    """The bytes around each anchor that still matters."""
    schema_from, schema_to = layout.before, layout.length

    def run(batches):
        for batch in batches:
            data, starts = text_bytes(batch.column("text"))
            todo = batch.column("todo")
            pos, owner = _flat(todo, "pos")
            cell, _ = _flat(todo, "cell")
            known, _ = _flat(todo, "known")
            rank = _entries(todo).field("rank")
            left = np.maximum(pos - schema_from, 0)
            size = np.diff(starts)[owner]
            right = np.minimum(pos + schema_to, size)
            base = starts[owner]
            for some in range(0, len(pos), 8192):
                part = slice(some, some + 8192)
                yield {
                    "key": batch.column("key").take(pa.array(owner[part])),
                    "pos": pos[part],
                    "cell": cell[part],
                    "known": known[part],
                    "rank": rank.slice(some, len(owner[part])),
                    "before": pos[part] - left[part],
                    "around": [data[b + l : b + r].tobytes() for b, l, r in zip(base[part], left[part], right[part])],
                }

    return run


def _grids(batch, layout, rows=1024):
    """(slice, grid of bytes, first column, last column): contexts with their anchors below one another."""
    width = layout.before + layout.length
    data, starts = text_bytes(batch.column("around"))
    before = batch.column("before").to_numpy()
    for some in range(0, batch.num_rows, rows):
        part = slice(some, min(some + rows, batch.num_rows))
        size = np.diff(starts[part.start : part.stop + 1])
        first = layout.before - before[part]
        grid = np.zeros((len(size), width), np.uint8)
        column = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)
        grid[np.repeat(np.arange(len(size)), size), column] = data[starts[part.start] : starts[part.stop]]
        yield part, grid, first, first + size


def _consumed(layout, j) -> tuple[int, int]:
    """Columns that two passes have consumed of the strings of cell j."""
    first = layout.before - j * CELL
    return first, max(layout.length, first + layout.length - (CELL - 1))


def _cells(layout):
    """Rank after the second pass, and hull, of each smaller cell of the contexts."""
    length, before = layout.length, layout.before

    def run(batches):
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            rank = batch.column("rank").to_pylist()
            for part, grid, first, last in _grids(batch, layout):
                raw, width = grid.tobytes(), grid.shape[1]
                lo, hi = cell[part] & 0xFFFF, cell[part] >> 16
                for j in range(-(-layout.span // CELL)):
                    some = np.flatnonzero((lo < (j + 1) * CELL) & (hi > j * CELL))
                    if len(some) == 0:
                        continue
                    a, b = _consumed(layout, j)
                    left = np.maximum(first[some], before - j * CELL - (CELL - 1))
                    right = np.minimum(last[some], before - j * CELL + length)
                    added, touched = [], []
                    for row, l, r in zip(some.tolist(), left.tolist(), right.tolist()):
                        at = row * width
                        consumed = raw[at + a : at + before] + raw[at + length : at + b]
                        added.append(_tagged(j, rank[part.start + row] + consumed))
                        touched.append(_tagged(l, raw[at + l : at + r]))
                    take = pa.array(some + part.start)
                    yield {
                        "key": batch.column("key").take(take),
                        "pos": batch.column("pos").take(take),
                        "known": batch.column("known").take(take),
                        "cell": np.maximum(lo[some], j * CELL) | np.minimum(hi[some], (j + 1) * CELL) << 16,
                        "core": _digests(added),
                        "hull": _digests(touched),
                    }

    return run


def _rows_as_binary(grid: np.ndarray) -> pa.Array:
    n, width = grid.shape
    fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), n, [None, pa.py_buffer(grid.tobytes())])
    return fixed.cast(pa.binary())


def _strings(layout):
    """The bytes left of every single string of the cells still open, after its offset in the cell."""
    length, before = layout.length, layout.before
    ends = np.array([_consumed(layout, j) for j in range(-(-layout.span // CELL))])

    def run(batches):
        for batch in batches:
            todo = batch.column("todo")
            cells, owner = _flat(todo, "cell")
            known, _ = _flat(todo, "known")
            rank = _entries(todo).field("rank")
            pos = batch.column("pos").to_numpy()
            for part, grid, _, _ in _grids(batch, layout, SPELLED):
                here = np.flatnonzero((owner >= part.start) & (owner < part.stop))
                lo, hi = cells[here] & 0xFFFF, cells[here] >> 16
                entry = np.repeat(here, hi - lo)
                row = owner[entry]
                offset = np.arange(len(row)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)
                ahead, end = (offset % CELL)[:, None], ends[offset // CELL, 1][:, None]
                step = np.arange(CELL - 1)[None, :]
                start = before - offset[:, None]
                column = np.where(step < ahead, start + step, end + step - ahead)
                inside = column < start + length
                left = grid[(row - part.start)[:, None], np.where(inside, column, 0)] * inside
                yield {
                    "key": batch.column("key").take(pa.array(row)),
                    "start": pos[row] - offset,
                    "known": known[entry],
                    "rank": rank.take(pa.array(entry)),
                    "digit": _rows_as_binary(np.hstack([ahead, left]).astype(np.uint8)),
                }

    return run


def _decide(cells: DataFrame, length: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(repeated spans, cells to split, tables to remove) of cells with their ranks (core) and hulls.

    The cells' own table is removed as soon as those that share a rank are written. Counts are combined before the shuffle and written; the joins with them have
    a shuffle on both sides, so that a digit with a third of all rows is split.
    """
    cores = cut_lineage(cells.groupBy("core").agg(F.count("*").alias("n_core")).filter("n_core > 1"))
    shared = cut_lineage(cells.join(cores, "core"))
    unlink(cells)
    unlink(cores)
    member = F.struct("key", "pos", "cell")
    hulls = cut_lineage(
        shared.groupBy("hull").agg(F.count("*").alias("n_hull"), F.min(member).alias("first")).filter("n_hull > 1")
    )
    judged = shared.join(hulls, "hull", "left")
    lo, hi = F.col("cell").bitwiseAND(0xFFFF), F.shiftright("cell", 16)
    spans = judged.filter("n_hull > 1 AND NOT known").select(
        "key", (F.col("pos") - hi + 1).alias("start"), (F.col("pos") - lo + length).alias("stop")
    )
    chosen = F.col("n_hull").isNotNull() & (F.col("n_core") > F.col("n_hull")) & (F.col("first") == member)
    rest = judged.filter(F.col("n_hull").isNull() | chosen).select(
        "key", "pos", "cell", (F.col("known") | F.col("n_hull").isNotNull()).alias("known"), F.col("core").alias("rank")
    )
    return spans, rest, [shared, hulls]


def _todo(rest: DataFrame, *by: str) -> DataFrame:
    return rest.groupBy(*by).agg(F.collect_set(F.struct(*[c for c in rest.columns if c not in by])).alias("todo"))


def repeated_spans(rows: DataFrame, length: int = LENGTH, remove: bool = False) -> DataFrame:
    """(key, spans): the byte ranges of each text that repeated strings cover, in no order, overlapping.

    rows are (key, text) with a 128-bit key of the row's identity; two rows of one
    key must have one text and each counts as a place. Text without repeated
    strings gives no row. Spans are merged stretch by stretch of a text before
    they come to one row, so a text that repeats throughout has few. With remove,
    rows is a table of its own that goes once it is read for the last time.
    """
    layout = Layout(length)
    anchors = arrow(rows, _anchors(layout), f"{KEY}, pos long, cell int, core binary, hull binary")
    top = cut_lineage(anchors.withColumn("known", F.lit(False)))
    spans0, rest0, used0 = _decide(top, length)
    spans0 = cut_lineage(spans0)
    wanted = _todo(rest0, "key")
    around = cut_lineage(
        arrow(
            rows.join(wanted, "key").select("key", "text", "todo"),
            _contexts(layout),
            f"{KEY}, pos long, cell int, known boolean, rank binary, before int, around binary",
        )
    )
    for done in (*used0, *([rows] if remove else [])):
        unlink(done)
    small = cut_lineage(arrow(around, _cells(layout), f"{KEY}, pos long, known boolean, cell int, core binary, hull binary"))
    spans1, rest1, used1 = _decide(small, length)
    spans1 = cut_lineage(spans1)
    places = around.dropDuplicates(["key", "pos"]).drop("cell", "known", "rank")
    open_cells = places.join(_todo(rest1, "key", "pos"), ["key", "pos"])
    strings = cut_lineage(arrow(open_cells, _strings(layout), f"{KEY}, start long, known boolean, rank binary, digit binary"))
    for done in (around, *used1):
        unlink(done)
    twice = cut_lineage(strings.groupBy("rank", "digit").agg(F.count("*").alias("n")).filter("n > 1").drop("n"))
    spans2 = strings.filter("NOT known").join(twice, ["rank", "digit"]).select("key", "start", (F.col("start") + length).alias("stop"))
    span = F.struct("start", "stop")
    stretches = (
        spans0.unionByName(spans1)
        .unionByName(spans2)
        .groupBy("key", F.floor(F.col("start") / PIECE).alias("stretch"))
        .agg(F.collect_set(span).alias("spans"))
    )
    runs = arrow(stretches.select("key", "spans"), _runs, f"{KEY}, start long, stop long")
    return runs.groupBy("key").agg(F.collect_list(span).alias("spans"))


def _runs(batches):
    """Maximal runs of each row's spans."""
    for batch in batches:
        start, owner = _flat(batch.column("spans"), "start")
        stop, _ = _flat(batch.column("spans"), "stop")
        cut = bounds(owner)
        merged = [_merged(start[a:b], stop[a:b]) for a, b in zip(cut, cut[1:])]
        row = np.repeat(owner[cut[:-1]], [len(a) for a, _ in merged])
        yield {
            "key": batch.column("key").take(pa.array(row)),
            "start": np.concatenate([a for a, _ in merged]),
            "stop": np.concatenate([b for _, b in merged]),
        }


def _merged(start, stop):
    """Maximal runs of the union of ranges."""
    order = np.argsort(start, kind="stable")
    start, stop = start[order], np.maximum.accumulate(stop[order])
    opens = np.append(True, start[1:] > stop[:-1])
    return start[opens], stop[np.append(np.flatnonzero(opens)[1:] - 1, len(stop) - 1)]


def _removed(batch):
    """For each row: its bytes and the maximal runs to remove."""
    data, starts = text_bytes(batch.column("text"))
    spans = batch.column("spans")
    spans = spans.combine_chunks() if isinstance(spans, pa.ChunkedArray) else spans
    start, owner = _flat(spans, "start")
    stop, _ = _flat(spans, "stop")
    cut = np.searchsorted(owner, np.arange(batch.num_rows + 1))
    for row in range(batch.num_rows):
        own = data[starts[row] : starts[row + 1]]
        if cut[row] == cut[row + 1]:
            yield own, np.zeros(0, np.int64), np.zeros(0, np.int64)
        else:
            part = slice(cut[row], cut[row + 1])
            yield own, *_merged(start[part], stop[part])


def _without(own, start, stop) -> bytes:
    keep = [own[a:b].tobytes() for a, b in zip([0, *stop], [*start, len(own)])]
    return b"".join(keep)


def _digest(batches):
    for batch in batches:
        rows = list(_removed(batch))
        yield {
            "doc_id": batch.column("doc_id"),
            "n_bytes": [len(own) for own, _, _ in rows],
            "n_removed": [int((stop - start).sum()) for _, start, stop in rows],
            "n_spans": [len(start) for _, start, _ in rows],
            "kept_sha256": [hashlib.sha256(_without(*r)).hexdigest() for r in rows],
            "text": [_without(*_whole_characters(*r)).decode() for r in rows],
        }


def _whole_characters(own, start, stop):
    """The runs without the parts of characters at their ends."""
    inside = np.append((own & 0xC0) == 0x80, False)
    start, stop = start.copy(), stop.copy()
    for at in range(len(start)):
        while inside[start[at]] and start[at] < stop[at]:
            start[at] += 1
        while inside[stop[at]] and stop[at] > start[at]:
            stop[at] -= 1
    return own, start, stop


def _spanned(docs: DataFrame, doc_id: str, text: str, length: int) -> DataFrame:
    """docs with the columns __key, text and spans."""
    keyed = docs.withColumn("__key", wide_key(doc_id, text))
    found = repeated_spans(keyed.select(F.col("__key").alias("key"), F.col(text).alias("text")), length)
    return keyed.join(found.select(F.col("key").alias("__key"), F.col("spans").alias("__spans")), "__key", "left")


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """docs without the characters that lie wholly in repeated strings of `length` bytes.

    A null text stays null, one that is covered altogether becomes empty; no
    document is dropped, and rows equal in id and text count as two places, so
    both lose their long strings. Other columns are handed on.
    """
    schema = docs.schema
    spanned = _spanned(docs, doc_id, text, length)

    def run(batches):
        for batch in batches:
            view = batch.select([text, "__spans"]).rename_columns(["text", "spans"])
            valid = batch.column(text).is_valid().to_pylist()
            kept = [_without(*_whole_characters(*r)).decode() if v else None for r, v in zip(_removed(view), valid)]
            yield {**{c: batch.column(c) for c in schema.names}, text: kept}

    return arrow(spanned.drop("__key"), run, schema)


def _blocks(own, white):
    """Ranges of about PIECE bytes that end where no word is cut."""
    start = 0
    while start < len(own):
        stop = start + PIECE
        if stop < len(own):
            gap = np.flatnonzero(white[stop : stop + PIECE])
            while len(gap) == 0 and stop + PIECE < len(own):
                stop += PIECE
                gap = np.flatnonzero(white[stop : stop + PIECE])
            stop = stop + gap[0] + 1 if len(gap) else len(own)
        yield start, min(stop, len(own))
        start = stop


def _words(own) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last byte of each word (between the white space 0x20, 0x09 to 0x0D), and its 64-bit hash."""
    white = (own == 0x20) | ((own >= 0x09) & (own <= 0x0D))
    found = []
    for a, b in _blocks(own, white):
        edge = np.diff(np.concatenate([[True], white[a:b], [True]]).astype(np.int8))
        first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        found.append((first + a, last + a, _stretch(_prefix(own[a:b]), first, last)))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(parts) for parts in zip(*found))


def _slices(batches):
    return (batch.slice(k, ROWS) for batch in batches for k in range(0, batch.num_rows, ROWS))


def _as_words(batches):
    """Texts as the hashes of their words, eight bytes each."""
    for batch in _slices(batches):
        data, starts = text_bytes(batch.column("text"))
        words = [_words(data[a:b])[2].tobytes() for a, b in zip(starts, starts[1:])]
        yield {"key": batch.column("key"), "text": words}


def _without_words(own, start, stop, n_words) -> bytes:
    """A text without the runs of n_words and more words that the ranges of word hashes hold wholly."""
    start, stop = -(-start // 8), stop // 8
    long = stop - start >= n_words
    if not long.any():
        return own.tobytes()
    first, last, _ = _words(own)
    left = _without(own, first[start[long]], last[stop[long] - 1])
    return left if left.strip(b" \t\n\v\f\r") else b""


def remove_repeated_words(docs: DataFrame, n_words: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the runs of words that strings of n_words words which occur elsewhere cover.

    Words are what stands between white space (0x20, 0x09 to 0x0D), compared as
    64-bit hashes; the white space between them does not count. Suffixes are
    sorted by word, so a repeated passage of n_words words goes whatever its
    bytes, and a shorter one stays. A run goes from its first word's first byte
    to its last word's last; white space around it stays, but a text that loses
    all its words becomes empty. A null text stays null; no document is dropped; rows equal in id and text count as two places. Other
    columns are handed on.
    """
    schema = docs.schema
    keyed = docs.withColumn("__key", wide_key(doc_id, text))
    hashed = arrow(keyed.select(F.col("__key").alias("key"), F.col(text).alias("text")), _as_words, f"{KEY}, text binary")
    found = repeated_spans(cut_lineage(hashed), 8 * n_words, remove=True)
    spanned = keyed.join(found.select(F.col("key").alias("__key"), F.col("spans").alias("__spans")), "__key", "left")

    def run(batches):
        for batch in _slices(batches):
            view = batch.select([text, "__spans"]).rename_columns(["text", "spans"])
            valid = batch.column(text).is_valid().to_pylist()
            kept = [_without_words(*r, n_words).decode() if v else None for r, v in zip(_removed(view), valid)]
            yield {**{c: batch.column(c) for c in schema.names}, text: kept}

    return arrow(spanned.drop("__key"), run, schema)


def op2_suffix_array(spark, sf_dir):
    """What is left of every document without the 400-byte strings that occur elsewhere.

    n_removed, n_spans and kept_sha256 are about bytes; text, the last column, is
    what is left in whole characters: parts of one at a run's ends stay.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    spanned = _spanned(docs, "doc_id", "text", LENGTH).select("doc_id", "text", F.col("__spans").alias("spans"))
    return arrow(spanned, _digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string")
