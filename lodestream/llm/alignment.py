"""Alignment of two tokenizers' tokens over a corpus, by external spill counting.

Each task turns its documents, a chunk at a time, into a run: the chunk's
distinct (A id, B id, document) records, parted by the A id's low digits
(radix), sorted A id first, and compressed by zstd. A run has two sides. Its
head, the distinct id pairs with their number of documents, is what is counted:
heads are merged with a heap over many runs at once, A id by A id, level by
level, and as all of an A id's partners come together, its highest count is
known there. Its body, the records, moves once: to the lane of its run, where
the counts stream past radix by radix and each document adds up its links.

So a pair that most documents hold is one entry of a run's head, however
frequent, and no group of records is ever gathered.
"""

import functools
import hashlib
import heapq
import math

import numpy as np
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.common import arrow, bounds, cut_lineage, table, unlink
from lodestream.llm.tokens import _byte_signs, _read, encoder, segments, vocabulary

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Characters and documents (at most 2^_SLOT) that make a run; a single longer text is a run of its own.
RUN_CHARS, RUN_DOCS = 2 << 20, 4096
#: Tokens that are linked at once.
BLOCK = 1 << 19
#: Parts a run is cut into by the A id; runs whose heads are merged together; runs that share a copy of the counts.
RADIX = 32
FAN = 256
SHARE = 16
#: Runs of a lane at most, whose documents' sums a task holds.
LANE = 1024
#: Token pairs of one stretch between common boundaries from which equal ids are merged first.
WIDE = 256
#: Entries of a merged head that make a row.
ENTRIES = 1 << 18

_BITS, _SLOT = 21, 12  # of an id within a pair's key, and of a document within a run


def _pack(*arrays) -> bytes:
    """Arrays of whole numbers as one zstd frame."""
    parts = [np.array([len(arrays), *(len(a) for a in arrays)], np.int64), *(np.asarray(a, np.int64) for a in arrays)]
    # by byte planes, which are mostly zeros
    planes = np.concatenate(parts).view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _unpack(blob: bytes) -> list[np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8, -1)
    whole = np.ascontiguousarray(planes.T).view(np.int64).ravel()
    ends = np.cumsum(whole[1 : 1 + whole[0]]) + 1 + whole[0]
    return np.split(whole[: ends[-1]], [1 + whole[0], *ends[:-1]])[1:]


def _deltas(keys: np.ndarray) -> np.ndarray:
    return np.diff(keys, prepend=0)


class _Side:
    """Ids and byte lengths of a tokenizer's tokens."""

    def __init__(self, encode, tokens):
        self.encode, self.tokens = encode, tokens
        self.lengths = np.array([len(t) for t in tokens], np.int64)


@functools.lru_cache(maxsize=2)
def _byte_side(path: str) -> _Side:
    """A byte-level BPE file; special strings in a text are ordinary text."""
    whole, signs = _read(path), _byte_signs()
    coder = encoder(path)
    tokens = [b""] * coder.size
    for token, n in whole["model"]["vocab"].items():
        tokens[n] = bytes(signs[c] for c in token) if all(c in signs for c in token) else token.encode()
    return _Side(lambda part: coder.encode(" " + part), tokens)


@functools.lru_cache(maxsize=2)
def _piece_side(path: str) -> tuple[_Side, bool]:
    """A sentencepiece file, and whether a text may be cut before single spaces: no piece goes on after one."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(n) for n in range(model.get_piece_size())]
    tokens = [bytes([int(p[3:5], 16)]) if model.is_byte(n) else p.replace("▁", " ").encode() for n, p in enumerate(pieces)]
    return _Side(model.encode, tokens), not any("▁" in p.lstrip("▁") for p in pieces)


def _tokens(text: str, a: _Side, b: _Side, cuttable: bool):
    """Ids of both sides, part by part, or none where their joined bytes are not a space and the text.

    Both take a part without its leading space and put one before it, so parts
    begin and end at common boundaries.
    """
    parts = []
    for n, part in enumerate(segments(text) if cuttable else [text]):
        part = part[1:] if n else part
        left, right, want = a.encode(part), b.encode(part), b" " + part.encode()
        if b"".join(map(a.tokens.__getitem__, left)) != want or b"".join(map(b.tokens.__getitem__, right)) != want:
            return []
        parts.append((np.array(left, np.int32), np.array(right, np.int32)))
    return parts


def _times(group, ids):
    """Distinct (group, id) and how often each occurs, in order."""
    order = np.lexsort((ids, group))
    group, ids = group[order], ids[order]
    cut = bounds(group, ids)
    return group[cut[:-1]], ids[cut[:-1]], np.diff(cut)


def _products(left, right, n_groups):
    """All pairs of entries (group, id, times) of the same group: ids of both, group, product of times."""
    (ga, a, ta), (gb, b, tb) = left, right
    nb = np.bincount(gb, minlength=n_groups)
    each = nb[ga]
    i = np.repeat(np.arange(len(ga)), each)
    j = np.repeat((np.cumsum(nb) - nb)[ga] - (np.cumsum(each) - each), each) + np.arange(len(i))
    return a[i], b[j], ga[i], ta[i] * tb[j]


def _records(key, times):
    """Distinct keys, sorted, and the sums of their times."""
    if (times == 1).all():
        key = np.sort(key)
        cut = bounds(key)
        return key[cut[:-1]], np.diff(cut)
    order = np.argsort(key, kind="stable")
    key, cut = key[order], bounds(key[order])
    return key[cut[:-1]], np.add.reduceat(times[order], cut[:-1]) if len(key) else times


class _Block:
    """Consecutive parts' tokens, cut into groups where both sides end."""

    def __init__(self, slots, a_ids, b_ids, a: _Side, b: _Side):
        self.a, self.b = np.concatenate(a_ids).astype(np.int64), np.concatenate(b_ids).astype(np.int64)
        a_end, b_end = np.cumsum(a.lengths[self.a]), np.cumsum(b.lengths[self.b])
        common = np.intersect1d(a_end, b_end, assume_unique=True)
        self.n = len(common)
        self.ga, self.gb = np.searchsorted(common, a_end), np.searchsorted(common, b_end)
        self.a_stop = np.searchsorted(self.ga, np.arange(self.n), "right")
        self.b_stop = np.searchsorted(self.gb, np.arange(self.n), "right")
        self.size = np.diff(self.a_stop, prepend=0) * np.diff(self.b_stop, prepend=0)
        self.slot = np.repeat(slots, [len(x) for x in a_ids])[self.a_stop - 1]

    def records(self):
        """((radix, A id, B id, slot) as one number, links), distinct."""
        wide, parts = self.size > WIDE, []
        for chosen, merged in ((~wide, False), (wide, True)):
            i, j = np.flatnonzero(chosen[self.ga]), np.flatnonzero(chosen[self.gb])
            if len(i):
                left, right = (self.ga[i], self.a[i]), (self.gb[j], self.b[j])
                if merged:
                    sides = _times(*left), _times(*right)
                else:
                    sides = (*left, np.ones(len(i), np.int64)), (*right, np.ones(len(j), np.int64))
                parts.append(_products(*sides, self.n))
        x, y, group, times = (np.concatenate(c) for c in zip(*parts))
        key = ((((x % RADIX) << _BITS | x) << _BITS | y) << _SLOT) | self.slot[group]
        return _records(key, times)

    def spelled(self, signs_a, signs_b):
        """(slot, a1,a2|b1;a3|b2,b3;) of each document; the signs are the ids with a comma, then with the group's mark."""
        index = np.zeros(len(self.a) + len(self.b), np.int64)
        last_a, last_b = np.zeros(len(self.a), bool), np.zeros(len(self.b), bool)
        last_a[self.a_stop - 1], last_b[self.b_stop - 1] = True, True
        start_b = np.append(0, self.b_stop[:-1])
        of_a, of_b = len(signs_a) // 2, len(signs_b) // 2
        index[np.arange(len(self.a)) + start_b[self.ga]] = self.a + of_a * last_a
        index[np.arange(len(self.b)) + self.a_stop[self.gb]] = len(signs_a) + self.b + of_b * last_b
        signs = signs_a + signs_b
        cut = bounds(self.slot)
        ends = (self.a_stop + self.b_stop)[cut[1:] - 1]
        for slot, p, q in zip(self.slot[cut[:-1]], np.append(0, ends[:-1]), ends):
            yield int(slot), "".join(map(signs.__getitem__, index[p:q].tolist()))


def _signs(n: int, mark: str) -> list[str]:
    return [f"{i}," for i in range(n)] + [f"{i}{mark}" for i in range(n)]


def _runs(a_path, b_path, spell, run_chars, run_docs, block):
    def run(batches):
        a, (b, cuttable) = _byte_side(a_path), _piece_side(b_path)
        signs = _signs(len(a.tokens), "|"), _signs(len(b.tokens), ";")
        number = TaskContext.get().partitionId() << 40
        names = ("run", "slot", "doc", "n_a", "n_b", "n_groups", "n_links", "groups", "radix", "head", "body")

        def blocks(rows):
            parts, size = [], 0
            for slot, (_, text) in enumerate(rows):
                for left, right in _tokens(text, a, b, cuttable) if text else ():
                    parts.append((slot, left, right))
                    size += len(left) + len(right)
                    if size >= block:
                        yield _Block(*zip(*parts), a, b)
                        parts, size = [], 0
            if parts:
                yield _Block(*zip(*parts), a, b)

        def chunk(rows):
            """The rows of one run: its documents', then its parts'."""
            nonlocal number
            figures = np.zeros((4, len(rows)), np.int64)  # tokens of A, of B, groups, links
            texts, keys, times = [[] for _ in rows], [], []
            for block in blocks(rows):
                for own, slots in zip(figures, (block.slot[block.ga], block.slot[block.gb], block.slot, None)):
                    if slots is not None:
                        own += np.bincount(slots, minlength=len(rows))
                np.add.at(figures[3], block.slot, block.size)
                for slot, text in block.spelled(*signs):
                    texts[slot].append(text)
                for held, own in zip((keys, times), block.records()):
                    held.append(own)
            blank = [None] * len(rows)
            spelled = [spell("".join(t)[:-1]) for t in texts]
            docs = [number] * len(rows), range(len(rows)), [d for d, _ in rows], *figures.tolist(), spelled
            yield dict(zip(names, (*map(list, docs), blank, blank, blank)))
            if keys:
                key, n = (keys[0], times[0]) if len(keys) == 1 else _records(np.concatenate(keys), np.concatenate(times))
                parts, cut = [], np.searchsorted(key >> (2 * _BITS + _SLOT), np.arange(RADIX + 1))
                for radix, (p, q) in enumerate(zip(cut, cut[1:])):
                    if p < q:
                        pair = (key[p:q] >> _SLOT) & ((1 << 2 * _BITS) - 1)
                        heads = bounds(pair)
                        head = _pack(_deltas(pair[heads[:-1]]), np.diff(heads))
                        parts.append((radix, head, _pack(key[p:q] & ((1 << _SLOT) - 1), n[p:q])))
                blank = [None] * len(parts)
                yield dict(zip(names, ([number] * len(parts), *[blank] * 7, *map(list, zip(*parts)))))
            number += 1

        held, size = [], 0
        for batch in batches:
            for row in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist()):
                held.append(row)
                size += len(row[1] or "")
                if size >= run_chars or len(held) >= run_docs:
                    yield from chunk(held)
                    held, size = [], 0
        if held:
            yield from chunk(held)

    return run


def _stream(n, blob):
    """(A id, run, its pairs' keys and counts), A id by A id."""
    deltas, count = _unpack(blob)
    keys = np.cumsum(deltas)
    side = keys >> _BITS
    cut = bounds(side)
    for p, q in zip(cut, cut[1:]):
        yield int(side[p]), n, keys[p:q], count[p:q]


def _merge(batches, final):
    """Rows (radix, lane, head) with the heads of each (radix, lane) merged by a heap over their streams.

    An A id's partners from all runs come together, so that, in the final merge,
    its highest count is known before its pairs are let out.
    """

    def merged(radix, lane, blobs):
        heap = heapq.merge(*(_stream(n, x) for n, x in enumerate(blobs)), key=lambda s: s[:2])
        parts, held, now = [], [], None

        def close():
            keys, counts = (np.concatenate(c) for c in zip(*held))
            order = np.argsort(keys, kind="stable")
            cut = bounds(keys[order])
            total = np.add.reduceat(counts[order], cut[:-1])
            parts.append((keys[order][cut[:-1]], total, total == total.max()))

        def row():
            keys, total, best = (np.concatenate(c) for c in zip(*parts))
            return radix, lane, _pack(_deltas(keys), total, *([best] if final else []))

        for side, _, keys, counts in heap:
            if held and side != now:
                close()
                held.clear()
                if sum(len(p[0]) for p in parts) >= ENTRIES:
                    yield row()
                    parts.clear()
            now = side
            held.append((keys, counts))
        if held:
            close()
            yield row()

    def run():
        name, blobs = None, []
        for batch in batches:
            for radix, lane, head in zip(*(batch.column(c).to_pylist() for c in ("radix", "lane", "head"))):
                if name != (radix, lane):
                    if blobs:
                        yield from merged(*name, blobs)
                    name, blobs = (radix, lane), []
                blobs.append(head)
        if blobs:
            yield from merged(*name, blobs)

    for row in run():
        yield dict(zip(("radix", "lane", "head"), ([v] for v in row)))


def _slots(df: DataFrame, cells: int) -> int:
    """Partitions for so many cells: one each, within four rounds of the session's partitions."""
    return max(1, min(cells, max(RADIX, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))))


def _counts(parts: DataFrame, runs: int, fan: int) -> DataFrame:
    """(radix, head): every pair's number of documents and whether it is its A id's highest.

    Each level merges about fan runs of a radix into one; the last one has a single lane.
    """
    level, n = parts.select("radix", F.pmod(F.xxhash64("run"), F.lit(max(1, math.ceil(runs / fan)))).alias("lane"), "head"), runs
    while True:
        n = math.ceil(n / fan)
        final = n <= 1
        cell = (F.col("radix") + F.lit(RADIX) * F.col("lane")) % F.lit(_slots(level, RADIX * n))
        sorted_parts = level.repartitionById(_slots(level, RADIX * n), cell.cast("int")).sortWithinPartitions("radix", "lane")
        made = arrow(sorted_parts, functools.partial(_merge, final=final), "radix int, lane long, head binary")
        if final:
            return cut_lineage(made)
        # a lane's head may be cut into rows, each in order of A id: as many streams
        level = cut_lineage(made.withColumn("lane", F.pmod(F.xxhash64("lane"), F.lit(math.ceil(n / fan)))))


def _look_up(batches):
    """Rows (run, slot, n_best, count_sum) of a lane: counts first, then the runs' parts, radix by radix."""
    now, keys, counts, best, sums = None, None, None, None, {}
    for batch in batches:
        for lane, radix, run, head, body in zip(*(batch.column(c).to_pylist() for c in ("lane", "radix", "run", "head", "body"))):
            if now is None or now[0] != lane:
                yield from _summed(sums)
                sums = {}
            if now != (lane, radix):
                now, keys, counts, best = (lane, radix), [], [], []
            if run is None:
                deltas, total, top = _unpack(head)
                keys.append(np.cumsum(deltas))
                counts.append(total)
                best.append(top)
                continue
            if isinstance(keys, list):
                keys, counts, best = (np.concatenate(c) for c in (keys, counts, best))
                order = np.argsort(keys, kind="stable")
                keys, counts, best = keys[order], counts[order], best[order]
            deltas, n = _unpack(head)
            at = np.repeat(np.searchsorted(keys, np.cumsum(deltas)), n)
            slot, times = _unpack(body)
            own = sums.setdefault(run, np.zeros((2, 0), np.int64))
            if own.shape[1] <= slot.max():
                own = sums[run] = np.pad(own, ((0, 0), (0, int(slot.max()) + 1 - own.shape[1])))
            np.add.at(own[0], slot, times * best[at])
            np.add.at(own[1], slot, times * counts[at])
    yield from _summed(sums)


def _summed(sums):
    for run, own in sums.items():
        slots = np.flatnonzero(own[1])
        yield {"run": np.full(len(slots), run), "slot": slots, "n_best": own[0][slots], "count_sum": own[1][slots]}


class Alignment:
    """What align() found, written to the shared folder.

    documents: (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups), a row for each document;
    pairs(): (a, b, n_docs, best), a row for each pair of linked ids.
    """

    def __init__(self, documents: DataFrame, counts: DataFrame):
        self.documents, self.counts = documents, counts

    def pairs(self) -> DataFrame:
        def run(batches):
            for batch in batches:
                for head in batch.column("head").to_pylist():
                    deltas, total, best = _unpack(head)
                    keys = np.cumsum(deltas)
                    yield {"a": keys >> _BITS, "b": keys & ((1 << _BITS) - 1), "n_docs": total, "best": best.astype(bool)}

        return arrow(self.counts, run, "a long, b long, n_docs long, best boolean")


def align(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    a_path: str | None = None,
    b_path: str | None = None,
    spell=str,
    run_chars: int = RUN_CHARS,
    run_docs: int = RUN_DOCS,
    block: int = BLOCK,
    fan: int = FAN,
    share: int = SHARE,
) -> Alignment:
    """Tokens of a byte-level BPE file (A, over a space and the text) linked with those of a sentencepiece file (B).

    Where tokens of both end at the same byte, a text is cut into groups; all A
    and B tokens of a group are linked. A pair's count is the number of documents
    that hold it linked. groups is what spell makes, in the task, of a document's
    groups written as a1,a2|b1;a3|b2,b3: that text itself, or a digest of it.
    Texts that are null or empty, or that either side does not give back byte by
    byte, have no tokens: zeros, and an empty string. Rows count as documents of
    their own whatever their id, so null and repeated ids do no harm; other
    columns are not read; an empty table gives no rows. Long texts are encoded
    part by part; a stretch without a common boundary is held whole. The other
    arguments bound what a task holds; the result does not depend on them.
    """
    a_path, b_path = a_path or vocabulary(A_FILE), b_path or vocabulary(B_FILE)
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text"))
    schema = (
        f"run long, slot int, doc {kind}, n_a long, n_b long, n_groups long, n_links long, groups string,"
        " radix int, head binary, body binary"
    )
    made = cut_lineage(arrow(rows, _runs(a_path, b_path, spell, run_chars, min(run_docs, 1 << _SLOT), block), schema))
    parts, texts = made.filter("radix IS NOT NULL"), made.filter("radix IS NULL")
    runs = texts.filter("slot = 0").count()
    counts = _counts(parts.select("run", "radix", "head"), runs, fan)
    # copies of the counts weigh no more than what they are copied to
    weight = parts.agg(F.sum(F.length("body"))).first()[0] or 0
    copy = counts.agg(F.sum(F.length("head"))).first()[0] or 1
    lanes = max(1, math.ceil(runs / LANE), min(math.ceil(runs / share), math.ceil(weight / copy)))
    own = parts.select(F.pmod(F.xxhash64("run"), F.lit(lanes)).cast("int").alias("lane"), "radix", "run", "head", "body")
    each = F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)))
    copied = counts.select(each.alias("lane"), "radix", F.lit(None).cast("long").alias("run"), "head", F.lit(None).cast("binary").alias("body"))
    sides = copied.unionByName(own).repartitionById(_slots(docs, lanes), F.col("lane") % _slots(docs, lanes)).sortWithinPartitions("lane", "radix", F.col("run").asc_nulls_first())
    sums = arrow(sides, _look_up, "run long, slot int, n_best long, count_sum long")
    zero = {c: F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")}
    documents = texts.join(sums, ["run", "slot"], "left").select(
        F.col("doc").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", *zero.values(), "groups"
    )
    found = cut_lineage(documents)
    unlink(made)
    return Alignment(found, counts)


def _digest(groups: str) -> str:
    return hashlib.sha256(groups.encode()).hexdigest() if groups else ""


def op12_alignment(spark, sf_dir):
    """All documents' links between byte_bpe_50k.json and piece_bpe_32k.model, groups as a digest."""
    found = align(table(spark, sf_dir, "documents"), spell=_digest).documents
    return found.withColumnRenamed("groups", "groups_sha256")
