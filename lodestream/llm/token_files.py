"""Packed token ids: best-fit decreasing with a segment tree over free space."""

import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.common import arrow, table
from lodestream.llm.tokens import encoder, vocabulary
from lodestream.session import fresh_dir

WIDTH = 2048
END = 50_256
#: Remainders that a task sorts and packs together.
BLOCK = 8192


class FreeSpace:
    """Bins by free space, in a tree that finds the least space that is enough in log steps.

    Leaf c counts the bins with c places free; an inner node its leaves' sum.
    """

    def __init__(self, width: int):
        self.leaves = 1 << width.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.bins = [[] for _ in range(width + 1)]

    def _add(self, space: int, change: int):
        node = space + self.leaves
        while node:
            self.count[node] += change
            node >>= 1

    def put(self, space: int, name):
        self.bins[space].append(name)
        self._add(space, 1)

    def best(self, size: int):
        """(space, bin) with the least space of at least size, taken out; None if there is none."""
        node = size + self.leaves
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        space = node - self.leaves
        self._add(space, -1)
        return space, self.bins[space].pop()


def best_fit(sizes, width: int) -> list[list[int]]:
    """Members of each bin: items by falling size, each into the fullest bin that has room."""
    free, out = FreeSpace(width), []
    for item in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = free.best(sizes[item])
        if found is None:
            found = width, len(out)
            out.append([])
        space, name = found
        out[name].append(item)
        free.put(space - sizes[item], name)
    return out


def _id_type(path: str, end: int):
    return np.dtype("<u2") if max(encoder(path).size, end + 1) <= 1 << 16 else np.dtype("<u4")


def _packed(width, end, path):
    def run(batches):
        sequence = TaskContext.get().partitionId() << 40
        kind = _id_type(path, end)
        held = []

        def row(pieces):
            nonlocal sequence
            grid = np.full(width, end, kind)
            ends = np.cumsum([0, *(len(ids) for _, _, ids in pieces)])
            for (_, _, ids), at in zip(pieces, ends):
                grid[at : at + len(ids)] = ids
            sequence += 1
            return sequence - 1, grid.tobytes(), ends.tolist(), ends[:-1].tolist(), [d for d, _, _ in pieces], [s for _, s, _ in pieces]

        def columns(rows):
            names = ("sequence_id", "ids", "cu_seqlens", "resets", "doc_ids", "starts")
            return dict(zip(names, (list(c) for c in zip(*rows)))) if rows else None

        def packed():
            return [row([held[i] for i in members]) for members in best_fit([len(ids) for _, _, ids in held], width)]

        for batch in batches:
            coder, rows = encoder(path), []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = np.append(coder.ids(text), np.uint32(end)).astype(kind)
                for start in range(0, len(ids), width):
                    piece = doc, start, ids[start : start + width].copy()
                    if len(piece[2]) == width:
                        rows.append(row([piece]))
                    else:
                        held.append(piece)
                if len(held) >= BLOCK:
                    rows += packed()
                    held.clear()
                if len(rows) >= 512:
                    yield columns(rows)
                    rows = []
            if rows:
                yield columns(rows)
        if held:
            yield columns(packed())

    return run


def pack_tokens(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, end: int = END, path: str | None = None
) -> DataFrame:
    """Rows of a matrix of token ids, each with the layout of its segments.

    sequence_id; ids: width little-endian ids (16 bits if the vocabulary allows,
    else 32), padded with the end id; cu_seqlens: cumulative segment lengths from
    0; resets: where positions start again from 0; doc_ids and starts: whose ids
    a segment holds, and how many of them come before. A document is its text's
    ids and the end id (a null text the end id alone); one that is longer than a
    row is split, full rows first, and loses nothing. Nothing is shuffled: a task
    packs what it reads, block by block.
    """
    id_type = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = (
        f"sequence_id long, ids binary, cu_seqlens array<int>, resets array<int>, doc_ids array<{id_type}>, starts array<long>"
    )
    return arrow(rows, _packed(width, end, path or vocabulary()), schema)


def write_tokens(docs: DataFrame, folder: str, **layout) -> DataFrame:
    """Pack docs, write the matrix rows to folder and read them back."""
    packed = pack_tokens(docs, **layout)
    packed.write.parquet(folder)
    return docs.sparkSession.read.schema(packed.schema).parquet(folder)


def _digests(batches):
    for batch in batches:
        kept = [c for c in batch.schema.names if c != "ids"]
        crc = [zlib.crc32(v) for v in batch.column("ids").to_pylist()]
        yield {**{c: batch.column(c) for c in kept}, "ids_crc32": crc}


def op10_token_files(spark, sf_dir):
    """The written rows of all documents, with a checksum in place of the ids."""
    written = write_tokens(table(spark, sf_dir, "documents"), fresh_dir(spark, "tokens"))
    kinds = {f.name: f.dataType.simpleString() for f in written.schema.fields if f.name != "ids"}
    schema = ", ".join(f"{n} {k}" for n, k in kinds.items())
    digest = arrow(written, _digests, f"{schema}, ids_crc32 long")
    return digest.withColumn("n_tokens", F.element_at("cu_seqlens", -1))
