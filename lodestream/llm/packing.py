"""Vector bin packing: sequences under limits on tokens, segments and loss-bearing tokens."""

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestream.llm.common import arrow, table
from lodestream.llm.token_counts import token_counts
from lodestream.llm.tokens import encoder, vocabulary

#: Tokens, segments and loss-bearing tokens a sequence may hold.
LIMITS = (1024, 64, 1024)
#: For texts whose sequences should be full however short the texts are: no piece is shorter than a token.
FULL_LIMITS = (1024, 1024, 1024)
#: For whole conversations.
CONVERSATION_LIMITS = (3072, 16, 2304)
#: Examples a task chooses from.
POOL = 2048


class Packer:
    """Fills one sequence after another from a pool by the dot-product heuristic.

    Of the examples that fit, the one whose demand has the largest dot product
    with what is left goes in, each dimension weighted by the pool's mean demand.
    If none fits and cutting is allowed, the largest is cut to fill the tokens
    that are left. Examples that exceed a limit by themselves get a sequence of
    their own.
    """

    def __init__(self, limits, cut: bool, pool: int = POOL):
        self.limits = np.array(limits, np.float64)
        self.cut = cut
        self.pool = pool
        self.size = np.zeros((pool + 1, len(limits)))
        self.item = [None] * (pool + 1)
        self.n = 0

    def add(self, item, size):
        """Sequences that become full: each a list of (item, tokens)."""
        if (np.asarray(size) > self.limits).any():
            return [[(item, int(size[0]))]]
        self._put(item, size)
        return [self._fill()] if self.n >= self.pool else []

    def rest(self):
        while self.n:
            yield self._fill()

    def _put(self, item, size):
        self.size[self.n] = size
        self.item[self.n] = item
        self.n += 1

    def _take(self, at):
        item, size = self.item[at], self.size[at].copy()
        self.n -= 1
        self.size[at] = self.size[self.n]
        self.item[at] = self.item[self.n]
        self.item[self.n] = None
        return item, size

    def _fill(self):
        left, out = self.limits.copy(), []
        share = self.size[: self.n] / self.limits
        weight = share.mean(axis=0)
        while self.n:
            size = self.size[: self.n]
            fits = (size <= left).all(axis=1)
            if not fits.any():
                break
            gain = size @ (weight * left / self.limits**2)
            at = int(np.where(fits, gain, -1.0).argmax())
            item, size = self._take(at)
            out.append((item, int(size[0])))
            left -= size
        room = int(min(left[0], left[2])) if self.cut else 0
        if room > 0 and left[1] >= 1 and self.n:
            item, size = self._take(int(self.size[: self.n, 0].argmax()))
            head, tail = item.split(room)
            out.append((head, room))
            self._put(tail, (size[0] - room, size[1], max(0, size[2] - room)))
        return out


class _Piece:
    """A stretch of a document's ids."""

    __slots__ = ("row", "start", "ids", "total")

    def __init__(self, row, start, ids, total):
        self.row, self.start, self.ids, self.total = row, start, ids, total

    def split(self, at):
        head = _Piece(self.row, self.start, self.ids[:at], self.total)
        return head, _Piece(self.row, self.start + at, self.ids[at:], self.total)


def _first_sequence() -> int:
    return TaskContext.get().partitionId() << 40


def _texts(limits, path, special):
    def run(batches):
        packer, sequence = Packer(limits, cut=True), _first_sequence()
        width = limits[0]

        def rows(sequences):
            nonlocal sequence
            out = {c: [] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}
            for pieces in sequences:
                at = 0
                for piece, length in pieces:
                    values = piece.row, piece.start, length, zlib.crc32(piece.ids), piece.total, sequence, at
                    for column, value in zip(out.values(), values):
                        column.append(value)
                    at += length
                sequence += 1
            return out

        for batch in batches:
            coder, made = encoder(path, special), []
            for row, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = np.append(coder.ids(text), np.uint32(0))
                n = len(ids)
                for start in range(0, n, width):
                    piece = _Piece(row, start, ids[start : start + width].copy(), n)
                    length = len(piece.ids)
                    if length == width:
                        made.append([(piece, length)])
                    else:
                        made += packer.add(piece, (length, 1, length - (start == 0)))
            yield rows(made)
        yield rows(packer.rest())

    return run


def pack_texts(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limits=LIMITS, path: str | None = None, special: bool = False
) -> DataFrame:
    """Every text's ids and an end id 0, cut and packed into sequences: a row for each piece.

    Returned: doc_id, start (the document's ids before the piece), length,
    ids_crc32 (little-endian 32-bit ids), doc_tokens, sequence_id, offset. Full
    sequences are cut off first, remainders are packed, so only the last
    sequences of a task are padded. Every id but a document's first bears loss.
    A null or empty text has the end id alone. With special, the vocabulary's
    added tokens in a text get their own ids; else they are ordinary text. Nothing is shuffled: a task packs
    the documents it reads, so a lost task is read and packed again alike.
    """
    id_type = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return arrow(rows, _texts(tuple(limits), path or vocabulary(), special), schema)


def pack_examples(examples: DataFrame, tokens: str, segments: str, loss: str, limits=LIMITS) -> DataFrame:
    """Whole examples, such as conversations, packed under all three limits.

    All columns are kept; sequence_id and offset (in tokens) are added or
    replaced. Null sizes count as zero. An example above a limit is alone in its
    sequence, so nothing is dropped.
    """
    names = [f for f in examples.schema.fields if f.name not in ("sequence_id", "offset")]
    schema = T.StructType([*names, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches):
        packer, sequence = Packer(limits, cut=False), _first_sequence()

        def rows(sequences):
            nonlocal sequence
            for members in sequences:
                at = np.cumsum([0, *(length for _, length in members)])
                parts = pa.Table.from_batches([row for row, _ in members])
                yield {
                    **{f.name: parts.column(f.name) for f in names},
                    "sequence_id": np.full(len(members), sequence),
                    "offset": at[:-1],
                }
                sequence += 1

        for batch in batches:
            sizes = np.stack([batch.column(c).fill_null(0).to_numpy() for c in (tokens, segments, loss)], axis=1)
            for k, size in enumerate(sizes):
                yield from rows(packer.add(batch.slice(k, 1), size))
        yield from rows(packer.rest())

    return arrow(examples, run, schema)


def conversation_sizes(turns: DataFrame, path: str | None = None) -> DataFrame:
    """(conv_id, n_tokens, n_turns, n_loss): the tokens of each conversation, its turns and the answers' tokens.

    A null text has no tokens, a null role is no answer; turns without conv_id
    are one conversation. Turns are counted where they are read and summed
    before the shuffle, so a conversation of any length is one row.
    """
    own = F.struct("conv_id", F.coalesce(F.col("role") == "assistant", F.lit(False)).alias("answer")).alias("turn")
    counted = token_counts(turns.select(own, "text"), "turn", "text", path).select("doc_id.conv_id", "doc_id.answer", "n_tokens")
    return counted.groupBy("conv_id").agg(
        F.sum("n_tokens").alias("n_tokens"),
        F.count("*").alias("n_turns"),
        F.sum(F.when(F.col("answer"), F.col("n_tokens")).otherwise(0)).alias("n_loss"),
    )


def packed_conversations(spark, sf_dir):
    """All conversations as instruction data: whole ones packed under limits on tokens, turns and answers' tokens."""
    sizes = conversation_sizes(table(spark, sf_dir, "conversations"))
    return pack_examples(sizes, "n_tokens", "n_turns", "n_loss", CONVERSATION_LIMITS)


def op9_packing(spark, sf_dir):
    """Pieces of all documents in sequences of up to 1,024 ids."""
    return pack_texts(table(spark, sf_dir, "documents"), limits=FULL_LIMITS, special=True)
