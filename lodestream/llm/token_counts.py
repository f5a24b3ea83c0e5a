"""Token counts of whole texts without encoding most of them."""

import functools
import re
import unicodedata

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.common import arrow, table
from lodestream.llm.tokens import PATTERN, encoder, segments, vocabulary

#: Tokens above which a text is over the limit.
LIMIT = 512
#: Counts of merged pre-tokens that a worker remembers, and the length of the longest that is worth it.
MEMO, MEMO_CHARS = 1 << 17, 48


def whole_tokens(path: str) -> frozenset[str] | None:
    """The vocabulary strings that the library encodes, alone, as one token: proved by encoding each.

    None where the shortcut does not hold: the file is no byte-level BPE with
    its split pattern, so pre-tokens cannot be told apart here.
    """
    coder = encoder(path, True)
    if coder.coder is None:
        return None
    strings = []
    for token in coder.coder.token_byte_values():
        try:
            strings.append(token.decode())
        except UnicodeDecodeError:  # part of a character: never a pre-token
            pass
    found = coder.library.encode_batch(strings, add_special_tokens=False)
    return frozenset(s for s, e in zip(strings, found) if len(e.ids) == 1 and s not in coder.added)


@functools.cache
def _unassigned() -> re.Pattern:
    """Code points without a meaning in this Python's Unicode tables; pattern engines differ about them."""
    ranges, start = [], None
    for point in range(0x110001):
        blank = point < 0x110000 and unicodedata.category(chr(point)) == "Cn"
        if blank and start is None:
            start = point
        elif not blank and start is not None:
            ranges.append(f"\\U{start:08x}-\\U{point - 1:08x}")
            start = None
    return re.compile(f"[{''.join(ranges)}]")


class _Sizes(dict):
    """Tokens of a pre-token: one for each proven whole token; others are merged when first met."""

    def __init__(self, whole, merge):
        super().__init__(dict.fromkeys(whole, 1))
        self.whole, self.merge = whole, merge

    def __missing__(self, piece):
        n = len(self.merge(piece))
        if len(piece) <= MEMO_CHARS:
            if len(self) >= len(self.whole) + MEMO:
                self.clear()
                self.update(dict.fromkeys(self.whole, 1))
            self[piece] = n
        return n


class TokenCounter:
    """How many tokens a text has, from its pre-tokens.

    A pre-token split off by the vocabulary's pattern is encoded on its own, so
    one that is a proven whole token counts as one; only the others are merged.
    Added tokens are cut out first and count as one each. Parts of a text with
    unassigned code points, which pattern engines class by their own version of
    Unicode, are encoded by the library.
    """

    def __init__(self, path: str, whole: frozenset[str]):
        import regex

        self.coder = encoder(path, True)
        self.split = regex.compile(PATTERN).findall
        self.size = _Sizes(whole, self.coder.coder._encode_single_piece)

    def _ordinary(self, text):
        n = 0
        for part in segments(text):
            if not part.isascii() and _unassigned().search(part):
                n += len(self.coder.encode(part))
            else:
                n += sum(map(self.size.__getitem__, self.split(part)))
        return n

    def count(self, text: str) -> int:
        added = self.coder.added
        if not added or not any(token in text for token in added):
            return self._ordinary(text)
        parts = self.coder.marks.split(text)
        return len(parts) // 2 + sum(self._ordinary(p) for p in parts[::2] if p)


def _library(path: str):
    """Count by the file's own library, with its defaults."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: len(model.encode(text))
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


@functools.lru_cache(maxsize=1)
def _counter(path, whole):
    return TokenCounter(path, whole).count if whole is not None else _library(path)


def token_counts(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, limit: int = LIMIT
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every text, as the vocabulary file's library counts it.

    No begin, end or added special tokens; special strings inside a text count
    as its default has them. n_bytes is the UTF-8 length; over_limit is whether
    n_tokens is above limit. A null text is empty: no bytes, no tokens. Rows
    with a null or repeated id are counted like any other; other columns are not
    read. A text of any length is taken part by part. Which strings are whole
    tokens is proved once, here, and sent along: as many as the vocabulary has,
    whatever the data. Nothing is shuffled, and a lost task counts its rows again.
    """
    path = path or vocabulary()
    whole = whole_tokens(path) if path.endswith(".json") else None
    id_type = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        count = _counter(path, whole)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            n = np.fromiter(map(count, texts), np.int64, len(texts))
            size = [len(t) if t.isascii() else len(t.encode()) for t in texts]
            yield {"doc_id": batch.column("doc_id"), "n_bytes": size, "n_tokens": n, "over_limit": n > limit}

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return arrow(rows, run, f"doc_id {id_type}, n_bytes long, n_tokens long, over_limit boolean")


def op13_token_counts(spark, sf_dir):
    """Token counts of all documents by byte_bpe_50k.json."""
    return token_counts(table(spark, sf_dir, "documents"))
