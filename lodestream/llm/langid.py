"""Language identification by cross-parsing against suffix automata."""

import functools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestream.llm.common import arrow, table

#: Bounds of the training sample: languages, characters a language, characters taken from one document.
MAX_LANGUAGES = 256
TRAIN_CHARS = 32_768
PIECE = 1_000
#: A text is parsed in segments of this many letters, all of a batch abreast.
SEGMENT = 512
#: Characters a worker parses at once, and rows it turns into text at once.
BLOCK = 1 << 20
ROWS = 500
#: Entries of the largest transition table; a language with more states times letters keeps sorted edges.
TABLE = 1 << 23
#: Letters that weigh in the score; the prediction uses them all.
SCORE_LETTERS = 32

_END, _ONE = 28, 1 << 28
_STATE = _ONE - 1
OTHER, FIRST = 1, 2


def sample(docs: DataFrame, text: str = "text", lang: str = "lang", row_id: str = "doc_id", chars: int = TRAIN_CHARS):
    """((lang, pieces), ...): a bounded sample of labelled text, which is all that the driver gets.

    The MAX_LANGUAGES most frequent labels count. A document is taken by a hash
    of its id and text, at a rate that gives each label about the same number;
    one piece from the middle of each is kept, repeated pieces once.
    """
    rows = docs.select(F.col(row_id).alias("i"), F.col(text).alias("t"), F.col(lang).alias("l")).filter(
        r"l IS NOT NULL AND t RLIKE '\\p{L}'"
    )
    counts = {r.l: r.n for r in rows.groupBy("l").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l").limit(MAX_LANGUAGES).collect()}
    if not counts:
        return ()
    want = max(64, min(512, 8192 // len(counts)))
    rates = F.create_map(*[F.lit(x) for l, n in counts.items() for x in (l, min(1 << 20, (3 * want << 19) // n + 1))])
    draw = F.xxhash64("i", "t")
    taken = (
        rows.withColumn("h", draw)
        .filter(F.pmod("h", F.lit(1 << 20)) < F.coalesce(F.element_at(rates, F.col("l")), F.lit(0)))
        .select("l", "h", F.substring("t", F.greatest(F.lit(1), F.floor((F.length("t") - PIECE) / 2) + 1).cast("int"), F.lit(PIECE)).alias("t"))
        .groupBy("l", "t")
        .agg(F.min("h").alias("h"))
        .orderBy("l", "h", "t")
        .collect()
    )
    pieces = {}
    for r in taken:
        own = pieces.setdefault(r.l, [])
        if sum(map(len, own)) < chars:
            own.append(r.t)
    return tuple((l, tuple(own)) for l, own in sorted(pieces.items()))


class _Dense:
    """Transitions as a table: one step is one look-up."""

    def __init__(self, follow, letters):
        self.letters = letters
        root = np.full(letters, 2 * _ONE, np.int32)
        for c, to in follow[0].items():
            root[c] = to * letters | _ONE
        way = np.tile(root, (len(follow), 1))
        way[0] = _ONE  # no phrase was open: only the new letter counts
        for state, edges in enumerate(follow):
            for c, to in edges.items():
                way[state, c] = to * letters
        self.way = way.ravel()

    def step(self, state, codes):
        found = self.way.take(state + codes, mode="clip")
        return found & _STATE, found >> _END


class _Sparse:
    """Transitions as sorted edges, at most three a letter of the sample: for alphabets whose table would be large."""

    def __init__(self, follow, letters):
        self.letters = letters
        edges = sorted((s * letters + c, to) for s, own in enumerate(follow) for c, to in own.items())
        self.edge = np.array([e for e, _ in edges] or [-1], np.int64)
        self.to = np.array([t for _, t in edges] or [0], np.int32)
        self.root = np.zeros(letters, np.int32)
        for c, to in follow[0].items():
            self.root[c] = to

    def step(self, state, codes):
        wanted = state.astype(np.int64) * self.letters + codes
        at = np.minimum(np.searchsorted(self.edge, wanted), len(self.edge) - 1)
        on = self.edge[at] == wanted
        again = self.root[codes]
        ended = np.where(state == 0, 1, np.where(again == 0, 2, 1))
        return np.where(on, self.to[at], again), np.where(on, 0, ended)


def _automaton(codes, letters: int):
    """Transitions of the suffix automaton of a text, made for greedy parsing.

    step(states, letters) gives the next states and the phrases that ended.
    Where the automaton has no way on, a phrase ends: the step leads on from the
    root and counts one phrase, or two if even the single letter is new. A table
    of at most TABLE entries is used as such, else the edges; both step alike.
    """
    follow, link, length = [{}], [-1], [0]
    last = 0
    for c in codes:
        new = len(follow)
        follow.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and c not in follow[at]:
            follow[at][c] = new
            at = link[at]
        if at >= 0:
            old = follow[at][c]
            if length[at] + 1 == length[old]:
                link[new] = old
            else:
                copy = len(follow)
                follow.append(dict(follow[old]))
                length.append(length[at] + 1)
                link.append(link[old])
                while at >= 0 and follow[at].get(c) == old:
                    follow[at][c] = copy
                    at = link[at]
                link[old] = link[new] = copy
        last = new
    return (_Dense if len(follow) * letters <= TABLE else _Sparse)(follow, letters)


class Parser:
    """Counts, for every text and language, the phrases of a greedy longest-match parse.

    Each language tells all letters of its own sample apart; a letter that its
    sample has not is a phrase by itself.
    """

    def __init__(self, pieces):
        self.langs = [l for l, _ in pieces]
        train = [" ".join(own).lower() for _, own in pieces]
        heard = [sorted({c for c in t if c.isalpha()}) for t in train]
        code = {c: FIRST + k for k, c in enumerate(sorted(set().union(*heard)))}
        self.kind = np.uint16 if len(code) < 0xFFF0 else np.uint32
        self.lut = np.zeros(0x110000, self.kind)
        for point in range(0x110000):
            c = chr(point)
            if c.isalpha():
                self.lut[point] = code.get(c.lower(), OTHER)
        self.own, self.ways, self.bits = [], [], []
        for t, letters in zip(train, heard):
            own = np.full(FIRST + len(code), OTHER, np.int32)
            own[0] = 0
            own[[code[c] for c in letters]] = np.arange(FIRST, FIRST + len(letters))
            codes = own[self._codes([t])[0]]
            self.own.append(own)
            self.ways.append(_automaton(codes.tolist(), FIRST + len(letters)))
            self.bits.append(np.log2(max(2, len(codes))))

    def _codes(self, texts):
        """Letter codes of all texts in one array, each stretch of other characters a single zero; lengths."""
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = np.cumsum([0, *map(len, texts)])[:-1]
        codes = self.lut[points]
        keep = codes != 0
        keep[1:] |= codes[:-1] != 0
        keep[starts] = codes[starts] != 0
        return codes[keep], np.add.reduceat(keep, starts, dtype=np.int64)

    def _block(self, texts):
        """Letters and phrases of texts that are not empty: arrays (texts,) and (languages, texts)."""
        codes, lengths = self._codes(texts)
        parts = -(-lengths // SEGMENT)
        owner = np.repeat(np.arange(len(texts)), parts)
        part = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        size = np.minimum(SEGMENT, lengths[owner] - part * SEGMENT)
        start = (np.cumsum(lengths) - lengths)[owner] + part * SEGMENT
        order = np.argsort(-size, kind="stable")
        size, start, owner = size[order], start[order], owner[order]
        phrases = np.zeros((len(self.ways), len(texts)), np.int64)
        if len(size) == 0:
            return lengths, phrases
        abreast = np.searchsorted(-size, -np.arange(size[0]), side="left")
        grid = np.zeros((size[0], len(size)), self.kind)
        for t in range(size[0]):
            grid[t, : abreast[t]] = codes[start[: abreast[t]] + t]
        for k, (own, way) in enumerate(zip(self.own, self.ways)):
            state = np.zeros(len(size), np.int32)
            count = np.zeros(len(size), np.int32)
            for t in range(size[0]):
                n = abreast[t]
                state[:n], ended = way.step(state[:n], own.take(grid[t, :n]))
                count[:n] += ended
            phrases[k] = np.bincount(owner, count + (state != 0), len(texts)).astype(np.int64)
        return lengths, phrases

    def parse(self, texts):
        """(letters and gaps, phrases by language) of each text; None counts as empty."""
        size = np.zeros(len(texts), np.int64)
        phrases = np.zeros((len(self.ways), len(texts)), np.int64)
        rows, held, chars = [], [], 0

        def flush():
            n, p = self._block(held)
            np.add.at(size, rows, n)
            for k in range(len(self.ways)):
                np.add.at(phrases[k], rows, p[k])

        for row, whole in enumerate(texts):
            for start in range(0, len(whole or ""), BLOCK):
                piece = whole[start : start + BLOCK]
                rows.append(row)
                held.append(piece)
                chars += len(piece)
                if chars >= BLOCK:
                    flush()
                    rows, held, chars = [], [], 0
        if held:
            flush()
        return size, phrases

    def predict(self, texts):
        """(language or und, score) of each text."""
        size, phrases = self.parse(texts)
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        cost = phrases * np.array(self.bits)[:, None] / np.maximum(size, 1)
        best = cost.argmin(axis=0)
        margin = (cost - cost.min(axis=0)) * np.minimum(size, SCORE_LETTERS)
        score = 1 / np.exp2(-margin).sum(axis=0)
        known = size > 0
        return [self.langs[b] if k else "und" for b, k in zip(best, known)], np.where(known, score, 0.0)


@functools.lru_cache(maxsize=1)
def parser(pieces) -> Parser:
    """Automata are built from the sample once in each worker."""
    return Parser(pieces)


def identify(docs: DataFrame, pieces, text: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """All columns of docs, with the predicted language and a score from 0 to 1.

    A text is lower-cased, its letters are kept and everything between them is
    one gap. It is cut greedily into the longest phrases that occur in a
    language's sample (segment by segment); the phrase count times the log of
    the sample's length, by the text's length, estimates its cross entropy. The
    language with the least wins, ties go to the first by name. A text that is
    null or has no letter, and every text if nothing was learnt, is `und` with
    score 0. Columns of docs named like the two new ones are replaced.
    """
    kept = [f for f in docs.schema.fields if f.name not in (lang_out, score_out)]
    schema = T.StructType([*kept, T.StructField(lang_out, T.StringType()), T.StructField(score_out, T.DoubleType())])

    def run(batches):
        for whole, start in ((b, k) for b in batches for k in range(0, b.num_rows, ROWS)):
            batch = whole.slice(start, ROWS)
            langs, scores = parser(pieces).predict(batch.column(text).to_pylist())
            yield {**{f.name: batch.column(f.name) for f in kept}, lang_out: langs, score_out: scores}

    # a replaced column may also be the text
    source = docs if text in [f.name for f in kept] else docs.withColumn(text, F.col(text))
    return arrow(source, run, schema)


def held_out(doc_id: str = "doc_id") -> F.Column:
    """True where crc32 of the id as text leaves 2 on division by 4; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op7_language_id(spark, sf_dir):
    """Language of every document, learnt from labelled documents that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out().alias("held_out"))
    pieces = sample(docs.filter("NOT held_out"))
    return identify(docs.select("doc_id", "text", "held_out"), pieces).select("doc_id", "held_out", "lang_pred", "score")
