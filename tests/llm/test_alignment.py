import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lodestream.llm import alignment as A
from lodestream.llm.queries import QUERIES
from lodestream.llm.tokens import vocabulary

SMALL = {"run_chars": 20_000, "block": 900, "fan": 3, "share": 2}


@pytest.fixture(scope="module")
def brute():
    """Plain alignment: pairs as a multiset for each document, counted in a dictionary."""
    left = Tokenizer.from_file(vocabulary(A.A_FILE))
    left.encode_special_tokens = True
    right = sentencepiece.SentencePieceProcessor(model_file=vocabulary(A.B_FILE))
    printing = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printing]
    sign = {chr(b): b for b in printing} | {chr(256 + n): b for n, b in enumerate(others)}

    def piece(i):
        p = right.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if right.is_byte(i) else p.replace("▁", " ").encode()

    def groups(text):
        if not text:
            return None
        a, b = left.encode(" " + text, add_special_tokens=False).ids, right.encode(text)
        ends = []
        for side in ([bytes(sign[c] for c in left.id_to_token(i)) for i in a], [piece(i) for i in b]):
            if b"".join(side) != (" " + text).encode():
                return None
            ends.append(np.cumsum([len(t) for t in side]).tolist())
        out, i, j = [], 0, 0
        for stop in sorted(set(ends[0]) & set(ends[1])):
            p, q = ends[0].index(stop, i) + 1, ends[1].index(stop, j) + 1
            out.append((a[i:p], b[j:q]))
            i, j = p, q
        return out

    def align(docs):
        found = [(d, groups(t)) for d, t in docs]
        links = [[(x, y) for p, q in own or () for x in p for y in q] for _, own in found]
        count, top = Counter(), defaultdict(int)
        for own in links:
            count.update(set(own))
        for (x, _), n in count.items():
            top[x] = max(top[x], n)
        rows = []
        for (d, own), pairs in zip(found, links):
            text = ";".join(f"{','.join(map(str, p))}|{','.join(map(str, q))}" for p, q in own or ())
            n_a, n_b = (sum(len(g[k]) for g in own or ()) for k in (0, 1))
            best = sum(count[p] == top[p[0]] for p in pairs)
            rows.append((d, n_a, n_b, len(own or ()), len(pairs), best, sum(count[p] for p in pairs), text))
        return rows, count, top

    return align


def same(found, want):
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, found), key=key) == sorted(want, key=key)


TRICKY = [
    None, "", " ", "  a", "a  b\n\n c ", "<|endoftext|> and <s> </s> <unk>", "it's 12 345,6!!", "日本語 テキスト 😀 x", "a▁b", "x\x00y", "﻿a",
    "a" * 3000, " " * 2500 + "x", "\n" * 900, "word " * 3000, "été " * 500, "<0x41> <0x0A>", "the", "the", "tab\t\tq \x1c r",
]


@pytest.mark.parametrize("sizes", [{}, SMALL, {"run_docs": 1, "fan": 2}])
def test_equals_plain_alignment(spark, make_docs, brute, sizes):
    rng = random.Random(3)
    words = ["the", "of", "Ärger", "naïve", "x1", "42", "...", "ing", "straße", "日", "qwzx"]
    rows = list(enumerate(TRICKY)) + [(None, "the end"), (7, "the end"), (7, "the end")]
    rows += [(100 + n, " ".join(rng.choice(words) for _ in range(rng.randrange(60)))) for n in range(40)]
    want, count, top = brute(rows)
    found = A.align(make_docs(rows), **sizes)
    same(found.documents.collect(), want)
    assert {(r.a, r.b): (r.n_docs, r.best) for r in found.pairs().collect()} == {p: (n, n == top[p[0]]) for p, n in count.items()}


def test_wide_stretch(spark, make_docs, brute):
    """Long stretches without a common boundary: pairs with their multiplicity."""
    rows = [(0, "aea" * 200), (1, "*." * 200 + " the " + "aae" * 150), (2, "aea" * 200)]
    want = brute(rows)[0]
    assert max(r[4] for r in want) > 20_000
    same(A.align(make_docs(rows)).documents.collect(), want)


def test_empty_tables(spark, make_docs):
    found = A.align(make_docs([(1, "a")]).limit(0))
    assert found.documents.collect() == [] and found.pairs().collect() == []
    found = A.align(make_docs([(1, None), (2, "")]))
    assert [tuple(r)[1:] for r in found.documents.collect()] == [(0, 0, 0, 0, 0, 0, "")] * 2 and found.pairs().count() == 0


def test_very_long_text(spark, make_docs):
    """Twenty blocks of one document count each pair once."""
    text = "some words of a long text. " * 60_000
    found = A.align(make_docs([(1, text), (2, text[:270])]), block=1 << 16)
    long, short = found.documents.orderBy("doc_id").collect()
    assert long.n_groups > 100_000 and long.groups.startswith(short.groups.rsplit(";", 1)[0])
    assert max(r.n_docs for r in found.pairs().collect()) == 2


def test_frames_round_trip():
    arrays = [np.array([5, -3, 1 << 60]), np.zeros(0, np.int64), np.arange(1000)]
    assert all((x == y).all() for x, y in zip(A._unpack(A._pack(*arrays)), arrays, strict=True))


def test_query_on_whole_table(spark, sf, brute):
    import hashlib

    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = [(*r[:7], hashlib.sha256(r[7].encode()).hexdigest() if r[7] else "") for r in brute(docs)[0]]
    found = QUERIES["op12_alignment"](spark, sf)
    names = "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()
    same(found.select(*names).collect(), want)
    assert found.columns == names
