import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from lodestream.llm import suffixes as S


def plain_removed(texts, length):
    """Flags of the bytes that repeated strings cover, by listing all strings."""
    data = [(t or "").encode() for t in texts]
    seen = {}
    for d in data:
        for i in range(len(d) - length + 1):
            seen[d[i : i + length]] = seen.get(d[i : i + length], 0) + 1
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append(gone)
    return data, out


def plain_rows(texts, length):
    for d, gone in zip(*plain_removed(texts, length)):
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        kept = bytes(np.frombuffer(d, np.uint8)[~gone])
        yield len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 7))) for _ in range(n))


def texts(rng):
    """Copies, near copies, passages in many texts, periodic texts, repeats inside a text, short and null ones."""
    passages = [words(rng, 40), words(rng, 25), "la " * 60, "x" * 150]
    out = [None, "", "short", "x" * 300, "ab" * 200, "ab" * 31]
    for _ in range(40):
        t = words(rng, rng.randrange(5, 120))
        for _ in range(rng.randrange(0, 3)):
            p = rng.choice(passages)
            p = p[rng.randrange(0, 30) : len(p) - rng.randrange(0, 30)]
            at = rng.randrange(len(t))
            t = t[:at] + p + t[at:]
        out.append(t)
    for t in out[8:16]:
        out.append(t)
        at = rng.randrange(len(t))
        out.append(t[:at] + "!" + t[at + 1 :])
    out.append(out[20][:200] + out[20])
    return out


def digest(spark, docs, length):
    from pyspark.sql import functions as F

    spanned = S._spanned(docs.select("doc_id", "text"), "doc_id", "text", length)
    spanned = spanned.select("doc_id", "text", F.col("__spans").alias("spans"))
    return S.arrow(spanned, S._digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


@pytest.mark.parametrize("length, seed", [(40, 1), (64, 2), (300, 3)])
def test_equals_brute_force(spark, make_docs, length, seed):
    rng = random.Random(seed)
    own = texts(rng)
    if length == 300:
        own = [t and t * 2 + words(rng, 60) if i % 3 else t for i, t in enumerate(own)]
    got = {r.doc_id: tuple(r)[1:] for r in digest(spark, make_docs(list(enumerate(own))), length).collect()}
    assert got == dict(enumerate(plain_rows(own, length)))


def test_long_texts_in_pieces(spark, make_docs, monkeypatch):
    """Anchors at the seams of pieces are found once."""
    rng = random.Random(9)
    passage = words(rng, 150)
    own = [words(rng, 300) + passage + words(rng, 400), words(rng, 777) + passage[100:], words(rng, 900)]
    import pyarrow as pa

    whole, parts = [], []
    for size, into in ((1 << 18, whole), (500, parts)):
        monkeypatch.setattr(S, "PIECE", size)
        batch = pa.RecordBatch.from_pydict({"key": pa.array([1, 2, 3]), "text": pa.array(own)})
        for columns in S._anchors(S.Layout(400))([batch]):
            into += zip(columns["key"].to_pylist(), *(columns[c].tolist() for c in ("pos", "cell", "core", "hull")))
    assert sorted(whole) == sorted(parts) and len(set(whole)) == len(whole)
    monkeypatch.undo()
    got = {r.doc_id: tuple(r)[1:] for r in digest(spark, make_docs(list(enumerate(own))), 400).collect()}
    assert got == dict(enumerate(plain_rows(own, 400)))


def test_repeated_rows_and_empty(spark, make_docs):
    rng = random.Random(4)
    t, u = words(rng, 60), words(rng, 60)
    docs = make_docs([(1, t), (1, t), (None, u), (None, u), (3, None), (4, words(rng, 60))])
    got = sorted((r.doc_id or -1, r.n_removed) for r in digest(spark, docs, 50).collect())
    n, m = len(t.encode()), len(u.encode())
    assert got == [(-1, m), (-1, m), (1, n), (1, n), (3, 0), (4, 0)]
    assert digest(spark, make_docs([]), 50).count() == 0


def test_remove_keeps_characters_and_columns(spark, make_docs):
    rng = random.Random(6)
    passage = "é" * 40 + words(rng, 20) + "ß" * 40
    own = [words(rng, 20) + passage, passage + words(rng, 30), None, words(rng, 30)]
    docs = make_docs(list(enumerate(own)))
    out = S.remove_repeats(docs, length=61)
    assert out.columns == docs.columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert got[2] is None and got[3] == own[3]
    for i, (d, gone) in enumerate(zip(*plain_removed(own, 61))):
        if i < 2:
            assert gone.any()
            kept = bytes(np.frombuffer(d, np.uint8)[~gone]).decode(errors="ignore")
            assert got[i].replace("é", "").replace("ß", "") == kept.replace("é", "").replace("ß", "")
            assert abs(len(got[i]) - len(kept)) <= 2


def test_query_on_whole_table(spark, sf):
    rows = S.op2_suffix_array(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert {r.doc_id: tuple(r)[1:5] for r in rows} == dict(zip([d.doc_id for d in docs], plain_rows([d.text for d in docs], 400)))
    assert sum(r.n_removed for r in rows) > 0


def test_query_hands_on_the_text(spark, sf):
    """Whole characters: the text's bytes are the kept ones, but for parts of characters at the ends of runs."""
    rows = S.op2_suffix_array(spark, sf).collect()
    assert rows[0].__fields__[-1] == "text" and any(r.n_removed for r in rows)
    for r in rows:
        left = r.text.encode()
        assert r.n_bytes - r.n_removed <= len(left) <= r.n_bytes - r.n_removed + 6 * r.n_spans
        if left.isascii():
            assert hashlib.sha256(left).hexdigest() == r.kept_sha256


def test_last_bytes_decide(spark, make_docs):
    """Strings that share all but their first or last byte are told apart by bytes, not by digests."""
    rng = random.Random(12)
    core = words(rng, 160).replace("é", "f")[:399]
    own = [words(rng, 90) + f"{a}" + core + f"{b}" + words(rng, 90) for a, b in ("13", "23", "14", "45")]
    got = {r.doc_id: tuple(r)[1:] for r in digest(spark, make_docs(list(enumerate(own))), 400).collect()}
    want = dict(enumerate(plain_rows(own, 400)))
    assert got == want and [w[1] > 0 for w in want.values()] == [True, True, True, False]


def test_text_that_repeats_throughout_has_few_spans(spark, monkeypatch):
    monkeypatch.setattr(S, "PIECE", 4096)
    rows = spark.createDataFrame([(1, "a" * 20_000), (2, "b" * 100)], "id long, text string")
    found = S.repeated_spans(rows.select(S.wide_key("id").alias("key"), "text"), 400).collect()
    assert len(found) == 1 and len(found[0].spans) <= 5
    assert min(s.start for s in found[0].spans) == 0 and max(s.stop for s in found[0].spans) == 20_000


def plain_without_words(texts, n):
    """Texts without the words that repeated strings of n words cover, by listing all of them."""
    place = [list(re.finditer(r"[^ \x09-\x0D]+", t or "")) for t in texts]
    names = [[m.group() for m in own] for own in place]
    seen = Counter(tuple(own[i : i + n]) for own in names for i in range(len(own) - n + 1))
    for t, own, words_of in zip(texts, place, names):
        gone = np.zeros(len(own) + 1, bool)
        for i in range(len(own) - n + 1):
            if seen[tuple(words_of[i : i + n])] > 1:
                gone[i : i + n] = True
        out, at = "", 0
        for i, m in enumerate(own):
            if gone[i] and not (i and gone[i - 1]):
                out += t[at : m.start()]
            if gone[i]:
                at = m.end()
        out += (t or "")[at:]
        yield None if t is None else "" if gone.any() and not out.strip(" \t\n\v\f\r") else out


@pytest.mark.parametrize("n, piece", [(7, 1 << 18), (12, 1 << 18), (7, 1024)])
def test_repeated_words_equal_brute_force(spark, make_docs, monkeypatch, n, piece):
    rng = random.Random(n)
    own = [t and t.replace(" ", rng.choice([" ", "\n", " \t "])) for t in texts(rng)]
    own += [" ".join("abcde"[i % 5] for i in range(60)), " \n ", "a\u00a0b " * 30, "x" * 3000 + " end", "\x0b".join(own[10].split())]
    docs = make_docs(list(enumerate(own)))
    monkeypatch.setattr(S, "PIECE", piece)
    blocks = [list(S._blocks(np.frombuffer((t or "").encode(), np.uint8), np.frombuffer((t or "").encode(), np.uint8) == 32)) for t in own]
    assert all(b[-1][1] == len((t or "").encode()) for b, t in zip(blocks, own) if b)
    got = {r.doc_id: r.text for r in S.remove_repeated_words(docs, n).collect()}
    assert got == dict(enumerate(plain_without_words(own, n)))
    assert sum(a != b for a, b in zip(own, got.values())) > 5


def test_words_of_blocks_are_those_of_the_whole(monkeypatch):
    rng = random.Random(8)
    raw = np.frombuffer((words(rng, 900) + " " + "y" * 700 + " \n" + words(rng, 50)).encode(), np.uint8)
    whole = [x.tolist() for x in S._words(raw)]
    monkeypatch.setattr(S, "PIECE", 100)
    assert [x.tolist() for x in S._words(raw)] == whole
