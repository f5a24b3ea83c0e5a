import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestream.llm import langid as L

PIECES = (("ab", ("abab abba ba",)), ("cd", ("cdcd ccd dcc", "Äc dä")))


def plain_codes(text):
    out = []
    for c in text.lower():
        if c.isalpha():
            out.append(c)
        elif out and out[-1] != " ":
            out.append(" ")
    return "".join(out)


def plain_phrases(text, train, segment):
    """Greedy longest matches, by substring search."""
    codes, total = plain_codes(text), 0
    for s in range(0, len(codes), segment):
        part = codes[s : s + segment]
        at = 0
        while at < len(part):
            size = 1
            while at + size < len(part) and part[at : at + size + 1] in train:
                size += 1
            if part[at] not in train:
                size = 1
            total += 1
            at += size
    return total


@pytest.mark.parametrize("segment", [7, 1024])
def test_phrases_equal_substring_search(monkeypatch, segment):
    monkeypatch.setattr(L, "SEGMENT", segment)
    monkeypatch.setattr(L, "BLOCK", 50)
    parser = L.Parser(PIECES)
    rng = random.Random(2)
    texts = ["", "...", None, "zzz", "AB ba", "äc"] + ["".join(rng.choice("abcd  ä.X") for _ in range(rng.randrange(1, 49))) for _ in range(80)]
    size, phrases = parser.parse(texts)
    for k, (_, own) in enumerate(PIECES):
        train = plain_codes(" ".join(own))
        assert phrases[k].tolist() == [plain_phrases(t or "", train, segment) for t in texts]
    assert size.tolist() == [len(plain_codes(t or "")) for t in texts]


def test_long_text_is_read_whole(monkeypatch):
    parser = L.Parser(PIECES)
    langs, _ = parser.predict(["abab " * 10 + "cdcd dcc " * 5000, "cdcd " * 10 + "abba ba " * 5000])
    assert langs == ["cd", "ab"]


def test_edge_cases(make_docs, spark):
    docs = make_docs([(1, None), (2, ""), (3, "12 .."), (4, "abab"), (4, "abab"), (None, "ccd")])
    docs = docs.withColumn("lang_pred", F.lit(3))
    got = L.identify(docs, PIECES)
    assert sorted(got.columns) == sorted({*docs.columns, "score"})
    assert sorted((r.doc_id or -1, r.lang_pred) for r in got.collect()) == [(-1, "cd"), (1, "und"), (2, "und"), (3, "und"), (4, "ab"), (4, "ab")]
    assert L.identify(make_docs([]), PIECES).count() == 0
    assert L.sample(make_docs([(1, "abc"), (2, None)])) == ()
    assert {r.lang_pred for r in L.identify(docs, ()).collect()} == {"und"}


def test_sample_is_bounded_and_distinct(spark):
    rows = [(i, f"text {'abc' * (i % 50)} " + "x" * 3000, "l" + str(i % 3)) for i in range(3000)] + [(i, "same words", "l0") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    pieces = L.sample(docs, chars=5000)
    assert [l for l, _ in pieces] == ["l0", "l1", "l2"]
    for _, own in pieces:
        assert sum(map(len, own)) < 5000 + L.PIECE and len(set(own)) == len(own)


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = L.op7_language_id(spark, sf).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
    held = [r for r in got if r.held_out and r.lang]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.9


def large_alphabets(rng):
    """Eight made-up languages: four share Latin letters, two have 300 Han letters each, two 300 Hangul letters."""
    alphabets = [[chr(97 + c) for c in rng.sample(range(26), 18)] for _ in range(4)]
    for first in (0x4E00, 0xAC00):
        letters = [chr(first + c) for c in rng.sample(range(3000), 600)]
        alphabets += [letters[:300], letters[300:]]
    return {f"l{k}": ["".join(rng.choice(a) for _ in range(rng.randrange(2, 6))) for _ in range(400)] for k, a in enumerate(alphabets)}


def test_every_letter_of_a_large_alphabet_counts():
    rng = random.Random(21)
    words = large_alphabets(rng)
    parser = L.Parser(tuple((l, (" ".join(rng.choices(w, k=6000)),)) for l, w in words.items()))
    for lang in ("l4", "l5", "l6", "l7"):
        texts = [" ".join(rng.choices(words[lang], k=2)) for _ in range(200)]
        assert parser.predict(texts)[0] == [lang] * 200


def test_edges_step_as_the_table_does(monkeypatch):
    rng = random.Random(5)
    words = large_alphabets(rng)
    pieces = tuple((l, (" ".join(rng.choices(w, k=300)),)) for l, w in words.items())
    texts = [" ".join(rng.choices(words[rng.choice(list(words))], k=rng.randrange(1, 40))) for _ in range(100)] + ["ж zq 漢", ""]
    found = []
    for entries in (0, 1 << 40):
        monkeypatch.setattr(L, "TABLE", entries)
        size, phrases = L.Parser(pieces).parse(texts)
        found.append((size.tolist(), phrases.tolist()))
    assert found[0] == found[1]
