import random

import pytest
import sentencepiece
from tokenizers import Tokenizer

from lodestream.llm import token_counts as C
from lodestream.llm import tokens as K
from lodestream.llm.queries import QUERIES


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(K.vocabulary())
    return lambda t: len(tokenizer.encode(t or "", add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def counter():
    return C.TokenCounter(K.vocabulary(), C.whole_tokens(K.vocabulary()))


def test_whole_tokens_are_proved(library):
    whole = C.whole_tokens(K.vocabulary())
    assert 45_000 < len(whole) < 50_257 and " the" in whole and "<|endoftext|>" not in whole
    assert all(library(s) == 1 for s in whole)


def test_every_code_point(counter, library):
    """In contexts where its class (letter, number, white space or none) decides the split."""
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    for start in range(0, len(points), 400):
        text = "".join(f"a{c}a1{c}1!{c}!x {c} " for c in points[start : start + 400])
        assert counter.count(text) == library(text), hex(start)


TRICKY = [
    None, "", " ", "\n", "a  b", "it's we'll '' ''s", "<|endoftext|>", "a <|endoftext|><|endoftext|> b", "<|endoftext", "x" * 70_000,
    " " * 2_000_000 + "x", "word " * 40_000, "\x1c a \x85b", "日本語 テキスト 😀", "a͸b", "é n't",
]


def test_tricky_texts(counter, library):
    rng = random.Random(2)
    signs = ["a", " ", "  ", "\n", "<|endoftext|>", "é's ", "12", " the", "\x1c", "\x85", "'", "'ll", "!", "漢", "͸", "😀"]
    mixed = ["".join(rng.choice(signs) for _ in range(n)) for n in [40] * 300 + [90_000] * 2]
    for text in TRICKY[1:] + mixed:
        assert counter.count(text) == library(text), repr(text[:100])


def test_remembered_counts_are_bounded(library, monkeypatch):
    monkeypatch.setattr(C, "MEMO", 50)
    counter = C.TokenCounter(K.vocabulary(), C.whole_tokens(K.vocabulary()))
    rng = random.Random(4)
    text = " ".join("".join(rng.choice("abcdefghij") for _ in range(9)) for _ in range(2000))
    assert counter.count(text) == library(text)
    assert len(counter.size) <= len(counter.size.whole) + 51 and counter.size[" the"] == 1


def test_frame(spark, make_docs, library):
    rows = [(n, t) for n, t in enumerate(TRICKY)] + [(None, "a b"), (3, "again"), (3, "again")]
    found = C.token_counts(make_docs(rows), limit=3).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in found) == sorted(
        (str(n), len((t or "").encode()), library(t), library(t) > 3) for n, t in rows
    )
    assert C.token_counts(make_docs(rows[:1]).limit(0)).collect() == []


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "word_bpe_49k.json"])
def test_other_files_are_left_to_their_library(spark, make_docs, name):
    path, text = K.vocabulary(name), "Some  words, and <s> more\n"
    if name.endswith("model"):
        n = len(sentencepiece.SentencePieceProcessor(model_file=path).encode(text))
    else:
        assert C.whole_tokens(path) is None
        n = len(Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids)
    assert [r.n_tokens for r in C.token_counts(make_docs([(1, text)]), path=path).collect()] == [n]


def test_query_on_whole_table(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: (len((r.text or "").encode()), library(r.text)) for r in docs}
    found = QUERIES["op13_token_counts"](spark, sf).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in found} == want and len(found) == len(docs)
    assert all(r.over_limit == (r.n_tokens > 512) for r in found)
