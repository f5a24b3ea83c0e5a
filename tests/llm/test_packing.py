import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from lodestream.llm import packing as P
from lodestream.llm import token_files as B
from lodestream.llm import tokens as K


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(K.vocabulary())
    tokenizer.encode_special_tokens = True
    return lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids


TRICKY = [
    None, "", " ", "  ", " a", "a ", "a  b", "a   b  ", "x\n y", "x \ny", "x\n \ny", "\n\n z", "it's we'll 12 345,6!! ?",
    "<|endoftext|> end <|endoftext|>", "é ü  ß  x", "tab\t\tq \t r", "日本語 テキスト 😀 x", "a\x1c b \x1cd", "x" * 5000, " ".join(map(str, range(4000))), " " * 3000 + "x", "\n" * 3000,
]


def test_ids_equal_whole_encoding(plain):
    coder = K.Encoder(K.vocabulary())
    rng = random.Random(1)
    mixed = ["".join(rng.choice([" ", "  ", "\n", "a", "bc", "'s", "9", "é", "\t", "!"]) for _ in range(30)) for _ in range(400)]
    for text in TRICKY + mixed:
        assert coder.ids(text).tolist() == plain(text), repr(text)


ADDED = [
    "a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>", " <|endoftext|>\n\n<|endoftext|>x", "a  <|endoftext|>  b",
    "<|endoftext", "<|endoftext|", "<|<|endoftext|>|>", "é<|endoftext|>é", "<|ENDOFTEXT|>", "it<|endoftext|>'s", " \n <|endoftext|>",
]


def test_added_tokens_get_the_library_ids(spark, tmp_path):
    """The library's default against the coder, and the registered query and the pipeline's stage against it."""
    import corpus_pipeline

    tokenizer = Tokenizer.from_file(K.vocabulary())
    library = lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids
    coder = K.Encoder(K.vocabulary(), special=True)
    for text in TRICKY + ADDED:
        assert coder.ids(text).tolist() == library(text), repr(text)
    assert coder.ids("a <|endoftext|> b").tolist() == [64, 220, 50256, 275]
    docs = list(enumerate(TRICKY + ADDED))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    check_pieces(P.op9_packing(spark, str(tmp_path)).collect(), docs, library)
    check_pieces(corpus_pipeline.packed(spark, frame, str(tmp_path)).collect(), docs, library)


def test_files_with_other_settings_are_left_to_the_library(tmp_path, plain):
    import json

    whole = json.load(open(K.vocabulary()))
    whole["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "other.json").write_text(json.dumps(whole))
    assert K.ranks_of(whole) is None
    assert K.Encoder(str(tmp_path / "other.json")).ids("a b").tolist() == plain(" a b")
    assert len(K.ranks_of(json.load(open(K.vocabulary())))) == 50256
    assert K.encoder(K.vocabulary()).size == 50257


def check_pieces(rows, docs, plain, width=1024, most=64):
    """Each id in one piece, sequences gapless and within limits."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == {i for i, _ in docs}
    for i, text in docs:
        ids, at = [*plain(text), 0], 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= width and len(own) <= most
    return by_sequence


def test_texts(make_docs, plain):
    rng = random.Random(2)
    docs = list(enumerate(TRICKY + [" ".join(rng.choice(["ab", "cde", "f"]) for _ in range(rng.randrange(1, 1500))) for _ in range(150)]))
    rows = P.pack_texts(make_docs(docs).coalesce(1)).collect()
    found = check_pieces(rows, docs, plain)
    tokens = sum(r.length for r in rows)
    assert len(found) <= tokens // 1024 + 2
    assert P.pack_texts(make_docs([])).count() == 0
    twice = P.pack_texts(make_docs([(1, "a b"), (1, "a b"), (None, "a")])).collect()
    assert sorted((r.doc_id or 0, r.length) for r in twice) == [(0, 2), (1, 3), (1, 3)]


def test_segment_limit_holds_for_tiny_texts(make_docs, plain):
    docs = [(i, "a") for i in range(300)]
    check_pieces(P.pack_texts(make_docs(docs)).collect(), docs, plain)


@pytest.mark.parametrize("pool", [4, 50, 2048])
def test_examples_under_three_limits(spark, pool, monkeypatch):
    monkeypatch.setattr(P, "POOL", pool)
    rng = random.Random(pool)
    rows = [(i, rng.randrange(0, 120), rng.randrange(1, 6), rng.randrange(0, 60), "x") for i in range(700)]
    rows += [(1000, 500, 1, 2, "long"), (1001, 10, 50, 2, "many"), (1002, None, None, None, None)]
    frame = spark.createDataFrame(rows, "id long, n int, turns int, answer int, sequence_id string")
    limits = (300, 9, 100)
    out = P.pack_examples(frame.coalesce(1), "n", "turns", "answer", limits).collect()
    assert sorted(r.id for r in out) == sorted(r[0] for r in rows)
    groups = defaultdict(list)
    for r in out:
        groups[r.sequence_id].append(r)
    for own in groups.values():
        at = 0
        for r in sorted(own, key=lambda r: (r.offset, r.n or 0)):
            assert r.offset == at
            at += r.n or 0
        sums = [sum((r[c] or 0) for r in own) for c in ("n", "turns", "answer")]
        assert len(own) == 1 or all(s <= m for s, m in zip(sums, limits))
    need = max(sum(r[k] or 0 for r in rows[:700]) / limits[k - 1] for k in (1, 2, 3))
    if pool == 2048:
        assert len(groups) <= 1.15 * need + 3
    assert P.pack_examples(frame.limit(0), "n", "turns", "answer", limits).count() == 0


def test_conversations_as_instruction_data(spark, sf):
    """Turns are segments, answers bear loss."""
    talks = spark.read.parquet(f"{sf}/conversations.parquet").selectExpr(
        "conv_id", "size(split(coalesce(text, ''), ' ')) AS n", "role = 'assistant' AS answer"
    )
    sizes = talks.groupBy("conv_id").agg({"n": "sum", "*": "count"}).toDF("conv_id", "turns", "n")
    answers = talks.filter("answer").groupBy("conv_id").agg({"n": "sum"}).toDF("conv_id", "loss")
    out = P.pack_examples(sizes.join(answers, "conv_id", "left").coalesce(1), "n", "turns", "loss", (2048, 32, 1024)).collect()
    assert len({r.conv_id for r in out}) == sizes.count() == len(out)


def test_short_texts_fill_their_sequences(make_docs, plain):
    docs = [(i, None if i % 3 else "a") for i in range(5000)]
    rows = P.pack_texts(make_docs(docs).coalesce(1), limits=P.FULL_LIMITS).collect()
    total = sum(r.length for r in rows)
    assert len(rows) == 5000 and len({r.sequence_id for r in rows}) == -(-total // 1024)
    at = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length


def test_packed_conversations(spark, sf, plain):
    """Sizes equal the library's; every limit holds, and each excludes something."""
    turns = spark.read.parquet(f"{sf}/conversations.parquet").collect()
    want = defaultdict(lambda: [0, 0, 0])
    for r in turns:
        n = len(plain(r.text))
        own = want[r.conv_id]
        own[0], own[1], own[2] = own[0] + n, own[1] + 1, own[2] + n * (r.role == "assistant")
    out = P.packed_conversations(spark, sf).collect()
    assert {r.conv_id: [r.n_tokens, r.n_turns, r.n_loss] for r in out} == want and len(out) == len(want)
    groups = defaultdict(list)
    for r in out:
        groups[r.sequence_id].append((r.n_tokens, r.n_turns, r.n_loss))
    sums = [(len(own), *map(sum, zip(*own))) for own in groups.values()]
    assert all(n == 1 or all(s <= m for s, m in zip(own, P.CONVERSATION_LIMITS)) for n, *own in sums)
    # each limit excludes something: without it the packing is another
    sizes = P.conversation_sizes(spark.read.parquet(f"{sf}/conversations.parquet")).orderBy("conv_id").coalesce(1)
    packed = []
    for k in (None, 0, 1, 2):
        limits = [10**9 if k == j else m for j, m in enumerate(P.CONVERSATION_LIMITS)]
        packed.append(sorted((r.conv_id, r.sequence_id) for r in P.pack_examples(sizes, "n_tokens", "n_turns", "n_loss", limits).collect()))
    assert packed[0] not in packed[1:]
    odd = spark.createDataFrame([(1, "assistant", None), (1, None, "a b"), (None, "user", ""), (2, "user", "x")], "conv_id long, role string, text string")
    assert sorted((r.conv_id or 0, r.n_turns, r.n_loss) for r in P.conversation_sizes(odd).collect()) == [(0, 1, 0), (1, 2, 0), (2, 1, 0)]


def test_query_on_whole_table(spark, sf, plain):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check_pieces(P.op9_packing(spark, sf).collect(), docs, plain)


def plain_best_fit(sizes, width):
    bins = []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fits = [b for b in bins if b[0] >= sizes[i]]
        if fits:
            least = min(b[0] for b in fits)
            chosen = [b for b in fits if b[0] == least][-1]
        else:
            chosen = [width, []]
            bins.append(chosen)
        chosen[0] -= sizes[i]
        chosen[1].append(i)
    return bins


@pytest.mark.parametrize("width", [7, 64, 100])
def test_best_fit_decreasing(width):
    rng = random.Random(width)
    for n in (0, 1, 5, 300):
        sizes = [rng.randrange(1, width + 1) for _ in range(n)]
        got = B.best_fit(sizes, width)
        assert sorted(i for b in got for i in b) == list(range(n))
        assert all(sum(sizes[i] for i in b) <= width for b in got)
        assert sorted(width - sum(sizes[i] for i in b) for b in got) == sorted(b[0] for b in plain_best_fit(sizes, width))


def unpacked(rows, width, kind="<u2"):
    """(pieces by document, from the written rows alone)."""
    out = defaultdict(dict)
    for r in rows:
        ids = np.frombuffer(r.ids, kind)
        assert len(ids) == width and r.cu_seqlens[0] == 0 and r.resets == r.cu_seqlens[:-1]
        assert (ids[r.cu_seqlens[-1] :] == B.END).all()
        for a, b, doc, start in zip(r.cu_seqlens, r.cu_seqlens[1:], r.doc_ids, r.starts):
            assert start not in out[doc]
            out[doc][start] = ids[a:b].tolist()
    return out


def test_round_trip_through_files(spark, make_docs, plain, tmp_path, monkeypatch):
    monkeypatch.setattr(B, "BLOCK", 40)
    rng = random.Random(3)
    docs = list(enumerate(TRICKY + [" ".join(rng.choice(["ab", "cde", "f"]) for _ in range(rng.randrange(1, 300))) for _ in range(150)]))
    rows = B.write_tokens(make_docs(docs), str(tmp_path / "rows"), width=128).collect()
    assert len({r.sequence_id for r in rows}) == len(rows)
    found = unpacked(rows, 128)
    for i, text in docs:
        joined = [x for s in sorted(found[i]) for x in found[i][s]]
        assert joined == [*plain(text), B.END], i
    used = sum(r.cu_seqlens[-1] for r in rows)
    assert used / (128 * len(rows)) > 0.9
    assert B.pack_tokens(make_docs([])).count() == 0


def test_wide_ids(make_docs):
    rows = B.pack_tokens(make_docs([(1, "a b")]), width=16, end=70_000).collect()
    assert np.frombuffer(rows[0].ids, "<u4")[2:].tolist() == [70_000] * 14


def test_token_query(spark, sf, plain):
    out = B.op10_token_files(spark, sf)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    total = {i: 0 for i in docs}
    for r in out.collect():
        assert r.n_tokens <= B.WIDTH
        for a, b, doc in zip(r.cu_seqlens, r.cu_seqlens[1:], r.doc_ids):
            total[doc] += b - a
    assert total == {i: len(plain(t)) + 1 for i, t in docs.items()}


@pytest.mark.parametrize("sign", [" ", "\n", "\t"])
def test_long_white_space_runs(spark, sign):
    """Runs of 2,000,000, alone and before a word, that the fast encoder's pattern search cannot bear."""
    default = Tokenizer.from_file(K.vocabulary())
    library = lambda t: default.encode(t or "", add_special_tokens=False).ids
    docs = [(0, sign * 2_000_000), (1, f"a{sign * 2_000_000}word<|endoftext|>{sign * 60_000}"), (2, "plain")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    check_pieces(P.pack_texts(frame, special=True).collect(), docs, library)
    widths = {r.doc_ids[0]: 0 for r in B.pack_tokens(frame).select("doc_ids").collect()}
    assert set(widths) >= {0, 1}


def test_parts_of_long_texts(plain):
    coder, rng = K.Encoder(K.vocabulary()), random.Random(9)
    text = "".join(rng.choice(["a", " ", "  ", "\n ", " b", "é's ", " 12", "\x1c "]) for _ in range(150_000))
    assert "".join(K.segments(text)) == text and len(list(K.segments(text))) > 2
    assert coder.encode(text) == plain(text)
    assert list(K.segments("x" * 200_000)) == ["x" * 200_000] and list(K.segments("")) == [""]
