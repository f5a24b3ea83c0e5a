"""Every stage against a plain version of it, on what the stage before it kept."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_packing import check_pieces
from test_simhash import plain_components, plain_print
from test_suffixes import plain_without_words
from tokenizers import Tokenizer

import corpus_pipeline as P
from lodestream.llm import mixing
from lodestream.llm.tokens import vocabulary

KIND = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """Name to (input rows, output rows) over a small table."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = {}
    for name, stage in P.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, sf).write.parquet(path)
        after = spark.read.parquet(path)
        out[name] = docs.collect(), after.collect()
        docs = after
    return out


def test_shape(stages):
    assert [n for n, _ in P.STAGES] == ["language_id", "simhash_near_dedup", "suffix_array_dedup", "mixing", "packing"]
    for name in [n for n, _ in P.STAGES][:-1]:
        assert list(stages[name][1][0].asDict()) == P.COLUMNS
    assert P.ORACLE_SQL is None


def test_language_id(stages):
    before, after = stages["language_id"]
    assert {r.doc_id for r in after} == {r.doc_id for r in before if r.text and any(c.isalpha() for c in r.text)}
    said = {r.doc_id: r.lang for r in before}
    assert np.mean([r.lang == said[r.doc_id] for r in after]) > 0.9
    assert {r.doc_id: r.text for r in after}.items() <= {r.doc_id: r.text for r in before}.items()


def test_near_duplicates(stages):
    before, after = stages["simhash_near_dedup"]
    groups = plain_components({r.doc_id: plain_print(r.text) for r in before})
    assert sorted(r.doc_id for r in after) == sorted(set(groups.values()))
    assert len(after) < len(before)
    assert set(after) <= set(before)


def test_repeated_passages(stages):
    before, after = stages["suffix_array_dedup"]
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before)
    kept = {r.doc_id: r.text for r in after}
    want = list(plain_without_words([r.text for r in before], P.PASSAGE_WORDS))
    assert [kept[r.doc_id] for r in before] == want
    assert any(w != r.text for w, r in zip(want, before))
    assert all(r.n_chars == len(r.text) for r in after)


def test_mixture(stages):
    before, after = stages["mixing"]
    assert set(after) <= set(before) and len({r.doc_id for r in after}) == len(after)
    words = {r.doc_id: len((r.text or "").split()) for r in before}
    budget = math.floor(P.MIX_RATE * sum(words.values()))
    used = sum(words[r.doc_id] for r in after)
    assert 0.6 * budget < used <= budget
    assert mixing.MAX_EPOCHS == 4


def test_packing(stages):
    before, after = stages["packing"]
    tokenizer = Tokenizer.from_file(vocabulary())
    tokenizer.encode_special_tokens = True
    check_pieces(after, [(r.doc_id, r.text) for r in before], lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids)


def test_run_equals_the_stages(spark, sf, stages):
    got = P.run(spark, sf).select("doc_id", "start", "length", "ids_crc32", "doc_tokens").collect()
    total = {}
    for r in got:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    want = {}
    for r in stages["packing"][1]:
        want[r.doc_id] = want.get(r.doc_id, 0) + r.length
    assert total == want


def frame(spark, rows):
    df = spark.createDataFrame(rows, KIND)
    for name in ("key", "__key", "root", "lang_pred", "fp"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def test_stages_on_odd_rows(spark, sf):
    long = "Wörter ohne Ende und noch mehr davon. " * 3000
    rows = [
        (1, None, None, None, None), (2, "", "en", "src1", 0), (3, "...", "en", "src1", 3), (4, "some words here", "en", "src1", 15),
        (4, "some words here", "en", "src1", 15), (None, "other words there", None, None, 17), (None, "other words there", None, None, 17),
        (5, long, "de", "src2", len(long)), (6, long, "de", "src3", len(long)), (7, "x", "", "", -1),
    ]
    for name, stage in P.STAGES:
        out = stage(spark, frame(spark, rows), sf)
        out.collect()
        empty = stage(spark, frame(spark, []), sf)
        assert empty.columns == out.columns and empty.count() == 0, name
    assert sorted((r.doc_id or 0, r.text[:4]) for r in P.language_id(spark, frame(spark, rows), sf).collect()) == [
        (0, "othe"), (0, "othe"), (4, "some"), (4, "some"), (5, "Wört"), (6, "Wört"), (7, "x")
    ]
    kept = P.near_duplicates(spark, frame(spark, rows), sf).collect()
    assert sorted(r.doc_id or 0 for r in kept) == [0, 1, 3, 4, 5, 7]
    cleaned = {r.doc_id: r.text for r in P.repeated_passages(spark, frame(spark, rows), sf).collect()}
    assert cleaned[1] is None and cleaned[5] == cleaned[6] == "" and cleaned[4] == "some words here"


def test_without_labels_languages_stay(spark, sf):
    rows = [(1, "some words", None, "s", 10), (2, "12", None, "s", 2)]
    assert [tuple(r) for r in P.language_id(spark, frame(spark, rows), sf).collect()] == [rows[0]]
