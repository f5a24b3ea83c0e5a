import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lodestream.llm import quality_rules as Q


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(5)}
    n = len(words)
    return (
        n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:k] for k, x in enumerate(lines)),
        len(covered), n < 10 or 100 * len(covered) > 20 * n,
    )


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def texts():
    rng = random.Random(6)
    out = [None, "", " \n\t ", "a", "As " * 50, "a b c d e " * 2, "a b c d e\n" * 30, "é ß\u00a0x\x1cy", "| " * 20 + "#<>*", "x" * 100_000]
    out += ["a b c d e f", "a a a a a", "a a a a a a", "\n\n x \n x\n x \n", " lead and trail "]
    for _ in range(80):
        vocabulary = [rng.choice(["w", "Wé", "$x", "y!"]) + str(k) for k in range(rng.choice([2, 6, 40, 400]))]
        out.append("".join(rng.choice(vocabulary) + rng.choice([" ", "\n", "  ", "\t", "\r\n"]) for _ in range(rng.randrange(1, 200))))
    return out


def test_counts_equal_plain(make_docs):
    rows = list(enumerate(texts()))
    got = {r.id: tuple(r[c] for c in COLUMNS) for r in Q.counts(make_docs(rows)).collect()}
    assert got == {i: plain(t) for i, t in rows}


def test_only_built_in_functions(make_docs):
    plan = Q.counts(make_docs([(1, "a b")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def feature_frame(spark, n=3000):
    """Bad are those with many symbols, and those with long words and many capitals; a few labels are wrong."""
    rng = random.Random(3)
    rows = []
    for i in range(n):
        symbols, chars, capitals = rng.random(), rng.uniform(2, 12), rng.random()
        bad = symbols > 0.8 or (chars > 9 and capitals > 0.5)
        rows.append((i * 7919, float(rng.randrange(10, 500)), chars, symbols, rng.random(), rng.random(), capitals, rng.random(), rng.random(), int(bad ^ (rng.random() < 0.02))))
    return rows, spark.createDataFrame(rows, "key long, " + ", ".join(f"{f} double" for f in Q.FEATURES) + ", bad int")


def test_learns_the_planted_rules(spark):
    rows, frame = feature_frame(spark)
    rules = Q.learn(frame)
    assert {c.feature for rule in rules for c in rule} >= {"symbols_per_word", "capitals_share", "chars_per_word"}
    kept, _ = Q.verdict(rules)
    right = frame.select(((~kept).cast("int") == F.col("bad")).cast("int").alias("r")).agg(F.avg("r")).first()[0]
    assert right > 0.93


def test_conditions_equal_counting_by_hand(spark):
    rows, frame = feature_frame(spark, 400)
    cuts = {f: sorted({float(x) for x in np.quantile([r[k + 1] for r in rows], [0.2, 0.5, 0.8])}) for k, f in enumerate(Q.FEATURES)}
    got, gain = Q._best_condition(frame, cuts)
    best = 0.0
    for k, f in enumerate(Q.FEATURES):
        for t in cuts[f]:
            for above in (False, True):
                hit = [r for r in rows if (r[k + 1] > t) == above]
                bad = sum(r[-1] for r in hit)
                all_bad = sum(r[-1] for r in rows)
                best = max(best, Q._gain(bad, len(hit) - bad, all_bad, len(rows) - all_bad))
    assert abs(gain - best) < 1e-9
    column = 1 + list(Q.FEATURES).index(got.feature)
    hit = [r for r in rows if (r[column] > got.threshold) == got.above]
    bad = sum(r[-1] for r in hit)
    assert abs(Q._gain(bad, len(hit) - bad, sum(r[-1] for r in rows), sum(1 - r[-1] for r in rows)) - gain) < 1e-9


def test_rules_apply_in_order(spark):
    rules = [[Q.Condition("words", True, 5.0)], [Q.Condition("words", True, 2.0), Q.Condition("digits_share", False, 0.5)]]
    kept, which = Q.verdict(rules)
    frame = spark.createDataFrame([(9.0, 0.1), (3.0, 0.1), (3.0, 0.9), (1.0, 0.0)], "words double, digits_share double")
    assert [tuple(r) for r in frame.select(kept, which).collect()] == [(False, 1), (False, 2), (True, None), (True, None)]


def test_edge_cases(spark, make_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = make_docs([(1, None), (2, "a b c d e f g h i j k"), (2, "a b c d e f g h i j k"), (None, "x")])
    got = sorted((r.id or -1, r.kept) for r in Q.judged(docs, none).collect())
    assert got == [(-1, False), (1, False), (2, True), (2, True)]
    assert Q.judged(make_docs([]), none).count() == 0
    odd = spark.createDataFrame([(2, None), (2, 1), (2, 5), (None, 0)], "doc_id long, quality int")
    assert Q.judged(docs, odd).filter("kept").count() == 2


def test_query_on_whole_table(spark):
    """Counts against the plain ones, verdicts against the labels."""
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = Q.op8_quality_rules(spark, sf).collect()
    assert {r.doc_id: tuple(r[c] for c in COLUMNS) for r in rows} == {i: plain(t) for i, t in docs.items()}
    kept = {r.doc_id: r.kept for r in rows}
    assert not any(r.kept for r in rows if r.base_failed)
    labels = [(kept[r.doc_id], r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    good = [k for k, q in labels if q == 1]
    bad = [k for k, q in labels if q == 0]
    print("good kept", np.mean(good), "bad kept", np.mean(bad))
    assert np.mean(good) > 0.8 and np.mean(bad) < 0.5
