import hashlib
import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import compare
from lodestream.llm import mixing as M


def water(children, budget):
    """Shares of {name: (weight, cap)} by filling up step by step."""
    share = {n: 0.0 for n in children}
    active = {n for n, (w, c) in children.items() if w > 0 and c > 0}
    left = float(budget)
    while active and left > 1e-9:
        total = sum(children[n][0] for n in active)
        step = min([left / total] + [(children[n][1] - share[n]) / children[n][0] for n in active])
        for n in active:
            share[n] += step * children[n][0]
        left -= step * total
        active = {n for n in active if share[n] < children[n][1] - 1e-9}
    return share


def plain_budgets(leaves, total, weights, max_epochs):
    """leaves: {(domain, lang, source): tokens}; budgets as real numbers."""

    def weight(level, name):
        return weights[level].get(name, weights[level].get(None, 0))

    def cap(prefix):
        own = [k for k in leaves if k[: len(prefix)] == prefix]
        ok = [k for k in own if all(weight(M.LEVELS[i], k[i]) > 0 for i in range(max(0, len(prefix) - 1), 3))]
        return sum(leaves[k] * max_epochs for k in ok)

    def down(prefix, budget):
        if len(prefix) == 3:
            return {prefix: budget}
        names = {k[: len(prefix) + 1] for k in leaves if k[: len(prefix)] == prefix}
        shares = water({n: (weight(M.LEVELS[len(prefix)], n[-1]), cap(n)) for n in names}, budget)
        out = {}
        for n in names:
            out |= down(n, shares[n])
        return out

    return down((), min(total, cap(())))


WEIGHTS = {"domain": {"web": 5, "books": 3, None: 1}, "lang": {"en": 6, "de": 3, "xx": 0, None: 1}, "source": {None: 2, "s1": 7}}


@pytest.mark.parametrize("total", [0, 100, 5_000, 40_000, 10**7])
def test_budgets_fill_siblings_first(spark, total):
    rng = random.Random(total)
    leaves = {
        (d, l, s): rng.choice([0, 3, 50, 400, 3000])
        for d in ("web", "books", "other")
        for l in ("en", "de", "fr", "xx")
        for s in ("s1", "s2", "s3")
    }
    frame = spark.createDataFrame([(*k, v) for k, v in leaves.items()], "domain string, lang string, source string, tokens long")
    got = {(r.domain, r.lang, r.source): r.budget for r in M.budgets(frame, total, WEIGHTS, max_epochs=2).collect()}
    want = plain_budgets(leaves, total, WEIGHTS, 2)
    assert set(got) == set(want)
    for k in want:
        assert abs(got[k] - want[k]) <= 5, (k, got[k], want[k])
        assert got[k] <= 2 * leaves[k]


def test_prefixes_by_hand(spark):
    rng = random.Random(8)
    rows = [
        (i, i, rng.choice([0, 1, 5, 80]), rng.choice(["web", "books"]), rng.choice(["en", "de", None]), rng.choice(["s1", "s2"]))
        for i in range(1500)
    ]
    frame = spark.createDataFrame(rows, "mix_key long, mix_id long, n_tokens long, domain string, lang string, source string")
    got = defaultdict(list)
    for r in M.select_mix(frame, 0.8, WEIGHTS, 3).collect():
        got[r.domain, r.lang, r.source].append((r.mix_id, r.epoch))
    leaves, members = defaultdict(int), defaultdict(list)
    for _, i, n, d, l, s in rows:
        leaves[d, l or "", s] += n
        members[d, l or "", s].append((i, n))
    total = math.floor(0.8 * sum(leaves.values()))
    tree = spark.createDataFrame([(*k, v) for k, v in leaves.items()], "domain string, lang string, source string, tokens long")
    plan = {(r.domain, r.lang, r.source): r.budget for r in M.budgets(tree, total, WEIGHTS, max_epochs=3).collect()}
    for leaf, own in members.items():
        whole = min(3, plan[leaf] // max(1, leaves[leaf]))
        want = [(i, e) for i, _ in own for e in range(whole)]
        order = sorted(own, key=lambda m: (hashlib.md5(f"{M.SEED}/{whole}/{m[0]}".encode()).hexdigest(), m[1]))
        used = 0
        for i, n in order if whole < 3 else []:
            used += n
            if used <= plan[leaf] - whole * leaves[leaf]:
                want.append((i, whole))
        assert sorted(got.get(leaf, [])) == sorted(want), leaf


def test_edge_cases(make_docs):
    none = M.select_mix(M.prepared(make_docs([])))
    assert none.count() == 0
    docs = make_docs([(1, None, None, None), (2, "", "en", "src1"), (3, "a b", "en", "src1"), (3, "a b", "en", "src1"), (None, "c d e", None, "x")])
    got = M.select_mix(M.prepared(docs), rate=1.0)
    assert got.filter("epoch = 0").agg(F.sum("n_tokens")).first()[0] <= 7
    assert {r.source for r in got.collect()} <= {"", "src1", "x"}


def test_query_equals_sql(spark, sf):
    assert compare.difference(spark, compare.duck(sf), sf, "op6_mixing") is None
    shares = entry.queries()["op6_mixing"](spark, sf).groupBy("domain").agg(F.sum("n_tokens").alias("n")).collect()
    total = sum(r.n for r in shares)
    assert total > 0
    for r in shares:
        assert abs(r.n / total - M.WEIGHTS["domain"][r.domain] / 1000) < 0.1
