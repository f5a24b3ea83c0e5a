import math
import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from lodestream.llm import components as C
from lodestream.llm import simhash as S


def plain_print(text, shingle=3):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    grams = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """prints: {id: fingerprint}."""
    ids = sorted(prints)
    top = {i: i for i in ids}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for x in ids:
        for y in ids:
            if x < y and (prints[x] ^ prints[y]).bit_count() <= 3:
                a, b = sorted((find(x), find(y)))
                top[b] = a
    return {i: find(i) for i in ids}


def texts():
    rng = random.Random(3)
    words = ["Alpha", "beta", "GAMMA", "délta", "ß", "x1", " nb", "zeta,"]
    out = [None, "", " \t\n", "one", "one two", "ONE two", "one two three", "a" * 50_000]
    for _ in range(60):
        base = [rng.choice(words) + str(rng.randrange(40)) for _ in range(rng.randrange(3, 90))]
        out.append(rng.choice([" ", "\n", "\t  "]).join(base))
        changed = list(base)
        changed[rng.randrange(len(base))] += "!"
        out.append(" ".join(changed))
    return out + out[:12]


def test_fingerprint_equals_plain():
    for t in texts():
        assert S.fingerprint((t or "").encode()) == plain_print(t)


def test_long_text_in_blocks(monkeypatch):
    text = " ".join(f"w{i % 700}" for i in range(3000))
    monkeypatch.setattr(S, "BLOCK", 100)
    assert S.fingerprint(text.encode()) == plain_print(text)


def test_groups_equal_brute_force(make_docs):
    rows = list(enumerate(texts()))
    got = {r.id: r for r in S.simhash_groups(make_docs(rows)).collect()}
    prints = {i: plain_print(t) for i, t in rows}
    want = plain_components(prints)
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.fp & (2**64 - 1) for i, r in got.items()} == prints


def test_links_of_planted_fingerprints(spark):
    """Fingerprints zero to five bits from some centre, and chains of them, at two prefix widths."""
    rng = random.Random(5)
    prints = set()
    for _ in range(40):
        centre = rng.getrandbits(64)
        prints.add(centre)
        for bits in range(1, 6):
            for _ in range(3):
                prints.add(centre ^ sum(1 << k for k in rng.sample(range(64), bits)))
    prints = sorted(prints)
    signed = [(p - 2**64 if p >= 2**63 else p,) for p in prints]
    frame = spark.createDataFrame(signed, "fp long")
    star = {r.a: r.b for r in C.components(S._linked(frame, 3)).collect()}
    want = plain_components({p[0]: p[0] & (2**64 - 1) for p in signed})
    assert {p[0]: star.get(p[0], p[0]) for p in signed} == want


def test_hot_prefixes_are_split(spark, monkeypatch):
    """A family of near copies beside other fingerprints: no group above the limit, the same components."""
    rng = random.Random(8)
    centre = rng.getrandbits(64)
    prints = {centre ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(6))) for _ in range(900)}
    for _ in range(60):
        lone = rng.getrandbits(64)
        prints |= {lone, lone ^ 7 << rng.randrange(60)}
    signed = sorted(p - 2**64 if p >= 2**63 else p for p in prints)
    frame = spark.createDataFrame([(p,) for p in signed], "fp long")
    want = plain_components({p: p & (2**64 - 1) for p in signed})
    for hot in (3000, 40_000):
        monkeypatch.setattr(S, "HOT", hot)
        dealt, _ = S._dealt(frame, 4)
        assert len(dealt) > 2
        for bits, rows in dealt:
            groups = {}
            for r in rows.collect():
                groups.setdefault(r.prefix & (1 << bits) - 1, []).append(r.fp & (2**64 - 1))
            for prefix, own in groups.items():
                assert len(own) == len(set(own))
                made = 0
                for p in own:
                    flips, rest = (p >> 64 - bits ^ prefix).bit_count(), 64 - bits
                    exactly = [1] if p.bit_count() % 2 == 0 else [0, 2]
                    made += sum(math.comb(rest, d - flips) for d in exactly if d >= flips)
                assert made <= hot
        star = {r.a: r.b for r in C.components(S._linked(frame, 3)).collect()}
        assert {p: star.get(p, p) for p in signed} == want


def test_groups_of_whole_variants(spark, monkeypatch):
    """With a limit of one variant, prefixes grow to all 64 bits."""
    monkeypatch.setattr(S, "HOT", 1)
    monkeypatch.setattr(S, "MORE", 20)
    prints = [0, 1, 3, 7, 15, -1, -2, -(2**63), 2**40, 2**40 + 2**50, 12345]
    frame = spark.createDataFrame([(p,) for p in prints], "fp long")
    star = {r.a: r.b for r in C.components(S._linked(frame, 3)).collect()}
    assert {p: star.get(p, p) for p in prints} == plain_components({p: p & (2**64 - 1) for p in prints})


def test_empty_and_repeated(make_docs, spark):
    assert S.simhash_groups(make_docs([])).count() == 0
    rows = [(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (None, None), (7, "")]
    got = sorted((r.id or -1, r.component_id) for r in S.simhash_groups(make_docs(rows)).collect())
    assert got == [(-1, 1), (-1, 7), (1, 1), (1, 1), (7, 7)]


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(100, 400)]
    star = [(5, i) for i in range(500, 900)]
    pairs = path + star + [(7, 7)]
    random.Random(1).shuffle(pairs)
    found = {r.a: r.b for r in C.components(spark.createDataFrame(pairs, "a long, b long").repartition(7)).collect()}
    assert found == {**{i: 100 for i in range(101, 401)}, **{i: 5 for i in range(500, 900)}}


def test_forest():
    a, b = S.forest(np.array([5, 3, 9, 4]), np.array([3, 1, 8, 5]))
    assert dict(zip(a.tolist(), b.tolist())) == {3: 1, 5: 1, 4: 1, 9: 8}


def test_query_on_whole_table(spark, sf):
    got = S.op4_simhash(spark, sf)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = plain_components({i: plain_print(t) for i, t in docs.items()})
    rows = got.collect()
    assert {r.doc_id: r.component_id for r in rows} == want
    assert all(r.fingerprint == f"{plain_print(docs[r.doc_id]):016x}" for r in rows)
    assert got.select(F.length("fingerprint")).distinct().collect()[0][0] == 16
