import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lodestream.llm import prefix_trie as P
from lodestream.llm.queries import QUERIES


def turn_key(role, text):
    """The order of turns with one number."""
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16] + len(text).to_bytes(8, "big")


def conversations_of(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            out[conv].append((turn is not None, turn or 0, turn_key(role or "", text or ""), role or "", text or ""))
    return {c: [t[3:] for t in sorted(own)] for c, own in out.items()}


def rebuilt_of(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def nodes_of(convs):
    """Every prefix with its members, subtree sums by walking all deeper prefixes."""
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
        ends[tuple(convs[c])].append(c)
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, own in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(own) - 1) * (len(p[-1][1]) if p else 0)
    digest = {p: hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest() for p in members}
    return {
        (own[0], len(p)): (members[p[:-1]][0] if p else None, len(own), children[p], leaves[p], saved[p], digest[p])
        for p, own in members.items()
    }


COLUMNS = ["parent_conv_id", "n_convs", "n_children", "n_leaves"]


def found_of(frame, *more):
    rows = frame.collect()
    found = {(r.conv_id, r.depth): tuple(r[c] for c in [*COLUMNS, *more]) for r in rows}
    assert len(found) == len(rows)
    return found


@pytest.fixture
def turns(spark):
    def make(rows):
        frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
        return frame.withColumns({n: F.lit("x") for n in ("pos", "block", "hi", "lo", "level", "t0", "depth", "_slice")})

    return make


def some_rows(seed, n, longest):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.randrange(longest + 1) if c % 7 else longest):
            rows.append((c, t, rng.choice(["user", "bot"]) if t % 3 else "user", rng.choice(["a", "bb", "", "éé"]) if t % 4 else "x"))
    return rows


EDGES = [
    (3, None, "user", "first"), (3, None, "user", "also"), (3, 0, None, None), (3, 0, None, None), (3, 9000, "", ""), (3, -5, "u", "😀" * 9),
    (None, 1, "lost", "turn"), (-105, 1, "a", "b"), (-100, 1, "a", "b"), (-5, 0, "z", "z"), (200, 0, "q", "1"), (201, 0, "q", "1"),
    (205, 0, "q", "1"), (10**15, 0, "q", "1"), (10**15 + 7, 4, "q", "y" * 70_000),
]


@pytest.mark.parametrize("rows", [some_rows(1, 60, 6), some_rows(2, 230, 4), some_rows(3, 40, 37), EDGES, EDGES + some_rows(4, 30, 17)])
@pytest.mark.parametrize("build", [False, True])
def test_equals_plain_trie(spark, turns, rows, build, tmp_path):
    want = conversations_of(rows)
    if build:
        turns(rows).select("conv_id", "turn", "role", "text").write.parquet(str(tmp_path / "conversations.parquet"))
        found = found_of(P.op11_prefix_trie(spark, str(tmp_path)), "saved_tokens", "ends_sha256")
        assert found == nodes_of(rebuilt_of(want))
    else:
        found = found_of(P.prefix_trie(turns(rows)).nodes, "saved")
        assert found == {k: v[:-1] for k, v in nodes_of(want).items()}


def test_slices_carry_positions_and_nodes(spark, turns, monkeypatch):
    """Conversations over many slices, of turns and of blocks."""
    monkeypatch.setattr(P, "SLICE", 3)
    rows = some_rows(5, 12, 90)
    assert found_of(P.prefix_trie(turns(rows)).nodes, "saved") == {k: v[:-1] for k, v in nodes_of(conversations_of(rows)).items()}


def test_members_and_texts(spark, turns):
    rows = [(1, 0, "u", "hi"), (1, 1, "b", "yes"), (2, 0, "u", "hi"), (4, 0, "u", "hi"), (4, 1, "b", "yes")]
    found = P.prefix_trie(turns(rows))
    ends = found.members.join(found.nodes.withColumnRenamed("conv_id", "owner"), P.NODE)
    assert {(r.conv_id, r.owner, r.depth) for r in ends.collect()} == {(1, 1, 2), (2, 1, 1), (4, 1, 2)}
    said = found.nodes.join(P.turn_texts(turns(rows)), "turn_id")
    assert {(r.depth, r.role, r.text) for r in said.collect()} == {(1, "u", "hi"), (2, "b", "yes")}


def test_many_conversations_end_in_one_node(spark, turns, monkeypatch):
    monkeypatch.setattr(P, "IDS", 16)
    convs = spark.range(0, 5000).selectExpr("id * 3 AS conv_id")
    members = convs.selectExpr("conv_id", "conv_id % 2 AS hi", "0L AS lo")
    want = {k: ",".join(str(c) for c in range(0, 15000, 3) if c % 2 == k) for k in (0, 1)}
    found = {r.hi: r.ends_sha256 for r in P._ends(members).collect()}
    assert found == {k: hashlib.sha256(v.encode()).hexdigest() for k, v in want.items()}


def test_empty_table(spark, turns, tmp_path):
    turns([]).write.parquet(str(tmp_path / "conversations.parquet"))
    assert P.op11_prefix_trie(spark, str(tmp_path)).collect() == []


def test_query_on_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    frame = QUERIES["op11_prefix_trie"](spark, sf)
    assert dict(frame.dtypes) == {c: "bigint" for c in ["conv_id", "depth", *COLUMNS, "saved_tokens"]} | {"ends_sha256": "string"}
    assert found_of(frame, "saved_tokens", "ends_sha256") == nodes_of(rebuilt_of(conversations_of(rows)))
