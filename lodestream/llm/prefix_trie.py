"""Prefix trie of conversations by ROLLUP over positional turn-id columns.

A turn becomes an id. A conversation is cut into blocks of WIDTH turns, each a
row with the ids of its positions in columns t0, t1, ..; one ROLLUP over these
columns groups the blocks' prefixes of every length at once, and grouping_id
tells the lengths apart. A block row also carries the node its conversation has
come to in the block before, and is grouped under it: so one ROLLUP serves all
blocks, however long the longest conversation is.

What a node says of its subtree needs no walk up the tree. The smallest member
of a node owns it, and what a conversation owns is the lower end of its path.
Sums over a subtree are therefore sums over a node's members, of the length a
conversation owns and of the leaf it may own: a second ROLLUP.
"""

import hashlib
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestream.llm.common import arrow, cut_lineage, table, unlink

#: Turns of a block; turns, and blocks, of one conversation that are put in order together.
WIDTH = 8
SLICE = 1024
#: Conversation ids that are spelled together.
IDS = 4096

TURNS = [f"t{j}" for j in range(WIDTH)]
NODE = ["hi", "lo"]


class Trie(NamedTuple):
    """nodes: hi, lo (the node's id), depth, conv_id (its smallest member), parent_conv_id, turn_id (of its last turn),
    n_convs, n_children, n_leaves, saved; members: conv_id and the hi, lo of the node where it ends."""

    nodes: DataFrame
    members: DataFrame


def _turn_id(role, text) -> F.Column:
    """128 bits of the SHA-256 of role and text, then the text's length in code points."""
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    size = F.lpad(F.hex(F.length(text).cast("long")), 16, "0")
    return F.unhex(F.concat(F.substring(F.sha2(whole, 256), 1, 32), size))


def _chars(turn_id) -> F.Column:
    """The text's length in a turn id; 0 for a null."""
    return F.coalesce(F.conv(F.hex(F.substring(turn_id, 17, 8)), 16, 10).cast("long"), F.lit(0))


def _before(rows: DataFrame, order: list, slice_, sums: dict, xors: dict) -> DataFrame:
    """rows with sums and exclusive ors (name: column) over the rows of the same conversation before each.

    They run inside (conversation, slice); one small row per slice carries them
    across, so that a conversation with a large share of all rows is spread.
    """
    sliced = rows.withColumn("_slice", slice_)
    inside = Window.partitionBy("conv_id", "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("conv_id").orderBy(F.col("_slice").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    made = {n: (F.sum, c) for n, c in sums.items()} | {n: (F.bit_xor, c) for n, c in xors.items()}
    totals = sliced.groupBy("conv_id", "_slice").agg(*[f(c).alias(f"_{n}") for n, (f, c) in made.items()])
    totals = totals.select("conv_id", "_slice", *[F.coalesce(f(f"_{n}").over(earlier), F.lit(0)).alias(f"_{n}") for n, (f, _) in made.items()])
    out = sliced.withColumns({n: F.coalesce(f(c).over(inside), F.lit(0)) for n, (f, c) in made.items()})
    totals = totals.withColumnsRenamed({"conv_id": "_conv", "_slice": "_part"})
    joined = out.join(totals, F.expr("conv_id = _conv AND _slice <=> _part"))
    joined = joined.withColumns({n: F.col(n) + F.col(f"_{n}") for n in sums} | {n: F.col(n).bitwiseXOR(F.col(f"_{n}")) for n in xors})
    return joined.drop("_conv", "_part", "_slice", *[f"_{n}" for n in made])


def turn_rows(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, pos, turn_id): the turns of each conversation, numbered from 0 in order of turn, null first.

    Turns with the same number come in order of their ids. A null role or text is
    empty. Rows without a conversation id belong to no conversation and are left out.
    """
    empty = F.lit("")
    rows = turns.filter(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        _turn_id(F.coalesce(role, empty), F.coalesce(text, empty)).alias("turn_id"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("turn_id")]
    found = _before(rows, order, F.floor(F.col("turn") / F.lit(SLICE)), {"pos": F.lit(1)}, {})
    return found.select("conv_id", "pos", "turn_id")


def turn_texts(turns: DataFrame, role: str = "role", text: str = "text") -> DataFrame:
    """(turn_id, role, text) of all different turns, to read a node's last turn by."""
    said = turns.select(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    return said.select(_turn_id(F.col("role"), F.col("text")).alias("turn_id"), "role", "text").distinct()


def _mark(seed: int, *columns) -> F.Column:
    return F.xxhash64(F.lit(seed), F.col("block"), *columns)


def _blocks(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for each WIDTH turns: conv_id, block, t0.., the node before it (hi, lo), characters before it and in all,
    whether it is the conversation's last; one empty row for a conversation without turns."""
    slot = F.col("pos") % WIDTH
    cut = rows.groupBy("conv_id", F.floor(F.col("pos") / WIDTH).alias("block")).agg(
        *[F.max(F.when(slot == j, F.col("turn_id"))).alias(t) for j, t in enumerate(TURNS)]
    )
    own = sum((_chars(t) for t in TURNS), F.lit(0))
    chained = _before(
        cut,
        ["block"],
        F.floor(F.col("block") / F.lit(SLICE)),
        {"chars": own},
        {n: _mark(seed, *TURNS) for seed, n in enumerate(NODE)},
    )
    whole = rows.groupBy("conv_id").agg(
        F.sum(_chars("turn_id")).alias("total"), F.floor(F.max("pos") / WIDTH).alias("_last")
    )
    full = chained.join(whole, "conv_id").withColumn("ends", F.col("block") == F.col("_last")).drop("_last")
    none = convs.select("conv_id").join(whole, "conv_id", "left_anti").select(
        "conv_id",
        F.lit(0).cast("long").alias("block"),
        *[F.lit(None).cast("binary").alias(t) for t in TURNS],
        *[F.lit(0).cast("long").alias(n) for n in ("chars", *NODE, "total")],
        F.lit(True).alias("ends"),
    )
    return full.unionByName(none)


def _rolled(blocks: DataFrame, sums: str) -> DataFrame:
    """sums of every node's members: hi, lo, p_hi, p_lo (its parent), depth, chars (through its last turn), turn_id and sums.

    Groups in which a conversation has ended before the last column are no nodes.
    """
    names = ", ".join(TURNS)
    grouped = blocks.sparkSession.sql(
        f"""SELECT block, hi, lo, chars, {names}, {WIDTH} - bit_count(grouping_id()) AS level, {sums}
            FROM {{blocks}} GROUP BY block, hi, lo, chars, ROLLUP ({names})""",
        blocks=blocks,
    )
    last = F.get(F.array(*TURNS), (F.col("level") - 1).cast("int"))
    nodes = grouped.withColumn("turn_id", last).filter("turn_id IS NOT NULL OR (block = 0 AND level = 0)")
    upper = [F.when(F.col("level") > j + 1, F.col(t)) for j, t in enumerate(TURNS)]

    def node(name, seed, least, columns):
        return F.when(F.col("level") <= least, F.col(name)).otherwise(F.col(name).bitwiseXOR(_mark(seed, *columns)))

    ids = [node(n, seed, 0, TURNS).alias(f"n_{n}") for seed, n in enumerate(NODE)]
    parents = [node(n, seed, 1, upper).alias(f"p_{n}") for seed, n in enumerate(NODE)]
    taken = {"block", "hi", "lo", "chars", "level", "turn_id", *TURNS}
    return nodes.select(
        *ids,
        *parents,
        (F.col("block") * WIDTH + F.col("level")).alias("depth"),
        sum((_chars(t) for t in TURNS), F.col("chars")).alias("chars"),
        "turn_id",
        *[c for c in nodes.columns if c not in taken],
    ).withColumnsRenamed({f"n_{n}": n for n in NODE})


def trie(rows: DataFrame, convs: DataFrame) -> Trie:
    """The trie of conversations given as turn rows (conv_id, pos, turn_id); convs (conv_id) names them all.

    A node stands for a sequence of turns that some conversation begins with; the
    root for none. A conversation without turns is a member of the root; no
    conversations give no nodes. Node ids are 128 bits of hashes of what the node
    stands for; within a block, groups are by the turn ids themselves. saved
    sums, over the node's subtree, (n_convs - 1) times the characters of a node's
    last turn. All aggregates combine before the shuffle, so a prefix that most
    conversations share is one row of a task. Written to the shared folder.
    """
    blocks = cut_lineage(_blocks(rows, convs))
    first = "min(conv_id) AS conv_id, count(*) AS n_convs, sum(total) AS total"
    nodes = cut_lineage(_rolled(blocks, first))
    children = nodes.filter("depth > 0").groupBy("p_hi", "p_lo").agg(F.count("*").alias("n_children"))
    children = children.withColumnsRenamed({f"p_{n}": n for n in NODE})
    grown = cut_lineage(nodes.join(children, NODE, "left").fillna(0, ["n_children"]))
    unlink(nodes)
    above = F.col("chars") - _chars("turn_id")
    owners = grown.groupBy("conv_id").agg(
        F.min(above).alias("cut"), F.max(F.when(F.col("n_children") == 0, 1).otherwise(0)).cast("long").alias("leaf")
    )
    second = "sum(total - cut) AS owned, sum(leaf) AS n_leaves, min(struct(conv_id, cut)).cut AS cut"
    below = _rolled(blocks.join(owners, "conv_id"), second).select(*NODE, "owned", "n_leaves", "cut")
    parents = grown.select(*[F.col(n).alias(f"p_{n}") for n in NODE], F.col("conv_id").alias("parent_conv_id"), F.lit(1).alias("_one"))
    saved = F.col("total") - F.col("n_convs") * above - F.col("owned") - F.col("cut") + above
    up = (F.col("depth") > 0).cast("int")
    found = (
        grown.join(below, NODE)
        .withColumn("_one", up)
        .join(parents, ["p_hi", "p_lo", "_one"], "left")
        .select(*NODE, "depth", "conv_id", "parent_conv_id", "turn_id", "n_convs", "n_children", "n_leaves", saved.alias("saved"))
    )
    end = [F.when(F.col("t0").isNull(), F.col(n)).otherwise(F.col(n).bitwiseXOR(_mark(s, *TURNS))).alias(n) for s, n in enumerate(NODE)]
    return Trie(found, blocks.filter("ends").select("conv_id", *end))


def prefix_trie(turns: DataFrame, **names) -> Trie:
    """The trie of a table of turns; names as in turn_rows."""
    rows = cut_lineage(turn_rows(turns, **names))
    return trie(rows, rows.select("conv_id").distinct())


# ---- the query ---------------------------------------------------------------


def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turn rows where each conversation begins with turns of another, and all conversation ids.

    Conversation c has the first h turns of c - c % 100 (all if it has fewer, none
    if it is absent), then its own after its first h; h is crc32 of c in decimal,
    modulo 6. Remainders have the sign of c, as in SQL.
    """
    convs = rows.select("conv_id").distinct().select(
        "conv_id",
        (F.col("conv_id") - F.col("conv_id") % 100).alias("base"),
        (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).alias("h"),
    )
    turn = F.struct("pos", "turn_id")
    heads = (
        rows.filter("conv_id % 100 = 0 AND pos < 5")
        .groupBy(F.col("conv_id").alias("base"))
        .agg(F.sort_array(F.collect_list(turn)).alias("head"))
    )
    begun = convs.join(heads, "base", "left").select(
        "conv_id", "h", F.expr("slice(coalesce(head, array()), 1, cast(h AS int))").alias("head")
    )
    begun = cut_lineage(begun)
    own = rows.join(begun.select("conv_id", "h", F.size("head").alias("n")), "conv_id").filter("pos >= h")
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("n")).alias("pos"), "turn_id")
    return own.unionByName(begun.selectExpr("conv_id", "inline(head)")), begun.select("conv_id")


def _hashed(batches):
    """(hi, lo, sha256) of each node's spelled ids, which come in order; only the state of one hash is held."""
    now, state = None, None
    for batch in batches:
        done = []
        for hi, lo, text in zip(*(batch.column(c).to_pylist() for c in ("hi", "lo", "ids"))):
            if (hi, lo) != now:
                if state:
                    done.append((*now, state.hexdigest()))
                now, state = (hi, lo), hashlib.sha256(text.encode())
            else:
                state.update(b"," + text.encode())
        if done:
            yield dict(zip(("hi", "lo", "ends_sha256"), map(list, zip(*done))))
    if state:
        yield {"hi": [now[0]], "lo": [now[1]], "ends_sha256": [state.hexdigest()]}


def _ends(members: DataFrame) -> DataFrame:
    """SHA-256 of the members that end at each node, as ascending decimal ids with commas between.

    Ids are spelled in ranges of IDS numbers, in parallel; one hash then runs over
    a node's ranges, as its bytes cannot be hashed apart.
    """
    spelled = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    ranges = members.groupBy(*NODE, F.floor(F.col("conv_id") / F.lit(IDS)).alias("range")).agg(spelled.alias("ids"))
    return arrow(
        ranges.repartition(*NODE).sortWithinPartitions(*NODE, "range"), _hashed, "hi long, lo long, ends_sha256 string"
    )


def op11_prefix_trie(spark, sf_dir):
    """All prefixes of the rebuilt conversations."""
    rows = cut_lineage(turn_rows(table(spark, sf_dir, "conversations")))
    found = trie(*rebuilt(rows))
    joined = found.nodes.join(_ends(found.members), NODE, "left")
    return joined.select(
        "conv_id",
        F.col("depth").cast("long").alias("depth"),
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
