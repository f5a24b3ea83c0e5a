"""Mixing sources to target weights: budgets down a tree, token prefixes of seeded epochs."""

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestream.llm.common import cut_lineage, table, unlink, wide_key

LEVELS = ("domain", "lang", "source")
#: Weight per mille by level and name; None is the weight of any other name.
WEIGHTS = {
    "domain": {"web": 500, "books": 300, "forum": 200},
    "lang": {"en": 500, "de": 200, "fr": 200, "es": 100, None: 50},
    "source": {"src0": 3, None: 1},
}
MAX_EPOCHS = 4
SEED = 17
#: Documents for which one bucket of the seeded order is planned.
BUCKET_ROWS = 256

WORDS = r"[^\x20\x09-\x0D]+"


def domain_of(source) -> F.Column:
    """Domain of a source by the number its name ends in; without one it is web."""
    number = F.expr(f"try_cast(regexp_extract({source}, '([0-9]+)$', 1) AS bigint)")
    return F.when(number % 3 == 1, "books").when(number % 3 == 2, "forum").otherwise("web")


def _weight(level: str, weights: dict) -> F.Column:
    own = weights[level]
    out = F.lit(int(own.get(None, 0)))
    for name, weight in own.items():
        if name is not None:
            out = F.when(F.col(level) == name, F.lit(int(weight))).otherwise(out)
    return out


def _filled(nodes: DataFrame, parent: list[str], by: list[str]) -> DataFrame:
    """nodes with their share: the parent's budget by weight, no child above its cap.

    What a child cannot use goes to its siblings by their weights: children are
    taken by cap per weight, those that the level of the others would overfill
    get their cap, the rest the level. Floored to whole tokens.
    """
    ratio = F.when(F.col("weight") > 0, F.col("cap") / F.col("weight"))
    order = Window.partitionBy(*parent).orderBy(ratio.asc_nulls_last(), *by)
    used = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = F.when(F.col("left") > 0, (F.col("budget") - F.col("used")) / F.col("left"))
    leveled = nodes.withColumns({"used": used, "left": left}).withColumn("level", level)
    full = F.col("weight") * F.col("level") >= F.col("cap")
    first_open = F.first(F.when(~full, F.col("level")), ignorenulls=True).over(
        order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    share = F.when(F.col("weight") <= 0, F.lit(0)).when(full, F.col("cap")).otherwise(F.floor(F.col("weight") * F.col("first_open")))
    return leveled.withColumn("first_open", first_open).withColumn("budget", share.cast("long")).drop(
        "used", "left", "level", "first_open"
    )


def budgets(leaves: DataFrame, total: int, weights: dict = WEIGHTS, levels=LEVELS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(levels..., tokens, cap, budget) of every leaf of a tree whose budget is total.

    A leaf can give its tokens max_epochs times, an inner node what its children
    can. Budgets go from the root to the leaves by weight; a shortage is made up
    by siblings first, as a parent keeps its budget while its children can use
    it, and by the parent's siblings for the rest.
    """
    depths = range(1, len(levels) + 1)
    nodes = {}
    below = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    for depth in reversed(depths):
        own = list(levels[:depth])
        if depth < len(levels):
            below = below.groupBy(*own).agg(F.sum("cap").alias("cap"))
        weight = _weight(own[-1], weights)
        below = below.withColumn("weight", weight).withColumn("cap", F.when(F.col("weight") > 0, F.col("cap")).otherwise(0))
        nodes[depth] = below
    top = nodes[1].withColumns({"one": F.lit(1), "budget": F.lit(int(total)).cast("long")})
    shared = _filled(top, ["one"], [levels[0]]).drop("one")
    for depth in depths[1:]:
        parent = list(levels[: depth - 1])
        given = shared.select(*parent, "budget")
        shared = _filled(nodes[depth].join(given, parent), parent, [levels[depth - 1]])
    return shared.drop("weight")


def _order(epoch) -> F.Column:
    return F.md5(F.concat_ws("/", F.lit(str(SEED)), epoch.cast("string"), F.coalesce(F.col("mix_id").cast("string"), F.lit(""))))


def select_mix(docs: DataFrame, rate: float = 0.5, weights: dict = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(mix_key, mix_id, epoch, domain, lang, source, n_tokens): the documents of the mixture, once for each epoch.

    docs have mix_key (identity of the row), mix_id, n_tokens and the levels. The
    mixture has rate times all tokens. A leaf's budget is as many whole epochs
    as fit and the longest prefix of the next, in an order drawn from the seed,
    the epoch and the id (equal ones by size). Only the documents of the
    one bucket of the order that the prefix ends in are sorted; others are
    decided by the sums of their buckets, so no leaf is in one task. A leaf
    without weight gives no tokens. Null levels count as the empty name.
    """
    named = cut_lineage(docs.select("mix_key", "mix_id", "n_tokens", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in LEVELS]))
    leaves = cut_lineage(
        named.groupBy(*LEVELS).agg(F.sum("n_tokens").cast("long").alias("tokens"), F.count("*").alias("n_docs"))
    )
    size = leaves.agg(F.sum("n_docs"), F.sum("tokens")).first()
    digits = max(1, math.ceil(math.log((size[0] or 1) / BUCKET_ROWS + 1, 16)))
    total = math.floor((size[1] or 0) * rate)
    whole = F.floor(F.col("budget") / F.greatest(F.col("tokens"), F.lit(1))).cast("int")
    plan = (
        budgets(leaves.drop("n_docs"), total, weights, max_epochs=max_epochs)
        .withColumn("whole", F.least(whole, F.lit(max_epochs)))
        .withColumn("rest", F.col("budget") - F.col("whole") * F.col("tokens"))
    )
    plan = cut_lineage(plan.select(*LEVELS, "whole", "rest"))
    drawn = cut_lineage(
        named.join(plan, list(LEVELS))
        .withColumn("order", _order(F.col("whole")))
        .withColumn("bucket", F.substring("order", 1, digits))
    )
    part = [*LEVELS, "bucket"]
    sums = cut_lineage(drawn.groupBy(*part).agg(F.sum("n_tokens").alias("own"), F.max("rest").alias("rest")))
    before = F.coalesce(
        F.sum("own").over(Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    placed = cut_lineage(sums.withColumn("before", before).drop("rest"))
    ranked = drawn.join(placed, part)
    inside = F.col("before") + F.col("own") <= F.col("rest")
    edge = ~inside & (F.col("before") <= F.col("rest"))
    upto = F.sum("n_tokens").over(
        Window.partitionBy(*part).orderBy("order", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    )
    last = ranked.filter(edge).withColumn("upto", F.col("before") + upto).filter("upto <= rest").drop("upto")
    prefix = ranked.filter(inside).unionByName(last).filter(F.col("whole") < max_epochs).withColumn("epoch", F.col("whole"))
    epochs = drawn.filter("whole > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("whole") - 1)))
    columns = ["mix_key", "mix_id", F.col("epoch").cast("int").alias("epoch"), *LEVELS, "n_tokens"]
    for done in (leaves, sums):
        unlink(done)
    return prefix.select(*columns).unionByName(epochs.select(*columns))


def prepared(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """docs as select_mix takes them; tokens are words, a null text has none."""
    return docs.select(
        wide_key(doc_id, text, lang, source).alias("mix_key"),
        F.col(doc_id).alias("mix_id"),
        F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long").alias("n_tokens"),
        domain_of(source).alias("domain"),
        F.col(lang).alias("lang"),
        F.col(source).alias("source"),
    )


def op6_mixing(spark, sf_dir):
    """The mixture of half of all tokens of documents, sources repeated up to four times."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    chosen = select_mix(prepared(docs))
    return chosen.select(F.col("mix_id").alias("doc_id"), "epoch", *LEVELS, "n_tokens")


def _case(level: str, weights: dict) -> str:
    own = "".join(f" WHEN '{n}' THEN {w}" for n, w in weights[level].items() if n is not None)
    return f"CASE {level}{own} ELSE {weights[level].get(None, 0)} END"


def _fill_sql(name: str, nodes: str, parent: str, by: str) -> str:
    """The same water level in SQL."""
    over = f"PARTITION BY {parent} ORDER BY CASE WHEN weight > 0 THEN cap / weight END ASC NULLS LAST, {by}"
    return f"""
{name}_a AS (SELECT *, coalesce(sum(cap) OVER ({over} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS used,
  (sum(weight) OVER ({over} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS remaining FROM {nodes}),
{name}_b AS (SELECT *, CASE WHEN remaining > 0 THEN (budget - used) / remaining END AS lev FROM {name}_a),
{name}_c AS (SELECT *, first_value(CASE WHEN weight * lev < cap THEN lev END IGNORE NULLS) OVER
  ({over} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS open_lev FROM {name}_b),
{name} AS (SELECT * EXCLUDE (used, remaining, lev, open_lev, budget), CASE WHEN weight <= 0 THEN 0 WHEN weight * lev >= cap
  THEN cap ELSE floor(weight * open_lev)::BIGINT END AS budget FROM {name}_c)"""


OP6_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    coalesce(len(regexp_extract_all(text, '[^ \\x09-\\x0D]+')), 0)::BIGINT AS n_tokens,
    CASE try_cast(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT) % 3 WHEN 1 THEN 'books' WHEN 2 THEN 'forum' ELSE 'web' END AS domain
  FROM documents),
l0 AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY ALL),
l3 AS (SELECT *, {_case("source", WEIGHTS)} AS weight, CASE WHEN {_case("source", WEIGHTS)} > 0 THEN tokens * {MAX_EPOCHS} ELSE 0 END AS cap FROM l0),
l2 AS (SELECT domain, lang, {_case("lang", WEIGHTS)} AS weight, CASE WHEN {_case("lang", WEIGHTS)} > 0 THEN sum(cap)::BIGINT ELSE 0 END AS cap
  FROM l3 GROUP BY domain, lang),
l1 AS (SELECT domain, {_case("domain", WEIGHTS)} AS weight, CASE WHEN {_case("domain", WEIGHTS)} > 0 THEN sum(cap)::BIGINT ELSE 0 END AS cap
  FROM l2 GROUP BY domain),
n1 AS (SELECT l1.*, 1 AS one, floor((SELECT sum(tokens) FROM l0) * 0.5)::BIGINT AS budget FROM l1),{_fill_sql("b1", "n1", "one", "domain")},
n2 AS (SELECT l2.*, b1.budget FROM l2 JOIN b1 USING (domain)),{_fill_sql("b2", "n2", "domain", "lang")},
n3 AS (SELECT l3.*, b2.budget FROM l3 JOIN b2 USING (domain, lang)),{_fill_sql("b3", "n3", "domain, lang", "source")},
p AS (SELECT domain, lang, source, tokens, least(budget // greatest(tokens, 1), {MAX_EPOCHS})::INT AS whole, budget FROM b3),
o AS (SELECT d.*, whole, budget - whole * tokens AS rest,
    md5(concat_ws('/', '{SEED}', whole::VARCHAR, coalesce(doc_id::VARCHAR, ''))) AS ord FROM d JOIN p USING (domain, lang, source)),
c AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY ord, n_tokens
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM o)
SELECT doc_id, whole AS epoch, domain, lang, source, n_tokens FROM c WHERE upto <= rest AND whole < {MAX_EPOCHS}
UNION ALL
SELECT doc_id, e::INT AS epoch, domain, lang, source, n_tokens FROM o, range({MAX_EPOCHS}) t(e) WHERE e < whole
"""
