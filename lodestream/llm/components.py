"""Connected components of links too many for one machine."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.common import arrow, cut_lineage, forest, unlink


def _local(batches):
    for batch in batches:
        a, b = forest(batch.column("a").to_numpy(), batch.column("b").to_numpy())
        yield {"a": a, "b": b}


def _star(links: DataFrame, both: bool) -> DataFrame:
    """One star step: the partners of each node are linked to its smallest partner instead.

    links hold (a, b) with a > b. The large star looks at all partners and moves
    the larger ones; the small star moves the smaller ones. Minima are combined
    before the shuffle and written, so that the join with them can be split
    where one node has many links.
    """
    turned = links.select(F.col("b").alias("a"), F.col("a").alias("b"))
    sides = links.unionByName(turned) if both else links
    least = cut_lineage(sides.groupBy("a").agg(F.min("b").alias("low")))
    if both:
        least = least.withColumn("low", F.least("a", "low"))
        moved = turned.join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        moved = (
            links.join(least, "a").filter("b != low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        ).unionByName(least.select("a", F.col("low").alias("b")))
    out = cut_lineage(moved.filter("a != b").distinct())
    unlink(least)
    return out


def _print_of(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(a, b): each node that has a link, but the smallest of its component, and that smallest node.

    links are pairs of long ids in columns a and b, in any order and number.
    Links are first thinned to a forest batch by batch, then large and small
    star steps alternate until nothing changes: a number of rounds that grows
    with the logarithm of the longest path. Each round is written to the shared
    folder and the round before it removed; two numbers a round reach the driver.
    No links give no rows.
    """
    pairs = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b")
    current = cut_lineage(arrow(pairs, _local, "a long, b long").distinct())
    mark = _print_of(current)
    while mark[0]:
        wide = _star(current, both=True)
        narrow = _star(wide, both=False)
        unlink(wide)
        unlink(current)
        current, before = narrow, mark
        mark = _print_of(current)
        if mark == before:
            break
    return current
