"""Trending scores that are kept instead of computed anew.

Fading by the hour is exponential, so a sum of faded weights as of one time is
the sum as of another times one factor. An item's heat is its sum as of a
stated second; heats are added after fading to a common second, and read out at
any time without the actions they came from.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestream.functions import text as X
from lodestream.functions.clock import MICROS, epoch_micros
from lodestream.operators.actions import action_weight

RATE = 0.01
SCHEMA = "item_id {kind}, at bigint, heat double"


def second_of(ts) -> F.Column:
    """The first whole second at or after a time, since 1970 on the same clock."""
    return F.ceil(epoch_micros(ts) / F.lit(MICROS)).cast("bigint")


def _faded(value: F.Column, seconds: F.Column, rate: float) -> F.Column:
    return value * F.exp(F.lit(-float(rate)) * seconds / F.lit(3600.0))


def heat(actions: DataFrame, at: int, rate: float = RATE) -> DataFrame:
    """(item_id, at, heat): action weights faded to the second at; null where no variant of an item is known.

    Ages are in whole seconds, as in recommend.trending. at may be any second; one
    near the newest action keeps numbers moderate.
    """
    own = _faded(action_weight(F.col("action_type")), F.lit(at) - second_of("ts"), rate)
    return actions.groupBy("item_id").agg(F.sum(own).alias("heat")).select("item_id", F.lit(at).cast("bigint").alias("at"), "heat")


def merged(heats: DataFrame, at: int, rate: float = RATE) -> DataFrame:
    """One heat an item as of the second at, from any number."""
    own = _faded(F.col("heat"), F.lit(at) - F.col("at"), rate)
    return heats.groupBy("item_id").agg(F.sum(own).alias("heat")).select("item_id", F.lit(at).cast("bigint").alias("at"), "heat")


def trending(heats: DataFrame, items: DataFrame, as_of: int, k: int, rate: float = RATE, category: str | None = None) -> DataFrame:
    """(rank, item_id, score, reason, category) as recommend.trending gives at the second as_of, from kept heats.

    The same for actions not after as_of. Nothing but one row an item is read.
    """
    named = merged(heats, as_of, rate).join(items.select("item_id", "category"), "item_id")
    if category is not None:
        named = named.filter(F.col("category") == category)
    order = F.round("heat", 9).desc(), F.col("item_id")
    top = named.orderBy(*order).limit(k)
    place = F.row_number().over(Window.orderBy(*order))
    return top.select(
        place.alias("rank"), "item_id", F.col("heat").alias("score"), F.lit(X.TRENDING_REASON).alias("reason"), "category"
    )
