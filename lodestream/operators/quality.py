"""Row validation: the first failing rule of a record gives its error text."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.functions import vectors as V
from lodestream.schemas import NIL_UUID

# fixed values: limits
MAX_DIM = 2048
MAX_CONTEXT_DIM = 512
MAX_NAME_BYTES = 100
MAX_RECOMMENDATIONS = 1000
MAX_EXCLUDED = 10000


def is_nil(column) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return c.isNull() | (c.cast("string") == NIL_UUID)


def first_error(rules: list[tuple[Column, str]]) -> Column:
    """Message of the first rule that fails; a rule that is null, as a null field makes it, fails."""
    out = None
    for failed, message in rules:
        out = (F if out is None else out).when(F.coalesce(failed, F.lit(True)), F.lit(message))
    return out


def _empty(vector) -> Column:
    return F.coalesce(F.size(vector) <= 0, F.lit(True))


def _broken(vector) -> Column:
    return ~V.all_finite(vector)


def _long_name(column: Column) -> Column:
    return F.octet_length(column) > MAX_NAME_BYTES


def action_error(as_of: Column) -> Column:
    """as_of stands for the current time."""
    ts = F.col("ts")
    # fixed values: messages and time limits
    return first_error(
        [
            (is_nil("user_id"), "User ID cannot be nil"),
            (is_nil("item_id"), "Item ID cannot be nil"),
            (ts > as_of + F.expr("INTERVAL 1 HOUR"), "Timestamp cannot be more than 1 hour in the future"),
            (ts < as_of - F.expr("INTERVAL 365 DAYS"), "Timestamp cannot be more than 1 year in the past"),
        ]
    )


def profile_error() -> Column:
    # fixed values: messages
    return first_error(
        [
            (is_nil("user_id"), "User ID cannot be nil"),
            (_empty("embedding"), "User embedding cannot be empty"),
            (_broken("embedding"), "User embedding contains invalid values (NaN or Infinity)"),
            (F.size("embedding") > MAX_DIM, "User embedding dimension too large (max 2048)"),
        ]
    )


def item_error() -> Column:
    popularity = F.col("popularity_score")
    # fixed values: messages
    return first_error(
        [
            (is_nil("item_id"), "Item ID cannot be nil"),
            (_empty("embedding"), "Item embedding cannot be empty"),
            (_broken("embedding"), "Item embedding contains invalid values (NaN or Infinity)"),
            (F.size("embedding") > MAX_DIM, "Item embedding dimension too large (max 2048)"),
            (F.coalesce(F.col("category"), F.lit("")) == "", "Item category cannot be empty"),
            (_long_name(F.col("category")), "Item category too long (max 100 characters)"),
            (
                ~F.isnan(popularity) & ((popularity < 0.0) | (popularity > 1.0)),
                "Item popularity score must be between 0.0 and 1.0",
            ),
        ]
    )


def request_error() -> Column:
    categories, excluded = F.col("filter_categories"), F.col("exclude_items")
    names = F.transform(categories, lambda c: F.coalesce(c, F.lit("")))
    empty_name = F.exists(names, lambda c: c == "")
    long_name = F.exists(names, lambda c: _long_name(c))
    # the first bad name decides which of the two messages is given
    first_bad = F.get(F.filter(names, lambda c: (c == "") | _long_name(c)), F.lit(0))
    # fixed values: messages
    return first_error(
        [
            (is_nil("user_id"), "User ID cannot be nil"),
            (F.col("num_recommendations") <= 0, "Number of recommendations must be greater than 0"),
            (
                F.col("num_recommendations") > MAX_RECOMMENDATIONS,
                "Number of recommendations too large (max 1000)",
            ),
            (categories.isNotNull() & (F.size(categories) == 0), "Filter categories cannot be empty if specified"),
            (categories.isNotNull() & empty_name & (first_bad == ""), "Category name cannot be empty"),
            (categories.isNotNull() & long_name, "Category name too long (max 100 characters)"),
            (excluded.isNotNull() & (F.size(excluded) > MAX_EXCLUDED), "Too many items to exclude (max 10000)"),
            (excluded.isNotNull() & F.exists(excluded, lambda i: is_nil(i)), "Excluded item ID cannot be nil"),
        ]
    )


def example_error() -> Column:
    label = F.col("label")
    # fixed values: messages
    return first_error(
        [
            (is_nil("user_id"), "User ID cannot be nil"),
            (is_nil("item_id"), "Item ID cannot be nil"),
            (~V.is_finite(label), "Training label contains invalid values (NaN or Infinity)"),
            ((label < 0.0) | (label > 1.0), "Training label must be between 0.0 and 1.0"),
            (_empty("user_features"), "User features cannot be empty"),
            (_broken("user_features"), "User features contain invalid values (NaN or Infinity)"),
            (_empty("item_features"), "Item features cannot be empty"),
            (_broken("item_features"), "Item features contain invalid values (NaN or Infinity)"),
            (_broken("context_features"), "Context features contain invalid values (NaN or Infinity)"),
            (F.size("user_features") > MAX_DIM, "User features dimension too large (max 2048)"),
            (F.size("item_features") > MAX_DIM, "Item features dimension too large (max 2048)"),
            (F.size("context_features") > MAX_CONTEXT_DIM, "Context features dimension too large (max 512)"),
        ]
    )


def feature_error() -> Column:
    # fixed values: messages
    return first_error(
        [
            (is_nil("id"), "Feature vector ID cannot be nil"),
            (_empty("vector"), "Feature vector cannot be empty"),
            (_broken("vector"), "Feature vector contains invalid values (NaN or Infinity)"),
            (F.size("vector") > MAX_DIM, "Feature vector dimension too large (max 2048)"),
        ]
    )


def model_errors(snapshot: DataFrame) -> DataFrame:
    """(version, error) of a snapshot in long form (version, side, id, vector).

    The earliest rule broken by any row of a version is its error; null when
    the version is sound. One aggregate, whatever the number of rows.
    """
    user, item, bias = (F.col("side") == s for s in ("user", "item", "bias"))
    # fixed values: messages
    rules = [
        (F.coalesce(F.col("version"), F.lit("")) == "", "Model version cannot be empty"),
        (_long_name(F.col("version")), "Model version too long (max 100 characters)"),
        (user & _empty("vector"), "User embedding weights cannot be empty"),
        (user & _broken("vector"), "User embedding weights contain invalid values"),
        (item & _empty("vector"), "Item embedding weights cannot be empty"),
        (item & _broken("vector"), "Item embedding weights contain invalid values"),
        (bias & _broken("vector"), "Bias weights contain invalid values"),
    ]
    place = None
    for n, (failed, _) in enumerate(rules):
        place = (F if place is None else place).when(failed, F.lit(n))
    worst = snapshot.groupBy("version").agg(F.min(place).alias("n"))
    text = first_error([(F.col("n").eqNullSafe(n), message) for n, (_, message) in enumerate(rules)])
    return worst.select("version", text.alias("error"))


def quarantine(rows: DataFrame, error: Column) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with their error)."""
    marked = rows.withColumn("error", error)
    return marked.filter("error IS NULL").drop("error"), marked.filter("error IS NOT NULL")


def rejects_by_rule(rows: DataFrame, error: Column) -> DataFrame:
    return rows.groupBy(F.coalesce(error, F.lit("valid")).alias("rule")).agg(F.count("*").alias("n"))
