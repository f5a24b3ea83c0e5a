"""Optimizer steps on the rows that a batch touches, as if every row had taken every step.

A dense optimizer moves all rows at each step: one without a gradient still
fades its moments and, under Adam, goes on moving. Here a row keeps the number
of its last step, t. When a batch touches it, or the table is read out, it
catches up on the steps it missed, in one expression; so a step reads and
writes only the rows of its batch.
"""

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.functions import vectors as V
from lodestream.operators import optimizers
from lodestream.operators import training as T
from lodestream.session import cut_lineage, fresh_dir
from lodestream.sources import keyed_log

#: State columns of each optimizer, all arrays of the vector's size.
STATE = {"sgd": [], "adam": ["m", "v"], "adagrad": ["s"], "rmsprop": ["c"]}
#: Missed Adam steps whose first moment has faded below this share are left out of the sum.
FADED = 1e-20


def schema_of(key: str, kind: str, optimizer: str) -> str:
    return ", ".join([f"{key} {kind}", "vector array<double>", "t int", *[f"{s} array<double>" for s in STATE[optimizer]]])


def _filled(table: DataFrame, optimizer: str) -> DataFrame:
    """Null or missing state as zeros."""
    zero = F.transform(V.as_double("vector"), lambda x: F.lit(0.0))
    own = {s: F.coalesce(F.col(s), zero) if s in table.columns else zero for s in STATE[optimizer]}
    t = F.coalesce("t", F.lit(0)) if "t" in table.columns else F.lit(0)
    return table.withColumns({"t": t.cast("int"), **own})


def caught_up(
    table: DataFrame, optimizer: str, step: int, lr: float = 0.001, beta1: float = 0.9, beta2: float = 0.999,
    epsilon: float = 1e-8, decay: float = 0.9,
) -> DataFrame:
    """table (vector, t, state) after steps up to step, those after t without a gradient.

    Rows at or beyond step stay. SGD and AdaGrad do not move without a gradient,
    RMSprop fades its average, Adam fades both moments and moves on: its missed
    steps are summed until the first moment has faded to FADED of itself.
    """
    rows = _filled(table, optimizer)
    missed = F.greatest(F.lit(step) - F.col("t"), F.lit(0))
    if optimizer == "rmsprop":
        rows = rows.withColumn("c", V.scale("c", F.pow(F.lit(decay), missed)))
    if optimizer == "adam":
        most = math.ceil(math.log(FADED) / math.log(beta1)) if beta1 > 0 else 0
        each = F.sequence(F.lit(1), F.least(missed, F.lit(most)))

        def factors(j):
            at = F.col("t") + j
            first = F.lit(lr) * F.pow(F.lit(beta1), j) / (1.0 - F.pow(F.lit(beta1), at))
            return F.struct(first.alias("a"), (F.pow(F.lit(beta2), j) / (1.0 - F.pow(F.lit(beta2), at))).alias("b"))

        none = F.array().cast("array<struct<a:double,b:double>>")
        rows = rows.withColumn("_steps", F.when((missed > 0) & F.lit(most > 0), F.transform(each, factors)).otherwise(none))
        moved = F.transform(
            F.arrays_zip(V.as_double("vector").alias("p"), F.col("m").alias("m"), F.col("v").alias("v")),
            lambda e: e["p"] - F.aggregate("_steps", F.lit(0.0), lambda x, s: x + e["m"] * s["a"] / F.sqrt(e["v"] * s["b"] + epsilon)),
        )
        faded = {"m": V.scale("m", F.pow(F.lit(beta1), missed)), "v": V.scale("v", F.pow(F.lit(beta2), missed))}
        rows = rows.withColumns({"vector": moved, **faded}).drop("_steps")
    return rows.withColumn("t", F.greatest("t", F.lit(step)))


def step(
    totals: DataFrame, users: DataFrame, items: DataFrame, number: int, optimizer: str, reg: float = T.REGULARIZATION, **settings
) -> tuple[DataFrame, DataFrame]:
    """The rows of users and items (id, vector, t, state) that step `number` changes, after it.

    totals are pair totals of the step's examples; users and items hold at least
    their ids. Rows first catch up to the step before, then take the summed
    gradient of the batch.
    """
    before = {}
    for key, table in (("user_id", users), ("item_id", items)):
        touched = table.join(totals.select(key).distinct(), key, "left_semi")
        before[key] = cut_lineage(caught_up(touched, optimizer, number - 1, **settings))
    narrow = cut_lineage(T.residuals(totals, before["user_id"], before["item_id"]))
    known = {"adam": ("lr", "beta1", "beta2", "epsilon"), "rmsprop": ("lr", "decay", "epsilon"), "adagrad": ("lr", "epsilon"), "sgd": ("lr",)}
    own = {n: v for n, v in settings.items() if n in known[optimizer]}
    if optimizer == "sgd":
        own.setdefault("lr", T.LEARNING_RATE)
    out = []
    for key, far in (("user_id", "item_id"), ("item_id", "user_id")):
        up = T.gradient(narrow, key, before[key], far, before[far], reg).select(key, V.scale("grad", F.lit(-1.0)).alias("grad"))
        rows = before[key].join(up, key).withColumnRenamed("vector", "params")
        rows = optimizers.OPTIMIZERS[optimizer](rows, **own).withColumn("t", F.lit(number))
        out.append(rows.select(key, F.col("params").alias("vector"), "t", *STATE[optimizer]))
    return tuple(out)


def fit(
    examples: DataFrame, batch: str, steps: int, dim: int, optimizer: str, reg: float = T.REGULARIZATION, seed=0, root: str | None = None,
    **settings,
) -> tuple[DataFrame, DataFrame]:
    """(user_id, vector, t, state) and (item_id, ...) after steps 1 to steps; the examples of step n have n in column batch.

    Ids start from factors drawn by id. A step writes the rows it changed to a
    keyed log under root; all rows catch up at the end. Null ids and labels are
    left out. The result equals the dense rule that moves every row at each step.
    """
    spark = examples.sparkSession
    sound = examples.filter(F.col("user_id").isNotNull() & F.col("item_id").isNotNull() & F.col("label").isNotNull())
    root = root or fresh_dir(spark, "steps")
    schemas = {}
    for key in ("user_id", "item_id"):
        kind = examples.schema[key].dataType.simpleString()
        schemas[key] = schema_of(key, kind, optimizer)
        none = spark.createDataFrame([], f"{key} {kind}, vector array<double>")
        start = _filled(T.factors_or_init(sound, none, key, dim, seed), optimizer)
        keyed_log.append(start.select(key, "vector", "t", *STATE[optimizer]), f"{root}/{key}", 0)
    for number in range(1, steps + 1):
        totals = cut_lineage(T.pair_totals(sound.filter(F.col(batch) == number)))
        sides = [keyed_log.current(spark, f"{root}/{k}", k, s, before=number, only=totals.select(k)) for k, s in schemas.items()]
        for key, changed in zip(schemas, step(totals, *sides, number, optimizer, reg, **settings)):
            keyed_log.append(changed, f"{root}/{key}", number)
    return tuple(caught_up(keyed_log.current(spark, f"{root}/{k}", k, s), optimizer, steps, **settings) for k, s in schemas.items())
