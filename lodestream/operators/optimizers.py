"""Optimizer steps over a table (key, params, grad, state...): one row per parameter vector.

A key has one gradient, the sum over its examples as training.gradient gives it.
Starting state is zero, and dropping the state columns resets an optimizer.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.functions import vectors as V


def _state(table: DataFrame, name: str) -> Column:
    zero = F.transform(V.as_double("params"), lambda x: F.lit(0.0))
    return F.coalesce(F.col(name), zero) if name in table.columns else zero


def _mean(old, grad, decay: float, power: int) -> Column:
    """Exponential moving average of the gradient or its square."""
    rest = 1.0 - decay
    return F.zip_with(old, grad, lambda s, g: s * decay + (g if power == 1 else g * g) * rest)


def _less(params, step) -> Column:
    return F.zip_with(V.as_double(params), step, lambda p, d: p - d)


def _rescaled(grad, squares, rate: float, epsilon: float) -> Column:
    return F.zip_with(grad, squares, lambda g, s: g * rate / F.sqrt(s + epsilon))


def sgd(table: DataFrame, lr: float) -> DataFrame:
    return table.withColumn("params", _less("params", V.scale("grad", F.lit(lr))))


def adam(
    table: DataFrame, lr: float = 0.001, beta1: float = 0.9, beta2: float = 0.999, epsilon: float = 1e-8
) -> DataFrame:
    """State m, v, t. epsilon is inside the square root; t counts the key's own updates."""
    t = (F.col("t") if "t" in table.columns else F.lit(0)) + 1
    stepped = (
        table.withColumn("t", t)
        .withColumn("m", _mean(_state(table, "m"), V.as_double("grad"), beta1, 1))
        .withColumn("v", _mean(_state(table, "v"), V.as_double("grad"), beta2, 2))
    )
    m_hat = V.scale("m", 1.0 / (1.0 - F.pow(F.lit(beta1), F.col("t"))))
    v_hat = V.scale("v", 1.0 / (1.0 - F.pow(F.lit(beta2), F.col("t"))))
    return stepped.withColumn("params", _less("params", _rescaled(m_hat, v_hat, lr, epsilon)))


def adagrad(table: DataFrame, lr: float = 0.01, epsilon: float = 1e-8) -> DataFrame:
    """State s: sum of squared gradients."""
    grown = F.zip_with(_state(table, "s"), V.as_double("grad"), lambda s, g: s + g * g)
    return table.withColumn("s", grown).withColumn(
        "params", _less("params", _rescaled(V.as_double("grad"), F.col("s"), lr, epsilon))
    )


def rmsprop(table: DataFrame, lr: float = 0.001, decay: float = 0.9, epsilon: float = 1e-8) -> DataFrame:
    """State c: moving average of squared gradients."""
    return table.withColumn("c", _mean(_state(table, "c"), V.as_double("grad"), decay, 2)).withColumn(
        "params", _less("params", _rescaled(V.as_double("grad"), F.col("c"), lr, epsilon))
    )


OPTIMIZERS = {"sgd": sgd, "adam": adam, "adagrad": adagrad, "rmsprop": rmsprop}
