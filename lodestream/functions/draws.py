"""Deterministic random draws and embedding initialisers.

A draw depends only on (id, position, seed): a retried or re-planned task
gives the same vector, and the same expression can be written in plain SQL.
"""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0


def words(id_col, n: int, seed) -> Column:
    """ARRAY<BIGINT> of n 32-bit draws: the four words of one md5 for every four positions."""

    def four(turn):
        text = F.concat_ws(":", id_col.cast("string"), turn.cast("string"), F.lit(str(seed)))
        # an array of one element holds the digest, so that it is computed once
        return F.get(
            F.transform(F.array(F.md5(text)), lambda d: F.array(*[F.conv(F.substring(d, 1 + 8 * k, 8), 16, 10).cast("bigint") for k in range(4)])),
            F.lit(0),
        )

    turns = F.sequence(F.lit(0), F.lit((n - 1) // 4))
    return F.slice(F.flatten(F.transform(turns, four)), 1, n)


def uniforms(id_col, n: int, seed, low=0.0, high=1.0) -> Column:
    """n draws, uniform from low to below high."""
    width = F.lit(float(high - low))
    return F.transform(words(id_col, n, seed), lambda w: F.lit(float(low)) + width * (w / F.lit(TWO_32)))


def normals(id_col, n: int, seed, mean=0.0, sigma=1.0) -> Column:
    """Box-Muller on two draws each; the half step keeps the logarithm finite."""

    def bell(r, a):
        u1 = (r + F.lit(0.5)) / F.lit(TWO_32)
        turn = F.cos(F.lit(2.0 * math.pi) * (a / F.lit(TWO_32)))
        return F.lit(float(mean)) + F.lit(float(sigma)) * (F.sqrt(F.lit(-2.0) * F.log(u1)) * turn)

    return F.zip_with(words(id_col, n, f"{seed}:r"), words(id_col, n, f"{seed}:a"), bell)


def init_vector(id_col, method: str, dim: int, seed=0, **params) -> Column:
    """ARRAY<DOUBLE> of dim initial weights for each id.

    Xavier and He share one scale, as only one fan is known: uniform within
    sqrt(6/dim), normal with sigma sqrt(2/dim). LeCun halves the variance.
    Every method is seeded per id.
    """
    id_col = F.col(id_col) if isinstance(id_col, str) else id_col

    wide, narrow = math.sqrt(6.0 / dim), math.sqrt(3.0 / dim)
    spans = {"xavier_uniform": wide, "he_uniform": wide, "lecun_uniform": narrow}
    sigmas = {"xavier_normal": 2.0, "he_normal": 2.0, "lecun_normal": 1.0}
    fills = {"zeros": 0.0, "ones": 1.0, "constant": params.get("value")}
    if method in spans:
        return uniforms(id_col, dim, seed, -spans[method], spans[method])
    if method in sigmas:
        return normals(id_col, dim, seed, 0.0, math.sqrt(sigmas[method] / dim))
    if method == "uniform":
        return uniforms(id_col, dim, seed, params["low"], params["high"])
    if method == "normal":
        return normals(id_col, dim, seed, params["mean"], params["std_dev"])
    if method in fills:
        return F.array_repeat(F.lit(float(fills[method])), dim)
    if method == "sparse":
        limit = F.lit(float(params["sparsity"]))
        dropped, kept = uniforms(id_col, dim, f"{seed}:drop"), uniforms(id_col, dim, seed, -1.0, 1.0)
        return F.zip_with(dropped, kept, lambda d, x: F.when(d < limit, F.lit(0.0)).otherwise(x))
    raise ValueError(f"unknown initialisation method {method}")
