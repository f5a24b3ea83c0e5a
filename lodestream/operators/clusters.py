"""Centres of vectors, trained in tasks.

Points stay where they are read. A round sends the centres to the tasks, each
task assigns its points and adds them up, and one row per centre comes back; a
small sample is one task's for all rounds. The
driver holds the centres and, to begin with, CANDIDATES points for each: the
number of centres is a parameter, so neither grows with the data.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.session import cut_lineage, drop_step

ROUNDS = 6
#: Points compared with all centres at once.
BLOCK = 1024
#: Numbers in a sample that one task goes over round after round; a larger one takes a job a round.
SMALL = 1 << 22
#: Points a centre that the first centres are drawn from; all that the driver ever gets of them.
CANDIDATES = 4


def nearest(points: np.ndarray, centres: np.ndarray, n: int = 1) -> np.ndarray:
    """Numbers of the n nearest centres of each point, the nearest first, ties by number."""
    half = np.einsum("ij,ij->i", centres, centres) / 2
    out = np.empty((len(points), n), np.int64)
    for start in range(0, len(points), BLOCK):
        score = points[start : start + BLOCK] @ centres.T - half
        if n == 1:
            out[start : start + BLOCK, 0] = score.argmax(axis=1)
            continue
        if n < score.shape[1]:
            some = np.sort(np.argpartition(-score, n - 1, axis=1)[:, :n], axis=1)
        else:
            some = np.tile(np.arange(score.shape[1]), (len(score), 1))
        order = np.argsort(-np.take_along_axis(score, some, 1), axis=1, kind="stable")
        out[start : start + BLOCK] = np.take_along_axis(some, order, 1)
    return out


def matrix(column, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, rows) of an array column's vectors of this width."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    places = np.flatnonzero(np.diff(lists.offsets.to_numpy()) == width)
    own = lists if len(places) == len(lists) else lists.take(pa.array(places))
    return places, own.flatten().to_numpy(zero_copy_only=False).reshape(len(places), width).astype(np.float64)


def _partial(centres: np.ndarray, vector: str, prepare):
    """Sums and numbers of a task's points by (part, centre); centres: parts x centres x width of a part."""
    parts, n_centres, width = centres.shape

    def run(batches):
        sums, n = np.zeros((parts * n_centres, width)), np.zeros(parts * n_centres, np.int64)
        for batch in batches:
            points = prepare(matrix(batch.column(vector), parts * width)[1]).reshape(-1, parts, width)
            for part in range(parts):
                home = nearest(points[:, part], centres[part])[:, 0] + part * n_centres
                n += np.bincount(home, minlength=len(n))
                np.add.at(sums, home, points[:, part])
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(some.astype(np.int32)),
                pa.array(n[some]),
                pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * width), pa.array(sums[some].ravel())),
            ],
            schema=pa.schema([("centre", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.float64()))]),
        )

    return run


def _all_rounds(start: np.ndarray, vector: str, rounds: int, prepare):
    """The centres after all rounds over the points of one task."""
    parts, n_centres, width = start.shape

    def run(batches):
        rows = [prepare(matrix(b.column(vector), parts * width)[1]).reshape(-1, parts, width) for b in batches if b.num_rows]
        if not rows:
            return
        points, centres = np.concatenate(rows), start.copy()
        for _ in range(rounds):
            for part in range(parts):
                home = nearest(points[:, part], centres[part])[:, 0]
                n, sums = np.bincount(home, minlength=n_centres), np.zeros((n_centres, width))
                np.add.at(sums, home, points[:, part])
                centres[part][n > 0] = sums[n > 0] / n[n > 0, None]
        ends = pa.array(np.arange(parts * n_centres + 1, dtype=np.int32) * width)
        lists = pa.ListArray.from_arrays(ends, pa.array(centres.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(parts * n_centres, dtype=np.int32)), lists], names=["centre", "s"])

    return run


def lloyd(points: DataFrame, start: np.ndarray, vector: str = "unit", rounds: int = ROUNDS, prepare=np.asarray) -> np.ndarray:
    """start after rounds of assigning points to their nearest centre and moving centres to the mean of theirs.

    start is parts x centres x width: a vector of parts x width numbers is cut into
    parts, each with centres of its own. prepare is applied, in the tasks, to a
    matrix of vectors. A centre without points stays. Vectors of another size
    take no part. One row per centre and round reaches the driver.
    """
    centres = start.copy()
    parts, n_centres, width = centres.shape
    if not centres.size:
        return centres
    if points.count() * parts * width <= SMALL:
        found = points.select(vector).coalesce(1).mapInArrow(_all_rounds(centres, vector, rounds, prepare), "centre int, s array<double>")
        for r in found.collect():
            centres.reshape(parts * n_centres, width)[r.centre] = r.s
        return centres
    for _ in range(rounds):
        made = points.select(vector).mapInArrow(_partial(centres, vector, prepare), "centre int, n long, sums array<double>")
        total = made.groupBy("centre").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("s"))
        flat = centres.reshape(parts * n_centres, width)
        for r in total.collect():
            flat[r.centre] = np.array(r.s) / r.n
    return centres


def drawn(points: DataFrame, key: str, rows: int, most: int, seed: int) -> DataFrame:
    """About most of the points, by a hash of their key, written to the shared folder."""
    rate = min(1 << 30, (most << 30) // max(1, rows) + 1)
    some = points.filter(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) < rate)
    slots = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut_lineage(some.coalesce(max(1, min(slots, most // 4096 + 1))))


def spread(points: np.ndarray, n: int, seed: int) -> np.ndarray:
    """n of the points, drawn one by one with odds of their squared distance from those drawn before."""
    if len(points) <= n:
        return points
    rng = np.random.default_rng(seed)
    chosen, far = [0], np.einsum("ij,ij->i", points - points[0], points - points[0])
    while len(chosen) < n:
        total = far.cumsum()
        at = min(int(np.searchsorted(total, rng.random() * total[-1], "right")), len(points) - 1)
        chosen.append(at)
        gap = points - points[at]
        far = np.minimum(far, np.einsum("ij,ij->i", gap, gap))
    return points[chosen]


def first_of(sample: DataFrame, key: str, n: int, vector: str = "unit") -> tuple[np.ndarray, int]:
    """The n vectors of a sample that come first by a hash of their key, of its usual size, and that size."""
    sizes = sample.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes:
        return np.zeros((0, 0)), 0
    d = sizes[0].d
    rows = sample.filter(F.size(vector) == d).orderBy(F.xxhash64(key), key).limit(n).select(vector).collect()
    return np.array([r[0] for r in rows], np.float64).reshape(len(rows), d), d


def centroids(units: DataFrame, n_lists: int, rows: int, key: str = "iid", vector: str = "unit", sample: int = 256, seed: int = 7, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of n_lists lists of vectors, or fewer if there are fewer vectors.

    Trained on about sample vectors a list. The size that most of them have counts.
    """
    some = drawn(units, key, rows, n_lists * sample, seed)
    start, d = first_of(some, key, CANDIDATES * n_lists, vector)
    start = spread(start, n_lists, seed)
    out = lloyd(some, start[None], vector, rounds)[0] if d else start
    drop_step(some)
    return out
