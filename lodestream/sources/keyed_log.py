"""A keyed table that grows by batches: a base and the changes since.

A batch writes only the rows it changed, under its own number, so repeating a
batch after a failure rewrites the same folder. The current content is the
newest row of each key. Only folders that were written to the end count.
Compacting writes a new base; what a repeat of the last batch cannot need any
more is removed.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from lodestream.operators.keyed_tables import latest


def _path(root: str) -> str:
    return f"{root.rstrip('/')}"


def _place(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    files, where = _place(spark, path)
    return files.exists(where)


def finished(spark: SparkSession, path: str, label: str) -> list[str]:
    """Values of the folders label=value under path that a write has completed."""
    files, where = _place(spark, path)
    if not files.exists(where):
        return []
    names = [f.getPath().getName() for f in files.listStatus(where)]
    own = [n for n in names if n.startswith(f"{label}=") and exists(spark, f"{path}/{n}/_SUCCESS")]
    return [n.partition("=")[2] for n in own]


def remove(spark: SparkSession, path: str) -> None:
    files, where = _place(spark, path)
    files.delete(where, True)


def append(changes: DataFrame, root: str, batch_id: int) -> None:
    changes.write.mode("overwrite").parquet(f"{_path(root)}/changes/batch={int(batch_id)}")


def _batches(spark, root, kind, before=None):
    found = sorted(int(n) for n in finished(spark, f"{_path(root)}/{kind}", "batch"))
    return [n for n in found if before is None or n < before]


def current(
    spark: SparkSession, root: str, key: str, schema: str, before: int | None = None, only: DataFrame | None = None
) -> DataFrame:
    """Newest row per key, from batches below before if given; empty when nothing was written.

    only, a frame of keys, restricts the rows before they are compared, so that
    a batch's few keys do not shuffle the whole table.
    """
    kind = StructType.fromDDL(schema)
    wide = StructType([*kind.fields]).add("batch", LongType())
    bases = _batches(spark, root, "base", before)
    at = bases[-1] if bases else -1
    folders = [("base", [at] if bases else []), ("changes", [n for n in _batches(spark, root, "changes", before) if n > at])]
    frames = [
        spark.read.schema(wide).option("basePath", f"{_path(root)}/{name}").parquet(*[f"{_path(root)}/{name}/batch={n}" for n in ns])
        for name, ns in folders
        if ns
    ]
    if not frames:
        return spark.createDataFrame([], kind)
    rows = frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1])
    if only is not None:
        rows = rows.join(only.select(key).distinct(), key, "left_semi")
    return latest(rows, key, ["batch"]).select(*kind.names)


def compact(spark: SparkSession, root: str, key: str, schema: str, upto: int) -> None:
    """Write the content after batch upto as a base, and remove what the base before it replaced."""
    bases = _batches(spark, root, "base")
    if bases and bases[-1] >= upto:
        return
    whole = current(spark, root, key, schema, before=upto + 1)
    whole.write.mode("overwrite").parquet(f"{_path(root)}/base/batch={int(upto)}")
    if bases:
        for n in _batches(spark, root, "changes"):
            if n <= bases[-1]:
                remove(spark, f"{_path(root)}/changes/batch={n}")
        for n in bases[:-1]:
            remove(spark, f"{_path(root)}/base/batch={n}")
