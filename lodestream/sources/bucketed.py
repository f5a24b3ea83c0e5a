"""State tables for micro-batches, partitioned by bucket.

A bucket holds the rows whose key hashes to it, as root/bucket=b/batch=n: its
whole content after batch n. A batch reads the newest version before it of the
buckets that its keys touch, and writes a new version of those; other buckets
are not opened, however long the history. Repeating a batch reads the same
versions and overwrites its own. Of each touched bucket the version before is
kept for that, older ones go. Between the commits of a batch's buckets, and
after a crash among them until the batch is repeated, a reader that names no
batch may see some buckets with it and some without.
"""

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from lodestream.sources import keyed_log


class Table(NamedTuple):
    """root: folder; by: column that is hashed; keys: columns that name a row; schema: all columns, as DDL."""

    root: str
    by: str
    keys: tuple[str, ...]
    schema: str
    buckets: int = 64

    def _bucket(self):
        return F.pmod(F.xxhash64(F.col(self.by)), F.lit(self.buckets)).cast("int")

    def _versions(self, spark: SparkSession, bucket: int, before: int | None) -> list[int]:
        files, where = keyed_log._place(spark, f"{self.root}/bucket={bucket}")
        if not files.exists(where):
            return []
        names = [f.getPath().getName() for f in files.listStatus(where)]
        found = sorted(int(n.partition("=")[2]) for n in names if n.startswith("batch="))
        return [n for n in found if before is None or n < before]

    def _touched(self, keys: DataFrame | None) -> list[int]:
        """Buckets of the keys: at most as many numbers as there are buckets reach the driver."""
        if keys is None:
            return list(range(self.buckets))
        return sorted(r[0] for r in keys.select(self._bucket().alias("b")).distinct().collect())

    def _read(self, spark: SparkSession, touched: list[int], before: int | None) -> DataFrame:
        kind = StructType.fromDDL(self.schema)
        newest = {b: found[-1] for b in touched if (found := self._versions(spark, b, before))}
        if not newest:
            return spark.createDataFrame([], kind)
        wide = StructType([*kind.fields]).add("bucket", IntegerType()).add("batch", LongType())
        paths = [f"{self.root}/bucket={b}/batch={n}" for b, n in newest.items()]
        return spark.read.schema(wide).option("basePath", self.root).parquet(*paths).select(*kind.names)

    def read(self, spark: SparkSession, before: int | None = None, only: DataFrame | None = None) -> DataFrame:
        """The rows after the last batch, or after those below before; only those of the keys in only (column by), if given."""
        rows = self._read(spark, self._touched(only), before)
        return rows if only is None else rows.join(only.select(self.by).distinct(), self.by, "left_semi")

    def files(self, spark: SparkSession, before: int | None = None, only: DataFrame | None = None) -> list[str]:
        """The files that such a read opens."""
        return self._read(spark, self._touched(only), before).inputFiles()

    def write(self, changes: DataFrame, batch_id: int, prune: Callable[[DataFrame], DataFrame] | None = None) -> None:
        """Rows of changes put in place of those of the same keys; prune is applied to the new content of touched buckets."""
        spark = changes.sparkSession
        names = StructType.fromDDL(self.schema).names
        new = changes.select(*names).dropDuplicates(list(self.keys))
        touched = self._touched(changes)
        if not touched:
            return
        old = self._read(spark, touched, batch_id).join(new.select(*self.keys), list(self.keys), "left_anti")
        whole = old.unionByName(new)
        whole = (prune(whole) if prune else whole).withColumn("bucket", self._bucket()).withColumn("batch", F.lit(int(batch_id)))
        # one task a bucket: a file each
        dealt = whole.repartition(min(len(touched), self.buckets), "bucket")
        dealt.write.partitionBy("bucket", "batch").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(self.root)
        for b in touched:
            for n in self._versions(spark, b, batch_id)[:-1]:
                keyed_log.remove(spark, f"{self.root}/bucket={b}/batch={n}")

    def settle(self, spark: SparkSession, batch_id: int) -> None:
        """Nothing to compact: a bucket is one version."""


class Log(NamedTuple):
    """A keyed log behind the same methods."""

    root: str
    key: str
    schema: str

    def read(self, spark: SparkSession, before: int | None = None, only: DataFrame | None = None) -> DataFrame:
        return keyed_log.current(spark, self.root, self.key, self.schema, before=before, only=only)

    def write(self, changes: DataFrame, batch_id: int) -> None:
        keyed_log.append(changes, self.root, batch_id)

    def settle(self, spark: SparkSession, batch_id: int) -> None:
        keyed_log.compact(spark, self.root, self.key, self.schema, batch_id)


def store(root: str, key: str, schema: str, buckets: int | None):
    """A keyed log, or with a number of buckets a bucketed table, for rows named by one key."""
    return Log(root, key, schema) if buckets is None else Table(root, key, (key,), schema, buckets)
