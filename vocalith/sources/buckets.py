"""A table kept by key in buckets: batches rewrite the buckets they touch, lookups read the buckets they ask for.

The rows of a bucket lie in a folder of their own, `rows/version=n/bucket=k`, where n is the batch
that wrote it last. A batch merges its rows with those of the buckets that it touches and writes
these alone; then it writes which version each bucket has, which is what makes it count. So a
batch that fails half way changes nothing, one that runs again is written once, and who reads
meanwhile has the state before. Folders of versions that no bucket has any more go with `vacuum`.

The merge has to be one that gives the same in any order and split (an aggregation by key that
can take its own results), and no more is asked of it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import delete, exists, folders

#: Given rows of some keys, possibly several of one, a row for each key.
Merge = Callable[[DataFrame], DataFrame]


class Buckets:
    def __init__(self, spark: SparkSession, path: str, key: str, merge: Merge, schema: str, buckets: int = 64):
        """schema: DDL of merged rows. buckets: for so many that one fits a task; it stays as it is once rows are written."""
        self.spark, self.path, self.key, self.merge, self.schema, self.count = spark, path, key, merge, schema, buckets

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key.cast("string")), F.lit(self.count)).cast("int")

    def number(self) -> int:
        """The last batch that counts; -1 if none does."""
        return max((int(n) for n in folders(self.spark, f"{self.path}/batches") if exists(self.spark, f"{self.path}/batches/{n}/_SUCCESS")), default=-1)

    def before(self, number: int) -> int:
        """The batch before one, which needn't have the number before."""
        return max((int(n) for n in folders(self.spark, f"{self.path}/batches") if int(n) < number), default=-1)

    def versions(self, number: int | None = None) -> dict[int, int]:
        """Of each bucket that has rows its version after a batch, by default the last: a row a bucket at most."""
        n = self.number() if number is None else number
        return {r["bucket"]: r["version"] for r in self.spark.read.schema("bucket int, version int").parquet(f"{self.path}/batches/{n}").collect()} if n >= 0 else {}

    def read(self, buckets: Iterable[int] | None = None, number: int | None = None) -> DataFrame:
        """The rows of some buckets, by default of all, after a batch, by default the last: no other folder is listed or read."""
        versions = self.versions(number)
        wanted = versions if buckets is None else {b: versions[b] for b in sorted(set(buckets)) if b in versions}
        paths = [f"{self.path}/rows/version={v}/bucket={b}" for b, v in wanted.items()]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def apply(self, rows: DataFrame, number: int | None = None) -> set[int]:
        """Merge a batch's rows into the table; returns the buckets it touched. number: the batch's; one that counts already does nothing."""
        last = self.number()
        number = last + 1 if number is None else number
        if number <= last:
            return set()
        versions = self.versions()
        merged = self.merge(rows).where(F.col(self.key).isNotNull()).withColumn("bucket", self.bucket(F.col(self.key))).persist()
        touched = {r["bucket"] for r in merged.select("bucket").distinct().collect()}
        both = self.merge(self.read(touched).unionByName(merged.drop("bucket"))).withColumn("bucket", self.bucket(F.col(self.key)))
        # a task writes whole buckets, so each is one file; what a batch that was cut short left behind has the same number
        both.repartition(max(1, len(touched)), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/rows/version={number}")
        merged.unpersist()
        versions |= dict.fromkeys(touched, number)
        counts = self.spark.createDataFrame(sorted(versions.items()), "bucket int, version int").coalesce(1)
        counts.write.mode("overwrite").parquet(f"{self.path}/batches/{number}")
        return touched

    def lookup(self, asked: DataFrame, number: int | None = None) -> DataFrame:
        """The rows of the keys that asked has: only their buckets are read, and of what is asked only bucket numbers reach the driver."""
        keys = asked.select(self.key).where(F.col(self.key).isNotNull()).distinct()
        wanted = [r["bucket"] for r in keys.select(self.bucket(F.col(self.key)).alias("bucket")).distinct().collect()]
        return self.read(wanted, number).join(keys, self.key, "left_semi")

    def get(self, key: str) -> DataFrame:
        """The rows of one key: one bucket is read, and the filter reaches the scan."""
        bucket = self.spark.range(1).select(self.bucket(F.lit(key))).first()[0]
        return self.read([bucket]).where(F.col(self.key) == F.lit(key))

    def vacuum(self) -> None:
        """Delete what no bucket has any more, once nobody reads it."""
        last, versions = self.number(), self.versions()
        for name in folders(self.spark, f"{self.path}/batches"):
            if int(name) < last:
                delete(self.spark, f"{self.path}/batches/{name}")
        for name in folders(self.spark, f"{self.path}/rows"):
            version = int(name.removeprefix("version="))
            for bucket in folders(self.spark, f"{self.path}/rows/{name}"):
                if bucket.startswith("bucket=") and versions.get(int(bucket.removeprefix("bucket="))) != version and version <= last:
                    delete(self.spark, f"{self.path}/rows/{name}/{bucket}")
            if version not in versions.values() and version <= last:
                delete(self.spark, f"{self.path}/rows/{name}")
