"""Tasks laid out by when they expire, so that live reads skip what has expired and expiry drops whole folders.

A task lies in the folder of its slot, its `ttl` (epoch seconds) divided by the slot's width. Those
without a ttl never expire and lie in a folder of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import delete, folders

HOUR = 3600


def slot(ttl: Column, width: int = HOUR) -> Column:
    return F.floor(ttl / width).cast("long")


def add(tasks: DataFrame, path: str, width: int = HOUR) -> None:
    """Append tasks to their slots."""
    tasks.withColumn("slot", slot(F.col("ttl"), width)).write.mode("append").partitionBy("slot").parquet(path)


def replace(tasks: DataFrame, path: str, width: int = HOUR) -> None:
    """Write the slots of these tasks anew, with these alone; others stay. tasks may have been read from there."""
    slotted = tasks.withColumn("slot", slot(F.col("ttl"), width))
    slotted.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slot").parquet(path)


def live(spark: SparkSession, path: str, schema: str, now: int, width: int = HOUR) -> DataFrame:
    """The tasks that haven't expired by now (epoch seconds): of slots before now's none is read."""
    there = spark.read.schema(f"{schema}, slot bigint").parquet(path)
    current = there.where((F.col("slot") >= now // width) | F.col("slot").isNull())
    return current.where((F.col("ttl") > now) | F.col("ttl").isNull()).drop("slot")


def expire(spark: SparkSession, path: str, now: int, width: int = HOUR) -> list[int]:
    """Delete the slots in which everything has expired by now; which these are comes from the folders' names. Running it again does no harm."""
    there = [int(name.removeprefix("slot=")) for name in folders(spark, path) if name.removeprefix("slot=").lstrip("-").isdigit()]
    gone = [k for k in sorted(there) if (k + 1) * width <= now + 1]
    for k in gone:
        delete(spark, f"{path}/slot={k}")
    return gone
