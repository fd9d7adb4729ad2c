"""Sharding by jump consistent hashing, on DataFrame operations alone.

The published algorithm (Lamping and Veach, 2014): a linear congruential generator seeded
with the 64-bit key makes the jumps, and the shard is the last jump below the shard count.
There is no ring table, and appending a shard moves rows only into it. Spark's integers
raise on overflow, so the 64-bit product is made of 32-bit halves.

Slots number each shard's rows from 0 without gaps and without gathering a shard in one
task: rows fall into buckets inside their shard, the bucket sizes (shards x buckets numbers,
a fixed bound) give each bucket its first slot, and rows are ordered only within a bucket.
Buckets come from a row id kept in a written table, so a key with a third of all rows
spreads over all of them.

Defined cases: a null key counts as 0. A null text has no bytes (size 8, CRC 0). Rows with
equal keys share a shard and get slots of their own. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, materialise, partitions

#: Fixed value: the multiplier of the generator in the published algorithm.
MULTIPLIER = 2862933555777941757
SHARDS = 24
#: At most so many buckets in a shard; shards x buckets rows are broadcast.
MAX_BUCKETS = 4096
_LOW, _HALF = 0xFFFFFFFF, 0xFFFF


def _step(hi: Column, lo: Column) -> tuple[Column, Column]:
    """The generator's next state, key * MULTIPLIER + 1 modulo 2**64, on 32-bit halves."""
    a0, a1, b0, b1 = (F.lit(MULTIPLIER >> s & _HALF).cast("long") for s in (0, 16, 32, 48))
    p1 = lo * a1
    low = lo * a0 + F.shiftleft(p1.bitwiseAND(F.lit(_HALF)), 16) + F.lit(1)
    carry = F.shiftright(low, 32) + F.shiftright(p1, 16)
    high = carry + hi * a0 + F.shiftleft((hi * a1).bitwiseAND(F.lit(_HALF)), 16) + lo * b0 + F.shiftleft((lo * b1).bitwiseAND(F.lit(_HALF)), 16)
    return high.bitwiseAND(F.lit(_LOW)), low.bitwiseAND(F.lit(_LOW))


def jump_shards(key: Column, shards: int) -> Column:
    """A struct: shard among `shards`, and grown among one more."""
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    zero = F.lit(0).cast("long")
    start = F.struct(F.shiftrightunsigned(key, 32).alias("hi"), key.bitwiseAND(F.lit(_LOW)).alias("lo"), zero.alias("jump"), zero.alias("shard"), zero.alias("grown"))

    def jump(s: Column, _: Column) -> Column:
        hi, lo = _step(s["hi"], s["lo"])
        to = F.floor((s["jump"] + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftrightunsigned(hi, 1) + 1).cast("double"))).cast("long")
        moved = F.struct(hi.alias("hi"), lo.alias("lo"), to.alias("jump"), F.when(to < shards, to).otherwise(s["shard"]).alias("shard"), F.when(to < shards + 1, to).otherwise(s["grown"]).alias("grown"))
        return F.when(s["jump"] > shards, s).otherwise(moved)

    # each jump goes up by one at least
    return F.aggregate(F.sequence(F.lit(0), F.lit(shards + 1)), start, jump, lambda s: F.struct(s["shard"].cast("int").alias("shard"), s["grown"].cast("int").alias("grown")))


def shard(docs: DataFrame, shards: int = SHARDS, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    spark = docs.sparkSession
    buckets = min(MAX_BUCKETS, partitions(spark))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(key_col).cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        jump_shards(F.col(key_col), shards).alias("j"), F.monotonically_increasing_id().alias("row"),
    )
    rows = materialise(rows.select("doc_id", "size", "text_crc32", "j.*", F.pmod(F.xxhash64("row"), F.lit(buckets)).cast("int").alias("bucket"), "row"), "shards")
    sizes = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_slot"))
    within = Window.partitionBy("shard", "bucket").orderBy("row")
    return (
        rows.withColumn("n", F.row_number().over(within) - 1)
        .join(F.broadcast(first), ["shard", "bucket"])
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first_slot") + F.col("n")).alias("slot"), F.col("grown").alias("grown_shard"))
    )


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir))
