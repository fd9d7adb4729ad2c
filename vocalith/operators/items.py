"""Articles and tasks kept as snapshots that batches of writes change in part, with an index by URL.

`catalog.current_state` reads a whole log; here a batch of writes is merged into the buckets of
its keys alone. What is kept of a key is its partial state, so writes may come in any order and
in any batches, and a deleted key keeps a row, since older updates may still come.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as T
from ..sources.buckets import Buckets
from .catalog import first_by, merge_states, partial_state, present_state

_INDEX = "url string, uuid string, createdAt timestamp, alive boolean, number bigint"


def _indexed(rows: DataFrame) -> DataFrame:
    """What is known last of each URL and item; in the same batch that the item has the URL outdoes that it had."""
    last = rows.groupBy("url", "uuid").agg(F.max_by(F.struct("createdAt", "alive", "number"), F.struct("number", "alive")).alias("_last"))
    return last.select("url", "uuid", "_last.*")


class Items:
    """Keyed state in a folder: `columns` is the DDL of an item's columns but the key, which is the string `uuid`."""

    def __init__(self, spark: SparkSession, path: str, columns: str, buckets: int = 64):
        self.spark, self.fields = spark, StructType.fromDDL(columns).fields
        kept = ", ".join(f"`{f.name}` struct<seq: bigint, value: {f.dataType.simpleString()}>" for f in self.fields)
        self.table = Buckets(spark, f"{path}/items", "uuid", merge_states, f"uuid string, _reset bigint, _op string, _update bigint, {kept}", buckets)
        self.by_url = Buckets(spark, f"{path}/by_url", "url", _indexed, _INDEX, buckets)

    def has(self, column: str) -> bool:
        return any(f.name == column for f in self.fields)

    def write(self, log: DataFrame, number: int | None = None) -> set[int]:
        """Merge a batch of writes (uuid, op, seq, some of the columns); returns the buckets that were rewritten.

        number: the batch's, which makes running it again harmless, even where it stopped between items and index.
        """
        number = (self.by_url if self.has("url") else self.table).number() + 1 if number is None else number
        columns = [(F.col(f.name) if f.name in log.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.fields]
        batch = partial_state(log.select(F.col("uuid").cast("string").alias("uuid"), "op", F.col("seq").cast("long").alias("seq"), *columns)).persist()
        touched = self.table.apply(batch, number)
        if self.has("url") and self.by_url.number() < number:
            before, after = (present_state(self.table.lookup(batch, n)) for n in (self.table.before(number), number))
            created = F.col("createdAt") if self.has("createdAt") else F.lit(None).cast("timestamp")
            of = lambda rows, alive: rows.where(T.present(F.col("url"))).select("url", "uuid", created.alias("createdAt"), F.lit(alive).alias("alive"), F.lit(number).cast("long").alias("number"))
            self.by_url.apply(of(before, False).unionByName(of(after, True)), number)
        batch.unpersist()
        return touched

    def state(self) -> DataFrame:
        """All items, as `current_state` of all writes gives them."""
        return present_state(self.table.read())

    def get(self, uuid: str | None) -> DataFrame:
        """The item of a key, from its bucket; none for a null or empty key."""
        return present_state(self.table.get(uuid)) if uuid else self.state().limit(0)

    def lookup(self, asked: DataFrame) -> DataFrame:
        """The items of the keys (uuid) that asked has, from their buckets."""
        return present_state(self.table.lookup(asked))

    def first_by_url(self, asked: DataFrame) -> DataFrame:
        """url, uuid and createdAt of the first item of each URL that asked has, from the buckets of these URLs."""
        return first_by(self.by_url.lookup(asked).where("alive").drop("alive", "number"), "url", ["createdAt", "uuid"])

    def query_by_url(self, url: str | None) -> DataFrame:
        """The first item of a URL: a bucket of the index and the buckets of the item are read."""
        if not url:
            return self.state().limit(0)
        return self.lookup(first_by(self.by_url.get(url).where("alive").drop("alive", "number"), "url", ["createdAt", "uuid"]))

    def vacuum(self) -> None:
        self.table.vacuum()
        self.by_url.vacuum()
