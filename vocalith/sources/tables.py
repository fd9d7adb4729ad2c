"""Batch and stream sources with stated schemas, and the sinks that go with them."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..schemas import CHANGE, NOTIFICATION


_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where it is unset (tests, one machine) a temporary folder takes its place, which
    goes when Python ends.
    """
    if base := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        return base
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="vocalith-"))
        atexit.register(shutil.rmtree, _own_dir[0], ignore_errors=True)
    return _own_dir[0]


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of whatever file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def folders(spark: SparkSession, path: str) -> list[str]:
    """The names of a folder's folders; none where it isn't there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in system.listStatus(at) if f.isDirectory()) if system.exists(at) else []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole table: filters and columns reach the Parquet scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt out by keys over all cores, for what computes long on few bytes: a file of a few MB is one task otherwise."""
    spark = rows.sparkSession
    return rows.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def objects(spark: SparkSession, path: str, prefix: str = "audio/") -> DataFrame:
    """key and content of the objects under a prefix of a bucket's folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{path}/{prefix}")
    return files.selectExpr(f"regexp_extract(path, '({prefix}.*)$', 1) AS key", "length", "modificationTime", "content")


def upload(rows: DataFrame, folder: str, key: str = "key", content: str = "content") -> DataFrame:
    """Write each row's content as the object of its key in a bucket's folder; the rows without it, with its length. A rerun writes the same objects again.

    folder is a path or a URI of any file system that Arrow knows.
    """
    rest = [c for c in rows.columns if c != content]
    kept = rows.select(*rest, F.col(content).cast("binary").alias(content))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, data in zip(batch.column(key).to_pylist(), batch.column(content), strict=True):
                fs.create_dir(f"{base}/{name}".rpartition("/")[0], recursive=True)
                with fs.open_output_stream(f"{base}/{name}") as file:
                    file.write(data.as_buffer() if data.is_valid else b"")
            length = pc.fill_null(pc.binary_length(batch.column(content)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), length], [*rest, "length"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.select(*rest).schema)
    return kept.mapInArrow(run, f"{schema}, length bigint")


def stream(spark: SparkSession, path: str, schema: StructType | str, format: str = "json", files_per_trigger: int | None = None) -> DataFrame:
    """Files that appear in a folder, as a stream. Small batches come from few files a trigger."""
    reader = spark.readStream.schema(schema).format(format)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def change_feed(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    return stream(spark, path, CHANGE, files_per_trigger=files_per_trigger)


def notifications(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    return stream(spark, path, NOTIFICATION, files_per_trigger=files_per_trigger)


#: Rows of a file of a feed.
FEED_ROWS = 500_000


def feed(rows: DataFrame, slots: int, path: str, format: str = "parquet", each: int = FEED_ROWS) -> int:
    """Write rows to a folder in the order of their `slot` (0 to slots - 1), for what is replayed as a stream.

    Returns how many files each slot has, so that so many a trigger give a batch for each.
    """
    spark, staged = rows.sparkSession, f"{path.rstrip('/')}-staged"
    rows.write.partitionBy("slot").parquet(staged)  # rows may cost much to make, so they are made once
    rows = spark.read.schema(rows.schema).parquet(staged)
    files = max(1, rows.count() // (slots * each))
    for k in range(slots):
        rows.where(F.col("slot") == k).drop("slot").repartition(files).write.mode("append").format(format).save(path)
    delete(spark, staged)
    return files


def append(rows: DataFrame, path: str, *partition_by: str) -> None:
    """Add rows to a Parquet log."""
    rows.write.mode("append").partitionBy(*partition_by).parquet(path)


def drain(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write what a stream has now to a Parquet folder, exactly once."""
    query = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
