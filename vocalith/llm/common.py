"""What the operators of this subpackage share: materialised intermediates, sieves and row ids."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from typing import TypeVar
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import delete, shared_dir

T = TypeVar("T")

#: Stands for a null id where rows are ordered by id: nulls come last.
LAST = 9223372036854775807

#: Files that a small table is written to, and rows of a file of a larger one.
FEW_FILES, FILE_ROWS = 8, 200_000


def materialise(df: DataFrame, name: str, most: int | None = None, each: int = FILE_ROWS, picked: bool = False) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    most: where it is known, the rows that df has at most; a small df is written by one task for
    about `each` of them then, and not by as many as its last shuffle has.
    picked: df's last stage may read far more rows than it gives, so it keeps its tasks and only
    what it gives is dealt out anew.

    Cuts the lineage: later jobs read the files, so a lost executor costs only the tasks it
    ran, and values that depend on the row order of a scan (row ids) stay what they were.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if most is not None:
        files = max(FEW_FILES, -(-most // each))
        if files < partitions(spark):
            df = df.repartition(files) if picked else df.coalesce(files)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


#: Where the tables are that materialise has written.
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def spent(*tables: DataFrame) -> None:
    """Delete tables of materialise that nothing reads any more."""
    for table in tables:
        delete(table.sparkSession, _paths.pop(table))


class Sieve:
    """Tells keys that aren't among a given set, most of the time; it never holds back one that is.

    A bitmap of 2**BITS bits, however many keys there are, so it can be broadcast: it keeps
    rows without a partner out of a shuffle, and the join after it stays exact.
    """

    BITS = 26

    def __init__(self, rows: DataFrame, *keys: str):
        """rows: those with the keys to let through."""
        bit = F.xxhash64(*keys).bitwiseAND(F.lit((1 << self.BITS) - 1))
        words = rows.select(bit.alias("b")).groupBy(F.shiftright("b", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("bits")).toArrow()
        bitmap = np.zeros(1 << self.BITS - 6, np.int64)
        bitmap[words["at"].to_numpy()] = words["bits"].to_numpy()
        self.keys = keys
        self.sent = rows.sparkSession.sparkContext.broadcast(bitmap.view(np.uint64))

    @staticmethod
    def test(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Which of the keys' hashes (xxhash64) pass."""
        bit = hashes.view(np.uint64) & np.uint64(64 * len(bitmap) - 1)
        return (bitmap[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)

    def passes(self) -> Column:
        """Whether a row's keys pass, by columns of the names that the sieve was made with."""
        sent, test = self.sent, self.test

        @F.arrow_udf("boolean")
        def of(hashes: pa.Array) -> pa.Array:
            return pa.array(test(sent.value, hashes.to_numpy()))

        return of(F.xxhash64(*self.keys))


_held: dict = {}


def held(key: tuple, make: Callable[[], T]) -> T:
    """What a worker process keeps for later tasks of the operator that key begins with; see frugal."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


#: Bytes of an Arrow batch: texts may be long, so a number of rows bounds nothing.
BATCH_BYTES = 4 << 20


def frugal(run: Callable[[Iterator], Iterator], keeps: str | None = None) -> Callable[[Iterator], Iterator]:
    """run, for a session that sends it batches of few bytes, in a worker that other operators use as well.

    What others hold there goes before a task; keeps is the operator whose store stays. Freed
    memory goes back to the system after it.
    """
    spark, setting = SparkSession.active(), "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(setting) == "67108864b":  # the default
        spark.conf.set(setting, f"{BATCH_BYTES}b")

    def task(batches: Iterator) -> Iterator:
        for key in [k for k in _held if k[0] != keeps]:
            del _held[key]
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # another C library
            ctypes.CDLL(None).malloc_trim(0)

    return task


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """A name for each of names that no column of df has, in whatever case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ordered_id(column: Column) -> Column:
    return F.coalesce(column.cast("long"), F.lit(LAST))
