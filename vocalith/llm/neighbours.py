"""Approximate nearest neighbours by a hash-prefix forest (LSH Forest).

All vectors are dealt into blocks of about `BLOCK`, whose arrays together are the forest:
`TREES` trees of sorted `BITS`-bit hash strings (which side of a random hyperplane, moved to
the median of a sample). Searching takes two rounds over blocks and queries:

1. A query descends every array to its longest-prefix match. Each block says how many points
   its trees hold for each length of prefix; the sums over all blocks say up to which level
   the query must ascend, in all trees of all blocks alike, for enough points.
2. Each block takes what its trees hold at that level (often nothing) and compares it exactly,
   in double precision, on the original vectors. A query keeps k rows of each block until the
   last step.

How many points are enough is measured, not guessed: on a sample of at most `BLOCK` vectors,
the least share whose answers hold `RECALL` of the true neighbours. Data with structure need
few points; of isotropic data any hashing must look at a good part. `explain` says which
share that is. All rows are indexed, whatever the sample.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take
no part, nor do rows without an id. Vectors of different lengths are never neighbours. Rows
that share an id take part each, as candidates (of each other too) and as queries, so an id
may be listed twice. Ties go to the smaller id. Fewer candidates than asked for give as many
rows. Empty tables give empty results. Only the id and the vector are read, so other columns
can't clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import frugal, materialise, spent

NEAREST, EVERY = 5, 50
BLOCK, QUERY_BLOCK, TREES, BITS, RECALL = 8192, 1024, 64, 32, 0.93
#: Queries of the sample that are measured.
MEASURED = 256


def planes(dimension: int) -> np.ndarray:
    return np.random.default_rng(dimension).standard_normal((dimension, TREES * BITS))


class Forest:
    """The sorted arrays over some vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, medians: np.ndarray):
        self.ids, self.vectors, self.medians = ids, vectors, medians
        self.norms = np.sqrt((vectors * vectors).sum(axis=1))
        self.unit = vectors / self.norms[:, None]
        keys = self.keys(self.unit)
        self.order = np.argsort(keys, axis=0, kind="stable")
        self.sorted = np.take_along_axis(keys, self.order, axis=0).T.copy()
        self.order = self.order.T.copy()

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """A hash string for each vector and tree, its first bit the highest."""
        bits = unit @ planes(unit.shape[1]) > self.medians
        packed = np.packbits(bits.reshape(len(unit), TREES, BITS), axis=2)
        return packed.view(">u4").reshape(len(unit), TREES).astype(np.uint64)

    def _range(self, keys: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query and tree the places that share the first `level` bits."""
        width = (np.uint64(1) << (BITS - level).astype(np.uint64))[:, None]
        low = keys // width * width
        lo, hi = np.empty(keys.shape, np.int64), np.empty(keys.shape, np.int64)
        for t in range(TREES):
            lo[:, t] = np.searchsorted(self.sorted[t], low[:, t])
            hi[:, t] = np.searchsorted(self.sorted[t], low[:, t] + width[:, 0])
        return lo, hi

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """For each query how many points its trees hold at each level, from no bit to all."""
        out = np.empty((len(keys), BITS + 1), np.int64)
        for level in range(BITS + 1):
            lo, hi = self._range(keys, np.full(len(keys), level))
            out[:, level] = (hi - lo).sum(axis=1)
        return out

    def held(self, keys: np.ndarray, levels: np.ndarray) -> Iterator[np.ndarray]:
        """For each query the places of the rows that its trees hold at its level."""
        lo, hi = self._range(keys, levels)
        held = np.zeros(len(self.ids), bool)
        for q in range(len(keys)):
            if not levels[q]:
                yield np.arange(len(self.ids))
                continue
            for t in np.flatnonzero(hi[q] > lo[q]):
                held[self.order[t, lo[q, t] : hi[q, t]]] = True
            yield np.flatnonzero(held)
            held[:] = False

    def nearest(self, rows: np.ndarray, query_rows: np.ndarray, queries: np.ndarray, levels: np.ndarray, k: int = NEAREST) -> Iterator[tuple[int, int, float]]:
        """query row, id, cosine: of each query the k nearest of its candidates, its own row left out."""
        norms = np.sqrt((queries * queries).sum(axis=1))
        unit = queries / norms[:, None]
        for q, at in enumerate(self.held(self.keys(unit), levels)):
            at = at[rows[at] != query_rows[q]]
            rough = self.unit[at] @ unit[q]
            if len(at) > k:
                at = at[rough >= np.partition(rough, len(at) - k)[len(at) - k] - 1e-9]
            # sums in one order for all rows, so equal vectors tie
            exact = (self.vectors[at] * queries[q]).sum(axis=1) / (self.norms[at] * norms[q])
            for i in np.lexsort((self.ids[at], -exact))[:k]:
                yield int(query_rows[q]), int(self.ids[at[i]]), float(exact[i])


def level_of(counts: np.ndarray, need: float) -> np.ndarray:
    """The longest prefix at which there are enough points; they only get fewer with each bit."""
    return (counts[:, 1:] >= need).sum(axis=1)


def measure(vectors: np.ndarray, k: int = NEAREST, recall: float = RECALL) -> tuple[np.ndarray, float, float]:
    """From a sample: the medians, the points over all trees (as a share of the rows) that reach the recall, and the share of rows they are."""
    norms = np.sqrt((vectors * vectors).sum(axis=1))
    unit = vectors / norms[:, None]
    medians = np.median(unit[:2048] @ planes(vectors.shape[1]), axis=0)
    forest, some = Forest(np.arange(len(vectors)), vectors, medians), np.arange(0, len(vectors), max(1, len(vectors) // MEASURED))
    sims = unit[some] @ unit.T
    sims[np.arange(len(some)), some] = -np.inf
    least = np.sort(sims, axis=1)[:, -min(k, len(vectors) - 1) :] if len(vectors) > 1 else sims[:, :0]
    keys = forest.keys(unit[some])
    counts, enough, share = forest.counts(keys), 0.01, 1.0
    while enough < TREES:
        found = looked = 0
        for q, at in enumerate(forest.held(keys, level_of(counts, enough * len(vectors)))):
            found += min(least.shape[1], int((sims[q, at] >= least[q, 0] - 1e-12).sum())) if least.shape[1] else 0
            looked += len(at)
        share = looked / (len(some) * len(vectors))
        if found >= recall * least.size:
            break
        enough *= 1.1
    return medians, enough, share


def usable(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, v: the rows with an id and a vector that can be compared."""
    v = F.col("v")
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where("vec_id IS NOT NULL AND v IS NOT NULL")
    return rows.where(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0))


def _flat(column: pa.Array, row: int) -> np.ndarray:
    at = column.offsets[row].as_py(), column.offsets[row + 1].as_py()
    return column.values.slice(at[0], at[1] - at[0]).to_numpy(zero_copy_only=False)


class Index:
    """The blocks of a table's vectors, and of each dimension what a sample says of it."""

    def __init__(self, table: DataFrame, k: int = NEAREST, id_col: str = "vec_id", vector_col: str = "embedding"):
        self.spark, self.k = table.sparkSession, k
        rows = usable(table, id_col, vector_col).select(F.monotonically_increasing_id().alias("row"), "vec_id", "v", F.size("v").alias("dimension"))
        self.rows = materialise(rows, "vectors")
        self.sizes = {r["dimension"]: r["n"] for r in self.rows.groupBy("dimension").agg(F.count("*").alias("n")).collect()}
        self.models = {}
        for dimension in self.sizes:
            some = self.rows.where(F.col("dimension") == dimension).select("row").orderBy(F.xxhash64("row"), "row").limit(BLOCK)
            sample = self.rows.join(F.broadcast(some), "row", "left_semi").select("v").toArrow()["v"].combine_chunks()
            self.models[dimension] = measure(sample.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension), k)
        parts = max(1, sum(-(-n // BLOCK) for n in self.sizes.values()))
        self.blocks = materialise(self._packed(self.rows, 1, ["row", "vec_id"], "").repartition(parts), "blocks")

    def explain(self) -> dict[int, float]:
        """Of each dimension the share of its rows that a query of the sample was compared with."""
        return {dimension: share for dimension, (_, _, share) in self.models.items()}

    def _of(self, value: dict[int, float]) -> Column:
        return F.create_map([F.lit(x) for pair in value.items() for x in pair])[F.col("dimension")] if value else F.lit(1)

    def _packed(self, rows: DataFrame, blocks: int, columns: list[str], prefix: str) -> DataFrame:
        """dimension, and of each so many blocks' rows the columns and the vectors in one array each."""
        parts = self._of({d: -(-n // (BLOCK * blocks)) for d, n in self.sizes.items()}).cast("long")
        some = rows.withColumn("block", F.pmod(F.xxhash64("row", F.lit(5)), parts)).groupBy("dimension", "block")
        lists = [F.collect_list(c).alias(f"{prefix}{c}") for c in columns]
        return some.agg(*lists, F.flatten(F.collect_list("v")).alias(f"{prefix}vectors")).withColumnRenamed("dimension", f"{prefix}dimension").drop("block")

    def _met(self, queries: DataFrame, answer: Callable[[Forest, dict[str, np.ndarray]], list[tuple]], names: list[str], types: list[pa.DataType], schema: str) -> DataFrame:
        """What each block answers to each block of queries."""
        sent = self.spark.sparkContext.broadcast({d: m[0] for d, m in self.models.items()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last, forest = None, None
            for batch in batches:
                for i in range(batch.num_rows):
                    d = batch.column("dimension")[i].as_py()
                    if d != batch.column("q_dimension")[i].as_py():
                        continue
                    c = {n: _flat(batch.column(n), i) for n in batch.schema.names if not n.endswith("dimension")}
                    if last is None or not np.array_equal(last, c["row"]):
                        last, forest = c["row"], Forest(c["vec_id"], c["vectors"].reshape(-1, d), sent.value[d])
                    c["q_vectors"] = c["q_vectors"].reshape(-1, d)
                    if found := answer(forest, c):
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), types, strict=True)], names)

        # stated queries against all rows, in blocks
        return self.blocks.crossJoin(queries).mapInArrow(frugal(run), schema)

    def search(self, asked: Column) -> DataFrame:
        """query_id, rank, vec_id, score: for each row that is asked for its k nearest among all others."""
        if not self.sizes:
            return self.spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        k, queries = self.k, self.rows.where(asked)
        per_block = max(1, QUERY_BLOCK * EVERY // BLOCK)

        def count(forest: Forest, c: dict[str, np.ndarray]) -> list[tuple]:
            unit = c["q_vectors"] / np.sqrt((c["q_vectors"] ** 2).sum(axis=1))[:, None]
            return list(zip(c["q_row"].tolist(), forest.counts(forest.keys(unit)).tolist(), strict=True))

        def compare(forest: Forest, c: dict[str, np.ndarray]) -> list[tuple]:
            return list(forest.nearest(c["row"], c["q_row"], c["q_vectors"], c["q_level"], k))

        first = materialise(self._packed(queries, per_block, ["row"], "q_"), "queries")
        counted = self._met(first, count, ["row", "counts"], [pa.int64(), pa.list_(pa.int64())], "row long, counts array<long>")
        sums = counted.groupBy("row").agg(*[F.sum(F.col("counts")[level]).alias(f"n{level}") for level in range(1, BITS + 1)])
        need = self._of({d: self.models[d][1] * n for d, n in self.sizes.items()})
        level = sum((F.col(f"n{level}") >= need).cast("long") for level in range(1, BITS + 1))
        levelled = queries.join(sums, "row").select("row", "dimension", "v", level.alias("level"))
        second = materialise(self._packed(levelled, per_block, ["row", "level"], "q_"), "queries")
        spent(first)
        found = self._met(second, compare, ["row", "vec_id", "score"], [pa.int64(), pa.int64(), pa.float64()], "row long, vec_id long, score double")
        best = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
        ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        return ranked.join(queries.select("row", F.col("vec_id").alias("query_id")), "row").select("query_id", "rank", "vec_id", "score")


def search(table: DataFrame, every: int = EVERY, k: int = NEAREST, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row with an id divisible by `every` its k nearest among all other rows."""
    return Index(table, k, id_col, vector_col).search(F.col("vec_id") % every == 0)


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
