"""Product codes of vectors by integer k-means, screened in single precision.

Components become integers, floor(`SCALE` * x). Each of `PARTS` parts has a codebook of `ENTRIES`
entries that start as the parts of the least ids. A round assigns every part to its nearest
entry and replaces entries by their parts' means, rounded down; unused ones stay.

Nearest entries are found by screening: a matrix product in single precision gives every entry's
squared distance but for the part's own norm, with an interval that holds the exact value
whatever the order of summation was. Entries whose interval overlaps the best one's are
evaluated again in 64-bit integers, and ties go to the lower index. Where integers are too large
for that, Python's own take their place. So codes, means and errors are exact.

Spark reads the vectors once a round; each task gives sums and counts for each entry, in limbs
of 32 bits that no sum overflows, and one aggregation adds these. What reaches the driver and
goes back to the tasks is the codebooks, `ENTRIES` vectors. A rerun task gives the same sums.

Defined cases: rows whose vector is null, or holds a null or a component that isn't finite, go;
so do vectors without components, and those of another length than the kept vector of the
least id has. Where PARTS doesn't divide the length, the first parts are one longer. Of rows that
share an id the one with the lesser vector comes first; null ids come last. With fewer rows
than ENTRIES, codebooks have as many entries as there are rows. An error that no 64-bit integer
holds is given as the largest one, and so is the sum over a label. An empty table gives an empty
result. Other columns don't matter, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frugal, materialise

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
_LIMB = 32
#: Largest 64-bit integer.
_MOST = (1 << 63) - 1
#: Rows screened at a time.
_ROWS = 4096


def finite(vector: Column) -> Column:
    """Whether a vector is there, with components that all are there and finite."""
    fine = F.forall(vector, lambda x: F.coalesce((F.abs(x.cast("double")) < float("inf")) & ~F.isnan(x.cast("double")), F.lit(False)))
    return F.coalesce(fine & (F.size(vector) > 0), F.lit(False))


def floors(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x): 64-bit integers, or Python's where these are too small."""
    with np.errstate(over="ignore"):
        scaled = np.floor(values * SCALE)
    if not len(scaled) or np.abs(scaled).max() < 1 << 62:
        return scaled.astype(np.int64)
    out = np.empty(values.shape, object)
    # beyond 2**53 doubles are whole numbers
    out.flat = [int(x) * SCALE if abs(x) >= 1 << 53 else math.floor(x * SCALE) for x in values.ravel().tolist()]
    return out


def edges(length: int) -> list[int]:
    """Where the parts begin, and the last one ends."""
    each, longer = divmod(length, PARTS)
    return [k * each + min(k, longer) for k in range(PARTS + 1)]


def exact(part: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of rows and entries of the same number, exactly."""
    top = lambda x: max((abs(int(x.max())), abs(int(x.min()))), default=0) if x.size else 0
    if part.dtype == object or entries.dtype == object or part.shape[-1] * (top(part) + top(entries)) ** 2 > _MOST:
        part, entries = part.astype(object), entries.astype(object)
    apart = part - entries
    return (apart * apart).sum(axis=-1)


def nearest(part: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """The nearest entry of each row, ties to the lower index."""
    overlap = _screened(part, entries)
    row, entry = np.nonzero(overlap)
    first = np.flatnonzero(np.diff(row, prepend=-1))
    open_ = np.repeat(np.diff(first, append=len(row)) > 1, np.diff(first, append=len(row)))
    # a row with one entry left has its nearest; the others' are evaluated again
    best = entry[first]
    row, entry = row[open_], entry[open_]
    if len(row):
        distance = exact(part[row], entries[entry])
        order = np.lexsort((entry, distance, row))
        firsts = order[np.flatnonzero(np.diff(row[order], prepend=-1))]
        best[row[firsts]] = entry[firsts]
    return best


def _screened(part: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Which entries may be the nearest, by intervals around what single precision says.

    The score |c|^2 - 2 x.c differs from the squared distance by |x|^2, which is the same for all
    entries. With u = 2^-24, conversion errs by u in each factor, a product and any order of n - 1
    additions by less than n u / (1 - n u) of the sum of |x_i c_i|, which is at most |x| |c|;
    |c|^2 comes from double precision. The interval is twice what these and the last rounding give.
    """
    n = part.shape[1]
    if n == 0:
        return np.arange(len(entries))[None, :] == np.zeros((len(part), 1), np.int64)
    if part.dtype == object or entries.dtype == object:
        return np.ones((len(part), len(entries)), bool)
    x, c = part.astype(np.float64), entries.astype(np.float64)
    norms, squares = np.sqrt((x * x).sum(axis=1)), (c * c).sum(axis=1)
    if n > 1 << 20 or max(norms.max(initial=0), np.sqrt(squares.max(initial=0))) > 1e18:  # single precision might overflow
        return np.ones((len(part), len(entries)), bool)
    u = 2.0**-24
    product = part.astype(np.float32) @ entries.astype(np.float32).T
    score = squares - 2.0 * product.astype(np.float64)
    reach = 2 * (2 * (n + 4) * u / (1 - (n + 4) * u) * norms[:, None] * np.sqrt(squares) + 1e-12 * (squares + np.abs(score)) + 1e-6)
    return score - reach <= (score + reach).min(axis=1, keepdims=True)


@dataclass(frozen=True)
class Codebooks:
    """For each part its entries, rows of integers."""

    parts: list[np.ndarray]

    @classmethod
    def of(cls, vectors: np.ndarray) -> Codebooks:
        at = edges(vectors.shape[1])
        return cls([vectors[:, a:b] for a, b in zip(at, at[1:], strict=False)])

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        """A row for each vector, the nearest entry of each part."""
        at = edges(vectors.shape[1])
        return np.stack([nearest(vectors[:, a:b], c) for a, b, c in zip(at, at[1:], self.parts, strict=False)], axis=1)

    def errors(self, vectors: np.ndarray, codes: np.ndarray) -> list[int]:
        at = edges(vectors.shape[1])
        each = [exact(vectors[:, a:b], c[codes[:, k]]) for k, (a, b, c) in enumerate(zip(at, at[1:], self.parts, strict=False))]
        # each is within 64 bits or Python's own; their sum may not be
        return [min(_MOST, sum(map(int, x))) for x in zip(*each, strict=True)]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(int(x)) for part in self.parts for x in part.ravel()).encode()).hexdigest()


def _vectors(batch: pa.RecordBatch, column: int, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """Integer vectors of a batch, some rows at a time, with the first one's place."""
    for at in range(0, batch.num_rows, _ROWS):
        flat = batch.column(column).slice(at, _ROWS).flatten().to_numpy(zero_copy_only=False)
        yield at, floors(flat.astype(np.float64).reshape(-1, length))


def _sums(vectors: DataFrame, books: Codebooks, length: int) -> DataFrame:
    """part, entry, place (-1: the count), limb and value: sums of the vectors' parts by their nearest entry. vectors: vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = edges(length)
        counts = np.zeros((PARTS, ENTRIES), np.int64)
        sums = [[[0] * (b - a) for _ in range(ENTRIES)] for a, b in zip(at, at[1:], strict=False)]
        for batch in batches:
            for _, some in _vectors(batch, 0, length):
                codes = books.codes(some)
                small = some.dtype != object and some.size and max(abs(int(some.max())), abs(int(some.min()))) <= _MOST // _ROWS
                for k, (a, b) in enumerate(zip(at, at[1:], strict=False)):
                    for e in np.unique(codes[:, k]).tolist():
                        mine = some[codes[:, k] == e, a:b]
                        counts[k, e] += len(mine)
                        total = (mine if small else mine.astype(object)).sum(axis=0).tolist()
                        sums[k][e] = [x + y for x, y in zip(sums[k][e], total, strict=True)]
        rows = [(k, e, -1, 0, int(counts[k, e])) for k, e in zip(*np.nonzero(counts), strict=True)]
        for k, entries in enumerate(sums):
            for e, totals in enumerate(entries):
                for place, total in enumerate(totals):
                    sign, rest, limb = -1 if total < 0 else 1, abs(total), 0
                    while rest:
                        rows.append((k, e, place, limb, sign * (rest & (1 << _LIMB) - 1)))
                        rest, limb = rest >> _LIMB, limb + 1
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["part", "entry", "place", "limb", "value"])

    each = vectors.select("vector").mapInArrow(frugal(run), "part long, entry long, place long, limb long, value long")
    return each.groupBy("part", "entry", "place", "limb").agg(F.sum("value").alias("value"))


def _moved(books: Codebooks, sums: pa.Table) -> Codebooks:
    """Codebooks of the means, rounded down. sums: PARTS x ENTRIES x places x limbs rows at most."""
    total: dict[tuple[int, int, int], int] = {}
    for part, entry, place, limb, value in zip(*(sums[c].to_pylist() for c in ("part", "entry", "place", "limb", "value")), strict=True):
        total[part, entry, place] = total.get((part, entry, place), 0) + (value << _LIMB * limb)
    out = []
    for k, old in enumerate(books.parts):
        means = old.astype(object)
        for e in range(len(old)):
            if count := total.get((k, e, -1)):
                means[e] = [total.get((k, e, place), 0) // count for place in range(old.shape[1])]
        fits = all(abs(int(x)) < 1 << 62 for x in means.ravel())
        out.append(means.astype(np.int64) if fits else means)
    return Codebooks(out)


def kept(rows: DataFrame, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, np.ndarray | None]:
    """vec_id, label and vector of the rows that take part, and the first ENTRIES vectors by id, as integers."""
    vector = F.col(vector_col)
    fine = rows.where(finite(vector)).select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), vector.cast("array<double>").alias("vector"))
    order = [F.col("vec_id").asc_nulls_last(), F.col("vector")]
    first = fine.orderBy(*order).limit(1).toArrow()["vector"].to_pylist()
    if not first:
        return fine, None
    same = fine.where(F.size("vector") == len(first[0]))
    return same, floors(np.array(same.orderBy(*order).limit(ENTRIES).toArrow()["vector"].to_pylist(), np.float64))


def encode(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of each row that takes part."""
    spark = rows.sparkSession
    vectors, first = kept(rows, id_col, vector_col, label_col)
    if first is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    length, books = first.shape[1], Codebooks.of(first)
    for _ in range(rounds):
        books = _moved(books, _sums(vectors, books, length).toArrow())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, some in _vectors(batch, 2, length):
                codes = books.codes(some)
                text = [c.tobytes().hex() for c in codes.astype(np.uint8)]
                columns = [*(batch.column(k).slice(at, len(some)) for k in range(2)), pa.array(text), pa.array(books.errors(some, codes), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "code", "error"])

    label = vectors.schema["label"].dataType.simpleString()
    coded = materialise(vectors.mapInArrow(frugal(run), f"vec_id long, label {label}, code string, error long"), "codes")
    # decimals, so that no sum overflows; a hot label is added up before the shuffle, and the join can be split
    most = F.least(F.sum(F.col("error").cast("decimal(19,0)")), F.lit(_MOST).cast("decimal(29,0)")).cast("long")
    totals = materialise(coded.groupBy(F.col("label").alias("of")).agg(most.alias("label_error")), "totals")
    return coded.join(totals, coded["label"].eqNullSafe(totals["of"])).select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql() -> str:
    """The same in DuckDB: a pair of common tables for each round."""
    assigned = """
{a} AS MATERIALIZED (
  SELECT vec_id, part, arg_min(entry, (distance, entry)) AS entry, min(distance) AS distance FROM (
    SELECT x.vec_id, x.part, c.entry, list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS distance FROM parts x JOIN {c} c USING (part)
  ) GROUP BY ALL
)"""
    moved = """
{c} AS MATERIALIZED (
  SELECT o.part, o.entry, coalesce(m.v, o.v) AS v FROM {o} o LEFT JOIN (
    SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY place) AS v FROM (
      SELECT part, entry, place, sum(value)::BIGINT AS s, count(*) AS n FROM (SELECT a.part, a.entry, unnest(x.v) AS value, unnest(range(1, len(x.v) + 1)) AS place FROM {a} a JOIN parts x USING (vec_id, part)) GROUP BY ALL
    ) GROUP BY ALL
  ) m USING (part, entry)
)"""
    steps = []
    for k in range(ROUNDS):
        steps += [assigned.format(a=f"a{k}", c=f"c{k}"), moved.format(a=f"a{k}", o=f"c{k}", c=f"c{k + 1}")]
    steps.append(assigned.format(a="last", c=f"c{ROUNDS}"))
    return f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT vec_id, part, v[part * len(v) // {PARTS} + 1 : (part + 1) * len(v) // {PARTS}] AS v FROM kept CROSS JOIN (SELECT unnest(range({PARTS})) AS part)
), c0 AS MATERIALIZED (
  SELECT part, entry, v FROM parts JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept) USING (vec_id) WHERE entry < {ENTRIES}
), {",".join(steps)}, coded AS (
  SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(distance)::BIGINT AS error FROM last GROUP BY vec_id
), sums AS (
  SELECT label, sum(error)::BIGINT AS label_error FROM coded JOIN kept USING (vec_id) GROUP BY label
)
SELECT vec_id, code, error, label_error, (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) FROM c{ROUNDS}) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id) JOIN sums ON sums.label IS NOT DISTINCT FROM kept.label
"""


SQL = _sql()
