"""Periodic runs of words: an all-lag scan.

A run is a stretch of words that repeats with a period q at least `EXPONENT` times and that
neither neighbour extends. Words become ids, and the array of a text's n ids is compared with
itself shifted by each lag p up to n / EXPONENT; where a stretch of equal places is long enough
it is a run of period p, unless a divisor of p is a period of it too.

A stretch of the length that lag p asks for holds four neighbouring multiples of a step h, a
quarter of it. So the lags of [p, 2p) are first compared at multiples of their common h alone,
all in one vectorised comparison, and only lags with four equal ones in a row are compared in
full and run-length coded. That loses no run, and a text without any costs n log n.

Texts of up to `LONG` bytes are scanned where they lie. For a longer one lags come in ranges of
bounded work that Spark deals out over the cluster; the runs found are gathered by text, of
which there are fewer than words, and joined with it again.

Defined cases: a null or wordless text has no runs and an empty collapsed text. A null id counts
as no id: the text stays as it is where the contract's rule repeats words by the id's CRC-32.
Each row gives one row, repeated ones too; other columns don't matter, whatever their names.
Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, frugal, materialise, partitions

EXPONENT, LEAST = 4, 6
#: Bytes of a text whose lags are scanned in one go.
LONG = 1 << 18
#: Comparisons, at most, of a range of lags of a longer text.
WORK = 1 << 31
#: Cells of a comparison of many lags.
_CELLS = 1 << 20

#: Given a text's words and its id, the words to look at.
Change = Callable[[list[bytes], int | None], list[bytes]]


def unchanged(words: list[bytes], doc_id: int | None) -> list[bytes]:
    return words


def repeated_by_id(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The contract's planted repetition: of one id in ten, by its CRC-32, words from one on repeat those before."""
    n, h = len(words), 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    block = words[a : a + p]
    return words[:a] + (block * (-(-(n - a) // p)))[: n - a]


def _ids(words: list[bytes]) -> np.ndarray:
    index = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(index.__getitem__, words), np.int32, len(words))


def _primes(n: int) -> list[int]:
    """The primes that divide n."""
    out, p = [], 2
    while p * p <= n:
        if n % p == 0:
            out.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return [*out, n] if n > 1 else out


def _needed(lag: int) -> int:
    """Equal places in a row that make a run of this period."""
    return max(LEAST, EXPONENT * lag) - lag


def _likely(ids: np.ndarray, low: int, high: int) -> Iterator[int]:
    """The lags of [low, high) that have four equal places in a row among multiples of a step; all lags with a run are among them."""
    n, width = len(ids), ids.itemsize
    # beyond the text nothing is equal
    padded = np.concatenate((ids, np.full(high, -1, ids.dtype)))
    while low < high:
        step = max(1, min(_needed(low), _needed(min(high, 2 * low) - 1)) // 4)
        at = ids[: n - low : step]
        top = min(high, 2 * low, low + max(1, _CELLS // len(at)))
        # a row for each multiple of the step, a column for each lag
        shifted = np.ndarray((len(at), top - low), ids.dtype, padded, low * width, (step * width, width))
        equal = shifted == at[:, None]
        if len(at) >= 4:
            found = (equal[:-3] & equal[1:-2] & equal[2:-1] & equal[3:]).any(axis=0)
            yield from (low + np.flatnonzero(found)).tolist()
        low = top


def scan(ids: np.ndarray, low: int = 1, high: int | None = None) -> list[tuple[int, int, int]]:
    """start, length and period of the runs with a period of [low, high), by default of all runs."""
    n, out = len(ids), []
    high = min(n // EXPONENT + 1, high or n)
    for lag in _likely(ids, low, high):
        needed = _needed(lag)
        equal = ids[lag:] == ids[:-lag]
        turns = np.flatnonzero(np.diff(np.concatenate(([0], equal.view(np.int8), [0]))))
        stretches = turns.reshape(-1, 2)
        for start, end in stretches[stretches[:, 1] - stretches[:, 0] >= needed].tolist():
            if not any(_has_period(ids, start, end + lag, lag // r) for r in _primes(lag)):
                out.append((start, end - start + lag, lag))
    return out


def _has_period(ids: np.ndarray, start: int, end: int, period: int) -> bool:
    return np.array_equal(ids[start : end - period], ids[start + period : end])


def summary(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    """n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256."""
    runs = sorted(runs, key=lambda r: (r[0], r[2]))
    listed = hashlib.sha256("".join(f"{s},{length},{p}\n" for s, length, p in runs).encode()).hexdigest()
    if not runs:
        return 0, None, None, None, None, listed, hashlib.sha256(b" ".join(words)).hexdigest()
    start, length, period = min(runs, key=lambda r: (-r[1], r[0], r[2]))
    covered = np.zeros(len(words) + 1, np.int64)
    for s, size, p in runs:
        covered[s + p] += 1
        covered[s + size] -= 1
    left = b" ".join([words[i] for i in np.flatnonzero(np.cumsum(covered[:-1]) == 0).tolist()])
    return len(runs), start, length, period, 1000 * length // period, listed, hashlib.sha256(left).hexdigest()


_RESULT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
_NAMES = [field.split()[0] for field in _RESULT.split(", ")]
_KINDS = [pa.string() if field.endswith("string") else pa.int64() for field in _RESULT.split(", ")]


def _words(text: pa.Scalar) -> list[bytes]:
    return text.as_buffer().to_pybytes().split() if text.is_valid else []  # of bytes: ASCII white space only


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, _KINDS, strict=True)], _NAMES)


def _whole(docs: DataFrame, change: Change) -> DataFrame:
    """Results of texts (doc_id, text) that one task scans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                words = change(_words(text), doc_id)
                rows.append((doc_id, *summary(words, scan(_ids(words)))))
            yield _batch(rows)

    return docs.mapInArrow(frugal(run), _RESULT)


def _in_ranges(docs: DataFrame, change: Change) -> DataFrame:
    """Results of texts (row, doc_id, text) whose lags are scanned by several tasks. docs is written already."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, doc_id, text, low, high in zip(*(batch.column(k) for k in range(5)), strict=True):
                ids = _ids(change(_words(text.cast(pa.binary())), doc_id.as_py()))
                found = scan(ids, low.as_py(), high.as_py())
                columns = list(zip(*((row.as_py(), *r) for r in found), strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["row", "start", "length", "period"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text, runs in zip(*(batch.column(k) for k in range(3)), strict=True):
                words = change(_words(text.cast(pa.binary())), doc_id.as_py())
                yield _batch([(doc_id.as_py(), *summary(words, [tuple(r.values()) for r in runs.as_py() or []]))])

    # a text has half as many words as bytes at most
    most = F.octet_length("text") / 2 + 1
    each = F.greatest(F.lit(1), F.floor(F.lit(WORK) / most))
    begins = docs.withColumns({"each": each, "low": F.explode(F.sequence(F.lit(1).cast("long"), F.floor(most / EXPONENT) + 1, each))})
    spread = begins.repartition(partitions(docs.sparkSession), "row", "low")
    found = spread.select("row", "doc_id", "text", "low", (F.col("low") + F.col("each")).alias("high")).mapInArrow(frugal(search), "row long, start long, length long, period long")
    runs = found.groupBy("row").agg(F.collect_list(F.struct("start", "length", "period")).alias("runs"))
    return docs.join(runs, "row", "left").select("doc_id", "text", "runs").mapInArrow(frugal(finish), _RESULT)


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", change: Change = unchanged) -> DataFrame:
    """For each row of docs doc_id, n_runs, the longest run's start, length, period and exponent_milli, and the hashes of all runs and of the text without repeated words."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    long_ = F.coalesce(F.octet_length("text") > LONG, F.lit(False))
    longer = materialise(rows.where(long_).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "long")
    done = _whole(rows.where(~long_), change)
    return done if longer.isEmpty() else done.unionByName(_in_ranges(longer, change))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(documents(spark, sf_dir), change=repeated_by_id)
