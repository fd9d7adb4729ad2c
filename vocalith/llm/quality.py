"""Quality classification by co-training two views, one of the text and one of the page's metadata.

Each view has a logistic regression of its own: the text view over hashed byte pairs of the
whole text, the metadata view over source, language and stated length; it never reads the
text. Both start from a part of the labelled rows. In each round each view labels all
unlabelled rows, and those it is surest of join the *other* view's training set; where both
chose a row and disagree, neither hands it over. A view that is sure of nothing hands over
nothing, and calibration takes its weight in the sum.
The labelled rows left aside then calibrate each view (Platt scaling), and the calibrated
log odds are added, the prior counting once, to score all documents.

At most `LABELLED` labelled documents, those of the least id hashes, are fitted on, and in a
round a view takes a bounded number of others from the whole corpus; only their features reach
the driver. All documents are scored by their whole text.

Defined cases: null text counts as empty, null or absent metadata as a value of its own. If
an id has several labels their mean decides, ties for good. Without labels of both kinds
nothing is rejected: every score is 1. Repeated rows get equal scores. Empty tables give
empty results. Other columns pass through `filter_documents` untouched, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, frugal, materialise, spent

LABELLED, POOL, ROUNDS, THRESHOLD = 6000, 4000, 4, 0.5
#: In a round a view hands over at most this share of the unlabelled rows (of `POOL` if there are more), and only labels of at least this probability.
SHARE, SURE = 0.1, 0.95
TEXT_DIM, META_DIM = 1042, 192
_META = ("source", "lang", "n_chars")


#: Class of each byte: space, digit, lower, upper, mark, beyond ASCII.
_CLASS = np.array([5 if i > 127 else 0 if chr(i).isspace() else 1 if chr(i).isdigit() else 2 if chr(i).islower() else 3 if chr(i).isupper() else 4 for i in range(256)])


def text_features(text: str | None) -> np.ndarray:
    """Square roots of the shares of hashed byte pairs, then shares of byte classes and of repeated words and lines; short texts say less."""
    text = text or ""
    b = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    out = np.zeros(TEXT_DIM, np.float32)
    if len(b) < 2:
        return out
    pairs = ((b[:-1] << np.uint32(8) | b[1:]) * np.uint32(2654435761)) >> np.uint32(22)
    out[:1024] = np.sqrt(np.bincount(pairs, minlength=1024) / (len(pairs) + 200))
    words, lines = text.split(), text.split("\n")
    n = len(words) + 20
    shares = [*np.bincount(_CLASS[b], minlength=6) / (len(b) + 50), sum(map(eq, words, words[1:])) / n, (len(words) - len(set(words))) / n, (len(lines) - len(set(lines))) / (len(lines) + 2)]
    out[1024:] = np.concatenate([shares, np.sqrt(shares)])
    return out


def meta_features(source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    """One of hashed sources, of hashed languages and of lengths (four classes a power of two)."""
    out = np.zeros(META_DIM, np.float32)
    out[zlib.crc32(repr(source).encode()) % 80] = 1
    out[80 + zlib.crc32(repr(lang).encode()) % 32] = 1
    out[112 + (0 if n_chars is None else min(79, 1 + int(4 * math.log2(max(1, n_chars)))))] = 1
    return out


def _features(texts: list, sources: list, langs: list, sizes: list) -> tuple[np.ndarray, np.ndarray]:
    return np.array([text_features(t) for t in texts]).reshape(-1, TEXT_DIM), np.array([meta_features(*x) for x in zip(sources, langs, sizes, strict=True)]).reshape(-1, META_DIM)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, steps: int = 250) -> np.ndarray:
    """Weights, the last being the constant, by accelerated gradient descent; the classes weigh alike. x isn't copied."""
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    rate = 4 / (np.einsum("i,ij,ij->", weight.astype(x.dtype), x, x) + 1 + penalty)
    w = v = np.zeros(x.shape[1] + 1)
    for k in range(steps):
        r = weight * (_sigmoid(_odds(v, x)) - y)
        gradient = np.append(r.astype(x.dtype) @ x + penalty * v[:-1], r.sum())
        new = v - rate * gradient
        v, w = new + k / (k + 3) * (new - w), new
    return w


def _odds(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return x @ w[:-1].astype(x.dtype) + w[-1]


def platt(odds: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and constant that calibrate log odds, by Newton's method with smoothed targets."""
    good, bad = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    x, ab = np.column_stack([odds, np.ones(len(odds))]), np.array([0.0, np.log((good + 1) / (bad + 1))])
    for _ in range(steps):
        p = _sigmoid(x @ ab)
        ab = ab - np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2), x.T @ (p - target))
    return max(0.0, float(ab[0])), float(ab[1])


def _handed(n: int) -> int:
    """How many rows of a kind a view hands over in a round, of n unlabelled ones."""
    return max(1, int(SHARE * n / 2))


def _agreed(lists: list[tuple[list, list]]) -> list[tuple[list, list]]:
    """For each view the rows that it calls bad and good, without those that the other calls the opposite."""
    (bad, good), (bad2, good2) = lists
    apart = set(bad) & set(good2) | set(good) & set(bad2)
    return [tuple([i for i in part if i not in apart] for part in view) for view in lists]


class Held:
    """Unlabelled rows in memory."""

    def __init__(self, views: tuple[np.ndarray, np.ndarray]):
        self.views, self.free = views, np.ones(len(views[0]), bool)

    def surest(self, weights: list[np.ndarray]) -> list[tuple[tuple[np.ndarray, np.ndarray], np.ndarray]]:
        """For each view the rows that it is surest of, and its labels. No row is handed over in two rounds."""
        chosen, most = [], _handed(len(self.free))
        for w, x in zip(weights, self.views, strict=True):
            p = _sigmoid(_odds(w, x))
            order = np.argsort(p, kind="stable")
            bad, good = ([i for i in part if self.free[i]][:most] for part in (order[p[order] <= 1 - SURE], order[::-1][p[order[::-1]] >= SURE]))
            chosen.append((bad, good))
        chosen = _agreed(chosen)
        for bad, good in chosen:
            self.free[[*bad, *good]] = False
        return [(tuple(x[[*bad, *good]] for x in self.views), np.concatenate([np.zeros(len(bad)), np.ones(len(good))])) for bad, good in chosen]


class Corpus:
    """All unlabelled documents, scored where they lie. Ids of labelled ones are in known."""

    def __init__(self, rows: DataFrame, known: DataFrame):
        self.rows, self.known, self.taken = rows.where("id IS NOT NULL"), known.select("id"), set()
        self.most = _handed(min(POOL, self.rows.select("id").distinct().join(self.known, "id", "left_anti").count()))

    def surest(self, weights: list[np.ndarray]) -> list[tuple[tuple[np.ndarray, np.ndarray], np.ndarray]]:
        """As Held.surest."""
        taken, sure = self.taken, float(np.log(SURE / (1 - SURE)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 1000):
                    batch = whole.slice(at, 1000)
                    odds = np.array([_odds(w, x) for w, x in zip(weights, _features(*(batch.column(c).to_pylist() for c in range(1, 5))), strict=True)], np.float64)
                    keep = pa.array((np.abs(odds) >= sure).any(axis=0) & np.array([i not in taken for i in batch.column(0).to_pylist()], bool))
                    yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, odds)], ["id", "v0", "v1"]).filter(keep)

        # rows of one id count once
        rated = self.rows.mapInArrow(frugal(run), "id long, v0 double, v1 double").groupBy("id").agg(F.min(F.struct("v0", "v1")).alias("v")).select("id", "v.*")
        rated = materialise(rated.join(self.known, "id", "left_anti"), "odds")
        lists = []
        for view in range(2):
            for y, odds in enumerate((-F.col(f"v{view}"), F.col(f"v{view}"))):
                best = rated.where(odds >= sure).orderBy(odds.desc(), F.xxhash64("id"), "id").limit(self.most)
                lists.append(best.select("id", F.lit(view).alias("view"), F.lit(y).alias("y")))
        found = [tuple(row) for row in lists[0].unionByName(lists[1]).unionByName(lists[2]).unionByName(lists[3]).collect()]
        spent(rated)
        views = _agreed([tuple([i for i, v, label in found if (v, label) == (view, y)] for y in (0, 1)) for view in (0, 1)])
        chosen = sorted((i, view, y) for view in (0, 1) for y in (0, 1) for i in views[view][y])
        ids, x = _fetch(self.rows, self.rows.sparkSession.createDataFrame(sorted({(i,) for i, *_ in chosen}), "id long"))
        place = {i: k for k, i in enumerate(ids)}
        self.taken = taken | place.keys()
        out = []
        for view in range(2):
            of = [(place[i], y) for i, v, y in chosen if v == view]
            at = np.array([k for k, _ in of], np.int64)
            out.append(((x[at, :TEXT_DIM], x[at, TEXT_DIM:]), np.array([y for _, y in of], np.float64)))
        return out


def _fetch(rows: DataFrame, ids: DataFrame) -> tuple[list[int], np.ndarray]:
    """The features of a bounded number of ids, one row each, in an order that depends on the ids alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, meta = _features(*(c.to_pylist() for c in batch.columns[1:]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in np.hstack([text, meta])], pa.binary())], ["id", "f"])

    found = rows.join(F.broadcast(ids), "id", "left_semi").dropDuplicates(["id"]).mapInArrow(frugal(run), "id long, f binary").toArrow()
    ids = found["id"].to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (zlib.crc32(str(ids[i]).encode()), ids[i]))
    x = np.empty((len(order), TEXT_DIM + META_DIM), np.float32)
    for i, at in enumerate(order):
        x[i] = np.frombuffer(found["f"][at].as_buffer(), np.float32)
    return [ids[i] for i in order], x


class Model:
    """Two calibrated views."""

    def __init__(self, labelled: tuple[np.ndarray, np.ndarray], y: np.ndarray, pool: tuple[np.ndarray, np.ndarray] | Corpus):
        seed = np.arange(len(y)) % 5 < 3
        self.ok = all(len(np.unique(y[part])) == 2 for part in (seed, ~seed))
        if not self.ok:
            return
        sets = [(x[seed], y[seed]) for x in labelled]
        pool = Held(pool) if isinstance(pool, tuple) else pool
        for _ in range(ROUNDS):
            self.weights = [logistic(*s) for s in sets]
            for to, (rows, labels) in zip((1, 0), pool.surest(self.weights), strict=True):
                x, have = sets[to]
                sets[to] = np.vstack([x, rows[to]]), np.concatenate([have, labels])
        self.weights = [logistic(*s) for s in sets]
        self.scales = [platt(_odds(w, x[~seed]), y[~seed]) for w, x in zip(self.weights, labelled, strict=True)]
        good = y.mean()
        self.prior = float(np.log(good / (1 - good)))

    def score(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The probability of good quality by the text, by the metadata and by both."""
        if not self.ok:
            return (np.ones(len(text)),) * 3
        of = [a * _odds(w, x) + b for w, x, (a, b) in zip(self.weights, (text, meta), self.scales, strict=True)]
        return _sigmoid(of[0]), _sigmoid(of[1]), _sigmoid(of[0] + of[1] - self.prior)


def _inputs(docs: DataFrame, text_col: str) -> list[Column]:
    """Text, source, language and length, whichever are there."""
    have = {c.lower() for c in docs.columns}
    return [F.col(text_col).cast("string").alias("text"), *[(F.col(c) if c in have else F.lit(None)).cast("long" if c == "n_chars" else "string").alias(c) for c in _META]]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """labels: the id and 0 or 1."""
    label = (F.avg(label_col) >= 0.5).cast("int").alias("y")
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(label)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), *_inputs(docs, text_col))
    # labels of ids that aren't there take no place in the sample
    sample = {r["id"]: r["y"] for r in known.join(rows.select("id"), "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(LABELLED).collect()}
    ids, x = _fetch(rows, docs.sparkSession.createDataFrame([(i,) for i in sorted(sample)], "id long"))
    return Model((x[:, :TEXT_DIM], x[:, TEXT_DIM:]), np.array([sample[i] for i in ids], np.int64), Corpus(rows, known))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """A row for each row of docs: doc_id, text_score, meta_score, score, kept."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                scores = sent.value.score(*_features(*(batch.column(c).to_pylist() for c in range(1, 5))))
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, scores), pa.array(scores[2] >= threshold)], ["doc_id", "text_score", "meta_score", "score", "kept"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), *_inputs(docs, text_col)).mapInArrow(frugal(run), "doc_id long, text_score double, meta_score double, score double, kept boolean")


def filter_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that aren't rejected, with the columns of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col))

    @frugal
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in batches:
            out = [sent.value.score(*_features(*(c.slice(at, 1000).to_pylist() for c in batch)))[2] >= threshold for at in range(0, len(batch[0]), 1000)]
            yield pa.array(np.concatenate(out) if out else np.zeros(0, bool))

    @F.arrow_udf("boolean")
    def keeps(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        yield from run(batches)

    return docs.where(keeps(*_inputs(docs, text_col)))


def op1_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
