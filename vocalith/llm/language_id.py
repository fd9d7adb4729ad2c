"""Language identification by words first, backing off to shorter and shorter n-grams.

A word that the model knows adds its log frequency in each language. A word that it doesn't
know is walked by character: at each place the longest known n-gram that ends there counts,
from `ORDERS[0]` characters down to one, with the word's ends marked. The language with the
largest sum wins, ties going to the first by name; the score is its share of the posterior
under equal priors.

The model is fitted on at most `SAMPLE` labelled rows, those of the least hashes of id, text
and language, whose words are counted by Spark. It knows all of their words and n-grams, however
rare; these rows bound what is broadcast. Every text is predicted whole.

Defined cases: a text that is null or has no letter gets `und` with score 0, and so do all
texts if there is nothing to learn from. A null language is never learnt from; a null id is
neither learnt from nor held out. Repeated rows count each, but are learnt from once. An empty table gives an empty
result. Only id, text and language are read, so other columns can't clash.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, frugal, materialise

SAMPLE, ORDERS = 10_000, (5, 4, 3, 2, 1)
SMOOTHING = 0.5
#: Unknown words whose sums a worker keeps; characters handled at a time.
KEPT_WORDS, SLICE_CHARS = 300_000, 3_000_000
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def grams_of(word: str) -> list[list[str]]:
    """For each place in the marked word the n-grams that end there, longest first."""
    marked = f"^{word}$"
    return [[marked[end - n : end] for n in ORDERS if n <= end] for end in range(2, len(marked) + 1)]


class Model:
    def __init__(self, languages: list[str], words: pa.Table, grams: pa.Table):
        """words, grams: key, then a column with a count for each language."""
        self.languages = languages
        # keys stay in Arrow, which is compact and quick to send; workers make of them what they need
        self.word_keys, self.gram_keys = (pa.array(t.column(0).to_pylist(), pa.string()) for t in (words, grams))
        keys = self.gram_keys.to_pylist()
        self.word_logs = self._logs(words, np.zeros(len(words), np.int64))
        gram_logs = self._logs(grams, np.fromiter(map(len, keys), np.int64, len(keys)))
        self.gram_logs = np.vstack([gram_logs, np.zeros((1, len(languages)))])  # last: not even the character is known
        # characters as numbers from 1, so that an n-gram is one integer, if there aren't too many of them
        letters = sorted(set().union(*keys))
        self.letters = np.array([ord(c) for c in letters], np.uint32)
        self.bits = max(1, len(letters).bit_length())
        self.codes = self.code_places = None
        if self.bits * ORDERS[0] < 64:
            number = {c: i + 1 for i, c in enumerate(letters)}
            codes = np.array([sum(number[c] << self.bits * j for j, c in enumerate(reversed(k))) for k in keys], np.uint64)
            self.code_places = np.argsort(codes)
            self.codes = codes[self.code_places]

    @staticmethod
    def _logs(table: pa.Table, group: np.ndarray) -> np.ndarray:
        counts = np.array([c.to_numpy() for c in table.columns[1:]], np.float64).reshape(table.num_columns - 1, len(table)).T + SMOOTHING
        for g in np.unique(group):
            counts[group == g] /= counts[group == g].sum(axis=0)
        return np.log(counts)

    @property
    def words(self) -> dict[str, int]:
        return {k: i for i, k in enumerate(self.word_keys.to_pylist())}

    @cached_property
    def grams(self) -> dict[str, int]:
        return {k: i for i, k in enumerate(self.gram_keys.to_pylist())}

    def _places(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For all places of all words the number of the longest known n-gram that ends there; how many places each word has."""
        none = len(self.gram_logs) - 1
        if self.codes is None:
            found = [[next((i for g in grams if (i := self.grams.get(g)) is not None), none) for grams in grams_of(word)] for word in words]
            return np.array([i for places in found for i in places], np.int64), np.array(list(map(len, found)))
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
        marked = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.arange(len(marked)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        number = np.minimum(np.searchsorted(self.letters, marked), max(0, len(self.letters) - 1))
        number = np.where(self.letters[number] == marked, number + 1, 0).astype(np.uint64) if len(self.letters) else np.zeros(len(marked), np.uint64)
        out, code, whole = np.full(len(marked), none), np.zeros(len(marked), np.uint64), np.ones(len(marked), bool)
        for n in range(1, ORDERS[0] + 1):
            back = np.concatenate([np.zeros(n - 1, np.uint64), number[: len(number) - n + 1]])
            code |= back << np.uint64(self.bits * (n - 1))
            # the n-gram lies in the word, and all its characters are known
            whole &= (back > 0) & (at >= n - 1)
            if n in ORDERS and len(self.codes):
                some = np.flatnonzero(whole)
                place = np.minimum(np.searchsorted(self.codes, code[some]), len(self.codes) - 1)
                hit = self.codes[place] == code[some]
                out[some[hit]] = self.code_places[place[hit]]  # a longer one takes the place of a shorter one
        return out[at > 0], sizes - 1

    def unknown(self, words: list[str]) -> np.ndarray:
        """The sums of words that aren't known. Overlapping n-grams tell the same thing, so a word counts as the mean of its places times two."""
        at, sizes = self._places(words)
        return 2 * np.add.reduceat(self.gram_logs[at], np.cumsum(sizes) - sizes) / sizes[:, None]


class Predictor:
    """A model with a bounded store of what it said of unknown words."""

    def __init__(self, model: Model):
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.rows = self.model.words
        self.logs = self.model.word_logs

    def __call__(self, texts: list[str | None]) -> Iterator[tuple[str, float]]:
        at, languages = 0, self.model.languages
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and (chars < SLICE_CHARS or end == at):
                chars += len(texts[end] or "")
                end += 1
            words = [words_of(t) if languages else [] for t in texts[at:end]]
            seen = set().union(*words)
            if len(self.rows) + len(seen) > len(self.model.word_keys) + KEPT_WORDS:
                self._clear()
            if new := [w for w in seen if w not in self.rows]:
                self.rows.update(zip(new, range(len(self.logs), len(self.logs) + len(new)), strict=True))
                self.logs = np.vstack([self.logs, self.model.unknown(new)])
            for text, w in zip(texts[at:end], words, strict=True):
                if not w or not any(map(str.isalpha, text)):
                    yield "und", 0.0
                    continue
                total = self.logs[np.fromiter(map(self.rows.__getitem__, w), np.int64, len(w))].sum(axis=0)
                best = int(total.argmax())
                yield languages[best], float(1 / np.exp(total - total[best]).sum())
            at = end


def held_out(id_: Column) -> Column:
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(rows: DataFrame) -> Model:
    """rows: doc_id, text, lang; all may be learnt from."""
    rows = rows.where("lang IS NOT NULL AND doc_id IS NOT NULL")
    rows = rows.select("doc_id", "text", "lang", F.xxhash64("doc_id", "text", "lang").alias("h"))
    least = rows.select("h").distinct().orderBy("h").limit(SAMPLE)
    sample = rows.join(F.broadcast(least), "h", "left_semi").dropDuplicates(["h"])

    def rows_of(lang: str, counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([lang] * len(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["key", "lang", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        for batch in batches:
            for text, lang in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                counts.setdefault(lang, Counter()).update(words_of(text))
        for lang, c in counts.items():
            yield rows_of(lang, c)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        for batch in batches:
            for word, lang, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                into = counts.setdefault(lang, Counter())
                for grams in grams_of(word):
                    for g in grams:
                        into[g] += n
        for lang, c in counts.items():
            yield rows_of(lang, c)

    schema = "key string, lang string, n long"
    words = materialise(sample.select("text", "lang").mapInArrow(frugal(count), schema).groupBy("key", "lang").agg(F.sum("n").alias("n")), "words")
    grams = materialise(words.mapInArrow(frugal(spell), schema).groupBy("key", "lang").agg(F.sum("n").alias("n")), "grams")
    languages = sorted(r[0] for r in words.select("lang").distinct().collect())

    def table(counts: DataFrame) -> pa.Table:
        each = [F.coalesce(F.sum(F.when(F.col("lang") == lang, F.col("n"))), F.lit(0)).alias(f"n{k}") for k, lang in enumerate(languages)]
        return counts.groupBy("key").agg(F.count("*").alias("langs"), *each).drop("langs").orderBy("key").toArrow()

    return Model(languages, table(words), table(grams))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, held_out, lang_pred, score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = Predictor(sent.value)
        for batch in batches:
            if batch.num_rows:
                langs, scores = zip(*predictor(batch.column(2).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(frugal(run), "doc_id long, held_out boolean, lang_pred string, score double")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return predict(docs, fit(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang")))
