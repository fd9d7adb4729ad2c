"""Best-fit packing after Martello-Toth dominance reduction.

Documents become token ids; those of over the capacity are cut. What matters to packing is
how many pieces there are of each length, at most `CAPACITY` numbers whatever the corpus, so
the packing is solved once, on the driver, over that histogram:

1. Reduction: for the longest remaining piece, if a set of at most three pieces dominates
   every other way to fill its sequence (Martello and Toth's criterion), that set is fixed
   for good, for as many pieces as the counts allow at once, and the instance shrinks.
2. Best fit decreasing packs the rest, all pieces of a length at a time; open sequences with
   the same room and contents form runs, so the plan has a few thousand rows at most.

The pieces of a length are numbered without gathering them: each task numbers its own from
0, and the sizes of the tasks' shares give each share its first number. A piece then finds
its place by its length and number in the broadcast plan.

Defined cases: a null text counts as empty, so it is the closing id alone. Names of special
tokens in a text are these tokens, as the library has it unless told otherwise. Repeated rows are
packed each. Null ids pass through. An empty table gives an empty result. Only the id and
the text are read, so other columns can't clash.
"""

from __future__ import annotations

import os
import zlib
from array import array
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, frugal, held, materialise

CAPACITY = 2048
#: Bytes of chunks that a worker keeps, in each of two generations, and words of marks alone.
KEPT_BYTES, KEPT_MARKS = 48_000_000, 10_000
#: Python takes these for white space and Unicode doesn't.
_CONTROL = "\x1c\x1d\x1e\x1f"


#: Marks that form one word of their own after letters, whichever follow each other (no apostrophe: it can open an ending).
_MARKS = ".,!?;:$%&*#|()-\""
#: Letters below this are composed already and have one lower-case form, but for the capital I with a dot.
_PLAIN = "\u0180"


class Tokens(dict):
    """Texts to ids, and the ids of each chunk as little-endian 32-bit integers. White space ends every word of this tokenizer, so the ids of a text are those of its chunks.

    A chunk of plain letters, with marks after it or not, is one or two words for the tokenizer,
    so its model gets them straight; all other chunks go through the whole tokenizer, which
    takes the names of its special tokens for these wherever they stand. Chunks are kept in two
    generations of bounded bytes: the older one goes, but for what was asked for again.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        bytewise = ByteLevel(add_prefix_space=False, use_regex=False)
        # a byte's character in the vocabulary: one of two that code a letter, or its own
        self.letters: dict[int, str] = {}
        for c in map(chr, range(1, 0x180)):
            if len(shown := "".join(x for x, _ in bytewise.pre_tokenize_str(c))) == len(coded := c.encode()):
                self.letters |= dict(zip(coded, shown, strict=True))
        self.marks: dict[str, list[int]] = {}
        self.older: dict[str, bytes] = {}
        self.size = 0

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> list[int]:
        """Of one word in lower case."""
        shown = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        return [t.id for t in self.model.tokenize(shown)]

    def _chunk(self, chunk: str) -> bytes:
        word = chunk.rstrip(_MARKS)
        if not (word.isalpha() and (word.isascii() or max(word) < _PLAIN and "\u0130" not in word)):
            return self._whole(chunk)
        ids = self._word(word.lower())
        if end := chunk[len(word) :]:
            if end not in self.marks:
                if len(self.marks) >= KEPT_MARKS:
                    self.marks.clear()
                self.marks[end] = self._word(end)
            ids += self.marks[end]
        return array("I", ids).tobytes()

    def __missing__(self, chunk: str) -> bytes:
        ids = self.older.get(chunk)
        if ids is None:
            ids = self._chunk(chunk)
        self.size += len(chunk) + len(ids) + 130
        self[chunk] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        text = text or ""
        if any(c in text for c in _CONTROL):
            return self._whole(text)
        ids = b"".join(map(self.__getitem__, text.split()))
        if self.size > KEPT_BYTES:
            self.older, self.size = dict(self), 0
            self.clear()
        return ids


def pieces(docs: DataFrame, path: str, closing_id: int = 0, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32; task and nth number the pieces of a length."""
    closing = np.array([closing_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, seen, task = held(("packing", path), lambda: Tokens(path)), Counter(), TaskContext.get().partitionId()
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch, out = whole.slice(at, 1000), []
                for doc_id, ids in zip(batch.column(0).to_pylist(), map(tokens.encode, batch.column(1).to_pylist()), strict=True):
                    ids += closing
                    for piece, start in enumerate(range(0, len(ids) // 4, capacity)):
                        part = ids[4 * start : 4 * (start + capacity)]
                        out.append((doc_id, piece, start, n := len(part) // 4, zlib.crc32(part), task, seen[n]))
                        seen[n] += 1
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(frugal(run, "packing"), "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long")


class Plan:
    """Which pieces of each length go where. Rows: length, first number, pieces per sequence, first sequence, offset."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY):
        self.capacity = capacity
        self.left = {n: c for n, c in counts.items() if c}
        self.used: dict[int, int] = defaultdict(int)
        self.rows: list[tuple[int, int, int, int, int]] = []
        self.sequences = self.fixed = 0
        self._reduce()
        self.reduced = self.sequences
        self._best_fit()

    def _place(self, length: int, sequences: int, each: int, first: int, offset: int, count: int | None = None) -> None:
        """Put `each` pieces of the length into each of the sequences (count in all, if the last gets fewer)."""
        count = sequences * each if count is None else count
        self.rows.append((length, self.used[length], each, first, offset))
        self.used[length] += count
        self.left[length] -= count
        if not self.left[length]:
            del self.left[length]

    def _fix(self, lengths: tuple[int, ...], times: int) -> None:
        """So many sequences with just these pieces, for good."""
        offset = 0
        for n, each in Counter(lengths).items():
            self._place(n, times, each, self.sequences, offset)
            offset += n * each
        self.sequences += times
        self.fixed += times * len(lengths)

    def _reduce(self) -> None:
        for longest in sorted(self.left, reverse=True):
            while longest in self.left and (found := dominating(self.left, longest, self.capacity)):
                self._fix(found, min(self.left[n] // c for n, c in Counter(found).items()))

    def _best_fit(self) -> None:
        open_by_room: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # room: (first sequence, sequences, filled)
        for n in sorted(self.left, reverse=True):
            for room in sorted(r for r in open_by_room if r >= n):
                runs, each = open_by_room[room], room // n
                while runs and n in self.left:
                    first, many, filled = runs.pop()
                    full = min(many, self.left[n] // each)
                    if full:
                        self._place(n, full, each, first, filled)
                        open_by_room[room - n * each].append((first, full, filled + n * each))
                    if full < many and (some := self.left.get(n, 0)):
                        self._place(n, 1, each, first + full, filled, some)
                        open_by_room[room - n * some].append((first + full, 1, filled + n * some))
                        full += 1
                    if full < many:
                        runs.append((first + full, many - full, filled))
                if not runs:
                    del open_by_room[room]
                if n not in self.left:
                    break
            if count := self.left.get(n, 0):
                each = self.capacity // n
                full, some = divmod(count, each)
                if full:
                    self._place(n, full, each, self.sequences, 0)
                    open_by_room[self.capacity - n * each].append((self.sequences, full, n * each))
                    self.sequences += full
                if some:
                    self._place(n, 1, each, self.sequences, 0, some)
                    open_by_room[self.capacity - n * some].append((self.sequences, 1, n * some))
                    self.sequences += 1


def dominating(counts: dict[int, int], longest: int, capacity: int) -> tuple[int, ...] | None:
    """The set with the longest piece that dominates all other feasible sets with it, if one of at most three pieces does.

    A set dominates another if the other's pieces can be parted into groups, each of which is
    no longer in all than a piece of its own in the set.
    """
    rest = Counter(counts)
    rest[longest] -= 1
    sizes = sorted(n for n, c in rest.items() if c > 0)
    room = capacity - longest
    fit = [n for n in sizes if n <= room]
    if not fit:
        return (longest,)
    one = fit[-1]
    if one == room:
        return (longest, one)
    smallest = [n for n in fit for _ in range(min(3, rest[n]))][:3]
    two = _best_pair(rest, fit, room)
    if two is None or one >= sum(two):  # then every pair, and with it every larger set, is no longer than this one piece
        if two is None or len(smallest) < 3 or sum(smallest) > room:
            return (longest, one)
        return None
    if len(smallest) == 3 and sum(smallest) <= room:
        return None  # larger sets than pairs are feasible
    partner = [n for n in fit if n <= room - one and (n != one or rest[n] > 1)]
    if not partner:
        return None
    other = partner[-1]
    # dominates, if in no pair both pieces are longer than the second and together longer than the first
    for a in fit[bisect_right(fit, other) :]:
        if 2 * a > room:
            break
        b = fit[bisect_right(fit, room - a) - 1]
        if (b != a or rest[a] > 1) and a + b > one:
            return None
    return (longest, one, other)


def _best_pair(rest: Counter, fit: list[int], room: int) -> tuple[int, int] | None:
    """The longest feasible pair."""
    best, j = None, len(fit) - 1
    for i, a in enumerate(fit):
        while j >= 0 and fit[j] + a > room:
            j -= 1
        if j < i:
            break
        b = fit[j] if j > i or rest[a] > 1 else None
        if b is not None and (best is None or a + b > sum(best)):
            best = (a, b)
    return best


def pack(docs: DataFrame, path: str, closing_id: int = 0, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    rows = materialise(pieces(docs, path, closing_id, capacity, id_col, text_col), "pieces")
    shares = materialise(rows.groupBy("length", "task").agg(F.count("*").alias("n")), "shares")
    counts = {r["length"]: r["n"] for r in shares.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    plan = np.array(Plan(counts, capacity).rows or [(0, 0, 1, 0, 0)], dtype=np.int64)
    plan = spark.sparkContext.broadcast(plan[np.lexsort((plan[:, 1], plan[:, 0]))])
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    firsts = shares.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, each, sequence, offset = plan.value.T
        keys = (length << 44) + first
        for batch in batches:
            n, nth = batch.column("length").to_numpy(), batch.column("nth").to_numpy() + batch.column("before").to_numpy()
            at = np.searchsorted(keys, (n << 44) + nth, "right") - 1
            k = nth - first[at]
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence[at] + k // each[at]), pa.array(offset[at] + k % each[at] * n)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    # lengths x tasks rows, which grow with the input: no broadcast
    return rows.join(firsts.hint("merge"), ["length", "task"]).mapInArrow(frugal(place, "packing"), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
