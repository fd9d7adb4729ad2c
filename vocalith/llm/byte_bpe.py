"""Byte-level BPE encoding and decoding by DuckDB recursive queries, inside each partition.

A partition's texts are cut into words by the tokenizer's pattern. Words that the worker
hasn't met yet become token-position rows, one per byte, which a recursive query joins with
the merge table: each round contracts the leftmost pair of least rank in every word that has
one, until no word has any; finished words leave the recursion. Decoding joins the token
positions of whole documents with the vocabulary and aggregates the bytes in order.

A word of over `SEGMENT` bytes becomes overlapping segments, contracted like words, or its
rounds times its length would be quadratic. Two neighbours are joined at a token that both have
at the same place. That is exact: a sequence of tokens is the encoding of its text if each
two neighbours in it are the encoding of theirs (until one round contracts across a token's
end, the rounds between two ends are those of that token alone), and each two neighbours of
the joined sequence are neighbours in a segment's encoding. If two segments have no token
in common, the word is cut into segments four times as long, at last into one.

A word's ids are kept for later texts, per worker process, in two generations of bounded
bytes, of which the older one goes; texts are read in slices and contracted and decoded in
batches of bounded size, so memory doesn't grow with the partition.

Defined cases: a null text counts as empty and has no tokens (its digests are those of no
bytes). Text that looks like a special token is ordinary text. Repeated rows give repeated
rows; null ids pass through. An empty table gives an empty result. Only the id and the text
are read, so other columns can't clash.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.shuffle import _get_local_dirs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, frugal, held

#: Characters of text handled at a time, bytes of words or tokens per query, bytes of words kept in a generation per worker.
SLICE_CHARS, QUERY_ROWS, KEPT_BYTES = 2_000_000, 600_000, 40_000_000
#: Bytes of a segment; the next one begins in its middle.
SEGMENT = 128

#: Word and position share an integer, k = (word << 32) + position, and so do rank and position.
_CONTRACT_SQL = """
WITH RECURSIVE t(live, k, id) AS (
  SELECT true, k, id FROM tokens
  UNION ALL
  SELECT best.v IS NOT NULL,
         CASE WHEN t.k > (best.w << 32) + (best.v & 4294967295) THEN t.k - 1 ELSE t.k END,
         CASE WHEN t.k = (best.w << 32) + (best.v & 4294967295) THEN best.v >> 32 ELSE t.id END
  FROM t LEFT JOIN (
    SELECT a.k >> 32 AS w, min(merges.id * 4294967296 + (a.k & 4294967295)) AS v
    FROM t a JOIN t b ON b.k = a.k + 1
    JOIN merges ON merges.pair = a.id * 16777216 + b.id
    WHERE a.live AND b.live
    GROUP BY 1
  ) best ON best.w = t.k >> 32
  WHERE t.live AND t.k <> coalesce((best.w << 32) + (best.v & 4294967295) + 1, -1)
)
SELECT k, id FROM t WHERE NOT live ORDER BY k
"""

#: Each byte of a token is the character of that number.
_DECODE_SQL = """
SELECT part, string_agg(vocabulary.bytes, '' ORDER BY k) AS bytes
FROM ids JOIN vocabulary USING (id) GROUP BY 1
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def _classes(pattern: str) -> str:
    """The pattern for Latin-1 texts, the characters of each class spelled out."""
    latin = list(map(chr, range(256)))
    some = {r"\p{L}": [c for c in latin if unicodedata.category(c)[0] == "L"], r"\p{N}": [c for c in latin if unicodedata.category(c)[0] == "N"], r"\s": [*"\t\n\v\f\r\x20\x85\xa0"]}
    inside = re.sub(r"\[[^\]]*\]", lambda m: functools.reduce(lambda p, x: p.replace(x[0], re.escape("".join(x[1]))), some.items(), m[0].replace(r"\S", "")), pattern)
    for name, of in some.items():
        inside = inside.replace(name, f"[{re.escape(''.join(of))}]")
    return inside.replace(r"\S", f"[^{re.escape(''.join(some[r'\s']))}]")


class Coder:
    """Words to ids and ids to bytes, by DuckDB, with a bounded store of what it has seen."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        ranks = read_ranks(path)
        splits = [(ranks[a], ranks[b], rank) for token, rank in ranks.items() for k in range(1, len(token)) if (a := token[:k]) in ranks and (b := token[k:]) in ranks]
        left, right, merged = np.array(splits, dtype=np.int64).reshape(-1, 3).T
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self._any, self._latin = regex.compile(pattern).findall, re.compile(_classes(pattern)).findall
        # what is too much for memory goes where Spark's own workers spill
        spill = _get_local_dirs("duckdb")[0]
        os.makedirs(os.path.dirname(spill), exist_ok=True)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "temp_directory": spill})
        self._table("merges", pair=left * (1 << 24) + right, id=merged)
        self._table("vocabulary", id=np.fromiter(ranks.values(), np.int64), bytes=[t.decode("latin-1") for t in ranks])
        self.store: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.size = 0

    def words_of(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self._any(text)
        return self._latin(text)

    def _table(self, name: str, **columns) -> None:
        self.db.register("columns", pa.table(columns))
        self.db.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM columns")
        self.db.unregister("columns")

    def contract(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as little-endian 32-bit integers."""
        out = []
        for at, end in _batches(list(map(len, words)), QUERY_ROWS):
            sizes = np.fromiter(map(len, words[at:end]), np.int64, end - at)
            flat = np.frombuffer(b"".join(words[at:end]), np.uint8)
            word, first = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes
            self._table("tokens", k=(word << 32) + np.arange(len(flat)) - np.repeat(first, sizes), id=self.byte_ids[flat])
            found = self.db.sql(_CONTRACT_SQL).to_arrow_table()
            ids, bounds = found["id"].to_numpy().astype("<u4").tobytes(), (4 * np.searchsorted(found["k"].to_numpy() >> 32, np.arange(len(sizes) + 1))).tolist()
            out += [ids[i:j] for i, j in zip(bounds, bounds[1:], strict=False)]
        return out

    def _long(self, word: bytes, size: int = SEGMENT) -> bytes:
        """The ids of a long word, by segments."""
        starts = range(0, max(1, len(word) - size // 2), size // 2)
        first, *rest = ((i, np.frombuffer(x, "<u4")) for i, x in zip(starts, self.contract([word[i : i + size] for i in starts]), strict=True))
        # (tokens, their places): what is joined so far ends where its last segment does
        parts, ids, places = [], first[1], self._places(first)
        for segment in rest:
            new = self._places(segment)
            # a token is in both if it begins and ends at the same places in both
            ends, new_ends = (np.append(x[1:], -1 - i) for i, x in enumerate((places, new)))
            _, i, j = np.intersect1d(places, new, return_indices=True)
            both = np.flatnonzero(ends[i] == new_ends[j])
            if not len(both):
                return self._long(word, 4 * size)
            i, j = i[both[0]], j[both[0]]
            parts.append(ids[:i])
            ids, places = segment[1][j:], new[j:]
        return np.concatenate([*parts, ids]).tobytes()

    def _places(self, segment: tuple[int, np.ndarray]) -> np.ndarray:
        sizes = self.sizes[segment[1]]
        return segment[0] + np.cumsum(sizes) - sizes

    @functools.cached_property
    def sizes(self) -> np.ndarray:
        """Bytes of each token, by id."""
        ids, sizes = self.db.sql("SELECT id, length(bytes) AS n FROM vocabulary").to_arrow_table().columns
        out = np.zeros(max(ids.to_pylist()) + 1, np.int64)
        out[ids.to_numpy()] = sizes.to_numpy()
        return out

    def learn(self, words: set[str]) -> None:
        """Put the ids of the words into the store."""
        if self.size > KEPT_BYTES:
            self.store, self.older, self.size = {}, self.store, 0
        missing = []
        for word in words:
            if word not in self.store:
                if word in self.older:
                    self.store[word] = self.older[word]
                    self.size += len(word) + 200
                else:
                    missing.append(word)
        coded = [w.encode("utf-8", "surrogatepass") for w in missing]
        short = [i for i, w in enumerate(coded) if len(w) <= SEGMENT]
        for i, ids in zip(short, self.contract([coded[i] for i in short]), strict=True):
            self.store[missing[i]] = ids
        for i, word in enumerate(coded):
            if len(word) > SEGMENT:
                self.store[missing[i]] = self._long(word)
        self.size += sum(map(len, coded)) + 200 * len(missing)

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """The bytes of each sequence of ids."""
        # a long text's are decoded in several parts
        parts = [(i, x[at : at + QUERY_ROWS]) for i, x in enumerate(ids) for at in range(0, len(x), QUERY_ROWS)]
        out: list[list[bytes]] = [[] for _ in ids]
        for start, end in _batches([len(x) for _, x in parts], QUERY_ROWS):
            sizes = np.fromiter((len(x) for _, x in parts[start:end]), np.int64, end - start)
            flat = np.concatenate([x for _, x in parts[start:end]]).astype(np.int64)
            first = np.cumsum(sizes) - sizes
            self._table("ids", part=np.repeat(np.arange(start, end), sizes), k=np.arange(len(flat)) - np.repeat(first, sizes), id=flat)
            for part, text in sorted(self.db.sql(_DECODE_SQL).fetchall()):
                out[parts[part][0]].append(text.encode("latin-1"))
        return list(map(b"".join, out))

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """For each text its ids, as little-endian 32-bit integers."""
        for at, end in _batches([len(t or "") for t in texts], SLICE_CHARS):
            words = [self.words_of(t or "") for t in texts[at:end]]
            self.learn(set().union(*words))
            for w in words:
                yield np.frombuffer(b"".join(map(self.store.__getitem__, w)), "<u4")


def _batches(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Runs of items of at most so much in all, or single ones."""
    at, total = 0, 0
    for i, n in enumerate(sizes):
        if total + n > most and i > at:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield at, len(sizes)


def _coder(path: str, pattern: str) -> Coder:
    """One for each worker process: later tasks find its store filled."""
    return held(("byte_bpe", path, pattern), lambda: Coder(path, pattern))


def _pieces(batch: pa.RecordBatch, size: int = 2000) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, size):
        yield batch.slice(at, size)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id and its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path, pattern)
        for batch in (b for whole in batches for b in _pieces(whole)):
            ids = [x.astype(np.int32) for x in coder.encode(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(frugal(run, "byte_bpe"), "doc_id long, ids array<int>")


def decode(coded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """A row for each row of coded: doc_id and the decoded bytes (null ids: none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path, pattern)
        for batch in (b for whole in batches for b in _pieces(whole, 200)):
            ids = [np.array(x or [], np.int64) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(coder.decode(ids), pa.binary())], ["doc_id", "bytes"])

    return coded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(frugal(run, "byte_bpe"), "doc_id long, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256; the ids themselves stay in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path, pattern)
        for batch in (b for whole in batches for b in _pieces(whole)):
            ids, counts, ids_hash, text_hash = [], [], [], []

            def flush() -> None:
                text_hash.extend(hashlib.sha256(x).hexdigest() for x in coder.decode(ids))
                ids.clear()

            for x in coder.encode(batch.column(1).to_pylist()):
                ids.append(x)
                counts.append(len(x))
                ids_hash.append(hashlib.sha256(x).hexdigest())
                if sum(map(len, ids)) > QUERY_ROWS:
                    flush()
            flush()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(frugal(run, "byte_bpe"), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
