"""SimHash near-deduplication with Golay-code fuzzy hashing.

1. A text's fingerprint has 64 bits; each is 1 if set in over half the XXH64 hashes of its word
   shingles, repeats included. Texts with equal fingerprints are one node from here on.
2. A fingerprint is cut into three segments. Two errors over three segments leave one without
   any, and at most two in its neighbour. The neighbour is decoded with the binary Golay code
   (23, 12, 7), which is perfect: within four errors of a word there are one to six codewords,
   5.3 on average, and two words at most two apart share one, that next to a word between them.
   So a node gets some 16 keys, each an exact segment and a codeword's index (34 bits), and
   linked nodes have a key in common.
3. Nodes with an equal key are candidates. A bucket of up to `SMALL` nodes gives its pairs, which
   are verified by their distance. Nodes of larger buckets don't meet each other: each goes to
   the 65 words that are at most one bit from it. Those that meet there are at most two apart,
   and any two nodes at most two apart meet at a word between them, so a link from each to the
   least one there is exact and linear in the nodes. No word has more than 65 of them.
4. Components come from alternating large-star and small-star steps on written tables.

Defined cases: a text without words (or null) has fingerprint zero and is linked like any
other; with fewer words than a shingle has, the whole sequence is its one shingle. A null id
takes part, but a component's id is its least non-null id. Each row of docs gives one row,
repeated ones too; other columns don't matter, whatever their names. Empty tables give empty
results. Texts are handled a slice at a time, so long ones need no more memory.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Sieve, documents, frugal, materialise, spent
from .near_dedup import components

SHINGLE, APART, SEED = 3, 2, 42
#: Largest bucket whose nodes meet each other.
SMALL = 8
#: First bit and bits of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: The Golay code's generator, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
_GENERATOR = 0b110001110101
#: Bytes of a text that are handled at a time, about.
_SLICE = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _slices(text: bytes) -> Iterator[bytes]:
    """The text in parts that end at white space."""
    at = 0
    while len(text) - at > _SLICE and (gap := _SPACE.search(text, at + _SLICE)):
        yield text[at : gap.end()]
        at = gap.end()
    yield text[at:]


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """The 64 bits of a text in UTF-8."""
    ones, total, carried = np.zeros(64, np.int64), 0, []
    for part in _slices(text):
        words = carried + part.lower().split()  # of bytes: A-Z and ASCII white space only
        if len(words) >= size:
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = np.concatenate(([0], ends[:-1] + 1))
            ones += _ones([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[: len(ends) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)])
            total += len(words) - size + 1
        carried = words[max(0, len(words) - size + 1) :]
    if not total and carried:
        ones, total = _ones([xxhash.xxh64_intdigest(b" ".join(carried), SEED)]), 1
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def _ones(hashes: list[int]) -> np.ndarray:
    """How many of the hashes have each bit."""
    bits = np.unpackbits(np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", size) for t in batch.column(1).cast(pa.binary())), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(frugal(run), "doc_id long, fp long")


def _remainders() -> np.ndarray:
    """What each of the high 12 bits of a word of 23 leaves when divided by the generator."""
    out = np.arange(1 << 12, dtype=np.int64) << 11
    for k in range(22, 10, -1):
        out ^= np.where(out >> k & 1, _GENERATOR << k - 11, 0)
    return out


def _errors(high: np.ndarray) -> np.ndarray:
    """A row for each remainder: the one to six patterns of up to four errors that leave it; -1 where there are fewer."""
    out, filled = np.full((1 << 11, 6), -1, np.int64), np.zeros(1 << 11, np.int64)
    for weight in range(5):
        for places in combinations(range(23), weight):
            pattern = sum(1 << p for p in places)
            left = high[pattern >> 11] ^ pattern & 0x7FF
            out[left, filled[left]] = pattern
            filled[left] += 1
    return out


class Golay:
    """Decodes words of 23 bits."""

    def __init__(self) -> None:
        self.high = _remainders()
        self.errors = _errors(self.high)

    def near(self, words: np.ndarray) -> np.ndarray:
        """A row for each word: the indices (12 bits) of the codewords within four errors; -1 where there are fewer than six."""
        errors = self.errors[self.high[words >> 11] ^ words & 0x7FF]
        return np.where(errors >= 0, (words[:, None] ^ errors) >> 11, -1)


def keys_of(fps: np.ndarray, golay: Golay) -> tuple[np.ndarray, np.ndarray]:
    """The place of a fingerprint (unsigned) and a key, for each of the keys of each."""
    parts = [(fps >> np.uint64(at) & np.uint64((1 << bits) - 1)).astype(np.int64) for at, bits in SEGMENTS]
    places, keys = [], []
    for i, part in enumerate(parts):
        index = golay.near(parts[(i + 1) % len(parts)])
        place, which = np.nonzero(index >= 0)
        places.append(place)
        keys.append((i << 34) | (part[place] << 12) | index[place, which])
    return np.concatenate(places), np.concatenate(keys)


def _keyed(nodes: DataFrame) -> DataFrame:
    """key, fp."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        golay = Golay()
        for batch in batches:
            fps = batch.column(0).to_numpy()
            place, keys = keys_of(fps.view(np.uint64), golay)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps[place])], ["key", "fp"])

    return nodes.select("fp").mapInArrow(frugal(run), "key long, fp long")


def _pairs(few: DataFrame) -> DataFrame:
    """All pairs a, b of buckets of up to SMALL nodes that are near enough."""
    listed = few.groupBy("key").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    each = listed.select("fps", F.posexplode("fps").alias("i", "a")).select("a", F.explode(F.expr("slice(fps, i + 2, size(fps))")).alias("b"))
    return each.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= APART).distinct()


def _met(crowd: DataFrame) -> DataFrame:
    """Pairs a, b of distinct nodes that meet at a word at most one bit from both: each with the least one there."""
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << k if k < 63 else -(1 << 63)) for k in range(64)])
    words = crowd.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("word"))
    listed = words.groupBy("word").agg(F.collect_list("fp").alias("fps")).where("size(fps) > 1")
    stars = listed.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b"))
    return stars.where("a != b").distinct()


def links(nodes: DataFrame) -> DataFrame:
    """Pairs a, b of fingerprints at most APART bits apart that connect all such pairs. nodes: fp, distinct."""
    keyed = materialise(_keyed(nodes), "keyed")
    buckets = materialise(keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "buckets")
    # what has its bucket to itself stays out of the shuffle; what a hot bucket is joined with is written first, so the join can be split
    members = materialise(keyed.where(Sieve(buckets, "key").passes()).join(buckets, "key"), "members")
    crowd = materialise(members.where(f"size > {SMALL}").select("fp").distinct(), "crowd")
    found = materialise(_pairs(members.where(f"size <= {SMALL}")).unionByName(_met(crowd)).distinct(), "links")
    spent(keyed, buckets, members, crowd)
    return found


def decide(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """A row for each row of docs: doc_id, fingerprint, component_id."""
    rows = materialise(fingerprints(docs, id_col, text_col, size), "fingerprints")
    nodes = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    found = links(nodes)
    roots = components(found)
    named = materialise(nodes.join(roots.withColumnRenamed("row", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "named")
    least = materialise(named.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    known = materialise(named.join(least, "root").select("fp", "component_id"), "known")
    spent(nodes, found, roots, named, least)
    return rows.join(known, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide(documents(spark, sf_dir))
