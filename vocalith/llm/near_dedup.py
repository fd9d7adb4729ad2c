"""MinHash near-deduplication with sequential Bayesian verification.

1. Each text's set of distinct word shingles gives a set digest and a MinHash signature.
   Texts with equal sets are one node from here on, so copies never meet each other.
2. Nodes with an equal band are candidates. Bands are as many as bring the chance that a
   pair at the threshold shares none below `MISS`. A bucket of up to `SMALL` nodes gives all
   its pairs. In larger ones, nodes go whose share of shingles that no other such node has
   rules out every partner (an exact bound); the others are compared with the bucket's most
   central node and, once links are known, those in another component than most of the bucket
   with the rest of it, as far as the same bound allows. Pairs inside one component need no
   comparison, so a bucket of near copies stays near linear.
3. Candidates are compared by signature a batch at a time. After n positions with m matches
   the similarity's posterior (uniform prior) is Beta(m + 1, n - m + 1); a pair goes once the
   chance that it reaches the threshold is below `MISS`.
4. Survivors are verified on their full sets, made anew from the whole texts.
5. Components of the links come from alternating large-star and small-star steps on written
   tables; nothing but the edge count and a checksum reaches the driver.

Defined cases: a text without words (or null) has an empty set, links with nothing and is its
own component; with fewer words than a shingle has, the whole sequence is its one shingle.
A null id takes part, but a component's id is its least non-null id. Repeated rows are copies
like any others; `decide` calls each row with the component's id kept, as stated in its
contract, while `deduplicate` keeps exactly one row of each component. Empty tables give
empty results. `deduplicate` passes all columns through, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Sieve, documents, fresh, frugal, materialise, ordered_id, spent

SHINGLE, PERCENT, ROWS, MISS, BATCH, SMALL = 5, 80, 6, 1e-6, 32, 8
#: Bits of a node's parity sketch.
PARITY = 2048
#: Words handled at a time, about.
_SLICE = 100_000
#: Texts, and pairs by their signatures, for one task.
TEXTS_EACH, PAIRS_EACH = 20_000, 50_000
#: Keys of texts that a task remembers.
REMEMBERED = 200_000


def bands_for(percent: int, rows: int = ROWS, miss: float = MISS) -> int:
    """Bands that leave a pair at the threshold without a common one with a chance below miss."""
    return math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** rows))


def _odd(count: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers in which every bit depends on every other."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_WORD_SEEDS = _odd(64, 7)


def shingle_sets(texts: list[str | None], size: int = SHINGLE) -> list[np.ndarray]:
    """For each text its set, as sorted 64-bit fingerprints."""
    words = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]  # of bytes: A-Z and ASCII white space only
    sizes = [len(w) for w in words]
    flat = np.fromiter((h for w in words for h in map(xxhash.xxh3_64_intdigest, w)), np.uint64, sum(sizes))
    out, at = [], 0
    whole = np.zeros(max(0, len(flat) - size + 1), np.uint64)
    for k in range(size):
        whole += flat[k : k + len(whole)] * _WORD_SEEDS[k]
    whole = _mixed(whole)
    for n in sizes:
        if n >= size:
            out.append(np.unique(whole[at : at + n - size + 1]))
        elif n:
            out.append(_mixed((flat[at : at + n] * _WORD_SEEDS[:n]).sum(keepdims=True) + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def _signed(sets: list[np.ndarray], factors: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """Minima of each permutation over each set; sets aren't empty."""
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    flat = np.concatenate(sets)
    out = np.empty((len(sets), len(factors)), np.uint64)
    for i, (a, b) in enumerate(zip(factors, shifts, strict=True)):
        out[:, i] = np.minimum.reduceat(flat * a + b, starts)
    return out


def _parities(fingerprints: np.ndarray) -> np.ndarray:
    """Of each of PARITY classes of fingerprints whether the set has an odd number, as 64-bit integers.

    Two sets whose parities differ in d classes differ in d elements at least.
    """
    odd = np.bincount((fingerprints >> np.uint64(64 - PARITY.bit_length() + 1)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _slices(column: pa.Array, most: int = 6 * _SLICE) -> Iterator[tuple[int, int, list[str | None]]]:
    """Runs of texts of about so many bytes: begin, end, texts."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    at = 0
    while at < len(sizes):
        end, n = at, 0
        while end < len(sizes) and (n < most or end == at):
            n += sizes[end]
            end += 1
        yield at, end, column.slice(at, end - at).to_pylist()
        at = end


def signatures(docs: DataFrame, percent: int, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """row, doc_id, text_hash, n, set_hash, and (null for empty sets) the signature, a byte of each minimum; the keys of the bands; the parities."""
    bands = bands_for(percent)
    factors, shifts, seeds = _odd(bands * ROWS, 11), _odd(bands * ROWS, 13), _odd(ROWS, 17)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, texts in _slices(batch.column(3)):
                sets = shingle_sets(texts, size)
                full = [i for i, s in enumerate(sets) if len(s)]
                digests, signs, keys = [None] * len(sets), [None] * len(sets), [None] * len(sets)
                if full:
                    minima = _signed([sets[i] for i in full], factors, shifts)
                    low = (_mixed(minima) >> np.uint64(56)).astype(np.uint8)
                    key = _mixed((minima.reshape(len(full), bands, ROWS) * seeds).sum(axis=2) + np.arange(bands, dtype=np.uint64)).astype(np.int64)
                    for k, i in enumerate(full):
                        digests[i], signs[i], keys[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest(), low[k].tobytes(), key[k]
                first = [batch.column(c).slice(at, end - at) for c in range(3)]
                columns = [pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(signs, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array([_parities(s) if len(s) else None for s in sets], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*first, *columns], ["row", "doc_id", "text_hash", "n", "set_hash", "sign", "bands", "parities"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))
    return rows.mapInArrow(frugal(run), "row long, doc_id long, text_hash long, n long, set_hash binary, sign binary, bands array<long>, parities array<long>")


def least_matches(percent: int, total: int, miss: float = MISS, batch: int = BATCH) -> list[tuple[int, int]]:
    """(positions compared, matches below which a pair is dropped) after each batch."""
    out, t = [], percent / 100
    for n in range(batch, total + 1, batch):
        # the posterior's weight above t is that of at most m successes among n + 1 trials at t
        tail, m = (1 - t) ** (n + 1), 0
        while tail < miss:
            m += 1
            tail += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append((n, m))
    return out


def _prune(pairs: DataFrame, signs: DataFrame, percent: int) -> DataFrame:
    """Pairs a, b that the signatures don't rule out. signs: row, n, sign of all rows in pairs."""
    steps = least_matches(percent, bands_for(percent) * ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sign", "sign_b"))
            alive, matches, done = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64), 0
            for n, least in steps:
                matches[alive] += (x[alive, done:n] == y[alive, done:n]).sum(axis=1)
                alive, done = alive[matches[alive] >= least], n
            yield batch.select(["a", "b"]).take(pa.array(alive))

    of = signs.select("row", "n", "sign")
    joined = pairs.join(of.select(F.col("row").alias("b"), F.col("n").alias("n_b"), F.col("sign").alias("sign_b")), "b").join(of.withColumnRenamed("row", "a"), "a")
    near = joined.where((100 * F.least("n", "n_b") >= percent * F.greatest("n", "n_b")))
    return near.select("a", "b", "sign", "sign_b").mapInArrow(frugal(run), "a long, b long")


def _texts(needed: DataFrame, most: int, rows: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row, text and crowd of the needed rows (row, crowd), by (id, hash of the text). A sieve of these keeps all other texts out of the shuffle."""
    keys = materialise(needed.join(rows, "row").select("row", "crowd", ordered_id(F.col("doc_id")).alias("ord"), "text_hash"), "keys", most, picked=True)
    sent = Sieve(keys, "ord", "text_hash").sent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[tuple[int, int]] = set()
        for batch in batches:
            at = np.flatnonzero(Sieve.test(sent.value, batch.column("h").to_numpy()))
            # repeated rows: one is enough; a task remembers a bounded number
            some, fresh_ = batch.select(["ord", "text_hash"]).take(pa.array(at)), []
            for i, key in enumerate(zip(*(c.to_pylist() for c in some.columns), strict=True)):
                if key not in given:
                    fresh_.append(at[i])
                    given.add(key)
            if len(given) > REMEMBERED:
                given.clear()
            yield batch.select(["ord", "text_hash", "text"]).take(pa.array(fresh_, pa.int64()))

    texts = docs.select(ordered_id(F.col(id_col)).alias("ord"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).cast("string").alias("text"))
    texts = texts.select("ord", "text_hash", "text", F.xxhash64("ord", "text_hash").alias("h")).mapInArrow(frugal(run), "ord long, text_hash long, text string")
    out = materialise(texts.join(keys, ["ord", "text_hash"]).dropDuplicates(["ord", "text_hash", "row"]).select("row", "text", "crowd"), "texts", most, TEXTS_EACH)
    spent(keys)
    return out


def _own_shingles(texts: DataFrame, size: int) -> DataFrame:
    """row, own: how many of a node's shingles no other of these nodes has, where there are any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, texts in _slices(batch.column(1)):
                sets = shingle_sets(texts, size)
                rows = np.repeat(batch.column(0).slice(at, end - at).to_numpy(), [len(x) for x in sets])
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(np.concatenate(sets).astype(np.int64))], ["row", "shingle"])

    shingles = texts.select("row", "text").mapInArrow(frugal(run), "row long, shingle long")
    return shingles.groupBy("shingle").agg(F.count("*").alias("n"), F.min("row").alias("row")).where("n = 1").groupBy("row").agg(F.count("*").alias("own"))


def _verify(pairs: DataFrame, texts: DataFrame, percent: int, size: int) -> DataFrame:
    """Pairs a, b whose full sets reach the threshold. texts: row, text of all rows in pairs, whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: OrderedDict[int, np.ndarray] = OrderedDict()

        def of(row: int, text: str) -> np.ndarray:
            if row not in known:
                known[row] = shingle_sets([text], size)[0]
                if len(known) > 64:
                    known.popitem(last=False)
            return known[row]

        for whole in batches:
            for at in range(0, whole.num_rows, 100):
                batch, found = whole.slice(at, 100), []
                for i, (a, b, text, text_b) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("a", "b", "text", "text_b")), strict=True)):
                    x, y = of(a, text), of(b, text_b)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * both >= percent * (len(x) + len(y) - both):
                        found.append(i)
                yield batch.select(["a", "b"]).take(pa.array(found, pa.int64()))

    joined = pairs.join(texts.select(F.col("row").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("row").alias("a"), "text"), "a")
    return joined.select("a", "b", "text", "text_b").mapInArrow(frugal(run), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """row, root: for every node of links (a, b) the least node that it is connected with."""

    def ordered(edges: DataFrame) -> DataFrame:
        return edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    def state(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    # least neighbours are written before they are joined, so a hub's edges can be split over tasks
    most = 2 * links.count()
    edges = materialise(ordered(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "edges", most)
    before, now = None, state(edges)
    while now != before:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least", most)
        large = materialise(ordered(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))), "edges", most)
        spent(edges, least)
        least = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "least", most)
        edges = materialise(ordered(large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))), "edges", most)
        spent(large, least)
        before, now = now, state(edges)
    labels = materialise(edges.select(F.col("u").alias("row"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("row"), F.col("v").alias("root")).distinct()), "labels", most)
    spent(edges)
    return labels


def _members(bands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of buckets of two nodes the pairs a, b; of larger ones key, row, size, first. bands: row, bands."""
    keyed = bands.select(F.explode("bands").alias("key"), "row")
    buckets = materialise(keyed.groupBy("key").agg(F.count("*").alias("size"), F.min("row").alias("first"), F.max("row").alias("last")).where("size > 1"), "buckets")
    pairs, rows = buckets.agg(F.sum(F.when(F.col("size") == 2, 1)), F.sum(F.when(F.col("size") > 2, F.col("size")))).first()
    two = materialise(buckets.where("size = 2").select(F.col("first").alias("a"), F.col("last").alias("b")).distinct(), "two", pairs or 0)
    more = buckets.where("size > 2").drop("last")
    members = materialise(keyed.where(Sieve(more, "key").passes()).join(more, "key"), "members", rows or 0, picked=True)
    spent(buckets)
    return two, members


def _few(members: DataFrame) -> DataFrame:
    """All pairs of small buckets."""
    few = members.where(f"size <= {SMALL}")
    star = few.where("row != first").select(F.col("first").alias("a"), F.col("row").alias("b"))
    listed = few.where("row != first").groupBy("key").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    each = listed.select("rows", F.posexplode("rows").alias("i", "a")).select("a", F.explode(F.expr("slice(rows, i + 2, size(rows))")).alias("b"))
    return star.unionByName(each)


def _many(members: DataFrame, signs: DataFrame, texts: DataFrame, percent: int, size: int) -> DataFrame:
    """key, row, n, own, shared, center: nodes of large buckets that can have a partner in theirs.

    A node shares at most n - own shingles, and no partner is smaller than the bucket's least
    node. The center is the node with the fewest shingles of its own: in a group of edited
    copies the one nearest to what they were copied from, so most links are with it.
    What a bucket's nodes are joined with is written first, so a hot bucket can be split over tasks.
    """
    large = members.where(f"size > {SMALL}").select("key", "row")
    most = large.count()
    own = materialise(_own_shingles(texts.where("crowd"), size), "own", most)
    sizes = signs.select("row", "n").join(own, "row", "left").na.fill(0, ["own"]).withColumn("shared", F.col("n") - F.col("own"))
    large = materialise(large.join(sizes, "row"), "large", most)
    least = materialise(large.groupBy("key").agg(F.min("n").alias("least")), "least", most)
    able = materialise(large.join(least, "key").where(F.col("shared") * 100 >= percent * (F.col("n") + F.greatest("least", "shared") - F.col("shared"))).drop("least"), "able", most)
    centers = materialise(able.groupBy("key").agg(F.min_by("row", F.struct("own", "row")).alias("center"), F.count("*").alias("size")).where("size > 1").drop("size"), "centers", most)
    many = materialise(able.join(centers, "key"), "many", most)
    spent(own, large, least, able, centers)
    return many


def _stars(many: DataFrame) -> DataFrame:
    """Each node of a large bucket with the center."""
    return many.where("row != center").select(F.least("row", "center").alias("a"), F.greatest("row", "center").alias("b"))


def _left_over(many: DataFrame, labels: DataFrame, signs: DataFrame, percent: int) -> DataFrame:
    """Pairs across components in large buckets that may reach the threshold: nodes outside the bucket's main component with all others.

    Near copies share many buckets; a pair comes out of the first that both are in. Exact
    bounds hold back pairs by the shingles that can't be common and by those that differ.
    """
    most = many.count()
    rooted = materialise(many.where("row != center").join(labels, "row", "left").select("key", "row", "n", "shared", F.coalesce("root", "row").alias("root")), "rooted", most)
    counts = rooted.groupBy("key", "root").agg(F.count("*").alias("nodes"))
    mixed = materialise(counts.groupBy("key").agg(F.count("*").alias("roots"), F.max_by("root", F.struct("nodes", "root")).alias("main")).where("roots > 1").drop("roots"), "mixed", most)
    contested = materialise(rooted.join(mixed, "key"), "contested", most)
    keys = many.join(contested.select("row").distinct(), "row", "left_semi").groupBy("row").agg(F.collect_set("key").alias("keys"))
    large = materialise(contested.join(keys, "row").join(signs.select("row", "parities"), "row"), "large", most)
    outside = large.where("root != main").select("key", *[F.col(c).alias(f"x_{c}") for c in ("row", "root", "n", "shared", "keys", "parities")])
    may = f"100 * least(shared, x_shared) >= {percent} * (n + x_n - least(shared, x_shared))"
    apart = "aggregate(zip_with(parities, x_parities, (p, q) -> bit_count(p ^ q)), 0, (s, b) -> s + b)"
    near = f"100 * (n + x_n - {apart}) >= {percent} * (n + x_n + {apart})"
    pairs = outside.join(large, "key").where(f"root != x_root AND (root = main OR x_row < row) AND {may} AND array_min(array_intersect(keys, x_keys)) = key AND {near}")
    out = materialise(pairs.select(F.least("x_row", "row").alias("a"), F.greatest("x_row", "row").alias("b")).distinct(), "pairs")
    spent(rooted, mixed, contested, large)
    return out


def _links(rows: DataFrame, nodes: DataFrame, docs: DataFrame, percent: int, id_col: str, text_col: str, size: int) -> DataFrame:
    """row, root: the components of nodes that are linked with any other."""
    bands = materialise(rows.select("row", "bands").join(nodes, "row"), "bands", rows.count())
    two, members = _members(bands)
    spent(bands)
    # a bucket of up to SMALL nodes gives so many pairs a node
    few = materialise(two.unionByName(_few(members)).distinct(), "pairs", two.count() + members.count() * (SMALL - 1) // 2)
    crowd = members.where(f"size > {SMALL}").select("row").distinct()
    paired = few.select(F.explode(F.array("a", "b")).alias("row"))
    # from here on only rows that share a bucket count: their signatures, and the texts of those that aren't ruled out, are fetched once
    in_buckets = materialise(crowd.unionByName(paired).distinct(), "rows", members.count() + 2 * few.count())
    rows_in = in_buckets.count()
    signs = materialise(rows.select("row", "n", "sign", "parities").where(Sieve(in_buckets, "row").passes()).join(in_buckets, "row"), "signs", rows_in, picked=True)
    likely = materialise(_prune(few, signs, percent), "likely", few.count(), PAIRS_EACH)
    ends = likely.select(F.explode(F.array("a", "b")).alias("row"), F.lit(False).alias("crowd"))
    needed = crowd.withColumn("crowd", F.lit(True)).unionByName(ends).groupBy("row").agg(F.max("crowd").alias("crowd"))
    texts = _texts(needed, rows_in, rows.select("row", "doc_id", "text_hash"), docs, id_col, text_col)
    many = _many(members, signs, texts, percent, size)
    stars = materialise(_prune(_stars(many).distinct(), signs, percent), "likely", many.count(), PAIRS_EACH)
    found = materialise(_verify(likely.unionByName(stars).distinct(), texts, percent, size), "links", likely.count() + stars.count(), TEXTS_EACH // 4)
    spent(two, members, few, in_buckets, likely, stars)
    labels = components(found)
    rest = _left_over(many, labels, signs, percent)
    if n := rest.count():
        likely = materialise(_prune(rest, signs, percent), "likely", n, PAIRS_EACH)
        late = materialise(_verify(likely, texts, percent, size), "links", likely.count(), TEXTS_EACH // 4)
        if not late.isEmpty():
            spent(labels)
            labels = components(found.unionByName(late))
        spent(likely, late)
    spent(signs, texts, many, found, rest)
    return labels


def _decided(docs: DataFrame, percent: int, id_col: str, text_col: str, size: int) -> DataFrame:
    """row, doc_id, text_hash, n, component_id, keeper (the component's one row that stays), alone (no other row is in its component)."""
    signed = materialise(signatures(docs, percent, id_col, text_col, size), "signatures")
    sets = signed.where("n > 0").withColumn("ord", ordered_id(F.col("doc_id"))).groupBy("set_hash").agg(F.min_by("row", "ord").alias("node"), F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    most = signed.count()
    sets = materialise(sets, "sets", most)
    labels = _links(signed, sets.select(F.col("node").alias("row")), docs, percent, id_col, text_col, size)
    named = materialise(sets.join(labels.withColumnRenamed("row", "node"), "node", "left").withColumn("root", F.coalesce("root", "node")), "named", most)
    keepers = materialise(named.groupBy("root").agg(F.min("least").alias("component_id"), F.min_by("node", ordered_id(F.col("least"))).alias("keeper_row"), F.sum("copies").alias("all")).where("all > 1").drop("all"), "keepers", most)
    known = materialise(named.join(keepers, "root").select("set_hash", "component_id", "keeper_row"), "known", most)
    rows = materialise(signed.select("row", "doc_id", "text_hash", "n", "set_hash"), "rows", most)
    spent(signed, sets, labels, named, keepers)
    alone = F.col("keeper_row").isNull()
    return rows.join(known, "set_hash", "left").select(
        "row", "doc_id", "text_hash", "n", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), (F.coalesce("keeper_row", "row") == F.col("row")).alias("keeper"), alone.alias("alone")
    )


def decide(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """A row for each row of docs: doc_id, n_shingles, component_id, kept (for a null id: whether it is the component's one row that stays)."""
    decided = _decided(docs, percent, id_col, text_col, size)
    kept: Column = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("keeper") & F.col("component_id").isNull())
    return decided.select("doc_id", F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))


def deduplicate(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """The rows of docs that stay, one of each component, with the columns of docs.

    Rows alone in their component pass where they lie; a sieve finds the others, and only these
    are shuffled. They go by (id, hash of the text), which the written decisions carry; rows
    alike in both are copies.
    """
    ord_, hash_ = fresh(docs, "ord", "hash")
    grouped = _decided(docs, percent, id_col, text_col, size).where("NOT alone").select(ordered_id(F.col("doc_id")).alias(ord_), F.col("text_hash").alias(hash_), "keeper")
    grouped = materialise(grouped, "grouped", grouped.count(), picked=True)
    tagged = docs.withColumns({ord_: ordered_id(F.col(id_col)), hash_: F.xxhash64(F.col(text_col))})
    met = Sieve(grouped, ord_, hash_).passes()
    kept = tagged.where(met).join(grouped.where("keeper").select(ord_, hash_), [ord_, hash_], "left_semi").dropDuplicates([ord_, hash_])
    others = tagged.where(met).join(grouped.select(ord_, hash_), [ord_, hash_], "left_anti")
    return tagged.where(~met).unionByName(kept).unionByName(others).select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide(documents(spark, sf_dir), percent=85)
