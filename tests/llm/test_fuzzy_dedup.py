"""SimHash near-deduplication against all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash

from vocalith.llm import fuzzy_dedup
from vocalith.llm.fuzzy_dedup import Golay


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(values):
    """Least place linked with each, over all pairs."""
    parent = list(range(len(values)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if bin(values[i] ^ values[j]).count("1") <= 2:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(values))]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_the_code_is_perfect():
    golay = Golay()
    # each remainder has one pattern of up to three errors; those of three have five more of four
    assert sorted(set((golay.errors >= 0).sum(axis=1).tolist())) == [1, 6]
    assert all(golay.high[p >> 11] ^ p & 0x7FF == left for left, row in enumerate(golay.errors.tolist()) for p in row if p >= 0)


def test_words_two_apart_share_a_codeword():
    golay, rng = Golay(), np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 4000)
    one, two = (1 << rng.integers(0, 23, len(words)) for _ in range(2))
    for other in (words, words ^ one, words ^ one ^ two):
        for x, y in zip(golay.near(words).tolist(), golay.near(other).tolist(), strict=True):
            assert (set(x) & set(y)) - {-1}


def test_fingerprints_two_apart_share_a_key():
    golay, rng = Golay(), random.Random(2)
    for _ in range(500):
        x = rng.getrandbits(64)
        y = x ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64)
        place, keys = fuzzy_dedup.keys_of(np.array([x, y], np.uint64), golay)
        assert set(keys[place == 0]) & set(keys[place == 1])


def corpus(seed):
    rng = random.Random(seed)
    texts = [None, "", " \n\t", "One", "one", "two words", "Two\x0bWords", "É b c", "é b c", "a b c", "a b c d", "a b c d"]
    for _ in range(25):
        words = [f"w{rng.randint(0, 300)}" for _ in range(rng.randint(3, 200))]
        for _ in range(rng.randint(1, 6)):
            texts.append(" ".join(words))
            words = list(words)
            words[rng.randrange(len(words))] = f"x{rng.randint(0, 9)}"
    return [*texts, *texts[20:24], texts[-1]]


@pytest.mark.parametrize("small", [2, 8])
def test_against_all_pairs(spark, monkeypatch, small):
    monkeypatch.setattr(fuzzy_dedup, "SMALL", small)
    monkeypatch.setattr(fuzzy_dedup, "_SLICE", 100)
    texts = corpus(small)
    fps = [plain_fingerprint(t) for t in texts]
    rows = [(i, t, "k", 7, [1]) for i, t in enumerate(texts)]
    got = fuzzy_dedup.decide(spark.createDataFrame(rows, "doc_id long, text string, fp string, key int, fps array<int>")).collect()
    assert sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == [(i, f"{f:016x}", r) for (i, f), r in zip(enumerate(fps), roots(fps), strict=True)]
    assert len({r["component_id"] for r in got}) < len(set(fps))


@pytest.mark.parametrize("small", [2, 8, 64])
def test_crowded_links(spark, monkeypatch, small):
    """Chains and clouds of fingerprints around a few centers, so that most buckets are large."""
    monkeypatch.setattr(fuzzy_dedup, "SMALL", small)
    rng = random.Random(3)
    values = {0, (1 << 64) - 1, 1 << 63}
    for _ in range(3):
        at = rng.getrandbits(64)
        for _ in range(60):
            values.add(at)
            at ^= 1 << rng.randrange(0, 64, 1 + rng.randrange(3)) ^ (1 << rng.randrange(64) if rng.random() < 0.6 else 0)
        values |= {at ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for _ in range(60)}
    values = sorted(values)
    links = fuzzy_dedup.links(spark.createDataFrame([(signed(v),) for v in values], "fp long")).collect()
    assert all(bin((r["a"] ^ r["b"]) & (1 << 64) - 1).count("1") <= 2 for r in links)
    place = {signed(v): i for i, v in enumerate(values)}
    parent = list(range(len(values)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for r in links:
        a, b = sorted((root(place[r["a"]]), root(place[r["b"]])))
        parent[b] = a
    assert [root(i) for i in range(len(values))] == roots(values)


def test_odd_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert fuzzy_dedup.decide(docs).collect() == []
    docs = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (None, "lone words of no id at all"), (3, None)], docs.schema)
    got = sorted(((r["doc_id"], r["component_id"]) for r in fuzzy_dedup.decide(docs).collect()), key=str)
    assert got == [(3, 3), (5, 5), (5, 5), (None, 5), (None, None)]


def test_a_very_long_text(spark):
    rng = random.Random(9)
    text = " ".join(f"w{rng.randint(0, 99999)}" for _ in range(400_000))
    docs = spark.createDataFrame([(1, text), (2, text + " end"), (3, "x" * 3_000_000)], "doc_id long, text string")
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in fuzzy_dedup.decide(docs).collect()}
    assert got[1][0] == f"{plain_fingerprint(text):016x}" and got[2][1] == 1 and got[3] == (f"{xxhash.xxh64_intdigest(b'x' * 3_000_000, 42):016x}", 3)
