"""Periodic runs against a search over all stretches."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from vocalith.llm import periodic_runs as pr


def smallest_period(words):
    return next(q for q in range(1, len(words) + 1) if words[q:] == words[: len(words) - q])


def plain_runs(words):
    """By the definition: every stretch, its smallest period, and whether a neighbour extends it."""
    n, out = len(words), set()
    for i in range(n):
        for j in range(i + 6, n + 1):
            # of stretches from i the one that can't be extended to the right, for each period
            q = smallest_period(words[i:j])
            if j - i >= max(6, 4 * q) and not (i and words[i - 1] == words[i - 1 + q]) and not (j < n and words[j] == words[j - q]):
                out.add((i, j - i, q))
    return sorted(out)


def plain(doc_id, text, planted=True):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if planted and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + length for s, length, q in runs)]
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in sorted(runs, key=lambda r: (r[0], r[2])))
    return (doc_id, len(runs), *best, best[1] and best[1] * 1000 // best[2], sha(listed), sha(" ".join(kept)))


def texts(seed, count):
    rng = random.Random(seed)
    for _ in range(count):
        letters = "abcdefgh"[: rng.randint(1, 8)]
        words = []
        for _ in range(rng.randint(0, 5)):
            block = [rng.choice(letters) for _ in range(rng.randint(1, 6))]
            words += (block * rng.randint(1, 9))[: rng.randint(1, 40)]
        yield words


def test_scan_finds_all_runs():
    found = 0
    for words in texts(1, 400):
        runs = pr.scan(pr._ids([w.encode() for w in words]))
        assert sorted(runs) == plain_runs(words)
        found += len(runs)
    assert found > 300


@pytest.mark.parametrize("cells", [1, 7, 1 << 20])
def test_ranges_of_lags_together_are_all_lags(monkeypatch, cells):
    monkeypatch.setattr(pr, "_CELLS", cells)
    for words in texts(2, 60):
        ids = pr._ids([w.encode() for w in words])
        apart = [r for low in range(1, len(ids) // 4 + 2, 3) for r in pr.scan(ids, low, low + 3)]
        assert sorted(apart) == sorted(pr.scan(ids)) == plain_runs(words)


def test_long_periods_are_found():
    rng = np.random.default_rng(3)
    for n, q, at, times in ((5000, 700, 900, 4.0), (5000, 701, 13, 5.5), (3000, 97, 1500, 4.01), (3000, 97, 1500, 3.99)):
        ids = rng.integers(0, 50, n).astype(np.int32)
        length = int(q * times)
        ids[at : at + length] = np.resize(ids[at : at + q], length)
        ids[at - 1], ids[at + length] = 1000, 1001
        assert [r for r in pr.scan(ids) if r[2] == q] == ([(at, length, q)] if times >= 4 else [])


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("long_", [1 << 18, 40])
def test_against_brute_force(spark, monkeypatch, long_):
    """With short texts scanned in one go, and with nearly all in ranges of lags."""
    monkeypatch.setattr(pr, "LONG", long_)
    monkeypatch.setattr(pr, "WORK", 100)
    given = [" ".join(w) for w in texts(4, 150)]
    given += [None, "", "  \n", "a\tb\x0ba\x0cb\ra\nb a b", "           ", "é é é é é é é", "A a A a A a A a", given[20], given[20]]
    docs = spark.createDataFrame([(i, t, 5, "x") for i, t in enumerate(given)], "doc_id long, text string, start int, row string")
    want = sorted((plain(i, t) for i, t in enumerate(given)), key=str)
    got = pr.detect(docs, change=pr.repeated_by_id)
    assert got.columns == "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()
    assert rows_of(got) == want
    assert rows_of(pr.detect(docs)) == sorted((plain(i, t, False) for i, t in enumerate(given)), key=str)


def test_odd_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pr.detect(docs, change=pr.repeated_by_id).collect() == []
    again = [(None, "a a a a a a"), (None, None), (4, "b b b b b b b"), (4, "b b b b b b b")]
    got = rows_of(pr.detect(spark.createDataFrame(again, docs.schema)))
    assert [r[:5] for r in got] == sorted([(None, 1, 0, 6, 1), (None, 0, None, None, None), (4, 1, 0, 7, 1), (4, 1, 0, 7, 1)], key=str)


def test_very_long_texts(spark):
    rng = random.Random(6)
    body = [f"w{rng.randint(0, 2000)}" for _ in range(150_000)]
    block = body[500:30_500]
    planted = body[:1000] + ["start"] + block * 4 + ["end"] + body[1000:]
    docs = spark.createDataFrame([(1, " ".join(body)), (2, " ".join(planted)), (3, "same " * 60_000)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pr.detect(docs).collect()}
    assert got[1]["n_runs"] == 0
    assert (got[2]["n_runs"], got[2]["start"], got[2]["length"], got[2]["period"], got[2]["exponent_milli"]) == (1, 1001, 120_000, 30_000, 4000)
    assert (got[3]["start"], got[3]["length"], got[3]["period"], got[3]["exponent_milli"]) == (0, 60_000, 1, 60_000_000)
    assert got[3]["collapsed_sha256"] == hashlib.sha256(b"same").hexdigest()
