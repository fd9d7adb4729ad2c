"""Integer product codes against a plain loop over Python's integers."""

import hashlib
import math
import random
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from vocalith.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows):
    """vec_id, code, error, label_error, hash of the codebooks."""
    fine = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    fine.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    fine = [r for r in fine if len(r[1]) == len(fine[0][1])]
    if not fine:
        return []
    n = len(fine[0][1])
    cut = [n // 8 * k + min(k, n % 8) for k in range(9)]
    vectors = [[math.floor(Fraction(x) * 4096) for x in r[1]] for r in fine]
    parts = [[v[a:b] for a, b in zip(cut, cut[1:])] for v in vectors]
    books = [[p[k] for p in parts[:16]] for k in range(8)]

    def assign():
        return [[min((sum((x - y) ** 2 for x, y in zip(p[k], c)), e) for e, c in enumerate(books[k])) for k in range(8)] for p in parts]

    for _ in range(6):
        found = assign()
        for k in range(8):
            for e in range(len(books[k])):
                mine = [p[k] for p, f in zip(parts, found) if f[k][1] == e]
                if mine:
                    books[k][e] = [sum(xs) // len(mine) for xs in zip(*mine)]
    found = assign()
    most = (1 << 63) - 1
    errors = [min(most, sum(d for d, _ in f)) for f in found]
    by = {}
    for r, e in zip(fine, errors):
        by[r[2]] = by.get(r[2], 0) + e
    sha = hashlib.sha256(",".join(str(x) for part in books for c in part for x in c).encode()).hexdigest()
    return [(r[0], "".join(f"{e:02x}" for _, e in f), x, min(most, by[r[2]]), sha) for r, f, x in zip(fine, found, errors)]


def got(spark, rows, schema=SCHEMA):
    return [tuple(r) for r in vc.encode(spark.createDataFrame(rows, schema)).collect()]


def order(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("length", [16, 21, 5])
def test_against_plain_loops(spark, length):
    rng = random.Random(length)
    rows = [(i, [rng.gauss(0, 0.01 if i % 3 else 1) for _ in range(length)], rng.choice([None, 1, 2])) for i in rng.sample(range(1000), 150)]
    # ties: few different values, and equal rows
    rows += [(2000 + i, [rng.choice([0.0, 0.25, -0.25]) for _ in range(length)], 3) for i in range(80)]
    rows += [(None, [0.5] * length, 1), (7777, None, 1), (7778, [None] * length, 1), (7779, [math.nan] * length, 1), (7780, [math.inf] + [0.0] * (length - 1), 1), (7781, [], 1), (7782, [1.0], 1), rows[-1]]
    assert order(got(spark, rows)) == order(brute(rows))


def test_few_rows_and_empty_tables(spark):
    rows = [(3, [1.0] * 8, 1), (1, [-1.0] * 8, 1), (2, [1.0] * 8, None)]
    assert order(got(spark, rows)) == order(brute(rows))
    assert got(spark, []) == [] and got(spark, [(1, None, 2)]) == []


def test_huge_components(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice([1e300, -1e300, 1e18, 3e9, 2.5, 0.0, 1e5]) * rng.random() for _ in range(8)], i % 2) for i in range(60)]
    assert order(got(spark, rows)) == order(brute(rows))
    rows = [(i, [rng.uniform(-1e9, 1e9) for _ in range(16)], i % 2) for i in range(60)]
    assert order(got(spark, rows)) == order(brute(rows))


def test_clashing_columns(spark):
    rows = [(i, [float(i % 7)] * 8, i % 3, "x", 1) for i in range(40)]
    mine = got(spark, rows, f"{SCHEMA}, code string, `of` int")
    assert order(mine) == order(brute([r[:3] for r in rows]))


def test_screening_keeps_the_nearest():
    """Intervals hold the exact value even where single precision can't tell entries apart."""
    rng = np.random.default_rng(4)
    for scale, n in ((1, 8), (1 << 12, 8), (1 << 20, 64), (1 << 28, 300), (1 << 40, 3)):
        c = rng.integers(-scale, scale + 1, (16, n))
        c[5:8] = c[4] + rng.integers(-1, 2, (3, n))
        c[9] = c[8]
        x = np.concatenate([rng.integers(-scale, scale + 1, (200, n)), c[4:10] + rng.integers(-1, 2, (6, n))])
        distances = [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, q)) for q in c] for p in x]
        assert vc.nearest(x, c).tolist() == [min(range(16), key=lambda e, d=d: (d[e], e)) for d in distances]
    assert vc._screened(rng.integers(-4096, 4096, (500, 8)), rng.integers(-4096, 4096, (16, 8))).sum() < 520


def test_sql_has_the_same_rows(spark):
    path = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/embeddings.parquet'")
    mine = vc.op12_vector_codes(spark, path)
    theirs = db.execute(vc.SQL)
    assert [d[0] for d in theirs.description] == mine.columns
    assert order(tuple(r) for r in mine.collect()) == order(theirs.fetchall())
