import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vocalith.llm import neighbours


def brute(rows, every=50, k=5):
    """query -> for each row of that id [(vec_id, score)]"""
    good = [(i, np.array(v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for p, (q, a) in enumerate(good):
        if q % every == 0:
            near = [(-float((a * b).sum() / (np.sqrt((b * b).sum()) * np.sqrt((a * a).sum()))), i) for r, (i, b) in enumerate(good) if r != p and len(b) == len(a)]
            out.setdefault(q, []).append([(i, -s) for s, i in sorted(near)[:k]])
    return out


@pytest.mark.parametrize("block", [8192, 300])
def test_recall_and_scores(spark, monkeypatch, block):
    monkeypatch.setattr(neighbours, "BLOCK", block)
    rng = np.random.default_rng(4)
    hot = rng.standard_normal(16).astype(np.float32)
    rows = [(i, [float(x) for x in (hot if i % 3 == 0 else rng.standard_normal(16).astype(np.float32))]) for i in range(1200)]
    rows += [(None, rows[0][1]), (2001, None), (2002, [0.0] * 16), (2003, [float("nan")] * 16), (2004, [None, *rows[1][1][1:]]), (2050, [1.0, 2.0]), (2051, [1.0, 2.5]), (2100, []), (7, rows[7][1]), (2150, [math.inf] * 16), (2051, [1.0, 2.5])]
    table = spark.createDataFrame([(i, v, 3) for i, v in rows], "vec_id long, embedding array<float>, ids int")
    got = {}
    for r in neighbours.search(table).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = brute(rows)
    assert set(got) == {q for q, near in want.items() if near[0]}
    found = total = 0
    for q, (near,) in want.items():
        mine = sorted(got.get(q, []))
        assert [r for r, *_ in mine] == list(range(1, len(near) + 1))
        assert [(-s, i) for _, i, s in mine] == sorted((-s, i) for _, i, s in mine)
        truth = dict(near)
        found += sum(i in truth for _, i, _ in mine)
        total += len(near)
        for _, i, s in mine:
            if i in truth:
                assert abs(truth[i] - s) < 1e-12
    assert found >= 0.9 * total
    assert [i for _, i, _ in sorted(got[0])] == [3, 6, 9, 12, 15] and [i for _, i, _ in sorted(got[2050])] == [2051, 2051]


def test_rows_that_share_an_id(spark):
    """Each takes part: as a candidate, of its like too, and as a query."""
    rows = [(50, [1.0, 0.0]), (50, [1.0, 0.1]), (7, [1.0, 0.2]), (7, [1.0, 0.2])]
    got = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    want = [(q, n + 1, i, s) for q, lists in brute(rows).items() for near in lists for n, (i, s) in enumerate(near)]
    for mine, true in zip(sorted(map(tuple, got)), sorted(want), strict=True):
        assert mine[:3] == true[:3] and abs(mine[3] - true[3]) < 1e-12


def test_levels_are_sought_over_all_blocks(spark, monkeypatch):
    """Clustered vectors: a query looks at few rows, wherever its cluster lies, and finds its neighbours."""
    monkeypatch.setattr(neighbours, "BLOCK", 500)
    rng = np.random.default_rng(6)
    centers = rng.standard_normal((100, 24))
    rows = [(i, [float(x) for x in centers[i % 97] + 0.1 * rng.standard_normal(24)]) for i in range(3000)]
    index = neighbours.Index(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert index.blocks.count() == 6 and index.explain()[24] < 0.1
    want, found = brute(rows), 0
    got = index.search(F.col("vec_id") % 50 == 0).collect()
    for r in got:
        found += r["vec_id"] in dict(want[r["query_id"]][0])
    assert len(got) == 300 and found >= 270


def test_few_and_none(spark):
    few = spark.createDataFrame([(50, [1.0, 0.0]), (51, [1.0, 1.0]), (100, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in neighbours.search(few).collect()) == [(50, 1, 51), (50, 2, 100), (100, 1, 51), (100, 2, 50)]
    assert neighbours.search(few.limit(0)).collect() == []
    assert neighbours.search(few.where("vec_id = 50")).collect() == []


def test_levels_are_longest_common_prefixes():
    rng = np.random.default_rng(2)
    vectors = rng.standard_normal((200, 8))
    forest = neighbours.Forest(np.arange(200), vectors, np.zeros(neighbours.TREES * neighbours.BITS))
    keys = forest.keys(forest.unit).astype(np.int64)
    levels = neighbours.level_of(forest.counts(forest.keys(forest.unit[:20])), 100)
    for q, at in enumerate(forest.held(forest.keys(forest.unit[:20]), levels)):
        common = [[neighbours.BITS - int(a ^ b).bit_length() for a, b in zip(keys[q], row, strict=True)] for row in keys]
        level = max(x for x in range(neighbours.BITS + 1) if sum(c >= x for row in common for c in row) >= 100)
        assert level == levels[q] and set(at) == {i for i, row in enumerate(common) if max(row) >= level}
