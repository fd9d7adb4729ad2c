import random
import re
from collections import defaultdict

import pytest

from vocalith.llm import common, near_dedup


def sets_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute(rows, percent):
    """component and set size by row index"""
    sets = [sets_of(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            x, y = sets[i], sets[j]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                parent[root(i)] = root(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(i)
    return sets, groups


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [None, "", " \t\n", "one", "One", "two words", "two  WORDS", "É a b c", "é a b c"]
    common = " ".join(rng.choice(vocabulary) for _ in range(60))
    for _ in range(40):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(5, 150))]
        texts.append(" ".join(words))
        for _ in range(rng.randint(0, 4)):
            copy = list(words)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
        if rng.random() < 0.5:
            texts.append(common + " " + " ".join(words[:30]))
    base = [rng.choice(vocabulary) for _ in range(300)]
    for i in range(60):  # a large group of near copies, as a chain too
        base = list(base)
        base[(7 * i) % 300] = f"x{i}"
        texts.append(" ".join(base))
    texts += [texts[10]] * 30
    rng.shuffle(texts)
    return [(i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("percent", [80, 85])
def test_against_all_pairs(spark, percent):
    rows = corpus(percent)
    got = {r["doc_id"]: r for r in near_dedup.decide(spark.createDataFrame(rows, "doc_id long, text string"), percent).collect()}
    sets, groups = brute(rows, percent)
    assert len(got) == len(rows)
    for members in groups.values():
        for i in members:
            assert got[i]["component_id"] == min(members), rows[i]
            assert got[i]["n_shingles"] == len(sets[i])
            assert got[i]["kept"] == (i == min(members))


def test_one_of_each_group_stays(spark):
    rows = corpus(3)
    rows += [rows[20], rows[20], (None, rows[21][1]), (None, "an id is missing here altogether"), (None, None)]
    docs = spark.createDataFrame([(i, t, 1, "o") for i, t in rows], "doc_id long, text string, row long, ord string")
    got = near_dedup.deduplicate(docs)
    assert got.columns == docs.columns
    kept = [(r["doc_id"], r["text"]) for r in got.collect()]
    sets, groups = brute(rows, 80)
    assert len(kept) == len(groups)
    of = {rows[i]: g for g, members in groups.items() for i in members}
    full = [k for k in kept if sets_of(k[1])]
    assert len({of[k] for k in full}) == len(full)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert near_dedup.decide(docs).collect() == []
    assert near_dedup.deduplicate(docs).collect() == []


def test_bounds_of_the_posterior():
    for n, least in near_dedup.least_matches(85, 192):
        # at a true similarity of the threshold the expected matches are far from the bound
        assert least < 0.85 * n
    assert 28 <= near_dedup.bands_for(85) <= 30


def test_parities_bound_the_difference():
    rng = random.Random(7)
    for _ in range(50):
        texts = [" ".join(str(rng.randint(0, 30)) for _ in range(rng.randint(1, 400))) for _ in range(2)]
        x, y = near_dedup.shingle_sets(texts)
        apart = sum(bin(int(a) & (1 << 64) - 1 ^ int(b) & (1 << 64) - 1).count("1") for a, b in zip(near_dedup._parities(x), near_dedup._parities(y), strict=True))
        assert apart <= len(set(x.tolist()) ^ set(y.tolist()))


def test_clashing_columns_and_long_texts(spark):
    rng = random.Random(17)
    words = [f"w{rng.randint(0, 9999)}" for _ in range(120_000)]
    edited = list(words)
    for _ in range(1000):
        edited[rng.randrange(len(edited))] = "edit"
    texts = [" ".join(words), " ".join(edited), " ".join(words[:60_000]), "x" * 300_000, "x" * 300_000 + " y"]
    docs = spark.createDataFrame([(i, t, i, "k", [1], 2, b"h") for i, t in enumerate(texts)], "doc_id long, text string, row int, key string, bands array<int>, n int, set_hash binary")
    got = {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in near_dedup.decide(docs).collect()}
    sets, groups = brute(list(enumerate(texts)), 80)
    assert got == {i: (min(g), len(sets[i])) for g in groups.values() for i in g}
    kept = near_dedup.deduplicate(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(min(g) for g in groups.values())


def test_sieve_holds_back_none_of_its_keys(spark, monkeypatch):
    monkeypatch.setattr(common.Sieve, "BITS", 12)
    some, others = spark.range(0, 3000, 7), spark.range(0, 3000)
    passed = {r["id"] for r in others.where(common.Sieve(some, "id").passes()).collect()}
    assert set(range(0, 3000, 7)) <= passed and len(passed) < 900
    assert others.where(common.Sieve(some.limit(0), "id").passes()).count() == 0


def test_spent_tables_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda _: str(tmp_path))
    rows = near_dedup.decide(spark.createDataFrame(corpus(5), "doc_id long, text string")).collect()
    # what the result reads is left
    assert rows and sorted(p.name.split("-")[0] for p in tmp_path.iterdir()) == ["known", "rows"]
