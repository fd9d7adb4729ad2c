import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from vocalith.llm import exact_dedup, licences, sharding

RNG = random.Random(12)


# exact deduplication


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


@pytest.fixture(scope="module")
def copies(spark):
    rows = [(i, RNG.choice(["a b", "a  b", "a\tb", "a\n\x0b\x0c\r b", " a b", "", None, "é", "a\xa0b"]), i) for i in range(300)]
    rows += [(i, f"text {RNG.randint(0, 80)} of{' ' * RNG.randint(1, 3)}many", i) for i in range(300, 700)] + [(700, "long " * 50_000, 0), (701, "long  " * 50_000, 0)]
    rows += [(3, "a b", 0), (3, "a b", 0), (None, "a b", 1), (None, "only null ids", 1), (None, "only  null ids", 2)]
    RNG.shuffle(rows)
    return rows, spark.createDataFrame(rows, "doc_id long, text string, digest int")


def test_exact_decisions(copies):
    rows, docs = copies
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[normal(t)].append(i)
    got = exact_dedup.decide(docs).collect()
    assert len(got) == len(rows)
    kept = defaultdict(int)
    by_hash = {hashlib.sha256(k.encode()).hexdigest(): k for k in groups}
    for r in got:
        ids = groups[by_hash[r["text_sha256"]]]
        assert r["keep_id"] == min((i for i in ids if i is not None), default=None)
        assert r["group_size"] == len(ids)
        kept[r["text_sha256"]] += r["kept"]
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    assert set(kept.values()) == {1} and len(kept) == len(groups)


def test_exact_kept_rows(copies):
    rows, docs = copies
    got = exact_dedup.deduplicate(docs)
    assert got.columns == docs.columns
    best = {}
    for i, t, _ in rows:
        key = normal(t)
        best[key] = min(best.get(key, 1 << 62), 1 << 62 if i is None else i)
    assert sorted((normal(r["text"]), 1 << 62 if r["doc_id"] is None else r["doc_id"]) for r in got.collect()) == sorted(best.items())
    assert exact_dedup.decide(docs.limit(0)).count() == exact_dedup.deduplicate(docs.limit(0)).count() == 0


def test_split_changes_nothing(copies, monkeypatch):
    _, docs = copies
    of = lambda: sorted(map(str, exact_dedup.decide(docs).select("doc_id", "keep_id", "group_size", "text_sha256").collect()))
    before = of()
    monkeypatch.setattr(exact_dedup, "TRACKED", 2)
    assert of() == before


# sharding


def jump(key, n):
    key, b, j = key % (1 << 64), -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int(float(b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_shards(spark):
    rows = [(i * 7, f"text é {i}") for i in range(500)] + [(None, "x"), (5, None), (-3, ""), (1 << 62, "🙂"), (-(1 << 63), "y" * 200_000)] + [(77, "hot")] * 250
    docs = spark.createDataFrame([(i, t, 9) for i, t in rows], "doc_id long, text string, shard int")
    got = sharding.shard(docs).collect()
    assert len(got) == len(rows)
    expected = sorted((-1 if i is None else i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), jump(i or 0, 24), jump(i or 0, 25)) for i, t in rows)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["grown_shard"]) for r in got) == expected
    assert all(r["grown_shard"] in (r["shard"], 24) and r["law"] == "key" for r in got)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard(docs.limit(0)).collect() == []


# licences


def brute(text):
    text = text or ""
    units = text.split("\n")
    if len(paragraphs := re.split(r"\n[\x20\t\r]*\n", text)) > 1:
        units = units + paragraphs
    if "\n" in text:
        units = [*units, text]
    found = []
    for unit in units:
        grams = licences.bigrams(unit)
        for name, texts in licences.TEMPLATES.items():
            for t in texts:
                other = licences.bigrams(t)
                if grams and 2 * len(grams & other) / (len(grams) + len(other)) >= 0.8:
                    found.append((2 * len(grams & other) / (len(grams) + len(other)), name))
    best = max(found, key=lambda x: x[0])[0] if found else None
    return len(found), min((n for d, n in found if d == best), default=None), best, ",".join(sorted({n for _, n in found}))


def test_licences(spark):
    mit = licences.NOTICES["MIT"][-1]
    words = mit.split()
    texts = [None, "", "x", "prose\nReleased under the MIT License.", "Licensed under CC BY-NC 4.0.\nLicensed under CC BY 4.0", "LICENSED   under the apache-license, version 2.0!", mit, "Title\n\n" + "\n".join(" ".join(words[i : i + 9]) for i in range(0, len(words), 9)) + "\n\nafter", " ".join(words[:60]), mit.replace("SOFTWARE", "WORK"), "word " * 60_000, "a b\n" * 3000]
    texts += ["\n".join(RNG.choice([*sum(licences.NOTICES.values(), []), "some other line", "the License."]) for _ in range(RNG.randint(1, 5))) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)] + [(3, texts[3], "z"), (None, texts[3], "z")], "doc_id long, text string, name string")
    got = licences.scan(docs).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        expected = brute(texts[3 if r["doc_id"] is None else r["doc_id"]])
        assert (r["n_matches"], r["license"], r["licenses"]) == (expected[0], expected[1], expected[3]), (r, expected)
        assert r["dice"] == expected[2]
    assert licences.scan(docs.limit(0)).collect() == []


def test_licences_in_running_text(spark):
    """Licences over several paragraphs or amid a line, inside long documents."""
    mit = licences.NOTICES["MIT"][-1]
    cut = [mit.index("The above"), mit.index("THE SOFTWARE IS")]
    three = "\n\n".join([mit[: cut[0]], mit[cut[0] : cut[1]], mit[cut[1] :]])
    prose = lambda n: " ".join(f"word{i}" for i in range(n))
    notice = "This work is licensed under the GNU General\nPublic License, version 3."
    texts = [f"{prose(200)}\n\n{three}\n\n{prose(90)}", f"{prose(300)} {notice} {prose(40)}", f"{prose(50)} Released under the MIT License. {prose(50)}"]
    texts += [f"{prose(200)}\n\n{mit[: cut[0]]}\n\n{prose(90)}", f"{prose(20)} released under the older licence {prose(20)}", f"{prose(9)}\n\n{three.replace('copyright', 'x')}\n\n{prose(400)}"]
    texts += [f"{prose(RNG.randint(0, 9))} {' '.join(w for w in mit.split() if RNG.random() > share)} {prose(200)}" for share in (0.02, 0.05, 0.08, 0.1) for _ in range(3)]

    def windows(text):
        """All of them, without pruning."""
        words, found = licences._words(text), {}
        pairs = [f"{a} {b}" for a, b in zip(words, words[1:])]
        for name, templates in licences.TEMPLATES.items():
            for t in templates:
                other, span = licences.bigrams(t), len(licences._words(t)) - 1
                for s in range(len(pairs) - span + 1):
                    grams = set(pairs[s : s + span])
                    if (dice := 2 * len(grams & other) / (len(grams) + len(other))) >= 0.8:
                        found[name] = max(found.get(name, 0), dice)
        return found

    got = {r["doc_id"]: r for r in licences.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i]["licenses"] for i in (0, 2, 3, 4, 5)] == ["MIT", "MIT", "", "", "MIT"] and "GPL-3.0" in got[1]["licenses"]
    assert got[0]["dice"] == got[1]["dice"] == 1 and got[1]["license"] == "GPL-3.0"
    for i, text in enumerate(texts):
        assert brute(text)[0] == 0
        new = windows(text)
        assert got[i]["licenses"] == ",".join(sorted(new)), i
        assert got[i]["n_matches"] == len(new), i
        assert got[i]["dice"] == max(new.values(), default=None), i
    # a line that bears one licence isn't a worse copy of another, and hides no other place
    agpl = licences.NOTICES["AGPL-3.0"][0]
    pair = [f"{prose(30)}\n{agpl}\n{prose(30)}", f"{prose(30)}\n{agpl}\n{prose(30)} {licences.NOTICES['MPL-2.0'][0]} {prose(30)}"]
    one, both = sorted(licences.scan(spark.createDataFrame(list(enumerate(pair)), "doc_id long, text string")).collect())
    assert one["licenses"] == brute(pair[0])[3] and both["licenses"] == ",".join(sorted([*one["licenses"].split(","), "MPL-2.0"]))


def test_whole_licence_texts(spark):
    """Files with a whole licence, as they come: with a copyright line, wrapped anew, inside a longer document, with some words lost."""
    whole = {name: texts[-1] for name, texts in licences.TEMPLATES.items() if len(texts[-1]) > 700}
    assert {"Apache-2.0", "BSD", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0", "Unlicense", "Zlib", "BSL-1.0"} <= whole.keys()
    prose = lambda n: " ".join(f"word{RNG.randint(0, 10**6)}" for _ in range(n))
    texts = []
    for name, text in whole.items():
        words = text.split()
        wrapped = "\n".join(" ".join(words[i : i + 14]) for i in range(0, len(words), 14))
        texts += [(name, text), (name, f"Copyright (c) 2024 The Someone\n\n{wrapped}"), (name, f"{prose(4000)}\n\n{text}\n\n{prose(5000)}"), (name, f"{prose(len(words))} {' '.join(w for w in words if RNG.random() > 0.03)} {prose(300)}")]
    texts += [("BSD", licences.TEMPLATES["BSD"][-2]), ("", prose(9000)), ("", " ".join(whole["GPL-3.0"].split()[:1500]))]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    for r in licences.scan(docs).collect():
        assert (r["license"] or "") == texts[r["doc_id"]][0], (r, texts[r["doc_id"]][1][:60])


def test_texts_without_an_anchor_have_no_match():
    """What the pattern passes over has none of a template's anchors, and every set that reaches the threshold has one."""
    pattern = re.compile(licences._any_of({a for texts in licences.TEMPLATES.values() for t in texts for a in licences.anchors(sorted(licences.bigrams(t)))}))
    for texts in licences.TEMPLATES.values():
        for t in texts:
            words = licences._words(t)
            for _ in range(20):
                some = [w for w in words if RNG.random() > 0.12]
                grams, other = licences.bigrams(" ".join(some)), licences.bigrams(t)
                if grams and 2 * len(grams & other) / (len(grams) + len(other)) >= 0.8:
                    assert pattern.search(f" {' '.join(some)} ")
    assert not pattern.search(" some words of no licence at all ")
