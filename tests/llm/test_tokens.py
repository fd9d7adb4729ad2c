import hashlib
import random
import struct
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from vocalith.llm import byte_bpe, packing

RANKS = P.path("byte_bpe_50k.tiktoken")
TEXTS = [None, "", " ", "a", "Hello world, it's   12345 tests!\n\n  next", "aaaaaaaaaaaaaaa" * 40, "é漢字 　\x85x\x1cy  ", "<|endoftext|> plain", "don't 'S", "ab" * 3000, "x" * 70 + " " * 200 + "\n" * 70 + "qwfp" * 50, "🙂🙃" * 30]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)] + [(0, texts[0], "x", 1), (None, "null id", None, None)], "doc_id long, text string, ids string, task int")


def test_bpe_equals_the_library(spark):
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})
    rng = random.Random(5)
    texts = TEXTS + ["".join(map(chr, range(256))) * 3] + ["".join(rng.choice("abcdeft '\n.,;0é") for _ in range(rng.randint(1, 300))) for _ in range(200)]
    docs = frame(spark, texts)
    got = {r["doc_id"]: r for r in byte_bpe.round_trip(docs, RANKS, P.PATTERN).collect()}
    assert len(got) == len(texts) + 1
    for i, t in enumerate(texts):
        ids = library.encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(ids), t
        assert got[i]["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    coded = byte_bpe.encode(docs, RANKS, P.PATTERN)
    back = {r["doc_id"]: bytes(r["bytes"]).decode() for r in byte_bpe.decode(coded, RANKS, P.PATTERN).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(texts))


def test_bpe_of_long_words():
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})
    rng = random.Random(6)
    coder = byte_bpe.Coder(RANKS, P.PATTERN)
    texts = ["".join(rng.choice(letters) for _ in range(n)) for n in (127, 128, 129, 192, 193, 5000) for letters in ("ab", "abcdefghijklmnopqrstuvwxyz", "éñü", "=-", "\x00 ")]
    texts += [x * n for x in ("a", "o", "=", "-", " ", "\n", "é", "abc", "lol", "ha", "漢字", "🙂") for n in (63, 500, 2001)]
    texts.append("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200_000)))
    for text, ids in zip(texts, coder.encode(texts), strict=True):
        assert ids.tolist() == library.encode_ordinary(text), (text[:20], len(text))
        assert coder.decode([ids]) == [text.encode()]


def test_bpe_store_is_bounded(monkeypatch):
    monkeypatch.setattr(byte_bpe, "KEPT_BYTES", 3000)
    coder = byte_bpe.Coder(RANKS, P.PATTERN)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})
    for k in range(200):
        text = f"same words and {k} word{k}x"
        assert next(coder.encode([text])).tolist() == library.encode_ordinary(text)
        assert len(coder.store) + len(coder.older) < 60


def test_bpe_of_an_empty_table(spark):
    assert byte_bpe.round_trip(frame(spark, TEXTS).limit(0), RANKS, P.PATTERN).collect() == []


def check_packing(rows, expected, capacity=2048):
    got = defaultdict(list)
    for r in rows:
        got[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in got.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == Counter(expected)
    return len(got)


def test_ids_of_chunks_are_those_of_the_text():
    whole = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rng = random.Random(8)
    signs = "abcéñüßÉÀÇŁİıſĸŉǅΣσςдЖ漢ﬁ'’e\u0301²½Ⅷ١0129.,!?;:$%&*#|()-\"<>@/_~`+ \t\n\xa0\u2003\x1c"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(1, 60))) for _ in range(3000)] + ["don't I'll ''s x's. it'S", "ΟΔΟΣ ΣΑΣ.", "<|endoftext|>"]
    texts += [f"{chr(c)}a{chr(c)}, {chr(c)}" for c in range(1, 0x250)]
    tokens = packing.Tokens(P.path("word_bpe_49k.json"))
    assert tokens.encode("a <|endoftext|> b") == struct.pack("<3I", 320, 49407, 321)
    texts += ["a <|endoftext|> b", "a<|endoftext|>b.", "<|startoftext|><|endoftext|>!!", "<|ENDOFTEXT|> <|endoftext|", "word, <|endoftext|>. Word"]
    for text, ids in zip(texts, map(tokens.encode, texts), strict=True):
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == whole.encode(text, add_special_tokens=False).ids, repr(text)


def test_chunks_that_are_kept_are_bounded(monkeypatch):
    monkeypatch.setattr(packing, "KEPT_BYTES", 3000)
    tokens, whole = packing.Tokens(P.path("word_bpe_49k.json")), Tokenizer.from_file(P.path("word_bpe_49k.json"))
    for k in range(200):
        text = f"Same words, and word{k}x eñe{chr(97 + k % 26)}!?"
        assert list(struct.unpack(f"<{len(ids := tokens.encode(text)) // 4}I", ids)) == whole.encode(text, add_special_tokens=False).ids
        assert len(tokens) + len(tokens.older) < 60


def test_packing_whole_documents(spark):
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rng = random.Random(3)
    texts = TEXTS + [" ".join(rng.choice(["Word", "tiny", "eñe", "x,y", "12"]) for _ in range(rng.randint(1, 900))) for _ in range(80)] + ["long " * 9000]
    expected = []
    docs = frame(spark, texts)
    for r in docs.collect():
        ids = [*t.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        for k, s in enumerate(range(0, len(ids), 2048)):
            part = ids[s : s + 2048]
            expected.append((r["doc_id"], k, s, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    rows = packing.pack(docs, P.path("word_bpe_49k.json")).collect()
    n = check_packing(rows, expected)
    assert n <= -(-sum(e[3] for e in expected) // 2048) + 1
    assert packing.pack(docs.limit(0), P.path("word_bpe_49k.json")).collect() == []


def optimum(sizes, capacity):
    best = len(sizes)

    def go(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(sizes):
            best = len(rooms)
            return
        for i in range(len(rooms)):
            if rooms[i] >= sizes[k] and rooms[i] not in rooms[:i]:
                rooms[i] -= sizes[k]
                go(k + 1, rooms)
                rooms[i] += sizes[k]
        go(k + 1, [*rooms, capacity - sizes[k]])
        rooms[len(rooms) :] = []

    go(0, [])
    return best


@pytest.mark.parametrize("seed", range(60))
def test_reduction_never_costs_a_sequence(seed):
    rng = random.Random(seed)
    capacity = 20
    sizes = sorted((rng.randint(3, 20) for _ in range(9)), reverse=True)
    plan = packing.Plan(Counter(sizes), capacity)
    # what the reduction fixed can be completed to an optimal packing
    contents = unfold(plan, Counter(sizes))
    rest = Counter(sizes)
    for s in range(plan.reduced):
        rest -= Counter(contents[s])
    assert plan.reduced + optimum(sorted(rest.elements(), reverse=True), capacity) == optimum(sizes, capacity)
    assert all(sum(c) <= capacity for c in contents.values())


def unfold(plan, counts):
    contents = defaultdict(list)
    starts = defaultdict(list)
    for row in plan.rows:
        starts[row[0]].append(row)
    for length, rows in starts.items():
        rows.sort(key=lambda r: r[1])
        for nth in range(counts[length]):
            _, first, each, sequence, _ = [r for r in rows if r[1] <= nth][-1]
            contents[sequence + (nth - first) // each].append(length)
    return contents


def test_domination_against_all_sets():
    rng = random.Random(1)
    capacity = 24
    found = 0
    for _ in range(400):
        counts = Counter(rng.randint(3, 24) for _ in range(7))
        longest = max(counts)
        best = packing.dominating(counts, longest, capacity)
        if best is None:
            continue
        found += 1
        rest = list((counts - Counter([longest])).elements())
        own = list(best[1:])
        assert sum(best) <= capacity and not Counter(best) - counts
        for k in range(len(rest) + 1):
            for other in combinations(rest, k):
                if sum(other) <= capacity - longest:
                    assert covers(own, sorted(other, reverse=True)), (counts, best, other)
    assert found > 100


def covers(rooms, items):
    if not items:
        return True
    for i, r in enumerate(rooms):
        if r >= items[0] and covers([*rooms[:i], r - items[0], *rooms[i + 1 :]], items[1:]):
            return True
    return False
