from collections import defaultdict

import corpus_pipeline
from vocalith.llm import near_dedup, secrets
from vocalith.llm.exact_dedup import deduplicate
from vocalith.llm.registry import QUERIES

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    at, seen = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, at, SF)
        assert after.columns == docs.columns, name
        after = spark.createDataFrame(after.collect(), docs.schema)
        seen.append({r["doc_id"]: r for r in after.collect()})
        at = after
    good, unique, far, clean = seen
    assert set(unique) <= set(good) and set(far) <= set(unique)
    # one of each component of the documents before
    sets = {i: set(near_dedup.shingle_sets([r["text"]])[0].tolist()) for i, r in unique.items()}
    near = defaultdict(set)
    for i in sets:
        for j in sets:
            if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                near[i].add(j)
                near[j].add(i)
    left, components = set(unique), 0
    while left:
        todo, members = [left.pop()], set()
        while todo:
            i = todo.pop()
            members.add(i)
            todo += near[i] & left
            left -= near[i]
        components += 1
        assert len(members & set(far)) == 1 and min(members) in far
    assert components == len(far) == len(clean)
    assert not any(secrets.base_spans(r["text"]) for r in clean.values())
    assert all(clean[i]["text"] == far[i]["text"] for i in far if not secrets.base_spans(far[i]["text"]))
    pieces = corpus_pipeline.packed(spark, at, SF).collect()
    assert {r["doc_id"] for r in pieces} == set(clean)


def test_rejected_documents(spark):
    """The smallest tables have eleven bad labels; these have enough to learn from."""
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    kept = {r["doc_id"] for r in corpus_pipeline.good_quality(spark, docs, sf).select("doc_id").collect()}
    of = {r["doc_id"]: r["quality"] for r in labels.collect()}
    good, bad = ({i for i, q in of.items() if q == x} for x in (1, 0))
    assert len(good - kept) <= 0.01 * len(good) and len(bad & kept) <= 0.1 * len(bad)


def test_odd_rows_pass_all_stages(spark):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (3, "word " * 5000, None, "s", -1), (4, "a password=hunter22", "en", None, 3)], "doc_id long, text string, lang string, source string, n_chars long")
    for some in (docs, docs.limit(0)):
        at = some
        for _, stage in corpus_pipeline.STAGES:
            at = spark.createDataFrame((df := stage(spark, at, SF)).collect(), df.schema)
        # the empty texts are one document; 5001 ids make three pieces
        assert sorted((r["doc_id"], r["piece"]) for r in at.collect()) == ([(1, 0), (3, 0), (3, 1), (3, 2), (4, 0)] if some is docs else [])


def test_queries_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert deduplicate
