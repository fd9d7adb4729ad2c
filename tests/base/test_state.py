"""State of streams: whatever the batches, the rows are those of a plain loop over all of it."""

import random
from datetime import UTC, datetime, timedelta

import pytest

from vocalith.sources import tables
from vocalith.streaming import state

ZERO = datetime(2024, 1, 1, tzinfo=UTC)
END = ZERO + timedelta(days=30)
LATE = "3 hours"


def moment(second):
    return ZERO + timedelta(seconds=second)


def run(spark, tmp_path, rows, schema, slots, change):
    """rows: (slot, ...), a batch for each slot."""
    frame = spark.createDataFrame(rows, f"slot int, {schema}")
    files = tables.feed(frame, slots, f"{tmp_path}/in")
    out = change(tables.stream(spark, f"{tmp_path}/in", frame.drop("slot").schema, "parquet", files))
    state.started(out, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    return spark.read.schema(out.schema).parquet(f"{tmp_path}/out").collect()


def plain_answers(rows, live):
    """Outcomes over all rows (second, put, id, token) of one URL."""
    out, resumed = [], set()
    tasks = sorted((s, i, t) for s, put, i, t in rows if not put)
    for s, _, i, _ in sorted((r for r in rows if r[1]), key=lambda r: (r[0], r[2])):
        first = min((t for t in tasks if t[0] <= s <= t[0] + live), default=None)
        if first is None:
            out.append(("unmatched", None, None, i, s))
        else:
            again = first[1] in resumed
            resumed.add(first[1])
            out.append(("duplicate" if again else "resumed", first[1], None if again else first[2], i, s))
    return out + [("expired", i, t, None, s + live) for s, i, t in tasks if i not in resumed]


@pytest.mark.parametrize("slots", [1, 4])
def test_waits(spark, tmp_path, slots):
    """Out of order within the lateness, in one batch or several: first task, one resume a token, duplicates, expiry."""
    rng = random.Random(slots)
    rows, by = [], {}
    for n in range(240):
        url, second = f"u{rng.randint(0, 5)}", rng.randint(0, 40_000)
        row = (second, rng.random() < 0.5, f"i{n:03}", f"t{n}")
        by.setdefault(url, []).append(row)
        # up to 10,000 seconds late, which the lateness allows
        rows.append((min(slots - 1, max(0, (second + rng.randint(-5000, 5000)) * slots // 40_000)), url, moment(second), *row[1:]))
    rows += [(0, url, moment(5), put, i, "t") for url, put, i in (("", False, "x"), (None, True, "y"), ("u1", False, None))] + [(0, "u1", None, True, "z", None)]
    rows.append((slots, "end", END, True, "end", None))
    got = run(spark, tmp_path, rows, "url string, at timestamp, put boolean, id string, token string", slots + 1, lambda s: state.answers(s, 500, LATE))
    mine = sorted(((r["url"], r["outcome"], r["task_uuid"], r["token"], r["notification"], round(r["at"].replace(tzinfo=UTC).timestamp() - ZERO.timestamp())) for r in got), key=str)
    want = sorted(((url, *x) for url, rows in by.items() for x in plain_answers(rows, 500)), key=str)
    assert mine == want
    assert {r[1] for r in mine} == {"resumed", "duplicate", "unmatched", "expired"}
    tokens = [r[3] for r in mine if r[3]]
    assert len(tokens) == len(set(tokens)) == sum(not put for rows in by.values() for _, put, _, _ in rows)


def test_rows_later_than_allowed_are_dropped(spark, tmp_path):
    rows = [(0, "u", moment(0), False, "task", "t"), (1, "v", moment(80_000), False, "w", "t2"), (2, "v", moment(80_100), True, "n", None)]
    rows += [(3, "u", moment(10), True, "late", None), (3, "end", END, True, "end", None), (4, "end", END + timedelta(days=1), True, "end", None)]
    got = run(spark, tmp_path, rows, "url string, at timestamp, put boolean, id string, token string", 5, lambda s: state.answers(s, 500, LATE))
    assert sorted((r["url"], r["outcome"]) for r in got) == [("end", "unmatched"), ("u", "expired"), ("v", "resumed")]


@pytest.mark.parametrize("slots", [1, 4])
def test_manifests(spark, tmp_path, slots):
    """Plans and parts in any order, some parts again, some never, some after the time is up."""
    rng = random.Random(7)
    rows, want = [], []
    for k in range(30):
        n = rng.randint(1, 6)
        lost = {rng.randrange(n)} if k % 10 == 3 else set()
        late = {n - 1} - lost if k % 10 == 4 else set()
        any_slot = lambda: rng.randrange(slots)
        rows.append((any_slot(), f"a{k}", "en-US", moment(k), n, None, None))
        for place in set(range(n)) - lost:
            rows += [(any_slot(), f"a{k}", "en-US", moment(5000 if place in late else rng.randint(0, 600)), None, place, f"{k}/{place}")] * rng.randint(1, 2)
        there = [p for p in range(n) if p not in lost | late]
        want.append((f"a{k}", f"{k}/0" if 0 in there else None, [f"{k}/{p}" for p in there if p], n - len(there)))
    rows += [(0, "stray", "en-US", moment(1), None, 0, "u"), (0, None, "en-US", moment(1), 1, None, None), (0, "a", "en-US", None, 1, None, None), (slots, "end", "en-US", END, None, 0, "u")]
    got = run(spark, tmp_path, rows, "uuid string, language string, at timestamp, expected int, place int, url string", slots + 1, lambda s: state.manifests(s, 2000, LATE))
    assert sorted((r["uuid"], r["title"], [t["url"] for t in r["text"]], r["missing"]) for r in got) == sorted(want)
    assert {r["missing"] > 0 for r in got} == {True, False}


def test_what_comes_after_the_manifest_gives_no_other(spark, tmp_path):
    part = lambda slot, second, place, url: (slot, "a", "en-US", moment(second), None, place, url)
    rows = [(0, "a", "en-US", moment(0), 2, None, None), part(0, 5, 1, "b"), part(1, 6, 0, "a"), part(1, 4, 1, "earlier"), part(2, 7, 0, "again"), (2, "a", "en-US", moment(8), 2, None, None), (3, "end", "en-US", END, None, 0, "u")]
    got = run(spark, tmp_path, rows, "uuid string, language string, at timestamp, expected int, place int, url string", 4, lambda s: state.manifests(s, 2000, LATE))
    assert [(r["title"], [t["url"] for t in r["text"]], r["missing"]) for r in got] == [("a", ["earlier"], 0)]


def test_completed_once(spark, tmp_path):
    order = [("x", "a"), ("x", "b"), ("z", "c"), ("x", "b"), ("x", "other"), ("z", "b"), ("x", "c"), ("x", "a"), ("y", "a"), ("y", "b"), ("z", "a"), (None, "a"), ("x", "c")]
    rows = [(k // 3, u, code) for k, (u, code) in enumerate(order)]
    got = run(spark, tmp_path, rows, "uuid string, language string", 5, lambda s: state.completed(s, ("a", "b", "c")))
    assert sorted((r["uuid"], r["languages"]) for r in got) == [("x", 3), ("z", 3)]


def test_the_sessions_settings_stay(spark, tmp_path):
    before = {k: spark.conf.get(k, None) for k in state.SETTINGS}
    run(spark, tmp_path, [(0, "x", "a")], "uuid string, language string", 1, lambda s: state.completed(s, ("a",)))
    assert {k: spark.conf.get(k, None) for k in state.SETTINGS} == before


def test_state_is_kept_by_groups(spark, tmp_path):
    """Many keys in a group answer as apart; the store has a few values for each group, and a few partitions a core."""
    rows, by = [], {}
    for n in range(600):
        row = (n * 7, n % 2 == 1, f"i{n:03}", f"t{n}")
        by.setdefault(f"u{n % 75}", []).append(row)
        rows.append((0, f"u{n % 75}", moment(row[0]), *row[1:]))
    rows.append((1, "end", END, True, "end", None))
    frame = spark.createDataFrame(rows, "slot int, url string, at timestamp, put boolean, id string, token string")
    feed = tables.stream(spark, f"{tmp_path}/in", frame.drop("slot").schema, "parquet", tables.feed(frame, 2, f"{tmp_path}/in"))
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        query = state.started(state.answers(feed, 500, LATE, groups=3), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
        assert spark.conf.get("spark.sql.shuffle.partitions") == "64"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    got = spark.read.parquet(f"{tmp_path}/out").where("url <> 'end'").collect()
    assert sorted(((r["url"], r["outcome"], r["task_uuid"], r["notification"]) for r in got), key=str) == sorted(((url, x[0], x[1], x[3]) for url, rows in by.items() for x in plain_answers(rows, 500)), key=str)
    kept = [p["stateOperators"][0] for p in query.recentProgress]
    assert max(k["numRowsUpdated"] for k in kept) < 75 and {k["numShufflePartitions"] for k in kept} == {12}


def test_rows_of_a_feed_are_made_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(len(batch))
            yield batch

    rows = spark.range(100).selectExpr("cast(id % 4 AS int) AS slot", "id").mapInPandas(count, "slot int, id bigint")
    assert tables.feed(rows, 4, f"{tmp_path}/in", each=5) == 5
    assert sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/in").collect()) == list(range(100)) and made.value == 100
