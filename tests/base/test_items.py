"""Items kept in buckets: any split of the writes gives the same, and only what is touched is rewritten or read."""

import json
import random
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from vocalith import schemas
from vocalith.operators import catalog
from vocalith.operators.items import Items
from vocalith.sources import tables
from vocalith.streaming import flows

SCHEMA = "uuid string, op string, seq long, url string, title string, createdAt timestamp"
COLUMNS = "url string, title string, createdAt timestamp"


def writes(seed, count=120):
    rng, out = random.Random(seed), []
    for seq in range(count):
        key, op = f"k{rng.randint(0, 9)}", rng.choice(["put", "put", "update", "update", "delete"])
        url = f"/u{rng.randint(0, 5)}" if op == "put" else None
        out.append((key, op, seq, url, f"t{seq}" if op == "update" else None, datetime(2024, 1, 1, 0, 0, rng.randint(0, 59)) if op == "put" else None))
    return out


def rows_of(df, *columns):
    return sorted(map(str, df.select(*columns).collect()))


def files(path):
    return {str(p) for p in Path(path).rglob("part-*.parquet")}


@pytest.mark.parametrize("batches", [1, 5])
def test_any_split_of_the_log(spark, tmp_path, batches):
    log = writes(batches)
    random.Random(1).shuffle(log)
    items = Items(spark, str(tmp_path), COLUMNS, buckets=4)
    for k in range(batches):
        items.write(spark.createDataFrame(log[k::batches], SCHEMA))
    want = catalog.current_state(spark.createDataFrame(log, SCHEMA))
    assert rows_of(items.state(), "uuid", "url", "title", "createdAt") == rows_of(want, "uuid", "url", "title", "createdAt")
    asked = spark.createDataFrame([(f"/u{k}",) for k in range(7)] + [(None,)], "url string")
    first = catalog.first_by(want, "url", ["createdAt", "uuid"])
    assert rows_of(items.first_by_url(asked), "url", "uuid", "createdAt") == rows_of(first, "url", "uuid", "createdAt")
    for url in ("/u1", "/none", "", None):
        assert rows_of(items.query_by_url(url), "uuid") == rows_of(catalog.query_by_url(want, url), "uuid")
    for uuid in ("k1", "k99", "", None):
        assert rows_of(items.get(uuid), "uuid", "url") == rows_of(catalog.get(want, uuid), "uuid", "url")
    asked = spark.createDataFrame([("k1",), ("k2",), ("k2",), ("none",), (None,)], "uuid string")
    assert rows_of(items.lookup(asked), "uuid", "title") == rows_of(want.where("uuid IN ('k1', 'k2')"), "uuid", "title")
    items.vacuum()
    assert rows_of(items.state(), "uuid", "url", "title", "createdAt") == rows_of(want, "uuid", "url", "title", "createdAt")


def test_only_touched_buckets_are_rewritten_and_read(spark, tmp_path):
    items = Items(spark, str(tmp_path), COLUMNS, buckets=8)
    rows = lambda keys, seq: spark.createDataFrame([(k, "put", seq, f"/{k}", None, None) for k in keys], SCHEMA)
    everything = [f"k{n}" for n in range(40)]
    assert items.write(rows(everything, 1)) == set(range(8))
    before = set(items.table.read().inputFiles())
    touched = items.write(rows(["k1"], 2))
    after = set(items.table.read().inputFiles())
    assert len(touched) == 1 and len(before & after) == 7 and len(after - before) == 1
    # lookups read one bucket of eight
    assert len(items.get("k1").inputFiles()) == 1
    assert set(items.get("k1").inputFiles()) == after - before
    assert len(items.by_url.get("/k5").inputFiles()) == 1
    assert "PushedFilters: [IsNotNull(uuid), EqualTo(uuid,k1)]" in items.table.get("k1")._jdf.queryExecution().toString()
    asked = spark.createDataFrame([("/k5",), ("/k6",)], "url string")
    assert 1 <= len(items.by_url.lookup(asked).inputFiles()) <= 2
    items.vacuum()
    assert {Path(f.removeprefix("file:")).name for f in after} == {Path(f).name for f in files(tmp_path / "items" / "rows")}


def test_a_batch_counts_once_or_not_at_all(spark, tmp_path, monkeypatch):
    log = writes(9)
    items = Items(spark, str(tmp_path), COLUMNS, buckets=4)
    first, second = (spark.createDataFrame(x, SCHEMA) for x in (log[:60], log[60:]))
    items.write(first, 0)
    kept = rows_of(items.state(), "*")
    assert items.write(second, 0) == set() and rows_of(items.state(), "*") == kept
    # stops before the items count: the state is as it was
    merge, calls = items.table.merge, []

    def stops(rows, *_):
        calls.append(1)
        if len(calls) == 2:
            raise OSError("lost")
        return merge(rows)

    monkeypatch.setattr(items.table, "merge", stops)
    with pytest.raises(OSError, match="lost"):
        items.write(second, 1)
    assert rows_of(items.state(), "*") == kept
    monkeypatch.setattr(items.table, "merge", merge)
    # stops between items and index: running it again completes the index
    monkeypatch.setattr(items.by_url, "apply", stops)
    calls[:] = [1]
    with pytest.raises(OSError, match="lost"):
        items.write(second, 1)
    monkeypatch.undo()
    items.write(second, 1)
    want = catalog.current_state(spark.createDataFrame(log, SCHEMA))
    asked = want.select("url").distinct()
    assert rows_of(items.state(), "uuid", "url", "title") == rows_of(want, "uuid", "url", "title")
    assert rows_of(items.first_by_url(asked), "url", "uuid") == rows_of(catalog.first_by(want, "url", ["createdAt", "uuid"]), "url", "uuid")


def test_empty(spark, tmp_path):
    items = Items(spark, str(tmp_path), COLUMNS)
    assert items.state().count() == 0 and items.write(spark.createDataFrame([], SCHEMA)) == set() and items.state().count() == 0
    assert items.first_by_url(spark.createDataFrame([("/x",)], "url string")).count() == 0 and items.get("x").count() == 0


def test_notifications_are_answered_from_the_snapshot(spark, tmp_path):
    note = lambda key, event="ObjectCreated:Put": json.dumps({"eventName": event, "s3": {"bucket": {"name": "b"}, "object": {"key": key}}})
    (tmp_path / "in").mkdir()
    for i, lines in enumerate(([note("audio/x"), note("audio/x")], [note("audio/y"), note("full/z"), note("audio/w")])):
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(lines))
    tasks = Items(spark, str(tmp_path / "tasks"), schemas.TASK_COLUMNS, buckets=4)
    url = "https://s3.us-east-1.amazonaws.com/b/audio/"
    waits = spark.createDataFrame([("2", url + "x", "t2"), ("1", url + "x", "t1"), ("3", url + "w", "t3"), ("4", url + "never", "t4")], "uuid string, url string, token string")
    tasks.write(catalog.create_task(waits, F.timestamp_seconds(F.lit(100))))
    done, audit = [], []
    flows.answer(tables.notifications(spark, str(tmp_path / "in"), 1), tasks, str(tmp_path / "checkpoint"), lambda df, n: done.extend(df.collect()), lambda df, n: audit.extend(df.collect()))
    assert sorted((r["task_uuid"], r["token"], r["task_status"]) for r in done) == [("1", "t1", "DELIVERED"), ("3", "t3", "DELIVERED")]
    assert [r["url"] for r in audit] == [url + "y"]
    assert sorted((r["uuid"], r["task_status"]) for r in tasks.state().collect()) == [("1", "DELIVERED"), ("2", "PENDING"), ("3", "DELIVERED"), ("4", "PENDING")]
