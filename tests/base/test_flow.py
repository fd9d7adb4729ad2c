"""Catalog, callbacks, manifests, pages, providers and streams."""

import json
from datetime import datetime
from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from vocalith import schemas
from vocalith.operators import callbacks, catalog, manifest, plan, providers
from vocalith.sources import pages, tables
from vocalith.streaming import flows

HTML = "<html><body><div><h2 class='headline big'> A <b>title</b> </h2><p class=byline--lite>By me\n</p></div><article><p class='paragraph--lite'>One &amp; two<p class='paragraph--lite'> Three<br>four </p><p class='paragraph--lite'>last</p></article></body></html>"


def at(n):
    return F.timestamp_seconds(F.lit(n))


@pytest.fixture
def state(spark):
    rows = lambda *x: spark.createDataFrame(x, "uuid string, url string")
    log = catalog.write_log([
        catalog.create_content(rows(("a", "/a"), ("b", "/b"), ("c", "/c"), ("", "/empty")), at(1)),
        catalog.update_title(spark.createDataFrame([("a", "old"), ("d", "upserted")], "uuid string, title string"), at(2)),
        catalog.update_title(spark.createDataFrame([("a", "new")], "uuid string, title string"), at(3)),
        catalog.update_outputs(spark.createDataFrame([("a", {"en-US": ("u",)})], f"uuid string, outputs {schemas.OUTPUTS}"), at(4)),
        catalog.update_content_status(rows(("b", None)), "FAILED", at(5)),
        catalog.delete(rows(("c", None)), at(6)),
        catalog.create_content(rows(("b", "/b2")), at(7)),
        catalog.create_merge_job(spark.createDataFrame([("m", "a", "/m", "fr-FR")], "uuid string, article_id string, url string, language string"), at(8)),
    ])
    return catalog.current_state(log)


def test_state_is_what_the_log_leaves(state):
    got = {r["uuid"]: r for r in state.collect()}
    assert set(got) == {"a", "b", "d", "m"}
    a, b, d, m = got["a"], got["b"], got["d"], got["m"]
    assert (a["url"], a["article_status"], a["title"], a["outputs"]["en-US"]["url"], a["createdAt"].second, a["updatedAt"].second) == ("/a", "PENDING", "new", "u", 1, 4)
    assert (b["url"], b["article_status"], b["updatedAt"].second) == ("/b2", "PENDING", 7)
    assert (d["title"], d["url"]) == ("upserted", None)
    assert (m["type"], m["article_status"], m["article_id"], m["language"]) == ("merge", "RENDERED", "a", "fr-FR")
    with pytest.raises(ValueError, match="none of"):
        catalog.update_content_status(state, "LOST", at(9))


def test_lookups(state):
    assert catalog.get(state, "a").count() == 1 and catalog.get(state, "zz").count() == 0
    assert catalog.get(state, None).count() == 0 == catalog.get(state, "").count() == catalog.query_by_url(state, "").count()
    assert catalog.query_by_url(state, "/b2").first()["uuid"] == "b"


def test_requests(spark, state):
    asked = spark.createDataFrame([(1, "a", None, "en-US"), (2, "zz", "https://www.cnn.com/b2", None), (3, "zz", "https://www.cnn.com/new", None), (4, None, None, None), (5, "zz", "https://elsewhere.org/", None), (6, "", "https://cnn.com/new", None)], "n int, contentId string, href string, language string")
    found = catalog.look_up(asked, state)
    assert [r["outcome"] for r in catalog.outcome(found).orderBy("n").collect()] == ["found", "found", "create", "Missing contentId or url", "404", "create"]
    new = catalog.current_state(catalog.create_missing(found, at(10))).collect()
    assert [(r["url"], r["article_status"]) for r in new] == [("/new", "PENDING")]
    got = {r["n"]: r for r in catalog.respond(found, at(0)).collect()}
    assert {n: r["complete"] for n, r in got.items()} == {1: True, 2: False}


def test_entries_are_signed_and_sorted(spark):
    url = "https://s3.us-east-1.amazonaws.com/b/full/x"
    rows = spark.createDataFrame([({"fr-FR": (url,), "de-DE": ("odd",)},)], f"outputs {schemas.OUTPUTS}")
    got = rows.select(catalog.entries(F.col("outputs"), at(100)).alias("e")).first()["e"]
    assert [(e["code"], e["signed"] and tuple(e["signed"])) for e in got] == [("de-DE", None), ("fr-FR", (url, 3700))]


def test_http(spark):
    events = spark.createDataFrame([("GET", ("p",), None), ("POST", None, '{"contentId": "c", "url": "u", "language": "l"}'), ("POST", None, None)], schemas.HTTP_EVENT)
    assert [tuple(r) for r in catalog.sanitise(events).collect()] == [("p", None, None), ("c", "u", "l"), (None, None, None)]
    got = spark.range(1).select(catalog.http_output(F.lit(200), F.struct(F.lit(1).alias("a"))).alias("x"), catalog.http_output(F.lit(204)).alias("y")).first()
    assert (tuple(got["x"]), tuple(got["y"])) == ((200, '{"a":1}'), (204, None))


def test_tasks_and_callbacks(spark):
    audio = lambda task, url: ((task, url),)
    waits = spark.createDataFrame([("title", "t1", audio("1", "https://s3.us-east-1.amazonaws.com/b/audio/x"), None), ("paragraph", "t2", None, audio("2", "u2")), ("other", "t3", audio("3", "u3"), None), ("title", "t4", audio("", "u4"), None), ("paragraph", "t5", audio("5", "u5"), None)], schemas.WAIT)
    picked = callbacks.waiting(waits)
    tasks = catalog.current_state(catalog.create_task(picked, at(1000)))
    got = {r["uuid"]: r for r in tasks.collect()}
    assert set(got) == {"1", "2"} and got["1"]["ttl"] == 1500 and got["1"]["task_status"] == "PENDING"
    assert catalog.unexpired(tasks, at(1499)).count() == 2 and catalog.unexpired(tasks, at(1500)).count() == 0
    notes = spark.createDataFrame([("ObjectCreated:Put", (("b",), ("audio/x",))), ("ObjectCreated:Copy", (("b",), ("audio/x",))), ("ObjectCreated:Put", (("b",), ("full/x",))), ("ObjectCreated:Put", (("b",), ("audio/none",)))], schemas.NOTIFICATION)
    done = callbacks.success(callbacks.match(callbacks.put_urls(notes), tasks)).collect()
    assert [(r["task_uuid"], r["token"], r["task_status"], json.loads(r["output"])) for r in done] == [("1", "t1", "DELIVERED", {"url": "https://s3.us-east-1.amazonaws.com/b/audio/x"})]
    assert callbacks.put_urls(notes.limit(0)).count() == 0
    after = catalog.current_state(catalog.write_log([catalog.create_task(picked, at(1000)), catalog.update_task_status(picked.where("uuid = '1'"), "DELIVERED", at(1001))]))
    assert {r["uuid"]: r["task_status"] for r in after.collect()} == {"1": "DELIVERED", "2": "PENDING"}
    resumed = callbacks.selected(spark.createDataFrame([("title", "a"), ("paragraph", "b")], "text_type string, url string")).collect()
    assert [(r["title"], r["paragraph"] and r["paragraph"]["url"]) for r in resumed] == [("a", None), (None, "b")]


def test_plan_to_manifest(spark):
    articles = spark.createDataFrame([("x", "/x", "Title", "By", "One\nTwo")], schemas.ARTICLE)
    prepared = plan.prepare(plan.translate(plan.fan_out(articles), providers.dictionary_translation({("es", "Title"): "Título"})))
    assert prepared.columns == ["uuid", "language", "selectedVoice", "title", "text"]
    asked = plan.synthesise(plan.requests(prepared), providers.hashed_synthesis("b"), concurrency=5)
    rows = asked.collect()
    assert len(rows) == 10 and {r["ssml"] for r in rows if r["language_code"] == "es-US" and r["place"] == 0} == {"<speak>Título<p>By</p></speak>"}
    segments = asked.select("uuid", F.col("language_code").alias("language"), "place", F.col("audioOutput.SynthesisTask.OutputUri").alias("url"))
    merged = manifest.keys(manifest.assemble(segments), "b")
    one = merged.where("language = 'en-US'").first()
    urls = {r["place"]: r["audioOutput"]["SynthesisTask"]["OutputUri"] for r in rows if r["language_code"] == "en-US"}
    assert one["title"] == urls[0] and [t["url"] for t in one["text"]] == [urls[1]] and [f"https://s3.us-east-1.amazonaws.com/b/{k}" for k in one["inputs"]] == [urls[0], urls[1]]
    done = manifest.finish(merged, "b", F.when(F.col("language") == "de-DE", "no disk"))
    by = {r["language"]: r for r in done.collect()}
    assert by["fr-FR"]["output_key"] == "full/x-fr-FR.mp3" and by["fr-FR"]["succeeded"] and not by["de-DE"]["succeeded"]
    assert json.loads(by["de-DE"]["output"]) == {"uuid": "x"} and by["de-DE"]["error"] == "no disk"
    outputs = manifest.outputs(done.where("succeeded").withColumn("n", F.lit(1)), "n").first()["outputs"]
    assert sorted(outputs) == ["en-US", "es-US", "fr-FR", "pt-BR"]
    missing = manifest.keys(spark.createDataFrame([("x", "t", None, "en", "k")], schemas.MERGE), "b").first()
    assert missing["inputs"] == ["t"]


def test_bytes_in_order(spark):
    parts = spark.createDataFrame([("x", "l", 1, b"b"), ("x", "l", 0, b"a"), ("x", "l", 2, b"c")], "uuid string, language string, place int, content binary")
    assert bytes(manifest.concatenated(parts).first()["content"]) == b"abc"


def test_pages(spark):
    frame = spark.createDataFrame([(1, HTML), (2, None), (3, "<p")], "page_id int, html string")
    got = {r["page_id"]: r for r in pages.extract(frame).collect()}
    assert (got[1]["title"], got[1]["byline"], got[1]["text"]) == ("A title", "By me", "One & two\nThreefour")
    assert (got[2]["title"], got[2]["error"]) == (None, "no page") and (got[3]["title"], got[3]["error"]) == ("", None)
    every = pages.extract_page(HTML, pages.Selectors("h2", ".byline--lite", "article p", skip_last=False))
    assert every[2].split("\n") == ["One & two", "Threefour", "last"]


@pytest.mark.parametrize(("html", "inner", "every"), [
    ("<div>{p}<b>One{p}Two</p>{p}Three</p></div>", "One Two", "One Two Three"),
    ("<div>{p}a<table><tr><td>{p}x</td><td>y</table>{p}z</div>{p}end", "a", "a x z end"),
    ("<body>{p}x</p></body>{p}y</p><i>q</i></html>", "x y", "x y"),
    ("{p}One<i>two</div>three</i></p>{p}l", "Onetwothree", "Onetwothree l"),
    ("</p>{p}x</p><div></div>", "x", "x"),
    ("<ul><li>1{p}a<li>2{p}b</ul>", "", "a b"),
    ("<h2 class=headline>A</h2>{p}First{p}Second{p}Read more", "First Second", "First Second Read&more"),
    ("{p}1<br>2<img src=x>{p}3<hr>", "12 3", "12 3"),
    ("", "", ""),
])
def test_left_out_and_stray_tags(html, inner, every):
    page = html.replace("{p}", '<p class="paragraph--lite">')
    assert pages.extract_page(page, pages.Selectors())[2] == inner.replace(" ", "\n")
    assert pages.extract_page(page, pages.Selectors(skip_last=False))[2] == every.replace(" ", "\n").replace("Read&more", "Read more")


def test_nested_deeply():
    assert pages.extract_page("<div>" * 20_000 + "<p class='paragraph--lite'>x<b>" + "<b>" * 5000, pages.Selectors(skip_last=False))[2] == "x"


def test_services_are_called_again(spark, tmp_path):
    log = tmp_path / "calls"

    def flaky(*x):
        with log.open("a") as file:
            file.write("x")
        if log.stat().st_size % 3:
            raise OSError("busy")
        return x

    once_more = providers.Retry(2, 0)
    translate = providers.called_translation(lambda text, to: f"{flaky(text, to)[1]}:{text}", once_more)
    rows = spark.createDataFrame([("x", "/x", "Title", "By", None)], schemas.ARTICLE).coalesce(1)
    got = {r["language"]["code"]: (r["title"], r["text"]) for r in plan.translate(plan.fan_out(rows), translate).collect()}
    assert got["de-DE"] == ("de:Title", None) and got["en-US"] == ("Title", None)
    speak = providers.called_synthesis(lambda ssml, code, voice: (code, voice), once_more)
    audio = spark.createDataFrame([("s", "fr-FR", "Remi")], "a string, b string, c string").select(speak(F.col("a"), F.col("b"), F.col("c")).alias("o")).first()["o"]
    assert audio["SynthesisTask"].asDict() == {"TaskId": "fr-FR", "OutputUri": "Remi"}


def test_merged_objects(spark, tmp_path):
    for name, content in (("a", b"1"), ("b", b"22"), ("c", b"3")):
        (tmp_path / "audio").mkdir(exist_ok=True)
        (tmp_path / "audio" / name).write_bytes(content)
    merges = spark.createDataFrame([("x", "en-US", ["audio/b", "audio/a", "audio/c"]), ("y", "en-US", ["audio/none"])], "uuid string, language string, inputs array<string>")
    got = {r["uuid"]: r for r in manifest.merge_objects(merges, str(tmp_path), retry=providers.Retry(1, 0)).collect()}
    assert (got["x"]["length"], got["x"]["merge_error"]) == (4, None) and (tmp_path / got["x"]["output_key"]).read_bytes() == b"2213"
    assert got["y"]["length"] is None and "audio/none" in got["y"]["merge_error"]


def test_remuxing_by_a_program(tmp_path):
    program = tmp_path / "concat"
    program.write_text("#!/bin/sh\nfor f in $(sed \"s/file '//; s/'$//\" \"$6\"); do cat $f; done > \"$9\"\n")
    program.chmod(0o755)
    assert providers.remuxing(str(program))([b"1", b"22", b"3"]) == b"1223"
    with pytest.raises(FileNotFoundError):
        providers.remuxing(str(tmp_path / "none"))([b"1"])


def test_listening(spark, tmp_path):
    (tmp_path / "in").mkdir()
    note = lambda key, event="ObjectCreated:Put": json.dumps({"eventName": event, "s3": {"bucket": {"name": "b"}, "object": {"key": key}}})
    for i, lines in enumerate(([note("audio/x"), note("audio/x")], [note("audio/y"), note("full/z"), note("audio/x", "ObjectRemoved:Delete")])):
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(lines))
    tasks = spark.createDataFrame([("1", "https://s3.us-east-1.amazonaws.com/b/audio/x", "t1", datetime(2024, 1, 1))], "uuid string, url string, token string, createdAt timestamp")
    done, audit = {}, {}
    flows.listen(tables.notifications(spark, str(tmp_path / "in")), lambda: tasks, str(tmp_path / "checkpoint"), lambda df, n: done.update({n: df.collect()}), lambda df, n: audit.update({n: df.collect()}))
    assert [(r["task_uuid"], r["token"]) for rows in done.values() for r in rows] == [("1", "t1")]
    assert [r["url"] for rows in audit.values() for r in rows] == ["https://s3.us-east-1.amazonaws.com/b/audio/y"]


def test_unmatched_tasks_and_notifications(spark):
    tasks = spark.createDataFrame([(1, "a", datetime(2024, 1, 1)), (2, "b", datetime(2024, 1, 1))], "task int, k string, t timestamp")
    notes = spark.createDataFrame([(7, "a", datetime(2024, 1, 1, 0, 5)), (8, "a", datetime(2024, 1, 2))], "note int, k string, n timestamp")
    rows = lambda how: sorted(((r["task"] or 0, r["note"] or 0) for r in callbacks.match_within(tasks, notes, "k", "t", "n", how=how).select("task", "note").collect()))
    assert rows("inner") == [(1, 7)] and rows("leftOuter") == [(1, 7), (2, 0)] and rows("rightOuter") == [(0, 8), (1, 7)]


def test_executions_and_signers(spark):
    row = plan.executions(plan.fan_out(spark.createDataFrame([("x", "/x", 'A "title"', None, "One\nTwo")], schemas.ARTICLE))).orderBy("name").first()
    assert row["name"] == "x-de-DE" and json.loads(row["input"]) | {"language": 0} == {"uuid": "x", "url": "/x", "title": 'A "title"', "text": "One\nTwo", "byline": None, "language": 0}
    url = "https://s3.us-east-1.amazonaws.com/b/full/x"
    signed = spark.createDataFrame([({"fr-FR": (url,)},)], f"outputs {schemas.OUTPUTS}").select(catalog.entries(F.col("outputs"), at(100), lambda b, k, e: F.concat_ws("|", b, k, e)).alias("e")).first()["e"]
    assert signed[0]["signed"]["url"] == "b|full/x|3700"


def test_an_entry_without_a_value_is_missing(spark):
    from vocalith.functions import text as T

    rows = spark.createDataFrame([({"fr-FR": None, "de-DE": ("u",)},), (None,)], f"outputs {schemas.OUTPUTS}")
    of = lambda code: [r[0] for r in rows.select(T.languages_present(F.col("outputs"), F.lit(code), ("de-DE",))).collect()]
    assert of("fr-FR") == [False, False] and of("de-DE") == [True, False] and of("") == [True, False]


def test_retry_waits():
    assert providers.RETRY_TITLE.waits() == [2, 4, 8, 16, 32, 64] and len(providers.RETRY_MERGE.waits()) == 20
    waited, calls = [], []

    def fails():
        calls.append(1)
        if len(calls) < 3:
            raise OSError

    providers.RETRY_PARAGRAPH.call(fails, wait=waited.append)
    assert waited == [2, 4] and len(calls) == 3


def test_objects(spark, tmp_path):
    (tmp_path / "audio").mkdir()
    (tmp_path / "audio" / "a.mp3").write_bytes(b"sound")
    (tmp_path / "full").mkdir()
    (tmp_path / "full" / "b.mp3").write_bytes(b"other")
    assert [(r["key"], bytes(r["content"])) for r in tables.objects(spark, str(tmp_path)).collect()] == [("audio/a.mp3", b"sound")]


def test_change_feed_to_plans(spark, tmp_path):
    changes = [{"eventName": kind, "dynamodb": {"NewImage": {"uuid": {"S": u}, "url": {"S": f"/{u}"}}}} for kind, u in (("INSERT", "a"), ("MODIFY", "b"), ("INSERT", "missing"))]
    (tmp_path / "in").mkdir()
    for i, c in enumerate(changes):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps(c))
    site = spark.createDataFrame([("https://lite.cnn.com/a", HTML), ("https://lite.cnn.com/b", HTML)], "url string, html string")
    done, failed = {}, {}
    flows.follow(tables.change_feed(spark, str(tmp_path / "in"), 1), site, str(tmp_path / "checkpoint"), lambda df, n: done.update({n: df.collect()}), lambda df, n: failed.update({n: df.collect()}))
    plans = [r for rows in done.values() for r in rows]
    assert len(done) == 3 and {r["uuid"] for r in plans} == {"a"} and len(plans) == 5
    assert [(r["uuid"], r["error"]) for rows in failed.values() for r in rows] == [("missing", "no page")]


def test_stream_equals_batch(spark):
    from vocalith.plans.queries import callback_interval, stream_callback_interval, stream_change_inserts

    sf = "/root/testdata/sf0.001"
    streamed = stream_callback_interval(spark, sf).collect()
    events = spark.read.parquet(f"{sf}/events.parquet")
    of = lambda kind, id_, time: events.where(F.col("event_type") == kind).select(F.col("event_id").alias(id_), "user_id", F.col("ts").cast("timestamp").alias(time))
    batch = callbacks.match_within(of("signup", "task_id", "task_ts"), of("purchase", "event_id", "ts"), "user_id", "task_ts", "ts", 7200).select("task_id", "event_id")
    assert sorted(map(tuple, streamed)) == sorted(map(tuple, batch.collect()))
    assert callback_interval(spark, sf).count() <= batch.count()
    assert stream_change_inserts(spark, sf).count() == events.where("event_type = 'signup'").count()


def test_changes_without_a_time(spark, tmp_path):
    """Inserts with a null ts come out of the stream; tables without times or rows give what they have."""
    from vocalith.plans import queries

    rows = [(i, i % 3, "signup" if i % 2 else "click", None if i % 5 == 1 else datetime(2024, 1, 1 + i)) for i in range(20)]
    for name, some in (("mixed", rows), ("untimed", [(*r[:3], None) for r in rows]), ("empty", [])):
        spark.createDataFrame(some, "event_id long, user_id long, event_type string, ts timestamp_ntz").write.parquet(str(tmp_path / name / "events.parquet"))
        got = queries.stream_change_inserts(spark, str(tmp_path / name)).collect()
        assert sorted(map(tuple, got)) == [r[:2] for r in some if r[2] == "signup"]
        assert queries.stream_callback_interval(spark, str(tmp_path / name)).count() == 0


def test_folder_where_the_setting_is_absent(monkeypatch):
    """A temporary one, the same each time; a session's own setting comes first."""
    unset = SimpleNamespace(get=lambda *_: None)
    session = lambda conf: SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(getConf=lambda: unset))
    monkeypatch.setattr(tables, "_own_dir", [])
    assert tables.shared_dir(session(SimpleNamespace(get=lambda *_: "hdfs://x/y"))) == "hdfs://x/y"
    assert Path(own := tables.shared_dir(session(unset))).is_dir() and tables.shared_dir(session(unset)) == own


def test_voices_are_picked_by_key(spark):
    rows = spark.createDataFrame([(f"a{k}",) for k in range(300)] + [(None,)], "uuid string")
    voices = F.array(*[F.struct(F.lit(v).alias("name")) for v in ("x", "y", "z")])
    picked = lambda items: [r[0] for r in rows.select(plan.pick_voice(items, F.col("uuid"), F.lit("en-US"))["name"]).collect()]
    got = picked(voices)
    assert got == picked(voices) and all(70 < got.count(v) < 130 for v in ("x", "y", "z"))
    assert set(picked(F.array(F.struct(F.lit("only").alias("name"))))) == {"only"}
    assert set(picked(F.array().cast("array<struct<name: string>>"))) == {None}


def test_uploads(spark, tmp_path):
    rows = spark.createDataFrame([("audio/a b.mp3", b"\x00\xff", 1), ("full/deep/x", None, 2)], "key string, content binary, n int")
    assert sorted(tuple(r) for r in tables.upload(rows, str(tmp_path)).collect()) == [("audio/a b.mp3", 1, 2), ("full/deep/x", 2, 0)]
    assert (tmp_path / "audio" / "a b.mp3").read_bytes() == b"\x00\xff" and (tmp_path / "full" / "deep" / "x").read_bytes() == b""
