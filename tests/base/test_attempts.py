"""The log of attempts, and selectors as steps on nodes."""

import pytest
from pyspark.sql import functions as F

from vocalith.operators.attempts import Attempts
from vocalith.operators.providers import Retry
from vocalith.sources import pages, selectors

REQUESTS = [("a", "0"), ("b", "1"), ("c", "2"), ("d", "9"), ("a", "0"), (None, "0")]


def service(log):
    """Fails so often as the payload says; notes each call in a file."""

    def call(key, payload, attempt):
        with log.open("a") as file:
            file.write(f"{key}{attempt} ")
        if attempt <= int(payload):
            raise OSError("busy")
        return key.upper()

    return call


def test_only_what_is_due_is_called(spark, tmp_path):
    asked, log = spark.createDataFrame(REQUESTS, "key string, payload string"), tmp_path / "calls"
    work = Attempts(spark, str(tmp_path / "log"), Retry(2, 2, 2), buckets=2)
    call = service(log)
    calls = lambda: sorted(log.read_text().split())
    assert sorted((r["key"], r["outcome"], r["due"]) for r in work.round(asked, call, 100).collect()) == [("a", "done", None), ("b", "waiting", 102), ("c", "waiting", 102), ("d", "waiting", 102)]
    assert calls() == ["a1", "b1", "c1", "d1"] and work.next_due() == 102
    # nothing is due yet, whoever asks
    again = Attempts(spark, str(tmp_path / "log"), Retry(2, 2, 2), buckets=2)
    assert again.round(asked, call, 101).count() == 0 and len(calls()) == 4
    again.round(asked, call, 102)
    assert calls()[-1] == "d2" and len(calls()) == 7 and again.next_due() == 106
    again.round(asked, call, 106, concurrency=1)
    state = {r["key"]: (r["outcome"], r["attempt"], r["response"]) for r in again.state().collect()}
    assert state == {"a": ("done", 1, "A"), "b": ("done", 2, "B"), "c": ("done", 3, "C"), "d": ("dead", 3, None)}
    assert again.next_due() is None and again.round(asked, call, 10_000).count() == 0
    assert calls() == ["a1", "b1", "b2", "c1", "c2", "c3", "d1", "d2", "d3"]
    # a dead letter is driven again, and mended now
    assert [(r["key"], "busy" in r["error"]) for r in again.dead().collect()] == [("d", True)]
    again.redrive(spark.createDataFrame([("d",), ("a",)], "key string"), 200)
    mended = spark.createDataFrame([("d", "0"), ("a", "0")], "key string, payload string")
    again.round(mended, call, 200)
    assert again.dead().count() == 0 and {r["key"]: r["response"] for r in again.state().collect()}["d"] == "D"
    assert calls().count("a1") == 1 and calls().count("d1") == 2


def test_a_written_round_is_not_called_again(spark, tmp_path, monkeypatch):
    asked, log = spark.createDataFrame(REQUESTS, "key string, payload string"), tmp_path / "calls"
    work = Attempts(spark, str(tmp_path / "log"), Retry(2, 2, 2), buckets=2)
    with monkeypatch.context() as patch, pytest.raises(OSError, match="lost"):
        patch.setattr(work.table, "apply", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        work.round(asked, service(log), 100)
    assert len(log.read_text().split()) == 4 and work.state().count() == 0
    # the driver comes back: the round counts, and no request is called for it
    work.round(asked, service(log), 101)
    assert len(log.read_text().split()) == 4 and work.state().count() == 4


PAGE = """<div class=a><p class="x y">1<b>2</b></p><p>3<div class=a><p class=x>4</p><span>5<p class=x>6</span></div><p class=x>7</p></div>
<ul><li>8<ul><li>9</li></ul></li><li>10</li></ul><h1>T &amp; <i>u</i></h1><h1> v</h1>"""


@pytest.mark.parametrize(("selector", "want"), [
    ("p", ["12", "3", "4", "6", "7"]), (".x", ["12", "4", "6", "7"]), (".y", ["12"]), ("p:not(:last-child)", ["12", "3", "4"]),
    (".a .x", ["12", "4", "6", "7"]), (".a .a .x", ["4", "6"]), (".a > .x", ["12", "4", "7"]), (".a > .a > .x", ["4"]), (".a span .x", ["6"]), ("span > p", ["6"]),
    ("ul li", ["89", "9", "10"]), ("ul ul li", ["9"]), ("li > li", []), ("ul > li:not(:last-child)", ["89"]), ("h1", ["T & u", " v"]), ("none", []), (".a .none .x", []),
])
def test_selectors(spark, selector, want):
    rows = selectors.nodes(spark.createDataFrame([(1, PAGE), (2, None), (3, ""), (4, "<p class=x>other</p>")], "page_id int, html string"))
    got = selectors.texts(rows, selectors.select(rows, {"s": selector})).where("page = 1").collect()
    assert [t for r in got for t in r["texts"]] == want


def test_many_selectors_at_once(spark):
    rows = selectors.nodes(spark.createDataFrame([(1, PAGE), (4, "<p class=x>other</p><i></i>")], "page_id int, html string"))
    wanted = {"all": "p", "deep": ".a .a .x", "child": "span > p", "empty": "i"}
    got = {(r["page"], r["name"]): r["texts"] for r in selectors.texts(rows, selectors.select(rows, wanted)).collect()}
    assert got == {(1, "all"): ["12", "3", "4", "6", "7"], (1, "deep"): ["4", "6"], (1, "child"): ["6"], (1, "empty"): ["u"], (4, "all"): ["other"], (4, "empty"): [""]}


def test_extraction_by_steps_is_that_of_the_parser(spark):
    some = [PAGE, None, "", "<p", "<h1>a</h1><article><p>x<p> y <p>z</article>", "<div>" * 300 + "<p class=paragraph--lite>x<b>" + "<b>" * 50]
    df = spark.createDataFrame([(i, f"/{i}", x) for i, x in enumerate(some)], "page_id int, url string, html string")
    for s in (pages.Selectors("h1", ".byline", "p"), pages.Selectors("h1", "i", "article p", skip_last=False), pages.Selectors()):
        order = lambda x: sorted(map(str, x.collect()))
        assert order(selectors.extract(df, s)) == order(pages.extract(df, s))


def test_fetching_is_settled(spark):
    site = spark.createDataFrame([("/a", "<p>2"), ("/a", "<p>1"), ("/b", None)], "url string, html string")
    asked = spark.createDataFrame([("x", "/a"), ("y", "/b"), ("z", "/c")], "uuid string, url string")
    assert sorted((r["uuid"], r["html"] or "") for r in pages.fetch(asked, site.repartition(F.lit(3)), "").collect()) == [("x", "<p>1"), ("y", ""), ("z", "")]
