"""Goldens of the scalar functions, and packing against a plain loop."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from vocalith.functions import text as T
from vocalith.functions.languages import CODES, languages


def of(spark, function, *values):
    """function of each value"""
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["x"] for r in rows.select("i", function(F.col("v")).alias("x")).orderBy("i").collect()]


def test_escape(spark):
    assert of(spark, T.escape_ssml, "Hello \"world\" & 'universe' <planet> >moon<", "", None, "no signs") == [
        "Hello &amp;quot;world&amp;quot; &amp; &apos;universe&apos; &lt;planet&gt; &gt;moon&lt;", "", None, "no signs",
    ]
    assert of(spark, lambda c: T.escape_ssml(c, strict_xml=True), '"&"') == ["&quot;&amp;&quot;"]


def test_title(spark):
    assert of(spark, lambda c: T.ssml_title(c, F.lit("By <me>")), "Sample Title") == ["<speak>Sample Title<p>By &lt;me&gt;</p></speak>"]


def test_content_path(spark):
    urls = ["https://www.cnn.com/path/to/resource/", "https://cnn.com/a?b=c#d", "http://lite.cnn.com/x", "https://www.cnn.com", "https://www.cnn.com/", "", "https://a.b.cnn.com/x", "https://example.com/x", None]
    assert of(spark, T.content_path, *urls) == ["/path/to/resource/", "/a?b=c#d", "/x", None, None, None, None, None, None]


def test_object_urls(spark):
    urls = ["https://s3.us-east-1.amazonaws.com/b/full/a%20b+c.mp3", "https://s3.amazonaws.com/b/k", "nonsense", None, "https://s3.eu-west-1.amazonaws.com/b/x/y"]
    got = of(spark, T.parse_object_url, *urls)
    assert [g and tuple(g) for g in got] == [("b", "full/a b+c.mp3"), None, None, None, ("b", "x/y")]
    with pytest.raises(Exception, match="Invalid S3 URL"):
        of(spark, lambda c: T.parse_object_url(c, strict=True), "nonsense")
    assert of(spark, lambda c: T.object_url(F.lit("b"), c), "audio/a%20b") == ["https://s3.us-east-1.amazonaws.com/b/audio/a%20b"]
    assert of(spark, lambda c: T.object_key(c, "b"), "https://s3.us-east-1.amazonaws.com/b/k/l", "k") == ["k/l", "k"]
    assert of(spark, T.last_segment, "a/b/c.mp3", "c") == ["c.mp3", "c"]


def test_trim_and_lengths(spark):
    assert of(spark, T.trim, "  \n\tx y﻿　", "\x1fz", None) == ["x y", "\x1fz", None]
    assert of(spark, T.utf16_length, "a", "é", "🙂", "") == [1, 1, 2, 0]


def test_times(spark):
    row = spark.range(1).select(F.lit("2024-05-06 07:08:09.123999").cast("timestamp").alias("t"))
    got = row.select(T.iso_time(F.col("t")).alias("iso"), T.ttl(F.col("t")).alias("ttl"), T.signed(F.lit("u"), F.col("t")).alias("s")).first()
    at = int(dt.datetime(2024, 5, 6, 7, 8, 9, tzinfo=dt.timezone.utc).timestamp())
    assert (got["iso"], got["ttl"], got["s"]["expires_at"]) == ("2024-05-06T07:08:09.123Z", at + 500, at + 3600)


def loop(text, limit):
    """A second statement of the packing rule: sizes in UTF-16 units."""
    size = lambda s: len(s.encode("utf-16-be")) // 2
    groups = [[]]
    for p in (f"<p>{line}</p>" for line in text.split("\n")):
        if groups[-1] and size(" ".join(groups[-1])) + size(p) > limit:
            groups.append([])
        groups[-1].append(p)
    return [f"<speak>{' '.join(g)}</speak>" for g in groups]


def test_packing_goldens(spark):
    pack = lambda c: T.group_paragraphs(c, 20)
    assert of(spark, pack, "Paragraph 1\nParagraph 2\nParagraph 3", "") == [[f"<speak><p>Paragraph {i}</p></speak>" for i in (1, 2, 3)], ["<speak><p></p></speak>"]]


def test_packing_against_a_loop(spark):
    rng = random.Random(6)
    texts = ["\n".join("".join(rng.choice("ab🙂é ") for _ in range(rng.choice([0, 1, 5, 20, 33, 34, 60]))) for _ in range(rng.randint(1, 12))) for _ in range(200)]
    texts += ["x" * 33, "x" * 34, "x" * 33 + "\n", "\n" + "x" * 34, "\n\n\n", "x" * 13 + "\n" + "y" * 12, "x" * 13 + "\n" + "y" * 14]
    assert of(spark, lambda c: T.group_paragraphs(c, 40), *texts) == [loop(t, 40) for t in texts]


def test_languages(spark):
    rows = languages(spark).collect()
    assert [(r["code"], r["items"][0]["name"], r["items"][0]["news"], r["items"][0]["gender"], r["translate"]) for r in rows] == [
        ("en-US", "Matthew", True, "MALE", "en"), ("es-US", "Pedro", True, "MALE", "es"), ("fr-FR", "Remi", False, "MALE", "fr"), ("de-DE", "Daniel", False, "MALE", "de"), ("pt-BR", "Thiago", False, "MALE", "pt"),
    ]


def test_completeness(spark):
    every = {c: ("u",) for c in CODES}
    some = {c: ("u",) for c in CODES[:2]}
    rows = spark.createDataFrame([(0, every, None), (1, some, None), (2, None, None), (3, some, "en-US"), (4, some, "en"), (5, None, "en-US"), (6, every, "")], "i int, outputs map<string, struct<url: string>>, language string")
    got = rows.select("i", T.languages_present(F.col("outputs"), F.col("language"), CODES).alias("x")).orderBy("i").collect()
    assert [r["x"] for r in got] == [True, False, False, True, False, False, True]
