"""From articles to synthesis requests: fan out over languages, translate, prepare, pack, explode.

Everything up to the requests is narrow: one stage, no shuffle, the languages broadcast (five
rows).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.languages import SOURCE_LANGUAGE, languages
from .providers import Synthesiser, Translator, tagged_translation

LIMIT = 2900


def fan_out(articles: DataFrame) -> DataFrame:
    """Each article once for each language, with `language` and the execution's name."""
    dimension = languages(articles.sparkSession).select(F.struct("code", "items", "translate").alias("language"))
    return articles.crossJoin(F.broadcast(dimension)).withColumn("execution_name", T.execution_name(F.col("uuid").cast("string"), F.col("language.code")))


def executions(plan: DataFrame) -> DataFrame:
    """The workflow's executions, one an article and language: name and JSON input."""
    parts = [F.col(c) for c in ("uuid", "url", "title", "text", "byline", "language")]
    return plan.select(F.col("execution_name").alias("name"), F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}).alias("input"))


def route(target: Column) -> Column:
    """Texts go to translation unless they are in the target language already."""
    return F.when(target != SOURCE_LANGUAGE, "translate").otherwise("synthesise")


def translate(plan: DataFrame, translator: Translator = tagged_translation) -> DataFrame:
    """Title, byline and text translated independently where the route says so; uuid, url and language stay."""
    target = F.col("language.translate")
    # groups of a text in its own language are none of the translation's
    plan = plan.drop("groups")
    moved = {c: F.when(route(target) == "translate", translator(F.col(c), target)).otherwise(F.col(c)) for c in ("title", "byline", "text")}
    return plan.withColumns(moved)


def pick_voice(items: Column, *key: Column) -> Column:
    """One of the voices, the same for the same key, by the first 32 bits of the key's MD5; null where there are none."""
    number = F.conv(F.substring(F.md5(F.concat_ws("\x1f", *[k.cast("string") for k in key])), 1, 8), 16, 10).cast("long")
    return F.get(items, F.try_mod(number, F.size(items).cast("long")).cast("int"))


def pack(articles: DataFrame, limit: int = LIMIT) -> DataFrame:
    """With `groups`, the text in SSML groups: before the fan-out, texts that aren't translated are packed once for all languages."""
    return articles.withColumn("groups", T.group_paragraphs(F.coalesce("text", F.lit("")), limit))


def prepare(plan: DataFrame, limit: int = LIMIT) -> DataFrame:
    """uuid, language, selectedVoice, title as SSML and text as an array of groups with their voice; the URL goes.

    Texts that `pack` has packed aren't packed again.
    """
    voiced = plan.withColumn("selectedVoice", pick_voice(F.col("language.items"), F.col("uuid"), F.col("language.code")))
    if "groups" not in plan.columns:
        voiced = pack(voiced, limit)
    groups = F.transform("groups", lambda g: F.struct(g.alias("text"), F.col("selectedVoice.name").alias("voice")))
    return voiced.select("uuid", "language", "selectedVoice", T.ssml_title(F.col("title"), F.col("byline")).alias("title"), groups.alias("text"))


def requests(prepared: DataFrame) -> DataFrame:
    """A row for each synthesis: the title at place 0, then the groups in order. Places replace the map's order of completion."""
    code, voice = F.col("language.code"), F.col("selectedVoice.name")
    title = F.array(F.struct(F.col("title").alias("text"), voice.alias("voice")))
    parts = prepared.select("uuid", code.alias("language_code"), F.posexplode(F.concat(title, "text")).alias("place", "part"))
    return parts.select(
        "uuid", "language_code", "place", F.when(F.col("place") == 0, "title").otherwise("paragraph").alias("text_type"), F.col("part.text").alias("ssml"), F.col("part.voice").alias("voice"),
        F.lit("neural").alias("engine"), F.lit("ssml").alias("input_type"), F.lit("mp3").alias("output_format"), F.lit("audio/").alias("key_prefix"),
    )


def synthesise(requested: DataFrame, provider: Synthesiser, concurrency: int | None = None) -> DataFrame:
    """Requests with their task; concurrency bounds how many partitions call the provider at once."""
    limited = requested if concurrency is None else requested.repartition(concurrency)
    return limited.withColumn("audioOutput", provider(F.col("ssml"), F.col("language_code"), F.col("voice")))
