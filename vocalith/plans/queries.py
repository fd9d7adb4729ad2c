"""The engine's operators applied to the driver's tables.

Those tables aren't shaped like articles and tasks, so columns stand in: `documents` are
article texts (first line: title, source: byline), `events` change feeds and notifications
(signup: INSERT or task, purchase: object put, user: key), `pages` the site, `conversations`
ordered segments. Each query has DuckDB SQL with the same rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.languages import CODES
from ..operators import callbacks, catalog, manifest, plan, providers
from ..sources import pages as site
from ..sources.tables import delete, drain, feed, notifications, objects, shared_dir, stream, table, upload
from ..streaming.flows import instant, once, resolve

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

NOW = "2024-01-15 00:00:00"
HOST = r"example\.(?:com|net|org)"
BUCKET = "bucket"


def query(sql: str | None = None):
    def register(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return register


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    return d.select(F.col("doc_id").alias("uuid"), F.concat(F.lit("/a/"), F.col("doc_id").cast("string")).alias("url"), F.substring_index(text, "\n", 1).alias("title"), F.coalesce("source", F.lit("")).alias("byline"), text.alias("text"), "lang", "source")


def _group_rows(text: str = "coalesce(text, '')", length: str = "length({0})") -> str:
    """SQL: the SSML groups of documents, numbered. length: of a string, in the units that count."""
    a, b = length.format("a.cur"), length.format("b.cur")
    return f"""
  SELECT doc_id, unnest(range(1, len(g) + 1))::INT AS group_no, unnest(g) AS ssml FROM (SELECT doc_id, list_append(r.done, '<speak>' || r.cur || '</speak>') AS g FROM (
  SELECT doc_id, list_reduce(
    list_prepend({{'done': []::VARCHAR[], 'cur': '', 'n': 0}}, list_transform(string_split({text}, chr(10)), lambda p: {{'done': []::VARCHAR[], 'cur': '<p>' || p || '</p>', 'n': 1}})),
    lambda a, b: CASE WHEN {a} + {b} <= 2900
      THEN {{'done': a.done, 'cur': CASE WHEN a.n = 0 THEN b.cur ELSE a.cur || ' ' || b.cur END, 'n': a.n + 1}}
      ELSE {{'done': CASE WHEN a.n = 0 THEN a.done ELSE list_append(a.done, '<speak>' || a.cur || '</speak>') END, 'cur': b.cur, 'n': 1}} END) AS r
  FROM documents))
"""


_GROUP_ROWS = _group_rows()
_ESCAPE = "replace(replace(replace(replace(replace({0}, '\"', '&quot;'), '&', '&amp;'), '''', '&apos;'), '<', '&lt;'), '>', '&gt;')"
_TITLE = "string_split(coalesce(text, ''), chr(10))[1]"
_LANGUAGES = "(VALUES ('en-US', 'Matthew', 'en'), ('es-US', 'Pedro', 'es'), ('fr-FR', 'Remi', 'fr'), ('de-DE', 'Daniel', 'de'), ('pt-BR', 'Thiago', 'pt')) l(code, voice, translate)"
CODE_OF = "CASE lang WHEN 'en' THEN 'en-US' WHEN 'es' THEN 'es-US' WHEN 'fr' THEN 'fr-FR' WHEN 'de' THEN 'de-DE' WHEN 'pt' THEN 'pt-BR' END"


@query("SELECT doc_id, unnest(range(1, len(p) + 1))::INT AS pos, '<p>' || unnest(p) || '</p>' AS paragraph FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents)")
def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = articles(spark, sf_dir).select(F.col("uuid").alias("doc_id"), F.posexplode(T.paragraphs(F.col("text"))).alias("pos", "paragraph"))
    return rows.withColumn("pos", F.col("pos") + 1)


@query(_GROUP_ROWS)
def ssml_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = articles(spark, sf_dir).select(F.col("uuid").alias("doc_id"), F.posexplode(T.group_paragraphs(F.col("text"))).alias("group_no", "ssml"))
    return rows.withColumn("group_no", F.col("group_no") + 1)


@query(_group_rows("replace(replace(coalesce(text, ''), 'e', chr(128512)), '. ', chr(10))", "(length({0}) + length(regexp_replace({0}, '[^\\x{{10000}}-\\x{{10ffff}}]', '', 'g')))"))
def ssml_groups_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with many signs that take two units of UTF-16, which the limit counts."""
    wide = F.replace(F.replace("text", F.lit("e"), F.lit("\U0001f600")), F.lit(". "), F.lit("\n"))
    rows = articles(spark, sf_dir).select(F.col("uuid").alias("doc_id"), F.posexplode(T.group_paragraphs(wide)).alias("group_no", "ssml"))
    return rows.withColumn("group_no", F.col("group_no") + 1)


@query(f"SELECT doc_id, {_ESCAPE.format('text')} AS escaped FROM documents")
def ssml_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.escape_ssml(F.col("text")).alias("escaped"))


@query(f"SELECT doc_id, '<speak>' || {_ESCAPE.format(_TITLE)} || '<p>' || {_ESCAPE.format('source')} || '</p></speak>' AS ssml_title FROM documents")
def ssml_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles(spark, sf_dir).select(F.col("uuid").alias("doc_id"), T.ssml_title(F.col("title"), F.col("byline")).alias("ssml_title"))


@query("SELECT page_id, CASE WHEN r <> '' THEN '/' || r END AS path FROM (SELECT page_id, regexp_extract(url, '^https?://(?:[a-zA-Z0-9_-]+\\.)?(?:example\\.(?:com|net|org))/(.*)', 1) AS r FROM pages)")
def content_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.content_path(F.col("url"), HOST).alias("path"))


@query("SELECT doc_id, coalesce(source, '') AS bucket, 'audio/' || doc_id || ' ' || coalesce(lang, '') || '+.mp3' AS key FROM documents")
def object_url_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    url = T.object_url(F.coalesce("source", F.lit("")), F.concat(F.lit("audio/"), F.col("doc_id").cast("string"), F.lit("%20"), F.coalesce("lang", F.lit("")), F.lit("+.mp3")))
    return d.select("doc_id", T.parse_object_url(url).alias("o")).select("doc_id", "o.*")


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    image = F.struct(F.struct(F.col("user_id").cast("string").alias("S")).alias("uuid"), F.struct(F.concat(F.lit("/u/"), F.col("user_id").cast("string")).alias("S")).alias("url"))
    return e.select("event_id", F.when(F.col("event_type") == "signup", "INSERT").otherwise("MODIFY").alias("eventName"), F.struct(image.alias("NewImage")).alias("dynamodb"))


@query("SELECT event_id, user_id::VARCHAR AS uuid, '/u/' || user_id AS url FROM events WHERE event_type = 'signup'")
def change_inserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return callbacks.inserted(_changes(spark, sf_dir))


def _notifications(events: DataFrame) -> DataFrame:
    key = F.concat(F.when(F.col("event_id") % 2 == 0, "audio/").otherwise("full/"), F.col("user_id").cast("string"), F.lit("%20.mp3"))
    s3 = F.struct(F.struct(F.lit(BUCKET).alias("name")).alias("bucket"), F.struct(key.alias("key")).alias("object"))
    name = F.when(F.col("event_type") == "purchase", "ObjectCreated:Put").otherwise("ObjectCreated:Copy")
    return events.select(*[c for c in ("event_id", "slot") if c in events.columns], name.alias("eventName"), s3.alias("s3"))


@query("SELECT event_id, 'https://s3.us-east-1.amazonaws.com/bucket/audio/' || user_id || '%20.mp3' AS url FROM events WHERE event_type = 'purchase' AND event_id % 2 = 0")
def put_notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return callbacks.put_urls(_notifications(e))


@query("SELECT 'https://s3.us-east-1.amazonaws.com/bucket/audio/' || user_id || '%20.mp3' AS url FROM events WHERE event_type = 'purchase' AND event_id % 2 = 0")
def stream_notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, sf_dir, callbacks.put_urls, lambda events: _notifications(events).drop("event_id"))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def props_unwrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


def _fanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.fan_out(articles(spark, sf_dir))


@query(f"SELECT doc_id, code, doc_id || '-' || code AS execution_name FROM documents CROSS JOIN {_LANGUAGES}")
def language_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fanned(spark, sf_dir).select(F.col("uuid").alias("doc_id"), F.col("language.code").alias("code"), "execution_name")


@query(f"SELECT doc_id, code, CASE WHEN translate <> 'en' THEN 'translate' ELSE 'synthesise' END AS route FROM documents CROSS JOIN {_LANGUAGES}")
def route_translate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fanned(spark, sf_dir).select(F.col("uuid").alias("doc_id"), F.col("language.code").alias("code"), plan.route(F.col("language.translate")).alias("route"))


@query(f"SELECT doc_id, code, voice FROM documents CROSS JOIN {_LANGUAGES}")
def voice_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.col("language.code")
    return _fanned(spark, sf_dir).select(F.col("uuid").alias("doc_id"), code.alias("code"), plan.pick_voice(F.col("language.items"), F.col("uuid"), code)["name"].alias("voice"))


@query(f"SELECT doc_id, code, voice || ' ' || ('0x' || md5(doc_id || chr(31) || code)[1:8])::BIGINT % 3 AS voice FROM documents CROSS JOIN {_LANGUAGES}")
def voice_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of three voices for each language."""
    code = F.col("language.code")
    voices = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.struct(F.concat_ws(" ", F.col("language.items")[0]["name"], k.cast("string")).alias("name")))
    return _fanned(spark, sf_dir).select(F.col("uuid").alias("doc_id"), code.alias("code"), plan.pick_voice(voices, F.col("uuid"), code)["name"].alias("voice"))


@query(f"SELECT doc_id, code, CASE WHEN translate <> 'en' THEN '[' || translate || '] ' ELSE '' END || {_TITLE} AS title, CASE WHEN translate <> 'en' THEN '[' || translate || '] ' ELSE '' END || coalesce(source, '') AS byline, md5(CASE WHEN translate <> 'en' THEN '[' || translate || '] ' ELSE '' END || coalesce(text, '')) AS text_md5 FROM documents CROSS JOIN {_LANGUAGES}")
def translated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.translate(_fanned(spark, sf_dir)).select(F.col("uuid").alias("doc_id"), F.col("language.code").alias("code"), "title", "byline", F.md5("text").alias("text_md5"))


@query(f"""
WITH g AS ({_GROUP_ROWS}), t AS (SELECT doc_id, '<speak>' || {_ESCAPE.format(_TITLE)} || '<p>' || {_ESCAPE.format("coalesce(source, '')")} || '</p></speak>' AS ssml FROM documents),
p AS (SELECT doc_id, 0 AS place, 'title' AS text_type, ssml FROM t UNION ALL SELECT doc_id, group_no, 'paragraph', ssml FROM g)
SELECT doc_id, code AS language_code, place, text_type, md5(ssml) AS ssml_md5, voice, 'neural' AS engine, 'ssml' AS input_type, 'mp3' AS output_format, 'audio/' AS key_prefix FROM p CROSS JOIN {_LANGUAGES}
""")
def synthesis_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = plan.requests(plan.prepare(plan.fan_out(plan.pack(articles(spark, sf_dir)))))
    return asked.withColumn("ssml_md5", F.md5("ssml")).withColumnRenamed("uuid", "doc_id").drop("ssml")


@query("SELECT min(page_id) AS page_id, url FROM pages GROUP BY url")
def lookup_by_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.first_by(table(spark, sf_dir, "pages").select("page_id", "url"), "url", ["page_id"]).select("page_id", "url")


def _content(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    entry = F.create_map(F.lit("en-US"), F.struct(T.object_url(F.lit(BUCKET), F.concat(F.lit("full/"), F.col("c_custkey").cast("string"), F.lit("%20.mp3"))).alias("url")))
    return c.select(F.col("c_custkey").cast("string").alias("uuid"), F.concat(F.lit("/n/"), F.col("c_nationkey").cast("string")).alias("url"), F.when(F.col("c_custkey") % 2 == 0, entry).alias("outputs"), F.timestamp_seconds(F.col("c_custkey")).alias("createdAt"))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    name = F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("https://www.cnn.com/n/"), (F.col("event_id") % 40).cast("string"))).otherwise(F.lit(""))
    return e.select("event_id", F.when(F.col("event_id") % 5 != 0, (F.col("user_id") * 13).cast("string")).alias("contentId"), name.alias("href"), F.when(F.col("event_id") % 2 == 0, "en-US").alias("language"))


_ASKED = "SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN user_id * 13 END AS id, CASE WHEN event_id % 3 <> 0 THEN event_id % 40 END AS nation, event_id % 2 = 0 AS en FROM events"
_FOUND = f"""
WITH a AS ({_ASKED}), n AS (SELECT c_nationkey AS nation, min(c_custkey) AS first FROM customer GROUP BY 1)
SELECT a.*, coalesce(c.c_custkey, n.first) AS item FROM a LEFT JOIN customer c ON c.c_custkey = a.id LEFT JOIN n USING (nation)
"""


@query(f"SELECT event_id, item::VARCHAR AS matched_key FROM ({_FOUND})")
def lookup_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.look_up(_asked(spark, sf_dir), _content(spark, sf_dir)).select("event_id", F.col("item.uuid").alias("matched_key"))


@query(f"SELECT event_id, CASE WHEN id IS NULL AND nation IS NULL THEN 'Missing contentId or url' WHEN item IS NOT NULL THEN 'found' WHEN nation IS NULL THEN '404' ELSE 'create' END AS outcome FROM ({_FOUND})")
def request_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.outcome(catalog.look_up(_asked(spark, sf_dir), _content(spark, sf_dir))).select("event_id", "outcome")


@query(f"""
SELECT event_id, item::VARCHAR AS uuid, en AND item % 2 = 0 AS complete, CASE WHEN item % 2 = 0 THEN 'en-US' END AS code,
       CASE WHEN item % 2 = 0 THEN 'https://s3.us-east-1.amazonaws.com/bucket/full/' || item || '%20.mp3' END AS url, CASE WHEN item % 2 = 0 THEN epoch(TIMESTAMP '{NOW}')::BIGINT + 3600 ELSE 0 END AS expires_at
FROM ({_FOUND}) WHERE item IS NOT NULL
""")
def get_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = catalog.respond(catalog.look_up(_asked(spark, sf_dir), _content(spark, sf_dir)), F.lit(NOW).cast("timestamp"))
    return found.select("event_id", F.col("item.uuid").alias("uuid"), "complete", F.explode_outer("outputs").alias("o")).select("event_id", "uuid", "complete", "o.code", "o.signed.url", F.coalesce("o.signed.expires_at", F.lit(0)).alias("expires_at"))


@query(f"SELECT DISTINCT '/n/' || nation AS url, 'PENDING' AS article_status FROM ({_FOUND}) WHERE item IS NULL AND nation IS NOT NULL")
def create_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    writes = catalog.create_missing(catalog.look_up(_asked(spark, sf_dir), _content(spark, sf_dir)), F.lit(NOW).cast("timestamp"))
    return catalog.current_state(writes).select("url", "article_status")


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type = 'signup'")
    return e.select(F.col("event_id").alias("uuid"), F.col("user_id").cast("string").alias("url"), F.concat(F.lit("token-"), F.col("event_id").cast("string")).alias("token"), instant("ts").alias("createdAt"))


@query("SELECT event_id::VARCHAR AS uuid, user_id::VARCHAR AS url, 'token-' || event_id AS token FROM events WHERE event_type = 'signup' AND event_id = (SELECT max(event_id) FROM events WHERE event_type = 'signup')")
def task_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = _tasks(spark, sf_dir)
    last = tasks.agg(F.max(F.col("uuid"))).first()[0]
    return catalog.get(tasks.withColumn("uuid", F.col("uuid").cast("string")), None if last is None else str(last)).select("uuid", "url", "token")


@query("SELECT arg_min(event_id, (ts, event_id)) AS uuid, user_id::VARCHAR AS url FROM events WHERE event_type = 'signup' AND user_id = (SELECT min(user_id) FROM events WHERE event_type = 'signup') GROUP BY user_id")
def task_by_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = _tasks(spark, sf_dir)
    least = tasks.agg(F.min(F.col("url").cast("long"))).first()[0]
    return catalog.query_by_url(tasks, None if least is None else str(least)).select("uuid", "url")


@query("SELECT count(*) AS n_urls FROM events WHERE event_type = 'no such kind'")
def no_notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed without records gives none."""
    none = table(spark, sf_dir, "events").where("event_type = 'no such kind'")
    return callbacks.put_urls(_notifications(none)).agg(F.count("*").alias("n_urls"))


@query("""
WITH t AS (SELECT user_id, arg_min(event_id, (ts, event_id)) AS task_id FROM events WHERE event_type = 'signup' GROUP BY 1)
SELECT n.event_id, t.task_id, 'token-' || t.task_id AS token, 'DELIVERED' AS task_status, '{"url":"' || n.user_id || '"}' AS output FROM events n JOIN t USING (user_id) WHERE n.event_type = 'purchase'
""")
def callback_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = table(spark, sf_dir, "events").where("event_type = 'purchase'").select("event_id", F.col("user_id").cast("string").alias("url"))
    return callbacks.success(callbacks.match(urls, _tasks(spark, sf_dir))).select("event_id", F.col("task_uuid").alias("task_id"), "token", "task_status", "output")


_WITHIN = "SELECT t.event_id AS task_id, n.event_id AS event_id FROM events t JOIN events n ON n.user_id = t.user_id AND n.ts BETWEEN t.ts AND t.ts + INTERVAL {0} SECOND WHERE t.event_type = 'signup' AND n.event_type = 'purchase'"


def _two(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    of = lambda kind, id_, time: events.where(F.col("event_type") == kind).select(F.col("event_id").alias(id_), "user_id", instant("ts").alias(time))
    return of("signup", "task_id", "task_ts"), of("purchase", "event_id", "ts")


@query(_WITHIN.format(500))
def callback_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return callbacks.match_within(*_two(table(spark, sf_dir, "events")), "user_id", "task_ts", "ts").select("task_id", "event_id")


def fifth(events: DataFrame) -> Column:
    """In which fifth of the events' time one is, from 0; 0 without a time."""
    micros = F.unix_micros(instant("ts"))
    low, high = events.agg(F.min(micros), F.max(micros)).first()
    return F.lit(0) if low is None else F.coalesce(sum(((micros >= low + (high - low) * k // 5).cast("int") for k in range(1, 5)), F.lit(0)), F.lit(0))


def replayed(rows: DataFrame, slots: int, change: Callable[[str, int], DataFrame], format: str = "parquet", run: Callable[[DataFrame, str, str], object] = drain) -> DataFrame:
    """What a stream makes of rows that come slot by slot. change: given a folder and the files of a batch."""
    spark = rows.sparkSession
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    out = change(f"{path}/in", feed(rows, slots, f"{path}/in", format))
    run(out, f"{path}/out", f"{path}/checkpoint")
    delete(spark, f"{path}/in")
    delete(spark, f"{path}/checkpoint")
    return spark.read.schema(out.schema).parquet(f"{path}/out")


def _streamed(spark: SparkSession, sf_dir: str, change: Callable[[DataFrame], DataFrame], records: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The rows of a stream over the events, a fifth of their time in each batch.

    records makes of the events those of a JSON feed of notifications, in place of Parquet.
    """
    events = table(spark, sf_dir, "events")
    slotted = events.withColumn("slot", fifth(events))
    if records:
        return replayed(records(slotted), 5, lambda path, files: change(notifications(spark, path, files)), "json")
    return replayed(slotted, 5, lambda path, files: change(stream(spark, path, events.schema, "parquet", files)))


@query(_WITHIN.format(7200))
def stream_callback_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, sf_dir, lambda events: resolve(*_two(events), "user_id", "task_ts", "ts", 7200).select("task_id", "event_id"))


@query("SELECT event_id, user_id FROM events WHERE event_type = 'signup'")
def stream_change_inserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    def change(events: DataFrame) -> DataFrame:
        inserts = events.where("event_type = 'signup'").select("event_id", "user_id", instant("ts").alias("ts"))
        # the feed brings each event twice, but those without a time, which no watermark reaches
        again = inserts.where("ts IS NOT NULL")
        return once(inserts.unionByName(again), ["event_id"], "ts").select("event_id", "user_id")

    return _streamed(spark, sf_dir, change)


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as writes: signup puts, error deletes, the others update a column each."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("uuid"), "event_type", F.col("event_id").alias("seq"), instant("ts").alias("at"), F.col("event_id").cast("string").alias("title"), F.concat(F.lit("/u/"), F.col("user_id").cast("string")).alias("url"))
    of = lambda kind: e.where(F.col("event_type") == kind)
    at = F.col("at")
    return catalog.write_log([
        catalog.create_content(of("signup"), at), catalog.delete(of("error"), at), catalog.update_title(of("click"), at),
        catalog.update_content_status(of("view"), "FAILED", at), catalog.update_outputs(of("purchase").withColumn("outputs", F.create_map(F.lit("en-US"), F.struct(F.col("title").alias("url")))), at),
    ])


@query("""
WITH r AS (SELECT user_id, max(event_id) FILTER (event_type IN ('signup', 'error')) AS reset FROM events GROUP BY 1),
e AS (SELECT e.*, coalesce(r.reset, -1) AS reset FROM events e JOIN r USING (user_id) WHERE event_id >= coalesce(r.reset, -1))
SELECT user_id AS uuid, arg_max(CASE event_type WHEN 'signup' THEN 'PENDING' WHEN 'view' THEN 'FAILED' END, event_id) FILTER (event_type IN ('signup', 'view')) AS article_status,
       max(event_id) FILTER (event_type = 'click')::VARCHAR AS title, max(event_id) FILTER (event_type = 'purchase')::VARCHAR AS en_url,
       strftime(date_trunc('milliseconds', max(ts) FILTER (event_type = 'signup')), '%Y-%m-%dT%H:%M:%S.%gZ') AS created_at, strftime(date_trunc('milliseconds', arg_max(ts, event_id)), '%Y-%m-%dT%H:%M:%S.%gZ') AS updated_at
FROM e GROUP BY 1 HAVING bool_or(event_type <> 'error')
""")
def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = catalog.current_state(log(spark, sf_dir))
    return state.select("uuid", "article_status", "title", F.col("outputs")["en-US"]["url"].alias("en_url"), T.iso_time(F.col("createdAt")).alias("created_at"), T.iso_time(F.col("updatedAt")).alias("updated_at"))


@query(f"SELECT event_id, ttl, ttl <= epoch(TIMESTAMP '{NOW}')::BIGINT AS expired FROM (SELECT event_id, floor(epoch(ts))::BIGINT + 500 AS ttl FROM events)")
def ttl_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = T.ttl(instant("ts"))
    return table(spark, sf_dir, "events").select("event_id", at.alias("ttl"), (at <= F.unix_timestamp(F.lit(NOW).cast("timestamp"))).alias("expired"))


@query("SELECT event_id, strftime(date_trunc('milliseconds', ts), '%Y-%m-%dT%H:%M:%S.%gZ') AS iso FROM events")
def iso_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", T.iso_time(instant("ts")).alias("iso"))


def finished(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as finished merges: source the article, language the code."""
    code = F.element_at(F.create_map([F.lit(x) for c in CODES for x in (c[:2], c)]), F.col("lang"))
    rows = articles(spark, sf_dir).where("lang IS NOT NULL AND source IS NOT NULL")
    return rows.select(F.col("source").alias("uuid"), code.alias("language"), T.object_url(F.lit(BUCKET), F.concat(F.lit("full/"), F.col("uuid").cast("string"))).alias("output_url"), F.col("uuid").alias("seq"))


@query(f"SELECT source, {CODE_OF} AS code, 'https://s3.us-east-1.amazonaws.com/bucket/full/' || max(doc_id) AS url FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY ALL")
def outputs_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = manifest.outputs(finished(spark, sf_dir), "seq")
    return have.select(F.col("uuid").alias("source"), F.explode("outputs").alias("code", "o")).select("source", "code", F.col("o.url").alias("url"))


@query(f"SELECT source, 5 - count(DISTINCT {CODE_OF})::INT AS n_missing, count(DISTINCT {CODE_OF}) = 5 AS complete, bool_or(lang = 'en') AS has_english FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY 1")
def languages_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = manifest.outputs(finished(spark, sf_dir), "seq")
    outputs = F.col("outputs")
    return have.select(F.col("uuid").alias("source"), T.missing_languages(outputs, CODES).alias("n_missing"), T.all_languages(outputs, CODES).alias("complete"), T.languages_present(outputs, F.lit("en-US"), CODES).alias("has_english"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    place = (F.row_number().over(_turns()) - 1).alias("place")
    url = T.object_url(F.lit(BUCKET), F.concat(F.lit("audio/"), F.col("conv_id").cast("string"), F.lit("."), F.col("turn").cast("string"), F.lit(".mp3")))
    return c.select(F.col("conv_id").alias("uuid"), F.lit("en-US").alias("language"), place, url.alias("url"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))


def _turns():
    from pyspark.sql import Window

    return Window.partitionBy("conv_id").orderBy("turn", "role", "text")


ORDER = "(SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n FROM conversations)"


@query(f"SELECT conv_id, string_agg('file ''' || conv_id || '.' || turn || '.mp3''', chr(10) ORDER BY n) AS manifest FROM {ORDER} GROUP BY 1")
def merge_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    merges = manifest.keys(manifest.assemble(segments(spark, sf_dir)), BUCKET)
    return merges.select(F.col("uuid").alias("conv_id"), manifest.file_list(F.col("inputs")).alias("manifest"))


@query(f"SELECT conv_id, md5(string_agg(coalesce(text, ''), '' ORDER BY n)) AS content_md5 FROM {ORDER} GROUP BY 1")
def merge_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.concatenated(segments(spark, sf_dir)).select(F.col("uuid").alias("conv_id"), F.md5("content").alias("content_md5"))


@query(f"SELECT conv_id, 'full/' || conv_id || '-en-US.mp3' AS key, strlen(string_agg(coalesce(text, ''), '' ORDER BY n))::BIGINT AS length, md5(string_agg(coalesce(text, ''), '' ORDER BY n)) AS content_md5 FROM {ORDER} GROUP BY 1")
def uploaded_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments are put as objects, merged by article into others, and these are read again."""
    bucket = f"{shared_dir(spark)}/bucket-{uuid.uuid4().hex}"
    parts = segments(spark, sf_dir).withColumn("key", T.object_key(F.col("url"), BUCKET))
    upload(parts.select("key", "content"), bucket).write.format("noop").mode("overwrite").save()
    merges = manifest.keys(manifest.assemble(parts), BUCKET)
    manifest.merge_objects(merges, bucket).write.format("noop").mode("overwrite").save()
    merged = objects(spark, bucket, "full/")
    return merged.select(F.regexp_extract("key", r"full/(-?\d+)-", 1).cast("long").alias("conv_id"), "key", "length", F.md5("content").alias("content_md5"))


@query(f"""
SELECT conv_id, 'full/' || conv_id || '-en-US.mp3' AS output_key, conv_id % 7 <> 0 AS succeeded, CASE WHEN conv_id % 7 = 0 THEN 'no disk' END AS error,
       CASE WHEN conv_id % 7 = 0 THEN '{{"uuid":' || conv_id || '}}' ELSE '{{"uuid":' || conv_id || ',"outputs":{{"en-US":{{"url":"https://s3.us-east-1.amazonaws.com/bucket/full/' || conv_id || '-en-US.mp3"}}}}}}' END AS output
FROM (SELECT DISTINCT conv_id FROM conversations)
""")
def merge_callbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = manifest.finish(manifest.assemble(segments(spark, sf_dir)), BUCKET, F.when(F.col("uuid") % 7 == 0, "no disk"))
    return done.select(F.col("uuid").alias("conv_id"), "output_key", "succeeded", "error", "output")


@query(f"SELECT conv_id, string_agg(text, chr(10) ORDER BY n) AS text FROM {ORDER} GROUP BY 1")
def thread_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "text", F.struct("turn", "role", "text").alias("place"))
    return manifest.ordered_text(c, "conv_id", "place", "text")


def _resolved(html: str) -> str:
    """SQL: the text of HTML without tags, trimmed."""
    for sign, name in (("\"", "quot"), ("<", "lt"), (">", "gt"), ("&", "amp")):
        html = f"regexp_replace({html}, '&{name};?', '{sign}', 'g')"
    return f"regexp_replace({html}, '^\\s+|\\s+$', '', 'g')"


_PARAGRAPHS = f"""
SELECT page_id, url, {_resolved("regexp_extract(html, '<h1>(.*?)</h1>', 1, 's')")} AS title,
       list_transform(string_split(regexp_extract(html, '<article>(.*)</article>', 1, 's'), '<p>')[2:], lambda x: {_resolved("regexp_replace(string_split(x, '</p>')[1], '<[^>]*>', '', 'g')")}) AS parts
FROM pages
"""


@query(f"SELECT page_id, url, title, '' AS byline, array_to_string(parts, chr(10)) AS text, NULL::VARCHAR AS error FROM ({_PARAGRAPHS})")
def pages_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site.extract(table(spark, sf_dir, "pages"), site.Selectors("h1", ".byline", "article p", skip_last=False))


@query(f"SELECT page_id, array_to_string(parts[:-2], chr(10)) AS text FROM ({_PARAGRAPHS})")
def pages_extract_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site.extract(table(spark, sf_dir, "pages"), site.Selectors("h1", ".byline", "article p")).select("page_id", "text")


@query(f"SELECT page_id AS uuid, url, CASE WHEN page_id % 3 <> 0 THEN md5(array_to_string(parts[:-2], chr(10))) END AS text_md5, CASE WHEN page_id % 3 = 0 THEN 'no page' END AS error FROM ({_PARAGRAPHS})")
def fetched_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    asked = pages.select(F.col("page_id").alias("uuid"), "url")
    selectors = site.Selectors("h1", ".byline", "article p")
    good, bad = site.split_failures(site.extract(site.fetch(asked, pages.where("page_id % 3 <> 0"), site=""), selectors))
    return good.select("uuid", "url", F.md5("text").alias("text_md5"), F.lit(None).cast("string").alias("error")).unionByName(bad, allowMissingColumns=True)


@query("SELECT event_id, 'task-' || user_id AS uuid, 'u' || event_id AS url, 't' || event_id AS token FROM events WHERE event_type IN ('click', 'view') AND event_id % 3 <> 0")
def wait_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    audio = F.struct(F.struct(F.concat(F.lit("task-"), F.col("user_id").cast("string")).alias("TaskId"), F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("u"), F.col("event_id").cast("string"))).otherwise(F.lit("")).alias("OutputUri")).alias("SynthesisTask"))
    kind = F.when(F.col("event_type") == "click", "title").when(F.col("event_type") == "view", "paragraph").otherwise("other")
    title, paragraph = F.when(kind == "title", audio), F.when(kind == "paragraph", audio)
    return callbacks.waiting(e.select("event_id", kind.alias("textType"), F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("token"), title.alias("title"), paragraph.alias("audioOutput")))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'c' || user_id ELSE 'p' || user_id END AS content_id, CASE WHEN event_id % 2 = 0 THEN 'https://www.cnn.com/' || user_id END AS href, CASE WHEN event_id % 2 = 0 THEN 'fr-FR' END AS language FROM events")
def sanitised_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.col("user_id").cast("string")
    body = F.to_json(F.struct(F.concat(F.lit("c"), user).alias("contentId"), F.concat(F.lit("https://www.cnn.com/"), user).alias("url"), F.lit("fr-FR").alias("language")))
    post = F.col("event_id") % 2 == 0
    e = table(spark, sf_dir, "events").select("event_id", F.when(post, "POST").otherwise("GET").alias("httpMethod"), F.struct(F.concat(F.lit("p"), user).alias("contentId")).alias("pathParameters"), F.when(post, body).alias("body"))
    return catalog.sanitise(e).withColumnRenamed("contentId", "content_id")


@query("SELECT event_id, 200 AS status_code, '{\"event_id\":' || event_id || '}' AS body FROM events")
def http_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", catalog.http_output(F.lit(200), F.struct("event_id")).alias("o")).select("event_id", F.col("o.statusCode").alias("status_code"), "o.body")


@query(f"SELECT count(*) AS n_tasks, count(DISTINCT ssml || code || voice) AS n_distinct FROM (SELECT ssml, code, voice FROM ({_GROUP_ROWS}) CROSS JOIN {_LANGUAGES})")
def synthesis_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = plan.requests(plan.prepare(plan.fan_out(plan.pack(articles(spark, sf_dir))))).where("text_type = 'paragraph'")
    done = plan.synthesise(asked, providers.hashed_synthesis(BUCKET))
    return done.agg(F.count("audioOutput.SynthesisTask.TaskId").alias("n_tasks"), F.countDistinct("audioOutput.SynthesisTask.OutputUri").alias("n_distinct"))


@query(f"""
SELECT doc_id || '-' || code AS name, md5(json_object('uuid', doc_id, 'url', '/a/' || doc_id, 'title', {_TITLE}, 'text', coalesce(text, ''), 'byline', coalesce(source, ''), 'language', json_object('code', code, 'voice', voice, 'translate', translate))::VARCHAR) AS input_md5
FROM documents CROSS JOIN {_LANGUAGES}
""")
def execution_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    language = F.struct("language.code", F.get("language.items", F.lit(0))["name"].alias("voice"), "language.translate")
    started = plan.executions(_fanned(spark, sf_dir).withColumn("language", language))
    return started.select("name", F.md5("input").alias("input_md5"))


@query("SELECT o_custkey::VARCHAR AS uuid, max(o_orderkey)::VARCHAR AS article_id, 'fr-FR' AS language, 'merge' AS type, 'RENDERED' AS article_status FROM orders GROUP BY o_custkey")
def merge_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    rows = orders.select(F.col("o_custkey").cast("string").alias("uuid"), F.col("o_orderkey").cast("string").alias("article_id"), F.lit("/m").alias("url"), F.lit("fr-FR").alias("language"), F.col("o_orderkey").alias("seq"))
    return catalog.current_state(catalog.create_merge_job(rows, F.lit(NOW).cast("timestamp"))).select("uuid", "article_id", "language", "type", "article_status")


@query("""
WITH u AS (SELECT user_id, max(event_id) FILTER (event_type = 'signup') AS put, max(event_id) FILTER (event_type = 'purchase') AS done FROM events GROUP BY 1)
SELECT u.user_id AS uuid, CASE WHEN done > coalesce(put, -1) THEN 'DELIVERED' ELSE 'PENDING' END AS task_status, 'token-' || put AS token, floor(epoch(e.ts))::BIGINT + 500 AS ttl
FROM u LEFT JOIN events e ON e.event_id = u.put WHERE put IS NOT NULL OR done IS NOT NULL
""")
def task_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("uuid"), "event_type", F.col("event_id").alias("seq"), instant("ts").alias("at"), F.lit("/u").alias("url"), F.concat(F.lit("token-"), F.col("event_id").cast("string")).alias("token"))
    created = catalog.create_task(e.where("event_type = 'signup'"), F.col("at"))
    delivered = catalog.update_task_status(e.where("event_type = 'purchase'"), "DELIVERED", F.col("at"))
    return catalog.current_state(catalog.write_log([created, delivered])).select("uuid", "task_status", "token", "ttl")


@query("SELECT event_id, CASE WHEN event_type = 'click' THEN 'u' || event_id END AS title, CASE WHEN event_type = 'view' THEN 'u' || event_id END AS paragraph_url FROM events WHERE event_type IN ('click', 'view')")
def resumed_waits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type IN ('click', 'view')")
    waited = e.select("event_id", F.when(F.col("event_type") == "click", "title").otherwise("paragraph").alias("text_type"), F.concat(F.lit("u"), F.col("event_id").cast("string")).alias("url"))
    return callbacks.selected(waited).select("event_id", "title", F.col("paragraph.url").alias("paragraph_url"))


@query("SELECT n.event_id FROM events n WHERE n.event_type = 'purchase' AND NOT EXISTS (SELECT 1 FROM events t WHERE t.event_type = 'signup' AND t.user_id = n.user_id AND t.event_id % 50 = 0)")
def callback_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = table(spark, sf_dir, "events").where("event_type = 'purchase'").select("event_id", F.col("user_id").cast("string").alias("url"))
    return callbacks.unmatched(urls, _tasks(spark, sf_dir).where("uuid % 50 = 0")).select("event_id")


@query("SELECT doc_id, regexp_replace(chr(160) || chr(9) || coalesce(text, '') || chr(8195) || chr(10), '^[\\s\\p{Z}\\x{feff}]+|[\\s\\p{Z}\\x{feff}]+$', '', 'g') AS trimmed FROM documents")
def trimmed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded = F.concat(F.lit("\u00a0\t"), F.coalesce("text", F.lit("")), F.lit("\u2003\n"))
    return table(spark, sf_dir, "documents").select("doc_id", T.trim(padded).alias("trimmed"))


@query("SELECT page_id, h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] AS uuid FROM (SELECT page_id, sha256(url) AS h FROM pages)")
def content_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.content_id(F.col("url")).alias("uuid"))


@query(f"""
SELECT conv_id, 'https://s3.us-east-1.amazonaws.com/bucket/audio/' || conv_id || '.' || arg_min(turn, n) || '.mp3' AS title, count(*) - 1 AS n_text, 'token-' || conv_id AS token,
       '{{"uuid":' || conv_id || ',"outputs":{{"de-DE":{{"url":"old"}},"en-US":{{"url":"https://s3.us-east-1.amazonaws.com/bucket/full/' || conv_id || '-en-US.mp3"}}}}}}' AS output
FROM {ORDER} GROUP BY conv_id
""")
def merge_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent = manifest.payloads(manifest.assemble(segments(spark, sf_dir)), F.concat(F.lit("token-"), F.col("uuid").cast("string")))
    had = F.create_map(*[x for code in ("de-DE", "en-US") for x in (F.lit(code), F.struct(F.lit("old").alias("url")))])
    done = manifest.finish(sent.withColumn("outputs", had), BUCKET)
    return done.select(F.col("uuid").alias("conv_id"), "title", F.size("text").cast("long").alias("n_text"), "token", "output")
