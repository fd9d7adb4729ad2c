"""Queries over what is kept: state of streams, snapshots, indexes and logs, on the same tables as `queries`."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import signing, typed
from ..functions import text as T
from ..functions.languages import CODES
from ..operators import catalog, manifest
from ..operators.attempts import Attempts
from ..operators.items import Items
from ..operators.providers import Retry
from ..sources import expiring, selectors
from ..sources.pages import Selectors
from ..sources.tables import shared_dir, spread, stream, table
from ..streaming import state
from ..streaming.flows import instant
from .queries import BUCKET, CODE_OF, NOW, ORDER, SQL, fifth, finished, log, query, replayed, segments

#: A time after all events, which moves the watermark past them.
_END = "2100-01-01 00:00:00"
_DAY = 86_400


@query(f"""
WITH b AS (SELECT min(epoch_us(ts)) AS low, max(epoch_us(ts)) AS high FROM events),
e AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS us FROM events, b WHERE event_id % 97 <> 0 OR epoch_us(ts) >= low + (high - low) // 5),
t AS (SELECT * FROM e WHERE event_type = 'signup'), n AS (SELECT * FROM e WHERE event_type = 'purchase'),
m AS (SELECT n.event_id, n.user_id, n.us, arg_min(t.event_id, (t.us, t.event_id::VARCHAR)) AS task FROM n LEFT JOIN t ON t.user_id = n.user_id AND t.us <= n.us AND n.us <= t.us + {_DAY}000000 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY us, event_id::VARCHAR) AS k FROM m)
SELECT user_id, CASE WHEN task IS NULL THEN 'unmatched' WHEN k = 1 THEN 'resumed' ELSE 'duplicate' END AS outcome, task AS task_id, CASE WHEN task IS NOT NULL AND k = 1 THEN 'token-' || task END AS token, event_id, us AS at_us FROM r
UNION ALL SELECT user_id, 'expired', event_id, 'token-' || event_id, NULL, us + {_DAY}000000 FROM t WHERE event_id NOT IN (SELECT task FROM m WHERE task IS NOT NULL)
""")
def stream_callback_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signups wait for purchases of their user. Every seventh event comes a batch late, within the lateness; some of the first fifth come last and are dropped."""
    events = table(spark, sf_dir, "events").where("ts IS NOT NULL AND event_type IN ('signup', 'purchase')")
    part = fifth(table(spark, sf_dir, "events"))
    moved = F.when((F.col("event_id") % 97 == 0) & (part == 0), 4).when(F.col("event_id") % 7 == 0, F.least(part + 1, F.lit(4))).otherwise(part)
    id_, put = F.col("event_id").cast("string"), F.col("event_type") == "purchase"
    rows = events.select(moved.alias("slot"), F.col("user_id").cast("string").alias("url"), instant("ts").alias("at"), put.alias("put"), id_.alias("id"), F.when(~put, F.concat(F.lit("token-"), id_)).alias("token"))
    end = spark.range(1).select(F.lit(5).alias("slot"), F.lit("end").alias("url"), F.lit(_END).cast("timestamp").alias("at"), F.lit(True).alias("put"), F.lit("end").alias("id"), F.lit(None).cast("string").alias("token"))
    rows = rows.unionByName(end)
    got = replayed(rows, 6, lambda path, files: state.answers(stream(spark, path, rows.drop("slot").schema, "parquet", files), _DAY, "7 days"), run=state.started)
    return got.select(F.col("url").cast("long").alias("user_id"), "outcome", F.col("task_uuid").cast("long").alias("task_id"), "token", F.col("notification").cast("long").alias("event_id"), F.unix_micros("at").alias("at_us"))


@query(f"SELECT conv_id, string_agg('file ''' || conv_id || '.' || turn || '.mp3''', chr(10) ORDER BY n) AS manifest FROM {ORDER} GROUP BY 1")
def stream_merge_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments come in four batches in any order, some twice, and so does what says how many there are."""
    parts = segments(spark, sf_dir).select(F.col("uuid").cast("string").alias("uuid"), "language", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("uuid") % 600).alias("at"), F.lit(None).cast("int").alias("expected"), F.col("place").cast("int").alias("place"), "url")
    plans = parts.groupBy("uuid", "language", "at").agg(F.count("*").cast("int").alias("expected")).withColumns({"place": F.lit(None).cast("int"), "url": F.lit(None).cast("string")})
    again = parts.where(F.pmod(F.xxhash64("url"), F.lit(11)) == 0)
    rows = parts.withColumn("n", F.lit(0)).unionByName(plans.withColumn("n", F.lit(1))).unionByName(again.withColumn("n", F.lit(2)))
    rows = rows.withColumn("slot", F.pmod(F.xxhash64("uuid", "place", "n"), F.lit(4)).cast("int")).drop("n")
    got = replayed(rows, 4, lambda path, files: state.manifests(stream(spark, path, rows.drop("slot").schema, "parquet", files), 3600, "1 hour"), run=state.started)
    merges = manifest.keys(got.where("missing = 0"), BUCKET)
    return merges.select(F.col("uuid").cast("long").alias("conv_id"), manifest.file_list(F.col("inputs")).alias("manifest"))


@query(f"SELECT source AS uuid, 4 AS languages FROM (SELECT source, {CODE_OF} AS code FROM documents WHERE source IS NOT NULL) WHERE code <> 'pt-BR' GROUP BY source HAVING count(DISTINCT code) = 4")
def stream_completed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents finish languages of their source, of which the tables have four, in five batches."""
    codes = tuple(c for c in CODES if c != "pt-BR")
    rows = finished(spark, sf_dir).select("uuid", "language", F.pmod(F.xxhash64("seq"), F.lit(5)).cast("int").alias("slot"))
    return replayed(rows, 5, lambda path, files: state.completed(stream(spark, path, rows.drop("slot").schema, "parquet", files), codes), run=state.started)


def _items(spark: SparkSession, columns: str) -> Items:
    return Items(spark, f"{shared_dir(spark)}/items-{uuid.uuid4().hex}", columns, buckets=4)


@query(SQL["latest_state"])
def snapshot_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The writes come in three batches in any order; each rewrites the buckets of its keys."""
    items = _items(spark, schemas.CONTENT_COLUMNS)
    writes = log(spark, sf_dir).withColumn("uuid", F.col("uuid").cast("string"))
    for k in range(3):
        items.write(writes.where(F.pmod(F.xxhash64("seq"), F.lit(3)) == k))
    state_ = items.state()
    return state_.select(F.col("uuid").cast("long").alias("uuid"), "article_status", "title", F.col("outputs")["en-US"]["url"].alias("en_url"), T.iso_time(F.col("createdAt")).alias("created_at"), T.iso_time(F.col("updatedAt")).alias("updated_at"))


@query("SELECT min(page_id) AS page_id, url FROM pages WHERE page_id % 5 <> 0 AND url IN (SELECT url FROM pages WHERE page_id % 9 = 0) GROUP BY url")
def index_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages are put by a batch, and every fifth is deleted by another; the index of URLs answers for the URLs of every ninth."""
    items = _items(spark, "url string, createdAt timestamp, article_status string, updatedAt timestamp")
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("uuid"), "url", "page_id")
    at = F.timestamp_seconds(F.col("page_id"))
    items.write(catalog.create_content(pages, at))
    items.write(catalog.delete(pages.where("page_id % 5 = 0").withColumn("seq", F.lit(1 << 60)), at))
    found = items.first_by_url(pages.where("page_id % 9 = 0"))
    return found.select(F.col("uuid").cast("long").alias("page_id"), "url")


@query(SQL["ttl_expired"])
def expiring_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events are tasks laid out by when they expire, a slot a day; slots that are over are dropped, and those that live are read."""
    path = f"{shared_dir(spark)}/tasks-{uuid.uuid4().hex}"
    tasks = table(spark, sf_dir, "events").select("event_id", T.ttl(instant("ts")).alias("ttl"))
    now = int(spark.range(1).select(F.unix_timestamp(F.lit(NOW).cast("timestamp"))).first()[0])
    expiring.add(tasks, path, _DAY)
    expiring.expire(spark, path, now, _DAY)
    live = expiring.live(spark, path, "event_id bigint, ttl bigint", now, _DAY).select("event_id", F.lit(False).alias("expired"))
    expired = F.when(F.col("ttl").isNotNull(), F.coalesce("expired", F.lit(True)))
    return tasks.join(live, "event_id", "left").select("event_id", "ttl", expired.alias("expired"))


@query("""
SELECT 'event' AS kind, event_id AS id, coalesce(event_type, '') || '/' || coalesce(props, '') AS name, value AS number, value > 50 AS flag, user_id::VARCHAR AS inner_text, event_id % 3 = 0 AS empty FROM events
UNION ALL SELECT 'customer', c_custkey, coalesce(c_name, '') || '/' || coalesce(c_mktsegment, ''), c_acctbal::DOUBLE, c_acctbal > 0, c_nationkey::VARCHAR, c_custkey % 3 = 0 FROM customer
""")
def typed_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and customers as items with nested typed values, and these decoded again, with no schema."""
    e, c = table(spark, sf_dir, "events"), table(spark, sf_dir, "customer")
    rows = [
        ("event", e, F.col("event_id"), F.concat(F.coalesce("event_type", F.lit("")), F.lit("/"), F.coalesce("props", F.lit(""))), F.col("value"), F.col("value") > 50, F.col("user_id")),
        ("customer", c, F.col("c_custkey"), F.concat(F.coalesce("c_name", F.lit("")), F.lit("/"), F.coalesce("c_mktsegment", F.lit(""))), F.col("c_acctbal").cast("double"), F.col("c_acctbal") > 0, F.col("c_nationkey")),
    ]
    out = []
    for kind, rows_, id_, name, number, flag, inner in rows:
        deep = F.array(F.struct(inner.cast("string").alias("S"), F.array(inner.cast("long")).alias("M")))
        item = F.struct(id_.cast("long").alias("id"), name.alias("name"), number.alias("number"), flag.alias("flag"), F.struct(deep.alias("L"), F.when(id_ % 3 != 0, "there").alias("none")).alias("nested"))
        images = rows_.select(item.alias("item"))
        image = images.select(typed.encoded_item(F.col("item"), images.schema["item"].dataType).alias("image"))
        v = typed.decoded_item(F.col("image"), 5)
        of = lambda path, as_, v=v: F.try_variant_get(F.col("v"), path, as_)
        out.append(image.select(v.alias("v")).select(F.lit(kind).alias("kind"), of("$.id", "long").alias("id"), of("$.name", "string").alias("name"), of("$.number", "double").alias("number"), of("$.flag", "boolean").alias("flag"), of("$.nested.L[0].S", "string").alias("inner_text"), of("$.nested.none", "string").isNull().alias("empty")))
    return out[0].unionByName(out[1])


_KEY, _SECRET = "AKIDEXAMPLE", "wJalrXUtnFEMI/K7MDENG+bPxRfiCYEXAMPLEKEY"


def _hmac_sql(key: str, message: str) -> str:
    """DuckDB: the HMAC of a message under a key of up to 64 bytes, columns or expressions of bytes."""
    block = f"unhex(rpad(hex({key}), 128, '0'))::BIT"
    pad = lambda byte: f"xor({block}, unhex(repeat('{byte}', 64))::BIT)::BLOB"
    return f"unhex(sha256({pad('5C')} || unhex(sha256({pad('36')} || {message}))))"


def _signed_sql() -> str:
    time = f"strftime(TIMESTAMP '{NOW}', '%Y%m%dT%H%M%SZ')"
    scope = f"strftime(TIMESTAMP '{NOW}', '%Y%m%d') || '/us-east-1/s3/aws4_request'"
    steps = ["k0 AS (SELECT encode('AWS4" + _SECRET + "') AS key)"]
    parts = (f"strftime(TIMESTAMP '{NOW}', '%Y%m%d')", "'us-east-1'", "'s3'", "'aws4_request'")
    steps += [f"k{k} AS (SELECT {_hmac_sql('key', f'encode({part})')} AS key FROM k{k - 1})" for k, part in enumerate(parts, 1)]
    query_ = f"'X-Amz-Algorithm=AWS4-HMAC-SHA256&X-Amz-Credential={_KEY}%2F' || replace({scope}, '/', '%2F') || '&X-Amz-Date=' || {time} || '&X-Amz-Expires=3600&X-Amz-SignedHeaders=host'"
    return f"""
WITH {", ".join(steps)},
o AS (SELECT c_custkey, '/full/' || c_custkey || '%20%C3%A9.mp3' AS path, {query_} AS query FROM customer),
r AS (SELECT *, 'AWS4-HMAC-SHA256' || chr(10) || {time} || chr(10) || {scope} || chr(10) || sha256('GET' || chr(10) || path || chr(10) || query || chr(10) || 'host:{BUCKET}.s3.us-east-1.amazonaws.com' || chr(10) || chr(10) || 'host' || chr(10) || 'UNSIGNED-PAYLOAD') AS to_sign FROM o)
SELECT c_custkey, 'https://{BUCKET}.s3.us-east-1.amazonaws.com' || path || '?' || query || '&X-Amz-Signature=' || lower(hex({_hmac_sql("k4.key", "encode(to_sign)")})) AS url, epoch(TIMESTAMP '{NOW}')::BIGINT + 3600 AS expires_at
FROM r, k4
"""


@query(_signed_sql())
def signed_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An output of each customer, signed for an hour from now."""
    url = T.object_url(F.lit(BUCKET), F.concat(F.lit("full/"), F.col("c_custkey").cast("string"), F.lit("%20%C3%A9.mp3")))
    done = T.signed(url, F.lit(NOW).cast("timestamp"), signer=signing.presigner(_KEY, _SECRET))
    return spread(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey").select("c_custkey", done.alias("o")).select("c_custkey", "o.url", "o.expires_at")


@query("""
SELECT event_id, least(f + 1, 4)::INT AS attempts, least(f + 1, 4) AS n_calls, CASE WHEN f > 3 THEN 'dead' ELSE 'done' END AS outcome, CASE WHEN f <= 3 THEN 'r' || event_id END AS response, [0, 2, 6, 14][least(f + 1, 4)]::BIGINT AS ended_at
FROM (SELECT event_id, event_id % 6 AS f FROM events WHERE event_type = 'error')
""")
def attempt_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests whose first calls fail, up to five times, under a rule of three retries after 2, 4 and 8 seconds."""

    def call(key: str, payload: str, attempt: int) -> str:
        if attempt <= int(payload):
            raise OSError("busy")
        return f"r{key}"

    asked = table(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("event_id").cast("string").alias("key"), (F.col("event_id") % 6).cast("string").alias("payload"))
    log_ = Attempts(spark, f"{shared_dir(spark)}/attempts-{uuid.uuid4().hex}", Retry(3, 2, 2), buckets=4)
    now, rounds = 0, []
    while now is not None:  # as often as the rule has attempts
        rounds.append(log_.round(asked, call, now).select("key", F.lit(now).cast("long").alias("at")))
        now = log_.next_due()
    calls = rounds[0]
    for made in rounds[1:]:
        calls = calls.unionByName(made)
    ended = calls.groupBy("key").agg(F.count("*").alias("n_calls"), F.max("at").alias("ended_at"))
    return log_.state().join(ended, "key").select(F.col("key").cast("long").alias("event_id"), F.col("attempt").alias("attempts"), "n_calls", "outcome", "response", "ended_at")


@query(SQL["pages_extract"])
def pages_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selectors.extract(table(spark, sf_dir, "pages"), Selectors("h1", ".byline", "article p", skip_last=False))


@query(SQL["pages_extract_inner"])
def pages_selected_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selectors.extract(table(spark, sf_dir, "pages"), Selectors("h1", ".byline", "article p")).select("page_id", "text")
