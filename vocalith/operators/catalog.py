"""Articles and tasks as keyed state, kept as a log of writes.

A write is a row: key, `op` (put, update, delete), `seq` (its order) and the columns it sets,
null where it sets none. The current state of a key is what its last put or delete and the
updates since leave, column by column. One aggregation computes it, combining on the map side,
so a key with most of the log is no bottleneck and no read-modify-write can lose an update.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.languages import CODES
from ..schemas import CONTENT_STATUS, TASK_STATUS


def _write(rows: DataFrame, op: str, at: Column, **sets: Column) -> DataFrame:
    """at: when it was written, which orders writes unless rows have a seq of their own."""
    seq = F.col("seq") if "seq" in rows.columns else F.unix_micros(at)
    return rows.select(F.col("uuid"), F.lit(op).alias("op"), seq.alias("seq"), *[c.alias(n) for n, c in sets.items()], at.cast("timestamp").alias("updatedAt"))


def _status(value: str, allowed: tuple[str, ...]) -> Column:
    if value not in allowed:
        raise ValueError(f"{value} is none of {allowed}")
    return F.lit(value)


def create_content(rows: DataFrame, at: Column) -> DataFrame:
    """rows: uuid, url. A put of a pending article; it replaces an item of the same key."""
    return _write(rows, "put", at, url=F.col("url"), article_status=_status("PENDING", CONTENT_STATUS), createdAt=at.cast("timestamp"))


def create_merge_job(rows: DataFrame, at: Column) -> DataFrame:
    """rows: uuid, article_id, url, language."""
    return _write(rows, "put", at, url=F.col("url"), article_id=F.col("article_id"), language=F.col("language"), type=F.lit("merge"), article_status=_status("RENDERED", CONTENT_STATUS), createdAt=at.cast("timestamp"))


def update_content_status(rows: DataFrame, status: str, at: Column) -> DataFrame:
    return _write(rows, "update", at, article_status=_status(status, CONTENT_STATUS))


def update_title(rows: DataFrame, at: Column) -> DataFrame:
    """rows: uuid, title."""
    return _write(rows, "update", at, title=F.col("title"))


def update_outputs(rows: DataFrame, at: Column) -> DataFrame:
    """rows: uuid, outputs. Replaces the whole map; the status stays as it was."""
    return _write(rows, "update", at, outputs=F.col("outputs"))


def delete(rows: DataFrame, at: Column) -> DataFrame:
    return _write(rows, "delete", at)


def create_task(rows: DataFrame, at: Column) -> DataFrame:
    """rows: uuid, url, token; the time to live counts from the write."""
    return _write(rows, "put", at, url=F.col("url"), token=F.col("token"), ttl=T.ttl(at.cast("timestamp")), task_status=_status("PENDING", TASK_STATUS), createdAt=at.cast("timestamp"))


def update_task_status(rows: DataFrame, status: str, at: Column) -> DataFrame:
    return _write(rows, "update", at, task_status=_status(status, TASK_STATUS))


def write_log(writes: Iterable[DataFrame]) -> DataFrame:
    first, *others = writes
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


_BEFORE_ALL = -(1 << 63)


def partial_state(log: DataFrame, key: str = "uuid") -> DataFrame:
    """A row for each key of the log: of its last put or delete `_reset` (the seq) and `_op`, of its last update `_update`, and of each column the last seq and value that was set.

    Such rows of several parts of a log, merged, are those of all of it.
    """
    columns = [c for c in log.columns if c not in (key, "op", "seq")]
    resets = F.col("op") != "update"
    last = [F.max_by(F.struct("seq", F.col(c).alias("value")), F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in columns]
    return log.where(T.present(F.col(key).cast("string"))).groupBy(key).agg(
        F.max(F.when(resets, F.col("seq"))).alias("_reset"), F.max_by("op", F.when(resets, F.col("seq"))).alias("_op"), F.max(F.when(~resets, F.col("seq"))).alias("_update"), *last
    )


def merge_states(states: DataFrame, key: str = "uuid") -> DataFrame:
    """Partial states, several of a key, to one a key."""
    columns = [c for c in states.columns if c not in (key, "_reset", "_op", "_update")]
    return states.groupBy(key).agg(F.max("_reset").alias("_reset"), F.max_by("_op", "_reset").alias("_op"), F.max("_update").alias("_update"), *[F.max_by(c, F.col(c)["seq"]).alias(c) for c in columns])


def present_state(states: DataFrame, key: str = "uuid") -> DataFrame:
    """A row for each key that exists, of partial states with one row a key."""
    columns = [c for c in states.columns if c not in (key, "_reset", "_op", "_update")]
    start = F.coalesce("_reset", F.lit(_BEFORE_ALL).cast("long"))
    alive = F.coalesce(F.col("_op") == "put", F.lit(True)) | (F.coalesce("_update", F.lit(_BEFORE_ALL).cast("long")) > start)
    return states.where(alive).select(key, *[F.when(F.col(c)["seq"] >= start, F.col(c)["value"]).alias(c) for c in columns])


def current_state(log: DataFrame, key: str = "uuid") -> DataFrame:
    """A row for each key that exists, with the log's columns but op and seq.

    Writes of one key need seqs of their own: of two that set a column with the same seq either may win.
    """
    return present_state(partial_state(log, key), key)


def unexpired(tasks: DataFrame, now: Column) -> DataFrame:
    return tasks.where(F.col("ttl") > F.unix_timestamp(now))


def get(items: DataFrame, key: str | None, column: str = "uuid") -> DataFrame:
    """The item of a key; none for a null or empty key. The filter reaches the scan."""
    return items.where(F.col(column) == key) if key else items.limit(0)


def first_by(items: DataFrame, column: str, order: list[str]) -> DataFrame:
    """Of the items that share a value of the column the first by the order."""
    others = [c for c in items.columns if c != column]
    first = items.where(T.present(F.col(column).cast("string"))).groupBy(column).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("_item"))
    return first.select(column, "_item.*")


def query_by_url(items: DataFrame, url: str | None) -> DataFrame:
    """The first item of a URL."""
    return first_by(get(items, url, "url"), "url", ["createdAt", "uuid"]) if url else items.limit(0)


def sanitise(events: DataFrame) -> DataFrame:
    """contentId, href and language of HTTP events: a POST's are in its body, any other has only the path's id."""
    body = F.from_json(F.coalesce("body", F.lit("{}")), "contentId string, url string, language string")
    post = F.coalesce(F.col("httpMethod") == "POST", F.lit(False))
    rest = [c for c in events.columns if c not in ("httpMethod", "pathParameters", "body")]
    return events.select(*rest, F.when(post, body["contentId"]).otherwise(F.col("pathParameters.contentId")).alias("contentId"), F.when(post, body["url"]).alias("href"), F.when(post, body["language"]).alias("language"))


def http_output(status: Column, output: Column | None = None) -> Column:
    """Status code and JSON body; without an output the body is null."""
    return F.struct(status.alias("statusCode"), (F.lit(None).cast("string") if output is None else F.to_json(output)).alias("body"))


def look_up(asked: DataFrame, content: DataFrame, host: str = T.SITE_HOST) -> DataFrame:
    """asked: contentId, href and whatever else, with the item found: by id, or else by URL.

    path is the URL's; item is null if neither finds one. Both joins are equi-joins; the URL side has one row a URL.
    """
    every = F.struct(*content.columns)
    by_id = content.where(T.present(F.col("uuid").cast("string"))).select(F.col("uuid").alias("_id"), every.alias("_by_id"))
    by_url = first_by(content, "url", ["createdAt", "uuid"]).select(F.col("url").alias("_url"), every.alias("_by_url"))
    paths = asked.withColumn("path", T.content_path(F.col("href"), host))
    found = paths.join(by_id, T.known(F.col("contentId")) == F.col("_id"), "left").join(by_url, F.col("path") == F.col("_url"), "left")
    return found.withColumn("item", F.coalesce("_by_id", "_by_url")).drop("_id", "_by_id", "_url", "_by_url")


def outcome(found: DataFrame) -> DataFrame:
    """With `outcome`: an error for a request with neither id nor URL, 404 if there is nothing to register, else found or create."""
    asked = T.present(F.col("contentId")) | T.present(F.col("href"))
    return found.withColumn("outcome", F.when(~asked, "Missing contentId or url").when(F.col("item").isNotNull(), "found").when(F.col("path").isNull(), "404").otherwise("create"))


def create_missing(found: DataFrame, at: Column) -> DataFrame:
    """Writes that register the URLs of requests that found nothing, each once."""
    new = outcome(found).where("outcome = 'create'").select(F.col("path").alias("url")).distinct()
    return create_content(new.withColumn("uuid", T.content_id(F.col("url"))), at)


def entries(outputs: Column, now: Column, signer: T.Signer | None = None) -> Column:
    """The map as an array by code, with signed URLs; a URL that isn't an object's has none."""
    def entry(e: Column) -> Column:
        url = e["value"]["url"]
        at = T.parse_object_url(url)
        return F.struct(e["key"].alias("code"), F.when(at.isNotNull(), T.signed(url, now, signer=signer)).alias("signed"))

    return F.array_sort(F.transform(F.map_entries(outputs), entry), lambda a, b: F.when(a["code"] < b["code"], -1).when(a["code"] > b["code"], 1).otherwise(0))


def respond(found: DataFrame, now: Column, codes: tuple[str, ...] = CODES, signer: T.Signer | None = None) -> DataFrame:
    """Found items with `complete` (in place of waiting) and their outputs as an array."""
    item = outcome(found).where("outcome = 'found'")
    return item.withColumns({"complete": T.languages_present(F.col("item.outputs"), F.col("language"), codes), "outputs": entries(F.col("item.outputs"), now, signer)})
