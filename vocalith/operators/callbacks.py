"""Matching finished audio with the tasks that wait for it, in batch or on streams.

All functions here are transformations that work alike on both; only the interval join of
two streams needs watermarks, which the streaming package sets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .catalog import first_by

PREFIX = "audio/"


def inserted(changes: DataFrame) -> DataFrame:
    """uuid and url of the articles that a change feed adds; other changes don't act."""
    rest = [c for c in changes.columns if c not in ("eventName", "dynamodb")]
    return changes.where("eventName = 'INSERT'").select(*rest, F.col("dynamodb.NewImage.uuid.S").alias("uuid"), F.col("dynamodb.NewImage.url.S").alias("url"))


def put_urls(notifications: DataFrame, prefix: str = PREFIX) -> DataFrame:
    """The object URLs of puts under the prefix; keys stay as they come, undecoded. No records, no rows."""
    key = F.col("s3.object.key")
    rest = [c for c in notifications.columns if c not in ("eventName", "s3")]
    return notifications.where((F.col("eventName") == "ObjectCreated:Put") & F.startswith(key, F.lit(prefix))).select(*rest, T.object_url(F.col("s3.bucket.name"), key).alias("url"))


def waiting(waits: DataFrame) -> DataFrame:
    """uuid, url and token of the tasks to wait for: the title's audio or the paragraph's, if both its id and its URL are there."""
    source = F.when(F.col("textType") == "title", F.col("title")).when(F.col("textType") == "paragraph", F.col("audioOutput"))
    rest = [c for c in waits.columns if c not in ("textType", "token", "title", "audioOutput")]
    picked = waits.select(*rest, source["SynthesisTask"]["TaskId"].alias("uuid"), source["SynthesisTask"]["OutputUri"].alias("url"), "token")
    return picked.where(T.present(F.col("uuid")) & T.present(F.col("url")))


def match(urls: DataFrame, tasks: DataFrame) -> DataFrame:
    """Notifications with the first task of their URL; those without a task go, whatever the task's status."""
    first = first_by(tasks, "url", ["createdAt", "uuid"])
    return urls.join(first.select("url", F.col("uuid").alias("task_uuid"), "token"), "url")


def unmatched(urls: DataFrame, tasks: DataFrame) -> DataFrame:
    """For audit: the notifications whose URL no task has."""
    return urls.join(tasks.select("url").where(T.present(F.col("url"))), "url", "left_anti")


def success(matched: DataFrame) -> DataFrame:
    """In one row what resolves a task: its new status and the callback that resumes the workflow."""
    return matched.withColumns({"task_status": F.lit("DELIVERED"), "succeeded": F.lit(True), "output": F.to_json(F.struct("url"))})


def match_within(tasks: DataFrame, urls: DataFrame, key: str, task_time: str, url_time: str, seconds: int = T.TTL_SECONDS, how: str = "inner") -> DataFrame:
    """Tasks with the notifications of their key from their creation until they expire.

    how: `leftOuter` keeps tasks that none came for, `rightOuter` notifications that no task waits for.
    """
    within = F.expr(f"n.`{url_time}` >= t.`{task_time}` AND n.`{url_time}` <= t.`{task_time}` + INTERVAL {seconds} SECONDS")
    return tasks.alias("t").join(urls.alias("n"), (F.col(f"t.{key}") == F.col(f"n.{key}")) & within, how)


def selected(waited: DataFrame) -> DataFrame:
    """What a resumed wait leaves: the title's URL as `title`, a paragraph's as `url`."""
    title = F.col("text_type") == "title"
    return waited.withColumns({"title": F.when(title, F.col("url")), "paragraph": F.when(~title, F.struct("url"))})


