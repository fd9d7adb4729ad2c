"""Change feeds and callbacks as streams.

State is bounded by watermarks: a task is forgotten once its time to live and the allowed
lateness have passed, and late or unmatched notifications are dropped. Event times without a
zone are taken as UTC, since watermarks need an instant. Outer joins keep what stays unmatched.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import TTL_SECONDS
from ..operators.callbacks import inserted, match, match_within, put_urls, success, unmatched
from ..operators.catalog import update_task_status
from ..operators.items import Items
from ..operators.plan import fan_out, prepare, translate
from ..sources.pages import Selectors, extract, fetch, split_failures

LATENESS = "10 minutes"


def resolve(tasks: DataFrame, urls: DataFrame, key: str, task_time: str, url_time: str, seconds: int = TTL_SECONDS, lateness: str = LATENESS, how: str = "inner") -> DataFrame:
    """Tasks with the notifications that come for them before they expire. Both times are timestamps.

    how: `leftOuter` also gives tasks that expired unanswered, `rightOuter` notifications without
    a task, each once the watermark has passed what could still match it.
    """
    return match_within(tasks.withWatermark(task_time, lateness), urls.withWatermark(url_time, lateness), key, task_time, url_time, seconds, how)


def once(notifications: DataFrame, key: list[str], time: str, lateness: str = LATENESS) -> DataFrame:
    """Without repeated notifications, as far as the watermark reaches; it doesn't reach those without a time, which all pass."""
    timed = notifications.where(F.col(time).isNotNull()).withWatermark(time, lateness).dropDuplicatesWithinWatermark(key)
    return timed.unionByName(notifications.where(F.col(time).isNull()))


def plans(articles: DataFrame, pages: DataFrame, selectors: Selectors | None = None) -> tuple[DataFrame, DataFrame]:
    """New articles (uuid, url) to speech plans, and the dead letters."""
    good, bad = split_failures(extract(fetch(articles, pages), selectors))
    return prepare(translate(fan_out(good))), bad


def follow(changes: DataFrame, pages: DataFrame, checkpoint: str, write_plans: Callable[[DataFrame, int], None], write_failures: Callable[[DataFrame, int], None], selectors: Selectors | None = None) -> StreamingQuery:
    """Act on what a change feed inserts, batch by batch, until the feed is drained.

    A bad page makes a dead letter and doesn't stop the others. The writers get the batch's
    number, so that a batch that is run again can replace what it wrote.
    """

    def act(batch: DataFrame, number: int) -> None:
        good, bad = plans(inserted(batch), pages, selectors)
        write_plans(good, number)
        write_failures(bad, number)

    query = changes.writeStream.foreachBatch(act).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def listen(notifications: DataFrame, tasks: Callable[[], DataFrame], checkpoint: str, write_callbacks: Callable[[DataFrame, int], None], write_unmatched: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """From a feed of storage notifications to the callbacks that resolve tasks, batch by batch, until the feed is drained.

    tasks gives their current state, which each batch reads anew. A notification that comes
    twice in a batch counts once; those of no task are written for audit.
    """

    def act(batch: DataFrame, number: int) -> None:
        # both are read twice
        urls, waiting = put_urls(batch).dropDuplicates(["url"]).persist(), tasks().persist()
        write_callbacks(success(match(urls, waiting)), number)
        write_unmatched(unmatched(urls, waiting), number)
        urls.unpersist()
        waiting.unpersist()

    query = notifications.writeStream.foreachBatch(act).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def answer(notifications: DataFrame, tasks: Items, checkpoint: str, write_callbacks: Callable[[DataFrame, int], None], write_unmatched: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """As `listen`, with tasks kept as a snapshot: a batch reads the buckets of its URLs and tasks, and what it resolves is written back as delivered.

    A batch that runs again writes the same: its updates have the seqs of their tasks' writes, plus one.
    """

    def act(batch: DataFrame, number: int) -> None:
        urls = put_urls(batch).dropDuplicates(["url"]).persist()
        found = tasks.first_by_url(urls)
        first = found.select("uuid").join(tasks.lookup(found), "uuid").persist()
        matched = match(urls, first)
        write_callbacks(success(matched), number)
        write_unmatched(unmatched(urls, first), number)
        delivered = matched.select(F.col("task_uuid").alias("uuid")).join(first.select("uuid", "updatedAt"), "uuid")
        at = F.timestamp_micros(F.unix_micros("updatedAt") + 1)
        tasks.write(update_task_status(delivered.where("updatedAt IS NOT NULL"), "DELIVERED", at))
        urls.unpersist()
        first.unpersist()

    query = notifications.writeStream.foreachBatch(act).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def instant(column: str) -> Column:
    """A time without a zone as an instant, in the session's zone."""
    return F.col(column).cast("timestamp")
