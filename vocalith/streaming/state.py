"""State that streams keep by key: waiting tasks, parts of a merge as they come, and languages done.

Each is a stateful processor. Where the order of rows counts, they wait in state until the
watermark has passed them and are then taken by their times; where it doesn't, they count as
they come. So results don't depend on how a feed falls into batches, and rows that come later
than the lateness allows are dropped by Spark. State of a key goes once nothing can change it.
A call to the state store costs far more than a row, so tasks and parts are kept for groups of
keys, rows by column: a batch costs a few calls for each group that it has rows of, and reads
and writes what these hold.
The state store has to be RocksDB, which `started` sees to.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from itertools import groupby

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.languages import CODES
from ..functions.text import TTL_SECONDS, present

LATENESS = "10 minutes"
#: Groups of keys that have their state together. More of them where batches are small and much waits; a stream keeps the number that it began with.
GROUPS = 2048
#: Rows in a value of the state store.
_CHUNK = 4096
#: What streams with state run with: a batch writes what it changes, not the whole store.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
_SECOND = 1_000_000


def started(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write what a stream with state has now to a Parquet folder, exactly once, and wait for it. The session's settings stay what they were.

    Each batch opens the stores of all partitions, so a new stream has a few of these a core at most.
    """
    spark = rows.sparkSession
    conf = spark.conf
    partitions = min(int(conf.get("spark.sql.shuffle.partitions")), max(12, 3 * spark.sparkContext.defaultParallelism))
    settings = SETTINGS | {"spark.sql.shuffle.partitions": str(partitions)}
    before = {k: conf.get(k, None) for k in settings}
    for k, value in settings.items():
        conf.set(k, value)
    try:
        query = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, value in before.items():
            conf.unset(k) if value is None else conf.set(k, value)
    return query


def _timed(rows: DataFrame, lateness: str) -> DataFrame:
    """rows with a time `at`, by which the watermark goes, and `micros`, the same as a number; those without go."""
    return rows.where(F.col("at").isNotNull()).withColumn("micros", F.unix_micros("at")).withWatermark("at", lateness)


def _instants(rows: DataFrame) -> DataFrame:
    """With the number in `at` as a time again."""
    return rows.withColumn("at", F.timestamp_micros("at"))


def _grouped(rows: DataFrame, keys: list[str], columns: list[str], groups: int) -> DataFrame:
    """group, keys and columns of rows, and the time that has the watermark."""
    return rows.select(F.pmod(F.xxhash64(*keys), F.lit(groups)).cast("int").alias("group"), *keys, *columns, "at")


class Rows:
    """Rows that a group holds, in a list state: its values are chunks, an array a column."""

    def __init__(self, handle: StatefulProcessorHandle, name: str, schema: str):
        columns = [x.split() for x in schema.split(", ")]
        self.state = handle.getListState(name, ", ".join(f"{column} array<{kind}>" for column, kind in columns))

    def get(self) -> list[tuple]:
        return [row for chunk in self.state.get() for row in zip(*chunk, strict=True)]

    def append(self, rows: list[tuple]) -> None:
        self.state.appendList(self._chunks(rows))

    def put(self, rows: list[tuple]) -> None:
        self.state.put(self._chunks(rows)) if rows else self.state.clear()

    @staticmethod
    def _chunks(rows: list[tuple]) -> list[tuple]:
        return [tuple(map(list, zip(*rows[k : k + _CHUNK], strict=True))) for k in range(0, len(rows), _CHUNK)]


class Grouped(StatefulProcessor):
    """What wakes at the earliest time at which something happens in a group."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.woken: set[tuple] = set()

    def wake(self, key: tuple, timerValues) -> int | None:
        """The watermark in microseconds; none if the group has been woken in this batch, as it is by each of its timers."""
        if (key := tuple(key)) in self.woken:
            return None
        self.woken.add(key)
        return timerValues.getCurrentWatermarkInMs() * 1000

    def wake_at(self, micros: int | None) -> None:
        if micros is not None:
            self.handle.registerTimer(-(-micros // 1000))

    def close(self) -> None:
        pass


WAIT_ROWS = "url string, outcome string, task_uuid string, token string, notification string, at long"
_Answer = Row("url", "outcome", "task_uuid", "token", "notification", "at")


class Waits(Grouped):
    """Of a URL the tasks that wait for it, as a store with a time to live has them.

    A notification finds the first task (by time and id) that hasn't expired. If that one waits
    it is resumed; if it was resumed before, the notification is a duplicate, and the token isn't
    sent again. A notification that finds no task is unmatched. A task expires when its time to
    live passes without a notification of its own.

    Rows wait until the watermark has passed them and are then taken in order.
    """

    def __init__(self, seconds: int):
        self.live = seconds * _SECOND

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.arrived = Rows(handle, "arrived", "url string, at long, put boolean, id string, token string")
        self.waiting = Rows(handle, "tasks", "url string, at long, id string, token string, resumed boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = [tuple(r)[1:6] for r in rows]
        self.arrived.append(new)
        self.wake_at(min(r[1] for r in new))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if (now := self.wake(key, timerValues)) is None:
            return
        rows = self.arrived.get()
        ready, later = sorted(r for r in rows if r[1] <= now), [r for r in rows if r[1] > now]
        before = self.waiting.get()
        tasks: dict[str, deque[tuple]] = {}
        for url, *task in before:
            tasks.setdefault(url, deque()).append(tuple(task))
        for url, of in groupby(ready, lambda r: r[0]):
            mine = tasks.setdefault(url, deque())
            for _, at, put, id_, token in of:
                yield from self._expired(url, mine, at - 1)
                if put:
                    yield self._answer(url, mine, at, id_)
                else:
                    mine.append((at, id_, token, False))
        for url, mine in tasks.items():
            yield from self._expired(url, mine, now)
        after = [(url, *task) for url, mine in tasks.items() for task in mine]
        if after != before:
            self.waiting.put(after)
        if ready:
            self.arrived.put(later)
        self.wake_at(min([r[1] for r in later] + [mine[0][0] + self.live for mine in tasks.values() if mine], default=None))

    def _answer(self, url: str, tasks: deque[tuple], at: int, id_: str) -> Row:
        if not tasks:
            return _Answer(url, "unmatched", None, None, id_, at)
        created, task, token, resumed = tasks[0]
        tasks[0] = (created, task, token, True)
        return _Answer(url, "duplicate" if resumed else "resumed", task, None if resumed else token, id_, at)

    def _expired(self, url: str, tasks: deque[tuple], until: int) -> Iterator[Row]:
        while tasks and tasks[0][0] + self.live <= until:
            created, task, token, resumed = tasks.popleft()
            if not resumed:
                yield _Answer(url, "expired", task, token, None, created + self.live)


def answered(tasks: DataFrame, notifications: DataFrame, seconds: int = TTL_SECONDS, lateness: str = LATENESS) -> DataFrame:
    """What becomes of each waiting task and each notification: url, outcome (resumed, duplicate, unmatched, expired), task_uuid, token, notification, at.

    tasks: uuid, url, token, createdAt. notifications: id, url, at. A token is given once, with
    what resumes its task or when it expires. Rows without a URL, id or time take no part. Of two
    streams each has to move on for the watermark to.
    """
    waits = tasks.select("url", F.col("createdAt").alias("at"), F.lit(False).alias("put"), F.col("uuid").alias("id"), "token")
    puts = notifications.select("url", "at", F.lit(True).alias("put"), "id", F.lit(None).cast("string").alias("token"))
    return answers(waits.unionByName(puts), seconds, lateness)


def answers(feed: DataFrame, seconds: int = TTL_SECONDS, lateness: str = LATENESS, groups: int = GROUPS) -> DataFrame:
    """The same for tasks and notifications in one feed: url, at, put (false: a task), id, token."""
    rows = _timed(feed.where(present(F.col("url")) & F.col("id").isNotNull()), lateness).withColumn("token", F.coalesce("token", F.lit("")))
    rows = _grouped(rows, ["url"], ["micros", "put", "id", "token"], groups)
    return _instants(rows.groupBy("group").transformWithState(Waits(seconds), WAIT_ROWS, "Append", "EventTime"))


PART_ROWS = "uuid string, language string, title string, text array<struct<url: string>>, missing int"


class Parts(Grouped):
    """Of an article and language the parts of its audio, until all are there.

    The plan says how many parts there are, and its time begins the wait; plan and parts come in
    any order, and parts more often than once (the earliest counts). The manifest goes out once:
    as soon as all parts are there, or without the missing ones when the time is up. Parts whose
    time is after that don't count. A key is remembered until its time is up, so that what comes
    again gives no second manifest.
    """

    def __init__(self, seconds: int):
        self.live = seconds * _SECOND

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.barriers = Rows(handle, "barriers", "uuid string, language string, begun long, expected int, done boolean")
        self.parts = Rows(handle, "parts", "uuid string, language string, place int, at long, url string")

    def load(self) -> tuple[dict[tuple, tuple], dict[tuple, dict[int, tuple]]]:
        """By key the barrier (when the wait began, how many parts, whether the manifest is out), and the parts by place."""
        plans, have = {(uuid, language): tuple(plan) for uuid, language, *plan in self.barriers.get()}, {}
        for uuid, language, place, *part in self.parts.get():
            have.setdefault((uuid, language), {})[place] = tuple(part)
        return plans, have

    def store(self, plans: dict[tuple, tuple], have: dict[tuple, dict[int, tuple]]) -> None:
        self.barriers.put([(*key, *plan) for key, plan in plans.items()])
        self.parts.put([(*key, place, *part) for key, parts in have.items() for place, part in parts.items()])
        begun = [plan[0] for plan in plans.values()] + [at for key, parts in have.items() if key not in plans for at, _ in parts.values()]
        self.wake_at(min(begun) + self.live if begun else None)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        plans, have = self.load()
        come = set()
        for _, uuid, language, micros, expected, place, url, _ in rows:
            come.add(of := (uuid, language))
            begun, count, done = plans.get(of, (None, None, False))
            if expected is not None:
                plans[of] = (*((micros, expected) if begun is None else min((micros, expected), (begun, count))), done)
            elif place is not None and not done:
                part, parts = (micros, url or ""), have.setdefault(of, {})
                parts[place] = min(part, parts.get(place, part))
        for of in sorted(come & plans.keys()):
            begun, expected, done = plans[of]
            if not done and len(there := self._there(have.get(of, {}), begun, expected)) == expected:
                yield self._manifest(of, there, expected)
                plans[of] = begun, expected, True
                have.pop(of, None)
        self.store(plans, have)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if (now := self.wake(key, timerValues)) is None:
            return
        plans, have = self.load()
        for of, (begun, expected, done) in list(plans.items()):
            if begun + self.live <= now:
                parts = have.pop(of, {})
                if not done:
                    yield self._manifest(of, self._there(parts, begun, expected), expected)
                del plans[of]
        for of in have.keys() - plans.keys():  # no plan has come for these
            have[of] = {place: part for place, part in have[of].items() if part[0] + self.live > now}
        self.store(plans, have)

    def _there(self, have: dict[int, tuple[int, str]], begun: int, expected: int) -> list[tuple[int, str]]:
        return sorted((place, url) for place, (at, url) in have.items() if place < expected and at <= begun + self.live)

    def _manifest(self, key: tuple, there: list[tuple[int, str]], expected: int) -> Row:
        title = next((url for place, url in there if place == 0), None)
        return Row(uuid=key[0], language=key[1], title=title, text=[Row(url=url) for place, url in there if place], missing=expected - len(there))


def gathered(plans: DataFrame, parts: DataFrame, seconds: int = TTL_SECONDS, lateness: str = LATENESS) -> DataFrame:
    """Manifests as `manifest.assemble` gives them, each once all its parts are there: uuid, language, title, text, missing (0 if complete).

    plans: uuid, language, expected (how many parts, the title's among them), at. parts: uuid,
    language, place, url, at. seconds: how long, from the plan's time, parts are waited for; then
    the manifest goes out without the `missing` ones. Parts of no plan go. Uuids are strings.
    """
    asked = plans.select("uuid", "language", "at", F.col("expected").cast("int").alias("expected"), F.lit(None).cast("int").alias("place"), F.lit(None).cast("string").alias("url"))
    come = parts.select("uuid", "language", "at", F.lit(None).cast("int").alias("expected"), F.col("place").cast("int").alias("place"), "url")
    return manifests(asked.unionByName(come), seconds, lateness)


def manifests(feed: DataFrame, seconds: int = TTL_SECONDS, lateness: str = LATENESS, groups: int = GROUPS) -> DataFrame:
    """The same for plans and parts in one feed: uuid, language, at, expected or else place and url."""
    rows = _timed(feed.where(F.col("uuid").isNotNull() & F.col("language").isNotNull()), lateness)
    rows = _grouped(rows, ["uuid", "language"], ["micros", "expected", "place", "url"], groups)
    return rows.groupBy("group").transformWithState(Parts(seconds), PART_ROWS, "Append", "EventTime")


DONE_ROWS = "uuid string, languages int"


class Languages(StatefulProcessor):
    """Of an article the languages done, a bit each; it goes out once, when the last one comes."""

    def __init__(self, full: int):
        self.full = full

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bits = handle.getValueState("bits", "bits int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = (self.bits.get() or (0,))[0]
        now = before
        for row in rows:
            now |= row["bits"]
        if now != before:
            self.bits.update((now,))
            if now == self.full:
                yield Row(uuid=key[0], languages=now.bit_count())

    def close(self) -> None:
        pass


def completed(finished: DataFrame, codes: tuple[str, ...] = CODES) -> DataFrame:
    """Articles that have turned complete, each once: uuid and the number of its languages.

    finished: uuid, language. An article's bits stay, as its outputs do, so one that is complete
    doesn't turn so again; other languages than codes don't count.
    """
    bits: Column = F.coalesce(*[F.when(F.col("language") == code, F.lit(1 << k)) for k, code in enumerate(codes)], F.lit(0))
    rows = finished.where(F.col("uuid").isNotNull()).select("uuid", bits.alias("bits")).where("bits > 0")
    return rows.groupBy("uuid").transformWithState(Languages((1 << len(codes)) - 1), DONE_ROWS, "Append", "None")
