"""Calls of a service with their attempts in a written log, so that retries outlive tasks, drivers and sessions.

Each request has a key. A round calls those that are due: new ones, and failed ones whose wait is
over. What came of a round is written before anything reads it, so no later plan calls again, and
a round that was written but not taken in when the driver was lost is taken in without calls. A
request that fails after its last attempt is a dead letter, which can be driven again.

Within a round Spark may run a task twice when an executor is lost. The service is given the key
with each call, by which it can tell that it has seen the request: with such a service each
request has one effect.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.buckets import Buckets
from ..sources.tables import exists
from .providers import Retry

#: Given a key, a payload and the number of the attempt (from 1), the response; an exception is a failure.
Call = Callable[[str, str, int], str]

_STATE = "key string, generation int, attempt int, outcome string, due bigint, response string, error string"


def _latest(rows: DataFrame) -> DataFrame:
    names = ["generation", "attempt", "outcome", "due", "response", "error"]
    last = rows.groupBy("key").agg(F.max_by(F.struct(*names), F.struct("generation", "attempt")).alias("_last"))
    return last.select("key", "_last.*")


class Attempts:
    def __init__(self, spark: SparkSession, path: str, retry: Retry, buckets: int = 64):
        self.spark, self.path, self.retry = spark, path, retry
        self.table = Buckets(spark, f"{path}/state", "key", _latest, _STATE, buckets)

    def state(self) -> DataFrame:
        """Of each request its last attempt: outcome is done, waiting or dead; due (epoch seconds) is when a waiting one is tried again."""
        return self.table.read()

    def due(self, requests: DataFrame, now: int) -> DataFrame:
        """key, payload, generation and number of attempts so far of the requests to call now; of requests with one key the least payload."""
        asked = requests.where(F.col("key").isNotNull()).groupBy("key").agg(F.min("payload").alias("payload"))
        known = self.table.lookup(asked).select("key", "generation", "attempt", "outcome", "due")
        open_ = F.col("outcome").isNull() | ((F.col("outcome") == "waiting") & (F.col("due") <= now))
        return asked.join(known, "key", "left").where(open_).select("key", "payload", F.coalesce("generation", F.lit(0)).alias("generation"), F.coalesce("attempt", F.lit(0)).alias("attempt"))

    def round(self, requests: DataFrame, call: Call, now: int, concurrency: int | None = None) -> DataFrame:
        """Call what is due and log it; returns the round's rows. requests: key, payload. concurrency: how many tasks call at once."""
        self.recover()
        due = self.due(requests, now)
        limited = due if concurrency is None else due.repartition(concurrency)
        path = self._next()
        limited.mapInPandas(_calls(call, self.retry.waits(), now), _STATE).write.mode("overwrite").parquet(path)
        self.recover()
        return self.spark.read.schema(_STATE).parquet(path)

    def _next(self) -> str:
        return f"{self.path}/rounds/{self.table.number() + 1}"

    def recover(self) -> None:
        """Take in a round that is written but doesn't count yet."""
        if exists(self.spark, f"{self._next()}/_SUCCESS"):
            self.table.apply(self.spark.read.schema(_STATE).parquet(self._next()))

    def next_due(self) -> int | None:
        """When the next waiting request is due."""
        return self.state().where("outcome = 'waiting'").agg(F.min("due")).first()[0]

    def dead(self) -> DataFrame:
        """The dead letters: key, attempt, error."""
        return self.state().where("outcome = 'dead'").select("key", "attempt", "error")

    def redrive(self, keys: DataFrame, now: int) -> None:
        """Let dead letters among these keys be tried again, from their first attempt on."""
        self.recover()
        again = self.table.lookup(keys).where("outcome = 'dead'")
        fresh = again.select("key", (F.col("generation") + 1).alias("generation"), F.lit(0).alias("attempt"), F.lit("waiting").alias("outcome"), F.lit(now).cast("long").alias("due"), F.lit(None).cast("string").alias("response"), "error")
        self.table.apply(fresh)


def _calls(call: Call, waits: list[float], now: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, payload, generation, before in zip(batch["key"], batch["payload"], batch["generation"], batch["attempt"], strict=True):
                attempt = int(before) + 1
                try:
                    rows.append((key, generation, attempt, "done", None, call(key, payload, attempt), None))
                except Exception as e:  # noqa: BLE001  one bad request mustn't end the others
                    due = now + int(waits[attempt - 1]) if attempt <= len(waits) else None
                    rows.append((key, generation, attempt, "dead" if due is None else "waiting", due, None, f"{type(e).__name__}: {e}"))
            out = pd.DataFrame(rows, columns=["key", "generation", "attempt", "outcome", "due", "response", "error"])
            yield out.astype({"due": "Int64"})

    return run
