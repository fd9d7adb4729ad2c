"""The services that the workflow calls, as interfaces, and deterministic stand-ins for them.

A provider turns columns into a column. `called_translation` and `called_synthesis` make one
of a function that calls a service, with the step's retries around each call; Spark retries
whole tasks, so write the result before anything reads it, or use `attempts`, which logs them. `remuxing` merges audio by a program. The stand-ins translate nothing, synthesise
nothing and only join bytes.
"""

from __future__ import annotations

import subprocess
import tempfile
import time
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T


@dataclass(frozen=True)
class Retry:
    """How often a failed call is tried again, and the waits before that."""

    attempts: int
    interval_seconds: float = 1
    backoff: float = 1

    def waits(self) -> list[float]:
        return [self.interval_seconds * self.backoff**k for k in range(self.attempts)]

    def call(self, function: Callable, *args, wait: Callable[[float], None]):
        """The function's value; a failure waits and tries again, and the last one is raised."""
        for seconds in self.waits():
            try:
                return function(*args)
            except Exception:  # noqa: BLE001
                wait(seconds)
        return function(*args)


# The retry rules of the three steps.
RETRY_TITLE, RETRY_PARAGRAPH, RETRY_MERGE = Retry(6, 2, 2), Retry(3, 2, 2), Retry(20)

Translator = Callable[[Column, Column], Column]
Synthesiser = Callable[[Column, Column, Column], Column]
#: Makes one object's bytes of those of several, in order.
Merger = Callable[[list[bytes]], bytes]


def called_translation(call: Callable[[str, str], str], retry: Retry = RETRY_PARAGRAPH, wait: Callable[[float], None] = time.sleep) -> Translator:
    """A translator that calls a function of text and target; null texts aren't sent."""

    @F.pandas_udf("string")
    def translate(texts: pd.Series, targets: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else retry.call(call, t, to, wait=wait) for t, to in zip(texts, targets, strict=True)], dtype=object)

    return translate.asNondeterministic()


def called_synthesis(call: Callable[[str, str, str], tuple[str, str]], retry: Retry = RETRY_PARAGRAPH, wait: Callable[[float], None] = time.sleep) -> Synthesiser:
    """A synthesiser that calls a function of SSML, language and voice, which gives a task's id and the URL of its audio."""

    @F.pandas_udf("TaskId string, OutputUri string")
    def start(ssml: pd.Series, codes: pd.Series, voices: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([retry.call(call, *x, wait=wait) for x in zip(ssml, codes, voices, strict=True)], columns=["TaskId", "OutputUri"], dtype=object)

    once = start.asNondeterministic()
    return lambda ssml, code, voice: F.struct(once(ssml, code, voice).alias("SynthesisTask"))


def remuxing(program: str = "ffmpeg", suffix: str = ".mp3", seconds: float = 10) -> Merger:
    """A merger that has a program concatenate the parts without encoding them anew, as one container.

    The program reads a list of files, so the parts lie in a folder of the task's own during the call.
    """

    def merge(parts: list[bytes]) -> bytes:
        with tempfile.TemporaryDirectory() as folder:
            names = [Path(folder, f"{i}{suffix}") for i in range(len(parts))]
            for name, part in zip(names, parts, strict=True):
                name.write_bytes(part)
            listed, merged = Path(folder, "list.txt"), Path(folder, f"merged{suffix}")
            listed.write_text("\n".join(f"file '{name}'" for name in names))
            subprocess.run([program, "-f", "concat", "-safe", "0", "-i", str(listed), "-c", "copy", str(merged)], check=True, capture_output=True, timeout=seconds)
            return merged.read_bytes()

    return merge


def joined_bytes(parts: list[bytes]) -> bytes:
    """Stands for a merge: the parts one after the other; containers aren't remuxed."""
    return b"".join(parts)


def tagged_translation(text: Column, target: Column) -> Column:
    """Stands for a translation: the text behind its target language."""
    return F.concat(F.lit("["), target, F.lit("] "), text)


def dictionary_translation(pairs: dict[tuple[str, str], str]) -> Translator:
    """Whole texts looked up by (target, text); what isn't there stays as it is."""
    table = F.create_map([F.lit(x) for (target, source), text in pairs.items() for x in (f"{target}\x1f{source}", text)]) if pairs else None

    def translate(text: Column, target: Column) -> Column:
        return text if table is None else F.coalesce(table[F.concat(target, F.lit("\x1f"), text)], text)

    return translate


def hashed_synthesis(bucket: str = "bucket", prefix: str = "audio/") -> Synthesiser:
    """Stands for a synthesis task: its id and the URL where audio would appear, from the request's hash."""

    def synthesise(ssml: Column, code: Column, voice: Column) -> Column:
        task = F.sha2(F.concat_ws("\x1f", ssml, code, voice), 256)
        url = T.object_url(F.lit(bucket), F.concat(F.lit(prefix), task, F.lit(".mp3")))
        return F.struct(F.struct(task.alias("TaskId"), url.alias("OutputUri")).alias("SynthesisTask"))

    return synthesise
