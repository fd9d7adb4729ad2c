"""From resolved segments to merged articles: ordered manifests, outputs and callbacks.

Only paths go through shuffles: the task that merges an article reads its audio itself.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .providers import RETRY_MERGE, Merger, Retry, joined_bytes


def assemble(segments: DataFrame) -> DataFrame:
    """segments: uuid, language, place (0: the title), url. Of each article and language the title's URL and the others in order."""
    grouped = segments.groupBy("uuid", "language").agg(F.array_sort(F.collect_list(F.struct("place", "url"))).alias("_parts"))
    urls = lambda keep: F.transform(F.filter("_parts", keep), lambda p: F.struct(p["url"].alias("url")))
    return grouped.select("uuid", F.try_element_at(urls(lambda p: p["place"] == 0), F.lit(1))["url"].alias("title"), urls(lambda p: p["place"] > 0).alias("text"), "language")


def payloads(merges: DataFrame, token: Column) -> DataFrame:
    """What the merge step gets: uuid, title, text, language, and the token that resumes its execution."""
    return merges.select("uuid", "title", "text", "language", token.alias("token"))


def keys(merges: DataFrame, bucket: str) -> DataFrame:
    """With `inputs`, the keys to concatenate: the title first, then the text; a missing text is empty."""
    text = F.coalesce("text", F.array().cast("array<struct<url: string>>"))
    inputs = F.transform(F.concat(F.array("title"), F.transform(text, lambda p: p["url"])), lambda u: T.object_key(u, bucket))
    return merges.withColumn("inputs", inputs)


def file_list(inputs: Column) -> Column:
    """The list that a concatenating program reads."""
    return F.array_join(F.transform(inputs, lambda k: F.concat(F.lit("file '"), T.last_segment(k), F.lit("'"))), "\n")


def concatenated(segments: DataFrame) -> DataFrame:
    """segments: uuid, language, place, content. Their bytes in order: no remuxing of containers.

    For contents in a table, which go through the shuffle; `merge_objects` is for objects.
    """
    grouped = segments.groupBy("uuid", "language").agg(F.array_sort(F.collect_list(F.struct("place", "content"))).alias("_parts"))
    return grouped.select("uuid", "language", F.unhex(F.array_join(F.transform("_parts", lambda p: F.hex(p["content"])), "")).alias("content"))


def merge_objects(merges: DataFrame, folder: str, merger: Merger = joined_bytes, retry: Retry = RETRY_MERGE, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """Merge each row's inputs (keys in order) into one object of the bucket's folder, at output_key; with length, or merge_error.

    The task reads and writes the objects; a rerun writes the same object again. folder is a
    path or a URI of any file system that Arrow knows.
    """

    def merge(fs: pyarrow.fs.FileSystem, base: str, inputs: list[str], to: str) -> int:
        def read(key: str) -> bytes:
            with fs.open_input_stream(f"{base}/{key}") as file:
                return file.read()

        content = merger([read(key) for key in inputs])
        fs.create_dir(f"{base}/{to}".rpartition("/")[0], recursive=True)
        with fs.open_output_stream(f"{base}/{to}") as file:
            file.write(content)
        return len(content)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            rows = []
            for inputs, to in zip(batch["inputs"], batch["output_key"], strict=True):
                try:
                    rows.append((retry.call(merge, fs, base, list(inputs), to, wait=wait), None))
                except Exception as e:  # noqa: BLE001  one bad merge mustn't end the others
                    rows.append((None, f"{type(e).__name__}: {e}"))
            done = pd.DataFrame(rows, columns=["length", "merge_error"], index=batch.index, dtype=object)
            yield pd.concat([batch, done], axis=1)

    key = T.merged_key(F.col("uuid").cast("string"), F.col("language"))
    placed = merges.select("uuid", "language", "inputs", key.alias("output_key"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in placed.schema)
    return placed.mapInPandas(run, f"{schema}, length bigint, merge_error string")


def finish(merges: DataFrame, bucket: str, failure: Column | None = None) -> DataFrame:
    """With where the merged audio goes, its URL, and the callback: success with the outputs so far, or failure with its cause.

    failure: the cause where a merge failed, else null. merges may have `outputs`, those that
    the article has already, and `token`, which stays and names the execution to resume.
    """
    cause = F.lit(None).cast("string") if failure is None else failure
    bad = F.coalesce(cause, F.when(~T.present(F.col("title")), "no title audio"))
    key = T.merged_key(F.col("uuid").cast("string"), F.col("language"))
    placed = merges.withColumns({"output_key": key, "output_url": T.object_url(F.lit(bucket), key), "error": bad})
    own = F.create_map(F.col("language"), F.struct(F.col("output_url").alias("url")))
    if "outputs" in merges.columns:
        others = F.map_filter(F.coalesce("outputs", F.create_map().cast("map<string, struct<url: string>>")), lambda code, _: code != F.col("language"))
        own = F.map_concat(others, own)
    output = F.when(F.col("error").isNull(), F.to_json(F.struct("uuid", own.alias("outputs")))).otherwise(F.to_json(F.struct("uuid")))
    return placed.withColumns({"succeeded": F.col("error").isNull(), "output": output})


def outputs(finished: DataFrame, order: str) -> DataFrame:
    """uuid and its outputs, the last URL of each language; an aggregation, so concurrent languages can't lose each other's."""
    last = finished.groupBy("uuid", "language").agg(F.max_by("output_url", order).alias("url"))
    entries = F.array_sort(F.collect_list(F.struct(F.col("language").alias("key"), F.struct("url").alias("value"))))
    return last.groupBy("uuid").agg(F.map_from_entries(entries).alias("outputs"))


def ordered_text(rows: DataFrame, key: str, place: str, text: str, separator: str = "\n") -> DataFrame:
    """key and its texts joined in order."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(place).alias("_place"), F.col(text).alias("_text"))))
    return rows.groupBy(key).agg(F.array_join(F.transform(parts, lambda p: p["_text"]), separator).alias(text))
