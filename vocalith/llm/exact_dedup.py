"""Exact deduplication with a heavy-hitter split, on DataFrame operations alone.

Texts are equal when identical once each run of white space is one space. Every row gets the
SHA-256 of that text. A Misra-Gries summary (Spark's `approx_top_k`, the weighted form with
median decrements; mergeable, of fixed size) names the digests that may be frequent. Their
winners are verified by an exact aggregation, which combines on the map side, and broadcast:
at most `TRACKED` rows, however large the corpus. Rows with such a digest are decided where
they lie and never shuffled; all other rows are shuffled by digest as usual. A digest that
the summary misses is merely shuffled, so the split never changes the result.

Defined cases: a null text counts as empty. A null id orders after all others. Among rows
that share text and id exactly one is kept. An empty table gives an empty result. Other
columns pass through `deduplicate` untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, fresh, materialise, ordered_id

#: Digests that the summary reports, which bounds what is broadcast, and counters that it keeps.
TRACKED, COUNTERS = 1024, 16384
#: A run of white space that isn't a single space already.
_RUN = r"(?:\x20[\x20\x09-\x0D]|[\x09-\x0D])[\x20\x09-\x0D]*"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), _RUN, " ")


def digest(text: Column) -> Column:
    """SHA-256 of the normalised text, 32 bytes."""
    return F.unhex(F.sha2(normalised(text), 256))


def heavy_winners(rows: DataFrame) -> DataFrame:
    """rows: digest, ord, row. Of frequent digests: digest, win_ord, win_row, win_size; TRACKED rows at most (but for hash collisions)."""
    keyed = rows.withColumn("h", F.xxhash64("digest"))
    top = keyed.agg(F.expr(f"approx_top_k(h, {TRACKED}, {COUNTERS})").alias("top"))
    frequent = top.select(F.explode("top").alias("t")).where("t.count > 1").select(F.col("t.item").alias("h"))
    return keyed.join(F.broadcast(frequent), "h", "left_semi").groupBy("digest").agg(F.min("ord").alias("win_ord"), F.min_by("row", "ord").alias("win_row"), F.count("*").alias("win_size"))


def decide(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), digest(F.col(text_col)).alias("digest"), F.monotonically_increasing_id().alias("row"))
    rows = materialise(rows, "digests").withColumn("ord", ordered_id(F.col("doc_id")))
    winners = materialise(heavy_winners(rows), "winners")
    heavy = rows.join(F.broadcast(winners), "digest").select("doc_id", F.col("win_ord").alias("keep"), F.col("win_size").alias("group_size"), (F.col("row") == F.col("win_row")).alias("kept"), "digest")
    group = Window.partitionBy("digest")
    first = group.orderBy("ord", "row")
    rest = rows.join(F.broadcast(winners), "digest", "left_anti").select(
        "doc_id", F.first("ord").over(first).alias("keep"), F.count("*").over(group).alias("group_size"), (F.row_number().over(first) == 1).alias("kept"), "digest"
    )
    known = F.when(F.col("keep") != ordered_id(F.lit(None)), F.col("keep"))
    return heavy.unionByName(rest).select("doc_id", known.alias("keep_id"), "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with the columns of docs.

    Of a frequent digest only the winner's rows go into the shuffle; all others are shuffled once.
    """
    digest_, ord_, win_, n_ = fresh(docs, "digest", "ord", "win", "n")
    rows = docs.select(digest(F.col(text_col)).alias("digest"), ordered_id(F.col(id_col)).alias("ord"), F.lit(0).alias("row"))
    winners = materialise(heavy_winners(materialise(rows, "digests")), "winners").select(F.col("digest").alias(digest_), F.col("win_ord").alias(win_))
    tagged = docs.withColumns({digest_: digest(F.col(text_col)), ord_: ordered_id(F.col(id_col))}).join(F.broadcast(winners), digest_, "left")
    tagged = tagged.where(F.col(win_).isNull() | (F.col(ord_) == F.col(win_)))
    first = Window.partitionBy(digest_).orderBy(ord_)
    return tagged.withColumn(n_, F.row_number().over(first)).where(F.col(n_) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide(documents(spark, sf_dir))


SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), w AS (
  SELECT *, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
         row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) AS n
  FROM d
)
SELECT doc_id, keep_id, group_size, n = 1 AS kept, text_sha256 FROM w
"""
