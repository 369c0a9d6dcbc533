"""Exact deduplication by digest, with the frequent digests split off.

A Misra-Gries style summary (Spark's ``approx_top_k``, a frequent-items sketch of bounded size) finds the digests
that may be frequent. An exact aggregate verifies them and picks their winners; that table is bounded by the
sketch's k and is broadcast, so rows of a frequent digest are settled where they are read. Any digest left has
at most a small share of the rows, and an ordinary aggregate and join settle it. Only built-in functions run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from variorum.llm._shared import BLANKS, documents, keep_listed, materialize

#: Digests that the summary reports, and counters it holds while it counts. Each row count above rows/COUNTERS is found.
FREQUENT, COUNTERS = 1024, 8192


def digest_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.sha2(F.regexp_replace(text, BLANKS, "").cast("binary"), 256).alias("text_sha256"),
        F.char_length(text).alias("_points"),
        F.monotonically_increasing_id().alias("_row"),
    )


def winners(digests: DataFrame) -> DataFrame:
    """(text_sha256, keep_id, _keep_row, group_size): a row for each digest, combined before it is shuffled."""
    # ~x falls as x rises and can't overflow; a null id is the least, so it comes last
    best = F.max(F.struct("_points", F.bitwise_not("doc_id").alias("_id"), F.bitwise_not("_row").alias("_place")))
    found = digests.groupBy("text_sha256").agg(best.alias("w"), F.count(F.lit(1)).alias("group_size"))
    return found.select("text_sha256", F.bitwise_not("w._id").alias("keep_id"), F.bitwise_not("w._place").alias("_keep_row"), "group_size")


def frequent_digests(digests: DataFrame, frequent: int = FREQUENT, counters: int = COUNTERS) -> DataFrame:
    """At most ``frequent`` rows of ``winners``, all exact."""
    top = digests.agg(F.expr(f"approx_top_k(text_sha256, {frequent}, {counters})").alias("top"))
    candidates = top.select(F.explode("top.item").alias("text_sha256"))
    return winners(digests.join(F.broadcast(candidates), "text_sha256")).filter("group_size > 1")


def _marked(docs: DataFrame, id_col: str, text_col: str, frequent: int, counters: int) -> DataFrame:
    digests = materialize(digest_table(docs, id_col, text_col), "digests")
    heavy = materialize(frequent_digests(digests, frequent, counters), "frequent")
    settled = digests.join(F.broadcast(heavy), "text_sha256")
    rest = digests.join(F.broadcast(heavy.select("text_sha256")), "text_sha256", "left_anti")
    return settled.unionByName(rest.join(winners(rest), "text_sha256")).withColumn("kept", F.col("_row") == F.col("_keep_row"))


def exact_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT, counters: int = COUNTERS) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical after all of blank, tab to carriage return are deleted; null is the empty text.
    The row with most code points in its original text stays, then the smallest doc_id (a null id comes last); of rows
    that tie in both, one stays. Empty tables give an empty result. Other columns of docs are not read.
    """
    return _marked(docs, id_col, text_col, frequent, counters).select("doc_id", "keep_id", F.col("group_size").cast("long"), "kept", "text_sha256")


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """docs without the rows that ``exact_duplicates`` drops, all columns as they were.

    Of rows alike in id, text and length, null ids included, one stays where their group's choice falls on them. Null texts
    are empty texts, so they and blank ones are one group. An empty table stays empty; no column name is taken.
    """
    marked = materialize(_marked(docs, "doc_id", "text", FREQUENT, COUNTERS), "marked")
    key = F.array(F.col("doc_id").cast("string"), "text_sha256", F.col("_points").cast("string"))
    # only rows that tie with the kept one in all three can be taken for it
    tied = marked.filter("doc_id <=> keep_id").groupBy("doc_id", "text_sha256", "_points").agg(F.count(F.lit(1)).alias("copies"), F.max("kept").alias("kept"))
    text = F.coalesce(docs["text"], F.lit(""))
    digest = F.sha2(F.regexp_replace(text, BLANKS, "").cast("binary"), 256)
    return keep_listed(docs, tied.filter("kept").select(key.alias("key"), "copies"), [docs["doc_id"], digest, F.char_length(text)])


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), r AS (
  SELECT doc_id, text_sha256,
         first_value(doc_id) OVER w AS keep_id,
         row_number() OVER w AS place,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id)
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM r
"""
