"""Evaluation against gold events and corpus expectations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from variorum.functions import text as T


def match_events(expected: DataFrame, found: DataFrame, case: list[str]) -> DataFrame:
    """Each expected event with ``hits`` and ``matched``: as many found events of its kind, texts and place as it says occur.

    expected: case, event_id, kind, old_text, new_text, location, occurrences, critical. found: case, kind, old_text,
    new_text, location. Texts are compared with blanks collapsed; a null place fits any.
    """
    norm = lambda c: T.collapsed(F.coalesce(c, F.lit("")))
    key = [*case, "kind", "_o", "_n"]
    a = expected.withColumns({"_o": norm(F.col("old_text")), "_n": norm(F.col("new_text"))})
    b = found.select(*case, "kind", norm(F.col("old_text")).alias("_o"), norm(F.col("new_text")).alias("_n"), F.col("location").alias("_at")).groupBy(*key, "_at").agg(F.count(F.lit(1)).alias("_c"))
    met = a.join(b, key, "left")
    fits = F.col("location").isNull() | F.col("_at").isNull() | F.contains(F.lower("_at"), F.lower("location"))
    hits = met.groupBy(*case, "event_id").agg(F.coalesce(F.sum(F.when(fits, F.col("_c"))), F.lit(0)).alias("hits"))
    return expected.join(hits, [*case, "event_id"]).withColumn("matched", F.col("hits") == F.coalesce("occurrences", F.lit(1)))


def accuracy(events: DataFrame, found: DataFrame, cases: DataFrame, case: list[str]) -> DataFrame:
    """One row: events, matched, recall, critical_recall, found, precision. Precision is null unless all oracles are complete."""
    a = events.agg(F.count(F.lit(1)).alias("events"), F.count_if("matched").alias("matched"), F.count_if("critical").alias("critical"), F.count_if(F.col("critical") & F.col("matched")).alias("critical_matched"), F.sum(F.when(F.col("matched"), F.col("hits")).otherwise(0)).alias("true_found"))
    b = found.agg(F.count(F.lit(1)).alias("found"))
    c = cases.agg(F.bool_and("oracle_complete").alias("complete"))
    row = a.join(F.broadcast(b)).join(F.broadcast(c))  # one row each
    return row.select("events", "matched", F.try_divide("matched", "events").alias("recall"), F.try_divide("critical_matched", "critical").alias("critical_recall"), "found", F.when(F.col("complete"), F.try_divide("true_found", "found")).alias("precision"))


def binary_metrics(rows: DataFrame, label: Column, predicted: Column) -> DataFrame:
    """tp, fp, fn, tn, precision, recall of two boolean columns."""
    c = {"tp": label & predicted, "fp": ~label & predicted, "fn": label & ~predicted, "tn": ~label & ~predicted}
    out = rows.agg(*[F.count_if(v).alias(k) for k, v in c.items()])
    return out.withColumn("precision", F.try_divide("tp", F.col("tp") + F.col("fp"))).withColumn("recall", F.try_divide("tp", F.col("tp") + F.col("fn")))


def status_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def distinct_source_pairs(cases: DataFrame) -> DataFrame:
    """Pairs of source digests without regard to order, less those of a file with itself."""
    pairs = cases.filter("old_sha <> new_sha").select(F.least("old_sha", "new_sha").alias("a"), F.greatest("old_sha", "new_sha").alias("b"))
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def folded(c: Column) -> Column:
    return F.lower(T.collapsed(c))


def expectations(cases: DataFrame, texts: DataFrame, case: list[str]) -> DataFrame:
    """Each anchor of a case with ``ok``: must_find in the material text, must_ignore nowhere in what readers see, must_review
    in the review text, must_extract in the source. texts: case, material, reader, review, source. Empty texts hold nothing."""
    rules = {"must_find": ("material", True), "must_ignore": ("reader", False), "must_review": ("review", True), "must_extract": ("source", True)}
    out = None
    joined = cases.join(texts, case, "left")
    for rule, (column, wanted) in rules.items():
        if rule in cases.columns:
            one = joined.select(*case, F.lit(rule).alias("rule"), F.explode(rule).alias("anchor"), F.coalesce(column, F.lit("")).alias("_t"))
            one = one.withColumn("ok", F.contains(folded(F.col("_t")), folded(F.col("anchor"))) == F.lit(wanted)).drop("_t")
            out = one if out is None else out.unionByName(one)
    return out


def in_order(text: Column, anchors: list[str]) -> Column:
    """Whether all anchors come in the text, each after the one before."""
    pattern = "(?s).*" + ".*".join("\\Q" + a.replace("\\E", "") + "\\E" for a in anchors) + ".*"
    return text.rlike(pattern)
