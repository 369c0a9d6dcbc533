"""Ordered (window) operators. Every order has a tie-breaker, so results do not depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def occurrence(rows: DataFrame, keys: list[str], order: list[str], name: str = "occ") -> DataFrame:
    """Number of each row among those of its key, from 1."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def unique_only(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key no other row has. Counted by an aggregate that is combined before its shuffle, not by a window."""
    single = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n = 1").drop("_n")
    return rows.join(single, keys, "left_semi")


def mutual_best(pairs: DataFrame, group: list[str], old: str, new: str, score: str) -> DataFrame:
    """Pairs that are the only best of both their sides; a tie is no best."""
    best_old = pairs.groupBy(*group, old).agg(F.max(score).alias("_bo"))
    best_new = pairs.groupBy(*group, new).agg(F.max(score).alias("_bn"))
    tops = pairs.join(best_old, [*group, old]).join(best_new, [*group, new])
    one_old = tops.filter(F.col(score) == F.col("_bo")).groupBy(*group, old).agg(F.count(F.lit(1)).alias("_no"))
    one_new = tops.filter(F.col(score) == F.col("_bn")).groupBy(*group, new).agg(F.count(F.lit(1)).alias("_nn"))
    kept = tops.filter((F.col(score) == F.col("_bo")) & (F.col(score) == F.col("_bn")))
    kept = kept.join(one_old.filter("_no = 1"), [*group, old], "left_semi").join(one_new.filter("_nn = 1"), [*group, new], "left_semi")
    return kept.select(*pairs.columns)


def crossing(pairs: DataFrame, group: list[str], old: str, new: str) -> DataFrame:
    """pairs with ``crosses``: whether another pair of the group lies the other way round."""
    order = Window.partitionBy(*group).orderBy(old, new)
    before = F.max(new).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(new).over(order.rowsBetween(1, Window.unboundedFollowing))
    return pairs.withColumn("crosses", F.coalesce(before > F.col(new), F.lit(False)) | F.coalesce(after < F.col(new), F.lit(False)))


def within_anchors(candidates: DataFrame, anchors: DataFrame, group: list[str], old: str, new: str) -> DataFrame:
    """Candidates that lie between the same two neighbouring anchors on both sides: as many anchors are before them."""

    def before(side: str, name: str) -> DataFrame:
        points = candidates.select(*group, F.col(side).alias("_at"), F.lit(0).alias("_a")).distinct().unionAll(anchors.select(*group, F.col(side).alias("_at"), F.lit(1).alias("_a")))
        upto = Window.partitionBy(*group).orderBy("_at").rangeBetween(Window.unboundedPreceding, -1)
        return points.withColumn(name, F.coalesce(F.sum("_a").over(upto), F.lit(0))).filter("_a = 0").select(*group, F.col("_at").alias(side), name)

    out = candidates.join(before(old, "_bo"), [*group, old]).join(before(new, "_bn"), [*group, new])
    return out.filter("_bo = _bn").select(*candidates.columns)


def nearest_matched(rows: DataFrame, group: list[str], order: str, matched: str) -> DataFrame:
    """rows with ``before`` and ``after``: the nearest matched value on either side, as of the row."""
    w = Window.partitionBy(*group).orderBy(order)
    return rows.withColumn("before", F.last(matched, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn(
        "after", F.first(matched, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    )


def bracketed(rows: DataFrame, group: list[str], order: str, matched: str) -> DataFrame:
    """rows whose two direct neighbours are matched, one after the other on the other side with one place between."""
    w = Window.partitionBy(*group).orderBy(order)
    return rows.withColumn("_p", F.lag(matched).over(w)).withColumn("_n", F.lead(matched).over(w)).filter("_p is not null and _n is not null and _n = _p + 2").drop("_p", "_n")


def relative_position(group: list[str], order: str) -> Column:
    """Place from 0 to 1; the only row of its group is at 0."""
    return F.percent_rank().over(Window.partitionBy(*group).orderBy(order))


def runs(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """Runs of values that each are one more than the last: group, first, last, length."""
    w = Window.partitionBy(*group).orderBy(value)
    island = rows.select(*group, value).distinct().withColumn("_i", F.col(value) - F.row_number().over(w))
    return island.groupBy(*group, "_i").agg(F.min(value).alias("first"), F.max(value).alias("last"), F.count(F.lit(1)).alias("length")).drop("_i")


def longest_run(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """The longest run of each group, the first of equally long ones."""
    w = Window.partitionBy(*group).orderBy(F.desc("length"), "first")
    return runs(rows, group, value).withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def increasing(rows: DataFrame, group: list[str], order: str, value: str) -> DataFrame:
    """For each group whether the value rises strictly along the order."""
    w = Window.partitionBy(*group).orderBy(order)
    return rows.withColumn("_ok", F.coalesce(F.col(value) > F.lag(value).over(w), F.lit(True))).groupBy(*group).agg(F.bool_and("_ok").alias("increasing"))


def continuation_runs(rows: DataFrame, group: list[str], order: list[str], same: Column, name: str = "run") -> DataFrame:
    """rows with a run number that rises wherever ``same`` (an expression over lag and the row) isn't true."""
    w = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn("_new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def offset_support(pairs: DataFrame, group: list[str], old: str, new: str, least: int = 2) -> DataFrame:
    """Groups with exactly one non-zero offset new - old that at least ``least`` pairs prove: group, offset, support."""
    counted = pairs.withColumn("offset", F.col(new) - F.col(old)).filter("offset <> 0").groupBy(*group, "offset").agg(F.count(F.lit(1)).alias("support")).filter(F.col("support") >= least)
    one = counted.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).filter("_n = 1").drop("_n")
    return counted.join(one, group, "left_semi")
