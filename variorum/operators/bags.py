"""Bags: every occurrence is a fact of its own. None of these removes duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counts(rows: DataFrame, keys: list[str], name: str = "n") -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def bag_intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersectAll(b)


def bag_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(b)


def bag_union(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with the sum of both counts."""
    return counts(a.select(*keys).unionAll(b.select(*keys)), keys)


def bag_compare(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """For each key: old_n, new_n, shared, only_old, only_new. One shuffle, combined before it: sides are counted together."""
    tagged = old.select(*keys, F.lit(1).alias("_o"), F.lit(0).alias("_n")).unionAll(new.select(*keys, F.lit(0).alias("_o"), F.lit(1).alias("_n")))
    out = tagged.groupBy(*keys).agg(F.sum("_o").alias("old_n"), F.sum("_n").alias("new_n"))
    return out.withColumns({"shared": F.least("old_n", "new_n"), "only_old": F.greatest(F.col("old_n") - F.col("new_n"), F.lit(0)), "only_new": F.greatest(F.col("new_n") - F.col("old_n"), F.lit(0))})


def dice_similarity(old: DataFrame, new: DataFrame, group: list[str], keys: list[str]) -> DataFrame:
    """For each group: shared occurrences, both totals, twice the shared over all."""
    each = bag_compare(old, new, [*group, *keys]).groupBy(*group).agg(F.sum("shared").alias("shared"), F.sum("old_n").alias("old_total"), F.sum("new_n").alias("new_total"))
    return each.withColumn("dice", 2.0 * F.col("shared") / (F.col("old_total") + F.col("new_total")))


def contained(fragment: DataFrame, evidence: DataFrame, group: list[str], key: str) -> DataFrame:
    """Groups of fragment all of whose occurrences are in the group's evidence bag."""
    each = bag_compare(fragment, evidence, [*group, key])
    return each.groupBy(*group).agg(F.max("only_old").alias("_missing"), F.max("old_n").alias("_any")).filter("_missing = 0 and _any > 0").select(*group)


def ordered_distinct(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Each key once, at its first place."""
    return rows.groupBy(*keys).agg(F.min(order).alias(order))


def hidden_removed(audit: DataFrame, hidden: DataFrame) -> DataFrame:
    """The audit facts less the hidden occurrences, one for one."""
    return audit.exceptAll(hidden)


def intervals_merged(rows: DataFrame, group: list[str], start: str, end: str) -> DataFrame:
    """Disjoint intervals that cover what rows' half-open intervals cover."""
    order = Window.partitionBy(*group).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col(start) <= reach, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_island", island).groupBy(*group, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def intervals_subtracted(rows: DataFrame, holes: DataFrame, group: list[str], start: str, end: str) -> DataFrame:
    """What of rows' intervals no hole covers: borders in order, open while inside a row and outside all holes."""
    borders = []
    for frame, a, b in ((rows, 1, 0), (holes, 0, 1)):
        borders.append(frame.select(*group, F.col(start).alias("at"), F.lit(a).alias("inside"), F.lit(b).alias("cut")))
        borders.append(frame.select(*group, F.col(end).alias("at"), F.lit(-a).alias("inside"), F.lit(-b).alias("cut")))
    events = borders[0]
    for b in borders[1:]:
        events = events.unionAll(b)
    events = events.groupBy(*group, "at").agg(F.sum("inside").alias("inside"), F.sum("cut").alias("cut"))
    order = Window.partitionBy(*group).orderBy("at")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    parts = events.withColumn("_in", F.sum("inside").over(upto)).withColumn("_cut", F.sum("cut").over(upto)).withColumn("_next", F.lead("at").over(order))
    return parts.filter("_in > 0 and _cut = 0 and _next is not null").select(*group, F.col("at").alias(start), F.col("_next").alias(end))


def array_bag_overlap(a: Column, b: Column) -> Column:
    """Shared occurrences of two arrays of strings."""
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda n, x: n + F.least(F.size(F.filter(a, lambda y: y == x)), F.size(F.filter(b, lambda y: y == x))))
