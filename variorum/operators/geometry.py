"""Operators on words with places: validity, gutters, page numbers, watermarks, columns, coverage of a page by boxes.

A ``words`` table has a document's columns, page_no, text, x0, top, x1, bottom, and where an operator asks for them
page_width, page_height, size, angle. All are aggregates, windows and equi-joins on a document or page; nothing is collected.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from variorum.operators.ordered import runs

#: Fixed values of the proofs: least share of pages, least pages, spread of baselines and edges as shares of the page.
COVERAGE, LEAST_PAGES, SPREAD, GUTTER_COVERAGE, MARGIN = 0.8, 3, 0.006, 0.8, 0.12
#: What marks debris of figures, axes and formulas: only numbers and signs, one letter, dotted leaders, axis units.
NOISE = r"^(?:[\d\s.,%+−-]{1,24}|\p{L}|[.·…_\-–—\s]{3,}|[()\[\]{}=+*/^∑∫√<>|\s]+|\(?(?:GHz|MHz|kHz|Hz|dB|ns|ps|mV|V|mA|A|UI|mm)\)?)$"


def valid_words(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(words that can be used, the others with ``warning``): blank_text, missing_place, not_finite, empty_box, outside_page."""
    box = [F.col(c) for c in ("x0", "top", "x1", "bottom")]
    finite = [~F.isnan(c.cast("double")) & (F.abs(c) < F.lit(math.inf)) for c in box]
    warning = (
        F.when(F.trim(F.coalesce("text", F.lit(""))) == "", "blank_text")
        .when(F.greatest(*[c.isNull().cast("int") for c in box]) == 1, "missing_place")
        .when(~(finite[0] & finite[1] & finite[2] & finite[3]), "not_finite")
        .when((F.col("x1") <= F.col("x0")) | (F.col("bottom") <= F.col("top")), "empty_box")
        .when((F.col("x1") < 0) | (F.col("bottom") < 0) | (F.col("x0") > F.col("page_width")) | (F.col("top") > F.col("page_height")), "outside_page")
    )
    told = words.withColumn("warning", warning)
    return told.filter("warning is null").drop("warning"), told.filter("warning is not null")


def folio_runs(words: DataFrame, doc: list[str]) -> DataFrame:
    """Page numbers that are proven: doc, offset (number less page), first_page, last_page, pages, side_rule.

    Lone numbers in a margin, one on a page, make a run where number less page stays the same over at least three pages that
    follow each other, cover 80 % of the document's pages, and share a baseline; odd pages stand on one side and even
    pages on the other, or all in the middle or on one side.
    """
    centre = (F.col("x0") + F.col("x1")) / 2 / F.col("page_width")
    in_margin = (F.col("bottom") <= MARGIN * F.col("page_height")) | (F.col("top") >= (1 - MARGIN) * F.col("page_height"))
    found = words.filter(F.col("text").rlike(r"^\d{1,5}$") & in_margin)
    found = found.select(*doc, "page_no", (F.col("text").cast("int") - F.col("page_no")).alias("offset"), (F.col("bottom") / F.col("page_height")).alias("base"), F.when(centre < 0.4, "left").when(centre > 0.6, "right").otherwise("middle").alias("place"))
    one = found.groupBy(*doc, "offset", "page_no").agg(F.count(F.lit(1)).alias("n"), F.first("base").alias("base"), F.first("place").alias("place")).filter("n = 1")
    pages = words.groupBy(*doc).agg(F.count_distinct("page_no").alias("_all"))
    side = lambda odd: F.collect_set(F.when(F.col("page_no") % 2 == odd, F.col("place")))
    told = one.groupBy(*doc, "offset").agg(F.count(F.lit(1)).alias("pages"), (F.max("base") - F.min("base")).alias("spread"), side(1).alias("odd"), side(0).alias("even"))
    longest = runs(one, [*doc, "offset"], "page_no").groupBy(*doc, "offset").agg(F.max(F.struct("length", "first", "last")).alias("run"))
    told = told.join(pages, doc).join(longest, [*doc, "offset"])
    rule = F.when((F.size("odd") == 1) & (F.size("even") == 1), F.when(F.col("odd") == F.col("even"), "one_side").when(F.array_contains("odd", "middle") | F.array_contains("even", "middle"), None).otherwise("alternating"))
    enough = (F.col("pages") >= F.greatest(F.lit(LEAST_PAGES), F.ceil(COVERAGE * F.col("_all")))) & (F.col("run.length") >= LEAST_PAGES) & (F.col("spread") <= SPREAD)
    return told.withColumn("side_rule", rule).filter(enough & F.col("side_rule").isNotNull()).select(*doc, "offset", F.col("run.first").alias("first_page"), F.col("run.last").alias("last_page"), "pages", "side_rule")


def line_number_gutters(words: DataFrame, doc: list[str], *, grid: float = 0.01) -> DataFrame:
    """Columns of line numbers that are proven: doc, column (place on a grid of the page's width), pages, numbers.

    Numbers at one place near an edge that rise down the page, on at least three pages and 80 % of those of the document.
    """
    near_edge = (F.col("x1") <= MARGIN * F.col("page_width")) | (F.col("x0") >= (1 - MARGIN) * F.col("page_width"))
    found = words.filter(F.col("text").rlike(r"^\d{1,5}$") & near_edge).withColumn("column", F.round(F.col("x1") / F.col("page_width") / grid).cast("int")).withColumn("value", F.col("text").cast("int"))
    down = Window.partitionBy(*doc, "column", "page_no").orderBy("top", "x0")
    found = found.withColumn("rises", F.coalesce(F.col("value") > F.lag("value").over(down), F.lit(True)))
    page = found.groupBy(*doc, "column", "page_no").agg(F.count(F.lit(1)).alias("n"), F.bool_and("rises").alias("rises")).filter("n >= 3 and rises")
    pages = words.groupBy(*doc).agg(F.count_distinct("page_no").alias("_all"))
    out = page.groupBy(*doc, "column").agg(F.count(F.lit(1)).alias("pages"), F.sum("n").alias("numbers")).join(pages, doc)
    return out.filter((F.col("pages") >= LEAST_PAGES) & (F.col("pages") >= GUTTER_COVERAGE * F.col("_all"))).drop("_all")


def without_gutters(words: DataFrame, gutters: DataFrame, doc: list[str], *, grid: float = 0.01) -> DataFrame:
    """words less the numbers that stand in a proven gutter."""
    told = words.withColumn("_column", F.when(F.col("text").rlike(r"^\d{1,5}$"), F.round(F.col("x1") / F.col("page_width") / grid).cast("int")))
    return told.join(gutters.select(*doc, F.col("column").alias("_column")), [*doc, "_column"], "left_anti").select(*words.columns)


def watermarks(words: DataFrame, page: list[str], *, ratio: float = 2.0) -> DataFrame:
    """Groups of slanted words much larger than the page's median: page, angle, text, words."""
    usual = words.groupBy(*page).agg(F.percentile_approx("size", 0.5).alias("_usual"))
    slanted = words.join(usual, page).filter((F.abs(F.col("angle")) > 10) & (F.abs(F.col("angle")) < 80) & (F.col("size") >= ratio * F.col("_usual")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "top", "text"))), lambda x: x["text"]), " ")
    return slanted.groupBy(*page, F.round("angle").cast("int").alias("angle")).agg(text.alias("text"), F.count(F.lit(1)).alias("words"))


def without_watermarks(words: DataFrame, found: DataFrame, page: list[str], *, ratio: float = 2.0) -> DataFrame:
    usual = words.groupBy(*page).agg(F.percentile_approx("size", 0.5).alias("_usual"))
    told = words.join(usual, page).withColumn("_angle", F.when(F.col("size") >= ratio * F.col("_usual"), F.round("angle").cast("int")))
    return told.join(found.select(*page, F.col("angle").alias("_angle")), [*page, "_angle"], "left_anti").select(*words.columns)


def column_split(words: DataFrame, page: list[str], *, least: int = 6, gap: float = 0.03) -> DataFrame:
    """Pages with two columns: page, split (where the right one begins), left, right (words of each), crossing (words over the gap).

    The split is the widest stretch between 30 % and 70 % of the width that no word starts or ends in; a page has columns if the
    stretch is wide enough, both sides have enough words and at most a tenth of all cross it: a risk of wrong order.
    """
    told = words.select(*page, (F.col("x0") / F.col("page_width")).alias("l"), (F.col("x1") / F.col("page_width")).alias("r"))
    edges = told.select(*page, F.explode(F.array("l", "r")).alias("x")).filter("x >= 0.3 and x <= 0.7")
    edges = edges.unionByName(told.select(*page).distinct().withColumn("x", F.explode(F.array(F.lit(0.3), F.lit(0.7)))))
    w = Window.partitionBy(*page).orderBy("x")
    widest = edges.withColumn("next", F.lead("x").over(w)).filter("next is not null").groupBy(*page).agg(F.max(F.struct((F.col("next") - F.col("x")).alias("gap"), F.col("next").alias("split"), F.col("x").alias("from"))).alias("g"))
    sides = told.join(widest, page).groupBy(*page, F.col("g.split").alias("split"), F.col("g.gap").alias("gap")).agg(
        F.count_if(F.col("r") <= F.col("g.from")).alias("left"), F.count_if(F.col("l") >= F.col("g.split")).alias("right"), F.count_if((F.col("l") <= F.col("g.from")) & (F.col("r") >= F.col("g.split"))).alias("crossing")
    )
    return sides.filter((F.col("gap") >= gap) & (F.col("left") >= least) & (F.col("right") >= least) & (F.col("crossing") * 10 <= F.col("left") + F.col("right") + F.col("crossing"))).drop("gap")


def column_order(words: DataFrame, splits: DataFrame, page: list[str], *, line: float = 2.0) -> DataFrame:
    """words with ``place`` (from 1): down the left column, then the right one, where the page has two; else by line and left edge.
    A word over both columns parts them: what is above it comes before what is below."""
    told = words.join(splits.select(*page, (F.col("split") * F.lit(1.0)).alias("_split")), page, "left")
    over = F.col("_split").isNotNull() & (F.col("x0") < F.col("_split") * F.col("page_width")) & (F.col("x1") > F.col("_split") * F.col("page_width"))
    told = told.withColumn("_over", F.when(over, 1).otherwise(0)).withColumn("_line", F.floor(F.col("top") / line))
    down = Window.partitionBy(*page).orderBy("_line", F.desc("_over"), "x0", "text")
    told = told.withColumn("_band", F.sum("_over").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    side = F.when(F.col("_over") == 1, -1).when(F.col("_split").isNull(), 0).otherwise((F.col("x0") >= F.col("_split") * F.col("page_width")).cast("int"))
    order = Window.partitionBy(*page).orderBy("_band", side, "_line", "x0", "text")
    return told.withColumn("place", F.row_number().over(order)).select(*words.columns, "place")


def visual_noise(line: Column) -> Column:
    """Whether a line is debris of a figure, an axis, a plot or a formula."""
    return F.coalesce(F.trim(line).rlike(NOISE), F.lit(False))


def covered_share(boxes: DataFrame, page: list[str]) -> DataFrame:
    """page, covered: the share of the page that boxes cover together (overlaps once).

    A sweep over x: between two neighbouring edges the union of the boxes that span there, merged by a running maximum.
    """
    x0, x1 = F.greatest(F.col("x0"), F.lit(0.0)), F.least(F.col("x1"), F.col("page_width"))
    top, bottom = F.greatest(F.col("top"), F.lit(0.0)), F.least(F.col("bottom"), F.col("page_height"))
    cut = boxes.select(*page, x0.alias("x0"), x1.alias("x1"), top.alias("top"), bottom.alias("bottom"), (F.col("page_width") * F.col("page_height")).alias("area")).filter("x1 > x0 and bottom > top")
    edges = cut.select(*page, F.explode(F.array("x0", "x1")).alias("x")).distinct()
    strips = edges.withColumn("to", F.lead("x").over(Window.partitionBy(*page).orderBy("x"))).filter("to is not null")
    spans = strips.join(cut, page).filter((F.col("x0") <= F.col("x")) & (F.col("x1") >= F.col("to")))
    w = Window.partitionBy(*page, "x").orderBy("top", "bottom")
    seen = F.coalesce(F.max("bottom").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("top"))
    new = spans.withColumn("height", F.greatest(F.col("bottom") - F.greatest(F.col("top"), seen), F.lit(0.0)))
    return new.groupBy(*page).agg((F.sum(F.col("height") * (F.col("to") - F.col("x"))) / F.max("area")).alias("covered"))


def ocr_gate(images: DataFrame, text: DataFrame, page: list[str], *, share: float = 0.5) -> DataFrame:
    """Pages to be read from their image: images cover half of it or more and native text less than half."""
    told = covered_share(images, page).withColumnRenamed("covered", "image").join(covered_share(text, page).withColumnRenamed("covered", "native"), page, "left")
    return told.withColumn("ocr", (F.col("image") >= share) & (F.coalesce("native", F.lit(0.0)) < share))


def same_place_pairs(old: DataFrame, new: DataFrame, doc: list[str], pages: DataFrame, *, grid: float = 24.0, tolerance: float = 12.0) -> DataFrame:
    """Boxes at one place on paired pages, for review only: doc, old_id, new_id. pages: doc, old_page, new_page."""
    a = old.select(*doc, F.col("page_no").alias("old_page"), F.col("box_id").alias("old_id"), *[F.col(c).alias(f"a_{c}") for c in ("x0", "top", "x1", "bottom")])
    b = new.select(*doc, F.col("page_no").alias("new_page"), F.col("box_id").alias("new_id"), *[F.col(c).alias(f"b_{c}") for c in ("x0", "top", "x1", "bottom")])
    a = a.join(pages, [*doc, "old_page"]).withColumns({"_x": F.explode(F.sequence(F.floor((F.col("a_x0") - tolerance) / grid), F.floor((F.col("a_x0") + tolerance) / grid)))})
    b = b.withColumn("_x", F.floor(F.col("b_x0") / grid))
    met = a.join(b, [*doc, "new_page", "_x"])
    for c in ("x0", "top", "x1", "bottom"):
        met = met.filter(F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) <= tolerance)
    return met.select(*doc, "old_id", "new_id").distinct()
