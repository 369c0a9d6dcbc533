"""Captions and contexts of tables over two revisions: cores that several captions share, families of numbers that moved, runs of
one caption, enclosing sections, lists of captions; and pages that hold one text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from variorum.functions import text as T
from variorum.operators.bags import dice_similarity
from variorum.operators.ordered import crossing, occurrence, unique_only

#: Least words of a core, least and most tables of a group on a side, least anchors of a family.
CORE, GROUP, ANCHORS = 4, (2, 3), 3


def core_groups(old: DataFrame, new: DataFrame, doc: list[str]) -> DataFrame:
    """Tables of both sides whose captions share a core of four words or more that two or three tables of each side have: doc,
    old_tables, new_tables, core. Only where a document has one such grouping, and no caption of it twice: for review.

    old, new: doc, table_id, caption.
    """

    def held(rows: DataFrame, side: str) -> DataFrame:
        words = F.regexp_extract_all(T.caption_descriptor(F.col("caption")), F.lit(r"([a-z0-9]+|[\x{3400}-\x{9FFF}]+)"), F.lit(1))
        at = rows.select(*doc, "table_id", F.lower(T.collapsed("caption")).alias("_c"), words.alias("_w")).filter(F.size("_w") >= CORE)
        spans = at.withColumn("_i", F.explode(F.sequence(F.lit(1), F.size("_w") - CORE + 1)))
        spans = spans.withColumn("_n", F.explode(F.sequence(F.lit(CORE), F.size("_w") - F.col("_i") + 1)))
        cores = spans.select(*doc, "table_id", "_c", F.array_join(F.slice("_w", F.col("_i"), F.col("_n")), " ").alias("core")).distinct()
        few = cores.groupBy(*doc, "core").agg(F.count(F.lit(1)).alias("_k")).filter(F.col("_k").between(*GROUP)).drop("_k")
        listed = cores.join(few, [*doc, "core"]).groupBy(*doc, "core")
        return listed.agg(F.array_sort(F.collect_list("table_id")).alias(f"{side}_tables"), F.collect_list("_c").alias(f"_{side}"))

    met = held(old, "old").join(held(new, "new"), [*doc, "core"])
    named = met.groupBy(*doc, "old_tables", "new_tables").agg(F.max_by("core", F.struct(F.length("core"), "core")).alias("core"), F.first(F.concat("_old", "_new")).alias("_all"))
    told = named.filter(F.size(F.array_distinct("_all")) == F.size("_all"))
    one = named.groupBy(*doc).agg(F.count(F.lit(1)).alias("_k")).filter("_k = 1").drop("_k")
    return told.join(one, doc, "left_semi").select(*doc, "old_tables", "new_tables", "core")


def family_map(old: DataFrame, new: DataFrame, doc: list[str]) -> DataFrame:
    """Families of table numbers that became another: doc, old_family, new_family, anchors.

    Proven by three or more descriptors that come once on both sides, all in one order, where neither family has
    another partner. old, new: doc, ord, family, descriptor.
    """
    side = lambda rows, name: unique_only(rows.filter("descriptor <> ''"), [*doc, "descriptor"]).select(*doc, "descriptor", F.col("ord").alias(f"{name}_ord"), F.col("family").alias(f"{name}_family"))
    pairs = side(old, "old").join(side(new, "new"), [*doc, "descriptor"]).filter("old_family <> new_family")
    family = [*doc, "old_family", "new_family"]
    found = crossing(pairs, family, "old_ord", "new_ord").groupBy(*family).agg(F.count(F.lit(1)).alias("anchors"), F.bool_or("crosses").alias("_x"))
    alone = unique_only(found, [*doc, "old_family"]).join(unique_only(found, [*doc, "new_family"]).select(*family), family, "left_semi")
    return alone.filter((F.col("anchors") >= ANCHORS) & ~F.col("_x")).drop("_x")


def aligned_runs(old: DataFrame, new: DataFrame, doc: list[str]) -> DataFrame:
    """Tables of one caption that comes more than once, aligned by the longest common order of their contents: doc, caption,
    old_table, new_table. Of equally long alignments the one with the earliest old, then new places is taken.

    old, new: doc, caption, ord, table_id, content (a key of all rows). Solved for one caption of one document at a time.
    """
    key = [*doc, "caption"]
    tagged = old.select(*key, "ord", "table_id", "content", F.lit(0).alias("side")).unionByName(new.select(*key, "ord", "table_id", "content", F.lit(1).alias("side")))
    often = tagged.groupBy(*key).agg(F.count_if(F.col("side") == 0).alias("_a"), F.count_if(F.col("side") == 1).alias("_b")).filter("_a > 0 and _b > 0 and greatest(_a, _b) > 1").select(*key)

    def solve(k: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["side", "ord", "table_id"])
        a, b = (rows[rows.side == s] for s in (0, 1))
        pairs = common_order(a.content.tolist(), b.content.tolist())
        return pd.DataFrame([(*k, a.table_id.iloc[i], b.table_id.iloc[j]) for i, j in pairs], columns=[*key, "old_table", "new_table"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in tagged.select(*key).schema)
    ids = tagged.schema["table_id"].dataType.simpleString()
    return tagged.join(often, key, "left_semi").groupBy(*key).applyInPandas(solve, f"{schema}, old_table {ids}, new_table {ids}")


def common_order(a: list, b: list) -> list[tuple[int, int]]:
    """Places of a longest common subsequence, the earliest in a, then in b."""
    left = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in reversed(range(len(a))):
        for j in reversed(range(len(b))):
            left[i][j] = left[i + 1][j + 1] + 1 if a[i] == b[j] else max(left[i + 1][j], left[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b) and left[i][j]:
        # a[i] belongs to a longest one if its first partner from here on keeps the length
        k = next((k for k in range(j, len(b)) if b[k] == a[i]), None)
        if k is not None and left[i + 1][k + 1] + 1 == left[i][j]:
            out.append((i, k))
            j = k + 1
        i += 1
    return out


def table_context(tables: DataFrame, sections: DataFrame, doc: list[str]) -> DataFrame:
    """tables with ``context``: the innermost section around their page (most numbers, then level, then latest start, then place),
    as its numbers and title, or its heading; empty where none is. tables: doc, table_id, page_no. sections: doc, ord,
    number_path, level, title, heading, start_page, end_page."""
    name = F.when(F.size("number_path") > 0, F.concat(F.lit("number:"), F.array_join("number_path", "/"), F.lit("\x1ftitle:"), F.lower(T.collapsed("title")))).otherwise(F.concat(F.lit("heading:"), F.lower(T.collapsed("heading"))))
    pages = tables.select(*doc, "page_no").distinct()
    spread = sections.withColumn("_name", name).withColumn("page_no", F.explode(F.sequence("start_page", "end_page"))).join(pages, [*doc, "page_no"], "left_semi")
    inner = spread.groupBy(*doc, "page_no").agg(F.max_by("_name", F.struct(F.size("number_path"), "level", "start_page", "ord")).alias("context"))
    return tables.join(inner, [*doc, "page_no"], "left").withColumn("context", F.coalesce("context", F.lit("")))


def catalog_similarity(old: DataFrame, new: DataFrame, doc: list[str]) -> DataFrame:
    """How alike two lists of figures or tables are, as bags of (identifier, title): doc, shared, old_total, new_total, dice.

    old, new: one row for each entry, repeats included."""
    return dice_similarity(old, new, doc, ["identifier", "title"])


def page_pairs(old: DataFrame, new: DataFrame, doc: list[str], key: str = "key") -> DataFrame:
    """Pages of one text: doc, old_page, new_page, basis. A text that one page of each side has pairs them; where both sides have
    as many pages and the same text at every place, pages pair by place. old, new: doc, page_no, key; empty keys pair by
    place only."""
    alone = lambda rows, name: unique_only(rows.filter(F.col(key) != ""), [*doc, key]).select(*doc, key, F.col("page_no").alias(name))
    once = alone(old, "old_page").join(alone(new, "new_page"), [*doc, key]).select(*doc, "old_page", "new_page", F.lit("unique_text").alias("basis"))
    w = Window.partitionBy(*doc).orderBy("page_no")
    placed = lambda rows, name: rows.select(*doc, F.row_number().over(w).alias("_i"), F.col(key).alias(f"_{name}"), F.col("page_no").alias(name))
    both = placed(old, "old_page").join(placed(new, "new_page"), [*doc, "_i"], "full")
    same = both.groupBy(*doc).agg(F.bool_and(F.coalesce(F.col("_old_page") == F.col("_new_page"), F.lit(False))).alias("_s")).filter("_s").select(*doc)
    by_place = both.join(same, doc, "left_semi").select(*doc, "old_page", "new_page").join(once, [*doc, "old_page", "new_page"], "left_anti")
    return once.unionByName(by_place.withColumn("basis", F.lit("equal_sequence")))


def covered_fragments(fragments: DataFrame, table_texts: DataFrame, doc: list[str], *, text: str = "text") -> DataFrame:
    """Fragments all of whose words, each as often, are in the document's table text: doc, fragment_id. They leave the reader's
    view, not the audit."""
    each = lambda rows, c: F.explode(F.filter(F.split(F.lower(T.collapsed(F.col(c))), " "), lambda x: x != "")).alias("_w")
    have = table_texts.select(*doc, each(table_texts, text))
    asked = fragments.select(*doc, "fragment_id", each(fragments, text))
    # a document's table words are told to each of its fragments that could use them, already counted
    bag = have.groupBy(*doc, "_w").agg(F.count(F.lit(1)).alias("_have"))
    want = asked.groupBy(*doc, "fragment_id", "_w").agg(F.count(F.lit(1)).alias("_want"))
    met = want.join(bag, [*doc, "_w"], "left").groupBy(*doc, "fragment_id").agg(F.bool_and(F.coalesce(F.col("_have") >= F.col("_want"), F.lit(False))).alias("_all"))
    return met.filter("_all").select(*doc, "fragment_id")


def refilled(shown: DataFrame, audit: DataFrame, group: list[str], item: str, order: str, limit: int) -> DataFrame:
    """What a reader sees of each group: ``shown`` and, up to ``limit``, occurrences of the audit beyond those shown, in order:
    group, item, order. Occurrences count one for one; more shown than the limit are cut in order."""
    w = Window.partitionBy(*group).orderBy("_new", order, item)
    had = shown.groupBy(*group, item).agg(F.count(F.lit(1)).alias("_had"))
    more = occurrence(audit, [*group, item], [order], "_occ").join(had, [*group, item], "left").filter(F.col("_occ") > F.coalesce("_had", F.lit(0)))
    rows = shown.select(*group, item, order, F.lit(0).alias("_new")).unionByName(more.select(*group, item, order, F.lit(1).alias("_new")))
    return rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= max(0, limit)).drop("_r", "_new")


def partial_window(start: Column, end: Column, total: Column) -> Column:
    """Whether a selection of pages is known to leave some out."""
    return F.coalesce(start.isNotNull() & end.isNotNull() & ((start > 1) | ((total > 0) & (end < total))), F.lit(False))


def ordered_sections(changes: DataFrame) -> DataFrame:
    """By the first page of either side, the publication's own sections last on it, then heading."""
    return changes.orderBy(F.coalesce(F.least("old_page", "new_page"), F.lit(0)), F.when(F.col("role") == "document_metadata", 1).otherwise(0), F.coalesce("new_heading", "old_heading"), F.coalesce("old_ord", "new_ord"))


def row_review_reason(old: Column, new: Column) -> Column:
    """Why two rows (arrays of (label, value), labels alike) that aren't equal are for review and no change: ``layout``
    (blanks alone, numbers as they were), ``digit_spacing`` (blanks inside a number), ``blank_unit`` (a unit on one side only),
    ``glyphs`` (private-use signs that read alike); null where none fits."""
    values = lambda c: F.transform(c, lambda x: x["value"])
    labels = lambda c: F.transform(c, lambda x: F.lower(x["label"]))
    tight = lambda c: F.transform(values(c), lambda v: F.regexp_replace(v, r"\\n|\\r|(?U)[\s\x{F020}]+", ""))
    digits = lambda c: F.regexp_extract_all(F.array_join(values(c), "|"), F.lit(r"(\d+)"), F.lit(1))
    differ = F.filter(F.arrays_zip(labels(old).alias("l"), values(old).alias("a"), values(new).alias("b")), lambda x: T.collapsed(x["a"]) != T.collapsed(x["b"]))
    unit = F.size(differ) == 1
    one = F.try_element_at(differ, F.lit(1))
    spaced = F.forall(differ, lambda x: (F.regexp_replace(x["a"], r"\s+", "") == F.regexp_replace(x["b"], r"\s+", "")) & F.regexp_replace(x["a"], r"\s+", "").rlike(r"^[+\-−]?\d+(?:\.\d+)?$"))
    read = lambda c: T.collapsed(T.symbol_font_decoded(F.array_join(values(c), "|")))
    glyph = T.private_use(F.array_join(F.concat(values(old), values(new)), "|"))
    same = (labels(old) == labels(new)) & (values(old) != values(new))
    return F.when(
        same,
        F.when((tight(old) == tight(new)) & (digits(old) == digits(new)), "layout")
        .when((F.size(differ) > 0) & spaced, "digit_spacing")
        .when(unit & one["l"].isin("unit", "units") & ((T.collapsed(one["a"]) == "") != (T.collapsed(one["b"]) == "")), "blank_unit")
        .when(glyph & (read(old) == read(new)), "glyphs"),
    )
