"""Quality of documents and pairs: counters, routes, reasons, states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Limits of a reliable reading.
LEAST_CHARACTERS, MOST_EMPTY, LEAST_DENSITY, LEAST_PAGES, FRAGMENT_LINES, FRAGMENT_LENGTH, FRAGMENT_SHARE = 500, 0.20, 200, 3, 40, 4.0, 0.5
ONE_SIDED, ONE_SIDED_RATIO, FALLBACK_PAIRS = 10, 3.0, 5


def page_route(ocr: Column, image: Column, risk: Column, characters: Column) -> Column:
    """One of five routes, the first that fits: OCR, image, layout risk, empty, native text."""
    return F.when(ocr, "ocr").when(image, "image_review").when(risk, "layout_review").when(characters == 0, "empty").otherwise("native_text")


def page_range(rows: DataFrame, start: int | None, end: int | None, *, page: str = "page_no") -> DataFrame:
    """Rows of pages from start to end, both included and from 1; the filter reaches the scan."""
    if start is not None and start < 1 or start is not None and end is not None and end < start:
        raise ValueError("a page range begins at 1 and doesn't end before it begins")
    if start is not None:
        rows = rows.filter(F.col(page) >= start)
    return rows if end is None else rows.filter(F.col(page) <= end)


def page_audit(pages: DataFrame, blocks: DataFrame, doc: list[str]) -> DataFrame:
    """For each page: characters, route, blocks and their kinds."""
    kinds = blocks.groupBy(*doc, "page_no").agg(F.count(F.lit(1)).alias("blocks"), F.count_if(F.col("kind") == "table").alias("table_blocks"), F.count_if(F.col("kind") == "ocr").alias("ocr_blocks"))
    told = pages.join(kinds, [*doc, "page_no"], "left")
    no = F.lit(False)
    route = page_route(F.coalesce("ocr_used", no), F.coalesce("image_dominant", no), F.coalesce("layout_risk", no), F.length(F.coalesce("text", F.lit(""))))
    return told.select(*doc, "page_no", F.length(F.coalesce("text", F.lit(""))).alias("characters"), route.alias("route"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("blocks", "table_blocks", "ocr_blocks")])


def route_pages(audit: DataFrame, doc: list[str]) -> DataFrame:
    return audit.groupBy(*doc, "route").agg(F.array_sort(F.collect_list("page_no")).alias("pages"))


def document_metrics(pages: DataFrame, doc: list[str]) -> DataFrame:
    """Counters of a document from its pages (page_no, text and flags)."""
    text = F.coalesce("text", F.lit(""))
    flag = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False))) if c in pages.columns else F.lit(0).cast("long")
    words = F.size(F.filter(F.split(text, r"\s+"), lambda x: x != ""))
    out = pages.groupBy(*doc).agg(
        F.count(F.lit(1)).alias("pages"), F.count_if(F.length(F.trim(text)) == 0).alias("empty_pages"), F.sum(F.length(text)).alias("characters"), F.sum(words).alias("words"),
        F.min("page_no").alias("first_page"), F.max("page_no").alias("last_page"), flag("layout_risk").alias("layout_risk_pages"), flag("ocr_used").alias("ocr_pages"), flag("image_dominant").alias("image_pages"),
    )
    return out.withColumn("empty_ratio", F.col("empty_pages") / F.col("pages")).withColumn("consistent_window", F.col("last_page") - F.col("first_page") + 1 == F.col("pages"))


def section_metrics(sections: DataFrame, doc: list[str]) -> DataFrame:
    duplicates = sections.groupBy(*doc, "identity_key").agg(F.count(F.lit(1)).alias("_n")).groupBy(*doc).agg(F.sum(F.col("_n") - 1).alias("duplicate_paths"))
    told = sections.groupBy(*doc).agg(
        F.count(F.lit(1)).alias("sections"), F.count_if(F.col("section_id").startswith("P")).alias("fallback_sections"), F.count_if(F.size("number_path") == 0).alias("unnumbered_sections"),
        F.sum(F.when(F.col("role") == "technical", F.length("body")).otherwise(0)).alias("technical_characters"),
    )
    return told.join(duplicates, doc)


def fragmentation(lines: DataFrame, doc: list[str], *, line: str = "line") -> DataFrame:
    """Documents of many very short lines: doc, lines, average length, share of single characters, fragmented."""
    out = lines.groupBy(*doc).agg(F.count(F.lit(1)).alias("lines"), F.avg(F.length(line)).alias("average"), F.avg(F.when(F.length(line) == 1, 1.0).otherwise(0.0)).alias("single"))
    return out.withColumn("fragmented", (F.col("lines") >= FRAGMENT_LINES) & ((F.col("average") <= FRAGMENT_LENGTH) | (F.col("single") >= FRAGMENT_SHARE)))


def repeated_edge_characters(lines: DataFrame, doc: list[str], *, page: str = "page_no", order: str = "line_no") -> DataFrame:
    """Characters of first and last lines that are on three quarters of the pages, three at the least: to be discounted."""
    up, down = Window.partitionBy(*doc, page).orderBy(order), Window.partitionBy(*doc, page).orderBy(F.desc(order))
    edges = lines.withColumn("_e", (F.row_number().over(up) == 1) | (F.row_number().over(down) == 1)).filter("_e")
    pages = lines.groupBy(*doc).agg(F.count_distinct(page).alias("_pages"))
    often = edges.groupBy(*doc, "line").agg(F.count_distinct(page).alias("_n"), F.count(F.lit(1)).alias("_all")).join(pages, doc).filter(F.col("_n") >= F.greatest(F.lit(3), F.ceil(0.75 * F.col("_pages"))))
    return often.groupBy(*doc).agg(F.sum(F.length("line") * F.col("_all")).alias("repeated_characters"))


def ambiguous_context_pages(tables: DataFrame, sections: DataFrame, doc: list[str]) -> DataFrame:
    """Pages with several tables and several sections: whose table is whose isn't known."""
    spread = sections.select(*doc, F.explode(F.sequence("start_page", "end_page")).alias("page_no")).groupBy(*doc, "page_no").agg(F.count(F.lit(1)).alias("sections"))
    return tables.groupBy(*doc, "page_no").agg(F.count(F.lit(1)).alias("tables")).join(spread, [*doc, "page_no"]).filter("tables > 1 and sections > 1")


def window_consistency(pages: DataFrame, doc: list[str]) -> DataFrame:
    w = Window.partitionBy(*doc).orderBy("page_no")
    return pages.withColumn("_ok", F.coalesce(F.col("page_no") == F.lag("page_no").over(w) + 1, F.lit(True))).groupBy(*doc).agg(F.bool_and("_ok").alias("consistent"))


#: Reason and the condition over a side's metrics that gives it.
def reasons(m: dict[str, Column]) -> list[tuple[str, Column]]:
    return [
        ("few_characters", m["characters"] < LEAST_CHARACTERS),
        ("empty_pages", m["empty_ratio"] > MOST_EMPTY),
        ("inconsistent_window", ~m["consistent_window"]),
        ("low_density", (m["pages"] >= LEAST_PAGES) & (m["characters"] / m["pages"] < LEAST_DENSITY)),
        ("layout_risk", m["layout_risk_pages"] > 0),
        ("ocr", m["ocr_pages"] > 0),
        ("image_pages", m["image_pages"] > 0),
        ("fallback_sections", m["fallback_sections"] > 0),
        ("unnumbered_sections", m["unnumbered_sections"] > 0),
        ("duplicate_paths", m["duplicate_paths"] > 0),
        ("one_stable_section", (m["pages"] >= LEAST_PAGES) & (m["sections"] <= 1)),
    ]


def pair_assessment(old: DataFrame, new: DataFrame, doc: list[str], *, pairing: DataFrame | None = None) -> DataFrame:
    """doc, state, reasons: indeterminate where a side has no characters or sections, degraded for any reason, else reliable.

    Only a reliable pair without changes may be said to have none. pairing: doc, one_sided, paired, conflicts, fallback_pairs.
    """
    names = [c for c in old.columns if c not in doc]
    both = old.select(*doc, *[F.col(c).alias(f"old_{c}") for c in names]).join(new.select(*doc, *[F.col(c).alias(f"new_{c}") for c in names]), doc, "full")
    told = []
    for side in ("old", "new"):
        told += [F.when(F.coalesce(cond, F.lit(False)), f"{side}_{name}") for name, cond in reasons({c: F.col(f"{side}_{c}") for c in names})]
    if pairing is not None:
        both = both.join(pairing, doc, "left")
        told += [
            F.when(F.col("conflicts") > 0, "order_conflicts"),
            F.when((F.col("one_sided") >= ONE_SIDED) & (F.col("one_sided") > ONE_SIDED_RATIO * F.col("paired")), "one_sided"),
            F.when((F.col("fallback_pairs") >= FALLBACK_PAIRS) & (F.col("fallback_pairs") > 0.5 * F.col("paired")), "fallback_pairs"),
        ]
    empty = F.lit(False)
    for side in ("old", "new"):
        empty = empty | (F.coalesce(f"{side}_characters", F.lit(0)) == 0) | (F.coalesce(f"{side}_sections", F.lit(0)) == 0)
    found = F.array_compact(F.array(*told))
    return both.select(*doc, F.when(empty, "indeterminate").when(F.size(found) > 0, "degraded").otherwise("reliable").alias("state"), found.alias("reasons"))


def downgraded(assessment: DataFrame, visual: DataFrame, doc: list[str]) -> DataFrame:
    """Visual evidence of unexplained pages can only lower a state: visual has doc, unexplained."""
    out = assessment.join(visual, doc, "left")
    worse = F.coalesce(F.col("unexplained") > 0, F.lit(False))
    return out.select(*doc, F.when(worse & (F.col("state") == "reliable"), "degraded").otherwise(F.col("state")).alias("state"), F.when(worse, F.array_append("reasons", F.lit("visual_review"))).otherwise(F.col("reasons")).alias("reasons"))


def pairing_counts(matches: DataFrame, doc: list[str]) -> DataFrame:
    both = F.col("old_ord").isNotNull() & F.col("new_ord").isNotNull()
    return matches.groupBy(*doc).agg(
        F.count_if(both).alias("paired"), F.count_if(~both & (F.col("basis") != "ambiguous_order_conflict")).alias("one_sided"),
        F.count_if(F.col("basis") == "ambiguous_order_conflict").alias("conflicts"), F.count_if(F.col("basis") == "similarity_fallback").alias("fallback_pairs"),
    )


def change_counts(changes: DataFrame, doc: list[str]) -> DataFrame:
    return changes.groupBy(*doc, "change_type").agg(F.count(F.lit(1)).alias("n"))


def coverage_review(*parts: DataFrame) -> DataFrame:
    """Review items of all kinds in one table: doc, page_no, kind, n."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def reader_summary(changes: DataFrame, doc: list[str]) -> DataFrame:
    counted = {k: F.count_if(F.col("change_type") == k).alias(k) for k in ("modified", "added", "deleted", "unchanged", "review")}
    return changes.groupBy(*doc).agg(*counted.values())


def characters_conserved(before: DataFrame, after: DataFrame, doc: list[str], text: str = "text") -> DataFrame:
    """Documents whose characters, blanks aside, are not the same bag before and after."""
    from variorum.operators.bags import bag_compare

    letters = lambda rows: rows.select(*doc, F.explode(F.split(F.regexp_replace(text, r"(?U)\s+", ""), "")).alias("_c")).filter("_c <> ''")
    each = bag_compare(letters(before), letters(after), [*doc, "_c"])
    return each.filter("only_old > 0 or only_new > 0").select(*doc).distinct()
