"""From pages of two revisions to changes, evidence and quality.

``compare`` takes pages(doc..., page_no, text, flags) of both sides for any number of document pairs and returns named
DataFrames; nothing is collected. Pairs that are equal are taken out before anything else runs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from variorum.functions import text as T
from variorum.operators import delta, match, quality, segment, tables
from variorum.plans.options import Options
from variorum.session import stored


@dataclass(frozen=True)
class Comparison:
    """identical: pairs taken out; sections of both sides (column side); matches; changes (audit); view (for readers);
    counts; assessment; table_changes, table_rows: tables of both sides and the rows of paired ones, each with the section
    that holds it; events: units with display flags. Tables and events are made when first asked for."""

    identical: DataFrame
    sections: DataFrame
    matches: DataFrame
    changes: DataFrame
    view: DataFrame
    counts: DataFrame
    assessment: DataFrame
    unit_events: Callable[[], DataFrame]
    made_tables: Callable[[], tuple[DataFrame, DataFrame]]

    @cached_property
    def _tables(self) -> tuple[DataFrame, DataFrame]:
        return self.made_tables()

    @property
    def table_changes(self) -> DataFrame:
        return self._tables[0]

    @property
    def table_rows(self) -> DataFrame:
        return self._tables[1]

    @cached_property
    def events(self) -> DataFrame:
        return self.unit_events()

    def tables(self) -> dict[str, DataFrame]:
        names = ("identical", "sections", "matches", "changes", "view", "counts", "assessment", "events", "table_changes", "table_rows")
        return {name: getattr(self, name) for name in names}


def sections_of(pages: DataFrame, doc: list[str], options: Options) -> DataFrame:
    """Sections: lines without page counters, then headings. Both sides go through it together, told apart by a column of doc."""
    # both steps read their rows more than once: stored, pages are made and cut once
    rows = stored(segment.lines(pages.select(*doc, "page_no", F.col("text")), keep=[*doc, "page_no"]).drop("raw"), "lines")
    return segment.sections(stored(segment.without_page_counters(rows, doc), "text-lines"), doc)


def compare(old: DataFrame, new: DataFrame, doc: list[str], options: Options = Options()) -> Comparison:
    old = quality.page_range(old, options.old_start_page, options.old_end_page)
    new = quality.page_range(new, options.new_start_page, options.new_end_page)
    identical = stored(match.identical_pairs(old, new, doc, "page_no", "text"), "identical")
    rest_old, rest_new = old.join(identical, doc, "left_anti"), new.join(identical, doc, "left_anti")
    # what feeds several stages is stored: it is made once, and plans stay small
    sides = rest_old.select(*doc, "page_no", "text", F.lit("old").alias("side")).unionByName(rest_new.select(*doc, "page_no", "text", F.lit("new").alias("side")))
    both = stored(sections_of(sides, [*doc, "side"], options), "sections")
    a, b = both.filter("side = 'old'").drop("side"), both.filter("side = 'new'").drop("side")
    windows = [x is not None and x > 1 for x in (options.old_start_page, options.new_start_page)]
    matches = stored(match.match_sections(a, b, doc, least=options.section_similarity, window=any(windows)), "matches")
    pairs = matches.filter("old_ord is not null and new_ord is not null").select(*doc, "old_ord", "new_ord")
    group = [*doc, "old_ord", "new_ord"]

    def side_units(sections: DataFrame, side: str) -> DataFrame:
        rows = sections.withColumnRenamed("ord", f"{side}_ord").join(pairs, [*doc, f"{side}_ord"])
        rows = rows.select(*group, F.posexplode(F.split("body", "\n")).alias("line_no", "line")).filter("line <> ''")
        blocks = segment.merged_lines(rows, group, ["line_no"])
        return segment.units(blocks, group, ["block"])

    def events() -> DataFrame:
        old_units, new_units = stored(side_units(a, "old"), "old-units"), stored(side_units(b, "new"), "new-units")
        unit_pairs = match.pair_units(old_units, new_units, group, least=options.unit_similarity)
        return delta.top_snippets(delta.unit_events(old_units, new_units, unit_pairs, group).filter("kind <> 'unchanged'"), group, options.snippets)

    def table_results() -> tuple[DataFrame, DataFrame]:
        rows = segment.lines(sides.select(*doc, "side", "page_no", F.col("text")), keep=[*doc, "side", "page_no"])
        found, cells = (stored(x, name) for x, name in zip(tables.captioned_tables(rows, [*doc, "side"]), ("tables", "cells")))
        one = lambda side: tuple(x.filter(F.col("side") == side).drop("side") for x in (found, cells))
        told, row_kinds = tables.compare_tables(one("old"), one("new"), doc, least=options.table_similarity)
        # the section around a table, on the side where it stands
        told = told.withColumn("page_no", F.coalesce("new_page", "old_page"))
        held = match.containing_section(told.filter("new_table is not null"), b, doc).unionByName(match.containing_section(told.filter("new_table is null"), a, doc))
        return held.withColumnRenamed("ord", "section_ord").drop("page_no"), row_kinds

    complete = lambda pages, sections: sections.select(*doc, "ord").withColumn("whole", F.lit(True)) if "layout_risk" not in pages.columns else match.containing_section(
        pages.select(*doc, "page_no", F.coalesce("layout_risk", F.lit(False)).alias("_r")), sections, doc
    ).groupBy(*doc, "ord").agg((~F.bool_or("_r")).alias("whole"))
    only_old = matches.filter("basis = 'only_old'").select(*doc, F.col("old_ord").alias("ord"))
    only_new = matches.filter("basis = 'only_new'").select(*doc, F.col("new_ord").alias("ord"))
    proven = match.absence(only_old, pairs.select(*doc, F.col("old_ord").alias("ord"), F.col("new_ord").alias("other")), complete(rest_new, b), doc).withColumn("side", F.lit("old"))
    proven = proven.unionByName(match.absence(only_new, pairs.select(*doc, F.col("new_ord").alias("ord"), F.col("old_ord").alias("other")), complete(rest_old, a), doc).withColumn("side", F.lit("new")))
    changes = delta.section_changes(a, b, matches, doc, proven=proven, general=options.general)
    changes = delta.boundary_prelude(changes, both, doc, old_window=windows[0], new_window=windows[1])
    if not options.include_unchanged:
        changes = changes.filter("change_type <> 'unchanged'")
    metrics = lambda pages, sections: quality.document_metrics(pages, doc).join(quality.section_metrics(sections, doc), doc, "left")
    assessment = quality.pair_assessment(metrics(rest_old, a), metrics(rest_new, b), doc, pairing=quality.pairing_counts(matches, doc))
    assessment = assessment.unionByName(identical.select(*doc, F.lit("reliable").alias("state"), F.array().cast("array<string>").alias("reasons")))
    return Comparison(identical, both, matches, changes, delta.reader_view(changes), quality.change_counts(changes, doc), assessment, events, table_results)


def run_comparison(spark: SparkSession, old_path: str, new_path: str, out: str, options: Options = Options(), doc: list[str] | None = None) -> Comparison:
    """Compare two Parquet tables of pages and publish every result as a table below ``out``, in one step."""
    from variorum.sources import sinks

    doc = doc or ["doc_id"]
    result = compare(spark.read.parquet(old_path), spark.read.parquet(new_path), doc, options)

    def write(folder: str) -> None:
        for name, rows in result.tables().items():
            rows.write.parquet(f"{folder}/{name}")
        sinks.write_section_changes(result.view, f"{folder}/changes_csv")

    sinks.publish(spark, out, write)
    return result


def text_normalised_pages(docs: DataFrame, doc: str = "doc_id", *, lines_per_page: int = 40) -> DataFrame:
    """Pages from whole texts: every ``lines_per_page`` lines are one."""
    rows = docs.select(doc, F.posexplode(F.split("text", "\n")).alias("_n", "line"))
    rows = rows.withColumn("page_no", (F.floor(F.col("_n") / lines_per_page) + 1).cast("int"))
    return rows.groupBy(doc, "page_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "line"))), lambda x: x["line"]), "\n").alias("text"))


def cosmetic_pages(pages: DataFrame) -> DataFrame:
    return pages.withColumn("text", T.cosmetic_key(F.col("text")))
