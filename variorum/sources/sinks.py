"""Sinks: change tables as CSV and JSON, reports, read-back checks, publication in one step."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SECTION_COLUMNS = ["change_type", "role", "basis", "similarity", "review_reason", "old_heading", "new_heading", "old_page", "new_page", "old_body", "new_body"]


def _flat(rows: DataFrame) -> DataFrame:
    """Nested columns as JSON, doubles with six digits: what a CSV file can hold."""
    out = []
    for f in rows.schema:
        kind = f.dataType.typeName()
        c = F.col(f"`{f.name}`")
        out.append((F.to_json(c) if kind in ("array", "map", "struct") else F.format_string("%.6f", c) if kind == "double" else c).alias(f.name))
    return rows.select(*out)


def write_csv(rows: DataFrame, path: str, *, order: list | None = None, single: bool = False) -> None:
    """A header in every file. ``single`` puts a small report into one file; tables that grow are left in parts."""
    rows = rows.orderBy(*order) if order else rows
    flat = _flat(rows)
    (flat.coalesce(1) if single else flat).write.mode("overwrite").option("header", True).option("escape", '"').option("multiLine", True).csv(path)


def write_section_changes(changes: DataFrame, path: str, **kw) -> None:
    keys = [c for c in changes.columns if c not in SECTION_COLUMNS]
    write_csv(changes.select(*keys, *[c for c in SECTION_COLUMNS if c in changes.columns]), path, **kw)


def write_table_changes(changes: DataFrame, path: str, **kw) -> None:
    """One line for each changed row of a table; tables without one have a line too."""
    write_csv(changes.withColumn("row", F.explode_outer("row_changes")).select("*", "row.*").drop("row", "row_changes"), path, **kw)


def write_json(bundle: dict[str, DataFrame], path: str) -> None:
    for name, rows in bundle.items():
        rows.write.mode("overwrite").json(f"{path}/{name}")


def read_back_equal(rows: DataFrame, path: str) -> bool:
    """Whether the rows on disk are the rows: nothing is missing and nothing more is there, counted as bags."""
    flat = _flat(rows).select([F.col(c).cast("string").alias(c) for c in rows.columns])
    found = rows.sparkSession.read.option("header", True).option("escape", '"').option("multiLine", True).schema(flat.schema).csv(path)
    return flat.exceptAll(found).isEmpty() and found.exceptAll(flat).isEmpty()


def publish(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Let write fill a folder beside path, then give it path's name in one step. An existing path is an error."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(target):
        raise FileExistsError(path)
    staged = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    try:
        write(staged)
        if not files.rename(jvm.org.apache.hadoop.fs.Path(staged), target):
            raise OSError(f"{staged} can't be renamed to {path}")
    finally:
        files.delete(jvm.org.apache.hadoop.fs.Path(staged), True)


def write_appendix(sections: DataFrame, tables: DataFrame, path: str, **kw) -> None:
    """Pairs that scored full marks on everything, with the columns of the main tables, beside them."""
    write_section_changes(sections, f"{path}/sections", **kw)
    write_csv(tables, f"{path}/tables", **kw)


def html_report(changes: DataFrame, *, limit: int = 200, title: str = "Changes") -> str:
    """The first changes in reading order, both sides beside each other; deleted and inserted parts are marked. Texts are escaped.
    The limit is the report's, the tables hold all."""
    from html import escape

    from variorum.operators.delta import inline_marks, ordered_changes

    def marked(text: str, spans: list[dict], tag: str) -> str:
        out, at = [], 0
        for s in spans:
            out += [escape(text[at : s["start"]]), f"<{tag}>", escape(text[s["start"] : s["end"]]), f"</{tag}>"]
            at = s["end"]
        return "".join([*out, escape(text[at:])])

    cards = []
    for r in ordered_changes(changes.filter("change_type <> 'unchanged'")).limit(limit).collect():
        old, new = r["old_body"] or "", r["new_body"] or ""
        both = inline_marks(old, new) if r["old_body"] is not None and r["new_body"] is not None else []
        sides = [marked(text, [m for m in both if m["side"] == side], tag) for text, side, tag in ((old, "old", "del"), (new, "new", "ins"))]
        cards.append(f"<section class={escape(r['change_type'])!r}><h2>{escape(r['new_heading'] or r['old_heading'] or '')}</h2><table><tr><td><pre>{sides[0]}</pre></td><td><pre>{sides[1]}</pre></td></tr></table></section>")
    return f"<!doctype html><html><head><meta charset='utf-8'><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1>{''.join(cards)}</body></html>"


#: Formats that ``write_reports`` knows, and what each writes below the folder.
FORMATS = ("csv", "json", "markdown", "html")


def write_reports(bundle: dict[str, DataFrame], path: str, formats: tuple[str, ...] = FORMATS, *, limit: int = 200) -> list[str]:
    """Write the tables of a comparison (``changes`` and others) in the formats asked for, all or none, and return what is there.

    csv and json hold every row; markdown and html are one small file each with the first ``limit`` changes. An unknown format, or
    a folder that exists, is an error before anything is written.
    """
    if unknown := set(formats) - set(FORMATS):
        raise ValueError(f"no such format: {', '.join(sorted(unknown))}")
    spark = bundle["changes"].sparkSession

    def write(folder: str) -> None:
        for f in formats:
            if f == "csv":
                for name, rows in bundle.items():
                    (write_section_changes if name == "changes" else write_csv)(rows, f"{folder}/csv/{name}")
            elif f == "json":
                write_json(bundle, f"{folder}/json")
            else:
                text = (markdown_report if f == "markdown" else html_report)(bundle["changes"], limit=limit)
                spark.createDataFrame([(text,)], "value string").coalesce(1).write.option("lineSep", "\n").text(f"{folder}/{f}")

    publish(spark, path, write)
    return [f"{path}/{f}" for f in formats]


def markdown_report(changes: DataFrame, *, limit: int = 200) -> str:
    """The first changes in reading order as text; the limit is the report's, the tables hold all."""
    from variorum.operators.delta import ordered_changes

    out = ["# Changes", ""]
    for r in ordered_changes(changes.filter("change_type <> 'unchanged'")).limit(limit).collect():
        out += [f"## {r['change_type']}: {r['new_heading'] or r['old_heading']}", "", f"- before: {(r['old_body'] or '')[:400]}", f"- after: {(r['new_body'] or '')[:400]}", ""]
    return "\n".join(out)
