"""Segmentation: documents to lines, headings, sections and review units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from variorum.functions import text as T

# Heading shapes, the first that fits names the kind. (pattern, level, kind; level 0: the depth of the number)
CHINESE_NUMBER = "零〇一二三四五六七八九十百千万两0-9"
HEADINGS = (
    (r"(?i)^((?:part)\s+(?:[IVXLCDM]+|\d+))(?:(?:[\s:.–—-]+)(.{0,120}))?$", 1, "part"),
    (r"^([A-Z]\.\d+(?:\.\d+){0,4})(?:[、.)．\s]+)(.{0,120})$", 0, "annex_numeric"),
    (r"^(\d+\.[A-Z](?:\.\d+){0,4})(?:[、.)．\s]+)(.{0,120})$", 0, "numeric_letter"),
    (r"^((?i:annex|appendix)\s+(?:[A-Z]{1,2}|[IVXLCDM]{2,5}|\d+)(?:\.(?:[A-Z]|\d+))*)(?:(?:\s+|[:–—-]\s*|\.(?!\w)\s*)(.{0,120}))?$", 1, "annex"),
    (rf"(?i)^(附录\s*[A-Z{CHINESE_NUMBER}]+)(?:(?:[\s:：.–—-]+)(.{{0,120}}))?$", 1, "annex"),
    (r"(?i)^((?:chapter)\s+\d+(?:\.\d+)*)(?:[\s:.-]+)(.{0,120})$", 1, "named_numeric"),
    (r"(?i)^((?:section|clause)\s+\d+(?:\.\d+)*)(?:[\s:.-]+)(.{0,120})$", 0, "named_numeric"),
    (rf"^(第\s*[{CHINESE_NUMBER}]+\s*章)\s*(.{{0,100}})$", 1, "chapter"),
    (rf"^(第\s*[{CHINESE_NUMBER}]+\s*节)\s*(.{{0,100}})$", 2, "section"),
    (r"^(\d+(?:\.\d+){0,5})(?:[、.)．\s]+)(.{0,120})$", 0, "numeric"),
    (r"^([一二三四五六七八九十百千万]+[、.．])\s*(.{1,100})$", 2, "cn_list"),
    (r"^[(（]([一二三四五六七八九十百千万0-9\d]+)[)）]\s*(.{1,100})$", 3, "paren"),
)
#: What looks like a heading and isn't: years, values with units, sentences, table rows, addresses.
NOT_HEADINGS = (
    r"^(?:19|20)\d\d\b[^.]*\b(?:19|20)\d\d|^(?:19|20)\d\d[-/]"
    r"|^\d+(?:\.\d+)?\s*(?:%|[munpkMG]?(?:V|A|W|Hz|s|m|Ω|F|H|b/s|T/s)|dB|ps|ns|UI|ohm)\b"
    r"|[.;]\s+\S.*[.;]$|\|.*\||@|^\d+(?:\.\d+)?\s+\d+(?:\.\d+)?(?:\s|$)"
)
CONTENTS = r"(?i)^(?:table of contents|contents|list of (?:figures|tables)|目录|图目录|表目录)$"
TABLE_ROW = r"^(?:表格行|表格文字|Table row)[:：]"
#: The deepest number that a heading shape allows has six parts; a part or annex above it makes it one deeper.
MAX_LEVEL = 8


def pinned(rows: DataFrame, name: str, c: Column) -> DataFrame:
    """rows with a column that later projections refer to and don't repeat: a generator stands between, so an expression
    that many others use is worked out once a row and the plan doesn't multiply."""
    return rows.select(*[x for x in rows.columns if x != name], F.explode(F.array(c)).alias(name))


def lines(docs: DataFrame, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs' rows once for each non-empty line: kept columns, line_no (from 0, of all lines), raw, line (blanks collapsed)."""
    keep = keep or [c for c in docs.columns if c != text]
    out = docs.select(*keep, F.posexplode(F.split(F.col(text), r"\r\n|\n|\r")).alias("line_no", "raw"))
    return out.withColumn("line", T.collapsed(F.col("raw"))).filter("line <> ''")


def heading(line: Column) -> Column:
    """(kind, number, title, level) of a heading line; null where it is none."""
    found = F.lit(None)
    for pattern, level, kind in reversed(HEADINGS):
        number = T.heading_number(F.regexp_extract(line, pattern, 1))
        depth = F.lit(level) if level else F.size(F.split(number, r"\."))
        info = F.struct(F.lit(kind).alias("kind"), number.alias("number"), F.trim(F.coalesce(F.regexp_extract(line, pattern, 2), F.lit(""))).alias("title"), depth.cast("int").alias("level"))
        found = F.when(line.rlike(pattern), info).otherwise(found)
    title = F.regexp_replace(line, r"[\d\W_]+", "")
    return F.when(line.rlike(NOT_HEADINGS) | (F.length(line) > 140) | (F.length(title) == 0), F.lit(None)).otherwise(found)


def with_headings(rows: DataFrame, doc: list[str], order: list[str], *, line: str = "line") -> DataFrame:
    """rows with ``heading``; numbers under a part, annex or appendix are one level deeper; sentences in lower case are none.

    A marker line without title takes the next line for its title.
    """
    w = Window.partitionBy(*doc).orderBy(*order)
    rows = pinned(rows, "_h", heading(F.col(line)))
    rows = rows.withColumn("_next", F.lead(line).over(w))
    bare = F.coalesce(F.col("_h").isNotNull() & (F.col("_h.title") == "") & F.col("_next").rlike(r"^\p{Lu}") & (F.length("_next") <= 100), F.lit(False))
    rows = pinned(rows, "_bare", bare)
    title = F.when(F.col("_bare"), F.col("_next")).otherwise(F.col("_h.title"))
    sentence = (F.col("_h.kind") == "numeric") & title.rlike(r"^[a-z]")
    taken = F.coalesce(F.lag("_bare").over(w), F.lit(False))
    container = F.when(F.col("_h.kind").isin("part", "annex"), F.lit(1)).when(F.col("_h.kind") == "chapter", F.lit(0))
    under = F.last(container, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumns({"is_title": taken, "_under": F.coalesce(under, F.lit(0))})
    deeper = F.col("_h.kind").isin("numeric", "numeric_letter", "named_numeric") & (F.col("_under") == 1)
    told = F.struct(F.col("_h.kind").alias("kind"), F.col("_h.number").alias("number"), title.alias("title"), (F.col("_h.level") + F.when(deeper, 1).otherwise(0)).alias("level"))
    # a line that became a title is no heading of its own
    rows = pinned(rows, "heading", F.when(F.col("_h").isNull() | F.col("is_title") | F.coalesce(sentence, F.lit(False)), F.lit(None)).otherwise(told))
    return rows.drop("_h", "_bare", "_next", "_under")


def stack_path(doc: list[str], order: list[str], level: Column, label: Column, most: int = MAX_LEVEL) -> Column:
    """The labels of the open headings above a row, outermost first: for each level the last label there, unless a
    heading of a smaller level came after it. ``level`` and ``label`` are null on rows that aren't headings."""
    upto = Window.partitionBy(*doc).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    place = F.struct(*order)
    shown = []
    for k in range(1, most + 1):
        own = F.last(F.when(level == k, F.struct(place.alias("at"), label.alias("label"))), ignorenulls=True).over(upto)
        above = F.last(F.when(level < k, place), ignorenulls=True).over(upto)
        shown.append(F.when(above.isNull() | (own["at"] > above), own["label"]))
    return F.array_compact(F.array(*shown))


def sections(rows: DataFrame, doc: list[str], *, page: str = "page_no", order: list[str] | None = None) -> DataFrame:
    """Sections of documents from their lines: doc, ord, section_id, heading, number, title, level, heading_path,
    number_path, start_page, end_page, body, role, identity_key.

    Text before the first heading is a section of level 0. Sections with neither body nor number are dropped. A document
    without any heading has one section for each page, known by the digest of its body.
    """
    order = order or [page, "line_no"]
    w = Window.partitionBy(*doc).orderBy(*order)
    rows = with_headings(rows, doc, order)
    number, title = F.col("heading.number"), F.col("heading.title")
    rows = rows.withColumn("ord", F.sum(F.when(F.col("heading").isNotNull(), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    level = F.col("heading.level")
    rows = rows.withColumn("heading_path", stack_path(doc, order, level, F.trim(F.concat_ws(" ", number, title)))).withColumn("number_path", stack_path(doc, order, level, number))
    body = F.when(F.col("heading").isNull() & ~F.coalesce("is_title", F.lit(False)), F.struct(*order, "line"))
    head = F.col("heading").isNotNull()
    found = rows.groupBy(*doc, "ord").agg(
        F.first(F.when(head, F.col("heading")), ignorenulls=True).alias("h"),
        F.first(F.when(head, F.col("line")), ignorenulls=True).alias("heading"),
        F.first(F.when(head, F.col("heading_path")), ignorenulls=True).alias("heading_path"),
        F.first(F.when(head, F.col("number_path")), ignorenulls=True).alias("number_path"),
        F.min(page).alias("start_page"),
        F.max(page).alias("end_page"),
        F.array_join(F.transform(F.array_sort(F.collect_list(body)), lambda x: x["line"]), "\n").alias("body"),
    )
    found = found.filter((F.col("body") != "") | F.col("h").isNotNull())
    some = Window.partitionBy(*doc)
    found = found.withColumn("_headed", F.max(F.col("h").isNotNull()).over(some))
    by_heading = found.filter("_headed").select(
        *doc, "ord", F.format_string("S%04d", (F.row_number().over(Window.partitionBy(*doc).orderBy("ord"))).cast("int")).alias("section_id"),
        F.coalesce("heading", F.lit("(start)")).alias("heading"), F.coalesce("h.number", F.lit("")).alias("number"), F.coalesce("h.title", F.lit("")).alias("title"),
        F.coalesce("h.level", F.lit(0)).alias("level"), F.coalesce("heading_path", F.array().cast("array<string>")).alias("heading_path"),
        F.coalesce("number_path", F.array().cast("array<string>")).alias("number_path"), "start_page", "end_page", "body",
    )
    none = rows.join(found.filter("_headed").select(*doc).distinct(), doc, "left_anti")
    pages = none.groupBy(*doc, page).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "line"))), lambda x: x["line"]), "\n").alias("body"))
    by_page = pages.select(
        *doc, F.col(page).cast("long").alias("ord"), F.format_string("P%04d", F.col(page).cast("int")).alias("section_id"), F.format_string("Page %d", F.col(page).cast("int")).alias("heading"),
        F.lit("").alias("number"), F.lit("").alias("title"), F.lit(1).alias("level"), F.array(F.sha1(F.col("body").cast("binary"))).alias("heading_path"),
        F.array().cast("array<string>").alias("number_path"), F.col(page).alias("start_page"), F.col(page).alias("end_page"), "body",
    )
    out = by_heading.unionByName(by_page)
    role = F.when(T.metadata_title(F.col("title")) | F.col("title").rlike(CONTENTS), "document_metadata").otherwise("technical")
    identity = F.when(F.size("number_path") > 0, F.concat_ws("/", "number_path")).otherwise(F.lower(F.concat_ws("/", "heading_path")))
    return out.withColumn("role", role).withColumn("identity_key", identity)


def merged_lines(rows: DataFrame, group: list[str], order: list[str], *, line: str = "line") -> DataFrame:
    """Blocks of wrapped lines: group, block (from 1), text, first_line.

    A block ends where the next line is a list item, a note or a table row, where the text so far ends a sentence, or
    where a short first line is followed by a capital.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    item = F.col(line).rlike(r"^(?:\d{1,3}[.)]|[A-Za-z][.)]|[•●▪■◦–-])\s|(?i)^note\s*\d*\s*[:：]|" + TABLE_ROW)
    before = F.lag(line).over(w)
    ended = before.rlike(r"[.。;；!！?？]$") & ~before.rlike(r"^(?:\d{1,3}|[A-Za-z])[.)]$")
    short = (F.length(before) <= 60) & F.col(line).rlike(r"^[A-Z]")
    marked = rows.withColumn("_new", F.when(before.isNull() | item | ended | short, 1).otherwise(0)).withColumn("block", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, line))), lambda x: x[line]), " ")
    return marked.groupBy(*group, "block").agg(joined.alias("text"), F.min(F.struct(*order)).alias("first_line"))


def sentences(c: Column) -> Column:
    """An array of sentences: cut after 。！？；;!? and after a full stop before a blank, but not after a bare marker or
    between digits. Signs that end sentences stay with them."""
    marked = F.regexp_replace(c, r"([。！？；;!?])\s*", "$1\u0001")
    marked = F.regexp_replace(marked, r"(?<!(?:^|\s)(?:\d{1,3}|[A-Za-z]))(?<!\u0001)\.\s+", ".\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001"), lambda x: F.trim(x)), lambda x: x != "")


def units(rows: DataFrame, group: list[str], order: list[str], *, text: str = "text", most: int = 720, exact_keys: bool = True) -> DataFrame:
    """Review units: group, unit_no, text, key, occ. Long sentences are cut at a readable place. With exact_keys the key
    is the typed unit key (Python on Arrow batches), else the collapsed text in lower case (built in)."""
    out = rows.select(*group, F.struct(*order).alias("_at"), F.posexplode(sentences(F.col(text))).alias("_s", "_text"))
    cut = F.when(F.length("_text") <= most, F.array("_text")).otherwise(T.split_long_udf(F.col("_text"))) if exact_keys else F.array("_text")
    out = out.select(*group, "_at", "_s", F.posexplode(cut).alias("_p", "text"))
    out = out.withColumn("unit_no", F.row_number().over(Window.partitionBy(*group).orderBy("_at", "_s", "_p"))).drop("_at", "_s", "_p")
    key = T.unit_key_udf(F.col("text")) if exact_keys else F.lower(T.collapsed(F.col("text")))
    out = out.withColumn("key", key)
    return out.withColumn("occ", F.row_number().over(Window.partitionBy(*group, "key").orderBy("unit_no")))


def review_units(all_units: DataFrame, covered: DataFrame, group: list[str]) -> DataFrame:
    """Units less those whose key a table row or displayed equation covers."""
    return all_units.join(covered.select(*group, "key").distinct(), [*group, "key"], "left_anti")


def coherent_groups(rows: DataFrame, group: list[str], order: str, *, most: int = 12, characters: int = 6000) -> DataFrame:
    """Consecutive units in groups of at most ``most`` units and ``characters``: rows with ``run`` and ``part``."""
    w = Window.partitionBy(*group).orderBy(order)
    rows = rows.withColumn("run", F.col(order) - F.row_number().over(w))
    inside = Window.partitionBy(*group, "run").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    place, size = F.row_number().over(Window.partitionBy(*group, "run").orderBy(order)), F.sum(F.length("text")).over(inside)
    return rows.withColumn("part", F.greatest(F.floor((place - 1) / most), F.floor((size - 1) / characters)).cast("int"))


def spans(rows: DataFrame, group: list[str], order: str, *, key: str = "key", most: int = 8, least: int = 40, same: list[str] | None = None) -> DataFrame:
    """Runs of 1 to ``most`` neighbouring units as (group, first, last, n, text); longer ones have ``least`` characters or more.

    Units with risks or empty keys belong to none, and a span doesn't go on where a column of ``same`` changes.
    """
    same = same or []
    w = Window.partitionBy(*group).orderBy(order)
    frame = w.rowsBetween(0, most - 1)
    held = rows.withColumn("_list", F.collect_list(F.struct(order, key, F.struct(*same, F.lit(0)).alias("same"), F.coalesce("risky", F.lit(False)).alias("risky")) if "risky" in rows.columns else F.struct(order, key, F.struct(*same, F.lit(0)).alias("same"), F.lit(False).alias("risky"))).over(frame))
    out = held.select(*group, *same, F.col(order).alias("first"), "_list", F.explode(F.sequence(F.lit(1), F.size("_list"))).alias("n"))
    part = F.slice("_list", 1, F.col("n"))
    whole = F.forall(part, lambda x: (x[key] != "") & ~x["risky"] & (x["same"] == F.col("_list")[0]["same"]))
    out = out.filter(whole).withColumn("text", F.array_join(F.transform(part, lambda x: x[key]), " ")).withColumn("last", F.element_at(part, -1)[order])
    return out.filter((F.col("n") == 1) | (F.length("text") >= least)).drop("_list")


def catalog_entries(rows: DataFrame, group: list[str], *, line: str = "line") -> DataFrame:
    """Counts of (identifier, title) of figure and table lists: entries end in leader dots and a page."""
    pattern = r"(?i)^((?:figure|fig\.|table|图|表)\s+[A-Z0-9]+(?:[.\-–][A-Z0-9]+)*)[.:：]?\s+(.+?)(?:\.{3,}|…{2,}|(?:\.\s*){3,})\s*(?:\d+|[ivxlcdm]+)$"
    told = rows.filter(F.col(line).rlike(pattern))
    return told.groupBy(*group, F.lower(F.regexp_extract(line, pattern, 1)).alias("identifier"), F.trim(F.regexp_extract(line, pattern, 2)).alias("title")).agg(F.count(F.lit(1)).alias("n"))


def edge_lines(rows: DataFrame, page: list[str], order: str, *, margin: int = 4) -> DataFrame:
    """rows with ``top`` and ``bottom``: whether a line is among the first or last ``margin`` of its page."""
    up, down = Window.partitionBy(*page).orderBy(order), Window.partitionBy(*page).orderBy(F.desc(order))
    return rows.withColumn("top", F.row_number().over(up) <= margin).withColumn("bottom", F.row_number().over(down) <= margin)


def without_page_counters(rows: DataFrame, doc: list[str], *, page: str = "page_no", order: str = "line_no", proven: DataFrame | None = None) -> DataFrame:
    """rows less page counters in a margin of at least 55 of a hundred pages, two at the least.

    Other repeated lines stay. A bare "page N" goes only with those of ``proven`` (doc, page, line). Documents of one page
    are left alone.
    """
    marked = edge_lines(rows, [*doc, page], order)
    counter = T.is_page_counter(F.col("line"))
    bare = F.lower(T.collapsed(F.col("line"))).rlike(r"^page \d+$")
    pages = rows.groupBy(*doc).agg(F.count_distinct(page).alias("_pages")).filter("_pages > 1")
    found = marked.filter(counter).select(*doc, page, T.furniture_fingerprint(F.col("line")).alias("fingerprint"), F.explode(F.array_compact(F.array(F.when(F.col("top"), "top"), F.when(F.col("bottom"), "bottom")))).alias("zone"))
    often = found.groupBy(*doc, "fingerprint", "zone").agg(F.count_distinct(page).alias("_n")).join(pages, doc).filter(F.col("_n") >= F.greatest(F.lit(2), F.ceil(0.55 * F.col("_pages"))))
    zones = often.groupBy(*doc, "fingerprint").agg(F.collect_set("zone").alias("_zones"))
    out = marked.withColumn("fingerprint", F.when(counter, T.furniture_fingerprint(F.col("line")))).join(zones, [*doc, "fingerprint"], "left")
    gone = (F.col("top") & F.array_contains("_zones", "top")) | (F.col("bottom") & F.array_contains("_zones", "bottom"))
    if proven is not None:
        out = out.join(proven.select(*doc, page, "line").withColumn("_proven", F.lit(True)), [*doc, page, "line"], "left")
        gone = gone & (~bare | F.coalesce("_proven", F.lit(False)))
    else:
        gone = gone & ~bare
    return out.filter(~F.coalesce(gone, F.lit(False))).select(*rows.columns)


def running_lines(rows: DataFrame, doc: list[str], *, page: str = "page_no", order: str = "line_no", margin: int = 2, least: int = 3) -> DataFrame:
    """Running headers and footers, compared once: (doc, line, first_page, last_page, pages) of margin lines on ``least`` pages."""
    marked = edge_lines(rows, [*doc, page], order, margin=margin).filter("top or bottom")
    found = marked.groupBy(*doc, "line").agg(F.min(page).alias("first_page"), F.max(page).alias("last_page"), F.count_distinct(page).alias("pages"))
    return found.filter(F.col("pages") >= least)


def blocks_from_words(words: DataFrame, page: list[str], *, tolerance: float = 2.0) -> DataFrame:
    """Text blocks from words with coordinates: a new block where the top moves by more than ``tolerance``; reading order
    is top, then left; page, block_no (from 0), text, x0, top, x1, bottom."""
    w = Window.partitionBy(*page).orderBy("top", "x0", "text")
    rows = words.withColumn("_new", F.when(F.abs(F.col("top") - F.lag("top").over(w)) <= tolerance, 0).otherwise(1)).withColumn("_line", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = rows.groupBy(*page, "_line").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda x: x["text"]), " ").alias("text"),
        F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom"),
    )
    return out.withColumn("block_no", F.row_number().over(Window.partitionBy(*page).orderBy("top", "x0", "_line")) - 1).drop("_line")
