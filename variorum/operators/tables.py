"""Tables: rows and headers, pairing of tables, differences of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from variorum.functions import similarity as S
from variorum.functions import text as T
from variorum.operators import captions
from variorum.operators.bags import dice_similarity
from variorum.operators.ordered import continuation_runs, crossing, mutual_best, offset_support, unique_only
from variorum.session import stored

IDENTITY_LABELS = ("parameter", "characteristic", "symbol", "item", "name", "description", "field")
SIMILAR = 0.65
#: Words that make a table's order count.
ORDERED = r"(?i)\b(?:policy|priority|sequence|rule|order|step|rank|procedure)\b"
LIMITS = r"(?i)^(?:setting|limit|min|max|typ|typical|nominal|unit|units|value|minimum|maximum)\b"


def html_tables(pages: DataFrame, *, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """Cells of HTML tables: page_id, table_no, caption, row_no, header (boolean), cells. Built-in regular expressions only."""
    plain = lambda c: T.collapsed(F.replace(F.replace(F.replace(F.regexp_replace(c, r"<[^>]*>", " "), F.lit("&nbsp;"), F.lit(" ")), F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&")))
    tables = pages.select(page_id, F.posexplode(F.regexp_extract_all(html, F.lit(r"(?is)(<table\b.*?</table>)"), F.lit(1))).alias("table_no", "_t"))
    tables = tables.withColumn("caption", plain(F.regexp_extract("_t", r"(?is)<caption[^>]*>(.*?)</caption>", 1)))
    rows = tables.select(page_id, "table_no", "caption", F.posexplode(F.regexp_extract_all("_t", F.lit(r"(?is)(<tr\b.*?</tr>)"), F.lit(1))).alias("row_no", "_r"))
    cells = F.transform(F.regexp_extract_all("_r", F.lit(r"(?is)<t[hd]\b[^>]*>(.*?)</t[hd]>"), F.lit(1)), plain)
    return rows.select(page_id, "table_no", "caption", "row_no", F.col("_r").rlike(r"(?i)<th\b").alias("header"), cells.alias("cells"))


def text_tables(lines: DataFrame, doc: list[str], order: list[str], *, line: str = "line") -> DataFrame:
    """Rows of pipe-separated text: runs of lines with a bar are tables: doc, table_no, row_no, cells."""
    w = Window.partitionBy(*doc).orderBy(*order)
    told = lines.withColumn("_bar", F.col(line).rlike(r"\S\s+\|\s+\S"))
    told = told.withColumn("_start", F.when(F.col("_bar") & ~F.coalesce(F.lag("_bar").over(w), F.lit(False)), 1).otherwise(0)).withColumn("table_no", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = told.filter("_bar").withColumn("row_no", F.row_number().over(Window.partitionBy(*doc, "table_no").orderBy(*order)) - 1)
    return rows.select(*doc, "table_no", "row_no", F.transform(F.split(line, r"\s+\|\s+"), lambda x: F.trim(x)).alias("cells"))


def captioned_tables(lines: DataFrame, doc: list[str], *, line: str = "line") -> tuple[DataFrame, DataFrame]:
    """(tables, rows) of pipe-separated text in lines (doc, page_no, line_no): doc, table_id, ord, page_no, caption, schema; and
    doc, table_id, row_no, cells.

    The caption is the line right above, or the last line of the page before, where that reads like one. A table that goes on
    with caption and schema on the same or next page is one with the last, and its repeated header is no row.
    """
    order = ["page_no", "line_no"]
    w = Window.partitionBy(*doc).orderBy(*order)
    bar, named = F.col(line).rlike(r"\S\s+\|\s+\S"), F.col(line).rlike(r"(?i)^(?:table|表)\s*[A-Z]?\d")
    told = lines.withColumns({"_bar": bar, "_named": F.when(named, F.col(line))})
    # a run of rows may go over a page's end; a caption between two parts it
    told = told.withColumn("_above", F.lag("_named").over(w))
    told = told.withColumn("_start", F.when(bar & (~F.coalesce(F.lag("_bar").over(w), F.lit(False)) | (F.coalesce(F.lag("page_no").over(w), F.lit(-1)) != F.col("page_no"))), 1).otherwise(0))
    told = told.withColumn("ord", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("_bar")
    cells = F.transform(F.split(line, r"\s+\|\s+"), lambda x: F.trim(x))
    parts = told.groupBy(*doc, "ord").agg(F.min("page_no").alias("page_no"), F.min_by(F.col("_above"), F.struct(*order)).alias("caption"), F.min_by(F.array_join(cells, "|"), F.struct(*order)).alias("schema"), F.min(F.struct(*order)).alias("_head"))
    before = Window.partitionBy(*doc).orderBy("ord")
    again = F.coalesce((F.lag("schema").over(before) == F.col("schema")) & (F.col("page_no") - F.lag("page_no").over(before)).between(0, 1), F.lit(False))
    parts = parts.withColumn("caption", F.when(F.col("caption").isNull() & again, F.lag("caption").over(before)).otherwise(F.coalesce("caption", F.lit(""))))
    parts = continuations(parts.withColumn("caption", F.coalesce("caption", F.lit(""))), doc)
    first = Window.partitionBy(*doc, "run").orderBy("ord")
    parts = parts.withColumn("table_id", F.concat(F.lit("t"), F.col("run"))).withColumn("_part", F.row_number().over(first))
    rows = told.select(*doc, "ord", *order, cells.alias("cells")).join(parts.select(*doc, "ord", "table_id", "_part", "_head"), [*doc, "ord"])
    rows = rows.filter((F.col("_part") == 1) | (F.struct(*order) != F.col("_head")))
    rows = rows.withColumn("row_no", F.row_number().over(Window.partitionBy(*doc, "table_id").orderBy(*order)) - 1)
    return parts.filter("_part = 1").select(*doc, "table_id", "ord", "page_no", "caption", "schema"), rows.select(*doc, "table_id", "row_no", "cells")


def keyed_rows(rows: DataFrame, table: list[str]) -> DataFrame:
    """Data rows as pairing and differences ask for them: table, row_no, fields, identity, display, values."""
    told = labelled_rows(expanded_rows(rows).drop("part"), table)
    return told.select(*table, "row_no", "fields", row_identity(F.col("fields")).alias("identity"), row_display(F.col("fields")).alias("display"), F.transform("fields", lambda x: x["value"]).alias("values"))


def compare_tables(old: tuple[DataFrame, DataFrame], new: tuple[DataFrame, DataFrame], doc: list[str], *, least: float = SIMILAR) -> tuple[DataFrame, DataFrame]:
    """(changes, rows) of the tables of both sides: each table once with change_type; each row of paired tables with its kind.

    Where order counts and rows that both have come in another order, an unchanged pair is for review.
    """
    (a, ra), (b, rb) = old, new
    ka, kb = stored(keyed_rows(ra, [*doc, "table_id"]), "old-rows"), stored(keyed_rows(rb, [*doc, "table_id"]), "new-rows")
    pairs = stored(pair_tables(a, b, ka, kb, doc, least=least), "table-pairs")
    both = pairs.filter("old_table is not null and new_table is not null").select(*doc, "old_table", "new_table")
    table = [*doc, "old_table", "new_table"]
    side = lambda rows, name: rows.withColumnRenamed("table_id", name).join(both, [*doc, name])
    pa, pb = side(ka, "old_table"), side(kb, "new_table")
    rows = stored(row_differences(pa, pb, table), "row-differences")
    moved = row_order_changed(pa, pb, table).join(order_matters(pa, table).filter("ordered"), table, "left_semi").withColumn("_moved", F.lit(True))
    changes = table_changes(pairs, rows, doc).join(moved, table, "left")
    kind = F.when(F.col("_moved") & (F.col("change_type") == "unchanged"), "review").otherwise(F.col("change_type"))
    changes = changes.withColumn("change_type", kind).withColumn("order_changed", F.coalesce("_moved", F.lit(False))).drop("_moved")
    changes = parted(changes, a, b, doc)
    named = [t.select(*doc, F.col("table_id").alias(f"{s}_table"), F.col("caption").alias(f"{s}_caption"), F.col("page_no").alias(f"{s}_page")) for s, t in (("old", a), ("new", b))]
    return changes.join(named[0], [*doc, "old_table"], "left").join(named[1], [*doc, "new_table"], "left"), rows


def parted(changes: DataFrame, old: DataFrame, new: DataFrame, doc: list[str]) -> DataFrame:
    """changes where one-sided tables whose captions share a core with some of the other side, as parts of one table may, are
    for review and neither added nor deleted."""
    alone = lambda rows, name, other: rows.join(changes.filter(F.col(other).isNull()).select(*doc, F.col(name).alias("table_id")), [*doc, "table_id"], "left_semi")
    groups = stored(captions.core_groups(alone(old, "old_table", "new_table"), alone(new, "new_table", "old_table"), doc), "caption-cores")
    for name in ("old_table", "new_table"):
        changes = changes.join(groups.select(*doc, F.explode(f"{name}s").alias(name), F.lit(True).alias(f"_{name}")), [*doc, name], "left")
    part = F.coalesce("_old_table", "_new_table", F.lit(False))
    return changes.withColumns({"change_type": F.when(part, "review").otherwise(F.col("change_type")), "basis": F.when(part, "caption_core").otherwise(F.col("basis"))}).drop("_old_table", "_new_table")


def ordered_table_changes(changes: DataFrame) -> DataFrame:
    """By page on the new side, or the old one, then table."""
    return changes.orderBy(F.coalesce("new_page", "old_page"), F.coalesce("new_table", "old_table"))


def labelled_rows(rows: DataFrame, table: list[str]) -> DataFrame:
    """Data rows as arrays of (label, value). The header is the first row that says so, or whose cells are words while the
    rows below hold numbers; without one, columns are neutral."""
    w = Window.partitionBy(*table)
    wordy = F.forall("cells", lambda x: x.rlike(r"\p{L}") & ~x.rlike(r"^[+-]?\d"))
    numbers = F.exists("cells", lambda x: x.rlike(r"^[+-]?\d"))
    told = rows.withColumn("_head", (F.col("row_no") == F.min("row_no").over(w)) & ((F.col("header") if "header" in rows.columns else F.lit(False)) | (wordy & (F.max(F.when(numbers, 1).otherwise(0)).over(w) == 1))))
    told = told.withColumn("_labels", F.first(F.when(F.col("_head"), F.col("cells")), ignorenulls=True).over(w))
    label = lambda i: F.coalesce(F.when(F.length(F.coalesce(F.try_element_at(F.col("_labels"), i + 1), F.lit(""))) > 0, F.try_element_at(F.col("_labels"), i + 1)), F.concat(F.lit("Column "), (i + 1).cast("string")))
    pairs = F.transform("cells", lambda x, i: F.struct(label(i).alias("label"), x.alias("value")))
    return told.filter(~F.col("_head")).withColumn("fields", pairs).drop("_head", "_labels")


def expanded_rows(rows: DataFrame) -> DataFrame:
    """Physical rows whose cells hold several lines as logical rows: where two or more cells have the same number n of lines
    and every cell has n or one; else the row stays one."""
    counts = F.transform("cells", lambda x: F.size(F.split(x, "\n")))
    many = F.filter(counts, lambda n: n > 1)
    n = F.when((F.size(F.array_distinct(many)) == 1) & (F.size(many) >= 2), F.element_at(F.array_distinct(many), 1)).otherwise(1)
    out = rows.withColumn("_n", n).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    cell = lambda x: F.when(F.size(F.split(x, "\n")) > 1, F.get(F.split(x, "\n"), F.col("part"))).otherwise(x)
    return out.withColumn("cells", F.when(F.col("_n") > 1, F.transform("cells", cell)).otherwise(F.col("cells"))).drop("_n")


def row_identity(fields: Column) -> Column:
    """What names a row, without its values: the field with a naming label, else the first that isn't a number or a unit."""
    named = F.filter(fields, lambda x: F.lower(x["label"]).isin(*IDENTITY_LABELS))
    wordy = F.filter(fields, lambda x: x["value"].rlike(r"[A-Za-z\x{4E00}-\x{9FFF}]") & ~F.lower(x["value"]).rlike(r"^(?:ohm|ω|ff|pf|ph|mhz|ghz|ui|mv|v|db|ns/mm|1/mm|units?)$") & (F.length(x["value"]) > 1))
    return F.lower(T.collapsed(F.coalesce(F.try_element_at(named, F.lit(1))["value"], F.try_element_at(wordy, F.lit(1))["value"], F.lit(""))))


def row_display(fields: Column) -> Column:
    return T.collapsed(F.array_join(F.transform(fields, lambda x: F.concat(x["label"], F.lit("="), x["value"])), " | "))


def continuations(tables: DataFrame, doc: list[str], *, order: str = "ord") -> DataFrame:
    """tables with ``run``: one that goes on with caption and schema on the same or next page continues the last."""
    w = Window.partitionBy(*doc).orderBy(order)
    caption = T.caption_descriptor(F.col("caption"))
    told = tables.withColumn("_c", caption)
    same = (F.lag("_c").over(w) == F.col("_c")) & (F.lag("schema").over(w) == F.col("schema")) & (F.col("page_no") - F.lag("page_no").over(w)).between(0, 1)
    return continuation_runs(told, doc, [order], same).drop("_c")


def pair_tables(old: DataFrame, new: DataFrame, old_rows: DataFrame, new_rows: DataFrame, doc: list[str], *, least: float = SIMILAR) -> DataFrame:
    """Every table of either side once: doc, old_table, new_table, score, basis.

    Stages on what is left: captions that come once; descriptors that come once, where two or more in a family prove one
    shift of the numbers; repeated captions in the longest common order of their contents and descriptors of a family that
    became another (where tables have a place ``ord`` and rows a ``row_no``); similar captions and rows, each the other's only best and not crossing another; conflicts are for
    review; the rest is one-sided. Row bags meet through equal row identities, so no pair without a shared row is made.
    """
    caption = lambda rows, name: rows.select(*doc, F.col("table_id").alias(name), F.lower(T.collapsed(F.col("caption"))).alias("caption"), T.caption_descriptor(F.col("caption")).alias("descriptor"), T.caption_family(F.col("caption")).alias("family"), F.regexp_extract(T.caption_number(F.col("caption")), r"(\d+)$", 1).try_cast("int").alias("number"))
    # each stage is stored: the next ones ask for what it left more than once
    a, b = stored(caption(old, "old_table"), "captions"), stored(caption(new, "new_table"), "captions")
    same = unique_only(a.filter("caption <> ''"), [*doc, "caption"]).select(*doc, "caption", "old_table").join(unique_only(b.filter("caption <> ''"), [*doc, "caption"]).select(*doc, "caption", "new_table"), [*doc, "caption"])
    done = stored(same.select(*doc, "old_table", "new_table", F.lit(1.0).alias("score"), F.lit("same_caption").alias("basis")), "same-caption")
    left_a, left_b = a.join(done, [*doc, "old_table"], "left_anti"), b.join(done, [*doc, "new_table"], "left_anti")
    named = unique_only(left_a.filter("descriptor <> ''"), [*doc, "descriptor"]).select(*doc, "descriptor", "old_table", "family", F.col("number").alias("o"))
    told = named.join(unique_only(left_b.filter("descriptor <> ''"), [*doc, "descriptor"]).select(*doc, "descriptor", "new_table", F.col("family").alias("new_family"), F.col("number").alias("n")), [*doc, "descriptor"]).filter("family = new_family and o is not null and n is not null")
    told = stored(told, "descriptors")
    shifts = offset_support(told, [*doc, "family"], "o", "n")
    renumbered = told.withColumn("offset", F.col("n") - F.col("o")).join(shifts.select(*doc, "family", "offset"), [*doc, "family", "offset"], "left_semi")
    done = stored(done.unionByName(renumbered.select(*doc, "old_table", "new_table", F.lit(1.0).alias("score"), F.lit("descriptive_renumbering").alias("basis"))), "renumbered")
    done = later_captions(old, new, old_rows, new_rows, a, b, done, doc)
    left_a, left_b = a.join(done, [*doc, "old_table"], "left_anti"), b.join(done, [*doc, "new_table"], "left_anti")
    keys = lambda rows, name: rows.select(*doc, F.col("table_id").alias(name), "display", "identity")
    ra, rb = keys(old_rows, "old_table").join(left_a.select(*doc, "old_table"), [*doc, "old_table"], "left_semi"), keys(new_rows, "new_table").join(left_b.select(*doc, "new_table"), [*doc, "new_table"], "left_semi")
    met = ra.filter("identity <> ''").select(*doc, "old_table", "identity").distinct().join(rb.filter("identity <> ''").select(*doc, "new_table", "identity").distinct(), [*doc, "identity"]).select(*doc, "old_table", "new_table").distinct()
    bags = dice_similarity(ra.join(met, [*doc, "old_table"]).select(*doc, "old_table", "new_table", "display"), rb.join(met, [*doc, "new_table"]).select(*doc, "old_table", "new_table", "display"), [*doc, "old_table", "new_table"], ["display"])
    scored = bags.join(left_a.select(*doc, "old_table", F.col("caption").alias("_a")), [*doc, "old_table"]).join(left_b.select(*doc, "new_table", F.col("caption").alias("_b")), [*doc, "new_table"])
    scored = scored.filter(F.col("dice") >= least).withColumn("score", F.least("dice", S.exact_ratio_udf("_a", "_b"))).filter(F.col("score") >= least).select(*doc, "old_table", "new_table", "score")
    fuzzy = crossing(mutual_best(stored(scored, "similar"), doc, "old_table", "new_table", "score"), doc, "old_table", "new_table")
    done = stored(done.unionByName(fuzzy.select(*doc, "old_table", "new_table", "score", F.when(F.col("crosses"), "ambiguous_order_conflict").otherwise("similar").alias("basis"))), "paired")
    none = F.lit(None)
    only_a = a.join(done, [*doc, "old_table"], "left_anti").select(*doc, "old_table", none.cast(b.schema["new_table"].dataType).alias("new_table"), none.cast("double").alias("score"), F.lit("only_old").alias("basis"))
    only_b = b.join(done, [*doc, "new_table"], "left_anti").select(*doc, none.cast(a.schema["old_table"].dataType).alias("old_table"), "new_table", none.cast("double").alias("score"), F.lit("only_new").alias("basis"))
    return done.unionByName(only_a).unionByName(only_b)


def later_captions(old: DataFrame, new: DataFrame, old_rows: DataFrame, new_rows: DataFrame, a: DataFrame, b: DataFrame, done: DataFrame, doc: list[str]) -> DataFrame:
    """done with tables of repeated captions and of families that moved; a, b: what ``pair_tables`` knows of captions."""
    if "ord" not in old.columns or "ord" not in new.columns:
        return done

    def left(rows: DataFrame, known: DataFrame, name: str, held: DataFrame) -> DataFrame:
        return known.join(rows.select(*doc, F.col("table_id").alias(name), "ord"), [*doc, name]).join(held, [*doc, name], "left_anti")

    if "row_no" in old_rows.columns and "row_no" in new_rows.columns:

        def content(rows: DataFrame, known: DataFrame, all_rows: DataFrame, name: str) -> DataFrame:
            whole = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "display"))), lambda x: x["display"]), "\n"), 256)
            keys = all_rows.groupBy(*doc, F.col("table_id").alias(name)).agg(whole.alias("content"))
            return left(rows, known, name, done).filter("caption <> ''").join(keys, [*doc, name]).select(*doc, "caption", "ord", F.col(name).alias("table_id"), "content")

        runs = captions.aligned_runs(content(old, a, old_rows, "old_table"), content(new, b, new_rows, "new_table"), doc)
        done = stored(done.unionByName(runs.select(*doc, "old_table", "new_table", F.lit(1.0).alias("score"), F.lit("repeated_caption").alias("basis"))), "repeated")
    left_a, left_b = left(old, a, "old_table", done).filter("family <> ''"), left(new, b, "new_table", done).filter("family <> ''")
    families = captions.family_map(left_a, left_b, doc)
    named = unique_only(left_a.filter("descriptor <> ''"), [*doc, "descriptor"]).select(*doc, "descriptor", "old_table", F.col("family").alias("old_family"))
    met = named.join(unique_only(left_b, [*doc, "descriptor"]).select(*doc, "descriptor", "new_table", F.col("family").alias("new_family")), [*doc, "descriptor"])
    moved = met.join(families.select(*doc, "old_family", "new_family"), [*doc, "old_family", "new_family"], "left_semi")
    return stored(done.unionByName(moved.select(*doc, "old_table", "new_table", F.lit(1.0).alias("score"), F.lit("cross_clause").alias("basis"))), "families")


def row_kind(old_display: Column, new_display: Column, old_values: Column, new_values: Column) -> Column:
    """The first that fits: unchanged, review (cosmetic only), row_deleted, row_added, symbol_changed, value_changed, replaced.

    Values are arrays of strings.
    """
    flat = lambda c: F.array_join(c, " ")
    spaceless = lambda c: F.regexp_replace(flat(c), r"\s+", "")
    numberless = lambda c: F.regexp_replace(flat(c), T.NUMBER, "#")
    signless = lambda c: F.regexp_replace(flat(c), r"[^\w\s]", "")
    return (
        F.when(old_display == new_display, "unchanged")
        .when(old_values == new_values, "unchanged")
        .when(old_display.isNotNull() & new_display.isNotNull() & ((spaceless(old_values) == spaceless(new_values)) | (T.cosmetic_key(flat(old_values)) == T.cosmetic_key(flat(new_values)))), "review")
        .when(new_display.isNull(), "row_deleted")
        .when(old_display.isNull(), "row_added")
        .when((signless(old_values) == signless(new_values)), "symbol_changed")
        .when(numberless(old_values) == numberless(new_values), "value_changed")
        .otherwise("replaced")
    )


def row_differences(old: DataFrame, new: DataFrame, table: list[str]) -> DataFrame:
    """Rows of paired tables: table, identity, n, old_display, new_display, kind.

    Equal rows cancel one for one, wherever they are; the others meet by their place among the rows of one identity; what is
    left is one-sided. Columns: identity, display, values (array), row_no.
    """

    def counted(rows: DataFrame, keys: list[str]) -> DataFrame:
        return rows.withColumn("n", F.row_number().over(Window.partitionBy(*table, *keys).orderBy("row_no")))

    key = [*table, "identity", "display", "n"]
    a, b = counted(old, ["identity", "display"]), counted(new, ["identity", "display"])
    equal = a.select(*key).join(b.select(*key), key, "left_semi")
    rest_a = counted(a.join(equal, key, "left_anti"), ["identity"]).select(*table, "identity", "n", F.col("display").alias("old_display"), F.col("values").alias("old_values"))
    rest_b = counted(b.join(equal, key, "left_anti"), ["identity"]).select(*table, "identity", "n", F.col("display").alias("new_display"), F.col("values").alias("new_values"))
    changed = rest_a.join(rest_b, [*table, "identity", "n"], "full")
    kinds = changed.withColumn("kind", row_kind(F.col("old_display"), F.col("new_display"), F.col("old_values"), F.col("new_values")))
    same = equal.select(*table, "identity", "n", F.col("display").alias("old_display"), F.col("display").alias("new_display"), F.lit("unchanged").alias("kind"))
    return same.unionByName(kinds.select(*table, "identity", "n", "old_display", "new_display", "kind"))


def order_matters(rows: DataFrame, table: list[str]) -> DataFrame:
    """For each table whether its rows' order counts: wording of order anywhere, a row without identity, no column of limits."""
    limit = F.exists("fields", lambda x: x["label"].rlike(LIMITS))
    return rows.groupBy(*table).agg((F.bool_or(F.col("display").rlike(ORDERED)) | F.bool_or(F.col("identity") == "") | ~F.bool_and(limit)).alias("ordered"))


def row_order_changed(old: DataFrame, new: DataFrame, table: list[str]) -> DataFrame:
    """Tables whose rows that are unique and on both sides come in another order."""
    from variorum.operators.ordered import increasing

    a = unique_only(old, [*table, "display"]).select(*table, "display", F.col("row_no").alias("_o"))
    b = unique_only(new, [*table, "display"]).select(*table, "display", F.col("row_no").alias("_n"))
    return increasing(a.join(b, [*table, "display"]), table, "_o", "_n").filter("not increasing").select(*table)


def nested_removed(tables: DataFrame, doc: list[str]) -> DataFrame:
    """tables less those with the caption of another on the page whose box holds theirs and whose rows hold theirs in order."""
    inner = tables.alias("i").join(tables.alias("o"), [*doc, "page_no", "caption"]).filter(
        (F.col("i.table_id") != F.col("o.table_id")) & (F.col("i.x0") >= F.col("o.x0")) & (F.col("i.top") >= F.col("o.top")) & (F.col("i.x1") <= F.col("o.x1")) & (F.col("i.bottom") <= F.col("o.bottom"))
        & F.contains(F.array_join("o.row_texts", "\n"), F.array_join("i.row_texts", "\n")) & ((F.size("i.row_texts") < F.size("o.row_texts")) | (F.col("i.table_id") > F.col("o.table_id")))
    )
    gone = inner.select(*doc, F.col("i.table_id").alias("table_id")).distinct()
    return tables.join(gone, [*doc, "table_id"], "left_anti")


def content_score(rows: DataFrame, table: list[str]) -> DataFrame:
    """Mean over a pair's row identities of the best row's similarity; rows come from row_differences."""
    one = F.when(F.col("kind") == "unchanged", 1.0).when(F.col("old_display").isNull() | F.col("new_display").isNull(), 0.0).otherwise(S.exact_ratio_udf("old_display", "new_display"))
    best = rows.withColumn("_s", one).groupBy(*table, "identity").agg(F.max("_s").alias("_s"))
    return best.groupBy(*table).agg(F.avg("_s").alias("content_score"))


def table_changes(pairs: DataFrame, rows: DataFrame, doc: list[str]) -> DataFrame:
    """pairs with change_type: added, deleted, review, modified where a row's kind isn't unchanged, else unchanged."""
    told = rows.groupBy(*doc, "old_table", "new_table").agg(F.count_if(F.col("kind") != "unchanged").alias("changed_rows"), F.count_if(F.col("kind") == "review").alias("review_rows"))
    out = pairs.join(told, [*doc, "old_table", "new_table"], "left")
    kind = F.when(F.col("basis") == "ambiguous_order_conflict", "review").when(F.col("old_table").isNull(), "added").when(F.col("new_table").isNull(), "deleted")
    kind = kind.when(F.coalesce("changed_rows", F.lit(0)) == 0, "unchanged").when(F.col("changed_rows") == F.col("review_rows"), "review").otherwise("modified")
    return out.withColumn("change_type", kind)
