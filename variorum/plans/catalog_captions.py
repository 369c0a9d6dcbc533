"""Queries of captions, contexts, pages and what readers see, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from variorum.operators import captions
from variorum.plans.catalog import _LINES, query, revision_lines
from variorum.sources import readers

_PAGES = f"""{_LINES}, op AS (SELECT doc_id, ord // 4 AS page_no, string_agg(line, ' ' ORDER BY ord) AS key FROM old_lines GROUP BY ALL),
np AS (SELECT doc_id, ord // 4 AS page_no, string_agg(line, ' ' ORDER BY ord) AS key FROM new_lines WHERE ord >= 0 GROUP BY ALL)"""
_SHOWN = f"""{_LINES}, au AS (SELECT doc_id, line, ord FROM new_lines ANTI JOIN (SELECT doc_id, line, ord FROM old_lines) o USING (doc_id, line, ord)),
sh AS (SELECT doc_id, line, ord FROM au QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY ord) % 3 = 1)"""


def sized_parts(spark, sf_dir):
    """Tables named for parts: two revisions of captions, a document for each brand and size."""
    part = readers.table(spark, sf_dir, "part").select(F.col("p_brand"), F.col("p_size"), F.col("p_partkey"), "p_name", "p_type")
    caption = lambda no: F.concat(F.lit("Table "), no, F.lit(" "), F.col("p_type"), F.lit(" in "), F.col("p_brand"), F.lit(" of "), F.col("p_name"))
    tables = lambda no: part.select("p_brand", "p_size", F.col("p_partkey").alias("table_id"), caption(no).alias("caption"))
    return tables(F.concat(F.lit("4."), F.col("p_partkey"))), tables(F.concat(F.lit("5."), F.col("p_partkey")))


@query("caption_families", """WITH t AS (SELECT p_type, p_size, p_partkey, lower(p_name) || ' ' || p_partkey AS d FROM part), p AS (SELECT p_type, 'A.' || (p_size % 5) AS o, 'B.' || (CASE WHEN p_size % 25 = 7 THEN 9 ELSE p_size % 5 END) AS n, d, p_partkey AS i, CASE WHEN p_size % 5 = 3 THEN -p_partkey ELSE p_partkey END AS j FROM t),
  f AS (SELECT p_type, o AS old_family, n AS new_family, count(*) AS anchors, bool_or(j < 0) AND count(*) > 1 AS x FROM p GROUP BY ALL)
  SELECT p_type, old_family, new_family, anchors FROM f QUALIFY count(*) OVER (PARTITION BY p_type, old_family) = 1 AND count(*) OVER (PARTITION BY p_type, new_family) = 1 AND anchors >= 3 AND NOT x""")  # fmt: skip
def caption_families(spark, sf_dir):
    part = readers.table(spark, sf_dir, "part")
    left = F.col("p_size") % 5
    side = lambda family, order: part.select("p_type", order.alias("ord"), family.alias("family"), F.concat_ws(" ", F.lower("p_name"), "p_partkey").alias("descriptor"))
    old = side(F.concat(F.lit("A."), left), F.col("p_partkey"))
    new = side(F.concat(F.lit("B."), F.when(F.col("p_size") % 25 == 7, 9).otherwise(left)), F.when(left == 3, -F.col("p_partkey")).otherwise(F.col("p_partkey")))
    return captions.family_map(old, new, ["p_type"])


@query("caption_cores")
def caption_cores(spark, sf_dir):
    return captions.core_groups(*sized_parts(spark, sf_dir), ["p_brand", "p_size"])


@query("caption_runs")
def caption_runs(spark, sf_dir):
    items = readers.table(spark, sf_dir, "lineitem").select("l_suppkey", F.concat(F.lit("Table "), "l_returnflag").alias("caption"), "l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("q"), "l_partkey", "l_extendedprice")
    at = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    rows = items.select("l_suppkey", "caption", F.row_number().over(Window.partitionBy("l_suppkey", "caption").orderBy(at)).alias("ord"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("table_id"), F.col("q").cast("string").alias("content"), "q")
    return captions.aligned_runs(rows.filter("q % 7 <> 0"), rows.filter("q % 5 <> 0"), ["l_suppkey"])


@query("table_contexts", """WITH s AS (SELECT l_orderkey, l_partkey AS ord, l_linenumber AS a, l_linenumber + l_suppkey % 4 AS b, l_suppkey % 3 AS level FROM lineitem WHERE l_returnflag <> 'N'), t AS (SELECT DISTINCT l_orderkey, l_linenumber AS page_no FROM lineitem WHERE l_returnflag = 'N')
  SELECT t.l_orderkey, page_no, coalesce(arg_max('number:' || (CASE level WHEN 0 THEN '1' WHEN 1 THEN '1/2' ELSE '1/2/3' END) || chr(31) || 'title:part ' || ord, level * 100000000000000 + a * 1000000000000 + ord), '') AS context
  FROM t LEFT JOIN s ON t.l_orderkey = s.l_orderkey AND page_no BETWEEN a AND b GROUP BY ALL""")  # fmt: skip
def table_contexts(spark, sf_dir):
    rows = readers.table(spark, sf_dir, "lineitem")
    level = F.col("l_suppkey") % 3
    path = F.slice(F.array(F.lit("1"), F.lit("2"), F.lit("3")), 1, (level + 1).cast("int"))
    title = F.concat(F.lit("Part  "), "l_partkey")
    page = F.col("l_linenumber").cast("long")
    sections = rows.filter("l_returnflag <> 'N'").select("l_orderkey", F.col("l_partkey").alias("ord"), path.alias("number_path"), level.alias("level"), title.alias("title"), title.alias("heading"), page.alias("start_page"), (page + F.col("l_suppkey") % 4).alias("end_page"))
    return captions.table_context(rows.filter("l_returnflag = 'N'").select("l_orderkey", page.alias("page_no")).distinct(), sections, ["l_orderkey"])


@query("catalog_similarity", """WITH e AS (SELECT p_brand, p_partkey AS k, 'table ' || p_size AS identifier, p_name AS title FROM part), x AS (SELECT p_brand, identifier, title, count(*) FILTER (k % 7 <> 0) AS o, count(*) FILTER (k % 5 <> 0) AS n FROM e GROUP BY ALL)
  SELECT p_brand, sum(least(o, n))::BIGINT AS shared, sum(o)::BIGINT AS old_total, sum(n)::BIGINT AS new_total, 2.0 * sum(least(o, n)) / sum(o + n) AS dice FROM x GROUP BY p_brand""")  # fmt: skip
def catalog_similarity(spark, sf_dir):
    entries = readers.table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.concat(F.lit("table "), "p_size").alias("identifier"), F.col("p_name").alias("title"))
    return captions.catalog_similarity(entries.filter("p_partkey % 7 <> 0"), entries.filter("p_partkey % 5 <> 0"), ["p_brand"])


@query("page_text_pairs", f"""WITH {_PAGES}, u AS (SELECT doc_id, a.page_no AS old_page, b.page_no AS new_page FROM (SELECT * FROM op QUALIFY count(*) OVER (PARTITION BY doc_id, key) = 1) a JOIN (SELECT * FROM np QUALIFY count(*) OVER (PARTITION BY doc_id, key) = 1) b USING (doc_id, key)),
  s AS (SELECT doc_id FROM (SELECT doc_id, list(key ORDER BY page_no) AS k FROM op GROUP BY doc_id) a JOIN (SELECT doc_id, list(key ORDER BY page_no) AS k FROM np GROUP BY doc_id) b USING (doc_id, k)),
  r AS (SELECT doc_id, a.page_no AS old_page, b.page_no AS new_page FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_no) AS i FROM op) a JOIN (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_no) AS i FROM np) b USING (doc_id, i) SEMI JOIN s USING (doc_id))
  SELECT *, 'unique_text' AS basis FROM u UNION ALL SELECT *, 'equal_sequence' FROM r ANTI JOIN u USING (doc_id, old_page, new_page)""")  # fmt: skip
def page_text_pairs(spark, sf_dir):
    def pages(rows):
        listed = F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"])
        return rows.groupBy("doc_id", F.expr("ord div 4").alias("page_no")).agg(F.array_join(listed, " ").alias("key"))

    old, new = revision_lines(spark, sf_dir)
    return captions.page_pairs(pages(old), pages(new.filter("ord >= 0")), ["doc_id"])


@query("covered_fragments", f"""WITH {_LINES}, f AS (SELECT doc_id, ord AS fragment_id, unnest(string_split(lower(line), ' ')) AS w FROM old_lines), t AS (SELECT doc_id, unnest(string_split(lower(line), ' ')) AS w FROM new_lines),
  a AS (SELECT doc_id, fragment_id, w, count(*) AS n FROM f WHERE w <> '' GROUP BY ALL), b AS (SELECT doc_id, w, count(*) AS m FROM t GROUP BY ALL)
  SELECT doc_id, fragment_id FROM a LEFT JOIN b USING (doc_id, w) GROUP BY ALL HAVING bool_and(coalesce(m >= n, false))""")  # fmt: skip
def covered_fragments(spark, sf_dir):
    old, new = revision_lines(spark, sf_dir)
    return captions.covered_fragments(old.select("doc_id", F.col("ord").alias("fragment_id"), "line"), new, ["doc_id"], text="line")


@query("refilled_display", f"""WITH {_SHOWN}, h AS (SELECT doc_id, line, count(*) AS had FROM sh GROUP BY ALL), m AS (SELECT doc_id, line, ord, row_number() OVER (PARTITION BY doc_id, line ORDER BY ord) AS occ FROM au),
  r AS (SELECT doc_id, line, ord, 0 AS k FROM sh UNION ALL SELECT doc_id, line, ord, 1 FROM m LEFT JOIN h USING (doc_id, line) WHERE occ > coalesce(had, 0))
  SELECT doc_id, line, ord FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY k, ord, line) <= 4""")  # fmt: skip
def refilled_display(spark, sf_dir):
    old, new = revision_lines(spark, sf_dir)
    audit = new.select("doc_id", "line", "ord").join(old, ["doc_id", "line", "ord"], "left_anti")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord"))
    shown = audit.withColumn("_r", place).filter("_r % 3 = 1").drop("_r")
    return captions.refilled(shown, audit, ["doc_id"], "line", "ord", 4)


@query("partial_windows", "SELECT l_orderkey, l_linenumber, l_partkey, l_linenumber > 1 OR l_linenumber + 1 < l_quantity AS partial FROM lineitem")
def partial_windows(spark, sf_dir):
    start = F.col("l_linenumber")
    return readers.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", captions.partial_window(start, start + 1, F.col("l_quantity")).alias("partial"))


@query("row_review_reasons", """WITH p AS (SELECT p_partkey, p_partkey % 6 AS m FROM part)
  SELECT p_partkey, CASE m WHEN 0 THEN 'layout' WHEN 1 THEN 'digit_spacing' WHEN 2 THEN 'blank_unit' WHEN 3 THEN 'glyphs' END AS reason FROM p""")  # fmt: skip
def row_review_reasons(spark, sf_dir):
    m = F.col("p_partkey") % 6
    key, name = F.col("p_partkey").cast("string"), F.col("p_name")
    number = F.concat(F.lit("1"), key)
    row = lambda *cells: F.array(*[F.struct(F.lit(label).alias("label"), v.alias("value")) for label, v in zip(("Name", "Value", "Unit"), cells)])
    old = row(F.when(m == 3, F.concat(name, F.lit(" "))).otherwise(name), number, F.lit("mV"))
    new = row(
        F.when(m == 0, F.regexp_replace(name, " ", "")).when(m == 3, F.concat(name, F.lit(" ±"))).when(m == 4, F.concat(name, F.lit(" x"))).otherwise(name),
        F.when(m == 1, F.concat(F.lit("1 "), key)).otherwise(number), F.when(m == 2, "").otherwise(F.lit("mV")),
    )
    return readers.table(spark, sf_dir, "part").select("p_partkey", captions.row_review_reason(old, new).alias("reason"))
