"""Queries of multisets, ordered operators, counters and boxes, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from variorum.functions import similarity as S
from variorum.functions import text as T
from variorum.operators import bags, delta, evaluate, match, ordered, quality, segment
from variorum.plans.catalog import _ANCHORS, _BAGS, _LINES, _WORDS, anchors, line_bags, query, revision_lines
from variorum.sources import readers

_PAGED = f"{_LINES}, paged AS (SELECT doc_id, (ord // 6 + 1) AS page_no, ord AS line_no, line FROM old_lines)"


def paged_lines(spark, sf_dir):
    """Old lines with pages of three."""
    return revision_lines(spark, sf_dir)[0].select("doc_id", F.expr("ord div 6 + 1").alias("page_no"), F.col("ord").alias("line_no"), "line")


# --- multisets


@query("bag_union_counts", f"WITH {_LINES} SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, line FROM old_lines UNION ALL SELECT doc_id, line FROM new_lines) GROUP BY ALL")
def bag_union_counts(spark, sf_dir):
    return bags.bag_union(*revision_lines(spark, sf_dir), ["doc_id", "line"])


@query("bag_difference_rows", f"WITH {_LINES} SELECT doc_id, line FROM old_lines EXCEPT ALL SELECT doc_id, line FROM new_lines")
def bag_difference_rows(spark, sf_dir):
    old, new = revision_lines(spark, sf_dir)
    return bags.bag_difference(old.select("doc_id", "line"), new.select("doc_id", "line"))


@query("ordered_distinct_lines", f"WITH {_LINES} SELECT doc_id, line, min(ord) AS ord FROM new_lines GROUP BY ALL")
def ordered_distinct_lines(spark, sf_dir):
    return bags.ordered_distinct(revision_lines(spark, sf_dir)[1], ["doc_id", "line"], "ord")


@query("hidden_occurrences_removed", f"WITH {_LINES} SELECT doc_id, line FROM new_lines EXCEPT ALL SELECT DISTINCT doc_id, line FROM old_lines")
def hidden_occurrences_removed(spark, sf_dir):
    old, new = revision_lines(spark, sf_dir)
    return bags.hidden_removed(new.select("doc_id", "line"), old.select("doc_id", "line").distinct())


@query("intervals_uncovered", """WITH i AS (SELECT DISTINCT o_custkey, unnest(range(o_orderkey, o_orderkey + 300)) AS p FROM orders WHERE o_orderstatus <> 'P'),
  h AS (SELECT DISTINCT o_custkey, unnest(range(o_orderkey, o_orderkey + 200)) AS p FROM orders WHERE o_orderstatus = 'O')
  SELECT o_custkey, count(*) AS uncovered FROM i ANTI JOIN h USING (o_custkey, p) GROUP BY o_custkey""")  # fmt: skip
def intervals_uncovered(spark, sf_dir):
    orders = readers.table(spark, sf_dir, "orders")
    span = lambda rows, n: rows.select("o_custkey", F.col("o_orderkey").alias("s"), (F.col("o_orderkey") + n).alias("e"))
    parts = bags.intervals_subtracted(span(orders.filter("o_orderstatus <> 'P'"), 300), span(orders.filter("o_orderstatus = 'O'"), 200), ["o_custkey"], "s", "e")
    return parts.groupBy("o_custkey").agg(F.sum(F.col("e") - F.col("s")).alias("uncovered"))


# --- ordered operators


@query("continuation_run_ids", """WITH l AS (SELECT l_orderkey, l_linenumber, CASE WHEN lag(l_returnflag) OVER w = l_returnflag THEN 0 ELSE 1 END AS f, l_partkey, l_extendedprice FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice))
  SELECT l_orderkey, l_linenumber, sum(f) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM l""")  # fmt: skip
def continuation_run_ids(spark, sf_dir):
    order = ["l_linenumber", "l_partkey", "l_extendedprice"]
    rows = readers.table(spark, sf_dir, "lineitem").select("l_orderkey", *order, "l_returnflag")
    same = F.lag("l_returnflag").over(Window.partitionBy("l_orderkey").orderBy(*order)) == F.col("l_returnflag")
    return ordered.continuation_runs(rows, ["l_orderkey"], order, same).select("l_orderkey", "l_linenumber", "run")


@query("bracketed_lines", f"""WITH {_ANCHORS}, r AS (SELECT l.doc_id, l.ord, a.new_ord // 2 AS m FROM old_lines l LEFT JOIN anchors a ON l.doc_id = a.doc_id AND l.ord = a.old_ord)
  SELECT doc_id, ord FROM (SELECT doc_id, ord, lag(m) OVER w AS p, lead(m) OVER w AS n FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY ord)) WHERE n = p + 2""")  # fmt: skip
def bracketed_lines(spark, sf_dir):
    old = revision_lines(spark, sf_dir)[0].select("doc_id", "ord")
    met = anchors(spark, sf_dir).select("doc_id", F.col("old_ord").alias("ord"), F.floor(F.col("new_ord") / 2).alias("m"))
    return ordered.bracketed(old.join(met, ["doc_id", "ord"], "left"), ["doc_id"], "ord", "m").select("doc_id", "ord")


@query("relative_positions", "SELECT l_orderkey, l_linenumber, round(percent_rank() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber), 6) AS position FROM lineitem")
def relative_positions(spark, sf_dir):
    return readers.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(ordered.relative_position(["l_orderkey"], "l_linenumber"), 6).alias("position"))


@query("sibling_offsets", f"""WITH {_ANCHORS}, a AS (SELECT doc_id, ord AS old_ord, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS i FROM old_lines), b AS (SELECT doc_id, ord AS new_ord, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS j FROM new_lines),
  c AS (SELECT doc_id, j - i AS "offset", count(*) AS support FROM anchors JOIN a USING (doc_id, old_ord) JOIN b USING (doc_id, new_ord) WHERE j <> i GROUP BY ALL HAVING count(*) >= 2)
  SELECT doc_id, "offset", support FROM c QUALIFY count(*) OVER (PARTITION BY doc_id) = 1""")  # fmt: skip
def sibling_offsets(spark, sf_dir):
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")).cast("long")
    old, new = revision_lines(spark, sf_dir)
    pairs = anchors(spark, sf_dir).join(old.select("doc_id", F.col("ord").alias("old_ord"), place.alias("i")), ["doc_id", "old_ord"])
    return ordered.offset_support(pairs.join(new.select("doc_id", F.col("ord").alias("new_ord"), place.alias("j")), ["doc_id", "new_ord"]), ["doc_id"], "i", "j")


@query("increasing_anchors", f"""WITH {_ANCHORS} SELECT doc_id, bool_and(ok) AS increasing FROM (SELECT doc_id, coalesce(new_ord > lag(new_ord) OVER (PARTITION BY doc_id ORDER BY old_ord), true) AS ok FROM anchors) GROUP BY doc_id""")
def increasing_anchors(spark, sf_dir):
    return ordered.increasing(anchors(spark, sf_dir), ["doc_id"], "old_ord", "new_ord")


@query("coherent_unit_groups", f"""WITH {_LINES}, u AS (SELECT doc_id, ord // 2 AS unit_no, line AS text FROM old_lines WHERE ord % 14 <> 0),
  r AS (SELECT doc_id, unit_no, text, unit_no - row_number() OVER (PARTITION BY doc_id ORDER BY unit_no) AS run FROM u)
  SELECT doc_id, unit_no, run, greatest((row_number() OVER w - 1) // 3, (sum(length(text)) OVER w - 1) // 400)::INT AS part FROM r WINDOW w AS (PARTITION BY doc_id, run ORDER BY unit_no)""")  # fmt: skip
def coherent_unit_groups(spark, sf_dir):
    units = revision_lines(spark, sf_dir)[0].filter("ord % 14 <> 0").select("doc_id", F.expr("ord div 2").alias("unit_no"), F.col("line").alias("text"))
    return segment.coherent_groups(units, ["doc_id"], "unit_no", most=3, characters=400).drop("text")


@query("uncovered_units", f"WITH {_LINES} SELECT doc_id, ord, line AS key FROM old_lines ANTI JOIN (SELECT doc_id, line FROM new_lines) n USING (doc_id, line)")
def uncovered_units(spark, sf_dir):
    old, new = (x.select("doc_id", "ord", F.col("line").alias("key")) for x in revision_lines(spark, sf_dir))
    return segment.review_units(old, new, ["doc_id"])


# --- counters


@query("repeated_edge_characters", f"""WITH {_PAGED}, e AS (SELECT doc_id, page_no, line FROM paged QUALIFY row_number() OVER (PARTITION BY doc_id, page_no ORDER BY line_no) = 1 OR row_number() OVER (PARTITION BY doc_id, page_no ORDER BY line_no DESC) = 1),
  p AS (SELECT doc_id, count(DISTINCT page_no) AS pages FROM paged GROUP BY doc_id), o AS (SELECT doc_id, line, count(DISTINCT page_no) AS n, count(*) AS c FROM e GROUP BY ALL)
  SELECT doc_id, sum(length(line) * c)::BIGINT AS repeated_characters FROM o JOIN p USING (doc_id) WHERE n >= greatest(3, ceil(0.75 * pages)) GROUP BY doc_id""")  # fmt: skip
def repeated_edge_characters(spark, sf_dir):
    return quality.repeated_edge_characters(paged_lines(spark, sf_dir), ["doc_id"])


@query("ambiguous_context_pages", """WITH s AS (SELECT l_suppkey, page_no, count(*) AS sections FROM (SELECT l_suppkey, unnest(range(l_linenumber, l_linenumber + 3)) AS page_no FROM lineitem WHERE l_returnflag = 'R') GROUP BY ALL),
  t AS (SELECT l_suppkey, l_linenumber AS page_no, count(*) AS tables FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL)
  SELECT l_suppkey, page_no, tables, sections FROM t JOIN s USING (l_suppkey, page_no) WHERE tables > 1 AND sections > 1""")  # fmt: skip
def ambiguous_context_pages(spark, sf_dir):
    rows = readers.table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_linenumber").cast("long").alias("page_no"), "l_returnflag")
    sections = rows.filter("l_returnflag = 'R'").select("l_suppkey", F.col("page_no").alias("start_page"), (F.col("page_no") + 2).alias("end_page"))
    return quality.ambiguous_context_pages(rows.filter("l_returnflag = 'A'"), sections, ["l_suppkey"])


@query("page_window_consistency", """SELECT l_orderkey, bool_and(ok) AS consistent FROM (SELECT l_orderkey, coalesce(l_linenumber = lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) + 1, true) AS ok FROM lineitem WHERE l_returnflag <> 'R') GROUP BY l_orderkey""")
def page_window_consistency(spark, sf_dir):
    rows = readers.table(spark, sf_dir, "lineitem").filter("l_returnflag <> 'R'")
    return quality.window_consistency(rows.select("l_orderkey", F.col("l_linenumber").alias("page_no")), ["l_orderkey"])


@query("page_audit", f"""WITH {_LINES}, b AS (SELECT doc_id AS page_no, count(*) AS blocks, count(*) FILTER (contains(line, '|')) AS table_blocks FROM old_lines GROUP BY ALL)
  SELECT lang, d.doc_id AS page_no, length(coalesce(text, '')) AS characters, CASE WHEN length(coalesce(text, '')) = 0 THEN 'empty' ELSE 'native_text' END AS route, coalesce(blocks, 0) AS blocks, coalesce(table_blocks, 0) AS table_blocks, 0::BIGINT AS ocr_blocks
  FROM documents d LEFT JOIN b ON b.page_no = d.doc_id""")  # fmt: skip
def page_audit(spark, sf_dir):
    none = F.lit(None).cast("boolean")
    pages = readers.table(spark, sf_dir, "documents").select("lang", F.col("doc_id").alias("page_no"), "text", none.alias("ocr_used"), none.alias("image_dominant"), none.alias("layout_risk"))
    lines = revision_lines(spark, sf_dir)[0].select(F.col("doc_id").alias("page_no"), F.when(F.contains("line", F.lit("|")), "table").otherwise("text").alias("kind"))
    return quality.page_audit(pages, lines.join(pages.select("lang", "page_no"), "page_no"), ["lang"])


@query("route_page_lists", "SELECT lang, CASE WHEN length(text) > 2000 THEN 'long' ELSE 'short' END AS route, list(doc_id ORDER BY doc_id) AS pages FROM documents GROUP BY ALL")
def route_page_lists(spark, sf_dir):
    docs = readers.table(spark, sf_dir, "documents")
    return quality.route_pages(docs.select("lang", F.when(F.length("text") > 2000, "long").otherwise("short").alias("route"), F.col("doc_id").alias("page_no")), ["lang"])


@query("coverage_review_items", f"""WITH {_BAGS} SELECT doc_id, 'added' AS kind, sum(new_n - old_n)::BIGINT AS n FROM bag WHERE new_n > old_n GROUP BY doc_id UNION ALL SELECT doc_id, 'deleted', sum(old_n - new_n)::BIGINT FROM bag WHERE old_n > new_n GROUP BY doc_id""")
def coverage_review_items(spark, sf_dir):
    each = line_bags(spark, sf_dir)
    part = lambda kind, c: each.filter(F.col(c) > 0).groupBy("doc_id").agg(F.lit(kind).alias("kind"), F.sum(c).alias("n"))
    return quality.coverage_review(part("added", "only_new"), part("deleted", "only_old"))


@query("reader_summary", f"""WITH {_BAGS}, k AS (SELECT doc_id, CASE WHEN old_n = new_n THEN 'unchanged' WHEN old_n = 0 THEN 'added' WHEN new_n = 0 THEN 'deleted' ELSE 'review' END AS t FROM bag)
  SELECT doc_id, 0::BIGINT AS modified, count(*) FILTER (t = 'added') AS added, count(*) FILTER (t = 'deleted') AS deleted, count(*) FILTER (t = 'unchanged') AS unchanged, count(*) FILTER (t = 'review') AS review FROM k GROUP BY doc_id""")  # fmt: skip
def reader_summary(spark, sf_dir):
    kind = F.when(F.col("old_n") == F.col("new_n"), "unchanged").when(F.col("old_n") == 0, "added").when(F.col("new_n") == 0, "deleted").otherwise("review")
    return quality.reader_summary(line_bags(spark, sf_dir).withColumn("change_type", kind), ["doc_id"])


@query("characters_not_conserved", f"""WITH {_LINES}, c AS (SELECT doc_id, unnest(regexp_extract_all(replace(line, ' ', ''), '(?s).')) AS c, 1 AS s FROM old_lines UNION ALL SELECT doc_id, unnest(regexp_extract_all(replace(line, ' ', ''), '(?s).')), -1 FROM new_lines)
  SELECT DISTINCT doc_id FROM (SELECT doc_id, c FROM c GROUP BY ALL HAVING sum(s) <> 0)""")  # fmt: skip
def characters_not_conserved(spark, sf_dir):
    return quality.characters_conserved(*revision_lines(spark, sf_dir), ["doc_id"], "line")


@query("visual_downgrade", """SELECT doc_id, CASE WHEN length(coalesce(text, '')) = 0 THEN 'indeterminate' WHEN quality = 0 THEN 'degraded' ELSE 'reliable' END AS state,
  CASE WHEN quality = 0 THEN ['visual_review'] ELSE [] END AS reasons FROM documents LEFT JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY doc_id) USING (doc_id)""")  # fmt: skip
def visual_downgrade(spark, sf_dir):
    docs = readers.table(spark, sf_dir, "documents")
    empty = F.length(F.coalesce("text", F.lit(""))) == 0
    told = docs.select("doc_id", F.when(empty, "indeterminate").otherwise("reliable").alias("state"), F.array().cast("array<string>").alias("reasons"))
    seen = readers.table(spark, sf_dir, "labels").groupBy("doc_id").agg((1 - F.min("quality")).alias("unexplained"))
    return quality.downgraded(told, seen, ["doc_id"])


@query("residual_literals", f"""WITH {_ANCHORS}, a AS (SELECT doc_id, line AS key FROM old_lines ANTI JOIN (SELECT doc_id, old_ord AS ord FROM anchors) x USING (doc_id, ord)),
  b AS (SELECT doc_id, line AS key FROM new_lines ANTI JOIN (SELECT doc_id, new_ord AS ord FROM anchors) x USING (doc_id, ord))
  SELECT doc_id, key, greatest(sum(s), 0)::BIGINT AS old_left, greatest(-sum(s), 0)::BIGINT AS new_left FROM (SELECT *, 1 AS s FROM a UNION ALL SELECT *, -1 FROM b) GROUP BY ALL""")  # fmt: skip
def residual_literals(spark, sf_dir):
    old, new = (x.select("doc_id", F.col("ord").alias("unit_no"), F.col("line").alias("key")) for x in revision_lines(spark, sf_dir))
    pairs = anchors(spark, sf_dir).select("doc_id", F.col("old_ord").alias("old_no"), F.col("new_ord").alias("new_no"))
    return delta.residual_literals(old, new, pairs, ["doc_id"])


@query("status_counts", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY ALL")
def status_counts(spark, sf_dir):
    return evaluate.status_counts(readers.table(spark, sf_dir, "orders").withColumnRenamed("o_orderstatus", "status"))


# --- sources


@query("merged_observations", f"WITH {_LINES} SELECT doc_id, ord, line, 'native' AS origin FROM old_lines UNION ALL SELECT doc_id, ord, line, 'ocr' FROM new_lines ANTI JOIN (SELECT doc_id, line FROM old_lines) o USING (doc_id, line)")
def merged_observations(spark, sf_dir):
    native, seen = (x.select("doc_id", "ord", "line") for x in revision_lines(spark, sf_dir))
    return readers.merged_observations(native, seen, ["doc_id"])


@query("uncached_pages", "SELECT doc_id, n_chars FROM documents ANTI JOIN labels USING (doc_id)")
def uncached_pages(spark, sf_dir):
    return readers.uncached(readers.table(spark, sf_dir, "documents").select("doc_id", "n_chars"), readers.table(spark, sf_dir, "labels"), ["doc_id"])


# --- scalar functions


@query("line_forms", rf"""WITH {_LINES} SELECT doc_id, ord, regexp_replace(line, '^\s*(?:[•●▪■◦‣·*–-]|\(?[a-z0-9]{{1,3}}[.)])\s+', '') AS bare, translate(line, '{T.DASHES}', '------') AS dashes,
  translate(replace(line, ' ', ''), '{T.DASHES}', '------') AS formula, CASE WHEN length(line) > 60 THEN left(line, 59) || '…' ELSE line END AS short, sha256(doc_id || chr(31) || line) AS scope FROM old_lines""")  # fmt: skip
def line_forms(spark, sf_dir):
    line = F.col("line")
    return revision_lines(spark, sf_dir)[0].select(
        "doc_id", "ord", T.without_list_marker(line).alias("bare"), T.dashes_unified(line).alias("dashes"), T.formula_key(line).alias("formula"),
        T.truncated(line, 60).alias("short"), T.scope_hash(F.col("doc_id").cast("string"), line).alias("scope"),
    )


@query("line_signatures", rf"""WITH {_LINES} SELECT doc_id, ord, list_filter(regexp_extract_all(line, '{T.NUMBER}'), lambda x: regexp_matches(x, '^[+-]?0\d+$')) AS zeros,
  array_to_string(regexp_extract_all(line, '[{T.SUPERSCRIPTS}{T.SUBSCRIPTS}]+'), ' ') AS scripts, regexp_matches(line, '{T.MEASUREMENT}') AS measured,
  regexp_extract_all(line, '[A-Za-z][A-Za-z0-9+.-]*://[^\s,;]+|[A-Za-z]:\\[^\s,;]+|/?[A-Za-z0-9_.+-]+(?:/[A-Za-z0-9_.+-]+)+') AS paths FROM old_lines""")  # fmt: skip
def line_signatures(spark, sf_dir):
    line = F.col("line")
    return revision_lines(spark, sf_dir)[0].select("doc_id", "ord", T.leading_zero_numbers(line).alias("zeros"), T.script_signature(line).alias("scripts"), T.measurement_context(line).alias("measured"), T.paths(line).alias("paths"))


@query("image_hash_distance", "SELECT o_orderkey, bit_count(xor(o_orderkey, o_custkey))::INT AS distance FROM orders")
def image_hash_distance(spark, sf_dir):
    return readers.table(spark, sf_dir, "orders").select("o_orderkey", S.hamming(F.col("o_orderkey"), F.col("o_custkey")).alias("distance"))


@query("word_overlap_factor", f"""WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents)
  SELECT a.doc_id, round(CASE WHEN least(len(a.w), len(b.w)) > 0 THEN 0.75 + 0.25 * len(list_intersect(a.w, b.w)) / least(len(a.w), len(b.w)) ELSE 0.75 END, 6) AS factor FROM d a JOIN d b ON b.doc_id = a.doc_id + 1""")  # fmt: skip
def word_overlap_factor(spark, sf_dir):
    docs = readers.table(spark, sf_dir, "documents").select("doc_id", F.array_distinct(T.meaningful_words(F.col("text"))).alias("w"))
    after = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("w").alias("w2"))
    return docs.join(after, "doc_id").select("doc_id", F.round(S.word_overlap_factor(F.col("w"), F.col("w2")), 6).alias("factor"))


@query("contained_boxes", """SELECT a.o_custkey, a.o_orderkey, b.o_orderkey AS outer_id FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND b.o_orderstatus = 'F'
  AND a.o_orderkey % 500 + 5 BETWEEN b.o_orderkey % 400 AND b.o_orderkey % 400 + 150 AND a.o_orderkey % 300 + 5 BETWEEN b.o_orderkey % 200 AND b.o_orderkey % 200 + 120""")  # fmt: skip
def contained_boxes(spark, sf_dir):
    orders = readers.table(spark, sf_dir, "orders")

    def boxes(rows, name, x, y, wide, high):
        left, top = F.col("o_orderkey") % x, F.col("o_orderkey") % y
        return rows.select("o_custkey", F.col("o_orderkey").alias(name), left.cast("double").alias("x0"), (left + wide).cast("double").alias("x1"), top.cast("double").alias("top"), (top + high).cast("double").alias("bottom"))

    inner, outer = boxes(orders, "o_orderkey", 500, 300, 10, 10), boxes(orders.filter("o_orderstatus = 'F'"), "outer_id", 400, 200, 150, 120)
    return match.contained_boxes(inner, outer, ["o_custkey"]).select("o_custkey", "o_orderkey", "outer_id")
