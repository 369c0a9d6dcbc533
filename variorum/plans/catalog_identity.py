"""Queries of what makes two sections, runs or lines one, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from variorum.functions import text as T
from variorum.operators import identity, paired
from variorum.plans.catalog import _LINES, line_sides, query, revision_lines
from variorum.sources import readers

_REVISED_TURNS = """o AS (SELECT conv_id, turn AS ord, text FROM conversations),
n AS (SELECT conv_id, turn AS ord, CASE WHEN conv_id % 3 = 0 AND turn = 1 THEN text || ' Moreover' ELSE text END AS text FROM conversations)
"""
_MASK = "regexp_replace(line, ' (?:the|a) ', ' # ', 'g')"


def of_paragraphs(spark, sf_dir, work, schema):
    """What ``work`` makes of a document's units, which are its lines, of both sides: judged where they are gathered."""
    return paired.over_documents(line_sides(spark, sf_dir), ["doc_id"], lambda a, x, b, y: [work(x, y)], schema)


@query("same_identity_similarity")
def same_identity_similarity(spark, sf_dir):
    told = of_paragraphs(spark, sf_dir, lambda x, y: (identity.identity_similarity("\n".join(x), "\n".join(y), x, y),), "similarity double")
    return told.withColumn("similarity", F.round("similarity", 6))


@query("skeleton_peer_counts")
def skeleton_peer_counts(spark, sf_dir):
    return of_paragraphs(spark, sf_dir, lambda x, y: (len(x), len(y), identity.peer_count(x, y)), "old_units int, new_units int, peers int")


@query("title_anchor_lines", f"""WITH {_LINES}, t AS (SELECT doc_id, arg_min(line, ord) AS title FROM old_lines GROUP BY doc_id),
  u AS (SELECT l.doc_id, ord, line, title, list_distinct(regexp_extract_all(lower(line), '[a-z]{{4,}}')) AS w, list_distinct(regexp_extract_all(lower(title), '[a-z]{{4,}}')) AS v,
          list_distinct(regexp_extract_all(line, '\\b[A-Z][A-Z0-9]+\\b')) AS a, list_distinct(regexp_extract_all(title, '\\b[A-Z][A-Z0-9]+\\b')) AS b FROM old_lines l JOIN t USING (doc_id) WHERE line <> title)
  SELECT doc_id, ord FROM u WHERE length(line) >= 80 AND regexp_matches(line, '[.。;；!！?？]["''”’)\\]]*$') AND regexp_matches(line, '{T.SENTENCE_VERB}')
    AND (list_has_any(w, v) OR list_has_any(a, b) OR len(list_filter(v, lambda x: len(list_filter(w, lambda y: least(length(x), length(y)) >= 6 AND (starts_with(x, y) OR starts_with(y, x)))) > 0)) > 0)""")  # fmt: skip
def title_anchor_lines(spark, sf_dir):
    old = revision_lines(spark, sf_dir)[0]
    titles = old.groupBy("doc_id").agg(F.min_by("line", "ord").alias("title"))
    return identity.title_anchors(old.join(titles, "doc_id").filter("line <> title"), ["doc_id"], text="line").select("doc_id", "ord")


@query("coalesced_runs", f"""WITH {_REVISED_TURNS}, a AS (SELECT conv_id, trim(regexp_replace(string_agg(text, ' ' ORDER BY ord), '[\\s\\v\\x00-\\x1F\\x7F\\x{{A0}}]+', ' ', 'g')) AS t, count(*) AS old_parts FROM o GROUP BY conv_id),
  b AS (SELECT conv_id, trim(regexp_replace(string_agg(text, ' ' ORDER BY ord), '[\\s\\v\\x00-\\x1F\\x7F\\x{{A0}}]+', ' ', 'g')) AS t, count(*) AS new_parts FROM n GROUP BY conv_id)
  SELECT conv_id, old_parts, new_parts FROM a JOIN b USING (conv_id, t) WHERE t <> ''""")  # fmt: skip
def coalesced_runs(spark, sf_dir):
    old = readers.table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("ord"), "text")
    edited = F.when((F.col("conv_id") % 3 == 0) & (F.col("ord") == 1), F.concat("text", F.lit(" Moreover"))).otherwise(F.col("text"))
    return identity.coalesced_runs(old, old.withColumn("text", edited), ["conv_id"])


@query("masked_repairs", f"""WITH {_LINES}, a AS (SELECT doc_id, ord, {_MASK} AS m FROM old_lines ANTI JOIN (SELECT doc_id, line FROM new_lines) x USING (doc_id, line)),
  b AS (SELECT doc_id, ord, {_MASK} AS m FROM new_lines ANTI JOIN (SELECT doc_id, line FROM old_lines) x USING (doc_id, line)),
  ua AS (SELECT doc_id, m, min(ord) AS old_ord FROM a WHERE m <> '' GROUP BY ALL HAVING count(*) = 1), ub AS (SELECT doc_id, m, min(ord) AS new_ord FROM b WHERE m <> '' GROUP BY ALL HAVING count(*) = 1)
  SELECT doc_id, old_ord, new_ord FROM ua JOIN ub USING (doc_id, m)""")  # fmt: skip
def masked_repairs(spark, sf_dir):
    old, new = revision_lines(spark, sf_dir)
    key = ["doc_id", "line"]
    mask = F.regexp_replace("line", " (?:the|a) ", " # ")
    return identity.masked_repairs(old.join(new, key, "left_anti"), new.join(old, key, "left_anti"), ["doc_id"], mask)
