"""Queries over the supplied tables: each applies operators of this package, and SQL says what it must give.

Old and new revisions are derived from ``documents``: the new one drops, repeats, edits and moves lines by a rule.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from variorum.functions import similarity as S
from variorum.functions import text as T
from variorum.operators import bags, delta, evaluate, evidence, geometry, match, ordered, paired, quality, segment, tables
from variorum.plans import compare
from variorum.plans.options import Options
from variorum.sources import readers
from variorum.streaming import revisions as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_BLANK = r"[\s\v\x00-\x1F\x7F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_LINES = rf"""
raw_lines AS (SELECT doc_id, source, generate_subscripts(l, 1) - 1 AS k, unnest(l) AS raw
              FROM (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents)),
norm AS (SELECT doc_id, source, k, trim(regexp_replace(raw, '{_BLANK}', ' ', 'g')) AS line FROM raw_lines),
old_lines AS (SELECT doc_id, source, k * 2 AS ord, line FROM norm WHERE line <> ''),
edited AS (SELECT doc_id, source, k, CASE WHEN (doc_id + k) % 5 = 0 THEN replace(line, ' the ', ' a ') ELSE line END AS line,
                  CASE WHEN doc_id % 13 = 0 AND k = max(k) OVER (PARTITION BY doc_id) THEN -2 ELSE k * 2 END AS ord
           FROM norm WHERE line <> '' AND (doc_id + k) % 7 <> 0),
new_lines AS (SELECT doc_id, source, ord, line FROM edited
              UNION ALL SELECT doc_id, source, ord + 1, line FROM edited WHERE (doc_id + k) % 11 = 0)
"""
_BAGS = f"""{_LINES},
bag AS (SELECT doc_id, source, line, sum(o)::BIGINT AS old_n, sum(n)::BIGINT AS new_n FROM (
          SELECT doc_id, source, line, 1 AS o, 0 AS n FROM old_lines UNION ALL SELECT doc_id, source, line, 0, 1 FROM new_lines)
        GROUP BY ALL)
"""
_OCC = f"""{_LINES},
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY ord) AS occ FROM old_lines),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY ord) AS occ FROM new_lines)
"""
_ANCHORS = f"""{_LINES},
ua AS (SELECT doc_id, line, min(ord) AS old_ord FROM old_lines WHERE length(line) >= 50 GROUP BY ALL HAVING count(*) = 1),
ub AS (SELECT doc_id, line, min(ord) AS new_ord FROM new_lines WHERE length(line) >= 50 GROUP BY ALL HAVING count(*) = 1),
anchors AS (SELECT doc_id, old_ord, new_ord FROM ua JOIN ub USING (doc_id, line))
"""
_WORDS = "list_filter(list_distinct(regexp_extract_all(lower({0}), '[a-z]+[a-z0-9]*(?:[-_/][a-z0-9]+)*')), lambda x: NOT list_contains(" + str(sorted(T.STOP_WORDS)) + ", x))"
_SHARED = f"""{_LINES}, a AS (SELECT doc_id, ord AS old_ord, unnest({_WORDS.format('line')}) AS w FROM old_lines), b AS (SELECT doc_id, ord AS new_ord, unnest({_WORDS.format('line')}) AS w FROM new_lines),
fa AS (SELECT doc_id, w FROM a GROUP BY ALL HAVING count(*) <= 32), fb AS (SELECT doc_id, w FROM b GROUP BY ALL HAVING count(*) <= 32),
shared AS (SELECT doc_id, old_ord, new_ord, count(*) AS shared FROM a SEMI JOIN fa USING (doc_id, w) JOIN (SELECT * FROM b SEMI JOIN fb USING (doc_id, w)) b USING (doc_id, w) GROUP BY ALL)
"""
# all lines that share a word, however many have it
_SHARING = f"""{_LINES}, a AS (SELECT doc_id, ord AS old_ord, unnest({_WORDS.format('line')}) AS w FROM old_lines), b AS (SELECT doc_id, ord AS new_ord, unnest({_WORDS.format('line')}) AS w FROM new_lines),
shared AS (SELECT DISTINCT doc_id, old_ord, new_ord FROM a JOIN b USING (doc_id, w))
"""
_SCORED = """
pairs AS (SELECT doc_id, old_ord, new_ord, o.line AS old_line, n.line AS new_line, round(2.0 * least(length(o.line), length(n.line)) / (length(o.line) + length(n.line)), 6) AS score
          FROM shared JOIN (SELECT doc_id, ord AS old_ord, line FROM old_lines) o USING (doc_id, old_ord) JOIN (SELECT doc_id, ord AS new_ord, line FROM new_lines) n USING (doc_id, new_ord))
"""
_PAIRS = f"""{_SHARED},
pairs AS (SELECT doc_id, old_ord, new_ord, o.line AS old_line, n.line AS new_line, round(2.0 * least(length(o.line), length(n.line)) / (length(o.line) + length(n.line)), 6) AS score
          FROM shared JOIN (SELECT doc_id, ord AS old_ord, line FROM old_lines) o USING (doc_id, old_ord) JOIN (SELECT doc_id, ord AS new_ord, line FROM new_lines) n USING (doc_id, new_ord))
"""


def query(name: str, sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def revision_lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(old, new) lines: doc_id, source, ord, line. The new side lacks lines with (doc_id + k) % 7 = 0, repeats those with
    % 11 = 0, edits those with % 5 = 0, and begins with its last line where doc_id % 13 = 0."""
    # dealt by document before they are cut into lines: windows and groups over a document's lines move nothing more
    docs = readers.table(spark, sf_dir, "documents").select("doc_id", "source", "text").repartition("doc_id")
    rows = segment.lines(docs).select("doc_id", "source", F.col("line_no").alias("k"), "line")
    old = rows.select("doc_id", "source", (F.col("k") * 2).cast("long").alias("ord"), "line")
    place = F.col("doc_id") + F.col("k")
    # not a plain comparison: from one Spark would infer that doc_id isn't null, on this side alone, and deal the texts twice
    kept = rows.filter(F.coalesce(place % 7 != 0, F.lit(False)))
    last = F.max("k").over(Window.partitionBy("doc_id"))
    edited = kept.withColumn("_last", last).withColumn("line", F.when(place % 5 == 0, F.replace("line", F.lit(" the "), F.lit(" a "))).otherwise(F.col("line")))
    edited = edited.withColumn("ord", F.when((F.col("doc_id") % 13 == 0) & (F.col("k") == F.col("_last")), -2).otherwise(F.col("k") * 2).cast("long"))
    copies = F.when(place % 11 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    new = edited.withColumn("_c", F.explode(copies)).select("doc_id", "source", (F.col("ord") + F.col("_c")).alias("ord"), "line")
    return old, new


def line_bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bags.bag_compare(*revision_lines(spark, sf_dir), ["doc_id", "source", "line"])


def line_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a document's two sides that share a word which at most 32 lines of either side have, with their length bound."""
    old, new = revision_lines(spark, sf_dir)
    shared = match.shared_word_pairs(old, new, ["doc_id"], "ord", "line").drop("shared")
    a = old.select("doc_id", F.col("ord").alias("old_ord"), F.col("line").alias("old_line"))
    b = new.select("doc_id", F.col("ord").alias("new_ord"), F.col("line").alias("new_line"))
    return shared.join(a, ["doc_id", "old_ord"]).join(b, ["doc_id", "new_ord"]).withColumn("score", F.round(S.length_bound(F.col("old_line"), F.col("new_line")), 6))


def line_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's lines of both sides in one row: the unit in which they are paired."""
    return paired.sides(*revision_lines(spark, sf_dir), ["doc_id"], "ord", ["ord", "line"])


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.unique_equal(*revision_lines(spark, sf_dir), ["doc_id"], "line", "ord", "ord")


@query("added_deleted_counts", f"WITH {_BAGS} SELECT doc_id, sum(greatest(new_n - old_n, 0))::BIGINT AS added, sum(greatest(old_n - new_n, 0))::BIGINT AS deleted, sum(least(old_n, new_n))::BIGINT AS kept FROM bag GROUP BY doc_id")
def added_deleted_counts(spark, sf_dir):
    return line_bags(spark, sf_dir).groupBy("doc_id").agg(F.sum("only_new").alias("added"), F.sum("only_old").alias("deleted"), F.sum("shared").alias("kept"))


@query("line_bag_diff", f"WITH {_BAGS} SELECT doc_id, line, old_n, new_n FROM bag WHERE old_n <> new_n")
def line_bag_diff(spark, sf_dir):
    return line_bags(spark, sf_dir).filter("old_n <> new_n").select("doc_id", "line", "old_n", "new_n")


@query("line_bag_intersection", f"WITH {_LINES} SELECT doc_id, line FROM old_lines INTERSECT ALL SELECT doc_id, line FROM new_lines")
def line_bag_intersection(spark, sf_dir):
    old, new = revision_lines(spark, sf_dir)
    return bags.bag_intersection(old.select("doc_id", "line"), new.select("doc_id", "line"))


@query("unit_occurrence_join", f"""WITH {_OCC} SELECT coalesce(o.doc_id, n.doc_id) AS doc_id,
  CASE WHEN o.line IS NULL THEN 'added' WHEN n.line IS NULL THEN 'deleted' WHEN o.ord = n.ord THEN 'unchanged' ELSE 'moved' END AS kind, count(*) AS n
  FROM o FULL JOIN n ON o.doc_id = n.doc_id AND o.line = n.line AND o.occ = n.occ GROUP BY ALL""")  # fmt: skip
def unit_occurrence_join(spark, sf_dir):
    old, new = (ordered.occurrence(x, ["doc_id", "line"], ["ord"]) for x in revision_lines(spark, sf_dir))
    both = old.select("doc_id", "line", "occ", F.col("ord").alias("o")).join(new.select("doc_id", "line", "occ", F.col("ord").alias("n")), ["doc_id", "line", "occ"], "full")
    kind = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "deleted").when(F.col("o") == F.col("n"), "unchanged").otherwise("moved")
    return both.groupBy("doc_id", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("content_digest_identity", f"""WITH {_LINES}, a AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY ord) AS t FROM old_lines GROUP BY doc_id),
  b AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY ord) AS t FROM new_lines GROUP BY doc_id) SELECT doc_id FROM a JOIN b USING (doc_id) WHERE a.t = b.t""")  # fmt: skip
def content_digest_identity(spark, sf_dir):
    old, new = revision_lines(spark, sf_dir)
    return match.identical_pairs(old, new, ["doc_id"], "ord", "line")


@query("unique_content_anchor", f"WITH {_ANCHORS} SELECT doc_id, old_ord, new_ord FROM anchors")
def unique_content_anchor(spark, sf_dir):
    return anchors(spark, sf_dir)


@query("crossing_pairs", f"""WITH {_ANCHORS} SELECT doc_id, old_ord, new_ord,
  coalesce(max(new_ord) OVER (PARTITION BY doc_id ORDER BY old_ord, new_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > new_ord, false)
  OR coalesce(min(new_ord) OVER (PARTITION BY doc_id ORDER BY old_ord, new_ord ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) < new_ord, false) AS crosses FROM anchors""")  # fmt: skip
def crossing_pairs(spark, sf_dir):
    return ordered.crossing(anchors(spark, sf_dir), ["doc_id"], "old_ord", "new_ord")


@query("nearest_anchor_asof", f"""WITH {_ANCHORS}, r AS (SELECT l.doc_id, l.ord, a.new_ord AS m FROM old_lines l LEFT JOIN anchors a ON l.doc_id = a.doc_id AND l.ord = a.old_ord)
  SELECT doc_id, ord, last_value(m IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
  first_value(m IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM r""")  # fmt: skip
def nearest_anchor_asof(spark, sf_dir):
    old, _ = revision_lines(spark, sf_dir)
    rows = old.select("doc_id", "ord").join(anchors(spark, sf_dir).select("doc_id", F.col("old_ord").alias("ord"), F.col("new_ord").alias("m")), ["doc_id", "ord"], "left")
    return ordered.nearest_matched(rows, ["doc_id"], "ord", "m").drop("m")


@query("within_anchors", f"""WITH {_ANCHORS}, u AS (SELECT a.doc_id, a.ord AS old_ord, b.ord AS new_ord FROM old_lines a JOIN new_lines b USING (doc_id, line) WHERE length(a.line) < 50)
  SELECT doc_id, old_ord, new_ord FROM u WHERE (SELECT count(*) FROM anchors x WHERE x.doc_id = u.doc_id AND x.old_ord < u.old_ord) = (SELECT count(*) FROM anchors x WHERE x.doc_id = u.doc_id AND x.new_ord < u.new_ord)""")  # fmt: skip
def within_anchors(spark, sf_dir):
    old, new = revision_lines(spark, sf_dir)
    short = lambda x, name: x.filter(F.length("line") < 50).select("doc_id", "line", F.col("ord").alias(name))
    candidates = short(old, "old_ord").join(short(new, "new_ord"), ["doc_id", "line"]).drop("line")
    return ordered.within_anchors(candidates, anchors(spark, sf_dir), ["doc_id"], "old_ord", "new_ord")


@query("mutual_best_length", f"""WITH {_SHARING}, {_SCORED}, m AS (SELECT *, max(score) OVER (PARTITION BY doc_id, old_ord) AS bo, max(score) OVER (PARTITION BY doc_id, new_ord) AS bn FROM pairs),
  co AS (SELECT doc_id, old_ord FROM m WHERE score = bo GROUP BY ALL HAVING count(*) = 1), cn AS (SELECT doc_id, new_ord FROM m WHERE score = bn GROUP BY ALL HAVING count(*) = 1)
  SELECT m.doc_id, m.old_ord, m.new_ord, score FROM m JOIN co USING (doc_id, old_ord) JOIN cn USING (doc_id, new_ord) WHERE score = bo AND score = bn""")  # fmt: skip
def mutual_best_length(spark, sf_dir):
    return paired.over_documents(line_sides(spark, sf_dir), ["doc_id"], paired.best_length_pairs(), "old_ord long, new_ord long, score double")


@query("length_bound_pruning", f"WITH {_PAIRS} SELECT doc_id, count(*) AS pairs, count(*) FILTER (score >= 0.72) AS kept FROM pairs GROUP BY doc_id")
def length_bound_pruning(spark, sf_dir):
    return line_pairs(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("score") >= 0.72).alias("kept"))


@query("character_bag_similarity", f"""WITH {_PAIRS}, p AS (SELECT doc_id, old_ord, new_ord, old_line, new_line FROM pairs WHERE score >= 0.72),
  x AS (SELECT doc_id, old_ord, c, count(*) AS n FROM (SELECT doc_id, ord AS old_ord, unnest(string_split(line, '')) AS c FROM old_lines) GROUP BY ALL),
  y AS (SELECT doc_id, new_ord, c, count(*) AS m FROM (SELECT doc_id, ord AS new_ord, unnest(string_split(line, '')) AS c FROM new_lines) GROUP BY ALL),
  s AS (SELECT doc_id, old_ord, new_ord, sum(least(n, m)) AS s FROM p JOIN x USING (doc_id, old_ord) JOIN y USING (doc_id, new_ord, c) GROUP BY ALL)
  SELECT doc_id, old_ord, new_ord, round(2.0 * coalesce(s, 0) / (length(old_line) + length(new_line)), 6) AS bound FROM p LEFT JOIN s USING (doc_id, old_ord, new_ord)""")  # fmt: skip
def character_bag_similarity(spark, sf_dir):
    found = paired.over_documents(line_sides(spark, sf_dir), ["doc_id"], paired.character_pairs(match.TOKEN_DOCUMENTS, 0.72), "old_ord long, new_ord long, shared long, total long")
    return found.select("doc_id", "old_ord", "new_ord", F.round(2.0 * F.col("shared") / F.col("total"), 6).alias("bound"))


@query("token_blocking_candidates", f"WITH {_SHARED} SELECT doc_id, old_ord, new_ord, shared FROM shared")
def token_blocking_candidates(spark, sf_dir):
    return match.shared_word_pairs(*revision_lines(spark, sf_dir), ["doc_id"], "ord", "line")


@query("jaccard_tokens", f"""WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents)
  SELECT a.doc_id, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))), 6) AS similarity FROM d a JOIN d b ON b.doc_id = a.doc_id + 1 WHERE len(list_distinct(list_concat(a.w, b.w))) > 0""")  # fmt: skip
def jaccard_tokens(spark, sf_dir):
    words = readers.table(spark, sf_dir, "documents").select("doc_id", T.meaningful_words(F.col("text")).alias("a"))
    both = words.join(words.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b")), "doc_id").filter((F.size("a") > 0) | (F.size("b") > 0))
    return both.select("doc_id", F.round(S.jaccard(F.col("a"), F.col("b")), 6).alias("similarity"))


@query("change_counts_rollup", f"""WITH {_BAGS}, k AS (SELECT source, 'added' AS kind, greatest(new_n - old_n, 0) AS n FROM bag UNION ALL SELECT source, 'deleted', greatest(old_n - new_n, 0) FROM bag UNION ALL SELECT source, 'kept', least(old_n, new_n) FROM bag)
  SELECT source, kind, sum(n)::BIGINT AS n FROM k GROUP BY ROLLUP (source, kind)""")  # fmt: skip
def change_counts_rollup(spark, sf_dir):
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("n")) for k, c in (("added", "only_new"), ("deleted", "only_old"), ("kept", "shared"))]))
    return line_bags(spark, sf_dir).select("source", kinds.alias("x")).select("source", "x.*").rollup("source", "kind").agg(F.sum("n").alias("n"))


_VERB = T.SENTENCE_VERB.replace("'", "''")
_PRIORITY = rf"CASE WHEN regexp_matches({{0}}, '[0-9]') THEN 4 WHEN regexp_matches(lower({{0}}), '{T.NAMED_NUMBER}') THEN 3 WHEN regexp_matches({{0}}, '{_VERB}') THEN 2 ELSE 1 END"
_CHANGED = f"""{_OCC}, ev AS (SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, coalesce(o.line, n.line) AS line, coalesce(o.ord, n.ord) AS pos, CASE WHEN o.line IS NULL THEN 2 ELSE 1 END AS r
  FROM o FULL JOIN n ON o.doc_id = n.doc_id AND o.line = n.line AND o.occ = n.occ WHERE o.line IS NULL OR n.line IS NULL)"""


def changed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = (ordered.occurrence(x, ["doc_id", "line"], ["ord"]) for x in revision_lines(spark, sf_dir))
    pairs = old.select("doc_id", "line", "occ", F.col("ord").alias("old_no")).join(new.select("doc_id", "line", "occ", F.col("ord").alias("new_no")), ["doc_id", "line", "occ"])
    as_units = lambda x: x.select("doc_id", F.col("ord").alias("unit_no"), F.col("line").alias("text"), F.col("line").alias("key"))
    return delta.unit_events(as_units(old), as_units(new), pairs, ["doc_id"]).filter("kind <> 'unchanged'")


@query("priority_topk_snippets", f"""WITH {_CHANGED}, r AS (SELECT *, {_PRIORITY.format('line')} AS p, row_number() OVER (PARTITION BY doc_id ORDER BY {_PRIORITY.format('line')} DESC, pos, r) AS place FROM ev)
  SELECT doc_id, line, p AS priority, pos FROM r WHERE place <= 3""")  # fmt: skip
def priority_topk_snippets(spark, sf_dir):
    top = delta.top_snippets(changed_lines(spark, sf_dir), ["doc_id"], 3).filter("shown")
    return top.select("doc_id", F.coalesce("old_text", "new_text").alias("line"), "priority", F.col("at.place").alias("pos"))


@query("omitted_counts", f"WITH {_CHANGED} SELECT doc_id, count(*) AS changed, greatest(count(*) - 3, 0) AS omitted FROM ev GROUP BY doc_id")
def omitted_counts(spark, sf_dir):
    return delta.top_snippets(changed_lines(spark, sf_dir), ["doc_id"], 3).groupBy("doc_id").agg(F.count(F.lit(1)).alias("changed"), F.max("omitted").alias("omitted"))


@query("duplicate_document_groups", f"""WITH d AS (SELECT doc_id, sha256(trim(regexp_replace(lower(text), '{_BLANK}', ' ', 'g'))) AS digest FROM documents)
  SELECT digest, min(doc_id) AS first_id, count(*) AS copies, sum(count(*) - 1) OVER ()::BIGINT AS surplus FROM d GROUP BY digest HAVING count(*) > 1""")  # fmt: skip
def duplicate_document_groups(spark, sf_dir):
    docs = readers.table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.collapsed(F.lower("text")).cast("binary"), 256).alias("digest"))
    groups = docs.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    return groups.join(F.broadcast(groups.agg(F.sum(F.col("copies") - 1).alias("surplus"))))  # one row


@query("repeated_line_furniture", f"""WITH {_LINES}, m AS (SELECT source, doc_id AS page_no, line, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS u, row_number() OVER (PARTITION BY doc_id ORDER BY ord DESC) AS d FROM old_lines)
  SELECT source, line, min(page_no) AS first_page, max(page_no) AS last_page, count(DISTINCT page_no) AS pages FROM m WHERE u <= 2 OR d <= 2 GROUP BY source, line HAVING count(DISTINCT page_no) >= 3""")  # fmt: skip
def repeated_line_furniture(spark, sf_dir):
    old, _ = revision_lines(spark, sf_dir)
    return segment.running_lines(old.withColumnRenamed("doc_id", "page_no"), ["source"], order="ord")


@query("longest_consecutive_run", """WITH d AS (SELECT lang, doc_id, doc_id - row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS i FROM documents),
  r AS (SELECT lang, min(doc_id) AS first, max(doc_id) AS last, count(*) AS length FROM d GROUP BY lang, i)
  SELECT lang, first, last, length FROM r QUALIFY row_number() OVER (PARTITION BY lang ORDER BY length DESC, first) = 1""")  # fmt: skip
def longest_consecutive_run(spark, sf_dir):
    return ordered.longest_run(readers.table(spark, sf_dir, "documents"), ["lang"], "doc_id")


_ITEMS = """i AS (SELECT l_returnflag, l_orderkey || '-' || l_linenumber AS identity, l_shipdate, l_orderkey, l_quantity::BIGINT AS q, l_partkey AS p, l_suppkey AS s,
  row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS row_no FROM lineitem),
a AS (SELECT l_returnflag, identity, row_no, [q::VARCHAR, p::VARCHAR] AS v FROM i WHERE l_shipdate < TIMESTAMP '1998-01-01'),
b AS (SELECT l_returnflag, identity, row_no, [(q + CASE WHEN l_orderkey % 10 = 0 THEN 1 ELSE 0 END)::VARCHAR, p::VARCHAR] AS v FROM i WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1999-01-01')"""


def item_snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    items = readers.table(spark, sf_dir, "lineitem")
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")

    def side(rows: DataFrame, quantity) -> DataFrame:
        out = rows.select("l_returnflag", F.concat_ws("-", "l_orderkey", "l_linenumber").alias("identity"), F.array(quantity.cast("long").cast("string"), F.col("l_partkey").cast("string")).alias("values"), order.alias("row_no"))
        return out.withColumn("display", F.array_join("values", "|"))

    old = side(items.filter(F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp")), F.col("l_quantity"))
    new = items.filter((F.col("l_shipdate") >= F.lit("1996-01-01").cast("timestamp")) & (F.col("l_shipdate") < F.lit("1999-01-01").cast("timestamp")))
    return old, side(new, F.col("l_quantity").cast("long") + F.when(F.col("l_orderkey") % 10 == 0, 1).otherwise(0))


@query("table_row_diff", f"""WITH {_ITEMS},
  ka AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag, identity, v ORDER BY row_no) AS n FROM a), kb AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag, identity, v ORDER BY row_no) AS n FROM b),
  eq AS (SELECT ka.l_returnflag, ka.identity, ka.v, ka.n FROM ka JOIN kb ON ka.l_returnflag = kb.l_returnflag AND ka.identity = kb.identity AND ka.v = kb.v AND ka.n = kb.n),
  ra AS (SELECT l_returnflag, identity, v, row_number() OVER (PARTITION BY l_returnflag, identity ORDER BY row_no) AS n FROM ka ANTI JOIN eq USING (l_returnflag, identity, v, n)),
  rb AS (SELECT l_returnflag, identity, v, row_number() OVER (PARTITION BY l_returnflag, identity ORDER BY row_no) AS n FROM kb ANTI JOIN eq USING (l_returnflag, identity, v, n)),
  d AS (SELECT l_returnflag, 'unchanged' AS kind FROM eq UNION ALL SELECT coalesce(ra.l_returnflag, rb.l_returnflag), CASE WHEN rb.v IS NULL THEN 'row_deleted' WHEN ra.v IS NULL THEN 'row_added' ELSE 'value_changed' END
    FROM ra FULL JOIN rb ON ra.l_returnflag = rb.l_returnflag AND ra.identity = rb.identity AND ra.n = rb.n)
  SELECT l_returnflag, kind, count(*) AS n FROM d GROUP BY ALL""")  # fmt: skip
def table_row_diff(spark, sf_dir):
    old, new = item_snapshots(spark, sf_dir)
    return tables.row_differences(old, new, ["l_returnflag"]).groupBy("l_returnflag", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("table_dice_similarity", f"""WITH {_ITEMS}, x AS (SELECT l_returnflag, identity, v, count(*) AS n FROM a GROUP BY ALL), y AS (SELECT l_returnflag, identity, v, count(*) AS m FROM b GROUP BY ALL)
  SELECT l_returnflag, round(2.0 * sum(least(coalesce(n, 0), coalesce(m, 0))) / (sum(coalesce(n, 0)) + sum(coalesce(m, 0))), 6) AS dice FROM x FULL JOIN y USING (l_returnflag, identity, v) GROUP BY l_returnflag""")  # fmt: skip
def table_dice_similarity(spark, sf_dir):
    old, new = item_snapshots(spark, sf_dir)
    return bags.dice_similarity(old, new, ["l_returnflag"], ["identity", "display"]).select("l_returnflag", F.round("dice", 6).alias("dice"))


@query("row_codec_round_trip", """SELECT p_partkey, ['name' , 'a=b|c'] AS labels, [p_name || '=|' || chr(92) || p_brand, p_type] AS parts FROM part""")
def row_codec_round_trip(spark, sf_dir):
    value = F.concat("p_name", F.lit("=|\\"), "p_brand")
    cells = F.array(F.struct(F.lit("name").alias("label"), value.alias("value")), F.struct(F.lit("a=b|c").alias("label"), F.col("p_type").alias("value")))
    back = readers.table(spark, sf_dir, "part").select("p_partkey", T.decoded_row(T.encoded_row(cells)).alias("c"))
    return back.select("p_partkey", F.col("c.label").alias("labels"), F.col("c.value").alias("parts"))


@query("quality_metrics", """SELECT source, count(*) AS pages, count(*) FILTER (trim(coalesce(text, '')) = '') AS empty_pages, sum(length(coalesce(text, '')))::BIGINT AS characters,
  sum(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\v\\f\\r]+')))::BIGINT AS words, min(doc_id) AS first_page, max(doc_id) AS last_page, max(doc_id) - min(doc_id) + 1 = count(*) AS consistent_window FROM documents GROUP BY source""".replace("\\\\", "\\"))  # fmt: skip
def quality_metrics(spark, sf_dir):
    pages = readers.table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "page_no")
    return quality.document_metrics(pages, ["source"]).select("source", "pages", "empty_pages", "characters", "words", "first_page", "last_page", "consistent_window")


@query("pair_assessment", f"""WITH {_LINES}, a AS (SELECT doc_id, sum(length(line)) AS c, count(*) AS p FROM old_lines GROUP BY doc_id), b AS (SELECT doc_id, sum(length(line)) AS c, count(*) AS p FROM new_lines GROUP BY doc_id)
  SELECT doc_id, CASE WHEN coalesce(a.c, 0) = 0 OR coalesce(b.c, 0) = 0 THEN 'indeterminate' WHEN a.c < 500 OR b.c < 500 OR (a.p >= 3 AND a.c / a.p < 200) OR (b.p >= 3 AND b.c / b.p < 200) THEN 'degraded' ELSE 'reliable' END AS state
  FROM a FULL JOIN b USING (doc_id)""")  # fmt: skip
def pair_assessment(spark, sf_dir):
    def metrics(rows: DataFrame) -> DataFrame:
        out = quality.document_metrics(rows.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")).alias("page_no"), F.col("line").alias("text")), ["doc_id"])
        zero = {c: F.lit(0) for c in ("fallback_sections", "unnumbered_sections", "duplicate_paths")}
        return out.withColumns(zero | {"sections": F.lit(2)})

    old, new = revision_lines(spark, sf_dir)
    return quality.pair_assessment(metrics(old), metrics(new), ["doc_id"]).select("doc_id", "state")


@query("fragmentation_flags", f"WITH {_LINES} SELECT doc_id, count(*) AS lines, round(avg(length(line)), 6) AS average, count(*) >= 40 AND (avg(length(line)) <= 4.0 OR avg(CASE WHEN length(line) = 1 THEN 1.0 ELSE 0.0 END) >= 0.5) AS fragmented FROM old_lines GROUP BY doc_id")
def fragmentation_flags(spark, sf_dir):
    old, _ = revision_lines(spark, sf_dir)
    return quality.fragmentation(old, ["doc_id"]).select("doc_id", "lines", F.round("average", 6).alias("average"), "fragmented")


@query("page_window_filter", "SELECT doc_id, length(text) AS characters FROM documents WHERE doc_id BETWEEN 10 AND 200")
def page_window_filter(spark, sf_dir):
    return quality.page_range(readers.table(spark, sf_dir, "documents"), 10, 200, page="doc_id").select("doc_id", F.length("text").cast("long").alias("characters"))


@query("route_classification", "SELECT CASE WHEN doc_id % 7 = 0 THEN 'ocr' WHEN doc_id % 11 = 0 THEN 'image_review' WHEN doc_id % 5 = 0 THEN 'layout_review' WHEN length(text) = 0 THEN 'empty' ELSE 'native_text' END AS route, count(*) AS pages, min(doc_id) AS first_page FROM documents GROUP BY route")
def route_classification(spark, sf_dir):
    docs = readers.table(spark, sf_dir, "documents")
    route = quality.page_route(F.col("doc_id") % 7 == 0, F.col("doc_id") % 11 == 0, F.col("doc_id") % 5 == 0, F.length("text"))
    return docs.groupBy(route.alias("route")).agg(F.count(F.lit(1)).alias("pages"), F.min("doc_id").alias("first_page"))


@query("number_token_extract", f"SELECT doc_id, len(n) AS numbers, list_aggregate(list_transform(n, lambda x: length(x)), 'sum')::BIGINT AS characters FROM (SELECT doc_id, regexp_extract_all(text, '{T.NUMBER}') AS n FROM documents) WHERE len(n) > 0")
def number_token_extract(spark, sf_dir):
    found = readers.table(spark, sf_dir, "documents").select("doc_id", T.number_tokens(F.col("text")).alias("n")).filter(F.size("n") > 0)
    return found.select("doc_id", F.size("n").cast("long").alias("numbers"), F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("characters"))


_EMAIL_SQL = T.EMAIL.replace("'", "''")


@query("email_neutralise", f"SELECT doc_id, sha256(regexp_replace(text, '{_EMAIL_SQL}', '[email]', 'g')) AS digest FROM documents WHERE regexp_matches(text, '{_EMAIL_SQL}')")
def email_neutralise(spark, sf_dir):
    docs = readers.table(spark, sf_dir, "documents").filter(F.col("text").rlike(T.EMAIL))
    return docs.select("doc_id", F.sha2(T.neutral_emails(F.col("text")).cast("binary"), 256).alias("digest"))


@query("span_ngrams", """WITH c AS (SELECT conv_id, turn, text AS key FROM conversations), s AS (
  SELECT conv_id, key AS t, 1 AS n FROM c UNION ALL SELECT a.conv_id, a.key || ' ' || b.key, 2 FROM c a JOIN c b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
  UNION ALL SELECT a.conv_id, a.key || ' ' || b.key || ' ' || d.key, 3 FROM c a JOIN c b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 JOIN c d ON a.conv_id = d.conv_id AND d.turn = a.turn + 2)
  SELECT conv_id, n, count(*) AS spans, sum(length(t))::BIGINT AS characters FROM s WHERE n = 1 OR length(t) >= 40 GROUP BY ALL""")  # fmt: skip
def span_ngrams(spark, sf_dir):
    turns = readers.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("key"))
    return segment.spans(turns, ["conv_id"], "turn", most=3).groupBy("conv_id", "n").agg(F.count(F.lit(1)).alias("spans"), F.sum(F.length("text")).alias("characters"))


@query("gold_precision_recall", """WITH x AS (SELECT quality = 1 AS y, n_chars > 1000 AS p FROM labels JOIN documents USING (doc_id)), c AS (
  SELECT count(*) FILTER (y AND p) AS tp, count(*) FILTER (NOT y AND p) AS fp, count(*) FILTER (y AND NOT p) AS fn, count(*) FILTER (NOT y AND NOT p) AS tn FROM x)
  SELECT *, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall FROM c""")  # fmt: skip
def gold_precision_recall(spark, sf_dir):
    rows = readers.table(spark, sf_dir, "labels").join(readers.table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    out = evaluate.binary_metrics(rows, F.col("quality") == 1, F.col("n_chars") > 1000)
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall")})


@query("distinct_source_pairs", """WITH d AS (SELECT doc_id, sha256(text) AS s FROM documents) SELECT least(a.s, b.s) AS a, greatest(a.s, b.s) AS b, count(*) AS n FROM d a JOIN d b ON b.doc_id = a.doc_id + 1 WHERE a.s <> b.s GROUP BY ALL""")
def distinct_source_pairs(spark, sf_dir):
    docs = readers.table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("old_sha"))
    return evaluate.distinct_source_pairs(docs.join(docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("old_sha").alias("new_sha")), "doc_id"))


@query("benchmark_location", """SELECT b.item_id, CASE WHEN count(d.doc_id) = 1 THEN min(d.doc_id) END AS page_no FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY b.item_id""")
def benchmark_location(spark, sf_dir):
    items = readers.table(spark, sf_dir, "benchmark").select(F.lit(0).alias("g"), F.col("item_id").alias("snippet_id"), "text")
    docs = readers.table(spark, sf_dir, "documents").select(F.lit(0).alias("g"), F.col("doc_id").alias("page_no"), "text")
    return delta.locate_snippets(items, docs, ["g"]).select(F.col("snippet_id").alias("item_id"), "page_no")


@query("recursive_parent_closure", """WITH RECURSIVE p AS (SELECT o_orderkey::VARCHAR AS k FROM orders),
  t AS (SELECT k FROM p WHERE length(k) = 1 UNION SELECT p.k FROM p JOIN t ON length(p.k) = length(t.k) + 1 AND left(p.k, length(t.k)) = t.k) SELECT k FROM t""")  # fmt: skip
def recursive_parent_closure(spark, sf_dir):
    keys = readers.table(spark, sf_dir, "orders").select(F.lit(0).alias("g"), F.split(F.col("o_orderkey").cast("string"), "").alias("old_path")).distinct()
    keys = keys.withColumn("old_path", F.filter("old_path", lambda x: x != "")).withColumn("new_path", F.col("old_path"))
    return match.trusted_parents(keys, ["g"]).select(F.array_join("old_path", "").alias("k"))


@query("heading_level_stack", """WITH h AS (SELECT page_id, generate_subscripts(x, 1) AS i, unnest(x) AS t FROM (SELECT page_id, regexp_extract_all(html, '(?i)<h[1-6]\\b') AS x FROM pages)),
  g AS (SELECT page_id, i, right(t, 1)::INT AS level FROM h) SELECT page_id, count(*) AS headings, max(level) AS deepest,
  sum(1 + (SELECT count(DISTINCT a.level) FROM g a WHERE a.page_id = g.page_id AND a.i < g.i AND a.level < g.level AND NOT EXISTS (SELECT 1 FROM g b WHERE b.page_id = a.page_id AND b.i > a.i AND b.i < g.i AND b.level <= a.level)))::BIGINT AS depth
  FROM g GROUP BY page_id""".replace("\\\\", "\\"))  # fmt: skip
def heading_level_stack(spark, sf_dir):
    found = F.regexp_extract_all("html", F.lit(r"(?i)<h([1-6])\b"), F.lit(1))
    rows = readers.table(spark, sf_dir, "pages").select("page_id", F.posexplode(found).alias("i", "l")).withColumn("level", F.col("l").cast("int"))
    path = segment.stack_path(["page_id"], ["i"], F.col("level"), F.col("l"), most=6)
    return rows.withColumn("path", path).groupBy("page_id").agg(F.count(F.lit(1)).alias("headings"), F.max("level").alias("deepest"), F.sum(F.size("path")).alias("depth"))


@query("html_table_rows", """SELECT p_partkey AS page_id, 0 AS table_no, trim(p_brand) AS caption, 'Name=' || p_name || ' | Limit=' || p_size AS display, lower(p_name) AS identity FROM part""")
def html_table_rows(spark, sf_dir):
    html = F.concat(F.lit("<p>x</p><TABLE class='t'><caption>"), "p_brand", F.lit("</caption><tr><th>Name<th/></th><th>Limit</th></tr>\n<tr><td>"), "p_name", F.lit("</td><td><b>"), F.col("p_size").cast("string"), F.lit("</b></td></tr></TABLE>"))
    pages = readers.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page_id"), F.replace(html, F.lit("<th/>"), F.lit("")).alias("html"))
    rows = tables.labelled_rows(tables.html_tables(pages), ["page_id", "table_no"])
    return rows.select("page_id", "table_no", "caption", tables.row_display(F.col("fields")).alias("display"), tables.row_identity(F.col("fields")).alias("identity"))


@query("intervals_merged", """WITH i AS (SELECT o_custkey, o_orderkey AS s, o_orderkey + 500 AS e FROM orders), m AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY o_custkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS f FROM i),
  g AS (SELECT *, sum(f) OVER (PARTITION BY o_custkey ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM m) SELECT o_custkey, min(s) AS s, max(e) AS e FROM g GROUP BY o_custkey, k""")  # fmt: skip
def intervals_merged(spark, sf_dir):
    spans = readers.table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("s"), (F.col("o_orderkey") + 500).alias("e"))
    return bags.intervals_merged(spans, ["o_custkey"], "s", "e")


@query("containment_bag", f"""WITH {_LINES}, o AS (SELECT doc_id, line, count(*) AS n FROM old_lines GROUP BY ALL), w AS (SELECT doc_id, line, count(*) AS m FROM new_lines GROUP BY ALL)
  SELECT doc_id FROM o LEFT JOIN w USING (doc_id, line) GROUP BY doc_id HAVING max(n - coalesce(m, 0)) <= 0""")  # fmt: skip
def containment_bag(spark, sf_dir):
    old, new = revision_lines(spark, sf_dir)
    return bags.contained(old.select("doc_id", "line"), new.select("doc_id", "line"), ["doc_id"], "line")


@query("streaming_window_counts", "SELECT time_bucket(INTERVAL 5 MINUTES, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def streaming_window_counts(spark, sf_dir):
    rows = readers.table(spark, sf_dir, "events")
    return streams.windowed_counts(rows).select(F.col("window.start").alias("window_start"), "event_type", "n")


_PARTS = """p AS (SELECT p_brand, p_partkey AS k, p_name || ' ' || p_partkey AS name, p_size FROM part),
o AS (SELECT p_brand, k, lower(name) AS identity, p_size AS v FROM p WHERE k % 11 <> 0), n AS (SELECT p_brand, k, lower(name) AS identity, CASE WHEN k % 10 = 0 THEN p_size + 100 ELSE p_size END AS v FROM p WHERE k % 7 <> 0)"""


def part_pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Lines of two revisions of a catalogue: a captioned table for each brand, two pages each; the new one lacks some rows,
    has some more, and other sizes."""
    part = readers.table(spark, sf_dir, "part").select("p_brand", F.col("p_partkey").alias("k"), F.concat_ws(" ", "p_name", "p_partkey").alias("name"), "p_size")

    def lines(rows: DataFrame, size) -> DataFrame:
        n = F.row_number().over(Window.partitionBy("p_brand").orderBy("k"))
        body = rows.select("p_brand", (n % 2 + 1).alias("page_no"), (F.col("k") + 2).alias("line_no"), F.concat_ws(" | ", "name", size.cast("string")).alias("line"))
        brands = rows.select("p_brand").distinct()
        at = lambda page, n, text: F.struct(F.lit(page).alias("page_no"), F.lit(n).alias("line_no"), text.alias("line"))
        head = brands.select("p_brand", F.explode(F.array(at(1, 0, F.concat(F.lit("Table 1 Sizes of "), "p_brand")), at(1, 1, F.lit("Name | Size")), at(2, 1, F.lit("Name | Size")))).alias("x"))
        return head.select("p_brand", "x.*").unionByName(body)

    return lines(part.filter("k % 11 <> 0"), F.col("p_size")), lines(part.filter("k % 7 <> 0"), F.when(F.col("k") % 10 == 0, F.col("p_size") + 100).otherwise(F.col("p_size")))


def part_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    old, new = part_pages(spark, sf_dir)
    return tables.compare_tables(tables.captioned_tables(old, ["p_brand"]), tables.captioned_tables(new, ["p_brand"]), ["p_brand"])


@query("table_changes", f"""WITH {_PARTS}, x AS (SELECT coalesce(o.p_brand, n.p_brand) AS p_brand, o.v IS DISTINCT FROM n.v AS c FROM o FULL JOIN n USING (p_brand, identity))
  SELECT p_brand, 'same_caption' AS basis, CASE WHEN sum(c::INT) > 0 THEN 'modified' ELSE 'unchanged' END AS change_type, sum(c::INT)::BIGINT AS changed_rows FROM x GROUP BY p_brand""")  # fmt: skip
def table_changes(spark, sf_dir):
    return part_tables(spark, sf_dir)[0].select("p_brand", "basis", "change_type", "changed_rows")


@query("table_row_kinds", f"""WITH {_PARTS} SELECT coalesce(o.p_brand, n.p_brand) AS p_brand, identity, CASE WHEN n.v IS NULL THEN 'row_deleted' WHEN o.v IS NULL THEN 'row_added' WHEN o.v = n.v THEN 'unchanged' ELSE 'value_changed' END AS kind
  FROM o FULL JOIN n USING (p_brand, identity)""")  # fmt: skip
def table_row_kinds(spark, sf_dir):
    return part_tables(spark, sf_dir)[1].select("p_brand", "identity", "kind")


_PLACES = f"""{_LINES}, w AS (SELECT doc_id, k, (k // 3 + 1)::INT AS page_no FROM norm WHERE line <> ''), pg AS (SELECT doc_id, count(DISTINCT page_no) AS n FROM w GROUP BY doc_id)"""


def word_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents with places, three lines to a page: page numbers outside (every third document), line numbers in
    the gutter (every fourth), a slanted mark over the first page (every fifth)."""
    rows = segment.lines(readers.table(spark, sf_dir, "documents").select("doc_id", "text"))
    rows = rows.select("doc_id", F.col("line_no").alias("k"), (F.floor(F.col("line_no") / 3) + 1).cast("int").alias("page_no"), "line")
    box = lambda text, x0, top, size=10.0, angle=0.0: F.struct(text.alias("text"), x0.cast("double").alias("x0"), top.cast("double").alias("top"), (x0 + size * 3).cast("double").alias("x1"), (top + size).cast("double").alias("bottom"), F.lit(size).alias("size"), F.lit(angle).alias("angle"))
    line = 100 + 20 * (F.col("k") % 3)
    body = rows.select("doc_id", "page_no", "k", F.posexplode(F.split("line", " ")).alias("j", "word"))
    body = body.select("doc_id", "page_no", box(F.col("word"), 80 + 40 * (F.col("j") % 11), line + 60 * (F.floor(F.col("j") / 11) % 8)).alias("b"))
    numbers = rows.filter("doc_id % 4 = 0").select("doc_id", "page_no", box((F.col("k") % 3 + 1).cast("string"), F.lit(20), line).alias("b"))
    pages = rows.select("doc_id", "page_no").distinct()
    folios = pages.filter("doc_id % 3 = 0").select("doc_id", "page_no", box((F.col("page_no") + 4).cast("string"), F.when(F.col("page_no") % 2 == 1, 500).otherwise(50), F.lit(770)).alias("b"))
    marks = pages.filter("doc_id % 5 = 0 and page_no = 1").select("doc_id", "page_no", F.explode(F.array(box(F.lit("NOT"), F.lit(100), F.lit(500), 60.0, 45.0), box(F.lit("FINAL"), F.lit(300), F.lit(300), 60.0, 45.0))).alias("b"))
    words = body.unionByName(numbers).unionByName(folios).unionByName(marks).select("doc_id", "page_no", "b.*")
    return words.withColumns({"page_width": F.lit(600.0), "page_height": F.lit(800.0)})


@query("folio_runs", f"""WITH {_PLACES}, r AS (SELECT doc_id, page_no, page_no - row_number() OVER (PARTITION BY doc_id ORDER BY page_no) AS i FROM (SELECT DISTINCT doc_id, page_no FROM w)),
  l AS (SELECT doc_id, min(page_no) AS first_page, max(page_no) AS last_page, count(*) AS n FROM r GROUP BY doc_id, i QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(page_no) DESC) = 1)
  SELECT doc_id, 4 AS "offset", first_page, last_page, pg.n AS pages, 'alternating' AS side_rule FROM pg JOIN l USING (doc_id) WHERE doc_id % 3 = 0 AND pg.n >= 3 AND l.n >= 3""")  # fmt: skip
def folio_runs(spark, sf_dir):
    return geometry.folio_runs(word_places(spark, sf_dir), ["doc_id"])


@query("line_number_gutters", f"""WITH {_PLACES}, f AS (SELECT doc_id, page_no FROM w WHERE doc_id % 4 = 0 GROUP BY ALL HAVING count(*) = 3)
  SELECT doc_id, 8 AS "column", count(*) AS pages, 3 * count(*)::BIGINT AS numbers FROM f JOIN pg USING (doc_id) GROUP BY doc_id, n HAVING count(*) >= 3 AND count(*) >= 0.8 * n""")  # fmt: skip
def line_number_gutters(spark, sf_dir):
    return geometry.line_number_gutters(word_places(spark, sf_dir), ["doc_id"])


@query("watermark_groups", f"""WITH {_PLACES} SELECT doc_id, 1 AS page_no, 45 AS angle, 'NOT FINAL' AS text, 2::BIGINT AS words FROM w WHERE doc_id % 5 = 0 AND page_no = 1
  AND doc_id IN (SELECT doc_id FROM norm WHERE line <> '' AND k < 3 GROUP BY doc_id HAVING sum(len(string_split(line, ' '))) + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN doc_id % 4 = 0 THEN count(*) ELSE 0 END >= 2) GROUP BY doc_id""")  # fmt: skip
def watermark_groups(spark, sf_dir):
    return geometry.watermarks(word_places(spark, sf_dir), ["doc_id", "page_no"])


@query("visual_noise_lines", f"WITH {_LINES} SELECT doc_id, count(*) AS noise FROM old_lines WHERE regexp_matches(line, '{geometry.NOISE}') GROUP BY doc_id")
def visual_noise_lines(spark, sf_dir):
    old, _ = revision_lines(spark, sf_dir)
    return old.filter(geometry.visual_noise(F.col("line"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("noise"))


@query("image_coverage", """WITH b AS (SELECT o_custkey, o_orderkey % 10 AS x, o_orderkey % 7 AS y FROM orders), c AS (SELECT DISTINCT o_custkey, i, j FROM b, range(3) r(i0), range(2) s(j0), LATERAL (SELECT x + i0 AS i, y + j0 AS j) WHERE x + i0 < 10 AND y + j0 < 8)
  SELECT o_custkey, round(count(*) / 80.0, 6) AS covered FROM c GROUP BY o_custkey""")  # fmt: skip
def image_coverage(spark, sf_dir):
    x, y = F.col("o_orderkey") % 10, F.col("o_orderkey") % 7
    boxes = readers.table(spark, sf_dir, "orders").select("o_custkey", x.cast("double").alias("x0"), (x + 3).cast("double").alias("x1"), y.cast("double").alias("top"), (y + 2).cast("double").alias("bottom"), F.lit(10.0).alias("page_width"), F.lit(8.0).alias("page_height"))
    return geometry.covered_share(boxes, ["o_custkey"]).select("o_custkey", F.round("covered", 6).alias("covered"))


@query("reordered_texts", """WITH a AS (SELECT p_partkey, p_name AS o, list_aggregate(list_reverse(string_split(p_name, ' ')), 'string_agg', ' ') AS n FROM part) SELECT p_partkey FROM a WHERE o <> n""")
def reordered_texts(spark, sf_dir):
    rows = readers.table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("o"), F.array_join(F.reverse(F.split("p_name", " ")), " ").alias("n"))
    return rows.filter(delta.reorder_only(F.col("o"), F.col("n"))).select("p_partkey")


_CLAUSES = """c AS (SELECT n_regionkey AS r, n_name AS title, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS n FROM nation UNION ALL SELECT r_regionkey, r_name, 0 FROM region),
  s AS (SELECT *, row_number() OVER (ORDER BY r, n) - 1 AS ord FROM c)"""


@query("rescued_sections", f"""WITH {_CLAUSES} SELECT ord AS old_ord, ord AS new_ord, CASE WHEN n = 4 THEN 'mapped_parent_child' ELSE 'numbering_shift' END AS basis FROM s WHERE n > 2""")
def rescued_sections(spark, sf_dir):
    """Regions as clauses and nations as theirs; the new side numbers regions one higher, their nations one higher too, but the
    fourth five higher. Regions and their first two nations are matched; the others are to be found."""
    nation, region = readers.table(spark, sf_dir, "nation"), readers.table(spark, sf_dir, "region")
    rank = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey"))
    clauses = nation.select(F.col("n_regionkey").alias("r"), F.col("n_name").alias("title"), rank.alias("n")).unionByName(region.select(F.col("r_regionkey").alias("r"), F.col("r_name").alias("title"), F.lit(0).alias("n")))
    clauses = clauses.withColumn("ord", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("r", "n")) - 1).cast("long"))  # 30 rows

    def side(first: int, moved) -> DataFrame:
        path = F.when(F.col("n") == 0, F.array((F.col("r") + first).cast("string"))).otherwise(F.array((F.col("r") + first).cast("string"), moved.cast("string")))
        told = clauses.select(F.lit(0).alias("g"), "ord", path.alias("number_path"), "title", F.when(F.col("n") == 0, 1).otherwise(2).alias("level"), F.lower("title").alias("body"), F.array("title").alias("heading_path"))
        return told.withColumn("identity_key", F.concat_ws("/", "number_path"))

    held = clauses.filter("n <= 2").select(F.lit(0).alias("g"), F.col("ord").alias("old_ord"), F.col("ord").alias("new_ord"))
    found = match.rescued(side(1, F.col("n")), side(2, F.col("n") + F.when(F.col("n") == 4, 5).otherwise(1)), held, ["g"])
    return found.select("old_ord", "new_ord", "basis")


@query("evidence_conservation", f"""WITH {_LINES} SELECT doc_id, sum(o)::BIGINT AS old_units, sum(n)::BIGINT AS new_units, sum(o) + sum(n) = sum(o + n) AS once FROM (SELECT doc_id, 1 AS o, 0 AS n FROM old_lines UNION ALL SELECT doc_id, 0, 1 FROM new_lines) GROUP BY doc_id""")
def evidence_conservation(spark, sf_dir):
    """Whatever the alignment finds, each occurrence is in exactly one relation."""
    return evidence.conservation(*evidence_units(spark, sf_dir), ["doc_id"])


# --- what SQL can't express


def unit_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    old, new = revision_lines(spark, sf_dir)
    units = lambda x: segment.units(x.withColumnRenamed("line", "text"), ["doc_id"], ["ord"])
    return units(old), units(new)


@query("review_unit_key")
def review_unit_key(spark, sf_dir):
    return unit_sides(spark, sf_dir)[0].select("doc_id", "unit_no", "key", "occ")


@query("exact_ratio")
def exact_ratio(spark, sf_dir):
    return paired.over_documents(line_sides(spark, sf_dir), ["doc_id"], paired.ratio_pairs(0.72), "old_ord long, new_ord long, ratio double")


@query("unit_pairs")
def unit_pairs(spark, sf_dir):
    return match.pair_units(*unit_sides(spark, sf_dir), ["doc_id"])


@query("ordered_occurrences")
def ordered_occurrences(spark, sf_dir):
    return match.ordered_occurrences(*unit_sides(spark, sf_dir), ["doc_id"]).groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("monotonic_assignment")
def monotonic_assignment(spark, sf_dir):
    def work(*columns: list) -> Iterator[tuple]:
        return match.assigned(((*x, "similarity_fallback") for x in pairs(*columns)), [], match.SECTION)

    pairs = paired.length_pairs(match.TOKEN_DOCUMENTS)
    return paired.over_documents(line_sides(spark, sf_dir), ["doc_id"], work, match.MATCH)


def evidence_units(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    old, new = revision_lines(spark, sf_dir)
    docs = lambda x, side: x.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")) - 1).select(
        "doc_id", F.col("_n").alias("ord"), F.concat_ws(":", F.lit(side), "doc_id", "_n").alias("occurrence_id"), F.col("line").alias("text"), F.lit("body").alias("role"), F.array().cast("array<string>").alias("risks")
    )
    return docs(old, "old"), docs(new, "new")


def evidence_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.align_evidence(*evidence_units(spark, sf_dir), ["doc_id"])


@query("evidence_alignment")
def evidence_alignment(spark, sf_dir):
    return evidence_relations(spark, sf_dir)


def revision_pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Pages of 40 lines with a numbered heading before every tenth line."""

    def pages(rows: DataFrame) -> DataFrame:
        n = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord"))
        told = rows.withColumn("_n", n - 1)
        text = F.when(F.col("_n") % 10 == 0, F.concat((F.floor(F.col("_n") / 10) + 1).cast("string"), F.lit(" Part "), F.initcap(F.regexp_extract("line", r"(\p{L}+)", 1)), F.lit("\n"), F.col("line"))).otherwise(F.col("line"))
        told = told.withColumn("line", text).withColumn("page_no", (F.floor(F.col("_n") / 40) + 1).cast("int"))
        return told.groupBy("doc_id", "page_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "line"))), lambda x: x["line"]), "\n").alias("text"))

    return tuple(map(pages, revision_lines(spark, sf_dir)))


@query("section_changes")
def section_changes(spark, sf_dir):
    old, new = revision_pages(spark, sf_dir)
    return compare.compare(old, new, ["doc_id"], Options(include_unchanged=True)).changes.drop("old_body", "new_body")


@query("inline_diff_spans")
def inline_diff_spans(spark, sf_dir):
    best = paired.over_documents(line_sides(spark, sf_dir), ["doc_id"], paired.best_changed_lines(match.TOKEN_DOCUMENTS), "old_ord long, new_ord long, old_line string, new_line string")
    return best.select("doc_id", "old_ord", "new_ord", delta.inline_marks_udf("old_line", "new_line").alias("marks"))
