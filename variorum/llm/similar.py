"""The pipeline's near duplicates: SimHash links, and with them all texts of Jaccard similarity 0.8 or more.

At similarity 0.8 two 64-bit fingerprints differ in about ten bits, and balls that meet that far apart would have
hundreds of millions of variants. So fingerprints within four bits are linked as ``simhash`` does it, and what they miss is
found exactly, on sets of shingle hashes:

1. Of each text's shingles the first by hash are kept, enough that two similar texts share at least ``SHARE`` of one's
   shingles there (a prefix filter). A text with fewer shingles there that some text of another component has is done
   with; that is nearly every text.
2. The rest give all their shingles, which are counted among the rest. A text most of whose shingles no other has is done
   with too. Of the others the rarest shingles are kept, as many as two similar texts can't but share one of.
3. Texts that meet there are compared. First each with the pivot of the shingle where it meets others, the text with the
   fewest shingles of its own, so that a group of near copies is joined by about as many comparisons as it has texts. Then all
   that meet, still have different roots, and can be alike: what follows the first shingle that both have must be enough, and
   two texts differ at least by what each has of its own and by the difference of what they lack of one pivot. Those
   pairs are counted in full.

Nothing is capped or sampled; orders and counts only decide which texts meet.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from variorum.llm._shared import join_unique, keep_listed, materialize, slices, text_keys, tidy
from variorum.llm.components import components
from variorum.llm.simhash import RADIUS, STAGE_SIMILARITY, STAGE_WORDS, _majority, ball_links, shingle_hashes

#: What two similar texts share of one's shingles among those kept first.
SHARE = 0.1


def _least(n: np.ndarray, similarity: float) -> np.ndarray:
    """Of n shingles, how many a similar text has at least."""
    return np.ceil(similarity * n - 1e-9)


def shingle_sets(texts: DataFrame, words: int, similarity: float | None) -> DataFrame:
    """The columns of texts but text, with fp, n distinct shingles, and the hashes kept: the first, or all where similarity is None."""
    names = [c for c in texts.columns if c != "text"]
    schema = pa.schema([*((c, pa.int64()) for c in [*names, "fp", "n"]), ("hashes", pa.list_(pa.int64()))])

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            fps, sizes, taken = [], [], []
            for text in batch.column("text").to_pylist():
                blocks = list(shingle_hashes(text, words))
                fps.append(_majority(blocks))
                found = np.unique(np.concatenate(blocks)) if blocks else np.empty(0, np.uint64)
                sizes.append(len(found))
                if similarity is not None and len(found):
                    n = len(found)
                    found = found[: min(n, n - int(_least(n, similarity)) + math.ceil(SHARE * n))]
                taken.append(found.view(np.int64))
            hashes = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, taken)]), pa.int32()), pa.array(np.concatenate(taken)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), hashes], schema=schema)
            del batch, hashes, taken
        tidy()

    return texts.select(*names, "text").mapInArrow(compute, ", ".join(f"{c} long" for c in [*names, "fp", "n"]) + ", hashes array<long>")


def candidates(rows: DataFrame, docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """(num, fp, root, n, hashes, kept, shared, own): texts that may be similar to one of another root, all their hashes, the
    rarest of those that texts of other roots have, and the numbers of those and of what no other text has. rows: num, k1, k2, n and first hashes of each row."""
    least = lambda n: F.ceil(F.lit(similarity) * n - F.lit(1e-9))
    dealt = rows.select("num", "n", F.explode("hashes").alias("h"))
    met = dealt.groupBy("h").agg(F.min("num").alias("lo"), F.max("num").alias("hi")).filter("lo < hi").select("h")
    told = dealt.join(met, "h").groupBy("num", "n").agg(F.count(F.lit(1)).alias("c"))
    active = told.filter(F.col("c") >= F.ceil(F.lit(SHARE) * least(F.col("n")) - F.lit(1e-9))).select("num")
    active = rows.select("num", "k1", "k2", "fp").join(active, "num").groupBy("k1", "k2", "fp").agg(F.min("num").alias("num"), F.count(F.lit(1)).alias("copies"))
    active = materialize(active.select("num", "k1", "k2", F.col("fp").alias("root"), "copies"), "active")
    found = docs.select(*text_keys(F.col("text")), F.coalesce("text", F.lit("")).alias("text")).join(active, ["k1", "k2"])
    # a text that one row has needs no grouping
    one, more = found.filter("copies = 1"), found.filter("copies > 1").dropDuplicates(["num"])
    whole = materialize(shingle_sets(one.unionByName(more).select("num", "root", "text"), words, None), "sets")
    dealt = whole.select("num", "n", "root", F.explode("hashes").alias("h"))
    met = dealt.groupBy("h").agg(F.count(F.lit(1)).alias("df"), (F.min("root") < F.max("root")).alias("apart")).filter("df > 1")
    met = dealt.join(met, "h").groupBy("num", "n").agg(F.sort_array(F.collect_list(F.when(F.col("apart"), F.struct("df", "h")))).alias("known"), F.count(F.lit(1)).alias("c"))
    met = met.withColumn("spare", (F.size("known") - least(F.col("n")) + 1).cast("int")).filter("spare > 0")
    kept = F.transform(F.slice("known", 1, F.col("spare")), lambda x: x["h"])
    return materialize(whole.join(met.select("num", kept.alias("kept"), F.size("known").alias("shared"), (F.col("n") - F.col("c")).alias("own")), "num"), "candidates")


def overlaps(index: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (x, y) of numbers with n, root of both and the number o of shingles that both have."""
    sides = [index.select(F.col("num").alias(c), F.col("n").alias(f"n{c}"), F.col("root").alias(f"r{c}"), F.col("hashes").alias(f"h{c}")) for c in "xy"]
    both = pairs.join(sides[0], "x").join(sides[1], "y")
    return both.select("x", "y", "nx", "ny", "rx", "ry", F.size(F.array_intersect("hx", "hy")).alias("o"))


def similar_roots(index: DataFrame, linked: DataFrame, similarity: float) -> DataFrame:
    """(fp, root): fingerprints that links (a, b) and similar texts of ``candidates`` join, with the least of their component."""
    alike = F.col("o") >= (F.col("nx") + F.col("ny")) * F.lit(similarity / (1 + similarity)) - F.lit(1e-6)
    as_long = F.least("n", "m") >= F.greatest("n", "m") * F.lit(similarity) - F.lit(1e-6)

    def links(counted: DataFrame) -> DataFrame:
        return counted.filter(alike & (F.col("rx") != F.col("ry"))).select(F.col("rx").alias("a"), F.col("ry").alias("b")).distinct()

    # after: how many of a text's shared shingles come from this one on, in the order that all texts' are kept in
    met = index.select("num", "n", "root", "own", "shared", F.posexplode("kept").alias("at", "h")).withColumn("after", F.col("shared") - F.col("at")).drop("shared", "at")
    pivots = met.groupBy("h").agg(F.min(F.struct("own", "num", "n")).alias("p"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi")
    pivots = materialize(pivots.select("h", F.col("p.num").alias("pivot"), F.col("p.n").alias("m")), "pivots")
    star = met.join(pivots, "h").filter((F.col("num") != F.col("pivot")) & as_long).select(F.col("num").alias("x"), F.col("pivot").alias("y")).distinct()
    star = materialize(overlaps(index, star), "star")
    first = materialize(linked.unionByName(links(star)), "first-links")

    moved = components(first, "a", "b").select(F.col("node").alias("root"), F.col("root").alias("_least"))
    now = met.join(moved, "root", "left").withColumn("root", F.coalesce("_least", "root")).drop("_least")
    apart = now.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("h")
    lacks = star.select(F.col("x").alias("num"), F.col("y").alias("pivot"), (F.col("ny") - F.col("o")).alias("lacks"))
    live = now.join(apart, "h").join(pivots, "h").join(lacks, ["num", "pivot"], "left")
    at_pivot = F.col("num") == F.col("pivot")  # what the pivot has of its own is what others lack of it
    live = live.withColumns({"own": F.when(at_pivot, 0).otherwise(F.col("own")), "lacks": F.when(at_pivot, 0).otherwise(F.col("lacks"))})
    live = materialize(live.select("h", "num", "n", "root", "own", "lacks", "after"), "live")
    other = live.select("h", *[F.col(c).alias(d) for c, d in (("num", "y"), ("n", "m"), ("root", "other"), ("own", "others_own"), ("lacks", "others_lacks"), ("after", "others_after"))])
    differ = F.col("own") + F.col("others_own") + F.coalesce(F.abs(F.col("lacks") - F.col("others_lacks")), F.lit(0))
    near = differ <= (F.col("n") + F.col("m")) * F.lit((1 - similarity) / (1 + similarity)) + F.lit(1e-6)
    # at the first shingle that both have, all that they share is still to come
    enough = F.least("after", "others_after") >= (F.col("n") + F.col("m")) * F.lit(similarity / (1 + similarity)) - F.lit(1e-6)
    pairs = live.join(other, "h").filter((F.col("root") < F.col("other")) & as_long & enough & near).select(F.col("num").alias("x"), "y").distinct()
    found = materialize(first.unionByName(links(overlaps(index, materialize(pairs, "pairs")))), "links")
    return components(found, "a", "b").withColumnRenamed("node", "fp")


def near_components(docs: DataFrame, *, words: int = STAGE_WORDS, radius: int = RADIUS, similarity: float = STAGE_SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(doc_id, k1, k2, fp) of every row, and (fp, copies, root) of every distinct fingerprint, the least of its component."""
    text = F.coalesce("text", F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *text_keys(F.col("text")), text.alias("text"))
    rows = materialize(shingle_sets(texts, words, similarity).withColumn("num", F.monotonically_increasing_id()), "shingles")
    nodes = materialize(rows.groupBy("fp").agg(F.count(F.lit(1)).alias("copies")), "nodes")
    linked = materialize(ball_links(nodes.select("fp"), nodes.count(), radius=radius), "balls")
    roots = similar_roots(candidates(rows, docs, words, similarity), linked, similarity)
    rooted = materialize(nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "components")
    return rows.select("doc_id", "k1", "k2", "fp"), rooted


def drop_near_duplicates(docs: DataFrame, *, words: int = STAGE_WORDS, radius: int = RADIUS, similarity: float = STAGE_SIMILARITY) -> DataFrame:
    """docs with one row of each component; all columns as they were.

    Texts within 2 * radius bits or of Jaccard similarity ``similarity`` or more, on shingles of ``words`` words, are linked.
    The row of the smallest id stays, a null id last; of rows that share that id, the one whose text has the least hash,
    and one of those alike in both. Null, empty and blank texts have no shingle and are linked among themselves. Rows
    that share an id are judged by their texts. An empty table stays empty; no column name is taken.
    """
    rows, rooted = near_components(docs, words=words, radius=radius, similarity=similarity)
    placed = join_unique(rows, rooted, "fp", "copies")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "k1", "k2")
    first = materialize(placed.groupBy("root").agg(F.min(order).alias("w")).select("root", "w.doc_id", "w.k1", "w.k2"), "first")
    # how many rows are alike in id and text is asked of the rows that stay only
    alike = [rows[c].eqNullSafe(first[c]) for c in ("doc_id", "k1", "k2")]
    listed = rows.join(first, alike[0] & alike[1] & alike[2]).groupBy(first["doc_id"], first["k1"], first["k2"]).agg(F.count(F.lit(1)).alias("copies"))
    key = F.array(*[F.col(c).cast("string") for c in ("doc_id", "k1", "k2")])
    return keep_listed(docs, listed.select(key.alias("key"), "copies"), [docs["doc_id"].cast("long"), *text_keys(docs["text"])])
