"""Nearest neighbours by additive quantisation.

A vector is approximated by a sum of one codeword from each of ``BOOKS`` codebooks, each codeword as long as the vector. The
codebooks are fitted on a bounded sample: k-means on residuals, book after book. Every vector is encoded by beam search, and its norm is stored beside its code. A query
is scored against codes through a table of its products with all codewords, scaled by the stored norm; the best
``KEPT`` are scored exactly on the original vectors.

The query set is searched against all vectors in blocks: each block of vectors meets each block of queries once, by an
equi-join on the query block's number, and a task keeps the best of its group of vector blocks. A block of queries is as
large as memory lets it be, and only as much smaller as it takes to have ``SPREAD`` of them, so codes
are copied that often until there are more queries than as many full blocks hold. Equal vectors are indexed once, so that a vector with very many copies neither
fills the candidates nor makes a hot key; only as many of its ids as an answer can hold are kept beside it.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from variorum.llm._shared import hash_sample, join_unique, materialize

#: Codebooks, codewords of each, beam of the encoder, vectors that the index is fitted on.
BOOKS, WORDS, BEAM, SAMPLE, SEED = 32, 256, 4, 16_384, 8
#: Candidates that are scored exactly, neighbours of a query, vectors of a block, blocks of a group, each how manieth row is a query.
KEPT, NEIGHBOURS, BLOCK, GROUP, EVERY = 200, 20, 8192, 64, 20
#: Queries of a block at most, blocks of queries that there are at least, if they hold ``AT_ONCE``; queries scored at once.
QUERIES, SPREAD, AT_ONCE = 4096, 16, 128


class Quantizer:
    def __init__(self, books: np.ndarray) -> None:
        self.books = books.astype(np.float32)  # book, word, dimension
        self.norms = (self.books * self.books).sum(axis=2)

    @staticmethod
    def fit(x: np.ndarray, books: int = BOOKS, words: int = WORDS, seed: int = SEED) -> Quantizer:
        r = np.random.default_rng(seed)
        x = x.astype(np.float32)
        words = max(1, min(words, len(x) // 4))
        rest, out = x.copy(), []
        for _ in range(books):
            centre = rest[r.permutation(len(rest))[:words]]
            for _ in range(8):
                near = (rest @ centre.T - (centre * centre).sum(axis=1) / 2).argmax(axis=1)
                size = np.bincount(near, minlength=words)
                sums = np.stack([np.bincount(near, rest[:, j], words) for j in range(x.shape[1])], axis=1)
                centre = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], rest[r.integers(0, len(rest), words)]).astype(np.float32)
            near = (rest @ centre.T - (centre * centre).sum(axis=1) / 2).argmax(axis=1)
            rest -= centre[near]
            out.append(centre)
        return Quantizer(np.stack(out))

    def encode(self, x: np.ndarray, beam: int = BEAM, block: int = 1024) -> np.ndarray:
        """The code of the least error that a beam search over the books finds."""
        m, k, d = self.books.shape
        out = np.zeros((len(x), m), np.int64)
        for at in range(0, len(x), block):
            part = x[at : at + block].astype(np.float32)
            n = len(part)
            rest, error = part[:, None, :], np.zeros((n, 1), np.float32)
            codes = np.zeros((n, 1, 0), np.int64)
            for b in range(m):
                dot = (rest.reshape(-1, d) @ self.books[b].T).reshape(n, -1, k)
                new = (error[:, :, None] + self.norms[b] - 2 * dot).reshape(n, -1)
                width = min(beam, new.shape[1])
                best = np.argpartition(new, width - 1, axis=1)[:, :width]
                error = np.take_along_axis(new, best, axis=1)
                parent, word = best // k, best % k
                rest = np.take_along_axis(rest, parent[:, :, None], axis=1) - self.books[b][word]
                codes = np.concatenate([np.take_along_axis(codes, parent[:, :, None], axis=1), word[:, :, None]], axis=2)
            out[at : at + n] = np.take_along_axis(codes, error.argmin(axis=1)[:, None, None], axis=1)[:, 0]
        return out

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.books[b, codes[:, b]] for b in range(len(self.books)))

    def table(self, queries: np.ndarray) -> np.ndarray:
        """Products of each codeword with each query: book, word, query."""
        return self.books @ queries.astype(np.float32).T


def best_of(scores: np.ndarray, kept: int) -> Iterator[np.ndarray]:
    """Columns of the largest scores of each row; of equal ones, the first."""
    n = scores.shape[1]
    if n <= kept:
        for _ in scores:
            yield np.arange(n)
        return
    least = np.partition(scores, n - kept, axis=1)[:, n - kept]
    for row, bound in zip(scores, least):
        above = np.flatnonzero(row > bound)
        yield np.concatenate([above, np.flatnonzero(row == bound)[: kept - len(above)]])


def usable(embedding: Column) -> Column:
    """Not null, without null or non-finite components, not zero."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return embedding.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(embedding, lambda x: x != 0)


def _blocks(rows: DataFrame, n: int, size: int, label: str, columns: dict[str, str]) -> tuple[DataFrame, int]:
    """Rows of (block, count, one binary for each column), each of about ``size`` rows."""
    count = max(1, -(-n // size))

    def pack_rows(table: pa.Table) -> pa.Table:
        table = table.sort_by("rep")
        out = {label: [table.column(label)[0].as_py()]}
        for name, kind in columns.items():
            values = table.column(name).combine_chunks()
            raw = b"".join(values.to_pylist()) if kind == "raw" else np.asarray(values, kind).tobytes()
            out[name] = [raw]
        return pa.table({k: pa.array(v, pa.int32() if k == label else pa.binary()) for k, v in out.items()})

    dealt = rows.withColumn(label, F.pmod(F.xxhash64(F.lit(label), "rep"), F.lit(count)).cast("int"))
    return dealt.groupBy(label).applyInArrow(pack_rows, f"{label} int, " + ", ".join(f"{c} binary" for c in columns)), count


def nearest(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", every: int = EVERY, neighbours: int = NEIGHBOURS, kept: int = KEPT) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest by inner product of each row whose id is divisible by ``every``.

    Candidates are all rows but the query's own; equal scores go to the smaller id. Vectors that are null, zero, hold null or
    non-finite components, have a null id, or another length than most (no inner product) take no part. Vectors of float
    or double are told apart and scored as they are; only the index holds them as float. Of rows that repeat an id
    each is a row of its own, but none is a neighbour of its own id. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    kind = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("embedding")).filter(F.col("vec_id").isNotNull())
    rows = rows.filter(usable(F.col("embedding")))
    length = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if length is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.filter(F.size("embedding") == length["n"]).withColumn("h1", F.xxhash64("embedding")).withColumn("h2", F.xxhash64(F.lit(1), F.reverse("embedding")))
    rows = materialize(rows, "vectors")
    # 128 bits of hash tell vectors apart
    distinct = rows.groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.min_by("embedding", "vec_id").alias("embedding"))
    distinct = materialize(distinct, "distinct")
    n = distinct.count()
    place = Window.partitionBy("h1", "h2").orderBy("vec_id")
    members = rows.select("vec_id", "h1", "h2").withColumn("place", F.row_number().over(place)).filter(F.col("place") <= neighbours + 1)
    members = materialize(members.join(distinct.select("h1", "h2", "rep"), ["h1", "h2"]).select("rep", "vec_id"), "members")
    asked = rows.filter(F.col("vec_id") % every == 0).select("vec_id", "h1", "h2")
    queries = asked.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("copies")).join(distinct, ["h1", "h2"])
    queries = materialize(queries, "queries")

    sample = hash_sample(distinct.select("rep", "embedding"), ["rep"], n, SAMPLE)
    index = Quantizer.fit(np.array([r["embedding"] for r in sorted(sample, key=lambda r: r["rep"])], np.float32))
    shared = spark.sparkContext.broadcast(pickle.dumps(index))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = pickle.loads(shared.value)
        for batch in batches:
            x = np.asarray(batch.column("embedding").flatten(), np.float32).reshape(batch.num_rows, -1)
            codes = index.encode(x)
            stored = np.linalg.norm(x, axis=1) / np.maximum(np.linalg.norm(index.decode(codes), axis=1), 1e-30)
            raw = [row.tobytes() for row in codes.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(raw, pa.binary()), pa.array(stored.astype(np.float32))], names=["rep", "code", "norm"])

    coded = distinct.select("rep", "embedding").mapInArrow(encode, "rep long, code binary, norm float")
    vector_blocks, _ = _blocks(coded, n, BLOCK, "vector_block", {"rep": "<i8", "code": "raw", "norm": "<f4"})
    wide = queries.select("rep", F.col("embedding"))

    def flatten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column("embedding").flatten(), np.float32).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array([row.tobytes() for row in x], pa.binary())], names=["rep", "vector"])

    asking = queries.count()
    size = max(AT_ONCE, min(QUERIES, -(-asking // SPREAD)))
    query_blocks, count = _blocks(wide.mapInArrow(flatten, "rep long, vector binary"), asking, size, "query_block", {"rep": "<i8", "vector": "raw"})
    query_blocks = materialize(query_blocks.select("query_block", F.col("rep").alias("query_reps"), "vector"), "query-blocks")
    grouped = materialize(vector_blocks, "vector-blocks").withColumn("vector_group", F.floor(F.col("vector_block") / GROUP).cast("int"))
    meetings = grouped.withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).join(query_blocks, "query_block")

    def search(table: pa.Table) -> pa.Table:
        index = pickle.loads(shared.value)
        blocks = [(np.frombuffer(r, "<i8"), np.frombuffer(c, np.uint8), np.frombuffer(n, "<f4")) for r, c, n in zip(*(table.column(k).to_pylist() for k in ("rep", "code", "norm")))]
        asked = np.frombuffer(table.column("query_reps")[0].as_py(), "<i8")
        q = np.frombuffer(table.column("vector")[0].as_py(), "<f4").reshape(len(asked), -1)
        who, ids, near = [], [], []
        for at in range(0, len(asked), AT_ONCE):
            part = asked[at : at + AT_ONCE]
            products = index.table(q[at : at + AT_ONCE])
            found: list[list] = [[] for _ in part]
            for reps, codes, norm in blocks:
                codes = codes.reshape(len(reps), -1)
                scores = np.zeros((len(reps), len(part)), np.float32)
                for b in range(len(products)):
                    scores += products[b][codes[:, b]]
                scores = np.ascontiguousarray((scores * norm[:, None]).T)
                for k, p in enumerate(best_of(scores, kept)):
                    found[k].append((reps[p], scores[k, p]))
            for k, parts in enumerate(found):
                r, s = np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])
                p = np.lexsort((r, -s))[:kept]
                who.append(np.full(len(p), part[k]))
                ids.append(r[p])
                near.append(s[p])
        return pa.table({"query": np.concatenate(who), "rep": np.concatenate(ids), "near": np.concatenate(near)})

    found = meetings.groupBy("query_block", "vector_group").applyInArrow(search, "query long, rep long, near float")
    nearest_first = Window.partitionBy("query").orderBy(F.desc("near"), "rep")
    found = found.withColumn("place", F.row_number().over(nearest_first)).filter(F.col("place") <= kept).select("query", "rep")
    exact = F.aggregate(F.zip_with("q", "embedding", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, b: a + b)
    scored = found.join(distinct.select("rep", "embedding"), "rep").join(queries.select(F.col("rep").alias("query"), F.col("embedding").alias("q")), "query")
    scored = scored.select("query", "rep", exact.alias("score")).join(members, "rep")
    final = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    lists = scored.withColumn("place", F.row_number().over(final)).filter(F.col("place") <= neighbours + 1)
    lists = lists.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score"))).alias("list"))
    lists = materialize(lists.join(queries.select(F.col("rep").alias("query"), "h1", "h2", "copies"), "query").select(F.struct("h1", "h2").alias("key"), "copies", "list"), "lists")
    answers = join_unique(asked.select("vec_id", F.struct("h1", "h2").alias("key")), lists, "key", "copies").withColumnRenamed("vec_id", "query_id")
    others = F.slice(F.filter("list", lambda x: x["vec_id"] != F.col("query_id")), 1, neighbours)
    out = answers.select("query_id", F.posexplode(others).alias("pos", "x"))
    return out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
