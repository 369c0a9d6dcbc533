"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints that differ in at most 2r bits have a common variant within r bits of both, and any two that
share such a variant differ in at most 2r bits. So every fingerprint emits all variants within r = 2 bits (2081 of
them), variants are shuffled on, and fingerprints that meet in a variant are linked.

The shuffle deals variants by their leading ``prefix_bits`` bits. A fingerprint's variants fall into few such prefixes
(the prefixes within 2 bits of its own), so it is sent once to each of those with what flips are left, and its
variants with that prefix are written out after the shuffle, by the task that sorts them: the same 2081 variants meet
in the same places, but what crosses the network is tens of rows for a fingerprint, not 2081. The number of bits
follows the number of fingerprints, so a prefix holds a bounded number of variants. Within a prefix, fingerprints that
meet are joined into a local forest, so a task returns at most one link for each fingerprint it got, however large
a group of near copies is.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from variorum.llm._shared import documents, join_unique, materialize, slices, tidy
from variorum.llm.components import components

SHINGLE_WORDS, RADIUS, SEED = 4, 2, 42
#: The pipeline stage's own rule: shingles of five words, Jaccard similarity 0.8.
STAGE_WORDS, STAGE_SIMILARITY = 5, 0.8
#: Variants that one prefix holds on average, and that a task writes out at once, at most: bound a task's memory.
VARIANTS_PER_PREFIX, AT_ONCE = 1 << 21, 1 << 23
_BLOCK = 1 << 15


def shingle_hashes(text: str | None, words: int = SHINGLE_WORDS) -> Iterator[np.ndarray]:
    """XXH64 of every shingle, in blocks; no word: nothing."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    digest = xxhash.xxh64_intdigest
    if len(tokens) <= words:
        if tokens:
            yield np.array([digest(b" ".join(tokens), SEED)], np.uint64)
        return
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(tokens) - words + 1
    for first in range(0, n, _BLOCK):
        last = min(n, first + _BLOCK)
        spans = zip(starts[first:last].tolist(), ends[first + words - 1 : last + words - 1].tolist())
        yield np.array([digest(joined[i:j], SEED) for i, j in spans], np.uint64)


def _majority(blocks: Iterable[np.ndarray]) -> int:
    ones, n = np.zeros(64, np.int64), 0
    for hashes in blocks:
        n += len(hashes)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > n, bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """64 bits; bit i is 1 if more than half of the shingles' XXH64 hashes have it. No word: 0. Repeated shingles count each time."""
    return _majority(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp) for every row, fp as a signed long with the fingerprint's bits."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            fps = np.array([fingerprint(x, words) for x in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps)], schema=schema)
        tidy()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(compute, "doc_id long, fp long")


def variants(radius: int = RADIUS) -> int:
    return sum(math.comb(64, k) for k in range(radius + 1))


def prefix_bits(n: int, per_prefix: int = VARIANTS_PER_PREFIX, radius: int = RADIUS) -> int:
    return max(0, min(40, math.ceil(math.log2(max(1, n * variants(radius) / per_prefix)))))


def _flips(bits: int, most: int) -> np.ndarray:
    """Masks over the lowest ``bits`` bits with at most ``most`` ones."""
    return np.array([sum(1 << i for i in c) for k in range(most + 1) for c in combinations(range(bits), k)], np.uint64)


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of each index's component."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        if (root == before).all():
            return root


def _pairs(fps: np.ndarray, left: np.ndarray, tails: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of two fingerprints for each link found among variants with at most ``left`` flips in the lowest ``tails`` bits."""
    mask = np.uint64((1 << tails) - 1) if tails < 64 else np.uint64(0xFFFFFFFFFFFFFFFF)
    keys, owner = [], []
    for k in range(radius + 1):
        who = np.flatnonzero(left == k)
        if len(who):
            flips = _flips(tails, k)
            keys.append(((fps[who] & mask)[:, None] ^ flips[None, :]).ravel())
            owner.append(np.repeat(who.astype(np.int32), len(flips)))
    key, own = np.concatenate(keys), np.concatenate(owner)
    order = np.argsort(key)
    key, own = key[order], own[order]
    same = key[1:] == key[:-1]
    a, b = own[1:][same].astype(np.int64), own[:-1][same].astype(np.int64)
    if not len(a):
        return a, b
    pair = np.unique(np.minimum(a, b) * len(fps) + np.maximum(a, b))
    a, b = pair // len(fps), pair % len(fps)
    near = np.bitwise_count(fps[a] ^ fps[b]) <= 2 * radius
    return a[near], b[near]


def _written(left: np.ndarray, tails: int, radius: int) -> int:
    """How many variants fingerprints with these flips left have."""
    size = [sum(math.comb(tails, j) for j in range(k + 1)) for k in range(radius + 1)]
    return int((np.bincount(left, minlength=radius + 1) * size).sum())


def meet(fps: np.ndarray, left: np.ndarray, bits: int, radius: int = RADIUS, at_once: int = AT_ONCE) -> np.ndarray:
    """Write out each fingerprint's variants in one prefix, those with at most ``left`` flips in the lowest 64 - bits
    bits, and return the root index of each fingerprint among those that it meets, each link checked.

    Where the variants are more than ``at_once``, they are written out by one further bit at a time: all whose next
    bit is 0, then all whose next bit is 1, and so on below.
    """
    who = np.arange(len(fps))
    todo, found = [(who, left, 64 - bits)], []
    while todo:
        who, flips, tails = todo.pop()
        if tails > 8 and _written(flips, tails, radius) > at_once:
            bit = fps[who] >> np.uint64(tails - 1) & np.uint64(1)
            for value in (0, 1):
                rest = flips - (bit != value)
                some = rest >= 0
                todo.append((who[some], rest[some], tails - 1))
        elif len(who) > 1:
            a, b = _pairs(fps[who], flips, tails, radius)
            found.append((who[a], who[b]))
    if not found:
        return np.arange(len(fps))
    return _forest(len(fps), np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found]))


def _routes(bits: int, below: int, radius: int) -> Column:
    """Each way to flip at most radius of ``bits`` bits that stand above the lowest ``below``: how many, and their mask."""
    made = []
    for k in range(min(radius, bits) + 1):
        for c in combinations(range(bits), k):
            m = sum(1 << (below + i) for i in c)
            made.append(F.struct(F.lit(k).alias("used"), F.lit(m - (1 << 64) if m >= 1 << 63 else m).cast("long").alias("mask")))
    return F.array(*made)


def ball_links(fps: DataFrame, n: int, *, per_prefix: int = VARIANTS_PER_PREFIX, radius: int = RADIUS, further: int = 6) -> DataFrame:
    """fps: distinct fp. Links (a, b) between fingerprints whose closure is that of all pairs within 2 * radius bits.

    A prefix that more than eight times ``per_prefix`` variants fall to is dealt once more, by ``further`` bits. What is
    still many then, because the fingerprints themselves crowd there, its task writes out in parts (``meet``).
    """
    bits = prefix_bits(n, per_prefix, radius)
    cut = lambda below: F.lit(0).cast("long") if below >= 64 else F.shiftrightunsigned(F.col("fp").bitwiseXOR(F.col("r.mask")), below)
    dealt = fps.select("fp", F.explode(_routes(bits, 64 - bits, radius)).alias("r")).select("fp", (F.lit(radius) - F.col("r.used")).cast("int").alias("left"), cut(64 - bits).alias("prefix"))
    sizes = F.element_at(F.array(*[F.lit(sum(math.comb(64 - bits, j) for j in range(k + 1))) for k in range(radius + 1)]), F.col("left") + 1)
    crowded = materialize(dealt.groupBy("prefix").agg(F.sum(sizes).alias("size")).filter(F.col("size") > 8 * per_prefix).select("prefix"), "crowded")

    def link(bits: int):
        def run(table: pa.Table) -> pa.Table:
            fp = table.column("fp").to_numpy().view(np.uint64)
            root = meet(fp, table.column("left").to_numpy().astype(np.int64), bits, radius)
            moved = np.flatnonzero(root != np.arange(len(fp)))
            tidy()
            return pa.table({"a": fp[moved].view(np.int64), "b": fp[root[moved]].view(np.int64)})

        return run

    if crowded.isEmpty():
        return dealt.groupBy("prefix").applyInArrow(link(bits), "a long, b long")
    calm = dealt.join(crowded, "prefix", "left_anti").groupBy("prefix").applyInArrow(link(bits), "a long, b long")
    below = 64 - bits - further
    again = dealt.join(crowded, "prefix", "left_semi").withColumn("r", F.explode(_routes(further, below, radius))).filter("r.used <= left")
    tail = F.shiftrightunsigned(F.col("fp").bitwiseXOR(F.col("r.mask")), below).bitwiseAND(F.lit((1 << further) - 1))
    again = again.select("fp", (F.col("left") - F.col("r.used")).cast("int").alias("left"), "prefix", tail.alias("tail"))
    return calm.unionByName(again.groupBy("prefix", "tail").applyInArrow(link(bits + further), "a long, b long"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", per_prefix: int = VARIANTS_PER_PREFIX, words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id.

    Texts are lower-cased in A-Z, cut into words at blank and tab to carriage return, and into shingles of ``words``
    words (fewer words: one shingle of all). A null or empty text has fingerprint zero, which links like any other.
    Fingerprints within 2 * radius bits are linked; component_id is the smallest doc_id reachable. Rows with a null id take
    part with their text, but give no component its name; a component of such rows only has a null component_id. Rows
    that share an id are linked by their texts only. An empty table gives an empty result; other columns are not read.
    """
    rows = materialize(fingerprints(docs, id_col=id_col, text_col=text_col, words=words), "fingerprints")
    nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")), "nodes")
    rooted = nodes.join(fingerprint_roots(nodes, per_prefix, radius), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = materialize(rooted, "roots")
    # a component's fingerprints are few for most; its name is a minimum, combined before it is shuffled
    large = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    named = materialize(join_unique(rooted.select("fp", "copies", "root"), large, "root", "n").select("fp", "copies", "component_id"), "components")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return join_unique(rows.select("doc_id", "fp"), named, "fp", "copies").select("doc_id", digits.alias("fingerprint"), "component_id")


def fingerprint_roots(nodes: DataFrame, per_prefix: int = VARIANTS_PER_PREFIX, radius: int = RADIUS) -> DataFrame:
    """(fp, root) of every distinct fingerprint that has a link and isn't the least of its component."""
    links = ball_links(nodes.select("fp"), nodes.count(), per_prefix=per_prefix, radius=radius)
    return components(links, "a", "b").withColumnRenamed("node", "fp")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
