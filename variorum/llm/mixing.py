"""Mixing sources to target weights.

A source's weight is its share of all tokens to the power of an exponent (0: all sources alike, 1: as they are, above:
large sources more so), divided by the sum of all. Two targets bound the exponent from below: the smallest up to 1 at which no
source is repeated more than allowed, and the smallest at which the weights have no more entropy than asked for. The
larger of both is taken. Entropy falls as the exponent grows, and up to 1 so does the largest repetition, so each is
found by bisection, five binary digits to a pass: one aggregate over the table of sources tries many exponents at
once, so that no more than a row comes to the driver however many sources there are.

Weights become budgets of tokens. No budget is more than ``repeats`` times its source's tokens: where no exponent meets
that limit (a budget beyond ``repeats`` times all tokens, or an entropy that leaves little but one source), the
mixture is smaller than asked for, and the weights stay as they are. Where no exponent meets the entropy (sources all of one size), 1 is taken.

A source is passed over in epochs; in each, its documents are dealt by a hash to ``BLOCKS`` blocks, the blocks are permuted
by a seeded hash, and so are the documents within each. Whole epochs give every document once; the last gives blocks in
their order until the budget is spent, and of the block where that happens documents in their order. Running sums go
over blocks, and within that one block of each source: never over a source. Rows alike in id, source and text are one
document there, with their number as its copies, so that they make no hot block.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from variorum.llm._shared import documents, fresh, join_unique, materialize, text_keys

#: Blocks of a source; steps of one pass; passes; the largest exponent that is tried.
BLOCKS, PARTS, PASSES, MOST = 4096, 32, 6, 1024.0
#: Production parameters: share of the largest possible entropy, times that a source may be repeated, seed.
ENTROPY, REPEATS, SEED = 0.97, 2.0, 11
WORD, NO_SOURCE = r"[^\x20\x09-\x0D]+", "\0"


def n_tokens(text: Column) -> Column:
    """Words between blank characters; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def document_key() -> list[Column]:
    """What makes rows one document: id, source and text."""
    return [F.col("doc_id").cast("long").alias("doc_id"), "source", *text_keys(F.col("text"))]


def token_table(docs: DataFrame) -> DataFrame:
    """A row for each document: its key, copies, tokens of one copy, block."""
    rows = docs.select(*document_key(), n_tokens(F.col("text")).alias("n_tokens"))
    found = rows.groupBy("doc_id", "source", "k1", "k2").agg(F.count(F.lit(1)).alias("copies"), F.max("n_tokens").alias("n_tokens"))
    block = F.pmod(F.xxhash64(F.lit(SEED), "doc_id", "k1"), F.lit(BLOCKS)).cast("int")
    return found.withColumns({"_source": F.coalesce("source", F.lit(NO_SOURCE)), "block": block})


def _smallest(tried: list[float], measure: Callable[[list[float]], list[bool]]) -> float | None:
    """The smallest exponent that meets a target, found between two of those tried first; None if none of them does."""
    for _ in range(PASSES):
        met = measure(tried)
        first = next((k for k, m in enumerate(met) if m), None)
        if first is None:
            return None
        if first == 0:
            return tried[0]
        low, high = tried[first - 1], tried[first]
        tried = [low + (high - low) * k / PARTS for k in range(PARTS + 1)]
    return high


def exponent(sources: DataFrame, *, entropy: float | None = ENTROPY, repeats: float | None = REPEATS, budget: float | None = None) -> float:
    """The smallest exponent that meets both targets, as the module says.

    sources: a row for each source, with its tokens as double. entropy: share of the logarithm of the number of sources.
    repeats: budget of a source as a multiple of its tokens. budget: tokens of the mixture, by default those there are.
    """
    known = sources.filter("tokens > 0")
    total, largest, count = known.agg(F.sum("tokens"), F.max("tokens"), F.count(F.lit(1))).first()
    if not count or count == 1:
        return 1.0
    budget = budget or total
    p = F.col("tokens") / F.lit(float(largest))

    def sums(tried: list[float], column: Callable[[Column, float], Column]) -> list[tuple[float, float]]:
        row = known.agg(*[c for a in tried for c in (F.sum(F.pow(p, F.lit(a))), column(p, a))]).first()
        return list(zip(row[::2], row[1::2]))

    def spread(tried: list[float]) -> list[bool]:
        weighed = sums(tried, lambda p, a: F.sum(F.pow(p, F.lit(a)) * F.log(p) * F.lit(a)))
        return [math.log(z) - s / z <= entropy * math.log(count) + 1e-12 for z, s in weighed]

    def repeated(tried: list[float]) -> list[bool]:
        times = sums(tried, lambda p, a: F.max(F.pow(p, F.lit(a - 1))))
        return [m / z * budget / largest <= repeats + 1e-12 for z, m in times]

    unit = [k / PARTS for k in range(PARTS + 1)]
    by_repeats = _smallest(unit, repeated) if repeats is not None else 0.0
    by_entropy = _smallest(unit + [2.0**k for k in range(1, int(math.log2(MOST)) + 1)], spread) if entropy is not None else 0.0
    return max(1.0 if by_repeats is None else by_repeats, 1.0 if by_entropy is None else by_entropy)


def _plan(tokens: DataFrame, entropy: float | None, repeats: float | None, budget: float | None) -> DataFrame:
    """Rows of token_table with weight, epoch and block_place, once for each time that the document's copies are given."""
    blocks = materialize(tokens.groupBy("_source", "block").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("block_tokens")), "blocks")
    sources = materialize(blocks.groupBy("_source").agg(F.sum("block_tokens").cast("double").alias("tokens")), "sources")
    alpha = exponent(sources, entropy=entropy, repeats=repeats, budget=budget)
    total, largest = sources.agg(F.sum("tokens"), F.max("tokens")).first()
    power = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(largest or 1.0), F.lit(alpha))).otherwise(F.lit(0.0))
    z = sources.agg(F.sum(power)).first()[0] or 1.0
    asked = F.col("weight") * F.lit(float(budget or total or 0.0))
    goal = asked if repeats is None else F.least(asked, F.col("tokens") * F.lit(float(repeats)))
    weighed = sources.withColumn("weight", power / F.lit(z)).withColumn("goal", F.when(F.col("tokens") > 0, goal).otherwise(F.lit(0.0)))
    full = F.when(F.col("tokens") > 0, F.floor(F.col("goal") / F.col("tokens") + F.lit(1e-9))).otherwise(F.lit(1)).cast("int")
    weighed = weighed.withColumn("full", full).withColumn("left", F.greatest(F.col("goal") - F.col("full") * F.col("tokens"), F.lit(0.0)))
    epochs = blocks.join(weighed, "_source").withColumn("epoch", F.explode(F.sequence(F.lit(0), "full")))
    order = Window.partitionBy("_source", "epoch").orderBy(F.xxhash64(F.lit(SEED), "epoch", "_source", "block"), "block")
    placed = epochs.withColumn("block_place", F.row_number().over(order)).withColumn("through", F.sum("block_tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = F.col("epoch") < F.col("full")
    state = F.when(whole | (F.col("through") <= F.col("left")), F.lit("all")).when((F.col("through") - F.col("block_tokens") < F.col("left")) & (F.col("tokens") > 0), F.lit("part"))
    plan = placed.withColumn("state", state).filter("state is not null").withColumn("room", F.col("left") - (F.col("through") - F.col("block_tokens")))
    # a source without tokens has no second epoch
    plan = plan.filter((F.col("tokens") > 0) | whole)
    given = tokens.join(plan.select("_source", "block", "weight", "epoch", "block_place", "state", "room"), ["_source", "block"])
    within = Window.partitionBy("_source", "block", "epoch").orderBy(F.xxhash64(F.lit(SEED), "epoch", "doc_id", "k1"), "doc_id", "k1", "k2")
    cut = given.filter("state = 'part'").withColumn("upto", F.sum(F.col("n_tokens") * F.col("copies")).over(within.rowsBetween(Window.unboundedPreceding, 0)))
    columns = ("doc_id", "source", "k1", "k2", "copies", "weight", "epoch", "block", "block_place", "n_tokens")
    return given.filter("state = 'all'").select(*columns).unionByName(cut.filter("upto <= room").select(*columns))


def mixture(docs: DataFrame, *, entropy: float | None = ENTROPY, repeats: float | None = REPEATS, budget: float | None = None) -> DataFrame:
    """One row for each time that a row of docs is given: doc_id, source, weight, epoch, block, block_place, n_tokens.

    block_place is the block's place in its source's permutation for that epoch, from 1. A null source is a source of its
    own; documents without any token (null and empty texts) come with their block; a source without tokens is given
    once. Rows alike in id, source and text are given together or not at all; rows that share an id, or have none, with
    different texts are documents of their own. A document is never cut, so a source's budget is not overrun, and
    underrun by less than its next document with its copies. An empty table gives an empty result.
    """
    given = _plan(materialize(token_table(docs), "tokens"), entropy, repeats, budget)
    copies = given.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return copies.select("doc_id", "source", "weight", "epoch", "block", "block_place", "n_tokens")


def mix_sources(docs: DataFrame, *, entropy: float | None = ENTROPY, repeats: float | None = REPEATS, budget: float | None = None) -> DataFrame:
    """docs as the mixture gives them: each row as often as its document is given; all columns as they were.

    Null ids, sources and texts, repeated rows, empty texts and an empty table are treated as ``mixture`` says.
    """
    given = _plan(materialize(token_table(docs), "tokens"), entropy, repeats, budget)
    given = given.groupBy("doc_id", "source", "k1", "k2").agg(F.count(F.lit(1)).alias("times"), F.first("copies").alias("copies"))
    key, times, copies, time = fresh(docs, "_key", "_times", "_copies", "_time")
    listed = materialize(given.select(F.to_json(F.struct("doc_id", "source", "k1", "k2")).alias(key), F.col("times").alias(times), F.col("copies").alias(copies)), "given")
    named = docs.withColumn(key, F.to_json(F.struct(*document_key())))
    found = join_unique(named, listed, key, copies).filter(F.col(times).isNotNull())
    return found.withColumn(time, F.explode(F.sequence(F.lit(1), F.col(times).cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(documents(spark, sf_dir))
