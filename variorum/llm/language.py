"""Language identification by rank-order profiles.

A profile is a ranking of the most frequent letter n-grams (one to three letters, with a mark for a word's ends). Each
language's profile is counted over all of its training documents; a document's own profile is compared to each by the
sum of the differences in rank, where an n-gram that a language lacks counts as out of place by the whole profile.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from variorum.llm._shared import documents, is_held_out, slices, texts

#: N-grams of a profile; labels of this remainder of the id's crc32 are never learned from.
PROFILE, MODULUS, HELD_OUT = 400, 4, 2
#: Letters that are counted at a time, distinct n-grams that a task holds before it passes them on.
BLOCK, HELD = 1 << 20, 1 << 20
UNDETERMINED = "und"
_LETTER = np.array([chr(c).isalpha() for c in range(0x10000)])


def letters(text: str) -> np.ndarray:
    """Code points of the lower-cased text plus one; 1 stands for the ends of words, once between two words."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    known = _LETTER[np.minimum(code, 0xFFFF)]
    far = np.flatnonzero(code > 0xFFFF)
    if len(far):
        known[far] = [chr(c).isalpha() for c in code[far].tolist()]
    code = np.concatenate(([1], np.where(known, code + 1, 1), [1]))
    return code[np.concatenate(([True], (code[1:] > 1) | (code[:-1] > 1)))]


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """N-grams as numbers, in order, and how often each comes. No n-gram reaches over the end of a word."""
    code = letters(text)
    merged: list[tuple[np.ndarray, np.ndarray]] = []
    for at in range(0, len(code) - 1, BLOCK):
        a = code[at : at + BLOCK + 2]
        n = min(BLOCK, len(a))
        one = a[:n][a[:n] > 1]
        two = (a[:-1] << 21 | a[1:])[:n]
        three = (a[:-2] << 42 | a[1:-1] << 21 | a[2:])[a[1:-1] > 1][:n]
        merged.append(np.unique(np.concatenate([one, two, three]), return_counts=True))
    return add(merged)


def add(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(inverse, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


def ranking(keys: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent first; of equally frequent ones, the smaller number."""
    return keys[np.argsort(-counts, kind="stable")[:size]]


def profiles(docs: DataFrame, size: int = PROFILE) -> dict[str, np.ndarray]:
    """Each language's ranking, counted over every training document. What comes to the driver is languages times size."""
    schema = pa.schema([("lang", pa.string()), ("ngram", pa.int64()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                keys, n = add(parts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(n)], schema=schema)
            held.clear()

        for batch in slices(batches, "text"):
            for lang, text in zip(batch.column("lang").to_pylist(), texts(batch)):
                part = ngram_counts(text)
                held.setdefault(lang, []).append(part)
                size += len(part[0])
                if size > HELD:
                    held = {lang: [add(parts)] for lang, parts in held.items()}
                    size = sum(len(parts[0][0]) for parts in held.values())
                    if size > HELD // 2:
                        yield from out()
                        size = 0
        yield from out()

    rows = docs.filter(F.col("lang").isNotNull() & ~is_held_out(F.col("doc_id"), MODULUS, HELD_OUT)).select("lang", "text")
    counts = rows.mapInArrow(count, "lang string, ngram long, n long").groupBy("lang", "ngram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "ngram")
    top = counts.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= size)
    found: dict[str, list] = {}
    for r in top.orderBy("lang", "place").collect():
        found.setdefault(r["lang"], []).append(r["ngram"])
    return {lang: np.array(x, np.int64) for lang, x in found.items()}


class Identifier:
    def __init__(self, known: dict[str, np.ndarray], size: int = PROFILE) -> None:
        self.langs, self.size = sorted(known), size
        self.keys = np.unique(np.concatenate([*known.values(), np.zeros(0, np.int64)])).astype(np.int64)
        self.ranks = np.full((len(self.langs), len(self.keys) + 1), -1)
        for row, lang in zip(self.ranks, self.langs):
            row[np.searchsorted(self.keys, known[lang])] = np.arange(len(known[lang]))

    def identify(self, text: str) -> tuple[str, float]:
        """The nearest language, the first by name of equally near ones, and 1 less its distance as a share of the largest."""
        own = ranking(*ngram_counts(text), self.size)
        if not (len(own) and own[own < 1 << 21].size and self.langs):
            return UNDETERMINED, 0.0
        at = np.searchsorted(self.keys, own)
        at[(at == len(self.keys)) | (self.keys[np.minimum(at, len(self.keys) - 1)] != own)] = len(self.keys)
        rank = self.ranks[:, at]
        distance = np.where(rank < 0, self.size, np.abs(rank - np.arange(len(own)))).sum(axis=1)
        best = int(distance.argmin())
        return self.langs[best], float(1 - distance[best] / (self.size * len(own)))


def languages(docs: DataFrame, *, size: int = PROFILE) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of docs.

    A text that is null or has no letter is ``und`` with score 0, as every text is where no language was learned. Very long
    texts are profiled whole, rows that repeat are alike, a null id isn't held out, and an empty table gives an empty
    result. Columns other than doc_id, text and lang (for learning only) are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(profiles(docs, size))
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        identifier = Identifier(shared.value, size)
        for batch in slices(batches, "text"):
            found = [identifier.identify(t) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), is_held_out(F.col("doc_id"), MODULUS, HELD_OUT).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(documents(spark, sf_dir))
