"""Both sides of a document in one row, and what is worked out of such a row in Python on Arrow batches.

Rows are dealt once, by document, as texts; pairs are made where both sides already are and never cross the network. A document
pair is the unit of the work.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence
from decimal import ROUND_HALF_UP, Decimal
from functools import cached_property, lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from variorum.functions.similarity import exact_ratio, lcs_length
from variorum.operators.identity import words

#: Documents whose Python objects exist at once, and result rows of one batch.
SLICE, ROWS = 128, 20_000
#: Characters of texts that are compared side by side.
PACK = 1 << 14


def sides(old: DataFrame, new: DataFrame, doc: list[str], order: str, columns: list[str], *, how: str = "inner") -> DataFrame:
    """One row for each document: doc and, for every column, its values on the old and on the new side as arrays in order."""

    def gathered(rows: DataFrame, side: str) -> DataFrame:
        listed = F.sort_array(F.collect_list(F.struct(order, *[c for c in columns if c != order])))
        told = rows.groupBy(*doc).agg(listed.alias("_x"))
        return told.select(*doc, *[F.col("_x")[c].alias(f"{side}_{c}") for c in columns])

    return gathered(old, "old").join(gathered(new, "new"), doc, how)


def over_documents(rows: DataFrame, doc: list[str], work: Callable[..., Iterable[tuple]], schema: str) -> DataFrame:
    """Result rows of ``work``, which gets the columns that aren't ``doc`` of one row at a time: doc and ``schema``."""
    rest = [c for c in rows.columns if c not in doc]
    kind = StructType([f for f in rows.schema if f.name in doc] + StructType.fromDDL(schema).fields)
    arrow = to_arrow_schema(StructType([*kind.fields[len(doc) :]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                at: list[int] = []
                out: list[tuple] = []
                for i, values in enumerate(zip(*[part.column(c).to_pylist() for c in rest])):
                    for found in work(*values):
                        at.append(i)
                        out.append(found)
                        if len(out) >= ROWS:
                            yield made(part, at, out)
                            at, out = [], []
                if out:
                    yield made(part, at, out)

    def made(part: pa.RecordBatch, at: list[int], out: list[tuple]) -> pa.RecordBatch:
        keys = [part.column(c).take(pa.array(at, pa.int32())) for c in doc]
        values = [pa.array(x, f.type) for x, f in zip(zip(*out), arrow)]
        return pa.RecordBatch.from_arrays([*keys, *values], names=[*doc, *arrow.names])

    return rows.select(*doc, *rest).mapInArrow(run, kind)


def sharing(old: Sequence[str], new: Sequence[str], most: int) -> Iterator[tuple[int, list[int]]]:
    """For places of the old side those of the new side that share a word which at most ``most`` texts of either side have.

    A word's texts on the new side are bits of one number; equal texts are read once.
    """
    known = {text: words(text) for text in {*old, *new}}
    count = Counter(w for text in old for w in known[text])
    where: dict[str, int] = {}
    for j, text in enumerate(new):
        for w in known[text]:
            if w in count:
                where[w] = where.get(w, 0) | 1 << j
    where = {w: x for w, x in where.items() if count[w] <= most and x.bit_count() <= most}
    for i, text in enumerate(old):
        met = 0
        for w in known[text]:
            if w in where:
                met |= where[w]
        found = []
        while met:
            low = met & -met
            found.append(low.bit_length() - 1)
            met ^= low
        if found:
            yield i, found


@lru_cache(maxsize=1 << 16)
def length_score(a: int, b: int) -> float:
    """``similarity.length_bound`` of two lengths, to six decimals as Spark rounds."""
    if not a + b:
        return 1.0
    return float(Decimal(repr(2.0 * min(a, b) / (a + b))).quantize(Decimal("0.000001"), ROUND_HALF_UP))


def scored(old: Sequence[str], new: Sequence[str], most: int, least: float = 0.0) -> Iterator[tuple[int, int, float]]:
    """Places that share such a word, with their length score, where it is ``least`` or more."""
    m, n = [len(x) for x in old], [len(x) for x in new]
    for i, found in sharing(old, new, most):
        for j in found:
            score = length_score(m[i], n[j])
            if score >= least:
                yield i, j, score


def only_best(pairs: Iterable[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """Pairs that are the only best of both their sides; a tie is no best."""
    best: tuple[dict, dict] = {}, {}
    for pair in pairs:
        for k in (0, 1):
            held = best[k].get(pair[k])
            if held is None or pair[2] > held[2]:
                best[k][pair[k]] = pair
            elif pair[2] == held[2]:
                best[k][pair[k]] = (None, None, pair[2])
    return [p for p in best[0].values() if p[0] is not None and best[1][p[1]] is p]


def crossed(values: Sequence[int]) -> list[bool]:
    """For each value whether a larger one is before it or a smaller one after it."""
    before = [float("-inf"), *accumulate(values, max)]
    after = [*accumulate(reversed(values), min)][::-1][1:] + [float("inf")]
    return [b > v or a < v for v, b, a in zip(values, before, after)]


def length_pairs(most: int, least: float = 0.0) -> Callable[..., Iterator[tuple]]:
    """Work on (old orders, old texts, new orders, new texts): old_ord, new_ord, score of each pair."""

    def work(a: list, x: list[str], b: list, y: list[str]) -> Iterator[tuple]:
        return ((a[i], b[j], s) for i, j, s in scored(x, y, most, least))

    return work


def only_nearest(mine: Sequence[str], others: Sequence[str], known: dict[str, set[str]]) -> list[int | None]:
    """For each text the one other of the best length score among all that share a word with it; None without one or on a tie.

    A word's texts are in order of length, so the best of a word are beside a text's own length: no pair is made of the rest.
    """
    having: dict[str, tuple[list[int], list[int]]] = {}
    for j in sorted(range(len(others)), key=lambda j: len(others[j])):
        for w in known[others[j]]:
            lengths, places = having.setdefault(w, ([], []))
            lengths.append(len(others[j]))
            places.append(j)

    def nearest(text: str) -> int | None:
        m = len(text)
        met = [(*having[w], bisect_left(having[w][0], m)) for w in known[text] if w in having]
        best = max((length_score(m, lengths[k]) for lengths, _, at in met for k in (at - 1, at) if 0 <= k < len(lengths)), default=None)
        found: set[int] = set()
        for lengths, places, at in met:
            for run in (range(at, len(lengths)), range(at - 1, -1, -1)):
                for k in run:
                    if length_score(m, lengths[k]) < best:
                        break
                    found.add(places[k])
                    if len(found) > 1:
                        return None
        return next(iter(found), None)

    told = {text: nearest(text) for text in {*mine}}
    return [told[text] for text in mine]


def best_length_pairs() -> Callable[..., Iterator[tuple]]:
    """The like, of pairs that are the only best of both their sides among all that share a word, however many texts have it."""

    def work(a: list, x: list[str], b: list, y: list[str]) -> Iterator[tuple]:
        known = {text: words(text) for text in {*x, *y}}
        back = only_nearest(y, x, known)
        return ((a[i], b[j], length_score(len(x[i]), len(y[j]))) for i, j in enumerate(only_nearest(x, y, known)) if j is not None and back[j] == i)

    return work


def best_changed_lines(most: int) -> Callable[..., Iterator[tuple]]:
    """The like, of texts that differ, with both: old_ord, new_ord, old_line, new_line."""

    def work(a: list, x: list[str], b: list, y: list[str]) -> Iterator[tuple]:
        return ((a[i], b[j], x[i], y[j]) for i, j, _ in only_best(scored(x, y, most)) if x[i] != y[j])

    return work


class Pack:
    """Texts side by side: their characters' counts are the rows of one table, and in one number each has its bits and a clear bit
    after them, so that one pass over another text finds its longest common subsequence with every one."""

    def __init__(self, texts: Sequence[str]) -> None:
        self.texts, self.lengths = texts, np.array([len(x) for x in texts])
        ends = np.cumsum(self.lengths + 1)
        self.starts = ends - self.lengths - 1
        codes = np.full(ends[-1], -1, np.int64)
        self.inside = np.ones(len(codes), bool)
        self.inside[ends - 1] = False
        codes[self.inside] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        letters, self.codes = np.unique(codes, return_inverse=True)
        self.letters = {chr(c): k for k, c in enumerate(letters.tolist()) if c >= 0}
        text = np.repeat(np.arange(len(texts)), self.lengths + 1)
        self.counts = np.bincount(text * len(letters) + self.codes, minlength=len(texts) * len(letters)).reshape(len(texts), len(letters))

    @cached_property
    def bits(self) -> tuple[dict[str, int], int]:
        number = lambda x: int.from_bytes(np.packbits(x, bitorder="little").tobytes(), "little")
        return {c: number(self.codes == k) for c, k in self.letters.items()}, number(self.inside)

    def shared(self, count: Counter) -> np.ndarray:
        """Size of the common bag of characters with each text."""
        mine = np.zeros(self.counts.shape[1], self.counts.dtype)
        for c, n in count.items():
            if c in self.letters:
                mine[self.letters[c]] = n
        return np.minimum(self.counts, mine).sum(axis=1)

    def common(self, text: str) -> np.ndarray:
        """Length of the longest common subsequence with each text."""
        at, full = self.bits
        row = full
        for c in text:
            if c in at:
                met = row & at[c]
                # what is carried out of a text ends in the clear bit after it
                row = (row + met | row - met) & full
        left = np.unpackbits(np.frombuffer(row.to_bytes((len(self.codes) + 7) // 8, "little"), np.uint8), bitorder="little")[: len(self.codes)]
        return self.lengths - np.add.reduceat(left.astype(np.int64), self.starts)


def packs(texts: Iterable[str]) -> Iterator[Pack]:
    """The different texts by length, about PACK characters at a time."""
    part, size = [], 0
    for text in sorted({*texts}, key=lambda x: (len(x), x)):
        if part and size + len(text) > PACK:
            yield Pack(part)
            part, size = [], 0
        part.append(text)
        size += len(text) + 1
    if part:
        yield Pack(part)


def ratios(text: str, pack: Pack, least: float) -> Iterator[tuple[str, float]]:
    """The pack's texts whose lengths allow ``least`` with their exact ratio, 0 where that is below it: what ``bounded_ratio`` says of each."""
    m, lengths = len(text), pack.lengths.tolist()
    middle = bisect_left(lengths, m)
    lo = bisect_left(lengths, True, hi=middle, key=lambda n: length_score(m, n) >= least)
    hi = bisect_left(lengths, True, lo=middle, key=lambda n: length_score(m, n) < least)
    if lo == hi:
        return
    total = pack.lengths[lo:hi] + m
    open_ = total > 0
    sure = np.maximum(total, 1)
    open_ &= (2 * np.minimum(pack.lengths[lo:hi], m) / sure >= least) & (2 * pack.shared(Counter(text))[lo:hi] / sure >= least)
    left = [k for k in (lo + np.flatnonzero(open_)).tolist() if pack.texts[k] != text]
    if 4 * len(left) >= len(lengths) > 1:
        common = pack.common(text)
        reached = {k for k in left if 2 * int(common[k]) / (m + lengths[k]) >= least}
    else:
        reached = {k for k in left if 2 * lcs_length(text, pack.texts[k]) / (m + lengths[k]) >= least}
    for k in range(lo, hi):
        ratio = 1.0 if pack.texts[k] == text else exact_ratio(text, pack.texts[k]) if k in reached else 0.0
        yield pack.texts[k], ratio if ratio >= least else 0.0


def ratio_pairs(least: float) -> Callable[..., Iterator[tuple]]:
    """old_ord, new_ord, exact ratio (0 where it is below ``least``) of all pairs whose lengths allow ``least``; equal texts are compared once."""

    def work(a: list, x: list[str], b: list, y: list[str]) -> Iterator[tuple]:
        olds: dict[str, list] = {}
        news: dict[str, list] = {}
        for told, places, texts in ((olds, a, x), (news, b, y)):
            for place, text in zip(places, texts):
                told.setdefault(text, []).append(place)
        for pack in packs(news):
            for text, mine in olds.items():
                for other, ratio in ratios(text, pack, least):
                    yield from ((i, j, ratio) for i in mine for j in news[other])

    return work


def character_pairs(most: int, least: float) -> Callable[..., Iterator[tuple]]:
    """old_ord, new_ord, shared characters, characters of both, of pairs whose lengths allow ``least``; a text's are counted once."""

    def work(a: list, x: list[str], b: list, y: list[str]) -> Iterator[tuple]:
        counts = {text: Counter(text) for text in {*x, *y}}
        for i, j, _ in scored(x, y, most, least):
            m, n = counts[x[i]], counts[y[j]]
            yield a[i], b[j], sum(min(k, n[c]) for c, k in m.items() if c in n), len(x[i]) + len(y[j])

    return work
