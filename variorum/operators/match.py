"""Matching old and new: staged, consuming joins to one-to-one pairs that keep order.

Sections are dealt once and matched in one row for each document pair: unique bodies, identities, similarity of all pairs that
bounds leave possible, and the assignment. What follows, on the few that are left, is joins.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Container, Hashable, Iterable, Iterator, Sequence
from functools import cache
from heapq import heapify, heappop, heappush
from itertools import pairwise
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from variorum.functions import similarity as S
from variorum.functions import text as T
from variorum.operators.assignment import BASIS_RANK, Candidate, common_in_order, monotonic_pairs, rising_chain
from variorum.operators.identity import identity_similarity
from variorum.operators.ordered import crossing, offset_support, unique_only, within_anchors
from variorum.operators.paired import crossed, only_best, over_documents, sides
from variorum.operators.segment import sentences
from variorum.session import stored

#: Thresholds of the stages.
SECTION, TABLE, UNIT, NEAR = 0.72, 0.65, 0.45, 0.85
BODY_ANCHOR, TOKEN_DOCUMENTS, POSITION = 50, 32, 3


def grouped(rows: DataFrame, keys: list[str]):
    """Grouped rows under columns of their own, so that both sides of a cogroup may come from one table."""
    return rows.toDF(*rows.columns).groupBy(*keys)


def identical_pairs(old: DataFrame, new: DataFrame, doc: list[str], order: str, text: str) -> DataFrame:
    """Documents whose texts are equal in order: prune these before anything else runs. A digest for each side is compared."""

    def digest(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy(*doc).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, F.sha2(text, 256).alias("d")))), lambda x: x["d"]), ""), 256).alias(name))

    return digest(old, "_a").join(digest(new, "_b"), doc).filter("_a = _b").select(*doc)


def unique_equal(old: DataFrame, new: DataFrame, doc: list[str], key: str, old_id: str, new_id: str, *, longest_first: int = BODY_ANCHOR) -> DataFrame:
    """Pairs whose key is long enough and comes once on either side; they may cross (content that moved)."""
    a = unique_only(old.filter(F.length(key) >= longest_first), [*doc, key]).select(*doc, key, F.col(old_id).alias("old_ord"))
    b = unique_only(new.filter(F.length(key) >= longest_first), [*doc, key]).select(*doc, key, F.col(new_id).alias("new_ord"))
    return a.join(b, [*doc, key]).select(*doc, "old_ord", "new_ord")


class Told(NamedTuple):
    """What a section is matched by. ``digest`` is that of the body in lower case with blanks collapsed, ``size`` its length."""

    ord: int
    identity: str
    leaf: str | None
    title: str
    location: str
    body: str
    digest: str
    size: int
    units: list[str]


def alone(rows: Iterable[Told], key: Callable[[Told], Hashable]) -> dict[Hashable, Told]:
    """Sections whose key no other has, by it."""
    rows = list(rows)
    count = Counter(map(key, rows))
    return {key(x): x for x in rows if count[key(x)] == 1}


def body_anchors(old: Sequence[Told], new: Sequence[Told]) -> list[tuple[int, int, bool]]:
    """Places of bodies that are long enough and come once on either side, and whether another such pair crosses."""
    a, b = (alone((x for x in side if x.size >= BODY_ANCHOR), lambda x: x.digest) for side in (old, new))
    pairs = sorted((a[k].ord, b[k].ord) for k in a.keys() & b.keys())
    return [(*pair, c) for pair, c in zip(pairs, crossed([n for _, n in pairs]))]


def leaf_candidates(old: Sequence[Told], new: Sequence[Told]) -> Iterator[tuple[Told, Told, float, str]]:
    """Sections whose last number comes once on either side, with equal titles and bodies of 80 characters or more."""
    a, b = (alone((x for x in side if x.leaf is not None and len(x.body) >= 80), lambda x: x.leaf) for side in (old, new))
    yield from ((a[k], b[k], 1.0, "structural_leaf_body_anchor") for k in a.keys() & b.keys() if (a[k].title, a[k].digest) == (b[k].title, b[k].digest))


def identity_candidates(old: Sequence[Told], new: Sequence[Told], least: float) -> Iterator[tuple[Told, Told, float, str]]:
    """Sections with one identity key whose bodies, unit by unit, don't speak against it."""
    a, b = (alone(side, lambda x: x.identity) for side in (old, new))
    for k in a.keys() & b.keys():
        score = identity_similarity(a[k].body, b[k].body, a[k].units, b[k].units)
        if score is not None and score >= least:
            yield a[k], b[k], score, "similarity_exact"


def similarity_candidates(old: Sequence[Told], new: Sequence[Told], least: float, proven: Container[tuple[int, int]] = ()) -> Iterator[tuple[Told, Told, float, str]]:
    """Sections that are similar by title, location and whole body: all pairs but the ``proven`` ones, whose proof counts more.

    Bounds of the body's ratio come before it, by length, shared characters and common subsequence; each drops a pair whose
    score can't reach ``least`` with it.
    """
    ratio = cache(S.exact_ratio)
    texts = {x.body: x.body.lower() for side in (old, new) for x in side}
    letters = cache(Counter)
    others = sorted(new, key=lambda x: len(texts[x.body]))
    lengths = [len(texts[x.body]) for x in others]
    for a in old:
        x = texts[a.body]
        for k in range(bisect_left(lengths, math.floor(len(x) * least / (2 - least))), len(others)):
            b, y = others[k], texts[others[k].body]
            total = len(x) + len(y)
            bound = 2.0 * min(len(x), len(y)) / total if total else 1.0
            if bound < least:
                if len(y) > len(x):
                    break
                continue
            if (a.ord, b.ord) in proven:
                continue
            title, place = ratio(a.title, b.title), ratio(a.location, b.location)
            score = lambda body: max(0.85 * title + 0.15 * body, 0.4 * place + 0.6 * body)  # noqa: B023, E731
            possible = lambda body: body >= least and score(body) >= least  # noqa: B023, E731
            if not possible(bound):
                continue
            if x != y:
                m, n = letters(x), letters(y)
                if not possible(2.0 * sum(min(count, n[c]) for c, count in m.items() if c in n) / total):
                    continue
                asked = max(least, min((least - 0.85 * title) / 0.15, (least - 0.4 * place) / 0.6)) * total / 2
                if not S.look_alike(x, y) and not possible(2.0 * S.lcs_length(x, y, asked - 1e-6) / total):
                    continue
            body = S.exact_ratio(x, y)
            if possible(body):
                yield a, b, score(body), "similarity_fallback"


def matched_in_document(old: Sequence[Told], new: Sequence[Told], least: float) -> Iterator[tuple]:
    """A document's pairs and conflicts of order: unique bodies, then what ``assigned`` chooses of all candidates that lie between the
    same anchors. Below a threshold of 1 each section meets every other there."""
    found = body_anchors(old, new)
    yield from ((a, b, 1.0, "unique_body_move_anchor" if moved else "unique_body_content_anchor") for a, b, moved in found)
    fixed = [(a, b) for a, b, moved in found if not moved]
    taken = {a for a, _, _ in found}, {b for _, b, _ in found}
    left = [x for x in old if x.ord not in taken[0]], [x for x in new if x.ord not in taken[1]]
    between: tuple[dict[int, list[Told]], ...] = {}, {}
    for side, rows in enumerate(left):
        ends = [pair[side] for pair in fixed]
        for x in rows:
            between[side].setdefault(bisect_left(ends, x.ord), []).append(x)
    gap = [{x.ord: k for k, rows in side.items() for x in rows} for side in between]
    # keys must be unique in the document, so these look at all that is left
    sure = [x for x in (*leaf_candidates(*left), *identity_candidates(*left, least)) if gap[0][x[0].ord] == gap[1][x[1].ord]]
    proven = {(a.ord, b.ord) for a, b, _, _ in sure}
    if least < 1:
        for k in between[0].keys() & between[1].keys():
            sure.extend(similarity_candidates(between[0][k], between[1][k], least, proven))
    yield from assigned(((a.ord, b.ord, score, basis) for a, b, score, basis in sure), fixed, least)


def solved_sections(old: DataFrame, new: DataFrame, doc: list[str], least: float) -> DataFrame:
    """``matched_in_document`` of every document; its sections are dealt once: doc, old_ord, new_ord, score, basis."""

    def told(rows: DataFrame) -> DataFrame:
        empty = lambda c: F.coalesce(c, F.lit(""))
        plain = T.collapsed(F.lower(empty(F.col("body"))))
        leaf = F.when(F.size("number_path") > 0, F.element_at("number_path", -1))
        return rows.select(*doc, F.col("ord").cast("long").alias("ord"), "identity_key", leaf.alias("leaf"), F.lower(empty(F.col("title"))).alias("title"), F.lower(F.concat_ws(" / ", "heading_path")).alias("location"), empty(F.col("body")).alias("body"), F.sha2(plain, 256).alias("digest"), F.length(plain).alias("size"))

    def work(*columns: list) -> Iterator[tuple]:
        half = len(columns) // 2
        return matched_in_document(list(map(Told, *columns[:half])), list(map(Told, *columns[half:])), least)

    columns = ["ord", "identity_key", "leaf", "title", "location", "body", "digest", "size"]
    both = sides(told(old), told(new), doc, "ord", columns)
    units = lambda side: F.transform(f"{side}_body", sentences).alias(f"{side}_units")
    both = both.select(*doc, *[f"old_{c}" for c in columns], units("old"), *[f"new_{c}" for c in columns], units("new"))
    return over_documents(both, doc, work, MATCH)


def shared_word_pairs(old: DataFrame, new: DataFrame, doc: list[str], order: str, text: str, *, most: int = TOKEN_DOCUMENTS) -> DataFrame:
    """doc, old_ord, new_ord, shared: rows that share words which at most ``most`` rows of their side have."""

    def words(rows: DataFrame, name: str) -> DataFrame:
        told = rows.select(*doc, F.col(order).alias(name), F.explode(F.array_distinct(T.meaningful_words(F.col(text)))).alias("word"))
        # one shuffle: a word's rows are counted where they meet; what the window drops never goes further
        number = F.row_number().over(Window.partitionBy(*doc, "word").orderBy(name))
        first = told.withColumn("_r", number).filter(F.col("_r") <= most + 1)
        return first.withColumn("_n", F.max("_r").over(Window.partitionBy(*doc, "word"))).filter(F.col("_n") <= most).drop("_r", "_n")

    return words(old, "old_ord").join(words(new, "new_ord"), [*doc, "word"]).groupBy(*doc, "old_ord", "new_ord").agg(F.count(F.lit(1)).alias("shared"))


def length_pairs(old: DataFrame, new: DataFrame, doc: list[str], least: float) -> DataFrame:
    """Pairs (doc, old_ord, new_ord) whose bodies' lengths allow a ratio of ``least``: no other pair can have it. Lengths are dealt to
    classes so that such pairs are in one class or in neighbouring ones."""
    step = 1 / max(least / (2 - least), 1e-3)
    length = F.length(S.section_sample(F.col("body")))
    of = F.floor(F.log(F.greatest(length, F.lit(1)).cast("double")) / F.lit(max(1e-6, math.log(step))))
    a = old.select(*doc, F.col("ord").alias("old_ord"), length.alias("_a"), F.explode(F.sequence(of - 1, of + 1)).alias("_class"))
    b = new.select(*doc, F.col("ord").alias("new_ord"), length.alias("_b"), of.alias("_class"))
    met = a.join(b, [*doc, "_class"])
    return met.filter(2.0 * F.least("_a", "_b") >= least * (F.col("_a") + F.col("_b"))).select(*doc, "old_ord", "new_ord")


MATCH = "old_ord long, new_ord long, score double, basis string"


def assigned(candidates: Iterable[tuple], anchors: Sequence[tuple[int, int]], least: float) -> Iterator[tuple]:
    """One document's ``solve``: candidates (old_ord, new_ord, score, basis) and anchors (old_ord, new_ord) to the rows of its result."""
    anchors = sorted(anchors)
    olds, news = [a for a, _ in anchors], [b for _, b in anchors]
    if any(x >= y for x, y in pairwise(news)):
        return
    taken = set(olds), set(news)
    best: dict[tuple[int, int], tuple] = {}
    for a, b, score, basis in candidates:
        if score is None or not 0 < score < math.inf or a in taken[0] or b in taken[1] or bisect_left(olds, a) != bisect_left(news, b):
            continue
        proof = BASIS_RANK.get(basis, 0), score, basis or ""
        best[a, b] = max(best.get((a, b), proof), proof)
    sure = sorted(only_best((a, b, x[1]) for (a, b), x in best.items()))
    conflicts = [(a, b) for (a, b, _), c in zip(sure, crossed([b for _, b, _ in sure])) if c]
    blocked = {a for a, _ in conflicts}, {b for _, b in conflicts}
    free = [Candidate(x[1], a, b, x[2]) for (a, b), x in best.items() if a not in blocked[0] and b not in blocked[1]]
    yield from ((c.old, c.new, c.score, c.basis) for c in rising_chain(free, least))
    for a, b in conflicts:
        yield a, None, None, "ambiguous_order_conflict"
        yield None, b, None, "ambiguous_order_conflict"


def solve(candidates: DataFrame, anchors: DataFrame, doc: list[str], *, least: float = SECTION) -> DataFrame:
    """doc, old_ord, new_ord, score, basis: the chosen pairs, and one-sided rows with basis ambiguous_order_conflict for
    places whose best pairs cross.

    Anchors must rise, or their document has no result. Candidates lie between the same anchors on both sides; of a pair's,
    the strongest proof counts, then the score. Pairs that are each other's only best and cross are reported and block
    their places. Candidates are numbers, dealt once by document; a document pair is the unit of the work.
    """

    def listed(rows: DataFrame, columns: list[str], name: str) -> DataFrame:
        told = rows.groupBy(*doc).agg(F.collect_list(F.struct(*columns)).alias("_x"))
        return told.select(*doc, *[F.col("_x")[c].alias(f"{name}{c}") for c in columns])

    def work(a: list, b: list, score: list, basis: list, x: list | None, y: list | None) -> Iterator[tuple]:
        return assigned(zip(a, b, score, basis), list(zip(x or (), y or ())), least)

    both = listed(candidates, ["old_ord", "new_ord", "score", "basis"], "_c").join(listed(anchors, ["old_ord", "new_ord"], "_a"), doc, "left")
    return over_documents(both, doc, work, MATCH)


def with_parents(sections: DataFrame) -> DataFrame:
    """sections with ``parent`` (the numbers above its own, joined) and ``ordinal`` (its last number, if it is one)."""
    return sections.withColumns({"parent": F.array_join(F.slice("number_path", 1, F.greatest(F.size("number_path") - 1, F.lit(0))), "/"), "ordinal": F.regexp_extract(F.element_at("number_path", -1), r"(\d+)$", 1).try_cast("int")})


def rescued(old: DataFrame, new: DataFrame, matched: DataFrame, doc: list[str], *, window: bool = False) -> DataFrame:
    """Further pairs of sections that ``matched`` (pairs that keep order) leaves: doc, old_ord, new_ord, score, basis.

    In turn, each on what is left: sections of one identity between matched neighbours; children moved by the one offset that
    their siblings prove; children whose title comes once under matched parents; and, for a window of pages, related
    titles with shared sentences. A pair must be the only one of both its sides and keep order with all before it.
    """
    a, b = stored(with_parents(old), "old-left"), stored(with_parents(new), "new-left")
    held = matched.select(*doc, "old_ord", "new_ord")
    found = None

    def children(side: DataFrame, c: str) -> DataFrame:
        return side.filter("parent <> ''").join(held.select(*doc, F.col(c).alias("ord")), [*doc, "ord"], "left_anti")

    def parents() -> DataFrame:
        both = held.join(a.select(*doc, F.col("ord").alias("old_ord"), F.col("number_path").alias("old_path"), F.col("parent").alias("old_parent"), F.col("ordinal").alias("o")), [*doc, "old_ord"])
        return both.join(b.select(*doc, F.col("ord").alias("new_ord"), F.col("number_path").alias("new_path"), F.col("parent").alias("new_parent"), F.col("ordinal").alias("n")), [*doc, "new_ord"])

    def mapped(both: DataFrame) -> DataFrame:
        paths = both.filter("size(old_path) > 0 and size(new_path) > 0").select(*doc, F.array_join("old_path", "/").alias("old_parent"), F.array_join("new_path", "/").alias("new_parent")).distinct()
        return unique_only(unique_only(paths, [*doc, "old_parent"]), [*doc, "new_parent"])

    def shifted() -> DataFrame:
        both = stored(parents(), "paired")
        shifts = offset_support(both.filter("o is not null and n is not null"), [*doc, "old_parent"], "o", "n").select(*doc, "old_parent", "offset")
        return shifted_children(children(a, "old_ord"), children(b, "new_ord"), mapped(both), shifts, doc)

    stages = [("structural_neighbours", lambda: structural_rescue(a, b, held, doc).drop("basis")), ("numbering_shift", shifted), ("mapped_parent_child", lambda: mapped_parent_children(children(a, "old_ord"), children(b, "new_ord"), mapped(parents()), doc))]
    if window:
        left = lambda side, c: side.join(held.select(*doc, F.col(c).alias("ord")), [*doc, "ord"], "left_anti")
        stages.append(("page_window", lambda: window_rescue(left(a, "old_ord"), left(b, "new_ord"), doc)))
    for basis, stage in stages:
        more = stage().select(*doc, F.col("old_ord").cast("long"), F.col("new_ord").cast("long")).distinct()
        more = unique_only(unique_only(stored(more, "found"), [*doc, "old_ord"]), [*doc, "new_ord"])
        for c in ("old_ord", "new_ord"):
            more = more.join(held.select(*doc, c), [*doc, c], "left_anti")
        more = within_anchors(more, held, doc, "old_ord", "new_ord")
        more = stored(crossing(more, doc, "old_ord", "new_ord").filter("not crosses").select(*doc, "old_ord", "new_ord", F.lit(None).cast("double").alias("score"), F.lit(basis).alias("basis")), basis)
        held = held.unionByName(more.select(*doc, "old_ord", "new_ord"))
        found = more if found is None else found.unionByName(more)
    return found


def match_sections(old: DataFrame, new: DataFrame, doc: list[str], *, least: float = SECTION, window: bool = False) -> DataFrame:
    """Every section of either side once: doc, old_ord, new_ord, score, basis.

    Stages, each on what is left: unique bodies that keep order, identity keys and unique leaves, similarity; conflicts of
    order stay as review rows; then ``rescued``; the rest is one-sided, and a child whose text its matched ancestor's
    counterpart holds is ``folded_into_parent``. A threshold of 1 leaves out all that infers.
    """
    every = stored(solved_sections(old, new, doc, least), "solved")
    anchor = F.col("basis").isin("unique_body_move_anchor", "unique_body_content_anchor")
    taken, solved = every.filter(anchor), every.filter(~anchor)
    fixed = taken.filter("basis = 'unique_body_content_anchor'").select(*doc, "old_ord", "new_ord")
    done = every
    if least < 1:
        in_order = fixed.unionByName(solved.filter("old_ord is not null and new_ord is not null").select(*doc, "old_ord", "new_ord"))
        open_old = old.join(solved.filter("new_ord is null").unionByName(taken).select(*doc, F.col("old_ord").alias("ord")), [*doc, "ord"], "left_anti").unionByName(old.join(fixed.select(*doc, F.col("old_ord").alias("ord")), [*doc, "ord"], "left_semi"))
        open_new = new.join(solved.filter("old_ord is null").unionByName(taken).select(*doc, F.col("new_ord").alias("ord")), [*doc, "ord"], "left_anti").unionByName(new.join(fixed.select(*doc, F.col("new_ord").alias("ord")), [*doc, "ord"], "left_semi"))
        done = done.unionByName(rescued(open_old, open_new, in_order, doc, window=window))
        done = stored(done, "done")
    none = F.lit(None)
    out = done
    for side, mine, c, other in (("old", old, "old_ord", "new_ord"), ("new", new, "new_ord", "old_ord")):
        only = mine.join(done.filter(F.col(c).isNotNull()).select(*doc, F.col(c).alias("ord")), [*doc, "ord"], "left_anti")
        paired = done.filter("old_ord is not null and new_ord is not null").join(mine.select(*doc, F.col("ord").alias(c), "number_path"), [*doc, c]).join((new if side == "old" else old).select(*doc, F.col("ord").alias(other), F.col("body").alias("other_body")), [*doc, other])
        folded = folded_into_parent(only, paired.filter("size(number_path) > 0"), doc).withColumn("_folded", F.lit(True))
        rows = only.select(*doc, "ord").join(folded, [*doc, "ord"], "left")
        basis = F.when(F.col("_folded"), "folded_into_parent").otherwise(f"only_{side}").alias("basis")
        ends = {c: F.col("ord").cast("long").alias(c), other: none.cast("long").alias(other)}
        out = out.unionByName(rows.select(*doc, ends["old_ord"], ends["new_ord"], none.cast("double").alias("score"), basis))
    return out


def structural_rescue(old: DataFrame, new: DataFrame, matched: DataFrame, doc: list[str]) -> DataFrame:
    """Unmatched sections with one path, level and title whose direct neighbours are matched to direct neighbours."""
    pairs = matched.filter("old_ord is not null and new_ord is not null").select(*doc, "old_ord", "new_ord")
    key = [*doc, "identity_key", "level", "title"]
    a = unique_only(old, key).select(*key, F.col("ord").alias("old_ord")).join(pairs.select(*doc, "old_ord"), [*doc, "old_ord"], "left_anti")
    b = unique_only(new, key).select(*key, F.col("ord").alias("new_ord")).join(pairs.select(*doc, "new_ord"), [*doc, "new_ord"], "left_anti")
    found = a.join(b, key).select(*doc, "old_ord", "new_ord")
    for step in (-1, 1):
        beside = pairs.select(*doc, (F.col("old_ord") - step).alias("old_ord"), (F.col("new_ord") - step).alias("new_ord"))
        found = found.join(beside, [*doc, "old_ord", "new_ord"], "left_semi")
    return found.withColumn("basis", F.lit("structural_neighbours"))


def trusted_parents(pairs: DataFrame, doc: list[str]) -> DataFrame:
    """Closure of trusted parent pairs from the root: pairs (old_path, new_path) whose parents are trusted in their turn.

    pairs: doc, old_path, new_path (arrays of numbers). The deepest path bounds the rounds, since each adds one level; every
    eighth is stored, so that plans stay small.
    """
    parent = lambda c: F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(0)))
    rows = pairs.select(*doc, "old_path", "new_path", parent(F.col("old_path")).alias("old_parent"), parent(F.col("new_path")).alias("new_parent"), F.size("old_path").alias("depth"))
    trusted = rows.filter((F.size("old_parent") == 0) & (F.size("new_parent") == 0))
    deepest = rows.agg(F.max("depth")).first()[0] or 0
    last = trusted
    for k in range(1, deepest):
        if k % 8 == 0:
            trusted, last = stored(trusted, "trusted"), stored(last, "level")
        up = last.select(*doc, F.col("old_path").alias("old_parent"), F.col("new_path").alias("new_parent")).distinct()
        last = rows.join(up, [*doc, "old_parent", "new_parent"], "left_semi")
        trusted = trusted.unionByName(last)
    return trusted.select(*doc, "old_path", "new_path").distinct()


def shifted_children(old: DataFrame, new: DataFrame, parents: DataFrame, shifts: DataFrame, doc: list[str]) -> DataFrame:
    """Unmatched children whose title comes once under a parent, whose parent is mapped, and whose ordinal is moved by the one
    offset that other children prove: doc, old_ord, new_ord."""
    a = unique_only(old, [*doc, "parent", "title"]).select(*doc, F.col("parent").alias("old_parent"), "title", F.col("ordinal").alias("old_n"), F.col("ord").alias("old_ord"))
    b = unique_only(new, [*doc, "parent", "title"]).select(*doc, F.col("parent").alias("new_parent"), "title", F.col("ordinal").alias("new_n"), F.col("ord").alias("new_ord"))
    found = a.join(parents, [*doc, "old_parent"]).join(b, [*doc, "new_parent", "title"]).join(shifts, [*doc, "old_parent"])
    return found.filter(F.col("new_n") - F.col("old_n") == F.col("offset")).select(*doc, "old_ord", "new_ord")


def mapped_parent_children(old: DataFrame, new: DataFrame, parents: DataFrame, doc: list[str]) -> DataFrame:
    """Children whose title comes once under mapped parents on both sides."""
    a = unique_only(old, [*doc, "parent", "title"]).select(*doc, F.col("parent").alias("old_parent"), "title", F.col("ord").alias("old_ord"))
    b = unique_only(new, [*doc, "parent", "title"]).select(*doc, F.col("parent").alias("new_parent"), "title", F.col("ord").alias("new_ord"))
    return a.join(parents, [*doc, "old_parent"]).join(b, [*doc, "new_parent", "title"]).select(*doc, "old_ord", "new_ord")


def window_rescue(old: DataFrame, new: DataFrame, doc: list[str], *, least: float = NEAR) -> DataFrame:
    """Pairs in order of unmatched sections with related titles and shared sentences, of the greatest total weight."""
    a = old.select(*doc, F.col("ord").alias("o"), F.lower("title").alias("ot"), F.lower("body").alias("ob"))
    b = new.select(*doc, F.col("ord").alias("n"), F.lower("title").alias("nt"), F.lower("body").alias("nb"))

    def run(key: tuple, x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        x, y = x.sort_values("o").reset_index(drop=True), y.sort_values("n").reset_index(drop=True)
        sentences = [set(p.strip() for p in t.split(".") if len(p.strip()) >= 20) for t in x.ob], [set(p.strip() for p in t.split(".") if len(p.strip()) >= 20) for t in y.nb]

        def weight(i: int, j: int) -> float | None:
            title, shared = S.exact_ratio(x.ot[i], y.nt[j]), len(sentences[0][i] & sentences[1][j])
            if not (title >= 1 and shared or title >= 0.92 and shared >= 2 or title >= least and shared >= 1):
                return None
            return 100 * title + 10 * shared

        pairs = monotonic_pairs(len(x), len(y), weight)
        return pd.DataFrame([(*key, int(x.o[i]), int(y.n[j])) for i, j in pairs], columns=[*doc, "old_ord", "new_ord"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in old.select(*doc).schema)
    return grouped(a, doc).cogroup(grouped(b, doc)).applyInPandas(run, f"{schema}, old_ord long, new_ord long")


def folded_into_parent(only: DataFrame, paired: DataFrame, doc: list[str]) -> DataFrame:
    """One-sided children whose body is contained in the other side's body of their nearest paired ancestor.

    only: doc, ord, number_path, body. paired: doc, number_path, other_body. The ancestor is the longest prefix.
    """
    prefixes = only.select(*doc, "ord", T.collapsed(F.lower("body")).alias("_body"), F.explode(F.sequence(F.lit(1), F.greatest(F.size("number_path") - 1, F.lit(1)))).alias("_k"), "number_path")
    prefixes = prefixes.filter(F.col("_k") < F.size("number_path")).withColumn("prefix", F.slice("number_path", 1, F.col("_k")))
    met = prefixes.join(paired.select(*doc, F.col("number_path").alias("prefix"), T.collapsed(F.lower("other_body")).alias("_other")), [*doc, "prefix"])
    nearest = met.groupBy(*doc, "ord").agg(F.max_by(F.struct("_body", "_other"), "_k").alias("x"))
    return nearest.filter((F.length("x._body") > 0) & F.contains("x._other", "x._body")).select(*doc, "ord")


def absence(only: DataFrame, matched: DataFrame, complete: DataFrame, doc: list[str]) -> DataFrame:
    """Whether one-sided rows may count as added or deleted: doc, ord, ``proven``.

    A matched neighbour on either side bounds where the counterpart would be; that interval on the other side must be whole
    (``complete``: doc, ord of the other side, whole), and the neighbours must be in order.
    """
    pairs = matched.select(*doc, F.col("ord").alias("ord"), F.col("other").alias("other"))
    rows = only.select(*doc, "ord").withColumn("other", F.lit(None).cast("long")).withColumn("_mine", F.lit(True)).unionByName(pairs.withColumn("_mine", F.lit(False)))
    w = Window.partitionBy(*doc).orderBy("ord")
    told = rows.withColumn("before", F.last("other", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("after", F.first("other", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))).filter("_mine")
    ends = complete.groupBy(*doc).agg(F.min("ord").alias("_lo"), F.max("ord").alias("_hi"))
    told = told.join(ends, doc, "left").withColumn("_a", F.coalesce("before", F.col("_lo") - 1)).withColumn("_b", F.coalesce("after", F.col("_hi") + 1))
    broken = complete.filter("not whole").select(*doc, F.col("ord").alias("_bad"))
    hit = told.join(broken, doc).filter("_bad > _a and _bad < _b").select(*doc, "ord").distinct().withColumn("_broken", F.lit(True))
    out = told.join(hit, [*doc, "ord"], "left")
    return out.select(*doc, "ord", ((F.col("before").isNotNull() | F.col("after").isNotNull()) & (F.col("_a") < F.col("_b")) & F.col("_broken").isNull()).alias("proven"))


def unit_candidates(old: Sequence[set[str]], new: Sequence[set[str]]) -> Iterator[tuple[int, int]]:
    """Places of units to compare, by their words: all pairs of a small group, else those that share a word or are at nearly the same relative place."""
    n, m = len(old), len(new)
    if n * m <= 1024:
        yield from ((i, j) for i in range(n) for j in range(m))
        return
    having: dict[str, list[int]] = {}
    for j, found in enumerate(new):
        for w in found:
            having.setdefault(w, []).append(j)
    for i, found in enumerate(old):
        told: dict[int, int] = {}
        for w in found:
            for j in having.get(w, ()) if len(having.get(w, ())) <= TOKEN_DOCUMENTS else ():
                told[j] = told.get(j, 0) + 1
        at = round(i * (m - 1) / max(1, n - 1))
        picked = sorted(told, key=lambda j: (-told[j], abs(j - at), j))[:TOKEN_DOCUMENTS]
        yield from ((i, j) for j in {*picked, *range(max(0, at - POSITION), min(m, at + POSITION + 1))})


def similar_units(old: Sequence[tuple[str, str]], new: Sequence[tuple[str, str]], least: float) -> list[tuple[int, int, float]]:
    """Units (text, key) of a group in pairs: what ``greedy_pairs`` chooses of all candidates' scores.

    A pair waits under a bound of its score, by length, then by shared characters, then by the longest common subsequence. The
    ratio is worked out only when nothing else can come before the pair and both its places are free still.
    """
    n, m = len(old), len(new)
    words = [set(t.lower().split()) for t, _ in old], [set(t.lower().split()) for t, _ in new]
    waiting = []
    for i, j in unit_candidates(*words):
        smaller = min(len(words[0][i]), len(words[1][j]))
        factor = 0.75 + 0.25 * (len(words[0][i] & words[1][j]) / smaller if smaller else 0)
        a, b = len(old[i][1]), len(new[j][1])
        bound = 2.0 * min(a, b) / (a + b) if a + b else 1.0
        if bound >= least / factor:
            # best first; of equal values bounds before scores, then the smaller gap of relative places, then the earlier places
            waiting.append((-factor * bound, 0, abs(i / max(1, n - 1) - j / max(1, m - 1)), i, j, factor, 0))
    heapify(waiting)
    used: tuple[set[int], set[int]] = set(), set()
    out = []
    while waiting:
        value, told, gap, i, j, factor, step = heappop(waiting)
        if i in used[0] or j in used[1]:
            continue
        if told:
            used[0].add(i)
            used[1].add(j)
            out.append((i, j, -value))
            continue
        x, y = old[i][1], new[j][1]
        ratio = S.exact_ratio(x, y) if step == 2 else 2.0 * (S.lcs_length if step else S.shared_characters)(x, y) / (len(x) + len(y)) if x or y else 1.0
        if ratio >= least / factor and (step < 2 or factor * ratio >= least):
            heappush(waiting, (-factor * ratio, int(step == 2), gap, i, j, factor, step + 1))
    return sorted(out)


def pair_units(old: DataFrame, new: DataFrame, group: list[str], *, least: float = UNIT) -> DataFrame:
    """Units of matched sections in pairs: group, old_no, new_no, score, basis.

    Equal keys by occurrence, then an assignment's field that comes once on both sides, then, among the rest of a group,
    the best scores first. A group's units are dealt once and paired in one row.
    """

    def told(rows: DataFrame) -> DataFrame:
        field = F.when(F.contains("text", F.lit("=")), T.assignment_field(F.col("text"))).otherwise(F.lit(""))
        return rows.select(*group, "unit_no", "text", "key", "occ", field.alias("field"))

    def work(a_no: list, a_text: list, a_key: list, a_occ: list, a_field: list, b_no: list, b_text: list, b_key: list, b_occ: list, b_field: list) -> Iterator[tuple]:
        equal = {(k, n): j for j, (k, n) in enumerate(zip(b_key, b_occ))}
        exact = [(i, equal[k, n]) for i, (k, n) in enumerate(zip(a_key, a_occ)) if (k, n) in equal]
        yield from ((a_no[i], b_no[j], 1.0, "exact_key") for i, j in exact)
        rest = [sorted({*range(len(keys))} - {x[side] for x in exact}) for side, keys in enumerate((a_key, b_key))]
        alone = []
        for places, names in zip(rest, (a_field, b_field)):
            count = Counter(names[i] for i in places if names[i])
            alone.append({names[i]: i for i in places if count[names[i]] == 1})
        fields = [(i, alone[1][name]) for name, i in alone[0].items() if name in alone[1]]
        yield from ((a_no[i], b_no[j], 0.99, "unique_field") for i, j in fields)
        x, y = ([i for i in places if i not in {f[side] for f in fields}] for side, places in enumerate(rest))
        for i, j, score in similar_units([(a_text[i], a_key[i]) for i in x], [(b_text[j], b_key[j]) for j in y], least):
            yield a_no[x[i]], b_no[y[j]], score, "similar"

    both = sides(told(old), told(new), group, "unit_no", ["unit_no", "text", "key", "occ", "field"])
    return over_documents(both, group, work, "old_no int, new_no int, score double, basis string")


def ordered_occurrences(old: DataFrame, new: DataFrame, group: list[str], *, order: str = "unit_no") -> DataFrame:
    """Equal occurrences: those in a longest common order as ``kept``, equal ones elsewhere as ``moved``: group, old_no, new_no, kind."""

    def run(key: tuple, x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        x, y = x.sort_values(order).reset_index(drop=True), y.sort_values(order).reset_index(drop=True)
        kept = common_in_order(x.key.tolist(), y.key.tolist())
        rows = [(*key, int(x[order][i]), int(y[order][j]), "kept") for i, j in kept]
        old_used, new_used = {i for i, _ in kept}, {j for _, j in kept}
        free: dict[str, list[int]] = {}
        for j in range(len(y)):
            if j not in new_used:
                free.setdefault(y.key[j], []).append(j)
        for i in range(len(x)):
            if i not in old_used and free.get(x.key[i]):
                rows.append((*key, int(x[order][i]), int(y[order][free[x.key[i]].pop(0)]), "moved"))
        return pd.DataFrame(rows, columns=[*group, "old_no", "new_no", "kind"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in old.select(*group).schema)
    return grouped(old.select(*group, order, "key"), group).cogroup(grouped(new.select(*group, order, "key"), group)).applyInPandas(run, f"{schema}, old_no int, new_no int, kind string")


def containing_section(rows: DataFrame, sections: DataFrame, doc: list[str], *, page: str = "page_no") -> DataFrame:
    """rows with the ``ord`` of the section whose pages hold theirs: the deepest, then the one that starts last."""
    spread = sections.select(*doc, F.explode(F.sequence("start_page", "end_page")).alias(page), F.struct(F.size("number_path").alias("d"), "level", "start_page", "ord").alias("_s"))
    best = spread.groupBy(*doc, page).agg(F.max("_s").alias("_s"))
    return rows.join(best, [*doc, page], "left").withColumn("ord", F.col("_s.ord")).drop("_s")


def contained_boxes(inner: DataFrame, outer: DataFrame, page: list[str], *, cell: float = 64.0) -> DataFrame:
    """(inner columns, outer_id) where the inner box's centre lies in the outer box; a grid of cells is the join key."""
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("top") + F.col("bottom")) / 2
    a = inner.withColumns({"_x": x, "_y": y}).withColumns({"_cx": F.floor(F.col("_x") / cell), "_cy": F.floor(F.col("_y") / cell)})
    b = outer.select(*page, "outer_id", F.col("x0").alias("_x0"), F.col("x1").alias("_x1"), F.col("top").alias("_t"), F.col("bottom").alias("_b"))
    b = b.withColumn("_cx", F.explode(F.sequence(F.floor(F.col("_x0") / cell), F.floor(F.col("_x1") / cell)))).withColumn("_cy", F.explode(F.sequence(F.floor(F.col("_t") / cell), F.floor(F.col("_b") / cell))))
    met = a.join(b, [*page, "_cx", "_cy"]).filter((F.col("_x") >= F.col("_x0")) & (F.col("_x") <= F.col("_x1")) & (F.col("_y") >= F.col("_t")) & (F.col("_y") <= F.col("_b")))
    return met.select(*inner.columns, "outer_id")
