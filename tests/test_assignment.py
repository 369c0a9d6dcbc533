import itertools
import random

from variorum.operators import match
from variorum.operators.assignment import Candidate, common_in_order, greedy_pairs, monotonic_pairs, rising_chain


def test_monotonic_pairs_against_all_choices():
    r = random.Random(2)
    for _ in range(60):
        n, m = r.randint(0, 4), r.randint(0, 4)
        s = {(i, j): r.choice([None, 0.0, 1.0, 2.0, 3.0]) for i in range(n) for j in range(m)}
        got = monotonic_pairs(n, m, lambda i, j: s[i, j])
        assert all(a < c and b < d for (a, b), (c, d) in itertools.pairwise(got))
        best = 0.0
        for k in range(min(n, m) + 1):
            for a in itertools.combinations(range(n), k):
                for b in itertools.combinations(range(m), k):
                    w = [s[p] for p in zip(a, b)]
                    if all(x is not None and x > 0 for x in w):
                        best = max(best, sum(w))
        assert sum(s[p] for p in got) == best


def chains(pairs):
    for k in range(len(pairs) + 1):
        for pick in itertools.combinations(sorted(pairs, key=lambda x: (x.old, x.new)), k):
            if all(a.old < b.old and a.new < b.new for a, b in itertools.pairwise(pick)):
                yield round(sum(x.score - 0.72 for x in pick), 9), k


def test_rising_chain_against_all_choices():
    r = random.Random(3)
    for _ in range(150):
        c = {(x.old, x.new): x for x in (Candidate(r.choice([0.75, 0.8, 0.9, 0.95]), r.randrange(5), r.randrange(5), "similarity_fallback") for _ in range(r.randint(0, 8)))}
        got = rising_chain(c.values())
        assert all(a.old < b.old and a.new < b.new for a, b in itertools.pairwise(got))
        assert (round(sum(x.score - 0.72 for x in got), 9), len(got)) == max(chains(c.values()))


CANDIDATES, ANCHORS = "g int, old_ord long, new_ord long, score double, basis string", "g int, old_ord long, new_ord long"


def solved(spark, candidates, anchors=()):
    found = match.solve(spark.createDataFrame(candidates, CANDIDATES), spark.createDataFrame(list(anchors), ANCHORS), ["g"]).collect()
    return {g: sorted((r.old_ord is None, r.old_ord, r.new_ord is None, r.new_ord, r.basis) for r in found if r.g == g) for g in {c[0] for c in candidates}}


def test_crossing_best_pairs_are_conflicts(spark):
    got = solved(spark, [(1, 0, 1, 0.9, "x"), (1, 1, 0, 0.9, "x"), (1, 2, 2, 0.8, "x")])[1]
    no = "ambiguous_order_conflict"
    assert got == sorted([(False, 0, True, None, no), (False, 1, True, None, no), (True, None, False, 0, no), (True, None, False, 1, no), (False, 2, False, 2, "x")])


def test_anchors_bound_candidates(spark):
    got = solved(spark, [(1, 0, 3, 0.9, "x"), (1, 0, 0, 0.8, "x"), (2, 5, 5, 0.9, "x")], [(1, 1, 1), (2, 0, 1), (2, 1, 0)])
    assert got == {1: [(False, 0, False, 0, "x")], 2: []}


def test_the_strongest_proof_counts(spark):
    got = match.solve(spark.createDataFrame([(1, 0, 0, 0.99, "similarity_fallback"), (1, 0, 0, 0.8, "similarity_exact")], CANDIDATES), spark.createDataFrame([], ANCHORS), ["g"]).collect()
    assert [(r.score, r.basis) for r in got] == [(0.8, "similarity_exact")]


def test_closure_of_a_deep_chain(spark):
    paths = [(1, list(range(k + 1)), list(range(k + 1))) for k in range(15)] + [(1, [9, 9], [9, 9])]
    assert match.trusted_parents(spark.createDataFrame(paths, "g int, old_path array<int>, new_path array<int>"), ["g"]).count() == 15


def test_common_in_order_and_greedy():
    assert common_in_order(list("abcd"), list("acbd")) in ([(0, 0), (1, 2), (3, 3)], [(0, 0), (2, 1), (3, 3)])
    assert greedy_pairs(2, 2, [(0.9, 0, 1), (0.9, 0, 0), (0.5, 1, 1), (0.3, 1, 0)]) == [(0, 0, 0.9), (1, 1, 0.5)]
