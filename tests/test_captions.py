from itertools import combinations

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from variorum.operators import captions


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=7), st.lists(st.sampled_from("abc"), max_size=7))
def test_common_order_is_longest(a, b):
    pairs = captions.common_order(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    parts = {tuple(a[i] for i in c) for n in range(len(a) + 1) for c in combinations(range(len(a)), n)}
    want = max(len(p) for p in parts if p in {tuple(b[j] for j in c) for c in combinations(range(len(b)), len(p))})
    assert len(pairs) == want


def tables(spark, rows):
    return spark.createDataFrame(rows, "doc int, table_id string, caption string")


def test_core_groups(spark):
    old = tables(spark, [(1, "a", "Table 1 Limits of the transmit clock, part one"), (1, "b", "Table 2 Limits of the transmit clock, part two"), (1, "c", "Table 3 Colours"), (2, "a", "Table 1 x y z w"), (2, "b", "Table 1 x y z w")])
    new = tables(spark, [(1, "p", "Table 1 Limits of the transmit clock for lanes"), (1, "q", "Table 2 Limits of the transmit clock for pads"), (1, "r", "Table 3 Limits of the transmit clock at rest"), (2, "p", "Table 1 x y z w"), (2, "q", "Table 2 x y z w v")])
    got = captions.core_groups(old, new, ["doc"]).collect()
    assert [(r.doc, r.old_tables, r.new_tables, r.core) for r in got] == [(1, ["a", "b"], ["p", "q", "r"], "limits of the transmit clock")]


def test_a_core_of_four_tables_is_no_group(spark):
    rows = [(1, k, f"Table {k} the same four words {k}x") for k in "abcd"]
    assert captions.core_groups(tables(spark, rows), tables(spark, rows), ["doc"]).isEmpty()


def test_family_map(spark):
    rows = lambda family, order: [(1, order[k], family, d) for k, d in enumerate(("one", "two", "three"))]
    frame = lambda x: spark.createDataFrame(x, "doc int, ord int, family string, descriptor string")
    found = captions.family_map(frame(rows("3", [1, 2, 3])), frame(rows("4", [5, 6, 9])), ["doc"]).collect()
    assert [tuple(r) for r in found] == [(1, "3", "4", 3)]
    assert captions.family_map(frame(rows("3", [1, 2, 3])), frame(rows("4", [6, 5, 9])), ["doc"]).isEmpty()
    torn = [(1, 7, "3", "four")], [(1, 10, "8", "four")]
    assert captions.family_map(frame(rows("3", [1, 2, 3]) + torn[0]), frame(rows("4", [5, 6, 9]) + torn[1]), ["doc"]).isEmpty()


def test_aligned_runs(spark):
    frame = lambda x: spark.createDataFrame([(1, c, k, f"{c}{k}", v) for c, vs in x.items() for k, v in enumerate(vs)], "doc int, caption string, ord int, table_id string, content string")
    got = captions.aligned_runs(frame({"A": "xyz", "B": "x"}), frame({"A": "yzw", "B": "x"}), ["doc"]).collect()
    assert sorted(map(tuple, got)) == [(1, "A", "A1", "A0"), (1, "A", "A2", "A1")]  # B comes once on both sides


def test_page_pairs(spark):
    frame = lambda x: spark.createDataFrame([(d, k, t) for d, ts in x.items() for k, t in enumerate(ts)], "doc int, page_no int, key string")
    got = captions.page_pairs(frame({1: ["a", "", "a"], 2: ["a", "b", "b"], 3: ["q"]}), frame({1: ["a", "", "a"], 2: ["x", "a", "b"], 3: ["q"]}), ["doc"]).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 0, "equal_sequence"), (1, 1, 1, "equal_sequence"), (1, 2, 2, "equal_sequence"), (2, 0, 1, "unique_text"), (3, 0, 0, "unique_text")]


def test_row_reasons_leave_real_changes(spark):
    cell = "array<struct<label:string,value:string>>"
    rows = [([("Value", "4 0")], [("Value", "40")], "digit_spacing"), ([("Value", "40")], [("Value", "41")], None), ([("Unit", "mV")], [("Unit", "V")], None), ([("Unit", "mV")], [("Units", "mV")], None), ([("A", "x")], [("A", "x")], None), ([("A", "Below 10 GHz")], [("A", "Below10GHz")], "layout")]
    frame = spark.createDataFrame([(k, a, b) for k, (a, b, _) in enumerate(rows)], f"k int, a {cell}, b {cell}")
    got = {r.k: r.r for r in frame.select("k", captions.row_review_reason(F.col("a"), F.col("b")).alias("r")).collect()}
    assert got == {k: r[2] for k, r in enumerate(rows)}


def test_refill_counts_occurrences(spark):
    shown = spark.createDataFrame([(1, "a", 0)], "g int, t string, o int")
    audit = spark.createDataFrame([(1, "a", 0), (1, "a", 3), (1, "b", 2), (1, "c", 1)], "g int, t string, o int")
    got = captions.refilled(shown, audit, ["g"], "t", "o", 3).collect()
    assert sorted((r.t, r.o) for r in got) == [("a", 0), ("b", 2), ("c", 1)]
    assert captions.refilled(shown, audit, ["g"], "t", "o", 0).isEmpty()
