import math
import random

import pytest

from variorum.functions import similarity as S
from variorum.operators import delta, geometry, match, segment, tables

WORDS = "d int, page_no int, text string, x0 double, top double, x1 double, bottom double, size double, angle double, page_width double, page_height double"


def words(spark, rows):
    """(page, text, x0, top) or (page, text, x0, top, size, angle)"""
    full = [(1, r[0], r[1], float(r[2]), float(r[3]), float(r[2]) + 30, float(r[3]) + 10, *(map(float, r[4:6]) if len(r) > 4 else (10.0, 0.0)), 600.0, 800.0) for r in rows]
    return spark.createDataFrame(full, WORDS)


def test_valid_words(spark):
    rows = [(1, 1, t, *box, 10.0, 0.0, 600.0, 800.0) for t, box in [("ok", (1.0, 1.0, 2.0, 2.0)), (" ", (1.0, 1.0, 2.0, 2.0)), ("a", (None, 1.0, 2.0, 2.0)), ("b", (math.nan, 1.0, 2.0, 2.0)), ("c", (3.0, 1.0, 2.0, 2.0)), ("d", (700.0, 1.0, 720.0, 2.0)), (None, (1.0, 1.0, 2.0, 2.0))]]
    good, bad = geometry.valid_words(spark.createDataFrame(rows, WORDS))
    assert [r.text for r in good.collect()] == ["ok"]
    assert sorted(r.warning for r in bad.collect()) == ["blank_text", "blank_text", "empty_box", "missing_place", "not_finite", "outside_page"]


@pytest.mark.parametrize("places, rule", [((500, 50), "alternating"), ((285, 285), "one_side"), ((500, 285), None)])
def test_folio_runs(spark, places, rule):
    rows = [(p, str(p + 9), places[p % 2 == 0], 770) for p in range(1, 6)] + [(p, "12", 100, 400) for p in range(1, 6)]
    got = geometry.folio_runs(words(spark, rows), ["d"]).collect()
    assert [(r.offset, r.first_page, r.last_page, r.pages, r.side_rule) for r in got] == ([(9, 1, 5, 5, rule)] if rule else [])
    # a number that isn't on four pages of five is no page number
    assert geometry.folio_runs(words(spark, [r for r in rows if r[0] != 2 and r[0] != 4 or r[1] == "12"]), ["d"]).isEmpty()


def test_gutters(spark):
    rows = [(p, str(k + 1), 20, 100 + 20 * k) for p in (1, 2, 3) for k in range(5)] + [(p, "7", 300, 100) for p in (1, 2, 3)]
    found = geometry.line_number_gutters(words(spark, rows), ["d"])
    assert [(r.pages, r.numbers) for r in found.collect()] == [(3, 15)]
    assert {r.text for r in geometry.without_gutters(words(spark, rows), found, ["d"]).collect()} == {"7"}


def test_watermarks(spark):
    rows = [(1, w, 50 * k, 100) for k, w in enumerate("some body text of a page".split())] + [(1, "NOT", 100, 500, 60, 45), (1, "FINAL", 300, 300, 60, 45), (1, "slanted", 10, 10, 10, 45)]
    found = geometry.watermarks(words(spark, rows), ["d", "page_no"])
    assert [(r.text, r.words) for r in found.collect()] == [("NOT FINAL", 2)]
    assert geometry.without_watermarks(words(spark, rows), found, ["d", "page_no"]).count() == len(rows) - 2


def test_columns(spark):
    rows = [(1, "Title", 20, 10)] + [(1, f"l{k}", 50, 100 + 20 * k) for k in range(6)] + [(1, f"r{k}", 400, 100 + 20 * k) for k in range(6)] + [(2, f"x{k}", 20 * k, 100) for k in range(28)]
    w = words(spark, rows)
    split = geometry.column_split(w, ["d", "page_no"])
    assert [(r.page_no, r.left, r.right, r.crossing) for r in split.collect()] == [(1, 7, 6, 0)]
    order = [r.text for r in geometry.column_order(w, split, ["d", "page_no"]).filter("page_no = 1").orderBy("place").collect()]
    assert order == ["Title", *[f"l{k}" for k in range(6)], *[f"r{k}" for k in range(6)]]
    assert [r.text for r in geometry.column_order(w, split, ["d", "page_no"]).filter("page_no = 2").orderBy("place").collect()] == [f"x{k}" for k in range(28)]


def test_covered_share_against_a_grid(spark):
    r = random.Random(4)
    boxes = [(p, float(x), float(y), float(x + r.randint(0, 9)), float(y + r.randint(0, 9)), 20.0, 15.0) for p in range(6) for x, y in [(r.randint(-3, 18), r.randint(-3, 14)) for _ in range(7)]]
    got = {x.p: x.covered for x in geometry.covered_share(spark.createDataFrame(boxes, "p int, x0 double, top double, x1 double, bottom double, page_width double, page_height double"), ["p"]).collect()}
    for p in range(6):
        cells = {(i, j) for q, x0, y0, x1, y1, *_ in boxes if q == p for i in range(max(0, int(x0)), min(20, int(x1))) for j in range(max(0, int(y0)), min(15, int(y1)))}
        assert math.isclose(got.get(p, 0.0), len(cells) / 300, abs_tol=1e-9)


def test_ocr_gate_and_same_place(spark):
    schema = "p int, x0 double, top double, x1 double, bottom double, page_width double, page_height double"
    box = lambda p, a, b, c, d: (p, float(a), float(b), float(c), float(d), 10.0, 10.0)
    got = geometry.ocr_gate(spark.createDataFrame([box(1, 0, 0, 10, 6), box(2, 0, 0, 10, 6), box(3, 0, 0, 3, 3)], schema), spark.createDataFrame([box(2, 0, 0, 10, 8)], schema), ["p"])
    assert {r.p: r.ocr for r in got.collect()} == {1: True, 2: False, 3: False}
    r = random.Random(6)
    side = lambda: [(1, p, f"{p}{k}", *(float(r.randint(0, 200)) for _ in range(4))) for p in (1, 2) for k in range(40)]
    a, b, cols = side(), side(), "d int, page_no int, box_id string, x0 double, top double, x1 double, bottom double"
    pairs = geometry.same_place_pairs(spark.createDataFrame(a, cols), spark.createDataFrame(b, cols), ["d"], spark.createDataFrame([(1, 1, 2), (1, 2, 1)], "d int, old_page int, new_page int"), tolerance=60.0)
    want = {(x[2], y[2]) for x in a for y in b if x[1] == 3 - y[1] and all(abs(m - n) <= 60 for m, n in zip(x[3:], y[3:]))}
    assert {(x.old_id, x.new_id) for x in pairs.collect()} == want and want


def test_visual_noise(spark):
    rows = spark.createDataFrame([("3.5 4.0 4.5",), ("GHz",), ("(mV)",), ("x",), ("....",), ("+ = )",), ("a word",), ("Gain 3 dB",)], "line string")
    assert {r.line for r in rows.filter(geometry.visual_noise(rows["line"])).collect()} == {"3.5 4.0 4.5", "GHz", "(mV)", "x", "....", "+ = )"}


# --- sections and tables


def sections(spark, rows):
    """(ord, number path, title, body)"""
    schema = "d int, ord long, number_path array<string>, title string, level int, body string, identity_key string, heading_path array<string>"
    return spark.createDataFrame([(1, o, list(n), t, len(n), b, "/".join(n) + t, [t]) for o, n, t, b in rows], schema)


def test_each_rescue(spark):
    old = sections(spark, [(0, "1", "a", "x"), (1, "2", "mid", "p q r"), (2, "3", "b", "y"), (3, "4", "par", "z"), (4, ["4", "1"], "c1", "k"), (5, ["4", "2"], "c2", "l"), (6, ["4", "3"], "c3", "m"), (7, ["4", "9"], "last", "n")])
    new = sections(spark, [(0, "1", "a", "x"), (1, "2", "mid", "v w"), (2, "3", "b", "y"), (3, "5", "par", "z"), (4, ["5", "2"], "c1", "k"), (5, ["5", "3"], "c2", "l"), (6, ["5", "4"], "c3", "M"), (7, ["5", "8"], "last", "N")])
    held = spark.createDataFrame([(1, o, o) for o in (0, 2, 3, 4, 5)], "d int, old_ord long, new_ord long")
    got = {(r.old_ord, r.new_ord): r.basis for r in match.rescued(old, new, held, ["d"]).collect()}
    assert got == {(1, 1): "structural_neighbours", (6, 6): "numbering_shift", (7, 7): "mapped_parent_child"}


def test_sections_that_blocking_passes_over(spark):
    """Forty sections of common words; one moved by twenty places and edited: no rare word and no near place leads to it."""
    r = random.Random(7)
    common = [f"word{c}" for c in "abcdefghij"]
    body = lambda: " ".join(r.choices(common, k=40))
    rows = [(k, str(k + 1), f"Title {common[k % 10]}", body()) for k in range(40)]
    kept = rows[:10] + rows[30:]
    moved = rows[5][3].split()
    moved[3] = "wordj"
    new = [(k, str(60 + k), t, b) for k, (_, _, t, b) in enumerate([*rows[30:], (0, "", rows[5][2], " ".join(moved))])]
    got = match.match_sections(sections(spark, rows[:1] + [rows[5]]), sections(spark, new), ["d"]).collect()
    assert any(x.old_ord == 5 and x.new_ord == len(new) - 1 for x in got) and len(kept) == 20
    lengths = lambda x: [(o, len(b)) for o, _, _, b in x]
    short = [(k, str(k), "t", "x" * n) for k, n in enumerate((0, 1, 2, 3, 5, 8, 13, 21, 34, 55, 90, 91))]
    pairs = {(x.old_ord, x.new_ord) for x in match.length_pairs(sections(spark, short), sections(spark, short), ["d"], 0.72).collect()}
    assert pairs == {(i, j) for i, a in lengths(short) for j, b in lengths(short) if 2 * min(a, b) >= 0.72 * (a + b)}


def test_folded_children_are_not_gone(spark):
    text = "The parent's own text that is long enough to be the only one of its kind here."
    old = sections(spark, [(0, "1", "par", text), (1, ["1", "1"], "kid", "what the child says")])
    new = sections(spark, [(0, "1", "par", text + " what the child says and more")])
    got = {r.old_ord: r.basis for r in match.match_sections(old, new, ["d"]).collect()}
    assert got[0] == "similarity_exact" and got[1] == "folded_into_parent"


def test_sentences_keep_their_digits(spark):
    """The place of a sentence or cell is no argument of trim."""
    rows = spark.createDataFrame([(1, 0, "gain | 1 | dB"), (1, 1, "2 | 2 | 2")], "d int, line_no int, line string")
    assert [r.cells for r in tables.text_tables(rows, ["d"], ["line_no"]).orderBy("row_no").collect()] == [["gain", "1", "dB"], ["2", "2", "2"]]
    one = spark.createDataFrame([("The first is here. 1 of them is one. It ends with 2",)], "t string")
    assert one.select(segment.sentences(one["t"]).alias("s")).first().s == ["The first is here.", "1 of them is one.", "It ends with 2"]


def lines_of(spark, pages):
    return spark.createDataFrame([(1, p, k, t) for p, text in enumerate(pages, 1) for k, t in enumerate(text)], "d int, page_no int, line_no int, line string")


def test_tables_over_pages(spark):
    head = "Name | Max"
    old = lines_of(spark, [["Table 1 Limits", head, "speed | 5", "power | 7"], [head, "gain | 1", "text", "Table 2 Steps", "Step | Do", "one | go", "two | stop"]])
    new = lines_of(spark, [["Table 1 Limits", head, "speed | 6", "power | 7", "gain | 1"], ["Table 2 Steps", "Step | Do", "two | stop", "one | go"]])
    found, rows = tables.captioned_tables(old, ["d"])
    assert sorted((r.caption, r.page_no) for r in found.collect()) == [("Table 1 Limits", 1), ("Table 2 Steps", 2)] and rows.count() == 7
    changes, kinds = tables.compare_tables((found, rows), tables.captioned_tables(new, ["d"]), ["d"])
    assert {r.old_caption: (r.change_type, r.changed_rows, r.order_changed) for r in changes.collect()} == {"Table 1 Limits": ("modified", 1, False), "Table 2 Steps": ("review", 0, True)}
    assert sorted(r.kind for r in kinds.collect()) == ["unchanged"] * 5 + ["value_changed"]


def test_reader_view_and_windows(spark):
    cols = "d int, old_ord long, new_ord long, change_type string, review_reason string, old_heading string, new_heading string, old_body string, new_body string"
    changes = spark.createDataFrame([(1, 0, 0, "modified", None, "2 Limits", "3 Limits", "x", "x"), (1, 1, 1, "modified", None, "2 Limits", "3 Bounds", "x", "x"), (1, None, 2, "added", None, None, "", None, "y")], cols)
    assert {r.new_ord for r in delta.number_only_headings(changes).collect()} == {1, 2}
    sections = spark.createDataFrame([(1, "new", 2, 0), (1, "new", 1, 1)], "d int, side string, ord int, level int")
    told = {r.new_ord: (r.change_type, r.review_reason) for r in delta.boundary_prelude(changes, sections, ["d"], old_window=False, new_window=True).collect()}
    assert told == {0: ("modified", None), 1: ("modified", None), 2: ("review", "window_boundary")}
    snippets = spark.createDataFrame([(1, 1, "== 7"), (1, 2, "words here")], "d int, snippet_id int, text string")
    pages = spark.createDataFrame([(1, 4, "a == 7 b"), (1, 5, "some words here")], "d int, page_no int, text string")
    assert {r.snippet_id: r.page_no for r in delta.locate_snippets(snippets, pages, ["d"]).collect()} == {1: 4, 2: 5}


def test_sections_are_compared_whole(spark):
    """Bodies that differ only where 1,200 sampled characters are taken: the first, middle and last ones."""
    r = random.Random(8)
    text = lambda n, letters: "".join(r.choice(letters) for _ in range(n))
    common = [text(2200, "abcdefgh ") for _ in range(2)]
    old = sections(spark, [(0, "1", "Limits", text(490, "klmn") + common[0] + text(380, "klmn") + common[1] + text(380, "klmn"))])
    new = sections(spark, [(3, "7", "Limits", text(490, "wxyz") + common[0] + text(380, "wxyz") + common[1] + text(380, "wxyz"))])
    got = [(x.old_ord, x.new_ord, x.basis) for x in match.match_sections(old, new, ["d"]).collect()]
    assert got == [(0, 3, "similarity_fallback")]


def test_similar_sections_are_those_of_all_pairs():
    r = random.Random(9)
    words = ["alpha", "beta", "gamma", "delta", "Omega", "12"]

    def side() -> list[match.Told]:
        texts = [" ".join(r.choice(words) for _ in range(r.randint(0, 9))) for _ in range(12)]
        return [match.Told(k, str(k), None, r.choice(words), r.choice(words), x, x, len(x), []) for k, x in enumerate(texts)]

    for least in (0.3, 0.72, 0.9):
        for _ in range(20):
            old, new = side(), side()
            want = {}
            for a in old:
                for b in new:
                    title, place, body = S.exact_ratio(a.title, b.title), S.exact_ratio(a.location, b.location), S.exact_ratio(a.body.lower(), b.body.lower())
                    score = max(0.85 * title + 0.15 * body, 0.4 * place + 0.6 * body)
                    if body >= least and score >= least:
                        want[a.ord, b.ord] = score
            assert {(a.ord, b.ord): score for a, b, score, _ in match.similarity_candidates(old, new, least)} == want
            assert {(a.ord, b.ord) for a, b, _, _ in match.similarity_candidates(old, new, least, set(list(want)[1:]))} == set(list(want)[:1])


def test_sections_are_dealt_once(spark):
    rows = sections(spark, [(0, "1", "a", "x"), (1, "2", "b", "y")])
    plan = match.solved_sections(rows, rows, ["d"], match.SECTION)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2
