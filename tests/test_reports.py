import csv
import json

import pytest

from variorum.operators import tables
from variorum.sources import sinks

CHANGES = "doc_id int, old_ord long, new_ord long, change_type string, role string, basis string, similarity double, review_reason string, old_heading string, new_heading string, old_page int, new_page int, old_body string, new_body string"


def changes(spark):
    return spark.createDataFrame(
        [
            (1, 1, 1, "modified", "technical", "x", 0.9, None, "1 A", "1 A", 1, 1, "limit 5 <mV>", "limit 6 <mV>"),
            (1, 2, None, "deleted", "technical", None, None, None, "2 B", None, 2, None, "gone & lost", None),
            (1, 3, 3, "unchanged", "technical", "x", 1.0, None, "3 C", "3 C", 3, 3, "same", "same"),
        ],
        CHANGES,
    )


def test_html_report(spark):
    page = sinks.html_report(changes(spark))
    assert "limit <del>5</del> &lt;mV&gt;" in page and "limit <ins>6</ins> &lt;mV&gt;" in page
    assert "gone &amp; lost" in page and "3 C" not in page


def test_reports_are_all_or_none(spark, tmp_path):
    bundle = {"changes": changes(spark), "view": changes(spark).filter("change_type = 'modified'")}
    out = f"file://{tmp_path}/out"
    with pytest.raises(ValueError):
        sinks.write_reports(bundle, out, ("csv", "pdf"))
    assert not (tmp_path / "out").exists()
    assert sinks.write_reports(bundle, out) == [f"{out}/{f}" for f in sinks.FORMATS]
    rows = [r for f in (tmp_path / "out/csv/changes").glob("*.csv") for r in csv.DictReader(f.open())]
    assert sorted(r["change_type"] for r in rows) == ["deleted", "modified", "unchanged"]
    lines = [json.loads(x) for f in (tmp_path / "out/json/view").glob("*.json") for x in f.read_text().splitlines()]
    assert [x["new_body"] for x in lines] == ["limit 6 <mV>"]
    with pytest.raises(FileExistsError):
        sinks.write_reports(bundle, out)


def test_appendix(spark, tmp_path):
    sinks.write_appendix(changes(spark).filter("similarity >= 1"), changes(spark).select("doc_id", "similarity").filter("similarity >= 1"), f"file://{tmp_path}/exact", single=True)
    for name in ("sections", "tables"):
        rows = [r for f in (tmp_path / "exact" / name).glob("*.csv") for r in csv.DictReader(f.open())]
        assert [r["similarity"] for r in rows] == ["1.000000"]


def test_table_stages_on_captions(spark):
    cols, cells = "doc int, page_no int, line_no int, line string", lambda v: f"n{v} | {v}"

    def side(family, tables_, extra):
        out = []
        for no, (name, value) in enumerate(tables_, 1):
            out += [f"Table {family}.{no} {name}", "Name | Limit", cells(value), ""]
        for name, value in extra:
            out += [name, "Name | Size | Limit", f"q | {value} | 1", ""]
        return spark.createDataFrame([(1, 1, k, x) for k, x in enumerate(out)], cols)

    names = [("Clock limits", 1), ("Power limits", 2), ("Pin limits", 3)]
    old = side("3", names, [("Table 9", 50), ("Table 9", 60)])
    new = side("4", names, [("Table 9", 40), ("Table 9", 50), ("Table 9", 60)])
    captioned = lambda x: tables.captioned_tables(x, ["doc"])
    got = tables.compare_tables(captioned(old), captioned(new), ["doc"])[0].collect()
    by = {}
    for r in got:
        by.setdefault(r.basis, []).append((r.old_caption, r.new_caption))
    assert sorted(by["cross_clause"]) == sorted((f"Table 3.{k} {n}", f"Table 4.{k} {n}") for k, (n, _) in enumerate(names, 1))
