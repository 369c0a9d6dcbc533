import random

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SF
from variorum.functions.similarity import bounded_ratio
from variorum.operators import evidence, paired
from variorum.operators.identity import words


def moved(plan: str) -> int:
    """Exchanges of a plan before it runs."""
    return plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning") + plan.count("Exchange RoundRobin")


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["mutual_best_length", "exact_ratio", "inline_diff_spans", "character_bag_similarity", "evidence_alignment", "monotonic_assignment"])
def test_pairs_of_lines_never_cross_the_network(spark, name):
    # one exchange of the texts for each side, which AQE makes one; pairs are made where both sides are
    assert moved(plan(entry.queries()[name](spark, SF))) <= 2


def test_sharing_by_hand():
    old, new = ["the red fox", "red hen", ""], ["Red fox red", "a blue hen"]
    assert list(paired.sharing(old, new, 2)) == [(0, [0]), (1, [0, 1])]
    assert list(paired.sharing(old, new, 1)) == [(0, [0]), (1, [1])]


def test_only_best_leaves_ties_out():
    assert paired.only_best([(0, 0, 0.9), (0, 1, 0.8), (1, 1, 0.8), (2, 2, 0.5), (2, 3, 0.5)]) == [(0, 0, 0.9)]


def test_evidence_moves_ids_only(spark):
    # beside the two exchanges of the texts, those of the counted ids
    assert moved(plan(entry.queries()["evidence_conservation"](spark, SF))) <= 4


@pytest.mark.parametrize("name", ["evidence_conservation", "evidence_alignment"])
def test_evidence_deals_texts_once(spark, name):
    # texts leave for both sides alike, so that one exchange serves them; of what is found only a count for each document moves
    found = entry.queries()[name](spark, SF)
    found.collect()
    final = plan(found).split("== Initial Plan ==")[0]
    reused = final.count("ReusedExchange")
    assert reused and moved(final) - reused <= (2 if name == "evidence_conservation" else 1)


def test_conservation_of_null_documents_and_repeated_ids(spark):
    units = lambda rows: spark.createDataFrame(rows, "doc int, ord int, occurrence_id string, text string, role string, risks array<string>")
    old = units([(None, 0, "a", "x", "body", []), (1, 0, "b", "x", "body", []), (1, 1, "b", "y", "body", [])])
    new = units([(None, 0, "c", "x", "body", []), (1, 0, "d", "x", "body", [])])
    assert sorted(map(tuple, evidence.conservation(old, new, ["doc"]).collect()), key=str) == [(1, 1, 1, False), (None, 1, 1, True)]


def sides_by_chance(rnd: random.Random, most: int) -> tuple[list[str], list[str]]:
    drawn = lambda: " ".join(rnd.choice(["red", "fox", "the", "blue", "cat7", "zeta-9", "12"]) for _ in range(rnd.randint(1, 5))) + "x" * rnd.randint(0, 3)
    return [drawn() for _ in range(rnd.randint(1, most))], [drawn() for _ in range(rnd.randint(1, most))]


def test_best_lengths_whatever_the_number_of_lines_with_a_word():
    # 40 lines share a word; beyond 32 none of its pairs were looked at
    old, new = ["common " + "a" * (5 * k + 1) for k in range(40)], ["common " + "b" * (5 * k + 2) for k in range(40)]
    assert sorted((i, j) for i, j, _ in paired.best_length_pairs()(range(40), old, range(40), new)) == [(k, k) for k in range(40)]
    rnd = random.Random(5)
    for _ in range(60):
        x, y = sides_by_chance(rnd, 45)
        want = paired.only_best((i, j, paired.length_score(len(s), len(t))) for i, s in enumerate(x) for j, t in enumerate(y) if words(s) & words(t))
        assert sorted(paired.best_length_pairs()(range(len(x)), x, range(len(y)), y)) == sorted(want)


def test_mutual_best_length_of_a_long_document_as_its_sql(spark, tmp_path):
    text = "\n".join("common " + "word " * (k % 7) + "y" * k for k in range(60))
    spark.createDataFrame([(1, text, "en", "s", len(text))], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql("SELECT doc_id, old_ord, new_ord, round(score, 6) FROM (" + entry.oracle_sql()["mutual_best_length"] + ")").fetchall()
    got = entry.queries()["mutual_best_length"](spark, str(tmp_path)).collect()
    assert want and sorted((r.doc_id, r.old_ord, r.new_ord, round(r.score, 6)) for r in got) == sorted(want)


def test_ratios_of_all_pairs_whose_lengths_allow_them(monkeypatch):
    # no word in common, and a word that 40 lines have: neither was compared
    found = {(i, j): r for i, j, r in paired.ratio_pairs(0.72)(range(41), ["1234567890"] + ["common " + "ab" * k for k in range(40)], range(41), ["1234567891"] + ["common " + "ab" * k for k in range(40)])}
    assert found[0, 0] == 0.9 and all(found[k, k] == 1 for k in range(1, 41))
    rnd = random.Random(6)
    for pack in (1, 60, paired.PACK):
        monkeypatch.setattr(paired, "PACK", pack)
        for _ in range(30):
            x, y = sides_by_chance(rnd, 12)
            x[0], y[0] = "", "ß\U0001f98a𝔘 " + y[0]
            want = [(i, j, bounded_ratio(s, t, 0.72)) for i, s in enumerate(x) for j, t in enumerate(y) if paired.length_score(len(s), len(t)) >= 0.72]
            assert sorted(paired.ratio_pairs(0.72)(range(len(x)), x, range(len(y)), y)) == want
