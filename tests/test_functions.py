import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from variorum.functions import similarity as S
from variorum.functions import text as T


def one(spark, c, **values):
    row = spark.createDataFrame([tuple(values.values())], [*values])
    return row.select(c.alias("x")).first().x


@pytest.mark.parametrize(
    "a, b, equal",
    [
        ("The limit is 1.0 ps.", "the limit is 1.0 ps", True),
        ("The limit is 1.0 ps.", "The limit is 10 ps.", False),
        ("offset +3.0", "offset -3.0", False),
        ("MODE_FAST is set", "mode_fast is set", False),
        ("use seven samples", "use 7 samples", True),
        ("Gen seven link", "Gen 7 link", False),
        ("a <= b", "a ≤ b", True),
        ("a <= b", "a >= b", False),
        ("x² rises", "x2 rises", False),
        ("code 007", "code 7", False),
        ("• item one", "item one", True),
        ("version 1.2.3 ships", "version 1.2.4 ships", False),
        ("5 V supply", "5V supply", True),
        ("七个样本", "7个样本", True),
        ("", "", True),
    ],
)
def test_unit_key(a, b, equal):
    assert (T.unit_key(a) == T.unit_key(b)) is equal


def test_number_words():
    assert T.counted_words("two thousand five hundred units".split()) == ["2500", "units"]
    assert T.counted_words("one hundred and five bits".split()) == ["105", "bits"]
    assert T.counted_words("twenty-one pins".split()) == ["21", "pins"]
    assert T.counted_words("table seven shows".split()) == ["table", "seven", "shows"]
    assert T.chinese_number("一百零五") == 105 and T.chinese_number("两千") == 2000 and T.chinese_number("三万") == 30_000
    assert T.chinese_counts("第七章 一体化 十二个") == "第 7 章 一体化 12个"


def test_columns(spark):
    v = F.col("v")
    assert one(spark, T.collapsed(v), v=" a\u00a0\t b\n") == "a b"
    assert one(spark, T.canonical_number(v), v="+1,000.50") == "1000.50"
    assert one(spark, T.literal_atoms(v), v="MODE_A/b -1.5e3 字x ≤") == ["MODE_A/b", "-1.5e3", "字", "x", "≤"]
    assert one(spark, T.assignment_field(v), v="Max voltage = 3.3 V") == "max voltage"
    assert one(spark, T.assignment_field(v), v="a = b = c") == ""
    assert [one(spark, T.priority(v), v=x) for x in ("3 V", "lane ts1 on", "it is so", "words only")] == [4, 4, 2, 1]
    assert one(spark, T.caption_number(v), v="Table 3–2: Limits (continued)") == "3-2"
    assert one(spark, T.caption_descriptor(v), v="Table 3-2: Limits (continued)") == "limits"
    assert one(spark, T.is_page_counter(v), v="Page 2 of 14") is True and one(spark, T.is_page_counter(v), v="Page layout") is False
    assert one(spark, T.cosmetic_key(v), v="5  GHz band") == one(spark, T.cosmetic_key(v), v="5GHz band")
    assert one(spark, T.neutral_emails(v), v="mail a.b@c.org now") == "mail [email] now"
    assert one(spark, T.change_natures(v, F.lit(True)), v="step 3 in section B at 5 mV") == ["step", "reference", "limit", "wording"]
    assert len(one(spark, T.sampled(v), v="x" * 5000)) == 1200
    assert one(spark, T.dotted_identifiers(v), v="v1.2.3 and 1.50 and a.txt") == ["v1.2.3", "a.txt"]


def test_row_codec(spark):
    cells = [("a=b|c\\", "x | y\nz="), ("n", "\\n \\\\ q")]
    rows = spark.createDataFrame([(cells,)], "c array<struct<label:string,value:string>>")
    back = rows.select(T.decoded_row(T.encoded_row(F.col("c"))).alias("d")).first().d
    assert [(x.label, x.value) for x in back] == cells


def test_split_long():
    parts = T.split_long("First sentence here. " * 80)
    assert all(len(p) <= 720 for p in parts) and " ".join(parts) == ("First sentence here. " * 80).strip()
    assert [len(p) for p in T.split_long("x" * 1500)] == [720, 720, 60]


def test_ratio_and_bounds(spark):
    r = random.Random(1)
    pairs = [("".join(r.choices("abcde ", k=r.randint(0, 30))), "".join(r.choices("abcde ", k=r.randint(0, 30)))) for _ in range(200)]
    for a, b in pairs:
        exact = SequenceMatcher(None, a, b, autojunk=False).ratio()
        assert S.exact_ratio(a, b) == exact
        assert S.bounded_ratio(a, b, 0.5) in (0.0, exact)
        size = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                size[i + 1][j + 1] = size[i][j] + 1 if x == y else max(size[i][j + 1], size[i + 1][j])
        assert S.lcs_length(a, b) == size[-1][-1]
        edits = len(a) + len(b) - 2 * size[-1][-1]
        assert S.within_edits(a, b, edits) and not (edits and S.within_edits(a, b, edits - 1))
    rows = spark.createDataFrame(pairs, "a string, b string")
    for row in rows.select("a", "b", S.length_bound(F.col("a"), F.col("b")).alias("l"), S.character_bound(F.col("a"), F.col("b")).alias("c"), S.exact_ratio_udf("a", "b").alias("r")).collect():
        assert row.r <= row.c + 1e-12 <= row.l + 2e-12


def test_blocks_are_those_of_difflib():
    dice = random.Random(3)
    for k in range(600):
        letters = ("ab", "abc ", "abcdefgh ")[k % 3]
        a = "".join(dice.choice(letters) for _ in range(dice.randint(0, 50)))
        b = "".join(c for c in a if dice.random() > 0.1) + dice.choice(["", "ab"]) if k % 2 else "".join(dice.choice(letters) for _ in range(dice.randint(0, 50)))
        assert S.exact_ratio(a, b) == SequenceMatcher(None, a, b, autojunk=False).ratio()
        assert 2 * S.matched(a, b) <= 2 * S.lcs_length(a, b) <= 2 * S.shared_characters(a, b)


def test_places_count_the_tokens_before_them(monkeypatch):
    value = "A_b 1,234.5e6 iPhone7 -> x<=y 3 ′ v1.2.3 C:/d/e 0012 μ² a-b/c " * 4
    place = T._Places(value)
    assert [place(k) for k in range(len(value))] == [len(T._TOKEN.findall(value[:k])) for k in range(len(value))]
    read = []

    class Counted:
        finditer = staticmethod(lambda x, f=T._TOKEN.finditer: read.append(len(x)) or f(x))
        findall = staticmethod(lambda x, f=T._TOKEN.findall: read.append(len(x)) or f(x))

    monkeypatch.setattr(T, "_TOKEN", Counted)
    T.unit_key.__wrapped__(value)
    # before: the text was read again up to each mark
    assert sum(read) < 4 * len(value)


def test_blocks_are_found_in_few_looks():
    """A text of two changed places is not asked about every character."""

    class Counted(str):
        looks = 0

        def __getitem__(self, at):
            Counted.looks += 1
            return str.__getitem__(self, at)

    r = random.Random(12)
    text = "".join(r.choice("abcdefgh ") for _ in range(3000))
    for other in (text[:700] + "XX" + text[760:2000] + text[2100:], text[1500:] + text[:1500]):
        Counted.looks = 0
        assert S.exact_ratio(Counted(text), other) == SequenceMatcher(None, text, other, autojunk=False).ratio()
        assert Counted.looks < 1500


def test_a_subsequence_is_given_up_when_it_can_not_be_long_enough():
    r = random.Random(13)
    for _ in range(200):
        a, b = ("".join(r.choice("abcd") for _ in range(r.randint(0, 900))) for _ in "ab")
        length = S.lcs_length(a, b)
        assert length == S.lcs_length(b, a) == S.lcs_length(a, b, length)
        assert length <= S.lcs_length(a, b, length + 40) < length + 40
        least = r.choice([0.5, 0.72, 0.9])
        ratio = SequenceMatcher(None, a, b, autojunk=False).ratio()
        assert S.bounded_ratio(a, b, least) == (ratio if ratio >= least else 0.0)
