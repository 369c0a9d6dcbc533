"""Text normalisation, keys and token functions.

Functions that end in ``_udf`` are Arrow-batched Python for what built-in functions can't express (Unicode composition, case
folding, number words, look-around); all others are column expressions that stay in generated code.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from functools import cached_property, lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

# Patterns and word lists that results depend on.
NUMBER = r"[+-]?(?:\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?|\.\d+)(?:[eE][+-]?\d+)?"
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]*(?:[./-][A-Za-z0-9_]+)*"
SENTENCE_VERB = (
    r"(?i)(?:^|[^\pL\pN_])(?:shall|should|must|may|can|is|are|was|were|be|been|being|means|defines?|describes?|specifies?|specified|"
    r"measured|computed|used|found|shown|meet|meets|differ|differs|provide|provided|use|uses|refer|requires?|contains?)(?:[^\pL\pN_]|$)"
)
NAMED_NUMBER = r"(?:^|[^\pL\pN_])[a-z]+[0-9]+(?:[-_/][a-z0-9]+)*(?:[^\pL\pN_]|$)"
EMAIL = r"[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?\.[A-Za-z]{2,}"
NUMBER_WORDS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen"]
TENS = ["twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety"]
SCALES = {"hundred": 100, "thousand": 1_000, "million": 1_000_000, "billion": 1_000_000_000}
#: Words before or after which a number word names something and is no count.
NAMING_BEFORE = frozenset({"appendix", "build", "clause", "code", "codes", "figure", "gen", "generation", "id", "identifier", "model", "models", "part", "profile", "profiles", "rev", "revision", "serial", "section", "table", "type", "version", "versions"})
NAMING_AFTER = frozenset({"csv", "dat", "doc", "docx", "html", "json", "pdf", "txt", "xls", "xlsx", "xml", "zip"})
CHINESE_DIGITS = {c: i for i, c in enumerate("零一二三四五六七八九")} | {"〇": 0, "两": 2}
CHINESE_UNITS = {"十": 10, "百": 100, "千": 1000, "万": 10_000}
CHINESE_MEASURES = "个位次条项章节页行列组字秒分时天年月层级步种类倍点"
SUPERSCRIPTS, SUBSCRIPTS = "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾ⁿⁱ", "₀₁₂₃₄₅₆₇₈₉₊₋₌₍₎ₐₑₕᵢⱼₖₗₘₙₒₚᵣₛₜᵤᵥₓ"
DASHES = "‐‑‒–—−"
STOP_WORDS = frozenset({"a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "if", "in", "is", "it", "of", "on", "or", "shall", "that", "the", "this", "to", "was", "were", "will", "with"})
MEASUREMENT = r"(?i)\b(?:voltage|current|resistance|impedance|frequency|rate|time|delay|width|length|height|angle|temperature|power|loss|gain|jitter|skew)\b|电压|电流|电阻|频率|时间|温度|功率"
BLANKS = r"(?U)[\s\x00-\x1F\x7F]+"
_NUMBER = re.compile(NUMBER)
_TOKEN = re.compile(r"<=>|<->|->|<-|=>|<=|>=|!=|==|[≤≥≠]|" + NUMBER + r"|(?:[^\W\d_]|_)\w*(?:[-/]\w+)*|[^\w\s.,;:?\"“”'‘’，。；：！？、]")
_ATOM = IDENTIFIER + r"|[+−-]?(?:\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+\.\d+|\.\d+|\d+)(?:[eE][+−-]?\d+)?|[㐀-鿿]|\p{L}+|[^\s]"


# --- built-in expressions


def collapsed(c: Column) -> Column:
    """Blank characters of any kind become one blank; none at the ends. Signs, case and symbols stay."""
    return F.trim(F.regexp_replace(c, BLANKS, " "))


def canonical_number(c: Column) -> Column:
    """Without thousands separators and a plus sign; digits after the point stay, so 1.0 isn't 1."""
    return F.regexp_replace(F.regexp_replace(c, ",", ""), r"^\+", "")


def number_tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"({NUMBER})"), F.lit(1))


def has_number(c: Column) -> Column:
    return c.rlike(r"[0-9]")


def has_identifier(c: Column) -> Column:
    return F.lower(c).rlike(NAMED_NUMBER)


def has_verb(c: Column) -> Column:
    return c.rlike(SENTENCE_VERB)


def priority(c: Column) -> Column:
    """4 for numbers, 3 for identifiers, 2 for sentences with a verb, 1 for the rest."""
    return F.when(has_number(c), 4).when(has_identifier(c), 3).when(has_verb(c), 2).otherwise(1)


def heading_number(c: Column) -> Column:
    """A heading's number without blanks around its dots."""
    return collapsed(F.regexp_replace(c, r"\s*\.\s*", "."))


def dashes_unified(c: Column) -> Column:
    return F.translate(c, DASHES, "-" * len(DASHES))


def formula_key(c: Column) -> Column:
    return F.translate(F.regexp_replace(c, r"(?U)\s+", ""), DASHES, "-" * len(DASHES))


def without_emails(c: Column) -> Column:
    return F.regexp_replace(c, EMAIL, "")


def neutral_emails(c: Column) -> Column:
    return F.regexp_replace(c, EMAIL, "[email]")


def literal_atoms(c: Column) -> Column:
    """Identifiers, numbers, single CJK characters, runs of letters, single signs."""
    return F.regexp_extract_all(c, F.lit(f"({_ATOM})"), F.lit(1))


def meaningful_words(c: Column) -> Column:
    words = F.regexp_extract_all(F.lower(c), F.lit(r"([a-z]+[a-z0-9]*(?:[-_/][a-z0-9]+)*)"), F.lit(1))
    return F.array_except(words, F.array(*map(F.lit, sorted(STOP_WORDS))))


def script_signature(c: Column) -> Column:
    """Superscripts and subscripts as they come, before any folding."""
    return F.array_join(F.regexp_extract_all(c, F.lit(f"([{SUPERSCRIPTS}{SUBSCRIPTS}]+)"), F.lit(1)), " ")


def leading_zero_numbers(c: Column) -> Column:
    return F.filter(number_tokens(c), lambda x: x.rlike(r"^[+-]?0\d+$"))


def labelled_identifiers(c: Column) -> Column:
    """What follows a word such as version or model, if it has a digit."""
    found = F.regexp_extract_all(c, F.lit(r"(?i)\b(?:build|codes?|filename|id|identifier|models?|part|profiles?|rev|revision|serial|versions?)\b\s*(?:[:=#]\s*)?([^\s,;]+)"), F.lit(1))
    return F.filter(found, lambda x: x.rlike(r"\d"))


def dotted_identifiers(c: Column) -> Column:
    """Dotted names and versions of three parts or with a letter; plain decimals aren't."""
    found = F.regexp_extract_all(c, F.lit(r"((?<![\w.])[A-Za-z0-9_+-]+(?:\.[A-Za-z0-9_+-]+)+(?![\w.]))"), F.lit(1))
    return F.filter(found, lambda x: x.rlike(r"^[^.]*[A-Za-z]|\.[^.]*\.|\.[A-Za-z]+(?:\.|$)"))


def paths(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"([A-Za-z][A-Za-z0-9+.-]*://[^\s,;]+|[A-Za-z]:\\[^\s,;]+|/?[A-Za-z0-9_.+-]+(?:/[A-Za-z0-9_.+-]+)+)"), F.lit(1))


def operators(c: Column) -> Column:
    """Comparison signs anywhere and arithmetic signs between operands."""
    return F.regexp_extract_all(c, F.lit(r"(<=|>=|!=|==|[≤≥≠×÷±]|(?<=[A-Za-z0-9)\]]) [+*/−-] (?=[A-Za-z0-9(\[]))"), F.lit(1))


def measurement_context(c: Column) -> Column:
    return c.rlike(MEASUREMENT)


def math_normalised(c: Column) -> Column:
    """x between digits is a multiplication sign; minus glyphs before a digit are one; comparison digraphs are single signs."""
    out = F.regexp_replace(c, r"(?<=\d)\s*[xX×]\s*(?=\d)", "×")
    out = F.regexp_replace(out, r"[−–](?=\s*\d)", "-")
    for pair, sign in (("<=", "≤"), (">=", "≥"), ("!=", "≠")):
        out = F.replace(out, F.lit(pair), F.lit(sign))
    return out


def arrows_normalised(c: Column) -> Column:
    out = F.translate(c, "→⇒←⇐↔⇔", "→→←←↔↔")
    for ascii_arrow, arrow in (("<->", "↔"), ("->", "→"), ("<-", "←")):
        out = F.replace(out, F.lit(ascii_arrow), F.lit(arrow))
    return out


def without_list_marker(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s*(?:[•●▪■◦‣·*–-]|\(?[a-z0-9]{1,3}[.)])\s+", "")


def symbol_font_decoded(c: Column) -> Column:
    """Private-use code points of symbol fonts for the signs that they show."""
    codes = {0xF0B1: "±", 0xF0B3: "≥", 0xF0A3: "≤", 0xF0B9: "≠", 0xF0B4: "×", 0xF0B8: "÷", 0xF06D: "μ", 0xF057: "Ω", 0xF0B0: "°", 0xF0AE: "→", 0xF0B7: "•"}
    return F.translate(c, "".join(map(chr, codes)), "".join(codes.values()))


def private_use(c: Column) -> Column:
    return c.rlike(r"[\x{E000}-\x{F8FF}]")


def assignment_field(c: Column) -> Column:
    """The left side of a line with one equals sign, where it is shaped like a field's name; else empty."""
    text = F.trim(collapsed(c), F.lit(".?!！？。 "))
    left, right = F.trim(F.substring_index(text, "=", 1)), F.trim(F.substring_index(text, "=", -1))
    shaped = left.rlike(r"^(?U)\w+(?:[./-]\w+)*(?:\[[\w.-]+\])?(?: \w+(?:[./-]\w+)*)*$") & (F.length(left) <= 80) & right.rlike(r"^(?U)(?:[\w\"'(\[{]|[+−±-]?\s*\.?\d)")
    told = (F.size(meaningful_words(left)) > 0) | left.rlike(r"[\x{4E00}-\x{9FFF}]")
    return F.when((F.length(text) - F.length(F.replace(text, F.lit("="), F.lit(""))) == 1) & shaped & told, F.lower(left)).otherwise(F.lit(""))


def caption_number(c: Column) -> Column:
    return dashes_unified(F.regexp_extract(c, r"(?i)^\s*(?:table|figure|fig\.|表|图)\s*([A-Z0-9]+(?:[.\-–][A-Z0-9]+)*)", 1))


def caption_descriptor(c: Column) -> Column:
    """A caption without its number, a mark of continuation and case."""
    text = F.regexp_replace(c, r"(?i)^\s*(?:table|figure|fig\.|表|图)\s*[A-Z0-9]+(?:[.\-–][A-Z0-9]+)*\s*[.:：-]?\s*", "")
    return F.lower(collapsed(F.regexp_replace(text, r"(?i)\s*[(（](?:continued|cont\.?|续)[)）]\s*$", "")))


def caption_family(c: Column) -> Column:
    """A caption's number without its last part."""
    return F.regexp_replace(caption_number(c), r"(?:^|[.-])[^.-]*$", "")


def is_page_counter(c: Column) -> Column:
    text = collapsed(c)
    return (F.length(text).between(2, 100)) & text.rlike(r"(?i)^(?:page \d+(?: ?(?:of|/|-) ?\d+)?|第 ?\d+ ?页(?: ?[/共] ?\d+ ?页?)?)$")


def furniture_fingerprint(c: Column) -> Column:
    return F.regexp_replace(F.lower(collapsed(c)), r"\d+", "#")


def publication_date(c: Column) -> Column:
    months = "january|february|march|april|may|june|july|august|september|october|november|december"
    return c.rlike(rf"(?i)^\s*(?:(?:\d{{1,2}}\s+)?(?:{months})\s+(?:\d{{1,2}},?\s+)?(?:19|20)\d\d|(?:19|20)\d\d[-/.]\d{{1,2}}[-/.]\d{{1,2}})\s*$")


def metadata_title(c: Column) -> Column:
    """Titles of sections about the publication, not its subject."""
    title = F.lower(F.trim(c))
    return title.rlike(
        r"^(?:contents|目录|authors?|editors?|contributors?|contact information|list of (?:figures|tables|illustrations|(?:member )?companies))$"
        r"|table of contents|\b(?:legal )?notice\b|copyright|foreword|preface|(?:revision|version|change|document|release|amendment) history"
        r"|(?:change|release) (?:log|record)|document control|distribution list|前言|版权|修订历史|版本历史"
    )


def cosmetic_key(c: Column) -> Column:
    """Equal where only spacing, hyphen glyphs between letters or the blank before a unit differ; case counts."""
    out = F.regexp_replace(without_emails(c), r"(?<=[A-Za-z])[‐‑](?=[A-Za-z])", "-")
    out = F.regexp_replace(out, r"(?<=\d)([eE])[‐‑−](?=\d)", "$1-")
    out = F.regexp_replace(out, r"(?<=\d)[ \t]+(?=(?:GHz|MHz|kHz|Hz|mV|mA|mW|dB|ns|ps|mm|cm|V|A|W|s|m)\b)", "")
    return collapsed(out)


def cell_cleaned(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[ \t\x{00A0}]+", " "), r" ?\n ?", "\n"))


def sampled(c: Column, most: int = 1200) -> Column:
    """A long text's first 40, middle 30 and last 30 of a hundred characters."""
    head, part = int(most * 0.4), int(most * 0.3)
    middle = (F.floor(F.length(c) / 2) - part // 2 + 1).cast("int")
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, head), F.substr(c, middle, F.lit(part)), F.right(c, F.lit(part))))


def truncated(c: Column, most: int) -> Column:
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(most - 1)), F.lit("…"))).otherwise(c)


def change_natures(c: Column, wording: Column) -> Column:
    """Up to four kinds that a change's text shows: step, reference, limit, wording."""
    step = F.when(c.rlike(r"(?i)\bsteps?\s+\d+|\b\d+\s+through\s+\d+\b"), "step")
    reference = F.when(c.rlike(r"(?i)\b(?:appendix|section)\s+[A-Z0-9]+(?:\.\d+)*\b"), "reference")
    limit = F.when(c.rlike(r"(?i)<=|>=|[≤≥<>=]|[+-]?\d+(?:\.\d+)?\s*(?:ps|mv|db|gt/s|mhz|ghz|ui|%)"), "limit")
    return F.slice(F.array_compact(F.array(step, reference, limit, F.when(wording, "wording"))), 1, 4)


def scope_hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def escaped_component(c: Column) -> Column:
    """A header or value of a coded table row: backslash, line break, bar and equals sign are escaped."""
    out = c
    for sign, code in (("\\", "\\\\"), ("\n", "\\n"), ("|", "\\|"), ("=", "\\=")):
        out = F.replace(out, F.lit(sign), F.lit(code))
    return out


def unescaped_component(c: Column) -> Column:
    """The inverse; a backslash before any other character stays."""
    hold = "\x00"
    out = F.replace(c, F.lit("\\\\"), F.lit(hold))
    for sign, code in (("\n", "\\n"), ("|", "\\|"), ("=", "\\=")):
        out = F.replace(out, F.lit(code), F.lit(sign))
    return F.replace(out, F.lit(hold), F.lit("\\"))


def encoded_row(cells: Column) -> Column:
    """An array of (label, value) as ``label=value | label=value``."""
    return F.array_join(F.transform(cells, lambda x: F.concat(escaped_component(x["label"]), F.lit("="), escaped_component(x["value"]))), " | ")


def decoded_row(c: Column) -> Column:
    """The array of (label, value) of a coded row, in order; labels may repeat; a cell without a label has a null one."""

    def cell(x: Column) -> Column:
        at = F.regexp_instr(x, F.lit(r"(?<!\\)(?:\\\\)*="))
        run = F.length(F.regexp_extract(x, r"(?<!\\)((?:\\\\)*)=", 1))
        left = F.when(at > 0, unescaped_component(F.substr(x, F.lit(1), at + run - 1)))
        right = F.when(at > 0, F.substr(x, at + run + 1)).otherwise(x)
        return F.struct(left.alias("label"), unescaped_component(right).alias("value"))

    return F.transform(F.split(c, r"\s+\|\s+"), lambda x: cell(F.trim(x)))


# --- Python on Arrow batches


def compose_line(value: str) -> str:
    """Composed form (no compatibility folding), without invisible controls, blanks collapsed."""
    value = unicodedata.normalize("NFC", value)
    if value.isprintable():  # holds no control
        return " ".join(value.split())
    kept = (ch if unicodedata.category(ch) not in ("Cc", "Cf") or ch.isspace() or "⁡" <= ch <= "⁤" else "" for ch in value)
    return " ".join("".join(kept).split())


def similarity_text(value: str) -> str:
    lines = (compose_line(x) for x in value.splitlines())
    return "\n".join(x for x in lines if x).casefold()


def number_phrase(words: list[str], at: int) -> tuple[int, int] | None:
    """(value, words used) of the cardinal that begins at a place; None if none does."""
    total, current, used, end = 0, None, at, at
    while used < len(words):
        parts = words[used].split("-")
        small = 0
        for part in parts:
            if part in NUMBER_WORDS:
                small += NUMBER_WORDS.index(part)
            elif part in TENS:
                small += 20 + 10 * TENS.index(part)
            else:
                small = -1
                break
        if small >= 0:
            if current is not None and not (current % 100 == 0 and current > 0 or (20 <= current % 100 and current % 10 == 0 and small < 10)):
                break
            current = (current or 0) + small
            used += 1
            end = used
        elif words[used] in SCALES and current is not None:
            scale = SCALES[words[used]]
            if scale == 100:
                current *= 100
            else:
                total, current = total + current * scale, None
            used += 1
            end = used
        elif words[used] == "and" and end == used and end > at and used + 1 < len(words) and (words[used + 1].split("-")[0] in NUMBER_WORDS or words[used + 1].split("-")[0] in TENS):
            used += 1
        else:
            break
    return None if end == at else (total + (current or 0), end - at)


_CARDINALS = frozenset([*NUMBER_WORDS, *TENS])


def counted_words(tokens: list[str]) -> list[str]:
    """Cardinals in words become digits, but for those that name something (a generation, a file)."""
    out, at = [], 0
    while at < len(tokens):
        found = number_phrase(tokens, at) if tokens[at].partition("-")[0] in _CARDINALS else None
        before = tokens[at - 1] if at else ""
        after = tokens[at + found[1]] if found and at + found[1] < len(tokens) else ""
        if found and before not in NAMING_BEFORE and after not in NAMING_AFTER:
            out.append(str(found[0]))
            at += found[1]
        else:
            out.append(tokens[at])
            at += 1
    return out


def chinese_number(value: str) -> int | None:
    total = section = digit = 0
    for c in value:
        if c in CHINESE_DIGITS:
            digit = digit * 10 + CHINESE_DIGITS[c] if digit else CHINESE_DIGITS[c]
        elif c == "万":
            total, section, digit = (total + section + digit) * 10_000, 0, 0
        elif c in CHINESE_UNITS:
            section += (digit or 1) * CHINESE_UNITS[c]
            digit = 0
        else:
            return None
    return total + section + digit


_CHINESE = "".join([*CHINESE_DIGITS, *CHINESE_UNITS])
_CHINESE_ORDINAL = re.compile(rf"第\s*([{_CHINESE}]+)\s*([章节条项步页级])")
_CHINESE_COUNT = re.compile(rf"([{_CHINESE}]+)(?=[{CHINESE_MEASURES}])")


def chinese_counts(value: str) -> str:
    """Numerals before a measure word or in an ordinal become digits; others may be parts of words."""
    value = _CHINESE_ORDINAL.sub(lambda m: f"第 {chinese_number(m[1])} {m[2]}", value)
    return _CHINESE_COUNT.sub(lambda m: str(chinese_number(m[1])), value)


_TECHNICAL = re.compile(r"(?<!\w)(?:[^\W\d_]|_)\w*(?:[-/]\w+)*(?!\w)")
_COMPARED = re.compile(r"<=|>=|!=|==|[≤≥≠×÷±]|(?<=[A-Za-z0-9)\]])\s+[+*/−-]\s+(?=[A-Za-z0-9(\[])")
_DIGIT, _INNER, _SIGN = re.compile(r"\d"), re.compile(r"_|[\w/-][A-Z]"), re.compile(r"[<>=!≤≥≠×÷±+*/−-]")
_SAME_SIGN = {"<=": "≤", ">=": "≥", "!=": "≠", "−": "-"}
_LABELLED = re.compile(r"(?i)\b(build|codes?|filename|id|identifier|models?|part|profiles?|rev|revision|serial|versions?)\b\s*(?:[:=#]\s*)?([^\s,;]*\d[^\s,;]*)")
_DOTTED = re.compile(r"(?<![\w.])[A-Za-z0-9_+-]+(?:\.[A-Za-z0-9_+-]+)+(?![\w.])")
_PATH = re.compile(r"(?<!\w)(?:[A-Za-z][A-Za-z0-9+.-]*://[^\s,;]+|[A-Za-z]:\\[^\s,;]+|/?[A-Za-z0-9_.+-]+(?:/[A-Za-z0-9_.+-]+)+)")


class _Places:
    """How many tokens the text before a place has. The whole text is cut once: what ends before a place is a token of the part
    before it too, and only a token that the place cuts is cut anew."""

    def __init__(self, value: str) -> None:
        self.value = value

    @cached_property
    def spans(self) -> list[tuple[int, int]]:
        return [m.span() for m in _TOKEN.finditer(self.value)]

    def __call__(self, at: int) -> int:
        k = bisect_right(self.spans, at, key=lambda x: x[1])
        cut = k < len(self.spans) and self.spans[k][0] < at
        return k + (len(_TOKEN.findall(self.value[self.spans[k][0] : at])) if cut else 0)


@lru_cache(maxsize=65_536)
def unit_key(value: str) -> str:
    """The key of a review unit: words without case and sentence punctuation, then typed marks of what must not be lost.

    Numbers (as written but for separators), spelling of technical words (with an inner capital, digit or underscore),
    operators, scripts, leading zeros, labelled, dotted and path identifiers each leave a mark with their place.
    """
    value = re.sub(r"^\s*(?:[•●▪■◦‣·]|\(?[a-z]{1,2}[.)]|\d{1,2}[)])\s+", "", compose_line(value))
    marks, place = [], _Places(value)
    # most units hold no digit, sign or slash: a pattern is only tried where what it must hold is there
    digits, plain = _DIGIT.search(value), value.isascii()
    for m in _TECHNICAL.finditer(value) if digits or not plain or _INNER.search(value) else ():
        word = m[0]
        if word.isalpha() and word.isascii() and (len(word) == 1 or word[1:].islower()):
            continue
        if "_" in word or any(c.isdigit() for c in word) or (any(c.isupper() for c in word[1:]) and not (word.isupper() and len(word) > 12)):
            marks.append(f"case:{place(m.start())}:{word}")
    if _SIGN.search(value):
        marks += [f"operator:{place(m.start())}:{_SAME_SIGN.get(m[0].strip(), m[0].strip())}" for m in _COMPARED.finditer(value)]
    marks += [f"modifier:{place(m.start())}:{m[0]}" for m in re.finditer(r"(?<=\d)\s*[′″']", value)] if digits else []
    marks += [] if plain else [f"script:{m.start()}:{m[0]}" for m in re.finditer(f"[{SUPERSCRIPTS}{SUBSCRIPTS}]+", value)]
    numbers = list(_NUMBER.finditer(value)) if digits else []
    marks += [f"lexical-number:{k}:{m[0]}" for k, m in enumerate(numbers) if re.fullmatch(r"[+-]?0\d+", m[0])]
    marks += [f"identifier-literal:{place(m.start(2))}:{m[1].lower()}:{m[2].rstrip('.)]}。')}" for m in _LABELLED.finditer(value)] if digits else []
    for m in _DOTTED.finditer(value) if "." in value[:-1] else ():
        parts = m[0].split(".")
        if len(parts) > 2 or any(c.isalpha() for c in parts[0]) or any(p.isalpha() for p in parts[1:]):
            marks.append(f"dotted-identifier:{place(m.start())}:{m[0]}")
    marks += [f"path-identifier:{place(m.start())}:{m[0].rstrip('.)]}。')}" for m in _PATH.finditer(value)] if "/" in value or "\\" in value else []
    text = similarity_text(value)
    text = (text if plain else chinese_counts(text)).replace("µ", "u").replace("μ", "u").replace("&", " and ")
    text = text.replace("<=", "≤").replace(">=", "≥").replace("!=", "≠")
    if _DIGIT.search(text):
        text = re.sub(r"(?<=\d)\s*[x×]\s*(?=\d)", " × ", text)
        text = re.sub(r"(?<=\d)(?![eE][+-]?\d)(?=[^\W\d_])", " ", text)
    tokens = [t.replace(",", "").lstrip("+") if not t[0].isalpha() and _NUMBER.fullmatch(t) and not t.startswith("+") else t for t in _TOKEN.findall(text)]
    return " ".join([*counted_words(tokens), *marks])


def split_long(value: str, most: int = 720) -> list[str]:
    """Parts of at most ``most`` characters, cut after a sentence, else a clause, else a word, else anywhere."""
    out = []
    while len(value) > most:
        part = value[:most]
        cut = max(part.rfind(x) + len(x) if part.rfind(x) > 0 else 0 for x in (". ", "; ", "。", "；"))
        cut = cut or part.rfind(" ") + 1 or most
        out.append(value[:cut].strip())
        value = value[cut:].strip()
    return [x for x in [*out, value] if x]


def inline_tokens(value: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, key) of numbers, identifiers, words, CJK characters and signs."""
    out = []
    for m in re.finditer(rf"(?P<number>{NUMBER})(?!\w)|(?P<word>(?:[^\W\d_]|_)\w*(?:[-/.]\w+)*)|(?P<sign>[^\s])", value):
        text = m[0]
        if m["word"] and "㐀" <= text[0] <= "鿿":
            out += [(m.start() + k, m.start() + k + 1, "cjk", c) for k, c in enumerate(text)]
        elif m["word"]:
            technical = "_" in text or any(c.isdigit() or c.isupper() for c in text[1:])
            out.append((m.start(), m.end(), "identifier" if technical else "word", text if technical else text.casefold()))
        else:
            out.append((m.start(), m.end(), "number" if m["number"] else "sign", text.replace(",", "") if m["number"] else text))
    return out


def critical_signature(value: str) -> str:
    """Numbers, identifiers, negations and comparison signs in order, references to other places masked."""
    masked = re.sub(r"(?i)\b(?:section|clause|table|figure|appendix|page|step)\s+[A-Z]?\d[\w.-]*", " ", value)
    kept = [key for _, _, kind, key in inline_tokens(masked) if kind in ("number", "identifier") or key in ("not", "no", "never", "<", ">", "=", "≤", "≥", "≠", "±")]
    return " ".join(kept)


@F.pandas_udf(StringType())
def normalize_line_udf(c: pd.Series) -> pd.Series:
    return c.map(compose_line, na_action="ignore")


@F.pandas_udf(StringType())
def similarity_text_udf(c: pd.Series) -> pd.Series:
    return c.map(similarity_text, na_action="ignore")


@F.pandas_udf(StringType())
def unit_key_udf(c: pd.Series) -> pd.Series:
    return c.map(unit_key, na_action="ignore")


@F.pandas_udf(StringType())
def counted_words_udf(c: pd.Series) -> pd.Series:
    return c.map(lambda x: " ".join(counted_words(x.split())), na_action="ignore")


@F.pandas_udf(StringType())
def chinese_counts_udf(c: pd.Series) -> pd.Series:
    return c.map(chinese_counts, na_action="ignore")


@F.pandas_udf(ArrayType(StringType()))
def split_long_udf(c: pd.Series) -> pd.Series:
    return c.map(split_long, na_action="ignore")


@F.pandas_udf(StringType())
def critical_signature_udf(c: pd.Series) -> pd.Series:
    return c.map(critical_signature, na_action="ignore")


_TOKENS = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("kind", StringType()), StructField("key", StringType())]))


@F.pandas_udf(_TOKENS)
def inline_tokens_udf(c: pd.Series) -> pd.Series:
    return c.map(lambda x: [dict(zip(("start", "end", "kind", "key"), t)) for t in inline_tokens(x)], na_action="ignore")
