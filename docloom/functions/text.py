"""Scalar text functions as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Digits of Chinese numerals.
CHINESE_DIGITS = {"一": 1, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}


def trimmed(x: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def is_blank(x: Column) -> Column:
    return F.coalesce(trimmed(x), F.lit("")) == ""


def blank_to_default(x: Column, default: Column) -> Column:
    return F.coalesce(F.nullif(trimmed(x), F.lit("")), default)


def first_non_blank(*xs: Column) -> Column:
    return F.coalesce(*[F.when(~is_blank(x), x) for x in xs], F.lit(""))


def compact(x: Column) -> Column:
    return F.regexp_replace(trimmed(x), r"\s+", " ")


def cleaned(x: Column) -> Column:
    """Line ends as LF, NUL and TAB as a space, trimmed."""
    return trimmed(F.translate(F.regexp_replace(x, "\r\n?", "\n"), "\x00\t", "  "))


def clip_head(x: Column, n: int) -> Column:
    return F.when(F.char_length(x) > n, F.concat(F.substring(x, 1, n - 1), F.lit("…"))).otherwise(x)


def clip_tail(x: Column, n: int) -> Column:
    return F.when(F.char_length(x) > n, F.concat(F.lit("…"), F.right(x, F.lit(n - 1)))).otherwise(x)


def join_non_blank(xs: Column, separator: str) -> Column:
    return F.array_join(F.filter(xs, lambda x: ~is_blank(x)), separator)


def han_count(x: Column) -> Column:
    return F.regexp_count(x, F.lit(r"\p{IsHan}"))


def token_estimate(x: Column) -> Column:
    """Han characters + words with a Latin letter + a quarter (1 at least) of all other characters."""
    han = han_count(x)
    latin = F.regexp_count(x, F.lit(r"\S*[A-Za-z]\S*"))
    rest = F.floor((F.char_length(x) - han - latin) / 4)
    return (han + latin + F.greatest(F.lit(1), rest)).cast("long")


def token_set(x: Column) -> Column:
    """Distinct lower-cased Latin words of 2 characters or more and single Han characters."""
    return F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit(r"[a-z0-9]{2,}|\p{IsHan}"), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token sets; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def sentences(x: Column) -> Column:
    """Sentences with their closing mark, trimmed, blanks dropped."""
    return F.filter(F.transform(F.split(x, "(?<=[。！？!?;；.])"), trimmed), lambda s: s != "")


def slug(x: Column) -> Column:
    """Digits, Latin letters and Han only; other runs become '-'."""
    return F.regexp_replace(F.regexp_replace(x, r"[^0-9a-zA-Z\p{IsHan}]+", "-"), "^-+|-+$", "")


def chinese_number(x: Column) -> Column:
    """1 to 99 written in Chinese numerals or Arabic digits; null otherwise."""
    digit = F.create_map(*[F.lit(v) for pair in CHINESE_DIGITS.items() for v in pair])
    tens, ones = F.regexp_extract(x, "^([一二三四五六七八九]?)十([一二三四五六七八九]?)$", 1), F.regexp_extract(x, "^([一二三四五六七八九]?)十([一二三四五六七八九]?)$", 2)
    with_ten = F.when(tens == "", 1).otherwise(F.try_element_at(digit, tens)) * 10 + F.when(ones == "", 0).otherwise(F.try_element_at(digit, ones))
    return F.when(x.rlike("^[0-9]{1,9}$"), x.try_cast("int")).when(x.rlike("^[一二三四五六七八九]?十[一二三四五六七八九]?$"), with_ten).otherwise(F.try_element_at(digit, x)).cast("int")


def heading_code(x: Column) -> Column:
    return F.regexp_extract(trimmed(x), r"^\d+(\.\d+)*", 0)


def heading_level(x: Column, level: Column | None = None) -> Column:
    """The level given (1 to 6), else the number of leading '#', else 1."""
    marks = F.length(F.regexp_extract(trimmed(x), "^(#{1,6})", 1))
    by_text = F.when(marks > 0, marks).otherwise(1)
    return by_text if level is None else F.when(level.between(1, 6), level).otherwise(by_text)


def contains_any(x: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | x.contains(w)
    return found


def title_key(x: Column) -> Column:
    """A title for comparison: punctuation and blanks dropped, lower-cased."""
    return F.lower(F.regexp_replace(x, r"[\s\p{P}\p{S}]+", ""))


def content_hash(*parts: Column) -> Column:
    return F.sha2(F.concat(*[F.coalesce(p, F.lit("")) for p in parts]), 256)


def outer_json(x: Column, kind: str = "object") -> Column:
    """The outermost JSON object or array written in a text."""
    return F.regexp_extract(x, r"(?s)\{.*\}" if kind == "object" else r"(?s)\[.*\]", 0)


def tolerant_array(x: Column) -> Column:
    """An array of strings written as JSON, anywhere in a text; without one, the lines with list marks dropped. Blanks go."""
    written = F.from_json(outer_json(x, "array"), "array<string>")
    lines = F.transform(F.split(F.coalesce(x, F.lit("")), "\n"), lambda y: F.regexp_replace(y, r"^\s*([-*•]|[0-9]+[.)、])\s*", ""))
    return F.filter(F.transform(F.coalesce(written, lines), trimmed), lambda y: y != "")


def prompt(template: str, values: dict[str, Column]) -> Column:
    """A template with each {name} replaced; null values leave nothing."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def stable_id(*parts: Column) -> Column:
    """A positive 63-bit id that depends on the parts alone."""
    return F.xxhash64(*parts).bitwiseAND(F.lit(2**63 - 1))


def number_text(x: Column, digits: int = 2) -> Column:
    """A number with at most that many decimals (halves to even) and no trailing zeros."""
    return F.regexp_replace(F.regexp_replace(F.format_string(f"%.{digits}f", F.bround(x.cast("double"), digits)), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def segmented(x: Column, words: list[str]) -> Column:
    """Words of a text by longest match with a dictionary; other Han characters stand alone, Latin words and numbers stay whole."""
    known = "|".join(re.escape(w) for w in sorted(set(words), key=lambda w: (-len(w), w)) if w)
    return F.regexp_extract_all(x, F.lit(rf"{known + '|' if known else ''}[A-Za-z0-9]+|\p{{IsHan}}"), F.lit(0))
