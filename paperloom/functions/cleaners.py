"""String cleaners as column expressions; each takes a column and returns one. A null stays null."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions import lexicon as lx

WS = f"[{lx.SPACES}]"
GLYPHS = lx.BULLETS
BULLET = rf"^{WS}*(?:[{GLYPHS}]|[-*+–—](?={WS}))"
BULLET_RUN = rf"^{WS}*(?:[{GLYPHS}]+|[-*+–—](?={WS})){WS}*"
LINE_SPLIT = r"[ \t\f\x0B\r]*\n[ \t\f\x0B\r]*"
BLANK_SPLIT = rf"\n[ \t\f\x0B\r]*\n{WS}*"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it, inside lambdas too."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A{WS}+|{WS}+\z", "")


def clean_non_ascii_chars(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\x00-\x7F]", "")


def clean_bullets(c: Column) -> Column:
    return F.when(c.rlike(BULLET), strip(F.regexp_replace(c, BULLET_RUN, ""))).otherwise(c)


def clean_ordered_bullets(c: Column) -> Column:
    head = F.regexp_extract(c, rf"\A{WS}*([^{lx.SPACES}]+){WS}+[^{lx.SPACES}]", 1)
    outline = head.rlike(r"\A[A-Za-z0-9]{1,2}(?:\.[A-Za-z0-9]{1,2}){0,2}\.?\z") & head.contains(".") & ~head.contains("..")
    return F.when(outline, F.regexp_replace(c, rf"\A{WS}*[^{lx.SPACES}]+{WS}+", "")).otherwise(c)


def clean_ligatures(c: Column) -> Column:
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), lx.LIGATURES, c)


def replace_unicode_quotes(c: Column) -> Column:
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), lx.QUOTES, c)


def remove_punctuation(c: Column) -> Column:
    return F.regexp_replace(c, r"\p{P}", "")


def remove_sentence_punctuation(c: Column, exclude_punctuation: list[str] | None = None) -> Column:
    kept = "".join("\\" + x for x in exclude_punctuation or [])
    return F.regexp_replace(c, rf"[\p{{P}}&&[^{kept}]]" if kept else r"\p{P}", "")


def clean_extra_whitespace(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, f"{WS}+", " "))


def clean_dashes(c: Column) -> Column:
    return strip(F.translate(c, lx.DASHES, " " * len(lx.DASHES)))


def clean_trailing_punctuation(c: Column) -> Column:
    return F.regexp_replace(strip(c), r"[.,:;]+\z", "")


def clean_prefix(c: Column, pattern: str, ignore_case: bool = False, strip: bool = True) -> Column:
    out = F.regexp_replace(c, rf"{'(?i)' if ignore_case else ''}\A(?:{pattern})", "")
    return F.regexp_replace(out, rf"\A{WS}+", "") if strip else out


def clean_postfix(c: Column, pattern: str, ignore_case: bool = False, strip: bool = True) -> Column:
    out = F.regexp_replace(c, rf"{'(?i)' if ignore_case else ''}(?:{pattern})\z", "")
    return F.regexp_replace(out, rf"{WS}+\z", "") if strip else out


def clean(
    c: Column,
    extra_whitespace: bool = False,
    dashes: bool = False,
    bullets: bool = False,
    trailing_punctuation: bool = False,
    lowercase: bool = False,
) -> Column:
    """The chosen steps in a fixed order: case, trailing punctuation, dashes, white space, bullets, ends."""
    steps: list[tuple[bool, Callable[[Column], Column]]] = [
        (lowercase, F.lower),
        (trailing_punctuation, clean_trailing_punctuation),
        (dashes, clean_dashes),
        (extra_whitespace, clean_extra_whitespace),
        (bullets, clean_bullets),
    ]
    return strip(reduce(lambda x, s: s[1](x) if s[0] else x, steps, c))


def bytes_string_to_string(c: Column, encoding: str = "utf-8") -> Column:
    """Code points taken as bytes, decoded."""
    return F.decode(F.encode(c, "ISO-8859-1"), encoding)


def replace_mime_encodings(c: Column, encoding: str = "utf-8") -> Column:
    """Quoted-printable decoded; an Arrow pass, since SQL has no such function."""
    @F.pandas_udf("string")
    def decode(s: pd.Series) -> pd.Series:
        import quopri

        return s.map(lambda x: None if x is None else quopri.decodestring(x.encode(encoding)).decode(encoding))

    return decode(c)


def group_bullet_paragraph(c: Column) -> Column:
    """An array with an item for each bullet."""
    parts = F.split(c, rf"{WS}*(?=[{GLYPHS}])")
    joined = F.transform(parts, lambda p: F.array_join(F.filter(F.transform(F.split(p, LINE_SPLIT), strip), lambda x: x != ""), " "))
    return F.filter(joined, lambda x: x != "")


def _lines(c: Column, split: str) -> Column:
    return F.filter(F.transform(F.split(c, split), strip), lambda x: x != "")


def new_line_paragraphs(c: Column, split: str = LINE_SPLIT) -> Column:
    return _lines(c, split)


def broken_paragraphs(c: Column, line_split: str = LINE_SPLIT, paragraph_split: str = BLANK_SPLIT) -> Column:
    """An array of paragraphs: bullets one each, short lines one each, other wrapped lines joined."""

    def unwrap(lines: Column) -> Column:
        short = F.forall(lines, lambda x: F.size(F.split(x, f"{WS}+")) < 5)
        return F.when(short, lines).otherwise(F.array(F.array_join(lines, " ")))

    def regroup(p: Column) -> Column:
        return F.when(strip(p).rlike(BULLET), group_bullet_paragraph(p)).otherwise(bind(_lines(p, line_split), unwrap))

    parts = F.filter(F.split(c, paragraph_split), lambda p: strip(p) != "")
    return F.flatten(F.transform(parts, regroup))


def group_broken_paragraphs(c: Column, line_split: str = LINE_SPLIT, paragraph_split: str = BLANK_SPLIT) -> Column:
    return F.array_join(broken_paragraphs(c, line_split, paragraph_split), "\n\n")


def new_line_grouper(c: Column, paragraph_split: str = LINE_SPLIT) -> Column:
    return F.array_join(new_line_paragraphs(c, paragraph_split), "\n\n")


def blank_line_grouper(c: Column, paragraph_split: str = BLANK_SPLIT) -> Column:
    return group_broken_paragraphs(c, paragraph_split=paragraph_split)


def _mostly_filled(c: Column, line_split: str, max_line_count: int, threshold: float) -> Column:
    lines = F.slice(F.split(c, line_split), 1, max_line_count)
    return bind(lines, lambda a: F.size(F.filter(a, lambda x: strip(x) == "")) / F.size(a) < threshold)


def auto_paragraphs(c: Column, line_split: str = LINE_SPLIT, max_line_count: int = 2000, threshold: float = 0.1) -> Column:
    """An array of paragraphs: a line each where few of the first lines are blank, else by blank lines."""
    few = _mostly_filled(c, line_split, max_line_count, threshold)
    return F.when(few, new_line_paragraphs(c)).otherwise(broken_paragraphs(c))


def auto_paragraph_grouper(c: Column, line_split: str = LINE_SPLIT, max_line_count: int = 2000, threshold: float = 0.1) -> Column:
    return F.array_join(auto_paragraphs(c, line_split, max_line_count, threshold), "\n\n")


def apply_cleaners(c: Column, *cleaners: Callable[[Column], Column]) -> Column:
    return reduce(lambda x, f: f(x), cleaners, c)
