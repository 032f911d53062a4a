"""Column expressions on text; all stay inside whole-stage code generation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that web text treats as blank; Java's ``\\s`` only knows the ASCII ones.
BLANK = r"[\t-\r    -     　﻿]"
#: Labels of page controls that stand on a line of their own (fixed values).
CONTROLS = ("展开全部", "展开全文", "收起", "阅读全文", "显示全部", "全文")


def word(pattern: str) -> str:
    """A pattern between ASCII word boundaries (``\\b`` sees Han characters as letters)."""
    return rf"(?<![A-Za-z0-9_])(?:{pattern})(?![A-Za-z0-9_])"


def clean_text(c: Column) -> Column:
    """Runs of blanks as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, BLANK + "+", " "))


def strip_controls(c: Column) -> Column:
    """Without lines that only hold a control's label, and at most one empty line between paragraphs."""
    body = F.regexp_replace(c, rf"(^|\n)\s*(?:{'|'.join(CONTROLS)})[^\S\n]*(?=\n|\z)", "$1")
    return F.regexp_replace(F.regexp_replace(body, r"\n{3,}", "\n\n"), r"^\s+|\s+\z", "")


def title_of(c: Column, most: int = 48, least_cut: int = 16) -> Column:
    """First sentence of four characters or more; a long one is cut at its last pause."""
    body = F.regexp_replace(c, r"(^|\n)[ \t]*[-=_*]{3,}[ \t]*(?=\n|$)", "$1")
    body = F.regexp_replace(body, r"(^|\n)[ \t]*[#>|]+[ \t]*", "$1")
    parts = F.transform(F.split(body, r"[。！？!?\n]"), clean_text)
    first = F.coalesce(F.try_element_at(F.filter(parts, lambda p: F.length(p) >= 4), F.lit(1)), clean_text(body))
    head = F.substring(first, 1, most)
    last = F.greatest(*(F.when(F.instr(head, p) > 0, most + 1 - F.instr(F.reverse(F.rpad(head, most, "\u0001")), p)).otherwise(0) for p in ("，", "、", "；", " ")))
    return F.when(F.length(first) <= most, first).when(last - 1 >= least_cut, F.substring(head, F.lit(1), (last - 1).cast("int"))).otherwise(head)


def match_key(c: Column, most: int | None = 24) -> Column:
    """Text without markup, blanks, zero-width characters and punctuation, cut to ``most`` characters; whole with None."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"<[^>]*>", " ")
    c = F.regexp_replace(c, BLANK, "")
    c = F.regexp_replace(c, r"[​-‏﻿]", "")
    c = F.regexp_replace(c, r"[　-〿＀-･!-/:-@\[-`{-~]", "")
    return c if most is None else F.substring(c, 1, most)


def slug(c: Column, most: int = 60) -> Column:
    """A file name part: no control or reserved characters, blanks and dashes as one dash, never empty."""
    c = F.regexp_replace(c, r"[\x00-\x1f\x7f]", "")
    c = F.regexp_replace(c, r'[\\/?%*:|"<>]', " ")
    c = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\.{2,}", " "), r"^\.+", ""), r"\.+$", "")
    c = F.regexp_replace(F.regexp_replace(c, r"[\s_-]+", "-"), r"^-+|-+$", "")
    c = F.regexp_replace(F.substring(c, 1, most), "-+$", "")
    reserved = F.lower(c).rlike(r"^(?:con|prn|aux|nul|com[1-9]|lpt[1-9])$")
    return F.when(F.length(c) == 0, F.lit("untitled")).when(reserved, F.concat(F.lit("_"), F.lower(c))).otherwise(c)


def html_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def occurrences(haystack: Column, term: str) -> Column:
    """Number of occurrences of a fixed term that don't overlap."""
    return ((F.length(haystack) - F.length(F.replace(haystack, F.lit(term), F.lit("")))) / len(term)).cast("int")


def hits(c: Column, terms: Sequence[str]) -> Column:
    """The terms that occur in a text, in their own order."""
    return F.filter(F.array(*(F.lit(t) for t in terms)), lambda t: F.contains(c, t))


def pattern_count(c: Column, patterns: Sequence[str]) -> Column:
    """How many of the patterns match."""
    total = F.lit(0)
    for p in patterns:
        total = total + F.coalesce(c.rlike(p), F.lit(False)).cast("int")
    return total


def first_match(c: Column, rules: Sequence[tuple[str, str]], otherwise: str | None = None) -> Column:
    """Label of the first rule whose pattern matches; an ordered ladder."""
    out = None
    for pattern, label in rules:
        out = F.when(c.rlike(pattern), label) if out is None else out.when(c.rlike(pattern), label)
    return out.otherwise(F.lit(otherwise)) if out is not None else F.lit(otherwise)
