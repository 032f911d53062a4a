"""Categories, keywords, summaries and rule filters; the rules are data passed in."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from heapq import nsmallest

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.text import BLANK, hits

#: A neutral pack for front-end writing; callers bring their own.
CATEGORIES: dict[str, tuple[str, ...]] = {
    "frontend": ("css", "react", "vue", "浏览器", "组件", "渲染", "rendering", "browser"),
    "engineering": ("部署", "构建", "缓存", "监控", "build", "cache", "release"),
    "interview": ("面试", "面经", "追问", "offer", "interview"),
    "career": ("薪资", "职场", "团队", "入职", "salary", "team"),
}
LEXICON = ("css", "react", "vue", "websocket", "promise", "worker", "cache", "build", "缓存", "渲染", "组件", "性能", "构建", "监控", "面试", "团队")
#: Words that are no keywords, the shape of a Latin term and of a sentence, marks that don't tell sentences apart.
STOP_WORDS = ("the", "and", "for", "with", "from", "that", "this", "into")
_LATIN = re.compile(r"[a-z][a-z0-9+#.-]{1,24}")
_SENTENCE = re.compile(r"[^。！？!?\n]+[。！？!?]?")
_BLANKS = re.compile(f"{BLANK}+")
_SAME = re.compile(f"(?:{BLANK}|[，。！？!?、；;：:])+")


def category(title: Column, text: Column, rules: Mapping[str, Sequence[str]] = CATEGORIES, otherwise: str = "other", title_weight: int = 3) -> Column:
    """The category with most terms found (substring, any case; a hit in the title counts more); ties by order, none: ``otherwise``."""
    low_title, low_text = F.lower(F.coalesce(title, F.lit(""))), F.lower(F.coalesce(text, F.lit("")))
    scored = []
    for i, (name, terms) in enumerate(rules.items()):
        score = F.lit(0)
        for t in terms:
            score = score + F.contains(low_title, F.lit(t)).cast("int") * title_weight + F.contains(low_text, F.lit(t)).cast("int")
        scored.append(F.struct(score.alias("score"), F.lit(-i).alias("order"), F.lit(name).alias("name")))
    best = F.array_max(F.array(*scored))
    return F.when(best["score"] > 0, best["name"]).otherwise(otherwise)


def tags(user: Column, suggested: Column, found: Column, most: int = 8) -> Column:
    """The user's tags if any, else suggested ones and found keywords; trimmed, distinct, in order, cut."""
    empty = F.array().cast("array<string>")
    auto = F.concat(F.coalesce(suggested, empty), F.coalesce(found, empty))
    chosen = F.when(F.size(F.coalesce(user, empty)) > 0, user).otherwise(auto)
    return F.slice(F.array_distinct(F.filter(F.transform(chosen, F.trim), lambda t: F.length(t) > 0)), 1, most)


def keywords(df: DataFrame, key: str, title: str, text: str, lexicon: Sequence[str] = LEXICON, stop: Sequence[str] = STOP_WORDS, most: int = 8) -> DataFrame:
    """``(key, keywords)``: lexicon terms and Latin tokens by count, the title counting three times; ties by term.

    A Latin lexicon term counts both as a term and as a token; documents without a term have no row. Each document
    is counted where it is read, so nothing is exchanged.
    """
    left_out = frozenset(stop)

    @F.pandas_udf("array<string>")
    def terms(titles: pd.Series, texts: pd.Series) -> pd.Series:
        def top(name: str | None, body: str | None) -> list[str] | None:
            hay = " ".join(x for x in (name, name, name, body) if x is not None).lower()
            count = Counter(_LATIN.findall(hay))
            for t in lexicon:
                if n := hay.count(t):
                    count[t] += n
            for t in left_out:
                count.pop(t, None)
            return [t for _, t in nsmallest(most, ((-n, t) for t, n in count.items()))] or None

        return pd.Series([top(n, b) for n, b in zip(titles, texts, strict=True)], dtype=object)

    return df.select(F.col(key), terms(title, text).alias("keywords")).where("keywords is not null")


def summary(df: DataFrame, key: str, title: str, text: str, lexicon: Sequence[str] = LEXICON, most: int = 280, picks: int = 4) -> DataFrame:
    """``(key, summary)``: up to four telling sentences in their order; repeated sentences count once. Nothing is exchanged."""

    def told(name: str, body: str) -> str:
        in_title, seen, scored = [t for t in lexicon if t in name], set(), []
        for raw in _SENTENCE.findall(body):
            s = _BLANKS.sub(" ", raw).strip(" ")
            if len(s) < 12 or (k := _SAME.sub("", s)) in seen:
                continue
            j, low = len(seen), s.lower()
            seen.add(k)
            score = max(0, 6 - j) + 5 * sum(t in low for t in in_title) + 3 * (24 <= len(s) <= 90) + (s[-1] in "。！？!?")
            scored.append((-score, j, s))
        out = ""
        for _, _, s in sorted(nsmallest(picks, scored), key=lambda x: x[1]):
            if len(out) + len(s) > most:
                break
            out += s
        return out or _BLANKS.sub(" ", body).strip(" ")[:most]

    @F.pandas_udf("string")
    def tell(titles: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([told((n or "").lower(), b or "") for n, b in zip(titles, texts, strict=True)], dtype=object)

    return df.select(F.col(key), tell(title, text).alias("summary"))


@dataclass(frozen=True)
class Topic:
    """A topic to leave out: strong terms name it, supporting ones confirm it."""

    id: str
    strong: tuple[str, ...]
    supporting: tuple[str, ...]


def topic(text: Column, rules: Sequence[Topic], opening: int = 150, least: int = 2) -> Column:
    """First topic with a strong term in the opening and at least two terms in all: struct(rule, hits), else null."""
    out = None
    for r in rules:
        strong, more = hits(text, r.strong), hits(text, r.supporting)
        ok = (F.size(hits(F.substring(text, 1, opening), r.strong)) > 0) & (F.size(strong) + F.size(more) >= least)
        value = F.struct(F.lit(r.id).alias("rule"), F.concat(strong, more).alias("hits"))
        out = F.when(ok, value) if out is None else out.when(ok, value)
    return out
