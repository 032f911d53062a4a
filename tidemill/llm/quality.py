"""Per-document text statistics, robust distance from prose, and the form of a document.

Each document gets word count, mean word length, symbol ratio, share of lines ending in punctuation, share
of common words and the shares behind the forms (entries, rows of cells, unreadable characters, machine
runs, repeated sentences, repeated words). For each language (by script, as ``lang`` is often wrong) the mean and
covariance of prose are fitted robustly over all documents: medians and absolute deviations choose a
first core, whose moments are refitted on the documents near it. The squared Mahalanobis distance is the
sum of one contribution per statistic. Documents beyond the cut are outliers, all others are prose whatever
their lines look like. An outlier gets the form that its contributions name: entry lines a list, rows of cells a
table (both only with the four fifths of the definition), unreadable characters, machine runs, symbols,
repetition and missing common words junk. An outlier by anything else (width, length, punctuation) stays prose.
Moments are summed inside Arrow batches and then by Spark, so fitting takes a few hundred rows to the driver
whatever the input.

Defined results: null and blank texts are prose with zero statistics and distance (there is nothing unreadable);
repeated rows are judged alike; empty tables give no rows; extra columns are not read.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.functions import codepoints as C
from tidemill.session import cut

STATS = (
    "log_words", "mean_word_length", "symbol_ratio", "punctuated_lines", "common_words", "entry_lines", "cell_lines", "odd_chars",
    "machine_runs", "repeated_sentences", "log_line_width", "digit_ratio", "repeated_words",
)
#: Least spread of each statistic in prose; keeps constant ones from dividing by zero.
SPREAD = np.array([0.3, 0.3, 0.03, 0.1, 0.05, 0.08, 0.05, 0.02, 0.03, 0.06, 0.3, 0.03, 0.06])
WHOLE = 0.8  # share of lines that makes a list or a table
CUT = 27.7  # 0.99 quantile of chi square with 13 degrees of freedom
NAMED = 49.0  # what the statistics of junk must contribute together: seven standard deviations
BARE, ROWS = 3, 2  # lines from which short lines without a mark are entries, and commas or semicolons part cells; fewer are a remark or a statement
PRIOR_WORDS, PRIOR_SHARE = 8, 0.3  # words of usual prose that every text counts as having beside its own: few words show no lack of common ones
STRETCH, FEW, SHINGLE = 100, 10, 8  # words of a stretch, words without repetition that every text counts as having, words of a shingle
SLICE = 100_000  # characters measured at once, so that the arrays stay in the processor's cache

_HAN = re.compile("[㐀-鿿豈-﫿]")
_WORD = re.compile("[A-Za-z]+")
_LINK = re.compile(r"\[([^\]]*)\]\([^)]*\)")
_MARK = re.compile(
    r"^\s*(?:[-*+•·–—▪◦●○■□✓✔>]|\d{1,3}\s?[.)、．:：]|[①-⑳]|[(（]\d{1,3}[)）]|[a-zA-Z][.)]|#{1,6})\s*(?:\[[ xX]\]\s*)?"
)
_NOTE = re.compile(r"[（(][^）)]{0,6}[）)]\s*$")
_SENT = re.compile(r"[，。！？；：、]|[,.;:!?](?=\s|$)")
_RULE = re.compile(r"[|│+├┼┤┌┬┐└┴┘─\-=: ]{5,}")
_GAP = re.compile(r" {2,}")
_TOKEN_TAG = re.compile(r"<\|[A-Za-z_]{1,24}\|>")
_CELL = re.compile(r"[^\W_]")
_PROSE_MARK = re.compile(r"[。，！？]|, ")
_ODD = "[�\u0080-ÿ■-◿€œ‚„†‡ˆ‰Š‹ŒŽ™š›žŸ˜锟烫屯拷]"
_RUN = re.compile(r"[A-Za-z0-9+/=]{30,}")
_SPLIT = re.compile(r"[。！？!?\n]+|\.\s|(?<=[a-z0-9)\]\"'])\.(?=[A-Z㐀-鿿豈-﫿])")
_END = re.compile(r"[。．.！!？?…：:；;」』”\"’')）]\s*$")


def _width(s: str) -> int:
    return len(s) + len(_HAN.findall(s))


def is_entry(line: str, bare_too: bool = True) -> bool:
    """A short list entry, marked or (in a text of several lines) bare."""
    line = _LINK.sub(r"\1", line.strip())
    m = _MARK.match(line)
    if not m and not bare_too:
        return False
    bare = _NOTE.sub("", line[m.end() :] if m else line).strip()
    if not bare:
        return bool(m)
    return bool(_CELL.search(bare)) and len(bare) <= 44 and _width(bare) <= 44 and not _SENT.search(bare) and len(bare.split()) <= 6


def is_row(line: str, delimited: bool = True) -> bool:
    """A row of cells: ruled, tabbed, aligned or delimited. Markers of a tokenizer rule no cells, and a row holds letters or digits or is a rule."""
    s = _TOKEN_TAG.sub("", line).strip()
    if not _CELL.search(s):
        return bool(_RULE.fullmatch(s))
    if s.count("|") >= 2 or s.count("│") >= 2 or "\t" in s or _RULE.fullmatch(s) or len(_GAP.split(s)) >= 3:
        return True
    for d in ",;" if delimited else "":
        if s.count(d) >= 2 and max(map(_width, s.split(d))) <= 26 and not _PROSE_MARK.search(s):
            return True
    return False


_SYMBOL, _BLANK, _ODDITY, _DIGIT, _LATIN, _HANZI = (1 << i for i in range(6))


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Classes of every code point as bits."""
    out = np.zeros(sys.maxunicode + 1, np.uint8)
    for bit, pattern in ((_SYMBOL, r"[!-/:-@\[-`{-~]"), (_ODDITY, _ODD), (_LATIN, "[A-Za-z]"), (_HANZI, _HAN.pattern)):
        test = re.compile(pattern)
        out[[i for i in range(0x10000) if test.match(chr(i))]] |= bit
    every = [chr(i) for i in range(0x20000)]  # no blank and no digit lies beyond
    out[[i for i, c in enumerate(every) if c.isspace()]] |= _BLANK
    out[[i for i, c in enumerate(every) if c.isdigit()]] |= _DIGIT
    return out


def word_hashes(words: Sequence[str]) -> np.ndarray:
    cp, starts, ends = C.spans(C.to_array(C.join(list(words))))
    return np.sort(C.segment_hashes(cp, starts, ends)) if len(words) else np.zeros(0, np.uint64)


def _distinct(doc: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Number of distinct values of each of n documents."""
    _, first = np.unique(C.mix(value + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
    return np.bincount(doc[first], minlength=n)


def word_counts(texts: Sequence[str | None], common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many words are common ones (by their hashes), and the share of words that repeat.

    Words are Latin runs and neighbouring pairs of Chinese characters. The share is the greater one of words that
    repeat one of their stretch, and of shingles that repeat one of the text; ``FEW`` words that don't are added.
    """
    n = len(texts)
    cp, starts, ends = C.spans(C.to_array(C.join(texts).lower()))
    owner = np.repeat(np.arange(n), ends - starts)
    latin = (cp >= 97) & (cp <= 122)
    han = (_classes()[cp] & _HANZI) > 0
    joined = np.concatenate((owner[1:] == owner[:-1], [False])) if len(cp) else np.zeros(0, bool)  # the next character is of the same text

    def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        on = mask & joined & np.concatenate((mask[1:], [False]))  # goes on
        return np.flatnonzero(mask & ~np.concatenate(([False], on[:-1]))), np.flatnonzero(mask & ~on) + 1

    if not len(cp):
        return np.zeros(n), np.zeros(n)
    a, z = runs(latin)
    of_latin = C.segment_hashes(cp, a, z)
    usual = np.bincount(owner[a[np.isin(of_latin, common)]], minlength=n)
    b, y = runs(han)
    single = b[y - b == 1]
    pair = np.flatnonzero(han & joined & np.concatenate((han[1:], [False])))
    wide = cp.astype(np.uint64)
    at = np.concatenate((a, single, pair))
    value = np.concatenate((of_latin, C.mix(wide[single] + np.uint64(1 << 40)), C.mix(wide[pair] * np.uint64(1 << 21) + wide[np.minimum(pair + 1, len(cp) - 1)] + np.uint64(1 << 50))))
    order = np.argsort(at, kind="stable")
    value, doc = value[order], owner[at[order]]
    count = np.bincount(doc, minlength=n)
    place = np.arange(len(doc)) - (np.cumsum(count) - count)[doc]
    of = count[doc]
    whole = (of <= STRETCH) | (place < of // STRETCH * STRETCH)
    tail = (of > STRETCH) & (of % STRETCH > 0) & (place >= of - STRETCH)  # the last stretch overlaps the one before
    part = np.concatenate((place[whole] // STRETCH, np.full(tail.sum(), 1 << 40)))
    d, v = np.concatenate((doc[whole], doc[tail])), np.concatenate((value[whole], value[tail]))
    total = np.bincount(d, minlength=n)
    near = (total - _distinct(d, v + part.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F), n)) / (total + FEW)
    begins = np.flatnonzero(place + SHINGLE <= of)
    shingle = np.zeros(len(begins), np.uint64)
    for k in range(SHINGLE):
        shingle = C.mix(shingle * np.uint64(0xC2B2AE3D27D4EB4F) + value[begins + k])
    total = np.bincount(doc[begins], minlength=n)
    far = (total - _distinct(doc[begins], shingle, n)) / (total + FEW)
    return usual, np.maximum(near, far)


def measures(texts: Sequence[str | None], english: np.ndarray, chinese: re.Pattern[str]) -> np.ndarray:
    """Statistics in the order of STATS, then words, lines, visible characters and whether the language is Chinese; a row per text."""
    texts = ["" if t is None else t for t in texts]
    cp, starts, ends = C.spans(C.to_array(C.join(texts)))
    kinds = _classes()[cp]
    same = np.repeat(np.arange(len(texts)), ends - starts)

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mask)))
        return total[ends] - total[starts]

    latin = (kinds & _LATIN) > 0
    goes_on = np.concatenate(([False], latin[:-1] & (same[1:] == same[:-1]))) if len(cp) else latin
    n_latin, n_han = count(latin), count((kinds & _HANZI) > 0)
    words = count(latin & ~goes_on) + n_han
    visible = np.maximum(ends - starts - count((kinds & _BLANK) > 0), 1)
    middle = np.zeros(len(cp), bool)  # the second of three characters that only wrong decoding gives together
    if len(cp) > 2:
        middle[1:-1] = (cp[1:-1] == ord("斤")) & (cp[:-2] == ord("锟")) & (cp[2:] == ord("拷"))
    usual, repeated = word_counts(texts, english)
    k = len(STATS)
    out = np.zeros((len(texts), k + 4))
    for i, text in enumerate(texts):
        lines = [x for x in text.split("\n") if x.strip()]
        if not lines:
            continue
        n = len(lines)
        sentences = [x for x in map(str.strip, _SPLIT.split(text)) if x]
        out[i, k + 1] = n
        out[i, [3, 4, 5, 6, 8, 9]] = (
            sum(bool(_END.search(x)) for x in lines) / n, sum(map(len, chinese.findall(text))) if n_han[i] else 0, sum(is_entry(x, n >= BARE) for x in lines) / n,
            sum(is_row(x, n >= ROWS) for x in lines) / n, sum(map(len, _RUN.findall(text))) / visible[i], (len(sentences) - len(set(sentences))) / (len(sentences) + 2),
        )
    full = out[:, k + 1] > 0
    out[:, 0] = np.log1p(words)
    out[:, 1] = (n_latin + n_han) / np.maximum(words, 1)
    out[:, 2] = count((kinds & _SYMBOL) > 0) / visible
    out[:, 4] = (out[:, 4] + usual + PRIOR_WORDS * PRIOR_SHARE) / (words + PRIOR_WORDS)
    out[:, 7] = count(((kinds & _ODDITY) > 0) | middle) / visible
    out[:, 10] = np.log1p(visible / np.maximum(out[:, k + 1], 1))
    out[:, 11] = count((kinds & _DIGIT) > 0) / visible
    out[:, 12] = repeated
    out[:, k], out[:, k + 2], out[:, k + 3] = words, visible, n_han > 0.3 * (n_han + n_latin)
    return np.where(full[:, None], out, 0.0)


def _measured(docs: DataFrame, words: DataFrame, key: str, text: str) -> DataFrame:
    rows = words.select("lang", "word").where("word is not null").collect()  # a word list: its size doesn't follow the documents
    english = word_hashes(sorted({r[1].lower() for r in rows if _WORD.fullmatch(r[1])}))
    han = sorted({r[1] for r in rows if _HAN.search(r[1])}, key=len, reverse=True)
    chinese = re.compile("|".join(map(re.escape, han)) or "(?!)")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k = len(STATS)
        for b in (w.iloc[low:high] for w in batches for low, high in C.slices(w["t"].tolist(), SLICE)):
            m = measures(b["t"].tolist(), english, chinese)
            yield pd.DataFrame({
                "k": b["k"].to_numpy(), "zh": m[:, k + 3] > 0, "x": list(m[:, :k]), "words": m[:, k].astype(np.int64),
                "lines": m[:, k + 1].astype(np.int64), "chars": m[:, k + 2].astype(np.int64),
            })

    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(
        run, "k bigint, zh boolean, x array<double>, words bigint, lines bigint, chars bigint"
    )


def _moments(measured: DataFrame, core) -> dict[bool, tuple[np.ndarray, np.ndarray]]:
    """Mean and covariance per language of the rows that ``core(zh, x)`` keeps."""
    d = len(STATS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for zh in (False, True):
                x = np.stack(b["x"][b["zh"] == zh].to_list()) if (b["zh"] == zh).any() else np.zeros((0, d))
                x = x[core(zh, x)] if len(x) else x
                if not len(x):
                    continue
                one = np.hstack((np.ones((len(x), 1)), x))
                s = one.T @ one
                i, j = np.triu_indices(d + 1)
                yield pd.DataFrame({"zh": zh, "i": i.astype(np.int32), "j": j.astype(np.int32), "s": s[i, j]})

    rows = measured.mapInPandas(run, "zh boolean, i int, j int, s double").groupBy("zh", "i", "j").agg(F.sum("s").alias("s")).collect()
    out = {}
    for zh in (False, True):
        s = np.zeros((d + 1, d + 1))
        for r in rows:
            if r["zh"] == zh:
                s[r["i"], r["j"]] = s[r["j"], r["i"]] = r["s"]
        n = s[0, 0]
        mean = s[0, 1:] / n if n else np.zeros(d)
        cov = s[1:, 1:] / n - np.outer(mean, mean) if n > 2 * d else np.zeros((d, d))
        out[zh] = mean, cov + np.diag(SPREAD**2)
    return out


def _distances(x: np.ndarray, fit: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Contribution of each statistic to the squared distance; shape like x."""
    c = x - fit[0]
    return c * np.linalg.solve(fit[1], c.T).T


def prose_fit(measured: DataFrame) -> dict[bool, tuple[np.ndarray, np.ndarray]]:
    """Robust mean and covariance of prose for Chinese (True) and other text (False)."""
    cols = [F.element_at("x", i + 1).alias(s) for i, s in enumerate(STATS)]
    flat = measured.where("words >= 8").select("zh", *cols)
    centre = {r["zh"]: np.array([r[s] for s in STATS]) for r in flat.groupBy("zh").agg(*(F.percentile_approx(s, 0.5, 2000).alias(s) for s in STATS)).collect()}

    def first(zh: bool, x: np.ndarray) -> np.ndarray:
        return (np.abs(x - centre.get(zh, np.zeros(len(STATS)))) <= 4 * np.maximum(SPREAD, [1.2, 1.2, 0, 0.2, 0.05, 0.02, 0, 0, 0, 0, 1.0, 0, 0.1])).all(axis=1)

    fit = _moments(measured, first)
    for _ in range(2):
        last = fit
        fit = _moments(measured, lambda zh, x, last=last: _distances(x, last[zh]).sum(axis=1) <= CUT)
    return fit


#: Statistics whose excess (for common words: lack) is evidence of a form.
EVIDENCE = {
    "list": ("entry_lines",), "table": ("cell_lines",),
    "junk": ("odd_chars", "machine_runs", "symbol_ratio", "repeated_sentences", "repeated_words", "digit_ratio", "common_words"),
}


def form_of(x: np.ndarray, centre: np.ndarray, contributions: np.ndarray) -> np.ndarray:
    """Form of documents from what each statistic contributes to their distance from prose (``centre``)."""
    side = np.sign(x - centre)
    side[:, STATS.index("common_words")] *= -1
    towards = np.where(side > 0, contributions, 0.0)
    g = {form: towards[:, [STATS.index(s) for s in names]].sum(axis=1) for form, names in EVIDENCE.items()}
    unreadable = towards[:, [STATS.index("odd_chars"), STATS.index("machine_runs")]].sum(axis=1) > np.maximum(np.maximum(g["list"], g["table"]), CUT)
    table = (g["table"] > CUT) & (x[:, STATS.index("cell_lines")] >= WHOLE)
    entries = (g["list"] > CUT) & (x[:, STATS.index("entry_lines")] >= WHOLE)
    form = np.select([unreadable, table, entries, g["junk"] > NAMED], ["junk", "table", "list", "junk"], "prose")
    return np.where(contributions.sum(axis=1) > CUT, form, "prose")


def profiled(docs: DataFrame, words: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: statistics, squared distance, contributions, and form."""
    measured = cut(_measured(docs, words, key, text))
    fit = prose_fit(measured)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            x = np.stack(b["x"].to_list())
            zh = b["zh"].to_numpy(bool)
            parts, centre = np.zeros_like(x), np.where(zh[:, None], fit[True][0], fit[False][0])
            for z in (False, True):
                if (zh == z).any():
                    parts[zh == z] = _distances(x[zh == z], fit[z])
            blank = b["chars"].to_numpy() == 0
            parts[blank] = 0.0
            d2, form = parts.sum(axis=1), form_of(x, centre, parts)
            yield pd.DataFrame({
                key: b["k"], "language": np.where(zh, "zh", "en"), "words": b["words"], "lines": b["lines"], "chars": b["chars"],
                "x": list(x), "distance2": d2, "contributions": list(parts), "form": form,
            })

    schema = f"{key} bigint, language string, words bigint, lines bigint, chars bigint, x array<double>, distance2 double, contributions array<double>, form string"
    return measured.mapInPandas(run, schema)


def _tables(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/common_words.parquet")


def found(spark, sf_dir: str) -> DataFrame:
    """Query p8_found: (doc_id, form) of documents that are not prose."""
    return profiled(*_tables(spark, sf_dir)).where("form <> 'prose'").select("doc_id", "form")


def report(spark, sf_dir: str) -> DataFrame:
    """Query p8_statistics: every statistic of every document, its distance and what contributed most."""
    p = profiled(*_tables(spark, sf_dir))
    top = F.array_position("contributions", F.array_max("contributions")).cast("int")
    named = [F.round(F.element_at("x", i + 1), 6).alias(s) for i, s in enumerate(STATS)]
    return p.select(
        "doc_id", "language", "words", "lines", *named, F.round("distance2", 4).alias("distance2"),
        F.element_at(F.array(*(F.lit(s) for s in STATS)), top).alias("largest_contribution"), "form",
    )
