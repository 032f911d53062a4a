"""Texts that break off before their writer's end.

1. The page's own lines (see ``sitelines``, at lower shares) and expansion controls are taken off the
   end; what is left is the body, its last line the ending.
2. The lengths of text and body are computed under alternative encodings (code points, UTF-8, UTF-16,
   GB 18030 width, entity escaping, JSON escaping with and without ASCII, CRLF and LF line ends) and
   counted per source; a length that open endings hit far more often than its neighbours is a hidden
   storage limit.
3. Endings are inspected: a sentence mark ends a text; a broken character, entity, tag or an ellipsis
   with an expansion label cuts it; anything else is complete only if it has the form of a closing
   (signature, hash tags, reference, link, fence, list entry) and doesn't sit at a hidden limit, or recurs as a
   whole line or closing form in other texts, or is a remark without any punctuation. Closings, forms, page lines
   and limits are counted over distinct texts, closings and forms over texts that begin differently as well:
   copies and edited copies of one text prove nothing about its ending.

A text that ends with a sentence mark is complete even at a limit: length alone proves nothing (see README).

Defined results: null and blank texts are not truncated (nothing breaks off); a flag in ``truncated`` is
not read; repeated rows are judged alike; empty tables give no rows; only named columns are read.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions import codepoints as C
from tidemill.llm import sitelines
from tidemill.session import cut

ENCODINGS = ("points", "utf8", "utf16", "gb18030", "html", "json_ascii", "json", "crlf", "crlf_utf8", "lf", "html_utf8")
PAGE = sitelines.Rule(source_share=0.01, account_share=0.05)
TERMINAL, FORM, OPEN, CUT = 0, 1, 2, 3
#: A usual closing ends this share of all distinct texts, three at least; half of those at least begin differently.
#: A lower share takes broken stock sentences for closings ("If you are also preparing" cut at the same word in several texts).
CLOSING_SHARE, CLOSING_TEXTS, CLOSING_OPENINGS = 0.0004, 3, 0.5
OPENING = 16  # letters and digits that tell texts from edited copies

# Expansion labels of folded text, with or without brackets.
FOLDED = ("展开全文", "展开全部", "展开", "显示全部", "查看全部", "查看全文", "查看剩余内容", "阅读全文", "查看更多", "收起前的内容已折叠，点此展开",
          "收起前的内容已折叠,点此展开", "read more", "show more", "see more", "continue reading")
#: Labels of unfolded text and of reactions below it; they are no part of the text.
UNFOLDED = ("收起", "收起全文", "show less")

_STRIP = "[]【】()（）<>《》「」*_~ \t\r​　 "
_ENDS = set("。．.！!？?；;」』”’\"'）)】〕》〉>}~～`")
_MARKER = re.compile(rf"(?:…|\.\.\.|⋯)\s*(?:{'|'.join(map(re.escape, FOLDED))})?\s*$|(?:{'|'.join(map(re.escape, FOLDED[2:9]))})\s*$", re.I)
_BROKEN = re.compile(r"�\s*$|&(?:#?[a-zA-Z0-9]{0,7})$|<[a-zA-Z/!][^<>]{0,60}$|!?\[[^\]\s]{0,12}$|\\u?[0-9a-fA-F]{0,3}$|[(（「『《【“‘\[{,，、：:]\s*$")
_URL = re.compile(r"https?://[^\s，。]+$")
_FORMS = re.compile(
    r"^\s*(?:[—–-]{1,3}\s?\S.{0,40}|#\S.*#|`{3,}|v?\d+(?:\.\d+)+|(?:参考|出处|来源|ref(?:erence)?s?)\s*[：:].{1,80}[》”\"章节页)）\d]|\+\d+)\s*$", re.I
)
_LIST = re.compile(r"^\s*(?:[-*•·]|\d+[.、)])\s+\S")
_SENTENCE = re.compile(r"[。！？!?，,；;]|\.\s")
_POINT = re.compile(r"[，。！？；：、…,.!?;:\n]")


def _weights(cp: np.ndarray) -> Iterator[np.ndarray]:
    """Size of each code point under each encoding, one after the other."""
    one = np.ones(len(cp), np.int32)
    utf8 = one + (cp >= 0x80) + (cp >= 0x800) + (cp >= 0x10000)
    astral = (cp >= 0x10000).astype(np.int32)
    prev_cr = np.concatenate(([False], cp[:-1] == 13)) if len(cp) else np.zeros(0, bool)
    next_lf = np.concatenate((cp[1:] == 10, [False])) if len(cp) else np.zeros(0, bool)
    bare_lf = ((cp == 10) & ~prev_cr).astype(np.int32)
    cr_of_pair = ((cp == 13) & next_lf).astype(np.int32)
    html = np.zeros(len(cp), np.int32)
    for ch, extra in (("&", 4), ("<", 3), (">", 3), ('"', 5), ("'", 5)):
        html += (cp == ord(ch)) * np.int32(extra)
    escaped = ((cp == 34) | (cp == 92) | (cp == 10) | (cp == 13) | (cp == 9)).astype(np.int32)
    control = ((cp < 32) & (escaped == 0)).astype(np.int32) * 5
    ascii_extra = np.where(cp >= 0x10000, 11, np.where(cp >= 0x80, 5, 0)).astype(np.int32)
    gb = one + (cp >= 0x80) + 2 * astral
    yield one
    yield utf8
    yield one + astral
    yield gb
    yield one + html
    yield one + escaped + control + ascii_extra
    yield one + escaped + control
    yield one + bare_lf
    yield utf8 + bare_lf
    yield one - cr_of_pair
    yield utf8 + html


def lengths(texts: list[str], parts: list[int] | None = None) -> np.ndarray:
    """Length of each text under each encoding, then of its first ``parts`` characters; shape (n, len(ENCODINGS)) or twice as wide."""
    cp, starts, ends = C.spans(C.to_array(C.join(texts)))
    out = np.zeros((len(ENCODINGS) * (1 if parts is None else 2), len(texts)), np.int32)
    stops = None if parts is None else starts + np.asarray(parts, np.int64)
    for i, w in enumerate(_weights(cp)):
        total = np.concatenate(([0], np.cumsum(w, dtype=np.int64)))
        out[i] = total[ends] - total[starts]
        if stops is not None:
            out[len(ENCODINGS) + i] = total[stops] - total[starts]
    return out.T


def ending(line: str) -> int:
    """Kind of a body's last line; see the module text."""
    s = line.rstrip(" \t\r​　 *_")
    if not s:
        return FORM
    if _MARKER.search(s):
        before = _MARKER.sub("", s).rstrip()
        # a doubled ellipsis is a writer's mark; an ellipsis after a sentence mark cuts nothing
        if s.endswith(("……", "⋯⋯")) or before.endswith("…"):
            return CUT if not s.endswith("…") else OPEN
        return FORM if before and before[-1] in "。！？!?" else CUT
    if _URL.search(s):
        return FORM
    if _BROKEN.search(s) and not _FORMS.match(s):
        return CUT
    last = s[-1]
    if last in _ENDS:
        return TERMINAL
    if _FORMS.match(s) or unicodedata.category(last) in ("So", "Sk", "Mn", "Cf"):
        return FORM
    return OPEN


def _masked(line: str) -> str:
    return re.sub(r"[0-9]+", "9", unicodedata.normalize("NFKC", line).strip().lower())


def body_of(text: str, marked: set[int]) -> tuple[str, str, bool]:
    """Body, its last line, and whether a folded-text label followed it."""
    lines = text.split("\n")
    j, folded = len(lines), False
    while j:
        bare = lines[j - 1].strip(_STRIP)
        if bare and j not in marked:
            low = bare.lower()
            if low in FOLDED:
                folded = True
            elif low not in UNFOLDED:
                break
        j -= 1
    return "\n".join(lines[:j]), lines[j - 1] if j else "", folded


def _features(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """One row per text with a body: kind of ending, keys of its last line and form, lengths."""
    at = marked.groupBy("seq").agg(F.collect_set("line_no").alias("marked"))
    slim = docs.select("seq", "source", "text").where("text is not null").join(at, "seq", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole, (low, high) in ((w, r) for w in batches for r in C.slices(w["text"].tolist())):
            b = whole.iloc[low:high].reset_index(drop=True)
            texts = b["text"].tolist()
            bodies, kinds, lines = [], [], []
            for t, m in zip(texts, b["marked"], strict=True):
                body, last, folded = body_of(t, set() if m is None else set(m))
                k = ending(last) if last else TERMINAL
                if folded and k in (OPEN, FORM) and not (last.rstrip() and last.rstrip()[-1] in _ENDS):
                    k = CUT
                if k == OPEN and not _POINT.search(body.strip()):
                    k = FORM  # a remark: its writer uses no marks at all
                bodies.append(body)
                kinds.append(k)
                lines.append(last)
            _, _, key, _ = sitelines.line_table([x.replace("\n", " ") for x in lines])
            masked = [_masked(x) for x in lines]
            exact = [sitelines.code(m, 2) for m in masked]
            form = [sitelines.code(f"{m[:4]}\x00{m[-3:]}", 3) if len(m) >= 6 else 0 for m in masked]
            both = lengths(texts, [len(x) for x in bodies])
            cp, starts, ends = C.normalised([x[:256] for x in bodies])
            opening = C.segment_hashes(cp, starts, np.minimum(ends, starts + OPENING)).view(np.int64)
            entry = [bool(_LIST.match(x)) or (len(x) < 40 and not _SENTENCE.search(x)) for x in lines]
            yield pd.DataFrame({
                "seq": b["seq"], "source": b["source"], "kind": kinds, "key": key, "exact": exact, "form": form,
                "entry": entry, "lengths": list(both), "body": [sitelines.code(x, 4) for x in bodies], "opening": opening,
            })

    return slim.mapInPandas(
        run, "seq bigint, source string, kind int, key bigint, exact bigint, form bigint, entry boolean, lengths array<int>, body bigint, opening bigint"
    )


def hidden_limits(features: DataFrame, reach: int = 12, ratio: float = 6.0, least: int = 5) -> DataFrame:
    """``(source, measure, length, open_rows, rows)``: lengths at which endings stay open far more often than nearby.

    measure is an index into the encodings of the text, then of the body.
    """
    once = features.groupBy("source", "body").agg(F.min_by(F.struct("kind", "lengths"), "seq").alias("f")).select("source", "f.*")
    each = once.select("source", (F.col("kind") >= OPEN).cast("int").alias("open"), F.posexplode("lengths").alias("measure", "length"))
    count = each.groupBy("source", "measure", "length").agg(F.sum("open").alias("open_rows"), F.count("*").alias("rows"))
    near = Window.partitionBy("source", "measure").orderBy("length").rangeBetween(-reach, reach)
    around = (F.sum("open_rows").over(near) - F.col("open_rows")) / F.lit(2.0 * reach)
    total = F.sum("open_rows").over(Window.partitionBy("source", "measure"))
    return count.withColumn("around", around).withColumn("total", total).where(
        (F.col("open_rows") >= least) & (F.col("open_rows") >= ratio * (F.col("around") + 0.25)) & (F.col("open_rows") >= 0.01 * F.col("total"))
    ).drop("around", "total")


def distinct_texts(docs: DataFrame) -> DataFrame:
    """One row of each text of a source, the first captured."""
    first = docs.where("text is not null").groupBy("source", F.xxhash64("text").alias("h"), F.length("text").alias("n")).agg(F.min("seq").alias("seq"))
    return docs.join(first.select("seq"), "seq", "left_semi")


def _recurring(endings: DataFrame, by: str, texts: int) -> DataFrame:
    """Values of ``by`` that end a closing's share of the ``texts``, with different openings. Counts are partial before each exchange."""
    per_opening = endings.select(by, "opening", "body").distinct().groupBy(by, "opening").agg(F.count("*").alias("n"))
    of_value = per_opening.groupBy(by).agg(F.count("*").alias("openings"), F.sum("n").alias("bodies"))
    least = max(CLOSING_TEXTS, CLOSING_SHARE * texts)
    return of_value.where((F.col("bodies") >= least) & (F.col("openings") >= CLOSING_TEXTS) & (F.col("openings") >= CLOSING_OPENINGS * F.col("bodies")))


def _inspected(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Features of the texts, and the lines they were found with."""
    lines = cut(sitelines.lines_of(docs))
    first = distinct_texts(docs.select("seq", "source", "author", "text"))
    marks = sitelines.site_lines(first, PAGE, lines.join(first.select("seq"), "seq", "left_semi"))
    return cut(_features(docs, sitelines.marked_lines(docs, marks, lines))), lines


def limits_of(docs: DataFrame) -> DataFrame:
    """``(source, part, encoding, length, open_rows, rows)``: the hidden limits, of whole texts and of their bodies."""
    names = F.array(*(F.lit(e) for e in ENCODINGS))
    n = len(ENCODINGS)
    return hidden_limits(_inspected(docs)[0]).select(
        "source", F.when(F.col("measure") < n, "text").otherwise("body").alias("part"), F.get(names, F.col("measure") % n).alias("encoding"), "length", "open_rows", "rows"
    )


def truncated(docs: DataFrame) -> DataFrame:
    """``(seq, source, reason, limit_measure, limit_length)`` of the texts that break off."""
    features, lines = _inspected(docs)
    limits = cut(hidden_limits(features))
    doubtful = features.where(F.col("kind").isin(FORM, OPEN)).select("seq", "source", "kind", "key", "exact", "form", "entry", "lengths", "body", "opening")
    # every ending counts, so that a line which only ever ends texts doesn't seem to stand inside of one
    final = features.join(doubtful.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.count("*").alias("ending_rows"))
    stands = lines.where(F.col("flags").bitwiseAND(sitelines.ONCE) != 0).join(final.select("key"), "key", "left_semi").groupBy("key").agg(F.count("*").alias("line_rows"))
    inside = stands.join(final, "key").select("key", (F.col("line_rows") > F.col("ending_rows")).alias("stands_inside"))
    texts = features.agg(F.approx_count_distinct("body", 0.01)).head()[0]
    usual_lines = _recurring(doubtful, "exact", texts).select("exact", F.lit(True).alias("usual_line"))
    usual_forms = _recurring(doubtful.where("form <> 0"), "form", texts).select("form", F.lit(True).alias("usual_form"))
    hits = (
        doubtful.select("seq", "source", F.posexplode("lengths").alias("measure", "length"))
        .join(limits.select("source", "measure", "length"), ["source", "measure", "length"])
        .groupBy("seq").agg(F.min_by(F.struct("measure", "length"), "measure").alias("limit"))
    )
    judged = (
        doubtful.drop("lengths", "body", "opening").join(inside, "key", "left").join(usual_lines, "exact", "left").join(usual_forms, "form", "left").join(hits, "seq", "left")
    )
    usual = F.col("usual_line").isNotNull() | (F.coalesce(F.col("stands_inside"), F.lit(False)) & F.col("entry"))
    closing = usual | F.col("usual_form").isNotNull()
    at_limit = F.col("limit").isNotNull()
    reason = (
        F.when((F.col("kind") == OPEN) & at_limit & ~usual, "limit")
        .when((F.col("kind") == OPEN) & ~closing, "open")
        .when((F.col("kind") == FORM) & at_limit & ~closing, "limit")
    )
    soft = judged.select("seq", "source", reason.alias("reason"), "limit.measure", "limit.length").where("reason is not null")
    hard = features.where(F.col("kind") == CUT).select(
        "seq", "source", F.lit("cut").alias("reason"), F.lit(None).cast("int").alias("measure"), F.lit(None).cast("int").alias("length")
    )
    return soft.unionByName(hard)


def _docs(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/collected_documents.parquet").select("seq", "source", "author", "text")


def found(spark, sf_dir: str) -> DataFrame:
    """Query p1_found: (seq) of truncated rows."""
    return truncated(_docs(spark, sf_dir)).select("seq")


def shares(spark, sf_dir: str) -> DataFrame:
    """Query p1_sources: rows, truncated rows and their share for each source."""
    docs = _docs(spark, sf_dir)
    bad = cut(truncated(docs)).groupBy("source").agg(F.count("*").alias("truncated_rows"))
    every = docs.groupBy("source").agg(F.count("*").alias("rows"))
    joined = every.join(bad, every["source"].eqNullSafe(bad["source"]), "left").drop(bad["source"])
    n = F.coalesce("truncated_rows", F.lit(0))
    return joined.select("source", "rows", n.alias("truncated_rows"), F.round(n / F.col("rows"), 6).alias("truncated_share"))


def limits(spark, sf_dir: str) -> DataFrame:
    """Query p1_limits: hidden storage limits of each source, under each encoding that shows them."""
    return limits_of(_docs(spark, sf_dir))
