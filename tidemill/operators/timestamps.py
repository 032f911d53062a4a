"""Mixed timestamp forms and zones to one UTC instant.

Each value is reduced to a *shape mask*: digits become ``9``, month names ``M``, weekday names ``W``,
day-part words ``P``, zone abbreviations ``Z`` and region names ``R``; other characters stay. Every
distinct mask is matched against the grammar once per Python worker and gives a parser (which runs of
digits are which field); all values with the mask are then converted together in numpy, and wall-clock
times go to UTC by binary search in zone transition tables made from one dated release of the zone
database (see :func:`zone_release`).

Defined results: null, blank, placeholder and impossible values give a null instant and are left out
by :func:`instants`; repeated rows give one row each; an empty table gives no rows; other columns of
the input are never read, so their names cannot clash.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

US = 1_000_000
DAY = 86_400 * US
NAT = np.iinfo(np.int64).min
LOW, HIGH = 946_684_800 * US, 4_102_444_800 * US  # 2000-01-01 and 2100-01-01

# Names as they occur in written dates.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
MONTH_WORDS = (
    "january|february|march|april|may|june|july|august|september|october|november|december"
    "|jan|feb|mar|apr|jun|jul|aug|sept|sep|oct|nov|dec"
)
WEEKDAY_WORDS = (
    "monday|tuesday|wednesday|thursday|friday|saturday|sunday|mon|tues|tue|wed|thurs|thur|thu|fri|sat|sun"
    "|星期[一二三四五六日天]|周[一二三四五六日天]"
)
# Day parts: AM-like words keep the hour (12 is 0), PM-like ones add 12 (12 stays).
AM_WORDS = ("am", "a.m.", "上午", "凌晨", "早上", "清晨")
PM_WORDS = ("pm", "p.m.", "下午", "晚上", "傍晚", "中午")
# Abbreviations with one accepted meaning, in minutes east of UTC.
ABBREVIATIONS = {
    "utc": 0, "gmt": 0, "z": 0, "wet": 0, "bst": 60, "west": 60, "cet": 60, "cest": 120, "eet": 120, "eest": 180,
    "msk": 180, "ist": 330, "hkt": 480, "sgt": 480, "awst": 480, "jst": 540, "kst": 540, "aest": 600, "aedt": 660,
    "nzst": 720, "nzdt": 780, "est": -300, "edt": -240, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480,
    "pdt": -420, "akst": -540, "akdt": -480, "hst": -600,
}

_TOKEN = re.compile(
    rf"(?P<R>[a-z]+(?:/[a-z_+-]+[0-9]*)+)|(?<![a-z])(?:(?P<M>{MONTH_WORDS})|(?P<W>{WEEKDAY_WORDS}))(?![a-z])\.?"
    rf"|(?P<P>上午|下午|凌晨|早上|清晨|晚上|傍晚|中午|(?<![a-z])(?:am|pm)(?![a-z])|[ap]\.m\.)"
    rf"|(?<![a-z])(?P<Z>{'|'.join(sorted((a for a in ABBREVIATIONS if a != 'z'), key=len, reverse=True))})(?![a-z+-])"
    rf"|星期[一二三四五六日天]|周[一二三四五六日天]"
)
_DIGIT = re.compile("[0-9]")
_NUMBERS = re.compile("[0-9]+")
_BLANKS = re.compile(r"\s+")
_DASHES = re.compile("[\u2010-\u2015\u2212]")

# ---------------------------------------------------------------------------------------------
# The grammar over masks. Groups name fields; each is a run of the mask's digits or a word class.
_TIME = (
    r"(?:(?P<pm1>P)\s*)?(?P<H>99?)[:时點点](?P<MI>99?)(?:分?[:]?(?P<S>99)秒?(?:[.,](?P<F>9{1,12}))?|分)?(?:\s*(?P<pm2>P))?"
)
_ZONE = (
    r"(?:\s*(?P<utc>z)|\s*(?P<abbr>Z)(?:\s*(?P<sgn2>[+-])(?P<zh2>99?)(?::?(?P<zm2>99))?)?"
    r"|\s*(?P<sgn>[+-])(?P<zh>99)(?::?(?P<zm>99))?|\s*[\[(]?(?P<region>R)[\])]?)?(?:\s*\(Z\))?"
)
_LEAD = r"\D{0,12}?"
_DATES = (
    r"(?P<Y>9999)[-/.](?P<MO>99?)[-/.](?P<D>99?)",
    r"(?P<Y>9999)年(?P<MO>99?)月(?P<D>99?)[日号]?",
    r"(?P<Y2>99)[-/.](?P<MO>99?)[-/.](?P<D>99?)",
    r"(?P<Y2>99)年(?P<MO>99?)月(?P<D>99?)[日号]?",
)
_FORMS = tuple(
    re.compile(rf"{lead}{d}(?:(?:[t\s]\s*|(?=P))(?:W\s*)?{_TIME}{_ZONE})?")
    for d in _DATES
    for lead in (r"(?:[^\x00-\x7f]+[:\s]*)?(?:W,?\s*)?",)
) + (
    re.compile(rf"(?P<Y>9999)(?P<MO>99)(?P<D>99)(?:t?\s?(?P<H>99)(?P<MI>99)(?P<S>99)(?:[.,](?P<F>9{{1,12}}))?{_ZONE})"),
    re.compile(rf"(?:W,?\s*)?(?P<D>99?)[\s-]+(?P<MN>M)[\s-]+(?P<Y>9999)(?:,?\s+{_TIME}{_ZONE})?"),
    re.compile(rf"(?:W,?\s*)?(?P<MN>M)\s+(?P<D>99?),?\s+(?P<Y>9999)(?:,?\s+(?:at\s+)?{_TIME}{_ZONE})?"),
    re.compile(rf"W,?\s*(?P<MN>M)\s+(?P<D>99?)\s+{_TIME}\s+(?:(?P<zz>Z)\s+)?(?P<Y>9999)"),
)
_YEARLESS = tuple(
    re.compile(rf"(?:[^\x00-\x7f]+[:\s]*)?{d}\s*{_TIME}")
    for d in (r"(?P<MO>99?)[-/.](?P<D>99?)\s", r"(?P<MO>99?)月(?P<D>99?)[日号]")
)
_EPOCH = re.compile(r"-?9{9,10}|9{13}|9{16}")
_AGO = re.compile(r"(?:[^\x00-\x7f9]+[:\s])?(?P<N>9{1,6})\s*(?P<unit>分钟|小时|秒钟?|天|日)前")
_DAYWORD = re.compile(rf"(?:[^\x00-\x7f]+[:\s]+)?(?P<word>今天|昨天|前天|大前天)\s*(?:{_TIME})?")
_NOW = re.compile(r"(?:[^\x00-\x7f]+[:\s]+)?刚刚")


@dataclass(frozen=True)
class Parser:
    """How to read one mask: kind, and for each field the ordinal of its digit run or word."""

    kind: str  # date, yearless, epoch, ago, day, now, none
    runs: tuple[tuple[str, int], ...] = ()
    sign: int = 1
    word: str = ""
    zone: str = ""  # utc, offset, abbr, region or ''
    pm: bool = False


@lru_cache(maxsize=100_000)
def parser_for(mask: str) -> Parser:
    """The parser of a mask; the one place where the grammar is consulted."""
    starts = {m.start(): i for i, m in enumerate(re.finditer("9+", mask))}

    def runs(m: re.Match[str], names: str) -> tuple[tuple[str, int], ...]:
        # a run may hold several fields (compact forms), so the offset inside the run is kept as well
        out = []
        for name in names.split():
            if m.groupdict().get(name) is not None:
                s = m.start(name)
                base = max(k for k in starts if k <= s)
                out.append((name, starts[base] * 1000 + (s - base)))
        return tuple(out)

    if _EPOCH.fullmatch(mask):
        return Parser("epoch", sign=-1 if mask[0] == "-" else 1, word=str(mask.count("9")))
    fields = "Y Y2 MO D H MI S F zh zm zh2 zm2"
    for kind, forms in (("date", _FORMS), ("yearless", _YEARLESS)):
        for form in forms:
            if m := form.fullmatch(mask):
                g = m.groupdict()
                zone = (
                    "utc" if g.get("utc") else "region" if g.get("region") else "offset" if g.get("sgn") or g.get("sgn2")
                    else "abbr" if g.get("abbr") or g.get("zz") else ""
                )
                minus = (g.get("sgn") or g.get("sgn2")) == "-"
                return Parser(kind, runs(m, fields), -1 if minus else 1, "M" if g.get("MN") else "", zone, bool(g.get("pm1") or g.get("pm2")))
    if m := _AGO.fullmatch(mask):
        return Parser("ago", runs(m, "N"), word=m["unit"])
    if m := _DAYWORD.fullmatch(mask):
        return Parser("day", runs(m, "H MI S F"), word=m["word"], pm=bool(m["pm1"] or m["pm2"]))
    return Parser("now") if _NOW.fullmatch(mask) else Parser("none")


def shape(value: str) -> tuple[str, dict[str, str]]:
    """The mask of a value and its words by class."""
    words: dict[str, str] = {}

    def put(m: re.Match[str]) -> str:
        kind = m.lastgroup or "W"
        words[kind] = m.group(kind) if m.lastgroup else m.group()
        return kind

    return _DIGIT.sub("9", _TOKEN.sub(put, value)), words


def clean(value: str) -> str:
    """NFKC, lower case, blanks and invisible characters unified, dashes and minus signs as ``-``."""
    if value.isascii():
        return _BLANKS.sub(" ", value).strip().lower()
    v = unicodedata.normalize("NFKC", value).lower()
    v = "".join(c for c in v if unicodedata.category(c) != "Cf")
    return _BLANKS.sub(" ", _DASHES.sub("-", v)).strip()


# ---------------------------------------------------------------------------------------------
# Zone transition tables.
@lru_cache(maxsize=1)
def zone_release() -> str:
    """Release of the zone database that the tables come from."""
    try:
        import tzdata

        return str(tzdata.IANA_VERSION)
    except ImportError:
        return "system"


@lru_cache(maxsize=2048)
def transitions(name: str) -> tuple[np.ndarray, np.ndarray] | None:
    """Wall-clock thresholds and offsets (both in microseconds) of a zone from 1990 to 2110.

    A local time ``w`` belongs to offset ``offsets[searchsorted(thresholds, w, 'right')]``. The
    threshold of a change at instant t is t plus the larger of both offsets: a time that occurs twice
    is read as the earlier one, and one in a gap keeps the old offset, which moves it forward by the gap.
    """
    from datetime import datetime, timedelta, timezone
    from zoneinfo import ZoneInfo

    try:
        zone = ZoneInfo(_zone_name(name))
    except Exception:  # noqa: BLE001 - not a zone of this release
        return None
    epoch = datetime(1970, 1, 1, tzinfo=timezone.utc)

    def offset(s: int) -> int:
        return int((epoch + timedelta(seconds=s)).astimezone(zone).utcoffset().total_seconds())

    low, high, step = 631_152_000, 4_417_977_600, 7 * 86_400
    offsets, limits, last = [offset(low)], [], offset(low)
    for s in range(low + step, high, step):
        now = offset(s)
        if now != last:
            a, z = s - step, s
            while z - a > 1:
                mid = (a + z) // 2
                a, z = (mid, z) if offset(mid) == last else (a, mid)
            limits.append(z + max(last, now))
            offsets.append(now)
            last = now
    return np.array(limits, np.int64) * US, np.array(offsets, np.int64) * US


@lru_cache(maxsize=1)
def _zone_names() -> dict[str, str]:
    from zoneinfo import available_timezones

    return {n.lower(): n for n in available_timezones()}


def _zone_name(name: str) -> str:
    return _zone_names().get(name.strip().lower(), name.strip())


def wall_to_utc(wall: np.ndarray, zone: str) -> np.ndarray | None:
    """Local microseconds to UTC microseconds; None for an unknown zone."""
    table = transitions(zone)
    if table is None:
        return None
    return wall - table[1][np.searchsorted(table[0], wall, side="right")]


def days_from_civil(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Days since 1970-01-01 of proleptic Gregorian dates."""
    y = y - (m <= 2)
    era = y // 400
    yoe = y - era * 400
    doy = (153 * (m + np.where(m > 2, -3, 9)) + 2) // 5 + d - 1
    return era * 146_097 + yoe * 365 + yoe // 4 - yoe // 100 + doy - 719_468


_MONTH_DAYS = np.array([31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])


def valid_date(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> np.ndarray:
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    ok = (m >= 1) & (m <= 12)
    most = _MONTH_DAYS[np.where(ok, m, 1) - 1] + ((m == 2) & leap)
    return ok & (d >= 1) & (d <= most)


def _years(us: np.ndarray) -> np.ndarray:
    return us.astype("datetime64[us]").astype("datetime64[Y]").astype(np.int64) + 1970


# ---------------------------------------------------------------------------------------------
WIDTH = {"Y": 4, "Y2": 2, "MO": 2, "D": 2, "H": 2, "MI": 2, "S": 2, "zh": 2, "zm": 2, "zh2": 2, "zm2": 2}


def convert(
    values: list[str | None],
    zones: list[str | None],
    defaults: list[int],
    collected: np.ndarray,
    yearless: np.ndarray,
) -> np.ndarray:
    """UTC microseconds of each value, ``NAT`` where it denotes no instant.

    zones: the row's own zone name or null; defaults: minutes east of UTC used without one;
    collected: UTC microseconds of the collection; yearless: rows that may lack a year.
    """
    n = len(values)
    out = np.full(n, NAT, np.int64)
    groups: dict[str, list[int]] = {}
    cleaned: list[str] = [""] * n
    words: list[dict[str, str]] = [{}] * n
    seen: dict[str, tuple[str, str, dict[str, str]]] = {}
    for i, v in enumerate(values):
        if not v:
            continue
        known = seen.get(v)
        if known is None:
            c = clean(v)
            known = seen[v] = (c, *shape(c))
        cleaned[i], mask, words[i] = known
        groups.setdefault(mask, []).append(i)
    fallback = np.asarray(defaults, np.int64) * 60 * US
    for mask, rows in groups.items():
        p = parser_for(mask)
        if p.kind == "none":
            continue
        at = np.asarray(rows)
        numbers = [_NUMBERS.findall(_TOKEN.sub(" ", cleaned[i]) if words[i] else cleaned[i]) for i in rows]
        if p.kind == "epoch":
            scale = {"9": US, "10": US, "13": 1000, "16": 1}[p.word]
            out[at] = np.array([int(r[0]) for r in numbers], np.int64) * scale * p.sign
            continue
        if p.kind == "now":
            out[at] = collected[at]
            continue
        field: dict[str, np.ndarray] = {}
        for name, where in p.runs:
            run, off = divmod(where, 1000)
            if name == "F":
                field[name] = np.array([int((r[run][off:] + "000000")[:6]) for r in numbers], np.int64)
            elif name == "N":
                field[name] = np.array([int(r[run]) for r in numbers], np.int64)
            else:
                w = WIDTH[name]
                field[name] = np.array([int(r[run][off : off + w]) for r in numbers], np.int64)
        zero = np.zeros(len(at), np.int64)
        if p.kind == "ago":
            unit = {"分钟": 60 * US, "小时": 3600 * US, "秒": US, "秒钟": US}.get(p.word)
            known_time = collected[at] != NAT
            if unit:
                out[at] = np.where(known_time, collected[at] - field["N"] * unit, NAT)
            else:  # whole days by the calendar of +08:00, no time of day
                day = (collected[at] + 8 * 3600 * US) // DAY - field["N"]
                out[at] = np.where(known_time, day * DAY - 8 * 3600 * US, NAT)
            continue
        hour, minute, second = (field.get(k, zero) for k in ("H", "MI", "S"))
        ok = (minute < 60) & (second < 60)
        if p.pm:
            late = np.array([words[i].get("P") in PM_WORDS for i in rows])
            hour = np.where(late, np.where(hour < 12, hour + 12, hour), np.where(hour == 12, 0, hour))
        midnight = (hour == 24) & (minute == 0) & (second == 0) & ("H" in field)
        ok &= (hour < 24) | midnight
        clock = ((hour * 60 + minute) * 60 + second) * US + field.get("F", zero)
        if p.kind == "day":
            back = {"今天": 0, "昨天": 1, "前天": 2, "大前天": 3}[p.word]
            day = (collected[at] + 8 * 3600 * US) // DAY - back
            out[at] = np.where(ok & (collected[at] != NAT), day * DAY + clock - 8 * 3600 * US, NAT)
            continue
        month = np.array([MONTHS.index(words[i]["M"][:3]) + 1 for i in rows], np.int64) if p.word == "M" else field["MO"]
        if p.kind == "date":
            utc = _to_utc(p, at, rows, words, field, ok, field["Y"] if "Y" in field else 2000 + field["Y2"], month, clock, zones, fallback)
        else:
            known_time = (collected[at] != NAT) & yearless[at]
            year = _years(np.where(known_time, collected[at], 0))
            utc = _to_utc(p, at, rows, words, field, ok & known_time, year, month, clock, zones, fallback)
            late = utc > collected[at] + 2 * DAY
            before = _to_utc(p, at, rows, words, field, ok & known_time, year - 1, month, clock, zones, fallback)
            utc = np.where(late, before, utc)
        out[at] = utc
    return np.where((out >= LOW) & (out < HIGH), out, NAT)


def _to_utc(p, at, rows, words, field, ok, year, month, clock, zones, fallback) -> np.ndarray:
    ok = ok & valid_date(year, month, field["D"])
    safe = np.where(ok, month, 1)
    wall = days_from_civil(np.where(ok, year, 2000), safe, np.where(ok, field["D"], 1)) * DAY + clock
    if p.zone == "utc":
        utc = wall
    elif p.zone in ("offset", "abbr"):
        base = np.zeros(len(at), np.int64)
        if p.zone == "abbr":
            base = np.array([ABBREVIATIONS[words[i]["Z"]] for i in rows], np.int64)
        zh = field.get("zh", field.get("zh2", base * 0))
        zm = field.get("zm", field.get("zm2", base * 0))
        ok = ok & (zh <= 18) & (zm < 60)
        utc = wall - (base + p.sign * (zh * 60 + zm)) * 60 * US
    else:
        names = [words[i].get("R") if p.zone == "region" else zones[i] for i in rows]
        utc = wall - fallback[at]
        for name in set(names):
            if not name:
                continue
            here = np.array([x == name for x in names])
            moved = wall_to_utc(wall[here], name)
            if moved is not None:
                utc[here] = moved
            elif p.zone == "region":
                ok = ok & ~here
    return np.where(ok, utc, NAT)


# ---------------------------------------------------------------------------------------------
def instants(
    df: DataFrame,
    value: Column,
    key: Column,
    zone: Column,
    default_minutes: Column,
    collected: Column,
    yearless: Column,
) -> DataFrame:
    """``(seq BIGINT, utc_us BIGINT)`` for each row whose value denotes an instant; one narrow scan, no shuffle.

    collected must be an ISO UTC string or null; relative and year-less values need it.
    """
    slim = df.select(
        key.alias("seq"), value.alias("v"), zone.alias("z"), default_minutes.cast("int").alias("m"),
        F.unix_micros(F.try_to_timestamp(collected)).alias("c"), yearless.alias("y"),
    ).where("v is not null")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = convert(
                b["v"].tolist(),
                [z if isinstance(z, str) else None for z in b["z"]],
                b["m"].fillna(0).astype(np.int64).tolist(),
                b["c"].astype("Int64").fillna(NAT).to_numpy(np.int64),
                b["y"].fillna(False).to_numpy(bool),
            )
            keep = got != NAT
            yield pd.DataFrame({"seq": b["seq"].to_numpy()[keep], "utc_us": got[keep]})

    return slim.mapInPandas(run, "seq bigint, utc_us bigint")


def source_minutes(source: Column) -> Column:
    """Minutes east of UTC that a source's dates have without a zone."""
    return F.when(source.isin("wechat", "zsxq", "nowcoder"), 480).otherwise(0)


def source_yearless(source: Column) -> Column:
    """Whether a source writes dates without their year."""
    return F.coalesce(source == "nowcoder", F.lit(False))


@F.pandas_udf(LongType())
def utc_micros(value: pd.Series, default_minutes: pd.Series, collected_us: pd.Series, yearless: pd.Series) -> pd.Series:
    """The same conversion as a column, for rows without a zone of their own; null where the value denotes no instant."""
    got = convert(
        [v if isinstance(v, str) else None for v in value], [None] * len(value), default_minutes.fillna(0).astype(np.int64).tolist(),
        collected_us.astype("Int64").fillna(NAT).to_numpy(np.int64), yearless.to_numpy(bool),
    )
    return pd.Series(got, dtype="Int64").mask(got == NAT)


def document_instants(docs: DataFrame) -> DataFrame:
    """``publishedAt`` of captured documents: clock zone of the row, else +08:00 but UTC for github."""
    return instants(
        docs,
        F.col("publishedAt"),
        F.col("seq"),
        F.col("sourceMetadata")["clockZone"],
        source_minutes(F.col("source")),
        F.col("collectedAt"),
        source_yearless(F.col("source")),
    )


def repository_instants(repos: DataFrame) -> DataFrame:
    """``pushedAt`` of repositories: the zone of the clock that wrote the row, else UTC."""
    return instants(
        repos, F.col("pushedAt"), F.col("seq"), F.col("captureZone"), F.lit(0), F.lit(None).cast("string"), F.lit(False)
    )


def found(spark, sf_dir: str) -> DataFrame:
    """Query p4_found: (tbl, seq, utc_us) over both tables."""
    docs = document_instants(spark.read.parquet(f"{sf_dir}/collected_documents.parquet"))
    repos = repository_instants(spark.read.parquet(f"{sf_dir}/github_repositories.parquet"))
    return docs.select(F.lit("collected_documents").alias("tbl"), "seq", "utc_us").unionAll(
        repos.select(F.lit("github_repositories").alias("tbl"), "seq", "utc_us")
    )
