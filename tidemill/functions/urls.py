"""Addresses as column expressions: canonical form, identity, host, links."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType


@dataclass(frozen=True)
class Site:
    """A registered source: its hosts (exact, or with subdomains), identity parameters and kinds."""

    id: str
    hosts: tuple[str, ...]
    subdomains: bool = False
    identity: tuple[str, ...] = ()
    kinds: tuple[str, ...] = ("article",)


#: Sites of the capture tables, first match wins.
SITES = (
    Site("wechat", ("mp.wechat.example",), False, ("__biz", "mid", "idx", "sn", "chksm"), ("article",)),
    Site("zsxq", ("wx.zsxq.example", "zsxq.example"), True, ("topic_id", "group_id", "article_id", "question_id", "answer_id"),
         ("article", "post", "question", "answer")),
    Site("nowcoder", ("nowcoder.example",), True, (), ("post",)),
    Site("github", ("github.example",), False, (), ("article",)),
)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def site_of(url: Column, sites: Sequence[Site] = SITES) -> Column:
    """Id of the first registered site of an https address, else null."""
    h = host(url)
    out = None
    for s in sites:
        own = h.isin(*s.hosts)
        if s.subdomains:
            for x in s.hosts:
                own = own | h.endswith("." + x)
        ok = own & F.lower(url).startswith("https://")
        out = F.when(ok, s.id) if out is None else out.when(ok, s.id)
    return out


def canonical(url: Column, identity: Mapping[str, Sequence[str]] | None = None, site: Column | None = None, sites: Sequence[Site] = SITES) -> Column:
    """Without fragment, with identity parameters only (sorted), without a slash at the end of a path; host in lower case.

    Null for an address of no registered site.
    """
    site = site if site is not None else site_of(url, sites)
    identity = identity if identity is not None else {s.id: s.identity for s in sites}
    bare = F.substring_index(url, "#", 1)
    scheme = F.lower(F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    path = F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*(/[^?]*)?", 1)
    path = F.when(path.isin("", "/"), F.lit("/")).otherwise(F.regexp_replace(path, "/+$", ""))
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    allowed = None
    for s, names in identity.items():
        known = F.array(*(F.lit(n) for n in names)).cast("array<string>")
        allowed = F.when(site == s, known) if allowed is None else allowed.when(site == s, known)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: F.array_contains(allowed, F.substring_index(p, "=", 1))))
    return F.when(site.isNotNull(), F.concat(scheme, F.lit("://"), host(url), path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))))


def content_id(canonical_url: Column) -> Column:
    """Twelve hex digits of the SHA-256 of the canonical address."""
    return F.substring(F.sha2(canonical_url, 256), 1, 12)


def links(html: Column) -> Column:
    """All link targets of a page in order."""
    return F.transform(F.regexp_extract_all(html, F.lit(r'href="([^"]*)"'), F.lit(1)), lambda u: F.replace(u, F.lit("&amp;"), F.lit("&")))


def text_links(text: Column) -> Column:
    """All http(s) addresses written out in a text, without closing punctuation."""
    return F.regexp_extract_all(text, F.lit(r"(https?://[A-Za-z0-9._~:/?#@!$&*+;=%-]+[A-Za-z0-9/_-])"), F.lit(1))


def absolute(base: Column, ref: Column) -> Column:
    """A reference seen from a page: absolute, scheme-relative, root-relative or next to the page."""
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(F.regexp_replace(base, r"[?#].*$", ""), r"^([A-Za-z][A-Za-z0-9+.-]*://[^/]*(?:/.*)?)/[^/]*$", 1)
    return (
        F.when(ref.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), ref)
        .when(ref.startswith("//"), F.concat(F.substring_index(base, "//", 1), ref))
        .when(ref.startswith("/"), F.concat(origin, ref))
        .when(ref.startswith("#") | ref.startswith("?"), F.concat(F.regexp_replace(base, r"[?#].*$", ""), ref))
        .otherwise(F.concat(F.when(folder == "", origin).otherwise(folder), F.lit("/"), ref))
    )


def bare_domains(text: Column, endings: Sequence[str] = ("com.cn", "com", "cn", "net", "top", "xyz"), trusted: Sequence[str] = ()) -> Column:
    """Distinct domains named in a text that aren't a trusted one or below it."""
    found = F.regexp_extract_all(F.lower(text), F.lit(rf"(?<![a-z0-9@./-])((?:[a-z0-9-]+\.)+(?:{'|'.join(e.replace('.', '[.]') for e in endings)}))(?![a-z0-9-])"), F.lit(1))
    known = [F.lit(t) for t in trusted]
    return F.array_distinct(F.filter(found, lambda d: ~F.exists(F.array(*known).cast("array<string>"), lambda t: (d == t) | d.endswith(F.concat(F.lit("."), t)))))


def ipv4_public(address: Column) -> Column:
    """Whether an IPv4 address is public: false for reserved ranges, null for anything else than an IPv4 address."""
    p = [F.try_element_at(F.split(address, "[.]"), F.lit(i)).try_cast("int") for i in (1, 2, 3, 4)]
    a, b, c = p[0], p[1], p[2]
    valid = address.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$") & (F.greatest(*p) <= 255)
    reserved = (
        a.isin(0, 10, 127) | (a >= 224) | ((a == 100) & b.between(64, 127)) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31))
        | ((a == 192) & (b == 168)) | ((a == 192) & (b == 88) & (c == 99)) | ((a == 192) & (b == 0) & c.isin(0, 2)) | ((a == 198) & b.isin(18, 19))
        | ((a == 198) & (b == 51) & (c == 100)) | ((a == 203) & (b == 0) & (c == 113))
    )
    return F.when(valid, ~reserved)


def _public6(address: str | None) -> bool | None:
    from ipaddress import IPv4Address, IPv6Address

    try:
        a = IPv6Address((address or "").strip("[]").split("%")[0])
    except ValueError:
        return None
    n = int(a)
    if n >> 32 in (0, 0xFFFF) and n > 1:  # a written-out or mapped IPv4 address is judged as such
        return bool(_public4(str(IPv4Address(n & 0xFFFFFFFF))))
    first = n >> 112
    return not (n <= 1 or first & 0xFE00 == 0xFC00 or first & 0xFFC0 in (0xFE80, 0xFEC0) or first & 0xFF00 == 0xFF00 or n >> 96 == 0x20010DB8)


def _public4(address: str) -> bool:
    a, b, c, _ = map(int, address.split("."))
    return not (
        a in (0, 10, 127) or a >= 224 or (a == 100 and 64 <= b <= 127) or (a, b) in ((169, 254), (192, 168), (198, 18), (198, 19)) or (a == 172 and 16 <= b <= 31)
        or (a, b, c) in ((192, 0, 0), (192, 0, 2), (192, 88, 99), (198, 51, 100), (203, 0, 113))
    )


@F.pandas_udf(BooleanType())
def ipv6_public(addresses: pd.Series) -> pd.Series:
    """Whether an IPv6 address is public: false for reserved ranges and mapped reserved IPv4, null for anything else than an IPv6 address."""
    return pd.Series([_public6(a) for a in addresses], dtype=object)


def created_time(c: Column) -> Column:
    """A time as an API writes it; one without a year of four digits is no time."""
    return F.when(c.rlike("(?:19|20)[0-9]{2}"), F.try_to_timestamp(c))
