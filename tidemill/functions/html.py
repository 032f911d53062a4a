"""HTML in Arrow functions: a small tolerant tree, cleaning, Markdown, extraction of the main text.

The tree builder accepts unclosed and stray tags. Selectors know ``tag``, ``#id``, ``.class``,
``[attr*=part]`` and their combinations. Everything here runs once per Arrow batch in Python, as Spark has
no HTML expressions; filter rows with native predicates before calling it.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
DROPPED = frozenset("script style noscript form iframe template object".split())
BLOCKS = frozenset("address article aside blockquote div dl dd dt figure footer h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tr ul".split())
CLOSES = {"p": BLOCKS, "li": {"li"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
# What a cleaned page may keep.
ALLOWED_TAGS = frozenset(
    "h1 h2 h3 h4 h5 h6 p br hr strong b em i del s a img ul ol li blockquote pre code table thead tbody tr th td figure figcaption".split()
)
ALLOWED_ATTRIBUTES = {"a": ("href", "title"), "img": ("src", "alt", "title"), "code": ("class",), "th": ("colspan", "rowspan"), "td": ("colspan", "rowspan")}
_TRACKER = re.compile("qrcode|report|trace|pixel", re.I)
_SPACES = re.compile(r"[\s ]+")


@dataclass(eq=False)
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)
    parent: Node | None = None

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(c for c in reversed(n.children) if isinstance(c, Node))

    def text(self) -> str:
        """Blank-collapsed text without dropped elements; blocks are set apart by a space."""
        out: list[str] = []

        def visit(n: Node) -> None:
            for c in n.children:
                if isinstance(c, str):
                    out.append(c)
                elif c.tag not in DROPPED:
                    out.append(" " if c.tag in BLOCKS or c.tag == "br" else "")
                    visit(c)
                    out.append(" " if c.tag in BLOCKS else "")

        visit(self)
        return clean("".join(out))


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root")

    def handle_starttag(self, tag: str, attrs: list) -> None:
        closed = self.at
        if closed.tag in CLOSES and tag in CLOSES[closed.tag]:
            self.at = closed.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, [], self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        n = self.at
        while n.parent is not None and n.tag != tag:
            n = n.parent
        if n.parent is not None:  # a stray end tag closes nothing
            self.at = n.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def clean(text: str | None) -> str:
    return _SPACES.sub(" ", text or "").strip()


def parse(html: str | None) -> Node:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


_PART = re.compile(r"([a-z][a-z0-9]*)|#([\w-]+)|\.([\w-]+)|\[([\w-]+)(?:([*^]?=)[\"']?([^\"'\]]+)[\"']?)?\]", re.I)


def matches(n: Node, selector: str) -> bool:
    for tag, ident, cls, attr, op, value in _PART.findall(selector):
        if tag and n.tag != tag.lower():
            return False
        if ident and n.attrs.get("id") != ident:
            return False
        if cls and cls not in n.attrs.get("class", "").split():
            return False
        if attr:
            have = n.attrs.get(attr)
            if have is None or (op == "*=" and value not in have) or (op == "^=" and not have.startswith(value)) or (op == "=" and value != have):
                return False
    return True


def select(root: Node, selectors: Sequence[str]) -> list[Node]:
    """Outermost matches of the first selector that matches anything; a blank in a selector means 'inside of'."""
    for s in selectors:
        steps = s.split()
        found: list[Node] = []
        for n in root.walk():
            if not matches(n, steps[-1]):
                continue
            up, k = n.parent, len(steps) - 2
            outer = False
            p = n.parent
            while p is not None:
                outer = outer or p in found
                p = p.parent
            while up is not None and k >= 0:
                if matches(up, steps[k]):
                    k -= 1
                up = up.parent
            if k < 0 and not outer:
                found.append(n)
        if found:
            return found
    return []


def sanitise(html: str | None, base: str = "") -> str:
    """Allowed tags and attributes only, addresses absolute http(s); other tags give way to their content."""
    out: list[str] = []

    def visit(n: Node) -> None:
        for c in n.children:
            if isinstance(c, str):
                out.append(_html.escape(c, quote=False))
                continue
            if c.tag in DROPPED:
                continue
            keep = c.tag in ALLOWED_TAGS
            if keep:
                attrs = []
                for a in ALLOWED_ATTRIBUTES.get(c.tag, ()):
                    v = c.attrs.get(a)
                    if v is not None and a in ("href", "src"):
                        v = urljoin(base, v.strip())
                        v = v if v.startswith(("http://", "https://")) else None
                    if v is not None:
                        attrs.append(f' {a}="{_html.escape(v)}"')
                out.append(f"<{c.tag}{''.join(attrs)}{' /' if c.tag in VOID else ''}>")
            visit(c)
            if keep and c.tag not in VOID:
                out.append(f"</{c.tag}>")

    visit(parse(html))
    return "".join(out)


def markdown(html: str | None) -> str:
    """ATX headings, fenced code, ``-`` bullets, ``_`` for emphasis, ``**`` for strong text."""

    def inline(n: Node) -> str:
        parts = []
        for c in n.children:
            if isinstance(c, str):
                parts.append(_SPACES.sub(" ", c))
            elif c.tag in DROPPED:
                continue
            elif c.tag in ("em", "i"):
                parts.append(f"_{inline(c).strip()}_")
            elif c.tag in ("strong", "b"):
                parts.append(f"**{inline(c).strip()}**")
            elif c.tag == "code":
                parts.append(f"`{c.text()}`")
            elif c.tag == "br":
                parts.append("\n")
            elif c.tag == "img":
                parts.append(f"![{c.attrs.get('alt', '')}]({c.attrs.get('src', '')})")
            elif c.tag == "a":
                parts.append(f"[{inline(c).strip()}]({c.attrs.get('href', '')})")
            else:
                parts.append(inline(c))
        return "".join(parts)

    def blocks(n: Node, depth: int = 0) -> list[str]:
        out: list[str] = []
        run: list = []

        def flush() -> None:
            if run:
                t = inline(Node("span", {}, list(run))).strip()
                if t:
                    out.append(t)
                run.clear()

        for c in n.children:
            if isinstance(c, str) or c.tag not in BLOCKS:
                run.append(c)
                continue
            flush()
            if c.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
                out.append("#" * int(c.tag[1]) + " " + inline(c).strip())
            elif c.tag == "pre":
                raw = "".join(x if isinstance(x, str) else "".join(y for y in x.children if isinstance(y, str)) for x in c.children)
                out.append(f"```\n{raw.strip(chr(10))}\n```")
            elif c.tag in ("ul", "ol"):
                items = []
                for i, li in enumerate((x for x in c.children if isinstance(x, Node) and x.tag == "li"), 1):
                    mark = f"{i}. " if c.tag == "ol" else "- "
                    body = "\n".join(blocks(li, depth + 1))
                    items.append(mark + body.replace("\n", "\n" + " " * len(mark)))
                out.append("\n".join(items))
            elif c.tag == "blockquote":
                out.append("\n".join("> " + line for line in "\n\n".join(blocks(c, depth)).split("\n")))
            elif c.tag == "hr":
                out.append("---")
            elif c.tag == "table":
                rows = [[inline(d).strip() for d in r.children if isinstance(d, Node) and d.tag in ("td", "th")] for r in c.walk() if r.tag == "tr"]
                if rows:
                    lines = ["| " + " | ".join(r) + " |" for r in rows]
                    out.append("\n".join([lines[0], "|" + " --- |" * len(rows[0]), *lines[1:]]))
            elif c.tag in DROPPED:
                continue
            else:
                out.extend(blocks(c, depth))
        flush()
        return out

    return "\n\n".join(blocks(parse(html))).strip()


@dataclass(frozen=True)
class Profile:
    """Where a site keeps its parts; the first selector that matches counts."""

    content: tuple[str, ...]
    title: tuple[str, ...] = ("h1", "title")
    author: tuple[str, ...] = (".author", "[rel=author]")
    time: tuple[str, ...] = ("time", ".time", ".date")
    login: tuple[str, ...] = ()
    least: int = 40


PROFILES: dict[str, Profile] = {
    "wechat": Profile(("#js_content",), ("#activity-name", "h1", "title"), ("#js_name",), ("#publish_time",), (), 40),
    "nowcoder": Profile((".post-content", ".feed-content", "article", "main"), login=(".login-wall", ".login-dialog"), least=40),
    "zsxq": Profile((".topic-content", ".talk-content-container", ".content"), least=20),
    "github": Profile(("article.markdown-body", ".markdown-body", "article"), least=1),
}


def block_features(root: Node) -> list[tuple[Node, float, int]]:
    """(block, score, length) of blocks that may be the main text: long and paragraphed, few links and controls."""
    out = []
    for n in root.walk():
        if n.tag not in ("div", "section", "article", "main", "td"):
            continue
        t = n.text()
        if len(t) < 80:
            continue
        nodes = list(n.walk())
        p = sum(x.tag == "p" for x in nodes)
        links = [x for x in nodes if x.tag == "a"]
        link_length = sum(len(x.text()) for x in links)
        controls = sum(x.tag in ("button", "input", "select", "textarea") for x in nodes)
        nav = sum(len(x.text()) for x in nodes if x.tag in ("nav", "aside", "footer")) / len(t)
        head = 260 if any(x.tag in ("h1", "h2") for x in nodes) else 60 if any(x.tag in ("h3", "h4") for x in nodes) else 0
        score = min(len(t), 5000) + 120 * p + min(len(t) / max(p, 1), 160) + head - 2 * link_length - 30 * len(links) - 400 * nav - 50 * controls
        out.append((n, score, len(t)))
    return out


def main_block(root: Node, ratio: float = 1.15) -> Node | None:
    """Best scored block, if it beats every block that neither holds it nor lies in it."""
    ranked = sorted(block_features(root), key=lambda x: -x[1])
    if not ranked:
        return None
    best = ranked[0]
    inside = set(map(id, best[0].walk()))
    for n, score, _ in ranked[1:]:
        if id(n) in inside or any(x is best[0] for x in n.walk()):
            continue
        return best[0] if best[1] >= ratio * score else None
    return best[0]


def images_of(n: Node, base: str) -> list[dict[str, str]]:
    """Images without trackers, lazy addresses resolved."""
    out = []
    for x in n.walk():
        if x.tag != "img":
            continue
        raw = x.attrs.get("data-src") or x.attrs.get("src") or ""
        small = any(x.attrs.get(a, "").isdigit() and 0 < int(x.attrs[a]) <= 2 for a in ("width", "height"))
        url = urljoin(base, raw)
        if raw and not small and not _TRACKER.search(raw) and url.startswith(("http://", "https://")):
            out.append({"url": url, "alt": clean(x.attrs.get("alt")) or None})
    return out


def extract(html: str | None, url: str, source: str | None) -> dict:
    """Title, author, date, text and images of a page, or an error code."""
    empty = {"ok": False, "error": None, "title": None, "author": None, "published": None, "text": None, "images": []}
    profile = PROFILES.get(source or "")
    if profile is None:
        return empty | {"error": "UNSUPPORTED_URL"}
    root = parse(html)
    if profile.login and select(root, profile.login):
        return empty | {"error": "AUTH_REQUIRED"}
    parts = select(root, profile.content)
    if not parts:
        best = main_block(root)
        parts = [best] if best is not None else []
    text = "\n\n".join(t for t in (p.text() for p in parts) if t)
    if len(text) < profile.least:
        return empty | {"error": "CONTENT_EMPTY"}

    def first(selectors: Sequence[str]) -> Node | None:
        for s in selectors:
            for n in select(root, (s,)):
                if n.text() or n.attrs.get("datetime"):
                    return n
        return None

    title, author, time = first(profile.title), first(profile.author), first(profile.time)
    return {
        "ok": True, "error": None, "title": title.text() if title else None, "author": author.text() if author else None,
        "published": (time.attrs.get("datetime") or time.text()) if time else None, "text": text,
        "images": [i for p in parts for i in images_of(p, url)],
    }


EXTRACTED = "ok boolean, error string, title string, author string, published string, text string, images array<struct<url: string, alt: string>>"


def extracted(pages: DataFrame, key: str = "seq", html: str = "html", url: str = "url", source: str = "source") -> DataFrame:
    """One row per page with its extracted parts or error code."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [extract(h, u or "", s) for h, u, s in zip(b["h"], b["u"], b["s"], strict=True)]
            yield pd.concat((b[["k"]].rename(columns={"k": key}).reset_index(drop=True), pd.DataFrame(rows, columns=[c.split()[0] for c in EXTRACTED.split(", ")][:7])), axis=1)

    slim = pages.select(F.col(key).alias("k"), F.col(html).alias("h"), F.col(url).alias("u"), F.col(source).alias("s"))
    return slim.mapInPandas(run, f"{key} bigint, {EXTRACTED}")


@F.pandas_udf(StringType())
def sanitise_column(html: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([None if h is None else sanitise(h, b or "") for h, b in zip(html, base, strict=True)])


@F.pandas_udf(StringType())
def markdown_column(html: pd.Series) -> pd.Series:
    return html.map(lambda h: None if h is None else markdown(h))
