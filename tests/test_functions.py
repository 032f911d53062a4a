import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemill.functions import codepoints as C
from tidemill.functions import finger, html, text, urls


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40)), max_size=12))
def test_batched_normalisation_equals_one_by_one(texts):
    cp, starts, ends = C.normalised(texts)
    for t, s, e in zip(texts, starts, ends, strict=True):
        plain = unicodedata.normalize("NFKC", t or "").lower()
        if "￿" in plain or "￾" in plain:
            continue
        assert C.text_of(cp[s:e]) == "".join(c for c in plain if unicodedata.category(c)[0] in "LN")


def test_windows_stay_inside_texts():
    cp, starts, ends = C.normalised(["abcdef", "ab", "", "abcdef"])
    h, own = C.window_hashes(cp, 5), C.owners(starts, ends, 5, len(cp))
    assert own[own >= 0].tolist() == [0, 0, 3, 3]
    a, b = np.flatnonzero(own == 0), np.flatnonzero(own == 3)
    assert (h[a] == h[b]).all()


def test_slices_cover_all_rows():
    texts = ["x" * 10, None, "", "y" * 100, "z"]
    assert C.slices(texts, 50) == [(0, 3), (3, 4), (4, 5)]
    assert C.slices([]) == []


def column(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("r")).head()[0]


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        ("https://mp.wechat.example/s?__biz=B&mid=2&idx=1&sn=a&scene=21#wechat_redirect", "https://mp.wechat.example/s?__biz=B&idx=1&mid=2&sn=a"),
        ("https://WWW.nowcoder.example/discuss/1/?from=x", "https://www.nowcoder.example/discuss/1"),
        ("https://github.example/", "https://github.example/"),
        ("http://github.example/a", None),
        ("https://github.example.evil.example/a", None),
        ("https://notgithub.example/a", None),
        ("file:///etc/passwd", None),
        ("no address", None),
        (None, None),
    ],
)
def test_canonical(spark, raw, expected):
    assert column(spark, raw, urls.canonical) == expected


@pytest.mark.parametrize(("ref", "expected"), [("b.html", "https://h.example/a/b.html"), ("/x", "https://h.example/x"), ("//o.example/y", "https://o.example/y"), ("mailto:a", "mailto:a"), ("?q", "https://h.example/a/c?q")])
def test_absolute(spark, ref, expected):
    assert column(spark, ref, lambda c: urls.absolute(F.lit("https://h.example/a/c?z=1"), c)) == expected


@pytest.mark.parametrize(("a", "public"), [("8.8.8.8", True), ("10.1.1.1", False), ("172.16.0.1", False), ("172.32.0.1", True), ("192.168.1.1", False), ("256.1.1.1", None), ("x", None), ("100.64.0.1", False)])
def test_ipv4(spark, a, public):
    assert column(spark, a, urls.ipv4_public) is public


def test_simhash_forms_agree(spark):
    texts = ["面试官问了 React 渲染 React", "", None, "a", "面", "Hello hello WORLD 你好世界 123", "x" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    native = {r.k: r.simhash for r in df.select("k", finger.simhash_plain("t").alias("simhash")).collect()}
    fast = {r.k: r.s for r in df.select("k", finger.simhash("t").alias("s")).collect()}
    assert native == fast == {i: finger.simhash_of(t) for i, t in enumerate(texts)}


def test_content_hash_ignores_case_and_punctuation(spark):
    df = spark.createDataFrame([("Hello, World!",), ("hello world",), ("HELLO　ＷＯＲＬＤ",)], "t string")
    got = [r[0] for r in df.select(finger.content_hash(finger.nfkc("t"))).collect()]
    assert len(set(got)) == 1 and len(got[0]) == 16


def test_text_helpers(spark):
    assert column(spark, "正文\n展开全部\n收起\n结尾", text.strip_controls) == "正文\n\n结尾"
    assert column(spark, "---\n# 标题在这里。后面", text.title_of) == "标题在这里"
    assert column(spark, "a" * 60, text.title_of) == "a" * 48
    assert column(spark, "一二三四五六七八九十一二三四五六七，" + "x" * 60, text.title_of) == "一二三四五六七八九十一二三四五六七"
    assert column(spark, "..a/b:c  d..", text.slug) == "a-b-c-d"
    assert column(spark, "con", text.slug) == "_con"
    assert column(spark, "///", text.slug) == "untitled"
    assert column(spark, "aXaXa", lambda c: text.occurrences(c, "aX")) == 2


PAGE = """<html><head><title>T</title><script>var x='</p>'</script></head><body><nav><a href="/a">menu</a></nav>
<div id="js_content"><h1>Head</h1><p>First <b>bold<p>second &amp; more text that is long enough to count
<img data-src="/i.png" width=300><img src="/pixel.gif" width=1><a href="javascript:x()">bad</a><a href="/y" onclick="z">good</a>
<script>evil()</script></div></body></html>"""


def test_html():
    got = html.extract(PAGE, "https://mp.wechat.example/s", "wechat")
    assert got["ok"] and got["title"] == "Head" and "evil" not in got["text"] and "second & more" in got["text"]
    assert got["images"] == [{"url": "https://mp.wechat.example/i.png", "alt": None}]
    clean = html.sanitise(PAGE, "https://h.example/")
    assert "script" not in clean and "onclick" not in clean and "javascript" not in clean and 'href="https://h.example/y"' in clean
    assert html.extract("<p>x</p>", "", "wechat")["error"] == "CONTENT_EMPTY"
    assert html.extract('<div class="login-wall">x</div>', "", "nowcoder")["error"] == "AUTH_REQUIRED"
    assert html.extract(PAGE, "", "other")["error"] == "UNSUPPORTED_URL"
    assert html.extract(None, "", "github")["ok"] is False


def test_markdown():
    assert html.markdown("<h2>A</h2><p>x <em>y</em> <strong>z</strong></p><ul><li>1<li>2</ul><pre><code>k = 1\n</code></pre>") == "## A\n\nx _y_ **z**\n\n- 1\n- 2\n\n```\nk = 1\n```"


def test_fallback_needs_a_clear_winner():
    body = "<p>" + "words in a row " * 20 + "</p>"
    assert html.main_block(html.parse(f"<div>{body}</div>")) is not None
    assert html.main_block(html.parse(f"<section>{body}</section><section>{body}</section>")) is None


@pytest.mark.parametrize(
    ("a", "public"),
    [("2606:4700::1111", True), ("::1", False), ("::", False), ("fc00::1", False), ("fe80::1%eth0", False), ("ff02::1", False), ("2001:db8::1", False), ("::ffff:10.0.0.1", False),
     ("::ffff:8.8.8.8", True), ("[2606:4700::1]", True), ("8.8.8.8", None), ("1::2::3", None), (None, None)],
)
def test_ipv6(spark, a, public):
    assert column(spark, a, urls.ipv6_public) == public


def test_created_time(spark):
    assert column(spark, "2024-05-06T07:08:09Z", lambda c: urls.created_time(c).cast("long")) == 1714979289
    assert column(spark, "05-06 07:08", urls.created_time) is None and column(spark, "not 2024", urls.created_time) is None
