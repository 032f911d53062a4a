import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.llm import neardup, sitelines, truncation

DOC = "seq long, source string, author string, text string, anchor string, rep long, id string"


def normal(t):
    return "".join(c for c in unicodedata.normalize("NFKC", t or "").lower() if unicodedata.category(c)[0] in "LN")


def brute_pairs(docs, at_least=0.6, least=300):
    sets = {}
    for k, t in docs:
        n = normal(t)
        if t is not None and len(n) >= least:
            sets[k] = {n[i : i + 5] for i in range(len(n) - 4)}
    keys = sorted(sets)
    return {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= at_least}


def edited(rng, text, n):
    t = list(text)
    for _ in range(n):
        i = rng.randrange(len(t))
        t[i] = chr(rng.randrange(0x4E00, 0x6E00))
    return "".join(t)


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(3)
    docs, k = [], 0
    for _ in range(12):
        base = "".join(chr(rng.randrange(0x4E00, 0x7E00)) for _ in range(420))
        for n in (0, 0, 3, 8, 14, 40):
            docs.append((k, edited(rng, base, n)))
            k += 1
    docs += [(900, None), (901, ""), (902, "短"), (903, "a" * 400), (904, "A" * 400), (905, "x" * 299), (906, docs[0][1] * 30), (907, docs[0][1] * 30)]
    df = spark.createDataFrame([(k, "s", None, t, "x", 1, "y") for k, t in docs], DOC)
    got = [tuple(r) for r in neardup.row_pairs(*neardup.near_duplicates(df)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_pairs(docs)


def test_copies_are_split_and_classes_connect(spark, monkeypatch):
    rng = random.Random(18)
    base = "".join(chr(rng.randrange(0x4E00, 0x7E00)) for _ in range(400))
    near, far = edited(rng, base, 9), "".join(chr(rng.randrange(0x4E00, 0x7E00)) for _ in range(400))
    docs = [(k, base) for k in range(40)] + [(100 + k, near) for k in range(25)] + [(200, far), (201, "短"), (202, None)]
    df = spark.createDataFrame([(k, "s", None, t, "x", 1, "y") for k, t in docs], DOC)
    members, links = neardup.near_duplicates(df)
    monkeypatch.setattr(neardup, "BLOCK", 7)
    got = [tuple(r) for r in neardup.row_pairs(members, links).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_pairs(docs)
    told = {r.id: (r.class_id, r.links) for r in neardup.classes(members, links).collect()}
    assert told == {**{k: (0, 1) for k, t in docs if t in (base, near)}, 200: (200, 0)}


def test_components_equal_a_plain_search(spark):
    rng = random.Random(19)
    links = [(i, i + 1) for i in range(100, 160)] + [tuple(sorted(rng.sample(range(60), 2))) for _ in range(45)] + [(200, 200 + k) for k in range(1, 20)]
    root = {x: x for e in links for x in e}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((top(a), top(b)))
        root[y] = x
    got = [tuple(r) for r in neardup.components(spark.createDataFrame(links, "a long, b long")).collect()]
    assert len(got) == len(root) and dict(got) == {x: top(x) for x in root}
    assert neardup.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hot_anchor_is_split_without_loss(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 8)
    rng = random.Random(4)
    base = "".join(chr(rng.randrange(0x4E00, 0x7E00)) for _ in range(400))
    docs = [(i, edited(rng, base, 2)) for i in range(40)]
    df = spark.createDataFrame([(k, "s", None, t, "x", 1, "y") for k, t in docs], DOC)
    got = {tuple(r) for r in neardup.row_pairs(*neardup.near_duplicates(df)).collect()}
    assert got == brute_pairs(docs)


def test_words_within_one_symbol_share_an_anchor():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, (50, neardup.BINS), dtype=np.uint64)
    b = a.copy()
    for t in range(neardup.TABLES):
        b[:, t * neardup.SYMBOLS + t % neardup.SYMBOLS] += np.uint64(1)
    x, y = neardup.anchors(a), neardup.anchors(b)
    assert all(len(set(x[i]) & set(y[i])) == neardup.TABLES for i in range(50))


def test_no_documents(spark):
    members, links = neardup.near_duplicates(spark.createDataFrame([], DOC))
    assert members.count() == 0 and links.count() == 0 and neardup.row_pairs(members, links).count() == 0


def brute_lines(rows):
    letters = lambda x: "".join(c for c in unicodedata.normalize("NFKC", x).lower() if unicodedata.category(c)[0] == "L")
    by_source, by_account, n_source, n_account, each = {}, {}, {}, {}, []
    for k, s, a, t in rows:
        n_source[s] = n_source.get(s, 0) + 1
        a = sitelines.account(a)
        if a is not None:
            n_account[s, a] = n_account.get((s, a), 0) + 1
        keys = [(i, letters(x)) for i, x in enumerate(t.split("\n"), 1) if len(x) <= 160] if t is not None else []
        keys = [(i, x) for i, x in keys if len(x) >= 4]
        for x in {x for _, x in keys}:
            by_source[s, x] = by_source.get((s, x), 0) + 1
            if a is not None:
                by_account[s, a, x] = by_account.get((s, a, x), 0) + 1
        each.append((k, s, a, keys))
    return {
        (k, i) for k, s, a, keys in each for i, x in keys
        if (by_source[s, x] >= 8 and by_source[s, x] >= 0.03 * n_source[s]) or (a is not None and n_account[s, a] >= 100 and by_account[s, a, x] >= 0.1 * n_account[s, a])
    }


def site_rows():
    rng = random.Random(5)
    rows = []
    for k in range(700):
        source = rng.choice(["one", "two", "two", None])
        author = rng.choice([None, "Zoé", " zoé ", "ＺＯÉ", f"a{rng.randrange(40)}"])
        lines = [f"独立的内容{rng.randrange(10**9)}号{chr(rng.randrange(0x4E00, 0x7E00)) * 4}" for _ in range(rng.randrange(4))]
        if source == "one" and rng.random() < 0.2:
            lines.append(rng.choice(["Follow our page!", "follow  our page", "Follow our page (12)"]))
        if sitelines.account(author) == "zoé" and rng.random() < 0.3:
            lines.insert(0, "我是作者本人签名")
        if rng.random() < 0.3:
            lines.append("everywhere the same line")
        if rng.random() < 0.02:
            lines.append("x" * 161)
        lines += ["ab"] * rng.randrange(2)
        rows.append((k, source, author, "\n".join(lines)))
    return rows + [(9000, "one", None, None), (9001, "one", None, ""), (9002, None, "zoé", "y\n" * 3000)]


def test_site_lines_equal_brute_force(spark):
    rows = site_rows()
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], DOC)
    lines = sitelines.site_lines(df)
    got = {tuple(r) for r in sitelines.marked_lines(df, lines).collect()}
    expected = brute_lines(rows)
    assert got == expected and expected
    cleaned = {r.seq: r.clean_text for r in sitelines.without_lines(df, sitelines.marked_lines(df, lines)).collect()}
    for k, _, _, t in rows:
        want = None if t is None else "\n".join(x for i, x in enumerate(t.split("\n"), 1) if (k, i) not in expected)
        assert cleaned[k] == want


def test_marks_without_broadcast(spark):
    rows = site_rows()
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], DOC)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert {tuple(r) for r in sitelines.marked_lines(df, sitelines.site_lines(df)).collect()} == brute_lines(rows)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_the_ratio_chooses_the_lines(spark, monkeypatch):
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in site_rows()], DOC)
    tests = sitelines.line_tests(df)
    limit = sitelines.discovery_cut(tests, 0.01)
    below = tests.where((F.col("strength") < limit) & (F.col("k") >= 2)).count()
    assert below and 1 < limit < 20  # lines repeated by chance are turned down
    monkeypatch.setattr(sitelines, "log_likelihood_ratio", lambda k1, n1, k2, n2: F.lit(0.0))
    assert sitelines.site_lines(df).count() == 0


def test_the_outside_is_made_of_sources_that_do_not_repeat_the_line(spark):
    rows = [(i, "a", None, f"独有的一行文字甲{i}" + ("\n共有的一行文字" if i % 40 == 0 else "") + ("\n各处的一行文字" if i % 40 == 1 else "")) for i in range(400)]
    rows += [(1000 + i, "b", None, f"别处的一行文字乙{i}" + ("\n共有的一行文字" if i % 100 == 0 else "") + ("\n各处的一行文字" if i % 70 == 1 else "")) for i in range(700)]
    rows += [(2000 + i, "c", None, f"远处的一行文字丙{i}") for i in range(500)]
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], DOC)
    got = {(r["k"], r["n1"], r["k2"], r["n2"]) for r in sitelines.line_tests(df).where("k < 400").collect()}
    assert got == {(10, 400, 7, 1200), (7, 700, 0, 500), (10, 400, 0, 500), (10, 700, 0, 500)}


def test_no_lines(spark):
    df = spark.createDataFrame([], DOC)
    assert sitelines.marked_lines(df, sitelines.site_lines(df)).count() == 0


@pytest.mark.parametrize(
    ("line", "kind"),
    [
        ("写完了。", truncation.TERMINAL), ("That is all.", truncation.TERMINAL), ("他说“好”", truncation.TERMINAL), ("【完】", truncation.TERMINAL),
        ("然后我就打开了", truncation.OPEN), ("and it d", truncation.OPEN), ("不是坏�", truncation.CUT), ("于是&nb", truncation.CUT), ("于是<p", truncation.CUT),
        ("最后… 阅读全文", truncation.CUT), ("最后...展开全部", truncation.CUT), ("边…", truncation.CUT), ("写完了。…展开全部", truncation.FORM),
        ("见 https://a.example/b", truncation.FORM), ("#前端# #面试#", truncation.FORM), ("v1.2.3", truncation.FORM), ("—— 写于春天", truncation.FORM), ("加油 ✨", truncation.FORM),
    ],
)
def test_endings(line, kind):
    assert truncation.ending(line) == kind


def test_lengths_under_encodings():
    import html
    import json

    texts = ["a<b>&\"'", "", "你好\n\t\\", "😀\r\n\n", "x" * 3000]
    got = dict(zip(truncation.ENCODINGS, truncation.lengths(texts).T.tolist(), strict=True))
    crlf = [t.replace("\r\n", "\n").replace("\n", "\r\n") for t in texts]
    assert got["points"] == [len(t) for t in texts] and got["utf8"] == [len(t.encode()) for t in texts]
    assert got["utf16"] == [len(t.encode("utf-16-le")) // 2 for t in texts] and got["gb18030"] == [len(t.encode("gb18030")) for t in texts]
    assert got["html"] == [len(html.escape(t)) for t in texts] and got["json_ascii"] == [len(json.dumps(t)) - 2 for t in texts]
    assert got["json"] == [len(json.dumps(t, ensure_ascii=False)) - 2 for t in texts] and got["crlf"] == [len(t) for t in crlf]
    assert got["lf"] == [len(t.replace("\r\n", "\n")) for t in texts]


def test_truncated(spark):
    rng = random.Random(6)
    word = lambda n: "".join(chr(rng.randrange(0x4E00, 0x5E00)) for _ in range(n))
    rows, truth = [], set()
    for k in range(600):
        t = "".join(word(rng.randrange(8, 30)) + "。" for _ in range(rng.randrange(5, 12)))
        if k % 5 == 0:
            t = (t + word(200))[:120]  # a storage limit
        elif k % 11 == 0:
            t += word(7)
        elif k % 13 == 0:
            t += "\n以上"
        if t[-1] != "。" and not t.endswith("\n以上"):
            truth.add(k)
        if k % 3 == 0:
            t += "\n长按关注本页公告"
        rows.append((k, "s", None, t, "x", 1, "y"))
    rows += [(7000, "s", None, None, "", 1, ""), (7001, "s", None, "", "", 1, ""), (7002, "s", None, "\n \n", "", 1, ""), (7003, None, None, "完整的一句话。" * 5000, "", 1, "")]
    got = truncation.truncated(spark.createDataFrame(rows, DOC)).collect()
    assert {r.seq for r in got} == truth and len(got) == len(truth)
    assert any(r.reason == "limit" and r.length == 120 for r in got)


def test_limits_find_cuts_that_endings_cannot(spark, monkeypatch):
    rng = random.Random(16)
    word = lambda n: "".join(chr(rng.randrange(0x4E00, 0x5E00)) for _ in range(n))
    rows = [(k, "s", None, "".join(word(rng.randrange(8, 30)) + "。" for _ in range(rng.randrange(5, 14)))) for k in range(600)]
    cut = [(1000 + k, "s", None, ("".join(word(9) + "，" for _ in range(20)))[:97] + word(3)) for k in range(40)]  # open endings at 100 characters
    # cut there as well, but with the form of a link, a version, a list entry; and whole texts of that form and of that length
    formed = [(2000, "s", None, word(70) + "。\nhttps://a.example/" + "x" * 10), (2001, "s", None, word(92) + "。\nv1.2.3")]
    whole = [(3000, "s", None, word(60) + "。\nhttps://a.example/" + "x" * 10), (3001, "s", None, word(99) + "。"), (3002, "s", None, word(49) + "。" + word(49) + "！")]
    assert {len(r[3]) for r in cut + formed + whole[1:]} == {100}
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows + cut + formed + whole], DOC)
    found = {r.seq for r in truncation.truncated(df).collect()}
    assert found == {r[0] for r in cut + formed}
    assert {(r.part, r.encoding, r.length) for r in truncation.limits_of(df).collect()} >= {("text", "points", 100), ("body", "points", 100)}
    none = truncation.hidden_limits
    monkeypatch.setattr(truncation, "hidden_limits", lambda features: none(features).where("false"))
    assert {r.seq for r in truncation.truncated(df).collect()} == {r[0] for r in cut}


def test_remarks_and_edited_copies(spark):
    rng = random.Random(17)
    word = lambda n: "".join(chr(rng.randrange(0x4E00, 0x5E00)) for _ in range(n))
    rows = [(k, "s", None, "".join(word(rng.randrange(8, 30)) + "。" for _ in range(6))) for k in range(300)]
    rows += [(1000 + k, "s", None, t) for k, t in enumerate(("同问", "mark", "顶", "这是一个没有任何标点的很长的评语也就这样结束了"))]
    head, tail = word(30) + "，", "\n我们随后把它改"
    rows += [(2000 + k, "s", None, head + word(40) + "。" + word(k) + tail) for k in range(6)]  # edited copies of a cut text, too few for a line of the page
    rows += [(3000, "s", None, "前面说过，后面也要"), (3001, "s", None, "然后展开一看...Read More")]
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], DOC)
    assert {r.seq for r in truncation.truncated(df).collect()} == {*range(2000, 2006), 3000, 3001}


def test_truncated_nothing(spark):
    assert truncation.truncated(spark.createDataFrame([], DOC)).count() == 0
