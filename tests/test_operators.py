import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.operators import cluster, jobs, keyed, library, match, organize, relational
from tidemill.plans import captures
from tidemill.plans import jobs as plans_jobs
from tidemill.plans import library as plans_library
from tidemill.plans import relational as plans_relational


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_keyed(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 3, None), (None, 4, "n")], "k string, seq int, v string")
    assert rows(keyed.first_per_key(df, ["k"], F.col("seq"))) == [("a", 1, "x"), ("b", 3, None), (None, 4, "n")]
    assert rows(keyed.latest_per_key(df, ["k"], F.col("seq"))) == [("a", 2, "y"), ("b", 3, None), (None, 4, "n")]
    new = spark.createDataFrame([("a", 9, "z"), ("c", 9, "w")], "k string, seq int, v string")
    assert rows(keyed.upsert(df.where("seq <> 1"), new, ["k"], keep=["v"])) == [("a", 9, "y"), ("b", 3, None), ("c", 9, "w"), (None, 4, "n")]
    none = spark.createDataFrame([], "k string")
    assert keyed.selected(df, none, "k").count() == 0 and keyed.without(df, none, "k").count() == 4


def test_running_limit(spark):
    df = spark.createDataFrame([(i, i % 3 == 0) for i in range(20)], "seq int, new boolean")
    assert [r.seq for r in keyed.running_limit(df, ["seq"], "new", 3).orderBy("seq").collect()] == list(range(7))
    assert keyed.running_limit(df, ["seq"], "new", 50).count() == 20


def test_quarantine(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    good, bad = keyed.quarantine(df, [("v", "missing", F.col("v").isNotNull())])
    assert rows(good) == [(1, "a")] and bad.head().issues[0].message == "missing"
    assert captures.document_rules()


def forest_by_hand(entries, radius):
    out, now = {}, {}
    for _, i, ch, fp in sorted(entries):
        if i not in now:
            exact = sorted(x for x, (c, _) in now.items() if ch is not None and c == ch)
            near = sorted((bin((f ^ fp) & (2**64 - 1)).count("1"), x) for x, (_, f) in now.items() if fp is not None and f is not None)
            near = [n for n in near if n[0] <= radius]
            if exact:
                out[i] = (exact[0], "exact")
            elif near:
                out[i] = (near[0][1], "near")
        now[i] = ch, fp
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_cluster_equals_sequential(spark, seed):
    r = random.Random(seed)
    base = [r.getrandbits(64) - 2**63 for _ in range(6)]
    entries = []
    for s in range(60):
        fp = r.choice(base)
        for _ in range(r.randint(0, 3)):
            fp ^= (1 << r.randint(0, 62))
        entries.append((s, f"id{r.randint(0, 45):03d}", r.choice([None, "c1", f"u{s}"]), r.choice([fp, fp, None])))
    df = spark.createDataFrame(entries, "seq long, id string, ch string, fp long")
    got = {x.id: (x.parent, x.kind) for x in cluster.parents(df).collect()}
    expected = forest_by_hand(entries, 3)
    assert got == expected
    root = {i: i for _, i, _, _ in entries}
    for i, (p, _) in expected.items():
        q = p
        while q in expected:
            q = expected[q][0]
        root[i] = q
    links = spark.createDataFrame([(i, p) for i, (p, _) in expected.items()], "id string, parent string")
    assert {x.id: x.root for x in cluster.roots(links).collect()} == {i: root[i] for i in expected}


@pytest.mark.parametrize("seed", [3, 4])
def test_cluster_radius_of_reference(spark, seed):
    r = random.Random(seed)
    base = [r.getrandbits(64) - 2**63 for _ in range(8)]
    entries = []
    for s in range(120):
        fp = r.choice(base)
        for _ in range(r.randint(0, 9)):
            fp ^= 1 << r.randint(0, 62)
        entries.append((s, f"id{r.randint(0, 90):03d}", r.choice([None, None, "c1", f"u{s}"]), r.choice([fp, fp, fp ^ -(2**63), None])))
    df = spark.createDataFrame(entries, "seq long, id string, ch string, fp long")
    expected = forest_by_hand(entries, 12)
    assert len(expected) > len(forest_by_hand(entries, 3))
    assert {x.id: (x.parent, x.kind) for x in cluster.parents(df, 12).collect()} == expected


def test_candidates_link_at_twelve_bits(spark, tmp_path):
    entries = [(1, "a", "h1", "0" * 16), (2, "b", "h2", "0000000000000fff"), (3, "c", "h3", "fff8000000000000"), (4, "d", "h4", "000000000000001f")]
    schema = "seq long, id string, contentHash string, simHash string"
    spark.createDataFrame(entries, schema).write.parquet(f"{tmp_path}/candidate_entries.parquet")
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/candidate_batches.parquet")
    assert rows(plans_jobs.candidate_parents(spark, str(tmp_path))) == [("b", "a", "near", 12), ("d", "a", "near", 5)]
    assert rows(plans_jobs.candidate_clusters(spark, str(tmp_path))) == [("a", 3)]


def test_fold(spark):
    events = [("j", 1, "queued"), ("j", 2, "saved"), ("j", 3, "collecting"), ("j", 4, "saved"), ("j", 5, "queued"), ("k", 1, "saved")]
    df = spark.createDataFrame(events, "job_id string, seq long, event string")
    assert rows(jobs.fold(df)) == [("j", "saved", 5, 2), ("k", None, 1, 1)]


def test_due(spark):
    df = spark.createDataFrame([("a", None, None), ("b", "2025-01-01 00:00:00", None), ("c", "2025-01-01 00:00:00", "x")], "source string, t string, last_error string")
    df = df.select("source", F.to_timestamp("t").alias("last_attempt"), "last_error")
    at = lambda t: {r.source: r.is_due for r in jobs.due(df, F.lit(t).cast("timestamp"), F.lit(86400), 3600).collect()}
    assert at("2025-01-01 01:00:00") == {"a": True, "b": False, "c": True}
    assert at("2025-01-01 00:59:59") == {"a": True, "b": False, "c": False}
    assert at("2025-01-02 00:00:00") == {"a": True, "b": True, "c": True}


def test_match_stages(spark):
    long = "".join(chr(0x4E00 + i) for i in range(60))
    records = [("1", long), ("2", "短文开头" + "甲" * 30), ("3", "乙" * 30 + "重复"), ("4", "乙" * 30 + "不同"), ("5", "标题在前面" + "".join(chr(0x5E00 + i) for i in range(80)))]
    queries = [(1, long + "展开"), (2, "短文开头"), (3, "乙" * 30), (4, "".join(chr(0x5E00 + i) for i in range(70))), (5, "完全无关的内容" * 6), (6, ""), (7, None), (8, long[:30] + "错" + long[31:])]
    q = spark.createDataFrame(queries, "seq long, text string")
    r = spark.createDataFrame(records, "topic_id string, text string")
    got = {x.seq: (x.topic_id, x.stage) for x in match.resolve(q, r).collect()}
    assert got == {1: ("1", "equal"), 2: ("2", "prefix"), 4: ("5", "inside"), 8: ("1", "equal")}
    top = match.closest(q.where("seq = 8"), r).collect()
    assert (top[0].topic_id, top[0].common) == ("1", 30)


def test_harvest():
    body = '{"a": [{"topic_id": 12, "talk": {"text": "hello there"}}, {"topicId": "x"}], "b": {"topic_id": "13", "title": "abcd", "text": "efgh"}}'
    assert [(r["topic_id"], r["parts"]) for r in match.harvest(body)] == [("13", ["efgh", "abcd"]), ("12", ["hello there"])]
    assert match.harvest("not json") == [] and match.harvest(None) == []


def test_sync_states(spark):
    sync = "struct<state: string, target: string, at: string, committed: boolean, pushed: boolean, pushFailed: boolean, error: string>"
    s = lambda **k: tuple(k.get(c) for c in ("state", "target", "at", "committed", "pushed", "pushFailed", "error"))
    data = [(1, None), (2, s(state="synced")), (3, s(state="synced", pushed=False)), (4, s(state="synced", pushed=False, error="x")), (5, s(state="failed")), (6, s(state="synced", pushFailed=True))]
    df = spark.createDataFrame(data, f"k int, sync {sync}")
    got = {r.k: (r.s, r.d) for r in df.select("k", library.sync_state(F.col("sync")).alias("s"), library.delivered(F.col("sync")).alias("d")).collect()}
    assert got == {1: ("pending", False), 2: ("synced", True), 3: ("synced", True), 4: ("failed", False), 5: ("failed", False), 6: ("synced", False)}


def test_summary_and_topic(spark):
    df = spark.createDataFrame([(1, "缓存", "缓存命中率的问题其实很常见也很重要。短句。缓存命中率的问题其实很常见也很重要！这是另一句足够长的普通句子内容。", )], "k int, t string, x string")
    assert organize.summary(df, "k", "t", "x").head().summary == "缓存命中率的问题其实很常见也很重要。这是另一句足够长的普通句子内容。"
    rule = [organize.Topic("t", ("强词",), ("佐证",))]
    texts = ["强词与佐证", "强词", "x" * 200 + "强词佐证", None]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, x string")
    assert [r.k for r in d.where(organize.topic(F.col("x"), rule).isNotNull()).collect()] == [0]


def test_as_of_and_range(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 3)], "k string, t int")
    right = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y"), ("b", 9, "z")], "k string, t int, v string")
    assert rows(relational.as_of(left, right, "k", "t", "v", "v")) == [("a", 1, None), ("a", 5, "y"), ("b", 3, None)]
    p = spark.createDataFrame([(0.0,), (9.9,), (10.0,), (25.0,)], "x double")
    r = spark.createDataFrame([("r1", 0.0, 10.0), ("r2", 5.0, 30.0)], "n string, lo double, hi double")
    assert rows(relational.in_range(p, r, "x", "lo", "hi", 7.0).select("x", "n")) == [(0.0, "r1"), (10.0, "r2"), (25.0, "r2"), (9.9, "r1"), (9.9, "r2")]


CATALOG = "id string, source string, title string, relativePath string, updatedAt string, publishedAt string, sync struct<at: string>"


def test_inbox_keeps_every_entry(spark, tmp_path):
    at = "2024-03-05T10:00:00.000Z"
    values = {
        "iso": ("zsxq", "2023-09-12T08:37:33+01:00", "2023-09-12", "published"), "none": ("zsxq", None, "2024-03-05", "collected"),
        "han": ("wechat", "2023年7月18日 01:05", "2023-07-18", "published"), "day": ("zsxq", "2023-10-08", "2023-10-08", "published"),
        "epoch": ("github", "1693839265", "2023-09-04", "published"), "ago": ("nowcoder", "昨天 23:30", "2024-03-04", "published"),
        "late": ("nowcoder", "12-30 23:30", "2023-12-30", "published"), "null": ("github", "null", "2024-03-05", "collected"),
        "empty": ("github", "", "2024-03-05", "collected"), "zero": ("github", "0000-00-00 00:00:00", "2024-03-05", "collected"),
    }
    data = [(k, s, "t", "p", at, v, None) for k, (s, v, _, _) in values.items()]
    spark.createDataFrame(data, CATALOG).write.parquet(f"{tmp_path}/catalog.parquet")
    got = {r.id: (r.folder, r.date_source) for r in plans_library.inbox_paths(spark, str(tmp_path)).collect()}
    assert got == {k: (f"{s}/{day}-{k}", kind) for k, (s, _, day, kind) in values.items()}


def test_centroids_of_all_dimensions(spark, tmp_path):
    data = [("a", [float(i) for i in range(7)]), ("a", [float(i + 1) for i in range(7)]), ("b", [1.0] * 5)]
    spark.createDataFrame(data, "label string, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert rows(plans_relational.embedding_centroids(spark, str(tmp_path))) == sorted([("a", i, i + 0.5) for i in range(7)] + [("b", i, 1.0) for i in range(5)], key=repr)


def test_whole_texts_of_controls_and_domains(spark, tmp_path):
    texts = [
        "正文\r\n展开全部\r\n后文", "正文\n收起\n后文", "正文\n 全文 \n后文", "see example.community and shop.net, then a.cnblogs, b.com.cn",
        "at x.com-y and x.com", "mail me@q.com or api.github.com or notgithub.com", None, "点击展开全部",
    ]
    data = list(enumerate(texts))
    spark.createDataFrame(data, "seq long, text string").write.parquet(f"{tmp_path}/collected_documents.parquet")
    # as in the reference, the label and blanks around it go and its line stays empty
    assert rows(captures.controls_removed(spark, str(tmp_path))) == [(0, 5), (1, 2), (2, 4)]
    expected = Counter()
    for _, t in data:
        expected.update({d for d in re.findall(r"(?<![a-z0-9@./-])((?:[a-z0-9-]+[.])+(?:com[.]cn|com|cn|net|top|xyz))(?![a-z0-9-])", (t or "").lower()) if not f".{d}".endswith(".github.com")})
    assert expected == {"shop.net": 1, "b.com.cn": 1, "x.com": 1, "notgithub.com": 1}
    assert dict(rows(captures.named_domains(spark, str(tmp_path)))) == expected


def test_inbox_paths_keep_every_entry(spark, tmp_path):
    import __spark_entry__ as engine

    sync = "struct<state: string, target: string, at: string, committed: boolean, pushed: boolean, pushFailed: boolean, error: string>"
    schema = f"id string, source string, title string, url string, category string, relativePath string, updatedAt string, publishedAt string, sync {sync}"
    at = "2025-03-05T20:00:00.000Z"
    dates = {
        "a": ("wechat", "2025-01-02T23:30:00Z", "2025-01-02", "published"), "b": ("zsxq", "2025年1月3日 07:15", "2025-01-03", "published"),
        "c": ("nowcoder", None, "2025-03-05", "collected"), "d": ("github", "n/a", "2025-03-05", "collected"), "e": ("wechat", "1735862400", "2025-01-03", "published"),
        "f": ("github", "1735862400", "2025-01-03", "published"), "g": ("wechat", "", "2025-03-05", "collected"), "h": ("wechat", "2025/2/30", "2025-03-05", "collected"),
    }
    rows = [(i, s, "t", "u", "c", "p", at, p, None) for i, (s, p, _, _) in dates.items()]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "catalog.parquet"))
    got = {r.id: (r.folder, r.date_source) for r in engine.queries()["inbox_paths"](spark, str(tmp_path)).collect()}
    assert got == {i: (f"{s}/{day}-{i}", kind) for i, (s, _, day, kind) in dates.items()}


def test_bare_domains_and_controls(spark):
    from tidemill.functions import text, urls

    texts = ["see a.com,b.cn and x@c.com, https://d.com/e.net", "foo.community foo.com.community a.com-b q.com.cn.", "A.Example.TOP", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(urls.bare_domains(F.col("t")).alias("d")).collect()
    assert [r.d for r in rows] == [["a.com", "b.cn"], ["foo.com", "q.com.cn"], ["a.example.top"], None]
    lines = ["a\n展开全文\n收起\nb", " 全文\r\na\r\n展开全部 \r", "全文看\n\n\n\nx", ""]
    got = spark.createDataFrame([(t,) for t in lines], "t string").select(text.strip_controls(F.col("t")).alias("x")).collect()
    assert [r.x for r in got] == ["a\n\n\nb".replace("\n\n\n", "\n\n"), "a", "全文看\n\nx", ""]


def test_closest_equals_all_pairs(spark):
    from difflib import SequenceMatcher

    rng = random.Random(21)
    stock = ["".join(rng.choice("abcdefgh") for _ in range(12)) for _ in range(8)]
    word = lambda: "".join(rng.choice(stock) if rng.random() < 0.5 else "".join(rng.choice("ijklmnop") for _ in range(5)) for _ in range(rng.randrange(1, 7)))
    records = [(f"r{i:03d}", word()) for i in range(150)] + [("x", "短"), ("y", None), ("z", "aaaaaaaaaaaaaaaaaaaaaaaa")]
    queries = [(i, word()) for i in range(20)] + [(90, "短文"), (91, "q"), (92, "aaaaaaaaaaaaaaaaaaaa"), (93, None)]
    got = match.closest(spark.createDataFrame(queries, "seq long, text string"), spark.createDataFrame(records, "topic_id string, text string")).collect()
    for seq, a in queries:
        runs = [(-SequenceMatcher(None, a or "", b or "", autojunk=False).find_longest_match().size, i) for i, b in records]
        want = [(i, -n) for n, i in sorted(runs)[:5] if n < 0]
        assert [(r.topic_id, r.common) for r in sorted((r for r in got if r.seq == seq), key=lambda r: r["rank"])] == want


def _all_pairs(queries, records, most=5):
    from difflib import SequenceMatcher

    runs = {q: sorted((-SequenceMatcher(None, a, b, autojunk=False).find_longest_match().size, i) for i, b in records) for q, a in queries}
    return sorted(((q, i, -n, k + 1) for q, x in runs.items() for k, (n, i) in enumerate(x[:most]) if n), key=repr)


def test_closest_keeps_no_pairs(spark, monkeypatch):
    # every query shares the opening with every record: pairs would be queries x records
    rng = random.Random(24)
    word = lambda: "共同的开头大家都有一样" + "".join(chr(rng.randrange(0x4E00, 0x4E40)) for _ in range(rng.randrange(1, 25)))
    records, queries = [(f"r{i:03d}", word()) for i in range(300)], [(i, word()) for i in range(30)]
    kept, cut = [], match.cut
    monkeypatch.setattr(match, "cut", lambda df: kept.append(cut(df)) or kept[-1])
    got = match.closest(spark.createDataFrame(queries, "seq long, text string"), spark.createDataFrame(records, "topic_id string, text string"))
    assert rows(got) == _all_pairs(queries, records)
    assert sum(df.count() for df in kept) <= len(records) + len(queries)


def test_closest_over_blocks(spark):
    rng = random.Random(25)
    stock = ["".join(rng.choice("abcd") for _ in range(9)) for _ in range(5)] + ["a" * 40, "𝒳字"]
    word = lambda: "".join(rng.choice(stock) if rng.random() < 0.6 else rng.choice("efgh") for _ in range(rng.randrange(1, 6)))
    records, queries = [(f"r{i:03d}", word()) for i in range(120)], [(i, word()) for i in range(20)] + [(50, "zz")]
    q, r = spark.createDataFrame(queries, "seq long, text string"), spark.createDataFrame(records, "topic_id string, text string")
    assert rows(match.closest(q, r, block=7)) == rows(match.closest(q, r)) == _all_pairs(queries, records)
    assert rows(match.closest(q.limit(0), r)) == rows(match.closest(q, r.limit(0))) == []


def test_closest_reads_whole_texts(spark):
    # what is shared begins behind the 240th character, crosses it, or is longer; a short run in the openings doesn't win
    rng = random.Random(26)
    word = lambda n, at=0x4E00: "".join(chr(rng.randrange(at, at + 0x800)) for _ in range(n))
    late, long, opening = word(40), word(900), word(9)
    queries = [(1, opening + word(700) + late), (2, word(200) + long + word(50)), (3, word(3000, 0x6000) + "𝒳" * 30), (4, "a" * 700)]
    records = [("open", opening + word(300)), ("late", word(2500) + late + word(9)), ("cross", word(230) + late), ("long", word(5) + long), ("part", long[100:700])]
    records += [("end", word(4000, 0x6000) + "𝒳" * 29), ("a1", "a" * 650), ("a2", "ba" * 300 + "a" * 300), ("twin", "a" * 650)]
    q, r = spark.createDataFrame(queries, "seq long, text string"), spark.createDataFrame(records, "topic_id string, text string")
    got = rows(match.closest(q, r))
    assert {(1, "cross", 40, 1), (1, "late", 40, 2), (2, "long", 900, 1), (2, "part", 600, 2), (3, "end", 29, 1), (4, "a1", 650, 1), (4, "twin", 650, 2), (4, "a2", 301, 3)} <= set(got)
    assert got == rows(match.closest(q, r, block=1000)) == _all_pairs(queries, records)


def test_closest_walks_past_repeats(monkeypatch):
    # few records that repeat a run: a walk went by each of their suffixes alone
    calls, ranked = [], match._ranked
    monkeypatch.setattr(match, "_ranked", lambda *x: calls.append(1) or ranked(*x))
    records, queries = ["a" * 2990, "ab" * 900, "a" * 2980, "c" + "a" * 500], ["a" * 3000, "b" + "a" * 2000, "ba" * 1000]
    known = np.zeros((3, 5), np.int32)
    got = sorted(zip(*(x.tolist() for x in match.nearest(queries, records, known, 5)), strict=True))
    assert got == [(0, 0, 2990), (0, 1, 1), (0, 2, 2980), (0, 3, 500), (1, 0, 2000), (1, 1, 2), (1, 2, 2000), (1, 3, 500), (2, 0, 1), (2, 1, 1800), (2, 2, 1), (2, 3, 1)]
    assert known.tolist() == [[2990, 2980, 500, 1, 0], [2000, 2000, 500, 2, 0], [1800, 1, 1, 1, 0]]
    assert len(calls) < 200


def test_needles_in_texts(spark):
    rng = random.Random(22)
    word = lambda n: "".join(chr(rng.randrange(0x4E00, 0x4E20)) for _ in range(n))
    records = [(str(i), word(rng.randrange(24, 600))) for i in range(60)]
    queries = []
    for k in range(60):
        i, t = rng.choice(records)
        a = rng.randrange(max(1, len(t) - 24))
        queries.append((k, [t[a : a + rng.randrange(20, 300)], word(30) + t[:250] + word(9), word(50)][k % 3]))
    got = {r.seq: (r.topic_id, r.stage) for r in match.resolve(spark.createDataFrame(queries, "seq long, text string"), spark.createDataFrame(records, "topic_id string, text string")).collect()}
    for k, q in queries:
        equal = {i for i, t in records if t[:24] == q[:24]}
        short = {i for i, t in records if (len(q) < 24 and t[:24].startswith(q))}
        inside = {i for i, t in records if len(q) >= 24 and (q[:240] in t or t[:240] in q)}
        hits, stage = (equal, "equal") if equal else (short, "prefix") if short else (inside, "inside")
        assert got.get(k) == ((min(hits), stage) if len(hits) == 1 else None)


def test_popular_content_keeps_few_versions(spark, monkeypatch):
    monkeypatch.setattr(cluster, "SPAN", 16)
    rng = random.Random(23)
    rows = [(s, f"i{rng.randrange(400):03d}", rng.choice(["hot", "hot", "hot", f"c{s % 7}", None]), None) for s in range(600)]
    df = spark.createDataFrame(rows, "seq long, id string, ch string, fp long")
    seen, held, want = set(), {}, {}
    for s, i, ch, _ in rows:
        if i not in seen and ch is not None:
            like = [o for o, c in held.items() if c == ch]
            if like:
                want[i] = min(like)
        seen.add(i)
        held[i] = ch
    assert {r.id: r.parent for r in cluster.parents(df).collect()} == want
    every = cluster.versions(df)
    kept = cluster.least_so_far(every).where("ch = 'hot' and until is null").count()
    assert kept < 0.2 * every.where("ch = 'hot' and until is null").count()


def test_accounts_are_one_however_written(spark, tmp_path):
    import __spark_entry__ as engine

    rows = [("a", "Zoé"), ("a", " zoé "), ("a", "ＺＯÉ"), ("b", "zoé"), ("a", None), ("a", "Ann")]
    spark.createDataFrame(rows, "source string, author string").write.parquet(str(tmp_path / "collected_documents.parquet"))
    got = sorted(tuple(r) for r in engine.queries()["authors"](spark, str(tmp_path)).collect())
    assert got == [("a", "ann", 1), ("a", "zoé", 3), ("b", "zoé", 1)]
