import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.llm import batchdedup, leakage, mixing, quality, truncation

WORDS = "lang string, word string"


def test_leaks_equal_brute_force(spark):
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abcdefghij甲乙丙丁戊") for _ in range(n))
    items = [(i, word(rng.randrange(40, 300))) for i in range(25)] + [(90, None), (91, ""), (92, items_text := word(60)), (93, items_text)]
    docs = []
    for k in range(150):
        t = word(rng.randrange(20, 200))
        if k % 3 == 0:
            _, x = items[rng.randrange(25)]
            n = rng.choice([58, 59, 60, 61, 90])
            s = rng.randrange(max(1, len(x) - n + 1))
            t += " " + "​, ".join(x[s : s + n][i : i + 7] for i in range(0, n, 7)).upper() + word(30)
        docs.append((k, t))
    docs += [(900, None), (901, ""), (902, word(9000) + items_text + word(5000)), (903, items_text), (902, items_text)]
    truth = {(k, i) for k, t in docs for i, x in items if t and x and any(x[j : j + 60] in t.lower().replace("​", "").replace(",", "").replace(" ", "") for j in range(len(x) - 59))}
    d = spark.createDataFrame([(k, t, 1) for k, t in docs], "doc_id long, text string, item_id int")
    i = spark.createDataFrame([(k, t, 1) for k, t in items], "item_id long, text string, doc_id int")
    got = [tuple(r) for r in leakage.leaked(d, i).collect()]
    assert set(got) == truth and len(got) == len(truth)
    assert leakage.leaked(d, i.where("false")).count() == 0 and leakage.leaked(d.where("false"), i).count() == 0


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(leakage, "PATTERNS", 10)
    texts = ["".join(chr(0x4E00 + 100 * i + j) for j in range(70)) for i in range(9)]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    i = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id long, text string")
    assert sorted(map(tuple, leakage.leaked(d, i).collect())) == [(k, k) for k in range(9)]


HISTORY = "seq long, id string, source string, contentHash string, simHash string, representativeId string, batch string"
BATCH = "seq long, batch_no int, id string, contentHash string, simHash string, parent string"


def by_hand(history, batches):
    rep = {h[1]: h[5] or h[1] for h in history}
    rows, out = [(h[0], h[1], (h[3] or "").lower(), (h[4] or "").lower()) for h in history], {}
    for seq, _, i, ch, fp, _ in sorted(batches):
        ch, fp = (ch or "").lower(), (fp or "").lower()
        if i not in rep:
            best = []
            for s, j, c, f in rows:
                if j == i or batchdedup.EMPTY_TEXT in (ch, c):
                    continue
                if ch and c == ch:
                    best.append((0, 0, s, j))
                if len(fp) == len(f) == 16 and (d := bin(int(fp, 16) ^ int(f, 16)).count("1")) <= 3:
                    best.append((1, d, s, j))
            rep[i] = i
            if best:
                rep[i] = out[seq] = rep[min(best)[3]]
        rows.append((seq, i, ch, fp))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_duplicates_equal_sequential(spark, seed):
    r = random.Random(seed)
    base = [r.getrandbits(64) for _ in range(12)]

    def print_():
        x = r.choice(base)
        for _ in range(r.randrange(5)):
            x ^= 1 << r.randrange(64)
        return r.choice([f"{x:016x}", f"{x:016X}", f"{x:016x}", None, "zz"]) if r.random() < 0.5 else f"{r.getrandbits(64):016x}"

    ch = lambda: r.choice([None, batchdedup.EMPTY_TEXT, f"c{r.randrange(40):015d}", f"{r.getrandbits(64):016x}", "C%015d" % r.randrange(40)])
    history = [(s, f"h{s}", "x", ch(), print_(), r.choice([None, f"h{r.randrange(1, s + 1)}"]), "b") for s in range(1, 60)]
    batches = [(s, 1 + (s - 60) // 12, r.choice([f"n{s}"] * 5 + [f"h{r.randrange(1, 60)}", f"n{r.randrange(60, s + 1)}"]), ch(), print_(), "p") for s in range(60, 180)]
    got = batchdedup.duplicates(spark.createDataFrame(history, HISTORY), spark.createDataFrame(batches, BATCH)).collect()
    assert {x.seq: x.duplicate_of for x in got} == by_hand(history, batches) and len(got) == len({x.seq for x in got})


def test_duplicates_without_rows(spark):
    h, b = spark.createDataFrame([], HISTORY), spark.createDataFrame([], BATCH)
    assert batchdedup.duplicates(h, b).count() == 0
    one = spark.createDataFrame([(1, 1, "a", "c1", "f" * 16, None), (2, 1, "b", None, "F" * 16, None)], BATCH)
    assert [tuple(x) for x in batchdedup.duplicates(h, one).collect()] == [(2, "a")]


def rows_of(spark, rows):
    return batchdedup.entries(spark.createDataFrame(rows, BATCH))


def sized(r, first, n, near=()):
    return [(first + k, 1, f"i{first + k}", None, f"{(near[k % len(near)] ^ (1 << r.randrange(64))) if near and k % 4 == 0 else r.getrandbits(64):016x}", None) for k in range(n)]


def test_batch_by_batch_equals_backlog(spark):
    r = random.Random(11)
    base = [r.getrandbits(64) for _ in range(6)]
    history = [(s, f"h{s}", "x", f"c{s % 30}", f"{r.choice(base) ^ (1 << r.randrange(64)):016x}", None, "b") for s in range(1, 80)]
    batches = [(s, (s - 80) // 25 + 1 if s < 170 else None, r.choice([f"n{s}", f"h{s % 90}"]), r.choice([None, f"c{r.randrange(60)}"]), f"{r.choice(base) ^ (5 << r.randrange(60)):016x}", "p") for s in range(80, 180)]
    h, b = spark.createDataFrame(history, HISTORY), spark.createDataFrame(batches, BATCH)
    one, all_ = batchdedup.duplicates(h, b, one_by_one=True), batchdedup.duplicates(h, b)
    want = by_hand(history, [(s, n or 99, *x) for s, n, *x in batches])
    assert {x.seq: x.duplicate_of for x in one.collect()} == {x.seq: x.duplicate_of for x in all_.collect()} == want


def test_index_reads_follow_the_batch_and_segments_merge(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(batchdedup, "ROW_GROUP", 1 << 15)
    read = {}
    for size in (6_000, 60_000):
        r = random.Random(size)
        index = batchdedup.SegmentIndex(spark, str(tmp_path / str(size)))
        index.ingest(rows_of(spark, sized(r, 1, size)), 0, accepted=True)
        index.ingest(rows_of(spark, sized(r, size + 1, 2)), 1)
        read[size] = index.bytes_read()
        assert [s["rows"] for s in index.manifest()["segments"]] == [size, 2]
    assert read[60_000] < 2 * read[6_000]  # the footers grow, what is read of the segments doesn't
    names = index.manifest()["segments"]
    for k in range(2, 5):
        index.ingest(rows_of(spark, sized(r, 60_000 + 100 * k, 2)), k)
    index.compact()
    held = [s["rows"] for s in index.manifest()["segments"]]
    assert held[0] == 60_000 and sum(held) == 60_000 + 8 and len(held) <= 3 and index.manifest()["segments"][0] == names[0]
    assert index.vacuum() and not index.vacuum()


def test_killed_between_write_and_manifest(spark, tmp_path, monkeypatch):
    r = random.Random(12)
    base = [r.getrandbits(64) for _ in range(5)]
    parts = [sized(r, 1 + 40 * k, 40, base) for k in range(3)]
    whole, torn = batchdedup.SegmentIndex(spark, str(tmp_path / "a")), batchdedup.SegmentIndex(spark, str(tmp_path / "b"))
    for k, part in enumerate(parts):
        whole.ingest(rows_of(spark, part), k)
    commit = batchdedup.SegmentIndex._commit

    def die(self, manifest):
        raise OSError("killed")

    for k, part in enumerate(parts):
        monkeypatch.setattr(batchdedup.SegmentIndex, "_commit", die)
        with pytest.raises(OSError):
            torn.ingest(rows_of(spark, part), k)
        monkeypatch.setattr(batchdedup.SegmentIndex, "_commit", commit)
        assert torn.ingest(rows_of(spark, part), k) and not torn.ingest(rows_of(spark, part), k)
    got = [sorted(map(tuple, i.results(*range(3)).collect())) for i in (whole, torn)]
    assert got[0] == got[1] and got[0] and torn.vacuum()
    assert sorted(map(tuple, torn.results(*range(3)).collect())) == got[0]


def test_words_meet_within_three_bits(spark):
    r = random.Random(13)
    pairs = []
    for _ in range(300):
        a = r.getrandbits(64)
        b = a
        for i in r.sample(range(64), 3):
            b ^= 1 << i
        pairs.append((a - (1 << 64 if a >> 63 else 0), b - (1 << 64 if b >> 63 else 0)))
    df = spark.createDataFrame(pairs, "a long, b long")
    rows = df.select(F.size(F.array_intersect(batchdedup.words(F.col("a"), 3), batchdedup.words(F.col("b"), 3))).alias("n")).collect()
    assert all(x.n >= 1 for x in rows)


def test_hot_word_is_walked_in_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(batchdedup, "HELD", 5)
    monkeypatch.setattr(batchdedup, "TASK_ROWS", 40)
    fps = [(0xABCD << 40) ^ (1 << i) ^ (1 << j) for i in range(20) for j in range(i)]
    rows = [(k, 1, f"i{k}", None, f"{f:016x}", None) for k, f in enumerate(fps)]
    index = batchdedup.SegmentIndex(spark, str(tmp_path / "i"))
    index.ingest(rows_of(spark, rows), 0)
    got = {x.seq: x.duplicate_of for x in index.results(0).collect()}
    assert got == by_hand([], rows)


def test_shares_and_repeats(spark):
    rng = random.Random(8)
    docs = [(k, rng.choice(["big", "big", "big", "mid"]), "word " * rng.randrange(5, 60) + str(k), 1) for k in range(600)]
    docs += [(1000 + k, "small", f"small text number {k} " * 4, 1) for k in range(6)] + [(2000, "big", None, 1), (2001, "big", "", 1), (2002, None, "x", 1), (2003, "other", "x y z", 1)]
    targets = [("big", 0.5, 1, None), ("mid", 0.3, 3, None), ("small", 0.2, 4, None), ("absent", 0.5, 2, None), ("zero", 0.0, 1, None), ("other", None, 1, None)]
    d = spark.createDataFrame(docs, "doc_id long, source string, text string, tokens int")
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int, note string")
    chosen, report = mixing.mixed(d, t, budget=6000)
    got, told = chosen.collect(), {r.source: r for r in report.collect()}
    assert len({r.doc_id for r in got}) == len(got) and all(1 <= r.copies <= {"big": 1, "mid": 3, "small": 4}[r.source] for r in got)
    assert {r.source for r in got} == {"big", "mid", "small"} and set(told) == {t[0] for t in targets}
    assert all(r.copies == 4 for r in got if r.source == "small")  # all it may give
    free = 6000 - told["small"].tokens
    assert abs(told["big"].tokens - free * 0.625) < 60 and abs(told["mid"].tokens - free * 0.375) < 60
    assert abs(sum(r.actual_share for r in told.values()) - 1) < 1e-4 and told["absent"].tokens == 0
    again = mixing.mixed(d, t, budget=6000)[0].collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))
    empty = mixing.mixed(d.where("false"), t)
    assert empty[0].count() == 0 and empty[1].count() == 6


def test_exact_copies_share_an_allotment(spark):
    docs = [(k, "s", "the same text over and over") for k in range(50)] + [(100 + k, "s", f"text {k} is of its own kind") for k in range(50)]
    d = spark.createDataFrame(docs, "doc_id long, source string, text string")
    t = spark.createDataFrame([("s", 1.0, 1)], "source string, target_share double, max_repeats int")
    got = mixing.mixed(d, t)[0].collect()
    assert sum(r.doc_id < 100 for r in got) <= 2 and sum(r.doc_id >= 100 for r in got) >= 49


def test_water_filling():
    p = mixing.plan([("a", 100), ("b", 1000)], [("a", 0.5, 2), ("b", 0.5, None), ("c", 1.0, 1)], 900)
    assert p["a"]["quota"] == 200 and p["b"]["quota"] == 700 and p["c"]["quota"] == 0


FORMS = {
    "prose": ["我在这里把问题的来龙去脉都说清楚了。因为它很重要，所以我们一起再看一遍。", "This is what we did in the end, and it was not easy at all for us.", "短评", None, "", "因为我们没有时间，所以先写到这里。\n- 第一点\n- 第二点\n最后我还是要说，这是对的，也是好的。\n他们都去看了，也都说可以。\n因为这样，我们就不再改了。"],
    "list": ["- 懒加载\n- 代码分割\n- 事件循环（必考）\n- 闭包", "1. one\n2) two v2\n3、three\n4. four", "懒加载\n闭包\n合成层\n热更新\n原型链", "- [a](https://x.example/a)\n- [b](https://x.example/b)\n- [c](https://x.example/c)"],
    "table": ["| a | b |\n|---|---|\n| 1 | 2 |", "a,1,x\nb,2,y\nc,3,z", "a\t1\nb\t2\nc\t3", '"a";"1";"x"\n"b";"2";"y"', "aa      bb      cc\n11      22      33"],
    "junk": ["锟斤拷烫烫烫屯屯屯◆□�" * 5, "!function(c){var x=1;o.mi&&u(z)}();" * 9, "同一句话在这里出现。" * 9, "闭包 热更新 闭包 热更新 合成层 " * 9, "Zm9vYmFyYmF6" * 20, "x7q 9kz p0v 3jd qq8 " * 9],
}


def test_forms(spark):
    rng = random.Random(9)
    zh = ["因为", "所以", "我们", "没有", "可以", "这个问题", "排查", "之后", "发现", "是", "的", "了", "在", "也"]
    en = "the of and to we it is that for on with as was are not because when our will which have they can parser cache build".split()
    rows, truth, k = [], {}, 0
    for _ in range(250):
        rows.append((k, "".join("".join(rng.choice(zh) for _ in range(rng.randrange(6, 14))) + rng.choice("。，！") for _ in range(rng.randrange(3, 9))) + "。"))
        rows.append((k + 1, " ".join(" ".join(rng.choice(en) for _ in range(rng.randrange(6, 14))) + "." for _ in range(rng.randrange(2, 8)))))
        truth[k] = truth[k + 1] = "prose"
        k += 2
    for form, texts in FORMS.items():
        for t in texts:
            rows.append((k, t))
            truth[k] = form
            k += 1
    d = spark.createDataFrame([(a, b, "x", 1.0) for a, b in rows], "doc_id long, text string, form string, x double")
    words = spark.createDataFrame([("en", w) for w in en[:20]] + [("zh", w) for w in zh if len(w) <= 2] + [("zh", None)], WORDS)
    got = quality.profiled(d, words).collect()
    assert {r.doc_id: r.form for r in got} == truth
    for r in got:
        assert abs(sum(r.contributions) - r.distance2) < 1e-6 * max(1, r.distance2)
    assert quality.profiled(d.where("false"), words).count() == 0


def test_the_distance_decides_the_form():
    k = len(quality.STATS)
    x, centre, parts = np.zeros((5, k)), np.zeros(k), np.zeros((5, k))
    at = quality.STATS.index
    for row, (s, v, c) in enumerate((("entry_lines", 1.0, 60), ("entry_lines", 1.0, 20), ("entry_lines", 0.7, 60), ("log_line_width", 1.0, 900), ("common_words", -0.3, 60))):
        x[row, at(s)], parts[row, at(s)] = v, c
    assert quality.form_of(x, centre, parts).tolist() == ["list", "prose", "prose", "prose", "junk"]
    assert set(quality.form_of(x, centre, 0 * parts)) == {"prose"}  # the same lines, but no distance


def test_statistics():
    m = quality.measures(["x", "The cat sat. 我的！\n- x", None, "锟斤拷 12"], quality.word_hashes(["the", "of"]), re.compile("的"))
    s = dict(zip(quality.STATS, m[1], strict=False))
    assert s["common_words"] == pytest.approx((2 + 8 * 0.3) / (6 + 8)) and s["entry_lines"] == 0.5 and s["punctuated_lines"] == 0.5
    assert m[1, -4:].tolist() == [6, 2, 15, 0] and not m[2].any() and m[3, 7] == 3 / 5 and m[3, 11] == 2 / 5


def test_repeated_words_equal_a_plain_count():
    rng = random.Random(14)
    texts = [" ".join(rng.choice(["ab", "c", "甲", "乙丙", "丁戊己庚", "zz9q", "-"]) for _ in range(rng.randrange(0, 350))) for _ in range(40)] + ["", None, "甲"]

    def plain(text):
        words = []
        for run in re.findall("[a-z]+|[㐀-鿿]+", (text or "").lower()):
            words += [run] if run[0] < "㐀" or len(run) < 3 else [run[i : i + 2] for i in range(len(run) - 1)]
        n, size = len(words), quality.STRETCH
        parts = [words[i : i + size] for i in range(0, n - size + 1, size)] or [words]
        parts += [words[-size:]] if n > size and n % size else []
        near = (sum(map(len, parts)) - sum(len(set(p)) for p in parts)) / (sum(map(len, parts)) + quality.FEW)
        shingles = [tuple(words[i : i + quality.SHINGLE]) for i in range(n - quality.SHINGLE + 1)]
        return max(near, (len(shingles) - len(set(shingles))) / (len(shingles) + quality.FEW))

    _, got = quality.word_counts(texts, quality.word_hashes([]))
    assert got.tolist() == pytest.approx([plain(t) for t in texts])


def test_repeated_words_and_unspaced_sentences(spark):
    rng = random.Random(4)
    common = "the of and to we it is that for on with as".split()
    vocabulary = ["".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randrange(3, 9))) for _ in range(600)]
    prose = [" ".join(" ".join(rng.choice(common) if rng.random() < 0.4 else rng.choice(vocabulary) for _ in range(rng.randrange(8, 15))) + "." for _ in range(rng.randrange(3, 30))) for _ in range(200)]
    few = vocabulary[:5] + common[:3]
    paragraph = " ".join(rng.choice(common) if rng.random() < 0.4 else rng.choice(vocabulary) for _ in range(150))
    junk = ["Nothing in it depends on the cache so we remove the rest of code." * 9, " ".join(rng.choice(few) for _ in range(120)), f"{paragraph} " * 6]
    rows = [(i, t) for i, t in enumerate(prose + junk)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    words = spark.createDataFrame([("en", w) for w in common], WORDS)
    got = {r.doc_id: r.form for r in quality.profiled(d, words).collect()}
    assert got == {i: "prose" if i < len(prose) else "junk" for i in got} and len(got) == len(rows)


def test_copies_of_a_cut_text_are_no_closing(spark):
    cut = "我们把缓存的策略重新梳理了一遍，发现真正的问题在于请求的顺序和预期的完"
    rows = [(i, "a", f"w{i}", f"第{i}篇讲的是{'甲乙丙丁戊己庚辛'[i % 8] * (i % 5 + 1)}的经过，写得很完整。") for i in range(40)]
    rows += [(100 + i, "a", f"x{i}", cut) for i in range(20)]
    d = spark.createDataFrame(rows, "seq long, source string, author string, text string")
    assert {r.seq for r in truncation.truncated(d).collect()} == set(range(100, 120))
