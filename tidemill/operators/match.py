"""Resolving partial texts to ids, similarity of texts, records in JSON of unknown shape."""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.functions import codepoints as C
from tidemill.functions.text import match_key
from tidemill.session import cut

KEY, NEEDLE, HAYSTACK = 24, 240, 2000


def resolve(queries: DataFrame, records: DataFrame) -> DataFrame:
    """``(seq, topic_id, stage)`` of each query text that exactly one record fits.

    queries: (seq, text); records: (topic_id, text). Three stages, each only for what the one before left:
    equal 24-character keys; one text a prefix of the other (short texts); the opening of one inside the
    other. A stage that finds several ids ends the search without an answer. Containment is not tested
    for all pairs, see :func:`_holders`.
    """
    q = cut(queries.select("seq", match_key(F.col("text"), HAYSTACK).alias("h")).where("h <> ''"))
    r = cut(records.select("topic_id", match_key(F.col("text"), HAYSTACK).alias("h")).where("h <> ''").distinct())
    qk, rk = q.withColumn("key", F.substring("h", 1, KEY)), r.withColumn("key", F.substring("h", 1, KEY))

    def answer(hits: DataFrame, stage: str) -> DataFrame:
        # the least and the greatest id tell one from several without gathering them
        g = hits.groupBy("seq").agg(F.min("topic_id").alias("a"), F.max("topic_id").alias("b"))
        return g.select("seq", F.when(F.col("a") == F.col("b"), F.col("a")).alias("topic_id"), F.lit(stage).alias("stage"))

    equal = cut(answer(qk.join(rk.select("key", "topic_id"), "key"), "equal"))
    left = qk.join(equal, "seq", "left_anti")
    short_q, short_r = left.where(F.length("key") < KEY), rk.where(F.length("key") < KEY)
    # a short key is a prefix of the other side: join on every length that a short key has
    longer_r = rk.select("topic_id", "key", F.explode(F.sequence(F.lit(1), F.length("key"))).alias("n")).select("topic_id", F.expr("substring(key, 1, n)").alias("key"))
    longer_q = left.select("seq", "key", F.explode(F.sequence(F.lit(1), F.length("key"))).alias("n")).select("seq", F.expr("substring(key, 1, n)").alias("key"))
    prefix = cut(answer(short_q.join(longer_r, "key").select("seq", "topic_id").unionAll(longer_q.join(short_r, "key").select("seq", "topic_id")), "prefix"))
    rest = left.join(prefix, "seq", "left_anti").where(F.length("h") >= KEY)

    long_r = r.where(F.length("h") >= KEY)
    both = cut(_holders(rest, "seq", long_r, "topic_id")).unionByName(cut(_holders(long_r, "topic_id", rest, "seq")))
    inside = answer(both, "inside")
    return equal.unionAll(prefix).unionAll(inside).where("topic_id is not null")


def _holders(short: DataFrame, key: str, long: DataFrame, other: str) -> DataFrame:
    """``(key, other)``: whose text ``h`` holds the first ``NEEDLE`` characters of whose.

    A text that holds a needle holds all its seeds, so each needle is looked up by the one that the fewest texts hold.
    Only ids and seed hashes are exchanged; texts are joined to the pairs that are left.
    """
    needles = short.select(key, F.substring("h", 1, NEEDLE).alias("needle"))
    held = _seeds(long.select(F.col(other).cast("string").alias("id"), "h")).select(F.col("id").alias("_other"), "seed")
    asked = _seeds(needles.select(F.col(key).cast("string").alias("id"), F.col("needle").alias("h")))
    often = held.groupBy("seed").agg(F.count("*").alias("n"))
    rarest = asked.join(often, "seed", "left").groupBy("id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "seed")).alias("s"))
    pairs = rarest.where("s.n > 0").select(F.col("id").alias("_key"), "s.seed").join(held, "seed").select("_key", "_other")
    texts = long.select(F.col(other).cast("string").alias("_other"), other, "h")
    found = pairs.join(needles.select(F.col(key).cast("string").alias("_key"), key, "needle"), "_key").join(texts, "_other")
    return found.where(F.contains("h", F.col("needle"))).select("seq", "topic_id")


SEED = 16  # characters of a seed; every 24 characters hold the least of their nine seeds


def _seeds(texts: DataFrame) -> DataFrame:
    """``(id, seed)``: hashes of the least seed in each window of ``KEY`` characters (winnowing), without repeats. texts: (id, h)."""
    width = KEY - SEED + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cp, starts, ends = C.spans(C.to_array(C.join(b["h"].tolist())))
            if len(cp) < KEY:
                continue
            h = C.window_hashes(cp, SEED)
            least = np.lib.stride_tricks.sliding_window_view(h, width).min(axis=1)
            own = C.owners(starts, ends, KEY, len(cp))
            got = pd.DataFrame({"o": own, "seed": least.view(np.int64)})[own >= 0].drop_duplicates()
            yield pd.DataFrame({"id": b["id"].to_numpy()[got["o"].to_numpy()], "seed": got["seed"].to_numpy()})

    return texts.mapInPandas(run, "id string, seed bigint")


BLOCK = 1_500_000  # characters of each side that are sorted together
TOP = "seq bigint, topic_id string, common int"


class _Suffixes:
    """The sorted suffixes of texts, by doubling; a suffix ends with its text.

    ``at[i]`` is where text i begins in ``code``, ``order`` holds the places in ``code`` by suffix. Suffixes that are equal to their
    ends may stand in any order.
    """

    def __init__(self, texts: list[str]) -> None:
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.at = np.cumsum(lengths + 1) - lengths - 1
        self.own = np.repeat(np.arange(len(texts), dtype=np.int32), lengths + 1)
        n = len(self.own)
        self.left = np.repeat((self.at + lengths).astype(np.int32), lengths + 1) - np.arange(n, dtype=np.int32)  # characters up to the end of the text
        cp = C.to_array("".join(texts))
        used = np.zeros(0x110000, bool)
        used[cp] = True
        codes = np.cumsum(used)
        self.code = np.zeros(n + 1, np.int32)  # 0 ends a text
        self.code[np.flatnonzero(self.left)] = codes[cp]
        bits = max(1, int(codes[-1]).bit_length())
        self.width = 62 // bits
        key = np.zeros(n, np.int64)
        for k in range(self.width):
            key <<= bits
            key[: max(n - k, 0)] |= self.code[k:n]
        self.order = np.argsort(key).astype(np.int32)
        fresh = np.ones(n, bool)
        fresh[1:] = np.diff(key[self.order]) != 0
        self.ranks = []  # by length (width, twice it, ...) the first place of all suffixes that begin alike; equal to the end counts as alike
        rank = np.empty(n + 1, np.int32)
        rank[n] = -1
        rank[self.order] = np.maximum.accumulate(np.where(fresh, np.arange(n, dtype=np.int32), 0))
        del key
        self.ranks.append(rank)
        h = self.width
        while True:
            same = ~fresh
            same[:-1] |= ~fresh[1:]
            where = np.flatnonzero(same)
            where = where[self.left[self.order[where]] >= h]
            if not len(where):
                return
            some = self.order[where]
            key = (rank[some].astype(np.int64) << 32) | rank[some + h]
            by = np.argsort(key)
            some, key = some[by], key[by]
            self.order[where] = some
            new = np.ones(len(where), bool)
            new[1:] = np.diff(key) != 0
            fresh[where] = new
            rank = rank.copy()
            rank[some] = np.maximum.accumulate(np.where(new, where, 0))
            self.ranks.append(rank)
            h *= 2

    def common(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """How many characters the suffixes at ``p`` and ``q`` share from their beginning."""
        most = np.minimum(self.left[p], self.left[q])
        n, got = len(self.left), np.zeros(len(p), np.int32)
        for k in range(len(self.ranks) - 1, -1, -1):
            alike = self.ranks[k][np.minimum(p + got, n)] == self.ranks[k][np.minimum(q + got, n)]
            got += alike * np.int32(self.width << k)
        on = got < most
        for _ in range(self.width - 1):
            on &= self.code[np.minimum(p + got, n)] == self.code[np.minimum(q + got, n)]
            got += on
        return np.minimum(got, most)


def _first(key: np.ndarray, most: int) -> np.ndarray:
    """Of a sorted array, which elements are among the first ``most`` of their value."""
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[1:] != key[:-1]
    at = np.arange(len(key), dtype=np.int32)
    return at - np.maximum.accumulate(np.where(fresh, at, 0)) < most


def _ranked(q: np.ndarray, r: np.ndarray, v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``most`` records of each query with the greatest value, ties by record; of a pair the greatest value counts."""
    by = np.lexsort((-v, r, q))
    q, r, v = q[by], r[by], v[by]
    new = np.ones(len(q), bool)
    new[1:] = (q[1:] != q[:-1]) | (r[1:] != r[:-1])
    q, r, v = q[new], r[new], v[new]
    by = np.lexsort((r, -v, q))
    by = by[_first(q[by], most)]
    return q[by], r[by], v[by]


def nearest(queries: list[str], records: list[str], known: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(query, record, common)``: for each query the ``most`` records with the longest common run, ties by their order.

    ``known`` (queries x ``most``, falling) holds the lengths found with other records and is brought up to date; records that
    can't be among the first with them are left out. The best records of a query are the best of one of its suffixes, and those
    stand next to it in sorted order. So neighbours are walked while they share more than the query's last of ``most``; then
    that length is certain, and the first records of it are those of the runs of suffixes that share it. Long walks leave out
    neighbours that have the query's character in front of them too: they share more with the suffix before.
    """
    s = _Suffixes(records + queries)
    text, real = s.own[s.order], s.left[s.order] > 0
    is_record = real & (text < len(records))
    recs = s.order[is_record]
    own, n = s.own[recs], len(recs)
    if not n:
        return (np.zeros(0, np.int32),) * 3
    asks = real & (text >= len(records))
    q, at, k = text[asks] - np.int32(len(records)), s.order[asks], np.cumsum(is_record, dtype=np.int32)[asks]
    shared = np.zeros(n + 1, np.int32)  # of a record's suffix with the one before it
    shared[1:n] = s.common(recs[:-1], recs[1:])
    left = np.where(k > 0, s.common(at, recs[np.maximum(k - 1, 0)]), np.int32(0))
    right = np.where(k < n, s.common(at, recs[np.minimum(k, n - 1)]), np.int32(0))
    count = len(records)
    del s.order, text, real, is_record, asks

    def skip(w: np.ndarray, wk: np.ndarray, wv: np.ndarray, step: np.ndarray) -> None:
        before, ahead = s.code[recs - 1], s.code[at[w] - 1]  # the characters in front; 0 where a text begins
        bounds = np.concatenate([[0], np.flatnonzero(np.diff(before)) + 1, [n]]).astype(np.int32)  # where it is another one
        same = np.flatnonzero((before[wk] == ahead) & (ahead > 0))
        here = np.searchsorted(bounds, wk[same], "right")
        wk[same] = np.where(step[same] > 0, bounds[here], bounds[here - 1] - 1)
        inside = (wk[same] >= 0) & (wk[same] < n)
        wv[same] = np.where(inside, s.common(at[w[same]], recs[np.clip(wk[same], 0, n - 1)]), 0)

    last = known[:, -1].copy()
    kept = np.repeat(np.arange(len(queries), dtype=np.int32), most), np.tile(-1 - np.arange(most, dtype=np.int32), len(queries)), known.ravel()  # other records: negative
    kept = tuple(x[kept[2] > 0] for x in kept)
    best = np.zeros(len(queries), np.int32)
    np.maximum.at(best, q, np.maximum(left, right))
    high = np.concatenate([left, right]) > np.tile(best[q] // 2, 2)
    for walk in (high, ~high):  # after the high ones most others are out at once
        w = np.flatnonzero(walk).astype(np.int32)
        down = w < len(q)
        w = np.where(down, w, w - np.int32(len(q)))
        step = np.where(down, np.int32(-1), np.int32(1))
        wk, wv, steps = np.where(down, k[w] - 1, k[w]), np.where(down, left[w], right[w]), 0
        while True:
            on = np.flatnonzero(wv > last[q[w]])
            w, wk, wv, step = w[on], wk[on], wv[on], step[on]
            if len(w) and steps >= 16:  # most walks end before
                skip(w, wk, wv, step)
                on = np.flatnonzero(wv > last[q[w]])
                w, wk, wv, step = w[on], wk[on], wv[on], step[on]
            if not len(w):
                break
            steps += 1
            width = 1 if steps < 64 else max(1, min(4096, 1_000_000 // len(w)))  # long walks, through texts that repeat a run, go by many at once
            back = (step < 0)[:, None]
            path = wk[:, None] + step[:, None] * np.arange(width, dtype=np.int32)
            value = shared[np.clip(path + back, 0, n)]
            value[:, 0] = wv
            np.minimum.accumulate(value, axis=1, out=value)
            some = value > last[q[w]][:, None]
            kept = _ranked(*(np.concatenate(x) for x in zip(kept, (np.repeat(q[w], some.sum(axis=1)), own[path[some]], value[some]), strict=True)), most)
            full = np.flatnonzero(np.bincount(kept[0], minlength=len(queries)) >= most)
            last[full] = kept[2][np.searchsorted(kept[0], full, "right") - 1]
            wk = path[:, -1] + step
            wv = np.minimum(value[:, -1], shared[np.clip(wk + back[:, 0], 0, n)])
    del s
    begin = np.searchsorted(kept[0], kept[0])
    known[:] = 0
    known[kept[0], np.arange(len(begin)) - begin] = kept[2]

    found = [tuple(x[kept[1] >= 0] for x in kept)]
    open_ = np.flatnonzero((last[q] > 0) & (np.maximum(left, right) >= last[q]))
    for length in np.unique(last[q[open_]]):
        mine = open_[last[q[open_]] == length]
        starts = np.flatnonzero(shared[:n] < length)
        run = np.searchsorted(starts, np.where(right[mine] >= length, k[mine], k[mine] - 1), "right") - 1
        runs, run = np.unique(run, return_inverse=True)
        lo, sizes = starts[runs], np.append(starts, n)[runs + 1] - starts[runs]
        ends = np.cumsum(sizes)
        held = own[np.repeat(lo - (ends - sizes), sizes) + np.arange(ends[-1])]
        pair = np.unique(q[mine].astype(np.int64) * len(runs) + run)
        asking, run = pair // len(runs), pair % len(runs)
        for _ in range(most):
            least = np.minimum.reduceat(held, ends - sizes)
            got = least[run]
            some = got < count
            found.append((asking[some].astype(np.int32), got[some], np.full(some.sum(), length)))
            held[held == np.repeat(least, sizes)] = count
    return _ranked(*(np.concatenate(x) for x in zip(*found, strict=True)), most)


def closest(queries: DataFrame, records: DataFrame, most: int = 5, block: int = BLOCK) -> DataFrame:
    """``(seq, topic_id, common, rank)``: records whose text shares the longest common run with a query's, both whole.

    All queries are sent to all tasks, the records are exchanged once; no pairs are. A task sorts the suffixes of a
    block of records with those of a block of queries (:func:`nearest`) and keeps the ``most`` best of each query. Ties by id;
    a record without a common character has no row. Blocks hold ``block`` characters, or one text that is longer.
    """
    spark = queries.sparkSession
    asked = queries.select(F.col("seq").cast("bigint"), match_key(F.col("text"), None).alias("a")).where("a <> '' and seq is not null").toPandas()
    sent = spark.sparkContext.broadcast([(asked["seq"].to_numpy()[i:j], asked["a"].tolist()[i:j]) for i, j in C.slices(asked["a"].tolist(), block)])
    r = cut(records.select(F.col("topic_id").cast("string"), match_key(F.col("text"), None).alias("b")).where("b <> '' and topic_id is not null"))
    size = r.agg(F.sum(F.length("b"))).head()[0] or 0
    tasks = max(1, min(-(-size // block), 4 * spark.sparkContext.defaultParallelism))

    def best(x: pd.DataFrame) -> pd.DataFrame:
        top = x.sort_values(["seq", "common", "topic_id"], ascending=[True, False, True]).groupby("seq").head(most)
        return top.assign(topic_id=pd.Series(top["topic_id"].tolist(), index=top.index, dtype=object))  # one piece of memory, as Arrow wants it

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for b in batches:
            for i, j in C.slices(b["b"].tolist(), max(1, block // 4)):
                part = b.iloc[i:j]
                more = int(part["b"].str.len().sum())
                if held and n + more > block + block // 2:  # some more than a task's even share, as each is sorted with all queries
                    yield pd.concat(held).sort_values("topic_id")
                    held, n = [], 0
                held.append(part)
                n += more
        if held:
            yield pd.concat(held).sort_values("topic_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asks, out = sent.value, []
        known = [np.zeros((len(seqs), most), np.int32) for seqs, _ in asks]
        for part in blocks(batches):
            ids, texts = part["topic_id"].to_numpy(object), part["b"].tolist()
            for (seqs, a), lengths in zip(asks, known, strict=True):
                q, found, common = nearest(a, texts, lengths, most)
                out.append(pd.DataFrame({"seq": seqs[q], "topic_id": ids[found], "common": common}))
        if out:
            yield best(pd.concat(out))

    scored = r.repartition(tasks, "topic_id").mapInPandas(run, TOP)
    top = scored.groupBy("seq").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("common")).alias("n"), "topic_id"))), 1, most).alias("t"))
    each = top.select("seq", F.posexplode("t").alias("rank", "x"))
    return each.select("seq", F.col("x.topic_id").alias("topic_id"), (-F.col("x.n")).alias("common"), (F.col("rank") + 1).alias("rank"))


# Keys of captured JSON that hold text, in the order they are read.
PART_KEYS = ("text", "title", "content", "talk", "article", "question", "answer")


def _parts(value: object, depth: int = 0) -> Iterator[str]:
    if isinstance(value, str):
        if len(value.strip()) >= 4:
            yield value
    elif isinstance(value, list) and depth < 3:
        for x in value[:4]:
            yield from _parts(x, depth + 1)
    elif isinstance(value, dict) and depth < 3:
        for k in PART_KEYS:
            if k in value:
                yield from _parts(value[k], depth + 1)


def harvest(body: str | None, most: int = 400, nodes: int = 5000, parts_of: int = 9, keys_of: int = 24) -> list[dict]:
    """Objects with a numeric topic id anywhere in a JSON text, breadth first, with their text parts and whole text.

    The limits are the fixed ones of such walks; pass others to keep more.
    """
    try:
        root = json.loads(body or "")
    except ValueError:
        return []
    queue, seen, out = deque([root]), 0, []
    while queue and seen < nodes and len(out) < most:
        n = queue.popleft()
        seen += 1
        if isinstance(n, dict):
            ident = n.get("topic_id", n.get("topicId"))
            if ident is not None and str(ident).isdigit():
                parts = list(_parts(n))[:parts_of]
                text = "\n".join(parts)
                if text.strip():
                    out.append({"topic_id": str(ident), "text": text, "parts": parts, "keys": list(n)[:keys_of]})
            queue.extend(v for v in n.values() if isinstance(v, dict | list))
        elif isinstance(n, list):
            queue.extend(v for v in n if isinstance(v, dict | list))
    return out


def harvested(payloads: DataFrame, key: str = "seq", body: str = "body") -> DataFrame:
    """One row per record found in JSON bodies; the longest text of an id is kept, ties keep the earlier."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [{"seq": k, "pos": i, **r} for k, t in zip(b["k"], b["t"], strict=True) for i, r in enumerate(harvest(t))]
            yield pd.DataFrame(rows, columns=["seq", "pos", "topic_id", "text", "parts", "keys"])

    each = payloads.select(F.col(key).alias("k"), F.col(body).alias("t")).mapInPandas(
        run, "seq bigint, pos int, topic_id string, text string, parts array<string>, keys array<string>"
    )
    best = each.groupBy("topic_id").agg(F.max_by(F.struct("seq", "text", "parts", "keys"), F.struct(F.length("text"), -F.col("seq"), -F.col("pos"))).alias("r"))
    return best.select("topic_id", "r.seq", "r.text", "r.parts", "r.keys")


def enriched(docs: DataFrame, articles: DataFrame) -> DataFrame:
    """Documents with the text of the article they link to, if it was obtained and is the longer one.

    docs: (link, text, ...); articles: (link, article), one row per link. ``truncated`` is true where a link leads to no
    article; a shorter article leaves the text as it is.
    """
    longer = F.length("article") > F.length("text")
    joined = docs.join(articles, "link", "left").withColumn("truncated", F.col("link").isNotNull() & F.col("article").isNull())
    return joined.withColumn("text", F.when(longer, F.concat("text", F.lit("\n\n"), "article")).otherwise(F.col("text"))).drop("article")


def text_index(whole: DataFrame, part: DataFrame) -> DataFrame:
    """``(key, topic_id, whole)``: the last writer of each key (seq); keys of whole texts come before keys of parts. Empty keys have no row."""
    rows = whole.withColumn("whole", F.lit(True)).unionByName(part.withColumn("whole", F.lit(False))).where("key <> ''")
    best = rows.groupBy("key").agg(F.max_by(F.struct("topic_id", "whole"), F.struct("whole", "seq")).alias("b"))
    return best.select("key", "b.topic_id", "b.whole")
