"""Near-duplicate texts by anchor points of a covering code.

1. Rows with the same normalised text collapse to one representative (grouping on a 128-bit digest).
2. The character shingles of each text are min-hashed in one pass (one-permutation hashing with 256
   bins, empty bins filled from other bins). A *fingerprint* is a word of ``SYMBOLS`` such values; each
   text has ``TABLES`` fingerprints, plus one sketch bit per bin.
3. Anchors are the codewords of the single-parity-check code of length ``SYMBOLS`` over 64-bit symbols.
   Its covering radius is one: changing any one symbol of a word to fit the parity gives a codeword, so
   each word lies within distance one of exactly ``SYMBOLS`` anchors, and two words that differ in at
   most one symbol (the threshold) always have an anchor in common. Each fingerprint is replicated to
   all its anchors. Two texts of similarity s share an anchor in one table with probability
   ``s^4 + 4 s^3 (1 - s)``; with eight tables 0.994 at s = 0.6, 0.999 at 0.65.
4. Within an anchor the sketches are compared in blocks; pairs near enough are candidates. Anchors with
   more than ``BLOCK`` members are split into block pairs that run as separate tasks, so no anchor is
   bound to one task and none is capped.
5. Candidates are confirmed exactly on their shingle sets.

Defined results: null and short texts (fewer than ``min_chars`` normalised characters) are in no pair;
empty tables give no rows; repeated rows with one key would be one member each; only the key and the
text column are read, so extra columns cannot clash. Texts of any length are used whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.functions import codepoints as C
from tidemill.session import cut

BINS, TABLES, SYMBOLS = 256, 8, 4
BLOCK = 2048
SKETCH_LIMIT = 70  # of 256 bits; similarity 0.6 has 51 +- 6.4, 0.3 has 90 +- 7.6, unrelated texts 128 +- 8
WORDS = BINS // 64
SKETCH = [f"s{i}" for i in range(WORDS)]
HELD = 500_000  # most ids that are broadcast (4 MB), so that texts need not be exchanged to be chosen; more are joined by exchange
BIN_BITS = BINS.bit_length() - 1
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_U = np.uint64


def bin_minima(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int) -> np.ndarray:
    """Minimum shingle hash per text and bin, empty bins filled by further hashing; shape (n, BINS)."""
    n = len(starts)
    out = np.full(n * BINS, _EMPTY, np.uint64)
    h = C.window_hashes(cp, width)
    own = C.owners(starts, ends, width, len(cp))
    keep = own >= 0
    h, own = h[keep], own[keep]
    np.minimum.at(out, own * BINS + (h >> _U(64 - BIN_BITS)).astype(np.int64), C.mix(h))
    out = out.reshape(n, BINS)
    rows, bins = np.nonzero((out == _EMPTY) & (out != _EMPTY).any(axis=1)[:, None])
    filled, step = out.copy(), 0
    while len(rows):
        step += 1
        probe = (C.mix(bins.astype(np.uint64) * _U(0x9E3779B97F4A7C15) + _U(step)) >> _U(64 - BIN_BITS)).astype(np.int64)
        got = out[rows, probe]
        ok = got != _EMPTY
        filled[rows[ok], bins[ok]] = C.mix(got[ok] + _U(step))
        rows, bins = rows[~ok], bins[~ok]
    return filled


def sketch_bits(minima: np.ndarray) -> np.ndarray:
    """One bit of each bin, packed; shape (n, WORDS), int64."""
    bits = (C.mix(minima + _U(77)) & _U(1)).astype(np.uint8)
    return np.packbits(bits, axis=1).view(np.int64).reshape(-1, WORDS)


def anchors(minima: np.ndarray) -> np.ndarray:
    """Keys of the anchors within the covering radius; shape (n, TABLES * SYMBOLS), int64."""
    n = len(minima)
    words = minima[:, : TABLES * SYMBOLS].reshape(n, TABLES, SYMBOLS)
    total = words.sum(axis=2, dtype=np.uint64)
    place = C.mix(np.arange(1, SYMBOLS + 1, dtype=np.uint64)) | _U(1)
    weighted = (C.mix(words) * place).sum(axis=2, dtype=np.uint64)
    keys = np.empty((n, TABLES, SYMBOLS), np.uint64)
    for i in range(SYMBOLS):
        fitted = words[:, :, i] - total  # the value of symbol i that makes the sum zero
        keys[:, :, i] = weighted - C.mix(words[:, :, i]) * place[i] + C.mix(fitted) * place[i]
    keys = C.mix(keys + np.arange(TABLES, dtype=np.uint64)[None, :, None] * _U(0xD1B54A32D192ED03))
    return keys.reshape(n, -1).view(np.int64)


def _sketches(docs: DataFrame, key: str, text: str, width: int, min_chars: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole, (low, high) in ((w, r) for w in batches for r in C.slices(w["t"].tolist())):
            b = whole.iloc[low:high]
            cp, starts, ends = C.normalised(b["t"].tolist())
            long = np.flatnonzero(ends - starts >= max(min_chars, width))
            if not len(long):
                continue
            digest = C.hash_texts(cp, starts[long], ends[long])
            m = bin_minima(cp, starts, ends, width)[long]
            s = sketch_bits(m)
            yield pd.DataFrame({
                "id": b["k"].to_numpy()[long], "d1": digest[:, 0], "d2": digest[:, 1],
                **{c: s[:, i] for i, c in enumerate(SKETCH)}, "anchors": list(anchors(m)),
            })

    slim = docs.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t")).where("t is not null and k is not null")
    sketch = ", ".join(f"{c} bigint" for c in SKETCH)
    return slim.mapInPandas(run, f"id bigint, d1 bigint, d2 bigint, {sketch}, anchors array<bigint>")


def _distance(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Differing bits of sketches, over the last axis."""
    return np.bitwise_count(s ^ t).sum(axis=-1, dtype=np.int16)


def _compare(members: DataFrame) -> DataFrame:
    """Pairs within each (anchor, part) group: members of side 0 against side 1, or side 2 among themselves."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for b in batches:
            if not len(b):
                continue
            held.append(b)
            a = b["anchor"].to_numpy()
            p = b["part"].to_numpy()
            if len(a) and (a[-1] != held[0]["anchor"].iloc[0] or p[-1] != held[0]["part"].iloc[0]):
                whole = pd.concat(held) if len(held) > 1 else b
                last = (whole["anchor"].to_numpy() == a[-1]) & (whole["part"].to_numpy() == p[-1])
                yield from groups(whole[~last])
                held = [whole[last]]
        if held:
            yield from groups(pd.concat(held))

    def groups(b: pd.DataFrame) -> Iterator[pd.DataFrame]:
        a, p, ids, side = (b[c].to_numpy() for c in ("anchor", "part", "id", "side"))
        s = np.ascontiguousarray(b[SKETCH].to_numpy(np.int64)).view(np.uint64)
        new = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (p[1:] != p[:-1])))) if len(a) else np.zeros(0, np.int64)
        sizes = np.diff(np.concatenate((new, [len(a)])))
        left, right = [], []
        # groups of equal small size are compared together
        for size in np.unique(sizes):
            if size < 2:
                continue
            at = new[sizes == size]
            if size <= 32:
                for x in range(size - 1):
                    for y in range(x + 1, size):
                        i, j = at + x, at + y
                        near = _distance(s[i], s[j]) <= SKETCH_LIMIT
                        near &= (side[i] == 2) | (side[i] != side[j])
                        left.append(ids[i[near]])
                        right.append(ids[j[near]])
                continue
            for z in at:
                g = slice(z, z + size)
                if side[z] == 2:
                    one = two = np.arange(z, z + size)
                else:
                    one, two = z + np.flatnonzero(side[g] == 0), z + np.flatnonzero(side[g] == 1)
                for k in range(0, len(one), 256):
                    i, j = np.nonzero(_distance(s[one[k : k + 256], None], s[None, two]) <= SKETCH_LIMIT)
                    left.append(ids[one[k : k + 256][i]])
                    right.append(ids[two[j]])
        if left:
            x, y = np.concatenate(left), np.concatenate(right)
            keep = x != y
            x, y = np.minimum(x, y)[keep], np.maximum(x, y)[keep]
            yield pd.DataFrame({"a": x, "b": y}).drop_duplicates()

    return members.mapInPandas(run, "a bigint, b bigint")


def candidate_pairs(reps: DataFrame) -> DataFrame:
    """Pairs ``(a, b)``, a < b, of representatives that meet at an anchor with near sketches."""
    met = reps.select("id", *SKETCH, F.explode(F.array_distinct("anchors")).alias("anchor"))
    hot = met.groupBy("anchor").count().where(F.col("count") > BLOCK)
    hot = cut(hot.select("anchor", F.ceil(F.col("count") / F.lit(BLOCK // 2)).cast("int").alias("blocks")))
    plain = met
    if hot.isEmpty():
        plain = plain.select("*", F.lit(0).alias("part"), F.lit(2).alias("side"))
    else:
        split = met.join(hot, "anchor")
        block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
        # block i meets every block j: part i * blocks + j holds block i as side 0 and block j as side 1
        split = split.withColumn("mine", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        split = split.select(
            "id", *SKETCH, "anchor",
            (F.least("mine", "other") * F.col("blocks") + F.greatest("mine", "other") + 1).alias("part"),
            F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1).alias("side"),
        )
        plain = met.join(hot, "anchor", "left_anti").select("*", F.lit(0).alias("part"), F.lit(2).alias("side"))
        plain = plain.select("id", *SKETCH, "anchor", "part", "side").unionByName(split)
    grouped = plain.repartition("anchor", "part").sortWithinPartitions("anchor", "part")
    return _compare(grouped).distinct()


def _confirm(pairs: DataFrame, docs: DataFrame, key: str, text: str, width: int, at_least: float) -> DataFrame:
    """Exact similarity of candidate pairs on whole texts; texts of rows in no pair are not moved."""
    wanted = cut(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct())
    wanted = F.broadcast(wanted) if wanted.count() <= HELD else wanted
    texts = (
        docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("t"))
        .where("t is not null and id is not null")
        .join(wanted, "id", "left_semi")
    )
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("t").alias("ta")), "a").join(
        texts.select(F.col("id").alias("b"), F.col("t").alias("tb")), "b"
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for low, high in C.slices([x if len(x) > len(y) else y for x, y in zip(whole["ta"], whole["tb"], strict=True)]):
                b = whole.iloc[low:high]
                if not len(b):
                    continue
                ids, where = np.unique(np.concatenate((b["a"].to_numpy(), b["b"].to_numpy())), return_index=True)
                both_texts = b["ta"].tolist() + b["tb"].tolist()
                cp, starts, ends = C.normalised([both_texts[i] for i in where])
                h, own = C.window_hashes(cp, width), C.owners(starts, ends, width, len(cp))
                sets: list[np.ndarray] = []
                for s, e in zip(starts, ends, strict=True):
                    sets.append(np.unique(h[s : max(s, e - width + 1)]))
                del own
                ia, ib = np.searchsorted(ids, b["a"].to_numpy()), np.searchsorted(ids, b["b"].to_numpy())
                j = np.empty(len(b))
                for n, (x, y) in enumerate(zip(ia.tolist(), ib.tolist(), strict=True)):
                    u, v = sets[x], sets[y]
                    if min(len(u), len(v)) < at_least * max(len(u), len(v)):
                        j[n] = 0.0
                        continue
                    both_sorted = np.concatenate((u, v))
                    both_sorted.sort()
                    inter = int((both_sorted[1:] == both_sorted[:-1]).sum())
                    j[n] = inter / max(1, len(u) + len(v) - inter)
                keep = j >= at_least
                yield pd.DataFrame({"a": b["a"].to_numpy()[keep], "b": b["b"].to_numpy()[keep], "similarity": j[keep]})

    return both.mapInPandas(run, "a bigint, b bigint, similarity double")


def near_duplicates(
    docs: DataFrame, key: str = "seq", text: str = "text", width: int = 5, at_least: float = 0.6, min_chars: int = 300
) -> tuple[DataFrame, DataFrame]:
    """Members ``(id, rep)`` of exact-copy groups and confirmed links ``(a, b, similarity)`` between representatives."""
    sketched = cut(_sketches(docs, key, text, width, min_chars))
    first = sketched.groupBy("d1", "d2").agg(F.min("id").alias("rep"))
    members = sketched.select("id", "d1", "d2").join(first, ["d1", "d2"]).select("id", "rep")
    copies = cut(members.where("id <> rep"))
    reps = sketched.join(copies.select("id"), "id", "left_anti")
    links = cut(_confirm(cut(candidate_pairs(reps)), docs, key, text, width, at_least))
    whole = sketched.select("id").join(copies, "id", "left").select("id", F.coalesce("rep", "id").alias("rep"))
    return whole, links


def components(links: DataFrame) -> DataFrame:
    """``(id, root)`` of every id in a link ``(a, b)``: the least id that it is connected with.

    Large-star and small-star rounds (each an aggregate and a join on ids), so the number of rounds grows with the
    logarithm of the longest chain, and an id with many links is a partial aggregate.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m")).distinct()
        small = cut(small)
        if small.exceptAll(edges).isEmpty() and edges.exceptAll(small).isEmpty():
            return edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("id"), "root").union(edges.select("v", "v").distinct())
        edges = small


def classes(members: DataFrame, links: DataFrame) -> DataFrame:
    """``(id, class_id, links)``: one row per text that may be compared: the least id of its class, and its links to other texts.

    Copies share the links of their text; the links of a text are those to different texts. A class without links is
    one text with its copies.
    """
    ends = links.select(F.col("a").alias("rep")).unionAll(links.select(F.col("b").alias("rep")))
    degree = ends.groupBy("rep").agg(F.count("*").alias("links"))
    of_class = components(links).withColumnRenamed("id", "rep")
    joined = members.join(degree, "rep", "left").join(of_class, "rep", "left")
    return joined.select("id", F.coalesce("root", "rep").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


def row_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """All pairs of rows: copies of one text with each other, and copies across linked texts.

    A text with more than ``BLOCK`` copies is split into blocks of copies; each pair of blocks is a group of its own, so no task
    writes all pairs of a text. (The number of pairs is what the definition asks for; :func:`classes` says the same in one row per text.)
    """
    size = members.groupBy("rep").agg(F.count("*").alias("n")).where("n > 1")
    several = members.join(size, "rep").select("rep", "id", F.ceil(F.col("n") / F.lit(BLOCK)).cast("int").alias("blocks"))
    several = several.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    x = several.select("rep", F.col("id").alias("x"), F.col("block").alias("i"), every.alias("j"))
    y = several.select("rep", F.col("id").alias("y"), F.col("block").alias("j"), every.alias("i"))
    same = x.join(y, ["rep", "i", "j"]).where("x < y").select(F.col("x").alias("seq_a"), F.col("y").alias("seq_b"))
    # links of copied texts are spread by the blocks of both sides
    copies = several.select("rep", "id", "block")
    blocks = several.select("rep", "blocks").distinct()
    a = links.select("a", "b").join(blocks.select(F.col("rep").alias("a"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i")), "a", "left")
    a = a.join(copies.select(F.col("rep").alias("a"), F.col("block").alias("i"), F.col("id").alias("ida")), ["a", "i"], "left")
    b = a.select("b", F.coalesce("ida", "a").alias("x")).join(blocks.select(F.col("rep").alias("b"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j")), "b", "left")
    ab = b.join(copies.select(F.col("rep").alias("b"), F.col("block").alias("j"), F.col("id").alias("idb")), ["b", "j"], "left")
    y = F.coalesce("idb", "b")
    return same.unionAll(ab.select(F.least("x", y).alias("seq_a"), F.greatest("x", y).alias("seq_b")))


def _captures(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/collected_documents.parquet").select("seq", "text")


def found(spark, sf_dir: str) -> DataFrame:
    """Query p2_found: all row pairs of collected_documents with 5-character similarity of 0.6 or more."""
    return row_pairs(*near_duplicates(_captures(spark, sf_dir)))


def groups(spark, sf_dir: str) -> DataFrame:
    """Query p2_classes: each row with the class it belongs to and its number of links."""
    return classes(*near_duplicates(_captures(spark, sf_dir))).select(F.col("id").alias("seq"), "class_id", "links")
