"""Passages of held-out test items inside a corpus, by Wu-Manber search.

Both sides are normalised (NFKC, lower case, letters and digits only). Each item is cut into blocks of
half the least run length, at multiples of that length: any shared run of ``run`` characters holds at
least one whole block. The blocks are the patterns of a Wu-Manber search: a table over hashed character
blocks says how far the scan may skip, suffix hashes choose the patterns to look at where it may not, and
a direct comparison confirms the occurrence. Confirmed occurrences are then compared along their diagonal
to see whether the run reaches ``run`` characters.

All segments of a batch are scanned in lockstep by numpy, so the skips cost vector operations, not
interpreted steps. Items are read in blocks of at most ``PATTERNS`` patterns; each block is one scan of
the corpus, so memory per worker is bounded whatever the number of items.

Defined results: null or short texts (fewer than ``run`` normalised characters) share nothing; repeated
documents or items give a row for each pair of ids, repeated ids one row; empty tables give no rows;
only the id and text columns are read. Texts of any length are searched whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.functions import codepoints as C

RUN = 60
BLOCK = 5  # characters per shift-table block
PATTERNS = 200_000  # patterns per scan; about 25 MB
SEGMENT = 4096
_U = np.uint64


def _block_hash(cp: np.ndarray, at: np.ndarray, bits: int) -> np.ndarray:
    """Hash of the ``BLOCK`` code points that end at each position."""
    h = np.zeros(len(at), np.uint64)
    for k in range(BLOCK):
        h = h * _U(0x9E3779B97F4A7C15) + cp[at - k]
    return (C.mix(h) >> _U(64 - bits)).astype(np.int64)


def _pattern_hash(windows: np.ndarray) -> np.ndarray:
    h = np.zeros(len(windows), np.uint64)
    for k in range(windows.shape[1]):
        h = h * _U(0xC2B2AE3D27D4EB4F) + windows[:, k]
    return C.mix(h)


class Patterns:
    """Shift table, suffix-hash buckets and pattern rows of a block of items."""

    def __init__(self, ids: list[int], texts: list[str | None], run: int = RUN) -> None:
        self.run, self.m = run, run // 2
        cp, starts, ends = C.normalised(texts)
        self.ids, self.starts, self.ends = np.asarray(ids, np.int64), starts, ends
        self.cp = cp.astype(np.uint64)
        at, item = [], []
        for i, (s, e) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
            if e - s >= run:
                p = np.arange(s, e - self.m + 1, self.m)
                at.append(p)
                item.append(np.full(len(p), i))
        self.at = np.concatenate(at) if at else np.zeros(0, np.int64)
        self.item = np.concatenate(item) if item else np.zeros(0, np.int64)
        rows = self.cp[self.at[:, None] + np.arange(self.m)] if len(self.at) else np.zeros((0, self.m), np.uint64)
        h = _pattern_hash(rows)
        order = np.argsort(h, kind="stable")
        self.hash, self.rows, self.at, self.item = h[order], rows[order], self.at[order], self.item[order]
        self.bits = max(14, min(24, int(np.ceil(np.log2(max(len(self.at), 1) * self.m * 8)))))
        self.shift = np.full(1 << self.bits, self.m - BLOCK + 1, np.int16)
        for j in range(BLOCK - 1, self.m):  # block that ends at offset j leaves m - 1 - j characters
            np.minimum.at(self.shift, _block_hash(self.cp, self.at + j, self.bits), np.int16(self.m - 1 - j))

    def occurrences(self, cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``cp`` (of the first character) and pattern numbers of all confirmed occurrences."""
        m = self.m
        pos = starts + m - 1
        live = pos < ends
        pos, last = pos[live], ends[live]
        hits = []
        while len(pos):
            s = self.shift[_block_hash(cp, pos, self.bits)]
            stop = s == 0
            if stop.any():
                hits.append(pos[stop] - (m - 1))
            pos = pos + np.maximum(s, 1)
            live = pos < last
            pos, last = pos[live], last[live]
        if not hits:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.concatenate(hits)
        windows = cp[at[:, None] + np.arange(m)]
        h = _pattern_hash(windows)
        low, high = np.searchsorted(self.hash, h, "left"), np.searchsorted(self.hash, h, "right")
        n = high - low
        which = np.repeat(np.arange(len(at)), n)
        pattern = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        same = (windows[which] == self.rows[pattern]).all(axis=1)
        return at[which[same]], pattern[same]

    def leaks(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and item ids of the texts that share a run of at least ``run`` characters."""
        cp, starts, ends = C.normalised(texts)
        cp = cp.astype(np.uint64)
        doc = np.flatnonzero(ends - starts >= self.run)
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(doc) or not len(self.at):
            return none
        # long texts become overlapping segments, so that lockstep isn't bound to the longest text
        pieces = -(-(ends[doc] - starts[doc]) // SEGMENT)
        which = np.repeat(np.arange(len(doc)), pieces)
        k = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        s = starts[doc][which] + k * SEGMENT
        at, pattern = self.occurrences(cp, s, np.minimum(s + SEGMENT + self.m - 1, ends[doc][which]))
        if not len(at):
            return none
        d = np.searchsorted(starts, at, side="right") - 1
        d = np.where(ends[d] > at, d, np.searchsorted(ends, at, side="right"))
        item = self.item[pattern]
        diagonal = (at - starts[d]) - (self.at[pattern] - self.starts[item])
        keys = np.unique(np.stack((d, item, diagonal)), axis=1)
        rows, found, done = [], [], set()
        for a, i, g in keys.T.tolist():
            if (a, i) in done:
                continue
            x0, x1, y0, y1 = starts[a], ends[a], self.starts[i], self.ends[i]
            low, high = max(0, -g), min(y1 - y0, x1 - x0 - g)  # offsets in the item along the diagonal
            same = cp[x0 + g + low : x0 + g + high] == self.cp[y0 + low : y0 + high]
            breaks = np.flatnonzero(np.concatenate(([True], ~same, [True])))
            if len(breaks) > 1 and int(np.diff(breaks).max()) - 1 >= self.run:
                done.add((a, i))
                rows.append(a)
                found.append(int(self.ids[i]))
        return np.asarray(rows, np.int64), np.asarray(found, np.int64)


def _item_blocks(items: DataFrame, key: str, text: str, run: int) -> Iterator[tuple[list[int], list[str]]]:
    ids: list[int] = []
    texts: list[str] = []
    patterns = 0
    for r in items.select(key, text).where(F.col(text).isNotNull() & F.col(key).isNotNull()).toLocalIterator():
        ids.append(r[0])
        texts.append(r[1])
        patterns += len(r[1]) // (run // 2) + 1
        if patterns >= PATTERNS:
            yield ids, texts
            ids, texts, patterns = [], [], 0
    if ids:
        yield ids, texts


def leaked(
    docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", run: int = RUN
) -> DataFrame:
    """``(doc_id, item_id)`` of every document that shares a run of at least ``run`` normalised characters with an item."""
    spark = docs.sparkSession
    slim = docs.select(F.col(doc_key).cast("bigint").alias("k"), F.col(text).alias("t")).where(f"length(t) >= {run // 20} and k is not null")
    schema = f"{doc_key} bigint, {item_key} bigint"
    scans = []
    for ids, texts in _item_blocks(items, item_key, text, run):
        sent = spark.sparkContext.broadcast(Patterns(ids, texts, run))

        def scan(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            patterns = sent.value
            for b in batches:
                keys, texts = b["k"].to_numpy(), b["t"].tolist()
                for low, high in C.slices(texts):
                    rows, found = patterns.leaks(texts[low:high])
                    yield pd.DataFrame({doc_key: keys[low:high][rows], item_key: found})

        scans.append(slim.mapInPandas(scan, schema))
    if not scans:
        return spark.createDataFrame([], schema)
    out = scans[0]
    for s in scans[1:]:
        out = out.unionAll(s)
    return out.distinct()


def _tables(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/eval_items.parquet")


def found(spark, sf_dir: str) -> DataFrame:
    """Query p6_found: (doc_id, item_id)."""
    return leaked(*_tables(spark, sf_dir))


def items_report(spark, sf_dir: str) -> DataFrame:
    """Query p6_items: for each item that leaked, in how many documents."""
    docs, items = _tables(spark, sf_dir)
    hits = leaked(docs, items).groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"))
    return items.select("item_id", "suite", "lang").join(hits, "item_id")
