"""Content fingerprints and 64-bit SimHash.

A SimHash is counted where its text is read: the tokens of an Arrow batch are found by numpy, each distinct one
is hashed once, and nothing is exchanged. Runs of Han characters count as single characters and pairs, runs of
ASCII letters and digits as words.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidemill.functions import codepoints as C

_HAN_RUN = re.compile("[㐀-䶿一-鿿豈-﫿]+|[a-z0-9]+")


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Unicode compatibility composition; the JVM has no expression for it."""
    return texts.map(lambda t: None if t is None else t if t.isascii() else unicodedata.normalize("NFKC", t))


def content_hash(c: Column) -> Column:
    """Sixteen hex digits of the SHA-256 of a text in lower case without punctuation, symbols and blanks.

    Pass the text through :func:`nfkc` first where full-width forms occur.
    """
    return F.substring(F.sha2(F.regexp_replace(F.lower(c), r"[\p{P}\p{S}\s 　﻿]+", ""), 256), 1, 16)


@lru_cache(maxsize=200_000)
def _lanes(token: str) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(sha256(token.encode()).digest()[:8], np.uint8))
    return bits.astype(np.int32) * 2 - 1


def simhash_of(text: str | None, compose: bool = True) -> str:
    """SimHash of one text in plain Python; the brute-force reference of the others."""
    t = unicodedata.normalize("NFKC", text or "").lower() if compose else (text or "").lower()
    out: list[str] = []
    for run in _HAN_RUN.findall(t):
        if run[0] < "\u0080":
            out.append(run)
        else:
            out.extend(run)
            out.extend(run[i : i + 2] for i in range(len(run) - 1))
    total = np.sum([_lanes(x) for x in out or [""]], axis=0)
    return np.packbits(total >= 0).tobytes().hex()


@lru_cache(maxsize=1_000_000)
def _spread(token: str) -> tuple[int, ...]:
    """The 64 bits of a token's hash in sixteen words of four 16-bit lanes."""
    bits = np.unpackbits(np.frombuffer(sha256(token.encode()).digest()[:8], np.uint8)).reshape(16, 4).astype(np.int64)
    return tuple((bits << np.array([0, 16, 32, 48])).sum(axis=1).tolist())


_IS_HAN = [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF)]


def simhash_batch(texts: list[str | None], compose: bool = True) -> list[str]:
    """SimHash (with NFKC) of many texts at once; each distinct token of a batch is hashed once."""
    joined = C.join(texts)
    cp, starts, ends = C.spans(C.to_array((unicodedata.normalize("NFKC", joined) if compose else joined).lower()))
    han = np.zeros(len(cp), bool)
    for a, z in _IS_HAN:
        han |= (cp >= a) & (cp <= z)
    word = ((cp >= 97) & (cp <= 122)) | ((cp >= 48) & (cp <= 57))
    owner = np.repeat(np.arange(len(starts)), ends - starts)
    singles = np.flatnonzero(han)
    pair = han[:-1] & han[1:] & (owner[:-1] == owner[1:]) if len(cp) > 1 else np.zeros(0, bool)
    pairs = np.flatnonzero(pair)
    begins = word & ~np.concatenate(([False], word[:-1] & (owner[:-1] == owner[1:]))) if len(cp) else word
    ws = np.flatnonzero(begins)
    stops = word & ~np.concatenate((word[1:] & (owner[:-1] == owner[1:]), [False])) if len(cp) else word
    we = np.flatnonzero(stops) + 1
    at = np.concatenate((singles, pairs, ws))
    stop = np.concatenate((singles + 1, pairs + 2, we))
    keys = np.concatenate((
        C.mix(cp[singles].astype(np.uint64) + np.uint64(1 << 50)),
        C.mix(cp[pairs].astype(np.uint64) * np.uint64(1 << 21) + cp[pairs + 1] + np.uint64(1 << 51)),
        C.segment_hashes(cp, ws, we),
    ))
    docs = owner[at] if len(at) else np.zeros(0, np.int64)
    _, first, which = np.unique(keys, return_index=True, return_inverse=True)
    table = np.array([_spread(C.text_of(cp[at[i] : stop[i]])) for i in first.tolist()], np.int64).reshape(-1, 16)
    order = np.argsort(docs, kind="stable")
    which, docs = which[order], docs[order]
    tokens_in = np.bincount(docs, minlength=len(starts))
    lanes = np.zeros((len(starts), 16, 4), np.int64)
    # lanes hold 16 bits, so sums are taken over runs of fewer than 2^15 tokens and added up wide
    for low in range(0, len(docs), 1 << 15):
        part = slice(low, low + (1 << 15))
        d = docs[part]
        new = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1])))
        for c in range(16):
            sums = np.add.reduceat(table[which[part], c], new)
            for lane in range(4):
                lanes[d[new], c, lane] += (sums >> (16 * lane)) & 0xFFFF
    ones = lanes.reshape(len(starts), 64)
    bits = 2 * ones >= tokens_in[:, None]
    out = [r.tobytes().hex() for r in np.packbits(bits, axis=1)]
    nothing = sha256(b"").hexdigest()[:16]
    return [x if n else nothing for x, n in zip(out, tokens_in.tolist(), strict=True)]


@F.pandas_udf(StringType())
def simhash(texts: pd.Series) -> pd.Series:
    """SimHash with NFKC; slices of Arrow batches at a time."""
    values = texts.tolist()
    return pd.Series([h for low, high in C.slices(values, 300_000) for h in simhash_batch(values[low:high])])


@F.pandas_udf(StringType())
def simhash_plain(texts: pd.Series) -> pd.Series:
    """SimHash of texts as they are."""
    values = texts.tolist()
    return pd.Series([h for low, high in C.slices(values, 300_000) for h in simhash_batch(values[low:high], compose=False)])


def as_long(hex16: Column) -> Column:
    """A 64-bit value from sixteen hex digits; null for anything else."""
    low = F.lower(hex16)
    return F.when(low.rlike("^[0-9a-f]{16}$"), F.conv(low, 16, -10).cast("bigint"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("int")
