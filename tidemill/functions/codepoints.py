"""Unicode work on whole batches of texts as arrays of code points.

A batch is joined into one string, so NFKC and lower case run once in C, and every later step
(filtering by category, hashing windows, searching) is a numpy operation on ``uint32`` code points.
Only usable inside Arrow functions; the JVM has no NFKC expression.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Sequence
from functools import lru_cache

import numpy as np

SEP = "\uffff"  # a noncharacter: never text, left alone by NFKC and lower case
_SEP = np.uint32(0xFFFF)
_CLASSES = "LNPSZMC"


@lru_cache(maxsize=1)
def categories() -> np.ndarray:
    """The major Unicode category of every code point as an index into ``LNPSZMC``."""
    index = {c: i for i, c in enumerate(_CLASSES)}
    cat = unicodedata.category
    return np.fromiter((index[cat(chr(i))[0]] for i in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)


@lru_cache(maxsize=4)
def members(classes: str) -> np.ndarray:
    """Boolean table of the code points whose category is one of ``classes`` (e.g. ``"LN"``)."""
    return np.isin(categories(), [_CLASSES.index(c) for c in classes])


def join(texts: Sequence[str | None]) -> str:
    """All texts in one string, one separator after each; nulls count as empty."""
    clean = [("" if t is None else t) for t in texts]
    big = SEP.join(clean)
    if big.count(SEP) != max(len(clean) - 1, 0):
        big = SEP.join(t.replace(SEP, "\ufffe") for t in clean)
    return big + SEP if clean else ""


def slices(texts: Sequence[str | None], most: int = 1_500_000) -> list[tuple[int, int]]:
    """Ranges of rows with about ``most`` characters each (one row at least), so that memory follows texts, not rows."""
    out, start, held = [], 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if held and held + n > most:
            out.append((start, i))
            start, held = i, 0
        held += n
    if len(texts) > start:
        out.append((start, len(texts)))
    return out


def to_array(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def spans(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points without separators, and the start and end of each text in them."""
    at = np.flatnonzero(cp == _SEP)
    ends = at - np.arange(len(at))
    starts = np.concatenate(([0], ends[:-1])) if len(at) else ends
    return cp[cp != _SEP], starts.astype(np.int64), ends.astype(np.int64)


def normalised(texts: Sequence[str | None], keep: str = "LN") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """NFKC, lower case, then only the categories in ``keep``; see :func:`spans` for the shape."""
    cp = to_array(unicodedata.normalize("NFKC", join(texts)).lower())
    table = members(keep).copy()
    table[int(_SEP)] = True
    return spans(cp[table[cp]])


def text_of(cp: np.ndarray) -> str:
    return np.ascontiguousarray(cp).tobytes().decode("utf-32-le", "surrogatepass")


_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * _M1
    x ^= x >> np.uint64(33)
    x *= _M2
    x ^= x >> np.uint64(33)
    return x


def window_hashes(cp: np.ndarray, width: int) -> np.ndarray:
    """64-bit hash of the ``width`` code points that begin at each position (windows may cross texts)."""
    n = len(cp) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    wide = cp.astype(np.uint64)
    h = wide[:n].copy()
    for k in range(1, width):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += wide[k : k + n]
    return mix(h)


def owners(starts: np.ndarray, ends: np.ndarray, width: int, total: int) -> np.ndarray:
    """For each window start the index of the text that holds the whole window, else -1."""
    n = total - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    lengths = ends - starts
    owner = np.repeat(np.arange(len(starts)), lengths)[:n]
    inside = np.arange(n) + width <= ends[owner]
    return np.where(inside, owner, -1)


def segment_hashes(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of disjoint segments by position-weighted sums of mixed code points."""
    pos = np.arange(len(cp), dtype=np.uint64)
    inside = np.zeros(len(cp) + 1, np.int64)
    np.add.at(inside, starts, 1)
    np.add.at(inside, ends, -1)
    first = np.zeros(len(cp), np.uint64)
    long = ends > starts
    first[starts[long]] = starts[long].astype(np.uint64)
    pos -= np.maximum.accumulate(first) if len(first) else first
    v = mix(cp.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + pos * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1))
    v[np.cumsum(inside[:-1]) == 0] = 0
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(v, dtype=np.uint64)))
    return mix(total[ends] - total[starts] + (ends - starts).astype(np.uint64))


def hash_texts(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """128-bit digests of the texts as two int64 columns, shape (n, 2)."""
    import xxhash

    view = memoryview(np.ascontiguousarray(cp)).cast("B")
    out = np.empty((len(starts), 2), np.int64)
    for i, (a, z) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        d = xxhash.xxh3_128_intdigest(view[4 * a : 4 * z])
        out[i, 0] = (d >> 64) - (1 << 64 if d >> 127 else 0)
        low = d & 0xFFFFFFFFFFFFFFFF
        out[i, 1] = low - (1 << 64 if low >> 63 else 0)
    return out
