"""Lines that belong to the site or the account instead of the piece.

Lines are compared by the letters left after NFKC and lower case. For each source (and each account
with enough rows) the number of rows that hold a line is set against its frequency outside
by a log-likelihood ratio (see :func:`line_tests` for what counts as outside). All lines repeated in a source
are tested, and the p values are controlled for false discovery (Benjamini-Hochberg over a fixed histogram of
-log10 p, so no global sort is needed). Significant lines that also reach the stated shares are the site's
lines; they are taken out of each text by position, and only positions are exchanged for that.

The texts are read once, to a table of narrow line rows; counts go by (line, source, account), (line, source) and line, each
with partial sums before the exchange, so no popular line is gathered in one task. Defined results: null texts have no lines; null sources are a source of their own; null
authors are in no account; empty tables give no rows; repeated rows count as often as they occur;
only the named columns are read.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.functions import codepoints as C
from tidemill.session import cut

MIN_LETTERS, MAX_CHARS = 4, 160
LEAST = 3.0  # -log10 p that a line absent outside must reach there, else the outside is too small to speak
MANY = 1_000_000  # rows with a line in the stand-in for the outside, so that its rate counts as known
_U = np.uint64


@dataclass(frozen=True)
class Rule:
    """When a repeated line counts as excessive."""

    min_rows: int = 8
    source_share: float = 0.03
    account_share: float = 0.10
    account_rows: int = 100
    discovery_rate: float = 0.01


def account(author: str | None) -> str | None:
    return None if author is None else unicodedata.normalize("NFKC", author).strip().lower()


def code(value: str | None, salt: int = 0) -> int:
    """Signed 64-bit code of a short string (source or account)."""
    import xxhash

    h = xxhash.xxh3_64_intdigest(b"\x00" if value is None else b"\x01" + value.encode("utf-8", "surrogatepass"), salt)
    return h - (1 << 64 if h >> 63 else 0)


def line_table(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """All lines of the texts, the text each belongs to, its key, and whether it may count."""
    parts = [[] if t is None else t.split("\n") for t in texts]
    lines = list(chain.from_iterable(parts))
    owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    cp, starts, ends = C.normalised(lines, "L")
    letters = ends - starts
    counts = (letters >= MIN_LETTERS) & (np.fromiter(map(len, lines), np.int64, len(lines)) <= MAX_CHARS)
    return lines, owner, text_keys(cp, starts, ends), counts


def text_keys(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit keys of the texts by a position-weighted sum of mixed code points."""
    pos = np.arange(len(cp), dtype=np.uint64) - np.repeat(starts.astype(np.uint64), ends - starts)
    with np.errstate(over="ignore"):
        v = C.mix(cp.astype(np.uint64) * _U(0x9E3779B97F4A7C15) + pos * _U(0xC2B2AE3D27D4EB4F) + _U(1))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(v, dtype=np.uint64)))
        return C.mix(total[ends] - total[starts] + (ends - starts).astype(np.uint64)).view(np.int64)


def _codes(values: pd.Series, make) -> np.ndarray:
    index, unique = pd.factorize(values, use_na_sentinel=True)
    table = np.array([make(u) for u in unique] + [make(None)], np.int64)
    return table[index]


def _slim(docs: DataFrame) -> DataFrame:
    return docs.select("seq", "source", "author", "text")


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for low, high in C.slices(b["text"].tolist()):
            yield b.iloc[low:high].reset_index(drop=True)


COUNTS, FIRST, ONCE = 1, 2, 4  # flags of a line: it may count; the first such line of its text with this key; the first of all


def lines_of(docs: DataFrame) -> DataFrame:
    """``(seq, line_no, key, source, account, flags)`` of every line of every text; the one pass over the texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _pieces(batches):
            _, o, key, counts = line_table(b["text"].tolist())
            if not len(o):
                continue
            source = _codes(b["source"], code)
            who = _codes(b["author"], lambda a: code(account(a), 1) if a is not None else 0)
            no = np.arange(len(o)) - np.searchsorted(o, o) + 1
            once = ~pd.DataFrame({"o": o, "key": key}).duplicated().to_numpy()
            first = ~pd.DataFrame({"o": o, "key": key, "c": counts}).duplicated().to_numpy() & counts
            flags = counts * COUNTS + first * FIRST + once * ONCE
            yield pd.DataFrame({"seq": b["seq"].to_numpy()[o], "line_no": no, "key": key, "source": source[o], "account": who[o], "flags": flags})

    return _slim(docs).mapInPandas(run, "seq bigint, line_no int, key bigint, source bigint, account bigint, flags int")


def line_counts(lines: DataFrame) -> DataFrame:
    """``(key, source, account, rows)``: in how many rows of an account each line stands."""
    first = F.col("flags").bitwiseAND(FIRST) != 0
    return lines.where(first).groupBy("key", "source", "account").agg(F.count("*").alias("rows"))


def row_counts(docs: DataFrame) -> DataFrame:
    """``(source, account, rows)``: rows of each account, accounts written in any way being one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({
                "source": _codes(b["source"], code), "account": _codes(b["author"], lambda a: code(account(a), 1) if a is not None else 0),
                "n": b["n"],
            })

    raw = docs.groupBy("source", "author").agg(F.count("*").alias("n"))
    return raw.mapInPandas(run, "source bigint, account bigint, n bigint").groupBy("source", "account").agg(F.sum("n").alias("account_rows"))


def _cell(observed, expected):
    return F.when(observed > 0, observed * F.log(observed / expected)).otherwise(0.0)


def log_likelihood_ratio(k1, n1, k2, n2):
    """G2 of k1 in n1 against k2 in n2, zero where the first rate isn't the larger."""
    k1, n1, k2, n2 = (c.cast("double") for c in (k1, n1, k2, n2))
    rate = (k1 + k2) / (n1 + n2)
    g = 2.0 * (
        _cell(k1, n1 * rate) + _cell(k2, n2 * rate) + _cell(n1 - k1, n1 * (1 - rate)) + _cell(n2 - k2, n2 * (1 - rate))
    )
    return F.when((n2 == 0) | (k1 * n2 > k2 * n1), F.greatest(g, F.lit(0.0))).otherwise(0.0)


def _log10_p(g):
    """-log10 of the upper tail of chi square with one degree of freedom (Gaussian tail bound, exact to 1 % from g = 4)."""
    z = F.sqrt(g)
    tail = -F.log10(F.lit(math.sqrt(2 / math.pi))) + g / (2 * math.log(10)) + F.log10(z + 1.0)
    return F.when(g > 0, F.greatest(tail, F.lit(0.0))).otherwise(0.0)


def discovery_cut(tests: DataFrame, rate: float, bins: int = 400, per_unit: int = 4) -> float:
    """Smallest -log10 p that Benjamini-Hochberg accepts at ``rate``; from a histogram of fixed size."""
    rows = (
        tests.groupBy(F.least(F.floor(F.col("strength") * per_unit), F.lit(bins)).cast("int").alias("bin"))
        .agg(F.count("*").alias("n"))
        .collect()
    )
    count = {r["bin"]: r["n"] for r in rows}
    total, above, best = sum(count.values()), 0, math.inf
    for b in range(bins, -1, -1):
        above += count.get(b, 0)
        if above and 10 ** (-b / per_unit) <= rate * above / total:
            best = b / per_unit
    return best


def line_tests(docs: DataFrame, rule: Rule = Rule(), lines: DataFrame | None = None) -> DataFrame:
    """``(source, account, key, k, n1, k2, n2, strength, shared)`` of every line that is repeated in a source.

    The outside of a source is made of the sources in which the line isn't repeated itself (fewer than ``min_rows``
    rows), so that lines shared by several sites don't hide each other; for an account the rest of its source
    belongs to it on the same condition. Where the outside is so small that even a line absent from it couldn't
    be told from chance (strength below ``LEAST``), a line of one row in each ``n1`` rows stands for the outside.
    """
    counts = cut(line_counts(lines_of(docs) if lines is None else lines))
    sizes = cut(row_counts(docs))
    n = sizes.agg(F.sum("account_rows")).head()[0] or 0
    per_source = sizes.groupBy("source").agg(F.sum("account_rows").alias("source_rows"))
    in_source = counts.groupBy("key", "source").agg(F.sum("rows").alias("in_source")).join(per_source, "source")
    repeated = F.col("in_source") >= rule.min_rows
    outside = in_source.groupBy("key").agg(
        F.sum(F.when(~repeated, F.col("in_source")).otherwise(0)).alias("k_clean"), F.sum(F.when(repeated, F.col("source_rows")).otherwise(0)).alias("n_unclean"),
        F.max("in_source").alias("most"),
    )
    placed = cut(in_source.where("in_source >= 2").join(outside.where("most >= 2"), "key"))
    own = ~repeated  # a source below the least number of rows is part of what is clean
    source = placed.select(
        "source", F.lit(0).cast("bigint").alias("account"), "key", F.col("in_source").alias("k"), F.col("source_rows").alias("n1"),
        (F.col("k_clean") - F.when(own, F.col("in_source")).otherwise(0)).alias("k2"),
        (F.lit(n) - F.col("n_unclean") - F.when(own, F.col("source_rows")).otherwise(0)).alias("n2"),
        (repeated & (F.col("in_source") >= F.lit(rule.source_share) * F.col("source_rows"))).alias("shared"),
    )
    of_account = (
        counts.where((F.col("account") != 0) & (F.col("rows") >= F.lit(rule.account_share * rule.account_rows)))
        .join(sizes.where(F.col("account_rows") >= rule.account_rows), ["source", "account"]).join(placed, ["key", "source"])
    )
    rest = F.col("in_source") - F.col("rows")
    fit = rest < rule.min_rows
    base_k = F.col("k_clean") - F.when(own, F.col("in_source")).otherwise(0)
    base_n = F.lit(n) - F.col("n_unclean") - F.when(own, F.col("source_rows")).otherwise(0)
    accounts = of_account.select(
        "source", "account", "key", F.col("rows").alias("k"), F.col("account_rows").alias("n1"),
        (base_k + F.when(fit, rest).otherwise(0)).alias("k2"), (base_n + F.when(fit, F.col("source_rows") - F.col("account_rows")).otherwise(0)).alias("n2"),
        (F.col("rows") >= F.lit(rule.account_share) * F.col("account_rows")).alias("shared"),
    )
    tests = source.unionAll(accounts)
    k, n1, none = F.col("k"), F.col("n1"), F.lit(0)
    speaks = _log10_p(log_likelihood_ratio(k, n1, none, F.col("n2"))) >= LEAST
    g = F.when(speaks, log_likelihood_ratio(k, n1, F.col("k2"), F.col("n2"))).otherwise(log_likelihood_ratio(k, n1, F.lit(MANY), F.lit(MANY) * n1))
    return tests.withColumn("strength", _log10_p(g))


def site_lines(docs: DataFrame, rule: Rule = Rule(), lines: DataFrame | None = None) -> DataFrame:
    """Marked lines ``(source, account, key)``; account 0 means the whole source. ``lines``: :func:`lines_of` the documents, if at hand.

    The ratio chooses under discovery control; of the chosen lines those stay that have the stated shares.
    """
    tests = cut(line_tests(docs, rule, lines))
    limit = discovery_cut(tests, rule.discovery_rate)
    return cut(tests.where((F.col("strength") > 0) & (F.col("strength") >= F.lit(limit)) & F.col("shared")).select("source", "account", "key"))


def marked_lines(docs: DataFrame, marks: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """``(seq, line_no)`` of every line that is marked for its source or account.

    All lines are joined with the marks of their source and of their account; Spark broadcasts the marks if they are small enough.
    """
    each = (lines_of(docs) if lines is None else lines).where(F.col("flags").bitwiseAND(COUNTS) != 0)
    of_source = marks.where("account = 0").select("key", "source", F.lit(True).alias("by_source"))
    of_account = marks.where("account <> 0").select("key", "source", "account", F.lit(True).alias("by_account"))
    hit = each.join(of_source, ["key", "source"], "left").join(of_account, ["key", "source", "account"], "left")
    return hit.where("by_source or by_account").select("seq", "line_no")


def without_lines(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """The documents with ``clean_text``: the unmarked lines in their order. Only (seq, positions) are grouped."""
    at = marked.groupBy("seq").agg(F.collect_set("line_no").alias("_marked"))  # bounded by the lines of one text
    lines = F.split(F.col("text"), "\n")
    kept = F.filter(F.transform(lines, lambda x, i: F.struct(x.alias("x"), (i + 1).alias("n"))), lambda s: ~F.array_contains(F.col("_marked"), s["n"]))
    cleaned = F.when(F.col("_marked").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda s: s["x"]), "\n"))
    return docs.join(at, "seq", "left").withColumn("clean_text", cleaned).drop("_marked")


def _docs(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/collected_documents.parquet")


def found(spark, sf_dir: str) -> DataFrame:
    """Query p3_found: (seq, line_no) of the site's lines."""
    docs = _docs(spark, sf_dir)
    lines = cut(lines_of(docs))
    return marked_lines(docs, site_lines(docs, lines=lines), lines)


def cleaned(spark, sf_dir: str) -> DataFrame:
    """Query p3_clean: each text without the site's lines, and how many were removed."""
    docs = _docs(spark, sf_dir).select("seq", "source", "author", "text")
    lines = cut(lines_of(docs))
    out = without_lines(docs, marked_lines(docs, site_lines(docs, lines=lines), lines))
    return out.select("seq", "source", "clean_text", (F.length("text") - F.length("clean_text")).alias("chars_removed"))
