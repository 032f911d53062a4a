"""Mixing sources to target shares of all tokens by Pareto order sampling.

1. Tokens of every document of a targeted source are counted with a public tokenizer.
2. Shares are made to sum to one over the sources that have text and a positive share. The budget is
   spread over them in proportion; a source that would need more than ``max_repeats`` copies of its texts
   gives all it may, and the rest is spread over the others (water filling).
3. A source's quota divided by its tokens is the expected number of copies of each text; exact copies of
   a text within a source share one allotment, so the expected copies of a document are unequal. The
   whole part is allotted for certain. The fraction is the inclusion probability pi of Pareto order
   sampling: documents are ranked by (u / (1 - u)) / (pi / (1 - pi)), u a hash of key and seed, and taken
   in that order until the source's remaining tokens are reached.
4. The place of the cut in each source's order is found by refining a histogram of the ranks, so no
   source is sorted in one task.

Defined results: targets with a null, zero or negative share and sources without tokens get nothing; a
null or missing cap means one copy at most; repeated target rows of a source add up their shares and
take the least cap; null or empty texts have no tokens and are never taken; ties of rank are broken by
key; empty tables give no rows; extra columns are not read.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.session import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Split pattern that belongs to the vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BINS = 4096


@lru_cache(maxsize=2)
def _encoding(ranks: bytes):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
    return tiktoken.Encoding("mixing", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def count_tokens(df: DataFrame, text: str, out: str = "tokens", tokenizer: str = TOKENIZER) -> DataFrame:
    """``df`` with the number of tokens of a text column; the vocabulary file is read once and sent to the workers."""
    with open(tokenizer, "rb") as f:
        ranks = df.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf("bigint")
    def size(texts: pd.Series) -> pd.Series:
        encode = _encoding(ranks.value).encode_ordinary
        return pd.Series([0 if not t else len(encode(t)) for t in texts])

    return df.withColumn(out, size(F.col(text)))


def plan(sizes: list[tuple[str, int]], targets: list[tuple[str, float | None, int | None]], budget: int | None = None) -> dict[str, dict]:
    """Quota of each targeted source. sizes: tokens per source, every text counted once per exact copy group."""
    wish: dict[str, list] = {}
    for source, share, cap in targets:
        w = wish.setdefault(source, [0.0, None])
        w[0] += share if share is not None and share > 0 else 0.0
        c = max(int(cap), 0) if cap is not None else 1
        w[1] = c if w[1] is None else min(w[1], c)
    have = dict(sizes)
    total_share = sum(w[0] for s, w in wish.items() if have.get(s, 0) > 0 and w[1] > 0)
    out = {s: {"share": w[0] / total_share if total_share and have.get(s, 0) > 0 and w[1] > 0 else 0.0, "cap": w[1], "available": have.get(s, 0), "quota": 0.0}
           for s, w in wish.items()}
    open_ = {s for s, p in out.items() if p["share"] > 0}
    left = float(budget if budget is not None else sum(out[s]["available"] for s in open_))
    while open_ and left > 0:
        weight = sum(out[s]["share"] for s in open_)
        full = {s for s in open_ if out[s]["cap"] * out[s]["available"] <= left * out[s]["share"] / weight}
        if not full:
            for s in open_:
                out[s]["quota"] = left * out[s]["share"] / weight
            break
        for s in full:
            out[s]["quota"] = float(out[s]["cap"] * out[s]["available"])
            left -= out[s]["quota"]
        open_ -= full
    return out


def _cut_points(drawn: DataFrame, need: DataFrame) -> DataFrame:
    """Rows of ``drawn`` (key, source, tokens, place in [0, 1)) that come first in their source until ``need`` tokens."""
    scale, taken, edge = 1, None, drawn.join(F.broadcast(need), "source")  # need has a row per target
    width = 1.0
    for _ in range(3):
        lower = F.col("lower") if scale > 1 else F.lit(0.0)
        width = width / BINS
        binned = edge.withColumn("bin", F.least(F.floor((F.col("place") - lower) / F.lit(width)), F.lit(BINS - 1)).cast("int"))
        sums = binned.groupBy("source", "bin").agg(F.sum("tokens").alias("n"), F.first("need").alias("need"))
        order = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        before = sums.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0)))  # at most BINS rows per source
        whole = before.where(F.col("before") + F.col("n") <= F.col("need")).select("source", "bin")
        part = before.where((F.col("before") <= F.col("need")) & (F.col("before") + F.col("n") > F.col("need"))).select(
            "source", "bin", (F.col("need") - F.col("before")).alias("rest")
        )
        sure = binned.join(F.broadcast(whole), ["source", "bin"], "left_semi").select("key")
        taken = sure if taken is None else taken.unionAll(sure)
        edge = cut(
            binned.join(F.broadcast(part), ["source", "bin"])
            .withColumn("start", lower + F.col("bin") * F.lit(width))
            .select("key", "source", "tokens", "place", F.col("rest").alias("need"), F.col("start").alias("lower"))
        )
        scale *= BINS
    # what is left per source shares one of 2^36 places: order it by key, and take a row if that brings the sum nearer
    inside = Window.partitionBy("source").orderBy("place", "key").rowsBetween(Window.unboundedPreceding, -1)
    last = edge.withColumn("before", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    last = last.where(F.col("before") + F.col("tokens") / 2.0 <= F.col("need")).select("key")
    return taken.unionAll(last)


def mixed(
    docs: DataFrame,
    targets: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    budget: int | None = None,
    seed: int = 17,
    tokenizer: str = TOKENIZER,
) -> tuple[DataFrame, DataFrame]:
    """Selection ``(key, source, tokens, copies)`` and report of shares, one row per target."""
    spark = docs.sparkSession
    # one row per target source: a table of the mix, not of the data
    wanted = [(r[0], r[1], r[2]) for r in targets.select("source", "target_share", "max_repeats").where("source is not null").collect()]
    asked = [s for s, share, _ in wanted if share is not None and share > 0]
    slim = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), F.col(text).alias("t"))
    slim = slim.where(F.col("source").isin(asked) & (F.length("t") > 0) & F.col("key").isNotNull()) if asked else slim.where("false")
    sized = cut(count_tokens(slim, "t", tokenizer=tokenizer).select("key", "source", "tokens", F.xxhash64("t").alias("h1"), F.crc32("t").alias("h2")))
    # exact copies share one allotment; hot texts are pre-aggregated before the exchange
    copies = sized.groupBy("source", "h1", "h2").agg(F.count("*").alias("k"))
    several = copies.where("k > 1")
    weighted = cut(sized.join(several, ["source", "h1", "h2"], "left").select("key", "source", "tokens", (1.0 / F.coalesce("k", F.lit(1))).alias("w")))
    sizes = weighted.groupBy("source").agg(F.sum(F.col("w") * F.col("tokens")).alias("n")).collect()
    quotas = plan([(r[0], r[1] or 0) for r in sizes], wanted, budget)
    rate = [(s, float(q["quota"] / q["available"])) for s, q in quotas.items() if q["quota"] > 0]
    if not rate:
        rate_df = spark.createDataFrame([], "source string, rate double")
    else:
        rate_df = spark.createDataFrame(rate, "source string, rate double")
    expected = F.col("rate") * F.col("w")
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col("key")), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    drawn = (
        weighted.where("tokens > 0").join(F.broadcast(rate_df), "source")
        .withColumn("whole", F.floor(expected + 1e-9).cast("int"))
        .withColumn("pi", F.greatest(expected - F.col("whole"), F.lit(0.0)))
        .withColumn("u", u)
    )
    # q / (1 + q) keeps the order of the Pareto ranks and lies in [0, 1)
    odds = (F.col("u") / (1 - F.col("u"))) * ((1 - F.col("pi")) / F.col("pi"))
    drawn = cut(drawn.withColumn("place", F.when(F.col("pi") > 1e-9, odds / (1 + odds))))
    need = (
        drawn.groupBy("source").agg(F.sum(F.col("whole") * F.col("tokens")).alias("sure"))
        .join(F.broadcast(spark.createDataFrame([(s, q["quota"]) for s, q in quotas.items()] or [("", 0.0)], "source string, quota double")), "source")
        .select("source", F.greatest(F.col("quota") - F.col("sure"), F.lit(0.0)).alias("need"))
    )
    sampled = _cut_points(drawn.where("place is not null").select("key", "source", "tokens", "place"), need)
    chosen = drawn.join(sampled.withColumn("extra", F.lit(1)), "key", "left").withColumn("copies", F.col("whole") + F.coalesce("extra", F.lit(0)))
    chosen = cut(chosen.where("copies > 0").select(F.col("key").alias(key), "source", "tokens", "copies"))
    given = chosen.groupBy("source").agg(
        F.count("*").alias("documents"), F.sum("copies").alias("copies"), F.max("copies").alias("most_copies"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens")
    )
    rows = [(s, float(q["share"]), int(q["cap"]), float(q["available"]), float(q["quota"])) for s, q in quotas.items()]
    named = spark.createDataFrame(rows, "source string, share double, cap int, available double, quota double")
    total = Window.partitionBy()  # one row per target
    report = named.join(F.broadcast(given), "source", "left").select(
        "source", F.round("share", 6).alias("target_share"), F.col("cap").alias("max_repeats"), F.round("available", 1).alias("available_tokens"),
        F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("copies", F.lit(0)).alias("copies"),
        F.coalesce("most_copies", F.lit(0)).alias("most_copies"), F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.round(F.coalesce(F.col("tokens"), F.lit(0)) / F.sum(F.coalesce(F.col("tokens"), F.lit(0))).over(total), 6).alias("actual_share"),
    )
    return chosen, report


def _mix(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mixed(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/mix_targets.parquet"))


def selection(spark, sf_dir: str) -> DataFrame:
    """Query p7_mix: the selected documents with their numbers of copies."""
    return _mix(spark, sf_dir)[0]


def shares(spark, sf_dir: str) -> DataFrame:
    """Query p7_shares: for each target what was asked, what there is, and what was reached."""
    return _mix(spark, sf_dir)[1]
