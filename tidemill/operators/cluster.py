"""Duplicate forests: exact and near parents of entries in arrival order, and their roots.

An entry's parent depends on earlier fingerprints only, never on earlier labels, so the order-dependent
clustering is a join: equal content hash first (least id), else the nearest fingerprint within the
radius (then least id). Fingerprints within radius r agree in at least one of r + 1 bands, so for a small
radius candidates come from an equi-join on bands of distinct values. Of the entries with one content only those
are joined that can be the least id at some moment, so a popular content stays linear. With a large radius bands are so narrow that they prune nothing:
then salted blocks of sightings are compared pair by pair, and each block pair gives one best row per
sighting, so no pairs are kept. Roots follow by pointer doubling.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.finger import hamming
from tidemill.session import cut


BANDED = 3  # largest radius searched by bands; at four of 64 bits a band has 12 bits
BLOCK = 32_768  # rows of a block
LEFT, RIGHT = 64, 4_096  # rows compared at once


def bands(radius: int, bits: int = 64) -> list[tuple[int, int]]:
    """(shift, width) of radius + 1 bands that cover all bits."""
    n = radius + 1
    edges = [i * bits // n for i in range(n + 1)]
    return [(edges[i], edges[i + 1] - edges[i]) for i in range(n)]


def near_values(values: DataFrame, radius: int) -> DataFrame:
    """``(fp, other, distance)`` for all pairs of distinct values within the radius, both ways, without the value itself."""
    keyed = values.select("fp", F.explode(F.array(*(
        F.struct(F.lit(i).alias("band"), F.shiftrightunsigned(F.shiftleft("fp", 64 - s - w) if s + w < 64 else F.col("fp"), 64 - w).alias("part"))
        for i, (s, w) in enumerate(bands(radius))
    ))).alias("b")).select("fp", "b.band", "b.part")
    other = keyed.withColumnRenamed("fp", "other")
    d = hamming(F.col("fp"), F.col("other"))
    return keyed.join(other, ["band", "part"]).where(F.col("fp") != F.col("other")).select("fp", "other", d.alias("distance")).where(F.col("distance") <= radius).distinct()


def versions(events: DataFrame) -> DataFrame:
    """Sightings (seq, id, ch, fp) with ``until``, the next sighting of the id; each id's window is short."""
    w = Window.partitionBy("id").orderBy("seq")
    return events.select("seq", "id", "ch", "fp", F.lead("seq").over(w).alias("until"))


SPAN = 65_536  # numbers of a stretch of arrivals


def least_so_far(every: DataFrame) -> DataFrame:
    """The versions ``(ch, other_id, since, until)`` that can be the least id with their content at some moment.

    Of versions that hold for good only those count whose id is below all such ids before them: a handful, however
    many entries share the content. The running minimum is taken over stretches of arrivals first, so no content is one task.
    Versions that were replaced are kept all.
    """
    v = every.where("ch is not null").select("ch", F.col("id").alias("other_id"), F.col("seq").alias("since"), "until")
    lasting = v.where("until is null").withColumn("stretch", F.floor(F.col("since") / SPAN))
    tops = lasting.groupBy("ch", "stretch").agg(F.min("other_id").alias("least"))
    before = Window.partitionBy("ch").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("ch", "stretch", F.min("least").over(before).alias("least_before"))
    inside = Window.partitionBy("ch", "stretch").orderBy("since").rowsBetween(Window.unboundedPreceding, -1)
    low = lasting.join(tops, ["ch", "stretch"]).withColumn("so_far", F.least(F.min("other_id").over(inside), F.col("least_before")))  # least leaves nulls out
    return low.where(F.col("so_far").isNull() | (F.col("other_id") < F.col("so_far"))).select(*v.columns).unionByName(v.where("until is not null"))


def nearest_in_block(seq: np.ndarray, fp: np.ndarray, ids: np.ndarray, other: np.ndarray, since: np.ndarray, until: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Least distance and then least id of the versions that hold at each ``seq``; 255 and None where none is in the radius."""
    best, parent = np.full(len(seq), 255, np.int32), np.full(len(seq), None, object)
    if not len(seq) or not len(since):
        return best, parent
    fp, other = fp.astype(np.int64).view(np.uint64), other.astype(np.int64).view(np.uint64)  # bits of signed numbers are counted without sign
    by_id = np.argsort(ids, kind="stable")
    rank = np.empty(len(ids), np.int64)
    rank[by_id] = np.arange(len(ids))
    left, right = np.argsort(seq, kind="stable"), np.argsort(since, kind="stable")
    key = np.full(len(seq), 255 * len(ids), np.int64)  # distance * rows + rank of the id
    for j in range(0, len(right), RIGHT):
        r = right[j : j + RIGHT]
        r = r[np.argsort(rank[r], kind="stable")]  # so that argmin finds the least id among equals
        o, s, u, from_seq = other[r], since[r], until[r], since[r].min()
        for i in range(int(np.searchsorted(seq[left], from_seq, "right")), len(left), LEFT):
            x = left[i : i + LEFT]
            d = np.bitwise_count(fp[x, None] ^ o[None, :])
            d[(s[None, :] >= seq[x, None]) | (u[None, :] <= seq[x, None]) | (d > radius)] = 255
            at = d.argmin(axis=1)
            least = d[np.arange(len(x)), at].astype(np.int64)
            key[x] = np.where(least < 255, np.minimum(key[x], least * len(ids) + rank[r[at]]), key[x])
    hit = key < 255 * len(ids)
    best[hit] = key[hit] // len(ids)
    parent[hit] = ids[by_id[key[hit] % len(ids)]]
    return best, parent


def nearest_by_blocks(left: DataFrame, other: DataFrame, radius: int) -> DataFrame:
    """``(id, m: (distance, id))``: for each (id, seq, fp) the nearest of (other_id, other, since, until) that holds at seq.

    ``until`` must be above ``since``, and an id's own versions must not begin before its seq.
    """
    blocks = max(4, -(-other.count() // BLOCK))
    every = F.array(*(F.lit(i) for i in range(blocks)))
    salt = lambda c: F.pmod(F.xxhash64(*c), F.lit(blocks)).cast("int")
    ours = left.select(F.lit(True).alias("ours"), "id", "seq", "fp", F.lit(0).cast("long").alias("until"), salt(["id", "seq"]).alias("a"), F.explode(every).alias("b"))
    theirs = other.select(
        F.lit(False).alias("ours"), F.col("other_id").alias("id"), F.col("since").alias("seq"), F.col("other").alias("fp"), F.coalesce("until", F.lit(2**63 - 1)).alias("until"),
        F.explode(every).alias("a"), salt(["other_id", "since"]).alias("b"),
    )

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        x, y = rows[rows["ours"]], rows[~rows["ours"]]
        d, p = nearest_in_block(
            x["seq"].to_numpy(np.int64), x["fp"].to_numpy(np.int64), y["id"].to_numpy(object), y["fp"].to_numpy(np.int64),
            y["seq"].to_numpy(np.int64), y["until"].to_numpy(np.int64), radius,
        )
        hit = d < 255
        return pd.DataFrame({"id": x["id"].to_numpy(object)[hit], "distance": d[hit], "parent": p[hit]})

    # an explicit number of partitions: few bytes, but much work in each pair of blocks
    best = ours.unionByName(theirs).repartition(blocks * blocks, "a", "b").groupBy("a", "b").applyInPandas(run, "id string, distance int, parent string")
    return best.groupBy("id").agg(F.min(F.struct("distance", F.col("parent").alias("id"))).alias("m"))


def parents(events: DataFrame, radius: int = 3) -> DataFrame:
    """``(id, seq, parent, kind, distance)`` of ids that follow a like entry when they are first seen.

    events: (seq, id, ch, fp), seq unique. A later sighting of an id replaces the fingerprints that others
    are compared with, but not its own place. Equal content comes first (least id), else the least
    (distance, id) among the versions that hold at that moment.
    """
    every = versions(events)
    first = events.groupBy("id").agg(F.min_by(F.struct("seq", "ch", "fp"), "seq").alias("e")).select("id", "e.seq", "e.ch", "e.fp")
    other = every.select("ch", F.col("fp").alias("other"), F.col("id").alias("other_id"), F.col("seq").alias("since"), "until")
    live = (F.col("other_id") != F.col("id")) & (F.col("since") < F.col("seq")) & (F.col("until").isNull() | (F.col("seq") < F.col("until")))
    exact = (
        first.where("ch is not null").select("id", "seq", "ch").join(least_so_far(every), "ch")
        .where(live).groupBy("id").agg(F.min("other_id").alias("parent"))
    )
    left = first.where("fp is not null").join(exact.select("id"), "id", "left_anti").select("id", "seq", "fp")
    if radius > BANDED:
        near = nearest_by_blocks(left, other.where("other is not null").select("other", "other_id", "since", "until"), radius)
    else:
        values = every.where("fp is not null").select("fp").distinct()
        pairs = near_values(values, radius).unionByName(values.select("fp", F.col("fp").alias("other"), F.lit(0).alias("distance")))
        near = (
            left.join(pairs, "fp").join(other.select("other", "other_id", "since", "until"), "other").where(live)
            .groupBy("id").agg(F.min(F.struct("distance", F.col("other_id").alias("id"))).alias("m"))
        )
    both = exact.select("id", "parent", F.lit("exact").alias("kind"), F.lit(0).alias("distance")).unionByName(
        near.select("id", F.col("m.id").alias("parent"), F.lit("near").alias("kind"), F.col("m.distance").alias("distance"))
    )
    return both.join(first.select("id", "seq"), "id")


def roots(links: DataFrame) -> DataFrame:
    """``(id, root)`` for a forest of ``(id, parent)`` links; each round halves the height of what is left."""
    up = cut(links.select("id", F.col("parent").alias("root")))
    while True:
        step = up.join(up.select(F.col("id").alias("root"), F.col("root").alias("further")), "root", "left")
        if step.where("further is not null").isEmpty():
            return up
        up = cut(step.select("id", F.coalesce("further", "root").alias("root")))
