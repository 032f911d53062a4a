"""Keyed tables: versions, upserts, selections.

Window forms would gather all versions of a key in one task; the aggregates here combine on the map side,
so a key with a third of all rows costs no more than another.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pick(df: DataFrame, keys: Sequence[str], by: Sequence[Column], latest: bool) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(*by)
    choose = F.max_by if latest else F.min_by
    return df.groupBy(*keys).agg(choose(F.struct(*rest), order).alias("_row")).select(*keys, "_row.*").select(*df.columns)


def first_per_key(df: DataFrame, keys: Sequence[str], *by: Column) -> DataFrame:
    """The row of each key that comes first; ``by`` must tell all rows of a key apart for a defined result."""
    return _pick(df, keys, by, latest=False)


def latest_per_key(df: DataFrame, keys: Sequence[str], *by: Column) -> DataFrame:
    """The row of each key that comes last."""
    return _pick(df, keys, by, latest=True)


def upsert(table: DataFrame, new: DataFrame, keys: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """``table`` with the rows of ``new`` in place of those with the same key; columns in ``keep`` keep their first value."""
    if keep:
        old = table.select(*keys, *(F.col(c).alias(f"_{c}") for c in keep))
        new = new.join(old, list(keys), "left")
        for c in keep:
            new = new.withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
    return table.join(new.select(*keys), list(keys), "left_anti").unionByName(new.select(*table.columns))


def selected(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is asked for; no ids select nothing."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def without(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't among ``ids``; null keys stay."""
    return df.join(ids.select(key).distinct(), key, "left_anti")


def running_limit(df: DataFrame, order: Sequence[str], counted: str, most: int) -> DataFrame:
    """Rows in order until ``most`` counted ones were met (the row that reaches the limit is kept).

    The limit is found from the ``most`` first counted rows, a top-k, so nothing is sorted in one task.
    """
    first = df.where(F.col(counted)).orderBy(*order).limit(most)
    bound = first.agg(F.when(F.count("*") == most, F.max(F.struct(*order)))).scalar()
    return df.where(bound.isNull() | (F.struct(*order) <= bound))


def quarantine(df: DataFrame, rules: Sequence[tuple[str, str, Column]]) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and the others with an array ``issues`` of (path, message); a null check is a failure."""
    issues = F.filter(
        F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.struct(F.lit(p).alias("path"), F.lit(m).alias("message"))) for p, m, ok in rules)),
        lambda x: x.isNotNull(),
    )
    judged = df.withColumn("issues", issues)
    return judged.where(F.size("issues") == 0).drop("issues"), judged.where(F.size("issues") > 0)
