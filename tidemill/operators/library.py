"""The library catalog: delivery states, listings, routes, residue."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators import keyed

STORE = "markdown"  # the sink every entry goes to before any other


def sync_state(sync: Column) -> Column:
    """Shown state: none is pending; synced but unpushed with a failed push or an error is failed; else as stored."""
    broken = ~F.coalesce(sync["pushed"], F.lit(True)) & (F.coalesce(sync["pushFailed"], F.lit(False)) | sync["error"].isNotNull())
    return F.when(sync.isNull() | sync["state"].isNull(), "pending").when((sync["state"] == "synced") & broken, "failed").otherwise(sync["state"])


def delivered(sync: Column) -> Column:
    """Synced, the push not failed, and not left unpushed with an error."""
    return F.coalesce(
        (sync["state"] == "synced")
        & ~F.coalesce(sync["pushFailed"], F.lit(False))
        & ~(~F.coalesce(sync["pushed"], F.lit(True)) & sync["error"].isNotNull()),
        F.lit(False),
    )


def entry_date(published: Column, updated: Column) -> Column:
    return F.coalesce(published, updated)


def listing(catalog: DataFrame) -> DataFrame:
    """Newest first by date, then id; sorted by ranges over all partitions."""
    return catalog.orderBy(F.desc(entry_date(F.col("publishedAt"), F.col("updatedAt"))), "id")


def routes(spark: SparkSession, by_source: Mapping[str, Sequence[str]], sinks: Sequence[str]) -> DataFrame:
    """``(source, sinks, target)``: known sinks of each source without repeats, the store if none; target is the first other."""
    known = F.array(*(F.lit(s) for s in sinks))
    raw = spark.createDataFrame([(s, list(x)) for s, x in by_source.items()], "source string, wanted array<string>")
    return resolve(raw, known)


def resolve(wanted: DataFrame, known: Column) -> DataFrame:
    kept = F.array_distinct(F.filter(F.coalesce("wanted", F.array().cast("array<string>")), lambda s: F.array_contains(known, s)))
    chosen = F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit(STORE)))
    return wanted.withColumn("sinks", chosen).withColumn("target", F.try_element_at(F.filter("sinks", lambda s: s != STORE), F.lit(1))).drop("wanted")


def outcomes(chosen: DataFrame, results: DataFrame, targets: DataFrame) -> DataFrame:
    """What delivering each chosen entry came to: one row each, a failure never stops another.

    chosen: (id, source); targets: (source, target); results: (id, ok, committed, pushed, error).
    """
    r = chosen.join(targets, "source", "left").join(results, "id", "left")
    ok = F.coalesce(F.col("ok"), F.lit(False)) & F.coalesce(F.col("committed"), F.lit(True)) & F.coalesce(F.col("pushed"), F.lit(True))
    state = F.when(F.col("target").isNull(), "failed").when(ok, "synced").otherwise("failed")
    reason = F.when(F.col("target").isNull(), "no target for this source").when(~ok, F.coalesce("error", F.lit("not delivered")))
    return r.select("id", "source", "target", state.alias("state"), reason.alias("reason"))


def residue(catalog: DataFrame, files: DataFrame) -> DataFrame:
    """Files no entry knows, entries without file, leftovers of writes: (kind, path). files: (path)."""
    folder = lambda c: F.regexp_replace(c, "/[^/]*$", "")
    real = files.where(~F.col("path").endswith(".tmp"))
    known = catalog.select(folder(F.col("relativePath")).alias("folder")).distinct()
    orphans = real.withColumn("folder", folder(F.col("path"))).join(known, "folder", "left_anti").select(F.lit("orphan").alias("kind"), "path")
    zombies = catalog.select(F.col("relativePath").alias("path")).join(real, "path", "left_anti").select(F.lit("zombie").alias("kind"), "path")
    temporary = files.where(F.col("path").endswith(".tmp")).select(F.lit("temporary").alias("kind"), "path")
    return orphans.unionByName(zombies.distinct()).unionByName(temporary)


def front_matter(fields: Sequence[tuple[str, Column]]) -> Column:
    """A YAML head with JSON-quoted strings; absent values leave no line."""
    # json of a one-field struct is {"v":...}: cut the frame, so that quoting is JSON's
    lines = [F.when(c.isNotNull(), F.concat(F.lit(f"{name}: "), F.regexp_replace(F.to_json(F.struct(c.alias("v"))), r'^\{"v":|\}$', ""))) for name, c in fields]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n"))


def deleted(catalog: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remaining rows, and ``(id, source, relativePath, outcome)`` of the chosen ones; no ids delete nothing.

    A chosen row always leaves the catalog. Its folder is ``deleted`` if the path stays below the root; a path that is
    absent, absolute or climbs out is ``missing``, and nothing is to be removed for it.
    """
    path = F.col("relativePath")
    outside = path.isNull() | (path == "") | path.startswith("/") | path.rlike(r"(^|/)\.\.(/|$)")
    chosen = keyed.selected(catalog, ids, "id")
    outcome = F.when(outside, "missing").otherwise("deleted")
    return keyed.without(catalog, ids, "id"), chosen.select("id", "source", "relativePath", outcome.alias("outcome"))


#: What a failed delivery says, first match wins.
FAILURES = (
    ("(?i)xcrun|CommandLineTools|xcode-select", "toolchain"), ("(?i)unmerged files|MERGE_HEAD|you have not concluded your merge|unresolved conflict", "merge"),
    ("(?i)not a git repository", "repository"), (r"(?i)Please tell me who you are|user\.email", "identity"),
    (r"(?i)could not read Username|Authentication failed|Permission denied \(publickey\)", "credentials"),
    ("(?i)no upstream|does not appear to be a git repository|couldn't find remote", "remote"), ("(?i)non-fast-forward|rejected|fetch first|behind", "behind"),
)


def repository_reason(now: Column, host: str = "https://github.example/", days: int = 365) -> Column:
    """Why a found repository is dropped, or ``kept``: columns id, fullName, htmlUrl, owner, updatedAt."""
    updated = F.try_to_timestamp("updatedAt")
    same = F.lower("htmlUrl") == F.lower(F.concat(F.lit(host), "fullName"))
    no = lambda c: ~F.coalesce(c, F.lit(False))
    return (
        F.when(F.col("id").isNull(), "no id").when(no(F.col("fullName").rlike("^[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+$")), "name").when(no(same), "address")
        .when(F.coalesce("owner", F.lit("")) == "", "owner").when(updated.isNull(), "time").when(updated < now - F.make_dt_interval(F.lit(days)), "old").otherwise("kept")
    )
