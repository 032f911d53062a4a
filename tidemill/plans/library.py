"""Queries over the library catalog and repositories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import text
from tidemill.operators import keyed, library, timestamps
from tidemill.plans.book import query, table

_STATE_SQL = """CASE WHEN sync IS NULL OR sync.state IS NULL THEN 'pending'
  WHEN sync.state = 'synced' AND coalesce(sync.pushed, true) = false AND (coalesce(sync.pushFailed, false) OR sync.error IS NOT NULL) THEN 'failed'
  ELSE sync.state END"""
_DELIVERED_SQL = """coalesce(sync.state = 'synced' AND NOT coalesce(sync.pushFailed, false) AND NOT (NOT coalesce(sync.pushed, true) AND sync.error IS NOT NULL), false)"""
# the order of saves isn't in the table; updatedAt, then path, title and state tell versions apart
_LATEST_SQL = "latest AS (SELECT * FROM catalog QUALIFY row_number() OVER (PARTITION BY id ORDER BY updatedAt DESC, coalesce(relativePath, '') DESC, coalesce(title, '') DESC, coalesce(sync.at, '') DESC) = 1)"


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "catalog")


def latest(catalog: DataFrame) -> DataFrame:
    none = F.lit("")
    return keyed.latest_per_key(catalog, ["id"], F.col("updatedAt"), F.coalesce("relativePath", none), F.coalesce("title", none), F.coalesce("sync.at", none))


@query("catalog_upsert", f"""
WITH {_LATEST_SQL}, firsts AS (SELECT id, arg_min(relativePath, {{'a': updatedAt, 'b': coalesce(relativePath, '')}}) AS p FROM catalog GROUP BY id)
SELECT l.id, l.source, l.title, f.p AS relative_path, l.updatedAt AS updated_at FROM latest l JOIN firsts f USING (id)""")
def catalog_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest row of each id under the path it was first saved at."""
    c = _catalog(spark, sf_dir)
    firsts = c.groupBy("id").agg(F.min_by("relativePath", F.struct("updatedAt", F.coalesce("relativePath", F.lit("")))).alias("relative_path"))
    return latest(c).join(firsts, "id").select("id", "source", "title", "relative_path", F.col("updatedAt").alias("updated_at"))


@query("library_listing", f"WITH {_LATEST_SQL} SELECT id, title, coalesce(publishedAt, updatedAt) AS date, {_STATE_SQL} AS state FROM latest ORDER BY date DESC, id")
def library_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = library.listing(latest(_catalog(spark, sf_dir)))
    return rows.select("id", "title", library.entry_date(F.col("publishedAt"), F.col("updatedAt")).alias("date"), library.sync_state(F.col("sync")).alias("state"))


@query("pending_entries", f"WITH {_LATEST_SQL} SELECT id, source FROM latest WHERE NOT {_DELIVERED_SQL}")
def pending_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(_catalog(spark, sf_dir)).where(~library.delivered(F.col("sync"))).select("id", "source")


@query("states_by_source", f"""WITH {_LATEST_SQL} SELECT source, {_STATE_SQL} AS state, count(*) AS entries,
  bool_and(coalesce(sync.state = 'synced', false)) AS only_pushes_left FROM latest GROUP BY ALL""")
def states_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = latest(_catalog(spark, sf_dir)).withColumn("state", library.sync_state(F.col("sync")))
    return rows.groupBy("source", "state").agg(F.count("*").alias("entries"), F.every(F.coalesce(F.col("sync.state") == "synced", F.lit(False))).alias("only_pushes_left"))


@query("failures_by_reason", f"""
WITH {_LATEST_SQL} SELECT coalesce(sync.error, 'none given') AS reason, count(*) AS entries, min(id) AS first_id, arg_min(title, id) AS example
FROM latest WHERE {_STATE_SQL} = 'failed' GROUP BY ALL""")
def failures_by_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = latest(_catalog(spark, sf_dir)).where(library.sync_state(F.col("sync")) == "failed")
    return rows.groupBy(F.coalesce("sync.error", F.lit("none given")).alias("reason")).agg(
        F.count("*").alias("entries"), F.min("id").alias("first_id"), F.min_by("title", "id").alias("example")
    )


_CLASS_SQL = " ".join("WHEN regexp_matches(e, '{}') THEN '{}'".format(p.replace("'", "''"), c) for p, c in library.FAILURES)


@query("failure_classes", f"SELECT CASE {_CLASS_SQL} ELSE 'other' END AS class, count(*) AS rows FROM (SELECT sync.error AS e FROM catalog) WHERE e IS NOT NULL GROUP BY ALL")
def failure_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delivery errors by an ordered ladder of patterns."""
    errors = _catalog(spark, sf_dir).select(F.col("sync.error").alias("e")).where("e is not null")
    return errors.groupBy(text.first_match(F.col("e"), library.FAILURES, "other").alias("class")).agg(F.count("*").alias("rows"))


_ROUTES = {"wechat": ["repo-a", "markdown", "repo-a"], "zsxq": ["gone"], "nowcoder": ["repo-b"], "github": []}


@query("routes", """
SELECT * FROM (VALUES ('wechat', 'repo-a,markdown', 'repo-a'), ('zsxq', 'markdown', NULL), ('nowcoder', 'repo-b', 'repo-b'), ('github', 'markdown', NULL)) AS t(source, sinks, target)""")
def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sinks of each source after unknown and repeated ones are dropped."""
    r = library.routes(spark, _ROUTES, ["markdown", "repo-a", "repo-b"])
    return r.select("source", F.array_join("sinks", ",").alias("sinks"), "target")


@query("sync_outcomes", f"""
WITH {_LATEST_SQL}, chosen AS (SELECT * FROM latest WHERE NOT {_DELIVERED_SQL}),
t AS (SELECT * FROM (VALUES ('wechat', 'repo-a'), ('zsxq', NULL), ('nowcoder', 'repo-b'), ('github', NULL)) AS t(source, target)),
r AS (SELECT c.id, c.source, t.target, coalesce(sync.state = 'synced', false) AND coalesce(sync.committed, true) AND coalesce(NOT sync.pushFailed, true) AS ok, sync.error AS error FROM chosen c LEFT JOIN t USING (source))
SELECT id, source, target, CASE WHEN target IS NULL OR NOT ok THEN 'failed' ELSE 'synced' END AS state,
  CASE WHEN target IS NULL THEN 'no target for this source' WHEN NOT ok THEN coalesce(error, 'not delivered') END AS reason FROM r""")
def sync_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = latest(_catalog(spark, sf_dir)).where(~library.delivered(F.col("sync")))
    results = rows.select("id", (F.col("sync.state") == "synced").alias("ok"), F.col("sync.committed").alias("committed"), (~F.col("sync.pushFailed")).alias("pushed"), F.col("sync.error").alias("error"))
    targets = library.routes(spark, _ROUTES, ["markdown", "repo-a", "repo-b"]).select("source", "target")
    return library.outcomes(rows.select("id", "source"), results, F.broadcast(targets))  # one row per source


@query("selected_entries", """
SELECT DISTINCT c.id, c.title FROM catalog c WHERE c.id IN (SELECT substr(sha256(canonicalUrl), 1, 12) FROM collected_documents WHERE truncated)""")
def selected_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries whose capture is flagged as truncated."""
    ids = table(spark, sf_dir, "collected_documents").where("truncated").select(F.substring(F.sha2("canonicalUrl", 256), 1, 12).alias("id"))
    return keyed.selected(_catalog(spark, sf_dir).select("id", "title"), ids, "id").distinct()


@query("entry_bodies", """
SELECT c.id, substring(d.text, 1, 500) AS body, length(d.text) > 500 AS cut FROM (SELECT DISTINCT id, url FROM catalog) c
JOIN (SELECT canonicalUrl, arg_max(text, seq) AS text FROM collected_documents WHERE text IS NOT NULL GROUP BY canonicalUrl) d ON d.canonicalUrl = c.url""")
def entry_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest body of each entry for a reading view, with a flag where the view cuts it."""
    docs = table(spark, sf_dir, "collected_documents").where("text is not null").groupBy(F.col("canonicalUrl").alias("url")).agg(F.max_by("text", "seq").alias("text"))
    c = _catalog(spark, sf_dir).select("id", "url").distinct()
    return c.join(docs, "url").select("id", F.substring("text", 1, 500).alias("body"), (F.length("text") > 500).alias("cut"))


@query("catalog_residue", """
WITH f AS (SELECT relativePath AS path FROM catalog WHERE source <> 'zsxq' UNION SELECT relativePath || '.tmp' FROM catalog WHERE source = 'github' UNION SELECT 'loose/' || id || '/index.md' FROM catalog WHERE source = 'wechat'),
real AS (SELECT path FROM f WHERE NOT path LIKE '%.tmp'), k AS (SELECT DISTINCT regexp_replace(relativePath, '/[^/]*$', '') AS folder FROM catalog)
SELECT 'orphan' AS kind, path FROM real WHERE regexp_replace(path, '/[^/]*$', '') NOT IN (SELECT folder FROM k WHERE folder IS NOT NULL)
UNION ALL SELECT DISTINCT 'zombie', relativePath FROM catalog WHERE relativePath NOT IN (SELECT path FROM real)
UNION ALL SELECT 'temporary', path FROM f WHERE path LIKE '%.tmp'""")
def catalog_residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans, zombies and leftovers against a listing derived from the catalog itself."""
    c = _catalog(spark, sf_dir)
    files = (
        c.where("source <> 'zsxq'").select(F.col("relativePath").alias("path"))
        .union(c.where("source = 'github'").select(F.concat("relativePath", F.lit(".tmp"))))
        .union(c.where("source = 'wechat'").select(F.concat(F.lit("loose/"), "id", F.lit("/index.md")))).distinct()
    )
    return library.residue(c, files)


@query("entry_slugs", r"""
SELECT DISTINCT title, CASE WHEN s = '' THEN 'untitled' ELSE s END AS slug FROM (
  SELECT title, regexp_replace(substring(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    regexp_replace(title, '[\x00-\x1f\x7f]', '', 'g'), '[\\/?%*:|"<>]', ' ', 'g'), '\.{2,}', ' ', 'g'), '^\.+', ''), '\.+$', ''), '[\s_-]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60), '-+$', '') AS s
  FROM catalog WHERE title IS NOT NULL)""")
def entry_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _catalog(spark, sf_dir).where("title is not null").select("title").distinct().select("title", text.slug(F.col("title")).alias("slug"))


_HEAD = ("id", "source", "title", "url", "category", "publishedAt", "updatedAt")
_HEAD_SQL = ", ".join(f"CASE WHEN {n} IS NOT NULL THEN '{n}: ' || to_json({n})::VARCHAR END" for n in _HEAD)


@query("front_matter", f"""
WITH {_LATEST_SQL} SELECT id, '---' || chr(10) || array_to_string(list_filter([{_HEAD_SQL}], lambda x: x IS NOT NULL), chr(10)) || chr(10) || '---' || chr(10) AS head FROM latest""")
def front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heads of the files that the store writes."""
    fields = [(n, F.col(n)) for n in _HEAD]
    return latest(_catalog(spark, sf_dir)).select("id", library.front_matter(fields).alias("head"))


def _repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "github_repositories")


@query("repositories_first_seen", """
SELECT id, fullName AS full_name, query, stars FROM github_repositories QUALIFY row_number() OVER (PARTITION BY id ORDER BY query_ord, seq) = 1""")
def repositories_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each repository as the first query that found it saw it."""
    slim = _repos(spark, sf_dir).select("id", F.col("fullName").alias("full_name"), "query", "stars", "query_ord", "seq")
    return keyed.first_per_key(slim, ["id"], F.col("query_ord"), F.col("seq")).select("id", "full_name", "query", "stars")


@query("repository_projection", """
SELECT seq, fullName AS full_name, coalesce(stars, 0) AS stars, coalesce(forks, 0) AS forks, coalesce(defaultBranch, 'main') AS branch,
  CASE WHEN license = 'NOASSERTION' THEN NULL ELSE license END AS license,
  regexp_matches(fullName, '^[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+$') AND lower(htmlUrl) = lower('https://github.example/' || fullName) AS consistent
FROM github_repositories""")
def repository_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    same = F.lower("htmlUrl") == F.lower(F.concat(F.lit("https://github.example/"), "fullName"))
    return _repos(spark, sf_dir).select(
        "seq", F.col("fullName").alias("full_name"), F.coalesce("stars", F.lit(0)).alias("stars"), F.coalesce("forks", F.lit(0)).alias("forks"),
        F.coalesce("defaultBranch", F.lit("main")).alias("branch"), F.when(F.col("license") != "NOASSERTION", F.col("license")).alias("license"),
        (F.col("fullName").rlike("^[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+$") & same).alias("consistent"),
    )


@query("repository_topics", """
SELECT topic, count(*) AS rows, count(DISTINCT id) AS repositories FROM (SELECT id, unnest(string_split(topics, ',')) AS topic FROM github_repositories) WHERE topic <> '' GROUP BY topic""")
def repository_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = _repos(spark, sf_dir).select("id", F.explode(F.split("topics", ",")).alias("topic")).where("topic <> ''")
    return each.groupBy("topic").agg(F.count("*").alias("rows"), F.countDistinct("id").alias("repositories"))


@query("repository_drift", """
SELECT id, count(*) AS sightings, max(stars) - min(stars) AS star_spread, arg_max(stars, seq) AS last_stars FROM github_repositories GROUP BY id HAVING count(*) > 1""")
def repository_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _repos(spark, sf_dir).groupBy("id").agg(F.count("*").alias("sightings"), (F.max("stars") - F.min("stars")).alias("star_spread"), F.max_by("stars", "seq").alias("last_stars"))
    return g.where("sightings > 1")


@query("first_new_repositories", """
WITH f AS (SELECT id, arg_min(seq, {'a': query_ord, 'b': seq}) AS seq, min({'a': query_ord, 'b': seq}) AS o FROM github_repositories GROUP BY id)
SELECT id, seq FROM f ORDER BY o LIMIT 12""")
def first_new_repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twelve distinct repositories in discovery order (a top-k)."""
    f = _repos(spark, sf_dir).groupBy("id").agg(F.min(F.struct("query_ord", "seq")).alias("o"))
    return f.orderBy("o").limit(12).select("id", "o.seq")


@query("inbox_paths")
def inbox_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folder of each entry in a repository's inbox, by publication or else collection date.

    An ISO date is taken as written; other forms are read by the timestamp operator, and give the day in the
    source's default zone. A value that denotes no instant counts as none.
    """
    iso = F.col("publishedAt").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}T")
    shift = timestamps.source_minutes(F.col("source"))
    raw = F.when(~iso, F.col("publishedAt"))
    read = timestamps.utc_micros(raw, shift, F.unix_micros(F.try_to_timestamp("updatedAt")), timestamps.source_yearless(F.col("source")))
    minutes = F.floor(F.col("us") / 60_000_000) + shift
    written = F.date_from_unix_date(F.floor(minutes / 1440).cast("int")).cast("string")
    rows = latest(_catalog(spark, sf_dir)).select("id", "source", "publishedAt", "updatedAt", read.alias("us"))
    published = F.when(iso, F.substring("publishedAt", 1, 10)).otherwise(written)
    day = library.entry_date(published, F.substring("updatedAt", 1, 10))
    return rows.select("id", F.concat("source", F.lit("/"), day, F.lit("-"), "id").alias("folder"), F.when(published.isNull(), "collected").otherwise("published").alias("date_source"))