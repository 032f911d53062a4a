"""Queries that keep library, jobs and sources in order: deletion, recovery, phases, records, enrichment, text index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import urls
from tidemill.functions.text import match_key
from tidemill.operators import jobs, keyed, library, match
from tidemill.plans.book import SQL, query, table
from tidemill.plans.pages import _KEY_SQL


@query("deleted_entries", r"""
WITH ids AS (SELECT DISTINCT substr(sha256(canonicalUrl), 1, 12) AS id FROM collected_documents WHERE truncated),
c AS (SELECT source, id IN (SELECT id FROM ids) AS chosen, relativePath IS NULL OR relativePath = '' OR starts_with(relativePath, '/') OR regexp_matches(relativePath, '(^|/)[.][.](/|$)') AS outside FROM catalog)
SELECT source, count_if(chosen AND NOT outside) AS deleted, count_if(chosen AND outside) AS missing, count_if(NOT chosen) AS remaining FROM c GROUP BY source""")
def deleted_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What deleting the entries of truncated captures comes to, by source."""
    catalog = table(spark, sf_dir, "catalog")
    ids = table(spark, sf_dir, "collected_documents").where("truncated").select(F.substring(F.sha2("canonicalUrl", 256), 1, 12).alias("id"))
    rest, gone = library.deleted(catalog, ids)
    both = gone.select("source", "outcome").unionByName(rest.select("source", F.lit("remaining").alias("outcome")))
    return both.groupBy("source").agg(*(F.count_if(F.col("outcome") == o).alias(o) for o in ("deleted", "missing", "remaining")))


@query("recovered_jobs", f"""
SELECT job_id, CASE WHEN state IN ('dispatched', 'collecting') THEN 'queued' ELSE state END AS state, state IN ('dispatched', 'collecting') AS recovered FROM ({SQL['job_states']})""")
def recovered_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States after a restart: what was under way is queued again."""
    states = jobs.fold(table(spark, sf_dir, "job_events")).withColumn("state", F.coalesce("state", F.lit("")))
    return jobs.recovered(states).select("job_id", "state", "recovered")


@query("round_phases", """
WITH l AS (SELECT job_id, arg_max(event, seq) AS state, arg_max_null(requested_by, seq) AS requester, count(DISTINCT ts::DATE) AS days FROM job_events GROUP BY job_id),
c AS (SELECT requester, count(*) AS found, count_if(state = 'saved') AS collected, count_if(state = 'failed') AS failed, count_if(state = 'needs_attention') AS skipped, max(days) AS rounds FROM l GROUP BY requester)
SELECT requester, found, collected, failed, skipped, CASE WHEN found = 0 THEN 'empty' WHEN collected = 0 AND failed > 0 THEN 'failed' WHEN collected = 0 AND skipped > 0 THEN 'skipped_all'
  WHEN rounds >= 1 AND collected >= 60 THEN 'capped' ELSE 'done' END AS phase FROM c""")
def round_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each requester's rounds ended, from its counts."""
    e = table(spark, sf_dir, "job_events")
    last = e.groupBy("job_id").agg(F.max_by("event", "seq").alias("state"), F.max_by("requested_by", "seq").alias("requester"), F.countDistinct(F.to_date("ts")).alias("days"))
    of = lambda s: F.count_if(F.col("state") == s)
    c = last.groupBy("requester").agg(F.count("*").alias("found"), of("saved").alias("collected"), of("failed").alias("failed"), of("needs_attention").alias("skipped"), F.max("days").alias("rounds"))
    phase = jobs.phase(F.col("found"), F.col("collected"), F.col("failed"), F.col("skipped"), F.col("rounds"), most_rounds=1, most_items=60)
    return c.select("requester", "found", "collected", "failed", "skipped", phase.alias("phase"))


@query("source_records", """
WITH l AS (SELECT requested_by AS source, max({'s': seq, 'ts': ts, 'e': error_message, 'f': event = 'failed'}) AS l FROM job_events WHERE event IN ('saved', 'failed') GROUP BY requested_by)
SELECT source, l.ts AS last_attempt, CASE WHEN NOT l.f THEN l.ts END AS last_success, CASE WHEN l.f THEN coalesce(l.e, 'failed') END AS last_error FROM l""")
def source_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record of each source after its last run: a success clears the error, a failure drops the last success."""
    e = table(spark, sf_dir, "job_events").where(F.col("event").isin("saved", "failed"))
    error = F.when(F.col("event") == "failed", F.coalesce("error_message", F.lit("failed")))
    return jobs.records(e.select(F.col("requested_by").alias("source"), "seq", F.col("ts").alias("at"), error.alias("error")))


@query("repository_rejections", """
WITH n AS (SELECT max(try_cast(updatedAt AS TIMESTAMP)) AS now FROM github_repositories)
SELECT reason, count(*) AS rows FROM (SELECT CASE WHEN id IS NULL THEN 'no id' WHEN NOT coalesce(regexp_matches(fullName, '^[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+$'), false) THEN 'name'
  WHEN NOT coalesce(lower(htmlUrl) = lower('https://github.example/' || fullName), false) THEN 'address' WHEN coalesce(owner, '') = '' THEN 'owner'
  WHEN try_cast(updatedAt AS TIMESTAMP) IS NULL THEN 'time' WHEN try_cast(updatedAt AS TIMESTAMP) < now - INTERVAL 365 DAY THEN 'old' ELSE 'kept' END AS reason FROM github_repositories, n) GROUP BY reason""")
def repository_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why found repositories are dropped; the first reason counts."""
    r = table(spark, sf_dir, "github_repositories")
    now = r.agg(F.max(F.try_to_timestamp("updatedAt"))).scalar()
    return r.select(library.repository_reason(now).alias("reason")).groupBy("reason").agg(F.count("*").alias("rows"))


@query("enriched_texts", r"""
WITH d AS (SELECT seq, text, canonicalUrl, regexp_extract(text, 'https?://[A-Za-z0-9._~:/?#@!$&*+;=%-]+[A-Za-z0-9/_-]') AS link FROM collected_documents WHERE text IS NOT NULL),
a AS (SELECT canonicalUrl AS link, arg_max(text, seq) AS article FROM collected_documents WHERE text IS NOT NULL GROUP BY canonicalUrl)
SELECT d.seq, d.link, length(CASE WHEN length(article) > length(text) THEN text || chr(10) || chr(10) || article ELSE text END) AS chars, article IS NULL AS truncated FROM d LEFT JOIN a USING (link) WHERE d.link <> ''""")
def enriched_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that link to an article, with its text where it was captured and is the longer one."""
    docs = table(spark, sf_dir, "collected_documents").where("text is not null")
    linking = docs.select("seq", "text", F.try_element_at(urls.text_links(F.col("text")), F.lit(1)).alias("link")).where("link is not null")
    articles = docs.groupBy(F.col("canonicalUrl").alias("link")).agg(F.max_by("text", "seq").alias("article"))
    return match.enriched(linking, articles).select("seq", "link", F.length("text").alias("chars"), "truncated")


@query("text_index", f"""
WITH d AS (SELECT seq, regexp_extract(canonicalUrl, '/topic/([0-9]+)', 1) AS topic_id, text, title FROM collected_documents WHERE source = 'zsxq'),
k AS (SELECT substring({_KEY_SQL}, 1, 24) AS key, topic_id, seq, 1 AS whole FROM d WHERE text IS NOT NULL AND topic_id <> ''
  UNION ALL SELECT substring({_KEY_SQL.replace('replace(text,', 'replace(title,')}, 1, 24), topic_id, seq, 0 FROM d WHERE title IS NOT NULL AND topic_id <> '')
SELECT key, arg_max(topic_id, {{'w': whole, 's': seq}}) AS topic_id, max(whole) = 1 AS whole FROM k WHERE key <> '' GROUP BY key""")
def text_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids by text key: the last writer of a key wins, and a key of a part never replaces one of a whole text."""
    d = table(spark, sf_dir, "collected_documents").where("source = 'zsxq'").select("seq", F.regexp_extract("canonicalUrl", r"/topic/(\d+)", 1).alias("topic_id"), "text", "title").where("topic_id <> ''")
    whole = d.where("text is not null").select(match_key(F.col("text")).alias("key"), "topic_id", "seq")
    part = d.where("title is not null").select(match_key(F.col("title")).alias("key"), "topic_id", "seq")
    return match.text_index(whole, part)


@query("unique_captures_limit", """
WITH d AS (SELECT seq, truncated IS TRUE AS counted FROM collected_documents), n AS (SELECT seq FROM d WHERE counted ORDER BY seq LIMIT 20)
SELECT seq FROM d WHERE seq <= CASE WHEN (SELECT count(*) FROM n) < 20 THEN (SELECT max(seq) FROM d) ELSE (SELECT max(seq) FROM n) END""")
def unique_captures_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures in order until twenty flagged ones were met (the early stop of a round is the feature)."""
    d = table(spark, sf_dir, "collected_documents").select("seq", F.coalesce("truncated", F.lit(False)).alias("counted"))
    return keyed.running_limit(d, ["seq"], "counted", 20).select("seq")
