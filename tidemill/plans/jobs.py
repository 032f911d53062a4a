"""Queries over job events and candidate entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.finger import as_long
from tidemill.operators import cluster, jobs, keyed
from tidemill.plans.book import query, table
from tidemill.session import cut


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "job_events")


_OK_SQL = "CASE WHEN s.state IS NULL THEN e.event = 'queued' " + " ".join(
    f"WHEN s.state = '{s}' THEN e.event IN ({', '.join(repr(t) for t in to)})" if to else f"WHEN s.state = '{s}' THEN false" for s, to in jobs.STEPS.items()
) + " ELSE false END"


@query("job_states", f"""
WITH RECURSIVE e AS (SELECT job_id, event, row_number() OVER (PARTITION BY job_id ORDER BY seq) AS n FROM job_events),
s(job_id, n, state, illegal) AS (
  SELECT DISTINCT job_id, 0::BIGINT, NULL::VARCHAR, 0::BIGINT FROM job_events
  UNION ALL
  SELECT s.job_id, e.n, CASE WHEN {_OK_SQL} THEN e.event ELSE s.state END, s.illegal + CASE WHEN {_OK_SQL} THEN 0 ELSE 1 END
  FROM s JOIN e ON e.job_id = s.job_id AND e.n = s.n + 1)
SELECT job_id, arg_max(state, n) AS state, max(n) AS events, max(illegal) AS illegal FROM (SELECT job_id, n, coalesce(state, '') AS state, illegal FROM s) GROUP BY job_id""")
def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final state of each job, illegal events counted and ignored."""
    return jobs.fold(_events(spark, sf_dir)).withColumn("state", F.coalesce("state", F.lit("")))


@query("jobs_by_state", """
SELECT event AS last_event, count(*) AS jobs FROM (SELECT job_id, arg_max(event, seq) AS event FROM job_events GROUP BY job_id) GROUP BY event""")
def jobs_by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = _events(spark, sf_dir).groupBy("job_id").agg(F.max_by("event", "seq").alias("last_event"))
    return last.groupBy("last_event").agg(F.count("*").alias("jobs"))


@query("job_conflicts", """
SELECT job_id, count(DISTINCT url) AS urls, min(url) AS first_url FROM job_events WHERE url IS NOT NULL GROUP BY job_id HAVING count(DISTINCT url) > 1""")
def job_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs whose events name different addresses."""
    g = _events(spark, sf_dir).where("url is not null").groupBy("job_id").agg(F.countDistinct("url").alias("urls"), F.min("url").alias("first_url"))
    return g.where("urls > 1")


@query("job_durations", "SELECT job_id, min(ts) AS first_ts, max(ts) AS last_ts, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS seconds FROM job_events GROUP BY job_id")
def job_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.durations(_events(spark, sf_dir))


@query("stalled_jobs", """
SELECT job_id, seq, event, next_event, gap FROM (
  SELECT job_id, seq, event, lead(event) OVER w AS next_event, (epoch_us(lead(ts) OVER w) - epoch_us(ts)) / 1e6 AS gap FROM job_events WINDOW w AS (PARTITION BY job_id ORDER BY seq)) WHERE gap >= 90""")
def stalled_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps that took a minute and a half or longer."""
    return jobs.gaps(_events(spark, sf_dir), 90).select("job_id", "seq", "event", "next_event", "gap")


@query("job_errors", """
SELECT error_code, count(*) AS events, count(DISTINCT job_id) AS jobs, count_if(needs_attention) AS attention, arg_min_null(error_message, seq) AS first_message
FROM job_events WHERE error_code IS NOT NULL GROUP BY error_code""")
def job_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).where("error_code is not null")
    return e.groupBy("error_code").agg(
        F.count("*").alias("events"), F.countDistinct("job_id").alias("jobs"), F.count_if("needs_attention").alias("attention"), F.min_by("error_message", "seq").alias("first_message")
    )


@query("repeated_events", """
SELECT job_id, event, count(*) AS times FROM job_events GROUP BY ALL HAVING count(*) > 1""")
def repeated_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).groupBy("job_id", "event").agg(F.count("*").alias("times")).where("times > 1")


@query("due_requesters", """
WITH l AS (SELECT requested_by AS source, max(ts) AS last_attempt, arg_max_null(error_code, seq) FILTER (WHERE event IN ('failed', 'saved')) AS last_error FROM job_events GROUP BY requested_by),
n AS (SELECT max(ts) AS now FROM job_events)
SELECT source, last_attempt, last_attempt + CASE WHEN last_error IS NOT NULL THEN INTERVAL 1 HOUR ELSE INTERVAL 24 HOUR END AS next_due,
  last_attempt + CASE WHEN last_error IS NOT NULL THEN INTERVAL 1 HOUR ELSE INTERVAL 24 HOUR END <= now AS is_due FROM l, n""")
def due_requesters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Next run of each requester after its last event: a day, an hour after an error."""
    e = _events(spark, sf_dir)
    ended = F.col("event").isin("failed", "saved")
    state = e.groupBy(F.col("requested_by").alias("source")).agg(F.max("ts").alias("last_attempt"), F.max(F.when(ended, F.struct("seq", "error_code"))).alias("e"))
    state = state.select("source", "last_attempt", F.col("e.error_code").alias("last_error"))
    return jobs.due(state, e.agg(F.max("ts")).scalar(), F.lit(86_400), 3_600).select("source", "last_attempt", "next_due", "is_due")


@query("jobs_matched_to_captures", """
SELECT j.job_id, max(d.seq) AS seq FROM (SELECT DISTINCT job_id, url FROM job_events WHERE url IS NOT NULL) j JOIN collected_documents d ON d.canonicalUrl = j.url GROUP BY j.job_id""")
def jobs_matched_to_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs and the latest capture of their page."""
    j = _events(spark, sf_dir).where("url is not null").select("job_id", "url").distinct()
    d = table(spark, sf_dir, "collected_documents").select("seq", F.col("canonicalUrl").alias("url"))
    return j.join(d, "url").groupBy("job_id").agg(F.max("seq").alias("seq"))


@query("job_results_mismatched", """
SELECT j.job_id, j.url FROM (SELECT DISTINCT job_id, url FROM job_events WHERE event = 'saved' AND url IS NOT NULL) j
WHERE NOT EXISTS (SELECT 1 FROM collected_documents d WHERE d.canonicalUrl = j.url)""")
def job_results_mismatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved jobs whose address no capture has: the dead letters of result handling."""
    j = _events(spark, sf_dir).where("event = 'saved' and url is not null").select("job_id", "url").distinct()
    return keyed.without(j, table(spark, sf_dir, "collected_documents").select(F.col("canonicalUrl").alias("url")), "url")


NEAR = 12  # bits; the reference's radius of near duplicates


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sightings of candidates in order of arrival, with usable fingerprints."""
    ch = F.lower("contentHash")
    usable = F.coalesce(ch != "e3b0c44298fc1c14", F.lit(True))
    cols = ["seq", "id", F.when(usable, ch).alias("ch"), F.when(usable, as_long(F.col("simHash"))).alias("fp")]
    return table(spark, sf_dir, "candidate_entries").select(*cols).unionByName(table(spark, sf_dir, "candidate_batches").select(*cols))


_ENTRIES_SQL = f"""v AS (
  SELECT seq, id, CASE WHEN u THEN lower(contentHash) END AS ch, CASE WHEN u AND regexp_matches(lower(simHash), '^[0-9a-f]{{16}}$') THEN ('0x' || lower(simHash))::UBIGINT END AS fp,
    lead(seq) OVER (PARTITION BY id ORDER BY seq) AS until, row_number() OVER (PARTITION BY id ORDER BY seq) AS n FROM (
    SELECT seq, id, contentHash, simHash, coalesce(lower(contentHash) <> 'e3b0c44298fc1c14', true) AS u FROM (
      SELECT seq, id, contentHash, simHash FROM candidate_entries UNION ALL SELECT seq, id, contentHash, simHash FROM candidate_batches))),
e AS (SELECT * FROM v WHERE n = 1),
x AS (SELECT a.id, min(b.id) AS parent FROM e a JOIN v b ON a.ch = b.ch AND b.seq < a.seq AND (b.until IS NULL OR a.seq < b.until) AND a.id <> b.id GROUP BY a.id),
n AS (SELECT a.id, min({{'d': bit_count(xor(a.fp, b.fp))::INT, 'id': b.id}}) AS m FROM e a JOIN v b ON b.seq < a.seq AND (b.until IS NULL OR a.seq < b.until) AND a.id <> b.id AND bit_count(xor(a.fp, b.fp)) <= {NEAR}
  WHERE a.id NOT IN (SELECT id FROM x) GROUP BY a.id),
p AS (SELECT id, parent, 'exact' AS kind, 0 AS distance FROM x UNION ALL SELECT id, m.id, 'near', m.d FROM n)"""


@query("candidate_parents", f"WITH {_ENTRIES_SQL} SELECT id, parent, kind, distance FROM p")
def candidate_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earlier entry that each candidate follows: equal content first, else the nearest within twelve bits."""
    return cluster.parents(cut(_entries(spark, sf_dir)), NEAR).select("id", "parent", "kind", "distance")


@query("candidate_clusters", f"""
WITH RECURSIVE {_ENTRIES_SQL}, r(id, root) AS (SELECT id, id FROM e WHERE id NOT IN (SELECT id FROM p) UNION ALL SELECT p.id, r.root FROM p JOIN r ON p.parent = r.id)
SELECT root, count(*) AS members FROM r GROUP BY root HAVING count(*) > 1""")
def candidate_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters founded by their first member; later links never merge two of them."""
    links = cluster.parents(cut(_entries(spark, sf_dir)), NEAR).select("id", "parent")
    members = cluster.roots(links)
    return members.groupBy("root").agg((F.count("*") + 1).alias("members"))


@query("run_reports", """
WITH l AS (SELECT job_id, arg_max(event, seq) AS state, arg_max_null(requested_by, seq) AS requester, arg_min(error_message, seq) AS error FROM job_events GROUP BY job_id)
SELECT requester, count(*) AS jobs, count_if(state = 'saved') AS saved, count_if(state = 'failed') AS failed,
  CASE WHEN count_if(state = 'saved') = 0 AND count_if(state = 'failed') > 0 THEN 'failed' WHEN count_if(state NOT IN ('saved', 'failed', 'needs_attention')) > 0 THEN 'running' ELSE 'completed' END AS phase,
  arg_min(error, job_id) FILTER (WHERE state = 'failed') AS first_error FROM l GROUP BY requester""")
def run_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome of each requester's jobs: counts, phase, first error among the failed."""
    e = _events(spark, sf_dir)
    last = e.groupBy("job_id").agg(
        F.max_by("event", "seq").alias("state"), F.max_by("requested_by", "seq").alias("requester"),
        F.min(F.when(F.col("error_message").isNotNull(), F.struct("seq", "error_message"))).alias("e"),
    )
    saved, failed = F.count_if(F.col("state") == "saved"), F.count_if(F.col("state") == "failed")
    first = F.min(F.when((F.col("state") == "failed") & F.col("e").isNotNull(), F.struct("job_id", F.col("e.error_message").alias("m"))))
    g = last.groupBy("requester").agg(
        F.count("*").alias("jobs"), saved.alias("saved"), failed.alias("failed"), F.count_if(~F.col("state").isin("saved", "failed", "needs_attention")).alias("open"), first.alias("f")
    )
    phase = F.when((F.col("saved") == 0) & (F.col("failed") > 0), "failed").when(F.col("open") > 0, "running").otherwise("completed")
    return g.select("requester", "jobs", "saved", "failed", phase.alias("phase"), F.col("f.m").alias("first_error"))
