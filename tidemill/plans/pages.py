"""Queries over HTML and partial texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import html, urls
from tidemill.operators import match
from tidemill.plans.book import query, table


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "collected_documents").where("html <> ''").select("seq", "source", "url", "html", "text")


@query("page_extract")
def page_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, author, date and main text of each stored page, or why there is none."""
    return html.extracted(_pages(spark, sf_dir)).select("seq", "ok", "error", "title", "author", "published", "text", F.size("images").alias("images"))


@query("page_clean")
def page_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with allowed markup only, and as Markdown."""
    safe = _pages(spark, sf_dir).select("seq", html.sanitise_column("html", "url").alias("clean_html"))
    return safe.select("seq", "clean_html", html.markdown_column("clean_html").alias("markdown"))


@query("page_links", r"""
SELECT seq, unnest(list_transform(regexp_extract_all(html, 'href="([^"]*)"', 1), lambda u: replace(u, '&amp;', '&'))) AS href FROM collected_documents WHERE html <> ''""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("seq", F.explode(urls.links(F.col("html"))).alias("href"))


_KEY_SQL = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '<[^>]*>', ' ', 'g'), '[\t-\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]', '', 'g'), '[\x{200b}-\x{200f}\x{feff}]', '', 'g'), '[\x{3000}-\x{303f}\x{ff00}-\x{ff65}!-/:-@\[-`{-~]', '', 'g')"""


@query("question_matches", f"""
WITH d AS (SELECT seq, regexp_extract(canonicalUrl, '/topic/([0-9]+)', 1) AS topic_id, substring({_KEY_SQL}, 1, 2000) AS h FROM collected_documents WHERE source = 'zsxq' AND text IS NOT NULL),
q AS (SELECT seq, h FROM d WHERE h <> ''), r AS (SELECT DISTINCT topic_id, h FROM d WHERE h <> '' AND topic_id <> ''),
e AS (SELECT q.seq, min(r.topic_id) AS a, max(r.topic_id) AS b FROM q JOIN r ON substring(q.h, 1, 24) = substring(r.h, 1, 24) GROUP BY q.seq),
l AS (SELECT * FROM q WHERE seq NOT IN (SELECT seq FROM e)),
p AS (SELECT l.seq, min(r.topic_id) AS a, max(r.topic_id) AS b FROM l JOIN r ON (length(l.h) < 24 AND starts_with(substring(r.h, 1, 24), l.h)) OR (length(r.h) < 24 AND starts_with(substring(l.h, 1, 24), r.h)) GROUP BY l.seq),
m AS (SELECT * FROM l WHERE length(h) >= 24 AND seq NOT IN (SELECT seq FROM p)),
i AS (SELECT m.seq, min(r.topic_id) AS a, max(r.topic_id) AS b FROM m JOIN r ON length(r.h) >= 24 AND (contains(r.h, substring(m.h, 1, 240)) OR contains(m.h, substring(r.h, 1, 240))) GROUP BY m.seq)
SELECT seq, a AS topic_id, 'equal' AS stage FROM e WHERE a = b UNION ALL SELECT seq, a, 'prefix' FROM p WHERE a = b UNION ALL SELECT seq, a, 'inside' FROM i WHERE a = b""")
def question_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Community texts resolved to the page that alone holds them."""
    docs = table(spark, sf_dir, "collected_documents").where("source = 'zsxq' and text is not null")
    records = docs.select(F.regexp_extract("canonicalUrl", r"/topic/(\d+)", 1).alias("topic_id"), "text").where("topic_id <> ''")
    return match.resolve(docs.select("seq", "text"), records)


@query("text_key_matches", r"""
WITH d AS (SELECT seq, regexp_extract(canonicalUrl, '/topic/([0-9]+)', 1) AS topic_id,
  substring(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '<[^>]*>', ' ', 'g'), '[\t-\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]', '', 'g'), '[\x{200b}-\x{200f}\x{feff}]', '', 'g'), '[\x{3000}-\x{303f}\x{ff00}-\x{ff65}!-/:-@\[-`{-~]', '', 'g'), 1, 24) AS key
  FROM collected_documents WHERE source = 'zsxq' AND text IS NOT NULL)
SELECT q.seq, min(r.topic_id) AS topic_id FROM d q JOIN d r ON q.key = r.key WHERE q.key <> '' AND r.topic_id <> '' GROUP BY q.seq HAVING count(DISTINCT r.topic_id) = 1""")
def text_key_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first stage of matching: equal keys, one id."""
    docs = table(spark, sf_dir, "collected_documents").where("source = 'zsxq' and text is not null")
    records = docs.select(F.regexp_extract("canonicalUrl", r"/topic/(\d+)", 1).alias("topic_id"), "text").where("topic_id <> ''")
    return match.resolve(docs.select("seq", "text"), records).where("stage = 'equal'").select("seq", "topic_id")


@query("closest_texts")
def closest_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every row whose seq 50 divides, the five texts of its source with the longest common run."""
    docs = table(spark, sf_dir, "collected_documents").where("source = 'zsxq' and text is not null")
    return match.closest(docs.where("seq % 50 = 0").select("seq", "text"), docs.select(F.col("seq").cast("string").alias("topic_id"), "text"))
