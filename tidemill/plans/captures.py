"""Queries over captured documents: identity, versions, validation, text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.functions import finger, text, urls
from tidemill.operators import keyed, organize
from tidemill.plans.book import query, table

_SITE_SQL = """
  CASE WHEN NOT lower(url) LIKE 'https://%' THEN NULL
       WHEN h = 'mp.wechat.example' THEN 'wechat'
       WHEN h IN ('wx.zsxq.example', 'zsxq.example') OR h LIKE '%.wx.zsxq.example' OR h LIKE '%.zsxq.example' THEN 'zsxq'
       WHEN h = 'nowcoder.example' OR h LIKE '%.nowcoder.example' THEN 'nowcoder'
       WHEN h = 'github.example' THEN 'github' END
"""
_CANON_SQL = f"""
hosts AS (SELECT *, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS h FROM collected_documents),
sited AS (SELECT *, {_SITE_SQL} AS site, split_part(url, '#', 1) AS bare FROM hosts),
parts AS (
  SELECT *, lower(regexp_extract(bare, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme,
    regexp_extract(bare, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*(/[^?]*)?', 1) AS p,
    list_sort(list_filter(string_split(regexp_extract(bare, '[?](.*)$', 1), '&'), lambda x: list_contains(CASE site
      WHEN 'wechat' THEN ['__biz', 'mid', 'idx', 'sn', 'chksm']
      WHEN 'zsxq' THEN ['topic_id', 'group_id', 'article_id', 'question_id', 'answer_id'] ELSE [] END, split_part(x, '=', 1)))) AS kept
  FROM sited),
canon AS (
  SELECT *, scheme || '://' || h || CASE WHEN p IN ('', '/') THEN '/' ELSE regexp_replace(p, '/+$', '') END
    || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS canonical
  FROM parts WHERE site IS NOT NULL)
"""


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "collected_documents")


def canonical_docs(docs: DataFrame) -> DataFrame:
    """Supported captures with ``site``, ``canonical`` and ``id``."""
    sited = docs.withColumn("site", urls.site_of(F.col("url"))).where("site is not null")
    sited = sited.withColumn("canonical", urls.canonical(F.col("url"), site=F.col("site")))
    return sited.withColumn("id", urls.content_id(F.col("canonical")))


@query("canonical_captures", f"WITH {_CANON_SQL} SELECT seq, site, canonical, substr(sha256(canonical), 1, 12) AS id FROM canon")
def canonical_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical_docs(_docs(spark, sf_dir)).select("seq", "site", "canonical", "id")


@query("captures_by_host", f"""
WITH {_CANON_SQL}, firsts AS (SELECT canonical, arg_min(h, seq) AS host FROM canon GROUP BY canonical)
SELECT host, count(*) AS pages FROM firsts GROUP BY host""")
def captures_by_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: captures to canonical pages, one per page, counted by host."""
    firsts = keyed.first_per_key(canonical_docs(_docs(spark, sf_dir)).select("canonical", "seq", urls.host(F.col("url")).alias("host")), ["canonical"], F.col("seq"))
    return firsts.groupBy("host").agg(F.count("*").alias("pages"))


@query("unsupported_urls", f"""
WITH hosts AS (SELECT seq, url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS h FROM collected_documents)
SELECT seq, url FROM hosts WHERE ({_SITE_SQL}) IS NULL""")
def unsupported_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).where(urls.site_of(F.col("url")).isNull()).select("seq", "url")


@query("latest_captures", """
SELECT canonicalUrl AS canonical_url, seq, title, source FROM collected_documents
QUALIFY row_number() OVER (PARTITION BY canonicalUrl ORDER BY seq DESC) = 1""")
def latest_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest version of each page by arrival."""
    slim = _docs(spark, sf_dir).select(F.col("canonicalUrl").alias("canonical_url"), "seq", "title", "source")
    return keyed.latest_per_key(slim, ["canonical_url"], F.col("seq"))


@query("first_captures", """
SELECT canonicalUrl AS canonical_url, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS versions,
       count(DISTINCT text) AS texts FROM collected_documents GROUP BY canonicalUrl""")
def first_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = _docs(spark, sf_dir).select(F.col("canonicalUrl").alias("canonical_url"), "seq", F.sha2("text", 256).alias("h"))
    return hashed.groupBy("canonical_url").agg(
        F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("versions"), F.countDistinct("h").alias("texts")
    )


@query("late_arrivals", """
WITH m AS (SELECT seq, source, collectedAt, max(collectedAt) OVER (PARTITION BY source ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
           FROM collected_documents)
SELECT source, count(*) AS late_rows FROM m WHERE collectedAt < before GROUP BY source""")
def late_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows collected before a row that arrived earlier. The running maximum is taken in arrival blocks, so no source is one task."""
    slim = _docs(spark, sf_dir).select("source", "seq", "collectedAt").withColumn("block", F.floor(F.col("seq") / 65536))
    tops = slim.groupBy("source", "block").agg(F.max("collectedAt").alias("top"))
    before = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.withColumn("top_before", F.max("top").over(before)).select("source", "block", "top_before")
    inside = Window.partitionBy("source", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    m = slim.join(tops, ["source", "block"]).withColumn("before", F.greatest(F.max("collectedAt").over(inside), F.col("top_before")))
    return m.where(F.col("collectedAt") < F.col("before")).groupBy("source").agg(F.count("*").alias("late_rows"))


def document_rules() -> list:
    """(path, message, holds) of the document schema and its cross-field refinements."""
    size = lambda c: F.length(F.trim(c))
    optional = lambda c, most: F.col(c).isNull() | (size(c) <= most)
    site = urls.site_of(F.col("url"))
    iso = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?Z$"
    return [
        ("source", "unknown source", F.col("source").isin("wechat", "zsxq", "nowcoder", "github")),
        ("kind", "unknown kind", F.col("kind").isin("article", "post", "question", "answer")),
        ("url", "not an address", F.length("url") <= 4096),
        ("title", "must have 1 to 500 characters", size("title").between(1, 500)),
        ("author", "too long", optional("author", 200)),
        ("publishedAt", "not an ISO time in UTC", F.col("publishedAt").isNull() | F.col("publishedAt").rlike(iso)),
        ("collectedAt", "not an ISO time in UTC", F.col("collectedAt").rlike(iso)),
        ("images", "more than 30", F.col("images").isNull() | (F.size("images") <= 30)),
        ("suggestedTags", "more than 20", F.col("suggestedTags").isNull() | (F.size("suggestedTags") <= 20)),
        ("source", "does not fit the address", site == F.col("source")),
        ("canonicalUrl", "is not the canonical address", F.col("canonicalUrl") == urls.canonical(F.col("url"), site=site)),
        ("schemaVersion", "must be 1", F.col("schemaVersion") == 1),
        ("html", "missing or too long", F.length("html") <= 10_000_000),
        ("text", "missing or too long", F.length("text") <= 5_000_000),
        ("images.url", "not an address", F.coalesce(F.forall("images", lambda i: F.coalesce(F.length(i["url"]) <= 4096, F.lit(False))), F.lit(True))),
        ("images.alt", "too long", F.coalesce(F.forall("images", lambda i: i["alt"].isNull() | (size(i["alt"]) <= 500)), F.lit(True))),
        ("questioner", "too long", optional("questioner", 200)),
        ("suggestedCategory", "too long", optional("suggestedCategory", 100)),
        ("userCategory", "too long", optional("userCategory", 100)),
        ("userTags", "more than 20", F.col("userTags").isNull() | (F.size("userTags") <= 20)),
        ("suggestedTags", "must have 1 to 50 characters", F.coalesce(F.forall("suggestedTags", lambda t: F.coalesce(size(t).between(1, 50), F.lit(False))), F.lit(True))),
        ("userTags", "must have 1 to 50 characters", F.coalesce(F.forall("userTags", lambda t: F.coalesce(size(t).between(1, 50), F.lit(False))), F.lit(True))),
        ("candidate.qualityScore", "must be 0 to 100", F.col("candidate.qualityScore").isNull() | F.col("candidate.qualityScore").between(0, 100)),
        ("candidate.projectScore", "must be 0 to 100", F.col("candidate.projectScore").isNull() | F.col("candidate.projectScore").between(0, 100)),
        ("candidate.simHash", "malformed", F.col("candidate.simHash").isNull() | F.col("candidate.simHash").rlike("^[a-f0-9]{16}$")),
        ("candidate.clusterId", "must have 1 to 100 characters", F.col("candidate.clusterId").isNull() | size("candidate.clusterId").between(1, 100)),
        ("candidate.duplicateOf", "must have 1 to 100 characters", F.col("candidate.duplicateOf").isNull() | size("candidate.duplicateOf").between(1, 100)),
        ("candidate.contentHash", "malformed", F.col("candidate.contentHash").isNull() | F.col("candidate.contentHash").rlike("^[a-f0-9]{16}$")),
    ]


@query("validation_issues", f"""
WITH {_CANON_SQL}, all_rows AS (
  SELECT d.*, c.canonical, s.site AS its_site FROM collected_documents d LEFT JOIN (SELECT seq, canonical FROM canon) c USING (seq) LEFT JOIN (SELECT seq, site FROM sited) s USING (seq)),
i AS (
  SELECT unnest(list_filter([
    CASE WHEN source IN ('wechat', 'zsxq', 'nowcoder', 'github') THEN NULL ELSE 'source|unknown source' END,
    CASE WHEN kind IN ('article', 'post', 'question', 'answer') THEN NULL ELSE 'kind|unknown kind' END,
    CASE WHEN length(url) <= 4096 THEN NULL ELSE 'url|not an address' END,
    CASE WHEN length(trim(title)) BETWEEN 1 AND 500 THEN NULL ELSE 'title|must have 1 to 500 characters' END,
    CASE WHEN author IS NULL OR length(trim(author)) <= 200 THEN NULL ELSE 'author|too long' END,
    CASE WHEN publishedAt IS NULL OR regexp_matches(publishedAt, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{2}}:[0-9]{{2}}(:[0-9]{{2}}([.][0-9]+)?)?Z$') THEN NULL ELSE 'publishedAt|not an ISO time in UTC' END,
    CASE WHEN regexp_matches(collectedAt, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{2}}:[0-9]{{2}}(:[0-9]{{2}}([.][0-9]+)?)?Z$') THEN NULL ELSE 'collectedAt|not an ISO time in UTC' END,
    CASE WHEN images IS NULL OR len(images) <= 30 THEN NULL ELSE 'images|more than 30' END,
    CASE WHEN suggestedTags IS NULL OR len(suggestedTags) <= 20 THEN NULL ELSE 'suggestedTags|more than 20' END,
    CASE WHEN its_site = source THEN NULL ELSE 'source|does not fit the address' END,
    CASE WHEN canonicalUrl = canonical THEN NULL ELSE 'canonicalUrl|is not the canonical address' END,
    CASE WHEN schemaVersion = 1 THEN NULL ELSE 'schemaVersion|must be 1' END,
    CASE WHEN length(html) <= 10000000 THEN NULL ELSE 'html|missing or too long' END,
    CASE WHEN length(text) <= 5000000 THEN NULL ELSE 'text|missing or too long' END,
    CASE WHEN images IS NULL OR len(list_filter(images, lambda i: NOT coalesce(length(i.url) <= 4096, false))) = 0 THEN NULL ELSE 'images.url|not an address' END,
    CASE WHEN images IS NULL OR len(list_filter(images, lambda i: length(trim(i.alt)) > 500)) = 0 THEN NULL ELSE 'images.alt|too long' END,
    CASE WHEN questioner IS NULL OR length(trim(questioner)) <= 200 THEN NULL ELSE 'questioner|too long' END,
    CASE WHEN suggestedCategory IS NULL OR length(trim(suggestedCategory)) <= 100 THEN NULL ELSE 'suggestedCategory|too long' END,
    CASE WHEN userCategory IS NULL OR length(trim(userCategory)) <= 100 THEN NULL ELSE 'userCategory|too long' END,
    CASE WHEN userTags IS NULL OR len(userTags) <= 20 THEN NULL ELSE 'userTags|more than 20' END,
    CASE WHEN suggestedTags IS NULL OR len(list_filter(suggestedTags, lambda t: NOT coalesce(length(trim(t)) BETWEEN 1 AND 50, false))) = 0 THEN NULL ELSE 'suggestedTags|must have 1 to 50 characters' END,
    CASE WHEN userTags IS NULL OR len(list_filter(userTags, lambda t: NOT coalesce(length(trim(t)) BETWEEN 1 AND 50, false))) = 0 THEN NULL ELSE 'userTags|must have 1 to 50 characters' END,
    CASE WHEN candidate.qualityScore IS NULL OR candidate.qualityScore BETWEEN 0 AND 100 THEN NULL ELSE 'candidate.qualityScore|must be 0 to 100' END,
    CASE WHEN candidate.projectScore IS NULL OR candidate.projectScore BETWEEN 0 AND 100 THEN NULL ELSE 'candidate.projectScore|must be 0 to 100' END,
    CASE WHEN candidate.simHash IS NULL OR regexp_matches(candidate.simHash, '^[a-f0-9]{{16}}$') THEN NULL ELSE 'candidate.simHash|malformed' END,
    CASE WHEN candidate.clusterId IS NULL OR length(trim(candidate.clusterId)) BETWEEN 1 AND 100 THEN NULL ELSE 'candidate.clusterId|must have 1 to 100 characters' END,
    CASE WHEN candidate.duplicateOf IS NULL OR length(trim(candidate.duplicateOf)) BETWEEN 1 AND 100 THEN NULL ELSE 'candidate.duplicateOf|must have 1 to 100 characters' END,
    CASE WHEN candidate.contentHash IS NULL OR regexp_matches(candidate.contentHash, '^[a-f0-9]{{16}}$') THEN NULL ELSE 'candidate.contentHash|malformed' END
  ], lambda x: x IS NOT NULL)) AS issue FROM all_rows)
SELECT split_part(issue, '|', 1) AS path, split_part(issue, '|', 2) AS message, count(*) AS rows FROM i GROUP BY ALL""")
def validation_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of the rows that go to quarantine, counted."""
    _, bad = keyed.quarantine(_docs(spark, sf_dir), document_rules())
    return bad.select(F.explode("issues").alias("i")).groupBy("i.path", "i.message").agg(F.count("*").alias("rows"))


@query("exact_duplicates", r"""
WITH h AS (SELECT seq, canonicalUrl, substr(sha256(regexp_replace(lower(text), '[\p{P}\p{S}\s\x{00A0}\x{3000}\x{FEFF}]+', '', 'g')), 1, 16) AS content_hash
           FROM collected_documents WHERE text IS NOT NULL)
SELECT content_hash, count(*) AS rows, count(DISTINCT canonicalUrl) AS pages, min(seq) AS first_seq FROM h GROUP BY content_hash HAVING count(*) > 1""")
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts without case, punctuation and blanks."""
    hashed = _docs(spark, sf_dir).where("text is not null").select("seq", "canonicalUrl", finger.content_hash(F.col("text")).alias("content_hash"))
    return (
        hashed.groupBy("content_hash").agg(F.count("*").alias("rows"), F.countDistinct("canonicalUrl").alias("pages"), F.min("seq").alias("first_seq"))
        .where(F.col("rows") > 1)
    )


@query("content_fingerprints")
def content_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content hash and SimHash with compatibility composition (no SQL form of NFKC)."""
    return _docs(spark, sf_dir).select("seq", finger.content_hash(finger.nfkc("text")).alias("content_hash"), finger.simhash("text").alias("simhash"))


@query("simhash_signatures", r"""
WITH t AS (SELECT seq, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w, regexp_extract_all(lower(coalesce(text, '')), '[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}]+') AS r FROM collected_documents),
u AS (
  SELECT seq, unnest(w) AS token FROM t
  UNION ALL SELECT seq, unnest(string_split(x, '')) FROM (SELECT seq, unnest(r) AS x FROM t)
  UNION ALL SELECT seq, unnest(list_transform(range(1, length(x)), lambda i: substring(x, i::BIGINT, 2))) FROM (SELECT seq, unnest(r) AS x FROM t)),
c AS (SELECT seq, token, count(*) AS n FROM u GROUP BY ALL),
h AS (SELECT seq, n, ('0x' || substr(sha256(token), 1, 16))::UBIGINT AS h FROM c),
b AS (SELECT seq, i, sum(CASE WHEN (h >> i::UBIGINT) & 1 = 1 THEN n ELSE -n END) AS s FROM h, range(64) AS g(i) GROUP BY ALL),
v AS (SELECT seq, bit_or(CASE WHEN s >= 0 THEN 1::UBIGINT << i::UBIGINT ELSE 0::UBIGINT END) AS v FROM b GROUP BY seq)
SELECT d.seq, coalesce(lpad(lower(to_hex(v.v)), 16, '0'), substr(sha256(''), 1, 16)) AS simhash FROM collected_documents d LEFT JOIN v USING (seq)""")
def simhash_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash of texts as they are."""
    return _docs(spark, sf_dir).select("seq", finger.simhash_plain("text").alias("simhash"))


@query("titles_from_text")
def titles_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived titles next to the stored ones."""
    return _docs(spark, sf_dir).select("seq", "title", text.title_of(text.strip_controls(F.col("text"))).alias("derived_title"))


_LABELS = "|".join(text.CONTROLS)


@query("controls_removed", rf"""
-- a newline is written as the two characters 1 (end of a line) and 2 (start of a line), as DuckDB's patterns can't look ahead
SELECT seq, length(text) - length(regexp_replace(regexp_replace(replace(regexp_replace(replace(text, chr(10), chr(1) || chr(2)),
    '(^|\x02)[\t\v\f\r \x01\x02]*(?:{_LABELS})[\t\v\f\r ]*(\x01|$)', '\1\2', 'g'), chr(1) || chr(2), chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'),
    '^[\t\n\v\f\r ]+|[\t\n\v\f\r ]+$', '', 'g')) AS removed
FROM collected_documents WHERE regexp_matches(text, '(^|\n)[\t\n\v\f\r ]*(?:{_LABELS})[\t\v\f\r ]*(\n|$)')""")
def controls_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters that leave with whole-line control labels."""
    rows = _docs(spark, sf_dir).where(F.col("text").rlike(rf"(^|\n)\s*(?:{_LABELS})[^\S\n]*(\n|\z)"))
    return rows.select("seq", (F.length("text") - F.length(text.strip_controls(F.col("text")))).alias("removed"))


_CAT = list(organize.CATEGORIES.items())
_SCORE = "3 * contains(lower(coalesce(title, '')), '{0}')::INT + contains(lower(coalesce(text, '')), '{0}')::INT"
_CAT_SQL = ", ".join(f"({' + '.join(_SCORE.format(t) for t in terms)}) AS s{i}" for i, (_, terms) in enumerate(_CAT))
_BEST_SQL = "CASE WHEN greatest(s0, s1, s2, s3) = 0 THEN 'other' " + " ".join(f"WHEN s{i} = greatest(s0, s1, s2, s3) THEN '{n}'" for i, (n, _) in enumerate(_CAT)) + " END"


@query("categories", f"SELECT seq, {_BEST_SQL} AS category FROM (SELECT seq, {_CAT_SQL} FROM collected_documents)")
def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("seq", organize.category(F.col("title"), F.col("text")).alias("category"))


@query("document_tags", """
WITH base AS (SELECT seq, CASE WHEN len(coalesce(userTags, [])) > 0 THEN userTags ELSE coalesce(suggestedTags, []) END AS t FROM collected_documents),
e AS (SELECT seq, trim(unnest(t)) AS tag, unnest(range(len(t))) AS pos FROM base), d AS (SELECT seq, tag, min(pos) AS pos FROM e WHERE tag <> '' GROUP BY ALL)
SELECT tag, count(*) AS documents FROM (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY seq ORDER BY pos) <= 8) GROUP BY tag""")
def document_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.array().cast("array<string>")
    chosen = organize.tags(F.col("userTags"), F.col("suggestedTags"), none)
    return _docs(spark, sf_dir).select(F.explode(chosen).alias("tag")).groupBy("tag").agg(F.count("*").alias("documents"))


_TERMS = ", ".join(f"('{t}')" for t in organize.LEXICON)


@query("keywords", f"""
WITH hay AS (SELECT seq, lower(concat_ws(' ', title, title, title, text)) AS h FROM collected_documents),
e AS (
  SELECT seq, term, (length(h) - length(replace(h, term, ''))) // length(term) AS n FROM hay, (VALUES {_TERMS}) AS l(term)
  UNION ALL SELECT seq, unnest(regexp_extract_all(h, '[a-z][a-z0-9+#.-]{{1,24}}')) AS term, 1 AS n FROM hay),
c AS (SELECT seq, term, sum(n) AS n FROM e WHERE n > 0 AND term NOT IN ('the', 'and', 'for', 'with', 'from', 'that', 'this', 'into') GROUP BY ALL)
SELECT seq, string_agg(term, ' ' ORDER BY n DESC, term) AS keywords FROM (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY seq ORDER BY n DESC, term) <= 8) GROUP BY seq""")
def keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top eight terms of each document."""
    k = organize.keywords(_docs(spark, sf_dir), "seq", "title", "text")
    return k.select("seq", F.array_join("keywords", " ").alias("keywords"))


_LEX_SQL = " UNION ALL ".join(f"SELECT '{t}' AS term, sum((length(h) - length(replace(h, '{t}', ''))) // {len(t)}) AS occurrences, sum(contains(h, '{t}')::INT) AS documents FROM hay" for t in organize.LEXICON)


@query("lexicon_counts", f"WITH hay AS (SELECT lower(concat_ws(' ', title, text)) AS h FROM collected_documents) SELECT term, occurrences::BIGINT AS occurrences, documents::BIGINT AS documents FROM ({_LEX_SQL})")
def lexicon_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences of each lexicon term over the corpus: one pass, partial sums, one row per term."""
    hay = _docs(spark, sf_dir).select(F.lower(F.concat_ws(" ", "title", "text")).alias("h"))
    each = F.array(*(F.struct(F.lit(t).alias("term"), text.occurrences(F.col("h"), t).alias("n")) for t in organize.LEXICON))
    flat = hay.select(F.explode(each).alias("e")).select("e.term", "e.n")
    return flat.groupBy("term").agg(F.sum("n").alias("occurrences"), F.sum((F.col("n") > 0).cast("bigint")).alias("documents"))


_BLANKS = r"[\t-\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
_TITLE_HITS = " + ".join(f"(contains(t, '{t}') AND contains(lower(s), '{t}'))::INT" for t in organize.LEXICON)


@query("summaries", rf"""
WITH base AS (SELECT seq, lower(coalesce(title, '')) AS t, coalesce(text, '') AS x FROM collected_documents),
raw AS (SELECT seq, t, unnest(p) AS s, unnest(range(len(p))) AS pos FROM (SELECT seq, t, regexp_extract_all(x, '[^。！？!?\n]+[。！？!?]?') AS p FROM base)),
cl AS (SELECT seq, t, pos, trim(regexp_replace(s, '{_BLANKS}+', ' ', 'g'), ' ') AS s FROM raw),
f AS (SELECT seq, regexp_replace(s, '({_BLANKS}|[，。！？!?、；;：:])+', '', 'g') AS k, min(pos) AS pos, arg_min(s, pos) AS s, any_value(t) AS t FROM cl WHERE length(s) >= 12 GROUP BY ALL),
j AS (SELECT seq, s, t, row_number() OVER (PARTITION BY seq ORDER BY pos) - 1 AS j FROM f),
sc AS (SELECT seq, s, j, greatest(0, 6 - j) + 5 * ({_TITLE_HITS}) + CASE WHEN length(s) BETWEEN 24 AND 90 THEN 3 ELSE 0 END + CASE WHEN regexp_matches(s, '[。！？!?]$') THEN 1 ELSE 0 END AS score FROM j),
top AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY seq ORDER BY score DESC, j) <= 4),
run AS (SELECT seq, s, j, sum(length(s)) OVER (PARTITION BY seq ORDER BY j) AS total FROM top),
told AS (SELECT seq, string_agg(s, '' ORDER BY j) AS summary FROM run WHERE total <= 280 GROUP BY seq)
SELECT b.seq, coalesce(told.summary, substring(trim(regexp_replace(x, '{_BLANKS}+', ' ', 'g'), ' '), 1, 280)) AS summary FROM base b LEFT JOIN told USING (seq)""")
def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return organize.summary(_docs(spark, sf_dir), "seq", "title", "text")


_TOPICS = (organize.Topic("interview", ("面经", "面试官", "面试"), ("追问", "简历", "offer", "薪资")), organize.Topic("performance", ("性能", "缓存", "卡顿"), ("首屏", "毫秒", "掉帧", "监控")))


@query("topic_matches", """
WITH m AS (SELECT seq, text,
  list_filter(['面经', '面试官', '面试'], lambda t: contains(text, t)) AS s1, list_filter(['追问', '简历', 'offer', '薪资'], lambda t: contains(text, t)) AS u1,
  list_filter(['性能', '缓存', '卡顿'], lambda t: contains(text, t)) AS s2, list_filter(['首屏', '毫秒', '掉帧', '监控'], lambda t: contains(text, t)) AS u2
  FROM collected_documents WHERE text IS NOT NULL),
r AS (SELECT seq, CASE
    WHEN len(list_filter(['面经', '面试官', '面试'], lambda t: contains(substring(text, 1, 150), t))) > 0 AND len(s1) + len(u1) >= 2 THEN {'rule': 'interview', 'hits': list_concat(s1, u1)}
    WHEN len(list_filter(['性能', '缓存', '卡顿'], lambda t: contains(substring(text, 1, 150), t))) > 0 AND len(s2) + len(u2) >= 2 THEN {'rule': 'performance', 'hits': list_concat(s2, u2)} END AS x FROM m)
SELECT seq, x.rule AS rule, array_to_string(x.hits, ',') AS hits FROM r WHERE x IS NOT NULL""")
def topic_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First topic whose strong term opens the text and that a second term confirms."""
    hit = organize.topic(F.col("text"), _TOPICS)
    return _docs(spark, sf_dir).select("seq", hit.alias("x")).where("x is not null").select("seq", "x.rule", F.array_join("x.hits", ",").alias("hits"))


@query("outbound_hosts", r"""
WITH l AS (SELECT seq, unnest(regexp_extract_all(text, 'https?://[A-Za-z0-9._~:/?#@!$&*+;=%-]+[A-Za-z0-9/_-]')) AS link FROM collected_documents),
h AS (SELECT seq, link, lower(regexp_extract(link, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host FROM l)
SELECT host, count(*) AS links, count(DISTINCT seq) AS documents, min(seq) AS first_seq FROM h GROUP BY host ORDER BY links DESC, host LIMIT 12""")
def outbound_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Census of hosts linked from texts, the twelve most linked."""
    l = _docs(spark, sf_dir).select("seq", F.explode(urls.text_links(F.col("text"))).alias("link")).withColumn("host", urls.host(F.col("link")))  # noqa: E741
    counted = l.groupBy("host").agg(F.count("*").alias("links"), F.countDistinct("seq").alias("documents"), F.min("seq").alias("first_seq"))
    return counted.orderBy(F.desc("links"), "host").limit(12)


@query("longest_text_per_page", """
SELECT canonicalUrl AS canonical_url, max(length(text)) AS longest, arg_min(seq, {'a': -length(text), 'b': seq}) AS seq
FROM collected_documents WHERE text IS NOT NULL GROUP BY canonicalUrl""")
def longest_text_per_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest text retained per page; ties keep the earlier one."""
    slim = _docs(spark, sf_dir).where("text is not null").select(F.col("canonicalUrl").alias("canonical_url"), "seq", F.length("text").alias("longest"))
    return keyed.first_per_key(slim, ["canonical_url"], -F.col("longest"), F.col("seq"))


@query("known_excluded", """
SELECT d.seq, d.canonicalUrl AS canonical_url FROM collected_documents d
WHERE NOT EXISTS (SELECT 1 FROM catalog c WHERE c.url = d.canonicalUrl)""")
def known_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures whose page isn't in the catalog."""
    slim = _docs(spark, sf_dir).select("seq", F.col("canonicalUrl").alias("canonical_url"))
    return keyed.without(slim, table(spark, sf_dir, "catalog").select(F.col("url").alias("canonical_url")), "canonical_url")


@query("authors")
def authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each account, however its name is written (DuckDB has no NFKC, so there is no SQL)."""
    return (
        _docs(spark, sf_dir).where("author is not null").groupBy("source", F.lower(F.trim(finger.nfkc("author"))).alias("account")).agg(F.count("*").alias("documents"))
    )


@query("discovered_pages", r"""
WITH l AS (SELECT seq, unnest(u) AS link, unnest(range(len(u))) AS pos FROM (SELECT seq, regexp_extract_all(text, 'https?://[A-Za-z0-9._~:/?#@!$&*+;=%-]+[A-Za-z0-9/_-]') AS u FROM collected_documents WHERE text IS NOT NULL)),
f AS (SELECT link, min({'a': seq, 'b': pos}) AS o FROM l WHERE link LIKE 'https://%' AND link NOT IN (SELECT url FROM catalog WHERE url IS NOT NULL) GROUP BY link)
SELECT link, o.a AS first_seq FROM f ORDER BY o LIMIT 24""")
def discovered_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 24 linked addresses that the catalog doesn't know, in order of first occurrence."""
    l = _docs(spark, sf_dir).where("text is not null").select("seq", F.posexplode(urls.text_links(F.col("text"))).alias("pos", "link")).where(F.col("link").startswith("https://"))  # noqa: E741
    first = l.groupBy("link").agg(F.min(F.struct("seq", "pos")).alias("o"))
    known = table(spark, sf_dir, "catalog").select(F.col("url").alias("link"))
    return keyed.without(first, known, "link").orderBy("o").limit(24).select("link", F.col("o.seq").alias("first_seq"))


@query("named_domains", r"""
-- a domain begins where a run of such characters begins, so each run is cut out first and then matched from its start
WITH t AS (SELECT seq, unnest(regexp_extract_all(lower(text), '(?:^|[^a-z0-9@./-])([a-z0-9-][a-z0-9.-]*)', 1)) AS run FROM collected_documents),
d AS (SELECT seq, regexp_extract(run, '^((?:[a-z0-9-]+[.])+(?:com[.]cn|com|cn|net|top|xyz))(?:[^a-z0-9-]|$)', 1) AS domain FROM t)
SELECT domain, count(DISTINCT seq) AS documents FROM d WHERE domain <> '' AND NOT (domain = 'github.com' OR domain LIKE '%.github.com') GROUP BY domain""")
def named_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains written out bare in texts, apart from trusted ones."""
    each = _docs(spark, sf_dir).select("seq", F.explode(urls.bare_domains(F.col("text"), trusted=("github.com",))).alias("domain"))
    return each.groupBy("domain").agg(F.countDistinct("seq").alias("documents"))


@query("completed_texts", """
WITH n AS (SELECT canonicalUrl AS url, seq, text, length(regexp_replace(text, '[ \t\n\r]+', '', 'g')) AS size FROM collected_documents WHERE text IS NOT NULL),
b AS (SELECT url, arg_min({'seq': seq, 'size': size}, seq) AS f, arg_min({'seq': seq, 'size': size}, {'a': -size, 'b': seq}) AS l FROM n GROUP BY url)
SELECT url, f.seq AS first_seq, l.seq AS longest_seq FROM b WHERE l.size >= 1.15 * f.size AND l.size >= f.size + 120""")
def completed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose first capture a later, clearly longer one completes."""
    n = _docs(spark, sf_dir).where("text is not null").select(F.col("canonicalUrl").alias("url"), "seq", F.length(F.regexp_replace("text", r"[ \t\n\r]+", "")).alias("size"))
    b = n.groupBy("url").agg(F.min_by(F.struct("seq", "size"), "seq").alias("f"), F.min_by(F.struct("seq", "size"), F.struct(-F.col("size"), "seq")).alias("l"))
    clear = (F.col("l.size") >= 1.15 * F.col("f.size")) & (F.col("l.size") >= F.col("f.size") + 120)
    return b.where(clear).select("url", F.col("f.seq").alias("first_seq"), F.col("l.seq").alias("longest_seq"))


@query("image_plan", """
SELECT seq, pos + 1 AS position, i.url AS image FROM (SELECT seq, unnest(images) AS i, unnest(range(len(images))) AS pos FROM collected_documents)
WHERE pos < 30 AND regexp_matches(lower(i.url), '^https?://[^?#]+[.](jpg|jpeg|png|gif|webp)([?#]|$)')""")
def image_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images to fetch: the first thirty of a document with an accepted type. Fetching is the caller's."""
    i = _docs(spark, sf_dir).select("seq", F.posexplode("images").alias("pos", "i"))
    ok = F.lower("i.url").rlike("^https?://[^?#]+[.](jpg|jpeg|png|gif|webp)([?#]|$)")
    return i.where((F.col("pos") < 30) & ok).select("seq", (F.col("pos") + 1).alias("position"), F.col("i.url").alias("image"))


@query("organised_documents")
def organised_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain that a save runs: valid documents with id, category, keywords and summary."""
    good, _ = keyed.quarantine(_docs(spark, sf_dir), [r for r in document_rules() if r[0] != "publishedAt"])
    base = good.select("seq", urls.content_id(F.col("canonicalUrl")).alias("id"), "title", organize.category(F.col("title"), F.col("text")).alias("category"))
    k, s = organize.keywords(good, "seq", "title", "text"), organize.summary(good, "seq", "title", "text")
    return base.join(k, "seq", "left").join(s, "seq", "left")
