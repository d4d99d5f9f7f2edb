"""Queries A: scans, feed items, cleaning, deduplication, writers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from newsloom.operators import analytics, cleaning, ingest
from newsloom.operators.cleaning import (
    DURATION, MARKDOWN_IMAGE, MARKDOWN_LINK, NOISE_HEADINGS, NOISE_LINES, NOISE_PREFIXES,
)
from newsloom.functions.urls import AUTHORITY, TRACKING_PARAMETERS, URI
from newsloom.plans.registry import query
from newsloom.plans.views import AS_OF_SQL, SETTINGS, Views, fold_sql
from newsloom.session import shared_folder
from newsloom.sources import sinks
from newsloom.sources.tables import TABLES

# Character references of the given tables, for the SQL twins; ``&amp;`` comes last.
ENTITIES = {
    "&lt;": "<",
    "&gt;": ">",
    "&quot;": '"',
    "&#34;": '"',
    "&apos;": "'",
    "&#39;": "'",
    "&#x27;": "'",
    "&nbsp;": " ",
    "&#160;": " ",
    "&ndash;": "–",
    "&#8211;": "–",
    "&mdash;": "—",
    "&#8212;": "—",
    "&lsquo;": "‘",
    "&#8216;": "‘",
    "&rsquo;": "’",
    "&#8217;": "’",
    "&ldquo;": "“",
    "&#8220;": "“",
    "&rdquo;": "”",
    "&#8221;": "”",
    "&hellip;": "…",
    "&#8230;": "…",
    "&copy;": "©",
    "&middot;": "·",
    "&amp;": "&",
    "&#38;": "&",
}

# More references, and what they stand for.
MORE_REFERENCES = (
    "caf&eacute; &#8364;5 &#x20AC;5 &Aring; &szlig; &ntilde; &uuml; &pound; &yen; &sect; &deg; &frac12; &times; &divide; "
    "&laquo; &raquo; &bull; &trade; &rarr; &permil; &Sigma; &amp;eacute; &eacute"
)
MORE_TEXT = "café €5 €5 Å ß ñ ü £ ¥ § ° ½ × ÷ « » • ™ → ‰ Σ &eacute; é"

KEYS = {name: columns.split()[0] for name, columns in TABLES.items()}


def scratch(views: Views, name: str) -> str:
    """A new folder for a written result: next to the cluster's checkpoints, if it names any."""
    base = shared_folder(views.spark)
    if base is None:
        return tempfile.mkdtemp(prefix="spark-") + "/" + name
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query(
    "a1_scan",
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS n_rows, count(DISTINCT {k}) AS n_keys FROM {t}" for t, k in KEYS.items()
    ),
)
def a1(v):
    parts = [
        v.table(t).agg(F.count("*").alias("n_rows"), F.count_distinct(k).alias("n_keys"))
        .select(F.lit(t).alias("table_name"), "n_rows", "n_keys")
        for t, k in KEYS.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _entities_sql(x: str) -> str:
    for entity, char in ENTITIES.items():
        x = f"replace({x}, '{entity}', '{char.replace(chr(39), chr(39) * 2)}')"
    return f"replace({x}, '&amp', '&')"  # the one form without a semicolon in the given tables


def _plain_sql(x: str) -> str:
    tagless = f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"
    return f"nullif(trim(regexp_replace({_entities_sql(tagless)}, '\\s+', ' ', 'g'), ' '), '')"


@query(
    "a2_feed_item_normalize",
    f"""
SELECT page_id, CASE WHEN page_id % 3 <> 0 THEN 'g' || page_id END AS guid,
  CASE page_id % 4 WHEN 1 THEN 'https://feeds.example.com/en/story/' || page_id WHEN 2 THEN 'https://feeds.example.com/rss/' || page_id
    WHEN 3 THEN 'https://cdn.example.com/' || page_id ELSE url END AS url,
  coalesce({_plain_sql("regexp_extract(html, '<title>(.*?)</title>', 1) || ' &amp; &lt;more&gt;&nbsp;'")} || ' {MORE_TEXT}', 'Untitled') AS title,
  {_plain_sql('html')} AS summary, NULL::VARCHAR AS author,
  strftime(CASE WHEN page_id % 2 = 0 THEN {AS_OF_SQL} - INTERVAL 2 HOUR ELSE {AS_OF_SQL} - to_hours(page_id % 72) END, '%Y-%m-%d %H:%M:%S') AS published_at
FROM pages WHERE page_id % 10 <> 9""",
)
def a2(v):
    p = F.col("page_id")
    raw = v.table("pages").select(
        "page_id",
        F.when(p % 10 != 9, F.when(p % 4 == 1, F.concat(F.lit("/en/story/"), p))
               .when(p % 4 == 2, p.cast("string"))
               .when(p % 4 == 3, F.concat(F.lit("//cdn.example.com/"), p))
               .otherwise(F.col("url"))).alias("link"),
        F.lit("https://feeds.example.com/rss/all.xml").alias("base_url"),
        F.when(p % 3 != 0, F.concat(F.lit(" g"), p, F.lit(" "))).otherwise("  ").alias("guid"),
        F.concat(F.regexp_extract("html", "<title>(.*?)</title>", 1), F.lit(f" &amp; &lt;more&gt;&nbsp; {MORE_REFERENCES}")).alias("title"),
        F.col("html").alias("summary"),
        F.lit("<i> </i>").alias("author"),
        F.when(p % 2 != 0, v.as_of - F.make_dt_interval(F.lit(0), (p % 72).cast("int"))).alias("published"),
        (v.as_of - F.expr("interval 2 hours")).alias("updated"),
    )
    return ingest.feed_item_normalize(raw)


_CANONICAL = f"""
SELECT page_id, url, scheme || '://' || host || CASE WHEN path = '' THEN '/' ELSE path END
  || CASE WHEN len(pairs) > 0 THEN '?' || array_to_string(pairs, '&') ELSE '' END AS canonical_url
FROM (SELECT page_id, url, lower(regexp_extract(url, '{URI}', 1)) AS scheme,
  lower(regexp_extract(regexp_extract(url, '{URI}', 2), '{AUTHORITY}', 2)) AS host,
  regexp_extract(url, '{URI}', 3) AS path,
  list_sort(list_filter(string_split(regexp_extract(url, '{URI}', 4), '&'),
    lambda p: p <> '' AND split_part(p, '=', 1) NOT IN ({', '.join(repr(t) for t in TRACKING_PARAMETERS)}))) AS pairs
  FROM pages)"""


@query(
    "a3_canonicalize_url",
    f"SELECT page_id, canonical_url, sha256(canonical_url) AS url_hash FROM ({_CANONICAL})",
)
def a3(v):
    return ingest.canonicalize_url(v.feed_items).select("page_id", "canonical_url", "url_hash")


def hashed_items(v: Views):
    return ingest.canonicalize_url(v.feed_items.select("page_id", "item_order", "url", "source_id", "guid"))


@query(
    "a4_dedup_feed_items",
    f"""
WITH RECURSIVE items AS (
  SELECT row_number() OVER (ORDER BY f.page_id) AS i, f.page_id, c.canonical_url AS u,
    CASE WHEN f.guid IS NOT NULL THEN f.source_id || ':' || f.guid END AS g
  FROM v_feed_items f JOIN ({_CANONICAL}) c USING (page_id)),
walk AS (
  SELECT 0::BIGINT AS i, NULL::BIGINT AS page_id, false AS kept, []::VARCHAR[] AS us, []::VARCHAR[] AS gs
  UNION ALL
  SELECT n.i, n.page_id, NOT (list_contains(w.us, n.u) OR coalesce(list_contains(w.gs, n.g), false)),
    CASE WHEN list_contains(w.us, n.u) OR coalesce(list_contains(w.gs, n.g), false) THEN w.us ELSE list_append(w.us, n.u) END,
    CASE WHEN list_contains(w.us, n.u) OR coalesce(list_contains(w.gs, n.g), false) OR n.g IS NULL THEN w.gs ELSE list_append(w.gs, n.g) END
  FROM walk w JOIN items n ON n.i = w.i + 1)
SELECT page_id, kept FROM walk WHERE i > 0""",
)
def a4(v):
    return ingest.dedup_feed_items(hashed_items(v)).select("page_id", "kept")


@query(
    "a5_enabled_feeds",
    """
SELECT s.source_id, s.publisher_id, s.name FROM v_sources s JOIN v_publishers p USING (publisher_id)
WHERE s.enabled AND p.enabled""",
)
def a5(v):
    return ingest.enabled_feeds(v.sources, v.publishers).select("source_id", "publisher_id", "name")


@query(
    "a6_discovery_stats",
    """
SELECT source_id, count(*) AS discovered, count(*) FILTER (o = 'content_duplicate') AS duplicates,
  count(*) FILTER (o = 'failed') AS failed, count(*) FILTER (o <> 'failed') AS extracted
FROM (SELECT a.source_id, CASE WHEN a.status = 'failed' THEN 'failed' WHEN f.first_id < a.article_id THEN 'content_duplicate' ELSE 'extracted' END AS o
  FROM v_articles a LEFT JOIN (SELECT content_hash, min(article_id) AS first_id FROM v_articles WHERE status = 'extracted' GROUP BY content_hash) f USING (content_hash))
GROUP BY ROLLUP (source_id)""",
)
def a6(v):
    articles = v.articles.select("article_id", "source_id", "status", "content_hash")
    checked = ingest.content_dedup(articles, articles).select("article_id", F.col("status").alias("verdict"))
    outcome = F.when(F.col("status") == "failed", "failed").when(
        F.col("verdict") == "duplicate", "content_duplicate"
    ).otherwise("extracted")
    outcomes = articles.join(checked, "article_id", "left").select("source_id", outcome.alias("outcome"))
    return ingest.discovery_stats(outcomes)


@query(
    "a7_content_dedup",
    f"""
SELECT article_id, CASE WHEN first_id < article_id THEN 'duplicate' ELSE 'extracted' END AS status,
  CASE WHEN first_id < article_id THEN first_id END AS duplicate_of
FROM (SELECT article_id, published_at, min(article_id) OVER (PARTITION BY content_hash) AS first_id FROM v_articles WHERE status = 'extracted')
WHERE published_at >= {AS_OF_SQL} - INTERVAL 24 HOUR""",
)
def a7(v):
    batch = v.articles.filter(F.col("published_at") >= v.as_of - F.expr("interval 24 hours"))
    return ingest.content_dedup(v.articles, batch)


@query(
    "a8_media_page_reject",
    """
SELECT article_id, contains(canonical_url, '/video/')
  OR regexp_matches(trim(title), '(?i)^(?:watch|listen)(?:\\s+live)?\\s*:|\\blive\\s+stream\\b') AS is_media FROM v_articles""",
)
def a8(v):
    return v.articles.select(
        "article_id", ingest.is_media_page(F.col("canonical_url"), F.col("title")).alias("is_media")
    )


@query("a9_prune_html")
def a9(v):
    return cleaning.prune_html(v.table("pages"))


def _quoted(values) -> str:
    return ", ".join(f"'{x}'" for x in values)


_CLEANED = f"""
SELECT d.doc_id, coalesce(k.text, '') AS text FROM documents d LEFT JOIN (
  SELECT doc_id, string_agg(line, E'\\n\\n' ORDER BY pos) AS text FROM (
    SELECT *, trim(f, ' :') AS label, count(*) OVER (PARTITION BY doc_id, f) AS twins FROM (
      SELECT *, {fold_sql('line')} AS f, len(regexp_extract_all(line, '\\S+')) AS words FROM (
        SELECT doc_id, trim(unnest(parts), E' \\t') AS line, generate_subscripts(parts, 1) AS pos FROM (
          SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '{MARKDOWN_IMAGE}', '', 'g'), '{MARKDOWN_LINK}', '\\1', 'g'), chr(10)) AS parts FROM documents))
      WHERE line <> ''))
  WHERE label NOT IN ({_quoted(NOISE_LINES)}, {_quoted(NOISE_HEADINGS)}) AND NOT regexp_matches(line, '{DURATION}')
    AND NOT ({' OR '.join(f"starts_with(label, '{p}')" for p in NOISE_PREFIXES)}) AND NOT (words <= 3 AND twins >= 2)
  GROUP BY doc_id) k USING (doc_id)"""


@query("a10_clean_text_lines", f"SELECT doc_id, sha256(text) AS text_hash, length(text) AS n_chars FROM ({_CLEANED})")
def a10(v):
    cleaned = cleaning.clean_text_lines(v.table("documents").select("doc_id", "text"))
    return cleaned.select("doc_id", F.sha2("text", 256).alias("text_hash"), F.length("text").alias("n_chars"))


@query(
    "a11_extraction_gate",
    f"""
SELECT article_id, word_count, CASE WHEN word_count >= 150 THEN h END AS content_hash,
  CASE WHEN word_count >= 150 THEN 'extracted' ELSE 'failed' END AS status,
  CASE WHEN word_count < 150 THEN CASE WHEN word_count = 0 THEN 'no_text' ELSE 'too_few_words' END END AS reason
FROM (SELECT doc_id AS article_id, len(regexp_extract_all(text, '\\S+')) AS word_count, sha256(text) AS h FROM ({_CLEANED}))""",
)
def a11(v):
    cleaned = v.table("documents").select(
        F.col("doc_id").alias("article_id"), cleaning.clean_text(F.col("text")).alias("content")
    )
    return ingest.extraction_gate(cleaned, SETTINGS.article_min_words).drop("content")


@query(
    "a12_group_feeds_into_publishers",
    """
SELECT source_id, min(source_id) OVER w AS publisher_source_id, first_value(name) OVER (PARTITION BY k ORDER BY source_id) AS publisher_name
FROM (SELECT *, coalesce(lower(rtrim(site_url, '/')), 'source:' || source_id) AS k FROM v_sources) WINDOW w AS (PARTITION BY k)""",
)
def a12(v):
    return ingest.group_feeds_into_publishers(v.sources)


@query("a13_persist_list", f"SELECT user_id, '2024-01-31' AS list_date, rank, article_id, reading_minutes FROM v_list")
def a13(v):
    """Written twice; the second write, with other ranks, must change nothing."""
    from newsloom.plans.lists import daily_list

    folder = scratch(v, "lists")
    items = daily_list(v).select(
        "user_id", F.to_date(v.as_of).alias("list_date"), "rank", "article_id", "reading_minutes"
    )
    stored = sinks.persist_list(items, folder)
    changed = stored.withColumn("rank", F.col("rank") + 1).select(*items.columns)
    return sinks.persist_list(changed, folder).select(*items.columns)


@query(
    "a14_export_csv",
    """
SELECT CAST(run_id AS VARCHAR) AS run_id, node_name, CAST(CAST(round(CAST(seconds AS DECIMAL(28,10)), 3) AS DECIMAL(18,3)) AS VARCHAR) AS seconds,
  CAST(attempts AS VARCHAR) AS attempts FROM v_times""",
)
def a14(v):
    folder = scratch(v, "steps")
    times = analytics.node_time(v.run_events)
    sinks.export_csv(times, folder)
    schema = ", ".join(f"{c} string" for c in times.columns)
    return v.spark.read.schema(schema).option("header", True).csv(folder)
