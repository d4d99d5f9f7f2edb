"""Queries B, C and D: features, scores, reading lists and preferences."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions import clock
from newsloom.functions.text import fingerprint, round_to
from newsloom.operators import features, preferences, scoring
from newsloom.plans.registry import query
from newsloom.session import cut_lineage
from newsloom.plans.views import AS_OF_SQL, SETTINGS, VIEW_SQL, Views, fold_sql, r

# Settings with preferences, to exercise the configured parts of the score.
CHOOSY = replace(
    SETTINGS, preferred_topics=("the re", "ting", "climate"), preferred_source_ids=(1, 3, 5), blocked_source_ids=(4, 6)
)

# --- check side -----------------------------------------------------------------

_LENGTH = "greatest(0, 10 * (1 - abs(word_count - m * 225.0::DOUBLE) / greatest(1, m * 225.0::DOUBLE)))"
_FRESH = "greatest(0, 40 * (1 - age / 48.0::DOUBLE))"
VIEW_SQL["v_base"] = f"""
SELECT article_id, m, reading_minutes, published_at, {r(f'{_FRESH} + 15 + 10 + {_LENGTH}', 2)} AS base_score,
  {r(_FRESH, 2)} AS freshness_score, {r(_LENGTH, 2)} AS length_score,
  'freshness ' || CAST(CAST({r(_FRESH, 1)} AS DECIMAL(18,1)) AS VARCHAR) || '/40; length fit ' || CAST(CAST({r(_LENGTH, 1)} AS DECIMAL(18,1)) AS VARCHAR) || '/10' AS base_reason
FROM (SELECT article_id, reading_minutes, published_at, age::DOUBLE AS age, word_count, unnest(generate_series(2, 25)) AS m FROM v_eligible)"""
VIEW_SQL["v_personal"] = f"""
SELECT user_id, article_id, {r('avg(part) * 30', 2)} AS personalization_score,
  coalesce(array_to_string(list(reason ORDER BY n) FILTER (n <= 3 AND round(part, 9) <> 0), '; '), '') AS personal_reason
FROM (SELECT user_id, article_id, part, feature_type || ' ''' || feature_value || ''' ' || CASE WHEN part > 0 THEN 'preferred' ELSE 'avoided' END AS reason,
    row_number() OVER (PARTITION BY user_id, article_id ORDER BY round(abs(part), 9) DESC, feature_type, feature_value) AS n
  FROM (SELECT p.user_id, f.article_id, f.feature_type, f.feature_value, p.score * p.confidence * f.confidence AS part
    FROM v_preferences p JOIN v_features f USING (feature_type, feature_value) WHERE f.article_id IN (SELECT article_id FROM v_eligible)))
GROUP BY user_id, article_id"""
VIEW_SQL["v_totals"] = f"""
SELECT t.user_id, t.target_count, t.target_minutes, b.article_id, b.published_at, b.reading_minutes,
  {r('b.base_score + coalesce(p.personalization_score, 0)', 2)} AS total_score, b.base_score, coalesce(p.personalization_score, 0) AS personalization_score,
  b.freshness_score, b.length_score, b.base_reason || CASE WHEN coalesce(p.personal_reason, '') <> '' THEN '; personalization: ' || p.personal_reason ELSE '' END AS selection_reason
FROM v_targets t JOIN v_base b ON b.m = t.minutes_per_article LEFT JOIN v_personal p ON p.user_id = t.user_id AND p.article_id = b.article_id"""


def walk_sql(ranked: str, order: str, name: str) -> None:
    """A recursive walk over one ranking, for the check side of budgeted selection."""
    VIEW_SQL[f"v_{name}_ranked"] = f"""
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {order}) AS i FROM {ranked}"""
    VIEW_SQL[f"v_{name}_steps"] = f"""
SELECT user_id, 0::BIGINT AS i, 0::BIGINT AS n, 0::BIGINT AS used, false AS taken FROM v_targets
UNION ALL
SELECT w.user_id, c.i, w.n + CASE WHEN ok THEN 1 ELSE 0 END, w.used + CASE WHEN ok THEN c.reading_minutes ELSE 0 END, ok
FROM v_{name}_steps w JOIN (SELECT * FROM v_{name}_ranked) c ON c.user_id = w.user_id AND c.i = w.i + 1,
  LATERAL (SELECT w.n < c.target_count AND w.used + c.reading_minutes <= c.target_minutes AS ok)"""
    VIEW_SQL[f"v_{name}"] = f"""
SELECT c.*, w.n AS rank FROM v_{name}_ranked c JOIN v_{name}_steps w USING (user_id, i) WHERE w.taken"""


walk_sql("v_totals", "total_score DESC, article_id", "list")
walk_sql("v_totals", "total_score DESC, published_at DESC, article_id", "direct")
walk_sql(
    f"(SELECT * FROM v_totals WHERE published_at >= {AS_OF_SQL} - INTERVAL 6 HOUR)",
    "total_score DESC, article_id", "firstpass",
)

# --- plans ----------------------------------------------------------------------


def daily_list(v: Views, order: str = "graph") -> DataFrame:
    """The reading list of every user: eligible articles, scored, personalised, walked."""
    scored = scoring.article_scores(v.eligible, SETTINGS, v.as_of)
    return scoring.select_lists(v.targets, scored, v.eligible_features, v.preferences, SETTINGS, order)


def explained(v: Views, rows: DataFrame) -> DataFrame:
    """The reason step reads its rows twice, so they are stored first."""
    scored = scoring.article_scores(v.eligible, SETTINGS, v.as_of)
    return scoring.selection_reasons(
        cut_lineage(rows), v.targets, scored, v.eligible_features, v.preferences, SETTINGS
    )


# --- B --------------------------------------------------------------------------

@query("b1_reading_minutes", "SELECT article_id, greatest(1, ceil(word_count / 225.0))::BIGINT AS reading_minutes FROM v_articles")
def b1(v):
    return v.articles.select("article_id", features.reading_minutes(F.col("word_count")).alias("reading_minutes"))


@query(
    "b2_hours_since",
    "SELECT event_id, " + r("greatest(0, epoch_us(TIMESTAMP '2024-01-20 00:00:00') - epoch_us(ts)) / 3.6e9", 6) + " AS age_hours FROM events",
)
def b2(v):
    as_of = clock.instant("2024-01-20 00:00:00")
    return v.table("events").select("event_id", round_to(clock.hours_since(F.col("ts"), as_of), 6).alias("age_hours"))


@query(
    "b3_combined_text",
    f"""
SELECT article_id, sha256(t) AS text_hash, length(t) AS n_chars
FROM (SELECT article_id, {fold_sql("concat_ws(chr(10), nullif(title, ''), nullif(rss_summary, ''), nullif(content_text, ''))")} AS t FROM v_articles)""",
)
def b3(v):
    text = features.combined_text(F.col("title"), F.col("rss_summary"), F.col("content_text"))
    return v.articles.select("article_id", text.alias("t")).select(
        "article_id", F.sha2("t", 256).alias("text_hash"), F.length("t").alias("n_chars")
    )


@query("b4_classify_content_type", "SELECT article_id, content_type FROM v_articles")
def b4(v):
    return v.articles.select("article_id", "content_type")


_RAW_TYPES = ("Op-Ed", " breaking news ", "How to", "In-Depth", "politics", "Guide", "Reporting", "weather", "step by step", "other")


@query(
    "b5_normalize_content_type",
    """
SELECT article_id, ['opinion', 'news', 'tutorial', 'analysis', 'news', 'tutorial', 'news', 'other', 'tutorial', 'other'][article_id % 10 + 1] AS content_type
FROM v_articles WHERE article_id % 10 NOT IN (4, 7)
UNION ALL SELECT article_id, CASE WHEN article_id % 4 = 0 THEN 'news' ELSE 'other' END FROM v_articles WHERE article_id % 10 IN (4, 7)""",
)
def b5(v):
    from newsloom.plans.views import pick

    a = F.col("article_id")
    return v.articles.select(
        "article_id",
        features.normalize_content_type(pick(_RAW_TYPES, a % 10), a % 4 == 0).alias("content_type"),
    )


_CODES = f"""
SELECT article_id, unnest(list_filter([
  CASE WHEN status <> 'extracted' THEN 'not_extracted' END,
  CASE WHEN content_text = '' THEN 'missing_content' END,
  CASE WHEN word_count < 200 THEN 'too_short' WHEN word_count > 4000 THEN 'too_long' END,
  CASE WHEN published_at < {AS_OF_SQL} - INTERVAL 48 HOUR THEN 'too_old' END,
  CASE WHEN language <> 'en' THEN 'language_not_allowed' END,
  CASE WHEN source_id IN (4, 6) THEN 'blocked_source' END], lambda x: x IS NOT NULL)) AS reason FROM v_articles"""


@query(
    "b6_hard_filter",
    f"""
SELECT article_id, coalesce(c.reasons, '') AS reasons, c.reasons IS NULL AS accepted FROM v_articles LEFT JOIN (
  SELECT article_id, string_agg(reason, ',' ORDER BY reason) AS reasons FROM ({_CODES}) GROUP BY article_id) c USING (article_id)""",
)
def b6(v):
    out = features.hard_filter(v.articles, CHOOSY, v.as_of)
    return out.select(
        "article_id",
        F.array_join(F.sort_array("rejections"), ",").alias("reasons"),
        (F.size("rejections") == 0).alias("accepted"),
    )


@query("b7_rejection_counts", f"SELECT reason, count(*) AS n FROM ({_CODES}) GROUP BY reason")
def b7(v):
    return features.rejection_counts(features.hard_filter(v.articles, CHOOSY, v.as_of))


@query("b8_article_features", "SELECT * FROM v_features")
def b8(v):
    return v.features


@query(
    "b9_missing_features",
    """
SELECT * FROM v_features WHERE feature_type <> 'topic' OR article_id NOT IN (SELECT article_id FROM v_articles WHERE content_type = 'news')""",
)
def b9(v):
    """Stored: the features of news articles, saved before topics existed."""
    news = v.articles.filter("content_type = 'news'").select("article_id")
    stored = v.features.filter("feature_type <> 'topic'").join(news, "article_id", "left_semi")
    return features.missing_features(v.articles, stored)


@query(
    "b10_merge_topics",
    """
SELECT article_id, feature_type, feature_value, confidence FROM v_features f
WHERE NOT (feature_type = 'content_type' AND article_id IN (SELECT article_id FROM v_articles WHERE status = 'extracted'))
UNION ALL SELECT article_id, 'content_type', 'analysis', 0.75 FROM v_articles WHERE status = 'extracted'
UNION ALL SELECT article_id, 'topic', t, 0.75 FROM (SELECT article_id, unnest(['space travel', 'culture', 'topic ' || source_id]) AS t FROM v_articles WHERE status = 'extracted') m
WHERE NOT EXISTS (SELECT 1 FROM v_features f WHERE f.article_id = m.article_id AND f.feature_type = 'topic' AND f.feature_value = m.t)""",
)
def b10(v):
    model = v.articles.filter("status = 'extracted'").select(
        "article_id",
        F.lit("analysis").alias("content_type"),
        F.array(F.lit(" Space Travel"), F.lit("Culture"), F.lit("space travel"), F.lit(" "),
                F.concat(F.lit("Topic "), F.col("source_id"))).alias("topics"),
        F.lit(0.75).alias("confidence"),
    )
    return features.merge_topics(v.features, model)


@query(
    "b11_content_fingerprint",
    "SELECT article_id, sha256(title || chr(10) || content_text || chr(10) || 'phase5-v2') AS input_hash FROM v_articles",
)
def b11(v):
    return v.articles.select(
        "article_id", fingerprint(F.col("title"), F.col("content_text"), F.lit(SETTINGS.prompt_version)).alias("input_hash")
    )


@query(
    "b12_local_date",
    "SELECT event_id, CAST(CAST(ts - INTERVAL 8 HOUR AS DATE) AS VARCHAR) AS local_day FROM events",
)
def b12(v):
    """January in the configured zone is UTC-8 throughout."""
    return v.table("events").select("event_id", clock.local_date(F.col("ts"), SETTINGS.timezone).alias("local_day"))


@query("b13_clamp_user_targets", "SELECT * FROM v_targets")
def b13(v):
    return v.targets


@query(
    "b14_domain_allowed",
    """
SELECT page_id, url FROM (SELECT *, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS h FROM pages)
WHERE h = 'example.org' OR h LIKE '%.example.org' OR h LIKE '%.cheap-pills.example.com' OR h = 'cheap-pills.example.com'""",
)
def b14(v):
    allowed = v.spark.createDataFrame([("www.Example.org",), ("cheap-pills.example.com",)], "domain string")
    return features.domain_allowed(v.table("pages").select("page_id", "url"), allowed)


@query(
    "b15_route_path_valid",
    """
SELECT page_id, length(p) BETWEEN 1 AND 120 AND starts_with(p, '/') AND NOT contains(p, '?') AND NOT contains(p, '#') AS valid
FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*(.*)$', 1) AS p FROM pages)""",
)
def b15(v):
    path = F.regexp_extract("url", "^[a-z]+://[^/?#]*(.*)$", 1)
    return v.table("pages").select("page_id", features.route_path_valid(path).alias("valid"))


@query(
    "b16_article_model_text",
    """
SELECT article_id, sha256(t) AS text_hash, length(t) AS n_chars FROM (
  SELECT article_id, 'Title: ' || title || chr(10) || 'Summary: ' || rss_summary || chr(10) || 'Article: ' || content_text AS t FROM v_articles)""",
)
def b16(v):
    return v.articles.select("article_id", features.article_model_text().alias("t")).select(
        "article_id", F.sha2("t", 256).alias("text_hash"), F.length("t").alias("n_chars")
    )


# --- C --------------------------------------------------------------------------

_TEXT = fold_sql("concat_ws(chr(10), nullif(title, ''), nullif(rss_summary, ''), nullif(content_text, ''))")
_MATCHES = f"list_filter({list(sorted(CHOOSY.preferred_topics))}, lambda t: contains({_TEXT}, t))"
_SOURCE = "CASE WHEN source_id IN (1, 3, 5) THEN 20.0 ELSE 5.0 END"
_FIT = "greatest(0, 10 * (1 - abs(word_count - 2100.0::DOUBLE) / 1900.0::DOUBLE))"


@query("c1_freshness_score", f"SELECT article_id, round(greatest(0, 40 * (1 - age::DOUBLE / 48)), 6) AS freshness FROM v_eligible")
def c1(v):
    return v.eligible.select("article_id", F.round(scoring.freshness_score(SETTINGS, v.as_of), 6).alias("freshness"))


@query(
    "c2_topic_score",
    f"""
SELECT article_id, array_to_string(m, ',') AS matched, round(30.0::DOUBLE * len(m) / 3, 6) AS topic
FROM (SELECT article_id, {_MATCHES} AS m FROM v_eligible)""",
)
def c2(v):
    scored = scoring.article_scores(v.eligible, CHOOSY, v.as_of)
    return scored.select("article_id", F.array_join("matched", ",").alias("matched"), F.round("topic", 6).alias("topic"))


@query("c3_source_score", f"SELECT article_id, CAST({_SOURCE} AS DOUBLE) AS source FROM v_eligible")
def c3(v):
    return scoring.article_scores(v.eligible, CHOOSY, v.as_of).select("article_id", "source")


@query(
    "c4_length_score",
    f"""
SELECT article_id, m AS minutes, round({_LENGTH}, 6) AS length, round({_FIT}, 6) AS length_default
FROM (SELECT article_id, word_count, unnest(generate_series(2, 25)) AS m FROM v_eligible)""",
)
def c4(v):
    rows = v.eligible.select("article_id", "word_count").withColumn(
        "minutes", F.explode(F.sequence(F.lit(2), F.lit(SETTINGS.max_minutes_per_article)))
    )
    words = F.col("word_count")
    return rows.select(
        "article_id", "minutes",
        F.round(scoring.length_score(words, SETTINGS, F.col("minutes")), 6).alias("length"),
        F.round(scoring.length_score(words, SETTINGS), 6).alias("length_default"),
    )


@query(
    "c5_base_score",
    f"""
SELECT article_id, {r('f + t + s + l', 2)} AS base_score, {r('f', 2)} AS freshness_score, {r('t', 2)} AS topic_score, s AS source_score, {r('l', 2)} AS length_score,
  'freshness ' || CAST(CAST({r('f', 1)} AS DECIMAL(18,1)) AS VARCHAR) || '/40; length fit ' || CAST(CAST({r('l', 1)} AS DECIMAL(18,1)) AS VARCHAR) || '/10; '
  || CASE WHEN len(m) > 0 THEN 'matched topics: ' || array_to_string(m, ', ') ELSE 'no preferred-topic match' END
  || CASE WHEN s = 20 THEN '; preferred source' ELSE '' END AS reason
FROM (SELECT article_id, greatest(0, 40 * (1 - age::DOUBLE / 48)) AS f, m, 30.0::DOUBLE * len(m) / 3 AS t, CAST({_SOURCE} AS DOUBLE) AS s, {_FIT} AS l
  FROM (SELECT *, {_MATCHES} AS m FROM v_eligible))""",
)
def c5(v):
    scored = scoring.base_score(scoring.article_scores(v.eligible, CHOOSY, v.as_of), CHOOSY)
    return scored.select(
        "article_id", "base_score", "freshness_score", "topic_score", "source_score", "length_score",
        F.col("base_reason").alias("reason"),
    )


@query("c6_personalization", "SELECT user_id, article_id, personalization_score, personal_reason FROM v_personal")
def c6(v):
    return scoring.personalization(v.eligible_features, v.preferences, SETTINGS)


@query(
    "c7_score_candidates",
    """
SELECT user_id, article_id, reading_minutes, total_score, base_score, personalization_score, freshness_score, length_score, selection_reason FROM v_totals""",
)
def c7(v):
    scored = scoring.article_scores(v.eligible, SETTINGS, v.as_of)
    found = scoring.score_candidates(v.targets, scored, v.eligible_features, v.preferences, SETTINGS, reasons=True)
    return found.select(
        "user_id", "article_id", "reading_minutes", "total_score", "base_score", "personalization_score",
        "freshness_score", "length_score", "selection_reason",
    )


_ITEM = "user_id, rank, article_id, total_score, base_score, personalization_score, reading_minutes, selection_reason"


@query("c8_budgeted_select", f"SELECT {_ITEM} FROM v_list")
def c8(v):
    return explained(v, daily_list(v)).select(*_ITEM.split(", "))


@query("c8_budgeted_select_direct", f"SELECT {_ITEM} FROM v_direct")
def c8_direct(v):
    return explained(v, daily_list(v, "direct")).select(*_ITEM.split(", "))


@query(
    "c9_list_header",
    """
SELECT t.user_id, '2024-01-31' AS list_date, t.target_count, t.target_minutes, count(l.article_id) AS actual_count,
  CAST(coalesce(sum(l.reading_minutes), 0) AS BIGINT) AS actual_minutes
FROM v_targets t LEFT JOIN v_list l USING (user_id) GROUP BY ALL""",
)
def c9(v):
    return scoring.list_header(daily_list(v), v.targets, F.to_date(v.as_of))


@query(
    "c10_expand_pool",
    """
WITH short AS (SELECT t.user_id FROM v_targets t LEFT JOIN v_firstpass f USING (user_id) GROUP BY t.user_id, t.target_count HAVING count(f.article_id) < t.target_count)
SELECT user_id, 0 AS expansion_round, rank, article_id, total_score FROM v_firstpass WHERE user_id NOT IN (SELECT user_id FROM short)
UNION ALL SELECT user_id, 1, rank, article_id, total_score FROM v_list WHERE user_id IN (SELECT user_id FROM short)""",
)
def c10(v):
    """First the articles of this run (the last six hours); users left short get
    one more pass over everything extracted."""
    scored = scoring.article_scores(v.eligible, SETTINGS, v.as_of)
    found = scoring.expand_pool(
        v.targets, scored, v.eligible_features, v.preferences, SETTINGS, v.as_of - F.expr("interval 6 hours")
    )
    return found.select("user_id", "expansion_round", "rank", "article_id", "total_score")


# --- D --------------------------------------------------------------------------

@query("d1_current_feedback", "SELECT user_id, article_id, event_group, event_id, event_type FROM v_current")
def d1(v):
    return preferences.current_feedback(v.feedback).drop("reason", "created_at")


@query("d2_feedback_attribution", "SELECT * FROM v_attribution")
def d2(v):
    return preferences.feedback_attribution(preferences.current_feedback(v.feedback), v.features)


@query(
    "d3_rebuild_preferences",
    "SELECT user_id, feature_type, feature_value, round(score, 6) AS score, confidence, positive_count, negative_count FROM v_preferences",
)
def d3(v):
    return v.preferences.withColumn("score", F.round("score", 6))


@query(
    "d4_preference_impacts",
    f"""
SELECT user_id, feature_type, feature_value, confidence, {r('score * confidence * 30', 2)} AS potential_adjustment FROM v_preferences""",
)
def d4(v):
    return preferences.preference_impacts(v.preferences, SETTINGS).select(
        "user_id", "feature_type", "feature_value", "confidence", "potential_adjustment"
    )


VIEW_SQL["v_saved"] = """
SELECT f.user_id, f.article_id, min(f.created_at) AS saved_at FROM v_feedback f LEFT JOIN (
  SELECT user_id, article_id, max((created_at, event_id)) AS cut FROM v_feedback WHERE event_type = 'unstar' GROUP BY ALL) u USING (user_id, article_id)
WHERE f.event_type = 'star' AND (u.cut IS NULL OR (f.created_at, f.event_id) > u.cut) GROUP BY ALL"""


@query("d5_saved_state", "SELECT user_id, article_id, strftime(saved_at, '%Y-%m-%d %H:%M:%S') AS saved_at FROM v_saved")
def d5(v):
    return preferences.saved_state(v.feedback)
