"""Queries L: read queries over the derived tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.operators import evidence, grounding, preferences, reports
from newsloom.plans.lists import daily_list
from newsloom.plans.registry import query
from newsloom.plans.runs import supplement_runs
from newsloom.plans.views import AS_OF_SQL, VIEW_SQL
from newsloom.session import cut_lineage

STAMP = "'%Y-%m-%d %H:%M:%S'"


@query(
    "l1_list_articles",
    f"""
SELECT article_id, title, strftime(published_at, {STAMP}) AS published_at FROM v_articles WHERE status = 'extracted'
ORDER BY v_articles.published_at DESC NULLS LAST, article_id LIMIT 50 OFFSET 25""",
)
def l1(v):
    out = reports.list_articles(v.articles, status="extracted", offset=25, limit=50)
    return out.select("article_id", "title", "published_at")


@query(
    "l2_list_clusters",
    """
SELECT cluster_id, CAST(event_date AS VARCHAR) AS event_date, representative_title, comparison_status,
  (SELECT count(*) FROM v_members m WHERE m.cluster_id = c.cluster_id) AS member_count
FROM v_clusters c ORDER BY c.event_date DESC, cluster_id DESC LIMIT 50""",
)
def l2(v):
    out = reports.list_clusters(v.clusters, v.members)
    return out.select("cluster_id", "event_date", "representative_title", "comparison_status", "member_count")


@query(
    "l3_cluster_detail",
    """
SELECT cluster_id, 'member' AS section, article_id AS item_id, NULL::BIGINT AS other_id, relationship AS text, NULL::DOUBLE AS confidence FROM v_members
UNION ALL SELECT cluster_id, 'claim', claim_id, article_id, claim_text, round(confidence, 6) FROM v_claims
UNION ALL SELECT cluster_id, 'link', left_claim_id, right_claim_id, relationship, round(confidence, 6) FROM v_links
UNION ALL SELECT cluster_id, 'comparison', representative_article_id, NULL,
  'evidence_score=' || CAST(CAST(CAST(round(CAST(evidence_score AS DECIMAL(28,10)), 3) AS DOUBLE) AS DECIMAL(18,3)) AS VARCHAR) || ', extracted_claims=' || n_claims || ', word_count=' || word_count,
  NULL FROM v_representatives""",
)
def l3(v):
    chosen = evidence.choose_representative(evidence.article_evidence(v.claims, v.pairs, v.links), v.articles)
    out = reports.cluster_detail(v.clusters, v.members, v.claims, v.links, chosen)
    return out.withColumn("confidence", F.round("confidence", 6))


@query(
    "l4_my_model_calls",
    """
SELECT user_id, call_id, run_id, role, place FROM (SELECT c.*, row_number() OVER (PARTITION BY r.user_id ORDER BY c.created_at DESC, c.call_id DESC) AS place
  FROM v_model_calls c JOIN v_runs r USING (run_id)) WHERE place <= 20""",
)
def l4(v):
    out = reports.my_model_calls(v.model_calls.drop("user_id"), v.runs, 20)
    return out.select("user_id", "call_id", "run_id", "role", "place")


@query(
    "l5_feedback_history",
    """
SELECT user_id, event_id, article_id, event_type, place FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, event_id DESC) AS place FROM v_feedback) WHERE place <= 20""",
)
def l5(v):
    return reports.feedback_history(v.feedback, 20).select("user_id", "event_id", "article_id", "event_type", "place")


@query(
    "l5_saved_articles",
    f"SELECT user_id, article_id, title, strftime(saved_at, {STAMP}) AS saved_at FROM v_saved JOIN v_articles USING (article_id)",
)
def l5_saved(v):
    return reports.saved_articles(preferences.saved_state(v.feedback), v.articles).select(
        "user_id", "article_id", "title", "saved_at"
    )


def dated_items(v):
    """Lists of two dates: short targets get yesterday's list, the others today's. Stored, as both are read twice."""
    day = F.date_sub(F.to_date(v.as_of), (F.col("target_count") % 2).cast("int"))
    return cut_lineage(daily_list(v).withColumn("list_date", day))


VIEW_SQL["v_dated"] = f"SELECT *, CAST({AS_OF_SQL} AS DATE) - CAST(target_count % 2 AS INT) AS list_date FROM v_list"


@query(
    "l6_newest_list_content",
    """
SELECT d.user_id, d.rank, a.title, a.canonical_url, length(a.content_text) AS n_chars FROM v_dated d JOIN v_articles a USING (article_id)
WHERE d.list_date = (SELECT max(list_date) FROM v_dated)""",
)
def l6(v):
    items = dated_items(v).select("user_id", "list_date", "rank", "article_id")
    sized = v.articles.withColumn("n_chars", F.length("content_text"))
    out = reports.newest_list_content(items, sized, ("title", "canonical_url", "n_chars"))
    return out.select("user_id", "rank", "title", "canonical_url", "n_chars")


@query(
    "l7_list_report",
    """
SELECT user_id, CAST(list_date AS VARCHAR) AS list_date, count(*) OVER (PARTITION BY user_id) AS actual_count, rank, article_id, a.title, total_score, freshness_score, length_score
FROM v_dated d JOIN v_articles a USING (article_id)""",
)
def l7(v):
    items = dated_items(v)
    lists = items.groupBy("user_id", "list_date").agg(F.count("*").alias("actual_count"))
    return reports.list_report(lists, items, v.articles).select(
        "user_id", "list_date", "actual_count", "rank", "article_id", "title", "total_score", "freshness_score", "length_score"
    )


@query(
    "l8_claims_per_run",
    """
SELECT r.run_id, c.cluster_id, c.article_id, count(*) AS extracted_claims FROM v_claims c JOIN v_runs r ON c.created_at BETWEEN r.started_at AND r.completed_at GROUP BY ALL""",
)
def l8(v):
    return reports.claims_per_run(v.claims, v.runs)


@query(
    "l9_links_per_run",
    """
SELECT r.run_id, l.cluster_id, l.relationship, count(*) AS evaluated_pairs FROM v_links l JOIN v_runs r ON l.created_at BETWEEN r.started_at AND r.completed_at GROUP BY ALL""",
)
def l9(v):
    return reports.links_per_run(v.links, v.runs)


@query(
    "l10_run_chunks",
    """
SELECT t.run_id, t.cluster_id, k.article_id, a.title, k.chunk_index, k.word_count, k.chunk_text AS chunk_preview, len(k.vector) AS embedding_dimensions
FROM (SELECT DISTINCT r.run_id, c.article_id, c.cluster_id FROM v_claims c JOIN v_runs r ON c.created_at BETWEEN r.started_at AND r.completed_at) t
JOIN v_chunks k USING (article_id) JOIN v_articles a USING (article_id)""",
)
def l10(v):
    return reports.run_chunks(v.claims, v.runs, v.chunks, v.articles).select(
        "run_id", "cluster_id", "article_id", "title", "chunk_index", "word_count", "chunk_preview", "embedding_dimensions"
    )


@query(
    "l11_claim_link_report",
    """
SELECT l.cluster_id, x.claim_text AS left_claim, y.claim_text AS right_claim, l.relationship FROM v_links l
JOIN v_claims x ON x.claim_id = l.left_claim_id JOIN v_claims y ON y.claim_id = l.right_claim_id""",
)
def l11(v):
    return reports.claim_link_report(v.links, v.claims).select("cluster_id", "left_claim", "right_claim", "relationship")


@query(
    "l12_supplement_report",
    """
SELECT r.run_id AS item_id, c.display_order, c.heading, t.statement_index, t.citation_order, e.evidence_id, e.text AS evidence_excerpt
FROM v_budgets r LEFT JOIN v_cards c USING (run_id) LEFT JOIN v_citations t USING (run_id, card_index) LEFT JOIN v_research e USING (run_id, evidence_id)""",
)
def l12(v):
    items = v.budgets.select(F.col("run_id").alias("item_id"))
    runs = supplement_runs(v).withColumn("item_id", F.col("run_id"))
    out = reports.supplement_report(
        items, runs, grounding.assemble_cards(v.kept_statements, v.draft_cards),
        grounding.card_citations(v.kept_statements), v.research,
    )
    return out.select(
        "item_id", "display_order", "heading", "statement_index", "citation_order", "evidence_id", "evidence_excerpt"
    )


@query(
    "l13_feed_catalog",
    """
SELECT p.publisher_id, p.name AS publisher, p.enabled AS publisher_enabled, s.source_id, s.name AS feed, s.category, s.feed_url, s.enabled AS feed_enabled
FROM v_publishers p JOIN v_sources s USING (publisher_id)""",
)
def l13(v):
    return reports.feed_catalog(v.publishers, v.sources)


@query("l14_extraction_failures", "SELECT article_id, title, canonical_url FROM v_articles WHERE status = 'failed'")
def l14(v):
    return reports.extraction_failures(v.articles).select("article_id", "title", "canonical_url")


@query(
    "l15_comparison_report",
    f"""
SELECT r.cluster_id, a.title AS selected_article, strftime(c.created_at, {STAMP}) AS created_at FROM v_representatives r
JOIN v_articles a ON a.article_id = r.representative_article_id JOIN v_clusters c USING (cluster_id)""",
)
def l15(v):
    scores = evidence.article_evidence(v.claims, v.pairs, v.links)
    chosen = evidence.choose_representative(scores, v.articles).join(v.clusters.select("cluster_id", "created_at"), "cluster_id")
    return reports.comparison_report(chosen, v.articles).select("cluster_id", "selected_article", "created_at")


@query(
    "l16_recent_usage",
    f"SELECT event_id, user_id, path, strftime(created_at, {STAMP}) AS created_at FROM v_usage ORDER BY v_usage.created_at DESC, event_id DESC LIMIT 100",
)
def l16(v):
    return reports.recent_usage(v.usage).select("event_id", "user_id", "path", "created_at")
