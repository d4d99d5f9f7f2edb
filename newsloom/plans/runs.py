"""Queries H, I and J: supplements, retention, usage and run metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import round_to
from newsloom.operators import analytics, grounding, retention
from newsloom.operators.grounding import COVERAGE_AREAS
from newsloom.plans.registry import query
from newsloom.plans.views import AS_OF_SQL, SETTINGS, VIEW_SQL, r

# --- H --------------------------------------------------------------------------


@query(
    "h1_supplement_budget",
    "SELECT article_id, CAST(floor(word_count * 0.5) AS BIGINT) AS word_budget FROM v_articles WHERE content_type = 'news'",
)
def h1(v):
    kinds = v.articles.select("article_id", (F.col("content_type") == "news").alias("is_news"))
    items = v.articles.select("article_id", "word_count")
    return grounding.supplement_budget(items, kinds, SETTINGS).select("article_id", "word_budget")


AREA_SQL = "[" + ", ".join(f"'{a}'" for a in COVERAGE_AREAS) + "]"
VIEW_SQL["v_decisions"] = f"""
SELECT run_id, turn // 2 + 1 AS iteration, {AREA_SQL}[a + 1] AS area, (run_id + turn + a) % 3 <> 0 AS needed,
  [turn_id - 1, turn_id - 1, turn_id - 1 - 2 * a, run_id * 1000 + 999] AS evidence_ids
FROM (SELECT *, unnest([0, 1, 2, 3]) AS a FROM v_turns WHERE role = 'assistant')"""
VIEW_SQL["v_ledger_steps"] = """
SELECT run_id, area, 0::BIGINT AS n, []::BIGINT[] AS ids, false AS satisfied FROM (SELECT DISTINCT run_id, area FROM v_decisions)
UNION ALL
SELECT s.run_id, s.area, d.n, list_sort(list_distinct(list_concat(s.ids, list_slice(d.cited, 1, greatest(0, 3 - len(s.ids)))))), s.satisfied OR NOT d.needed
FROM v_ledger_steps s JOIN v_cited d ON d.run_id = s.run_id AND d.area = s.area AND d.n = s.n + 1"""
VIEW_SQL["v_cited"] = """
SELECT d.run_id, d.area, d.needed, row_number() OVER (PARTITION BY d.run_id, d.area ORDER BY d.iteration) AS n,
  list_filter(d.evidence_ids, lambda x: list_contains(coalesce(e.ids, []), x)) AS cited
FROM v_decisions d LEFT JOIN (SELECT run_id, list(evidence_id) AS ids FROM v_research WHERE trusted GROUP BY run_id) e USING (run_id)"""
VIEW_SQL["v_ledger"] = """
SELECT run_id, area, is_target, CASE WHEN is_target THEN ids ELSE [] END AS ids, is_target AND satisfied AS satisfied FROM (
  SELECT run_id, area, arg_max(ids, n) AS ids, arg_max(satisfied, n) AS satisfied FROM v_ledger_steps GROUP BY ALL)
JOIN (SELECT run_id, area, coalesce(bool_or(needed) FILTER (iteration = 1), false) AS is_target FROM v_decisions GROUP BY ALL) USING (run_id, area)"""
VIEW_SQL["v_ledger_status"] = """
SELECT run_id, area, CASE WHEN NOT is_target THEN 'not_needed' WHEN satisfied THEN 'satisfied' WHEN len(ids) >= 3 THEN 'max_target_reached' ELSE 'search_needed' END AS status,
  greatest(0, 3 - len(ids)) AS remaining_slots FROM v_ledger"""


def decisions(v) -> DataFrame:
    """Per assistant turn a decision on each area, citing some ids twice and some unknown ones."""
    from newsloom.plans.views import pick

    t, a = F.col("turn_id"), F.col("a")
    return (
        v.turns.filter("role = 'assistant'")
        .withColumn("a", F.explode(F.array(*[F.lit(i) for i in range(len(COVERAGE_AREAS))])))
        .select(
            "run_id",
            (F.floor(F.col("turn") / 2) + 1).alias("iteration"),
            pick(COVERAGE_AREAS, a).alias("area"),
            ((F.col("run_id") + F.col("turn") + a) % 3 != 0).alias("needed"),
            F.array(t - 1, t - 1, t - 1 - 2 * a, F.col("run_id") * 1000 + 999).alias("evidence_ids"),
        )
    )


def ledger(v) -> DataFrame:
    return grounding.coverage_ledger(decisions(v), v.trusted, SETTINGS)


@query("h2_coverage_ledger", "SELECT run_id, area, is_target, satisfied, array_to_string(ids, ',') AS evidence_ids FROM v_ledger")
def h2(v):
    return ledger(v).withColumn("evidence_ids", F.array_join(F.col("evidence_ids").cast("array<string>"), ","))


@query("h3_ledger_status", "SELECT * FROM v_ledger_status")
def h3(v):
    return grounding.ledger_status(ledger(v), SETTINGS)


@query("h3_research_complete", "SELECT run_id, bool_and(status <> 'search_needed') AS research_complete FROM v_ledger_status GROUP BY run_id")
def h3_complete(v):
    return grounding.research_complete(grounding.ledger_status(ledger(v), SETTINGS))


@query(
    "h4_verification_contract",
    """
SELECT run_id, card_index, statement_index, CASE WHEN v.run_id IS NULL THEN 'missing' ELSE 'unexpected' END AS problem, NULL::BIGINT AS evidence_id
FROM v_statements s FULL OUTER JOIN v_verification v USING (run_id, card_index, statement_index) WHERE s.run_id IS NULL OR v.run_id IS NULL
UNION ALL
SELECT DISTINCT run_id, card_index, statement_index, 'invalid_citation', id FROM (
  SELECT run_id, card_index, statement_index, s.evidence_ids AS drafted, unnest(v.evidence_ids) AS id FROM v_statements s JOIN v_verification v USING (run_id, card_index, statement_index)) c
WHERE NOT list_contains(drafted, id) OR NOT EXISTS (SELECT 1 FROM v_research r WHERE r.trusted AND r.run_id = c.run_id AND r.evidence_id = c.id)""",
)
def h4(v):
    return grounding.verification_contract(v.statements, v.verification, v.trusted)


@query(
    "h5_supported_statements",
    "SELECT run_id, card_index, statement_index, card_type, text, n_words, array_to_string(cited, ',') AS cited FROM v_kept",
)
def h5(v):
    return v.kept_statements.withColumn("cited", F.array_join(F.col("cited").cast("array<string>"), ","))


VIEW_SQL["v_cards"] = """
SELECT run_id, card_index, any_value(card_type) AS card_type, 'Card ' || card_index AS heading, string_agg(text, E'\\n\\n' ORDER BY statement_index) AS summary_text,
  CAST(sum(n_words) AS BIGINT) AS word_count, row_number() OVER (PARTITION BY run_id ORDER BY card_index) AS display_order, count(*) AS n_statements
FROM v_kept GROUP BY run_id, card_index"""
VIEW_SQL["v_citations"] = """
SELECT run_id, card_index, statement_index, unnest(cited) AS evidence_id, generate_subscripts(cited, 1) AS citation_order FROM v_kept"""


@query("h6_assemble_cards", "SELECT * FROM v_cards")
def h6(v):
    return grounding.assemble_cards(v.kept_statements, v.draft_cards)


@query("h6_card_citations", "SELECT * FROM v_citations")
def h6_citations(v):
    return grounding.card_citations(v.kept_statements)


def supplement_runs(v) -> DataFrame:
    run = F.col("run_id")
    status = F.when(run % 9 == 0, "failed").when(run % 5 == 0, "skipped").when(run % 4 == 0, "insufficient").otherwise("complete")
    return v.budgets.select("run_id", status.alias("status"))


@query(
    "h7_supplement_stats",
    """
SELECT count(*) FILTER (s = 'complete') AS complete, count(*) FILTER (s = 'skipped') AS skipped, count(*) FILTER (s = 'insufficient') AS insufficient,
  count(*) FILTER (s = 'failed') AS failed, (SELECT count(*) FROM v_research) AS evidence_items, (SELECT count(*) FROM v_cards) AS cards
FROM (SELECT CASE WHEN run_id % 9 = 0 THEN 'failed' WHEN run_id % 5 = 0 THEN 'skipped' WHEN run_id % 4 = 0 THEN 'insufficient' ELSE 'complete' END AS s FROM v_budgets)""",
)
def h7(v):
    return grounding.supplement_stats(supplement_runs(v), v.research, grounding.assemble_cards(v.kept_statements, v.draft_cards))


# --- I --------------------------------------------------------------------------

VIEW_SQL["v_chosen"] = "SELECT article_id FROM v_eligible"
VIEW_SQL["v_chosen_clusters"] = "SELECT DISTINCT cluster_id FROM v_members WHERE article_id IN (SELECT article_id FROM v_chosen)"
_KEPT = f"{AS_OF_SQL} + INTERVAL 30 DAY"


def _extended(table: str, key: str, chosen: str, ident: str) -> str:
    return f"""
SELECT '{table}' AS table_name, CAST({ident} AS BIGINT) AS row_id, strftime(CASE WHEN {key} IN (SELECT {key} FROM {chosen}) THEN {_KEPT} ELSE expires_at END, '%Y-%m-%d %H:%M:%S') AS expires_at
FROM v_{table}"""


@query(
    "i1_extend_retention",
    " UNION ALL ".join([
        _extended("chunks", "article_id", "v_chosen", "chunk_id"),
        _extended("claims", "cluster_id", "v_chosen_clusters", "claim_id"),
        _extended("links", "cluster_id", "v_chosen_clusters", "left_claim_id * 1000000 + right_claim_id"),
        _extended("clusters", "cluster_id", "v_chosen_clusters", "cluster_id"),
    ]),
)
def i1(v):
    """Eligible articles stand for the selected ones: their chunks, and all evidence of their stories."""
    chosen = v.eligible.select("article_id")
    clusters = retention.selected_clusters(v.members, chosen)
    tables = (
        ("chunks", v.chunks, "article_id", chosen, F.col("chunk_id")),
        ("claims", v.claims, "cluster_id", clusters, F.col("claim_id")),
        ("links", v.links, "cluster_id", clusters, F.col("left_claim_id") * 1000000 + F.col("right_claim_id")),
        ("clusters", v.clusters, "cluster_id", clusters, F.col("cluster_id")),
    )
    parts = [
        retention.extend_retention(
            df.select(key, ident.alias("row_id"), "expires_at"), by, key, SETTINGS, v.as_of
        ).select(F.lit(name).alias("table_name"), "row_id", "expires_at")
        for name, df, key, by, ident in tables
    ]
    return reduce(DataFrame.unionByName, parts)


def _expiry_sql(table: str) -> str:
    return (
        f"SELECT '{table}' AS table_name, count(*) FILTER (expires_at < {AS_OF_SQL}) AS n_expired, "
        f"count(*) FILTER (expires_at >= {AS_OF_SQL}) AS n_kept FROM v_{table}"
    )


@query("i2_drop_expired", " UNION ALL ".join(_expiry_sql(t) for t in ("links", "claims", "chunks", "model_calls", "clusters")))
def i2(v):
    tables = {"links": v.links, "claims": v.claims, "chunks": v.chunks, "model_calls": v.model_calls, "clusters": v.clusters}
    return retention.expired_counts(tables, v.as_of)


@query("i2_drop_expired_rows", f"SELECT call_id, run_id FROM v_model_calls WHERE expires_at >= {AS_OF_SQL}")
def i2_rows(v):
    return retention.drop_expired(v.model_calls, v.as_of).select("call_id", "run_id")


@query("i3_usage_retention", f"SELECT event_id FROM v_usage WHERE created_at >= {AS_OF_SQL} - INTERVAL 20 DAY")
def i3(v):
    return retention.usage_retention(v.usage, 20, v.as_of).select("event_id")


# --- J --------------------------------------------------------------------------

@query("j1_visitor_hash", "SELECT event_id, visitor_hash FROM v_usage")
def j1(v):
    return v.usage.select("event_id", "visitor_hash")


_USAGE = "count(*) AS page_views, count(DISTINCT visitor_hash) AS unique_visitors, count(DISTINCT user_id) AS signed_in_users"


@query("j2_usage_totals", f"SELECT {_USAGE} FROM v_usage WHERE created_at >= {AS_OF_SQL} - INTERVAL 14 DAY")
def j2(v):
    return analytics.usage_totals(v.usage, 14, v.as_of)


@query(
    "j3_usage_daily",
    f"SELECT CAST(CAST(created_at AS DATE) AS VARCHAR) AS day, {_USAGE} FROM v_usage WHERE created_at >= {AS_OF_SQL} - INTERVAL 14 DAY GROUP BY 1",
)
def j3(v):
    return analytics.usage_daily(v.usage, 14, v.as_of)


@query(
    "j4_run_event_stats",
    """
SELECT run_id, key, CAST(k AS VARCHAR) AS value, k AS number FROM v_stats
UNION ALL SELECT run_id, 'note', CAST(arg_max(k, event_id) AS VARCHAR), NULL FROM v_run_events GROUP BY run_id""",
)
def j4(v):
    return analytics.run_event_stats(analytics.event_values(v.run_events))


@query("j5_node_time", "SELECT run_id, node_name, round(seconds, 6) AS seconds, attempts FROM v_times")
def j5(v):
    return analytics.node_time(v.run_events).withColumn("seconds", F.round("seconds", 6))


def volumes(v) -> DataFrame:
    values = analytics.event_values(v.run_events)
    return analytics.node_volume(values, analytics.run_event_stats(values), analytics.node_time(v.run_events), v.runs)


@query("j6_node_volume", "SELECT * FROM v_volumes")
def j6(v):
    return volumes(v)


def steps(v) -> DataFrame:
    return analytics.seconds_per_unit(analytics.node_time(v.run_events), volumes(v))


@query(
    "j7_seconds_per_unit",
    f"SELECT run_id, node_name, {r('seconds', 6)} AS seconds, attempts, volume, {r('seconds_per_unit', 6)} AS seconds_per_unit FROM v_steps",
)
def j7(v):
    return steps(v).withColumns({c: round_to(F.col(c), 6) for c in ("seconds", "seconds_per_unit")})


VIEW_SQL["v_latest"] = """
SELECT *, row_number() OVER (ORDER BY run_id) AS slot FROM (SELECT * FROM v_runs WHERE status = 'complete' ORDER BY created_at DESC, run_id DESC LIMIT 5)"""
VIEW_SQL["v_metrics"] = """
SELECT run_id, 'run.wall_clock_seconds' AS metric, epoch_us(completed_at - started_at) / 1e6 AS value FROM v_runs
UNION ALL SELECT run_id, 'run.selected_articles', selected_count FROM v_runs
UNION ALL SELECT run_id, 'node.' || node_name || '.seconds', seconds FROM v_steps
UNION ALL SELECT run_id, 'node.' || node_name || '.volume', volume FROM v_steps
UNION ALL SELECT run_id, 'node.' || node_name || '.attempts', attempts FROM v_steps
UNION ALL SELECT run_id, 'node.' || node_name || '.seconds_per_unit', seconds_per_unit FROM v_steps"""


@query(
    "j8_run_summary_pivot",
    "SELECT metric, "
    + ", ".join(f"{r(f'max(value) FILTER (slot = {i})', 6)} AS run_{i}" for i in range(1, 6))
    + f", {r('avg(value)', 6)} AS average FROM v_metrics JOIN v_latest USING (run_id) GROUP BY metric",
)
def j8(v):
    out = analytics.run_summary_pivot(analytics.run_metrics(v.runs, steps(v)), analytics.latest_runs(v.runs, 5), 5)
    return out.select("metric", *[round_to(F.col(c), 6).alias(c) for c in out.columns if c != "metric"])


@query(
    "j9_model_role_rollup",
    """
SELECT run_id, role, count(*) AS responses, round(coalesce(sum(elapsed_ms), 0) / 1000, 6) AS total_response_seconds, round(avg(elapsed_ms) / 1000, 6) AS average_response_seconds,
  CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS output_tokens FROM v_model_calls GROUP BY run_id, role""",
)
def j9(v):
    out = analytics.model_role_rollup(v.model_calls)
    return out.withColumns({c: F.round(c, 6) for c in ("total_response_seconds", "average_response_seconds")})


_CALLS = """
count(*) AS request_count, CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS output_tokens,
CAST(round(CAST(coalesce(sum(elapsed_ms), 0) AS DECIMAL(28,6)), 1) AS DOUBLE) AS elapsed_ms FROM v_model_calls"""


@query("j10_model_call_rollup", f"SELECT role, provider, model, status, {_CALLS} GROUP BY role, provider, model, status")
def j10(v):
    return analytics.model_call_rollup(v.model_calls)


@query("j10_model_call_totals", f"SELECT role, provider, model, status, {_CALLS} GROUP BY ROLLUP (role, provider, model, status)")
def j10_totals(v):
    return analytics.model_call_rollup(v.model_calls, "rollup")


@query("j11_run_wall_seconds", "SELECT run_id, round(epoch_us(completed_at - started_at) / 1e6, 6) AS wall_seconds FROM v_runs")
def j11(v):
    return analytics.run_wall_seconds(v.runs).select("run_id", F.round("wall_seconds", 6).alias("wall_seconds"))


@query("j12_latest_runs", "SELECT run_id, selected_count, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM v_latest")
def j12(v):
    return analytics.latest_runs(v.runs, 5).select("run_id", "selected_count", "created_at")


@query("j13_attempt_number", "SELECT run_id, node_name, max(event_id % 4) + 1 AS next_attempt FROM v_run_events GROUP BY ALL")
def j13(v):
    return analytics.attempt_number(v.run_events.withColumn("attempt", F.col("event_id") % 4))
