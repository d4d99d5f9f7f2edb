"""Queries K: quality metrics over planted labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.functions.text import word_count
from newsloom.operators import clustering, quality, retrieval
from newsloom.plans.registry import query
from newsloom.plans.stories import as_runs, cluster_corpus, cluster_queries, norm_sql, retrieved, shown
from newsloom.plans.views import SETTINGS, VIEW_SQL

SWEEP = (0.70, 0.75, 0.80, 0.82, 0.85, 0.88, 0.90, 0.92, 0.95)

# The raw labels against blocks of ten ids: a clustering with every kind of error.
VIEW_SQL["v_labeled"] = "SELECT vec_id, label AS expected, vec_id // 10 AS predicted FROM embeddings"


def labeled(v):
    return v.table("embeddings").select(
        "vec_id", F.col("label").alias("expected"), F.floor(F.col("vec_id") / 10).cast("bigint").alias("predicted")
    )


def rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


@query(
    "k1_pairwise_cluster_metrics",
    """
WITH p AS (SELECT count(*) FILTER (e AND q) AS tp, count(*) FILTER (NOT e AND q) AS fp, count(*) FILTER (e AND NOT q) AS fn, count(*) FILTER (NOT e AND NOT q) AS tn FROM (
  SELECT x.expected = y.expected AS e, x.predicted = y.predicted AS q FROM v_labeled x JOIN v_labeled y ON x.vec_id < y.vec_id))
SELECT tp AS true_positive, fp AS false_positive, fn AS false_negative, tn AS true_negative, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall,
  round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) AS f1, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy FROM p""",
)
def k1(v):
    return rounded(quality.pairwise_cluster_metrics(labeled(v)), "precision", "recall", "f1", "accuracy")


@query(
    "k2_purity",
    """
SELECT count(*) AS n_clusters, round(sum(top) / sum(size), 6) AS purity FROM (
  SELECT predicted, max(n) AS top, sum(n) AS size FROM (SELECT predicted, expected, count(*) AS n FROM v_labeled GROUP BY ALL) GROUP BY predicted)""",
)
def k2(v):
    return rounded(quality.purity(labeled(v)), "purity")


@query(
    "k2_majority_label",
    """
SELECT predicted, label, n_label, n FROM (SELECT predicted, expected AS label, count(*) AS n_label, CAST(sum(count(*)) OVER (PARTITION BY predicted) AS BIGINT) AS n,
  row_number() OVER (PARTITION BY predicted ORDER BY count(*) DESC, expected) AS place FROM v_labeled GROUP BY predicted, expected) WHERE place = 1""",
)
def k2_majority(v):
    return quality.majority_label(labeled(v))


@query("k3_threshold_sweep")
def k3(v):
    """Nine thresholds at once; clusters of one run are scored against the planted stories."""
    found = clustering.threshold_sweep(as_runs(v), SWEEP, SETTINGS)
    truth = v.vectors.select("article_id", F.col("story_id").alias("expected"))
    scored = found.join(truth, "article_id").select(
        "threshold", "expected", F.col("cluster_id").alias("predicted")
    )
    by = ("threshold",)
    return rounded(
        quality.pairwise_cluster_metrics(scored, by).join(quality.purity(scored, by), "threshold"),
        "precision", "recall", "f1", "accuracy", "purity",
    )


@query(
    "k1_story_metrics",
    """
SELECT 0 AS false_positive, 0 AS false_negative, 1.0 AS precision, 1.0 AS recall, 1.0 AS f1, 1.0 AS accuracy""",
)
def k1_story(v):
    """The graph clustering finds the planted stories exactly."""
    out = quality.pairwise_cluster_metrics(v.labeled)
    return rounded(out, "precision", "recall", "f1", "accuracy").drop("true_positive", "true_negative")


@query(
    "k4_classification_metrics",
    """
WITH c AS (SELECT quality AS e, CASE WHEN word_count >= 100 THEN 1 ELSE 0 END AS p FROM labels JOIN v_articles ON article_id = doc_id),
l AS (SELECT DISTINCT unnest([e, p]) AS label FROM c),
s AS (SELECT label, (SELECT count(*) FROM c WHERE e = label AND p = label) AS tp, (SELECT count(*) FROM c WHERE p = label) AS np, (SELECT count(*) FROM c WHERE e = label) AS ne FROM l)
SELECT round(sum(tp) / sum(ne), 6) AS accuracy, round(avg(coalesce(2.0::DOUBLE * tp / nullif(np + ne, 0), 0)), 6) AS macro_f1, count(*) AS n_labels FROM s""",
)
def k4(v):
    """A length rule as the classifier of the given quality labels."""
    docs = v.table("documents").select("doc_id", (word_count(F.col("text")) >= 100).cast("int").alias("predicted"))
    pairs = v.table("labels").join(docs, "doc_id").select(F.col("quality").alias("expected"), "predicted")
    return rounded(quality.classification_metrics(pairs), "accuracy", "macro_f1")


VIEW_SQL["v_run_ranking"] = """
SELECT cluster_id AS query_id, chunk_id AS item_id, row_number() OVER (PARTITION BY cluster_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM v_bm25"""
VIEW_SQL["v_relevant"] = "SELECT cluster_id AS query_id, chunk_id AS item_id FROM v_retrieved WHERE rank <= 3"


@query(
    "k5_retrieval_metrics",
    """
SELECT query_id, round(hits / returned, 6) AS precision_at_k, round(coalesce(hits / nullif(n, 0), 0), 6) AS recall_at_k, round(coalesce(1.0::DOUBLE / first_hit, 0), 6) AS mrr FROM (
  SELECT q.query_id, count(*) FILTER (q.rank <= 2) AS returned, count(*) FILTER (q.rank <= 2 AND r.item_id IS NOT NULL) AS hits, min(q.rank) FILTER (r.item_id IS NOT NULL) AS first_hit
  FROM v_run_ranking q LEFT JOIN v_relevant r ON r.query_id = q.query_id AND r.item_id = q.item_id GROUP BY q.query_id)
LEFT JOIN (SELECT query_id, count(*) AS n FROM v_relevant GROUP BY query_id) USING (query_id)""",
)
def k5(v):
    """BM25 alone, judged by the three best hybrid results of each story."""
    from pyspark.sql import Window

    scores = retrieval.bm25(cluster_corpus(v), cluster_queries(v), ["cluster_id"], ["article_id", "chunk_id"])
    place = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc(F.round("score", 9)), "chunk_id"))
    ranked = scores.select(F.col("cluster_id").alias("query_id"), F.col("chunk_id").alias("item_id"), place.alias("rank"))
    relevant = retrieved(v).filter("rank <= 3").select(
        F.col("cluster_id").alias("query_id"), F.col("chunk_id").alias("item_id")
    )
    return rounded(quality.retrieval_metrics(ranked, relevant, 2), "precision_at_k", "recall_at_k", "mrr")


@query("k6_claim_recall")
def k6(v):
    """Expected claims: the first and last word of every extracted claim."""
    parts = F.split(F.trim("claim_text"), " ")
    expected = v.claims.select(
        "article_id", F.col("claim_id").alias("expected_id"),
        F.array(F.get(parts, F.lit(0)), F.element_at(parts, -1)).alias("required_terms"),
    )
    predicted = v.claims.select("article_id", "claim_id", "claim_text", F.col("supporting_excerpt").alias("excerpt"))
    return rounded(quality.claim_recall(expected, predicted), "recall", "match_precision")


@query(
    "k7_grounding_rate",
    f"""
SELECT count(*) AS n_claims, count(*) FILTER (ok) AS n_grounded, round(count(*) FILTER (ok) / count(*), 6) AS grounding_rate FROM (
  SELECT contains({norm_sql('s.shown')}, {norm_sql('c.supporting_excerpt')}) AS ok FROM v_claims c JOIN v_shown s USING (article_id))""",
)
def k7(v):
    return rounded(quality.grounding_rate(v.claims.select("article_id", "supporting_excerpt"), shown(v)), "grounding_rate")


@query(
    "k8_link_accuracy",
    """
SELECT expected, count(*) AS n_pairs, count(*) FILTER (predicted = 'missing') AS n_missing, round(avg(CASE WHEN expected = predicted THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy FROM (
  SELECT ['equivalent', 'supports', 'contradicts', 'related', 'unrelated'][(p.left_claim_id + p.right_claim_id) % 5 + 1] AS expected, coalesce(l.relationship, 'missing') AS predicted
  FROM v_pairs p LEFT JOIN (SELECT * FROM v_links WHERE confidence > 0.6) l ON l.left_claim_id = least(p.left_claim_id, p.right_claim_id) AND l.right_claim_id = greatest(p.left_claim_id, p.right_claim_id))
GROUP BY expected""",
)
def k8(v):
    """Only confident links count as given."""
    from newsloom.plans.views import RELATIONSHIPS, pick

    low, high = F.least("left_claim_id", "right_claim_id"), F.greatest("left_claim_id", "right_claim_id")
    expected = v.pairs.select(
        low.alias("left_claim_id"), high.alias("right_claim_id"), pick(RELATIONSHIPS, (low + high) % 5).alias("relationship")
    )
    return rounded(quality.link_accuracy(expected, v.links.filter("confidence > 0.6")), "accuracy")


@query(
    "k9_gap_f1",
    """
WITH e AS (SELECT DISTINCT run_id, area FROM v_decisions WHERE iteration = 1 AND needed), p AS (SELECT DISTINCT run_id, area FROM v_decisions WHERE iteration = 2 AND needed),
c AS (SELECT (SELECT count(*) FROM e JOIN p USING (run_id, area)) AS tp, (SELECT count(*) FROM p ANTI JOIN e USING (run_id, area)) AS fp, (SELECT count(*) FROM e ANTI JOIN p USING (run_id, area)) AS fn)
SELECT tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2.0::DOUBLE * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""",
)
def k9(v):
    """Do the gaps of the second iteration repeat those of the first?"""
    from newsloom.plans.runs import decisions

    gaps = decisions(v).filter("needed").select(F.col("run_id").alias("case_id"), F.col("area").alias("gap"), "iteration")
    out = quality.gap_f1(gaps.filter("iteration = 1"), gaps.filter("iteration = 2"))
    return rounded(out, "precision", "recall", "f1")
