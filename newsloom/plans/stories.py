"""Queries E, F, G: story clusters, retrieval and claims."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from newsloom.functions.text import fingerprint, terms
from newsloom.functions.vectors import cosine
from newsloom.operators import clustering, evidence, neighbours, retrieval
from newsloom.plans.registry import query
from newsloom.plans.views import AS_OF_SQL, MODEL, SETTINGS, VIEW_SQL, cosine_sql, r

# --- E --------------------------------------------------------------------------


@query(
    "e1_inference_worklist",
    f"""
SELECT article_id // 50 AS run_id, article_id FROM v_articles WHERE status <> 'failed'""",
)
def e1(v):
    """Cached: what failed before under the same model; another model's cache does not count."""
    inputs = v.articles.select(
        "article_id", F.floor(F.col("article_id") / 50).cast("bigint").alias("run_id"),
        fingerprint(F.col("title"), F.col("content_text"), F.lit(SETTINGS.prompt_version)).alias("input_hash"),
        "status",
    )
    cached = inputs.select(
        "article_id", "input_hash", F.when(F.col("status") == "failed", MODEL).otherwise("older").alias("model")
    )
    return clustering.inference_worklist(inputs.drop("status"), cached, MODEL).select("run_id", "article_id")


def hashing_embedder(batch: pd.DataFrame) -> pd.DataFrame:
    """A deterministic stand-in for an embedding model: 64 signed term buckets."""
    out = []
    for tokens in batch["tokens"]:
        v = np.zeros(64)
        for t in tokens:
            h = sum((i + 1) * b for i, b in enumerate(t.encode())) % 128
            v[h % 64] += 1 if h < 64 else -1
        out.append(v.tolist())
    return pd.DataFrame({"article_id": batch["article_id"], "embedding": out, "model": "buckets-64"})


@query("e2_batch_model_map")
def e2(v):
    texts = v.articles.select("article_id", terms(F.col("content_text")).alias("tokens"))
    out = clustering.batch_model_map(
        texts, hashing_embedder, "article_id bigint, embedding array<double>, model string",
        SETTINGS.embedding_batch_size,
    )
    return out.select("article_id", "model", F.size("embedding").alias("dimensions"), F.round(
        F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x), 6).alias("squared_length"))


@query(
    "e3_cosine",
    f"""
SELECT e.vec_id, round({cosine_sql('e.embedding::DOUBLE[]', 'a.embedding::DOUBLE[]')}, 6) AS similarity
FROM embeddings e JOIN embeddings a ON a.vec_id = e.vec_id // 8 * 8""",
)
def e3(v):
    e = v.table("embeddings")
    first = e.filter("vec_id % 8 = 0").select(F.floor(F.col("vec_id") / 8).alias("s"), F.col("embedding").alias("anchor"))
    return e.withColumn("s", F.floor(F.col("vec_id") / 8)).join(first, "s").select(
        "vec_id", F.round(cosine(F.col("embedding"), F.col("anchor")), 6).alias("similarity")
    )


def centroid_targets(v):
    return v.clusters.select(F.col("cluster_id").alias("target_id"), "model", F.col("centroid").alias("vector"))


def vector_queries(v):
    return v.vectors.select(F.col("article_id").alias("query_id"), "model", "vector")


_KNN = f"""
SELECT article_id AS query_id, cluster_id AS target_id, round(sim, 6) AS similarity FROM (
  SELECT v.article_id, c.cluster_id, {cosine_sql('v.vector', 'c.centroid')} AS sim,
    row_number() OVER (PARTITION BY v.article_id ORDER BY {cosine_sql('v.vector', 'c.centroid')} DESC, c.cluster_id) AS n
  FROM v_vectors v CROSS JOIN v_centroids c) WHERE n <= 3"""


@query("e4_knn", _KNN)
def e4(v):
    return neighbours.nearest(vector_queries(v), centroid_targets(v), 3).withColumn("similarity", F.round("similarity", 6))


@query("e4_knn_blocked", _KNN)
def e4_blocked(v):
    """The same with few pivots and cells cut into many blocks."""
    found = neighbours.nearest(vector_queries(v), centroid_targets(v), 3, block_bytes=16 << 10)
    return found.withColumn("similarity", F.round("similarity", 6))


@query(
    "e5_assign_to_centroids",
    f"""
WITH kept AS (SELECT article_id, cluster_id FROM v_members WHERE relationship = 'redundant'),
best AS (SELECT v.article_id, c.cluster_id, {cosine_sql('v.vector', 'c.centroid')} AS sim,
    row_number() OVER (PARTITION BY v.article_id ORDER BY {cosine_sql('v.vector', 'c.centroid')} DESC, c.cluster_id) AS n
  FROM v_vectors v CROSS JOIN v_clusters c WHERE c.event_date >= CAST({AS_OF_SQL} AS DATE) - 7)
SELECT v.article_id, coalesce(k.cluster_id, b.cluster_id) AS cluster_id, CASE WHEN k.cluster_id IS NULL THEN round(b.sim, 6) END AS similarity
FROM v_vectors v LEFT JOIN kept k USING (article_id) LEFT JOIN best b ON b.article_id = v.article_id AND b.n = 1 AND b.sim >= 0.82""",
)
def e5(v):
    """Articles found redundant earlier are members already; the others look for a centroid."""
    members = v.members.filter("relationship = 'redundant'")
    out = clustering.assign_to_centroids(v.vectors, v.clusters, members, SETTINGS, v.as_of)
    return out.withColumn("similarity", F.round("similarity", 6))


def as_runs(v):
    """Runs of 24 consecutive articles, as a scheduler would hand them over."""
    return v.vectors.withColumn("run_id", F.floor(F.col("article_id") / 24).cast("bigint"))


@query(
    "e6_leader_cluster",
    "SELECT article_id, article_id // 24 AS run_id, min(article_id) OVER (PARTITION BY story_id, article_id // 24) AS cluster_id FROM v_vectors",
)
def e6(v):
    """Stories are well apart, so the sequential rule finds exactly the story of each run."""
    return clustering.leader_cluster(as_runs(v), SETTINGS).select("article_id", "run_id", "cluster_id")


@query(
    "e7_graph_cluster",
    f"""
WITH RECURSIVE edges AS (SELECT x.article_id AS a, y.article_id AS b FROM v_vectors x JOIN v_vectors y ON {cosine_sql('x.vector', 'y.vector')} >= 0.82),
reach AS (SELECT article_id AS a, article_id AS b FROM v_vectors UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b)
SELECT a AS article_id, min(b) AS cluster_id FROM reach GROUP BY a""",
)
def e7(v):
    return clustering.graph_cluster(v.vectors, SETTINGS.similarity_threshold)


@query(
    "e7_graph_cluster_recheck",
    f"""
WITH RECURSIVE edges AS (SELECT x.vec_id AS a, y.vec_id AS b FROM embeddings x JOIN embeddings y
  ON {cosine_sql('x.embedding::DOUBLE[]', 'y.embedding::DOUBLE[]')} >= 0.4),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b),
comp AS (SELECT a AS article_id, min(b) AS cluster_id FROM reach GROUP BY a),
mean AS (SELECT cluster_id, list(m ORDER BY d) AS centroid FROM (
  SELECT cluster_id, d, avg(x) AS m FROM (SELECT cluster_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS d
    FROM comp JOIN embeddings ON vec_id = article_id) GROUP BY ALL) GROUP BY ALL)
SELECT article_id, CASE WHEN {cosine_sql('e.embedding::DOUBLE[]', 'm.centroid')} >= 0.4 THEN cluster_id ELSE article_id END AS cluster_id
FROM comp JOIN mean m USING (cluster_id) JOIN embeddings e ON e.vec_id = article_id""",
)
def e7_recheck(v):
    """The raw vectors chain at a low threshold; the recheck splits the chains again."""
    raw = v.table("embeddings").select(
        F.col("vec_id").alias("article_id"), F.transform("embedding", lambda x: x.cast("double")).alias("vector")
    )
    return clustering.graph_cluster(raw, 0.4, recheck=True, block_bytes=64 << 10)


@query(
    "e8_centroid_update",
    """
SELECT cluster_id, n_members + coalesce(n, 0) AS n_members, round(list_sum(list_transform(generate_series(1, len(centroid)),
    lambda i: i * CASE WHEN added IS NULL THEN centroid[i] ELSE (centroid[i] * n_members + added[i]) / (n_members + n) END)), 6) AS weighted_sum
FROM v_centroids LEFT JOIN (
  SELECT story_id AS cluster_id, max(n) AS n, list(s ORDER BY d) AS added FROM (
    SELECT story_id, d, sum(x) AS s, count(*) AS n FROM (SELECT story_id, unnest(vector) AS x, generate_subscripts(vector, 1) AS d
      FROM v_vectors JOIN v_members USING (article_id) WHERE relationship = 'redundant') GROUP BY ALL) GROUP BY ALL) USING (cluster_id)""",
)
def e8(v):
    """Redundant members arrive once more and pull their centroids."""
    again = v.vectors.join(
        v.members.filter("relationship = 'redundant'").select("cluster_id", "article_id"), "article_id"
    ).select("cluster_id", "vector")
    out = clustering.centroid_update(v.clusters.select("cluster_id", "centroid", "n_members"), again)
    digest = F.aggregate(
        F.transform("centroid", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x
    )
    return out.select("cluster_id", "n_members", F.round(digest, 6).alias("weighted_sum"))


@query("e9_prune_members", "SELECT cluster_id, article_id, publisher_id, relationship FROM v_members")
def e9(v):
    return v.members


@query(
    "e10_cluster_status",
    """
SELECT *, CASE WHEN n_publishers >= 2 THEN 'evidence' WHEN n_active > 1 THEN 'single_source' ELSE 'singleton' END AS status FROM (
  SELECT cluster_id, count(*) FILTER (relationship = 'coverage') AS n_active,
    count(DISTINCT publisher_id) FILTER (relationship = 'coverage') AS n_publishers FROM v_members GROUP BY cluster_id)""",
)
def e10(v):
    return clustering.cluster_status(v.members)


@query(
    "e11_apply_representatives",
    """
SELECT article_id FROM v_eligible WHERE article_id NOT IN (SELECT article_id FROM v_members WHERE relationship = 'redundant')
  AND article_id NOT IN (SELECT article_id FROM v_members JOIN v_clusters USING (cluster_id) WHERE comparison_status = 'complete')
UNION SELECT representative_article_id FROM v_clusters WHERE comparison_status = 'complete'""",
)
def e11(v):
    return clustering.apply_representatives(v.eligible, v.members, v.clusters)


# --- F --------------------------------------------------------------------------


@query(
    "f1_chunk_text",
    "SELECT article_id, chunk_index, sha256(chunk_text) AS content_hash, word_count, character_start, character_end FROM v_chunks",
)
def f1(v):
    return retrieval.chunk_text(v.articles.filter("status = 'extracted'"), SETTINGS).drop("chunk_text")


VIEW_SQL["v_doc_terms"] = """
SELECT doc_id, regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[a-z0-9]+') AS terms FROM documents"""


@query(
    "f2_tokenize",
    "SELECT doc_id, len(terms) AS n_terms, len(list_distinct(terms)) AS n_distinct, sha256(array_to_string(terms, ' ')) AS terms_hash FROM v_doc_terms",
)
def f2(v):
    return v.table("documents").select("doc_id", terms(F.col("text")).alias("t")).select(
        "doc_id", F.size("t").alias("n_terms"), F.size(F.array_distinct("t")).alias("n_distinct"),
        F.sha2(F.array_join("t", " "), 256).alias("terms_hash"),
    )


def bm25_sql(docs: str, queries: str, group: str, doc: str) -> str:
    """BM25 over ``docs(group, doc, text)`` and ``queries(group, text)``."""
    tokens = "regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[a-z0-9]+')"
    return f"""
SELECT d.{group}, d.{doc}, coalesce(s.score, 0) AS score FROM {docs} d LEFT JOIN (
  SELECT {group}, {doc}, sum(ln(1 + (n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE
      / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / CASE WHEN avg_dl = 0 THEN 1 ELSE avg_dl END))) AS score
  FROM (SELECT *, count(*) OVER (PARTITION BY {group}, term) AS df FROM (
    SELECT {group}, {doc}, dl, term, count(*) AS tf FROM (
      SELECT {group}, {doc}, len(t) AS dl, unnest(t) AS term FROM (SELECT {group}, {doc}, {tokens} AS t FROM {docs}))
    JOIN (SELECT DISTINCT {group}, unnest({tokens}) AS term FROM {queries}) USING ({group}, term) GROUP BY ALL))
  JOIN (SELECT {group}, count(*) AS n_docs, avg(len({tokens})) AS avg_dl FROM {docs} GROUP BY {group}) USING ({group})
  GROUP BY {group}, {doc}) s ON s.{group} = d.{group} AND s.{doc} = d.{doc}"""


def scaled_sql(scores: str, group: str) -> str:
    return f"""
SELECT *, CASE WHEN abs(hi - lo) <= 1e-9 * greatest(abs(hi), abs(lo)) THEN CASE WHEN hi > 0 THEN 1 ELSE 0 END ELSE (score - lo) / (hi - lo) END AS scaled
FROM (SELECT *, min(score) OVER (PARTITION BY {group}) AS lo, max(score) OVER (PARTITION BY {group}) AS hi FROM ({scores}))"""


def vector_score_sql(vector: str, centroid: str) -> str:
    return (
        f"CASE WHEN {vector} IS NOT NULL AND {centroid} IS NOT NULL "
        f"THEN greatest(0, least(1, ({cosine_sql(vector, centroid)} + 1) / 2)) ELSE 0 END"
    )


VIEW_SQL["v_queries"] = """
SELECT c.cluster_id, array_to_string(list_filter(list_concat([c.representative_title, c.event_summary], t.titles), lambda x: coalesce(x, '') <> ''), ' ') AS text
FROM v_clusters c JOIN (
  SELECT cluster_id, list(title ORDER BY first_id) AS titles FROM (
    SELECT cluster_id, title, min(article_id) AS first_id FROM v_members JOIN v_articles USING (article_id) WHERE relationship = 'coverage' GROUP BY cluster_id, title)
  GROUP BY cluster_id) t USING (cluster_id)"""
VIEW_SQL["v_corpus"] = "SELECT cluster_id, article_id, chunk_id, chunk_text AS text FROM v_cluster_chunks"
VIEW_SQL["v_bm25"] = bm25_sql("v_corpus", "v_queries", "cluster_id", "chunk_id")
VIEW_SQL["v_scaled"] = scaled_sql("SELECT * FROM v_bm25", "cluster_id")
VIEW_SQL["v_hybrid"] = f"""
SELECT k.cluster_id, k.article_id, k.chunk_id, k.chunk_index, s.scaled AS bm25_score, {vector_score_sql('k.vector', 'c.centroid')} AS vector_score,
  round(0.4::DOUBLE * s.scaled + 0.6::DOUBLE * {vector_score_sql('k.vector', 'c.centroid')}, 9) AS hybrid_score
FROM v_cluster_chunks k JOIN v_scaled s USING (cluster_id, chunk_id) JOIN v_centroids c USING (cluster_id)"""
VIEW_SQL["v_retrieved"] = """
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY tier, hybrid_score DESC, chunk_id) AS rank FROM (
    SELECT *, CASE WHEN row_number() OVER (PARTITION BY cluster_id, article_id ORDER BY hybrid_score DESC, chunk_id) = 1 THEN 0 ELSE 1 END AS tier FROM v_hybrid))
WHERE rank <= 20"""


def cluster_queries(v):
    return retrieval.cluster_query(v.clusters, v.members, v.articles)


def cluster_corpus(v):
    return v.cluster_chunks.select("cluster_id", "article_id", "chunk_id", F.col("chunk_text").alias("text"))


@query("f3_bm25", "SELECT cluster_id, chunk_id, round(score, 6) AS score FROM v_bm25")
def f3(v):
    out = retrieval.bm25(cluster_corpus(v), cluster_queries(v), ["cluster_id"], ["article_id", "chunk_id"])
    return out.select("cluster_id", "chunk_id", F.round("score", 6).alias("score"))


@query("f4_minmax", "SELECT cluster_id, chunk_id, round(scaled, 6) AS scaled FROM v_scaled")
def f4(v):
    out = retrieval.bm25(cluster_corpus(v), cluster_queries(v), ["cluster_id"], ["article_id", "chunk_id"])
    return retrieval.minmax(out, ["cluster_id"]).select("cluster_id", "chunk_id", F.round("scaled", 6).alias("scaled"))


def retrieved(v, settings=SETTINGS):
    return retrieval.hybrid_retrieve(v.cluster_chunks, cluster_queries(v), v.clusters, settings)


@query(
    "f5_hybrid_score",
    """
SELECT cluster_id, chunk_id, round(hybrid_score, 6) AS hybrid_score, round(bm25_score, 6) AS bm25_score, round(vector_score, 6) AS vector_score FROM v_hybrid""",
)
def f5(v):
    """All chunks of the stories: the limit is set to the most a story can have."""
    from dataclasses import replace

    out = retrieved(v, replace(SETTINGS, retrieval_chunk_limit=1 << 30))
    return out.select(
        "cluster_id", "chunk_id",
        *[F.round(c, 6).alias(c) for c in ("hybrid_score", "bm25_score", "vector_score")],
    )


@query("f6_coverage_first_topk", "SELECT cluster_id, article_id, chunk_id, rank, round(hybrid_score, 6) AS hybrid_score FROM v_retrieved")
def f6(v):
    return retrieved(v).select("cluster_id", "article_id", "chunk_id", "rank", F.round("hybrid_score", 6).alias("hybrid_score"))


@query("f7_cluster_query", "SELECT cluster_id, text FROM v_queries")
def f7(v):
    return cluster_queries(v)


VIEW_SQL["v_searches"] = f"""
SELECT m.article_id AS search_id, m.article_id, m.cluster_id, a.title AS query, CASE WHEN m.article_id % 2 = 0 THEN DATE '2024-01-28' END AS start_date,
  CASE WHEN m.article_id % 3 = 0 THEN DATE '2024-01-30' END AS end_date
FROM v_members m JOIN v_articles a USING (article_id) WHERE m.article_id = m.cluster_id * 8"""
VIEW_SQL["v_scope"] = """
SELECT s.search_id, s.cluster_id, c.article_id, c.chunk_id, c.chunk_text AS text, c.vector, m.relationship
FROM v_searches s JOIN v_members m ON m.cluster_id = s.cluster_id AND m.article_id <> s.article_id JOIN v_articles a ON a.article_id = m.article_id
JOIN v_chunks c ON c.article_id = m.article_id
WHERE (s.start_date IS NULL OR a.published_at >= s.start_date) AND (s.end_date IS NULL OR a.published_at < s.end_date + INTERVAL 1 DAY)"""
VIEW_SQL["v_asked"] = "SELECT search_id, query AS text FROM v_searches"
VIEW_SQL["v_search_scores"] = scaled_sql(bm25_sql("v_scope", "v_asked", "search_id", "chunk_id"), "search_id")


@query(
    "f8_local_search",
    f"""
SELECT search_id, article_id, chunk_id, relationship, rank, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY tier, rel, score DESC, chunk_id) AS rank FROM (
    SELECT *, CASE WHEN row_number() OVER (PARTITION BY search_id, article_id ORDER BY rel, score DESC, chunk_id) = 1 THEN 0 ELSE 1 END AS tier FROM (
      SELECT k.search_id, k.article_id, k.chunk_id, k.relationship, CASE WHEN k.relationship = 'coverage' THEN 0 ELSE 1 END AS rel,
        round(0.4::DOUBLE * s.scaled + 0.6::DOUBLE * {vector_score_sql('k.vector', 'c.centroid')}, 9) AS score
      FROM v_scope k JOIN v_search_scores s ON s.search_id = k.search_id AND s.chunk_id = k.chunk_id JOIN v_centroids c ON c.cluster_id = k.cluster_id)))
WHERE rank <= 5""",
)
def f8(v):
    """One search per story: its first article looks for background."""
    a = F.col("article_id")
    searches = (
        v.members.filter(a == F.col("cluster_id") * 8).select("article_id")
        .join(v.articles.select("article_id", "title"), "article_id")
        .select(
            a.alias("search_id"), "article_id", F.col("title").alias("query"),
            F.when(a % 2 == 0, F.lit("2024-01-28").cast("date")).alias("start_date"),
            F.when(a % 3 == 0, F.lit("2024-01-30").cast("date")).alias("end_date"),
        )
    )
    out = retrieval.local_search(searches, v.members, v.chunks, v.articles, v.clusters, SETTINGS)
    return out.select("search_id", "article_id", "chunk_id", "relationship", "rank", F.round("score", 6).alias("score"))


VIEW_SQL["v_pieces"] = """
SELECT doc_id, c AS chunk_index, ltrim(array_to_string(list_slice(p, c * 290 + 1, c * 290 + 350), ''), E' \\n') AS text
FROM (SELECT doc_id, p, unnest(generate_series(0, greatest(0, CAST(ceil((len(p) - 350) / 290.0) AS BIGINT)))) AS c
      FROM (SELECT doc_id, regexp_extract_all(text, '\\s*\\S+') AS p FROM documents) WHERE len(p) > 0)"""
VIEW_SQL["v_doc_queries"] = "SELECT doc_id, substr(text, 1, 80) AS text FROM documents"
VIEW_SQL["v_piece_scores"] = bm25_sql("v_pieces", "v_doc_queries", "doc_id", "chunk_index")


@query(
    "f9_best_excerpt",
    """
SELECT doc_id, chunk_index, sha256(text) AS excerpt_hash FROM v_pieces JOIN (
  SELECT doc_id, chunk_index FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, chunk_index) AS n FROM v_piece_scores) WHERE n = 1)
USING (doc_id, chunk_index)""",
)
def f9(v):
    """A document's query is its first 80 characters."""
    documents = v.table("documents").select("doc_id", "text", F.substring("text", 1, 80).alias("query"))
    return retrieval.best_excerpt(documents).select(
        "doc_id", "chunk_index", F.sha2("excerpt", 256).alias("excerpt_hash")
    )


@query(
    "f10_collect_excerpt",
    """
SELECT run_id, content_hash, arg_min(article_id, chunk_id) AS article_id FROM (
  SELECT *, sha256('https://pub.example.com/' || publisher_id || chr(10) || excerpt) AS content_hash FROM (
    SELECT c.article_id % 10 AS run_id, c.article_id, c.chunk_id, a.publisher_id, array_to_string(list_slice(regexp_extract_all(c.chunk_text, '\\S+'), 1, 40), ' ') AS excerpt
    FROM v_chunks c JOIN v_articles a USING (article_id)))
WHERE content_hash NOT IN (SELECT sha256('https://pub.example.com/' || publisher_id || chr(10) || array_to_string(list_slice(regexp_extract_all(content_text, '\\S+'), 1, 40), ' '))
  FROM v_articles WHERE status = 'extracted' AND source_id = 3)
GROUP BY run_id, content_hash""",
)
def f10(v):
    """Articles of one feed were collected before; equal excerpts of one publisher count once."""
    base = v.articles.filter("status = 'extracted'")
    url = F.concat(F.lit("https://pub.example.com/"), F.col("publisher_id"))
    stored = retrieval.collect_excerpt(
        base.filter("source_id = 3").select(
            F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(9).cast("bigint"))).alias("run_id"),
            F.col("article_id").alias("found_order"), url.alias("url"), F.col("content_text").alias("text"),
        ),
        None, 40,
    )
    found = v.chunks.join(base.select("article_id", "publisher_id"), "article_id").select(
        (F.col("article_id") % 10).alias("run_id"), F.col("chunk_id").alias("found_order"), "article_id",
        url.alias("url"), F.col("chunk_text").alias("text"),
    )
    return retrieval.collect_excerpt(found, stored, 40).select("run_id", "content_hash", "article_id")


# --- G --------------------------------------------------------------------------

VIEW_SQL["v_shown"] = """
SELECT a.article_id, coalesce(p.shown, a.content_text) AS shown FROM v_articles a LEFT JOIN (
  SELECT article_id, string_agg(k.chunk_text, E'\\n\\n' ORDER BY chunk_index) AS shown FROM (SELECT article_id, chunk_id FROM v_retrieved) JOIN v_chunks k USING (article_id, chunk_id)
  GROUP BY article_id) p USING (article_id)"""


def norm_sql(x: str) -> str:
    return f"trim(regexp_replace(replace(lower({x}), 'ß', 'ss'), '\\s+', ' ', 'g'), ' ')"


def shown(v):
    text = v.chunks.select("chunk_id", "chunk_index", "chunk_text")
    chosen = retrieved(v).select("article_id", "chunk_id").join(text, "chunk_id")
    return evidence.shown_text(v.articles.select("article_id", "content_text"), chosen)


@query(
    "g1_ground_claims",
    f"""
SELECT c.claim_id, c.article_id, sha256(replace(lower(c.claim_text), 'ß', 'ss')) AS claim_hash FROM v_claims c JOIN v_shown s USING (article_id)
WHERE contains({norm_sql('s.shown')}, {norm_sql('c.supporting_excerpt')})""",
)
def g1(v):
    claims = v.claims.select("claim_id", "article_id", "claim_text", "supporting_excerpt")
    return evidence.ground_claims(claims, shown(v)).select("claim_id", "article_id", "claim_hash")


@query(
    "g2_jaccard",
    """
SELECT doc_id, round(coalesce(len(list_intersect(x, y)) / nullif(len(list_distinct(list_concat(x, y))), 0), 0), 6) AS similarity FROM (
  SELECT d.doc_id, list_distinct(regexp_extract_all(replace(lower(d.text), 'ß', 'ss'), '[a-z0-9]+')) AS x,
    list_distinct(regexp_extract_all(replace(lower(b.text), 'ß', 'ss'), '[a-z0-9]+')) AS y
  FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % 40)""",
)
def g2(v):
    docs = v.table("documents").select("doc_id", terms(F.col("text")).alias("x"), (F.col("doc_id") % 40).alias("item_id"))
    items = v.table("benchmark").select("item_id", terms(F.col("text")).alias("y"))
    return docs.join(items, "item_id").select("doc_id", F.round(evidence.jaccard(F.col("x"), F.col("y")), 6).alias("similarity"))


@query("g3_claim_pairs", "SELECT cluster_id, left_claim_id, right_claim_id, publisher_low, publisher_high, round(score, 6) AS score FROM v_all_pairs")
def g3(v):
    return evidence.claim_pairs(v.claims, v.members).select(
        "cluster_id", "left_claim_id", "right_claim_id", "publisher_low", "publisher_high", F.round("score", 6).alias("score")
    )


@query("g4_select_pairs", "SELECT cluster_id, rank, left_claim_id, right_claim_id, round(score, 6) AS score FROM v_pairs")
def g4(v):
    return v.pairs.select("cluster_id", "rank", "left_claim_id", "right_claim_id", F.round("score", 6).alias("score"))


@query("g5_pair_batches", "SELECT cluster_id, batch, count(*) AS n_pairs, min(rank) AS first_rank FROM v_pairs GROUP BY ALL")
def g5(v):
    return v.pairs.groupBy("cluster_id", "batch").agg(F.count("*").alias("n_pairs"), F.min("rank").alias("first_rank"))


@query("g6_valid_links", "SELECT cluster_id, left_claim_id, right_claim_id, relationship, round(confidence, 6) AS confidence FROM v_links")
def g6(v):
    return v.links.select("cluster_id", "left_claim_id", "right_claim_id", "relationship", F.round("confidence", 6).alias("confidence"))


VIEW_SQL["v_representatives"] = f"""
SELECT cluster_id, article_id AS representative_article_id, evidence_score, n_claims, word_count FROM (
  SELECT e.*, a.word_count, row_number() OVER (PARTITION BY cluster_id ORDER BY evidence_score DESC, n_claims DESC, word_count DESC, article_id) AS n
  FROM v_evidence e JOIN v_articles a USING (article_id)) WHERE n = 1"""


@query(
    "g7_choose_representative",
    f"""
SELECT cluster_id, representative_article_id, round(evidence_score, 6) AS evidence_score,
  'evidence_score=' || CAST(CAST({r('evidence_score', 3)} AS DECIMAL(18,3)) AS VARCHAR) || ', extracted_claims=' || n_claims || ', word_count=' || word_count AS selection_reason
FROM v_representatives""",
)
def g7(v):
    scores = evidence.article_evidence(v.claims, v.pairs, v.links)
    return evidence.choose_representative(scores, v.articles).withColumn("evidence_score", F.round("evidence_score", 6))


@query(
    "g8_comparison_summary",
    """
SELECT w.cluster_id, w.n_articles, coalesce(p.n_pairs, 0) AS n_pairs, coalesce(l.s, 0) AS shared_claim_count, coalesce(l.d, 0) AS disputed_claim_count,
  coalesce(l.u, 0) AS unsupported_claim_count, round(coalesce(p.c, 0), 6) AS confidence,
  CASE WHEN p.n_pairs IS NULL THEN 'insufficient_evidence' ELSE 'complete' END AS status
FROM (SELECT c.cluster_id, count(DISTINCT c.article_id) AS n_articles FROM v_claims c JOIN v_members m USING (article_id) WHERE m.relationship = 'coverage' GROUP BY ALL) w
LEFT JOIN (SELECT cluster_id, sum(n)::BIGINT AS n_pairs, avg(0.5 + ((cluster_id + batch) % 5) / 10.0) AS c FROM (SELECT cluster_id, batch, count(*) AS n FROM v_pairs GROUP BY ALL) GROUP BY ALL) p USING (cluster_id)
LEFT JOIN (SELECT cluster_id, count(*) FILTER (relationship IN ('equivalent', 'supports')) AS s, count(*) FILTER (relationship = 'contradicts') AS d,
  count(*) FILTER (relationship = 'unrelated') AS u FROM v_links GROUP BY ALL) l USING (cluster_id) WHERE w.n_articles >= 2""",
)
def g8(v):
    batches = v.pairs.select("cluster_id", "batch").distinct().withColumn(
        "confidence", F.lit(0.5) + ((F.col("cluster_id") + F.col("batch")) % 5) / 10.0
    )
    out = evidence.comparison_summary(v.claims, v.members, v.pairs, v.links, batches)
    return out.withColumn("confidence", F.round("confidence", 6))
