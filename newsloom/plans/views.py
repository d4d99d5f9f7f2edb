"""Derived views: news-shaped tables over the given ones, in Spark and in SQL.

The input tables hold documents, pages, vectors, events and conversations. The
views give them the column names of articles, feeds, feedback, claims and runs.
Both spellings of a view must agree; ``VIEW_SQL`` is the check side.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import clock
from newsloom.functions.text import word_count
from newsloom.operators import clustering, evidence, features, preferences, retrieval
from newsloom.operators.analytics import NODE_COUNTERS, visitor_hash
from newsloom.session import cut_lineage
from newsloom.settings import Settings
from newsloom.sources.tables import read_table

AS_OF_TEXT = "2024-01-31 00:00:00"
AS_OF_SQL = f"TIMESTAMP '{AS_OF_TEXT}'"
SETTINGS = Settings()
MODEL = "embed-64"

CATEGORIES = ("business", "science", "sports", "culture")
SECTIONS = ("world", "opinion", "analysis", "how-to", "guide", "video")
EVENT_TYPES = {
    "click": "like", "error": "dislike", "view": "open", "signup": "complete", "purchase": "star",
}
RELATIONSHIPS = ("equivalent", "supports", "contradicts", "related", "unrelated")
# A step and the counter its events report.
STEP_KEYS = tuple(
    (node, keys[0] if keys else "round_1_database_candidates" if node == "expand_sources"
     else "supplements_complete" if node == "supplement" else "loaded")
    for node, keys in NODE_COUNTERS.items()
)


def pick(values, at):
    """``values[at]`` as an expression."""
    return F.get(F.array(*[F.lit(v) for v in values]), at.cast("int"))


class Views:
    """Views over one folder of tables.

    Most are lazy. What a deployment stores between its steps (clusters, their
    members and chunks, claim pairs and links) is written out once here too, so
    that a query over them plans and runs from the stored rows.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.as_of = clock.instant(AS_OF_TEXT)

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.folder, name)

    @cached_property
    def sources(self) -> DataFrame:
        sid = F.col("source_id")
        return (
            self.table("documents").select(F.substring("source", 4, 10).cast("bigint").alias("source_id"))
            .distinct()
            .select(
                "source_id",
                (sid % 7).alias("publisher_id"),
                F.concat(F.lit("feed "), sid).alias("name"),
                pick(CATEGORIES, sid % 4).alias("category"),
                (sid % 11 != 0).alias("enabled"),
                F.when(
                    sid % 9 != 0,
                    F.concat(F.lit("https://Pub"), sid % 7, F.lit(".example.com"),
                             F.when(sid % 2 == 0, "/").otherwise("")),
                ).alias("site_url"),
                F.concat(F.lit("https://pub.example.com/feed/"), sid).alias("feed_url"),
            )
        )

    @cached_property
    def publishers(self) -> DataFrame:
        pid = F.col("publisher_id")
        return self.sources.select("publisher_id").distinct().select(
            "publisher_id", F.concat(F.lit("publisher "), pid).alias("name"), (pid != 5).alias("enabled")
        )

    @cached_property
    def articles(self) -> DataFrame:
        doc = F.col("doc_id")
        base = self.table("documents").select(
            doc.alias("article_id"),
            F.substring("source", 4, 10).cast("bigint").alias("source_id"),
            F.substring("text", 1, 80).alias("title"),
            F.substring("text", 81, 120).alias("rss_summary"),
            F.col("text").alias("content_text"),
            F.col("lang").alias("language"),
            (self.as_of - F.make_dt_interval(F.lit(0), (doc % 96).cast("int"))).alias("published_at"),
            word_count(F.col("text")).alias("word_count"),
            F.when(doc % 17 == 0, "failed").otherwise("extracted").alias("status"),
            F.sha2("text", 256).alias("content_hash"),
            pick(SECTIONS, doc % 6).alias("section"),
        )
        url = F.concat(F.lit("https://src"), F.col("source_id"), F.lit(".example.com/"),
                       F.col("section"), F.lit("/"), F.col("article_id"))
        return (
            base.withColumn("publisher_id", F.col("source_id") % 7)
            .withColumn("category", pick(CATEGORIES, F.col("source_id") % 4))
            .withColumn("discovered_at", F.col("published_at") + F.expr("interval 1 hour"))
            .withColumn("canonical_url", url)
            .withColumn(
                "content_type", features.classify_content_type(F.col("title"), F.col("canonical_url"))
            )
            .drop("section")
        )

    @cached_property
    def eligible(self) -> DataFrame:
        return cut_lineage(features.eligible(self.articles, SETTINGS, self.as_of))

    @cached_property
    def eligible_features(self) -> DataFrame:
        return cut_lineage(features.article_features(self.eligible))

    @cached_property
    def features(self) -> DataFrame:
        return features.article_features(self.articles)

    @cached_property
    def users(self) -> DataFrame:
        """Raw targets, some out of bounds."""
        u = F.col("user_id")
        return self.table("events").select("user_id").distinct().select(
            "user_id",
            (u % 13 - 1).cast("int").alias("daily_list_length"),
            (u % 30).cast("int").alias("minutes_per_article"),
        )

    @cached_property
    def targets(self) -> DataFrame:
        return features.clamp_user_targets(self.users)

    @cached_property
    def feedback(self) -> DataFrame:
        e = F.col("event_id")
        kind = F.lit(None).cast("string")
        for given, ours in EVENT_TYPES.items():
            kind = F.when(F.col("event_type") == given, ours).otherwise(kind)
        kind = F.when((F.col("event_type") == "purchase") & (e % 4 == 0), "unstar").otherwise(kind)
        return self.table("events").select(
            "event_id", "user_id",
            F.get_json_object("props", "$.k").cast("bigint").alias("article_id"),
            kind.alias("event_type"),
            F.when(e % 25 == 0, "topic_science").alias("reason"),
            F.col("ts").alias("created_at"),
        )

    @cached_property
    def preferences(self) -> DataFrame:
        current = preferences.current_feedback(self.feedback)
        # All events, not the current ones: what no event is left for finds no row below, and the events are shuffled once.
        named = self.features.join(self.feedback.select("article_id").distinct(), "article_id", "left_semi")
        return cut_lineage(preferences.rebuild_preferences(preferences.feedback_attribution(current, named)))

    @cached_property
    def usage(self) -> DataFrame:
        visitor = F.col("user_id").cast("string")
        return self.table("events").filter("event_type IN ('view', 'click')").select(
            "event_id",
            F.when(F.col("event_id") % 3 != 0, F.col("user_id")).alias("user_id"),
            visitor_hash(visitor).alias("visitor_hash"),
            F.lit("page_view").alias("event_type"),
            F.concat(F.lit("/"), F.col("event_type")).alias("path"),
            F.col("ts").alias("created_at"),
        )

    @cached_property
    def run_events(self) -> DataFrame:
        """A run is one user's day; its events step through the known nodes."""
        e = F.col("event_id")
        node = pick([n for n, _ in STEP_KEYS], e % len(STEP_KEYS))
        key = pick([k for _, k in STEP_KEYS], e % len(STEP_KEYS))
        k = F.get_json_object("props", "$.k")
        return self.table("events").select(
            "event_id", "user_id",
            (F.col("user_id") * 100 + F.dayofmonth("ts")).alias("run_id"),
            node.alias("node_name"),
            F.col("value").alias("elapsed_ms"),
            F.concat(F.lit('{"'), key, F.lit('": '), k, F.lit(', "note": "'), k, F.lit('"}')).alias("message"),
            F.when(e % 20 == 0, "failed").otherwise("complete").alias("status"),
            F.col("ts").alias("created_at"),
        )

    @cached_property
    def runs(self) -> DataFrame:
        r = F.col("run_id")
        return self.run_events.groupBy("run_id", "user_id").agg(
            F.min("created_at").alias("started_at"), F.max("created_at").alias("last_at")
        ).select(
            "run_id", "user_id", "started_at",
            F.when(r % 13 != 0, F.col("last_at")).alias("completed_at"),
            F.when(r % 13 == 0, "running").when(r % 7 == 0, "failed").otherwise("complete").alias("status"),
            (r % 11).alias("selected_count"),
            F.col("started_at").alias("created_at"),
        )

    @cached_property
    def model_calls(self) -> DataFrame:
        e = F.col("event_id")
        return self.table("events").select(
            e.alias("call_id"), "user_id",
            (F.col("user_id") * 100 + F.dayofmonth("ts")).alias("run_id"),
            F.col("event_type").alias("role"),
            F.concat(F.lit("provider "), e % 2).alias("provider"),
            F.concat(F.lit("model "), e % 3).alias("model"),
            F.when(e % 20 == 0, "failed").otherwise("success").alias("status"),
            F.when(e % 6 != 0, F.floor("value").cast("bigint")).alias("input_tokens"),
            (e % 50).alias("output_tokens"),
            F.when(e % 9 != 0, F.col("value")).alias("elapsed_ms"),
            F.col("ts").alias("created_at"),
            (F.col("ts") + F.make_dt_interval(F.lit(7))).alias("expires_at"),
        )

    @cached_property
    def vectors(self) -> DataFrame:
        """Stories of eight vectors around the first one."""
        own = self.table("embeddings").select(
            F.col("vec_id").alias("article_id"),
            F.floor(F.col("vec_id") / 8).cast("bigint").alias("story_id"),
            "embedding",
        )
        anchor = own.filter("article_id = story_id * 8").select("story_id", F.col("embedding").alias("anchor"))
        w = F.when(F.col("article_id") % 8 == 7, 6.0).otherwise(3.0)
        return own.join(anchor, "story_id").select(
            "article_id", "story_id",
            F.zip_with("anchor", "embedding", lambda a, b: a.cast("double") * w + b.cast("double")).alias("vector"),
            F.when(F.col("story_id") % 5 == 0, F.lit(0).cast("bigint")).otherwise(F.col("article_id") % 3)
            .alias("publisher_id"),
            F.date_sub(F.to_date(self.as_of), (F.col("story_id") % 10).cast("int")).alias("event_date"),
            F.lit(MODEL).alias("model"),
        )

    @cached_property
    def clusters(self) -> DataFrame:
        """One cluster per story, named by its first article."""
        means = clustering.centroids_of(self.vectors.select(F.col("story_id").alias("cluster_id"), "vector"))
        c = F.col("cluster_id")
        first = self.articles.select(
            "article_id", F.col("title").alias("representative_title"), F.col("rss_summary").alias("event_summary")
        )
        return cut_lineage(
            means.withColumn("article_id", c * 8)
            .join(first, "article_id", "left")
            .select(
                "cluster_id", "centroid", "n_members", "representative_title", "event_summary",
                F.date_sub(F.to_date(self.as_of), (c % 10).cast("int")).alias("event_date"),
                pick(("complete", "pending", "singleton"), c % 3).alias("comparison_status"),
                F.col("article_id").alias("representative_article_id"),
                F.lit(MODEL).alias("model"),
                (self.as_of - F.make_dt_interval(F.lit(0), (c % 48).cast("int"))).alias("created_at"),
                (self.as_of + F.make_dt_interval((c % 9 - 4).cast("int"))).alias("expires_at"),
            )
        )

    @cached_property
    def members(self) -> DataFrame:
        return cut_lineage(
            clustering.prune_members(
                self.vectors.withColumnRenamed("story_id", "cluster_id"), self.clusters, SETTINGS
            )
        )

    @cached_property
    def chunks(self) -> DataFrame:
        pieces = retrieval.chunk_text(self.articles.filter("status = 'extracted'"), SETTINGS)
        return (
            pieces.withColumn("chunk_id", F.col("article_id") * 1000 + F.col("chunk_index"))
            .join(self.vectors.select("article_id", "vector"), "article_id", "left")
            .withColumn("expires_at", self.as_of + F.make_dt_interval((F.col("article_id") % 7 - 3).cast("int")))
        )

    @cached_property
    def cluster_chunks(self) -> DataFrame:
        active = self.members.filter("relationship = 'coverage'").select("cluster_id", "article_id")
        return cut_lineage(self.chunks.join(active, "article_id"))

    @cached_property
    def claims(self) -> DataFrame:
        """Stand-in for model output: every distinct sentence of every article, the longest first."""
        # Cut behind every end mark: one pass, also over long text without any.
        pieces = F.filter(
            F.split("content_text", r"\n|(?<=[.!?])"), lambda s: (F.length(s) > 1) & F.right(s, F.lit(1)).isin(".", "!", "?")
        )
        sentences = F.array_distinct(F.transform(pieces, lambda s: F.trim(s)))
        longest = F.sort_array(F.transform(sentences, lambda s: F.struct((-F.length(s)).alias("n"), s.alias("s"))))
        cid = F.col("claim_id")
        return (
            self.articles.select("article_id", "content_text")
            .join(
                self.vectors.select("article_id", F.col("story_id").alias("cluster_id"), "publisher_id", "vector"),
                "article_id",
            )
            .select("article_id", "cluster_id", "publisher_id", "vector", F.posexplode(longest).alias("k", "row"))
            # An article has fewer than 2^24 sentences: Spark's arrays and strings end before that.
            .withColumn("claim_id", F.shiftleft("article_id", 24) + F.col("k"))
            .select(
                "claim_id", "article_id", "cluster_id", "publisher_id",
                F.col("row.s").alias("claim_text"),
                F.when(cid % 6 == 0, F.concat(F.lit("made up "), F.col("row.s"))).otherwise(F.upper("row.s"))
                .alias("supporting_excerpt"),
                (F.lit(0.5) + (cid % 5) / 10.0).alias("confidence"),
                F.when(cid % 10 != 0, F.col("vector")).alias("vector"),
                (self.as_of - F.make_dt_interval(F.lit(0), (cid % 700).cast("int"))).alias("created_at"),
                (self.as_of + F.make_dt_interval((cid % 11 - 5).cast("int"))).alias("expires_at"),
            )
        )

    @cached_property
    def pairs(self) -> DataFrame:
        return cut_lineage(evidence.select_pairs(evidence.claim_pairs(self.claims, self.members), SETTINGS))

    @cached_property
    def raw_links(self) -> DataFrame:
        """Stand-in for model output: an answer per pair, some asked in no batch or given twice."""
        both = F.col("left_claim_id") + F.col("right_claim_id")
        rows = self.pairs.select(
            "cluster_id", "batch", "left_claim_id", "right_claim_id",
            F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("link_order"),
        )
        order = F.col("link_order")
        return rows.filter((order != 1) | (both % 2 == 0)).select(
            "cluster_id",
            F.when(order == 2, F.col("batch") + 1).otherwise(F.col("batch")).alias("batch"),
            "link_order",
            F.when(order == 1, F.col("right_claim_id")).otherwise(F.col("left_claim_id")).alias("left_claim_id"),
            F.when(order == 1, F.col("left_claim_id")).otherwise(F.col("right_claim_id")).alias("right_claim_id"),
            pick(RELATIONSHIPS, (both + order) % 5).alias("relationship"),
            (F.lit(0.5) + (both % 6) / 12.0).alias("confidence"),
        )

    @cached_property
    def links(self) -> DataFrame:
        both = F.col("left_claim_id") + F.col("right_claim_id")
        return cut_lineage(evidence.valid_links(self.raw_links, self.pairs).select(
            "*",
            (self.as_of - F.make_dt_interval(F.lit(0), (both % 700).cast("int"))).alias("created_at"),
            (self.as_of + F.make_dt_interval((both % 11 - 5).cast("int"))).alias("expires_at"),
        ))

    @cached_property
    def feed_items(self) -> DataFrame:
        p = F.col("page_id")
        return self.table("pages").select(
            "page_id", p.alias("item_order"), "url", "html",
            (p % 5).alias("source_id"),
            F.when(p % 3 != 0, F.concat(F.lit("g"), p % 40)).alias("guid"),
        )

    @cached_property
    def turns(self) -> DataFrame:
        """Conversation turns as research material: run = conversation."""
        t = F.col("turn")
        return self.table("conversations").select(
            F.col("conv_id").alias("run_id"), "turn", "role", "text",
            F.floor(t / 4).cast("bigint").alias("card_index"),
            (F.floor(t / 2) % 2).cast("bigint").alias("statement_index"),
            (F.col("conv_id") * 1000 + t).alias("turn_id"),
        )

    @cached_property
    def research(self) -> DataFrame:
        """User turns are evidence; every fifth one is not trusted."""
        return self.turns.filter("role = 'user'").select(
            "run_id", F.col("turn_id").alias("evidence_id"), "text", (F.col("turn_id") % 5 != 4).alias("trusted")
        )

    @cached_property
    def trusted(self) -> DataFrame:
        return self.research.filter("trusted").select("run_id", "evidence_id", "text")

    @cached_property
    def statements(self) -> DataFrame:
        """Assistant turns are drafted statements that cite the turn before and two before that."""
        return self.turns.filter("role = 'assistant'").select(
            "run_id", "card_index", "statement_index", "text", "turn",
            pick(("context", "timeline", "impact"), F.col("card_index") % 3).alias("card_type"),
            F.array(F.col("turn_id") - 1, F.col("turn_id") - 3).alias("evidence_ids"),
        )

    @cached_property
    def verification(self) -> DataFrame:
        """A checker's answers: some missing, misplaced, unsupported or citing other evidence."""
        r, t = F.col("run_id"), F.col("turn")
        return self.statements.filter((r + t) % 11 != 0).select(
            "run_id", "card_index",
            F.when((r + t) % 13 == 0, F.col("statement_index") + 5).otherwise(F.col("statement_index"))
            .alias("statement_index"),
            ((r + t) % 4 != 0).alias("supported"),
            F.when((r + t) % 7 == 0, F.concat("evidence_ids", F.array(r * 1000 + 999)))
            .otherwise(F.col("evidence_ids")).alias("evidence_ids"),
        )

    @cached_property
    def budgets(self) -> DataFrame:
        return self.turns.select("run_id").distinct().select(
            "run_id", (F.lit(20) + F.col("run_id") % 60).cast("int").alias("word_budget")
        )

    @cached_property
    def kept_statements(self) -> DataFrame:
        from newsloom.operators import grounding

        return grounding.supported_statements(self.statements, self.verification, self.trusted, self.budgets)

    @cached_property
    def draft_cards(self) -> DataFrame:
        return self.statements.select(
            "run_id", "card_index", "card_type",
            F.concat(F.lit("Card "), F.col("card_index")).alias("heading"),
        ).distinct()

    @cached_property
    def labeled(self) -> DataFrame:
        """Vectors with the story they belong to and the cluster they were put in."""
        found = clustering.graph_cluster(self.vectors, SETTINGS.similarity_threshold)
        return found.join(self.vectors.select("article_id", F.col("story_id").alias("expected")), "article_id").select(
            "article_id", "expected", F.col("cluster_id").alias("predicted")
        )


def _case(column: str, values: dict) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def fold_sql(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


def r(x: str, digits: int) -> str:
    """Round half up on the decimal value, as ``round_to`` does."""
    return f"CAST(round(CAST({x} AS DECIMAL(28,10)), {digits}) AS DOUBLE)"


def cosine_sql(a: str, b: str) -> str:
    return f"coalesce(list_dot_product({a}, {b}) / nullif(sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})), 0), 0)"


def phrases_sql(text: str) -> str:
    whens = " ".join(
        f"WHEN regexp_matches({text}, '\\b(?:{'|'.join(p)})\\b') THEN '{kind}'"
        for kind, p in features.CONTENT_TYPE_PHRASES.items()
    )
    return f"CASE {whens} ELSE 'news' END"


_TOPICS = " UNION ALL ".join(
    f"SELECT article_id, 'topic' AS feature_type, '{topic}' AS feature_value, 0.8::DOUBLE AS confidence FROM texts WHERE "
    + " OR ".join(f"contains(t, '{k}')" for k in keywords)
    for topic, keywords in features.TOPIC_KEYWORDS.items()
)

_PRUNE_ROUNDS = "".join(
    f""",
p{i} AS (
  SELECT * FROM p{i - 1} UNION ALL
  SELECT cluster_id, article_id FROM (
    SELECT m.cluster_id, m.article_id, row_number() OVER (PARTITION BY m.cluster_id
        ORDER BY 0.65 * m.rel + 0.35 * (1 - max(s.sim)) DESC, m.rel DESC, m.article_id) AS n
    FROM rel m JOIN p{i - 1} p ON p.cluster_id = m.cluster_id
    JOIN v_sims s ON s.a = m.article_id AND s.b = p.article_id
    WHERE m.n > 5 AND (SELECT count(*) FROM p{i - 1} q WHERE q.cluster_id = m.cluster_id) < 5
      AND NOT EXISTS (SELECT 1 FROM p{i - 1} q WHERE q.article_id = m.article_id)
    GROUP BY m.cluster_id, m.article_id, m.rel HAVING max(s.sim) < 0.94)
  WHERE n = 1)"""
    for i in range(1, 5)
)

VIEW_SQL = {
    "v_sources": f"""
SELECT s AS source_id, s % 7 AS publisher_id, 'feed ' || s AS name, {_list(CATEGORIES)}[s % 4 + 1] AS category,
  s % 11 <> 0 AS enabled,
  CASE WHEN s % 9 <> 0 THEN 'https://Pub' || (s % 7) || '.example.com' || CASE WHEN s % 2 = 0 THEN '/' ELSE '' END END AS site_url,
  'https://pub.example.com/feed/' || s AS feed_url
FROM (SELECT DISTINCT CAST(substr(source, 4) AS BIGINT) AS s FROM documents)""",
    "v_publishers": """
SELECT DISTINCT publisher_id, 'publisher ' || publisher_id AS name, publisher_id <> 5 AS enabled FROM v_sources""",
    "v_articles": f"""
SELECT *, {phrases_sql(fold_sql("title || ' ' || canonical_url"))} AS content_type FROM (
SELECT doc_id AS article_id, s AS source_id, s % 7 AS publisher_id, {_list(CATEGORIES)}[s % 4 + 1] AS category,
  substr(text, 1, 80) AS title, substr(text, 81, 120) AS rss_summary, text AS content_text, lang AS language,
  {AS_OF_SQL} - to_hours(doc_id % 96) AS published_at,
  {AS_OF_SQL} - to_hours(doc_id % 96) + INTERVAL 1 HOUR AS discovered_at,
  len(regexp_extract_all(text, '\\S+')) AS word_count,
  CASE WHEN doc_id % 17 = 0 THEN 'failed' ELSE 'extracted' END AS status,
  sha256(text) AS content_hash,
  'https://src' || s || '.example.com/' || {_list(SECTIONS)}[doc_id % 6 + 1] || '/' || doc_id AS canonical_url
FROM (SELECT *, CAST(substr(source, 4) AS BIGINT) AS s FROM documents))""",
    "v_eligible": f"""
SELECT *, greatest(0, epoch({AS_OF_SQL} - published_at) / 3600.0) AS age,
  greatest(1, ceil(word_count / 225.0))::BIGINT AS reading_minutes
FROM v_articles WHERE status = 'extracted' AND content_text <> '' AND word_count BETWEEN 200 AND 4000
  AND published_at >= {AS_OF_SQL} - INTERVAL 48 HOUR AND lower(language) = 'en'""",
    "v_features": f"""
WITH texts AS (
  SELECT article_id, ' ' || {fold_sql("concat_ws(chr(10), nullif(title, ''), nullif(rss_summary, ''), nullif(content_text, ''))")} || ' ' AS t FROM v_articles)
SELECT article_id, 'content_type' AS feature_type, content_type AS feature_value, 1.0::DOUBLE AS confidence FROM v_articles
UNION ALL SELECT article_id, 'publisher', CAST(publisher_id AS VARCHAR), 1.0::DOUBLE FROM v_articles
UNION ALL SELECT article_id, 'category', category, 1.0::DOUBLE FROM v_articles
UNION ALL {_TOPICS}""",
    "v_users": """
SELECT DISTINCT user_id, user_id % 13 - 1 AS daily_list_length, user_id % 30 AS minutes_per_article FROM events""",
    "v_targets": """
SELECT user_id, least(greatest(daily_list_length, 1), 10) AS target_count,
  least(greatest(minutes_per_article, 2), 25) AS minutes_per_article,
  least(greatest(daily_list_length, 1), 10) * least(greatest(minutes_per_article, 2), 25) AS target_minutes FROM v_users""",
    "v_feedback": f"""
SELECT event_id, user_id, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS article_id,
  CASE WHEN event_type = 'purchase' AND event_id % 4 = 0 THEN 'unstar' ELSE {_case('event_type', EVENT_TYPES)} END AS event_type,
  CASE WHEN event_id % 25 = 0 THEN 'topic_science' END AS reason, ts AS created_at FROM events""",
    "v_current": """
SELECT * EXCLUDE (n) FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, article_id, event_group ORDER BY created_at DESC, event_id DESC) AS n
  FROM (SELECT *, CASE WHEN event_type IN ('like', 'dislike', 'skip') THEN 'reaction'
                       WHEN event_type IN ('star', 'unstar') THEN 'star' ELSE event_type END AS event_group FROM v_feedback))
WHERE n = 1 AND event_type <> 'unstar'""",
    "v_attribution": """
SELECT user_id, article_id, event_id, event_type, 'topic' AS feature_type, 'science' AS feature_value, 1.0::DOUBLE AS confidence
FROM v_current WHERE reason = 'topic_science'
UNION ALL SELECT c.user_id, c.article_id, c.event_id, c.event_type, f.feature_type, f.feature_value, f.confidence
FROM v_current c JOIN v_features f USING (article_id) WHERE c.reason IS NULL""",
    "v_preferences": """
SELECT user_id, feature_type, feature_value,
  (sum(greatest(part, 0)) - sum(greatest(-part, 0))) / (sum(greatest(part, 0)) + sum(greatest(-part, 0))) AS score,
  least(1.0::DOUBLE, count(*)::DOUBLE / 5) AS confidence,
  count(*) FILTER (part > 0) AS positive_count, count(*) FILTER (part <= 0) AS negative_count
FROM (SELECT *, confidence * CASE event_type WHEN 'like' THEN 1.0::DOUBLE WHEN 'dislike' THEN -1.0::DOUBLE WHEN 'skip' THEN -0.4::DOUBLE
        WHEN 'open' THEN 0.1::DOUBLE WHEN 'complete' THEN 0.5::DOUBLE WHEN 'star' THEN 1.5::DOUBLE END AS part FROM v_attribution)
GROUP BY ALL""",
    "v_usage": """
SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN user_id END AS user_id, sha256(CAST(user_id AS VARCHAR)) AS visitor_hash,
  'page_view' AS event_type, '/' || event_type AS path, ts AS created_at FROM events WHERE event_type IN ('view', 'click')""",
    "v_run_events": f"""
SELECT event_id, user_id, user_id * 100 + day(ts) AS run_id, {_list([n for n, _ in STEP_KEYS])}[event_id % {len(STEP_KEYS)} + 1] AS node_name,
  value AS elapsed_ms, {_list([k for _, k in STEP_KEYS])}[event_id % {len(STEP_KEYS)} + 1] AS key,
  CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS k,
  CASE WHEN event_id % 20 = 0 THEN 'failed' ELSE 'complete' END AS status, ts AS created_at FROM events""",
    "v_runs": """
SELECT run_id, user_id, min(created_at) AS started_at, CASE WHEN run_id % 13 <> 0 THEN max(created_at) END AS completed_at,
  CASE WHEN run_id % 13 = 0 THEN 'running' WHEN run_id % 7 = 0 THEN 'failed' ELSE 'complete' END AS status,
  run_id % 11 AS selected_count, min(created_at) AS created_at FROM v_run_events GROUP BY run_id, user_id""",
    "v_stats": """
SELECT run_id, key, arg_max(k, event_id) AS k FROM v_run_events GROUP BY ALL""",
    "v_times": """
SELECT run_id, node_name, sum(elapsed_ms) / 1000.0 AS seconds, count(*) AS attempts FROM v_run_events GROUP BY ALL""",
    "v_volumes": f"""
SELECT r.run_id, n.node_name, CAST(coalesce(CASE n.node_name
    WHEN 'load_settings' THEN CASE WHEN t.attempts > 0 THEN 1 END
    WHEN 'finalize' THEN r.selected_count
    WHEN 'expand_sources' THEN (SELECT sum(k) FROM v_stats s WHERE s.run_id = r.run_id AND s.key = 'round_1_database_candidates')
    WHEN 'supplement' THEN (SELECT sum(k) FROM v_stats s WHERE s.run_id = r.run_id AND s.key LIKE 'supplements_%')
    ELSE v.volume END, 0) AS BIGINT) AS volume
FROM v_runs r CROSS JOIN (SELECT unnest({_list([n for n, _ in STEP_KEYS])}) AS node_name) n
LEFT JOIN v_times t ON t.run_id = r.run_id AND t.node_name = n.node_name
LEFT JOIN (SELECT run_id, node_name, sum(k) AS volume FROM v_run_events WHERE status = 'complete' GROUP BY ALL) v
  ON v.run_id = r.run_id AND v.node_name = n.node_name""",
    "v_steps": """
SELECT v.run_id, v.node_name, t.seconds, coalesce(t.attempts, 0) AS attempts, v.volume,
  CASE WHEN v.volume > 0 THEN t.seconds / v.volume END AS seconds_per_unit
FROM v_volumes v LEFT JOIN v_times t USING (run_id, node_name)""",
    "v_model_calls": """
SELECT event_id AS call_id, user_id, user_id * 100 + day(ts) AS run_id, event_type AS role, 'provider ' || event_id % 2 AS provider,
  'model ' || event_id % 3 AS model, CASE WHEN event_id % 20 = 0 THEN 'failed' ELSE 'success' END AS status,
  CASE WHEN event_id % 6 <> 0 THEN CAST(floor(value) AS BIGINT) END AS input_tokens, event_id % 50 AS output_tokens,
  CASE WHEN event_id % 9 <> 0 THEN value END AS elapsed_ms, ts AS created_at, ts + INTERVAL 7 DAY AS expires_at FROM events""",
    "v_vectors": f"""
SELECT e.vec_id AS article_id, e.vec_id // 8 AS story_id,
  list_transform(list_zip(a.embedding, e.embedding), lambda x: x[1]::DOUBLE * CASE WHEN e.vec_id % 8 = 7 THEN 6 ELSE 3 END + x[2]::DOUBLE) AS vector,
  CASE WHEN (e.vec_id // 8) % 5 = 0 THEN 0 ELSE e.vec_id % 3 END AS publisher_id,
  CAST({AS_OF_SQL} AS DATE) - CAST((e.vec_id // 8) % 10 AS INT) AS event_date
FROM embeddings e JOIN embeddings a ON a.vec_id = e.vec_id // 8 * 8""",
    "v_centroids": """
SELECT story_id AS cluster_id, list(m ORDER BY d) AS centroid, max(n) AS n_members FROM (
  SELECT story_id, d, avg(x) AS m, count(*) AS n FROM (
    SELECT story_id, unnest(vector) AS x, generate_subscripts(vector, 1) AS d FROM v_vectors) GROUP BY ALL) GROUP BY ALL""",
    "v_clusters": f"""
SELECT c.cluster_id, c.centroid, c.n_members, a.title AS representative_title, a.rss_summary AS event_summary,
  CAST({AS_OF_SQL} AS DATE) - CAST(c.cluster_id % 10 AS INT) AS event_date,
  ['complete', 'pending', 'singleton'][c.cluster_id % 3 + 1] AS comparison_status,
  c.cluster_id * 8 AS representative_article_id,
  {AS_OF_SQL} - to_hours(c.cluster_id % 48) AS created_at, {AS_OF_SQL} + to_days(CAST(c.cluster_id % 9 - 4 AS INT)) AS expires_at
FROM v_centroids c LEFT JOIN v_articles a ON a.article_id = c.cluster_id * 8""",
    "v_sims": f"""
SELECT x.article_id AS a, y.article_id AS b, {cosine_sql('x.vector', 'y.vector')} AS sim
FROM v_vectors x JOIN v_vectors y ON x.story_id = y.story_id""",
    "v_members": f"""
WITH rel AS (
  SELECT v.story_id AS cluster_id, v.article_id, v.publisher_id, {cosine_sql('v.vector', 'c.centroid')} AS rel,
    count(*) OVER (PARTITION BY v.story_id) AS n
  FROM v_vectors v JOIN v_centroids c ON c.cluster_id = v.story_id),
best AS (
  SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY rel DESC, article_id) AS place FROM (
    SELECT *, row_number() OVER (PARTITION BY cluster_id, publisher_id ORDER BY rel DESC, article_id) AS b FROM rel) WHERE b = 1),
p0 AS (SELECT cluster_id, article_id FROM best WHERE place <= 5){_PRUNE_ROUNDS}
SELECT m.cluster_id, m.article_id, m.publisher_id,
  CASE WHEN m.n <= 5 OR EXISTS (SELECT 1 FROM p4 p WHERE p.article_id = m.article_id) THEN 'coverage' ELSE 'redundant' END AS relationship
FROM rel m""",
    "v_chunks": f"""
SELECT w.article_id, chunk_index, chunk_text, len(regexp_extract_all(chunk_text, '\\S+')) AS word_count, character_start,
  character_start + length(chunk_text) AS character_end, sha256(chunk_text) AS content_hash,
  w.article_id * 1000 + chunk_index AS chunk_id, v.vector, {AS_OF_SQL} + to_days(CAST(w.article_id % 7 - 3 AS INT)) AS expires_at
FROM (
  SELECT article_id, 0 AS chunk_index, content_text AS chunk_text, 0 AS character_start
  FROM v_articles WHERE status = 'extracted' AND content_text <> '' AND word_count < 1500
  UNION ALL
  SELECT article_id, c AS chunk_index, ltrim(array_to_string(list_slice(p, c * 700 + 1, c * 700 + 800), ''), E' \\n') AS chunk_text,
    length(array_to_string(list_slice(p, 1, c * 700), ''))
      + length(p[c * 700 + 1]) - length(ltrim(p[c * 700 + 1], E' \\n')) AS character_start
  FROM (SELECT article_id, p, unnest(generate_series(0, greatest(0, CAST(ceil((len(p) - 800) / 700.0) AS BIGINT)))) AS c
        FROM (SELECT article_id, regexp_extract_all(content_text, '\\s*\\S+') AS p FROM v_articles
              WHERE status = 'extracted' AND word_count >= 1500))) w
LEFT JOIN v_vectors v USING (article_id)""",
    "v_cluster_chunks": """
SELECT c.*, m.cluster_id FROM v_chunks c JOIN v_members m USING (article_id) WHERE m.relationship = 'coverage'""",
    "v_claims": f"""
SELECT claim_id, article_id, story_id AS cluster_id, publisher_id, s AS claim_text,
  CASE WHEN claim_id % 6 = 0 THEN 'made up ' || s ELSE upper(s) END AS supporting_excerpt,
  0.5 + (claim_id % 5) / 10.0 AS confidence,
  CASE WHEN claim_id % 10 <> 0 THEN vector END AS vector,
  {AS_OF_SQL} - to_hours(claim_id % 700) AS created_at,
  {AS_OF_SQL} + to_days(CAST(claim_id % 11 - 5 AS INT)) AS expires_at
FROM (SELECT article_id, s, article_id * 16777216 + row_number() OVER (PARTITION BY article_id ORDER BY length(s) DESC, s) - 1 AS claim_id FROM (
        SELECT DISTINCT article_id, trim(unnest(regexp_extract_all(content_text, '[^.!?\\n]+[.!?]')), ' ') AS s FROM v_articles))
JOIN v_vectors USING (article_id)""",
    "v_terms": """
SELECT claim_id, list_distinct(regexp_extract_all(replace(lower(claim_text), 'ß', 'ss'), '[a-z0-9]+')) AS terms FROM v_claims""",
    "v_all_pairs": f"""
SELECT cluster_id, l AS left_claim_id, r AS right_claim_id, la AS left_article_id, ra AS right_article_id,
  least(lp, rp) AS publisher_low, greatest(lp, rp) AS publisher_high,
  round(0.8 * CASE WHEN lv IS NOT NULL AND rv IS NOT NULL THEN greatest(0, least(1, ({cosine_sql('lv', 'rv')} + 1) / 2)) ELSE 0 END
    + 0.2 * coalesce(len(list_intersect(lt, rt)) / nullif(len(list_distinct(list_concat(lt, rt))), 0), 0), 9) AS score
FROM (
  SELECT x.cluster_id, x.claim_id AS l, y.claim_id AS r, x.article_id AS la, y.article_id AS ra, mx.publisher_id AS lp, my.publisher_id AS rp,
    x.vector AS lv, y.vector AS rv, tx.terms AS lt, ty.terms AS rt
  FROM v_claims x JOIN v_claims y ON x.cluster_id = y.cluster_id AND x.article_id < y.article_id
  JOIN v_members mx ON mx.article_id = x.article_id AND mx.relationship = 'coverage'
  JOIN v_members my ON my.article_id = y.article_id AND my.relationship = 'coverage'
  JOIN v_terms tx ON tx.claim_id = x.claim_id JOIN v_terms ty ON ty.claim_id = y.claim_id
  WHERE mx.publisher_id <> my.publisher_id)""",
    "v_pairs": """
SELECT *, (rank - 1) // 5 AS batch FROM (
  SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY tier, score DESC, left_claim_id, right_claim_id) AS rank FROM (
    SELECT *, CASE WHEN row_number() OVER (PARTITION BY cluster_id, publisher_low, publisher_high
                                          ORDER BY score DESC, left_claim_id, right_claim_id) = 1 THEN 0 ELSE 1 END AS tier FROM v_all_pairs))
WHERE rank <= 20""",
    "v_raw_links": f"""
SELECT cluster_id, CASE WHEN o = 2 THEN batch + 1 ELSE batch END AS batch, o AS link_order,
  CASE WHEN o = 1 THEN right_claim_id ELSE left_claim_id END AS left_claim_id,
  CASE WHEN o = 1 THEN left_claim_id ELSE right_claim_id END AS right_claim_id,
  {_list(RELATIONSHIPS)}[(left_claim_id + right_claim_id + o) % 5 + 1] AS relationship,
  0.5 + ((left_claim_id + right_claim_id) % 6) / 12.0 AS confidence
FROM (SELECT *, unnest([0, 1, 2]) AS o FROM v_pairs) WHERE o <> 1 OR (left_claim_id + right_claim_id) % 2 = 0""",
    "v_links": f"""
SELECT cluster_id, low AS left_claim_id, high AS right_claim_id, relationship, confidence,
  {AS_OF_SQL} - to_hours((low + high) % 700) AS created_at, {AS_OF_SQL} + to_days(CAST((low + high) % 11 - 5 AS INT)) AS expires_at
FROM (
  SELECT *, row_number() OVER (PARTITION BY cluster_id, low, high ORDER BY batch DESC, link_order DESC) AS n FROM (
    SELECT *, least(left_claim_id, right_claim_id) AS low, greatest(left_claim_id, right_claim_id) AS high FROM v_raw_links) k
  WHERE EXISTS (SELECT 1 FROM v_pairs p WHERE p.cluster_id = k.cluster_id AND p.batch = k.batch
                AND least(p.left_claim_id, p.right_claim_id) = k.low AND greatest(p.left_claim_id, p.right_claim_id) = k.high))
WHERE n = 1""",
    "v_evidence": """
SELECT cluster_id, article_id, round(sum(0.25 * confidence + coalesce(linked, 0)), 9) AS evidence_score, count(*) AS n_claims
FROM v_claims c LEFT JOIN (
  SELECT claim_id, sum(part) AS linked FROM (
    SELECT unnest([left_claim_id, right_claim_id]) AS claim_id, confidence * CASE relationship WHEN 'equivalent' THEN 2.0::DOUBLE WHEN 'supports' THEN 1.5::DOUBLE
      WHEN 'related' THEN 0.25::DOUBLE WHEN 'contradicts' THEN 0.1::DOUBLE ELSE 0::DOUBLE END AS part FROM v_links) GROUP BY ALL) USING (claim_id)
WHERE claim_id IN (SELECT unnest([left_claim_id, right_claim_id]) FROM v_pairs) GROUP BY ALL""",
    "v_feed_items": """
SELECT page_id, page_id AS item_order, url, html, page_id % 5 AS source_id, CASE WHEN page_id % 3 <> 0 THEN 'g' || (page_id % 40) END AS guid FROM pages""",
    "v_turns": """
SELECT conv_id AS run_id, turn, role, text, turn // 4 AS card_index, turn // 2 % 2 AS statement_index, conv_id * 1000 + turn AS turn_id FROM conversations""",
    "v_research": """
SELECT run_id, turn_id AS evidence_id, text, turn_id % 5 <> 4 AS trusted FROM v_turns WHERE role = 'user'""",
    "v_statements": """
SELECT run_id, card_index, statement_index, text, turn, ['context', 'timeline', 'impact'][card_index % 3 + 1] AS card_type,
  [turn_id - 1, turn_id - 3] AS evidence_ids FROM v_turns WHERE role = 'assistant'""",
    "v_verification": """
SELECT run_id, card_index, CASE WHEN (run_id + turn) % 13 = 0 THEN statement_index + 5 ELSE statement_index END AS statement_index,
  (run_id + turn) % 4 <> 0 AS supported,
  CASE WHEN (run_id + turn) % 7 = 0 THEN list_concat(evidence_ids, [run_id * 1000 + 999]) ELSE evidence_ids END AS evidence_ids
FROM v_statements WHERE (run_id + turn) % 11 <> 0""",
    "v_budgets": """
SELECT DISTINCT run_id, 20 + run_id % 60 AS word_budget FROM v_turns""",
    "v_candidates": """
SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY card_index, statement_index) AS i FROM (
  SELECT s.run_id, s.card_index, s.statement_index, s.card_type, trim(s.text, E' \\n') AS text, len(regexp_extract_all(s.text, '\\S+')) AS n_words,
    list_filter(v.evidence_ids, lambda x: list_contains(s.evidence_ids, x) AND list_contains(e.ids, x)) AS cited
  FROM v_statements s JOIN v_verification v USING (run_id, card_index, statement_index)
  JOIN (SELECT run_id, list(evidence_id) AS ids FROM v_research WHERE trusted GROUP BY run_id) e ON e.run_id = s.run_id
  WHERE v.supported) WHERE len(cited) > 0""",
    "v_walk": """
SELECT run_id, 0::BIGINT AS i, 0::BIGINT AS used, false AS kept FROM v_budgets
UNION ALL
SELECT w.run_id, c.i, w.used + CASE WHEN w.used + c.n_words <= b.word_budget THEN c.n_words ELSE 0 END,
  w.used + c.n_words <= b.word_budget
FROM v_walk w JOIN v_candidates c ON c.run_id = w.run_id AND c.i = w.i + 1 JOIN v_budgets b ON b.run_id = w.run_id""",
    "v_kept": """
SELECT c.* FROM v_candidates c JOIN v_walk w USING (run_id, i) WHERE w.kept""",
}
