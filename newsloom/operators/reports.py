"""Read queries. Every ordering ends in a key, so that limits are repeatable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def list_articles(
    articles: DataFrame,
    status: str | None = None,
    source_id: int | None = None,
    offset: int = 0,
    limit: int = 50,
) -> DataFrame:
    """L1. Newest first, undated last."""
    if status:
        articles = articles.filter(F.col("status") == status)
    if source_id:
        articles = articles.filter(F.col("source_id") == source_id)
    return articles.orderBy(F.desc_nulls_last("published_at"), "article_id").offset(offset).limit(limit)


def list_clusters(clusters: DataFrame, members: DataFrame, limit: int = 50) -> DataFrame:
    """L2. Newest clusters with their member count, 0 included."""
    counts = members.groupBy("cluster_id").agg(F.count("*").alias("member_count"))
    newest = clusters.orderBy(F.desc("event_date"), F.desc("cluster_id")).limit(limit)
    return newest.join(counts, "cluster_id", "left").withColumn(
        "member_count", F.coalesce("member_count", F.lit(0))
    )


def cluster_detail(
    clusters: DataFrame, members: DataFrame, claims: DataFrame, links: DataFrame, comparisons: DataFrame
) -> DataFrame:
    """L3. What the page of each given cluster lists, as rows of four sections.

    Rows instead of nested arrays: a story may have any number of members, and a
    page reads its sections in order of ``item_id``.
    """
    wanted = clusters.select("cluster_id")

    def section(df: DataFrame, name: str, item: Column, other: Column, text: Column, confidence: Column) -> DataFrame:
        return df.join(wanted, "cluster_id", "left_semi").select(
            "cluster_id",
            F.lit(name).alias("section"),
            item.cast("bigint").alias("item_id"),
            other.cast("bigint").alias("other_id"),
            text.alias("text"),
            confidence.cast("double").alias("confidence"),
        )

    none = F.lit(None)
    return (
        section(members, "member", F.col("article_id"), none, F.col("relationship"), none)
        .unionByName(
            section(claims, "claim", F.col("claim_id"), F.col("article_id"), F.col("claim_text"), F.col("confidence"))
        )
        .unionByName(
            section(links, "link", F.col("left_claim_id"), F.col("right_claim_id"), F.col("relationship"), F.col("confidence"))
        )
        .unionByName(
            section(comparisons, "comparison", F.col("representative_article_id"), none, F.col("selection_reason"), none)
        )
    )


def my_model_calls(calls: DataFrame, runs: DataFrame, limit: int = 100) -> DataFrame:
    """L4. Newest model calls of every user's own runs, ``limit`` per user."""
    own = calls.join(runs.select("run_id", "user_id"), "run_id")
    return newest_per_user(own, [F.desc("created_at"), F.desc("call_id")], limit)


def newest_per_user(rows: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows per user; the rank limit runs before the shuffle."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(*order))
    return rows.withColumn("place", place).filter(F.col("place") <= limit)


def feedback_history(events: DataFrame, limit: int = 100) -> DataFrame:
    """L5. Newest feedback per user."""
    return newest_per_user(events, [F.desc("created_at"), F.desc("event_id")], limit)


def saved_articles(saved: DataFrame, articles: DataFrame) -> DataFrame:
    """L5. Saved articles with their titles, newest first."""
    return saved.join(articles.select("article_id", "title"), "article_id").orderBy(
        "user_id", F.desc("saved_at"), "article_id"
    )


def newest_list_content(
    items: DataFrame, articles: DataFrame, shown: tuple[str, ...] = ("title", "canonical_url", "content_text")
) -> DataFrame:
    """L6. Articles of the lists with the latest date; only the columns ``shown`` travel."""
    latest = items.agg(F.max("list_date").alias("list_date"))
    return (
        items.join(F.broadcast(latest), "list_date")
        .join(articles.select("article_id", *shown), "article_id")
        .orderBy("user_id", "rank")
    )


def list_report(lists: DataFrame, items: DataFrame, articles: DataFrame) -> DataFrame:
    """L7. Lists, their items and titles with all scores."""
    return (
        lists.select("user_id", "list_date", "actual_count")
        .join(items, ["user_id", "list_date"])
        .join(articles.select("article_id", "title"), "article_id")
        .orderBy(F.desc("list_date"), "user_id", "rank")
    )


#: Parts that the rows of one day are dealt to.
HOUR_PARTS = 32


def run_days(runs: DataFrame) -> DataFrame:
    """``(run_id, started_at, completed_at)`` per day that a run touches and part of that day."""
    days = F.sequence(F.to_date("started_at"), F.to_date("completed_at"))
    return (
        runs.filter("started_at <= completed_at")
        .select("run_id", "started_at", "completed_at", F.explode(days).alias("_day"))
        .withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(HOUR_PARTS - 1))))
    )


def meet_on_days(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """``rows`` with ``_day`` and ``_part`` and the runs of that day, as a shuffled join.

    Spark's size estimate does not see that runs are copied to parts, so without the hint it
    would send all the copies through the driver.
    """
    n = 8 * HOUR_PARTS
    return rows.repartition(n, "_day", "_part").join(
        run_days(runs).repartition(n, "_day", "_part").hint("merge"), ["_day", "_part"])


def during_runs(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """Rows whose ``created_at`` lies between start and end of a run, both included.

    A run covers a day or two; both sides meet on the day, so the range test is only a
    residual of an equi join. The rows of a day are dealt to ``HOUR_PARTS`` parts by all
    their columns and its runs are copied to each, so an hour that holds most rows is the
    work of many tasks.
    """
    part = F.pmod(F.xxhash64(*rows.columns), F.lit(HOUR_PARTS)).cast("int")
    return (
        meet_on_days(rows.withColumns({"_day": F.to_date("created_at"), "_part": part}), runs)
        .filter(F.col("created_at").between(F.col("started_at"), F.col("completed_at")))
        .drop("_day", "_part", "started_at", "completed_at")
    )


def instants_of(rows: DataFrame, *keys: str) -> DataFrame:
    """One row per group of ``keys``: its ``instants(at, n)`` in order, rows counted per instant.

    An article's claims and a story's labelled pairs are few, which bounds the array.
    """
    counted = rows.filter("created_at IS NOT NULL").groupBy(*keys, "created_at").agg(F.count("*").alias("n"))
    return counted.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(F.col("created_at").alias("at"), "n"))).alias("instants")
    )


def groups_in_runs(groups: DataFrame, runs: DataFrame, *keys: str) -> DataFrame:
    """Each of ``groups(keys, instants, ...)`` with every run that holds an instant of it, once, and ``n``
    rows in that run.

    A group is copied to the days of its instants, each with the instants of that day and the one before each. A run
    meets a group at the first instant that it holds, and at no other: two comparisons of instants decide a pair, and
    only pairs of the result count what the run holds. They are neither shuffled nor aggregated again.
    """
    kept = [c for c in groups.columns if c != "instants"]
    days = F.explode(F.array_distinct(F.transform("instants", lambda i: F.to_date(i["at"]))))
    part = F.pmod(F.xxhash64(*keys, "_day"), F.lit(HOUR_PARTS)).cast("int")
    firsts = F.transform("instants", lambda i, k: F.struct(
        i["at"].alias("_at"), F.get("instants", k - 1)["at"].alias("_before"), k.alias("_k")))
    spread = groups.withColumn("_day", days).withColumns({
        "_part": part, "_firsts": F.filter(firsts, lambda f: F.to_date(f["_at"]) == F.col("_day"))})
    met = meet_on_days(spread, runs).select("run_id", *kept, "instants", "started_at", "completed_at", F.inline("_firsts")).filter(
        "started_at <= _at AND _at <= completed_at AND (_before IS NULL OR _before < started_at)")
    held = F.slice("instants", F.col("_k") + 1, F.size("instants"))
    n = F.aggregate(held, F.lit(0).cast("bigint"), lambda a, i: F.when(i["at"] <= F.col("completed_at"), a + i["n"]).otherwise(a))
    return met.select("run_id", *kept, n.alias("n"))


def claims_per_run(claims: DataFrame, runs: DataFrame) -> DataFrame:
    """L8. Claims per (run, cluster, article)."""
    keys = "cluster_id", "article_id"
    return groups_in_runs(instants_of(claims, *keys), runs, *keys).withColumnRenamed("n", "extracted_claims")


def links_per_run(links: DataFrame, runs: DataFrame) -> DataFrame:
    """L9. Evaluated pairs per (run, cluster, relationship)."""
    keys = "cluster_id", "relationship"
    return groups_in_runs(instants_of(links, *keys), runs, *keys).withColumnRenamed("n", "evaluated_pairs")


def shown(text: str, chars: int | None) -> Column:
    """A text, or its first ``chars`` characters."""
    return F.col(text) if chars is None else F.left(text, F.lit(chars))


def run_chunks(
    claims: DataFrame, runs: DataFrame, chunks: DataFrame, articles: DataFrame, preview_chars: int | None = None
) -> DataFrame:
    """L10. Chunks of the articles whose claims were extracted in a run, whole unless a preview is asked for.

    An article's chunks and title join its claim instants before runs do, so a text moves once a day of
    its claims, not once a run."""
    keys = "article_id", "cluster_id"
    pieces = chunks.select("article_id", F.struct(
        "chunk_index", "word_count",
        shown("chunk_text", preview_chars).alias("chunk_preview"),
        F.size("vector").alias("embedding_dimensions"),
    ).alias("c")).groupBy("article_id").agg(F.collect_list("c").alias("_chunks"))
    told = instants_of(claims, *keys).join(pieces, "article_id").join(articles.select("article_id", "title"), "article_id")
    return groups_in_runs(told, runs, *keys).select("run_id", *keys, F.inline("_chunks"), "title")


def claim_link_report(links: DataFrame, claims: DataFrame) -> DataFrame:
    """L11. Links with both claim texts."""
    text = claims.select("claim_id", "claim_text")
    left = text.withColumnsRenamed({"claim_id": "left_claim_id", "claim_text": "left_claim"})
    right = text.withColumnsRenamed({"claim_id": "right_claim_id", "claim_text": "right_claim"})
    return links.join(left, "left_claim_id").join(right, "right_claim_id").orderBy(
        F.desc("cluster_id"), "left_claim_id", "right_claim_id"
    )


def supplement_report(
    items: DataFrame, runs: DataFrame, cards: DataFrame, citations: DataFrame, evidence: DataFrame,
    preview_chars: int | None = None,
) -> DataFrame:
    """L12. Items with their supplement, its cards and cited evidence; items without one stay."""
    return (
        items.join(runs, "item_id", "left")
        .join(cards, "run_id", "left")
        .join(citations, ["run_id", "card_index"], "left")
        .join(
            evidence.select("run_id", "evidence_id", shown("text", preview_chars).alias("evidence_excerpt")),
            ["run_id", "evidence_id"], "left",
        )
    )


def feed_catalog(publishers: DataFrame, sources: DataFrame) -> DataFrame:
    """L13. Feeds with their publishers."""
    return (
        publishers.select(
            "publisher_id", F.col("name").alias("publisher"), F.col("enabled").alias("publisher_enabled")
        )
        .join(
            sources.select(
                "publisher_id", "source_id", F.col("name").alias("feed"), "category", "feed_url",
                F.col("enabled").alias("feed_enabled"),
            ),
            "publisher_id",
        )
        .orderBy("publisher", "feed")
    )


def extraction_failures(articles: DataFrame) -> DataFrame:
    """L14. Failed extractions, newest first."""
    return articles.filter("status = 'failed'").orderBy(F.desc("discovered_at"), "article_id")


def comparison_report(comparisons: DataFrame, articles: DataFrame) -> DataFrame:
    """L15. Comparisons with the title of the chosen article, newest first."""
    title = articles.select(F.col("article_id").alias("representative_article_id"), F.col("title").alias("selected_article"))
    return comparisons.join(title, "representative_article_id").orderBy(F.desc("created_at"), "cluster_id")


def recent_usage(usage: DataFrame, n: int = 100) -> DataFrame:
    """L16. The newest usage rows."""
    return usage.orderBy(F.desc("created_at"), F.desc("event_id")).limit(n)
