"""Claims of one story: ground them, pair them across publishers, pick a representative."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import fingerprint, fold, normalized, round_to, terms
from newsloom.functions.vectors import cosine, norm, unit_interval
from newsloom.operators.retrieval import coverage_first_topk
from newsloom.session import cut_lineage
from newsloom.settings import Settings

# How much a labelled link adds to both articles.
RELATIONSHIP_WEIGHTS = {
    "equivalent": 2.0,
    "supports": 1.5,
    "related": 0.25,
    "contradicts": 0.1,
    "unrelated": 0.0,
}
CLAIM_WEIGHT = 0.25
PAIR_BLOCK = 512


def shown_text(articles: DataFrame, retrieved: DataFrame) -> DataFrame:
    """What the extractor saw: an article's retrieved chunks in order, else its text.
    At most ``retrieval_chunk_limit`` chunks per cluster exist."""
    parts = retrieved.groupBy("article_id").agg(
        F.sort_array(F.collect_list(F.struct("chunk_index", "chunk_text"))).alias("rows")
    )
    joined = F.array_join(F.transform("rows", lambda r: r["chunk_text"]), "\n\n")
    return articles.join(parts, "article_id", "left").select(
        "article_id", F.coalesce(joined, "content_text", F.lit("")).alias("shown")
    )


def ground_claims(claims: DataFrame, shown: DataFrame) -> DataFrame:
    """G1. Claims whose excerpt occurs in the text shown, with their claim hash.
    Each text is normalised once, below the join."""
    texts = shown.select("article_id", normalized(F.col("shown")).alias("_text"))
    held = F.contains(F.col("_text"), normalized(F.col("supporting_excerpt")))
    return (
        claims.join(texts, "article_id")
        .filter(held)
        .select(*claims.columns, fingerprint(fold(F.col("claim_text"))).alias("claim_hash"))
    )


def jaccard(a: Column, b: Column) -> Column:
    """G2. Shared over all distinct terms of two term arrays; 0 when both are empty."""
    return F.coalesce(
        F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0)
    )


def claim_pairs(claims: DataFrame, members: DataFrame) -> DataFrame:
    """G3. Scored pairs of one story from different articles and publishers.

    ``claims(cluster_id, article_id, claim_id, claim_text, vector)``. Only
    ``coverage`` members take part. A story's claims are dealt to blocks of about
    ``PAIR_BLOCK``; two blocks meet on a key of their own, so a story of many
    claims is the work of many tasks, and a small one is a single block. Claims of one
    article, block and vector travel as one row: rows of the same article or publisher are
    dropped, and a cosine is computed, once per pair of rows, not per pair of claims.
    """
    active = members.filter("relationship = 'coverage'").select("cluster_id", "article_id", "publisher_id")
    own = claims.select("cluster_id", "article_id", "claim_id", "claim_text", "vector")
    side = own.join(active, ["cluster_id", "article_id"]).select(
        "cluster_id", "article_id", "claim_id", "publisher_id", "vector",
        F.array_distinct(terms(F.col("claim_text"))).alias("terms"),
    )
    side = cut_lineage(side)
    sizes = side.groupBy("cluster_id").agg(F.ceil(F.count("*") / PAIR_BLOCK).cast("int").alias("_blocks"))
    blocked = side.join(sizes, "cluster_id").withColumn("_own", F.pmod(F.xxhash64("claim_id"), F.col("_blocks")).cast("int"))
    alike = ["article_id", "publisher_id", "vector"]
    rows = blocked.groupBy("cluster_id", "_blocks", "_own", *alike).agg(
        F.collect_list(F.struct("claim_id", "terms", F.size("terms").alias("size"))).alias("claims")
    ).withColumn("length", norm(F.col("vector")))
    others = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_other")
    meet = rows.select("cluster_id", *alike, "length", "claims", "_own", others)

    def named(own: str, kept: str, other: str) -> DataFrame:
        columns = [F.col(c).alias(f"{own}_{c}") for c in (*alike, "length", "claims")]
        return meet.select("cluster_id", F.col("_own").alias(kept), F.col("_other").alias(other), *columns)

    left, right = named("left", "_left", "_right"), named("right", "_right", "_left")
    semantic = F.when(
        F.col("left_vector").isNotNull() & F.col("right_vector").isNotNull(),
        unit_interval(
            cosine(F.col("left_vector"), F.col("right_vector"), F.col("left_length"), F.col("right_length"))
        ),
    ).otherwise(0.0)
    met = (
        left.join(right, ["cluster_id", "_left", "_right"])
        .filter(
            (F.col("left_article_id") < F.col("right_article_id"))
            & (F.col("left_publisher_id") != F.col("right_publisher_id"))
        )
        .select(
            "cluster_id", "left_article_id", "right_article_id",
            F.least("left_publisher_id", "right_publisher_id").alias("publisher_low"),
            F.greatest("left_publisher_id", "right_publisher_id").alias("publisher_high"),
            semantic.alias("semantic"), "right_claims", F.explode("left_claims").alias("l"),
        )
    )
    # Terms of a claim are distinct, so the size of their union needs no second pass.
    shared = F.size(F.array_intersect("l.terms", "r.terms"))
    return (
        met.select(*[c for c in met.columns if c != "right_claims"], F.explode("right_claims").alias("r"))
        .withColumn("shared", shared)
        .select(
            "cluster_id", F.col("l.claim_id").alias("left_claim_id"), F.col("r.claim_id").alias("right_claim_id"),
            "left_article_id", "right_article_id", "publisher_low", "publisher_high",
            F.round(
                0.8 * F.col("semantic")
                + 0.2 * F.coalesce(F.try_divide(F.col("shared"), F.col("l.size") + F.col("r.size") - F.col("shared")), F.lit(0.0)),
                9,
            ).alias("score"),
        )
    )


def select_pairs(pairs: DataFrame, settings: Settings) -> DataFrame:
    """G4 and G5. One pair per publisher pair first, then by score; batches in rank order."""
    order = [
        F.desc("score"),
        F.asc(F.least("left_claim_id", "right_claim_id")),
        F.asc(F.greatest("left_claim_id", "right_claim_id")),
    ]
    chosen = coverage_first_topk(
        pairs, ["cluster_id"], ["publisher_low", "publisher_high"], order, settings.max_claim_pairs
    )
    return chosen.withColumn(
        "batch", F.floor((F.col("rank") - 1) / settings.pair_batch_size).cast("int")
    )


def valid_links(links: DataFrame, selected: DataFrame) -> DataFrame:
    """G6. Links whose pair was asked in their batch; the last answer counts.

    ``links(cluster_id, batch, link_order, left_claim_id, right_claim_id,
    relationship, confidence)``.
    """
    def pair(df: DataFrame) -> DataFrame:
        return df.withColumn("low", F.least("left_claim_id", "right_claim_id")).withColumn(
            "high", F.greatest("left_claim_id", "right_claim_id")
        )

    keys = ["cluster_id", "batch", "low", "high"]
    asked = pair(selected).select(*keys)
    return (
        pair(links)
        .join(asked, keys, "left_semi")
        .groupBy("cluster_id", "low", "high")
        .agg(F.max_by(F.struct("relationship", "confidence"), F.struct("batch", "link_order")).alias("l"))
        .select(
            "cluster_id", F.col("low").alias("left_claim_id"), F.col("high").alias("right_claim_id"), "l.*"
        )
    )


def _sides(df: DataFrame, *extra: str) -> DataFrame:
    """One row per claim of a pair or link."""
    return df.select(
        "cluster_id", *extra,
        F.explode(F.array("left_claim_id", "right_claim_id")).alias("claim_id"),
    )


def article_evidence(claims: DataFrame, selected: DataFrame, links: DataFrame) -> DataFrame:
    """Evidence score and claim count per (cluster, article), over claims in selected pairs."""
    used = claims.join(_sides(selected).distinct(), ["cluster_id", "claim_id"], "left_semi").select(
        "cluster_id", "article_id", "claim_id", "confidence"
    )
    weight = F.lit(None).cast("double")
    for relationship, value in RELATIONSHIP_WEIGHTS.items():
        weight = F.when(F.col("relationship") == relationship, value).otherwise(weight)
    linked = (
        _sides(links.withColumn("part", weight * F.col("confidence")), "part")
        .groupBy("cluster_id", "claim_id")
        .agg(F.sum("part").alias("linked"))
    )
    return (
        used.join(linked, ["cluster_id", "claim_id"], "left")
        .groupBy("cluster_id", "article_id")
        .agg(
            round_to(
                F.sum(CLAIM_WEIGHT * F.col("confidence") + F.coalesce("linked", F.lit(0.0))), 9
            ).alias("evidence_score"),
            F.count("*").alias("n_claims"),
        )
    )


def choose_representative(evidence: DataFrame, articles: DataFrame) -> DataFrame:
    """G7. Best evidence score; then more claims, more words, lower id."""
    rows = evidence.join(articles.select("article_id", "word_count"), "article_id").withColumn(
        "words", F.coalesce("word_count", F.lit(0))
    )
    best = F.max_by(
        F.struct("article_id", "evidence_score", "n_claims", "words"),
        F.struct("evidence_score", "n_claims", "words", (-F.col("article_id")).alias("o")),
    )
    return rows.groupBy("cluster_id").agg(best.alias("b")).select(
        "cluster_id",
        F.col("b.article_id").alias("representative_article_id"),
        F.col("b.evidence_score").alias("evidence_score"),
        F.concat(
            F.lit("evidence_score="), F.format_string("%.3f", round_to(F.col("b.evidence_score"), 3)),
            F.lit(", extracted_claims="), F.col("b.n_claims"),
            F.lit(", word_count="), F.col("b.words"),
        ).alias("selection_reason"),
    )


def comparison_summary(
    claims: DataFrame, members: DataFrame, selected: DataFrame, links: DataFrame, batches: DataFrame
) -> DataFrame:
    """G8. Shared, disputed and unsupported counts and mean batch confidence.

    ``batches(cluster_id, batch, confidence)``. Stories with claims from fewer
    than two articles are left out; those without a pair lack evidence.
    """
    active = members.filter("relationship = 'coverage'").select("cluster_id", "article_id")
    wide = (
        claims.join(active, ["cluster_id", "article_id"], "left_semi")
        .groupBy("cluster_id")
        .agg(F.count_distinct("article_id").alias("n_articles"))
        .filter("n_articles >= 2")
    )
    pairs = selected.groupBy("cluster_id").agg(F.count("*").alias("n_pairs"))
    kind = F.col("relationship")
    counted = links.groupBy("cluster_id").agg(
        F.count_if(kind.isin("equivalent", "supports")).alias("shared_claim_count"),
        F.count_if(kind == "contradicts").alias("disputed_claim_count"),
        F.count_if(kind == "unrelated").alias("unsupported_claim_count"),
    )
    confidence = batches.groupBy("cluster_id").agg(F.avg("confidence").alias("confidence"))
    zero = F.lit(0).cast("bigint")
    return (
        wide.join(pairs, "cluster_id", "left")
        .join(counted, "cluster_id", "left")
        .join(confidence, "cluster_id", "left")
        .select(
            "cluster_id",
            "n_articles",
            F.coalesce("n_pairs", zero).alias("n_pairs"),
            *[
                F.coalesce(c, zero).alias(c)
                for c in ("shared_claim_count", "disputed_claim_count", "unsupported_claim_count")
            ],
            F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
            F.when(F.col("n_pairs").isNull(), "insufficient_evidence").otherwise("complete").alias("status"),
        )
    )
