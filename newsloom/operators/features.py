"""Per-article projections, predicates and features."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import clock, urls
from newsloom.functions.text import fold, let, non_empty, strip
from newsloom.settings import Settings

# Title and URL phrases per content type, first match wins.
CONTENT_TYPE_PHRASES = {
    "opinion": ("opinion", "editorial", "commentary", "op-ed", "opinion piece"),
    "analysis": ("analysis", "explainer", "what it means", "in depth"),
    "tutorial": ("tutorial", "how to", "how-to", "step-by-step", "guide"),
}

# Spellings of the five content types.
CONTENT_TYPE_ALIASES = {
    "news": "news",
    "breaking_news": "news",
    "news_report": "news",
    "report": "news",
    "reporting": "news",
    "current_events": "news",
    "analysis": "analysis",
    "news_analysis": "analysis",
    "explainer": "analysis",
    "in_depth": "analysis",
    "opinion": "opinion",
    "op_ed": "opinion",
    "editorial": "opinion",
    "commentary": "opinion",
    "tutorial": "tutorial",
    "how_to": "tutorial",
    "guide": "tutorial",
    "step_by_step": "tutorial",
    "other": "other",
}

# Substrings that tag a topic.
TOPIC_KEYWORDS = {
    "technology": ("technology", "software", "computer", "cybersecurity", "chip"),
    "artificial intelligence": ("artificial intelligence", "machine learning", " ai "),
    "science": ("science", "researcher", "study", "space", "physics", "biology"),
    "business": ("business", "company", "market", "economy", "finance", "stock"),
    "politics": ("politics", "election", "government", "congress", "president"),
    "health": ("health", "medical", "medicine", "hospital", "disease"),
    "climate": ("climate", "global warming", "emissions", "renewable energy"),
    "sports": ("sports", "football", "basketball", "baseball", "soccer", "tennis"),
    "culture": ("culture", "film", "music", "book", "television", "art"),
    "crime": ("crime", "criminal", "homicide", "robbery", "prosecutor", "police"),
}
TOPIC_CONFIDENCE = 0.8

FEATURE_COLUMNS = ("article_id", "feature_type", "feature_value", "confidence")


def reading_minutes(words: Column, words_per_minute: int = 225) -> Column:
    """B1."""
    return F.greatest(F.lit(1), F.ceil(words / F.lit(float(words_per_minute))).cast("int"))


def combined_text(*parts: Column) -> Column:
    """B3. Non-empty parts on their own lines, folded."""
    return fold(F.concat_ws("\n", *[non_empty(p) for p in parts]))


def classify_content_type(title: Column, url: Column) -> Column:
    """B4. Phrase rules over folded title and URL, in rule order."""
    searchable = fold(
        F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(url, F.lit("")))
    )

    def choose(text: Column) -> Column:
        out = None
        for kind, phrases in CONTENT_TYPE_PHRASES.items():
            hit = text.rlike(r"(?U)\b(?:" + "|".join(phrases) + r")\b")
            out = F.when(hit, kind) if out is None else out.when(hit, kind)
        return out.otherwise("news")

    return let(searchable, choose)


def normalize_content_type(raw: Column, is_news: Column) -> Column:
    """B5. Known aliases; otherwise the model's own news flag decides."""
    key = F.replace(F.replace(fold(strip(raw)), F.lit("-"), F.lit("_")), F.lit(" "), F.lit("_"))
    aliases = F.create_map(*[F.lit(x) for x in chain(*CONTENT_TYPE_ALIASES.items())])
    return F.coalesce(
        F.try_element_at(aliases, key),
        F.when(is_news, "news").otherwise("other"),
    )


def rejection_codes(settings: Settings, as_of: Column) -> Column:
    """B6. The reasons an article is not eligible; an empty array accepts it."""
    words = F.col("word_count")
    seen = F.coalesce("published_at", "discovered_at")
    age = clock.hours_since(seen, as_of)
    rules = [
        F.when(~F.col("status").eqNullSafe("extracted"), "not_extracted"),
        F.when(F.coalesce("content_text", F.lit("")) == "", "missing_content"),
        F.when(words.isNull(), "missing_word_count")
        .when(words < settings.min_article_words, "too_short")
        .when(words > settings.max_article_words, "too_long"),
        F.when(seen.isNull(), "missing_publication_date")
        .when(age > settings.max_article_age_hours, "too_old"),
        F.when(
            ~fold(F.coalesce("language", F.lit(""))).isin(*settings.allowed_languages),
            "language_not_allowed",
        ),
        F.when(
            ~fold(F.coalesce("content_type", F.lit(""))).isin(*settings.allowed_content_types),
            "content_type_not_allowed",
        ),
    ]
    if settings.blocked_source_ids:
        rules.append(F.when(F.col("source_id").isin(*settings.blocked_source_ids), "blocked_source"))
    return F.array_compact(F.array(*rules))


def hard_filter(articles: DataFrame, settings: Settings, as_of: Column) -> DataFrame:
    return articles.withColumn("rejections", rejection_codes(settings, as_of))


def eligible(articles: DataFrame, settings: Settings, as_of: Column) -> DataFrame:
    """Accepted articles. Status, age and length also stand as plain predicates,
    so that they reach the scan and the text of old articles is never read."""
    recent = F.coalesce("published_at", "discovered_at") >= as_of - F.expr(
        f"make_dt_interval(0, {settings.max_article_age_hours})"
    )
    return articles.filter((F.col("status") == "extracted") & recent).filter(
        F.size(rejection_codes(settings, as_of)) == 0
    )


def rejection_counts(filtered: DataFrame) -> DataFrame:
    """B7."""
    return (
        filtered.select(F.explode("rejections").alias("reason"))
        .groupBy("reason")
        .agg(F.count("*").alias("n"))
    )


def feature_array() -> Column:
    """B8 before the explode: (type, value, confidence) structs of one article."""
    def row(kind: str, value: Column, confidence: float) -> Column:
        return F.struct(
            F.lit(kind).alias("feature_type"),
            value.alias("feature_value"),
            F.lit(confidence).alias("confidence"),
        )

    text = combined_text(F.col("title"), F.col("rss_summary"), F.col("content_text"))

    def topics(searchable: Column) -> Column:
        found = []
        for topic, keywords in TOPIC_KEYWORDS.items():
            hit = F.lit(False)
            for keyword in keywords:
                hit = hit | F.contains(searchable, F.lit(keyword))
            found.append(F.when(hit, row("topic", F.lit(topic), TOPIC_CONFIDENCE)))
        return F.array_compact(F.array(*found))

    kind = F.coalesce(non_empty(F.col("content_type")), F.lit("unknown"))
    fixed = F.array_compact(
        F.array(
            row("content_type", fold(kind), 1.0),
            F.when(
                F.col("publisher_id").isNotNull(),
                row("publisher", F.col("publisher_id").cast("string"), 1.0),
            ),
            F.when(
                F.coalesce("category", F.lit("")) != "",
                row("category", fold(F.col("category")), 1.0),
            ),
        )
    )
    return F.concat(fixed, let(F.concat(F.lit(" "), text, F.lit(" ")), topics))


def article_features(articles: DataFrame) -> DataFrame:
    """B8. One pass over the text; only ids and features leave the row."""
    return articles.select("article_id", F.inline(feature_array()))


def missing_features(articles: DataFrame, stored: DataFrame) -> DataFrame:
    """B9. Stored features, plus computed ones for articles that have none."""
    bare = articles.join(stored.select("article_id").distinct(), "article_id", "left_anti")
    return stored.select(*FEATURE_COLUMNS).unionByName(article_features(bare))


def merge_topics(features: DataFrame, model: DataFrame) -> DataFrame:
    """B10. ``model(article_id, content_type, topics, confidence)``: the model's
    content type replaces the stored one, its new topics are added."""
    present = features.filter("feature_type = 'topic'").select("article_id", "feature_value")
    added = (
        model.select("article_id", "confidence", F.explode("topics").alias("topic"))
        .select(
            "article_id",
            F.lit("topic").alias("feature_type"),
            fold(strip(F.col("topic"))).alias("feature_value"),
            "confidence",
        )
        .filter("feature_value <> ''")
        .dropDuplicates(["article_id", "feature_value"])
        .join(present, ["article_id", "feature_value"], "left_anti")
    )
    types = model.select(
        "article_id",
        F.lit("content_type").alias("feature_type"),
        F.col("content_type").alias("feature_value"),
        "confidence",
    )
    replaced = features.join(
        types.select("article_id", "feature_type"), ["article_id", "feature_type"], "left_anti"
    )
    return (
        replaced.select(*FEATURE_COLUMNS)
        .unionByName(types.select(*FEATURE_COLUMNS))
        .unionByName(added.select(*FEATURE_COLUMNS))
    )


def clamp_user_targets(users: DataFrame) -> DataFrame:
    """B13. List length 1-10, minutes per article 2-25, budget = product."""
    length = F.least(F.greatest("daily_list_length", F.lit(1)), F.lit(10)).cast("int")
    minutes = F.least(F.greatest("minutes_per_article", F.lit(2)), F.lit(25)).cast("int")
    return users.select(
        "user_id",
        length.alias("target_count"),
        minutes.alias("minutes_per_article"),
        (length * minutes).alias("target_minutes"),
    )


def domain_allowed(pages: DataFrame, allowed: DataFrame, url: str = "url") -> DataFrame:
    """B14. Pages whose host equals or is under an allowed domain.

    Every suffix of the host becomes a key, so the test is an equi semi join
    and not a comparison with each allowed domain.
    """
    labels = F.split(urls.site_domain(F.col(url)), r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."),
    )
    domains = allowed.select(
        F.regexp_replace(fold(F.col("domain")), r"^www\.", "").alias("_suffix")
    ).distinct()
    matched = (
        pages.select("page_id", F.explode(suffixes).alias("_suffix"))
        .filter("_suffix <> ''")
        .join(domains, "_suffix", "left_semi")
        .select("page_id")
        .distinct()
    )
    return pages.join(matched, "page_id", "left_semi")


def route_path_valid(path: Column) -> Column:
    """B15. Stripped path of 1-120 characters, from '/', without query or fragment."""
    return F.length(path).between(1, 120) & strip(path).rlike(r"^/[^?#]*$")


def article_model_text(limit: int | None = None) -> Column:
    """B16. What an embedding model is shown: the whole article, or its first ``limit`` characters."""
    body = F.coalesce("content_text", F.lit(""))
    return F.concat(
        F.lit("Title: "), F.col("title"),
        F.lit("\nSummary: "), F.coalesce("rss_summary", F.lit("")),
        F.lit("\nArticle: "), body if limit is None else F.left(body, F.lit(limit)),
    )
