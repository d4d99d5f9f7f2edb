"""Preferences learned from feedback events, for all users in one job."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import round_to
from newsloom.settings import Settings

# Weight of the latest event of each kind.
EVENT_WEIGHTS = {
    "like": 1.0,
    "dislike": -1.0,
    "skip": -0.4,
    "open": 0.1,
    "complete": 0.5,
    "star": 1.5,
}

# Reasons that name a topic.
TOPIC_REASONS = {
    "topic_technology": "technology",
    "topic_artificial_intelligence": "artificial intelligence",
    "topic_science": "science",
    "topic_business": "business",
    "topic_politics": "politics",
    "topic_health": "health",
    "topic_climate": "climate",
    "topic_sports": "sports",
    "topic_culture": "culture",
    "topic_crime": "crime",
}


def _lookup(values: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for x in chain(*values.items())]), key)


def event_group(event_type: Column) -> Column:
    return (
        F.when(event_type.isin("like", "dislike", "skip"), "reaction")
        .when(event_type.isin("star", "unstar"), "star")
        .otherwise(event_type)
    )


def current_feedback(events: DataFrame) -> DataFrame:
    """D1. The latest event per (user, article, group), without unstars.

    ``max_by`` combines before the shuffle, so a busy user or article costs one
    row per map task instead of a sorted window.
    """
    order = F.struct("created_at", "event_id")
    return (
        events.withColumn("event_group", event_group(F.col("event_type")))
        .groupBy("user_id", "article_id", "event_group")
        .agg(F.max_by(F.struct("event_id", "event_type", "reason", "created_at"), order).alias("e"))
        .select("user_id", "article_id", "event_group", "e.*")
        .filter("event_type <> 'unstar'")
    )


def feedback_attribution(current: DataFrame, features: DataFrame) -> DataFrame:
    """D2. A topic reason names the one feature; otherwise all the article's features."""
    told = F.struct("feature_type", "feature_value", "confidence")
    own = features.groupBy("article_id").agg(F.collect_list(told).alias("own"))
    topic = F.struct(
        F.lit("topic").alias("feature_type"), F.col("topic").alias("feature_value"), F.lit(1.0).alias("confidence"))
    # One pass: events that name a topic and the others part inside the row, so they are grouped and shuffled once.
    return (
        current.withColumn("topic", _lookup(TOPIC_REASONS, F.col("reason")))
        .join(own, "article_id", "left")
        .select(
            "user_id", "article_id", "event_id", "event_type",
            F.inline(F.when(F.col("topic").isNotNull(), F.array(topic)).otherwise(F.col("own"))),
        )
    )


def rebuild_preferences(attributed: DataFrame) -> DataFrame:
    """D3. Signed weights and counts per (user, feature)."""
    part = _lookup(EVENT_WEIGHTS, F.col("event_type")) * F.col("confidence")
    rows = attributed.withColumn("part", part).filter(
        _lookup(EVENT_WEIGHTS, F.col("event_type")).isNotNull()
    )
    up, down = F.col("part") > 0, F.col("part") <= 0
    sums = rows.groupBy("user_id", "feature_type", "feature_value").agg(
        F.sum(F.when(up, F.col("part")).otherwise(0.0)).alias("plus"),
        F.sum(F.when(down, -F.col("part")).otherwise(0.0)).alias("minus"),
        F.count_if(up).alias("positive_count"),
        F.count_if(down).alias("negative_count"),
    )
    return sums.select(
        "user_id",
        "feature_type",
        "feature_value",
        F.try_divide(F.col("plus") - F.col("minus"), F.col("plus") + F.col("minus")).alias("score"),
        F.least(F.lit(1.0), (F.col("positive_count") + F.col("negative_count")) / 5.0).alias("confidence"),
        "positive_count",
        "negative_count",
    ).filter("score IS NOT NULL")


def preference_impacts(preferences: DataFrame, settings: Settings) -> DataFrame:
    """D4. What each preference can add to a score, strongest first."""
    impact = F.col("score") * F.col("confidence") * settings.personalization_weight
    return preferences.withColumn("potential_adjustment", round_to(impact, 2)).orderBy(
        "user_id", F.desc("confidence"), F.desc("score"), "feature_type", "feature_value"
    )


def saved_state(events: DataFrame) -> DataFrame:
    """D5. Articles still starred; saved at the first star since the last unstar."""
    stars = events.filter("event_type IN ('star', 'unstar')")
    order = F.struct("created_at", "event_id")
    last_unstar = stars.groupBy("user_id", "article_id").agg(
        F.max(F.when(F.col("event_type") == "unstar", order)).alias("cut")
    )
    return (
        stars.filter("event_type = 'star'")
        .join(last_unstar, ["user_id", "article_id"])
        .filter(F.col("cut").isNull() | (order > F.col("cut")))
        .groupBy("user_id", "article_id")
        .agg(F.min("created_at").alias("saved_at"))
    )
