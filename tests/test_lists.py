"""Filtering, scoring, selection and preferences on hand-made rows."""

import random
from collections import Counter
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from newsloom.functions import clock
from newsloom.functions.text import collapse, fold, strip, terms, word_count
from newsloom.operators import features, preferences, scoring
from newsloom.settings import Settings

S = Settings()


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text", ["", " ", "a", " a b ", "a b", "a b c\n", "\n\n", "one two  three", "ça va", "x\x1cy"]
)
def test_words_split_like_unicode_aware_code(spark, text):
    assert one(spark, word_count(F.lit(text))) == len(text.split())
    assert one(spark, collapse(F.lit(text))) == " ".join(text.split())
    assert one(spark, strip(F.lit(text))) == text.strip()


@pytest.mark.parametrize("text", ["Straße", "ΣΑΣ", "ÉTÉ", "ſt", "µm", "STRASSE"])
def test_fold_matches_case_folding(spark, text):
    assert one(spark, fold(F.lit(text))) == text.casefold()


def test_terms_are_ascii_runs(spark):
    assert one(spark, terms(F.lit("Don't PANIC, é42x"))) == ["don", "t", "panic", "42x"]


def test_reading_minutes_round_up(spark):
    words = {0: 1, 1: 1, 225: 1, 226: 2, 451: 3}
    for n, minutes in words.items():
        assert one(spark, features.reading_minutes(F.lit(n))) == minutes


def article(spark, **changes):
    row = dict(
        article_id=1, source_id=2, publisher_id=9, category="Science", status="extracted", title="A title",
        rss_summary="summary", content_text="some text on ai and physics", canonical_url="https://x.example/a",
        word_count=500, language="en", content_type="news", published_at="2024-01-30 12:00:00",
        discovered_at="2024-01-30 13:00:00",
    )
    row.update(changes)
    schema = ", ".join(
        f"{k} {'bigint' if k in ('article_id', 'source_id', 'publisher_id', 'word_count') else 'string'}" for k in row
    )
    df = spark.createDataFrame([tuple(row.values())], schema)
    return df.withColumns({c: F.to_timestamp_ntz(c) for c in ("published_at", "discovered_at")})


NOW = "2024-01-31 00:00:00"


def rejections(spark, settings=S, **changes):
    return one_row(features.hard_filter(article(spark, **changes), settings, clock.instant(NOW)))["rejections"]


def one_row(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_hard_filter_codes(spark):
    assert rejections(spark) == []
    bad = rejections(
        spark, replace(S, blocked_source_ids=(2,)), status="failed", word_count=20, language="FR",
        content_type="poem", published_at="2024-01-01 00:00:00", content_text="",
    )
    assert bad == [
        "not_extracted", "missing_content", "too_short", "too_old", "language_not_allowed",
        "content_type_not_allowed", "blocked_source",
    ]
    assert rejections(spark, published_at=None, discovered_at=None) == ["missing_publication_date"]
    assert rejections(spark, word_count=None) == ["missing_word_count"]
    assert rejections(spark, published_at="2024-03-01 00:00:00") == []


def test_topics_need_the_spaces_around_short_keywords(spark):
    rows = features.article_features(article(spark)).collect()
    topics = sorted(r["feature_value"] for r in rows if r["feature_type"] == "topic")
    assert topics == ["artificial intelligence", "science"]
    rows = features.article_features(article(spark, content_text="maintain")).collect()
    assert [r["feature_value"] for r in rows if r["feature_type"] == "topic"] == []


def test_preferred_topics_and_sources_raise_the_score(spark):
    liked = replace(S, preferred_topics=("physics", "ai", "golf"), preferred_source_ids=(2,))
    row = one_row(scoring.base_score(scoring.article_scores(article(spark), liked, clock.instant(NOW)), liked))
    assert (row["topic_score"], row["source_score"]) == (20.0, 20.0)
    assert "matched topics: ai, physics; preferred source" in row["base_reason"]
    plain = one_row(scoring.base_score(scoring.article_scores(article(spark), S, clock.instant(NOW)), S))
    assert (plain["topic_score"], plain["source_score"], plain["freshness_score"]) == (15.0, 10.0, 30.0)


def test_content_type_aliases(spark):
    cases = [("Op-Ed", True, "opinion"), ("breaking news", False, "news"), ("How To", False, "tutorial"),
             ("in-depth", False, "analysis"), ("politics", True, "news"), ("politics", False, "other")]
    for raw, news, kind in cases:
        assert one(spark, features.normalize_content_type(F.lit(raw), F.lit(news))) == kind


def walk(rows, count, budget):
    picked, used = [], 0
    for total, article_id, minutes in sorted(rows, key=lambda r: (-r[0], r[1])):
        if len(picked) >= count:
            break
        if used + minutes <= budget:
            picked.append(article_id)
            used += minutes
    return picked


def test_selection_equals_the_plain_walk(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for user in range(60):
        count, budget = rng.randint(1, 10), rng.randint(2, 60)
        pool = [(float(rng.randint(1, 12)), a, rng.randint(1, 14)) for a in range(rng.randint(0, 60))]
        rows += [(user, count, budget, a, t, m) for t, a, m in pool]
        want[user] = walk(pool, count, budget)
    df = spark.createDataFrame(
        rows, "user_id bigint, target_count int, target_minutes int, article_id bigint, total_score double, reading_minutes int"
    )
    got = {u: [] for u in want}
    for r in sorted(scoring.budgeted_select(df).collect(), key=lambda r: (r["user_id"], r["rank"])):
        got[r["user_id"]].append(r["article_id"])
    assert got == want


def test_budget_skips_but_does_not_stop(spark):
    df = spark.createDataFrame(
        [(1, 5, 10, 1, 9.0, 8), (1, 5, 10, 2, 8.0, 4), (1, 5, 10, 3, 7.0, 2)],
        "user_id bigint, target_count int, target_minutes int, article_id bigint, total_score double, reading_minutes int",
    )
    assert [(r["rank"], r["article_id"]) for r in scoring.budgeted_select(df).orderBy("rank").collect()] == [(1, 1), (2, 3)]


@pytest.mark.parametrize("order", ["graph", "direct"])
def test_trimmed_candidates_give_the_same_lists(spark, monkeypatch, order):
    """Many articles of few profiles: the trim must not change any list, nor do the blocks of users."""
    monkeypatch.setattr(scoring, "USERS_A_BLOCK", 4)
    rng = random.Random(7)
    arts = [(a, rng.randint(200, 2000), f"2024-01-{rng.choice([29, 30])} {rng.randint(1, 23):02d}:00:00", a % 3) for a in range(150)]
    base = spark.createDataFrame(arts, "article_id bigint, word_count bigint, p string, kind int")
    rows = base.select(
        "article_id", F.lit(1).alias("source_id"), "word_count", F.to_timestamp_ntz("p").alias("published_at"),
        F.to_timestamp_ntz("p").alias("discovered_at"), F.lit("t").alias("title"), F.lit("").alias("rss_summary"), F.lit("c").alias("content_text"),
    )
    scored = scoring.article_scores(rows, S, clock.instant(NOW))
    feats = base.select("article_id", F.lit("k").alias("feature_type"), F.col("kind").cast("string").alias("feature_value"), F.lit(1.0).alias("confidence"))
    prefs = spark.createDataFrame(
        [(u, "k", str(k), rng.uniform(-1, 1), 0.8) for u in range(12) for k in range(2)],
        "user_id bigint, feature_type string, feature_value string, score double, confidence double",
    )
    users = features.clamp_user_targets(
        spark.createDataFrame([(u, u, 2 * u) for u in range(14)], "user_id bigint, daily_list_length int, minutes_per_article int")
    )

    def rows_of(out):
        return sorted((r["user_id"], r["rank"], r["article_id"]) for r in out.collect())

    def lists(trim, who=users, what=scored):
        return rows_of(scoring.budgeted_select(scoring.score_candidates(who, what, feats, prefs, S, trim, order), order))

    whole = lists(False)
    assert lists(True) == whole and whole

    since = F.lit("2024-01-30 22:00:00").cast("timestamp_ntz")
    first = lists(False, what=scored.filter(F.col("seen_at") >= since))
    taken = Counter(u for u, _, _ in first)
    full = {r["user_id"] for r in users.collect() if taken[r["user_id"]] >= r["target_count"]}
    assert full and len(full) < 14
    want = sorted([x for x in first if x[0] in full] + [x for x in whole if x[0] not in full])
    assert rows_of(scoring.expand_pool(users, scored, feats, prefs, S, since, order)) == want


def test_rows_no_user_can_reach_are_cut_before_users_join(spark):
    menu = spark.createDataFrame(
        [(a, 2, f"p{a % 50}", 1, 50.0 - a / 10) for a in range(500)] + [(900, 2, "liked", 1, 20.0), (901, 2, None, 1, 45.1), (902, 2, "p0", 99, 90.0)],
        "article_id bigint, minutes_per_article int, profile_id string, reading_minutes int, base_score double",
    )
    feats = spark.createDataFrame(
        [(f"p{k}", "k", "common", 0.5) for k in range(50)] + [("liked", "k", "rare", 1.0), ("liked", "k", "common", 0.5)],
        "profile_id string, feature_type string, feature_value string, confidence double",
    )
    prefs = spark.createDataFrame(
        [(u, "k", "common", 0.02 * (u % 3 - 1), 1.0) for u in range(7)] + [(1, "k", "rare", 1.0, 1.0), (2, "k", "rare", 0.9, 1.0)],
        "user_id bigint, feature_type string, feature_value string, score double, confidence double",
    )
    bounds = scoring.profile_bounds(feats, prefs, S)
    assert {r["profile_id"]: (r["low"], r["high"]) for r in bounds.collect()} == {
        "liked": (-0.3, 30.0), **{f"p{k}": (-0.3, 0.3) for k in range(50)}}
    got = {r["article_id"] for r in scoring.selectable(menu, bounds, 5, 20).collect()}
    # The fifth best row is worth 49.6 - 0.3 to everybody; the best user adds 0.3 to any other row.
    assert got == {*range(11), 900}
    assert {r["article_id"] for r in scoring.selectable(menu, bounds.limit(0), 5, 20).collect()} == {*range(5)}


FEEDBACK = "event_id bigint, user_id bigint, article_id bigint, event_type string, reason string, created_at timestamp_ntz"


def feedback(spark, *kinds, reason=None):
    rows = [(i, 1, 7, k, reason, f"2024-01-01 00:00:{i:02d}") for i, k in enumerate(kinds)]
    return spark.createDataFrame(rows, FEEDBACK.replace("timestamp_ntz", "string")).withColumn(
        "created_at", F.to_timestamp_ntz("created_at")
    )


def test_latest_reaction_counts_and_unstar_removes(spark):
    left = preferences.current_feedback(feedback(spark, "like", "dislike", "star", "unstar")).collect()
    assert [r["event_type"] for r in left] == ["dislike"]


def test_topic_reason_replaces_features(spark):
    feats = spark.createDataFrame([(7, "publisher", "3", 1.0)], ", ".join(
        ["article_id bigint", "feature_type string", "feature_value string", "confidence double"]))
    current = preferences.current_feedback(feedback(spark, "like", reason="topic_health"))
    assert [(r["feature_type"], r["feature_value"]) for r in preferences.feedback_attribution(current, feats).collect()] == [("topic", "health")]
    current = preferences.current_feedback(feedback(spark, "skip", "open"))
    row = one_row(preferences.rebuild_preferences(preferences.feedback_attribution(current, feats)))
    assert row["score"] == pytest.approx((0.1 - 0.4) / 0.5) and row["confidence"] == pytest.approx(0.4)


def test_personal_score(spark):
    feats = spark.createDataFrame([(7, "topic", "science", 0.8)], "article_id bigint, feature_type string, feature_value string, confidence double")
    prefs = spark.createDataFrame([(1, "topic", "science", 1.0, 0.5)], "user_id bigint, feature_type string, feature_value string, score double, confidence double")
    row = one_row(scoring.personalization(feats, prefs, S))
    assert row["personalization_score"] == 12.0 and row["personal_reason"] == "topic 'science' preferred"


def test_targets_are_clamped(spark):
    users = spark.createDataFrame([(1, 0, 1), (2, 99, 99), (3, 5, 6)], "user_id bigint, daily_list_length int, minutes_per_article int")
    got = [tuple(r) for r in features.clamp_user_targets(users).orderBy("user_id").collect()]
    assert got == [(1, 1, 2, 2), (2, 10, 25, 250), (3, 5, 6, 30)]


def test_a_list_may_be_longer_than_ten(spark):
    rows = [(1, i, 12, 100, 3, float(50 - i)) for i in range(12)]
    pool = spark.createDataFrame(
        rows, "user_id bigint, article_id bigint, target_count int, target_minutes int, reading_minutes int, total_score double")
    assert [r["article_id"] for r in scoring.budgeted_select(pool).orderBy("rank").collect()] == list(range(12))


def test_candidates_meet_users_without_a_shuffle_of_their_product(spark):
    """Users and menu are dealt to cells once; scoring and the walk stay there, so only the sides travel."""
    users = features.clamp_user_targets(spark.range(300).select(
        F.col("id").alias("user_id"), F.lit(10).alias("daily_list_length"), (F.col("id") % 4 + 7).cast("int").alias("minutes_per_article")))
    rows = spark.range(400).select(
        F.col("id").alias("article_id"), F.lit(1).alias("source_id"), (200 + F.col("id")).alias("word_count"),
        F.to_timestamp_ntz(F.lit("2024-01-30 10:00:00")).alias("published_at"), F.to_timestamp_ntz(F.lit("2024-01-30 10:00:00")).alias("discovered_at"),
        F.lit("t").alias("title"), F.lit("").alias("rss_summary"), F.lit("c").alias("content_text"))
    scored = scoring.article_scores(rows, S, clock.instant(NOW))
    feats = rows.select("article_id", F.lit("k").alias("feature_type"), (F.col("article_id") % 90).cast("string").alias("feature_value"), F.lit(1.0).alias("confidence"))
    prefs = spark.range(300).select(
        F.col("id").alias("user_id"), F.lit("k").alias("feature_type"), (F.col("id") % 90).cast("string").alias("feature_value"), F.lit(1.0).alias("score"), F.lit(0.5).alias("confidence"))
    plan = scoring.select_lists(users, scored, feats, prefs, S)._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("SortMergeJoin [minutes_per_article")]
    assert "Exchange" not in above and "Window" in above


def test_lists_are_made_where_users_and_menu_are_dealt(spark, monkeypatch):
    """A second shuffle by fewer columns would be sized by the small sides, and a few tasks would sort all candidates on disk."""
    monkeypatch.setattr(scoring, "USERS_A_BLOCK", 40)
    users = features.clamp_user_targets(spark.range(300).select(
        F.col("id").alias("user_id"), F.lit(10).alias("daily_list_length"), (F.col("id") % 4 + 7).cast("int").alias("minutes_per_article")))
    scored = scoring.article_scores(article(spark), S, clock.instant(NOW))
    feats = spark.createDataFrame([(1, "k", "v", 1.0)], "article_id bigint, feature_type string, feature_value string, confidence double")
    prefs = spark.createDataFrame([(1, "k", "v", 1.0, 0.5)], "user_id bigint, feature_type string, feature_value string, score double, confidence double")
    lists = scoring.select_lists(users, scored, feats, prefs, S)
    assert lists.count() == 300
    plan = lists._jdf.queryExecution().executedPlan().toString()
    join = plan[plan.index("SortMergeJoin [minutes_per_article"):]
    dealt = [line for line in join.splitlines() if "Exchange hashpartitioning(minutes_per_article" in line and "_block" in line]
    assert dealt and all("REPARTITION_BY_NUM" in line for line in dealt)
