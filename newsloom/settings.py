"""Curation settings. Defaults are fixed values: results depend on them."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # filtering
    article_min_words: int = 150
    min_article_words: int = 200
    max_article_words: int = 4000
    max_article_age_hours: int = 48
    allowed_languages: tuple[str, ...] = ("en",)
    allowed_content_types: tuple[str, ...] = ("news", "analysis", "opinion", "tutorial", "other")
    preferred_topics: tuple[str, ...] = ()
    preferred_source_ids: tuple[int, ...] = ()
    blocked_source_ids: tuple[int, ...] = ()
    # selection
    reading_words_per_minute: int = 225
    max_list_length: int = 10
    max_minutes_per_article: int = 25
    personalization_weight: float = 30.0
    timezone: str = "America/Los_Angeles"
    # model work
    run_article_cap: int = 30
    embedding_batch_size: int = 10
    prompt_version: str = "phase5-v2"
    # story clusters
    similarity_threshold: float = 0.82
    redundancy_threshold: float = 0.94
    cluster_max_articles: int = 5
    cluster_lookback_days: int = 7
    # chunks and retrieval
    chunk_word_threshold: int = 1500
    chunk_target_words: int = 800
    chunk_overlap_words: int = 100
    retrieval_chunk_limit: int = 20
    bm25_weight: float = 0.4
    vector_weight: float = 0.6
    # claims
    max_claim_pairs: int = 20
    pair_batch_size: int = 5
    # retention
    selected_evidence_retention_days: int = 30
    usage_retention_days: int = 365
    # supplements
    supplement_word_ratio: float = 0.5
    max_evidence_per_area: int = 3
