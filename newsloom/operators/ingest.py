"""Feed items in: normalise, canonicalise, deduplicate, gate, group into publishers."""

from __future__ import annotations

import html
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import urls
from newsloom.functions.text import collapse, fold, non_empty, strip, word_count
from newsloom.session import cut_lineage

# Pages that carry media instead of an article.
MEDIA_SEGMENTS = ("audio", "live", "livestream", "podcast", "podcasts", "video", "videos")
MEDIA_TITLE = r"(?i)^(?:watch|listen)(?:\s+live)?\s*:|\blive\s+stream\b"


def _character_references() -> Callable[[Column], Column]:
    """All character references of HTML, numeric and named, in one pass. Spark has no such
    function and a chain of 2,231 replaces would decode twice, so this is an Arrow batch function."""

    def decode(texts: pd.Series) -> pd.Series:
        return texts.map(html.unescape, na_action="ignore")

    return F.pandas_udf(decode, "string")


def plain_text(x: Column) -> Column:
    """Feed markup to text: tags out, character references decoded, spaces collapsed; '' is null."""
    return non_empty(collapse(_character_references()(F.regexp_replace(x, "<[^>]+>", " "))))


def absolute_url(link: Column, base: Column) -> Column:
    """Resolve a feed link against the address the feed came from."""
    root = F.concat(urls.scheme(base), F.lit("://"), urls.authority(base))
    folder = F.regexp_replace(F.concat(root, urls.path(base)), "/[^/]*$", "/")
    return (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(urls.scheme(base), F.lit(":"), link))
        .when(link.startswith("/"), F.concat(root, link))
        .otherwise(F.concat(folder, link))
    )


def feed_item_normalize(items: DataFrame) -> DataFrame:
    """A2. ``items(link, base_url, guid, title, summary, author, published, updated, ...)``."""
    return items.filter(F.coalesce(F.col("link"), F.lit("")) != "").select(
        *[
            c
            for c in items.columns
            if c
            not in ("link", "base_url", "guid", "title", "summary", "author", "published", "updated")
        ],
        non_empty(strip(F.col("guid"))).alias("guid"),
        absolute_url(F.col("link"), F.col("base_url")).alias("url"),
        F.coalesce(plain_text(F.col("title")), F.lit("Untitled")).alias("title"),
        plain_text(F.col("summary")).alias("summary"),
        plain_text(F.col("author")).alias("author"),
        F.coalesce("published", "updated").alias("published_at"),
    )


def canonicalize_url(items: DataFrame, url: str = "url") -> DataFrame:
    """A3. Add ``canonical_url`` and its SHA-256 ``url_hash``."""
    return items.withColumn("canonical_url", urls.canonicalize(F.col(url))).withColumn(
        "url_hash", F.sha2(F.col("canonical_url"), 256)
    )


def dedup_feed_items(items: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """A4. Add ``kept``: walking by ``item_order``, an item is dropped when an
    earlier *kept* item (or a stored one) has its url hash or its non-null
    (source, guid). A dropped item blocks nobody, so this is a fixpoint:

    * drop an undecided item that has an earlier kept twin,
    * keep one that has no earlier kept or undecided twin.

    ``items(item_order, url_hash, source_id, guid)``. Copies of one
    (url, source, guid) triple are folded into their first copy by a partial
    aggregate before anything is joined, so a hot URL costs one row. Keys are
    matched by aggregate + join, never by a window over a whole key group.
    A round decides the oldest open item at least, so the loop ends however long
    a chain is; items without an order cannot be decided and are an error.
    """
    triple = ["url_hash", "source_id", "guid"]
    first = items.groupBy(*triple).agg(F.min("item_order").alias("item_order"))
    state = first.withColumn("kept", F.lit(None).cast("boolean"))
    if stored is not None:
        by_url = stored.select("url_hash").distinct().withColumn("_url", F.lit(True))
        by_guid = (
            stored.filter("guid IS NOT NULL").select("source_id", "guid").distinct()
            .withColumn("_guid", F.lit(True))
        )
        state = (
            state.join(by_url, "url_hash", "left")
            .join(by_guid, ["source_id", "guid"], "left")
            .withColumn("kept", F.when(F.col("_url") | F.col("_guid"), False))
            .drop("_url", "_guid")
        )
    state = cut_lineage(state.select(*triple, "item_order", "kept"))
    before = None
    while (left := state.filter("kept IS NULL").count()) > 0:
        if left == before:
            raise ValueError(f"{left} feed items cannot be decided: is item_order null?")
        before = left
        live = state.filter("kept IS NULL OR kept")
        marks = (
            F.min("item_order").alias("live"),
            F.min(F.when(F.col("kept"), F.col("item_order"))).alias("taken"),
        )
        url_marks = live.groupBy("url_hash").agg(*marks)
        guid_marks = live.filter("guid IS NOT NULL").groupBy("source_id", "guid").agg(*marks)
        step = (
            state.alias("s")
            .join(url_marks.alias("u"), "url_hash", "left")
            .join(guid_marks.alias("g"), ["source_id", "guid"], "left")
        )
        order = F.col("s.item_order")
        taken = F.least("u.taken", "g.taken")
        oldest = F.least("u.live", "g.live")
        verdict = F.when(F.col("s.kept").isNotNull(), F.col("s.kept")).when(
            taken < order, False
        ).when(oldest == order, True)
        state = cut_lineage(
            step.select("url_hash", "source_id", "guid", order.alias("item_order"),
                        verdict.alias("kept"))
        )
    kept_orders = state.filter("kept").select("item_order", F.lit(True).alias("kept"))
    return items.join(kept_orders, "item_order", "left").withColumn(
        "kept", F.coalesce("kept", F.lit(False))
    )


def enabled_feeds(sources: DataFrame, publishers: DataFrame) -> DataFrame:
    """A5. Sources whose own switch and whose publisher's switch are on."""
    on = publishers.filter("enabled").select("publisher_id")
    return sources.filter("enabled").join(on, "publisher_id", "left_semi")


def discovery_stats(outcomes: DataFrame) -> DataFrame:
    """A6. ``outcomes(source_id, outcome)`` counted per source; null source = the run."""
    counts = [
        F.count_if(F.col("outcome").isin("extracted", "failed", "content_duplicate")).alias("discovered"),
        F.count_if(F.col("outcome").isin("duplicate", "content_duplicate")).alias("duplicates"),
        F.count_if(F.col("outcome") == "failed").alias("failed"),
        F.count_if(F.col("outcome").isin("extracted", "content_duplicate")).alias("extracted"),
    ]
    return outcomes.rollup("source_id").agg(*counts)


def content_dedup(articles: DataFrame, batch: DataFrame) -> DataFrame:
    """A7. Batch rows with an older extracted twin become ``duplicate``.

    ``articles(article_id, status, content_hash)``, ``batch(article_id)``. The
    twin of a hash is a ``min`` with map-side combine plus a join back, so one
    text repeated everywhere does not gather in one task.
    """
    usable = articles.filter("status = 'extracted' AND content_hash IS NOT NULL").select(
        "article_id", "content_hash"
    )
    oldest = usable.groupBy("content_hash").agg(F.min("article_id").alias("first_id"))
    joined = usable.join(batch.select("article_id"), "article_id", "left_semi").join(
        oldest, "content_hash"
    )
    twin = F.col("first_id") < F.col("article_id")
    return joined.select(
        "article_id",
        F.when(twin, "duplicate").otherwise("extracted").alias("status"),
        F.when(twin, F.col("first_id")).alias("duplicate_of"),
    )


def is_media_page(url: Column, title: Column | None = None) -> Column:
    """A8. A path segment or the title says audio, video or live stream."""
    segments = F.split(fold(urls.path(url)), "/")
    hit = F.arrays_overlap(segments, F.array(*[F.lit(s) for s in MEDIA_SEGMENTS]))
    if title is not None:
        hit = hit | F.coalesce(strip(title).rlike(MEDIA_TITLE), F.lit(False))
    return hit


def extraction_gate(cleaned: DataFrame, min_words: int) -> DataFrame:
    """A11. ``cleaned(article_id, content)`` -> words, hash, status and reason."""
    n = word_count(F.col("content"))
    enough = F.col("word_count") >= min_words
    return (
        cleaned.withColumn("word_count", n)
        .withColumn(
            "content_hash", F.when(enough, F.sha2(F.col("content"), 256))
        )
        .withColumn("status", F.when(enough, "extracted").otherwise("failed"))
        .withColumn(
            "reason",
            F.when(~enough, F.when(F.coalesce("content", F.lit("")) == "", "no_text")
                   .otherwise("too_few_words")),
        )
    )


def group_feeds_into_publishers(sources: DataFrame) -> DataFrame:
    """A12. Feeds of one normalised site share a publisher, named by the first id;
    a feed without a site is its own publisher."""
    key = F.coalesce(
        F.lower(F.regexp_replace("site_url", "/+$", "")),
        F.concat(F.lit("source:"), F.col("source_id")),
    )
    keyed = sources.withColumn("site_key", key)
    heads = keyed.groupBy("site_key").agg(
        F.min("source_id").alias("publisher_source_id"),
        F.min_by("name", "source_id").alias("publisher_name"),
    )
    return keyed.join(heads, "site_key").select(
        "source_id", "publisher_source_id", "publisher_name"
    )
