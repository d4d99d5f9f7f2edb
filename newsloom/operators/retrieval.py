"""Chunking and hybrid BM25 + vector retrieval, for all groups at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.text import PIECE, SPACE, let, terms, words
from newsloom.functions.vectors import cosine, unit_interval
from newsloom.session import cut_lineage
from newsloom.settings import Settings

# Okapi BM25.
K1, B = 1.5, 0.75


def windows(text: Column, target: int, overlap: int) -> Column:
    """Overlapping word windows as exact slices of ``text`` with code-point offsets.

    Works inside one row: the text is cut into word pieces once, block lengths
    give the offset of every window start, and the text is never shuffled.
    """
    step = max(1, target - overlap)
    pieces = F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))

    def joined(p: Column, start: Column, size: int) -> Column:
        return F.array_join(F.slice(p, start + 1, F.lit(size)), "")

    def cut(p: Column) -> Column:
        n = F.size(p)
        last = F.greatest(F.lit(0), F.ceil((n - target) / F.lit(float(step))).cast("int"))
        numbers = F.sequence(F.lit(0), last)
        offsets = F.aggregate(
            numbers,
            F.array(F.lit(0)),
            lambda acc, c: F.concat(
                acc, F.array(F.element_at(acc, -1) + F.length(joined(p, c * step, step)))
            ),
        )

        def one(c: Column, offset: Column) -> Column:
            return let(
                joined(p, c * step, target),
                lambda raw: F.struct(
                    c.alias("chunk_index"),
                    F.regexp_replace(raw, f"^[{SPACE}]+", "").alias("chunk_text"),
                    F.least(F.lit(target), n - c * step).alias("chunk_words"),
                    (
                        offset + F.length(raw)
                        - F.length(F.regexp_replace(raw, f"^[{SPACE}]+", ""))
                    ).alias("character_start"),
                    (offset + F.length(raw)).alias("character_end"),
                ),
            )

        rows = let(offsets, lambda o: F.transform(numbers, lambda c: one(c, F.get(o, c))))
        return F.when(n > 0, rows)

    return let(pieces, cut)


def chunk_text(
    articles: DataFrame, settings: Settings, text: str = "content_text", key: str = "article_id"
) -> DataFrame:
    """F1. One chunk for a short article, word windows for a long one."""
    body = F.col(text)
    whole = F.array(
        F.struct(
            F.lit(0).alias("chunk_index"),
            body.alias("chunk_text"),
            F.col("word_count").cast("int").alias("chunk_words"),
            F.lit(0).alias("character_start"),
            F.length(body).alias("character_end"),
        )
    )
    pieces = F.when(F.col("word_count") < settings.chunk_word_threshold, whole).otherwise(
        windows(body, settings.chunk_target_words, settings.chunk_overlap_words)
    )
    return (
        articles.filter(F.coalesce(body, F.lit("")) != "")
        .select(key, F.inline(pieces))
        .withColumnRenamed("chunk_words", "word_count")
        .withColumn("content_hash", F.sha2("chunk_text", 256))
    )


def _matches(tokens: Column, asked: Column) -> Column:
    """Length of a token list and how often each asked term is in it, inside the row."""
    def count(own: Column) -> Column:
        found = F.filter(own, lambda t: F.array_contains(asked, t))
        return F.struct(
            F.size(own).alias("dl"),
            let(found, lambda f: F.transform(asked, lambda t: F.size(f) - F.size(F.array_remove(f, t)))).alias("tf"),
        )

    return let(tokens, count)


def _okapi(tf: Column, dl: Column, df: Column, n_docs: Column, avg_dl: Column) -> Column:
    """BM25 of one document: ``tf`` and ``df`` are arrays over the asked terms."""
    average = F.when(avg_dl == 0, 1.0).otherwise(avg_dl)

    def weight(f: Column, n: Column) -> Column:
        idf = F.log(1 + (n_docs - n + 0.5) / (n + 0.5))
        return F.when(f > 0, idf * f * (K1 + 1) / (f + K1 * (1 - B + B * dl / average))).otherwise(0.0)

    return F.aggregate(F.zip_with(tf, df, weight), F.lit(0.0), lambda acc, x: acc + x)


def bm25(docs: DataFrame, queries: DataFrame, group: list[str], doc: list[str], text: str = "text") -> DataFrame:
    """F3. Okapi BM25 of every document against its group's query.

    ``docs(*group, *doc, text)``, ``queries(*group, text)``, one query per group;
    the corpus is the group and query terms count once. Groups without a query
    are not searched, nor are null texts.

    A group's query terms join its documents once; text is tokenised and counted inside
    the row, and only lengths and counts are kept, one row a document. Document
    frequencies are partial counts of (group, place of the term), so a big group needs no
    task of its own.
    """
    asked = queries.select(*group, F.array_distinct(terms(F.col(text))).alias("_asked"))
    counts = cut_lineage(
        docs.filter(F.col(text).isNotNull()).join(asked, group)
        .select(*group, *doc, _matches(terms(F.col(text)), F.col("_asked")).alias("_m"))
        .select(*group, *doc, "_m.dl", "_m.tf")
    )
    stats = counts.groupBy(*group).agg(
        F.count("*").alias("n_docs"), F.avg("dl").alias("avg_dl"), F.max(F.size("tf")).alias("_asked"))
    df = (
        counts.select(*group, F.posexplode("tf").alias("k", "f")).filter("f > 0")
        .groupBy(*group, "k").agg(F.count("*").alias("df"))
        .groupBy(*group).agg(F.map_from_entries(F.collect_list(F.struct("k", "df"))).alias("df"))
    )
    places = F.when(F.col("_asked") > 0, F.sequence(F.lit(0), F.col("_asked") - 1)).otherwise(F.array().cast("array<int>"))
    known = stats.join(df, group, "left").select(
        *group, "n_docs", "avg_dl", F.transform(places, lambda k: F.coalesce(F.try_element_at("df", k), F.lit(0))).alias("df"))
    score = _okapi(F.col("tf"), F.col("dl"), F.col("df"), F.col("n_docs"), F.col("avg_dl"))
    return counts.join(known, group).select(*group, *doc, score.alias("score"))


def minmax(scores: DataFrame, group: list[str], score: str = "score") -> DataFrame:
    """F4. Scale scores to 0-1 inside a group; equal scores become 1 if positive, else 0."""
    bounds = scores.groupBy(*group).agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))
    lo, hi = F.col("_lo"), F.col("_hi")
    flat = F.abs(hi - lo) <= 1e-9 * F.greatest(F.abs(lo), F.abs(hi))
    scaled = F.when(flat, F.when(hi > 0, 1.0).otherwise(0.0)).otherwise(
        F.try_divide(F.col(score) - lo, hi - lo)
    )
    return scores.join(bounds, group).withColumn("scaled", scaled).drop("_lo", "_hi")


def vector_score(vector: Column, centroid: Column) -> Column:
    return F.when(
        vector.isNotNull() & centroid.isNotNull(), unit_interval(cosine(vector, centroid))
    ).otherwise(0.0)


def hybrid_score(lexical: Column, semantic: Column, settings: Settings) -> Column:
    """F5. Weights are scaled to sum 1; both zero means half and half."""
    total = settings.bm25_weight + settings.vector_weight
    a, b = (settings.bm25_weight / total, settings.vector_weight / total) if total else (0.5, 0.5)
    return F.lit(a) * lexical + F.lit(b) * semantic


def coverage_first_topk(
    ranked: DataFrame, group: list[str], unit: list[str], order: list[Column], k: int
) -> DataFrame:
    """F6. The best row of every unit first, then the rest by order, k per group.

    Two limited ranks find all rows that can be chosen (the k best units' best
    rows, and the k best rows); only those few are ranked together.
    """
    def limited(rows: DataFrame, by: list[str], n: int) -> DataFrame:
        number = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
        return rows.withColumn("_n", number).filter(F.col("_n") <= n).drop("_n")

    leaders = limited(limited(ranked, [*group, *unit], 1), group, k).withColumn("_tier", F.lit(0))
    others = limited(ranked, group, k).withColumn("_tier", F.lit(1))
    pool = leaders.unionByName(others)
    # A leader that is also among the k best rows appears twice; its tier 0 copy wins.
    same_row = Window.partitionBy(*group, *unit).orderBy(*order)
    final = Window.partitionBy(*group).orderBy("_tier", *order)
    return (
        pool.withColumn("_place", F.rank().over(same_row))
        .filter((F.col("_tier") == 0) | (F.col("_place") > 1))
        .withColumn("rank", F.row_number().over(final))
        .filter(F.col("rank") <= k)
        .drop("_tier", "_place")
    )


def cluster_query(clusters: DataFrame, members: DataFrame, articles: DataFrame) -> DataFrame:
    """F7. Title, summary and distinct member titles, in article order.

    Only ``coverage`` members speak, and pruning leaves at most five of them.
    """
    titles = (
        members.filter("relationship = 'coverage'")
        .join(articles.select("article_id", "title"), "article_id")
        .groupBy("cluster_id")
        .agg(F.sort_array(F.collect_list(F.struct("article_id", "title"))).alias("rows"))
    )
    parts = F.filter(
        F.concat(
            F.array("representative_title", "event_summary"),
            F.array_distinct(F.transform("rows", lambda r: r["title"])),
        ),
        lambda p: F.coalesce(p, F.lit("")) != "",
    )
    return clusters.join(titles, "cluster_id").select(
        "cluster_id", F.array_join(parts, " ").alias("text")
    )


def hybrid_retrieve(
    chunks: DataFrame, queries: DataFrame, clusters: DataFrame, settings: Settings
) -> DataFrame:
    """F3-F6 in one chain: ``chunks(cluster_id, article_id, chunk_id, chunk_text,
    vector)`` -> the ranked chunks of every cluster."""
    lexical = minmax(
        bm25(
            chunks.select("cluster_id", "article_id", "chunk_id", F.col("chunk_text").alias("text")),
            queries, ["cluster_id"], ["article_id", "chunk_id"],
        ),
        ["cluster_id"],
    ).select("cluster_id", "article_id", "chunk_id", F.col("scaled").alias("bm25_score"))
    semantic = (
        chunks.select("cluster_id", "article_id", "chunk_id", "vector")
        .join(clusters.select("cluster_id", "centroid"), "cluster_id")
        .select("cluster_id", "article_id", "chunk_id",
                vector_score(F.col("vector"), F.col("centroid")).alias("vector_score"))
    )
    scored = lexical.join(semantic, ["cluster_id", "article_id", "chunk_id"]).withColumn(
        "hybrid_score", F.round(hybrid_score(F.col("bm25_score"), F.col("vector_score"), settings), 9)
    )
    return coverage_first_topk(
        scored, ["cluster_id"], ["article_id"],
        [F.desc("hybrid_score"), F.asc("chunk_id")], settings.retrieval_chunk_limit,
    )


def local_search(
    searches: DataFrame,
    members: DataFrame,
    chunks: DataFrame,
    articles: DataFrame,
    clusters: DataFrame,
    settings: Settings,
    relationships: tuple[str, ...] = ("coverage", "redundant"),
    limit: int = 5,
) -> DataFrame:
    """F8. Search the story of a selected article, without the article itself.

    ``searches(search_id, article_id, query, start_date, end_date)``. The corpus
    of a search is its own group, so all searches run as one job.
    """
    place = searches.join(members.select("article_id", "cluster_id"), "article_id").select(
        "search_id", "cluster_id", "query", "start_date", "end_date",
        F.col("article_id").alias("selected_id"),
    )
    others = members.filter(F.col("relationship").isin(*relationships)).select(
        "cluster_id", "article_id", "relationship"
    )
    meta = articles.select("article_id", "publisher_id", "canonical_url", "title", "published_at")
    scope = (
        place.join(others, "cluster_id")
        .filter("article_id <> selected_id")
        .join(meta, "article_id")
        .filter(
            (F.col("start_date").isNull() | (F.col("published_at") >= F.col("start_date")))
            & (F.col("end_date").isNull() | (F.col("published_at") < F.date_add("end_date", 1)))
        )
    )
    pool = scope.join(chunks.select("article_id", "chunk_id", "chunk_text", "vector"), "article_id")
    lexical = minmax(
        bm25(
            pool.select("search_id", "chunk_id", F.col("chunk_text").alias("text")),
            place.select("search_id", F.col("query").alias("text")),
            ["search_id"], ["chunk_id"],
        ),
        ["search_id"],
    ).select("search_id", "chunk_id", F.col("scaled").alias("lexical"))
    semantic = vector_score(F.col("vector"), F.col("centroid"))
    scored = (
        pool.join(clusters.select("cluster_id", "centroid"), "cluster_id")
        .join(lexical, ["search_id", "chunk_id"])
        .select(
            "search_id", "article_id", "chunk_id", "relationship", "publisher_id", "title",
            "canonical_url", "published_at",
            F.round(hybrid_score(F.col("lexical"), semantic, settings), 9).alias("score"),
        )
    )
    order = [
        F.desc(F.col("relationship") == "coverage"), F.desc("score"), F.asc("chunk_id"),
    ]
    return coverage_first_topk(scored, ["search_id"], ["article_id"], order, limit)


def best_excerpt(documents: DataFrame, target_words: int = 350) -> DataFrame:
    """F9. The window of each document that answers its query best; first on ties.

    ``documents(doc_id, text, query)``. A document is its own corpus, so windows are
    cut, counted and compared inside the row and nothing is shuffled.
    """
    # Texts without a word are dropped by the text: a filter on the windows would cut them twice.
    pieces = documents.filter(F.col("text").rlike(f"[^{SPACE}]")).select(
        "doc_id", windows(F.col("text"), target_words, min(60, target_words // 4)).alias("pieces"),
        F.array_distinct(terms(F.coalesce("query", F.lit("")))).alias("asked"),
    )
    counted = pieces.select(
        "doc_id", "asked", F.transform("pieces", lambda p: F.struct(
            p["chunk_index"].alias("chunk_index"), p["chunk_text"].alias("excerpt"), _matches(terms(p["chunk_text"]), F.col("asked")).alias("m"),
        )).alias("pieces"))
    total = F.aggregate("pieces", F.lit(0).cast("bigint"), lambda acc, p: acc + p["m"]["dl"])
    held = F.transform("asked", lambda t, k: F.size(F.filter("pieces", lambda p: F.get(p["m"]["tf"], k) > 0)))
    known = counted.select("doc_id", "pieces", F.size("pieces").alias("n"), (total / F.size("pieces")).alias("average"), held.alias("df"))
    scored = F.transform("pieces", lambda p: F.struct(
        F.round(_okapi(p["m"]["tf"], p["m"]["dl"], F.col("df"), F.col("n"), F.col("average")), 9).alias("s"),
        (-p["chunk_index"]).alias("o"), p["excerpt"].alias("excerpt")))
    return known.select("doc_id", F.array_max(scored).alias("b")).select(
        "doc_id", (-F.col("b.o")).alias("chunk_index"), F.col("b.excerpt").alias("excerpt"))


def collect_excerpt(found: DataFrame, stored: DataFrame | None, max_words: int) -> DataFrame:
    """F10. First words of each hit with a content hash, each text once per run.

    ``found(run_id, found_order, url, text)``, ``stored(run_id, content_hash)``.
    """
    excerpt = F.array_join(F.slice(words(F.col("text")), 1, max_words), " ")
    cut = found.withColumn("excerpt", excerpt).withColumn(
        "content_hash", F.sha2(F.concat_ws("\n", "url", "excerpt"), 256)
    )
    if stored is not None:
        cut = cut.join(stored.select("run_id", "content_hash"), ["run_id", "content_hash"], "left_anti")
    rest = [c for c in cut.columns if c not in ("run_id", "content_hash", "text")]
    return (
        cut.groupBy("run_id", "content_hash")
        .agg(F.min_by(F.struct(*rest), "found_order").alias("first"))
        .select("run_id", "content_hash", "first.*")
    )
