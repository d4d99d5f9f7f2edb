"""Queries M: the streaming jobs, run over everything there is and read back.

The given tables are the stream source (one file per table; ``split`` writes a
table out as several files, so that state has to survive between micro-batches).
"""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.plans.ingest import scratch
from newsloom.plans.registry import REGISTRY, query
from newsloom.plans.views import SETTINGS, VIEW_SQL, Views
from newsloom.sources.tables import TABLES
from newsloom.streaming import jobs
from newsloom.streaming.store import BatchLog, VersionedTable


class StreamViews(Views):
    """The derived views over streaming reads of ``streamed`` tables."""

    def __init__(self, base: Views, streamed: str, files: int = 4):
        super().__init__(base.spark, base.folder)
        self.base, self.streamed, self.files = base, streamed, files

    def table(self, name: str) -> DataFrame:
        if name != self.streamed:
            return super().table(name)
        folder = f"{scratch(self.base, 'stream')}/{name}"
        self.base.table(name).repartition(self.files).write.parquet(folder)
        return (
            self.spark.readStream.schema(TABLES[name]).option("maxFilesPerTrigger", 1).parquet(folder)
        )


def run(stream: DataFrame, each, folder: str, mode: str = "append") -> int:
    """Run to the end; returns the last version number written."""
    q = jobs.start(stream, each, f"{folder}/checkpoint", mode)
    q.awaitTermination()
    return (q.lastProgress or {"batchId": -1})["batchId"] + 1


def place(v: Views, name: str) -> str:
    return scratch(v, name)


@query(
    "m1_stream_feed_dedup",
    REGISTRY["a4_dedup_feed_items"].sql.replace("SELECT page_id, kept FROM walk WHERE i > 0", "SELECT page_id FROM walk WHERE kept"),
)
def m1(v):
    """One micro-batch over the pages, against an empty store."""
    folder = place(v, "m1")
    store = BatchLog(f"{folder}/kept", jobs.ITEM_KEYS)
    pages = StreamViews(v, "pages", files=1).feed_items.withColumn("seen_at", v.as_of)
    stream = jobs.feed_dedup_stream(pages.select("item_order", "url", "source_id", "guid", "seen_at"), "seen_at", "1 day")
    run(stream, jobs.feed_dedup_batches(store), folder)
    kept = store.read_before(v.spark, 1 << 60)
    return kept.select(F.col("item_order").alias("page_id"))


def counted(v: Views, name: str, stream: DataFrame) -> DataFrame:
    """The last complete result of a stream that is counted over several micro-batches."""
    folder = place(v, name)

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/v{batch_id + 1}")

    last = run(stream, each, folder, "complete")
    return v.spark.read.parquet(f"{folder}/v{last}")


_COUNTS = "count(*) AS page_views, count(DISTINCT visitor_hash) AS unique_visitors, count(DISTINCT user_id) AS signed_in_users"


@query("m2_stream_usage", f"SELECT CAST(CAST(created_at AS DATE) AS VARCHAR) AS day, {_COUNTS} FROM v_usage GROUP BY 1")
def m2(v):
    found = jobs.usage_counts(counted(v, "m2", jobs.usage_windows(StreamViews(v, "events").usage, "40 days")))
    return found.withColumn("start", F.to_date("start")).withColumnRenamed("start", "day")


@query(
    "m2_stream_usage_sliding",
    f"""
SELECT strftime(start, '%Y-%m-%d %H') AS start, {_COUNTS} FROM (
  SELECT *, unnest([time_bucket(INTERVAL 12 HOURS, created_at), time_bucket(INTERVAL 12 HOURS, created_at) - INTERVAL 12 HOURS]) AS start
  FROM v_usage) GROUP BY ALL""",
)
def m2_sliding(v):
    """Days that begin every twelve hours."""
    halves = jobs.usage_windows(StreamViews(v, "events").usage, "40 days", "1 day", "12 hours")
    found = jobs.usage_counts(counted(v, "m2-sliding", halves))
    return found.withColumn("start", F.date_format("start", "yyyy-MM-dd HH"))


@query(
    "m2_merged_weeks",
    f"SELECT strftime(date_trunc('week', created_at), '%Y-%m-%d') AS week, {_COUNTS} FROM v_usage GROUP BY 1",
)
def m2_weeks(v):
    """Weeks from the stored days: a visitor of several days counts once."""
    days = counted(v, "m2-days", jobs.usage_windows(StreamViews(v, "events").usage, "40 days"))
    weeks = jobs.usage_counts(days, F.date_trunc("week", "start"))
    return weeks.withColumn("start", F.date_format("start", "yyyy-MM-dd")).withColumnRenamed("start", "week")


@query(
    "m2_stream_sessions",
    """
SELECT visitor_hash, strftime(min(created_at), '%Y-%m-%d %H:%M:%S') AS started_at,
  strftime(max(created_at) + INTERVAL 6 HOURS, '%Y-%m-%d %H:%M:%S') AS ended_at, count(*) AS page_views FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY visitor_hash ORDER BY created_at, event_id) AS visit FROM (
    SELECT *, CASE WHEN created_at <= lag(created_at) OVER (PARTITION BY visitor_hash ORDER BY created_at, event_id) + INTERVAL 6 HOURS
      THEN 0 ELSE 1 END AS fresh FROM v_usage)) GROUP BY visitor_hash, visit""",
)
def m2_sessions(v):
    """Visits with pauses of six hours at most."""
    found = counted(v, "m2-sessions", jobs.usage_sessions(StreamViews(v, "events").usage, "40 days", "6 hours"))
    return found.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("started_at", "ended_at")})


@query(
    "m3_stream_preferences",
    "SELECT user_id, feature_type, feature_value, round(score, 6) AS score, confidence, positive_count, negative_count FROM v_preferences",
)
def m3(v):
    from newsloom.session import cut_lineage

    folder = place(v, "m3")
    latest = VersionedTable(f"{folder}/latest", jobs.FEEDBACK)
    result = VersionedTable(f"{folder}/preferences", jobs.PREFERENCES)
    each = jobs.preference_batches(latest, result, cut_lineage(v.features))
    last = run(StreamViews(v, "events").feedback, each, folder)
    return result.read(v.spark, last).withColumn("score", F.round("score", 6))


VIEW_SQL["v_story_heads"] = "SELECT article_id, story_id * 8 AS cluster_id FROM v_vectors"


@query("m4_stream_cluster", "SELECT article_id, cluster_id FROM v_story_heads")
def m4(v):
    """Clusters are named by the smallest id they ended up with."""
    from dataclasses import replace

    folder = place(v, "m4")
    centroids = VersionedTable(f"{folder}/centroids", jobs.CENTROIDS)
    members = BatchLog(f"{folder}/members", jobs.MEMBERS)
    # Stories of the last ten days stay joinable.
    settings = replace(SETTINGS, cluster_lookback_days=10)
    arriving = StreamViews(v, "embeddings").table("embeddings").select(F.col("vec_id").alias("article_id"))
    each = jobs.cluster_batches(centroids, members, settings, v.as_of)

    def with_vectors(batch: DataFrame, batch_id: int) -> None:
        rows = v.vectors.join(batch, "article_id", "left_semi")
        each(rows.select("article_id", "model", "vector", "event_date"), batch_id)

    run(arriving, with_vectors, folder)
    found = members.read_before(v.spark, 1 << 60)
    heads = found.groupBy("cluster_id").agg(F.min("article_id").alias("head"))
    return found.join(heads, "cluster_id").select("article_id", F.col("head").alias("cluster_id"))


@query(
    "m5_stream_expiry",
    "SELECT call_id, run_id FROM v_model_calls WHERE expires_at >= (SELECT max(created_at) FROM v_model_calls)",
)
def m5(v):
    folder = place(v, "m5")
    schema = "call_id bigint, run_id bigint, created_at timestamp_ntz, expires_at timestamp_ntz"
    table = VersionedTable(folder + "/calls", schema)
    calls = StreamViews(v, "events").model_calls.select("call_id", "run_id", "created_at", "expires_at")
    last = run(calls, jobs.expiry_batches(table, "created_at"), folder)
    return table.read(v.spark, last).select("call_id", "run_id")
