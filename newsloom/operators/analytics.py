"""Usage counts and run metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import clock
from newsloom.functions.text import round_to

# The steps of a run and the counters each reports about itself.
# ``load_settings``, ``expand_sources``, ``supplement`` and ``finalize`` have their own rules.
NODE_COUNTERS = {
    "load_settings": (),
    "collect": ("sources_polled",),
    "exact_deduplicate": ("exact_unique_candidates",),
    "extract": ("extracted", "extraction_failed"),
    "content_deduplicate": ("content_unique_candidates", "content_duplicates"),
    "classify": ("classified_candidates",),
    "filter": ("classified_candidates",),
    "ai_classify": ("ai_classified",),
    "embed_articles": ("articles_embedded",),
    "cluster_stories": ("eligible_candidates",),
    "chunk_articles": ("chunks_created",),
    "embed_chunks": ("chunks_embedded",),
    "extract_claims": ("claims_created",),
    "compare_evidence": ("clusters_compared",),
    "apply_evidence": ("post_evidence_candidates",),
    "personalize": ("scored_candidates",),
    "select": ("scored_candidates",),
    "expand_sources": (),
    "persist_list": ("final_article_count",),
    "supplement": (),
    "finalize": (),
}
EXPANSION_COUNTER = "round_1_database_candidates"
SUPPLEMENT_COUNTERS = (
    "supplements_complete", "supplements_skipped", "supplements_insufficient", "supplements_failed",
)


def visitor_hash(visitor: Column) -> Column:
    """J1."""
    return F.sha2(visitor.cast("string"), 256)


def _views(usage: DataFrame, days: int, as_of: Column) -> DataFrame:
    start = as_of - F.make_dt_interval(F.lit(days))
    return usage.filter((F.col("event_type") == "page_view") & (F.col("created_at") >= start))


def _counts(approximate: bool) -> list[Column]:
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    return [
        F.count("*").alias("page_views"),
        distinct("visitor_hash").alias("unique_visitors"),
        distinct("user_id").alias("signed_in_users"),
    ]


def usage_totals(usage: DataFrame, days: int, as_of: Column, approximate: bool = False) -> DataFrame:
    """J2. Page views, visitors and signed-in users of the last ``days``."""
    return _views(usage, days, as_of).agg(*_counts(approximate))


def usage_daily(usage: DataFrame, days: int, as_of: Column, approximate: bool = False) -> DataFrame:
    """J3. The same per UTC day."""
    return (
        _views(usage, days, as_of)
        .groupBy(F.to_date("created_at").alias("day"))
        .agg(*_counts(approximate))
        .orderBy("day")
    )


def event_values(events: DataFrame) -> DataFrame:
    """Counters reported by run events, one row per key; text that is not a JSON
    object reports nothing. ``number`` is null for values that are not numbers."""
    message = F.from_json("message", "map<string,string>")
    rows = events.select(
        "run_id", "event_id", "node_name", "status", "message", F.explode(message).alias("key", "value")
    )
    # A quoted number is text, not a count.
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json("message"), F.concat(F.lit("$."), F.col("key")), "variant"))
    number = F.when(kind != "STRING", F.col("value").try_cast("double"))
    return rows.select(
        "run_id", "event_id", "node_name", "status", "key", "value",
        F.when(number >= 0, F.floor(number)).otherwise(F.ceil(number)).cast("bigint").alias("number"),
    )


def run_event_stats(values: DataFrame) -> DataFrame:
    """J4. Latest value per (run, key), over events of any status."""
    return values.groupBy("run_id", "key").agg(
        F.max_by(F.struct("value", "number"), "event_id").alias("v")
    ).select("run_id", "key", "v.*")


def node_time(events: DataFrame) -> DataFrame:
    """J5. Seconds and attempts per (run, step)."""
    return events.groupBy("run_id", "node_name").agg(
        (F.sum("elapsed_ms") / 1000.0).alias("seconds"), F.count("*").alias("attempts")
    )


def node_volume(values: DataFrame, stats: DataFrame, times: DataFrame, runs: DataFrame) -> DataFrame:
    """J6. Work done per (run, step): own counters of complete events, plus the
    four steps that read attempts, the run row or the merged stats."""
    spark = values.sparkSession
    pairs = [(node, key) for node, keys in NODE_COUNTERS.items() for key in keys]
    counters = F.broadcast(spark.createDataFrame(pairs, "node_name string, key string"))
    own = (
        values.filter("status = 'complete'")
        .join(counters, ["node_name", "key"])
        .groupBy("run_id", "node_name")
        .agg(F.sum("number").alias("volume"))
    )
    def merged(node: str, keys: tuple[str, ...]) -> DataFrame:
        return (
            stats.filter(F.col("key").isin(*keys))
            .groupBy("run_id")
            .agg(F.sum("number").alias("volume"))
            .select("run_id", F.lit(node).alias("node_name"), "volume")
        )
    loaded = times.filter("node_name = 'load_settings'").select(
        "run_id", "node_name", F.lit(1).cast("bigint").alias("volume")
    )
    finished = runs.select(
        "run_id", F.lit("finalize").alias("node_name"), F.col("selected_count").cast("bigint").alias("volume")
    )
    known = reduce(
        DataFrame.unionByName,
        [own, loaded, finished, merged("expand_sources", (EXPANSION_COUNTER,)),
         merged("supplement", SUPPLEMENT_COUNTERS)],
    )
    every = runs.select(
        "run_id", F.explode(F.array(*[F.lit(n) for n in NODE_COUNTERS])).alias("node_name")
    )
    return every.join(known, ["run_id", "node_name"], "left").select(
        "run_id", "node_name", F.coalesce("volume", F.lit(0)).alias("volume")
    )


def seconds_per_unit(times: DataFrame, volumes: DataFrame) -> DataFrame:
    """J7. Seconds by volume; null without volume or without time."""
    return volumes.join(times, ["run_id", "node_name"], "left").select(
        "run_id", "node_name", "seconds", F.coalesce("attempts", F.lit(0)).alias("attempts"), "volume",
        F.when(F.col("volume") > 0, F.col("seconds") / F.col("volume")).alias("seconds_per_unit"),
    )


def run_wall_seconds(runs: DataFrame) -> DataFrame:
    """J11. Null while the run is open."""
    return runs.withColumn("wall_seconds", clock.seconds_between(F.col("started_at"), F.col("completed_at")))


def latest_runs(runs: DataFrame, n: int) -> DataFrame:
    """J12. The last ``n`` complete runs, oldest first."""
    return (
        runs.filter("status = 'complete'")
        .orderBy(F.desc("created_at"), F.desc("run_id"))
        .limit(n)
        .orderBy("run_id")
    )


def run_metrics(runs: DataFrame, steps: DataFrame) -> DataFrame:
    """Long form of the run summary: ``(metric, run_id, value)``."""
    run_values = run_wall_seconds(runs).select(
        "run_id",
        F.inline(
            F.array(
                F.struct(F.lit("run.wall_clock_seconds").alias("metric"), F.col("wall_seconds").alias("value")),
                F.struct(
                    F.lit("run.selected_articles").alias("metric"),
                    F.col("selected_count").cast("double").alias("value"),
                ),
            )
        ),
    )
    step_values = steps.select(
        "run_id",
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.concat(F.lit("node."), F.col("node_name"), F.lit(f".{c}")).alias("metric"),
                        F.col(c).cast("double").alias("value"),
                    )
                    for c in ("seconds", "volume", "attempts", "seconds_per_unit")
                ]
            )
        ),
    )
    return run_values.unionByName(step_values)


def run_summary_pivot(metrics: DataFrame, chosen: DataFrame, n: int) -> DataFrame:
    """J8. Metric by run, with the average of the runs that have a value.

    ``chosen`` are the ``n`` runs of ``latest_runs``; their place (1 to n) names
    the column, so the pivot has a fixed width and needs no look at the data.
    """
    places = F.sort_array(F.collect_list("run_id"))
    slots = chosen.agg(places.alias("ids")).select(F.posexplode("ids").alias("_i", "run_id"))
    slotted = metrics.join(F.broadcast(slots), "run_id").withColumn("slot", F.col("_i") + 1)
    wide = slotted.groupBy("metric").pivot("slot", list(range(1, n + 1))).agg(F.first("value"))
    average = slotted.groupBy("metric").agg(F.avg("value").alias("average"))
    return wide.withColumnsRenamed({str(i): f"run_{i}" for i in range(1, n + 1)}).join(average, "metric")


def model_role_rollup(calls: DataFrame) -> DataFrame:
    """J9. Per (run, role)."""
    return calls.groupBy("run_id", "role").agg(
        F.count("*").alias("responses"),
        F.coalesce(F.sum("elapsed_ms") / 1000.0, F.lit(0.0)).alias("total_response_seconds"),
        (F.avg("elapsed_ms") / 1000.0).alias("average_response_seconds"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
    )


def model_call_rollup(calls: DataFrame, grouping: str = "groupBy") -> DataFrame:
    """J10. By role, provider, model and status; ``rollup`` or ``cube`` add totals."""
    return getattr(calls, grouping)("role", "provider", "model", "status").agg(
        F.count("*").alias("request_count"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
        round_to(F.coalesce(F.sum("elapsed_ms"), F.lit(0.0)), 1).alias("elapsed_ms"),
    )


def attempt_number(events: DataFrame) -> DataFrame:
    """J13. The attempt a next event of each (run, step) would get: one more than
    the largest recorded attempt."""
    return events.groupBy("run_id", "node_name").agg((F.max("attempt") + 1).alias("next_attempt"))
