"""Cited supplements: coverage of research areas, verification, word budgets, cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.text import strip, word_count
from newsloom.settings import Settings

# What a supplement may have to cover.
COVERAGE_AREAS = (
    "earlier_events_and_timeline",
    "affected_people_and_effects",
    "missing_information_from_other_reporting",
    "disagreement_or_uncertainty",
)

RUN_STATUSES = ("complete", "skipped", "insufficient", "failed")


def supplement_budget(items: DataFrame, classifications: DataFrame, settings: Settings) -> DataFrame:
    """H1. News items only; the budget is a share of the article's words, rounded down."""
    news = classifications.filter("is_news").select("article_id")
    budget = F.floor(F.coalesce("word_count", F.lit(0)) * settings.supplement_word_ratio)
    return items.join(news, "article_id", "left_semi").withColumn("word_budget", budget.cast("int"))


def _valid_citations(rows: DataFrame, keys: list[str], ids: str, evidence: DataFrame) -> DataFrame:
    """``rows`` plus ``cited``: the ids of its own list that the run's evidence has,
    in order, repeats included. Ids meet the evidence on (run, id), so a run with
    much evidence spreads; only one row's own list is put together again."""
    known = evidence.select("run_id", F.col("evidence_id").alias("_id")).distinct()
    found = (
        rows.select(*keys, F.posexplode(ids).alias("_at", "_id"))
        .join(known, ["run_id", "_id"], "left_semi")
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list(F.struct("_at", "_id"))).alias("_found"))
        .select(*keys, F.transform("_found", lambda f: f["_id"]).alias("cited"))
    )
    empty = F.array().cast("array<bigint>")
    return rows.join(found, keys, "left").withColumn("cited", F.coalesce("cited", empty))


def coverage_ledger(decisions: DataFrame, evidence: DataFrame, settings: Settings) -> DataFrame:
    """H2. ``decisions(run_id, iteration, area, needed, evidence_ids)`` folded in
    iteration order per (run, area). Targets are the areas needed at iteration 1.

    Each iteration cites ids; the free slots are filled from the cited list
    before repeats are removed, so a repeated id wastes a slot. Satisfied stays
    satisfied.
    """
    limit = settings.max_evidence_per_area
    empty = F.array().cast("array<bigint>")
    cited = _valid_citations(decisions, ["run_id", "area", "iteration"], "evidence_ids", evidence)
    start = F.struct(empty.alias("ids"), F.lit(False).alias("satisfied"))

    def step(acc: Column, d: Column) -> Column:
        taken = F.slice(d["cited"], F.lit(1), F.greatest(F.lit(0), limit - F.size(acc["ids"])))
        return F.struct(
            F.array_distinct(F.concat(acc["ids"], taken)).alias("ids"),
            (acc["satisfied"] | ~d["needed"]).alias("satisfied"),
        )

    rows = cited.groupBy("run_id", "area").agg(
        F.sort_array(F.collect_list(F.struct("iteration", "needed", "cited"))).alias("rows"),
        F.max(F.when(F.col("iteration") == 1, F.col("needed"))).alias("target"),
    )
    target = F.coalesce("target", F.lit(False))
    return rows.withColumn("end", F.aggregate("rows", start, step)).select(
        "run_id",
        "area",
        target.alias("is_target"),
        F.when(target, F.sort_array("end.ids")).otherwise(empty).alias("evidence_ids"),
        (target & F.col("end.satisfied")).alias("satisfied"),
    )


def ledger_status(ledger: DataFrame, settings: Settings) -> DataFrame:
    """H3. Status and free slots per area."""
    n = F.size("evidence_ids")
    return ledger.select(
        "run_id",
        "area",
        F.when(~F.col("is_target"), "not_needed")
        .when(F.col("satisfied"), "satisfied")
        .when(n >= settings.max_evidence_per_area, "max_target_reached")
        .otherwise("search_needed")
        .alias("status"),
        F.greatest(F.lit(0), settings.max_evidence_per_area - n).alias("remaining_slots"),
    )


def research_complete(status: DataFrame) -> DataFrame:
    """H3. A run is done when no area still needs a search."""
    return status.groupBy("run_id").agg(
        F.bool_and(F.col("status") != "search_needed").alias("research_complete")
    )


def verification_contract(statements: DataFrame, verification: DataFrame, evidence: DataFrame) -> DataFrame:
    """H4. Every violation: missing and unexpected coordinates, citations that are
    unavailable or not in the draft. No rows means the contract holds.

    ``statements(run_id, card_index, statement_index, evidence_ids)``,
    ``verification(same, evidence_ids)``.
    """
    at = ["run_id", "card_index", "statement_index"]
    drafted = statements.select(*at, F.col("evidence_ids").alias("draft_ids"), F.lit(True).alias("in_draft"))
    checked = verification.select(*at, F.col("evidence_ids").alias("ids"), F.lit(True).alias("in_check"))
    both = drafted.join(checked, at, "full_outer")
    coordinates = both.filter("in_draft IS NULL OR in_check IS NULL").select(
        *at,
        F.when(F.col("in_check").isNull(), "missing").otherwise("unexpected").alias("problem"),
        F.lit(None).cast("bigint").alias("evidence_id"),
    )
    cited = both.filter("in_draft AND in_check").select(
        *at, "draft_ids", F.explode(F.array_distinct("ids")).alias("evidence_id")
    )
    known = evidence.select("run_id", "evidence_id", F.lit(True).alias("known")).distinct()
    citations = (
        cited.join(known, ["run_id", "evidence_id"], "left")
        .filter(F.col("known").isNull() | ~F.array_contains("draft_ids", F.col("evidence_id")))
        .select(*at, F.lit("invalid_citation").alias("problem"), "evidence_id")
    )
    return coordinates.unionByName(citations)


def supported_statements(
    statements: DataFrame, verification: DataFrame, evidence: DataFrame, budgets: DataFrame
) -> DataFrame:
    """H5. Whole supported statements with a valid citation, in card order, while
    they fit the word budget; one that does not fit is skipped.

    ``statements(run_id, card_index, statement_index, card_type, text,
    evidence_ids)``. Before the fold each statement length keeps only as many rows
    as could fit the budget together; a length that was refused once is refused
    ever after, so nothing is lost and the budget bounds the fold.
    """
    at = ["run_id", "card_index", "statement_index"]
    supported = _valid_citations(
        verification.filter("supported").select(*at, F.col("evidence_ids").alias("ids")), at, "ids", evidence
    ).select(*at, F.col("cited").alias("ids"))
    in_draft = F.filter(F.col("ids"), lambda x: F.array_contains("evidence_ids", x))
    same_length = Window.partitionBy("run_id", "n_words").orderBy("card_index", "statement_index")
    candidates = (
        statements.join(supported, at)
        .withColumn("cited", F.array_distinct(in_draft))
        .filter(F.size("cited") > 0)
        .withColumn("n_words", word_count(F.col("text")))
        .join(budgets.select("run_id", "word_budget"), "run_id")
        .withColumn("_n", F.row_number().over(same_length))
        .filter(F.col("_n") * F.col("n_words") <= F.col("word_budget"))
        .select(
            "run_id",
            "word_budget",
            F.struct(
                "card_index", "statement_index", "card_type", strip(F.col("text")).alias("text"), "n_words", "cited"
            ).alias("row"),
        )
    )
    walks = candidates.groupBy("run_id", "word_budget").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    start = F.struct(F.lit(0).alias("used"), F.slice("rows", 1, 0).alias("kept"))

    def step(acc: Column, row: Column) -> Column:
        fits = acc["used"] + row["n_words"] <= F.col("word_budget")
        return F.struct(
            F.when(fits, acc["used"] + row["n_words"]).otherwise(acc["used"]).alias("used"),
            F.when(fits, F.concat(acc["kept"], F.array(row))).otherwise(acc["kept"]).alias("kept"),
        )

    return walks.select("run_id", F.inline(F.aggregate("rows", start, step)["kept"]))


def assemble_cards(kept: DataFrame, cards: DataFrame) -> DataFrame:
    """H6. One card per draft card that kept a statement, renumbered from 1."""
    parts = F.sort_array(F.collect_list(F.struct("statement_index", "text")))
    built = kept.groupBy("run_id", "card_index").agg(
        F.array_join(F.transform(parts, lambda r: r["text"]), "\n\n").alias("summary_text"),
        F.count("*").alias("n_statements"),
    )
    places = built.groupBy("run_id").agg(F.sort_array(F.collect_set("card_index")).alias("order"))
    return (
        built.join(places, "run_id")
        .join(cards.select("run_id", "card_index", "card_type", "heading"), ["run_id", "card_index"])
        .select(
            "run_id", "card_index", "card_type", "heading", "summary_text",
            word_count(F.col("summary_text")).cast("int").alias("word_count"),
            F.array_position("order", F.col("card_index")).cast("int").alias("display_order"),
            "n_statements",
        )
    )


def card_citations(kept: DataFrame) -> DataFrame:
    """H6. Numbered citations; the evidence they name is the selected evidence."""
    return kept.select(
        "run_id", "card_index", "statement_index", F.posexplode("cited").alias("_i", "evidence_id")
    ).select(
        "run_id", "card_index", "statement_index", "evidence_id",
        (F.col("_i") + 1).alias("citation_order"),
    )


def supplement_stats(runs: DataFrame, evidence: DataFrame, cards: DataFrame) -> DataFrame:
    """H7. Runs per status, and the evidence items and cards of those runs."""
    n_evidence = evidence.groupBy("run_id").agg(F.count("*").alias("n_evidence"))
    n_cards = cards.groupBy("run_id").agg(F.count("*").alias("n_cards"))
    return (
        runs.join(n_evidence, "run_id", "left")
        .join(n_cards, "run_id", "left")
        .agg(
            *[F.count_if(F.col("status") == s).alias(s) for s in RUN_STATUSES],
            F.coalesce(F.sum("n_evidence"), F.lit(0)).alias("evidence_items"),
            F.coalesce(F.sum("n_cards"), F.lit(0)).alias("cards"),
        )
    )
