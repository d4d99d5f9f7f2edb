"""Quality metrics over predictions and labels. Pairs are counted, never formed."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import normalized, strip


def ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(empty))


def f1(precision: Column, recall: Column) -> Column:
    return ratio(2 * precision * recall, precision + recall)


def _choose_two(n: Column) -> Column:
    return n * (n - 1) / 2


def pairwise_cluster_metrics(labeled: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """K1. ``labeled(*by, expected, predicted)``. Pair counts come from the sizes of
    the contingency cells: sum of n(n-1)/2, linear in the rows."""
    keys = by or ("_all",)
    cells = (
        labeled.withColumn("_all", F.lit(0))
        .groupBy(*keys, "expected", "predicted")
        .agg(F.count("*").alias("n"))
    )

    def pairs(df: DataFrame, name: str, *parts: str) -> DataFrame:
        sizes = df.groupBy(*keys, *parts).agg(F.sum("n").alias("n"))
        return sizes.groupBy(*keys).agg(F.sum(_choose_two(F.col("n"))).alias(name))

    both = pairs(cells, "tp", "expected", "predicted")
    predicted = pairs(cells, "same_predicted", "predicted")
    expected = pairs(cells, "same_expected", "expected")
    every = pairs(cells, "all_pairs")
    joined = both
    for other in (predicted, expected, every):
        joined = joined.join(other, list(keys))
    tp = F.col("tp")
    fp, fn = F.col("same_predicted") - tp, F.col("same_expected") - tp
    tn = F.col("all_pairs") - tp - fp - fn
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return joined.select(
        *by,
        *[c.cast("bigint").alias(n) for c, n in ((tp, "true_positive"), (fp, "false_positive"),
                                                 (fn, "false_negative"), (tn, "true_negative"))],
        precision.alias("precision"),
        recall.alias("recall"),
        f1(precision, recall).alias("f1"),
        ratio(tp + tn, F.col("all_pairs"), 1.0).alias("accuracy"),
    )


def purity(labeled: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """K2. Share of rows that carry the main label of their cluster."""
    cells = labeled.groupBy(*by, "predicted", "expected").agg(F.count("*").alias("n"))
    clusters = cells.groupBy(*by, "predicted").agg(F.max("n").alias("top"), F.sum("n").alias("size"))
    return clusters.groupBy(*by).agg(
        F.count("*").alias("n_clusters"), ratio(F.sum("top"), F.sum("size"), 1.0).alias("purity")
    )


def majority_label(labeled: DataFrame) -> DataFrame:
    """K2. The main label of every cluster; the smaller label on ties."""
    cells = labeled.groupBy("predicted", "expected").agg(F.count("*").alias("n"))
    return cells.groupBy("predicted").agg(
        F.min_by("expected", F.struct((-F.col("n")).alias("n"), "expected")).alias("label"),
        F.max("n").alias("n_label"),
        F.sum("n").alias("n"),
    )


def classification_metrics(labeled: DataFrame) -> DataFrame:
    """K4. Accuracy and macro F1 over the union of expected and predicted labels."""
    cells = labeled.groupBy("expected", "predicted").agg(F.count("*").alias("n"))
    sides = cells.select(
        "n",
        (F.col("expected") == F.col("predicted")).alias("hit"),
        F.explode(
            F.array(
                F.struct(F.col("expected").alias("label"), F.lit("e").alias("side")),
                F.struct(F.col("predicted").alias("label"), F.lit("p").alias("side")),
            )
        ).alias("s"),
    ).select("n", "hit", "s.*")
    def count(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0))
    per_label = sides.groupBy("label").agg(
        count(F.col("hit") & (F.col("side") == "e")).alias("tp"),
        count(F.col("side") == "p").alias("n_predicted"),
        count(F.col("side") == "e").alias("n_expected"),
    )
    p, r = ratio(F.col("tp"), F.col("n_predicted")), ratio(F.col("tp"), F.col("n_expected"))
    return per_label.agg(
        ratio(F.sum("tp"), F.sum("n_expected"), 0.0).alias("accuracy"),
        F.coalesce(F.avg(f1(p, r)), F.lit(1.0)).alias("macro_f1"),
        F.count("*").alias("n_labels"),
    )


def retrieval_metrics(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """K5. ``ranked(query_id, item_id, rank)`` -> precision and recall at k and
    reciprocal rank per query."""
    wanted = relevant.groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    hit = F.coalesce(F.col("is_relevant"), F.lit(False))
    scored = (
        ranked.join(
            relevant.select("query_id", "item_id", F.lit(True).alias("is_relevant")),
            ["query_id", "item_id"], "left",
        )
        .groupBy("query_id")
        .agg(
            F.count_if(hit & (F.col("rank") <= k)).alias("hits"),
            F.count_if(F.col("rank") <= k).alias("returned"),
            F.min(F.when(hit, F.col("rank"))).alias("first_hit"),
        )
    )
    return scored.join(wanted, "query_id", "left").select(
        "query_id",
        ratio(F.col("hits"), F.col("returned")).alias("precision_at_k"),
        ratio(F.col("hits"), F.coalesce("n_relevant", F.lit(0))).alias("recall_at_k"),
        F.coalesce(1.0 / F.col("first_hit"), F.lit(0.0)).alias("mrr"),
    )


def claim_recall(expected: DataFrame, predicted: DataFrame) -> DataFrame:
    """K6. Expected claims matched one to one, first free match in order.

    ``expected(article_id, expected_id, required_terms)``,
    ``predicted(article_id, claim_id, claim_text, excerpt)``. Texts and terms are normalized in
    Spark; the greedy walk is sequential within one article and gets its claims, never the pairs
    of them: a set of terms is looked up once in each text at most, as it goes on where it last matched.
    """
    text = normalized(F.concat_ws(" ", "claim_text", "excerpt"))
    # Articles are spread before their texts are normalized: a file may hold most of the claims.
    spoken = predicted.filter("article_id IS NOT NULL").withColumnRenamed("article_id", "_of").repartition("_of").select(
        F.col("_of"), "claim_id", text.alias("spoken"))
    asked = expected.repartition("article_id").select(
        "article_id", "expected_id", F.transform("required_terms", normalized).alias("terms"))

    def walk(asked: pa.Table, spoken: pa.Table) -> pa.Table:
        said = zip(spoken["claim_id"].to_pylist(), spoken["spoken"].to_pylist(), strict=True)
        heard = sorted((c, x) for c, x in said if c is not None)
        claims, texts = [c for c, _ in heard], [x for _, x in heard]
        after: dict[tuple, int] = {}
        taken: set[int] = set()

        def first_free(terms: tuple) -> int:
            """Where the first free claim with all terms stands; claims are never freed, so a set only moves on."""
            at = after.get(terms, 0)
            while at < len(texts) and (claims[at] in taken or not all(t in texts[at] for t in terms)):
                at += 1
            after[terms] = at
            return at

        wanted: dict[int, set[tuple]] = {}
        for expected_id, t in zip(asked["expected_id"].to_pylist(), asked["terms"].to_pylist(), strict=True):
            if expected_id is not None and t is not None and None not in t:
                wanted.setdefault(expected_id, set()).add(tuple(sorted(set(t))))
        matched = 0
        for expected_id in sorted(wanted):
            at = min(map(first_free, wanted[expected_id]))
            if at < len(texts):
                taken.add(claims[at])
                matched += 1
        some = min(1, len(asked))
        counts = {"n_expected": len(asked), "n_predicted": len(spoken), "n_matched": matched}
        return pa.table({
            "article_id": asked["article_id"].slice(0, 1).cast(pa.int64()),
            **{name: pa.array([n] * some, pa.int64()) for name, n in counts.items()},
        })

    found = asked.groupBy("article_id").cogroup(spoken.groupBy("_of")).applyInArrow(
        walk, "article_id bigint, n_expected bigint, n_predicted bigint, n_matched bigint"
    )
    return found.withColumn("recall", ratio(F.col("n_matched"), F.col("n_expected"))).withColumn(
        "match_precision", ratio(F.col("n_matched"), F.col("n_predicted"))
    )


def grounding_rate(claims: DataFrame, shown: DataFrame) -> DataFrame:
    """K7. Share of claims whose non-blank excerpt occurs in the text shown."""
    texts = shown.select("article_id", normalized(F.col("shown")).alias("_text"))
    excerpt = F.col("supporting_excerpt")
    held = (strip(excerpt) != "") & F.contains(F.col("_text"), normalized(excerpt))
    checked = claims.select("article_id", excerpt).join(texts, "article_id", "left")
    return checked.agg(
        F.count("*").alias("n_claims"),
        F.count_if(held).alias("n_grounded"),
        ratio(F.count_if(held), F.count("*")).alias("grounding_rate"),
    )


def link_accuracy(expected: DataFrame, predicted: DataFrame) -> DataFrame:
    """K8. Predicted relationship per expected pair, ``missing`` when absent."""
    answer = predicted.select(
        "left_claim_id", "right_claim_id", F.col("relationship").alias("predicted")
    )
    return (
        expected.select("left_claim_id", "right_claim_id", F.col("relationship").alias("expected"))
        .join(answer, ["left_claim_id", "right_claim_id"], "left")
        .withColumn("predicted", F.coalesce("predicted", F.lit("missing")))
        .groupBy("expected")
        .agg(
            F.count("*").alias("n_pairs"),
            F.count_if(F.col("predicted") == "missing").alias("n_missing"),
            F.avg((F.col("expected") == F.col("predicted")).cast("double")).alias("accuracy"),
        )
    )


def gap_f1(expected: DataFrame, predicted: DataFrame) -> DataFrame:
    """K9. Micro precision, recall and F1 over (case, gap) sets."""
    keys = ["case_id", "gap"]
    both = expected.select(*keys).distinct().withColumn("e", F.lit(True)).join(
        predicted.select(*keys).distinct().withColumn("p", F.lit(True)), keys, "full_outer"
    )
    tp, fp, fn = (
        F.count_if(F.col("e") & F.col("p")),
        F.count_if(F.col("e").isNull()),
        F.count_if(F.col("p").isNull()),
    )
    counts = both.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.select("tp", "fp", "fn", p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1"))
