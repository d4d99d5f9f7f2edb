"""Story clusters: assign to live centroids, cluster the leftovers, keep diverse members."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from newsloom.functions.text import let
from newsloom.functions.vectors import cosine
from newsloom.operators.neighbours import (
    BLOCK_BYTES,
    LEAST,
    NOWHERE,
    PART_BYTES,
    SLACK,
    TILE,
    Dealt,
    Pivots,
    angles,
    choose_pivots,
    in_cells,
    nearest,
    packed,
    unit_rows,
    unpacked,
    visitors,
)
from newsloom.session import cut_lineage
from newsloom.settings import Settings

# Fixed value: blocks of a graph that are cut for the sake of many tasks; a larger table has as many as its bytes need.
BLOCKS = 8


def inference_worklist(
    inputs: DataFrame, cached: DataFrame, model: str, cap: int | None = None
) -> DataFrame:
    """E1. Inputs ``(run_id, article_id, input_hash)`` a model has not answered yet.
    With ``cap``, a run gets its first ``cap`` unanswered articles; the next run gets the rest."""
    done = cached.filter(F.col("model") == model).select("article_id", "input_hash")
    todo = inputs.join(done, ["article_id", "input_hash"], "left_anti")
    if cap is not None:
        by_run = Window.partitionBy("run_id").orderBy("article_id")
        todo = todo.withColumn("_n", F.row_number().over(by_run)).filter(F.col("_n") <= cap).drop("_n")
    return todo


def batch_model_map(
    df: DataFrame,
    fn: Callable[[pd.DataFrame], pd.DataFrame],
    schema: str | StructType,
    batch_size: int = 10,
) -> DataFrame:
    """E2. Apply a user's batch function (embed, classify, extract) to every row,
    ``batch_size`` rows per call. Map-only; a lost task repeats its batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), batch_size):
                yield fn(batch.iloc[at : at + batch_size])

    return df.mapInPandas(run, schema)


def clusterable(articles: DataFrame) -> Column:
    """Only news with a vector is clustered; a table without ``is_news`` holds news alone."""
    has_vector = F.col("vector").isNotNull()
    return has_vector & F.coalesce("is_news", F.lit(False)) if "is_news" in articles.columns else has_vector


def assign_to_centroids(
    articles: DataFrame,
    centroids: DataFrame,
    members: DataFrame,
    settings: Settings,
    as_of: Column,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """E5. Nearest recent centroid of the same model, if similar enough.

    Articles that already belong to a cluster keep it. ``cluster_id`` is null
    for leftovers, which go to ``graph_cluster``, and for articles that are not
    news (an ``is_news`` column that is not true) or have no vector.
    """
    kept = articles.join(members.select("article_id", "cluster_id"), "article_id").select(
        "article_id", "cluster_id", F.lit(None).cast("double").alias("similarity")
    )
    fresh = articles.join(members.select("article_id"), "article_id", "left_anti")
    active = centroids.filter(
        F.col("event_date") >= F.date_sub(F.to_date(as_of), settings.cluster_lookback_days)
    )
    best = nearest(
        fresh.filter(clusterable(fresh)).select(F.col("article_id").alias("query_id"), "model", "vector"),
        active.select(F.col("cluster_id").alias("target_id"), "model", F.col("centroid").alias("vector")),
        1,
        block_bytes,
        settings.similarity_threshold,
    )
    hit = best.filter(F.col("similarity") >= settings.similarity_threshold).select(
        F.col("query_id").alias("article_id"), F.col("target_id").alias("cluster_id"), "similarity"
    )
    placed = fresh.select("article_id").join(hit, "article_id", "left")
    return kept.unionByName(placed.select("article_id", "cluster_id", "similarity"))


def leader_cluster(articles: DataFrame, settings: Settings) -> DataFrame:
    """E6. The sequential rule: in id order, join the nearest centroid (a running
    mean) if similar enough, else open a cluster. A ``threshold`` column, if there
    is one, takes the place of the setting.

    It is sequential by definition, so it runs per ``(run_id, model)``; a run
    holds at most ``run_article_cap`` articles, and a larger group is an error,
    not a slow task. Use ``assign_to_centroids`` and ``graph_cluster`` for volume.
    """
    limit = settings.run_article_cap
    if "threshold" not in articles.columns:
        articles = articles.withColumn("threshold", F.lit(settings.similarity_threshold))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        cut = group["threshold"].iloc[0]
        if len(group) > limit:
            raise ValueError(f"a run holds at most {limit} articles, got {len(group)}")
        group = group.sort_values("article_id")
        sums: list[np.ndarray] = []
        sizes: list[int] = []
        label, score = [], []
        for row in np.array(group["vector"].tolist(), dtype=np.float64):
            best, value = -1, 1.0
            if sums:
                means = np.array([s / n for s, n in zip(sums, sizes, strict=True)])
                lengths = np.linalg.norm(means, axis=1) * np.linalg.norm(row)
                sims = np.divide(means @ row, lengths, out=np.zeros(len(sums)), where=lengths > 0)
                best, value = int(sims.argmax()), float(sims.max())
            if best < 0 or value < cut:
                sums.append(row.copy())
                sizes.append(1)
                best, value = len(sums) - 1, 1.0
            else:
                sums[best] += row
                sizes[best] += 1
            label.append(best)
            score.append(value)
        first = group["article_id"].to_numpy()[[label.index(x) for x in label]]
        return pd.DataFrame(
            {
                "threshold": cut,
                "run_id": group["run_id"].to_numpy(),
                "article_id": group["article_id"].to_numpy(),
                "cluster_id": first,
                "similarity": score,
            }
        )

    return (
        articles.select("threshold", "run_id", "article_id", "model", "vector")
        .groupBy("threshold", "run_id", "model")
        .applyInPandas(
            run,
            "threshold double, run_id bigint, article_id bigint, cluster_id bigint, similarity double",
        )
    )


def threshold_sweep(articles: DataFrame, thresholds: tuple[float, ...], settings: Settings) -> DataFrame:
    """K3. The sequential rule at several thresholds in one job: the threshold is
    one more grouping key."""
    every = F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))
    return leader_cluster(articles.withColumn("threshold", every), settings)


def _link(label: np.ndarray, rows: np.ndarray, cols: np.ndarray, linked: np.ndarray) -> None:
    """Join the labels of ``rows`` and ``cols`` along ``linked``.

    Every pass links each row to one row of another component, so components halve per pass.
    """
    while True:
        cross = linked & (label[rows][:, None] != label[cols][None, :])
        has = cross.any(axis=1)
        if not has.any():
            return
        for i, j in zip(rows[has], cols[cross[has].argmax(axis=1)], strict=True):
            x, y = label[i], label[j]
            while label[x] != x:
                x = label[x]
            while label[y] != y:
                y = label[y]
            label[max(x, y)] = min(x, y)
        while not np.array_equal(label, further := label[label]):
            label[:] = further


def _forest(home: pd.DataFrame, guests: pd.DataFrame, same: bool, cut: float, tile: int) -> list[tuple]:
    """Spanning stars of the graph ``cosine >= cut`` between the cells at home and the guests that visit them.

    Cells are multiplied one by one, in tiles; tiles that are one component already are not multiplied. With
    ``same``, the guests are the rows at home.
    """
    offset = 0 if same else len(home)
    ids = home["id"].to_numpy() if same else np.concatenate([home["id"].to_numpy(), guests["id"].to_numpy()])
    left = unit_rows(home["vector"])
    right, visited = left if same else unit_rows(guests["vector"]), unpacked(guests["open"])
    cells, starts = np.unique(home["cell"].to_numpy(), return_index=True)
    ends = np.append(starts[1:], len(home))
    label = np.arange(len(ids))
    for at in range(0, len(guests), TILE):
        for cell, start, end in zip(cells, starts, ends, strict=True):
            here = at + np.flatnonzero(visited[at : at + TILE, cell])
            if not len(here):
                continue
            visiting = right[here]
            for a in range(start, end, tile):
                rows, cols = np.arange(a, min(a + tile, end)), here + offset
                if label[rows].min() == label[rows].max() == label[cols].min() == label[cols].max():
                    continue
                linked = left[rows[0] : rows[-1] + 1] @ visiting.T >= cut
                some, others = linked.any(axis=1), linked.any(axis=0)
                if some.any():
                    _link(label, rows[some], cols[others], linked[some][:, others])
    heads = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(heads, label, ids)
    return [(int(h), int(i)) for h, i in zip(heads[label], ids, strict=True) if h != i]


def visiting(
    vectors: DataFrame, threshold: float, block_bytes: int = BLOCK_BYTES, part_bytes: int = PART_BYTES
) -> tuple[DataFrame, pd.DataFrame, Pivots]:
    """``vectors(id, model, vector)`` with home cell and block and what they visit, and the rows of each cell.

    Let t be the angle of ``threshold``. If y is within t of an x at home with pivot p, then p is at most
    2t farther from y than y's own pivot, and at most t farther than the radius of p's cell. Of two cells,
    rows of the higher one visit the lower one, so every linked pair meets in exactly one cell; rows of one
    cell visit it in their own block and the ones before. ``open`` has a bit a cell, ``blocks`` are those that
    hold an open cell, each of at most about ``part_bytes``.
    """
    pivots = choose_pivots(vectors, block_bytes)
    placed = in_cells(vectors, pivots).filter(F.col("cell") != NOWHERE)
    homes = placed.groupBy("model", "cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).toPandas()
    columns = {m: len(p) for m, p in pivots.of.items()}
    radius = {m: np.full(n, -np.inf) for m, n in columns.items()}
    for r in homes.itertuples():
        radius[r.model][r.cell] = r.radius
    most = min(pivots.rows(part_bytes), max(LEAST, math.ceil(homes["n"].sum() / BLOCKS)))
    dealt = Dealt(homes, columns, most)
    reach = math.acos(max(-1.0, min(1.0, threshold)))
    shared = vectors.sparkSession.sparkContext.broadcast((pivots.of, radius, dealt))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pivots_of, radius_of, dealt = shared.value
        for batch in batches:
            for model, group in batch.groupby("model", sort=False):
                to = angles(unit_rows(group["vector"]), pivots_of[model])
                limit = np.minimum(group["angle"].to_numpy()[:, None] + 2 * reach, radius_of[model][None] + reach)
                homes_of = group["cell"].to_numpy()
                flags = (to <= limit + SLACK) & (np.arange(to.shape[1]) < homes_of[:, None])
                flags &= dealt.parts[model] > 0
                flags[np.arange(len(group)), homes_of] = True
                block = dealt.block(model, homes_of, group["id"].to_numpy())
                names, met = dealt.visited(model, flags)
                met &= names <= block[:, None]
                yield group.drop(columns="angle").assign(
                    block=block, open=packed(flags), blocks=[names[row].tolist() for row in met]
                )

    out = cut_lineage(
        placed.mapInPandas(
            run, "id bigint, model string, vector array<double>, cell int, block int, open binary, blocks array<int>"
        )
    )
    return out, homes, pivots


def bordered(vectors: DataFrame, threshold: float, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, pd.DataFrame, Pivots]:
    """What ``visiting`` found, with the rows at home and the guests of each cell."""
    out, homes, pivots = visiting(vectors, threshold, block_bytes)
    cells = homes[["model", "cell", "n"]].merge(visitors(out), on=["model", "cell"])
    cells = cells.assign(n_home=cells["n"], n_guests=cells["n_visitors"] - cells["n"])
    return out, cells[["model", "cell", "n_home", "n_guests"]], pivots


def pairs_compared(cells: pd.DataFrame) -> int:
    """Pairs that ``similar_edges`` has to compare, to be held against n (n - 1) / 2."""
    return int((cells["n_home"] * (cells["n_home"] - 1) // 2 + cells["n_home"] * cells["n_guests"]).sum())


def similar_edges(
    vectors: DataFrame, threshold: float, block_bytes: int = BLOCK_BYTES, part_bytes: int = PART_BYTES
) -> DataFrame:
    """Edges ``(a, b)`` whose components are those of ``cosine >= threshold`` within a model.

    Rows ``(id, model, vector)`` meet in the cells of ``visiting`` only. Cells share blocks, and a task is a
    block with the guests of one other block (or with itself), each side of at most about ``part_bytes``: a
    row travels once a block, however many cells it visits there. A task compares cell by cell with matrix
    products, at most ``block_bytes`` of a cell at once, but returns only a spanning forest: fewer edges than
    rows, however many pairs are similar. Zero vectors have no edges; ``threshold`` is above 0.
    """
    if threshold <= 0:
        raise ValueError("a threshold of 0 or less would link zero vectors to everything")
    placed, _, pivots = visiting(vectors, threshold, block_bytes, part_bytes)
    # One row a pair of blocks that meet, as few as there are tasks.
    met = placed.select(F.explode("blocks").alias("i"), F.col("block").alias("j")).distinct().collect()
    others = F.broadcast(vectors.sparkSession.createDataFrame(
        [(r["i"], r["j"]) for r in met if r["i"] != r["j"]], "block int, j int"))
    sent = ["id", "vector", "cell", "open", "i", "j"]
    home = placed.join(others, "block").withColumn("i", F.col("block"))
    guests = placed.withColumn("i", F.explode("blocks")).withColumn("j", F.col("block"))
    spread = home.select(*sent, F.lit(False).alias("guest")).unionByName(guests.select(*sent, F.lit(True).alias("guest")))
    tile = min(TILE, pivots.rows(block_bytes))

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        same = key[0] == key[1]
        group = group.sort_values("cell", kind="stable")
        guests = group[group["guest"]]
        edges = _forest(guests if same else group[~group["guest"]], guests, same, threshold, tile)
        return pd.DataFrame(edges, columns=["a", "b"]).astype("int64")

    return spread.groupBy("i", "j").applyInPandas(run, "a bigint, b bigint")


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, component)`` with the smallest id as the label.

    Each round takes the smallest label among neighbours, then the label's own
    label (pointer jumping), and is written to the checkpoint folder. A round
    that lowers no label is the last, so the loop always ends.
    """
    edges = cut_lineage(edges)
    both = edges.select(F.col("a").alias("id"), F.col("b").alias("near")).unionByName(
        edges.select(F.col("b").alias("id"), F.col("a").alias("near"))
    )
    labels = cut_lineage(nodes.select("id", F.col("id").alias("component")))
    while True:
        offered = (
            both.join(labels.select(F.col("id").alias("near"), "component"), "near")
            .groupBy("id")
            .agg(F.min("component").alias("offer"))
        )
        lower = labels.join(offered, "id", "left").select(
            "id", F.col("component").alias("old"), F.least("component", "offer").alias("via")
        )
        jump = labels.select(F.col("id").alias("via"), F.col("component").alias("further"))
        step = cut_lineage(
            lower.join(jump, "via", "left").select("id", "old", F.least("via", "further").alias("component"))
        )
        labels = step.select("id", "component")
        if step.filter("old <> component").isEmpty():
            return labels


def graph_cluster(
    articles: DataFrame, threshold: float, recheck: bool = False, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """E7. Clusters of ``articles(article_id, vector)``: linked at ``threshold``.

    With a ``model`` column, only vectors of one model meet. Articles that are not
    ``clusterable`` come back with a null ``cluster_id``. Identical vectors are
    folded into one node first (a partial aggregate), so a text copied a million
    times is compared once. With ``recheck`` members that are too far from the
    mean of their cluster become clusters of their own, which undoes chains.
    """
    if "model" not in articles.columns:
        articles = articles.withColumn("model", F.lit(""))
    rest = articles.filter(~clusterable(articles)).select("article_id", F.lit(None).cast("bigint").alias("cluster_id"))
    articles = articles.filter(clusterable(articles)).withColumn("model", F.coalesce("model", F.lit("")))
    nodes = cut_lineage(articles.groupBy("model", "vector").agg(F.min("article_id").alias("id")))
    components = connected_components(nodes.select("id"), similar_edges(nodes, threshold, block_bytes))
    nonzero = F.exists("vector", lambda x: x != 0)
    placed = (
        articles.join(nodes, ["model", "vector"])
        .join(components, "id")
        .select(
            "article_id",
            "vector",
            F.when(nonzero, F.col("component")).otherwise(F.col("article_id")).alias("cluster_id"),
        )
    )
    if not recheck:
        return placed.select("article_id", "cluster_id").unionByName(rest)
    means = centroids_of(placed.select("cluster_id", "vector"))
    near = cosine(F.col("vector"), F.col("centroid")) >= threshold
    return placed.join(means, "cluster_id").select(
        "article_id", F.when(near, F.col("cluster_id")).otherwise(F.col("article_id")).alias("cluster_id")
    ).unionByName(rest)


def centroids_of(members: DataFrame) -> DataFrame:
    """Mean vector per cluster, by partial sums per (cluster, dimension)."""
    sums = (
        members.select("cluster_id", F.posexplode("vector").alias("dim", "x"))
        .groupBy("cluster_id", "dim")
        .agg(F.sum(F.col("x").cast("double")).alias("s"), F.count("*").alias("n"))
    )
    rows = F.sort_array(F.collect_list(F.struct("dim", (F.col("s") / F.col("n")).alias("x"))))
    return sums.groupBy("cluster_id").agg(
        F.transform(rows, lambda r: r["x"]).alias("centroid"), F.max("n").alias("n_members")
    )


def centroid_update(clusters: DataFrame, added: DataFrame) -> DataFrame:
    """E8. ``clusters(cluster_id, centroid, n_members)`` after ``added(cluster_id,
    vector)`` joined: the mean weighted by member counts, equal to updating one
    member at a time."""
    new = centroids_of(added).withColumnsRenamed({"centroid": "mean_added", "n_members": "n_added"})
    n, m = F.col("n_members"), F.coalesce("n_added", F.lit(0))
    mixed = F.zip_with("centroid", "mean_added", lambda o, a: (o * n + a * m) / (n + m))
    return clusters.join(new, "cluster_id", "left").select(
        "cluster_id",
        F.when(F.col("mean_added").isNull(), F.col("centroid")).otherwise(mixed).alias("centroid"),
        (n + m).alias("n_members"),
    )


def prune_members(members: DataFrame, clusters: DataFrame, settings: Settings) -> DataFrame:
    """E9. ``coverage`` or ``redundant`` for every member.

    ``members(cluster_id, article_id, publisher_id, vector)``,
    ``clusters(cluster_id, centroid)``. Small clusters are kept whole. Larger
    ones keep the best member per publisher, then add novel members one per
    round. A round joins the few vectors picked so far to the members and takes
    one ``max_by`` per cluster: nothing is collected per cluster, and a story
    that holds a third of all rows only means more map-side combining. Each
    round uses the one before it once, so the plan grows linearly.
    """
    cap = settings.cluster_max_articles
    rel = cosine(F.col("vector"), F.col("centroid"))
    pool = (
        members.filter("vector IS NOT NULL")
        .join(clusters.select("cluster_id", "centroid"), "cluster_id")
        .select("cluster_id", "article_id", "publisher_id", "vector", rel.alias("rel"))
    )
    pick = F.struct("article_id", "vector")
    best = (
        pool.groupBy("cluster_id", "publisher_id")
        .agg(
            F.max_by(F.struct("rel", "article_id", "vector"),
                     F.struct("rel", (-F.col("article_id")).alias("o"))).alias("b")
        )
        .select("cluster_id", "b.*")
    )
    first = Window.partitionBy("cluster_id").orderBy(F.desc("rel"), "article_id")
    starts = (
        best.withColumn("_n", F.row_number().over(first))
        .filter(F.col("_n") <= cap)
        .groupBy("cluster_id")
        .agg(F.collect_list(pick).alias("picked"))
    )
    sizes = pool.groupBy("cluster_id").agg(F.count("*").alias("n"))
    picks = starts.join(sizes, "cluster_id")
    closest = let(
        F.col("vector"),
        lambda v: F.array_max(F.transform("picked", lambda p: cosine(v, p["vector"]))),
    )
    value = 0.65 * F.col("rel") + 0.35 * (1.0 - F.col("closest"))
    free = ~F.exists("picked", lambda p: p["article_id"] == F.col("article_id"))
    wanted = (F.col("n") > cap) & (F.size("picked") < cap)
    for _ in range(cap - 1):
        # Clusters without a candidate keep their picks: every member joins, and
        # only candidates have an order for max_by to compare.
        state = pool.join(picks, "cluster_id").withColumn("closest", F.when(wanted & free, closest))
        order = F.when(
            F.col("closest") < settings.redundancy_threshold,
            F.struct(value.alias("v"), "rel", (-F.col("article_id")).alias("o")),
        )
        picks = (
            state.groupBy("cluster_id")
            .agg(
                F.any_value("n").alias("n"),
                F.any_value("picked").alias("picked"),
                F.max_by(pick, order).alias("c"),
            )
            .select(
                "cluster_id",
                "n",
                F.when(F.col("c").isNull(), F.col("picked"))
                .otherwise(F.concat("picked", F.array("c"))).alias("picked"),
            )
        )
    kept = picks.filter(F.col("n") > cap).select(
        "cluster_id", F.explode(F.col("picked.article_id")).alias("article_id"), F.lit(True).alias("chosen")
    )
    small = sizes.filter(F.col("n") <= cap).select("cluster_id", F.lit(True).alias("whole"))
    keep = F.col("chosen") | (F.col("whole") & F.col("embedded"))
    return (
        members.select(
            "cluster_id", "article_id", "publisher_id", F.col("vector").isNotNull().alias("embedded")
        )
        .join(small, "cluster_id", "left")
        .join(kept, ["cluster_id", "article_id"], "left")
        .select(
            "cluster_id",
            "article_id",
            "publisher_id",
            F.when(keep, "coverage").otherwise("redundant").alias("relationship"),
        )
    )


def cluster_status(members: DataFrame) -> DataFrame:
    """E10. Two active publishers make an evidence cluster."""
    active = F.col("relationship") == "coverage"
    return members.groupBy("cluster_id").agg(
        F.count_if(active).alias("n_active"),
        F.count_distinct(F.when(active, F.col("publisher_id"))).alias("n_publishers"),
    ).withColumn(
        "status",
        F.when(F.col("n_publishers") >= 2, "evidence")
        .when(F.col("n_active") > 1, "single_source")
        .otherwise("singleton"),
    )


def apply_representatives(eligible: DataFrame, members: DataFrame, clusters: DataFrame) -> DataFrame:
    """E11. ((eligible - redundant) - members of compared clusters) + representatives.

    ``clusters(cluster_id, comparison_status, representative_article_id)``. A
    representative returns even when it was not eligible.
    """
    redundant = members.filter("relationship = 'redundant'").select("article_id")
    complete = clusters.filter("comparison_status = 'complete'")
    in_complete = members.join(complete.select("cluster_id"), "cluster_id", "left_semi").select("article_id")
    with_members = complete.join(members.select("cluster_id"), "cluster_id", "left_semi")
    representatives = with_members.filter("representative_article_id IS NOT NULL").select(
        F.col("representative_article_id").alias("article_id")
    )
    return (
        eligible.select("article_id")
        .join(redundant, "article_id", "left_anti")
        .join(in_complete, "article_id", "left_anti")
        .unionByName(representatives)
        .distinct()
    )
