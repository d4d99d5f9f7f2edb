"""Exact nearest vectors by metric cells: pivots, angles, and matrix products within a cell.

A vector lives in the cell of its nearest pivot. Angles between vectors obey the triangle
inequality, so the angle of a vector to a pivot, less the radius of that pivot's cell, is a
lower bound of its angle to every vector of the cell; cells whose bound is too large are
never visited. The plan is the same at every size: only pivots, one row of figures a cell and one
a block reach the driver; pivots and cells are bounded by ``block_bytes``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.session import cut_lineage

# How many bytes of vectors one side of a product (or all pivots) may hold, and one side of a task.
BLOCK_BYTES = 32 << 20
PART_BYTES = 32 << 20
TILE = 2048
PIVOTS = 1024
# Smaller parts than this many rows are not worth a task; up to so many tasks share a block's work.
LEAST = 4096
TASKS = 24

# Arc cosines of nearly equal vectors are wrong by up to the root of the rounding error.
SLACK = 1e-6
# The cell of zero vectors: their similarity to everything is 0, so they have no angles.
NOWHERE = -1

RESULT = "query_id bigint, target_id bigint, similarity double"
PLACED = "id bigint, model string, vector array<double>, cell int, angle double"


def unit_rows(vectors: pd.Series) -> np.ndarray:
    """Rows scaled to length 1; a zero vector stays zero and its similarities are 0."""
    m = np.array(vectors.tolist(), dtype=np.float64)
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def angles(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit @ pivots.T, -1.0, 1.0))


def top_k(queries: pd.DataFrame, targets: pd.DataFrame, k: int, tile: int = TILE) -> pd.DataFrame:
    """The k best targets per query among the cells it visits.

    ``queries(query_id, vector, open)``, ``targets(target_id, vector, cell)``. Cells are multiplied one by
    one, at most ``tile`` targets at once; similarities equal to 12 digits go to the lower id.
    """
    targets = targets.sort_values(["cell", "target_id"])
    ids, matrix = targets["target_id"].to_numpy(), unit_rows(targets["vector"])
    cells, starts = np.unique(targets["cell"].to_numpy(), return_index=True)
    ends = np.append(starts[1:], len(ids))
    parts = []
    for at in range(0, len(queries), TILE):
        rows = queries.iloc[at : at + TILE]
        unit, visited = unit_rows(rows["vector"]), unpacked(rows["open"])
        best, owner = np.full((len(rows), k), -np.inf), np.full((len(rows), k), -1, dtype=np.int64)
        for cell, start, end in zip(cells, starts, ends, strict=True):
            here = np.flatnonzero(visited[:, cell])
            if not len(here):
                continue
            asking = unit if len(here) == len(unit) else unit[here]
            for a in range(start, end, tile):
                sims = asking @ matrix[a : min(a + tile, end)].T
                better = np.round(sims.max(axis=1), 12) >= np.round(best[here, k - 1], 12)
                if better.any():
                    _merge(best, owner, here[better], sims[better], ids[a : min(a + tile, end)])
        filled = np.isfinite(best.ravel())
        parts.append(
            pd.DataFrame(
                {
                    "query_id": np.repeat(rows["query_id"].to_numpy(), k)[filled],
                    "target_id": owner.ravel()[filled],
                    "similarity": best.ravel()[filled],
                }
            )
        )
    return pd.concat(parts, ignore_index=True)


def _merge(best: np.ndarray, owner: np.ndarray, rows: np.ndarray, sims: np.ndarray, ids: np.ndarray) -> None:
    """Put the best of ``sims`` (columns by rising id) into the k best of ``rows``."""
    k, order = best.shape[1], -np.round(sims, 12)
    if k <= 8:
        picks = []
        for _ in range(min(k, len(ids))):
            picks.append(order.argmin(axis=1))
            order[np.arange(len(rows)), picks[-1]] = np.inf
        chosen = np.stack(picks, axis=1)
    else:
        chosen = np.argsort(order, axis=1, kind="stable")[:, :k]
    values = np.concatenate([best[rows], np.take_along_axis(sims, chosen, axis=1)], axis=1)
    names = np.concatenate([owner[rows], ids[chosen]], axis=1)
    first = np.lexsort((names, -np.round(values, 12)), axis=-1)[:, :k]
    best[rows], owner[rows] = np.take_along_axis(values, first, axis=1), np.take_along_axis(names, first, axis=1)


def packed(flags: np.ndarray) -> list[bytes]:
    """A row of flags as bits, one binary a row."""
    return [row.tobytes() for row in np.packbits(flags, axis=1, bitorder="little")]


def unpacked(bits: pd.Series) -> np.ndarray:
    rows = np.frombuffer(b"".join(bits), dtype=np.uint8).reshape(len(bits), -1)
    return np.unpackbits(rows, axis=1, bitorder="little").astype(bool)


def nonzero(vector: str = "vector"):
    return F.exists(vector, lambda x: x != 0)


@dataclass
class Pivots:
    """Unit pivots of each model, and the bytes of the longest vector."""

    of: dict[str, np.ndarray]
    row_bytes: int

    def rows(self, size: int) -> int:
        """Rows of at most about ``size`` bytes."""
        return max(1, size // self.row_bytes)


class Dealt:
    """Which blocks hold which cells of each model.

    ``cells(model, cell, n)``; a cell is a column of the model's visits. Cells of a model in turn share a
    block of at most ``most`` rows, and the rows of a larger cell are dealt to blocks of its own.
    """

    def __init__(self, cells: pd.DataFrame, columns: dict[str, int], most: int):
        self.first = {m: np.zeros(n, dtype=np.int64) for m, n in columns.items()}
        self.parts = {m: np.zeros(n, dtype=np.int64) for m, n in columns.items()}
        at, held, last = -1, math.inf, None
        for r in cells.sort_values(["model", "cell"]).itertuples():
            parts = max(1, math.ceil(r.n / most))
            if parts > 1 or r.model != last or held + r.n > most:
                at, held = at + 1, 0
            self.first[r.model][r.cell], self.parts[r.model][r.cell] = at, parts
            at, held, last = at + parts - 1, (math.inf if parts > 1 else held + r.n), r.model

    def block(self, model: str, cells: np.ndarray, ids: np.ndarray) -> np.ndarray:
        mixed = (ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        return self.first[model][cells] + (mixed % self.parts[model][cells].astype(np.uint64)).astype(np.int64)

    def visited(self, model: str, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Block numbers of the model, and which of them hold a flagged cell, a row each."""
        first, parts = self.first[model], self.parts[model]
        if not parts.any():
            return np.zeros(0, dtype=np.int64), np.zeros((len(flags), 0), dtype=bool)
        low = first[parts > 0].min()
        holds = np.zeros((len(first), int((first + parts).max() - low)), dtype=np.float32)
        for cell in np.flatnonzero(parts):
            holds[cell, first[cell] - low : first[cell] - low + parts[cell]] = 1
        return low + np.arange(holds.shape[1]), flags.astype(np.float32) @ holds > 0


def visitors(rows: DataFrame) -> pd.DataFrame:
    """How many rows of ``(model, open)`` visit each cell."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for model, group in batch.groupby("model", sort=False):
                n = unpacked(group["open"]).sum(axis=0)
                yield pd.DataFrame({"model": model, "cell": np.flatnonzero(n), "n": n[n > 0]})

    counted = rows.select("model", "open").mapInPandas(run, "model string, cell int, n bigint")
    return counted.groupBy("model", "cell").agg(F.sum("n").alias("n_visitors")).toPandas()


def choose_pivots(vectors: DataFrame, block_bytes: int = BLOCK_BYTES) -> Pivots:
    """About 4 sqrt(n) vectors of each model, in hash order of their ids.

    ``vectors(id, model, vector)``. All pivots together stay under ``block_bytes`` (at least one a
    model; models are names of embedding versions), and a model has at most ``PIVOTS``. Any choice
    gives the same result; it only decides how many pairs are compared.
    """
    known = vectors.filter(nonzero())
    models = known.groupBy("model").agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("d")).collect()
    row_bytes = 8 * max((r["d"] for r in models), default=1)
    n = sum(r["n"] for r in models)
    wanted = min(PIVOTS, 4 * math.isqrt(n) + 1, block_bytes // (row_bytes * max(1, len(models))))
    first = Window.partitionBy("model").orderBy(F.xxhash64("id"), "id")
    chosen = (
        known.withColumn("_n", F.row_number().over(first))
        .filter(F.col("_n") <= max(1, wanted))
        .orderBy("model", "_n")
        .select("model", "vector")
        .toPandas()
    )
    return Pivots({m: unit_rows(g["vector"]) for m, g in chosen.groupby("model")}, row_bytes)


def in_cells(vectors: DataFrame, pivots: Pivots) -> DataFrame:
    """``vectors(id, model, vector)`` with the cell of the nearest pivot and the angle to it."""
    shared = vectors.sparkSession.sparkContext.broadcast(pivots.of)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for model, group in batch.groupby("model", sort=False):
                group = group.assign(cell=NOWHERE, angle=0.0)
                if model in shared.value:
                    unit = unit_rows(group["vector"])
                    to = angles(unit, shared.value[model])
                    some = unit.any(axis=1)
                    group["cell"] = np.where(some, to.argmin(axis=1), NOWHERE)
                    group["angle"] = np.where(some, to.min(axis=1), 0.0)
                yield group[["id", "model", "vector", "cell", "angle"]]

    return vectors.select("id", "model", F.col("vector").cast("array<double>").alias("vector")).mapInPandas(run, PLACED)


@dataclass
class Meeting:
    """What meets in the cells: queries with the cells and blocks they visit, placed targets, rows of each cell."""

    queries: DataFrame
    targets: DataFrame
    cells: pd.DataFrame

    @property
    def compared(self) -> int:
        """Pairs that are multiplied, to be held against all queries times all targets."""
        met = self.cells.merge(visitors(self.queries), on=["model", "cell"])
        return int((met["n_visitors"] * met["n"]).sum())


def meeting(
    queries: DataFrame, targets: DataFrame, k: int, at_least: float = -1.0, block_bytes: int = BLOCK_BYTES,
    part_bytes: int = PART_BYTES,
) -> tuple[Meeting, Pivots]:
    """Which cells each query has to visit for its k best targets of similarity ``at_least`` or more.

    A cell offers one target at most its least angle away from the pivot, and its others at most its
    radius away; the k-th best offer of all cells is an upper bound of the query's k-th best angle. A cell
    is visited if its lower bound does not pass that. ``open`` has a bit a cell, the last one for zero
    vectors, and ``blocks`` are the blocks of at most about ``part_bytes`` that hold an open cell.
    """
    pivots = choose_pivots(targets, block_bytes)
    placed = in_cells(targets, pivots)
    figures = (
        placed.groupBy("model", "cell")
        .agg(F.min("angle").alias("least"), F.max("angle").alias("radius"), F.count("*").alias("n"))
        .toPandas()
    )
    reach = math.acos(max(-1.0, min(1.0, at_least)))
    columns = {m: len(pivots.of.get(m, ())) + 1 for m in figures["model"].unique()}
    known = {}
    for model, rows in figures.groupby("model"):
        n = columns[model] - 1
        radius, inner, zeros = np.full(n, -np.inf), np.full((n, k), np.inf), np.zeros(0)
        for r in rows.itertuples():
            held = min(k, r.n)
            if r.cell == NOWHERE:
                zeros = np.full(held, math.pi / 2)
            else:
                radius[r.cell], inner[r.cell, :held] = r.radius, r.radius
                inner[r.cell, 0] = r.least
        known[model] = radius, inner, zeros
    # The cell of zero vectors is the last column.
    cells = figures.assign(cell=np.where(figures["cell"] == NOWHERE, figures["model"].map(columns) - 1, figures["cell"]))
    dealt = Dealt(cells, columns, pivots.rows(part_bytes))
    shared = queries.sparkSession.sparkContext.broadcast((pivots.of, known, dealt, columns))

    def visits(model: str, vectors: pd.Series) -> np.ndarray:
        pivots_of, cells_of, _, _ = shared.value
        radius, inner, zeros = cells_of[model]
        out = np.zeros((len(vectors), len(radius) + 1), dtype=bool)
        step = max(1, (4 << 20) // max(1, inner.size))
        for at in range(0, len(vectors), step):
            unit = unit_rows(vectors.iloc[at : at + step])
            some = unit.any(axis=1)
            bound = np.full(len(unit), reach)
            to = angles(unit, pivots_of[model]) if model in pivots_of else np.zeros((len(unit), 0))
            offers = (to[:, :, None] + inner[None]).reshape(len(unit), -1)
            offers = np.concatenate([offers, np.broadcast_to(zeros, (len(unit), len(zeros)))], axis=1)
            if offers.shape[1] >= k:
                bound = np.minimum(bound, np.partition(offers, k - 1, axis=1)[:, k - 1])
            here = out[at : at + step]
            here[:, :-1] = (to - radius <= bound[:, None] + SLACK) & some[:, None]
            here[:, -1] = (len(zeros) > 0) & (math.pi / 2 <= bound + SLACK) & some
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _, cells_of, dealt, _ = shared.value
        for batch in batches:
            for model, group in batch.groupby("model", sort=False):
                if model not in cells_of:
                    continue
                flags = visits(model, group["vector"])
                names, met = dealt.visited(model, flags)
                yield group.assign(open=packed(flags), blocks=[names[row].tolist() for row in met])

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _, _, dealt, columns = shared.value
        for batch in batches:
            for model, group in batch.groupby("model", sort=False):
                cell = np.where(group["cell"] == NOWHERE, columns[model] - 1, group["cell"])
                block = dealt.block(model, cell, group["id"].to_numpy())
                yield group.drop(columns="angle").assign(cell=cell, block=block)

    doubles = F.col("vector").cast("array<double>").alias("vector")
    routed = cut_lineage(
        queries.select("query_id", "model", doubles).mapInPandas(
            run, "query_id bigint, model string, vector array<double>, open binary, blocks array<int>"
        )
    )
    located = placed.mapInPandas(place, "id bigint, model string, vector array<double>, cell int, block int")
    return Meeting(routed, located, cells), pivots


def nearest(
    queries: DataFrame, targets: DataFrame, k: int, block_bytes: int = BLOCK_BYTES, at_least: float = -1.0,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """E4. For every query its k most similar targets of the same model.

    ``queries(query_id, model, vector)``, ``targets(target_id, model, vector)``. Targets are placed
    in metric cells and queries visit the cells that can hold one of their k best (``meeting``). Cells share
    blocks: a query travels once to a block, however many of its cells it visits, with a bit a cell. A task
    holds a block of targets and some of its queries, each of at most about ``part_bytes``, multiplies
    cell by cell, at most ``block_bytes`` of targets at once, and a per-query limit merges the blocks.
    Exact for every size of blocks. Of equal target vectors only the k lowest ids can be an answer, so the
    others do not travel. Targets less similar than ``at_least`` may be missing. Rows without a vector or a
    model have no neighbours; a zero vector's similarity to everything is 0, so it gets the lowest ids.
    """
    known = "vector IS NOT NULL AND model IS NOT NULL"
    queries = queries.select("query_id", "model", "vector").filter(known)
    targets = targets.select(F.col("target_id").alias("id"), "model", "vector").filter(known)
    twins = Window.partitionBy("model", "vector").orderBy("id")
    targets = cut_lineage(targets.withColumn("_n", F.row_number().over(twins)).filter(F.col("_n") <= k).drop("_n"))
    met, pivots = meeting(queries, targets, k, at_least, block_bytes, part_bytes)

    spark = queries.sparkSession
    visiting = met.queries.select("query_id", "vector", "open", F.explode("blocks").alias("block"))
    # A block's targets meet its queries in parts of at most half a block, and in enough parts to share the work.
    sizes = visiting.groupBy("block").agg(F.count("*").alias("n")).collect()
    most = min(pivots.rows(part_bytes // 2), max(LEAST, math.ceil(sum(r["n"] for r in sizes) / TASKS)))
    parts = F.broadcast(
        spark.createDataFrame([(r["block"], math.ceil(r["n"] / most)) for r in sizes], "block int, parts int")
    )
    q = visiting.join(parts, "block").withColumn("part", F.pmod(F.xxhash64("query_id"), "parts").cast("int")).drop("parts")
    t = (
        met.targets.select(F.col("id").alias("target_id"), "vector", "cell", "block")
        .join(parts, "block")
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .drop("parts")
    )
    tile = min(TILE, pivots.rows(block_bytes))

    def pair(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "target_id": [], "similarity": []})
        return top_k(left, right, k, tile)

    keys = ["block", "part"]
    found = q.groupBy(*keys).cogroup(t.groupBy(*keys)).applyInPandas(pair, RESULT)
    best = Window.partitionBy("query_id").orderBy(F.round("similarity", 12).desc(), "target_id")
    ranked = found.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= k).drop("_n")

    lowest = Window.partitionBy("model").orderBy("id")
    first = (
        targets.select("model", F.col("id").alias("target_id"), F.row_number().over(lowest).alias("_n"))
        .filter(F.col("_n") <= k)
        .drop("_n")
    )
    blank = queries.filter(~nonzero()).select("query_id", "model").join(F.broadcast(first), "model")
    return ranked.unionByName(blank.select("query_id", "target_id", F.lit(0.0).alias("similarity")))
