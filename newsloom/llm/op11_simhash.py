"""SimHash near-duplicates by vantage-point trees over Hamming distance.

1. A text's words, A-Z lower-cased, give 3-word shingles (repeats included; a shorter text is one
   shingle). Bit b of the fingerprint is set if it is set in over half of the shingles' XXH64 hashes
   (seed 42). Texts without a word have fingerprint zero, which links like any other.
2. Equal fingerprints are folded. A vantage-point tree over a sample of ``SAMPLE`` fingerprints a
   shard deals the others to shards: at each node those within the node's radius go left, the
   others right. A fingerprint whose distance lies up to ``LINK`` below the radius visits the
   right side too: by the triangle inequality no other pair crosses the node.
3. A shard searches its own fingerprints and visitors in a tree of its own with the same rule,
   down to leaves that are compared in whole. Every linked pair meets in one leaf. What leaves a leaf is a
   spanning forest of its links, never all its pairs.
4. Components of the forest edges, by stars; the smallest doc_id of each is its id.

Null texts are empty. Rows with a null doc_id are fingerprinted and link others; they get the id of
their component, null if it has no other. Repeated rows give equal results. The tree is
sent to all tasks; it has at most ``SHARDS`` leaves, beyond which shards grow.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import U, mix, signed, stored, text_steps
from newsloom.llm.op06_minhash import components

SHINGLE = 3
SEED = 42
LINK = 3
#: Distinct fingerprints of a shard, sampled ones for each, and shards at most.
SHARD, SAMPLE, SHARDS = 1 << 15, 64, 1 << 16
#: Fingerprints of a leaf, vantage points tried at a node, and distances computed at once.
LEAF, TRIED, BLOCK = 256, 8, 1 << 22
#: Shingles hashed at once.
STEP = 1 << 18


def fingerprint(text: bytes) -> int:
    """The fingerprint of one text in UTF-8."""
    words = text.lower().split()  # bytes: A-Z, and the six ASCII spaces
    if not words:
        return 0
    size = min(SHINGLE, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    total = len(words) - size + 1
    ones = np.zeros(64, np.int64)
    for at in range(0, total, STEP):
        to = min(at + STEP, total)
        spans = zip(starts[at:to].tolist(), ends[at + size - 1 : to + size - 1].tolist(), strict=True)
        h = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans], "<u8")
        ones += _set_bits(h)
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<u8")[0])


def _set_bits(h: np.ndarray) -> np.ndarray:
    """How many values have each bit set: eight bits at a time, one byte lane each."""
    out = np.zeros((8, 8), np.int64)
    for bit in range(8):
        lanes = h >> U(bit) & U(0x0101010101010101)
        for at in range(0, len(lanes), 255):  # a lane holds up to 255
            out[:, bit] += lanes[at : at + 255].sum(dtype=np.uint64).reshape(1).view(np.uint8)
    return out.ravel()


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp, the signed form of the fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, bounds in text_steps(batches):
            raw = data.tobytes()
            own = np.array([fingerprint(raw[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], np.uint64)
            yield pa.record_batch([batch.column("doc_id"), pa.array(signed(own))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, fp bigint")


def distance(point: np.uint64, others: np.ndarray) -> np.ndarray:
    return np.bitwise_count(others ^ point)


def vantage(points: np.ndarray) -> tuple[np.uint64, int] | None:
    """The best of some vantage points and its radius, so that both sides have points; None if no point parts the others.

    The best has the fewest points that would visit the other side, against an even split.
    """
    best = None
    for i in np.unique(np.linspace(0, len(points) - 1, TRIED).astype(int)):
        near = np.cumsum(np.bincount(distance(points[i], points), minlength=65))[:65]
        radius = np.flatnonzero((near > 0) & (near < len(points)))
        if not len(radius):
            continue
        left, n = near[radius], len(points)
        edge = left - np.where(radius >= LINK, near[radius - LINK], 0)
        cost = left**2 + (n - left + edge) ** 2
        k = int(cost.argmin())
        if best is None or cost[k] < best[0]:
            best = (cost[k], points[i], int(radius[k]))
    return best and best[1:]


@dataclass(frozen=True)
class Tree:
    """Nodes as arrays: vantage point, radius and children; a child below zero is leaf ``-child - 1``."""

    point: np.ndarray
    radius: np.ndarray
    left: np.ndarray
    right: np.ndarray

    def deal(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of a point, shard, and whether the shard is its own; visitors have a row for each shard they visit."""
        out = []
        stack = [(0 if len(self.point) else -1, np.arange(len(points)), np.ones(len(points), bool))]
        while stack:
            node, who, own = stack.pop()
            if not len(who):
                continue
            if node < 0:
                out.append((who, np.full(len(who), -node - 1), own))
                continue
            for child, k, mine in sides(self.point[node], self.radius[node], points[who], own):
                stack.append((int((self.left, self.right)[child][node]), who[k], mine))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def sides(point: np.uint64, radius: int, points: np.ndarray, own: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Side, places and ownership of the points that go left (0) and right (1) of a node.

    Own points near the radius visit the right side only: one meeting of a pair is enough. Visitors
    look for all own points, so they go to both sides unless the triangle bounds rule one out.
    """
    far = distance(point, points).astype(np.int64)
    k = np.flatnonzero(np.where(own, far <= radius, far <= radius + LINK))
    yield 0, k, own[k]
    k = np.flatnonzero(far > radius - LINK)
    yield 1, k, own[k] & (far[k] > radius)


def top_tree(sample: np.ndarray, shards: int) -> Tree:
    """A tree of about ``shards`` leaves with equally many sampled points."""
    rows: list[list] = []
    leaves = 0
    stack = [(sample, None)]
    least = max(2, -(-len(sample) // max(shards, 1)))
    while stack:
        points, parent = stack.pop()
        found = vantage(points) if len(points) > least else None
        if found is None:
            leaves += 1
            name = -leaves
        else:
            name = len(rows)
            rows.append([*found, 0, 0])
            far = distance(found[0], points) <= found[1]
            stack += [(points[far], (name, 2)), (points[~far], (name, 3))]
        if parent is not None:
            rows[parent[0]][parent[1]] = name
    point, radius, left, right = zip(*rows, strict=True) if rows else ([],) * 4
    return Tree(np.array(point, np.uint64), np.array(radius, np.int64), np.array(left, np.int64), np.array(right, np.int64))


def forest(points: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of linked points that connect all points of a leaf which links connect.

    All own points and visitors are compared with all own points, in blocks; each
    block's links join the parts found so far.
    """
    mine = np.flatnonzero(own)
    label = np.arange(len(points))
    step = max(1, BLOCK // max(len(mine), 1))
    for at in range(0, len(points), step):
        x, y = np.nonzero(np.bitwise_count(points[at : at + step, None] ^ points[mine]) <= LINK)
        x, y = x + at, mine[y]
        while len(x):
            a, b = label[x], label[y]
            apart = a != b
            x, y, a, b = x[apart], y[apart], a[apart], b[apart]
            if len(a):
                to = np.arange(len(points))
                np.minimum.at(to, np.maximum(a, b), np.minimum(a, b))
                while (to[to] != to).any():
                    to = to[to]
                label = to[label]
    k = np.flatnonzero(label != np.arange(len(points)))
    return k, label[k]


def shard_links(points: np.ndarray, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Forest edges (as points) of a shard, leaf by leaf of its tree."""
    stack = [(points, own)]
    while stack:
        points, own = stack.pop()
        if not own.any() or len(points) < 2:
            continue
        found = vantage(points[own]) if own.sum() > LEAF else None
        if found is None:
            a, b = forest(points, own)
            if len(a):
                yield points[a], points[b]
            continue
        stack += [(points[k], mine) for _, k, mine in sides(*found, points, own)]


def dealt(distinct: DataFrame, tree: Tree) -> DataFrame:
    """(shard, own, fp) of each fingerprint and each of its visits."""
    sent = distinct.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy()
            who, shard, own = sent.value.deal(fp.view(np.uint64))
            yield pa.record_batch([pa.array(shard, pa.int64()), pa.array(own, pa.bool_()), pa.array(fp[who])], ["shard", "own", "fp"])

    return distinct.select("fp").mapInArrow(run, "shard bigint, own boolean, fp bigint")


def links(distinct: DataFrame, n: int, shard: int = SHARD, sample: int = SAMPLE) -> DataFrame:
    """Edges (a, b) between fingerprints that join what links join; ``distinct`` has n rows."""
    shards = min(SHARDS, -(-n // shard))
    # Those with the smallest hashes: a sample that a repeated task draws again.
    order = F.xxhash64("fp")
    part = sample * shards / max(n, 1)
    drawn = distinct.select("fp").where(order < F.lit(int(min(part * 2**64, 2**64 - 1)) - 2**63)) if shards > 1 else distinct.limit(0)
    points = np.array([r["fp"] for r in drawn.select("fp").collect()], np.int64).view(np.uint64)
    tree = top_tree(points[np.argsort(mix(points))], shards)

    def run(table: pa.Table) -> pa.Table:
        points, own = table.column("fp").to_numpy().view(np.uint64), table.column("own").to_numpy()
        order = np.argsort(mix(points))
        found = list(shard_links(points[order], own[order]))
        a, b = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.uint64),) * 2
        return pa.table({"a": signed(a), "b": signed(b)})

    return dealt(distinct, tree).groupBy("shard").applyInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, shard: int = SHARD, sample: int = SAMPLE) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row."""
    found = stored(fingerprints(docs))
    distinct = stored(found.groupBy("fp").agg(F.min("doc_id").alias("least")))
    edges = stored(links(distinct, distinct.count(), shard, sample).distinct())
    roots = components(edges)
    named = distinct.join(roots, F.col("fp") == F.col("id"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    each = named.select("fp", "root").join(least, "root").select("fp", "component_id")
    return found.join(each, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
