"""Near duplicates by ProbMinHash over weighted word shingles, banding and verification.

Similarity is the probability Jaccard index of the shingle weights ``1 + ln(count)``;
where no shingle repeats, it is the Jaccard index of the shingle sets. Copies of the
same word sequence are folded first. Buckets of equal bands give candidates; each is
verified on its whole shingle multiset. Classes are the connected components.

No bucket is expanded into all pairs. Every member meets the bucket's smallest id, its hub.
Members that are in another class after that meet the members of other classes in their
buckets, once each, unless one of two bounds rules the pair out: the distances of both to
the hub (exact, as one minus the index is a metric), or a signature estimate below the
similarity by more than ``ERRORS`` standard errors. Pairs in one class already add nothing
to the classes. A link at exactly the similarity is lost with probability 5e-5 by the
bands, and one between classes with 1e-3 by the estimate; both vanish quickly above it.

Null texts and texts without a word are nobody's copies: each is a class of its own.
Texts of fewer than ``size`` words are one shingle. Repeated rows with one id count once. Rows
with a null id are in no class: one row with null class ids stands for them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import STEP, WORD_POWERS, U, Words, lists, mix, signed, span_hashes, stored, text_steps

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 25, 5
ERRORS = 3.0
#: Registers of a signature: the first BANDS * ROWS make the bands, all of them the estimate.
REGISTERS = 256
#: Bits of each register that the estimate compares, packed into words of 64 bits.
NIBBLE, WORDS = 4, REGISTERS // 16


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, shingle hash) in order, with counts."""
    begin, end, doc = words.windows(size, short=True)
    h = span_hashes(words.hashes(), begin, end, WORD_POWERS)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(np.append(at, len(h)))


def prob_minhash(doc: np.ndarray, elem: np.ndarray, weight: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """Signatures: the element that arrives first in each of m registers.

    An element's arrivals are a Poisson process of rate ``weight``; each falls in a
    random register. An element stops once its next arrival is later than all
    registers of its document, which ends all work early. Randomness comes from
    the element alone, so documents agree on it.
    """
    time = np.full(n_docs * m, np.inf)
    owner = np.zeros(n_docs * m, np.uint64)
    seed = mix(elem ^ U(0x5851F42D4C957F2D))
    now = np.zeros(len(elem))
    live = np.arange(len(elem))
    k = 0
    while len(live):
        k += 1
        draw = mix(seed[live] + U(k * int(STEP) % 2**64))
        now[live] -= np.log(((draw >> U(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight[live]
        slot = doc[live] * m + (mix(draw) % U(m)).astype(np.int64)
        np.minimum.at(time, slot, now[live])
        first = time[slot] == now[live]
        owner[slot[first]] = elem[live[first]]
        latest = time.reshape(n_docs, m).max(axis=1)
        live = live[now[live] < latest[doc[live]]]
    return owner.reshape(n_docs, m)


def sketch(docs: DataFrame, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, a 128-bit digest of the word sequence, one key per band and the packed low bits of
    the registers; no row without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, bounds in text_steps(batches):
            words = Words(data, bounds)
            doc, h, count = shingles(words, size)
            sig = prob_minhash(doc, h, 1 + np.log(count), len(bounds) - 1, REGISTERS)
            key = np.zeros((len(sig), bands), np.uint64) + np.arange(bands, dtype=np.uint64) * STEP
            for r in range(rows):
                key = mix(key ^ sig[:, : bands * rows].reshape(-1, bands, rows)[:, :, r]) + STEP
            packed = np.bitwise_or.reduce((mix(sig) & U(15)).reshape(-1, WORDS, 16) << (U(NIBBLE) * np.arange(16, dtype=np.uint64)), axis=2)
            whole = [span_hashes(words.hashes(s), words.first[:-1], words.first[1:], WORD_POWERS) for s in (0, 1)]
            some = np.flatnonzero(words.count)
            yield pa.record_batch([
                batch.column("doc_id").take(pa.array(some)), pa.array(signed(whole[0][some])), pa.array(signed(whole[1][some])),
                lists(signed(key[some]).ravel(), np.full(len(some), bands), pa.int64()),
                lists(signed(packed[some]).ravel(), np.full(len(some), WORDS), pa.int64()),
            ], ["doc_id", "d0", "d1", "keys", "registers"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, d0 bigint, d1 bigint, keys array<bigint>, registers array<bigint>")


def profiles(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id and the sorted shingle hashes of its whole text, repeats included, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, bounds in text_steps(batches):
            doc, h, count = shingles(Words(data, bounds), size)
            full = np.repeat(h, count)
            per = np.bincount(doc, count, len(bounds) - 1).astype(np.int64) * 8
            at = np.concatenate([[0], np.cumsum(per)])
            raw = full.tobytes()
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array([raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())],
                ["doc_id", "profile"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, profile binary")


def probability_jaccard(a: bytes, b: bytes) -> float:
    """Exact index of two profiles."""
    ha, ca = np.unique(np.frombuffer(a, np.uint64), return_counts=True)
    hb, cb = np.unique(np.frombuffer(b, np.uint64), return_counts=True)
    both, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    wa, wb = 1 + np.log(ca), 1 + np.log(cb)
    x, y = wa[ia], wb[ib]
    only_a, only_b = wa.sum() - x.sum(), wb.sum() - y.sum()
    # The sum over j of max(a_j / a_i, b_j / b_i), by the order of the ratios a_j / b_j.
    order = np.argsort(x / y)
    x, y = x[order], y[order]
    ratio = x / y
    low = np.searchsorted(ratio, ratio, "left")
    above = x.sum() - np.concatenate([[0], np.cumsum(x)])[low] + only_a
    below = np.concatenate([[0], np.cumsum(y)])[low] + only_b
    return float((1 / (above / x + below / y)).sum())


def verified(pairs: DataFrame, profile: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) at or above the similarity, with it."""
    left = profile.select(F.col("doc_id").alias("a"), F.col("profile").alias("pa"))
    right = profile.select(F.col("doc_id").alias("b"), F.col("profile").alias("pb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.array([
                probability_jaccard(x.as_py(), y.as_py()) for x, y in zip(batch.column("pa"), batch.column("pb"), strict=True)
            ], np.float64)
            keep = pa.array(np.flatnonzero(score >= similarity - 1e-9))
            yield pa.record_batch(
                [batch.column("a").take(keep), batch.column("b").take(keep), pa.array(score).take(keep)], ["a", "b", "similarity"]
            )

    return pairs.join(left, "a").join(right, "b").select("a", "b", "pa", "pb").mapInArrow(run, "a bigint, b bigint, similarity double")


def components(links: DataFrame) -> DataFrame:
    """(id, root): the smallest id that each linked id reaches, by alternating stars.

    Each round halves the paths; the loop ends when every id has one edge, to an id without one.
    """
    edges = stored(links.select("a", "b").where("a <> b").distinct())
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Large star: larger neighbours go to the smallest of the neighbourhood.
        least = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("root").alias("b")).distinct()
        # Small star: an id and its smaller neighbours go to the smallest of them.
        small = stored(large.groupBy("a").agg(F.min("b").alias("root")))
        pulled = large.join(small, "a").where("b <> root").select(F.col("b").alias("a"), F.col("root").alias("b"))
        edges = stored(pulled.unionAll(small.select("a", F.col("root").alias("b"))).distinct())
        spread = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
        inner = edges.select(F.col("b").alias("a")).distinct().join(spread, "a", "left_semi").select("a")
        if spread.where("n > 1").select("a").unionAll(inner).isEmpty():
            return edges.select(F.col("a").alias("id"), F.col("b").alias("root"))


def _unequal(a: str, b: str) -> Column:
    """Registers whose low bits differ, from the packed words."""
    total = F.lit(0)
    for i in range(WORDS):
        d = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 2))
        total = total + F.bit_count(d.bitwiseAND(F.lit(0x1111111111111111)))
    return total


def classes(docs: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per doc_id: class_id (smallest id of the class) and exact_of (smallest id with
    the same words). Links are found only as far as the classes need them, so none are counted."""
    own = docs.where("doc_id is not null")
    found = stored(sketch(own, size, bands, rows))
    copies = stored(found.groupBy("d0", "d1").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    member = stored(
        found.select("doc_id", "d0", "d1").join(copies, ["d0", "d1"])
        .select(F.col("doc_id").alias("id"), "rep").where("id <> rep").distinct()
    )
    single = found.join(member, found["doc_id"] == member["id"], "left_anti")
    banded = single.select(F.col("doc_id").alias("id"), F.explode("keys").alias("key"))
    hubs = stored(banded.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("last")).where("hub < last"))
    buckets = stored(banded.join(hubs.select("key", "hub"), "key").select("key", "id", "hub").distinct())
    star = buckets.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    named = buckets.select(F.col("id").alias("doc_id")).distinct()
    profile = stored(profiles(own.select("doc_id", "text").join(named, "doc_id", "left_semi"), size).dropDuplicates(["doc_id"]))
    tested = stored(verified(star, profile, 0.0))
    links = tested.where(F.col("similarity") >= similarity - 1e-9)
    roots = components(links)

    # Members that the star left outside the hub's class meet the bucket's other classes.
    root = stored(named.join(roots, F.col("doc_id") == F.col("id"), "left").select(
        F.col("doc_id").alias("id"), F.coalesce("root", "doc_id").alias("root")))
    placed = stored(
        buckets.join(root, "id")
        .join(root.select(F.col("id").alias("hub"), F.col("root").alias("hub_root")), "hub")
        .join(tested.select(F.col("a").alias("hub"), F.col("b").alias("id"), (1 - F.col("similarity")).alias("far")), ["hub", "id"])
        .select("key", "id", "root", "hub_root", "far")
    )
    outside = stored(placed.where("root <> hub_root").select("key", "id"))
    busy = outside.select("key").distinct()
    traits = single.select(F.col("doc_id").alias("id"), "keys", "registers").dropDuplicates(["id"])
    rest = stored(placed.join(busy, "key", "left_semi").select("key", "id", "root", "far").join(traits, "id"))
    x, y = rest.join(outside, ["key", "id"], "left_semi").alias("x"), rest.alias("y")
    m = REGISTERS
    expected = m * (similarity + (1 - similarity) / 2**NIBBLE)
    least = expected - ERRORS * (expected * (1 - expected / m)) ** 0.5
    meet = (
        (F.col("x.key") == F.col("y.key")) & (F.col("x.root") != F.col("y.root"))
        & (F.abs(F.col("x.far") - F.col("y.far")) <= 1 - similarity + 1e-9)
        & (m - _unequal("x.registers", "y.registers") >= least)
        # Each pair once: in the first of its common buckets.
        & (F.element_at(F.array_intersect("x.keys", "y.keys"), 1) == F.col("x.key"))
    )
    second = x.join(y, meet).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()
    links = stored(links.unionAll(verified(second, profile, similarity)).dropDuplicates(["a", "b"]))
    roots = components(links)

    ids = docs.select("doc_id").distinct().join(member, F.col("doc_id") == F.col("id"), "left").select(
        "doc_id", F.coalesce("rep", "doc_id").alias("exact_of"))
    return (
        ids.join(roots.withColumnRenamed("id", "exact_of"), "exact_of", "left")
        .select("doc_id", F.coalesce("root", "exact_of").alias("class_id"), "exact_of")
    )


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The documents without near duplicates: the smallest id of each class stays.

    A null id belongs to no class; such rows stay.
    """
    gone = stored(classes(docs, **options).where("doc_id <> class_id").select("doc_id"))
    return docs.join(gone, "doc_id", "left_anti")
