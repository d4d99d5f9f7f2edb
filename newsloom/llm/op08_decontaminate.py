"""Benchmark decontamination by rare seeds and Smith-Waterman alignment.

Texts are compared as lower-case words without ASCII punctuation. The score is the best local
alignment's weight over the item's weight with itself, 0 to 1.

The seeds of an item are its ordered pairs of words one or two places apart. An alignment of m
matches and e edits weighs 2 m - e; at the score s it has 2 m - e >= 2 s L for an item of L
words. Two matches that follow each other cost at least 2 edits unless they are at most two
places apart in item and text, so at least need = s L - 1 of them are such pairs, each begun by
another word of the item, and the text's part is at most m + e <= (3 - 2 s) L words long. Items
of at most 1 / s words have their single words as seeds.

A first scan counts how often the corpus holds each seed. An item is probed with its rare seeds
only: the need - 1 words whose seeds are most frequent begin no probe, and by pigeonhole every
alignment at the score still holds one. Texts and items that share a probe are joined, all
seeds of the item are counted in the text, and only texts with so many of them in so short a
part are aligned. Frequencies choose the probes, not the result: it is that of aligning every
text with every item, at any size of the corpus.

Items reach the workers in parts of about ``ITEM_WORDS`` words, each two scans of the texts. Null
texts and items are empty; empty items match nothing. Repeated rows with one doc_id count once, at
their best score. Rows with a null doc_id or item_id are not compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import STEP, U, Words, column_bytes, lists, mix, signed, stored, text_steps

SCORE = 0.5
FILTER_BITS = 1 << 22
ITEM_WORDS = 1 << 20
#: Rows that a step of the join holds at once. One text has at most a part's seeds of them when it
#: meets its items, and its own length when it is compared with one.
MOST_HITS = 1 << 20
MATCH, MISMATCH, GAP = 2, -1, -1

LETTERS = np.arange(256, dtype=np.uint8)
LETTERS[[c for c in range(33, 127) if not chr(c).isalnum()]] = 32


def plain_words(column: pa.Array) -> Words:
    data, bounds = column_bytes(pc.utf8_lower(column.cast(pa.large_string())))
    return Words(LETTERS[data], bounds)


@dataclass(frozen=True)
class Index:
    """Items with words, their seeds, and the items that each seed probes for."""

    ids: np.ndarray
    words: np.ndarray
    first: np.ndarray
    #: Seeds that an alignment at the score has at least, and the words of text that it spans at most.
    need: np.ndarray
    span: np.ndarray
    #: All seeds, sorted; item i has those numbered ``own[own_at[i]:own_at[i + 1]]``.
    seed: np.ndarray
    own_at: np.ndarray
    own: np.ndarray
    #: Seed k probes for the items ``owner[at[k]:at[k + 1]]``.
    at: np.ndarray
    owner: np.ndarray
    #: Whether any seed is a single word.
    single: bool


def item_words(bench: DataFrame) -> DataFrame:
    """item_id and words (hashes) of each item that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            words = plain_words(batch.column("text"))
            yield pa.record_batch([batch.column("item_id"), lists(signed(words.hashes()), words.count, pa.int64())], ["item_id", "words"])

    return bench.where("item_id is not null").select("item_id", "text").mapInArrow(
        run, "item_id bigint, words array<bigint>").where(F.size("words") > 0)


def seeds(h: np.ndarray, row: np.ndarray, apart: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words that begin a seed, and the seeds; rows are never crossed."""
    if not apart:
        return np.arange(len(h)), mix(h + STEP)
    at = np.flatnonzero(row[:-apart] == row[apart:])
    return at, mix(mix(h[at]) + h[at + apart])


def seed_hits(words: Words, h: np.ndarray, seed: np.ndarray, known: np.ndarray, single: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of the texts that begin a seed of the sorted ``seed``, and its number."""
    row = words.doc()
    place, which = [], []
    for apart in (0, 1, 2) if single else (1, 2):
        at, own = seeds(h, row, apart)
        hit = np.flatnonzero(known[(own % U(FILTER_BITS)).astype(np.int64)])
        k = np.minimum(np.searchsorted(seed, own[hit]), len(seed) - 1)
        same = seed[k] == own[hit]
        place.append(at[hit[same]])
        which.append(k[same])
    return np.concatenate(place), np.concatenate(which)


def seed_filter(seed: np.ndarray) -> np.ndarray:
    known = np.zeros(FILTER_BITS, bool)
    known[(seed % U(FILTER_BITS)).astype(np.int64)] = True
    return known


def frequencies(docs: DataFrame, seed: np.ndarray, single: bool) -> np.ndarray:
    """Occurrences of each seed in all texts: one row a seed and task is shuffled, one a seed comes back."""
    sent = docs.sparkSession.sparkContext.broadcast(seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = seed_filter(sent.value), np.zeros(len(sent.value), np.int64)
        for batch, _, _ in text_steps(batches):
            words = plain_words(batch.column("text"))
            if len(words):
                total += np.bincount(seed_hits(words, words.hashes(), sent.value, known, single)[1], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], ["k", "n"])

    found = docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(run, "k bigint, n bigint")
    rows = found.groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(seed), np.int64)
    out[rows.column("k").to_numpy()] = rows.column("n").to_numpy()
    return out


def index_items(items: DataFrame, docs: DataFrame, score: float) -> Index:
    rows = items.select("item_id", "words").toArrow()
    words = rows.column("words").combine_chunks()
    size = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    h = words.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    row = np.repeat(np.arange(len(size)), size)
    short = score * size <= 1
    need = np.where(short, 1, np.maximum(np.ceil(score * size - 1 - 1e-9), 1)).astype(np.int64)
    place, found = [], []
    for apart in (0, 1, 2):
        at, own = seeds(h, row, apart)
        mine = short[row[at]] == (apart == 0)
        place.append(at[mine])
        found.append(own[mine])
    place = np.concatenate(place)
    seed, number = np.unique(np.concatenate(found), return_inverse=True)
    n_seeds = max(len(seed), 1)
    often = frequencies(docs, seed, bool(short.any())) if len(seed) else np.zeros(0, np.int64)

    # Of an item's words that begin seeds, all but the need - 1 most frequent begin its probes.
    begin = np.unique(place)
    weight = np.bincount(place, often[number], len(h))[begin]
    order = np.lexsort((begin, -weight, row[begin]))
    rank = np.arange(len(begin)) - np.searchsorted(row[begin], row[begin])
    probing = np.zeros(len(h), bool)
    probing[begin[order]] = rank >= need[row[begin]] - 1

    own_at, own = np.divmod(np.unique(row[place] * n_seeds + number), n_seeds)
    rare = probing[place]
    at, owner = np.divmod(np.unique(number[rare] * max(len(size), 1) + row[place[rare]]), max(len(size), 1))
    return Index(
        rows.column("item_id").to_numpy(), h, np.concatenate([[0], np.cumsum(size)]), need,
        np.ceil((3 - 2 * score) * size).astype(np.int64), seed, np.searchsorted(own_at, np.arange(len(size) + 1)), own,
        np.searchsorted(at, np.arange(len(seed) + 1)), owner, bool(short.any()),
    )


def spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers from each start, as many as its count, one run after another."""
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(start, count)


def blocks(weight: np.ndarray) -> Iterator[slice]:
    """Runs of about ``MOST_HITS`` of weight, of one row at least."""
    total = np.concatenate([[0], np.cumsum(weight)])
    done = 0
    while done < len(weight):
        to = int(np.searchsorted(total, total[done] + MOST_HITS, "right")) - 1
        to = max(to, done + 1)
        yield slice(done, to)
        done = to


def passages(words: Words, h: np.ndarray, index: Index, known: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Item, text, first and end word and number of seeds of each passage that can hold an item."""
    n, n_seeds, n_items = len(h), len(index.seed), len(index.ids)
    place, which = seed_hits(words, h, index.seed, known, index.single)
    if not len(place):
        return
    row = words.doc()
    order = np.lexsort((place, which, row[place]))
    place, key = place[order], (row[place] * n_seeds + which)[order]
    # Each seed of each text once, with the run of its places.
    pair, start = np.unique(key, return_index=True)
    stop = np.append(start[1:], len(key))
    text, seed = np.divmod(pair, n_seeds)
    edge = np.searchsorted(text, np.arange(len(words.count) + 1))
    held = np.diff(np.searchsorted(key, np.arange(len(words.count) + 1) * n_seeds))
    count = index.at[seed + 1] - index.at[seed]
    for texts in blocks(np.diff(np.concatenate([[0], np.cumsum(count)])[edge])):
        part = slice(edge[texts.start], edge[texts.stop])
        met = np.unique(
            np.repeat(text[part], count[part]) * n_items + index.owner[spread(index.at[seed[part]], count[part])])
        in_text, item = np.divmod(met, n_items)
        for some in blocks(index.own_at[item + 1] - index.own_at[item] + held[in_text]):
            yield from confirmed(words, index, in_text[some], item[some], place, pair, start, stop)


def confirmed(
    words: Words, index: Index, text: np.ndarray, item: np.ndarray,
    place: np.ndarray, pair: np.ndarray, start: np.ndarray, stop: np.ndarray,
) -> Iterator[tuple[np.ndarray, ...]]:
    """Passages of the pairs (text, item): as many seeds as an alignment needs, as near as it can be."""
    n = int(words.first[-1])
    size = index.own_at[item + 1] - index.own_at[item]
    who = np.repeat(np.arange(len(item)), size)
    want = text[who] * len(index.seed) + index.own[spread(index.own_at[item], size)]
    k = np.minimum(np.searchsorted(pair, want), len(pair) - 1)
    same = pair[k] == want
    who, k = who[same], k[same]
    runs = stop[k] - start[k]
    enough = (np.bincount(who, runs, len(item)) >= index.need[item])[who]
    who, k, runs = who[enough], k[enough], runs[enough]
    code = np.unique(np.repeat(who, runs) * n + place[spread(start[k], runs)])
    who, at = np.divmod(code, n)
    need = index.need[item[who]]
    last = np.arange(len(code)) + need - 1
    k = np.flatnonzero(last < len(code))
    last = last[k]
    near = (who[last] == who[k]) & (at[last] - at[k] < index.span[item[who[k]]])
    k, last = k[near], last[near]
    if not len(k):
        return
    who = who[k]
    span = index.span[item[who]]
    lo = np.maximum(at[k] - span, words.first[text[who]])
    hi = np.minimum(at[last] + span + 1, words.first[text[who] + 1])
    new = np.ones(len(k), bool)
    new[1:] = (who[1:] != who[:-1]) | (lo[1:] > hi[:-1])
    begin = np.flatnonzero(new)
    who, lo, hi = who[begin], lo[begin], hi[np.append(begin[1:], len(k)) - 1]
    yield item[who], text[who], lo, hi, np.searchsorted(code, who * n + hi) - np.searchsorted(code, who * n + lo)


def smith_waterman(item: np.ndarray, passage: np.ndarray) -> tuple[float, int, int]:
    """Weight of the best local alignment over the item's own, and its last word in item and passage."""
    if not len(item) or not len(passage):
        return 0.0, 0, 0
    slope = np.arange(len(passage) + 1) * GAP
    row = np.zeros(len(passage) + 1)
    best, where = 0.0, (0, 0)
    for i, word in enumerate(item):
        step = np.maximum(row + GAP, 0)
        step[1:] = np.maximum(step[1:], row[:-1] + np.where(passage == word, MATCH, MISMATCH))
        row = np.maximum.accumulate(step - slope) + slope  # gaps along the passage
        top = int(row.argmax())
        if row[top] > best:
            best, where = float(row[top]), (i, top - 1)
    return best / (MATCH * len(item)), *where


def aligned(docs: DataFrame, index: Index, score: float) -> DataFrame:
    """doc_id, item_id, score and n_seeds of each passage at or above the score."""
    sent = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        known = seed_filter(own.seed)
        for batch, _, _ in text_steps(batches):
            words = plain_words(batch.column("text"))
            h = words.hashes()
            if not len(h):
                continue
            for who, text, lo, hi, n in passages(words, h, own, known):
                got = np.array([
                    smith_waterman(own.words[own.first[i] : own.first[i + 1]], h[a:b])[0] for i, a, b in zip(who, lo, hi, strict=True)
                ])
                keep = np.flatnonzero(got >= score)
                yield pa.record_batch([
                    batch.column("doc_id").take(pa.array(text[keep])), pa.array(own.ids[who[keep]], pa.int64()),
                    pa.array(got[keep]), pa.array(n[keep].astype(np.int64)),
                ], ["doc_id", "item_id", "score", "n_seeds"])

    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(
        run, "doc_id bigint, item_id bigint, score double, n_seeds bigint")


def matches(docs: DataFrame, bench: DataFrame, score: float = SCORE) -> DataFrame:
    """(doc_id, item_id, score, n_seeds) of the documents that hold a copy of an item at or above the
    score; n_seeds counts the words of the passage that begin a seed of the item."""
    items = stored(item_words(bench))
    parts = -(-(items.agg(F.sum(F.size("words"))).first()[0] or 0) // ITEM_WORDS)
    part = F.pmod(F.xxhash64("item_id", "words"), F.lit(max(parts, 1)))
    found = docs.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint, score double, n_seeds bigint")
    for i in range(parts):
        index = index_items(items.where(part == i), docs, score)
        if len(index.ids):
            found = found.unionAll(aligned(docs, index, score))
    return found.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"), F.max("n_seeds").alias("n_seeds"))


def clean(docs: DataFrame, bench: DataFrame, score: float = SCORE) -> DataFrame:
    """The documents that hold no copy of an item."""
    leaked = stored(matches(docs, bench, score).select("doc_id").distinct())
    return docs.join(leaked, "doc_id", "left_anti").select(docs.columns)
