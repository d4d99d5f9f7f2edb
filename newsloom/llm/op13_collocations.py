"""Phrase collocations, candidates found by mergeable Misra-Gries summaries.

1. Every document names its phrases of one to ``LONGEST`` words as 64-bit hashes, counted per
   ``COMBINE`` phrases before they leave a task. Hashes are dealt to hash partitions; a partition
   holds one Misra-Gries summary. Its capacity exceeds the partition's mass over ``LEAST``, so
   what it takes off every counter (``off``) stays below ``LEAST`` and every phrase of ``LEAST``
   occurrences is left with a counter of ``LEAST - off`` or more. The masses come first in
   the partition's order, so the capacity is known before the first phrase.
2. The survivors of a partition become its part of a bit field of ``FIELD`` bits. A second pass over all
   documents sends the phrases whose bit is set, as text, and Spark counts them exactly by text.
   Hash collisions and strays of the field cost work, never a count.

Phrases stay inside pieces: texts are split at ``.,;:!?`` and at the breaks \\x0A-\\x0D, pieces at
spaces and tabs. A-Z are lower-cased. Counts are per language; a null language is ``und``.
Null texts are empty. Repeated rows count each time; doc_id plays no part. An empty table
gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.common import BYTE_POWERS, STEP, U, column_bytes, mix, signed, span_hashes, stored, text_steps

LEAST = 10
LONGEST = 3
#: A candidate inside a longer one goes if that has this share (percent) of its occurrences.
HELD = 50
TOP = 2000
#: Text bytes whose phrases make one hash partition.
PART_BYTES = 16 << 20
#: Bits of the field of survivors, over all partitions; each has 64 at least.
FIELD = 1 << 27
#: Phrases that a task counts before it passes them on.
COMBINE = 4 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BREAKS = np.zeros(256, bool)
BREAKS[[*b".,;:!?", 10, 11, 12, 13]] = True
ENDS = BREAKS.copy()
ENDS[[9, 32]] = True


class Pieces:
    """Words of a run of documents, their languages, and how many words of the piece follow each."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, lang: pa.Array):
        self.data = LOWER[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[bounds] = True
        inside = ~ENDS[self.data]
        before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        self.start = np.flatnonzero(inside & (~before | edge[:-1]))
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        #: Words of document d are ``first[d]`` to ``first[d + 1]``.
        self.first = np.searchsorted(self.start, bounds)
        breaks = np.cumsum(BREAKS[self.data])
        piece = breaks[self.start] if len(self.start) else np.zeros(0, np.int64)
        new = np.ones(len(piece) + 1, bool)
        new[1:-1] = piece[1:] != piece[:-1]
        new[self.first] = True
        cut = np.flatnonzero(new)
        self.left = np.repeat(cut[1:], np.diff(cut)) - np.arange(len(piece))
        codes = lang.dictionary_encode()
        self.lang = codes.indices.to_numpy(zero_copy_only=False)
        self.langs = codes.dictionary
        self.doc = np.repeat(np.arange(len(bounds) - 1), np.diff(self.first))

    def hashes(self, longest: int, seed: int = 0) -> list[np.ndarray]:
        """For n = 1 to ``longest``: the hashes of the phrases of n words, in order of their first word."""
        table = mix((np.arange(256, dtype=np.uint64) + U(1 + 256 * seed)) * STEP)
        word = span_hashes(table[self.data], self.start, self.end, BYTE_POWERS)
        raw, bounds = column_bytes(self.langs)
        own = span_hashes(table[raw], bounds[:-1], bounds[1:], BYTE_POWERS)
        run = mix(word + mix(own)[self.lang[self.doc]]) if len(word) else word
        out = [run]
        for n in range(1, longest):
            run = mix(run[: len(word) - n] + STEP) + word[n:]
            out.append(run)
        return [mix(x)[self.left[: len(x)] > n] for n, x in enumerate(out)]

    def phrases(self, words: np.ndarray, n: np.ndarray) -> pa.Array:
        """The text of each phrase of ``n`` words from a word on, joined by single spaces."""
        size = self.end - self.start
        at = np.append(0, np.cumsum(size + 1))
        spaced = np.full(at[-1], 32, np.uint8)
        spaced[np.repeat(at[:-1] - self.start, size) + self._bytes()] = self.data[self._bytes()]
        begin, length = at[words], at[words + n] - at[words] - 1
        to = np.append(0, np.cumsum(length))
        raw = spaced[np.arange(to[-1]) + np.repeat(begin - to[:-1], length)]
        return pa.LargeStringArray.from_buffers(len(words), pa.py_buffer(to.astype(np.int64)), pa.py_buffer(raw)).cast(pa.string())

    def _bytes(self) -> np.ndarray:
        """Places of all bytes of words."""
        size = self.end - self.start
        return np.arange(size.sum()) + np.repeat(self.start - np.cumsum(size) + size, size)


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[Pieces]:
    for batch, data, bounds in text_steps(batches):
        yield Pieces(data, bounds, batch.column("lang"))


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    """The hash partition of signed hashes."""
    return h % parts


def dealt(docs: DataFrame, parts: int, longest: int) -> DataFrame:
    """(h, n): counted phrases, dealt to their hash partitions; a row of n below zero is a mass of partition h."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        mass = np.zeros(parts, np.int64)

        def flush() -> pa.RecordBatch:
            h, n = np.unique(signed(np.concatenate(held)), return_counts=True)
            np.add.at(mass, part_of(h, parts), n)
            return pa.record_batch([pa.array(h), pa.array(n.astype(np.int64))], ["h", "n"])

        for text in pieces(batches):
            held += text.hashes(longest)
            size += sum(map(len, held[-longest:]))
            if size >= COMBINE:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()
        own = np.flatnonzero(mass)
        yield pa.record_batch([pa.array(own.astype(np.int64)), pa.array(-mass[own])], ["h", "n"])

    part = F.when(F.col("n") < 0, F.col("h")).otherwise(F.pmod("h", F.lit(parts))).cast("int")
    return docs.mapInArrow(run, "h bigint, n bigint").repartitionById(parts, part)


class Summary:
    """A Misra-Gries summary: at most ``capacity`` counters; a phrase is undercounted by ``off`` at most."""

    def __init__(self, capacity: int):
        self.capacity, self.off = capacity, 0
        self.keys, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def merge(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Adds counted keys, each given once or often, as another summary's would be."""
        keys, counts = np.concatenate([self.keys, keys]), np.concatenate([self.counts, counts])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        keys, counts = keys[at], np.add.reduceat(counts, at) if len(at) else counts
        if len(keys) > self.capacity:
            k = len(keys) - self.capacity - 1
            least = int(np.partition(counts, k)[k])
            self.off += least
            keep = counts > least
            keys, counts = keys[keep], counts[keep] - least
        self.keys, self.counts = keys, counts

    def survivors(self, least: int) -> np.ndarray:
        return self.keys[self.counts >= least - self.off]


def field_size(parts: int, bits: int = FIELD) -> int:
    """Bits of one partition's part of the field: a multiple of 64."""
    return max(64, bits // parts // 64 * 64)


def field_bits(h: np.ndarray, parts: int, size: int) -> np.ndarray:
    """Places of signed hashes in the field."""
    return part_of(h, parts) * size + (mix(h.view(np.uint64)) % U(size)).astype(np.int64)


def summaries(rows: DataFrame, parts: int, least: int, size: int) -> DataFrame:
    """(part, bits, off, n_survivors) of each hash partition; its masses come before its phrases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, mass, summary = 0, 0, None
        keys, counts, held = [], [], 0
        for batch in batches:
            h, n = batch.column("h").to_numpy(), batch.column("n").to_numpy()
            first = int((n < 0).sum())
            if first:
                part, mass = int(h[0]), mass - int(n[:first].sum())
            if first == len(n):
                continue
            summary = summary or Summary(mass // least + 1)
            keys.append(h[first:])
            counts.append(n[first:])
            held += len(n) - first
            if held >= max(summary.capacity, 1 << 18):
                summary.merge(np.concatenate(keys), np.concatenate(counts))
                keys, counts, held = [], [], 0
        if summary is None:
            return
        if keys:
            summary.merge(np.concatenate(keys), np.concatenate(counts))
        last = summary.survivors(least)
        own = np.zeros(size, np.uint8)
        own[field_bits(last, parts, size) - part * size] = 1
        yield pa.record_batch([
            pa.array([part], pa.int64()), pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary()),
            pa.array([summary.off], pa.int64()), pa.array([len(last)], pa.int64()),
        ], ["part", "bits", "off", "n_survivors"])

    return rows.sortWithinPartitions(F.col("n") >= 0).mapInArrow(run, "part bigint, bits binary, off bigint, n_survivors bigint")


def exact_counts(docs: DataFrame, field: np.ndarray, parts: int, size: int, longest: int, least: int) -> DataFrame:
    """lang, words, phrase and a (exact) of every phrase of ``least`` occurrences, by its text.

    The row of no words holds the number of all words of a language.
    """
    sent = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        names = ["lang", "words", "phrase", "a"]
        for text in pieces(batches):
            total = np.bincount(text.lang[text.doc], minlength=len(text.langs)).astype(np.int64)
            none = np.zeros(len(total), np.int32)
            yield pa.record_batch([text.langs, pa.array(none), pa.array([""] * len(total), pa.string()), pa.array(total)], names)
            first = text.hashes(longest)
            second = text.hashes(longest, 1)
            word, length, key = [], [], []
            for n, (x, y) in enumerate(zip(first, second, strict=True), 1):
                place = field_bits(signed(x), parts, size)
                hit = np.flatnonzero(known[place >> 3] >> (place & 7).astype(np.uint8) & 1)
                word.append(np.flatnonzero(text.left >= n)[hit])
                length.append(np.full(len(hit), n))
                key.append(np.column_stack([x[hit], y[hit]]))
            word, length, key = np.concatenate(word), np.concatenate(length), np.concatenate(key)
            if not len(word):
                continue
            order = np.argsort(key[:, 0], kind="stable")
            key = key[order]
            at = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(axis=1)))
            one = order[at]
            yield pa.record_batch([
                text.langs.take(pa.array(text.lang[text.doc[word[one]]])), pa.array(length[one].astype(np.int32)),
                text.phrases(word[one], length[one]), pa.array(np.diff(np.append(at, len(key))).astype(np.int64)),
            ], names)

    found = docs.mapInArrow(run, "lang string, words int, phrase string, a bigint")
    return found.groupBy("lang", "words", "phrase").agg(F.sum("a").alias("a")).where(F.col("a") >= least)


def frequent(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, part_bytes: int = PART_BYTES) -> DataFrame:
    """lang, words (1 to ``longest``), phrase and a of all phrases with ``least`` occurrences or more;
    with no words, a language's number of words."""
    own = docs.select("text", F.coalesce("lang", F.lit("und")).alias("lang"))
    bytes_ = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-bytes_ // part_bytes))
    size = field_size(parts)
    field = np.zeros(parts * size // 8, np.uint8)
    for r in summaries(dealt(own, parts, longest), parts, least, size).select("part", "bits").collect():  # the field, in parts
        field[r["part"] * size // 8 : (r["part"] + 1) * size // 8] = np.frombuffer(r["bits"], np.uint8)
    return exact_counts(own, field, parts, size, longest, least)


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, held: int = HELD, top: int = TOP, part_bytes: int = PART_BYTES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score: the first ``top`` phrases of each language.

    A phrase is cut behind each of its words but the last; l and r count both sides, and the cut
    with the least floor(1000000 a a / (l r)) holds, the leftmost of equal ones.
    """
    counts = stored(frequent(docs, least, longest, part_bytes))
    many = counts.where("words > 1").select("lang", "phrase", "words", "a", F.split("phrase", " ").alias("w"))
    part = counts.select(F.col("lang").alias("_lang"), F.col("phrase").alias("_phrase"), F.col("a").alias("_n"))

    def span(at: Column, n: Column) -> Column:
        return F.array_join(F.slice("w", at, n), " ")

    def side(name: str, count: str) -> tuple[DataFrame, Column]:
        return part.withColumnRenamed("_n", count), (F.col("lang") == F.col("_lang")) & (F.col(name) == F.col("_phrase"))

    # A side occurs at least as often as its phrase, so it has been counted.
    cut = many.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", span(F.lit(1), F.col("k")).alias("head"), span(F.col("k") + 1, F.col("words") - F.col("k")).alias("tail"))
    sides = cut.join(*side("head", "l")).drop("_lang", "_phrase").join(*side("tail", "r")).drop("_lang", "_phrase")
    # 38 digits: exact up to 10^15 occurrences.
    score = F.expr("cast(1000000 as decimal(38,0)) * a * a div (cast(l as decimal(38,0)) * r)")
    scored = (
        sides.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "k", "a", "l", "r")).alias("x"))
        .select("lang", "phrase", "x.a", "x.l", "x.r", "x.score")
    )
    shorter = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda n: F.transform(
        F.sequence(F.lit(1), F.col("words") - n + 1), lambda i: span(i, n))))
    inside = (
        many.where("words > 2").select("lang", "a", F.explode(shorter).alias("phrase"))
        .groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    )
    kept = scored.join(inside, ["lang", "phrase"], "left").where((F.col("longer").isNull()) | (100 * F.col("longer") < held * F.col("a")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    first = kept.withColumn("rank", rank).where(F.col("rank") <= top)
    total = counts.where("words = 0").select("lang", F.col("a").alias("n"))
    return first.join(total, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
