"""Substring dedup by repeated-phrase automata.

1. Every document of ``window`` words or more names its anchors: the minimum-hash
   phrase of ``PHRASE`` words of each window. Equal windows have equal anchors.
2. Anchors named by two documents recur. Their words are fetched in a second pass, for anchors
   whose bit is set in a field of ``FIELD`` bits, and confirmed: one row a phrase, however often it occurs.
3. The confirmed phrases are compiled into Aho-Corasick automata over letters of word hashes, and all documents
   are streamed through them. Windows whose anchor is located give fingerprints. What fits one small automaton
   is sent to all tasks, map-side. More are dealt to shards of at most some ``PHRASES`` by anchor hash; the anchors of every document,
   as letters, go to the shard that alone could hold them, in one pass. What is located there sets bits in a field of
   ``FIELD`` bits, by which a second pass finds the windows again: two passes, however many shards. No text moves.
4. The smallest document of each fingerprint is found by one shuffle of fingerprints; windows of larger documents
   that share it are removed. Only the texts of documents whose doc_id has its
   bit set in a field of those that lose words are shuffled, once, to meet their windows.

Copies of a whole text are folded beforehand and lose all words if they have a window.
Fingerprints are 96 bits of the word bytes. Two phrases with one anchor hash are both compiled.

Null texts have no words. Rows with one doc_id never remove each other's words; each row
gets its own result, equal rows equal ones. Rows with a null doc_id remove and lose nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import WORD_POWERS, U, Words, lists, mix, release, signed, span_hashes, stored, text_steps

WINDOW = 50
PHRASE = 16
#: Phrases of one automaton, and bits of the field of recurring anchors.
PHRASES = 1 << 17
FIELD = 1 << 26
#: Parts that the field is gathered in.
PARTS = 64
#: Least number of shards that phrases are dealt to, for the sake of many tasks.
SHARDS = 64


def anchors(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First word and document of each window, and word and hash of its anchor, the leftmost minimum."""
    begin, _, doc = words.windows(window)
    n = len(words) - PHRASE + 1
    if not len(begin):
        return begin, doc, begin, np.zeros(0, np.uint64)
    at = np.arange(n)
    low = span_hashes(words.hashes(), at, at + PHRASE, WORD_POWERS)
    span, width = window - PHRASE + 1, 1

    def join(low: np.ndarray, at: np.ndarray, by: int) -> tuple[np.ndarray, np.ndarray]:
        right = low[by:] < low[:-by]
        return np.where(right, low[by:], low[:-by]), np.where(right, at[by:], at[:-by])

    while width * 2 <= span:
        low, at = join(low, at, width)
        width *= 2
    if span > width:
        low, at = join(low, at, span - width)
    return begin, doc, at[begin], low[begin]


def digest(words: Words, seed: int = 0) -> np.ndarray:
    return signed(span_hashes(words.hashes(seed), words.first[:-1], words.first[1:], WORD_POWERS))


def marks(docs: DataFrame, window: int) -> DataFrame:
    """doc_id, hash of the text, digest of the word sequence, and its distinct anchors; documents with a window only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, bounds in text_steps(batches):
            words = Words(data, bounds)
            _, doc, word, low = anchors(words, window)
            new = np.ones(len(word), bool)
            new[1:] = word[1:] != word[:-1]
            per = np.bincount(doc[new], minlength=len(bounds) - 1)
            long = pa.array(np.flatnonzero(words.count >= window))
            yield pa.record_batch([
                batch.column("doc_id").take(long), batch.column("hash").take(long), pa.array(digest(words)).take(long),
                pa.array(digest(words, 1)).take(long), lists(signed(low[new]), per, pa.int64()).take(long),
            ], ["doc_id", "hash", "d0", "d1", "phrases"])

    return docs.mapInArrow(run, "doc_id bigint, hash bigint, d0 bigint, d1 bigint, phrases array<bigint>")


def _place(h: np.ndarray) -> np.ndarray:
    return (h % U(PARTS) * U(FIELD // PARTS) + mix(h) % U(FIELD // PARTS)).astype(np.int64)


def field_of(keys: DataFrame) -> np.ndarray:
    """The field with the bits of all values of ``key``, gathered in ``PARTS`` parts of fixed size."""
    size = FIELD // PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, part = np.zeros(size, np.uint8), None
        for batch in batches:
            if batch.num_rows:
                at = _place(batch.column("key").to_numpy().view(np.uint64))
                part = int(at[0]) // size
                bits[at - part * size] = 1
        if part is not None:
            yield pa.record_batch([pa.array([part]), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], ["part", "bits"])

    field = np.zeros(FIELD // 8, np.uint8)
    part = F.pmod("key", F.lit(PARTS)).cast("int")
    for r in keys.repartitionById(PARTS, part).mapInArrow(run, "part bigint, bits binary").collect():
        field[r["part"] * size // 8 : (r["part"] + 1) * size // 8] = np.frombuffer(r["bits"], np.uint8)
    return field


def is_set(field: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = _place(h)
    return (field[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def sent_field(rows: DataFrame, key: str) -> Broadcast:
    return rows.sparkSession.sparkContext.broadcast(field_of(rows.select(F.col(key).alias("key"))))


def letters_of(words: Words) -> np.ndarray:
    """Two letters of six bits for each word. Small alphabets keep an automaton's nodes narrow; what
    words share letters by chance is told apart by the fingerprints."""
    h = words.hashes()
    return np.column_stack([h >> U(40) & U(63), h >> U(50) & U(63)]).astype(np.uint8)


def confirmed(docs: DataFrame, recurring: DataFrame, window: int, sent: Broadcast | None = None) -> DataFrame:
    """(phrase, letters): the distinct word sequences of recurring anchors; ``sent`` is their field, if it is there already."""
    sent = sent or sent_field(recurring, "phrase")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, bounds in text_steps(batches):
            words = Words(data, bounds)
            _, _, word, low = anchors(words, window)
            if not len(word):
                continue
            new = np.ones(len(word), bool)
            new[1:] = word[1:] != word[:-1]
            word, low = word[new], low[new]
            hit = np.flatnonzero(is_set(sent.value, low))
            low, one = np.unique(low[hit], return_index=True)
            letters = letters_of(words)[word[hit][one][:, None] + np.arange(PHRASE)]
            yield pa.record_batch([pa.array(signed(low)), pa.array([x.tobytes() for x in letters], pa.binary())], ["phrase", "letters"])

    found = docs.mapInArrow(run, "phrase bigint, letters binary")
    return found.join(recurring, "phrase", "left_semi").distinct()


def compiled(phrases: list[bytes]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for phrase in phrases:
        out.add_word(phrase.decode("latin-1"))
    out.make_automaton()
    return out


#: Automata of this worker process: the last one only.
_compiled: dict[str, ahocorasick.Automaton] = {}


def automaton(name: str, phrases: list[bytes]) -> ahocorasick.Automaton:
    """The automaton of all phrases, compiled once a worker."""
    if name not in _compiled:
        _compiled.clear()
        _compiled[name] = compiled(phrases)
    return _compiled[name]


def locate(found: ahocorasick.Automaton, letters: np.ndarray) -> np.ndarray:
    """Whether a phrase of the automaton starts at a word."""
    per = letters.shape[1]
    out = np.zeros(len(letters), bool)
    if not len(found):
        return out
    at = np.array([end - length + 1 for end, length in found.iter(letters.tobytes().decode("latin-1"))], np.int64)
    out[at[at % per == 0] // per] = True
    return out


def windows_at(docs: DataFrame, window: int, chosen: Callable[[pa.RecordBatch, Words, np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """Runs of windows whose anchor is ``chosen`` by batch, words, and the windows' documents, anchor words and hashes:
    doc_id, hash, first window and the fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, bounds in text_steps(batches):
            words = Words(data, bounds)
            begin, doc, word, low = anchors(words, window)
            if not len(begin):
                continue
            take = np.flatnonzero(chosen(batch, words, doc, word, low))
            if not len(take):
                continue
            begin, doc = begin[take], doc[take]
            new = np.ones(len(begin), bool)
            new[1:] = (begin[1:] != begin[:-1] + 1) | (doc[1:] != doc[:-1])
            at = np.flatnonzero(new)
            size = np.diff(np.append(at, len(begin)))
            rows = pa.array(doc[at])
            yield pa.record_batch([
                batch.column("doc_id").take(rows), batch.column("hash").take(rows), pa.array((begin[at] - words.first[doc[at]]).astype(np.int32)),
                lists(signed(span_hashes(words.hashes(), begin, begin + window, WORD_POWERS)), size, pa.int64()),
                lists((span_hashes(words.hashes(1), begin, begin + window, WORD_POWERS) >> U(32)).astype(np.uint32).view(np.int32), size, pa.int32()),
            ], ["doc_id", "hash", "at", "w0", "w1"])

    return docs.mapInArrow(run, "doc_id bigint, hash bigint, at int, w0 array<bigint>, w1 array<int>")


def located(docs: DataFrame, name: str, phrases: list[bytes], window: int) -> DataFrame:
    """Runs of windows whose anchor the one automaton of all ``phrases`` locates."""
    sent = docs.sparkSession.sparkContext.broadcast(phrases)
    return windows_at(docs, window, lambda batch, words, doc, word, low: locate(automaton(name, sent.value), letters_of(words))[word])


def place_of(doc_id: np.ndarray, text: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Key of a word of a document, by its number from the document's first."""
    return mix(mix(doc_id.view(U)) ^ text.view(U)) + word.astype(U)


def dealt_anchors(docs: DataFrame, shards: int, window: int) -> DataFrame:
    """The anchors of all documents, a row for each shard and step of text: their places, and their letters in one string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, bounds in text_steps(batches):
            words = Words(data, bounds)
            _, doc, word, low = anchors(words, window)
            if not len(word):
                continue
            new = np.ones(len(word), bool)
            new[1:] = word[1:] != word[:-1]
            doc, word, shard = doc[new], word[new], signed(low[new]) % shards
            order = np.argsort(shard, kind="stable")
            doc, word = doc[order], word[order]
            own, size = np.unique(shard, return_counts=True)
            letters = np.ascontiguousarray(letters_of(words)[word[:, None] + np.arange(PHRASE)])
            end = np.cumsum(size)
            place = place_of(batch.column("doc_id").to_numpy()[doc], batch.column("hash").to_numpy()[doc], word - words.first[doc])
            yield pa.record_batch([
                pa.array(own), lists(signed(place), size, pa.int64()),
                pa.array([letters[e - n : e].tobytes() for e, n in zip(end.tolist(), size.tolist(), strict=True)], pa.binary()),
            ], ["shard", "places", "letters"])

    return docs.mapInArrow(run, "shard bigint, places array<bigint>, letters binary")


def located_in_shards(docs: DataFrame, phrase: DataFrame, recurring: Broadcast, shards: int, window: int) -> DataFrame:
    """Runs of windows whose anchor the automaton of its shard locates. A shard is the work of one task, which holds
    its automaton and a batch of what is streamed through it. Bits that are set by chance add windows, never a wrong
    one; a window is added only where the field of ``recurring`` anchors errs too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, phrases, own = None, [], None
        for batch in batches:
            for shard, places, letters in zip(*(batch.column(c) for c in ("shard", "places", "letters")), strict=True):
                if shard.as_py() != now:
                    now, phrases, own = shard.as_py(), [], None
                if not places.is_valid:
                    phrases.append(letters.as_py())
                    continue
                if own is None and phrases:
                    own, phrases = compiled(phrases), []
                if own is not None:
                    text = np.frombuffer(letters.as_buffer(), np.uint8).reshape(len(places) * PHRASE, -1)
                    yield pa.record_batch([places.values.filter(pa.array(locate(own, text)[::PHRASE]))], ["key"])

    rows = phrase.select(
        F.pmod("phrase", F.lit(shards)).alias("shard"), F.lit(None).cast("array<bigint>").alias("places"), "letters",
    ).unionAll(dealt_anchors(docs, shards, window))
    keys = rows.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard", F.isnotnull("places")).mapInArrow(run, "key bigint")
    sent = sent_field(stored(keys), "key")

    def chosen(batch: pa.RecordBatch, words: Words, doc: np.ndarray, word: np.ndarray, low: np.ndarray) -> np.ndarray:
        out = is_set(recurring.value, low)
        doc, word = doc[out], word[out]
        doc_id, text = (batch.column(c).to_numpy()[doc] for c in ("doc_id", "hash"))
        out[out] = is_set(sent.value, place_of(doc_id, text, word - words.first[doc]))
        return out

    return windows_at(docs, window, chosen)


def repeats(docs: DataFrame, window: int = WINDOW, phrases: int = PHRASES) -> DataFrame:
    """Words to remove, as (doc_id, hash, spans) with the text's hash; ``to`` null is the end of the text."""
    own = docs.where("doc_id is not null").select("doc_id", "text", F.xxhash64("text").alias("hash"))
    mark = stored(marks(own, window))
    copies = mark.groupBy("d0", "d1").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    folded = stored(
        mark.select("doc_id", "hash", "d0", "d1").join(copies.select("d0", "d1", "least"), ["d0", "d1"])
        .where("doc_id > least").select("doc_id", "hash").distinct()
    )
    recurring = stored(
        mark.join(folded, ["doc_id", "hash"], "left_anti").select("doc_id", F.explode("phrases").alias("phrase"))
        .groupBy("phrase").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("phrase")
    )
    sent = sent_field(recurring, "phrase")
    phrase = stored(confirmed(own, recurring, window, sent))
    n = phrase.count()
    if n > phrases // SHARDS:
        found = located_in_shards(own, phrase, sent, max(-(-n // phrases), SHARDS), window)
    else:
        found = located(own, uuid.uuid4().hex, [bytes(r["letters"]) for r in phrase.select("letters").distinct().collect()], window)
    found = stored(found)
    each = found.join(folded, ["doc_id", "hash"], "left_anti").select(
        "doc_id", "hash", "at", F.posexplode(F.arrays_zip("w0", "w1")).alias("k", "w")).select(
        "doc_id", "hash", (F.col("at") + F.col("k")).alias("at"), "w.w0", "w.w1")
    shared = each.groupBy("w0", "w1").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("w0", "w1", "least")
    gone = each.join(shared, ["w0", "w1"]).where("doc_id > least")
    # A document's windows, in order; the words that they cover are found where the text is.
    spans = gone.groupBy("doc_id", "hash").agg(F.sort_array(F.collect_list("at")).alias("at"))
    return folded.withColumn("at", F.lit(None).cast("array<int>")).withColumn("whole", F.lit(True)).unionAll(spans.withColumn("whole", F.lit(False)))


def removal(docs: DataFrame, columns: tuple[str, ...] = ("doc_id",), window: int = WINDOW, phrases: int = PHRASES) -> DataFrame:
    """Per row: the named columns, n_words, n_removed and kept_text (kept words joined by one space)."""
    names = list(dict.fromkeys(columns))
    gone = stored(repeats(docs, window, phrases)).select(
        F.col("doc_id").alias("_id"), F.col("hash").alias("_hash"), F.col("at").alias("_at"), F.col("whole").alias("_whole"))
    release(docs.sparkSession)  # the shuffles of fingerprints are over before the texts meet their spans
    source = docs.select(*dict.fromkeys([*names, "doc_id", "text"]))
    sent = sent_field(gone.select(F.xxhash64("_id").alias("key")), "key")
    plain = source.columns
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema]

    def kept(batch: pa.RecordBatch, data: np.ndarray, bounds: np.ndarray, at: np.ndarray, size: np.ndarray, whole: np.ndarray) -> pa.RecordBatch:
        """Rows without the words of their windows (``at``, ``size`` of them a row), or of whole texts."""
        words = Words(data, bounds)
        cover = np.zeros(len(words) + 1, np.int64)
        start = at + np.repeat(words.first[:-1], size)
        np.add.at(cover, start, 1)
        np.add.at(cover, start + window, -1)
        np.add.at(cover, words.first[whole], 1)
        np.add.at(cover, words.first[whole + 1], -1)
        gone = np.cumsum(cover)[:-1] > 0
        raw = data.tobytes()
        texts, removed = [], []
        for a, b in zip(words.first[:-1], words.first[1:], strict=True):
            keep = np.flatnonzero(~gone[a:b]) + a
            texts.append(b" ".join(raw[s:e] for s, e in zip(words.start[keep].tolist(), words.end[keep].tolist(), strict=True)))
            removed.append(int(b - a - len(keep)))
        return pa.record_batch(
            [*(batch.column(c) for c in names), pa.array(words.count.astype(np.int64)), pa.array(removed, pa.int64()),
             pa.array(texts, pa.binary()).cast(pa.string())], [*names, "n_words", "n_removed", "kept_text"])

    def may_lose(batch: pa.RecordBatch) -> np.ndarray:
        return is_set(sent.value, batch.column("_key").to_numpy().view(np.uint64)) & batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, bounds in text_steps(b.filter(pa.array(~may_lose(b))) for b in batches):
            yield kept(batch, data, bounds, np.zeros(0, np.int64), np.zeros(len(bounds) - 1, np.int64), np.zeros(0, np.int64))

    def losers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(may_lose(batch))).select(plain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, bounds in text_steps(batches):
            at = batch.column("_at")
            whole = np.flatnonzero(batch.column("_whole").fill_null(False).to_numpy(zero_copy_only=False))
            yield kept(batch, data, bounds, at.flatten().to_numpy(), at.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), whole)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*names).schema), "n_words bigint, n_removed bigint, kept_text string"])
    keyed = source.withColumn("_key", F.xxhash64("doc_id"))
    affected = keyed.mapInArrow(losers, ", ".join(fields))
    joined = affected.join(gone, (F.col("doc_id") == F.col("_id")) & (F.xxhash64("text") == F.col("_hash")), "left").drop("_id", "_hash")
    return keyed.mapInArrow(others, schema).unionAll(joined.mapInArrow(run, schema))
