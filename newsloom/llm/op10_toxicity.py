"""Toxicity by compression distance with zstandard dictionaries.

A text is cut into windows of about ``WINDOW`` bytes. Each window is compressed with
an ordinary and a toxic dictionary; the gain is the difference of the two lengths. A
document's gains (largest, mean of the three largest, mean, sum over root of count)
meet a logistic threshold that is fitted on labelled documents the dictionaries
have not seen.

The ordinary dictionary is what zstandard's trainer makes of ordinary windows. The
toxic dictionary holds the words of toxic windows that ordinary text does not have,
commonest first, before that same ordinary content, so that common language costs
the same under both. A word is taken if its byte n-grams occur in many different
contexts of toxic windows and rarely in ordinary ones; copies of one text are one context.

Only training is bounded: ``MAX_TOXIC`` and ``MAX_ORDINARY`` labelled documents and
``MAX_WINDOWS`` windows of each class, drawn by hash. Every text is scored whole.

Null and empty texts have one blank window. Without labelled rows of both classes all
scores are 0. Repeated rows get equal scores; labels that are null do not count.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import crc_mod, mix, stored

WINDOW = 56
MAX_TOXIC, MAX_ORDINARY = 4000, 6000
MAX_WINDOWS = {1: 50_000, 0: 120_000}
GRAM = 6
TOXIC_BYTES, BASE_BYTES = 2048, 8192
#: Cost of a toxic text that passes, in ordinary texts that are rejected.
MISSED = 3.0


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    centre: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]


def windows(text: str | None, size: int = WINDOW) -> list[bytes]:
    """Runs of whole words of about ``size`` bytes; the last word of one begins the next.

    Every word is in a window. A short last run starts earlier, with words of the window
    before it, so that it has full size.
    """
    out, run, n, before = [], [], 0, []
    for word in (text or "").lower().encode().split():
        for at in range(0, len(word), 2 * size) if len(word) > 2 * size else (0,):
            part = word[at : at + 2 * size]
            run.append(part)
            n += len(part) + 1
            if n >= size:
                out.append(b" " + b" ".join(run) + b" ")
                run, n, before = [part], len(part) + 1, run[:-1]
    if len(run) > 1 or not out:
        full = size if n <= size // 3 else 0
        while n < full and before:
            run.insert(0, before.pop())
            n += len(run[0]) + 1
        out.append(b" " + b" ".join(run) + b" ")
    return out


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters(
        window_log=14, hash_log=12, chain_log=12, search_log=4, min_match=4, target_length=16,
        strategy=zstandard.STRATEGY_LAZY2, write_checksum=0, write_content_size=0, write_dict_id=0,
    )
    words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    words.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=words, compression_params=params)


def gains(text: str | None, ordinary: zstandard.ZstdCompressor, toxic: zstandard.ZstdCompressor) -> tuple[float, ...]:
    plain, marked = ordinary.compress, toxic.compress
    g = np.array([len(plain(w)) - len(marked(w)) for w in windows(text)], np.float64)
    top = np.sort(g)[-3:]
    return float(top[-1]), float(top.mean()), float(g.mean()), float(g.sum() / np.sqrt(len(g)))


def _grams(found: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows joined, the n-gram code at each byte, and where an n-gram lies in one window."""
    joined = np.frombuffer(b"".join(found), np.uint8)
    n = max(len(joined) - GRAM + 1, 0)
    code = np.zeros(n, np.int64)
    for i in range(GRAM):
        code <<= 8
        code |= joined[i : i + n]
    fits = np.ones(len(joined), bool)
    ends = np.cumsum([len(w) for w in found])
    for i in range(1, GRAM):
        fits[np.maximum(ends - i, 0)] = False
    return joined, code, fits[:n]


def _isin(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _contexts(found: list[bytes], among: np.ndarray | None = None, step: int = 10_000) -> tuple[np.ndarray, np.ndarray]:
    """In how many contexts, the four bytes before it, each n-gram (of those in ``among``) occurs."""
    keys, codes = [], []
    for k in range(0, len(found), step):
        _, code, fits = _grams(found[k : k + step])
        at = np.flatnonzero(fits if among is None else fits & _isin(code, among))
        lead = np.where(at >= 4, code[np.maximum(at - 4, 0)] >> (8 * (GRAM - 4)), 0)
        key, first = np.unique(mix(mix(code[at].view(np.uint64)) ^ lead.view(np.uint64)), return_index=True)
        keys.append(key)
        codes.append(code[at[first]])
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, first = np.unique(np.concatenate(keys), return_index=True)
    return np.unique(np.concatenate(codes)[first], return_counts=True)


def distinctive_words(toxic: list[bytes], ordinary: list[bytes], ratio: float = 6.0) -> Counter:
    """Words around byte n-grams whose contexts are many in toxic and few in ordinary windows."""
    least = max(4, len(toxic) // 5000)
    code_t, n_t = _contexts(toxic)
    code_t, n_t = code_t[n_t >= least], n_t[n_t >= least]
    if not len(code_t):
        return Counter()
    code_o, n_o = _contexts(ordinary, code_t)
    expected = np.zeros(len(code_t))
    expected[np.searchsorted(code_t, code_o)] = n_o * len(toxic) / len(ordinary)
    marked = code_t[n_t > ratio * (expected + 1)]
    joined, code, fits = _grams(toxic)
    hit = np.zeros(len(joined) + 2, np.int8)
    at = np.flatnonzero(fits & _isin(code, marked))
    for i in range(GRAM):
        hit[at + 1 + i] = 1
    edge = np.diff(hit)
    blanks = np.flatnonzero(joined == 32)
    words: Counter = Counter()
    for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
        left = blanks[max(np.searchsorted(blanks, a, "right") - 1, 0)]
        right = blanks[min(np.searchsorted(blanks, b - 1), len(blanks) - 1)]
        words[joined[left : right + 1].tobytes().strip(b" .,;:!?")] += 1
    return words


def dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> tuple[bytes, bytes]:
    """Toxic and ordinary dictionary content from windows of each class."""
    toxic, ordinary = sorted(set(toxic)), sorted(set(ordinary))
    try:
        base = zstandard.train_dictionary(BASE_BYTES, ordinary[:: max(1, len(ordinary) // 60_000)], k=32, d=6, level=9).as_bytes()
    except zstandard.ZstdError:  # too few windows to train on
        base = b"".join(ordinary)[:BASE_BYTES]
    own = b""
    for word, _ in sorted(distinctive_words(toxic, ordinary).items(), key=lambda x: (-x[1], x[0])):
        if len(own) + len(word) + 1 > TOXIC_BYTES:
            break
        own += b" " + word
    return own + base, base


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weighted ridge logistic regression by Newton steps; the last weight is the intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    weight = weight / weight.sum()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w -= np.linalg.solve(hess, x.T @ (weight * (p - y)) + ridge * w)
    return w


def labelled_sample(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[int, float]]:
    """Texts of a bounded sample of labelled documents (y, fold, text), and rows for each drawn one."""
    known = labels.where("toxic in (0, 1) and doc_id is not null").where(crc_mod("doc_id", 5) != 0).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    known = stored(known)
    count = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    drawn = None
    for y, most in ((1, MAX_TOXIC), (0, MAX_ORDINARY)):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        drawn = part if drawn is None else drawn.unionAll(part)
    # At most MAX_TOXIC + MAX_ORDINARY pairs of numbers: their size is bounded.
    texts = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    each = {y: n / min(n, most) for y, n, most in ((1, count.get(1, 0), MAX_TOXIC), (0, count.get(0, 0), MAX_ORDINARY)) if n}
    return stored(texts.select("y", crc_mod("doc_id", 5).alias("fold"), "text")), each


def _sampled_windows(sample: DataFrame) -> dict[int, list[bytes]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for y, text in zip(batch.column("y").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = windows(text)
                yield pa.record_batch([pa.array([y] * len(found), pa.int32()), pa.array(found, pa.binary())], ["y", "w"])

    cut = stored(sample.where("fold <> 4").select("y", "text").mapInArrow(run, "y int, w binary").distinct())
    n = {r["y"]: r["n"] for r in cut.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = {y: min(1.0, MAX_WINDOWS[y] / n[y]) for y in n}
    out: dict[int, list[bytes]] = {0: [], 1: []}
    for y in n:
        bound = int(share[y] * 2**31)
        rows = cut.where((F.col("y") == y) & (F.pmod(F.xxhash64("w"), F.lit(2**31)) < bound)).select("w")
        out[y] = rows.toArrow().column("w").to_pylist()
    return out


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Dictionaries and threshold from labelled documents whose crc32(doc_id) mod 5 is not 0."""
    sample, each = labelled_sample(docs, labels)
    if len(each) < 2:
        return None
    found = _sampled_windows(sample)
    if not found[0] or not found[1]:
        return None
    toxic, ordinary = dictionaries(found[1], found[0])
    rows = sample.where("fold = 4")
    if rows.groupBy("y").count().count() < 2:
        rows = sample
    part = with_gains(rows.select("y", "text"), toxic, ordinary, "y int").toPandas()
    x = part[["g0", "g1", "g2", "g3"]].to_numpy()
    y = part["y"].to_numpy()
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    w = logistic((x - centre) / scale, y, np.where(y == 1, MISSED * each[1], each[0]))
    return Model(toxic, ordinary, tuple(centre), tuple(scale), tuple(w))


def with_gains(docs: DataFrame, toxic: bytes, ordinary: bytes, kept: str) -> DataFrame:
    """The column named in ``kept`` and the four gains of each whole text."""
    name = kept.split()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain, marked = compressor(ordinary), compressor(toxic)
        for batch in batches:
            g = np.array([gains(t.as_py(), plain, marked) for t in batch.column("text")], np.float64).reshape(-1, 4)
            yield pa.record_batch([batch.column(name), *(pa.array(g[:, i]) for i in range(4))], [name, "g0", "g1", "g2", "g3"])

    return docs.select(name, "text").mapInArrow(run, f"{kept}, g0 double, g1 double, g2 double, g3 double")


def scores(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id and score of every document."""
    if model is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"))
    z = F.lit(model.weights[-1])
    for i, (c, s, w) in enumerate(zip(model.centre, model.scale, model.weights, strict=False)):
        z = z + F.lit(float(w)) * (F.col(f"g{i}") - F.lit(float(c))) / F.lit(float(s))
    return with_gains(docs, model.toxic, model.ordinary, "doc_id bigint").select("doc_id", (1 / (1 + F.exp(-z))).alias("score"))


def without_toxic(docs: DataFrame, model: Model | None, threshold: float = 0.5) -> DataFrame:
    """The documents that score below the threshold; rows with a null id are judged by their text too."""
    if model is None:
        return docs
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain, marked = compressor(model.ordinary), compressor(model.toxic)
        w = np.array(model.weights)
        for batch in batches:
            g = np.array([gains(t.as_py(), plain, marked) for t in batch.column("text")], np.float64).reshape(-1, 4)
            z = (g - np.array(model.centre)) / np.array(model.scale) @ w[:-1] + w[-1]
            yield batch.filter(pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))) < threshold)).select(columns)

    return docs.mapInArrow(run, docs.schema)
