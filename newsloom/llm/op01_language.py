"""Language identification by family, then by one-versus-one support vector machines.

A text becomes hashed counts of its letter n-grams (``GRAMS`` bytes of the lower-case
text, other characters as blanks), on a square-root scale and of unit length. One-versus-rest
linear SVMs choose the family; within it, linear SVMs of every pair of languages vote, and
the sum of margins breaks ties (then the code). A language that is in no known family is
a family of its own.

Only training is bounded: ``PER_LANGUAGE`` texts of each language, drawn by hash. Every text
is read whole. Null texts and texts without a letter are ``und`` with score 0; so is
every text if nothing was learned. Repeated rows get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.common import STEP, U, column_bytes, crc_mod, mix, stored, text_steps

GRAMS = (2, 3, 4)
FEATURES = 2048
PER_LANGUAGE = 1000
#: Close relatives by ISO 639-1 code.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "is", "lb", "nb", "nl", "nn", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "turkic": ("az", "kk", "ky", "tr", "uz"),
    "uralic": ("et", "fi", "hu"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}
#: Texts that a step holds feature vectors of.
STEP_ROWS = 512
LETTERS = np.arange(256, dtype=np.uint8)
LETTERS[[c for c in range(128) if not chr(c).isalpha()]] = 32
HAS_LETTER = regex.compile(r"\p{L}").search


@dataclass(frozen=True)
class Model:
    """Weights with the intercept last; families[i] has languages[i], pairs[(a, b)] is positive for a."""

    families: tuple[str, ...]
    languages: tuple[tuple[str, ...], ...]
    family_weights: np.ndarray
    pairs: dict[tuple[str, str], np.ndarray]


def features(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One unit vector for each text, from its lower-case bytes."""
    n = len(bounds) - 1
    b = LETTERS[data].astype(np.uint64)
    doc = np.repeat(np.arange(n), np.diff(bounds))
    out = np.zeros(n * FEATURES)
    for size in GRAMS:
        m = len(b) - size + 1
        if m <= 0:
            continue
        code = np.full(m, U(size))
        for i in range(size):
            code = (code << U(8)) | b[i : i + m]
        fits = np.arange(m) + size <= bounds[doc[:m] + 1]
        slot = (mix(code * STEP) % U(FEATURES)).astype(np.int64)
        out += np.bincount((doc[:m] * FEATURES + slot)[fits], minlength=len(out))
    x = np.sqrt(out).reshape(n, FEATURES)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def lower_steps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch, _, _ in text_steps(batches, rows=STEP_ROWS):
        yield batch, features(*column_bytes(pc.utf8_lower(batch.column("text").cast(pa.large_string()))))


def linear_svm(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4, rounds: int = 150) -> np.ndarray:
    """Squared-hinge linear SVM by accelerated gradient steps; y is 1 or -1, classes weigh the same."""
    x = np.column_stack([x, np.ones(len(x))])
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1))
    w = look = np.zeros(x.shape[1])
    rate = 1 / (2 * (weight * (x**2).sum(axis=1)).sum() + ridge)
    for k in range(rounds):
        slack = np.maximum(1 - y * (x @ look), 0)
        step = look - rate * (ridge * look - 2 * x.T @ (weight * slack * y))
        w, look = step, step + k / (k + 3) * (step - w)
    return w


def fit(docs: DataFrame) -> Model | None:
    """Learn from text and non-null lang of documents whose crc32(doc_id) mod 4 is not 2."""
    known = docs.where("lang is not null and doc_id is not null").where(crc_mod("doc_id", 4) != 2)
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    drawn = stored(known.select("doc_id", "lang").withColumn("n", F.row_number().over(order)).where(F.col("n") <= PER_LANGUAGE).select("doc_id").distinct())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in lower_steps(batches):
            raw = [row.tobytes() for row in x.astype(np.float32)]
            yield pa.record_batch([batch.column("lang"), pa.array(raw, pa.binary())], ["lang", "x"])

    # PER_LANGUAGE ids of each language: their size is bounded.
    rows = known.select("doc_id", "lang", "text").join(F.broadcast(drawn), "doc_id").mapInArrow(run, "lang string, x binary").toArrow()
    if not rows.num_rows:
        return None
    lang = np.array(rows.column("lang").to_pylist())
    x = np.frombuffer(b"".join(rows.column("x").to_pylist()), np.float32).reshape(len(lang), FEATURES).astype(np.float64)
    codes = sorted(set(lang.tolist()))
    family = np.array([FAMILY_OF.get(code, code) for code in lang.tolist()])
    families = sorted(set(family.tolist()))
    weights = np.array([linear_svm(x, np.where(family == f, 1, -1)) if len(families) > 1 else np.zeros(FEATURES + 1) for f in families])
    groups = tuple(tuple(c for c in codes if FAMILY_OF.get(c, c) == f) for f in families)
    pairs = {}
    for group in groups:
        for a, b in combinations(group, 2):
            two = (lang == a) | (lang == b)
            pairs[a, b] = linear_svm(x[two], np.where(lang[two] == a, 1, -1))
    return Model(tuple(families), groups, weights, pairs)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(4 * z, -50, 50)))


def decide(model: Model, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Language and score of each feature vector."""
    x = np.column_stack([x, np.ones(len(x))])
    margin = x @ model.family_weights.T
    best = margin.argmax(axis=1)
    score = _sigmoid(margin[np.arange(len(x)), best]) if len(model.families) > 1 else np.ones(len(x))
    lang = np.empty(len(x), object)
    for f, group in enumerate(model.languages):
        rows = np.flatnonzero(best == f)
        if len(group) == 1:
            lang[rows] = group[0]
            continue
        vote = np.zeros((len(rows), len(group)))
        total = np.zeros((len(rows), len(group)))
        for i, j in combinations(range(len(group)), 2):
            z = x[rows] @ model.pairs[group[i], group[j]]
            vote[:, i] += z >= 0
            vote[:, j] += z < 0
            total[:, i] += z
            total[:, j] -= z
        won = (vote + _sigmoid(total) * 0.5).argmax(axis=1)
        lang[rows] = np.array(group, object)[won]
        score[rows] *= _sigmoid(total[np.arange(len(rows)), won] / (len(group) - 1))
    return lang, score


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred and score of every document, from its whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in lower_steps(batches):
            lang, score = decide(model, x) if model else (np.full(batch.num_rows, "und", object), np.zeros(batch.num_rows))
            blank = np.array([not (t and HAS_LETTER(t)) for t in batch.column("text").to_pylist()], bool)
            lang[blank], score[blank] = "und", 0.0
            yield pa.record_batch([batch.column("doc_id"), pa.array(lang.tolist(), pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, lang_pred string, score double")
