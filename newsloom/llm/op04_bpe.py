"""Byte-level BPE encoding and decoding over length-bucketed padded numpy matrices.

A text is cut by the tokenizer's pattern; each distinct piece is encoded once per
task. New pieces are bucketed by length into matrices of token ids, padded with -1.
Each round every row merges its leftmost pair of minimum rank; pair ranks come from
an open-addressing hash table, rows are compacted to the left, and rows that have
no pair left are done. Merge order is that of the rank file: any two neighbours whose
bytes together are a token may merge, at that token's rank.

A null text is empty: no tokens, no bytes. Rows are independent of each other, so
ties, repeated rows and extra columns need no rule.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

NONE = np.int64(2**62)
#: Pieces above this many bytes are merged one by one; each round merges all copies of the pair.
LONG = 512
#: Pieces that a task remembers; the memory is emptied when it is full.
REMEMBER = 200_000
#: White space of the pattern: the property of that name.
WHITE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
BLACK = "[^" + WHITE[1:]


def load_ranks(path: str) -> list[tuple[bytes, int]]:
    with open(path, "rb") as lines:
        return [(base64.b64decode(a), int(b)) for a, b in map(bytes.split, lines)]


def with_white_space(pattern: str) -> str:
    """The pattern with ``\\s`` and ``\\S`` spelled out, as libraries differ on control characters."""
    out = regex.sub(r"\[\^\\s", lambda _: "[^" + WHITE[1:-1], pattern)
    return out.replace(r"\s", WHITE).replace(r"\S", BLACK)


class PairTable:
    """Ranks of token pairs in an open-addressing hash table of numpy arrays."""

    def __init__(self, ranks: list[tuple[bytes, int]]):
        of = dict(ranks)
        left, right, rank = [], [], []
        for token, r in ranks:
            for i in range(1, len(token)):
                a, b = of.get(token[:i]), of.get(token[i:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    rank.append(r)
        key = (np.array(left, np.int64) << 32) | np.array(right, np.int64)
        self.bits = max(int(np.ceil(np.log2(max(len(key), 1) * 2.5))), 4)
        self.key = np.full(1 << self.bits, -1, np.int64)
        self.rank = np.full(1 << self.bits, NONE, np.int64)
        slot, todo = self._slot(key), np.arange(len(key))
        rank = np.array(rank, np.int64)
        while len(todo):
            free = self.key[slot[todo]] == -1
            self.key[slot[todo[free]]] = key[todo[free]]
            placed = self.key[slot[todo]] == key[todo]
            self.rank[slot[todo[placed]]] = rank[todo[placed]]
            todo = todo[~placed]
            slot[todo] = (slot[todo] + 1) & (len(self.key) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; ``NONE`` if it is no token or if either side is padding."""
        shape = left.shape
        key = np.where((left < 0) | (right < 0), np.int64(-2), (left << 32) | right).ravel()
        out = np.full(len(key), NONE, np.int64)
        todo = np.flatnonzero(key != -2)
        slot = self._slot(key[todo])
        while len(todo):
            there = self.key[slot]
            hit = there == key[todo]
            out[todo[hit]] = self.rank[slot[hit]]
            on = ~hit & (there != -1)
            todo, slot = todo[on], (slot[on] + 1) & (len(self.key) - 1)
        return out.reshape(shape)


class ByteBpe:
    """Encoder and decoder of one rank file and pattern."""

    def __init__(self, path: str, pattern: str):
        ranks = load_ranks(path)
        self.of = dict(ranks)
        self.bytes = {r: t for t, r in ranks}
        self.text = {r: str(r) for _, r in ranks}
        self.pairs = PairTable(ranks)
        self.first = np.array([self.of[bytes([i])] for i in range(256)], np.int64)
        self.cut = regex.compile(with_white_space(pattern)).findall
        self.seen: dict[str, tuple[str, int, bytes]] = {}

    def merge(self, rows: list[bytes]) -> list[list[int]]:
        """Ids of pieces of one length bucket."""
        size = np.fromiter(map(len, rows), np.int64, len(rows))
        width = int(size.max())
        ids = np.full((len(rows), width), -1, np.int64)
        ids[np.arange(width) < size[:, None]] = self.first[np.frombuffer(b"".join(rows), np.uint8)]
        out = np.full_like(ids, -1)
        name = np.arange(len(rows))
        rank = self.pairs(ids[:, :-1], ids[:, 1:])
        while rank.shape[1]:
            at = rank.argmin(axis=1)
            best = rank[np.arange(len(name)), at]
            done = best == NONE
            if done.any():
                out[name[done], : ids.shape[1]] = ids[done]
                ids, rank, at, best, name = ids[~done], rank[~done], at[~done], best[~done], name[~done]
                if not len(name):
                    break
            row = np.arange(len(name))
            # The merged token takes the place of the pair; what follows moves up by one.
            column = np.arange(ids.shape[1] - 1)
            moved = column + (column > at[:, None])
            ids = np.take_along_axis(ids, moved, axis=1)
            ids[row, at] = best
            rank = np.take_along_axis(rank, moved[:, :-1], axis=1)
            for side in (at - 1, at):
                ok = np.flatnonzero((side >= 0) & (side < rank.shape[1]))
                rank[ok, side[ok]] = self.pairs(ids[ok, side[ok]], ids[ok, side[ok] + 1])
            used = int((ids >= 0).sum(axis=1).max())
            ids, rank = ids[:, :used], rank[:, : used - 1]
        out[name, : ids.shape[1]] = ids
        count = (out >= 0).sum(axis=1).tolist()
        return [ids[:n] for ids, n in zip(out.tolist(), count, strict=True)]

    def merge_long(self, piece: bytes) -> list[int]:
        """Ids of one long piece. A round merges every copy of the minimum pair, left to right,
        as single steps would; if a new pair ranked lower, it merges the leftmost copy only."""
        ids = self.first[np.frombuffer(piece, np.uint8)]
        rank = self.pairs(ids[:-1], ids[1:])
        while len(rank) and (best := rank.min()) != NONE:
            at = np.flatnonzero(rank == best)
            run = np.cumsum(np.concatenate([[True], np.diff(at) > 1]))
            at = at[(np.arange(len(at)) - np.searchsorted(run, run)) % 2 == 0]
            for take in (at, at[:1]):
                keep = np.ones(len(ids), bool)
                keep[take + 1] = False
                after = ids.copy()
                after[take] = best
                follows = np.append(ids, -1)[take + 2]
                new = after[keep]
                ranks = self.pairs(new[:-1], new[1:])
                own = np.flatnonzero(keep)
                own = np.searchsorted(own, take)
                touched = np.concatenate([ranks[own[own > 0] - 1], self.pairs(np.full(len(take), best), follows)])
                if len(take) == 1 or not (touched < best).any():
                    break
            ids, rank = new, ranks
        return ids.tolist()

    def learn(self, pieces: list[str]) -> None:
        """Encode distinct new pieces, by length."""
        buckets: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            raw = piece.encode()
            whole = self.of.get(raw)
            if whole is not None:
                self._remember(piece, [whole])
            elif len(raw) > LONG:
                self._remember(piece, self.merge_long(raw))
            else:
                buckets.setdefault(max(8, 1 << (len(raw) - 1).bit_length()), []).append((piece, raw))
        for width, found in buckets.items():
            step = max(1, (1 << 19) // width)
            for i in range(0, len(found), step):
                part = found[i : i + step]
                for (piece, _), ids in zip(part, self.merge([raw for _, raw in part]), strict=True):
                    self._remember(piece, ids)

    def _remember(self, piece: str, ids: list[int]) -> None:
        text, raw = self.text, self.bytes
        self.seen[piece] = (" ".join([text[i] for i in ids]), len(ids), b"".join([raw[i] for i in ids]))

    def encode(self, texts: list[str | None]) -> list[tuple[list[tuple[str, int, bytes]]]]:
        """For each text, what ``_remember`` keeps of each piece in turn."""
        if len(self.seen) > REMEMBER:
            self.seen.clear()
        cut = [self.cut(t) if t else [] for t in texts]
        new = set().union(*cut).difference(self.seen) if cut else set()
        self.learn(sorted(new))
        look = self.seen.__getitem__
        return [list(map(look, pieces)) for pieces in cut]


@cache
def coder(path: str, pattern: str) -> ByteBpe:
    """One encoder for all tasks of a Python worker."""
    return ByteBpe(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, step_chars: int = 1 << 19) -> DataFrame:
    """doc_id, ids (decimal, joined by one space), n_tokens and the decoded bytes of each text.

    ``step_chars`` bounds the text in work at once; a longer text is a step of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            at = 0
            while at < len(texts):
                to, chars = at, 0
                while to < len(texts) and (to == at or chars + len(texts[to] or "") <= step_chars):
                    chars += len(texts[to] or "")
                    to += 1
                ids, count, raw = [], [], []
                for found in bpe.encode(texts[at:to]):
                    ids.append(" ".join([f[0] for f in found]))
                    count.append(sum([f[1] for f in found]))
                    raw.append(b"".join([f[2] for f in found]))
                yield pa.record_batch([
                    batch.column("doc_id").slice(at, to - at), pa.array(ids, pa.string()), pa.array(count, pa.int64()), pa.array(raw, pa.binary()),
                ], ["doc_id", "ids", "n_tokens", "decoded"])
                at = to

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, ids string, n_tokens bigint, decoded binary")


def decode(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and decoded bytes from doc_id and ids; an unknown id is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = coder(path, pattern).bytes
        for batch in batches:
            raw = [b"".join([table[int(i)] for i in (x or "").split()]) for x in batch.column("ids").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(raw, pa.binary())], ["doc_id", "decoded"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and the hex SHA-256 of ids and decoded bytes, taken where the text is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([
                batch.column("doc_id"), batch.column("n_tokens"),
                pa.array([hashlib.sha256(x.as_py().encode()).hexdigest() for x in batch.column("ids")], pa.string()),
                pa.array([hashlib.sha256(x.as_py()).hexdigest() for x in batch.column("decoded")], pa.string()),
            ], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encode(docs, path, pattern).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
