"""URL filters by a bit-parallel wildcard automaton.

All glob rules are packed into the bits of a row of 64-bit words: one bit for each
position of each pattern. A batch of canonical URLs (host and path) is simulated together,
one byte of every URL at a time: ``D = ((D << 1 | starts) & accepts[byte]) | (D & loops[byte])``,
with carries from word to word. ``*`` loops over bytes other than ``/``, ``**`` over any
byte, ``?`` takes one byte other than ``/``. A pattern must match the whole URL.

A rule of host and path fits that host and its subdomains where the path starts with the
rule's path: two patterns, ``host/path**`` and ``*.host/path**``. The longest rule that
fits decides, then the rule that comes first. URLs that no rule fits go by the
method's own patterns: allowed unless a blocking pattern matches.

A URL that is null or has no ``://`` has an empty host and path; no rule fits it and it is
allowed. Rows are independent, so ties and repeated rows need no rule.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

U = np.uint64
#: (verdict, host, path) of the rules.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: What the method itself blocks.
BLOCKED = ("spam-*/**", "*.spam-*/**", "*casino*/**", "*poker*/**", "**/wp-login.php**", "**/../**")

#: Padded bytes and states that a group of URLs holds.
GROUP_BYTES = 16 << 20


@dataclass(frozen=True)
class Automaton:
    """Masks of ``words`` 64-bit words; pattern p ends in bit ``end[p]``."""

    accepts: np.ndarray
    loops: np.ndarray
    starts: np.ndarray
    begin: np.ndarray
    end: np.ndarray


def compile_globs(patterns: tuple[str, ...]) -> Automaton:
    """One state before each pattern and one after each of its bytes; stars loop on the state they follow."""
    steps: list[list[object]] = []
    loops: list[list[object]] = []
    for pattern in patterns:
        raw = pattern.encode()
        own_steps: list[object] = []
        own_loops: list[object] = [None]
        i = 0
        while i < len(raw):
            if raw[i : i + 2] == b"**":
                own_loops[-1] = "any"
                i += 2
            elif raw[i : i + 1] == b"*":
                own_loops[-1] = own_loops[-1] or "part"
                i += 1
            else:
                own_steps.append(None if raw[i : i + 1] == b"?" else raw[i])
                own_loops.append(None)
                i += 1
        steps.append(own_steps)
        loops.append(own_loops)
    size = [len(x) for x in loops]
    first = np.concatenate([[0], np.cumsum(size)])
    words = max(1, -(-int(first[-1]) // 64))
    accepts, loop = np.zeros((256, words * 64), bool), np.zeros((256, words * 64), bool)
    part = np.array([c != ord("/") for c in range(256)])
    for p in range(len(patterns)):
        for k, byte in enumerate(steps[p]):
            state = first[p] + k + 1
            if byte is None:
                accepts[part, state] = True
            else:
                accepts[byte, state] = True
        for k, kind in enumerate(loops[p]):
            if kind:
                loop[part if kind == "part" else slice(None), first[p] + k] = True

    def packed(bits: np.ndarray) -> np.ndarray:
        return np.packbits(bits, axis=-1, bitorder="little").view(np.uint64)

    begin = np.zeros(words * 64, bool)
    begin[first[:-1]] = True
    return Automaton(packed(accepts), packed(loop), packed(begin), first[:-1].copy(), first[1:] - 1)


def matches(automaton: Automaton, urls: list[bytes]) -> np.ndarray:
    """Whether each URL (row) matches each pattern (column).

    URLs meet the masks in groups of like length, longest first: the padded bytes and the states
    of a group stay within ``GROUP_BYTES``, or it is one URL.
    """
    size = np.array([len(u) for u in urls], np.int64)
    order = np.argsort(-size, kind="stable")
    out = np.empty((len(urls), len(automaton.end)), bool)
    done = 0
    while done < len(urls):
        room = GROUP_BYTES // max(int(size[order[done]]) + automaton.starts.nbytes, 1)
        some = order[done : done + max(room, 1)]
        out[some] = simulated(automaton, [urls[i] for i in some], size[some])
        done += len(some)
    return out


def simulated(automaton: Automaton, urls: list[bytes], ends: np.ndarray) -> np.ndarray:
    """``matches`` of URLs in falling order of their lengths ``ends``."""
    longest = int(ends.max(initial=0))
    grid = np.zeros((len(urls), longest), np.uint8)
    grid[np.arange(longest) < ends[:, None]] = np.frombuffer(b"".join(urls), np.uint8)
    state = np.repeat(automaton.starts[None, :], len(urls), axis=0)
    for i in range(longest):
        n = int(np.searchsorted(-ends, -i, "left"))  # URLs longer than i
        d = state[:n]
        carry = np.zeros_like(d)
        carry[:, 1:] = d[:, :-1] >> U(63)
        byte = grid[:n, i]
        state[:n] = (((d << U(1)) | carry) & automaton.accepts[byte]) | (d & automaton.loops[byte])
    return np.unpackbits(state.view(np.uint8), axis=1, bitorder="little")[:, automaton.end].astype(bool)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path, by the first ``://``; both empty without one."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def verdicts(pages: DataFrame, rules: tuple = RULES, blocked: tuple[str, ...] = BLOCKED) -> DataFrame:
    """page_id, host, path, rule (host and path) and verdict of every page."""
    patterns = tuple(g for _, host, path in rules for g in (f"{host}{path}**", f"*.{host}{path}**")) + tuple(blocked)
    # Longest first, so that the first fit decides.
    order = sorted(range(len(rules)), key=lambda i: (-len(rules[i][1] + rules[i][2]), i))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = compile_globs(patterns)
        for batch in batches:
            host, path = (batch.column(c).to_pylist() for c in ("host", "path"))
            found = matches(automaton, [(h + p).encode() for h, p in zip(host, path, strict=True)])
            rule = np.full(len(host), -1)
            for i in reversed(order):
                rule[found[:, 2 * i] | found[:, 2 * i + 1]] = i
            bad = found[:, 2 * len(rules) :].any(axis=1)
            names = [None if i < 0 else rules[i][1] + rules[i][2] for i in rule]
            said = [("block" if b else "allow") if i < 0 else rules[i][0] for i, b in zip(rule, bad, strict=True)]
            yield pa.record_batch(
                [batch.column("page_id"), batch.column("host"), batch.column("path"), pa.array(names, pa.string()), pa.array(said, pa.string())],
                ["page_id", "host", "path", "rule", "verdict"],
            )

    host, path = host_and_path(F.col("url"))
    parts = pages.select("page_id", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    return parts.mapInArrow(run, "page_id bigint, host string, path string, rule string, verdict string")
