"""SimHash trees, prefix tries and phrase collocations against brute force."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from newsloom.llm import op11_simhash, op12_prefix_trie, op13_collocations

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
TURNS = "conv_id bigint, turn bigint, role string, text string"


def lower(text):
    return re.sub("[A-Z]", lambda x: x[0].lower(), text or "")


def extra(df):
    """Columns whose names clash with the operators' own."""
    for name in ("fp", "shard", "own", "least", "root", "keys", "turns", "base", "n", "h", "a", "words", "phrase", "rank"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def simhash(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    h = np.array([xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(len(w) - 2, 1))] if w else [], np.uint64)
    return sum(1 << b for b in range(64) if 2 * int((h >> np.uint64(b) & np.uint64(1)).sum()) > len(h))


def linked(values, reach=3):
    """For each value the least index that it reaches over links, by brute force."""
    f = np.array(values, np.uint64)
    label = np.arange(len(f))
    near = np.bitwise_count(f[:, None] ^ f) <= reach
    while True:
        new = np.where(near, label, len(f)).min(axis=1)
        if (new == label).all():
            return label
        label = new


def clouds(n, seed):
    """Fingerprints in clouds, so that links, chains and near misses occur."""
    rng = np.random.default_rng(seed)
    centre = rng.integers(0, 2**64, n // 8, np.uint64)
    out = centre[rng.integers(0, len(centre), n)]
    for _ in range(4):
        out ^= np.where(rng.random(n) < 0.5, np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64), np.uint64(0))
    return np.unique(out)


def test_fingerprints_equal_single_bits():
    texts = ["", " \n", "One", "one two", "a b c", "É É\x1cx y Z z", "w " * 1000, " ".join(f"w{i}" for i in range(2000))]
    assert [op11_simhash.fingerprint(t.encode()) for t in texts] == [simhash(t) for t in texts]


@pytest.mark.parametrize("leaf", [2, 8, 256])
def test_trees_find_all_links(monkeypatch, leaf):
    monkeypatch.setattr(op11_simhash, "LEAF", leaf)
    monkeypatch.setattr(op11_simhash, "BLOCK", 64)
    points = clouds(900, leaf)
    tree = op11_simhash.top_tree(points[::3], 16)
    who, shard, own = tree.deal(points)
    assert len(tree.point) > 8 and sorted(who[own]) == list(range(len(points)))
    label = {p: p for p in points.tolist()}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for s in np.unique(shard):
        k = shard == s
        for a, b in op11_simhash.shard_links(points[who[k]], own[k]):
            assert (np.bitwise_count(a ^ b) <= 64).all()
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                label[max(root(x), root(y))] = min(root(x), root(y))
    assert [root(p) for p in points.tolist()] == points[linked(points)].tolist()


def test_equidistant_points_are_one_leaf():
    points = np.uint64(1) << np.arange(64, dtype=np.uint64)
    assert op11_simhash.vantage(np.repeat(points[:1], 5)) is None
    edges = list(op11_simhash.shard_links(points, np.ones(64, bool)))
    assert sum(len(a) for a, _ in edges) == 63  # a forest, not all 2016 pairs


def test_near_duplicates_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    base = [" ".join("".join(rng.choice(list("abcde"), 4)) for _ in range(60)) for _ in range(12)]
    texts = [b if i % 3 == 0 else b + " end" if i % 3 == 1 else b.upper() for i, b in enumerate(base * 4)]
    texts += [None, "", "\t \n", "one", "One", "long " * 50_000]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    rows += [rows[0], (None, texts[0], "en", "s", 1), (None, "no other text is like this one", None, None, None)]
    got = op11_simhash.near_duplicates(extra(spark.createDataFrame(rows, DOCS)), 4, 4).collect()
    assert len(got) == len(rows)
    want = linked([simhash(t) for t in texts])
    for r in got:
        if r["doc_id"] is not None:
            assert (r["fingerprint"], r["component_id"]) == (f"{simhash(texts[r['doc_id']]):016x}", want[r["doc_id"]])
    assert sorted((r["component_id"] for r in got if r["doc_id"] is None), key=str) == [0, None]
    empty = op11_simhash.near_duplicates(spark.createDataFrame([], DOCS))
    assert empty.columns == ["doc_id", "fingerprint", "component_id"] and empty.count() == 0


def trie_rows(rows):
    """The nodes of a plain dictionary of prefixes."""
    turns = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in turns.items()}
    made = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = tuple(turns.get(c - c % 20, [])[:h] + own[h:])
    members = collections.defaultdict(list)
    for c in sorted(made):
        for d in range(len(made[c]) + 1):
            members[made[c][:d]].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, own in members.items():
        cost = (len(own) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += cost
    return sorted(
        (own[0], len(p), members[p[:-1]][0] if p else None, len(own), children[p], leaves[p], saved[p],
         hashlib.sha256(",".join(str(c) for c in own if made[c] == p).encode()).hexdigest())
        for p, own in members.items()
    )


def conversation_rows(n, seed):
    rng = np.random.default_rng(seed)
    out = []
    for c in range(n):
        for t in range(rng.integers(1, 7)):
            # One very common first turn, few others, and copies of whole conversations.
            text = "hello there" if t == 0 and rng.random() < 0.5 else f"say {rng.integers(0, 3)} " * int(rng.integers(1, 3))
            out.append((c, t, "user" if t % 2 == 0 else "assistant", text))
    return out


@pytest.mark.parametrize("shard_turns", [8, 40, 1 << 15])
def test_trie_equals_a_dictionary(spark, shard_turns):
    rows = conversation_rows(130, 7)
    rows += [(500, None, "user", "first"), (500, 3, None, None), (500, 1, "user", ""), (501, 0, "user", "alone"), (None, 1, "user", "lost")]
    rows += [(520, t, "user", f"turn {t}") for t in range(60)] + [rows[0], (521, 0, "system", "x " * 100_000)]
    got = op12_prefix_trie.trie(extra(spark.createDataFrame(rows, TURNS)), shard_turns)
    assert got.columns == list(op12_prefix_trie.NODE)
    key = lambda r: (r[0], r[1])
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(trie_rows(rows), key=key)
    assert op12_prefix_trie.trie(spark.createDataFrame([], TURNS)).count() == 0


def test_double_array_refuses_foreign_turns():
    trie = op12_prefix_trie.DoubleArray(2)
    trie.add(np.zeros(3, np.int64), np.array([0, 2, 5]))
    a = trie.step(np.zeros(3, np.int64), np.array([0, 2, 5]))
    trie.add(np.sort(a), np.array([1, 1, 0]))
    assert len(set(a.tolist())) == 3 and (a > 0).all() and (trie.check[a] == 0).all()
    assert trie.step(np.zeros(3, np.int64), np.array([1, 3, 700])).tolist() == [-1, -1, -1]
    assert (trie.step(np.sort(a), np.array([1, 1, 0])) > 0).all()


def grams(rows):
    f, total = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(w)
            for n in (1, 2, 3):
                for i in range(len(w) - n + 1):
                    f[lang or "und"][tuple(w[i : i + n])] += 1
    return f, total


def test_collocations_equal_plain_counts(spark):
    rng = np.random.default_rng(11)
    words = ["en", "es", "New", "york", "the", "CITY", "été", "a\x1cb", "x"]
    texts = []
    for i in range(120):
        w = list(rng.choice(words, 40)) + ["new", "york", "city"] * int(rng.integers(0, 3))
        gaps = rng.choice([" ", "  ", "\t", ", ", ".", "\n", " "], len(w))
        texts.append(("".join(a + b for a, b in zip(w, gaps, strict=True)), [None, "en", "es"][i % 3]))
    texts += [(None, "en"), ("", "de"), ("?!.", "fr"), ("hi hi " * 30_000, "en"), texts[0], texts[0]]
    docs = extra(spark.createDataFrame([(i % 50, t, lang, "s", 1) for i, (t, lang) in enumerate(texts)], DOCS))
    f, total = grams(texts)
    want = []
    for lang, c in f.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= 10}
        gone = {q for p, a in found.items() if len(p) == 3 for q in (p[:2], p[1:]) if 100 * a >= 50 * found[q]}
        best = [(*min((1000000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p))), a, p) for p, a in found.items() if p not in gone]
        best.sort(key=lambda r: (-r[0], -r[2], " ".join(r[3]).encode()))
        want += [(lang, i, " ".join(p), a, c[p[:k]], c[p[k:]], total[lang], s) for i, (s, k, a, p) in enumerate(best[:25], 1)]
    got = op13_collocations.collocations(docs, top=25, part_bytes=3000)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert op13_collocations.collocations(docs.limit(0)).count() == 0


def test_summaries_keep_every_frequent_key():
    rng = np.random.default_rng(2)
    stream = np.concatenate([np.repeat(np.arange(40), rng.integers(5, 40, 40)), rng.integers(100, 10**9, 4000)])
    rng.shuffle(stream)
    true = collections.Counter(stream.tolist())
    summary = op13_collocations.Summary(len(stream) // 10 + 1)
    for part in np.array_split(stream, 23):
        summary.merge(part, np.ones(len(part), np.int64))
    assert len(summary.keys) <= summary.capacity and summary.off < 10
    left = set(summary.survivors(10).tolist())
    assert {k for k, n in true.items() if n >= 10} <= left
    assert all(true[k] - summary.off <= n <= true[k] for k, n in zip(summary.keys.tolist(), summary.counts.tolist(), strict=True))
