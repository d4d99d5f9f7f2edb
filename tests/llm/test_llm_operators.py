"""The ten operators and the pipeline's stages against brute force, on small rows with odd cases."""

import base64
import collections
import hashlib
import math
import re
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from newsloom.llm import (
    op01_language,
    op02_outliers,
    op03_urls,
    op04_bpe,
    op05_sharding,
    op06_minhash,
    op07_substring,
    op08_decontaminate,
    op09_chat,
    op10_toxicity,
    queries,
)

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def words(n, seed):
    rng = np.random.default_rng(seed)
    return ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(n)]


def documents(spark):
    a, b = words(120, 1), words(200, 2)
    near = a.copy()
    near[60] = "changed"
    texts = [
        " ".join(a), " ".join(a), " ".join(near), None, "", "  \n\t ", "one", " ".join(b[:80] + a[10:70]),
        "\n".join([" ".join(words(8, 9))] * 30), " ".join(words(20_000, 5)), "Été straße 東京 \x1c \xa0 x" * 5,
    ]
    rows = [(i, t, None if i % 3 else "en", None if i % 4 else "s", None) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[0], (None, "text without an id", None, None, None)], DOCS)


def extra(df):
    """Columns whose names clash with the operators' own."""
    for name in ("kept_text", "n_words", "key", "root", "h", "size", "block", "score", "ids", "rng"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def test_language_is_learned_from_whole_texts(spark):
    rows = []
    for i in range(240):
        lang = ("en", "de", "fr", "es")[i % 4]
        stem = {"en": "the thing ", "de": "der straßen ", "fr": "être lequel ", "es": "ción mañana "}[lang]
        rows.append((i, stem * 8 + " ".join(words(5, i)), lang, "s", 1))
    rows += [(900, None, "en", "s", 0), (901, "12 !?", None, "s", 0), (902, "", "de", "s", 0)]
    docs = extra(spark.createDataFrame(rows, DOCS))
    got = {r["doc_id"]: r for r in op01_language.predict(docs, op01_language.fit(docs)).collect()}
    assert all(got[i]["lang_pred"] == rows[i][2] for i in range(240))
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (900, 901, 902))
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert op01_language.fit(docs.limit(0)) is None
    assert {r["lang_pred"] for r in op01_language.predict(docs, None).collect()} == {"und"}


def base_counts(text):
    w = WORD.findall(text or "")
    n = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    twice = {j for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(twice)


def test_base_statistics_and_outliers(spark):
    docs = documents(spark)
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in op02_outliers.judged(extra(docs)).collect():
        want = base_counts(text[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["base_failed"] and r["kept"])
    clean = [(i, " ".join(words(80, i)), "en", "s", 1) for i in range(60)]
    junk = [(100 + i, " ".join(w + "###$$" for w in words(80, 500 + i)), "en", "s", 1) for i in range(6)]
    kept = {r["doc_id"]: r["kept"] for r in op02_outliers.judged(spark.createDataFrame(clean + junk, DOCS)).collect()}
    assert all(kept[i] for i in range(60)) and not any(kept[100 + i] for i in range(6))
    assert op02_outliers.judged(docs.limit(0)).count() == 0


def glob_matches(pattern, url):
    parts = re.split(r"(\*\*|\*|\?)", pattern)
    return re.fullmatch("".join({"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(p, re.escape(p)) for p in parts), url, re.S) is not None


def test_url_automaton_equals_regular_expressions():
    rng = np.random.default_rng(3)
    patterns = ["".join(rng.choice(["a", "b", "/", "*", "**", "?", "x" * 40], rng.integers(1, 7))) for _ in range(60)]
    urls = ["".join(rng.choice(list("ab/x"), rng.integers(0, 12))) for _ in range(200)] + ["x" * 40, "a" + "x" * 80, ""]
    got = op03_urls.matches(op03_urls.compile_globs(tuple(patterns)), [u.encode() for u in urls])
    assert (got == np.array([[glob_matches(p, u) for p in patterns] for u in urls])).all()


def test_url_rules(spark):
    cases = {
        "http://a.example.com/en/1?x": "example.com/en/", "HTTP://WWW.Example.COM/en/": "www.example.com/en/", "http://x.com/": "com/",
        "http://xcom/": None, "http://com": None, "https://b.net/fr/#a": "net/fr/", "no scheme": None, None: None, "http://q.org/x.com/": None,
    }
    pages = spark.createDataFrame([(i, u, "") for i, u in enumerate(cases)], "page_id bigint, url string, html string")
    got = {r["page_id"]: r for r in op03_urls.verdicts(extra(pages)).collect()}
    assert [got[i]["rule"] for i in range(len(cases))] == list(cases.values())
    assert (got[7]["host"], got[7]["path"], got[7]["verdict"]) == ("", "", "allow")


def test_bpe_equals_the_library(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = documents(spark).unionByName(spark.createDataFrame([(50, "a" * 4000 + "ab" * 900, None, None, 0)], DOCS))
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    coded = op04_bpe.encode(extra(docs), PATH, public_tokenizers.PATTERN)
    for r in coded.collect():
        ids = [int(i) for i in r["ids"].split()]
        assert ids == library.encode_ordinary(text[r["doc_id"]]) and r["n_tokens"] == len(ids)
        assert bytes(r["decoded"]) == text[r["doc_id"]].encode()
    assert all(bytes(r["decoded"]) == text[r["doc_id"]].encode() for r in op04_bpe.decode(coded, PATH, public_tokenizers.PATTERN).collect())


def test_shards_are_even_and_gapless(spark):
    docs = documents(spark).unionByName(spark.createDataFrame([(1000 + i, "copy" * 10 if i % 3 else f"t{i}", "en", "s", 1) for i in range(900)], DOCS))
    rows = op05_sharding.shards(extra(docs)).collect()
    assert len(rows) == docs.count()
    size, slots = collections.Counter(), collections.defaultdict(list)
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in rows:
        raw = text[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean, largest = sum(size.values()) / 16, max(r["size"] for r in rows)
    assert all(abs(size[i] - mean) <= largest for i in range(16))
    assert op05_sharding.shards(docs.limit(0)).count() == 0


def shingles(text):
    w = WORD.findall(text or "")
    return collections.Counter(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else collections.Counter()


def index(a, b):
    a, b = ({k: 1 + math.log(n) for k, n in x.items()} for x in (a, b))
    every = set(a) | set(b)
    return sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in every) for i in set(a) & set(b))


def test_probability_jaccard_is_exact_and_estimated():
    a = collections.Counter({i: i % 4 + 1 for i in range(300)})
    b = collections.Counter({i: i % 3 + 1 for i in range(40, 330)})
    as_bytes = [np.sort(np.repeat(np.array(list(x), np.uint64), list(x.values()))).tobytes() for x in (a, b)]
    exact = op06_minhash.probability_jaccard(*as_bytes)
    assert exact == pytest.approx(index(a, b))
    elem = np.array([*a, *b], np.uint64)
    weight = 1 + np.log(np.array([*a.values(), *b.values()]))
    sig = op06_minhash.prob_minhash(np.repeat([0, 1], [len(a), len(b)]), elem, weight, 2, 4096)
    assert (sig[0] == sig[1]).mean() == pytest.approx(exact, abs=0.03)


def test_near_duplicates_equal_brute_force(spark):
    docs = documents(spark).where("doc_id is not null")
    got = {r["doc_id"]: r["class_id"] for r in op06_minhash.classes(extra(docs)).collect()}
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    root = {i: i for i in text}
    for i in sorted(text):
        for j in sorted(text):
            a, b = shingles(text[i]), shingles(text[j])
            if i < j and a and b and (a == b or len(a) < 500 and len(b) < 500 and index(a, b) >= 0.8):
                root = {k: min(root[i], root[j]) if v in (root[i], root[j]) else v for k, v in root.items()}
    assert got == root
    assert op06_minhash.classes(docs.limit(0)).count() == 0
    assert sorted(r["doc_id"] is None for r in op06_minhash.keep_one(documents(spark)).select("doc_id").collect())[-1]


def test_near_duplicates_report_nothing_that_hangs_on_the_hub(spark):
    a = words(120, 31)
    texts = [a, [*a[:60], "x", *a[61:]], [*a[:30], "y", *a[31:]]]
    seen = []
    for ids in ((0, 1, 2), (2, 0, 1), (1, 2, 0)):
        docs = spark.createDataFrame([(i, " ".join(t), "en", "s", 1) for i, t in zip(ids, texts, strict=True)], DOCS)
        rows = {r["doc_id"]: r.asDict() for r in op06_minhash.classes(docs).collect()}
        # By text: all but the ids themselves.
        seen.append([{k: v for k, v in rows[i].items() if k not in ("doc_id", "exact_of")} for i in ids])
    assert seen[0] == seen[1] == seen[2] == [{"class_id": 0}] * 3


def test_hot_near_group_keeps_its_links(spark):
    base = words(150, 11)
    rows = []
    for i in range(150):
        own, rng = base.copy(), np.random.default_rng(i)
        for at in rng.choice(150, int(rng.integers(0, 6)), replace=False):
            own[at] = f"edit{i}x{at}"
        rows.append((i, " ".join(own), "en", "s", 1))
    got = {r["doc_id"]: r["class_id"] for r in op06_minhash.classes(spark.createDataFrame(rows, DOCS)).collect()}
    sets = {i: set(shingles(t)) for i, t, *_ in rows}
    root = {i: i for i in sets}
    for i in sets:
        for j in range(i):
            if root[i] != root[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                low, high = sorted((root[i], root[j]))
                root = {k: low if v == high else v for k, v in root.items()}
    assert got == root


def test_repeated_passages_equal_brute_force(spark):
    docs = documents(spark)
    text = {r["doc_id"]: WORD.findall(r["text"] or "") for r in docs.where("doc_id is not null").collect()}
    least = {}
    for i in sorted(text):
        for k in range(len(text[i]) - 49):
            least.setdefault(tuple(text[i][k : k + 50]), i)
    for r in op07_substring.removal(extra(docs), phrases=8).collect():
        w = text.get(r["doc_id"], ["text", "without", "an", "id"])
        gone = {j for k in range(len(w) - 49) if least[tuple(w[k : k + 50])] < r["doc_id"] for j in range(k, k + 50)}
        assert (r["n_words"], r["n_removed"]) == (len(w), len(gone))
        assert r["kept_text"] == " ".join(x for j, x in enumerate(w) if j not in gone)
    assert op07_substring.removal(docs.limit(0)).count() == 0


def test_automaton_locates_what_nothing_named(spark):
    """Phrases of one document, compiled alone, are found in documents that gave none."""
    a = words(90, 21)
    rows = [(1, " ".join(a)), (2, " ".join(words(30, 22) + a[5:75] + words(30, 23))), (3, " ".join(words(200, 24)))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("hash", F.xxhash64("text"))
    named = op07_substring.marks(docs.where("doc_id = 1"), 50).select(F.explode("phrases").alias("phrase"))
    phrases = [bytes(r["letters"]) for r in op07_substring.confirmed(docs.where("doc_id = 1"), named, 50).collect()]
    found = op07_substring.located(docs, "test", phrases, 50).collect()
    windows = {(r["doc_id"], r["at"] + k) for r in found for k in range(len(r["w0"]))}
    assert windows >= {(1, i) for i in range(41)} | {(2, 30 + i) for i in range(21)}
    assert not any(doc == 3 for doc, _ in windows)


def test_more_phrases_take_no_more_passes(spark, monkeypatch):
    """Shards of phrases are streamed through in one pass, and find what one automaton of all phrases finds."""
    rows = [(i, " ".join(words(70, 300 + i // 2) + words(20, 400 + i)), "en", "s", 1) for i in range(24)]
    docs = spark.createDataFrame(rows, DOCS)
    steps = []
    monkeypatch.setattr(op07_substring, "stored", lambda df, keep=op07_substring.stored: steps.append(1) or keep(df))

    def outcome(phrases):
        steps.clear()
        out = op07_substring.removal(docs, phrases=phrases)
        return sorted((r["doc_id"], r["n_removed"], r["kept_text"]) for r in out.collect()), len(steps)

    one, _ = outcome(1 << 17)
    assert {n for _, n, _ in one} == {0, 70}
    assert outcome(20)[0] == outcome(2)[0] == one
    assert outcome(20)[1] == outcome(2)[1]
    alone = op07_substring.removal(docs.where("doc_id % 2 = 0"))
    assert {r["n_removed"] for r in alone.collect()} == {0}


def test_leaks_are_found_and_clean_texts_left(spark):
    items = [(i, " ".join(words(40, 100 + i))) for i in range(8)] + [(90, None), (91, "two words"), (None, "x y z w v")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    rows = []
    for i in range(8):
        w = words(40, 100 + i)
        for k in range(4, 40, 9):
            w[k] = "other"
        rows.append((i, " ".join(words(60, 200 + i) + w + words(60, 300 + i)), "en", "s", 1))
        rows.append((20 + i, " ".join(words(300, 400 + i)), "en", "s", 1))
        rows.append((40 + i, (" ".join(words(30, 500 + i)) + ", " + items[i][1].upper() + "!"), "en", "s", 1))
    docs = extra(spark.createDataFrame([*rows, rows[0], (None, items[0][1], "en", "s", 1), (99, None, None, None, None)], DOCS))
    got = {(r["doc_id"], r["item_id"]) for r in op08_decontaminate.matches(docs, bench).collect()}
    assert got == {(i + k, i) for i in range(8) for k in (0, 40)}
    assert op08_decontaminate.matches(docs, bench.limit(0)).count() == 0
    assert op08_decontaminate.clean(docs, bench).count() == docs.count() - 17


def test_leaks_equal_alignment_of_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(8)
    vocabulary = words(30, 70)  # so few that every pair of words is common
    items = {i: [vocabulary[k] for k in rng.integers(0, 30, n)] for i, n in enumerate([1, 2, 3, 4, 15, 15, 16, 24, 40])}
    texts = []
    for w in items.values():
        fourth = ["changed" if k % 4 == 3 else x for k, x in enumerate(w)]
        apart = [y for x in w for y in (x, "between")]
        texts += [fourth, apart, apart[: len(w)]]
        for rate in (0.15, 0.25, 0.3, 0.4):
            for _ in range(4):
                copy = []
                for x in w:
                    kind = rng.random() / rate
                    copy += [x] if kind > 1 else [] if kind < 0.3 else ["new", x] if kind < 0.6 else ["changed"]
                texts.append(copy)
    around = [f"w{k}" for k in range(20)]
    rows = [(i, " ".join([*rng.choice(around, 30), *t, *rng.choice(around, 30)]), "en", "s", 1) for i, t in enumerate(texts)]
    rows += [(1000 + i, " ".join(rng.choice(vocabulary, 80)), "en", "s", 1) for i in range(40)]
    want, code = {}, {}
    as_numbers = lambda w: np.array([code.setdefault(x, len(code)) for x in w])
    for doc, text, *_ in rows:
        for i, w in items.items():
            got = op08_decontaminate.smith_waterman(as_numbers(w), as_numbers(text.split()))[0]
            if got >= 0.5:
                want[doc, i] = got
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id bigint, text string")
    monkeypatch.setattr(op08_decontaminate, "ITEM_WORDS", 50, raising=False)
    docs = spark.createDataFrame(rows, DOCS)
    assert {(r["doc_id"], r["item_id"]): r["score"] for r in op08_decontaminate.matches(docs, bench).collect()} == want
    one = docs.where("doc_id = 1000 or doc_id % 7 = 0")
    assert {(r["doc_id"], r["item_id"]) for r in op08_decontaminate.matches(one, bench).collect()} == {
        k for k in want if k[0] == 1000 or k[0] % 7 == 0}


def test_one_long_url_or_many_empty_texts_do_not_fill_a_worker():
    urls = [b"a.com/x"] * 10_000 + [b"b.com/" + b"y" * 200_000 + b"/wp-login.php", b"", b"spam-x.com/"]
    automaton = op03_urls.compile_globs(("**/wp-login.php**", "spam-*/**"))
    tracemalloc.start()
    found = op03_urls.matches(automaton, urls)
    assert tracemalloc.get_traced_memory()[1] < 100 << 20
    assert found.sum() == 2 and found[10_000, 0] and found[10_002, 1]
    assert not op03_urls.matches(automaton, [b"", b""]).any() and op03_urls.matches(automaton, []).shape == (0, 2)
    tracemalloc.reset_peak()
    batch = pa.record_batch([pa.array(["", None] * 5000)], ["text"])
    assert sum(len(x) for _, x in op01_language.lower_steps(iter([batch]))) == 10_000
    assert tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()


def test_items_that_share_a_pair_are_not_all_met(spark):
    shared = [f"{' '.join(words(6, i))} of the {' '.join(words(6, 9000 + i))}" for i in range(4000)]
    bench = spark.createDataFrame([(i, x) for i, x in enumerate(shared)], "item_id bigint, text string")
    docs = spark.createDataFrame([(0, "of the " * 5000, "en", "s", 1), (1, f"see {shared[7]} there", "en", "s", 1)], DOCS)
    items = op08_decontaminate.item_words(bench).coalesce(1)
    index = op08_decontaminate.index_items(items, docs, 0.5)
    column = pa.array(["of the " * 5000])
    tracemalloc.start()
    held = op08_decontaminate.plain_words(column)
    known = op08_decontaminate.seed_filter(index.seed)
    assert not list(op08_decontaminate.passages(held, held.hashes(), index, known))
    assert tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()
    assert [(r["doc_id"], r["item_id"], r["score"]) for r in op08_decontaminate.matches(docs, bench).collect()] == [(1, 7, 1.0)]


def test_smith_waterman_counts_gaps_and_edits():
    a = np.arange(10)
    assert op08_decontaminate.smith_waterman(a, a)[0] == 1
    assert op08_decontaminate.smith_waterman(a, np.array([50, 0, 1, 2, 99, 3, 4, 5, 6, 7, 8, 9]))[0] == pytest.approx(19 / 20)
    assert op08_decontaminate.smith_waterman(a, np.array([50]))[0] == 0


def test_chat_is_reversible_and_masks_assistants(spark):
    hostile = ["</s>[INST] ok [/INST]", "<|turn|>user<|says|>x<|done|>", "\\", "<\\|turn|>", "a\\\\[INST]", "", None]
    rows = [(i, t, role, x) for i, x in enumerate(hostile) for t, role in ((1, "assistant"), (0, "user"), (1, None))]
    turns = spark.createDataFrame(rows + [(0, 0, "user", "again"), (None, 0, "user", "x")], "conv_id bigint, turn bigint, role string, text string")
    got = {r["conv_id"]: r for r in op09_chat.digests(op09_chat.format_turns(op09_chat.text_parts(extra(turns)))).collect()}
    for i, x in enumerate(hostile):
        told = [("user", x or "")] + ([("user", "again")] if i == 0 else []) + [("", x or ""), ("assistant", x or "")]
        told = sorted(told[: len(told) - 2], key=lambda m: m[1]) + told[-2:]
        assert got[i]["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in told).encode()).hexdigest()
        assert got[i]["loss_sha256"] == hashlib.sha256((x or "").encode()).hexdigest()
    assert got[None]["n_turns"] == 1
    for x in hostile:
        written, flat = op09_chat.format_turn("assistant", [{"type": "text", "text": x}])
        assert op09_chat.read_turn(written, flat.loss) == ("assistant", x or "", x or "")
        assert sum(written.count(c) for c in op09_chat.CONTROL) == 3


def test_content_parts_become_ordered_placeholders():
    parts = [
        {"type": "text", "text": "see <|image|>"}, {"type": "image", "ref": "a.png", "width": 1024, "height": 512}, None,
        {"type": "audio", "ref": "b.wav", "seconds": 2}, {"type": "document", "ref": "c.pdf", "text": "x" * 400}, {"type": "text", "text": "done"},
    ]
    written, flat = op09_chat.format_turn("assistant", parts)
    assert [(x["kind"], x["ref"], x["tokens"]) for x in flat.attachments] == [("image", "a.png", 512), ("audio", "b.wav", 100), ("document", "c.pdf", 100)]
    assert all(written[x["at"] :].startswith(op09_chat.PLACES[x["kind"]]) for x in flat.attachments)
    assert flat.tokens == 712 and "".join(op09_chat.unescape(written[a:b]) for a, b in flat.loss) == "see <|image|>done"


def test_toxic_texts_are_told_apart(spark):
    rude = ["worthless", "pathetic", "disgusting"]
    rows, labels = [], []
    for i in range(600):
        w = words(60, i)
        toxic = i % 4 == 0
        for k in range(3, 60, 8) if toxic else ():
            w[k] = rude[(i + k) % 3]
        rows.append((i, " ".join(w), "en", "s", 1))
        labels.append((i, 1, int(toxic)))
    docs = extra(spark.createDataFrame([*rows, (900, None, None, None, None), (901, "", None, None, None), (None, "x", None, None, None)], DOCS))
    known = spark.createDataFrame([*labels, (901, 1, None)], "doc_id bigint, quality int, toxic int")
    model = op10_toxicity.fit(docs, known)
    got = {r["doc_id"]: r["score"] for r in op10_toxicity.scores(docs, model).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == (i % 4 == 0) for i in held]) > 0.97
    assert got[900] == got[901] < 0.5
    assert op10_toxicity.without_toxic(docs, model).columns == docs.columns
    assert op10_toxicity.fit(docs, known.limit(0)) is None


def test_every_word_is_in_a_window_and_a_toxic_last_word_counts():
    for i in range(300):
        rng = np.random.default_rng(i)
        w = ["".join(rng.choice(list("abcdefgh"), rng.integers(1, 12))) + f"q{k}" for k in range(rng.integers(1, 40))]
        found = op10_toxicity.windows(" ".join(w))
        assert [x for x in w if not any(x.encode() in f.split() for f in found)] == []
    base = " ".join(words(400, 7)).encode()
    plain, marked = op10_toxicity.compressor(base), op10_toxicity.compressor(b" disgusting" + base)
    for i in range(20):
        # Ten words of five letters fill a window; the word behind them is a last run of 17 bytes.
        text = " ".join(words(10, 900 + i))
        assert op10_toxicity.gains(text + " disgusting", plain, marked)[0] > op10_toxicity.gains(text, plain, marked)[0] + 2


def test_pipeline_stages_keep_their_contract(spark):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "repeated_passages", "decontamination", "encoding"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == list(corpus_pipeline.COLUMNS), name
        assert stage(spark, docs.limit(0), SF).count() == 0
    done = corpus_pipeline.run(spark, SF)
    assert 0 < done.count() <= docs.count() and done.columns == ["doc_id", "n_tokens", "ids"]


def test_every_operator_has_its_query():
    assert [q.split("_")[0] for q in queries.QUERIES] == [*(f"op{i}" for i in range(1, 11)), "pipeline"]


def test_adjacent_text_parts_bring_in_no_control_string():
    for cut in (["<|done", "|><|tu", "rn|>"], ["</", "s>", "\\", "<"], ["<|im", None, "_start|>"]):
        parts = [{"type": "text", "text": x} for x in cut]
        written, flat = op09_chat.format_turn("assistant", parts)
        whole = "".join(x or "" for x in cut)
        assert op09_chat.read_turn(written, flat.loss) == ("assistant", whole, whole)
        assert sum(written.count(c) for c in op09_chat.CONTROL) == 3


def test_odd_parts_are_defined():
    parts = [
        {"type": "video", "ref": "v", "text": "x" * 40}, {"type": "image", "width": "wide", "height": -3}, None, {},
        {"type": "audio", "seconds": float("nan")}, "plain", {"type": 7, "tokens": "12"}, {"text": 5},
    ]
    written, flat = op09_chat.format_turn("user", parts)
    assert [(x["kind"], x["tokens"]) for x in flat.attachments] == [("document", 10), ("image", 256), ("audio", 50), ("document", 12)]
    assert op09_chat.read_turn(written, flat.loss)[1].endswith("plain<|document|>5")
    assert op09_chat.format_turn(None, [])[1].tokens == 0


def test_rows_without_an_id_are_in_no_class(spark):
    text = " ".join(words(80, 31))
    docs = spark.createDataFrame([(1, text, None, None, 0), (2, text, None, None, 0), (None, text, None, None, 0)], DOCS)
    got = {r["doc_id"]: r["class_id"] for r in op06_minhash.classes(docs).collect()}
    assert got == {1: 1, 2: 1, None: None}
    assert sorted((r["doc_id"] for r in op06_minhash.keep_one(docs).collect()), key=str) == [1, None]
