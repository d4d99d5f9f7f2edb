"""Clusters, chunks, retrieval, claims, supplements and metrics against plain loops."""

import math
import random
import re
from collections import Counter
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.functions.text import PIECE, SPACE, SPACE_CHARACTERS, collapse, strip
from newsloom.operators import clustering, evidence, grounding, neighbours, quality, reports, retrieval
from newsloom.settings import Settings

S = Settings()


def vectors(seed, n, dim=8, centres=6, noise=0.25):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(centres, dim))
    return [[float(x) for x in base[i % centres] + rng.normal(size=dim) * noise] for i in range(n)]


def cos(a, b):
    a, b = np.array(a), np.array(b)
    d = np.linalg.norm(a) * np.linalg.norm(b)
    return float(a @ b / d) if d else 0.0


@pytest.mark.parametrize("block_bytes", [1 << 20, 700])
def test_nearest_is_exact_both_ways(spark, block_bytes):
    q, t = vectors(1, 40), vectors(2, 30)
    models = ["a", "b"]
    qs = spark.createDataFrame([(i, models[i % 2], v) for i, v in enumerate(q)], "query_id bigint, model string, vector array<double>")
    ts = spark.createDataFrame([(i, models[i % 2], v) for i, v in enumerate(t)], "target_id bigint, model string, vector array<double>")
    got = {}
    for r in sorted(neighbours.nearest(qs, ts, 3, block_bytes).collect(), key=lambda r: (r[0], -r[2], r[1])):
        got.setdefault(r["query_id"], []).append(r["target_id"])
    for i, v in enumerate(q):
        same = [(-cos(v, w), j) for j, w in enumerate(t) if j % 2 == i % 2]
        assert got[i] == [j for _, j in sorted(same)[:3]]


def test_nearest_of_ties_zero_vectors_and_missing_models(spark):
    t = vectors(4, 25) + [[0.0] * 8] * 4 + [vectors(4, 25)[3]] * 9
    q = vectors(4, 12) + [[0.0] * 8, None, vectors(4, 25)[3], [-x for x in vectors(4, 25)[5]]]
    qs = spark.createDataFrame(
        [(i, None if i == 1 else "lonely" if i == 2 else "m", v) for i, v in enumerate(q)],
        "query_id bigint, model string, vector array<double>")
    ts = spark.createDataFrame(
        [(j, "m", v) for j, v in enumerate(t)] + [(99, "m", None), (98, None, t[0])],
        "target_id bigint, model string, vector array<double>")
    for block_bytes in (1 << 20, 500):
        got = {}
        for r in neighbours.nearest(qs, ts, 4, block_bytes).collect():
            got.setdefault(r["query_id"], set()).add(r["target_id"])
        want = {}
        for i, v in enumerate(q):
            if v is not None and i not in (1, 2):
                want[i] = {j for _, j in sorted((-round(cos(v, w), 12), j) for j, w in enumerate(t))[:4]}
        assert got == want
    assert neighbours.nearest(qs, ts.limit(0), 4).isEmpty() and neighbours.nearest(qs.limit(0), ts, 4).isEmpty()
    near = neighbours.nearest(qs, ts, 1, at_least=0.9).filter("similarity >= 0.9").collect()
    assert {r["query_id"] for r in near} == {
        i for i, v in enumerate(q) if v is not None and i not in (1, 2) and max(cos(v, w) for w in t) >= 0.9}


def test_cells_compare_few_of_all_pairs(spark):
    vs = vectors(11, 3000, dim=32, centres=60, noise=0.05)
    df = spark.createDataFrame([(i, "m", v) for i, v in enumerate(vs)], "id bigint, model string, vector array<double>")
    met, _ = neighbours.meeting(df.withColumnRenamed("id", "query_id"), df, 3)
    assert 0 < met.compared < 0.1 * 3000**2
    _, cells, _ = clustering.bordered(df, 0.9)
    assert 0 < clustering.pairs_compared(cells) < 0.1 * 3000 * 2999 / 2


@pytest.mark.parametrize("block_bytes", [1 << 20, 900])
def test_graph_clusters_are_the_components(spark, block_bytes):
    vs = vectors(3, 60, noise=0.6) + [vectors(3, 60, noise=0.6)[0]] * 20 + [[0.0] * 8, [0.0] * 8]
    cut = 0.85
    label = list(range(len(vs)))
    changed = True
    while changed:
        changed = False
        for i in range(len(vs)):
            for j in range(len(vs)):
                if cos(vs[i], vs[j]) >= cut and label[j] > label[i]:
                    label[j], changed = label[i], True
    df = spark.createDataFrame(list(enumerate(vs)), "article_id bigint, vector array<double>")
    got = {r["article_id"]: r["cluster_id"] for r in clustering.graph_cluster(df, cut, block_bytes=block_bytes).collect()}
    assert got == dict(enumerate(label))


def shuffled_rows(df):
    """Rows that an exchange below a Python group function takes in."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = df._jdf.queryExecution().executedPlan()
        df._jdf.queryExecution().toRdd().count()
        found, todo = [], [plan]
        while todo:
            node = todo.pop()
            if node.nodeName() == "Exchange":
                found.append(node.metrics().apply("shuffleRecordsWritten").value())
            children = node.children()
            todo += [children.apply(i) for i in range(children.length())]
        return sum(found)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_rows_travel_once_a_block_not_once_a_cell(spark):
    vs = vectors(5, 900, dim=64, centres=900)
    df = spark.createDataFrame([(i, "m", v) for i, v in enumerate(vs)], "id bigint, model string, vector array<double>")
    near = neighbours.nearest(df.withColumnRenamed("id", "query_id"), df.withColumnRenamed("id", "target_id"), 3, 16 << 10)
    edges = clustering.similar_edges(df, 0.4, 16 << 10)
    assert shuffled_rows(near) < 8 * 900
    assert shuffled_rows(edges) < 2 * 900


@pytest.mark.parametrize("part_bytes", [640, 3000])
def test_many_blocks_find_the_same(spark, part_bytes):
    vs = vectors(6, 150, noise=0.5) + [vectors(6, 1)[0]] * 5 + [[0.0] * 8] * 2 + vectors(7, 60, centres=1, noise=0.01)
    df = spark.createDataFrame([(i * 8, "ab"[i % 2], v) for i, v in enumerate(vs)], "id bigint, model string, vector array<double>")
    qs, ts = df.withColumnRenamed("id", "query_id"), df.withColumnRenamed("id", "target_id")
    got = {}
    for r in neighbours.nearest(qs, ts, 3, 200, part_bytes=part_bytes).collect():
        got.setdefault(r["query_id"], set()).add(r["target_id"])
    for i, v in enumerate(vs):
        same = [(-round(cos(v, w), 12), 8 * j) for j, w in enumerate(vs) if j % 2 == i % 2]
        assert got[8 * i] == {j for _, j in sorted(same)[:3]}
    components = clustering.connected_components(df.select("id"), clustering.similar_edges(df, 0.9, 200, part_bytes))
    label, changed = list(range(len(vs))), True
    linked = [[j for j in range(i % 2, len(vs), 2) if cos(vs[i], vs[j]) >= 0.9] for i in range(len(vs))]
    while changed:
        changed = False
        for i, near in enumerate(linked):
            low = min([label[i], *[label[j] for j in near]])
            changed |= low < label[i]
            label[i] = low
    assert {r["id"]: r["component"] for r in components.collect()} == {8 * i: 8 * c for i, c in enumerate(label)}


def plain_prune(members, centroid, cap, cut):
    if len(members) <= cap:
        return {a for a, _, _ in members}
    rel = {a: cos(v, centroid) for a, _, v in members}
    best = {}
    for a, p, v in sorted(members, key=lambda m: (-rel[m[0]], m[0])):
        best.setdefault(p, (a, v))
    kept = sorted(best.values(), key=lambda m: (-rel[m[0]], m[0]))[:cap]
    while len(kept) < cap:
        options = []
        for a, _, v in members:
            if a in {k for k, _ in kept}:
                continue
            near = max(cos(v, w) for _, w in kept)
            if near < cut:
                options.append((0.65 * rel[a] + 0.35 * (1 - near), rel[a], -a, v))
        if not options:
            break
        top = max(options, key=lambda o: o[:3])
        kept.append((-top[2], top[3]))
    return {a for a, _ in kept}


def test_pruning_equals_the_greedy_loop(spark):
    rng = random.Random(4)
    members, clusters, want = [], [], set()
    for c in range(12):
        vs = vectors(10 + c, rng.choice([3, 5, 6, 12, 30]), centres=2, noise=0.5)
        rows = [(c, 100 * c + i, rng.randint(0, rng.choice([0, 2, 8])), v) for i, v in enumerate(vs)]
        centre = [float(x) for x in np.mean([r[3] for r in rows], axis=0)]
        members += rows
        clusters.append((c, centre))
        want |= plain_prune([(a, p, v) for _, a, p, v in rows], centre, 5, 0.94)
    members.append((0, 99, 1, None))
    df = spark.createDataFrame(members, "cluster_id bigint, article_id bigint, publisher_id int, vector array<double>")
    out = clustering.prune_members(df, spark.createDataFrame(clusters, "cluster_id bigint, centroid array<double>"), S)
    assert {r["article_id"] for r in out.collect() if r["relationship"] == "coverage"} == want
    assert out.count() == len(members)


def test_leader_rule_refuses_unbounded_runs(spark):
    rows = [(1, i, "m", v) for i, v in enumerate(vectors(1, 31))]
    df = spark.createDataFrame(rows, "run_id bigint, article_id bigint, model string, vector array<double>")
    assert clustering.leader_cluster(df.filter("article_id < 30"), S).count() == 30
    with pytest.raises(Exception, match="at most 30"):
        clustering.leader_cluster(df, S).collect()


def test_centroid_update_equals_one_by_one(spark):
    vs = vectors(5, 9)
    mean, n = np.mean(vs[:4], axis=0), 4
    for v in vs[4:]:
        mean, n = (mean * n + np.array(v)) / (n + 1), n + 1
    old = [float(x) for x in np.mean(vs[:4], axis=0)]
    clusters = spark.createDataFrame([(1, old, 4), (2, old, 4)], "cluster_id bigint, centroid array<double>, n_members bigint")
    added = spark.createDataFrame([(1, v) for v in vs[4:]], "cluster_id bigint, vector array<double>")
    rows = {r["cluster_id"]: r for r in clustering.centroid_update(clusters, added).collect()}
    assert rows[1]["centroid"] == pytest.approx(list(mean)) and rows[1]["n_members"] == 9
    assert rows[2]["centroid"] == pytest.approx(old)


def plain_windows(text, target, overlap):
    found = list(re.finditer(r"\S+", text))
    out = []
    for at in range(0, len(found), max(1, target - overlap)):
        end = min(len(found), at + target)
        out.append((text[found[at].start():found[end - 1].end()], found[at].start(), found[end - 1].end()))
        if end == len(found):
            break
    return out


@pytest.mark.parametrize("target, overlap", [(10, 2), (10, 0), (3, 5), (800, 100)])
def test_windows_slice_back(spark, target, overlap):
    rng = random.Random(6)
    texts = ["", " \n ", "one", " lead and trail  "]
    texts += ["".join(rng.choice(["a", "é", "😀", "word", " ", "\n", " "]) for _ in range(200)) for _ in range(12)]
    texts.append(" ".join(f"w{i}" for i in range(25)))
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    rows = df.select("id", F.inline(retrieval.windows(F.col("text"), target, overlap))).collect()
    for i, text in enumerate(texts):
        mine = sorted((r for r in rows if r["id"] == i), key=lambda r: r["chunk_index"])
        assert [(r["chunk_text"], r["character_start"], r["character_end"]) for r in mine] == plain_windows(text, target, overlap)
        assert all(r["chunk_words"] == len(r["chunk_text"].split()) for r in mine)


def test_coverage_first_equals_the_loop(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for g in range(25):
        chunks = [(g, rng.randint(0, 6), 100 * g + i, float(rng.randint(0, 9))) for i in range(rng.randint(1, 30))]
        rows += chunks
        ranked = sorted(chunks, key=lambda c: (-c[3], c[2]))
        first = {}
        for c in ranked:
            first.setdefault(c[1], c)
        picked = list(first.values())[:5]
        picked += [c for c in ranked if c not in picked][: 5 - len(picked)]
        want[g] = [c[2] for c in picked]
    df = spark.createDataFrame(rows, "g int, unit int, id int, score double")
    out = retrieval.coverage_first_topk(df, ["g"], ["unit"], [F.desc("score"), F.asc("id")], 5)
    got = {g: [] for g in want}
    for r in sorted(out.collect(), key=lambda r: (r["g"], r["rank"])):
        got[r["g"]].append(r["id"])
    assert got == want


def test_bm25_of_one_group(spark):
    docs = [(1, 1, "the cat sat"), (1, 2, "cat cat dog"), (1, 3, ""), (2, 9, "other cat")]
    out = retrieval.bm25(
        spark.createDataFrame(docs, "g int, id int, text string"),
        spark.createDataFrame([(1, "Cat? bird cat"), (2, "none")], "g int, text string"), ["g"], ["id"],
    )
    got = {r["id"]: r["score"] for r in out.collect()}
    idf = math.log(1 + (3 - 2 + 0.5) / 2.5)
    def weight(tf, dl):
        return idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / 2))
    assert got == pytest.approx({1: weight(1, 3), 2: weight(2, 3), 3: 0.0, 9: 0.0})


def test_best_excerpt_is_the_best_window(spark):
    text = " ".join(["filler"] * 400 + ["needle thread"] + ["filler"] * 500)
    docs = [(1, text, "Needle!"), (2, "short text", "absent"), (3, None, "x"), (4, text, None), (5, "", "x")]
    out = retrieval.best_excerpt(spark.createDataFrame(docs, "doc_id int, text string, query string"), 100)
    got = {r["doc_id"]: (r["chunk_index"], "needle" in r["excerpt"]) for r in out.collect()}
    assert got[1][1] and got[2] == (0, False) and got[4] == (0, False) and set(got) == {1, 2, 4}


def test_excerpt_windows_are_cut_once(spark):
    docs = spark.createDataFrame([(1, "a b", "a")], "doc_id int, text string, query string")
    plan = retrieval.best_excerpt(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(text") == 1


def test_pieces_and_spaces_equal_the_plain_patterns(spark):
    rng = random.Random(5)
    rows = [("".join(rng.choices(list(SPACE_CHARACTERS) + list("  \n\nabZ!~äßж\u200b\u0000\U0001f600"), k=rng.randrange(25))),) for _ in range(3000)]
    df = spark.createDataFrame(rows, "text string").select(
        F.regexp_extract_all("text", F.lit(PIECE), F.lit(0)).alias("a"),
        F.regexp_extract_all("text", F.lit(f"[{SPACE}]*[^{SPACE}]+"), F.lit(0)).alias("b"),
        collapse(F.col("text")).alias("c"), strip(F.regexp_replace("text", f"[{SPACE}]+", " ")).alias("d"))
    assert df.filter("a <> b or c <> d").isEmpty() and df.filter("size(a) > 3").count() > 100


def test_pairs_of_a_hot_story_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(evidence, "PAIR_BLOCK", 16)
    claims = [(1 if i % 3 else 2, i % 7, i, f"term{i % 11} word{i % 5}", [1.0, float(i % 4)] if i % 6 else None) for i in range(210)]
    members = [(c, a, a % 3, "coverage" if a != 6 else "redundant") for c in (1, 2) for a in range(7)]
    got = evidence.claim_pairs(
        spark.createDataFrame(claims, "cluster_id int, article_id int, claim_id int, claim_text string, vector array<double>"),
        spark.createDataFrame(members, "cluster_id int, article_id int, publisher_id int, relationship string"))
    want = {
        (x[0], x[2], y[2]) for x in claims for y in claims
        if x[0] == y[0] and (x[1], x[2]) < (y[1], y[2]) and x[1] != y[1] and x[1] % 3 != y[1] % 3 and 6 not in (x[1], y[1])
    }
    rows = [(r["cluster_id"], r["left_claim_id"], r["right_claim_id"]) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_representative_prefers_linked_claims(spark):
    claims = spark.createDataFrame([(1, 10, 1, 0.9), (1, 20, 2, 0.8), (1, 30, 3, 0.99)], "cluster_id int, article_id bigint, claim_id bigint, confidence double")
    pairs = spark.createDataFrame([(1, 1, 2), (1, 2, 3)], "cluster_id int, left_claim_id bigint, right_claim_id bigint")
    links = spark.createDataFrame([(1, 1, 2, "equivalent", 0.9), (1, 2, 3, "supports", 0.8)],
                                  "cluster_id int, left_claim_id bigint, right_claim_id bigint, relationship string, confidence double")
    words = spark.createDataFrame([(10, 500), (20, 400), (30, 900)], "article_id bigint, word_count int")
    row = evidence.choose_representative(evidence.article_evidence(claims, pairs, links), words).first()
    assert row["representative_article_id"] == 20
    assert row["selection_reason"] == "evidence_score=3.200, extracted_claims=1, word_count=400"


def test_ledger_wastes_a_slot_on_a_repeat(spark):
    area = grounding.COVERAGE_AREAS[0]
    decisions = spark.createDataFrame(
        [(1, 1, area, True, [5, 5, 6, 7]), (1, 2, area, True, [8, 9]), (1, 3, area, False, [4]), (1, 4, area, True, None)],
        "run_id bigint, iteration int, area string, needed boolean, evidence_ids array<bigint>",
    )
    known = spark.createDataFrame([(1, i) for i in range(4, 9)], "run_id bigint, evidence_id bigint")
    ledger = grounding.coverage_ledger(decisions, known, S)
    row = ledger.first()
    assert row["evidence_ids"] == [5, 6, 8] and row["satisfied"]
    assert grounding.ledger_status(ledger, S).first()["status"] == "satisfied"


def test_statements_skip_what_does_not_fit(spark):
    rows = [(1, 0, 0, "context", "a b c d", [1]), (1, 0, 1, "context", "e f g h", [1]), (1, 1, 0, "context", "i j", [2]), (1, 1, 1, "context", "k", [3])]
    statements = spark.createDataFrame(rows, "run_id bigint, card_index bigint, statement_index bigint, card_type string, text string, evidence_ids array<bigint>")
    checks = statements.select("run_id", "card_index", "statement_index", F.lit(True).alias("supported"), "evidence_ids")
    known = spark.createDataFrame([(1, 1), (1, 2)], "run_id bigint, evidence_id bigint")
    kept = grounding.supported_statements(statements, checks, known, spark.createDataFrame([(1, 6)], "run_id bigint, word_budget int"))
    assert [(r["card_index"], r["statement_index"]) for r in kept.collect()] == [(0, 0), (1, 0)]


def test_cluster_metrics_of_merged_clusters(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("b", 1)], "expected string, predicted int")
    row = quality.pairwise_cluster_metrics(df).first()
    assert (row["recall"], row["precision"]) == (1.0, pytest.approx(1 / 3))
    assert quality.purity(df).first()["purity"] == 0.5


def test_claim_recall_is_one_to_one(spark):
    expected = spark.createDataFrame([(1, 1, ["fire"]), (1, 2, ["fire", "north"]), (1, 3, ["flood"])], "article_id bigint, expected_id bigint, required_terms array<string>")
    predicted = spark.createDataFrame([(1, 1, "Fire in the  North", "x"), (1, 2, "a fire", "x")], "article_id bigint, claim_id bigint, claim_text string, excerpt string")
    row = quality.claim_recall(expected, predicted).first()
    assert (row["n_matched"], row["recall"], row["match_precision"]) == (1, pytest.approx(1 / 3), 0.5)


def test_claim_recall_equals_the_walk_over_all_pairs(spark):
    rng = random.Random(8)
    words = ["red", "green", "blue", "gre", "sky", ""]
    expected = [(a, i % 25, rng.choice([None, [], [rng.choice(words), None], rng.choices(words, k=1), rng.choices(words, k=2)]))
                for a in (1, 2, 3, None) for i in range(30)]
    predicted = [(a, i, " ".join(rng.choices(words, k=2)).title(), rng.choice([None, "x  sky"])) for a in (1, 2, 4, None) for i in range(20)]
    want = {}
    for a in (1, 2, 3, None):
        own = [r for r in expected if r[0] == a]
        said = [] if a is None else [(c, " ".join(" ".join(x for x in (t, e) if x is not None).lower().split())) for b, c, t, e in predicted if b == a]
        taken = set()
        for e in sorted({r[1] for r in own}):
            free = [c for c, x in said if c not in taken and any(
                r[2] is not None and None not in r[2] and all(t in x for t in r[2]) for r in own if r[1] == e)]
            taken |= set(free[:1])
        want[a] = (len(own), len(said), len(taken))
    out = quality.claim_recall(
        spark.createDataFrame(expected, "article_id bigint, expected_id bigint, required_terms array<string>"),
        spark.createDataFrame(predicted, "article_id bigint, claim_id bigint, claim_text string, excerpt string"))
    assert {r["article_id"]: (r["n_expected"], r["n_predicted"], r["n_matched"]) for r in out.collect()} == want


def test_claim_recall_of_a_long_article_makes_no_pairs(spark):
    n = 3000
    rows = spark.createDataFrame([(1, i) for i in range(n)], "article_id bigint, id bigint")
    expected = rows.select("article_id", F.col("id").alias("expected_id"), F.array(F.lit("common")).alias("required_terms"))
    predicted = rows.select("article_id", F.col("id").alias("claim_id"), F.lit("Common words").alias("claim_text"), F.lit("x").alias("excerpt"))
    out = quality.claim_recall(expected, predicted)
    assert out.first()["n_matched"] == n
    assert shuffled_rows(out) <= 2 * n and "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_range_join_includes_both_ends(spark):
    def at(df):
        return df.withColumns({c: F.to_timestamp_ntz(c) for c in df.columns if c.endswith("_at")})
    runs = at(spark.createDataFrame([(1, "2024-01-01 00:59:00", "2024-01-01 02:00:00"), (2, "2024-01-01 02:00:00", None)], "run_id int, started_at string, completed_at string"))
    rows = at(spark.createDataFrame([(1, "2024-01-01 00:58:59"), (2, "2024-01-01 00:59:00"), (3, "2024-01-01 02:00:00"), (4, "2024-01-01 02:00:01")], "id int, created_at string"))
    assert sorted((r["run_id"], r["id"]) for r in reports.during_runs(rows, runs).collect()) == [(1, 2), (1, 3)]


def test_small_clusters_are_kept_whole_with_larger_caps(spark):
    df = spark.createDataFrame([(1, i, 0, v) for i, v in enumerate(vectors(1, 4))], "cluster_id bigint, article_id bigint, publisher_id int, vector array<double>")
    centre = spark.createDataFrame([(1, vectors(1, 1)[0])], "cluster_id bigint, centroid array<double>")
    out = clustering.prune_members(df, centre, replace(S, cluster_max_articles=4))
    assert {r["relationship"] for r in out.collect()} == {"coverage"}


def test_statement_budget_equals_the_plain_walk(spark):
    rng = random.Random(9)
    rows, budgets, want = [], [], {}
    for run in range(20):
        budget, used, kept = rng.randint(0, 25), 0, []
        for card in range(4):
            for at in range(rng.randint(0, 6)):
                n = rng.randint(1, 9)
                rows.append((run, card, at, "context", " ".join(["w"] * n), [1]))
                if used + n <= budget:
                    used += n
                    kept.append((card, at))
        budgets.append((run, budget))
        want[run] = kept
    statements = spark.createDataFrame(
        rows, "run_id bigint, card_index bigint, statement_index bigint, card_type string, text string, evidence_ids array<bigint>"
    )
    checks = statements.select("run_id", "card_index", "statement_index", F.lit(True).alias("supported"), "evidence_ids")
    known = spark.createDataFrame([(r, 1) for r in range(20)], "run_id bigint, evidence_id bigint")
    out = grounding.supported_statements(
        statements, checks, known, spark.createDataFrame(budgets, "run_id bigint, word_budget int")
    ).collect()
    for run, kept in want.items():
        assert sorted((r["card_index"], r["statement_index"]) for r in out if r["run_id"] == run) == kept


def test_a_capped_worklist_goes_on_in_the_next_run(spark):
    inputs = spark.createDataFrame([(1, i, f"h{i}") for i in range(50)], "run_id bigint, article_id bigint, input_hash string")
    cached = spark.createDataFrame([("m", i, f"h{i}") for i in range(30)], "model string, article_id bigint, input_hash string")
    assert clustering.inference_worklist(inputs, cached, "m").count() == 20
    capped = clustering.inference_worklist(inputs, cached, "m", cap=5).orderBy("article_id").collect()
    assert [r["article_id"] for r in capped] == [30, 31, 32, 33, 34]


def test_only_news_with_a_vector_is_clustered_and_models_do_not_meet(spark):
    v, w = [1.0, 0.0], [0.99, 0.1]
    rows = [(1, "m1", v, True), (2, "m1", w, True), (3, "m2", v, True), (4, "m1", None, True), (5, "m1", v, False), (6, "m1", v, None)]
    df = spark.createDataFrame(rows, "article_id bigint, model string, vector array<double>, is_news boolean")
    got = {r["article_id"]: r["cluster_id"] for r in clustering.graph_cluster(df, 0.9).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: None, 5: None, 6: None}
    known = spark.createDataFrame([(9, "m1", v, 1)], "cluster_id bigint, model string, centroid array<double>, d int").withColumn(
        "event_date", F.lit("2024-01-02").cast("date"))
    members = spark.createDataFrame([], "article_id bigint, cluster_id bigint")
    placed = clustering.assign_to_centroids(df, known, members, S, F.lit("2024-01-03").cast("timestamp_ntz"))
    assert {r["article_id"]: r["cluster_id"] for r in placed.collect()} == {1: 9, 2: 9, 3: None, 4: None, 5: None, 6: None}


def test_streamed_members_keep_their_similarity(spark, tmp_path):
    from newsloom.streaming import jobs
    from newsloom.streaming.store import BatchLog, VersionedTable

    centroids = VersionedTable(f"{tmp_path}/centroids", jobs.CENTROIDS)
    members = BatchLog(f"{tmp_path}/members", jobs.MEMBERS)
    each = jobs.cluster_batches(centroids, members, S, F.lit("2024-01-03").cast("timestamp_ntz"))
    schema = "article_id bigint, model string, vector array<double>, event_date date"
    day = __import__("datetime").date(2024, 1, 2)
    first = [(1, "m1", [1.0, 0.0], day), (2, "m1", [0.8, 0.6], day), (3, "m2", [1.0, 0.0], day), (4, "m1", None, day)]
    each(spark.createDataFrame(first, schema), 0)
    each(spark.createDataFrame(first, schema), 0)  # a replayed batch leaves the same state
    each(spark.createDataFrame([(5, "m2", [0.9, 0.1], day)], schema), 1)
    got = {r["article_id"]: (r["cluster_id"], round(r["similarity"], 6)) for r in members.read_before(spark, 9).collect()}
    near = round(0.9 / math.hypot(0.9, 0.1), 6)
    assert got == {1: (1, 1.0), 2: (2, 1.0), 3: (3, 1.0), 5: (3, near)}
    models = {r["cluster_id"]: r["model"] for r in centroids.read(spark, 2).collect()}
    assert models == {1: "m1", 2: "m1", 3: "m2"}


def test_the_cluster_list_counts_all_members(spark):
    from types import SimpleNamespace

    from newsloom.plans.reports import l2

    clusters = spark.createDataFrame(
        [(1, "2024-01-02", "a", "complete"), (2, "2024-01-01", "b", "pending"), (3, "2024-01-01", "c", "pending")],
        "cluster_id bigint, event_date string, representative_title string, comparison_status string")
    members = spark.createDataFrame(
        [(1, 10, "coverage"), (1, 11, "redundant"), (1, 12, "coverage"), (2, 13, "coverage")],
        "cluster_id bigint, article_id bigint, relationship string")
    got = {r["cluster_id"]: r["member_count"] for r in l2(SimpleNamespace(clusters=clusters, members=members)).collect()}
    assert got == {1: 3, 2: 1, 3: 0}


def test_an_hour_that_holds_all_claims_is_spread(spark):
    rng = random.Random(4)
    second = [rng.randint(0, 3599) for _ in range(3000)]
    claims = spark.createDataFrame(list(enumerate(second)), "claim_id bigint, s int").select(
        "claim_id", (F.col("claim_id") % 3).alias("cluster_id"), (F.col("claim_id") % 5).alias("article_id"),
        F.expr("timestamp_ntz'2024-01-01 10:00:00' + make_interval(0, 0, 0, 0, 0, 0, s)").alias("created_at"),
    )
    cover = [(1, 0, 3599), (2, 100, 1800), (3, 1800, 1800), (4, 3000, 2000)]
    at = "timestamp_ntz'2024-01-01 10:00:00' + make_interval(0, 0, 0, 0, 0, 0, {})"
    runs = spark.createDataFrame(cover, "run_id bigint, a int, b int").select(
        "run_id", F.expr(at.format("a")).alias("started_at"), F.expr(at.format("b")).alias("completed_at"))
    want = {}
    for run, a, b in cover:
        for i, s in enumerate(second):
            if a <= s <= b:
                want[run, i % 3, i % 5] = want.get((run, i % 3, i % 5), 0) + 1
    got = reports.claims_per_run(claims, runs)
    assert {tuple(r)[:3]: r["extracted_claims"] for r in got.collect()} == want
    parts = claims.select(F.pmod(F.xxhash64(*claims.columns), F.lit(reports.HOUR_PARTS)).alias("p")).groupBy("p").count()
    assert parts.agg(F.max("count")).first()[0] < 300
    assert "_part" in got._jdf.queryExecution().optimizedPlan().toString()


def test_groups_meet_a_long_run_once_and_runs_are_not_broadcast(spark):
    rng = random.Random(8)
    stamps = [(i, i % 4, rng.randint(0, 6 * 86400)) for i in range(300)]
    at = "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, {})"
    claims = spark.createDataFrame(stamps, "claim_id bigint, article_id bigint, s int").select(
        "claim_id", "article_id", F.lit(1).alias("cluster_id"), F.expr(at.format("s")).alias("created_at"))
    cover = [(r, a, a + rng.choice([0, 60, 30000, 90000, 400000])) for r, a in enumerate(rng.sample(range(5 * 86400), 40))]
    cover += [(90 + i, s, s) for i, (_, _, s) in enumerate(stamps[:3])]
    runs = spark.createDataFrame(cover, "run_id bigint, a int, b int").select(
        "run_id", F.expr(at.format("a")).alias("started_at"), F.expr(at.format("b")).alias("completed_at"))
    want = Counter((r, k) for r, a, b in cover for _, k, s in stamps if a <= s <= b)
    got = reports.claims_per_run(claims, runs)
    assert {(r["run_id"], r["article_id"]): r["extracted_claims"] for r in got.collect()} == want
    assert got.count() == len(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan
    assert "Exchange" not in plan[: plan.index("SortMergeJoin [_day")]


def test_claims_of_one_vector_meet_as_one_row(spark):
    """Cosines are made per pair of articles and vectors; scores equal those of every pair of claims."""
    rng = random.Random(12)
    rows = [(1, a, 10 * a + i, " ".join(rng.sample(["a", "b", "c", "d", "e"], rng.randint(0, 4))), [float(a + 1), 1.0] if i else None)
            for a in range(4) for i in range(3)]
    claims = spark.createDataFrame(rows, "cluster_id int, article_id int, claim_id int, claim_text string, vector array<double>")
    members = spark.createDataFrame([(1, a, a, "coverage") for a in range(4)], "cluster_id int, article_id int, publisher_id int, relationship string")

    def score(x, y):
        s, t = set(x[3].split()), set(y[3].split())
        words = len(s & t) / len(s | t) if s | t else 0.0
        if x[4] is None or y[4] is None:
            return 0.2 * words
        cos = sum(p * q for p, q in zip(x[4], y[4])) / math.sqrt(sum(p * p for p in x[4]) * sum(q * q for q in y[4]))
        return 0.8 * (cos + 1) / 2 + 0.2 * words

    out = evidence.claim_pairs(claims, members)
    got = {(r["left_claim_id"], r["right_claim_id"]): r["score"] for r in out.collect()}
    assert got == pytest.approx({(x[2], y[2]): score(x, y) for x in rows for y in rows if x[1] < y[1]})
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Join Inner") and "left_terms" not in plan


def test_a_run_and_a_group_are_decided_by_two_comparisons(spark):
    """Arrays of instants are read for pairs of the result only, not for all that share a day."""
    claims = spark.createDataFrame([(1, 1, 1, "2024-01-01 10:00:00"), (2, 1, 1, "2024-01-02 10:00:00"), (3, 1, 1, "2024-01-02 10:00:00")],
                                   "claim_id bigint, cluster_id bigint, article_id bigint, t string")
    runs = spark.createDataFrame([(7, "2024-01-01 11:00:00", "2024-01-02 09:00:00"), (8, "2024-01-01 10:00:00", "2024-01-02 10:00:00")], "run_id bigint, a string, b string")
    got = reports.claims_per_run(
        claims.withColumn("created_at", F.to_timestamp_ntz("t")).drop("t"),
        runs.select("run_id", F.to_timestamp_ntz("a").alias("started_at"), F.to_timestamp_ntz("b").alias("completed_at")))
    assert [(r["run_id"], r["extracted_claims"]) for r in got.collect()] == [(8, 3)]
    above = (plan := got._jdf.queryExecution().executedPlan().toString())[: plan.index("SortMergeJoin [_day")]
    assert "filter(instants" not in above and "_before" in above
