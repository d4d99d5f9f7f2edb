"""Registered queries of the training-data operators, with SQL twins where SQL can express them.

The twins compute the columns that a contract fixes; columns that depend on a method's own
choices (a model, a robust estimate, a shard) have no SQL form and are tested by brute force.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

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
    op11_simhash,
    op12_prefix_trie,
    op13_collocations,
)
from newsloom.llm.common import crc_mod, read

VOCABULARY = "byte_bpe_50k.tiktoken"


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = op01_language.predict(docs, op01_language.fit(docs))
    return found.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op2_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op02_outliers.judged(read(spark, sf_dir, "documents")).drop("distance")


def op3_url_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op03_urls.verdicts(read(spark, sf_dir, "pages"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op04_bpe.digests(read(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op5_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op05_sharding.shards(read(spark, sf_dir, "documents"))


def op6_prob_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op06_minhash.classes(read(spark, sf_dir, "documents"))


def op7_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = op07_substring.removal(read(spark, sf_dir, "documents"))
    return rest.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op08_decontaminate.matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op9_content_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id bigint, turn bigint, role string, text string")
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return op09_chat.digests(op09_chat.format_turns(op09_chat.text_parts(turns)))


def op10_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = op10_toxicity.scores(docs, op10_toxicity.fit(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_simhash_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op12_double_array_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_prefix_trie.trie(read(spark, sf_dir, "conversations"))


def op13_misra_gries_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_collocations.collocations(read(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_language_id, op2_robust_outliers, op3_url_automaton, op4_byte_bpe, op5_sampled_splitters,
        op6_prob_minhash, op7_phrase_automata, op8_decontamination, op9_content_parts, op10_compression,
        op11_simhash_trees, op12_double_array_trie, op13_misra_gries_phrases, pipeline,
    )
}

SQL = {
    "op3_url_automaton": """
        WITH rest AS (
            SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages
        ), parts AS (
            SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest
        ), rules(verdict, h, p, n) AS (
            VALUES ('allow', 'com', '/', 1), ('block', 'example.com', '/en/', 2), ('allow', 'www.example.com', '/en/', 3),
                   ('block', 'net', '/es/', 4), ('block', 'net', '/fr/', 5)
        ), fits AS (
            SELECT page_id, h || p AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC, n) AS k
            FROM parts JOIN rules ON (host = h OR suffix(host, '.' || h)) AND starts_with(path, p)
        )
        SELECT a.page_id, a.host, a.path, b.rule, coalesce(b.verdict, CASE WHEN regexp_matches(a.host || a.path,
            '^(spam-[^/]*/|[^/]*[.]spam-[^/]*/|[^/]*casino[^/]*/|[^/]*poker[^/]*/|.*/wp-login[.]php|.*/[.][.]/)') THEN 'block' ELSE 'allow' END) AS verdict
        FROM parts a LEFT JOIN fits b ON a.page_id = b.page_id AND b.k = 1
    """,
    # crc32 by bits: an element of -1 is one shift of the remainder.
    "op12_double_array_trie": r"""
        WITH numbered AS (
            SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
            FROM conversations WHERE conv_id IS NOT NULL
        ), own AS (
            SELECT conv_id, list({'role': role, 'text': text} ORDER BY i) AS turns FROM numbered GROUP BY conv_id
        ), heads AS (
            SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(conv_id::VARCHAR, ''),
                lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
                lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END) END), 4294967295) % 4 AS h
            FROM own
        ), rebuilt AS (
            SELECT c.conv_id, list_concat(coalesce(b.turns, [])[1:c.h], c.turns[c.h + 1:]) AS turns
            FROM heads c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 20
        ), paths AS (
            SELECT conv_id, d, turns[1:d] AS path, d = len(turns) AS ends FROM rebuilt, unnest(generate_series(0, len(turns))) AS t(d)
        ), nodes AS (
            SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs,
                   sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256,
                   (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(path[d].text, '[^\x20\x09-\x0D]+')) END AS saving
            FROM paths GROUP BY path, d
        ), children AS (
            SELECT path[1:d - 1] AS path, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1
        ), full_nodes AS (
            SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM nodes n LEFT JOIN children c USING (path)
        ), below AS (
            SELECT path[1:a] AS path, sum((n_children = 0)::INT) AS n_leaves, sum(saving) AS saved_tokens
            FROM full_nodes, unnest(generate_series(0, d)) AS t(a) GROUP BY 1
        )
        SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, b.n_leaves::BIGINT AS n_leaves,
               b.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
        FROM full_nodes n JOIN below b USING (path) LEFT JOIN nodes p ON n.d > 0 AND p.path = n.path[1:n.d - 1]
    """,
    "op13_misra_gries_phrases": r"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang,
                   unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents WHERE text IS NOT NULL
        ), listed AS (
            SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
        ), counts AS (
            SELECT lang, w[i:i + k - 1] AS p, count(*) AS a
            FROM listed, unnest([1, 2, 3]) AS s(k), unnest(generate_series(1, len(w) - k + 1)) AS t(i) GROUP BY ALL
        ), totals AS (
            SELECT lang, sum(len(w))::BIGINT AS n FROM listed GROUP BY lang
        ), candidates AS (
            SELECT lang, p, a FROM counts WHERE len(p) > 1 AND a >= 10
        ), inside AS (
            SELECT lang, p[i:i + 1] AS p, max(a) AS longer FROM candidates, unnest([1, 2]) AS t(i) WHERE len(p) = 3 GROUP BY ALL
        ), cuts AS (
            SELECT c.lang, c.p, c.a, l.a AS l, r.a AS r, k, ((1000000 * c.a::HUGEINT * c.a) // (l.a::HUGEINT * r.a))::BIGINT AS score
            FROM candidates c, unnest(generate_series(1, len(c.p) - 1)) AS t(k)
            JOIN counts l ON l.lang = c.lang AND l.p = c.p[1:k] JOIN counts r ON r.lang = c.lang AND r.p = c.p[k + 1:]
        ), best AS (
            SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1
        ), ranked AS (
            SELECT b.lang, array_to_string(b.p, ' ') AS phrase, b.a, b.l, b.r, b.score,
                   row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, array_to_string(b.p, ' ')) AS rank
            FROM best b LEFT JOIN inside i USING (lang, p) WHERE i.longer IS NULL OR 100 * i.longer < 50 * b.a
        )
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
    """,
}
