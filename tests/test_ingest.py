"""URLs, deduplication, cleaning and writers."""

import html
import random

import pytest
from pyspark.sql import functions as F

from newsloom.functions import urls
from newsloom.operators import cleaning, ingest
from newsloom.sources import sinks


@pytest.mark.parametrize(
    "raw, canonical",
    [
        ("HTTPS://User@Example.COM:443/a?utm_source=x&b=2&a=1#top", "https://example.com/a?a=1&b=2"),
        ("http://example.com:8080", "http://example.com:8080/"),
        (" http://example.com:80/x?q=a+b%20c&q=~*&empty= ", "http://example.com/x?empty=&q=a+b+c&q=~%2A"),
        ("https://example.com/?UTM_Medium=1&fbclid=2", "https://example.com/"),
        ("https://example.com/p?flag&&z=1", "https://example.com/p?flag=&z=1"),
        ("https://example.com/p?x=a=b", "https://example.com/p?x=a%3Db"),
        ("https://example.com/p?x=100%", "https://example.com/p?x=100%25"),
        ("https://example.com/p?x=%C3%A9", "https://example.com/p?x=%C3%A9"),
    ],
)
def test_canonical_urls(spark, raw, canonical):
    got = spark.createDataFrame([(raw,)], "url string").select(urls.canonicalize(F.col("url")).alias("c")).first()["c"]
    assert got == canonical


def keep_in_order(items, stored):
    seen_urls = {u for u, _, _ in stored}
    seen_guids = {(s, g) for _, s, g in stored if g is not None}
    kept = []
    for order, u, s, g in items:
        if u in seen_urls or (g is not None and (s, g) in seen_guids):
            continue
        kept.append(order)
        seen_urls.add(u)
        if g is not None:
            seen_guids.add((s, g))
    return kept


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_feed_dedup_equals_the_sequential_rule(spark, seed):
    rng = random.Random(seed)
    def key():
        return f"u{rng.randint(0, 25)}", rng.randint(0, 2), rng.choice([None, *[f"g{i}" for i in range(12)]])
    items = [(i, *key()) for i in range(120)]
    items += [(200 + i, "hot", 0, None) for i in range(60)]
    stored = [key() for _ in range(4)]
    schema = "url_hash string, source_id int, guid string"
    out = ingest.dedup_feed_items(
        spark.createDataFrame(items, "item_order bigint, " + schema), spark.createDataFrame(stored, schema)
    )
    assert sorted(r["item_order"] for r in out.filter("kept").collect()) == keep_in_order(items, stored)
    assert out.count() == len(items)


def clean(spark, text):
    return spark.createDataFrame([(text,)], "text string").select(cleaning.clean_text(F.col("text")).alias("t")).first()["t"]


def test_cleaning_lines(spark):
    text = "\n".join([
        "Home", "![logo](https://x.example/a.png)", "A [linked](https://x.example/b) sentence stays here.",
        "3:45", "1:02:03", "Watch: the clip", "Read more", "read more", "Related stories:", "  A long line that is repeated twice here ",
        "A long line that is repeated twice here", "", "Sign in",
    ])
    long = "A long line that is repeated twice here"
    assert clean(spark, text) == f"A linked sentence stays here.\n\n{long}\n\n{long}"
    assert clean(spark, "") == "" and clean(spark, "Home\nNews") == ""


def test_html_chrome_is_pruned(spark):
    html = (
        "<html><head><title>A &amp; B</title><style>x</style></head><body><nav><p>menu</nav><div class='x Related-Content'>gone<div>too</div></div>"
        "<main><p>Kept <b>bold</b> text.<p>Second.<br>Third</main><div role=navigation>gone</div><footer>gone</footer></body></html>"
    )
    row = cleaning.prune_html(spark.createDataFrame([(1, html), (2, None)], "page_id bigint, html string")).orderBy("page_id").collect()
    assert (row[0]["title"], row[0]["text"]) == ("A & B", "Kept bold text.\nSecond.\nThird")
    assert row[1]["text"] == ""


def test_media_pages(spark):
    cases = [("https://x.example/video/1", "t", True), ("https://x.example/videos-of", "t", False), ("https://x.example/a", "Watch live: x", True),
             ("https://x.example/a", "The live stream", True), ("https://x.example/a", "How we watch", False), ("https://x.example/LIVE", None, True)]
    df = spark.createDataFrame(cases, "url string, title string, want boolean")
    rows = df.select(ingest.is_media_page(F.col("url"), F.col("title")).alias("got"), "want").collect()
    assert all(r["got"] == r["want"] for r in rows)


def test_gate_and_content_dedup(spark):
    gated = ingest.extraction_gate(spark.createDataFrame([(1, "a b c"), (2, "a"), (3, "")], "article_id bigint, content string"), 2)
    assert [(r["status"], r["reason"]) for r in gated.orderBy("article_id").collect()] == [
        ("extracted", None), ("failed", "too_few_words"), ("failed", "no_text")]
    arts = spark.createDataFrame([(1, "extracted", "h"), (2, "extracted", "h"), (3, "failed", "h"), (4, "extracted", None), (5, "extracted", "k")],
                                 "article_id bigint, status string, content_hash string")
    out = ingest.content_dedup(arts, arts.filter("article_id > 1")).orderBy("article_id").collect()
    assert [tuple(r) for r in out] == [(2, "duplicate", 1), (5, "extracted", None)]


def test_lists_are_stored_once_unless_regenerated(spark, tmp_path):
    folder = str(tmp_path / "lists")
    def items(*rows):
        return spark.createDataFrame(rows, "user_id bigint, list_date string, rank int").withColumn("list_date", F.to_date("list_date"))
    def stored():
        return sorted((r["user_id"], str(r["list_date"]), r["rank"]) for r in sinks.read_lists(spark, folder, items((0, "2024-01-01", 0))).collect())
    sinks.persist_list(items((1, "2024-01-01", 1), (1, "2024-01-02", 1)), folder)
    sinks.persist_list(items((1, "2024-01-01", 5), (2, "2024-01-01", 1)), folder)
    assert stored() == [(1, "2024-01-01", 1), (1, "2024-01-02", 1), (2, "2024-01-01", 1)]
    sinks.persist_list(items((1, "2024-01-01", 7)), folder, regenerate=True)
    assert stored() == [(1, "2024-01-01", 7), (1, "2024-01-02", 1), (2, "2024-01-01", 1)]


def test_all_character_references_in_one_pass(spark):
    texts = [
        "caf&eacute; &#8364;5 &copy; 2024", "&amp;lt; stays &lt;", "a&nbsp;&nbsp;b", "&notit; &not &AMP &ampx", "&#x1F600; &#128;",
        "&Aring;&szlig;&ntilde;&uuml;&ouml;&auml;&euro;&pound;&yen;&sect;&deg;&frac12;&times;&divide;&laquo;&raquo;&bull;&trade;&rarr;&NotEqualTilde;",
        "<b>bold</b>&middot;text", "no reference & a bare sign", "", None,
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(ingest.plain_text(F.col("t"))).collect()]
    want = [" ".join(html.unescape((t or "").replace("<b>", " ").replace("</b>", " ")).split()) or None for t in texts]
    assert got == want


def test_dedup_of_a_long_chain_settles(spark):
    """Items linked by url and guid in turn are settled one per round, however many they are."""
    n = 66
    rows = [(i, f"u{(i + 1) // 2}", 1, f"g{i // 2}") for i in range(n)]
    df = spark.createDataFrame(rows, "item_order bigint, url_hash string, source_id bigint, guid string")
    kept = {r["item_order"]: r["kept"] for r in ingest.dedup_feed_items(df).collect()}
    assert kept == {i: i % 2 == 0 for i in range(n)}


def test_dedup_without_an_order_is_an_error(spark):
    df = spark.createDataFrame([(None, "u", 1, "g")], "item_order bigint, url_hash string, source_id bigint, guid string")
    with pytest.raises(ValueError, match="item_order"):
        ingest.dedup_feed_items(df)
