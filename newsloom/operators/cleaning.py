"""Article text cleaning: residual page chrome out of lines, and out of HTML."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import LINE_END, fold, let, strip, word_count

# Lines that are navigation, not text.
NOISE_LINES = (
    "audio", "business", "culture", "documentaries", "earth", "health", "home", "live",
    "news", "save", "share", "sign in", "sport", "sports", "subscribe", "technology",
    "travel", "video", "watch live",
)
NOISE_HEADINGS = (
    "explore more", "more on this story", "more from this section", "most read",
    "related content", "related stories", "recommended stories", "top stories",
)
NOISE_PREFIXES = ("watch:", "listen:", "video:")
DURATION = r"^(?:\d{1,2}:)?\d{1,2}:\d{2}$"
MARKDOWN_IMAGE = r"(?is)!\[[^\]]*\]\s*\(\s*https?://[^)]*\)"
MARKDOWN_LINK = r"(?is)\[([^\]]*)\]\s*\(\s*https?://[^)]*\)"

# Elements that hold page chrome.
NOISE_TAGS = ("nav", "footer", "aside", "form", "dialog", "script", "style", "svg", "noscript")
NOISE_ROLES = ("navigation", "complementary", "contentinfo", "dialog", "menu")
NOISE_ATTRIBUTE_PARTS = (
    "navigation", "navbar", "nav-menu", "site-menu", "sidebar", "related-content",
    "related-stories", "recommendation", "recommended", "most-read", "most-popular",
    "top-stories", "promo-list", "share-tools", "social-share", "newsletter", "subscription",
    "advertisement", "advertisement-block", "ad-slot", "ad-unit", "cookie-banner",
    "consent-banner", "media-player", "video-player",
)
ATTRIBUTES = ("id", "class", "data-component", "data-testid", "aria-label")


def clean_text(text: Column) -> Column:
    """A10. Whole-text cleaning as one map-side expression.

    Short repeated lines are found by sorting the document's own lines, so the
    text never leaves its row and cost is n log n in the number of lines.
    """
    without_images = F.regexp_replace(text, MARKDOWN_IMAGE, "")
    unlinked = F.regexp_replace(without_images, MARKDOWN_LINK, "$1")
    lines = F.filter(
        F.transform(F.split(unlinked, LINE_END), strip), lambda line: line != ""
    )
    described = F.transform(
        lines,
        lambda line, i: let(
            fold(line),
            lambda f: F.struct(
                f.alias("folded"),
                i.alias("pos"),
                line.alias("line"),
                word_count(line).alias("words"),
            ),
        ),
    )

    def noise(row: Column) -> Column:
        label = F.btrim(row["folded"], F.lit(" :"))
        prefixed = F.lit(False)
        for prefix in NOISE_PREFIXES:
            prefixed = prefixed | label.startswith(prefix)
        return (
            label.isin(*NOISE_LINES, *NOISE_HEADINGS)
            | ((F.length(row["line"]) <= 8) & row["line"].rlike(DURATION))
            | prefixed
        )

    def keep(rows: Column) -> Column:
        """Rows are sorted by folded line, so twins are neighbours."""
        def lonely(row: Column, i: Column) -> Column:
            before = F.get(rows, i - 1)["folded"]
            after = F.get(rows, i + 1)["folded"]
            twin = F.coalesce(before == row["folded"], F.lit(False)) | F.coalesce(
                after == row["folded"], F.lit(False)
            )
            return ~((row["words"] <= 3) & twin) & ~noise(row)

        return F.filter(rows, lonely)

    kept = let(F.sort_array(described), keep)
    in_order = F.sort_array(
        F.transform(kept, lambda r: F.struct(r["pos"].alias("pos"), r["line"].alias("line")))
    )
    return F.array_join(F.transform(in_order, lambda r: r["line"]), "\n\n")


def clean_text_lines(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn(text, clean_text(F.col(text)))


class _VisibleText(HTMLParser):
    """Collects the text outside chrome elements, one line per block."""

    VOID = frozenset(
        "area base br col embed hr img input link meta param source track wbr".split()
    )
    BLOCK = frozenset(
        "address article blockquote body div dd dl dt figure figcaption h1 h2 h3 h4 h5 h6 "
        "header hr li main ol p pre section table td th tr ul br".split()
    )
    SELF_CLOSING_SIBLINGS = frozenset("p li option tr td th dt dd".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool]] = []
        self.lines: list[list[str]] = [[]]
        self.title: list[str] = []

    def _noise(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in NOISE_TAGS:
            return True
        values = {k: v or "" for k, v in attrs}
        label = " ".join(values[a] for a in ATTRIBUTES if values.get(a)).casefold()
        return values.get("role", "").casefold() in NOISE_ROLES or any(
            part in label for part in NOISE_ATTRIBUTE_PARTS
        )

    def _hidden(self) -> bool:
        return bool(self.open) and self.open[-1][1]

    def handle_starttag(self, tag, attrs):
        if tag in self.BLOCK:
            self.lines.append([])
        if tag in self.VOID:
            return
        if tag in self.SELF_CLOSING_SIBLINGS and self.open and self.open[-1][0] == tag:
            self.open.pop()
        self.open.append((tag, self._hidden() or self._noise(tag, attrs)))

    def handle_startendtag(self, tag, attrs):
        if tag in self.BLOCK:
            self.lines.append([])

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                break
        if tag in self.BLOCK:
            self.lines.append([])

    def handle_data(self, data):
        if self.open and self.open[-1][0] == "title":
            self.title.append(data)
        elif not self._hidden():
            self.lines[-1].append(data)

    def result(self) -> tuple[str, str]:
        rows = (re.sub(r"\s+", " ", "".join(parts)).strip() for parts in self.lines)
        return "\n".join(r for r in rows if r), " ".join("".join(self.title).split())


def prune_html(pages: DataFrame) -> DataFrame:
    """A9. ``pages(page_id, html)`` -> ``page_id, text, title`` without page chrome.

    Markup nesting needs a parser, so this is the one cleaning step in Python;
    it is map-only, and Spark's byte-sized input splits keep tasks even.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for html in batch["html"]:
                parser = _VisibleText()
                parser.feed(html or "")
                parser.close()
                out.append(parser.result())
            yield pd.DataFrame(
                {
                    "page_id": batch["page_id"],
                    "text": [text for text, _ in out],
                    "title": [title for _, title in out],
                }
            )

    return pages.select("page_id", "html").mapInPandas(
        run, "page_id bigint, text string, title string"
    )
