"""Main text of web pages: flat text blocks, classified by a decision tree over the block and its neighbours.

A page is cut into blocks (page_blocks). For each of them and its neighbours word count and link density are known, and
what the elements around it say: whether it is in an article, or in something marked as a menu, advert, form and so on,
and whether the page has an article at all. A tree of Gini splits, grown on the small labelled table below, becomes one
Spark expression over the page's array of blocks; the blocks that it takes are joined.

Defined results: null or empty pages, and pages without a main block, have an empty text; a page is worked on whole;
repeated rows, null and repeated page_ids each get their own result; other columns are dropped whatever their names; an
empty table gives none. References are decoded once, in text only; a page that ends inside an element, comment or tag is
read as if it ended there.
"""

from __future__ import annotations

import functools
import random
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import bounded_batches, tidied
from pathloom.llm.page_blocks import Block, blocks

BLOCK = "array<struct<text: string, words: int, linked: int, article: boolean, beside: boolean>>"
FEATURES = ("beside", "article", "has_article", "words", "density", "words_before", "density_before", "words_after", "density_after")
MOST_DEPTH, LEAST_ROWS = 7, 2

#: Labelled pages: + marks a block of the main text, - another. A number of words stands for a text, a for a link; w
#: for a text of any length, for pages whose elements say enough: such a page stands for DRAWS pages with drawn lengths.
DRAWS = 6
LABELLED = (
    "<body><nav><ul><li>-<a>w</a><li>-<a>w</a><li>-<a>w</a></ul></nav><div class=ad>-w</div><article><h1>+w</h1><p>+w<p>+w<p>+w</article><footer>-w</footer>",
    "<body><header><h1>-w</h1><p>-w</header><div class=ad>-w</div><main><h1>+w</h1><p>+w<p>+w<p>+w</main><aside><h3>-w</h3><p>-w</aside><footer>-w</footer>",
    "<body><div class=cookie-notice>-w</div><article><header><h1>+w</h1></header><p>+w<p>+w<div class=share>-<a>w</a></div></article><section id=comments><h2>-w</h2><p>-w<p>-w</section>",
    "<body><article><h2>+w</h2><p>+w<form><p>-w<p>-w</form><p>+w<aside>-w</aside><p>+w</article><div>-w</div><div>-<a>w</a></div>",
    "<body><main><p>+w<p>+w<h2>+w</h2><ul><li>+w<li>+w</ul></main><div>-w</div><p>-w<p>-w",
    "<body><p>-w<article><p>+w<p>+w<p>+w<p>+w",
    "<body><p>-w<p>-<a>w</a><p>-w<article><h1>+w</h1><p>+w</article><p>-w<p>-w",
    "<body><article><p>+w<p>+<a>4</a><p>+w<h3>-<a>5</a></h3><ul><li>-<a>6</a><li>-<a>7</a><li>-<a>4</a></ul></article>",
    "<body><article><p>+<a>8</a><p>+w</article><p>-<a>2</a>",
    "<body><main><h1>+<a>6</a></h1><p>+w<p>+w<p>+<a>3</a></main><p>-w",
    # pages without an article: words and links of a block and its neighbours decide
    "<body><div><ul><li>-<a>1</a><li>-<a>2</a><li>-<a>1</a><li>-<a>2</a></ul></div><h1>+6</h1><p>+48<p>+31<p>+5<p>+60<div>-<a>2</a></div><div>-<a>1</a></div><div>-7</div>",
    "<body><div>-3</div><div>-<a>2</a></div><div>-<a>3</a></div><div><p>+80<p>+22<p>+39</div><div>-<a>4</a></div><div>-<a>3</a></div><div>-4</div>",
    "<body><p>-<a>2</a><p>-<a>2</a><p>-4<p>-<a>1</a><h1>+5</h1><p>+26<p>+19<p>+57<p>-<a>6</a><p>-<a>4</a><p>-3",
    "<body><table><tr><td>-<a>1</a><td>-<a>1</a></table><p>+33<p>+3<p>+45<p>+12<p>+21<table><tr><td>-<a>3</a><td>-2</table>",
    "<body><p>+18<p>+24<p>+2<p>+95",
    "<body><h2>+3</h2><p>+120",
    "<body><h1>+2</h1><p>+4<p>+1<p>+9",
    "<body><p>+6",
    "<body><p>+1",
    "<body><div class=menu>-<a>5</a></div><h1>+4</h1><p>+55<p>+4<p>+17<div class=sidebar><p>-40<p>-26</div><div class=footer>-11</div>",
)


class Row(NamedTuple):
    beside: int
    article: int
    has_article: int
    words: float
    density: float
    words_before: float
    density_before: float
    words_after: float
    density_after: float


class Split(NamedTuple):
    """rows with feature <= at go to low."""

    feature: str
    at: float
    low: Split | bool
    high: Split | bool


def features(page: list[Block]) -> list[Row]:
    """What the tree sees of each block; beyond the page's ends there are blocks of no words."""
    has = int(any(article and not beside for *_, article, beside in page))
    sizes = [(0, 0.0), *[(n, linked / n) for _, n, linked, _, _ in page], (0, 0.0)]
    return [Row(int(b[4]), int(b[3]), has, *sizes[k + 1], *sizes[k], *sizes[k + 2]) for k, b in enumerate(page)]


def labelled_rows() -> list[tuple[Row, bool]]:
    """The labelled pages as rows of features."""
    out, lengths = [], random.Random(12)
    for page in LABELLED:
        found = blocks(page)
        for _ in range(DRAWS if any(t[1:] == "w" for t, *_ in found) else 1):
            sizes = [round(2 ** lengths.uniform(0, 8)) if t[1:] == "w" else int(t[1:]) for t, *_ in found]
            read = [(t, n, n if linked else 0, article, beside) for n, (t, _, linked, article, beside) in zip(sizes, found, strict=True)]
            out += [(row, b[0][0] == "+") for row, b in zip(features(read), found, strict=True)]
    return out


def impurity(labels: list[bool]) -> float:
    share = sum(labels) / len(labels)
    return len(labels) * 2 * share * (1 - share)


def grow(rows: list[tuple[Row, bool]], depth: int = MOST_DEPTH) -> Split | bool:
    """A tree of the splits that leave the least Gini impurity; ties: the earlier feature, then the lower border."""
    labels = [y for _, y in rows]
    majority = 2 * sum(labels) >= len(labels)
    if not depth or len(set(labels)) == 1:
        return majority
    best = None
    for k in range(len(FEATURES)):
        values = sorted({r[k] for r, _ in rows})
        for a, b in zip(values, values[1:]):
            at = (a + b) / 2
            low, high = [y for r, y in rows if r[k] <= at], [y for r, y in rows if r[k] > at]
            if min(len(low), len(high)) >= LEAST_ROWS:
                left = impurity(low) + impurity(high)
                if best is None or left < best[0] - 1e-9:
                    best = left, k, at
    if best is None:
        return majority
    _, k, at = best
    low, high = (grow([r for r in rows if (r[0][k] <= at) == side], depth - 1) for side in (True, False))
    return low if low is high else Split(FEATURES[k], at, low, high)


@functools.cache
def tree() -> Split | bool:
    return grow(labelled_rows())


def decide(node: Split | bool, row: Row) -> bool:
    while isinstance(node, Split):
        node = node.low if getattr(row, node.feature) <= node.at else node.high
    return node


def as_column(node: Split | bool, values: dict[str, Column]) -> Column:
    if not isinstance(node, Split):
        return F.lit(node)
    return F.when(values[node.feature] <= node.at, as_column(node.low, values)).otherwise(as_column(node.high, values))


def main_blocks(page: Column, node: Split | bool) -> Column:
    """The blocks of an array that the tree takes."""
    has = F.exists(page, lambda b: b["article"] & ~b["beside"]).cast("int")

    def size(b: Column) -> tuple[Column, Column]:
        return F.coalesce(b["words"], F.lit(0)), F.coalesce(b["linked"] / b["words"], F.lit(0.0))

    def taken(b: Column, k: Column) -> Column:
        values = {"beside": b["beside"].cast("int"), "article": b["article"].cast("int"), "has_article": has}
        for at, suffix in ((b, ""), (F.get(page, k - 1), "_before"), (F.get(page, k + 1), "_after")):
            values["words" + suffix], values["density" + suffix] = size(at)
        return as_column(node, values)

    return F.filter(page, taken)


def cut(pages: DataFrame) -> DataFrame:
    """page_id, url and the blocks of each page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ("text", "words", "linked", "article", "beside")
        for batch in batches:
            found = [[dict(zip(names, b, strict=True)) for b in blocks(t or "")] for t in batch["html"]]
            yield pd.DataFrame({"page_id": batch["page_id"].astype("Int64"), "url": batch["url"], "blocks": found})

    bounded_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInPandas(tidied(run), f"page_id long, url string, blocks {BLOCK}")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text (the main blocks, an empty line between them), n_chars, n_blocks, n_main of every page."""
    chosen = cut(pages).withColumn("main", main_blocks(F.col("blocks"), tree()))
    text = F.array_join(F.transform("main", lambda b: b["text"]), "\n\n")
    return chosen.select("page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"), F.size("blocks").cast("long").alias("n_blocks"), F.size("main").cast("long").alias("n_main"))


#: The same in DuckDB's SQL for pages whose main text is all of one article element, as the given tables have them.
ORACLE = r"""
with body as (select page_id, url, regexp_extract(regexp_replace(coalesce(html, ''), '(?is)<!--.*?-->|<(script|style|title)[^>]*>.*?</(script|style|title)>', '', 'g'), '(?is)<article>(.*?)(</article>|$)', 1) as article from pages),
parts as (select page_id, url, list_transform(regexp_split_to_array(article, '(?i)</?(p|h[1-6]|div|ul|ol|li|section|blockquote|header)( [^>]*)?>'),
    lambda x: trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&'), '[\x{a0}\s]+', ' ', 'g'))) as found from body),
texts as (select page_id, url, list_filter(found, lambda x: x <> '') as kept from parts)
select page_id, url, array_to_string(kept, chr(10) || chr(10)) as text, length(array_to_string(kept, chr(10) || chr(10)))::bigint as n_chars from texts
"""
