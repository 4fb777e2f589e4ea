"""Periodic runs, page texts and centroid clusters against brute force on small fixtures with nulls, empty and long texts,
repeated rows, ties, empty tables and columns whose names clash."""

import hashlib
import math
import random
import re
import zlib
from fractions import Fraction
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.llm import centroids, page_text, periodic_runs, queries
from pathloom.llm.common import whole_text
from pathloom.llm.page_blocks import blocks

# --- periodic runs


def brute_runs(words):
    n, out = len(words), []
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            start = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            size = i - start + p
            if size >= max(6, 4 * p) and not any(all(words[k] == words[k + q] for k in range(start, start + size - q)) for q in range(1, p)):
                out.append((start, size, p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def random_words(rng):
    n, k = rng.randint(0, 60), rng.choice([1, 2, 3, 50])
    w = [rng.randrange(k) for _ in range(n)]
    if rng.random() < 0.6 and n > 4:
        q, a = rng.randint(1, max(1, n // 4)), rng.randrange(n)
        w = [w[i] if i < a or a + (i - a) % q >= n else w[a + (i - a) % q] for i in range(n)]
    if rng.random() < 0.3:
        w += [rng.randrange(2) for _ in range(rng.randint(1, 9))] * rng.randint(2, 8)
    return w


def test_runs_equal_brute_force():
    rng = random.Random(3)
    for _ in range(600):
        texts = [random_words(rng) for _ in range(rng.randint(1, 5))]
        found = periodic_runs.find_runs([np.array(t, np.int64) for t in texts])
        assert found == [brute_runs(t) for t in texts]


def test_runs_whose_grid_points_lie_in_shorter_runs():
    for words in ([0] * 6 + [1] + [0] * 6 + [1] + [0] * 6 + [1] + [0] * 6 + [1], ([0] * 9 + [1, 2]) * 5, ([0] * 6 + [1] * 6) * 4 + [0] * 3):
        assert periodic_runs.find_runs([np.array(words)]) == [brute_runs(words)]


def test_runs_in_long_texts_and_small_blocks(monkeypatch):
    rng = random.Random(8)
    words = [rng.randrange(5000) for _ in range(3000)]
    words[500:1700] = (words[500:740] * 5)[:1200]
    words[2000:2400] = words[2000:2003] * 134
    words = words[:3000]
    whole = periodic_runs.find_runs([np.array(words)])
    assert whole == [brute_runs(words)] and len(whole[0]) >= 2
    monkeypatch.setattr(periodic_runs, "PAIRS", 100)
    assert periodic_runs.find_runs([np.array([1, 2]), np.array(words)]) == [[], whole[0]]


RUN_TEXTS = [None, "", " \n\t ", "a", "la " * 5, "la " * 6, "x " + "la la lo " * 9 + "y", "a b c d e " * 7, "one two three four five six seven eight " * 12, "wide space stays " * 4, "p q p q p q p q r s r s r s r s"]


def run_rows():
    rng = random.Random(4)
    rows = [(i, t) for i, t in enumerate(RUN_TEXTS)]
    rows += [(100 + i, " ".join(str(w) for w in random_words(rng))) for i in range(150)]
    return rows + [(None, "la " * 8), (7, "a b " * 6), (7, "a b " * 6), (7, "c")]


def wanted_runs(doc, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc).encode()) if doc is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    gone = {i for s, size, p in runs for i in range(s + p, s + size)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2], sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_periodic_runs_query(spark):
    rows = run_rows()
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, runs string, collapsed long")
    found = periodic_runs.digests(periodic_runs.detect(docs, periodic_runs.periodic_text(F.col("doc_id"), whole_text()))).drop("n_words").collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(repr(wanted_runs(*r)) for r in rows)
    assert sum(zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in rows if d is not None) > 5
    assert periodic_runs.digests(periodic_runs.detect(docs.limit(0))).count() == 0


def test_detected_runs_and_texts(spark):
    row = periodic_runs.detect(spark.createDataFrame([(1, "x la la la la la la y")], "doc_id long, text string")).first()
    assert ([tuple(r) for r in row.runs], row.collapsed, row.n_words) == ([(1, 6, 1)], "x la y", 8)


def test_periodic_runs_of_the_table(spark, data_dir):
    short = {r.doc_id: r.text for r in spark.read.parquet(f"{data_dir}/documents.parquet").collect() if len(r.text or "") < 6000}
    found = {r.doc_id: r for r in queries.op11_periodic_runs(spark, data_dir).drop("n_words").collect()}
    for doc, text in short.items():
        assert tuple(found[doc]) == wanted_runs(doc, text)


# --- page text


def page(body):
    return f"<!DOCTYPE html><html><head><title>No title</title><style>p>a{{}}</style></head>{body}"


#: html, text that must come out
PAGES = [
    (None, ""),
    ("", ""),
    ("<html></html>", ""),
    (page("<body><nav><a href=x>Home</a></nav><article><h1>A &amp; B</h1><p>One\n two&nbsp;three<br>four<p>Tail &lt;p&gt; &#228;</article><footer>&copy; me</footer>"), "A & B\n\nOne two three four\n\nTail <p> ä"),
    (page("<body class='has-sidebar'><header><h1>Site</h1></header><main><header><h1>Title</h1></header><p>Text <b>bold</b> and <a href='a>b'>link</a> more words here.</p><form><label>Mail</label><input name=a><button>Send</button></form></main>"), "Title\n\nText bold and link more words here."),
    (page("<body><article><p>Kept.<script>var a = '<p>no</p>';</script><style>b</style><div class='advert'>Buy this now please buy it</div><p>Also kept.</article><section id=comments><article class=comment><p>First! A rather long comment of a reader about this.</article></section>"), "Kept.\n\nAlso kept."),
    (page("<body><div role=dialog>We use cookies</div><article><p>x<aside>Side</aside><div hidden>Hidden</div><div style='display: none'>Not shown</div><p>y<!-- <p>comment</p> -->z"), "x\n\nyz"),
    (page("<body><article><p>a < b and 3 <4<p>cut <a href='never clo"), "a < b and 3 <4\n\ncut"),
    (page("<body><ul><li><a href=1>Home</a><li><a href=2>News</a><li><a href=3>About us</a></ul><h1>A plain old page title here</h1><p>" + "word " * 40 + "<p>" + "term " * 55 + "<div><a href=4>Next page</a></div><div><a href=5>Previous</a></div>"), "A plain old page title here\n\n" + ("word " * 40).strip() + "\n\n" + ("term " * 55).strip()),
    (page("<body><div id=cookieBanner><p>" + "cookies " * 30 + "</div><ARTICLE CLASS=post><H2>Upper</H2><P>Case</ARTICLE><div class=sideBar>no</div>"), "Upper\n\nCase"),
    (page("<body><article><ul><li>one<li>two</ul><table><tr><td>1<td>2<tr><td>3</table><blockquote>quoted</blockquote><pre>a\n  b</pre></article>"), "one\n\ntwo\n\n1\n\n2\n\n3\n\nquoted\n\na b"),
    (page("<body><form id=aspnet action=x><div class='page has-sidebar'><article class=post><div class=post-header><h1>Of its own</h1></div><p>Text.</p><form><p>Vote</form></article></div><section id=comments><article><p>A reader says so and so, at some length, about it.</article></section></form>"), "Of its own\n\nText."),
    (page("<body><div class=cookiebanner>We bake</div><ins class=adsbygoogle>Buy</ins><main><p>Main text<section class=commentArea><p>Nice</section><div class='c reader-comments'><article><p>Me too</article></div></main><div class=sitefooter>x</div>"), "Main text"),
    (page("<body><article><p>only</p></article></div></p></article><p>Stray text behind the article that nobody needs to see.</p>"), "only"),
]


def test_planted_pages(spark):
    rows = [(i, f"u{i}", h, "x", 3) for i, (h, _) in enumerate(PAGES)] + [(3, None, PAGES[3][0], "x", 3), (None, "n", PAGES[3][0], "x", 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, words int")
    found = page_text.extract(pages)
    assert found.columns[:4] == ["page_id", "url", "text", "n_chars"]
    got = found.collect()
    assert len(got) == len(rows)
    for r in got:
        want = PAGES[3 if r.page_id is None else r.page_id][1]
        assert r.text == want and r.n_chars == len(want)
    assert page_text.extract(pages.limit(0)).count() == 0


def test_tree_learns_its_table_and_the_column_decides_alike(spark):
    rows = page_text.labelled_rows()
    wrong = sum(page_text.decide(page_text.tree(), r) != y for r, y in rows)
    assert wrong <= len(rows) // 100
    pages = [h for h, _ in PAGES if h]
    for found, html_ in zip(page_text.cut(spark.createDataFrame([(i, "", h) for i, h in enumerate(pages)], "page_id long, url string, html string")).withColumn("main", page_text.main_blocks(F.col("blocks"), page_text.tree())).orderBy("page_id").collect(), pages, strict=True):
        own = blocks(html_)
        assert [b.text for b in found.main] == [b[0] for b, f in zip(own, page_text.features(own), strict=True) if page_text.decide(page_text.tree(), f)]


def test_held_out_layouts():
    """Layouts that the table doesn't have, with drawn lengths: blocks taken rightly."""
    rng, right, n = random.Random(5), 0, 0
    layouts = [
        "<body><div id=top><a>-w</a> <a>-w</a></div><main><article><h1>+w</h1><section><p>+w<p>+w</section><p>+w</article></main><div class=newsletter>-w</div><footer><p>-w<p>-w</footer>",
        "<body><aside>-w</aside><article><p>+w<figure><img src=a><figcaption>+w</figcaption></figure><p>+w<div class='social share'>-<a>w</a></div></article><div id=disqus>-w</div>",
        "<body><header><nav>-<a>w</a></nav></header><div class=popup>-w</div><article><h1>+w</h1><ol><li>+w<li>+w</ol><p>+w</article><p>-w",
    ]
    for layout in layouts * 40:
        text = re.sub(r"([+-])((?:<a>)?)w", lambda m: m[2] + m[1] + " w" * rng.randint(0, 120), layout)
        found = blocks(text)
        for b, f in zip(found, page_text.features(found), strict=True):
            n += 1
            right += page_text.decide(page_text.tree(), f) == (b[0][0] == "+")
    assert right / n >= 0.98


def test_very_long_and_deep_pages():
    words = " ".join(f"w{i}" for i in range(200_000))
    assert [b[0] for b in blocks(f"<article><p>{words}</article>")] == [words]
    assert len(blocks("<div>" * 20_000 + "a" + "</div></p>" * 20_000 + "<p>b")) == 2
    assert len(blocks("<a href=\"x" * 5000 + "<p>b</p>")) <= 2
    assert [b[0] for b in blocks("<p>" + "<" * 50_000 + " end")] == ["<" * 50_000 + " end"]


class Reader(HTMLParser):
    """Text of the article by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.inside, self.now = [], False, ""

    def handle_starttag(self, tag, attrs):
        self.flush(tag)
        self.inside |= tag == "article"

    def handle_endtag(self, tag):
        self.flush(tag)
        self.inside &= tag != "article"

    def flush(self, tag):
        if tag == "br":
            self.now += " "
        elif tag != "b":
            if self.inside and self.now.split():
                self.out.append(" ".join(self.now.split()))
            self.now = ""

    def handle_data(self, data):
        self.now += data


def test_pages_of_the_table(spark, data_dir):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{data_dir}/pages.parquet").collect()}
    for r in queries.op12_page_text(spark, data_dir).collect():
        reader = Reader()
        reader.feed(pages[r.page_id])
        reader.close()
        assert r.text == "\n\n".join(reader.out) and r.n_chars == len(r.text)


# --- centroid clustering


def brute_clusters(vectors, k=40, rounds=5, dims=64):
    kept = [(v, [max(-(1 << 27), min(1 << 27, math.floor(256 * x))) for x in e]) for v, e in vectors if e is not None and len(e) == dims and all(x is not None and math.isfinite(x) for x in e)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    means = [r[1] for r in first[:k]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, m, strict=True)), i) for i, m in enumerate(means))

    for _ in range(rounds):
        of = [nearest(x)[1] for _, x in kept]
        for i in range(len(means)):
            own = [x for (_, x), c in zip(kept, of, strict=True) if c == i]
            if own:
                means[i] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    ended = [(v, *nearest(x)[::-1]) for v, x in kept]
    return [(v, c, d, sum(e for _, b, e in ended if b == c), sum(e for *_, e in ended), hashlib.sha256(",".join(map(str, means[c])).encode()).hexdigest()) for v, c, d in ended]


def vector_rows(n, dims, seed, spread=1.0):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([rng.gauss(0, spread), rng.randint(-2, 2) / 4]) for _ in range(dims)]) for i in range(n)]
    rows += [(5, list(rows[5][1])), (5, list(rows[5][1])), (7, list(rows[8][1])), (None, list(rows[3][1])), (900, [0.0] * dims), (901, [0.0] * dims)]
    return rows + [(910, None), (911, []), (912, [1.0] * (dims - 1)), (913, [None] + [1.0] * (dims - 1)), (914, [float("nan")] + [1.0] * (dims - 1)), (915, [float("-inf")] + [0.0] * (dims - 1))]


@pytest.mark.parametrize(("n", "k", "dims", "spread"), [(120, 9, 4, 1.0), (150, 12, 1, 3.0), (10, 40, 4, 1.0), (60, 7, 3, 1e6)])
def test_clusters_equal_brute_force(spark, n, k, dims, spread):
    rows = vector_rows(n, dims, n + k, spread)
    table = spark.createDataFrame([(v, e, 1, "x") for v, e in rows], "vec_id long, embedding array<double>, cluster int, distance string")
    got = centroids.cluster(table, k, 5, dims)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, brute_clusters(rows, k, 5, dims)))
    assert centroids.cluster(table.limit(0), k, 5, dims).count() == 0


def test_ties_and_borders_of_the_annulus():
    rng = np.random.default_rng(1)
    for scale in (2, 30, 1 << 20, 1 << 26):
        for dims in (1, 2, 5):
            rows, x = rng.integers(-scale, scale + 1, (25, dims)), rng.integers(-scale, scale + 1, (300, dims))
            d = ((x[:, None].astype(object) - rows[None].astype(object)) ** 2).sum(2)
            number, least = centroids.Centroids(rows).nearest(x)
            assert (number == [min(range(25), key=lambda i: (r[i], i)) for r in d]).all() and (least == d.min(1)).all()


def test_annulus_prunes():
    """Centroids far off by norm are not compared."""
    own = centroids.Centroids(np.array([[10 * i, 0] for i in range(100)]))
    compared = []
    own.distances = lambda x, square, to: (compared.append(len(to)), centroids.Centroids.distances(own, x, square, to))[1]
    number, _ = own.nearest(np.array([[10 * i + 1, 0] for i in range(100)]))
    assert number.tolist() == list(range(100)) and max(compared) <= 3


def test_a_score_replaces_a_column_of_its_name(spark):
    from pathloom.llm import quality_model

    docs = spark.createDataFrame([(i, f"word{i} good text", "old", i) for i in range(6)], "doc_id long, text string, Score string, kept int")
    model = quality_model.fit(docs, spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id long, quality int"))
    got = quality_model.score(docs, model)
    assert got.columns == ["doc_id", "text", "kept", "score"] and all(0 <= r.score <= 1 for r in got.collect())
