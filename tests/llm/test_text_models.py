"""Whitening, main text of pages, prefix tries."""

from __future__ import annotations

import hashlib
import re
import zlib
from html import unescape

import numpy as np
import pytest
from meterline.llm import prefixes
from meterline.llm.content import LABELLED, best_run, label_counts, main_text, main_texts, weights_of
from meterline.llm.queries import ORACLE, QUERIES
from meterline.llm.whitening import inertia, leading_pairs, whitened_frame, whitening_report
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_whitening(rows):
    """Kept ids, n, deviations and eigenvalues of the contract, by numpy's own eigensolver."""
    fine = [(i, v) for i, v in rows if v and all(e is not None and np.isfinite(e) for e in v)]
    x = np.floor(1024 * np.array([v for _, v in fine], dtype=float)).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(axis=0)
    y = x - sums / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1][:8], vectors[:, ::-1][:, :8]
    return [i for i, _ in fine], n, ((n * x - sums) ** 2).sum(axis=1), values, (y @ vectors) / np.sqrt(values), (y * y).sum() / n


def test_inertia_counts_signs():
    draw = np.random.default_rng(5)
    for size in (1, 2, 3, 7, 40):
        a = draw.standard_normal((size, size))
        for matrix in (a + a.T, np.triu(a, 1) + np.triu(a, 1).T, np.diag(np.round(2 * draw.standard_normal(size)))):
            values = np.linalg.eigvalsh(matrix)
            for shift in (-0.7, 0.3, 1.1):
                negative, zero, positive = inertia(matrix - shift * np.eye(size))
                assert (negative, zero, positive) == ((values < shift).sum(), 0, (values > shift).sum())
    assert inertia(np.diag([1.0, 0.0, -2.0, 0.0])) == (1, 2, 1)


def test_leading_pairs_with_close_and_equal_values():
    draw = np.random.default_rng(6)
    turn = np.linalg.qr(draw.standard_normal((12, 12)))[0]
    for values in (np.arange(12.0, 0, -1), [5, 5, 5, 2, 2, 1, 1, 1, 1, 0, 0, 0], [3, 3 - 1e-9, 3 - 2e-9] + [1] * 9, [1] + [1e-9] * 11):
        matrix = turn @ np.diag(np.array(values, dtype=float)) @ turn.T
        matrix = (matrix + matrix.T) / 2
        found, axes = leading_pairs(matrix, 8)
        wanted = [v for v in values if v > 0][:8]
        assert np.allclose(found, wanted, rtol=0, atol=1e-13 * max(values))
        assert np.abs(matrix @ axes - axes * found).max() < 1e-13 * max(values)
        assert np.abs(axes.T @ axes - np.eye(len(found))).max() < 1e-12


def test_whitening_equals_plain(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, n, deviations, values, coordinates, trace = plain_whitening(rows)
    got = QUERIES["op11_spectrum_slicing_whitening"](spark, sf).collect()
    assert len(got) == 8 * len(ids)
    table = {(r.vec_id, r.component): r for r in got}
    for k in range(8):
        sign = np.sign(table[ids[0], k + 1].whitened * coordinates[0, k])
        for at, i in enumerate(ids):
            row = table[i, k + 1]
            assert (row.n, row.deviation) == (n, deviations[at])
            assert abs(row.whitened - sign * coordinates[at, k]) < 1e-9
            assert abs(row.explained - values[k] / trace) < 1e-12
            assert row.identity_error < 1e-10


def test_whitening_of_odd_rows(spark):
    schema = "vec_id long, embedding array<float>, VEC_ID long, n long, whitened string"
    nan, inf = float("nan"), float("inf")
    vectors = [(1, [1.0, 2.0]), (2, None), (3, [None, 1.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, []), (None, [2.0, 0.5]), (7, [0.0, 0.25]),
               (7, [0.0, 0.25]), (8, [1.0, 2.0, 3.0]), (9, [3e38, 1.0])]
    odd = spark.createDataFrame([(i, v, 0, 0, "x") for i, v in vectors], schema)
    got = whitening_report(odd).collect()
    assert sorted((r.vec_id or 0, r.component) for r in got) == sorted([(1, 1), (1, 2), (0, 1), (0, 2), (7, 1), (7, 2), (7, 1), (7, 2)])
    assert {r.n for r in got} == {4}
    assert whitening_report(odd.limit(0)).count() == 0
    few = odd.select("embedding", F.lit(1).alias("vec_id"))
    assert whitening_report(few.filter("get(embedding, 0) = 0")).count() == 0
    one = whitening_report(few.filter("get(embedding, 0) < 2 and size(embedding) = 2")).collect()
    assert {r.component for r in one} == {1} and all(abs(r.explained - 1) < 1e-12 for r in one)


def test_deviation_beyond_a_long(spark):
    rows = spark.createDataFrame([(1, [4e12, 1.0]), (2, [-4e12, 2.0])], "vec_id long, embedding array<double>")
    x = [[1024 * 4 * 10**12 + 100_000, 101_024], [-1024 * 4 * 10**12 + 100_000, 102_048]]
    sums = [x[0][k] + x[1][k] for k in (0, 1)]
    wanted = {i + 1: sum((2 * v - s) ** 2 for v, s in zip(x[i], sums, strict=True)) for i in (0, 1)}
    assert {r.vec_id: int(r.deviation) for r in whitened_frame(rows, 1).collect()} == wanted
    assert {r.deviation for r in whitening_report(rows).collect()} == {None}


def by_hand():
    counts = label_counts(LABELLED[0])
    for page in LABELLED[1:]:
        counts.update(label_counts(page))
    return weights_of(counts, counts)


def test_best_run_is_the_best():
    draw = np.random.default_rng(7)
    for _ in range(200):
        scores = draw.integers(-3, 4, draw.integers(1, 12)).astype(float).tolist()
        first, last = best_run(scores)
        every = [sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)]
        assert sum(scores[first:last]) == max(0.0, *every)


def test_pages_of_the_tables(spark, sf):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = QUERIES["op12_maximum_subsequence_text"](spark, sf).collect()
    assert len(got) == len(pages)
    for row in got:
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", pages[row.page_id].html, re.DOTALL).group(1)
        wanted = " ".join(unescape(re.sub(r"<[^>]*>", " ", article.replace("<b>", ""))).split())
        assert (row.text, row.n_chars, row.url) == (wanted, len(wanted), pages[row.page_id].url)


@pytest.mark.parametrize("other", ["main", "div", "section", 'div class="post-body"'])
def test_articles_without_their_element(spark, sf, other):
    """Held-out layouts: the same pages with another element in place of `article`."""
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    renamed = F.replace(F.replace("html", F.lit("<article>"), F.lit(f"<{other}>")), F.lit("</article>"), F.lit(f"</{other.split()[0]}>"))
    mixed = pages.withColumn("html", F.when(F.col("page_id") % 2 == 0, renamed).otherwise(F.col("html")))
    plain = {r.page_id: r.text for r in main_texts(pages).collect()}
    assert {r.page_id: r.text for r in main_texts(mixed).collect()} == plain


LONG = "<p>The river rose for three days and the lower meadows were under water by Sunday.</p>"
PAGES = {
    f"<body><div class='site-header'><h2>Site</h2></div><div id=content><h1>High water</h1>{LONG}</div><div class=comments><p>First reader: a fine"
    " article, I liked it very much indeed.</p></div></body>": "High water",
    f"<div class='cookie-notice'><p>We use cookies to make this site work better for you and for us.</p></div><main><h1>High water</h1>{LONG}"
    "<form><p>Enter your name and your mail address here</p></form></main>": "High water",
    f"<body class=has-sidebar><article><header><h1>High water</h1></header>{LONG}<div class=ad>Buy boots now, only this week, only here with us"
    "</div><footer>By a reporter</footer></article><div class='sidebar'><p>Other things that were written this week on this site</p></div>": None,
    f"<article class='comment'><p>{'A long comment that is no article at all. ' * 9}</p></article><article><h1>High water</h1>{LONG}</article>": "High water",
    f"<nav hidden><p>Menu</p></nav><h1>High<br>water</h1>{LONG}<script>if (a < b) document.write('<p>no text at all of any kind</p>')</script>"
    "<div style='display: none'>hidden words that nobody sees on the page</div>": "High water",
}


@pytest.mark.parametrize("page", list(PAGES))
def test_layouts(page):
    text = main_text(page, by_hand())
    body = re.sub("<[^>]*>", "", LONG)
    assert text == (f"{PAGES[page]} {body}" if PAGES[page] else f"High water {body} By a reporter")


def test_odd_pages(spark):
    deep = "<div>" * 3_000 + LONG + "</div>" * 3_000
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<p"), (4, "u", "no tags, but a number of plain words here and some more of them"), (5, "u", "<!-- never closed <p>x</p>"),
            (6, "u", "<article><p>a &lt;b&gt; &eacute;&nbsp;&#x4e2d; &am</p><p>x<b>y</b>z</p></article>"), (None, "v", LONG * 5_000), (7, "u", deep),
            (8, "u", "<script>" + LONG), (9, "u", "<article></article><div>only this</div>"), (1, "u", None)]
    odd = spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows], "page_id long, url string, html string, HTML string, n_chars long")
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in main_texts(odd).collect()}
    assert main_texts(odd).count() == len(rows)
    body = re.sub("<[^>]*>", "", LONG)
    assert got[1, "u"] == got[2, None] == got[3, "u"] == got[5, "u"] == got[8, "u"] == ("", 0)
    assert got[4, "u"][0] == "no tags, but a number of plain words here and some more of them"
    assert got[6, "u"] == ("a <b> é 中 &am xyz", 17)
    assert got[None, "v"][0] == " ".join([body] * 5_000) and got[7, "u"][0] == body
    assert main_texts(odd.limit(0)).count() == 0


def plain_trie(rows, splice=False):
    """Every node of the contract from plain lists."""
    talks = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            talks.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))

    def identity(turn):
        return hashlib.sha256(f"{len(turn[2])}:{turn[2]}{turn[3]}".encode()).digest()[:16]

    talks = {c: [t[2:] for t in sorted(turns, key=lambda t: (t[:2], identity(t)))] for c, turns in talks.items()}
    if splice:
        taken = {c: zlib.crc32(str(c).encode()) % 4 for c in talks}
        talks = {c: talks.get(c - c % 20, [])[: taken[c]] + turns[taken[c] :] for c, turns in talks.items()}
    nodes = {}
    for c, turns in talks.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    children, leaves, saved = {}, {}, {}
    for path in nodes:
        if path:
            children[path[:-1]] = children.get(path[:-1], 0) + 1
    for path, members in nodes.items():
        words = len(WORD.findall(path[-1][1])) if path else 0
        for up in range(len(path) + 1):
            leaves[path[:up]] = leaves.get(path[:up], 0) + (path not in children)
            saved[path[:up]] = saved.get(path[:up], 0) + (len(members) - 1) * words
    return sorted(
        (min(m), len(p), min(nodes[p[:-1]]) if p else -1, len(m), children.get(p, 0), leaves[p], saved[p],
         hashlib.sha256(",".join(str(c) for c in sorted(m) if len(talks[c]) == len(p)).encode()).hexdigest())
        for p, m in nodes.items()
    )


def rows_of(trie):
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert trie.columns == columns
    return sorted(tuple(-1 if v is None else v for v in r) for r in trie.collect())


def test_trie_equals_its_sql(spark, sf, sql):
    wanted = sorted(tuple(-1 if v is None else v for v in r) for r in sql.sql(ORACLE["op13_rollup_prefix_trie"]).fetchall())
    assert rows_of(QUERIES["op13_rollup_prefix_trie"](spark, sf)) == wanted
    table = spark.read.parquet(f"{sf}/conversations.parquet").collect()
    assert plain_trie(table, splice=True) == wanted


TALKS = [
    (40, 1, "user", "hello there"), (40, 2, "bot", "hello to you too"), (41, 1, "user", "hello there"), (41, 2, "bot", "hello to you too"),
    (41, None, "system", "be kind"), (42, 1, None, None), (42, 1, "", ""), (43, 1, "user", "hello there"), (43, 1, "user", "hello there"),
    (-7, 1, "user", "hello there"), (-7, 2, "bot", "no"), (None, 1, "user", "nobody's"), (61, 1, "us", "erhello there"), (60, 5, "user", "  "),
    (80, 1, "a", "x"), (81, 1, "a", "y"),
]
SCHEMA = "conv_id long, turn long, role string, text string, TEXT string, depth long, pid string"


@pytest.mark.parametrize("splice", [False, True])
def test_trie_of_odd_rows(spark, splice):
    frame = spark.createDataFrame([(*t, "other", 1, "x") for t in TALKS], SCHEMA)
    got = prefixes.spliced_trie(frame) if splice else prefixes.prefix_trie(frame)
    assert rows_of(got) == plain_trie(TALKS, splice)
    assert prefixes.prefix_trie(frame.limit(0)).count() == prefixes.spliced_trie(frame.limit(0)).count() == 0


def test_trie_of_long_and_hot_conversations(spark, monkeypatch):
    """Paths of many blocks, chains of several levels, lists of several pieces; a third of the rows in one conversation."""
    monkeypatch.setattr(prefixes, "CHAIN", 3)
    monkeypatch.setattr(prefixes, "LIST_IDS", 4)
    talks = [(1, t, "user", f"turn {t % 5}") for t in range(400)]
    talks += [(2, t, "user", f"turn {t % 5}") for t in range(300)]
    talks += [(c, t, "user", f"turn {t}" if t < 16 else f"{c} at {t}") for c in range(3, 8) for t in range(20)]
    talks += [(c, t, "user", f"turn {t}") for c in range(100, 140) for t in range(8)]
    frame = spark.createDataFrame(talks, "conv_id long, turn long, role string, text string")
    assert rows_of(prefixes.prefix_trie(frame)) == plain_trie(talks)
