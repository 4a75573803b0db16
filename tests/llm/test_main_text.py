"""Main text: messages and gradient against enumeration, held-out accuracy, broken and huge pages."""
import html
import itertools
import re
import time

import numpy as np
import pytest

from callwise.llm import main_text as mt

SMOKE = "/root/testdata/sf0.001"
SCHEMA = "page_id long, url string, html string, text string, h int, n_chars string"


def forest(*pages):
    tree = mt.Tree()
    for p in pages:
        tree.add(p)
    return tree, mt.Forest(tree)


SMALL = "<body><nav><a href=x>a b</a></nav><div class=post><h1>T</h1><p>One two. Three.<p>Four</div>end</body>"


def enumerated(f, weights, edges):
    n = len(f.node)
    own = f.x @ weights
    total, marginal, pairs, value = 0.0, np.zeros(n), np.zeros(edges.shape), {}
    for y in itertools.product((0, 1), repeat=n):
        s = sum(own[i] for i in range(n) if y[i])
        s += sum(edges[f.kind[i], y[f.parent[i]], y[i]] for i in range(n) if f.parent[i] >= 0)
        value[y] = s
        w = np.exp(s)
        total += w
        marginal += w * np.array(y)
        for i in range(n):
            if f.parent[i] >= 0:
                pairs[f.kind[i], y[f.parent[i]], y[i]] += w
    return marginal / total, pairs / total, np.log(total), value


def test_messages_equal_enumeration():
    _, f = forest(SMALL)
    assert 8 <= len(f.node) <= 14
    rng = np.random.default_rng(0)
    weights, edges = rng.normal(size=mt.FEATURES), rng.normal(size=(4, 2, 2))
    p, joint, log_z = mt.marginals(f, weights, edges, pairs=True)
    want, pairs, z, value = enumerated(f, weights, edges)
    assert np.allclose(p, want, atol=1e-5) and np.allclose(joint, pairs, atol=1e-5) and abs(z - log_z) < 1e-4
    y = np.array(next(itertools.islice(value, 137, None)))
    assert abs(mt.likelihood(f, y, weights, edges)[0] - (value[tuple(y)] - z)) < 1e-4


def test_gradient_equals_differences():
    _, f = forest(SMALL, SMALL.replace("nav", "aside"))
    rng = np.random.default_rng(1)
    weights, edges = rng.normal(size=mt.FEATURES), rng.normal(size=(4, 2, 2))
    y = rng.integers(0, 2, len(f.node))
    _, gw, ge = mt.likelihood(f, y, weights, edges)
    for i in np.flatnonzero(np.abs(gw) > 1e-3)[:8]:
        step = np.zeros_like(weights)
        step[i] = 1e-2
        d = (mt.likelihood(f, y, weights + step, edges)[0] - mt.likelihood(f, y, weights - step, edges)[0]) / 2e-2
        assert abs(d - gw[i]) < 2e-2 * max(1, abs(gw[i]))
    for k in itertools.product(range(4), range(2), range(2)):
        step = np.zeros_like(edges)
        step[k] = 1e-3
        d = (mt.likelihood(f, y, weights, edges + step)[0] - mt.likelihood(f, y, weights, edges - step)[0]) / 2e-3
        assert abs(d - ge[k]) < 2e-2


@pytest.fixture(scope="module")
def fitted(spark):
    return mt.model(spark.read.parquet(f"{SMOKE}/pages.parquet"))


def kept(page, fitted):
    tree, f = forest(page)
    keep = mt.marginals(f, *fitted)[f.leaves] >= 0.5
    return " ".join(t for t, k in zip(tree.texts, keep) if k)


def article(page):
    """The article of the given pages, by their one template."""
    inside = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.S)[1]
    return " ".join(html.unescape(re.sub(r"<(?!/?b>)[^>]*>", " ", inside).replace("<b>", "").replace("</b>", "")).split())


def test_query_extracts_the_articles(spark):
    got = mt.op11_tree_model(spark, "/root/testdata/sf0.01").collect()
    pages = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    assert len(got) == len(pages)
    right = sum(r.text == article(pages[r.page_id]) for r in got)
    assert right >= 0.99 * len(got), right
    assert all(r.n_chars == len(r.text) for r in got)


def test_held_out_layouts(spark, fitted):
    """Layouts of other pages' words, drawn anew: told by names or not."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").orderBy("page_id").collect()]
    trees = [forest(mt._MAIN.sub(r"<\1 data-label=1", p, count=1)) for p in pages]
    texts = [[t for t, own in zip(tree.texts, mt.labels(f)[f.leaves]) if own] for tree, f in trees]
    made = mt.Layouts([t for x in texts for t in x], seed=2024)
    tree, f = forest(*[made.page(html.escape(x[0]), x[1:] or x) for x in texts if x])
    keep, y = mt.marginals(f, *fitted)[f.leaves] >= 0.5, mt.labels(f)[f.leaves] == 1
    size = np.array([len(t) for t in tree.texts])
    precision, recall = size[keep & y].sum() / size[keep].sum(), size[keep & y].sum() / size[y].sum()
    assert precision > 0.95 and recall > 0.95, (precision, recall)


PARAGRAPHS = ["The committee met on Tuesday, and after three hours of debate it voted for the plan.",
              "Nobody expected the result: even the chair, who had spoken first, called it a surprise.", "It will be heard again in June.",
              "Work on the bridge begins once the river falls below its summer mark, the engineers said."]


@pytest.mark.parametrize("page", [
    "<header><h1>Daily News</h1><nav><a href=a>Home</a> <a href=b>World</a></nav></header><main><h1>Plan passes</h1>%s</main><aside><h3>More</h3><ul><li><a href=c>Other story</a><li><a href=d>Next story</a></ul></aside><footer>&copy; 2024 Daily News. All rights reserved.</footer>",
    "<div class=topbar>Daily News</div><div id=menu><ul><li><a href=a>Home</a></li><li><a href=b>World</a></li></ul></div><div class='cookie-notice'>We use cookies. By reading on, you accept them.</div><div class=post-content><h1>Plan passes</h1>%s</div><div class=comments><h3>Comments</h3><div class=comment><b>Ann</b><p>I was there, and it was nothing like this at all, believe me.</p></div></div><div class=footer>Imprint | Contact</div>",
    "<table><tr><td class=sidebar><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></td><td class=content><h1>Plan passes</h1>%s</td></tr></table>",
    "<article><h1>Plan passes</h1>%s<form class=newsletter><p>Get our letter every morning.</p><input name=mail><input type=submit></form><div class='ad-box'>Buy one boat, get another one free.</div></article>",
])
def test_pages_of_other_kinds(page, fitted):
    assert kept(page % "".join(f"<p>{p}</p>" for p in PARAGRAPHS), fitted) == " ".join(["Plan passes", *PARAGRAPHS])


def test_reading():
    tree, f = forest("<p>a<b>b</b>c<br>d &amp;&nbsp;e<p>x  \n y<ul><li>1<li>2<ul><li>3</ul></ul><!-- no > --><script>if (a < b) '</p>'</script>z<div title='>'>q</div>a < b<hr>w<title>t</title>")
    assert tree.texts == ["abc d & e", "x y", "1", "2", "3", "z", "q", "a < b", "w"]
    assert forest("<div><p>one<div>two</div>three</p>four</div></div></div>five")[0].texts == ["one", "two", "three", "four", "five"]
    assert forest("a<!-- open <p>b")[0].texts == ["a"]
    assert forest("a<script>b")[0].texts == ["a"] and forest("a<p title='x>b</p>")[0].texts[0] == "a"
    assert forest("a<svg>b")[0].texts == ["ab"] and forest("a<svg>b</svg>c<button>d</button>e")[0].texts == ["ac e"]
    assert forest("", "   ", "<>", "&#0;&#xD800;&bogus;")[0].texts == ["<>", "��&bogus;"]
    one = forest("<div>" * 3000 + "x<p>y" + "</div>" * 10 + "z")[0]
    assert one.texts == ["x", "y", "z"]


@pytest.mark.parametrize("unit", ["<div>", "<p>", "<", "</div>", "<!--", "<a ", "<a href='", '<a "', "<svg>", "<script ", "<li>", "<ul><li>", "<td>", "&", "<b>", "<p class=a>x ", "</", "<div a='x'>y</div>", "\x00", "<title>"])
def test_half_a_megabyte_of_anything(unit):
    t = time.time()
    tree, f = forest(unit * (500_000 // len(unit)))
    assert np.isfinite(mt.marginals(f, np.ones(mt.FEATURES), np.ones((4, 2, 2)))).all()
    assert time.time() - t < 20


def test_defined_cases(spark, monkeypatch):
    monkeypatch.setattr(mt, "STEPS", 20)
    page = f"<nav><a href=x>menu</a></nav><article>{''.join(f'<p>{p}</p>' for p in PARAGRAPHS)}</article>"
    rows = [(1, "u", page), (1, "u", page), (None, None, page), (2, "u", None), (3, "u", ""), (4, "u", "<script>x</script>"), (5, "u", "<article>" + "<p>long text. " * 100_000)]
    got = mt.main_text(spark.createDataFrame([(*r, "t", 1, "n") for r in rows], SCHEMA)).collect()
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append(r)
    assert len(got) == 7 and len(by[1]) == 2 and by[1][0] == by[1][1] and by[None][0].url is None
    assert by[1][0].text == by[None][0].text != ""
    assert [by[i][0].text for i in (2, 3, 4)] == [""] * 3 and by[5][0].n_runs == 100_000
    assert mt.main_text(spark.createDataFrame([], SCHEMA)).collect() == []
    assert [r.text for r in mt.main_text(spark.createDataFrame([(1, "u", None, "", 0, "")], SCHEMA)).collect()] == [""]
