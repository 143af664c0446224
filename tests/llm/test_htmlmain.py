import time
import html
import re

import numpy as np

from genonet.llm import htmlmain


def article(page):
    """The plain reading of the generated tables' pages: what <article> holds, block by block."""
    inside = re.search(r"<article>(.*?)(?:</article>|<footer|\Z)", page or "", re.S)
    parts = re.split(r"</?(?:p|h1)>", inside[1]) if inside else []
    found = [" ".join(html.unescape(re.sub(r"<[^>]*>?", " ", re.sub(r"</?b>", "", x))).split()) for x in parts]
    return "\n".join(x for x in found if x)


def test_blocks():
    page = "<body><nav><ul><li><a href=x>One</a><li>Two</ul></nav><p>a &amp; <b>b</b>&#233;<br>c<p>d<script>var t='</p>'</script><!-- x --> e<style>p{}</style></body>"
    assert [(t, p[-1]) for t, p, _ in htmlmain.blocks(page)] == [("One", "li"), ("Two", "li"), ("a & bé c", "p"), ("d e", "p")]
    assert htmlmain.blocks(None) == htmlmain.blocks("") == htmlmain.blocks("<p") == []
    assert [t for t, _, _ in htmlmain.blocks("1 < 2 <p>x</div></p> y &lt;p&gt;")] == ["1 < 2", "x", "y <p>"]


def test_broken_quotes():
    """A stray quote is part of a name; an unclosed value ends the tag at the first >."""
    texts = lambda page: [t for t, _, _ in htmlmain.blocks(page)]
    assert texts("<p title='it's here'>Text of the article don't lose me.</p><p>Second block.</p>") == ["Text of the article don't lose me.", "Second block."]
    assert texts('<p title="5" tall">One</p>') == ["One"] and texts('<p title="open>One</p><p>Two</p>') == ["One", "Two"]
    assert texts("<p =a = b=>x</p></><//>y<!-->a<!--->b<!-- c --!>d") == ["x", "yabd"]
    assert texts('<p title="a > b" data-x=\'">\'>One') == ["One"]
    assert htmlmain.blocks("<div title='class=no' CLASS='a b' id=x-y role=\"main\">T")[0][1] == ("div", ".a", ".b", ".x", ".y", ".main")
    assert texts('<p title="' * 20_000) == [] and texts("<p a='" * 20_000 + '"') == []


def test_layouts_without_article(spark):
    """F1 of article blocks on held-out pages none of which has an <article>."""
    pages = [p for p in htmlmain.generated(600, seed=4321) if "<article" not in p]
    xs, ys = htmlmain.labelled(pages)
    got, want = np.concatenate(htmlmain.model().labels(xs)), np.concatenate(ys) > 0
    right = (got & want).sum()
    f1 = 2 * right / (got.sum() + want.sum())
    assert len(pages) > 200 and f1 >= 0.97, f1
    print("F1", f1, len(pages))


def test_gradients_are_right():
    rng = np.random.default_rng(0)
    own = htmlmain.Labeller(1)
    own.p = {k: v.astype(np.float64) for k, v in own.p.items()}
    x, mask = htmlmain.padded([rng.standard_normal((n, htmlmain.SIZE)) for n in (3, 5)])
    y = (rng.random(mask.shape) < 0.5).astype(float)

    def loss():
        z = own.logits(x, mask)
        return ((np.log1p(np.exp(z)) - y * z) * mask).sum() / mask.sum()

    g = own.gradients(x, mask, y)
    for name in own.p:
        at = tuple(int(rng.integers(n)) for n in own.p[name].shape)
        keep = own.p[name][at]
        own.p[name][at] = keep + 1e-2
        up = loss()
        own.p[name][at] = keep - 1e-2
        down = loss()
        own.p[name][at] = keep
        assert abs((up - down) / 2e-2 - g[name][at]) < 1e-3


def test_held_out_blocks():
    xs, ys = htmlmain.labelled(htmlmain.generated(200, seed=123))
    got = htmlmain.model().labels(xs)
    assert np.mean(np.concatenate(got) == np.concatenate(ys)) > 0.99


def test_whole_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: article(r.html) for r in pages.collect()}
    rows = htmlmain.extract(pages).collect()
    assert len(rows) == len(want) and all(r.n_chars == len(r.text) for r in rows)
    assert sum(r.text == want[r.page_id] for r in rows) >= 0.98 * len(rows)


def test_edges(spark):
    long = "<html><body><nav><a>x</a></nav><article>" + "<p>Some words stand here.</p>" * 3000 + "</article></body></html>"
    rows = [(1, "u", None), (2, "u", ""), (3, None, long), (4, "u", "<html><body><div class=ad>Buy now</div></body></html>"), (4, "u", "<html><body><div class=ad>Buy now</div></body></html>")]
    pages = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, text string")
    got = sorted((r.page_id, r.n_chars) for r in htmlmain.extract(pages).collect())
    assert got == [(1, 0), (2, 0), (3, 3000 * 23 - 1), (4, 0), (4, 0)]
    assert htmlmain.extract(pages.limit(0)).count() == 0


def test_self_closed_svg(spark):
    """An empty svg is skipped like a full one, and takes nothing with it."""
    page = "<html><body><header>{0}</header><article><p>Some words{0} stand here.</p><p>And some more words here.</p></article>{1}</body></html>"
    want = htmlmain.blocks(page.format("", ""))
    icons = ["<svg/>", '<svg class="i"/>', "<svg class='a>b' />", "<SVG WIDTH=10 />", '<svg class="i"><use href="#x"/></svg>']
    assert len(want) == 2 and all(htmlmain.blocks(page.format(icon, end)) == want for icon in icons for end in ("", "<svg><path/></svg>"))
    article = "<article>" + "<p>Some words stand here.</p>" * 20 + "</article>"
    html = [f"<html><body><nav>{icon}<a>x</a></nav>{article}</body></html>" for icon in ("", '<svg class="i"/>')]
    rows = htmlmain.extract(spark.createDataFrame([(i, "u", h) for i, h in enumerate(html)], "page_id long, url string, html string")).collect()
    assert len({r.text for r in rows}) == 1 and [r.n_chars for r in rows] == [20 * 23 - 1] * 2


def test_deep_markup_takes_time_in_proportion():
    """Containers that never end, and end tags of none that is open: time and memory go with the page's length."""
    took = []
    for n in (5_000, 50_000):
        page = "<div class=a>x </b></i></section>" * n
        began = time.process_time()
        found = htmlmain.blocks(page)
        x = htmlmain.features(found)
        took.append(time.process_time() - began)
        assert len(found) == n and len(found[-1][1]) == 2 * n and x.shape[0] == n
    assert took[1] < 30 * took[0] + 1 and took[1] < 30
    path = htmlmain.blocks("<main><div id=q>a<p class='x y'>b")[1][1]
    assert path == ("main", "div", ".q", "p", ".x", ".y") and path[-1] == ".y" and len(path) == 6
    vector = np.clip(sum((htmlmain._path_vector(v) for v in path), np.zeros(htmlmain.PATH_SIZE, np.float32)), -3, 3)
    assert (htmlmain.features([("b", path, 0.0)])[0, : htmlmain.PATH_SIZE] == vector).all()
