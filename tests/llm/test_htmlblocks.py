"""Blocks of awkward markup, the network against plain loops, the labeller on pages it has not seen."""

from __future__ import annotations

import time
import zlib

import numpy as np
import pytest

from chronoband.llm import blocklstm
from chronoband.llm.blocklstm import HIDDEN, INPUTS, SLOTS_PATH, Network, _path_bits, _path_row, fit, made_pages, main_text
from chronoband.llm.htmlblocks import blocks, names


@pytest.mark.parametrize(("page", "texts"), [
    (None, []), ("", []), ("  \n", []), ("plain  text\n more", ["plain text more"]),
    ("<p>a &amp; b&nbsp;&copy; &#233; &am</p>", ["a & b © é &am"]),
    ("<p><b>one<br>two<p>three</b></p>four", ["one two", "three", "four"]),
    ("<ul><li>a<li>b <i>c</i>d</ul>e", ["a", "b cd", "e"]),
    ("<script>var t='</p>';</script><p>x</p><style>p{}</style><!-- <p>no</p> --><p>y<!-- cut", ["x", "y"]),
    ('<p title="a > b">t</p><p class=\'x\'>u', ["t", "u"]), ("<p>a < b and c</p>", ["a < b and c"]),
    ("<div>a<p>b<div>c</div>d</div>e", ["a", "b", "c", "d", "e"]), ("<p>end</p><a hre", ["end"]),
    ("<title>T</title><body>x<textarea>no</textarea> y<SCRIPT>z", ["x y"]),
    ("<table><tr><td>1<td>2<tr><td>3</table>", ["1", "2", "3"]), ('<p>a "quoted <b x="1>t</b></p>', ['a "quoted t']),
])
def test_blocks(page, texts):
    assert [b.text for b in blocks(page)] == texts


@pytest.mark.parametrize(("page", "texts"), [
    *[(f"<article><p>a</p><{t} x='1'/><p>b</p><p>c</p></article>d", ["a", "b", "c", "d"]) for t in ("svg", "math", "iframe", "object", "canvas")],
    *[(f"<article><p>a</p><{t}>x<p>b</p><p>c</p></article>d", ["a", "x", "b", "c", "d"]) for t in ("button", "object", "noscript")],
    *[(f"<p>a<{t}>x</p><p>b</p><p>c <{t}>no</{t}></p>d", ["ax" if t != "button" else "a", *["x"] * (t == "button"), "b", "c", "d"])
      for t in ("button", "object", "select", "canvas", "svg")],
    ("<p>Choose <select><option>x<option>y</select> one</p>z", ["Choose one", "z"]),
    ("<p>Choose <select><option>x<option>y</select></p>z", ["Choose", "z"]),
    ("<p>a</p><button><div>no</div></button><object><object>no</object>no<p>no</p></object><p>b", ["a", "b"]),
    ("<p>for <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> holds</p>", ["for x=2 holds"]),
    ("<p>a<svg><title/><style/><g>no</g></svg> b</p><p>c", ["a b", "c"]),
    ("<p>a</p><iframe>no<p>no</p>", ["a"]), ("<p>a<br>b<svg>no<br>no</svg><a>c</a></p>", ["a bc"]),
])
def test_hidden_elements_hide_only_their_own(page, texts):
    assert [b.text for b in blocks(page)] == texts


def test_unended_elements_leave_no_trace():
    page = blocks("<article><button class=x>go<p>b <a>c</a></p></article><p>d</p>")
    assert [b.path for b in page] == [("article",), ("article", "p"), ("p",)] and [b.linked for b in page] == [0, 1, 0]


def test_paths_and_links():
    page = blocks('<nav class="siteNav main-menu"><a href="x">go</a></nav><article><p>a <a>b</a></p></article>')
    assert page[0].path == ("nav", ".site", ".nav", ".main", ".menu") and page[0].linked == 2
    assert page[1].path == ("article", "p") and page[1].leaf == "p" and page[1].linked == 1
    assert names(" id=Foo2 role='nav' data-x=\"class\"") == ("foo", "nav")


def test_long_page_is_linear():
    assert len(blocks("<p>x" * 200_000)) == 200_000
    assert len(blocks("<b>" * 50_000 + "x")) == 1


@pytest.mark.parametrize(("page", "n"), [
    ("<div>x" * 200_000, 200_000), ("<font>" * 100_000 + "<p>x</p>" * 100_000, 100_000), ("<a>" * 100_000 + "<li>x" * 100_000, 100_000),
    ("<svg><style>" * 50_000 + "x", 1), ("<ul><li>x" * 50_000, 50_000), ("<div>" * 100_000 + "</p>x" * 100_000, 100_000)])
def test_deep_pages_are_linear(page, n):
    start = time.perf_counter()
    found = blocks(page)
    assert len(found) == n and time.perf_counter() - start < 10
    assert len(_path_bits(found[-1].node).to_bytes(SLOTS_PATH // 8 + 1, "little"))


def test_path_slots_are_those_of_the_names():
    page = blocks('<div class="siteNav"><p>a</p><button>x<p>b</p></div><font><font>c')
    for b in page:
        row = np.zeros(SLOTS_PATH, np.float32)
        for name in (*b.path, "leaf " + b.leaf):
            for raw in (name.encode(), b"again " + name.encode()):
                row[zlib.crc32(raw) % SLOTS_PATH] = 1
        assert np.array_equal(_path_row(b), row)


def plain_states(net, side, x):
    sigma = lambda v: 1 / (1 + np.exp(-v))
    h = c = np.zeros(HIDDEN)
    out = np.zeros((len(x), HIDDEN))
    for t in range(len(x)) if side == "f" else reversed(range(len(x))):
        z = x[t] @ net.p["x" + side] + net.p["c" + side] + h @ net.p["h" + side]
        i, f, o, g = sigma(z[:HIDDEN]), sigma(z[HIDDEN:2 * HIDDEN]), sigma(z[2 * HIDDEN:3 * HIDDEN]), np.tanh(z[3 * HIDDEN:])
        c = f * c + i * g
        h = o * np.tanh(c)
        out[t] = h
    return out


def test_batched_states_equal_plain_loops():
    rng, net = np.random.default_rng(0), Network()
    pages = [rng.normal(size=(n, INPUTS)).astype(np.float32) for n in (5, 1, 9)]
    x, mask = blocklstm._together(pages)
    p, both, _ = net.forward(x, mask)
    for k, page in enumerate(pages):
        want = np.concatenate([plain_states(net, s, page) for s in "fb"], axis=1)
        assert np.allclose(both[:len(page), k], want, atol=1e-5)


def test_gradients_by_differences():
    rng, net = np.random.default_rng(1), Network()
    pages = [rng.normal(size=(n, INPUTS)).astype(np.float32) for n in (4, 2)]
    x, mask = blocklstm._together(pages)
    y = (rng.random(mask.shape) < 0.5).astype(np.float32)

    def loss():
        p = np.clip(net.forward(x, mask)[0].astype(np.float64), 1e-9, 1 - 1e-9)
        return -((y * np.log(p) + (1 - y) * np.log(1 - p)) * mask).sum() / mask.sum()
    for name, g in net.gradients(x, mask, y).items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        kept, step = net.p[name][at], 1e-2
        net.p[name][at] = kept + step
        up = loss()
        net.p[name][at] = kept - step
        down = loss()
        net.p[name][at] = kept
        assert abs((up - down) / (2 * step) - g[at]) < 2e-2 * abs(g[at]) + 1e-4, name


SENTENCES = [f"Sentence {k} says something of its own." for k in range(60)]


@pytest.fixture(scope="module")
def network():
    return blocklstm.train(made_pages(SENTENCES))


def test_made_pages_not_seen(network):
    wrong = total = 0
    for v, y in made_pages(SENTENCES, 150, seed=77):
        x, mask = blocklstm._together([v])
        wrong += int(((network.forward(x, mask)[0][:, 0] >= 0.5) != (y > 0)).sum())
        total += len(y)
    assert wrong < 0.02 * total


PAGE = """<!doctype html><html><head><title>T</title></head><body>
<div class="cookie-notice"><p>We use cookies here.</p><button>OK</button></div>
<header><div class="logo">The Site</div></header><nav><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li></ul></nav>
<main><article><h1>Big news</h1><p>First paragraph of it.</p><div class="advert">Buy now</div><p>Second &lt;one&gt;.</p></article>
<aside class="sidebar"><h3>Related</h3><ul><li><a href=/o>Other story</a></li></ul></aside></main>
<section id="comments"><h3>Comments</h3><div class="comment"><p>I liked this article a lot.</p></div></section>
<form class="newsletter"><label>Email</label><input><p>Join us.</p></form><footer><p>Copyright</p></footer></body></html>"""


def test_extraction(spark, network):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (3, "", ""), (None, "n", "<article><p>Only words here.</p></article>"), (4, "s", "<script>x</script>")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id bigint, url string, html string, text string")
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in main_text(pages, network=network).collect()), key=str)
    text = "Big news\nFirst paragraph of it.\nSecond <one>."
    assert got == sorted([(1, "u", text, len(text))] * 2 + [(2, None, "", 0), (3, "", "", 0), (4, "s", "", 0), (None, "n", "Only words here.", 16)], key=str)


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    want = {r.page_id: "\n".join(b.text for b in blocks(r.html) if "article" in b.path) for r in pages.collect()}
    assert {r.page_id: r.text for r in main_text(pages).collect()} == want


def test_empty_table(spark):
    none = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert fit(none).p["v"].shape == (1,)
    assert main_text(none).count() == 0
