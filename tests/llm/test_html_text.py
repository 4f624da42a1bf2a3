import random

import numpy as np
import pytest

from cases import words
from folioflow.llm import html_text
from folioflow.llm.html_text import blocks, extract

SCHEMA = "page_id long, url string, html string, text string, n_chars int"


def page(rng, landmarks=True):
    """A page and its article's text."""
    paragraphs = [words(rng, rng.randint(4, 60)).capitalize() + rng.choice([".", " &amp; more.", " caf&eacute;."]) for _ in range(rng.randint(1, 9))]
    title = words(rng, 6)
    body = f"<h1>{title}</h1>" + "".join(rng.choice(["<p>{}</p>", "<p><b>{}</b></p>", "<p>\n  {}<br></p>", "<div>{}</div>"]).format(p) for p in paragraphs)
    inner = f"<article>{body}</article>" if landmarks else f'<div id="content">{body}</div>'
    links = "".join(f'<li><a href="/{k}">{words(rng, 1)}</a></li>' for k in range(6))
    html = (
        f'<!DOCTYPE html><html><head><title>x</title><style>p{{}}</style><script>var a="</p>";</script></head><body><nav><ul>{links}</ul></nav>'
        f'<!-- c --><div class="ad">{words(rng, 8)}.</div>{inner}<section class="comments"><div class="comment"><p>{words(rng, 12)}</p></div></section><footer>&copy; {words(rng, 5)}</footer></body></html>'
    )
    return html, "\n".join([title, *(p.replace("&amp;", "&").replace("&eacute;", "é") for p in paragraphs)])


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(12)
    made = [page(rng, k % 5 > 0) for k in range(150)]
    rows = [(k, f"u{k}", h, "x", 1) for k, (h, _) in enumerate(made)]
    rows += [(900, None, None, "x", 1), (901, "u", "", "x", 1), (902, "u", "just text &lt;b&gt;", "x", 1), (903, "u", "<p>unclosed <b>bold <i>", "x", 1), (904, "u", "<<<>>> <a href='", "x", 1), (905, "u", "<script>never ends", "x", 1)]
    return made, {r.page_id: r for r in extract(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}


def test_articles_come_out_whole(pages):
    made, got = pages
    assert np.mean([got[k].text == want for k, (_, want) in enumerate(made)]) > 0.97
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_odd_pages(pages):
    _, got = pages
    assert set(got) >= set(range(900, 906)) and got[900].url is None
    assert got[900].text == got[901].text == got[905].text == ""


def test_no_rows(spark):
    assert extract(spark.createDataFrame([], SCHEMA)).collect() == []


def test_blocks_decode_and_collapse():
    got = [b.text for b in blocks("<div>a&nbsp;&lt;\n b<p>c <b>d</b>e<br>f<p>g<!-- x --> h<ul><li>i<li>j</ul>k</div>")]
    assert got == ["a < b", "c de f", "g h", "i", "j", "k"]


def test_what_is_left_open_drops_no_text():
    got = lambda page: [b.text for b in blocks(page)]
    assert got("<html><head><meta charset=x><title>t</title><body><article><p>a</p></article>") == ["a"]
    assert got("<head><title>t</title><script>x</script><link href=y><p>a<p>b") == ["a", "b"]
    assert got("<head> <style>s</style> </head><header>h</header><p>a") == ["h", "a"]
    assert got("<p>a <svg class='i'/> b<p>c <svg><text>no</text></svg>d<p>e") == ["a b", "c d", "e"]
    assert got("<p>a<svg><p>b") == got("<p>a<p>b<button>") == ["a", "b"]
    assert got("<p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math> <object>o</object> <canvas>k</canvas> holds<p>b") == ["so x=1 o k holds", "b"]
    assert got("<p>a<script>b<p>c") == ["a"] and got("<p>a<title>b<p>c") == ["a", "c"] and got("<button-bar>a</button-bar>b") == ["a", "b"]
    assert got("<head><title>t<body><article><p>a</article>") == ["a"]
    assert got("<article><p>One.</p><button>Click<p>Two.</p></article>") == got("<article><p>One.</p><button>Click<p>Two.</p><button></button></article>") == ["One.", "Click", "Two."]
    assert got("<p>a<select><option>x<p>b") == ["a", "x", "b"] and got("<p>a<textarea>b<p>c") == ["a", "b", "c"]
    assert got("<p>a<svg><svg><text>n</text></svg><text>m</text></svg>b") == ["ab"]


def test_gradients():
    """The labeller's gradient against differences."""
    rng = np.random.default_rng(3)
    lstm = html_text.Lstm(5, rng)
    lstm.p = [p.astype(np.float64) for p in lstm.p]
    x, mask = rng.normal(size=(3, 4, 5)), np.array([[1, 1, 1, 1], [1, 1, 0, 0], [1, 1, 1, 0]], float)
    weight = rng.normal(size=(3, 4, html_text.HIDDEN))

    def loss():
        return float((lstm.forward(x, mask, range(4)) * weight).sum())

    loss()
    grads = lstm.backward(x, weight)
    for p, g in zip(lstm.p, grads, strict=True):
        at = tuple(rng.integers(0, n) for n in p.shape)
        p[at] += 1e-3
        up = loss()
        p[at] -= 2e-3
        down = loss()
        p[at] += 1e-3
        assert abs((up - down) / 2e-3 - g[at]) < 2e-3 * max(1, abs(g[at]))
