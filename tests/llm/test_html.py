import time

import numpy as np
import pytest

from rankweave.llm import html_extract as H
from rankweave.llm.html_blocks import blocks


def test_blocks_of_sound_and_broken_markup():
    html = "<!DOCTYPE html><title>no</title><script>var t='</p>';</script><style>p{}</style><!-- <p>no</p> --><p>a &amp; b<br>c <b>d</b><p>e\n  f</p><ul><li>g<li>h</ul>1 < 2<div>i<span class=ad>j</span></div>"
    assert [b.text for b in blocks(html)] == ["a & b c d", "e f", "g", "h", "1 < 2", "ij"]
    assert [b.path for b in blocks("<div class='siteFooter x'><p>a</p></div>")] == [("div site footer x", "p")]
    assert blocks("") == [] and blocks("<p> &nbsp; </p>") == [] and [b.text for b in blocks("plain")] == ["plain"]
    assert [b.text for b in blocks("<p>a<script>b")] == ["a"] and [b.text for b in blocks("<p title='>'>a</p>")] == ["a"]
    assert blocks("<a href=x>link</a>")[0].linked == 4
    deep = blocks("<div>" * 3000 + "x")
    assert len(deep) == 1 and len(blocks("<p>y" * 5000)) == 5000


@pytest.mark.parametrize("piece", ["<!--", "<a ", "<p", "<title>", '<a "', '<a ">" ', "<a '\"", "</p"])
def test_time_grows_with_the_page_only(piece):
    began = time.process_time()
    blocks(piece * 60_000)
    blocks(piece * 60_000 + ">")
    assert time.process_time() - began < 5


def test_all_words_of_a_class_count():
    assert blocks("<p class='a b c d e f g h i footer'>x</p>")[0].path == ("p a b c d e f g h i footer",)


@pytest.fixture(scope="module")
def labeller():
    return H.trained()


def test_held_out_pages(labeller):
    pages = H.made_pages(200, 4242)
    got = labeller.label([H.features(b) for b, _ in pages])
    right = np.concatenate([g == (y > 0.5) for g, (_, y) in zip(got, pages, strict=True)])
    assert right.mean() >= 0.97


def test_gradients():
    rng = np.random.default_rng(0)
    lstm = H.Lstm(rng, 3, 2)
    for name in ("w", "u", "b"):
        setattr(lstm, name, getattr(lstm, name).astype(np.float64))
    x, mask = rng.normal(size=(4, 2, 3)), np.array([[1, 1], [1, 1], [1, 0], [1, 0]], float)
    weight = rng.normal(size=(4, 2, 2))

    def loss():
        return float((lstm.forward(x, mask)[0] * weight).sum())

    _, trace = lstm.forward(x, mask, keep=True)
    for w, g in zip((lstm.w, lstm.u, lstm.b), lstm.backward(x, weight, trace), strict=True):
        for at in [tuple(rng.integers(0, s) for s in w.shape) for _ in range(4)]:
            old = w[at]
            w[at] = old + 1e-2
            up = loss()
            w[at] = old - 1e-2
            down = loss()
            w[at] = old
            assert g[at] == pytest.approx((up - down) / 2e-2, abs=2e-3)


PAGE = """<html><head><title>T</title></head><body><div class="cookie-notice">We use cookies</div><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav>
<article><h1>The long way home</h1><p>It was a cold and rainy night, and nobody was out.</p><div class="ad">Buy now</div><p>Then, at last, the sun came up over the hills &amp; fields.</p></article>
<aside class="sidebar"><h3>Most read</h3><ul><li><a href=/c>Other story</a></li></ul></aside><div id="comments"><h3>Comments</h3><div class="comment"><p>Great post!</p></div></div>
<form><label>Name</label><button>Send</button></form><footer>&copy; 2024</footer></body></html>"""


def test_a_page_in_text(labeller):
    assert H.extract_texts([PAGE, None, "", "<p></p>"], labeller) == ["The long way home\n\nIt was a cold and rainy night, and nobody was out.\n\nThen, at last, the sun came up over the hills & fields.", "", "", ""]


def test_frames(spark, labeller):
    df = spark.createDataFrame([(1, PAGE, "old"), (2, None, None), (2, None, None)], "page_id long, html string, text string")
    out = H.extract(df, labeller=labeller)
    assert out.columns == ["page_id", "html", "text"] and sorted(r.text for r in out.collect())[:2] == ["", ""]
    assert H.extract(df.where("false"), labeller=labeller).count() == 0


def test_query_gives_the_articles(spark, data):
    from rankweave.llm.queries import op4_html_extract

    html = {r.page_id: r.html for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    rows = op4_html_extract(spark, data).collect()
    gold = {k: "\n\n".join(b.text for b in blocks(h) if any(p.startswith("article") for p in b.path)) for k, h in html.items()}
    assert len(rows) == len(html) and all(r.n_chars == len(r.text) for r in rows)
    assert sum(r.text == gold[r.page_id] for r in rows) / len(rows) >= 0.95
