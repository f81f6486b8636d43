import html
import itertools
import re

import numpy as np

from sievelab.llm import html_extract as h
from sievelab.llm.common import table
from sievelab.llm.q_html_extract import html_extract


def test_labels_of_unseen_drawn_pages():
    model = h.default_model()
    pages = h.labelled_pages(300, seed=99)
    pairs = [(a, b) for rows, labels in pages for a, b in zip(model.labels(rows), labels)]
    assert np.mean([a == b for a, b in pairs]) > 0.97


def test_viterbi_is_the_best_sequence():
    rng = np.random.default_rng(3)
    model = h.Model(rng.normal(size=len(h.FEATURES)), rng.normal(size=(2, 2)))
    for _ in range(20):
        rows = [rng.integers(0, len(h.FEATURES), 4).tolist() for _ in range(6)]

        def score(labels):
            return sum(model.weights[r].sum() * y for r, y in zip(rows, labels)) + sum(model.moves[a, b] for a, b in zip(labels, labels[1:]))

        best = max(itertools.product((0, 1), repeat=6), key=score)
        assert tuple(model.labels(rows)) == best


def test_given_pages_give_their_articles(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r.html for r in table(spark, sf, "pages").collect()}
    for r in html_extract(spark, sf).collect():
        article = re.search("<article>(.*)</article>", pages[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", article)]
        assert re.sub(r"\s+", " ", r.text) == " ".join(b for b in blocks if b)
        assert r.n_chars == len(r.text)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class=home>
<header><a href=/>Site</a></header><div class="cookie-notice">We use cookies &amp; more.</div>
<main><article><h1>A&nbsp;title &lt;here&gt;</h1><p>First  <b>bold</b>
text, 1 &lt; 2 &#233;.<p>Second<br>line.<div class="advert"><p>Buy this now, it is a very good thing to own.</p></div>
<ul><li>item one<li>item two</ul><script>var x = "<p>no</p>";</script><!-- <p>gone</p> --></article>
<section id="comments"><p>I think that this is a fine article and wish to say so at length.</p></section></main>
<aside class="sidebar"><p>Other stories that you may like to read today.</p></aside>
<form><label>Mail</label><input><button>Send</button></form><footer>&copy; 2020 Somebody</footer></body></html>"""


def test_odd_pages(spark):
    schema = "page_id long, url string, html string, text string"
    rows = [(1, "u", PAGE, "c"), (2, None, None, "c"), (None, "u", "", "c"), (4, "u", "<p>", "c"), (1, "u", PAGE, "c"),
            (5, "u", "<article><p>" + "word " * 200_000 + "</article>", "c"), (6, "u", "no markup < at all &", "c")]
    out = h.extract(spark.createDataFrame(rows, schema)).collect()
    want = "A title <here>\n\nFirst bold text, 1 < 2 é.\n\nSecond line.\n\nitem one\n\nitem two"
    texts = {}
    for r in out:
        texts.setdefault(r.page_id, []).append(r.text)
    assert texts[1] == [want, want] and texts[2] == texts[None] == texts[4] == [""]
    assert texts[5] == [("word " * 200_000).strip()] and len(texts[6]) == 1
    assert h.extract(spark.createDataFrame([], schema)).count() == 0


def article(page):
    blocks = h.blocks_of(page)
    return [b.text for b, on in zip(blocks, h.default_model().labels(h.page_features(blocks))) if on]


BODY = "<nav><a href=/>Home</a> <a href=/b>Bridges</a></nav>{}<footer>&copy; 2020 Somebody</footer>"
TEXTS = ["The bridge was built over the river in a long and dry summer.", "It carries the road to the old town, and people like it."]
PARAS = "".join(f"<p>{t}</p>" for t in TEXTS)


def test_classes_of_site_themes_do_not_outweigh_the_article():
    for names in ("has-sidebar header-fixed", "page comments-open social", "sidebar nav footer"):
        assert article(f'<html><body class="{names}">' + BODY.format(f"<article>{PARAS}</article>") + "</body></html>") == TEXTS
    assert article('<div class="site has-sidebar">' + BODY.format(f"<main>{PARAS}</main>") + "</div>") == TEXTS


def test_title_in_a_header_of_the_article_stays_and_that_of_the_site_goes():
    page = "<body><header><h1>The Site</h1></header>" + BODY.format(f"<article><header><h1>Bridge</h1></header>{PARAS}</article>")
    assert article(page) == ["Bridge", *TEXTS]


def test_comments_in_articles_of_their_own_go():
    said = "<section id=comments><article><p>I think that this is a fine bridge and like it.</p></article></section>"
    assert article(BODY.format(f"<article>{PARAS}</article>{said}")) == TEXTS


def test_stray_quotes_do_not_swallow_text():
    page = "<article><div data-x=it's>First para of the text.</div><p>Second para don't miss.</p></article>"
    assert [b.text for b in h.blocks_of(page)] == ["First para of the text.", "Second para don't miss."]
    assert [b.text for b in h.blocks_of('<p title="a > b">one</p><p title="never closed>two</p><p>three</p>')] == ["one", "two", "three"]
    assert [b.text for b in h.blocks_of("<p>1 < 2 <p class='x'>a <b")] == ["1 < 2", "a <b"]


def test_hostile_pages_take_linear_time():
    import time

    began = time.time()
    h.blocks_of('<a "' * 250_000)
    h.blocks_of('<a "' * 250_000 + ">")
    h.blocks_of('<a x="' * 170_000 + ">" + "<p>text")
    h.blocks_of("<a x='>\"" * 100_000)
    h.blocks_of("<script>" + "</script" * 120_000)
    h.blocks_of("<!-" * 300_000 + ">" + "<!--" * 200_000)
    assert len(h.page_features(h.blocks_of("<div class=content>a" * 100_000))) == 100_000
    h.blocks_of("<span>" * 100_000 + "<li>x" * 50_000)
    assert time.time() - began < 30
