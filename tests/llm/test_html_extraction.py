import random
import re
import time
from html import unescape

import numpy as np
import pytest

from quern.llm import html_extraction as x

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return x.fit(spark.read.parquet(f"{SF}/pages.parquet"))


def test_given_pages_equal_their_article_elements(spark, model):
    """Brute force over the whole table by other means: a cut of the source, without the parser or the field."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    found = {r.page_id: (r.url, r.text, r.n_chars) for r in x.extract(pages, model).collect()}
    rows = pages.collect()
    assert len(found) == len(rows)
    for r in rows:
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        text = " ".join(unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", inner))).split())
        assert found[r.page_id] == (r.url, text, len(text))


PAGE = """<!doctype html><html><head><title>Site</title><script>var a = "<p>not text</p>";</script></head><body>
<header class="site-header"><div>My site</div><form class="search"><label>Find</label><input></form></header>
<nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav>
<div class="cookie-banner">We keep cookies to give you the best experience on this site. <button>Fine</button></div>
<div id="content"><h1>A &amp; B</h1><p>First   paragraph of the\n story, <a href="/x">with a link</a> and <b>more</b> words.<p>Second one&nbsp;here &lt;tag&gt;, it goes on for a while.</p>
<div class="ad"><p>Buy now, it is very cheap and very good for you.</p></div>
<p>The third paragraph ends the story, as all stories end.</p></div>
<section class="comments"><h3>Comments</h3><div class="comment"><p>I liked this story a lot, it was good to read.</p></div></section>
<aside class="sidebar"><h3>Related</h3><ul><li><a href="/r">Other story</a></li></ul></aside>
<footer>&copy; 2020 My site. All rights kept.</footer></body></html>"""


def test_an_unseen_layout(model):
    assert model.text(PAGE) == "A & B First paragraph of the story, with a link and more words. Second one here <tag>, it goes on for a while. The third paragraph ends the story, as all stories end."


def test_held_out_layouts(model):
    """Composed pages from other words and another seed: blocks that are kept or dropped wrongly."""
    rnd = random.Random(5)
    composer = x.Composer(77, [x.filler(rnd, rnd.randint(5, 80)) for _ in range(300)], [x.filler(rnd, 2) for _ in range(100)])
    right = wrong = whole = 0
    for _ in range(200):
        found = x.blocks(composer.page(), gold=True)
        same = [a == b.label for a, b in zip(model.decode(found), found)]
        right, wrong, whole = right + sum(same), wrong + len(same) - sum(same), whole + all(same)
    assert wrong < 0.02 * right and whole > 170


def test_decoding_equals_all_labellings(model):
    rnd = random.Random(2)
    found = x.blocks(PAGE)
    for _ in range(20):
        n = rnd.randint(1, 9)
        some = [rnd.choice(found) for _ in range(n)]
        emit = [sum(model.weights.get(f, 0.0) for f in fs) for fs in x.placed(some)]

        def score(labels):
            return sum(e for e, y in zip(emit, labels) if y) + sum(model.transitions[some[i].parent == some[i - 1].parent][labels[i - 1]][labels[i]] for i in range(1, n))

        best = max(score([k >> i & 1 for i in range(n)]) for k in range(2**n))
        assert np.isclose(score([int(y) for y in model.decode(some)]), best)
    assert model.decode([]) == []


def test_training_raises_the_likelihood_of_its_labels():
    pages = x.labelled([], seed=3, composed=40)
    m = x.trained(pages)
    right = sum(a == b.label for p in pages for a, b in zip(m.decode(p), p))
    assert right > 0.98 * sum(map(len, pages))


@pytest.mark.parametrize("html,texts", [
    ("a<br>b<hr>c", ["a b", "c"]),
    ("<p>a<p>b<div>c</b></span>d</div></p>e", ["a", "b", "cd", "e"]),
    ("<td>a</td><td>b</td>", ["a", "b"]),
    ("x<!-- <p>no</p> -->y <i>z</i>w", ["xy zw"]),
    ("<style>p{}</style><script>1 < 2</script><noscript>n</noscript>t", ["t"]),
    ("&#65;&amp;amp; &nbsp; &unknown; &lt;b&gt;", ["A&amp; &unknown; <b>"]),
    ("a < b & c > d <", ["a < b & c > d <"]),
    ("", []), (" \n\t ", []), ("<div><p>open", ["open"]), ("</div></p>text</p>", ["text"]),
])
def test_blocks(html, texts):
    assert [b.text for b in x.blocks(html)] == texts


def test_odd_tables(spark, model):
    schema = "page_id long, url string, html string, text string, n_chars int, _html string"
    rows = [(1, None, None, "t", 1, "h"), (None, "u", "", "t", 1, "h"), (1, "u", PAGE, "t", 1, "h"), (1, "u", PAGE, "t", 1, "h"), (2, "u", "<article><p>" + "long words. " * 200_000, "t", 1, "h")]
    df = spark.createDataFrame(rows, schema)
    found = sorted(((r.page_id, r.url, r.n_chars) for r in x.extract(df, model).collect()), key=str)
    n = len(model.text(PAGE))
    assert found == sorted([(1, None, 0), (None, "u", 0), (1, "u", n), (1, "u", n), (2, "u", 12 * 200_000 - 1)], key=str)
    empty = df.limit(0)
    assert x.extract(empty, x.fit(empty)).collect() == []


@pytest.mark.parametrize("html", ["<" * 200_000, "<!--" * 20_000, "&" * 200_000, "<a " * 50_000, "<div>" * 100_000 + "</p>" * 100_000, "<b>" * 100_000 + "</i>" * 100_000, "<p" * 50_000 + ">"])
def test_broken_pages_take_time_in_line_with_their_length(model, html):
    began = time.time()
    model.text(html)
    assert time.time() - began < 20
