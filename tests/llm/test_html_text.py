import random
import time

import numpy as np

from tidewater.llm.boosting import fit_trees
from tidewater.llm.html_text import Page, extract, fit_model, main_text, tags, training_page

PAGE = (
    "<!DOCTYPE html><html><head><title>t</title><style>p{margin:0}</style><script>var t=\"</p>\";</script></head><body><nav><ul><li><a href='/a'>a</a></li>"
    "<li><a href='/b'>b</a></li></ul></nav><!-- x --><div class=\"ad\">Buy now.</div><article><h1>Ti&amp;tle &eacute;</h1><p><b>One  \n two&nbsp;3 &lt;b&gt;.<br><p>Next "
    "<a href=x>linked</a> words, more of them here.</p><form class='newsletter'><label>Mail</label><input></form></article><div id='comments'><div class='comment'><p>I agree!</p>"
    "</div></div><footer>&copy; site &middot; all.</footer></body></html>"
)
SCHEMA = "page_id long, url string, html string, text string, n_chars string"


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    m = fit_trees(x[:2000], y[:2000])
    assert ((m.margin(x[2000:]) > 0) == y[2000:]).mean() > 0.95


def test_decoding_matches_all_labellings():
    rng = np.random.default_rng(2)
    page = Page("<div><p>a</p><p>b<div class=x>c<span id=y>d</span></div></div><ul><li>e<li>f</ul>")
    n = len(page.tag)
    for _ in range(50):
        margin = rng.normal(size=n) * 2
        best, chosen = -np.inf, None
        for code in range(2 ** (n - 1)):
            keep = np.array([True] + [bool(code >> i & 1) for i in range(n - 1)])
            if any(keep[i] and not keep[page.parent[i]] for i in range(1, n)):
                continue
            value = -np.where(keep[1:], np.logaddexp(0, -margin[1:]), np.logaddexp(0, margin[1:])).sum()
            if value > best:
                best, chosen = value, keep
        assert (page.decode(margin) == chosen).all()


def test_held_out_pages():
    rng, model, precision, recall = random.Random(5), fit_model(), [], []
    for _ in range(120):
        source, article = training_page(rng)
        found = {w.strip(".,!") for w in extract([source], model)[0].split()}
        precision.append(len(found & article) / max(1, len(found)))
        recall.append(len(found & article) / len(article))
    assert np.mean(precision) > 0.97 and np.mean(recall) > 0.94


def test_rows_of_every_kind(spark):
    want = "Ti&tle é One two 3 <b>. Next linked words, more of them here."
    deep = "<div>" * 3000 + "x"
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (3, "v", ""), (None, "w", PAGE), (4, "x", PAGE.replace("</footer></body></html>", "")), (5, "y", deep), (6, "z", "<script>" + "a<b " * 50_000), (7, "q", "<a href='" + "<" * 20_000)]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
    got = main_text(df).collect()
    assert [(r.page_id, r.url) for r in got] == [(r[0], r[1]) for r in rows]
    assert [r.text for r in got][:6] == [want, want, "", "", want, want]
    assert all(r.n_chars == len(r.text) for r in got)
    assert main_text(df.limit(0)).collect() == []


def test_pages_laid_by_hand():
    model = fit_model()
    body = "The first paragraph tells at some length what happened, where, and to whom. It has several sentences."
    more = "A second paragraph, no shorter than the first, goes on with the story and brings it to its end, as stories do."
    menu = "<ul class=menu><li><a href=/a>Home</a><li><a href=/b>News</a><li><a href=/c>About us</a></ul>"
    pages = {
        f"<body>{menu}<div id=content><h2>Headline of it</h2><p>{body}<p>{more}</div><div class=footer>Copyright, all rights.</div></body>": f"Headline of it {body} {more}",
        f"<nav>{menu}</nav><main><p>{body}</p><p>where <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math> holds, as was said at length before, and so on.</p></main>": f"{body} where x=1 holds, as was said at length before, and so on.",
        f"<div class='wrapper'><header><h1>Site</h1></header><article><p>{body}</p><ul><li>{more}</li><li>{body}</li></ul></article><aside class=related><h3>More</h3>{menu}</aside></div>": f"{body} {more} {body}",
        f"<article><p>{body}</p><p>a < b and 3 > 2 &amp;&#233; hold in the text, whatever comes, and stay as they are.</p></article><section class=comments><p>I agree with all of it.</p></section>": f"{body} a < b and 3 > 2 &é hold in the text, whatever comes, and stay as they are.",
    }
    assert extract(list(pages), model) == list(pages.values())


def test_malformed_pages_take_time_in_proportion():
    for source in ("<a " * 340_000, '<a href="x ' * 90_000, '<a ">"' * 60_000, "<i>" * 30_000 + "<div></div>" * 20_000, "<div>" * 20_000 + "</p>" * 50_000, "<b><div>" + "<i>" * 30_000 + "</b>" * 30_000, "<h1>" * 20_000 + "<td>" * 20_000):
        began = time.process_time()
        Page(source)
        assert time.process_time() - began < 6, source[:20]


def test_tags_end_outside_quotes():
    read = lambda t: [x[2:] for x in tags(t)]
    assert read('<a title="1>2" b=\'>\'>x</A ><br/>') == [("a", False, ' title="1>2" b=\'>\''), ("a", True, " "), ("br", False, "/")]
    assert read('<p class="x>y') == [("p", False, ' class="x')] and read("1 < 2 <") == [] and read("<p") == [] and read("<!-- <p> <!x>") == [("", False, "")]
    assert read("<!doctype x><?y?></ z>") == [("", False, "")] * 3
