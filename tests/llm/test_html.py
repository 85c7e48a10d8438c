"""HTML extraction: attributes, pages without wrappers, and the text against plainer versions."""

import re
from html.parser import HTMLParser

import numpy as np
import pytest

from orrery.llm import html_extract


@pytest.fixture(scope="module")
def model():
    return html_extract.default_model()


@pytest.mark.parametrize(
    "raw, found",
    [
        (' id="sidebar" width="100"', {"id": "sidebar", "width": "100"}),
        (' id="sidebar" data-id="9"', {"id": "sidebar", "data-id": "9"}),
        (' aria-hidden="false"', {"aria-hidden": "false"}),
        (' href="/class=nav"', {"href": "/class=nav"}),
        (" href=/class=nav/ x", {"href": "/class=nav/", "x": ""}),
        (' class=b title="class c" CLASS=d', {"class": "b", "title": "class c"}),
        (" hidden a = 'b c' /", {"hidden": "", "a": "b c"}),
        (" = =", {}),
    ],
)
def test_attributes(raw, found):
    assert html_extract.attributes(raw) == found


@pytest.mark.parametrize(
    "page, text",
    [
        ('<article><table><tr><td data-label="Price">5<td data-label="">6<td data-label="²">7</table></article>', "5 6 7"),
        ("<p>One two.</p><p>Three &amp; four.</p>", "One two. Three & four."),
        ("only text, no markup", "only text, no markup"),
        ("<article><p>E = <math><mi>m</mi></math> c</p><object data=x>no film</object></article>", "E = m c no film"),
        ('<nav><a href=/class=article>Home</a></nav><article><p title="class sidebar">Text.</p></article>', "Text."),
        ("", ""),
        ("   \n ", ""),
    ],
)
def test_texts(model, page, text):
    assert model.text(page) == text


def test_labels_are_read_in_training_alone():
    page = '<p data-label="1">x</p><p data-label="Price">y</p>'
    assert [n.label for n in html_extract.parse(page)] == [0] * 5
    assert [n.label for n in html_extract.parse(page.split("<p data-label=\"Price")[0], labelled=True)] == [0, 1, 1]


def test_end_tags_that_close_nothing_cost_no_walk():
    n = 20_000
    nodes = html_extract.parse("<div>" * n + "</section></i>" * n + "<b>" * n + "<hr>" * n + "x")
    assert len(nodes) == 3 * n + 2


def marginals_by_enumeration(model, nodes):
    unary = [sum(model.weights.get(f, 0.0) for f in html_extract.traits(nodes, k)) for k in range(len(nodes))]
    states = (np.arange(2 ** len(nodes))[:, None] >> np.arange(len(nodes))) & 1
    score = states @ np.array(unary)
    for k, x in enumerate(nodes[1:], 1):
        score += np.array(model.edges[html_extract.kind(x)])[states[:, x.parent], states[:, k]]
    weight = np.exp(score - score.max())
    return weight @ states / weight.sum()


@pytest.mark.parametrize(
    "page",
    [
        "<body><nav><a href=/>Home</a></nav><article><p>Text here.</p></article></body>",
        "<p>One.</p>two<footer>three</footer>",
        "<div class=ad>buy</div><main><h1>T</h1></main>",
        "<ul id=menu><li>a<li>b</ul><section class=content>c</section>",
    ],
)
def test_text_is_that_of_marginals_by_enumeration(model, page):
    nodes = html_extract.parse(page)
    belief = marginals_by_enumeration(model, nodes)
    assert np.allclose(model.marginals(nodes)[0], belief, atol=1e-9)
    assert model.text(page) == " ".join(x.text.strip() for x, p in zip(nodes, belief, strict=True) if x.tag == "#" and p > 0.5)


class Article(HTMLParser):
    """The text of the article element by the standard library's parser; blocks apart."""

    def __init__(self):
        super().__init__()
        self.inside, self.blocks = False, [""]

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        if tag == "br":
            self.blocks[-1] += " "
        elif tag in html_extract.BLOCK:
            self.blocks.append("")

    def handle_endtag(self, tag):
        self.inside &= tag != "article"
        if tag in html_extract.BLOCK:
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def test_query_gives_the_article_of_every_page(spark):
    from orrery.llm.queries import op4_html_extraction

    sf = "/root/testdata/sf0.01"
    got = {r.page_id: r for r in op4_html_extraction(spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(got) == len(pages)
    for page in pages:
        plain = Article()
        plain.feed(page.html or "")
        want = " ".join(t for b in plain.blocks if (t := re.sub(r"\s+", " ", b).strip()))
        assert (got[page.page_id].url, got[page.page_id].text, got[page.page_id].n_chars) == (page.url, want, len(want))


def test_awkward_rows(spark):
    long = "<article>" + "<p>word &lt;3 </p>" * 50_000 + "</article>"
    rows = [(1, "u", long, 3, "c"), (None, None, None, 1, None), (2, "v", "<p>x</p>", None, "n"), (2, "v", "<p>x</p>", None, "n")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text int, n_chars string")
    got = sorted(map(tuple, html_extract.extract(pages).collect()), key=repr)
    words = " ".join(["word <3"] * 50_000)
    assert got == sorted([(1, "u", words, len(words)), (None, None, "", 0), (2, "v", "x", 1), (2, "v", "x", 1)], key=repr)
    assert html_extract.extract(pages.limit(0)).collect() == []
