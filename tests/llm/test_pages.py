"""Main text of pages: broken, deep and hostile pages, names that only look like furniture, and an extractor of another make."""

import time
from html.parser import HTMLParser

import pytest

from assayer.llm import html

HOSTILE = {
    "quotes": "<a '" * 250_000,
    "deep": "<div>" * 20_000 + "x",
    "inline": "<p>" + "<b>" * 50_000 + "x" + "</i>" * 50_000,
    "less": "<" * 500_000,
    "unclosed": "<a " * 300_000,
    "values": '<a =">" ' * 100_000,
    "titles": "<title>" * 50_000,
    "comments": "<!-" * 200_000 + "<!--" * 1000,
    "declarations": "<!" * 300_000 + ">",
    "cells": "<table><td>" * 5000 + "<b>" * 5000 + "</i>" * 5000,
    "items": "<ul><li>" * 20_000,
    "classes": '<div class="' + "ad-x " * 100_000 + '">t</div>',
    "attributes": "<div " + "a " * 300_000 + ">x",
}


@pytest.mark.parametrize("name", sorted(HOSTILE))
def test_hostile_pages_take_linear_time(name):
    began = time.process_time()
    page = html.parse(HOSTILE[name])
    path, _ = html.candidate(page)
    html.extracted(page, path)
    assert page.known(page.spelled(path)) == path
    assert time.process_time() - began < 5


def test_deep_and_broken_pages_in_the_operator(spark):
    deep = "<article><p>" + "<b>" * 5000 + "deep" + "</b>" * 5000 + "<p>end</article>"
    after = "<div class=post><p>" + "word " * 50 + "</p></div>" + "<i>" * 3000 + "tail"
    pages = [(0, "http://a.x", deep), (1, "http://b.x/1", after), (2, "http://b.x/2", HOSTILE["quotes"]), (3, "http://c.x", "<div>" * 5000 + "y"), (None, None, "<p>no id</p>"), (None, None, "<p>no id</p>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    text = {r.page_id: r.text for r in html.main_text(df).collect()}
    assert len(html.main_text(df).collect()) == 6 and text[None] == "no id"
    assert text[0] == "deep\nend" and text[1].startswith("word word") and text[3] == "y"


def test_names_that_only_look_like_furniture(spark):
    """Formulas, drawings' labels, fallbacks, prices, blackboards and replies of an interview stay; adverts and comments go."""
    body = """<article><h1>T</h1><p>E = <math><mi>m</mi></math> end</p><div class="share-price"><p>3.50</p></div><div class="notice-board">kept</div>
    <svg><text>label</text></svg><object data=x>fallback</object><section id=side-effects>effects</section><p class="formula-one">race</p><a name="x"/>anchor
    <div class="ad">buy</div><div class="ad-slot-300x250">buy</div><div id="comments">me too</div><div class="newsletter-xyz">join</div><p class="sponsored">paid</p><div class="share-buttons">share</div>
    <form>name</form><aside>also</aside><div role=navigation>up</div><div hidden>no</div></article>"""
    df = spark.createDataFrame([(1, "http://h.x", body)], "page_id long, url string, html string")
    assert html.main_text(df).collect()[0].text == "T\nE = m end\n3.50\nkept\nlabelfallback\neffects\nrace\nanchor"


def test_tags_end_as_the_standard_says():
    cases = {
        '<p title="5" tall">a &lt; b</p><p>x < y and 3<4</p>': "a < b\nx < y and 3<4",
        "<p title='a>b'>in</p>": "in",
        '<p class=x "foo>bar</p>': "bar",
        "a<!-->b<!-- c --> d <!-- e": "ab d",
        "<ul><li>a<li>b<ul><li>c</ul><li>d</ul>": "a\nb\nc\nd",
        "<dl><dt>t<dd>d<dt>u</dl>": "t\nd\nu",
        "<table><tr><td>a<td>b<tr><td>c</table>": "a\nb\nc",
        "<p>a<div>b</div>c</p>": "a\nb\nc",
        "<script>x</SCRIPT >y<style>z": "y",
        "&eacute;&#233;&#xe9;&amp;amp;": "ééé&amp;",
    }
    for text, want in cases.items():
        page = html.parse(text)
        assert html.extracted(page, 0) == want, text


class Brute(HTMLParser):
    """The article's blocks, by the library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.blocks = 0, [""]

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        if tag in html.BLOCK:
            self.blocks.append("")
        elif tag == "br":
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        self.depth -= tag == "article"
        if tag in html.BLOCK:
            self.blocks.append("")

    def handle_data(self, data):
        if self.depth:
            self.blocks[-1] += data


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query_against_another_extractor(spark, sf):
    from assayer.llm import queries

    folder = f"/root/testdata/sf{sf}"
    want = {}
    for r in spark.read.parquet(f"{folder}/pages.parquet").collect():
        b = Brute()
        b.feed(r.html or "")
        b.close()
        want[r.page_id] = (r.url, "\n".join(x for x in (" ".join(y.split()) for y in b.blocks) if x))
    rows = queries.op4_html_extraction(spark, folder).collect()
    assert {r.page_id: (r.url, r.text) for r in rows} == want and len(rows) == len(want)
    assert all(r.n_chars == len(r.text) for r in rows)


WRAPPERS = ['<div class="site has-sidebar">{}</div>', '<div id="page" class="no-sidebar">{}</div>', '<form id="aspnetForm">{}</form>', '<div class="page with-comments">{}</div>', '<div class="sidebar-layout">{}</div>', "{}"]
ARTICLES = ['<article class="post newsletter-issue">{}</article>', "<article>{}</article>", '<main id="content">{}</main>', '<div class="post-body">{}</div>']


@pytest.mark.parametrize("wrapper", WRAPPERS)
@pytest.mark.parametrize("article", ARTICLES)
def test_what_holds_the_text_is_no_furniture(spark, wrapper, article):
    """The text is known as the page is made; furniture lies around the article and within it."""
    lines = ["The title"] + [f"Sentence {i} of this article goes on for some words, as articles do, and then it ends." for i in range(8)]
    parts = [f"<h1>{lines[0]}</h1>", *(f"<p>{x}</p>" for x in lines[1:])]
    furniture = ['<div class="ad">buy now</div>', '<div class="share-buttons"><a href=x>share</a></div>', '<aside>see also</aside>', '<div id="comments"><h2>Comments</h2><p>me too, and at some length</p></div>', "<form><input>your mail</form>"]
    for at, x in zip((2, 4, 5, 9, 7), furniture):
        parts.insert(at, x)
    around = '<nav><a href="/">home</a></nav>{}<div class="sidebar"><h3>Popular</h3><p>an older piece</p></div><footer>all rights</footer>'
    df = spark.createDataFrame([(1, "http://h.x/1", f"<html><body>{wrapper.format(around.format(article.format(''.join(parts))))}</body></html>")], "page_id long, url string, html string")
    assert html.main_text(df).first().text == "\n".join(lines)


def test_sections_of_an_article_stay_and_comments_go(spark):
    body = "<h1>T</h1><p>" + "words of the paper " * 20 + "</p>"
    own = '<section id="discussion"><h2>Discussion</h2><p>we discuss</p></section><section id="related"><h2>Related work</h2><p>others did</p></section><div id="notices"><h3>Notices</h3><p>legal</p></div>'
    not_own = '<section id="discussion"><h2>Discussion</h2><div class="comment"><p>first!</p></div></section><div id="related"><h3>More</h3><ul><li><a href=x>another long title</a></li></ul></div><section id="comments"><h2>Comments</h2><p>hm</p></section>'
    rows = [(1, "http://a.x", f"<article>{body}{own}</article>"), (2, "http://b.x", f"<article>{body}{not_own}</article>")]
    text = {r.page_id: r.text.split("\n")[2:] for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert text == {1: ["Discussion", "we discuss", "Related work", "others did", "Notices", "legal"], 2: []}


def test_an_end_tag_that_never_ends_is_looked_for_once():
    for name in ("title", "script", "textarea"):
        began = time.process_time()
        html.parse(f"<p>x</p><{name}>" + f"</{name} " * 100_000)
        assert time.process_time() - began < 2
