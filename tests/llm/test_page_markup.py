"""Class and id names as wholes, wrappers that hold the text, recurring boxes, and whole pages against an extractor of its own."""

import re
from html.parser import HTMLParser

import pytest

from tessera.llm import html_text
from tessera.llm.html_text import main_text

LONG = "<p>A long paragraph of the story itself, with words enough.</p><p>And a second one that goes on for a while.</p>"
TEXT = "A long paragraph of the story itself, with words enough.\nAnd a second one that goes on for a while."


@pytest.mark.parametrize("attributes", [
    'class="container has-sidebar"', 'id="page" class="nav-closed"', 'class="post social-science"', 'class="content menu-open"', 'id="header-wrapper-2col"', 'class="layout"', 'class="no-ads"',
    'id="main" class="sidebar"', 'class="widget"', 'class="page-header"', 'class="advertising-law"', 'class="notice-board"', 'class="commentary"',
])
def test_wrappers_keep_the_text(attributes):
    """Names that only contain a word of a frame, and frames around the whole text."""
    assert main_text(f"<body><div {attributes}>{LONG}</div><div class='footer'>Imprint</div></body>") == TEXT


def test_a_form_around_everything():
    assert main_text(f"<form id='aspnetForm'><nav>m</nav>{LONG}<form>a form of its own</form></form>") == TEXT
    assert main_text(f"<div>{LONG}<form><p>Your mail</p><input></form></div>") == TEXT


@pytest.mark.parametrize("box", [
    '<div class="advert-box"><p>Buy now</p></div>', '<div class="ad-slot">Buy</div>', '<div id="ad_15"><p>x</p></div>', '<div class="comments-area"><p>First! I liked it.</p></div>', '<ol class="comment-list"><li><p>me too</p></li></ol>',
    '<section id="comments"><h3>2 comments</h3><p>a</p></section>', '<div class="postComments"><p>a</p></div>', '<div class="google-ad">x</div>', '<div class="ad">x</div>', '<div class="share-buttons">Share</div>', '<div class="cookie-notice"><p>We use cookies</p></div>',
    '<div class="newsletter-signup"><p>Subscribe!</p></div>', '<div role="complementary">x</div>', '<div class="site-footer">x</div>', '<div class="main-nav">x</div>', '<div class="promo">Sale</div>', "<aside><p>y</p></aside>", '<div style="display: none"><p>z</p></div>',
])
@pytest.mark.parametrize("page", ["<article>{}</article>", "<div>{}</div>", "<main><p>before the box</p>{}</main>"])
def test_boxes_go(box, page):
    before = "before the box\n" if "before" in page else ""
    assert main_text(page.format(box + LONG)) == before + TEXT and main_text(page.format(LONG + box)) == before + TEXT


def test_long_comments_go():
    assert main_text(f"<article>{LONG}</article><div class='comments'>{'<p>I have a lot to say about this.</p>' * 50}</div>") == TEXT
    assert main_text(f"<div>{LONG}<div id='disqus_thread'>{'<p>I have a lot to say about this.</p>' * 50}</div></div>") == TEXT


def test_text_in_boxes_of_weak_names_stays():
    assert main_text('<article><p>one</p><div class="promo"><p>Important text</p></div></article>') == "one\nImportant text"
    assert main_text('<article><p>one</p><p class="notice">two</p><div class="social-history"><p>three</p></div></article>') == "one\ntwo\nthree"


def test_recurring_boxes_inside_articles_go(spark):
    """What only the counts can tell: a notice that recurs in a site's articles goes, a box that does not stays."""
    box = '<div class="notice"><p>This article is part of our summer series.</p></div>'
    rows = [(i, f"http://h.example/{i}", f"<article><p>Text number {i} stands here, long enough to be a text.</p>{box}<div class='notice'><p>Only on page {i}.</p></div></article>") for i in range(8)]
    rows += [(100, "http://other.example/", f"<article><p>Text.</p>{box}</article>")]
    got = {r["page_id"]: r["text"] for r in html_text.op3_site_templates(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Text number {i} stands here, long enough to be a text.\nOnly on page {i}." for i in range(8))
    assert got[100] == "Text.\nThis article is part of our summer series."


class Plain(HTMLParser):
    """The article's blocks of well-formed pages, by the standard library's parser."""

    BLOCKS = {"article", "p", "h1", "h2", "h3", "h4", "li", "ul", "ol", "div", "section", "blockquote", "pre", "table", "tr", "td", "th", "br"}
    SKIP = {"script", "style", "nav", "footer", "aside", "form", "title"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.skip, self.parts = 0, [], []

    def handle_starttag(self, tag, attributes):
        if tag == "article":
            self.inside += 1
        if tag in self.SKIP or dict(attributes).get("class") == "ad" or self.skip:
            if tag not in ("br", "img", "hr", "meta", "link", "input"):
                self.skip.append(tag)
        elif tag in self.BLOCKS and self.inside:
            self.parts.append(" " if tag == "br" else "\n")

    def handle_endtag(self, tag):
        if self.skip:
            if tag in self.skip:
                while self.skip.pop() != tag:
                    pass
        elif tag in self.BLOCKS and self.inside:
            self.parts.append("\n")
        if tag == "article":
            self.inside -= 1

    def handle_data(self, data):
        if self.inside and not self.skip:
            self.parts.append(re.sub(r"\s+", " ", data))


def test_whole_pages_against_another_extractor(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html_text.op3_site_templates(pages).collect()}
    for r in pages.collect():
        other = Plain()
        other.feed(r["html"])
        other.close()
        assert got[r["page_id"]] == "\n".join(x for x in (" ".join(b.split()) for b in "".join(other.parts).split("\n")) if x), r["page_id"]
