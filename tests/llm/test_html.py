"""Main text of small pages."""

import time

import pytest

from quire.llm.html_text import main_text

ARTICLE = "A sentence that is long enough to be the text of an article, and then some more of it. " * 2


def page(inside, around=("", "")):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>{around[0]}{inside}{around[1]}</body></html>"


def test_blocks_and_references():
    t = main_text(page("<article><h1>A &amp; B&nbsp;&#233;</h1><p>one\n two<b>three</b> <i>four</i><p>five<br>six</article>"))
    assert t == "A & B é\none twothree four\nfive six"


def test_boilerplate_goes():
    around = (
        '<nav><ul><li><a href="/x">Menu</a></li></ul></nav><header>Site</header><div class="cookie-notice">We use</div>'
        '<script>var t="</p>";</script><!-- <p>no</p> --><div class="ad">Buy</div><form><p>Name</p></form>',
        '<aside>Side</aside><section id="comments"><article><p>First! ' + ARTICLE + '</p></article></section><footer>&copy;</footer>',
    )
    assert main_text(page(f"<article><p>{ARTICLE}</p><p>Short.</p></article>", around)) == f"{ARTICLE.strip()}\nShort."


def test_without_article_element():
    around = (
        '<div class="menu"><a href="/">Home</a></div><ul><li><a href=a>One</a><li><a href=b>Two</a></ul>',
        '<div id="sidebar"><p>Other</p></div>',
    )
    text = main_text(page(f"<div class='content with-sidebar'><p>{ARTICLE}</p><p>End.</p></div>", around))
    assert text == f"{ARTICLE.strip()}\nEnd."


def test_short_article_is_kept_whole():
    assert main_text(page("<article><p>Hi.</p></article>", ("<nav>Menu</nav>", "<footer>Foot</footer>"))) == "Hi."


def test_broken_pages():
    assert main_text("") == ""
    assert main_text("<nav><ul><li>x") == ""
    assert main_text("<p>a<p>b<div") == "a\nb"
    assert main_text("<body><nav><ul><li>menu<article><p>text") == "text"
    assert main_text("a < b & c") == "a < b & c"
    assert main_text('<article><p title="a>b">x</p><p class="y>z</p></article>').startswith("x")
    assert main_text("<script>" * 1000) == ""


def test_long_page():
    page = "<article>" + "<p>word &amp; word</p>" * 50_000 + "</article>"
    assert main_text(page) == "\n".join(["word & word"] * 50_000)


def test_article_inside_boilerplate():
    body = f"<article><h1>Head</h1><p>{ARTICLE}</p></article>"
    text = f"Head\n{ARTICLE.strip()}"
    assert main_text(page(f'<form action="/x"><input name="v">{body}<p>Field</p></form>')) == text
    for unclosed in ('<div class="ad">Buy', "<aside>Side", '<p class="ad">Buy', "<ul><li class=ad>Buy", '<div id="comments">', "<footer>"):
        assert main_text(page(unclosed + body)) == text, unclosed
    assert main_text(page(f'<aside>{body}</aside><p>Other text of the page that is no article at all.</p>')).startswith("Other")


def test_unclosed_skipped_paragraph_ends():
    rest = f"<p>{ARTICLE}<p>More.</div>"
    assert main_text(page(f'<div><p class="ad">Buy{rest}')) == f"{ARTICLE.strip()}\nMore."
    assert main_text(page(f'<div><ul><li class="promo">Buy<li>Item</ul>{rest}')) == f"Item\n{ARTICLE.strip()}\nMore."
    assert main_text(page(f'<div><div><div class="ad">Buy</div></div>{rest}')) == f"{ARTICLE.strip()}\nMore."


def test_wrappers_that_hold_the_text():
    inside = f"<p>{ARTICLE}</p><p>End.</p>"
    text = f"{ARTICLE.strip()}\nEnd."
    for name in ("layout no-sidebar", "has-sidebar", "header-and-content", "page-header", "sidebar-layout"):
        assert main_text(page(f'<div class="{name}">{inside}<div class="ad">Buy</div></div>')) == text, name
    assert main_text(page(f"<form>{inside}<nav>Menu</nav></form><p>Out.</p>")) == f"{text}\nOut."
    assert main_text(page(f"<main><h1>H</h1><form>{inside}</form></main>")) == f"H\n{text}"
    assert main_text(page(f'<div class="comments">{inside}</div><p>Text.</p>')) == "Text."
    section = f'<section class="discussion"><p>{ARTICLE}</p></section><section id="comments"><p>First!</p></section>'
    assert main_text(page(f"<article><p>Intro.</p>{section}</article>")) == f"Intro.\n{ARTICLE.strip()}"


def test_stray_end_tags_and_depth():
    assert main_text(page(f"<div><article><p>{ARTICLE}</p></div></span><p>End.</p></article></div>")) == f"{ARTICLE.strip()}\nEnd."
    assert main_text("<div>" * 50_000 + "</p>" * 50_000 + "text") == "text"
    assert main_text("<div><article>" + "<i>" * 20_000 + "<section>" * 20_000 + "</div></i>" * 20_000 + "text") == "text"


def test_embedded_elements_end():
    text = f"<p>{ARTICLE}</p><p>End.</p>"
    for embedded in ('<svg class="i"/>', "<p><video src=x>", "<div><object data=x></div>", "<p>x<svg><path/></svg>"):
        got = main_text(f"<article>{embedded}{text}</article>")
        assert got.endswith(f"{ARTICLE.strip()}\nEnd."), embedded
    assert main_text(f"<article><p>One <svg><text>no</text></svg>two<noscript><p>no</p></noscript> three.</p>{text}</article>").startswith("One two three.\n")
    formula = "<math><semantics><mrow><mi>x</mi><mo>=</mo><mn>1</mn></mrow><annotation>x=1</annotation></semantics></math>"
    assert main_text(f"<article><p>Let {formula} be.</p>{text}</article>").startswith("Let x=1 be.\n")


@pytest.mark.parametrize("part", ["<script ", "<a ", '<a "', "<!", "<!--", "<title>x", "<li><div>", "<p><b>", "<ul><li>", "</script ", "<div><p>", '<div class="ad"><li>'])
def test_long_broken_pages_take_linear_time(part):
    page = part * (1_000_000 // len(part))
    began = time.process_time()
    main_text(page)
    assert time.process_time() - began < 5


@pytest.mark.parametrize("deep", [3, 31, 32, 200])
def test_an_item_ends_the_one_before_whatever_is_open_in_it(deep):
    body = "This is the text of the article, long enough to be a surge of its own in any window of lines. " * 3
    page = f'<body><ul><li class="ad">{"<div>" * deep}buy this<li><p>{body}</p></ul></body>'
    assert main_text(page) == body.strip()
