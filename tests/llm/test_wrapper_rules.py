"""What the wrapper of a host decides about its pages, and how large it gets."""

import json

from frameloom.llm.wrapper import align, extract, observe, rules

NO_RULES = {"inside": "", "template": []}


def host(pages):
    wrapper = observe(pages[0])
    for page in pages[1:]:
        wrapper = align(wrapper, observe(page))
    return wrapper


def test_names_inside_an_article_need_evidence():
    parts = [("div", "legal"), ("div", "related-work"), ("p", "share"), ("p", "reply"), ("section", "discussion")]
    body = "".join(f"<{t} class='{c}'>{c} of page {{0}} has words of its own</{t}>" for t, c in parts)
    menu = "<ul class='related'><li><a href='/{0}'>other story {0}</a></li><li><a href='/x{0}'>one more {0}</a></li></ul>"
    pages = [f"<body><article><p>text {i} is long enough</p>{body.format(i)}{menu.format(i)}<div class='comments'>no</div></article></body>" for i in range(3)]
    told = rules(host(pages))
    got = extract(pages[1], told).split("\n")
    assert got == ["text 1 is long enough", *(f"{c} of page 1 has words of its own" for _, c in parts)]
    assert "other story 1" in extract(pages[1], NO_RULES)  # the wrapper takes the list of links away, no name does


def test_menus_without_telling_names_go_by_alignment():
    page = "<body><article><h1>Head {0}</h1><div class='k1'><a href='/a'>Start</a></div><p>words {0} of this page only</p><div class='k2'><p>We write every day</p></div></article></body>"
    pages = [page.format(i) for i in range(6)]
    assert extract(pages[2], rules(host(pages))) == "Head 2\nwords 2 of this page only"
    assert "Start" in extract(pages[2], NO_RULES) and "We write" in extract(pages[2], NO_RULES)


def test_text_beside_an_article_element_stays():
    page = "<body><div class='page'><article><p>begin {0} with words</p></article><div class='story-end'><p>end {0} of the story</p></div><div class='k'><p>always the same</p></div></div></body>"
    pages = [page.format(i) for i in range(5)]
    assert extract(pages[3], rules(host(pages))) == "begin 3 with words\nend 3 of the story"
    assert extract(pages[3], NO_RULES) == "begin 3 with words"


def test_main_stands_for_a_teaser_beside_it():
    page = "<body><main><p>the long text of this very page</p></main><article><p>teaser</p></article></body>"
    assert extract(page, rules(observe(page))) == "the long text of this very page"
    listing = "<body><article><p>first of two</p></article><article><p>second</p></article></body>"
    assert extract(listing, rules(observe(listing))) == "first of two\nsecond"


def test_a_varied_host_has_a_bounded_wrapper():
    page = "<body><article>" + "".join(f"<div class='n{{0}}x{j}'><p>text {{0}} {j}</p></div>" for j in "abcd") + "<p>own {0}</p><div>Read more of us</div></article></body>"
    letters = lambda i: "".join(chr(97 + int(d)) for d in str(i))
    pages = [page.format(letters(i)) for i in range(400)]
    few, many = host(pages[:100]), host(pages)
    assert len(json.dumps(many)) < 1.3 * len(json.dumps(few)) < 40_000
    assert extract(pages[7], rules(many)).split("\n") == [*(f"text h {j}" for j in "abcd"), "own h"]
