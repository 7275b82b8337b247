import pytest

from fieldloom.llm import html_style_tree

ARTICLES = [
    '<div class="has-sidebar"><article><p>text</p></article></div>',
    '<div class="sidebar"><article><p>text</p></article></div>',
    '<div class="layout no-sidebar"><main><p>text</p></main></div>',
    '<article class="post comments-open"><p>text</p></article>',
    '<article class="post category-legal"><p>text</p></article>',
    '<main><article class="post category-legal"><p>text</p></article></main>',
    '<article><header class="entry-header"><h1>text</h1></header></article>',
    '<article><h2 id="related-work">text</h2></article>',
    '<article><h2 id="search-algorithms">text</h2></article>',
    '<article><section id="discussion"><p>text</p></section></article>',
    '<article><section id="feedback"><p>text</p></section></article>',
]


@pytest.mark.parametrize("html", ARTICLES)
def test_names_lose_no_article(html):
    assert html_style_tree.main_text(f"<body>{html}</body>", set()) == "text"


def test_names_that_still_go():
    page = '<main><article><p>text</p><div class="ad-box">buy</div></article><section id="comments"><article class="comment"><p>first</p></article></section></main>'
    assert html_style_tree.main_text(page, set()) == "text"


def test_importance_decides_doubtful_names():
    page = '<article><p>text</p><section class="related"><p>more</p></section></article>'
    found = [e for e, t in html_style_tree.blocks(page) if t == "more"]
    assert html_style_tree.main_text(page, set()) == "text\nmore"
    assert html_style_tree.main_text(page, {(found[0].path, html_style_tree.text_key("more"))}) == "text"
    assert html_style_tree.main_text(page, set(), {found[0].parent.path}) == "text"


ODD = [
    ("<article><p title=it's>One two</p><p>it's three</p></article>", "One two\nit's three"),
    ("<article><p it's>One</p><p data-id=\"sidebar\" title='class=\"ad\"'>two</p></article>", "One\ntwo"),
    ('<article><p title="a > b" class = kept>One</p><p x=a"b>two</p></article>', "One\ntwo"),
    ('<article><div class="related-work">One</div><p class="share-price">two</p><section id="discussion"><p>three</p></section></article>', "One\ntwo\nthree"),
    ("<article><p>one <template><b>x</b></template>run <select><option>no</select>of <button>no</button>text</p></article>", "one run of text"),
    ("<article><p>&am<b></b>p; &amp;lt; &#x41;&nbsp;b</p></article>", "&amp; &lt; A b"),
    ("<article><p>" + "very long " * 200_000 + "</p></article>", "very long " * 199_999 + "very long"),
    ("<p " * 3000 + "<article><p>end</p></article>", "end"),
]


@pytest.mark.parametrize("html, text", ODD, ids=range(len(ODD)))
def test_markup_by_the_rules(html, text):
    assert html_style_tree.main_text(html, set()) == text
