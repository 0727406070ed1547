import pytest

from panelspark.llm import html_consensus as H
from panelspark.llm.common import read
from panelspark.llm.queries import QUERIES

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p>";</script></head><body><header>top</header>
<nav><ul><li><a href="/a">menu</a></li></ul></nav><div class="cookie-notice">We use cookies</div><div class="ad">buy</div><!-- c -->
<article class="post post-17"><h1>Title &amp; more</h1><p>One  two\n three<b> four</b>&nbsp;five<p>Six<br>seven &lt;x&gt; &#233;&copy
<aside>side</aside><form><p>name</p><input></form><ul><li>a<li>b</ul><table><tr><td>c</td><td>d</td></tr></table>
<section id="comments"><p>nice post</p></section></article><div class="sidebar"><p>side side</p></div><footer>&copy; x</footer></body></html>"""
TEXT = "Title & more\nOne two three four five\nSix seven <x> é©\na\nb\nc\nd"

CASES = [(None, ""), ("", ""), ("plain  text", "plain text"), (PAGE, TEXT), (PAGE[:PAGE.index("<aside>")], "Title & more\nOne two three four five\nSix seven <x> é©"),
         ("<p>a<p>b", "a\nb"), ("<div><p>x &am y</p></div>", "x &am y"), ("<body><p>a < b and c > d</p></body>", "a < b and c > d"), ("<", "<"), ("<p", ""),
         ("<script>x", ""), ("<body><nav>n</nav></body>", ""), ("<p title='a>b'>q</p>", "q"), ("<!-- open <p>x</p>", ""), ("<b>x<p>y</b>z</p>", "x\nyz")]


@pytest.mark.parametrize("page,want", CASES)
def test_extract(page, want):
    assert H.extract(page, H.best_container(page)[0]) == want


ARTICLE = "<h1>Title</h1><p>" + "word " * 40 + "</p>"
WANT = "Title\n" + " ".join(["word"] * 40)
SIDE = "<div class='sidebar'><p>side</p></div><div class='comment-list'><p>nice</p></div>"


@pytest.mark.parametrize("name", ["layout no-sidebar", "has-sidebar", "content-sidebar-wrap", "with-comments", "page-with-sidebar", "elementor-widget"])
@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_wrappers_named_like_boilerplate(name, tag):
    page = f"<body><div class='{name}'><{tag} class='text'>{ARTICLE}{SIDE}</{tag}></div><div class='footer'>f</div></body>"
    assert H.extract(page, H.best_container(page)[0]) == WANT
    page = f"<body><{tag} class='text'><div class='{name}'>{ARTICLE}{SIDE}</div></{tag}></body>"
    assert H.extract(page, H.best_container(page)[0]) == WANT


def test_article_in_a_form_and_title_in_a_header():
    for page in (f"<body><form id='all'><main>{ARTICLE}<form>f</form></main></form></body>",
                 "<body><article><div class='post-header'><h1>Title</h1><p>by x</p></div><p>" + "word " * 40 + "</p></article></body>"):
        assert H.extract(page, H.best_container(page)[0]) == WANT


def test_named_inline_elements_are_left_out():
    assert H.extract("<article><p>one <span class='share'>share</span>two</p></article>", None) == "one two"


def test_long_comments_are_left_out():
    much = "<p>" + "nice post " * 200 + "</p>"
    for page in (f"<body><article>{ARTICLE}<div class='comments-area'>{much}</div></article></body>",
                 f"<body><article>{ARTICLE}<section id='comments'><article class='comment'>{much}</article></section></article></body>",
                 f"<body><article>{ARTICLE}</article><div class='sidebar'>{much}</div></body>"):
        assert H.extract(page, H.best_container(page)[0]) == WANT


def test_consensus_overrules_a_page(spark):
    """One page's longest container is a box that the host's other pages don't use."""
    good = "<body><main class='story-{0}'><p>" + "word " * 40 + "</p></main><div class='box'><p>note</p></div></body>"
    odd = "<body><main class='story-9'><p>short</p></main><div class='box'><p>" + "filler " * 90 + "</p></div></body>"
    rows = [(i, "http://A.de/x", good.format(i)) for i in range(4)] + [(9, "http://a.de/y", odd), (10, "http://b.de/", odd), (11, None, odd), (12, "http://a.de", None), (12, "http://a.de", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {}
    for r in H.main_text(df).collect():
        got.setdefault(r.page_id, []).append(r)
        assert r.n_chars == len(r.text)
    assert got[9][0].text == "short" and got[10][0].text.startswith("filler") and got[11][0].text.startswith("filler")
    assert [r.text for r in got[12]] == ["", ""] and got[9][0].path == "/body/main.story-"
    assert H.main_text(df.limit(0)).count() == 0


def test_long_page():
    page = "<article>" + "<p>" + "x " * 500_000 + "</p>" + "<p>y</p>" * 20_000 + "<div>" * 3000
    assert len(H.extract(page, None)) == 999_999 + 2 * 20_000


def test_given_pages(spark, sf):
    """Against the shape of these pages: everything in the article, and nothing else."""
    import html
    import re
    pages = {p.page_id: p for p in read(spark, sf, "pages").collect()}
    got = QUERIES["op6_html_consensus"](spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        body = re.search(r"<article>(.*?)(</article>|$)", pages[r.page_id].html, re.S)[1]
        want = [" ".join(html.unescape(re.sub(r"<[^>]*>?", " " if False else "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        assert r.text == "\n".join(w for w in want if w)
        assert r.url == pages[r.page_id].url


LONG = "word " * 40
KEPT = [
    (f"<main><section class='intro'>Lead</section><section class='body'><p>{LONG}</p></section></main>", "Lead\n" + LONG.strip()),
    (f"<body><div class='intro'>Lead</div><div class='body'><p>{'w ' * 30}</p></div></body>", "Lead\n" + ("w " * 30).strip()),
    ("<p data-x=don't>First</p><p>It's second</p><p>Third", "First\nIt's second\nThird"),
    ("<p class=\"a\"\">First</p><p>say \"two\"</p>", "First\nsay \"two\""),
    ("<p title=\"class='ad' > x\">First</p>", "First"),
    ("<p title=\"open>First</p><p>Second</p>", "First\nSecond"),
    (f"<article><div class='share-price'>1 EUR</div><p class='related-work'>see</p><p>an <span class='notice'>important</span> word</p><p>{LONG}</p></article>",
     "1 EUR\nsee\nan important word\n" + LONG.strip()),
    (f"<body><form id='aspnet'><nav>menu</nav><div><h1>Title</h1><p>{LONG}</p></div><form><div>name</div></form></form></body>", "Title\n" + LONG.strip()),
    ("<body><form><p>name</p><p>password</p></form></body>", ""),
]


@pytest.mark.parametrize("page,want", KEPT)
def test_whole_articles(page, want):
    assert H.extract(page, H.best_container(page)[0]) == want


@pytest.mark.parametrize("name", ["sidebar-left", "ad-slot", "share-buttons", "related-posts", "menu-item", "cookie-notice", "newsletter-signup", "left-sidebar", "nav-menu-main"])
def test_boilerplate_names(name):
    page = f"<body><article>{ARTICLE}<div class='{name}'>x</div></article></body>"
    assert H.extract(page, None) == WANT


def test_deep_page_is_linear():
    import time
    times = []
    for depth in (5_000, 40_000):
        page = "<body>" + "<div class='a'>t" * depth + "</b>" * 1000
        began = time.perf_counter()
        assert H.extract(page, H.best_container(page)[0]).count("\n") == depth - 1
        times.append(time.perf_counter() - began)
    assert times[1] < 40 * times[0]


def test_made_pages():
    """Pages put together at random from known article blocks and boilerplate come back as their article."""
    import random
    rng = random.Random(5)
    junk = ["<nav><a href='/'>home</a></nav>", "<div class='ad'>buy</div>", "<aside>more</aside>", "<div class='cookie-notice'>ok?</div>", "<footer>end</footer>",
            "<form><input><p>mail</p></form>", "<script>var a='<p>x</p>'</script>", "<div class='share-buttons'>share</div>", "<div id='sidebar'><p>side</p></div>", "<!-- <p>no</p> -->"]
    for _ in range(200):
        want, inner = [], []
        for _ in range(rng.randint(1, 8)):
            words = " ".join(rng.choice(["alpha", "it's", "x &lt; y", "<b>bold</b>", "<a href=u>link</a>", "\n gap", "100%"]) for _ in range(rng.randint(5, 40)))
            plain = words.replace("<b>", "").replace("</b>", "").replace("<a href=u>", "").replace("</a>", "").replace("&lt;", "<")
            tag = rng.choice(["p", "div", "section", "h2", "blockquote"])
            inner.append(f"<{tag} data-k=it's>{words}</{tag}>")
            want.append(" ".join(plain.split()))
            if rng.random() < 0.3:
                inner.append(rng.choice(junk))
        wrap = rng.choice(["article", "main"])
        page = f"<html><body>{''.join(rng.sample(junk, 3))}<div class='page-with-sidebar'><{wrap} class='x{rng.randint(1, 9)}'>{''.join(inner)}</{wrap}></div>{''.join(rng.sample(junk, 3))}</body></html>"
        assert H.extract(page, H.best_container(page)[0]) == "\n".join(want)


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "http://a.b/", "<p>x</p>", "t", "h", "p", 5)], "page_id long, url string, html string, text string, host string, path string, n_chars int")
    assert [(r.page_id, r.url, r.text, r.n_chars) for r in H.main_text(df).collect()] == [(1, "http://a.b/", "x", 1)]
