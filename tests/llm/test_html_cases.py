"""Main text of single pages whose markup misleads, and of a host where only the template tells."""

import pytest

from palaver.llm import html

LONG = "Body text of the page that is long enough to be most of it."
CASES = {
    "a form around the page": (f"<form id='aspnetForm'><nav><a>Home</a></nav><p>{LONG}</p></form>", LONG),
    "a form around an article": (f"<form id='aspnetForm'><nav>x</nav><article><p>{LONG}</p></article></form>", LONG),
    "a form of its own": (f"<form><label>Search <input></label></form><p>{LONG}</p>", LONG),
    "an article of blanks": ("<article>&nbsp; </article><div><p>Body text outside</p></div>", "Body text outside"),
    "a card in the main element": (f"<main><p>{LONG}</p><article>teaser card</article></main>", f"{LONG}\nteaser card"),
    "an article in the main element": (f"<main><p>By line</p><article><p>{LONG}</p></article></main>", LONG),
    "a menu that is never closed": ("<nav><a>Home</a><p>Body</p>", "Body"),
    "a footer that is cut off": (f"<p>{LONG}</p><footer><p>Imprint", LONG),
    "a head that is never closed": ("<head><title>t</title><p>x</p>", "x"),
    "a script in a line": ("<p>Hello <script>x()</script>world</p>", "Hello world"),
    "a drawing in a line": ("<p>Hello <svg><path d=1/><g><title>t</title></g></svg>wor<b>ld</b> <button>ok</button>!</p>", "Hello world !"),
    "more comments than text": ("<p>Body short.</p><div class='comments'><p>" + "blah " * 50 + "</p></div>", "Body short."),
    "comments as articles": ("<article><p>Body</p></article><section id=comments><article class=comment><p>one two three four</p></article></section>", "Body"),
    "comments around all": (f"<div class='has-comments'><article><p>{LONG}</p></article></div>", LONG),
    "references": ("<p>a&lt;b&gt; &amp;amp; &eacute;&nbsp;c</p>", "a<b> &amp; é c"),
    "nothing": ("", ""),
}


@pytest.mark.parametrize("name", CASES)
def test_case(name):
    page, want = CASES[name]
    assert html.main_text(page, None) == want


def test_very_long_pages():
    """Linear in a page's size, whatever is nested or left open."""
    assert html.main_text("<p>" + "w " * 500_000 + "</p>", None).count("w") == 500_000
    assert html.main_text("<div>" * 20_000 + "x" + "<b>" * 20_000, None) == "x"
    assert html.main_text("<nav>" * 5_000 + "<p>x</p>", None) == "x"


def test_templates_decide(spark):
    """No name or element tells the site's own lines from the text; only what pages of a host have in common does."""
    words = [f"word{i}" for i in range(60)]
    page = lambda i: f"<div><div>Our site since 1999</div><div>{' '.join(words[i : i + 20])}</div><div>All rights with us</div></div>"
    rows = [(i, "http://same.example/a", page(i)) for i in range(12)] + [(100, "http://other.example/", page(3))]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {**{i: " ".join(words[i : i + 20]) for i in range(12)}, 100: f"Our site since 1999\n{' '.join(words[3:23])}\nAll rights with us"}
