import pytest

from tickloom.llm import html_text as H


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>t</title>{head}</head><body>{body}</body></html>"


CASES = [
    (None, ""), ("", ""), ("<", "<"), ("just text", "just text"), (page(""), ""),
    (page("<nav>m</nav><article><h1>T</h1><p>a &amp; b&nbsp;c\n d<p>e<b>f</b></article><footer>z"), "T\na & b c d\nef"),
    (page("<article><p><b>one<br><p>two</p></article><div class='ad'>x</div>"), "one\ntwo"),
    (page("<article><p>a<script>var t='</p>';</script>b</p><style>p{}</style><!-- <p>c --><p>d</p></article>"), "ab\nd"),
    (page("<article><p>a</p><aside>s</aside><div id=comments><p>c</p></div><form>f<input></form><p>b</p></article>"), "a\nb"),
    (page("<header>h</header><main><div class='cookie-notice'>n</div><ul><li>x<li>y</ul><div hidden>q</div></main>"), "x\ny"),
    (page("<article><header><h1>T</h1></header><p title='a>b'>x &lt; y &#233; &copy &am</p></article>"), "T\nx < y é © &am"),
    (page("<article><table><tr><td>a<td>b<tr><td>c</table></article>"), "a b\nc"),
    (page("<div class=content><p>A</p><p>B</p></div><div class='sidebar x'><p>C</p></div>"), "A\nB"),
    ("<article><p>cut off <b>here</b> <a href='x", "cut off here"),
    (page("</p></div><p>stray</b> ends</p></article>"), "stray ends"),
    (page("<article>" + "<p>x</p>" * 20_000 + "</article>"), "\n".join(["x"] * 20_000)),
]


def test_pages():
    for source, text in CASES:
        assert H.main_text(source) == text, source


def test_table(spark):
    rows = [(k, f"https://u@Host.example:80/{k}", s) for k, (s, _) in enumerate(CASES)] + [(90, None, CASES[5][0]), (90, None, CASES[5][0])]
    df = spark.createDataFrame([(*r, "h", 1) for r in rows], "page_id long, url string, html string, host string, path int")
    out = {r["page_id"]: r for r in H.extract(df).collect()}
    for k, (_, text) in enumerate(CASES):
        assert (out[k]["text"], out[k]["n_chars"], out[k]["url"]) == (text, len(text), rows[k][1])
    assert H.extract(df).count() == len(rows) and H.extract(df.limit(0)).count() == 0
    assert df.select(H.host_of(df.url)).first()[0] == "host.example"


def test_style_tree_removes_what_a_site_repeats(spark):
    unlabelled = [page(f"<div class=top><p>Welcome to our site</p></div><div class=story><p>story {k} first</p><p>more of {k}</p></div>"
                       f"<div class=foot><p>All rights reserved</p></div>") for k in range(8)]
    rows = [(k, f"http://a.example/{k}", s) for k, s in enumerate(unlabelled)] + [(100 + k, "http://b.example/", unlabelled[0]) for k in range(9)]
    out = {r["page_id"]: r["text"] for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(out[k] == f"story {k} first\nmore of {k}" for k in range(8))
    # copies of one page are one page to the statistics: nothing is known about this host
    assert out[100] == "Welcome to our site\nstory 0 first\nmore of 0\nAll rights reserved"


def test_copies_of_an_article_stay(spark):
    rows = [(k, "http://a.example/x", page(f"<nav>{k}</nav><article><p>the same article</p></article>")) for k in range(30)]
    out = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["text"] for r in out} == {"the same article"}


def texts(spark, bodies):
    rows = [(k, f"http://a.example/{k}", page(b)) for k, b in enumerate(bodies)]
    out = {r["page_id"]: r["text"] for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    return [out[k] for k in range(len(rows))]


def test_style_tree_decides_inside_an_article(spark):
    bodies = [f"<div class=strip><p>All our stories</p></div><article><h1>Title {'abcdefgh'[k]}</h1><p>story <b>{k}</b></p>"
              f"<div class=box><p>Read us every day</p></div></article><p>more on {k}</p>" for k in range(8)]
    assert texts(spark, bodies) == [f"Title {'abcdefgh'[k]}\nstory {k}\nmore on {k}" for k in range(8)]


def test_text_outside_a_small_article_stays():
    assert H.main_text(page("<main><h1>T</h1><p>long text</p><article><p>teaser</p></article></main>")) == "T\nlong text\nteaser"
    assert H.main_text(page("<h1>T</h1><p>long text</p><article><p>teaser</p></article>")) == "T\nlong text\nteaser"


def test_copies_of_an_article_with_a_counter_stay(spark):
    bodies = [f"<div class=hello><p>Hello {'abcdefghij'[k]}</p></div><article><p>the same article</p><p>{k} views</p></article>" for k in range(10)]
    assert all("the same article" in t for t in texts(spark, bodies))


def test_paragraphs_with_inline_marks_stay(spark):
    bodies = [f"<article><p>{'abcdefgh'[k]} <a><b>x</b></a><em><i>y</i></em><span><b>z</b></span><u><b>w</b></u></p></article>" for k in range(8)]
    assert texts(spark, bodies) == [f"{'abcdefgh'[k]} xyzw" for k in range(8)]


@pytest.mark.parametrize("source, text", [
    ('<article class="post share"><h1>T</h1><p>Body text.</p></article>', "T\nBody text."),
    ('<article class="search-result promo"><p>Body.</p></article>', "Body."),
    ('<article><p class="side-by-side">One.</p><p id="notice-of-award">Two.</p><div class="share-buttons">x</div><p class="ad-slot">y</p></article>', "One.\nTwo."),
    ('<article><p>Body.</p><article class="comment byuser"><p>first!</p></article></article>', "Body."),
])
def test_articles_stay_whatever_their_class(source, text):
    assert H.main_text(source) == text
