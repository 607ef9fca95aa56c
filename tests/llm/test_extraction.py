import html
import re

from docpipe.llm import extraction as X


def plain(page):
    a = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)[1]
    parts = re.split(r"</?(?:p|h1)>", a)
    return "\n\n".join(t for t in (" ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub("<br>", " ", b))).split()) for b in parts) if t)


def test_pages(spark):
    d = "/root/testdata/sf0.01"
    want = {r.page_id: plain(r.html) for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
    rows = X.query(spark, d).collect()
    assert {r.page_id: r.text for r in rows} == want and all(r.n_chars == len(r.text) for r in rows)


PAGE = '<html><head><title>t</title></head><body><div class="top"><ul><li>Home<li>News</ul></div><div id=main><h1>{0}</h1>{1}<p class=by>Written by the desk</p></div><div class="comments"><p>Nice one</p></div><div class=foot>About us</div></body></html>'


def test_wrapper_finds_template(spark):
    pages = [(i, "http://h.org/%d" % i, PAGE.format(f"Title {i}", "".join(f"<p>Body {i} {k} is long enough to weigh</p>" for k in range(i % 4 + 1)))) for i in range(12)]
    pages[3] = (3, "http://h.org/3", "<p>odd page &amp; broken <b>tag")
    out = {r.row.page_id: r.text for r in X.extracted(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert out[5] == "Title 5\n\nBody 5 0 is long enough to weigh\n\nBody 5 1 is long enough to weigh"
    assert out[3] == "odd page & broken tag"


def test_alignment():
    w = X.of_page("<body><div><p>a</p><p>b</p></div><footer>f</footer></body>")
    w.meet(X.of_page("<body><h1>x</h1><div><p>c</p></div><footer>f</footer></body>"))
    assert w.expression() == "<body> (<h1> x </h1>)? <div> (<p> # </p>)+ </div> <footer> f </footer> </body>"
    w = X.of_page("<dl><dt>a<dd>b<dt>c<dd>d</dl>")
    assert w.expression() == "<dl> (( <dt> # </dt> <dd> # </dd> ))+ </dl>"


def test_boilerplate_inside_the_article():
    page = "<main><article><header><h1>Ti&amp;tle</h1></header><p>One <b>two</b>\n three.<br>four<div class='share'>Share</div><aside>s</aside><form>f</form><script>x<p>y</script><style>q</style><section id=comments><p>nice</p></section></article></main>"
    assert X.extract(page, None) == "Ti&tle\n\nOne two three. four"


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "", ""), (3, "x", "<div" * 3), (4, "http://a/", "<!-- cut"), (5, "http://a/", "<script>never closed"), (6, "http://A:80/x", "plain &lt; text &am"), (6, "http://A:80/x", "plain &lt; text &am"), (7, "http://b", "<div>" * 3000 + "deep")]
    df = spark.createDataFrame([(*r, "row", "text") for r in rows], "page_id long, url string, html string, row string, text string")
    out = sorted((r.row.page_id, r.text) for r in X.extracted(df).collect())
    assert out == [(1, ""), (2, ""), (3, ""), (4, ""), (5, ""), (6, "plain < text &am"), (6, "plain < text &am"), (7, "deep")]
    assert X.extracted(df.where("page_id = 0")).count() == 0


def test_many_hosts_are_joined_by_salt(spark, monkeypatch):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    want = sorted((r.row.page_id, r.text) for r in X.extracted(pages).collect())
    monkeypatch.setattr(X, "BROADCAST_BYTES", 0)
    assert sorted((r.row.page_id, r.text) for r in X.extracted(pages).collect()) == want


def test_marks():
    for name in ("comment-list", "commentList", "siteFooter", "ad", "cookie-notice", "side-bar nav", "reader-comments", "Sidebar2"):
        assert any(X.marked(x, "div") for x in name.split()), name
    for name in ("content has-sidebar", "no-comments", "gradient", "story", "shaded", "article-body", "headline"):
        assert not any(X.marked(x, "div") for x in name.split()), name
    assert X.marked("comment", "article") and not X.marked("post-ad", "article")
    page = "<body class='page sidebar'><div class='wrap has-sidebar'><article class='post'><div class='post-header'><h1 class='header'>T</h1></div><p>a b</p><p class='notice'>n</p><div class=AdBox>buy</div></article><ol class='commentlist'><li>hi</ol></div></body>"
    assert X.extract(page, None) == "T\n\na b"


def test_title_beside_the_body_stays(spark):
    page = "<body><div class=a><ul><li>Home<li>Contact the desk of this site at any time</ul></div><div class=b><h1>Title {0}</h1><section><p>First {0} words of the text</p><p>Second {0} words of it</p></section></div><div class=c>All of this is ours and nobody else's</div></body>"
    pages = spark.createDataFrame([(i, "http://t.org/", page.format("abcdefghi"[i] * 3)) for i in range(9)], "page_id long, url string, html string")
    assert {r.text for r in X.extracted(pages).collect()} == {f"Title {x}\n\nFirst {x} words of the text\n\nSecond {x} words of it" for x in (c * 3 for c in "abcdefghi")}


def test_texts_of_few_values_stay(spark):
    # Table cells of two values, many times in a page; eight articles, five copies of each; a line that stands on all pages.
    words = "alpha beta gamma delta omega sigma kappa theta".split()
    page = "<body><article><h1>{0}</h1><p>All about {0} alone</p>{1}<p>Printed by us</p></article></body>"
    cells = "<table><tr><td>Yes<td>No<tr><td>No<td>Yes</table>"
    rows = [(i, "http://few.org/", page.format(w, cells if i < 4 else "")) for i, w in enumerate(words) for _ in range(5)]
    got = {r.row.page_id: r.text for r in X.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"{w}\n\nAll about {w} alone" + ("\n\nYes\n\nNo\n\nNo\n\nYes" if i < 4 else "") for i, w in enumerate(words)}


BARE = "<body><div><div>{menu}</div><div>{teaser}</div><div>{body}</div><div>{legal}</div></div></body>"


def test_hosts_whose_tags_and_classes_tell_nothing(spark):
    words = "alpha beta gamma delta omega sigma kappa theta zeta iota".split()
    menu, legal = "".join(f"<div>Go to part {k} of our site</div>" for k in range(30)), "<div>" + "All rights are ours, and this notice stands on every page of this site. " * 12 + "</div>"
    bodies = [[f"Story {w} begins here and goes on for a while", *[f"Part {k} of {w} tells what {w} did then and why it mattered" for k in range(i % 3 + 1)]] for i, w in enumerate(words)]
    page = [BARE.format(menu=menu, teaser=f"<p>See {w}</p>" if i % 2 else "", body="".join(f"<div>{x}</div>" for x in b), legal=legal) for i, (w, b) in enumerate(zip(words, bodies, strict=True))]
    df = spark.createDataFrame([(i, "http://bare.org/", p) for i, p in enumerate(page)], "page_id long, url string, html string")
    got = {r.row.page_id: r.text for r in X.extracted(df).collect()}
    assert got == {i: "\n\n".join(b) for i, b in enumerate(bodies)}
    assert not any(X.extract(p, None) == got[i] for i, p in enumerate(page))


def test_many_blocks_before_the_article(spark):
    pages = [(i, "http://many.org/", "<body>" + "".join(f"<div class='k{chr(97 + (i * 7 + k) % 26)}{k}'>Block {k} {i} of this page</div>" for k in range(70)) + f"<article><p>Article {'abcdefghijkl'[i]} text</p></article></body>") for i in range(12)]
    got = {r.row.page_id: r.text for r in X.extracted(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Article {'abcdefghijkl'[i]} text" for i in range(12)}


def test_excluded_elements_below_the_deepest():
    assert X.extract("<div>" * 120 + "<nav>Menu</nav><p>deep</p><form>f</form><p>er", None) == "deep\n\ner"
    assert X.extract("<div>" * 120 + "a<div class=sidebar>b<p>c</div>d", None) == "a\n\nd"


def test_long_lists_align_at_singles():
    a = [f"p.x{k % 50}" if k % 7 else f"div.only{k}" for k in range(600)]
    b = ["h1", *a[:300], "hr", *a[300:], "footer"]
    assert X.aligned(a, b) == [(k, k + 1 + (k >= 300)) for k in range(600)]
    got = X.aligned(["a", "b"] * 300, ["b", "a"] * 300)
    assert len(got) >= 300 and all(p < r and q < s for (p, q), (r, s) in zip(got, got[1:]))


def test_repeated_and_optional_places():
    items = [["h1", "1", [], 0], ["(dt dd)", "+", [["dt", "1", [], 0], ["dd", "?", [], 0]], 0], ["p", "*", [], 0], ["footer", "?", [], 0]]
    level = X.Level(items, [])
    assert level.places(["h1", "dt", "dd", "dt", "dt", "dd", "p", "p"]) == [0, 1, 2, 1, 1, 2, 3, 3]
    assert X.Level([["p", "1", [], 0], ["div", "1", [], 0], ["p", "1", [], 0]], []).places(["div.k", "section", "p"]) == [1, -1, 2]


def test_very_long_page():
    body = "".join(f"<p>Paragraph {k} of the text</p>" for k in range(40_000))
    assert X.extract(f"<nav>n</nav><main>{body}</main>", None).count("\n\n") == 39_999


def texts_of_pages(spark, htmls):
    rows = [(k, f"https://one.example/{k}", h) for k, h in enumerate(htmls)]
    return {r.row.page_id: r.text for r in X.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


WORDS = ["alpha", "bravo", "carbon", "delta", "ember", "forest", "garnet", "harbor", "indigo", "jasper"]


def test_fixed_labels_of_an_article_stay(spark):
    page = "<body><nav>Home</nav><article><h1>{w}</h1><p>All about {w}</p><table><tr><th>Colour<td>{w}x<tr><th>Weight<td>{w}y</table><p>Ingredients:</p><ul><li>Salt<li>{w}</ul><div><p>Printed with care.</p><p>Ask your doctor.</p></div></article></body>"
    got = texts_of_pages(spark, [page.format(w=w) for w in WORDS])
    for k, w in enumerate(WORDS):
        assert got[k].split("\n\n") == [w, f"All about {w}", "Colour", f"{w}x", "Weight", f"{w}y", "Ingredients:", "Salt", w]  # the div is the template's as a whole


def test_compound_names_in_an_article_stay(spark):
    page = (
        "<article><h1>{w}</h1><p class='side-effects'>effects of {w}</p><div class='social-history'>history of {w}</div><p class='ad-hoc'>hoc {w}</p><section id='notice-period'>period {w}</section>"
        "<p class='lead promo-text'>lead {w}</p><div class='related-reading'><a href=x>read {w} too</a></div><div class='ad-slot'>buy {w}</div><div class='comment-text'>a reader of {w}</div></article>"
    )
    got = texts_of_pages(spark, [page.format(w=w) for w in WORDS])
    for k, w in enumerate(WORDS):
        assert got[k].split("\n\n") == [w, f"effects of {w}", f"history of {w}", f"hoc {w}", f"period {w}", f"lead {w}"]


def test_two_articles_of_a_page_are_parts(spark):
    page = "<main><article class=head><h1>{w}</h1><p>the first part of {w}</p></article><article class=facts><p>more of {w}, and as long as that</p><table><tr><td>t<td>{w}</table></article><article class=teaser><a>b</a></article></main>"
    got = texts_of_pages(spark, [page.format(w=w) for w in WORDS])
    assert all(x in got[0] for x in ("the first part of alpha", "more of alpha", "alpha"))
