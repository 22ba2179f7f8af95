"""Main text of pages: templates by host, the form of what is rare, odd markup; the stored pages against a plain restatement."""

import html as stdlib_html
import re

import pandas as pd

from docmill.llm import html, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "page_id long, url string, html string, text string"


def text(source, templates=frozenset()):
    page = html.Page(source)
    page.survey()
    return page.text(templates)


def test_stored_pages(spark):
    """On these pages the main text is what stands in <article>."""
    pages = pd.read_parquet(f"{SF}/pages.parquet")
    got = queries.op11_html_extraction(spark, SF).toPandas().set_index("page_id")
    assert len(got) == len(pages)
    for i, url, source in zip(pages.page_id, pages.url, pages.html, strict=True):
        inner = re.search(r"<article>(.*?)</article>", source, re.S)[1]
        want = " ".join(stdlib_html.unescape(re.sub(r"<[^>]+>", " ", inner)).split())
        assert (got.url[i], got.text[i], got.n_chars[i]) == (url, want, len(want))


def site(n, extra=""):
    """Pages without article, class names or telling tags: only recurrence tells their frame."""
    top, end = "<div><p>Daily Gazette</p><div>Home - Sport - Weather</div></div>", "<div><span>All rights reserved by the Gazette.</span></div>"
    return f"<html><body>{top}<div><h1>Story {n}</h1><p>What happened on day {n} &amp; why:\n it  rained.</p>{extra}</div>{end}</body></html>"


def test_templates_by_host(spark):
    """What a host repeats goes, what only copies of one article repeat stays, as does what another host shows once."""
    boxed = "<div>Read our offer of the week</div>"
    rows = [(i, f"https://news.example/{i}", site(i, boxed), "x") for i in range(6)]
    rows += [(100 + i, f"http://User@COPIES.example:8080/{i}", site(77, boxed), None) for i in range(6)]  # one article, six times
    rows += [(200, "https://once.example/", site(5, boxed), None), (201, None, site(6, boxed), None), (None, "nonsense", None, None), (203, "https://news.example/7", "", None)]
    got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()}
    assert len(got) == len(rows)
    for i in range(6):
        assert got[i] == f"Story {i} What happened on day {i} & why: it rained."
        assert got[100 + i] == got[100] and "Daily Gazette" in got[100]
    assert "Read our offer" in got[200] and "Read our offer" in got[201] and got[None] == "" and got[203] == ""


def test_main_prose_stays_and_boxes_go(spark):
    """Inside an article a repeated paragraph is prose, a repeated box is not."""
    page = "<body><div>Menu of site</div><article><h1>T{0}</h1><p>A passage that many articles quote.</p><div><p>Share this!</p></div><p>Own words {0}.</p></article></body>"
    got = html.main_text(spark.createDataFrame([(i, "http://a.example/", page.format(i), "") for i in range(5)], SCHEMA))
    assert {r.text for r in got.collect()} == {f"T{i} A passage that many articles quote. Own words {i}." for i in range(5)}


def test_templates_counts(spark):
    sigs = spark.createDataFrame([("h", 1, 4, [5, 6]), ("h", 1, 1, [5]), ("h", 2, 1, [5, 7]), ("h", 3, 1, [5]), ("", 4, 9, [5]), ("g", 5, 1, [5])], "host string, main long, size long, trees array<long>")
    assert [tuple(r) for r in html.templates(sigs).collect()] == [("h", 5, 4)]
    assert html.templates(sigs, min_share=0.9).count() == 1 and html.templates(sigs, min_pages=4).count() == 0


def test_forms():
    body = (
        "<head><title>No</title></head><body class='has-sidebar'><header><h1>Site</h1></header><nav>n</nav><div id=cookie-notice>c</div><main class='content with-sidebar'><article><header><h1>Head</h1><div class=share>s</div></header>"
        "<p>One <b>bo</b>ld&nbsp;<i>text</i><br>line.<p>Two<ul><li>x<li>y</ul><table><tr><td>a<td>b</table><form>f</form><aside>as</aside><div hidden>h</div><div style='display: none'>d</div>"
        "<script>var t='</p>';</script><style>p{}</style><!-- c --><section class='comments'><p>First!</p></section><footer>by me</footer></article></main><div class=sidebar>side</div><p>after</p></body>"
    )
    assert text(body) == "Head One bold text line. Two x y a b"
    assert text("<div class='comment-page'><p>Long text of the page here.</p></div><div class=ad>x</div>") == "Long text of the page here."
    assert text("<body><p>plain <b>run<p>next</b> one</body></html>") == "plain run next one"


def test_odd_markup():
    assert text("") == "" and text("just text") == "just text" and text("a < b & c &lt;d&gt; &#233;&eacute &bogus;") == "a < b & c <d> éé &bogus;"
    assert text("x<p title='a>b'>y</p><a href=\"unclosed>z</a>") == "x y z" and text("<p>end <b") == "end"
    assert text("</p></div>t</article><!x><?y?>u<![CDATA[v]]>") == "t u"
    assert text("<script>never closed") == "" and text("<!-- never closed") == "" and text("<textarea><p>raw</textarea>k") == "k"
    assert text("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    assert len(text("<p>" + "word " * 200_000)) == 999_999


def test_hash_is_of_the_subtree():
    def tree(source, tag="div"):
        page = html.Page(source)
        return page.hashes[page.tag.index(tag)]

    assert tree("<div class=a><p>x  y</p></div>") == tree("<body>\n<div  class=a><p>x y</p></div>") != tree("<div><p>x y</p></div>")
    assert tree("<div><p>x</p>y</div>") != tree("<div>x<p>y</p></div>")


def test_no_pages(spark):
    assert html.main_text(spark.createDataFrame([], SCHEMA)).count() == 0
