import time
import pytest

from stridemill.llm.html_text import extract, main_text
from stridemill.llm.page_queries import op4_html_extraction

LONG = "A sentence, with commas, that is long enough to count, and goes on."


@pytest.mark.parametrize("html, text", [
    (None, ""), ("", ""), ("<html><body></body></html>", ""), ("plain", "plain"), ("<p>x", "x"),
    (f"<body><nav><a href=x>Menu</a></nav><article><h1>T &amp; t</h1><p>{LONG}<p>Two <b>bo</b>ld&nbsp; \n it.</article><footer>F</footer>",
     f"T & t {LONG} Two bold it."),
    (f"<article><header><h1>Head</h1></header><p>{LONG}</p><aside>side</aside><form>mail <input></form></article>", f"Head {LONG}"),
    (f"<header><h1>Site</h1></header><main><p>{LONG}</p><div class=advert>Buy {LONG}</div></main>", LONG),
    (f"<article><p>{LONG}</p></article><section id='comments'><p>{LONG}</p><p>{LONG}</p></section>", LONG),
    (f"<article><p>{LONG}</p><div class='comment-list'><p>{LONG}</p></div></article>", LONG),
    (f"<div class='page with-sidebar'><div class=sidebar>{LONG}</div><div><p>{LONG}</p><ul><li>one<li>two</ul></div></div>", f"{LONG} one two"),
    (f"<article><p>{LONG}<script>var t = '</p>';</script><style>p{{}}</style><!-- {LONG} --> end</p></article>", f"{LONG} end"),
    (f"<div role=dialog>{LONG}</div><div hidden>{LONG}</div><div style='display: none'>{LONG}</div><article><p>short</p></article>", "short"),
    (f"<div id=cookie-banner><p>{LONG}</p></div><article><p><b>Head.<br><p>{LONG}</article>", f"Head. {LONG}"),
    ("<article><h1>Only a head</h1></article>", "Only a head"),
    (f"<article><p>{LONG} &lt;b&gt; &#233; &eacute", f"{LONG} <b> é é"),
    (f"<article><table><tr><td>a<td>b<tr><td>c</table><p>{LONG}</p><pre>x\n  y</pre></article>", f"a b c {LONG} x y"),
    (f"<ul>{'<li><a href=x>link, link</a></li>' * 30}</ul><div><p>{LONG}</p></div>", LONG),
])
def test_main_text(html, text):
    assert main_text(html) == text


def test_broken_and_very_long_pages():
    assert main_text("<div " * 5000) == "" and main_text('<a "' * 3000) is not None
    assert main_text("<div>" * 30_000 + "<p>hello, world") == "hello, world"
    body = " ".join(f"<p>{LONG}</p>" for _ in range(3000))
    assert main_text(f"<article>{body}</article>") == " ".join([LONG] * 3000)


@pytest.mark.parametrize("quote", ["'", '"'])
@pytest.mark.parametrize("size", [10, 19_000, 21_000, 500_000])
def test_quoted_values_of_any_length(quote, size):
    value = ("<nav>junk > <script>" * (size // 20 + 1))[:size]
    assert main_text(f"<article><p>Before.</p><p data-x={quote}{value}{quote}>After.</p></article>") == "Before. After."


def test_quotes_that_stay_open_end_at_the_first_bracket():
    assert main_text(f"<article><p title=\"x>{LONG}</p><p>End.</p></article>") == f"{LONG} End."
    # No bracket outside quotes from any of these tags on: the page is looked through once.
    assert main_text('<a ">"x"<b>"' * 100_000) is not None


def test_query(spark, as_tables):
    rows = [(1, "u", f"<article><p>{LONG}</p></article>", "t"), (None, None, None, None), (1, "u", "", "t"), (2, None, "<p>é", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = op4_html_extraction(spark, as_tables(pages=pages)).collect()
    assert sorted((str(r.page_id), str(r.url), r.text, r.n_chars) for r in got) == [
        ("1", "u", "", 0), ("1", "u", LONG, len(LONG)), ("2", "None", "é", 1), ("None", "None", "", 0)]
    assert extract(pages.limit(0), "html").collect() == []


@pytest.mark.parametrize("page", ["<div>" * 100_000 + "<p>Some text, with commas, in it.</p>", "<b>" * 50_000 + "text<br>" * 50_000,
                                  "<ul><li>" * 30_000 + "x", "<p>" * 100_000, "<div><p>x" * 50_000 + "</div>" * 50_000])
def test_deep_pages_take_time_in_proportion(page):
    began = time.process_time()
    main_text(page)
    assert time.process_time() - began < 4
