"""Main text of pages."""

import html
import re
import time

import pytest

from rookery.llm import html_text

CASES = {
    "": "",
    "plain, with no tags.": "plain, with no tags.",
    "<p>a<p>b": "a\n\nb",
    "<nav><a href=x>Home</a></nav>": "",
    "<body><nav><p>Menu text</nav><article><h1>T &amp; u</h1><p>One\n  two<br>three &lt;x&gt; &eacute;&#233;.<p>Four</article>": "T & u\n\nOne two three <x> éé.\n\nFour",
    "<article><header><h2>Title</h2><p>By me</p></header><p>Body text, here.</p></article>": "Title\n\nBody text, here.",
    "<main><div><p>Long text, with words. And more.</p><div class='ad-slot'><p>Buy</p></div></div><p>End.</p></main><aside><p>Side</p></aside>": "Long text, with words. And more.\n\nEnd.",
    "<div id=content><p>Main, words. More words.</p><ul><li>one<li>two</ul></div><div class=sidebar><p>Very long other text, much longer than main is, yes. It is.</p></div>": "Main, words. More words.\n\none\n\ntwo",
    "<article><p>Text, a.</p><script>if (a < b) { '</p>' }</script><style>p{}</style><form><p>Name</p></form><!-- <p>no</p> --><p>Text, b.</p></article>": "Text, a.\n\nText, b.",
    "<article><p>Text.</p><section class=comments><article><p>Nice post, thanks for it!</p></article></section></article>": "Text.",
    "<article><p>a <b>bold <i>both</b> it</i> x</p><table><tr><td>1<td>2</table></article>": "a bold both it x\n\n1\n\n2",
    "<body class=has-sidebar><article><p>Kept.</article><div class=cookieNotice><p>We use cookies, as all do.</div></body>": "Kept.",
    "<div class='page with-sidebar'><div class=post><p>Kept, all of it.</div><ins class=adsbygoogle>Buy</ins></div>": "Kept, all of it.",
    "<article><p>1 < 2 and 3 > 2</p><p title='a > b'>c</p></article>": "1 < 2 and 3 > 2\n\nc",
}


@pytest.mark.parametrize("page", CASES)
def test_cases(page):
    assert html_text.main_text(page) == CASES[page]


def test_template_pages_and_odd_rows(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = html_text.extract(pages).collect()
    raw = {r.page_id: r.html for r in pages.collect()}
    assert len(got) == len(raw)
    for r in got:
        article = re.search(r"<article>(.*?)</article>", raw[r.page_id], re.S)[1].replace("<br>", " ")
        parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article))
        assert r.text == "\n\n".join(p for p in parts if p) and r.n_chars == len(r.text)
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (2, "", "x"), (3, "<p>" + "word, " * 200_000, "x")], "page_id long, html string, text string")
    assert sorted((r.page_id, r.text, r.n_chars) for r in html_text.extract(odd).select("page_id", "text", "n_chars").collect())
    assert [r.n_chars for r in html_text.extract(odd).orderBy("page_id").collect()] == [0, 0, 0, 1_199_999]
    assert html_text.extract(odd.limit(0)).count() == 0


@pytest.mark.parametrize("tag", ['h2 id="side-effects"', 'section id="discussion"', 'div class="social-science"', 'div class="content header-fixed"', 'div id="legal-history"'])
def test_names_made_from_titles(tag):
    end = tag.split()[0]
    for page in ("<article><{0}>Kept, yes.</{1}><p>More, of it.</p></article>", "<body><{0}>Kept, yes.</{1}><p>More, of it.</p></body>"):
        assert html_text.main_text(page.format(tag, end)) == "Kept, yes.\n\nMore, of it."
    for name in ("search", "site-search", "page-header", "socialShare", "ad-slot"):
        assert html_text.main_text(f"<article><p>Text, a.</p><div class={name}><p>No, no.</p></div></article>") == "Text, a."


def test_all_parts_of_marked_content():
    main = "<main><h1>Title</h1><article><p>Long text, with words. And more, of it.</p></article><section><p>Rest, a.</p></section></main>"
    assert html_text.main_text(main) == "Title\n\nLong text, with words. And more, of it.\n\nRest, a."
    assert html_text.main_text("<div><article><p>One, long text.</p></article></div><section><article><p>Two.</p></article></section>") == "One, long text.\n\nTwo."
    lists = "<article><p>Text, a.</p><ul><li><a>A long linked entry of it</a></ul><p>Text, b.</p><ul><li>own item</ul></article>"
    assert html_text.main_text(lists) == "Text, a.\n\nText, b.\n\nown item"


def test_parts_beside_the_heaviest_and_linked_paragraphs_stay():
    said = "<p>Some words of a long article, with points. " * 4 + "</p>"
    page = f"<body><div class=a>{said * 10}</div><section>{said * 5}</section><div><a href=1>Home</a> | <a href=2>News</a></div></body>"
    text = html_text.main_text(page)
    assert text.count("Some words") == 60 and "Home" not in text
    linked = "<article><p>Text, a.</p><p><a href=x>One link as a paragraph</a></p><p>Text, b.</p></article>"
    assert html_text.main_text(linked) == "Text, a.\n\nOne link as a paragraph\n\nText, b."


@pytest.mark.parametrize("tag", ["div", "font", "li", "article", "div class=sidebar", "header"])
def test_deep_nesting_takes_time_in_proportion(tag):
    begin = time.perf_counter()
    text = html_text.main_text(f"<{tag}>some text, here. " * 20_000 + "</b></p></td>" * 20_000)
    assert time.perf_counter() - begin < 10
    assert text.count("some text") in ((0,) if "side" in tag or tag == "header" else (20_000,))
