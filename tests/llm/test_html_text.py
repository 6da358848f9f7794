"""Main text of pages against an independent parser and hand-made pages."""

import json
from html.parser import HTMLParser

import pytest

from corpusloom.llm import html_text as ht
from tests.llm.test_operators import SF, needs_data


class Article(HTMLParser):
    """Blocks inside <article>, by the parser of the standard library."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks, self.now = 0, [], []

    def cut(self):
        text = " ".join("".join(self.now).split())
        self.now = []
        if text:
            self.blocks.append(text)

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "h1", "article"):
            self.cut()
        if tag == "br":
            self.now.append(" ")
        self.inside += tag == "article"

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "article"):
            self.cut()
        self.inside -= tag == "article"

    def handle_data(self, data):
        if self.inside:
            self.now.append(data)


def article(page):
    parser = Article()
    parser.feed(page)
    parser.close()
    parser.cut()
    return "\n\n".join(parser.blocks)


def text_of(*pages):
    """Texts of the pages of one host."""
    wrapper = ht.wrapper_of(pages[0])
    for page in pages[1:]:
        wrapper = ht.aligned(wrapper, ht.wrapper_of(page))
    judge = ht.judged(json.loads(json.dumps(wrapper)))
    return [ht.main_text(page, judge) for page in pages]


@needs_data
def test_query_against_an_independent_parser(spark):
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r.page_id: r for r in ht.op13_html_extraction(spark, SF).collect()}
    assert len(got) == len(rows)
    for r in rows:
        want = article(r.html)
        assert got[r.page_id].text == want and want
        assert got[r.page_id].url == r.url
        assert got[r.page_id].n_chars == len(want)


@pytest.mark.parametrize(("page", "want"), [
    ("", ""), ("plain &lt;words&gt;\n here", "plain <words> here"),
    ("<p>a &amp b<br>c&nbsp; d<p>e&#233;f<!-- x <p>y</p> -->g",
     "a & b c d\n\neéfg"),
    ("<script>var t='</p>';</script><style>p{}</style><article><p>x</article>",
     "x"),
    ("<body><header>site</header><nav><ul><li>one</ul></nav><main><h1>T</h1>"
     "<p>one <b>two</b> <a href='x>y'>three</a></p><ul><li>k<li>l</ul></main>"
     "<aside>side</aside><footer>f</footer>",
     "T\n\none two three\n\nk\n\nl"),
    ("<article><header><h1>T</h1></header><p>x</p><aside>no</aside>"
     "<div class='ad-slot'>no<p>no</p></div><form>no<button>no</button></form>"
     "<p>y</p><div id='comments'><article class='comment'><p>no</p></article>"
     "</div><section class=related><p>no</section></article>",
     "T\n\nx\n\ny"),
    ("<div class='cookieNotice'>no</div><div role=main><p>yes</p></div>"
     "<div class=sidebar><p>no</p></div>", "yes"),
    ("<div id=content><p>yes</p><div hidden>no</div></div><p>beside</p>",
     "yes"),
    ("<nav><p>never closed<article><p>yes</p></article>", "yes"),
    ("<article>a < b and <3 <p title=it's>c</p></article>", "a < b and <3\n\nc"),
    ("<article><table><tr><td>a<td>b<tr><td>c</table></article>",
     "a\n\nb\n\nc"),
    ("<article><p>cut in a tag <a href=\"http", "cut in a tag"),
    ("<article><p>x</p><script>unclosed <p>no</p>", "x"),
    ("<svg/><article><svg><title>t</title><text>no</text></svg>yes</article>",
     "yes"),
])
def test_single_pages(page, want):
    assert text_of(page) == [want]


def test_constant_texts_of_unmarked_pages_go():
    pages = [f"<body><div>Our site</div><p>story {i}</p><p>more {i}</p>"
             f"<ul><li><a href=x>link {i}</a></li><li><a>other</a></li></ul>"
             "<div>All rights</div></body>" for i in range(5)]
    assert text_of(*pages) == [f"story {i}\n\nmore {i}" for i in range(5)]
    # copies of one page say nothing about what is constant
    assert text_of(pages[0], pages[0], pages[0]) == [
        "Our site\n\nstory 0\n\nmore 0\n\nAll rights"] * 3
    assert text_of(*pages[:2])[0].startswith("Our site")


def test_expression_has_optional_and_repeated_groups():
    def page(*parts):
        return f"<article>{''.join(parts)}</article>"

    one, two = "<h2>a</h2><p>b</p>", "<h2>c</h2><p>d</p><p>e</p>"
    wrapper = ht.aligned(ht.wrapper_of(page(one, two, one)),
                         ht.wrapper_of(page(two, "<pre>x</pre>")))
    assert ht.expression(wrapper) == (
        "<article>(<h2>#</> (<p>#</>)+)+ (<pre>#</>)?</>")
    rest = ht.aligned(wrapper, ht.wrapper_of("<ul><li>z</ul>"))
    assert ht.expression(rest).count("?") == 3


def test_long_and_deep_pages_stay_bounded():
    tags = ["p", "h2", "ul", "pre", "dl", "h3", "table", "address"]
    state, mixed = 7, []
    for _ in range(20_000):
        state = state * 1103515245 % 2**31 + 12345
        mixed.append(f"<{tags[state >> 16 & 7]}>x</{tags[state >> 16 & 7]}>")
    deep = "<div class=post><ul><li>" * 20_000 + "deep"
    wide = "<article>" + "".join(mixed) + "</article>"
    quotes = "<a '" * 50_000
    wrapper = ht.aligned(ht.wrapper_of(wide), ht.wrapper_of(deep))
    wrapper = ht.aligned(wrapper, ht.wrapper_of(quotes))
    assert len(json.dumps(wrapper)) < 10_000
    assert text_of(wide) == ["\n\n".join(["x"] * 20_000)]
    assert text_of(deep) == ["deep"]


def test_operator_rows(spark):
    rows = [(1, "http://a.org/1", "<article>x</article>", "t", 1, "h"),
            (2, "HTTP://A.org/2", None, "t", 1, "h"), (3, None, "", "t", 1, "h"),
            (None, "no host", "<p>words", "t", 1, "h"),
            (1, "http://a.org/1", "<article>x</article>", "t", 1, "h"),
            (9, "http://b.org", "<nav>only</nav>", None, None, None)]
    pages = spark.createDataFrame(
        rows, "page_id long, url string, html string, text string, pages int, "
              "host string")
    wrappers = ht.infer_wrappers(pages)
    assert {r.host: r.pages for r in wrappers.collect()} == {
        "a.org": 3, "": 2, "b.org": 1}
    want = sorted([(1, "http://a.org/1", "x")] * 2 + [
        (2, "HTTP://A.org/2", ""), (3, None, ""), (None, "no host", "words"),
        (9, "http://b.org", "")], key=repr)
    got = ht.extract_text(pages, wrappers)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    empty = pages.limit(0)
    assert ht.extract_text(empty, ht.infer_wrappers(empty)).count() == 0


def test_wrappers_beyond_the_broadcast_bound(spark, monkeypatch):
    pages = spark.range(300).selectExpr(
        "id as page_id", "concat('http://h', if(id % 3 = 0, 0, id % 7), '.org/"
        "') as url", "concat('<p>menu</p><div class=post><p>t', id, '</p></div>'"
        ") as html").repartition(9)
    monkeypatch.setattr(ht, "WRAPPER_BYTES", 0)
    wrappers = ht.infer_wrappers(pages)
    assert wrappers.count() == 7
    got = ht.extract_text(pages, wrappers)
    assert {(r.page_id, r.text) for r in got.collect()} == {
        (i, f"t{i}") for i in range(300)}
