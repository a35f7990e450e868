"""H1-H9 on small inline HTML snippets: one positive and one negative case
per selector, plus the documented limits of regex selection."""

import datetime as dt
import random
import time
from html import unescape

from pyspark.sql import functions as F

from tickerwire.functions import html, structure
from tickerwire.operators import extract

TITLE_CASES = [
    ("bloomberg", '<h1 class="lede-text-v2__hed">  Big &amp; bold\n news </h1>', "Big & bold news"),
    ("bloomberg", '<h1 class="other">x</h1>', None),
    ("seekingalpha", "<head><title>SA title</title></head>", "SA title"),
    ("seekingalpha", "<h1>no title tag</h1>", None),
    ("reuters", '<h1 class="x ArticleHeader_headline y">R <b>head</b></h1>', "R head"),
    ("reuters", '<h1 class="ArticleHeader_headlines">near miss</h1>', None),
    ("thestreet", '<H1 CLASS="article__headline">Upper tags</H1>', "Upper tags"),
    ("thestreet", '<h2 class="article__headline">wrong tag</h2>', None),
    ("investopedia", '<h1 id="article-heading_2-0">Inv</h1>', "Inv"),
    ("investopedia", '<h1 id="article-heading_2-1">Inv</h1>', None),
    ("wsj", "<h1 class='wsj-article-headline'>single quotes</h1>", "single quotes"),
    ("wsj", '<!-- <h1 class="wsj-article-headline">in comment</h1> -->', None),
    ("marketwatch", "<h1>no selector</h1>", None),
]

DATE_CASES = [
    ("bloomberg", "<nav>1/1/1999</nav><article><p>March 3, 2021</p></article>", dt.date(2021, 3, 3)),
    ("bloomberg", "<nav>1/1/1999</nav><div>March 3, 2021</div>", None),   # container missing
    ("reuters", '<div class="ArticleHeader_date">Mar 4, 2021 / 10:00</div>', dt.date(2021, 3, 4)),
    ("reuters", '<div class="Other">Mar 4, 2021</div>', None),
    ("thestreet", '<time title="Last Publish Date" datetime="2021-03-05">x</time>', dt.date(2021, 3, 5)),
    ("thestreet", '<time title="First Publish Date">2021-03-05</time>', None),
    ("investopedia", '<div id="displayed-date_1-0">6 March 2021</div>', dt.date(2021, 3, 6)),
    ("investopedia", '<div id="displayed-date">6 March 2021</div>', None),
    ("wsj", "<time>3/7/2021</time>", dt.date(2021, 3, 7)),
    ("wsj", "<span>3/7/2021</span>", None),
    ("marketwatch", "<p>x</p><span>2021-03-08</span>", dt.date(2021, 3, 8)),   # whole document
    ("marketwatch", '<script>var d="2020-01-01"</script><p>2021-03-09</p>', dt.date(2020, 1, 1)),
]


def _pages(spark, cases):
    return spark.createDataFrame([(i, s, h) for i, (s, h, _) in enumerate(cases)],
                                 "page_id INT, source STRING, html STRING")


def test_titles(spark):
    out = {r.page_id: r for r in extract.extract_title(_pages(spark, TITLE_CASES)).collect()}
    for i, (source, _, expected) in enumerate(TITLE_CASES):
        assert out[i].title == expected, (source, TITLE_CASES[i][1])
    assert out[len(TITLE_CASES) - 1].reject_reason == "no_selector"


def test_dates(spark):
    out = {r.page_id: r.publish_date for r in extract.extract_date(_pages(spark, DATE_CASES)).collect()}
    for i, (source, h, expected) in enumerate(DATE_CASES):
        assert out[i] == expected, (source, h)


def first(df, *selector, outer=False):
    got = html.with_first(df, "h", {"x": [(None, *selector)]}, outer=["x"] if outer else [])
    assert got.columns == [*df.columns, "x"]
    return [r.x for r in got.collect()]


def test_first_element_ends_at_its_own_tag(spark):
    h = "<p>0</p><div class='a'>x<div>y<div>1</div></div>z</div><div>after</div>"
    df = spark.createDataFrame([(h,), (None,), ("",), ("<div class=a>plain</div>",), ("<div class='a'></div>",)], "h STRING")
    assert first(df, "div", "class", "a") == ["x<div>y<div>1</div></div>z", None, None, "plain", None]
    assert first(df, "div", "class", "a", outer=True)[0] == "<div class='a'>x<div>y<div>1</div></div>z</div>"
    # an inner element without its closing tag: all that follows
    df = spark.createDataFrame([("<div class='a'>x<div>y</div>z",)], "h STRING")
    assert first(df, "div", "class", "a") == ["x<div>y</div>z"]


def test_elements_nest_as_counted(spark):
    """Random well-formed markup against a stack."""
    r = random.Random(4)
    pages, want = [], []
    for _ in range(60):
        out, stack, found = [], [], []
        for _ in range(r.randrange(300)):
            if stack and r.random() < 0.5:
                name, at = stack.pop()
                found.append((at, name, "".join(out[at + 1:])))
                out.append(f"</{name.upper()} >")
            else:
                stack.append((r.choice(["table", "tr", "td"]), len(out)))
                out.append(f"<{stack[-1][0]} k='{len(out)}'>")
            if r.random() < 0.7:
                out.append(r.choice(["text", "<b>é</b>", "\n", "<tdx>", "</t>"]))
        for name, at in reversed(stack):
            found.append((at, name, "".join(out[at + 1:])))
        pages.append("".join(out))
        want.append([(n, m) for _, n, m in sorted(found)])
    df = spark.createDataFrame(list(enumerate(pages)) + [(-1, None)], "k INT, h STRING")
    got = structure.with_elements(df, "h", ["table", "tr", "td"]).select("k", F.expr(
        f"transform(filter(_page.elements, x -> x.name <> ''), e -> named_struct('n', e.name, 'm', {structure.inner('_page', 'e')}))").alias("e"))
    for k, elements in got.collect():
        assert elements is None if k < 0 else [tuple(e) for e in elements] == want[k]


def test_many_tags_are_no_burden(spark):
    rows = "<tr><td>a</td><td><a>b</a></td></tr>" * 8000
    df = spark.createDataFrame([(1, f'<table class="quoteTable">{rows}</table>')], "k INT, html STRING")
    start = time.time()
    assert extract.constituents(df, "class_quotetable").count() == 8000
    assert time.time() - start < 30


def test_table_with_a_table_in_a_cell(spark):
    t = ('<table id="constituents"><tr><td>A<table><tr><td>x</td><td>y</td></tr></table></td><td>later</td></tr>'
         '<tr><td>B</td></tr></table>')
    df = spark.createDataFrame([(1, t)], "k INT, html STRING")
    cells = [(c.row_pos, c.col_pos, c.cell_html) for c in extract.table_cells(df, "id", "constituents").orderBy("row_pos", "col_pos").collect()]
    assert cells == [(0, 0, "A<table><tr><td>x</td><td>y</td></tr></table>"), (0, 1, "x"), (0, 2, "y"), (0, 3, "later"),
                     (1, 0, "x"), (1, 1, "y"), (2, 0, "B")]
    assert [r.ticker for r in extract.constituents(df, "id_constituents").orderBy("row_pos").collect()] == ["Axy", "x", "B"]
    q = ('<table class="quoteTable"><tr><td><a>A</a><table><tr><td><a>X</a></td></tr></table></td><td><a>B</a></td></tr></table>')
    got = extract.constituents(spark.createDataFrame([(1, q)], "k INT, html STRING"), "class_quotetable")
    assert sorted(r.ticker for r in got.collect()) == ["A", "B", "X"]


def test_nested_result_blocks(spark):
    h = ('<div class="g"><div class="g"><a href="/url?q=https://a.com/1">1</a></div><a href="/url?q=https://b.com/2">2</a></div>'
         '<div class="g"><p>x</p><div class="g"></div></div><div class="g"><a href="/url?q=https://c.com/3">3</a></div>')
    df = spark.createDataFrame([(1, h)], "page_id INT, html STRING")
    assert [r.url for r in extract.result_links(df).orderBy("link_pos").collect()] == ["https://a.com/1", "https://a.com/1", "https://c.com/3"]


def test_result_links(spark):
    h = ('<div id="nav"><a href="/url?q=http://nav/">n</a></div>'
         '<div class="g"><h3>t</h3><a href="/url?q=https://a.com/1">1</a><a href="/url?q=https://b.com/">2</a></div>'
         '<div class="g x"><a class="l" href="/url?q=/c.com/3">3</a></div>'
         '<div class="gg"><a href="/url?q=https://d.com/4">4</a></div>')
    df = spark.createDataFrame([(1, h)], "page_id INT, html STRING")
    got = [(r.link_pos, r.url) for r in extract.result_links(df).orderBy("link_pos").collect()]
    assert got == [(0, "https://a.com/1"), (1, "http://c.com/3")]


def test_links_as_a_parser_reads_them(spark):
    h = ('<div class="g"><a href="/url?q=https://a.com/1&amp;sa=U&amp;ved=1">1</a></div>'
         "<div class='g'><div><a data-href='no' href='/url?q=https://b.com/2'>2</a></div></div>"
         '<div class="g"><span>no anchor</span></div><div><a href="/url?q=https://footer.com/">f</a></div>'
         '<div class="g"><a href=/url?q=https://c.com/3>3</a></div>')
    df = spark.createDataFrame([(1, h)], "page_id INT, html STRING")
    assert [r.url for r in extract.result_links(df).orderBy("link_pos").collect()] == [
        "https://a.com/1&sa=U&ved=1", "https://b.com/2", "https://c.com/3"]


def test_profile_stays_inside_its_container(spark):
    h = ('<div class="asset-profile-container"><div><p>only one</p></div></div>'
         '<div><p><span>a</span><span>b</span><span>c</span><span>d</span></p></div>')
    df = spark.createDataFrame([(1, h)], "k INT, html STRING")
    assert [tuple(r) for r in extract.profile_fields(df).select("sector", "industry").collect()] == [(None, None)]


def test_table_cells_and_constituents(spark):
    t = ('<table id="constituents"><tr><th>S</th></tr><tr><td> MMM </td><td>3M</td></tr>'
         '<tr><td>ABT\n</td><td>Abbott</td></tr></table>')
    df = spark.createDataFrame([(1, t)], "k INT, html STRING")
    cells = extract.table_cells(df, "id", "constituents").orderBy("row_pos", "col_pos").collect()
    assert [(c.row_pos, c.col_pos) for c in cells] == [(1, 0), (1, 1), (2, 0), (2, 1)]
    got = [r.ticker for r in extract.constituents(df, "id_constituents").orderBy("row_pos").collect()]
    assert got == ["MMM", "ABT"]

    nyse = ('<table id="CompanylistResults"><tr><th>h</th></tr>'
            '<tr><td>A</td><td><a href="#"> B RK \n</a></td></tr><tr><td>x</td><td><a>SKIP</a></td></tr>'
            '<tr><td>C</td><td><a>GE</a></td></tr></table>')
    df = spark.createDataFrame([(1, nyse)], "k INT, html STRING")
    assert [r.ticker for r in extract.constituents(df, "id_companylist").orderBy("row_pos").collect()] == ["BRK", "GE"]

    nq = '<table class="quoteTable"><tr><td><a> AAPL</a></td><td>x</td><td><a>MSFT </a></td></tr></table>'
    df = spark.createDataFrame([(1, nq)], "k INT, html STRING")
    assert [r.ticker for r in extract.constituents(df, "class_quotetable").orderBy("col_pos").collect()] == ["AAPL", "MSFT"]


def test_anchors_profile_movers(spark):
    cal = ('<a class="data-table-row-cell__link" href="/quote/AAPL:US">A</a>'
           '<a href="/quote/NO:US">n</a><a href="/q/MSFT:US" class="x data-table-row-cell__link">m</a>')
    df = spark.createDataFrame([(1, cal)], "k INT, html STRING")
    got = [r.symbol for r in extract.anchors_by_class(df, "data-table-row-cell__link").orderBy("link_pos").collect()]
    assert got == ["quote/AAPL", "q/MSFT"]

    prof = ('<div class="asset-profile-container"><div><div><p>addr</p><p><span>Sector</span>: '
            '<span>Technology</span><br><span>Industry</span>: <span>Consumer &amp; Electronics</span></p></div></div></div>')
    short = '<div class="asset-profile-container"><div><div><p>only one</p></div></div></div>'
    df = spark.createDataFrame([(1, prof), (2, short)], "k INT, html STRING")
    got = {r.k: (r.sector, r.industry) for r in extract.profile_fields(df).collect()}
    assert got == {1: ("Technology", "Consumer & Electronics"), 2: (None, None)}

    mv = "<table><tr><td><a>Apple Inc. (AAPL)</a></td><td>1.0</td><td><a>no paren</a></td></tr></table>"
    df = spark.createDataFrame([(1, mv)], "k INT, html STRING")
    got = [(r.cell_pos, r.symbol) for r in extract.movers(df).orderBy("cell_pos").collect()]
    assert got == [(0, "AAPL"), (2, None)]


def test_character_references(spark):
    texts = {"It&#8217;s &eacute;t&#xE9; &amp; more": "It’s été & more", "Apple&rsquo;s &#8220;big&#8221; day&hellip; AT&#38;T": "Apple’s “big” day… AT&T",
             "&amp;lt; &unknown; &#x1F600; &#146; &#0; &#55296; a & b": "&lt; &unknown; \U0001F600 ’ \ufffd \ufffd a & b", "": "", "plain": "plain",
             "&copy 5 &bigstar; &copyright &notit; &#169 &#xA9x &NotEqualTilde; &amp": "© 5 ★ ©right ¬it; © ©x ≂̸ &"}
    texts |= {t: unescape(t) for t in ("&notin; &notinx &ampamp; &gt&lt;&quot", "&LT;&#x80;&#150;&#129;" + "&a" * 20, "&#1114112; &#xFFFFFF; &;&#;&#x;")}
    df = spark.createDataFrame([(k,) for k in texts] + [(None,)], "s STRING")
    got = {r.s: r.t for r in df.select("s", html.decode_entities("s").alias("t")).collect()}
    assert got == texts | {None: None}


def test_references_in_attribute_values(spark):
    h = '<a href="/u?a=1&copy=2&amp;b=3&lt;x&reg&copyz">x</a>'
    df = spark.createDataFrame([(h,)], "h STRING")
    assert df.select(html.first_href("h")).first()[0] == "/u?a=1&copy=2&b=3<x®&copyz"


def test_hidden_blocks_match_any_case(spark):
    df = spark.createDataFrame([("<SCRIPT>var t='<title>bad</title>'</SCRIPT><title>good</title>",)], "html string")
    assert first(df.select(html.strip_hidden("html").alias("h")), "title", None, None) == ["good"]


def test_body_of_a_page_without_an_article(spark):
    pages = [(1, "<h1>T</h1><nav>n</nav><article>a <b>b</b> c</article>"), (2, "<title>t</title><p>one two</p><script>x y</script><p> three</p>"), (3, "")]
    df = extract.with_clean_html(spark.createDataFrame([(k, "wsj", h) for k, h in pages], "k INT, source STRING, html STRING"))
    assert [r.b for r in extract.with_fields(df, body="b").orderBy("k").collect()] == ["a b c", "tone two three", None]
