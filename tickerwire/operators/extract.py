"""HTML extraction jobs over a table of pages (H2-H9).

Each job is a projection (plus ``posexplode`` where one page yields many
rows), so it runs inside the scan stage with no shuffle; the wide ``html``
column is dropped as soon as the fields are extracted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerwire.functions.dates import publish_date
from tickerwire.functions.html import (anchor_hrefs, by_case, decode_entities, element_regex, first_href, first_hrefs,
                                       open_tag_regex, sql_text, strip_hidden, strip_tags, texts_of, with_first)
from tickerwire.functions.rows import compute_once
from tickerwire.functions.structure import inner, inside, is_flat, matching, with_elements
from tickerwire.functions.text import WHITESPACE_CLASS, strip_all_ws
from tickerwire.functions.urls import symbol_from_href, unwrap_link
from tickerwire.sources.registry import selectors


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _choices(field: str, source) -> list[tuple]:
    """The selectors of a field, one per source (only the branch of a row's
    source runs)."""
    return [(_c(source) == name, tag, attr, value) for name, tag, attr, value in selectors(field)]


def has_title_selector(source) -> Column:
    return _c(source).isin(*[n for n, *_ in selectors("title")])


def with_clean_html(df: DataFrame, html: str = "html", out: str = "_clean") -> DataFrame:
    """Markup without comments, scripts and styles, as its own projection so
    title and date extraction share one pass."""
    return df.withColumn(out, strip_hidden(html))


def with_fields(df: DataFrame, clean: str = "_clean", html: str = "html", source: str = "source", title: str | None = None,
                date: str | None = None, body: str | None = None) -> DataFrame:
    """H2, H3 and the text of the ``article`` element, each where a column
    name is given, from one pass over the markup: the title's text (tags
    removed, references decoded, white space collapsed), the first date (F9)
    of the source's date container with its attributes, and the article's
    text (the page's where it has no ``article``). Sources without a date container are searched whole; a configured
    container that is missing gives null."""
    wanted = {"_title_html": title and _choices("title", source), "_date_html": date and _choices("date", source),
              "_body_html": body and [(None, "article", None, None)]}
    df = with_first(df, clean, {k: c for k, c in wanted.items() if c}, outer=["_date_html"])
    if body:   # a page without an article element is its own body
        df = df.withColumn("_body_html", F.coalesce("_body_html", F.col(clean)))
    out = texts_of({n: k for k, n in (("_title_html", title), ("_body_html", body)) if n})
    if date:
        configured = _c(source).isin(*[n for n, *_ in selectors("date")])
        out[date] = publish_date(F.when(configured, F.col("_date_html")).otherwise(F.col(html)))
    return compute_once(df, **out).drop(*[k for k, c in wanted.items() if c])


def extract_title(pages: DataFrame, html: str = "html", source: str = "source",
                  out: str = "title") -> DataFrame:
    """H2 over a table: adds ``out`` and a ``reject_reason`` ('no_selector')
    for sources without a title selector."""
    df = with_fields(with_clean_html(pages, html), "_clean", html, source, title=out).drop("_clean")
    return df.withColumn("reject_reason",
                         F.when(~has_title_selector(source), F.lit("no_selector")))


def extract_date(pages: DataFrame, html: str = "html", source: str = "source",
                 out: str = "publish_date") -> DataFrame:
    """H3 over a table."""
    return with_fields(with_clean_html(pages, html), "_clean", html, source, date=out).drop("_clean")


def result_links(pages: DataFrame, html: str = "html") -> DataFrame:
    """H4 (+F4, P11): for every ``div.g`` block its first anchor's href,
    unwrapped; a block's range includes the blocks inside it, so an outer and
    an inner block may give the same link. Blocks without an anchor and empty
    links are dropped. Adds (link_pos, href, url)."""
    blocks = matching("_page", "div", open_tag_regex("div", "class", "g"))
    staged = with_elements(pages.withColumn("_clean", strip_hidden(html)).drop(html), "_clean", ["div"]).drop("_clean")
    staged = compute_once(staged, _blocks=F.expr(f"transform({blocks}, e -> {inner('_page', 'e')})")).drop("_page")
    hrefs = F.filter(first_hrefs(F.col("_blocks")), lambda h: h.isNotNull())
    ex = staged.select(*[c for c in pages.columns if c != html], F.posexplode(hrefs).alias("link_pos", "href"))
    return ex.withColumn("url", unwrap_link("href")).filter(F.col("url").isNotNull())


def all_links(pages: DataFrame, html: str = "html") -> DataFrame:
    """Every anchor href of a page with its position."""
    return pages.select("*", F.posexplode(anchor_hrefs(html)).alias("link_pos", "href")).drop(html)


_ANCHOR = r"(?s)<[aA](?:\s[^>]*)?>"
_ANCHOR_TEXT = _ANCHOR + r"(.*?)</[aA]\s*>"


_ROW = r"(?s)<[tT][rR](?:\s[^>]*)?>(.*?)</[tT][rR]\s*>"
_CELL = r"(?s)<[tT][dD](?:\s[^>]*)?>(.*?)</[tT][dD]\s*>"


def _cells(pages: DataFrame, tables: list[tuple[Column | None, str, str]], html: str) -> DataFrame:
    """Every cell of the page's first table with (condition, attribute, value)
    as (row_pos, col_pos, cell_html, own). Rows and cells inside cells count
    like all others, in document order, so a row goes on after a table in one
    of its cells; ``own``: no row inside this one holds the cell. Pages whose
    tables hold none are read by patterns alone."""
    names = ["table", "tr", "td"]
    choices = [(when, "table", attr, value) for when, attr, value in tables]
    staged = compute_once(pages.withColumn("_clean", strip_hidden(html)).drop(html), _flat=F.coalesce(is_flat("_clean", names), F.lit(True)))
    staged = with_elements(staged.withColumn("_deep", F.when(~F.col("_flat"), F.col("_clean"))), "_deep", names)
    own = f"NOT exists({inside('_page', 'r', 'tr')}, n -> n.open < e.open AND e.close <= n.close)"
    cells = f"transform({inside('_page', 'r', 'td')}, e -> named_struct('cell_html', {inner('_page', 'e')}, 'own', {own}))"
    rows = f"flatten(transform(_hits, tb -> transform({inside('_page', 'tb', 'tr')}, r -> named_struct('html', cast(null as string), 'cells', {cells}))))"
    no_cells = "cast(null as array<struct<cell_html:string,own:boolean>>)"
    hits = by_case(choices, lambda *selector: F.expr(matching("_page", selector[0], open_tag_regex(*selector))))
    flat_table = by_case(choices, lambda *s: F.regexp_extract("_clean", element_regex(*s), 1))
    staged = compute_once(staged, _hits=F.when(~F.col("_flat"), F.slice(hits, 1, 1)),
                          _flat_rows=F.when(F.col("_flat"), F.regexp_extract_all(flat_table, F.lit(_ROW), F.lit(1))))
    staged = compute_once(staged, _rows=F.when(F.col("_flat"), F.expr(f"transform(_flat_rows, r -> named_struct('html', r, 'cells', {no_cells}))"))
                          .otherwise(F.expr(rows)))
    keep = [c for c in pages.columns if c != html]
    ex = staged.select(*keep, F.posexplode("_rows").alias("row_pos", "_row"))
    of_row = F.transform(F.regexp_extract_all("_row.html", F.lit(_CELL), F.lit(1)), lambda c: F.struct(c.alias("cell_html"), F.lit(True).alias("own")))
    ex = ex.select(*keep, "row_pos", F.posexplode(F.coalesce("_row.cells", of_row)).alias("col_pos", "_cell"))
    return ex.select(*keep, "row_pos", "col_pos", "_cell.*")


def table_cells(pages: DataFrame, attr: str, value: str, html: str = "html") -> DataFrame:
    """H5: cells of the first table with attr = value as
    (row_pos, col_pos, cell_html); row_pos counts every <tr>, so header rows
    (no <td>) keep their position and yield no cell."""
    return _cells(pages, [(None, attr, value)], html).drop("own")


def _strip_ends(s: Column) -> Column:
    return F.regexp_replace(s, "^" + WHITESPACE_CLASS + "+|" + WHITESPACE_CLASS + "+$", "")


def _anchor_text(cell: Column) -> Column:
    """Text of the cell's first anchor, null without one."""
    return F.when(cell.rlike(_ANCHOR), decode_entities(strip_tags(F.regexp_extract(cell, _ANCHOR_TEXT, 1))))


#: Table of each constituents layout.
SPECS = {"id_constituents": ("id", "constituents"), "id_companylist": ("id", "CompanylistResults"), "class_quotetable": ("class", "quoteTable")}


def constituents(pages: DataFrame, spec: str | Column, html: str = "html") -> DataFrame:
    """H6: ticker lists from constituent tables. spec:
    'id_constituents'   table#constituents, column 0 text, ends stripped;
    'id_companylist'    table#CompanylistResults, odd rows, column 1 anchor
                        text, all whitespace removed;
    'class_quotetable'  table.quoteTable, every cell with an anchor, its
                        anchor text, all whitespace removed.
    A column of such names lets one pass read pages of several layouts.
    Adds (row_pos, col_pos, ticker)."""
    if isinstance(spec, str) and spec not in SPECS:
        raise ValueError(f"unknown constituents spec: {spec}")
    layout = F.lit(spec) if isinstance(spec, str) else spec
    is_ = lambda name: F.col("_layout") == name
    c = _cells(pages.withColumn("_layout", layout), [(is_(k), *v) for k, v in SPECS.items()], html)
    c = c.filter((is_("id_constituents") & (F.col("col_pos") == 0))
                 | (is_("id_companylist") & (F.col("row_pos") % 2 == 1) & (F.col("col_pos") == 1)) | (is_("class_quotetable") & F.col("own")))
    # one decoding for all layouts: the cell's text, or that of its first anchor
    cell = F.col("cell_html")
    raw = F.when(is_("id_constituents"), cell).when(cell.rlike(_ANCHOR), F.regexp_extract(cell, _ANCHOR_TEXT, 1))
    c = compute_once(c, _text=decode_entities(strip_tags(raw)))
    c = c.withColumn("ticker", F.when(is_("id_constituents"), _strip_ends(F.col("_text"))).otherwise(strip_all_ws("_text")))
    return c.filter(F.col("_text").isNotNull()).drop("cell_html", "own", "_layout", "_text")


def anchors_by_class(pages: DataFrame, cls: str, html: str = "html") -> DataFrame:
    """H7 (+F13): hrefs of anchors carrying class token ``cls``, and the
    symbol cut out of each href. Adds (link_pos, href, symbol)."""
    tags = F.regexp_extract_all(strip_hidden(html), F.lit(r"<[aA]\s[^>]*>"), F.lit(0))
    cls_rx = r"\s[cC][lL][aA][sS][sS]\s*=\s*[\"'](?:[^\"']*\s)?" + cls.replace(".", r"\.") + \
        r"(?:\s[^\"']*)?[\"']"
    hits = F.filter(tags, lambda t: t.rlike(cls_rx))
    hrefs = F.transform(hits, lambda t: F.coalesce(first_href(t), F.lit("")))
    ex = pages.select("*", F.posexplode(hrefs).alias("link_pos", "href")).drop(html)
    return ex.withColumn("symbol", symbol_from_href("href"))


def profile_fields(pages: DataFrame, html: str = "html") -> DataFrame:
    """H8: in the profile container, the second <p>: span 1 is the sector,
    span 3 the industry (0-based); null when missing. Paragraphs outside the
    container are not read."""
    staged = pages.withColumn("_clean", strip_hidden(html)).drop(html)
    staged = with_first(staged, "_clean", {"_profile": [(None, "div", "class", "asset-profile-container")]})
    paras = F.regexp_extract_all("_profile", F.lit(r"(?s)<[pP](?:\s[^>]*)?>(.*?)</[pP]\s*>"), F.lit(1))
    spans = F.regexp_extract_all(F.get(paras, 1), F.lit(r"(?s)<span(?:\s[^>]*)?>(.*?)</span\s*>"), F.lit(1))
    staged = compute_once(staged, _spans=spans).withColumns({"_sector": F.get("_spans", 1), "_industry": F.get("_spans", 3)})
    staged = compute_once(staged, **texts_of({"sector": "_sector", "industry": "_industry"}))
    return staged.drop("_clean", "_profile", "_spans", "_sector", "_industry")


def paren_symbol(text) -> Column:
    """H9: text inside the outermost parentheses, or null."""
    return F.nullif(F.regexp_extract(_c(text), r"\((.*)\)", 1), F.lit(""))


def movers(pages: DataFrame, html: str = "html") -> DataFrame:
    """H9 over a table: for each <td> holding an anchor, the symbol in
    parentheses of the anchor text. Adds (cell_pos, symbol)."""
    staged = compute_once(pages.withColumn("_clean", strip_hidden(html)).drop(html), _flat=F.coalesce(is_flat("_clean", ["td"]), F.lit(True)))
    staged = with_elements(staged.withColumn("_deep", F.when(~F.col("_flat"), F.col("_clean"))), "_deep", ["td"])
    staged = compute_once(staged, _cells=F.when(F.col("_flat"), F.regexp_extract_all("_clean", F.lit(_CELL), F.lit(1))).otherwise(F.expr(
        f"transform(filter(_page.elements, x -> x.name = 'td'), e -> {inner('_page', 'e')})"))).drop("_page", "_clean", "_deep", "_flat")
    ex = staged.select(*[c for c in staged.columns if c != "_cells"], F.posexplode("_cells").alias("cell_pos", "_cell"))
    return (ex.filter(F.col("_cell").rlike(_ANCHOR))
            .withColumn("symbol", paren_symbol(_anchor_text(F.col("_cell")))).drop("_cell"))
