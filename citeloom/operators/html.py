"""Records from stored web pages, parsed in Arrow batches with the standard library."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions.text import strip, url_join

#: Elements without an end tag; elements whose text isn't shown.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = set("script style template noscript head title".split())
#: Phrases of a page that asks for a human instead of showing its content.
BLOCK_PHRASES = ["security verification", "verifies you are not a bot", "performing security", "i am human", "checking your browser"]


class Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict, parent: Node | None) -> None:
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack += [c for c in reversed(n.children) if isinstance(c, Node)]

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            elif n.tag not in HIDDEN or n is self:
                if n.tag in ("br", "p", "div", "li", "tr"):
                    out.append(" ")
                stack += reversed(n.children)
        return re.sub(r"\s+", " ", "".join(out)).strip()


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        closes = {"td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "p": ("p",)}.get(tag, ())
        while self.at.tag in closes:
            self.at = self.at.parent
        n = Node(tag, dict(attrs), self.at)
        self.at.children.append(n)
        if tag not in VOID:
            self.at = n

    def handle_endtag(self, tag: str) -> None:
        n = self.at
        while n.parent is not None and n.tag != tag:
            n = n.parent
        if n.parent is not None:
            self.at = n.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(html: str | None) -> Node:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


def select(root: Node, selector: str) -> Iterator[Node]:
    """Nodes that a selector of tags and classes with descendants ('div.main a.pdf') finds, in order of the document."""
    steps = [(s.split(".")[0], set(s.split(".")[1:])) for s in selector.split()]

    def fits(n: Node, step: tuple) -> bool:
        return (not step[0] or n.tag == step[0]) and step[1] <= set((n.attrs.get("class") or "").split())

    for n in root.walk():
        if n.tag and fits(n, steps[-1]):
            k, up = len(steps) - 2, n.parent
            while k >= 0 and up is not None:
                if fits(up, steps[k]):
                    k -= 1
                up = up.parent
            if k < 0:
                yield n


def _rows(pages: DataFrame, html: str, keep: list[str], one, fields: str) -> DataFrame:
    names = [f.split()[0] for f in fields.split(", ")]
    schema = ", ".join([f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep] + [fields])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [(*row[:-1], *r) for row in f[[*keep, "__html"]].itertuples(index=False, name=None) for r in one(row[-1])]
            yield pd.DataFrame(got, columns=[*keep, *names])

    return pages.where(F.col(html).isNotNull()).select(*keep, F.col(html).alias("__html")).mapInPandas(run, schema)


def accordion_rows(pages: DataFrame, html: str, keep: list[str]) -> DataFrame:
    """(year, code, adoption, title, url) of pages that list records in tables under dt / dd. Rows of 2 cells have '' for adoption,
    of 3 the middle one; others and rows without a code are left out. A dt without its own dd gives nothing."""

    def one(html: str) -> Iterator[tuple]:
        for dt in select(parse(html), "dt"):
            after = [c for c in dt.parent.children if isinstance(c, Node)]
            nxt = after[after.index(dt) + 1] if after.index(dt) + 1 < len(after) else None
            if nxt is None or nxt.tag != "dd":
                continue
            table = next(select(nxt, "table"), None)
            for tr in select(table, "tr") if table else ():
                cells = [c for c in tr.children if isinstance(c, Node) and c.tag == "td"]
                if len(cells) not in (2, 3):
                    continue
                a = next(select(cells[0], "a"), None)
                code = (a or cells[0]).text()
                if code:
                    yield dt.text(), code, cells[1].text() if len(cells) == 3 else "", cells[-1].text(), (a.attrs.get("href") or "") if a else ""

    return _rows(pages, html, keep, one, "year string, code string, adoption string, title string, url string")


def table_rows(html: Column) -> Column:
    """array<array<string>>: the cells' texts of each row of tables, for lookups in SQL."""

    @F.pandas_udf("array<array<string>>")
    def cells(s: pd.Series) -> pd.Series:
        return s.map(lambda h: None if h is None else [[c.text() for c in tr.children if isinstance(c, Node) and c.tag in ("td", "th")] for tr in select(parse(h), "tr")])

    return cells(html)


def field_of(rows: Column, label: str) -> Column:
    """The other cells, joined by blanks, of the first row whose first cell is the label, case ignored; null if there is none."""
    fits = F.filter(rows, lambda r: (F.size(r) > 0) & (F.lower(strip(r[0])) == label.lower()))
    rest = F.filter(F.slice(fits[0], 2, F.greatest(F.size(fits[0]) - 1, F.lit(0))), lambda x: x != "")
    return F.when(F.size(fits) > 0, F.nullif(F.array_join(rest, " "), F.lit("")))


def digits_of(rows: Column, label: str) -> Column:
    """The sum of the other cells that are whole numbers, of the first row whose first cell holds the label; null without such a row."""
    fits = F.filter(rows, lambda r: (F.size(r) > 0) & F.contains(F.lower(r[0]), F.lit(label.lower())))
    rest = F.filter(F.transform(F.slice(fits[0], 2, F.greatest(F.size(fits[0]) - 1, F.lit(0))), lambda x: strip(x)), lambda x: x.rlike("^[0-9]+$"))
    return F.when(F.size(fits) > 0, F.aggregate(rest, F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint")))


def cards(pages: DataFrame, html: str, keep: list[str], card: str, title: str, adopted: str) -> DataFrame:
    """(title, adopted_text, url) of each element that the selector `card` finds; one without a title or address is left out."""

    def one(h: str) -> Iterator[tuple]:
        for n in select(parse(h), card):
            t = next(select(n, title), None)
            a = next(select(n, adopted), None)
            if t is not None and n.attrs.get("href"):
                yield t.text(), a.text() if a else "", n.attrs["href"]

    return _rows(pages, html, keep, one, "title string, adopted_text string, url string")


def next_page(html: str, selector: str) -> str | None:
    """Address of the next page; None where the link is missing or disabled."""
    n = next(select(parse(html), selector), None)
    return None if n is None or "disabled" in (n.attrs.get("class") or "") else n.attrs.get("href")


def collect_pages(first: str, get, selector: str) -> Iterator[tuple[str, str]]:
    """(url, html) of a list followed by its next links, each page once, to the list's end or to a page that came before."""
    url, seen = first, set()
    while url and url not in seen:
        seen.add(url)
        html = get(url)
        yield url, html
        url = next_page(html, selector)


def css_text(html: Column, selector: str) -> Column:
    """Text of the first element that the selector finds; null if there is none or it is empty."""

    @F.pandas_udf("string")
    def first(s: pd.Series) -> pd.Series:
        return s.map(lambda h: None if h is None else next((n.text() for n in select(parse(h), selector)), None) or None)

    return first(html)


def css_attr(html: Column, selector: str, attr: str) -> Column:
    """Attribute of the first element that the selector finds; null if there is none."""

    @F.pandas_udf("string")
    def first(s: pd.Series) -> pd.Series:
        return s.map(lambda h: None if h is None else next((n.attrs.get(attr) for n in select(parse(h), selector)), None))

    return first(html)


def visible_text(html: Column) -> Column:
    """Text without scripts, styles and the head."""

    @F.pandas_udf("string")
    def text(s: pd.Series) -> pd.Series:
        return s.map(lambda h: None if h is None else parse(h).text())

    return text(html)


def is_block_page(body: Column, phrases: list[str] | None = None) -> Column:
    """Whether the text holds a phrase of a guard's page, case ignored; False for null."""
    hit = F.lit(False)
    for p in phrases or BLOCK_PHRASES:
        hit = hit | F.coalesce(F.contains(F.lower(body), F.lit(p)), F.lit(False))
    return hit


def is_real_page(body: Column, least: int = 100) -> Column:
    """No block page, and more than `least` characters between the outer white space; False for null."""
    return ~is_block_page(body) & F.coalesce(F.length(strip(body)) > least, F.lit(False))


def detail_rows(pages: DataFrame, html: str, keep: list[str], host: str) -> DataFrame:
    """(keep, adopted_by, content, pdf_url, status) of detail pages; a guard's page has status SECURITY_BLOCK and an unreadable
    one ERROR, also in adopted_by, as later steps look for it there."""
    body = visible_text(F.col("__h"))
    p = pages.select(*keep, F.col(html).alias("__h")).withColumn("__b", body)
    status = F.when(F.col("__h").isNull(), "ERROR").when(is_block_page(F.col("__b")), "SECURITY_BLOCK").otherwise("OK")
    p = p.withColumn("status", status)
    ok = F.col("status") == "OK"
    # Where the pages have these fields.
    return p.select(*keep, F.when(ok, css_text(F.col("__h"), "div.content-hero p")).otherwise(F.col("status")).alias("adopted_by"), F.when(ok, css_text(F.col("__h"), "div.main-content")).alias("content"),
                    F.when(ok, url_join(host, css_attr(F.col("__h"), "div.paragraph--type--file-version a.pdf", "href"))).alias("pdf_url"), "status")
