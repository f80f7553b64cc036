"""HTML sources: infobox rows and linked lists of entities. Parsing runs over Arrow batches; the rest is DataFrame code."""

from __future__ import annotations

from html import escape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.code import arrow_map
from ..functions.text import slugify

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class Element:
    __slots__ = ("attributes", "children", "tag")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children = tag, attributes, []

    def classes(self) -> list[str]:
        return (self.attributes.get("class") or "").split()

    def elements(self):
        """This element's descendants in document order."""
        todo = [c for c in reversed(self.children) if isinstance(c, Element)]
        while todo:
            e = todo.pop()
            yield e
            todo.extend(c for c in reversed(e.children) if isinstance(c, Element))

    def first(self, tag: str):
        return next((e for e in self.elements() if e.tag == tag), None)

    def texts(self, without=lambda e: False):
        todo = [self]
        while todo:
            e = todo.pop()
            if isinstance(e, str):
                yield e
            elif not without(e):
                todo.extend(reversed(e.children))

    def html(self) -> str:
        said = "".join(f' {k}="{escape(v or "")}"' for k, v in self.attributes.items())
        inner = "".join(c.html() if isinstance(c, Element) else escape(c, quote=False) for c in self.children)
        return f"<{self.tag}{said}/>" if self.tag in _VOID else f"<{self.tag}{said}>{inner}</{self.tag}>"


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        e = Element(tag, dict(attrs))
        self.open[-1].children.append(e)
        if tag not in _VOID:
            self.open.append(e)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Element(tag, dict(attrs)))

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def parse(text: str) -> Element:
    b = _Builder()
    b.feed(text)
    b.close()
    return b.root


def _citation(e: Element) -> bool:
    return e.tag == "sup" and "reference" in e.classes()


def cell_text(e: Element, citations: bool = False) -> str:
    return " ".join(s for t in e.texts((lambda _: False) if citations else _citation) if (s := t.strip()))


def infobox_rows(text: str) -> list[dict] | None:
    """label, value_html, value_text, raw_text of each row of the page's infobox; None without one.

    A header row names a section, and bulleted labels after it carry its name. Rows about GDP or the time zone end it.
    """
    box = next((e for e in parse(text or "").elements() if e.tag == "table" and "infobox" in e.classes()), None)
    if box is None:
        return None
    rows, section = [], None
    for tr in (box.first("tbody") or box).children:
        if not isinstance(tr, Element) or tr.tag != "tr" or "display:none" in (tr.attributes.get("style") or ""):
            continue
        th, td = tr.first("th"), tr.first("td")
        if th is not None and td is None and "infobox-header" in th.classes():
            section = cell_text(th) or section
        if th is None or td is None:
            continue
        label, value = cell_text(th), cell_text(td)
        if not label or not value:
            continue
        if label.startswith("GDP") or label == "Time zone":
            section = None
        if section and label.startswith("•"):
            label = f"{section} {label}"
        rows.append({"label": label, "value_html": td.html(), "value_text": value, "raw_text": cell_text(td, citations=True)})
    return rows


ROWS = "array<struct<label:string,value_html:string,value_text:string,raw_text:string>>"


def infoboxes(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages and a column `rows` (ROWS, null where a page has no infobox). A page that can't be parsed has `error`."""
    row = pa.list_(pa.struct([(n, pa.string()) for n in ("label", "value_html", "value_text", "raw_text")]))
    names = pages.columns

    def run(batches):
        for batch in batches:
            found, errors = [], []
            for text in batch.column(html).to_pylist():
                try:
                    found.append(infobox_rows(text))
                    errors.append(None)
                except (ValueError, AssertionError, RecursionError) as e:
                    found.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(found, row), pa.array(errors, pa.string())], [*names, "rows", "error"])

    return arrow_map(pages, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema) + f", rows {ROWS}, error string")


def _links(text: str) -> list[tuple[str, str]]:
    out = []
    for table in parse(text or "").elements():
        if table.tag == "table" and {"wikitable", "sortable"} <= set(table.classes()):
            for tr in (e for e in table.elements() if e.tag == "tr"):
                a = tr.first("a")
                href, name = (a.attributes.get("href") or "", "".join(t.strip() for t in a.texts())) if a is not None else ("", "")
                if href.startswith("/wiki/") and name:
                    out.append((name, href))
    return out


def entity_list(pages: DataFrame, base_url: str, html: str = "html") -> DataFrame:
    """pos, name, url, slug of the linked entities in sortable tables; of equal slugs the first stays."""

    def run(batches):
        for batch in batches:
            found = [(k, *x) for text in batch.column(html).to_pylist() for k, x in enumerate(_links(text))]
            columns = list(zip(*found)) if found else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string()))], ["pos", "name", "href"])

    rows = arrow_map(pages.select(html), run, "pos long, name string, href string").withColumn("slug", slugify("name"))
    first = F.row_number().over(W.partitionBy("slug").orderBy("pos", "href"))
    return rows.withColumn("r", first).where("r = 1").select("pos", "name", F.concat(F.lit(base_url), F.col("href")).alias("url"), "slug")
