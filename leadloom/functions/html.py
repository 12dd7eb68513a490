"""HTML pages as typed columns: one Arrow pass a page, everything after it stays in Catalyst."""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

PAGE = (
    "struct<title:string,metas:map<string,string>,anchors:array<struct<href:string,text:string,pos:int,header:boolean,hidden:boolean>>,"
    "scripts:array<struct<type:string,src:string,text:string>>,links:array<struct<rel:string,href:string>>,"
    "imgs:array<struct<src:string,name:string,marked:boolean,header:boolean,link:string,pos:int>>,nav_text:string,visible_text:string,"
    "blocks:array<string>,ldjson:array<string>,commerce:boolean,error:string>"
)
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Elements that an opening of the key's elements ends.
IMPLIED = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "option": {"option"}}
#: Block elements end an open paragraph too.
ENDS_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
UNSEEN = {"script", "style", "noscript", "template"}
BLOCKS = {"address", "p", "li", "div", "section", "td", "span"}
MIN_BLOCK, MAX_BLOCK, MAX_NAV = 20, 900, 12_000
_SPACE = re.compile(r"\s+")
_LOGO = re.compile(r"(?:^|[^a-z])logo(?:[^a-z]|$)", re.I)


def squeeze(text: str) -> str:
    return _SPACE.sub(" ", text).strip()


class _Page(HTMLParser):
    """Keeps the open elements; text goes to every open element that collects it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, dict]] = []  # tag, hidden, what it collects
        self.title, self.metas, self.anchors, self.scripts, self.links, self.imgs = None, {}, [], [], [], []
        self.nav, self.seen, self.blocks, self.ldjson, self.commerce, self.pos = [], [], [], [], False, 0

    def _inside(self, *tags: str) -> bool:
        return any(t in tags for t, _, _ in self.open)

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        self.pos += 1
        if tag in ENDS_P and any(t == "p" for t, _, _ in self.open):
            self._end("p")
        for t in IMPLIED.get(tag, ()):
            if t != "p" and self.open and self.open[-1][0] == t:
                self._end(t)
        hidden = bool(self.open and self.open[-1][1]) or tag in UNSEEN or "hidden" in a or a.get("aria-hidden") == "true"
        what: dict = {"attrs": a, "text": [], "pos": self.pos}
        if "schema.org/Product" in a.get("itemtype", "") or (tag == "a" and "/products/" in a.get("href", "")) or (tag == "form" and "/cart/add" in a.get("action", "")):
            self.commerce = True
        if tag == "meta" and a.get("content"):
            self.metas.setdefault((a.get("property") or a.get("name") or "").lower(), a["content"])
        elif tag == "link":
            self.links.append({"rel": a.get("rel", ""), "href": a.get("href", "")})
        elif tag == "img":
            src = a.get("data-src") or a.get("src") or ""
            if not src or src.startswith("data:"):
                src = ((a.get("data-srcset") or a.get("srcset") or "").split(",")[-1].split() or [""])[0]
            name = " ".join((a.get("alt", ""), a.get("class", ""), a.get("id", ""))).lower()
            header = any(t == "header" or "header" in w["attrs"].get("class", "").lower() for t, _, w in self.open)
            link = next((w["attrs"]["href"] for t, _, w in reversed(self.open) if t == "a" and "href" in w["attrs"]), None)
            self.imgs.append({"src": src, "name": name, "marked": bool(_LOGO.search(f"{name} {src}")), "header": header, "link": link, "pos": self.pos})
        if tag not in VOID:
            self.open.append((tag, hidden, what))

    def handle_endtag(self, tag):
        if any(t == tag for t, _, _ in self.open):
            self._end(tag)

    def _end(self, tag):
        while self.open:
            t, hidden, what = self.open.pop()
            text = "".join(what["text"])
            if t == "title" and self.title is None:
                self.title = squeeze(text)
            elif t == "script":
                kind = what["attrs"].get("type", "").lower()
                (self.ldjson.append(text) if kind == "application/ld+json" else self.scripts.append({"type": kind, "src": what["attrs"].get("src", ""), "text": text}))
            elif t == "a":
                self.anchors.append({"href": what["attrs"].get("href", ""), "text": squeeze(text), "pos": what["pos"], "header": self._inside("header"), "hidden": hidden})
            if t in BLOCKS and not hidden and MIN_BLOCK <= len(b := squeeze(text)) <= MAX_BLOCK:
                self.blocks.append(b)
            if t == tag:
                return

    def handle_data(self, data):
        hidden = bool(self.open and self.open[-1][1])
        for t, h, what in self.open:
            if h == hidden and (not hidden or t in UNSEEN) and (t in BLOCKS or t in ("a", "title", "script")):
                what["text"].append(data)
        if not hidden and not self._inside("title"):
            self.seen.append(data)
            if self._inside("nav", "h1", "h2"):
                self.nav.append(data)

    def result(self) -> dict:
        while self.open:
            self._end(self.open[-1][0])
        text = squeeze(re.sub("&nbsp;?", " ", "".join(x if x.isspace() else x + " " for x in self.seen)))
        return {
            "title": self.title, "metas": self.metas, "anchors": self.anchors, "scripts": self.scripts, "links": self.links, "imgs": self.imgs,
            "nav_text": squeeze(" ".join(self.nav))[:MAX_NAV], "visible_text": text, "blocks": self.blocks, "ldjson": self.ldjson, "commerce": self.commerce, "error": None,
        }


def parse(html: str | None) -> dict:
    """A page's parts; a page that cannot be read has only ``error``. Null is an empty page."""
    p = _Page()
    try:
        p.feed(html or "")
        p.close()
        return p.result()
    except Exception as e:  # one bad page must not stop a batch
        return dict.fromkeys(("title", "nav_text", "visible_text")) | {"metas": {}, "anchors": [], "scripts": [], "links": [], "imgs": [], "blocks": [], "ldjson": [], "commerce": False, "error": str(e)[:200]}


def parse_page(html: Column) -> Column:
    """``parse`` as an Arrow function that returns a struct (see PAGE)."""

    @F.pandas_udf(PAGE)
    def parsed(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse(h) for h in pages], columns=list(parse("")))

    return parsed(html)


class _Tables(HTMLParser):
    """First cell of each row, by table; cells and rows need not be closed."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables: list[list[tuple[str, str]]] = []
        self.cell: list[str] | None = None
        self.fresh = False

    def _close(self):
        if self.cell is not None:
            self.tables[-1].append((self.cell[0], squeeze("".join(self.cell[1:]))))
            self.cell = None

    def handle_starttag(self, tag, attrs):
        if tag in ("table", "tr", "td", "th"):
            self._close()
        if tag == "table":
            self.tables.append([])
        elif tag == "tr":
            self.fresh = True
        elif tag in ("td", "th") and self.fresh and self.tables:
            self.cell, self.fresh = [tag], False

    def handle_endtag(self, tag):
        if tag in ("table", "tr", "td", "th"):
            self._close()

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)


def table_cells(html: str, header: str = "store") -> list[str]:
    """First cells of the rows of each table whose first header cell is ``header``."""
    p = _Tables()
    p.feed(html)
    p.close()
    p._close()
    fit = [t for t in p.tables if next((text.lower() for tag, text in t if tag == "th"), None) == header]
    return [text for t in fit for tag, text in t if tag == "td"]


def json_objects(text: str) -> list[dict]:
    """Every object at any depth of a JSON text, outer before inner; malformed text has none."""
    out: list[dict] = []

    def walk(x):
        if isinstance(x, dict):
            out.append(x)
        for y in x.values() if isinstance(x, dict) else x if isinstance(x, list) else ():
            walk(y)

    try:
        walk(json.loads(text))
    except ValueError:
        pass
    return out


def ld_objects(texts: Column) -> Column:
    """Objects of all JSON-LD texts of a page as ARRAY<STRUCT<types, url, emails, telephones, logo>>, by an Arrow function.

    ``types`` has every ``@type`` of an object; e-mails and numbers are its own and those of its contact points, each a text
    or a list of texts; a logo is a text or an object with ``url`` or ``contentUrl``."""
    kind = "array<struct<types:array<string>,url:string,emails:array<string>,telephones:array<string>,logo:string>>"

    def many(v):
        return [x for x in (v if isinstance(v, list) else [v]) if isinstance(x, str)]

    @F.pandas_udf(kind)
    def objects(column: pd.Series) -> pd.Series:
        def one(ts):
            rows = []
            for o in (o for t in (ts if ts is not None else ()) for o in json_objects(t)):
                points = o.get("contactPoint", [])
                people = [o, *(p for p in (points if isinstance(points, list) else [points]) if isinstance(p, dict))]
                logo = o.get("logo")
                logo = logo.get("url") or logo.get("contentUrl") if isinstance(logo, dict) else logo
                rows.append({
                    "types": many(o.get("@type")), "url": o["url"] if isinstance(o.get("url"), str) else None,
                    "emails": [e for p in people for e in many(p.get("email"))], "telephones": [e for p in people for e in many(p.get("telephone"))],
                    "logo": logo if isinstance(logo, str) and logo else None,
                })
            return rows

        return column.map(one)

    return objects(texts)
