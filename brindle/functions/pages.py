"""The page parser (X1-X8, X10): elements of a page, its record and its features.

A page needs its nesting, which no SQL function reads, so pages go through the
standard library's parser in Arrow batches; what is decided about them (page_state
and the like) are column expressions over the features found here.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from brindle.functions import addresses
from brindle.functions.html import skipped

# Class names and ids of the page layout, the heading of extensions, the label whose value is the description, marks of filters.
HEADER, BODY, LABEL, SECTION, RULE, INNER = "header", "body", "spalte1", "body_einzeln", "line_separator", "ce_text"
EXTENSIONS, EFFECT = "Zaubererweiterungen", "Wirkung"
FILTER_MARKS = ("[Alle]", "Publikation", "Tradition", "Leiteigenschaft")
LONG, SUBSTANTIVE = 40, 80
FOLLOW, HUB, LISTING = 3, 5, 10

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_CLOSES_P = {"address", "article", "aside", "blockquote", "div", "dl", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
_BOX = re.compile(rf"""<div\b[^>]*\bclass\s*=\s*["'][^"'>]*\b{INNER}\b""", re.I)
_NESTED = re.compile(r"<!DOCTYPE html>.*?</html>", re.S | re.I)


class Element:
    """An element, its attributes, and its children: elements and texts."""

    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Element | str] = []

    def has_class(self, name: str) -> bool:
        return name in self.attrs.get("class", "").split()

    def all(self) -> Iterator[Element]:
        """The elements below, in document order."""
        stack = [iter(self.children)]
        while stack:
            for child in stack[-1]:
                if isinstance(child, Element):
                    yield child
                    stack.append(iter(child.children))
                    break
            else:
                stack.pop()

    def find(self, tag: str | None = None, cls: str | None = None, **attrs: str) -> Element | None:
        return next(self.find_all(tag, cls, **attrs), None)

    def find_all(self, tag: str | None = None, cls: str | None = None, **attrs: str) -> Iterator[Element]:
        return (e for e in self.all() if tag in (None, e.tag) and (cls is None or e.has_class(cls)) and all(e.attrs.get(k) == v for k, v in attrs.items()))

    def texts(self) -> Iterator[str]:
        stack = [iter(self.children)]
        while stack:
            for child in stack[-1]:
                if isinstance(child, str):
                    yield child
                elif child.tag not in ("script", "style"):
                    stack.append(iter(child.children))
                    break
            else:
                stack.pop()

    def text(self, joint: str = " ") -> str:
        """Its texts, each stripped, blanks left out, joined."""
        return joint.join(s for t in self.texts() if (s := t.strip()))

    def after(self) -> list[Element | str]:
        """Its later siblings."""
        if self.parent is None:
            return []
        here = next(i for i, c in enumerate(self.parent.children) if c is self)
        return self.parent.children[here + 1 :]


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.root = self.at = Element("", {}, None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _CLOSES_P and self._is_open("p"):
            self.handle_endtag("p")
        if tag in ("li", "option", "dt", "dd", "tr", "td", "th") and self.at.tag == tag:
            self.handle_endtag(tag)
        element = Element(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(element)
        if tag not in _VOID:
            self.at = element

    def _is_open(self, tag: str) -> bool:
        e = self.at
        while e is not None and e.tag not in ("", "div", "table", "td", "body"):
            if e.tag == tag:
                return True
            e = e.parent
        return False

    def handle_endtag(self, tag: str) -> None:
        e = self.at
        while e.parent is not None and e.tag != tag:
            e = e.parent
        if e.parent is not None:
            self.at = e.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parsed(page: str) -> Element:
    """The elements of a page; of a whole document kept inside a page's text element,
    that document's (X7)."""
    builder = _Builder()
    builder.feed(page)
    builder.close()
    if (box := _BOX.search(page)) and builder.root.find("div", INNER) and (inner := _NESTED.search(page, box.end())):
        builder = _Builder()
        builder.feed(inner[0])
        builder.close()
    return builder.root


def content_area(root: Element) -> Element:
    """The first of #main, .inside, .body, main and body that there is."""
    return root.find("div", id="main") or root.find("div", "inside") or root.find("div", BODY) or root.find("main") or root.find("body") or root


def _titled(title: Element | None, site_name: str) -> str:
    """A title without the site's name at its end."""
    return title.text("").removesuffix(f" - {site_name}" if site_name else "").strip() if title else ""


def name_of(root: Element, site_name: str = "") -> str:
    """The first header or heading, else the title without the site's suffix."""
    head = next((e for e in root.all() if e.tag == "h1" or (e.tag == "div" and e.has_class(HEADER))), None)
    if head and len(text := head.text()) > 1:
        return text
    return _titled(root.find("title"), site_name)


def labelled(root: Element) -> list[tuple[str, Element]]:
    """Labels of the body and the element beside each."""
    body, out = root.find("div", BODY), []
    for label in body.find_all("div", LABEL) if body else ():
        beside = next((e for e in label.after() if isinstance(e, Element) and e.tag == "div"), None)
        if beside:
            out.append((label.text("").rstrip(":"), beside))
    return out


def properties_of(root: Element) -> dict[str, str]:
    """Values by label (X3); a label beside a label has none."""
    found = {label: e.text() for label, e in labelled(root) if not e.has_class(LABEL)}
    return {k: v for k, v in found.items() if k and v}


def breadcrumbs_of(root: Element) -> list[str]:
    box = root.find(cls="breadcrumb_boxed")
    return [t for a in box.find_all("a") if (t := a.text(""))] if box else []


def paragraphs_of(root: Element, least: int) -> list[str]:
    return [t for p in content_area(root).find_all("p") if len(t := p.text()) >= least]


def description_of(root: Element) -> str:
    """The value of the effect label; without a body, its long paragraphs."""
    if root.find("div", BODY):
        return next((e.text() for label, e in labelled(root) if label == EFFECT), "")
    return "\n\n".join(paragraphs_of(root, LONG))


def extensions_of(root: Element) -> list[dict[str, str]]:
    """Elements after the extensions' heading: "#name" opens one, others describe it,
    a separator ends them (X6)."""
    body = root.find("div", BODY)
    # sections of a body count as headings
    head = next((e for e in body.all() if (e.tag == "h3" or (e.tag == "div" and e.has_class(SECTION))) and EXTENSIONS in "".join(e.texts())), None) if body else None
    out: list[dict[str, str]] = []
    for e in head.after() if head else ():
        if not isinstance(e, Element):
            continue
        if e.has_class(RULE):
            break
        text = e.text("")
        if text.startswith("#"):
            out.append({"name": text[1:].strip(), "description": ""})
        elif out and text:
            out[-1]["description"] = f"{out[-1]['description']} {text}".strip()
    return out


RECORD = "name string, breadcrumbs array<string>, subcategory string, properties array<struct<k:string,v:string>>, description string, extensions array<struct<name:string,description:string>>, error string"
_NO_RECORD = {"name": None, "breadcrumbs": [], "subcategory": None, "properties": [], "description": None, "extensions": [], "error": None}


def record_of(page: str, site_name: str = "") -> dict:
    root = parsed(page)
    crumbs = breadcrumbs_of(root)
    return _NO_RECORD | {
        "name": name_of(root, site_name),
        "breadcrumbs": crumbs,
        "subcategory": crumbs[-2] if len(crumbs) > 1 else None,
        "properties": [{"k": k, "v": v} for k, v in properties_of(root).items()],
        "description": description_of(root),
        "extensions": extensions_of(root),
    }


def record(html: Column, site_name: str = "") -> Column:
    """The record of each page (X8) of the site of that name; a null page is empty, one that fails has its
    error instead of a record."""

    @F.pandas_udf(RECORD)
    def udf(pages: pd.Series) -> pd.DataFrame:
        rows = []
        for page in pages:
            try:
                rows.append(record_of(page or "", site_name))
            except Exception as e:  # noqa: BLE001  a page that cannot be read is a row with its error
                rows.append(_NO_RECORD | {"error": str(e)})
        return pd.DataFrame(rows, columns=list(_NO_RECORD))

    return udf(html)


FEATURES = "is_filter boolean, has_properties boolean, has_text boolean, has_labels boolean, has_name boolean, n_links int, hrefs array<string>, error string"
_NO_FEATURES = {"is_filter": False, "has_properties": False, "has_text": False, "has_labels": False, "has_name": False, "n_links": 0, "hrefs": []}


def _is_link(href: str, site: str) -> bool:
    return bool(href) and not href.startswith(("#", "mailto:")) and (site in href or not href.startswith("http"))


def features_of(page: str, site: str, labels: tuple[str, ...], site_name: str = "") -> dict:
    root = parsed(page)
    select = root.find("select")
    boxes = [e for e in root.all() if e.has_class("filter_einzeln")]
    is_filter = any(d.find("select") for d in root.find_all("div", "filter")) or any(i.attrs.get("type") == "submit" for b in boxes for i in b.find_all("input"))
    if select and not is_filter:
        options = " ".join(o.text() for o in root.find_all("option"))
        is_filter = any(m in options for m in FILTER_MARKS)
    body = root.find("div", BODY)
    text = "".join(root.texts()).lower() if labels else ""
    links = [e.attrs["href"] for e in content_area(root).find_all("a") if "href" in e.attrs]
    title = root.find("title")
    return {
        "is_filter": is_filter,
        "has_properties": bool(body and body.find("div", LABEL)),
        "has_text": bool(paragraphs_of(root, SUBSTANTIVE)),
        "has_labels": any(m.lower() in text for m in labels),
        "has_name": bool(_titled(title, site_name) or name_of(root, site_name)),
        "n_links": sum(_is_link(h, site) for h in links),
        "hrefs": [h for e in root.find_all("a") if (h := e.attrs.get("href"))],
    }


def features(html: Column, site: str, labels: list[str], site_name: str = "", told: bool = False) -> Column:
    """What a page's class is decided from; ``site`` is the address that internal links
    start with, ``labels`` are words that mark content.  n_all_links counts the page's links
    but those that a crawl of the site skips.  A page that cannot be read is an error, or, if
    it is to be ``told``, a row with its error."""
    names, marks = [f.split()[0] for f in FEATURES.split(", ")], tuple(labels)

    def of(page: str) -> dict:
        try:
            return features_of(page, site, marks, site_name) | {"error": None}
        except Exception as e:  # noqa: BLE001  as above
            if not told:
                raise
            return _NO_FEATURES | {"error": str(e)}

    @F.pandas_udf(FEATURES)
    def udf(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([of(p or "") for p in pages], columns=names)

    counted = lambda f: F.size(F.filter(F.transform(f.hrefs, lambda h: addresses.absolute(F.lit(site), h)), lambda u: ~skipped(u, site)))
    return addresses.let(udf(html), lambda f: f.withField("n_all_links", counted(f)).dropFields("hrefs"))


def page_class(found: Column) -> Column:
    """struct<page_state, emit, follow> from the features (X10): a hub of HUB links, a
    filter, or text with FOLLOW links is followed; a filter over LISTING links or
    without own content is not emitted."""

    def of(f: Column) -> Column:
        links = F.when(f.n_links > 0, f.n_links).otherwise(f.n_all_links)
        follow = (f.n_links >= HUB) | f.is_filter | (f.has_text & (links >= FOLLOW))
        listing = f.is_filter & ~f.has_properties & (links >= LISTING)
        own = f.has_properties | f.has_text | (f.has_labels & f.has_name & ~f.is_filter)
        emit = ~listing & ~(f.is_filter & ~f.has_properties & ~f.has_text) & own
        state = F.when(emit & follow, "hybrid").when(emit, "content").otherwise("crawl_only")
        return F.struct(state.alias("page_state"), emit.alias("emit"), follow.alias("follow"))

    return addresses.let(found, of)


def is_noise(url: Column, name: Column, breadcrumbs: Column, n_properties: Column, site_name: str, search: str, welcome: str) -> Column:
    """Pages that are no record (C13): the site's search page (titled ``search``) and welcome
    page (its title begins with ``welcome``), the root, and pages with nothing but the
    site's name as breadcrumb."""
    title = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    own = (title == search.lower()) | title.startswith(welcome.lower())
    root = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")).isin("", "/")
    only = (F.array_join(breadcrumbs, "\x01") == site_name) & (F.size(breadcrumbs) == 1)
    return own | root | (F.coalesce(only, F.lit(False)) & (F.coalesce(n_properties, F.lit(0)) == 0))
