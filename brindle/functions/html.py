"""HTML and URL expressions.

Pages are read with regular expressions on the JVM after scripts, styles and
comments are cut out; what needs the nesting of elements is in pages.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Length of a long paragraph; addresses that a crawl never follows, and
# marks of addresses that a template left broken.
LONG_PARAGRAPH = 40
SKIPPED = ("kontakt.html", "impressum", "datenschutz", "index.html", "start.html", "javascript:", "mailto:", "#", "sitemap")
BROKEN = ("{{", "}}", "{link_url", "|urlattr", "\ufffd", "%ef%bf%bd")


def cleaned(html: Column) -> Column:
    """The page without scripts, styles and comments."""
    return F.regexp_replace(html, r"(?s)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", "")


def bare_text(fragment: Column) -> Column:
    """Tags dropped, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(fragment, r"<[^>]*>", ""), r"\s+", " "))


def heading(html: Column) -> Column:
    """The first h1, else the title; '' without either."""
    h1 = bare_text(F.regexp_extract(cleaned(html), r"(?s)<h1[^>]*>(.*?)</h1>", 1))
    return F.coalesce(F.nullif(h1, F.lit("")), bare_text(F.regexp_extract(html, r"(?s)<title[^>]*>(.*?)</title>", 1)))


def paragraphs(html: Column, least: int = LONG_PARAGRAPH) -> Column:
    """Texts of the closed paragraphs of at least ``least`` characters."""
    found = F.regexp_extract_all(cleaned(html), F.lit(r"(?s)<p>(.*?)</p>"), F.lit(1))
    return F.filter(F.transform(found, bare_text), lambda p: F.char_length(p) >= least)


def hrefs(html: Column) -> Column:
    """All link targets, as written."""
    return F.regexp_extract_all(cleaned(html), F.lit(r'<a[^>]+href="([^"]*)"'), F.lit(1))


def is_internal(href: Column) -> Column:
    return href.startswith("/") & ~href.startswith("//")


def path_of(url: Column) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))


def first_query_value(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"[?&][^=&#]*=([^&#]*)", 1), F.lit(""))


def item_id(url: Column, name: Column) -> Column:
    """The first query value, else the name, else a stable hash of the URL."""
    return F.coalesce(first_query_value(url), F.nullif(F.trim(name), F.lit("")), F.left(F.sha2(url, 256), F.lit(8)))


def skipped(url: Column, site: str) -> Column:
    """Links that a crawl never follows (C15): other sites, and the site's own pages
    such as imprint, contact and search."""
    low = F.lower(url)
    out = ~low.startswith(site.lower()) | F.coalesce(F.try_parse_url(low, F.lit("PATH")).endswith("/suche.html"), F.lit(False))
    for mark in SKIPPED:
        out = out | low.contains(mark)
    return out


def broken(url: Column) -> Column:
    """Addresses with what is left of a template or of a wrong encoding."""
    out = F.lit(False)
    for mark in BROKEN:
        out = out | F.lower(url).contains(mark)
    return out


def base_of(html: Column, url: Column) -> Column:
    """The address that a page's links start from: its base element, else its own."""
    base = F.regexp_extract(cleaned(html), r"""(?is)<base\b[^>]*?\bhref\s*=\s*["']([^"']*)["']""", 1)
    return F.coalesce(F.nullif(base, F.lit("")), url)


def anchors(html: Column) -> Column:
    """All link targets in either kind of quotes, entities of & resolved."""
    found = F.regexp_extract_all(cleaned(html), F.lit(r"""(?is)<a\b[^>]*?\bhref\s*=\s*("[^"]*"|'[^']*')"""), F.lit(1))
    return F.transform(found, lambda a: F.replace(F.substr(a, F.lit(2), F.char_length(a) - 2), F.lit("&amp;"), F.lit("&")))


def sitemap_urls(xml: Column) -> Column:
    return F.array_distinct(F.transform(F.xpath(xml, F.lit("//*[local-name()='loc']/text()")), lambda u: F.trim(u)))


def decoded(url: Column) -> Column:
    """Path and query, percent-decoded, in lower case."""
    path, query = (F.coalesce(F.try_parse_url(url, F.lit(part)), F.lit("")) for part in ("PATH", "QUERY"))
    return F.lower(F.coalesce(F.try_url_decode(F.replace(F.concat(path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")), F.lit("+"), F.lit("%2B"))), F.concat(path, query)))


def page_file(url: Column) -> Column:
    """The file a page is kept in (I12): path and query, what a file name cannot hold
    as underscores, at most 200 characters."""
    path, query = (F.coalesce(F.try_parse_url(url, F.lit(part)), F.lit("")) for part in ("PATH", "QUERY"))
    flat = F.regexp_replace(F.replace(path, F.lit("/"), F.lit("_")), "^_+|_+$", "")
    name = F.when(query != "", F.concat(flat, F.lit("_"), F.translate(query, "/=", "__"))).otherwise(flat)
    plain = F.coalesce(F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))), name)
    return F.concat(F.left(F.regexp_replace(plain, r'[<>:"/\\|?*]', "_"), F.lit(200)), F.lit(".html"))


def url_of_file(name: Column, site: str) -> Column:
    """The address that a file name was made of (I12): page.html_key_value.html is
    page.html?key=value; of others underscores are slashes."""
    page, rest = F.split_part(name, F.lit(".html_"), F.lit(1)), F.split_part(name, F.lit(".html_"), F.lit(2))
    key = F.regexp_extract(rest, "^([^_]*)_", 1)
    value = F.regexp_replace(F.substr(rest, F.char_length(key) + 2), r"\.html$", "")
    query = name.contains(".html_") & rest.contains("_")
    return F.when(query, F.concat(F.lit(site), page, F.lit(".html?"), key, F.lit("="), value)).otherwise(F.concat(F.lit(site), F.replace(name, F.lit("_"), F.lit("/"))))
