"""Addresses as SQL functions: parts, relative addresses, percent-encoding.

The rules are those of the common URL syntax as the standard library of Python applies
them: white space at the start and tabs and line breaks anywhere go, schemes come in
lower case, an empty query or fragment goes with its mark.  A bracket left open is a
character like others.  A null address stays null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Schemes whose addresses can be relative to one another.
RELATIVE = ("", "ftp", "http", "gopher", "nntp", "imap", "wais", "file", "https", "shttp", "mms", "prospero", "rtsp", "rtsps", "rtspu", "sftp", "svn", "svn+ssh", "ws", "wss")
# Schemes whose addresses have a host.
HOSTED = ("ftp", "http", "gopher", "nntp", "telnet", "imap", "wais", "file", "mms", "https", "shttp", "snews", "prospero", "rtsp", "rtsps", "rtspu", "rsync", "svn", "svn+ssh", "sftp", "nfs", "git", "git+ssh", "ws", "wss", "itms-services")
#: Scheme, host with its mark, path, query with its mark, fragment with its mark.
_PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?$"


def let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def parts(url: Column) -> Column:
    """struct<scheme, host, path, query, fragment>; '' for what is not there."""
    clean = F.translate(F.regexp_replace(url, r"^[\x00-\x20]+", ""), "\t\r\n", "")
    part = lambda u, i: F.regexp_extract(u, _PARTS, i)
    return let(
        clean,
        lambda u: F.struct(
            F.lower(part(u, 1)).alias("scheme"),
            F.substr(part(u, 2), F.lit(3)).alias("host"),
            part(u, 3).alias("path"),
            F.substr(part(u, 4), F.lit(2)).alias("query"),
            F.substr(part(u, 5), F.lit(2)).alias("fragment"),
        ),
    )


def joined(address: Column) -> Column:
    """The address of a struct of parts."""
    marked = lambda mark, c: F.when(c != "", F.concat(F.lit(mark), c)).otherwise("")

    def whole(p: Column) -> Column:
        rooted = F.when((p.path != "") & ~p.path.startswith("/"), F.concat(F.lit("/"), p.path)).otherwise(p.path)
        hosted = p.path.startswith("//") | (p.scheme.isin(*HOSTED) & ((p.path == "") | p.path.startswith("/")))
        middle = F.when(p.host != "", F.concat(F.lit("//"), p.host, rooted)).when(hosted, F.concat(F.lit("//"), p.path)).otherwise(p.path)
        return F.concat(F.when(p.scheme != "", F.concat(p.scheme, F.lit(":"))).otherwise(""), middle, marked("?", p.query), marked("#", p.fragment))

    return let(address, whole)


def _resolved(base: Column, path: Column) -> Column:
    """A path read from a base path, its dot segments taken as steps of a stack."""
    step = lambda a, s: F.when(s == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).when(s == ".", a).otherwise(F.array_append(a, s))

    def named(last: Column) -> Column:
        # a parameter of the last segment is no part of its name
        name = F.regexp_extract(last, r"(?s)^([^;]*)", 1)
        own = F.concat(F.substr(path, F.lit(1), F.char_length(path) - F.char_length(last)), name)
        return let(own, lambda o: F.concat(let(F.split(F.when(o.startswith("/"), o).otherwise(F.concat(F.regexp_replace(base, r"[^/]+$", ""), o)), "/", -1), lambda s: walked(s, o.startswith("/"))), F.substr(last, F.char_length(name) + 1)))

    def walked(segments: Column, rooted: Column) -> Column:
        kept = F.filter(segments, lambda s, i: (s != "") | (i == 0) | (i == F.size(segments) - 1) | rooted)
        stack = let(kept, lambda k: let(F.aggregate(k, F.array().cast("array<string>"), step), lambda a: F.when(F.element_at(k, -1).isin(".", ".."), F.array_append(a, F.lit(""))).otherwise(a)))
        return F.coalesce(F.nullif(F.array_join(stack, "/"), F.lit("")), F.lit("/"))

    return let(F.regexp_extract(path, r"(?s)([^/]*)$", 1), named)


def absolute(base: Column, href: Column) -> Column:
    """The address that a link found at ``base`` points to."""
    # an empty parameter of the last segment goes with its mark
    bare = lambda p: F.regexp_replace(p, r"(?s)^((?:.*/)?[^/;]*);\z", "$1")
    told = lambda url: let(parts(url), lambda p: p.withField("path", bare(p.path)))

    def done(b: Column, h: Column) -> Column:
        scheme = F.when(h.scheme == "", b.scheme).otherwise(h.scheme)
        made = lambda host, path, query: F.struct(b.scheme.alias("scheme"), host.alias("host"), path.alias("path"), query.alias("query"), h.fragment.alias("fragment"))
        same = made(b.host, b.path, F.when(h.query == "", b.query).otherwise(h.query))
        address = F.when(h.host != "", made(h.host, h.path, h.query)).when(h.path == "", same).otherwise(made(b.host, _resolved(b.path, h.path), h.query))
        return F.when((scheme != b.scheme) | ~b.scheme.isin(*RELATIVE), href).otherwise(joined(address))

    both = let(told(base), lambda b: let(told(href), lambda h: done(b, h)))
    return F.when(F.coalesce(base, F.lit("")) == "", F.coalesce(href, F.lit(""))).when(F.coalesce(href, F.lit("")) == "", base).otherwise(both)


def quoted(text: Column, safe: str) -> Column:
    """Percent-encoded byte by byte, but for letters, digits, ``_.-~`` and ``safe``."""
    keep = "[A-Za-z0-9_.~" + "".join(f"\\{c}" for c in safe) + "-]"
    char = lambda p: F.when(p < "80", F.char(F.conv(p, 16, 10).cast("int")))
    one = lambda p: let(char(p), lambda c: F.when(F.coalesce(c.rlike(f"^{keep}$"), F.lit(False)) & (c != "\n"), c).otherwise(F.concat(F.lit("%"), p)))
    pairs = F.regexp_extract_all(F.hex(F.encode(text, "utf-8")), F.lit("(..)"), F.lit(1))
    return F.when(text.rlike(f"^{keep}*\\z"), text).otherwise(F.array_join(F.transform(pairs, one), ""))


def encoded(url: Column) -> Column:
    """Percent-encoded part by part, each with its own safe characters."""
    # The safe characters of path, query and fragment.
    path, query, fragment = "/%", "=&%+/:()-", ""
    return let(parts(url), lambda p: joined(F.struct(p.scheme.alias("scheme"), p.host.alias("host"), quoted(p.path, path).alias("path"), quoted(p.query, query).alias("query"), quoted(p.fragment, fragment).alias("fragment"))))
