"""Addresses and the folding of letters against the standard library."""

from __future__ import annotations

import itertools
import random
import re
import sys
import unicodedata
from urllib.parse import quote, urljoin, urlsplit, urlunsplit

import duckdb
from pyspark.sql import functions as F

from brindle.functions import addresses, text
from brindle.plans.registry import ORACLE_SQL, QUERIES

BASES = ["http://a/b/c/d;p?q", "https://h.example/x/", "https://h.example", "https://h.example/x/y/z.html?k=v#top", "ftp://f/a", "mailto:x@y", "/only/path", "a/b", "", None, "HTTP://Upper/Case", "http://h/../x/./y"]
HREFS = [
    "g:h", "g", "./g", "g/", "/g", "//g", "?y", "g?y", "#s", "g#s", "g?y#s", ";x", "g;x", "g;x?y#s", "", ".", "./", "..", "../", "../g", "../..", "../../", "../../g", "../../../g", "/./g", "/../g", "g.", ".g", "g..", "..g",
    "./../g", "./g/.", "g/./h", "g/../h", "g;x=1/./y", "g;x=1/../y", "..;x", ".;x", "http:g", "https:/g", "HTTPS://X/y", "mailto:me@x", "javascript:void(0)", "//h2/p//q/../r", "a//b///c", " lead", "\ttab\n", "x\ny", "g?y/../x", "g#s/../x",
    "für/ß ?ü=é&a=(b):c-d+e%20#ä b", "100%", "a%zz", "'\"<>", "\\back", "~t_i.l-d*e!", "//", "///x", "////x", "/", "?", "#", "x?#", "data:,a b", "1:2", "a:b", "日本/語?q=語", "😀", None,
]


def plain(url):
    p = urlsplit(url)
    return urlunsplit((p.scheme, p.netloc, quote(p.path, safe="/%"), quote(p.query, safe="=&%+/:()-"), quote(p.fragment, safe="")))


def test_addresses_equal_the_library(spark):
    rng = random.Random(2)
    some = ["".join(rng.choice(["/", ".", "..", "a", "b", ";", "?", "#", "/", "ü", " ", "%", ":"]) for _ in range(rng.randint(1, 9))) for _ in range(400)]
    pairs = list(itertools.product(BASES, HREFS)) + [(rng.choice(BASES[:5]), h) for h in some]
    df = spark.createDataFrame([(i, b, h) for i, (b, h) in enumerate(pairs)], "i int, b string, h string")
    rows = {r.i: (r.a, r.e) for r in df.select("i", addresses.absolute(df.b, df.h).alias("a"), addresses.encoded(df.h).alias("e")).collect()}
    wrong = [(b, h, rows[i][0], urljoin(b or "", h or "")) for i, (b, h) in enumerate(pairs) if rows[i][0] != urljoin(b or "", h or "")]
    assert not wrong
    wrong = [(h, rows[i][1], plain(h)) for i, (_, h) in enumerate(pairs) if h is not None and rows[i][1] != plain(h)]
    assert not wrong
    assert all(rows[i][1] is None for i, (_, h) in enumerate(pairs) if h is None)


def test_quoting_is_byte_by_byte(spark):
    texts = [chr(c) for c in itertools.chain(range(1, 300), (0x20AC, 0x1F600))] + ["", "a b\nc", "x\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for safe in ("", "/%", "=&%+/:()-"):
        assert [r.q for r in df.select(addresses.quoted(df.t, safe).alias("q")).collect()] == [quote(t, safe=safe) for t in texts]


def test_folding_equals_decomposition_of_every_character(spark):
    chars = [chr(c) for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    rng = random.Random(7)
    several = [c for c in chars if len(unicodedata.normalize("NFKD", c).encode("ascii", "ignore")) > 1]
    texts = ["x".join(chars[i : i + 500]) for i in range(0, len(chars), 500)] + ["", " ", "Äpfel & Öl, Straße", "ﬁne ½ ㎏ Ⅷ"]
    texts += ["".join(rng.choice(rng.choice([several, chars[:600]])) for _ in range(30)) for _ in range(200)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "i int, t string")
    got = {r.i: r.f for r in df.select("i", text.ascii_folded(df.t).alias("f")).collect()}
    fold = lambda t: re.sub("[^a-z0-9]+", " ", unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode().lower()).strip()
    assert got.pop(-1) == "" and got == {i: fold(t) for i, t in enumerate(texts)}


def test_upper_keeps_every_character_one(spark):
    """As DuckDB's upper, on every character and within texts."""
    con = duckdb.connect()
    chars = [chr(c) for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and (len(chr(c).upper()) > 1 or c < 0x2000)]
    # capitals that Unicode 16 added, which the JVM has and DuckDB has not
    chars = [c for c in chars if c not in "\u019b\u0264\u1c8a"]
    texts = [*chars, "".join(chars), "Straße", "ß", "ßß", "aßb ŉ ᾀ", "ﬁn", "", None]
    expected = [r[0] for r in con.execute("SELECT upper(t) FROM (SELECT unnest($t) AS t, unnest(range(len($t))) AS i) ORDER BY i", {"t": texts}).fetchall()]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", text.upper(F.col("t")).alias("u")).orderBy("i").collect()
    assert [(t, r["u"]) for t, r in zip(texts, rows, strict=True)] == list(zip(texts, expected, strict=True))


def test_synced_pages_with_a_sharp_s(spark, tmp_path):
    """French texts with a sharp s, which are rare in the small tables, give DuckDB's rows."""
    rows = [(1, "groß ŉ", "fr"), (2, "groß", "de"), (3, "ß", "es"), (4, "plain", "fr"), (5, "straße " * 600, "fr")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("p12_versions", "p12_sync_pages", "p12_sync_chunks", "p12_hash_sync"):
        df = QUERIES[name](spark, str(tmp_path))
        found = con.execute(ORACLE_SQL[name])
        columns = [d[0] for d in found.description]
        assert sorted(map(str, map(tuple, df.select(*columns).collect()))) == sorted(map(str, found.fetchall()))
