"""The crawl against plain Python, whole, in parts, and after a round that was cut off."""

from __future__ import annotations

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from brindle.operators import crawl

SITE = "https://h/"
LONG = "x" * 90


def page(links, text):
    return "<html><head><title>t</title></head><body>" + "".join(f'<a href="{x}">l</a>' for x in links) + (f"<p>{LONG}</p>" if text else "<p>short</p>") + "</body></html>"


def site_of(seed, n=60):
    rng = random.Random(seed)
    pages = {}
    for i in range(n):
        links = [rng.choice([f"p{rng.randrange(n + 8)}", f"/p{rng.randrange(n + 8)}", f"https://h/p{rng.randrange(n)}", "https://far/p1", "#top", "mailto:a@b", "kontakt.html"]) for _ in range(rng.choice([0, 1, 2, 4, 6]))]
        pages[f"{SITE}p{i}"] = page(links, rng.random() < 0.5)
    for i in range(0, n, 13):
        pages[f"{SITE}p{i}"] = None
    return pages


def state(html):
    """(page_state, links to follow): text counts from three links on, else five."""
    hrefs = re.findall('href="([^"]*)"', html)
    text = LONG in html
    inner = sum(not h.startswith(("#", "mailto:")) and (SITE in h or not h.startswith("http")) for h in hrefs)
    targets = {h if h.startswith("http") else SITE + h.lstrip("/") for h in hrefs if not h.startswith(("#", "mailto:")) and "kontakt" not in h}
    count = inner or len([t for t in targets if t.startswith(SITE)])
    follow = inner >= 5 or (text and count >= 3)
    kind = "hybrid" if text and follow else "content" if text else "crawl_only"
    return kind, {t for t in targets if t.startswith(SITE)} if follow else set()


def walked(pages, seeds, runs=1):
    done, failed, sources, pending = {}, {}, {}, set()
    for run in range(runs):
        for name, start in seeds:
            urls = set(start) | ({u for c, u in pending if c == name} if run else set())
            for u in urls & set(done):
                sources[u].add(name)
            frontier, visited, hop = urls - set(done), set(), 0
            while frontier:
                found, before = set(), set(done)
                for u in frontier:
                    visited.add(u)
                    if pages.get(u) is None:
                        failed[u] = "gone" if u in pages else "not found"
                        pending.add((name, u))
                    else:
                        kind, links = state(pages[u])
                        done[u] = (name, kind, hop)
                        sources[u] = {name}
                        found |= links
                for u in found & before:
                    sources[u].add(name)
                frontier, hop = found - set(done) - visited, hop + 1
    return {u: (*v, sorted(sources[u])) for u, v in done.items()}, failed, {(c, u) for c, u in pending if u not in done}


def told(c):
    return {r.url: (r.category, r.page_state, r.hop, r.sources) for r in c.completed.collect()}, {r.url: r.error for r in c.failed.collect()}, {(r.category, r.url) for r in c.pending.collect()}


@pytest.fixture
def made(spark):
    def make(seed):
        pages = site_of(seed)
        df = spark.createDataFrame([(u, h, None if h else "gone") for u, h in pages.items()], "url string, html string, error string").cache()
        seeds = [("a", [f"{SITE}p1", f"{SITE}p2", f"{SITE}p0"]), ("none", []), ("b", [f"{SITE}p1", f"{SITE}p30", f"{SITE}p99", None]), ("c", [f"{SITE}p{i}" for i in range(40, 60)])]
        plain = [(n, [u for u in s if u]) for n, s in seeds]
        return pages, df, plain, [(n, spark.createDataFrame([(u,) for u in s], "url string")) for n, s in seeds]

    return make


def test_crawl_equals_plain_python(made, tmp_path):
    pages, df, plain, seeds = made(1)
    found = crawl.crawl(df, seeds, str(tmp_path), SITE, [])
    assert found.finished and told(found) == walked(pages, plain)
    assert len(told(found)[0]) > 20 and told(found)[1]


def test_crawl_goes_on_after_a_stop(made, tmp_path):
    pages, df, plain, seeds = made(2)
    whole = crawl.crawl(df, seeds, f"{tmp_path}/whole", SITE, [])
    part = crawl.crawl(df, seeds, f"{tmp_path}/part", SITE, [], max_rounds=2)
    assert not part.finished and 0 < part.completed.count() < whole.completed.count() and part.pending.count() > 0
    # a round cut off before its manifest: its tables are there, and are done again
    crawl.crawl(df, seeds, f"{tmp_path}/part", SITE, [], max_rounds=1)
    os.remove(f"{tmp_path}/part/manifest/3")
    rest = crawl.crawl(df, seeds, f"{tmp_path}/part", SITE, [])
    assert rest.finished and told(rest) == told(whole) == walked(pages, plain)
    # finished: nothing changes, until it is asked for again
    assert told(crawl.crawl(df, seeds, f"{tmp_path}/part", SITE, [])) == told(whole)


def test_pending_addresses_are_tried_again(made, spark, tmp_path):
    pages, df, plain, seeds = made(3)
    first = crawl.crawl(df, seeds, str(tmp_path), SITE, [])
    assert told(first) == walked(pages, plain)
    mended = {u: h or page([f"{SITE}p3"], True) for u, h in pages.items()}
    again = spark.createDataFrame([(u, h, None) for u, h in mended.items()], "url string, html string, error string")
    second = crawl.crawl(again, seeds, str(tmp_path), SITE, [], again=True)
    lost = {u for _, u in told(first)[2]}
    assert lost & set(told(second)[0]) == {u for u in lost if u in mended} and not {u for _, u in told(second)[2]} & set(mended)


def test_crawl_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "url string, html string, error string")
    assert crawl.crawl(none, [], f"{tmp_path}/a", SITE, []).completed.count() == 0
    found = crawl.crawl(none, [("a", spark.createDataFrame([("https://h/x",)], "url string"))], f"{tmp_path}/b", SITE, [])
    assert found.finished and told(found) == ({}, {"https://h/x": "not found"}, {("a", "https://h/x")})


def test_a_page_is_read_once_however_many_rounds(spark, tmp_path):
    read, bodies = spark.sparkContext.accumulator(0), [page([f"p{i + 1}", "p0", "p1", "p2", "p3"], True) for i in range(8)]

    @F.udf("string")
    def html(i):
        read.add(1)
        return bodies[i]

    pages = spark.range(8).select(F.concat(F.lit(f"{SITE}p"), "id").alias("url"), html("id").alias("html"), F.lit(None).cast("string").alias("error"))
    found = crawl.crawl(pages, [("a", spark.createDataFrame([(f"{SITE}p0",)], "url string"))], str(tmp_path), SITE, [])
    assert {(r.url, r.hop) for r in found.completed.collect()} == {(f"{SITE}p{i}", max(i - 2, 1) if i else 0) for i in range(8)}
    assert read.value == 8


def test_a_page_that_cannot_be_read_fails_alone(spark, tmp_path):
    bad = "<![1x[" + page([], True)
    pages = {f"{SITE}p0": page(["p1"] * 5, True), f"{SITE}p1": bad, f"{SITE}p2": bad}
    df = spark.createDataFrame([(u, h, None) for u, h in pages.items()], "url string, html string, error string")
    found = crawl.crawl(df, [("a", spark.createDataFrame([(f"{SITE}p0",)], "url string"))], str(tmp_path), SITE, [])
    done, failed, pending = told(found)
    assert set(done) == {f"{SITE}p0"} and set(failed) == {f"{SITE}p1"} and "expected name token" in failed[f"{SITE}p1"] and pending == {("a", f"{SITE}p1")}
