"""Links and the crawl frontier."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import addresses, html
from brindle.functions import pages as page_views


def links(pages: DataFrame, key: str, body: str, keep: list[str] | None = None) -> DataFrame:
    """Distinct internal links of each page, as written."""
    targets = F.array_distinct(F.filter(html.hrefs(F.col(body)), html.is_internal))
    return pages.select(key, *(keep or []), F.explode(targets).alias("href"))


def link_targets(body: Column, url: Column) -> Column:
    """The absolute addresses that a page's links point to, from its base element where it
    has one; anchors, mail and scripts do not count."""
    hrefs = F.filter(F.array_distinct(html.anchors(body)), lambda h: ~h.rlike("(?i)^(?:#|mailto:|javascript:)"))
    return addresses.let(html.base_of(body, url), lambda b: F.transform(hrefs, lambda h: addresses.absolute(b, h)))


def resolved_links(pages: DataFrame, key: str, body: str, url: str, site: Column) -> DataFrame:
    """(key, target): the distinct addresses of a site that each page links to (X9), from
    the page's base element where it has one; relative links count, anchors, mail and
    scripts do not."""
    told = pages.select(key, site.alias("__site"), F.explode(link_targets(F.col(body), F.col(url))).alias("__target"))
    found = told.select(key, "__site", addresses.encoded(F.col("__target")).alias("target"))
    return found.filter(F.col("target").startswith(F.col("__site"))).select(key, "target").distinct()


def seeds(hubs: DataFrame, sitemap: DataFrame, url: str, pattern: str, site: str | None = None) -> DataFrame:
    """Hub addresses and those of the sitemap that match a category (X12), without what a
    crawl of ``site`` skips."""
    listed = sitemap.filter(html.decoded(F.col(url)).rlike(pattern))
    if site is not None:
        listed = listed.filter(~html.skipped(F.col(url), site))
    return hubs.select(url).union(listed.select(url)).distinct()


def reachable(edges: DataFrame, start: DataFrame, folder: str, hops: int | None = None) -> DataFrame:
    """(node, hop, sources): nodes reachable from ``start`` (node, source), the least
    number of links, and which of the sources they are reached from (X11).

    Each round joins only what is new, (node, source) pairs not seen before, and is
    written to ``folder``, so the lineage stays short; the crawl ends when nothing is
    new, or after ``hops`` rounds if that is given."""
    spark, at = edges.sparkSession, f"{folder}/{uuid.uuid4().hex}"
    seen = start.select("node", "source").distinct().withColumn("hop", F.lit(0))
    schema = seen.schema
    seen.write.parquet(f"{at}/hop=0")
    hop = 0
    while hops is None or hop < hops:
        seen = spark.read.schema(schema).parquet(*(f"{at}/hop={h}" for h in range(hop + 1)))
        last = spark.read.schema(schema).parquet(f"{at}/hop={hop}")
        hop += 1
        step = edges.join(last.select(F.col("node").alias("src"), "source"), "src").select(F.col("dst").alias("node"), "source").distinct()
        fresh = step.join(seen, (step["node"] == seen["node"]) & step["source"].eqNullSafe(seen["source"]), "left_anti")
        fresh.withColumn("hop", F.lit(hop)).write.parquet(f"{at}/hop={hop}")
        if spark.read.schema(schema).parquet(f"{at}/hop={hop}").isEmpty():
            break
    seen = spark.read.schema(schema).parquet(*(f"{at}/hop={h}" for h in range(hop + 1)))
    return seen.groupBy("node").agg(F.min("hop").alias("hop"), F.array_sort(F.collect_set("source")).alias("sources"))


@dataclass
class Crawl:
    """What a crawl has found: pages completed (url, category that reached it first,
    page_state, hop, sources), addresses that failed (url, error), and what is still to do
    or failed and may be tried again (category, url)."""

    completed: DataFrame
    failed: DataFrame
    pending: DataFrame
    finished: bool


_EVENTS = "kind string, url string, category string, page_state string, hop int, error string"


class _Rounds:
    """The events of a crawl (completed, failed, linked, frontier), a folder for each round.  A
    round counts when its manifest is there, which is written last, by a rename.  A round
    that was cut off is done again."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self.fs = self.hadoop.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def last(self) -> dict | None:
        if not self.fs.exists(self.hadoop.Path(f"{self.folder}/manifest")):
            return None
        lines = [json.loads(r["value"]) for r in self.spark.read.text(f"{self.folder}/manifest").collect()]
        return max(lines, key=lambda m: m["round"]) if lines else None

    def write(self, number: int, events: DataFrame | None, **told: int) -> dict:
        """Writes the events of a round, then its manifest: ``told`` and the size of the frontier."""
        events = self.spark.createDataFrame([], _EVENTS) if events is None else events
        path = f"{self.folder}/events/round={number}"
        events.write.mode("overwrite").parquet(path)
        n = self.spark.read.schema(_EVENTS).parquet(path).filter("kind = 'frontier'").count()
        told = {"round": number, "n": n, **told}
        fresh = self.hadoop.Path(f"{self.folder}/writing")
        out = self.fs.create(fresh, True)
        out.writeBytes(json.dumps(told))
        out.close()
        self.fs.mkdirs(self.hadoop.Path(f"{self.folder}/manifest"))
        self.fs.rename(fresh, self.hadoop.Path(f"{self.folder}/manifest/{number}"))
        return told

    def events(self, kind: str, upto: int, first: int = 0) -> DataFrame:
        rows = self.spark.read.schema(f"{_EVENTS}, round int").parquet(f"{self.folder}/events")
        return rows.filter((F.col("kind") == kind) & F.col("round").between(first, upto))


def _event(rows: DataFrame, kind: str, category: str, **columns: Column) -> DataFrame:
    given = {"page_state": F.lit(None).cast("string"), "hop": F.lit(None).cast("int"), "error": F.lit(None).cast("string")} | columns
    return rows.select(F.lit(kind).alias("kind"), "url", F.lit(category).alias("category"), *(c.alias(k) for k, c in given.items()))


def crawl(pages: DataFrame, seeds: list[tuple[str, DataFrame]], folder: str, site: str, labels: list[str], *, follow: bool = True, again: bool = False, max_rounds: int | None = None) -> Crawl:
    """Crawls ``pages`` (url, html, error) from the seeds (url) of one category after the
    other (X11, X12, A6, J6), and writes every round to ``folder``.

    A round takes the frontier's addresses; one without a page, or with one that cannot be
    read, fails, with its error or ``not found``.  Pages are classified (X10), and only those
    whose class says so are expanded, to their links on ``site`` (X9) that a crawl does not
    skip (C15).  A call reads each page once, before its first round, and the rounds meet
    addresses and links only, so their number does not count against the pages.  A link to
    a page that is completed adds the category to its sources and is not followed again; an
    address that failed is tried again by the next category that meets it.

    Called again with the same folder a crawl goes on after its last whole round, also when it
    was stopped by ``max_rounds`` or cut off; once finished it changes nothing, unless
    ``again`` asks for another run over the seeds and what is pending.  A page's
    address is once in ``pages``; of several rows any one counts."""
    spark, rounds = pages.sparkSession, _Rounds(pages.sparkSession, folder)

    def begin(number: int, run: int, category: int, upto: int) -> dict:
        """Writes the first frontier of a category; where it is empty, of the next that has any."""
        while category < len(seeds):
            name, start = seeds[category]
            urls = start.select("url").filter(F.col("url").isNotNull()).distinct()
            if upto < 0:
                events = _event(urls, "frontier", name)
            else:
                if run:
                    urls = urls.union(_pending(rounds, upto, None).filter(F.col("category") == name).select("url")).distinct()
                done = rounds.events("completed", upto).select("url")
                events = _event(urls.join(done, "url", "left_anti"), "frontier", name).union(_event(urls.join(done, "url", "left_semi"), "linked", name))
            told = rounds.write(number, events, run=run, category=category, hop=0, first=number)
            if told["n"]:
                return told
            number, upto, category = number + 1, number, category + 1
        return rounds.write(number, None, run=run, category=category, hop=0, first=number)

    now = rounds.last()
    if now is None:
        now = begin(0, 0, 0, -1)
    elif again and now["category"] >= len(seeds):
        now = begin(now["round"] + 1, now["run"] + 1, 0, now["round"])
    ran, read = 0, None
    while now["category"] < len(seeds) and (max_rounds is None or ran < max_rounds):
        k, name = now["round"], seeds[now["category"]][0]
        if read is None:
            _read(pages, site, labels, follow).write.mode("overwrite").parquet(f"{folder}/read")
            read = spark.read.parquet(f"{folder}/read")
        path = f"{folder}/fetched/round={k}"
        rounds.events("frontier", k, k).select("url").join(read, "url", "left").write.mode("overwrite").parquet(path)
        got = spark.read.parquet(path)
        targets = got.select(F.explode("links").alias("url")).distinct()
        before = rounds.events("completed", k).select("url")
        # an address is visited once in a category's run
        tried = rounds.events("frontier", k, now["first"]).select("url")
        events = (
            _event(got.filter("page_state is not null"), "completed", name, page_state=F.col("page_state"), hop=F.lit(now["hop"]))
            .union(_event(got.filter("page_state is null"), "failed", name, error=F.coalesce("error", F.lit("not found"))))
            .union(_event(targets.join(before, "url", "left_semi"), "linked", name))
            .union(_event(targets.join(before.union(tried), "url", "left_anti"), "frontier", name))
        )
        now = rounds.write(k + 1, events, run=now["run"], category=now["category"], hop=now["hop"] + 1, first=now["first"])
        if not now["n"]:
            now = begin(now["round"] + 1, now["run"], now["category"] + 1, now["round"])
        ran += 1
    return _result(rounds, now, seeds)


def _read(pages: DataFrame, site: str, labels: list[str], follow: bool) -> DataFrame:
    """(url, page_state, error, links): each address with its page's class, or why it has
    none, and the links that a crawl follows from it."""
    own = pages.groupBy("url").agg(F.max(F.struct("html", "error")).alias("p")).select("url", "p.html", "p.error")
    seen = own.withColumn("f", page_views.features(F.col("html"), site, labels, told=True))
    good = F.col("html").isNotNull() & F.col("f.error").isNull()
    c = seen.withColumn("c", F.when(good, page_views.page_class(F.col("f"))))
    own_links = F.filter(F.transform(link_targets(F.col("html"), F.col("url")), addresses.encoded), lambda u: u.startswith(site) & ~html.skipped(u, site))
    links = F.when(F.col("c.follow") & F.lit(follow), F.array_distinct(own_links))
    return c.select("url", F.col("c.page_state").alias("page_state"), F.coalesce("error", "f.error").alias("error"), links.alias("links"))


def _pending(rounds: _Rounds, k: int, name: str | None) -> DataFrame:
    """(category, url) of what failed and is not completed, and of the frontier left of a
    category."""
    open_ones = rounds.events("failed", k).select("category", "url")
    if name is not None:
        open_ones = open_ones.union(rounds.events("frontier", k, k).select("category", "url"))
    return open_ones.distinct().join(rounds.events("completed", k).select("url"), "url", "left_anti").select("category", "url")


def _result(rounds: _Rounds, now: dict, seeds: list[tuple[str, DataFrame]]) -> Crawl:
    k = now["round"]
    done = rounds.events("completed", k).select("url", "category", "page_state", "hop")
    sources = done.select("url", "category").union(rounds.events("linked", k).select("url", "category")).groupBy("url").agg(F.array_sort(F.collect_set("category")).alias("sources"))
    failed = rounds.events("failed", k).groupBy("url").agg(F.max_by("error", "round").alias("error"))
    finished = now["category"] >= len(seeds)
    return Crawl(done.join(sources, "url"), failed, _pending(rounds, k, None if finished else seeds[now["category"]][0]), finished)
