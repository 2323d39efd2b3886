from __future__ import annotations

import json
import math
import random
import re
from urllib.parse import quote, urljoin, urlsplit, urlunsplit

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions import addresses, html, pages
from brindle.operators import audit, categorize, combat, crawl, imports, mutations, ranking, search, sessions
from brindle.plans import search_queries
from brindle.plans.registry import QUERIES
from brindle.sources import readers, schemas
from brindle.streaming import fights


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_upsert_and_deletes(spark):
    t = spark.createDataFrame([(1, "a", 2), (2, "b", 1)], "k int, v string, q int")
    s = spark.createDataFrame([(2, "B", 9), (3, "c", 1)], "k int, v string, q int")
    assert rows(mutations.upsert(t, s, ["k"])) == [(1, "a", 2), (2, "B", 9), (3, "c", 1)]
    after, counts = mutations.insert_if_absent(t, s, ["k"])
    assert rows(after) == [(1, "a", 2), (2, "b", 1), (3, "c", 1)] and tuple(counts.first()) == (1, 1)
    assert rows(mutations.use_one(t, F.lit(True), "q")) == [(1, "a", 1)]
    assert rows(mutations.stack(t, s, ["k"], "q")) == [(1, 2), (2, 10), (3, 1)]
    assert rows(mutations.upsert(t.limit(0), s, ["k"])) == rows(s)


def test_sync_actions(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "k int, h string")
    b = spark.createDataFrame([(2, "z"), (3, None), (4, "w")], "k int, h string")
    assert rows(mutations.sync(a, b, "k", "h")) == [(1, "deleted"), (2, "update"), (3, "unchanged"), (4, "insert")]


def test_required_fails_on_a_miss(spark):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    right = spark.createDataFrame([(1, "a")], "k int, v string")
    with pytest.raises(Exception, match="no match for 2"):
        mutations.required(left, right, ["k"], "k").collect()


def test_exactly_one(spark):
    with pytest.raises(ValueError):
        mutations.exactly_one(spark.range(2))
    assert mutations.exactly_one(spark.range(1)).id == 0


def test_equip_moves_what_fits_either_slot(spark):
    t = spark.createDataFrame([(1, "ADAPTIVE", True), (2, "OFFENSE", True), (3, "OFFENSE", False), (4, "DEFENSE", True)], "k int, slot string, worn boolean")
    worn, slot = mutations.equip(F.col("slot"), F.col("worn"), F.col("k") == 3, "OFFENSE")
    assert rows(t.select("k", worn, slot)) == [(1, True, "DEFENSE"), (2, False, None), (3, True, "OFFENSE"), (4, True, "DEFENSE")]


def test_resolve_confidence(spark):
    v = spark.createDataFrame([(1, "a", 100, ""), (2, "a", 90, ""), (2, "b", 80, ""), (3, "a", 45, ""), (4, "a", 90, ""), (4, "b", 79, "")], "k int, category string, points int, reason string")
    assert rows(categorize.resolve(v, "k").select("k", "category", "confidence")) == [(1, "a", "high"), (2, "unresolved", "ambiguous"), (3, "unresolved", "low"), (4, "a", "medium")]


def test_title_tiers_and_hybrid(spark):
    t = spark.createDataFrame([(1, "Fire bolt"), (2, "Bolt"), (3, "bolt of fire"), (4, "ice")], "id int, title string")
    found = search.rank_titles(t, "title", "BOLT", "id")
    assert [(r.id, r.tier) for r in found.collect()] == [(2, 1), (3, 2), (1, 3)]
    merged = search.hybrid(found.select("id"), t.select("id"), "id")
    assert rows(merged) == [(1, "exact"), (2, "exact"), (3, "exact"), (4, "semantic")]


def test_zero_vectors_are_dropped_and_top_k_is_not_a_sort(spark):
    v = spark.createDataFrame([(1, [0.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, None, 1), (4, [0.6, 0.8], 2)], "vec_id long, embedding array<float>, label int")
    found = search.match_chunks(v, [1.0, 0.0], 0.5, 5)
    assert [(r.vec_id, round(r.similarity, 5)) for r in found.collect()] == [(2, 1.0), (4, 0.6)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Python" not in plan


def test_many_queries_equal_brute_force(spark):
    rng = random.Random(2)
    data = [(i, [float(rng.randint(-2, 2)) for _ in range(3)] if i % 17 else None) for i in range(200)] + [(900, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").repartition(3)
    q = df.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    want = []
    for a, x in data:
        if a % 20 == 0 and x and any(x):
            scored = sorted((-round(sum(p * r for p, r in zip(x, y)) / math.sqrt(sum(p * p for p in x)) / math.sqrt(sum(r * r for r in y)), 9), b) for b, y in data if y and any(y) and b != a)[:4]
            want += [(a, b, k + 1) for k, (_, b) in enumerate(scored)]
    for block in (3, 4096):
        got = search.match_many(q, df, 4, block=block).withColumn("similarity", F.round("similarity", 9))
        assert {(r.query_id, r.similarity) for r in got.collect()} and sorted((r.query_id, r.vec_id, r["rank"]) for r in got.collect()) == sorted(want)
    assert search.match_many(q.limit(0), df, 4).count() == 0


def test_the_best_of_each_page_is_of_all_rows_and_in_no_single_task(spark, sf):
    v = spark.createDataFrame([(i, [1.0, float(i)], i % 3) for i in range(50)] + [(50, [0.0, 0.0], 7)], "vec_id long, embedding array<float>, label int")
    assert search.match_chunks(v, [1.0, 0.0], -2.0, None).count() == 50
    plan = search_queries.f1_dedupe_best_per_page(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "TakeOrdered" not in plan and "SinglePartition" not in plan and "GlobalLimit" not in plan


def test_filters_reach_the_scan(spark, sf):
    d = search.by_category(spark.read.parquet(f"{sf}/part.parquet"), "p_brand", "Brand#2", ["p_name"], 3).select("p_name")
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(p_brand,Brand#2)" in plan and "p_retailprice" not in plan.split("ReadSchema")[1]


def test_inventory_and_duplicates(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(2,), (2,), (None,)], "k int")
    inv = {r.k: (r.in_a, r.in_b, r.n_b) for r in audit.inventory("k", a=a, b=b).collect()}
    assert inv == {1: (True, False, 0), 2: (True, True, 2), None: (False, True, 1)}
    assert rows(audit.duplicates(b.na.fill(7), [F.col("k")], "k")) == [(2, 2, 2, 2)]


def test_reachable(spark, tmp_path):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5)], "src int, dst int")
    start = spark.createDataFrame([(1, "a"), (4, "b")], "node int, source string")
    assert rows(crawl.reachable(edges, start, str(tmp_path))) == [(1, 0, ["a"]), (2, 1, ["a"]), (3, 2, ["a"]), (4, 0, ["a", "b"]), (5, 1, ["a", "b"])]
    assert rows(crawl.reachable(edges, start.filter("node = 1"), str(tmp_path), 2)) == [(1, 0, ["a"]), (2, 1, ["a"]), (3, 2, ["a"])]


def test_next_alive_goes_round(spark):
    m = spark.createDataFrame([("s", 0, True), ("s", 1, False), ("s", 2, False), ("s", 3, True)], "s string, pos int, alive boolean")
    found = ranking.next_alive(m, "s", F.col("pos"), F.lit(3), F.lit(4), F.col("alive"), 2)
    assert [(r.pos, r.wrapped) for r in found.orderBy("place").collect()] == [(0, True), (3, True)]


def test_tail_of_short_arrays(spark):
    df = spark.createDataFrame([([1, 2, 3],), ([],)], "a array<int>")
    assert [r.t for r in df.select(ranking.tail(F.col("a"), 2).alias("t")).collect()] == [[2, 3], []]


PAGE = """<!DOCTYPE html><html><head><title>Fire - Example Wiki</title><script>var p="</p><p>no";</script></head><body><nav><a href="/x">x</a></nav>
<div class="breadcrumb_boxed"><a>Home</a> <a>Rules</a> <a> Fire </a></div><div id="main"><div class="header">Fire <b>bolt</b></div><div class="body">
<div class="spalte1">Cost:</div><div class="spalte2">4 <i>AsP</i></div><div class="spalte1">Wirkung:</div><div>Burns &amp; hurts</div><div class="spalte1">Alone</div><div class="spalte1">Next:</div><div></div>
<div class="body_einzeln">Zaubererweiterungen</div><p>intro</p><p>#More</p><p>hotter</p><p>still</p><p># Far</p><div class="line_separator"></div><p>#Not this</p></div></div></body></html>"""


def test_page_records(spark):
    article = "<html><body><h1>Plain</h1><p>short<p>" + "long " * 10 + "<p>" + "more " * 10 + "</body></html>"
    nested = f'<html><body><h1>Outside</h1><div class="ce_text">{PAGE}</div></body></html>'
    df = spark.createDataFrame([(1, PAGE), (2, None), (3, ""), (4, article), (5, nested), (6, "<p><b><div")], "id int, html string")
    r = {x.id: x.r for x in df.select("id", pages.record(F.col("html"), "Example Wiki").alias("r")).collect()}
    assert r[1].name == "Fire bolt" and r[1].breadcrumbs == ["Home", "Rules", "Fire"] and r[1].subcategory == "Rules"
    assert [tuple(p) for p in r[1].properties] == [("Cost", "4 AsP"), ("Wirkung", "Burns & hurts")] and r[1].description == "Burns & hurts"
    assert [tuple(e) for e in r[1].extensions] == [("More", "hotter still"), ("Far", "")]
    assert r[2].name == "" and r[3].error is None and r[4].name == "Plain" and r[4].description == ("long " * 10).strip() + "\n\n" + ("more " * 10).strip()
    assert r[5].name == "Fire bolt" and len(r[5].properties) == 2


def test_page_classes(spark):
    text = "<p>" + "word " * 20 + "</p>"
    link = '<a href="/a">a</a>'
    found = {
        "content": text, "content with few links": text + link * 2, "hybrid": text + link * 3, "hub": link * 5, "properties": '<div class="body"><div class="spalte1">A</div></div>',
        "listing": "<select><option>[Alle]</option></select>" + text + link * 10, "filter": "<select><option>Tradition</option></select>", "filter with text": '<div class="filter"><select></select></div>' + text,
        "marked": "<h1>Name</h1>Kosten", "unmarked": "<h1>Name</h1>", "far links": text + '<a href="http://far/x">x</a>' * 9,
        # links outside the content count where it has none, but those that a crawl skips
        "skipped links": '<nav><a href="http://far/x">x</a><a href="mailto:a@b">m</a><a href="/kontakt.html">k</a></nav><div id="main">' + text + "</div>",
        "links elsewhere": f'<nav>{link * 3}</nav><div id="main">{text}</div>', "select": "<select><option>one</option></select>" + text,
    }
    df = spark.createDataFrame(list(found.items()), "name string, html string").select("name", pages.features(F.col("html"), "https://site/", ["kosten"]).alias("f"))
    got = {r.name: r.s for r in df.select("name", pages.page_class(F.col("f")).page_state.alias("s")).collect()}
    assert got == {"content": "content", "content with few links": "content", "hybrid": "hybrid", "hub": "crawl_only", "properties": "content", "listing": "crawl_only", "filter": "crawl_only", "filter with text": "hybrid", "marked": "content", "unmarked": "crawl_only", "far links": "content", "skipped links": "content", "links elsewhere": "hybrid", "select": "content"}


def test_links_of_a_page(spark):
    site = "https://h/"
    body = "<base href='https://h/sub/'><a href=\"a.html\">1</a><a class=x href='/b?x=ü&amp;y=1'>2</a><a href='#top'>3</a><a href='mailto:x'>4</a><a href='https://far/z'>5</a><a href='a.html'>6</a><!-- <a href='/no'> -->"
    df = spark.createDataFrame([(1, "https://h/page", body), (2, "https://h/dir/page", "<a href='c'>c</a>")], "id int, url string, html string")
    assert rows(crawl.resolved_links(df, "id", "html", "url", F.lit(site))) == [(1, "https://h/b?x=%C3%BC&y=1"), (1, "https://h/sub/a.html"), (2, "https://h/dir/c")]
    hubs = spark.createDataFrame([("https://h/hub",)], "url string")
    listed = spark.createDataFrame([("https://h/zauber/a%20b.html",), ("https://h/impressum-zauber",), ("https://far/zauber",), ("https://h/x",)], "url string")
    assert rows(crawl.seeds(hubs, listed, "url", "zauber/a b", site)) == [("https://h/hub",), ("https://h/zauber/a%20b.html",)]


def test_resolved_links_equal_urllib(spark, sf):
    found = {}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        site = re.match("[a-z]+://[^/?#]+", r.url)[0]
        for href in re.findall(r'<a[^>]+href="([^"]*)"', re.sub(r"(?s)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", "", r.html)):
            p = urlsplit(urljoin(r.url, href.replace("&amp;", "&")))
            full = urlunsplit((p.scheme, p.netloc, quote(p.path, safe="/%"), quote(p.query, safe="=&%+/:()-"), quote(p.fragment, safe="")))
            if full.startswith(site):
                found.setdefault(r.page_id, set()).add(full)
    got = {}
    for r in QUERIES["x9_resolved_links"](spark, sf).collect():
        got.setdefault(r.page_id, set()).add(r.target)
    assert got == found and found


def test_url_pieces(spark):
    df = spark.createDataFrame([("https://h/a b/ü.html?id=7&x=1", "../c")], "u string, l string")
    r = df.select(addresses.encoded(F.col("u")).alias("e"), addresses.absolute(F.col("u"), F.col("l")).alias("a"), html.item_id(F.col("u"), F.lit("n")).alias("i")).first()
    assert r.e == "https://h/a%20b/%C3%BC.html?id=7&x=1" and r.a == "https://h/c" and r.i == "7"
    urls = spark.createDataFrame([("https://h/Suche.html",), ("https://h/a/suche.html?x",), ("https://h/nosuche.html",), ("https://far/a",), ("https://h/index.html",), ("https://h/{{x}}",)], "u string")
    assert [(r.s, r.b) for r in urls.select(html.skipped(F.col("u"), "https://h/").alias("s"), html.broken(F.col("u")).alias("b")).collect()] == [(True, False), (True, False), (False, False), (True, False), (True, False), (False, True)]
    files = spark.createDataFrame([("https://h/zauber.html?zauber=A%20b",), ("https://h/a/b/",)], "u string").select(html.page_file(F.col("u")).alias("f"))
    assert [r.f for r in files.collect()] == ["zauber.html_zauber_A b.html", "a_b.html"]
    assert files.limit(1).select(html.url_of_file(F.col("f"), "https://h/").alias("u")).first().u == "https://h/zauber.html?zauber=A b"
    xml = '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> https://h/1 </loc></url><url><loc>https://h/1</loc></url></urlset>'
    assert spark.createDataFrame([(xml,)], "x string").select(html.sitemap_urls(F.col("x")).alias("l")).first().l == ["https://h/1"]


def test_final_category_by_address_words(spark):
    df = spark.createDataFrame([(1, "https://h/Z%C3%A4uber/feuer.html?a=1", "zauber feuer", ["kap"]), (2, "https://h/x", "", [])], "id int, url string, folded string, labels array<string>")
    none = F.array().cast("array<string>")
    got = categorize.final_category(df, "id", url=F.col("url"), folded_url=F.col("folded"), folded_crumbs=F.lit(""), labels=F.col("labels"), crawl_sources=none, provisional=F.lit(None).cast("string"), url_rules=[("magic", ["z[aä]uber/", "nothing"]), ("fire", ["^feuer"])], crumb_rules=[("magic", ["zauber"])], label_rules={"gods": ["kap"]})
    assert [(r.id, r.category, r.score, r.confidence, r.evidence) for r in got.orderBy("id").collect()] == [(1, "magic", 90, "medium", ["url_pattern"]), (2, "unresolved", 0, "none", [])]


def test_swap_is_all_or_nothing(spark, tmp_path):
    a, b = spark.range(3), spark.range(2).withColumnRenamed("id", "k")
    mutations.swap({"a": a, "b": b}, str(tmp_path))
    assert mutations.current(spark, str(tmp_path), "a").count() == 3
    with pytest.raises(Exception, match="boom"):
        mutations.swap({"a": spark.range(9), "b": b.select(F.raise_error(F.lit("boom")).alias("k"))}, str(tmp_path))
    assert mutations.current(spark, str(tmp_path), "a").count() == 3
    mutations.swap({"a": spark.range(4), "b": b}, str(tmp_path))
    assert mutations.current(spark, str(tmp_path), "a").count() == 4 and mutations.current(spark, str(tmp_path), "b").count() == 2


def test_distinct_pages_in_order(spark):
    found = spark.createDataFrame([("c1", "p1", "d1", 0.9), ("c2", "p1", "d2", 0.8), ("c3", "p3", "d2", 0.7), ("c4", None, "d1", 0.6), ("c5", None, None, 0.5), ("c6", None, None, 0.4)], "chunk_id string, page_id string, doc_id string, similarity double")
    assert [r.chunk_id for r in search.distinct_pages(found, 9).orderBy("chunk_id").collect()] == ["c1", "c3", "c5", "c6"]
    assert [r.chunk_id for r in search.distinct_pages(found, 1).collect()] == ["c1"]


def test_imports_fail_on_a_miss_and_replace(spark):
    docs = spark.createDataFrame([("d1", "u1", "T", "c", "body", False), ("d2", "u2", "", "", " x ", False)], "doc_id string, url string, title string, category string, embedding_text string, is_unresolved boolean").withColumns({c: F.lit(None).cast("string") for c in ("url_hash", "resolved_category", "page_state")})
    chunk = lambda d, i: (d, f"{d}_{i}", i, "t", "c", False, f"chunk {i}", 0, 1)
    schema = "doc_id string, chunk_id string, chunk_index int, title string, category string, is_unresolved boolean, chunk_text string, char_start int, char_end int"
    rows_ = spark.createDataFrame([chunk("d1", 0), chunk("d1", 1), chunk("d2", 0)], schema)
    now = F.lit("2024-01-01").cast("timestamp")
    empty_pages = imports.page_rows(docs, now).limit(0)
    out = imports.run_import(docs, rows_, (empty_pages, imports.chunk_rows(rows_, imports.page_rows(docs, now)).limit(0)), None, now)
    assert {(r.doc_id, r.title, r.category, r.normalized_content, r.canonical_slug) for r in out["rule_pages"].collect()} == {("d1", "T", "c", "body", "d1"), ("d2", "d2", "general", "x", "d2")}
    assert out["rule_chunks"].count() == 3
    with pytest.raises(Exception, match="missing page row"):
        imports.chunk_rows(spark.createDataFrame([chunk("d9", 0)], schema), imports.page_rows(docs, now)).collect()
    old = spark.createDataFrame([("T (part 1/2)", "u1", "old"), ("kept", "u", "k")], "title string, source_url string, content string")
    legacy = imports.run_import(docs, rows_, None, old, now)["rule_documents"]
    assert rows(legacy.select("title", "content")) == [("T (part 1/2)", "chunk 0"), ("T (part 2/2)", "chunk 1"), ("d2", "chunk 0"), ("kept", "k")]
    with pytest.raises(ValueError):
        imports.run_import(docs, rows_, None, None, now)


def test_sessions_refuse_and_change_nothing(spark):
    held = spark.createDataFrame([("s", "SETUP", ["a", "b"], 0, None), ("r", "RUNNING", ["c"], 0, ["x"])], "id string, state string, turn_order array<string>, current_turn_index int, combat_log array<string>")
    members = spark.createDataFrame([("a", "s", 0, False), ("b", "s", 0, False), ("c", "r", 0, True)], "id string, session_id string, initiative_roll int, is_active_turn boolean")
    asked = spark.createDataFrame([("s", ["b", "a"], {"a": 3, "b": 7}), ("r", ["c", "c"], {}), ("none", ["c", "c"], {})], "session_id string, turn_order array<string>, initiatives map<string,int>")
    step = sessions.start(held, members, asked)
    assert rows(step.refused.select("session_id", "reason")) == [("none", "session not found"), ("r", "not in setup")]
    assert rows(step.sessions.select("id", "state", "turn_order", "combat_log")) == [("r", "RUNNING", ["c"], ["x"]), ("s", "RUNNING", ["b", "a"], ["--- Combat Started! ---"])]
    assert rows(step.combatants.select("id", "initiative_roll", "is_active_turn")) == [("a", 3, False), ("b", 7, True), ("c", 0, True)]
    bad = sessions.turn(held, members, spark.createDataFrame([("s", "jump"), ("r", "start")], "session_id string, action string"))
    assert rows(bad.refused.select("session_id", "reason")) == [("r", "not in setup"), ("s", "invalid action")] and rows(bad.combatants) == rows(members)
    over = sessions.turn(held, members, spark.createDataFrame([("r", "end"), ("s", "start")], "session_id string, action string"))
    assert rows(over.sessions.select("id", "state")) == [("r", "ENDED"), ("s", "RUNNING")] and rows(over.combatants.select("id", "is_active_turn")) == [("a", True), ("b", False), ("c", False)]


def told(held, members, commands):
    """Sessions, members and answers after each session's commands, one by one, in plain Python."""
    held, members, answers = {k: dict(v) for k, v in held.items()}, {k: dict(v) for k, v in members.items()}, []
    for sid, seq, kind, order, rolls, reason in sorted(commands, key=lambda c: (c[0], c[1])):
        s, why = held.get(sid), None
        if kind == "start" and len(order or []) < 2:
            why = "fewer than two participants"
        elif s is None:
            why = "session not found"
        elif kind not in sessions.KINDS:
            why = "invalid action"
        elif kind in ("start", "turn_start") and s["state"] != "SETUP":
            why = "not in setup"
        elif kind == "turn_start" and not s["order"]:
            why = "no combatants in turn order"
        elif kind == "end" and s["state"] == "ENDED":
            why = "already ended"
        elif kind == "pause" and s["state"] != "RUNNING" or kind == "resume" and s["state"] != "PAUSED":
            why = {"pause": "not running", "resume": "not paused"}[kind]
        answers.append((sid, seq, kind, why))
        if why:
            continue
        own = [m for m in members.values() if m["session"] == sid]
        if kind == "start":
            s |= {"state": "RUNNING", "order": order, "at": 0, "log": s["log"] + ["--- Combat Started! ---"]}
            for m in own:
                m["roll"] = (rolls or {}).get(m["id"], m["roll"])
                m["active"] |= m["id"] == order[0]
        elif kind == "next":
            s["at"] = s["at"] or 0
            if s["order"]:
                for m in own:
                    if s["at"] < len(s["order"]) and m["id"] == s["order"][s["at"]]:
                        m["active"] = False
                s["at"] = (s["at"] + 1) % len(s["order"])
                for m in own:
                    m["active"] |= m["id"] == s["order"][s["at"]]
        elif kind == "turn_start":
            s |= {"state": "RUNNING", "at": 0}
            for m in own:
                m["active"] |= m["id"] == s["order"][0]
        elif kind in ("end", "turn_end"):
            s["state"] = "ENDED"
            for m in own:
                m["active"] = False
            if kind == "end":
                s["log"] = s["log"] + [f"--- Combat Ended: {reason} ---" if reason else "--- Combat Ended ---"]
        else:
            s["state"] = {"pause": "PAUSED", "resume": "RUNNING"}[kind]
    return held, members, answers


@pytest.mark.parametrize("block", [10_000, 4])
def test_commands_follow_one_another(spark, tmp_path, block):
    """A fold over many commands of each session equals running them one by one, also when
    a session's commands are folded in blocks."""
    rng = random.Random(block)
    held, members, commands = {}, {}, []
    for i in range(40):
        own = [f"{i}.{k}" for k in range(rng.randint(0, 4))]
        held[str(i)] = {"state": rng.choice(["SETUP", "SETUP", "RUNNING", "PAUSED", "ENDED"]), "order": own[: rng.randint(0, 4)], "at": rng.choice([None, 0, 1, 3]), "log": []}
        for m in own:
            members[m] = {"id": m, "session": str(i), "roll": 0, "active": rng.random() < 0.3}
        for seq in range(rng.randint(0, 15)):
            kind = rng.choice([*sessions.KINDS, "next", "start", "dance", None])
            commands.append((str(i) if rng.random() < 0.97 else "nowhere", seq + 100 * i, kind, rng.choice([own, own[::-1], None]), rng.choice([{m: rng.randint(1, 20) for m in own}, {}, None]), rng.choice([None, "", "fled"])))
    s = spark.createDataFrame([(k, v["state"], v["order"], v["at"], v["log"]) for k, v in held.items()], "id string, state string, turn_order array<string>, current_turn_index int, combat_log array<string>")
    m = spark.createDataFrame([(v["id"], v["session"], v["roll"], v["active"]) for v in members.values()], "id string, session_id string, initiative_roll int, is_active_turn boolean")
    c = spark.createDataFrame(commands, "session_id string, seq long, kind string, turn_order array<string>, initiatives map<string,int>, reason string").repartition(3)
    step = sessions.run(s, m, c, str(tmp_path), block)
    want = told(held, members, commands)
    assert {r.id: (r.state, r.turn_order, r.current_turn_index, r.combat_log) for r in step.sessions.collect()} == {k: (v["state"], v["order"], v["at"], v["log"]) for k, v in want[0].items()}
    assert {r.id: (r.initiative_roll, r.is_active_turn) for r in step.combatants.collect()} == {k: (v["roll"], v["active"]) for k, v in want[1].items()}
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, step.refused.collect())) == sorted(key(a) for a in want[2] if a[3])
    assert sorted(map(key, step.accepted.collect())) == sorted(key(a[:3]) for a in want[2] if not a[3])


def test_very_many_commands_of_a_session_need_no_folder(spark):
    """Commands are never gathered in one row, so none is too many."""
    held = spark.createDataFrame([("s", "SETUP", ["a", "b", "c"], None, ["x"])], "id string, state string, turn_order array<string>, current_turn_index int, combat_log array<string>")
    members = spark.createDataFrame([(m, "s", 0, False) for m in "abc"], "id string, session_id string, initiative_roll int, is_active_turn boolean")
    kind = F.when(F.col("id") == 5, "turn_start").when(F.col("id") % 100 == 99, "pause").otherwise("next")
    step = sessions.run(held, members, spark.range(12_000).select(F.lit("s").alias("session_id"), F.col("id").alias("seq"), kind.alias("kind")))
    nexts = sum(k % 100 != 99 for k in range(6, 12_000))
    assert rows(step.sessions.select("state", "current_turn_index")) == [("PAUSED", nexts % 3)]
    assert rows(step.combatants.filter("is_active_turn").select("id")) == [("abc"[nexts % 3],)]
    assert step.refused.count() == 119 and step.accepted.count() == 11_881


def test_sources(spark, tmp_path):
    schema = T.StructType([T.StructField("url", T.StringType())])
    assert readers.json_array(spark, str(tmp_path / "none.json"), schema).count() == 0
    (tmp_path / "spells.json").write_text(json.dumps([{"url": "a"}, {"url": "b"}]))
    (tmp_path / "spells_parse_errors.json").write_text(json.dumps([{"url": "c"}]))
    assert rows(readers.json_outputs(spark, str(tmp_path), schema)) == [("a", "spells"), ("b", "spells")]
    (tmp_path / "l.jsonl").write_text('{"url": "a"}\n\n{"url": "b"}\n')
    assert rows(readers.json_lines(spark, str(tmp_path / "l.jsonl"), schema)) == [("a",), ("b",)]
    (tmp_path / "cp").write_text(json.dumps({"completed": ["u"], "failed": {"v": "404"}, "pending": {"c": ["w", "x"]}}))
    t = readers.checkpoint_tables(spark, str(tmp_path / "cp"))
    assert rows(t["failed"]) == [("v", "404")] and rows(t["pending"]) == [("c", "w"), ("c", "x")]
    readers.write_json(readers.json_lines(spark, str(tmp_path / "l.jsonl"), schema), str(tmp_path / "out"), by=None)
    assert rows(readers.json_lines(spark, str(tmp_path / "out"), schema)) == [("a",), ("b",)]
    readers.write_json(spark.createDataFrame([("a", "x"), ("b", "y")], "url string, category string"), str(tmp_path / "by"), by="category")
    assert rows(spark.read.json(str(tmp_path / "by")).select("url", "category")) == [("a", "x"), ("b", "y")]
    for k in (1, 2):
        readers.append_run(spark.createDataFrame([(k,)], "n int"), str(tmp_path / "runs"), F.lit(f"2024-01-0{k}"))
    assert rows(spark.read.json(str(tmp_path / "runs")).select("n", "run_at")) == [(1, "2024-01-01"), (2, "2024-01-02")]
    (tmp_path / "p.md").write_text("# A\n\ntext")
    assert rows(readers.whole_files(spark, str(tmp_path / "*.md"))) == [("p.md", "# A\n\ntext")] and readers.whole_files(spark, str(tmp_path / "*.htm")).count() == 0
    spark.range(1).createOrReplaceTempView("seen_here")
    assert readers.has_function(spark, "sha2") and not readers.has_function(spark, "match_rule_chunks")
    assert ("seen_here", True) in rows(readers.catalogue(spark)) and len(schemas.TABLES) == 15 and readers.ready(spark)
    assert readers.table_or(spark, "no_such_table", spark.range(3)).count() == 3


def test_stream_equals_batch_over_a_restart(spark, tmp_path):
    """The second run goes on from the state that the first has left."""
    data = [(s, i, (i * 7 + s) % 4, (i * 5 + s) % 9) for s in range(5) for i in range(40 if s else 3)]
    schema = "session long, seq long, target int, damage int"
    whole = spark.createDataFrame(data, schema)
    batch = {r.session: tuple(r)[1:] for r in combat.fold(whole, 4, 30).collect()}
    last = {}

    def keep(df, _):
        last.update({r.session: tuple(r)[1:] for r in df.collect()})

    for k, (a, b) in enumerate(((0, 15), (15, 40))):
        whole.filter((F.col("seq") >= a) & (F.col("seq") < b)).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{k}"))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        q = fights.fights(stream, 4, 30).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert last == batch and any(v[2] == "ENDED" for v in batch.values())


def test_the_last_row_of_a_repeated_address_counts(spark):
    """A page index that names an address twice gives one row, of the last that should have
    a record."""
    index = spark.createDataFrame(
        [("u", "a", None, "a", "content", ["s"], "low", None, "p1", 0), ("u", "b", None, "b", "content", ["t"], "low", None, "p2", 1), ("u", "c", None, "c", "crawl_only", ["t"], "low", None, "p3", 2), ("v", "a", None, "a", "content", [], "low", None, "p4", 0), ("", "a", None, "a", "content", [], "low", None, "p5", 0)],
        "url string, category string, provisional_category string, resolved_category string, page_state string, crawl_sources array<string>, resolution_confidence string, resolution_evidence array<string>, filepath string, position int",
    )
    item = "struct<id:string,name:string,category:string,breadcrumbs:array<string>,subcategory:string,description:string,resolution_confidence:string,resolution_evidence:array<string>>"
    emitted = spark.createDataFrame([("u", "b", 0, ("1", "first", "b", [], None, "d", "x", [])), ("u", "b", 1, ("1", "second", "b", [], None, "d", "x", [])), ("w", "unresolved", 0, ("2", "n", "b", [], None, "d", "x", []))], f"url string, category string, file_order int, item {item}")
    done = spark.createDataFrame([("u",), ("u",), ("x",)], "url string")
    failed = spark.createDataFrame([("y", "http 404")], "url string, error string")
    found = {r.url: r for r in audit.url_inventory(index, emitted, done, failed, F.lit("r")).collect()}
    assert sorted(found) == ["u", "v", "w", "x", "y"]
    assert (found["u"].resolved_category, found["u"].raw_html_path, found["u"].title, found["u"].is_duplicate) == ("b", "p2", "first", True)
    assert (found["y"].http_status, found["y"].fetched, found["x"].fetched, found["x"].parsed) == (404, False, True, False)
    assert {(r.type, r.url) for r in audit.audit_details(index, emitted, done).collect()} == {("missing_from_json", "v"), ("orphan_json", "w"), ("completed_without_page_index", "x")}
    # of one category: the address's last row of that category, and unresolved records of its pages alone
    assert [r.filepath for r in audit.expected(index, ["a"]).orderBy("filepath").collect()] == ["p1", "p4"]
    assert audit.emitted_rows(emitted, index, ["c"]).count() == 0


def test_rows_are_dealt_by_group_over_tasks_that_grow_with_them(spark):
    rows = spark.range(40_000).withColumn("k", F.col("id") % 5_000)
    at = ranking.dealt(rows, "k", 2_000).withColumn("task", F.spark_partition_id())
    assert at.groupBy("task").count().agg(F.max("count")).first()[0] < 4_000
    assert at.groupBy("k").agg(F.countDistinct("task").alias("n")).filter("n > 1").isEmpty() and at.count() == 40_000


def test_targets_are_found_where_the_lines_were_dealt(spark, sf, capsys):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        QUERIES["c12_targets"](spark, sf).explain()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    plan = capsys.readouterr().out
    assert "SortMergeJoin" in plan and "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan
