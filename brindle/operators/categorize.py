"""Evidence-scored categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brindle.functions import html

# Points of evidence, and the decision on them.
PROVISIONAL, URL_ONE, URL_MANY, CRUMB_ONE, CRUMB_MANY, PROPERTY, CRAWL = 100, 90, 45, 80, 35, 25, 10
LEAST, GAP, HIGH = 60, 10, 100


def pattern_votes(rows: DataFrame, key: str, text: Column, patterns: list[tuple[str, str]], one: int, many: int, reason: str) -> DataFrame:
    """(key, category, points, reason) for every pattern that matches.

    The patterns are an array of conditions on the row, so there is no join; a
    category that matches alone weighs more than one of several."""
    hits = F.filter(F.array(*(F.when(text.rlike(p), c) for c, p in patterns)), lambda x: x.isNotNull())
    found = rows.select(key, F.array_distinct(hits).alias("__hits"))
    points = F.when(F.size("__hits") == 1, one).otherwise(many)
    return found.select(key, points.alias("points"), F.explode("__hits").alias("category")).select(key, "category", "points", F.lit(reason).alias("reason"))


def overlap_votes(rows: DataFrame, key: str, keys: Column, labels: dict[str, list[str]], points: int = PROPERTY, reason: str = "properties") -> DataFrame:
    """A vote for each category that shares a label with the row's keys."""
    hits = F.filter(F.array(*(F.when(F.arrays_overlap(keys, F.array(*map(F.lit, v))), c) for c, v in labels.items())), lambda x: x.isNotNull())
    return rows.select(key, F.explode(hits).alias("category")).select(key, "category", F.lit(points).alias("points"), F.lit(reason).alias("reason"))


def url_votes(rows: DataFrame, key: str, url: Column, rules: list[tuple[str, list[str]]], folded: Column | None = None) -> DataFrame:
    """Votes of address patterns (D9): a category has several, each tried on the decoded
    address and on its folded form, where punctuation is a space."""
    forms = [html.decoded(url)] + ([folded] if folded is not None else [])
    patterns = [(category, "|".join(f"(?:{p})" for p in words)) for category, words in rules]
    text = F.concat_ws("\n", *forms)
    return pattern_votes(rows, key, text, [(c, f"(?m){p}") for c, p in patterns], URL_ONE, URL_MANY, "url_pattern").withColumn("reason", F.when(F.col("points") == URL_ONE, "url_pattern").otherwise("url_pattern_ambiguous"))


def crumb_votes(rows: DataFrame, key: str, folded: Column, tokens: list[tuple[str, list[str]]]) -> DataFrame:
    """Votes of words in the folded breadcrumbs and title."""
    hits = F.filter(F.array(*(F.when(F.exists(F.array(*map(F.lit, words)), lambda w: folded.contains(w)), c) for c, words in tokens)), lambda x: x.isNotNull())
    found = rows.select(key, hits.alias("__hits"))
    one = F.size("__hits") == 1
    return found.select(key, F.explode("__hits").alias("category"), F.when(one, CRUMB_ONE).otherwise(CRUMB_MANY).alias("points"), F.when(one, "breadcrumb").otherwise("breadcrumb_ambiguous").alias("reason"))


def final_category(rows: DataFrame, key: str, *, url: Column, folded_url: Column, folded_crumbs: Column, labels: Column, crawl_sources: Column, provisional: Column, url_rules: list[tuple[str, list[str]]], crumb_rules: list[tuple[str, list[str]]], label_rules: dict[str, list[str]]) -> DataFrame:
    """(key, category, score, confidence, evidence) of every row by all five kinds of
    evidence (X16): where it was expected, its address, its breadcrumbs, its labels and
    where the crawl came from.  The rules are data."""
    given = rows.filter(provisional.isNotNull() & (provisional != "")).select(key, provisional.alias("category"), F.lit(PROVISIONAL).alias("points"), F.lit("provisional_category").alias("reason"))
    crawled = rows.select(key, F.explode(crawl_sources).alias("category")).select(key, "category", F.lit(CRAWL).alias("points"), F.lit("crawl_source").alias("reason"))
    kinds = [given, url_votes(rows, key, url, url_rules, folded_url), crumb_votes(rows, key, folded_crumbs, crumb_rules), overlap_votes(rows, key, labels, label_rules), crawled]
    votes = None
    for order, part in enumerate(kinds):
        part = part.select(key, "category", "points", "reason").withColumn("kind", F.lit(order))
        votes = part if votes is None else votes.unionByName(part)
    return resolve(votes, key, rows.select(key).distinct())


def resolve(votes: DataFrame, key: str, keys: DataFrame | None = None, least: int = LEAST, gap: int = GAP, high: int = HIGH) -> DataFrame:
    """(key, category, score, confidence, evidence): the best category of each key.

    Below ``least`` points it is low, with a second within ``gap`` ambiguous; both
    leave the category unresolved.  Ties go to the first name.  evidence has the
    reasons of the best, by kind.  With ``keys``, those without a vote are "none"."""
    kind = "kind" if "kind" in votes.columns else "reason"
    reasons = F.array_sort(F.collect_list(F.struct(F.col(kind).alias("kind"), "reason")))
    scores = votes.groupBy(key, "category").agg(F.sum("points").alias("score"), F.transform(reasons, lambda r: r.reason).alias("evidence"))
    by = W.partitionBy(key).orderBy(F.desc("score"), "category")
    top = scores.withColumn("rank", F.row_number().over(by)).withColumn("second", F.lead("score").over(by)).filter("rank = 1")
    confidence = F.when(F.col("score") < least, "low").when(F.coalesce(F.col("second") >= F.col("score") - gap, F.lit(False)), "ambiguous").when(F.col("score") >= high, "high").otherwise("medium")
    best = top.select(key, F.when(confidence.isin("high", "medium"), F.col("category")).otherwise("unresolved").alias("category"), "score", confidence.alias("confidence"), "evidence")
    if keys is None:
        return best
    none = F.array().cast("array<string>")
    return keys.join(best, key, "left").select(key, F.coalesce("category", F.lit("unresolved")).alias("category"), F.coalesce("score", F.lit(0)).alias("score"), F.coalesce("confidence", F.lit("none")).alias("confidence"), F.coalesce("evidence", none).alias("evidence"))


def keyword_category(url: Column, rules: list[tuple[str, list[str]]], default: str) -> Column:
    """The first rule one of whose words is in the URL."""
    out, low = None, F.lower(url)
    for category, words in rules:
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        out = F.when(hit, category) if out is None else out.when(hit, category)
    return out.otherwise(default)
