"""PII: patterns propose spans, checksums confirm them, context words set the score.

A span's score starts from its kind and is raised or lowered by words within CONTEXT
code points on either side.  Spans of the base kinds always stay; those of the kinds
added stay from a score of MIN_SCORE on, so an account number beside a word such as
"order" or "version" needs a word such as "bank" or "iban" beside it too.

Built of SQL functions only.  Every pattern is written with possessive runs that
start at the beginning of a run, so that a scan stays linear on very long texts
without separators.

Edge cases: a null or empty text has no spans; repeated rows give repeated
results; an empty table gives an empty table; other columns pass untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.spans import let, listed, masked, matches

# The patterns of the kinds.  \G lets a match begin where the last
# one ended; elsewhere a match can only begin at the start of a run.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Countries by the length of their account numbers (ISO 13616).
ACCOUNTS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS",
    23: "AE GI IL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL",
    29: "BR PS QA UA", 30: "JO KW MU", 31: "MT",
}
IBAN = "(?<![A-Za-z0-9])(?=[A-Z]{2}[0-9]{2})(?:" + "|".join(rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, c in ACCOUNTS.items()) + ")(?![A-Za-z0-9])"
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"

# Start score of each kind, words nearby that raise or lower it.
START = {"email": 0.8, "ip": 0.5, "card": 0.7, "phone": 0.5, "iban": 0.8}
RAISE = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|kontakt|courriel|correo)\b",
    "ip": r"(?i)\b(?:ip|address|host|server|client|adresse)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta)\b",
    "phone": r"(?i)\b(?:phone|call|tel|fax|mobile|telefon|telefono)\b",
    "iban": r"(?i)\b(?:iban|account|bank|konto|compte|cuenta)\b",
}
LOWER = r"(?i)\b(?:version|order|isbn|sku|build|release|example)\b"
#: Code points on either side in which context words count; least score of the kinds
#: beyond BASE.
CONTEXT, MIN_SCORE = 40, 0.7


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    return let(F.regexp_replace(m, r"[\x20-]", ""), lambda d: F.char_length(d).between(13, 19) & F.call_function("luhn_check", d))


def mod97(code: Column) -> Column:
    """The remainder that a valid account number leaves at 1: four characters
    move to the end, letters count from ten, the number is taken mod 97."""
    turned = F.concat(F.substr(code, F.lit(5)), F.left(code, F.lit(4)))
    value = lambda ch: F.when(ch.rlike("[0-9]"), ch.cast("int")).otherwise(F.ascii(ch) - 55)
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, ch: F.when(ch == "", a).otherwise(let(value(ch), lambda v: (a * F.when(v < 10, 10).otherwise(100) + v) % 97)))


def _iban(m: Column) -> Column:
    return mod97(F.regexp_replace(m, " ", "")) == 1


#: kind -> (pattern, confirmation of a match), in the order of the results.
KINDS = {
    "email": (EMAIL, lambda m: F.lit(True)),
    "ip": (IP, lambda m: m.rlike(rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$")),
    "card": (CARD, _luhn),
    "phone": (PHONE, lambda m: F.char_length(_digits(m)).between(9, 15)),
    "iban": (IBAN, _iban),
}
BASE = ("email", "ip", "card", "phone")


def _score(kind: str, s: Column) -> Column:
    around = F.concat(s.before, F.lit(" "), s.after)
    raised = F.when(around.rlike(RAISE[kind]), 0.2).otherwise(0.0)
    return F.round(F.lit(START[kind]) + raised - F.when(around.rlike(LOWER), 0.2).otherwise(0.0), 2)


def pii_spans(text: Column, min_score: float = MIN_SCORE) -> Column:
    """array<struct<kind, start, end, score>> of the confirmed spans, kind by kind.

    Spans of one kind never overlap; spans of several kinds may.  min_score only
    holds for kinds beyond BASE, whose spans always stay.
    """

    def of(kind: str) -> Column:
        pattern, confirmed = KINDS[kind]
        found = F.filter(matches(text, pattern, CONTEXT), lambda s: confirmed(s.match))
        rows = F.transform(found, lambda s: F.struct(F.lit(kind).alias("kind"), s.start.alias("start"), s.end.alias("end"), _score(kind, s).alias("score")))
        return rows if kind in BASE else F.filter(rows, lambda s: s.score >= min_score)

    return F.concat(*(of(k) for k in KINDS))


def with_pii(df: DataFrame, text: str = "text", into: str = "pii") -> DataFrame:
    """Adds the spans of ``text`` as column ``into``, replacing one of that name."""
    return df.withColumn(into, pii_spans(F.col(text)))


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """Replaces every span of ``text`` by its kind, as [PHONE]; keeps all rows."""
    return df.withColumn(text, let(pii_spans(F.col(text)), lambda s: masked(F.col(text), s)))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All personal data of every document, digested."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = with_pii(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))).select("doc_id", "pii")
    count = lambda k: F.size(F.filter("pii", lambda s: s.kind == k)).cast("long").alias(f"n_{k}")
    base = F.filter("pii", lambda s: s.kind.isin(*BASE))
    scores = F.array_join(F.transform("pii", lambda s: s.score.cast("string")), ",")
    return found.select("doc_id", *(count(k) for k in BASE), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("pii")).alias("spans"), scores.alias("scores"))
