"""Secret scan: fixed patterns, and strings that pass a battery of randomness tests.

Built of SQL functions only.  Beyond the patterns, every maximal run of token
characters is a candidate.  Its encoding is inferred from its characters; the run
must then look uniform on that alphabet in three tests (chi-squared of the symbol
counts, Wald-Wolfowitz runs about the middle symbol, lag-1 serial correlation).
How unlike words it is enters as the likelihood ratio of the uniform model to a
model of word characters, whose shares are counted over the whole table (but never
below LEAST, which allows for identifiers).  Such a ratio is an e-value; it is divided
by what the three tests say against randomness, an e-value too where it is above 1, and
so stays one.  The e-value form of Benjamini-Hochberg, weighted by length, bounds the
share of false discoveries among a text's candidates.

Edge cases: a null or empty text has no spans; repeated rows give repeated
results; an empty table gives an empty table; other columns pass untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.spans import let, listed, masked, matches

# The patterns of the base kinds and the class of token characters.
ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]++"""
ASSIGN_HEAD = r"""^(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?"""
ACCESS = r"AKIA[A-Z0-9]++"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "random")

# The alphabets of the encodings, in the order of inference.
ALPHABETS = {
    "hex": ("^[0-9a-f]+$|^[0-9A-F]+$", "0123456789abcdef"),
    "base32": ("^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    "base64": ("^[A-Za-z0-9+/]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
}
#: Character classes of words with their number of characters, and least shares.
CLASSES = {"[a-z]": 26, "[A-Z]": 26, "[0-9]": 10, "[+/]": 2}
LEAST = {"[a-z]": 0.5, "[A-Z]": 0.08, "[0-9]": 0.05, "[+/]": 0.02}
#: Shares assumed where no table is given.
WORD_MODEL = {"[a-z]": 0.85, "[A-Z]": 0.08, "[0-9]": 0.05, "[+/]": 0.02}


def word_model(df: DataFrame, text: str = "text") -> dict[str, float]:
    """Shares of the character classes among the token characters of all texts, each
    at least LEAST; four numbers reach the driver."""
    names = list(CLASSES)
    row = df.agg(*(F.sum(F.regexp_count(text, F.lit(c))).alias(f"n{i}") for i, c in enumerate(names))).first()
    counts = [row[f"n{i}"] or 0 for i in range(len(names))]
    if not sum(counts):
        return WORD_MODEL
    shares = {c: max(n / sum(counts), LEAST[c]) for c, n in zip(names, counts, strict=True)}
    return {c: s / sum(shares.values()) for c, s in shares.items()}


def _tail(z: Column) -> Column:
    """Upper tail of the standard normal distribution, to about 1e-4."""
    bounded = F.least(F.greatest(z, F.lit(-8.0)), F.lit(8.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(bounded * 1.5976 + F.pow(bounded, F.lit(3)) * 0.070565956))


def _chi_squared(code: Column, alphabet: str) -> Column:
    """p-value of the symbol counts against the uniform distribution."""
    size, free = len(alphabet), len(alphabet) - 1
    n = F.char_length(code)
    count = lambda ch: n - F.char_length(F.replace(code, ch, F.lit("")))
    squares = F.aggregate(F.array(*map(F.lit, alphabet)), F.lit(0.0), lambda a, ch: let(count(ch).cast("double"), lambda k: a + k * k))
    chi = squares * size / n - n
    spread = 2 / (9 * free)
    return _tail((F.pow(F.greatest(chi, F.lit(0.0)) / free, F.lit(1 / 3)) - (1 - spread)) / spread**0.5)


def _order_tests(code: Column, alphabet: str) -> Column:
    """The lesser p-value of the runs test and of the lag-1 serial correlation."""
    values = F.transform(F.filter(F.split(code, ""), lambda ch: ch != ""), lambda ch: (F.call_function("instr", F.lit(alphabet), ch) - 1).cast("double"))
    middle = (len(alphabet) - 1) / 2
    zero = F.struct(F.lit(None).cast("double").alias("last"), *(F.lit(0.0).alias(k) for k in ("n", "high", "runs", "s", "ss", "lag")))

    def step(a: Column, x: Column) -> Column:
        d = x - middle
        return F.struct(
            d.alias("last"),
            (a.n + 1).alias("n"),
            (a.high + F.when(d > 0, 1.0).otherwise(0.0)).alias("high"),
            (a.runs + F.when(a["last"].isNull() | ((a["last"] > 0) != (d > 0)), 1.0).otherwise(0.0)).alias("runs"),
            (a.s + d).alias("s"),
            (a.ss + d * d).alias("ss"),
            (a.lag + F.coalesce(a["last"] * d, F.lit(0.0))).alias("lag"),
        )

    def verdict(a: Column) -> Column:
        low = a.n - a.high
        mean = a.high * low * 2 / a.n + 1
        var = (mean - 1) * (mean - 2) / (a.n - 1)
        runs = F.when(var > 0, _tail(F.abs(a.runs - mean) / F.sqrt(var)) * 2).otherwise(0.0)
        about = a.ss - a.s * a.s / a.n
        serial = F.when(about > 0, _tail(F.abs(a.lag - a.s * a.s / a.n) / about * F.sqrt(a.n)) * 2).otherwise(0.0)
        return F.least(runs, serial)

    return F.aggregate(values, zero, step, verdict)


def _log_e(code: Column, alphabet: str, model: dict[str, float]) -> Column:
    """log likelihood ratio of a uniform code to the characters of words."""
    of = lambda cls, q: (F.char_length(code) - F.char_length(F.regexp_replace(code, cls, ""))) * F.log(F.lit(1 / len(alphabet) / q))
    return sum((of(cls, share / CLASSES[cls]) for cls, share in model.items()), F.lit(0.0))


def _against(p: Column) -> Column:
    """log of the e-value 1 / (2 sqrt(p)) against randomness, at least 0."""
    return F.greatest(F.lit(0.0), -F.log(2 * F.sqrt(F.greatest(p, F.lit(1e-12)))))


def random_spans(text: Column, level: float = 0.001, rate: float = 0.01, model: dict[str, float] = WORD_MODEL) -> Column:
    """array<struct<start, end, encoding, p, log_e>> of the runs that pass the battery.

    level: a run goes when the Bonferroni p-value of the three tests is below it.
    rate: bound on the expected share of false discoveries in a text.
    """

    def judged(s: Column) -> Column:
        plain = F.translate(F.regexp_replace(s.match, "=++$", ""), "-_", "+/")

        def row(name: str, alphabet: str, code: Column) -> Column:
            as_is = F.lower(code) if name == "hex" else code
            p = F.least(F.lit(1.0), 3 * F.least(_chi_squared(as_is, alphabet), _order_tests(as_is, alphabet)))
            evidence = lambda q: (_log_e(code, alphabet, model) - _against(q)).alias("log_e")
            return let(p, lambda q: F.struct(s.start.alias("start"), s.end.alias("end"), F.lit(name).alias("encoding"), q.alias("p"), evidence(q)))

        def by_encoding(code: Column) -> Column:
            out = None
            for name, (shape, alphabet) in ALPHABETS.items():
                hit = code.rlike(shape) & code.rlike("[0-9]") & code.rlike("[A-Za-z]") & (F.char_length(code) >= 20)
                out = F.when(hit, row(name, alphabet, code)) if out is None else out.when(hit, row(name, alphabet, code))
            return out

        return let(plain, by_encoding)

    def discoveries(rows: Column) -> Column:
        k = F.size(rows)
        total = F.aggregate(rows, F.lit(0.0), lambda a, r: a + (r.end - r.start))
        weighted = lambda t: F.transform(rows, lambda r: F.struct((-(r.log_e + F.log((r.end - r.start) * k / t))).alias("rank"), r.alias("row")))
        ordered = F.array_sort(let(total, weighted))

        def kept(o: Column) -> Column:
            passing = F.filter(F.transform(o, lambda r, i: F.when(-r["rank"] >= F.log(k / ((i + 1) * rate)), i + 1).otherwise(0)), lambda i: i > 0)
            return F.transform(F.slice(o, 1, F.coalesce(F.array_max(passing), F.lit(0))), lambda r: r["row"])

        return let(ordered, kept)

    candidates = F.filter(F.transform(matches(text, RUN), judged), lambda r: r.isNotNull())
    return let(F.filter(candidates, lambda r: r.p >= level), discoveries)


def secret_spans(text: Column, model: dict[str, float] = WORD_MODEL) -> Column:
    """array<struct<start, rank, end, kind, encoding, log_e>>, by start, then kind.

    Random runs that overlap a base span are left out: the base span stands for them.
    """
    plain = lambda kind, rows: F.transform(rows, lambda s: F.struct(s.start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), s.end.alias("end"), F.lit(kind).alias("kind"), F.lit("").alias("encoding"), F.lit(0.0).alias("log_e")))
    base = F.concat(
        plain("assign", F.filter(matches(text, ASSIGN), lambda s: F.char_length(F.regexp_replace(s.match, ASSIGN_HEAD, "")) >= 6)),
        plain("access", F.filter(matches(text, ACCESS), lambda s: F.char_length(s.match) >= 20)),
        plain("hex", matches(text, HEX)),
    )

    def added(b: Column) -> Column:
        fresh = F.filter(random_spans(text, model=model), lambda r: ~F.exists(b, lambda s: (s.start < r.end) & (s.end > r.start)))
        more = F.transform(fresh, lambda r: F.struct(r.start.alias("start"), F.lit(KINDS.index("random")).alias("rank"), r.end.alias("end"), F.lit("random").alias("kind"), r.encoding.alias("encoding"), r.log_e.alias("log_e")))
        return F.array_sort(F.concat(b, more))

    return let(base, added)


def with_secrets(df: DataFrame, text: str = "text", into: str = "secrets", model: dict[str, float] = WORD_MODEL) -> DataFrame:
    """Adds the spans of ``text`` as column ``into``, replacing one of that name."""
    return df.withColumn(into, secret_spans(F.col(text), model))


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """Replaces every secret of ``text`` by its kind in brackets; keeps all rows."""
    return df.withColumn(text, let(secret_spans(F.col(text)), lambda s: masked(F.col(text), s)))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All secrets of every document, digested."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = with_secrets(docs, model=word_model(docs)).select("doc_id", "secrets")
    count = lambda k: F.size(F.filter("secrets", lambda s: s.kind == k)).cast("long").alias(f"n_{k}")
    base = F.filter("secrets", lambda s: s.kind.isin(*BASE))
    return found.select("doc_id", *(count(k) for k in BASE), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"))
