"""Text expressions (I2-I8, I12-I18), all JVM-side."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from brindle.sources.schemas import FILE_CATEGORIES


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)


# The prefix and length of document ids.
def doc_id(c: Column) -> Column:
    """doc_ and the first 16 digits of the hash of a natural key."""
    return F.concat(F.lit("doc_"), F.left(sha256(c), F.lit(16)))


def slug(c: Column, default: str = "item") -> Column:
    """Lower case, other runs than a-z 0-9 as one hyphen, none at the ends."""
    body = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(body, F.lit("")), F.lit(default))


@cache
def _folds() -> dict[str, str]:
    """What is left in ASCII of each character's compatibility decomposition, where
    anything is; characters decompose one by one."""
    chars = (chr(c) for c in range(128, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)
    return {c: a for c in chars if (a := unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode())}


def ascii_folded(c: Column) -> Column:
    """Compatibility decomposition, ASCII only, lower case, runs of others as a space; a null
    text is ''.

    Characters that become one are translated at once; the few that become several are
    looked up in a table of all, and only in texts that have one."""
    one = {k: v for k, v in _folds().items() if len(v) == 1}
    several = {k: v for k, v in _folds().items() if len(v) > 1}
    text = F.translate(F.coalesce(c, F.lit("")), "".join(one), "".join(one.values()))
    table = "".join(f"\x01{k}{v}" for k, v in several.items()) + "\x01"
    # the table's entry of a character: from behind it to the next mark
    behind = lambda k: F.call_function("substring_index", F.lit(table), F.concat(F.lit("\x01"), k), F.lit(-1))
    entry = lambda k: F.substring_index(behind(k), "\x01", 1)
    marks = "[" + "".join(several) + "]"
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(marks), F.lit(0)))
    spread = F.when(text.rlike(marks), F.aggregate(found, text, lambda t, k: F.replace(t, k, entry(k)))).otherwise(text)
    plain = F.lower(F.regexp_replace(spread, r"[^\x00-\x7F]", ""))
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))


@cache
def _single_uppers() -> dict[str, str]:
    """Characters that Spark's upper makes several of, with the one that stands for each: its
    title case where that is one character, the capital sharp s, or else itself."""
    chars = (chr(c) for c in range(128, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)
    return {c: "\u1e9e" if c == "\xdf" else t if len(t := c.title()) == 1 else c for c in chars if len(c.upper()) > 1}


def upper(c: Column) -> Column:
    """Upper case character by character, as SQL's upper has it in DuckDB: every character
    stays one, so a sharp s becomes a capital sharp s and not SS.

    Only in texts that have a character that Spark's upper makes several of, it is kept apart."""
    table = _single_uppers()
    marks = "[" + "".join(table) + "]"
    pieces = F.split(c, f"(?<={marks})|(?={marks})")
    one = F.transform(pieces, lambda p: F.when(p.rlike(f"^{marks}$"), F.translate(p, "".join(table), "".join(table.values()))).otherwise(F.upper(p)))
    # no character becomes less than one
    return F.when(F.char_length(F.upper(c)) > F.char_length(c), F.array_join(one, "")).otherwise(F.upper(c))


def first_of(*cs: Column) -> Column:
    """The first value that is neither null nor blank."""
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in cs))


def sections(*parts: tuple[str, Column]) -> Column:
    """Labelled sections joined by an empty line; those without content are left out.
    A label of '' leaves the content bare."""
    lines = [F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{name}: " if name else ""), c)) for name, c in parts]
    return F.array_join(F.filter(F.array(*lines), lambda x: x.isNotNull()), "\n\n")


def flattened(pairs: Column) -> Column:
    """``key: value`` lines of an array<struct<k, v>>, blank values left out; '' of none."""
    lines = F.transform(F.filter(pairs, lambda p: F.trim(F.coalesce(p.v, F.lit(""))) != ""), lambda p: F.concat(p.k, F.lit(": "), p.v))
    return F.coalesce(F.array_join(lines, "\n"), F.lit(""))


def flattened_extensions(extensions: Column) -> Column:
    """``name: description`` lines of an array<struct<name, description>>, stripped of
    colons and spaces, empty ones left out (I7)."""
    lines = F.transform(extensions, lambda e: F.regexp_replace(F.concat(F.coalesce(e["name"], F.lit("")), F.lit(": "), F.coalesce(e.description, F.lit(""))), "^[: ]+|[: ]+$", ""))
    return F.coalesce(F.array_join(F.filter(lines, lambda x: x != ""), "\n"), F.lit(""))


# The labels of a document's sections.
def embedding_text(name: Column, category: Column, breadcrumbs: Column, subcategory: Column, properties: Column, description: Column, extensions: Column) -> Column:
    """The text that stands for a record (I6): seven labelled sections, empty ones left
    out; the last three start on a line of their own.  properties and extensions come
    flattened."""
    bare = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")
    line = lambda label, c: F.when(c != "", F.concat(F.lit(label), c))
    trail = F.when(F.size(breadcrumbs) > 0, F.concat(F.lit("Breadcrumbs: "), F.array_join(F.filter(breadcrumbs, lambda b: F.coalesce(b, F.lit("")) != ""), " > ")))
    parts = [line("Title: ", bare(name)), line("Category: ", bare(category)), trail, line("Subcategory: ", bare(subcategory)), line("Properties:\n", properties), line("Description:\n", bare(description)), line("Extensions:\n", extensions)]
    return bare(F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull()), "\n\n"))


# The banners of a fight's log.
def log_line(c: Column) -> Column:
    """A fight's log line in short (I16): turn and end banners by name, known banners,
    of others marks of bold dropped and spaces tidied."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")
    turn = F.regexp_extract(t, r"^---\s+(.+?)'s Turn\s+---$", 1)
    ended = F.regexp_extract(t, r"^---\s+Combat Ended:\s+(.+?)\s+---$", 1)
    tidy = F.regexp_replace(F.regexp_replace(t, r"\*\*", ""), r"\s+", " ")
    tidy = F.trim(F.regexp_replace(F.regexp_replace(tidy, r"\.\s+\|", " |"), r"\s+\|\s+", " | "))
    return F.when(turn != "", F.concat(F.lit("Turn: "), turn)).when(t == "--- Combat Started! ---", "Combat started").when(t == "--- Combat Resumed ---", "Combat resumed").when(ended != "", F.concat(F.lit("Combat ended: "), ended)).otherwise(tidy)


def level_bar(level: Column, most: int = 4) -> Column:
    """Filled and open circles of a condition's level."""
    n = F.least(F.greatest(F.coalesce(level, F.lit(0)), F.lit(0)), F.lit(most)).cast("int")
    return F.concat(F.repeat(F.lit("●"), n), F.repeat(F.lit("○"), F.lit(most) - n))


def source_url(markdown: Column) -> Column:
    """The address a markdown text names as its source; null without one."""
    return F.nullif(F.regexp_extract(markdown, r"\*Source: (https?://[^\s]+)", 1), F.lit(""))


def first_heading(markdown: Column, default: Column) -> Column:
    """The first heading of a markdown text, else ``default``."""
    return F.coalesce(F.nullif(F.regexp_extract(markdown, r"(?m)^#+ (.+)", 1), F.lit("")), default)


def embedding_input(c: Column, limit: int = 8000) -> Column:
    """What is sent to be embedded: newlines as spaces, at most ``limit`` characters."""
    return F.left(F.translate(c, "\n", " "), F.lit(limit))


def cut_at_word(c: Column, limit: int, share: float = 0.6) -> Column:
    """A text cut to ``limit`` characters, back to its last space if that keeps more
    than ``share`` of them, with an ellipsis."""
    head = F.left(c, F.lit(limit))
    last = F.lit(limit) - F.instr(F.reverse(head), " ")
    back = F.instr(head, " ") > 0
    return F.when(F.char_length(c) <= limit, c).otherwise(F.concat(F.when(back & (last > limit * share), F.left(head, last)).otherwise(head), F.lit("…")))


def cut_at(c: Column, limit: int, keep: int) -> Column:
    return F.when(F.char_length(c) > limit, F.concat(F.left(c, F.lit(keep)), F.lit("..."))).otherwise(c)


def status_code(c: Column) -> Column:
    """The first three-digit word of an error text."""
    return F.regexp_extract(c, r"\b(\d{3})\b", 1).try_cast("int")


def leading_int(c: Column) -> Column:
    """The integer a text starts with, after white space; null without one."""
    return F.regexp_extract(c, r"^\s*([+-]?\d+)", 1).try_cast("int")


def half_up(c: Column) -> Column:
    """Rounding halves towards positive infinity."""
    return F.floor(c + 0.5)


def bar(current: Column, most: Column, width: int, full: str = "#", empty: str = "-") -> Column:
    n = half_up(F.coalesce(F.try_divide(current.cast("double"), most.cast("double")), F.lit(0.0)) * width).cast("int")
    n = F.least(F.greatest(n, F.lit(0)), F.lit(width))
    return F.concat(F.repeat(F.lit(full), n), F.repeat(F.lit(empty), F.lit(width) - n))


def safe_name(c: Column, limit: int = 200) -> Column:
    """A file name: scheme dropped, characters not allowed as underscores, cut."""
    bare = F.regexp_replace(c, r"^[a-z]+://", "")
    return F.left(F.regexp_replace(bare, r"[^A-Za-z0-9._-]+", "_"), F.lit(limit))


_NOTATION = {
    "damage": r"(?i)^\s*(\d*)\s*[wd]\s*(\d+)\s*(?:(\+)\s*(\d+))?\s*$",
    "roll": r"(?i)^(\d*)[wd](\d+)(?:([+-])(\d+))?$",
    "effect": r"(?i)(\d*)w(\d+)(?:\s*([+-])\s*(\d+))?",
}


def dice(c: Column, dialect: str = "damage") -> Column:
    """struct<count, sides, bonus> of a dice notation as 2W6+3.

    damage: spaces allowed, a bonus is only added; blank is nothing (all 0), a plain
    number is a bonus alone.  roll: no spaces, a bonus of either sign.  effect: the first
    notation inside a text.  Others are null; a count of none or 0 is 1."""
    n = lambda g: F.regexp_extract(c, _NOTATION[dialect], g)
    count, bonus = F.coalesce(F.nullif(n(1).try_cast("int"), F.lit(0)), F.lit(1)), F.coalesce(n(4).try_cast("int"), F.lit(0))
    rolled = F.struct(count.alias("count"), n(2).try_cast("int").alias("sides"), F.when(n(3) == "-", -bonus).otherwise(bonus).alias("bonus"))
    found = F.when(n(2) != "", rolled)
    if dialect != "damage":
        return found
    fixed = lambda b: F.struct(F.lit(0).alias("count"), F.lit(0).alias("sides"), b.alias("bonus"))
    return F.when(F.trim(F.coalesce(c, F.lit(""))) == "", fixed(F.lit(0))).when(n(2) != "", rolled).when(c.rlike(r"^\s*\d+\s*$"), fixed(F.trim(c).try_cast("int")))


def file_category(name: Column) -> Column:
    """The category that a file's name stands for (I28): of the first word it has."""
    low, out = F.lower(name), F.lit(None).cast("string")
    for word, category in reversed(FILE_CATEGORIES):
        out = F.when(low.contains(word), category).otherwise(out)
    return F.coalesce(out, F.lit("general"))
