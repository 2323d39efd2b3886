"""Native span search: positions of regular-expression matches as columns.

Spark can extract the matches of a pattern and split a text at them, but has no
function for their positions.  Both results come from the same leftmost scan, so
the running sum of the lengths of pieces and matches gives every start and end.
All offsets are code points, ends exclusive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements folded by one inner fold of prefixes; code points of a piece of a text.
#: Only a matter of speed.
BLOCK, PIECE = 128, 512


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def prefixes(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """combine() of the first i values (at least 0) for every i, block by block.

    Appending in a fold copies the result so far; two levels keep that cost
    near-linear for texts with very many matches.
    """
    empty = F.array().cast("array<int>")

    def running(xs: Column) -> Column:
        start = F.struct(F.lit(0).alias("last"), empty.alias("out"))
        step = lambda a, x: let(combine(a["last"], x), lambda y: F.struct(y.alias("last"), F.array_append(a.out, y).alias("out")))
        return F.aggregate(xs, start, step, lambda a: a.out)

    def blocks_of(xs: Column) -> Column:
        count = F.ceil(F.size(xs) / F.lit(BLOCK)).cast("int")
        return F.transform(F.sequence(F.lit(0), count - 1), lambda b: running(F.slice(xs, b * BLOCK + 1, BLOCK)))

    def joined(blocks: Column) -> Column:
        totals = running(F.transform(blocks, lambda b: F.element_at(b, -1)))
        return let(totals, lambda t: F.flatten(F.transform(blocks, lambda b, i: F.transform(b, lambda x: combine(F.when(i > 0, F.get(t, i - 1)).otherwise(0), x)))))

    return let(values, lambda xs: F.when(F.size(xs) == 0, empty).otherwise(let(blocks_of(xs), joined)))


def prefix_sums(values: Column) -> Column:
    """Inclusive running sums of an array<int>."""
    return prefixes(values, lambda a, x: a + x)


def prefix_max(values: Column) -> Column:
    """Inclusive running maxima of an array<int>, at least 0."""
    return prefixes(values, lambda a, x: F.greatest(a, x))


def matches(text: Column, pattern: str, context: int = 0) -> Column:
    """array<struct<start int, end int, match string, before string, after string>>
    of the leftmost non-overlapping matches of ``pattern`` (never an empty match).

    before and after hold up to ``context`` code points between a match and its
    neighbours.  A null text gives an empty array.
    """
    none = F.array().cast("array<struct<start:int,end:int,match:string,before:string,after:string>>")

    def placed(found: Column) -> Column:
        def rows(pieces: Column) -> Column:
            widths = F.transform(found, lambda m, i: F.char_length(F.get(pieces, i)) + F.char_length(m))
            around = (lambda c: c) if context else (lambda c: F.lit(""))
            return let(
                prefix_sums(widths),
                lambda ends: F.transform(
                    found,
                    lambda m, i: F.struct(
                        (F.get(ends, i) - F.char_length(m)).alias("start"),
                        F.get(ends, i).alias("end"),
                        m.alias("match"),
                        around(F.right(F.get(pieces, i), F.lit(context))).alias("before"),
                        around(F.left(F.get(pieces, i + 1), F.lit(context))).alias("after"),
                    ),
                ),
            )

        return F.when(F.size(found) > 0, let(F.split(text, pattern, -1), rows)).otherwise(none)

    return F.coalesce(let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed), none)


def listed(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined in the given order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets, as [EMAIL].

    Overlapping spans are covered by the first of them and vanish as a whole.
    A null text stays null.  Spark finds a place in a text by counting from its
    start; here it is counted from the start of a piece of PIECE code points, so
    the cost is linear in the text and in the number of spans.
    """
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s.start.alias("start"), (-s.end).alias("rev"), s.kind.alias("kind"))))
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))

    def between(cut: Column, a: Column, b: Column) -> Column:
        """Code points a to b (exclusive) of the text."""
        low, high = F.floor(a / PIECE).cast("int"), F.ceil(b / PIECE).cast("int")
        return F.when(b > a, F.substr(F.array_join(F.slice(cut, low + 1, high - low), ""), a - low * PIECE + 1, b - a)).otherwise("")

    def written(rows: Column, cut: Column, ends: Column) -> Column:
        before = lambda i: F.when(i > 0, F.get(ends, i - 1)).otherwise(0)
        part = lambda r, i: let(before(i), lambda at: F.when(r.start >= at, F.concat(between(cut, at, r.start), F.lit("["), F.upper(r.kind), F.lit("]"))).otherwise(""))
        last = F.element_at(ends, -1)
        return F.concat(F.array_join(F.transform(rows, part), ""), between(cut, last, F.greatest(last, F.char_length(text))))

    def done(rows: Column) -> Column:
        return let(pieces, lambda cut: let(prefix_max(F.transform(rows, lambda r: -r.rev)), lambda ends: written(rows, cut, ends)))

    return F.when(F.size(spans) > 0, let(ordered, done)).otherwise(text)
