from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from brindle.functions import rules, text


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("roll", "confirm", "skill", "outcome"),
    [(1, 10, 12, "critical"), (1, 13, 12, "hit"), (20, 13, 12, "botch"), (20, 12, 12, "miss"), (12, 1, 12, "hit"), (13, 1, 12, "miss")],
)
def test_attack(spark, roll, confirm, skill, outcome):
    assert value(spark, rules.attack(F.lit(roll), F.lit(confirm), F.lit(skill))) == outcome


@pytest.mark.parametrize(("damage", "armour", "left"), [(5, 2, 3), (1, 2, 1), (2, 4, 1), (3, 4, 0), (4, 4, 0), (0, 4, 0), (5, -2, 7)])
def test_soak(spark, damage, armour, left):
    assert value(spark, rules.soak(F.lit(damage), F.lit(armour))) == left


@pytest.mark.parametrize(("now", "most", "level"), [(5, 100, 4), (25, 100, 3), (26, 100, 2), (50, 100, 2), (75, 100, 1), (76, 100, 0), (3, 0, 0), (None, 30, 0)])
def test_pain(spark, now, most, level):
    assert value(spark, rules.pain(F.lit(now).cast("int"), F.lit(most))) == level


@pytest.mark.parametrize(("rolls", "attributes", "skill", "expected"), [((10, 10, 10), (12, 12, 12), 7, (7, True, 3)), ((14, 10, 10), (12, 12, 12), 1, (-1, False, 0)), ((8, 9, 8), (0, 8, None), 4, (3, True, 1)), ((1, 1, 1), (8, 8, 8), 40, (40, True, 6))])
def test_probe(spark, rolls, attributes, skill, expected):
    r = value(spark, rules.probe([F.lit(x) for x in rolls], [F.lit(x).cast("int") for x in attributes], F.lit(skill)))
    assert tuple(r) == expected


def test_regenerate_never_exceeds(spark):
    assert value(spark, rules.regenerate(F.lit(28), F.lit(30), F.lit(6), F.lit(1))) == 30
    assert value(spark, rules.regenerate(F.lit(10), F.lit(30), F.lit(1), F.lit(-4))) == 10
    assert value(spark, rules.regenerate(F.lit(0), F.lit(0), F.lit(6), F.lit(1))) == 0


@pytest.mark.parametrize(("note", "expected"), [("2W6+3", (2, 6, 3)), ("w20", (1, 20, 0)), ("3d6 + 1", (3, 6, 1)), ("", (0, 0, 0)), (None, (0, 0, 0)), ("7", (0, 0, 7)), ("fist", None), ("2w6-1", None)])
def test_dice(spark, note, expected):
    d = value(spark, text.dice(F.lit(note).cast("string")))
    assert (tuple(d) if d else None) == expected


def test_text_kernels(spark):
    assert value(spark, text.half_up(F.lit(-2.5))) == -2
    assert value(spark, text.leading_int(F.lit(" 12abc"))) == 12
    assert value(spark, text.leading_int(F.lit("abc"))) is None
    assert value(spark, text.status_code(F.lit("http_404"))) is None
    assert value(spark, text.status_code(F.lit("status 503 again"))) == 503
    assert value(spark, text.slug(F.lit("  Ärger & Co. "))) == "rger-co"
    assert value(spark, text.slug(F.lit("!!"))) == "item"
    assert value(spark, text.ascii_folded(F.lit("Größe  É–1"))) == "groe e1"
    assert value(spark, text.cut_at_word(F.lit("aaaa bbbb cccc"), 11)) == "aaaa bbbb…"
    assert value(spark, text.cut_at_word(F.lit("a bbbbbbbbbbbbb"), 11)) == "a bbbbbbbbb…"
