"""Rule kernels as column expressions (R1-R10, E8-E10).  Dice are input columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Outcomes of an attack.
CRITICAL, HIT, MISS, BOTCH = "critical", "hit", "miss", "botch"


def attack(roll: Column, confirm: Column, value: Column) -> Column:
    """A 1 is confirmed to a critical hit, a 20 to a botch; else roll under value."""
    return (
        F.when(roll == 1, F.when(confirm <= value, CRITICAL).otherwise(HIT))
        .when(roll == 20, F.when(confirm > value, BOTCH).otherwise(MISS))
        .otherwise(F.when(roll <= value, HIT).otherwise(MISS))
    )


def defence(roll: Column, value: Column) -> Column:
    return roll <= F.coalesce(value, F.lit(0))


def soak(damage: Column, armour: Column) -> Column:
    """Damage after armour; small hits up to half the armour still do 1, those
    between half and all of it do none."""
    return F.when((damage > 0) & (damage <= F.floor(armour / 2)), 1).otherwise(F.greatest(damage - armour, F.lit(0)))


def pain(current: Column, most: Column) -> Column:
    """Level 0 to 4 by what share of life is left; 5 points or less are always 4."""
    valid = current.isNotNull() & most.isNotNull() & (most > 0)
    return F.when(~valid, 0).when(current <= 5, 4).when(current <= most * 0.25, 3).when(current <= most * 0.5, 2).when(current <= most * 0.75, 1).otherwise(0)


def probe(rolls: list[Column], attributes: list[Column], skill: Column) -> Column:
    """struct<rest, success, quality>: what three rolls exceed their attributes by is
    paid from the skill; an attribute of 0 or null counts as 8."""
    over = sum((F.greatest(r - F.coalesce(F.nullif(a, F.lit(0)), F.lit(8)), F.lit(0)) for r, a in zip(rolls, attributes, strict=True)), F.lit(0))
    rest = skill - over
    quality = F.when(rest < 0, 0).otherwise(F.least(F.greatest(F.ceil(rest / 3), F.lit(1)), F.lit(6)))
    return F.struct(rest.alias("rest"), (rest >= 0).alias("success"), quality.cast("int").alias("quality"))


def regenerate(current: Column, most: Column, roll: Column, modifier: Column) -> Column:
    """Current value after a night: up to the maximum, never a loss; none without one."""
    return F.when(most > 0, F.least(most, current + F.greatest(roll + modifier, F.lit(0)))).otherwise(current)


def botch_damage(damage: Column) -> Column:
    """What a botch does to oneself: half, at least 1."""
    return F.greatest(F.floor(damage / 2), F.lit(1))


def combat_damage(outcome: Column, dice_sum: Column, bonus: Column) -> Column:
    """A critical hit doubles the dice before the bonus; a miss does nothing."""
    return F.when(outcome == CRITICAL, dice_sum * 2 + bonus).when(outcome == HIT, dice_sum + bonus).when(outcome == BOTCH, botch_damage(dice_sum + bonus)).otherwise(0)


def band(part: Column, whole: Column) -> Column:
    """low, middle or high share of a sum."""
    share = F.try_divide(part, whole)
    return F.when(share < 0.25, "low").when(share < 0.5, "middle").otherwise("high")


def evade_chance(value: Column) -> Column:
    return F.floor(value / 20 * 100 + 0.5)


def roll(dice: Column, rolls: Column) -> Column:
    """Sum of a notation's dice, which are the first of ``rolls`` (an array of numbers of
    1 to its sides), and its bonus (R1); null where the notation is."""
    return F.when(dice.isNotNull(), F.aggregate(F.slice(rolls, 1, dice["count"]), F.lit(0), lambda a, x: a + x.cast("int")) + dice.bonus)


def die(seed: Column, sides: Column) -> Column:
    """A number of 1 to ``sides`` that only depends on ``seed`` (I26); 1 for no sides."""
    return F.when(sides > 0, F.pmod(F.xxhash64(seed), sides) + 1).otherwise(1)


def spend(current: Column, amount: Column) -> Column:
    """struct<value, error>: what is left, or the old value where that is too little."""
    short = current < amount
    return F.struct(F.when(short, current).otherwise(current - amount).alias("value"), F.when(short, "not enough").alias("error"))


def restore(current: Column, most: Column, amount: Column) -> Column:
    """struct<value, gained>, at most the maximum."""
    value = F.least(current + amount, most)
    return F.struct(value.alias("value"), (value - current).alias("gained"))


def set_to(value: Column, most: Column) -> Column:
    """A value kept between 0 and the maximum."""
    return F.greatest(F.lit(0), F.least(value, most))


def regeneration(rows: DataFrame, key: str, resources: dict[str, tuple[str, str, str]], modifier: Column, always: str) -> DataFrame:
    """(key, resource, old, value) after a night (R7), a row for each resource that one
    has: its columns are (current, most, roll); ``always`` is never left out."""
    parts = [F.when(F.lit(name == always) | (F.col(most) > 0), F.struct(F.lit(name).alias("resource"), F.col(current).cast("long").alias("old"), F.least(F.col(most), F.col(current) + F.greatest(F.col(dice) + modifier, F.lit(0))).cast("long").alias("value"))) for name, (current, most, dice) in resources.items()]
    return rows.select(key, F.inline(F.filter(F.array(*parts), lambda p: p.isNotNull())))
