"""Combat resolution and the fold of a fight.

One turn of a fight is one function of state and event, ``advance``; the batch
fold runs it over each session's events in order, the stream keeps its state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions import rules

#: Lines of a fight's log that are kept.
LOG = 20
STATE = T.StructType(
    [
        T.StructField("round", T.IntegerType()),
        T.StructField("turn", T.IntegerType()),
        T.StructField("state", T.StringType()),
        T.StructField("winner", T.StringType()),
        T.StructField("n_log", T.LongType()),
        T.StructField("hp", T.ArrayType(T.IntegerType())),
        T.StructField("log", T.ArrayType(T.StringType())),
    ]
)


def resolve(rows: DataFrame, *, roll: str, confirm: str, attack: str, defence_roll: str, parry: str, dice: str, bonus: Column, armour: str, critical_parried: bool = False, botch_hurts: bool = True) -> DataFrame:
    """Adds outcome, raw and damage.  A critical hit is not parried unless said so;
    a botch hurts oneself, past armour, unless said otherwise.  A plain attack (R9) has
    critical_parried and no botch_hurts."""
    outcome = rules.attack(F.col(roll), F.col(confirm), F.col(attack))
    defended = rules.defence(F.col(defence_roll), F.col(parry))
    stopped = defended & (F.col("outcome").isin(rules.HIT, rules.CRITICAL) if critical_parried else (F.col("outcome") == rules.HIT))
    harmless = F.lit(not botch_hurts) & (F.col("outcome") == rules.BOTCH)
    raw = F.when(stopped | harmless, 0).otherwise(rules.combat_damage(F.col("outcome"), F.col(dice), bonus))
    damage = F.when(F.col("outcome") == rules.BOTCH, F.col("raw")).otherwise(rules.soak(F.col("raw"), F.col(armour)))
    return rows.withColumn("outcome", outcome).withColumn("raw", raw.cast("long")).withColumn("damage", damage.cast("long"))


def readiness(members: DataFrame, session: str, side: Column) -> DataFrame:
    """A fight can start with two members or more on both sides."""
    n = F.count("*")
    return members.groupBy(session).agg(n.alias("n"), ((n >= 2) & F.bool_or(side) & F.bool_or(~side)).alias("ready"))


def start(members: int, life: int) -> dict:
    return {"round": 1, "turn": 0, "state": "RUNNING", "winner": None, "n_log": 0, "hp": [life] * members, "log": []}


def advance(state: dict, target: int, damage: int) -> dict:
    """The state after the member in turn has hit ``target``.

    Sides are even and odd members.  A side alone ends the fight before the turn
    moves; nobody left is a draw; the round grows when the turn goes round."""
    if state["state"] != "RUNNING":
        return state
    hp = list(state["hp"])
    hp[target] = max(0, hp[target] - damage)
    line = f"R{state['round']} {state['turn']}>{target} -{damage}"
    out = state | {"hp": hp, "n_log": state["n_log"] + 1, "log": [*state["log"], line][-LOG:]}
    alive = [i for i, x in enumerate(hp) if x > 0]
    sides = {i % 2 for i in alive}
    if len(sides) < 2:
        return out | {"state": "ENDED", "winner": "draw" if not sides else "odd" if sides == {1} else "even"}
    turn = next((state["turn"] + k) % len(hp) for k in range(1, len(hp) + 1) if hp[(state["turn"] + k) % len(hp)] > 0)
    return out | {"turn": turn, "round": state["round"] + (turn <= state["turn"])}


def fold(events: DataFrame, members: int, life: int) -> DataFrame:
    """(session, state columns): all events (session, seq, target, damage) in order.

    Sessions are spread and sorted once, then read as a stream of sorted rows: the
    memory of a task is one fight's state however long its log of events is."""
    schema = T.StructType([T.StructField("session", events.schema["session"].dataType), *STATE.fields])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, state, done = None, None, []
        for frame in frames:
            for key, target, damage in zip(frame["session"], frame["target"], frame["damage"], strict=True):
                if state is None or key != session:
                    if state is not None:
                        done.append({"session": session} | state)
                    session, state = key, start(members, life)
                state = advance(state, int(target), int(damage))
            if done:
                yield pd.DataFrame(done, columns=schema.names)
                done = []
        if state is not None:
            yield pd.DataFrame([{"session": session} | state], columns=schema.names)

    return events.repartition("session").sortWithinPartitions("session", "seq").mapInPandas(run, schema)
