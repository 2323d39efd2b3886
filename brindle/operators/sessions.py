"""Session and combatant mutations.

Commands are rows; those of one session take effect one after the other, found by windows
over the session's commands in their order.  A mutation is a plan from the present snapshots to
the next ones.  What breaks a rule comes back with its reason and changes nothing, so a
command takes effect in all its tables or in none.

sessions: id, channel_id, state, turn_order (array), current_turn_index, combat_log
(array).  combatants: id, session_id, initiative_roll, is_active_turn, ...
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brindle.operators.mutations import rejected

# Lines that a fight's log begins and ends with.
STARTED, ENDED, ENDED_BY = "--- Combat Started! ---", "--- Combat Ended ---", "--- Combat Ended: %s ---"


@dataclass
class Step:
    """The next snapshots, the commands refused (with their reason) and those accepted."""

    sessions: DataFrame
    combatants: DataFrame
    refused: DataFrame
    accepted: DataFrame | None = None


def _split(commands: DataFrame, sessions: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Commands accepted, with their session's columns as s, and those refused."""
    held = sessions.select(F.col("id").alias("session_id"), F.struct(*sessions.columns).alias("s"))
    met = commands.join(held, "session_id", "left")
    rules = {"session not found": F.col("s").isNotNull()} | rules
    refused = rejected(met, rules)
    good = F.lit(True)
    for rule in rules.values():
        good = good & F.coalesce(rule, F.lit(False))
    return met.filter(good), refused.drop("s")


# The kinds of commands.
KINDS = ("start", "end", "next", "turn_start", "turn_end", "pause", "resume")
_COMMAND = {"seq": "long", "kind": "string", "turn_order": "array<string>", "rolls": "array<struct<key:string,value:int>>", "reason": "string"}


def _commands(commands: DataFrame) -> DataFrame:
    """session_id and the command's columns (_COMMAND); those that are not there are null, seq 0."""
    given = {k: (F.col(k) if k in commands.columns else F.lit(None)).cast(t) for k, t in _COMMAND.items()}
    rolls = F.map_entries("initiatives") if "initiatives" in commands.columns else F.lit(None)
    given |= {"seq": F.coalesce(given["seq"], F.lit(0)), "rolls": F.sort_array(rolls.cast(_COMMAND["rolls"]))}
    # of other kinds neither changes anything, not even which of two equal ones is first
    used = F.coalesce(given["kind"].isin("start", "end"), F.lit(False))
    given |= {c: F.when(used, given[c]) for c in ("turn_order", "rolls")}
    return commands.select("session_id", *(c.alias(k) for k, c in given.items()))


def _judged(asked: DataFrame, held: DataFrame) -> DataFrame:
    """The commands of known sessions, with their place (i), why each is refused, and how the
    session stands after it.

    What a session does is fixed by a few places among its commands.  SETUP is left once:
    by the first start or turn_start that is good in itself (opened), if no end comes
    before it.  The first end (closed) is the last change of state.  Between them the last
    pause or resume tells the state, whether it was refused or not.  The index moves on with
    every next since ``opened``.  So windows over the commands in their order, which Spark
    spills, find all of it, however many commands a session has."""
    own = W.partitionBy("session_id").orderBy(*_COMMAND)
    rows = asked.join(held, "session_id").withColumn("i", F.row_number().over(own).cast("long"))
    placed = W.partitionBy("session_id").orderBy("i")
    now, before = placed.rowsBetween(W.unboundedPreceding, W.currentRow), placed.rowsBetween(W.unboundedPreceding, -1)
    i, kind, sure = F.col("i"), F.col("kind"), lambda c: F.coalesce(c, F.lit(False))
    # only commands that may begin a fight carry their lists from here on
    may = (kind == "start") & (F.col("s0") == "SETUP")
    rows = rows.withColumns({"m": F.size("turn_order"), "given": F.when(may & (F.size("turn_order") >= 2), F.struct("turn_order", "rolls"))}).drop("turn_order", "rolls")
    enough = sure(F.col("m") >= 2)
    opens = ((kind == "start") & enough) | ((kind == "turn_start") & (F.col("n0") > 0))
    first = lambda c: F.min(F.when(c, i)).over(now)
    rows = rows.withColumns({"opened": first(opens), "closed": first(kind.isin("end", "turn_end")), "nexts": F.count(F.when(kind == "next", 1)).over(now)})
    rows = rows.withColumn("opened", F.when((F.col("s0") == "SETUP") & ~sure(F.col("closed") < F.col("opened")), F.col("opened")))
    here = sure(i == F.col("opened"))
    mark = F.when(here | (kind == "resume"), "RUNNING").when(kind == "pause", "PAUSED")
    rows = rows.withColumns({
        "was": F.last(mark, ignorenulls=True).over(before),
        "since": F.max(F.when(here, F.col("nexts"))).over(now),
        "n1": F.max(F.when(here & (kind == "start"), F.col("m"))).over(now),
    })
    over, begun = sure(F.col("s0") == "ENDED") | sure(F.col("closed") < i), sure(F.col("opened") < i)
    setup = sure(F.col("s0") == "SETUP") & ~over & ~begun
    runs = F.when(~over & (begun | sure(F.col("s0").isin("RUNNING", "PAUSED"))), F.coalesce("was", "s0"))
    why = (
        F.when(~sure(kind.isin(*KINDS)), "invalid action")
        .when((kind == "start") & ~enough, "fewer than two participants")
        .when(kind.isin("start", "turn_start") & ~setup, "not in setup")
        .when((kind == "turn_start") & (F.col("n0") == 0), "no combatants in turn order")
        .when((kind == "end") & over, "already ended")
        .when((kind == "pause") & ~sure(runs == "RUNNING"), "not running")
        .when((kind == "resume") & ~sure(runs == "PAUSED"), "not paused")
    )
    begins = F.col("since").isNotNull()
    return rows.withColumns({
        "why": why, "here": here, "mark": F.coalesce(mark, F.col("was")), "moved": F.col("nexts") - F.coalesce("since", F.lit(0)),
        "base": F.when(begins, 0).otherwise(F.coalesce("at0", F.lit(0))).cast("long"), "n": F.coalesce("n1", "n0").cast("long"),
    })


def _after(judged: DataFrame) -> DataFrame:
    """What all its commands make of each session."""
    good, kind = F.col("why").isNull(), F.col("kind")
    begun = F.first(F.when(F.col("here") & (kind == "start"), F.col("given")), ignorenulls=True)
    ended = F.first(F.when(good & (kind == "end"), F.struct(F.coalesce("reason", F.lit("")).alias("reason"))), ignorenulls=True)
    last = F.max_by(F.struct("opened", "mark", "moved", "base", "n", "s0", "at0"), "i")
    # the last place of an end that took effect
    over = F.max(F.when(good & kind.isin("end", "turn_end"), F.col("i")))
    return judged.groupBy("session_id").agg(begun.alias("begun"), ended.alias("ended"), last.alias("z"), over.alias("over"))


def _touched(judged: DataFrame, after: DataFrame, held: DataFrame) -> DataFrame:
    """(session_id, on, off): the members that have, or had and lost, the turn since the last
    end: the last command that touched a member counts."""
    n, at = F.col("n"), F.col("base") + F.col("moved")
    touch = lambda place, t, fresh: F.struct(place.cast("int").alias("place"), t.alias("t"), fresh.alias("fresh"))
    left, came, fresh = 2 * F.col("i"), 2 * F.col("i") + 1, F.col("n1").isNotNull()
    moves = F.array(touch(F.when(F.col("moved") == 1, F.col("base")).otherwise(F.pmod(at - 1, n)), left, fresh), touch(F.pmod(at, n), came, fresh))
    both = F.when(F.col("here"), F.array(touch(F.lit(0), came, fresh))).when((F.col("kind") == "next") & (n > 0), moves)
    places = judged.select("session_id", F.inline(both)).groupBy("session_id", "fresh", "place").agg(F.max("t").alias("t"))
    met = places.join(after.select("session_id", "over", F.col("begun.turn_order").alias("o1")), "session_id").filter(F.col("t") > 2 * F.coalesce("over", F.lit(0)) + 1)
    met = met.join(held.select("session_id", "o0"), "session_id")
    named = met.select("session_id", "t", F.get(F.when(F.col("fresh"), F.col("o1")).otherwise(F.col("o0")), F.col("place")).alias("id")).filter("id is not null")
    last = named.groupBy("session_id", "id").agg((F.max("t") % 2 == 1).alias("has"))
    return last.groupBy("session_id").agg(F.collect_list(F.when(F.col("has"), F.col("id"))).alias("on"), F.collect_list(F.when(~F.col("has"), F.col("id"))).alias("off"))


def run(sessions: DataFrame, combatants: DataFrame, commands: DataFrame, folder: str | None = None, block: int | None = None) -> Step:
    """The sessions and combatants after all commands, each session's in the order of seq,
    one after the other (P1, P2, P3, P10, C19).

    commands: session_id, seq, kind (KINDS) and, where the kind needs them, turn_order,
    initiatives (map of combatant to roll) and reason; commands of equal seq follow one
    another in the order of their other fields.  A command that breaks a rule is
    refused and changes nothing; the next one finds the state as it was.  refused has
    session_id, seq, kind, reason, accepted the other commands.

    start writes rolls and log, the first in order has the turn; next goes to the following
    place, whoever is down, and without an order only makes a missing index 0; turn_start and
    turn_end write no log; both ends take the turn from all members.  ``folder``,
    where given, takes the commands as judged, which are then computed once for all that is
    made of them.  No session's commands are ever one row, so ``block`` is without effect."""
    asked = _commands(commands)
    none = F.array().cast("array<string>")
    order = F.coalesce("turn_order", none)
    held = sessions.select(F.col("id").alias("session_id"), F.col("state").alias("s0"), F.col("current_turn_index").cast("long").alias("at0"), F.size(order).alias("n0"))
    judged = _judged(asked, held)
    if folder is not None:
        at = f"{folder}/{uuid.uuid4().hex}"
        judged.write.parquet(at)
        judged = sessions.sparkSession.read.schema(judged.schema).parquet(at)
    done = _after(judged)
    z = lambda c: F.col(f"z.{c}")
    live = z("opened").isNotNull() | F.coalesce(z("s0").isin("RUNNING", "PAUSED"), F.lit(False))
    line = F.when(F.col("ended.reason") != "", F.format_string(ENDED_BY, F.col("ended.reason"))).otherwise(ENDED)
    some = lambda c, value: F.when(F.col(c).isNotNull(), F.array(value)).otherwise(none)
    changes = {
        "state": F.when(F.col("over").isNotNull(), "ENDED").when(live, F.coalesce(z("mark"), z("s0"))).otherwise(z("s0")),
        "turn_order": F.coalesce("begun.turn_order", order),
        "current_turn_index": F.when(z("moved") == 0, F.when(z("opened").isNotNull(), 0).otherwise(z("at0"))).when(z("n") > 0, F.pmod(z("base") + z("moved"), z("n"))).otherwise(z("base")).cast("int"),
        "combat_log": F.concat(F.coalesce("combat_log", none), some("begun", F.lit(STARTED)), some("ended", line)),
    }
    final = sessions.join(done.withColumnRenamed("session_id", "id"), "id", "left")
    after = final.select(*(F.when(F.col("z").isNotNull(), changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in sessions.columns))
    touched = _touched(judged, done, sessions.select(F.col("id").alias("session_id"), order.alias("o0")))
    told = done.select("session_id", F.col("begun.rolls").alias("__rolls"), F.col("over").isNotNull().alias("__over")).join(touched.select("session_id", F.col("on").alias("__on"), F.col("off").alias("__off")), "session_id", "left")
    met = combatants.join(told, "session_id", "left")
    roll = F.element_at(F.map_from_entries("__rolls"), F.col("id"))
    active = F.when(F.array_contains("__on", F.col("id")), True).when(F.array_contains("__off", F.col("id")), False).when(F.col("__over"), False).otherwise(F.col("is_active_turn"))
    members = {"initiative_roll": F.coalesce(roll, "initiative_roll"), "is_active_turn": active}
    members = met.select(*(members[c].alias(c) if c in members else F.col(c) for c in combatants.columns))
    lost = asked.join(held.select("session_id"), "session_id", "left_anti")
    why = F.when((F.col("kind") == "start") & ~F.coalesce(F.size("turn_order") >= 2, F.lit(False)), "fewer than two participants").otherwise("session not found")
    answers = judged.select("session_id", "seq", "kind", F.col("why").alias("reason"))
    refused = answers.filter("reason is not null").union(lost.select("session_id", "seq", "kind", why.alias("reason")))
    return Step(after, members, refused, answers.filter("reason is null").drop("reason"))


def start(sessions: DataFrame, combatants: DataFrame, commands: DataFrame) -> Step:
    """Starts fights (P1): commands are session_id, turn_order, initiatives, and seq where
    a session has several."""
    return run(sessions, combatants, commands.withColumn("kind", F.lit("start")))


def end(sessions: DataFrame, combatants: DataFrame, commands: DataFrame) -> Step:
    """Ends fights (P2): commands are session_id, reason (or null), and seq."""
    return run(sessions, combatants, commands.withColumn("kind", F.lit("end")))


def turn(sessions: DataFrame, combatants: DataFrame, commands: DataFrame) -> Step:
    """Moves turns (P3): commands are session_id, action (next, start or end), and seq."""
    return run(sessions, combatants, commands.withColumn("kind", F.when(F.col("action") == "next", "next").otherwise(F.concat(F.lit("turn_"), F.col("action")))))


def join_fight(sessions: DataFrame, combatants: DataFrame, commands: DataFrame) -> Step:
    """Adds combatants (P5): commands have a new combatant's columns, discord_user_id (or
    null) among them.  A session that has ended takes none, a user is in a session once;
    of two commands for one user the first by id counts."""
    first = F.row_number().over(W.partitionBy("session_id", "discord_user_id").orderBy("id"))
    there = combatants.filter("discord_user_id is not null").select("session_id", "discord_user_id", F.lit(True).alias("__there")).distinct()
    asked = commands.withColumn("__first", F.col("discord_user_id").isNull() | (first == 1)).join(there, ["session_id", "discord_user_id"], "left")
    needed = [F.col(c).isNotNull() for c in ("type", "allegiance", "name", "max_hp", "current_hp")]
    whole = needed[0]
    for c in needed[1:]:
        whole = whole & c
    rules = {"missing required fields": whole, "session has ended": F.col("s.state") != "ENDED", "user has a combatant": F.col("__there").isNull() & F.col("__first")}
    ok, refused = _split(asked, sessions, rules)
    defaults = {"initiative_base": F.coalesce("initiative_base", F.lit(0)), "is_active_turn": F.lit(False)}
    fresh = ok.select(*(defaults.get(c, F.col(c) if c in commands.columns else F.lit(None).cast(combatants.schema[c].dataType)).alias(c) for c in combatants.columns))
    return Step(sessions, combatants.unionByName(fresh), refused.drop("__first", "__there"))


def set_state(sessions: DataFrame, combatants: DataFrame, commands: DataFrame, kind: str) -> Step:
    """Pauses or resumes sessions (P10): kind is pause or resume."""
    return run(sessions, combatants, commands.withColumn("kind", F.lit(kind)))


def recovered(sessions: DataFrame, combatants: DataFrame) -> DataFrame:
    """Sessions to take up again after a restart (P10, J2): running or paused, with a
    channel; combatants nested."""
    members = combatants.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct(*[c for c in combatants.columns if c != "session_id"]))).alias("combatants"))
    live = sessions.filter(F.col("state").isin("RUNNING", "PAUSED") & (F.coalesce("channel_id", F.lit("")) != ""))
    joined = live.join(members.withColumnRenamed("session_id", "id"), "id", "left")
    return joined.withColumn("combatants", F.coalesce("combatants", F.array().cast(members.schema["combatants"].dataType)))


def in_turn_order(sessions: DataFrame, combatants: DataFrame) -> DataFrame:
    """(session_id, place, combatant columns): members by their place in the order (D11);
    a place whose member is gone has nulls."""
    places = sessions.select(F.col("id").alias("session_id"), F.posexplode("turn_order").alias("place", "id"))
    return places.join(combatants, ["session_id", "id"], "left")


def targets(combatants: DataFrame) -> DataFrame:
    """(session_id, actor, target): whom each member can attack (C12): another, alive, of
    the other side.  An equi-join within sessions, whose members are a handful; combatants
    that are ``ranking.dealt`` by session are joined where they are."""
    a = combatants.select("session_id", F.col("id").alias("actor"), F.col("allegiance").alias("__side"))
    b = combatants.filter("current_hp > 0").select("session_id", F.col("id").alias("target"), "allegiance")
    return a.join(b, "session_id").filter((F.col("actor") != F.col("target")) & (F.col("__side") != F.col("allegiance"))).select("session_id", "actor", "target")


def tick(effects: DataFrame, remaining: str) -> DataFrame:
    """Effects one round later (J5): those without a duration last, those used up go."""
    return effects.withColumn(remaining, F.col(remaining) - 1).filter(F.col(remaining).isNull() | (F.col(remaining) > 0))


def open_requests(requests: DataFrame, now: Column, seconds: int = 60) -> DataFrame:
    """Requests that can still be answered (J3): no older than ``seconds``, each nonce the
    first time only.  Columns nonce, asked_at."""
    first = requests.withColumn("__n", F.row_number().over(W.partitionBy("nonce").orderBy("asked_at"))).filter("__n = 1").drop("__n")
    return first.filter(F.unix_timestamp(now) - F.unix_timestamp("asked_at") <= seconds)
