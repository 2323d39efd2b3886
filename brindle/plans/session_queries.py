"""Sessions and combatants (made of orders and their lines), the full search and the
fixed catalogues."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions import rules, text
from brindle.operators import categorize, mutations, ranking, search, sessions
from brindle.plans.base import query, shared_folder, table
from brindle.plans.search_queries import first_vector
from brindle.sources import schemas

# A session for each order, a member for each of its lines.
SESSIONS = "SELECT o_orderkey::VARCHAR AS id, CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE 'ch' || o_orderkey END AS channel_id, CASE o_orderkey % 5 WHEN 0 THEN 'SETUP' WHEN 1 THEN 'RUNNING' WHEN 2 THEN 'PAUSED' ELSE 'ENDED' END AS state, CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS idx FROM orders"
MEMBERS = "SELECT l_orderkey::VARCHAR AS session_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k, l_linenumber, l_returnflag, l_quantity FROM lineitem"


def _lines(spark, sf_dir):
    """The lines with the session of each and their number in it, dealt by session once for all that follows."""
    li = table(spark, sf_dir, "lineitem").withColumn("session_id", F.col("l_orderkey").cast("string"))
    return ranking.parts(ranking.dealt(li, "session_id"), "session_id", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"])


def _tables(spark, sf_dir):
    o, m = table(spark, sf_dir, "orders"), _lines(spark, sf_dir)
    s = spark.sql(SESSIONS.replace("::VARCHAR", "::STRING").replace("FROM orders", "FROM {o}"), o=o)
    members = m.select(
        F.concat_ws(".", "session_id", F.col("part").cast("string")).alias("id"), "session_id", F.lit("NPC").alias("type"), F.when(F.col("part") % 2 == 0, "A").otherwise("B").alias("allegiance"),
        F.when(F.col("l_returnflag") == "R", F.col("part").cast("string")).alias("discord_user_id"), F.lit("x").alias("name"), F.lit(30).alias("max_hp"), F.col("l_quantity").cast("int").alias("current_hp"),
        F.lit(0).alias("initiative_base"), F.lit(0).alias("initiative_roll"), (F.col("part") == 1).alias("is_active_turn"),
    )
    order = members.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct(F.split_part("id", F.lit("."), F.lit(2)).cast("int").alias("k"), "id"))).alias("o")).select(F.col("session_id").alias("id"), F.transform("o", lambda x: x.id).alias("turn_order"))
    held = s.join(order, "id", "left").select("id", "channel_id", "state", F.coalesce("turn_order", F.array().cast("array<string>")).alias("turn_order"), F.col("idx").alias("current_turn_index"), F.array(F.lit("begun")).alias("combat_log"))
    return held, members


def _twice(df):
    """Each command two times, one after the other."""
    return df.withColumn("seq", F.explode(F.array(F.lit(1), F.lit(2))))


def _log(df, *more):
    return df.select("id", "state", F.col("current_turn_index").cast("long").alias("turn"), F.array_join("combat_log", "|").alias("log"), *more)


N = "(SELECT session_id, max(k) AS n FROM (" + MEMBERS + ") GROUP BY 1)"


@query("p1_start_combat", f"SELECT s.id, CASE WHEN s.state = 'SETUP' AND n >= 2 THEN 'RUNNING' ELSE s.state END AS state, (CASE WHEN s.state = 'SETUP' AND n >= 2 THEN 0 ELSE idx END)::BIGINT AS turn, 'begun' || CASE WHEN s.state = 'SETUP' AND n >= 2 THEN '|--- Combat Started! ---' ELSE '' END AS log FROM ({SESSIONS}) s LEFT JOIN {N} n ON n.session_id = s.id")
def p1_start_combat(spark, sf_dir):
    """Every session twice with its own order; those not in setup, as the second time, or with
    one member are refused."""
    held, members = _tables(spark, sf_dir)
    asked = held.select(F.col("id").alias("session_id"), "turn_order", F.map_from_arrays("turn_order", F.transform("turn_order", lambda x, i: i + 5)).alias("initiatives"))
    return _log(sessions.start(held, members, _twice(asked)).sessions)


@query("p1_start_members", f"SELECT m.session_id || '.' || k AS id, CASE WHEN s.state = 'SETUP' AND n >= 2 THEN k + 4 ELSE 0 END AS initiative_roll, k = 1 AS is_active_turn FROM ({MEMBERS}) m JOIN {N} n USING (session_id) JOIN ({SESSIONS}) s ON s.id = m.session_id")
def p1_start_members(spark, sf_dir):
    held, members = _tables(spark, sf_dir)
    asked = held.select(F.col("id").alias("session_id"), "turn_order", F.map_from_arrays("turn_order", F.transform("turn_order", lambda x, i: i + 5)).alias("initiatives"))
    return sessions.start(held, members, _twice(asked)).combatants.select("id", F.col("initiative_roll").cast("long").alias("initiative_roll"), "is_active_turn")


@query("p2_end_combat", f"SELECT id, 'ENDED' AS state, idx::BIGINT AS turn, 'begun' || CASE WHEN state = 'ENDED' THEN '' WHEN id::BIGINT % 4 = 0 THEN '|--- Combat Ended: fled ---' ELSE '|--- Combat Ended ---' END AS log FROM ({SESSIONS})")
def p2_end_combat(spark, sf_dir):
    held, members = _tables(spark, sf_dir)
    asked = held.select(F.col("id").alias("session_id"), F.when(F.col("id").cast("long") % 4 == 0, "fled").alias("reason"))
    return _log(sessions.end(held, members, _twice(asked)).sessions)


@query("p2_refused", f"SELECT id AS session_id, 2 AS seq, 'already ended' AS reason FROM ({SESSIONS}) UNION ALL SELECT id, 1, 'already ended' FROM ({SESSIONS}) WHERE state = 'ENDED' UNION ALL SELECT 'nowhere', unnest([1, 2]), 'session not found'")
def p2_refused(spark, sf_dir):
    """Two ends for each session: the second comes too late."""
    held, members = _tables(spark, sf_dir)
    asked = held.select(F.col("id").alias("session_id")).union(spark.createDataFrame([("nowhere",)], "session_id string"))
    return sessions.end(held, members, _twice(asked)).refused.select("session_id", F.col("seq").cast("int").alias("seq"), "reason")


AT = "coalesce(idx, 0)"


@query("p3_next_turn", f"SELECT s.id, s.state, (CASE WHEN n IS NULL THEN {AT} ELSE (({AT} + 1) % n + 1) % n END)::BIGINT AS turn, 'begun' AS log FROM ({SESSIONS}) s LEFT JOIN {N} n ON n.session_id = s.id")
def p3_next_turn(spark, sf_dir):
    """Two places on; a missing index counts as the first place."""
    held, members = _tables(spark, sf_dir)
    return _log(sessions.turn(held, members, _twice(held.select(F.col("id").alias("session_id"), F.lit("next").alias("action")))).sessions)


@query("p3_turn_members", f"SELECT m.session_id || '.' || k AS id, CASE WHEN k = (({AT} + 1) % n + 1) % n + 1 THEN true WHEN k = {AT} + 1 OR k = ({AT} + 1) % n + 1 THEN false ELSE k = 1 END AS is_active_turn FROM ({MEMBERS}) m JOIN {N} n USING (session_id) JOIN ({SESSIONS}) s ON s.id = m.session_id")
def p3_turn_members(spark, sf_dir):
    held, members = _tables(spark, sf_dir)
    return sessions.turn(held, members, _twice(held.select(F.col("id").alias("session_id"), F.lit("next").alias("action")))).combatants.select("id", "is_active_turn")


# A command for each line of an order, in the order of the lines; and their fold.
ORDERED = f"""WITH RECURSIVE c AS (SELECT session_id, k, ['start', 'next', 'pause', 'resume', 'next', 'end', 'turn_start', 'dance'][(session_id::BIGINT * 5 + l_linenumber * 3 + k) % 8 + 1] AS kind, k % 3 = 0 AS small, count(*) OVER (PARTITION BY session_id) AS n FROM ({MEMBERS})),
 r AS (SELECT s.id, 0::BIGINT AS k, s.state, s.idx, 'begun' AS log, false AS rolled, [1::BIGINT] AS act, '' AS refused FROM ({SESSIONS}) s WHERE s.id IN (SELECT session_id FROM c)
  UNION ALL SELECT id, q.k + 1,
   CASE WHEN why IS NOT NULL THEN state WHEN kind IN ('start', 'turn_start', 'resume') THEN 'RUNNING' WHEN kind = 'end' THEN 'ENDED' WHEN kind = 'pause' THEN 'PAUSED' ELSE state END,
   CASE WHEN why IS NOT NULL THEN idx WHEN kind IN ('start', 'turn_start') THEN 0 WHEN kind = 'next' THEN (was + 1) % n ELSE idx END,
   log || CASE WHEN why IS NOT NULL THEN '' WHEN kind = 'start' THEN '|--- Combat Started! ---' WHEN kind = 'end' THEN '|--- Combat Ended ---' ELSE '' END,
   rolled OR (why IS NULL AND kind = 'start'),
   CASE WHEN why IS NOT NULL THEN act WHEN kind = 'end' THEN [] WHEN kind IN ('start', 'turn_start') THEN list_distinct(list_append(act, 1)) WHEN kind = 'next' THEN list_distinct(list_append(list_filter(act, lambda x: x <> was + 1), (was + 1) % n + 1)) ELSE act END,
   refused || CASE WHEN why IS NULL THEN '' ELSE '|' || (q.k + 1) || ' ' || why END
  FROM (SELECT r.*, c.kind, c.n, {AT} AS was, CASE WHEN kind = 'dance' THEN 'invalid action' WHEN kind = 'start' AND (small OR n < 2) THEN 'fewer than two participants' WHEN kind IN ('start', 'turn_start') AND state <> 'SETUP' THEN 'not in setup' WHEN kind = 'end' AND state = 'ENDED' THEN 'already ended' WHEN kind = 'pause' AND state <> 'RUNNING' THEN 'not running' WHEN kind = 'resume' AND state <> 'PAUSED' THEN 'not paused' END AS why FROM r JOIN c ON c.session_id = r.id AND c.k = r.k + 1) q),
 o AS (SELECT * FROM r JOIN {N} n ON n.session_id = r.id AND n.n = r.k)
"""


def _ordered(spark, sf_dir):
    held, members = _tables(spark, sf_dir)
    lines = _lines(spark, sf_dir)
    kinds = F.array(*map(F.lit, ("start", "next", "pause", "resume", "next", "end", "turn_start", "dance")))
    asked = lines.select("session_id", F.col("part").alias("seq"), F.element_at(kinds, ((F.col("l_orderkey") * 5 + F.col("l_linenumber") * 3 + F.col("part")) % 8 + 1).cast("int")).alias("kind"))
    orders = held.select(F.col("id").alias("session_id"), F.col("turn_order").alias("o"))
    asked = asked.join(orders, "session_id").select("session_id", "seq", "kind", F.when(F.col("seq") % 3 == 0, F.slice("o", 1, 1)).otherwise(F.col("o")).alias("turn_order"), F.map_from_arrays("o", F.transform("o", lambda x, i: i + 5)).alias("initiatives"))
    return held, sessions.run(held, members, asked, shared_folder(spark))


@query("p10_ordered_commands", ORDERED + f"SELECT s.id, coalesce(o.state, s.state) AS state, coalesce(o.idx, s.idx)::BIGINT AS turn, coalesce(o.log, 'begun') AS log, coalesce(refused, '') AS refused FROM ({SESSIONS}) s LEFT JOIN o ON o.id = s.id")
def p10_ordered_commands(spark, sf_dir):
    """Up to seven commands of all kinds for each session, one after the other."""
    _, step = _ordered(spark, sf_dir)
    lines = F.transform(F.sort_array(F.collect_list(F.struct("seq", "reason"))), lambda r: F.concat(F.lit("|"), r.seq.cast("string"), F.lit(" "), r.reason))
    refused = step.refused.groupBy(F.col("session_id").alias("id")).agg(F.array_join(lines, "").alias("refused"))
    return _log(step.sessions).join(refused, "id", "left").withColumn("refused", F.coalesce("refused", F.lit("")))


@query("p10_ordered_members", ORDERED + f"SELECT m.session_id || '.' || m.k AS id, CASE WHEN rolled THEN m.k + 4 ELSE 0 END AS initiative_roll, list_contains(act, m.k) AS is_active_turn FROM ({MEMBERS}) m JOIN o ON o.id = m.session_id")
def p10_ordered_members(spark, sf_dir):
    _, step = _ordered(spark, sf_dir)
    return step.combatants.select("id", F.col("initiative_roll").cast("long").alias("initiative_roll"), "is_active_turn")


@query("p5_join_fight", f"SELECT count(*) AS n FROM ({MEMBERS}) UNION ALL SELECT count(*) FROM ({SESSIONS}) s WHERE state <> 'ENDED' AND NOT EXISTS (SELECT 1 FROM ({MEMBERS}) m WHERE m.session_id = s.id AND l_returnflag = 'R' AND k = 1)")
def p5_join_fight(spark, sf_dir):
    """User 1 asks to join every session, twice; where they are in it already, or it has
    ended, they are refused."""
    held, members = _tables(spark, sf_dir)
    asked = held.select(F.explode(F.array(F.lit("n1"), F.lit("n2"))).alias("id"), F.col("id").alias("session_id")).withColumns({"type": F.lit("PLAYER"), "allegiance": F.lit("A"), "discord_user_id": F.lit("1"), "name": F.lit("new"), "max_hp": F.lit(9), "current_hp": F.lit(9), "initiative_base": F.lit(None).cast("int")})
    fresh = sessions.join_fight(held, members, asked).combatants.groupBy(F.col("name") == "new").agg(F.count("*").alias("n"))
    return fresh.select("n")


@query("p10_pause_resume", f"SELECT id, CASE state WHEN 'RUNNING' THEN 'PAUSED' ELSE state END AS state FROM ({SESSIONS})")
def p10_pause_resume(spark, sf_dir):
    held, members = _tables(spark, sf_dir)
    return sessions.set_state(held, members, _twice(held.select(F.col("id").alias("session_id"))), "pause").sessions.select("id", "state")


@query("p10_recovered", f"SELECT s.id, coalesce(n, 0) AS members FROM ({SESSIONS}) s LEFT JOIN {N} n ON n.session_id = s.id WHERE state IN ('RUNNING', 'PAUSED') AND channel_id <> ''")
def p10_recovered(spark, sf_dir):
    held, members = _tables(spark, sf_dir)
    return sessions.recovered(held, members).select("id", F.size("combatants").cast("long").alias("members"))


@query("d11_turn_order_lookup", f"SELECT session_id, (k - 1)::BIGINT AS place, session_id || '.' || k AS id, l_quantity::INTEGER AS current_hp FROM ({MEMBERS})")
def d11_turn_order_lookup(spark, sf_dir):
    held, members = _tables(spark, sf_dir)
    return sessions.in_turn_order(held, members).select("session_id", F.col("place").cast("long").alias("place"), "id", "current_hp")


@query("c12_targets", f"SELECT a.session_id, count(*) AS n FROM ({MEMBERS}) a JOIN ({MEMBERS}) b ON a.session_id = b.session_id AND a.k % 2 <> b.k % 2 AND b.l_quantity >= 1 GROUP BY 1")
def c12_targets(spark, sf_dir):
    _, members = _tables(spark, sf_dir)
    return sessions.targets(members).groupBy("session_id").agg(F.count("*").alias("n"))


@query("c11_consumables", "SELECT p_partkey FROM part WHERE p_brand IN ('Brand#1', 'Brand#3') OR (CASE WHEN p_size % 4 = 0 THEN p_name WHEN p_size % 4 = 1 THEN '' END) <> ''")
def c11_consumables(spark, sf_dir):
    """Of a consumable type, or with an effect; a null type or effect is none."""
    effect = F.when(F.col("p_size") % 4 == 0, F.col("p_name")).when(F.col("p_size") % 4 == 1, "")
    usable = F.coalesce(F.col("p_brand").isin("Brand#1", "Brand#3"), F.lit(False)) | (F.coalesce(effect, F.lit("")) != "")
    return table(spark, sf_dir, "part").filter(usable).select("p_partkey")


@query("j5_tick_durations", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_linenumber - 1 END::INTEGER AS rounds FROM lineitem WHERE l_linenumber % 3 = 0 OR l_linenumber > 1")
def j5_tick_durations(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_linenumber") % 3 != 0, F.col("l_linenumber")).cast("int").alias("rounds"))
    return sessions.tick(li, "rounds")


@query("j3_open_requests", "SELECT user_id, event_type, min(ts) AS asked_at FROM events GROUP BY 1, 2 HAVING epoch(TIMESTAMP '2024-01-02 00:00:00') - floor(epoch(min(ts))) <= 60")
def j3_open_requests(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", F.concat_ws("|", "user_id", "event_type").alias("nonce"), F.col("ts").cast("timestamp").alias("asked_at"))
    return sessions.open_requests(e, F.lit("2024-01-02 00:00:00").cast("timestamp")).select("user_id", "event_type", F.col("asked_at").cast(table(spark, sf_dir, "events").schema["ts"].dataType).alias("asked_at"))


@query("b7_insert_returning", "SELECT (SELECT max(n_nationkey) FROM nation) + row_number() OVER (ORDER BY r_name) AS n_nationkey, r_name AS n_name FROM region")
def b7_insert_returning(spark, sf_dir):
    fresh = table(spark, sf_dir, "region").select(F.col("r_name").alias("n_name"), F.col("r_regionkey").alias("n_regionkey"))
    _, made = mutations.insert_returning(table(spark, sf_dir, "nation"), fresh, "n_nationkey", ["n_name"])
    return made.select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name")


@query("e17_roster", "SELECT c_nationkey, count(*) FILTER (WHERE r <= 5) AS shown, count(*) FILTER (WHERE r > 5 AND c_acctbal > 0) AS active, count(*) FILTER (WHERE r > 5 AND NOT c_acctbal > 0) AS down FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) GROUP BY 1")
def e17_roster(spark, sf_dir):
    return ranking.roster(table(spark, sf_dir, "customer"), "c_nationkey", [F.desc("c_acctbal"), F.col("c_custkey")], 5, F.col("c_acctbal") > 0)


@query("f9_part_titles", "WITH t AS (SELECT doc_id, lang AS title, (doc_id % 3 + 1) AS n FROM documents), m AS (SELECT title, count(*) AS d FROM t GROUP BY 1) SELECT doc_id, t.title || CASE WHEN n > 1 THEN ' (part 1/' || n || ')' ELSE '' END || CASE WHEN d > 1 THEN ' [' || doc_id || ']' ELSE '' END AS part_title FROM t JOIN m USING (title)")
def f9_part_titles(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("title"))
    return ranking.part_titles(d, "title", "doc_id", F.lit(1), F.col("doc_id") % 3 + 1).select("doc_id", "part_title")


@query("r9_plain_attack", "WITH e AS (SELECT event_id, (event_id * 7919) % 20 + 1 AS d, (event_id * 104729) % 20 + 1 AS c, (event_id * 13) % 18 + 2 AS s, (event_id * 31) % 6 + 1 AS dice FROM events), o AS (SELECT *, CASE WHEN d = 1 THEN CASE WHEN c <= s THEN 'critical' ELSE 'hit' END WHEN d = 20 THEN CASE WHEN c > s THEN 'botch' ELSE 'miss' END WHEN d <= s THEN 'hit' ELSE 'miss' END AS outcome, c <= 7 AS parried FROM e), r AS (SELECT *, CASE WHEN outcome IN ('miss', 'botch') OR parried THEN 0 WHEN outcome = 'critical' THEN dice * 2 + 1 ELSE dice + 1 END AS raw FROM o) SELECT event_id, outcome, CASE WHEN raw > 0 AND raw <= 1 THEN 1 ELSE greatest(raw - 3, 0) END AS damage FROM r")
def r9_plain_attack(spark, sf_dir):
    """An attack outside a fight: a critical hit can be parried, a botch does nothing."""
    from brindle.operators import combat

    e = table(spark, sf_dir, "events").select("event_id", F.expr("(event_id * 7919) % 20 + 1 AS d"), F.expr("(event_id * 104729) % 20 + 1 AS c"), F.expr("(event_id * 13) % 18 + 2 AS s"), F.expr("(event_id * 31) % 6 + 1 AS dice"), F.lit(7).alias("parry"), F.lit(3).alias("armour"))
    return combat.resolve(e, roll="d", confirm="c", attack="s", defence_roll="c", parry="parry", dice="dice", bonus=F.lit(1), armour="armour", critical_parried=True, botch_hurts=False).select("event_id", "outcome", "damage")


@query("i17_dice_dialects", "SELECT p_partkey, p_size AS roll_count, 6 AS roll_sides, -(p_size % 5) AS roll_bonus, p_size AS effect_count, 8 AS effect_sides, p_size % 3 AS effect_bonus FROM part")
def i17_dice_dialects(spark, sf_dir):
    n = F.col("p_size").cast("string")
    strict = text.dice(F.concat(n, F.lit("W6-"), (F.col("p_size") % 5).cast("string")), "roll")
    loose = text.dice(F.concat(F.lit("Heal "), n, F.lit("w8 + "), (F.col("p_size") % 3).cast("string"), F.lit(" HP")), "effect")
    found = table(spark, sf_dir, "part").select("p_partkey", strict.alias("a"), loose.alias("b"))
    return found.select("p_partkey", *(F.col(f"a.{c}").alias(f"roll_{c}") for c in ("count", "sides", "bonus")), *(F.col(f"b.{c}").alias(f"effect_{c}") for c in ("count", "sides", "bonus")))


@query("r1_rolled", "SELECT p_partkey, p_size % 4 + (p_size % 3 + 1) * 2 AS damage FROM part")
def r1_rolled(spark, sf_dir):
    """Rolls are columns: each die shows 2."""
    note = F.concat((F.col("p_size") % 3 + 1).cast("string"), F.lit("W6+"), (F.col("p_size") % 4).cast("string"))
    rolls = F.array_repeat(F.lit(2), 6)
    return table(spark, sf_dir, "part").select("p_partkey", rules.roll(text.dice(note), rolls).alias("damage"))


@query("i26_dice", "SELECT count(*) AS n, true AS within FROM part")
def i26_dice(spark, sf_dir):
    """Dice that depend on the row alone: within their sides, 1 without any."""
    d = table(spark, sf_dir, "part").select(rules.die(F.col("p_partkey"), F.col("p_size")).alias("d"), rules.die(F.col("p_partkey"), F.lit(0)).alias("none"), "p_size")
    return d.agg(F.count("*").alias("n"), F.bool_and(F.col("d").between(1, F.col("p_size")) & (F.col("none") == 1)).alias("within"))


@query("i21_resources", "SELECT p_partkey, CASE WHEN p_size < 20 THEN p_size ELSE p_size - 20 END AS spent, CASE WHEN p_size < 20 THEN 'not enough' END AS error, least(p_size + 7, 50) AS restored, least(p_size + 7, 50) - p_size AS gained, greatest(0, least(p_size - 10, 30)) AS put FROM part")
def i21_resources(spark, sf_dir):
    n = F.col("p_size")
    found = table(spark, sf_dir, "part").select("p_partkey", rules.spend(n, F.lit(20)).alias("s"), rules.restore(n, F.lit(50), F.lit(7)).alias("r"), rules.set_to(n - 10, F.lit(30)).alias("put"))
    return found.select("p_partkey", F.col("s.value").alias("spent"), "s.error", F.col("r.value").alias("restored"), "r.gained", "put")


@query("r7_regeneration", "SELECT p_partkey, 'lep' AS resource, p_size::BIGINT AS old, least(60, p_size + 3)::BIGINT AS value FROM part UNION ALL SELECT p_partkey, 'asp', 5, least(p_size % 4 * 3, 5 + greatest(p_partkey % 6 + 1 - 1, 0)) FROM part WHERE p_size % 4 > 0")
def r7_regeneration(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumns({"most": F.lit(60), "four": F.lit(4), "five": F.lit(5), "asp": F.col("p_size") % 4 * 3, "d6": F.col("p_partkey") % 6 + 1})
    return rules.regeneration(p, "p_partkey", {"lep": ("p_size", "most", "four"), "asp": ("five", "asp", "d6")}, F.lit(-1), "lep")


@query("i27_level_bars", "SELECT l_orderkey, l_linenumber, l_partkey, repeat('●', least(l_linenumber, 4)::INT) || repeat('○', 4 - least(l_linenumber, 4)::INT) AS bar FROM lineitem")
def i27_level_bars(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", text.level_bar(F.col("l_linenumber")).alias("bar"))


@query("g9_ordered_effects", "SELECT l_orderkey, string_agg(l_returnflag || l_linenumber, ',' ORDER BY l_returnflag, l_linenumber, l_partkey) AS effects FROM lineitem GROUP BY 1")
def g9_ordered_effects(spark, sf_dir):
    rows = F.array_sort(F.collect_list(F.struct("l_returnflag", "l_linenumber", "l_partkey")))
    listed = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(rows.alias("e"))
    return listed.select("l_orderkey", F.array_join(F.transform("e", lambda x: F.concat(x.l_returnflag, x.l_linenumber.cast("string"))), ",").alias("effects"))


@query("x15_label_votes", "SELECT p_partkey, 'small' AS category, 25 AS points, 'properties' AS reason FROM part WHERE p_size < 10 OR p_brand = 'Brand#1' UNION ALL SELECT p_partkey, 'first', 25, 'properties' FROM part WHERE p_brand = 'Brand#1' OR p_brand = 'Brand#2'")
def x15_label_votes(spark, sf_dir):
    labels = F.array(F.col("p_brand"), F.when(F.col("p_size") < 10, "little").otherwise("large"))
    return categorize.overlap_votes(table(spark, sf_dir, "part"), "p_partkey", labels, {"small": ["little", "Brand#1"], "first": ["Brand#1", "Brand#2"]})


FINAL = """WITH v AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'x' WHEN 1 THEN 'fire' END AS category, 100 AS points, 0 AS kind, 'provisional_category' AS reason FROM pages WHERE page_id % 3 < 2 AND page_id % 2 = 0
 UNION ALL SELECT page_id, c, CASE WHEN n = 1 THEN 90 ELSE 45 END, 1, CASE WHEN n = 1 THEN 'url_pattern' ELSE 'url_pattern_ambiguous' END FROM (SELECT page_id, c, count(*) OVER (PARTITION BY page_id) AS n FROM (SELECT page_id, unnest(list_filter([CASE WHEN page_id % 4 < 2 THEN 'x' END, CASE WHEN page_id % 4 IN (1, 2) THEN 'fire' END], lambda q: q IS NOT NULL)) AS c FROM pages))
 UNION ALL SELECT page_id, c, CASE WHEN n = 1 THEN 80 ELSE 35 END, 2, CASE WHEN n = 1 THEN 'breadcrumb' ELSE 'breadcrumb_ambiguous' END FROM (SELECT page_id, c, count(*) OVER (PARTITION BY page_id) AS n FROM (SELECT page_id, unnest(list_filter([CASE WHEN page_id % 5 < 2 THEN 'x' END, CASE WHEN page_id % 5 IN (1, 2) THEN 'water' END], lambda q: q IS NOT NULL)) AS c FROM pages))
 UNION ALL SELECT page_id, 'water', 25, 3, 'properties' FROM pages WHERE page_id % 7 = 0 UNION ALL SELECT page_id, 'fire', 10, 4, 'crawl_source' FROM pages WHERE page_id % 3 <> 2),
 s AS (SELECT page_id, category, sum(points) AS score, string_agg(reason, '|' ORDER BY kind, reason) AS evidence FROM v GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER w AS k, lead(score) OVER w AS second FROM s WINDOW w AS (PARTITION BY page_id ORDER BY score DESC, category)),
 c AS (SELECT *, CASE WHEN score < 60 THEN 'low' WHEN second >= score - 10 THEN 'ambiguous' WHEN score >= 100 THEN 'high' ELSE 'medium' END AS confidence FROM r WHERE k = 1)
SELECT p.page_id, CASE WHEN confidence IN ('high', 'medium') THEN category ELSE 'unresolved' END AS category, coalesce(score, 0)::BIGINT AS score, coalesce(confidence, 'none') AS confidence, coalesce(evidence, '') AS evidence FROM pages p LEFT JOIN c USING (page_id)"""


@query("x16_final_category", FINAL)
def x16_final_category(spark, sf_dir):
    """All five kinds of evidence, made of the page's number."""
    k = F.col("page_id")
    path = lambda n, a, b: F.concat(F.when(k % n < 2, a).otherwise(""), F.when((k % n).isin(1, 2), b).otherwise(""))
    p = table(spark, sf_dir, "pages").select("page_id")
    found = categorize.final_category(
        p, "page_id", url=F.concat(F.lit("https://h/"), path(4, "xx", "-fire.html")), folded_url=F.lit(""), folded_crumbs=path(5, "the xx ", "| water"), labels=F.when(k % 7 == 0, F.array(F.lit("wet"))).otherwise(F.array(F.lit("dry"))),
        crawl_sources=F.when(k % 3 != 2, F.array(F.lit("fire"))).otherwise(F.array().cast("array<string>")), provisional=F.when((k % 2 == 0) & (k % 3 == 0), "x").when((k % 2 == 0) & (k % 3 == 1), "fire"),
        url_rules=[("x", ["xx", "never"]), ("fire", [r"fire\.html"])], crumb_rules=[("x", ["xx"]), ("water", ["water"])], label_rules={"water": ["wet"]},
    )
    return found.select("page_id", "category", "score", "confidence", F.array_join("evidence", "|").alias("evidence"))


@query("a14_talents", "SELECT 59 AS n, 8 AS attributes")
def a14_talents(spark, sf_dir):
    t = schemas.talents(spark)
    return t.agg(F.countDistinct("name").cast("int").alias("n"), F.size(F.array_distinct(F.flatten(F.collect_list(F.array("stat1", "stat2", "stat3"))))).alias("attributes"))


@query("a14_maneuvers", "SELECT * FROM (VALUES ('Finte', -2, 0, -2), ('Wuchtschlag', -2, 2, 0)) t(name, at_modifier, damage_bonus, opponent_pa_modifier)")
def a14_maneuvers(spark, sf_dir):
    field = lambda f: F.coalesce(F.get_json_object("rules", f"$.{f}").cast("int"), F.lit(0)).alias(f)
    return schemas.maneuvers(spark).select("name", field("at_modifier"), field("damage_bonus"), field("opponent_pa_modifier"))


@query("r11_vocabulary", "SELECT * FROM (VALUES ('condition', 10), ('status', 13)) t(kind, n)")
def r11_vocabulary(spark, sf_dir):
    return schemas.vocabulary(spark).groupBy("kind").agg(F.count("*").cast("int").alias("n"))


@query("b14_log_export", "SELECT conv_id, sha256(string_agg(role || ': ' || length(\"text\"), chr(10) ORDER BY turn)) AS log_sha256 FROM conversations GROUP BY conv_id")
def b14_log_export(spark, sf_dir):
    """A log as one text of lines."""
    line = F.concat("role", F.lit(": "), F.char_length("text"))
    logs = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("log"))
    return logs.select("conv_id", text.sha256(F.array_join(F.transform("log", lambda x: x.line), "\n")).alias("log_sha256"))


@query("i23_arrays", "SELECT p_partkey, p_size || ',' || (p_size + 1) || ',9' AS appended, 5 IN (p_size, p_size + 1, 9) AS has_five, CASE WHEN p_size % 2 = 0 THEN p_size || ',9' ELSE (p_size + 1) || ',9' END AS kept FROM part")
def i23_arrays(spark, sf_dir):
    n = F.col("p_size")
    joined = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
    a = F.array_append(F.array(n, n + 1), F.lit(9))
    return table(spark, sf_dir, "part").select("p_partkey", joined(a).alias("appended"), F.array_contains(a, 5).alias("has_five"), joined(F.concat(F.filter(F.array(n, n + 1), lambda x: x % 2 == 0), F.slice(a, -1, 1))).alias("kept"))


# Pages and chunks of the search: a page for each part, chunks dealt out to the first 97.
PAGES = "SELECT p_partkey AS page_id, 'd' || (p_partkey % 60) AS doc_id, p_name AS title, p_brand AS category, CASE WHEN p_partkey % 2 = 0 THEN 'r' ELSE '' END AS resolved_category, 'u' || p_partkey AS source_url, p_partkey % 5 = 0 AS is_unresolved, CASE WHEN p_partkey % 11 = 0 THEN TIMESTAMP '2024-01-01 00:00:00' END AS deleted_at FROM part"
CHUNKS = "SELECT 'c' || lpad(vec_id::VARCHAR, 7, '0') AS chunk_id, (vec_id % 97 + 1) AS page_id, CASE WHEN vec_id % 3 = 0 THEN NULL ELSE 'text ' || vec_id END AS chunk_text, embedding, vec_id % 7 <> 0 AS is_active FROM embeddings"
SIM = "list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings ORDER BY vec_id LIMIT 1))"
MATCH = f"SELECT chunk_id, page_id, doc_id, title, category, coalesce(nullif(resolved_category, ''), category) AS resolved_category, coalesce(chunk_text, '') AS chunk_text, {SIM} AS s FROM ({CHUNKS}) JOIN ({PAGES}) USING (page_id) WHERE is_active AND deleted_at IS NULL AND {SIM} >= 0.0"


def _search_tables(spark, sf_dir):
    e, p = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "part")
    return spark.sql(CHUNKS.replace("::VARCHAR", "::STRING").replace("FROM embeddings", "FROM {e}"), e=e), spark.sql(PAGES.replace("FROM part", "FROM {p}"), p=p)


@query("k1_match_rule_chunks", f"SELECT chunk_id, page_id, doc_id, round(s, 6) AS similarity FROM ({MATCH}) JOIN (SELECT page_id FROM ({PAGES}) WHERE NOT is_unresolved AND category = 'Brand#1') USING (page_id) ORDER BY s DESC, chunk_id LIMIT 12")
def k1_match_rule_chunks(spark, sf_dir):
    """Living pages of a category, active chunks; unresolved pages are left out by default."""
    found = search.match_rule_chunks(*_search_tables(spark, sf_dir), first_vector(spark, sf_dir), 0.0, 12, "Brand#1")
    return found.select("chunk_id", "page_id", "doc_id", F.round("similarity", 6).alias("similarity"))


@query("c7_with_unresolved", f"SELECT chunk_id, page_id, round(s, 6) AS similarity FROM ({MATCH}) ORDER BY s DESC, chunk_id LIMIT 12")
def c7_with_unresolved(spark, sf_dir):
    found = search.match_rule_chunks(*_search_tables(spark, sf_dir), first_vector(spark, sf_dir), 0.0, 12, include_unresolved=True)
    return found.select("chunk_id", "page_id", F.round("similarity", 6).alias("similarity"))


FOUND = f"SELECT * FROM ({MATCH}) JOIN (SELECT page_id FROM ({PAGES}) WHERE NOT is_unresolved) USING (page_id) ORDER BY s DESC, chunk_id LIMIT 10"


@query("s2_search_rules", f"SELECT chunk_id, resolved_category, chunk_text, round(s, 6) AS similarity FROM ({FOUND})")
def s2_search_rules(spark, sf_dir):
    found = search.search_rules(_search_tables(spark, sf_dir), None, first_vector(spark, sf_dir), 0.0, 10)
    return found.select("chunk_id", "resolved_category", "chunk_text", F.round("similarity", 6).alias("similarity"))


@query("s2_legacy_search", f"SELECT chunk_id, resolved_category, round(s, 6) AS similarity FROM (SELECT *, {SIM} AS s FROM (SELECT 'c' || lpad(vec_id::VARCHAR, 7, '0') AS chunk_id, 'l' || label AS resolved_category, embedding, vec_id % 4 = 0 AS is_unresolved FROM embeddings) WHERE {SIM} >= 0.0 ORDER BY s DESC, chunk_id LIMIT 15) WHERE NOT is_unresolved ORDER BY s DESC, chunk_id LIMIT 5")
def s2_legacy_search(spark, sf_dir):
    """The fallback where the structured tables do not exist: filtered after the fetch."""
    e = table(spark, sf_dir, "embeddings")
    legacy = e.select(F.concat(F.lit("c"), F.lpad(F.col("vec_id").cast("string"), 7, "0")).alias("chunk_id"), F.lit("d").alias("doc_id"), F.lit("t").alias("title"), F.concat(F.lit("l"), F.col("label").cast("string")).alias("category"), F.lit("").alias("resolved_category"), F.lit("u").alias("source_url"), F.lit("x").alias("chunk_text"), "embedding", (F.col("vec_id") % 4 == 0).alias("is_unresolved"))
    found = search.search_rules(None, legacy, first_vector(spark, sf_dir), 0.0, 5)
    return found.select("chunk_id", "resolved_category", F.round("similarity", 6).alias("similarity"))


@query("s7_fetch_page", f"SELECT doc_id, any_value(title) AS title FROM ({PAGES}) WHERE doc_id = 'd7' GROUP BY doc_id HAVING count(*) = 1 UNION ALL SELECT p_name, p_name FROM part WHERE p_partkey = 44")
def s7_fetch_page(spark, sf_dir):
    """A doc_id that several pages have is no page; a deleted page is fetched."""
    _, pages = _search_tables(spark, sf_dir)
    own = pages.withColumn("doc_id", F.when(F.col("page_id") == 44, F.col("title")).otherwise(F.col("doc_id")))
    name = table(spark, sf_dir, "part").filter("p_partkey = 44").select("p_name").first()["p_name"]
    only = own.filter((F.col("page_id") == 44) | (F.col("doc_id") != name))
    return search.fetch_page(only, "d7").select("doc_id", "title").union(search.fetch_page(only, name).select("doc_id", "title"))


# Titles of pages that have several: the list is in the order of the parts.
TITLES = "SELECT 'd' || (p_partkey % 97) AS doc_id, p_name AS title, p_brand AS category, p_partkey AS place FROM part WHERE p_partkey > 60"
HYBRID = f"""WITH l AS ({TITLES}), h AS (SELECT *, CASE WHEN lower(title) = 'red' THEN 1 WHEN starts_with(lower(title), 'red') THEN 2 ELSE 3 END AS tier FROM l WHERE contains(lower(title), 'red') QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY place) = 1),
 x AS (SELECT * FROM h ORDER BY tier, place LIMIT 3),
 f AS (SELECT *, row_number() OVER (ORDER BY s DESC, chunk_id) AS k FROM ({FOUND})), u AS (SELECT * FROM f WHERE k = (SELECT min(k) FROM f g WHERE g.page_id = f.page_id) AND k = (SELECT min(k) FROM f g WHERE g.doc_id = f.doc_id) ORDER BY k LIMIT 5),
 e AS (SELECT 'exact' AS role, row_number() OVER (ORDER BY tier, place) AS place, doc_id, title, ['exact', 'prefix', 'contains'][tier] AS match_type, NULL::DOUBLE AS similarity FROM x),
 m AS (SELECT 'semantic' AS role, row_number() OVER (ORDER BY k) AS place, doc_id, title, 'semantic' AS match_type, round(s, 6) AS similarity FROM u WHERE doc_id NOT IN (SELECT doc_id FROM x)),
 c AS (SELECT * FROM (SELECT * FROM e UNION ALL SELECT * FROM m) ORDER BY role, place LIMIT 1)
SELECT * FROM e UNION ALL SELECT * FROM m UNION ALL SELECT 'selected', 0, doc_id, title, CASE WHEN role = 'exact' AND (SELECT count(*) FROM l WHERE l.doc_id = c.doc_id) = 1 THEN 'exact' ELSE match_type END, similarity FROM c"""


@query("s6_hybrid_search", HYBRID)
def s6_hybrid_search(spark, sf_dir):
    """Titles and meaning together, with the page selected."""
    found = search.search_rules(_search_tables(spark, sf_dir), None, first_vector(spark, sf_dir), 0.0, 10)
    titles = spark.sql(TITLES.replace("FROM part", "FROM {p}"), p=table(spark, sf_dir, "part"))
    hits = search.hybrid_search(titles, found, titles, "red", limit=5, order=("place",))
    return hits.select("role", "place", "doc_id", "title", "match_type", F.round("similarity", 6).alias("similarity"))
