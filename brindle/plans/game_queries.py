"""Rule kernels and turn state; dice and stats are derived from event and part columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions import rules, text
from brindle.operators import combat, mutations, ranking
from brindle.plans.base import query, table

# Dice of an event: two twenty-sided, one six-sided, from arithmetic on its id.
D20, C20, D6 = "((event_id * 7919) % 20 + 1)", "((event_id * 104729) % 20 + 1)", "((event_id * 31) % 6 + 1)"
SKILL = "((event_id * 13) % 18 + 2)"
OUTCOME = f"CASE WHEN {D20} = 1 THEN CASE WHEN {C20} <= {SKILL} THEN 'critical' ELSE 'hit' END WHEN {D20} = 20 THEN CASE WHEN {C20} > {SKILL} THEN 'botch' ELSE 'miss' END WHEN {D20} <= {SKILL} THEN 'hit' ELSE 'miss' END"


def _dice(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id")
    return e.withColumns({"d20": F.expr(D20), "c20": F.expr(C20), "d6": F.expr(D6), "skill": F.expr(SKILL)})


@query("r2_attack_outcome", f"SELECT event_id, {OUTCOME} AS outcome FROM events")
def r2_attack_outcome(spark, sf_dir):
    return _dice(spark, sf_dir).select("event_id", rules.attack(F.col("d20"), F.col("c20"), F.col("skill")).alias("outcome"))


@query("r3_defence", f"SELECT event_id, {C20} <= {SKILL} AS defended FROM events")
def r3_defence(spark, sf_dir):
    return _dice(spark, sf_dir).select("event_id", rules.defence(F.col("c20"), F.col("skill")).alias("defended"))


DICE_SUM = f"({D6} + (event_id * 17) % 6 + 1)"


@query(
    "r8_combat_resolution",
    f"""WITH o AS (SELECT event_id, {OUTCOME} AS outcome, {C20} <= ((event_id * 5) % 12 + 3) AS defended, {DICE_SUM} AS dice, (event_id % 5) AS armour FROM events),
 d AS (SELECT *, CASE outcome WHEN 'critical' THEN dice * 2 + 3 WHEN 'hit' THEN CASE WHEN defended THEN 0 ELSE dice + 3 END WHEN 'botch' THEN greatest((dice + 3) // 2, 1) ELSE 0 END AS raw FROM o)
SELECT event_id, outcome, raw, CASE WHEN outcome = 'botch' THEN raw WHEN raw > 0 AND raw <= armour // 2 THEN 1 ELSE greatest(raw - armour, 0) END AS damage FROM d""",
)
def r8_combat_resolution(spark, sf_dir):
    e = _dice(spark, sf_dir).withColumns({"dice": F.expr(DICE_SUM), "armour": F.col("event_id") % 5, "parry": F.expr("(event_id * 5) % 12 + 3")})
    return combat.resolve(e, roll="d20", confirm="c20", attack="skill", defence_roll="c20", parry="parry", dice="dice", bonus=F.lit(3), armour="armour").select("event_id", "outcome", "raw", "damage")


@query("r4_soak", "SELECT p_partkey, CASE WHEN p_size % 12 > 0 AND p_size % 12 <= floor((p_partkey % 9) / 2) THEN 1 ELSE greatest(p_size % 12 - p_partkey % 9, 0) END::BIGINT AS damage FROM part")
def r4_soak(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", rules.soak(F.col("p_size") % 12, F.col("p_partkey") % 9).cast("long").alias("damage"))


@query("r5_pain", "SELECT p_partkey, CASE WHEN p_partkey % 41 = 0 THEN 0 WHEN p_size <= 5 THEN 4 WHEN p_size <= (p_partkey % 41) * 0.25 THEN 3 WHEN p_size <= (p_partkey % 41) * 0.5 THEN 2 WHEN p_size <= (p_partkey % 41) * 0.75 THEN 1 ELSE 0 END AS pain FROM part")
def r5_pain(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", rules.pain(F.col("p_size"), F.col("p_partkey") % 41).alias("pain"))


REST = f"({SKILL} - greatest({D20} - 12, 0) - greatest({C20} - 8, 0) - greatest((event_id * 37) % 20 + 1 - 10, 0))"


@query("r6_probe", f"SELECT event_id, {REST} AS rest, {REST} >= 0 AS success, CASE WHEN {REST} < 0 THEN 0 ELSE least(greatest(ceil({REST} / 3.0), 1), 6) END::INTEGER AS quality FROM events")
def r6_probe(spark, sf_dir):
    d = _dice(spark, sf_dir)
    p = rules.probe([F.col("d20"), F.col("c20"), F.expr("(event_id * 37) % 20 + 1")], [F.lit(12), F.lit(0), F.lit(10)], F.col("skill"))
    return d.select("event_id", p.alias("p")).select("event_id", "p.rest", "p.success", "p.quality")


@query("r7_regen", "SELECT p_partkey, CASE WHEN p_partkey % 4 > 0 THEN least((p_partkey % 4) * 10, p_size + greatest(p_partkey % 6 + 1 - 2, 0)) ELSE p_size END::BIGINT AS value FROM part")
def r7_regen(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", rules.regenerate(F.col("p_size"), (F.col("p_partkey") % 4) * 10, F.col("p_partkey") % 6 + 1, F.lit(-2)).cast("long").alias("value"))


@query("r10_evasion", f"SELECT event_id, {D20} <= {SKILL} AS evaded, floor({SKILL} / 20.0 * 100 + 0.5)::BIGINT AS chance FROM events")
def r10_evasion(spark, sf_dir):
    return _dice(spark, sf_dir).select("event_id", (F.col("d20") <= F.col("skill")).alias("evaded"), rules.evade_chance(F.col("skill")).cast("long").alias("chance"))


NOTE = "CASE WHEN p_size % 7 = 0 THEN '' WHEN p_size % 7 = 1 THEN p_size::VARCHAR WHEN p_size % 7 = 2 THEN 'w6' WHEN p_size % 7 = 3 THEN p_size || 'D6 + ' || (p_size % 5) WHEN p_size % 7 = 4 THEN 'fist' ELSE p_size || 'W20' END"


@query(
    "r1_dice_parse",
    f"""WITH n AS (SELECT p_partkey, {NOTE} AS note FROM part)
SELECT p_partkey, CASE WHEN regexp_matches(note, '^[0-9]*[wWdD][0-9]+') THEN coalesce(TRY_CAST(nullif(regexp_extract(note, '^([0-9]*)[wWdD]', 1), '') AS INTEGER), 1) WHEN regexp_matches(note, '^[0-9]*$') THEN 0 END AS count,
 CASE WHEN regexp_matches(note, '^[0-9]*[wWdD][0-9]+') THEN regexp_extract(note, '[wWdD]([0-9]+)', 1)::INTEGER WHEN regexp_matches(note, '^[0-9]*$') THEN 0 END AS sides,
 CASE WHEN regexp_matches(note, '^[0-9]*[wWdD][0-9]+') THEN coalesce(TRY_CAST(nullif(regexp_extract(note, '[+] ?([0-9]+)', 1), '') AS INTEGER), 0) WHEN note = '' THEN 0 WHEN regexp_matches(note, '^[0-9]+$') THEN note::INTEGER END AS bonus FROM n""",
)
def r1_dice_parse(spark, sf_dir):
    size = F.col("p_size")
    word = size.cast("string")
    note = F.when(size % 7 == 0, "").when(size % 7 == 1, word).when(size % 7 == 2, "w6").when(size % 7 == 3, F.concat(word, F.lit("D6 + "), (size % 5).cast("string"))).when(size % 7 == 4, "fist").otherwise(F.concat(word, F.lit("W20")))
    return table(spark, sf_dir, "part").select("p_partkey", text.dice(note).alias("d")).select("p_partkey", "d.count", "d.sides", "d.bonus")


@query("i19_bars", "SELECT p_partkey, repeat('#', floor(p_size / 50.0 * 10 + 0.5)::INT) || repeat('-', 10 - floor(p_size / 50.0 * 10 + 0.5)::INT) AS bar FROM part")
def i19_bars(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.bar(F.col("p_size"), F.lit(50), 10).alias("bar"))


@query("i18_leading_int", r"SELECT event_id, TRY_CAST(nullif(regexp_extract(substring(props, 7), '^\s*([+-]?\d+)', 1), '') AS INTEGER) AS k FROM events")
def i18_leading_int(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", text.leading_int(F.substr("props", F.lit(7))).alias("k"))


@query("i22_json_field", "SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER), 0) AS k, coalesce(TRY_CAST(json_extract_string(props, '$.missing') AS INTEGER), 0) AS missing FROM events")
def i22_json_field(spark, sf_dir):
    field = lambda name: F.coalesce(F.get_json_object("props", f"$.{name}").try_cast("int"), F.lit(0)).alias(name)
    return table(spark, sf_dir, "events").select("event_id", field("k"), field("missing"))


@query("e8_capped_sum", "SELECT l_orderkey, least(sum(l_linenumber), 5)::BIGINT AS level, (sum(l_linenumber) >= 8 OR min(l_quantity) <= 5) AS down FROM lineitem GROUP BY 1")
def e8_capped_sum(spark, sf_dir):
    total = F.sum(F.coalesce("l_linenumber", F.lit(0)))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.least(total, F.lit(5)).cast("long").alias("level"), ((total >= 8) | (F.min("l_quantity") <= 5)).alias("down"))


@query("e10_ratio_band", "SELECT l_suppkey, CASE WHEN sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) / sum(l_quantity) < 0.25 THEN 'low' WHEN sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) / sum(l_quantity) < 0.5 THEN 'middle' ELSE 'high' END AS band FROM lineitem GROUP BY 1")
def e10_ratio_band(spark, sf_dir):
    returned = F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0))
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(rules.band(returned, F.sum("l_quantity")).alias("band"))


@query("d13_effective_stats", "SELECT c_custkey, coalesce(nullif(o.n, 0), 8) AS orders_or_default, CASE WHEN c_mktsegment = 'MACHINERY' THEN coalesce(s.s_acctbal, 0.0) ELSE c_acctbal END AS balance FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o_custkey = c_custkey LEFT JOIN supplier s ON s_suppkey = c_custkey")
def d13_effective_stats(spark, sf_dir):
    """The source of a value depends on the row's kind; defaults where it is missing."""
    c = table(spark, sf_dir, "customer")
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("c_custkey"), "s_acctbal")
    joined = c.join(o, "c_custkey", "left").join(s, "c_custkey", "left")
    balance = F.when(F.col("c_mktsegment") == "MACHINERY", F.coalesce("s_acctbal", F.lit(0.0))).otherwise(F.col("c_acctbal"))
    return joined.select("c_custkey", F.coalesce(F.nullif(F.col("n"), F.lit(0)), F.lit(8)).alias("orders_or_default"), balance.alias("balance"))


@query("c16_equipped_weapon", "SELECT l_orderkey, coalesce(nullif(min_by(l_quantity, (l_linenumber, l_partkey, l_suppkey, l_extendedprice)) FILTER (WHERE l_returnflag IN ('A', 'N')), 0), 8.0) AS attack FROM lineitem GROUP BY 1")
def c16_equipped_weapon(spark, sf_dir):
    usable = F.col("l_returnflag").isin("A", "N")
    first = F.min_by(F.when(usable, F.col("l_quantity")), F.when(usable, F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.coalesce(F.nullif(first, F.lit(0.0)), F.lit(8.0)).alias("attack"))


@query("f4_turn_order", "SELECT user_id, count(*) AS n, string_agg(event_id::VARCHAR, ',' ORDER BY value DESC, length(event_type) DESC, event_id) AS turn_order FROM events GROUP BY user_id")
def f4_turn_order(spark, sf_dir):
    return ranking.turn_order(table(spark, sf_dir, "events"), "user_id", [F.desc("value"), F.desc(F.length("event_type")), F.col("event_id")], "event_id")


MEMBERS = "SELECT l_orderkey, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS pos, count(*) OVER (PARTITION BY l_orderkey) AS n, l_quantity > 10 AS alive FROM lineitem"


def _members(spark, sf_dir):
    rows = ranking.parts(table(spark, sf_dir, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"])
    return rows.select("l_orderkey", "l_partkey", (F.col("part") - 1).cast("long").alias("pos"), F.col("n_parts").alias("n"), (F.col("l_quantity") > 10).alias("alive"))


@query(
    "f5_next_alive",
    f"SELECT l_orderkey, pos, place, pos <= cur AS wrapped FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY ((pos - cur - 1) % n + n) % n, pos) AS place FROM (SELECT *, l_orderkey % n AS cur FROM ({MEMBERS})) WHERE alive) WHERE place <= 3",
)
def f5_next_alive(spark, sf_dir):
    m = _members(spark, sf_dir)
    found = ranking.next_alive(m, "l_orderkey", F.col("pos"), F.col("l_orderkey") % F.col("n"), F.col("n"), F.col("alive"), 3)
    return found.select("l_orderkey", "pos", F.col("place").cast("long").alias("place"), "wrapped")


SLOT = "CASE l_returnflag WHEN 'N' THEN 'OFFENSE' WHEN 'R' THEN 'DEFENSE' ELSE 'ADAPTIVE' END"


@query(
    "p7_equip_slots",
    f"SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber = 1 THEN true WHEN l_linestatus = 'O' AND l_returnflag = 'N' THEN false ELSE l_linestatus = 'O' END AS equipped, CASE WHEN l_linenumber = 1 THEN 'OFFENSE' WHEN l_linestatus = 'O' AND l_returnflag = 'N' THEN NULL WHEN l_linestatus = 'O' AND l_returnflag = 'A' THEN 'DEFENSE' ELSE {SLOT} END AS slot FROM lineitem",
)
def p7_equip_slots(spark, sf_dir):
    """What comes off has no slot any more."""
    return _equipped(spark, sf_dir, "OFFENSE")


@query("p7_equip_adaptive", f"SELECT l_orderkey, l_linenumber, l_partkey, l_linenumber = 1 AS equipped, CASE WHEN l_linenumber = 1 THEN 'ADAPTIVE' WHEN l_linestatus = 'O' THEN NULL ELSE {SLOT} END AS slot FROM lineitem")
def p7_equip_adaptive(spark, sf_dir):
    """Wanting either slot takes everything else off."""
    return _equipped(spark, sf_dir, "ADAPTIVE")


def _equipped(spark, sf_dir, wanted):
    slot = F.expr(SLOT)
    worn, place = mutations.equip(slot, F.col("l_linestatus") == "O", F.col("l_linenumber") == 1, wanted)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", worn.alias("equipped"), place.alias("slot"))


@query("p8_select_one", "SELECT o_orderkey, CASE WHEN o_custkey = 5 THEN CASE WHEN o_totalprice > 200000.0 THEN 'YES' ELSE 'NO' END ELSE 'KEEP' END AS selected FROM orders")
def p8_select_one(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("selected", F.lit("KEEP"))
    return mutations.select_one(o, F.col("o_custkey") == 5, F.col("o_totalprice") > 200000.0, "selected").select("o_orderkey", "selected")


@query("p6_start_readiness", f"SELECT l_orderkey, count(*) AS n, (count(*) >= 2 AND bool_or(alive) AND bool_or(NOT alive)) AS ready FROM ({MEMBERS}) GROUP BY 1")
def p6_start_readiness(spark, sf_dir):
    return combat.readiness(_members(spark, sf_dir), "l_orderkey", F.col("alive"))


@query("j1_session_fold", "SELECT conv_id, count(*) AS n_events, count(*) FILTER (WHERE role = 'user') AS round, arg_max(role, turn) AS last_role, max(turn) AS last_turn, CASE WHEN arg_max(role, turn) = 'assistant' THEN 'ENDED' ELSE 'RUNNING' END AS state FROM conversations GROUP BY conv_id")
def j1_session_fold(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    last = F.max_by("role", "turn")
    return c.groupBy("conv_id").agg(F.count("*").alias("n_events"), F.count_if(F.col("role") == "user").alias("round"), last.alias("last_role"), F.max("turn").alias("last_turn"), F.when(last == "assistant", "ENDED").otherwise("RUNNING").alias("state"))


FIGHT = """WITH RECURSIVE e AS (SELECT user_id, (event_id % 4)::INTEGER AS target, floor(value / 10)::INTEGER AS damage, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
 r AS (SELECT DISTINCT user_id, 0::BIGINT AS k, 1 AS round, 0 AS turn, 'RUNNING' AS state, NULL::VARCHAR AS winner, [30, 30, 30, 30] AS hp, []::VARCHAR[] AS log FROM e
 UNION ALL SELECT user_id, k + 1, CASE WHEN even AND odd AND next <= turn THEN round + 1 ELSE round END, CASE WHEN even AND odd THEN next ELSE turn END, CASE WHEN even AND odd THEN 'RUNNING' ELSE 'ENDED' END,
  CASE WHEN even AND odd THEN NULL WHEN even THEN 'even' WHEN odd THEN 'odd' ELSE 'draw' END, now, list_append(log, 'R' || round || ' ' || turn || '>' || target || ' -' || damage)
  FROM (SELECT *, now[1] > 0 OR now[3] > 0 AS even, now[2] > 0 OR now[4] > 0 AS odd, CASE WHEN now[(turn + 1) % 4 + 1] > 0 THEN (turn + 1) % 4 WHEN now[(turn + 2) % 4 + 1] > 0 THEN (turn + 2) % 4 WHEN now[(turn + 3) % 4 + 1] > 0 THEN (turn + 3) % 4 ELSE turn END AS next
   FROM (SELECT r.*, e.target, e.damage, list_transform([1, 2, 3, 4], lambda i: CASE WHEN i = e.target + 1 THEN greatest(0, r.hp[i] - e.damage) ELSE r.hp[i] END) AS now FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1 WHERE r.state = 'RUNNING')))
SELECT user_id AS session, arg_max(round, k) AS round, arg_max(turn, k) AS turn, arg_max(state, k) AS state, max(winner) AS winner, max(len(log)) AS n_log, array_to_string(arg_max(hp, k), ',') AS hp, sha256(array_to_string(list_slice(arg_max(log, k), -20, -1), chr(10))) AS log_sha256 FROM r GROUP BY user_id"""


@query("p4_combat_fold", FIGHT)
def p4_combat_fold(spark, sf_dir):
    """Every user's events as hits in turn, folded to the state of a fight."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), (F.col("event_id") % 4).cast("int").alias("target"), F.floor(F.col("value") / 10).cast("int").alias("damage"))
    return combat.fold(e, members=4, life=30).select("session", "round", "turn", "state", "winner", "n_log", F.array_join(F.col("hp").cast("array<string>"), ",").alias("hp"), F.sha2(F.array_join("log", "\n"), 256).alias("log_sha256"))
