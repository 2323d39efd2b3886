"""Explicit schemas of the game and corpus tables; nothing is ever inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def _struct(text: str) -> T.StructType:
    """A schema from ``name kind`` pairs; arrays as kind[]."""
    kinds = {"int": T.IntegerType(), "long": T.LongType(), "string": T.StringType(), "bool": T.BooleanType(), "time": T.TimestampType(), "float": T.FloatType()}
    fields = []
    for pair in text.split(","):
        name, kind = pair.split()
        fields.append(T.StructField(name, T.ArrayType(kinds[kind[:-2]]) if kind.endswith("[]") else kinds[kind]))
    return T.StructType(fields)


TABLES: dict[str, T.StructType] = {
    "players": _struct("id int, name string, discord_id string, selected string, avatar string"),
    "stats": _struct("player_id int, mu int, kl int, inn int, ch int, ff int, ge int, ko int, kk int, le_max int, le_current int, asp_max int, asp_current int, kap_max int, kap_current int, initiative int, ruestungsschutz int, ausweichen int, attacke_basis int, parade_basis int"),
    "talents": _struct("id int, name string, stat1 string, stat2 string, stat3 string"),
    "player_talents": _struct("player_id int, talent_id int, ftw int"),
    "action_modifications": _struct("id string, name string, description string, action_type string, prerequisites string, rules string"),
    "player_action_modifications": _struct("player_id int, action_modification_id string, ftw int"),
    "weapons": _struct("id int, player_id int, name string, type string, tp string, at int, pa int, is_equipped string, equipped_slot string"),
    "items": _struct("id int, player_id int, name string, type string, effect string, description string, quantity int"),
    "mobs": _struct("id string, name string, base_hp int, base_initiative int, base_attack int, base_parry int, base_soak int, base_damage_tp string"),
    "combat_sessions": _struct("id string, channel_id string, dm_user_id string, state string, turn_order string[], current_turn_index int, current_round int, combat_log string[]"),
    "combatants": _struct("id string, session_id string, type string, allegiance string, player_id int, mob_definition_id string, name string, max_hp int, current_hp int, initiative_base int, initiative_roll int, is_active_turn bool"),
    "combatant_conditions": _struct("id string, combatant_id string, condition_type string, level int, source string, duration_type string, duration_remaining int"),
    "combatant_statuses": _struct("id string, combatant_id string, status_type string, source string, duration_rounds int"),
    "rule_pages": _struct("id string, doc_id string, source_item_id string, source_url string, url_hash string, canonical_slug string, title string, category string, resolved_category string, subcategory string, page_state string, is_unresolved bool, resolution_confidence string, normalized_content string, content_hash string, parser_version string, scraper_version string, source_snapshot_at time, version int, metadata string, last_seen_at time, deleted_at time"),
    "rule_chunks": _struct("chunk_id string, page_id string, version int, chunk_index int, title string, category string, resolved_category string, heading string, chunk_text string, char_start int, char_end int, is_unresolved bool, metadata string, embedding float[], embedding_model string, embedded_at time, is_active bool"),
}

# The skills every character has, with their three attributes.
TALENTS = (
    ("Alchemie", "MU", "KL", "FF"),
    ("Bekehren & Überzeugen", "MU", "KL", "CH"),
    ("Betören", "MU", "CH", "CH"),
    ("Boote & Schiffe", "FF", "GE", "KK"),
    ("Brett & Glücksspiel", "KL", "KL", "IN"),
    ("Einschüchtern", "MU", "IN", "CH"),
    ("Etikette", "MU", "IN", "CH"),
    ("Fährtensuchen", "MU", "IN", "CH"),
    ("Fahrzeuge", "CH", "FF", "KO"),
    ("Fesseln", "KL", "FF", "KK"),
    ("Fischen & Angeln", "FF", "GE", "KO"),
    ("Fliegen", "MU", "IN", "GE"),
    ("Gassenwissen", "KL", "IN", "CH"),
    ("Gaukeleien", "MU", "CH", "FF"),
    ("Geographie", "KL", "KL", "IN"),
    ("Geschichtswissen", "KL", "KL", "IN"),
    ("Götter & Kulte", "KL", "KL", "IN"),
    ("Handel", "KL", "IN", "CH"),
    ("Heilkunde: Gift", "MU", "KL", "IN"),
    ("Heilkunde: Krankheiten", "MU", "IN", "KO"),
    ("Heilkunde: Wunden", "KL", "FF", "FF"),
    ("Heilkunde: Seele", "IN", "CH", "KO"),
    ("Holzbearbeitung", "FF", "GE", "KK"),
    ("Klettern", "MU", "GE", "KK"),
    ("Körperbeherrschung", "GE", "GE", "KO"),
    ("Kraftakt", "KO", "KK", "KK"),
    ("Kriegskunst", "MU", "KL", "IN"),
    ("Lebensmittelbearbeitung", "IN", "FF", "FF"),
    ("Lederbearbeitung", "FF", "GE", "KO"),
    ("Magiekunde", "KL", "KL", "IN"),
    ("Malen & Zeichnen", "IN", "FF", "FF"),
    ("Mechanik", "KL", "KL", "FF"),
    ("Menschenkenntnis", "KL", "IN", "CH"),
    ("Metallbearbeitung", "FF", "KO", "KK"),
    ("Musizieren", "CH", "FF", "KO"),
    ("Orientierung", "KL", "IN", "IN"),
    ("Pflanzenkunde", "KL", "FF", "KO"),
    ("Rechnen", "KL", "KL", "IN"),
    ("Rechtskunde", "KL", "KL", "IN"),
    ("Reiten", "CH", "GE", "KK"),
    ("Sagen & Legenden", "KL", "KL", "IN"),
    ("Schlösserknacken", "IN", "FF", "FF"),
    ("Schwimmen", "GE", "KO", "KK"),
    ("Selbstbeherrschung", "MU", "MU", "KO"),
    ("Singen", "KL", "CH", "KO"),
    ("Sinnesschärfe", "KL", "IN", "IN"),
    ("Spährenkunde", "KL", "KL", "IN"),
    ("Steinbearbeitung", "FF", "FF", "KK"),
    ("Sternkunde", "KL", "KL", "IN"),
    ("Stoffbearbeitung", "KL", "FF", "FF"),
    ("Tanzen", "KL", "CH", "GE"),
    ("Taschendiebstahl", "MU", "FF", "GE"),
    ("Tierkunde", "MU", "MU", "CH"),
    ("Überreden", "MU", "IN", "CH"),
    ("Verbergen", "MU", "IN", "GE"),
    ("Verkleiden", "IN", "CH", "GE"),
    ("Wildnisleben", "MU", "GE", "KO"),
    ("Willenskraft", "MU", "IN", "CH"),
    ("Zechen", "KL", "KO", "KK"),
)

# Maneuvers, with the technique they need and what they change.
MANEUVERS = (
    ("Wuchtschlag", "MELEE", "Hiebwaffen", 10, '{"type": "power_attack", "at_modifier": -2, "damage_bonus": 2}'),
    ("Finte", "MELEE", "Hiebwaffen", 12, '{"type": "feint", "at_modifier": -2, "opponent_pa_modifier": -2}'),
)

# Conditions by group, and statuses.
CONDITIONS = {
    "Körperlich": ("schmerz", "betaeubung", "paralyse", "belastung", "ueberanstrengung"),
    "Geistig": ("verwirrung", "furcht", "berauscht", "entrueckung", "trance"),
}
STATUSES = ("blutend", "bewusstlos", "blind", "brennend", "handlungsunfaehig", "liegend", "stumm", "taub", "ueberrascht", "unsichtbar", "vergiftet", "fixiert", "bewegungsunfaehig")

# Words in a file's name and the category they stand for, in order.
FILE_CATEGORIES = (("conditions", "condition"), ("status", "status"), ("wound", "combat"), ("maneuver", "maneuver"), ("spell", "spell"), ("talent", "talent"), ("combat", "combat"))


def talents(spark: SparkSession) -> DataFrame:
    """(name, stat1, stat2, stat3) of the skills."""
    return spark.createDataFrame(list(TALENTS), "name string, stat1 string, stat2 string, stat3 string")


def maneuvers(spark: SparkSession) -> DataFrame:
    """(name, action_type, technique, least, rules) of the maneuvers."""
    return spark.createDataFrame(list(MANEUVERS), "name string, action_type string, technique string, least int, rules string")


def vocabulary(spark: SparkSession) -> DataFrame:
    """(kind, category, name) of conditions and statuses."""
    rows = [("condition", group, name) for group, names in CONDITIONS.items() for name in names]
    return spark.createDataFrame([*rows, *(("status", None, name) for name in STATUSES)], "kind string, category string, name string")
