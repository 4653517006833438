"""Production schema constants for pitch-level and at-bat-level tables.

The column lists below are fixed values: they must equal the upstream feed
and warehouse layout for the production pipeline to line up.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: raw feed columns kept by cleaning, in feed order -------
KEEP_COLUMNS = [
    "game_pk", "game_date", "game_type", "home_team", "away_team",
    "at_bat_number", "inning", "inning_topbot", "events",
    "batter", "stand", "pitcher", "p_throws",
    "pitch_type", "pitch_name", "pitch_number", "description", "type",
    "sz_top", "sz_bot", "des",
    "release_pos_x", "release_pos_y", "release_pos_z", "plate_x", "plate_z", "zone",
    "release_speed", "effective_speed", "vx0", "vy0", "vz0", "ax", "ay", "az",
    "pfx_x", "pfx_z", "release_extension", "release_spin_rate", "spin_axis",
    "balls", "strikes", "outs_when_up", "on_3b", "on_2b", "on_1b",
    "home_score", "away_score", "bat_score", "fld_score",
    "post_home_score", "post_away_score", "post_bat_score",
    "if_fielding_alignment", "of_fielding_alignment",
    "hit_location", "bb_type", "hc_x", "hc_y", "hit_distance_sc",
    "launch_speed", "launch_angle", "launch_speed_angle",
    "woba_value", "woba_denom", "babip_value", "iso_value",
    "estimated_ba_using_speedangle", "estimated_woba_using_speedangle",
    "delta_home_win_exp", "delta_run_exp",
]

# --- fixed values: renames applied by cleaning / nesting ---------------------
CLEAN_RENAMES = {"game_pk": "game_id", "hit_distance_sc": "hit_distance"}
NEST_RENAMES = {"release_spin_rate": "release_spin"}

# --- fixed values: text columns that are whitespace-stripped -----------------
TEXT_COLUMNS = [
    "game_type", "events", "description", "stand", "p_throws", "home_team",
    "away_team", "type", "pitch_type", "pitch_name", "des", "bb_type",
    "inning_topbot", "if_fielding_alignment", "of_fielding_alignment",
]

# --- fixed values: columns coerced to numbers (bad values -> null) ----------
NUMERIC_COLUMNS = [
    "game_id", "at_bat_number", "inning", "batter", "pitcher",
    "pitch_number", "sz_top", "sz_bot", "release_pos_x", "release_pos_y",
    "release_pos_z", "plate_x", "plate_z", "zone", "release_speed",
    "effective_speed", "vx0", "vy0", "vz0", "ax", "ay", "az",
    "pfx_x", "pfx_z", "release_extension", "release_spin_rate", "spin_axis",
    "balls", "strikes", "outs_when_up", "on_3b", "on_2b", "on_1b",
    "home_score", "away_score", "bat_score", "fld_score",
    "post_home_score", "post_away_score", "post_bat_score",
    "hit_location", "hc_x", "hc_y", "hit_distance", "launch_speed",
    "launch_angle", "launch_speed_angle", "woba_value", "woba_denom",
    "babip_value", "iso_value", "estimated_ba_using_speedangle",
    "estimated_woba_using_speedangle", "delta_home_win_exp", "delta_run_exp",
]

# --- fixed values: rows missing any of these are dropped by cleaning -------
REQUIRED_COLUMNS = [
    "game_id", "game_date", "at_bat_number", "pitch_number",
    "batter", "pitcher", "inning", "inning_topbot",
]

# --- fixed values: cleaned output column order -------------------------------
FINAL_ORDER = [
    "game_id", "game_date", "game_type", "home_team", "away_team",
    "at_bat_number", "inning", "inning_topbot", "events",
    "batter", "stand", "pitcher", "p_throws",
    "pitch_type", "pitch_name", "pitch_number", "description", "type",
    "sz_top", "sz_bot", "des",
    "release_pos_x", "release_pos_y", "release_pos_z", "plate_x", "plate_z", "zone",
    "release_speed", "effective_speed", "vx0", "vy0", "vz0", "ax", "ay", "az",
    "pfx_x", "pfx_z", "release_extension", "release_spin_rate", "spin_axis",
    "balls", "strikes", "outs_when_up", "on_3b", "on_2b", "on_1b",
    "home_score", "away_score", "bat_score", "fld_score",
    "post_home_score", "post_away_score", "post_bat_score",
    "if_fielding_alignment", "of_fielding_alignment",
    "hit_location", "bb_type", "hc_x", "hc_y", "hit_distance",
    "launch_speed", "launch_angle", "launch_speed_angle",
    "woba_value", "woba_denom", "babip_value", "iso_value",
    "estimated_ba_using_speedangle", "estimated_woba_using_speedangle",
    "delta_home_win_exp", "delta_run_exp",
]

# --- fixed values: at-bat level (header) columns of the fact table ----------
ATBAT_COLUMNS = [
    "game_id", "game_date", "game_type", "home_team", "away_team",
    "at_bat_number", "inning", "inning_topbot", "events",
    "batter", "stand", "pitcher", "p_throws",
]

# --- fixed values: pitch fields that must be present for a pitch to be kept -
REQUIRED_PITCH_FIELDS = [
    "pitch_type", "pitch_name", "pitch_number", "description", "type",
    "sz_top", "sz_bot", "des", "release_pos_x", "release_pos_y", "release_pos_z",
    "plate_x", "plate_z", "zone", "release_speed", "effective_speed",
    "vx0", "vy0", "vz0", "ax", "ay", "az", "pfx_x", "pfx_z",
    "release_extension", "release_spin_rate", "spin_axis",
    "balls", "strikes", "outs_when_up", "home_score", "away_score",
    "bat_score", "fld_score", "post_home_score", "post_away_score", "post_bat_score",
    "if_fielding_alignment", "of_fielding_alignment",
]

# --- fixed values: integer-typed pitch fields (truncating cast) -------------
PITCH_INT_FIELDS = [
    "pitch_number", "zone", "release_spin_rate", "spin_axis",
    "balls", "strikes", "outs_when_up", "on_3b", "on_2b", "on_1b",
    "home_score", "away_score", "bat_score", "fld_score",
    "post_home_score", "post_away_score", "post_bat_score",
    "hit_location", "hit_distance", "launch_angle", "launch_speed_angle",
    "woba_denom", "babip_value", "iso_value",
]

# Pitch struct fields: every cleaned column that is not an at-bat header.
PITCH_COLUMNS = [c for c in FINAL_ORDER if c not in ATBAT_COLUMNS]


def raw_string_schema(columns) -> T.StructType:
    """All-string schema for raw CSV reads (typing happens afterwards)."""
    return T.StructType([T.StructField(c, T.StringType(), True) for c in columns])
