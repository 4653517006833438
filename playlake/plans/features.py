"""Facts -> model features (K5): un-nest, encode, expand, drop, load.

Every dictionary is one small distinct-aggregate over the un-nested rows;
the un-nested projection is checkpointed once (reliable checkpoint in the
shared folder) so the dictionaries and the final projection read it
instead of re-running scan + explode for each encoded column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import date_to_int
from ..operators import encode as EN
from ..operators.nesting import unnest

# --- fixed values: production column roles of the feature build ------------
NOMINALS = ["game_type", "bb_type", "pitch_name", "if_fielding_alignment", "of_fielding_alignment"]
BINARIES = ["stand", "p_throws", "inning_topbot"]
PLAYERS = ["on_3b", "on_2b", "on_1b"]
REMOVE = ["pitch_type", "hit_distance_sc", "game_pk", "estimated_ba_using_speedangle",
          "estimated_woba_using_speedangle", "woba_value", "babip_value", "launch_speed_angle",
          "delta_home_win_exp", "delta_run_exp", "launch_speed", "launch_angle", "hc_x", "hc_y",
          "woba_denom", "hit_location", "type", "hit_distance", "post_home_score", "post_away_score",
          "post_bat_score", "description", "iso_value"]


def build_features(facts: DataFrame, items: str = "pitches", date_col: str = "game_date",
                   nominals=NOMINALS, binaries=BINARIES, players=PLAYERS, events_col: str = "events",
                   outcome_map: dict | None = None, remove=REMOVE, hash_method: str = "murmur3",
                   checkpoint: bool = True):
    """Returns (features, key_table).

    Expanded hash columns are ``<col><i>``; ``embedding_vector`` is null
    until the embedding job fills it.
    """
    flat = unnest(facts, items)
    cols = set(flat.columns)
    flat = flat.withColumn(f"{date_col}_int", date_to_int(date_col))
    if checkpoint:
        flat = flat.checkpoint(eager=True)
    keys, widths = [], {}
    for c in [c for c in nominals if c in cols]:
        d = EN.hash_dictionary(flat, c, method=hash_method)
        flat, _ = EN.feature_hash(flat, c, dictionary=d)
        keys.append(EN.hash_key(d, c))
        widths[c] = d
    for c in [c for c in binaries if c in cols]:
        d = EN.category_dictionary(flat, c)
        flat, _ = EN.category_codes(flat, c, dictionary=d)
        keys.append(EN.code_key(d, c, c))
    flat = flat.withColumns({c: EN.presence_flag(c) for c in players if c in cols})
    if events_col in cols:
        flat = EN.outcome_recode(flat, events_col, out=events_col, mapping=outcome_map)
        keys.append(EN.outcome_key(flat.sparkSession, feature=events_col))
    for c, d in widths.items():
        width = d.agg(F.max("width")).first()[0]  # one number per encoded column
        flat = EN.expand_vector(flat, c, int(width))
    flat = flat.drop(*[c for c in remove if c in flat.columns])
    flat = flat.dropna(subset=[events_col]) if events_col in flat.columns else flat
    flat = flat.dropna(how="any").withColumn("embedding_vector", F.lit(None).cast("array<double>"))
    return flat, EN.key_table(*keys)
