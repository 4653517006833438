"""Player dimension (C8): batter x season batting lines, nested per player.

Built from the at-bat fact table (one row per plate appearance, pitches
sorted).  Standard public definitions; the outcome names are those of the
outcome map in ``operators.encode``.  Two aggregation levels: player x season
(map-side combined), then one row per player with an array sorted by season.
The sums by month can be stored and kept up to date (``plans/rollup.py``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rollup

# --- fixed values: outcome names used by the batting formulas ---------------
HITS = ["single", "double", "triple", "home_run"]
WALKS = ["walk", "intent_walk"]
HIT_BY_PITCH = ["hit_by_pitch"]
SAC_FLIES = ["sac_fly", "sac_fly_double_play"]
SAC_BUNTS = ["sac_bunt", "sac_bunt_double_play"]
INTERFERENCE = ["catcher_interf"]


def _n(events, names):
    return F.sum(F.when(F.col(events).isin(names), 1).otherwise(0))


SUMS = ["plate_apperances", "hits", "home_runs", "_d", "_t", "_bb", "_hbp", "_sf", "_sh", "_ci", "rbi", "_wv", "_wd", "_evs", "_evn"]


def batting_partials(facts: DataFrame, items: str = "pitches", by=()) -> DataFrame:
    """Sums by player, season and team (and ``by``) that add up over any split of the plate appearances."""
    last = F.try_element_at(F.col(items), F.lit(-1))
    pa = facts.where(F.col("events").isNotNull()).select(
        *by, F.col("batter").alias("player_id"),
        F.year("game_date").alias("season_year"),
        F.when(F.col("inning_topbot") == "Bot", F.col("home_team")).otherwise(F.col("away_team")).alias("team"),
        "events",
        (last["post_bat_score"] - last["bat_score"]).alias("runs_in"),
        last["woba_value"].alias("woba_value"), last["woba_denom"].alias("woba_denom"),
        F.aggregate(F.transform(F.col(items), lambda p: F.coalesce(p["launch_speed"], F.lit(0.0))),
                    F.lit(0.0), lambda a, b: a + b).alias("ev_sum"),
        F.size(F.filter(F.col(items), lambda p: p["launch_speed"].isNotNull())).alias("ev_n"))
    ev = "events"
    return pa.groupBy(*by, "player_id", "season_year", "team").agg(
        F.count(F.lit(1)).alias("plate_apperances"),
        _n(ev, HITS).alias("hits"), _n(ev, ["home_run"]).alias("home_runs"),
        _n(ev, ["double"]).alias("_d"), _n(ev, ["triple"]).alias("_t"),
        _n(ev, WALKS).alias("_bb"), _n(ev, HIT_BY_PITCH).alias("_hbp"), _n(ev, SAC_FLIES).alias("_sf"),
        _n(ev, SAC_BUNTS).alias("_sh"), _n(ev, INTERFERENCE).alias("_ci"),
        F.sum(F.coalesce("runs_in", F.lit(0))).alias("rbi"),
        F.sum("woba_value").alias("_wv"), F.sum("woba_denom").alias("_wd"),
        F.sum("ev_sum").alias("_evs"), F.sum("ev_n").alias("_evn"))


def batting_lines(partial: DataFrame) -> DataFrame:
    """One row per player with the seasons' lines, from :func:`batting_partials`; the team of most appearances, ties by name."""
    teams = partial.groupBy("player_id", "season_year", "team").agg(*[F.sum(c).alias(c) for c in SUMS])
    named = F.when(F.col("team").isNotNull(), F.struct((-F.col("plate_apperances")).alias("m"), "team"))
    per = teams.groupBy("player_id", "season_year").agg(F.min(named)["team"].alias("team"), *[F.sum(c).alias(c) for c in SUMS])
    ab = F.col("plate_apperances") - F.col("_bb") - F.col("_hbp") - F.col("_sf") - F.col("_sh") - F.col("_ci")
    per = per.withColumn("atbats", ab)
    tb = F.col("hits") + F.col("_d") + 2 * F.col("_t") + 3 * F.col("home_runs")
    obp_den = F.col("atbats") + F.col("_bb") + F.col("_hbp") + F.col("_sf")
    per = per.select(
        "player_id", "season_year", "team", "plate_apperances", "atbats", "hits", "home_runs", "rbi",
        F.when(F.col("atbats") > 0, F.col("hits") / F.col("atbats")).alias("batting_avg"),
        F.when(obp_den > 0, (F.col("hits") + F.col("_bb") + F.col("_hbp")) / obp_den).alias("obp"),
        F.when(F.col("atbats") > 0, tb / F.col("atbats")).alias("slg"),
        F.when(F.col("_wd") > 0, F.col("_wv") / F.col("_wd")).alias("woba"),
        F.when(F.col("_evn") > 0, F.col("_evs") / F.col("_evn")).alias("avg_exit_vel"))
    per = per.withColumn("ops", F.col("obp") + F.col("slg"))
    fields = ["season_year", "team", "plate_apperances", "atbats", "hits", "home_runs", "rbi",
              "batting_avg", "obp", "slg", "ops", "woba", "avg_exit_vel"]
    return per.groupBy("player_id").agg(
        F.array_sort(F.collect_list(F.struct(*fields))).alias("seasonal_stats"))


def season_batting_stats(facts: DataFrame, items: str = "pitches") -> DataFrame:
    """The player dimension from the facts themselves."""
    return batting_lines(batting_partials(facts, items))


def refresh_batting(spark: SparkSession, facts_path: str, partials_path: str, items: str = "pitches") -> list[str]:
    """Bring stored sums up to date with a versioned facts table: only months whose loads changed are read."""
    return rollup.refresh(spark, facts_path, partials_path, lambda f: batting_partials(f, items, by=[rollup.PART]))


def stored_batting(spark: SparkSession, partials_path: str) -> DataFrame:
    """The player dimension from the stored sums."""
    return batting_lines(rollup.partials(spark, partials_path))
