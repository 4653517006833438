"""Production path on the hand fixture: clean -> nest -> un-nest -> features."""

import pytest
from pyspark.sql import functions as F

from playlake.operators.encode import OUTCOME_MAP, outcome_recode
from playlake.plans import ingest as IG
from playlake.sources import versions as V
from playlake.operators.nesting import unnest

COLS = ["game_pk", "game_date", "at_bat_number", "inning", "inning_topbot", "events", "batter", "pitcher",
        "pitch_number", "pitch_type", "description", "release_speed", "stand"]

# (at-bat, pitch rows) — strings as they arrive from the feed.
ROWS = [
    # 1: three pitches out of order, event only on the last
    ("100", "2024-04-01", "1", "1", "Top", None, "11", "21", "2", "FF", "ball", "95.1", "R"),
    ("100", "2024-04-01", "1", "1", "Top", "single", "11", "21", "3", "SL", "hit_into_play", "85.0", "R"),
    ("100", "2024-04-01", "1", "1", "Top", None, "11", "21", "1", "FF", "called_strike", "96.0", "R"),
    # 2: two pitchers
    ("100", "2024-04-01", "2", "1", "Top", None, "12", "21", "1", "FF", "ball", "95.0", "L"),
    ("100", "2024-04-01", "2", "1", "Top", "walk", "12", "22", "2", "FF", "ball", "94.0", "L"),
    # 3: null event on the last pitch
    ("100", "2024-04-01", "3", "1", "Top", None, "13", "21", "1", "CU", "ball", "80.0", "R"),
    ("100", "2024-04-01", "3", "1", "Top", "NA", "13", "21", "2", "CU", "ball", "81.0", "R"),
    # 4: the only pitch lacks a required field
    ("100", "2024-04-01", "4", "1", "Top", "strikeout", "14", "21", "1", "FF", "swinging_strike", "", "R"),
    # 5: text spellings, float-typed id, junk number
    ("100", "2024-04-01", "5", "2", "Bot", None, "3.0", "31", "1", " NA ", "ball", "90.0", "R"),
    ("100", "2024-04-01", "5", "2", "Bot", "field_out", "3.0", "31", "2", "FF", "hit_into_play", "abc", "NaN"),
    # 6: one row without an at-bat number
    ("100", "2024-04-01", "6", "2", "Bot", "home_run", "16", "31", "1", "FF", "hit_into_play", "99.0", "L"),
    ("100", "2024-04-01", None, "2", "Bot", None, "16", "31", "2", "FF", "ball", "98.0", "L"),
]


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame(ROWS, ", ".join(f"{c} string" for c in COLS))


def test_clean_types_and_drops(raw):
    clean, obs = IG.clean(raw)
    rows = clean.collect()
    assert len(rows) == 11
    assert obs.get["rows_in"] == 12 and obs.get["rows_dropped"] == 1
    ab5 = [r for r in rows if r.at_bat_number == 5]
    assert {r.batter for r in ab5} == {3}
    assert [r.pitch_type for r in sorted(ab5, key=lambda r: r.pitch_number)] == [None, "FF"]
    assert sorted(r.release_speed for r in ab5 if r.release_speed is not None) == [90.0]
    assert [r.stand for r in ab5 if r.pitch_number == 2] == [None]
    assert "game_id" in clean.columns and "game_pk" not in clean.columns


def test_nest_reasons_and_items(raw):
    clean, _ = IG.clean(raw)
    nested = IG.nest(clean, with_reason=True)
    got = {r.at_bat_number: r for r in nested.collect()}
    assert got[1].drop_reason is None and [p.pitch_number for p in got[1].pitches] == [1, 2, 3]
    assert got[1].events == "single"
    assert got[2].drop_reason == "multi_valued"
    assert got[3].drop_reason == "null_header"
    assert got[4].drop_reason is None and got[4].pitches == []
    assert got[5].drop_reason is None and got[5].pitches == []
    assert got[6].drop_reason is None and len(got[6].pitches) == 1
    assert [p.pitch_number for p in got[1].pitches] == [1, 2, 3]


def test_unnest_drops_empty_sequences(raw):
    clean, _ = IG.clean(raw)
    flat = unnest(IG.nest(clean), "pitches")
    assert flat.count() == 4
    assert set(flat.select("at_bat_number").distinct().toPandas()["at_bat_number"]) == {1, 6}


def test_outcome_recode_all_events(spark):
    names = list(OUTCOME_MAP) + [None, "unknown_event"]
    df = spark.createDataFrame([(n,) for n in names], "events string")
    out = {r.events: r.code for r in outcome_recode(df, "events", out="code").collect()}
    assert out["single"] == 1 and out["home_run"] == 4 and out["grounded_into_double_play"] == 7
    assert out["hit_by_pitch"] == 9 and out["fielders_choice"] == 10 and out["truncated_pa"] == 0
    assert out[None] == 0 and out["unknown_event"] == 0


def test_jagged_csv_with_quoted_newline(spark, tmp_path):
    from playlake.sources.files import read_raw_csv
    p = tmp_path / "feed.csv"
    p.write_text('a,b,c\n1,"two\nlines",3\n4,5\n')
    rows = read_raw_csv(spark, str(p), ["a", "b", "c"], multi_line=True).collect()
    assert [tuple(r) for r in rows] == [("1", "two\nlines", "3"), ("4", "5", None)]


def test_streaming_landing_load(spark, raw, tmp_path):
    from playlake.streaming.monthly import load_landing
    from playlake.sources.files import write_csv
    landing, table, ckpt = str(tmp_path / "landing"), str(tmp_path / "facts"), str(tmp_path / "ckpt")
    write_csv(raw.coalesce(1), landing)
    load_landing(spark, landing, COLS, table, ckpt)
    facts = V.read(spark, table)
    assert sorted(r.at_bat_number for r in facts.collect()) == [1, 4, 5, 6]
    load_landing(spark, landing, COLS, table, ckpt)  # nothing new: no change
    assert V.read(spark, table).count() == 4


def test_streaming_result_does_not_depend_on_the_batches(spark, raw, tmp_path):
    """Two files of one day, one of which splits an at-bat: files per batch make no difference."""
    from playlake.streaming.monthly import load_landing
    from playlake.sources.files import write_csv
    landing = str(tmp_path / "landing")
    first = F.col("pitch_number") == "1"
    write_csv(raw.where(first).coalesce(1), landing)
    write_csv(raw.where(~first | F.col("pitch_number").isNull()).coalesce(1), landing, mode="append")
    got = []
    for n in (1, 16):
        table = str(tmp_path / f"facts{n}")
        load_landing(spark, landing, COLS, table, str(tmp_path / f"ckpt{n}"), max_files_per_trigger=n)
        got.append(sorted(str(r) for r in V.read(spark, table).select("game_id", "at_bat_number", "pitches").collect()))
    assert got[0] == got[1] and len(got[0]) == 4


def test_csv_append_counts_bad_cells(spark, tmp_path):
    from pyspark.sql import Observation
    from playlake.sources.files import load_csv_append
    p, t = tmp_path / "x.csv", str(tmp_path / "t")
    p.write_text("a,b\n1,x\nbad,y\n,z\n")
    spark.createDataFrame([], "a long, b string").write.parquet(t)
    seen = Observation()
    out = load_csv_append(spark, str(p), t, ["a", "b"], cast={"a": "bigint"}, observation=seen)
    assert sorted(str(r) for r in out.collect()) == ["Row(a=1, b='x')", "Row(a=None, b='y')", "Row(a=None, b='z')"]
    assert seen.get["rejected_cells"] == 1


def test_unknown_action_is_an_error(spark):
    import datetime as dt
    plan = spark.createDataFrame([(dt.date(2020, 1, 1), 0, "merge")], "month_start date, existing long, action string")
    with pytest.raises(ValueError, match="merge"):
        IG.planned(plan)


def test_season_batting_stats(spark):
    from playlake.plans.players import season_batting_stats
    pitch = "array<struct<pitch_number:bigint, bat_score:bigint, post_bat_score:bigint, woba_value:double, woba_denom:bigint, launch_speed:double>>"
    rows = [
        (7, "2023-05-01", "Bot", "H", "A", "single", [(1, 0, 0, None, None, None), (2, 0, 0, 0.9, 1, 100.0)]),
        (7, "2023-05-01", "Bot", "H", "A", "home_run", [(1, 0, 1, 2.0, 1, 110.0)]),
        (7, "2023-05-02", "Bot", "H", "A", "walk", [(1, 1, 1, 0.7, 1, None)]),
        (7, "2023-05-02", "Bot", "H", "A", "strikeout", [(1, 1, 1, 0.0, 1, None)]),
        (7, "2023-05-03", "Top", "H", "A", "sac_fly", [(1, 1, 2, 0.0, 1, 90.0)]),
        (7, "2024-04-01", "Top", "H", "A", "double", [(1, 0, 0, 1.2, 1, 105.0)]),
    ]
    df = spark.createDataFrame(rows, f"batter long, game_date string, inning_topbot string, home_team string, "
                                     f"away_team string, events string, pitches {pitch}") \
        .withColumn("game_date", F.to_date("game_date"))
    r = season_batting_stats(df).collect()
    assert len(r) == 1
    s2023, s2024 = r[0].seasonal_stats
    assert (s2023.season_year, s2023.team, s2023.plate_apperances, s2023.atbats) == (2023, "H", 5, 3)
    assert (s2023.hits, s2023.home_runs, s2023.rbi) == (2, 1, 2)
    assert abs(s2023.batting_avg - 2 / 3) < 1e-12 and abs(s2023.obp - 3 / 5) < 1e-12
    assert abs(s2023.slg - 5 / 3) < 1e-12 and abs(s2023.ops - (3 / 5 + 5 / 3)) < 1e-12
    assert abs(s2023.woba - 3.6 / 5) < 1e-12 and abs(s2023.avg_exit_vel - 100.0) < 1e-12
    assert (s2024.team, s2024.hits) == ("A", 1)
