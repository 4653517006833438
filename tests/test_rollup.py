"""Stored partial aggregates and sketches against the full recompute."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from playlake.plans import players as PL
from playlake.plans import rollup as RO
from playlake.sources import versions as V

PITCH = "array<struct<pitch_number:bigint, bat_score:bigint, post_bat_score:bigint, woba_value:double, woba_denom:bigint, launch_speed:double>>"
FACTS = (f"batter long, game_date date, inning_topbot string, home_team string, away_team string, events string, pitches {PITCH}")
EVENTS = ["single", "double", "home_run", "walk", "strikeout", "sac_fly", "hit_by_pitch", "field_out", None]


def appearances(spark, seed, months, n=60):
    import datetime as dt
    r = random.Random(seed)
    rows = [(r.randint(1, 4), dt.date(2023 + m // 12, m % 12 + 1, r.randint(1, 28)), r.choice(["Top", "Bot"]),
             r.choice(["H", "A", "C", None]), r.choice(["H", "A"]), r.choice(EVENTS),
             [(1, 0, r.randint(0, 2), r.choice([None, 0.5, 1.25]), r.choice([None, 1]), r.choice([None, 90.0, 101.5]))] * r.randint(0, 2))
            for m in months for _ in range(n)]
    return spark.createDataFrame(rows, FACTS)


def lines(df):
    """Seasons by player; averages to 9 digits, as sums run in another order."""
    say = lambda v: round(v, 9) if isinstance(v, float) else v
    return {r.player_id: [tuple(say(v) for v in s) for s in r.seasonal_stats] for r in df.collect()}


def test_stored_lines_equal_the_recompute_after_append_and_replace(spark, tmp_path):
    facts, sums = str(tmp_path / "facts"), str(tmp_path / "sums")
    month = F.date_format(F.trunc("game_date", "month"), "yyyy-MM-dd")

    def same():
        assert lines(PL.stored_batting(spark, sums)) == lines(PL.season_batting_stats(V.read(spark, facts)))

    V.commit(spark, facts, appearances(spark, 1, range(10, 15)), month)
    assert len(PL.refresh_batting(spark, facts, sums)) == 5
    same()
    assert PL.refresh_batting(spark, facts, sums) == []
    V.commit(spark, facts, appearances(spark, 2, [14, 15]), month)  # append to one month, add another
    assert PL.refresh_batting(spark, facts, sums) == ["2024-03-01", "2024-04-01"]
    same()
    V.commit(spark, facts, appearances(spark, 3, [11]), month, actions={"2024-01-01": "replace"}, default="replace")  # one gone
    assert PL.refresh_batting(spark, facts, sums) == ["2023-12-01", "2024-01-01"]
    same()
    V.commit(spark, facts, appearances(spark, 4, [12]), month, truncate=True)
    assert len(PL.refresh_batting(spark, facts, sums)) == 6
    same()
    V.commit(spark, facts, appearances(spark, 5, []), month, truncate=True)
    PL.refresh_batting(spark, facts, sums)
    assert lines(PL.stored_batting(spark, sums)) == {}


def test_only_changed_parts_are_read(spark, tmp_path):
    path, kept = str(tmp_path / "t"), str(tmp_path / "sums")
    seen = []

    def partial(rows):
        seen.append(sorted(r[0] for r in rows.select(RO.PART).distinct().collect()))
        return rows.groupBy(RO.PART).agg(F.sum("id").alias("n"))

    for part, n in (("a", 3), ("b", 4), ("a", 5)):
        V.commit(spark, path, spark.range(n), F.lit(part))
        RO.refresh(spark, path, kept, partial)
    assert seen == [["a"], ["b"], ["a"]]
    assert {r.part: r.n for r in RO.partials(spark, kept).collect()} == {"a": 3 + 10, "b": 6}
    assert [r.part for r in RO.partials(spark, kept, "b", "z").collect()] == ["b"]


@pytest.mark.parametrize("parts", [1, 12])
def test_sketches_are_within_their_bounds(spark, tmp_path, parts):
    path, kept = str(tmp_path / "t"), str(tmp_path / "sketches")
    rng = np.random.default_rng(parts)
    x = rng.lognormal(0, 2, 40_000)
    df = spark.createDataFrame([(i % parts, "g" if i % 4 else "h", float(v), i % 7001) for i, v in enumerate(x.tolist())],
                               "p int, g string, v double, k int").unionByName(spark.createDataFrame([(0, "none", None, None)], "p int, g string, v double, k int"))
    V.commit(spark, path, df, F.col("p"))
    RO.refresh(spark, path, kept, lambda r: RO.sketches(r, ["v"], ["k"], ["g"]))
    probabilities = (0.05, 0.25, 0.5, 0.75, 0.95)
    out = {r.g: r for r in RO.profile(RO.partials(spark, kept), ["v"], ["k"], ["g"], probabilities).collect()}
    for g in "gh":
        own = np.sort(x[[("g" if i % 4 else "h") == g for i in range(len(x))]])
        assert out[g].rows == len(own) and (out[g].v_min, out[g].v_max) == (own[0], own[-1])
        ranks = np.searchsorted(own, out[g].v_q) / len(own)
        assert np.abs(ranks - probabilities).max() < 0.03  # three standard errors at k = 200
        exact = len({i % 7001 for i in range(len(x)) if ("g" if i % 4 else "h") == g})
        assert abs(out[g].k_distinct / exact - 1) < 0.05
    assert out["none"].rows == 1 and out["none"].v_q is None and out["none"].k_distinct == 0
