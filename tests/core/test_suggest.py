"""Ratings of songs, their reasons and the list of suggestions on values worked out by hand."""

import pytest
from pyspark.sql import functions as F
from tessella.operators import suggest

MOOD = "struct<romance:double,action:double,sad:double,funny:double,calm:double>"
KINDS = f"song int, artist string, label string, duration long, bpm double, cuts long, drop double, pool long, moods {MOOD}, profile {MOOD}"
WILD, SOFT = (0.1, 0.9, 0.1, 0.3, 0.1), (0.9, 0.1, 0.4, 0.3, 0.8)
STYLE = suggest.Style(mood={"action": 1.0, "calm": -0.5}, bpm=(140.0, 175.0), song_drop=1.0)


def songs(spark, *rows):
    base = {"song": 1, "artist": "A", "label": "L", "duration": 100, "bpm": 150.0, "cuts": 30, "drop": 0.4, "pool": 60, "moods": WILD, "profile": WILD}
    return spark.createDataFrame([tuple((base | r).values()) for r in rows], KINDS)


def test_parts_and_score(spark):
    (r,) = suggest.rate(songs(spark, {}), STYLE).collect()
    # (0.9 - 0.05 + 0.5) / 1.5
    assert (r.mood, r.season, r.tempo, r.drop, r.material, r.factor) == (0.9, 1.0, 1.0, 1.0, 1.0, 1.0) and r.score == round((0.9 + 0.5 * 4) / 3, 3)
    half, slow, none = suggest.rate(songs(spark, {"bpm": 80.0, "cuts": 60}, {"bpm": 130.0, "drop": 0.1}, {"drop": None, "profile": None, "moods": SOFT}), STYLE).collect()
    assert (half.factor, half.tempo, half.material) == (0.5, 0.85, 0.5)
    assert (slow.factor, slow.tempo, slow.drop) == (1.0, round(1 - (140 / 130 - 1) / 0.4, 3), 0.25)
    assert (none.mood, none.season, none.drop) == (0.133, 0.5, 0.0) and none.score == round((0.133 + 0.5 * (1 + 0 + 1)) / 2.5, 3)


def test_styles_without_tempo_or_against_drops(spark):
    free = suggest.Style(mood={"romance": 1.0}, song_drop=-0.5)
    hard, soft = suggest.rate(songs(spark, {"drop": 0.4}, {"drop": None}), free).collect()
    assert (hard.drop, soft.drop, hard.tempo) == (0.0, 1.0, 1.0) and soft.score == round((0.1 + 0.5 + 0.25 + 0.5) / 2.25, 3)


def test_reasons_and_concerns(spark):
    rated = suggest.rate(songs(spark, {"song": 1}, {"song": 2, "profile": SOFT}, {"song": 3, "bpm": 100.0, "cuts": 100, "drop": None, "moods": SOFT}), STYLE)
    got = {r.song: (r.reasons, r.concerns) for r in suggest.explain(rated, STYLE).collect()}
    assert got[1] == (["mood", "tempo", "drop"], [])  # the season says the same as the mood
    assert got[2][0] == ["mood", "tempo", "drop"] and got[2][1] == ["season"]
    assert got[3] == ([], ["mood", "tempo"]) or got[3][1][0] == "mood"
    against = suggest.Style(mood={"action": 1.0}, song_drop=-1.0)
    (r,) = suggest.explain(suggest.rate(songs(spark, {"cuts": 100}), against), against).collect()
    assert r.concerns == ["drop", "material"] and "drop" not in r.reasons and "tempo" not in r.reasons


def test_suggestions_by_artist_and_length(spark):
    rows = [{"song": k, "artist": a, "label": lab, "cuts": c, "duration": d} for k, (a, lab, c, d) in enumerate([("X", "b", 30, 100), ("x", "a", 30, 100), ("X", "c", 30, 100), ("", "d", 40, 100), ("", "e", 40, 100), (None, "f", 40, 100), ("Y", "g", 30, 10)])]
    rated = suggest.rate(songs(spark, *rows), STYLE).withColumn("season", F.lit("s"))
    got = [(r.place, r.song) for r in suggest.suggest(rated, ["season"], 50, top=5).orderBy("place").collect()]
    assert got == [(1, 1), (2, 0), (3, 3), (4, 4), (5, 5)]
    assert suggest.suggest(rated, ["season"], 50, top=9, per_artist=0).count() == 6


@pytest.mark.parametrize("drop", [1.0, -1.0, 0.0])
def test_no_songs(spark, drop):
    style = suggest.Style(mood={}, song_drop=drop)
    assert suggest.explain(suggest.rate(songs(spark, {}).where("song < 0"), style), style).count() == 0
