"""Characters by name, overviews and sheets, payloads of spans and episodes, and moods of measures."""

import pytest
from pyspark.sql import functions as F
from tessella.functions import music
from tessella.operators import media, people

CAST = [("s", 1, "Kyouko Hori", "MAIN", 0), ("s", 2, "Izumi Miyamura", "MAIN", 1), ("s", 3, "Motoko Hori", "SUPPORTING", 2), ("s", 4, "Yuriko Hori", "BACKGROUND", 3), ("s", 5, "Hörige", None, 4), ("s", 6, None, "MAIN", 5), ("t", 7, "Hori", "MAIN", 0)]


@pytest.fixture(scope="module")
def cast(spark):
    return spark.createDataFrame(CAST, "season string, character_id long, name string, role string, position int")


def test_find_orders_by_name_then_role(spark, cast):
    asked = spark.createDataFrame([("s", "HORI!"), ("s", "hori"), ("s", "hori kyouko"), ("s", "  "), ("s", None), ("u", "hori"), ("s", "zz")], "season string, q string")
    got = {}
    for r in people.find(asked, cast, "season", "q").orderBy("place").collect():
        got.setdefault(r.q, []).append((r.character_id, r.score))
    assert got == {"HORI!": [(1, 2), (3, 2), (4, 2), (5, 1)], "hori": [(1, 2), (3, 2), (4, 2), (5, 1)], "hori kyouko": [(1, 2)]}


def test_pick_names_of_a_list(spark, cast):
    asks = spark.createDataFrame([("s", 1, "Hori, miyamura,"), ("s", 2, "Hori,kyouko,nobody"), ("s", 3, " , "), ("s", 4, None)], "season string, r int, text string")
    rows = people.pick(asks, cast, "season", "r", "text").orderBy("r", "position").collect()
    assert [(r.r, r.search, r.character_id, r.status) for r in rows] == [
        (1, "Hori", 1, "found"), (1, "miyamura", 2, "found"), (2, "Hori", 1, "found"), (2, "kyouko", 1, "repeated"), (2, "nobody", None, "unknown"), (3, None, None, "empty"), (4, None, None, "empty"),
    ]
    assert rows[0].others == ["Motoko Hori", "Yuriko Hori", "Hörige"] and rows[4].others == []


FACE = "season string, clip long, face_id long, character_id long, probability double, height double"


def test_overview_and_sheet(spark, cast):
    faces = [("s", 1, 1, 1, 0.9, 0.1), ("s", 1, 2, 1, 0.7, 0.1), ("s", 2, 3, 1, None, 0.1), ("s", 2, 4, None, 0.1, 0.3), ("s", 3, 5, None, 0.1, 0.6), ("s", 3, 6, None, 0.2, None)]
    df = spark.createDataFrame(faces, FACE)
    got = {r.character_id: (r.clips, r.faces, r["mean"]) for r in people.overview(cast, df, "season").collect()}
    assert got[1] == (2, 3, pytest.approx(0.8)) and got[2] == (0, 0, None) and len(got) == 7
    placed = {(r.character_id, r.place): r.face_id for r in people.sheet(df, "season", 2).collect()}
    assert placed == {(1, 0): 1, (1, 1): 3, (None, 0): 5, (None, 1): 4}
    assert people.sheet(df.limit(0), "season", 2).count() == 0


def test_skip_times_by_nearest_length(spark):
    entry = lambda kind, a, b, length: f'{{"skipType":"{kind}","interval":{{"startTime":{a},"endTime":{b}}},"episodeLength":{length}}}'
    body = lambda *e: f'{{"found":true,"results":[{",".join(e)}]}}'
    rows = [
        (1, body(entry("op", 10, 100, 1410), entry("op", 20, 110, 1402), entry("op", 30, 120, 1398), entry("ed", 5, 6, 1300), entry("intro", 1, 2, 1400)), 1400.0),
        (2, body(entry("ed", 5, 6, 1300), entry("recap", 1, 2, 99)), None), (3, '{"found":false}', 1400.0), (4, "no json", 1400.0), (5, None, 1400.0),
    ]
    df = spark.createDataFrame(rows, "ep int, p string, d double")
    assert sorted((r.ep, r.kind, r.start, r.end) for r in media.skip_times(df, "ep", "p", "d").collect()) == [(1, "op", 20, 110), (2, "ed", 5, 6), (2, "recap", 1, 2)]


def test_episode_pages(spark):
    rows = [(9, 1, '{"data":[{"mal_id":1,"title":"A","filler":true},{"mal_id":2}]}'), (9, 2, '{"data":[{"mal_id":2,"title":"B","recap":true},{"title":"no number"}]}'), (8, 1, "x"), (8, 2, None)]
    df = spark.createDataFrame(rows, "id int, page int, p string")
    assert sorted(tuple(r) for r in media.episode_list(df, "id", "page", "p").collect()) == [(9, 1, "A", True, False), (9, 2, "B", False, True)]


def test_places_of_moods(spark):
    df = spark.createDataFrame([(180.0, 1.0), (30.0, 0.0), (120.0, None)], "tempo double, major double")
    got = df.select(music.scaled_mean({"tempo": 1.0, "major": 3.0, "x": 0.0}, {"tempo": (60, 180)}).alias("m"), music.place_fit(F.lit(0.85), F.lit(0.4), (0.85, 0.4), 0.3).alias("here"), music.describe(F.col("major"), F.col("major")).alias("d")).collect()
    assert [r.m for r in got] == [1.0, 0.0, None] and got[0].here == 1.0
    assert [r.d for r in got] == ["energetic, rather happy", "calm, rather sad", None]
    assert df.select(music.scaled_mean({}, {}).alias("m")).first().m == 0.5
