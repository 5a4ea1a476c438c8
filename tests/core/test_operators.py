"""Operators on small frames with exact values, and all registered SQL against DuckDB."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tessella.functions import music, names, text
from tessella.operators import catalogue, fusion, intervals, planner, ranks, series, vectors
from tessella.plans import editing, indexing, structure  # noqa: F401
from tessella.plans import queries as plans
from tessella.sources import readers

TABLES = "region nation customer supplier part orders lineitem events documents pages embeddings conversations".split()


def plain(v):
    return v + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_sql(spark, small, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{small}/{t}.parquet'")
    rel = con.sql(plans.SQL[name])
    columns = sorted(rel.columns)
    want = sorted((tuple(map(plain, r)) for r in rel.project(", ".join(f'"{c}"' for c in columns)).fetchall()), key=repr)
    df = plans.QUERIES[name](spark, small)
    assert sorted(df.columns) == columns
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr) == want


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def test_intervals(spark):
    iv = lambda *x: spark.createDataFrame([("a", i, float(s), float(e)) for i, (s, e) in enumerate(x)], "axis string, seg int, s double, e double")
    assert rows(intervals.merge(iv((5, 10), (0, 3), (9, 12)).drop("seg")), "s", "e") == [(0, 3), (5, 12)]
    assert rows(intervals.merge(iv((0, 3), (3, 4))), "s", "e") == [(0, 4)]
    left = intervals.subtract(iv((0, 30), (30, 80), (80, 100), (100, 200)), iv((90, 180)))
    assert rows(left, "s", "e") == [(0, 30), (30, 80), (80, 90), (180, 200)]
    assert rows(intervals.subtract(iv((0, 100)), iv((40, 50))), "s", "e") == [(0, 40), (50, 100)]
    ratio = lambda a, b: spark.range(1).select(intervals.overlap_ratio(*map(F.lit, (*a, *b)))).first()[0]
    assert ratio((0.0, 10.0), (5.0, 15.0)) == pytest.approx(1 / 3) and ratio((0.0, 1.0), (2.0, 3.0)) == 0
    lines = spark.createDataFrame([("a", 1, 1.0, 3.0), ("a", 2, 3.9, 6.0), ("a", 3, 8.0, 9.0)], "axis string, line int, ls double, le double")
    assert rows(intervals.lines_in(iv((0, 4)), lines, "axis", 0.2), "line") == [(1,)]
    assert rows(intervals.lines_in(iv((2.5, 8.5)), lines, "axis", 0.2), "line") == [(1,), (2,), (3,)]


def test_ranks_and_fusion(spark):
    df = spark.createDataFrame([("x", 0, 3.0), ("x", 1, 1.0), ("x", 2, None), ("x", 3, 2.0), ("y", 4, 5.0), ("y", 5, 5.0), ("y", 6, 1.0), ("z", 7, 7.0)], "k string, i int, v double")
    got = {r.i: r.r for r in ranks.percentile_rank(df, ["k"], r="v").collect()}
    assert got == {0: 1.0, 1: 0.0, 2: None, 3: 0.5, 4: 0.75, 5: 0.75, 6: 0.0, 7: 0.5}
    sixty = spark.range(60).select(F.lit("s").alias("k"), "id", (F.col("id") % 3).cast("double").alias("v"))
    assert ranks.top_share(sixty, "v", ["id"], ["k"], 0.3).count() == 18
    one = spark.range(1)
    none = F.lit(None).cast("double")
    assert one.select(fusion.weighted_mean({"a": none, "b": none}, {"a": 1, "b": 2})).first()[0] == 0.5
    assert one.select(fusion.weighted_mean({"a": F.lit(1.0), "b": none}, {"a": 1, "b": 2})).first()[0] == 1.0
    assert one.select(fusion.mood_match({"a": none}, {"a": 1.0})).first()[0] == 0.5
    assert one.select(fusion.profile_similarity([F.lit(0.1)] * 5, [F.lit(0.2)] * 5)).first()[0] == 0.5
    with pytest.raises(ValueError):
        fusion.weighted_mean({"a": none}, {"b": 1})


def test_series(spark):
    df = spark.createDataFrame([("a", i) for i in (1, 2, 3, 7, 8, 20)], "k string, i int")
    assert rows(series.longest_run(df, ["k"], "i", 0), "first", "last") == [(1, 3)]
    assert rows(series.longest_run(df, ["k"], "i", 3), "first", "last") == [(1, 8)]
    beats = spark.createDataFrame([("a", i, i * 0.5) for i in range(9)] + [("b", 0, 1.0)], "k string, i int, t double")
    assert rows(series.bpm(beats, ["k"], "i", "t")) == [("a", pytest.approx(120)), ("b", 0.0)]
    drops = spark.createDataFrame([("a", i, s) for i, s in ((10, 0.5), (12, 0.9), (30, 0.4), (31, 0.4))], "k string, i int, v double")
    assert rows(series.suppress(drops, ["k"], "i", "v", 8, 4), "i") == [(12,), (30,)]


def test_music(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(music.ramp(4, F.lit(4.0), F.lit(1.0))) == [4, 2, 2, 1]
    assert one(music.ramp(2, F.lit(4.0), F.lit(1.0))) == [4, 1] and one(music.ramp(1, F.lit(4.0), F.lit(1.0))) == [1]
    factor = lambda *x: one(music.tempo_factor(*map(F.lit, x)))
    assert factor(150.0, 70.0, 100.0) == 2.0 and factor(70.0, 120.0, 150.0) == 0.5 and factor(90.0, 70.0, 100.0) == 1.0 and factor(0.0, 70.0, 100.0) == 1.0
    assert one(music.tempo_fit(F.lit(150.0), F.lit(70.0), F.lit(100.0))) == 0.85 and one(music.tempo_fit(F.lit(110.0), F.lit(70.0), F.lit(100.0))) == 0.75
    assert one(music.window_starts(F.lit(8.0), 6, 10.0)) == [0.0] and one(music.window_starts(F.lit(200.0), 1, 10.0)) == [95.0] and one(music.window_starts(F.lit(0.0), 6, 10.0)) == []
    assert one(music.window_starts(F.lit(100.0), 3, 10.0)) == [10.0, 45.0, 80.0] and one(music.window_starts(F.lit(12.0), 6, 10.0)) == [1.0]


def test_text(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(text.normalize_name(F.lit("Édouard-Ñ  X!"))) == "edouard n x"
    assert [one(names.episode_number(F.lit(n))) for n in ("Show S01E05.mkv", "Show - 12 [1080p].mkv", "Folge 7.mp4", "Show 03.avi", "Movie.mkv")] == [5, 12, 7, 3, None]
    assert one(names.song_label(F.lit(None), F.lit("Song (Official Video) [HD]"))) == "Song"
    assert one(text.title_score(F.lit("red"), F.lit("red"))) == 1.0 and one(text.title_score(F.lit("widget"), F.lit("red widget x"))) >= 0.9
    assert [one(text.mmss(F.lit(s))) for s in (0.0, 65.9, 600.0)] == ["0:00", "1:05", "10:00"]
    assert one(text.language_rank(F.array(F.lit("en"), F.lit("de")), ["de", "en"])) == 0 and one(text.language_rank(F.array(F.lit("fr")), ["de", "en"])) == 2


def test_vectors(spark):
    b = spark.createDataFrame([("f", i, *box, s) for i, (box, s) in enumerate([((0.0, 0.0, 10.0, 10.0), 0.9), ((1.0, 1.0, 10.0, 10.0), 0.8), ((30.0, 30.0, 5.0, 5.0), 0.1)])], "frame string, box_id long, x double, y double, w double, h double, score double")
    assert rows(vectors.nms(b, ["frame"], 0.5), "box_id") == [(0,), (2,)]


def test_catalogue(spark):
    old = spark.createDataFrame([(1, "a", 1, 10, True), (2, "b", 1, 20, True)], "key int, title string, number int, anilist_id int, done boolean")
    new = spark.createDataFrame([(1, "a", 1), (2, "B", 1), (3, "c", 1)], "key int, title string, number int")
    assert rows(catalogue.upsert_seasons(old, new)) == [(1, "a", 1, 10, True), (2, "B", 1, None, False), (3, "c", 1, None, False)]
    signed = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "id int, signature string")
    assert catalogue.worklist(signed, signed, "id", "signature").count() == 0  # a second run computes nothing
    assert rows(catalogue.worklist(signed, spark.createDataFrame([(1, "x"), (2, "old")], "id int, signature string"), "id", "signature"), "id") == [(2,), (3,)]


def test_alignment_and_plans(spark, small):
    assert planner.align_start(10, 14, 11.2, 1.0, [0, 0.5]) == (pytest.approx(11.2), True)
    assert planner.align_start(10, 12.4, 11.8, 1.1, [0, 0.5]) == (pytest.approx(11.3), True)
    assert planner.align_start(10, 14, None, 2.0, [0]) == (11.0, False)
    for mode in ("assign_greedy", "assign_story", "assign_random"):
        plan = plans.QUERIES[mode](spark, small).collect()
        assert len(plan) == plans.edit_inputs(spark, small)[0].count() > 20 and len({(r.edit_id, r.clip_id) for r in plan}) == len(plan)
    again = plans.QUERIES["assign_greedy"](spark, small).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, plans.QUERIES["assign_greedy"](spark, small).collect()))


def test_readers(spark, tmp_path):
    for n in ("Show S01E02.mkv", "Show S01E01.mkv", "extra.mkv", "Show E02 again s01e02.mkv", "note.txt"):
        (tmp_path / n).write_bytes(b"x")
    got = {r.name: r.number for r in readers.episodes(spark, str(tmp_path)).collect()}
    assert got["Show S01E01.mkv"] == 1 and len(got) == 4 and len(set(got.values())) == 4
    (tmp_path / "a.ass").write_text("Dialogue: 0,0:00:01.00,0:00:03.00,Default,,0,0,0,,Hello\\Nthere\nDialogue: 0,0:00:04.00,0:00:05.00,Signs,,0,0,0,,SHOP\nComment: 0,0:00:04.00,0:00:05.00,Default,,0,0,0,,no\nDialogue: 0,0:00:06.00,0:00:07.00,Default,,0,0,0,,{\\pos(1,2)}sign\n")
    (tmp_path / "b.srt").write_text("1\n00:00:01,500 --> 00:00:02,000\n<i>Hi</i>\n\n2\n00:00:03,000 --> 00:00:04,000\n♪ la\n")
    lines = [(r.start, r.end, r.text) for f in ("a.ass", "b.srt") for r in readers.subtitles(spark, str(tmp_path / f)).collect()]
    assert lines == [(1.0, 3.0, "Hello there"), (1.5, 2.0, "Hi")]
    lacking = spark.createDataFrame([(1,)], "id int")
    schema = spark.createDataFrame([(1, "x")], "id int, note string").schema
    assert rows(readers.conform(lacking, schema)) == [(1, None)]


def test_fullest_span_that_holds_a_row(spark):
    df = spark.createDataFrame([(0, 1), (30, 1), (70, 1)], "t int, k int")
    assert {r.t: r.crowd for r in ranks.crowd(df, ["k"], "t", 60).collect()} == {0: 2, 30: 2, 70: 2}


def test_keys_of_both_modes_and_flat(spark):
    from tessella.plans.queries import MAJOR, MINOR

    rotated = lambda p, t: [p[(k - t) % 12] for k in range(12)]
    songs = {1: rotated(MAJOR, 7), 2: rotated(MINOR, 9), 3: [1.0] * 12}
    df = spark.createDataFrame([(s, k, v) for s, p in songs.items() for k, v in enumerate(p)], "song int, pc int, v double")
    got = {r.song: r for r in series.musical_key(df, "song", "pc", "v", MAJOR, MINOR).collect()}
    assert [(got[s].tonic, got[s].major) for s in (1, 2, 3)] == [(7, True), (9, False), (0, True)]
    assert got[1].strength == got[2].strength == 1.0 and got[1].majorness > 0.5 > got[2].majorness and (got[3].strength, got[3].majorness) == (0.0, 0.5)


def test_boundaries_keep_their_distance(spark):
    nov = [0.0, 9.0, 1.0, 5.0, 1.0, 4.0, 1.0, 1.0, 6.0, 1.0, 0.5, 8.0]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(nov)], "k int, i int, v double")
    of = lambda least: sorted(r.i for r in series.boundaries(df, ["k"], "i", "v", least, 0.5).collect())
    assert of(3) == [0, 3, 8] and of(1) == [0, 1, 3, 8, 11]
